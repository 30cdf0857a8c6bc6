import json

from corpusloom import cli, sources
from corpusloom.operators.concat import from_bytes


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_convert(spark, tmp_path):
    path = lines(tmp_path / "t.jsonl", [{"id": i, "text": f"a{i} b c"} for i in range(20)])
    root = str(tmp_path / "out")
    cli.main(["convert", "--path", path, "--out-root", root, "--split", "train", "--concat-tokens", "8", "--eos-id", "2", "--order", "id"])
    chunks = from_bytes(sources.shards(spark, root, "train")).collect()
    assert len(chunks) == 10 and all(len(r["tokens"]) == 8 and r["tokens"][3] == r["tokens"][7] == 2 for r in chunks)
    cli.main(["convert", "--path", path, "--out-root", root, "--split", "raw"])
    assert sources.shards(spark, root, "raw").first()["text"].decode().endswith(" b c")


def test_pairs_and_profile(spark, tmp_path, capsys):
    path = lines(tmp_path / "p.jsonl", [{"inputs": f"what is {i}", "targets": "a number"} for i in range(30)])
    root = str(tmp_path / "out")
    cli.main(["pairs", "--path", path, "--out-root", root, "--preprocessor", "p3"])
    rows = sources.shards(spark, root, "train")
    assert rows.count() == 30 and rows.where("prompt like 'what is %:'").count() == 30
    pairs = str(tmp_path / "pairs")
    rows.write.parquet(pairs)
    cli.main(["profile", "--path", pairs, "--format", "parquet", "--batch", "2", "--length", "16", "--min", "1.5", "--max", "3", "--num", "2"])
    assert "padding_percent" in capsys.readouterr().out


def test_run_report(spark, tmp_path, capsys):
    run = {"name": "base-7b-x", "status": "COMPLETED", "model": "base-7b", "gpu_num": 8, "gpu_type": "a", "seq_len": 2048, "global_batch": 64, "micro_batch": 4, "n_layers": 32, "d_model": 4096, "act_ckpt": True}
    path = lines(tmp_path / "r.jsonl", [run | {"log_lines": ["n_params: 6658859008", "throughput/samples_per_sec: 14.9"]}, run | {"name": "base-7b-y", "log_lines": []}, run | {"name": "base-7b-z", "status": "FAILED", "log_lines": []}])
    cli.main(["runs", "--path", path, "--project", "base", "--filters", "7b"])
    out = capsys.readouterr().out
    assert "base-7b-x" in out and "left out, as figures are missing: base-7b-y" in out and "base-7b-z" not in out


SCORES = """
gauntlet:
  weighting: EQUAL
  subtract_baseline: true
  rescale: true
  categories:
  - name: knowledge
    benchmarks:
    - name: quiz
      num_fewshot: 2
      random_baseline: 0.25
  - name: language
    benchmarks:
    - name: cloze
      num_fewshot: 0
      random_baseline: 0.0
"""


def test_scores(spark, tmp_path, capsys):
    (tmp_path / "c.yaml").write_text(SCORES)
    key = "metrics/{}-shot/InContextLearningMultipleChoiceAccuracy"
    path = lines(tmp_path / "m.jsonl", [{"model": m, "key": key.format(k), "position": i, "value": v} for m, d in (("a", 0.0), ("b", 0.25)) for i, (k, v) in enumerate((("quiz/2", 0.5 + d), ("cloze/0", 0.5)))])
    cli.main(["scores", "--path", path, "--config", str(tmp_path / "c.yaml")])
    out = capsys.readouterr().out
    assert "quiz" in out and out.index("| b") < out.rindex("| a") and "average" in out
    cli.main(["scores", "--path", path, "--config", str(tmp_path / "c.yaml"), "gauntlet.rescale=false", "--out", str(tmp_path / "t")])
    board = {r["model"]: r for r in spark.read.option("header", True).csv(str(tmp_path / "t" / "leaderboard")).collect()}
    assert float(board["a"]["knowledge"]) == 0.25 and float(board["b"]["knowledge"]) == 0.5 and float(board["b"]["average"]) == 0.5


def test_sweep(spark, tmp_path, capsys):
    cli.main(["sweep", "project=speed", "models=[small,large]", "batch_sizes=[64,100]", "microbatch_sizes=[1,4]", "gpu_nums=[8,16]", "--out", str(tmp_path / "s")])
    rows = spark.read.option("header", True).csv(str(tmp_path / "s" / "sweep")).collect()
    got = {(r["model"], int(r["global_batch"]), int(r["micro_batch"]), int(r["gpu_num"])) for r in rows}
    assert got == {(m, b, k, g) for m in ("small", "large") for b in (64, 100, 256) for k in (1, 4) for g in (8, 16) if b % g == 0 and b // g % k == 0}
    assert all(r["name"].startswith("speed-") for r in rows) and len({r["name"] for r in rows}) == len(rows)
