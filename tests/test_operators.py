"""Literal results, properties and small folds of the operators."""

import os
import random
import threading

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom import queries, sinks, sources
from corpusloom.functions import arrays as A
from corpusloom.functions import scalars
from corpusloom.functions import tokenize as K
from corpusloom.operators import collate, concat, denoise, evalagg, icl, masks, packing, pairs, runs, sampling, series
from corpusloom.plans import config


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ids(*values):
    return F.array(*(F.lit(v).cast("long") for v in values))


@pytest.mark.parametrize("kind, expected", [("eos", [0, 0, 0, 0, 1, 1, 1, 2, 2]), ("bos", [0, 0, 0, 1, 1, 1, 2, 2, 2])])
def test_sequence_id(spark, kind, expected):
    assert one(spark, A.sequence_id(ids(0, 1, 2, 5, 0, 1, 5, 0, 6), **{kind: 5})) == expected


def test_sequence_id_needs_one_separator():
    for given_ in ({}, {"eos": 1, "bos": 2}):
        with pytest.raises(ValueError):
            A.sequence_id("x", **given_)


def test_empty_arrays(spark):
    empty = F.expr("cast(array() as array<bigint>)")
    assert one(spark, A.sequence_id(empty, eos=5)) == []
    assert one(spark, A.next_targets(empty)) == []
    assert one(spark, A.with_eos(empty, 2)) == [2]
    assert one(spark, A.fitted(empty, 3, 0)) == [0, 0, 0]


def test_tokenizers_round_trip(spark):
    text = "Ü ß 🙂\n漢"
    assert one(spark, K.code_points(F.lit(text))) == [ord(c) for c in text]
    assert bytes(one(spark, K.byte_tokens(F.lit(text)))).decode() == text
    assert one(spark, K.text_of(K.code_points(F.lit(text)))) == text
    assert one(spark, K.byte_tokens(F.lit(""))) == []
    assert one(spark, K.word_tokens(F.lit(None).cast("string"))) == []


def fold(rows, length, wrap):
    held, out = [], []
    for row in rows:
        held += row
        while len(held) >= length:
            out.append(held[:length])
            held = held[length:] if wrap else []
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.integers(3, 99), max_size=9), max_size=14), st.integers(1, 7))
def test_chunks_equal_the_fold(spark, rows, length):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "k long, t array<long>")
    got = {r["chunk_id"]: r["tokens"] for r in concat.concat_chunks(df, "t", "k", length, eos=(2,), span=3).collect()}
    whole = [r + [2] for r in rows]
    assert [got[i] for i in range(len(got))] == fold(whole, length, True)
    loose = {r["chunk_id"]: r["tokens"] for r in concat.concat_chunks_no_wrap(df, "t", "k", length, eos=(2,)).collect()}
    cut = []
    held = []
    for row in whole:
        held += row
        if len(held) >= length:
            cut.append(held[:length])
            held = []
    assert [loose[i] for i in range(len(loose))] == cut


def test_token_bytes(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, None)], "k long, tokens array<long>")
    raw = concat.to_bytes(df)
    assert raw.where("k = 1").first()["tokens"] == np.array([1, 2, 3], "<i8").tobytes()
    assert {r["k"]: r["tokens"] for r in concat.from_bytes(raw, length=2).collect()} == {1: [1, 2], 2: [], 3: None}


def test_batched_is_row_number(spark):
    df = spark.createDataFrame([(i * 7919 % 1009,) for i in range(300)], "k long")
    got = {r["k"]: (r["batch_id"], r["pos"]) for r in collate.batched(df, "k", 16).collect()}
    for n, k in enumerate(sorted(got)):
        assert got[k] == (n // 16, n % 16)


def test_first_fit_rules():
    full, rest = packing.first_fit([5, 3, 4, 2], list("abcd"), 2, 8, [])
    assert [(b.size, b.members) for b in full] == [(8, ["a", "b"]), (6, ["c", "d"])] and not rest
    full, rest = packing.first_fit([5], ["a"], 3, 8, [])
    assert [(b.size, b.members) for b in full] == [(5, ["a"])]
    full, rest = packing.first_fit([4, 4, 4], list("abc"), 1, 8, [packing.Bin(6, ["z"])])
    assert [(b.size, b.members) for b in full] == [(8, ["a", "b"])]
    assert [(b.size, b.members) for b in rest] == [(6, ["z"]), (4, ["c"])]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 16), max_size=30), st.integers(1, 6))
def test_first_fit_keeps_everything(sizes, bins):
    full, rest = packing.first_fit(sizes, list(range(len(sizes))), bins, 16, [])
    assert sorted(i for b in full + rest for i in b.members) == list(range(len(sizes)))
    assert all(b.size == sum(sizes[i] for i in b.members) <= 16 for b in full + rest)
    assert len(full) == min(bins, len(full) + len(rest))


def test_packed_batches_keep_all_tokens(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(40):
        n = int(rng.integers(1, 12))
        body = [int(x) for x in rng.integers(5, 90, n)]
        rows.append((i // 20, i % 20, [0] * (16 - n) + body, [-100] * (16 - n) + body, [0] * (16 - n) + [1] * n, [0] * 16))
    df = spark.createDataFrame(rows, "batch_id long, pos long, input_ids array<long>, labels array<long>, attention_mask array<int>, bidirectional_mask array<int>")
    out = packing.pack_batches(df, 20, 16, 0).collect()
    assert all(len(r["input_ids"]) == 16 for r in out)
    kept = sorted(x for r in out for x, a in zip(r["input_ids"], r["attention_mask"]) if a)
    assert kept == sorted(x for r in rows for x, a in zip(r[2], r[4]) if a)
    assert all(s == -1 for r in out for s, a in zip(r["sequence_id"], r["attention_mask"]) if not a)


def test_packing_arguments():
    assert packing.raw_batch(2, 5.5) == 11 and packing.raw_batch(2, None) == 2
    for bad in (lambda: packing.raw_batch(2, 0.5), lambda: packing.raw_batch(2, None, 3), lambda: packing.check(8, 2, None, ["decoder_input_ids"]), lambda: packing.check(0, 2, None, [])):
        with pytest.raises(ValueError):
            bad()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 200), st.floats(0.05, 0.9), st.floats(1.0, 20.0), st.integers(0, 9))
def test_span_masks(length, ratio, mean, seed):
    mask = denoise.span_mask(length, ratio, mean, seed)
    assert len(mask) == length and not mask[0]
    if length > 1:
        assert mask.sum() == denoise.counts(length, ratio, mean)[0]


def test_mask_applied():
    tokens, mask = np.array([10, 11, 12, 13, 14]), np.array([False, True, True, False, True])
    rows = lambda marked, sentinels, eos: [x.tolist() for x in denoise.applied(np.tile(tokens, 2), np.repeat([0, 1], len(tokens)), 2, np.tile(mask, 2), np.array(marked), np.array(sentinels), eos)]
    assert rows([False, True], [99, 98], 2) == [[10, 13, 2, 10, 99, 13, 98, 2], [0, 0, 0, 1, 1, 1, 1, 1]]
    assert rows([True, False], [99], None) == [[10, 99, 13, 99, 10, 13], [0, 0, 0, 0, 1, 1]]


def test_noisers_are_checked():
    for bad in ([(-1, 0.2)], [(3, 1.0)], [(3, 0.0)]):
        with pytest.raises(ValueError):
            denoise.noisers(bad, None)
    for bad in ([0.0], [1.5]):
        with pytest.raises(ValueError):
            denoise.noisers(None, bad)
    with pytest.raises(ValueError):
        denoise.noisers(None, None)
    assert [denoise.ul2_prefix(*x) for x in ((0.2, None), (1.0, None), (0.15, 3), (0.5, 3), (0.15, 12))] == ["[S2S]", "[CLM]", "[NLU]", "[NLG]", "[NLG]"]


def test_denoising_is_a_function_of_seed_and_row(spark):
    df = spark.createDataFrame([(i, list(range(5, 5 + i))) for i in range(0, 60, 3)] + [(999, None)], "k long, t array<long>")
    kinds = denoise.noisers([(3.0, 0.15)], [0.25])
    first = {r["k"]: r for r in denoise.denoised(df, "t", "k", 128, kinds).collect()}
    again = {r["k"]: r for r in denoise.denoised(df.repartition(5), "t", "k", 128, kinds).collect()}
    assert first == again and 999 not in first and 0 not in first
    assert all(len(r[c]) == 128 for r in first.values() for c in ("input_ids", "labels", "attention_mask"))


def test_alpaca_needs_one_mark(spark):
    df = spark.createDataFrame([("a ### Response: b ### Response: c",)], "text string")
    with pytest.raises(Exception, match="once"):
        pairs.alpaca(df).collect()


def test_multiple_choice(spark):
    df = spark.createDataFrame([("q", ["a", "b"], 1), ("q", ["a", "b"], -1), ("q", ["a"], 5), ("q", [], 0), ("q", None, 0)], "query string, choices array<string>, gold long")
    assert [r["response"] for r in pairs.multiple_choice(df).collect()] == ["b", "b", None, None, None]
    assert pairs.multiple_choice(df).first()["prompt"] == "q\nOptions:\n - a\n - b\nAnswer: "


def test_registry():
    with pytest.raises(ValueError):
        pairs.register("alpaca")(lambda df: df)
    with pytest.raises(ValueError):
        pairs.resolve("no_such")
    with pytest.raises(ValueError):
        pairs.mapped(None, {"response": "a", "prompt": "b"})
    assert pairs.resolve(None, "p3") is pairs.p3


def test_prompt_filter_counts_what_it_drops(spark):
    from pyspark.sql import Observation

    seen = Observation()
    df = spark.createDataFrame([([1],), ([1, 2, 3],), ([],)], "ids array<long>")
    assert pairs.shorter_prompts(df, "ids", 3, seen).count() == 2
    assert seen.get["dropped"] == 1


def test_collation_cuts_the_front_of_long_targets(spark):
    df = spark.createDataFrame([(1, [4, 5], [6, 7, 8, 9])], "k long, context array<long>, target array<long>")
    row = collate.decoder_only(df, 5, 0, 2).first()
    assert row["input_ids"] == [4, 5, 8, 9, 2] and row["labels"] == [-100, -100, 8, 9, 2] and row["bidirectional_mask"] == [1, 1, 0, 0, 0]
    assert collate.decoder_only(df, 2, 0, 2).count() == 0
    right = collate.decoder_only(df, 9, 0, 2, side="right").first()
    assert right["input_ids"] == [4, 5, 6, 7, 8, 9, 2, 0, 0] and right["attention_mask"] == [1] * 7 + [0, 0]


def test_first_batch_keeps_its_length(spark):
    df = spark.createDataFrame([(b, [0] * 12 + [1] * 4, [0] * 12 + [7] * 4) for b in (0, 1)], "batch_id long, attention_mask array<int>, input_ids array<long>")
    got = {r["batch_id"]: r["input_ids"] for r in collate.trimmed(df, ("input_ids", "attention_mask")).collect()}
    assert len(got[0]) == 16 and got[1] == [0] * 4 + [7] * 4


def test_gauntlet_rescaling(spark):
    log = spark.createDataFrame([("m", "metrics/a/0-shot/InContextLearningMultipleChoiceAccuracy", 0, 0.30), ("m", "other", 1, 9.0)], "model string, key string, position long, value double")
    benchmarks = evalagg.weights(spark.createDataFrame([("c", "a", "0", 0.25), ("none", "b", "0", 0.5)], "category string, benchmark string, num_shot string, baseline double"), None)
    got = {r["category"]: round(r["score"], 4) for r in evalagg.gauntlet(log, benchmarks).collect()}
    assert got == {"c": 0.0667, "none": 0.0, "average": 0.0333}


def test_plain_key_replaces_subtasks(spark):
    key = "metrics/a/0-shot{}/InContextLearningLMAccuracy"
    log = spark.createDataFrame([("m", key.format("/x"), 0, 0.0), ("m", key.format(""), 1, 0.4), ("m", key.format("/y"), 2, 0.8)], "model string, key string, position long, value double")
    assert evalagg.averaged(log).first()["value"] == pytest.approx(0.6)


def test_published_utilisation(spark):
    seqs = 30596 / 2048
    assert one(spark, scalars.mfu(F.lit(6658859008.0), F.lit(32.0), F.lit(4096.0), F.lit(2048.0), F.lit(seqs), F.lit(8.0))) == pytest.approx(52.92, abs=0.02)


def test_microbatches(spark):
    assert one(spark, scalars.microbatches(F.lit(48), F.lit(11))) == [11, 11, 11, 11, 4]


def test_chat_and_few_shot(spark):
    items = spark.createDataFrame([(1, "The tap ran, therefore", "the bath filled."), (2, "Rain fell, so", "roofs shone.")], "k long, c string, a string")
    rows = {r["k"]: r for r in icl.prompts(items, "k", "c", "a", icl.Task("t", "multiple_choice"), 1).collect()}
    assert rows[1]["prompt"] == "Rain fell, so roofs shone.\nThe tap ran, therefore" and rows[1]["continuation"] == " the bath filled."
    assert one(spark, icl.qa_correct(F.lit("The  Cat! sat"), F.array(F.lit("cat"), F.lit("dog"))))
    with pytest.raises(ValueError):
        icl.Task("t", "no_such")


def test_attention_matrix(spark):
    df = spark.createDataFrame([(1, [0, 0, 0, 0, 1, 1, 1, 1], [1, 1, 0, 0, 1, 1, 1, 0])], "k long, s array<int>, p array<int>")
    got = {(r["i"], r["j"]) for r in masks.attention_pairs(df, "k", "s", "p").collect()}
    seq, pre = [0] * 4 + [1] * 4, [1, 1, 0, 0, 1, 1, 1, 0]
    assert got == {(i, j) for i in range(8) for j in range(8) if seq[i] == seq[j] and (j <= i or pre[i] and pre[j])}


def test_alibi_slopes():
    assert masks.alibi_slopes(8) == [2.0**-h for h in range(1, 9)]
    assert len(masks.alibi_slopes(12)) == 12 and masks.alibi_slopes(12)[0] == 2.0**-1


def test_outliers_equal_the_queues(spark):
    rng = np.random.default_rng(3)
    values = rng.gamma(1.0, 1.0, 80).tolist()
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "m string, s long, v double")
    got = [r["outlier"] for r in series.outliers(df, "m", "s", "v", 5, 2.0).orderBy("s").collect()]
    expected = []
    for i, v in enumerate(values):
        past = values[max(0, i - 9) : max(0, i - 4)]
        expected.append(bool(past) and v > 2.0 * sum(past) / len(past))
    assert got == expected


def test_nucleus(spark):
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([3, 2, 1, 0])], "k long, t long, x double")
    kept = {r["t"]: r["p"] for r in sampling.nucleus(df, "k", "t", "x", top_p=0.8).collect()}
    assert set(kept) == {0, 1} and sum(kept.values()) == pytest.approx(1.0)


def test_weighted_sampling_counts(spark):
    df = spark.createDataFrame([(i, "a" if i % 10 else "b") for i in range(500)], "k long, s string")
    got = sampling.weighted(df, "s", "k", {"a": 0.5, "b": 0.5}, 400).groupBy("s").agg(F.sum("draws").alias("n"))
    assert {r["s"]: r["n"] for r in got.collect()} == {"a": 200, "b": 200}


def test_shards(spark, tmp_path):
    root = str(tmp_path / "set")
    df = spark.range(25).withColumn("text", F.col("id").cast("string"))
    sinks.write_shards(df, root, "train", rows_a_shard=10)
    assert sources.shards(spark, root, "train").count() == 25
    with pytest.raises(FileExistsError):
        sinks.write_shards(df, root, "train")
    with pytest.raises(FileExistsError):
        sinks.guard(spark, root, ["train"])
    with pytest.raises(FileNotFoundError):
        sources.shards(spark, root, "val")
    next((tmp_path / "set" / "split=train").glob("part-*")).write_bytes(b"changed")
    with pytest.raises(FileNotFoundError):
        sources.shards(spark, root, "train")


def test_probe_order_and_formats(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        sources.probe(spark, str(tmp_path), "train")
    (tmp_path / "train.csv").write_text("a,b\n1,x\n")
    assert sources.probe(spark, str(tmp_path), "train").columns == ["a", "b"]
    (tmp_path / "train.jsonl").write_text('{"c": 1}\n')
    assert sources.probe(spark, str(tmp_path), "train").columns == ["c"]


def test_folders_are_not_entered(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.json").write_text('{"x": 1}\n')
    (tmp_path / "sub" / "b.json").write_text('{"x": 2}\n')
    assert sources.json_rows(spark, str(tmp_path), "x long").count() == 1


def test_prompts_from_files(spark, tmp_path):
    path = tmp_path / "p.txt"
    path.write_text("one\ntwo\nthree\n")
    assert sources.prompt(spark, f"file::{path}").first()["prompt"] == "one\ntwo\nthree\n"
    assert sources.prompt(spark, "hi").first()["prompt"] == "hi"
    assert [r["prompt"] for r in sources.prompt_lines(spark, str(path), 2).collect()] == ["one", "two"]
    assert sources.prompt_lines(spark, None, 2).first()["prompt"] == "<|endoftext|>"


def test_settings_files():
    read = config.parse_yaml("a:\n  b: 1\n  c: [x, 2]\nlist:\n- name: n1\n  v: 1.5\n- name: n2\nflag: true\nref: ${a.b}/x\n")
    assert config.resolved(read) == {"a": {"b": 1, "c": ["x", 2]}, "list": [{"name": "n1", "v": 1.5}, {"name": "n2"}], "flag": True, "ref": "1/x"}
    assert config.merged({"a": {"b": 1, "c": 2}}, config.from_dots(["a.b=3"])) == {"a": {"b": 3, "c": 2}}


def test_batch_plan(spark):
    assert config.batch_plan(64, 8, 4) == {"device_batch": 8, "micro_batch": 4, "grad_accum": 2}
    with pytest.raises(ValueError):
        config.batch_plan(10, 4, 1)
    with pytest.raises(ValueError, match="Your dataset"):
        config.check_rows(spark.range(3), 2, 4)
    with pytest.raises(ValueError):
        config.check_loader("text", "hf_t5")


def test_booleans(spark):
    with pytest.raises(Exception, match="not a boolean"):
        spark.range(1).select(scalars.to_bool(F.lit("maybe"))).collect()


def test_run_sizes(spark):
    assert one(spark, runs.parameters(F.lit("mpt-125m-x"))) == 125e6
    with pytest.raises(Exception, match="no size"):
        spark.range(1).select(runs.size_of(F.lit("mpt-7q"))[0]).collect()


def test_streaming_packing(spark, tmp_path):
    from corpusloom import streaming

    rows = [("a", i, s) for i, s in enumerate([5, 3, 4, 2, 7])]
    spark.createDataFrame(rows, "w string, i long, n long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("w string, i long, n long").parquet(str(tmp_path / "in"))
    job = streaming.packed_sizes(stream, "w", "i", "n", 2, 8, 4).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    job.awaitTermination()
    got = {tuple(sorted(r["members"])): r["used"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    full, _ = packing.first_fit([5, 3, 4, 2, 7], list(range(5)), 2, 8, [])
    assert got == {tuple(sorted(b.members)): b.size for b in full}


def test_plans_push_down(spark, folder):
    df = sources.lazy(spark, f"{folder}/documents.parquet").where("lang = 'en'").select("doc_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "text" not in plan.split("ReadSchema")[1]


def test_core_doesnt_know_the_subpackage():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "corpusloom"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"^\s*(?:from|import)\s.*\bllm\b", path.read_text(), re.M), path


@pytest.mark.parametrize("length, span, seed", [(7, 5, 0), (16, 3, 1), (50, 8, 2), (1, 4, 3), (500, 2, 4)])
def test_no_wrap_chunks_against_a_fold(spark, length, span, seed):
    """Spans far smaller than chunks and the other way round, empty and null rows, sparse orders, two mixed streams."""
    rng = random.Random(seed)
    rows, order = [], 0
    for _ in range(120):
        order += rng.choice([1, 1, 2, 900])
        rows.append((order, rng.randrange(2), rng.choice([None, [], *([rng.randrange(9) for _ in range(rng.randrange(1, 30))] for _ in range(6))])))
    want, held = {}, {}
    for _, stream, ids in rows:
        own, n = held.get(stream, ([], 0))
        own = own + [1] * (length > 7) + (ids or []) + [2] * (length > 7)
        if len(own) >= length:
            want[stream, n] = own[:length]
            own, n = [], n + 1
        held[stream] = own, n
    df = spark.createDataFrame(rows, "k long, s int, t array<long>").repartition(4)
    got = concat.concat_chunks_no_wrap(df, "t", "k", length, (1,) * (length > 7), (2,) * (length > 7), stream="s", span=span).collect()
    assert {(r["stream"], r["chunk_id"]): r["tokens"] for r in got} == want and len(got) == len(want)
    assert concat.concat_chunks_no_wrap(df.limit(0), "t", "k", length).count() == 0


def test_settings_over_http(tmp_path):
    import functools
    import http.server
    import threading

    (tmp_path / "c.yaml").write_text("model:\n  name: small\n")
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        assert sources.settings(f"http://127.0.0.1:{server.server_port}/c.yaml") == {"model": {"name": "small"}}
    finally:
        server.shutdown()


def test_loaders_are_checked():
    with pytest.warns(UserWarning):
        assert config.checked_loaders("hf_t5", [{"name": "text_denoising", "decoder_only_format": True}])[0]["decoder_only_format"] is False
    assert config.checked_loaders("hf_prefix_lm", [{"name": "text_denoising", "decoder_only_format": True}, {"name": "finetuning"}])[1] == {"name": "finetuning"}
    for model, loaders, icl_ in (("hf_t5", [{"name": "text"}], False), ("hf_causal_lm", [{"name": "text_denoising"}], False), ("hf_t5", [{"name": "finetuning"}], True)):
        with pytest.raises(ValueError):
            config.checked_loaders(model, loaders, icl_)


def test_unknown_attention_is_an_error(spark):
    flags = [F.lit(False)] * 4
    with pytest.raises(Exception, match="unknown attention"):
        spark.range(1).select(masks.bias_shape(F.lit("other"), F.lit(8), F.lit(16), *flags)).collect()


def test_vocabulary_must_be_there(spark):
    with pytest.raises(FileNotFoundError):
        K.shipped(spark, "/nowhere/vocabulary.json")


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.fixture
def vocabulary():
    pytest.importorskip("tokenizers")
    if not os.path.isfile(VOCABULARY):
        pytest.skip("no vocabulary file here")
    return VOCABULARY


def test_vocabulary_memory_of_a_large_batch(spark, vocabulary):
    """One batch of 10,000 texts, 24 MB: a worker holds the ids of a slice, not of the batch."""
    psutil = pytest.importorskip("psutil")
    most, over = 0, threading.Event()

    def watch():
        nonlocal most
        while not over.wait(0.05):
            for p in psutil.Process().children(recursive=True):
                try:
                    if "pyspark.daemon" in " ".join(p.cmdline()):
                        most = max(most, p.memory_info().rss)
                except psutil.Error:
                    pass

    text = F.expr("array_join(transform(sequence(1, 400), i -> concat('word', pmod(hash(id, i), 5000))), ' ')")
    watching = threading.Thread(target=watch)
    watching.start()
    try:
        row = spark.range(0, 10_000, numPartitions=1).select(F.size(K.vocabulary_tokens(vocabulary)(text)).alias("n")).agg(F.sum("n"), F.count("n")).first()
    finally:
        over.set()
        watching.join()
    assert row[0] > 4_000_000 and row[1] == 10_000
    assert 0 < most < 500e6


def test_vocabulary_ids_of_odd_texts(vocabulary, monkeypatch):
    """Parts, kept or not, pieces of long texts and texts back, against the vocabulary on whole texts."""
    rng = random.Random(5)
    pool = [*" " * 8, *"\n\t\r\x0b\x1c\x85\xa0\u2003\u200b\u3000\ufeff\u0301'sab12!\x00é中٣²🙂Ġ", "'s", "'ll", "<|endoftext|>", "x" * 70]
    texts = ["", " ", "a" * 500, *("".join(rng.choices(pool, k=rng.randrange(40))) for _ in range(3000))]
    for slice_, kept in ((1 << 17, 1 << 16), (7, 50)):
        monkeypatch.setattr(K, "SLICE", slice_)
        monkeypatch.setattr(K, "KEPT", kept)
        v = K._Vocabulary(vocabulary)
        assert v.by_parts
        ids = [np.frombuffer(x, np.int64).tolist() for x in v.ids(texts)]
        assert ids == [e.ids for e in v.vocabulary.encode_batch(texts, add_special_tokens=False)]
        assert v.texts(ids) == texts
        some = [[rng.randrange(50_257) for _ in range(rng.randrange(6))] for _ in range(500)]
        assert v.texts(some) == v.vocabulary.decode_batch(some, skip_special_tokens=False)
        assert v.texts([[1, 60_000, 2]]) == v.vocabulary.decode_batch([[1, 60_000, 2]], skip_special_tokens=False)


def test_vocabulary_of_whole_texts(spark, tmp_path):
    """A vocabulary whose texts don't fall into independent parts; null, empty and long texts."""
    tokenizers = pytest.importorskip("tokenizers")
    v = tokenizers.Tokenizer(tokenizers.models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    v.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    v.save(path := str(tmp_path / "words.json"))
    df = spark.createDataFrame([(0, None), (1, ""), (2, "a b"), (3, "b " * 200_000), (4, "c a")], "id long, text string").coalesce(1)
    rows = df.select("id", K.vocabulary_tokens(path)("text").alias("ids")).select("id", F.size("ids"), F.slice("ids", 1, 3), F.substring(K.vocabulary_text(path)("ids"), 1, 5)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(0, 0, [], ""), (1, 0, [], ""), (2, 2, [0, 1], "a b"), (3, 200_000, [1, 1, 1], "b b b"), (4, 2, [2, 0], "? a")]


def test_vocabulary_ids_are_made_once(spark, folder, vocabulary, monkeypatch):
    monkeypatch.setenv("CORPUSLOOM_VOCABULARY", vocabulary)
    plan = queries.queries()["TOK1_byte_pair_vocabulary"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("run(text") == 1 and plan.count("run(") == 2, plan
