"""Runs, utilisation, series, reductions, sweeps and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import scalars
from ..operators import runs as R
from ..operators import series
from .base import query

# A run a part: sizes, lengths and devices are made of its numbers.
RUNS = """(SELECT p_partkey AS run_id, 'base-' || CASE p_partkey % 4 WHEN 0 THEN '125m' WHEN 1 THEN '1b' WHEN 2 THEN '7b' ELSE '30b' END || '-' || p_partkey AS name,
 'base-' || CASE p_partkey % 4 WHEN 0 THEN '125m' WHEN 1 THEN '1b' WHEN 2 THEN '7b' ELSE '30b' END AS model,
 CASE p_partkey % 5 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'RUNNING' ELSE 'COMPLETED' END AS status, CASE p_partkey % 4 WHEN 0 THEN 125e6 WHEN 1 THEN 1.3e9 WHEN 2 THEN 6.7e9 ELSE 30e9 END::DOUBLE AS n_params,
 (12 + p_partkey % 37)::BIGINT AS n_layers, (768 + 64 * (p_partkey % 50))::BIGINT AS d_model, (CASE p_partkey % 3 WHEN 0 THEN 512 WHEN 1 THEN 2048 ELSE 8192 END)::BIGINT AS seq_len,
 (CASE p_partkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 64 END)::BIGINT AS gpu_num, (p_size * 64)::BIGINT AS global_batch, (1 + p_partkey % 6)::BIGINT AS micro_batch, p_partkey % 2 = 0 AS act_ckpt, p_retailprice / 100 AS samples_per_sec FROM part)"""


def _runs(t):
    k = F.col("p_partkey")

    def pick(n, *values):
        out = F.lit(values[-1])
        for i in reversed(range(len(values) - 1)):
            out = F.when(k % n == i, values[i]).otherwise(out)
        return out

    size = pick(4, "125m", "1b", "7b", "30b")
    return t.part.select(
        k.alias("run_id"), F.concat(F.lit("base-"), size, F.lit("-"), k.cast("string")).alias("name"), F.concat(F.lit("base-"), size).alias("model"), pick(5, "FAILED", "RUNNING", "COMPLETED").alias("status"),
        pick(4, 125e6, 1.3e9, 6.7e9, 30e9).alias("n_params"), (12 + k % 37).alias("n_layers"), (768 + 64 * (k % 50)).alias("d_model"), pick(3, 512, 2048, 8192).cast("long").alias("seq_len"), pick(3, 8, 16, 64).cast("long").alias("gpu_num"),
        (F.col("p_size") * 64).cast("long").alias("global_batch"), (1 + k % 6).alias("micro_batch"), (k % 2 == 0).alias("act_ckpt"), (F.col("p_retailprice") / 100).alias("samples_per_sec"),
    )


@query(f"SELECT run_id, name, status, gpu_num FROM {RUNS}")
def SRC11_run_catalogue(t):
    from .. import sources

    path = t.scratch()
    _runs(t).withColumn("log_lines", F.array(F.lit("start"))).write.json(path)
    return sources.runs(t.spark, path).select(F.regexp_extract("name", r"(\d+)$", 1).cast("long").alias("run_id"), "name", "status", "gpu_num")


@query(f"SELECT run_id, name FROM {RUNS} WHERE contains(name, 'base') AND contains(name, '7b') AND contains(name, '-1')")
def FLT3_run_names(t):
    return R.named(_runs(t), "base", ("7b", "-1")).select("run_id", "name")


@query(f"SELECT run_id, status FROM {RUNS} WHERE status = 'COMPLETED'")
def FLT4_finished_runs(t):
    return R.finished(_runs(t)).select("run_id", "status")


@query(f"SELECT ok, count(*)::BIGINT AS n FROM (SELECT (CASE WHEN run_id % 7 > 0 THEN n_params END) IS NOT NULL AS ok FROM {RUNS}) GROUP BY ok")
def FLT5_readable_runs(t):
    good, bad = R.readable(_runs(t).withColumn("n_params", F.when(F.col("run_id") % 7 > 0, F.col("n_params"))), ("n_params", "seq_len"))
    return good.select(F.lit(True).alias("ok")).unionAll(bad.select(F.lit(False).alias("ok"))).groupBy("ok").agg(F.count("*").alias("n"))


@query(f"SELECT run_id FROM {RUNS} WHERE n_params * 16 <= gpu_num * 40e9")
def FLT6_fits_memory(t):
    return R.fits_memory(_runs(t), 16, 40e9).select("run_id")


@query(f"SELECT run_id FROM {RUNS} WHERE gpu_num * 8 <= global_batch")
def FLT7_fits_batch(t):
    return R.fits_batch(_runs(t), 8).select("run_id")


@query("SELECT 'enough' AS given, 'accepted' AS outcome UNION ALL SELECT 'too few', 'Your dataset'")
def FLT8_smallest_dataset(t):
    from ..plans.config import check_rows

    out = []
    for given, world in (("enough", 2), ("too few", 1 << 40)):
        try:
            check_rows(t.copa, 8, world)
            out.append((given, "accepted"))
        except ValueError as said:
            out.append((given, str(said)[:12]))
    return t.rows(out, "given string, outcome string")


@query("SELECT pair_id FROM tasks WHERE right(response, 1) IN ('.', '?')")
def FLT11_stop_tokens(t):
    from ..functions.tokenize import code_points

    rows = t.tasks.where(F.length("response") > 0).select("pair_id", code_points(F.substring("response", -2, 2)).alias("ids"))
    return rows.where(F.element_at("ids", -1).isin(46, 63)).select("pair_id")


@query("SELECT vec_id FROM embeddings WHERE label IN (1, 3) AND embedding IS NOT NULL")
def FLT12_parameter_groups(t):
    return t.embeddings.where(F.col("embedding").isNotNull() & F.col("label").isin(1, 3)).select("vec_id")


@query("SELECT text, value FROM (VALUES ('True', true), ('f', false), ('1', true), ('NO', false), ('y', true)) v(text, value)")
def FLT13_booleans(t):
    rows = t.rows([("True",), ("f",), ("1",), ("NO",), ("y",)], "text string")
    return rows.select("text", scalars.to_bool(F.col("text")).alias("value"))


UTILISATION = f"""SELECT run_id, (samples_per_sec * seq_len)::BIGINT AS x, CAST(floor(samples_per_sec * seq_len) AS BIGINT) AS tokens_per_sec, CAST(floor(samples_per_sec * seq_len / gpu_num) AS BIGINT) AS tokens_per_sec_gpu,
 round(100.0 * (6.0 * seq_len * n_params + 12.0 * n_layers * d_model * seq_len * seq_len) * samples_per_sec / (gpu_num * 312e12), 2) AS mfu,
 round(100.0 * CASE WHEN act_ckpt THEN 8.0 * seq_len * n_params + 16.0 * n_layers * d_model * seq_len * seq_len ELSE 6.0 * seq_len * n_params + 12.0 * n_layers * d_model * seq_len * seq_len END * samples_per_sec / (gpu_num * 312e12), 2) AS hfu,
 ceil(global_batch::DOUBLE / gpu_num / micro_batch)::BIGINT AS grad_accum FROM {RUNS}"""


@query(UTILISATION.replace("(samples_per_sec * seq_len)::BIGINT AS x, ", ""))
def AGG14_utilisation(t):
    return R.utilisation(_runs(t)).select("run_id", "tokens_per_sec", "tokens_per_sec_gpu", "mfu", "hfu", F.col("grad_accum").cast("long").alias("grad_accum"))


@query(f"SELECT run_id, round((2.0 * n_params * seq_len + n_layers * 4.0 * d_model * seq_len * seq_len) * 3 * global_batch, 0) AS flops FROM {RUNS}")
def AGG15_flops_per_batch(t):
    c = {x: F.col(x).cast("double") for x in ("n_params", "n_layers", "d_model", "seq_len", "global_batch")}
    return _runs(t).select("run_id", F.round(scalars.flops_per_batch(c["n_params"], c["n_layers"], c["d_model"], c["seq_len"], c["global_batch"]), 0).alias("flops"))


LINES = "list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, 'throughput/tokens_per_sec: (\\d+)'))"


@query(f"SELECT doc_id, regexp_extract({LINES}[-1], 'throughput/tokens_per_sec: (\\d+)', 1)::BIGINT AS last, regexp_extract({LINES}[1], 'throughput/tokens_per_sec: (\\d+)', 1)::BIGINT AS first FROM documents WHERE kind = 'log' AND len({LINES}) > 0")
def AGG16_log_figures(t):
    lines = F.split("text", "\n")
    pattern = r"throughput/tokens_per_sec: (\d+)"
    rows = t.documents.where("kind = 'log'").select("doc_id", R.last_match(lines, pattern).cast("long").alias("last"), R.first_match(lines, pattern).cast("long").alias("first"))
    return rows.where("last is not null")


@query("SELECT dataset_name, folder_split, (raw_samples * (chars_per_sample // chars_per_token)) // 2048 AS samples FROM data_splits WHERE chars_per_token > 0")
def AGG17_progress_estimate(t):
    rows = t.data_splits.where("chars_per_token > 0")
    return rows.select("dataset_name", "folder_split", F.expr("(raw_samples * (chars_per_sample div chars_per_token)) div 2048").alias("samples"))


@query("SELECT batch::BIGINT AS batch, micro::BIGINT AS micro, array_to_string(list_concat(list_resize([]::BIGINT[], batch // micro, micro), CASE WHEN batch % micro > 0 THEN [batch % micro] ELSE [] END), ',') AS sizes FROM (VALUES (48, 11), (48, 12), (5, 8)) v(batch, micro)")
def AGG18_microbatches(t):
    from .base import joined

    return t.rows([(48, 11), (48, 12), (5, 8)], "batch long, micro long").select("batch", "micro", joined(scalars.microbatches(F.col("batch"), F.col("micro"))).alias("sizes"))


@query("""WITH p AS (SELECT vec_id % 7 AS label, embedding AS e, vec_id % len(embedding) AS target, ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE)))) AS total FROM embeddings)
SELECT label, round(exp(avg(total - e[target + 1]::DOUBLE)), 6) AS perplexity, round(avg((list_position(e, list_max(e)) - 1 = target)::INT), 6) AS accuracy FROM p GROUP BY label""")
def AGG19_model_metrics(t):
    """Vectors as logits of one prediction each: cross entropy, perplexity and accuracy per label."""
    from ..operators.icl import accuracy, perplexity

    rows = t.embeddings.withColumn("target", F.col("vec_id") % F.size("embedding"))
    return rows.groupBy((F.col("vec_id") % 7).alias("label")).agg(F.round(perplexity(A.cross_entropy("embedding", "target")), 6).alias("perplexity"), F.round(accuracy(A.argmax("embedding") == F.col("target")), 6).alias("accuracy"))


@query("WITH b AS (SELECT least(floor(l_discount * 100 / 11 * 10), 9) AS b, avg(l_discount * 100 / 11) AS c, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS a, count(*) AS n FROM lineitem GROUP BY 1) SELECT round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM b")
def AGG19_calibration_error(t):
    from ..operators.icl import calibration_error

    rows = t.lineitem.select((F.col("l_discount") * 100 / 11).alias("confidence"), (F.col("l_returnflag") == "R").alias("correct"))
    return calibration_error(rows, "confidence", "correct").select(F.round("ece", 6).alias("ece"))


@query("SELECT vec_id, round(0.0001 * pow(ln(list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE)))), 2), 9) AS z FROM embeddings")
def AGG20_z_loss(t):
    return t.embeddings.select("vec_id", F.round(A.z_loss("embedding", 0.0001), 9).alias("z"))


@query("SELECT cluster, pow(2, k)::BIGINT AS gpu_num FROM (VALUES ('r1', 64::BIGINT), ('r2', 24), ('r3', 1)) c(cluster, most), range(0, 8) r(k) WHERE k <= ceil(log2(greatest(most, 1)))")
def AGG21_GEN_gpu_counts(t):
    clusters = t.rows([("r1", "a", 64), ("r1", "b", 8), ("r2", "a", 24), ("r3", "a", 0)], "cluster string, gpu_type string, gpus long")
    return R.gpu_counts(clusters)


# Ranks' metrics: norms and a cosine of each rank's share of the embeddings.
RANKS = """(SELECT label::BIGINT AS rank, 'l2_norm/moment/' || (vec_id % 3) AS metric, sqrt(sum(embedding[1]::DOUBLE ** 2)) AS value FROM embeddings GROUP BY ALL
UNION ALL SELECT label, 'l2_norm/grad/' || (vec_id % 3), sqrt(sum(embedding[2]::DOUBLE ** 2)) FROM embeddings GROUP BY ALL
UNION ALL SELECT label, 'cosine/moment_grad/' || (vec_id % 3), sum(embedding[1]::DOUBLE * embedding[2]::DOUBLE) / sqrt(sum(embedding[1]::DOUBLE ** 2)) / sqrt(sum(embedding[2]::DOUBLE ** 2)) FROM embeddings GROUP BY ALL
UNION ALL SELECT label, 'loss/train', avg(embedding[3]::DOUBLE) FROM embeddings GROUP BY ALL)"""


def _ranks(t):
    e = t.embeddings.select(F.col("label").cast("long").alias("rank"), (F.col("vec_id") % 3).cast("string").alias("part"), *(F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(3)))
    per = e.groupBy("rank", "part").agg(F.sqrt(F.sum(F.col("x0") ** 2)).alias("a"), F.sqrt(F.sum(F.col("x1") ** 2)).alias("b"), F.sum(F.col("x0") * F.col("x1")).alias("d"))
    rows = per.select("rank", F.explode(F.array(
        F.struct(F.concat(F.lit("l2_norm/moment/"), "part").alias("metric"), F.col("a").alias("value")), F.struct(F.concat(F.lit("l2_norm/grad/"), "part").alias("metric"), F.col("b").alias("value")),
        F.struct(F.concat(F.lit("cosine/moment_grad/"), "part").alias("metric"), (F.col("d") / F.col("a") / F.col("b")).alias("value")))).alias("m")).select("rank", "m.*")
    return rows.unionByName(e.groupBy("rank").agg(F.avg("x2").alias("value")).select("rank", F.lit("loss/train").alias("metric"), "value"))


@query(f"""WITH r AS {RANKS}, n AS (SELECT metric, sqrt(sum(value * value)) AS value FROM r WHERE starts_with(metric, 'l2_norm') GROUP BY metric)
SELECT metric, round(value, 6) AS value FROM n
UNION ALL SELECT metric, round(sum(value) / 4, 6) FROM r WHERE metric = 'loss/train' GROUP BY metric
UNION ALL SELECT c.metric, round(sum(c.value * a.value * b.value) / any_value(na.value) / any_value(nb.value), 6) FROM r c JOIN r a ON a.rank = c.rank AND a.metric = 'l2_norm/moment/' || right(c.metric, 1) JOIN r b ON b.rank = c.rank AND b.metric = 'l2_norm/grad/' || right(c.metric, 1)
 JOIN n na ON na.metric = a.metric JOIN n nb ON nb.metric = b.metric WHERE starts_with(c.metric, 'cosine') GROUP BY c.metric""")
def AGG9_JON5_reduced_over_ranks(t):
    return series.reduced(_ranks(t), 4).select("metric", F.round("value", 6).alias("value"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def AGG10_l2_norms(t):
    return t.embeddings.select("vec_id", F.round(A.l2_norm("embedding"), 6).alias("norm"))


@query("SELECT sum(p_size)::BIGINT AS n_params, sum(CASE WHEN p_brand LIKE '%1%' THEN p_size ELSE 0 END)::BIGINT AS n_trainable, round(100.0 * sum(CASE WHEN p_brand LIKE '%1%' THEN p_size ELSE 0 END) / sum(p_size), 6) AS percent FROM part")
def AGG11_parameter_counts(t):
    rows = t.part.select(F.col("p_name").alias("name"), F.col("p_size").cast("long").alias("size"), F.col("p_brand").contains("1").alias("trainable"))
    return R.parameter_counts(rows).withColumn("percent", F.round("percent", 6))


@query("SELECT sum(length(prompt))::BIGINT AS input_tokens, sum(greatest(length(response), 1))::BIGINT AS output_tokens FROM tasks WHERE response IS NOT NULL")
def AGG12_generation_totals(t):
    rows = t.tasks.where("response is not null").select(F.length("prompt").cast("long").alias("prompt_tokens"), (F.length("prompt") + F.length("response")).cast("long").alias("total_tokens"), F.lit(0.5).alias("seconds"))
    return R.generation_totals(rows).select("input_tokens", "output_tokens")


TIMES = "(SELECT o_orderkey % 3 + 1 AS batch, (o_orderkey % 2 + 1) * 16 AS output_len, row_number() OVER (PARTITION BY o_orderkey % 3, o_orderkey % 2 ORDER BY o_orderkey) - 1 AS i, o_totalprice / 1000.0 AS seconds FROM orders)"


@query(f"SELECT batch, output_len, round(avg(seconds), 6) AS mean_seconds, round(batch * output_len / avg(seconds), 6) AS tokens_per_sec, round(avg(seconds) * 1000 / output_len, 6) AS ms_per_token FROM {TIMES} WHERE i >= 5 GROUP BY batch, output_len")
def AGG13_JON8_latency(t):
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    rows = t.orders.select((k % 3 + 1).alias("batch"), ((k % 2 + 1) * 16).alias("output_len"), (F.row_number().over(Window.partitionBy(k % 3, k % 2).orderBy(k)) - 1).alias("i"), (F.col("o_totalprice") / 1000.0).alias("seconds"))
    out = R.latency(rows, 5, ("batch", "output_len"))
    return out.select("batch", "output_len", *(F.round(c, 6).alias(c) for c in ("mean_seconds", "tokens_per_sec", "ms_per_token")))


@query(f"SELECT run_id, row_number() OVER (ORDER BY CASE WHEN model LIKE '%b' THEN 1 ELSE 0 END DESC, regexp_extract(model, '(\\d+)', 1)::INT DESC, seq_len DESC, gpu_num DESC, global_batch DESC, run_id)::BIGINT AS place FROM {RUNS}")
def SRT1_largest_first(t):
    from pyspark.sql import Window

    rows = _runs(t)
    unit, number = R.size_of(F.col("model"))
    order = Window.orderBy(F.desc(F.when(unit == "b", 1).otherwise(0)), F.desc(number), F.desc("seq_len"), F.desc("gpu_num"), F.desc("global_batch"), "run_id")
    return R.largest_first(rows).withColumn("place", F.row_number().over(order).cast("long")).select("run_id", "place")  # a run a row of the report


@query("SELECT event_id, event_type, round(CASE WHEN event_type <> 'error' OR before <> 0 THEN value - before END, 9) AS fdiff FROM (SELECT *, lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS before FROM events)")
def WIN1_finite_difference(t):
    rows = series.differences(t.events, "event_type", "event_id", "value", ("error",))
    return rows.select("event_id", "event_type", F.round("fdiff", 9).alias("fdiff"))


MVA = "(SELECT event_id, event_type, value, avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING) AS mva FROM events)"


@query(f"SELECT event_id, round(mva, 6) AS mva, coalesce(value > 2 * mva, false) AS outlier FROM {MVA}")
def WIN2_WIN3_delayed_outliers(t):
    return series.outliers(t.events, "event_type", "event_id", "value", 10, 2.0).select("event_id", F.round("mva", 6).alias("mva"), "outlier")


@query(f"SELECT event_id, n_outliers::BIGINT AS n_outliers, round(0.001 * greatest(0.01, pow(0.9, n_outliers)), 12) AS lr FROM (SELECT *, sum(coalesce(value > 2 * mva, false)::INT) OVER (PARTITION BY event_type ORDER BY event_id RANGE BETWEEN 200 PRECEDING AND CURRENT ROW) AS n_outliers FROM {MVA})")
def WIN4_penalised_rate(t):
    rows = series.outliers(t.events, "event_type", "event_id", "value", 10, 2.0)
    return series.penalised(rows, "event_type", "event_id", 200, 0.9, 0.01, 0.001).select("event_id", "n_outliers", F.round("lr", 12).alias("lr"))


@query(f"SELECT event_id, round(CASE WHEN coalesce(value > 2 * mva, false) THEN mva * 2 ELSE value END, 6) AS clipped FROM {MVA}")
def WIN5_clipped(t):
    rows = series.outliers(t.events, "event_type", "event_id", "value", 10, 2.0)
    return series.clipped(rows, "value", 2.0).select("event_id", F.round("clipped", 6).alias("clipped"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS speed FROM events")
def WIN6_sliding_speed(t):
    return series.sliding(t.events, "event_type", "event_id", "value", 10).select("event_id", F.round("speed", 6).alias("speed"))


@query("SELECT vec_id, round(list_reduce(list_prepend(0::DOUBLE, list_transform(embedding, lambda x: x::DOUBLE)), lambda m, x: m * 0.9 + x * (1 - 0.9)), 6) AS momentum FROM embeddings")
def WIN7_momentum(t):
    return t.embeddings.select("vec_id", F.round(A.momentum("embedding", 0.9), 6).alias("momentum"))


@query("SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM documents")
def WIN8_offsets(t):
    from ..operators.concat import running_offset

    return running_offset(t.documents.select("doc_id", "n_chars"), "doc_id", F.col("n_chars"), name="at").select("doc_id", "at")


@query("SELECT event_id, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS session FROM events")
def WIN9_running_separators(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.events.select("event_id", F.sum((F.col("event_type") == "signup").cast("int")).over(w).alias("session"))


@query("SELECT pair_id, r // 32 AS batch_id, (r % 32)::INT AS pos FROM (SELECT pair_id, row_number() OVER (ORDER BY pair_id) - 1 AS r FROM tasks)")
def WIN11_batch_and_position(t):
    from ..operators.collate import batched

    return batched(t.tasks.select("pair_id"), "pair_id", 32)


@query("SELECT pow(2, n)::BIGINT AS seq_len FROM range(9, 15) r(n)")
def GEN1_sequence_lengths(t):
    return R.sequence_lengths(t.spark)


@query("SELECT DISTINCT seq_len, global_batch FROM (SELECT pow(2, n)::BIGINT AS seq_len, b AS global_batch FROM range(9, 15) r(n), (SELECT unnest([64::BIGINT, 100]) AS b) UNION ALL SELECT pow(2, n)::BIGINT, pow(2, k)::BIGINT // pow(2, n)::BIGINT FROM range(9, 15) r(n), range(19, 24) s(k))")
def GEN2_batch_grid(t):
    return R.batches(R.sequence_lengths(t.spark), [64, 100], 19, 23)


@query("SELECT DISTINCT p_brand, first(\"limit\" ORDER BY position) OVER (PARTITION BY p_brand)::BIGINT AS \"limit\" FROM (SELECT p_brand, p_size AS \"limit\", p_partkey AS position FROM part)")
def GEN3_first_limit(t):
    limits = t.part.select("p_brand", F.col("p_size").cast("long").alias("limit"), F.col("p_partkey").alias("position"))
    return R.limit_of(t.part.select("p_brand").distinct(), limits, "p_brand").select("p_brand", "limit")


@query("SELECT p_partkey, left(replace('sweep_a-' || p_name || '-' || p_size || '-' || p_type, '_', '-'), 47) AS name FROM part")
def GEN4_run_names(t):
    return t.part.select("p_partkey", R.run_name(F.lit("sweep_a"), F.col("p_name"), F.col("p_size"), F.col("p_type")).alias("name"))


@query(f"SELECT run_id, greatest(1, trunc(global_batch / pow(seq_len / 2048.0, 2)))::BIGINT AS eval_batch FROM {RUNS}")
def GEN5_eval_batch(t):
    return _runs(t).select("run_id", R.eval_batch(F.col("global_batch"), F.col("seq_len")).alias("eval_batch"))


@query("SELECT cluster, gpu_num, seq_len FROM (SELECT cluster, pow(2, k)::BIGINT AS gpu_num FROM (VALUES ('r1', 64::BIGINT), ('r2', 24)) c(cluster, most), range(0, 8) r(k) WHERE k <= ceil(log2(most))) g, (SELECT pow(2, n)::BIGINT AS seq_len FROM range(9, 12) r(n)) s, (VALUES ('r1', 64), ('r2', 16)) l(name, most) WHERE l.name = g.cluster AND g.gpu_num <= l.most")
def JON7_dependent_sweep(t):
    counts = R.gpu_counts(t.rows([("r1", "a", 64), ("r2", "a", 24)], "cluster string, gpu_type string, gpus long"))
    limits = t.rows([("r1", 64), ("r2", 16)], "cluster string, most long")
    return R.sweep(counts, R.sequence_lengths(t.spark, 9, 11)).join(F.broadcast(limits), "cluster").where("gpu_num <= most").drop("most")


@query("SELECT 'batch' AS key, '8' AS value UNION ALL SELECT 'missing', 'NameError' UNION ALL SELECT 'unused', 'extra'")
def CFG1_settings_taken(t):
    from ..plans import config

    given = {"batch": "8", "extra": 1}
    rows = [("batch", str(config.take(given, "batch", convert=int)))]
    try:
        config.take(given, "missing")
    except NameError as e:
        rows.append(("missing", type(e).__name__))
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        rows.append(("unused", ",".join(config.warn_unused(given))))
    return t.rows(rows, "key string, value string")


@query("SELECT * FROM (VALUES ('hub', 'hf'), ('remote', 'remote'), ('both', 'refused'), ('no local', 'refused')) v(given, outcome)")
def CFG2_source_rules(t):
    from ..plans.config import check_source

    rows = []
    for name, config in (("hub", {"hf_name": "x"}), ("remote", {"remote": "r", "local": "l"}), ("both", {"hf_name": "x", "remote": "r", "local": "l"}), ("no local", {"remote": "r"})):
        try:
            rows.append((name, check_source(config)))
        except ValueError:
            rows.append((name, "refused"))
    return t.rows(rows, "given string, outcome string")


@query("SELECT * FROM (VALUES ('text', 'built 8'), ('other', 'refused')) v(name, outcome)")
def CFG3_CFG4_dispatch(t):
    from ..plans.config import Registry

    loaders = Registry("loader")
    loaders.add("text")(lambda batch: f"built {batch}")
    rows = []
    for name in ("text", "other"):
        try:
            rows.append((name, loaders.build(name, batch=8)))
        except ValueError:
            rows.append((name, "refused"))
    return t.rows(rows, "name string, outcome string")


@query(f"SELECT event_id, round(mva, 6) AS mva, coalesce(value > 2 * mva, false) AS outlier FROM {MVA}")
def STR_outliers_as_stream(t):
    """The events read as a stream, through state that outlives each micro-batch; the sink's rows equal the batch result."""
    from .. import streaming

    path, place = t.scratch(), t.scratch()
    t.events.orderBy("event_id").coalesce(1).write.parquet(path)
    stream = t.spark.readStream.schema(t.events.schema).parquet(path)
    out = streaming.outliers(stream, "event_type", "event_id", "value", 10, 2.0)
    job = out.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    job.awaitTermination()
    if job.exception():
        raise job.exception()
    return t.spark.read.parquet(f"{place}/rows").select("event_id", F.round("mva", 6).alias("mva"), "outlier")


@query("""WITH c AS (SELECT p_partkey AS run_id, CASE p_partkey % 3 WHEN 0 THEN 'flash' WHEN 1 THEN 'torch' ELSE 'triton' END AS impl, (8 + 8 * (p_partkey % 4))::BIGINT AS h, (128 * (1 + p_size % 8))::BIGINT AS s, p_size % 2 = 0 AS alibi, p_size % 3 = 0 AS prefix, p_size % 5 > 0 AS causal, p_partkey % 7 = 0 AS ids FROM part)
SELECT run_id, CASE WHEN impl = 'flash' THEN NULL WHEN alibi AND (prefix OR NOT causal OR ids) THEN '1,' || h || ',' || s || ',' || s WHEN alibi THEN '1,' || h || ',1,' || s WHEN prefix OR ids THEN '1,1,' || s || ',' || s END AS shape FROM c""")
def NUM5_bias_shapes(t):
    from ..operators.masks import bias_shape
    from .base import joined

    k, size = F.col("p_partkey"), F.col("p_size")
    impl = F.when(k % 3 == 0, "flash").when(k % 3 == 1, "torch").otherwise("triton")
    shape = bias_shape(impl, 8 + 8 * (k % 4), 128 * (1 + size % 8), size % 2 == 0, size % 3 == 0, size % 5 > 0, k % 7 == 0)
    return t.part.select(k.alias("run_id"), joined(shape).alias("shape"))
