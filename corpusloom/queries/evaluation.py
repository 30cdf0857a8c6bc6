"""Score roll-ups, look-up joins, set operations, orders and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collate, evalagg, icl, sampling, series
from .base import query

# The metric log of these queries: an accuracy for each label, number of shots and category of mc_items, for two models.
LOG = """(SELECT 'm' || mo AS model, 'metrics/' || label || '/' || num_fewshot || '-shot' || CASE WHEN category IS NULL THEN '' ELSE '/' || category END || '/InContextLearningMultipleChoiceAccuracy' AS key,
 row_number() OVER (PARTITION BY mo ORDER BY label, num_fewshot, coalesce(category, ''))::BIGINT AS position, value FROM (
 SELECT item_id % 2 AS mo, label, num_fewshot, trim(lower(category)) AS category, avg(CASE WHEN coalesce(gold, 0) = 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS value FROM mc_items GROUP BY 1, 2, 3, 4))"""


def _log(t):
    from pyspark.sql import Window

    rows = t.mc_items.groupBy((F.col("item_id") % 2).alias("mo"), "label", "num_fewshot", F.trim(F.lower("category")).alias("category")).agg(F.avg(F.when(F.coalesce("gold", F.lit(0)) == 0, 1.0).otherwise(0.0)).alias("value"))
    w = Window.partitionBy("mo").orderBy("label", "num_fewshot", F.coalesce("category", F.lit("")))
    key = F.concat(F.lit("metrics/"), "label", F.lit("/"), F.col("num_fewshot").cast("string"), F.lit("-shot"), F.coalesce(F.concat(F.lit("/"), "category"), F.lit("")), F.lit("/InContextLearningMultipleChoiceAccuracy"))
    return rows.select(F.concat(F.lit("m"), F.col("mo").cast("string")).alias("model"), key.alias("key"), F.row_number().over(w).cast("long").alias("position"), "value")


PARSED = f"(SELECT model, position, value, regexp_extract(key, '^metrics/(.*?)/(\\d+)-shot(/.*?)?/InContextLearning(.*)', 1) AS benchmark, regexp_extract(key, '^metrics/(.*?)/(\\d+)-shot(/.*?)?/InContextLearning(.*)', 2) AS num_shot, nullif(substr(regexp_extract(key, '^metrics/(.*?)/(\\d+)-shot(/.*?)?/InContextLearning(.*)', 3), 2), '') AS subtask, regexp_extract(key, '^metrics/(.*?)/(\\d+)-shot(/.*?)?/InContextLearning(.*)', 4) AS metric FROM {LOG})"
AVERAGED = f"(SELECT model, benchmark, num_shot, metric, avg(value) AS value, min(position) AS position FROM (SELECT *, max(CASE WHEN subtask IS NULL THEN position END) OVER (PARTITION BY model, benchmark, num_shot, metric) AS last FROM {PARSED}) WHERE last IS NULL OR position >= last GROUP BY ALL)"

BENCHMARKS = [("daily life", "household_mc", "0", 0.25), ("daily life", "crafts_mc", "5", 0.25), ("daily life", "tools_mc", "0", 0.2), ("world", "nature_mc", "0", 0.25), ("world", "travel_mc", "0", 0.25), ("empty", "absent_mc", "0", 0.5)]
BENCHMARKS_SQL = "(VALUES " + ", ".join(f"('{c}', '{b}', '{n}', {r}::DOUBLE)" for c, b, n, r in BENCHMARKS) + ") b(category, benchmark, num_shot, baseline)"
SIZES_SQL = "(SELECT label || '/' || num_fewshot || '-shot/' || coalesce(category, '') AS name, count(*) AS samples FROM mc_items GROUP BY ALL)"


def _benchmarks(t):
    return t.rows(BENCHMARKS, "category string, benchmark string, num_shot string, baseline double")


def _sizes(t):
    return t.mc_items.groupBy(F.concat("label", F.lit("/"), F.col("num_fewshot").cast("string"), F.lit("-shot/"), F.coalesce("category", F.lit(""))).alias("name")).agg(F.count("*").alias("samples"))


@query(f"SELECT model, benchmark, num_shot, subtask, metric FROM {PARSED}")
def FLT9_metric_keys(t):
    return evalagg.parsed(_log(t)).select("model", "benchmark", "num_shot", "subtask", "metric")


@query(f"SELECT model, benchmark, num_shot, metric, round(value, 9) AS value FROM {AVERAGED}")
def AGG1_subtask_means(t):
    return evalagg.averaged(_log(t)).select("model", "benchmark", "num_shot", "metric", F.round("value", 9).alias("value"))


def _scores(weight: str) -> str:
    return f"""WITH w AS (SELECT b.*, {weight} AS weight FROM {BENCHMARKS_SQL}),
s AS (SELECT model, benchmark, num_shot, arg_min(value, position) AS value FROM {AVERAGED} WHERE contains(metric, 'Accuracy') GROUP BY ALL),
j AS (SELECT s.model, w.category, (s.value - w.baseline) / (1 - w.baseline) AS score, w.weight FROM s JOIN w USING (benchmark, num_shot)),
per AS (SELECT model, category, sum(score * weight) / sum(weight) AS score FROM j GROUP BY ALL),
full_ AS (SELECT m.model, c.category, coalesce(score, 0) AS score FROM (SELECT DISTINCT model FROM {LOG}) m CROSS JOIN (SELECT DISTINCT category FROM w) c LEFT JOIN per USING (model, category))"""


SUM_OF = f"greatest(coalesce((SELECT sum(samples) FROM {SIZES_SQL} z WHERE starts_with(z.name, b.benchmark || '/' || b.num_shot || '-shot')), 0), 1)::DOUBLE"


@query(_scores("1.0") + " SELECT model, category, round(score, 9) AS score FROM full_ UNION ALL SELECT model, 'average', round(avg(score), 9) FROM full_ GROUP BY model")
def AGG2_AGG3_AGG4_gauntlet(t):
    scores = evalagg.gauntlet(_log(t), evalagg.weights(_benchmarks(t), None))
    return scores.select("model", "category", F.round("score", 9).alias("score"))


@query(f"SELECT category, benchmark, num_shot, round(greatest(log2({SUM_OF}), 1), 9) AS log_weight, {SUM_OF} AS weight FROM {BENCHMARKS_SQL}")
def AGG5_JON3_benchmark_weights(t):
    log = evalagg.weights(_benchmarks(t), _sizes(t), "LOG_SAMPLE_SZ").withColumnRenamed("weight", "log_weight")
    size = evalagg.weights(_benchmarks(t), _sizes(t), "SAMPLE_SZ")
    return size.join(log.drop("baseline"), ["category", "benchmark", "num_shot"]).select("category", "benchmark", "num_shot", F.round("log_weight", 9).alias("log_weight"), "weight")


@query(_scores(f"greatest(log2({SUM_OF}), 1)") + " SELECT model, category, round(score, 9) AS score FROM full_")
def AGG3_log_weighted_categories(t):
    scores = evalagg.gauntlet(_log(t), evalagg.weights(_benchmarks(t), _sizes(t), "LOG_SAMPLE_SZ"))
    return scores.where("category <> 'average'").select("model", "category", F.round("score", 9).alias("score"))


TAXONOMY_SQL = "(VALUES ('household_mc', 'daily life'), ('nature_mc', 'world')) x(benchmark, category)"


@query(f"""WITH p AS (SELECT *, count(*) OVER (PARTITION BY model, num_shot, benchmark, metric) AS n FROM {PARSED}),
c AS (SELECT p.*, coalesce(x.category, '') AS category FROM p LEFT JOIN {TAXONOMY_SQL} ON x.benchmark = p.benchmark)
SELECT category, benchmark, NULL AS subtask, round(value, 9) AS accuracy, num_shot, model FROM c WHERE n = 1
UNION ALL SELECT category, benchmark, 'Average', round(avg(value), 9), num_shot, model FROM c WHERE n > 1 GROUP BY category, benchmark, num_shot, model, metric
UNION ALL SELECT category, NULL, coalesce(subtask, 'no_subcat'), round(value, 9), num_shot, model FROM c WHERE n > 1""")
def AGG6_JON1_result_table(t):
    taxonomy = t.rows([("household_mc", "daily life"), ("nature_mc", "world")], "benchmark string, category string")
    return evalagg.result_table(_log(t), taxonomy).withColumn("accuracy", F.round("accuracy", 9))


@query(_scores("1.0") + """, u AS (SELECT model, category, score FROM full_ UNION ALL SELECT model, 'average', avg(score) FROM full_ GROUP BY model)
SELECT model, round(max(CASE WHEN category = 'average' THEN score END), 9) AS average, round(max(CASE WHEN category = 'daily life' THEN score END), 9) AS "daily life", round(max(CASE WHEN category = 'empty' THEN score END), 9) AS empty, round(max(CASE WHEN category = 'world' THEN score END), 9) AS world FROM u GROUP BY model""")
def SRT2_leaderboard(t):
    board = evalagg.leaderboard(evalagg.gauntlet(_log(t), evalagg.weights(_benchmarks(t), None)))
    return board.select("model", *(F.round(c, 9).alias(c) for c in board.columns if c != "model"))


@query(f"SELECT b.benchmark, b.num_shot, s.model, round(s.value, 9) AS value FROM {BENCHMARKS_SQL} LEFT JOIN {AVERAGED} s ON s.benchmark = b.benchmark AND s.num_shot = b.num_shot")
def JON2_benchmark_to_metric(t):
    scores = evalagg.averaged(_log(t)).select("benchmark", "num_shot", "model", F.round("value", 9).alias("value"))
    return _benchmarks(t).select("benchmark", "num_shot").join(scores, ["benchmark", "num_shot"], "left")


@query("SELECT e.example_id, s.raw_samples, s.chars_per_sample FROM finetune_example e JOIN data_splits s ON s.dataset_name = e.source AND s.folder_split = e.folder_split")
def JON4_split_constants(t):
    splits = t.data_splits.select(F.col("dataset_name").alias("source"), "folder_split", "raw_samples", "chars_per_sample")
    return t.finetune_example.select("example_id", "source", "folder_split").join(F.broadcast(splits), ["source", "folder_split"]).select("example_id", "raw_samples", "chars_per_sample")


@query("SELECT e.example_id FROM finetune_example e WHERE NOT EXISTS (SELECT 1 FROM data_splits s WHERE s.dataset_name = e.source AND s.folder_split = e.folder_split)")
def JON4_unknown_splits(t):
    splits = t.data_splits.select(F.col("dataset_name").alias("source"), "folder_split")
    return t.finetune_example.select("example_id", "source", "folder_split").join(F.broadcast(splits), ["source", "folder_split"], "left_anti").select("example_id")


@query("SELECT temperature, top_p, top_k, seed FROM (VALUES (0.0::DOUBLE), (0.7), (1.0)) a(temperature), (VALUES (0.9::DOUBLE), (1.0)) b(top_p), (VALUES (0::BIGINT), (50)) c(top_k), range(3) d(seed)")
def JON6_sampling_grid(t):
    from ..operators.runs import sweep

    return sweep(t.rows([(0.0,), (0.7,), (1.0,)], "temperature double"), t.rows([(0.9,), (1.0,)], "top_p double"), t.rows([(0,), (50,)], "top_k long"), t.spark.range(3).withColumnRenamed("id", "seed"))


@query("SELECT item_id, i::INT AS choice_idx, choice FROM (SELECT item_id, unnest(range(0, len(choices))) AS i, unnest(choices) AS choice FROM mc_items)")
def JON9_choices(t):
    return icl.expanded(t.mc_items).select("item_id", "choice_idx", "choice")


@query("""WITH c AS (SELECT p_partkey AS run_id, CASE p_partkey % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'text_denoising' ELSE 'finetuning' END AS loader, CASE p_size % 4 WHEN 0 THEN 'hf_t5' WHEN 1 THEN 'hf_prefix_lm' WHEN 2 THEN 'hf_causal_lm' ELSE 'mpt_causal_lm' END AS model, p_partkey % 2 = 0 AS asked, p_partkey % 5 = 0 AS icl FROM part)
SELECT run_id, NOT ((loader = 'text' AND model IN ('hf_t5', 'hf_prefix_lm')) OR (loader = 'text_denoising' AND model = 'hf_causal_lm') OR (icl AND model = 'hf_t5')) AS allowed,
CASE WHEN loader = 'text_denoising' THEN CASE model WHEN 'hf_t5' THEN false WHEN 'hf_prefix_lm' THEN true ELSE asked END END AS decoder_only FROM c""")
def JON11_loader_matrix(t):
    """Runs joined with what the configuration check says of their few combinations of loader, model and settings."""
    import itertools
    import warnings

    from ..plans.config import LOADERS_OF, checked_loaders

    models = sorted(set().union(*LOADERS_OF.values()))
    said = []
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for loader, model, asked, icl_ in itertools.product(LOADERS_OF, models, (True, False), (True, False)):
            one = {"name": loader} | ({"decoder_only_format": asked} if loader == "text_denoising" else {})
            only = None
            for with_icl in (False, icl_):
                try:
                    only, allowed = checked_loaders(model, [one], with_icl)[0].get("decoder_only_format"), True
                except ValueError:
                    allowed = False
            said.append((loader, model, asked, icl_, allowed, asked if only is None and loader == "text_denoising" else only))
    rules = t.rows(said, "loader string, model string, asked boolean, icl boolean, allowed boolean, decoder_only boolean")
    k, size = F.col("p_partkey"), F.col("p_size")
    runs = t.part.select(
        k.alias("run_id"), F.when(k % 3 == 0, "text").when(k % 3 == 1, "text_denoising").otherwise("finetuning").alias("loader"), F.when(size % 4 == 0, "hf_t5").when(size % 4 == 1, "hf_prefix_lm").when(size % 4 == 2, "hf_causal_lm").otherwise("mpt_causal_lm").alias("model"),
        (k % 2 == 0).alias("asked"), (k % 5 == 0).alias("icl"),
    )
    return runs.join(rules, ["loader", "model", "asked", "icl"]).select("run_id", "allowed", "decoder_only")


@query("SELECT 'a' AS model, item_id, gold FROM copa UNION ALL SELECT 'b', item_id, gold FROM mc_items")
def SET1_stacked_results(t):
    return evalagg.stacked([t.copa.select(F.lit("a").alias("model"), "item_id", "gold"), t.mc_items.select(F.lit("b").alias("model"), "item_id", "gold")])


@query("SELECT query FROM copa UNION ALL SELECT query FROM mc_items")
def SET2_union_of_streams(t):
    return sampling.mixture({"copa": t.copa.select("query"), "items": t.mc_items.select("query")}).drop("stream")


@query("SELECT DISTINCT folder_split FROM data_splits INTERSECT SELECT DISTINCT folder_split FROM finetune_example")
def SET3_common_splits(t):
    return t.data_splits.select("folder_split").intersect(t.finetune_example.select("folder_split"))


@query("""WITH l AS (SELECT 1 AS part, 'lm_tasks/' || label AS label, min(item_id) AS first FROM lm_tasks GROUP BY label UNION ALL SELECT 2, 'mc_items/' || label, min(item_id) FROM mc_items GROUP BY label)
SELECT 0::BIGINT AS position, 'base' AS label UNION ALL SELECT row_number() OVER (ORDER BY part, first, label)::BIGINT, label FROM l""")
def SET4_ordered_evaluators(t):
    """The base evaluator, then those of the language modelling tasks, then the multiple-choice ones, as they come."""
    return evalagg.in_order([t.spark.sql("SELECT 'base' AS label, 0L AS item_id"), t.lm_tasks.select(F.concat(F.lit("lm_tasks/"), "label").alias("label"), "item_id"), t.mc_items.select(F.concat(F.lit("mc_items/"), "label").alias("label"), "item_id")], "label", "item_id")


@query("SELECT DISTINCT unnest(choices) AS choice FROM mc_items")
def SET5_distinct_choices(t):
    return t.mc_items.select(F.explode("choices").alias("choice")).distinct()


@query("SELECT label, item_id, row_number() OVER (PARTITION BY label ORDER BY length(query) DESC, item_id)::BIGINT AS r FROM mc_items")
def SRT3_stable_by_size(t):
    from pyspark.sql import Window

    return t.mc_items.select("label", "item_id", F.row_number().over(Window.partitionBy("label").orderBy(F.desc(F.length("query")), "item_id")).cast("long").alias("r"))


@query("SELECT key, row_number() OVER (ORDER BY CASE WHEN starts_with(key, 'l2_norm') THEN 0 ELSE 1 END, key)::BIGINT AS r FROM (SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN 'l2_norm/' ELSE 'cosine/' END || event_type AS key FROM events)")
def SRT4_norms_first(t):
    from pyspark.sql import Window

    keys = t.events.select(F.concat(F.when(F.col("event_id") % 2 == 0, "l2_norm/").otherwise("cosine/"), "event_type").alias("key")).distinct()
    return keys.select("key", F.row_number().over(Window.orderBy(F.when(F.col("key").startswith("l2_norm"), 0).otherwise(1), "key")).cast("long").alias("r"))  # a row a metric name


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 100")
def LIM1_truncated_split(t):
    return sampling.truncated(t.documents.select("doc_id", "n_chars"), "doc_id", 100)


@query("SELECT pair_id, batch_id FROM (SELECT pair_id, ((row_number() OVER (ORDER BY pair_id) - 1) // 64)::BIGINT AS batch_id FROM tasks) QUALIFY count(*) OVER (PARTITION BY batch_id) = 64")
def LIM2_drop_last(t):
    return collate.batched(t.tasks.select("pair_id"), "pair_id", 64, drop_last=True).select("pair_id", "batch_id")


@query("SELECT pair_id, batch_id FROM (SELECT pair_id, ((row_number() OVER (ORDER BY pair_id) - 1) // 64)::BIGINT AS batch_id FROM tasks) WHERE batch_id < 3")
def LIM3_first_batches(t):
    return sampling.first_batches(collate.batched(t.tasks.select("pair_id"), "pair_id", 64), 3).select("pair_id", "batch_id")


@query("SELECT label, item_id, n::BIGINT AS n FROM (SELECT label, item_id, length(query) AS n, row_number() OVER (PARTITION BY label ORDER BY length(query) DESC, item_id) AS r FROM mc_items) WHERE r <= 5")
def LIM4_largest_of_each(t):
    from pyspark.sql import Window

    rows = t.mc_items.select("label", "item_id", F.length("query").cast("long").alias("n"))
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "item_id"))).where("r <= 5").drop("r")


@query("SELECT item_id, query FROM copa ORDER BY item_id LIMIT 16")
def LIM5_first_rows(t):
    return t.copa.select("item_id", "query").orderBy("item_id").limit(16)


HASH = "('0x' || substr(md5('9176-' || {0}::VARCHAR), 1, 12))::BIGINT"


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {HASH.format('doc_id')}, doc_id)::BIGINT AS place FROM documents")
def SMP1_seeded_shuffle(t):
    from ..operators.concat import running_offset

    rows = t.documents.select("doc_id", sampling.hashed("doc_id", 9176, portable=True).alias("h"))
    return running_offset(rows, "h", F.lit(1), name="place").select("doc_id", (F.col("place") + 1).alias("place"))


WEIGHTED = f"""WITH q(stream, quota) AS (VALUES ('quizmill', 500), ('fablebank', 300), ('longwalk', 200)),
r AS (SELECT e.example_id, e.source, q.quota, row_number() OVER (PARTITION BY source ORDER BY {HASH.format('example_id').replace('9176', '5')}, example_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM finetune_example e JOIN q ON q.stream = e.source)
SELECT example_id, source, (quota // n + CASE WHEN r < quota % n THEN 1 ELSE 0 END)::BIGINT AS draws FROM r WHERE quota // n + CASE WHEN r < quota % n THEN 1 ELSE 0 END > 0"""


@query(WEIGHTED)
def SMP2_weighted_streams(t):
    drawn = sampling.weighted(t.finetune_example.select("example_id", "source"), "source", "example_id", {"quizmill": 0.5, "fablebank": 0.3, "longwalk": 0.2}, 1000, seed=5, portable=True)
    return drawn.select("example_id", "source", "draws")


@query(f"SELECT doc_id, ({HASH.format('doc_id').replace('9176', '11')} % 3)::INT AS noiser FROM documents")
def SMP3_random_choice(t):
    return t.documents.select("doc_id", sampling.chosen("doc_id", 3, 11, portable=True).alias("noiser"))


@query("SELECT doc_id, (doc_id % 8)::INT AS rank FROM documents")
def SMP4_worker_shards(t):
    return sampling.shard(t.documents.select("doc_id"), "doc_id", 8)


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity / 10.0 AS logit FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY logit DESC, l_linenumber) AS r FROM l),
k AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY l_orderkey)) AS e FROM r WHERE r <= 4), p AS (SELECT *, e / sum(e) OVER (PARTITION BY l_orderkey) AS p0 FROM k),
c AS (SELECT *, coalesce(sum(p0) OVER (PARTITION BY l_orderkey ORDER BY logit DESC, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
SELECT l_orderkey, l_linenumber, round(p0 / sum(p0) OVER (PARTITION BY l_orderkey), 6) AS p FROM c WHERE before < 0.9""")
def SMP5_nucleus(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10.0).alias("logit"))
    return sampling.nucleus(rows, "l_orderkey", "l_linenumber", "logit", top_k=4, top_p=0.9).select("l_orderkey", "l_linenumber", F.round("p", 6).alias("p"))


@query("SELECT event_id FROM events WHERE event_id % 100 = 0")
def FLT10_periodic(t):
    return series.due(t.events.select("event_id"), "event_id", 100)
