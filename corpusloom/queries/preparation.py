"""Sources, sinks, preprocessors, tokenizers and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sinks, sources
from ..functions import arrays as A
from ..functions import tokenize as K
from ..operators import concat, pairs, sampling
from .base import WORDS, drawn, joined, query, seeded


def some_pair(record: dict) -> dict:
    """A preprocessor of single records, as users bring them."""
    return {"prompt": f"Q: {record['query']}\nA:", "response": " " + record["choices"][0]}


@query("SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND n_chars > 500")
def SRC1_lazy_scan(t):
    return sources.lazy(t.spark, f"{t.folder}/documents.parquet").where("lang = 'en' and n_chars > 500").select("doc_id", "n_chars")


@query("SELECT item_id, query, len(choices)::BIGINT AS n, gold FROM copa")
def SRC2_json_scan(t):
    path = t.scratch()
    t.copa.write.json(path)
    return sources.json_rows(t.spark, path, "item_id long, query string, choices array<string>, gold long").select("item_id", "query", F.size("choices").cast("long").alias("n"), "gold")


@query("SELECT item_id, label, context, continuation FROM lm_tasks")
def SRC3_probed_file(t):
    folder = t.scratch()
    t.lm_tasks.write.json(f"{folder}/test.jsonl")
    return sources.probe(t.spark, folder, "test", "item_id long, label string, context string, continuation string")


@query("SELECT dataset_name, folder_split, raw_samples FROM data_splits")
def SRC4_format_with_options(t):
    path = t.scratch()
    sinks.write_csv(t.data_splits, path)
    return sources.lazy(t.spark, path, "csv", t.data_splits.schema, header="true", escape='"').select("dataset_name", "folder_split", "raw_samples")


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def SRC5_text_shards(t):
    root = t.scratch()
    sinks.write_shards(t.documents.select("doc_id", "text"), root, "train", rows_a_shard=500)
    return sources.shards(t.spark, root, "train").select("doc_id", F.md5("text").alias("digest"))


@query("SELECT pair_id, md5(prompt) AS p, md5(response) AS r FROM tasks WHERE response IS NOT NULL")
def SRC6_pair_shards(t):
    root = t.scratch()
    sinks.write_shards(t.tasks.select("pair_id", "prompt", "response").where("response is not null"), root, "val")
    return sources.shards(t.spark, root, "val").select("pair_id", F.md5("prompt").alias("p"), F.md5("response").alias("r"))


@query(
    "SELECT 'examples' AS stream, count(*)::BIGINT AS n, sum(length(query))::BIGINT AS chars FROM finetune_example UNION ALL SELECT 'items', count(*), sum(length(query))::BIGINT FROM mc_items UNION ALL SELECT 'copa', count(*), sum(length(query))::BIGINT FROM copa"
)
def SRC7_stream_mixture(t):
    mixed = sampling.mixture({"examples": t.finetune_example.select("query"), "items": t.mc_items.select("query"), "copa": t.copa.select("query")})
    return mixed.groupBy("stream").agg(F.count("*").alias("n"), F.sum(F.length("query")).alias("chars"))


@query("SELECT item_id, octet_length(encode(query)) ::BIGINT AS n, md5(query) AS digest FROM copa")
def SRC8_encoded_columns(t):
    return t.copa.select("item_id", F.encode("query", "UTF-8").alias("query")).select("item_id", F.octet_length("query").cast("long").alias("n"), F.md5("query").alias("digest"))


@query("SELECT md5(string_agg(query, chr(10) ORDER BY item_id)) AS digest FROM copa")
def SRC9_prompt_file(t):
    path = t.scratch()
    t.copa.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "query"))), lambda x: x["query"]), "\n").alias("value")).coalesce(1).write.text(path)
    return sources.prompt(t.spark, f"file::{path}/part-*").select(F.md5(F.regexp_replace("prompt", r"\n\z", "")).alias("digest"))


@query("SELECT * FROM (SELECT (row_number() OVER (ORDER BY item_id) - 1)::BIGINT AS line_no, query AS prompt FROM copa) WHERE line_no < 10")
def SRC10_prompt_lines(t):
    path = t.scratch()
    t.copa.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "query"))), lambda x: x["query"]), "\n").alias("value")).coalesce(1).write.text(path)
    return sources.prompt_lines(t.spark, f"{path}/part-*", 10)


@query("SELECT query, len(choices)::BIGINT AS n, gold FROM copa UNION ALL SELECT query, len(choices)::BIGINT, gold FROM mc_items")
def SRC12_icl_items(t):
    path = t.scratch()
    t.copa.select("query", "choices", "gold").unionAll(t.mc_items.select("query", "choices", "gold")).write.option("ignoreNullFields", False).json(path)
    return sources.icl_items(t.spark, path).select("query", F.when(F.col("choices").isNotNull(), F.size("choices")).cast("long").alias("n"), "gold")


@query(f"SELECT row_id, list_transform(range(0, 128), lambda i: {drawn('s', 'i')} % 32000) AS input_ids, list_transform(range(0, 128), lambda i: 1::INT) AS attention_mask FROM (SELECT r AS row_id, {seeded('0', 'r', 'synthetic')} AS s FROM range(0, 64) t(r))")
def SRC13_synthetic_batch(t):
    return sources.synthetic(t.spark, 64, 128, 32_000)


@query("SELECT 'batch' AS setting, '32' AS value UNION ALL SELECT 'model.name', 'small' UNION ALL SELECT 'path', 'runs/small' UNION ALL SELECT 'splits', 'train,val'")
def SRC14_settings(t):
    from ..plans.config import parse_yaml, resolved

    read = resolved(parse_yaml("model:\n  name: small  # a comment\nbatch: 32\nsplits:\n- train\n- val\npath: runs/${model.name}\n"))
    return t.rows([("model.name", read["model"]["name"]), ("batch", str(read["batch"])), ("splits", ",".join(read["splits"])), ("path", read["path"])], "setting string, value string")


@query("SELECT dataset_name, folder_split, hf_split, raw_samples, truncated_samples, chars_per_sample, chars_per_token FROM data_splits")
def SRC15_split_catalogue(t):
    return t.data_splits.select("dataset_name", "folder_split", "hf_split", "raw_samples", "truncated_samples", "chars_per_sample", "chars_per_token")


@query("SELECT split, count(*)::BIGINT AS n, sum(octet_length(encode(text)))::BIGINT AS bytes FROM (SELECT CASE WHEN doc_id % 10 = 0 THEN 'val' ELSE 'train' END AS split, text FROM documents) GROUP BY split")
def SNK1_shards_with_manifest(t):
    root = t.scratch()
    held_out = F.col("doc_id") % 10 == 0
    sinks.write_shards(t.documents.select("doc_id", "text").where(~held_out), root, "train", 1000)
    sinks.write_shards(t.documents.select("doc_id", "text").where(held_out), root, "val", 1000)
    return sources.shards(t.spark, root).groupBy("split").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


@query("SELECT pair_id, prompt FROM tasks")
def SNK2_dual_write(t):
    first, second = t.scratch(), t.scratch()
    sinks.write_both(t.tasks.select("pair_id", "prompt"), first, second, keep_first=False)
    return t.spark.read.parquet(second)


@query("SELECT 'refused' AS outcome")
def SNK3_overlap_guard(t):
    root = t.scratch()
    sinks.write_shards(t.copa, root, "train")
    try:
        sinks.guard(t.spark, root, ["val", "train"])
        said = "written"
    except FileExistsError:
        said = "refused"
    return t.rows([(said,)], "outcome string")


@query("SELECT item_id, label, context, continuation FROM lm_tasks")
def SNK4_csv(t):
    path = t.scratch()
    sinks.write_csv(t.lm_tasks, path)
    return t.spark.read.schema(t.lm_tasks.schema).csv(path, header=True, multiLine=True, escape='"')


@query("SELECT '| spec_id | purpose | capacity |' AS line UNION ALL SELECT '| --- | --- | --- |' UNION ALL SELECT '| ' || spec_id || ' | ' || purpose || ' | ' || capacity || ' |' FROM length_specs")
def SNK5_markdown(t):
    return t.rows([(x,) for x in sinks.markdown(t.length_specs.select("spec_id", "purpose", "capacity")).split("\n")], "line string")


@query(r"SELECT replace(replace(response, chr(13), '\r'), chr(10), '\n') AS value FROM tasks WHERE response IS NOT NULL")
def SNK6_text(t):
    path = t.scratch()
    sinks.write_text(t.tasks.where("response is not null"), "response", path)
    return t.spark.read.option("lineSep", "\n").text(path)


@query("SELECT event_type AS model, 'value' AS key, event_id AS step, value FROM events")
def SNK7_metric_log(t):
    path = t.scratch()
    rows = t.events.select(F.col("event_type").alias("model"), F.lit("value").alias("key"), F.col("event_id").alias("step"), "value")
    sinks.log_metrics(rows.where("step % 2 = 0"), path)
    sinks.log_metrics(rows.where("step % 2 = 1"), path)
    return t.spark.read.parquet(path).select("model", "key", "step", "value")


@query("SELECT pair_id AS step, prompt, response AS generation FROM tasks WHERE pair_id % 5 = 0")
def SNK8_generation_log(t):
    path = t.scratch()
    sinks.log_generations(t.tasks.select(F.col("pair_id").alias("step"), "prompt", F.col("response").alias("generation")), path, 5)
    return t.spark.read.parquet(path)


@query("SELECT event_id AS step FROM events WHERE event_id % 7 = 0 OR event_id = (SELECT max(event_id) FROM events)")
def SNK9_checkpoint_steps(t):
    last = t.events.agg(F.max("event_id").alias("last"))
    return sinks.due_checkpoints(t.events.select(F.col("event_id").alias("step")).join(F.broadcast(last)).select("step", (F.col("step") == F.col("last")).alias("is_last")), 7).select("step")


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS n, md5(text) AS digest FROM documents")
def PRJ1_no_concat(t):
    return t.documents.select("doc_id", F.encode("text", "UTF-8").alias("text")).select("doc_id", F.octet_length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


@query("SELECT query AS prompt, label AS response FROM mc_items")
def PRJ2_mapped_columns(t):
    return pairs.mapped(t.mc_items, {"prompt": "query", "response": "label"})


@query(
    "SELECT pair_id, parts[1] || '### Response:' AS prompt, parts[2] AS response FROM (SELECT pair_id, string_split(prompt || response, '### Response:') AS parts FROM tasks WHERE preproc = 'alpaca' AND response IS NOT NULL) WHERE len(parts) = 2"
)
def PRJ3_alpaca(t):
    whole = t.tasks.where("preproc = 'alpaca' and response is not null").select("pair_id", F.concat("prompt", "response").alias("text"))
    return pairs.alpaca(whole.where(F.size(F.split("text", pairs.ALPACA_MARK, -1)) == 2))


@query(
    f"SELECT item_id, '{pairs.DOLLY_HEAD}' || instruction || CASE WHEN input <> '' THEN chr(10) || input ELSE '' END || '{pairs.DOLLY_TAIL}' AS prompt, output AS response FROM (SELECT item_id, query AS instruction, coalesce(category, '') AS input, choices[1] AS output FROM mc_items)".replace("\n", "' || chr(10) || '")
)
def PRJ4_dolly(t):
    return pairs.dolly(t.mc_items.select("item_id", F.col("query").alias("instruction"), F.coalesce("category", F.lit("")).alias("input"), F.get("choices", F.lit(0)).alias("output")))


@query("SELECT pair_id, prompt || ':' AS prompt, response FROM tasks")
def PRJ5_p3(t):
    return pairs.p3(t.tasks.select("pair_id", F.col("prompt").alias("inputs"), F.col("response").alias("targets")))


@query(
    r"SELECT pair_id, prompt, CASE WHEN right(prompt, 1) IN (' ', chr(10), chr(9)) OR left(response, 1) IN (' ', chr(10), chr(9)) THEN response ELSE ' ' || response END AS response FROM tasks"
)
def PRJ6_spaced_flan(t):
    return pairs.resolve("spaced_flan")(t.tasks.select("pair_id", F.col("prompt").alias("inputs"), F.col("response").alias("targets")))


@query(
    "SELECT example_id, query || chr(10) || 'Options:' || coalesce(array_to_string(list_transform(choices, lambda c: chr(10) || ' - ' || c), ''), CASE WHEN choices IS NULL THEN NULL ELSE '' END) || chr(10) || 'Answer: ' AS prompt, CASE WHEN gold >= 0 THEN choices[gold + 1] END AS response FROM finetune_example"
)
def PRJ7_multiple_choice(t):
    return pairs.multiple_choice(t.finetune_example.select("example_id", "query", "choices", "gold"))


@query(
    "SELECT item_id, array_to_string(list_transform(choices, lambda o: left(query, loc) || CASE WHEN lower(string_split(o, ' ')[1]) IN ('the','a','an','my','his','her','their') AND NOT regexp_matches(left(query, loc), '(^|[.?!]\\s*)$') THEN lower(left(o, 1)) || substr(o, 2) ELSE o END), '|') AS context_options, substr(query, loc + 4) AS continuation, gold FROM (SELECT *, instr(query, ' the ') AS loc FROM copa) WHERE loc > 0".replace("\\\\", "\\")
)
def PRJ8_schema_items(t):
    found = t.copa.select("item_id", F.col("query").alias("text"), F.lit("the").alias("pronoun"), F.instr("query", " the ").alias("pronoun_loc"), F.col("choices").alias("options"), F.col("gold").alias("label")).where("pronoun_loc > 0")
    return pairs.schema_items(found).select("item_id", F.array_join("context_options", "|").alias("context_options"), "continuation", "gold")


@query("SELECT item_id, 'Question: ' || query || chr(10) || 'Answer:' AS prompt, choices[1] AS response FROM copa")
def PRJ9_trivia(t):
    return pairs.trivia(t.copa.select("item_id", F.col("query").alias("question"), F.get("choices", F.lit(0)).alias("answer")))


@query(f"SELECT pair_id, array_to_string({WORDS.format('prompt')}, ',') AS input_ids, array_to_string({WORDS.format('response')}, ',') AS labels FROM tasks")
def PRJ10_tokenised_pairs(t):
    return t.tasks.select("pair_id", joined(K.word_tokens(F.col("prompt"))).alias("input_ids"), joined(K.word_tokens(F.col("response"))).alias("labels"))


@query(f"SELECT len({WORDS.format('prompt')})::BIGINT AS n_input, len({WORDS.format('response')})::BIGINT AS n_labels FROM tasks")
def PRJ11_only_token_columns(t):
    rows = t.tasks.withColumn("input_ids", K.word_tokens(F.col("prompt"))).withColumn("labels", K.word_tokens(F.col("response"))).select("input_ids", "labels")
    return rows.select(F.size("input_ids").cast("long").alias("n_input"), F.size("labels").cast("long").alias("n_labels"))


@query("SELECT item_id, replace(replace(label, '_mc', '.choice'), 'nature', 'world') AS key FROM mc_items")
def PRJ12_renamed_keys(t):
    return t.mc_items.select("item_id", pairs.renamed_keys(F.col("label"), {"_mc": ".choice", "nature": "world"}).alias("key"))


@query("SELECT unnest(['alpaca','dolly','instruction_input_output','multiple_choice','p3','spaced_flan','spaced_p3','trivia']) AS name")
def UDF1_registry(t):
    return t.rows([(n,) for n in pairs.registered()], "name string")


@query("SELECT 'Q: ' || query || chr(10) || 'A:' AS prompt, ' ' || choices[1] AS response FROM copa")
def UDF2_imported_function(t):
    return pairs.resolve("corpusloom.queries.preparation:some_pair")(t.copa.select("query", "choices"))


@query(
    "SELECT ratio, mean, CASE WHEN mean IS NULL THEN CASE WHEN ratio < 1 THEN '[S2S]' ELSE '[CLM]' END WHEN mean >= 12 OR ratio >= 0.3 THEN '[NLG]' ELSE '[NLU]' END AS prefix FROM (VALUES (0.15::DOUBLE, 3.0::DOUBLE), (0.5, 3.0), (0.15, 32.0), (0.25, NULL), (1.0, NULL)) v(ratio, mean)"
)
def UDF3_prefix_function(t):
    from ..operators.denoise import ul2_prefix

    cases = [(0.15, 3.0), (0.5, 3.0), (0.15, 32.0), (0.25, None), (1.0, None)]
    return t.rows([(r, m, ul2_prefix(r, m)) for r, m in cases], "ratio double, mean double, prefix string")


@query(f"SELECT doc_id, len({WORDS.format('text')})::BIGINT AS n, array_to_string(list_slice({WORDS.format('text')}, 1, 5), ',') AS head FROM documents")
def TOK1_word_tokenizer(t):
    return t.documents.select("doc_id", K.word_tokens(F.col("text")).alias("ids")).select("doc_id", F.size("ids").cast("long").alias("n"), joined(F.slice("ids", 1, 5)).alias("head"))


@query("SELECT item_id, array_to_string(list_transform(regexp_extract_all(query, '(?s).'), lambda c: unicode(c)), ',') AS ids FROM copa")
def TOK1_code_points(t):
    return t.copa.select("item_id", joined(K.code_points(F.col("query"))).alias("ids"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS digest, length(coalesce(text, '')) > 0 AS has_tokens FROM documents")
def TOK1_byte_pair_vocabulary(t):
    """Ids of a public byte-pair vocabulary and back; its file is the driver's and is shipped to the executors."""
    import os

    path = K.shipped(t.spark, os.environ.get("CORPUSLOOM_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.json"))
    told = K.vocabulary_sizes(path)(K.vocabulary_tokens(path)("text"))
    return t.documents.select("doc_id", told.alias("told")).select("doc_id", F.md5("told.text").alias("digest"), (F.col("told.n") > 0).alias("has_tokens"))


@query(f"SELECT pair_id, array_to_string(list_resize(list_slice(ids, 1, 32), 32, 0), ',') AS ids FROM (SELECT pair_id, {WORDS.format('prompt')} AS ids FROM tasks)")
def TOK2_pad_truncate(t):
    return t.tasks.select("pair_id", joined(A.fitted(K.word_tokens(F.col("prompt")), 32, 0)).alias("ids"))


@query(f"SELECT pair_id, array_to_string(list_slice({WORDS.format('prompt')}, 1, 16), ',') AS ids FROM tasks")
def TOK3_bytes_and_back(t):
    rows = concat.to_bytes(t.tasks.select("pair_id", K.word_tokens(F.col("prompt")).alias("tokens")))
    return concat.from_bytes(rows, "tokens", 16).select("pair_id", joined("tokens").alias("ids"))


CHUNKS = f"""
WITH flat AS (SELECT doc_id, unnest(list_append(ids, 2)) AS tok, generate_subscripts(list_append(ids, 2), 1) AS i FROM (SELECT doc_id, {WORDS.format('text')} AS ids FROM documents)),
numbered AS (SELECT tok, row_number() OVER (ORDER BY doc_id, i) - 1 AS p FROM flat)
SELECT chunk_id::BIGINT AS chunk_id, sum(tok)::BIGINT AS total, md5(string_agg(tok::VARCHAR, ',' ORDER BY p)) AS digest FROM (SELECT p // 2048 AS chunk_id, tok, p FROM numbered) GROUP BY chunk_id HAVING count(*) = 2048"""


@query(CHUNKS)
def TOK4_concat_chunk(t):
    rows = t.documents.select("doc_id", K.word_tokens(F.col("text")).alias("ids"))
    chunks = concat.concat_chunks(rows, "ids", "doc_id", 2048, eos=(2,))
    return chunks.select("chunk_id", F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.md5(joined("tokens")).alias("digest"))


@query(f"""
WITH RECURSIVE d AS (SELECT (doc_id // 2000)::BIGINT AS stream, row_number() OVER (PARTITION BY doc_id // 2000 ORDER BY doc_id) AS r, len({WORDS.format('text')}) + 1 AS n, list_append({WORDS.format('text')}, 2) AS ids FROM documents),
fold AS (SELECT stream, r, n AS held, r AS first, 0 AS chunk FROM d WHERE r = 1 UNION ALL
SELECT d.stream, d.r, CASE WHEN fold.held >= 512 THEN d.n ELSE fold.held + d.n END, CASE WHEN fold.held >= 512 THEN d.r ELSE fold.first END, fold.chunk + CASE WHEN fold.held >= 512 THEN 1 ELSE 0 END FROM fold JOIN d ON d.stream = fold.stream AND d.r = fold.r + 1),
full_ AS (SELECT stream, chunk, first, r FROM fold WHERE held >= 512)
SELECT f.stream, f.chunk::BIGINT AS chunk_id, md5(array_to_string(list_slice(flatten(list(d.ids ORDER BY d.r)), 1, 512), ',')) AS digest FROM full_ f JOIN d ON d.stream = f.stream AND d.r BETWEEN f.first AND f.r GROUP BY f.stream, f.chunk""")
def TOK4_concat_chunk_no_wrap(t):
    rows = t.documents.select("doc_id", F.floor(F.col("doc_id") / 2000).alias("stream"), K.word_tokens(F.col("text")).alias("ids"))
    return concat.concat_chunks_no_wrap(rows, "ids", "doc_id", 512, eos=(2,), stream="stream").select("stream", "chunk_id", F.md5(joined("tokens")).alias("digest"))


@query("SELECT 'two tokens' AS given, 1::BIGINT AS warnings, false AS refused UNION ALL SELECT 'nothing', 0, true")
def TOK5_join_checks(t):
    tokenizer, refused = K.Tokenizer(), False
    said = tokenizer.check_joins("<s> <b>", "")
    try:
        tokenizer.check_joins()
    except ValueError:
        refused = True
    return t.rows([("two tokens", len(said), False), ("nothing", 0, refused)], "given string, warnings long, refused boolean")


@query(f"SELECT pair_id, array_to_string(list_filter(list_resize(list_slice({WORDS.format('prompt')}, 1, 24), 24, 0), lambda x: x <> 0), ',') AS ids FROM tasks")
def TOK6_strip_padding(t):
    return t.tasks.select("pair_id", joined(A.stripped(A.fitted(K.word_tokens(F.col("prompt")), 24, 0), F.lit(0))).alias("ids"))


@query(f"SELECT pair_id, array_to_string(CASE WHEN len(ids) > 0 AND ids[-1] = 2 THEN ids ELSE list_append(ids, 2) END, ',') AS ids FROM (SELECT pair_id, list_transform({WORDS.format('response')}, lambda x: CASE WHEN x % 5 = 0 THEN 2 ELSE x END) AS ids FROM tasks)")
def TOK7_ensure_eos(t):
    ids = F.transform(K.word_tokens(F.col("response")), lambda x: F.when(x % 5 == 0, F.lit(2).cast("long")).otherwise(x))
    return t.tasks.select("pair_id", joined(A.with_eos(ids, 2)).alias("ids"))


@query("SELECT 32868::BIGINT AS vocabulary, 32867::BIGINT AS first_sentinel, 32768::BIGINT AS last_sentinel, 0::BIGINT AS pad")
def TOK8_adapted_tokenizer(t):
    own = K.Tokenizer().adapted(100)
    return t.rows([(own.vocabulary, own.sentinel(0), own.sentinel(99), own.pad)], "vocabulary long, first_sentinel long, last_sentinel long, pad long")


SEQUENCES = f"(SELECT pair_id, list_transform({WORDS.format('prompt')}, lambda x: CASE WHEN x % 7 = 0 THEN 2 ELSE x END) AS ids FROM tasks)"


def _separated(t):
    return t.tasks.select("pair_id", F.transform(K.word_tokens(F.col("prompt")), lambda x: F.when(x % 7 == 0, F.lit(2).cast("long")).otherwise(x)).alias("ids"))


@query(f"SELECT pair_id, array_to_string(list_transform(range(1, len(ids) + 1), lambda i: len(list_filter(list_slice(ids, 1, i - 1), lambda x: x = 2))), ',') AS seq FROM {SEQUENCES}")
def TOK9_sequence_id_eos(t):
    return _separated(t).select("pair_id", joined(A.sequence_id("ids", eos=2)).alias("seq"))


@query(f"SELECT pair_id, array_to_string(list_transform(range(1, len(ids) + 1), lambda i: len(list_filter(list_slice(ids, 1, i), lambda x: x = 2))), ',') AS seq FROM {SEQUENCES}")
def TOK9_sequence_id_bos(t):
    return _separated(t).select("pair_id", joined(A.sequence_id("ids", bos=2)).alias("seq"))


@query(f"SELECT pair_id, array_to_string(list_transform(list_resize(list_slice({WORDS.format('prompt')}, 1, 24), 24, 0), lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), ',') AS labels FROM tasks")
def TOK10_clm_labels(t):
    return t.tasks.select("pair_id", joined(A.clm_labels(A.fitted(K.word_tokens(F.col("prompt")), 24, 0), F.lit(0))).alias("labels"))


@query(f"""SELECT pair_id, array_to_string(list_transform(ids, lambda t, i: CASE WHEN {drawn('s', '(i - 1)', 1)} >= 322122546 THEN t WHEN {drawn('s', '(i - 1)', 2)} < 1717986917 THEN 3 WHEN {drawn('s', '(i - 1)', 2)} < 1932735282 THEN {drawn('s', '(i - 1)', 3)} % 32768 ELSE t END), ',') AS input_ids,
array_to_string(list_transform(ids, lambda t, i: CASE WHEN {drawn('s', '(i - 1)', 1)} < 322122546 THEN t ELSE -100 END), ',') AS labels FROM (SELECT pair_id, {WORDS.format('prompt')} AS ids, {seeded('0', 'pair_id', 'mlm')} AS s FROM tasks)""")
def TOK10_mlm_labels(t):
    inputs, labels = A.mlm(K.word_tokens(F.col("prompt")), "pair_id", 0.15, 3, 32_768)
    return t.tasks.select("pair_id", joined(inputs).alias("input_ids"), joined(labels).alias("labels"))


@query(f"SELECT pair_id, array_to_string(CASE WHEN len(ids) = 0 THEN ids ELSE list_append(list_slice(ids, 2, len(ids)), -100) END, ',') AS targets FROM (SELECT pair_id, {WORDS.format('prompt')} AS ids FROM tasks)")
def TOK11_next_token_targets(t):
    return t.tasks.select("pair_id", joined(A.next_targets(K.word_tokens(F.col("prompt")))).alias("targets"))


@query("SELECT size, ceil(size / 64.0)::BIGINT * 64 AS padded FROM (VALUES (50257::BIGINT), (50304), (32000), (1)) v(size)")
def TOK12_vocabulary_padding(t):
    return t.rows([(s, K.padded_vocabulary(s, 64)) for s in (50257, 50304, 32000, 1)], "size long, padded long")


NUMBERED = f"(SELECT pair_id, (row_number() OVER (ORDER BY pair_id) - 1) // 16 AS batch_id, (row_number() OVER (ORDER BY pair_id) - 1) % 16 AS pos, {WORDS.format('prompt')} AS ids FROM tasks)"


@query(f"SELECT pair_id, batch_id::BIGINT AS batch_id, len(ids)::BIGINT AS n_tokens, array_to_string(list_concat(list_resize([]::BIGINT[], max(len(ids)) OVER (PARTITION BY batch_id) - len(ids), 0), ids), ',') AS ids FROM {NUMBERED}")
def TOK13_left_pad_batch(t):
    from ..operators.collate import batched, pad_to_longest

    rows = batched(t.tasks.select("pair_id", K.word_tokens(F.col("prompt")).alias("ids")), "pair_id", 16)
    return pad_to_longest(rows, "ids", 0).select("pair_id", "batch_id", F.col("n_tokens").cast("long").alias("n_tokens"), joined("ids").alias("ids"))


@query(f"SELECT pair_id, len(ids)::BIGINT AS true_length, array_to_string(list_filter(ids, lambda x: x <> 2), ',') AS ids FROM (SELECT pair_id, {WORDS.format('prompt')} AS ids FROM tasks)")
def TOK14_pad_and_strip_end(t):
    from ..operators.collate import batched, pad_to_longest

    rows = batched(t.tasks.select("pair_id", K.word_tokens(F.col("prompt")).alias("ids")).withColumn("true_length", F.size("ids").cast("long")), "pair_id", 16)
    return pad_to_longest(rows, "ids", 2, "right").select("pair_id", "true_length", joined(A.stripped("ids", F.lit(2))).alias("ids"))


@query(f"SELECT pair_id, array_to_string(list_transform(range(1, len(m) + 1), lambda i: greatest(i - 1 - len(list_filter(list_slice(m, 1, i), lambda x: x = 0)), 0)), ',') AS position_ids FROM (SELECT pair_id, list_transform({WORDS.format('prompt')}, lambda x: CASE WHEN x % 3 = 0 THEN 0 ELSE 1 END) AS m FROM tasks)")
def TOK15_position_ids(t):
    mask = F.transform(K.word_tokens(F.col("prompt")), lambda x: F.when(x % 3 == 0, 0).otherwise(1))
    return t.tasks.select("pair_id", joined(A.position_ids(mask)).alias("position_ids"))
