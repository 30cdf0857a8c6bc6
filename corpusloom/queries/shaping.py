"""Collation, packing, denoising, prompts and masks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import tokenize as K
from ..operators import collate, denoise, icl, masks, packing, pairs
from .base import WORDS, drawn, joined, query, seeded

LENGTH = 48


def _tokenised(t):
    """Pairs as context and target ids, in batches of 16 by id."""
    rows = t.tasks.where("response is not null").select("pair_id", K.word_tokens(F.col("prompt")).alias("context"), K.word_tokens(F.col("response")).alias("target"))
    return rows


BASE = f"SELECT pair_id, {WORDS.format('prompt')} AS c, {WORDS.format('response')} AS t0 FROM tasks WHERE response IS NOT NULL"
ENDED = f"SELECT pair_id, c, CASE WHEN len(t0) > 0 AND t0[-1] = 2 THEN t0 ELSE list_append(t0, 2) END AS t FROM ({BASE})"
CUT = f"SELECT pair_id, c, CASE WHEN len(c) + len(t) > {LENGTH} THEN list_append(list_slice(list_slice(t, len(t) - ({LENGTH} - len(c)) + 1, len(t)), 1, {LENGTH} - len(c) - 1), 2) ELSE t END AS t FROM ({ENDED}) WHERE len(c) < {LENGTH}"


def _fill(value: int, n: str) -> str:
    return f"list_resize([]::BIGINT[], greatest({n}, 0), {value})"


COLLATED = f"""SELECT pair_id, array_to_string(list_concat({_fill(0, f'{LENGTH} - len(c) - len(t)')}, list_concat(c, t)), ',') AS input_ids,
 array_to_string(list_concat({_fill(-100, f'{LENGTH} - len(t)')}, t), ',') AS labels,
 array_to_string(list_concat({_fill(0, f'{LENGTH} - len(c) - len(t)')}, {_fill(1, 'len(c) + len(t)')}), ',') AS attention_mask,
 array_to_string(list_concat(list_concat({_fill(0, f'{LENGTH} - len(c) - len(t)')}, {_fill(1, 'len(c)')}), {_fill(0, 'len(t)')}), ',') AS bidirectional_mask FROM ({CUT})"""


def _text(df, *keys):
    return df.select(*keys, *(joined(c).alias(c) for c in df.columns if c not in keys))


@query(COLLATED)
def COL1_COL2_COL3_decoder_only(t):
    return _text(collate.decoder_only(_tokenised(t), LENGTH, 0, 2), "pair_id")


@query(
    f"""SELECT pair_id, array_to_string(list_concat({_fill(0, f'{LENGTH} - len(c)')}, c), ',') AS input_ids, array_to_string(list_concat({_fill(0, f'{LENGTH} - len(t)')}, t), ',') AS labels,
 array_to_string(list_concat({_fill(0, f'{LENGTH} - len(c)')}, {_fill(1, 'len(c)')}), ',') AS attention_mask FROM ({CUT})"""
)
def COL4_for_generation(t):
    return _text(collate.decoder_only(_tokenised(t), LENGTH, 0, 2, generation=True).drop("bidirectional_mask"), "pair_id")


CUT_BOTH = f"""SELECT pair_id, CASE WHEN len(c) > {LENGTH} THEN list_append(list_slice(c, 1, {LENGTH - 1}), 2) ELSE c END AS c,
 CASE WHEN len(t) >= {LENGTH} THEN list_append(list_slice(t, 1, {LENGTH - 1}), 2) ELSE t END AS t FROM ({ENDED})"""


@query(
    f"""SELECT pair_id, array_to_string(list_concat(c, {_fill(0, f'{LENGTH} - len(c)')}), ',') AS input_ids, array_to_string(list_concat({_fill(1, 'len(c)')}, {_fill(0, f'{LENGTH} - len(c)')}), ',') AS attention_mask,
 array_to_string(list_concat(t, {_fill(-100, f'{LENGTH} - len(t)')}), ',') AS labels FROM ({CUT_BOTH})"""
)
def COL5_encoder_decoder(t):
    return _text(collate.encoder_decoder(_tokenised(t), LENGTH, 0, 2).drop("decoder_input_ids", "decoder_attention_mask"), "pair_id")


@query(
    f"""SELECT pair_id, array_to_string(list_slice(list_concat(list_concat([0::BIGINT], t), {_fill(0, f'{LENGTH} - len(t)')}), 1, {LENGTH}), ',') AS decoder_input_ids,
 array_to_string(list_concat({_fill(1, 'len(t)')}, {_fill(0, f'{LENGTH} - len(t)')}), ',') AS decoder_attention_mask FROM (SELECT pair_id, t FROM ({CUT_BOTH}))"""
)
def COL6_decoder_inputs(t):
    # the pad id stands where labels are ignored; the last label itself only moves right while there is room
    return _text(collate.encoder_decoder(_tokenised(t), LENGTH, 0, 2).select("pair_id", "decoder_input_ids", "decoder_attention_mask"), "pair_id")


TRIMMED = f"""WITH b AS (SELECT pair_id, c, t, ((row_number() OVER (ORDER BY pair_id) - 1) // 16)::BIGINT AS batch_id FROM ({CUT})),
k AS (SELECT *, CASE WHEN batch_id = 0 THEN {LENGTH} ELSE least(ceil(max(len(c) + len(t)) OVER (PARTITION BY batch_id) / 8.0)::BIGINT * 8, {LENGTH}) END AS keep FROM b)
SELECT pair_id, batch_id, array_to_string(list_concat({_fill(0, 'keep - len(c) - len(t)')}, list_concat(c, t)), ',') AS input_ids, array_to_string(list_concat({_fill(-100, 'keep - len(t)')}, t), ',') AS labels FROM k"""


@query(TRIMMED)
def COL7_trimmed_batches(t):
    rows = collate.batched(collate.decoder_only(_tokenised(t), LENGTH, 0, 2), "pair_id", 16)
    rows = collate.trimmed(rows, ("input_ids", "labels", "attention_mask", "bidirectional_mask"))
    return rows.select("pair_id", "batch_id", joined("input_ids").alias("input_ids"), joined("labels").alias("labels"))


@query("SELECT pair_id, 3::BIGINT AS epoch, 'finetuning' AS loader FROM tasks")
def COL8_batch_metadata(t):
    return collate.with_metadata(t.tasks.select("pair_id"), epoch=3, loader="finetuning").withColumn("epoch", F.col("epoch").cast("long"))


@query(COLLATED.replace(f"({BASE})", f"(SELECT pair_id, list_append(c, 5) AS c, t0 FROM ({BASE}))"))
def COL9_separator(t):
    return _text(collate.decoder_only(_tokenised(t), LENGTH, 0, 2, separator=collate.separator_ids(True, 5)), "pair_id")


@query(f"SELECT pair_id, array_to_string(list_concat(list_concat({_fill(0, f'{LENGTH} - len(c) - len(t)')}, {_fill(1, 'len(c)')}), {_fill(0, 'len(t)')}), ',') AS mask FROM ({CUT})")
def COL10_inferred_bidirectional(t):
    return collate.decoder_only(_tokenised(t), LENGTH, 0, 2).select("pair_id", joined(A.bidirectional("attention_mask", "labels")).alias("mask"))


@query(f"SELECT pair_id, len(c)::BIGINT AS n FROM ({BASE}) WHERE len(c) < 20")
def FLT1_prompt_length(t):
    rows = t.tasks.where("response is not null").select("pair_id", K.word_tokens(F.col("prompt")).alias("ids"))
    return pairs.shorter_prompts(rows, "ids", 20).select("pair_id", F.size("ids").cast("long").alias("n"))


@query(f"SELECT count(*)::BIGINT AS kept FROM ({BASE}) WHERE len(c) + 1 < {LENGTH}")
def FLT2_context_length(t):
    return collate.decoder_only(_tokenised(t), LENGTH, 0, 2, separator=(5,)).agg(F.count("*").alias("kept"))


def _batches(t, raw):
    return collate.batched(collate.decoder_only(_tokenised(t), 128, 0, 2), "pair_id", raw).withColumn("stream", F.floor(F.col("batch_id") / 8))


def _packed_sql(raw: int, stream: str, select: str, drawn: int = 1 << 40) -> str:
    """First fit, largest first, as a recursion over examples: a step an example, all streams at once; a batch's last step
    puts the 8 fullest bins out and keeps 80 others open. ``select`` reads from ``y`` (examples) and ``f`` (steps)."""
    cut = CUT.replace(str(LENGTH), "128")
    return f"""(WITH RECURSIVE x AS (SELECT list_concat(c, t) AS ids, list_concat({_fill(-100, 'len(c)')}, t) AS labels, row_number() OVER (ORDER BY pair_id) - 1 AS g FROM ({cut})),
v AS (SELECT *, g // {raw} AS batch_id, {stream.format(f'(g // {raw})')} AS stream, len(ids) AS size, count(*) OVER (PARTITION BY g // {raw}) AS m FROM x WHERE g < {drawn}),
y AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY size DESC, g) - 1 AS d, row_number() OVER (PARTITION BY stream ORDER BY batch_id, size DESC, g) AS step FROM v {'WHERE m >= 8' if drawn < 1 << 40 else ''}),
f AS (SELECT DISTINCT stream, -1::BIGINT AS batch_id, 0::BIGINT AS step, []::STRUCT(s BIGINT, m BIGINT[])[] AS line, NULL::STRUCT(s BIGINT, m BIGINT[])[] AS full_ FROM y UNION ALL
SELECT stream, batch_id, step, CASE WHEN last THEN list_slice(sorted, 9, 88) ELSE line END, CASE WHEN last THEN list_slice(sorted, 1, 8) END FROM (SELECT *, CASE WHEN last THEN list_transform(list_sort(list_transform(line, lambda b, i: {{'n': -b.s, 'i': i, 'b': b}})), lambda z: z.b) END AS sorted
FROM (SELECT stream, batch_id, step, last, CASE WHEN k IS NULL THEN list_append(line, {{'s': size, 'm': [g]}}) ELSE list_append(list_concat(list_slice(line, 1, k - 1), list_slice(line, k + 1, len(line))), {{'s': line[k].s + size, 'm': list_append(line[k].m, g)}}) END AS line
FROM (SELECT f.stream, y.batch_id, y.step, f.line, y.size, y.g, y.d = y.m - 1 AS last, CASE WHEN y.m - y.d > greatest(0, 8 - len(f.line)) THEN list_filter(range(1, len(f.line) + 1), lambda j: f.line[j].s + y.size <= 128)[1] END AS k FROM f JOIN y ON y.stream = f.stream AND y.step = f.step + 1))))
{select})"""


STREAMS = "({} // 8)"
STATISTICS = "SELECT sum(used)::BIGINT AS packed_tokens, (SELECT sum(size) FROM y)::BIGINT AS total_tokens, count(*)::BIGINT AS rows FROM (SELECT unnest(full_).s AS used FROM f WHERE full_ IS NOT NULL)"


@query(f"SELECT stream::BIGINT AS stream, batch_id::BIGINT AS batch_id, pos::INT AS pos, used::INT AS used, input_ids, sequence_id, labels FROM " + _packed_sql(24, STREAMS, f"""SELECT e.stream, e.batch_id, e.pos, e.used, array_to_string(list_concat({_fill(0, '128 - e.used')}, flatten(list(y.ids ORDER BY k))), ',') AS input_ids,
array_to_string(list_concat({_fill(-1, '128 - e.used')}, flatten(list(list_transform(y.ids, lambda z: k - 1) ORDER BY k))), ',') AS sequence_id,
array_to_string(list_concat({_fill(-100, '128 - e.used')}, flatten(list(CASE WHEN k = 1 THEN y.labels ELSE list_concat([-100], list_slice(y.labels, 2, len(y.labels))) END ORDER BY k))), ',') AS labels
FROM (SELECT stream, batch_id, pos, b.s AS used, unnest(b.m) AS g, generate_subscripts(b.m, 1) AS k FROM (SELECT stream, batch_id, unnest(full_) AS b, unnest(range(0, len(full_))) AS pos FROM f WHERE full_ IS NOT NULL)) e JOIN y ON y.g = e.g GROUP BY e.stream, e.batch_id, e.pos, e.used"""))
def PCK1_PCK5_packed_batches(t):
    raw = packing.raw_batch(8, 3.0)
    packed = packing.pack_batches(_batches(t, raw), 8, 128, 0, stream="stream")
    return packed.select("stream", "batch_id", "pos", "used", joined("input_ids").alias("input_ids"), joined("sequence_id").alias("sequence_id"), joined("labels").alias("labels"))


@query(f"SELECT pair_id, array_to_string(list_concat(c, t), ',') AS input_ids FROM ({CUT})")
def PCK2_trimmed_examples(t):
    rows = collate.decoder_only(_tokenised(t), LENGTH, 0, 2)
    kept = F.transform(F.filter(F.arrays_zip("input_ids", "attention_mask"), lambda x: x["attention_mask"] == 1), lambda x: x["input_ids"])
    return rows.select("pair_id", joined(kept).alias("input_ids"))


@query("SELECT 'labels' AS name, '-100,1,2,-100,4' AS value UNION ALL SELECT 'sequence_id', '0,0,0,1,1'")
def PCK3_joined_examples(t):
    one = packing.joined([{"labels": [-100, 1, 2], "sequence_id": [0, 0, 0]}, {"labels": [3, 4], "sequence_id": [0, 0]}])
    return t.rows([(k, ",".join(map(str, v))) for k, v in one.items()], "name string, value string")


@query("SELECT 8::BIGINT AS size, 3.0::DOUBLE AS ratio, 24::BIGINT AS raw UNION ALL SELECT 8, 5.5, 44 UNION ALL SELECT 8, 1.0, 8")
def PCK6_packing_ratio(t):
    return t.rows([(8, r, packing.raw_batch(8, r)) for r in (3.0, 5.5, 1.0)], "size long, ratio double, raw long")


@query("SELECT packed_tokens, total_tokens, rows, 1 - packed_tokens::DOUBLE / total_tokens AS waste, packed_tokens::DOUBLE / (rows * 128) AS efficiency FROM " + _packed_sql(24, STREAMS, STATISTICS))
def PCK4_AGG7_packing_statistics(t):
    return packing.statistics(packing.pack_batches(_batches(t, 24), 8, 128, 0, stream="stream"), 128)


RATIOS = packing.ratios(1.5, 4.0, 6, 8)


@query(" UNION ALL ".join(f"SELECT {ratio}::DOUBLE AS ratio, {raw}::BIGINT AS raw_rows, round(100 * (1 - packed_tokens::DOUBLE / (rows * 128)), 4) AS padding_percent, round(100 * (1 - packed_tokens::DOUBLE / total_tokens), 4) AS waste_percent FROM {_packed_sql(raw, '0', STATISTICS, 100 * max(r for _, r in RATIOS))}" for ratio, raw in RATIOS))
def AGG8_packing_profile(t):
    return packing.profile(collate.decoder_only(_tokenised(t), 128, 0, 2), "pair_id", 8, 128, RATIOS)


@query(
    "SELECT CASE WHEN mean IS NULL THEN 'sequence' ELSE 'span' END AS kind, ratio, mean FROM (VALUES (0.15::DOUBLE, 3.0::DOUBLE), (0.5, 8.0), (0.25, NULL)) v(ratio, mean)"
)
def DEN3_noiser_table(t):
    kinds = denoise.noisers([(3.0, 0.15), (8.0, 0.5)], [0.25])
    return t.rows([("sequence" if n.mean is None else "span", n.ratio, n.mean) for n in kinds], "kind string, ratio double, mean double")


@query("""WITH k AS (SELECT * FROM (VALUES (0.15::DOUBLE, 3.0::DOUBLE), (0.5, 8.0), (0.25, NULL)) v(ratio, mean), (VALUES (true), (false)) d(decoder_only)),
c AS (SELECT *, greatest(raw, 2) AS n FROM k, range(1, 513) r(raw)), o AS (SELECT *, least(greatest(round_even(ratio * n, 0), 1), n - 1) AS noise FROM c), s AS (SELECT *, greatest(round_even(noise / mean, 0), 1) AS spans FROM o),
f AS (SELECT *, n - noise + spans + decoder_only::INT AS inputs, noise + spans + 1 AS labels FROM s)
SELECT ratio, mean, decoder_only, CASE WHEN mean IS NULL THEN 255 - decoder_only::INT::BIGINT ELSE max(CASE WHEN CASE WHEN decoder_only THEN inputs + labels ELSE greatest(inputs, labels) END <= 256 THEN raw END) END::BIGINT AS longest FROM f GROUP BY ratio, mean, decoder_only""")
def DEN2_longest_starts(t):
    kinds = denoise.noisers([(3.0, 0.15), (8.0, 0.5)], [0.25])
    return t.rows([(n.ratio, n.mean, d, denoise.longest_start(256, n, d, d)) for n in kinds for d in (True, False)], "ratio double, mean double, decoder_only boolean, longest long")


def _noised(t, decoder_only):
    rows = t.documents.select("doc_id", K.word_tokens(F.col("text")).alias("ids"))
    return denoise.denoised(rows, "ids", "doc_id", 256, denoise.noisers([(3.0, 0.15), (8.0, 0.5)], [0.25], {"[S2S]": (5,), "[NLU]": (6,), "[NLG]": (7,)}), decoder_only=decoder_only, seed=17)


def _noised_sql(decoder_only: bool) -> str:
    """Corruption in SQL: parts cut at the places with the least draws, inputs and labels put together span by span."""
    kinds = denoise.noisers([(3.0, 0.15), (8.0, 0.5)], [0.25])
    first, second, third = (denoise.longest_start(256, denoise.Noiser(n.ratio, n.mean, p), decoder_only, decoder_only) for n, p in zip(kinds, ((6,), (7,), (5,))))
    marks = lambda total, salt: f"""(SELECT doc_id, list_concat([0], list_concat(coalesce(list(p ORDER BY p) FILTER (WHERE r < spans), []), [any_value(t)])) AS at FROM (SELECT doc_id, p, spans, t, row_number() OVER (PARTITION BY doc_id ORDER BY {drawn('s', 'p', salt)}, p) AS r
FROM (SELECT doc_id, s, spans, {total} AS t, unnest(range(0, {total})) AS p FROM n) WHERE p > 0 UNION ALL SELECT doc_id, 0, spans, {total}, 1099511627776 FROM n) GROUP BY doc_id)"""  # noqa: E731
    text = lambda x: f"array_to_string({x}, ',')"
    gap = "256 - len(i) - len(l)"
    if decoder_only:
        columns = f"""{text(f"list_concat({_fill(0, gap)}, list_concat(i, l))")} AS input_ids, {text(f"list_concat({_fill(-100, '256 - len(l)')}, l)")} AS labels,
{text(f"list_concat({_fill(0, gap)}, {_fill(1, 'len(i) + len(l)')})")} AS attention_mask, {text(f"list_concat({_fill(0, gap)}, list_concat({_fill(1, 'len(i)')}, {_fill(0, 'len(l)')}))")} AS bidirectional_mask"""
    else:
        columns = f"""{text("list_resize(i, 256, 0)")} AS input_ids, {text("list_resize(l, 256, -100)")} AS labels, {text(f"list_concat({_fill(1, 'len(i)')}, {_fill(0, '256 - len(i)')})")} AS attention_mask,
{text("list_resize(list_concat([0], list_slice(l, 1, len(l) - 1)), 256, 0)")} AS decoder_input_ids, {text(f"list_concat({_fill(1, 'len(l)')}, {_fill(0, '256 - len(l)')})")} AS decoder_attention_mask"""
    return f"""WITH d AS (SELECT doc_id, {WORDS.format('text')} AS ids, {seeded('17', 'doc_id')} AS s FROM documents),
w AS (SELECT *, {drawn('s', '0', 1)} % 3 AS k FROM d WHERE len(ids) > 0), c AS (SELECT doc_id, s, k::INT AS noiser, list_slice(ids, greatest(len(ids) - start + 1, 1), len(ids)) AS tok, ratio, mean, head FROM w JOIN (VALUES (0, 0.15::DOUBLE, 3.0::DOUBLE, 6, {first}), (1, 0.5, 8.0, 7, {second}), (2, 0.25, NULL, 5, {third})) v(kind, ratio, mean, head, start) ON v.kind = w.k),
m AS (SELECT *, len(tok) AS n, greatest(len(tok), 2) AS f FROM c), o AS (SELECT *, CASE WHEN mean IS NULL THEN least(round_even(1 + (2 * ratio * ({drawn('s', '0', 4)} / 2147483647.0::DOUBLE)) * (n - 1), 0), f - 1) ELSE least(greatest(round_even(ratio * f, 0), 1), f - 1) END::BIGINT AS noise FROM m),
n AS (SELECT *, CASE WHEN mean IS NULL THEN 1 ELSE least(greatest(round_even(noise / mean, 0), 1), noise, f - noise) END::BIGINT AS spans FROM o),
b AS (SELECT n.*, x.at AS kc, y.at AS nc FROM n JOIN {marks('f - noise', 2)} x USING (doc_id) JOIN {marks('noise', 3)} y USING (doc_id)),
r AS (SELECT doc_id, noiser, list_concat([head], CASE WHEN mean IS NULL THEN list_slice(tok, 1, CASE WHEN n = 1 THEN 1 ELSE n - noise END) ELSE flatten(list_transform(range(1, spans + 1), lambda j: list_concat(list_slice(tok, kc[j] + nc[j] + 1, kc[j + 1] + nc[j]), CASE WHEN n > 1 THEN [32868 - j] ELSE [] END))) END) AS i,
CASE WHEN mean IS NULL THEN CASE WHEN n = 1 THEN [] ELSE list_slice(tok, n - noise + 1, n) END WHEN n = 1 THEN [32867] ELSE flatten(list_transform(range(1, spans + 1), lambda j: list_concat([32868 - j], list_slice(tok, kc[j + 1] + nc[j] + 1, kc[j + 1] + nc[j + 1])))) END AS l FROM b),
e AS (SELECT doc_id, noiser, {"list_append(i, 2)" if decoder_only else "i"} AS i, list_append(l, 2) AS l FROM r)
SELECT doc_id, noiser, {columns} FROM e"""


@query(_noised_sql(True))
def DEN4_DEN10_decoder_only(t):
    return _text(_noised(t, True), "doc_id", "noiser")


@query(_noised_sql(False))
def DEN5_DEN9_encoder_decoder(t):
    return _text(_noised(t, False), "doc_id", "noiser")


@query(
    "SELECT doc_id, TRUE AS restored FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '\\S')".replace("\\\\", "\\")
)
def DEN7_DEN8_round_trip(t):
    """Inputs and labels of span corruption, put together again at the sentinels, give the tokens."""
    length = 192
    noised = denoise.denoised(t.documents.select("doc_id", K.word_tokens(F.col("text")).alias("ids")), "ids", "doc_id", 256, [denoise.Noiser(0.15, 3.0)], seed=3, side="right", decoder_only=False, most_raw=length)
    raw = t.documents.select("doc_id", F.slice(K.word_tokens(F.col("text")), 1, min(length, denoise.longest_start(256, denoise.Noiser(0.15, 3.0), False, False))).alias("raw"))
    tokenizer = K.Tokenizer().adapted()
    low, high = sorted((tokenizer.sentinel(0), tokenizer.sentinel(tokenizer.sentinels - 1)))
    marked = lambda x: x.between(low, high)
    # a span is what follows its sentinel in the labels, up to the next one or the end
    labels = F.filter("labels", lambda x: (x > 2) | marked(x))
    places = F.filter(F.sequence(F.lit(1), F.size("said")), lambda i: marked(F.element_at("said", i)))
    both = noised.join(raw, "doc_id").withColumn("said", labels).withColumn("at", F.concat(places, F.array(F.size("said") + 1)))
    span = lambda x: F.slice("said", F.element_at("at", F.array_position("at", F.array_position("said", x).cast("int")).cast("int")) + 1, F.element_at("at", (F.array_position("at", F.array_position("said", x).cast("int")) + 1).cast("int")) - F.array_position("said", x).cast("int") - 1)
    whole = F.flatten(F.transform(F.filter("input_ids", lambda x: (x > 2) | marked(x)), lambda x: F.when(marked(x), span(x)).otherwise(F.array(x))))
    return both.select("doc_id", (whole == F.col("raw")).alias("restored"))


SHOT = "md5('0-' || item_id::VARCHAR)"


@query("SELECT item_id, query || '' AS prompt, ' ' || ltrim(choices[gold + 1]) AS continuation FROM copa")
def ICL4_zero_shot(t):
    task = icl.Task("copa", "multiple_choice")
    rows = icl.prompts(t.copa.withColumn("answer", F.get("choices", F.col("gold").cast("int"))), "item_id", "query", "answer", task, 0)
    return rows.select("item_id", "prompt", "continuation")


@query(f"""
WITH w AS (SELECT item_id, query, choices[gold + 1] AS answer, row_number() OVER (ORDER BY {SHOT}, item_id) AS r FROM copa),
top AS (SELECT item_id AS id, query || ' ' || ltrim(answer) AS whole, r FROM w WHERE r <= 3)
SELECT w.item_id, 'Finish: ' || (SELECT string_agg(whole || chr(10), '' ORDER BY r) FROM (SELECT * FROM top WHERE top.id <> w.item_id ORDER BY r LIMIT 2)) || w.query AS prompt, ' ' || ltrim(w.answer) AS continuation FROM w""")
def ICL4_JON9_two_shot(t):
    task = icl.Task("copa", "multiple_choice", (2,), prompt="Finish: ")
    rows = icl.prompts(t.copa.withColumn("answer", F.get("choices", F.col("gold").cast("int"))), "item_id", "query", "answer", task, 2)
    return rows.select("item_id", "prompt", "continuation")


@query(
    "SELECT 'metrics/' || label || '/' || n || '-shot/' || category || '/InContextLearningMultipleChoiceAccuracy' AS key FROM (SELECT DISTINCT label, trim(lower(category)) AS category FROM mc_items WHERE category IS NOT NULL), (SELECT unnest([0, 5]) AS n)"
)
def ICL1_ICL2_ICL3_metric_keys(t):
    groups = t.mc_items.where("category is not null").select("label", F.trim(F.lower("category")).alias("category")).distinct()
    tasks = groups.groupBy("label").agg(F.sort_array(F.collect_set("category")).alias("categories"))
    keys = F.explode(F.flatten(F.transform(F.array(F.lit(0), F.lit(5)), lambda n: F.transform("categories", lambda c: F.concat(F.lit("metrics/"), F.col("label"), F.lit("/"), n.cast("string"), F.lit("-shot/"), c, F.lit(f"/{icl.METRICS['multiple_choice']}"))))))
    return tasks.select(keys.alias("key"))


@query(r"SELECT pair_id, starts_with(array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(response), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+'), lambda w: w NOT IN ('a', 'an', 'the', '')), ' '), 'nothing but') AS correct FROM tasks WHERE response IS NOT NULL")
def ICL5_question_answering(t):
    rows = t.tasks.where("response is not null")
    return rows.select("pair_id", icl.qa_correct(F.col("response"), F.array(F.lit("nothing but"))).alias("correct"))


@query("SELECT label, count(*)::BIGINT AS items, sum((' ' || string_split(context, ' ')[-1] = ' ' || ltrim(continuation))::INT)::BIGINT AS correct, sum((item_id % 3 = 0 AND ' ' || string_split(context, ' ')[-1] <> ' ' || ltrim(continuation))::INT)::BIGINT AS mended FROM lm_tasks GROUP BY label")
def ICL6_language_modelling(t):
    """Continuations predicted as the context's last word, and by a better model that gets every third item right."""
    said = t.lm_tasks.withColumn("expected", icl.continuation(F.ltrim("continuation"))).withColumn("last", F.concat(F.lit(" "), F.element_at(F.split("context", " "), -1)))
    better = F.when(F.col("item_id") % 3 == 0, F.col("expected")).otherwise(F.col("last"))
    right, better = icl.lm_correct(F.col("last"), F.col("expected")), icl.lm_correct(better, F.col("expected"))
    return said.groupBy("label").agg(F.count("*").alias("items"), F.count_if(right).alias("correct"), F.count_if(better & ~right).alias("mended"))


@query(
    "SELECT item_id, arg_min(i, (p, i))::BIGINT AS picked, arg_min(i, (p, i)) = first(gold) AS correct FROM (SELECT item_id, gold, unnest(range(0, len(choices))) AS i, unnest(list_transform(choices, lambda c: ('0x' || substr(md5(c), 1, 4))::BIGINT)) AS p FROM mc_items WHERE len(choices) > 0) GROUP BY item_id"
)
def ICL7_ICL8_least_perplexity(t):
    scored = icl.expanded(t.mc_items).withColumn("perplexity", F.conv(F.substring(F.md5("choice"), 1, 4), 16, 10).cast("long"))
    return icl.best_choice(scored, "item_id").select("item_id", F.col("picked").cast("long").alias("picked"), "correct")


@query(f"""
SELECT event_id, '{icl.CHAT_SYSTEM.replace('{}', 'Be brief.')}' || coalesce(string_agg(replace('{icl.CHAT_USER}', '{{}}', event_type) || replace('{icl.CHAT_ASSISTANT}', '{{}}', user_id::VARCHAR), '') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') || replace('{icl.CHAT_USER}', '{{}}', event_type) || '{icl.CHAT_PREFIX}' AS prompt FROM events""")
def ICL9_WIN10_chat_prompts(t):
    turns = t.events.withColumn("reply", F.col("user_id").cast("string"))
    return icl.chat_prompts(turns, "user_id", "event_id", "event_type", "reply", "Be brief.").select("event_id", "prompt")


@query("SELECT pair_id, response AS completion FROM tasks WHERE response IS NOT NULL")
def ICL10_completion(t):
    rows = t.tasks.where("response is not null").withColumn("generated", F.concat("prompt", "response"))
    return rows.select("pair_id", icl.completion(F.col("generated"), F.col("prompt")).alias("completion"))


PAIRS = f"""WITH s AS (SELECT item_id, {WORDS.format('query')} AS ids FROM copa),
p AS (SELECT item_id, i, ids[i + 1] % 3 AS g, (i < 4)::INT AS pre FROM (SELECT item_id, ids, unnest(range(0, len(ids))) AS i FROM s)),
q AS (SELECT item_id, i, sum((g = 0)::INT) OVER (PARTITION BY item_id ORDER BY i) AS s, pre FROM p)
SELECT a.item_id, count(*)::BIGINT AS n, sum(a.i * 100 + b.i)::BIGINT AS total FROM q a JOIN q b ON a.item_id = b.item_id AND a.s = b.s AND (b.i <= a.i OR (a.pre = 1 AND b.pre = 1)) GROUP BY a.item_id"""


@query(PAIRS)
def JON10_attention_pairs(t):
    ids = K.word_tokens(F.col("query"))
    rows = t.copa.select("item_id", A.running_sum(F.transform(ids, lambda x: (x % 3 == 0).cast("long"))).alias("seq"), F.transform(ids, lambda _, i: (i < 4).cast("int")).alias("prefix"))
    return masks.attention_pairs(rows, "item_id", "seq", "prefix").groupBy("item_id").agg(F.count("*").alias("n"), F.sum(F.col("i") * 100 + F.col("j")).cast("long").alias("total"))


@query("SELECT h::INT AS head, i::INT AS i, j::INT AS j, round(-abs(i - j) * pow(2.0, -8.0 * (h + 1) / 8), 9) AS bias FROM range(8) a(h), range(16) b(i), range(16) c(j)")
def NUM4_alibi_bias(t):
    return masks.alibi(t.spark, 8, 16, full=True).withColumn("bias", F.round("bias", 9))


@query(
    "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)) / len(embedding) + 0.00001))), 6) AS total, round((embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)) / len(embedding) + 0.00001)), 6) AS first FROM embeddings"
)
def NUM6_rms_norm(t):
    normed = t.embeddings.select("vec_id", A.rms_norm("embedding").alias("v"))
    return normed.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


@query(
    "SELECT step::BIGINT AS step, round(CASE WHEN step < 10 THEN step / 10.0 ELSE 0.1 + 0.9 * (1 + cos(pi() * least(1.0, (step - 10) / 90.0))) / 2 END, 9) AS factor FROM range(0, 121, 10) r(step)"
)
def NUM15_cosine_schedule(t):
    from ..plans.config import learning_rate

    return t.rows([(s, round(learning_rate(s, "cosine", 10, 100, 0.1), 9)) for s in range(0, 121, 10)], "step long, factor double")


@query(TRIMMED)
def UDF4_collator_chain(t):
    """Collators are functions of frames, put together by ``transform``."""
    rows = (
        _tokenised(t)
        .transform(lambda df: collate.decoder_only(df, LENGTH, 0, 2))
        .transform(lambda df: collate.batched(df, "pair_id", 16))
        .transform(lambda df: collate.trimmed(df, ("input_ids", "labels", "attention_mask", "bidirectional_mask")))
    )
    return rows.select("pair_id", "batch_id", joined("input_ids").alias("input_ids"), joined("labels").alias("labels"))


@query("SELECT doc_id, TRUE AS whole FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '\\S')".replace("\\\\", "\\"))
def DEN6_one_span_at_the_end(t):
    """Sequence corruption keeps a head as input and leaves the rest as labels; both together are the tokens."""
    noiser = denoise.Noiser(0.25, None)
    ids = K.word_tokens(F.col("text"))
    noised = denoise.denoised(t.documents.select("doc_id", ids.alias("ids")), "ids", "doc_id", 256, [noiser], seed=5, side="right", decoder_only=False)
    raw = t.documents.select("doc_id", F.slice(ids, 1, denoise.longest_start(256, noiser, False, False)).alias("raw"))
    body = lambda c: F.filter(c, lambda x: x > 2)
    return noised.join(raw, "doc_id").select("doc_id", (F.concat(body("input_ids"), body("labels")) == F.col("raw")).alias("whole"))


@query("SELECT * FROM (VALUES ('min', '231'), ('max', '255'), ('300', '300'), ('none', 'none'), ('0', 'refused')) v(setting, raw_limit)")
def DEN11_raw_limits(t):
    from ..plans.config import raw_limit

    rows = []
    for name, setting in (("min", "min"), ("max", "max"), ("300", 300), ("none", None), ("0", 0)):
        try:
            limit = raw_limit(setting, [231, 255])
            rows.append((name, "none" if limit is None else str(limit)))
        except ValueError:
            rows.append((name, "refused"))
    return t.rows(rows, "setting string, raw_limit string")


@query("SELECT 3::BIGINT AS attempts, 'loaded' AS outcome")
def ICL11_retries(t):
    from ..plans.config import retried

    seen = []

    def load():
        seen.append(1)
        if len(seen) < 3:
            raise OSError("not yet")
        return "loaded"

    said = retried(load, times=5, wait=0.0)
    return t.rows([(len(seen), said)], "attempts long, outcome string")
