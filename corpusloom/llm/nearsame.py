"""Pairs of texts that have most of their words in common, over collections too large for pairwise comparison.

1. Texts with the same words form one class: copies, however many, take part in the search once a task.
2. Each class gets a BagMinHash signature (:mod:`.bagminhash`), cut into bands. The weight of a word is the number of
   its occurrences where bags are compared, and the same for all words where sets are, so that the chance to meet depends
   on nothing but the common share of the words, whatever else the table holds.
3. Classes meet where a band agrees. A band is so long that chance meetings stay few as the table grows, and bands are
   so many that links aren't lost. Bands come in groups that share their first component: a class travels once a group,
   with the keys of its bands, to the partition of that component's value, packed in one blob a batch and partition.
   There numpy sorts and pairs the rows, and a 128-bit sketch turns away chance meetings: of shorter texts by an exact
   bound, of longer ones by a wide margin. Large tables take the groups in rounds, whose shuffles go one after another.
4. The classes that met are verified exactly on all their words, for which the texts are read again. The ids of these
   classes pick them by a semi-join: Spark broadcasts the ids where they are few (``autoBroadcastJoinThreshold``), else
   the words of all classes are shuffled once, after the shuffle of the bands is gone.

The number of partitions grows with the input; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, drop, release
from ..plans.sizing import PARTITIONS, partitions, planned, shuffled_into
from .bagminhash import DEPTH, Signer, bands, weighted
from .words import mixed, occurrences, runs, set_ids, word_sets

BITS, LONG = 56, 64
ROUNDS, SMALL, PAIRS = 3, 2 << 20, 1 << 16


@dataclass(frozen=True)
class Near:
    """``threshold``: common words over words in either, as a fraction of whole numbers (7, 10), reached or exceeded.
    ``bag``: words count as often as they occur, not once. ``rows`` components a band, the first of them
    common to the bands of one of ``groups`` groups of ``bands`` / ``groups`` bands each: :meth:`recall` has the
    probability that texts meet; in signatures of bags, not in their verification,
    2**DEPTH occurrences of a word weigh as much as more. ``apart``: of the sketch's 120 bits those that may differ where
    both texts have ``LONG`` words or more; 120 turns none of those away."""

    threshold: tuple[int, int] = (7, 10)
    bag: bool = False
    rows: int = 7
    bands: int = 144
    groups: int = 12
    apart: int = 38

    @property
    def each(self) -> int:
        """Bands a group."""
        return self.bands // self.groups

    @property
    def width(self) -> int:
        """Components a group."""
        return 1 + (self.rows - 1) * self.each

    def recall(self, similarity: float | Column) -> float | Column:
        """The expected share of links of one ``similarity`` whose texts meet in a band."""
        return 1 - (1 - similarity * (1 - (1 - similarity ** (self.rows - 1)) ** self.each)) ** self.groups


def _elements(texts: list[str | None], p: Near, orders: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (repeated in bags), the set elements that stand for them, and the texts' offsets in both."""
    words, offsets = word_sets(texts, orders, p.bag)
    return words, occurrences(words, offsets) if p.bag else words, offsets


def _fresh(cls: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of classes that a task meets for the first time (ascending), and all classes it has met."""
    own, first = np.unique(cls, return_index=True)
    new = (own != 0) & ~np.isin(own, seen, assume_unique=True)
    return np.sort(first[new]), np.union1d(seen, own)


def _taken(words: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of some texts, and their offsets."""
    lengths = np.diff(offsets)[rows]
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    return words[np.repeat(offsets[:-1][rows] - bounds[:-1], lengths) + np.arange(bounds[-1])], bounds


def sketches(words: np.ndarray, offsets: np.ndarray, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two int64 of each text: the number of its words (255: or more) above ``BITS`` bits, and 64 more bits. Texts have
    words, all distinct.

    A bit of a text below ``LONG`` words says whether an odd number of its words fall on it, so two such texts differ in
    at most as many bits as words stand in one of them only. A bit of a longer one is drawn from a component."""
    sizes, place = np.diff(offsets), words % np.uint64(BITS + 64)
    first = np.where(place < BITS, np.uint64(1) << (place % np.uint64(BITS)), np.uint64(0))
    second = np.where(place < BITS, np.uint64(0), np.uint64(1) << ((place - np.uint64(BITS)) % np.uint64(64)))
    bits = mixed(signatures[:, : BITS + 64].astype(np.uint64)) & np.uint64(1)
    out = []
    for odd, own in ((first, bits[:, :BITS]), (second, bits[:, BITS:])):
        drawn = (own << np.arange(own.shape[1], dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        out.append(np.where(sizes < LONG, np.bitwise_xor.reduceat(odd, offsets[:-1]), drawn))
    return (out[0] | (np.minimum(sizes, 255).astype(np.uint64) << np.uint64(BITS))).view(np.int64), out[1].view(np.int64)


def may_be_near(x: tuple[Column, Column], y: tuple[Column, Column], p: Near) -> Column:
    """Whether two sketches can be of near-same texts."""
    more, less = p.threshold[1] + p.threshold[0], p.threshold[1] - p.threshold[0]
    a, b = F.shiftrightunsigned(x[0], BITS), F.shiftrightunsigned(y[0], BITS)
    differ = F.bit_count(x[0].bitwiseXOR(y[0]).bitwiseAND(F.lit((1 << BITS) - 1))) + F.bit_count(x[1].bitwiseXOR(y[1]))
    alike = F.when((a < LONG) & (b < LONG), differ * more <= (a + b) * less).when((a >= LONG) & (b >= LONG), differ <= p.apart).otherwise(True)
    return (F.least(a, b) * p.threshold[1] >= F.greatest(a, b) * p.threshold[0]) & alike


def members(texts: DataFrame, p: Near = Near(), ordered: bool = False) -> DataFrame:
    """(every column but text, cls) of all texts that have words; texts with the same words have one ``cls``.

    ``ordered`` adds ``seq``, which only texts with the same words in the same order share."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            orders = [] if ordered else None
            _, elements, offsets = _elements(batch.column("text").to_pylist(), p, orders)
            cls = set_ids(elements, offsets)
            out = batch.drop_columns(["text"]).append_column("cls", pa.array(cls))
            if ordered:
                out = out.append_column("seq", pa.array(np.concatenate(orders)))
            yield out.filter(pa.array(cls != 0))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema if f.name != "text")
    return texts.mapInArrow(run, f"{schema}, cls long{', seq long' if ordered else ''}")


def classes(texts: DataFrame, p: Near) -> DataFrame:
    """(cls, words): the words of the classes; a task sends a class on once."""

    def run(batches):
        seen = np.zeros(0, np.int64)
        for batch in batches:
            if batch.num_rows:
                words, elements, offsets = _elements(batch.column("text").to_pylist(), p)
                cls = set_ids(elements, offsets)
                fresh, seen = _fresh(cls, seen)
                own, bounds = _taken(words, offsets, fresh)
                held = pa.Array.from_buffers(pa.large_binary(), len(fresh), [None, pa.py_buffer(bounds * 8), pa.py_buffer(own)])
                yield pa.RecordBatch.from_arrays([pa.array(cls[fresh]), held.cast(pa.binary())], ["cls", "words"])

    return texts.select("text").mapInArrow(run, "cls long, words binary")


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of a column of classes, and their offsets."""
    held = column.to_pylist()
    sizes = np.array([len(x) >> 3 for x in held], np.int64)
    return np.frombuffer(b"".join(held), np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def _limits(p: Near) -> np.ndarray:
    """How many bits two sketches may differ in by the two texts' sizes; -1 where the sizes alone are too far apart. The
    same as :func:`may_be_near`."""
    a, b = np.arange(256)[:, None], np.arange(256)[None, :]
    short = (a + b) * (p.threshold[1] - p.threshold[0]) // (p.threshold[1] + p.threshold[0])
    most = np.where((a < LONG) & (b < LONG), short, np.where((a >= LONG) & (b >= LONG), p.apart, 128))
    return np.where(np.minimum(a, b) * p.threshold[1] >= np.maximum(a, b) * p.threshold[0], most, -1).astype(np.int16).ravel()


def _row(p: Near) -> np.dtype:
    """A class in one group: its id, its sketch, the keys of the group's bands."""
    return np.dtype([("cls", "<i8"), ("sketch", "<u8"), ("more", "<u8"), ("keys", "<u4", (p.each,))])


def group_keys(signature: np.ndarray, p: Near, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """uint64 texts x groups: the value of the component that a group shares; texts x groups x bands a group: the bands'
    keys. ``signature`` has the components of the groups from ``first`` to below ``last``."""
    cells, keys = np.empty((len(signature), last - first), np.uint64), np.empty((len(signature), last - first, p.each), np.uint64)
    for g in range(last - first):
        own = signature[:, g * p.width : (g + 1) * p.width]
        cells[:, g] = bands(own[:, :1], 1, 1, first + g)[:, 0].view(np.uint64)
        keys[:, g] = mixed(bands(own[:, 1:], p.rows - 1, p.each).view(np.uint64) ^ cells[:, g, None])
    return cells, keys


def _pairs(key: np.ndarray, rows: np.ndarray, limits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b), a < b, of the classes of rows with one key whose sketches may be of near-same texts, about ``PAIRS``
    meetings at once however many there are."""
    if not len(rows):
        return
    order = np.sort((key.astype(np.uint64) << np.uint64(32)) | np.arange(len(rows), dtype=np.uint64))
    key, order = order >> np.uint64(32), (order & np.uint64(0xFFFFFFFF)).view(np.int64)
    new = np.concatenate([[True], key[1:] != key[:-1], [True]])
    met = ~(new[1:] & new[:-1])  # rows that aren't alone with their key
    order, new = order[met], new[:-1][met]
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(order)))
    later = np.repeat(first + many, many) - np.arange(len(order)) - 1  # rows that each row meets behind it
    met = np.concatenate([[0], np.cumsum(later)])
    cls, sketch, more = (rows[x][order] for x in ("cls", "sketch", "more"))
    size = (sketch >> np.uint64(BITS)).astype(np.uint16)
    i = 0
    while met[i] < met[-1]:
        j = max(i + 1, int(np.searchsorted(met, met[i] + PAIRS, "right")) - 1)
        x = np.repeat(np.arange(i, j), later[i:j])
        y = x + 1 + np.arange(met[i], met[j]) - met[x]
        most = limits[(size[x] << np.uint16(8)) | size[y]]
        near = np.flatnonzero(np.bitwise_count(more[x] ^ more[y]) <= most)
        x, y, most = x[near], y[near], most[near]
        differ = np.bitwise_count((sketch[x] ^ sketch[y]) << np.uint64(64 - BITS)) + np.bitwise_count(more[x] ^ more[y])
        near = (differ <= most) & (cls[x] != cls[y])
        a, b = cls[x[near]], cls[y[near]]
        yield np.minimum(a, b), np.maximum(a, b)
        i = j


def candidates(texts: DataFrame, p: Near, first: int, last: int) -> DataFrame:
    """Distinct (a, b), a < b: classes that agree in a band of the groups from ``first`` to below ``last`` and whose
    sketches may be of near-same texts."""
    parts, limits, kind = int(texts.sparkSession.conf.get(PARTITIONS)), _limits(p), _row(p)
    count = last - first

    def sign(batches):
        signer, seen = Signer(p.width * count, p.width * first), np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            words, elements, offsets = _elements(batch.column("text").to_pylist(), p)
            cls = set_ids(elements, offsets)
            fresh, seen = _fresh(cls, seen)
            if not len(fresh):
                continue
            elements, _ = _taken(elements, offsets, fresh)
            words, offsets = _taken(words, offsets, fresh)
            if p.bag:
                starts, _ = runs(words, offsets)
                many = np.diff(np.append(starts, len(words)))
                signature = signer.sign(weighted(words[starts], np.minimum(many, 1 << DEPTH)), np.searchsorted(starts, offsets))
            else:
                signature = signer.sign(weighted(words), offsets)
            cells, keys = group_keys(signature, p, first, last)
            rows = np.empty(cells.shape, kind)
            rows["cls"], rows["keys"] = cls[fresh][:, None], keys.astype(np.uint32)
            for name, own in zip(("sketch", "more"), sketches(elements, offsets, signature)):
                rows[name] = own.view(np.uint64)[:, None]
            part = ((cells.ravel() >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            rows, held = rows.ravel()[np.argsort(part, kind="stable")], np.bincount(part, minlength=parts)
            ends = np.concatenate([[0], np.cumsum(held)]) * kind.itemsize
            blobs = pa.Array.from_buffers(pa.large_binary(), parts, [None, pa.py_buffer(ends), pa.py_buffer(rows.view(np.uint8))])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), blobs.cast(pa.binary())], ["part", "held"]).filter(pa.array(held > 0))

    def meet(batches):
        held = b"".join(x for batch in batches for x in batch.column("held").to_pylist())
        rows = np.frombuffer(held, kind)
        for k in range(p.each):
            for a, b in _pairs(rows["keys"][:, k], rows, limits):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    rows = texts.select("text").mapInArrow(sign, "part int, held binary")
    return rows.repartitionById(parts, F.col("part")).select("held").mapInArrow(meet, "a long, b long").distinct()


def _met(texts: DataFrame, p: Near) -> DataFrame:
    """The :func:`candidates` of all groups, as a cut table. The shuffle of a round is gone before the next one begins."""
    spark = texts.sparkSession
    rounds = min(ROUNDS, p.groups, max(1, -(-planned(texts) // SMALL)))
    with shuffled_into(spark, partitions(texts, 24.0 / rounds, 24 << 20)):
        some = []
        for i in range(rounds):
            some.append(cut(candidates(texts, p, p.groups * i // rounds, p.groups * (i + 1) // rounds)))
            release(spark)
        if rounds == 1:
            return some[0]
        pairs = cut(reduce(DataFrame.unionAll, some).distinct())
    for x in some:
        drop(x)
    return pairs


def links(texts: DataFrame, p: Near = Near()) -> DataFrame:
    """(a, b, common, either) of classes a < b that are near-same: ``common / either`` reaches the threshold.

    ``texts`` has a string column ``text``. Null and wordless texts have no class; copies have one, so a pair of copies
    is no link; an empty table gives no links. Texts of any length take part whole. The result is a cut table."""
    spark = texts.sparkSession

    def verify(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            (one, ends), (two, stops) = _unpacked(batch.column("one")), _unpacked(batch.column("two"))
            if p.bag:
                one, two = occurrences(one, ends), occurrences(two, stops)
            sizes = np.diff(ends) + np.diff(stops)
            doc = np.concatenate([np.repeat(np.arange(len(sizes)), np.diff(x)) for x in (ends, stops)])
            every = np.concatenate([one, two])
            order = np.lexsort((every, doc))
            every, doc = every[order], doc[order]
            same = (every[1:] == every[:-1]) & (doc[1:] == doc[:-1])
            common = np.bincount(doc[1:][same], minlength=len(sizes))
            near = common * p.threshold[1] >= (sizes - common) * p.threshold[0]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(common), pa.array(sizes - common)], ["a", "b", "common", "either"]).filter(pa.array(near))

    pairs = _met(texts, p)
    with shuffled_into(spark, partitions(texts, 4.0)):
        wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct())
        held = classes(texts, p).join(wanted, "cls", "left_semi").groupBy("cls").agg(F.first("words").alias("words"))
        with_one = pairs.join(held.withColumnRenamed("words", "one"), F.col("a") == F.col("cls")).drop("cls")
        with_two = with_one.join(held.withColumnRenamed("words", "two"), F.col("b") == F.col("cls")).drop("cls")
        found = cut(with_two.mapInArrow(verify, "a long, b long, common long, either long"))
    drop(pairs)
    drop(wanted)
    return found


def by_force(texts: DataFrame, chosen: DataFrame, p: Near = Near(), block_words: int = 1 << 22) -> DataFrame:
    """(a, b, common, either) of every class ``a`` of ``chosen`` (cls) and every other class ``b`` that are near-same,
    without signatures: each chosen class is compared with all classes. For checks of :func:`links`.

    Chosen classes are broadcast in blocks of about ``block_words`` words; each block is one pass over the classes,
    which counts common words in an index of the block's words. The result is a cut table."""
    spark, schema, out = texts.sparkSession, "a long, b long, common long, either long", None
    held = cut(classes(texts, p).groupBy("cls").agg(F.first("words").alias("words")))
    picked = cut(held.join(chosen.select("cls").distinct(), "cls", "left_semi"))
    blocks = -(-(picked.agg(F.sum(F.length("words"))).first()[0] or 0) // (8 * block_words))
    for i in range(blocks):
        block = picked.where(F.pmod(F.xxhash64("cls"), F.lit(blocks)) == i).toArrow().combine_chunks()
        block = spark.sparkContext.broadcast((block.column("cls").to_numpy(), *_unpacked(block.column("words"))))
        some = cut(held.mapInArrow(partial(_compared, block=block, p=p), schema))
        out = some if out is None else out.unionAll(some)
    return spark.createDataFrame([], schema) if out is None else out


def _compared(batches, block, p: Near):
    ids, words, ends = block.value
    words = occurrences(words, ends) if p.bag else words
    query = np.repeat(np.arange(len(ids)), np.diff(ends))
    order = np.argsort(words, kind="stable")
    words, query, wanted = words[order], query[order], np.diff(ends)
    for batch in batches:
        every, offsets = _unpacked(batch.column("words"))
        every = occurrences(every, offsets) if p.bag else every
        cls, sizes = batch.column("cls").to_numpy(), np.diff(offsets)
        first, last = np.searchsorted(words, every, "left"), np.searchsorted(words, every, "right")
        met = np.concatenate([[0], np.cumsum(last - first)])[offsets]  # postings before each class
        a = 0
        while a < len(cls):
            b = min(max(a + 1, int(np.searchsorted(met, met[a] + (1 << 22), "right")) - 1), a + max(1, (1 << 23) // max(len(ids), 1)), len(cls))
            lo, n = first[offsets[a] : offsets[b]], (last - first)[offsets[a] : offsets[b]]
            posting = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            row = np.repeat(np.repeat(np.arange(b - a), sizes[a:b]), n)
            common = np.bincount(row * len(ids) + query[posting], minlength=(b - a) * len(ids)).reshape(b - a, len(ids))
            either = sizes[a:b, None] + wanted[None, :] - common
            i, j = np.nonzero((common * p.threshold[1] >= either * p.threshold[0]) & (cls[a:b, None] != ids[None, :]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(cls[a:b][i]), pa.array(common[i, j]), pa.array(either[i, j])], ["a", "b", "common", "either"])
            a = b


def recall(rows: DataFrame, p: Near = Near(), every: int = 20) -> DataFrame:
    """Of the links that the classes of all rows (uid, text) with ``uid`` divisible by ``every`` have to any class, by
    tenths of similarity: (similarity, links, found, wrong, recall, least_expected). ``found`` of them :func:`links`
    gives, ``wrong`` it gives beside them; ``least_expected`` is the expected recall at the lower end of the tenth."""
    chosen = members(rows.select("uid", "text"), p).where(F.col("uid") % every == 0).select("cls").distinct()
    true = by_force(rows, chosen, p)
    got = links(rows, p)
    got = got.select("a", "b", "common", "either").unionAll(got.select(F.col("b").alias("a"), F.col("a").alias("b"), "common", "either"))
    got = got.join(chosen.withColumnRenamed("cls", "a"), "a", "left_semi").withColumn("hit", F.lit(1))
    both = true.withColumn("truth", F.lit(1)).join(got, ["a", "b", "common", "either"], "full")
    low = F.expr("10 * common div either") / 10
    per = both.groupBy(low.alias("similarity")).agg(F.count("truth").alias("links"), F.count_if(F.expr("truth is not null and hit is not null")).alias("found"), F.count_if(F.expr("truth is null")).alias("wrong"))
    return per.select("similarity", "links", "found", "wrong", F.try_divide("found", "links").alias("recall"), p.recall(F.col("similarity")).alias("least_expected"))
