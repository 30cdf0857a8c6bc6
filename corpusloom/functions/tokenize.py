"""Tokenizers as columns.

``code_points`` and ``byte_tokens`` are exact and reversible; ``word_tokens`` hashes white-space words into a fixed
vocabulary; ``vocabulary_tokens`` runs a public byte-pair vocabulary in Arrow batches.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import Column
from pyspark.sql import functions as F

_shipped: set[str] = set()

#: Characters or ids that are in work at once; words, and parts of words, whose ids a worker keeps; characters above which
#: it keeps none.
SLICE, KEPT, LONG = 1 << 17, 1 << 16, 64

#: Parts of a text, with the white space before them, that no piece of a byte-level vocabulary goes beyond: such a piece
#: goes on neither from one kind of letter, digit and sign to another, save from an apostrophe, nor to a blank, tab or line
#: end from anything but white space. Where engines differ on a character, it stays inside a part.
_PARTS = re.compile(r"\s*+(?:(?:[A-Za-z]++|[0-9]++)(?![^\x00-\x7f])|[!-&(-/:-@\[-`{-~]++(?=[A-Za-z0-9 \t\n\r]|\Z)|\S++(?:[^\S \t\n\r]\s*+\S*+)*+)|\s++")
_BREAK = re.compile(r"\S(?=[ \t\n\r])")


@dataclass(frozen=True)
class Tokenizer:
    """What the operators need to know of a tokenizer. Ids below ``reserved`` are special."""

    vocabulary: int = 32_768
    pad: int = 0
    bos: int = 1
    eos: int = 2
    sep: int | None = None
    mask: int = 3
    reserved: int = 4
    model_max_length: int = int(1e30)
    sentinels: int = 0

    def adapted(self, sentinels: int = 100) -> Tokenizer:
        """With ``sentinels`` extra ids at the end of the vocabulary, for span corruption."""
        return self if self.sentinels else Tokenizer(self.vocabulary + sentinels, self.pad, self.bos, self.eos, self.sep, self.mask, self.reserved, self.model_max_length, sentinels)

    def sentinel(self, i: int) -> int:
        """Id of the i-th sentinel, counted from the end of the vocabulary as usual for these models."""
        return self.vocabulary - 1 - i

    def check_joins(self, bos_text: str = "", eos_text: str = "") -> list[str]:
        """Warnings for joining documents; an error if nothing would separate them."""
        if not bos_text and not eos_text:
            raise ValueError("documents would run together: give a begin or an end text")
        said = []
        for name, text in (("begin", bos_text), ("end", eos_text)):
            if len(text.split()) > 1:
                said.append(f"the {name} text is more than one token")
        return said


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))


def word_tokens(text: Column, t: Tokenizer = Tokenizer()) -> Column:
    """Ids of white-space words: md5 modulo the vocabulary, an id that other engines compute alike. Null text: no tokens."""
    span = t.vocabulary - t.reserved
    one = lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("long") % span + t.reserved
    return F.transform(words(F.coalesce(text, F.lit(""))), one)


def code_points(text: Column) -> Column:
    """Unicode code points. Null text: no tokens."""
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def byte_tokens(text: Column) -> Column:
    """UTF-8 bytes."""
    hexed = F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
    return F.when(F.length(hexed) == 0, F.expr("cast(array() as array<bigint>)")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(hexed) - 1, F.lit(1)), F.lit(2)), lambda i: F.conv(hexed.substr(i, F.lit(2)), 16, 10).cast("long"))
    )


def text_of(points: Column) -> Column:
    """The text of code points of the basic plane below 256 and others alike, by ``chr`` where Spark has it."""
    return F.array_join(F.transform(points, lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "UTF-32")), "")


def shipped(spark, path: str) -> str:
    """The name by which every executor finds the driver's file ``path``, delivered once by Spark's own file server."""
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no vocabulary file {path}: name one that the driver can read")
    name = os.path.basename(path)
    if SparkFiles.get(name) not in _shipped:
        spark.sparkContext.addFile(path)
        _shipped.add(SparkFiles.get(name))
    return name


def _pieces(text: str) -> Iterator[str]:
    """A long text in pieces of little more than ``SLICE`` characters, if it has breaks there."""
    start = 0
    while start < len(text):
        cut = _BREAK.search(text, start + SLICE)
        stop = cut.end() if cut else len(text)
        yield text[start:stop]
        start = stop


def _unknown(kept: dict[str, bytes], words: list[str]) -> set[str]:
    """Those that aren't kept; all, if with them there would be too many."""
    new = set(filterfalse(kept.__contains__, words))
    if len(kept) + len(new) <= KEPT:
        return new
    kept.clear()
    return set(words)


def _forget(kept: dict[str, bytes], new: set[str]) -> None:
    for word in new:
        if len(word) > LONG:
            del kept[word]


class _Vocabulary:
    """A ``tokenizers`` vocabulary in a worker, on the task's own core.

    Where parts of a text are independent, the ids of parts met are kept for the next texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Vocabulary
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        v = self.vocabulary = Vocabulary.from_file(path)
        v.encode_special_tokens = True
        cut = v.pre_tokenizer
        plain = v.normalizer is None and v.truncation is None and v.padding is None and getattr(v.model, "dropout", None) is None
        self.by_parts = plain and isinstance(cut, ByteLevel) and cut.use_regex and not cut.add_prefix_space and all(t.special for t in v.get_added_tokens_decoder().values())
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def encoded(self, texts: list[str]) -> list[bytes]:
        return [array("q", e.ids).tobytes() for e in self.vocabulary.encode_batch_fast(texts, add_special_tokens=False)]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Of each text, its ids in eight bytes each."""
        return [b"".join(map(self.of_words, _pieces(text))) for text in texts] if self.by_parts else self.encoded(texts)

    def of_words(self, text: str) -> bytes:
        """By blanks, which is quick, where each stands alone."""
        first, *words = text.split(" ")
        new = _unknown(self.words, words)
        if "" in new or (first or "a")[-1].isspace() or any(w[-1].isspace() for w in new):
            return self.of_parts([text])[0]
        own, *ids = self.of_parts([first, *(f" {w}" for w in new)])
        self.words.update(zip(new, ids, strict=True))
        found = own + b"".join(map(self.words.__getitem__, words))
        _forget(self.words, new)
        return found

    def of_parts(self, texts: list[str]) -> list[bytes]:
        parts = [_PARTS.findall(t) for t in texts]
        new = _unknown(self.parts, list(chain.from_iterable(parts)))
        self.parts.update(zip(new, self.encoded(list(new)), strict=True))
        found = [b"".join(map(self.parts.__getitem__, own)) for own in parts]
        _forget(self.parts, new)
        return found

    @cached_property
    def bytes_of(self) -> dict[int, bytes] | None:
        """The bytes of each id, if the vocabulary only joins these."""
        from tokenizers.decoders import ByteLevel

        if not isinstance(self.vocabulary.decoder, ByteLevel):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in set(shown)]
        byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}
        return {i: bytes(map(byte.__getitem__, t)) if byte.keys() >= set(t) else t.encode() for t, i in self.vocabulary.get_vocab(with_added_tokens=True).items()}

    def texts(self, ids: list[list[int]]) -> list[str]:
        if self.bytes_of:
            try:
                return [b"".join(map(self.bytes_of.__getitem__, x)).decode("utf-8", "replace") for x in ids]
            except KeyError:  # an id that the vocabulary doesn't have
                pass
        return self.vocabulary.decode_batch(ids, skip_special_tokens=False)


@lru_cache(maxsize=1)
def _loaded(path: str) -> _Vocabulary:
    return _Vocabulary(path)


def _vocabulary(path: str) -> _Vocabulary:
    return _loaded(path if os.path.dirname(path) else SparkFiles.get(path))


def _slices(rows: pa.Array, sizes: pa.Array) -> Iterator[pa.Array]:
    """Consecutive rows of ``SLICE`` characters or ids together, or a single row that has more."""
    ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(rows):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, "right")))
        yield rows[start:stop]
        start = stop


def vocabulary_tokens(path: str):
    """A column function ``text -> array<long>`` of a ``tokenizers`` vocabulary file (for instance byte_bpe_50k.json).

    ``path``: where executors have the file, or its name from :func:`shipped`. It is read once a worker; texts come in
    Arrow batches and leave in slices of these, so a worker holds the ids of one slice."""

    @F.arrow_udf("array<long>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = _vocabulary(path)
        for texts in batches:
            for some in _slices(texts, pc.utf8_length(texts)):
                ids = vocabulary.ids(some.fill_null("").to_pylist())
                ends = np.cumsum([0, *(len(x) // 8 for x in ids)], dtype=np.int32)
                yield pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(ids), dtype=np.int64))

    return run


def _told(path: str, batches: Iterator[pa.Array]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Slices of ids, with their texts."""
    vocabulary = _vocabulary(path)
    for ids in batches:
        for some in _slices(ids, pc.list_value_length(ids)):
            yield some, pa.array(vocabulary.texts([x.values.to_numpy(zero_copy_only=False).tolist() for x in some]), pa.string())


def vocabulary_text(path: str):
    """The texts that :func:`vocabulary_tokens` made ids of, exactly."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for _, texts in _told(path, batches):
            yield texts

    return run


def vocabulary_sizes(path: str):
    """The numbers of ids that :func:`vocabulary_tokens` made, as ``n``, and their ``text`` again.

    In one column: ids with one use go from function to function inside a worker, with two Spark makes them twice."""

    @F.arrow_udf("struct<n: bigint, text: string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for ids, texts in _told(path, batches):
            yield pa.StructArray.from_arrays([pc.list_value_length(ids).cast(pa.int64()), texts], ["n", "text"])

    return run


def padded_vocabulary(size: int, multiple: int) -> int:
    """``size`` rounded up to a multiple."""
    return -(-size // multiple) * multiple
