"""Problem 7: cutting oversized texts at natural boundaries, with overlap, by content-defined chunking.

A rolling hash over the text's bytes marks landmarks. Each piece looks at the stretch between its least and its
greatest size, takes the highest landmark there, and ends at the natural boundary nearest to it: a paragraph, line or
sentence end close by, else white space, else (an unbroken stretch longer than a piece) the landmark itself. Cuts hang
on nearby content only, so an edit alters the pieces next to it and the following ones fall into step again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import tokens
from .words import mixed

WINDOW = 32
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
FORCED, SPACE, SENTENCE, LINE, PARAGRAPH = range(5)
KINDS = ("forced", "space", "sentence", "line", "paragraph")
WHITE = re.compile(r"\s")
STOPS = np.array([ord(c) for c in ".!?…。"], np.uint32)


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, factor, np.uint64)])) for factor in (FACTOR, INVERSE))


def landmarks(data: np.ndarray) -> np.ndarray:
    """A pseudo-random height at every position of ``data`` (bytes), a function of the ``WINDOW`` bytes before it."""
    n = len(data)
    step, back = _powers(1 << max(n, 1).bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * step[:n])])
    out = np.zeros(n + 1, np.uint64)
    if n >= WINDOW:
        out[WINDOW:] = mixed((sums[WINDOW:] - sums[: n + 1 - WINDOW]) * back[: n + 1 - WINDOW])
    return out


def peak(raw: np.ndarray, low: int, high: int) -> int:
    """The first of the highest positions from ``low`` to ``high``; only the bytes around them are looked at."""
    a = max(0, low - WINDOW)
    return low + int(np.argmax(landmarks(raw[a:high])[low - a :]))


@lru_cache(1)
def _spaces() -> np.ndarray:
    """Which code points up to the last white space of Unicode are white space."""
    return np.array([WHITE.match(chr(c)) is not None for c in range(0x3002)])


BLOCK = 1 << 20


def boundaries(text: str, data: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Byte positions after each run of white space, their kinds, and the longest stretch without white space in bytes.

    Works through blocks of characters that end inside a word, so memory grows with the number of runs."""
    space, places, kinds = _spaces(), [], []
    a = at = last = longest = 0  # characters and bytes done, byte after the last run
    while a < len(text):
        b = min(a + BLOCK, len(text))
        while b < len(text) and (WHITE.match(text[b - 1]) or WHITE.match(text[b])):
            b += 1
        code = np.frombuffer(text[a:b].encode("utf-32-le", "surrogatepass"), np.uint32)
        white = (code < len(space)) & space[np.minimum(code, len(space) - 1)]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], white, [False]]).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        breaks = (code == 10) | ((code == 13) & (np.append(code[1:], 0) != 10))
        lines = np.concatenate([[0], np.cumsum(breaks, dtype=np.int32)])
        lines = lines[ends] - lines[starts]
        before = code[np.maximum(starts - 1, 0)]
        stop = np.isin(before, STOPS) & (starts > 0)
        kinds.append(np.where(lines > 1, PARAGRAPH, np.where(lines == 1, LINE, np.where(stop, SENTENCE, SPACE))).astype(np.int8))
        width = 1 + (code > 0x7F) + (code > 0x7FF).astype(np.int64) + (code > 0xFFFF)
        byte = np.concatenate([[0], np.cumsum(width)]) + at
        begins, places_ = byte[starts], byte[ends]
        if len(starts):
            longest = max(longest, int(np.max(begins - np.append(last, places_[:-1]))))
            last = int(places_[-1])
        places.append(places_)
        a, at = b, int(byte[-1])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int8), len(data)
    return np.concatenate(places), np.concatenate(kinds), max(longest, len(data) - last)


def split(text: str, capacity: int, overlap: int) -> tuple[list[tuple[int, int, int]], int]:
    """Pieces (start, stop, kind of their end) in bytes, at most ``capacity`` long, and the longest unbroken stretch.

    Consecutive pieces share exactly ``overlap`` bytes. Positions are between characters wherever a boundary allows."""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    places, kinds, longest = boundaries(text, data)
    if n <= capacity:
        return [(0, n, PARAGRAPH)], longest
    raw = np.frombuffer(data, np.uint8)
    lead = np.append((raw & 0xC0) != 0x80, True)
    whole = lead[places] & lead[np.maximum(places - overlap, 0)]  # the next piece begins between characters, too
    least = max(overlap + 1, capacity // 2)
    out, start = [], 0
    while n - start > capacity:
        low, high = start + least, start + capacity
        top = peak(raw, low, high)
        a, b = np.searchsorted(places, (start + overlap + 1, high + 1))
        best = None
        for exact in (True, False):
            for kind, a_, reach in ((SENTENCE, np.searchsorted(places, low), capacity // 8), (SPACE, np.searchsorted(places, low), capacity), (SPACE, a, capacity)):
                some = np.arange(a_, b)[kinds[a_:b] >= kind] if kind > SPACE else np.arange(a_, b)
                if exact:
                    some = some[whole[some]]
                if len(some):
                    near = np.abs(places[some] - top)
                    i = int(np.argmin(near))
                    if near[i] <= reach:
                        best = int(places[some[i]]), int(kinds[some[i]])
                        break
            if best:
                break
        if best is None:
            floor = start + overlap + 1  # below it the next piece would not get on
            near = np.arange(top, max(floor, top - 64) - 1, -1)
            fits = [near[lead[near] & lead[near - overlap]], near[lead[near]], near]
            stop = int(next(x for x in fits if len(x))[0])
            best = stop, FORCED
        out.append((start, *best))
        start = best[0] - overlap
    out.append((start, n, PARAGRAPH))
    return out, longest


def pieces(documents: DataFrame, specs: dict[int, tuple[int, int]]) -> DataFrame:
    """(doc_id, spec_id, piece, start, stop, boundary, cut, text) of every document above a spec's capacity, in order.

    ``documents``: doc_id, text; ``specs``: capacity and overlap by spec_id. start and stop are tokens (bytes);
    boundary is what the piece ends at; cut is ``forced`` for documents with an unbroken stretch above the capacity,
    else ``natural``. Texts within the capacity, blank ones and nulls give no rows. A torn character, which only a text
    without any fitting boundary has at a piece's start, is left out of the piece's text, not of its tokens."""
    if any(overlap >= capacity // 2 or capacity < 8 for capacity, overlap in specs.values()):
        raise ValueError("overlap must be less than half the capacity")
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "spec_id", "piece", "start", "stop", "boundary", "cut", "text"]
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            rows, size = [], 0

            def table():
                at, *columns = zip(*rows)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                return pa.RecordBatch.from_arrays([ids.take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, types))], names)

            for i in range(batch.num_rows):
                text = texts[i].as_py()
                data = text.encode("utf-8", "surrogatepass")
                for spec, (capacity, overlap) in specs.items():
                    if len(data) > capacity:
                        cuts, longest = split(text, capacity, overlap)
                        label = "forced" if longest > capacity else "natural"
                        for k, (a, b, end) in enumerate(cuts):
                            rows.append((i, spec, k, a, b, "end" if b == len(data) else KINDS[end], label, data[a:b].decode("utf-8", "ignore")))
                            size += b - a
                if size > 8_000_000:
                    yield table()
                    rows, size = [], 0
            if rows:
                yield table()

    least = min((c for c, _ in specs.values()), default=0)
    large = documents.select("doc_id", "text").where(tokens(F.col("text")) > least)
    if not specs:
        large = large.limit(0)
    return large.mapInArrow(run, f"doc_id {kind}, spec_id long, piece long, start long, stop long, boundary string, cut string, text string")


def found(cut_pieces: DataFrame) -> DataFrame:
    """p7_found: a row a document and spec, from its first piece."""
    return cut_pieces.where("piece = 0").select("doc_id", "spec_id", "cut")
