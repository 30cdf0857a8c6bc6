"""Canonical words of dirty texts, computed for a whole Arrow batch at a time.

A *word* is a maximal run of Latin letters and digits after undoing case, accents, look-alike and
invisible characters, markup, escapes and line-end hyphens. Null and blank texts have no words.

The batch is laid out as one array of code points and mapped through a lookup table, so the cost per
character is a few nanoseconds of numpy; only texts that hold markup or escapes see a regex.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import numpy as np

SEPARATOR, DROPPED, EXPANDED = 0, 1, 2

# Cyrillic and Greek letters drawn like Latin ones.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "з": "3", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o",
    "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "А": "a", "В": "b", "Е": "e", "З": "3", "І": "i", "Ї": "i", "Ј": "j", "К": "k", "М": "m", "Н": "h", "О": "o",
    "Р": "p", "С": "c", "Ѕ": "s", "Т": "t", "У": "y", "Х": "x",
    "Α": "a", "Β": "b", "Ε": "e", "Ζ": "z", "Η": "h", "Ι": "i", "Κ": "k", "Μ": "m", "Ν": "n", "Ο": "o", "Ρ": "p",
    "Τ": "t", "Υ": "y", "Χ": "x", "ı": "i", "ł": "l", "Ł": "l", "ø": "o", "Ø": "o", "đ": "d", "Đ": "d",
    "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "þ": "th", "Þ": "th", "ð": "d", "Ð": "d", "ɑ": "a", "ɡ": "g", "ɩ": "i",
}

TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->|<!\[CDATA\[|\]\]>", re.S)
LINE_HYPHEN = re.compile("(?<=\\w)[-\u00ad\u2010\u2011][ \t]*(?:\r\n|\r|\n)[ \t]*(?=\\w)")
CODE_ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]{1,6})\}|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|([ntrfv\"'/\\]))")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def tables() -> tuple[np.ndarray, dict[int, bytes]]:
    """The class or folded letter of every code point, and the expansions of those that fold to several."""
    lut, several = np.zeros(0x110000, np.uint8), {}
    spans = ((0, 0x3100), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB07), (0xFE00, 0xFE2F), (0xFEFF, 0xFF00), (0xFF00, 0xFFF0), (0x1D400, 0x1D800), (0x1F100, 0x1F1AD), (0xE0000, 0xE01F0))
    for span in spans:
        for code in range(*span):
            char = chr(code)
            kind = unicodedata.category(char)
            if char in LOOK_ALIKES:
                folded = LOOK_ALIKES[char]
            elif kind in ("Mn", "Me", "Cf"):
                lut[code] = DROPPED
                continue
            else:
                parts = unicodedata.normalize("NFKD", char).casefold()
                parts = "".join(LOOK_ALIKES.get(c, c) for c in parts if unicodedata.category(c) not in ("Mn", "Me", "Cf"))
                folded = "".join(c if c.isascii() and c.isalnum() else " " for c in parts)
            if len(folded) == 1 and folded != " ":
                lut[code] = ord(folded)
            elif folded.strip():
                lut[code], several[code] = EXPANDED, folded.encode()
    for code in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
        lut[code] = DROPPED
    return lut, several


def _code_escape(m: re.Match) -> str:
    hexed = m[1] or m[2] or m[3]
    if hexed is None:
        return " " if m[4] in "ntrfv" else m[4]
    code = int(hexed, 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else " "


def _percent(m: re.Match) -> str:
    try:
        return bytes.fromhex(m[0].replace("%", "")).decode()
    except UnicodeDecodeError:
        return m[0]


def unescaped(text: str | None) -> str:
    """``text`` without markup, escapes and line-end hyphens; most texts pass through untouched."""
    if not text:
        return ""
    if "&" in text:
        for _ in range(3):
            plain = html.unescape(text)
            if plain == text:
                break
            text = plain
    if "\\" in text:
        text = CODE_ESCAPE.sub(_code_escape, text)
    if "%" in text:
        text = PERCENT.sub(_percent, text)
    if "<" in text or "]]>" in text:
        text = TAG.sub(" ", text)
    if ("\n" in text or "\r" in text) and ("-" in text or "\u00ad" in text or "\u2010" in text or "\u2011" in text):
        text = LINE_HYPHEN.sub("", text)
    return text


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the well-known murmur3 one)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 64) * 2, MULTIPLIER))])
    return _powers


BLOCK_CHARS = 1 << 19


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and the offsets of each text's words (one more than texts).

    Works through blocks of ``BLOCK_CHARS`` characters, which stay in the processor's cache; a longer text is taken
    in several blocks that end at white space, so memory doesn't grow with the length of a text that has any."""
    parts, counts, block, size = [], [], [], 0

    def flush():
        nonlocal block, size
        if block:
            hashes, offsets = _block_hashes(block)
            parts.append(hashes)
            counts.extend(np.diff(offsets).tolist())
            block, size = [], 0

    for text in texts:
        text = unescaped(text)
        if size + len(text) > BLOCK_CHARS:
            flush()
        if len(text) <= 2 * BLOCK_CHARS:
            block.append(text)
            size += len(text)
            continue
        total, at = 0, 0
        while at < len(text):
            stop = at + BLOCK_CHARS
            while stop < len(text) and text[stop] not in " \n\t\r":
                stop += 1
            hashes, _ = _block_hashes([text[at:stop]])
            parts.append(hashes)
            total += len(hashes)
            at = stop
        counts.append(total)
    flush()
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(np.array(counts, np.int64))]).astype(np.int64)


def _block_hashes(plain: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = len(plain)
    codes = np.frombuffer("\n".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, plain), np.int64, n)
    ends = np.cumsum(lengths + 1)  # of each text with its separator; the last has none
    if not len(codes):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    lut, several = tables()
    letters = lut[codes]
    odd = np.flatnonzero(letters == EXPANDED)
    if len(odd):
        many = np.ones(len(codes), np.int64)
        many[odd] = [len(several[c]) for c in codes[odd].tolist()]
        at = np.cumsum(many)
        letters = np.repeat(letters, many)
        flat = np.frombuffer(b"".join(several[c] for c in codes[odd].tolist()), np.uint8)
        letters[letters == EXPANDED] = np.where(flat == 32, SEPARATOR, flat)
        ends = at[np.minimum(ends, len(codes)) - 1]
    kept = letters != DROPPED
    if not kept.all():
        ends = np.cumsum(kept)[np.minimum(ends, len(letters)) - 1]
        letters = letters[kept]
    inside = letters != SEPARATOR
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, stops = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    spans = stops - starts
    chars = letters[inside].astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(spans)[:-1]])
    place = np.arange(len(chars)) - np.repeat(first, spans)
    h = np.add.reduceat(chars * powers(int(spans.max()) + 1)[place], first)
    hashes = mixed(h + spans.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    offsets = np.concatenate([[0], np.searchsorted(starts, ends, "left")])
    offsets[-1] = len(starts)
    return hashes, offsets


DOC_BITS = 12
WORD_MASK = np.uint64((1 << (64 - DOC_BITS)) - 1)


def word_sets(texts: list[str | None], orders: list[np.ndarray] | None = None, repeated: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`word_hashes`, but each text's words distinct (unless ``repeated``), ascending, and hashes cut to 52 bits.

    Text number and hash share one 64-bit sort key, which numpy sorts several times as fast as two columns.
    ``orders``, where given, gets the :func:`sequence_ids` of the texts."""
    parts, counts = [], []
    for a in range(0, len(texts), 1 << DOC_BITS):
        some = texts[a : a + (1 << DOC_BITS)]
        hashes, offsets = word_hashes(some)
        if orders is not None:
            orders.append(sequence_ids(hashes, offsets))
        doc = np.repeat(np.arange(len(some), dtype=np.uint64), np.diff(offsets))
        keys = np.sort((hashes & WORD_MASK) | (doc << np.uint64(64 - DOC_BITS)))
        if not repeated:
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            keys = keys[new]
        parts.append(keys & WORD_MASK)
        counts.append(np.bincount((keys >> np.uint64(64 - DOC_BITS)).astype(np.int64), minlength=len(some)))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def runs(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of equal words within each text, and for every word its place in its run (0: the first)."""
    new = np.ones(len(words), bool)
    new[1:] = words[1:] != words[:-1]
    new[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(new)
    return starts, np.arange(len(words)) - np.repeat(starts, np.diff(np.append(starts, len(words))))


def occurrences(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ascending words with repeats as elements of a set: the k-th occurrence of a word becomes an element of its own
    (the first is the word itself), so set overlap of elements is multiset overlap of words."""
    _, place = runs(words, offsets)
    return np.where(place == 0, words, mixed(words ^ mixed(place.astype(np.uint64))) & WORD_MASK)


def sequence_ids(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit id of each text's words in their order, repeats included (int64); 0 for no words."""
    out, lengths = np.zeros(len(offsets) - 1, np.uint64), np.diff(offsets)
    full = np.flatnonzero(lengths)
    if len(full):
        place = (np.arange(len(hashes)) - np.repeat(offsets[:-1], lengths)).astype(np.uint64)
        out[full] = mixed(np.add.reduceat(mixed(hashes ^ mixed(place + np.uint64(1))), offsets[:-1][full]))
    return out.view(np.int64)


def set_ids(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set of words (int64); 0 for the empty set."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        starts = offsets[:-1][full]
        one, two = mixed(words * np.uint64(0x9FB21C651E98DF25)), mixed(words ^ np.uint64(0x5851F42D4C957F2D))
        out[full] = mixed(np.add.reduceat(one, starts) ^ (np.bitwise_xor.reduceat(two, starts) * MULTIPLIER))
    return out.view(np.int64)


def spelt(text: str | None) -> list[str]:
    """The words of one text as strings; the slow, plain way, for reports and tests."""
    lut, several = tables()
    out = "".join(
        "" if lut[ord(c)] == DROPPED else several[ord(c)].decode() if lut[ord(c)] == EXPANDED else chr(lut[ord(c)]) if lut[ord(c)] > EXPANDED else " "
        for c in unescaped(text)
    )
    return out.split()
