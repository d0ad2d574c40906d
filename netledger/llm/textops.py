"""Vectorised text primitives used inside Arrow tasks: code points, character classes, words, shingles, hashes.

A batch of texts is one array of code points plus offsets, so that a task works on millions of characters per numpy
call. Words are maximal runs of letters and digits, compared in lower case; a shingle is five words in a row (all words
of a shorter text form one shingle, a text without words has none).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np

SHINGLE = 5
#: Code points handled per numpy pass; bounds the memory of a task unless one text alone is longer.
PASS_CHARS = 500_000
CODE_SPACE = 0x110000
U64 = np.uint64
_MULT = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2^64
_MULT_INV = pow(_MULT, -1, 1 << 64)
#: Code points with the White_Space property.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = np.asarray(x, U64).copy()
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    """Lower case of each code point where that is a single code point, else the code point itself."""
    table = np.arange(CODE_SPACE, dtype=np.uint32)
    for c in range(CODE_SPACE):
        if not 0xD800 <= c < 0xE000 and len(low := chr(c).lower()) == 1:
            table[c] = ord(low)
    return table


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """0: other, 1: letter, 2: number, 3: white space."""
    table = np.zeros(CODE_SPACE, np.uint8)
    for c in range(CODE_SPACE):
        kind = unicodedata.category(chr(c))[0]
        table[c] = 1 if kind == "L" else 2 if kind == "N" else 0
    table[list(WHITE_SPACE)] = 3
    return table


@lru_cache(maxsize=1)
def word_char_table() -> np.ndarray:
    """A random 64-bit value for the lower case of each letter or digit, 0 for all other characters."""
    values = mix(lower_table().astype(U64) + U64(0x1234567))
    values[(class_table() == 0) | (class_table() == 3)] = 0
    return values


class Codes:
    """The code points of several texts, one after the other: text i is codes[offsets[i]:offsets[i + 1]]."""

    def __init__(self, texts: Sequence[str]):
        self.offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=self.offsets[1:])
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")

    def runs(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of the maximal runs where mask holds; a run ends with its text."""
        n = len(mask)
        before = np.empty(n, bool)
        before[:1] = False
        before[1:] = mask[:-1]
        after = np.empty(n, bool)
        after[-1:] = False
        after[:-1] = mask[1:]
        starts = self.offsets[:-1]
        before[starts[starts < n]] = False
        ends = self.offsets[1:]
        after[ends[ends > 0] - 1] = False
        first = np.flatnonzero(mask & ~before)
        return first, np.flatnonzero(mask & ~after) + 1, np.searchsorted(self.offsets, first, "right") - 1


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _MULT, U64), np.full(n, _MULT_INV, U64)
    up[:1] = down[:1] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class SpanHash:
    """64-bit hashes of any spans of one array, from prefix sums; equal spans have equal hashes."""

    def __init__(self, values: np.ndarray):
        size = 1 << max(16, int(len(values)).bit_length())
        up, self.down = _powers(size)
        self.sums = np.zeros(len(values) + 1, U64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(U64))


class Words:
    """Word hashes of a batch; bounds[i]:bounds[i + 1] are the words of text i."""

    def __init__(self, batch: Codes):
        values = word_char_table()[batch.codes]
        self.start, self.end, self.text = batch.runs(values != 0)
        self.spans = SpanHash(values)
        self.hash = self.spans(self.start, self.end)
        self.bounds = np.searchsorted(self.text, np.arange(len(batch.offsets)))


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words and the bounds per text; a shorter text gives one shingle of all its words."""
    counts = np.diff(bounds)
    out = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    shingle_bounds = np.zeros(len(bounds), np.int64)
    np.cumsum(out, out=shingle_bounds[1:])
    position = np.arange(shingle_bounds[-1]) + np.repeat(bounds[:-1] - shingle_bounds[:-1], out)
    last = np.repeat(bounds[1:], out)
    total = np.zeros(len(position), U64)
    for k in range(size):
        at = position + k
        inside = at < last
        total *= U64(0xD6E8FEB86659FD93)
        total += np.where(inside, hashes[np.minimum(at, max(len(hashes) - 1, 0))], U64(0)) if len(hashes) else U64(0)
    return mix(total), shingle_bounds


def passes(texts: Sequence[str | None], limit: int = PASS_CHARS) -> Iterator[tuple[int, list[str]]]:
    """Consecutive groups of texts (null: empty) of about `limit` characters, with the number of the first one."""
    group, chars, first = [], 0, 0
    for i, text in enumerate(texts):
        text = text or ""
        if group and chars + len(text) > limit:
            yield first, group
            group, chars, first = [], 0, i
        group.append(text)
        chars += len(text)
    if group:
        yield first, group


def sorted_sets(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each segment in ascending order, and their bounds."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[fresh], np.searchsorted(owner[fresh], np.arange(len(bounds)))


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each segment; empty segments give 0."""
    sums = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the given slices, one slice after the other."""
    total = np.cumsum(lengths)
    if not len(total):
        return np.zeros(0, np.int64)
    return np.arange(total[-1]) + np.repeat(starts - (total - lengths), lengths)


def unused(name: str, taken: Iterable[str]) -> str:
    """A column name that no column has yet (Spark compares names without case)."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name += "_"
    return name
