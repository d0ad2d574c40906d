"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Symbols are words (letters and digits, lower case). The random-walk embedding walks over a string, copies the symbol it
stands on into the next output place and moves on where a random bit, which depends on the place and the symbol, says so.
Strings at a small edit distance then agree in most places (Hamming distance). A key is a sample of places; strings
with equal keys in any of several repetitions (fresh bits, fresh sample) are compared exactly.

Windows. An item is looked up by its tails (from each word of its first half to its end), a document by the windows that
start where it has a pair of neighbouring words that some item has in its first half. Fewer edits than a quarter of the
words leave such a pair intact, so with the 20 % of edits that verification allows no window is missed by it. A window is
as long as the tail it is compared with; the walk over a shared prefix of 4, 8, 16, 32, or 64 words is the same for all
items of that size, so one walk per start serves all items.

The number of repetitions is computed from the items themselves: copies of them with as many edits as allowed are embedded,
and repetitions are added until the target recall is reached on those of every size, under the conditions of the search. All items
take part, in at least COPIES copies per size; if MOST_REPETITIONS do not reach the target, a warning says so.

Verification: smallest number of word insertions, deletions and substitutions that turn the item into some run of words of
the document; a hit has at most floor(edit_share x words) of them. Every hit is exact, only the search is probabilistic.

The items are sent to the tasks in shards of bounded size (SHARD_CHARS characters), one search per shard.

Defined cases: null texts are empty; items without words match nothing, items of one word match that word; repeated items
and documents give one row each; empty tables give an empty result.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netledger.llm.storage import stage
from netledger.llm.textops import U64, Codes, Words, mix, passes

EDIT_SHARE = 0.2
RECALL = 0.99
SHARD_CHARS = 8_000_000
SAMPLED_PLACES = 5
COPIES, MOST_REPETITIONS = 200, 64
SIZES = (64, 32, 16, 8, 4, 2, 1)
_NOTHING = U64(0)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * U64(3) + second)


class Embedding:
    """One repetition: random bits of the walk and the places sampled for each window size."""

    def __init__(self, repetition: int):
        self.seed = 0x51ED270B0A1F3D5 + 2 * repetition * 0x9E37 + 1
        rng = np.random.default_rng(repetition)
        # Place 0 is the first word, equal by construction; a walk of s words takes about 2 s steps.
        self.places = {s: np.sort(rng.choice(np.arange(1, max(2 * s, 3)), min(SAMPLED_PLACES, max(2 * s - 1, 1)),
                                             replace=False)) for s in SIZES}

    def keys(self, words: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
        """Keys of the windows words[start:start + size] (all inside the array)."""
        at, end = start.copy(), start + size
        key = np.full(len(start), U64(size), U64)
        places = set(self.places[size].tolist())
        for t in range(max(places) + 1):
            symbol = np.where(at < end, words[np.minimum(at, len(words) - 1)], _NOTHING)
            if t in places:
                key = mix(key * U64(31) + symbol)
            salt = U64(self.seed * (t + 1) % (1 << 64))
            at += ((symbol ^ salt) * U64(0x9E3779B97F4A7C15) >> U64(63)).astype(np.int64)
        return key


def edit_distance_within(item: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Distance of the item to the best run of words of each row of texts, and the column at which that run ends.

    texts is padded with 0, which equals no word.
    """
    best = np.zeros((len(texts), texts.shape[1] + 1), np.int32)
    columns = np.arange(texts.shape[1] + 1, dtype=np.int32)
    for i, word in enumerate(item.tolist()):
        nxt = np.empty_like(best)
        nxt[:, 0] = i + 1
        nxt[:, 1:] = np.minimum(best[:, :-1] + (texts != np.uint64(word)), best[:, 1:] + 1)
        best = np.minimum.accumulate(nxt - columns, axis=1) + columns  # insertions, left to right
    return np.stack([best.min(axis=1), best.argmin(axis=1)], axis=1)


class ItemIndex:
    """Tails of the items by pair and by embedding key."""

    def __init__(self, ids: list[int], texts: list[str | None], edit_share: float, recall: float):
        batch = Words(Codes([t or "" for t in texts]))
        self.ids, self.edit_share = ids, edit_share
        self.items = [batch.hash[a:b] for a, b in zip(batch.bounds, batch.bounds[1:])]
        tails = [(i, j) for i, w in enumerate(self.items) for j in range(max(1, (len(w) + 1) // 2)) if len(w)]
        self.item = np.array([t[0] for t in tails], np.int64)
        self.offset = np.array([t[1] for t in tails], np.int64)
        length = np.array([len(self.items[i]) for i, _ in tails], np.int64) - self.offset
        self.size = np.array([next(s for s in SIZES if s <= n) for n in length], np.int64)
        self.words = batch.hash
        self.start = batch.bounds[self.item] + self.offset if len(tails) else np.zeros(0, np.int64)
        self.pairs = {
            s: np.unique(self._anchor(self.words, self.start[self.size == s], s)) for s in SIZES if (self.size == s).any()
        }
        self.filter = np.zeros(1 << 20, bool)
        for anchors in self.pairs.values():
            self.filter[(anchors >> U64(44)).astype(np.int64)] = True
        self.singles = 1 in self.pairs
        self.repetitions = self._repetitions(recall)
        self.tables = []
        for r in range(self.repetitions):
            table = {}
            for s in self.pairs:
                rows = np.flatnonzero(self.size == s)
                keys = Embedding(r).keys(self.words, self.start[rows], s)
                order = np.argsort(keys, kind="stable")
                table[s] = (keys[order], rows[order])
            self.tables.append(table)

    @staticmethod
    def _anchor(words: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
        return _pair(words[start], words[start + 1] if size > 1 else _NOTHING * words[start])

    def _edited(self, item: np.ndarray, copy: int) -> np.ndarray:
        """A copy with as many edits as allowed; they depend on the item's words only."""
        rng = np.random.default_rng([int(mix(item * U64(3) + np.arange(len(item), dtype=U64)).sum()), copy])
        word = item.tolist()
        for _ in range(int(self.edit_share * len(item))):
            at, kind = int(rng.integers(len(word) + 1)), int(rng.integers(3))
            fresh = int(rng.integers(1, 2**63, dtype=np.int64))
            word[at:at + (kind != 2)] = [] if kind == 0 else [fresh]
        return np.array(word, U64)

    def _repetitions(self, recall: float) -> int:
        """As many as find `recall` of edited copies of the items of every size by at least one tail."""
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(self.items):
            if int(self.edit_share * len(w)):  # others are found as they are
                by_size.setdefault(next(s for s in SIZES if s <= len(w)), []).append(i)
        owner = np.array([i for own in by_size.values() for _ in range(math.ceil(COPIES / len(own))) for i in own], np.int64)
        if not len(owner):
            return 1
        group = np.array([next(s for s in SIZES if s <= len(self.items[i])) for i in owner.tolist()], np.int64)
        made: dict[int, int] = {}
        copies = []
        for i in owner.tolist():
            copies.append(self._edited(self.items[i], made.setdefault(i, 0)))
            made[i] += 1
        words = np.concatenate(copies)
        bounds = np.concatenate([[0], np.cumsum([len(c) for c in copies])])
        copy = np.repeat(np.arange(len(copies)), np.diff(bounds))
        starts = {}
        for s, anchors in self.pairs.items():
            at = np.flatnonzero(np.arange(len(words)) + s <= bounds[copy + 1])
            starts[s] = at[np.isin(self._anchor(words, at, s), anchors)] if len(at) else at
        tails = {s: np.flatnonzero(self.size == s) for s in self.pairs}
        with_item = lambda keys, item: mix(keys ^ mix(item.astype(U64)))
        found = np.zeros(len(copies), bool)
        for r in range(MOST_REPETITIONS):
            embedding = Embedding(r)
            for s, at in starts.items():
                at = at[~found[copy[at]]]
                if not len(at):
                    continue
                own = with_item(embedding.keys(self.words, self.start[tails[s]], s), self.item[tails[s]])
                hit = np.isin(with_item(embedding.keys(words, at, s), owner[copy[at]]), own)
                found[copy[at[hit]]] = True
            worst = min((float(found[group == g].mean()), g) for g in by_size)
            if worst[0] >= recall:
                return r + 1
        logging.getLogger(__name__).warning(
            "%d repetitions find %.4f of the edited items of %d words or more, target %.4f", MOST_REPETITIONS, worst[0], worst[1], recall)
        return MOST_REPETITIONS

    def search(self, words: Words) -> list[tuple[int, int, int, int]]:
        """(text, item, distance, first word) of all items found in the texts of a batch."""
        hashes, n = words.hash, len(words.hash)
        if not n or not len(self.item):
            return []
        follower = np.append(hashes[1:], _NOTHING)
        pair = _pair(hashes, follower)
        candidates: list[np.ndarray] = []
        for s, anchors in self.pairs.items():
            tested = _pair(hashes, np.zeros_like(hashes)) if s == 1 else pair
            at = np.flatnonzero(self.filter[(tested >> U64(44)).astype(np.int64)])
            at = at[at + s <= words.bounds[words.text[at] + 1]]
            place = np.minimum(np.searchsorted(anchors, tested[at]), len(anchors) - 1)
            at = at[anchors[place] == tested[at]]
            if not len(at):
                continue
            for r in range(self.repetitions):
                keys, rows = self.tables[r][s]
                own = Embedding(r).keys(hashes, at, s)
                left, right = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
                times = right - left
                tail = rows[np.repeat(left, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
                begin = np.repeat(at, times) - self.offset[tail]  # where the item would begin
                candidates.append(np.stack([words.text[np.repeat(at, times)], self.item[tail], begin], axis=1))
        met = np.unique(np.concatenate([np.zeros((0, 3), np.int64), *candidates]), axis=0)
        return self._verify(words, met) if len(met) else []

    def _verify(self, words: Words, candidates: np.ndarray) -> list[tuple[int, int, int, int]]:
        found: dict[tuple[int, int], tuple[int, int]] = {}
        order = np.argsort(candidates[:, 1], kind="stable")
        candidates = candidates[order]
        cuts = np.flatnonzero(np.diff(candidates[:, 1])) + 1
        for group in np.split(candidates, cuts):
            item = self.items[int(group[0, 1])]
            allowed = int(self.edit_share * len(item))
            # Starts of one text that lie within the slack of each other share a region.
            width = len(item) + 4 * allowed + 2
            for at in range(0, len(group), 2000):
                part = group[at:at + 2000]
                text, begin = part[:, 0], part[:, 2] - 2 * allowed - 1
                place = begin[:, None] + np.arange(width)
                inside = (place >= words.bounds[text][:, None]) & (place < words.bounds[text + 1][:, None])
                region = np.where(inside, words.hash[np.clip(place, 0, len(words.hash) - 1)], _NOTHING)
                result = edit_distance_within(item, region)
                for t, i, b, (distance, end) in zip(text.tolist(), part[:, 1].tolist(), begin.tolist(), result.tolist()):
                    if distance <= allowed:
                        first = max(b + end - len(item) - int(words.bounds[t]), 0)
                        found[t, i] = min(found.get((t, i), (distance, first)), (distance, first))
        return [(t, i, d, first) for (t, i), (d, first) in found.items()]


def _shards(items: DataFrame, shard_chars: int) -> list[DataFrame]:
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(chars / shard_chars))
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def contaminated(docs: DataFrame, items: DataFrame, edit_share: float = EDIT_SHARE, recall: float = RECALL,
                 shard_chars: int = SHARD_CHARS) -> DataFrame:
    """doc_id, item_id, n_edits, n_words (of the item), at_word (about where): one row per document row and item found."""
    keyed = docs.select("doc_id", "text", F.lit(None).cast("binary").alias("text_key"))
    return _found(keyed, items, edit_share, recall, shard_chars).drop("text_key")


def _found(docs: DataFrame, items: DataFrame, edit_share: float, recall: float, shard_chars: int) -> DataFrame:
    """The rows of `contaminated` with the text_key of docs (doc_id, text, text_key)."""

    def search_with(index: ItemIndex):
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, group in passes(batch.column(1).to_pylist()):
                    hits = index.search(Words(Codes(group)))
                    if hits:
                        text, item, distance, at = (np.array(c) for c in zip(*hits))
                        yield pa.RecordBatch.from_arrays([
                            batch.column(0).take(pa.array(text + first)),
                            pa.array([index.ids[i] for i in item], pa.int64()),
                            pa.array(distance.astype(np.int32)),
                            pa.array([len(index.items[i]) for i in item], pa.int32()), pa.array(at.astype(np.int64)),
                            batch.column(2).take(pa.array(text + first)),
                        ], ["doc_id", "item_id", "n_edits", "n_words", "at_word", "text_key"])

        return search

    found = []
    for shard in _shards(items.select("item_id", "text"), shard_chars):
        rows = shard.collect()  # at most about shard_chars characters
        index = ItemIndex([r["item_id"] for r in rows], [r["text"] for r in rows], edit_share, recall)
        found.append(docs.mapInArrow(
            search_with(index), "doc_id bigint, item_id bigint, n_edits int, n_words int, at_word bigint, text_key binary"))
    return reduce(DataFrame.unionByName, found)


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no item is found; all columns kept. A row goes by its id and text: rows that share an id, or have
    none, are judged each by its own text."""
    key = F.unhex(F.md5(F.coalesce(docs["text"], F.lit(""))))
    bad = stage(
        _found(docs.select(docs["doc_id"], docs["text"], key.alias("text_key")), items, EDIT_SHARE, RECALL, SHARD_CHARS)
        .select("doc_id", "text_key"), "contaminated",
    ).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["doc_id"]) & (key == bad["text_key"]), "left_anti")
