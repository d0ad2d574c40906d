"""Toxicity by noisy-channel deobfuscation.

A disguised word is read as what a channel made of a plain one: letters replaced by look-alikes (leetspeak), letters repeated,
separators or spaces put between. Each such token becomes a lattice of what its characters may stand for, and Viterbi decoding
under a character language model picks the likeliest plain word. The restored words, together with the words that
stand undisguised, are scored by a logistic model over whole words and word beginnings.

The language model holds counts of four letters in a row over all documents (letters folded to a-z, one more for other
scripts, one for the word border), interpolated with shorter contexts; its table is bounded by the alphabet. Labels are learned
from a sample of bounded size (SAMPLE_ROWS labelled documents with the smallest hashes of their ids); which words count as
features is decided on that sample as well. Held-out documents are never learned from.

Tokens with a single reading pass through undecoded: their lattice has one path. All others are decoded, each distinct one once:
tokens with a letter doubled, with a look-alike anywhere (at the edge, or nothing but look-alikes) or with signs between letters.
A word that spaces set apart is up to JOINED neighbouring tokens that the likeliest way of splitting the text takes as one word, at
a cost for each space, or any number of single characters.

Defined cases: a null text is an empty one; texts without known words get the score of the bias; repeated rows get the same score
each; without any labelled document, or with one label only, the model scores the rate of that label (0 without any).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from netledger.llm.storage import stage
from netledger.llm.textops import CODE_SPACE, U64, Codes, SpanHash, class_table, lower_table, mix, passes, ragged

SAMPLE_ROWS = 20_000
FEATURES = 2048
BEGINNINGS = (4, 5, 6, 7)
LETTERS = 28  # 0: border, 1-26: a-z, 27: any other letter
GRAMS = LETTERS**4
#: What a character may stand for besides itself.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s",
    "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "§": "s", "¢": "c",
}
#: Largest number of neighbouring tokens that are tried as one word.
JOINED = 6
#: Chosen by four-fold cross-validation on labelled rows that are not held out (sf0.1): of 3,155, 3,087 right at -1, 3,089 at -4, 3,088 at -8.
_COST_SPACE = -4.0
_COST_LOOKALIKE, _COST_NOISE, _COST_LETTER_AS_NOISE = -0.7, -2.5, -30.0


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Letter class of each code point: 0 no letter, 1-26 a-z (accents dropped), 27 another letter."""
    kind, lower = class_table(), lower_table()
    table = np.zeros(CODE_SPACE, np.uint8)
    for c in np.flatnonzero(kind == 1).tolist():
        low = int(lower[c])
        if low >= 0x250:
            table[c] = 27
            continue
        base = unicodedata.normalize("NFKD", chr(low))[0].lower()
        table[c] = ord(base) - 96 if "a" <= base <= "z" else 27
    return table


@lru_cache(maxsize=1)
def letter_values() -> np.ndarray:
    """A random 64-bit value per folded letter; letters of other scripts keep their own. 0 for no letter."""
    fold = fold_table()
    values = mix(np.where(fold == 27, lower_table().astype(U64) + U64(1000), fold.astype(U64)) + U64(0x7777))
    values[fold == 0] = 0
    return values


def gram_codes(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Four-letter codes that end at each letter or at the border after a word; contexts do not cross borders."""
    fold = np.zeros(len(codes) + len(offsets), np.int64)
    at = np.arange(len(codes)) + np.searchsorted(offsets, np.arange(len(codes)), "right")
    fold[at] = fold_table()[codes]  # a border stands before every text
    c1 = np.append([0], fold[:-1])
    c2 = np.where(c1 > 0, np.append([0, 0], fold[:-2])[: len(fold)], 0)
    c3 = np.where(c2 > 0, np.append([0, 0, 0], fold[:-3])[: len(fold)], 0)
    return (((c3 * LETTERS + c2) * LETTERS + c1) * LETTERS + fold)[(fold > 0) | (c1 > 0)]


def gram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all four-letter codes over all documents (GRAMS numbers)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(GRAMS, np.int64)
            for _, group in passes(batch.column(0).to_pylist()):
                codes = Codes(group)
                if len(codes.codes):
                    total += np.bincount(gram_codes(codes.codes, codes.offsets), minlength=GRAMS)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["gram", "n"])

    rows = docs.select("text").mapInArrow(count, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(GRAMS, np.int64)
    found = rows.toPandas()  # at most GRAMS rows
    counts[found["gram"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts


class LetterModel:
    """log P(letter | up to three letters before), interpolated down to single letters."""

    def __init__(self, counts: np.ndarray, weight: float = 4.0):
        n4 = counts.reshape((LETTERS,) * 4).astype(np.float64)
        p = (n4.sum((0, 1, 2)) + 1) / (n4.sum() + LETTERS)
        for axes in ((0, 1), (0,), ()):
            n = n4.sum(axes) if axes else n4
            p = (n + weight * p) / (n.sum(-1, keepdims=True) + weight)
        self.log = np.log(p).astype(np.float32)

    def words(self, letters: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """log P of the words letters[start:end] with the border after them, for folded letters."""
        flat, back = self.log.reshape(-1), [np.append(np.zeros(k, np.int64), letters)[: len(letters)] for k in (1, 2, 3)]
        context = [np.zeros_like(letters), back[0], back[1] * LETTERS + back[0], (back[2] * LETTERS + back[1]) * LETTERS + back[0]]
        by_length = [flat[c * LETTERS + letters].astype(np.float64) for c in context]
        sums = np.append([0.0], np.cumsum(by_length[3]))
        after = [(c * LETTERS + letters) % LETTERS**3 for c in context]  # context of what follows a word of 1, 2, 3 letters
        ends = [flat[c * LETTERS].astype(np.float64) for c in after[:3]]

        def score(start: np.ndarray, end: np.ndarray) -> np.ndarray:
            n, last = end - start, len(letters) - 1
            out = sums[end] - sums[np.minimum(start + 3, end)]
            for k in range(3):
                out += np.where(n > k, by_length[k][np.minimum(start + k, last)], 0.0)
            at = np.maximum(end - 1, 0)
            return out + np.select([n == 1, n == 2, n > 2], [e[at] for e in ends], float(flat[0]))

        return score


def _options(token: str) -> list[list[tuple[str, float]]]:
    """The lattice: for each run of equal characters, what it may stand for and at what cost."""
    fold = fold_table()
    out = []
    at = 0
    while at < len(token):
        char, end = token[at], at + 1
        code = int(fold[ord(char)])
        while end < len(token) and (token[end] == char or 0 < code < 27 and fold[ord(token[end])] == code):
            end += 1
        run, at = end - at, end
        if code:
            letter = chr(96 + code) if code < 27 else char
            if run == 1:
                out.append([(letter, 0.0)])
            else:
                # One letter or two; real double letters are common, longer runs are not.
                out.append([(letter * 2, 0.0 if run == 2 else -1.0), (letter, -3.0 if run == 2 else -1.0)])
        elif char in LOOKALIKES:
            options = [("", _COST_NOISE)]
            for letter in LOOKALIKES[char]:
                options += [(letter, _COST_LOOKALIKE)] + ([(letter * 2, _COST_LOOKALIKE)] if run > 1 else [])
            out.append(options)
        else:
            out.append([("", 0.0)])
    return out


def decode(token: str, model: LetterModel) -> str:
    """The likeliest plain word behind a token; states are the last three letters, with the way they were reached."""
    lattice = _options(token)
    if all(len(options) == 1 for options in lattice):
        return "".join(options[0][0] for options in lattice)
    table = model.log
    number = lambda x: ord(x) - 96 if "a" <= x <= "z" else 27
    states: dict[tuple[int, int, int], tuple[float, tuple]] = {(0, 0, 0): (0.0, ())}
    for options in lattice:
        after: dict[tuple[int, int, int], tuple[float, tuple]] = {}
        for (a, b, c), (score, text) in states.items():
            for letters, cost in options:
                x, y, z, s = a, b, c, score + cost
                for letter in letters:
                    k = number(letter)
                    s += float(table[x, y, z, k])
                    x, y, z = y, z, k
                best = after.get((x, y, z))
                if best is None or s > best[0]:
                    after[x, y, z] = (s, (text, letters) if letters else text)
        states = after
    way = max(((score + float(table[a, b, c, 0]), text) for (a, b, c), (score, text) in states.items()), key=lambda x: x[0])[1]
    out = []
    while way:
        way, letters = way
        out.append(letters)
    return "".join(reversed(out))


@lru_cache(maxsize=1)
def _reading_tables() -> tuple[np.ndarray, np.ndarray]:
    """Folded letter of each code point, look-alikes read as the first and as the last letter that they may stand for."""
    tables = fold_table().copy(), fold_table().copy()
    for char, letters in LOOKALIKES.items():
        for table, letter in zip(tables, (letters[0], letters[-1])):
            table[ord(char)] = ord(letter) - 96
    return tables


def disguised(batch: Codes, texts: list[str], model: LetterModel) -> tuple[list[str], np.ndarray]:
    """Tokens with more than one reading and neighbours that may be one word (with the space between), and the text each is from."""
    codes = batch.codes
    if not len(codes):
        return [], np.zeros(0, np.int64)
    kind, fold = class_table()[codes], fold_table()[codes]
    letter = fold > 0
    start, end, text = batch.runs(kind != 3)
    marks = np.isin(codes, np.array([ord(c) for c in LOOKALIKES], np.uint32))
    same = (codes[1:] == codes[:-1]) | ((fold[1:] == fold[:-1]) & (fold[1:] < 27))
    doubled = np.append([False], same & letter[1:] & letter[:-1])
    core = np.flatnonzero(letter | (kind == 2) | marks)
    letters = np.concatenate([[0], np.cumsum(letter)])
    doubles = np.concatenate([[0], np.cumsum(doubled)])
    left, right = np.searchsorted(core, start), np.searchsorted(core, end) - 1
    has = right >= left
    first = np.where(has, core[np.minimum(left, max(len(core) - 1, 0))] if len(core) else start, start)
    last = np.where(has, core[np.maximum(right, 0)] if len(core) else start, start)
    inside = letters[last + 1] - letters[first]
    pick = np.flatnonzero(has & ((inside < last - first + 1) | (doubles[last + 1] - doubles[first + 1] > 0)))
    joined = "".join(texts)
    found = [joined[a:b + 1] for a, b in zip(first[pick].tolist(), last[pick].tolist())]
    owner = [text[pick]]
    # Letters set apart by spaces: three or more single characters in a row, at least two of them letters.
    single = (end - start == 1) & has
    again = np.append([False], single[1:] & single[:-1] & (text[1:] == text[:-1]))
    begins = np.flatnonzero(single & ~again)
    stops = np.flatnonzero(single & ~np.append(again[1:], False))
    spaced = stops - begins >= 2
    for a, b in zip(begins[spaced].tolist(), stops[spaced].tolist()):
        if letter[start[a:b + 1]].sum() >= 2:
            found.append(joined[start[a]:end[b]])
            owner.append(text[a:a + 1])
    begin, stop = _set_apart(codes, start, end, text, first, last, has, letters, model)
    found += [joined[a:b + 1] for a, b in zip(first[begin].tolist(), last[stop].tolist())]
    return found, np.concatenate([*owner, text[begin]])


def _may_join(letters: np.ndarray, a: np.ndarray, b: np.ndarray, gap: np.ndarray, model: LetterModel) -> np.ndarray:
    """Which of the gaps (k: between the tokens k and k + 1, letters[a[k]:b[k]]) some word that is likelier whole can stand across.

    If a word of several tokens beats every split of it, it beats the split at this gap: what it gains there is what the (up to
    three) letters after the gap gain from the letters before it, less the border and the space. The most that can be, over
    all places where the word may begin and end near the gap, is above zero, or no such word exists.
    """
    flat, n = model.log.reshape(-1), b - a
    padded = np.concatenate([np.zeros(3, np.int64), letters, np.zeros(3, np.int64)])

    def most(k: np.ndarray, least: int) -> np.ndarray:
        p = a[k + 1] + 3
        before, behind = np.minimum(n[k], 3), np.minimum(n[k + 1], 3)
        best = np.full(len(k), -np.inf)
        for known in range(least, 4):  # letters of the word before the gap
            context, own = np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
            for back in range(known, 0, -1):
                context = context * LETTERS + padded[p - back]
            gain = -flat[context * LETTERS].astype(np.float64)
            for after in range(4):  # letters of the word behind the gap; with three the rest is the same either way
                if after >= least:
                    border = flat[context * LETTERS] - flat[own * LETTERS] if after < 3 else 0.0
                    best = np.where((known >= before) & (after >= behind), np.maximum(best, gain + border), best)
                if after < 3:
                    letter = padded[p + after]
                    gain += flat[context * LETTERS + letter] - flat[own * LETTERS + letter]
                    context, own = (context * LETTERS + letter) % LETTERS**3, (own * LETTERS + letter) % LETTERS**3
        return best

    out = np.zeros(len(gap))
    long = (n[gap] >= 3) & (n[gap + 1] >= 3)
    out[long], out[~long] = most(gap[long], 3), most(gap[~long], 0)
    return out + _COST_SPACE > -1e-4  # room for rounding


def _set_apart(codes: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, first: np.ndarray, last: np.ndarray,
               has: np.ndarray, letters: np.ndarray, model: LetterModel) -> tuple[np.ndarray, np.ndarray]:
    """First and last tokens of the runs of up to JOINED tokens that the likeliest reading of each text takes as one word."""
    # Tokens that nothing but white space parts.
    gap = np.flatnonzero(has[1:] & has[:-1] & (text[1:] == text[:-1]) & (last[:-1] + 1 == end[:-1]) & (first[1:] == start[1:]))
    hopeful = np.zeros(len(gap), bool)
    reads, places = [table[codes].astype(np.int64) for table in _reading_tables()], []
    for r in reads:
        places.append(np.concatenate([[0], np.cumsum(r > 0)]))
        # The second reading counts only where it differs from the first one near the gap.
        near = np.arange(len(gap))
        if len(places) > 1:
            other = np.concatenate([[0], np.cumsum(r != reads[0])])
            around = lambda k: np.clip(k, 0, len(start) - 1)
            near = np.flatnonzero(other[last[around(gap + 4)] + 1] > other[first[around(gap - 3)]])
        hopeful[near] |= _may_join(r[r > 0], places[-1][first], places[-1][last + 1], gap[near], model)
    gap = gap[hopeful]
    if not len(gap) or not places[0][-1]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    tokens = np.unique(np.concatenate([gap, gap + 1]))  # only these are scored
    n = len(tokens)
    linked = np.isin(tokens[:-1], gap)
    size = last[tokens] + 1 - first[tokens]
    at = ragged(first[tokens], size)
    bounds = np.append([0], np.cumsum(size))
    read = [r[at] for r in reads]
    place = np.concatenate([[0], np.cumsum(read[0] > 0)])
    scorers = [model.words(r[r > 0]) for r in read]
    score = lambda begin, stop: np.maximum(*[one(begin, stop) for one in scorers])
    a, b = place[bounds[:-1]], place[bounds[1:]]
    best, whole, chosen = [score(a, b)], np.ones(n, bool), []  # best[w - 1][i]: the tokens i to i + w - 1
    apart = np.append([0.0], np.cumsum(best[0]))
    for w in range(2, min(JOINED, n) + 1):
        m = n - w + 1
        whole = whole[:m] & linked[w - 2:w - 2 + m]
        split = np.max([best[k - 1][:m] + best[w - k - 1][k:k + m] for k in range(1, w)], axis=0)
        one = np.where(whole, score(a[:m], b[w - 1:]) + _COST_SPACE * (w - 1), -np.inf)
        best.append(np.maximum(one, split))
        at = np.flatnonzero(one > split)
        at = at[letters[last[tokens[at + w - 1]] + 1] > letters[first[tokens[at]]]]
        chosen.append((at, at + w, one[at] - (apart[at + w] - apart[at])))
    begin, stop, gain = map(np.concatenate, zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *chosen))
    # Of runs that overlap, those that make the whole text likeliest.
    cuts = np.unique(np.concatenate([begin, stop]))
    order = np.argsort(stop, kind="stable")
    from_cut, to_cut = np.searchsorted(cuts, begin[order]).tolist(), np.searchsorted(cuts, stop[order]).tolist()
    value, last_run, k = [0.0] * max(len(cuts), 1), [-1] * max(len(cuts), 1), 0
    for c in range(1, len(cuts)):
        value[c] = value[c - 1]
        while k < len(order) and to_cut[k] == c:
            if value[from_cut[k]] + gain[order[k]] > value[c]:
                value[c], last_run[c] = value[from_cut[k]] + gain[order[k]], k
            k += 1
    taken, c = [], len(cuts) - 1
    while c > 0:
        if last_run[c] < 0:
            c -= 1
        else:
            taken.append(order[last_run[c]])
            c = from_cut[last_run[c]]
    taken = np.array(taken[::-1], np.int64)
    return tokens[begin[taken]], tokens[stop[taken] - 1]


def word_features(batch: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and their beginnings, and the texts they are in."""
    values = letter_values()[batch.codes]
    start, end, text = batch.runs(values != 0)
    spans = SpanHash(values)
    out, owner = [spans(start, end)], [text]
    for k in BEGINNINGS:
        long = np.flatnonzero(end - start > k)
        out.append(mix(spans(start[long], start[long] + k) + U64(k)))
        owner.append(text[long])
    return np.concatenate(out), np.concatenate(owner)


class Restorer:
    """Features of texts with disguised tokens restored; remembers decoded tokens."""

    def __init__(self, model: LetterModel, memory: int = 200_000):
        self.model, self.memory, self.known = model, memory, {}

    def plain(self, token: str) -> str:
        """The restored form; empty where it is the token itself, whose features the text has already."""
        word = self.known.get(token)
        if word is None:
            if len(self.known) >= self.memory:
                self.known.clear()
            word = decode(token, self.model)
            word = self.known[token] = word if word != token.lower() else ""
        return word

    def features(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        batch = Codes(texts)
        hashes, owner = word_features(batch)
        tokens, of = disguised(batch, texts, self.model)
        plain = [self.plain(t) for t in tokens]
        changed = np.flatnonzero(np.fromiter(map(bool, plain), bool, len(plain)))
        if len(changed):
            more, which = word_features(Codes([plain[k] for k in changed.tolist()]))
            hashes, owner = np.concatenate([hashes, more]), np.concatenate([owner, of[changed[which]]])
        return hashes, owner


def restore(text: str, model: LetterModel) -> str:
    """The text with every disguised token replaced by its restored form."""
    batch = Codes([text])
    for token in sorted(set(disguised(batch, [text], model)[0]), key=len, reverse=True):
        text = text.replace(token, decode(token, model))
    return text


@dataclass
class ToxicityModel:
    letters: LetterModel
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))  # ascending
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -30.0

    def hits(self, restorer: Restorer, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature number) pairs, each once."""
        hashes, owner = restorer.features(texts)
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        maybe = np.zeros(1 << 22, bool)
        maybe[(self.hashes >> U64(42)).astype(np.int64)] = True
        some = np.flatnonzero(maybe[(hashes >> U64(42)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, hashes[some]), len(self.hashes) - 1)
        exact = self.hashes[place] == hashes[some]
        pairs = np.unique(owner[some[exact]] * len(self.hashes) + place[exact])
        return pairs // len(self.hashes), pairs % len(self.hashes)

    def score(self, restorer: Restorer, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        for first, group in passes(texts):
            text, number = self.hits(restorer, group)
            out[first:first + len(group)] += np.bincount(text, self.weights[number], len(group))
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def _logistic(rows: list[np.ndarray], labels: np.ndarray, n: int, l2: float = 1e-5, steps: int = 600) -> tuple[np.ndarray, float]:
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    theta = np.zeros(n + 1)
    rate = np.clip(labels.mean(), 1e-6, 1 - 1e-6)
    theta[n] = np.log(rate / (1 - rate))
    moment, square = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        z = np.bincount(owner, theta[column], len(rows)) + theta[n]
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels) / len(rows)
        grad = np.append(np.bincount(column, error[owner], n) + l2 * theta[:n], error.sum())
        moment, square = 0.9 * moment + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        theta -= 0.1 * (moment / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-9)
    return theta[:n], float(theta[n])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> ToxicityModel:
    """docs: doc_id, text (all documents); labels: doc_id, label (0 or 1), without held-out documents."""
    model = ToxicityModel(LetterModel(gram_counts(docs)))
    chosen = (
        labels.select("doc_id", F.col("label").cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    )
    sample = stage(
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text")),
        "labelled",
    )
    positive, total = sample.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    if not positive or positive == total:
        model.bias = 30.0 if positive else -30.0
        return model
    letters = sample.sparkSession.sparkContext.broadcast(model.letters)  # bounded by the alphabet

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(letters.value)
        for batch in batches:
            label = batch.column(0).to_numpy()
            for first, group in passes(batch.column(1).to_pylist()):
                hashes, owner = restorer.features(group)
                order = np.lexsort((owner, hashes))
                hashes, owner = hashes[order], owner[order]
                fresh = np.append([True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))[: len(hashes)]
                hashes, mark = hashes[fresh], label[first + owner[fresh]]
                distinct, number = np.unique(hashes, return_inverse=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(distinct.view(np.int64)), pa.array(np.bincount(number, mark, len(distinct)).astype(np.int64)),
                    pa.array(np.bincount(number, minlength=len(distinct)).astype(np.int64)),
                ], ["feature", "pos", "n"])

    counted = sample.select("label", "text").mapInArrow(counts, "feature bigint, pos bigint, n bigint").groupBy("feature").agg(
        F.sum("pos").alias("pos"), F.sum("n").alias("n")
    )
    neg = F.col("n") - F.col("pos")
    odds = F.log((F.col("pos") + 0.5) / (positive - F.col("pos") + 0.5)) - F.log((neg + 0.5) / ((total - positive) - neg + 0.5))
    surely = odds - 2.58 * F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (neg + 0.5))
    best = counted.filter("pos >= 3").withColumn("surely", surely).filter("surely > 0")
    found = best.orderBy(F.col("surely").desc(), "feature").limit(FEATURES).toPandas()
    model.hashes = np.sort(found["feature"].to_numpy(np.int64).view(U64))
    model.weights = np.zeros(len(model.hashes))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(letters.value)
        for batch in batches:
            for first, group in passes(batch.column(1).to_pylist()):
                text, number = model.hits(restorer, group)
                bounds = np.searchsorted(text, np.arange(len(group) + 1))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(group)),
                    pa.array([number[a:b].astype("<i4").tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
                ], ["label", "features"])

    rows = sample.orderBy("doc_id").select("label", "text").mapInArrow(known, "label int, features binary").toPandas()
    features = [np.frombuffer(b, "<i4").astype(np.int64) for b in rows["features"]]
    model.weights, model.bias = _logistic(features, rows["label"].to_numpy(np.float64), len(model.hashes))
    return model


def scores(model: ToxicityModel, spark, text: Column) -> Column:
    """Probability of label 1 for a text column."""
    shared = spark.sparkContext.broadcast(model)  # bounded by the alphabet and FEATURES

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer = Restorer(shared.value.letters)
        for texts in batches:
            yield pd.Series(shared.value.score(restorer, texts.tolist()))

    return score(F.coalesce(text, F.lit("")))
