"""Document fingerprints: one-permutation MinHash with optimal densification, stored as packed low-order bits.

Every shingle of a text is hashed once. The high bits of the hash choose one of BINS bins, each bin keeps its smallest
value. An empty bin takes the value of the first filled bin in a random order of all bins that is fixed for that bin, so two
texts fill it alike wherever their filled bins agree. Of every value the lowest BITS bits are stored. Two values
agree by chance with probability 2^-BITS, which the estimate of the similarity takes out.

Defined cases: a null text is an empty one; texts without words have the empty fingerprint, which is like itself (1) and unlike
all others (0); texts of fewer than five words are one shingle; repeated rows are documents of their own. The next document
is the one after in the order of (doc_id, text), null ids first; the last one is followed by the first, a
single one by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netledger.llm.textops import U64, Codes, Words, passes, shingles, unused

BINS = 512
BITS = 4
_EMPTY = U64(0xFFFFFFFFFFFFFFFF)


@lru_cache(maxsize=2)
def _orders(bins: int) -> np.ndarray:
    """For every bin, all bins in the random order in which it looks for a filled one."""
    return np.argsort(np.random.default_rng(20).random((bins, bins)), axis=1).astype(np.int32)


@lru_cache(maxsize=2)
def _ranks(bins: int) -> np.ndarray:
    return np.argsort(_orders(bins), axis=1).astype(np.int32)


def densify(values: np.ndarray) -> np.ndarray:
    """Fill the empty bins of each row that has a filled one."""
    bins = values.shape[1]
    filled = values != _EMPTY
    out = values.copy()
    open_rows = np.flatnonzero(filled.any(axis=1) & ~filled.all(axis=1))
    many = filled.sum(axis=1) >= bins // 16
    row, bin_ = np.nonzero(~filled[open_rows])
    row = open_rows[row]
    few = ~many[row]
    for r in np.unique(row[few]).tolist():
        have = np.flatnonzero(filled[r])
        nearest = have[_ranks(bins)[:, have].argmin(axis=1)]
        out[r] = np.where(filled[r], values[r], values[r, nearest])
    row, bin_ = row[~few], bin_[~few]
    for attempt in range(bins):
        if not len(row):
            break
        source = _orders(bins)[bin_, attempt]
        ready = filled[row, source]
        out[row[ready], bin_[ready]] = values[row[ready], source[ready]]
        row, bin_ = row[~ready], bin_[~ready]
    return out


def signatures(texts: list[str], bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(texts x bins) low-order bits, and which texts have words."""
    words = Words(Codes(texts))
    hashes, bounds = shingles(words.hash, words.bounds)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    shift = U64(64 - (bins - 1).bit_length())
    place = owner * bins + (hashes >> shift).astype(np.int64)
    values = np.full(len(texts) * bins, _EMPTY, U64)
    np.minimum.at(values, place, hashes & U64((1 << 48) - 1))
    values = densify(values.reshape(len(texts), bins))
    return (values & U64((1 << bits) - 1)).astype(np.uint8), np.diff(bounds) > 0


def pack(signature: np.ndarray, has_words: bool, bits: int = BITS) -> str:
    """Hexadecimal text of the packed bits; empty for a text without words."""
    if not has_words:
        return ""
    spread = (signature[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1
    return np.packbits(spread.ravel()).tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, a_words: np.ndarray, b_words: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated Jaccard similarity, row by row, free of chance matches and kept in 0 to 1."""
    chance = 2.0**-bits
    seen = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    return np.where(a_words & b_words, seen, (a_words == b_words).astype(np.float64))


def _neighbours(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, doc_id, text, tail), to be sorted: the order of doc_id cut into buckets of about equal size.

    Each bucket ends with a copy of the first rows of the next bucket that has any (tail = 1), the last one with that of the first.
    Only one smallest id per bucket reaches the driver (at most `buckets` of them).
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = sorted({int(c) for c in docs.approxQuantile("doc_id", [k / buckets for k in range(1, buckets)], 1 / (4 * buckets))})
    # Binary search over the cuts as nested conditions: a few comparisons per row.
    def bucket_of(low: int, high: int):
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col("doc_id") < cuts[middle], bucket_of(low, middle)).otherwise(bucket_of(middle + 1, high))

    number = F.when(F.col("doc_id").isNull(), -1).otherwise(bucket_of(0, len(cuts)))
    placed = docs.withColumn("bucket", number)
    firsts = sorted(tuple(r) for r in placed.groupBy("bucket").agg(F.min("doc_id")).collect())
    pairs = [(firsts[i][0], *firsts[(i + 1) % len(firsts)]) for i in range(len(firsts))]
    own = placed.withColumn("tail", F.lit(0))
    if not pairs:
        return own
    ends = docs.sparkSession.createDataFrame(pairs, "bucket int, from_bucket int, first bigint")
    tails = (
        placed.withColumnRenamed("bucket", "from_bucket")
        .join(F.broadcast(ends), "from_bucket").filter(F.col("doc_id").eqNullSafe(F.col("first")))
        .groupBy("bucket", "doc_id").agg(F.min("text").alias("text"))
        .select("doc_id", "text", "bucket", F.lit(1).alias("tail"))
    )
    return own.unionByName(tails)


def with_edits(docs: DataFrame, bins: int = BINS, bits: int = BITS, buckets: int | None = None) -> DataFrame:
    """Fingerprint of every text, of its edited text, and their likeness (columns: see FIELDS).

    Edited text: the last floor(n / 4) code points replaced by the first as many (or all) of the next document.
    """
    buckets = buckets or max(64, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = _neighbours(docs, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket", "tail", "doc_id", "text")

    def emit(ids: list, texts: list[str]) -> pa.RecordBatch:
        """All but the last text, each with the one after it."""
        edited = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts, texts[1:])]
        sig, has = signatures(texts, bins, bits)
        sig_e, has_e = signatures(edited, bins, bits)
        m = len(edited)
        return pa.RecordBatch.from_arrays([
            pa.array(ids[:m], pa.int64()), pa.array([len(t) for t in texts[:m]], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
            pa.array([pack(s, h, bits) for s, h in zip(sig[:m], has[:m])], pa.string()),
            pa.array([pack(s, h, bits) for s, h in zip(sig_e, has_e)], pa.string()),
            pa.array(likeness(sig[:m], sig_e, has[:m], has_e, bits)),
            pa.array(likeness(sig[:m], sig[1:], has[:m], has[1:], bits)),
        ], [f.split()[0] for f in FIELDS.split(", ")])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        bucket = None
        for batch in batches:
            own_ids, own_texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            own_buckets, tails = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for first, group in passes(own_texts, 700_000):
                for k, text in enumerate(group, first):
                    if own_buckets[k] != bucket:
                        if len(texts) > 1:
                            yield emit(ids, texts)
                        ids, texts, bucket = [], [], own_buckets[k]
                    ids.append(own_ids[k])
                    texts.append(text)
                    if tails[k]:
                        yield emit(ids, texts)
                        ids, texts = [], []
                if len(texts) > 1:
                    yield emit(ids, texts)
                    ids, texts = ids[-1:], texts[-1:]

    return rows.select("doc_id", "text", "bucket", "tail").mapInArrow(walk, FIELDS)


FIELDS = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """The rows of docs with one more column, fingerprint."""
    name = unused("fingerprint", docs.columns)

    @F.pandas_udf("string")
    def of(texts):
        import pandas as pd

        out = []
        for _, group in passes(texts.tolist()):
            out += [pack(s, h, bits) for s, h in zip(*signatures(group, bins, bits))]
        return pd.Series(out, dtype=object)

    return docs.withColumn(name, of(F.coalesce("text", F.lit(""))))
