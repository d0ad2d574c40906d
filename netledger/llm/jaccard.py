"""N-gram Jaccard join by MinHash banding.

Documents are sets of hashed word shingles (five words, lower case). Documents with equal sets are one class; classes are
joined. Each class has `bands` band hashes over `rows` min-hashes each, both chosen from the similarity and the
recall wanted. Classes that meet in a band bucket are compared on their full sets.

Hot buckets: a bucket is cut into blocks of at most about BLOCK classes and every pair of blocks is a unit of work, so no
task sees a whole bucket and no row per pair is ever made: a task counts the links of its classes and reports a spanning
forest of them. A pair that meets in several bands is compared in the first of them only. Sets travel only for classes
that have such a pair of fitting sizes.

Defined cases: a null text is an empty one; texts without words form one class (similarity 1); shorter texts than five
words are one shingle; repeated rows are copies; rows with a null id get null class and group and no links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netledger.llm.graph import components
from netledger.llm.storage import stage
from netledger.llm.textops import U64, Codes, Words, mix, passes, shingles, sorted_sets, unused

THRESHOLD = 0.8
RECALL = 0.999
BLOCK = 256
_NODE = ["key", "n", "copies", "bands"]


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = 96) -> tuple[int, int]:
    """(bands, rows): the most selective banding that still finds pairs at the threshold with the wanted probability.

    It uses at most most_hashes hashes, but for low thresholds, where bands of one row are as many as the recall takes.
    """
    if not (0 < threshold <= 1 and 0 < recall < 1):
        raise ValueError(f"threshold {threshold} must be in (0, 1], recall {recall} in (0, 1)")
    needed = lambda rows: math.ceil(math.log1p(-recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
    best = (needed(1), 1)
    for rows in range(2, most_hashes + 1):
        if threshold**rows < 1e-9 or needed(rows) * rows > most_hashes:
            break
        best = (needed(rows), rows)
    return best


def _sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    words = Words(Codes(texts))
    return sorted_sets(*shingles(words.hash, words.bounds))


def _class_keys(values: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128 bits of each set, from two sums over independent hashes of its members."""
    keys = np.zeros((len(bounds) - 1, 2), U64)
    for k in range(2):
        sums = np.zeros(len(values) + 1, U64)
        np.cumsum(mix(values ^ U64(0xA5A5A5A5F00D + k)), out=sums[1:])
        keys[:, k] = sums[bounds[1:]] - sums[bounds[:-1]]
    return [row.tobytes() for row in keys]


def _band_hashes(values: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets x bands) hashes; sets must not be empty."""
    out = np.zeros((len(bounds) - 1, bands), U64)
    if len(out):
        seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=U64))
        for h in range(bands * rows):
            lowest = np.minimum.reduceat(mix_light(values, seeds[2 * h] | U64(1), seeds[2 * h + 1]), bounds[:-1])
            out[:, h // rows] = mix(out[:, h // rows] * U64(31) + lowest)
    return out


def mix_light(values: np.ndarray, a: np.uint64, b: np.uint64) -> np.ndarray:
    """One hash function of a family over values that are well mixed already."""
    out = values ^ b
    out *= a
    out ^= out >> U64(32)
    out *= a
    return out


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, key (class), n (set size), bands (packed hashes) per document."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, group in passes(batch.column(1).to_pylist()):
                values, bounds = _sets(group)
                sizes = np.diff(bounds)
                filled = np.flatnonzero(sizes)
                hashes = _band_hashes(values, np.append(bounds[:-1][filled], len(values)), bands, rows)
                packed: list[bytes] = [b""] * len(group)
                for i, row in zip(filled, hashes):
                    packed[i] = row.tobytes()
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(group)), pa.array(_class_keys(values, bounds), pa.binary()),
                    pa.array(sizes.astype(np.int32)), pa.array(packed, pa.binary()),
                ], ["doc_id", "key", "n", "bands"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id bigint, key binary, n int, bands binary")


def _band_rows(classes: DataFrame) -> DataFrame:
    """(key, band, bucket) for every band of every class."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, packed = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            counts = np.array([len(p) // 8 for p in packed], np.int64)
            band = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            hashes = np.frombuffer(b"".join(packed), "<u8")
            bucket = mix(hashes + band.astype(U64) * U64(0x9E3779B97F4A7C15)).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.binary()).take(pa.array(np.repeat(np.arange(len(keys)), counts))),
                pa.array(band.astype(np.int32)), pa.array(bucket),
            ], ["key", "band", "bucket"])

    return classes.select("key", "bands").mapInArrow(spread, "key binary, band int, bucket bigint")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table per (bucket, lo, hi) from batches that are sorted by it."""
    rest: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
        cuts = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
        edges = [0, *cuts.tolist(), len(ids)]
        for a, b in zip(edges, edges[1:]):
            unit = tuple(ids[a].tolist())
            if rest and unit != current:
                yield pa.Table.from_batches(rest)
                rest = []
            current = unit
            rest.append(batch.slice(a, b - a))
    if rest:
        yield pa.Table.from_batches(rest)


def _first_meetings(unit: pa.Table, threshold: float) -> np.ndarray:
    """Boolean matrix (i < j): pairs of this unit that meet here first and whose sizes allow the similarity."""
    band = unit.column("band")[0].as_py()
    block = unit.column("block").to_numpy()
    size = unit.column("n").to_numpy()
    bands = np.frombuffer(b"".join(unit.column("bands").to_pylist()), "<u8").reshape(len(block), -1)
    pairs = np.triu(np.ones((len(block), len(block)), bool), 1)
    lo, hi = unit.column("lo")[0].as_py(), unit.column("hi")[0].as_py()
    if lo != hi:
        pairs &= block[:, None] != block[None, :]
    small, large = np.minimum(size[:, None], size[None, :]), np.maximum(size[:, None], size[None, :])
    pairs &= small >= threshold * large - 1e-9
    for k in range(band):
        pairs &= bands[:, None, k] != bands[None, :, k]
    return pairs


def _overlaps(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the wanted pairs (row, column indices)."""
    if len(sets) <= 8:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs], np.int64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1  # values of one set alone add nothing
    number = np.cumsum(shared) - 1
    owner, column = owner[shared[column]], number[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    width = 4096
    for left in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, [left, left + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[a:b], column[a:b] - left] = 1
        total += part @ part.T
    return np.rint(total[pairs[:, 0], pairs[:, 1]]).astype(np.int64)


def _forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for i, j in pairs.tolist():
        a, b = find(i), find(j)
        if a != b:
            parent[b] = a
            kept.append((i, j))
    return kept


def ngram_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id, group_id, n_copies, n_links.

    class_id: smallest id among the documents with the same set; n_copies: how many those are. n_links: number of other
    documents with similarity of at least the threshold, copies included. group_id: smallest id of the connected component of
    all links.
    """
    bands, rows = choose_bands(threshold, recall)
    docs = docs.select("doc_id", "text")
    signed = stage(signatures(docs.filter("doc_id is not null"), bands, rows), "signatures")
    classes = stage(
        signed.groupBy("key").agg(
            F.min("doc_id").alias("class_id"), F.count("*").alias("copies"), F.first("n").alias("n"),
            F.first("bands").alias("bands"),
        ), "classes",
    )
    met = _band_rows(classes)
    crowded = met.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1")
    placed = (
        met.join(crowded, "bucket").join(classes.select(*_NODE), "key")
        .withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("key", "bucket"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"),
                "band", "block", *_NODE)
    )
    unit = ["bucket", "lo", "hi"]
    schema = "bucket bigint, lo int, hi int, band int, block int, key binary, n int, copies bigint, bands binary"

    def worth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _units(batches):
            pairs = _first_meetings(table, threshold)
            wanted = np.flatnonzero(pairs.any(axis=0) | pairs.any(axis=1))
            if len(wanted):
                yield from table.take(pa.array(wanted)).combine_chunks().to_batches()

    work = stage(placed.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(worth, schema), "work")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, group in passes(batch.column(0).to_pylist()):
                values, bounds = _sets(group)
                yield pa.RecordBatch.from_arrays([
                    pa.array(_class_keys(values, bounds), pa.binary()),
                    pa.array([values[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
                ], ["key", "members"])

    needed = classes.join(work.select("key").distinct(), "key", "left_semi").select(F.col("class_id").alias("doc_id"))
    filled = (
        docs.join(needed, "doc_id").select("text").mapInArrow(fill, "key binary, members binary")
        .groupBy("key").agg(F.first("members").alias("members"))
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _units(batches):
            sets = [np.frombuffer(m, "<u8") for m in table.column("members").to_pylist()]
            size = np.array([len(s) for s in sets])
            copies = table.column("copies").to_numpy()
            pairs = np.argwhere(_first_meetings(table, threshold))
            if not len(pairs):
                continue
            common = _overlaps(sets, pairs)
            total = size[pairs[:, 0]] + size[pairs[:, 1]] - common
            pairs = pairs[common >= threshold * total - 1e-9]
            if not len(pairs):
                continue
            links = np.bincount(pairs.ravel(), copies[pairs[:, ::-1]].ravel(), len(sets)).astype(np.int64)
            own = np.flatnonzero(links)
            keys = table.column("key").to_pylist()
            forest = _forest(len(sets), pairs)
            yield pa.RecordBatch.from_arrays([
                pa.array([keys[i] for i in own] + [keys[i] for i, _ in forest], pa.binary()),
                pa.array([None] * len(own) + [keys[j] for _, j in forest], pa.binary()),
                pa.array(np.concatenate([links[own], np.zeros(len(forest), np.int64)])),
            ], ["a", "b", "links"])

    found = stage(
        work.join(filled, "key").select(*[c.split()[0] for c in schema.split(", ")], "members")
        .repartition(*unit).sortWithinPartitions(*unit).mapInArrow(verify, "a binary, b binary, links bigint"), "links",
    )
    linked = found.filter("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("links").alias("links"))
    roots = components(found.filter("b is not null"))
    grouped = (
        classes.select("key", "class_id", "copies").join(linked, "key", "left")
        .join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    )
    smallest = grouped.groupBy("root").agg(F.min("class_id").alias("group_id"))
    described = grouped.join(smallest, "root").select(
        "key", "class_id", "group_id", F.col("copies").alias("n_copies"),
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    columns = ["doc_id", "class_id", "group_id", "n_copies", "n_links"]
    nameless = docs.filter("doc_id is null").select(
        "doc_id", F.lit(None).cast("bigint").alias("class_id"), F.lit(None).cast("bigint").alias("group_id"),
        F.lit(1).cast("bigint").alias("n_copies"), F.lit(0).cast("bigint").alias("n_links"),
    )
    return signed.select("doc_id", "key").join(described, "key").select(columns).unionByName(nameless)


def one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without near duplicates plus one of each group (the smallest id); all columns kept.

    Of rows that repeat the id and the text of the document kept one stays; rows with its id and another text stay each, as
    do rows with a null id.
    """
    joined = ngram_join(docs.select(docs["doc_id"], docs["text"]), threshold)
    keep = joined.filter("doc_id = group_id").select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi")
    digest = unused("text_digest", docs.columns)
    one_each = kept.withColumn(digest, F.unhex(F.sha2("text", 256))).dropDuplicates(["doc_id", digest]).drop(digest)
    return one_each.unionByName(docs.filter("doc_id is null")) 
