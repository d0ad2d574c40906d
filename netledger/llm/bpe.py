"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Texts are cut into pre-tokens; each distinct pre-token of the whole corpus is encoded once; the ids go back to where the
pre-tokens stood. Positions stay with the text: a chunk (documents of about CHUNK_CHARS characters, or one longer document)
keeps, per document, the numbers of its pre-tokens in the chunk's own list of distinct ones. Only that list is exploded and shuffled, split
by word hash into `buckets` parts, so the shuffle carries each word once per chunk rather than once per place. A task
of the encoding stage sees every word of its buckets once per chunk, merges each distinct one once and sends packed ids back.
The chunk is then reassembled by position, and decoded by joining ids with the token-byte table (bounded by the vocabulary).

A chunk's name is a hash of its documents and words. Both branches of the plan (positions and words) compute it
from the text, so a recomputed task gives the same chunks for the same input; if ever a chunk misses words,
the job fails instead of returning wrong ids.

Defined cases: a null text is an empty one and has no tokens; repeated rows give one row each; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from netledger.llm.textops import U64, Codes, SpanHash, class_table, mix, ragged

CHUNK_CHARS = 4_000_000
#: Characters of a chunk that are hashed or compared at a time; bounds the wide arrays of a task.
BLOCK_CHARS = 500_000
#: Parts that a chunk's list of words is split into, at least; four times the shuffle partitions if that is more.
BUCKETS = 1024
#: Encoded words that a task remembers.
KNOWN_WORDS = 400_000
#: Hash functions tried for the pre-tokens of a chunk.
SALTS = 4
#: Endings that the pre-token pattern splits off after an apostrophe.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def pretoken_starts(batch: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pre-tokens of a batch (they tile every text) and their bounds per text.

    The pattern is: a contraction; or letters, numbers or other marks with at most one leading space; or white space,
    of which the last character stays for what follows.
    """
    codes, offsets = batch.codes, batch.offsets
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = class_table()[codes]
    fresh = np.empty(n, bool)
    fresh[0] = True
    fresh[1:] = kind[1:] != kind[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    fresh[heads] = True
    # White space before something else of the same text: its last character starts a token of its own; a plain space
    # takes the following run with it.
    run_end = np.append(fresh[1:], True)
    text_end = np.zeros(n, bool)
    text_end[offsets[1:][offsets[1:] > 0] - 1] = True
    last_space = np.flatnonzero((kind == 3) & run_end & ~text_end)
    fresh[last_space] = True
    joined = last_space[codes[last_space] == 32]
    fresh[joined + 1] = False
    # Contractions: a lone apostrophe that starts a token, followed by letters.
    lone = np.flatnonzero(fresh & (codes == 39) & run_end & ~text_end)
    for at in lone.tolist():
        tail = codes[at:at + 3]
        for ending in CONTRACTIONS:
            size = len(ending)
            if len(tail) >= size and all(tail[k] == ord(ending[k]) for k in range(size)):
                if not fresh[at + 2:at + size].any() and kind[at + 1] == 1:
                    fresh[at + 1] = False
                    # Letters left over start a token; a longer run of letters went on before.
                    if at + size < n and not text_end[at + size - 1]:
                        fresh[at + size] = fresh[at + size] or kind[at + size] == 1
                    break
    starts = np.flatnonzero(fresh)
    return starts, np.searchsorted(starts, offsets)


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the pair of the lowest rank, the leftmost first, until no pair is in the vocabulary."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    if n <= 64:
        parts = [word[i:i + 1] for i in range(n)]
        pairs = [ranks.get(word[i:i + 2]) for i in range(n - 1)]
        while True:
            low, at = None, -1
            for i, rank in enumerate(pairs):
                if rank is not None and (low is None or rank < low):
                    low, at = rank, i
            if low is None:
                return [ranks[p] for p in parts]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1])
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
    # Long words: a heap of pairs over a linked list of parts; stale entries are skipped.
    right = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    end_of = list(range(1, n + 1))
    while heap:
        rank, i, stop = heapq.heappop(heap)
        j = right[i] if alive[i] else n
        if not alive[i] or j >= n or end_of[j] != stop or ranks.get(word[i:stop]) != rank:
            continue
        alive[j] = False
        end_of[i] = stop
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
            if (r := ranks.get(word[i:end_of[right[i]]])) is not None:
                heapq.heappush(heap, (r, i, end_of[right[i]]))
        if left[i] >= 0 and (r := ranks.get(word[left[i]:stop])) is not None:
            heapq.heappush(heap, (r, left[i], stop))
    return [ranks[word[i:end_of[i]]] for i in range(n) if alive[i]]


def _blocks(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive pre-tokens of at most about BLOCK_CHARS characters (or one longer pre-token)."""
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + BLOCK_CHARS, "right")))
        yield a, b
        a = b


class Chunk:
    """Distinct pre-tokens of some texts and, per text, their numbers in order."""

    def __init__(self, texts: list[str], buckets: int):
        batch = Codes(texts)
        self.starts, self.bounds = pretoken_starts(batch)
        ends = np.append(self.starts[1:], len(batch.codes))
        hashes = np.empty(len(self.starts), U64)
        length = ends - self.starts
        for salt in range(77, 77 + SALTS):
            for a, b in _blocks(self.starts, ends):
                at = self.starts[a]
                values = mix(batch.codes[at:ends[b - 1]].astype(U64) + U64(salt))
                hashes[a:b] = SpanHash(values)(self.starts[a:b] - at, ends[a:b] - at)
            distinct, first, number = np.unique(hashes, return_index=True, return_inverse=True)
            # Hashes only group; every place is compared with the first place of its group, and other hashes are taken
            # where two different pre-tokens meet.
            model = self.starts[first][number]
            if np.array_equal(length, length[first][number]) and all(
                np.array_equal(batch.codes[self.starts[a]:ends[b - 1]], batch.codes[ragged(model[a:b], length[a:b])])
                for a, b in _blocks(self.starts, ends)
            ):
                break
        else:
            raise ValueError(f"different pre-tokens have the same 64-bit hash under {SALTS} hash functions")
        bucket = (distinct % U64(buckets)).astype(np.int64)
        order = np.lexsort((distinct, bucket))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.number = rank[number]
        self.edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        joined = "".join(texts)
        self.words = [joined[s:e].encode("utf-8", "surrogatepass")
                      for s, e in zip(self.starts[first][order].tolist(), ends[first][order].tolist())]

    def name(self, ids: list) -> int:
        digest = hashlib.blake2b(repr(ids).encode(), digest_size=8)
        for word in self.words:
            digest.update(word)
            digest.update(b"\xff")
        return int.from_bytes(digest.digest(), "little", signed=True)


def _chunks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[tuple[int, list, Chunk]]:
    """(name, ids, chunk) of consecutive documents of up to CHUNK_CHARS; the borders of batches do not matter."""
    ids: list = []
    texts: list[str] = []
    chars = 0

    def done() -> tuple[int, list, Chunk]:
        chunk = Chunk(texts, buckets)
        return chunk.name(ids), list(ids), chunk

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            if texts and chars + len(text) > CHUNK_CHARS:
                yield done()
                ids, texts, chars = [], [], 0
            ids.append(doc_id)
            texts.append(text)
            chars += len(text)
    if texts:
        yield done()


def _pack(numbers: np.ndarray) -> bytes:
    """Compressed unsigned numbers below 2^32, stored byte plane by byte plane."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _word_lists(words: list[bytes]) -> bytes:
    return np.array([len(w) for w in words], "<u4").tobytes() + b"".join(words)


def _split_list(packed: bytes, count: int) -> list[bytes]:
    lengths = np.frombuffer(packed, "<u4", count)
    at = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]) + 4 * count
    return [packed[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def encode(docs: DataFrame, ranks_path: str, emit, fields: str, buckets: int | None = None) -> DataFrame:
    """Token ids of every document, handed to emit(doc_ids, ids, bounds, token_bytes) chunk by chunk.

    ids is one array for all documents of the chunk (document i: ids[bounds[i]:bounds[i + 1]]); token_bytes is the decoding table
    (see `decode_bytes`). emit returns an Arrow batch of the columns named in fields. The driver reads the rank file
    and sends it to all executors.
    """
    buckets = buckets or max(BUCKETS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # bounded by the vocabulary
    docs = docs.select("doc_id", "text")

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, ids, chunk in _chunks(batches, buckets):
            yield pa.RecordBatch.from_arrays([
                pa.array([name], pa.int64()), pa.array([_pack(np.diff(chunk.bounds))], pa.binary()),
                pa.array([_pack(chunk.number)], pa.binary()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([len(chunk.words)], pa.int64()),
            ], ["chunk", "counts", "numbers", "ids", "n_words"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, chunk in _chunks(batches, buckets):
            filled = np.flatnonzero(np.diff(chunk.edges)).tolist()
            lists = [chunk.words[chunk.edges[b]:chunk.edges[b + 1]] for b in filled]
            yield pa.RecordBatch.from_arrays([
                pa.array(filled, pa.int32()), pa.array([name] * len(filled), pa.int64()),
                pa.array([len(x) for x in lists], pa.int32()), pa.array([_word_lists(x) for x in lists], pa.binary()),
            ], ["bucket", "chunk", "n", "words"])

    def encode_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = ranks.value, {}
        for batch in batches:
            out = []
            for count, packed in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                flat: list[int] = []
                sizes = []
                for word in _split_list(packed, count):
                    ids = known.get(word)
                    if ids is None:
                        if len(known) >= KNOWN_WORDS:  # a task takes many buckets; what it remembers stays bounded
                            known.clear()
                        ids = known[word] = np.array(encode_word(word, table), "<u4").tobytes()
                    sizes.append(len(ids) // 4)
                    flat.append(ids)
                out.append(np.array(sizes, "<u4").tobytes() + b"".join(flat))
            packed = [zstandard.ZstdCompressor(level=1).compress(
                np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(-1, 4).T).tobytes()) for x in out]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(0), batch.column(2), pa.array(packed, pa.binary())],
                ["chunk", "bucket", "n", "encoded"])

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        table = _byte_table(ranks.value)
        # Repeated documents can give equal chunks, whose words come back once for each; one of them is enough.
        back_by_bucket = dict(zip(right.column("bucket").to_pylist(), zip(right.column("n").to_pylist(),
                                                                          right.column("encoded").to_pylist())))
        sizes, flat = [], []
        for _, (n, packed) in sorted(back_by_bucket.items()):
            numbers = _unpack(packed)
            sizes.append(numbers[:n].astype(np.int64))
            flat.append(numbers[n:])
        size = np.concatenate([*sizes, np.zeros(0, np.int64)])
        ids = np.concatenate([*flat, np.zeros(0, "<u4")])
        begin = np.cumsum(size) - size
        results = []
        for row in left.to_pylist():
            if row["n_words"] != len(size):
                raise ValueError(f"chunk {row['chunk']} has {row['n_words']} words, {len(size)} came back")
            number = _unpack(row["numbers"]).astype(np.int64)
            counts = _unpack(row["counts"]).astype(np.int64)
            out = ids[ragged(begin[number], size[number])]
            ends = np.concatenate([[0], np.cumsum(size[number])])
            bounds = ends[np.concatenate([[0], np.cumsum(counts)])]
            results.append(emit(row["ids"], out, bounds, table))
        return pa.Table.from_batches(results)

    there = docs.mapInArrow(positions, "chunk bigint, counts binary, numbers binary, ids array<bigint>, n_words bigint")
    back = (
        docs.mapInArrow(words, "bucket int, chunk bigint, n int, words binary")
        .repartition("bucket")
        .mapInArrow(encode_all, "chunk bigint, bucket int, n int, encoded binary")
    )
    return there.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(assemble, fields)


_tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _byte_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens in one array, with start and length by id; built once per worker."""
    if id(ranks) not in _tables:
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        lengths = np.array([len(t) for t in tokens], np.int64)
        _tables.clear()
        _tables[id(ranks)] = (np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths)
    return _tables[id(ranks)]


def decode_bytes(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids, and where each id's bytes begin (one entry more than ids)."""
    flat, start, length = table
    own = length[ids]
    return flat[ragged(start[ids], own)], np.concatenate([[0], np.cumsum(own)])


def digests(doc_ids: list, ids: np.ndarray, bounds: np.ndarray, table) -> pa.RecordBatch:
    """doc_id, n_tokens and the hashes of the packed ids and of the decoded bytes."""
    data, at = decode_bytes(ids, table)
    packed, raw = ids.astype("<u4").tobytes(), data.tobytes()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    edges = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
    return pa.RecordBatch.from_arrays([
        pa.array(doc_ids, pa.int64()), pa.array(np.diff(bounds), pa.int64()),
        pa.array([sha(packed[4 * a:4 * b]) for a, b in edges], pa.string()),
        pa.array([sha(raw[at[a]:at[b]]) for a, b in edges], pa.string()),
    ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


DIGEST_FIELDS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def token_ids(doc_ids: list, ids: np.ndarray, bounds: np.ndarray, table) -> pa.RecordBatch:
    """doc_id, ids (array) and the decoded text."""
    data, at = decode_bytes(ids, table)
    raw = data.tobytes()
    edges = list(zip(bounds[:-1].tolist(), bounds[1:].tolist()))
    return pa.RecordBatch.from_arrays([
        pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())),
        pa.array([raw[at[a]:at[b]].decode("utf-8", "replace") for a, b in edges], pa.string()),
    ], ["doc_id", "ids", "decoded"])


TOKEN_FIELDS = "doc_id bigint, ids array<int>, decoded string"
