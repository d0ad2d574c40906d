"""Token counts: greedy longest-match word pieces in linear time, without building the pieces.

The vocabulary is a trie over UTF-8 bytes with two roots, one for pieces that begin a word and one for pieces that go on. Where
the walk through a word gets stuck in a node, the pieces that greedy matching would cut off are known in advance: each
node has a failure link (where the walk stands after them) and the number of pieces popped on the way. Counting a word is one
step per byte plus one per popped link.

Words are runs of letters and digits, and single other characters that are not white space; pieces are case-sensitive. A
word that no sequence of pieces spells counts as one unknown piece. In vocabulary files of byte-level tokenizers,
tokens with a leading space begin a word, all others go on.

Defined cases: a null text is an empty one (0 words, 0 pieces); repeated rows give one row each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from netledger.llm.bpe import read_ranks
from netledger.llm.textops import Codes, class_table, passes

#: Words remembered per task; beyond it the memory starts anew.
MEMORY = 300_000
_NONE = -1


class PieceCounter:
    def __init__(self, begin: Iterable[bytes], go_on: Iterable[bytes]):
        # Node 0 begins a word, node 1 goes on.
        self.child: list[dict[int, int]] = [{}, {}]
        is_piece = [False, False]
        for root, pieces in ((0, begin), (1, go_on)):
            for piece in pieces:
                node = root
                for byte in piece:
                    nxt = self.child[node].get(byte)
                    if nxt is None:
                        nxt = self.child[node][byte] = len(self.child)
                        self.child.append({})
                        is_piece.append(False)
                    node = nxt
                if node > 1:
                    is_piece[node] = True
        self.fail, self.popped = [_NONE] * len(self.child), [0] * len(self.child)
        level = [0, 1]
        while level:
            deeper = []
            for node in level:
                for byte, nxt in self.child[node].items():
                    deeper.append(nxt)
                    if is_piece[nxt]:
                        # The whole path is a piece: cut it off and go on from the second root.
                        self.fail[nxt], self.popped[nxt] = 1, 1
                        continue
                    at, count = self.fail[node], self.popped[node]
                    while at != _NONE and byte not in self.child[at]:
                        count += self.popped[at]
                        at = self.fail[at]
                    if at != _NONE:
                        self.fail[nxt], self.popped[nxt] = self.child[at][byte], count
            level = deeper

    def __call__(self, word: bytes) -> int:
        """Number of pieces of the word; 0 if it cannot be spelled."""
        child, fail, popped = self.child, self.fail, self.popped
        node = count = 0
        for byte in word:
            while byte not in child[node]:
                if fail[node] == _NONE:
                    return 0
                count += popped[node]
                node = fail[node]
            node = child[node][byte]
        while node > 1:
            if fail[node] == _NONE:
                return 0
            count += popped[node]
            node = fail[node]
        return count


def pieces_of_ranks(path: str) -> tuple[list[bytes], list[bytes]]:
    tokens = list(read_ranks(path))
    return [t[1:] for t in tokens if t[:1] == b" " and len(t) > 1], [t for t in tokens if t[:1] != b" "]


def word_spans(batch: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every word: runs of letters and digits, single other characters."""
    kind = class_table()[batch.codes]
    start, end, text = batch.runs((kind == 1) | (kind == 2))
    lone = np.flatnonzero(kind == 0)
    starts, ends = np.concatenate([start, lone]), np.concatenate([end, lone + 1])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    return starts, ends, np.searchsorted(batch.offsets, starts, "right") - 1


def count_pieces(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_words, n_pieces, n_unknown per document row."""
    # Bounded by the vocabulary; a worker loads it once.
    counter_ = docs.sparkSession.sparkContext.broadcast(PieceCounter(*pieces_of_ranks(ranks_path)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_.value
        memory: dict[str, int] = {}
        for batch in batches:
            for first, group in passes(batch.column(1).to_pylist()):
                codes = Codes(group)
                start, end, text = word_spans(codes)
                joined = "".join(group)
                sizes = np.empty(len(start), np.int64)
                for k, (a, b) in enumerate(zip(start.tolist(), end.tolist())):
                    word = joined[a:b]
                    size = memory.get(word)
                    if size is None:
                        if len(memory) >= MEMORY:
                            memory.clear()
                        size = memory[word] = counter(word.encode("utf-8", "surrogatepass"))
                    sizes[k] = size
                per_text = lambda values: np.bincount(text, values, len(group)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(group)), pa.array(per_text(np.ones(len(text)))),
                    pa.array(per_text(np.maximum(sizes, 1))), pa.array(per_text(sizes == 0)),
                ], ["doc_id", "n_words", "n_pieces", "n_unknown"])

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id bigint, n_words bigint, n_pieces bigint, n_unknown bigint")
