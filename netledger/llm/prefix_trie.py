"""The prefix trie of all conversations, from ternary search trees over turn ids, one per range shard.

Turns (role, text) are dictionary-encoded: Spark numbers the distinct ones. A conversation is a sequence of ids; equal sequences are
counted first, so a group of copies of any size is one entry. The distinct sequences are put in order by range partitioning and
cut into shards of at most SHARD_IDS ids. A shard's tree is a ternary search tree (smaller, equal, larger), balanced by
inserting medians first; an iterative traversal adds up members, leaves and savings. Nodes on the paths of a shard's first and last
sequence may reach into its neighbours: they stay open, and neighbouring shards merge theirs, FAN_IN at a time, until all are closed.
Such a boundary is as long as two sequences, whatever the size of a shard.

Sequences longer than SEGMENT turns are cut into segments, each in the trie below the node where the last one ended (named by a hash
chain); tries are built from the deepest level up. No task holds a conversation whole.

Defined cases: null role and text are empty; turns come by number (null first), then role, then text, copies included;
rows without conv_id belong to no conversation and are left out; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from netledger.llm.storage import stage
from netledger.operators.scan import prefix_scan

SEGMENT = 4096
SHARD_IDS = 200_000
#: Neighbouring shards whose open nodes meet in one task.
FAN_IN = 16
#: Conversations whose first turns are replaced come in blocks of BLOCK; at most PREFIX - 1 turns are.
BLOCK, PREFIX = 100, 6
#: Decimal ids that are hashed as one piece.
PIECE_IDS = 50_000
NOTHING = hashlib.sha256(b"").hexdigest()
_NODE = ("root string, key string, parent_key string, conv_id bigint, parent_conv_id bigint, depth bigint, n_convs bigint, "
         "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, chars bigint, "
         "closed boolean, shard bigint, on_left boolean, on_right boolean")
_FIELDS = tuple(f.split()[0] for f in _NODE.split(", "))


# -- sequences ----------------------------------------------------------------------------------------------------------------

def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), turn_key, chars: two-level scan, so that a long conversation is numbered by many tasks."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(F.col("turn").cast("bigint").alias("turn"), role.alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text")).alias("t"),
    ).withColumn("at", F.struct("t.turn", "t.role", "t.text")).select(
        "conv_id", "at", F.unhex(F.sha2(F.concat_ws(":", F.length("t.role"), "t.role", F.hex("t.digest")), 256)).alias("turn_key"),
        F.length("t.text").cast("bigint").alias("chars"),
    )
    bucket = F.coalesce(F.shiftright(F.col("at.turn"), 8), F.lit(-(1 << 62)))
    return prefix_scan(rows, ["conv_id"], ["at"], bucket, sums={"place": F.lit(1).cast("bigint")}).drop("at")


def encoded(turns: DataFrame) -> DataFrame:
    """turn_key replaced by turn_id: the distinct turns, numbered when their table is written."""
    turns = stage(turns, "turns")
    dictionary = stage(turns.select("turn_key").distinct().withColumn("turn_id", F.monotonically_increasing_id()), "dictionary")
    return stage(turns.join(dictionary, "turn_key").select("conv_id", "place", "turn_id", "chars"), "encoded")


def crc32_prefix(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % PREFIX).cast("bigint")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id, n_turns), (turns: conv_id, depth from 1, turn_id, chars) with the shared beginnings put in."""
    convs = turns.groupBy("conv_id").agg(F.max("place").alias("n")).withColumns({
        "h": crc32_prefix(F.col("conv_id")), "base": F.col("conv_id") - F.col("conv_id") % BLOCK,
    })
    sizes = convs.filter(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = stage(convs.join(sizes, "base", "left").select(
        "conv_id", "base", "n", "h", F.least("h", F.coalesce("base_n", F.lit(0).cast("bigint"))).alias("shared")), "conversations")
    heads = turns.filter((F.col("conv_id") % BLOCK == 0) & (F.col("place") < PREFIX)).withColumnRenamed("conv_id", "base")
    # At most BLOCK conversations (two blocks around zero) take the first PREFIX - 1 turns of one.
    taken = convs.join(heads, "base").filter("place <= shared").select("conv_id", F.col("place").alias("depth"), "turn_id", "chars")
    own = turns.join(convs.select("conv_id", "h", "shared"), "conv_id").filter("place > h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("shared")).alias("depth"), "turn_id", "chars")
    size = F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return convs.select("conv_id", size.cast("bigint").alias("n_turns")), taken.unionByName(own)


def segments(convs: DataFrame, turns: DataFrame, segment: int) -> DataFrame:
    """conv_id, level, last, ids, chars, root, path: one row per segment; the last one of a conversation may be empty.

    path names the node where a segment ends (hash chain over the conversation's segments), root the node where it begins.
    """
    cut = turns.groupBy("conv_id", F.floor((F.col("depth") - 1) / segment).alias("level")).agg(
        F.sort_array(F.collect_list(F.struct("depth", "turn_id", "chars"))).alias("t")  # at most `segment` turns
    ).select("conv_id", "level", F.col("t.turn_id").alias("ids"), F.col("t.chars").alias("chars"))
    every = convs.select("conv_id", F.floor(F.col("n_turns") / segment).alias("last_level")).select(
        "conv_id", "last_level", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last_level"))).alias("level"))
    none = F.array().cast("array<bigint>")
    rows = stage(every.join(cut, ["conv_id", "level"], "left").select(
        "conv_id", "level", (F.col("level") == F.col("last_level")).alias("last"), F.coalesce("ids", none).alias("ids"),
        F.coalesce("chars", none).alias("chars"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("digest"),
    ), "segments")
    chain = lambda root: F.sha2(F.concat(root, F.coalesce("digest", F.lit(""))), 256)
    long = rows.filter("level > 0").select("conv_id").distinct()
    if long.isEmpty():
        return rows.select("*", F.lit("").alias("root"), chain(F.lit("")).alias("path")).drop("digest")
    # One digest per segment: a conversation of a million turns has a list of 250.
    step = lambda acc, d: F.concat(acc, F.array(F.sha2(F.concat(F.element_at(acc, -1), F.coalesce(d["digest"], F.lit(""))), 256)))
    roots = rows.join(long, "conv_id", "left_semi").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("level", "digest"))).alias("d")).select(
        "conv_id", F.posexplode(F.aggregate("d", F.array(F.lit("")), step)).alias("level", "root"))
    rows = rows.join(roots.withColumn("level", F.col("level").cast("bigint")), ["conv_id", "level"], "left").withColumn(
        "root", F.coalesce("root", F.lit("")))
    return stage(rows.withColumn("path", chain(F.col("root"))).drop("digest"), "chained")


def end_hashes(ends: DataFrame) -> DataFrame:
    """path, ends_sha256 of the ascending decimal conv_ids per path, comma-joined.

    Ids are joined in pieces by the tasks of a range sort; one stream per path then hashes its few pieces, holding one at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, ids = None, []

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], ["path", "first", "ids"])

        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (p != path or len(ids) >= PIECE_IDS):
                    yield piece()
                    ids = []
                path = p
                ids.append(c)
        if ids:
            yield piece()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, running = None, None
        for batch in batches:
            out = []
            for p, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if p != path:
                    if running:
                        out.append((path, running.hexdigest()))
                    path, running = p, hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], ["path", "ends_sha256"])
        if running:
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([running.hexdigest()])], ["path", "ends_sha256"])

    cut = ends.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInArrow(
        pieces, "path string, first bigint, ids string")
    return cut.repartition("path").sortWithinPartitions("path", "first").mapInArrow(digests, "path string, ends_sha256 string")


# -- shards -------------------------------------------------------------------------------------------------------------------

@dataclass(slots=True)
class Node:
    """A trie node; children_, leaves_ and saved_ hold what its closed children have told."""

    key: str
    parent: str | None
    depth: int
    chars: int
    low: int
    members: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: str | None = None
    closed: bool = True
    parent_low: int | None = None
    root: str | None = None  # the name of the trie, at its root

    def tell(self, parent: Node) -> None:
        """Close this node: add its subtree, itself included, to its parent."""
        self.leaves = self.leaves if self.children else 1
        self.saved += (self.members - 1) * self.chars
        parent.children += 1
        parent.leaves += self.leaves
        parent.saved += self.saved


class TernaryTree:
    """Ids of one root: parallel lists smaller, equal, larger (0: none) over split ids; each cell is a node of the trie."""

    def __init__(self):
        self.split, self.smaller, self.equal, self.larger = [0], [0], [0], [0]
        self.chars, self.low, self.members, self.entry = [0], [0], [0], [None]

    def insert(self, entry: dict) -> None:
        """Cell 0 is the root of the trie; equal leads to the tree of a cell's children."""
        at = self._pass(0, entry)
        for token, chars in zip(entry["ids"], entry["chars"]):
            cell, link = self.equal[at], (self.equal, at)
            while cell and self.split[cell] != token:
                link = (self.smaller if token < self.split[cell] else self.larger), cell
                cell = link[0][cell]
            if not cell:
                cell = link[0][link[1]] = len(self.split)
                for column, value in ((self.split, token), (self.smaller, 0), (self.equal, 0), (self.larger, 0), (self.chars, chars),
                                      (self.low, entry["low"]), (self.members, 0), (self.entry, None)):
                    column.append(value)
            at = self._pass(cell, entry)
        self.entry[at] = entry

    def _pass(self, cell: int, entry: dict) -> int:
        self.low[cell] = min(self.low[cell], entry["low"]) if self.members[cell] else entry["low"]
        self.members[cell] += entry["n"]
        return cell

    def walk(self) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(cell, parent cell, depth) in order, parents first, without recursion."""
        yield 0, -1, 0
        todo = [(self.equal[0], 0, 1, False)]
        while todo:
            cell, parent, depth, seen = todo.pop()
            if not cell:
                continue
            if seen:
                yield cell, parent, depth
            else:
                todo += [(self.larger[cell], parent, depth, False), (self.equal[cell], cell, depth + 1, False),
                         (cell, parent, depth, True), (self.smaller[cell], parent, depth, False)]


def medians_first(n: int) -> Iterator[int]:
    todo = [(0, n)]
    while todo:
        low, high = todo.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            todo += [(middle + 1, high), (low, middle)]


def shard_nodes(entries: list[dict], base: int) -> tuple[list[Node], set[str], set[str]]:
    """The nodes of the tries over sorted entries (root, ids, chars, n, low, ends, below), and the keys of the outer paths."""
    out, left, right = [], set(), set()
    begin = 0
    while begin < len(entries):
        root = entries[begin]["root"]
        end = bisect_left(entries, True, begin, key=lambda e: e["root"] != root)
        tree = TernaryTree()
        for k in medians_first(end - begin):
            tree.insert(entries[begin + k])
        paths = [entries[k]["ids"] for k, outer in ((begin, begin == 0), (end - 1, end == len(entries))) if outer]
        sides = [side for side, outer in ((left, begin == 0), (right, end == len(entries))) if outer]
        nodes: dict[int, Node] = {}
        pairs: list[tuple[Node, Node | None]] = []
        on_path: dict[int, list[int]] = {}  # cells on outer paths, and which
        for cell, up, depth in tree.walk():
            on = [k for k, path in enumerate(paths) if up < 0 or k in on_path.get(up, ()) and depth <= len(path) and path[depth - 1] == tree.split[cell]]
            parent = nodes.get(up)
            # Only nodes on outer paths get a name: no other shard has to find the rest.
            name = f"{root}|" if up < 0 else f"{parent.key},{tree.split[cell]}"
            key = hashlib.sha256(name.encode()).hexdigest() if on else ""
            node = nodes[cell] = Node(key, parent.key if parent else None, base + depth, tree.chars[cell], tree.low[cell], tree.members[cell],
                                      closed=not on, root=root if up < 0 else None)
            pairs.append((node, parent))
            if on:
                on_path[cell] = on
                for k in on:
                    sides[k].add(key)
            if (entry := tree.entry[cell]) is not None:
                node.ends = entry["ends"]
                if entry["children"]:
                    node.children, node.leaves, node.saved = entry["children"], entry["leaves"], entry["saved"]
        close(pairs)
        out += nodes.values()
        begin = end
    return out, left, right


def close(pairs: list[tuple[Node, Node | None]]) -> None:
    """Add up closed nodes, from (node, parent) with parents first; children of closed parents learn their smallest member."""
    for node, parent in reversed(pairs):
        if node.closed and parent is not None:
            node.tell(parent)
        elif node.closed:
            node.leaves = node.leaves if node.children else 1  # a root has no text of its own
        if parent is not None and parent.closed:
            node.parent_low = parent.low


def _rows(nodes: Iterable[Node], shard: int, left: set[str], right: set[str]) -> list[tuple]:
    return [(n.root, n.key, n.parent, n.low, n.parent_low, n.depth, n.members, n.children, n.leaves, n.saved, n.ends, n.chars, n.closed, shard,
             n.key in left, n.key in right) for n in nodes]


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[f.split()[1]]) for k, f in enumerate(_NODE.split(", "))], list(_FIELDS))


def merge_open(rows: list[dict], shard: int, whole: bool) -> list[tuple]:
    """Merge the open nodes of neighbouring shards; what is not on the outer paths of all of them together is closed.

    whole: these are all shards there are, so that every node is closed.
    """
    first, last = min(r["shard"] for r in rows), max(r["shard"] for r in rows)
    left = {r["key"] for r in rows if not whole and r["shard"] == first and r["on_left"]}
    right = {r["key"] for r in rows if not whole and r["shard"] == last and r["on_right"]}
    nodes: dict[str, Node] = {}
    outer = left | right
    for r in sorted(rows, key=lambda r: r["depth"]):
        node = nodes.get(r["key"])
        if node is None:
            node = nodes[r["key"]] = Node(r["key"], r["parent_key"], r["depth"], r["chars"], r["conv_id"], closed=r["key"] not in outer, root=r["root"])
        node.low = min(node.low, r["conv_id"])
        node.members += r["n_convs"]
        node.children += r["n_children"]
        node.leaves += r["n_leaves"]
        node.saved += r["saved_tokens"]
        node.ends = node.ends or r["ends_sha256"]
    close([(n, nodes.get(n.parent)) for n in nodes.values()])
    return _rows(nodes.values(), shard, left, right)


def level_nodes(entries: DataFrame, base: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """All nodes of the tries over the entries (root, ids, chars, n, low, ends, children, leaves, saved), closed."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, held = TaskContext.get().partitionId() << 24, 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            nodes, left, right = shard_nodes(held, base)
            for at in range(0, len(nodes), 10_000):
                yield _table(_rows(nodes[at:at + 10_000], number, left, right))

        for batch in batches:
            for entry in batch.to_pylist():
                if held and size + len(entry["ids"]) > shard_ids:
                    yield from flush()
                    number, size, held = number + 1, 0, []
                held.append(entry)
                size += len(entry["ids"]) + 1
        if held:
            yield from flush()

    ordered = entries.repartitionByRange("root", "ids").sortWithinPartitions("root", "ids")
    rows = stage(ordered.mapInArrow(build, _NODE), "nodes")
    done, waiting, shift = rows.filter("closed"), rows.filter("not closed"), 24
    while not waiting.isEmpty():
        shift += FAN_IN.bit_length() - 1
        group = F.shiftright("shard", shift)
        whole = waiting.select(F.max(group)).first()[0] == 0  # the last round: nothing lies beyond
        merged = stage(waiting.groupBy(group).applyInPandas(_merger(shift, whole), _NODE), "merged")
        done, waiting = done.unionByName(merged.filter("closed")), merged.filter("not closed")
    return done


def _merger(shift: int, whole: bool):
    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        rows = frame.astype(object).where(frame.notna(), None).to_dict("records")
        return pd.DataFrame(merge_open(rows, int(rows[0]["shard"]) >> shift << shift, whole), columns=_FIELDS)

    return merge


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT, shard_ids: int = SHARD_IDS) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations (conv_id, turn, role, text)."""
    convs, turns = rebuilt(encoded(ordered_turns(conversations)))
    rows = segments(convs, turns, segment)
    ends = end_hashes(rows.filter("last").select("path", "conv_id"))
    counted = rows.groupBy("level", "root", "path", "ids", "chars").agg(F.count("*").alias("n"), F.min("conv_id").alias("low"))
    entries = stage(counted.join(ends.withColumnRenamed("ends_sha256", "ends"), "path", "left"), "entries")
    deepest = entries.agg(F.coalesce(F.max("level"), F.lit(-1))).first()[0]
    nothing = [F.lit(0).cast("bigint").alias(c) for c in ("children", "leaves", "saved")]
    below, parts, named = None, [], []
    for level in range(deepest, -1, -1):
        here = entries.filter(F.col("level") == level).drop("level")
        if below is None:
            here = here.select("*", *nothing)
        else:  # what hangs below the nodes where full segments end
            here = here.join(below, "path", "left").withColumn("ends", F.coalesce("ends", "below_ends")).drop("below_ends").fillna(
                0, ["children", "leaves", "saved"])
        nodes = level_nodes(here.select("root", "ids", "chars", "n", "low", "ends", "children", "leaves", "saved"), level * segment, shard_ids)
        below = nodes.filter("root is not null").select(
            F.col("root").alias("path"), F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"),
            F.col("saved_tokens").alias("saved"), F.col("ends_sha256").alias("below_ends"))
        parts.append(nodes if level == 0 else nodes.filter("root is null"))
        named.append(nodes.filter("key <> ''").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found")))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if not parts:
        return conversations.sparkSession.createDataFrame([], ", ".join(f"{c} bigint" for c in columns[:-1]) + ", ends_sha256 string")
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    nodes = union(parts)
    open_parent = F.col("parent_conv_id").isNull() & (F.col("parent_key") != "")
    looked_up = nodes.filter(open_parent).join(union(named), "parent_key", "left").withColumn("parent_conv_id", F.col("found"))
    rest = nodes.filter(~F.coalesce(open_parent, F.lit(False)))
    return rest.select(*columns).unionByName(looked_up.select(*columns)).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
