"""Connected components as rounds of contraction over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from netledger.llm.storage import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); nodes of one component share their root.

    Each round points every node at the neighbour (or itself) with the smallest random priority, relabels the edges and
    drops those that became loops. The number of nodes with edges shrinks by a constant factor in expectation, so
    the rounds are logarithmic in the input; every round is a written table. Rows with a null end and loops are ignored.
    """
    edges = stage(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    maps = []
    while not edges.isEmpty():
        priority = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(maps))), F.col(c).alias("k"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointed = stage(
            both.groupBy("a").agg(F.min(priority("b")).alias("p"))
            .select(F.col("a").alias("node"), F.least(F.col("p"), priority("a"))["k"].alias("root")),
            "pointers",
        )
        maps.append(pointed)
        at = lambda end: pointed.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
        edges = stage(
            edges.join(at("a"), "a").join(at("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
            .filter("a <> b").distinct(),
            "edges",
        )
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = maps[0]
    for later in maps[1:]:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
        out = out.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
