"""Connected components of a link table.

Alternating stars: every node first hands its larger neighbours, then its
smaller ones, over to the smallest node it knows, until only stars are left.
Each half is one aggregate (summed on the map side) and one equi-join; nodes of
very many links (hubs) are joined by broadcast, at most 10,000 of them, as their
links add up to the table (see joined_hot). Rounds grow with the logarithm of
the longest chain.

A table of few links, counted against ``at_once``, is settled by one task: rounds
would cost the driver many plans for little work. The result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docdelta.llm.exprs import joined_hot
from docdelta.plans.scratch import materialize


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest node of its component for every other node."""
    up: dict[int, int] = {}

    def root(i: int) -> int:
        while (j := up.setdefault(i, i)) != i:
            up[i] = i = up[j]
        return i

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = root(u), root(v)
            up[max(a, b)] = min(a, b)
    nodes = [i for i in up if root(i) != i]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(i) for i in nodes], pa.int64())], names=["node", "root"])


def components(links: DataFrame, max_rounds: int = 60, at_once: int = 100_000) -> DataFrame:
    """(node, root) for every node of the links (a, b) but the roots; root is the smallest node."""
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "edges")
    before = _state(edges)
    if before[0] <= at_once:
        return materialize(edges.coalesce(1).mapInArrow(_rooted, "node long, root long"), "rooted")
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        large = joined_hot(both.filter("v > u"), least, ["u"], "n", 2 * before[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = joined_hot(large, least, ["u"], "n", before[0]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _state(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 16))).first()
    return tuple(r)
