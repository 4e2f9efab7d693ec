"""Near-duplicates by SimHash and the Jaccard similarity of word shingles, for the pipeline.

Words as in simhash; shingles of five words, each once, as XXH64. Two texts are
near-duplicates if the Jaccard similarity of their shingle sets is ``least`` or
more. Texts of fewer words have one shingle, texts without words an empty one.

Candidates come from two places. The SimHash fingerprints of the sets link at
``DISTANCE`` or fewer bits by pigeonhole blocks, none of such pairs is missed
(see simhash). Pairs at similarity 0.8 differ by up to 13 bits, where blocks
select nothing; they meet under one of ``BANDS`` min-hash bands of ``ROWS``
values: at 0.8 a pair misses all bands with probability (1 - 0.8^5)^32, three in
a million, above it more rarely. Both only decide which texts are compared: their
links give candidate groups, and inside a group every pair is compared by its
exact sets, so fingerprints that are close by chance drop no text. Large groups
are cut into tiles that together compare every pair; a tile returns the links of
a spanning forest.

Defined cases
    null text: no words; equal shingle sets: one node, however many rows; null
    doc_id: links like any other; repeated rows: see simhash; empty table: no rows.

Scale: the text is read twice and shuffled only where a candidate group has
it; hot bands are summed on the map side and joined by broadcast up to a counted
bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docdelta.llm import simhash
from docdelta.llm.exprs import joined_hot
from docdelta.llm.graph import components
from docdelta.llm.simhash import component_names, keep_named
from docdelta.plans.scratch import materialize

# Shingle width and seed, bits of a close fingerprint, bands and the values in each.
WIDTH, SEED, DISTANCE = 5, 42, 4
BANDS, ROWS = 32, 5
_DRAW = np.random.default_rng(SEED).integers(1, 1 << 63, size=(2, BANDS * ROWS, 1), dtype=np.uint64)
_TIMES, _PLUS = _DRAW[0] * np.uint64(2) + np.uint64(1), _DRAW[1]


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    from xxhash import xxh64_intdigest as h

    found = simhash.shingles(text, width).astype(np.uint64)
    return np.unique(found) if len(found) else np.array([h(b"", SEED)], np.uint64)


def bands(hashes: np.ndarray) -> list[int]:
    """One signed value a band."""
    from xxhash import xxh64_intdigest as h

    low = np.full(BANDS * ROWS, 2**32 - 1, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(low, ((hashes[i : i + 1024] * _TIMES + _PLUS) >> np.uint64(32)).min(axis=1), out=low)
    rows = low.astype("<u4").reshape(BANDS, ROWS)
    return np.array([h(r.tobytes(), SEED) for r in rows], np.uint64).view(np.int64).tolist()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh64_intdigest as h

    for batch in batches:
        sets = [shingles(t.as_py()) for t in batch.column(2)]
        node = np.array([h(s.astype("<u8").tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        keys = pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
        fp = pa.array(np.array([simhash.folded(s) for s in sets], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), fp, keys], names=["doc_id", "th", "node", "fp", "bands"])


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = pa.array([shingles(t.as_py()).view(np.int64) for t in batch.column(3)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), sets], names=["root", "m", "node", "shingles"])


def close_pairs(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Which pairs of sets are similar, as a boolean matrix."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Only what two sets share counts; the columns are taken in bounded lots.
    column = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[place]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        both += part @ part.T
    return both >= least * (size[:, None] + size[None, :] - both)


def _linker(least: float):
    def linked(nodes: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
        _, first = np.unique(nodes, return_index=True)  # repeated rows
        nodes, sets = nodes[first], [sets[i] for i in first]
        close, left, out = close_pairs(sets, least), np.ones(len(nodes), bool), ([], [])
        while left.any():
            queue = [int(np.argmax(left))]
            left[queue[0]] = False
            while queue:
                i = queue.pop()
                for j in np.flatnonzero(close[i] & left).tolist():
                    left[j] = False
                    queue.append(j)
                    out[0].append(int(nodes[i]))
                    out[1].append(int(nodes[j]))
        return out

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets = None, [], []

        def done() -> pa.RecordBatch:
            a, b = linked(np.array(nodes, np.int64), sets)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for root, tile, node, held in zip(*(batch.column(i) for i in range(4)), strict=True):
                now = (root.as_py(), tile.as_py())
                if now != key and nodes:
                    yield done()
                    nodes, sets = [], []
                key = now
                nodes.append(node.as_py())
                sets.append(held.values.to_numpy())
        if nodes:
            yield done()

    return link


def _sized(df: DataFrame, bound: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= bound else df


def _stars(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of the links, the roots too."""
    stars = components(links)
    return materialize(stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()), "stars")


def _close_prints(distinct: DataFrame) -> DataFrame:
    """Links (a, b) from nodes to their fingerprint, and between close fingerprints, which are nodes too.

    A fingerprint that is alone and close to none has no link.
    """
    prints = materialize(distinct.groupBy("fp").agg(F.count("*").alias("n")), "prints")
    close = materialize(simhash.links(prints.select("fp"), DISTANCE), "close")
    ends = close.select(F.explode(F.array("a", "b")).alias("fp")).distinct().withColumn("linked", F.lit(True))
    met = prints.join(ends, "fp", "left").filter("linked OR n > 1").select("fp", "n")
    name = lambda c: F.xxhash64(F.lit("fingerprint"), c)
    nodes = joined_hot(distinct.select("node", "fp"), met, ["fp"], "n", distinct.count())
    return close.select(name("a").alias("a"), name("b").alias("b")).unionByName(nodes.select(F.col("node").alias("a"), name("fp").alias("b")))


def groups(docs: DataFrame, least: float = 0.8, tile: int = 256, broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id and component_id (the smallest doc_id of the group) of every row."""
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    rows = materialize(read.mapInArrow(_signed, "doc_id long, th long, node long, fp long, bands array<long>"), "signed")
    one = F.min(F.struct("doc_id", "th")).alias("one")
    distinct = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), one, F.first("fp").alias("fp"), F.first("bands").alias("bands")), "distinct")
    keyed = distinct.select("node", F.posexplode("bands").alias("c", "v"))
    shared = keyed.groupBy("c", "v").agg(F.min("node").alias("m"), F.max("node").alias("most")).filter("m <> most").drop("most")
    shared = materialize(shared, "shared")
    met = keyed.join(_sized(shared, broadcast_rows), ["c", "v"]).filter("node <> m").select(F.col("node").alias("a"), F.col("m").alias("b"))
    maybe = materialize(_stars(met.unionByName(_close_prints(distinct))).join(distinct.select("node", "one"), "node"), "maybe")

    sizes = maybe.groupBy("root").agg(F.ceil(F.count("*") / tile).alias("m"))
    wanted = maybe.join(_sized(sizes, broadcast_rows), "root")
    wanted = materialize(wanted.select("root", "m", "node", F.col("one.doc_id").alias("id"), F.col("one.th").alias("h")), "wanted")
    texts = read.join(_sized(wanted, broadcast_rows), (F.col("th") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("id"))).select("root", "m", "node", "text")
    sets = materialize(texts.mapInArrow(_with_sets, "root long, m long, node long, shingles array<long>"), "sets")
    whole = sets.filter("m = 1").select("root", F.lit(0).cast("long").alias("tile"), "node", "shingles")
    part = F.pmod(F.xxhash64("node", F.lit(7)), F.col("m"))
    more = sets.filter("m > 1").withColumn("r", part).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("s"))
    more = more.select("root", (F.least("r", "s") * F.col("m") + F.greatest("r", "s")).alias("tile"), "node", "shingles")
    dealt = whole.union(more).repartition("root", "tile").sortWithinPartitions("root", "tile")
    links = materialize(dealt.mapInArrow(_linker(least), "a long, b long").distinct(), "links")

    names = component_names(distinct.select("node", "least", "n"), components(links), "node")
    return joined_hot(rows.select("doc_id", "node"), names, ["node"], "n", rows.count()).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, least: float = 0.8, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One document of each group stays, as in simhash."""
    return keep_named(docs, groups(docs, least, broadcast_rows=broadcast_rows), broadcast_rows)
