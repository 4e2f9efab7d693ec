"""SimHash near-duplicates by pigeonhole blocks.

Fingerprint: A-Z lower-cased, words between white space, shingles of four words
with repeats, each hashed by XXH64 (seed 42); a bit is 1 if it is set in more
than half of the hashes. Texts of fewer words have one shingle; texts without
words have fingerprint zero, which links like any other.

Links: two fingerprints at ``distance`` or fewer differing bits. 64 bits are cut
into k blocks; of these at least k - distance agree for every close pair, so
pairs meet under one of the C(k, distance) combinations of blocks. k grows with
the number of distinct fingerprints, so that chance meetings stay below one in
four a row and key; the result is the same for every k. Candidates are verified
exactly. A key that very many fingerprints share is cut into tiles of bounded
size; tiles together compare every pair under the key. A tile returns the links
of a spanning forest, so dense groups cost no more rows than members.

Defined cases
    null text: no words; null doc_id: fingerprinted and linking, but never a
    component_id unless no document of the component has an id (then null);
    repeated rows: each returned; empty table: no rows; other columns ignored.

Scale: the text is read once and never shuffled; only distinct fingerprints are
keyed; components are found by distributed rounds (see graph).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docdelta.llm.exprs import joined_hot
from docdelta.llm.graph import components
from docdelta.plans.scratch import materialize

WIDTH, SEED = 4, 42


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The hash of every shingle, repeats included; a text of fewer words is one shingle, without words none."""
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    joined = b" ".join(words)
    if n <= width:
        return np.array([h(joined, SEED)] if n else [], np.dtype("<u8"))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    return np.fromiter((h(joined[a : b - 1], SEED) for a, b in zip(starts, ends[width - 1 :])), np.dtype("<u8"), n - width + 1)


def folded(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    return folded(shingles(text, width))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.dtype("<u8"), batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view("<i8"))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _blocks(k: int) -> list[tuple[int, int]]:
    cuts = [round(64 * i / k) for i in range(k + 1)]
    return list(zip(cuts, cuts[1:]))


def choose_blocks(n: int, distance: int) -> int:
    """Fewest blocks under which chance meetings are rarer than one in four a row and key."""
    for k in range(distance + 2, 33):
        least = sum(sorted(b - a for a, b in _blocks(k))[: k - distance])
        if n <= 2**least / 4 or comb(k + 1, distance) > 2000:
            return k
    return 33


def _keys(fp: Column, k: int, distance: int) -> Column:
    """All block combinations of a fingerprint, as hashes of (combination, kept bits)."""
    out = []
    for c, kept in enumerate(combinations(_blocks(k), k - distance)):
        mask = sum(((1 << b) - 1) ^ ((1 << a) - 1) for a, b in kept)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        out.append(F.struct(F.lit(c).alias("c"), fp.bitwiseAND(F.lit(mask).cast("long")).alias("bits")))
    return F.array(*out)


def _forest(fps: np.ndarray, groups: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest inside each run of equal group numbers."""
    n = len(fps)
    label = np.arange(n)
    begin = np.r_[0, np.flatnonzero(groups[1:] != groups[:-1]) + 1, n]
    last = np.repeat(begin[1:], np.diff(begin))
    rows = np.arange(n)

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    def flatten() -> None:
        """Every label at its root."""
        up = label[label]
        while not np.array_equal(up, label):
            label[:] = up
            up = label[label]

    step = 1
    while len(rows := rows[rows + step < last[rows]]):
        close = rows[np.bitwise_count(fps[rows] ^ fps[rows + step]) <= distance]
        close = close[label[close] != label[close + step]]
        for i in close.tolist():
            a, b = root(i), root(i + step)
            if a != b:
                label[max(a, b)] = min(a, b)
        if step % 16 == 0 or len(close):
            flatten()
        step += 1
    flatten()
    moved = np.flatnonzero(label != np.arange(n))
    return fps[moved], fps[label[moved]]


def _linker(distance: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            key = np.stack([held.column(i).to_numpy() for i in range(3)])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
            if not len(cut):
                continue
            ready, held = held.slice(0, cut[-1] + 1), held.slice(cut[-1] + 1)
            yield _linked(ready, key[:, : cut[-1] + 1], distance)
        if held is not None and held.num_rows:
            yield _linked(held, np.stack([held.column(i).to_numpy() for i in range(3)]), distance)

    return link


def _linked(table: pa.Table, key: np.ndarray, distance: int) -> pa.RecordBatch:
    groups = np.r_[0, np.cumsum((key[:, 1:] != key[:, :-1]).any(axis=0))]
    a, b = _forest(table.column(3).to_numpy().view(np.uint64), groups, distance)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def links(distinct: DataFrame, distance: int = 4, tile: int = 2048) -> DataFrame:
    """Links (a, b) between distinct fingerprints that connect whatever is close."""
    k = choose_blocks(distinct.count(), distance)
    keyed = distinct.select("fp", F.explode(_keys(F.col("fp"), k, distance)).alias("k")).select("k.c", "k.bits", "fp")
    keyed = keyed.select("*", F.count("*").over(Window.partitionBy("c", "bits")).alias("n")).filter("n > 1")
    keyed = materialize(keyed.select("c", "bits", F.ceil(F.col("n") / tile).alias("m"), "fp"), "keyed")
    once = keyed.filter("m = 1").select("c", "bits", F.lit(0).cast("long").alias("tile"), "fp")
    part = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("m"))
    more = keyed.filter("m > 1").select("c", "bits", "m", "fp", part.alias("r")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)).alias("s"))
    more = more.select("c", "bits", (F.least("r", "s") * F.col("m") + F.greatest("r", "s")).alias("tile"), "fp")
    dealt = once.union(more).repartition("c", "bits", "tile").sortWithinPartitions("c", "bits", "tile", "fp")
    return dealt.mapInArrow(_linker(distance), "a long, b long").distinct()


def groups(docs: DataFrame, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    rows = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    names = component_names(distinct, components(links(distinct.select("fp"), distance)), "fp")
    return joined_hot(rows, names, ["fp"], "n", rows.count()).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def component_names(distinct: DataFrame, stars: DataFrame, node: str) -> DataFrame:
    """node, n and component_id (the least ``least`` of the component) of every node of ``distinct`` (node, least, n).

    The join with the root is by broadcast for roots of very many nodes.
    """
    stars = stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", node)
    named = materialize(distinct.join(stars, node).select(node, "root", "least", "n"), "named")
    of_root = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("nodes"))
    linked = joined_hot(named, of_root, ["root"], "nodes", named.count()).select(node, "n", "component_id")
    alone = distinct.join(named.select(node), node, "left_anti").select(node, "n", F.col("least").alias("component_id"))
    return materialize(linked.unionByName(alone), "names")


def drop_near_duplicates(docs: DataFrame, distance: int = 4, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id.

    Of wholly equal rows one stays; rows without doc_id cannot be named as
    copies and stay.
    """
    return keep_named(docs, groups(docs, distance), broadcast_rows)


def keep_named(docs: DataFrame, grouped: DataFrame, broadcast_rows: int) -> DataFrame:
    """The documents that give their group (doc_id, component_id) its name."""
    by_id = grouped.filter(F.col("doc_id").isNotNull()).groupBy("doc_id")
    by_id = materialize(by_id.agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("n")), "verdicts")
    gone, repeated = by_id.filter("not stays").select("doc_id"), by_id.filter("n > 1").select("doc_id")
    sized = lambda ids: F.broadcast(ids) if ids.count() <= broadcast_rows else ids
    kept = docs.join(sized(gone), "doc_id", "left_anti")
    if repeated.take(1):
        some = sized(repeated)
        kept = kept.join(some, "doc_id", "left_anti").unionByName(kept.join(some, "doc_id", "left_semi").dropDuplicates())
    return kept.select(*docs.columns)
