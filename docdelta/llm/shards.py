"""Sharding by sampled splitters (native).

A size-weighted sample of the keys gives quantile boundaries; records are
range-partitioned by them; ranges that turn out overfull are sampled again and
subdivided. Exact byte sums of the ranges then place every record on the byte
axis, and a shard is an equal part of that axis. Law: ``bytes``.

The key is (doc_id, hash of the row, row number of one written pass), so equal
doc_ids and even wholly equal rows can be cut apart and a hot key never stays in
one range. Null doc_ids sort first; a null text has no bytes; an empty table
gives no rows; other columns only enter the row hash.

Scale: the text is read once (sizes and checksums). Everything after that runs
on about 40 bytes a row. Only the sample, at most ``ranges * oversample`` rows
in expectation whatever the input, and one row per range reach the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docdelta.plans.scratch import materialize

_KEY = ("key", "tie", "rid")


def _listed(value: list, kind: str) -> Column:
    """A constant array, parsed once while planning."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _at_or_below(bounds: list[tuple], key: Column) -> Column:
    """How many of the sorted bounds are at or below the key, in two short scans."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    named = [dict(zip(_KEY, b, strict=True)) for b in bounds]
    blocks = [named[i : i + step] for i in range(0, len(named), step)]
    kind = "array<struct<key:bigint,tie:bigint,rid:bigint>>"
    coarse = F.size(F.filter(_listed([b[0] for b in blocks[1:]], kind), lambda b: b <= key))
    fine = F.element_at(_listed(blocks, f"array<{kind}>"), coarse + 1)
    return coarse * step + F.size(F.filter(fine, lambda b: b <= key))


def _quantiles(sample: list[tuple[tuple, float]], parts: int) -> list[tuple]:
    """Boundaries that cut the weighted sample into equal parts."""
    sample = sorted(sample, key=lambda s: tuple((v is not None, v or 0) for v in s[0]))
    total, seen, out = sum(w for _, w in sample), 0.0, []
    for key, weight in sample:
        if out and len(out) >= parts - 1:
            break
        if seen >= total * (len(out) + 1) / parts and key not in out[-1:]:
            out.append(key)
        seen += weight
    return out


def _draw(rows: DataFrame, total: int, expected: int, seed: int) -> list[tuple[tuple, float]]:
    """Each record with probability size * expected / total; its weight makes up for that."""
    share = total / expected
    chance = (F.xxhash64(*_KEY, F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1))) / float(1 << 53)
    got = rows.filter(chance * share < F.col("size")).select(*_KEY, "size").collect()
    return [((r["key"], r["tie"], r["rid"]), max(float(r["size"]), share)) for r in got]


def assign(
    docs: DataFrame, shards: int = 24, ranges_per_shard: int = 32, oversample: int = 8, rounds: int = 6, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """key, size, text_crc32, shard and slot of every record."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = materialize(
        docs.select(
            F.col(key).cast("bigint").alias("key"),
            F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)).alias("tie"),
            F.monotonically_increasing_id().alias("rid"),
            (F.octet_length(body) + 8).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
        ),
        "sizes",
    )
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    parts = shards * ranges_per_shard
    at = F.struct(*_KEY)
    bounds = _quantiles(_draw(rows, total, parts * oversample, 0), parts) if n else []
    sums: dict[int, tuple[int, int]] = {}
    for turn in range(rounds):
        where = _at_or_below(bounds, at)
        sums = {r["range"]: (r["bytes"], r["n"]) for r in rows.groupBy(where.alias("range")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()}
        over = [k for k, (size, count) in sums.items() if size > 2 * total / parts and count > 1]
        if not over or turn == rounds - 1:
            break
        size = sum(sums[k][0] for k in over)
        again = _draw(rows.filter(where.isin(over)), size, max(64, round(2 * oversample * size * parts / total)), turn + 1)
        in_range: dict[int, list] = {k: [] for k in over}
        low = sorted(bounds, key=_order)
        for k, w in again:
            i = _bisect(low, k)
            if i in in_range:
                in_range[i].append((k, w))
        fresh = [b for k in over for b in _quantiles(in_range[k], 1 + max(1, round(2 * sums[k][0] * parts / total)))]
        if not set(fresh) - set(bounds):
            break
        bounds = sorted(set(bounds) | set(fresh), key=_order)
    last = max(sums, default=0)
    offsets, starts, b, c = [], [], 0, 0
    for k in range(last + 1):
        offsets.append(b)
        starts.append(c)
        b, c = b + sums.get(k, (0, 0))[0], c + sums.get(k, (0, 0))[1]
    of = lambda xs, i: F.element_at(_listed(xs, "array<bigint>"), i + 1)
    ranged = rows.withColumn("range", _at_or_below(bounds, at))
    order = Window.partitionBy("range").orderBy(*_KEY)
    placed = ranged.select(
        "*",
        (of(offsets, F.col("range")) + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("upto"),
        (of(starts, F.col("range")) + F.row_number().over(order) - 1).alias("idx"),
    )
    middle = (2 * F.col("upto") - F.col("size")) * shards
    placed = materialize(
        placed.select(F.col("key").alias(key), "size", "text_crc32", F.least(F.lit(shards - 1), F.floor(middle / F.lit(2 * max(total, 1)))).cast("int").alias("shard"), "idx", "range"),
        "placed",
    )
    first = {r["shard"]: r["i"] for r in placed.groupBy("shard").agg(F.min("idx").alias("i")).collect()}
    return placed.select(key, "size", "text_crc32", "shard", (F.col("idx") - of([first.get(s, 0) for s in range(shards)], F.col("shard"))).alias("slot"), "range")


def _order(key: tuple) -> tuple:
    return tuple((v is not None, v or 0) for v in key)


def _bisect(bounds: list[tuple], key: tuple) -> int:
    from bisect import bisect_right

    return bisect_right([_order(b) for b in bounds], _order(key))
