"""Plan helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are computed once a row.

    Projections may be merged, and what a lambda refers to is then computed anew
    for every element. A one-row generator keeps them apart and stays in the
    same stage of generated code.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, inside one expression."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def joined_hot(big: DataFrame, small: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """Inner join with a table of one row a key that says how many rows of ``big`` have the key (``count``).

    Keys of very many rows are joined by broadcast, so none of them gathers in one
    task: as their counts add up to ``total`` at most, there are at most 10,000 of
    them. All other keys shuffle. A total of 10,000 or fewer needs no such care: no
    task can get more rows than that.
    """
    if total <= 10_000:
        return big.join(small.drop(count), on)
    limit = max(200, total // 10_000)
    hot, cold = (small.filter(test).drop(count) for test in (F.col(count) > limit, F.col(count) <= limit))
    rest = big.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return big.join(F.broadcast(hot), on).unionByName(rest.join(cold, on))
