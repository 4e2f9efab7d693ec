"""Bounded samples of labelled documents for fitting a model.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0.
Of each class the rows with the smallest hash of their id are taken, at most
``per_class``; that bound is the only thing about a fit that does not grow with
the input. Repeated labels of a document: the larger one counts; repeated rows
of a document: the text of the smallest hash counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """True where the document's label must not be learned; a null id is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """doc_id, y and text of at most 2 * per_class documents."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col(label)).cast("int").alias("y"))
    drawn = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    drawn = drawn[0].unionByName(drawn[1])
    # At most 2 * per_class rows, whatever the input.
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"), F.min_by("text", F.xxhash64("text")).alias("text"))
