"""Result merge and legacy verdicts: E16-E18."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def legacy_verdict(results: DataFrame) -> DataFrame:
    """A missing verdict is identical only if flagged so and without differences."""
    derived = F.when(F.col("identical") & (F.coalesce(F.size("differences"), F.lit(0)) <= 0), "identical").otherwise("different")
    return results.withColumn("verdict", F.coalesce("verdict", derived))


def merge_fragments(fragments: DataFrame) -> DataFrame:
    """One result per job of which all chunks have come.

    ``fragments``: job_id, chunk_index, total_chunks, identical, verdict,
    differences; repeated chunks count once (the first received).
    """
    once = fragments.groupBy("job_id", "chunk_index").agg(F.min_by(F.struct("identical", "verdict", "differences"), "received_at").alias("f"), F.max("total_chunks").alias("total_chunks"))
    by = once.groupBy("job_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", F.col("f.differences").alias("d")))).alias("d"), F.bool_and(F.coalesce("f.identical", F.lit(False))).alias("same"),
        F.bool_or(F.coalesce("f.verdict", F.lit("different")) == "different").alias("different"), F.bool_or(F.col("f.verdict") == "content_equal").alias("equal"),
        F.count("*").alias("n"), F.max("total_chunks").alias("total_chunks"),
    )
    by = by.filter("n >= total_chunks").withColumn("differences", F.flatten(F.filter(F.transform("d", lambda x: x["d"]), lambda x: x.isNotNull())))
    identical = F.col("same") & (F.size("differences") == 0)
    verdict = F.when(identical, "identical").when(F.col("different"), "different").when(F.col("equal"), "content_equal").otherwise("different")
    return by.select("job_id", identical.alias("identical"), verdict.alias("verdict"), "differences", F.col("n").alias("n_fragments"))
