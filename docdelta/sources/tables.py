"""Parquet table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; the path may be on any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def widened(table: DataFrame) -> DataFrame:
    """A scanned table for heavy work on its texts: dealt over all cores where the scan has fewer splits than there are.

    A large table has more splits than cores and is left alone.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    splits = table._jdf.queryExecution().toRdd().getNumPartitions()
    return table.repartition(cores) if splits < cores else table
