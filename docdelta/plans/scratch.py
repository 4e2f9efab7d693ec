"""Intermediate tables in the folder that the whole cluster shares.

Lineage is cut by writing Parquet to ``spark.checkpoint.dir`` and reading it
back, so that a lost executor costs one re-read and never a recomputation.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of this session; a temporary one only where none is set and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("docdelta.scratch.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="docdelta-")
        spark.conf.set("docdelta.scratch.dir", root)
        _made.append((spark, root))
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver ends."""
    path = f"{scratch_root(spark)}/docdelta/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write the rows once and go on from the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(table: DataFrame, rows_per_task: int, *keys: str) -> DataFrame:
    """The rows dealt by keys over as many tasks as their number asks for.

    For work whose cost is the processor's and not the bytes': adaptive execution
    would join small partitions into one task. ``table`` should be a written one,
    as its rows are counted.
    """
    least = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return table.repartition(max(least, min(100_000, -(-table.count() // rows_per_task))), *keys)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path; a path that is already gone is no error."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _sweep() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the session may have ended before the interpreter
            pass


atexit.register(_sweep)
