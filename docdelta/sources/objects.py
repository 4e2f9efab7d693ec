"""Object payloads on any store that Spark reads: A11, B32."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_objects(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """object_key, content, size_bytes and sha256 of all objects below a root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    key = F.substring_index("path", root.split("://")[-1].rstrip("/") + "/", -1)
    return files.select(key.alias("object_key"), "content", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


class ObjectStore:
    """Single objects by key, through the Hadoop file system of the root; for the driver only."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, key: str):
        if not key or key.startswith("/") or ".." in key.split("/"):
            raise ValueError(f"key leaves the store: {key!r}")
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")

    def put(self, key: str, data: bytes, limit: int = 64 << 20) -> int:
        if len(data) > limit:
            raise ValueError("object is too large")
        out = self.fs.create(self._path(key), True)
        out.write(bytearray(data))
        out.close()
        return len(data)

    def exists(self, key: str) -> bool:
        return self.fs.exists(self._path(key))

    def delete(self, key: str) -> bool:
        return self.fs.delete(self._path(key), False)

    def delete_prefix(self, prefix: str) -> bool:
        return self.fs.delete(self._path(prefix.rstrip("/")), True)
