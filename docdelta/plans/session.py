"""Session settings used by the bench, the tests and interactive runs."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(name: str = "docdelta", cpus: str = "8", memory: str = "12g") -> SparkSession:
    """A local session; on a cluster these come from spark-submit, the package by ``--py-files`` or an installation."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if root not in path:  # the workers import the package whatever folder this runs in
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, path)])
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
