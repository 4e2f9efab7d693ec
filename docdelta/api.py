"""What a caller reads and registers, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docdelta.operators import jobs as _jobs
from docdelta.operators.pages import documents
from docdelta.operators.results import legacy_verdict
from docdelta.plans.compare import Comparison, compare, compare_texts

__all__ = ["Comparison", "compare", "compare_texts", "documents", "job", "list_jobs", "pages_of", "progress", "register", "result"]


def job(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.filter(F.col("job_id") == job_id)


def list_jobs(jobs: DataFrame, user_id: str | None = None) -> DataFrame:
    return _jobs.jobs_of(jobs, user_id)


def register(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Registrations as messages of the job log; the owner is mandatory."""
    owned = requests.withColumn("user_id", F.when(F.col("user_id").isNull(), F.raise_error(F.lit("user_id is required"))).otherwise(F.col("user_id")))
    return log.unionByName(owned.withColumn("status", F.lit("queued")), allowMissingColumns=True)


def pages_of(pages: DataFrame, job_id: str, side: int | None = None) -> DataFrame:
    """Stored pages in order, of one side or both."""
    rows = pages.filter(F.col("job_id") == job_id)
    return (rows if side is None else rows.filter(F.col("side") == side)).orderBy("page_number", "side")


def progress(jobs: DataFrame) -> DataFrame:
    return jobs.select("job_id", "status", F.concat_ws("/", F.col("processed_chunks").cast("string"), F.col("total_chunks").cast("string")).alias("progress"))


def result(results: DataFrame, job_id: str) -> DataFrame:
    """The newest result of a job, with a verdict whatever its age."""
    return legacy_verdict(_jobs.latest_result(results.filter(F.col("job_id") == job_id)))
