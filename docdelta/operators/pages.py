"""Page store semantics: A8, A9, A12-A14, B3, D1, D2, F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docdelta.schemas import PAGES


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Last write wins: the row with the greatest order per key."""
    w = Window.partitionBy(*keys).orderBy(*(o.desc() for o in order))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def sides(chunks: DataFrame) -> DataFrame:
    """A page-pair message as one row per side; a missing side leaves a placeholder."""
    def side(n: int) -> Column:
        file = F.col(f"file{n}")
        kind = file["content_type"]
        return F.struct(
            F.lit(n).cast("short").alias("side"), F.coalesce(file["content"], F.lit("")).alias("text"), F.coalesce(file["filename"], F.lit("")).alias("filename"),
            F.when(file.isNull(), "missing").otherwise(F.coalesce(kind, F.lit("text"))).alias("source_content_type"),
            F.coalesce(kind == "image", F.lit(False)).alias("was_ocr"), file.isNull().alias("is_missing"),
        )

    keep = [c for c in chunks.columns if c not in ("file1", "file2")]
    rows = chunks.select(*keep, F.inline(F.array(side(1), side(2))))
    return rows.withColumnRenamed("chunk_index", "page_number")


def stored(side_rows: DataFrame, ingest_order: str) -> DataFrame:
    """Pages after all writes; the key is (job, page, side)."""
    rows = latest(side_rows, ["job_id", "page_number", "side"], F.col(ingest_order))
    return rows.select(*(c.split()[0] for c in PAGES.split(", ")))


def stored_chunks(pages: DataFrame) -> DataFrame:
    """Chunks of which both sides are stored, by job."""
    both = pages.groupBy("job_id", "page_number").agg(F.countDistinct("side").alias("n")).filter("n = 2")
    return both.groupBy("job_id").agg(F.count("*").alias("stored_chunks"))


def ready(jobs: DataFrame) -> DataFrame:
    """Jobs whose comparison can start, oldest first."""
    return jobs.filter((F.col("status") == "ocr_ready") & ~F.col("comparison_claimed") & (F.col("total_chunks") > 0) & (F.col("processed_chunks") >= F.col("total_chunks"))).orderBy("created_at", "job_id")


def documents(pages: DataFrame) -> DataFrame:
    """Assembled documents; missing pages are left out."""
    rows = F.array_sort(F.collect_list(F.struct("page_number", "filename", "text", "is_missing")))
    by = pages.groupBy("job_id", "side").agg(rows.alias("p"))
    name = F.get(F.filter(F.transform("p", lambda x: x["filename"]), lambda n: n != ""), F.lit(0))
    there = F.filter("p", lambda x: ~x["is_missing"])
    texts = F.filter(F.transform(there, lambda x: x["text"]), lambda t: t != "")
    return by.select(
        "job_id", "side", F.coalesce(name, F.concat(F.lit("file"), F.col("side").cast("string"))).alias("filename"),
        F.size(there).alias("n_pages"), F.array_join(texts, "\n\n").alias("text"),
    )


def not_terminal(chunks: DataFrame, jobs: DataFrame) -> DataFrame:
    """messages of terminal or cancelled jobs are skipped."""
    done = F.col("status").isin("completed", "failed", "cancelled", "deleting", "deleted")
    asked = F.col("cancel_requested_at").isNotNull() if "cancel_requested_at" in jobs.columns else F.lit(False)
    return chunks.join(jobs.filter(done | asked).select("job_id"), "job_id", "left_anti")


def not_stored(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """messages whose both sides are stored already are skipped."""
    both = pages.groupBy("job_id", F.col("page_number").alias("chunk_index")).agg(F.countDistinct("side").alias("n")).filter("n = 2").drop("n")
    return chunks.join(both, ["job_id", "chunk_index"], "left_anti")


def unwrapped(commands: DataFrame) -> DataFrame:
    """The payload of an envelope, nested or flat, with its defaults."""
    flat = lambda n: F.coalesce(F.col(f"payload.{n}"), F.col(n))
    job = flat("job_id")
    return commands.select(
        job.alias("job_id"), F.coalesce(flat("document_id"), job).alias("document_id"), F.coalesce(flat("chunk_index"), F.lit(1)).alias("chunk_index"),
        F.coalesce(flat("total_chunks"), F.lit(1)).alias("total_chunks"), flat("file1").alias("file1"), flat("file2").alias("file2"),
    )


def resolved(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """Object references with their content: text decoded, anything else in base64.

    ``refs``: object_key, content, content_type, format, filename. ``objects``:
    object_key and content (binary). Inline content wins without a key; a key may
    also stand in a column ``key``; only text/* is text behind a key.
    """
    refs = refs.withColumn("object_key", F.coalesce("object_key", "key")).drop("key") if "key" in refs.columns else refs
    found = refs.join(objects.withColumnRenamed("content", "bytes"), "object_key", "left")
    kind = F.coalesce("content_type", F.lit("image/png"))
    keyed = F.col("object_key").isNotNull()
    is_text = kind.startswith("text/") | (~keyed & (kind == "text"))
    return found.select(
        "object_key", F.when(keyed, F.when(is_text, F.decode("bytes", "UTF-8")).otherwise(F.base64("bytes"))).otherwise(F.col("content")).alias("content"),
        F.when(is_text, "text").otherwise("image").alias("content_type"),
        F.coalesce("format", F.when(F.contains(kind, F.lit("png")), "pdf").otherwise("docx")).alias("format"),
        F.coalesce("filename", F.substring_index("object_key", "/", -1)).alias("filename"),
    )


def image_keys(commands: DataFrame) -> DataFrame:
    """Object keys of the references that are no text."""
    refs = F.filter(F.array("file1", "file2"), lambda r: r["object_key"].isNotNull() & ~F.coalesce(r["content_type"], F.lit("image/png")).startswith("text/"))
    return commands.select("*", F.transform(refs, lambda r: r["object_key"]).alias("image_keys"))
