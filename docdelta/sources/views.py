"""The engine's inputs as views over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docdelta.plans.compare import with_page_defaults
from docdelta.sources.tables import read_table

#: Documents with the same first characters are versions of one another.
VERSION_KEY = 40


def doc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """job_id, text1, text2: every document against the first of its versions."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("k", F.substring("text", 1, VERSION_KEY))
    base = docs.groupBy("k").agg(F.min("doc_id").alias("base"))
    later = docs.join(base, "k").filter("doc_id <> base").select(F.col("doc_id").cast("string").alias("job_id"), "base", F.col("text").alias("text2"))
    first = docs.select(F.col("doc_id").alias("base"), F.col("text").alias("text1"))
    return later.join(first, "base").select("job_id", "text1", "text2")


def doc_pages(pairs: DataFrame, lines_per_page: int = 5) -> DataFrame:
    """The pairs as pages of a few lines each."""
    side = lambda n: F.struct(F.lit(n).alias("side"), F.split(f"text{n}", "\n", -1).alias("lines"))
    rows = pairs.select("job_id", F.inline(F.array(side(1), side(2))))
    starts = F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / lines_per_page).cast("int"))
    rows = rows.select("job_id", "side", "lines", F.explode(starts).alias("p"))
    text = F.array_join(F.slice("lines", F.col("p") * lines_per_page + 1, lines_per_page), "\n")
    return with_page_defaults(rows.select("job_id", "side", (F.col("p") + 1).alias("page_number"), text.alias("text")))


def conv_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as page sides: even turns are side 1, odd ones side 2."""
    rows = read_table(spark, sf_dir, "conversations")
    return rows.select(
        F.col("conv_id").cast("string").alias("job_id"), (F.floor(F.col("turn") / 2) + 1).cast("int").alias("page_number"),
        (F.col("turn") % 2 + 1).cast("short").alias("side"), "text", F.col("turn").alias("turn"),
    )


def conv_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as page-pair messages, for the streams."""
    c = conv_chunks(spark, sf_dir)
    by = c.groupBy("job_id", "page_number").agg(*(F.max(F.when(F.col("side") == s, F.col("text"))).alias(f"t{s}") for s in (1, 2)))
    total = c.groupBy("job_id").agg(F.max("page_number").alias("total_chunks"))
    file = lambda s: F.when(F.col(f"t{s}").isNotNull(), F.struct(F.lit(f"f{s}.docx").alias("filename"), F.lit("docx").alias("format"), F.lit("text").alias("content_type"), F.col(f"t{s}").alias("content"))).alias(f"file{s}")
    return by.join(total, "job_id").select("job_id", F.col("job_id").alias("document_id"), F.col("page_number").alias("chunk_index"), "total_chunks", file(1), file(2))


STATUS_OF = {"signup": "queued", "view": "preparing", "click": "processing", "purchase": "ocr_ready", "error": "failed"}


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as status messages of one job per user."""
    e = read_table(spark, sf_dir, "events")
    status = F.element_at(F.create_map(*(F.lit(x) for kv in STATUS_OF.items() for x in kv)), F.col("event_type"))
    return e.select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), "ts", status.alias("status"),
        (F.col("event_id") % 7).cast("int").alias("total_chunks"), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("message"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("a"), F.col("event_id").cast("string"))).otherwise("").alias("file1_name"), F.lit("").alias("file2_name"), F.col("ts").alias("created_at"),
    )


def outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as outbox rows; purchases are published, every fifth row is claimed."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("user_id").cast("string").alias("job_id"), "event_type", F.col("ts").alias("created_at"),
        F.when(F.col("event_type") == "purchase", F.col("ts")).alias("published_at"), F.when(F.col("event_id") % 5 == 0, F.col("ts")).alias("claimed_at"),
    )


def work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as work items, one stage per event type."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("task_id"), F.col("event_type").alias("stage"), F.when(F.col("event_id") % 4 == 0, "leased").when(F.col("event_id") % 11 == 0, "completed").otherwise("pending").alias("status"),
        F.col("ts").alias("available_at"), F.col("ts").alias("created_at"), F.col("ts").alias("lease_expires_at"), F.lit(None).cast("string").alias("lease_owner"),
        (F.col("event_id") % 9).cast("int").alias("attempt"), F.lit(0).alias("lease_epoch"),
    )


def jobs_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs: the customer owns them, lines are chunks."""
    o = read_table(spark, sf_dir, "orders")
    lines = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.countDistinct("l_linenumber").cast("int").alias("processed_chunks"))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "comparing").otherwise("ocr_ready")
    return o.join(lines, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("user_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"),
        F.lit(4).alias("total_chunks"), F.coalesce("processed_chunks", F.lit(0)).alias("processed_chunks"), (F.col("o_orderkey") % 5 == 0).alias("comparison_claimed"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("w1")).when(F.col("o_orderkey") % 3 == 1, F.lit("w2")).alias("lease_owner"), F.col("o_orderdate").alias("lease_expires_at"),
    )
