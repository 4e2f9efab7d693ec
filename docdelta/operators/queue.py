"""Inbox, outbox, work items, dead letters and object metadata: B21-B33, F9-F11."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F


def inbox_new(events: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Events not seen by their consumer group, the first of repeats."""
    keys = ["consumer_group", "event_id"]
    first = Window.partitionBy(*keys).orderBy("received_at")
    rows = events.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
    return rows if ledger is None else rows.join(ledger.select(*keys).distinct(), keys, "left_anti")


def create_items(items: DataFrame, existing: DataFrame) -> DataFrame:
    """First write wins by task_id."""
    fresh = items.withColumn("_rn", F.row_number().over(Window.partitionBy("task_id").orderBy("created_at"))).filter("_rn = 1").drop("_rn")
    return existing.unionByName(fresh.join(existing.select("task_id"), "task_id", "left_anti"))


def leasable(items: DataFrame, as_of: Column) -> DataFrame:
    """Items that may be leased at ``as_of``."""
    expired = (F.col("status") == "leased") & (F.col("lease_expires_at") < as_of)
    return items.filter((F.col("available_at") <= as_of) & ((F.col("status") == "pending") | expired))


def lease_next(items: DataFrame, as_of: Column, worker: str, seconds: int = 900) -> DataFrame:
    """The oldest leasable item of each stage, leased."""
    oldest = Window.partitionBy("stage").orderBy("available_at", "task_id")
    rows = leasable(items, as_of).withColumn("_rn", F.row_number().over(oldest)).filter("_rn = 1").drop("_rn")
    return rows.withColumns({
        "status": F.lit("leased"), "lease_owner": F.lit(worker), "lease_expires_at": as_of + F.make_interval(secs=F.lit(seconds)),
        "attempt": F.col("attempt") + 1, "lease_epoch": F.col("lease_epoch") + 1,
    })


def complete(items: DataFrame, done: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Completion fenced by token and epoch; also the attempt rows of those that passed."""
    d = done.select("task_id", F.col("lease_token").alias("t"), F.col("lease_epoch").alias("e"), F.lit(True).alias("asked"))
    j = items.join(d, "task_id", "left")
    ok = F.coalesce(F.col("asked") & (F.col("t") == F.col("lease_token")) & (F.col("e") == F.col("lease_epoch")), F.lit(False))
    j = j.withColumn("passed", ok)
    attempts = j.filter("passed").select("task_id", "attempt", F.col("lease_owner").alias("worker"), at.alias("finished_at"), F.lit("completed").alias("outcome"))
    return j.select(*(F.when(F.col("passed"), "completed").otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in items.columns)), attempts


def backoff(attempt: Column) -> Column:
    """Seconds until the next attempt."""
    return F.least(F.lit(60.0), F.pow(F.lit(2.0), attempt)).cast("long")


def retry(items: DataFrame, as_of: Column, max_attempts: int = 8) -> DataFrame:
    """Failed for good after the last attempt, else pending after a delay."""
    over = F.col("attempt") >= max_attempts
    return items.withColumns({
        "status": F.when(over, "failed").otherwise("pending"),
        "available_at": F.when(over, F.col("available_at")).otherwise(F.timestamp_seconds(F.unix_timestamp(as_of.cast("timestamp")) + backoff(F.col("attempt")))),
    })


def outbox_due(outbox: DataFrame, as_of: Column, limit: int = 20, timeout: int = 30) -> DataFrame:
    """The oldest unpublished rows without a living claim."""
    stale = F.col("claimed_at").isNull() | (F.col("claimed_at") < as_of - F.make_interval(secs=F.lit(timeout)))
    return outbox.filter(F.col("published_at").isNull() & stale).orderBy("created_at", "event_id").limit(limit)


def enqueued(outbox: DataFrame, messages: DataFrame) -> DataFrame:
    """The outbox with new messages (job_id, topic, message_key, payload, created_at); ids follow from what is sent."""
    id_ = F.sha2(F.concat_ws("|", "job_id", "topic", "message_key", "payload", F.col("created_at").cast("string")).cast("binary"), 256)
    return outbox.unionByName(messages.withColumn("event_id", id_).withColumn("publish_attempts", F.lit(0)), allowMissingColumns=True)


def outbox_claimed(outbox: DataFrame, as_of: Column, limit: int = 20, timeout: int = 30) -> DataFrame:
    """The outbox after a claim; ``claimed`` marks the rows that were due, at most ``limit``.

    Attempts are counted once, when their outcome is marked.
    """
    due = outbox_due(outbox, as_of, limit, timeout).select("event_id", F.lit(True).alias("claimed"))
    j = outbox.join(F.broadcast(due), "event_id", "left").withColumn("claimed", F.coalesce("claimed", F.lit(False)))
    return j.select(*(F.when(F.col("claimed"), as_of).otherwise(F.col(c)).alias(c) if c == "claimed_at" else F.col(c) for c in outbox.columns), "claimed")


def relayed(outbox: DataFrame, publish: Callable[[Row], None], as_of: Column, limit: int = 20) -> DataFrame:
    """One round of the relay: due rows (at most ``limit``) are claimed, published one by one and marked."""
    spark, kind = outbox.sparkSession, dict(outbox.dtypes)["event_id"]
    after = outbox_claimed(outbox, as_of, limit)
    said = []
    for row in after.filter("claimed").orderBy("created_at", "event_id").limit(limit).collect():
        try:
            publish(row)
            said.append((row["event_id"], None))
        except Exception as e:  # any failure is noted and the row stays due
            said.append((row["event_id"], str(e)))
    return outbox_marked(after.drop("claimed"), spark.createDataFrame(said, f"event_id {kind}, error string"), as_of)


def outbox_marked(outbox: DataFrame, results: DataFrame, at: Column) -> DataFrame:
    """Published, or one more failed attempt with its error cut to 1000."""
    j = outbox.join(results.select("event_id", F.col("error").alias("e"), F.lit(True).alias("tried")), "event_id", "left")
    sent = F.coalesce(F.col("tried") & F.col("e").isNull(), F.lit(False))
    lost = F.coalesce(F.col("tried") & F.col("e").isNotNull(), F.lit(False))
    out = {"published_at": F.when(sent, at).otherwise(F.col("published_at")), "last_error": F.when(lost, F.substring("e", 1, 1000)).when(~sent, F.col("last_error")), "publish_attempts": F.col("publish_attempts") + F.coalesce(F.col("tried").cast("int"), F.lit(0)), "claimed_at": F.when(~lost, F.col("claimed_at"))}
    return j.select(*(out[c].alias(c) if c in out else F.col(c) for c in outbox.columns))


def outbox_lag(outbox: DataFrame, as_of: Column) -> DataFrame:
    """age in seconds of the oldest unpublished row; 0 without one."""
    oldest = F.min(F.when(F.col("published_at").isNull(), F.col("created_at")))
    return outbox.agg(F.coalesce(F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(oldest.cast("timestamp")), F.lit(0)).cast("long").alias("lag_seconds"))


def dead_letter(messages: DataFrame, error: Column) -> DataFrame:
    """The message without bodies, their lengths kept, the error cut to 500."""
    def bare(n: int) -> Column:
        f = F.col(f"file{n}")
        shape = F.struct(f["filename"].alias("filename"), f["format"].alias("format"), f["content_type"].alias("content_type"), F.lit("[omitted]").alias("content"), F.length(f["content"]).alias("content_chars"))
        return F.when(f.isNotNull(), shape).alias(f"file{n}")

    keep = [c for c in messages.columns if c not in ("file1", "file2")]
    return messages.select(*keep, bare(1), bare(2), F.substring(error, 1, 500).alias("error"))


def object_meta(objects: DataFrame, content: str = "content") -> DataFrame:
    """Digest and size of payloads."""
    return objects.withColumns({"sha256": F.sha2(F.col(content), 256), "size_bytes": F.octet_length(content).cast("long")})


def safe_key(key: Column) -> Column:
    """Whether an object key stays below its root."""
    return ~key.startswith("/") & ~key.rlike(r"(^|/)\.\.(/|$)") & (key != "")


def discard_images(assets: DataFrame, pages: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assets without the discarded images; pages without keys to them."""
    gone = keys.select("object_key").distinct()
    kept = assets.join(gone, "object_key", "left_anti")
    marked = pages.join(gone.withColumn("gone", F.lit(True)), "object_key", "left")
    return kept, marked.select(*(F.when(F.col("gone").isNull(), F.col(c)).alias(c) if c == "object_key" else F.col(c) for c in pages.columns))


def envelope(rows: DataFrame, pipeline: str = "v2") -> DataFrame:
    """command envelopes; the causing event defaults to the event itself."""
    return rows.select(
        "event_id", "job_id", F.coalesce("attempt", F.lit(1)).alias("attempt"), F.lit(pipeline).alias("pipeline_version"),
        F.coalesce("causation_id", "event_id").alias("causation_id"), F.coalesce("correlation_id", "job_id").alias("correlation_id"), "payload",
    )
