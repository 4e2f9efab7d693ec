"""Structured Streaming: A1-A4, B4, B29-B31, E17, F1-F6.

A bus topic is any streaming source; files stand in where no broker connector
is at hand. State is keyed by job and never dropped by time, as in the batch
semantics. Sinks are idempotent by batch id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docdelta.operators import pages, queue, results
from docdelta.plans.scratch import scratch_path
from docdelta.schemas import PAGES, RAW_CHUNK, STATUS


def topic(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", per_trigger: int = 1000, **options: str) -> DataFrame:
    """A topic as a stream; with fmt="kafka" pass the broker options instead of a path."""
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        return reader.options(startingOffsets="earliest", **options).load()
    return reader.schema(schema).option("maxFilesPerTrigger", per_trigger).options(**options).load(path)


def parsed(raw: DataFrame, schema: str = RAW_CHUNK, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON messages split into valid ones and ones for the dead-letter topic."""
    body = raw.select(F.col(value).cast("string").alias("raw")).select("raw", F.from_json("raw", schema).alias("m"))
    valid = F.col("m.job_id").isNotNull() & (F.col("m.chunk_index") >= 1)
    good = body.filter(F.coalesce(valid, F.lit(False))).select("m.*")
    bad = body.filter(~F.coalesce(valid, F.lit(False))).select(F.lit("[omitted]").alias("content"), F.length("raw").alias("content_chars"), F.lit("invalid message").alias("error"))
    return good, bad


def statuses(raw: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """status messages to push on, and invalid ones; every field but the time is needed."""
    body = raw.select(F.col(value).cast("string").alias("raw")).select("raw", F.from_json("raw", STATUS).alias("m"))
    fields = [c.split()[0] for c in STATUS.split(", ") if not c.startswith("updated_at")]
    valid = F.coalesce(F.forall(F.array(*(F.col(f"m.{c}").isNotNull() for c in fields)), lambda ok: ok), F.lit(False))
    return body.filter(valid).select("m.*"), body.filter(~valid).select("raw")


def handled(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str):
    """A2, A4: a handler per micro-batch; offsets move only after it, so a failed batch is given again at the next start."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handler).start()


def commands(stages: dict[str, DataFrame]) -> DataFrame:
    """A4: the command streams of all stages as one, each event once for its stage (the inbox)."""
    named = [df.withColumn("consumer_group", F.lit(stage)) for stage, df in stages.items()]
    every = named[0]
    for df in named[1:]:
        every = every.unionByName(df, allowMissingColumns=True)
    return every.dropDuplicates(["consumer_group", "event_id"])


def keyed(rows: DataFrame, key: str = "job_id") -> DataFrame:
    """Rows as bus messages: key and JSON value. A broker sink takes them as they are, with acks=all and idempotence set there."""
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value"))


def ingest(messages: DataFrame, page_path: str, dlt_path: str, checkpoint: str, jobs: Callable[[], DataFrame] | None = None, ocr: Callable[[DataFrame], DataFrame] | None = None, ready_path: str | None = None):
    """Page pairs to the page table, one idempotent folder per micro-batch.

    ``ocr`` turns image messages into text; messages whose content stays null
    go to the dead-letter folder. ``jobs`` gives the job table for skipping. With
    ``ready_path``, the stored chunks of the jobs of a batch are written there after
    its pages, as what jobs.after_pages takes; pairs that earlier batches
    stored are skipped and counted all the same.
    """

    def signal(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        total = batch.groupBy("job_id").agg(F.max("total_chunks").alias("message_total"))
        store = spark.read.option("mergeSchema", "false").parquet(f"{page_path}/batch=*")
        counts = pages.stored_chunks(store.join(total.select("job_id"), "job_id", "left_semi"))
        done = total.join(counts, "job_id", "left").select("job_id", F.coalesce("stored_chunks", F.lit(0)).alias("stored_chunks"), "message_total")
        done.write.mode("overwrite").parquet(f"{ready_path}/batch={batch_id}")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch if ocr is None else ocr(batch)
        if jobs is not None:
            rows = pages.not_terminal(rows, jobs())
        if batch_id > 0:  # pairs of earlier batches; a batch that runs again sees the same
            earlier = batch.sparkSession.read.schema(f"{PAGES}, ingest int, batch int").parquet(page_path).filter(F.col("batch") < batch_id)
            rows = pages.not_stored(rows, earlier)
        broken = F.exists(F.array("file1", "file2"), lambda f: f.isNotNull() & f["content"].isNull())
        queue.dead_letter(rows.filter(broken), F.lit("no content")).write.mode("overwrite").parquet(f"{dlt_path}/batch={batch_id}")
        good = pages.sides(rows.filter(~F.coalesce(broken, F.lit(False))))
        good.withColumn("ingest", F.lit(batch_id)).write.mode("overwrite").parquet(f"{page_path}/batch={batch_id}")
        if ready_path is not None:
            signal(batch, batch_id)

    return messages.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def _replayed(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    path = scratch_path(spark, name)
    rows.write.parquet(path)
    return topic(spark, path, rows.schema)  # type: ignore[arg-type]


def _drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over what is there and returns the rows it wrote."""
    spark = stream.sparkSession
    out, check = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
    else:
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(out)).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def completeness(messages: DataFrame) -> DataFrame:
    """chunks of each job of which both sides have come, and whether all have."""
    both = F.col("file1").isNotNull() & F.col("file2").isNotNull()
    by = messages.groupBy("job_id").agg(F.collect_set(F.when(both, F.col("chunk_index"))).alias("c"), F.max("total_chunks").alias("t"))
    return by.select("job_id", F.size("c").cast("long").alias("stored_chunks"), (F.size("c") >= F.col("t")).alias("ready"))


def completeness_once(spark: SparkSession, messages: DataFrame) -> DataFrame:
    return _drained(completeness(_replayed(spark, messages, "chunks")), "complete", "completeness")


def dedupe_once(spark: SparkSession, events: DataFrame) -> DataFrame:
    """B21 as a stream: each (group, event) once, without time limit."""
    return _drained(_replayed(spark, events, "events").dropDuplicates(["consumer_group", "event_id"]), "append", "inbox")


def results_once(spark: SparkSession, fragments: DataFrame) -> DataFrame:
    """E17 as a stream: fragments collected by micro-batch, results of complete jobs."""
    store, check = scratch_path(spark, "fragments-store"), scratch_path(spark, "fragments-checkpoint")
    stream = _replayed(spark, fragments, "fragments")
    q = stream.writeStream.option("checkpointLocation", check).trigger(availableNow=True).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{store}/batch={i}")).start()
    q.awaitTermination()
    merged = results.merge_fragments(spark.read.schema(fragments.schema).parquet(f"{store}/batch=*"))
    return merged.select("job_id", "identical", "verdict", F.size("differences").cast("long").alias("n_differences"))


def relay(outbox: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str):
    """Unpublished outbox rows to a publisher, batch by batch."""
    return outbox.filter("published_at IS NULL").writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(publish).start()
