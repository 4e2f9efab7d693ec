"""Job table semantics over logs of changes: A5-A7, A10, A15, B1-B20, F8, F10.

Mutable rows are append-only logs; the current row is an ordered fold. ``as_of``
is always given, so results do not depend on the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "cancelled", "deleted")
EARLY = ("queued", "preparing", "processing")
# States that an early status does not take back, and the legal transitions.
ADVANCED = ("ocr_ready", "comparing", "completed", "failed", "cancelled", "deleted", "deleting")
TRANSITIONS = {
    "queued": ("preparing", "processing", "failed", "cancel_requested"),
    "preparing": ("queued", "processing", "failed", "cancel_requested"),
    "processing": ("ocr_ready", "failed", "cancel_requested"),
    "ocr_ready": ("comparing", "failed", "cancel_requested"),
    "comparing": ("classifying", "finalizing", "completed", "failed", "cancel_requested"),
    "classifying": ("finalizing", "completed", "failed", "cancel_requested"),
    "finalizing": ("completed", "failed"),
    "cancel_requested": ("cancelled", "deleting"),
    "completed": ("deleting",),
    "failed": ("deleting",),
    "cancelled": ("deleting",),
    "deleting": ("deleted",),
    "deleted": (),
}


def transitions(spark: SparkSession) -> DataFrame:
    """F8: the legal moves as a table (a few dozen rows)."""
    rows = [(a, b) for a, bs in TRANSITIONS.items() for b in bs]
    return spark.createDataFrame(rows, "from_status string, to_status string")


def is_legal(old: Column, new: Column) -> Column:
    """F8: a listed move, or staying in a state that is not terminal."""
    moves = F.create_map(*(x for a, bs in TRANSITIONS.items() for x in (F.lit(a), F.array(*map(F.lit, bs)).cast("array<string>"))))
    listed = F.coalesce(F.array_contains(F.try_element_at(moves, old), new), F.lit(False))
    return F.when(old == new, ~old.isin(*TERMINAL)).otherwise(listed)


def next_status(old: Column, new: Column) -> Column:
    """B1: failed always wins; an early status does not take back an advanced one."""
    return F.when(new == "failed", new).when(old.isin(*ADVANCED) & new.isin(*EARLY), old).otherwise(new)


def current_jobs(log: DataFrame) -> DataFrame:
    """B1, B2: jobs after all messages. ``log``: job_id, seq, status, total_chunks, message, file1_name, file2_name, created_at."""
    fields = ["seq", "status", "total_chunks", "message", "file1_name", "file2_name", "created_at"]
    by = log.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("log"))
    named = lambda new, old: F.when(new != "", new).otherwise(old)
    state = lambda s, n, m, a, b: F.struct(s.alias("status"), n.alias("total_chunks"), m.alias("message"), a.alias("file1_name"), b.alias("file2_name"))
    first = F.element_at("log", 1)
    start = state(first["status"], F.greatest(first["total_chunks"], F.lit(0)), first["message"], first["file1_name"], first["file2_name"])

    def step(acc: Column, x: Column) -> Column:
        total = F.when(x["total_chunks"] > 0, F.greatest(acc["total_chunks"], x["total_chunks"])).otherwise(acc["total_chunks"])
        return state(next_status(acc["status"], x["status"]), total, named(x["message"], acc["message"]), named(x["file1_name"], acc["file1_name"]), named(x["file2_name"], acc["file2_name"]))

    rest = F.slice("log", F.lit(2), F.size("log"))
    return by.select("job_id", F.aggregate(rest, start, step).alias("j"), first["created_at"].alias("created_at"), F.element_at("log", -1)["created_at"].alias("updated_at"), F.size("log").alias("state_version")).select("job_id", "j.*", "created_at", "updated_at", "state_version")


def set_status(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Guarded status changes (job_id, new_status, new_message, at, release)."""
    sticky = F.col("status").isin("completed", "cancelled", "deleted")
    j = jobs.join(changes, "job_id", "left")
    hit, failed = F.col("new_status").isNotNull(), F.col("new_status") == "failed"
    free = hit & F.coalesce("release", F.lit(False))
    out = {
        "status": F.when(hit & ~sticky, F.col("new_status")).otherwise(F.col("status")), "message": F.when(hit & ~sticky, F.col("new_message")).otherwise(F.col("message")),
        "failure_code": F.when(hit & failed, "pipeline_error").otherwise(F.col("failure_code")), "failed_at": F.when(hit & failed & ~sticky, F.coalesce("failed_at", "at")).otherwise(F.col("failed_at")),
        "comparison_claimed": F.when(free, False).otherwise(F.col("comparison_claimed")), "lease_owner": F.when(~free, F.col("lease_owner")),
        "state_version": F.col("state_version") + hit.cast("int"),
    }
    return j.select(*((out[c].alias(c) if c in out else F.col(c)) for c in jobs.columns))


#: States whose first entry is noted in a column of their name.
STAMPED = ("queued", "preparing", "processing", "comparing", "completed", "failed", "cancelled")


def transition(jobs: DataFrame, moves: DataFrame) -> DataFrame:
    """Compare-and-set moves; adds ``moved``.

    ``moves``: job_id, to_status, and where given expected_version, from_status,
    message, failure_code and at. A move sets the status, the next version, a
    message that is not empty, a failure code, the first time of its state and the
    time of the change.
    """
    given = dict(moves.dtypes)
    of = lambda c, kind="string": F.col(f"move_.{c}") if c in given else F.lit(None).cast(kind)
    j = jobs.join(moves.select("job_id", F.struct(*(c for c in moves.columns if c != "job_id")).alias("move_")), "job_id", "left")
    to, at = of("to_status"), of("at", "timestamp")
    legal = of("from_status").isNull() | (is_legal(of("from_status"), to) & (of("from_status") == F.col("status")))
    version = of("expected_version", "int").isNull() | (of("expected_version", "int") == F.col("state_version"))
    open_ = to.isin(*TERMINAL) | ~F.col("status").isin(*TERMINAL)
    j = j.withColumn("moved", F.coalesce(to.isNotNull() & legal & version & open_, F.lit(False)))
    new = {
        "status": to, "state_version": F.col("state_version") + 1, "updated_at": at,
        "message": F.coalesce(F.nullif(of("message"), F.lit("")), F.col("message")) if "message" in jobs.columns else None, "failure_code": F.coalesce(of("failure_code"), F.col("failure_code")) if "failure_code" in jobs.columns else None,
    } | {f"{s}_at": F.when(to == s, F.coalesce(F.col(f"{s}_at"), at)).otherwise(F.col(f"{s}_at")) for s in STAMPED if f"{s}_at" in jobs.columns}
    return j.select(*(F.when(F.col("moved"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns), "moved")


def replay(log: DataFrame) -> DataFrame:
    """F8: the state reached by applying legal moves in order; illegal ones are counted and skipped."""
    by = log.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "status"))).alias("log"))
    start = F.struct(F.element_at("log", 1)["status"].alias("status"), F.lit(0).alias("illegal"), F.lit(0).alias("moves"))

    def step(acc: Column, x: Column) -> Column:
        ok = is_legal(acc["status"], x["status"])
        return F.struct(F.when(ok, x["status"]).otherwise(acc["status"]).alias("status"), (acc["illegal"] + (~ok).cast("int")).alias("illegal"), (acc["moves"] + ok.cast("int")).alias("moves"))

    return by.select("job_id", F.aggregate(F.slice("log", F.lit(2), F.size("log")), start, step).alias("s")).select("job_id", "s.status", "s.moves", "s.illegal")


def claimable(jobs: DataFrame) -> DataFrame:
    """Jobs that a comparer may claim."""
    free = ~F.col("comparison_claimed") & ~F.col("status").isin(*TERMINAL, "deleting") & F.col("cancel_requested_at").isNull()
    return jobs.filter(free & (F.col("total_chunks") > 0) & (F.col("processed_chunks") >= F.col("total_chunks")))


def claim(jobs: DataFrame, as_of: Column, owner: Column | str, seconds: int = 900) -> DataFrame:
    """All claimable jobs at ``as_of``, with their lease."""
    new = {
        "comparison_claimed": F.lit(True), "status": F.lit("comparing"), "lease_owner": F.lit(owner) if isinstance(owner, str) else owner, "lease_expires_at": as_of + F.make_interval(secs=F.lit(seconds)),
        "lease_epoch": F.col("lease_epoch") + 1, "state_version": F.col("state_version") + 1,
    } | ({"comparing_at": F.coalesce("comparing_at", as_of)} if "comparing_at" in jobs.columns else {})
    return claimable(jobs).withColumns(new)


def claims(jobs: DataFrame, bids: DataFrame, as_of: Column, seconds: int = 900) -> DataFrame:
    """Of several bids (job_id, owner, at) for a claimable job the first one wins; one row per job won."""
    first = bids.groupBy("job_id").agg(F.min(F.struct("at", "owner")).alias("bid_"))
    return claim(jobs.join(first, "job_id"), as_of, F.col("bid_.owner"), seconds).select(*jobs.columns)


def recover(runs: DataFrame, jobs: DataFrame, as_of: Column, owner: str) -> tuple[DataFrame, DataFrame]:
    """After a restart, runs without a living lease fail and their jobs become ready again."""
    dead = (F.col("lease_owner") == owner) | F.col("lease_owner").isNull() | F.col("lease_expires_at").isNull() | (F.col("lease_expires_at") < as_of)
    lost = jobs.filter(F.coalesce(dead, F.lit(True))).select("job_id").distinct().withColumn("lost", F.lit(True))
    hit = (F.col("status") == "running") & F.col("lost").isNotNull()
    out = runs.join(lost, "job_id", "left").select(
        *(F.when(hit, "failed").otherwise(F.col(c)).alias(c) if c == "status" else F.when(hit, F.coalesce(c, F.lit("restarted"))).otherwise(F.col(c)).alias(c) if c == "error_message" else F.col(c) for c in runs.columns)
    )
    again = (F.col("status") == "comparing") & F.coalesce(dead, F.lit(True))
    fixed = {"status": F.lit("ocr_ready"), "comparison_claimed": F.lit(False), "lease_owner": F.lit(None), "lease_expires_at": F.lit(None)}
    return out, jobs.select(*(F.when(again, fixed[c]).otherwise(F.col(c)).alias(c) if c in fixed else F.col(c) for c in jobs.columns))


def request_cancel(jobs: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """The first request counts; terminal and deleting jobs are left alone."""
    j = jobs.join(ids.select("job_id", F.lit(True).alias("asked")), "job_id", "left")
    hit = F.coalesce("asked", F.lit(False)) & ~F.col("status").isin(*TERMINAL, "deleting")
    return j.select(*(F.when(hit, "cancel_requested").otherwise(F.col(c)).alias(c) if c == "status" else F.when(hit, F.coalesce(c, at)).otherwise(F.col(c)).alias(c) if c == "cancel_requested_at" else F.col(c) for c in jobs.columns))


def complete_cancel(jobs: DataFrame) -> DataFrame:
    """B19"""
    return jobs.withColumn("status", F.when(F.col("status") == "cancel_requested", "cancelled").otherwise(F.col("status")))


def begin_delete(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Terminal or cancel-requested jobs start to be deleted."""
    j = jobs.join(ids.select("job_id", F.lit(True).alias("asked")), "job_id", "left")
    hit = F.coalesce("asked", F.lit(False)) & F.col("status").isin("completed", "failed", "cancelled", "cancel_requested")
    return j.withColumn("status", F.when(hit, "deleting").otherwise(F.col("status"))).drop("asked")


def finish_delete(jobs: DataFrame) -> DataFrame:
    """B19"""
    return jobs.withColumn("status", F.when(F.col("status") == "deleting", "deleted").otherwise(F.col("status")))


def delete_job(ids: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """The tables without the jobs and what depends on them."""
    return [t.join(ids.select("job_id"), "job_id", "left_anti") for t in tables]


def jobs_of(jobs: DataFrame, owner: int | str | None = None) -> DataFrame:
    """Newest first, of one owner or all."""
    rows = jobs if owner is None else jobs.filter(F.col("user_id") == owner)
    return rows.orderBy(F.desc("created_at"), "job_id")


def latest_result(results: DataFrame) -> DataFrame:
    """A10: the newest result of each job."""
    newest = results.groupBy("job_id").agg(F.max_by(F.struct(*(c for c in results.columns if c != "job_id")), F.struct("created_at", *(["result_id"] if "result_id" in results.columns else []))).alias("r"))
    return newest.select("job_id", "r.*")


def numbered(rows: DataFrame, order: list[str], name: str, last: DataFrame | None = None) -> DataFrame:
    """Run numbers and event sequence numbers of new rows within the job.

    They go on after the last number that a job has (``last``: job_id, last), from 1 without one.
    """
    place = F.row_number().over(Window.partitionBy("job_id").orderBy(*order))
    if last is None:
        return rows.withColumn(name, place)
    known = last.select("job_id", F.col("last").alias("last_"))
    return rows.join(known, "job_id", "left").withColumn(name, F.coalesce("last_", F.lit(0)) + place).drop("last_")


def append_events(jobs: DataFrame, events: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The new events with their numbers, and the jobs with their last number."""
    new = numbered(events, order, "seq", jobs.select("job_id", F.col("last_event_seq").alias("last")))
    top = new.groupBy("job_id").agg(F.max("seq").alias("top_"))
    after = jobs.join(top, "job_id", "left").select(*(F.coalesce("top_", c).alias(c) if c == "last_event_seq" else F.col(c) for c in jobs.columns))
    return new, after


def events_after(events: DataFrame, last_seq: int) -> DataFrame:
    """A15"""
    return events.filter(F.col("seq") > last_seq).orderBy("job_id", "seq")


def progress(chunks: DataFrame) -> DataFrame:
    """completion of each job; 0 of 0 counts as complete."""
    by = chunks.groupBy("job_id").agg(F.countDistinct("chunk_index").alias("done"), F.max("total_chunks").alias("total"))
    return by.select("job_id", "done", "total", (F.col("done") >= F.col("total")).alias("complete"), F.concat_ws("/", F.col("done").cast("string"), F.col("total").cast("string")).alias("progress_text"))


def progress_states(log: DataFrame) -> DataFrame:
    """what a progress tracker knows of each job after its calls, in order.

    ``log``: job_id, seq, op, status, total_chunks, chunk_index. Operations:
    ``ensure`` creates a job, or refreshes it (its total if above 0; its status if
    the new one is failed or the old one queued or preparing); ``chunk`` creates it
    as processing, or refreshes its total and moves it from queued or preparing to
    processing; ``done`` notes a chunk once and, where all are there, makes the job
    ocr_ready and counts a completion; ``set`` sets the status of a known job;
    ``fail`` creates or fails it.
    """
    by = log.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seq", "op", "status", "total_chunks", "chunk_index"))).alias("log"))
    state = lambda known, status, total, done, completions: F.struct(known.alias("known"), status.alias("status"), total.alias("total"), done.alias("done"), completions.alias("completions"))
    start = state(F.lit(False), F.lit(""), F.lit(0), F.array().cast("array<int>"), F.lit(0))

    def step(a: Column, x: Column) -> Column:
        early = a["status"].isin("queued", "preparing")
        total = F.when(x["total_chunks"] > 0, x["total_chunks"]).otherwise(a["total"])
        done = F.array_append(a["done"], x["chunk_index"])
        full = (F.size(done) >= a["total"]) & (a["status"] != "ocr_ready")
        made = lambda status, n: state(F.lit(True), status, n, a["done"], a["completions"])
        return (
            F.when((x["op"] == "ensure") & ~a["known"], made(x["status"], F.greatest(F.lit(0), x["total_chunks"])))
            .when(x["op"] == "ensure", made(F.when((x["status"] == "failed") | early, x["status"]).otherwise(a["status"]), total))
            .when((x["op"] == "chunk") & ~a["known"], made(F.lit("processing"), x["total_chunks"]))
            .when(x["op"] == "chunk", made(F.when(early, "processing").otherwise(a["status"]), total))
            .when((x["op"] == "done") & a["known"] & ~F.array_contains(a["done"], x["chunk_index"]), state(a["known"], F.when(full, "ocr_ready").otherwise(a["status"]), a["total"], done, a["completions"] + full.cast("int")))
            .when((x["op"] == "set") & a["known"], made(x["status"], a["total"]))
            .when(x["op"] == "fail", made(F.lit("failed"), a["total"]))
            .otherwise(a)
        )

    out = by.select("job_id", F.aggregate("log", start, step).alias("s")).filter("s.known")
    return out.select("job_id", "s.status", F.col("s.total").alias("total_chunks"), F.size("s.done").alias("processed_chunks"), "s.completions")


def after_pages(jobs: DataFrame, stored: DataFrame) -> DataFrame:
    """Jobs after page pairs were stored (``stored``: job_id, stored_chunks, message_total); adds ``ready``.

    The count never falls; a status is not taken back, nor is a request to cancel.
    """
    j = jobs.join(stored, "job_id", "left")
    hit = F.col("stored_chunks").isNotNull()
    ready = hit & (F.col("message_total") > 0) & (F.col("stored_chunks") >= F.col("message_total"))
    held = F.col("status").isin(*ADVANCED, "cancel_requested")
    new = {
        "status": F.when(hit & ~held, F.when(ready, "ocr_ready").otherwise("processing")).otherwise(F.col("status")),
        "processed_chunks": F.greatest("processed_chunks", "stored_chunks"), "total_chunks": F.greatest("total_chunks", "message_total"),
    }
    return j.select(*(new[c].alias(c) if c in new else F.col(c) for c in jobs.columns), F.coalesce(ready, F.lit(False)).alias("ready"))
