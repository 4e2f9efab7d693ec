"""What a finished comparison leaves behind: B7-B13, F6, F11."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docdelta.operators.tokendiff import classifier_view, result_view


def stored_candidates(candidates: DataFrame, run_id: Column) -> DataFrame:
    """Candidates as JSON rows of a run, in order."""
    body = F.to_json(F.struct(classifier_view().alias("candidate"), F.col("alignment_id")))
    return candidates.select("job_id", run_id.alias("run_id"), "candidate_id", "sort_order", body.alias("candidate"))


def with_decisions(stored: DataFrame, decisions: DataFrame) -> DataFrame:
    """Stored candidates joined with their decisions; without one they count as shown and deterministic."""
    columns = ["category", "technical_type", "reason", "confidence", "protection_tags", "classified_by", "include_in_result"]
    j = stored.join(decisions.select("job_id", "candidate_id", *columns), ["job_id", "candidate_id"], "left")
    return j.withColumn("classified_by", F.coalesce("classified_by", F.lit("deterministic"))).withColumn("include_in_result", F.coalesce("include_in_result", F.lit(True)))


def batch_audit(validated: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per model batch: what was asked, whether the answer passed, why not, and how long it took."""
    by = validated.groupBy("job_id", "batch_index").agg(F.array_sort(F.collect_list("candidate_id")).alias("candidate_ids"), F.bool_and("parse_ok").alias("parse_ok"))
    j = by.join(answers.select("job_id", "batch_index", F.col("content").alias("response"), *(["latency_ms"] if "latency_ms" in answers.columns else [])), ["job_id", "batch_index"], "left")
    reason = F.when(F.col("response").isNull(), "model_unavailable").when(~F.col("parse_ok"), "invalid_response")
    return j.withColumn("failure_reason", reason)


def results(verdicts: DataFrame, decisions: DataFrame, created_at: Column) -> DataFrame:
    """The result document of every job, differences in order."""
    shown = decisions.filter("include_in_result").select("job_id", F.struct("sort_order", result_view().alias("d")).alias("d"))
    by = shown.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list("d")), lambda x: x["d"]).alias("differences"))
    j = verdicts.select("job_id", "verdict").join(by, "job_id", "left")
    empty = F.array().cast(by.schema["differences"].dataType)
    return j.select("job_id", (F.col("verdict") == "identical").alias("identical"), "verdict", F.coalesce("differences", empty).alias("differences"), created_at.alias("created_at"))


def finalized(jobs: DataFrame, result: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Jobs after completion, their event rows, and the two outbox rows of each."""
    done = result.select("job_id", F.lit(True).alias("done"))
    hit = F.coalesce("done", F.lit(False)) & ~F.col("status").isin("cancelled", "deleted", "deleting", "cancel_requested")
    after = jobs.join(done, "job_id", "left").select(*(F.when(hit, "completed").otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in jobs.columns))
    events = result.select("job_id", F.lit("completed").alias("event_type"), F.to_json(F.struct("verdict")).alias("payload"), at.alias("created_at"))
    topic = lambda name, body: F.struct(F.lit(name).alias("topic"), body.alias("payload"))
    rows = F.array(topic("processed_results", F.to_json(F.struct("identical", "verdict", "differences"))), topic("status_updates", F.to_json(F.struct(F.lit("completed").alias("status")))))
    outbox = result.select("job_id", at.alias("created_at"), F.inline(rows)).withColumn("event_id", F.concat_ws(":", "job_id", "topic"))
    return after, events, outbox


def failed_runs(runs: DataFrame, errors: DataFrame, at: Column) -> DataFrame:
    """Running runs that failed, with their error."""
    j = runs.join(errors.select("run_id", F.col("error").alias("e")), "run_id", "left")
    hit = F.col("e").isNotNull() & (F.col("status") == "running")
    out = {"status": F.when(hit, "failed").otherwise(F.col("status")), "error_message": F.when(hit, F.col("e")).otherwise(F.col("error_message")), "finished_at": F.when(hit, at).otherwise(F.col("finished_at"))}
    return j.select(*(out[c].alias(c) if c in out else F.col(c) for c in runs.columns))


def to_schedule(ready: DataFrame, in_flight: DataFrame) -> DataFrame:
    """ready jobs that are not being compared already, each once."""
    return ready.select("job_id").distinct().join(in_flight.select("job_id"), "job_id", "left_anti")


def metrics(events: DataFrame) -> DataFrame:
    """counters by name."""
    return events.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("value"))
