"""Result documents, outbox rows, objects and the reading interface."""

from __future__ import annotations

import json
from datetime import datetime

import pytest
from docdelta import api
from docdelta.functions.images import smaller
from docdelta.operators import finalize
from docdelta.sources.objects import ObjectStore, read_objects
from pyspark.sql import functions as F

AT = datetime(2024, 1, 1)


def test_result_documents_and_rows(spark):
    c = api.compare_texts(spark.createDataFrame([("a", "срок – год", "срок - год"), ("b", "x", "x")], "job_id string, text1 string, text2 string"))
    result = finalize.results(c.verdicts, c.decisions, F.lit(AT))
    got = {r.job_id: r for r in result.collect()}
    assert (got["a"].verdict, len(got["a"].differences), got["b"].identical, got["b"].differences) == ("content_equal", 1, True, [])
    jobs = spark.createDataFrame([("a", "comparing"), ("b", "cancelled"), ("c", "comparing")], "job_id string, status string")
    after, events, outbox = finalize.finalized(jobs, result, F.lit(AT))
    assert {r.job_id: r.status for r in after.collect()} == {"a": "completed", "b": "cancelled", "c": "comparing"}
    assert events.count() == 2 and sorted(r.event_id for r in outbox.collect()) == ["a:processed_results", "a:status_updates", "b:processed_results", "b:status_updates"]
    stored = finalize.with_decisions(finalize.stored_candidates(c.candidates, F.lit("r")), c.decisions).first()
    assert json.loads(stored.candidate)["candidate"]["changed"]["file1"] == "–" and stored.category == "technical"
    read = api.result(result, "a").first()
    assert read.verdict == "content_equal"


def test_runs_and_schedule(spark):
    runs = spark.createDataFrame([("r1", "running", None, None), ("r2", "completed", None, AT)], "run_id string, status string, error_message string, finished_at timestamp")
    errors = spark.createDataFrame([("r1", "boom"), ("r2", "late")], "run_id string, error string")
    assert {r.run_id: (r.status, r.error_message) for r in finalize.failed_runs(runs, errors, F.lit(AT)).collect()} == {"r1": ("failed", "boom"), "r2": ("completed", None)}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "job_id string")
    assert sorted(r.job_id for r in finalize.to_schedule(ids("a", "a", "b"), ids("b")).collect()) == ["a"]


def test_objects(spark, tmp_path):
    store = ObjectStore(spark, f"file://{tmp_path}")
    assert store.put("job/a.bin", b"\x00\x01") == 2 and store.exists("job/a.bin")
    (r,) = read_objects(spark, f"file://{tmp_path}", "*.bin").collect()
    assert (r.object_key, bytes(r.content), r.size_bytes) == ("job/a.bin", b"\x00\x01", 2)
    for bad in ("../x", "/x", ""):
        with pytest.raises(ValueError):
            store.put(bad, b"")
    with pytest.raises(ValueError):
        store.put("big", b"xx", limit=1)
    assert store.delete("job/a.bin") and not store.exists("job/a.bin")
    store.put("job/b", b"1")
    assert store.delete_prefix("job") and not store.exists("job/b")


def test_unreadable_images_stay():
    assert smaller("no image") == "no image" and smaller(None) is None
