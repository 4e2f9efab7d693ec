"""Page store, job table, queue, result and stream semantics; registry contract."""

from __future__ import annotations

import json
from datetime import datetime

import duckdb
import pytest
from docdelta.operators import jobs, pages, queue, results
from docdelta.plans.registry import ORACLES, QUERIES
from docdelta.schemas import RAW_CHUNK
from docdelta.streaming import streams
from pyspark.sql import functions as F


def test_state_machine(spark):
    cases = [("queued", "processing", True), ("completed", "deleting", True), ("deleting", "deleted", True), ("completed", "processing", False), ("failed", "failed", False), ("processing", "processing", True), ("odd", "odd", True), ("odd", "queued", False), ("cancel_requested", "cancelled", True)]
    df = spark.createDataFrame(cases, "a string, b string, ok boolean")
    assert all(r.ok == r.got for r in df.withColumn("got", jobs.is_legal(F.col("a"), F.col("b"))).collect())
    assert jobs.transitions(spark).count() == sum(map(len, jobs.TRANSITIONS.values()))


def test_upsert_keeps_progress(spark):
    log = [("j", 1, "queued", 0, "m", "", ""), ("j", 2, "ocr_ready", 5, "", "a", ""), ("j", 3, "processing", 3, "late", "", "b"), ("k", 1, "failed", -1, "x", "", "")]
    df = spark.createDataFrame([(*r, datetime(2024, 1, r[1])) for r in log], "job_id string, seq int, status string, total_chunks int, message string, file1_name string, file2_name string, created_at timestamp")
    got = {r.job_id: (r.status, r.total_chunks, r.message, r.file1_name, r.file2_name) for r in jobs.current_jobs(df).collect()}
    assert got == {"j": ("ocr_ready", 5, "late", "a", "b"), "k": ("failed", 0, "x", "", "")}


JOBS = "job_id string, status string, message string, total_chunks int, processed_chunks int, comparison_claimed boolean, cancel_requested_at timestamp, lease_owner string, lease_expires_at timestamp, lease_epoch int, state_version int, failure_code string, failed_at timestamp, created_at timestamp"
NOW = datetime(2024, 1, 2)


def job(i, status, claimed=False, owner=None, done=2, cancel=None, expires=None):
    return (i, status, "m", 2, done, claimed, cancel, owner, expires, 0, 1, None, None, NOW)


def test_claim_recover_cancel_and_delete(spark):
    rows = [job("a", "ocr_ready"), job("b", "ocr_ready", True), job("c", "ocr_ready", done=1), job("d", "comparing", True, "me", expires=datetime(2025, 1, 1)), job("e", "comparing", True, "other", expires=datetime(2025, 1, 1)), job("f", "completed"), job("g", "ocr_ready", cancel=NOW)]
    df = spark.createDataFrame(rows, JOBS)
    at = F.lit(NOW)
    claimed = jobs.claim(df, at, "me").collect()
    assert [(r.job_id, r.status, r.lease_epoch, r.lease_expires_at) for r in claimed] == [("a", "comparing", 1, datetime(2024, 1, 2, 0, 15))]
    assert [r.job_id for r in pages.ready(df).collect()] == ["a", "g"]
    runs = spark.createDataFrame([("d", "running", None), ("e", "running", None), ("d", "completed", None)], "job_id string, status string, error_message string")
    failed, again = jobs.recover(runs, df, at, "me")
    assert sorted((r.job_id, r.status) for r in failed.collect()) == [("d", "completed"), ("d", "failed"), ("e", "running")]
    assert {r.job_id: r.status for r in again.collect()}["d"] == "ocr_ready"
    ids = spark.createDataFrame([("a",), ("f",)], "job_id string")
    asked = {r.job_id: r.status for r in jobs.request_cancel(df, ids, at).collect()}
    assert (asked["a"], asked["f"]) == ("cancel_requested", "completed")
    gone = {r.job_id: r.status for r in jobs.finish_delete(jobs.begin_delete(df, ids)).collect()}
    assert (gone["a"], gone["f"]) == ("ocr_ready", "deleted")
    assert [t.count() for t in jobs.delete_job(ids, df, runs)] == [5, 3]


def test_transition_is_compare_and_set(spark):
    df = spark.createDataFrame([job("a", "queued"), job("b", "completed"), job("c", "queued"), job("d", "queued")], JOBS)
    moves = spark.createDataFrame([("a", "processing", 1, "queued"), ("b", "processing", None, None), ("c", "processing", 7, None), ("d", "completed", None, "queued")], "job_id string, to_status string, expected_version int, from_status string")
    got = {r.job_id: (r.status, r.state_version, r.moved) for r in jobs.transition(df, moves).collect()}
    assert got == {"a": ("processing", 2, True), "b": ("completed", 1, False), "c": ("queued", 1, False), "d": ("queued", 1, False)}


def test_transition_notes_message_code_and_first_time(spark):
    df = spark.createDataFrame([job("a", "comparing"), job("b", "comparing")], JOBS).withColumn("failed_at", F.when(F.col("job_id") == "b", F.lit(datetime(2020, 1, 1)))).withColumn("updated_at", F.lit(None).cast("timestamp"))
    moves = spark.createDataFrame([("a", "failed", "broke", "x1", NOW), ("b", "failed", "", None, NOW)], "job_id string, to_status string, message string, failure_code string, at timestamp")
    got = {r.job_id: (r.status, r.message, r.failure_code, r.failed_at, r.updated_at) for r in jobs.transition(df, moves).collect()}
    assert got == {"a": ("failed", "broke", "x1", NOW, NOW), "b": ("failed", "m", None, datetime(2020, 1, 1), NOW)}


def test_one_bid_wins(spark):
    df = spark.createDataFrame([job("a", "ocr_ready"), job("b", "completed")], JOBS)
    bids = spark.createDataFrame([("a", "late", datetime(2024, 1, 3)), ("a", "w2", NOW), ("a", "w1", NOW), ("b", "w1", NOW)], "job_id string, owner string, at timestamp")
    assert [(r.job_id, r.lease_owner) for r in jobs.claims(df, bids, F.lit(NOW)).collect()] == [("a", "w1")]


def test_numbers_go_on(spark):
    df = spark.createDataFrame([("a", 4), ("b", 0)], "job_id string, last_event_seq int")
    new, after = jobs.append_events(df, spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "job_id string, at int"), ["at"])
    assert sorted((r.job_id, r.at, r.seq) for r in new.collect()) == [("a", 1, 5), ("a", 2, 6), ("b", 3, 1)]
    assert {r.job_id: r.last_event_seq for r in after.collect()} == {"a": 6, "b": 1}


def test_pages_make_a_job_ready(spark):
    df = spark.createDataFrame([job("a", "processing", done=1), job("b", "cancel_requested", done=0), job("c", "queued", done=0)], JOBS)
    stored = spark.createDataFrame([("a", 2, 2), ("b", 2, 2)], "job_id string, stored_chunks int, message_total int")
    got = {r.job_id: (r.status, r.processed_chunks, r.ready) for r in jobs.after_pages(df, stored).collect()}
    assert got == {"a": ("ocr_ready", 2, True), "b": ("cancel_requested", 2, True), "c": ("queued", 0, False)}


def test_sticky_status_still_notes_the_failure(spark):
    df = spark.createDataFrame([job("a", "completed", True, "w"), job("b", "comparing", True, "w")], JOBS)
    ch = spark.createDataFrame([(i, "failed", "x", NOW, True) for i in "ab"], "job_id string, new_status string, new_message string, at timestamp, release boolean")
    got = {r.job_id: (r.status, r.failure_code, r.failed_at, r.comparison_claimed, r.lease_owner) for r in jobs.set_status(df, ch).collect()}
    assert got == {"a": ("completed", "pipeline_error", None, False, None), "b": ("failed", "pipeline_error", NOW, False, None)}


def chunk(j, i, n, a, b):
    side = lambda t: None if t is None else ("f", "docx", "text", t)
    return (j, j, i, n, side(a), side(b))


def test_page_store(spark):
    df = spark.createDataFrame([chunk("a", 1, 2, "x", "y"), chunk("a", 2, 2, "z", None)], RAW_CHUNK)
    rows = pages.sides(df).withColumn("ingest", F.lit(1))
    twice = rows.unionByName(rows.filter("page_number = 1 AND side = 1").withColumn("ingest", F.lit(2)).withColumn("text", F.lit("new")))
    store = pages.stored(twice, "ingest")
    got = {(r.page_number, r.side): (r.text, r.source_content_type, r.is_missing) for r in store.collect()}
    assert got == {(1, 1): ("new", "text", False), (1, 2): ("y", "text", False), (2, 1): ("z", "text", False), (2, 2): ("", "missing", True)}
    assert pages.stored_chunks(store).first().stored_chunks == 2
    d = {r.side: (r.filename, r.text, r.n_pages) for r in pages.documents(store).collect()}
    assert d == {1: ("f", "new\n\nz", 2), 2: ("f", "y", 1)}
    assert pages.not_stored(df, store).count() == 0
    done = spark.createDataFrame([job("a", "completed")], JOBS)
    assert pages.not_terminal(df, done).count() == 0


def test_objects_and_envelopes(spark):
    refs = spark.createDataFrame([("k/a.png", None, "image/png", None, None), ("k/b", None, "text/plain", None, "n"), (None, "inline", "text", "docx", "f")], "object_key string, content string, content_type string, format string, filename string")
    blobs = spark.createDataFrame([("k/a.png", bytearray(b"\x01\x02")), ("k/b", bytearray("é".encode()))], "object_key string, content binary")
    got = {r.filename: (r.content, r.content_type, r.format) for r in pages.resolved(refs, blobs).collect()}
    assert got == {"a.png": ("AQI=", "image", "pdf"), "n": ("é", "text", "docx"), "f": ("inline", "text", "docx")}
    other = spark.createDataFrame([("k/b", "text"), ("k/b", None)], "key string, content_type string").withColumns({c: F.lit(None).cast("string") for c in ("object_key", "content", "format", "filename")})
    assert [(r.content, r.content_type, r.filename) for r in pages.resolved(other, blobs).collect()] == [("w6k=", "image", "b")] * 2  # only text/* is text behind a key
    side = "struct<object_key:string,content_type:string>"
    cmd = spark.createDataFrame([(None, None, (("p", 7, ("k/a", None), ("k/b", "text/plain")))), ("flat", 3, None)], f"job_id string, chunk_index int, payload struct<job_id:string,chunk_index:int,file1:{side},file2:{side}>")
    cmd = cmd.selectExpr("job_id", "CAST(NULL AS STRING) AS document_id", "chunk_index", "CAST(NULL AS INT) AS total_chunks", "payload.file1 AS file1", "payload.file2 AS file2", "named_struct('job_id', payload.job_id, 'document_id', CAST(NULL AS STRING), 'chunk_index', payload.chunk_index, 'total_chunks', CAST(NULL AS INT), 'file1', payload.file1, 'file2', payload.file2) AS payload")
    flat = pages.unwrapped(cmd)
    assert sorted((r.job_id, r.document_id, r.chunk_index, r.total_chunks) for r in flat.collect()) == [("flat", "flat", 3, 1), ("p", "p", 7, 1)]
    assert [r.image_keys for r in pages.image_keys(flat).orderBy("job_id").collect()] == [[], ["k/a"]]
    keys = spark.createDataFrame([("a/b",), ("../x",), ("/abs",), ("a/../b",), ("a..b",)], "k string")
    assert [r.s for r in keys.select(queue.safe_key(F.col("k")).alias("s")).collect()] == [True, False, False, False, True]


ITEMS = "task_id string, stage string, status string, available_at timestamp, created_at timestamp, lease_expires_at timestamp, lease_owner string, lease_token string, attempt int, lease_epoch int"


def test_work_items(spark):
    item = lambda i, st, **o: (i, o.get("stage", "s"), st, o.get("at", datetime(2024, 1, 1)), NOW, o.get("exp"), "w", "t", o.get("attempt", 0), 1)
    df = spark.createDataFrame([item("a", "leased", exp=datetime(2024, 1, 1)), item("b", "pending", at=datetime(2024, 1, 1, 1)), item("c", "pending", at=datetime(2025, 1, 1)), item("d", "leased", exp=datetime(2025, 1, 1))], ITEMS)
    (r,) = queue.lease_next(df, F.lit(NOW), "me").collect()
    assert (r.task_id, r.attempt, r.lease_epoch, r.lease_owner) == ("a", 1, 2, "me")
    done = spark.createDataFrame([("a", "t", 1), ("b", "old", 1), ("d", "t", 9)], "task_id string, lease_token string, lease_epoch int")
    after, attempts = queue.complete(df, done, F.lit(NOW))
    assert {x.task_id: x.status for x in after.collect()} == {"a": "completed", "b": "pending", "c": "pending", "d": "leased"}
    assert [(x.task_id, x.worker) for x in attempts.collect()] == [("a", "w")]
    more = queue.create_items(spark.createDataFrame([item("a", "pending"), item("z", "pending"), item("z", "pending")], ITEMS), df)
    assert sorted(x.task_id for x in more.collect()) == ["a", "b", "c", "d", "z"]
    tried = queue.retry(spark.createDataFrame([item("a", "leased", attempt=3), item("b", "leased", attempt=8)], ITEMS), F.lit(NOW))
    assert {x.task_id: (x.status, x.available_at) for x in tried.collect()} == {"a": ("pending", datetime(2024, 1, 2, 0, 0, 8)), "b": ("failed", datetime(2024, 1, 1))}


def test_outbox_and_inbox(spark):
    box = spark.createDataFrame([(1, NOW, None, None, 0, None), (2, datetime(2024, 1, 1), NOW, None, 1, None), (3, datetime(2023, 1, 1), None, NOW, 0, None)], "event_id int, created_at timestamp, published_at timestamp, claimed_at timestamp, publish_attempts int, last_error string")
    assert [r.event_id for r in queue.outbox_due(box, F.lit(datetime(2024, 1, 2, 0, 0, 10))).collect()] == [1]
    assert queue.outbox_lag(box.filter("event_id = 2"), F.lit(NOW)).first().lag_seconds == 0
    got = {r.event_id: (r.published_at is not None, r.publish_attempts, len(r.last_error or "")) for r in queue.outbox_marked(box, spark.createDataFrame([(1, "e" * 2000), (3, None)], "event_id int, error string"), F.lit(NOW)).collect()}
    assert got == {1: (False, 1, 1000), 2: (True, 1, 0), 3: (True, 1, 0)}
    e = spark.createDataFrame([("g", 1, 5), ("g", 1, 4), ("h", 1, 3), ("g", 2, 2)], "consumer_group string, event_id int, received_at int")
    left = queue.inbox_new(e, spark.createDataFrame([("g", 2)], "consumer_group string, event_id int"))
    assert sorted((r.consumer_group, r.event_id, r.received_at) for r in left.collect()) == [("g", 1, 4), ("h", 1, 3)]


def test_outbox_relay_and_enqueue(spark):
    box = spark.createDataFrame([("1", NOW, None, None, 0, None), ("2", NOW, None, None, 0, "old"), ("3", NOW, NOW, None, 1, None)], "event_id string, created_at timestamp, published_at timestamp, claimed_at timestamp, publish_attempts int, last_error string")
    sent = []

    def publish(row):
        if row["event_id"] == "1":
            raise RuntimeError("down " * 500)
        sent.append(row["event_id"])

    got = {r.event_id: (r.published_at is not None, r.publish_attempts, len(r.last_error or ""), r.claimed_at) for r in queue.relayed(box, publish, F.lit(NOW)).collect()}
    assert sent == ["2"] and got == {"1": (False, 1, 1000, None), "2": (True, 1, 0, NOW), "3": (True, 1, 0, None)}
    new = spark.createDataFrame([("j", "t", "k", "{}", NOW)], "job_id string, topic string, message_key string, payload string, created_at timestamp")
    rows = queue.enqueued(box, new).collect()
    assert len(rows) == 4 and len({r.event_id for r in rows}) == 4 and [r.publish_attempts for r in rows if r.job_id] == [0]


def test_envelopes_and_discarded_images(spark):
    df = spark.createDataFrame([("e", "j", None, None, None, "p"), ("f", "j", 3, "e", "c", "q")], "event_id string, job_id string, attempt int, causation_id string, correlation_id string, payload string")
    assert [(r.attempt, r.causation_id, r.correlation_id) for r in queue.envelope(df).orderBy("event_id").collect()] == [(1, "e", "j"), (3, "e", "c")]
    keys = spark.createDataFrame([("a",), ("a",)], "object_key string")
    assets = spark.createDataFrame([("a",), ("b",)], "object_key string")
    kept, marked = queue.discard_images(assets, spark.createDataFrame([(1, "a"), (2, "b")], "page int, object_key string"), keys)
    assert [r.object_key for r in kept.collect()] == ["b"] and {r.page: r.object_key for r in marked.collect()} == {1: None, 2: "b"}


def test_reading_interface(spark):
    from docdelta import api

    df = spark.createDataFrame([("a", "u", datetime(2024, 1, 1)), ("b", "u", NOW), ("c", "v", NOW)], "job_id string, user_id string, created_at timestamp")
    assert [r.job_id for r in api.list_jobs(df, "u").collect()] == ["b", "a"] and api.list_jobs(df).count() == 3 and api.job(df, "c").first().user_id == "v"
    p = spark.createDataFrame([("a", 2, 1), ("a", 1, 2), ("a", 1, 1), ("b", 1, 1)], "job_id string, page_number int, side int")
    assert [(r.page_number, r.side) for r in api.pages_of(p, "a").collect()] == [(1, 1), (1, 2), (2, 1)] and api.pages_of(p, "a", 2).count() == 1


def test_fragments(spark):
    f = lambda j, i, n, same, v, d, at=0: (j, i, n, same, v, d, at)
    rows = [f("a", 1, 2, True, "identical", []), f("a", 2, 2, True, "identical", []), f("b", 2, 2, False, "different", ["y"]), f("b", 1, 2, False, "content_equal", ["x"]), f("b", 1, 2, True, "identical", [], 9), f("c", 1, 2, True, "identical", []), f("d", 1, 1, False, None, [])]
    df = spark.createDataFrame(rows, "job_id string, chunk_index int, total_chunks int, identical boolean, verdict string, differences array<string>, received_at int")
    got = {r.job_id: (r.identical, r.verdict, r.differences) for r in results.merge_fragments(df).collect()}
    assert got == {"a": (True, "identical", []), "b": (False, "different", ["x", "y"]), "d": (False, "different", [])}
    legacy = spark.createDataFrame([(True, None, []), (True, None, ["d"]), (False, "content_equal", [])], "identical boolean, verdict string, differences array<string>")
    assert [r.verdict for r in results.legacy_verdict(legacy).collect()] == ["identical", "different", "content_equal"]


def test_stream_ingest_is_idempotent_and_routes_errors(spark, tmp_path):
    source, out = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    body = lambda j, i, t: json.dumps({"job_id": j, "document_id": j, "chunk_index": i, "total_chunks": 1, "file1": {"filename": "f", "format": "docx", "content_type": "text", "content": t}, "file2": None})
    (source / "a.txt").write_text("\n".join([body("a", 1, "x"), body("b", 1, None), "no json", body("done", 1, "y"), body("a", 0, "bad index")]))
    raw = spark.readStream.format("text").load(str(source))
    good, bad = streams.parsed(raw)
    jobs_now = lambda: spark.createDataFrame([job("done", "completed")], JOBS)
    for _ in range(2):
        streams.ingest(good, f"{out}/pages", f"{out}/dlt", f"{out}/check", jobs_now).awaitTermination()
    store = spark.read.parquet(f"{out}/pages/*")
    assert sorted((r.job_id, r.side, r.is_missing) for r in store.collect()) == [("a", 1, False), ("a", 2, True)]
    assert [r.job_id for r in spark.read.parquet(f"{out}/dlt/*").collect()] == ["b"]
    q = bad.writeStream.format("parquet").option("path", f"{out}/bad").option("checkpointLocation", f"{out}/check2").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(f"{out}/bad").count() == 2


def test_stream_skips_stored_pairs_and_signals(spark, tmp_path):
    source, out = tmp_path / "in", f"file://{tmp_path}/out"
    source.mkdir()
    body = lambda i, t: json.dumps({"job_id": "a", "document_id": "a", "chunk_index": i, "total_chunks": 2, "file1": {"filename": "f", "format": "docx", "content_type": "text", "content": t}, "file2": {"filename": "g", "format": "docx", "content_type": "text", "content": t}})
    for k, rows in enumerate([[body(1, "x")], [body(1, "again"), body(2, "y")]]):
        (source / f"{k}.txt").write_text("\n".join(rows))
        good, _ = streams.parsed(spark.readStream.format("text").load(str(source)))
        streams.ingest(good, f"{out}/pages", f"{out}/dlt", f"{out}/check", ready_path=f"{out}/ready").awaitTermination()
    store = spark.read.parquet(f"{out}/pages")
    assert sorted((r.page_number, r.side, r.text) for r in store.collect()) == [(1, 1, "x"), (1, 2, "x"), (2, 1, "y"), (2, 2, "y")]
    assert {r.batch: (r.stored_chunks, r.message_total) for r in spark.read.parquet(f"{out}/ready").collect()} == {0: (1, 2), 1: (2, 2)}


def test_failed_batches_are_given_again_and_commands_once(spark, tmp_path):
    cols = "event_id int, job_id string"
    for stage in ("ocr", "diff"):
        spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], cols).write.parquet(f"{tmp_path}/{stage}")
    every = streams.commands({s: spark.readStream.schema(cols).parquet(f"{tmp_path}/{s}") for s in ("ocr", "diff")})
    seen, fail = [], [True]

    def handler(batch, batch_id):
        if fail.pop() if fail else False:
            raise RuntimeError("handler")
        seen.extend((r.consumer_group, r.event_id) for r in batch.collect())

    with pytest.raises(Exception, match="handler"):
        streams.handled(every, handler, f"{tmp_path}/check").awaitTermination()
    streams.handled(every, handler, f"{tmp_path}/check").awaitTermination()
    assert sorted(seen) == [("diff", 1), ("diff", 2), ("ocr", 1), ("ocr", 2)]
    m = streams.keyed(spark.createDataFrame([(1, "a")], cols)).first()
    assert m.key == "a" and json.loads(m.value) == {"event_id": 1, "job_id": "a"}


FAST = ["technical_type_pairs", "safety_gate", "block_segments", "technical_rules", "group_technical", "progress_states", "transition_moves", "claim_winners", "page_pair_save", "status_relay", "collapse_whitespace_docs", "alignment_key_docs", "change_tags_pairs", "upsert_job_current", "state_replay", "merge_fragments", "document_assembly", "stream_completeness", "validate_batch"]


@pytest.mark.parametrize("name", FAST)
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "events", "orders", "lineitem", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    want = con.execute(ORACLES[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == names
    key = lambda r: repr(r)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=key) == sorted((tuple(r[cols.index(c)] for c in names) for r in want.fetchall()), key=key)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(QUERIES) >= 50
    assert e.entry(spark).schema.names == ["job_id", "verdict", "n_differences"]
