"""Registered queries of the comparison engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docdelta.functions import scalars as fn
from docdelta.functions.textnorm import alignment_key, layout_free, literal_key
from docdelta.operators import align, classify, jobs, pages, queue, results, segment, tokendiff
from docdelta.plans import compare as plan
from docdelta.sources import views
from docdelta.sources.tables import read_table, widened
from docdelta.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
AS_OF = "2024-01-20 00:00:00"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return widened(read_table(spark, sf, "documents").select("doc_id", "text"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _line_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the pairs at the same place that differ."""
    p = views.doc_pairs(spark, sf)
    z = p.select("job_id", F.posexplode(F.arrays_zip(F.split("text1", "\n", -1).alias("a"), F.split("text2", "\n", -1).alias("b"))).alias("line_no", "z"))
    return z.select("job_id", "line_no", F.coalesce("z.a", F.lit("")).alias("a"), F.coalesce("z.b", F.lit("")).alias("b")).filter("a <> b")


# ---- text functions -------------------------------------------------------


@query
def normalize_technical_docs(spark, sf):
    t = layout_free(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.length(t).cast("long").alias("n"), F.sha2(t.cast("binary"), 256).alias("sha"))


@query
def collapse_whitespace_docs(spark, sf):
    t = literal_key(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.length(t).cast("long").alias("n"), F.sha2(t.cast("binary"), 256).alias("sha"))


@query
def alignment_key_docs(spark, sf):
    t = alignment_key(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.length(t).cast("long").alias("n"), F.sha2(t.cast("binary"), 256).alias("sha"))


@query
def clip_docs(spark, sf):
    return _docs(spark, sf).select("doc_id", fn.clip(F.col("text"), 200).alias("clipped"))


@query
def token_counts(spark, sf):
    t = fn.tokens(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_types"))


@query
def line_kind_counts(spark, sf):
    lines = _lines(spark, sf).select(fn.block_kind(fn.strip(F.col("line"))).alias("k")).select(F.coalesce("k", F.lit("text")).alias("kind"))
    return lines.groupBy("kind").agg(F.count("*").alias("n"))


@query
def change_tags_pairs(spark, sf):
    t = F.array_join(fn.change_tags(F.col("a"), F.col("b")), ",")
    return _line_pairs(spark, sf).select("job_id", F.col("line_no").cast("long").alias("line_no"), t.alias("tags"))


@query
def protection_tags_pairs(spark, sf):
    t = F.array_join(fn.protection_tags(F.col("a"), F.col("b")), ",")
    return _line_pairs(spark, sf).select("job_id", F.col("line_no").cast("long").alias("line_no"), t.alias("tags"))


@query
def technical_type_pairs(spark, sf):
    a, b = F.col("a"), F.col("b")
    return _line_pairs(spark, sf).select(
        "job_id", F.col("line_no").cast("long").alias("line_no"), fn.dash_equivalent(a, b).alias("dash"), fn.technical_type(a, b).alias("technical_type")
    )


@query
def numbering_words(spark, sf):
    w = _docs(spark, sf).select(F.explode(F.split("text", r"[ \n]")).alias("w"))
    return w.filter(fn.is_numbering(F.col("w"))).groupBy("w").agg(F.count("*").alias("n"))


@query
def model_answers(spark, sf):
    """Decisions read back from fenced answers made of the events."""
    e = read_table(spark, sf, "events")
    body = F.concat(F.lit('```json\n{"decisions":[{"candidate_id":"e'), F.col("event_id").cast("string"), F.lit('","category":"technical","confidence":0.5}]}\n```'))
    d = fn.decisions(F.when(F.col("event_type") == "error", F.lit("no json")).otherwise(body))
    return e.select("event_id", F.size(d).alias("s"), F.get(d, F.lit(0))["candidate_id"].alias("candidate_id")).select("event_id", F.when(F.col("s") > 0, F.col("s")).cast("long").alias("n"), "candidate_id")


# ---- diff engine ----------------------------------------------------------


@query
def block_segments(spark, sf):
    b = segment.page_blocks(F.col("text"))
    return _docs(spark, sf).select("doc_id", F.posexplode(b).alias("pos", "b")).groupBy("doc_id", F.col("b.kind").alias("kind")).agg(F.count("*").alias("n"), F.sum(F.length("b.text")).alias("chars"))


@query
def special_blocks(spark, sf):
    b = segment.page_blocks(F.col("text"))
    rows = _docs(spark, sf).select("doc_id", F.inline(b)).filter("kind <> 'paragraph'")
    return rows.groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query
def block_neighbours(spark, sf):
    p = views.doc_pages(views.doc_pairs(spark, sf))
    rows = segment.blocks(p)
    return rows.select("job_id", F.col("side").cast("int").alias("side"), "index", F.col("b.page").alias("page"), F.col("b.block").alias("block"), F.sha2(F.concat_ws("|", "b.previous", "b.text", "b.next").cast("binary"), 256).alias("sha"))


@query
def pair_verdict_literal(spark, sf):
    same = literal_key(F.col("text1")) == literal_key(F.col("text2"))
    return views.doc_pairs(spark, sf).groupBy(F.when(same, "identical").otherwise("different").alias("verdict")).agg(F.count("*").alias("n"))


@query
def identity_short_circuit(spark, sf):
    return segment.document_keys(views.doc_pages(views.doc_pairs(spark, sf)))


def _comparison(spark, sf) -> plan.Comparison:
    return plan.compare(views.doc_pages(views.doc_pairs(spark, sf)))


@query
def block_alignments(spark, sf):
    p = plan.dealt(views.doc_pages(views.doc_pairs(spark, sf)))
    a = align.alignments(segment.blocks(p))
    return a.select("job_id", "alignment_id", "op", F.col("left.text").alias("left_text"), F.col("right.text").alias("right_text"))


@query
def token_candidates(spark, sf):
    c = _comparison(spark, sf).candidates
    return c.select("job_id", "candidate_id", "alignment_id", "file1_line", "file2_line", "change_position", F.array_join("change_tags", ",").alias("tags"), "file1_page", "file2_page", "file1_block", "file2_block")


@query
def candidate_results(spark, sf):
    d = _comparison(spark, sf).decisions.filter("include_in_result")
    return d.select("job_id", F.to_json(tokendiff.result_view()).alias("result"))


@query
def classified_candidates(spark, sf):
    d = _comparison(spark, sf).decisions
    return d.select("job_id", "candidate_id", "category", "technical_type", "reason", "confidence", F.array_join("protection_tags", ",").alias("protection"), "classified_by", "include_in_result")


@query
def classification_batches(spark, sf):
    c = _comparison(spark, sf).candidates
    return classify.batches(c).groupBy("job_id", "batch_index").agg(F.count("*").alias("n"))


@query
def job_verdicts(spark, sf):
    return _comparison(spark, sf).verdicts


@query
def category_counts(spark, sf):
    return classify.summary(_comparison(spark, sf).decisions)


@query
def dedupe_lines(spark, sf):
    """E7 over the differing lines of every pair, all in one alignment."""
    rows = _line_pairs(spark, sf).select(
        "job_id", F.lit(1).alias("alignment_id"), F.col("line_no").alias("sort_order"), F.format_string("%s:%05d", "job_id", "line_no").alias("candidate_id"), F.col("a").alias("changed1"), F.col("b").alias("changed2")
    )
    return classify.duplicates(rows).select("job_id", "candidate_id", "duplicate_of")


@query
def alignment_texts(spark, sf):
    """What the alignments of a job hold of each side, in order; no block may be lost, doubled or moved."""
    a = align.alignments(segment.blocks(plan.dealt(views.doc_pages(views.doc_pairs(spark, sf)))))
    sides = F.array(*(F.struct(F.lit(n).alias("side"), F.col(f"{s}.text").alias("text")) for n, s in ((1, "left"), (2, "right"))))
    rows = a.select("job_id", "alignment_id", F.inline(sides)).filter("text IS NOT NULL")
    by = rows.groupBy("job_id", "side").agg(F.array_sort(F.collect_list(F.struct("alignment_id", "text"))).alias("all"))
    t = F.array_join(F.transform("all", lambda x: x["text"]), " ")
    return by.select("job_id", "side", F.length(t).cast("long").alias("n"), F.sha2(t.cast("binary"), 256).alias("sha"))


@query
def batch_packing_lines(spark, sf):
    """D14 over the differing lines of every pair, as candidates whose evidence they are."""
    none = [F.lit("").alias(f"{c}{s}") for c in ("previous", "next") for s in (1, 2)]
    rows = _line_pairs(spark, sf).select("job_id", F.col("line_no").alias("sort_order"), F.format_string("%s:%05d", "job_id", "line_no").alias("candidate_id"), F.col("a").alias("evidence1"), F.col("b").alias("evidence2"), *none)
    return classify.batches(rows).select("job_id", "candidate_id", F.col("batch_index").cast("long").alias("batch_index"))


def _decorated(spark, sf) -> DataFrame:
    """Candidates made of the first word of each document, with one of ten decorations by its id."""
    d = _docs(spark, sf).select("doc_id", F.regexp_extract("text", "([A-Za-z]+)", 1).alias("w")).filter("w <> ''")
    k = F.col("doc_id") % 10
    pick = lambda *values: F.element_at(F.array(*(v if isinstance(v, Column) else F.lit(v) for v in values)), (k + 1).cast("int"))
    w, up = F.col("w"), F.upper("w")
    c = lambda *x: F.concat(*(v if isinstance(v, Column) else F.lit(v) for v in x))
    d = d.select(
        "doc_id", F.floor(F.col("doc_id") / 20).cast("string").alias("job_id"), F.floor(F.col("doc_id") / 2).cast("int").alias("alignment_id"), F.col("doc_id").cast("int").alias("sort_order"),
        pick(c(w, " – x"), "4.1.", "•", "##", "12", up, c("**", w, "**"), w, c("1) ", w), "—").alias("changed1"),
        pick(c(w, " - x"), "", "", "", "", "", w, c(w, "x"), w, "").alias("changed2"),
        pick("middle", "start", "start", "middle", "whole_block", "whole_block", "middle", "middle", "start", "whole_block").alias("change_position"),
        pick("", "", "", "", "", c(up, " ", up), "", "", "", "—").alias("near"),
    )
    flat = {f"{c}{s}": F.lit("") for c in ("previous", "next") for s in (1, 2)} | {f"file{s}_{c}": F.lit(1) for c in ("page", "block") for s in (1, 2)} | {f"file{s}_page_block_count": F.lit(9) for s in (1, 2)} | {f"file{s}_was_ocr": F.lit(False) for s in (1, 2)}
    d = d.withColumns(flat | {"evidence1": F.when(F.col("near") != "", F.col("near")).otherwise(F.col("changed1")), "evidence2": F.col("changed2"), "change_tags": F.array(F.lit("literal"))})
    return d.withColumns({"candidate_id": F.concat(F.lit("c"), F.col("doc_id").cast("string")), "file1_line": F.col("changed1"), "file2_line": F.col("changed2")})


@query
def technical_rules(spark, sf):
    """E5, C12-C16 over decorated words."""
    return _decorated(spark, sf).select("doc_id", fn.technical_rule().alias("technical_type"))


@query
def group_technical(spark, sf):
    """Alignments of two decorated words each, merged where the first one is equal but for decoration."""
    m = classify.merged_groups(classify.grouped_rules(_decorated(spark, sf)))
    return m.select("alignment_id", "sort_order", "group_type", "changed1", "changed2")


@query
def fallback_decisions(spark, sf):
    """Batches of four events without an answer, or with one that is no JSON."""
    e = read_table(spark, sf, "events").select("event_id", "event_type", F.floor(F.col("event_id") / 4).cast("int").alias("batch_index"))
    expected = e.select(F.lit("j").alias("job_id"), "batch_index", F.col("event_id").cast("string").alias("candidate_id"), F.lit("x").alias("left_change"), F.lit("y").alias("right_change"))
    answers = e.groupBy("batch_index").agg(F.max("event_type").alias("t")).select(F.lit("j").alias("job_id"), "batch_index", F.when(F.col("t") == "view", F.lit(None).cast("string")).otherwise(F.lit("sorry")).alias("content"))
    return classify.validated(expected, answers).select("candidate_id", "category", "technical_type", "reason", "confidence", "classified_by", "parse_ok")


@query
def candidate_ids(spark, sf):
    """Positions and ids of candidates, over the lines of orders."""
    rows = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("job_id"), (F.col("l_linenumber") % 3).alias("alignment_id"), F.col("l_linenumber").alias("ord"))
    return tokendiff.number(rows).select("job_id", F.col("ord").cast("long").alias("ord"), F.col("sort_order").cast("long").alias("sort_order"), "candidate_id")


def _decided(spark, sf) -> DataFrame:
    """Events as decided candidates of one job per user."""
    e = read_table(spark, sf, "events")
    category = F.when(F.col("event_type").isin("signup", "view"), "technical").when(F.col("event_type") == "click", "ocr_uncertain").when(F.col("event_type") == "error", "alignment_error").otherwise("substantive")
    by = F.when(F.col("event_type") == "signup", "deterministic").when(F.col("event_type") == "view", "llm").when(F.col("event_type") == "click", "fallback").otherwise("alignment_retry")
    shown = (F.col("event_id") % 3 > 0) & ((F.col("user_id") % 5 > 0) | (category == "technical")) & (F.col("user_id") % 7 > 0)
    return e.select(F.col("user_id").cast("string").alias("job_id"), category.alias("category"), by.alias("classified_by"), shown.alias("include_in_result"))


@query
def shown_counts(spark, sf):
    """E13, E15 over decided events."""
    return classify.summary(_decided(spark, sf))


@query
def event_verdicts(spark, sf):
    """All three verdicts, jobs without shown candidates among them."""
    d = _decided(spark, sf)
    return classify.verdicts(d.select("job_id").distinct(), d)


@query
def safety_gate(spark, sf):
    """E12 over the differing lines, as if a model had called each technical."""
    rows = _line_pairs(spark, sf).select(
        "job_id", F.col("line_no").cast("long").alias("line_no"), F.col("a").alias("changed1"), F.col("b").alias("changed2"), F.lit("technical").alias("category"), F.lit("dash").alias("technical_type"), F.lit("r").alias("reason"), F.lit("llm").alias("classified_by")
    )
    return classify.gated(rows).select("job_id", "line_no", "category", "technical_type", "classified_by", "reason")


@query
def validate_batch(spark, sf):
    """Batches of six events; answers of batches with an error event are wrong in one field."""
    e = read_table(spark, sf, "events").select("event_id", "event_type", F.floor(F.col("event_id") / 6).cast("int").alias("batch_index"))
    expected = e.select(F.lit("j").alias("job_id"), "batch_index", F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("candidate_id"), F.lit("x").alias("left_change"), F.lit(None).cast("string").alias("right_change"))
    item = F.struct(
        F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("candidate_id"), F.when(F.col("event_type") == "error", "wrong").otherwise("substantive").alias("category"),
        F.lit("x").alias("left_change"), F.lit(" r ").alias("reason"), F.lit(1.5).alias("confidence"),
    )
    answers = e.groupBy("batch_index").agg(F.to_json(F.struct(F.collect_list(item).alias("decisions"))).alias("content")).select(F.lit("j").alias("job_id"), "batch_index", "content")
    out = classify.validated(expected, answers)
    return out.groupBy("category", "reason", "classified_by", "parse_ok").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))


# ---- page store -----------------------------------------------------------


@query
def chunk_completeness(spark, sf):
    return pages.stored_chunks(views.conv_chunks(spark, sf))


@query
def document_assembly(spark, sf):
    c = views.conv_chunks(spark, sf)
    p = c.select("job_id", "side", "page_number", "text", F.when(F.col("page_number") % 2 == 0, F.concat(F.lit("n"), F.col("page_number").cast("string"))).otherwise("").alias("filename"), (F.col("page_number") == 3).alias("is_missing"))
    d = pages.documents(p)
    return d.select("job_id", F.col("side").cast("int").alias("side"), "filename", F.col("n_pages").cast("long").alias("n_pages"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


@query
def page_upserts(spark, sf):
    """Lines of an order as writes to one of seven pages; the last shipment wins."""
    li = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("page_number"), (F.col("l_partkey") % 2 + 1).cast("int").alias("side"), "l_shipdate", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    return pages.latest(li, ["job_id", "page_number", "side"], F.struct("l_shipdate", "l_partkey", "l_suppkey", "q")).select("job_id", "page_number", "side", "l_partkey")


@query
def terminal_skip(spark, sf):
    chunks = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("chunk_index"))
    left = pages.not_terminal(chunks, views.jobs_of_orders(spark, sf))
    return left.groupBy("job_id").agg(F.count("*").alias("n"))


@query
def ready_jobs(spark, sf):
    return pages.ready(views.jobs_of_orders(spark, sf)).select("job_id", "user_id")


# ---- jobs -----------------------------------------------------------------


@query
def upsert_job_current(spark, sf):
    return jobs.current_jobs(views.job_log(spark, sf)).select("job_id", "status", "total_chunks", "message", "file1_name", "file2_name", F.col("state_version").cast("long").alias("n_writes"))


@query
def total_chunks_max(spark, sf):
    j = jobs.current_jobs(views.job_log(spark, sf))
    return j.select("job_id", F.col("total_chunks").cast("long").alias("total_chunks"), "created_at", "updated_at")


@query
def list_jobs_by_owner(spark, sf):
    j = jobs.numbered(views.jobs_of_orders(spark, sf).withColumn("o", F.col("job_id")).withColumn("job_id", F.col("user_id")), [F.desc("created_at"), "o"], "position")
    return j.select("user_id", F.col("o").alias("job_id"), F.col("position").cast("long").alias("position"))


@query
def latest_result(spark, sf):
    o = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("result_id"), F.col("o_orderdate").alias("created_at"), "o_orderstatus")
    return jobs.latest_result(o).select("job_id", "result_id", "o_orderstatus")


@query
def events_after(spark, sf):
    e = jobs.numbered(views.job_log(spark, sf).select("job_id", "ts", F.col("seq").alias("event_id")), ["ts", "event_id"], "seq")
    return jobs.events_after(e, 50).select("job_id", "event_id", F.col("seq").cast("long").alias("seq"))


@query
def run_numbers(spark, sf):
    r = views.job_log(spark, sf).filter("status = 'ocr_ready'").select("job_id", "ts", F.col("seq").alias("event_id"))
    return jobs.numbered(r, ["ts", "event_id"], "run_number").groupBy("job_id").agg(F.max("run_number").cast("long").alias("runs"))


@query
def state_transitions(spark, sf):
    from pyspark.sql import Window

    log = views.job_log(spark, sf)
    prev = F.lag("status").over(Window.partitionBy("job_id").orderBy("ts", "seq"))
    rows = log.select(prev.alias("from_status"), F.col("status").alias("to_status")).filter("from_status IS NOT NULL")
    return rows.groupBy("from_status", "to_status").agg(F.count("*").alias("n")).select("*", jobs.is_legal(F.col("from_status"), F.col("to_status")).alias("legal"))


@query
def state_replay(spark, sf):
    r = jobs.replay(views.job_log(spark, sf))
    return r.select("job_id", "status", F.col("moves").cast("long").alias("moves"), F.col("illegal").cast("long").alias("illegal"))


@query
def recover_leases(spark, sf):
    j = views.jobs_of_orders(spark, sf)
    runs = j.filter("status = 'comparing'").select("job_id", F.lit("running").alias("status"), F.lit(None).cast("string").alias("error_message"))
    at = F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")
    failed, again = jobs.recover(runs, j, at, "w1")
    return failed.select("job_id", F.col("status").alias("run_status"), "error_message").join(again.select("job_id", F.col("status").alias("job_status"), "comparison_claimed"), "job_id")


@query
def job_progress(spark, sf):
    li = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("chunk_index"), F.lit(4).alias("total_chunks"))
    return jobs.progress(li).select("job_id", F.col("done").cast("long").alias("done"), "complete", "progress_text")


@query
def guarded_status(spark, sf):
    """B14 over the orders: a failure for every second job."""
    j = views.jobs_of_orders(spark, sf).select("job_id", "status", F.lit("m").alias("message"), F.lit(None).cast("string").alias("failure_code"), F.lit(None).cast("timestamp_ntz").alias("failed_at"), "comparison_claimed", "lease_owner", F.lit(1).alias("state_version"))
    ch = j.filter("job_id % 2 = 0").select("job_id", F.lit("failed").alias("new_status"), F.lit("x").alias("new_message"), as_of().alias("at"), F.lit(True).alias("release"))
    return jobs.set_status(j, ch)


def _jobs(spark, sf) -> DataFrame:
    """Orders as jobs with all columns of a claim."""
    j = views.jobs_of_orders(spark, sf)
    return j.withColumns({"cancel_requested_at": F.when(F.col("job_id") % 11 == 0, F.col("created_at")), "lease_epoch": F.lit(0), "state_version": F.lit(1)})


@query
def claim_winners(spark, sf):
    """Lines of an order as bids of their suppliers; the first shipment wins."""
    bids = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.concat(F.lit("w"), F.col("l_suppkey").cast("string")).alias("owner"), F.col("l_shipdate").alias("at"))
    return jobs.claims(_jobs(spark, sf), bids, as_of()).select("job_id", "status", "lease_owner", F.col("lease_epoch").cast("long").alias("lease_epoch"), "lease_expires_at")


@query
def run_numbers_continued(spark, sf):
    """New runs after those that a job has already."""
    log = views.job_log(spark, sf).select("job_id", "ts", F.col("seq").alias("event_id"), "status")
    last = log.filter("status = 'ocr_ready'").groupBy("job_id").agg(F.count("*").cast("int").alias("last"))
    new = log.filter("status = 'failed'").drop("status")
    return jobs.numbered(new, ["ts", "event_id"], "run_number", last).select("event_id", F.col("run_number").cast("long").alias("run_number"))


@query
def event_append(spark, sf):
    """Sequence numbers that go on after last_event_seq."""
    o = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("job_id"), (F.col("o_orderkey") % 4).cast("int").alias("last_event_seq"))
    e = read_table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("line"))
    _, after = jobs.append_events(o, e, ["line"])
    return after.select("job_id", F.col("last_event_seq").cast("long").alias("last_event_seq"))


@query
def transition_moves(spark, sf):
    """Every order is asked to move; versions, from-states, codes and first times are kept or refused."""
    none = F.lit(None).cast("timestamp_ntz")
    j = _jobs(spark, sf).select("job_id", "status", F.lit("m").alias("message"), F.lit(None).cast("string").alias("failure_code"), (F.col("job_id") % 3).cast("int").alias("state_version"), none.alias("failed_at"), F.when(F.col("job_id") % 2 == 0, F.col("created_at")).alias("completed_at"))
    k = F.col("job_id")
    moves = j.select(
        "job_id", F.when(k % 2 == 0, "completed").when(k % 5 == 0, "failed").otherwise("comparing").alias("to_status"), F.when(k % 3 == 0, 0).when(k % 3 == 1, 2).cast("int").alias("expected_version"),
        F.when(k % 4 < 2, "comparing").alias("from_status"), F.when(k % 6 == 0, "done").otherwise("").alias("message"), F.when(k % 5 == 0, "x").alias("failure_code"), as_of().alias("at"),
    )
    return jobs.transition(j, moves).withColumn("state_version", F.col("state_version").cast("long"))


@query
def progress_states(spark, sf):
    """events as the calls of a progress tracker."""
    op = {"signup": "ensure", "view": "chunk", "click": "done", "purchase": "set", "error": "fail"}
    status = {"signup": "queued", "purchase": "comparing"}
    by = lambda of: F.try_element_at(F.create_map(*(F.lit(x) for kv in of.items() for x in kv)), F.col("event_type"))
    log = read_table(spark, sf, "events").select(F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("seq"), by(op).alias("op"), by(status).alias("status"), (F.col("event_id") % 4).cast("int").alias("total_chunks"), (F.col("event_id") % 6).cast("int").alias("chunk_index"))
    r = jobs.progress_states(log)
    return r.select("job_id", "status", *(F.col(c).cast("long").alias(c) for c in ("total_chunks", "processed_chunks", "completions")))


@query
def page_pair_save(spark, sf):
    """Conversations as jobs whose pages were stored."""
    c = views.conv_chunks(spark, sf)
    stored = pages.stored_chunks(c).join(c.groupBy("job_id").agg(F.max("page_number").alias("message_total")), "job_id")
    k = F.col("job_id").cast("int") % 5
    status = F.element_at(F.array(*map(F.lit, ("queued", "processing", "cancel_requested", "completed", "failed"))), k + 1)
    j = c.select("job_id").distinct().select("job_id", status.alias("status"), (k * 2).alias("processed_chunks"), F.lit(0).alias("total_chunks"))
    r = jobs.after_pages(j, stored)
    return r.select("job_id", "status", F.col("processed_chunks").cast("long").alias("processed_chunks"), F.col("total_chunks").cast("long").alias("total_chunks"), "ready")


@query
def status_relay(spark, sf):
    """events as status messages, those of errors without a status and those of signups no JSON."""
    e = read_table(spark, sf, "events")
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("job_id"), F.lit("d").alias("document_id"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("status"), F.lit(1).alias("processed_chunks"), F.lit(2).alias("total_chunks"), F.lit("m").alias("message")))
    good, _ = streams.statuses(e.select(F.when(F.col("event_type") == "signup", "{no").otherwise(body).alias("value")))
    return good.select("job_id", "status", F.col("processed_chunks").cast("long").alias("processed_chunks"))


# ---- queues ---------------------------------------------------------------


@query
def inbox_dedupe(spark, sf):
    e = read_table(spark, sf, "events").select(F.col("event_type").alias("consumer_group"), (F.col("user_id") % 40).alias("event_id"), F.struct("ts", F.col("event_id").alias("i")).alias("received_at"))
    return queue.inbox_new(e).select("consumer_group", "event_id", F.col("received_at.i").alias("first_event"))


@query
def lease_next(spark, sf):
    r = queue.lease_next(views.work_items(spark, sf), as_of(), "w")
    return r.select("stage", "task_id", "status", F.col("attempt").cast("long").alias("attempt"), "lease_expires_at")


@query
def retry_backoff(spark, sf):
    i = views.work_items(spark, sf)
    r = queue.retry(i, as_of())
    return r.select("task_id", "status", queue.backoff(F.col("attempt")).alias("delay"))


@query
def outbox_claim(spark, sf):
    return queue.outbox_due(views.outbox(spark, sf), as_of()).select("event_id", "job_id")


@query
def outbox_claim_marked(spark, sf):
    """Claims of all rows of the outbox after one claim."""
    r = queue.outbox_claimed(views.outbox(spark, sf), as_of())
    return r.select("event_id", "claimed", "claimed_at")


@query
def outbox_lag(spark, sf):
    return queue.outbox_lag(views.outbox(spark, sf), as_of())


@query
def dead_letters(spark, sf):
    d = queue.dead_letter(views.conv_messages(spark, sf), F.lit("x" * 700))
    return d.select("job_id", "chunk_index", F.col("file1.content").alias("content1"), F.col("file1.content_chars").cast("long").alias("chars1"), F.col("file2.content_chars").cast("long").alias("chars2"), F.length("error").cast("long").alias("error_chars"))


@query
def object_digest(spark, sf):
    p = read_table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return queue.object_meta(p).select("page_id", "sha256", "size_bytes")


# ---- results --------------------------------------------------------------


def _fragments(spark, sf) -> DataFrame:
    e = read_table(spark, sf, "events")
    verdict = F.when(F.col("event_type") == "view", F.lit(None).cast("string")).when(F.col("event_type") == "error", "different").when(F.col("event_type") == "click", "content_equal").otherwise("identical")
    return e.select(
        (F.col("user_id") * 20 + F.col("event_id") % 13).cast("string").alias("job_id"), F.floor(F.col("event_id") / 13 % 3).cast("int").alias("chunk_index"), F.lit(3).alias("total_chunks"), verdict.alias("verdict"),
        F.col("event_type").isin("purchase", "signup").alias("identical"), F.when(F.col("event_type").isin("purchase", "signup"), F.array().cast("array<string>")).otherwise(F.array(F.col("event_id").cast("string"))).alias("differences"), F.col("event_id").alias("received_at"),
    )


@query
def merge_fragments(spark, sf):
    r = results.merge_fragments(_fragments(spark, sf))
    return r.select("job_id", "identical", "verdict", F.array_join("differences", ",").alias("differences"))


@query
def legacy_verdict(spark, sf):
    r = results.legacy_verdict(_fragments(spark, sf))
    return r.groupBy("identical", "verdict").agg(F.count("*").alias("n"))


# ---- streams --------------------------------------------------------------


@query
def stream_completeness(spark, sf):
    return streams.completeness_once(spark, views.conv_messages(spark, sf))


@query
def stream_dedupe(spark, sf):
    e = read_table(spark, sf, "events").select(F.col("event_type").alias("consumer_group"), (F.col("user_id") % 40).alias("event_id"))
    return streams.dedupe_once(spark, e)


@query
def stream_results(spark, sf):
    return streams.results_once(spark, _fragments(spark, sf))
