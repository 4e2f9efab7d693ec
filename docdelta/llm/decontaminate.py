"""Benchmark decontamination by spaced-seed hashing (native).

Texts become lower-case runs of letters and digits. Fixed masks pick some of
four neighbouring tokens and ignore the others; the picked tokens are hashed and
test hashes join training hashes. Where an item and a document share enough
seeds of one diagonal, the item is laid over the document there and compared
token by token.

An item of n tokens is reported where, in one document,
    at least ``overlap`` of its tokens agree on one diagonal, or
    at least ``overlap`` of its tokens agree on any diagonals together, counting
    only those within a window of ``WINDOW`` tokens that agrees in ``DENSE`` of
    them (so words that were put in or left out do no harm), or
    ``RUN`` tokens in a row agree.

No such pair is missed at an overlap of 60 % or more. Cut the item into fours:
one with three agreeing tokens holds a seed (111, 1101 or 1011), one with four
holds two. With two in every four and two in the rest at most
2 * floor(n / 4) + min(n mod 4, 2) tokens agree, which is below 60 % but for
n of 1, 2, 3, 5, 6 and 10; those have masks of weight one or two, which any 60 %
of them holds. Every token beyond that number is one more seed; a dense window
has two, a run more. That many seeds are asked for before a diagonal is compared.

Defined cases
    null or empty texts and items without tokens: no hit; documents of equal
    text and different ids: each is reported; rows of one id: reported together,
    once, where one of them overlaps; repeated items: each is reported; short
    items: as any other; empty tables: no rows; ties between alignments: the
    earliest position; extra columns are ignored.

Scale: the documents are read twice. They are never shuffled while the test
hashes, and then the places that were hit, stay below ``broadcast_rows`` (both
are counted first); beyond, the sides shuffle by hash or by document, where a
hash that many documents share is split by adaptive skew handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docdelta.llm.exprs import let
from docdelta.plans.scratch import materialize

# 1 marks a token that counts; what is verified locally.
MASKS = ("111", "1101", "1011")
SHORT = {1: ("1",), 2: ("11",), 3: ("11", "101"), 5: ("11", "101"), 6: ("11",), 10: ("11",)}
WINDOW, DENSE, RUN = 8, 6, 13


def tokens_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda x: x != "")


def _hash(tokens: str, at: Column, mask: str) -> Column:
    return F.xxhash64(F.lit(mask), *(F.get(tokens, at + i) for i, c in enumerate(mask) if c == "1"))


def _placed(tokens: DataFrame, keep: list[str], masks: list[str]) -> DataFrame:
    """(at, hash) of every mask at every position, beside the named columns of ``tokens`` (which has toks and n)."""
    def each(mask: str) -> Column:
        rows = F.transform(F.sequence(F.lit(0), F.col("n") - len(mask)), lambda i: F.struct(i.alias("at"), _hash("toks", i, mask).alias("hash")))
        return F.when(F.col("n") < len(mask), F.array().cast("array<struct<at:int,hash:bigint>>")).otherwise(rows)

    return tokens.select(*keep, F.explode(F.concat(*map(each, masks))).alias("p")).select(*keep, "p.at", "p.hash")


def _run(agree: Column) -> Column:
    """The longest run of agreeing tokens."""
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    def step(a: Column, x: Column) -> Column:
        now = F.when(x, a["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(agree, zero, step, lambda a: a["most"])


def _dense(agree: Column) -> Column:
    """Positions that agree within a dense window."""
    width = F.least(F.size(agree), F.lit(WINDOW))
    at = lambda j: F.filter(F.sequence(j, j + width - 1), lambda i: F.get(agree, i))
    windows = F.transform(F.sequence(F.lit(0), F.size(agree) - width), at)
    return F.flatten(F.filter(windows, lambda w: F.size(w) * WINDOW >= width * DENSE))


def find(docs: DataFrame, items: DataFrame, overlap: float = 0.6, broadcast_rows: int = 2_000_000) -> DataFrame:
    """One row per document and item that overlap: doc_id, item_id, matched, item_tokens, at."""
    test = let(items.select("item_id", F.col("text")), toks=tokens_of(F.col("text")))
    test = materialize(test.select("item_id", "toks", F.size("toks").alias("n")).filter("n > 0"), "items")
    lengths = [r["n"] for r in test.filter(F.col("n").isin(*SHORT)).select("n").distinct().collect()]  # as many as SHORT at most
    text = let(docs.select("doc_id", "text"), toks=tokens_of(F.col("text"))).select("doc_id", "toks", F.size("toks").alias("n"))

    seeds = _placed(test.filter(~F.col("n").isin(*SHORT)), ["item_id", "n"], list(MASKS))
    for n in lengths:
        seeds = seeds.union(_placed(test.filter(F.col("n") == n), ["item_id", "n"], list(SHORT[n])))
    seeds = seeds.select("hash", "item_id", F.col("n").alias("item_tokens"), F.col("at").alias("item_at"))
    n_seeds = seeds.count()
    masks = sorted({*MASKS, *(m for n in lengths for m in SHORT[n])})
    hits = _placed(text, ["doc_id"], masks).join(F.broadcast(seeds) if n_seeds <= broadcast_rows else seeds, "hash")
    places = hits.groupBy("doc_id", "item_id", "item_tokens", (F.col("at") - F.col("item_at")).alias("start")).count()
    n = F.col("item_tokens")
    sure = F.ceil(overlap * n - 1e-9) - 2 * F.floor(n / 4) - F.least(n % 4, F.lit(2))
    places = materialize(places.filter(F.col("count") >= F.when(n.isin(*SHORT), 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(2), sure)))), "places")

    by_doc = places.groupBy(F.col("doc_id").alias("id"), "item_id").agg(F.collect_set("start").alias("starts"))
    if places.count() <= broadcast_rows:
        by_doc = F.broadcast(by_doc)
    found = text.join(by_doc, F.col("doc_id").eqNullSafe(F.col("id"))).select("doc_id", F.col("toks").alias("under"), "item_id", "starts")
    found = found.join(test.select(F.col("item_id").alias("item"), "toks", "n"), F.col("item_id").eqNullSafe(F.col("item")))
    # What lies outside the document does not match.
    lay = lambda s: F.transform("toks", lambda t, i: F.when(s + i < 0, False).otherwise(F.coalesce(F.get("under", s + i) == t, F.lit(False))))
    found = let(found.select("doc_id", "item_id", "n", "starts", "toks", "under"), laid=F.transform("starts", lay))
    one = F.zip_with("starts", "laid", lambda s, a: F.struct(F.size(F.filter(a, lambda x: x)).alias("matched"), (-s).alias("minus")))
    found = let(found.select("doc_id", "item_id", "n", "starts", "laid"), one=F.array_max(one), run=F.array_max(F.transform("laid", _run)), joined=F.size(F.array_distinct(F.flatten(F.transform("laid", _dense)))))
    matched = F.greatest("one.matched", "joined")
    best = found.filter((matched >= overlap * F.col("n")) | (F.col("run") >= RUN))
    best = best.select("doc_id", "item_id", F.col("n").alias("item_tokens"), F.struct(matched.alias("matched"), F.col("one.minus").alias("minus")).alias("b"))
    best = best.groupBy("doc_id", "item_id").agg(F.max("b").alias("b"), F.max("item_tokens").alias("item_tokens"))
    return best.select(
        "doc_id", "item_id", F.col("b.matched").cast("long").alias("matched"), F.col("item_tokens").cast("long").alias("item_tokens"), (-F.col("b.minus")).cast("long").alias("at")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, limit: int = 1_000_000, **how) -> DataFrame:
    """The rows whose own text overlaps no item, whatever other rows share their doc_id."""
    name = "id" + "_" * max(map(len, docs.columns))  # no column of the documents is as long
    row = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    found = find(docs.select(row.alias("doc_id"), "text"), items, **how)
    ids = materialize(found.select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    ids = F.broadcast(ids) if ids.count() <= limit else ids
    same = F.col("doc_id").eqNullSafe(F.col(f"{name}.id")) & (F.xxhash64("text") == F.col(f"{name}.h"))
    return docs.join(ids, same, "left_anti").select(*docs.columns)
