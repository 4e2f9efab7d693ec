"""A corpus pipeline of training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; its result is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docdelta.llm import decontaminate, jaccard, pieces, pii, toxicity
from docdelta.llm.queries import pii_key
from docdelta.plans.scratch import scratch_path
from docdelta.sources.tables import read_table, widened


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of sentences, learned from the labels, scores 0.5 or more go.

    Null and empty texts score 0 and stay; without labels of both classes nothing
    goes; repeated rows share their fate; an empty table stays empty; all columns
    are kept.
    """
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles agree to 0.8 or more (directly or in a chain) the smallest doc_id stays.

    Candidates are close SimHash fingerprints and min-hash bands; exact sets decide.
    Null and empty texts are one group; wholly equal rows leave one; rows without
    doc_id cannot be named as copies and stay; an empty table stays empty; all
    columns are kept.
    """
    return jaccard.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold 60 % of a benchmark item, in one place or in dense pieces, or 13 of its tokens in a row, go.

    Every row is judged by its own text, whatever its doc_id; null and empty texts
    stay; without items nothing goes; an empty table stays empty; all columns are
    kept.
    """
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities are replaced by surrogates, one for all their forms over the whole corpus; no document goes.

    Null stays null, a text without entity stays as it is to the byte; n_chars is
    that of the new text; an empty table stays empty; all columns are kept.
    """
    done = pii.replace(docs, pii_key(spark))
    return done.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else done


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as pieces: all columns but the text and its length, n_pieces, decodes (the pieces give the text back) and ids.

    Null and empty texts have no pieces (a null one does not decode to itself:
    null); repeated rows are coded each; an empty table stays empty.
    """
    names = [c for c in docs.columns if c not in ("text", "n_chars", "n_pieces", "decodes", "ids")]
    rows = docs.select(F.struct(F.xxhash64("text").alias("text"), F.col("text").isNull().alias("ids"), *names).alias("k"), "text")
    coded = pieces.encode(rows, key="k")
    decodes = F.when(~F.col("k.ids"), F.xxhash64("decoded") == F.col("k.text"))
    return coded.select(*(F.col("k").getField(c).alias(c) for c in names), F.size("ids").cast("long").alias("n_pieces"), decodes.alias("decodes"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_near_duplicates", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii_surrogates", replace_pii),
    ("sentencepiece", encode_pieces),
]

#: No SQL counterpart: a learned model, XXH64 fingerprints and a vocabulary are not SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, one written table after the other."""
    docs = widened(read_table(spark, sf_dir, "documents"))
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
