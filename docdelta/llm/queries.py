"""Registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docdelta.llm import chat, decontaminate, oracles, pieces, pii, quality_mil, quality_rules, shards, simhash, toxicity, warc
from docdelta.plans.scratch import scratch_path
from docdelta.sources.tables import read_table, widened


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widened(read_table(spark, sf_dir, "documents"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(
        "SELECT CAST(-7 AS BIGINT) conv_id, CAST(turn AS BIGINT) turn, role, text FROM VALUES "
        "(0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]') AS v(turn, role, text)"
    )
    return chat.digest(chat.expand(rows.unionByName(extra)))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign(_documents(spark, sf_dir), shards=24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_documents(spark, sf_dir))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(_documents(spark, sf_dir))


def op8_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.classify(_documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write(read_table(spark, sf_dir, "pages"), path)
    return warc.page_rows(warc.read(spark, path, payload=False, pattern="part-*"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op3_shards": op3_shards,
    "op5_simhash": op5_simhash,
    "op6_quality_rules": op6_quality_rules,
    "op7_decontaminate": op7_decontaminate,
    "op8_quality_mil": op8_quality_mil,
    "op9_warc": op9_warc,
    "op10_toxicity": op10_toxicity,
}
ORACLES = oracles.ORACLES


def pii_key(spark: SparkSession) -> str:
    """The key of the surrogates: a setting of the session; the value for the test tables where it is unset."""
    return spark.conf.get("docdelta.pii.key", "key of the test tables")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", "text")
    return pii.replace(rows, pii_key(spark), count="n_replaced")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("doc_id", "text", F.xxhash64("text").alias("h"))
    coded = pieces.encode(rows.select(F.struct("doc_id", "h").alias("k"), "text"), key="k")
    return coded.select(
        "k.doc_id", F.size("ids").cast("long").alias("n_pieces"), (F.xxhash64("decoded") == F.col("k.h")).alias("decodes"), "ids"
    )


QUERIES["op4_pii"] = op4_pii
QUERIES["op2_sentencepiece"] = op2_sentencepiece
