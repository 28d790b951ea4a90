"""Queries of the corpus operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm import bpe, chat, collocations, decontam, divergence, langid, licenses, media, pii, quality, sharding, simhash, suffix_dedup
from querent.llm.common import read


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables have no media column: every row of ``embeddings`` is rendered as an image first."""
    return media.copies(media.render_table(read(spark, sf_dir, "embeddings")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(read(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return made.select("doc_id", "quality_score", "toxic_score", "keep")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read(spark, sf_dir, "documents"), shards=24)


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.expand(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(read(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(read(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), ids="ids", decoded="decoded", packed=True)
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read(spark, sf_dir, "documents"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(read(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_media, op2_suffix_dedup, op3_quality, op4_sharding, op5_decontam, op6_chat, op7_langid, op8_simhash, op9_bpe, op10_pii, op11_licenses, op12_collocations, op13_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op11_licenses": licenses.SQL, "op12_collocations": collocations.SQL, "op13_divergence": divergence.SQL}
