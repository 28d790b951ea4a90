"""A corpus from raw documents: what is bad, repeated, leaked or private goes, the rest is tokenised.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm import bpe, decontam, pii, quality, simhash
from querent.llm.common import read, shared_folder


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier calls good and not toxic."""
    return quality.keep(docs, quality.learn(docs, read(spark, sf_dir, "labels")))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 and more."""
    return simhash.dedup(docs, shingle=5, distance=4, similarity=0.8)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ids="ids", decoded="decoded")
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == whole).alias("round_trip"))


STAGES = [("quality", good), ("near_dedup", single), ("decontamination", unleaked), ("personal_data", private), ("tokens", tokens)]

#: Training, linear algebra and tokenising are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a data set."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:  # the stage before is read no more
            gone = spark._jvm.org.apache.hadoop.fs.Path(before)
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
        before = path
    return docs
