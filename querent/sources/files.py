"""File sources and sinks: JSON lines, results with errors, questions, column documentation, checkpoints."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from querent.functions.text import header_key

# Spellings of documentation headers, by priority.
COLUMN_HEADERS = ["original_column_name", "originalcolumnname", "column_name", "columnname", "field_name", "fieldname", "column"]
DESCRIPTION_HEADERS = ["column_description", "columndescription", "description", "column_desc", "columndesc"]
FORMAT_HEADERS = ["data_format", "dataformat", "format", "datatype"]
VALUE_HEADERS = ["value_description", "valuedescription", "values", "value_desc", "valuedesc"]
# End of fixed values.


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def read_profiles(spark: SparkSession, path: str, value: Column) -> DataFrame:
    """``key, text`` with key ``table.column``; a missing file is an empty map."""
    if not exists(spark, path):
        return spark.createDataFrame([], "key string, text string")
    return read_jsonl(spark, path).select(F.concat_ws(".", "table", "column").alias("key"), value.alias("text"))


def short_text() -> Column:
    """A short profile's raw answer before its cleaned sentence."""
    return F.coalesce(F.nullif("extracted_final", F.lit("")), F.nullif("short_profile_en", F.lit("")), F.lit(""))


def first_per_group(df: DataFrame, group: str, order: str, limit: int) -> DataFrame:
    """The first rows of each group by an order; each task keeps ``limit`` rows a group before the shuffle."""
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= limit).drop("_k")


def questions(spark: SparkSession, path: str, db_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Questions of one database (the first ``limit``) or all (the first ``limit`` of each)."""
    q = spark.read.option("multiLine", True).json(path)
    if db_id is not None:
        q = q.filter(F.col("db_id") == db_id)
    return first_per_group(q, "db_id", "question_id", limit) if limit else q


def train_questions(spark: SparkSession, path: str, fallback: str) -> DataFrame:
    """Training questions; where that file is missing, the fallback's questions."""
    return questions(spark, path if exists(spark, path) else fallback).select("question", "SQL", "evidence", "db_id")


def remaining(todo: DataFrame, results: DataFrame, errors: DataFrame, key: str = "question_id") -> DataFrame:
    """What neither succeeded nor failed yet."""
    return todo.join(results.select(key).union(errors.select(key)).distinct(), key, "left_anti")


def combined(spark: SparkSession, pattern: str, skip: str = "all_dbs") -> DataFrame:
    """``results`` of all files that match, one row a result; files named ``skip`` are left out."""
    files = spark.read.option("multiLine", True).option("recursiveFileLookup", True).json(pattern)
    return files.filter(~F.col("_metadata.file_name").contains(skip)).select(F.explode("results").alias("r")).select("r.*")


def column_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documentation of columns from CSV files named after tables: ``table, column, column_description,
    data_format, value_description``. Headers are matched by their letters; files without a column
    name header are skipped; of repeated columns the last stays."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = None
    for s in sorted(fs.listStatus(path), key=lambda s: s.getPath().getName()):
        name = s.getPath().getName()
        if not name.endswith(".csv"):
            continue
        raw = spark.read.option("header", True).option("multiLine", True).option("encoding", _encoding(fs, s.getPath())).csv(s.getPath().toString())
        known = {k: c for c, k in zip(raw.columns, raw.sparkSession.createDataFrame([(raw.columns,)], "h array<string>").select(F.transform("h", header_key)).first()[0], strict=True)}
        pick = lambda options: next((F.trim(F.col("`" + known[o].replace("`", "``") + "`")) for o in options if o in known), None)
        column = pick(COLUMN_HEADERS)
        if column is None:
            continue
        texts = [(pick(o) if pick(o) is not None else F.lit(None).cast("string")).alias(a) for o, a in ((DESCRIPTION_HEADERS, "column_description"), (FORMAT_HEADERS, "data_format"), (VALUE_HEADERS, "value_description"))]
        rows = raw.select(F.lit(name[:-4]).alias("table"), column.alias("column"), *texts, F.monotonically_increasing_id().alias("_at")).filter("column <> ''")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return spark.createDataFrame([], "table string, column string, column_description string, data_format string, value_description string")
    last = Window.partitionBy("table", "column").orderBy(F.desc("_at"))
    return out.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k", "_at")


def _encoding(fs: object, path: object) -> str:
    """UTF-8 if the first kilobyte reads as such, else Latin-1."""
    stream = fs.open(path)
    try:
        head = bytes(stream.read() for _ in range(min(1024, fs.getFileStatus(path).getLen())))
    finally:
        stream.close()
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        return "UTF-8" if e.start >= len(head) - 3 and len(head) == 1024 else "ISO-8859-1"
    return "UTF-8"


def save_results(results: DataFrame, errors: DataFrame, path: str, metadata: dict[str, str] | None = None) -> None:
    """Results and errors side by side, with a sidecar of metadata."""
    results.write.mode("append").json(f"{path}/results")
    errors.write.mode("append").json(f"{path}/errors")
    if metadata:
        results.sparkSession.createDataFrame([(metadata,)], "metadata map<string,string>").write.mode("overwrite").json(f"{path}/metadata")


def commit_results(results: DataFrame, errors: DataFrame, path: str, batch: str | None = None) -> bool:
    """Append a batch of results and errors, which count together from the moment that its marker is there.

    A batch whose marker exists is left alone (false), one that was broken off is written anew; so a retry
    adds nothing twice, and a crash between results and errors adds nothing. A batch has one writer at a time."""
    spark, batch = results.sparkSession, batch or uuid.uuid4().hex
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits/{batch}")
    fs = marker.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(marker):
        return False
    for name, rows in (("results", results), ("errors", errors)):
        rows.write.mode("overwrite").json(f"{path}/{name}/commit={batch}")
    return fs.createNewFile(marker)


def commits(spark: SparkSession, path: str) -> list[str]:
    """Batches that count; as many as there were appends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_commits")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def committed(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """``results`` or ``errors`` of all batches that count; none is an empty table."""
    folders = [f"{path}/{name}/commit={b}" for b in commits(spark, path)]
    return spark.read.schema(schema).json(folders) if folders else spark.createDataFrame([], schema)


def cached_vectors(texts: DataFrame, path: str, embed) -> DataFrame:
    """``text_key, vector`` of texts, kept by content: only texts that the folder lacks are embedded."""
    spark = texts.sparkSession
    keyed = texts.select("text", F.sha2("text", 256).alias("text_key")).distinct()
    have = spark.read.parquet(path) if exists(spark, path) else None
    new = keyed if have is None else keyed.join(have.select("text_key"), "text_key", "left_anti")
    new.select("text_key", embed(F.col("text")).alias("vector")).write.mode("append").parquet(path)
    return spark.read.parquet(path)
