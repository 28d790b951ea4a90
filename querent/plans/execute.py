"""Running statements that a model wrote: queries only, with a time limit, compared as sets of rows."""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, DecimalType, NumericType, TimestampType

from querent.plans.sqljvm import is_query


@dataclass
class Outcome:
    ok: bool
    rows: DataFrame | None = None
    error: str = ""


def canonical(df: DataFrame) -> DataFrame:
    """Columns by place, numbers and booleans as doubles, all else as text, repeated rows once: what
    decides whether two results are equal, names and order aside."""
    out = []
    for i, f in enumerate(df.schema.fields):
        c = F.col(df.columns[i]) if df.columns.count(df.columns[i]) == 1 else None
        if c is None:
            df = df.toDF(*[f"_{j}" for j in range(len(df.columns))])
            return canonical(df)
        c = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, BooleanType):
            c = c.cast("int").cast("double")
        elif isinstance(f.dataType, (NumericType, DecimalType)):
            c = c.cast("double")
        elif isinstance(f.dataType, (TimestampType, DateType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        else:
            c = c.cast("string")
        out.append(c.alias(f"_{i}"))
    return df.select(*out).distinct()


def equal(a: DataFrame, b: DataFrame) -> bool:
    """Set equality of two results; nulls equal each other; other numbers of columns, not equal."""
    if len(a.columns) != len(b.columns):
        return False
    x, y = canonical(a), canonical(b)
    if [t for _, t in x.dtypes] != [t for _, t in y.dtypes]:
        x, y = (d.select(*[F.col(c).cast("string").alias(c) for c in d.columns]) for d in (x, y))
    return x.subtract(y).isEmpty() and y.subtract(x).isEmpty()


def digest(df: DataFrame) -> DataFrame:
    """One row ``arity, n, h1, h2`` that equal results share; sums of two row hashes, no order needed."""
    c = canonical(df)
    wrap = lambda x: F.sum(x.cast("decimal(38,0)")).cast("string")
    return c.agg(F.lit(len(c.columns)).alias("arity"), F.count("*").alias("n"), wrap(F.xxhash64(*c.columns)).alias("h1"), wrap(F.xxhash64(F.lit("again"), *c.columns)).alias("h2"))


def run(spark: SparkSession, sql: str, seconds: float = 60) -> Outcome:
    """Execute one query. Blank texts, writes, errors and runs over time fail, with the reason.

    The result is materialised in Spark, never on the driver; a job group of its own is cancelled
    when time is up."""
    if not (sql or "").strip():
        return Outcome(False, error="blank")
    if not is_query(spark, sql):
        return Outcome(False, error="not a query")
    group, late = f"querent-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.setJobGroup(group, "candidate query", interruptOnCancel=True)
    timer.start()
    try:
        rows = canonical(spark.sql(sql)).persist()
        rows.count()
        return Outcome(True, rows)
    except Exception as e:  # noqa: BLE001  a candidate may fail in any way
        return Outcome(False, error="timeout" if late.is_set() else str(e).splitlines()[0])
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def resultset_equality(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``only_a, only_b, equal``: rows that one result has and the other lacks."""
    x, y = canonical(a), canonical(b)
    left, right = x.subtract(y).agg(F.count("*").alias("only_a")), y.subtract(x).agg(F.count("*").alias("only_b"))
    return left.join(right, F.lit(True)).select("only_a", "only_b", ((F.col("only_a") == 0) & (F.col("only_b") == 0)).alias("equal"))
