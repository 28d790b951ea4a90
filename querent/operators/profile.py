"""Column profiles of a table: one aggregation for plain statistics, one histogram for the rest.

Statistics that need no distinct values (rows, nulls, extremes, mean, deviation) come from a single
aggregation with partial sums. Everything about values (distinct counts, top values) comes from one
frequency table ``column, value, n``, whose rows are combined before the shuffle. Mixing both in one
aggregation would make Spark expand every row by every column and sort them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from querent.functions.text import numeric_prefix


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _rows(df: DataFrame, entries: list[Column]) -> DataFrame:
    """One row for each struct of a one-row frame."""
    return df.select(F.inline(F.array(*entries)))


def melted(df: DataFrame, columns: list[str] | None = None, key: str | None = None) -> DataFrame:
    """``column, value`` (text) of every cell, with an order key if named."""
    columns = columns or df.columns
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast("string").alias("value")) for c in columns])
    return df.select(*([F.col(quoted(key)).alias("key")] if key else []), F.inline(cells))


def plain_stats(df: DataFrame, text_numbers: bool = False, digits: int = 4) -> DataFrame:
    """``column, n_rows, null_count, min, max, avg, std`` from one pass.

    avg and std (population) are of numeric columns; with ``text_numbers`` also of texts, by their
    leading number. min and max are rendered as text."""
    aggs, out = [], []
    for i, f in enumerate(df.schema.fields):
        c = F.col(quoted(f.name))
        numeric = isinstance(f.dataType, NumericType)
        x = c.cast("double") if numeric else numeric_prefix(c.cast("string")) if text_numbers else None
        aggs += [F.count(c).alias(f"c{i}"), F.min(c).alias(f"l{i}"), F.max(c).alias(f"h{i}")]
        if x is not None:
            aggs += [F.avg(x).alias(f"a{i}"), F.stddev_pop(x).alias(f"s{i}")]
        number = lambda p, x=x, i=i: (F.round(f"{p}{i}", digits) if x is not None else F.lit(None)).cast("double")
        out.append(
            F.struct(
                F.lit(f.name).alias("column"),
                F.col("n").alias("n_rows"),
                (F.col("n") - F.col(f"c{i}")).alias("null_count"),
                F.col(f"l{i}").cast("string").alias("min"),
                F.col(f"h{i}").cast("string").alias("max"),
                number("a").alias("avg"),
                number("s").alias("std"),
            )
        )
    return _rows(df.agg(F.count("*").alias("n"), *aggs), out)


def histogram(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, value, n`` of all values that aren't null."""
    return melted(df, columns).filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``column, distinct_count``; a column of nulls counts 0.

    Counting by ``n`` keeps it in the histogram, which then equals that of the top values: a plan with
    both shuffles it once."""
    names = df.sparkSession.createDataFrame([(c,) for c in columns or df.columns], "column string")
    counted = histogram(df, columns).groupBy("column").agg(F.count_if(F.col("n") > 0).alias("distinct_count"))
    return names.join(counted, "column", "left").fillna(0, ["distinct_count"])


def distinct_limited(df: DataFrame, column: str, limit: int, *keys: str) -> DataFrame:
    """Distinct values among the first ``limit`` rows by the keys, nulls included in the limit."""
    return df.orderBy(*keys).limit(limit).agg(F.count_distinct(F.col(quoted(column))).alias("distinct_count"))


def top_values(df: DataFrame, k: int = 5, columns: list[str] | None = None) -> DataFrame:
    """``column, value, n, rank``: the k most frequent values of each column, ties by value.

    The rank filter is pushed into the sort, so each task sends k rows a column at most."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return histogram(df, columns).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def samples(df: DataFrame, key: str, n: int = 5, columns: list[str] | None = None) -> DataFrame:
    """``column, value, rank``: the first n values by the key (unique), repeats kept, nulls left out.

    The table's first n rows answer for every column that has no nulls among them. Only the other
    columns, found by a count over those rows, are melted over the whole table."""
    columns = columns or df.columns
    order = Window.partitionBy("column").orderBy("key")
    ranked = lambda rows, names: melted(rows, names, key).filter("value is not null").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).drop("key")
    head = df.select(*[F.col(quoted(c)) for c in dict.fromkeys([key, *columns])]).orderBy(F.col(quoted(key))).limit(n)
    seen = head.agg(F.count("*"), *[F.count(F.col(quoted(c))) for c in columns]).first()
    scarce = [c for c, held in zip(columns, seen[1:], strict=True) if seen[0] == n and held < n]
    near = [c for c in columns if c not in scarce]
    parts = [ranked(rows, names) for rows, names in ((head, near), (df, scarce)) if names]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def shape(sampled: DataFrame) -> DataFrame:
    """Lengths and shares of digits, upper, lower and other characters of sampled values, a column each."""
    count = lambda p: F.length(F.regexp_replace("value", f"(?U)[^{p}]", ""))
    total = F.sum(F.length("value"))
    share = lambda x: F.when(total > 0, F.round(100 * x / total, 1))
    d, u, lo = (F.sum(count(p)) for p in (r"\p{Nd}", r"\p{Lu}", r"\p{Ll}"))
    return sampled.groupBy("column").agg(
        F.round(F.avg(F.length("value")), 1).alias("avg_len"),
        F.min(F.length("value")).alias("min_len"),
        F.max(F.length("value")).alias("max_len"),
        share(d).alias("pct_digits"),
        share(u).alias("pct_upper"),
        share(lo).alias("pct_lower"),
        share(total - d - u - lo).alias("pct_other"),
    )


def common_prefix(sampled: DataFrame, coverage: float = 0.8) -> DataFrame:
    """``column, common_prefix``: the longest prefix of the first shortest value that a share of
    the sampled values has; empty if there is none. Sampled rows are few by construction."""
    candidate = sampled.groupBy("column").agg(F.min_by("value", F.struct(F.length("value"), "rank")).alias("least"))
    prefixes = candidate.filter("least <> ''").select("column", F.explode(F.transform(F.sequence(F.lit(1), F.length("least")), lambda i: F.substring("least", F.lit(1), i))).alias("prefix"))
    shared = prefixes.join(sampled, "column").groupBy("column", "prefix").agg(F.avg(F.col("value").startswith(F.col("prefix")).cast("int")).alias("share")).filter(F.col("share") >= coverage)
    best = shared.groupBy("column").agg(F.max_by("prefix", F.length("prefix")).alias("common_prefix"))
    return candidate.select("column").join(best, "column", "left").fillna("", ["common_prefix"])


def long_profile(df: DataFrame, key: str | None = None, k: int = 5, n: int = 5, shape_rows: int = 100) -> DataFrame:
    """One row a column with every statistic; with an order key also samples and shape."""
    out = plain_stats(df).join(distinct_counts(df), "column")
    top = top_values(df, k).groupBy("column").agg(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("top_values"))
    out = out.join(top, "column", "left")
    if key:
        first = samples(df, key, shape_rows)
        own = first.filter(F.col("rank") <= n).groupBy("column").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("samples"))
        out = out.join(own, "column", "left").join(shape(first), "column", "left").join(common_prefix(first), "column", "left")
    return out


def distinct_values(df: DataFrame, limit: int = 10_000, columns: list[str] | None = None) -> DataFrame:
    """``column, value``: distinct values, the first ``limit`` of each column by value."""
    order = Window.partitionBy("column").orderBy("value")
    return histogram(df, columns).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select("column", "value")
