"""Accuracy and summary aggregates over result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pct(part: F.Column, whole: F.Column) -> F.Column:
    return F.round(F.when(whole > 0, 100.0 * part / whole).otherwise(0.0), 2)


def accuracy(results: DataFrame, all_rows: bool = False) -> DataFrame:
    """One row of ``question_id, gold_ok, voted_correct, any_correct``: counts, percentages, gap.

    Shares are of questions whose gold statement ran, or of all questions."""
    ran = F.count_if("gold_ok")
    whole = F.count("*") if all_rows else ran
    voted, best = F.count_if(F.col("gold_ok") & F.col("voted_correct")), F.count_if(F.col("gold_ok") & F.col("any_correct"))
    return results.agg(whole.alias("n_questions"), voted.alias("n_voted"), best.alias("n_any"), _pct(voted, whole).alias("voted_pct"), _pct(best, whole).alias("any_pct"), _pct(best - voted, whole).alias("gap_pct"))


def histogram(results: DataFrame, *columns: str) -> DataFrame:
    """``kind, value, n``: counts of each column's values."""
    cells = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in columns])
    return results.select(F.inline(cells)).groupBy("kind", "value").agg(F.count("*").alias("n"))


def link_summary(links: DataFrame) -> DataFrame:
    """One row of ``question_id, schema_links``: questions, links, mean links a question."""
    n, total = F.count("*"), F.coalesce(F.sum(F.size("schema_links")), F.lit(0))
    return links.agg(n.alias("n_questions"), total.alias("n_links"), F.round(total / F.greatest(n, F.lit(1)), 4).alias("mean_links"))


def counts_with_total(df: DataFrame, column: str) -> DataFrame:
    """``value, n`` of each value, and one row ``TOTAL``. One pass: the total is a rollup."""
    return df.rollup(column).agg(F.count("*").alias("n"), F.grouping_id().alias("g")).select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col(column).cast("string")).alias("value"), "n")
