"""Choosing an answer among candidates: equal results, majorities, confidence, fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def majority(votes: DataFrame) -> DataFrame:
    """One row a question of ``question_id, idx, sql, ok, result`` (``result``: what equal results share).

    ``winner_idx, method, agreement``: the first candidate of the earliest group of two equal results
    or more (``majority``), else null (``none``). Failed candidates don't vote."""
    groups = votes.filter("ok and result is not null").groupBy("question_id", "result").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.get(F.sort_array(F.collect_list("idx")), F.lit(1)).alias("second"))
    best = groups.filter("n >= 2").groupBy("question_id").agg(F.min_by(F.struct("first", "n"), F.struct("second", "first", "result")).alias("m"))
    return votes.select("question_id").distinct().join(best, "question_id", "left").select("question_id", F.col("m.first").alias("winner_idx"), F.when(F.col("m").isNotNull(), "majority").otherwise("none").alias("method"), F.coalesce("m.n", F.lit(0)).cast("long").alias("agreement"))


def ladder(votes: DataFrame) -> DataFrame:
    """The same with fallbacks: majority, else the first valid candidate, else the first that isn't blank."""
    own = votes.groupBy("question_id").agg(F.min(F.when(F.col("ok"), F.col("idx"))).alias("valid"), F.min(F.when(F.trim("sql") != "", F.col("idx"))).alias("any"))
    m = majority(votes)
    return m.join(own, "question_id").select(
        "question_id",
        F.coalesce("winner_idx", "valid", "any").alias("winner_idx"),
        F.when(F.col("method") == "majority", "majority").when(F.col("valid").isNotNull(), "first_valid").when(F.col("any").isNotNull(), "fallback").otherwise("none").alias("method"),
        "agreement",
    )


def confidence(votes: DataFrame) -> DataFrame:
    """``question_id, first_idx, n, confidence, place``: groups of equal results, largest first, ties by first candidate."""
    groups = votes.filter("ok and result is not null").groupBy("question_id", "result").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))
    total = F.sum("n").over(Window.partitionBy("question_id"))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("n"), "first_idx"))
    return groups.select("question_id", "first_idx", "n", (F.col("n") / total).alias("confidence"), place.alias("place"))


def correction_summary(log: DataFrame) -> DataFrame:
    """``question_id, n_attempts, n_fixed, last_action`` of correction logs (``question_id, attempt, action``).

    Of several actions at the last attempt the greatest name counts."""
    return log.groupBy("question_id").agg(F.count("*").alias("n_attempts"), F.count_if(F.col("action").isin("fixed", "recovered", "success")).alias("n_fixed"), F.max_by("action", F.struct("attempt", "action")).alias("last_action"))


# The candidates' strategies (name, schema shown, profiles, examples, temperature, seed).
STRATEGIES = [
    ("wide_net", "full", "short", True, 0.0, None),
    ("deep_focus", "pruned", "full", True, 0.0, None),
    ("independent_thinker", "pruned", "long", False, 0.7, 42),
]
# End of fixed values.


def strategy_matrix(questions: DataFrame) -> DataFrame:
    """Each question with every strategy. The strategies are three rows."""
    rows = questions.sparkSession.createDataFrame(STRATEGIES, "strategy string, schema_mode string, profile_mode string, use_fewshot boolean, temperature double, seed int")
    return questions.join(F.broadcast(rows))
