"""Schema linking: which tables and columns a question needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["table", "column"]


def with_primary_keys(focused: DataFrame, catalog: DataFrame) -> DataFrame:
    """Focused columns and all primary keys of their tables: ``question_id, table, column``."""
    keys = focused.select("question_id", "table").distinct().join(catalog.filter("is_pk").select(*KEYS), "table")
    return focused.select("question_id", *KEYS).unionByName(keys.select("question_id", *KEYS)).distinct()


def focus(near: DataFrame, literal: DataFrame, catalog: DataFrame) -> DataFrame:
    """Columns near the question's vector, columns that hold its literals, and keys of their tables."""
    return with_primary_keys(near.select("question_id", *KEYS).unionByName(literal.select("question_id", *KEYS)).distinct(), catalog)


def pruned(catalog: DataFrame, linked: DataFrame) -> DataFrame:
    """Linked columns of each question in catalog order: ``question_id, table, ordinal, column, type``, and
    the catalog's ``comment`` where it has one."""
    noted = ["comment"] if "comment" in catalog.columns else []
    return linked.join(catalog, KEYS).select("question_id", "table", "ordinal", "column", "type", *noted)


def union_links(links: DataFrame) -> DataFrame:
    """Union of the links that candidates of all prompts gave: ``question_id, table, column``."""
    return links.select("question_id", *KEYS).distinct()


# The five prompts (name, tables, columns, profiles shown) and each prompt's
# candidates (temperature, seed of the column order).
COMBOS = [
    ("focused_short", "focused", "focused", "short"),
    ("focused_long", "focused", "focused", "long"),
    ("full_short", "all", "all", "short"),
    ("full_long", "all", "all", "long"),
    ("focused_full", "focused", "all", "full"),
]
CANDIDATES = [(0.0, None), (0.7, 1), (0.7, 2)]
# End of fixed values.


def combos(question_ids: DataFrame) -> DataFrame:
    """Each question with the five prompt settings. The settings are five rows."""
    rows = question_ids.sparkSession.createDataFrame(COMBOS, "combo string, tables string, columns string, profile_mode string")
    return question_ids.join(F.broadcast(rows))


def shown(catalog: DataFrame, focused: DataFrame, tables: str, columns: str) -> DataFrame:
    """The part of the catalog that a prompt setting shows, for one question's focused columns."""
    out = catalog
    if tables == "focused":
        out = out.join(focused.select("table").distinct(), "table", "left_semi")
    if columns == "focused":
        out = out.join(focused.select(*KEYS).distinct(), KEYS, "left_semi")
    return out


def shuffled(catalog: DataFrame, seed: int) -> DataFrame:
    """Columns of each table in a seeded order that every run repeats: ``table, column, place``."""
    from pyspark.sql import Window

    order = Window.partitionBy("table").orderBy(F.xxhash64(F.lit(seed), "table", "column"), "column")
    return catalog.select("table", "column", F.row_number().over(order).alias("place"))
