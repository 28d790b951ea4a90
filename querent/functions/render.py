"""Schemas, profiles and prompts as text, made by column expressions in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _line(label: str, value: Column) -> Column:
    """``label: value``, null where the value is null or empty (concat_ws skips it)."""
    return F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{label}: "), value))


def profile_text(p: DataFrame) -> DataFrame:
    """Long profiles (``table, column, type, is_pk`` and statistics) with ``profile_text``."""
    has = set(p.columns)
    stats = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in ("n_rows", "null_count", "distinct_count", "min", "max", "avg", "std") if c in has]
    shape = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in ("avg_len", "min_len", "max_len") if c in has]
    shares = [F.when(F.col(f"pct_{c}").isNotNull(), F.concat(F.lit(f"{c}="), F.col(f"pct_{c}").cast("string"), F.lit("%"))) for c in ("digits", "upper", "lower", "other") if f"pct_{c}" in has]
    prefix = [F.when(F.length("common_prefix") >= 2, F.concat(F.lit("common_prefix='"), F.col("common_prefix"), F.lit("'")))] if "common_prefix" in has else []
    quoted = lambda v: F.concat(F.lit("'"), v, F.lit("'"))
    lines = [_line("Column", F.concat_ws(".", "table", "column")), _line("Declared type", F.col("type")), _line("Primary key", F.initcap(F.col("is_pk").cast("string"))), _line("Stats", F.concat_ws(", ", *stats))]
    if shape or shares or prefix:
        lines.append(_line("Shape", F.concat_ws("; ", *[F.when(x != "", x) for x in (F.concat_ws(", ", *shape), F.concat_ws(", ", *shares))], *prefix)))
    if "top_values" in has:
        lines.append(_line("Top values", F.array_join(F.transform("top_values", lambda x: F.concat(quoted(x["value"]), F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ")))
    if "samples" in has:
        lines.append(_line("Samples", F.array_join(F.transform("samples", quoted), ", ")))
    return p.withColumn("profile_text", F.concat_ws("\n", *lines))


def full_profile(profile: Column, description: Column, data_format: Column, values: Column) -> Column:
    """Profile and documentation of a column in two blocks; the second only if there is any."""
    doc = F.concat_ws("\n", _line("Description", description), _line("Data format", data_format), _line("Values", values))
    return F.concat_ws("\n\n", F.concat(F.lit("[PROFILE]\n"), F.trim(F.coalesce(profile, F.lit("")))), F.when(doc != "", F.concat(F.lit("[DEV DOC]\n"), doc)))


def column_comment(mode: str, short: Column, long: Column, full: Column) -> Column:
    """The comment behind a column: short text; long in one line of 200; or documentation (150), else
    short text, then long (150)."""
    one = lambda c, n: F.substring(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" | ")), 1, n)
    if mode == "short":
        return F.coalesce(short, F.lit(""))
    if mode == "long":
        return one(long, 200)
    tail = F.when(full.contains("[DEV DOC]"), F.ltrim(F.substring_index(full, "[DEV DOC]", -1), F.lit("\n ")))
    first = F.when(F.coalesce(tail, F.lit("")) != "", one(tail, 150)).otherwise(F.coalesce(short, F.lit("")))
    return F.concat_ws(" || ", F.when(first != "", first), F.when(one(long, 150) != "", one(long, 150)))


def schema_text(columns: DataFrame, key: list[str] | None = None, comment: str | None = None) -> DataFrame:
    """``key, schema_text``: CREATE TABLE blocks of ``table, ordinal, column, type`` and a comment column.

    Tables in order of name, columns in order of ordinal; one group is one schema, read by a prompt."""
    key = key or []
    note = F.when(F.coalesce(F.col(comment), F.lit("")) != "", F.concat(F.lit("  -- "), F.col(comment))).otherwise("") if comment else F.lit("")
    line = F.concat(F.lit("  "), "column", F.lit(" "), "type", note)
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["line"])
    tables = columns.groupBy(*key, "table").agg(F.array_join(ordered(F.struct("ordinal", line.alias("line"))), ",\n").alias("body"))
    block = F.concat(F.lit("CREATE TABLE "), "table", F.lit(" (\n"), "body", F.lit("\n);"))
    return tables.groupBy(*key).agg(F.array_join(ordered(F.struct("table", block.alias("line"))), "\n\n").alias("schema_text"))


def highlighted(columns: DataFrame, linked: DataFrame, short: DataFrame) -> DataFrame:
    """The whole schema with keys named and linked columns marked: ``table, ordinal, column, type, note``."""
    j = columns.join(linked.select("table", "column").distinct().withColumn("linked", F.lit(True)), ["table", "column"], "left").join(short, ["table", "column"], "left")
    key = F.when(F.col("is_pk"), "primary key")
    return j.withColumn("note", F.concat_ws("  ", key, F.when(F.col("linked") & (F.coalesce("short_profile", F.lit("")) != ""), F.col("short_profile")), F.when(F.col("linked"), "/* LINKED */")))


def prompt(question: Column, schema: Column, evidence: Column | None = None, examples: Column | None = None) -> Column:
    """The text that asks a generator for a statement; sections without content are left out."""
    section = lambda head, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"### {head}\n"), body))
    parts = [F.lit("Answer the question with one SQL query over the schema."), section("Schema", schema)]
    if examples is not None:
        parts.append(section("Examples", examples))
    if evidence is not None:
        parts.append(section("Hint", evidence))
    parts += [section("Question", question), F.lit("### SQL\nGive only the query.")]
    return F.concat_ws("\n\n", *parts)
