"""Text expressions on columns: value variants, literals, masking, cleaning, answer extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOP_WORDS = [
    "What", "Which", "How", "Who", "When", "Where", "The", "Are", "Was",
    "Did", "Does", "Has", "Have", "List", "Find", "Show", "Give", "Tell",
    "Many", "Much", "Most", "All", "Any", "Each", "Every", "Some",
    "And", "For", "Not", "But", "With", "Than", "That", "This",
]
MASK_SKIP = ["SQL", "ID", "DB", "NULL", "AND", "OR", "NOT", "IN", "IS", "BY", "ON"]
QUOTED = r"""["']([^"']+)["']"""
UPPER = r"\b[A-Z][A-Z0-9]{1,}\b"
TITLE = r"\b[A-Z][a-z]{2,}\b"
NUMBER = r"\b\d{4}\b|\b\d+(?:\.\d+)?\b"
FINAL_BEGIN, FINAL_END = "###FINAL_BEGIN###", "###FINAL_END###"
# End of fixed values.

#: Word borders see all letters, not ASCII alone.
_U = "(?U)"


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(_U + pattern), group)


def kept(items: Column) -> Column:
    """An array without empty strings and repeats; first ones stay."""
    return F.array_distinct(F.filter(items, lambda x: x != ""))


def title(text: Column) -> Column:
    """Every run of letters: first letter upper, others lower (``O'Neil``, ``3Rd``), as one expression."""
    parts = F.regexp_extract_all(text, F.lit(r"(?U)\p{L}+|[^\p{L}]+"), 0)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), "")


def value_variants(value: Column) -> Column:
    """Raw, lower, upper, title and, if it differs, punctuation-free form; null or blank: none.

    A value of punctuation alone has the empty string among its variants."""
    s = F.trim(value)
    bare = F.regexp_replace(s, r"(?U)[^\w\s]", "")
    return F.when(s.isNull() | (s == ""), F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(s, F.lower(s), F.upper(s), title(s), bare)))


def extract_literals(text: Column) -> Column:
    """Quoted spans, all-capitals, capitalised words and numbers, in this order, without repeats."""
    words = F.array_except(F.concat(_found(text, UPPER), _found(text, TITLE)), F.array(*map(F.lit, STOP_WORDS)))
    quoted = F.transform(_found(text, QUOTED, 1), lambda x: F.trim(x))
    return kept(F.concat(quoted, words, _found(text, NUMBER)))


def sql_literals(sql: Column) -> Column:
    """Spans in single quotes, trimmed, without repeats."""
    return kept(F.transform(_found(sql, "'([^']*)'", 1), lambda x: F.trim(x)))


def mask_question(text: Column) -> Column:
    """Entities as placeholders: quoted spans, years, numbers, short codes, in this order."""
    out = F.regexp_replace(text, _U + r"""["'][^"']{1,100}["']""", "<value>")
    out = F.regexp_replace(out, _U + r"\b(?:19|20)\d{2}\b", "<year>")
    out = F.regexp_replace(out, _U + r"\b\d+(?:\.\d+)?\b", "<number>")
    return F.regexp_replace(out, _U + rf"\b(?!(?:{'|'.join(MASK_SKIP)})\b)[A-Z]{{2,6}}\b", "<code>")


def one_sentence(text: Column, words: int = 25) -> Column:
    """White space collapsed, fences dropped, at most ``words`` words, and an end mark."""
    s = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"^`+|`+$", ""), r"```|\s+", " ")
    s = F.trim(F.regexp_replace(s, r" +", " "))
    split = F.split(s, " ")
    s = F.when(F.size(split) > words, F.concat(F.regexp_replace(F.array_join(F.slice(split, 1, words), " "), r"[,.]+$", ""), F.lit("."))).otherwise(s)
    return F.when((s != "") & ~s.rlike(r"[.!?]$"), F.concat(s, F.lit("."))).otherwise(s)


def shortened(text: Column, limit: int = 3500, mark: str = "\n...[truncated]") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit)), F.lit(mark))).otherwise(text)


def final_answer(raw: Column) -> Column:
    """What stands between the last begin and the last end mark; the whole text where that is missing or blank."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    tail = F.substring_index(s, FINAL_BEGIN, -1)
    parts = F.split(tail, FINAL_END)
    block = F.regexp_replace(F.array_join(F.slice(parts, 1, F.size(parts) - 1), FINAL_END), r"^\s+|\s+$", "")
    return F.when(s.contains(FINAL_BEGIN) & tail.contains(FINAL_END) & (block != ""), block).otherwise(s)


def extract_sql(raw: Column) -> Column:
    """The statement in a model's answer: a fenced block, else from the last line that begins with
    SELECT or WITH, else from the first SELECT, else from ``WITH name AS``; cut at a blank line or
    after the first semicolon; empty if there is none."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    fenced = F.trim(F.regexp_extract(s, r"(?is)```(?:sql)?\s*(.+?)```", 1))
    line = F.regexp_extract(s, r"(?is)^(?:.*\n)?((?:SELECT|WITH)\b(?:(?!\n(?:SELECT|WITH)\b).)*)$", 1)
    first = F.regexp_extract(s, r"(?is)\bSELECT\b.*", 0)
    named = F.regexp_extract(s, r"(?is)\bWITH\b\s+\w+\s+(?:AS|RECURSIVE)\b.*", 0)
    found = F.coalesce(*[F.when(x != "", x) for x in (fenced, line, first, named)], F.lit(""))
    found = F.trim(F.regexp_extract(found, r"(?s)^(.*?)(?:\n\s*\n|$)", 1))
    return F.when(found.contains(";"), F.concat(F.substring_index(found, ";", 1), F.lit(";"))).otherwise(found)


def option_letter(raw: Column, letters: list[str], otherwise: str) -> Column:
    """The first option, in the order given, that occurs in the first ten characters."""
    head = F.upper(F.substring(F.trim(raw), 1, 10))
    return F.coalesce(*[F.when(head.contains(x), F.lit(x)) for x in letters], F.lit(otherwise))


def numeric_prefix(text: Column) -> Column:
    """A text's leading number, 0 without one: how a dynamically typed store averages texts."""
    return F.when(text.isNotNull(), F.coalesce(F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double"), F.lit(0.0)))


def header_key(name: Column) -> Column:
    """A header in lower case with letters, digits and underscores alone."""
    return F.lower(F.regexp_replace(F.trim(name), r"(?U)[^\p{L}\p{N}_]", ""))
