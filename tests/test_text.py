from __future__ import annotations

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querent.functions import text as T
from querent.functions.shingles import jaccard, kshingles


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("value", "want"),
    [
        (None, []),
        ("  ", []),
        ("---", ["---", ""]),
        ("O'Neil", ["O'Neil", "o'neil", "O'NEIL", "ONeil"]),
        ("3rd", ["3rd", "3RD", "3Rd"]),
        ("é_a-b!", ["é_a-b!", "É_A-B!", "É_A-B!", "é_ab"]),
    ],
)
def test_variants(spark, value, want):
    assert one(spark, T.value_variants, value) == list(dict.fromkeys(want))


@pytest.mark.parametrize(("value", "want"), [(None, []), ("", []), ("ab", ["ab"]), ("abc", ["abc"]), ("abcd", ["abc", "bcd"])])
def test_shingles(spark, value, want):
    assert one(spark, kshingles, value) == want


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(st.characters(codec="utf-8", exclude_categories=["Cs"], max_codepoint=0xFFFF, min_codepoint=32), min_size=1, max_size=20))
def test_shingle_count(spark, value):
    assert len(one(spark, kshingles, value)) == max(1, len(value) - 2)


def test_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], [])], "a array<string>, b array<string>")
    assert [round(r.j, 4) for r in df.select(jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [0.3333, 0.0]


def test_literals(spark):
    q = 'How many "Big 5 Clubs" in USA did Élise visit in 1999 with 2.5 points for The Rest?'
    assert one(spark, T.extract_literals, q) == ["Big 5 Clubs", "USA", "Big", "Clubs", "Rest", "5", "1999", "2.5"]


def test_literals_against_plain_code_on_documents(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", T.extract_literals(F.col("text")).alias("y")).collect()
    for r in rows:
        found = [m.strip() for m in re.findall(T.QUOTED, r.text)] + [m for p in (T.UPPER, T.TITLE) for m in re.findall(p, r.text) if m not in T.STOP_WORDS] + re.findall(T.NUMBER, r.text)
        assert r.y == list(dict.fromkeys(x for x in found if x))


def test_mask(spark):
    assert one(spark, T.mask_question, "List 'a b' of 1999 AND 3.5 by ABC, ID or ABCDEFG") == "List <value> of <year> AND <number> by <code>, ID or ABCDEFG"


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("x ```sql\nSELECT 1; SELECT 2\n``` y", "SELECT 1;"),
        ("think\nSELECT a\nmore\nWITH b AS (SELECT 1) SELECT * FROM b", "WITH b AS (SELECT 1) SELECT * FROM b"),
        ("so: select 1 from t\n\nbecause", "select 1 from t"),
        ("use with x as (y)", "with x as (y)"),
        ("work with Currency column", ""),
        (None, ""),
    ],
)
def test_extract_sql(spark, raw, want):
    from querent.operators.correct import statement

    assert one(spark, T.extract_sql, raw) == want
    assert statement(spark, raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [(f"a {T.FINAL_BEGIN} x {T.FINAL_END} b", "x"), (f"{T.FINAL_BEGIN}1{T.FINAL_END}{T.FINAL_BEGIN}2\n{T.FINAL_END}", "2"), (f"{T.FINAL_BEGIN} {T.FINAL_END}", f"{T.FINAL_BEGIN} {T.FINAL_END}"), (f"{T.FINAL_END} {T.FINAL_BEGIN} x", f"{T.FINAL_END} {T.FINAL_BEGIN} x"), (" plain ", "plain"), (None, "")],
)
def test_final(spark, raw, want):
    assert one(spark, T.final_answer, raw) == want


@pytest.mark.parametrize(("value", "want"), [("abc", 0.0), ("12x", 12.0), ("2013-01-05", 2013.0), (" -3.5e2z", -350.0), (".5", 0.5), ("", 0.0), (None, None)])
def test_numeric_prefix(spark, value, want):
    assert one(spark, T.numeric_prefix, value) == want


def test_one_sentence(spark):
    assert one(spark, T.one_sentence, "```a\n b```  c") == "a b c."
    long = " ".join(["w,"] * 30)
    assert one(spark, T.one_sentence, long) == " ".join(["w,"] * 25)[:-1] + "."
    assert one(spark, T.one_sentence, None) == ""


def test_option_letter(spark):
    letter = lambda c: T.option_letter(c, ["A", "B", "C"], "A")
    assert [one(spark, letter, x) for x in ("b", "The B", "none at all here: B", "")] == ["B", "B", "A", "A"]
