"""From tables to a scored answer with a scripted generator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from querent.engine import ERRORS, RESULTS, Database
from querent.operators import evaluate
from querent.operators.backend import Scripted
from querent.sources import catalog, files

NAMES = ["customer", "nation", "orders"]


@pytest.fixture(scope="module")
def db(spark, sf):
    return Database(spark, {n: catalog.table(spark, sf, n) for n in NAMES}, catalog.catalog(spark, sf, NAMES))


def test_profiles_and_descriptions(spark, db):
    p = db.long_profiles({"customer": "c_custkey"}).cache()
    assert p.count() == 14
    text = p.filter("column = 'c_mktsegment'").first().profile_text
    assert text.startswith("Column: customer.c_mktsegment\nDeclared type: string\nPrimary key: False\nStats: n_rows=150") and "Top values: '" in text and "Samples: '" in text
    docs = spark.createDataFrame([("nation", "n_name", "Its name", None, "")], "table string, column string, column_description string, data_format string, value_description string")
    full = db.full_profiles(p, docs)
    assert full.filter("column = 'n_name'").first().full_text.endswith("[DEV DOC]\nDescription: Its name")
    made = db.describe(full, full.filter("table <> 'nation'"), "scripted", answers=["###FINAL_BEGIN### a nation ###FINAL_END###"])
    assert {(r.column, r.short_profile) for r in made.collect()} == {(c, "a nation.") for c in ("n_nationkey", "n_name", "n_regionkey")}


def test_indexes_and_links(spark, db, tmp_path):
    path = str(tmp_path / "index")
    assert not Database.has_indexes(spark, path)
    db.build_indexes(db.long_profiles(), path, 100)
    assert Database.has_indexes(spark, path)
    q = spark.createDataFrame([(1, 'How many customers are in the "BUILDING" segment?')], "question_id long, question string")
    found = {(r.table, r.column) for r in db.link(q, path, 2).collect()}
    assert {("customer", "c_mktsegment"), ("customer", "c_custkey")} <= found
    names = db.missing(spark.read.parquet(f"{path}/variants"))
    assert names("SELECT count(*) FROM customer WHERE c_name = 'BUILDING'") == ["customer.c_mktsegment"]
    assert names("SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING'") == []


def test_answers_votes_and_scores(spark, db, tmp_path):
    links = spark.createDataFrame([(1, "nation", "n_name")], "question_id long, table string, column string")
    good, other = "SELECT count(*) FROM nation", "SELECT 25.0"
    a = db.answer(1, "How many nations?", links, Scripted(["SELECT 1", good, other]))
    assert (a.sql, a.method, a.agreement) == (good, "majority", 2)
    tie = db.answer(2, "?", links, Scripted(["SELECT 1", "SELECT 2", "SELECT 3", "B"]))
    assert (tie.sql, tie.method) == ("SELECT 2", "tiebreak")
    profiles = spark.createDataFrame([("nation", "n_name", "Its name.", "long text", "[DEV DOC]\nDescription: doc")], "table string, column string, short_profile string, profile_text string, full_text string")
    b = Scripted([good])
    db.answer(4, "How many?", links.withColumn("question_id", F.lit(4)), b, "a hint", "an example", profiles=profiles)
    wide, deep, lone = (a[0]["content"] for a in b.asked[:3])
    assert "n_name string  -- Its name." in wide and "c_name" in wide and "an example" in wide and "a hint" in wide
    assert "n_name string  -- Description: doc || long text" in deep and "c_name" not in deep
    assert "n_name string  -- long text\n" in lone and "an example" not in lone
    failed = db.answer(3, "?", links, Scripted(["no"]))
    assert (failed.sql, failed.method) == ("", "none")
    s = evaluate.accuracy(db.score([a, tie, failed], {1: "SELECT 25", 2: "SELECT 3", 3: "broken"})).first()
    assert (s.n_questions, s.n_voted, s.n_any) == (2, 1, 2)


def test_answers_resume(spark, db, tmp_path):
    out = str(tmp_path / "answers")
    q = spark.createDataFrame([(1, "a"), (2, "b")], "question_id long, question string")
    links = spark.createDataFrame([(1, "nation", "n_name"), (2, "nation", "n_name")], "question_id long, table string, column string")
    b = Scripted(["SELECT 1"])
    db.answer_all(q.filter("question_id = 1"), links, b, out)
    asked = len(b.asked)
    db.answer_all(q, links, b, out)
    assert len(b.asked) == 2 * asked
    assert sorted(r.question_id for r in spark.read.json(f"{out}/results").collect()) == [1, 2]


def test_batches_count_whole_or_not_at_all(spark, db, tmp_path):
    out = str(tmp_path / "answers")
    links = spark.createDataFrame([(i, "nation", "n_name") for i in range(1, 6)], "question_id long, table string, column string")
    q = spark.createDataFrame([(i, f"ask#{i}") for i in range(1, 6)], "question_id long, question string")
    asked: list[int] = []

    class Breaks(Scripted):
        """Ends the process, as it were, at one question."""

        def generate(self, messages, **settings):
            n = int(str(messages).split("ask#")[1][0])
            asked.append(n)
            if n == self.stop:
                raise KeyboardInterrupt
            return super().generate(messages, **settings)

    b = Breaks(["SELECT 1"])
    b.stop = 4
    with pytest.raises(KeyboardInterrupt):
        db.answer_all(q, links, b, out, flush=2)
    held = lambda n, k: sorted(r.question_id for r in files.committed(spark, out, n, k).collect())
    assert (held("results", RESULTS), held("errors", ERRORS)) == ([1, 2], [])  # question 3 was open
    # a batch whose results were written, but neither its errors nor its marker
    spark.createDataFrame([(3, "half", "none", 0)], RESULTS).write.json(f"{out}/results/commit=half")
    b.stop = 0
    asked.clear()
    db.answer_all(q, links, b, out, flush=2)
    assert set(asked) == {3, 4, 5}
    assert (held("results", RESULTS), held("errors", ERRORS)) == ([1, 2, 3, 4, 5], [])
    none = spark.createDataFrame([(7, "no answer")], ERRORS)
    again = spark.createDataFrame([(6, "SELECT 6", "majority", 2)], RESULTS)
    assert files.commit_results(again, none, out, "half") and not files.commit_results(again, none, out, "half")
    assert (held("results", RESULTS), held("errors", ERRORS)) == ([1, 2, 3, 4, 5, 6], [7])


def test_links_of_statements(spark, db):
    s = spark.createDataFrame([(1, "SELECT c_name || c_mktsegment FROM customer"), (1, "SELECT c_name FROM customer"), (2, "nonsense n_name FROM nation")], "question_id long, sql string")
    assert {tuple(r) for r in db.schema_links(s).collect()} == {(1, "customer", "c_name"), (1, "customer", "c_mktsegment"), (2, "nation", "n_name")}


def test_links_by_generation(spark, db):
    focused = spark.createDataFrame([("nation", "n_name")], "table string, column string")
    profiles = spark.createDataFrame([("nation", "n_name", "Its name.")], "table string, column string, short_profile string")
    variants = spark.createDataFrame([("nation", "n_name", "NATION_3")], "table string, column string, variant string")
    b = Scripted(["SELECT n_nationkey FROM nation WHERE n_name = 'NATION_3'"])
    found, chosen = db.generated_links(1, "?", focused, b, profiles, variants)
    assert {tuple(r) for r in found.collect()} == {(1, "nation", "n_name"), (1, "nation", "n_nationkey")}
    assert len(b.asked) == 15 and set(chosen) == {"focused_short", "focused_long", "full_short", "full_long", "focused_full"}
    assert "n_name string  -- Its name." in b.asked[0][0]["content"] and "c_name" not in b.asked[0][0]["content"] and "c_name" in b.asked[6][0]["content"]
