from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from querent.functions import render
from querent.operators import backend, correct, evaluate, link, lookup, profile, similar, vector, vote
from querent.sources import catalog, files


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_profile_nulls_and_ties(spark):
    df = spark.createDataFrame([(1, "b", None), (2, "a", None), (4, "a", None), (5, "b", 1.0), (6, None, 2.0), (7, None, 4.0)], "k int, s string, m double")
    p = {r.column: r for r in profile.long_profile(df, "k").collect()}
    assert (p["s"].n_rows, p["s"].null_count, p["s"].distinct_count, p["s"].min, p["s"].max) == (6, 2, 2, "a", "b")
    assert [(x.value, x.n) for x in p["s"].top_values] == [("a", 2), ("b", 2)]
    assert (p["m"].avg, p["m"].std) == (2.3333, 1.2472)
    assert p["s"].samples == ["b", "a", "a", "b"]


def test_profile_of_an_empty_table(spark):
    p = {r.column: r for r in profile.long_profile(spark.createDataFrame([], "k int, `odd ``name` string"), "k").collect()}
    assert p["odd `name"].n_rows == 0 and p["odd `name"].distinct_count == 0 and p["k"].min is None


@pytest.mark.parametrize(("values", "want"), [(["abc"] * 3, "abc"), (["ab1", "ab2", "ab3", "ab4", "xy5"], "ab"), (["abcd", "abce", "x"], ""), ([], None)])
def test_common_prefix(spark, values, want):
    df = spark.createDataFrame([("c", v, i) for i, v in enumerate(values)], "column string, value string, rank int")
    assert [r.common_prefix for r in profile.common_prefix(df).collect()] == ([want] if want is not None else [])


def test_lookup_prefers_exact(spark):
    values = spark.createDataFrame([("t", "c", "Alpha One"), ("t", "d", "alphabet"), ("u", "e", "zzz")], "table string, column string, value string")
    asked = spark.createDataFrame([("ALPHA ONE",), ("alphabets",)], "literal string")
    found = rows(lookup.matches(asked, values), "literal", "table", "column", "match_type")
    assert ("ALPHA ONE", "t", "c", "exact") in found and not any(f[0] == "ALPHA ONE" and f[3] != "exact" for f in found)
    assert ("alphabets", "t", "d", "approximate") in found


def test_band_recall_against_exact_similarity(spark):
    words = [f"customer number {i:03d}" for i in range(20)]
    values = spark.createDataFrame([("t", f"c{i}", w) for i, w in enumerate(words)], "table string, column string, value string")
    asked = spark.createDataFrame([(w + "x",) for w in words], "literal string")
    found = {(r.literal, r.column) for r in lookup.band_candidates(asked, values).collect()}
    assert sum((w + "x", f"c{i}") in found for i, w in enumerate(words)) >= 19


def test_top_k_is_whole_and_leaves_out_equals(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0], "a")], "query_id int, vector array<double>, own string")
    r = spark.createDataFrame([(i, [1.0, i / 10], "a" if i < 3 else "b") for i in range(6)] + [(9, [0.0, 0.0], None)], "row_id int, vector array<double>, own string")
    assert [x[0] for x in rows(vector.top_k(q, r, 3), "row_id")] == [3, 4, 5]
    assert len(rows(vector.top_k(q.drop("own"), r.drop("own"), 100), "row_id")) == 7


@pytest.mark.parametrize("own", [True, False])
def test_top_k_in_blocks_equals_broadcast(spark, own):
    r = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0], "ab"[i % 2]) for i in range(60)], "row_id int, vector array<double>, own string")
    q = r.filter("row_id % 6 = 0").withColumnRenamed("row_id", "query_id")
    if not own:
        q = q.drop("own")
    one, many = vector.top_k(q, r, 4), vector.top_k(q, r, 4, block=3)
    assert rows(one, "query_id", "rank", "row_id", "score") == rows(many, "query_id", "rank", "row_id", "score")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "Generate" not in plan


@pytest.mark.parametrize("block", [10_000, 3])
def test_top_k_compares_nine_digits_and_goes_by_id(spark, block):
    q = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(7)] + [(7, None)], "query_id int, vector array<double>")
    r = spark.createDataFrame([(5, [1.0, 0.0]), (4, [1.0, 1e-5]), (3, [2.0, 1.0]), (2, None), (1, [0.0, 0.0])], "row_id int, vector array<double>")
    got = {(x.query_id, x["rank"]): x.row_id for x in vector.top_k(q, r, 3, block=block).collect()}
    assert [got[0, i] for i in (1, 2, 3)] == [got[6, i] for i in (1, 2, 3)] == [4, 5, 3]
    assert [got[7, i] for i in (1, 2, 3)] == [1, 2, 3]


@pytest.mark.parametrize("sizes", [(2000, 1 << 22, 1 << 18), (7, 40, 11)])
def test_all_pairs_in_blocks_equal_a_join(spark, monkeypatch, sizes):
    for name, size in zip(("BLOCK", "CELLS", "PAIRS"), sizes, strict=True):
        monkeypatch.setattr(similar, name, size)
    texts = [(i % 3 or None, i if i % 10 else None, [f"s{(i * j) % 7}" for j in range(i % 5)] or None) for i in range(60)] + [(1, 4, ["x", "x", "s1"])]
    df = spark.createDataFrame(texts, "group int, key long, shingles array<string>")
    want = []
    for g, a, x in texts:
        for h, b, y in texts:
            if g is not None and g == h and a is not None and b is not None and a < b:
                x, y = set(x or []), set(y or [])
                want.append((a, b, round(len(x & y) / len(x | y), 6) if x | y else 0.0))
    got = similar.all_pairs(df)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_nearest_in_small_steps_equals_brute_force(monkeypatch):
    monkeypatch.setattr(vector.Nearest, "CELLS", 64)
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (400, 3)).astype(float)
    x = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=x.any(axis=1, keepdims=True))
    best = vector.Nearest(x[:20], 7, pa.int64())
    for low in range(0, 400, 90):
        best.show(x[low : low + 90], pa.array(range(low, min(low + 90, 400))))
    of, _, _, ids, _ = best.found()
    want = [sorted(range(400), key=lambda r: (-np.round(x[r] @ x[i], 9), r))[:7] for i in range(20)]
    assert [[r for o, r in zip(of.tolist(), ids.to_pylist(), strict=True) if o == i] for i in range(20)] == want


def test_profile_shuffles_one_histogram(spark):
    df = spark.createDataFrame([(i, str(i % 3)) for i in range(20)], "k int, s string")
    both = profile.distinct_counts(df).join(profile.top_values(df, 2).groupBy("column").count(), "column")
    both.collect()
    assert "ReusedExchange" in both._jdf.queryExecution().executedPlan().toString()


def test_samples_top_up_columns_with_nulls(spark):
    df = spark.createDataFrame([(i, None if i < 5 else f"v{i}", f"w{i}") for i in range(9)], "k int, s string, w string")
    assert rows(profile.samples(df, "k", 3), "column", "rank", "value") == sorted((c, i + 1, v) for c, vs in {"k": "012", "s": ["v5", "v6", "v7"], "w": ["w0", "w1", "w2"]}.items() for i, v in enumerate(vs))


def test_few_shots_leave_out_the_same_text(spark):
    pool = spark.createDataFrame([(1, "How many cats in 1999?"), (2, " How many cats in 1999? "), (3, "How many dogs in 2001?"), (4, "zebra")], "row_id int, question string")
    asked = spark.createDataFrame([(7, "How many cats in 1999?")], "query_id int, question string")
    assert [r.row_id for r in vector.few_shots(asked, pool, 2).orderBy("rank").collect()] == [3, 4]


def votes(spark, *results):
    return spark.createDataFrame([(1, i, "" if r == "" else "SELECT", r not in (None, ""), r or None) for i, r in enumerate(results)], "question_id int, idx int, sql string, ok boolean, result string")


@pytest.mark.parametrize(
    ("results", "winner", "method"),
    [(("x", "x", "x"), 0, "majority"), (("y", "x", "x"), 1, "majority"), (("x", "y", "z"), 0, "first_valid"), ((None, "y", "z"), 1, "first_valid"), ((None, None), 0, "fallback"), (("", ""), None, "none"), (("a", "b", "b", "a"), 1, "majority")],
)
def test_votes(spark, results, winner, method):
    r = vote.ladder(votes(spark, *results)).first()
    assert (r.winner_idx, r.method) == (winner, method)


def test_confidence(spark):
    assert rows(vote.confidence(votes(spark, "x", "y", "y", None)), "place", "first_idx", "n") == [(1, 1, 2), (2, 0, 1)]


def test_evaluation(spark):
    df = spark.createDataFrame([(1, True, True, True), (2, True, False, True), (3, False, True, True)], "question_id int, gold_ok boolean, voted_correct boolean, any_correct boolean")
    a, b = evaluate.accuracy(df).first(), evaluate.accuracy(df, all_rows=True).first()
    assert (a.n_questions, a.voted_pct, a.any_pct, a.gap_pct) == (2, 50.0, 100.0, 50.0)
    assert (b.n_questions, b.voted_pct) == (3, 33.33)
    assert evaluate.accuracy(df.limit(0)).first().voted_pct == 0.0
    assert evaluate.link_summary(spark.createDataFrame([], "question_id int, schema_links array<string>")).first().mean_links == 0


def test_seeded_order_repeats(spark, sf):
    c = catalog.catalog(spark, sf, ["orders"])
    assert rows(link.shuffled(c, 1), "place", "column") == rows(link.shuffled(c.repartition(3), 1), "place", "column") != rows(link.shuffled(c, 2), "place", "column")


def test_prompt_and_schema(spark):
    c = spark.createDataFrame([("t", 1, "b", "int", "note"), ("t", 0, "a", "string", ""), ("s", 0, "k", "int", None)], "table string, ordinal int, column string, type string, note string")
    s = render.schema_text(c, comment="note").first().schema_text
    assert s == "CREATE TABLE s (\n  k int\n);\n\nCREATE TABLE t (\n  a string,\n  b int  -- note\n);"
    p = spark.range(1).select(render.prompt(F.lit("Why?"), F.lit(s), F.lit("a hint")).alias("p")).first().p
    assert p.index("### Schema") < p.index("### Hint") < p.index("### Question\nWhy?") and "### Examples" not in p


@pytest.mark.parametrize(
    ("answers", "actions"),
    [
        (["SELECT 1"], ["success"]),
        (["no idea", "SELECT 1"], ["will_retry", "recovered", "success"]),
        (["SELECT x", "SELECT 1"], ["will_retry", "fixed"]),
        (["SELECT x"], ["will_retry", "stop"]),
        (["nothing"], ["will_retry", "will_retry", "will_retry", "exhausted"]),
        (["SELECT x", "SELECT y", "SELECT z", "SELECT w"], ["will_retry", "will_retry", "will_retry", "exhausted"]),
    ],
)
def test_corrections(spark, answers, actions):
    out = correct.corrected(spark, backend.Scripted(answers), "prompt")
    assert [x["action"] for x in out.log] == actions


def test_literal_correction(spark):
    b = backend.Scripted(["SELECT 2"])
    assert correct.literal_corrected(spark, b, "p", "SELECT 1", lambda s: ["t.c"] if s == "SELECT 1" else []) == "SELECT 2"
    assert "t.c" in b.asked[0][0]["content"]


def test_backends(spark):
    assert backend.make("scripted", answers=["a"]) is backend.make("scripted", answers=["a"])
    with pytest.raises(ValueError, match="unknown"):
        backend.make("nobody")
    m = backend.marked([{"role": "user", "content": "hi"}])
    assert m[0]["role"] == "system" and m[1]["content"].startswith("hi\nPut only")
    prompts = spark.createDataFrame([(1, "s", "u"), (2, "s", "u")], "id int, system string, user string")
    made = backend.generate(prompts, prompts.filter("id = 1"), "scripted", ["id"], answers=["ok"])
    assert rows(made, "id", "text") == [(2, "ok")]

    class Echo:
        def __init__(self, tail):
            self.tail = tail

        def generate(self, messages, max_new_tokens=512, **settings):
            return messages[-1]["content"] + self.tail

    backend.register("echo", Echo)  # known to this process alone: the maker travels with the task
    assert rows(backend.generate(prompts, prompts.limit(0), "echo", ["id"], tail="!"), "id", "text") == [(1, "u!"), (2, "u!")]
    p = spark.createDataFrame([(1, "old"), (2, "old")], "id int, profile_text string")
    once = backend.write_back(p, made, ["id"])
    assert rows(backend.write_back(once, made, ["id"]), "id", "profile_text") == [(1, "old"), (2, "ok\nold")]


def test_column_docs(spark, tmp_path):
    (tmp_path / "nation.csv").write_text(" Original_Column_Name ,Column Description,data format\nn_name,old,text\nn_name, new ,text\n,blank,x\n", encoding="utf-8")
    (tmp_path / "orders.csv").write_bytes("column,description\no_comment,prix é\n".encode("latin-1"))
    (tmp_path / "skip.csv").write_text("nothing,useful\n1,2\n")
    (tmp_path / "note.txt").write_text("column\nx\n")
    found = rows(files.column_docs(spark, str(tmp_path)), "table", "column", "column_description")
    assert found == [("nation", "n_name", "new"), ("orders", "o_comment", "prix é")]


def test_result_files(spark, tmp_path):
    for name, ids in (("links_a.json", [1, 2]), ("links_b.json", [3]), ("links_all_dbs.json", [9])):
        (tmp_path / name).write_text(json.dumps({"results": [{"question_id": i} for i in ids], "errors": [{"question_id": 99}]}))
    assert rows(files.combined(spark, f"{tmp_path}/*.json"), "question_id") == [(1,), (2,), (3,)]
    q = tmp_path / "q.json"
    q.write_text(json.dumps([{"question_id": i, "db_id": "ab"[i % 2], "question": "?"} for i in range(6)]))
    assert rows(files.questions(spark, str(q), limit=2), "question_id") == [(0,), (1,), (2,), (3,)]
    assert rows(files.questions(spark, str(q), "b", 1), "question_id") == [(1,)]
    q.write_text(json.dumps([{"question": "?", "SQL": "SELECT 1", "evidence": "", "db_id": "a"}]))
    assert files.train_questions(spark, f"{tmp_path}/none.json", str(q)).count() == 1
    todo = spark.range(4).withColumnRenamed("id", "question_id")
    assert rows(files.remaining(todo, todo.filter("question_id = 1"), todo.filter("question_id = 3")), "question_id") == [(0,), (2,)]


def test_json_lines_profiles_and_vectors(spark, tmp_path):
    df = spark.createDataFrame([("t", "a", "raw", "s."), ("t", "b", "", "s."), ("t", "c", None, None)], "table string, column string, extracted_final string, short_profile_en string")
    files.write_jsonl(df, f"{tmp_path}/p")
    files.write_jsonl(df.limit(0), f"{tmp_path}/p", append=True)
    schema = df.schema
    assert files.read_jsonl(spark, f"{tmp_path}/p", schema).count() == 3
    spark.read.schema(schema).json(f"{tmp_path}/p").createOrReplaceTempView("p")
    assert rows(spark.table("p").select(F.concat_ws(".", "table", "column").alias("k"), files.short_text().alias("t")), "k", "t") == [("t.a", "raw"), ("t.b", "s."), ("t.c", "")]
    assert files.read_profiles(spark, f"{tmp_path}/none", F.col("x")).count() == 0
    texts = spark.createDataFrame([("x",), ("y",)], "text string")
    assert files.cached_vectors(texts, f"{tmp_path}/v", vector.hashed).count() == 2
    assert files.cached_vectors(texts.union(texts), f"{tmp_path}/v", vector.hashed).count() == 2


def test_incremental_generation(spark, tmp_path):
    from querent.streaming.resume import generate_incrementally

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"id": 1, "system": "s", "user": "u"}\n{"id": 1, "system": "s", "user": "u"}\n')
    go = lambda: generate_incrementally(spark, f"{tmp_path}/in", "id int, system string, user string", f"{tmp_path}/out", f"{tmp_path}/ck", "scripted", ["id"], answers=["ok"]).awaitTermination()
    go()
    (tmp_path / "in" / "2.json").write_text('{"id": 1, "system": "s", "user": "u"}\n{"id": 2, "system": "s", "user": "u"}\n')
    go()
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "id", "text") == [(1, "ok"), (2, "ok")]


def test_containment_equals_brute_force(spark):
    """Every column that holds at least 80 of 100 of a literal's shingles is found, and no other."""
    import random

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcde é") for _ in range(n))
    values = [("t", f"c{i % 12}", word(rng.randrange(0, 30))) for i in range(400)] + [("t", "n", None)]
    asked = [word(rng.randrange(0, 12)) for _ in range(150)] + [v[2][3:17] + "b" for v in values[:60]] + [None, "", " ", "ab"]
    grams = lambda s: {s[i : i + 3] for i in range(max(1, len(s) - 2))} if s else set()
    clean = lambda s: (s or "").lower().strip(" ")
    held: dict[str, set] = {}
    for _, c, v in values:
        held.setdefault(c, set()).update(grams(clean(v)))
    want = {(x, c) for x in asked if x is not None for c, h in held.items() if grams(clean(x)) and len(grams(clean(x)) & h) * 100 >= 80 * len(grams(clean(x)))}
    index = lookup.shingle_index(spark.createDataFrame(values, "table string, column string, value string")).cache()
    got = lookup.contained(spark.createDataFrame([(x,) for x in asked], "literal string"), index)
    assert {(r.literal, r.column) for r in got.collect()} == want and len(want) > 100


@pytest.mark.parametrize("k", [1, 2, 3, 4])
def test_shingle_index_makes_no_row_a_shingle(spark, k):
    from querent.functions.shingles import kshingles

    texts = ["añ🙂" * 400_000 + "end", " AbC ", "ab", "", None, "a\x00b\x00", "xyz", "abcd" * 9, "ABCD" * 9]
    values = spark.createDataFrame([("t", f"c{i % 2}", x) for i, x in enumerate(texts)], "table string, column string, value string")
    index = lookup.shingle_index(values, k)
    want = values.select("table", "column", F.explode(kshingles(F.lower(F.trim("value")), k)).alias("shingle")).distinct()
    assert rows(index, "table", "column", "shingle") == rows(want, "table", "column", "shingle")
    assert "Generate" not in index._jdf.queryExecution().executedPlan().toString()


def test_long_texts_have_all_shingles(spark):
    from querent.functions.shingles import kshingles

    text = "añ🙂" * 50_000
    got = spark.createDataFrame([(text,), ("ab",), ("abc",)], "t string").select(kshingles(F.col("t")).alias("g")).collect()
    assert len(got[0].g) == 149_998 and got[0].g[:3] == ["añ🙂", "ñ🙂a", "🙂añ"]
    assert (got[1].g, got[2].g) == (["ab"], ["abc"])
