"""License scan, phrase collocations and divergence audit against plain versions on small tables."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from querent.llm import collocations, divergence, licenses, queries

KIND = "doc_id long, text string, lang string, source string, _row string, label string, term string, word string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, x, s, "clash", "clash", "clash", "clash") for i, t, x, s in rows], KIND)


def made(n=300, seed=3):
    rng = random.Random(seed)
    words = ["the", "of", "cc", "by", "Öl", "a1", "GPL", "x" * 40, "ñu"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", ",", "\t", "\n", "."]) for _ in range(rng.randrange(0, 30))) for _ in range(n)]
    rows = [(i % 250, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None])) for i, t in enumerate(texts)]
    rows += [(None, None, None, None), (7, "", "en", "s9"), (8, "lonely", "zz", "s1"), (9, "cc by " * 5000, "en", "s1")]
    return rows + [(500 + i, "same words of a hot group, all rights reserved", "en", "s1") for i in range(200)]


def rows_of(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


@pytest.mark.parametrize("name", ["op11_licenses", "op12_collocations", "op13_divergence"])
def test_equals_sql(spark, name, tmp_path):
    table(spark, made()).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.queries()[name](spark, str(tmp_path))
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    found = rows_of(got)
    assert sorted(columns) == sorted(got.columns) and len(found) > 3
    assert found == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["op11_licenses", "op12_collocations", "op13_divergence"])
def test_empty_table(spark, name, tmp_path):
    table(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0


def test_rules_hold_their_keyword():
    """A keyword stands in every text that its rule can match: outside of groups that may be missing."""
    assert len(licenses.RULES) > 200
    for _, label, level, keyword, pattern in licenses.RULES:
        sure = re.sub(r"\((?:[^()]|\([^()]*\))*\)[?*]", "", pattern)
        sure = re.sub(r"\([^()]*\|[^()]*\)", "", sure)
        assert re.search(rf"(?<![a-z0-9]){keyword}(?![a-z0-9?])", sure), (label, pattern)
        re.compile(pattern)
        assert 0 <= level < len(licenses.WEIGHTS)


def test_licenses(spark):
    said = {
        "Licensed under the Apache License, Version 2.0 (the \"License\")": "Apache-2.0,terms",
        "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0-or-later",
        "under the GNU General Public License, version 3": "GPL-3.0,gpl",
        "Released under CC BY-NC-SA 4.0": "CC-BY-NC-SA,cc-by",
        "This is free and unencumbered software released into the public domain.": "Unlicense",
        "ccby and general, public. license; reserved rights all": "gpl",
        "a licence plate": "",
    }
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.report(df).collect()}
    for i, (text, labels) in enumerate(said.items()):
        assert got[i].labels == labels, text
        assert got[i].score == (0.0 if not labels else got[i].score) and 0 <= got[i].score <= 1
    spans = licenses.detections(df).filter("doc_id = 2").orderBy("begin", "end").collect()
    assert [(s.label, s.begin, s.end, s.kept) for s in spans] == [("GPL-3.0", 2, 8, True), ("gpl", 3, 6, True)]


def test_containment_by_brute_force(spark):
    rng = random.Random(5)
    pieces = ["gnu", "lesser", "affero", "general public license", "version 3", "2 1", "or any later", "gpl", "cc by", "sa", "nc", "4 0", "all rights reserved", "without permission", "licensed under"]
    df = spark.createDataFrame([(i, " ".join(rng.choices(pieces, k=40))) for i in range(200)], "doc_id long, text string")
    spans = licenses.detections(df).collect()
    own = defaultdict(list)
    for s in spans:
        own[s.doc_id].append(s)
    assert len(spans) > 300 and not all(s.kept for s in spans)
    for s in spans:
        over = [o for o in own[s.doc_id] if o.begin <= s.begin and o.end >= s.end and o.level >= s.level and (o.end - o.begin, o.level, -o.rule) > (s.end - s.begin, s.level, -s.rule)]
        assert s.kept == (s.level == 0 or not over)


def test_bitmaps():
    rng = np.random.default_rng(1)
    place = np.sort(rng.choice(5000, 1500, replace=False))
    owner = rng.integers(0, 20, 1500)
    b = collocations.Bitmaps.of(owner, place, 20, 5000 // 64 + 2)
    sets = [set(place[owner == o].tolist()) for o in range(20)]
    assert b.counts().tolist() == [len(s) for s in sets]
    mine, theirs = rng.integers(0, 20, 300), rng.integers(0, 20, 300)
    met = b.moved().met(b, mine, theirs)
    assert met.counts().tolist() == [len({p + 1 for p in sets[x]} & sets[y]) for x, y in zip(mine, theirs, strict=True)]


def test_phrases_over_many_shards(spark, monkeypatch):
    """Whole counts of phrases, whatever the shards: a plain count of all of them."""
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices("a b c d e f".split(), weights=[9, 7, 3, 2, 1, 1], k=rng.randrange(1, 40))) + rng.choice([".", "!\n", ""]) + " a b", "en") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5)
    plain = Counter()
    for _, text, _ in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            plain.update(" ".join(w[i : i + k]) for k in (2, 3, 4) for i in range(len(w) - k + 1))
    monkeypatch.setattr(collocations, "SHARD", 500)
    monkeypatch.setattr(collocations, "BATCH", 64)
    monkeypatch.setattr(collocations, "HELD", 100)
    shards = collocations.written(collocations.shards(df))
    kind = "lang string, word string, f long"
    words = shards.mapInArrow(collocations._each(collocations._words, kind), kind).groupBy("lang", "word").agg({"f": "sum"}).withColumnRenamed("sum(f)", "f")
    got = {r.phrase: r.f for r in collocations.frequent(shards, words.filter("f >= 30 or word is null"), 30).collect()}
    assert got == {p: n for p, n in plain.items() if n >= 30}


def test_ands_read_about_what_phrases_have(monkeypatch):
    """Many pairs of common words, each pair rare: the blocks that ANDs read follow the pairs, not the words."""
    rng = np.random.default_rng(6)
    ids = rng.integers(0, 100, 30_000)
    words = [f"w{i}".encode() for i in range(100)]
    read, ranges = [], collocations._ranges
    monkeypatch.setattr(collocations, "_ranges", lambda begin, end: read.append(int((end - begin).sum())) or ranges(begin, end))
    every = np.full(collocations.BITS // 8, 255, np.uint8)
    got = Counter()
    for _, phrases, f in collocations._extended("en", words, ids, collocations._names("en", b"\n".join(words)), every, every, every):
        got.update(dict(zip(phrases, f.tolist(), strict=True)))
    plain = Counter(b" ".join(words[w] for w in ids[i : i + k]) for k in (2, 3, 4) for i in range(len(ids) - k + 1))
    assert got == plain
    assert sum(read) < 3 * sum(plain.values())


def test_a_phrase_is_counted_once_a_range_of_shards(spark):
    """Shards of a language lie together, so the rows of phrases don't grow with the shards."""
    df = spark.createDataFrame([(i, "one two three four", x) for i in range(400) for x in ("de", "en", "es", "fr")], "doc_id long, text string, lang string").repartition(32)
    shards = collocations.written(collocations.together(collocations.written(collocations.shards(df))))
    ranges = shards.select("lang", F.input_file_name()).distinct().count()
    assert shards.count() > 60 and ranges <= 3 * spark.sparkContext.defaultParallelism + 3


def test_outstanding_keeps_ties(spark):
    """More equal differences than ranks at the threshold: the smallest terms stay."""
    text = " ".join(f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120))
    rows = [(i, text, "en", "s1") for i in range(40)] + [(100 + i, "other words", "en", "s2") for i in range(40)]
    got = divergence.audit(table(spark, rows)).filter("part = 'term' and source = 's1'").orderBy("rank").collect()
    assert [r.item for r in got] == sorted(text.split())[:50] and len({r.value for r in got}) == 1


def test_phrases_of_some_first_words_at_a_time(monkeypatch):
    """A task holds the bitmaps of a bounded number of places, whatever its shard has, and counts the same."""
    rng = np.random.default_rng(5)
    ids = np.r_[rng.integers(0, 40, 20_000), -1, rng.integers(0, 40, 20_000), -1].astype(np.int64)
    words = [b"w%d" % i for i in range(40)]
    names = collocations._names("en", b"\n".join(words))
    every = np.full(collocations.BITS // 8, 255, np.uint8)
    sizes, of = [], collocations.Bitmaps.of

    def watched(owner, place, owners, blocks):
        sizes.append(len(place))
        return of(owner, place, owners, blocks)

    monkeypatch.setattr(collocations.Bitmaps, "of", watched)
    monkeypatch.setattr(collocations, "PLACES", 3000, raising=False)
    found = {}
    for _, phrases, f in collocations._extended("en", words, ids, names, every, every, every):
        found |= dict(zip(phrases, f.tolist(), strict=True))
    plain = Counter(b" ".join(words[w] for w in ids[i : i + k]) for k in (2, 3, 4) for i in range(len(ids) - k + 1) if (ids[i : i + k] >= 0).all())
    assert found == plain
    assert max(sizes) <= 3000
