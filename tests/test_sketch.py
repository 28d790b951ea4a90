"""Sketches of batches: merging equals the whole, bounds hold, appended batches need no rescan."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from querent.operators import sketch

KIND = "n int, x double, s string, d date, void string, `odd ``name` long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    return [(rng.randrange(-500, 500) if rng.random() > 0.1 else None, 1e6 + rng.gauss(0, 3), f"v{min(rng.randrange(200), rng.randrange(200))}", None, None, i) for i in range(6000)]


def test_merged_equals_whole(spark, rows):
    df = spark.createDataFrame(rows, KIND).repartition(3)
    parts = [df.filter(F.col("`odd ``name`") % 4 == i) for i in range(4)] + [df.limit(0)]
    one = {r.column: r for r in sketch.estimates(sketch.merged(sketch.sketch(df))).collect()}
    many = sketch.sketch(parts[0])
    for p in parts[1:]:
        many = many.unionByName(sketch.sketch(p))
    got = {r.column: r for r in sketch.estimates(sketch.merged(many)).collect()}
    assert set(got) == {"n", "x", "s", "d", "void", "odd `name"}
    for c, r in got.items():
        w = one[c]
        assert (r.n_rows, r.null_count, r.min, r.max, r.avg, r.std, r.top_values) == (w.n_rows, w.null_count, w.min, w.max, w.avg, w.std, w.top_values), c
    n = sorted(v[0] for v in rows if v[0] is not None)
    assert (got["n"].min, got["n"].max) == (str(n[0]), str(n[-1]))  # by size, not by text
    assert abs(got["n"].distinct_count - len(set(n))) <= 0.05 * len(set(n))
    for share, q in zip((0.25, 0.5, 0.75), got["n"].quantiles, strict=True):
        assert sum(v < q for v in n) / len(n) <= share + 0.01 and sum(v <= q for v in n) / len(n) >= share - 0.01
    best = sorted(Counter(v[2] for v in rows).items(), key=lambda x: (-x[1], x[0]))[:5]
    assert [(x.value, x.n) for x in got["s"].top_values] == best
    assert (got["void"].distinct_count, got["void"].quantiles, got["void"].top_values, got["d"].min) == (0, None, [], None)
    assert abs(got["x"].std - 3) < 0.2


def test_appended_batches(spark, rows, tmp_path):
    df, path = spark.createDataFrame(rows, KIND), str(tmp_path / "sketches")
    sketch.append(df.filter("n < 0"), path, "a/1")
    sketch.append(df.filter("n >= 0"), path, "b")
    sketch.append(df.filter("n is null"), path, "c")
    sketch.append(df.filter("n >= 0"), path, "b")  # a retry
    got = {r.column: r for r in sketch.estimates(sketch.stored(spark, path)).collect()}
    assert all(r.n_rows == len(rows) for r in got.values())
    assert got["n"].null_count == sum(v[0] is None for v in rows)


def test_bottom_k(spark, rows):
    df = spark.createDataFrame(rows, KIND)
    whole = sorted(tuple(r) for r in sketch.bottom(df, 30).collect())
    parts = sketch.bottom(df.filter("n < 0 or n is null"), 30).unionByName(sketch.bottom(df.filter("n >= 0"), 30))
    assert sorted(tuple(r) for r in sketch.merged_bottom(parts, 30).collect()) == whole
    assert Counter(c for c, _ in whole) == {"n": 30, "x": 30, "s": 30, "odd `name": 30}
