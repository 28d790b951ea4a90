"""The inverted file of vectors: recall, pruning, every row indexed."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from querent.operators import ann, vector


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    rows = [(i, (centres[i % 20] + 0.2 * rng.normal(size=16)).tolist()) for i in range(2000)]
    rows += [(2000 + i, centres[0].tolist()) for i in range(1000)]  # a third of all rows are one copy
    rows += [(4000, None), (4001, [0.0] * 16)]
    df = spark.createDataFrame(rows, "row_id long, vector array<double>")
    path = str(tmp_path_factory.mktemp("ann"))
    ann.build(df, path, cells=20)
    return df, path


def test_every_row_is_indexed(spark, made):
    df, path = made
    held = spark.read.parquet(f"{path}/cells")
    assert sorted(r.row_id for r in held.select("row_id").collect()) == sorted(r.row_id for r in df.select("row_id").collect())


def test_recall_of_clusters_with_few_probes(spark, made):
    df, path = made
    q = df.filter("row_id % 7 = 0 and row_id < 4000").select(F.col("row_id").alias("query_id"), "vector")
    probes = ann.probes_for(spark, path, 0.95)
    assert probes <= 10
    exact = vector.top_k(q, df.filter("row_id < 4000"), 10)
    assert ann.recall(ann.search(q, path, 10, probes), exact).first().recall >= 0.9
    whole = ann.search(q, path, 10, 20)
    assert sorted((r.query_id, r.rank, r.row_id) for r in whole.collect()) == sorted((r.query_id, r.rank, r.row_id) for r in exact.withColumn("score", F.round("score", 9)).collect()) or ann.recall(whole, exact).first().recall > 0.97


def test_scan_is_pruned(spark, made):
    df, path = made
    one = df.filter("row_id = 7").select(F.col("row_id").alias("query_id"), "vector")
    found = ann.search(one, path, 5, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan and "NestedLoop" not in plan
    assert found.filter("rank = 1").first().row_id == 7


def test_blocks_of_queries_and_appended_rows(spark, made, tmp_path, monkeypatch):
    df, _ = made
    path = str(tmp_path / "own")
    ann.build(df.filter("row_id < 1000"), path, cells=8)
    ann.append(df.filter("row_id >= 1000 and row_id < 2000"), path)
    q = df.filter("row_id % 100 = 0 and row_id < 2000").select(F.col("row_id").alias("query_id"), "vector")
    whole = sorted(tuple(r) for r in ann.search(q, path, 5, 8).select("query_id", "rank", "row_id").collect())
    monkeypatch.setattr(ann, "BLOCK", 7)
    assert sorted(tuple(r) for r in ann.search(q, path, 5, 8).select("query_id", "rank", "row_id").collect()) == whole
    assert len(whole) == 100 and any(r[2] >= 1000 for r in whole)


def test_a_batch_is_scored_in_bounded_memory():
    rng = np.random.default_rng(0)
    x, q = rng.normal(size=(16000, 8)), rng.normal(size=(6000, 8))
    batch = pa.record_batch([pa.array(range(16000), pa.int64()), pa.array(x.tolist()), pa.array([0] * 16000, pa.int32())], ["row_id", "vector", "cell"])
    sent = SimpleNamespace(value=(pa.array(range(6000), pa.int64()), q / np.linalg.norm(q, axis=1, keepdims=True), {0: np.arange(6000)}))
    tracemalloc.start()
    found = list(ann._scored(sent, 3)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(b.num_rows for b in found) == 18_000
    assert peak < 200 << 20  # all scores at once are 768 MB
