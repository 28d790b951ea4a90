"""Approximate nearest neighbours: an inverted file of vectors by cells, kept as a partitioned table.

Centres of cells are fitted on a bounded sample of rows (``SAMPLE``, the least of a seeded hash, so the same rows
each time); every row lies in the cell of its nearest centre. The table is partitioned by cell, so a search
reads only the cells that its queries probe: the scan's partition filter names them. Cells are files of
many rows each and are read by as many tasks as their size asks for, so a cell that holds a third of all
rows is no single task's.

Null and zero vectors lie in cell 0 with score 0 for every query; rows of other lengths than the centres'
fail. Repeated rows are kept; ties go by row_id.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querent.operators.vector import Nearest, matrix
from querent.session import ship

#: Rows that centres are fitted on, at most.
SAMPLE = 20_000
#: Queries that travel with one scan.
BLOCK = 10_000


def fit(rows: DataFrame, cells: int, seed: int = 1, rounds: int = 12) -> np.ndarray:
    """Unit centres of at most ``cells`` cells, by spherical k-means over a bounded sample of ``row_id, vector``."""
    some = rows.filter("vector is not null").orderBy(F.xxhash64(F.lit(seed), "row_id"), "row_id").limit(SAMPLE)
    held = some.select(F.col("vector").cast("array<double>")).toArrow().column(0).combine_chunks()
    if not len(held):
        return np.zeros((1, 0))
    x = matrix(held, len(held[0].as_py()))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(length > 0, total / np.where(length > 0, length, 1), centres)
    return centres


def _placed(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``row_id, vector, cell`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = (matrix(b.column(1), centres.shape[1]) @ centres.T).argmax(axis=1)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(near.astype(np.int32))], ["row_id", "vector", "cell"])

    kind = dict(rows.dtypes)["row_id"]
    return rows.select("row_id", F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, f"row_id {kind}, vector array<double>, cell int")


def build(rows: DataFrame, path: str, cells: int = 64, seed: int = 1) -> None:
    """Write every row of ``row_id, vector`` to its cell under a path, and the centres beside them."""
    spark = rows.sparkSession
    ship(spark)
    centres = fit(rows, cells, seed)
    own = _placed(rows, centres)
    # a cell goes to several writers, by the row, so that the largest one is no single task's
    own.repartition("cell", F.pmod(F.xxhash64("row_id"), F.lit(4))).write.partitionBy("cell").mode("overwrite").parquet(f"{path}/cells")
    spark.createDataFrame([(json.dumps(centres.tolist()),)], "centres string").write.mode("overwrite").parquet(f"{path}/centres")


def append(rows: DataFrame, path: str) -> None:
    """Put further rows into the cells that are there; the centres stay."""
    spark = rows.sparkSession
    ship(spark)
    centres = read_centres(spark, path)
    own = _placed(rows, centres)
    own.repartition("cell", F.pmod(F.xxhash64("row_id"), F.lit(4))).write.partitionBy("cell").mode("append").parquet(f"{path}/cells")


def read_centres(spark: SparkSession, path: str) -> np.ndarray:
    return np.array(json.loads(spark.read.parquet(f"{path}/centres").first().centres))


def search(queries: DataFrame, path: str, k: int = 10, probes: int = 8) -> DataFrame:
    """``query_id, row_id, score, rank``: the k rows of greatest cosine among each query's ``probes`` nearest cells.

    Queries (``query_id, vector``), a set that the caller states, are counted off in blocks of ``BLOCK``;
    each block is one scan of the cells that it probes. A task multiplies a batch of a cell's rows with the
    queries that probe the cell, once, and keeps k rows a query before the shuffle that merges them."""
    spark = queries.sparkSession
    ship(spark)
    blocks = max(1, -(-queries.count() // BLOCK))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    found = [_block(dealt.filter(F.col("block") == i), path, read_centres(spark, path), k, probes).drop("cell") for i in range(blocks)]
    return reduce(DataFrame.unionByName, found)


def _block(queries: DataFrame, path: str, centres: np.ndarray, k: int, probes: int) -> DataFrame:
    """The same for at most some ``BLOCK`` queries, with the cell of each row."""
    spark = queries.sparkSession
    table = spark.read.parquet(f"{path}/cells")
    kinds = {"q": dict(queries.dtypes)["query_id"], "r": dict(table.dtypes)["row_id"]}
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).toArrow()
    ids, q = asked.column(0).combine_chunks(), matrix(asked.column(1), centres.shape[1])
    near = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes]
    probing = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
    sent = spark.sparkContext.broadcast((ids, q, probing))
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "row_id")
    rows = table.filter(F.col("cell").isin(sorted(probing))).select("row_id", "vector", "cell").mapInArrow(_scored(sent, k), f"query_id {kinds['q']}, row_id {kinds['r']}, cell int, score double, near double")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("near")


def probes_for(spark: SparkSession, path: str, target: float = 0.95, k: int = 10, sample: int = 200, seed: int = 2) -> int:
    """How many cells to probe for a share ``target`` of the k nearest rows, by exact search of a bounded sample
    of the table's own rows: the least number that reaches their neighbours' cells. Data without
    clusters need most cells, data with clusters few; no setting fits both."""
    ship(spark)
    centres = read_centres(spark, path)
    some = spark.read.parquet(f"{path}/cells").filter("vector is not null").orderBy(F.xxhash64(F.lit(seed), "row_id"), "row_id").limit(sample)
    asked = some.select(F.col("row_id").alias("query_id"), "vector").toArrow()
    queries = spark.createDataFrame(asked)
    met = _block(queries, path, centres, k + 1, len(centres)).filter("query_id <> row_id").select("query_id", "cell").collect()  # sample x k rows
    own = dict(zip(asked.column(0).to_pylist(), np.argsort(-(matrix(asked.column(1).combine_chunks(), centres.shape[1]) @ centres.T), axis=1, kind="stable"), strict=True))
    places = np.sort([int(np.flatnonzero(own[r.query_id] == r.cell)[0]) for r in met])
    return int(places[min(len(places) - 1, int(np.ceil(target * len(places))) - 1)]) + 1 if len(places) else 1


def _scored(sent, k: int):
    """A task that keeps the k best rows of each query that it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, probing = sent.value
        best = None
        for b in batches:
            best = best or Nearest(q, k, b.column(0).type)
            cells, x = np.asarray(b.column(2)), matrix(b.column(1), q.shape[1])
            for c in np.unique(cells).tolist():
                at = np.flatnonzero(cells == c)
                best.show(x[at], b.column(0).take(pa.array(at)), probing[c], c)
        if best is not None:
            of, score, cell, rows, near = best.found()
            yield pa.record_batch([ids.take(pa.array(of)), rows, pa.array(cell), pa.array(score), pa.array(near)], ["query_id", "row_id", "cell", "score", "near"])

    return run


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row ``n_queries, n_exact, n_found, recall``: which of the exact neighbours (``query_id, row_id, rank``) are found."""
    met = exact.select("query_id", "row_id").join(found.select("query_id", "row_id", F.lit(1).alias("hit")), ["query_id", "row_id"], "left")
    return met.agg(F.count_distinct("query_id").alias("n_queries"), F.count("*").alias("n_exact"), F.count("hit").alias("n_found"), F.round(F.count("hit") / F.count("*"), 4).alias("recall"))
