"""Vectors: hashing embedder, cosine top-k of a query set against all rows, few-shot retrieval."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from querent.functions.text import mask_question
from querent.session import ship


#: Length of hashed embeddings.
DIMS = 256


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


@F.pandas_udf(ArrayType(DoubleType()))
def hashed(texts: pd.Series) -> pd.Series:
    """Deterministic embedding without a model: counts of lower-case character trigrams by hash; null: zeros."""

    def one(text: str | None) -> list[float]:
        s = (text or "").lower()
        grams = [s[i : i + 3] for i in range(max(1, len(s) - 2))] if s else []
        return np.bincount([zlib.crc32(g.encode()) % DIMS for g in grams], minlength=DIMS).astype(float).tolist()

    return texts.map(one, na_action=None)


def matrix(column: pa.Array, dims: int | None = None) -> np.ndarray:
    """Vectors of unit length from a column of lists of doubles; zeros for nulls, and for vectors that hold a null.
    A vector of another length fails, as it does in SQL."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    held = column.is_valid().to_numpy(zero_copy_only=False)
    dims = dims if dims is not None else int(sizes.max(initial=0))
    if (sizes[held] != dims).any():
        raise ValueError(f"vectors of {sorted(set(sizes[held].tolist()))} places where {dims} are expected")
    out = np.zeros((len(column), dims))
    out[held] = flat.to_numpy(zero_copy_only=False).reshape(held.sum(), dims)
    if flat.null_count:
        empty = np.zeros((len(column), dims), bool)
        empty[held] = flat.is_null().to_numpy(zero_copy_only=False).reshape(held.sum(), dims)
        out[empty.any(axis=1)] = 0
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=np.zeros_like(out), where=~(length <= 0))


class Nearest:
    """The k rows of greatest cosine of each query among the rows shown so far.

    Scores come from products of matrices of at most ``CELLS`` cells. What falls short of a query's k-th score is
    dropped at once; the rest is merged when it outgrows what is kept. Scores are compared at nine digits, ties by
    id, nulls first; NaN is the greatest, as in Spark."""

    CELLS = 1 << 20

    def __init__(self, q: np.ndarray, k: int, kind: pa.DataType):
        self.q, self.k = q, k
        self.line = np.full(len(q), -np.inf)
        self.held = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32), pa.array([], kind))]
        self.kept = 0

    def show(self, x: np.ndarray, ids: pa.Array, some: np.ndarray | None = None, tag: int = 0, apart: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        """Unit rows and their ids, to the queries numbered in ``some`` or all; pairs of equal codes ``apart`` do not count."""
        own = self.q if some is None else self.q[some]
        step = max(1, self.CELLS // max(1, len(own)))
        for low in range(0, len(x) if len(own) else 0, step):
            scores = x[low : low + step] @ own.T
            line = self.line if some is None else self.line[some]
            may = ~(scores < line - 1e-9)
            if apart is not None:
                may &= apart[0][low : low + step, None] != apart[1]
            row, of = np.nonzero(may)
            score = scores[row, of]
            self.held.append((of if some is None else some[of], score, np.full(len(of), tag, np.int32), ids.take(pa.array(row + low))))
            if sum(len(h[0]) for h in self.held[1:]) > max(self.kept // 2, 1 << 14):
                self.merge()

    def merge(self) -> None:
        of, score, tag = (np.concatenate([h[i] for h in self.held]) for i in range(3))
        ids = pa.concat_arrays([h[3] for h in self.held])
        near = np.where(np.isnan(score), np.inf, np.round(score, 9))
        order = np.lexsort((pc.rank(ids, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy(), -near, of))
        place = np.arange(len(order)) - np.searchsorted(of[order], of[order])
        last = order[place == self.k - 1]
        self.line[of[last]] = near[last]
        order = order[place < self.k]
        self.held, self.kept = [(of[order], score[order], tag[order], ids.take(pa.array(order)))], len(order)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """Numbers of queries, scores, tags and ids of rows, and the scores as they are compared."""
        self.merge()
        of, score, tag, ids = self.held[0]
        return of, score, tag, ids, np.where(np.isnan(score), np.inf, np.round(score, 9) + 0.0)


def _codes(own: pa.Array, known: pa.Array) -> np.ndarray:
    """Numbers of values among the known ones, null included, -1 for others."""
    return pc.fill_null(pc.index_in(own, known), -1).to_numpy(zero_copy_only=False)


#: Queries, and cells of a matrix of rows, that are packed into one row.
ASKED, PACKED = 1000, 1 << 18
#: Neighbours that a task holds before it passes them on.
HELD = 1 << 20


def _packed(rows: int | None):
    """A task that packs vectors: ``dims, ids, own, vectors``, the matrix of unit vectors as bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def passed() -> pa.RecordBatch:
            x = np.concatenate([h[0] for h in held])
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.concat_arrays([h[i] for h in held])) for i in (1, 2)]
            held.clear()
            return pa.record_batch([pa.array([x.shape[1]], pa.int32()), *lists, pa.array([x.tobytes()], pa.binary())], ["dims", "ids", "own", "vectors"])

        for b in batches:
            x = matrix(b.column("vector"))
            if held and held[0][0].shape[1] != x.shape[1]:
                yield passed()  # a batch of nulls has no dims
            most = rows or max(1, PACKED // max(1, x.shape[1]))
            low = 0
            while low < len(x):
                n = min(len(x) - low, most - sum(len(h[0]) for h in held))
                held.append((x[low : low + n], b.column("id").slice(low, n), b.column("own").slice(low, n)))
                low += n
                if sum(len(h[0]) for h in held) >= most:
                    yield passed()
        if held:
            yield passed()

    return run


def top_k(queries: DataFrame, rows: DataFrame, k: int, block: int = 10_000) -> DataFrame:
    """``query_id, row_id, score, rank``: the k rows of greatest cosine for each query, at nine digits, ties by row_id.

    Columns ``query_id, vector`` and ``row_id, vector``; where both sides also have ``own``, rows whose
    ``own`` equals the query's are left out before the k are taken. Vectors are packed into matrices, some
    thousand a row; a task multiplies the matrices that meet and keeps k rows a query before the shuffle that
    merges them. The query set, stated by the caller, is counted: up to ``block`` queries are broadcast, and
    rows stay where they are. More are dealt into blocks of about that size, and rows into lots; each block
    meets each lot in a join, so no task holds all rows, or all queries. Null and zero vectors score 0;
    vectors of other lengths than the queries' fail."""
    spark = rows.sparkSession
    ship(spark)
    apart = "own" in queries.columns and "own" in rows.columns
    shaped = lambda df, i: df.select(F.col(i).alias("id"), (F.col("own") if apart else F.lit(0)).alias("own"), F.col("vector").cast("array<double>").alias("vector"))
    q, r = shaped(queries, "query_id"), shaped(rows, "row_id")
    kind = lambda df: "dims int, ids array<{id}>, own array<{own}>, vectors binary".format(**dict(df.dtypes))
    blocks = max(1, -(-queries.count() // block))
    q = q.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    of_queries, of_rows = _packed(ASKED), _packed(None)

    def asked(key: tuple, group: pa.Table) -> pa.Table:
        made = pa.Table.from_batches(of_queries(group.combine_chunks().to_batches()))
        return made.append_column("block", pa.array([key[0].as_py()] * len(made), pa.int64())).append_column("part", pa.array(range(len(made)), pa.int32()))

    q = q.groupBy("block").applyInArrow(asked, f"{kind(q)}, block long, part int")
    q = q.select(*[F.col(c).alias(f"q_{c}") for c in ("dims", "ids", "own", "vectors")], "block", "part")
    r = r.mapInArrow(of_rows, kind(r))
    if blocks == 1:
        met = r.join(F.broadcast(q), F.lit(True))
    else:
        lots = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // blocks)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
        r = r.withColumn("lot", F.pmod(F.xxhash64("ids"), F.lit(lots))).withColumn("block", every(blocks))
        met = r.join(q.withColumn("lot", every(lots)).hint("shuffle_hash"), ["block", "lot"])
    kinds = f"query_id {dict(queries.dtypes)['query_id']}, row_id {dict(rows.dtypes)['row_id']}, score double, near double"
    met = met.select("block", "part", "q_dims", "q_ids", "q_own", "q_vectors", "dims", "ids", "own", "vectors").mapInArrow(_scored(k, apart), kinds)
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "row_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("near")


def _scored(k: int, apart: bool):
    """A task over packed queries and rows that meet: the k best rows of each query."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}

        def passed() -> Iterator[pa.RecordBatch]:
            for ids, _, _, best in held.values():
                of, score, _, found, near = best.found()
                yield pa.record_batch([ids.take(pa.array(of)), found, pa.array(score), pa.array(near)], ["query_id", "row_id", "score", "near"])
            held.clear()

        def unpacked(b: pa.RecordBatch, i: int, side: str) -> tuple[np.ndarray, pa.Array, pa.Array]:
            ids, own = (b.column(side + c)[i].values for c in ("ids", "own"))
            return np.frombuffer(b.column(side + "vectors")[i].as_buffer(), np.float64).reshape(len(ids), -1), ids, own

        for b in batches:
            for i in range(b.num_rows):
                key = tuple(b.column(c)[i].as_py() for c in ("block", "part", "q_dims"))
                x, ids, own = unpacked(b, i, "")
                if key not in held:
                    if sum(best.kept for *_, best in held.values()) > HELD:
                        yield from passed()
                    q, q_ids, q_own = unpacked(b, i, "q_")
                    known = q_own.unique()
                    held[key] = q_ids, known, _codes(q_own, known), Nearest(q.copy(), k, ids.type)
                _, known, codes, best = held[key]
                if x.shape[1] != best.q.shape[1]:
                    if x.any() and best.q.any():
                        raise ValueError(f"vectors of {x.shape[1]} places and queries of {best.q.shape[1]}")
                    x = np.zeros((len(x), best.q.shape[1]))
                best.show(x, ids, apart=(_codes(own, known), codes) if apart else None)
        yield from passed()

    return run


def few_shots(questions: DataFrame, pool: DataFrame, k: int = 8) -> DataFrame:
    """The k pool questions (``row_id, question``) nearest to each question (``query_id, question``)
    after masking. A pool question of the same text is left out before, not after, the k are taken."""
    ship(questions.sparkSession)
    shaped = lambda df, i: df.select(i, hashed(mask_question(F.col("question"))).alias("vector"), F.sha2(F.trim("question"), 256).alias("own"))
    return top_k(shaped(questions, "query_id"), shaped(pool, "row_id"), k)
