"""Similarity of all pairs of texts within groups, by products of incidence matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querent.session import ship

#: Texts of a block, cells of a matrix of shingles, and pairs of a batch of results.
BLOCK, CELLS, PAIRS = 2000, 1 << 22, 1 << 18


def _sets(lists: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of sets, and for each member its set and its number among the known shingles, -1 for others."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    at = pc.fill_null(pc.index_in(lists.flatten(), known), -1).to_numpy(zero_copy_only=False)
    return sizes, np.repeat(np.arange(len(sizes)), sizes), at


def shared(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many members the sets of two columns of lists have in common, and in their union: matrices of ``a`` by ``b``.
    Shingles are taken in runs, so that a matrix of incidence has at most some ``CELLS`` cells."""
    known = a.flatten().unique()
    (na, ia, ja), (nb, ib, jb) = _sets(a, known), _sets(b, known)
    both = np.zeros((len(na), len(nb)), np.float32)
    step = max(1, min(len(known), CELLS // max(len(na), len(nb), 1)))
    for low in range(0, len(known), step):
        x, y = np.zeros((len(na), step), np.float32), np.zeros((len(nb), step), np.float32)
        for m, i, j in ((x, ia, ja), (y, ib, jb)):
            at = (j >= low) & (j < low + step)
            m[i[at], j[at] - low] = 1
        both += x @ y.T
    return both, na[:, None] + nb - both


def _pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """``a, b, similarity`` of the pairs of texts of two blocks, or of one, whose keys differ: the lesser key first."""
    table = table.combine_chunks()
    of_left, of_right = (table.filter(pc.equal(table.column("block"), table.column(c))) for c in ("i", "j"))
    one = table.num_rows == 0 or table.column("i")[0].as_py() == table.column("j")[0].as_py()
    a, b = (t.column("key").combine_chunks() for t in (of_left, of_right))
    ids, other = (np.asarray(x) for x in (a, b))
    left, right = (t.column("shingles").combine_chunks() for t in (of_left, of_right))
    step = max(1, PAIRS // max(1, len(other)))
    for low in range(0, len(ids), step):
        both, union = shared(left.slice(low, step), right)
        own = ids[low : low + step, None]
        # all pairs of one block come up twice, in either order
        row, col = np.nonzero(own < other if one else own != other)
        both, union = both[row, col].astype(float), union[row, col].astype(float)
        score = np.floor(np.divide(both, union, out=np.zeros(len(both)), where=union > 0) * 1e6 + 0.5) / 1e6
        x, y = own[row, 0], other[col]
        yield pa.record_batch([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(score)], ["a", "b", "similarity"])


def all_pairs(texts: DataFrame) -> DataFrame:
    """``a, b, similarity`` of all pairs of a group with a < b, from ``group, key, shingles`` (an integer key): the Jaccard
    similarity at six digits, 0 for two empty sets.

    Every pair is a row, so the result grows with the square of a group. A group is dealt into blocks of some ``BLOCK``
    texts by the key; two blocks, or one, meet in a task, which holds their shingles and a bounded number of
    pairs. Null groups and keys have no pairs."""
    ship(texts.sparkSession)
    held = texts.filter("`group` is not null and key is not null").select("group", "key", F.array_distinct("shingles").alias("shingles"))
    largest = held.groupBy("group").count().agg(F.max("count")).first()[0] or 1
    blocks = -(-largest // BLOCK)
    dealt = held.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("group", "key", "shingles", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    kind = dict(held.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _pairs(pa.Table.from_batches(batches))

    return dealt.groupBy("group", "i", "j").applyInArrow(run, f"a {kind}, b {kind}, similarity double")
