"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in source blocks (a hash of the row). For block i and shard s the matrix holds how many
of the block's rows go to s. It is drawn exactly as a uniform random assignment would draw it:
row after row, multivariate hypergeometric over what each shard still lacks, so that rows sum to
block sizes and columns to shard sizes, which differ by at most one. Each block permutes its rows
and cuts them by its matrix row; the exchange follows; each shard permutes again, which gives
slots 0, 1, 2 ... without gaps.

Everything over rows is DataFrame code. The driver sees one count a block and draws the matrix;
blocks are a fixed number a shard, so the matrix has a size that does not grow with the rows. The
second permutation ranks within sub-blocks of a shard and adds the sub-blocks' offsets, so no task
sorts a whole shard.

Cases: null text has no bytes (size 8, crc32 of nothing: 0); a null doc_id is a value like any
other; repeated rows each get their own slot; with fewer rows than shards some shards are empty;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import random
from math import lgamma

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querent.llm.common import cut

#: Source blocks, and sub-blocks of a shard, whatever the size of the input.
BLOCKS, SUB_BLOCKS = 512, 64


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` without replacement are good; by inversion from the mode outwards."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low

    def log_choose(n: int, k: int) -> float:
        return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    total = log_choose(good + bad, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    from math import exp

    p = exp(log_choose(good, mode) + log_choose(bad, draws - mode) - total)
    u = rng.random() - p
    left = right = mode
    pl = pr = p
    while u > 0 and (left > low or right < high):
        if right < high:
            pr *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= pr
            if u <= 0:
                return right
        if left > low:
            pl *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= pl
            if u <= 0:
                return left
    return mode


def matrix(blocks: list[int], shards: int, seed: int) -> list[list[int]]:
    """Exact counts block by shard. Columns sum to the shards' sizes, at most one apart."""
    rng = random.Random(seed)
    n = sum(blocks)
    lacking = [n // shards + (s < n % shards) for s in range(shards)]
    out = []
    for size in blocks:
        rest, left, row = sum(lacking), size, []
        for s in range(shards):
            k = hypergeometric(rng, lacking[s], rest - lacking[s], left)
            rest -= lacking[s]
            left -= k
            lacking[s] -= k
            row.append(k)
        out.append(row)
    return out


def shuffle(df: DataFrame, shards: int, seed: int = 1, key: str = "_row") -> DataFrame:
    """Append ``shard`` and ``slot`` to rows that carry ``key``, a 64-bit hash of the row.

    The input is checkpointed once, since both the counts and the assignment read it."""
    block = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(BLOCKS)).cast("int")
    rows = cut(df.withColumn("_block", block))
    sizes = {r["_block"]: r["n"] for r in rows.groupBy("_block").agg(F.count("*").alias("n")).collect()}
    drawn = matrix([sizes.get(i, 0) for i in range(BLOCKS)], shards, seed)
    # the matrix as one literal: row i holds the upper bounds of each shard's cut of block i
    bounds = []
    for row in drawn:
        total = 0
        for k in row:
            total += k
            bounds.append(total)
    upper = F.split(F.lit(" ".join(map(str, bounds))), " ").cast("array<bigint>")
    spark = df.sparkSession
    lookup = spark.range(1).select(F.posexplode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("_block", "_b")).select("_block", F.slice(upper, F.col("_block") * shards + 1, shards).alias("_upper"))
    within = Window.partitionBy("_block").orderBy(F.xxhash64(F.col(key), F.lit(seed + 1)), F.col(key))
    sent = (
        rows.withColumn("_at", F.row_number().over(within).cast("long"))
        .join(F.broadcast(lookup), "_block")  # BLOCKS rows
        .withColumn("shard", F.size(F.filter("_upper", lambda u: u < F.col("_at"))).cast("int"))
        .withColumn("_sub", F.pmod(F.xxhash64(F.col(key), F.lit(seed + 2)), F.lit(SUB_BLOCKS)).cast("int"))
        .drop("_upper", "_at", "_block")
    )
    sent = cut(sent)
    before = Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sent.groupBy("shard", "_sub").agg(F.count("*").alias("_n")).withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    last = Window.partitionBy("shard", "_sub").orderBy(F.xxhash64(F.col(key), F.lit(seed + 3)), F.col(key))
    return (
        sent.withColumn("_rank", F.row_number().over(last).cast("long") - 1)
        .join(F.broadcast(offsets), ["shard", "_sub"])  # shards x SUB_BLOCKS rows
        .withColumn("slot", F.col("_offset") + F.col("_rank"))
        .drop("_sub", "_rank", "_offset")
    )


def assign(docs: DataFrame, shards: int = 24, seed: int = 1) -> DataFrame:
    """Place every document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn("_row", F.xxhash64("doc_id", "size", "text_crc32"))
    return shuffle(rows, shards, seed).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
