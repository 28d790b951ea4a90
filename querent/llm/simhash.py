"""SimHash near-duplicates with pigeonhole blocks.

A fingerprint has a bit where over half the hashes of a text's word shingles have it. Fingerprints
that differ in at most d bits agree on at least B - d of B blocks, so every choice of B - d blocks
is a join key; equal keys make candidates and the Hamming distance verifies them. Equal
fingerprints are one vertex before any join. A bucket yields the edges of a spanning forest of its
close pairs rather than the pairs, which keeps connectedness whole and output linear; a bucket
with over ``TILE`` fingerprints is dealt into pairs of tiles, each pair of members meeting in one.

Cases: null or blank text has fingerprint zero and links like any other; fewer words than a shingle
make one shingle of all; null doc_id rows get a component by their fingerprint, null if it has no
other; repeated rows share a component; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querent.llm.common import cut, frugal, ship, small_batches
from querent.llm.components import components

SEED, BITS, TILE = 42, 64, 4096
#: Least hashes of a signature, and how many of them make a band.
SLOTS, ROWS = 128, 6
#: Share of the similarity sought from which signatures let a pair be verified: 0.65 for 0.8, over four standard errors less.
MAYBE = 0.8125
_ODD = np.random.default_rng(8).integers(0, 1 << 63, SLOTS, np.uint64) * np.uint64(2) + np.uint64(1)


def hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle, repeats included; only A-Z are lower-cased."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    return np.fromiter(map(partial(xxh64_intdigest, seed=SEED), grams), np.uint64, len(words) - shingle + 1)


def fingerprint(h: np.ndarray) -> int:
    """Bits set in over half of the hashes; 0 for none."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 65536):
        part = np.ascontiguousarray(h[i : i + 65536]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (ones * 2 > len(h)) if len(h) else np.zeros(BITS, bool)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns kept and ``fp`` (signed 64-bit)."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    rows = docs.select(*keep, "text")

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(hashes(t, shingle)) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(fps.view(np.int64))], [*keep, "fp"])

    return rows.mapInArrow(frugal(run), rows.drop("text").schema.add("fp", "long"))


def plan_blocks(distance: int, n: int) -> list[int]:
    """Masks of the join keys. More fingerprints get more, hence longer, keys: buckets stay small
    while every pair within the distance still shares one."""
    blocks = distance + 1
    while blocks < distance + 4 and (BITS * (blocks - distance)) // blocks < np.log2(max(n, 2)) + 2:
        blocks += 1
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(one, blocks - distance)]


def forest(members: np.ndarray, near: Callable[[np.ndarray, np.uint64], np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs that ``near`` accepts."""
    edges, rest = [], members
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            hit = near(rest, x)
            if hit.any():
                found = rest[hit]
                rest = rest[~hit]
                edges += [(int(x), int(y)) for y in found]
                frontier.extend(found)
    return edges


def dealt(keyed: DataFrame) -> DataFrame:
    """Buckets (``m, k``) of two members at least, as rows of collected ``fp``.

    A bucket of over TILE members is dealt into tiles, and every two of its tiles meet in a row."""
    sizes = keyed.groupBy("m", "k").agg(F.count("*").alias("n")).filter("n > 1")
    tiles = F.ceil(F.col("n") / (TILE / 2)).cast("int")
    own = F.when(F.col("n") > TILE, F.pmod(F.xxhash64("fp"), tiles)).otherwise(F.lit(0)).cast("int")
    meets = F.when(F.col("n") > TILE, F.sequence(F.lit(0), tiles - 1)).otherwise(F.array(F.lit(0)))
    met = keyed.join(sizes, ["m", "k"]).select("fp", "m", "k", own.alias("i"), F.explode(meets).alias("j"))
    return (
        met.groupBy("m", "k", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
        .agg(F.collect_list(F.struct("fp")).alias("members"))
        .select("members")
    )


def close_edges(points: DataFrame, distance: int) -> DataFrame:
    """``a, b``: edges that connect what chains of fingerprints (column ``fp``, distinct) within the distance connect."""
    ship(points.sparkSession)
    masks = plan_blocks(distance, points.count())
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = points.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("m", "k"))

    def run(batches):
        near = lambda rest, x: np.bitwise_count(rest ^ x) <= distance
        for b in batches:
            values = b.column(0)
            flat, offsets = values.values.field("fp").to_numpy().view(np.uint64), values.offsets.to_numpy()
            edges = [e for lo, hi in zip(offsets, offsets[1:], strict=False) for e in forest(flat[lo:hi], near)]
            pairs = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return dealt(keyed).mapInArrow(frugal(run), "a long, b long")


def least_hashes(h: np.ndarray) -> tuple[bytes, list[int]]:
    """Signature of a shingle set: 16 bits of each of SLOTS minima; and a key for each band of them."""
    least = np.full(SLOTS, 1 << 32, np.uint64)
    for i in range(0, len(h), 1024):
        least = np.minimum(least, ((h[i : i + 1024, None] * _ODD) >> np.uint64(32)).min(0))
    bands = least[: SLOTS // ROWS * ROWS].reshape(-1, ROWS)
    keys = np.zeros(len(bands), np.uint64)
    for c in bands.T:
        keys = (keys ^ c) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return (least & np.uint64(0xFFFF)).astype(np.uint16).tobytes(), keys.view(np.int64).tolist()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets; 1 for two empty ones."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def shingle_sets(points: DataFrame, wanted: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """``fp, set`` of the fingerprints wanted: the shingles' sorted hashes, from the text (``d, u, text``) that ``first`` names."""
    slot = F.pmod(F.xxhash64("d", "u"), F.lit(1 << 20)).cast("int").alias("slot")
    named = cut(wanted.join(points, "fp").select("fp", "first.d", "first.u"))
    slots = named.select(slot).distinct()  # spares the shuffle of most other texts; at most 2^20 rows
    found = texts.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi").join(named, ["d", "u"]).groupBy("fp").agg(F.first("text").alias("text"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("fp"), pa.array([np.unique(hashes(t, shingle)).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["fp", "set"])

    return found.mapInArrow(frugal(run), "fp long, set binary")


def similar_edges(points: DataFrame, similarity: float, texts: DataFrame, shingle: int) -> DataFrame:
    """``a, b``: edges that connect the fingerprints (``fp, first, sig, bands``) whose texts' shingle sets are
    similar. Members of a band meet; signatures pass what may be similar, the shingle sets themselves
    decide. Bands with equal members are one."""
    keyed = points.select("fp", F.posexplode("bands").alias("m", "k"))
    met = cut(dealt(keyed).select(F.array_sort(F.transform("members", lambda m: m["fp"])).alias("own")).distinct().select(F.xxhash64("own").alias("g"), "own"))
    members = met.select("g", F.size("own").alias("size"), F.explode("own").alias("fp"))
    sets = cut(shingle_sets(points, members.select("fp").distinct(), texts, shingle))
    carried = members.join(points.select("fp", "sig").join(sets, "fp"), "fp")
    gathered = carried.groupBy("g", "size").agg(F.collect_list(F.struct("fp", "sig", "set")).alias("members")).select("members")

    def run(batches):
        for b in batches:
            values = b.column(0)
            fps, offsets = values.values.field("fp").to_numpy(), values.offsets.to_numpy()
            sigs = np.frombuffer(b"".join(values.values.field("sig").to_pylist()), np.uint16).reshape(-1, SLOTS)
            own = values.values.field("set")

            def near(rest, x, s=sigs, own=own):
                ok = (s[rest] == s[x]).sum(1) >= MAYBE * similarity * SLOTS
                a = np.frombuffer(own[int(x)].as_buffer(), np.uint64)
                ok[ok] = [jaccard(a, np.frombuffer(own[int(y)].as_buffer(), np.uint64)) >= similarity for y in rest[ok]]
                return ok

            edges = [e for lo, hi in zip(offsets, offsets[1:], strict=False) for e in forest(np.arange(lo, hi), near)]
            pairs = fps[np.array(edges, np.int64).reshape(-1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return gathered.mapInArrow(frugal(run), "a long, b long")


def dedup(docs: DataFrame, shingle: int = 5, distance: int = 4, similarity: float = 0.8) -> DataFrame:
    """One row of each group of near copies, all columns as they are: the smallest doc_id (null last).

    Near copies are texts whose fingerprints lie within the distance. 64 bits within 4 find word
    shingle sets of similarity 0.95 and more; for all from ``similarity`` on, bands of least hashes
    of the same shingles add candidates, which the shingle sets, read again, verify. Groups are chains of links of both kinds.

    Null and blank texts are copies of each other; of rows that repeat an id and text but differ elsewhere the
    one of least hash stays; very long texts are read whole; an empty table gives no rows."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    key = (F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), F.xxhash64("text").alias("u"))

    def run(batches):
        for b in batches:
            made = []
            for t in b.column("text").to_pylist():
                h = hashes(t, shingle)
                made.append((fingerprint(h), *least_hashes(h)))
            fps = np.array([m[0] for m in made], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("d"), b.column("u"), pa.array(fps), pa.array([m[1] for m in made], pa.binary()), pa.array([m[2] for m in made], pa.list_(pa.int64()))], ["d", "u", "fp", "sig", "bands"])

    marked = cut(docs.select(*key, "text").mapInArrow(frugal(run), "d long, u long, fp long, sig binary, bands array<long>"))
    points = cut(marked.groupBy("fp").agg(F.min_by(F.struct("sig", "bands"), F.struct("d", "u")).alias("x"), F.min(F.struct("d", "u")).alias("first")).select("fp", "first", "x.sig", "x.bands"))
    roots = components(close_edges(points.select("fp"), distance).unionAll(similar_edges(points, similarity, docs.select(*key, "text"), shingle)))
    placed = points.join(roots, points.fp == roots.vertex, "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    chosen = cut(placed.select("first.d", "first.u"))
    rows = docs.select(*key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # as one column, whatever its names
    found = rows.join(chosen, ["d", "u"], "left_semi")
    one = F.row_number().over(Window.partitionBy("d", "u").orderBy(F.xxhash64("row")))
    return found.withColumn("k", one).filter("k = 1").select("row.*")


def group(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """``doc_id, fp, component_id`` of every document."""
    marked = cut(fingerprints(docs, shingle))
    points = marked.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(close_edges(points.select("fp"), distance))
    placed = points.join(roots, points.fp == roots.vertex, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = cut(placed)
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return marked.join(named, marked.fp == named._fp).select("doc_id", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    return group(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
