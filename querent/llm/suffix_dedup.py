"""Exact substring deduplication by pruned distributed prefix doubling.

Every byte that a ``LENGTH``-byte string covers goes if that string also starts earlier (in a smaller
doc_id, or earlier in the same document). Ranks are names: equal strings, equal 64-bit name. Sorting
pairs of names at growing offsets, as prefix doubling does, would start with a row a byte; a sparse
start keeps it near the input's size without losing a match:

1. Names of ``GRAM`` bytes. Each window of LENGTH bytes owns the leftmost least-hashed gram in it,
   its anchor; equal windows own equal anchors at equal offsets. Only anchors enter Spark, one row
   for each run of windows (about one in 39 bytes). Anchors whose name is unique drop out.
2. Names of whole runs (up to 175 bytes): among equal runs all but the first are repeated, as a whole.
3. Names of ``CORE`` bytes to the right and to the left of the first run's anchor, one of which lies
   in each of its windows. Unique pairs of anchor and core drop out.
4. Names of LENGTH bytes of the windows left; sorted, all but the first of a name are repeated.

Runs equal within one batch of a task are combined before the shuffle, so a text copied a million
times sends a row a batch, not a copy, to one key. Long texts are read in pieces.

Cases: null text has no bytes; texts under LENGTH keep all; rows that repeat a doc_id with the same
text are one document and get equal results, with other texts are ordered by position; null doc_id
comes last; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querent.llm.common import cut, release, ship, small_batches

LENGTH, GRAM = 100, 24
SPAN = LENGTH - GRAM + 1  # grams in a window
HALF = (SPAN - 1) // 2
CORE = LENGTH - HALF
PIECE, BATCH = 1 << 20, 400_000
#: Documents that lose bytes are told by a slot of their key; the table of slots has a row a slot at most.
SLOTS = 1 << 20
_TEXT_BITS = 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = np.random.default_rng(2).integers(0, 1 << 64, 256, np.uint64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(29))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(32)
    x *= _U(0x94D049BB133111EB)
    return x ^ (x >> _U(29))


class Names:
    """64-bit names of a text's substrings, from prefix sums of bytes' values times powers of an odd base."""

    def __init__(self, data: np.ndarray):
        n = len(data) + 1
        if len(_POWERS[0]) < n:
            size = max(n, 1 << 17)
            for i, b in enumerate((_BASE, _INVERSE)):
                p = np.full(size, _U(b))
                p[0] = 1
                _POWERS[i] = np.multiply.accumulate(p)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_VALUE[data] * _POWERS[0][: n - 1], out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        """Names of all substrings of one length."""
        d = self.sums[length:] - self.sums[:-length]
        d *= _POWERS[1][: len(d)]
        return _mix(d)

    def at(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Names of given substrings; the length counts."""
        return _mix((self.sums[end] - self.sums[begin]) * _POWERS[1][begin] + (end - begin).astype(np.uint64))


def anchors(grams: np.ndarray, n_windows: int) -> np.ndarray:
    """Place of the leftmost least gram of every window."""
    low, at = grams, np.arange(len(grams), dtype=np.int32)
    span = 1
    while span < SPAN:
        step = min(span, SPAN - span)
        later = low[step:] < low[: len(low) - step]
        at = np.where(later, at[step:], at[: len(at) - step])
        low = np.where(later, low[step:], low[: len(low) - step])
        span += step
    return at[:n_windows]


def pieces(raw: bytes):
    """Start and bytes of the pieces of a text; each window lies in one."""
    for start in range(0, max(0, len(raw) - LENGTH + 1), PIECE):
        yield start, np.frombuffer(raw, np.uint8, min(PIECE + LENGTH - 1, len(raw) - start), start)


def runs(raw: bytes) -> tuple[np.ndarray, ...]:
    """Anchor's name, run's name, first window, anchor, number of windows and core names of a text's runs."""
    out = []
    for start, data in pieces(raw):
        names, n = Names(data), len(data) - LENGTH + 1
        grams = names.every(GRAM)
        at = anchors(grams, n)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        size = np.diff(np.r_[first, n])
        a = at[first].astype(np.int64)
        whole = names.at(first, first + size + LENGTH - 1)
        right, left = np.minimum(a + CORE, len(data)), np.maximum(a - HALF, 0)
        cores = (names.at(a, right) & _U(0xFFFFFFFF)) | (names.at(left, a + GRAM) << _U(32))
        out.append((grams[a], whole, first + start, a + start, size, cores))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def pack(a: np.ndarray, back: np.ndarray, size: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Anchor, windows before it, windows of the run and the text's tag in one integer that sorts by place."""
    return (a << 32) | (back << 25) | (size << 18) | tag


def _key(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``d`` orders documents; ``tag`` tells texts under one doc_id apart, with ``u``, the text's whole
    hash, where doc_id is null or holds several texts (its slot is in ``mixed``); 0 elsewhere, which shuffles small."""
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"), _id_slot())
    several = own.join(F.broadcast(mixed.withColumn("_several", F.lit(True))), "_s", "left")  # at most SLOTS rows
    u = F.when(F.col("doc_id").isNull() | F.col("_several"), F.col("_h")).otherwise(F.lit(0).cast("long"))
    return several.select("doc_id", "text", F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("d"), F.pmod("_h", F.lit(1 << _TEXT_BITS)).alias("tag"), u.alias("u"))


def _id_slot() -> F.Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).cast("int").alias("_s")


def _mixed(docs: DataFrame) -> DataFrame:
    """``_s``: slots of the ids that hold several texts."""
    own = docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("h"))
    return cut(own.groupBy("doc_id").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low <> high").select(_id_slot()).distinct())


def _slot() -> F.Column:
    return F.pmod(F.xxhash64("d", "tag", "u"), F.lit(SLOTS)).cast("int").alias("slot")


def _sparse(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``h, c, d, p, q, u, done``: the runs of all texts. ``done``: an equal run earlier in the batch."""

    def run(batches):
        def combined(parts: list[tuple]):
            h, c, q, d, p, u = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((u, p, d, c, h))
            h, c, q, d, p, u = (x[order] for x in (h, c, q, d, p, u))
            new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
            lead = np.flatnonzero(new)[np.cumsum(new) - 1]
            done = (d != d[lead]) | (p != p[lead]) | (u != u[lead])
            h = np.where(done, _mix(d.astype(np.uint64) * _U(_BASE) + p.astype(np.uint64) + u.astype(np.uint64) * _U(_INVERSE)), h)  # meets nothing, lies anywhere
            for lo in range(0, len(h), 100_000):
                s = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (h.view(np.int64), c.view(np.int64), d, p, q.view(np.int64), u, done)], ["h", "c", "d", "p", "q", "u", "done"])

        parts, held = [], 0
        for b in batches:
            for d, tag, u, t in zip(*[b.column(c).to_pylist() for c in ("d", "tag", "u", "text")], strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                if len(raw) < LENGTH:
                    continue
                h, c, first, a, size, q = runs(raw)
                parts.append((h, c, q, np.full(len(h), d, np.int64), pack(a, a - first, size, tag), np.full(len(h), u, np.int64)))
                held += len(h)
                if held >= BATCH:
                    yield from combined(parts)
                    parts, held = [], 0
        if parts:
            yield from combined(parts)

    return _key(docs, mixed).select("d", "tag", "u", "text").mapInArrow(run, "h long, c long, d long, p long, q long, u long, done boolean")


def _ranked(rows: DataFrame) -> DataFrame:
    """``d, p, u, kind``: 0 for runs that repeat as a whole; else which cores (1 right, 2 left) are not unique."""
    named = rows.repartition("h").withColumn("n", F.count("*").over(Window.partitionBy("h"))).filter("n > 1 or done")
    first = ~F.col("done") & (F.col("r") == 1)
    named = named.withColumn("r", F.rank().over(Window.partitionBy("h", "c").orderBy("d", "p", "u"))).withColumn("first", first.cast("int"))
    right, left = F.col("q").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("q", 32)
    shared = lambda core: F.sum("first").over(Window.partitionBy("h", core)) > 1
    named = named.withColumn("ql", left).withColumn("qr", right)
    named = named.withColumn("sl", shared("ql")).withColumn("sr", shared("qr"))
    return named.select("d", "p", "u", F.when(F.col("first") == 0, 0).otherwise(F.col("sr").cast("int") + 2 * F.col("sl").cast("int")).alias("kind"), "first").filter("first = 0 or kind > 0").drop("first")


def _windows(docs: DataFrame, wanted: DataFrame, mixed: DataFrame) -> DataFrame:
    """``name, d, tag, u, pos`` of the windows whose core is not unique."""
    tag = F.col("p").bitwiseAND(F.lit((1 << _TEXT_BITS) - 1)).alias("tag")
    wanted = wanted.select("d", tag, "u", "p", "kind")
    slots = wanted.select(_slot()).distinct()
    lists = wanted.groupBy("d", "tag", "u").agg(F.collect_list("p").alias("ps"), F.collect_list("kind").alias("kinds"))
    found = _key(docs, mixed).withColumn("slot", _slot()).join(F.broadcast(slots), "slot", "left_semi").join(lists, ["d", "tag", "u"])  # at most SLOTS rows

    def run(batches):
        for b in batches:
            for d, tag, u, t, ps, kinds in zip(*[b.column(c).to_pylist() for c in ("d", "tag", "u", "text", "ps", "kinds")], strict=True):
                raw = np.frombuffer((t or "").encode("utf-8", "surrogatepass"), np.uint8)
                p, kind = np.array(ps, np.int64), np.array(kinds)
                a, back, size = p >> 32, (p >> 25) & 127, (p >> 18) & 127
                pos = np.repeat(a - back, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                left = np.repeat(a, size) - pos >= HALF
                pos = np.unique(pos[(np.repeat(kind, size) & np.where(left, 2, 1)) > 0])
                for lo in range(0, len(raw), PIECE):
                    own = pos[(pos >= lo) & (pos < lo + PIECE)]
                    if len(own):
                        names = Names(raw[lo : lo + PIECE + LENGTH]).at(own - lo, own - lo + LENGTH)
                        yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(np.full(len(own), d, np.int64)), pa.array(np.full(len(own), tag, np.int64)), pa.array(np.full(len(own), u, np.int64)), pa.array(own)], ["name", "d", "tag", "u", "pos"])

    return found.select("d", "tag", "u", "text", "ps", "kinds").mapInArrow(run, "name long, d long, tag long, u long, pos long")


def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``d, tag, u, begin, end``: ranges of window starts whose string starts earlier too."""
    ranked = cut(_ranked(_sparse(docs, mixed)))
    release(docs.sparkSession)  # the rows of all runs are read no more
    names = _windows(docs, ranked.filter("kind > 0"), mixed)
    later = names.withColumn("r", F.rank().over(Window.partitionBy("name").orderBy("d", "pos", "tag", "u"))).filter("r > 1").select("d", "tag", "u", F.col("pos").alias("begin"), F.col("pos").alias("end"))
    back, size = F.shiftright("p", 25).bitwiseAND(F.lit(127)), F.shiftright("p", 18).bitwiseAND(F.lit(127))
    start = F.shiftright("p", 32) - back
    whole = ranked.filter("kind = 0").select("d", F.col("p").bitwiseAND(F.lit((1 << _TEXT_BITS) - 1)).alias("tag"), "u", start.alias("begin"), (start + size - 1).alias("end"))
    return cut(whole.unionByName(later))


def spans(raw: bytes, begins: list[int], ends: list[int]) -> list[tuple[int, int]]:
    """Maximal byte runs to remove, from ranges of window starts."""
    order = np.argsort(np.array(begins), kind="stable")
    begin, end = np.array(begins)[order], np.array(ends)[order] + LENGTH
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.r_[True, begin[1:] > reach[:-1]])
    return list(zip(begin[new].tolist(), np.r_[reach[new[1:] - 1], reach[-1]].tolist(), strict=True))


def dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (binary: the bytes left) of every document."""
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    mixed = _mixed(docs)
    ranges = repeated(docs, mixed)
    release(docs.sparkSession)  # nor are those of windows
    slots = cut(ranges.select(_slot()).distinct())
    keyed = _key(docs, mixed).withColumn("slot", _slot())
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    whole = keyed.join(F.broadcast(slots), "slot", "left_anti").select("doc_id", size, F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("kept"))
    lists = ranges.groupBy("d", "tag", "u").agg(F.collect_list("begin").alias("begins"), F.collect_list("end").alias("ends"))
    found = keyed.join(F.broadcast(slots), "slot", "left_semi").join(lists, ["d", "tag", "u"], "left").select("doc_id", "text", "begins", "ends")  # at most SLOTS rows

    def run(batches):
        for b in batches:
            rows = []
            for i, t, begins, ends in zip(*[b.column(c).to_pylist() for c in ("doc_id", "text", "begins", "ends")], strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                cuts = spans(raw, begins, ends) if begins else []
                kept, at = [], 0
                for lo, hi in cuts:
                    kept.append(raw[at:lo])
                    at = hi
                kept.append(raw[at:])
                rows.append((i, len(raw), sum(hi - lo for lo, hi in cuts), len(cuts), b"".join(kept)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)] if rows else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return whole.unionByName(found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))


def report(docs: DataFrame) -> DataFrame:
    return dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def plain(texts: dict[int, str | None]) -> dict[int, tuple[int, int, int, str]]:
    """The same results for a few documents, by the definition; what tests hold the operator against."""
    seen: set[bytes] = set()
    out = {}
    for i in sorted(texts):
        raw = (texts[i] or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - LENGTH + 1):
            s = raw[p : p + LENGTH]
            if s in seen:
                gone[p : p + LENGTH] = True
            seen.add(s)
        kept = bytes(x for x, g in zip(raw, gone, strict=False) if not g)
        out[i] = (len(raw), int(gone.sum()), int((gone[:-1] & ~np.r_[False, gone[:-2]]).sum()) if len(raw) else 0, hashlib.sha256(kept).hexdigest())
    return out
