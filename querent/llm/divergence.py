"""Source divergence audit: how a language's sources differ in the terms that they use.

Terms are runs of ASCII letters (A-Z lower-cased) and of all characters beyond ASCII. A language keeps the
V terms that at least ``min_docs`` of its documents hold. A group, a language's source, gives a kept term
that it holds c times the probability p = 1 + floor(10^9 (c + 5) / (N + 5 V)), N the sum of its c; so does
the language as a whole. All of it is exact integer arithmetic.

``pairs``: the sum of |p_a - p_b| over all kept terms, for every two sources of a language. Postings, the
sources that hold a term, compute it: a source's terms against the other's probability of a term that
it lacks, and what terms that both hold change. Tasks add up one number a pair, so neither pairs of
rows nor terms that a source lacks are ever listed.

``outstanding``: each group's terms whose p exceeds the language's by most. Terms lie in buckets by their
count; the largest p and the least q of a bucket bound its differences from above. Buckets are
evaluated best bound first: a first wave until k terms are seen, whose k-th difference is a threshold, then
all others whose bound is not strictly below it. So ties at the threshold are never lost.

Documents are counted in tasks, which hold at most ``HELD`` counters before they pass them on; the
counts meet in a shuffle by language and term, in which no key has more rows than tasks and sources.

Cases: null text, language and source are ''; a group without kept terms has pairs (against the
probability of a term that it lacks) and no outstanding terms; with V = 0 all pairs are 0; ties go by
UTF-8 order; repeated documents and a null doc_id count like any; very long texts are read whole; an
empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querent.llm.common import ship, small_batches, written

__all__ = ["SQL", "audit", "counts", "groups", "outstanding", "pairs"]

#: Counters that a task holds before it passes them on.
HELD = 1 << 20
#: Cells of pairs that a task holds before it passes them on.
CELLS = 1 << 22
SCALE = 10**9
#: Capitals become small, all other ASCII but letters parts terms.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, c, d`` of some documents: occurrences, and documents that hold the term."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def passed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (c, d) in held.items():
            terms = [None, *c]  # a null term says that the group is there
            cells = [pa.array([x] * len(terms)) for x in (lang, source)]
            texts = pa.array([None, *[t.decode() for t in terms[1:]]], pa.string())
            yield pa.record_batch([*cells, texts, pa.array([0, *c.values()], pa.int64()), pa.array([0, *[d[t] for t in terms[1:]]], pa.int64())], ["lang", "source", "term", "c", "d"])
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            c, d = held.setdefault((lang, source), (Counter(), Counter()))
            size -= len(c)
            found = text.encode().translate(_PLAIN).split()
            c.update(found)
            d.update(set(found))
            size += len(c)
            if size > HELD:
                yield from passed()
                size = 0
    yield from passed()


def counts(docs: DataFrame, min_docs: int = 30) -> DataFrame:
    """``lang, source, term, c, whole, first``: each group's occurrences of its language's kept terms, the
    language's, and whether the row is the term's first. One row of a null term stands for the group itself."""
    spark = docs.sparkSession
    ship(spark)
    small_batches(spark)
    own = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    parts = own.mapInArrow(_counted, "lang string, source string, term string, c long, d long")
    # one exchange serves the sums by source and the sums over sources
    summed = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    term = Window.partitionBy("lang", "term")
    summed = summed.withColumn("whole", F.sum("c").over(term)).withColumn("_docs", F.sum("d").over(term)).withColumn("first", F.col("source") == F.min("source").over(term))
    return summed.filter((F.col("_docs") >= min_docs) | F.col("term").isNull()).select("lang", "source", "term", "c", "whole", "first")


def probability(c: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (c + 5) / (n + 5 v)); null where nothing is kept. Products pass 64 bits, so decimals."""
    exact = lambda x: x.cast("decimal(19,0)")
    top = F.lit(SCALE).cast("decimal(10,0)") * exact(c + 5)
    return F.when(v > 0, F.call_function("div", top, F.nullif(exact(n + 5 * v), F.lit(0).cast("decimal(19,0)"))) + 1)


def groups(held: DataFrame) -> DataFrame:
    """``lang, source, n, terms, v, whole_n, zero``: sums of a group's and its language's counts, the group's
    and the language's kept terms, and the group's probability of a term that it lacks."""
    own = held.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count("term").alias("terms"), F.count_if(F.col("first") & F.col("term").isNotNull()).alias("_first"))
    lang = Window.partitionBy("lang")
    own = own.withColumn("v", F.sum("_first").over(lang)).withColumn("whole_n", F.sum("n").over(lang)).drop("_first")
    return own.withColumn("zero", probability(F.lit(0).cast("long"), F.col("n"), F.col("v")))


def _rated(held: DataFrame, known: DataFrame) -> DataFrame:
    """Held terms with ``p`` of their group, ``q`` of their language and the group's ``zero``."""
    met = held.filter("term is not null").join(known, ["lang", "source"])
    return met.withColumn("p", probability(F.col("c"), F.col("n"), F.col("v"))).withColumn("q", probability(F.col("whole"), F.col("whole_n"), F.col("v")))


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, item, more``: what terms that both sources hold add, summed over some postings."""
    held: dict[str, tuple[dict[str, int], np.ndarray]] = {}

    def passed() -> Iterator[pa.RecordBatch]:
        for lang, (place, sums) in held.items():
            names = np.array(list(place), object)
            a, b = np.nonzero(sums[: len(names), : len(names)])
            yield pa.record_batch([pa.array([lang] * len(a), pa.string()), pa.array(names[a], pa.string()), pa.array(names[b], pa.string()), pa.array(sums[a, b], pa.int64())], ["lang", "source", "item", "more"])
        held.clear()

    for batch in batches:
        for lang, posting in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            place, sums = held.get(lang) or ({}, np.zeros((8, 8), np.int64))
            at = np.array([place.setdefault(x["source"], len(place)) for x in posting])
            if len(place) > len(sums):
                grown = np.zeros((2 * len(place), 2 * len(place)), np.int64)
                grown[: len(sums), : len(sums)] = sums
                sums = grown
            held[lang] = (place, sums)
            p, z = (np.array([x[k] for x in posting], np.int64) for k in ("p", "zero"))
            more = abs(p[:, None] - p) - abs(p[:, None] - z) - abs(z[:, None] - p) + abs(z[:, None] - z)
            np.fill_diagonal(more, 0)
            sums[at[:, None], at] += more
        if sum(s.size for _, s in held.values()) > CELLS:
            yield from passed()
    yield from passed()


def pairs(rated: DataFrame, known: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every two sources of a language, both ways."""
    other = known.select("lang", F.col("source").alias("item"), F.col("zero").alias("other_zero"), F.col("terms").alias("other_terms"))
    # as many rows as the result has
    frame = known.select("lang", "source", "terms", "v", "zero").join(other, "lang").filter("source <> item")
    postings = rated.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "zero")).alias("posting")).filter(F.size("posting") > 1)
    both = postings.select("lang", "posting").mapInArrow(_both, "lang string, source string, item string, more long").groupBy("lang", "source", "item").agg(F.sum("more").alias("more"))
    # a group has far fewer counts than terms
    shares = rated.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
    alone = frame.join(shares, ["lang", "source"]).groupBy("lang", "source", "item").agg(F.sum(F.col("n") * F.abs(F.col("p") - F.col("other_zero"))).alias("alone"))
    back = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("alone").alias("back"))
    key = ["lang", "source", "item"]
    met = frame.join(alone, key, "left").join(back, key, "left").join(both, key, "left")
    neither = (F.col("v") - F.col("terms") - F.col("other_terms")) * F.abs(F.col("zero") - F.col("other_zero"))
    return met.select(*key, sum((F.coalesce(F.col(c), F.lit(0)) for c in ("alone", "back", "more")), F.coalesce(neither, F.lit(0))).cast("long").alias("value"))


def outstanding(rated: DataFrame, k: int = 50) -> DataFrame:
    """``lang, source, item, value, rank``: the k terms of each group whose p exceeds the language's by most."""
    group = ["lang", "source"]
    rated = rated.select(*group, "term", "p", "q", F.floor(F.log2("c") * 4).cast("int").alias("bucket"))
    bounds = rated.groupBy(*group, "bucket").agg(F.count("*").alias("n"), (F.max("p") - F.min("q")).alias("bound")).filter("bound > 0")
    best = Window.partitionBy(*group).orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    bounds = written(bounds.withColumn("wave", F.when(F.coalesce(F.sum("n").over(best), F.lit(0)) < k, 1).otherwise(2)))
    order = Window.partitionBy(*group).orderBy(F.desc("value"), "item")

    def evaluated(buckets: DataFrame) -> DataFrame:
        met = rated.join(buckets.select(*group, "bucket"), [*group, "bucket"]).filter("p > q")
        return met.select(*group, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    def first(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    seen = written(first(evaluated(bounds.filter("wave = 1"))))
    kth = seen.filter(F.col("rank") == k).select(*group, F.col("value").alias("kth"))
    rest = bounds.filter("wave = 2").join(kth, group, "left").filter("kth is null or bound >= kth")
    return first(seen.drop("rank").unionByName(evaluated(rest)))


def audit(docs: DataFrame, min_docs: int = 30, k: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank``: pairs of sources, and each group's outstanding terms."""
    held = written(counts(docs, min_docs))
    known = written(groups(held))
    rated = _rated(held, known)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    apart = pairs(rated, known).withColumn("rank", F.row_number().over(order))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return apart.withColumn("part", F.lit("pair")).select(columns).unionByName(outstanding(rated, k).withColumn("part", F.lit("term")).select(columns))


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
said AS (SELECT rid, lang, source, unnest(terms) AS term FROM docs),
held AS (SELECT lang, source, term, count(*) AS c, count(DISTINCT rid) AS d FROM said GROUP BY ALL),
kept AS (SELECT lang, term, sum(c)::HUGEINT AS c FROM held GROUP BY ALL HAVING sum(d) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(c)::HUGEINT AS n FROM kept GROUP BY lang),
grps AS (SELECT DISTINCT lang, source FROM docs),
cells AS (SELECT g.lang, g.source, k.term, coalesce(h.c, 0)::HUGEINT AS c, k.c AS whole FROM grps g JOIN kept k ON k.lang = g.lang LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
sums AS (SELECT lang, source, sum(c)::HUGEINT AS n FROM cells GROUP BY ALL),
rated AS (SELECT c.lang, c.source, c.term, c.c, 1 + 1000000000::HUGEINT * (c.c + 5) // (s.n + 5 * l.v) AS p, 1 + 1000000000::HUGEINT * (c.whole + 5) // (l.n + 5 * l.v) AS q
  FROM cells c JOIN sums s ON s.lang = c.lang AND s.source = c.source JOIN langs l ON l.lang = c.lang),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM rated a JOIN rated b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM grps a JOIN grps b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM rated WHERE c > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms) WHERE rank <= 50"""
