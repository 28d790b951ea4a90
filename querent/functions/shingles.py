"""Character shingles, least-hash signatures and bands, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PERMUTATIONS, BANDS, ROWS = 128, 37, 3


def kshingles(text: Column, k: int = 3) -> Column:
    """All overlapping k-grams; a shorter text is its own shingle; null and empty have none.

    Characters are zipped with themselves moved by one place k - 1 times: a substring at place i would be
    sought from the text's begin, which takes the square of a long text's length."""
    chars = F.split(text, "")
    grams = chars
    for i in range(1, k):
        grams = F.zip_with(grams, F.slice(chars, F.lit(i + 1), F.greatest(F.length(text), F.lit(1))), lambda x, y: F.concat(x, y))
    whole = F.filter(grams, lambda g: g.isNotNull())
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).when(F.length(text) <= k, F.array(text)).otherwise(whole)


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 for two empty ones."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def signatures(shingled: DataFrame, keys: list[str], shingle: str = "shingle", n: int = PERMUTATIONS) -> DataFrame:
    """Least hash of each group's shingles under n hash functions: ``keys, signature``.

    One aggregation; partial minima are taken before the shuffle, so a group sends n numbers a task."""
    cols = [F.min(F.xxhash64(F.col(shingle), F.lit(i))).alias(f"_{i}") for i in range(n)]
    return shingled.groupBy(*keys).agg(*cols).select(*keys, F.array(*[F.col(f"_{i}") for i in range(n)]).alias("signature"))


def bands(signature: Column, b: int = BANDS, r: int = ROWS) -> Column:
    """A hash for each run of r slots, with the band's number: what similar sets share."""
    return F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda i: F.struct(i.alias("band"), F.xxhash64(F.slice(signature, i * r + 1, r), i).alias("band_hash")))
