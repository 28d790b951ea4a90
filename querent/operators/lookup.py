"""From literals to the columns that hold them: exact lookup on value variants, else containment of shingles."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querent.functions.shingles import bands, kshingles, signatures
from querent.functions.text import value_variants
from querent.session import scratch, ship

KEYS = ["table", "column"]


def variant_index(values: DataFrame) -> DataFrame:
    """``table, column, variant`` of distinct column values (``table, column, value``)."""
    return values.select(*KEYS, F.explode(value_variants(F.col("value"))).alias("variant")).distinct()


def exact_matches(literals: DataFrame, index: DataFrame) -> DataFrame:
    """``literal, table, column, variants`` where a variant of a literal equals one of a value.

    A plain equi-join; Spark broadcasts the literals when they are small."""
    own = literals.select("literal").distinct().select("literal", F.explode(value_variants(F.col("literal"))).alias("variant"))
    return own.join(index, "variant").groupBy("literal", *KEYS).agg(F.sort_array(F.collect_set("variant")).alias("variants"))


def column_bands(values: DataFrame) -> DataFrame:
    """``table, column, band, band_hash``: bands of each column's signature over all its variants' shingles."""
    shingled = values.select(*KEYS, F.explode(value_variants(F.col("value"))).alias("v")).select(*KEYS, F.explode(kshingles(F.lower("v"))).alias("shingle"))
    return signatures(shingled, KEYS).select(*KEYS, F.inline(bands(F.col("signature"))))


def literal_bands(literals: DataFrame) -> DataFrame:
    shingled = literals.select("literal").distinct().select("literal", F.explode(value_variants(F.col("literal"))).alias("v")).select("literal", F.explode(kshingles(F.lower("v"))).alias("shingle"))
    return signatures(shingled, ["literal"]).select("literal", F.inline(bands(F.col("signature"))))


def band_candidates(literals: DataFrame, values: DataFrame) -> DataFrame:
    """``literal, table, column`` that share a band."""
    return literal_bands(literals).join(column_bands(values), ["band", "band_hash"]).select("literal", *KEYS).distinct()


#: Shingles that a task remembers before it passes over to new ones, and characters and values that it takes at once.
REMEMBERED, TAKEN, ROWS = 1 << 22, 1 << 19, 500
#: Length up to which equal values, such as codes, are dropped before they go to Python.
SHORT = 24


def _numbers(texts: list[str], k: int) -> np.ndarray:
    """The distinct k-grams, k at most 3, of texts of k characters at least, as numbers of 21 bits a character."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    whole = np.ones(len(codes), bool)
    ends = np.cumsum([len(x) for x in texts])
    key = codes[: len(codes) - k + 1]
    for i in range(1, k):
        whole[ends - i] = False
        key = key << 21 | codes[i : len(codes) - k + 1 + i]
    return np.unique(key[whole[: len(key)]])


def _spelt(numbers: np.ndarray, k: int) -> list[str]:
    codes = np.stack([numbers >> 21 * (k - 1 - i) & (1 << 21) - 1 for i in range(k)], axis=1).astype(np.uint32)
    text = codes.tobytes().decode("utf-32-le", "surrogatepass")
    return [text[i : i + k] for i in range(0, len(text), k)]


class Grams:
    """The k-grams of one column's values that a task has met; a shorter value is its own."""

    def __init__(self, k: int):
        self.k, self.strings, self.numbers = k, set(), np.zeros(0, np.int64)

    def new(self, texts: set[str]) -> list[str]:
        """Grams of some texts that no text before had."""
        k, fresh = self.k, {x for x in texts if 0 < len(x) < self.k}
        pieces = [x[i : i + TAKEN + k - 1] for x in texts if len(x) >= k for i in range(0, len(x) - k + 1, TAKEN)]
        out: list[str] = []
        held, size = [], 0
        for i, x in enumerate(pieces):
            held.append(x)
            size += len(x)
            if size < TAKEN and i + 1 < len(pieces):
                continue
            if k > 3:
                fresh.update(y[j : j + k] for y in held for j in range(len(y) - k + 1))
            else:
                found = np.setdiff1d(_numbers(held, k), self.numbers, assume_unique=True)
                if len(found):
                    self.numbers = np.sort(np.concatenate([self.numbers, found]))
                    out += _spelt(found, k)
            held, size = [], 0
        fresh -= self.strings
        self.strings |= fresh
        return out + list(fresh)

    def __len__(self) -> int:
        return len(self.strings) + len(self.numbers)


def _shingled(k: int):
    """A task over ``table, column, value``: the distinct ``table, column, shingle`` that it meets, as ``kshingles`` has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Grams] = {}
        for b in (b.slice(low, ROWS) for b in batches for low in range(0, b.num_rows, ROWS)):
            texts: dict[tuple, set[str]] = {}
            for place, column, value in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
                texts.setdefault((place, column), set()).add(value or "")
            for key, own in texts.items():
                new = held.setdefault(key, Grams(k)).new(own)
                if new:
                    yield pa.record_batch([pa.array([x] * len(new), pa.string()) for x in key] + [pa.array(new, pa.string())], [*KEYS, "shingle"])
            if sum(map(len, held.values())) > REMEMBERED:
                held.clear()

    return run


def shingle_index(values: DataFrame, k: int = 3) -> DataFrame:
    """``shingle, table, column, columns``: the distinct shingles of each column's lower-cased values, and how many
    columns hold the shingle. It grows with the alphabet and the columns, not with the rows: repeats are
    dropped in every task before the shuffle, a batch of values at a time."""
    ship(values.sparkSession)
    low = values.select(*KEYS, F.lower(F.trim("value")).alias("value")).filter("value <> ''")
    short = F.length("value") <= SHORT
    low = low.filter(short).distinct().unionAll(low.filter(~short))
    held = low.mapInArrow(_shingled(k), "table string, column string, shingle string").distinct()
    return held.withColumn("columns", F.count("*").over(Window.partitionBy("shingle"))).select("shingle", *KEYS, "columns")


def stored(index: DataFrame) -> DataFrame:
    """The same, made once and kept in the session's shared folder, for a frame that a plan reads several times."""
    path = f"{scratch(index.sparkSession)}/index-{uuid.uuid4().hex}"
    index.write.parquet(path)
    return index.sparkSession.read.schema(index.schema).parquet(path)


def contained(literals: DataFrame, index: DataFrame, percent: int = 80, k: int = 3) -> DataFrame:
    """``literal, table, column, shared, size``: columns whose shingles hold at least ``percent`` of a literal's.

    The share is of the literal, not of the union, which for a short literal and a whole column is next to
    nothing; so likeness of sets, and bands tuned to it, can't find them. A literal of ``size`` shingles, of
    which ``need`` must be held, has one of its rarest size - need + 1 in common with every column that
    is to be found: only these meet the index to find candidates (a prefix filter), and only candidates are
    counted in full. The result is exact. Nulls and blanks have no shingles and find nothing; literals that
    differ in case or outer blanks are kept apart but find the same."""
    own = literals.select("literal").distinct().select("literal", F.explode(F.array_distinct(kshingles(F.lower(F.trim("literal")), k))).alias("shingle"))
    rare = Window.partitionBy("literal").orderBy(F.coalesce("columns", F.lit(0)), "shingle")
    known = own.join(index.select("shingle", "columns").distinct(), "shingle", "left")
    known = known.withColumn("place", F.row_number().over(rare)).withColumn("size", F.count("*").over(Window.partitionBy("literal")))
    known = known.withColumn("need", F.floor((F.col("size") * percent + 99) / 100).cast("int"))
    prefix = known.filter("columns is not null and place <= size - need + 1").select("literal", "shingle")
    near = prefix.join(index.select("shingle", *KEYS), "shingle").select("literal", *KEYS).distinct()
    asked = known.filter("columns is not null").select("literal", "shingle", "size", "need")
    met = near.join(asked, "literal").join(index.select("shingle", *KEYS), ["shingle", *KEYS])
    found = met.groupBy("literal", *KEYS).agg(F.count("*").cast("int").alias("shared"), F.first("size").cast("int").alias("size"), F.first("need").alias("need"))
    return found.filter("shared >= need").drop("need")


def matches(literals: DataFrame, values: DataFrame) -> DataFrame:
    """``literal, table, column, match_type``: exact matches; for literals without any, columns that contain them."""
    exact = exact_matches(literals, variant_index(values)).select("literal", *KEYS)
    near = contained(literals.join(exact.select("literal").distinct(), "literal", "left_anti"), stored(shingle_index(values))).select("literal", *KEYS)
    return exact.withColumn("match_type", F.lit("exact")).unionByName(near.withColumn("match_type", F.lit("approximate")))


def exact_else(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Both as one with ``match_type``; a literal with any exact match keeps only these."""
    rest = approximate.join(exact.select("literal").distinct(), "literal", "left_anti")
    return exact.withColumn("match_type", F.lit("exact")).unionByName(rest.withColumn("match_type", F.lit("approximate")))


def missing_columns(literals: DataFrame, index: DataFrame, referenced: DataFrame) -> DataFrame:
    """``query_id, literal, table, column``: columns that hold a query's literal where the query refers to none of them."""
    held = literals.join(index.select(F.col("variant").alias("literal"), *KEYS).distinct(), "literal")
    used = held.join(referenced, ["query_id", *KEYS], "left_semi").select("query_id", "literal").distinct()
    return held.join(used, ["query_id", "literal"], "left_anti")
