"""Catalogs as DataFrames: the tables of a data set and their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The tables of a data set, with their keys.
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"],
    "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"],
    "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"],
}
REFERENCES = {("nation", "n_regionkey"): "region", ("customer", "c_nationkey"): "nation", ("supplier", "s_nationkey"): "nation", ("orders", "o_custkey"): "customer", ("lineitem", "l_orderkey"): "orders", ("lineitem", "l_partkey"): "part", ("lineitem", "l_suppkey"): "supplier"}
CATALOG = "db_id string, table string, ordinal int, column string, type string, not_null boolean, is_pk boolean, is_fk boolean"


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def register(spark: SparkSession, path: str, names: list[str] | None = None) -> list[str]:
    """Views of the data set's tables, for statements that name them."""
    names = names or sorted(KEYS)
    for n in names:
        table(spark, path, n).createOrReplaceTempView(n)
    return names


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def catalog(spark: SparkSession, path: str, names: list[str] | None = None, db_id: str = "main") -> DataFrame:
    """A row a column of the named tables, from their schemas alone; tables by name, columns in order."""
    rows = []
    for n in sorted(names or KEYS):
        for i, f in enumerate(table(spark, path, n).schema.fields):
            rows.append((db_id, n, i, f.name, f.dataType.simpleString(), not f.nullable, f.name in KEYS.get(n, []), (n, f.name) in REFERENCES))
    return spark.createDataFrame(rows, CATALOG)


def session_catalog(spark: SparkSession, db_id: str = "main") -> DataFrame:
    """The same for the session's tables and views; internal ones (``sqlite_...``) are left out."""
    rows = []
    for t in sorted(spark.catalog.listTables(), key=lambda t: t.name):
        if not t.name.startswith("sqlite_"):
            rows += [(db_id, t.name, i, f.name, f.dataType.simpleString(), not f.nullable, False, False) for i, f in enumerate(spark.table(quote(t.name)).schema.fields)]
    return spark.createDataFrame(rows, CATALOG)
