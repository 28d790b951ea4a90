"""SQLite files as Spark tables, read in ranges of rows and written a file a task.

A path is one SQLite file, or a folder that ``write`` made: a file for each task that wrote, and a
manifest that names the files which count. A task writes under a name of its own, and the driver
adds all names to the manifest at once, by a rename; files of tasks that failed or ran twice are in no
manifest, so a retry adds nothing twice. The path must be a folder mounted on all executors.

Reading: each file is cut into ranges of rowid, some ``rows`` numbers each; views and tables without rowid
are one range a file. The schema given to the reader is the columns it asks SQLite for. Comparisons,
IN and IS NOT NULL on INTEGER, REAL and TEXT columns go into the statement, others stay with Spark.

Cases: values whose storage class isn't their column's are null (SQLite lets any value into any column), for
filters too; text that isn't UTF-8 has replacement characters, and filters see its bytes; DATE, BOOLEAN and
other declared types are text, NUMERIC and DECIMAL are doubles; an empty table has no rows but its schema.
"""

from __future__ import annotations

import json
import os
import re
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote as url

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import types as T

from querent.session import ship
from querent.sources.catalog import CATALOG

MANIFEST = "_manifest.json"
#: Rowids of a range, and rows of an Arrow batch.
ROWS, BATCH = 1_000_000, 10_000
_SIGNS = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}
_DECLARED = {T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.ShortType: "INTEGER", T.ByteType: "INTEGER", T.BooleanType: "INTEGER", T.DoubleType: "REAL", T.FloatType: "REAL", T.StringType: "TEXT", T.BinaryType: "BLOB"}
DETAILS = f"{CATALOG}, default string, pk_ordinal int"
REFERENCES = "db_id string, table string, column string, to_table string, to_column string"


def local(path: str) -> str:
    """A mounted path of a URI; other stores hold no SQLite files that can be opened."""
    bare = re.sub(r"^file:(//)?(?=/)", "", path)
    if "://" in bare:
        raise ValueError(f"SQLite files lie in a mounted folder, not at {path}")
    return bare


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(file: str) -> sqlite3.Connection:
    con = sqlite3.connect(f"file:{url(file)}?mode=ro", uri=True)
    con.text_factory = lambda b: b.decode("utf-8", "replace")
    return con


def files(path: str) -> list[str]:
    """The files of a path; of a folder, those of its manifest."""
    path = local(path)
    if not os.path.isdir(path):
        return [path]
    with open(f"{path}/{MANIFEST}") as f:
        return [f"{path}/{n}" for n in json.load(f)]


def spark_type(declared: str) -> T.DataType:
    """By SQLite's rules of affinity, in their order."""
    d = declared.upper()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if "BLOB" in d:
        return T.BinaryType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL")):
        return T.DoubleType()
    return T.StringType()


def _info(con: sqlite3.Connection, table: str) -> list[tuple]:
    found = con.execute(f"PRAGMA table_info({quoted(table)})").fetchall()
    if not found:
        raise ValueError(f"no table {table}")
    return found


def _asked(name: str, kind: T.DataType) -> str:
    c = quoted(name)
    held = {T.LongType: ("'integer'", c), T.DoubleType: ("'integer', 'real'", f"CAST({c} AS REAL)"), T.BinaryType: ("'blob'", c)}
    classes, value = held.get(type(kind), ("'integer', 'real', 'text'", f"CAST({c} AS TEXT)"))
    return f"CASE WHEN typeof({c}) IN ({classes}) THEN {value} END"


@dataclass
class Range(ds.InputPartition):
    file: str
    low: int | None
    high: int | None


class Reader(ds.DataSourceReader):
    def __init__(self, schema: T.StructType, path: str, table: str, rows: int, declared: dict[str, str]):
        self.schema, self.path, self.table, self.rows, self.declared = schema, path, table, rows, declared
        self.wheres: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:  # noqa: N802
        for f in filters:
            if not self._push(f):
                yield f

    def _push(self, f: ds.Filter) -> bool:
        """Put a filter into the statement, where it holds for the same rows as in Spark."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        kind, classes = {"INTEGER": (int, "'integer'"), "REAL": (float, "'integer', 'real'"), "TEXT": (str, "'text'")}.get(self.declared.get(name, ""), (None, ""))
        if kind is None:
            return False
        c = f"{quoted(name)} COLLATE BINARY"
        fits = lambda x: type(x) is kind and (kind is not str or "\0" not in x) and x == x  # noqa: E731, PLR0124
        if isinstance(f, ds.In) and 0 < len(f.value) <= 500 and all(map(fits, f.value)):
            self.wheres.append(f"{c} IN ({', '.join('?' * len(f.value))})")
            self.values += f.value
        elif type(f) in _SIGNS and fits(f.value):
            self.wheres.append(f"{c} {_SIGNS[type(f)]} ?")
            self.values.append(f.value)
        elif not isinstance(f, ds.IsNotNull):
            return False
        self.wheres.append(f"typeof({quoted(name)}) IN ({classes})")  # other values are null in Spark
        return True

    def partitions(self) -> list[Range]:
        out = []
        for file in files(self.path):
            con = opened(file)
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
                kind = con.execute("SELECT type FROM sqlite_master WHERE name = ?", (self.table,)).fetchone()
                whole = kind is None or kind[0] != "table"
            except sqlite3.OperationalError:  # no rowid
                whole = True
            finally:
                con.close()
            if whole:
                out.append(Range(file, None, None))
            elif low is not None:
                out += [Range(file, a, min(a + self.rows - 1, high)) for a in range(low, high + 1, self.rows)]
        return out or [Range("", None, None)]

    def statement(self, part: Range) -> tuple[str, list]:
        wheres, values = list(self.wheres), list(self.values)
        if part.low is not None:
            wheres.append("rowid BETWEEN ? AND ?")
            values += [part.low, part.high]
        asked = ", ".join(_asked(f.name, f.dataType) for f in self.schema.fields) or "1"
        return f"SELECT {asked} FROM {quoted(self.table)}" + (f" WHERE {' AND '.join(wheres)}" if wheres else ""), values

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        kinds = [{T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.BinaryType: pa.binary()}.get(type(f.dataType), pa.string()) for f in self.schema.fields]
        con = opened(part.file)
        try:
            rows = con.execute(*self.statement(part))
            while some := rows.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], [f.name for f in self.schema.fields])
        finally:
            con.close()


@dataclass
class Wrote(ds.WriterCommitMessage):
    name: str | None


class Writer(ds.DataSourceArrowWriter):
    def __init__(self, schema: T.StructType, path: str, table: str, overwrite: bool):
        self.schema, self.path, self.table, self.overwrite = schema, local(path), table, overwrite
        unknown = [f.name for f in schema.fields if type(f.dataType) not in _DECLARED]
        if unknown:
            raise ValueError(f"SQLite has no type for columns {unknown}: cast them")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        name, con = f"part-{uuid.uuid4().hex}.sqlite", None
        try:
            for batch in iterator:
                if batch.num_rows and con is None:
                    os.makedirs(self.path, exist_ok=True)
                    con = sqlite3.connect(f"{self.path}/{name}")
                    con.execute("PRAGMA journal_mode = OFF")  # the manifest commits, not the file
                    con.execute(f"CREATE TABLE {quoted(self.table)} ({', '.join(f'{quoted(f.name)} {_DECLARED[type(f.dataType)]}' for f in self.schema.fields)})")
                if batch.num_rows:
                    marks = ", ".join("?" * batch.num_columns)
                    con.executemany(f"INSERT INTO {quoted(self.table)} VALUES ({marks})", zip(*[c.to_pylist() for c in batch.columns], strict=True))
            if con is not None:
                con.commit()
        finally:
            if con is not None:
                con.close()
        return Wrote(name if con is not None else None)

    def commit(self, messages: list[Wrote | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        manifest = f"{self.path}/{MANIFEST}"
        old = [os.path.basename(f) for f in files(self.path)] if os.path.exists(manifest) else []
        new = sorted(m.name for m in messages if m is not None and m.name)
        made = f"{manifest}.{uuid.uuid4().hex}"
        with open(made, "w") as f:
            json.dump(new if self.overwrite else old + new, f)
        os.replace(made, manifest)
        if self.overwrite:
            _removed(self.path, old)

    def abort(self, messages: list[Wrote | None]) -> None:
        _removed(self.path, [m.name for m in messages if m is not None and m.name])


def _removed(path: str, names: list[str]) -> None:
    for n in names:
        if os.path.exists(f"{path}/{n}"):
            os.remove(f"{path}/{n}")


class Sqlite(ds.DataSource):
    """Options: ``path``, ``table``, ``rows`` (rowids of a range)."""

    @classmethod
    def name(cls) -> str:
        return "querent_sqlite"

    def _columns(self) -> list[tuple[str, str]]:
        first = next(iter(files(self.options["path"])), None)
        if first is None:
            raise ValueError("an empty folder of SQLite files has no schema: give one")
        con = opened(first)
        try:
            return [(r[1], r[2]) for r in _info(con, self.options["table"])]
        finally:
            con.close()

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, spark_type(d)) for n, d in self._columns()])

    def reader(self, schema: T.StructType) -> Reader:
        held = self._columns() if files(self.options["path"]) else []
        lacking = [f.name for f in schema.fields if held and f.name not in dict(held)]
        if lacking:
            raise ValueError(f"no columns {lacking} in {self.options['table']}")
        affinity = {T.LongType: "INTEGER", T.StringType: "TEXT", T.DoubleType: "REAL"}
        # a filter may go to SQLite where the stored values compare as Spark's do
        sure = {n: affinity[type(spark_type(d))] for n, d in held if any(x in d.upper() for x in ("INT", "CHAR", "CLOB", "TEXT", "REAL", "FLOA", "DOUB"))}
        sure = {f.name: sure[f.name] for f in schema.fields if f.name in sure and affinity.get(type(f.dataType)) == sure[f.name]}
        return Reader(schema, self.options["path"], self.options["table"], int(self.options.get("rows", ROWS)), sure)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(schema, self.options["path"], self.options["table"], overwrite)


def _ready(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Sqlite)


def table(spark: SparkSession, path: str, name: str, columns: list[str] | None = None, rows: int = ROWS) -> DataFrame:
    """A table or view; of the ``columns`` only, where given. Filters on it go into SQLite's statement."""
    _ready(spark)
    made = spark.read.format("querent_sqlite").option("path", path).option("table", name).option("rows", str(rows))
    if columns is None:
        return made.load()
    whole = {f.name: f for f in Sqlite({"path": path, "table": name}).schema().fields}
    return made.schema(T.StructType([whole.get(c) or T.StructField(c, T.StringType()) for c in columns])).load()


def write(df: DataFrame, path: str, name: str, mode: str = "append") -> None:
    """Rows as a folder of SQLite files, one a partition; ``mode``: append or overwrite."""
    _ready(df.sparkSession)
    df.write.format("querent_sqlite").option("path", path).option("table", name).mode(mode).save()


def catalog(spark: SparkSession, path: str, db_id: str = "main") -> tuple[DataFrame, DataFrame]:
    """Two tables of a file's (or of a folder's first file's) schema: columns with their defaults and places in the
    primary key (from 1; 0: not in it), and foreign keys; a key to a table as such is to its primary key."""
    con = opened(files(path)[0])
    try:
        names = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name")]
        infos = {n: _info(con, n) for n in names}
        keys = []
        for n in names:
            for r in con.execute(f"PRAGMA foreign_key_list({quoted(n)})"):
                target = [x[1] for x in sorted(infos.get(r[2], []), key=lambda x: x[5]) if x[5]]
                keys.append((db_id, n, r[3], r[2], r[4] if r[4] is not None else target[r[1]] if r[1] < len(target) else None))
    finally:
        con.close()
    away = {k[1:3] for k in keys}
    rows = [(db_id, n, r[0], r[1], r[2], bool(r[3]), r[5] > 0, (n, r[1]) in away, r[4], r[5]) for n in names for r in infos[n]]
    return spark.createDataFrame(rows, DETAILS), spark.createDataFrame(sorted(keys, key=str), REFERENCES)
