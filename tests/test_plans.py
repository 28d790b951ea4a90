from __future__ import annotations

import pytest

from querent.plans import dialect, execute, lineage, repair, sqljvm, typed
from querent.sources.catalog import register

SCHEMA = {"orders": ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"], "customer": ["c_custkey", "c_name"], "a": ["id", "x"], "b": ["id", "y"]}


@pytest.fixture(scope="module", autouse=True)
def views(spark, sf):
    register(spark, sf, ["orders", "customer"])


@pytest.mark.parametrize(
    ("step", "sql", "want"),
    [
        (repair.nulls_last, "SELECT a FROM t ORDER BY a, b DESC LIMIT 3", "SELECT a FROM t ORDER BY a NULLS LAST, b DESC LIMIT 3"),
        (repair.nulls_last, "SELECT a FROM t ORDER BY a", None),
        (repair.nulls_last, "SELECT a FROM t ORDER BY a ASC NULLS FIRST LIMIT 1", None),
        (repair.drop_scalar_sort, "SELECT MAX(a) FROM t ORDER BY b", "SELECT MAX(a) FROM t"),
        (repair.drop_scalar_sort, "SELECT g, MAX(a) FROM t GROUP BY g ORDER BY g", None),
        (repair.drop_scalar_sort, "SELECT a FROM t ORDER BY b", None),
        (repair.split_concat, "SELECT a || '-' || b AS c, d FROM t", "SELECT a, b, d FROM t"),
        (repair.split_concat, "SELECT a || '-' AS c FROM t", None),
        (repair.split_concat, "SELECT a FROM t WHERE a || b = 'x'", None),
        (repair.extreme_to_top, "SELECT k FROM t WHERE a = (SELECT MIN(a) FROM t)", "SELECT k FROM t ORDER BY a ASC NULLS LAST LIMIT 1"),
        (repair.extreme_to_top, "SELECT k FROM t WHERE a = (SELECT MAX(a) FROM u)", None),
        (repair.extreme_to_top, "SELECT k FROM t WHERE a = (SELECT MAX(a) FROM t WHERE b = 1)", None),
        (repair.extreme_to_top, "SELECT k FROM t WHERE a = (SELECT MAX(a) FROM t) LIMIT 2", None),
        (repair.nulls_last, "this is not sql", None),
    ],
)
def test_repairs(spark, step, sql, want):
    assert step(spark, sql) == (want or sql)


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT o.o_custkey FROM orders o", {("orders", "o_custkey")}),
        ("SELECT * FROM customer", set()),
        ("SELECT id FROM a", {("a", "id")}),
        ("SELECT id FROM a JOIN b USING (id)", {("a", "id"), ("b", "id")}),
        ("WITH q AS (SELECT c_name n FROM customer) SELECT n FROM q WHERE n IN (SELECT o_custkey FROM orders)", {("customer", "c_name"), ("orders", "o_custkey")}),
        ("SELECT `c_name` FROM customer WHERE c_name = 'o_custkey'", {("customer", "c_name")}),
        ("SELEC c_name FROM customer WHER x", {("customer", "c_name")}),
        ("SELEC orders . `o_custkey` FROM `customer` WHER c_name = 'y o_orderdate' (", {("customer", "c_name"), ("orders", "o_custkey")}),
        ("SELEC id FROM b WHER (", {("b", "id")}),
    ],
)
def test_lineage(spark, sql, want):
    found = lineage.columns(spark, sql, SCHEMA)
    assert {f for f in found if f != ("a", "x")} == want


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT 1", "WITH a AS (SELECT 1) SELECT * FROM a", "SELECT 1 + 2 - 3 || 'x'", "SELECT current_date + INTERVAL 1 DAY", "SELECT CASE WHEN 1 + 1 = 2 THEN replace('a', 'a', 'b') END",
        "SELECT * FROM orders WHERE (o_orderkey, o_custkey) IN (SELECT 1, 2)", "SELECT 1 UNION SELECT 2 EXCEPT SELECT 3", "SELECT add_months(current_date, 1), date_add(current_date, 1)",
        "SELECT sum(o_totalprice) OVER (PARTITION BY o_custkey) FROM orders", "VALUES (1), (2)", "SELECT * FROM orders TABLESAMPLE (1 ROWS)",
    ],
)
def test_reads(spark, sql):
    assert sqljvm.is_query(spark, sql)
    assert execute.run(spark, sql).ok


@pytest.mark.parametrize(
    "sql",
    [
        "DROP TABLE x", "INSERT INTO x SELECT 1", "WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a", "CREATE TABLE x AS SELECT 1", "CREATE VIEW v AS SELECT 1", "DELETE FROM x", "UPDATE x SET a = 1",
        "MERGE INTO x USING y ON x.a = y.a WHEN MATCHED THEN DELETE", "ALTER TABLE x ADD COLUMN c INT", "TRUNCATE TABLE x", "SET a = 1", "CACHE TABLE x", "REFRESH TABLE x", "USE y", "ADD JAR 'x'",
        "INSERT OVERWRITE DIRECTORY '/tmp/x' USING parquet SELECT 1", "SELECT TRANSFORM (o_custkey) USING 'cat' AS (a) FROM orders", "BEGIN SELECT 1; END", "nonsense", "SELECT 1; SELECT 2",
    ],
)
def test_writes_are_refused(spark, sql):
    assert not sqljvm.is_query(spark, sql)


def test_run(spark):
    assert execute.run(spark, "SELECT 1 AS a").ok
    assert execute.run(spark, " ").error == "blank"
    assert execute.run(spark, "DROP VIEW orders").error == "not a query"
    assert not execute.run(spark, "SELECT no_such FROM orders").ok


def test_equality(spark):
    q = spark.sql
    assert execute.equal(q("SELECT 1 a, null b UNION ALL SELECT 1, null"), q("SELECT 1.0 x, null y"))
    assert execute.equal(q("SELECT true a"), q("SELECT 1 a"))
    assert not execute.equal(q("SELECT 1 a"), q("SELECT 1 a, 2 b"))
    assert not execute.equal(q("SELECT 1 a"), q("SELECT 2 a"))
    assert execute.digest(q("SELECT 1 a UNION ALL SELECT 2")).first() == execute.digest(q("SELECT 2 b UNION ALL SELECT 1 UNION ALL SELECT 1")).first()


def test_dialect(spark):
    assert dialect.translate("SELECT IIF(a > 1, 'IIF(', b) FROM t WHERE \"my col\" LIKE 'A%'") == "SELECT if(a > 1, 'IIF(', b) FROM t WHERE `my col` ILIKE 'A%'"
    assert spark.sql(dialect.translate("SELECT STRFTIME('%Y', MAX(o_orderdate)) AS y, CAST('abc' AS REAL) AS n FROM orders")).first().n is None


TYPES = {"t": {"i": "int", "j": "bigint", "r": "double", "s": "string"}, "u": {"i": "string", "k": "int"}}


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT 5 / 2", 2), ("SELECT -5 / 2", -2), ("SELECT 5 / 2.0", 2.5), ("SELECT 5 / 0", None), ("SELECT 5.0 / 0", None), ("SELECT 5 % 0", None), ("SELECT 7 / 2 / 2", 1), ("SELECT (1 + 6) / (1 + 1)", 3),
        ("SELECT COUNT(*) / 2 FROM t", 1), ("SELECT SUM(i) / COUNT(*) FROM t", 2), ("SELECT SUM(r) / COUNT(*) FROM t", 2.25), ("SELECT x / 2 FROM (SELECT i AS x FROM t WHERE i = 3)", 1), ("SELECT (SELECT MAX(i) FROM t) / 2", 1),
        ("SELECT MAX(1, 3, 2)", 3), ("SELECT MIN(1, NULL)", None), ("SELECT MAX(i) FROM t", 3), ("SELECT MAX(MIN(i, 2), 1) FROM t WHERE i = 3", 2),
        ("SELECT CAST('abc' AS REAL)", 0.0), ("SELECT CAST('12.9kg' AS INTEGER)", 12), ("SELECT CAST(' 1.5e2x' AS REAL)", 150.0), ("SELECT CAST(NULL AS REAL)", None), ("SELECT CAST(2.9 AS INTEGER)", 2), ("SELECT CAST(CAST('7x' AS INTEGER) AS TEXT)", "7"),
        ("SELECT 1 = '1'", False), ("SELECT 1 < '0'", True), ("SELECT '0' < 1", False), ("SELECT i = '3' FROM t WHERE i = 3", True), ("SELECT s = 10 FROM t WHERE i = 1", True), ("SELECT COUNT(*) FROM t WHERE i = 'x'", 0), ("SELECT 1 + 1 = '2'", False),
        ("SELECT s FROM (SELECT s, MAX(i) FROM t)", "c"), ("SELECT s FROM (SELECT s, MIN(i) FROM t)", "10"), ("SELECT s FROM (SELECT s, COUNT(*) FROM t)", "10"), ("SELECT COUNT(*) FROM (SELECT i AS g, s FROM t GROUP BY g, s)", 2),
        ("SELECT ROW_NUMBER() OVER (ORDER BY i) + i / 2 FROM t WHERE i = 3", 2), ("SELECT i FROM t WHERE s = '1 = ''1'' / MAX(1, 2)'", "none"),
    ],
)
def test_typed_dialect(spark, sql, want):
    spark.createDataFrame([(1, 4, 1.5, "10"), (3, 2, 3.0, "c")], "i int, j bigint, r double, s string").createOrReplaceTempView("t")
    row = spark.sql(typed.rewrite(spark, sql, TYPES)).first()
    assert (row[0] if row else "none") == want


def test_unknown_types_and_broken_statements_stay(spark):
    assert typed.rewrite(spark, "SELECT a / b FROM nowhere", TYPES) == "SELECT a / b FROM nowhere"
    assert typed.rewrite(spark, "SELECT u.i / t.i FROM t JOIN u ON u.k = t.j", TYPES) == "SELECT u.i / t.i FROM t JOIN u ON u.k = t.j"
    assert typed.rewrite(spark, "SELEC 5 / 2", TYPES) == "SELEC 5 / 2"
    assert typed.reserved(spark, "SELECT select FROM from WHERE where") and not typed.reserved(spark, "SELECT a FROM t")
    assert spark.conf.get("spark.sql.ansi.enforceReservedKeywords", "false") == "false"
