"""One query for each operator of the engine over the supplied tables, with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.functions import render, text
from querent.functions.shingles import kshingles, signatures
from querent.operators import ann, evaluate, link, lookup, profile, similar, sketch, vector, vote
from querent.plans import dialect, execute, lineage, repair, typed
from querent.sources import catalog as cat
from querent.session import scratch
from querent.sources import files, sqlite

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
#: Columns and types of the star schema, as the oracle's side states them.
COLUMNS = {
    "customer": "c_custkey:bigint c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string",
    "lineitem": "l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:double l_extendedprice:double l_discount:double l_tax:double l_returnflag:string l_linestatus:string l_shipdate:timestamp_ntz",
    "nation": "n_nationkey:int n_name:string n_regionkey:int",
    "orders": "o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:double o_orderdate:timestamp_ntz o_orderpriority:string",
    "part": "p_partkey:bigint p_name:string p_brand:string p_type:string p_size:int p_retailprice:double",
    "region": "r_regionkey:int r_name:string",
    "supplier": "s_suppkey:bigint s_name:string s_nationkey:int s_acctbal:double",
}
_FIELDS = [(t, i, *c.split(":")) for t in sorted(COLUMNS) for i, c in enumerate(COLUMNS[t].split())]
_VALUES = ", ".join(f"({g}, '{t}', {i}, '{c}', '{k}', {c in cat.KEYS[t]}, {(t, c) in cat.REFERENCES})".lower() for g, (t, i, c, k) in enumerate(_FIELDS))
#: The catalog as the oracle sees it.
CATALOG_SQL = f'(VALUES {_VALUES}) AS catalog(g, "table", ordinal, "column", type, is_pk, is_fk)'


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, path: str, name: str) -> DataFrame:
    return cat.table(spark, path, name)


def _each(columns: list[str], body: str) -> str:
    return " UNION ALL ".join(body.format(c=c) for c in columns)


def names(table: str) -> list[str]:
    return [c.split(":")[0] for c in COLUMNS[table].split()]


def star_catalog(spark: SparkSession, path: str) -> DataFrame:
    return cat.catalog(spark, path, STAR)


# Profiles


@query(" UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*)::BIGINT AS n_rows FROM {n}" for n in sorted(cat.KEYS)))
def profile_row_counts(spark: SparkSession, path: str) -> DataFrame:
    out = None
    for n in sorted(cat.KEYS):
        one = t(spark, path, n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table"), "n_rows")
        out = one if out is None else out.unionAll(one)
    return out


@query(_each(names("customer"), "SELECT '{c}' AS \"column\", count(*)::BIGINT AS n_rows, count(*) FILTER ({c} IS NULL)::BIGINT AS null_count FROM (SELECT * REPLACE (nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, nullif(c_nationkey, 3) AS c_nationkey) FROM customer)"))
def profile_null_counts(spark: SparkSession, path: str) -> DataFrame:
    df = t(spark, path, "customer").withColumns({"c_mktsegment": F.nullif("c_mktsegment", F.lit("BUILDING")), "c_nationkey": F.nullif("c_nationkey", F.lit(3))})
    return profile.plain_stats(df).select("column", "n_rows", "null_count")


@query(_each(names("lineitem"), "SELECT '{c}' AS \"column\", count(DISTINCT {c})::BIGINT AS distinct_count FROM lineitem"))
def profile_distinct_counts(spark: SparkSession, path: str) -> DataFrame:
    return profile.distinct_counts(t(spark, path, "lineitem"))


@query("SELECT count(DISTINCT o_custkey)::BIGINT AS distinct_count FROM (SELECT o_custkey FROM orders ORDER BY o_orderkey LIMIT 1000)")
def profile_distinct_limited(spark: SparkSession, path: str) -> DataFrame:
    return profile.distinct_limited(t(spark, path, "orders"), "o_custkey", 1000, "o_orderkey")


@query(_each(names("orders"), "SELECT '{c}' AS \"column\", min({c})::VARCHAR AS min, max({c})::VARCHAR AS max FROM orders"))
def profile_min_max(spark: SparkSession, path: str) -> DataFrame:
    return profile.plain_stats(t(spark, path, "orders")).select("column", "min", "max")


_NUMERIC = [c.split(":")[0] for c in COLUMNS["lineitem"].split() if c.split(":")[1] in ("bigint", "int", "double")]


@query(_each(_NUMERIC, "SELECT '{c}' AS \"column\", round(avg({c}::DOUBLE), 4) AS avg, round(stddev_pop({c}::DOUBLE), 4) AS std FROM lineitem"))
def profile_avg_std(spark: SparkSession, path: str) -> DataFrame:
    return profile.plain_stats(t(spark, path, "lineitem").select(*_NUMERIC)).select("column", "avg", "std")


_PREFIX_SQL = r"coalesce(try_cast(regexp_extract({c}::VARCHAR, '^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)', 1) AS DOUBLE), 0)"


@query(_each(["o_orderpriority", "o_orderstatus", "o_orderdate"], f"SELECT '{{c}}' AS \"column\", round(avg({_PREFIX_SQL}), 4) AS avg, round(stddev_pop({_PREFIX_SQL}), 4) AS std FROM orders"))
def profile_text_numeric_prefix(spark: SparkSession, path: str) -> DataFrame:
    df = t(spark, path, "orders").select("o_orderpriority", "o_orderstatus", F.col("o_orderdate").cast("string"))
    return profile.plain_stats(df, text_numbers=True).select("column", "avg", "std")


_TOP = "SELECT \"column\", value, n, rank FROM (SELECT \"column\", value, n, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value)::INTEGER AS rank FROM ({h})) WHERE rank <= {k}"
_HIST = "SELECT '{{c}}' AS \"column\", {{c}}::VARCHAR AS value, count(*)::BIGINT AS n FROM {t} WHERE {{c}} IS NOT NULL GROUP BY ALL"


@query(_TOP.format(h=_each(names("part"), _HIST.format(t="part")), k=5))
def profile_top_values(spark: SparkSession, path: str) -> DataFrame:
    return profile.top_values(t(spark, path, "part"), 5)


_FIRST = "SELECT \"column\", value, rank FROM (SELECT \"column\", value, row_number() OVER (PARTITION BY \"column\" ORDER BY key)::INTEGER AS rank FROM ({cells})) WHERE rank <= {n}"


def _cells(table: str, key: str) -> str:
    return _each(names(table), f"SELECT {key} AS key, '{{c}}' AS \"column\", {{c}}::VARCHAR AS value FROM {table} WHERE {{c}} IS NOT NULL")


@query(_FIRST.format(cells=_cells("part", "p_partkey"), n=5))
def profile_samples(spark: SparkSession, path: str) -> DataFrame:
    return profile.samples(t(spark, path, "part"), "p_partkey", 5)


_SHAPE = """SELECT "column", round(avg(length(value)), 1) AS avg_len, min(length(value))::INTEGER AS min_len, max(length(value))::INTEGER AS max_len,
  round(100 * sum(d) / sum(length(value)), 1) AS pct_digits, round(100 * sum(u) / sum(length(value)), 1) AS pct_upper,
  round(100 * sum(l) / sum(length(value)), 1) AS pct_lower, round(100 * (sum(length(value)) - sum(d) - sum(u) - sum(l)) / sum(length(value)), 1) AS pct_other
FROM (SELECT *, length(regexp_replace(value, '[^0-9]', '', 'g')) AS d, length(regexp_replace(value, '[^A-Z]', '', 'g')) AS u, length(regexp_replace(value, '[^a-z]', '', 'g')) AS l
  FROM ({s})) GROUP BY "column\""""


@query(_SHAPE.format(s=_FIRST.format(cells=_cells("customer", "c_custkey"), n=100)))
def profile_shape(spark: SparkSession, path: str) -> DataFrame:
    return profile.shape(profile.samples(t(spark, path, "customer"), "c_custkey", 100))


@query(f"""WITH s AS ({_FIRST.format(cells=_cells("customer", "c_custkey"), n=100)}),
c AS (SELECT "column", arg_min(value, length(value) * 1000 + rank) AS least FROM s GROUP BY 1),
p AS (SELECT "column", unnest(list_transform(range(1, length(least) + 1), lambda i: substring(least, 1, i::INTEGER))) AS prefix FROM c),
g AS (SELECT p."column", prefix FROM p JOIN s ON s."column" = p."column" GROUP BY ALL HAVING avg(starts_with(value, prefix)::INTEGER) >= 0.8)
SELECT c."column", coalesce(arg_max(prefix, length(prefix)), '') AS common_prefix FROM c LEFT JOIN g ON g."column" = c."column" GROUP BY 1""")
def profile_common_prefix(spark: SparkSession, path: str) -> DataFrame:
    return profile.common_prefix(profile.samples(t(spark, path, "customer"), "c_custkey", 100))


def _batches(spark: SparkSession, path: str, table: str, column: str, values: list[str]) -> DataFrame:
    """Merged sketches of a table that comes in a batch for each value of a column."""
    df = t(spark, path, table)
    return sketch.merged(reduce(DataFrame.unionByName, [sketch.sketch(df.filter(F.col(column) == v)) for v in values]))


@query(_each(names("lineitem"), "SELECT '{c}' AS \"column\", count(*)::BIGINT AS n_rows, count(*) FILTER ({c} IS NULL)::BIGINT AS null_count, min({c})::VARCHAR AS min, max({c})::VARCHAR AS max, true AS distinct_ok FROM lineitem"))
def sketch_merged_profile(spark: SparkSession, path: str) -> DataFrame:
    """Three batches' sketches as one profile; distinct counts within their bound of the exact ones."""
    made = sketch.estimates(_batches(spark, path, "lineitem", "l_returnflag", ["A", "N", "R"]))
    exact = profile.distinct_counts(t(spark, path, "lineitem")).withColumnRenamed("distinct_count", "exact")
    near = F.abs(F.col("distinct_count") - F.col("exact")) <= 0.05 * F.col("exact") + 0.5
    return made.join(exact, "column").select("column", "n_rows", "null_count", "min", "max", near.alias("distinct_ok"))


@query(_each(_NUMERIC, "SELECT '{c}' AS \"column\", round(avg({c}::DOUBLE), 4) AS avg, round(stddev_pop({c}::DOUBLE), 4) AS std, true AS median_ok FROM lineitem"))
def sketch_moments_quantiles(spark: SparkSession, path: str) -> DataFrame:
    """Mean and deviation of merged batches, and whether a hundredth of the rows at most parts the median from the exact one."""
    df = t(spark, path, "lineitem")
    made = sketch.estimates(_batches(spark, path, "lineitem", "l_returnflag", ["A", "N", "R"])).filter("quantiles is not null")
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in _NUMERIC])
    met = df.select(F.inline(cells)).join(F.broadcast(made.select("column", F.col("quantiles")[1].alias("m"))), "column")  # a row a column
    near = met.groupBy("column").agg(((F.avg((F.col("x") < F.col("m")).cast("int")) <= 0.51) & (F.avg((F.col("x") <= F.col("m")).cast("int")) >= 0.49)).alias("median_ok"))
    return made.join(near, "column").select("column", "avg", "std", "median_ok")


@query(_TOP.format(h=_each(["p_brand", "p_type", "p_size"], _HIST.format(t="part")), k=5))
def sketch_top_values(spark: SparkSession, path: str) -> DataFrame:
    """The most frequent values of two batches, parted by the key."""
    df = t(spark, path, "part")
    made = sketch.estimates(sketch.merged(sketch.sketch(df.filter("p_partkey % 3 = 0")).unionByName(sketch.sketch(df.filter("p_partkey % 3 <> 0")))))
    top = made.filter(F.col("column").isin("p_brand", "p_type", "p_size")).select("column", F.posexplode("top_values").alias("rank", "x"))
    return top.select("column", "x.value", "x.n", (F.col("rank") + 1).alias("rank"))


def _long_sql(table: str) -> str:
    out = []
    for c, kind in (x.split(":") for x in COLUMNS[table].split()):
        num = f"round(avg({c}::DOUBLE), 4), round(stddev_pop({c}::DOUBLE), 4)" if kind in ("bigint", "int", "double") else "NULL::DOUBLE, NULL::DOUBLE"
        out.append(f"SELECT '{c}', count(*)::BIGINT, count(*) - count({c}), min({c})::VARCHAR, max({c})::VARCHAR, {num}, count(DISTINCT {c})::BIGINT FROM {table}")
    top = _TOP.format(h=_each(names(table), _HIST.format(t=table)), k=5)
    return f"""SELECT s.*, v.top_values FROM ({' UNION ALL '.join(out)}) AS s("column", n_rows, null_count, min, max, avg, std, distinct_count)
    LEFT JOIN (SELECT "column", string_agg(value || ' (' || n || ')', ', ' ORDER BY rank) AS top_values FROM ({top}) GROUP BY 1) v ON v."column" = s."column\""""


@query(_long_sql("lineitem"))
def profile_long(spark: SparkSession, path: str) -> DataFrame:
    p = profile.long_profile(t(spark, path, "lineitem"))
    shown = F.array_join(F.transform("top_values", lambda x: F.concat(x["value"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ")
    return p.select("column", "n_rows", "null_count", "min", "max", "avg", "std", "distinct_count", shown.alias("top_values"))


@query(_TOP.replace("\"column\", value, n, rank FROM (SELECT \"column\", value, n,", "\"column\", value FROM (SELECT \"column\", value, n,").replace("n DESC, value", "value").format(h=_each(["p_name", "p_brand", "p_type"], _HIST.format(t="part")), k=20))
def distinct_values_capped(spark: SparkSession, path: str) -> DataFrame:
    return profile.distinct_values(t(spark, path, "part"), 20, ["p_name", "p_brand", "p_type"])


# Catalog, schemas, documentation


@query(f'SELECT "table", ordinal, "column", type, is_pk, is_fk FROM {CATALOG_SQL}')
def catalog_columns(spark: SparkSession, path: str) -> DataFrame:
    return star_catalog(spark, path).select("table", "ordinal", "column", "type", "is_pk", "is_fk")


_DOCS = [("nation", "n_name", "Name of the nation", "text"), ("orders", "o_orderstatus", "State of the order", "one letter"), ("orders", "o_totalprice", "Price of all items", None), ("orders", "no_such_column", "Not in any table", None)]
_DOCS_SQL = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in d) + ")" for d in _DOCS)


@query(f'SELECT c."table", c."column", d.description, d.data_format, d.description IS NOT NULL AS has_doc FROM {CATALOG_SQL} c LEFT JOIN (VALUES {_DOCS_SQL}) AS d("table", "column", description, data_format) ON d."table" = c."table" AND d."column" = c."column"'.replace("AS catalog(g", "AS c(g").replace(") c LEFT", ") LEFT"))
def join_profile_docs(spark: SparkSession, path: str) -> DataFrame:
    docs = spark.createDataFrame(_DOCS, "table string, column string, description string, data_format string")
    return star_catalog(spark, path).join(docs, ["table", "column"], "left").select("table", "column", "description", "data_format", F.col("description").isNotNull().alias("has_doc"))


@query(f"""WITH c AS (SELECT * FROM {CATALOG_SQL}), f AS (SELECT 1 AS question_id, "table", "column" FROM c WHERE "column" LIKE '%name%' UNION SELECT 2, "table", "column" FROM c WHERE "column" LIKE '%price%')
SELECT * FROM f UNION SELECT DISTINCT f.question_id, c."table", c."column" FROM f JOIN c ON c."table" = f."table" AND c.is_pk""")
def focused_with_pk(spark: SparkSession, path: str) -> DataFrame:
    c = star_catalog(spark, path)
    focused = c.filter("column like '%name%'").select(F.lit(1).alias("question_id"), "table", "column").unionAll(c.filter("column like '%price%'").select(F.lit(2), "table", "column"))
    return link.with_primary_keys(focused, c)


@query(f"""SELECT 'CREATE TABLE ' || "table" || ' (' || chr(10) || string_agg('  ' || "column" || ' ' || type, ',' || chr(10) ORDER BY ordinal) || chr(10) || ');' AS schema_text, "table" FROM {CATALOG_SQL} GROUP BY "table\"""")
def render_schema(spark: SparkSession, path: str) -> DataFrame:
    c = star_catalog(spark, path).withColumn("name", F.col("table"))
    return render.schema_text(c, ["name"]).select("schema_text", F.col("name").alias("table"))


@query(f"""WITH c AS (SELECT * FROM {CATALOG_SQL}) SELECT "table", ordinal, "column", type FROM c WHERE "column" LIKE '%key'""")
def pruned_schema(spark: SparkSession, path: str) -> DataFrame:
    c = star_catalog(spark, path)
    return link.pruned(c, c.filter("column like '%key'").select(F.lit(1).alias("question_id"), "table", "column")).select("table", "ordinal", "column", "type")


@query()
def render_profile(spark: SparkSession, path: str) -> DataFrame:
    p = profile.long_profile(t(spark, path, "customer"), "c_custkey").withColumn("table", F.lit("customer"))
    return render.profile_text(p.join(star_catalog(spark, path).select("table", "column", "type", "is_pk"), ["table", "column"])).select("table", "column", "profile_text")


@query()
def column_comment(spark: SparkSession, path: str) -> DataFrame:
    p = render_profile(spark, path)
    short = F.concat(F.lit("About "), "column", F.lit("."))
    full = render.full_profile(F.col("profile_text"), short, F.lit(None).cast("string"), F.lit(""))
    return p.select("column", *[render.column_comment(m, short, F.col("profile_text"), full).alias(m) for m in ("short", "long", "full")])


@query()
def seeded_column_order(spark: SparkSession, path: str) -> DataFrame:
    return link.shuffled(star_catalog(spark, path), 42)


@query("""SELECT item_id, 'Answer the question with one SQL query over the schema.' || chr(10) || chr(10) || '### Schema' || chr(10) || 'CREATE TABLE t (' || chr(10) || '  a int' || chr(10) || ');' || chr(10) || chr(10) || '### Question' || chr(10) || text || chr(10) || chr(10) || '### SQL' || chr(10) || 'Give only the query.' AS prompt FROM benchmark""")
def build_prompt(spark: SparkSession, path: str) -> DataFrame:
    return t(spark, path, "benchmark").select("item_id", render.prompt(F.col("text"), F.lit("CREATE TABLE t (\n  a int\n);"), F.lit("")).alias("prompt"))


# Text


_TITLE_SQL = "array_to_string(list_transform(regexp_extract_all(v, '[A-Za-z]+|[^A-Za-z]+'), lambda x: upper(x[1:1]) || lower(x[2:])), '')"
_VALUES_SQL = "SELECT c_mktsegment AS v FROM customer UNION SELECT p_brand FROM part UNION SELECT p_type FROM part UNION SELECT o_orderpriority FROM orders"


@query(f"SELECT DISTINCT v AS value, unnest([v, lower(v), upper(v), {_TITLE_SQL}, regexp_replace(v, '[^A-Za-z0-9_\\s]', '', 'g')]) AS variant FROM (SELECT trim(v) AS v FROM ({_VALUES_SQL}))")
def value_variants(spark: SparkSession, path: str) -> DataFrame:
    parts = [t(spark, path, a).select(F.col(c).alias("value")) for a, c in (("customer", "c_mktsegment"), ("part", "p_brand"), ("part", "p_type"), ("orders", "o_orderpriority"))]
    values = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).distinct()
    return values.select("value", F.explode(text.value_variants(F.col("value"))).alias("variant"))


@query("SELECT p_partkey, unnest(list_transform(range(1, greatest(length(p_name) - 2, 1) + 1), lambda i: substring(p_name, i::INTEGER, 3))) AS shingle FROM part")
def kshingle_rows(spark: SparkSession, path: str) -> DataFrame:
    return t(spark, path, "part").select("p_partkey", F.explode(kshingles(F.col("p_name"))).alias("shingle"))


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, list_distinct(list_transform(range(1, length(s_name) - 1), lambda i: substring(s_name, i::INTEGER, 3))) AS g FROM supplier)
SELECT a.s_suppkey AS a, b.s_suppkey AS b, round(len(list_intersect(a.g, b.g))::DOUBLE / len(list_distinct(list_concat(a.g, b.g))), 6) AS similarity FROM s a JOIN s b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""")
def shingle_jaccard(spark: SparkSession, path: str) -> DataFrame:
    s = t(spark, path, "supplier").select(F.col("s_nationkey").alias("group"), F.col("s_suppkey").alias("key"), kshingles(F.col("s_name")).alias("shingles"))
    return similar.all_pairs(s)


@query(r"""SELECT event_id, array_to_string(list_concat(q, list_concat(u, n)), '|') AS literals FROM (SELECT event_id,
  regexp_extract_all(props, '["'']([^"'']+)["'']', 1) AS q, regexp_extract_all(props, '\b[A-Z][A-Z0-9]{1,}\b') AS u, regexp_extract_all(props, '\b\d{4}\b|\b\d+(?:\.\d+)?\b') AS n FROM events)""")
def extract_literals(spark: SparkSession, path: str) -> DataFrame:
    return t(spark, path, "events").select("event_id", F.array_join(text.extract_literals(F.col("props")), "|").alias("literals"))


@query()
def extract_literals_documents(spark: SparkSession, path: str) -> DataFrame:
    return t(spark, path, "documents").select("doc_id", text.extract_literals(F.col("text")).alias("literals"))


@query("SELECT conv_id, turn, (SELECT count(DISTINCT x)::INTEGER FROM unnest(string_split(text, ' ')) AS u(x) WHERE x <> '') AS n_kept FROM conversations")
def literals_dedup(spark: SparkSession, path: str) -> DataFrame:
    return t(spark, path, "conversations").select("conv_id", "turn", F.size(text.kept(F.split("text", " "))).alias("n_kept"))


_STATEMENT = "concat('SELECT c_custkey FROM customer WHERE c_mktsegment = ''', c_mktsegment, ''' AND c_name = '' ', c_name, '''')"


@query("SELECT c_custkey, c_mktsegment || '|' || c_name AS literals FROM customer")
def sql_string_literals(spark: SparkSession, path: str) -> DataFrame:
    sql = F.concat(F.lit("SELECT c_custkey FROM customer WHERE c_mktsegment = '"), "c_mktsegment", F.lit("' AND c_name = ' "), "c_name", F.lit("'"))
    return t(spark, path, "customer").select("c_custkey", F.array_join(text.sql_literals(sql), "|").alias("literals"))


@query(r"""SELECT o_orderkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  'List the ID AND SUM of orders of ' || year(o_orderdate) || ' with priority ''' || o_orderpriority || ''' over ' || floor(o_totalprice)::BIGINT || '.5 by ' || o_custkey + 100000,
  '["''][^"'']{1,100}["'']', '<value>', 'g'), '\b(?:19|20)\d{2}\b', '<year>', 'g'), '\b\d+(?:\.\d+)?\b', '<number>', 'g'), '\bSUM\b', '<code>', 'g') AS masked FROM orders""")
def mask_question(spark: SparkSession, path: str) -> DataFrame:
    q = F.concat(F.lit("List the ID AND SUM of orders of "), F.year("o_orderdate").cast("string"), F.lit(" with priority '"), "o_orderpriority", F.lit("' over "), F.floor("o_totalprice").cast("string"), F.lit(".5 by "), (F.col("o_custkey") + 100000).cast("string"))
    return t(spark, path, "orders").select("o_orderkey", text.mask_question(q).alias("masked"))


@query(r"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(regexp_replace(trim(regexp_replace(trim(text), '^`+|`+$', '', 'g')), '```|[ \t\n\f\r\x0B]+', ' ', 'g'), ' +', ' ', 'g')), ' ') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) > 25 THEN regexp_replace(array_to_string(w[1:25], ' '), '[,.]+$', '') || '.' ELSE array_to_string(w, ' ') END AS s FROM w)
SELECT doc_id, CASE WHEN s <> '' AND NOT regexp_matches(s, '[.!?]$') THEN s || '.' ELSE s END AS sentence FROM s""")
def truncate_words(spark: SparkSession, path: str) -> DataFrame:
    return t(spark, path, "documents").select("doc_id", text.one_sentence(F.col("text")).alias("sentence"))


@query("SELECT c_custkey, c_name AS final FROM customer")
def extract_marked(spark: SparkSession, path: str) -> DataFrame:
    raw = F.concat(F.lit("I think ###FINAL_BEGIN### no ###FINAL_END### but then\n###FINAL_BEGIN###\n "), "c_name", F.lit(" \n###FINAL_END### done"))
    return t(spark, path, "customer").select("c_custkey", F.trim(F.regexp_replace(text.final_answer(raw), r"^\s+|\s+$", "")).alias("final"))


@query("SELECT c_custkey, 'SELECT c_name FROM customer WHERE c_custkey = ' || c_custkey || ';' AS fenced, 'SELECT ' || c_nationkey || ' AS n;' AS bare FROM customer")
def extract_sql(spark: SparkSession, path: str) -> DataFrame:
    fenced = F.concat(F.lit("Let me SELECT well.\n```sql\nSELECT c_name FROM customer WHERE c_custkey = "), F.col("c_custkey").cast("string"), F.lit("; -- so\n```\nThat is it"))
    bare = F.concat(F.lit("First I tried\nSELECT wrong\nand then, better,\nSELECT "), F.col("c_nationkey").cast("string"), F.lit(" AS n; or so\n\nmore words"))
    return t(spark, path, "customer").select("c_custkey", text.extract_sql(fenced).alias("fenced"), text.extract_sql(bare).alias("bare"))


# Lookup and vectors


def column_values(spark: SparkSession, path: str) -> DataFrame:
    """Distinct values of the text columns that literals are looked up in."""
    out = None
    for table, column in (("customer", "c_mktsegment"), ("part", "p_brand"), ("part", "p_type"), ("orders", "o_orderpriority"), ("nation", "n_name"), ("region", "r_name")):
        one = t(spark, path, table).select(F.lit(table).alias("table"), F.lit(column).alias("column"), F.col(column).alias("value")).distinct()
        out = one if out is None else out.unionAll(one)
    return out


_INDEX_SQL = " UNION ".join(f"SELECT '{a}' AS \"table\", '{c}' AS \"column\", {c} AS value FROM {a}" for a, c in (("customer", "c_mktsegment"), ("part", "p_brand"), ("part", "p_type"), ("orders", "o_orderpriority"), ("nation", "n_name"), ("region", "r_name")))
_LITERALS = ["building", "Brand#11", "nation_3", "no such thing", "MACHINERY", "1-urgent", "asia"]


def literals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in _LITERALS], "literal string")


_LITERALS_SQL = "(VALUES " + ", ".join(f"('{x}')" for x in _LITERALS) + ") AS l(literal)"


@query(f'SELECT DISTINCT literal, "table", "column" FROM {_LITERALS_SQL} JOIN ({_INDEX_SQL}) v ON lower(l.literal) = lower(v.value)')
def literal_exact_match(spark: SparkSession, path: str) -> DataFrame:
    return lookup.exact_matches(literals(spark), lookup.variant_index(column_values(spark, path))).select("literal", "table", "column")


@query(f"""WITH e AS (SELECT DISTINCT literal, "table", "column" FROM {_LITERALS_SQL} JOIN ({_INDEX_SQL}) v ON lower(l.literal) = lower(v.value)),
a AS (SELECT DISTINCT literal, "table", "column" FROM {_LITERALS_SQL} JOIN ({_INDEX_SQL}) v ON lower(v.value)[1:2] = lower(l.literal)[1:2])
SELECT *, 'exact' AS match_type FROM e UNION ALL SELECT *, 'approximate' FROM a WHERE literal NOT IN (SELECT literal FROM e)""")
def literal_match_fallback(spark: SparkSession, path: str) -> DataFrame:
    values = column_values(spark, path)
    near = literals(spark).join(values, F.lower(F.substring("value", 1, 2)) == F.lower(F.substring("literal", 1, 2))).select("literal", "table", "column").distinct()
    return lookup.exact_else(lookup.exact_matches(literals(spark), lookup.variant_index(values)).select("literal", "table", "column"), near)


@query()
def minhash_signature(spark: SparkSession, path: str) -> DataFrame:
    values = column_values(spark, path)
    return signatures(values.select("table", "column", F.explode(kshingles(F.lower("value"))).alias("shingle")), ["table", "column"])


@query()
def lsh_band_candidates(spark: SparkSession, path: str) -> DataFrame:
    values = column_values(spark, path)
    return lookup.band_candidates(values.select(F.col("value").alias("literal")), values)


@query()
def literal_lookup(spark: SparkSession, path: str) -> DataFrame:
    return lookup.matches(literals(spark), column_values(spark, path))


#: Every text column of the data set, and of which the values are literals that columns are sought for.
_TEXTS = [(a, c) for a, cs in {"benchmark": "text", "conversations": "role text", "customer": "c_name c_mktsegment", "documents": "text lang source", "events": "event_type props", "lineitem": "l_returnflag l_linestatus", "nation": "n_name", "orders": "o_orderstatus o_orderpriority", "pages": "url html", "part": "p_name p_brand p_type", "region": "r_name", "supplier": "s_name"}.items() for c in cs.split()]
_ASKED = [("part", "p_type"), ("part", "p_brand"), ("nation", "n_name"), ("region", "r_name"), ("customer", "c_mktsegment"), ("orders", "o_orderpriority"), ("events", "event_type"), ("pages", "url"), ("documents", "source")]


def text_values(spark: SparkSession, path: str, columns: list[tuple[str, str]] = _TEXTS) -> DataFrame:
    """``table, column, value`` of text columns; equal values are dropped where the index is made."""
    rows = [t(spark, path, a).select(F.lit(a).alias("table"), F.lit(c).alias("column"), F.col(c).alias("value")) for a, c in columns]
    return reduce(DataFrame.unionAll, rows)


_SPOILT_SQL = " UNION ".join(f"SELECT lower({c}[1:3]) || {c}[5:] || 'q' AS literal FROM {a}" for a, c in _ASKED)
_SHINGLES_SQL = "unnest(CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, greatest(length({x}) - 2, 1) + 1), lambda i: substring({x}, i::INTEGER, 3))) END)"
_HELD_SQL = " UNION ".join(f"SELECT '{a}' AS \"table\", '{c}' AS \"column\", {_SHINGLES_SQL.format(x=f'lower(trim({c}))')} AS shingle FROM {a} WHERE {c} IS NOT NULL" for a, c in _TEXTS)


@query(f"""WITH held AS ({_HELD_SQL}), l AS ({_SPOILT_SQL}), s AS (SELECT literal, {_SHINGLES_SQL.format(x='lower(trim(literal))')} AS shingle FROM l),
n AS (SELECT literal, count(*) AS size FROM s GROUP BY 1)
SELECT literal, "table", "column", count(*)::INTEGER AS shared, any_value(size)::INTEGER AS size FROM s JOIN n USING (literal) JOIN held USING (shingle) GROUP BY ALL HAVING count(*) * 100 >= any_value(size) * 80""")
def literal_containment(spark: SparkSession, path: str) -> DataFrame:
    """Misspelt values of nine columns (the fourth letter gone, a letter more) against all text columns."""
    spoilt = F.concat(F.lower(F.substring("value", 1, 3)), F.substring(F.col("value"), F.lit(5), F.lit(1 << 30)), F.lit("q"))
    asked = text_values(spark, path, _ASKED).filter("value is not null").select(spoilt.alias("literal"))
    return lookup.contained(asked, lookup.stored(lookup.shingle_index(text_values(spark, path))))


@query("SELECT c_custkey AS query_id, c_mktsegment AS literal, 'customer' AS \"table\", 'c_mktsegment' AS \"column\" FROM customer WHERE c_nationkey >= 12")
def missing_literal_columns(spark: SparkSession, path: str) -> DataFrame:
    c = t(spark, path, "customer")
    asked = c.select(F.col("c_custkey").alias("query_id"), F.col("c_mktsegment").alias("literal"))
    used = c.select(F.col("c_custkey").alias("query_id"), F.lit("customer").alias("table"), F.when(F.col("c_nationkey") < 12, "c_mktsegment").otherwise("c_name").alias("column"))
    return lookup.missing_columns(asked, lookup.variant_index(column_values(spark, path)), used)


_COS = "list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[])"


@query(f"""SELECT query_id, row_id, round(score, 4) AS score, rank FROM (SELECT q.vec_id AS query_id, r.vec_id AS row_id, {_COS} AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, r.vec_id)::INTEGER AS rank FROM embeddings q JOIN embeddings r ON q.vec_id % 50 = 0) WHERE rank <= 10""")
def embedding_topk_cosine(spark: SparkSession, path: str) -> DataFrame:
    e = t(spark, path, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector.top_k(q, e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector")), 10).withColumn("score", F.round("score", 4))


def _indexed(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """The query set of ``embeddings`` and the path of an inverted file of all its rows."""
    e = t(spark, path, "embeddings")
    folder = f"{scratch(spark)}/ann-{uuid.uuid4().hex}"
    ann.build(e.select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector")), folder, cells=32)
    return e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), folder


@query()
def embedding_ann_topk(spark: SparkSession, path: str) -> DataFrame:
    """Ten neighbours of each query by an inverted file, probed as deep as a sample of its rows asks for."""
    q, folder = _indexed(spark, path)
    return ann.search(q, folder, 10, ann.probes_for(spark, folder)).withColumn("score", F.round("score", 4))


@query("SELECT count(*)::BIGINT AS n_queries, true AS reached FROM embeddings WHERE vec_id % 50 = 0")
def embedding_ann_recall(spark: SparkSession, path: str) -> DataFrame:
    """Whether the inverted file finds nine of ten of the exact neighbours."""
    q, folder = _indexed(spark, path)
    rows = t(spark, path, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").alias("vector"))
    return ann.recall(ann.search(q, folder, 10, ann.probes_for(spark, folder)), vector.top_k(q, rows, 10)).select("n_queries", (F.col("recall") >= 0.9).alias("reached"))


@query(f"""SELECT query_id, row_id, round(score, 4) AS score, rank FROM (SELECT q.vec_id AS query_id, r.vec_id AS row_id, {_COS} AS score,
row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, r.vec_id)::INTEGER AS rank FROM embeddings q JOIN embeddings r ON q.vec_id % 50 = 0 AND q.label <> r.label) WHERE rank <= 8""")
def fewshot_topk_excluding_self(spark: SparkSession, path: str) -> DataFrame:
    e = t(spark, path, "embeddings").select(F.col("vec_id"), F.col("embedding").alias("vector"), F.col("label").alias("own"))
    return vector.top_k(e.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "row_id"), 8).withColumn("score", F.round("score", 4))


@query()
def fewshot_questions(spark: SparkSession, path: str) -> DataFrame:
    b = t(spark, path, "benchmark").withColumnRenamed("text", "question")
    return vector.few_shots(b.filter("item_id % 50 = 0").withColumnRenamed("item_id", "query_id"), b.withColumnRenamed("item_id", "row_id"))


# Linking and lineage


_NAMES = [(1, "doc_id"), (1, "QUALITY"), (2, "text"), (2, "role"), (3, "text"), (3, "n_name"), (3, "n_name")]
_USED = [(1, "labels"), (2, "conversations"), (3, "pages")]


@query("SELECT * FROM (VALUES (1, 'labels', 'doc_id'), (1, 'labels', 'quality'), (2, 'conversations', 'text'), (2, 'conversations', 'role'), (3, 'nation', 'n_name')) AS v(query_id, \"table\", \"column\")")
def column_resolution(spark: SparkSession, path: str) -> DataFrame:
    return lineage.resolve(spark.createDataFrame(_NAMES, "query_id int, name string"), cat.catalog(spark, path), spark.createDataFrame(_USED, "query_id int, table string"))


@query("SELECT * FROM (VALUES ('customer', 'c_custkey'), ('customer', 'c_name'), ('orders', 'o_custkey'), ('orders', 'o_totalprice'), ('orders', 'o_orderdate')) AS v(\"table\", \"column\")")
def sql_lineage(spark: SparkSession, path: str) -> DataFrame:
    sql = "WITH big AS (SELECT o.o_custkey AS k, max(o_totalprice) AS m FROM orders o GROUP BY o.o_custkey) SELECT c.c_name FROM customer c JOIN big ON big.k = c.c_custkey WHERE EXISTS (SELECT 1 FROM orders z WHERE z.o_orderdate > '1995-01-01')"
    return spark.createDataFrame(sorted(lineage.columns(spark, sql, {x: names(x) for x in COLUMNS})), "table string, column string")


@query(f"""WITH c AS (SELECT * FROM {CATALOG_SQL}), near AS (SELECT vec_id AS question_id, c."table", c."column" FROM embeddings JOIN c ON c.g = label),
lit AS (SELECT vec_id AS question_id, c."table", c."column" FROM embeddings JOIN c ON c.g = label + 20), f AS (SELECT * FROM near UNION SELECT * FROM lit)
SELECT * FROM f UNION SELECT f.question_id, c."table", c."column" FROM f JOIN c ON c."table" = f."table" AND c.is_pk""")
def schema_link_focus(spark: SparkSession, path: str) -> DataFrame:
    c = star_catalog(spark, path)
    numbered = spark.createDataFrame([(g, a, n) for g, (a, _, n, _) in enumerate(_FIELDS)], "g int, table string, column string")
    e = t(spark, path, "embeddings").select(F.col("vec_id").alias("question_id"), "label")
    near, held = (e.withColumn("g", F.col("label") + k).join(numbered, "g").select("question_id", "table", "column") for k in (0, 20))
    return link.focus(near, held, c)


@query("SELECT DISTINCT source AS question_id, lang AS \"table\", coalesce(quality::VARCHAR, 'none') AS \"column\" FROM documents LEFT JOIN labels USING (doc_id)")
def link_union(spark: SparkSession, path: str) -> DataFrame:
    d = t(spark, path, "documents").join(t(spark, path, "labels"), "doc_id", "left")
    return link.union_links(d.select(F.col("source").alias("question_id"), F.col("lang").alias("table"), F.coalesce(F.col("quality").cast("string"), F.lit("none")).alias("column")))


@query("SELECT item_id AS question_id, c.* FROM benchmark, (VALUES ('focused_short', 'focused', 'focused', 'short'), ('focused_long', 'focused', 'focused', 'long'), ('full_short', 'all', 'all', 'short'), ('full_long', 'all', 'all', 'long'), ('focused_full', 'focused', 'all', 'full')) AS c(combo, tables, columns, profile_mode)")
def prompt_combos(spark: SparkSession, path: str) -> DataFrame:
    return link.combos(t(spark, path, "benchmark").select(F.col("item_id").alias("question_id")))


# Execution, votes, evaluation


@query("SELECT o_orderstatus AS _0, count(*)::DOUBLE AS _1, sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END)::DOUBLE AS _2 FROM orders GROUP BY 1")
def exec_resultset(spark: SparkSession, path: str) -> DataFrame:
    cat.register(spark, path, ["orders"])
    out = execute.run(spark, dialect.translate("SELECT o_orderstatus, COUNT(*), SUM(IIF(o_totalprice > 100000, 1, 0)) FROM orders GROUP BY o_orderstatus"))
    if not out.ok:
        raise RuntimeError(out.error)
    return out.rows


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*)::BIGINT AS n FROM orders WHERE lower(o_orderpriority) LIKE '%urgent%' GROUP BY 1")
def dialect_translate(spark: SparkSession, path: str) -> DataFrame:
    cat.register(spark, path, ["orders"])
    return spark.sql(dialect.translate("SELECT STRFTIME('%Y-%m', o_orderdate) AS \"month\", COUNT(*) AS n FROM orders WHERE o_orderpriority LIKE '%urgent%' GROUP BY STRFTIME('%Y-%m', o_orderdate)"))


def _typed(spark: SparkSession, path: str, sql: str, *tables: str) -> DataFrame:
    """A statement of the lenient dialect over some tables, rewritten by their types."""
    cat.register(spark, path, list(tables))
    return spark.sql(typed.rewrite(spark, sql, {n: dict(spark.table(n).dtypes) for n in tables}))


@query("SELECT o_orderkey, o_custkey // 7 AS whole, o_totalprice / 7 AS share, CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE o_orderkey // (o_custkey % 2) END AS zero, (o_orderkey + o_custkey) // 3 // 2 AS twice, o_custkey / 2.0 AS half FROM orders")
def dialect_division(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark, path, "SELECT o_orderkey, o_custkey / 7 AS whole, o_totalprice / 7 AS share, o_orderkey / (o_custkey % 2) AS zero, (o_orderkey + o_custkey) / 3 / 2 AS twice, o_custkey / 2.0 AS half FROM orders", "orders")


@query("SELECT o_orderkey, greatest(o_custkey, o_orderkey, 500) AS most, least(o_totalprice, o_custkey) AS least, CASE WHEN o_orderstatus <> 'F' THEN greatest(o_custkey, 100) END AS gone FROM orders")
def dialect_scalar_extremes(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark, path, "SELECT o_orderkey, MAX(o_custkey, o_orderkey, 500) AS most, MIN(o_totalprice, o_custkey) AS least, MAX(IIF(o_orderstatus = 'F', NULL, o_custkey), 100) AS gone FROM orders", "orders")


@query("SELECT p_partkey, 0.0::DOUBLE AS none, substr(p_brand, 7)::BIGINT AS brand, p_size + 0.5::DOUBLE AS half, p_size::BIGINT AS lead, p_size::VARCHAR AS shown FROM part")
def dialect_casts(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark, path, "SELECT p_partkey, CAST(p_brand AS REAL) AS none, CAST(SUBSTR(p_brand, 7) AS INTEGER) AS brand, CAST(' ' || p_size || '.5 kg' AS REAL) AS half, CAST(p_size || '.9e3x' AS INTEGER) AS lead, CAST(p_size AS TEXT) AS shown FROM part", "part")


@query("SELECT c_custkey, false AS never, c_custkey = 5 AS number, false AS word, c_mktsegment = '5' AS text, c_custkey > 700 AS more, true AS before FROM customer")
def dialect_comparisons(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark, path, "SELECT c_custkey, 1 = '1' AS never, c_custkey = '5' AS number, c_custkey = 'five' AS word, c_mktsegment = 5 AS text, c_custkey > '700' AS more, c_custkey < 'word' AS before FROM customer", "customer")


@query("""SELECT o_orderpriority, o_orderstatus, max(o_orderkey) AS top, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1, 2
UNION ALL SELECT 'all', min(o_orderstatus), count(*), min(o_totalprice) FROM orders""")
def dialect_bare_columns(spark: SparkSession, path: str) -> DataFrame:
    """A column beside the only MAX is of its row (the key is unique, so there is one), else the least value."""
    sql = "SELECT o_orderpriority, o_orderstatus, MAX(o_orderkey) AS top, o_totalprice FROM orders GROUP BY o_orderpriority, 2 UNION ALL SELECT 'all', o_orderstatus, COUNT(*), o_totalprice FROM orders"
    return _typed(spark, path, sql, "orders")


@query("WITH a AS (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 9000), b AS (SELECT DISTINCT s_nationkey FROM supplier) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b))::BIGINT AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a))::BIGINT AS only_b, NOT EXISTS (SELECT * FROM a EXCEPT SELECT * FROM b) AND NOT EXISTS (SELECT * FROM b EXCEPT SELECT * FROM a) AS equal")
def resultset_equality(spark: SparkSession, path: str) -> DataFrame:
    return execute.resultset_equality(t(spark, path, "customer").filter("c_acctbal > 9000").select("c_nationkey"), t(spark, path, "supplier").select("s_nationkey"))


def votes(spark: SparkSession, path: str) -> DataFrame:
    """Candidates: each order's items vote with their flags; items flagged R failed, status O is blank SQL."""
    return t(spark, path, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("idx"), F.when(F.col("l_linestatus") == "O", " ").otherwise("SELECT 1").alias("sql"), (F.col("l_returnflag") != "R").alias("ok"), F.concat("l_returnflag", F.floor(F.col("l_quantity") / 20).cast("string")).alias("result"))


_VOTES_SQL = "v AS (SELECT l_orderkey AS question_id, l_linenumber AS idx, CASE WHEN l_linestatus = 'O' THEN ' ' ELSE 'SELECT 1' END AS sql, l_returnflag <> 'R' AS ok, l_returnflag || floor(l_quantity / 20)::INTEGER AS result FROM lineitem)"
_MAJORITY_SQL = f"""WITH {_VOTES_SQL}, g AS (SELECT question_id, result, count(*)::BIGINT AS n, min(idx) AS first, list_sort(list(idx))[2] AS second FROM v WHERE ok GROUP BY question_id, result HAVING count(*) >= 2),
b AS (SELECT question_id, first, n FROM g QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY second, first, result) = 1),
m AS (SELECT question_id, first AS winner_idx, CASE WHEN n IS NULL THEN 'none' ELSE 'majority' END AS method, coalesce(n, 0)::BIGINT AS agreement FROM (SELECT DISTINCT question_id FROM v) LEFT JOIN b USING (question_id))"""


@query(f"{_MAJORITY_SQL} SELECT * FROM m")
def majority_vote(spark: SparkSession, path: str) -> DataFrame:
    return vote.majority(votes(spark, path))


@query(f"""{_MAJORITY_SQL}, o AS (SELECT question_id, min(idx) FILTER (ok) AS valid, min(idx) FILTER (trim(sql) <> '') AS blankless FROM v GROUP BY 1)
SELECT question_id, coalesce(winner_idx, valid, blankless) AS winner_idx, CASE WHEN method = 'majority' THEN method WHEN valid IS NOT NULL THEN 'first_valid' WHEN blankless IS NOT NULL THEN 'fallback' ELSE 'none' END AS method, agreement FROM m JOIN o USING (question_id)""")
def vote_fallback_ladder(spark: SparkSession, path: str) -> DataFrame:
    return vote.ladder(votes(spark, path))


@query(f"""WITH {_VOTES_SQL}, g AS (SELECT question_id, count(*)::BIGINT AS n, min(idx) AS first_idx FROM v WHERE ok GROUP BY question_id, result)
SELECT question_id, first_idx, n, n::DOUBLE / sum(n) OVER (PARTITION BY question_id) AS confidence, row_number() OVER (PARTITION BY question_id ORDER BY n DESC, first_idx)::INTEGER AS place FROM g""")
def result_group_confidence(spark: SparkSession, path: str) -> DataFrame:
    return vote.confidence(votes(spark, path))


@query("""SELECT l_orderkey AS question_id, count(*)::BIGINT AS n_attempts, count(*) FILTER (l_returnflag <> 'A')::BIGINT AS n_fixed, max(lpad(l_linenumber::VARCHAR, 9, '0') || CASE l_returnflag WHEN 'R' THEN 'fixed' WHEN 'A' THEN 'will_retry' ELSE 'success' END)[10:] AS last_action FROM lineitem GROUP BY 1""")
def correction_log_summary(spark: SparkSession, path: str) -> DataFrame:
    action = F.when(F.col("l_returnflag") == "R", "fixed").when(F.col("l_returnflag") == "A", "will_retry").otherwise("success")
    return vote.correction_summary(t(spark, path, "lineitem").select(F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("attempt"), action.alias("action")))


@query("SELECT item_id AS question_id, s.* FROM benchmark, (VALUES ('wide_net', 'full', 'short', true, 0.0::DOUBLE, NULL::INTEGER), ('deep_focus', 'pruned', 'full', true, 0.0::DOUBLE, NULL::INTEGER), ('independent_thinker', 'pruned', 'long', false, 0.7::DOUBLE, 42)) AS s(strategy, schema_mode, profile_mode, use_fewshot, temperature, seed)")
def strategy_matrix(spark: SparkSession, path: str) -> DataFrame:
    return vote.strategy_matrix(t(spark, path, "benchmark").select(F.col("item_id").alias("question_id")))


@query("SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM orders ORDER BY status NULLS LAST, o_orderkey NULLS LAST LIMIT 50")
def rewrite_nulls_last(spark: SparkSession, path: str) -> DataFrame:
    cat.register(spark, path, ["orders"])
    return spark.sql(repair.nulls_last(spark, "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status FROM orders ORDER BY status, o_orderkey LIMIT 50"))


@query("SELECT max(o_totalprice) AS top FROM orders")
def rewrite_drop_scalar_sort(spark: SparkSession, path: str) -> DataFrame:
    cat.register(spark, path, ["orders"])
    return spark.sql(repair.drop_scalar_sort(spark, "SELECT MAX(o_totalprice) AS top FROM orders ORDER BY o_orderdate"))


@query("SELECT c_name, c_mktsegment, c_custkey FROM customer")
def rewrite_split_concat(spark: SparkSession, path: str) -> DataFrame:
    cat.register(spark, path, ["customer"])
    return spark.sql(repair.split_concat(spark, "SELECT c_name || ' - ' || c_mktsegment AS label, c_custkey FROM customer"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST LIMIT 1")
def rewrite_extreme_to_topk(spark: SparkSession, path: str) -> DataFrame:
    cat.register(spark, path, ["orders"])
    return spark.sql(repair.extreme_to_top(spark, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice = (SELECT MAX(o_totalprice) FROM orders)"))


def results(spark: SparkSession, path: str) -> DataFrame:
    """Answers: documents are questions, a label says whether gold ran, quality and toxicity who was right."""
    d = t(spark, path, "documents").join(t(spark, path, "labels"), "doc_id", "left")
    return d.select(F.col("doc_id").alias("question_id"), F.col("quality").isNotNull().alias("gold_ok"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("voted_correct"), F.coalesce((F.col("quality") == 1) | (F.col("toxic") == 0), F.lit(False)).alias("any_correct"))


_RESULTS_SQL = "r AS (SELECT quality IS NOT NULL AS g, coalesce(quality = 1, false) AS v, coalesce(quality = 1 OR toxic = 0, false) AS a FROM documents LEFT JOIN labels USING (doc_id)), c AS (SELECT {whole} AS n, count(*) FILTER (g AND v) AS nv, count(*) FILTER (g AND a) AS na FROM r)"
_ACCURACY_SQL = "SELECT n::BIGINT AS n_questions, nv::BIGINT AS n_voted, na::BIGINT AS n_any, round(100.0 * nv::DOUBLE / n, 2) AS voted_pct, round(100.0 * na::DOUBLE / n, 2) AS any_pct, round(100.0 * (na - nv)::DOUBLE / n, 2) AS gap_pct FROM c"


@query(f"WITH {_RESULTS_SQL.format(whole='count(*) FILTER (g)')} {_ACCURACY_SQL}")
def accuracy_summary(spark: SparkSession, path: str) -> DataFrame:
    return evaluate.accuracy(results(spark, path))


@query(f"WITH {_RESULTS_SQL.format(whole='count(*)')} {_ACCURACY_SQL}")
def accuracy_summary_total(spark: SparkSession, path: str) -> DataFrame:
    return evaluate.accuracy(results(spark, path), all_rows=True)


@query("SELECT 'method' AS kind, role AS value, count(*)::BIGINT AS n FROM conversations GROUP BY 2 UNION ALL SELECT 'winner', turn::VARCHAR, count(*)::BIGINT FROM conversations GROUP BY 2")
def vote_histogram(spark: SparkSession, path: str) -> DataFrame:
    return evaluate.histogram(t(spark, path, "conversations").select(F.col("role").alias("method"), F.col("turn").alias("winner")), "method", "winner")


@query("SELECT count(*)::BIGINT AS n_questions, sum(n)::BIGINT AS n_links, round(sum(n)::DOUBLE / count(*), 4) AS mean_links FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)")
def link_summary(spark: SparkSession, path: str) -> DataFrame:
    return evaluate.link_summary(t(spark, path, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("schema_links")))


@query("SELECT coalesce(lang, 'TOTAL') AS value, n FROM (SELECT lang, count(*)::BIGINT AS n FROM documents GROUP BY ROLLUP (lang))")
def count_by_group_with_total(spark: SparkSession, path: str) -> DataFrame:
    return evaluate.counts_with_total(t(spark, path, "documents"), "lang")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 10")
def questions_topn_per_group(spark: SparkSession, path: str) -> DataFrame:
    return files.first_per_group(t(spark, path, "documents").select("doc_id", "source"), "source", "doc_id", 10)


@query("SELECT doc_id AS question_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark: SparkSession, path: str) -> DataFrame:
    done = t(spark, path, "labels").withColumnRenamed("doc_id", "question_id")
    todo = t(spark, path, "documents").select(F.col("doc_id").alias("question_id"), "lang")
    return files.remaining(todo, done.filter("quality = 1"), done.filter("quality <> 1 or quality is null"))


@query("SELECT l_linenumber::BIGINT AS l_linenumber, count(*)::BIGINT AS n, sum(l_quantity)::BIGINT AS quantity, min(l_orderkey)::BIGINT AS first_order, count(DISTINCT l_linestatus)::BIGINT AS statuses FROM lineitem WHERE l_quantity > 30 AND l_returnflag IN ('R', 'A') GROUP BY 1")
def sqlite_scan(spark: SparkSession, path: str) -> DataFrame:
    """Lines written as SQLite files, a task each, and read back by ranges of rows with the filters in SQLite's statement."""
    folder = f"{sqlite.local(scratch(spark))}/sqlite-{uuid.uuid4().hex}"
    columns = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"]
    sqlite.write(t(spark, path, "lineitem").select(columns), folder, "lineitem")
    read = sqlite.table(spark, folder, "lineitem", columns).filter("l_quantity > 30 and l_returnflag in ('R', 'A')")
    return read.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"), F.min("l_orderkey").alias("first_order"), F.countDistinct("l_linestatus").alias("statuses"))
