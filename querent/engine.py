"""The whole way from tables to answers: profile, index, link, generate, choose, score.

Tables of columns, values, literals and links are DataFrames from end to end; only the turns with a
text generator, a handful for each question, run on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.functions import render, text
from querent.operators import backend as generators
from querent.operators import correct, link, lookup, profile, vector, vote
from querent.operators.backend import Backend
from querent.plans import lineage, repair
from querent.plans.execute import digest, run
from querent.session import ship
from querent.sources import files
from querent.sources.catalog import quote

KEYS = ["table", "column"]
Q = "question_id"
RESULTS, ERRORS = "question_id long, sql string, method string, agreement int", "question_id long, error string"


@dataclass
class Answer:
    question_id: int
    sql: str
    method: str
    agreement: int
    candidates: list[correct.Corrected] = field(default_factory=list)


class Database:
    """Tables by name, their catalog, and what is derived from them; derived tables are kept by path."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], catalog: DataFrame, db_id: str = "main"):
        self.spark, self.tables, self.catalog, self.db_id = spark, tables, catalog, db_id
        for name, df in tables.items():
            df.createOrReplaceTempView(quote(name))

    def schema(self) -> dict[str, list[str]]:
        return {t: df.columns for t, df in sorted(self.tables.items())}

    # Profiles

    def long_profiles(self, keys: dict[str, str] | None = None) -> DataFrame:
        """Profiles of all columns, with their text; tables with an order key also have samples and shape."""
        made = [profile.long_profile(df, (keys or {}).get(t)).withColumn("table", F.lit(t)) for t, df in sorted(self.tables.items())]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), made)
        return render.profile_text(rows.join(self.catalog.select("db_id", *KEYS, "type", "is_pk"), KEYS))

    def full_profiles(self, long: DataFrame, docs: DataFrame) -> DataFrame:
        """Profiles with the documentation of their columns."""
        joined = long.join(docs, KEYS, "left")
        return joined.withColumn("full_text", render.full_profile(F.col("profile_text"), F.col("column_description"), F.col("data_format"), F.col("value_description")))

    def prompts(self, profiles: DataFrame, column: str, ask: str) -> DataFrame:
        """``db_id, table, column, system, user``: what a generator is asked about each column."""
        user = F.concat(F.lit(f"{ask}\n\n"), text.shortened(F.col(column)))
        return profiles.select("db_id", *KEYS, F.lit("You describe columns of databases.").alias("system"), user.alias("user"))

    def describe(self, profiles: DataFrame, done: DataFrame, kind: str, **settings: object) -> DataFrame:
        """Generated one-sentence descriptions of columns that have none yet."""
        made = generators.generate(self.prompts(profiles, "full_text", "Describe the column in one sentence."), done, kind, ["db_id", *KEYS], **settings)
        return made.withColumn("short_profile", text.one_sentence(text.final_answer(F.col("text"))))

    # Indexes

    def values(self, limit: int = 10_000) -> DataFrame:
        """``table, column, value``: distinct values of all columns, a bounded number each."""
        made = [profile.distinct_values(df, limit).withColumn("table", F.lit(t)) for t, df in sorted(self.tables.items())]
        return reduce(DataFrame.unionByName, made).select(*KEYS, "value")

    def build_indexes(self, profiles: DataFrame, path: str, limit: int = 10_000, overwrite: bool = False) -> None:
        """Vectors of profile texts, exact variants, shingles and bands, as Parquet under a path; existing ones stay."""
        ship(self.spark)
        values = self.values(limit)
        tables = {"vectors": profiles.select("db_id", *KEYS, "type", "is_pk", "profile_text", vector.hashed(F.col("profile_text")).alias("vector")), "variants": lookup.variant_index(values), "bands": lookup.column_bands(values), "shingles": lookup.shingle_index(values), "values": values}
        for name, df in tables.items():
            if overwrite or not files.exists(self.spark, f"{path}/{name}"):
                df.write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def has_indexes(spark: SparkSession, path: str) -> bool:
        return all(files.exists(spark, f"{path}/{n}") for n in ("vectors", "variants", "bands", "shingles", "values"))

    # Linking

    def link(self, questions: DataFrame, path: str, k: int = 10) -> DataFrame:
        """``question_id, table, column`` that questions need: near profiles, held literals, keys."""
        ship(self.spark)
        read = lambda n: self.spark.read.parquet(f"{path}/{n}")
        vectors = read("vectors").withColumn("row_id", F.concat_ws(".", *KEYS))
        asked = questions.select(F.col(Q).alias("query_id"), vector.hashed(F.col("question")).alias("vector"))
        near = vector.top_k(asked, vectors.select("row_id", "vector"), k).join(vectors.select("row_id", *KEYS), "row_id").select(F.col("query_id").alias(Q), *KEYS)
        said = questions.select(Q, F.explode(text.extract_literals(F.col("question"))).alias("literal"))
        exact = lookup.exact_matches(said, read("variants")).select("literal", *KEYS)
        approximate = lookup.contained(said.join(exact, "literal", "left_anti"), read("shingles")).select("literal", *KEYS)
        held = said.join(lookup.exact_else(exact, approximate), "literal").select(Q, *KEYS)
        return link.focus(near, held, self.catalog)

    # Answers

    def schema_prompt(self, columns: DataFrame, question: str, evidence: str = "", examples: str = "", comment: str | None = None) -> str:
        """The prompt over some columns of the catalog (``table, ordinal, column, type``)."""
        shown = render.schema_text(columns, comment=comment).select(render.prompt(F.lit(question), F.col("schema_text"), F.lit(evidence), F.lit(examples)).alias("p")).first()
        return shown.p if shown else ""

    def missing(self, variants: DataFrame):
        """A function that names the columns which hold a statement's literals and that it doesn't use."""

        def names(sql: str) -> list[str]:
            used = sorted(lineage.columns(self.spark, sql, self.schema()))
            one = self.spark.createDataFrame([(1, sql)], "query_id int, sql string")
            asked = one.select("query_id", F.explode(text.sql_literals(F.col("sql"))).alias("literal"))
            seen = self.spark.createDataFrame([(1, *u) for u in used], "query_id int, table string, column string")
            return [f"{r.table}.{r.column}" for r in lookup.missing_columns(asked, variants, seen).select(*KEYS).distinct().collect()]

        return names

    def commented(self, profiles: DataFrame, mode: str) -> DataFrame:
        """The catalog with the comment that a profile mode puts behind each column (``short_profile,
        profile_text, full_text`` of profiles; columns without one get none)."""
        texts = [F.col(c) if c in profiles.columns else F.lit(None).cast("string") for c in ("short_profile", "profile_text", "full_text")]
        return self.catalog.join(profiles.select(*KEYS, render.column_comment(mode, *texts).alias("comment")), KEYS, "left")

    def generated_links(self, question_id: int, question: str, focused: DataFrame, backend: Backend, profiles: DataFrame, variants: DataFrame, evidence: str = "", examples: str = "") -> tuple[DataFrame, dict[str, str]]:
        """Columns that candidates of all five prompts refer to, and each prompt's chosen statement.

        Every prompt has three candidates, two of them with shuffled columns; each is repaired and
        asked again while columns that hold its literals are missing."""
        lacking, links, chosen = self.missing(variants), set(), {}
        for name, tables, columns, mode in link.COMBOS:
            part = link.shown(self.commented(profiles, mode), focused, tables, columns)
            made = []
            for temperature, seed in link.CANDIDATES:
                place = link.shuffled(self.catalog, seed).withColumnRenamed("place", "ordinal") if seed is not None else None
                ordered = part if place is None else part.drop("ordinal").join(place, KEYS)
                prompt = self.schema_prompt(ordered, question, evidence, examples, comment="comment")
                sql = correct.generate_sql(self.spark, backend, prompt, repair=repair.repair, temperature=temperature, seed=seed)
                if sql:
                    sql = correct.literal_corrected(self.spark, backend, prompt, sql, lacking)
                    links |= lineage.columns(self.spark, sql, self.schema())
                made.append(correct.Corrected(sql, outcome=run(self.spark, sql)))
            chosen[name] = self.choose(question_id, question, made).sql
        return self.spark.createDataFrame([(question_id, *x) for x in sorted(links)], "question_id long, table string, column string"), chosen

    def answer(self, question_id: int, question: str, linked: DataFrame, backend: Backend, evidence: str = "", examples: str = "", retries: int = 3, profiles: DataFrame | None = None) -> Answer:
        """Three candidates by three strategies, each corrected, then a vote; ties ask the generator.

        With profiles, each strategy puts its own kind of profile behind the columns that it shows."""
        made: list[correct.Corrected] = []
        for name, shown, mode, few, temperature, seed in vote.STRATEGIES:
            noted = self.catalog if profiles is None else self.commented(profiles, mode)
            columns = noted if shown == "full" else link.pruned(noted, linked)
            prompt = self.schema_prompt(columns, question, evidence, examples if few else "", comment=None if profiles is None else "comment")
            hint = next((c.sql for c in made if c.outcome and c.outcome.ok), "")
            made.append(correct.corrected(self.spark, backend, prompt, retries, hint, temperature=temperature, seed=seed, strategy=name))
        return self.choose(question_id, question, made, backend)

    def choose(self, question_id: int, question: str, made: list[correct.Corrected], backend: Backend | None = None) -> Answer:
        """Majority of equal results; without one a generator picks a letter; else the first that ran."""
        rows = []
        for i, c in enumerate(made):
            ok = bool(c.outcome and c.outcome.ok)
            rows.append((question_id, i, c.sql, ok, str(tuple(digest(c.outcome.rows).first())) if ok else None))
        votes = self.spark.createDataFrame(rows, "question_id long, idx int, sql string, ok boolean, result string")
        best = vote.ladder(votes).first()
        winner, method = best.winner_idx, best.method
        valid = [i for i, r in enumerate(rows) if r[3]]
        if method == "first_valid" and backend is not None and len(valid) > 1:
            letters = "ABCDEFGH"[: len(valid)]
            shown = "\n\n".join(f"{x}:\n{made[i].sql}" for x, i in zip(letters, valid, strict=False))
            said = backend.generate([{"role": "user", "content": f"{question}\n\nWhich query answers it? Give a letter.\n\n{shown}"}])
            pick = next((i for x, i in zip(letters, valid, strict=False) if x in said.strip().upper()[:10]), None)
            winner, method = (pick, "tiebreak") if pick is not None else (winner, method)
        for c in made:
            if c.outcome and c.outcome.rows is not None:
                c.outcome.rows.unpersist()
        return Answer(question_id, made[winner].sql if winner is not None else "", method, int(best.agreement), made)

    def answer_all(self, questions: DataFrame, links: DataFrame, backend: Backend, out: str, retries: int = 3, profiles: DataFrame | None = None, flush: int = 1) -> None:
        """Answers of all questions that ``out`` has neither a result nor an error of, committed ``flush`` at a time.

        Questions may bring ``evidence`` and ``examples``; both go into their prompts. After a crash the questions
        of the batch that was open are asked again, and no other; ``files.committed`` reads what counts."""
        kinds = {"results": RESULTS, "errors": ERRORS}
        done = [files.committed(self.spark, out, n, k) for n, k in kinds.items()]
        made: dict[str, list] = {n: [] for n in kinds}

        def save() -> None:
            files.commit_results(*(self.spark.createDataFrame(made[n], k) for n, k in kinds.items()), out)
            for rows in made.values():
                rows.clear()

        for q in files.remaining(questions, *done).orderBy(Q).toLocalIterator():
            said = q.asDict()
            try:
                a = self.answer(q[Q], q["question"], links.filter(F.col(Q) == q[Q]), backend, *(said.get(c) or "" for c in ("evidence", "examples")), retries=retries, profiles=profiles)
                made["results"].append((a.question_id, a.sql, a.method, a.agreement))
            except Exception as e:  # noqa: BLE001  one question's failure is recorded, the others go on
                made["errors"].append((q[Q], str(e)))
            if sum(map(len, made.values())) >= flush:
                save()
        if any(made.values()):
            save()

    def score(self, answers: list[Answer], gold: dict[int, str]) -> DataFrame:
        """``question_id, gold_ok, voted_correct, any_correct`` for the accuracy aggregates."""
        rows = []

        def result(sql: str) -> tuple | None:
            done = run(self.spark, sql)
            if not done.ok:
                return None
            try:
                return tuple(digest(done.rows).first())
            finally:
                done.rows.unpersist()

        for a in answers:
            truth = result(gold.get(a.question_id, ""))
            # each statement runs once; without a truth none has to
            found = {sql: result(sql) for sql in dict.fromkeys([a.sql, *(c.sql for c in a.candidates)])} if truth else {}
            right = {sql for sql, r in found.items() if r == truth}
            rows.append((a.question_id, truth is not None, a.sql in right, bool(right)))
        return self.spark.createDataFrame(rows, "question_id long, gold_ok boolean, voted_correct boolean, any_correct boolean")

    def schema_links(self, statements: DataFrame) -> DataFrame:
        """``question_id, table, column``: union of the columns that candidates (``question_id, sql``) refer to."""
        rows = [(r[Q], *c) for r in statements.toLocalIterator() for c in sorted(lineage.columns(self.spark, repair.repair(self.spark, r.sql), self.schema()))]
        return link.union_links(self.spark.createDataFrame(rows, "question_id long, table string, column string"))
