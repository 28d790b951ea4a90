"""Spark's own SQL parser over py4j. The only module that touches internals (classic sessions only)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession


@dataclass
class Node:
    """A plan or expression node: class name, place in the source text, parts."""

    kind: str
    start: int | None
    stop: int | None
    jvm: Any
    plans: list[Node] = field(default_factory=list)
    exprs: list[Node] = field(default_factory=list)
    is_plan: bool = False

    def walk(self) -> Iterator[Node]:
        """This node and all below it, through subqueries and named queries."""
        yield self
        for n in [*self.plans, *self.exprs]:
            yield from n.walk()

    def text(self, sql: str) -> str:
        return sql[self.start : self.stop + 1] if self.start is not None and self.stop is not None else ""


def _seq(x: Any) -> list[Any]:
    return [x.apply(i) for i in range(x.size())]


def _place(node: Any) -> tuple[int | None, int | None]:
    o = node.origin()
    a, b = o.startIndex(), o.stopIndex()
    return (a.get() if a.isDefined() else None, b.get() if b.isDefined() else None)


def _expr(e: Any) -> Node:
    kind = e.getClass().getSimpleName()
    n = Node(kind, *_place(e), e, exprs=[_expr(c) for c in _seq(e.children())])
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        n.plans.append(_plan(e.plan()))
    if kind == "InSubquery":
        n.exprs.append(_expr(e.query()))
    return n


def _plan(p: Any) -> Node:
    kind = p.getClass().getSimpleName()
    n = Node(kind, *_place(p), p, plans=[_plan(c) for c in _seq(p.children())], exprs=[_expr(e) for e in _seq(p.expressions())], is_plan=True)
    if kind == "UnresolvedWith":
        n.plans += [_plan(r._2()) for r in _seq(p.cteRelations())]
    return n


def parse(spark: SparkSession, sql: str) -> Node:
    """The parsed statement; raises ParseException as ``spark.sql`` would."""
    return _plan(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql))


#: Plan nodes that write, run programs or hold scripts without being commands of Spark's own kind.
_WRITES = {"InsertIntoStatement", "InsertIntoDir", "ScriptTransformation", "CompoundBody", "CompoundPlanStatement"}


def is_query(spark: SparkSession, sql: str) -> bool:
    """Whether the text is one statement that only reads: no node of its plan, subqueries and named queries
    included, is a command or writes. What expressions are called plays no part."""
    try:
        root = parse(spark, sql)
    except Exception:  # noqa: BLE001  whatever the parser refuses is no query
        return False
    command = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command", True, spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
    return not any(n.kind in _WRITES or (n.is_plan and command.isInstance(n.jvm)) for n in root.walk())


def name_parts(node: Node) -> list[str]:
    """Parts of an unresolved column or relation name."""
    x = node.jvm.nameParts() if node.kind == "UnresolvedAttribute" else node.jvm.multipartIdentifier()
    return _seq(x)
