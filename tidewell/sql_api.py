"""A guarded SELECT: one statement, only allowed tables, a row limit and a time limit; and conditions built from parts."""

from __future__ import annotations

import re
import threading
from collections.abc import Iterator

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

DEFAULT_ROWS, MOST_ROWS = 1_000, 10_000
#: Nodes of a parsed plan that only read and reshape tables.
READING = frozenset(
    "Project Filter Aggregate Join Sort GlobalLimit LocalLimit Offset SubqueryAlias UnresolvedSubqueryColumnAliases Distinct Deduplicate Union Intersect Except UnresolvedWith UnresolvedRelation "
    "OneRowRelation UnresolvedHaving WithWindowDefinition Window Generate LateralJoin Sample Expand UnresolvedOrdinal Pivot Unpivot SetOperation Subquery NamedParametersSupport NameParameterizedQuery".split()
)
#: Functions that reach outside the tables.
FORBIDDEN = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length current_user user session_user".split())
_views = threading.Lock()


class Refused(ValueError):
    """The statement isn't a query, or reads what it may not."""


def _each(sequence: JavaObject) -> Iterator[JavaObject]:
    items = sequence.iterator()
    while items.hasNext():
        yield items.next()


def _read(node: JavaObject, own: frozenset[str]) -> set[str]:
    """Names of the tables that a plan's node and all below it read; own holds the common table expressions in scope."""
    kind = node.getClass().getSimpleName()
    if kind not in READING:
        raise Refused(f"only queries over tables are allowed, not {kind}")
    if kind == "UnresolvedRelation":
        name = node.multipartIdentifier().mkString(".").lower()
        return set() if name in own else {name}
    found: set[str] = set()
    if kind == "UnresolvedWith":
        for pair in _each(node.cteRelations()):
            found |= _read(pair._2(), own)
            own = own | {pair._1().lower()}
        return found | _read(node.child(), own)
    for child in _each(node.children()):
        found |= _read(child, own)
    for expression in _each(node.expressions()):
        found |= _read_in(expression, own)
    return found


def _read_in(expression: JavaObject, own: frozenset[str]) -> set[str]:
    found: set[str] = set()
    kind = expression.getClass().getSimpleName()
    if kind == "UnresolvedFunction" and expression.nameParts().mkString(".").lower() in FORBIDDEN:
        raise Refused("this function isn't allowed")
    if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
        found |= _read(expression.plan(), own)
    for child in _each(expression.children()):
        found |= _read_in(child, own)
    return found


def relations(spark: SparkSession, sql: str) -> set[str]:
    """The tables a statement reads, from the nodes of its parsed plan: through joins, subqueries and common table expressions, which count only where they are in scope."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise Refused(f"can't be parsed: {str(e).splitlines()[0]}") from e
    return _read(plan, frozenset())


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame], *, rows: int = DEFAULT_ROWS, args: dict | None = None) -> DataFrame:
    """The statement's result over tables alone, at most rows (1 to MOST_ROWS) rows; named parameters are bound, not pasted.

    The tables' names are views only while the statement is analysed; views of the session by these names are as before afterwards.
    """
    if not re.match(r"(?is)^\s*(?:select|with)\b", sql):
        raise Refused("only SELECT is allowed")
    unknown = relations(spark, sql) - {t.lower() for t in tables}
    if unknown:
        raise Refused(f"not allowed: {', '.join(sorted(unknown))}")
    with _views:
        temporary = {t.name for t in spark.catalog.listTables() if t.isTemporary}
        held = {n: spark.table(n) for n in tables if n.lower() in {t.lower() for t in temporary}}
        try:
            for name, df in tables.items():
                df.createOrReplaceTempView(name)
            return spark.sql(sql, args=args or {}).limit(max(1, min(rows, MOST_ROWS)))
        finally:
            for name in tables:
                spark.catalog.dropTempView(name)
            for name, df in held.items():
                df.createOrReplaceTempView(name)


def conditions(
    *, equal: dict | None = None, among: dict | None = None, at_least: dict | None = None, at_most: dict | None = None, contains: dict | None = None, allowed: set[str]
) -> tuple[str, dict]:
    """A condition and its bound parameters from parts whose columns must be allowed; parts that are None or empty say nothing.

    contains looks for a text in any case. A part without a value for a column (None) is left out, as an unset filter is.
    """
    terms, args = [], {}

    def bind(value: object) -> str:
        args[f"p{len(args)}"] = value
        return f":p{len(args) - 1}"

    for operator, part in (("=", equal), (">=", at_least), ("<=", at_most)):
        for column, value in (part or {}).items():
            if value is not None:
                terms.append(f"{_known(column, allowed)} {operator} {bind(value)}")
    for column, values in (among or {}).items():
        if values is not None:
            terms.append(f"{_known(column, allowed)} in ({', '.join(bind(v) for v in values)})" if values else "false")
    for column, value in (contains or {}).items():
        if value:
            terms.append(f"contains(lower({_known(column, allowed)}), lower({bind(value)}))")
    return " and ".join(terms) or "true", args


def ordering(wanted: str, allowed: set[str], default: str) -> str:
    """An order-by column, with an optional asc or desc; anything that isn't on the list becomes the default."""
    column, _, direction = wanted.strip().partition(" ")
    if column not in allowed or direction.strip().lower() not in ("", "asc", "desc"):
        return default
    return f"`{column}` {direction.strip().lower() or 'asc'}"


def _known(column: str, allowed: set[str]) -> str:
    if column not in allowed:
        raise Refused(f"unknown column {column}")
    return f"`{column}`"


def collect_within(df: DataFrame, seconds: float) -> list:
    """df's rows, or TimeoutError after cancelling its jobs. df must be limited."""
    context, tag = df.sparkSession.sparkContext, f"tidewell-{id(df)}"
    timer = threading.Timer(seconds, lambda: context.cancelJobsWithTag(tag))
    context.addJobTag(tag)
    timer.start()
    try:
        return df.collect()
    except Exception as e:
        if "cancel" in str(e).lower():
            raise TimeoutError(f"took more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
