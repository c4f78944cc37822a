"""Read-only SQL over the catalog: a guard on the parsed plan, limited results, tables and columns."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

LIMIT = 50
#: The parsed plan nodes that a query may have, table functions, and expressions that run code.
NODES = {
    "Aggregate", "CTERelationDef", "Deduplicate", "Distinct", "Except", "Filter", "Generate", "GlobalLimit", "Intersect", "Join", "LateralJoin",
    "LocalLimit", "LocalRelation", "Offset", "OneRowRelation", "Pivot", "Project", "Repartition", "RepartitionByExpression", "Sample", "Sort",
    "SubqueryAlias", "Union", "UnresolvedHaving", "UnresolvedHint", "UnresolvedInlineTable", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases",
    "UnresolvedTVFAliases", "UnresolvedTableValuedFunction", "UnresolvedWith", "Unpivot", "Values", "Window", "WithWindowDefinition",
}
TABLE_FUNCTIONS = {"explode", "explode_outer", "inline", "inline_outer", "json_tuple", "posexplode", "posexplode_outer", "range", "stack"}
DENIED_FUNCTIONS = {"reflect", "java_method", "try_reflect"}
DENIED_CLASSES = ("CallMethodViaReflection", "TryReflect", "UnresolvedIdentifier", "ScriptTransformation", "PythonUDTF")


class NotReadOnly(ValueError):
    """SQL text that is no single read-only query."""


def _nodes(plan):
    """All plan nodes below and with this one, those of CTEs and subqueries too."""
    stack = [plan]
    while stack:
        p = stack.pop()
        yield p
        for seq in (p.children(), p.innerChildren(), p.subqueries()):
            for i in range(seq.size()):
                child = seq.apply(i)
                if hasattr(child, "subqueries"):
                    stack.append(child)
        if p.nodeName() == "UnresolvedWith":
            ctes = p.cteRelations()
            for i in range(ctes.size()):
                cte = ctes.apply(i)
                stack.append(next(x for x in (cte.productElement(k) for k in range(cte.productArity())) if hasattr(x, "subqueries")))


def _expressions(plan):
    stack = [plan.expressions().apply(i) for i in range(plan.expressions().size())]
    while stack:
        e = stack.pop()
        yield e
        kids = e.children()
        stack += [kids.apply(i) for i in range(kids.size())]


def _class(x) -> str:
    return x.getClass().getName().rsplit(".", 1)[-1]


def check(spark: SparkSession, query: str) -> None:
    """Raise NotReadOnly unless the text parses as one query of known nodes, without code execution, names made by expressions, or file paths."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
    except Exception as e:
        raise NotReadOnly(f"not one SQL query: {str(e).splitlines()[0]}") from None
    for node in _nodes(plan):
        kind = _class(node)
        if kind not in NODES:
            raise NotReadOnly(f"only queries are allowed, not {kind}")
        if kind == "UnresolvedRelation":
            parts = [node.multipartIdentifier().apply(i) for i in range(node.multipartIdentifier().size())]
            if len(parts) > 1 and not spark.catalog.databaseExists(parts[0]) and parts[0] not in ("system",):
                raise NotReadOnly(f"files cannot be read by path: {parts[0]}")
        if kind == "UnresolvedTableValuedFunction" and node.name().apply(node.name().size() - 1).lower() not in TABLE_FUNCTIONS:
            raise NotReadOnly("this table function is not allowed")
        for e in _expressions(node):
            name = _class(e)
            if any(d in name for d in DENIED_CLASSES):
                raise NotReadOnly(f"{name} is not allowed")
            if name == "UnresolvedFunction":
                names = e.nameParts()
                if names.apply(names.size() - 1).lower() in DENIED_FUNCTIONS:
                    raise NotReadOnly("functions that run code are not allowed")


def is_read_only(spark: SparkSession, query: str) -> bool:
    try:
        check(spark, query)
    except NotReadOnly:
        return False
    return True


def starts_with_select(query: str) -> bool:
    """The weaker rule by prefix."""
    return query.strip().lower().startswith("select")


def run(spark: SparkSession, query: str, args: dict | list | None = None) -> DataFrame:
    """A checked query as a lazy frame."""
    check(spark, query)
    df = spark.sql(query, args) if args else spark.sql(query)
    for node in _nodes(df._jdf.queryExecution().analyzed()):  # whatever a name stands for; nothing has run yet
        if any(d in _class(x) for x in (node, *_expressions(node)) for d in DENIED_CLASSES):
            raise NotReadOnly("functions that run code are not allowed")
    return df


def execute(spark: SparkSession, query: str, limit: int = LIMIT) -> dict:
    """success, row_count (of all), columns, data (at most `limit` rows as dicts)."""
    df = run(spark, query)
    return {"success": True, "row_count": df.count(), "columns": df.columns, "data": [r.asDict(recursive=True) for r in df.limit(limit).collect()]}


def list_tables(spark: SparkSession) -> list[str]:
    """Names of tables and views; LookupError if there is none."""
    names = [t.name for t in spark.catalog.listTables()]
    if not names:
        raise LookupError("no tables")
    return names


def describe(spark: SparkSession, name: str) -> list[dict]:
    """name, type, nullable of each column; LookupError for an unknown table."""
    if not spark.catalog.tableExists(name):
        raise LookupError(f"no table {name}")
    return [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in spark.table(name).schema]


def safe_name(text: str) -> str:
    """A table name of letters, digits and underscores."""
    name = re.sub(r"\W+", "_", text, flags=re.ASCII).strip("_").lower()
    return name if name and not name[0].isdigit() else f"t_{name}"
