"""Intents to DataFrames with chart specifications, and the event stream of an answer."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..operators import stats
from .intent import Frame, Intent, IntentError, compile_question

PREVIEW = 20


@dataclass(frozen=True)
class Result:
    """tables: name to lazy DataFrame; chart: what to draw from them (kind, table, x, y)."""

    intent: Intent
    tables: dict[str, DataFrame]
    chart: dict | None = None


def _check(df: DataFrame, names: tuple[str, ...], numeric: bool = True) -> None:
    for n in names:
        if n not in df.columns:
            raise IntentError(f"column not found: {n}")
        if numeric and not isinstance(df.schema[n].dataType, T.NumericType):
            raise IntentError(f"column is not numeric: {n}")


def _describe(df: DataFrame) -> DataFrame:
    if stats.numeric_columns(df):
        return stats.describe_numeric(df)
    return stats.describe_categorical(df, df.columns)


def run(intent: Intent, df: DataFrame, order: list[str] | None = None, plain_groups: bool = False) -> Result:
    """Plan an intent. order: the columns that order rows for a trend. plain_groups: text columns may be grouped by value."""
    kind, cols = intent.kind, intent.columns
    if kind == "summary":
        _check(df, cols)
        return Result(intent, {"summary": stats.column_summary(df, *cols)})
    if kind == "describe":
        return Result(intent, {"describe": _describe(df)})
    if kind == "histogram":
        _check(df, cols)
        return Result(intent, {"histogram": stats.histogram(df, cols[0], intent.bins)}, {"kind": "bar", "table": "histogram", "x": "lo", "y": "n"})
    if kind == "corr_matrix":
        return Result(intent, {"corr": stats.corr_matrix(df, [*cols])}, {"kind": "heatmap", "table": "corr", "x": "x", "y": "y", "value": "corr"})
    if kind == "scatter":
        _check(df, cols)
        return Result(intent, {"pairs": stats.scatter_pairs(df, *cols)}, {"kind": "scatter", "table": "pairs", "x": "x", "y": "y"})
    if kind == "grouped":
        _check(df, cols[:1])
        _check(df, cols[1:], numeric=not plain_groups)
        if plain_groups and not isinstance(df.schema[cols[1]].dataType, T.NumericType):
            from pyspark.sql import functions as F

            means = df.groupBy(stats.q(cols[1]).alias("group")).agg(F.count("*").alias("n"), F.avg(stats.number(cols[0])).alias("mean"))
            return Result(intent, {"grouped": means}, {"kind": "bar", "table": "grouped", "x": "group", "y": "mean"})
        return Result(intent, {"grouped": stats.grouped_bin_mean(df, *cols, bins=intent.bins)}, {"kind": "bar", "table": "grouped", "x": "bin", "y": "mean"})
    if kind == "trend":
        _check(df, cols)
        return Result(intent, {"trend": stats.trend(df, cols[0], order or [df.columns[0]])}, {"kind": "line", "table": "trend", "x": "index", "y": "value"})
    if kind == "profile":
        return Result(intent, {"shape": stats.shape(df), "profile": stats.profile(df), "describe": _describe(df), "nulls": stats.null_counts(df)})
    raise IntentError(f"unknown kind of analysis: {kind}")


def explain(intent: Intent) -> str:
    what = {"summary": "Mean, minimum, maximum and median of {0}.", "describe": "Statistics of every column.", "histogram": "How the values of {0} are spread over equal bins.", "corr_matrix": "How every pair of numeric columns moves together.", "scatter": "{0} against {1}.", "grouped": "The mean of {0} in ranges of {1}.", "trend": "{0} in order of the rows.", "profile": "Size, types, statistics and gaps of the data."}
    return what[intent.kind].format(*intent.columns)


def events(question: str, df: DataFrame, planner: Callable[[str, Frame], Intent] | None = None, **how) -> Iterator[dict]:
    """What a client is sent: status, code, status, output, chart if any, explanation, analysis_complete; error instead where it fails.

    planner: an optional model that makes the intent; if it fails, the rules do.
    """
    yield {"type": "status", "content": "Planning the analysis"}
    try:
        intent = None
        if planner:
            try:
                intent = planner(question, Frame.of(df))
            except Exception:
                yield {"type": "status", "content": "The planner failed; using rules"}
        intent = intent or compile_question(question, df)
        yield {"type": "code", "content": f"{intent.kind}({', '.join(intent.columns)})"}
        yield {"type": "status", "content": "Running the analysis"}
        result = run(intent, df, **how)
        rows = {name: [r.asDict(recursive=True) for r in t.limit(PREVIEW).collect()] for name, t in result.tables.items()}
        yield {"type": "output", "content": rows}
        if result.chart:
            yield {"type": "chart", "content": result.chart}
        yield {"type": "explanation", "content": explain(intent)}
        yield {"type": "analysis_complete", "done": True}
    except Exception as e:
        yield {"type": "error", "message": str(e), "done": True}
