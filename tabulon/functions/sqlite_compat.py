"""SQL text of the embedded-database dialect, rewritten token by token to functions that give its results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..plans import sql

#: Signature and body of each scalar function.
FUNCTIONS = {
    "julianday": ("t TIMESTAMP", "DOUBLE", "unix_micros(t) / 86400e6D + 2440587.5D"),
    "strftime": ("f STRING, t TIMESTAMP", "STRING", "date_format(t, replace(replace(replace(replace(replace(replace(f, '%Y', 'yyyy'), '%m', 'MM'), '%d', 'dd'), '%H', 'HH'), '%M', 'mm'), '%S', 'ss'))"),
    "json_extract": ("j STRING, p STRING", "STRING", "get_json_object(j, p)"),
    "glob": ("p STRING, x STRING", "BOOLEAN", "x rlike concat('^', replace(replace(regexp_replace(p, '([.+^$(){}|])', '\\\\\\\\$1'), '*', '.*'), '?', '.'), '$')"),
    "sqlite_div": ("a DOUBLE, b DOUBLE", "DOUBLE", "try_divide(a, b)"),
    "sqlite_mod": ("a BIGINT, b BIGINT", "BIGINT", "try_mod(a, b)"),
    "sqlite_sqrt": ("x DOUBLE", "DOUBLE", "if(x >= 0, sqrt(x), null)"),
    "sqlite_months": ("d DATE, n INT", "DATE", "date_add(add_months(trunc(d, 'MM'), n), day(d) - 1)"),
}
_TOKEN = re.compile(r"""\s+|--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|"(?:[^"]|"")*"|`(?:[^`]|``)*`|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\w+|<>|[<>!=]=|\|\||.""", re.S)
_MOVE = re.compile(r"'\s*([+-]?\d+)\s+(day|month|year)s?\s*'", re.I)
#: Words after which an operand, not an operator, stands.
_BEFORE = {"select", "where", "and", "or", "not", "on", "having", "by", "when", "then", "else", "case", "in", "like", "between", "distinct", "as", "from", "limit", "offset", "is"}


def register(spark: SparkSession) -> None:
    """Define the dialect's functions in the session."""
    for name, (args, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")


def run(spark: SparkSession, query: str) -> DataFrame:
    """A read-only query in the dialect, as a lazy frame."""
    register(spark)
    return sql.run(spark, rewrite(query))


def _blank(t: str) -> bool:
    return t.isspace() or t.startswith(("--", "/*"))


def _close(tokens: list[str], at: int) -> int:
    """Place of the parenthesis that closes the one at `at`."""
    depth = 0
    for i in range(at, len(tokens)):
        depth += (tokens[i] == "(") - (tokens[i] == ")")
        if not depth:
            return i
    raise ValueError("unbalanced parentheses")


def _arguments(tokens: list[str]) -> list[list[str]]:
    out, depth = [[]], 0
    for t in tokens:
        depth += (t == "(") - (t == ")")
        if t == "," and not depth:
            out.append([])
        else:
            out[-1].append(t)
    return [] if len(out) == 1 and all(map(_blank, out[0])) else out


def _moved(base: str, moves: list[str]) -> str | None:
    """A date after its modifiers; null text if one is unknown."""
    day = f"to_date({base})"
    for m in moves:
        step, m = _MOVE.fullmatch(m), m.lower()
        if step:
            n, unit = int(step[1]), step[2].lower()
            day = f"date_add({day}, {n})" if unit == "day" else f"sqlite_months({day}, {n * (12 if unit == 'year' else 1)})"
        elif m in ("'start of month'", "'start of year'"):
            day = f"trunc({day}, '{'MM' if 'month' in m else 'YEAR'}')"
        else:
            return None
    return f"date_format({day}, 'yyyy-MM-dd')"


def _call(name: str, args: list[list[str]]) -> str:
    a = [_text(x).strip() for x in args]
    f = name.lower()
    if f == "total" and len(a) == 1:
        return f"coalesce(cast(sum({a[0]}) as double), 0D)"
    if f == "group_concat" and a:
        return f"listagg({a[0]}, {a[1] if len(a) > 1 else repr(',')})"
    if f in ("max", "min") and len(a) > 1:
        null = " or ".join(f"({x}) is null" for x in a)
        return f"if({null}, null, {'greatest' if f == 'max' else 'least'}({', '.join(a)}))"
    if f == "round" and a:
        return f"cast(round(cast({a[0]} as double){''.join(f', {x}' for x in a[1:])}) as double)"
    if f == "sqrt" and len(a) == 1:
        return f"sqlite_sqrt({a[0]})"
    if f == "iif" and len(a) == 3:
        return f"if({', '.join(a)})"
    if f == "date" and a and (moved := _moved(a[0], a[1:])):
        return moved
    return f"{name}({', '.join(a)})"


def _operand(tokens: list[str], at: int) -> tuple[str, int]:
    """The operand that begins at `at`, rewritten, and the place behind it."""
    out, i = "", at
    while i < len(tokens) and (_blank(tokens[i]) or tokens[i] in "+-"):
        out, i = out + tokens[i], i + 1
    if i >= len(tokens):
        return out, i
    if tokens[i] == "(":
        end = _close(tokens, i)
        return f"{out}({_text(tokens[i + 1 : end])})", end + 1
    if tokens[i].lower() == "case":
        depth, j = 0, i
        while True:
            depth += (tokens[j].lower() == "case") - (tokens[j].lower() == "end")
            j += 1
            if not depth:
                return out + _text(tokens[i:j], whole=True), j
    j = i + 1
    while j + 1 < len(tokens) and tokens[j] == ".":
        j += 2
    if j < len(tokens) and tokens[j] == "(":
        end = _close(tokens, j)
        return out + _call("".join(tokens[i:j]), _arguments(tokens[j + 1 : end])), end + 1
    return out + "".join(_quoted(t) for t in tokens[i:j]), j


def _quoted(t: str) -> str:
    """A name in double quotes, in backticks."""
    return "`" + t[1:-1].replace('""', '"').replace("`", "``") + "`" if t.startswith('"') else t


def _text(tokens: list[str], whole: bool = False) -> str:
    out, i, last = [], 0, ""
    while i < len(tokens):
        t = tokens[i]
        if t in "/%" and last and last.lower() not in _BEFORE:
            right, i = _operand(tokens, i + 1)
            out.append(f"{t} nullif({right.strip()}, 0)")
            last = ")"
            continue
        if t.lower() == "like":
            out.append("ILIKE")
        elif re.fullmatch(r"\w+", t) and not t[0].isdigit() and i + 1 < len(tokens) and tokens[i + 1] == "(" and t.lower() not in _BEFORE and last != ".":
            end = _close(tokens, i + 1)
            out.append(_call(t, _arguments(tokens[i + 2 : end])))
            i, last = end + 1, ")"
            continue
        elif t == "(":
            end = _close(tokens, i)
            out.append(f"({_text(tokens[i + 1 : end])})")
            i, last = end + 1, ")"
            continue
        else:
            out.append(_quoted(t))
        if not _blank(t):
            last = t
        i += 1
    return "".join(out)


def rewrite(query: str) -> str:
    """The query with the dialect's meanings; text in quotes stays.

    x / 0 and x % 0 are null, LIKE ignores case, max and min of several arguments are null if one is, round gives a double, iif keeps its type,
    total is 0 of nothing, group_concat puts commas, date takes day, month and year steps (a day past the month's end runs on), sqrt of
    a negative number is null, names may stand in double quotes.
    """
    return _text(_TOKEN.findall(query))
