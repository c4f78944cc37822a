"""Scalar expressions, all built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.intent import PAIR

#: The fence that opens code in a reply, and the words that mark a failed one.
FENCE, FAILED = "```python", ("Error", "TIMEOUT")


def truncate_utf8(x: Column, size: int = 72) -> Column:
    """The longest prefix of whole characters of `size` bytes at most.

    Cutting at `size` bytes splits one character at most; its leftover bytes (continuations, and a lead byte
    that wants more) are dropped by testing the last four prefixes for whether they are whole.
    """
    cut = F.substring(F.encode(x, "UTF-8"), 1, size)
    fits = [F.substring(cut, F.lit(1), F.length(cut) - i) for i in range(4)]
    valid = F.coalesce(*[F.when(F.is_valid_utf8(f.cast("string")), f.cast("string")) for f in fits])
    return F.when(F.octet_length(x) <= size, x).otherwise(valid)


def safe_string(x: Column, default: str = "") -> Column:
    return F.coalesce(x.cast("string"), F.lit(default))


def joined_truthy(items: Column, default: str = "") -> Column:
    """Non-empty items of a string array with blanks between; null gives the default."""
    return F.coalesce(F.array_join(F.filter(items, lambda i: i.isNotNull() & (i != "")), " "), F.lit(default))


def mask(x: Column) -> Column:
    """The first ten and last four characters."""
    return F.concat(F.substring(x, 1, 10), F.lit("..."), F.right(x, F.lit(4)))


def extension(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def is_csv(name: Column) -> Column:
    return F.coalesce(F.lower(name).endswith(".csv"), F.lit(False))


def fenced_code(reply: Column) -> Column:
    """Text of the first python fence to the next fence, or the whole reply; trimmed."""
    at = F.instr(reply, FENCE)
    rest = F.substring(reply, at + len(FENCE), F.length(reply))
    return F.trim(F.when(at > 0, F.substring_index(rest, "```", 1)).otherwise(reply), F.lit(" \n\r\t"))


def is_failure(reply: Column) -> Column:
    return reply.contains(FAILED[0]) | reply.contains(FAILED[1])


def first_pair(question: Column) -> tuple[Column, Column]:
    """The words on either side of vs, against or and."""
    part = lambda i: F.nullif(F.regexp_extract(F.lower(question), PAIR, i), F.lit(""))
    return part(1), part(2)


def last_after_by(question: Column) -> Column:
    return F.element_at(F.split(F.lower(question), "by"), -1)


def normalise_markdown(x: Column) -> Column:
    """Bullets as dashes, numbers with a blank, at most one empty line in a row, no blanks at line ends."""
    for pattern, to in ((r"(?m)^[ \t]*[•*][ \t]+", "- "), (r"(?m)^(\d+)\)[ \t]*", "$1. "), (r"(?m)[ \t]+$", ""), (r"\n{3,}", "\n\n")):
        x = F.regexp_replace(x, pattern, to)
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def linkify(x: Column) -> Column:
    return F.regexp_replace(x, r"(https?://[^\s<>\"]+)", r'<a href="$1" target="_blank">$1</a>')


def title_of(content: Column, size: int = 20) -> Column:
    return F.substring(content, 1, size)


def seconds_left(end: Column, now: Column) -> Column:
    return F.greatest(F.lit(0), F.unix_timestamp(end) - F.unix_timestamp(now))


def backoff(attempt: Column) -> Column:
    return F.pow(F.lit(2.0), attempt)


def price_text(x: Column) -> Column:
    """Two decimals, no thousands separators."""
    return F.format_string("%.2f", x.cast("double"))
