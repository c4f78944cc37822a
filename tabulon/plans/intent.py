"""Questions in plain words to analysis plans: a table of rules, tried in order."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Substrings of the lower-cased question that choose a kind of analysis.
SUMMARY = ("average", "mean", "minimum", "maximum", "max", "min", "median", "summary", "describe")
DISTRIBUTION = ("distribution", "histogram", "frequency", "spread")
RELATION = ("correlation", "relationship", "compare", "association")
MATRIX = ("heatmap", "matrix")
GROUPED = ("by", "group", "range")
TREND = ("trend", "over time", "year", "month", "timeline", "progression")
PAIR = r"([a-z_]+)\s*(?:vs|against|and)\s*([a-z_]+)"
DEFAULT_TARGET = "median_income"


class IntentError(ValueError):
    """A question that no plan of this frame can answer."""


@dataclass(frozen=True)
class Intent:
    """kind: summary, describe, histogram, corr_matrix, scatter, grouped, trend, profile."""

    kind: str
    columns: tuple[str, ...] = ()
    bins: int = 0
    order: tuple[str, ...] = field(default=())


@dataclass(frozen=True)
class Frame:
    names: tuple[str, ...]
    numeric: tuple[str, ...]

    @classmethod
    def of(cls, df: DataFrame) -> Frame:
        return cls(tuple(df.columns), tuple(f.name for f in df.schema if isinstance(f.dataType, T.NumericType)))

    def named_in(self, text: str, names: tuple[str, ...] | None = None) -> str | None:
        """The first column, in schema order, whose name the text holds."""
        return next((c for c in (self.numeric if names is None else names) if c.lower() in text), None)

    def nth(self, i: int) -> str:
        if i >= len(self.numeric):
            raise IntentError("the frame has too few numeric columns")
        return self.numeric[i]


def _summary(text: str, f: Frame) -> Intent:
    named = f.named_in(text)
    return Intent("summary", (named,)) if named else Intent("describe")


def _distribution(text: str, f: Frame) -> Intent:
    default = f.nth(0)
    return Intent("histogram", (f.named_in(text) or default,), bins=20)


def _relation(text: str, f: Frame) -> Intent | None:
    if any(w in text for w in MATRIX):
        return Intent("corr_matrix", f.numeric)
    pair = re.search(PAIR, text)
    if not pair:
        return None
    holds = lambda word, i: next((c for c in f.names if word in c.lower()), None) or f.nth(i)
    f.nth(0), f.nth(1)
    return Intent("scatter", (holds(pair[1], 0), holds(pair[2], 1)))


def _grouped(text: str, f: Frame) -> Intent:
    target = next((c for c in f.numeric if c.lower() in text and "by" not in c.lower()), DEFAULT_TARGET)
    after = text.rpartition("by")[2] if "by" in text else ""
    group = f.named_in(after, f.names) if after else None
    return Intent("grouped", (target, group or (f.numeric[1] if len(f.numeric) > 1 else f.names[0])), bins=5)


def _trend(text: str, f: Frame) -> Intent:
    default = f.nth(0)
    return Intent("trend", (f.named_in(text) or default,))


RULES = ((SUMMARY, _summary), (DISTRIBUTION, _distribution), (RELATION, _relation), (GROUPED, _grouped), (TREND, _trend))


def compile_question(question: str, frame: Frame | DataFrame) -> Intent:
    """The intent of the first rule with a trigger in the question that yields one; a profile otherwise.

    A relation without two words to relate falls through to the rules after it. Triggers match inside words.
    """
    f = frame if isinstance(frame, Frame) else Frame.of(frame)
    text = question.lower()
    for words, make in RULES:
        if any(w in text for w in words) and (intent := make(text, f)):
            return intent
    return Intent("profile")
