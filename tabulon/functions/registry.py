"""Typed user functions by name: Arrow-batched functions in place of free-form code."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_registered: dict[str, tuple[Callable, str]] = {}


def vectorised(name: str, returns: str):
    """Register a function from series to series under a name, for every session that install() is called on."""

    def add(f: Callable[..., pd.Series]) -> Callable[..., pd.Series]:
        _registered[name] = (f, returns)
        return f

    return add


def install(spark: SparkSession) -> list[str]:
    """Make all registered functions callable in SQL; returns their names."""
    for name, (f, returns) in _registered.items():
        spark.udf.register(name, F.pandas_udf(f, returns))
    return sorted(_registered)


@vectorised("title_case", "string")
def title_case(x: pd.Series) -> pd.Series:
    return x.str.title()
