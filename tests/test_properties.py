"""Number grammar and bins against Python and numpy over generated values."""

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabulon.operators import stats
from tabulon.sources.csv_ingest import column_names, to_number


def python_number(text):
    if text in ("True", "False"):
        return float(text == "True")
    try:
        return float(text.replace(",", ""))
    except ValueError:
        return None


def test_number_grammar_is_pythons(spark):
    rnd = random.Random(7)
    alphabet = "0123456789..,,eE+-__ infaTru%"
    texts = sorted({"".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 8))) for _ in range(4000)} | {"True", "False", "inf", "-Infinity", "1_0", "1__0", "_1", "1e400", " 5 ", "5e", "0x1"})
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", to_number(F.col("t")).alias("v")).collect()
    for r in got:
        want = python_number(r.t)
        same = want is None and r.v is None or want is not None and r.v is not None and (want == r.v or math.isnan(want) and math.isnan(r.v))
        assert same, (r.t, r.v, want)


def test_bins_are_the_libraries(spark):
    rnd = np.random.default_rng(2)
    for values in (rnd.normal(size=200), rnd.integers(0, 9, 100).astype(float), np.array([1.0, 1.0, 2.0])):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        cut = pd.cut(pd.Series(values), 5, labels=False).value_counts().reindex(range(5), fill_value=0)
        got = stats.grouped_bin_mean(df, "x", "x").orderBy("bin").collect()
        assert [r.n for r in got] == cut.tolist()


def test_names_are_unique():
    rnd = random.Random(3)
    for _ in range(300):
        names = column_names([rnd.choice(["a", " a", "a.1", "", "b "]) for _ in range(rnd.randrange(1, 9))])
        assert len(set(names)) == len(names) and all(n == n.strip() and n for n in names)
