import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon.operators import reshape, stats


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_cut_edges_and_means(spark):
    df = frame(spark, [(0.0, 1.0), (2.0, 2.0), (4.0, 3.0), (10.0, 4.0), (None, 5.0)], "x double, v double")
    got = [tuple(r) for r in stats.grouped_bin_mean(df, "v", "x").orderBy("bin").collect()]
    assert [g[0] for g in got] == [1, 2, 3, 4, 5]
    assert [g[4] for g in got] == [1.5, 3.0, None, None, 4.0]
    assert [g[1] for g in got] == pytest.approx([-0.01, 2, 4, 6, 8])
    assert got[-1][2] == pytest.approx(10)


def test_cut_constant_and_bad(spark):
    df = frame(spark, [(5.0,), (5.0,)], "x double")
    got = stats.grouped_bin_mean(df, "x", "x").where("n > 0").collect()
    assert [(r.bin, round(r.lo, 3), round(r.hi, 3)) for r in got] == [(3, 4.999, 5.001)]
    with pytest.raises(ValueError):
        stats.grouped_bin_mean(frame(spark, [(float("inf"),), (1.0,)], "x double"), "x", "x")
    with pytest.raises(ValueError):
        stats.grouped_bin_mean(frame(spark, [(None,)], "x double"), "x", "x")


@pytest.mark.parametrize("values", [[0, 1, 2, 20], [5, 5], [-3.5, 0.1, 7.25, 7.25, 9]])
def test_histogram_is_numpys(spark, values):
    df = frame(spark, [(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
    got = stats.histogram(df, "x").orderBy("bin").collect()
    counts, edges = np.histogram(values, 20)
    assert [r.n for r in got] == counts.tolist()
    assert [r.lo for r in got] == pytest.approx(edges[:-1].tolist())


def test_empty_frames(spark):
    df = frame(spark, [], "x double, y double")
    assert stats.histogram(df, "x").count() == 0
    assert stats.column_summary(df, "x").first().mean is None
    assert {r.nulls for r in stats.null_counts(df).collect()} == {0}
    assert stats.scatter_pairs(df, "x", "y").count() == 0
    assert stats.trend(df, "x", ["y"]).count() == 0


def test_describe(spark):
    df = frame(spark, [(1.0, "a"), (2.0, "b"), (3.0, "a"), (4.0, None), (None, None)], "x double, s string")
    got = {r.stat: r.value for r in stats.describe_numeric(df).collect()}
    want = pd.Series([1.0, 2, 3, 4, None]).describe()
    assert all(got[k] == pytest.approx(want[k]) for k in want.index)
    assert tuple(stats.describe_categorical(df, ["s"]).first()) == ("s", 3, 2, "a", 2)


def test_approximate_quantiles(spark):
    df = spark.range(10_001).select(F.col("id").cast("double").alias("x"))
    got = {r.stat: r.value for r in stats.describe_numeric(df, exact=False).collect()}
    assert got["50%"] == pytest.approx(5000, abs=3) and got["25%"] == pytest.approx(2500, abs=3)


def test_corr(spark):
    df = frame(spark, [(1.0, 2.0, 7.0), (2.0, None, 7.0), (None, 3.0, 7.0), (4.0, 9.0, 7.0), (5.0, 1.0, 7.0)], "x double, y double, k double")
    got = {(r.x, r.y): r["corr"] for r in stats.corr_matrix(df).collect()}
    assert got["x", "y"] == pytest.approx(0.16531163063339513) == got["y", "x"]
    assert got["x", "k"] is None and got["k", "k"] is None and got["x", "x"] == pytest.approx(1)


def test_corr_without_gaps(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(50, 3)) * [1, 1e-3, 1e6] + [0, 5, 1e9]
    df = spark.createDataFrame([(*map(float, r), 0.1) for r in x], "a double, b double, c double, k double")
    got = {(r.x, r.y): r["corr"] for r in stats.corr_matrix(df).collect()}
    want = np.corrcoef(x.T)
    for i, p in enumerate("abc"):
        for j, o in enumerate("abc"):
            assert got[p, o] == pytest.approx(want[i, j], abs=1e-6)
    assert got["a", "k"] is None and len(got) == 16
    assert stats.corr_matrix(df.limit(0)).where("corr is not null").count() == 0


def test_moments_match_pandas(spark):
    v = [1.0, 2.0, 2.5, 7.0, 11.0, 3.0]
    got = stats.moments(frame(spark, [(x,) for x in v], "x double"), "x").first()
    s = pd.Series(v)
    assert (got["var"], got["skew"], got["kurt"]) == pytest.approx((s.var(), s.skew(), s.kurt()))


def test_trend_numbers_all_rows_in_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), F.col("id").cast("double").alias("v"))
    got = stats.trend(df, "v", ["k"]).orderBy("index").collect()
    assert [r["index"] for r in got] == list(range(1000))
    want = [r.v for r in df.orderBy("k").collect()]
    assert [r.value for r in got] == want


def test_split_is_stable(spark):
    df = spark.range(1000)
    train, test = stats.split_train_test(df, ["id"])
    again = stats.split_train_test(df.repartition(7), ["id"])[1]
    assert train.count() + test.count() == 1000 and 180 < test.count() < 320
    assert {r.id for r in test.collect()} == {r.id for r in again.collect()}


def test_metrics_and_t(spark):
    df = frame(spark, [(1.0, 1.5, "a"), (2.0, 2.0, "a"), (4.0, 3.0, "b"), (6.0, 6.5, "b")], "y double, p double, g string")
    m = stats.score_metrics(df, "y", "p").first()
    assert m.mse == pytest.approx(0.375) and m.r2 == pytest.approx(1 - 0.375 / np.var([1, 2, 4, 6]))
    t = stats.t_test(df, "y", "g", "a", "b").first()
    assert t.t == pytest.approx(-3.5 / math.sqrt(0.5 / 2 + 2 / 2))


def test_asof_ties_and_strict(spark):
    left = frame(spark, [(1, 10), (1, 20), (2, 5)], "k int, t int")
    right = frame(spark, [(1, 10, "a"), (1, 15, "b"), (2, 6, "c")], "k int, t int, v string")
    got = {(r.k, r.t): r.right_v for r in reshape.asof_join(left, right, ["k"], "t", ["v"]).collect()}
    assert got == {(1, 10): "a", (1, 20): "b", (2, 5): None}
    got = {(r.k, r.t): r.right_v for r in reshape.asof_join(left, right, ["k"], "t", ["v"], strict=True).collect()}
    assert got == {(1, 10): None, (1, 20): "b", (2, 5): None}


def test_range_join_equals_nested_loop(spark):
    points = spark.range(200).select((F.col("id") * 0.37).alias("p"))
    ranges = frame(spark, [(0.0, 3.0, 1), (2.5, 50.0, 2), (70.0, 60.0, 3), (10.0, 10.0, 4)], "lo double, hi double, n int")
    got = reshape.range_join(points, ranges, "p", "lo", "hi", 5.0)
    want = points.join(ranges, (F.col("p") >= F.col("lo")) & (F.col("p") < F.col("hi")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
