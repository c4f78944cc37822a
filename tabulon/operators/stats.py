"""Descriptive statistics as one or two aggregations each; NaN counts as null throughout."""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUARTILES = (0.25, 0.5, 0.75)
#: Accuracy of approximate quantiles: their rank is off by a share of 1 / APPROX at most.
APPROX = 10_000
#: Column pairs in one aggregation; wider frames are split.
PAIRS_AT_ONCE = 400


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def q(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(name: str) -> Column:
    """A numeric column as double with NaN as null."""
    x = q(name).cast("double")
    return F.when(~F.isnan(x), x)


def is_missing(df: DataFrame, name: str) -> Column:
    null = q(name).isNull()
    return null | F.isnan(q(name)) if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)) else null


def quantiles(x: Column, at: tuple[float, ...], exact: bool = True) -> Column:
    """Array of quantiles: exact and interpolated, in memory of the distinct values; or approximate, in bounded memory."""
    places = F.array(*[F.lit(v) for v in at])
    return F.percentile(x, places) if exact else F.percentile_approx(x, places, APPROX)


def column_summary(df: DataFrame, name: str, exact: bool = True) -> DataFrame:
    """One row: mean, minimum, maximum, median. exact False bounds the memory for huge columns of many values."""
    x = number(name)
    return df.agg(F.avg(x).alias("mean"), F.min(x).alias("minimum"), F.max(x).alias("maximum"), quantiles(x, (0.5,), exact)[0].alias("median"))


def describe_numeric(df: DataFrame, names: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Rows (column, stat, value): count, mean, std (sample), min, 25%, 50%, 75%, max of each numeric column, in one aggregation."""
    names = numeric_columns(df) if names is None else names
    if not names:
        raise ValueError("no numeric column to describe")

    def stats(name: str) -> Column:
        x = number(name)
        p = quantiles(x, QUARTILES, exact)
        pairs = [("count", F.count(x).cast("double")), ("mean", F.avg(x)), ("std", F.stddev_samp(x)), ("min", F.min(x)), *((f"{int(v * 100)}%", p[i]) for i, v in enumerate(QUARTILES)), ("max", F.max(x))]
        return F.array(*[F.struct(F.lit(name).alias("column"), F.lit(k).alias("stat"), v.alias("value")) for k, v in pairs])

    row = df.agg(F.flatten(F.array(*[stats(n) for n in names])).alias("all"))
    return row.select(F.inline("all"))


def describe_categorical(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows (column, count, unique, top, freq); the most frequent value, of equals the least.

    The columns are unpivoted and counted by value, so a frequent value is summed before its shuffle.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), q(n).cast("string").alias("value")) for n in names])).alias("x")).select("x.*")
    counts = long.groupBy("column", "value").agg(F.count("value").alias("n"))
    best = F.min(F.when(F.col("value").isNotNull(), F.struct((-F.col("n")).alias("m"), "value")))
    out = counts.groupBy("column").agg(F.sum("n").alias("count"), F.count(F.when(F.col("value").isNotNull(), 1)).alias("unique"), best.alias("b"))
    return out.select("column", "count", "unique", F.col("b.value").alias("top"), (-F.col("b.m")).alias("freq"))


def null_counts(df: DataFrame) -> DataFrame:
    """Rows (column, nulls), in one aggregation."""
    parts = F.array(*[F.struct(F.lit(n).alias("column"), F.count_if(is_missing(df, n)).alias("nulls")) for n in df.columns])
    return df.agg(parts.alias("all")).select(F.inline("all"))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def profile(df: DataFrame) -> DataFrame:
    """One row: columns array, dtypes map, shape struct."""
    names, kinds = F.array(*[F.lit(n) for n in df.columns]), F.array(*[F.lit(t) for _, t in df.dtypes])
    return df.agg(F.count("*").alias("rows")).select(names.alias("columns"), F.map_from_arrays(names, kinds).alias("dtypes"), F.struct("rows", F.lit(len(df.columns)).alias("cols")).alias("shape"))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation of complete pairs; null where either is constant."""
    return F.try_divide(F.regr_sxy(y, x), F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x)))


def corr_matrix(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Rows (x, y, corr) for every ordered pair of numeric columns; pairwise complete, each pair computed once.

    A first pass finds each column's mean and whether it has gaps. Pairs of columns without gaps are then a plain sum of
    products of centred values; only pairs with gaps need sums of their own rows.
    """
    names = numeric_columns(df) if names is None else names
    if not names:
        return df.sparkSession.createDataFrame([], "x string, y string, corr double")
    facts = df.agg(F.count("*"), *[f(number(n)) for n in names for f in (F.count, F.avg, F.min, F.max)]).first()
    full, mean, constant = {}, {}, {}
    for i, n in enumerate(names):
        count, mean[n], lo, hi = facts[1 + 4 * i : 5 + 4 * i]
        full[n], constant[n] = count == facts[0] and count > 0, lo == hi
    pairs, frames = [*combinations_with_replacement(names, 2)], []
    centred = lambda n: number(n) - F.lit(mean[n])
    product = lambda a, b: F.sum(centred(a) * centred(b))

    def value(a: str, b: str) -> Column:
        if constant[a] or constant[b]:
            return F.lit(None).cast("double")
        if full[a] and full[b]:
            return F.try_divide(product(a, b), F.sqrt(product(a, a) * product(b, b)))
        return safe_corr(number(a), number(b))

    for i in range(0, len(pairs), PAIRS_AT_ONCE):
        cells = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), v.alias("corr")) for a, b in pairs[i : i + PAIRS_AT_ONCE] for v in [value(a, b)] for x, y in sorted({(a, b), (b, a)})]
        frames.append(df.agg(F.array(*cells).alias("all")).select(F.inline("all")))
    return reduce(DataFrame.unionByName, frames)


def bounds(df: DataFrame, name: str) -> tuple[float | None, float | None]:
    """Least and greatest value: two numbers on the driver, which bin edges need."""
    x = number(name)
    row = df.agg(F.min(x), F.max(x)).first()
    return row[0], row[1]


def histogram(df: DataFrame, name: str, bins: int = 20) -> DataFrame:
    """Rows (bin, lo, hi, n) of equal-width bins, empty ones too; left-closed, the last closed at both ends.

    A constant column spans value +- 0.5. No row where the column has no value.
    """
    x, (lo, hi) = number(name), bounds(df, name)
    spine = df.sparkSession.range(1, bins + 1 if lo is not None else 1).select(F.col("id").cast("int").alias("bin"))
    if lo is None:
        return spine.select("bin", F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), F.lit(0).cast("long").alias("n"))
    if lo in (float("inf"), float("-inf")) or hi == float("inf"):
        raise ValueError(f"{name} is not finite")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    place = F.least(F.lit(bins), 1 + F.floor((x - F.lit(lo)) / F.lit(width)).cast("int"))
    counts = df.where(x.isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    edge = lambda i: F.lit(lo) + i * F.lit(width)
    return spine.join(counts, "bin", "left").select("bin", edge(F.col("bin") - 1).alias("lo"), edge(F.col("bin")).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def cut_column(x: Column, lo: float, hi: float, bins: int = 5) -> Column:
    """Number 1..bins of the equal-width, right-closed bin; the middle one for a constant column."""
    if lo == hi:
        return F.when(x.isNotNull(), F.lit((bins + 1) // 2))
    over = [(x > F.lit(lo + i * (hi - lo) / bins)).cast("int") for i in range(1, bins)]
    return reduce(lambda a, b: a + b, over, F.lit(1))


def grouped_bin_mean(df: DataFrame, target: str, group: str, bins: int = 5) -> DataFrame:
    """Rows (bin, lo, hi, n, mean): the target's mean over equal-width bins of the group column; empty bins stay.

    n counts rows of the bin, also those without a target. Edges: the lowest is 0.1 % of the range below the least value.
    """
    lo, hi = bounds(df, group)
    if lo is None:
        raise ValueError(f"{group} has no value")
    if lo in (float("inf"), float("-inf")) or hi in (float("inf"), float("-inf")):
        raise ValueError(f"{group} is not finite")
    x = number(group)
    means = df.where(x.isNotNull()).groupBy(cut_column(x, lo, hi, bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(number(target)).alias("mean"))
    pad = (abs(lo) or 1.0) * 0.001 if lo == hi else 0.0
    a, b = (lo - pad, hi + pad) if pad else (lo, hi)
    step = (b - a) / bins
    first = a if pad else a - (b - a) * 0.001
    edges = F.when(F.col("bin") == 1, F.lit(first)).otherwise(F.lit(a) + (F.col("bin") - 1) * F.lit(step))
    spine = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return spine.join(means, "bin", "left").select("bin", edges.alias("lo"), (F.lit(a) + F.col("bin") * F.lit(step)).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"), "mean")


def scatter_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    out = df.select(number(x).alias("x"), number(y).alias("y"))
    return out.where("x is not null and y is not null")


def trend(df: DataFrame, name: str, order: list[str], parts: int = 64) -> DataFrame:
    """Rows (index, value): the column against the 0-based row number in a declared order; ties share an order that may vary.

    The first order column's approximate quantiles cut the rows into `parts` ranges; rows are numbered in
    each range and the ranges' sizes give the offsets, so no single task sorts all rows. An order column
    that is no number, date or time is numbered in one range.
    """
    keys, first = [q(c) for c in order], df.schema[order[0]].dataType
    rows = df.select(*keys, number(name).alias("__v"))
    if isinstance(first, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        at = q(order[0]) if isinstance(first, T.NumericType) else F.unix_micros(q(order[0]).cast("timestamp"))
        edges = df.agg(F.percentile_approx(at.cast("double"), [i / parts for i in range(1, parts)], 1000)).first()[0] or []
        part = reduce(lambda a, e: a + F.coalesce((at.cast("double") > F.lit(e)).cast("int"), F.lit(0)), sorted(set(edges)), F.lit(0))
    else:
        part = F.lit(0)
    rows = rows.withColumn("__p", part)
    inner = rows.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*keys)))
    sizes = rows.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))  # a row a range
    return inner.join(F.broadcast(before), "__p").select((F.col("__b") + F.col("__i") - 1).cast("long").alias("index"), F.col("__v").alias("value"))


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: slope, intercept, r2, n of the least-squares line of y over x."""
    a, b = number(x), number(y)
    return df.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"), F.regr_count(b, a).alias("n"))


def regression_many(df: DataFrame, xs: list[str], y: str) -> DataFrame:
    """Rows (term, coefficient) of the least-squares fit of y over several columns, with r2 and mse on each row."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    clean = df.select(*[number(c).alias(f"x{i}") for i, c in enumerate(xs)], number(y).alias("y")).na.drop()
    data = VectorAssembler(inputCols=[f"x{i}" for i in range(len(xs))], outputCol="features").transform(clean)
    fit = LinearRegression(featuresCol="features", labelCol="y", solver="normal").fit(data)
    rows = [(n, float(c), float(fit.summary.r2), float(fit.summary.meanSquaredError)) for n, c in zip(["intercept", *xs], [fit.intercept, *fit.coefficients], strict=True)]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, r2 double, mse double")


def split_train_test(df: DataFrame, keys: list[str], test_share: float = 0.25, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key columns: the same rows on every run and any partitioning."""
    h = F.pmod(F.xxhash64(F.lit(seed), *[q(k) for k in keys]), F.lit(1_000_000)) < int(test_share * 1_000_000)
    return df.where(~h), df.where(h)


def score_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: r2 and mse of a prediction."""
    a, p = number(actual), number(predicted)
    both = F.when(p.isNotNull(), a)
    row = df.agg(F.avg((a - p) ** 2).alias("mse"), F.var_pop(both).alias("v"))
    return row.select((1 - F.try_divide("mse", "v")).alias("r2"), "mse")


def moments(df: DataFrame, name: str) -> DataFrame:
    """One row: n, mean, var (sample), skew and kurtosis (excess), both corrected for sample size."""
    x = number(name)
    row = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"), F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"))
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return row.select("n", "mean", "var", skew.alias("skew"), kurt.alias("kurt"))


def t_test(df: DataFrame, value: str, by: str, a: str, b: str) -> DataFrame:
    """One row: t and degrees of freedom of Welch's test between two groups."""
    x = lambda g: F.when(q(by) == g, number(value))
    row = df.agg(*[f(x(g)).alias(f"{k}{i}") for i, g in enumerate((a, b)) for k, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    s0, s1 = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    dof = F.try_divide((s0 + s1) ** 2, s0**2 / (F.col("n0") - 1) + s1**2 / (F.col("n1") - 1))
    return row.select(F.try_divide(F.col("m0") - F.col("m1"), F.sqrt(s0 + s1)).alias("t"), dof.alias("dof"))


def z_scores(df: DataFrame, name: str) -> DataFrame:
    """df plus <name>_z; the mean and deviation come from one aggregation."""
    x = number(name)
    m = df.agg(F.avg(x), F.stddev_samp(x)).first()
    z = F.try_divide(x - F.lit(m[0]), F.lit(m[1])) if m[1] else F.lit(None).cast("double")
    return df.withColumn(f"{name}_z", z)
