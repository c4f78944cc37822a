"""Reshaping, cleaning, rolling, as-of and per-session operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pivot_counts(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """A column of counts for each listed value; listing them saves a pass and bounds the width."""
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0)


def melt(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(ids, values, "variable", "value")


def rolling(value: Column | str, order: list, size: int, by: list | None = None, how=F.avg) -> Column:
    """Aggregate of the last `size` rows in order, null before there are as many with a value."""
    w = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(*order).rowsBetween(1 - size, 0)
    return F.when(F.count(value).over(w) >= size, how(value).over(w))


def pct_change(value: str, order: list, by: list) -> Column:
    last = F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    return F.try_divide(F.col(value) - last, last)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], strict: bool = False) -> DataFrame:
    """Rows of left plus right_<value> of the last row of right with the same keys and on <= left's (< if strict).

    One sort by key and time over both sides: neither side is multiplied. Rows without a match get null.
    """
    side = lambda df, n, keep: df.select(*by, on, F.lit(n).alias("__side"), *keep)
    payload = F.struct(*[c for c in left.columns if c not in (*by, on)], F.lit(True).alias("__own")).alias("__left")
    latest = F.struct(*[F.col(v).alias(v) for v in values]).alias("__right")
    # at equal times the right side comes first, or last if it must be strictly earlier
    both = side(left, 1, [payload]).unionByName(side(right, 2 if strict else 0, [latest]), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(on, "__side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("__last", F.last("__right", ignorenulls=True).over(w)).where("__side = 1")
    own = [c if c in (*by, on) else F.col(f"__left.{c}").alias(c) for c in left.columns]
    return filled.select(*own, *[F.col(f"__last.{v}").alias(f"right_{v}") for v in values])


def range_join(points: DataFrame, ranges: DataFrame, point: str, lo: str, hi: str, width: float) -> DataFrame:
    """points joined to ranges with lo <= point < hi through buckets of `width`, so that it is an equi-join.

    A range is repeated once for each bucket it meets; choose width near the usual range length.
    """
    bucket = lambda c: F.floor(F.col(c).cast("double") / F.lit(float(width))).cast("long")
    p = points.withColumn("__b", bucket(point))
    r = ranges.where(F.col(lo) < F.col(hi)).withColumn("__b", F.explode(F.sequence(bucket(lo), bucket(hi))))
    return p.join(r, "__b").where((F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi))).drop("__b")


def latest_per_session(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each session by the order columns, as a grouped maximum: partly aggregated before its shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"b.{c}").alias(c) for c in (*order, *rest)]).select(*df.columns)


def session_history(df: DataFrame, where: dict, order: list[str]) -> DataFrame:
    for k, v in where.items():
        df = df.where(F.col(k).eqNullSafe(F.lit(v)))
    return df.orderBy(*order)


def not_added_yet(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, one for each key, whose key old does not hold."""
    return new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti")


def resample(df: DataFrame, time: str, unit: str, aggregates: dict) -> DataFrame:
    """Aggregates by truncated time; unit as in date_trunc."""
    return df.groupBy(F.date_trunc(unit, time).alias(time)).agg(*[v.alias(k) for k, v in aggregates.items()])


def quantile_bins(df: DataFrame, name: str, bins: int) -> DataFrame:
    """df plus <name>_bin 1..bins by the exact quantiles as edges, right-closed like equal-width bins."""
    edges = df.agg(F.percentile(F.col(name).cast("double"), F.array(*[F.lit(i / bins) for i in range(1, bins)]))).first()[0]
    place = sum(((F.col(name) > F.lit(e)).cast("int") for e in edges), F.lit(1))
    return df.withColumn(f"{name}_bin", place)


def peer_group_frame(value: Column | str, order: list, before: int, after: int, by: list | None = None, how=F.sum) -> tuple[Column, Column]:
    """(group, aggregate): a frame of whole peer groups, `before` to `after` of them around a row's own.

    The group number must be a column of the frame first: df.withColumn("g", group) and then the aggregate over "g".
    """
    keys = by or []
    group = F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order))
    return group, how(value).over(Window.partitionBy(*keys).orderBy("g").rangeBetween(-before, after))


def without_own_row(value: str, frame) -> Column:
    """Sum over a frame that leaves out the row itself; null where no other row is in it."""
    others = F.count(value).over(frame) - F.when(F.col(value).isNotNull(), 1).otherwise(0)
    return F.when(others > 0, F.sum(value).over(frame) - F.coalesce(value, F.lit(0)))


def value_counts(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))


def numbered(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """df plus n: 0-based number in its group."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def clip(x: Column, lo: float, hi: float) -> Column:
    """Limits a value; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def concat(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; columns that one lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
