"""Priority top-up union: ranked sources fill a result list in turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What each source gives at most in the short rule.
ANSWERS, NEWS, TOTAL = 2, 3, 5


def takes_short(a: Column, n: Column, w: Column) -> tuple[Column, Column, Column]:
    """Rows taken from answers, news, web by the short rule, from how many each has: news only below 3 rows, web only below 5."""
    ta = F.least(F.lit(ANSWERS), a)
    tn = F.when(ta < 3, F.least(F.lit(NEWS), n)).otherwise(0)
    tw = F.when(ta + tn < TOTAL, F.least(F.lit(TOTAL) - ta - tn, w)).otherwise(0)
    return ta, tn, tw


def takes_fill(a: Column, n: Column, w: Column, most: int) -> tuple[Column, Column, Column]:
    """Rows taken where each later source fills up to `most`; answers give up to 2 even if most is less."""
    ta = F.least(F.lit(ANSWERS), a)
    tn = F.least(F.greatest(F.lit(most) - ta, F.lit(0)), n)
    tw = F.least(F.greatest(F.lit(most) - ta - tn, F.lit(0)), w)
    return ta, tn, tw


def topup(answers: DataFrame, news: DataFrame, web: DataFrame, pos: str, most: int | None = None) -> DataFrame:
    """Chosen rows plus priority (1 answers, 2 news, 3 web) and rank (1-based over the result).

    pos ranks rows in their source, from the least. most None: the short rule. No row is matched against another: repeats stay.
    Each source is cut to its first rows before anything moves, so its size does not matter.
    """
    caps = (ANSWERS, NEWS if most is None else max(most, 0), TOTAL if most is None else max(most, 0))
    firsts = [df.orderBy(pos).limit(c).withColumn("priority", F.lit(i)) for i, (df, c) in enumerate(zip((answers, news, web), caps, strict=True), 1)]
    pool = firsts[0].unionByName(firsts[1]).unionByName(firsts[2])
    counts = pool.agg(*[F.count_if(F.col("priority") == i).cast("int").alias(f"n{i}") for i in (1, 2, 3)])
    have = [F.col(f"n{i}") for i in (1, 2, 3)]
    ta, tn, tw = takes_short(*have) if most is None else takes_fill(*have, most)
    plan = counts.select(F.array(ta, tn, tw).alias("take")).first().take  # three numbers
    start = [0, plan[0], plan[0] + plan[1]]
    place = F.row_number().over(Window.partitionBy("priority").orderBy(pos))
    picked = pool.withColumn("__i", place).where(F.col("__i") <= F.array(*map(F.lit, plan))[F.col("priority") - 1])
    return picked.withColumn("rank", F.col("__i") + F.array(*map(F.lit, start))[F.col("priority") - 1]).drop("__i")
