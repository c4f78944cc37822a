"""Mix sources to target weights: temperature on token shares, realised as budgeted block permutations."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def weights_at(tokens: dict, exponent: float) -> dict:
    total = sum(tokens.values())
    raw = {k: (v / total) ** exponent if v else 0.0 for k, v in tokens.items()}
    z = sum(raw.values())
    return {k: v / z for k, v in raw.items()}


def temperature(tokens: dict, budget: float, target_entropy: float, max_repeats: float) -> tuple[float, dict]:
    """The exponent in [0, 1] and its weights, by bisection.

    Entropy falls as the exponent grows; repetition of the scarcest source falls too. Taken is the
    largest exponent whose entropy reaches target_entropy (as a share of log of the number of sources),
    raised where a source would be repeated more than max_repeats times within the budget.
    """
    live = {k: v for k, v in tokens.items() if v > 0}
    if not live:
        return 1.0, {}
    goal = target_entropy * math.log(len(live))

    def bisect(holds_high, lo: float, hi: float) -> float:
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if holds_high(mid) else (lo, mid)
        return lo

    high_enough = lambda e: entropy([*weights_at(live, e).values()]) >= goal
    exponent = 1.0 if high_enough(1.0) else bisect(high_enough, 0.0, 1.0)
    repeats = lambda e: max(weights_at(live, e)[k] * budget / live[k] for k in live)
    if repeats(exponent) > max_repeats:
        exponent = 1.0 if repeats(1.0) > max_repeats else bisect(lambda e: repeats(e) > max_repeats, exponent, 1.0) + 2**-50
    return exponent, weights_at(live, exponent)


def mix(docs: DataFrame, source: str = "source", text: str = "text", tokens: str | Column | None = None, budget: int | None = None, target_entropy: float = 0.97, max_repeats: float = 4.0, block_docs: int = 1024, seed: int = 17, broadcast_rows: int = 200_000) -> DataFrame:
    """Rows of docs in the chosen amounts: each row as often as it is used, plus mix_pass (0, 1, ...), mix_block, mix_order.

    tokens: a row's number of tokens, as an operator that counts them gives it; runs of non-space characters of `text` if None.
    budget: tokens to emit, all tokens of docs if None; more than max_repeats times all tokens is cut to that, with a warning.
    Each source is dealt by a hash of the row into blocks of some block_docs rows. Pass p permutes the blocks, and the rows inside, by
    another hash. A source gets its
    whole passes, then blocks of its last pass until its budget, and in the block where it is reached,
    rows until it is reached (the row that crosses it counts). Reading (mix_pass, mix_order) gives the
    sequence. One row a source comes to the driver; one number for each source and block is gathered; no row is sorted outside the one cut
    block a source. The table of blocks is broadcast up to broadcast_rows blocks, else joined by shuffle.
    Null is a source of its own; an empty table stays empty. Rows without tokens, null and empty texts among them, go along with their block.
    Repeated rows are dealt to the same block and are ordered by their tokens only, so they stay as many as they are. Columns
    named mix_* are replaced. The rows' hashes and counts are written to the shared folder, so texts are counted once.
    """
    own = [c for c in docs.columns if c not in ("mix_pass", "mix_block", "mix_order")]
    n_tokens = F.coalesce((F.regexp_count(text, F.lit(r"\S+")) if tokens is None else F.col(tokens) if isinstance(tokens, str) else tokens).cast("long"), F.lit(0))
    plain = [c for c, t in docs.dtypes if c in own and not t.startswith(("map", "variant"))]
    base = docs.select(*own).withColumn("__h", F.xxhash64(F.lit(seed), *plain))
    spark = docs.sparkSession
    slim = cut(base.select(F.col(source).alias("__src"), "__h", n_tokens.alias("__n")))
    per_source = slim.groupBy(F.col("__src").alias("s")).agg(F.sum("__n").alias("n"), F.count("*").alias("rows")).collect()  # one row a source
    if not per_source:
        return docs.select(*own).limit(0).withColumns({"mix_pass": F.lit(0), "mix_block": F.lit(0), "mix_order": F.struct(F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("row"))})
    counts = {r.s: r.n for r in per_source}
    total = sum(counts.values())
    budget = total if budget is None else budget
    if budget > max_repeats * total:
        warnings.warn(f"budget {budget} is more than {max_repeats} times all {total} tokens and is cut to that", stacklevel=2)
        budget = max_repeats * total
    exponent, weights = temperature(counts, budget, target_entropy, max_repeats)
    plan = []
    for r in per_source:
        share = min(weights.get(r.s, 0.0) * budget, max_repeats * r.n)
        whole = int(share // r.n) if r.n else (1 if budget >= total else 0)
        rest = share - whole * r.n if r.n else 0.0
        if r.n and rest > r.n - 0.5:
            whole, rest = whole + 1, 0.0
        plan.append((r.s, max(1, -(-r.rows // block_docs)), whole, float(rest) if rest >= 0.5 else 0.0))
    kind = docs.schema[source].dataType.simpleString()
    hint = F.broadcast if sum(p[1] for p in plan) <= broadcast_rows else lambda df: df
    chosen = hint(spark.createDataFrame(plan, f"__s {kind}, __blocks int, __whole int, __rest double"))

    def dealt(df: DataFrame, of: str) -> DataFrame:
        return df.join(chosen, F.col(of).eqNullSafe(F.col("__s"))).withColumn("mix_block", F.pmod("__h", "__blocks").cast("int"))

    key = F.xxhash64(F.lit(seed), "__whole", "mix_block")
    blocks = dealt(slim, "__src").withColumn("__key", key).groupBy("__s", "mix_block", "__key").agg(F.sum("__n").alias("__bn"), F.first("__rest").alias("__rest"))
    run = Window.partitionBy("__s").orderBy("__key", "mix_block").rowsBetween(Window.unboundedPreceding, -1)
    cum = blocks.withColumn("__before", F.coalesce(F.sum("__bn").over(run), F.lit(0))).select("__s", "mix_block", "__bn", "__before", (F.col("__rest") - F.col("__before")).alias("__left"))
    last = hint(cum.where("__left > 0").withColumnRenamed("__s", "__c").withColumnRenamed("mix_block", "__b"))  # at most a row a block
    state = dealt(base, source).join(last, F.col("__s").eqNullSafe(F.col("__c")) & (F.col("mix_block") == F.col("__b")), "left")
    full = state.withColumn("mix_pass", F.explode(F.sequence(F.lit(0), F.col("__whole")))).where("mix_pass < __whole or __left >= __bn")
    within = Window.partitionBy("__s", "mix_block").orderBy("__h", "__n").rowsBetween(Window.unboundedPreceding, -1)
    part = state.where("__left < __bn").withColumn("__n", n_tokens).withColumn("__used", F.coalesce(F.sum("__n").over(within), F.lit(0))).where("__used < __left").withColumn("mix_pass", F.col("__whole")).drop("__used", "__n")
    order = F.struct(F.xxhash64(F.lit(seed), "mix_pass", source, "mix_block").alias("block"), F.xxhash64(F.lit(seed), "mix_pass", "__h").alias("row"))
    return full.select(*part.columns).union(part).select(*own, "mix_pass", "mix_block", order.alias("mix_order"))
