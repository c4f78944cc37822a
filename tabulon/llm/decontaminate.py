"""Benchmark decontamination by spaced-seed hashing. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import url_filter
from .common import cut

#: Fixed seed masks: positions marked 0 are ignored, so a substitution there does not hide a hit. One of MASKS fits
#: every stretch of 13 tokens or more that is 0.8 equal, one of SHORT[n] every item of n tokens that is.
MASKS = ("110111", "11111")
SHORT = {5: ("1111", "11101", "11011", "10111"), 6: ("1111", "11011"), 7: ("11011",), 8: MASKS, 9: ("110111",), 10: ("110111", "11100011", "1101011"), 11: ("1101011", "1110011"), 12: MASKS}
ENOUGH = 13


def masks_of(n: int) -> tuple[str, ...]:
    """Masks for the items of n tokens; shorter ones than any in SHORT must be equal."""
    return MASKS if n >= ENOUGH else SHORT.get(n, ("1" * n,))


def token_hashes(text: str | Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits; null and blank texts have none."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    none = F.expr("cast(array() as array<bigint>)")
    return F.when(plain == "", none).otherwise(F.transform(F.split(plain, " "), lambda t: F.xxhash64(t)))


def content_key(text: str | Column) -> Column:
    """Names a text, so that copies share their work: 96 bits of hash and the length."""
    t = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(t).alias("a"), F.hash(t).alias("b"), F.length(t).alias("c"))


def seeds(h: str, masks: list[str]) -> Column:
    """Array of (p, s): the seed of each mask at each position."""
    none = F.expr("cast(array() as array<struct<p:int,s:bigint>>)")

    def of(mask: str) -> Column:
        chosen = [i for i, c in enumerate(mask) if c == "1"]
        last = F.size(h) - len(mask)
        seed = lambda p: F.struct(p.alias("p"), F.xxhash64(F.lit(mask), *[F.col(h)[p + o] for o in chosen]).alias("s"))
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), seed)).otherwise(none)

    parts = [of(m) for m in masks]
    return F.concat(*parts)


def best_overlap(doc: str, item: str, shift: str, least: Column) -> Column:
    """Of the tokens item[i], doc[i + shift] the stretch of `least` tokens or more with the highest matches - 4 x substitutions: (score, at, size, same).

    The score is negative if no such stretch has at least 0.8 of its tokens equal. It is a difference of prefix
    sums; `low` is the smallest prefix sum that lies at least `least` tokens behind.
    """
    lo, hi = F.greatest(F.lit(0), -F.col(shift)), F.least(F.size(item), F.size(doc) - F.col(shift))
    zero = F.expr("named_struct('cur', 0, 'hits', 0, 'lag', 0, 'lag_hits', 0, 'low', 0, 'low_at', 0, 'low_hits', 0, 'score', -1, 'at', 0, 'size', 0, 'same', 0)")
    hit = lambda i: F.when(F.col(item)[i] == F.col(doc)[i + F.col(shift)], 1).otherwise(0)

    def step(s: Column, i: Column) -> Column:
        start = i + 1 - least
        cur, hits = s.cur + hit(i) * 5 - 4, s.hits + hit(i)
        old = F.when(start > lo, hit(start - 1))  # null until a second start is possible
        lag, lag_hits = s.lag + F.coalesce(old * 5 - 4, F.lit(0)), s.lag_hits + F.coalesce(old, F.lit(0))
        fresh = (start == lo) | ((start > lo) & (lag <= s.low))
        low, low_at, low_hits = F.when(fresh, lag).otherwise(s.low), F.when(fresh, start).otherwise(s.low_at), F.when(fresh, lag_hits).otherwise(s.low_hits)
        more = (start >= lo) & (cur - low > s.score)
        keep = lambda new, old: F.when(more, new).otherwise(old)
        best = [keep(cur - low, s.score).alias("score"), keep(low_at, s["at"]).alias("at"), keep(i + 1 - low_at, s["size"]).alias("size"), keep(hits - low_hits, s.same).alias("same")]
        return F.struct(cur.alias("cur"), hits.alias("hits"), lag.alias("lag"), lag_hits.alias("lag_hits"), low.alias("low"), low_at.alias("low_at"), low_hits.alias("low_hits"), *best)

    return F.aggregate(F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.expr("cast(array() as array<int>)")), zero, step)


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", min_tokens: int = 13, broadcast_seeds: int = 500_000) -> DataFrame:
    """(key, item_id, start, size, same) for each text and benchmark item that overlap.

    An overlap has min_tokens tokens, or all tokens of a shorter item, of which at least 0.8 are equal,
    in order and without gaps; with min_tokens of ENOUGH or more each of them holds a hit of a mask, by enumeration. All positions of all
    texts are hashed. start and size count tokens of the document; the best overlap of each pair is given.
    The benchmark's seeds are broadcast up to broadcast_seeds; beyond that a blocked Bloom filter of
    bounded size thins the documents' seeds before a shuffled join. Items that are null, blank, or repeated
    under one id are harmless; repeated texts are worked on once.
    """
    items = benchmark.select(F.col(item_id).alias("item_id"), token_hashes(F.col(item_text)).alias("i")).where(F.size("i") > 0)
    sizes = [r[0] for r in items.select(F.least(F.size("i"), F.lit(ENOUGH))).distinct().collect()]  # at most ENOUGH
    fits: dict[str, list[int]] = {}
    for size in sorted(sizes) or [ENOUGH]:
        for mask in masks_of(size):
            fits.setdefault(mask, []).append(size)
    masks = [*fits]
    of_mask = [items.where(F.least(F.size("i"), F.lit(ENOUGH)).isin(n)).select("item_id", F.explode(seeds("i", [m])).alias("x")) for m, n in fits.items()]
    wanted = reduce(DataFrame.union, of_mask)
    wanted = wanted.select("item_id", F.col("x.p").alias("ip"), F.col("x.s").alias("s")).distinct()
    n = wanted.count()
    texts = docs.select(F.col(text).alias("__t")).select(content_key("__t").alias("key"), "__t")
    found = texts.select("key", token_hashes("__t").alias("d")).select("key", F.explode(seeds("d", masks)).alias("x")).select("key", F.col("x.p").alias("dp"), F.col("x.s").alias("s"))
    if n <= broadcast_seeds:
        wanted = F.broadcast(wanted)
    else:
        blocks = min(1 << 16, n * 16 // url_filter.BLOCK_BITS + 1)
        words = url_filter.bloom_words(wanted.select(F.col("s").alias("key")).distinct(), blocks).scalar()
        found = found.where(url_filter.bloom_hit(words, F.col("s"), blocks))
    hits = cut(found.join(wanted, "s").groupBy("key", "item_id", (F.col("dp") - F.col("ip")).alias("shift")).agg(F.count("*").alias("seeds")))
    bodies = texts.join(hits.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]).select("key", token_hashes("__t").alias("d"))
    small = items.groupBy("item_id", "i").agg(F.count("*").alias("copies"))
    if n <= broadcast_seeds:
        small = F.broadcast(small)
    pairs = hits.join(bodies, "key").join(small, hits.item_id.eqNullSafe(small.item_id)).drop(small.item_id)
    seen = pairs.select("key", "item_id", "shift", best_overlap("d", "i", "shift", F.least(F.lit(min_tokens), F.size("i"))).alias("o")).where("o.score >= 0")
    best = F.max_by(F.struct((F.col("o.at") + F.col("shift")).alias("start"), F.col("o.size").alias("size"), F.col("o.same").alias("same")), F.struct("o.score", -F.col("shift")))
    return seen.groupBy("key", "item_id").agg(best.alias("b")).select("key", "item_id", "b.*")


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """All columns of docs but the text, and item_id, start, size, same, similarity: a row for each document and item that overlap.

    Input columns with these names, or named key, are left out.
    """
    own = [c for c in docs.columns if c not in (text, "item_id", "start", "size", "same", "similarity", "key")]
    found = overlaps(docs, benchmark, text, **how)
    out = docs.select(*own, content_key(F.col(text)).alias("key")).join(found, "key").drop("key")
    return out.withColumn("similarity", F.col("same") / F.col("size"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """docs without those that overlap a benchmark item; columns as they are."""
    bad = overlaps(docs, benchmark, text, **how).select(F.col("key").alias("__key")).distinct()
    return docs.join(bad, content_key(F.col(text)) == F.col("__key"), "left_anti")
