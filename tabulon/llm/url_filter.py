"""URL filter: a blocked Bloom filter of listed canonical URLs before an exact join. DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK_BITS, WORDS = 512, 8
PROBES = 6


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _bits(key: Column, blocks: int) -> list[tuple[Column, Column]]:
    """For each probe the 0-based word in the filter and the bit in that word; all lie in one block of 512 bits."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks)) * WORDS
    second = F.xxhash64(key, F.lit(1))
    places = [F.shiftrightunsigned(second, 9 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)) for i in range(PROBES)]
    return [(block + F.shiftright(p, 6), p.bitwiseAND(F.lit(63))) for p in places]


def bloom_words(keys: DataFrame, blocks: int) -> DataFrame:
    """One row with `words`: the filter of column key as an array of blocks * 8 longs."""
    each = F.explode(F.array(*[F.struct(w.alias("w"), F.expr("1L").alias("one"), b.cast("int").alias("b")) for w, b in _bits(F.col("key"), blocks)]))
    set_words = keys.select(each.alias("x")).groupBy("x.w").agg(F.bit_or(F.expr("shiftleft(x.one, x.b)")).alias("v"))
    blank = keys.sparkSession.range(blocks * WORDS).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("v"))
    every = blank.union(set_words).groupBy("w").agg(F.bit_or("v").alias("v"))
    pairs = F.array_sort(F.collect_list(F.struct("w", "v")))  # blocks * WORDS rows, whatever the keys are
    return every.agg(F.transform(pairs, lambda p: p.v).alias("words"))


def bloom_hit(words: Column, key: Column, blocks: int) -> Column:
    tests = [F.expr("true")]
    for w, b in _bits(key, blocks):
        word = F.element_at(words, (w + 1).cast("int"))
        tests.append(F.call_function("shiftrightunsigned", word, b.cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    return reduce(lambda x, y: x & y, tests)


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, url: str = "url", default: str = "allow", bits_per_key: int = 16, max_blocks: int = 1 << 16, broadcast_rules: int = 100_000) -> DataFrame:
    """All rows and columns of pages plus host, path, rule, listed, verdict.

    rules(host, path, verdict): a rule fits its host and all its subdomains where the path starts with
    the rule's; the longest rule string wins, then the first in string order. listed(host, path): blocked
    URL prefixes of the same form, judged after the rules. Otherwise the verdict is `default`.

    The filter has bits_per_key bits a key but never more than max_blocks blocks of 64 bytes; beyond that
    only more false hits reach the exact join. The list is broadcast to that join up to broadcast_rules
    rows, else it is shuffled.
    Null or odd URLs have host and path empty and get the default. Rules with a null host or path, or
    an empty host, never fit. Repeated pages stay. An input column named like an output column is replaced.
    """
    taken = {"host", "path", "rule", "listed", "verdict"}
    own = [c for c in pages.columns if c not in taken]
    base = pages.select(*own, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    entries = rules.select("host", "path", "verdict", F.lit(0).alias("kind"))
    if listed is not None:
        entries = entries.unionByName(listed.select("host", "path", F.lit("block").alias("verdict"), F.lit(1).alias("kind")))
    entries = entries.where("host <> '' and path is not null").select(F.concat("host", "path").alias("key"), "kind", "verdict").groupBy("key", "kind").agg(F.min("verdict").alias("verdict"))
    lengths = sorted(r[0] for r in rules.select(F.length("path")).union((listed if listed is not None else rules).select(F.length("path"))).distinct().collect() if r[0] is not None)
    n = entries.count()
    blocks = max(1, min(max_blocks, math.ceil(n * bits_per_key / BLOCK_BITS)))
    words = bloom_words(entries, blocks).scalar()

    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(fitting, lambda n: F.concat(s, F.col("path").substr(F.lit(1), n)))))
    hits = base.select("host", "path").where("host <> ''").distinct().withColumn("key", F.explode(keys)).where(bloom_hit(words, F.col("key"), blocks))
    small = F.broadcast(entries) if n <= broadcast_rules else entries
    first = F.struct((-F.length("key")).alias("l"), "key", "verdict")
    judged = hits.join(small, "key").groupBy("host", "path").agg(F.min(F.when(F.col("kind") == 0, first)).alias("r"), F.min(F.when(F.col("kind") == 1, first)).alias("b"))
    out = base.join(judged, ["host", "path"], "left")
    return out.select(*own, "host", "path", F.col("r.key").alias("rule"), F.col("b.key").alias("listed"), F.coalesce("r.verdict", "b.verdict", F.lit(default)).alias("verdict"))
