"""Near-duplicate documents by order MinHash, verified by banded alignment of word shingles."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SIMILARITY, arrow_rows, components, cut, drop_cut, mix64, pieces, plain, shingles_of, word_hashes
from .decontaminate import content_key

SKETCHES, KMERS = 16, 3
_SEEDS = mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
HUBS, FEW, MANY = 2, 256, 1024
#: Shingles of texts that are counted against another text at once.
AT_ONCE = 1 << 20


def labelled(s: np.ndarray) -> np.ndarray:
    """Shingles with their occurrence number mixed in, so that all are distinct."""
    if len(s) < 2:
        return s
    order = np.argsort(s, kind="stable")
    t = s[order]
    first = np.r_[True, t[1:] != t[:-1]]
    if first.all():
        return s
    nth = np.arange(len(s)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    out = np.empty_like(s)
    out[order] = t ^ mix64(nth.astype(np.uint64))
    return out


def order_min_hash(s: np.ndarray, sketches: int = SKETCHES, kmers: int = KMERS) -> np.ndarray:
    """For each seed the kmers least labelled shingles, hashed in their order in the text."""
    k, out = min(kmers, len(s)), np.empty(sketches, np.uint64)
    at_once = max(1, (1 << 18) // max(1, len(s)))  # so that a long text takes no more memory for its sketches
    for i in range(0, sketches, at_once):
        h = _SEEDS[i : min(sketches, i + at_once)].copy()
        v = (s[None, :] ^ h[:, None]) * np.uint64(0xD6E8FEB86659FD93)
        v ^= v >> np.uint64(32)
        v *= np.uint64(0xD6E8FEB86659FD93)
        least = np.sort(np.argpartition(v, k - 1, axis=1)[:, :k], axis=1) if k < len(s) else np.tile(np.arange(k), (len(h), 1))
        for x in s[least].T:
            h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        out[i : i + at_once] = h
    return out


class Kmers:
    """A text's labelled shingles, in text order and sorted."""

    def __init__(self, words: np.ndarray):
        s = labelled(shingles_of(words))
        self.n = len(s)
        self.order = np.argsort(s)
        self.sorted = s[self.order]


def similarity(a: Kmers, b: Kmers, least: float = SIMILARITY) -> float:
    """Aligned shingles over all shingles of both, m / (a + b - m); 0 where it is below `least` for certain.

    m is the longest chain of equal labelled shingles that rises in both texts, within the band of
    shifts that texts of this similarity can have. No alignment is tried if too few shingles are equal.
    """
    need = least * (a.n + b.n) / (1 + least)
    if not a.n or min(a.n, b.n) < need - 1e-9:
        return 0.0
    at = np.minimum(np.searchsorted(b.sorted, a.sorted), b.n - 1)
    same = b.sorted[at] == a.sorted
    if same.sum() < need - 1e-9:
        return 0.0
    i, j = a.order[same], b.order[at[same]]
    band = a.n + b.n - 2 * need + 1e-9
    near = np.abs(i - j) <= band
    j = j[near][np.argsort(i[near])]
    tails: list[int] = []
    for x in j.tolist():
        if not tails or x > tails[-1]:
            tails.append(x)
        else:
            tails[bisect_left(tails, x)] = x
    m = len(tails)
    s = m / (a.n + b.n - m)
    return s if s >= least - 1e-12 else 0.0


def enough(few: list[Kmers], many: list[Kmers], least: float = SIMILARITY) -> Iterator[tuple[int, int]]:
    """Positions of the pairs that similarity() does not turn down by the number of their shingles and of those equal.

    These are counted for a text against many at once, over the sorted shingles of some AT_ONCE of all of them.
    """
    sizes = np.array([y.n for y in many], np.int64)
    part = np.cumsum(sizes) // AT_ONCE
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(many) else []
    for a, z in zip(starts, [*starts[1:], len(many)], strict=False):
        every = np.concatenate([y.sorted for y in many[a:z]])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], np.repeat(np.arange(z - a), sizes[a:z])[order]
        for i, x in enumerate(few):
            lo, hi = np.searchsorted(every, x.sorted), np.searchsorted(every, x.sorted, "right")
            n = hi - lo
            at = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
            need = least * (x.n + sizes[a:z]) / (1 + least) - 1e-9
            same = np.bincount(owner[at], minlength=z - a)
            for j in np.flatnonzero((same >= need) & (np.minimum(x.n, sizes[a:z]) >= need)).tolist():
                yield i, int(a) + j


def _hashes(words: bytes) -> np.ndarray:
    return np.frombuffer(words, np.uint64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text", 1 << 20):
        plains = [plain(t.as_py()) for t in b.column("text")]
        h, sizes = word_hashes(plains)
        each = np.split(h, np.cumsum(sizes)[:-1])
        keys = [xxhash.xxh128_digest(p) if p else None for p in plains]
        sketches = [order_min_hash(labelled(shingles_of(x))).view(np.int64) if len(x) else None for x in each]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("ck"), pa.array(keys, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))], names=["id", "ck", "key", "sketches"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text", 1 << 20):
        plains = [plain(t.as_py()) for t in b.column("text")]
        h, sizes = word_hashes(plains)
        raw = [x.tobytes() for x in np.split(h, np.cumsum(sizes)[:-1])]
        yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh128_digest(p) for p in plains], pa.binary()), pa.array(raw, pa.binary())], names=["key", "words"])


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, Kmers] | None = None
        for b in batches:
            ok = []
            for x, hub, y in zip(b.column("words"), b.column("b"), b.column("hub_words"), strict=True):
                if last is None or last[0] != hub.as_py():
                    last = (hub.as_py(), Kmers(_hashes(y.as_py())))
                ok.append(similarity(Kmers(_hashes(x.as_py())), last[1], least) > 0)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return run


def _compare(least: float):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        parent: dict = {}

        def top(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        few, many = g[g.few], g[~g.few]
        made = [[Kmers(_hashes(w)) for w in part.words] for part in (few, many)]
        keys, keys2, comps, comps2 = (part[c].tolist() for c in ("key", "comp") for part in (few, many))
        out = []
        for i, j in enough(*made, least):
            c, c2 = top(comps[i]), top(comps2[j])
            if c != c2 and similarity(made[0][i], made[1][j], least):
                parent[c] = c2
                out.append((keys[i], keys2[j]))
        return pd.DataFrame(out, columns=["a", "b"])

    return run


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(id, ck, class_id, first_ck, group_rows): one row for each row of docs; ck is content_key(text).

    Texts whose lower-cased words are equal are copies. Others link if the similarity of their runs of five words
    (of all words, if there are fewer) is >= least in an alignment (see similarity). class_id is the smallest id among all that
    are connected by copies and links; first_ck is the text it has, group_rows their number of rows.
    Texts without words and rows with a null id link with nothing and have their own id.

    Copies are one class each. Classes that share one of the order MinHash sketches are candidates. In
    a first round all classes of a sketch are compared with the most central ones of its HUBS parts only. Sketches that still hold
    classes of several components are then compared in full: every class outside the first hub's
    component against all classes of the sketch, in blocks of FEW by MANY, so no group is gathered in one task.
    """
    src = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).withColumn("ck", content_key("text"))
    made = T.StructType([*src.select("id", "ck").schema.fields, T.StructField("key", T.BinaryType()), T.StructField("sketches", T.ArrayType(T.LongType()))])
    rows = cut(src.mapInArrow(_sketch, made))
    named = rows.where("key is not null and id is not null")
    classes = cut(named.groupBy("key").agg(F.min(F.struct("id", "ck")).alias("first"), F.count("*").alias("n"), F.first("sketches").alias("sketches")))
    spread = classes.select("key", F.posexplode("sketches").alias("i", "sig")).select("key", F.xxhash64("i", "sig").alias("sig"))
    sizes = cut(spread.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1"))
    shared = cut(spread.join(sizes, "sig"))
    drop_cut(sizes)
    central = shared.groupBy("key").agg(F.sum("size").alias("met"))  # the more others meet it, the nearer it is to all
    part = F.pmod(F.hash("key"), F.lit(HUBS)).alias("part")
    best = shared.join(central, "key").groupBy("sig", part).agg(F.max(F.struct("met", "key")).alias("b"))  # a maximum is partly made before the shuffle
    hubs = cut(best.select("sig", F.col("b.key").alias("hub"), F.col("b.met").alias("met")))
    pairs = cut(shared.join(hubs, "sig").where("key <> hub").select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct())
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    texts = classes.select("key", F.col("first.ck").alias("ck")).join(wanted, "key", "left_semi").select("ck")
    words = cut(src.select("ck", "text").join(texts, "ck", "left_semi").dropDuplicates(["ck"]).select("text").mapInArrow(_words, "key binary, words binary"))
    by_hub = pairs.join(words.withColumnRenamed("key", "a"), "a").join(words.select(F.col("key").alias("b"), F.col("words").alias("hub_words")), "b")
    with arrow_rows(docs.sparkSession, 1000):
        links = cut(by_hub.select("a", "b", "words", "hub_words").mapInArrow(_verify(least), "a binary, b binary"))
    comps = cut(components(links))

    main = hubs.groupBy("sig").agg(F.max(F.struct("met", "hub")).alias("m"), F.count("*").alias("heads")).select("sig", "m.hub", "heads")
    left = shared.join(main, "sig").where("size > heads + 1").join(comps, F.col("key") == F.col("node"), "left").select("sig", "key", "hub", "size", F.coalesce("component", "key").alias("comp"))
    open_ = left.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.when(F.col("key") == F.col("hub"), F.col("comp"))).alias("main")).where("lo <> hi")
    rest = cut(left.join(open_.select("sig", "main"), "sig").select("sig", "key", "comp", "size", "main"))
    loose = rest.where("comp <> main").groupBy("sig").agg((F.ceil(F.count("*") / FEW)).cast("int").alias("blocks"))
    spot = rest.join(loose, "sig").withColumn("wide", F.ceil(F.col("size") / MANY).cast("int"))
    few = spot.where("comp <> main").select("sig", "key", "comp", F.pmod(F.hash("key"), "blocks").alias("x"), F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("y"), F.lit(True).alias("few"))
    many = spot.select("sig", "key", "comp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"), F.pmod(F.hash("key"), "wide").alias("y"), F.lit(False).alias("few"))
    more = few.unionByName(many).join(words, "key").groupBy("sig", "x", "y").applyInPandas(_compare(least), "a binary, b binary")
    comps = cut(components(links.union(cut(more.distinct()))))
    for done in (shared, hubs, pairs, words, links, rest):
        drop_cut(done)

    info = classes.drop("sketches").join(comps, F.col("key") == F.col("node"), "left").select("key", "first", "n", F.coalesce("component", "key").alias("component"))
    best = info.groupBy("component").agg(F.min("first").alias("first"), F.sum("n").alias("group_rows"))
    info = info.select("key", "component").join(best, "component").select("key", "first", "group_rows")
    marked = rows.select("id", "ck", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(info, "key", "left")
    return marked.select("id", "ck", F.coalesce("first.id", "id").alias("class_id"), F.coalesce("first.ck", "ck").alias("first_ck"), F.coalesce("group_rows", F.lit(1)).alias("group_rows"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near duplicates, that of the smallest id; columns as they are.

    Rows with a null id and texts without words all stay; of wholly repeated rows one stays.
    """
    g = cut(groups(docs, doc_id, text, least))
    first = (F.col("id") == F.col("class_id")) & (F.col("ck") == F.col("first_ck"))
    bad = g.where(F.col("id").isNotNull() & ~first).select(F.col("id").alias("__id"), F.col("ck").alias("__ck")).distinct()
    out = docs.join(bad, (F.col(doc_id) == F.col("__id")) & (content_key(F.col(text)) == F.col("__ck")), "left_anti")
    again = g.where(first & (F.col("group_rows") > 1)).groupBy("id", "ck").count().where("count > 1").select(F.col("id").alias("__id"), F.col("ck").alias("__ck"))
    if again.isEmpty():
        return out
    match = (F.col(doc_id) == F.col("__id")) & (content_key(F.col(text)) == F.col("__ck"))
    once = out.join(again, match, "left_semi").dropDuplicates([doc_id, text])
    return out.join(again, match, "left_anti").unionByName(once)
