"""Quality classifier with hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, pieces
from .decontaminate import content_key

_TOKEN = re.compile(r"\w+|[^\w\s]+")
SLOTS = 1 << 16
_SHAPE = re.compile(r"[^\W\d_]+")


class Slots(dict):
    """Token to feature slot, bounded."""

    def __missing__(self, t: str) -> int:
        if len(self) > 300_000:
            self.clear()
        s = self[t] = xxhash.xxh32_intdigest(t) % SLOTS
        return s


def dense(text: str, tokens: list[str], distinct: int) -> list[float]:
    """Shares of a whole text that mark boilerplate and noise, each in 0..1 or a logarithm."""
    n, c = max(1, len(tokens)), max(1, len(text))
    upper = sum(1 for w in text.split() if len(w) > 1 and w.isupper())
    words = sum(1 for t in tokens if t[0].isalnum())
    lines = text.count("\n") + 1
    return [
        1.0, math.log1p(n) / 10, distinct / n, words / n, upper / n, sum(map(len, tokens)) / n / 10,
        text.count("|") / n, lines / n, sum(ch in text for ch in "{}[]<>#*$%&@") / 12, math.sqrt(min(1.0, sum(map(text.count, "#*$%&!")) / c)),
        sum(map(text.count, "0123456789")) / c, min(1.0, 20 / n), min(1.0, 5 / n),
    ]


DENSE = 13


def features(text: str | None, slots: Slots) -> tuple[np.ndarray, list[float]]:
    text = text or ""
    tokens = _TOKEN.findall(text)
    seen = set(_TOKEN.findall(text.lower()))
    return np.unique(np.fromiter(map(slots.__getitem__, seen), np.int64, len(seen))), dense(text, tokens, len(seen))


def fit(at: np.ndarray, row: np.ndarray, dn: np.ndarray, bad: np.ndarray, rounds: int = 500, l2: float = 2e-5, least_z: float = 5.0) -> tuple[np.ndarray, np.ndarray]:
    """One logistic regression by full-batch Adagrad; only slots whose class frequencies differ by least_z deviations take part."""
    w, v = np.zeros(SLOTS), np.zeros(DENSE)
    if not len(bad) or bad.min() == bad.max():
        v[0] = 6.0 if len(bad) and bad.max() else -6.0
        return w, v
    n1, n0 = bad.sum(), (1 - bad).sum()
    c1 = np.bincount(at, bad[row], SLOTS)
    c0 = np.bincount(at, minlength=SLOTS) - c1
    p = (c1 + c0 + 1) / (n1 + n0 + 2)
    z = (c1 / n1 - c0 / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    told = ((np.abs(z) >= least_z) & (c1 + c0 >= 4))[at]
    at, row = at[told], row[told]
    weight = np.where(bad > 0, 0.5 / bad.mean(), 0.5 / (1 - bad.mean())) ** 0.5
    weight /= weight.sum()
    gw, gv = np.full(SLOTS, 1e-10), np.full(DENSE, 1e-10)
    for _ in range(rounds):
        s = np.bincount(row, w[at], len(bad)) + dn @ v
        g = (1 / (1 + np.exp(-np.clip(s, -30, 30))) - bad) * weight
        dw, dv = np.bincount(at, g[row], SLOTS) + l2 * w, g @ dn
        gw += dw**2
        gv += dv**2
        w -= 0.4 * dw / np.sqrt(gw)
        v -= 0.4 * dv / np.sqrt(gv)
    return w, v


def train(made: list[tuple[np.ndarray, list[float]]], targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A regression for each column of targets: slot weights (SLOTS x heads) and dense weights (DENSE x heads)."""
    at = np.concatenate([np.asarray(m[0], np.int32) for m in made]) if made else np.zeros(0, np.int32)
    row = np.repeat(np.arange(len(made), dtype=np.int32), [len(m[0]) for m in made])
    dn = np.array([m[1] for m in made]).reshape(-1, DENSE)
    heads = [fit(at, row, dn, targets[:, i]) for i in range(targets.shape[1])]
    return np.stack([h[0] for h in heads], 1), np.stack([h[1] for h in heads], 1)


def probability(x: tuple[np.ndarray, list[float]], w: np.ndarray, v: np.ndarray) -> float:
    """That some head's fault is there, as if they were independent."""
    z = np.clip(w[x[0]].sum(0) + np.dot(x[1], v), -12, 12)
    return float(1 - np.prod(1 / (1 + np.exp(z))))


def fitted(docs: DataFrame, labels: DataFrame, faults: tuple[str, ...], doc_id: str, text: str, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights learned from at most `rows` labelled texts without a fault and as many with each, the first by a hash of the id.

    Features of the whole texts are made where the texts are; one task gets the bounded sample of them and
    fits. Only the weights come to the driver: (SLOTS + DENSE) x faults numbers.
    """
    known = [F.max(F.coalesce(F.expr(x), F.lit(False)).cast("int")).alias(f"__f{i}") for i, x in enumerate(faults)]
    marked = labels.where(F.col(doc_id).isNotNull()).groupBy(doc_id).agg(*known).withColumn("__h", F.xxhash64(doc_id))
    cols = [f"__f{i}" for i in range(len(faults))]
    picked = marked.where(" and ".join(f"{c} = 0" for c in cols)).orderBy("__h").limit(rows)
    for c in cols:
        picked = picked.union(marked.where(f"{c} = 1").orderBy("__h").limit(rows))
    picked = F.broadcast(picked.distinct())  # at most (1 + faults) x rows
    got = docs.select(doc_id, F.col(text).alias("__t")).join(picked, doc_id).select("__h", F.xxhash64("__t").alias("__g"), F.array(*cols).alias("__y"), "__t")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        for b in pieces(batches, "__t"):
            x = [features(t.as_py(), slots) for t in b.column("__t")]
            own = [pa.array([m[0] for m in x], pa.list_(pa.int32())), pa.array([m[1] for m in x], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column("__h"), b.column("__g"), b.column("__y"), *own], names=["h", "g", "y", "at", "dn"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, y = [], []
        for b in batches:
            made += zip((x.values.to_numpy() for x in b.column("at")), b.column("dn").to_pylist(), strict=True)
            y += b.column("y").to_pylist()
        w, v = train(made, np.array(y, float).reshape(-1, len(faults)))
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (w, v)], names=["w", "v"])

    sample = got.mapInArrow(featured, "h long, g long, y array<int>, at array<int>, dn array<double>").orderBy("h", "g").limit((1 + len(faults)) * rows)
    w, v = sample.mapInArrow(learn, "w binary, v binary").first()  # a limited sample is one partition
    return np.frombuffer(w).reshape(SLOTS, -1), np.frombuffer(v).reshape(DENSE, -1)


def judge(docs: DataFrame, labels: DataFrame, faults: tuple[str, ...] = ("quality = 0", "toxic = 1"), doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", threshold: float = 0.5, sample_rows: int = 2500) -> DataFrame:
    """All rows and columns of docs but the text, plus p_doc, p_host, p_path, p_bad, keep.

    A linear classifier with a head for each fault is fitted on a bounded sample of labelled documents
    (sample_rows without a fault and as many with each, whole texts) and judges every whole
    text: p_doc, that it has any fault. Its probabilities are summed by host and by path of a
    host over all documents. Beta priors shrink them: a host's posterior mean lies between its own mean and
    the corpus's, a path's between its own and its host's, each with a prior strength fitted by moments, so
    that sparse sites take their parent's. p_host and p_path are of the other documents of the site: the
    document's own evidence counts once, in p_doc. p_bad replaces the corpus's odds by the path's in
    the document's. keep: p_bad < threshold. The scores, without texts, are written to the shared
    folder, so each text is judged once.

    Null texts are judged as empty; null hosts and paths are groups of their own. Labels that are null,
    repeated (the worse counts) or without a document are harmless; without labels of both classes all
    documents get the same p_doc. Repeated documents stay, each weighs in its site.
    """
    sent = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, faults, doc_id, text, sample_rows))
    made = ("p_doc", "p_host", "p_path", "p_bad", "keep")
    names = [c for c in docs.columns if c not in (*made, text)]
    schema = T.StructType([*docs.select(names).schema.fields, T.StructField("p_doc", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots()
        w, v = sent.value
        for b in batches:
            p = [probability(features(t.as_py(), slots), w, v) for t in b.column(text)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(p, pa.float64())], names=[*names, "p_doc"])

    scored = cut(docs.select(*names, text).mapInArrow(run, schema))
    return add_sites(scored, host, path, threshold)


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", **how) -> DataFrame:
    """docs without those that judge() rejects; columns as they are."""
    key = content_key(F.col(text)).alias("__ck")
    slim = docs.select(F.col(doc_id).alias("__id"), key, F.col(host).alias("__host"), F.col(path).alias("__path"), F.col(text).alias("__text"))
    named = labels.withColumnRenamed(doc_id, "__id")
    bad = judge(slim, named, doc_id="__id", text="__text", host="__host", path="__path", **how).where("not keep").select("__id", "__ck", "__host", "__path").distinct()
    match = F.col(doc_id).eqNullSafe(F.col("__id")) & (content_key(F.col(text)) == F.col("__ck")) & F.col(host).eqNullSafe(F.col("__host")) & F.col(path).eqNullSafe(F.col("__path"))
    return docs.join(bad, match, "left_anti")


def strength(mean: float, between: float) -> float:
    """Beta prior strength from the variance of group means about their parent's mean: m(1-m)/variance - 1, in 1..1000."""
    if between <= 0 or mean <= 0 or mean >= 1:
        return 1000.0
    return float(min(1000.0, max(1.0, mean * (1 - mean) / between - 1)))


def add_sites(scored: DataFrame, host: str, path: str, threshold: float) -> DataFrame:
    """scored(p_doc) plus p_host, p_path, p_bad, keep; see judge()."""
    site = scored.groupBy(F.col(host).alias("__h"), F.col(path).alias("__p")).agg(F.count("*").alias("__n"), F.sum("p_doc").alias("__s"))
    site = cut(site)  # one row a path
    hosts = site.groupBy("__h").agg(F.sum("__n").alias("__hn"), F.sum("__s").alias("__hs"))
    moments = lambda d, n, s: d.agg(F.sum(n).alias("n"), F.sum(s).alias("s"), (F.sum(F.expr(f"{s} * {s} / {n}")) / F.sum(n)).alias("q"), F.count("*").alias("k")).first()
    m, mp = moments(hosts, "__hn", "__hs"), moments(site, "__n", "__s")
    mean = m.s / m.n if m.n else 0.0
    a = strength(mean, (m.q or 0) - mean * mean)
    b = strength(mean, max(0.0, (mp.q or 0) - (m.q or 0)))
    sums = site.join(hosts.withColumnRenamed("__h", "__h2"), F.col("__h").eqNullSafe(F.col("__h2"))).drop("__h2")
    own = F.col("p_doc")
    others = lambda s, n, prior, k: (F.greatest(F.lit(0.0), F.col(s) - own) + F.lit(k) * prior) / (F.col(n) - 1 + F.lit(k))
    out = scored.join(sums, F.col(host).eqNullSafe(F.col("__h")) & F.col(path).eqNullSafe(F.col("__p")))
    out = out.withColumn("p_host", others("__hs", "__hn", F.lit(mean), a)).withColumn("p_path", others("__s", "__n", F.col("p_host"), b))
    logit = lambda p: F.log(F.greatest(F.lit(1e-6), p) / F.greatest(F.lit(1e-6), 1 - p))
    z = logit(own) + logit(F.col("p_path")) - F.lit(math.log(max(mean, 1e-6) / max(1 - mean, 1e-6)))
    p = 1 / (1 + F.exp(-z))
    return out.drop("__h", "__p", "__n", "__s", "__hn", "__hs").withColumn("p_bad", p).withColumn("keep", F.col("p_bad") < threshold)
