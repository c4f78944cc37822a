"""Embedding near-duplicates over a robust-pruned flat graph built on overlapping cluster shards."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut

DEGREE, ALPHA, BEAM, NEAREST, RANDOM, MEDOIDS = 20, 1.2, 24, 80, 16, 12
SHARD, OVERLAP = 1000, 4
#: A shard that clustering leaves larger than this (a dense ball) is split again inside its task.
SHARD_MOST = 4 * SHARD
CENTROIDS, SAMPLE = 4096, 40_000


def usable(vector: str | Column) -> Column:
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(a: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision, without overflow or underflow."""
    a = np.asarray(a, np.float64)
    a = a / np.abs(a).max(1, keepdims=True)
    return a / np.sqrt((a * a).sum(1, keepdims=True))


def robust_prune(order: np.ndarray, to_p: np.ndarray, x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> list[int]:
    """Of candidates by falling similarity, those that no chosen one is alpha times nearer to than p is."""
    d_p = np.sqrt(np.maximum(0, 2 - 2 * to_p[order]))
    d = np.sqrt(np.maximum(0, 2 - 2 * (x[order] @ x[order].T)))
    alive, out = np.ones(len(order), bool), []
    for i in range(len(order)):
        if alive[i]:
            out.append(int(order[i]))
            if len(out) >= degree:
                break
            alive &= alpha * d[i] > d_p
    return out


def build_graph(x: np.ndarray) -> list[list[int]]:
    """Adjacency lists of one shard: pruned nearest rows, a few pruned random ones, reverse edges, and edges that make all rows reachable from the medoids."""
    n, rnd = len(x), np.random.default_rng(len(x))
    f = x.astype(np.float32)
    out: list[list[int]] = []
    for a in range(0, n, 256):
        s = f[a : a + 256] @ f.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
        k = min(NEAREST, n - 1)
        near = np.argpartition(-s, k - 1, 1)[:, :k] if k else np.zeros((len(s), 0), int)
        for i in range(len(s)):
            o = near[i][np.argsort(-s[i][near[i]], kind="stable")]
            far = np.setdiff1d(rnd.integers(0, n, RANDOM), [a + i])
            far = far[np.argsort(-s[i][far], kind="stable")]
            out.append([*dict.fromkeys(robust_prune(o, s[i], f) + robust_prune(far, s[i], f, degree=DEGREE // 5))])
    for i, near in enumerate([*map(list, out)]):
        for j in near:
            if len(out[j]) < 2 * DEGREE and i not in out[j]:
                out[j].append(i)
    seen = np.zeros(n, bool)
    reach = medoids(x).tolist()
    while True:
        seen[reach] = True
        stack = list(reach)
        while stack:
            for j in out[stack.pop()]:
                if not seen[j]:
                    seen[j] = True
                    stack.append(j)
        lost = np.flatnonzero(~seen)
        if not len(lost):
            return out
        i, known = int(lost[0]), np.flatnonzero(seen)
        j = int(known[np.argmax(f[known] @ f[i])])
        out[j].append(i)
        out[i].append(j)
        reach = [i]


def medoids(x: np.ndarray) -> np.ndarray:
    """The rows nearest to the centroids of at most MEDOIDS clusters: where searches start."""
    return np.unique(np.argmax(x @ cluster(x, min(MEDOIDS, len(x))).T, 0))


def range_search(q: np.ndarray, x: np.ndarray, near: list[np.ndarray], start: np.ndarray, least: float, beam: int = BEAM) -> np.ndarray:
    """Rows with cosine >= least to q: greedy search from the rows `start`, then expansion around all rows in range."""
    seen = np.zeros(len(x), bool)
    seen[start] = True
    sims = x[start] @ q
    todo = [(-s, i) for s, i in zip(sims.tolist(), start.tolist(), strict=True)]
    heapq.heapify(todo)
    best = sorted(sims.tolist())[-beam:]
    found = [start[sims >= least]]
    while todo:
        s, i = heapq.heappop(todo)
        if len(best) >= beam and -s < best[0]:
            break
        new = near[i][~seen[near[i]]]
        if not len(new):
            continue
        seen[new] = True
        sims = x[new] @ q
        inside = sims >= least
        if inside.any():
            found.append(new[inside])
        for v, j in zip(sims.tolist(), new.tolist(), strict=True):
            if len(best) < beam:
                heapq.heappush(best, v)
            elif v > best[0]:
                heapq.heapreplace(best, v)
            else:
                continue
            heapq.heappush(todo, (-v, j))
    wave = np.concatenate(found) if found else np.zeros(0, np.int64)
    found, expanded = [wave], np.zeros(len(x), bool)
    while len(wave):
        expanded[wave] = True
        new = np.unique(np.concatenate([near[i] for i in wave]))
        new = new[~seen[new]]
        seen[new] = True
        wave = new[x[new] @ q >= least]
        found.append(wave)
    return np.concatenate(found)


def shards_of(x: np.ndarray, centroids: np.ndarray, overlap: int = OVERLAP) -> np.ndarray:
    k = min(overlap, len(centroids))
    s = x @ centroids.T
    return np.argpartition(-s, k - 1, 1)[:, :k] if k < len(centroids) else np.tile(np.arange(k), (len(x), 1))


def cluster(x: np.ndarray, k: int, rounds: int = 6, apart: float = 0.93) -> np.ndarray:
    """Unit centroids of spherical k-means, started on evenly spaced rows.

    Of centroids nearer to each other than `apart` only one stays, so that a dense ball is not cut.
    """
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], c)
    kept: list[int] = []
    for i in range(len(c)):
        if not kept or (c[kept] @ c[i]).max() < apart:
            kept.append(i)
    return c[kept]


def parts(x: np.ndarray) -> list[np.ndarray]:
    """Overlapping sub-shards of a shard that is too large; one part otherwise."""
    if len(x) <= SHARD_MOST:
        return [np.arange(len(x))]
    c = cluster(x[:: max(1, len(x) // SAMPLE)], -(-len(x) // SHARD))
    own = shards_of(x, c)
    return [np.flatnonzero((own == i).any(1)) for i in range(len(c))]


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row for each input row.

    Rows link if their labels and lengths are equal and their cosine in double precision is >= least.
    Null labels, null ids, and vectors that are null, empty, zero, or hold a null or a non-finite number link with
    nothing. Equal vectors of a label form a class, searched once; each row counts, so rows repeated
    under one id link with each other. component_id: the smallest id reachable by links; null for a null id,
    which is not kept. Other columns are ignored.

    Each class goes to the OVERLAP nearest of its label's clusters of some SHARD classes (centroids from a sample of some SAMPLE
    classes of the label, fitted where they lie, at most CENTROIDS a label). Every shard builds a robust-pruned graph; the adjacency lists of
    a class are united over its shards; in every shard each class is searched for from medoids, with
    range expansion, and each pair found is verified in double precision and counted in the first shard
    that it shares. A dense ball is never cut; a shard that is large all the same is split inside its task.
    """
    ok = usable(vector) & F.col(label).isNotNull() & F.col(vec_id).isNotNull()
    named = F.col(label).cast("string")
    two = [F.when(ok, F.xxhash64(*salt, named, F.col(vector))).alias(k) for k, salt in (("k", []), ("k2", [F.lit("second")]))]
    typed = rows.select(F.col(vec_id).alias("id"), *two, named.alias("label"), F.col(vector).cast("array<double>").alias("v"))
    good = typed.where("k is not null")
    classes = good.groupBy("k", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = classes.withColumn("label", F.concat_ws(":", F.size("v"), "label"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))  # 128 bits name a class, the number stands for them
    sizes = classes.groupBy("label").count().where(F.col("count") > SHARD)
    wanted = sizes.select(F.col("label").alias("of"), F.least(F.lit(CENTROIDS), F.ceil(F.col("count") * OVERLAP / SHARD)).cast("int").alias("many"), (F.lit(float(SAMPLE)) / F.col("count")).alias("share"))

    def centres(g: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.stack(g.sort_values("cid").v.to_numpy()))
        return pd.DataFrame({"label": [g.label.iloc[0]], "c": [cluster(x, min(len(x), int(g.many.iloc[0]))).ravel().tolist()]})

    sampled = classes.join(wanted, F.col("label") == F.col("of")).where(F.pmod(F.xxhash64("k"), F.lit(10**6)) < F.col("share") * 10**6)
    fitted = sampled.select("cid", "label", "v", "many").groupBy("label").applyInPandas(centres, "label string, c array<double>")  # some SAMPLE rows each
    centroids = {r.label: np.array(r.c).reshape(-1, int(r.label.split(":")[0])) for r in fitted.collect()}  # of labels above SHARD classes only
    sent = classes.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels = np.array(b.column("label").to_pylist(), object)
            shards: list[list[int]] = [[0]] * len(labels)
            for name in {*labels} & {*sent.value}:
                at = np.flatnonzero(labels == name)
                x = unit(np.array(b.column("v").take(pa.array(at)).to_pylist()))
                for i, s in zip(at, shards_of(x, sent.value[name]), strict=True):
                    shards[i] = sorted(map(int, s))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shards, pa.list_(pa.int32()))], names=[*b.schema.names, "shards"])

    placed = classes.select("cid", "n", "label", "v").mapInArrow(assign, "cid long, n long, label string, v array<double>, shards array<int>")
    members = cut(placed.select("*", F.explode("shards").alias("shard")))

    def build(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("cid")  # so that the search splits a large shard alike
        x, cid = unit(np.stack(g.v.to_numpy())), g.cid.to_numpy()
        out = []
        for part in parts(x):
            for i, near in enumerate(build_graph(x[part])):
                out.append((cid[part[i]], cid[part[near]].tolist()))
        return pd.DataFrame(out, columns=["cid", "near"])

    def search(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("cid")
        x, cid, n, shard = unit(np.stack(g.v.to_numpy())), g.cid.to_numpy(), g.n.to_numpy(), int(g.shard.iloc[0])
        place = {c: i for i, c in enumerate(cid.tolist())}
        near = [np.array(sorted({place[c] for c in e if c in place}), np.int64) for e in g.near]
        mine = np.array([[s for s in t if s != shard] for t in g.shards]) if len(g.shards.iloc[0]) > 1 else np.zeros((len(g), 0), int)
        start = np.unique(np.concatenate([p[medoids(x[p])] for p in parts(x) if len(p)]))
        links, parent = [set() for _ in cid], list(range(len(cid)))

        def top(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i in range(len(cid)):
            links[i] |= {*range_search(x[i], x, near, start, least).tolist()} - {i}
        for i in range(len(cid)):  # a link found from one side holds for both
            for j in links[i]:
                links[j].add(i)
        out = []
        for i in range(len(cid)):
            js = np.array(sorted(links[i]), np.int64)
            if len(js):
                js = js[~(((mine[js] < shard)[:, :, None] & (mine[js][:, :, None] == mine[i][None, None, :])).any((1, 2)))] if mine.shape[1] else js
            total = 0
            for j in js.tolist():
                total += int(n[j])
                a, b = top(i), top(j)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            out.append(total)
        others = [cid[top(i)] if top(i) != i else None for i in range(len(cid))]
        return pd.DataFrame({"cid": cid, "links": out, "other": pd.array(others, dtype="Int64")})

    edges = members.groupBy("label", "shard").applyInPandas(build, "cid long, near array<long>")
    united = edges.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # a list for each shard
    found = cut(members.join(united, "cid").groupBy("label", "shard").applyInPandas(search, "cid long, links long, other long"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comps = components(found.where("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    info = classes.select("cid", "rep", "n").join(links, "cid").join(comps, classes.cid == comps.node, "left").select("cid", "rep", "n", "links", F.coalesce("component", "cid").alias("component"))
    first = info.groupBy("component").agg(F.min("rep").alias("first"))
    info = info.join(first, "component").select("cid", (F.col("n") - 1 + F.col("links")).alias("n_links"), "first")
    out = typed.select("id", "k", "k2").join(classes.select("k", "k2", "cid"), ["k", "k2"], "left").join(info, "cid", "left")
    comp = F.coalesce("first", "id")
    return out.select(F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.cast("long").alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(False)).alias("kept"))


def true_links(rows: DataFrame, every: int = 100, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.93, block: int = 2000) -> DataFrame:
    """(vec_id, n_links) by brute force for ids divisible by `every`, against all rows, in blocks of queries: audits recall."""
    good = rows.where(usable(vector) & F.col(label).isNotNull() & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("l"), F.col(vector).cast("array<double>").alias("v"))
    queries = good.where(F.col("id") % every == 0).orderBy("id")
    out, spark, low = None, rows.sparkSession, None
    while True:
        q = (queries if low is None else queries.where(F.col("id") > low)).limit(block).toPandas()
        if not len(q):
            break
        low = int(q.id.max())
        sent = spark.sparkContext.broadcast((q.id.to_numpy(), q.l.to_numpy(), unit(np.stack(q.v.to_numpy()))))

        def count(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            ids, labels, x = sent.value
            for g in frames:
                y = unit(np.stack(g.v.to_numpy()))
                hit = (x @ y.T >= least) & (labels[:, None] == g.l.to_numpy()[None, :])
                yield pd.DataFrame({"id": ids, "n": hit.sum(1)})

        part = good.mapInPandas(count, "id long, n long").groupBy("id").agg((F.sum("n") - 1).alias("n"))
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], f"{vec_id} long, n_links long") if out is None else out.select(F.col("id").alias(vec_id), F.col("n").alias("n_links"))
