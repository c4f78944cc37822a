"""Helpers that the training-data operators share: cut lineage, hash words, find components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: An odd base of polynomial hashes, the words hashed at once, and the bytes of a word from which xxhash takes it.
BASE, CHUNK, HUGE = 0x9FB21C651E98DF25, 1 << 15, 1 << 12
#: So many edges at most are united in one task.
ONE_TASK = 1 << 18
#: Whether Spark deletes the shuffle files of a query at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WORD = re.compile(r"\w+")
#: What plain() makes of each byte of UTF-8, and what else parts words.
_BYTES = bytes(i if i > 127 else ord(chr(i).lower()) if _WORD.match(chr(i)) else 10 for i in range(256))
_PARTING = re.compile(r"[^\w\x00-\x7f]+")
_powers = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset and Spark is local, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended
        pass


@atexit.register
def _tidy() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting `name` for what runs inside."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it back, so that lost executors recompute nothing before it.

    The shuffle files behind df are then needless: Spark deletes them as the write ends, and what is left of others when the driver collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tabulon-{uuid.uuid4().hex}"
    with setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    _written.append((spark, path))
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of at most `rows` rows between Spark and Python for what is written inside: for rows with long texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    with setting(spark, name, str(min(rows, before) if before > 0 else rows)):
        yield


def drop_cut(df: DataFrame) -> None:
    """Delete what cut() wrote for df, once no later plan reads it."""
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        _delete(df.sparkSession, f)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values (splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def plain(text: str | None) -> str:
    """Runs of letters, digits and underscores of the text as it is, each lower-cased, one a line."""
    if not text:
        return ""
    ascii_ = text.isascii()
    raw = (text if ascii_ else _PARTING.sub("\n", text)).encode().translate(_BYTES)
    while b"\n\n" in raw:
        raw = raw.replace(b"\n\n", b"\n")
    found = raw.strip(b"\n").decode()
    return found if ascii_ else found.lower()


def words_of(text: str | None) -> list[str]:
    """The words of plain(), as many as word_spans gives."""
    found = plain(text)
    return found.split("\n") if found else []


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where the words of words_of stand in the text."""
    return [m.span() for m in _WORD.finditer(text)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, n of each."""
    if len(_powers[0]) < n:
        for i, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(max(n, 4096), b, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def run_hashes(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of x[start:end]: a polynomial in the values, from prefix sums."""
    up, down = powers(len(x) + 1)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[:-1], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts])


def word_hashes(plains: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of plain() texts, one text after the other; and how many each has."""
    sizes = np.fromiter((p.count("\n") + 1 if p else 0 for p in plains), np.int64, len(plains))
    raw = np.frombuffer("\n".join(filter(None, plains)).encode(), np.uint8)
    out = np.zeros(sizes.sum(), np.uint64)
    if not len(out):
        return out, sizes
    bounds = lambda: (lambda ends: (np.r_[0, ends[:-1] + 1], ends))(np.r_[np.flatnonzero(raw == 10), len(raw)])
    starts, ends = bounds()
    huge = {i: xxhash.xxh64_intdigest(raw[starts[i] : ends[i]].tobytes()) for i in np.flatnonzero(ends - starts > HUGE).tolist()}
    if huge:  # their bytes would need as many powers
        keep = np.ones(len(raw), bool)
        for i in huge:
            keep[starts[i] : ends[i]] = False
        raw = raw[keep]
        starts, ends = bounds()
    for i in range(0, len(out), CHUNK):
        a, z = starts[i : i + CHUNK], ends[i : i + CHUNK]
        out[i : i + CHUNK] = run_hashes(raw[a[0] : z[-1]] + np.uint64(1), a - a[0], z - a[0])
    for i, h in huge.items():
        out[i] = h
    return out, sizes


def hashes_of(text: str | None) -> np.ndarray:
    return word_hashes([plain(text)])[0]


def shingles_of(h: np.ndarray, k: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of all runs of k words; a shorter non-empty text is one shingle."""
    if not len(h):
        return h
    k = min(k, len(h))
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k), np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix64(out)


def pieces(batches: Iterable[pa.RecordBatch], text_col: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds some max_bytes of text; a longer single text stays whole."""
    for b in batches:
        if b.num_rows == 0:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(b.column(text_col)), 0).to_numpy(zero_copy_only=False), np.int64)
        group = np.cumsum(lengths) // max_bytes
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        for a, z in zip(starts, [*starts[1:], b.num_rows], strict=True):
            yield b.slice(int(a), int(z - a))


def united(a: pa.Array, b: pa.Array) -> tuple[pa.Array, pa.Array]:
    """All nodes on the edges (a, b) in rising order, and the smallest node reachable from each."""
    nodes = pc.unique(pa.concat_arrays([a, b]))
    nodes = nodes.take(pc.sort_indices(nodes))
    parent = list(range(len(nodes)))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(pc.index_in(a, nodes).to_pylist(), pc.index_in(b, nodes).to_pylist(), strict=True):
        x, y = top(x), top(y)
        parent[max(x, y)] = min(x, y)
    return nodes, nodes.take(pa.array([top(x) for x in range(len(nodes))], pa.int64()))


def _united_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if got := [b for b in batches if b.num_rows]:
        nodes, tops = united(*(pa.concat_arrays([b.column(c) for b in got]) for c in ("u", "v")))
        yield pa.RecordBatch.from_arrays([nodes, tops], names=["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for all nodes on edges; component is the smallest node reachable.

    Up to ONE_TASK edges are united in one task. More alternate large-star and small-star steps, each a grouped minimum that is
    partly aggregated before its shuffle, until nothing changes; every round is written to the shared folder.
    """
    ends = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v"))
    if ends.count() <= ONE_TASK:
        kind = ends.schema["u"].dataType.simpleString()
        return ends.repartition(1).mapInArrow(_united_rows, f"node {kind}, component {kind}")
    pair = F.array_sort(F.array(F.col(a), F.col(b)))
    e = cut(edges.where(F.col(a) != F.col(b)).select(pair[1].alias("u"), pair[0].alias("v")).distinct())
    h = F.xxhash64("u", "v")
    seen = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(h), F.bit_xor(F.xxhash64(h)), F.sum(F.pmod(h, F.lit(1 << 20)))).first())
    before = seen(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        n = cut(small.union(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        drop_cut(e)
        now, e = seen(n), n
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
