"""Near-duplicate passages across and within documents: compact windows over shingle min-hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, SHINGLE_WORDS, SIMILARITY, arrow_rows, cut, drop_cut, mix64, pieces, plain, run_hashes, shingles_of, word_hashes, word_spans

MIN_WORDS, FUNCTIONS, GAP = 50, 3, 12
#: From a passage's first shingle to its last one at least, and how far around a place in it these may lie.
STEP, REACH = MIN_WORDS - SHINGLE_WORDS, MIN_WORDS + GAP
#: Words that the longest equal run of a passage has at least: one with k edits shares 36 k shingles or more, and MIN_WORDS words have one edit.
RUN = MIN_WORDS // 2
#: Words by which two such passages of STEP shingles and more may differ in length between their ends.
DRIFT = 3
#: The least shared shingles of a passage, or of the part of STEP + 1 shingles of a longer one that has the most.
LEAST = int(SIMILARITY * (STEP + 1))
#: Windows are over runs of fewer words than the shingles that similarity counts, so that an edit hits fewer of them.
KEY_WORDS = 4
#: Such runs in a passage of MIN_WORDS words; a window's place takes 6 bits each for what lies before and behind it.
WIDTH = MIN_WORDS - KEY_WORDS + 1
#: In so many parts, by text, pairs are verified and the ends of passages looked for, one after the other, as their shuffles take more disk than any other.
PARTS = 2
_SEEDS = mix64(np.arange(11, 11 + 8, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def lowest(v: np.ndarray, left: np.ndarray, right: np.ndarray, least: int) -> np.ndarray:
    """Places of all values that are the minimum of `least` in a row within some v[left:right]; others may be among them."""

    def slide(x: np.ndarray, pick: np.ufunc) -> np.ndarray:
        width = 1
        while width < least:
            step = min(width, least - width)
            x, width = pick(x[:-step], x[step:]), width + step
        return x

    low = slide(v, np.minimum)
    inside = np.zeros(len(v) + 1, np.int64)
    np.add.at(inside, left, 1)
    np.add.at(inside, right - least + 1, -1)
    low = np.where(np.cumsum(inside)[: len(low)] > 0, low, v.min())
    return np.flatnonzero(slide(np.pad(low, least - 1, constant_values=v.min()), np.maximum) == v)


def compact_windows(v: np.ndarray, left: np.ndarray, right: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the Cartesian trees of v[left:right], many at once: every run within [l, r) that holds c has its first minimum at c.

    Only windows of `least` values or more, so the trees are built over the values of lowest() alone: all minima of a
    segment so wide are among them. The trees grow by level; equal minima of a segment are parted in one level, so that
    periodic text makes no deep tree.
    """
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
    wide = right - left >= least
    left, right = left[wide], right[wide]
    pos = lowest(v, left, right, least) if len(left) else left
    low = v[pos]
    a, z = np.searchsorted(pos, left), np.searchsorted(pos, right)  # the segments' places among pos
    while len(left):
        size = z - a
        offs = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(a - offs, size)
        x = low[at]
        hit = np.flatnonzero(x == np.repeat(np.minimum.reduceat(x, offs), size))
        seg = np.searchsorted(offs, hit, "right") - 1
        k, new = at[hit], np.diff(seg, prepend=-1) > 0
        c = pos[k]
        l, r = np.where(new, left[seg], np.r_[0, c[:-1] + 1]), right[seg]
        wide = r - l >= least
        out.append((l[wide], c[wide], r[wide]))
        last = np.r_[new[1:], True]
        a, z = np.r_[np.where(new, a[seg], np.r_[0, k[:-1] + 1]), k[last] + 1], np.r_[k, z[seg[last]]]
        left, right = np.r_[l, c[last] + 1], np.r_[c, r[last]]
        wide = right - left >= least
        left, right, a, z = left[wide], right[wide], a[wide], z[wide]
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def window_keys(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, at) of all compact windows of texts whose word hashes stand one after the other, MIN_WORDS or more each.

    key is the window's least hash of KEY_WORDS words, other for each of the FUNCTIONS. at packs the run's place, the function, and
    the places where passages of WIDTH runs begin that have this minimum: places < 2**30.
    """
    base = np.cumsum(sizes) - sizes
    s = shingles_of(h, KEY_WORDS)  # runs over the end of a text lie outside all windows
    out = []
    for f in range(FUNCTIONS):
        v = mix64(s ^ _SEEDS[f])
        l, c, r = compact_windows(v, base, base + sizes - KEY_WORDS + 1, WIDTH)
        start, stop = np.maximum(l, c - WIDTH + 1), np.minimum(c, r - WIDTH)
        text = np.searchsorted(base, c, "right") - 1
        out.append((text, v[c], (c - base[text]) << 14 | f << 12 | (c - start) << 6 | stop - start))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text, with id, d and its number of words; and one for each window, with key."""
    for b in pieces(batches, "text", 1 << 20):
        h, sizes = word_hashes([plain(t.as_py()) for t in b.column("text")])
        wide = sizes >= MIN_WORDS
        rows = np.flatnonzero(wide)
        if not len(rows):
            continue
        text, key, at = window_keys(h[np.repeat(wide, sizes)], sizes[rows])
        none, rid = len(key), b.column("rid").take(pa.array(rows))
        put = lambda name, more: pa.concat_arrays([b.column(name).take(pa.array(rows)), more])
        yield pa.RecordBatch.from_arrays([
            put("rid", rid.take(pa.array(text))), put("id", pa.nulls(none, pa.int64())), put("d", pa.nulls(none, pa.binary())),
            pa.concat_arrays([pa.nulls(len(rows), pa.int64()), pa.array(key.view(np.int64))]), pa.array(np.r_[sizes[rows], at]),
        ], names=["rid", "id", "d", "key", "at"])


def _plain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as their words, one a line, so that all pairs of a text share one tokenisation."""
    for b in pieces(batches, "text"):
        yield pa.RecordBatch.from_arrays([b.column("tid"), pa.array([plain(t.as_py()) for t in b.column("text")], pa.string())], names=["tid", "text"])


def cells(text: np.ndarray, key: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, key, c, c2, owner, more) for each two functions: the interval join of their windows, text by text.

    A cell is a set of passages of WIDTH runs that have both windows' minima, at c and c2; its key names
    the two. more[owner == i] are the keys of the other functions' windows that meet cell i.
    """
    c, f = at >> 14, at >> 12 & 3
    span = int(c.max()) + 2 if len(c) else 1
    first = text * span + c - (at >> 6 & 63)
    last = first + (at & 63)
    parts = np.unique(np.r_[first, last + 1])  # between two of these places no window begins or ends
    cover = []
    for i in range(FUNCTIONS):
        own = np.flatnonzero(f == i)
        own = own[np.argsort(first[own])]
        k = np.searchsorted(first[own], parts, "right") - 1
        inside = k >= 0
        inside[inside] = last[own[k[inside]]] >= parts[inside]
        cover.append(np.where(inside, own[k] if len(own) else -1, -1))
    for i, j in combinations(range(FUNCTIONS), 2):
        both = np.flatnonzero((cover[i] >= 0) & (cover[j] >= 0))
        a, b = cover[i][both], cover[j][both]
        new = (np.diff(a, prepend=-1) != 0) | (np.diff(b, prepend=-1) != 0)
        cell, x, y = np.cumsum(new) - 1, a[new], b[new]
        met = [(cell[w >= 0], key[w[w >= 0]]) for k in range(FUNCTIONS) if k not in (i, j) for w in [cover[k][both]]]
        owner, more = (np.concatenate(m) for m in zip(*met, strict=True))
        order = np.lexsort((more, owner))
        owner, more = owner[order], more[order]
        fresh = (np.diff(owner, prepend=-1) != 0) | np.r_[True, more[1:] != more[:-1]][: len(more)]
        yield text[x], mix64(key[x] * np.uint64(BASE) + key[y]), c[x], c[y], owner[fresh], more[fresh]


def least_places(text: np.ndarray, key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of each text and key: with the least place."""
    order = np.lexsort((at, key, text))
    out = np.zeros(len(order), bool)
    out[order] = (np.diff(text[order], prepend=-1) != 0) | np.r_[True, np.diff(key[order]) != 0][: len(order)]
    return out


def _cell_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        w = b.column("w")
        flat = w.flatten()
        if not len(flat):
            continue
        text = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(w.offsets)))
        for t, key, c, c2, *_ in cells(text, np.asarray(flat.field("key")).view(np.uint64), np.asarray(flat.field("at"))):
            at = c << 32 | c2
            yield pa.RecordBatch.from_arrays([b.column("tid").take(pa.array(t)), pa.array(key.view(np.int64)), pa.array(at), pa.array(least_places(t, key, at))], names=["tid", "key", "at", "first"])


Sorted = tuple[np.ndarray, np.ndarray, np.ndarray]
#: Diagonals that are compared one by one; of more, all equal shingles are listed.
FEW = 16


def in_order(words: np.ndarray) -> Sorted:
    """A text's shingles, the order that sorts them, and the sorted ones."""
    s = shingles_of(words)
    order = np.argsort(s, kind="stable")
    return s, order, s[order]


def _meetings(a: np.ndarray, at: np.ndarray, lo: np.ndarray, other: Sorted) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, i - j) of all places i among `at` and j of equal shingles, in parts of bounded size that have all of an i.

    lo: for all places of a the first equal shingle in the other text's sorted ones.
    """
    _, order, ranked = other
    lo = lo[at]
    n = np.searchsorted(ranked, a[at], "right") - lo
    part = np.cumsum(n) >> 20
    for k in np.unique(part):
        own = part == k
        m = n[own]
        i = np.repeat(at[own], m)
        yield i, i - order[np.arange(len(i)) + np.repeat(lo[own] - (np.cumsum(m) - m), m)]


def equal_runs(a: np.ndarray, other: Sorted, shifts: np.ndarray, same: bool, enough: float = 1) -> list[tuple[int, int, int]]:
    """(start, end, shift) in a, by start, of the longest stretches of a shingle or more that the other text has too, at i - shift.

    Given are the shingles of a and sorted shifts. Those within GAP of them count too, for shingles that no given shift explains:
    a word more or less in the middle of a passage moves what follows. Where a is the other text, only shifts above 0.
    Texts with fewer than `enough` equal shingles have none. In a text full of repeats of its own, each place is held against the one
    before it with the same shingle and against the FEW least shifts, as the passage nearest before it is source enough.
    """
    if same:
        shifts = shifts[shifts > 0]
    lo = np.searchsorted(other[2], a, "left")
    met = other[2][np.minimum(lo, len(other[2]) - 1)] == a if len(other[2]) else np.zeros(len(a), bool)
    if not len(shifts) or met.sum() < enough:
        return []
    told, out = np.zeros(len(a), bool), [np.zeros((0, 3), np.int64)]

    def put(i: np.ndarray, d: np.ndarray) -> None:
        if not len(i):
            return
        by = np.lexsort((i, d))
        i, d = i[by], d[by]
        new = np.ones(len(i) + 1, bool)
        new[1:-1] = (d[1:] != d[:-1]) | (i[1:] - i[:-1] != 1)
        out.append(np.stack([i[new[:-1]], i[new[1:]] + 1, d[new[:-1]]], 1))

    if same and len(shifts) > FEW:  # a text full of repeats: each place and the one before it with the same shingle
        order, ranked = other[1:]
        k = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
        i, d = order[k], order[k] - order[k - 1]
        told[i] = True
        put(i, d)
        shifts = shifts[:FEW]
    if len(shifts) <= FEW:
        for d in shifts.tolist():
            x, y = max(0, d), min(len(a), len(other[0]) + d)
            if y <= x:
                continue
            eq = np.zeros(y - x + 2, bool)
            np.equal(a[x:y], other[0][x - d : y - d], out=eq[1:-1])
            told[x:y] |= eq[1:-1]
            ends = np.flatnonzero(eq[1:] != eq[:-1])
            run = np.full((len(ends) // 2, 3), d, np.int64)
            run[:, :2] = ends.reshape(-1, 2) + x
            out.append(run)
    else:
        for i, d in _meetings(a, np.flatnonzero(met), lo, other):
            at = np.searchsorted(shifts, d)
            good = shifts[np.minimum(at, len(shifts) - 1)] == d
            told[i[good]] = True
            put(i[good], d[good])
    rest = np.flatnonzero(met & ~told)
    for i, d in _meetings(a, rest, lo, other) if len(rest) else ():
        at = np.searchsorted(shifts, d)
        far = np.minimum(np.abs(d - shifts[np.minimum(at, len(shifts) - 1)]), np.abs(d - shifts[np.maximum(at - 1, 0)]))
        good = (far <= GAP) & ((d > 0) | (not same))
        put(i[good], d[good])
    runs = np.concatenate(out)
    runs = np.unique(runs, axis=0) if same else runs
    if len(runs) > 1:  # stretches that the parts cut
        runs = runs[np.lexsort((runs[:, 0], runs[:, 2]))]
        new = np.ones(len(runs) + 1, bool)
        new[1:-1] = (runs[1:, 2] != runs[:-1, 2]) | (runs[1:, 0] != runs[:-1, 1])
        runs = np.stack([runs[new[:-1], 0], runs[new[1:], 1], runs[new[:-1], 2]], 1)
    return sorted((x, y + SHINGLE_WORDS - 1, d) for x, y, d in runs.tolist())


def hopes(runs: list[tuple[int, int, int]], size: int, width: int, similar: float) -> tuple[list[bool], list[float], list[float]]:
    """Of each run: whether so many shingles behind its start lie in runs that a passage of `width` shingles or more may begin there;
    the shingles in runs before its start, less `similar` of all before it; and the most of that at its end or behind.

    A passage that begins with one run can only end with or behind another whose third value is not under the first's second.
    """
    start, end, _ = np.array(runs, np.int64).reshape(-1, 3).T
    gain = np.bincount(start, minlength=size + 1) - np.bincount(end - SHINGLE_WORDS + 1, minlength=size + 1)
    over = -similar * np.arange(size + 1)
    over[1:] += np.cumsum(np.cumsum(gain)[:-1] > 0)
    best = np.maximum.accumulate(over[::-1])[::-1] + 1e-9
    may = (start + width <= size) & (best[np.minimum(start + width, size)] >= over[start])
    return may.tolist(), over[start].tolist(), best[end - SHINGLE_WORDS + 1].tolist()


def passages(a: np.ndarray, other: Sorted, shifts: np.ndarray, same: bool = False, least: int = MIN_WORDS, similar: float = SIMILARITY) -> list[tuple[int, int, int, int]]:
    """(start, end, other start, other end) of passages that are alike in two texts; a: shingles of the first.

    Equal stretches on the diagonals `shifts` (sorted), and on those near them (equal_runs), are chained in order, over gaps of GAP words at most on
    either side. A chain counts if it spans `least` words in both texts and its shared shingles are at
    least `similar` of all shingles of both spans. Where a is the other text, a passage may overlap its source, as in
    periodic text: cutting it leaves the first period.
    """
    few = similar / (1 + similar) * 2 * (least - SHINGLE_WORDS + 1)  # that even the shortest passage shares
    runs = equal_runs(a, other, shifts, same, few - 1e-9)
    out: list[tuple[int, int, int, int]] = []
    if not runs:
        return out
    done, (hopeful, before, ahead) = 0, hopes(runs, len(a), least - SHINGLE_WORDS + 1, similar)
    for i, (start, end, shift) in enumerate(runs):
        if end <= done or not hopeful[i]:
            continue
        last_end, last_shift, shared, best = end, shift, end - start - SHINGLE_WORDS + 1, None
        for j in range(i, len(runs)):
            s, e, k = runs[j]
            if j > i:
                if s - last_end > GAP:
                    break
                here = last_end if k <= last_shift else last_end - last_shift + k
                if s < here:
                    s = here
                if e - s < SHINGLE_WORDS or s - k - (last_end - last_shift) > GAP:
                    continue
                shared += e - s - SHINGLE_WORDS + 1 + (SHINGLE_WORDS - 1 if k == last_shift and s == last_end else 0)
                last_end, last_shift = e, k
            if ahead[j] < before[i]:
                break
            n, m = last_end - start, last_end - last_shift - (start - shift)
            if n >= least and m >= least and shared >= similar * (n + m - 2 * (SHINGLE_WORDS - 1) - shared):
                best = (start, last_end, start - shift, last_end - last_shift)
        if best:
            out.append(best)
            done = best[1]
    return out


_FOUND = "d long, start int, end int, e long, o_start int, o_end int, key long"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of each pair, with a null key; and the keys of its cells that lie in none, with all else null."""
    hub: tuple[int, Sorted] | None = None
    for b in pieces(batches, "text"):
        cells_, shifts = b.column("cells"), b.column("shifts")
        offsets, spread = ((np.asarray(x.offsets) - x.offsets[0].as_py()) // n for x, n in ((cells_, 2), (shifts, 1)))
        key, at = np.asarray(cells_.flatten()).reshape(-1, 2).T
        c, c2, shift = at >> 32, at & 0xFFFFFFFF, np.asarray(shifts.flatten(), np.int64)
        h, sizes = word_hashes([t.as_py() if d != e else "" for t, d, e in zip(b.column("text"), b.column("d").to_pylist(), b.column("e").to_pylist(), strict=True)])
        ends, pair, spans, opened = np.cumsum(sizes), [], [], [np.zeros(0, np.int64)]
        for i, (d, e) in enumerate(zip(b.column("d").to_pylist(), b.column("e").to_pylist(), strict=True)):
            if hub is None or hub[0] != e:
                hub = (e, in_order(word_hashes([b.column("other")[i].as_py()])[0]))
            a = hub[1][0] if d == e else shingles_of(h[ends[i] - sizes[i] : ends[i]])
            own = slice(offsets[i], offsets[i + 1])
            x, y = c[own], c2[own]
            open_ = np.ones(len(x), bool)
            for p in passages(a, hub[1], np.sort(shift[spread[i] : spread[i + 1]]), d == e):
                pair.append((d, e))
                spans.append(p)
                open_ &= (np.minimum(x, y) < p[0]) | (np.maximum(x, y) + KEY_WORDS > p[1])
            opened.append(key[own][open_])
        keys, n = np.unique(np.concatenate(opened)), len(pair)
        ids, place = np.array(pair, np.int64).reshape(-1, 2).T, np.array(spans, np.int32).reshape(-1, 4).T
        cols = [pa.concat_arrays([pa.array(x), pa.nulls(len(keys), pa.array(x).type)]) for x in (ids[0], *place[:2], ids[1], *place[2:])]
        yield pa.RecordBatch.from_arrays([*cols, pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(keys, pa.int64())])], names=["d", "start", "end", "e", "o_start", "o_end", "key"])


def first_holders(rows: DataFrame) -> DataFrame:
    """(key, e, n, place) of the keys that several rows have; e is the first text of them, place the first in it: that of its row with `first`."""
    place = F.min_by("at", F.when(F.col("first"), F.col("tid"))).alias("place")
    return cut(rows.groupBy("key").agg(F.min("tid").alias("e"), F.count("*").alias("n"), place).where("n > 1"))


def hub_pairs(far: DataFrame) -> DataFrame:
    """(d, e, shifts, cells): texts d paired with texts e that have a key of theirs at `place`; a text with itself for its other places.

    shifts: how far the places lie apart. cells: key and place in d, one after the other, where more than two rows have the key.
    """
    high, low = (lambda c: F.shiftright(c, 32)), (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    far = far.where((F.col("tid") != F.col("e")) | ((high("at") != high("place")) & (low("at") != low("place"))))
    apart = [F.collect_set((x("at") - x("place")).cast("int")) for x in (high, low)]
    cells_ = F.flatten(F.collect_list(F.when(F.col("n") > 2, F.array("key", "at"))))
    return cut(far.groupBy(F.col("tid").alias("d"), "e").agg(F.array_union(*apart).alias("shifts"), cells_.alias("cells")))


def part(df: DataFrame, by: str, i: int) -> DataFrame:
    """The rows of the i-th of PARTS parts of the texts in column `by`."""
    return df.where(F.pmod(F.xxhash64(by), F.lit(PARTS)) == i)


def verified(pairs: DataFrame, texts: DataFrame) -> list[DataFrame]:
    """Passages of all pairs and the keys that lie in none, in PARTS tables by text e; see _verify. texts are plain()."""
    first, second = texts.withColumnRenamed("tid", "d"), texts.select(F.col("tid").alias("e"), F.col("text").alias("other"))
    parts = []
    for i in range(PARTS):  # of the pairs' texts, that of d goes through two shuffles
        both = part(pairs, "e", i).join(first, "d").join(part(second, "e", i), "e")
        with arrow_rows(texts.sparkSession, 500):
            parts.append(cut(both.select("d", "e", "text", "other", "shifts", "cells").mapInArrow(_verify, _FOUND)))
    return parts


def with_new_shifts(more: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of `more` with a diagonal that the same pair of `pairs` lacks, with the diagonals of both."""
    new = more.join(pairs.select("d", "e", F.col("shifts").alias("had")), ["d", "e"], "left").withColumn("had", F.coalesce("had", F.slice("shifts", 1, 0)))
    new = new.where(F.size(F.array_except("shifts", "had")) > 0)
    return new.select("d", "e", F.array_union("shifts", "had").alias("shifts"), F.slice("cells", 1, 0).alias("cells"))


def near_rows(h: np.ndarray, sizes: np.ndarray, text: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, at) of the shingles and runs of RUN words that a passage over one of the given places of texts may have; at: place and kind (1: run).

    The word hashes of the texts stand one after the other, as in window_keys.
    """
    ends = np.cumsum(sizes)
    base = ends - sizes
    c, near = places + base[text], np.zeros(len(h) + 1, np.int64)
    np.add.at(near, np.maximum(c - REACH, base[text]), 1)
    np.add.at(near, np.minimum(c + REACH, ends[text]), -1)
    i = np.flatnonzero(np.cumsum(near)[:-1])
    own = np.searchsorted(ends, i, "right")
    short, long = i + SHINGLE_WORDS <= ends[own], i + RUN <= ends[own]
    x, y = i[short], i[long]
    keys = [shingles_of(h)[x], run_hashes(h, y, y + RUN)]
    at = [(i - base[own])[short] << 1, (i - base[own])[long] << 1 | 1]
    return np.r_[own[short], own[long]], np.concatenate(keys), np.concatenate(at)


def _near_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, "text", 1 << 20):
        h, sizes = word_hashes([t.as_py() for t in b.column("text")])
        places = b.column("places")
        text, key, at = near_rows(h, sizes, np.repeat(np.arange(b.num_rows), np.diff(np.asarray(places.offsets))), np.asarray(places.flatten()).astype(np.int64))
        yield pa.RecordBatch.from_arrays([b.column("tid").take(pa.array(text)), pa.array(key.view(np.int64)), pa.array(at)], names=["tid", "key", "at"])


def stretches(spot: np.ndarray, key: np.ndarray, here: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first key) of stretches of sorted places whose keys have all their places in common: `here` names a key's places, `behind` the next ones."""
    new = np.flatnonzero(np.r_[True, (np.diff(spot) != 1) | (here[1:] != behind[:-1])][: len(spot)])
    return spot[new], spot[np.r_[new[1:], len(spot)][: len(new)] - 1], key[new]


def ends_of(text: np.ndarray, key: np.ndarray, at: np.ndarray, here: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, key, a, b, first, last) of all two stretches, from a and b on, in which a passage may begin and end, one with a run of RUN words; key names the two.

    Given are the rows of _near_rows whose keys other places have. Such passages lie from first to last, their end shingles STEP to STEP + DRIFT apart.
    """
    span = (int(at.max(initial=0)) >> 1) + REACH + RUN
    spot, kind = text * span + (at >> 1), at & 1
    order = np.argsort(spot)
    x, y = (tuple(v[order[kind[order] == k]] for v in (spot, key, here, behind)) for k in (0, 1))
    short, long, inner, out = stretches(*x), stretches(*y), RUN - SHINGLE_WORDS, []
    for (start, end, name), (start2, end2, name2), less in ((long, short, 0), (short, long, inner)):
        near, far = STEP - less, STEP + DRIFT - less
        lo, hi = np.searchsorted(end2, start + near), np.searchsorted(start2, end + far, "right")
        n = np.maximum(hi - lo, 0)
        a = np.repeat(np.arange(len(start)), n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        first, last = np.maximum(start[a], start2[b] - far), np.minimum(end2[b], end[a] + far) + less
        some = np.searchsorted(x[0], last, "right") - np.searchsorted(x[0], first) >= LEAST
        a, b, first, last = a[some], b[some], first[some], last[some]
        t = start[a] // span
        out.append((t, mix64(name[a] * np.uint64(BASE) + name2[b]), *(v - t * span for v in (start[a], start2[b], first, last))))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def covered(text: np.ndarray, first: np.ndarray, last: np.ndarray, by: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether text[first:last] lies in one of the spans (text, start, end) of `by`."""
    span = max(int(x.max(initial=0)) for x in (first, last, *by[1:])) + 1
    start = by[0] * span + by[1]
    order = np.argsort(start)
    reach = np.maximum.accumulate(np.r_[-1, (by[0] * span + by[2])[order]])  # of spans that begin there or before
    return reach[np.searchsorted(start[order], text * span + first, "right")] >= text * span + last


def _end_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ends_of that lie in no span of their text; of the others the first of each key in a batch, as it may be the key's first holder."""
    for b in batches:
        s, spans = b.column("s"), b.column("spans")
        flat, found = s.flatten(), spans.flatten()
        if not len(flat):
            continue
        text, own = (np.repeat(np.arange(b.num_rows), np.asarray(pc.fill_null(pc.list_value_length(x), 0))) for x in (s, spans))
        t, key, i, j, first, last = ends_of(text, np.asarray(flat.field("key")).view(np.uint64), *(np.asarray(flat.field(c)) for c in ("at", "here", "behind")))
        at, tid = i << 32 | j, np.asarray(b.column("tid"))[t]
        inside = covered(t, first, last + SHINGLE_WORDS, (own, *(np.asarray(found.field(c)).astype(np.int64) for c in ("start", "end"))))
        order = np.lexsort((at, tid, key, ~inside))[: inside.sum()]
        rows = np.r_[np.flatnonzero(~inside), order[np.r_[True, np.diff(key[order]) != 0][: len(order)]]]
        first = least_places(t[rows], key[rows], at[rows])
        yield pa.RecordBatch.from_arrays([*(pa.array(x[rows]) for x in (tid, key.view(np.int64), at, ~inside)), pa.array(first)], names=["tid", "key", "at", "open", "first"])


def near_open(rows: DataFrame, hubs: DataFrame, opened: DataFrame, texts: DataFrame) -> DataFrame:
    """_near_rows around all rows of a key that an open cell and more than two rows have."""
    many = cut(opened.distinct().join(hubs.where("n > 2").select("key"), "key", "left_semi"))
    places = rows.join(many.hint("shuffle_hash"), "key").groupBy("tid").agg(F.collect_set(F.shiftright("at", 32)).alias("places"))
    near = cut(places.join(texts, "tid").mapInArrow(_near_rows, "tid long, key long, at long"))
    drop_cut(many)
    return near


def passage_ends(near: DataFrame, found: DataFrame) -> list[DataFrame]:
    """(tid, key, at, open, first) in PARTS tables: where passages may begin and end among the rows of near_open; open: they lie in no passage found of their text.

    Whatever is alike shares the two ends and a run of RUN words at one of them, so texts of one such key have all pairs that can be missing.
    Of ends that are not open only those are kept that can be the first holders of a key.
    """
    named = [F.bit_xor(F.xxhash64("tid", F.col("at") + more)).alias(c) for c, more in (("here", 0), ("behind", 2))]
    shared = cut(near.groupBy("key").agg(F.count("*").alias("n"), *named).where("n > 1").drop("n"))
    spans = found.where("key is null").groupBy(F.col("d").alias("tid"), "start").agg(F.max("end").alias("end"))
    spans = cut(spans.groupBy("tid").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    parts = []
    for i in range(PARTS):  # the shuffle files of one part are gone before those of the next
        by_text = part(near, "tid", i).join(shared.hint("shuffle_hash"), "key").groupBy("tid").agg(F.collect_list(F.struct("key", "at", "here", "behind")).alias("s"))
        with arrow_rows(near.sparkSession, 1000):
            parts.append(cut(by_text.join(spans.hint("shuffle_hash"), "tid", "left").select("tid", "s", "spans").mapInArrow(_end_rows, "tid long, key long, at long, open boolean, first boolean")))
    drop_cut(spans)
    drop_cut(shared)
    return parts


def merged(spans: DataFrame, by: str) -> DataFrame:
    """Spans of one `by` that touch or overlap become one, with the least source of any.

    Equal spans, of which a source of many copies has many, are one before the spans of a text meet.
    """
    spans = spans.groupBy(by, "start", "end").agg(F.min("source").alias("source"))
    cat = F.array_sort(F.collect_list(F.struct("start", "end", "source")))
    zero = F.expr("cast(array() as array<struct<start:int,end:int,source:bigint>>)")

    def add(s, x):
        last = F.try_element_at(s, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), F.least(last["source"], x["source"]).alias("source"))
        return F.when((F.size(s) > 0) & (x["start"] <= last["end"]), F.concat(F.slice(s, 1, F.size(s) - 1), F.array(joined))).otherwise(F.concat(s, F.array(x)))

    return spans.groupBy(by).agg(cat.alias("s")).select(by, F.aggregate("s", zero, add).alias("s"))


def text_key(text: str | Column) -> Column:
    """128 bits of a text that tell it from all others."""
    return F.unhex(F.md5(F.col(text) if isinstance(text, str) else text))


def row_key(doc_id: str) -> Column:
    """A row's whole-number id; null comes last."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(2**63 - 1))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, d, role, start_word, end_word, source_doc_id): passages that repeat; d is text_key of the text.

    A passage has MIN_WORDS lower-cased words or more, begins and ends with a shared shingle of five words, and its shingles are
    SIMILARITY or more like an earlier one's, in another document or before it in its own. Earlier: smaller doc_id (a whole number; null last), then
    smaller d, then place. role `later`: a passage whose source comes earlier, so it can go;
    role `first`: the source. Passages of one role in one document that touch are one row. All rows of
    equal texts but one are `later` as a whole. Shorter and null texts have no rows; an empty table gives none. Other
    columns are ignored.

    Cartesian trees of all whole texts give compact windows for FUNCTIONS hash functions. Of those whose minimum
    another window has too, an interval join in each text finds its cells: passages with the minima of two functions.
    All cells of one key are paired with the first only, so a group of g gives g pairs; the pair's
    cells are verified together. Where a key has a cell that this leaves unexplained, as texts may share
    more with each other than with the first, its texts are paired once more with the first
    that shares both ends of a passage there (passage_ends), where no passage covers these yet. A pair that this gives new diagonals is verified again, with all its seeds. Copies of a text share its work.
    """
    src = docs.select(row_key(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null").withColumn("d", text_key("text"))
    every = cut(src.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(_window_rows, "rid long, id long, d binary, key long, at long"))
    heads, windows = cut(every.where("key is null").select("rid", "id", "d", F.col("at").cast("int").alias("size"))), every.where("key is not null").select("rid", "key", "at")
    owners = heads.groupBy("d").agg(F.min(F.struct("id", "rid")).alias("o"), F.count("*").alias("n"), F.first("size").alias("size"))
    owners = owners.select("d", "o.rid", F.col("o.id").alias("first_id"), "n", "size").orderBy("first_id", "d")
    owners = cut(owners.withColumn("tid", F.monotonically_increasing_id()))  # numbers that rise in the order of texts
    shared = cut(windows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    by_text = windows.join(shared.hint("shuffle_hash"), "key").groupBy("rid").agg(F.collect_list(F.struct("key", "at")).alias("w"))
    made = by_text.join(owners.select("rid", "tid"), "rid").select("tid", "w")
    with arrow_rows(docs.sparkSession, 1000):  # rows hold all windows of a text
        rows = cut(made.mapInArrow(_cell_rows, "tid long, key long, at long, first boolean"))
    drop_cut(every)
    drop_cut(shared)
    hubs = first_holders(rows)
    pairs = hub_pairs(rows.select("tid", "key", "at").join(hubs.hint("shuffle_hash"), "key"))
    used = cut(owners.join(pairs.select(F.explode(F.array("d", "e")).alias("tid")).distinct(), "tid", "left_semi").select("tid", F.col("first_id").alias("id"), "d"))
    with arrow_rows(docs.sparkSession, 1000):
        own = src.join(used, ["id", "d"]).groupBy("id", "d").agg(F.first("tid").alias("tid"), F.first("text").alias("text"))  # by the keys of the join
        texts = cut(own.select("tid", "text").mapInArrow(_plain_rows, "tid long, text string"))
    got = reduce(DataFrame.union, verified(pairs, texts))
    near = near_open(rows, hubs, got.where("key is not null").select("key"), texts)
    for done in (rows, hubs, used):
        drop_cut(done)
    parts = passage_ends(near, got)
    drop_cut(near)
    ends = reduce(DataFrame.union, parts)
    firsts = first_holders(ends)
    again = hub_pairs(ends.where("open").select("tid", "key", "at").join(firsts.hint("shuffle_hash"), "key"))
    more = cut(with_new_shifts(again, pairs))
    for done in (pairs, *parts, firsts, again):
        drop_cut(done)
    few = cut(texts.join(more.select(F.explode(F.array("d", "e")).alias("tid")).distinct(), "tid", "left_semi"))
    drop_cut(texts)
    found = reduce(DataFrame.union, verified(more, few), got).where("key is null").drop("key")
    for done in (more, few):
        drop_cut(done)

    by_source = found.join(owners.select(F.col("tid").alias("e"), F.col("first_id").alias("source")), "e")
    later = merged(by_source.select(F.col("d").alias("tid"), "start", "end", "source"), "tid").select("tid", F.lit("later").alias("role"), F.explode("s").alias("x"))
    first = merged(by_source.select(F.col("e").alias("tid"), F.col("o_start").alias("start"), F.col("o_end").alias("end"), "source"), "tid").select("tid", F.lit("first").alias("role"), F.explode("s").alias("x"))
    spans = later.union(first).select("tid", "role", F.col("x.start").alias("start_word"), F.col("x.end").alias("end_word"), F.col("x.source").alias("source"))
    single = owners.select("tid", "d", F.col("first_id").alias("id")).join(spans, "tid").select("id", "d", "role", "start_word", "end_word", "source")
    copies = owners.where("n > 1").select("d", "first_id", "size")
    whole = heads.select("id", "d").join(copies, "d").select("id", "d", F.when(F.col("id") == F.col("first_id"), "first").otherwise("later").alias("role"), F.lit(0).alias("start_word"), F.col("size").alias("end_word"), F.col("first_id").alias("source"))
    out = single.union(whole).distinct()
    null_last = lambda c: F.when(F.col(c) < 2**63 - 1, F.col(c))
    return out.select(null_last("id").alias("doc_id"), "d", "role", "start_word", "end_word", null_last("source").alias("source_doc_id"))


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of the spans, which may overlap, and what stands between them."""
    at = word_spans(text)
    out, last = [], 0
    for start, end in sorted(spans):
        out.append(text[last : max(last, at[start][0])])
        last = max(last, at[end - 1][1])
    return "".join([*out, text[last:]])


def _remove(schema: T.StructType, text: str):
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = [], []
            for t, spans in zip(b.column(text).to_pylist(), b.column("__spans").to_pylist(), strict=True):
                cut_text = without_spans(t, [(s["start_word"], s["end_word"]) for s in spans]) if spans else t
                texts.append(cut_text)
                keep.append(not spans or len(word_spans(cut_text)) > 0)
            cols = [pa.array(texts, pa.string()) if n == text else b.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep))

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chars: str = "n_chars") -> DataFrame:
    """docs without their `later` passages; rows that have no word left go. A column `chars` gets the length of the text.

    Of wholly repeated rows (one id and text) all stay or lose the same, so remove such rows first.
    """
    r = repeats(docs, doc_id, text).where("role = 'later'")
    spans = cut(r.groupBy(row_key("doc_id").alias("__id"), F.col("d").alias("__d")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("__spans")))
    same = (row_key(doc_id) == F.col("__id")) & (text_key(text) == F.col("__d"))
    cut_docs = docs.join(spans, same, "left").drop("__id", "__d").mapInArrow(_remove(docs.schema, text), docs.schema)
    if chars not in docs.columns:
        return cut_docs
    return cut_docs.withColumn(chars, F.length(text).cast(docs.schema[chars].dataType)).select(*docs.columns)
