"""Language identification by cross-parsing entropy over suffix automata of labelled text."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces

BLOCK = 2048
UNKNOWN = "und"


class SuffixAutomaton:
    """All substrings of a byte string; state 0 is the empty match."""

    def __init__(self, text: bytes):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            cur = len(self.next)
            self.next.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur


class CrossParser:
    """Counts greedy longest-match phrases of texts against each language's automaton, many texts at once.

    Tables hold, for state and byte, the next state and the phrases that end there (two low bits): after
    a miss the parse starts anew at the same byte; a byte that the language never has is a phrase.
    Memory: languages x 2 x training bytes x distinct bytes x 4 bytes at most.
    """

    def __init__(self, texts: dict[str, bytes]):
        self.langs = sorted(texts)
        used = sorted({c for t in texts.values() for c in t})
        self.symbol = np.zeros(256, np.int32)  # 0: a byte in no language
        self.symbol[used] = np.arange(1, len(used) + 1)
        width = len(used) + 1
        rows, self.roots, self.bits = [], [], []
        for lang in self.langs:
            a = SuffixAutomaton(texts[lang])
            n, root = len(a.next), sum(map(len, rows))
            edges = np.full((n, width), -1, np.int64)
            for s, to in enumerate(a.next):
                for c, t in to.items():
                    edges[s, self.symbol[c]] = t + root
            start = np.where(edges[0] >= 0, edges[0] * 4 + 1, root * 4 + 2)
            table = np.where(edges >= 0, edges * 4, start)
            table[0] = np.where(edges[0] >= 0, edges[0] * 4, root * 4 + 1)
            rows.append(table.astype(np.int32))
            self.roots.append(root)
            self.bits.append(math.log2(len(texts[lang]) + 1))
        self.width = width
        self.table = np.concatenate(rows).ravel() if rows else np.zeros(0, np.int32)
        self.roots = np.array(self.roots, np.int32)

    def phrases(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Phrases (span x language) of data[start:end].

        Blocks of BLOCK bytes are parsed at once, each as if a phrase began there. Where the block before ends inside a
        phrase, both parses go on together until they meet, and the difference is made good: the counts are those of the whole span.
        """
        sizes = ends - starts
        blocks = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(starts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at = starts[owner] + nth * BLOCK
        size = np.minimum(BLOCK, ends[owner] - at)
        out = np.zeros((len(starts), len(self.langs)), np.int64)
        if not len(at):
            return out
        symbols = self.symbol[data]
        began = np.repeat(self.roots[None, :], len(at), 0)
        count, end = self._blocks(symbols, at, size)
        later = np.flatnonzero(nth)
        while True:
            wanted = began.copy()
            wanted[later] = end[later - 1]
            b, lang = np.nonzero(wanted != began)
            if not len(b):
                break
            old, new, gain = began[b, lang], wanted[b, lang], np.zeros(len(b), np.int64)
            began[b, lang] = new
            place, left, live = at[b], size[b], np.arange(len(b))
            while len(live):
                x, y = (self.table[s[live] * self.width + symbols[place[live]]] for s in (old, new))
                gain[live] += (y & 3) - (x & 3)
                old[live], new[live] = x >> 2, y >> 2
                place[live] += 1
                left[live] -= 1
                over = live[left[live] == 0]
                end[b[over], lang[over]] = new[over]
                live = live[(old[live] != new[live]) & (left[live] > 0)]
            count[b, lang] += gain
        last = nth == blocks[owner] - 1
        count[last] += end[last] != self.roots
        np.add.at(out, owner, count)
        return out

    def _blocks(self, symbols: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end in each block, and the state at its end, for each language."""
        order = np.argsort(-size, kind="stable")
        at, size = at[order], size[order]
        state = np.repeat(self.roots[None, :], len(at), 0)
        count = np.zeros(state.shape, np.int64)
        live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
        for step, n in enumerate(live):
            got = self.table[state[:n] * self.width + symbols[at[:n] + step][:, None]]
            count[:n] += got & 3
            state[:n] = got >> 2
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return count[back], state[back]


_parsers: dict[str, CrossParser] = {}


def parser(texts: dict[str, bytes]) -> CrossParser:
    key = repr(sorted((k, hash(v)) for k, v in texts.items()))
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = CrossParser(texts)
    return _parsers[key]


def cleaned(col: pa.Array) -> pa.Array:
    """Lower case; each run of anything but letters and marks is one space; null is empty."""
    return pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(col, "")), r"[^\pL\pM]+", " ")


def held_out(doc_id: str | Column) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_texts(docs: DataFrame, text: str, lang: str, rows_per_lang: int, chars_per_lang: int) -> dict[str, bytes]:
    """Of each language the rows_per_lang different texts that come first by hash, those up to a sixteenth of chars_per_lang before longer ones.

    Whole texts, until they have chars_per_lang characters; only a first text that is longer by itself is cut there.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).cast("string").alias("l"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    kinds = rows.select("l", (F.length("t") > chars_per_lang // 16).alias("long"), "h").distinct()
    first = kinds.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("long", "h"))).where(F.col("n") <= rows_per_lang)
    picked = rows.join(F.broadcast(first.select("l", "h", "n")), ["l", "h"]).groupBy("l", "n").agg(F.min("t").alias("t"))  # languages x rows_per_lang
    out: dict[str, list[str]] = {}
    for r in picked.select("l", "n", F.substring("t", 1, chars_per_lang).alias("t")).orderBy("l", "n").collect():
        own = out.setdefault(r.l, [])
        if not own or sum(map(len, own)) + len(r.t) <= chars_per_lang:
            own.append(r.t)
    return {k: b"".join(x.encode() for x in cleaned(pa.array(v)).to_pylist()) for k, v in out.items()}


def identify(docs: DataFrame, labelled: DataFrame, text: str = "text", lang: str = "lang", rows_per_lang: int = 48, chars_per_lang: int = 64_000) -> DataFrame:
    """All rows and columns of docs but the text, plus lang_pred, score.

    labelled: rows with text and language to learn from; a bounded sample of each language is used (see
    training_texts). Each whole text is parsed. A language's cost is its number of
    phrases times log2 of its training size, over the text's bytes; the least wins, the first in name
    order among equals. score: 1 - least/second least cost (1 with one language). Null texts, texts without
    a letter, and all texts where nothing can be learned, get `und` and score 0. Rows are independent.
    """
    texts = training_texts(labelled, text, lang, rows_per_lang, chars_per_lang)
    names = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    schema = T.StructType([*docs.select(names).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(sent.value)
        langs = np.array([*p.langs, UNKNOWN], object)
        for b in pieces(batches, text, 2 << 20):
            col = cleaned(b.column(text))
            col = pc.utf8_trim(col, " ").cast(pa.large_string())
            offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
            data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
            size = offsets[1:] - offsets[:-1]
            pred, score = np.full(len(col), UNKNOWN, object), np.zeros(len(col))
            if p.langs:
                cost = p.phrases(data, offsets[:-1], offsets[1:]) * np.array(p.bits) / np.maximum(size, 1)[:, None]
                ranked = np.sort(cost, 1)
                ok = (size > 0) & pc.match_substring_regex(col, r"\pL").to_numpy(zero_copy_only=False)
                pred[ok] = langs[np.argmin(cost, 1)[ok]]
                score[ok] = 1 - ranked[ok, 0] / ranked[ok, 1] if len(p.langs) > 1 else 1.0
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(pred, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return docs.select(*names, text).mapInArrow(run, schema)
