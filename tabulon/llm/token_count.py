"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
_PIECE = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
NORMAL, USER_DEFINED, UNUSED = 1, 4, 5
CACHE = 500_000


class Merges:
    """Counts tokens of a sentence-piece BPE vocabulary file without forming identifiers.

    The model must have no normalisation rules, a dummy prefix, kept white space and byte fallback;
    anything else raises ValueError. Special pieces are never matched inside texts.
    """

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n, t = m.normalizer_spec, m.trainer_spec
        if t.model_type != 2 or not t.byte_fallback or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or any(p.type == USER_DEFINED for p in m.pieces):
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no normalisation are read")
        self.rank = {p.piece: -p.score for p in m.pieces if p.type in (NORMAL, UNUSED)}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.rank):
            raise ValueError("a piece holds white space after another character")
        self.cache = Counts(self)

    def merged(self, word: str) -> int:
        """Initial symbols (a character, or its bytes where it is no piece) less the merges."""
        rank, n = self.rank, len(word)
        count = sum(1 if c in rank else len(c.encode()) for c in word)
        part: list[str | None] = list(word)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            r = rank.get(word[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 1, 2))
        heapq.heapify(heap)
        while heap:
            _, i, j, size = heapq.heappop(heap)
            a, b = part[i], part[j]
            if a is None or b is None or after[i] != j or len(a) + len(b) != size:
                continue  # one of the two has been merged since
            part[i], part[j] = a + b, None
            count -= 1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y >= 0:
                    s = part[x] + part[y]
                    r = rank.get(s)
                    if r is not None:
                        heapq.heappush(heap, (r, x, y, len(s)))
        return count

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.cache.__getitem__, _PIECE.findall(SPACE + text.replace(" ", SPACE))))


class Counts(dict):
    """Word to its tokens; long words are not kept, and all are forgotten at CACHE words."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, word: str) -> int:
        n = self.merges.merged(word)
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = n
        return n


_loaded: dict[str, Merges] = {}


def merges(path: str) -> Merges:
    if path not in _loaded:
        _loaded[path] = Merges(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, model: str, text: str = "text", limit: int = 4096) -> DataFrame:
    """All rows and columns of docs plus n_bytes, n_tokens, over_limit (n_tokens > limit).

    model: the vocabulary file, present at this path on every executor. Null and empty texts have no
    bytes and no tokens. Rows are independent: repeats and nulls in other columns do not matter. Input
    columns with the names of the results are replaced.
    """
    keep = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    schema = T.StructType([*docs.select(keep).drop(text).schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    names = [f.name for f in schema.fields[:-2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(model)
        for b in batches:
            col = b.column(text)
            n = [m.count(t.as_py()) for t in col]
            size = pc.fill_null(pc.binary_length(col), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), size, pa.array(n, pa.int64())], names=[*names, "n_bytes", "n_tokens"])

    return docs.select(keep).mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def default_model() -> str:
    import public_tokenizers

    return os.path.abspath(public_tokenizers.path("piece_bpe_32k.model"))
