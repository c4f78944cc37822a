"""Near duplicates, repeated passages, embeddings and components against brute force."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulon.llm import common
from tabulon.llm import embedding_dedup as emb
from tabulon.llm import near_dedup as near
from tabulon.llm import substring_dedup as sub
from tabulon.llm.common import HUGE, components, hashes_of, plain, run_hashes, shingles_of, word_hashes, word_spans, words_of


def words(rnd, n, names="abcdefghij"):
    return [rnd.choice(names) + rnd.choice("xyzuvw") + str(rnd.randrange(60)) for _ in range(n)]


def edited(rnd, text, share):
    return [w if rnd.random() > share else words(rnd, 1)[0] for w in text]


class Union:
    def __init__(self):
        self.p = {}

    def top(self, x):
        self.p.setdefault(x, x)
        while self.p[x] != x:
            x = self.p[x]
        return x

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.p[max(a, b)] = min(a, b)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(50)] + [(200, 300 + i) for i in range(30)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    u = Union()
    for a, b in edges:
        if a != b:
            u.join(a, b)
    assert got == {k: u.top(k) for k in u.p}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- near duplicates


def kmers(text):
    return near.Kmers(hashes_of(text))


def lcs_similarity(a, b):
    def labels(t):
        w = words_of(t)
        k = min(5, len(w))
        seen, out = Counter(), []
        for i in range(len(w) - k + 1 if k else 0):
            s = tuple(w[i : i + k])
            out.append((s, seen[s]))
            seen[s] += 1
        return out

    x, y = labels(a), labels(b)
    if not x or not y:
        return 0.0
    row = [0] * (len(y) + 1)
    for p in x:
        prev = row
        row = [0]
        for j, q in enumerate(y):
            row.append(prev[j] + 1 if p == q else max(prev[j + 1], row[j]))
    return row[-1] / (len(x) + len(y) - row[-1])


def test_alignment_is_the_longest_common_sequence():
    rnd = random.Random(8)
    for _ in range(60):
        a = words(rnd, rnd.randrange(1, 90), "ab")
        b = edited(rnd, a, 0.02)
        if rnd.random() < 0.3:
            k = rnd.randrange(len(b))
            b = b[k:] + b[:k]
        want = lcs_similarity(" ".join(a), " ".join(b))
        got = near.similarity(kmers(" ".join(a)), kmers(" ".join(b)))
        assert got == pytest.approx(want if want >= 0.8 else 0.0)


def test_groups_equal_brute_force(spark):
    rnd = random.Random(2)
    docs, texts = [], []
    for _ in range(12):
        base = words(rnd, rnd.choice([4, 8, 30, 120, 400]))
        for share in (0, 0, 0.004, 0.01, 0.02, 0.05):
            texts.append(" ".join(edited(rnd, base, share)))
    hot = words(rnd, 150)
    texts += [" ".join(edited(rnd, hot, 0.012)) for _ in range(150)]  # a group around the threshold
    texts += [" ".join(hot[:40] + words(rnd, 60)) for _ in range(40)]  # texts that share a passage only
    texts += ["", None, "!!", "word", "Word!", "one two", "one two three", "w " * 4000, "w " * 4500]
    docs = [(i, t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("id", F.lit(1))
    got = {r.id: r.class_id for r in near.groups(frame).collect()}
    u, made = Union(), [(i, kmers(t)) for i, t in docs if words_of(t)]
    for i, _ in docs:
        u.top(i)
    norm = defaultdict(list)
    for i, t in docs:
        if words_of(t):
            norm[tuple(words_of(t))].append(i)
    for g in norm.values():
        for i in g[1:]:
            u.join(g[0], i)
    for x, (i, a) in enumerate(made):
        for j, b in made[:x]:
            if near.similarity(a, b):
                u.join(i, j)
    assert got == {i: u.top(i) for i, _ in docs}
    kept = {r.doc_id for r in near.keep_first(frame).collect()}
    assert kept == {i for i, _ in docs if u.top(i) == i}


def test_near_odd_rows(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "other words"), (None, "a b c d e f"), (2, "A, b c d e f"), (3, None), (3, None), (4, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter((r.doc_id, r.text) for r in near.keep_first(frame).collect())
    assert kept == Counter({(1, "a b c d e f"): 1, (1, "other words"): 1, (None, "a b c d e f"): 1, (3, None): 2, (4, ""): 1})
    assert near.groups(frame.limit(0)).count() == 0 and near.keep_first(frame.limit(0)).columns == frame.columns


# --- repeated passages


@pytest.mark.parametrize("values", [1 << 60, 6, 1])
def test_compact_windows_cover_every_run(values):
    """Of random values, of values with many ties, and of equal ones."""
    rnd = np.random.default_rng(1)
    v = rnd.integers(0, values, 460).astype(np.uint64)
    left, right = np.array([0, 200, 215, 300]), np.array([200, 215, 300, 460])
    l, c, r = sub.compact_windows(v, left, right, 20)
    windows = list(zip(l.tolist(), c.tolist(), r.tolist(), strict=True))
    for begin, end in zip(left.tolist(), right.tolist(), strict=True):
        for a in range(begin, end - 19, 7):
            for z in range(a + 20, end + 1, 13):
                low = a + int(v[a:z].argmin())
                assert sum(x <= a and z <= y and m == low for x, m, y in windows) == 1


def test_cells_are_all_passages():
    """Every passage of WIDTH shingles lies in one cell of each two functions, whose key says what their minima are."""
    rnd = np.random.default_rng(2)
    sizes = np.array([180, 50, 400, 61])
    h = rnd.integers(0, 1 << 63, sizes.sum()).astype(np.uint64)
    h[300:420] = h[20:140]  # a passage of the first text in the third
    text, key, at = sub.window_keys(h, sizes)
    seen = Counter()
    shared = defaultdict(set)
    for pair, (t, k, c, c2, owner, more) in enumerate(sub.cells(text, key, at)):
        assert len(set(zip(t.tolist(), k.tolist(), c.tolist(), c2.tolist(), strict=True))) == len(k)
        for i in range(len(k)):
            seen[pair] += 1
            shared[int(k[i])].add((int(t[i]), int(c[i]), int(c2[i])))
            assert len(more[owner == i]) >= 1  # a window of the other function holds each passage
    assert len(seen) == 3
    for begin in range(20, 140 - 49, 6):  # each passage of 50 shared words has its three cells in both texts
        s = shingles_of(h[begin : begin + 50], sub.KEY_WORDS)
        low = [int(np.argmin(sub.mix64(s ^ sub._SEEDS[f]))) + begin for f in range(3)]
        other = [x - 20 + 300 - 230 for x in low]
        for i in range(3):
            for j in range(i + 1, 3):
                assert any({(0, low[i], low[j]), (2, other[i], other[j])} <= v for v in shared.values())


def test_word_hashes():
    texts = ["One two, two", "", None, "İstanbul straße é Ǆ x_1 ΑΣ", "a" * (HUGE + 9) + " b " + "a" * (HUGE + 9), "two"]
    h, n = word_hashes([plain(t) for t in texts])
    assert n.tolist() == [len(words_of(t)) for t in texts] == [3, 0, 0, 6, 3, 1] and all(len(word_spans(t or "")) == k for t, k in zip(texts, n, strict=True))
    by = defaultdict(set)
    for w, x in zip([w for t in texts for w in words_of(t)], h.tolist(), strict=True):
        by[w].add(x)
    assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by)
    x = np.random.default_rng(2).integers(0, 1 << 63, 300).astype(np.uint64)
    x[200:260] = x[20:80]
    got = run_hashes(x, np.arange(276), np.arange(276) + 25)
    assert (got[200:236] == got[20:56]).all() and len(set(got.tolist())) == 276 - 36


def alike(a, b):
    """Share of common shingles of two word lists, by plain sets."""
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
    return len(x & y) / len(x | y)


def test_recall_of_edited_passages(spark):
    """Passages of 50 to 60 words with one word changed or put in, that begin and end alike, at 0.8 or more: 0.9 and more are found."""
    rnd = random.Random(31)
    line, rows, kinds = words(rnd, 30), [], {}
    for k in range(360):
        n, kind = (50, 55, 60)[k % 3], ("changed", "put in", "behind a line")[k // 3 % 3]
        p = words(rnd, n)
        if kind == "behind a line":  # half of the passage is a line of many texts
            p = line + p[30:]
        e, at = [*p], rnd.randrange(5, n - 5)
        if kind == "put in":
            e.insert(at, "new")
        else:
            e[at] = "new"
        if alike(p, e) < 0.8:
            continue
        kinds[k] = (n, kind)
        for j, body in enumerate((p, e)):
            rows.append((1000 + 2 * k + j, " ".join(words(rnd, rnd.randrange(20, 90)) + body + words(rnd, rnd.randrange(20, 90)))))
    rows += [(i, " ".join(words(rnd, 60) + line + words(rnd, 60))) for i in range(200)]
    later = {r.doc_id for r in sub.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.role == "later"}
    assert not {i for i in later if i < 1000 or i % 2 == 0}
    for kind, least in (("changed", 0.9), ("put in", 0.9), ("behind a line", 0.9)):
        of = [1001 + 2 * k in later for k, v in kinds.items() if v[1] == kind]
        print(kind, len(of), sum(of) / len(of), [sum(1001 + 2 * k in later for k, v in kinds.items() if v == (n, kind)) / max(1, sum(v == (n, kind) for v in kinds.values())) for n in (50, 55, 60)])
        assert sum(of) >= least * len(of), kind


def test_removal_counts_the_same_words(spark):
    """Letters that change their number in lower case, and combining marks, do not move the cut."""
    rnd = random.Random(5)
    odd = ["İİİ", "straße", "e\u0301te\u0301", "ΑΣ", "x_1", "日本", "٣٤"]
    passage = words(rnd, 60)
    head, tail = [rnd.choice(odd) for _ in range(25)], [rnd.choice(odd) for _ in range(25)]
    rows = [(1, " ".join(passage + words(rnd, 20))), (2, " ".join([*head, *passage, *tail]))]
    out = {r.doc_id: r.text for r in sub.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[2].split() == [*head, *tail] and out[1] == rows[0][1]
    assert sub.without_spans("İ a, b! c", [(1, 2), (2, 3)]) == "İ , ! c"


def run_counts(texts):
    n = Counter()
    for t in texts:
        h = hashes_of(t)
        if len(h) >= 50:
            n.update(shingles_of(h, 50).tolist())
    return n


def test_passages_go_once(spark):
    rnd = random.Random(6)
    passage, line, other = words(rnd, 70), words(rnd, 30), words(rnd, 120)
    docs = {}
    for i in range(60):
        docs[i] = words(rnd, 90)
    for i in range(0, 30):
        docs[i] = docs[i][:20] + passage + docs[i][20:]
    for i in range(20, 50):
        docs[i] = docs[i][:10] + line + docs[i][10:]
    swapped = [*other]
    swapped[60] = "changed"
    docs[50], docs[51] = docs[50] + other, docs[51] + swapped
    docs[52] = words(rnd, 40) + passage + words(rnd, 10) + passage
    docs[53], docs[54] = ["again"] * 300, words(rnd, 7) * 40
    docs[55], docs[56] = docs[1][:], docs[1][:49]
    rows = [(i, " ".join(t)) for i, t in docs.items()] + [(None, None), (90, ""), (91, "short"), (None, " ".join(docs[2]))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text")).withColumn("d", F.lit("clash"))
    spans = sub.repeats(frame).collect()
    later = {r.doc_id for r in spans if r.role == "later"}
    assert set(range(1, 30)) | {51, 52, 53, 54, 55, None} <= later and not later & ({0, 50} | set(range(30, 50)))
    assert {r.source_doc_id for r in spans if r.doc_id == 51 and r.role == "later"} == {50}
    out = sub.remove_repeats(frame).collect()
    assert max(run_counts([r.text for r in out]).values(), default=0) <= 1
    kept = {r.doc_id: r.text for r in out if r.doc_id is not None}
    assert 55 not in kept and kept[0] == rows[0][1] and kept[35] == rows[35][1] and kept[91] == "short" and kept[90] == ""
    assert all(r.n_chars == len(r.text) for r in out if r.text is not None)
    before = run_counts([t for _, t in rows])
    assert any(before) and sum(len(words_of(kept[i])) for i in range(1, 20)) == sum(90 + (30 if 20 <= i < 50 else 0) for i in range(1, 20))
    assert sub.repeats(frame.limit(0)).count() == 0 and sub.remove_repeats(frame.limit(0)).columns == frame.columns


def test_passage_behind_a_common_line(spark):
    """Texts share 64 words with each other, of which the first 36 words stand in a hundred texts before them."""
    rnd = random.Random(9)
    line = words(rnd, 36)
    tails = [words(rnd, 28) for _ in range(5)]
    rows = [(i, " ".join(words(rnd, 60) + line + words(rnd, 60))) for i in range(100)]
    rows += [(200 + 10 * k + j, " ".join(words(rnd, 60) + line + tails[k] + words(rnd, 60))) for k in range(5) for j in range(4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    later = {r.doc_id for r in sub.repeats(frame).collect() if r.role == "later"}
    assert later == {200 + 10 * k + j for k in range(5) for j in range(1, 4)}


def test_second_passage_of_a_known_pair(spark):
    """Pairs of texts share a passage, and at another offset 59 words of which 49 stand in a text before them."""
    rnd = random.Random(21)
    rows = []
    for k in range(40):
        line, tail, passage = words(rnd, 49), words(rnd, 10), words(rnd, 70)
        rows.append((k, " ".join(words(rnd, 60) + line + words(rnd, 60))))
        for j, gap in enumerate((20, 45)):
            rows.append((100 + 2 * k + j, " ".join(words(rnd, 15) + passage + words(rnd, gap) + line + tail + words(rnd, 30))))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    out = sub.remove_repeats(frame).collect()
    assert len(out) == len(rows)
    assert max(run_counts([r.text for r in out]).values()) == 1


def test_passage_beyond_an_explained_text(spark):
    """A has P + R, B has P + R + Q, C has R + Q: B is explained by A, yet B and C share R + Q."""
    rnd = random.Random(22)
    rows = []
    for k in range(60):
        p, r, q = words(rnd, 30), words(rnd, 49), words(rnd, 12)
        for j, body in enumerate((p + r, p + r + q, r + q)):
            rows.append((3 * k + j, " ".join(words(rnd, 40) + body + words(rnd, 40))))
    spans = sub.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    later = {r.doc_id for r in spans if r.role == "later"}
    assert later == {i for i, _ in rows if i % 3}


@pytest.mark.parametrize("n", [40, 49])
def test_edited_passages_behind_a_longer_line(spark, n):
    """Passages of 50 to 60 words, one in two with a word changed or put in, whose first n words are a line of a hundred texts before them."""
    rnd = random.Random(77)
    line = words(rnd, n)
    rows = [(i, " ".join(words(rnd, 60) + line + words(rnd, 60))) for i in range(100)]
    for k in range(40):
        p = line + words(rnd, (50, 52, 55, 60)[k % 4] - n)
        e, at = [*p], rnd.randrange(5, len(p) - 5)
        if k // 4 % 2:
            e[at : at + k // 8 % 2] = ["new"]
        assert alike(p, e) >= 0.8
        rows += [(1000 + 2 * k + j, " ".join(words(rnd, rnd.randrange(20, 90)) + b + words(rnd, rnd.randrange(20, 90)))) for j, b in enumerate((p, e))]
    later = {r.doc_id for r in sub.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.role == "later"}
    wanted = {1001 + 2 * k for k in range(40)}
    print(n, len(wanted - later))
    assert len(wanted & later) >= 0.95 * len(wanted)


# --- embeddings


def vectors(rnd, n, dim=16):
    return rnd.normal(size=(n, dim))


def brute(rows, least=0.93):
    good = [(k, i, v, lab) for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, u = Counter(), Union()
    for k, i, v, lab in good:
        u.top(i)
        for k2, i2, v2, lab2 in good:
            if k2 < k and lab == lab2 and len(v) == len(v2):
                a, b = np.array(v, float), np.array(v2, float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                    links[k] += 1
                    links[k2] += 1
                    u.join(i, i2)
    return links, u


def test_embeddings_equal_brute_force(spark):
    rnd = np.random.default_rng(3)
    x = vectors(rnd, 150)
    rows = [(i, x[i].tolist(), i % 3) for i in range(150)]
    rows += [(200 + i, (x[i] + rnd.normal(size=16) * 0.05).tolist(), i % 3) for i in range(60)]
    rows += [(400 + i, x[4].tolist(), 1) for i in range(40)] + [(500 + i, (x[5] * (i + 1)).tolist(), 2) for i in range(20)]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [None, *[1.0] * 15], 1), (903, [float("nan"), *[1.0] * 15], 1), (904, [float("inf"), *[1.0] * 15], 1), (905, x[4].tolist(), None), (None, x[4].tolist(), 1), (906, [], 1), (907, x[4][:8].tolist(), 1), (404, x[4].tolist(), 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit(9)).withColumn("cid", F.lit("clash"))
    got = emb.near_duplicates(frame).collect()
    links, u = brute(rows)
    assert len(got) == len(rows)
    want = Counter((i, links[k], u.top(i) if i in u.p else i) for k, (i, _, _) in enumerate(rows))
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert emb.near_duplicates(frame.limit(0)).count() == 0


def test_recall_over_many_shards(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    x = vectors(rnd, 1500, 24)
    x[700:900] = x[0] + rnd.normal(size=(200, 24)) * 0.03  # a dense ball
    x[900:1400] = x[:500] + rnd.normal(size=(500, 24)) * 0.06
    monkeypatch.setattr(emb, "SHARD", 200)
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in emb.near_duplicates(frame).collect()}
    true = {r.vec_id: r.n_links for r in emb.true_links(frame, every=5).collect()}
    assert sum(min(got[i], n) for i, n in true.items()) >= 0.9 * sum(true.values()) and all(got[i] <= n for i, n in true.items())


def test_query_recall():
    rnd = np.random.default_rng(5)
    x = emb.unit(vectors(rnd, 600, 32))
    x[300:] = emb.unit(x[:300] + rnd.normal(size=(300, 32)) * 0.04)
    graph = [np.array(g) for g in emb.build_graph(x)]
    start = emb.medoids(x)
    hits = sum(set(np.flatnonzero(x @ x[i] >= 0.93)) == set(emb.range_search(x[i], x, graph, start, 0.93).tolist()) for i in range(0, 600, 10))
    assert hits >= 57


# --- pipeline


def test_pipeline(spark):
    import corpus_pipeline as p

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sizes = []
    for name, f in p.STAGES[:-1]:
        made = f(spark, docs, folder)
        assert made.columns == docs.columns and [t for _, t in made.dtypes] == [t for _, t in docs.dtypes], name
        made = p.cut(made)
        assert {r.doc_id for r in made.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
        sizes.append(made.count())
        docs = made
    assert sizes == sorted(sizes, reverse=True) and 500 < sizes[-1] < 900
    assert p.near_dedup.groups(docs).where("id <> class_id").count() < 5
    assert p.substring_dedup.repeats(docs).where("role = 'later'").count() == 0
    assert p.decontaminate.leaks(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).count() == 0
    out = p.run(spark, folder)
    assert out.count() > 0.9 * sizes[-1] and "mix_pass" in out.columns


def test_pipeline_odd_rows(spark, tmp_path):
    """Null ids, texts and sources, empty texts, repeated rows, and columns whose names the stages use inside."""
    import corpus_pipeline as p

    rnd = random.Random(12)
    rows = [(i, " ".join(words(rnd, 80)), "en", f"s{i % 3}") for i in range(40)]
    rows += [(50, None, "en", "s1"), (51, "", None, "s1"), (None, " ".join(words(rnd, 90)), "fr", None), (52, "one", "en", "s2"), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    for c in ("block", "row", "mix_pass", "key", "d", "id", "n", "s", "keep", "p_doc", "role", "sig", "item_id"):
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, rows[7][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        docs = p.cut(stage(spark, docs, str(tmp_path)))
    ids = [r.doc_id for r in docs.collect()]
    assert 7 not in ids and ids.count(3) == 1 and {50, 51, 52} <= set(ids) and None in ids
    out = p.STAGES[-1][1](spark, docs, str(tmp_path)).toPandas()
    assert len(out) and len(out.columns) == len(set(out.columns)) and (out["block"] == "own block").all() and (out["key"] == "own key").all()
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_words_by_bytes_are_those_of_the_pattern():
    odd = ["", "a", "İß", "ΑΣ. ΑΣ", "x́y", "  _9", "  \n\n", "\x00a\x1cb", "日本 語", "１２-Ⅷ"]
    for c in [chr(i) for i in (*range(0x3000), 0x1F600, 0x10400)]:
        for text in (c, f"A{c}Σ{c}{c}b"):
            assert plain(text) == "\n".join(re.findall(r"\w+", text)).lower()
    for text in odd:
        assert plain(text) == "\n".join(re.findall(r"\w+", text)).lower()
        assert len(words_of(text)) == len(word_spans(text))


def test_ends_by_parts(spark, monkeypatch):
    """Each part of passage_ends shuffles its own texts only, and all parts have the rows of one."""
    rnd = random.Random(21)
    line = words(rnd, 60)
    rows = [(i, " ".join(words(rnd, 8) + line + words(rnd, 8)), [20, 50]) for i in range(40)]
    near = spark.createDataFrame(rows, "tid long, text string, places array<int>").withColumn("text", F.replace("text", F.lit(" "), F.lit("\n"))).mapInArrow(sub._near_rows, "tid long, key long, at long")
    found = spark.createDataFrame([(i, 8, 68, 0, 8, 68, None) for i in range(1, 20)], sub._FOUND)

    def ends(n):
        monkeypatch.setattr(sub, "PARTS", n)
        return [[tuple(r) for r in p.select("tid", "key", "at").where("open").collect()] for p in sub.passage_ends(near, found)]

    (whole,), parts = ends(1), ends(4)
    assert len(parts) == 4 and max(map(len, parts)) < len(whole)
    assert sorted(sum(parts, [])) == sorted(whole) and {r[0] for r in whole} == {0, *range(20, 40)}
    assert not set.intersection(*({r[0] for r in p} for p in parts))


def test_rows_near_places_of_many_texts():
    rnd = random.Random(22)
    texts = [words(rnd, n) for n in (50, 300, 61, 140)]
    h, sizes = word_hashes(["\n".join(t) for t in texts])
    places = [(0, 3), (1, 10), (1, 250), (3, 139)]
    text, key, at = sub.near_rows(h, sizes, *np.array(places).T)
    want = set()
    for i, t in enumerate(texts):
        own = hashes_of(" ".join(t))
        for kind, k in ((0, sub.SHINGLE_WORDS), (1, sub.RUN)):
            for x in range(len(t) - k + 1):
                if any(i == j and c - sub.REACH <= x < c + sub.REACH for j, c in places):
                    of = shingles_of(own)[x] if kind == 0 else run_hashes(own, np.array([x]), np.array([x + k]))[0]
                    want.add((i, int(of), x << 1 | kind))
    got = list(zip(text.tolist(), key.tolist(), at.tolist(), strict=True))
    assert len(got) == len(want) and set(got) == want


def test_first_holder_is_the_least_text_at_its_least_place(spark):
    rnd = np.random.default_rng(23)
    text, key, at = rnd.integers(0, 30, 3000), rnd.integers(0, 400, 3000), rnd.integers(0, 50, 3000)
    first = sub.least_places(text, key, at)
    rows = [tuple(r) for r in np.stack([text, key, at, first], 1).tolist()]
    df = spark.createDataFrame([(t, k, a, bool(f)) for t, k, a, f in rows], "tid long, key long, at long, first boolean")
    want = {}
    for t, k, a, _ in rows:
        e, place, n = want.get(k, (t, a, 0))
        want[k] = (*min((e, place), (t, a)), n + 1)
    assert {(r.key, r.e, r.place, r.n) for r in sub.first_holders(df).collect()} == {(k, *w) for k, w in want.items() if w[2] > 1}


def test_verified_by_parts(spark, monkeypatch):
    """Each part of verified takes the pairs of its own texts e only, and all parts have the rows of one."""
    rnd = random.Random(22)
    line = words(rnd, 60)
    texts = spark.createDataFrame([(i, "\n".join(words(rnd, 8) + (line if i != 7 else []) + words(rnd, 8))) for i in range(40)], "tid long, text string")
    pairs = spark.createDataFrame([(d, d % 20, [0], [d, 20 << 32 | 30]) for d in range(20, 40)] + [(30, 7, [0], [99, 20 << 32 | 30])], "d long, e long, shifts array<int>, cells array<long>")

    def rows(n):
        monkeypatch.setattr(sub, "PARTS", n)
        return [[tuple(r) for r in p.collect()] for p in sub.verified(pairs, texts)]

    (whole,), parts = rows(1), rows(4)
    order = lambda x: sorted(x, key=str)
    assert len(parts) == 4 and max(map(len, parts)) < len(whole)
    assert order(sum(parts, [])) == order(whole)
    assert order(whole) == order([(d, 8, 68, d % 20, 8, 68, None) for d in range(20, 40) if d != 27] + [(None,) * 6 + (k,) for k in (27, 99)])
    sources = [{r[3] for r in p if r[3] is not None} for p in parts]
    assert sum(map(len, sources)) == len(set.union(*sources)) == 19


def test_cut_deletes_shuffle_files(spark, monkeypatch):
    """The shuffle files of what cut writes go as the write ends, before and without a collection of garbage."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        every = disk.getAllFiles()
        return {n for i in range(every.size()) if (n := every.apply(i).getName()).startswith("shuffle_")}

    def collect():
        until = time.time() + 10
        while (new := files() - before) and time.time() < until:
            time.sleep(0.1)
        left.append(new)

    left, before, name = [], files(), common.CLEANUP
    was = spark.conf.get(name)
    monkeypatch.setattr(common.gc, "collect", collect)
    df = common.cut(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).agg(F.count("*").alias("n")))
    assert left == [set()] and spark.conf.get(name) == was
    assert df.count() == 100 and df.agg(F.sum("n")).first()[0] == 1000


@pytest.mark.parametrize("most", [0, common.ONE_TASK])
def test_few_edges_are_united_in_one_task(spark, monkeypatch, most):
    rnd, written = random.Random(11), []
    monkeypatch.setattr(common, "ONE_TASK", most)
    monkeypatch.setattr(common, "cut", lambda df, cut=common.cut: written.append(df) or cut(df))
    name = lambda i: (i * 40503 % 65536).to_bytes(2, "big")  # noqa: E731  bytes from 128 on too
    edges = [(name(rnd.randrange(60)), name(rnd.randrange(60))) for _ in range(40)] + [(name(100 + i), name(101 + i)) for i in range(50)]
    frame = spark.createDataFrame([*edges, edges[0], (name(5), name(5)), (None, name(7)), (name(8), None)], "a binary, b binary")
    got = {bytes(r.node): bytes(r.component) for r in components(frame).collect()}
    u = Union()
    for a, b in edges:
        if a != b:
            u.join(a, b)
    assert got == {k: u.top(k) for k in u.p}
    assert bool(written) == (most == 0)


def test_only_texts_with_enough_equal_shingles_are_aligned(monkeypatch):
    rnd, aligned, similarity = random.Random(12), [], near.similarity
    bases = [words(rnd, n) for n in (6, 60, 60, 300)] + [["w"] * 90]
    texts = sorted({" ".join(edited(rnd, b, share)) for b in bases for share in (0, 0.01, 0.02, 0.1, 0.3) for _ in range(4)})
    rnd.shuffle(texts)
    made = [kmers(t) for t in texts]
    bound = lambda a, b: 0.8 * (a.n + b.n) / 1.8 - 1e-9
    want = {(i, j) for i, a in enumerate(made[:20]) for j, b in enumerate(made) if min(a.n, b.n) >= bound(a, b) and len(np.intersect1d(a.sorted, b.sorted)) >= bound(a, b)}
    for at_once in (1, 500, near.AT_ONCE):
        monkeypatch.setattr(near, "AT_ONCE", at_once)
        assert sorted(near.enough(made[:20], made)) == sorted(want)
    assert list(near.enough(made[:20], [])) == list(near.enough([], made)) == []
    linked = {(i, j) for i, a in enumerate(made[:20]) for j, b in enumerate(made) if similarity(a, b)}
    assert linked <= want and len(linked) > 20
    monkeypatch.setattr(near, "similarity", lambda *a: aligned.append(a) or similarity(*a))
    rows = [(bytes([i]), bytes([i]), hashes_of(texts[i]).tobytes(), few) for few, n in ((True, 20), (False, len(texts))) for i in range(n)]
    out = near._compare(0.8)(pd.DataFrame(rows, columns=["key", "comp", "words", "few"]))
    found, whole = Union(), Union()
    for i in range(len(texts)):
        found.top(i), whole.top(i)
    for a, b in zip(out.a, out.b, strict=True):
        found.join(a[0], b[0])
    for i, j in linked:
        whole.join(i, j)
    assert [found.top(i) for i in range(len(texts))] == [whole.top(i) for i in range(len(texts))]
    assert len(aligned) <= len(want) < 20 * len(texts) / 4
