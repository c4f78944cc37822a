"""Quality, language identification, token counts: cases, exact library counts and held-out accuracy."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import language_id, quality, queries, token_count

ODD = [None, "", " ", "\n\t", "</s>[INST]<s>", "<0x0A>", "a" * 20_000, "日本語 テキスト 𠀀", "\x00x", "▁▁ a▁b", "  two  blanks ", "🙂🙂"]


def test_counts_are_the_librarys(spark):
    import sentencepiece

    rnd = random.Random(2)
    parts = [" ", "  ", "a", "th", "e", " the", "\n", "▁", "日", "𠀀", "</s>", "!!", "-----", "ing", "é", "\x00"]
    texts = ODD + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(60))) for _ in range(400)]
    frame = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(1, "twice", 0)] * 2, "doc_id long, text string, n_tokens int")
    got = token_count.count_tokens(frame, token_count.default_model(), limit=5).collect()
    sp = sentencepiece.SentencePieceProcessor(model_file=token_count.default_model())
    want = {i: len(sp.encode(t or "")) for i, t in enumerate(texts)}
    assert len(got) == len(texts) + 2
    for r in got:
        if r.doc_id != 1:
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (want[r.doc_id], len((texts[r.doc_id] or "").encode()), want[r.doc_id] > 5)
    assert token_count.count_tokens(frame.limit(0), token_count.default_model()).count() == 0


# --- language


def brute_phrases(text, train):
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in train:
            j += 1
        i = max(i + 1, j - 1)
        n += 1
    return n


def test_cross_parsing_counts_phrases():
    rnd = random.Random(5)
    train = {k: bytes(rnd.choice(b"abcd" if k == "x" else b"bcde ") for _ in range(300)) for k in ("x", "y")}
    p = language_id.CrossParser(train)
    texts = [bytes(rnd.choice(b"abcdef ") for _ in range(rnd.randrange(1, 90))) for _ in range(50)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    got = p.phrases(data, ends - [len(t) for t in texts], ends)
    assert got.tolist() == [[brute_phrases(t, train[k]) for k in p.langs] for t in texts]


@pytest.mark.parametrize("block", [1, 7, 64])
def test_long_texts_are_parsed_whole(monkeypatch, block):
    """Blocks that are parsed at once give the phrases of one parse from the first byte to the last."""
    monkeypatch.setattr(language_id, "BLOCK", block)
    rnd = random.Random(block)
    train = {"x": bytes(rnd.choice(b"abc") for _ in range(400)), "y": b"ab" * 200, "z": bytes(rnd.choice(b"bcd") for _ in range(50))}
    p = language_id.CrossParser(train)
    texts = [b"ab" * 90, bytes(rnd.choice(b"abcdz") for _ in range(400)), b"zq" * 100, train["x"][30:200] + train["x"][:50], b"a"]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    assert p.phrases(data, ends - [len(t) for t in texts], ends).tolist() == [[brute_phrases(t, train[k]) for k in p.langs] for t in texts]


def test_training_texts(spark):
    rows = [("same text of many copies " * 3, "en")] * 300 + [(f"text number {i} of this language " * 4, "en") for i in range(30)] + [("lang " * 9000, "de"), ("\u0301", "fr")]
    got = language_id.training_texts(spark.createDataFrame(rows, "t string, l string"), "t", "l", 10, 2000)
    assert set(got) == {"en", "de"} and got["en"].count(b"same text") in (0, 3) and len(got["de"]) == 2000 and 900 < len(got["en"]) <= 2000


def test_language_cases(spark):
    en, fr = "the of and to that is with for was this " * 5, "les des est une dans pour que qui sur avec " * 5
    train = spark.createDataFrame([(en, "en"), (fr, "fr"), (None, "en"), ("123", "fr"), ("x", None)], "text string, lang string")
    docs = spark.createDataFrame([(1, en), (2, fr * 400), (3, None), (4, ""), (5, "12 !!"), (1, en), (None, "The That"), (6, "日本"), (7, "\u0301\u0302")], "doc_id long, text string").withColumn("score", F.lit(0)).withColumn("lang", F.lit("zz"))
    got = [(r.doc_id, r.lang_pred) for r in language_id.identify(docs, train).collect()]
    assert sorted((d, x) for d, x in got if d) == [(1, "en"), (1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (6, "en"), (7, "und")]
    assert (None, "en") in got
    assert {r.lang_pred for r in language_id.identify(docs, train.limit(0)).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), train).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op7_language_id(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98 and got.score.between(0, 1).all() and len(got) == 1000


# --- quality


def test_quality_on_labels(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.op2_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").toPandas()
    bad = (got.quality == 0) | (got.toxic == 1)
    assert (got.keep == ~bad).mean() > 0.97 and got.keep[~bad].mean() > 0.98 and got.keep[got.toxic == 1].mean() < 0.1


def test_quality_held_out():
    d = "/root/testdata/sf0.1"
    rows = duckdb.execute(f"select text, quality, toxic from '{d}/documents.parquet' d join '{d}/labels.parquet' l using (doc_id) order by hash(doc_id)").fetchall()
    faults = np.array([[q == 0, t == 1] for _, q, t in rows], float)
    n, slots = len(rows) // 2, quality.Slots()
    w, v = quality.train([quality.features(r[0], slots) for r in rows[:n]], faults[:n])
    bad = np.array([quality.probability(quality.features(r[0], slots), w, v) for r in rows[n:]]) > 0.5
    assert (bad == faults[n:].any(1)).mean() > 0.96 and bad[~faults[n:].any(1)].mean() < 0.02 and bad[faults[n:, 1] > 0].mean() > 0.85


def shrunk(rows):
    """p_host, p_path, p_bad of each (host, path, p) by plain sums over the other rows."""
    def group(key):
        out = {}
        for r in rows:
            out.setdefault(key(r), []).append(r[2])
        return out

    host, path, mean = group(lambda r: r[0]), group(lambda r: r[:2]), sum(r[2] for r in rows) / len(rows)
    spread = lambda g: sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in g.values()) / len(rows)
    prior = lambda var: 1000.0 if var <= 1e-15 else min(1000.0, max(1.0, mean * (1 - mean) / var - 1))
    a, b = prior(spread(host)), prior(spread(path) - spread(host))
    odds = lambda p: p / (1 - p)
    out = []
    for h, p, x in rows:
        ph = (sum(host[h]) - x + a * mean) / (len(host[h]) - 1 + a)
        pp = (sum(path[h, p]) - x + b * ph) / (len(path[h, p]) - 1 + b)
        o = odds(x) * odds(pp) / odds(mean)
        out.append((h, p, round(x, 9), round(ph, 9), round(pp, 9), round(o / (1 + o), 9)))
    return out


def test_site_posteriors(spark):
    rnd = random.Random(3)
    sites = [("a", "x", 60, 0.9), ("a", "y", 1, 0.1), ("b", "x", 200, 0.05), (None, None, 1, 0.5), ("c", "x", 1, 0.99), ("d", "x", 3, 0.4), ("d", "y", 30, 0.2)]
    rows = [(h, p, min(0.999, max(0.001, v + rnd.uniform(-0.05, 0.05)))) for h, p, n, v in sites for _ in range(n)]
    scored = spark.createDataFrame(rows, "source string, lang string, p_doc double").withColumns({"n": F.lit("kept"), "s": F.lit(7)})
    got = quality.add_sites(scored, "source", "lang", 0.5).toPandas()
    assert (got.n == "kept").all() and (got.s == 7).all() and (got.keep == (got.p_bad < 0.5)).all()
    key = lambda r: tuple(str(x) for x in r)
    have = [(r.source, r.lang, round(r.p_doc, 9), round(r.p_host, 9), round(r.p_path, 9), round(r.p_bad, 9)) for r in got.itertuples()]
    clean = lambda rs: sorted([tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rs], key=key)
    for x, y in zip(clean(have), clean(shrunk(rows)), strict=True):
        assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:], abs=2e-7)
    lone = got[got.source == "c"].iloc[0]  # a site of one row is judged by the corpus, not by itself
    assert lone.p_path == pytest.approx(np.mean([r[2] for r in rows]), abs=1e-9)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "s", None), (2, "", None, "en"), (3, "fine words here", "s", "en"), (3, "fine words here", "s", "en"), (None, "x" * 50_000, "s", "en")], "doc_id long, text string, source string, lang string").withColumn("keep", F.lit(1))
    labels = spark.createDataFrame([(3, 1, None), (3, None, 0), (9, 0, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.judge(docs, labels).count() == 5
    assert quality.judge(docs, labels.limit(0)).where("keep").count() == 5
    assert quality.judge(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(docs, labels).count() == 5


def test_oracle_library_is_here():
    assert duckdb.__version__
    pytest.importorskip("sentencepiece")
