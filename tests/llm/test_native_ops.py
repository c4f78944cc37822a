"""URL filter, decontamination, chat formatting and mixing: cases, brute force and SQL."""

import hashlib
import itertools
import math
import random
from collections import Counter

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from tabulon.llm import chat_format, decontaminate, mixing, queries, url_filter

RULES = queries.URL_RULES


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, folder, name):
    assert_same(queries.queries()[name](spark, folder), queries.oracle_sql()[name], folder)


# --- URL filter

URLS = [None, "", "no scheme", "http://", "http://ORG/", "http://a.Example.ORG/es/x?q=/en/1", "http://example.org/en/1", "http://example.org/en/123#x", "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/de/", "http://x.com/de", "http://com?x", "http://example.org", "http://spam-farm.example.com/", "http://www.spam-farm.example.com/fr/1", "a://b://c/", "http://x.org/\nline", "http://é.com/de/ü", "http://" + "a." * 300 + "com/de/" + "p" * 3000]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p)
    rules = sorted(((-len(h + p), h + p, v) for v, h, p in RULES if fits(h, p)))
    listed = any(fits(h, p) for h, p in queries.LISTED_SITES)
    return host, path, rules[0][1] if rules else None, rules[0][2] if rules else "block" if listed else "allow"


@pytest.mark.parametrize("limit", [100_000, 0])
def test_urls(spark, limit):
    pages = spark.createDataFrame([*enumerate(URLS), (0, URLS[5]), (0, URLS[5])], "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("key", F.lit(1))
    rules = spark.createDataFrame([*RULES, ("block", None, "/"), ("block", "x", None), ("block", "", "/")], "verdict string, host string, path string")
    listed = spark.createDataFrame(queries.LISTED_SITES, "host string, path string")
    got = url_filter.filter_urls(pages, rules, listed, broadcast_rules=limit).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == Counter((i, *judged(u)) for i, u in [*enumerate(URLS), (0, URLS[5]), (0, URLS[5])])


def test_urls_empty(spark):
    none = spark.createDataFrame([], "verdict string, host string, path string")
    pages = spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")
    assert [r.verdict for r in url_filter.filter_urls(pages, none).collect()] == ["allow"]
    assert url_filter.filter_urls(pages.limit(0), none).count() == 0


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    words = url_filter.bloom_words(keys, 94).first().words
    probe = spark.range(6000).select(F.col("id"), F.concat(F.lit("k"), "id").alias("key"))
    hit = probe.where(url_filter.bloom_hit(F.array(*map(F.lit, words)), F.col("key"), 94))
    ids = {r.id for r in hit.collect()}
    assert set(range(3000)) <= ids and len(ids) < 3300


# --- decontamination


def brute_leak(doc, item, least=13):
    """Best stretch by matches less four times the substitutions on any diagonal with a ten-token seed."""
    import re

    d, i = ([w for w in re.split(r"[\W_]+", t.lower()) if w] for t in (doc or "", item or ""))
    best = None
    for shift in range(-len(i) + 1, len(d)):
        same = [int(0 <= k + shift < len(d) and d[k + shift] == i[k]) for k in range(len(i))]
        span = [k for k in range(len(i)) if 0 <= k + shift < len(d)]
        seeded = any(all(same[k + o] for o, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for k in range(len(i) - 9) if k + 9 in span and k in span) if len(i) >= 10 else all(same)
        if not seeded:
            continue
        for a in span:
            for z in range(a + 1, span[-1] + 2):
                score = 5 * sum(same[a:z]) - 4 * (z - a)
                if score > 0 and z - a >= min(least, len(i)) and (best is None or score > best):
                    best = score
    return best is not None


def test_leaks(spark):
    rnd = random.Random(4)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("xyz") + str(rnd.randrange(40))
    item = [word() for _ in range(30)]
    texts = {}
    noise = lambda n: [word() for _ in range(n)]
    texts[1] = noise(40) + item + noise(10)
    swapped = [*item]
    swapped[7], swapped[20] = "q1", "q2"
    texts[2] = noise(5) + swapped + noise(5)
    texts[3] = noise(20) + item[:13] + noise(20)
    texts[4] = noise(20) + item[:9] + noise(20)
    texts[5] = noise(60)
    texts[6] = [w if k % 3 else "zz" for k, w in enumerate(item)]
    texts[7] = ["say", "only", "these", "words"]
    docs = [(k, " ".join(v)) for k, v in texts.items()] + [(8, None), (9, ""), (10, "!!! --"), (1, " ".join(texts[1])), (None, " ".join(texts[3])), (11, " ".join(item).upper().replace(" ", ", ")), (12, "w " * 30_000)]
    items = [(1, " ".join(item)), (2, "Say only these WORDS"), (3, None), (4, ""), (1, " ".join(item)), (None, " ".join(noise(20)))]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("item_id", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for how in ({}, {"broadcast_seeds": 0}):
        got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, bench, **how).collect()}
        want = {(d, i) for d, t in docs if d != 12 for i, x in items if brute_leak(t, x)}
        assert got == want and {(1, 1), (2, 1), (3, 1), (None, 1), (7, 2), (11, 1)} <= got
    kept = [r.doc_id for r in decontaminate.clean(frame, bench).collect()]
    assert sorted(kept) == [4, 5, 6, 8, 9, 10, 12]
    assert decontaminate.clean(frame.limit(0), bench).count() == 0
    assert decontaminate.clean(frame, bench.limit(0)).count() == len(docs)


def longest_rule(d, i, least=13):
    """Whether a stretch of `least` tokens, or a whole shorter item, is 0.8 equal on some diagonal."""
    least = min(least, len(i))
    for shift in range(-len(i) + 1, len(d)):
        same = [d[k + shift] == i[k] for k in range(max(0, -shift), min(len(i), len(d) - shift))]
        if any(5 * sum(same[a:z]) >= 4 * (z - a) for a in range(len(same)) for z in range(a + least, len(same) + 1)):
            return True
    return False


def test_masks_hit_every_overlap():
    """Stretches of 26 tokens or more split into two of 13 or more, of which one is 0.8 equal."""
    for n in range(1, 26):
        masks = decontaminate.masks_of(n)
        fits = [sum(1 << (p + o) for o, c in enumerate(m) if c == "1") for m in masks for p in range(n - len(m) + 1)]
        for subs in itertools.combinations(range(n), n // 5):
            bad = sum(1 << k for k in subs)
            assert any(not f & bad for f in fits), (n, subs)


def test_leaks_with_substitutions_anywhere(spark):
    """Items of all small sizes, with as many substitutions as the rule allows, and one more."""
    rnd = random.Random(12)
    docs, items, want = [], [], set()
    for n in [*range(1, 21), 25, 40]:
        item = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        places = [sorted(rnd.sample(range(n), min(n, n // 5 + more))) for more in (0, 0, 0, 0, 1)] + [list(range(4, n, 5))]
        for subs in places:
            d = ["a", "b", *["zz" if k in subs else w for k, w in enumerate(item)], "c"]
            docs.append((len(docs), " ".join(d)))
            if longest_rule(d, item):
                want.add((len(docs) - 1, n))
    assert len(docs) / 2 < len(want) < len(docs)
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for how in ({}, {"broadcast_seeds": 0}):
        assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(frame, bench, **how).collect()} == want


def test_leaks_near_the_ends(spark):
    """Substitutions near the ends, where the best-scoring stretch is shorter than the rule asks."""
    word = lambda k, n: f"w{n}x{k}"
    docs, items, want = [], [], set()
    for n in range(13, 21):
        item = [word(k, n) for k in range(n)]
        items.append((n, " ".join(item)))
        for subs in ([1], [n - 2], [1, n - 2] if n > 13 else [2], [0, 2]):
            doc_id = len(docs)
            d = ["a", "b", *["zz" if k in subs else w for k, w in enumerate(item)], "c"]
            docs.append((doc_id, " ".join(d)))
            if longest_rule(d, item):
                want.add((doc_id, n))
    assert len(want) == len(docs)
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.leaks(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want
    for r in rows:
        d, i = docs[r.doc_id][1].split(), dict(items)[r.item_id].split()
        assert r["size"] >= 13 and r.same >= 0.8 * r["size"]
        assert r.same == sum(x in i for x in d[r.start : r.start + r["size"]])


# --- chat formatting


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "back\\slash \\\\ <\\s>", "<|user|>\n", "", None, "a" * 50_000, "[[/INST]<<s>||>", "é😀\n\n"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, None, None, None), (None, 1, "assistant", "x"), (2, None, None, None), (3, 1, "a|>b", "y")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1))
    chats = chat_format.read_back(chat_format.format_chats(chat_format.chain(frame))).collect()
    assert len(chats) == 4
    for c in chats:
        own = sorted(((t if t is not None else -1, r or "", x or "") for k, t, r, x in rows if k == c.tree))
        assert [(t.role, t.text) for t in c.turns] == [(r, x) for _, r, x in own]
        assert c.loss_text == "".join(x for _, r, x in own if r == "assistant")
    got = chat_format.digests(chat_format.format_chats(chat_format.chain(frame.where("conv_id = 1")))).first()
    joined = "".join(f"{r}\n{x or ''}\n" for _, _, r, x in rows[:8])
    assert got.turns_sha256 == hashlib.sha256(joined.encode()).hexdigest() and got.n_turns == 8
    assert chat_format.format_chats(chat_format.chain(frame.limit(0))).count() == 0


def test_reply_trees(spark):
    rnd = random.Random(3)
    nodes = []
    for tree in range(5):
        nodes += [(tree, n, rnd.randrange(max(0, n - 3), n) if n else None, "user", f"t{n}", rnd.choice([0.0, 1.0, 2.0, None])) for n in range(40)]
    nodes += [(9, 1, 2, "user", "x", 1.0), (9, 2, 1, "user", "y", 1.0), (10, 1, 77, "user", "z", 1.0)]
    frame = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")

    def paths(tree):
        own = {n: (p, s or 0.0) for t, n, p, _, _, s in nodes if t == tree}
        leaves = set(own) - {p for p, _ in own.values()}
        out = {}
        for leaf in leaves:
            path = [leaf]
            while own[path[-1]][0] in own:
                path.append(own[path[-1]][0])
            out[leaf] = path[::-1]
        ranked = sorted(out, key=lambda x: (-sum(own[n][1] for n in out[x]) / len(out[x]), -len(out[x]), x))
        return [(x, out[x]) for x in ranked]

    got = {}
    for r in chat_format.branches(frame, None).orderBy("tree", "rank", "place").collect():
        got.setdefault((r.tree, r["rank"], r.leaf), []).append(r.node)
    for tree in range(5):
        assert [(k[2], v) for k, v in sorted(got.items()) if k[0] == tree] == paths(tree)
    assert got[10, 1, 1] == [1] and sorted(v for k, v in got.items() if k[0] == 9) == [[1], [2]]
    best = chat_format.format_chats(frame).where("tree = 0").first()
    assert best.leaf == paths(0)[0][0] and best.formatted.count("<|user|>") == len(paths(0)[0][1])


# --- mixing


@pytest.mark.parametrize("tokens", [{"a": 1000, "b": 10, "c": 100}, {"a": 5}, {}, {"a": 0, "b": 7}, {"a": 50, "b": 50}])
def test_temperature(tokens):
    total = sum(tokens.values())
    e, w = mixing.temperature(tokens, total, 0.9, 4.0)
    live = [k for k in tokens if tokens[k]]
    assert set(w) == set(live) and 0 <= e <= 1
    if live:
        assert sum(w.values()) == pytest.approx(1)
        assert all(w[k] * total / tokens[k] <= 4.0 + 1e-6 for k in live)
        reached = mixing.entropy([*w.values()]) >= 0.9 * math.log(len(live)) - 1e-6
        assert reached or max(w[k] * total / tokens[k] for k in live) == pytest.approx(4.0, rel=1e-3)


def test_mix_budgets(spark):
    rnd = random.Random(1)
    rows = [(i, s, " ".join(["w"] * rnd.randrange(1, 30))) for s, n in (("big", 3000), ("mid", 300), ("small", 60), (None, 40)) for i in range(n)]
    rows += [(1, "mid", None), (2, "mid", ""), (3, "mid", "  \n "), (5, "mid", "x y"), (5, "mid", "x y"), (6, "blank", "")]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("mix_pass", F.lit(-1)).withColumn("block", F.lit(0))
    got = mixing.mix(frame, block_docs=16).collect()
    size = lambda t: len((t or "").split())
    have, out = Counter(), Counter()
    for _, s, t in rows:
        have[s] += size(t)
    for r in got:
        out[r.source] += size(r.text)
    _, w = mixing.temperature({k: v for k, v in have.items()}, sum(have.values()), 0.97, 4.0)
    for s in w:
        assert w[s] * sum(have.values()) - 1 <= out[s] <= w[s] * sum(have.values()) + 30
    passes = Counter((r.source, r.doc_id, r.text, r.mix_pass) for r in got)
    once = Counter(rows and [(s, i, t) for i, s, t in rows])
    assert all(n <= once[k[:3]] for k, n in passes.items())
    again = mixing.mix(frame.repartition(5), block_docs=16).collect()
    assert Counter((r.source, r.doc_id, r.mix_pass) for r in again) == Counter((r.source, r.doc_id, r.mix_pass) for r in got)
    far = mixing.mix(frame, block_docs=16, broadcast_rows=0).collect()
    assert Counter((r.source, r.doc_id, r.mix_pass) for r in far) == Counter((r.source, r.doc_id, r.mix_pass) for r in got)
    assert mixing.mix(frame.limit(0)).count() == 0


def test_mix_keeps_the_repetition_limit(spark):
    one = spark.createDataFrame([(1, "s", "w " * 20)], "doc_id long, source string, text string").withColumn("n", F.lit(5))
    with pytest.warns(UserWarning, match="cut"):
        assert mixing.mix(one, budget=200).count() == 4
    assert mixing.mix(one, tokens="n", budget=10).count() == 2
    rows = [(i, s, "a b c d e") for s, n in (("big", 200), ("small", 3)) for i in range(n)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), max_repeats=2.0, target_entropy=1.0)
    assert max(r["count"] for r in got.groupBy("doc_id", "source").count().collect()) <= 2
