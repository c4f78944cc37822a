import pytest
from pyspark.sql import functions as F

from tabulon.functions import scalars
from tabulon.operators import context, topup


def counts(spark, a, n, w, most=None):
    sources = [spark.range(k).select(F.col("id").alias("pos"), F.lit(name).alias("s")) for k, name in ((a, "a"), (n, "n"), (w, "w"))]
    got = topup.topup(*sources, pos="pos", most=most).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, len(got) + 1))
    return tuple(sum(r.s == s for r in got) for s in "anw")


@pytest.mark.parametrize(("have", "short", "fill"), [((3, 5, 9), (2, 3, 0), (2, 3, 0)), ((0, 0, 9), (0, 0, 5), (0, 0, 5)), ((1, 1, 9), (1, 1, 3), (1, 1, 3)), ((0, 5, 9), (0, 3, 2), (0, 5, 0)), ((2, 0, 1), (2, 0, 1), (2, 0, 1))])
def test_topup(spark, have, short, fill):
    assert counts(spark, *have) == short
    assert counts(spark, *have, most=5) == fill


def test_topup_small_limit(spark):
    assert counts(spark, 3, 5, 9, most=1) == (2, 0, 0)


def test_connectors(spark):
    from tabulon.sources.search import Connector, search

    hits = lambda name: lambda q, n: [{"title": f"{name} {q} {i}", "href": "u"} for i in range(9)]
    bad = Connector("bad", lambda q, n: 1 / 0)
    got = search(spark, "x", Connector("a", hits("a")), bad, Connector("w", hits("w"))).collect()
    assert [r.engine for r in got] == ["a", "a", "w", "w", "w"] and got[2].title == "w x 0"


def test_search_status(spark):
    hits = spark.createDataFrame([("a", 1, "t", "b" * 90, "u"), ("a", 2, "", None, "u"), ("a", 3, "", "body", ""), ("b", 1, "", "", ""), ("c", 1, "t", "", "")], "k string, rank int, title string, body string, href string")
    got = {r.k: r for r in context.search_context(hits, ["k"]).collect()}
    assert got["a"].status == "success" and "Source 3: No title\nURL: No URL\nContent: body" in got["a"].block and "Source 2" not in got["a"].block
    assert got["b"].status == "All results empty" and got["b"].block == ""
    assert got["c"].n_valid == 1


def test_document_numbers(spark):
    docs = spark.createDataFrame([("s", 1, "f1", "x"), ("s", 2, "f2", None), ("s", 3, "f3", ""), ("s", 4, "f4", "y")], "k string, o int, filename string, extracted_text string")
    got = context.document_context(docs, ["k"], "o").first().documents
    assert got == "[PDF 1 Content Start: f1]\nx\n[PDF 1 Content End]\n[PDF 3 Content Start: f4]\ny\n[PDF 3 Content End]\n"


def test_prompt_and_chain(spark):
    row = spark.range(1).select(context.prompt(F.lit("D"), F.lit(None).cast("string"), F.lit("H"), F.lit("Q")).alias("p")).first()
    assert row.p.startswith("DH") and row.p.endswith("Q\nAI:")
    models = {"up": str.upper, "bad": lambda t: 1 / 0}
    assert context.chain(models, ["up"], "x") == "X"
    assert context.chain(models, ["up", "bad"], "x") == "x"
    assert context.chain(models, ["bad", "none", "up"], "x") == "X"


def test_scalars(spark):
    def value(c):
        return spark.range(1).select(c.alias("v")).first().v

    long = "a" * 71 + "é" + "b"
    assert value(scalars.truncate_utf8(F.lit(long))) == "a" * 71
    assert value(scalars.truncate_utf8(F.lit("é" * 40))) == "é" * 36
    assert value(scalars.truncate_utf8(F.lit("short"))) == "short"
    assert value(scalars.truncate_utf8(F.lit("a" * 70 + "😀"))) == "a" * 70
    assert value(scalars.fenced_code(F.lit("hi\n```python\nx = 1\n```\nbye"))) == "x = 1"
    assert value(scalars.fenced_code(F.lit(" x = 1 "))) == "x = 1"
    assert value(scalars.joined_truthy(F.array(F.lit("a"), F.lit(""), F.lit(None), F.lit("b")))) == "a b"
    assert value(scalars.joined_truthy(F.lit(None).cast("array<string>"), "d")) == "d"
    assert value(scalars.mask(F.lit("0123456789abcdefgh"))) == "0123456789...efgh"
    a, b = scalars.first_pair(F.lit("Standard deviation"))
    assert (value(a), value(b)) == ("st", "ard")
    assert value(scalars.linkify(F.lit("see http://x.y/z now"))) == 'see <a href="http://x.y/z" target="_blank">http://x.y/z</a> now'
    assert value(scalars.normalise_markdown(F.lit("* a\n\n\n\n1) b  \n"))) == "- a\n\n1. b"
    assert value(scalars.is_failure(F.lit("TIMEOUT"))) and not value(scalars.is_failure(F.lit("fine")))
