import pytest

from tabulon.plans import analyze
from tabulon.plans.intent import Frame, IntentError, compile_question

NUMERIC = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINEITEM = Frame((*NUMERIC, "l_returnflag", "l_linestatus", "l_shipdate"), NUMERIC)
CASES = {
    "What is the average l_extendedprice?": ("summary", ("l_extendedprice",)),
    "describe the data": ("describe", ()),
    "average l_extendedprice by l_quantity": ("summary", ("l_quantity",)),
    "l_extendedprice by l_quantity": ("grouped", ("l_quantity", "l_quantity")),
    "l_quantity by l_discount": ("grouped", ("l_quantity", "l_discount")),
    "show by l_returnflag": ("grouped", ("median_income", "l_returnflag")),
    "Histogram of l_discount": ("histogram", ("l_discount",)),
    "show the distribution": ("histogram", ("l_orderkey",)),
    "correlation heatmap": ("corr_matrix", NUMERIC),
    "relationship between l_tax and l_discount": ("scatter", ("l_tax", "l_discount")),
    "compare quantity vs extendedprice": ("scatter", ("l_quantity", "l_extendedprice")),
    "correlation of demand for x": ("scatter", ("l_orderkey", "l_partkey")),
    "compare l_tax by l_quantity": ("grouped", ("l_quantity", "l_quantity")),
    "compare prices": ("profile", ()),
    "trend of l_tax": ("trend", ("l_tax",)),
    "l_tax over time by month": ("grouped", ("l_tax", "l_partkey")),
    "monthly progression": ("trend", ("l_orderkey",)),
    "l_tax grouped by range of l_discount": ("grouped", ("l_discount", "l_discount")),
    "administrator count": ("describe", ()),
    "hello": ("profile", ()),
}


@pytest.mark.parametrize("question", CASES)
def test_rules(question):
    i = compile_question(question, LINEITEM)
    assert (i.kind, i.columns) == CASES[question]


def test_no_numeric_column():
    with pytest.raises(IntentError):
        compile_question("histogram", Frame(("a",), ()))


def test_events(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    ok = [*analyze.events("l_quantity by l_discount", df)]
    assert [e["type"] for e in ok] == ["status", "code", "status", "output", "chart", "explanation", "analysis_complete"]
    assert [r["n"] for r in ok[3]["content"]["grouped"]] == [1468, 1165, 1229, 1243, 895]
    assert [*analyze.events("show by l_returnflag", df)][-1]["type"] == "error"
    for q in ("describe the data", "correlation heatmap", "trend of l_tax", "Histogram of l_discount", "compare quantity vs extendedprice", "average l_tax", "hello"):
        assert [*analyze.events(q, df, order=["l_orderkey", "l_linenumber"])][-1]["type"] == "analysis_complete"


def test_planner_failure_falls_back(spark, folder):
    df = spark.read.parquet(f"{folder}/lineitem.parquet")
    got = [*analyze.events("average l_tax", df, planner=lambda q, f: 1 / 0)]
    assert got[-1]["type"] == "analysis_complete"
