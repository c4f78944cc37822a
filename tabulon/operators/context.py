"""Context for a prompt: last turn, documents, search hits, status, final order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Texts around the parts, defaults of a hit's fields, the least length of a useful search block.
SEARCH_START, SEARCH_END = "\n[SEARCH RESULTS START]\n", "[SEARCH RESULTS END]\n\n"
NO_TITLE, NO_CONTENT, NO_URL = "No title", "No content available", "No URL"
ASK, ANSWER = "Based on the above search results and context, please answer the following question: ", "\nAI:"
MIN_BLOCK = 100


def joined(parts: Column, order: Column, sep: str = "") -> Column:
    """Strings of a group, in order, as one."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), parts.alias("p"))))
    return F.array_join(F.transform(rows, lambda x: x.p), sep)


def last_history(turns: DataFrame, keys: list[str], order: list[str], prompt: str = "prompt", response: str = "response") -> DataFrame:
    """keys, history: the last turn of each session as `User: ...` and `AI: ...` lines."""
    last = turns.groupBy(*keys).agg(F.max(F.struct(*order, F.col(prompt).alias("__p"), F.col(response).alias("__r"))).alias("m"))
    line = F.concat(F.lit("User: "), F.coalesce("m.__p", F.lit("")), F.lit("\nAI: "), F.coalesce("m.__r", F.lit("")), F.lit("\n"))
    return last.select(*keys, line.alias("history"))


def document_blocks(docs: DataFrame, keys: list[str], order: str, filename: str = "filename", text: str = "extracted_text") -> DataFrame:
    """One row for each document with text: keys, number (1-based in upload order of those not null), block.

    Null texts are not numbered; empty ones are, but give no block.
    """
    rows = docs.where(F.col(text).isNotNull())
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    tag = lambda end: F.concat(F.lit("[PDF "), F.col("number").cast("string"), F.lit(f" Content {end}: "), F.col(filename), F.lit("]"))
    close = F.concat(F.lit("[PDF "), F.col("number").cast("string"), F.lit(" Content End]"))
    block = F.concat(tag("Start"), F.lit("\n"), F.col(text), F.lit("\n"), close, F.lit("\n"))
    return rows.withColumn("number", n).where(F.length(text) > 0).select(*keys, "number", block.alias("block"))


def document_context(docs: DataFrame, keys: list[str], order: str, **names: str) -> DataFrame:
    blocks = document_blocks(docs, keys, order, **names)
    return blocks.groupBy(*keys).agg(joined(F.col("block"), F.col("number")).alias("documents"))


def _field(x: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(x), F.lit("")), F.lit(default))


def clean_hits(hits: DataFrame) -> DataFrame:
    """title, content, url with defaults; raw hits have title, body, href."""
    own = [c for c in hits.columns if c not in ("title", "body", "href")]
    return hits.select(*own, _field("title", NO_TITLE).alias("title"), _field("body", NO_CONTENT).alias("content"), _field("href", NO_URL).alias("url"))


def search_context(hits: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """keys, block, n_results, n_valid, chars, status: one row for each group of ranked hits.

    Sources keep the number of their rank, so hits without title and content, which are left out, leave gaps. If
    all are left out the block is empty.
    """
    empty = (F.coalesce("title", F.lit("")) == "") & (F.coalesce("body", F.lit("")) == "")
    line = F.concat(F.lit("Source "), F.col(rank).cast("string"), F.lit(": "), _field("title", NO_TITLE), F.lit("\nURL: "), _field("href", NO_URL), F.lit("\nContent: "), _field("body", NO_CONTENT), F.lit("\n\n"))
    got = hits.groupBy(*keys).agg(joined(F.when(~empty, line), F.col(rank)).alias("lines"), F.count("*").alias("n_results"), F.count_if(~empty).alias("n_valid"))
    full = F.concat(F.lit(SEARCH_START), F.col("lines"), F.lit(SEARCH_END))
    got = got.withColumn("chars", F.length(full)).withColumn("block", F.when(F.col("n_valid") > 0, full).otherwise(""))
    return got.select(*keys, "block", "n_results", "n_valid", "chars", status("n_results", "n_valid", "chars").alias("status"))


def status(n: str, n_valid: str, chars: str) -> Column:
    return F.when(F.col(n) == 0, "No results found").when(F.col(n_valid) == 0, "All results empty").when(F.col(chars) < MIN_BLOCK, "not successful").otherwise("success")


def prompt(documents: Column, search: Column, history: Column, question: Column) -> Column:
    """Documents, search results, history, then the question; null parts are empty."""
    part = lambda x: F.coalesce(x, F.lit(""))
    return F.concat(part(documents), part(search), part(history), F.lit(ASK), question, F.lit(ANSWER))


def chain(models: dict, names: list[str], text: str) -> str:
    """Each model's answer is the next one's prompt; an unknown name or a failing model resets to the first prompt."""
    current = text
    for n in names:
        try:
            current = models[n](current)
        except Exception:
            current = text
    return current
