"""Search services as ranked source tables: a connector is a name and a function, so no service is built in."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import topup

HIT = "pos int, title string, body string, href string, engine string"


@dataclass(frozen=True)
class Connector:
    """fetch(query, limit) gives hits as dicts with title, body, href, in rank order."""

    name: str
    fetch: Callable[[str, int], Iterable[dict]]
    limit: int = 5

    def table(self, spark: SparkSession, query: str) -> DataFrame:
        """At most `limit` hits; a failing service is an empty source."""
        try:
            hits = [*self.fetch(query, self.limit)][: self.limit]
        except Exception:
            hits = []
        return spark.createDataFrame([(i, h.get("title"), h.get("body"), h.get("href"), self.name) for i, h in enumerate(hits)], HIT)


def search(spark: SparkSession, query: str, answers: Connector, news: Connector, web: Connector, most: int | None = None) -> DataFrame:
    """Hits of three services by the top-up rules, in order of rank."""
    return topup.topup(*(c.table(spark, query) for c in (answers, news, web)), pos="pos", most=most).orderBy("rank")
