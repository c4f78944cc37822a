"""Event lines: one JSON object a line, from files or packets that cut lines anywhere."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "type string, content string, message string, response string, done boolean"


def read_events(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """Parsed lines of text files; lines that are no JSON object are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("e"))
    return parsed.where("e is not null and e._bad is null").select("e.*").drop("_bad")


def until_done(events: Iterable[dict]) -> Iterator[dict]:
    for e in events:
        yield e
        if e.get("done"):
            return


def reassemble(packets: Iterable[bytes]) -> Iterator[dict]:
    """Objects from packets in order, a line cut between packets put together; bad lines are left out."""
    rest = b""
    for p in chain(packets, [b"\n"]):
        *lines, rest = (rest + p).split(b"\n")
        for line in lines:
            try:
                x = json.loads(line)
            except ValueError:
                continue
            if isinstance(x, dict):
                yield x
