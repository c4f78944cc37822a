"""Spark session with the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Session settings; those of an existing session stay where the user has set them.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get(app: str = "tabulon", **settings: str) -> SparkSession:
    """The running session, or a new one with SETTINGS and the given ones (dots as double underscores)."""
    active = SparkSession.getActiveSession()
    if active:
        return active
    conf = SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}
    return SparkSession.builder.appName(app).config(map=conf).getOrCreate()


def table(spark: SparkSession, folder: str, name: str):
    return spark.read.parquet(f"{folder}/{name}.parquet")
