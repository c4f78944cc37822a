"""Datasets, documents and turns kept as parquet under one folder, with a catalog."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import reshape
from .plans.sql import safe_name
from .sources import csv_ingest, documents

CATALOG = "id string, user_id long, session_id string, filename string, file_path string, columns_info string, table_name string, timestamp timestamp"
INFO = "columns array<string>, dtypes map<string,string>, shape struct<rows:long,cols:int>, sample array<map<string,string>>"
DOCUMENT = "id string, user_id long, session_id string, filename string, extracted_text string, timestamp timestamp"
TURN = "id string, user_id long, session_id string, prompt string, response string, timestamp timestamp"
SAMPLE_ROWS = 5


@dataclass
class Store:
    """All tables lie under `root`, in any file system that Spark writes to. Appends add files; a dataset is replaced whole."""

    spark: SparkSession
    root: str

    def _path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def _read(self, name: str, schema: str) -> DataFrame:
        self._restore(name)
        try:
            return self.spark.read.schema(schema).parquet(self._path(name))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, name: str, rows: list[tuple], schema: str) -> None:
        self.spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(self._path(name))

    @staticmethod
    def _stamp() -> tuple[str, dt.datetime]:
        return uuid.uuid4().hex, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)

    def save_dataset(self, df: DataFrame, name: str) -> str:
        """Write a frame as the table `name` (made safe), replacing an older one, and register it as a view."""
        name = safe_name(name)
        df.write.mode("overwrite").parquet(self._path(f"data/{name}"))
        self.spark.read.parquet(self._path(f"data/{name}")).createOrReplaceTempView(name)
        return name

    def dataset(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(f"data/{safe_name(name)}"))

    def ingest_dataset(self, path: str, user_id: int, session_id: str, filename: str | None = None, compat: bool = False) -> dict:
        """Read a CSV file, keep it as a dataset, catalog it; returns its profile. ValueError for other or empty files."""
        filename = filename or path.rsplit("/", 1)[-1]
        if not filename.lower().endswith(".csv"):
            raise ValueError("only CSV files are taken")
        df = csv_ingest.read_csv(self.spark, path, compat)
        if df is None:
            raise ValueError("the file has no rows")
        key, now = self._stamp()
        name = self.save_dataset(df, f"data_{user_id}_{session_id}_{int(now.timestamp())}_{key[:6]}")
        kept = self.dataset(name)
        sample = [r.asDict() for r in kept.limit(SAMPLE_ROWS).collect()]
        info = {"columns": kept.columns, "dtypes": dict(kept.dtypes), "shape": {"rows": kept.count(), "cols": len(kept.columns)}, "sample": [{k: None if v is None else str(v) for k, v in r.items()} for r in sample]}
        self._append("catalog", [(key, user_id, session_id, filename, path, json.dumps(info), name, now)], CATALOG)
        return {"filename": filename, "table_name": name, **info}

    def dataset_info(self, user_id: int, session_id: str) -> dict:
        """has_csv, and the latest dataset's catalog row with its profile."""
        rows = self._read("catalog", CATALOG).where((F.col("user_id") == user_id) & (F.col("session_id") == session_id))
        last = reshape.latest_per_session(rows, ["user_id", "session_id"], ["timestamp", "id"])
        got = last.withColumn("info", F.from_json("columns_info", INFO)).select("filename", "table_name", "timestamp", "info.*").collect()
        return {"has_csv": False} if not got else {"has_csv": True, **got[0].asDict(recursive=True)}

    def latest_dataset(self, user_id: int, session_id: str) -> DataFrame | None:
        info = self.dataset_info(user_id, session_id)
        return self.dataset(info["table_name"]) if info["has_csv"] else None

    def add_documents(self, path: str, user_id: int, session_id: str) -> DataFrame:
        """Read the files at a path or glob in parallel and append their texts."""
        _, now = self._stamp()
        got = documents.read_documents(self.spark, path)
        rows = got.select(F.expr("uuid()").alias("id"), F.lit(user_id).cast("long").alias("user_id"), F.lit(session_id).alias("session_id"), "filename", "extracted_text", F.lit(now).cast("timestamp").alias("timestamp"))
        rows.write.mode("append").parquet(self._path("documents"))
        return self.documents(user_id, session_id)

    def documents(self, user_id: int, session_id: str) -> DataFrame:
        return self._read("documents", DOCUMENT).where((F.col("user_id") == user_id) & (F.col("session_id") == session_id))

    def add_turn(self, user_id: int, session_id: str, prompt: str, response: str) -> None:
        key, now = self._stamp()
        self._append("turns", [(key, user_id, session_id, prompt, response, now)], TURN)

    def history(self, user_id: int, session_id: str) -> DataFrame:
        return reshape.session_history(self._read("turns", TURN), {"user_id": user_id, "session_id": session_id}, ["timestamp", "id"])

    def sessions(self, user_id: int) -> DataFrame:
        """session_id, title (first 20 characters of the last prompt), last, newest first."""
        mine = self._read("turns", TURN).where(F.col("user_id") == user_id)
        last = reshape.latest_per_session(mine, ["user_id", "session_id"], ["timestamp", "id"])
        return last.select("session_id", F.substring("prompt", 1, 20).alias("title"), F.col("timestamp").alias("last")).orderBy(F.desc("last"), "session_id")

    def forget(self, user_id: int) -> None:
        """Delete a user's turns; those of a null user stay.

        The others are written to a new folder. The old one is kept under another name until the new one stands in its place, and _restore puts
        it back after a crash in between.
        """
        self._restore("turns")
        rest = self._read("turns", TURN).where(~F.col("user_id").eqNullSafe(F.lit(user_id)))
        p, fs = self._files()
        new, old = self._path(f"turns-{uuid.uuid4().hex}"), self._path("turns-before")
        rest.write.parquet(new)
        if fs.exists(p(self._path("turns"))):
            fs.rename(p(self._path("turns")), p(old))
        fs.rename(p(new), p(self._path("turns")))
        fs.delete(p(old), True)

    def _files(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return p, p(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _restore(self, name: str) -> None:
        """If a crash left only the folder kept from before a change, take it back."""
        p, fs = self._files()
        if not fs.exists(p(self._path(name))) and fs.exists(p(self._path(f"{name}-before"))):
            fs.rename(p(self._path(f"{name}-before")), p(self._path(name)))


def jsonl(df: DataFrame) -> DataFrame:
    """Rows as JSON lines, for df.write.text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
