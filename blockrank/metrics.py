"""Counts and latencies of requests: each request's plan is observed, so nothing is computed twice for its figures."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Upper bounds of the histogram, in seconds.
BOUNDS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 300.0)
SCHEMA = "kind string, status string, seconds double, rows long, queries long, at timestamp"


class Metrics:
    """A log of requests under a folder. `run` does a request and logs it; tables read the log back."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def run(self, kind: str, plan: DataFrame, action=DataFrame.collect, **extra: Column):
        """action(plan), logged with its time, the rows that it gave and the distinct query_ids among them (about, by a
        sketch), and status `success` or `failed`. extra: further aggregates, in `last` afterwards."""
        seen = Observation(f"{kind}-{uuid.uuid4().hex}")
        figures = {"rows": F.count(F.lit(1)), **extra}
        if "query_id" in plan.columns:
            figures["queries"] = F.approx_count_distinct("query_id")
        watched = plan.observe(seen, *(c.alias(k) for k, c in figures.items()))
        began = time.monotonic()
        try:
            out = action(watched)
        except Exception:
            self._log(kind, "failed", time.monotonic() - began, {})
            raise
        self.last = seen.get
        self._log(kind, "success", time.monotonic() - began, self.last)
        return out

    def _log(self, kind: str, status: str, seconds: float, found: dict) -> None:
        row = [(kind, status, seconds, found.get("rows"), found.get("queries"))]
        self.spark.createDataFrame(row, "kind string, status string, seconds double, rows long, queries long").withColumn("at", F.current_timestamp()).write.mode("append").parquet(self.root)

    def requests(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.root)

    def counts(self) -> DataFrame:
        """kind, status, requests, rows."""
        return self.requests().groupBy("kind", "status").agg(F.count(F.lit(1)).alias("requests"), F.sum("rows").alias("rows"))

    def latencies(self) -> DataFrame:
        """kind, le, requests: how many took at most le seconds, for each of BOUNDS and without bound (infinity)."""
        each = self.requests().select("kind", F.explode(F.array(*map(F.lit, (*BOUNDS, float("inf"))))).alias("le"), (F.col("seconds") <= F.col("le")).cast("long").alias("within"))
        return each.groupBy("kind", "le").agg(F.sum("within").alias("requests"))
