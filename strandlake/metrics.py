"""Stage timers and their sinks."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "stage string, iteration int, ms double, rows long"


class Recorder:
    """Collects (stage, iteration, ms, rows); rows is null where it was not counted."""

    def __init__(self) -> None:
        self.found: list[tuple[str, int, float, int | None]] = []

    @contextmanager
    def stage(self, name: str, iteration: int = 0):
        note: dict[str, int | None] = {"rows": None}
        began = time.perf_counter()
        try:
            yield note
        finally:
            self.found.append((name, iteration, (time.perf_counter() - began) * 1000, note["rows"]))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.found, SCHEMA)

    def sums(self, spark: SparkSession) -> DataFrame:
        return self.frame(spark).groupBy("stage").agg(F.sum("ms").alias("ms"), F.count("*").alias("iterations"))

    def write_csv(self, spark: SparkSession, path: str) -> None:
        """`;`-separated, appended."""
        self.frame(spark).coalesce(1).write.mode("append").option("sep", ";").csv(path)

    def write_json(self, spark: SparkSession, path: str) -> None:
        self.frame(spark).coalesce(1).write.mode("append").json(path)
