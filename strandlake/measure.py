"""Micro-benchmarks of an exchange, of a distributed sort and of the kernel on one core."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import primitives as P
from .operators.suffix import single_suffix_array

SCHEMA = "name string, round int, rows long, ms double, mb_per_s double, right boolean"
SEED = 11


def _frame(spark: SparkSession, found: list[tuple]) -> DataFrame:
    return spark.createDataFrame(found, SCHEMA)


def _row(name: str, number: int, rows: int, size: int, seconds: float, right: bool) -> tuple:
    return name, number, rows, seconds * 1000, rows * size / 1e6 / seconds, right


def all_to_all(spark: SparkSession, rows: int, nodes: int, rounds: int = 3) -> DataFrame:
    """Numbers 0 to rows - 1 in mixed order go from `nodes` partitions to `nodes` targets, an equal share each.

    One row a round; `right` says that each number came once, to a partition
    that no other target's numbers are in. Rates count 8 bytes a row. The time
    holds the count by target and the check's sums.
    """
    found = []
    for number in range(rounds):
        began = time.perf_counter()
        sent = spark.range(0, rows, 1, nodes).select(F.col("id").alias("key"), F.pmod(F.xxhash64("id", F.lit(SEED + number)), F.lit(nodes)).alias("to"))
        got = P.exchange(sent, F.col("to"), nodes).groupBy(F.spark_partition_id().alias("at"), "dest").agg(F.count("*").alias("n"), F.sum("key").alias("sum"))
        whole = got.groupBy("at").agg(F.count("*").alias("targets"), F.sum("n").alias("n"), F.sum("sum").alias("sum"))
        most, n, total = whole.agg(F.max("targets"), F.sum("n"), F.sum("sum")).first()
        right = (n or 0) == rows and (total or 0) == rows * (rows - 1) // 2 and (most or 1) == 1
        found.append(_row("all_to_all", number, rows, 8, time.perf_counter() - began, right))
    return _frame(spark, found)


def sample_sort(spark: SparkSession, nodes: int, rounds: int = 10, first: int = 128) -> DataFrame:
    """Random longs, (first << round) - 1 a node, are brought into one order.

    One row a round; `right` says that places and keys agree: no key stands
    before a smaller one, and each place is taken once.
    """
    found = []
    for number in range(rounds):
        rows = ((first << number) - 1) * nodes
        began = time.perf_counter()
        keys = spark.range(0, rows, 1, nodes).select(F.xxhash64("id", F.lit(SEED + number)).alias("key"), "id")
        n, places, least, most = (sorted_ := P.numbered(keys, ["key", "id"])).agg(F.count("*"), F.sum("rn"), F.min("rn"), F.max("rn")).first()
        seconds = time.perf_counter() - began
        # the running maximum of the keys, by place, is the key itself
        top = P.inclusive_scan(sorted_.select("key", "rn"), ["rn"], "key", "top", "max")
        right = (n, places, least, most) == (rows, rows * (rows - 1) // 2, 0, rows - 1) and top.where("top <> key").isEmpty()
        found.append(_row("sample_sort", number, rows, 8, seconds, right))
    return _frame(spark, found)


def one_core(spark: SparkSession, data: bytes, rounds: int = 3) -> DataFrame:
    """The suffix array of one text in the driver's process; `right` says that it is a permutation."""
    found = []
    for number in range(rounds):
        began = time.perf_counter()
        sa = single_suffix_array(data)
        seconds = time.perf_counter() - began
        found.append(_row("one_core", number, len(data), 1, seconds, sorted(sa.tolist()) == list(range(len(data)))))
    return _frame(spark, found)
