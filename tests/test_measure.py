"""Micro-benchmarks, expansion of long rows and the scans and folds built on them."""

import pytest
from pyspark.sql import functions as F

from strandlake import measure
from strandlake.operators import primitives as P
from strandlake.operators.suffix import single_suffix_array


def test_micro_benchmarks_check_themselves(spark):
    for got in (measure.all_to_all(spark, 5000, 4, 2), measure.sample_sort(spark, 3, 3), measure.one_core(spark, b"banana" * 50, 2)):
        rows = got.collect()
        assert rows and all(r.right and r.ms > 0 for r in rows)
    assert [r.rows for r in measure.sample_sort(spark, 3, 3, 4).collect()] == [9, 21, 45]
    assert measure.all_to_all(spark, 0, 2, 1).first().right


@pytest.mark.parametrize("text", [b"", b"a", b"aaaa", b"banana", bytes(range(256)) * 3, b"\x00\xff" * 40])
def test_single_suffix_array(text):
    assert single_suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_work_items_of_long_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "ITEMS", 7)
    counts = {1: 0, 2: 1, 3: 7, 4: 8, 5: 50, 6: -2, 7: None}
    df = spark.createDataFrame(list(counts.items()), "s long, n int")
    want = sorted((s, r) for s, n in counts.items() for r in range(n or 0))
    assert sorted(map(tuple, P.load_balance_search(df, "s", "n").collect())) == want
    got = P.workcreate(df.withColumn("copy", F.lit("own")), F.col("n"))
    assert got.columns == ["s", "n", "copy"] and sorted((r.s, r.copy) for r in got.collect()) == want


def test_lbs_segreduce(spark):
    df = spark.createDataFrame([("a", 3), ("b", 0), (None, 2), ("c", None), ("d", 1), ("d", 2)], "s string, n long")
    by = lambda f, **k: {r.s: r.value for r in P.lbs_segreduce(df, "s", "n", f, **k).collect()}
    assert by(lambda s, r: r + 1) == {"a": 6, "b": 0, None: 3, "c": 0, "d": 4}
    assert by(lambda s, r: r, fold=F.max, init=-1) == {"a": 2, "b": -1, None: 1, "c": -1, "d": 1}
    assert P.lbs_segreduce(df.limit(0), "s", "n", lambda s, r: r).count() == 0


def test_scan_event_and_transform_scan(spark):
    df = spark.createDataFrame([(None, 1, 5), (None, 2, None), ("x", 3, 7), ("x", 4, -9)], "s string, i long, v long")
    scan, totals = P.scan_event(df, ["i"], F.col("v") * 2, "o", segment=["s"])
    assert {r.i: r.o for r in scan.collect()} == {1: 0, 2: 10, 3: 0, 4: 14}
    assert {r.s: r.total for r in totals.collect()} == {None: 10, "x": -4}
    assert scan.columns == ["s", "i", "v", "o"]
    none, total = P.scan_event(df.limit(0), ["i"], F.col("v"), "o")
    assert none.count() == 0 and total.first().total is None
    assert {r.i: r.o for r in P.transform_scan(df, ["i"], F.abs("v"), "o", "max", inclusive=True).collect()} == {1: 5, 2: 5, 3: 7, 4: 9}


def test_binary_search_partitions(spark):
    df = spark.createDataFrame([(k,) for k in [0, 3, 3, 4, 9, None, 12]], "k long")
    keys = [0, 3, 3, 4, 9, 12]
    for bound, less in (("lower", lambda k, t: k < t), ("upper", lambda k, t: k <= t)):
        got = sorted(map(tuple, P.binary_search_partitions(df, "k", 10, 3, bound).collect()))
        assert got == [(i, t, sum(less(k, t) for k in keys)) for i, t in enumerate([0, 3, 6, 9, 10])]
    assert [tuple(r) for r in P.binary_search_partitions(df.limit(0), "k", 0, 5).collect()] == [(0, 0, 0)]
    with pytest.raises(ValueError):
        P.binary_search_partitions(df, "k", 5, 0)
