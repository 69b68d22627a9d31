"""Scans and merges over segments that span tasks."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from strandlake.operators import primitives as P
from strandlake.operators.scan import segmented_scan
from strandlake.operators.suffix import suffix_array


@pytest.mark.parametrize("kind", ["sum", "max"])
@pytest.mark.parametrize("inclusive", [True, False])
def test_segmented_scan(spark, kind, inclusive):
    r = random.Random(3)
    rows = [(0 if r.random() < 0.6 else r.randint(1, 9), i, None if r.random() < 0.05 else r.randint(-50, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "s long, i long, v long").repartition(7)
    got = {x.i: x.o for x in segmented_scan(df, ["s"], ["i"], "v", "o", kind, inclusive).collect()}
    at, low = {}, -(2**63)
    for s, i, v in rows:
        before = at.get(s, 0 if kind == "sum" else low)
        after = before + (v or 0) if kind == "sum" else max(before, low if v is None else v)
        at[s] = after
        want = after if inclusive else before
        assert got[i] == (None if want == low else want)


def test_one_segment_and_empty(spark):
    df = spark.range(1000).selectExpr("id as i", "1L as v")
    assert sorted(r.o for r in segmented_scan(df, [], ["i"], "v", "o").collect()) == list(range(1, 1001))
    assert segmented_scan(df.where("i < 0"), [], ["i"], "v", "o").count() == 0


def test_remerge_of_a_permutation(spark):
    n = 4000
    values = list(range(1, n + 1))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v % 3, v) for v in values], "range long, key long").repartition(8)
    got = P.remerge(df, "range", ["key"]).collect()
    for k in range(3):
        assert [r.key for r in sorted((r for r in got if r["range"] == k), key=lambda r: r.rn)] == sorted(v for v in values if v % 3 == k)


def test_distributed_merge_of_even_and_odd(spark):
    a, b = spark.range(0, 2000, 2).toDF("key"), spark.range(1, 2001, 2).toDF("key")
    assert all(r.key == r.rn for r in P.distributed_merge(a, b, ["key"]).collect())


def test_kselect_and_split(spark):
    df = spark.createDataFrame([(v,) for v in [5, 1, 4, 1, 3]], "v long")
    assert [P.kselect(df, ["v"], k).collect()[0].v for k in range(5)] == [1, 1, 3, 4, 5]
    assert P.kselect(df, ["v"], 5).count() == 0
    assert [tuple(r) for r in P.merge_path_split(df, df, ["v"], [3]).collect()] == [(3, 2, 1)]


def test_scans_of_other_types(spark):
    rows = [("a", 1, 0.5, Decimal("0.50")), ("a", 2, 0.75, Decimal("0.75")), ("a", 3, None, None), ("b", 4, 2.5, Decimal("-2.50")), (None, 5, 1e300, Decimal("1.00")), (None, 6, 1.0, Decimal("2.00"))]
    df = spark.createDataFrame(rows, "s string, i long, x double, d decimal(10,2)")
    got = {r.i: r.o for r in segmented_scan(df, ["s"], ["i"], "x", "o").collect()}
    assert got == {1: 0.5, 2: 1.25, 3: 1.25, 4: 2.5, 5: 1e300, 6: 1e300 + 1}
    got = {r.i: r.o for r in segmented_scan(df, ["s"], ["i"], "d", "o").collect()}
    assert got == {1: Decimal("0.50"), 2: Decimal("1.25"), 3: Decimal("1.25"), 4: Decimal("-2.50"), 5: Decimal("1.00"), 6: Decimal("3.00")}
    got = {r.i: r.o for r in segmented_scan(df, ["s"], ["i"], "x", "o", "max", False).collect()}
    assert got == {1: None, 2: 0.5, 3: 0.75, 4: None, 5: None, 6: 1e300}
    with pytest.raises(ValueError):
        segmented_scan(df, [], ["i"], "s", "o")


def test_least_long_is_a_maximum(spark):
    df = spark.createDataFrame([(1, None), (2, -(2**63)), (3, None), (4, 5)], "i long, v long")
    assert {r.i: r.o for r in segmented_scan(df, [], ["i"], "v", "o", "max").collect()} == {1: None, 2: -(2**63), 3: -(2**63), 4: 5}


def test_segments_of_strings_span_tasks(spark):
    rows = [("hot" if i % 3 else f"s{i % 5}", i) for i in range(2000)] + [(None, i) for i in range(2000, 2100)]
    df = spark.createDataFrame(rows, "s string, i long").repartition(9)
    at, want = {}, {}
    for s, i in rows:
        want[i] = at[s] = at.get(s, -1) + 1
    assert {r.i: r.rn for r in P.segmented_sort(df, "s", ["i"]).collect()} == want


def test_null_needles_and_neighbours(spark):
    hay = spark.createDataFrame([(1,), (3,), (3,), (None,)], "k long")
    got = {r.x: r.place for r in P.sorted_search(spark.createDataFrame([(None,), (3,), (9,)], "x long"), "x", hay, "k").collect()}
    assert got == {None: None, 3: 1, 9: 3}
    df = spark.createDataFrame([(0, 0, 1), (0, 1, None), (0, 2, None), (0, 3, 2)], "s long, i long, v long")
    assert [r["head"] for r in P.heads(df, ["s"], ["i"], "v").orderBy("i").collect()] == [True, True, False, True]
    assert [r["unique"] for r in P.neighbours_differ(df, ["s"], ["i"], "v").orderBy("i").collect()] == [True, False, False, True]


def test_result_names_replace_columns(spark):
    df = spark.createDataFrame([(3, "a", 2), (1, "b", 0)], "v long, rn string, _n long")
    assert [(r.v, r.rn) for r in P.numbered(df, ["v"]).orderBy("v").collect()] == [(1, 0), (3, 1)]
    assert [(r.v, r._n, r["copy"]) for r in P.workcreate(df, F.col("_n")).orderBy("copy").collect()] == [(3, 2, 0), (3, 2, 1)]


def test_ids_must_tell_texts_apart(spark):
    df = spark.createDataFrame([(1, "ab"), (1, "ba")], "doc_id long, text string")
    for strategy in ("doubling", "dc3"):
        with pytest.raises(ValueError):
            suffix_array(df, strategy=strategy)
    assert suffix_array(df).count() == 4


def test_kselect_by_bounds(spark):
    """Beyond the sample's size: bounds, ties, nulls, few distinct keys, strings."""
    rows = [(None if i % 97 == 0 else (i * 7919) % 5003, f"s{i % 3}", i) for i in range(9000)]
    df = spark.createDataFrame(rows, "v long, s string, i long")
    for order in (["v", "i"], ["s", "i"], ["i"]):
        at = ["vsi".index(c) for c in order]
        key = lambda r: [(r[c] is not None, r[c] or 0) if c != 1 else r[c] for c in at]  # noqa: E731, B023
        want = sorted(rows, key=key)
        for k in (0, 50, 4500, 8999):
            assert tuple(P.kselect(df, order, k).first()) == want[k]
    assert P.kselect(df, ["s"], 5000).first().s == "s1"
    assert P.kselect(df, ["v"], 9000).count() == P.kselect(df, ["v"], -1).count() == 0


def test_kselect_sorts_only_what_lies_between(spark, monkeypatch):
    seen, numbered = [], P.numbered
    monkeypatch.setattr(P, "numbered", lambda df, order: seen.append(df.count()) or numbered(df, order))
    df = spark.range(100000).select((F.col("id") * 7919 % 100003).alias("v"))
    want = sorted(i * 7919 % 100003 for i in range(100000))
    assert P.kselect(df, ["v"], 60000).first().v == want[60000]
    assert seen[0] < 20000


def test_partition_points(spark):
    sides = [[1, 1, 4], [1, 2, 9, 9], [], [0, 2, 9]]
    dfs = [spark.createDataFrame([(v,) for v in s], "v long") for s in sides]
    merged = sorted((v, i) for i, s in enumerate(sides) for v in s)
    got = {r[0]: tuple(r[1:]) for r in P.partition_points(dfs, ["v"], [0, 3, 3, 7, 10, 11]).collect()}
    assert got == {d: tuple(sum(i == side for _, i in merged[:d]) for side in range(4)) for d in (3, 7, 10)}
    assert P.partition_points(dfs, ["v"], []).count() == 0


def test_a_large_bucket_takes_several_partitions(spark, monkeypatch):
    """Nine tenths of the rows, of which many are equal, are in one bucket; no partition holds two buckets."""
    monkeypatch.setattr(P, "SHARE", 4096)
    i = F.col("id")
    df = spark.range(0, 4000, 1, 8).select((i % 3).alias("x"), F.when(i % 2 == 0, "a").alias("s"), F.create_map(F.lit("k"), F.lit(1)).alias("m"), F.when(i % 10 > 0, 5).when(i % 20 > 0, -2).alias("b"))
    for got, name in ((P.multisplit(df, F.col("b"), 4), "bucket"), (P.exchange(df, F.col("b"), 4), "dest")):
        rows = got.select("x", "s", "b", F.col(name).alias("own"), F.spark_partition_id().alias("at")).collect()
        assert sorted(map(str, (r[:3] for r in rows))) == sorted(str(tuple(r)) for r in df.select("x", "s", "b").collect()) and all(r.b == r.own for r in rows)
        held, size = {}, {}
        for r in rows:
            held.setdefault(r["at"], set()).add(r.own)
            size[r["at"]] = size.get(r["at"], 0) + 1
        assert all(len(h) == 1 for h in held.values()) and max(size.values()) < 1000
        order = [next(iter(h)) for _, h in sorted(held.items())]
        assert order == sorted(order, key=lambda b: (b is not None, b or 0)) and set(order) == {None, -2, 5}
    few = P.multisplit(df.limit(0), F.col("b"), 4)
    assert few.count() == 0 and few.columns == [*df.columns, "bucket"]
