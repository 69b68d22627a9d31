"""Scans: prefix sums and maxima in segments of any size.

A window needs all rows of its partition in one task. Here rows are
range-partitioned by (segment, order) instead, each task scans what it has in
one pass, and one row a task comes to the driver, which adds up what is
carried from task to task. A segment may span any number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settled

FOLDS = {"sum": np.add, "max": np.maximum}
_OWN = ("__pid", "__at", "__has", "__run", "__value")


def _local(values: np.ndarray, starts: np.ndarray, kind: str) -> np.ndarray:
    """Inclusive scan that starts anew where `starts` is set."""
    if kind == "sum" and values.dtype == np.int64:
        c = np.cumsum(values)
        first = np.maximum.accumulate(np.where(starts, np.arange(len(values)), 0))
        return c - (c[first] - values[first])
    seg, out, step = np.cumsum(starts), values.copy(), 1
    while step < len(values):  # doubling: log(n) passes; nothing of one segment touches another's rounding
        same = seg[step:] == seg[:-step]
        if not same.any():
            break
        out[step:] = np.where(same, FOLDS[kind](out[step:], out[:-step]), out[step:])
        step *= 2
    return out


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before; null equals null only."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differ = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(differ, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)


def segmented_scan(df: DataFrame, segment: list[str], order: list[str], value: str, out: str, kind: str = "sum", inclusive: bool = True) -> DataFrame:
    """df with `out`: the sum or maximum of `value` over the segment's rows up to here.

    segment: columns of any type that can be ordered, none for one segment;
    null is a segment of its own. order: columns that decide the order in it.
    Values may be integers (the result is long), floats (double) or decimals of
    up to 18 digits (decimal(38, s)); other types raise ValueError. Exclusive
    scans give 0 for a sum and null for a maximum at a segment's first row. A
    null value counts as nothing. A column named `out` is replaced; columns
    that begin with two underscores and are named as those in use here raise.
    """
    clash = [c for c in _OWN if c in df.columns]
    if clash:
        raise ValueError(f"columns exist already: {clash}")
    given, scale = df.schema[value].dataType, None
    own = F.col(f"`{value}`")
    if isinstance(given, T.DecimalType) and given.precision <= 18:
        scale, own = given.scale, (own * F.lit(Decimal(10) ** given.scale)).cast("long")
    elif not isinstance(given, T.IntegralType | T.FractionalType) or isinstance(given, T.DecimalType):
        raise ValueError(f"cannot scan {given.simpleString()}")
    real = scale is None and isinstance(given, T.FractionalType)
    fold, kind_of = FOLDS[kind], "double" if real else "long"
    zero = 0 if kind == "sum" else -np.inf if real else np.iinfo(np.int64).min
    zero = np.float64(zero) if real else np.int64(zero)
    keys = [F.col(f"`{c}`") for c in (*segment, *order)]
    dealt = df.withColumn("__value", own.cast(kind_of)).repartitionByRange(*keys).sortWithinPartitions(*keys)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, carry, had, run = TaskContext.get().partitionId(), None, zero, False, 0
        for b in batches:
            if not b.num_rows:
                continue
            column = b.column(b.schema.get_field_index("__value"))
            has = column.is_valid().to_numpy(zero_copy_only=False)
            v = column.fill_null(zero.item()).to_numpy(zero_copy_only=False)
            seg = [b.column(b.schema.get_field_index(s)) for s in segment]
            starts = np.zeros(len(v), bool)
            for s in seg:
                starts[1:] |= _changes(s)
            head = [s[0].as_py() for s in seg]
            starts[0] = head != last
            runs = run + np.cumsum(starts)
            fresh = starts | (np.arange(len(v)) == 0)
            scanned, any_ = _local(v, fresh, kind), _local(has.astype(np.int64), fresh, "max") > 0
            upto = np.flatnonzero(starts)[0] if starts.any() else len(v)
            scanned[:upto] = fold(scanned[:upto], carry)
            any_[:upto] |= had
            at, known = scanned, any_
            if not inclusive:
                at, known = np.empty_like(scanned), np.empty_like(any_)
                at[1:], known[1:] = np.where(starts[1:], zero, scanned[:-1]), ~starts[1:] & any_[:-1]
                at[0], known[0] = (zero, False) if starts[0] else (carry, had)
            last, carry, had, run = [s[-1].as_py() for s in seg], scanned[-1], bool(any_[-1]), int(runs[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(v), pid, np.int64)), pa.array(at), pa.array(known), pa.array(runs.astype(np.int64))], names=[*b.schema.names, "__pid", "__at", "__has", "__run"])

    more = [T.StructField("__pid", T.LongType()), T.StructField("__at", T.DoubleType() if real else T.LongType()), T.StructField("__has", T.BooleanType()), T.StructField("__run", T.LongType())]
    local = settled(dealt.mapInArrow(scan, T.StructType([*dealt.schema.fields, *more])), "scan")
    seg = F.struct(*(F.col(f"`{s}`") for s in segment)) if segment else F.struct(F.lit(0).alias("none"))
    runs = local.groupBy("__pid", "__run").agg(F.first(seg).alias("seg"), (F.sum if kind == "sum" else F.max)("__value").alias("t"))
    ends = runs.groupBy("__pid").agg(F.min_by("seg", "__run").alias("head"), F.max_by("seg", "__run").alias("tail"), F.max_by("t", "__run").alias("t"), F.max("__run").alias("n"))
    carried, tail, carry, had = [], None, zero, False
    for r in sorted(ends.collect(), key=lambda r: r["__pid"]):  # one row a task
        if tail != tuple(r["head"]):
            carry, had = zero, False
        carried.append((r["__pid"], carry.item(), had))
        if r["n"] > 1:
            carry, had = zero, False
        own_t = zero if r["t"] is None else zero.dtype.type(r["t"])
        carry, had, tail = zero.dtype.type(fold(carry, own_t)), had or r["t"] is not None, tuple(r["tail"])
    table = df.sparkSession.createDataFrame(carried, f"__pid long, __carry {kind_of}, __had boolean")
    at = F.col("__at") + F.col("__carry") if kind == "sum" else F.greatest("__at", "__carry")
    at = F.when(F.col("__run") == 1, at).otherwise(F.col("__at"))
    if kind == "max":
        at = F.when(F.col("__has") | ((F.col("__run") == 1) & F.col("__had")), at)
    if scale is not None:
        at = (at.cast("decimal(38,0)") * F.lit(Decimal(1).scaleb(-scale))).cast(f"decimal(38,{scale})")
    joined = local.join(F.broadcast(table), "__pid")
    return joined.withColumn(out, at).drop("__carry", "__had", *_OWN)
