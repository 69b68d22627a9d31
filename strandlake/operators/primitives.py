"""Data-parallel primitives as DataFrame functions.

Partitioning and exchange (multisplit, split_table, exchange), merging
(distributed_merge, remerge, merge_path_split, kselect), segments
(segmented_sort, segmented_reduce, lbs_segreduce, transform_lbs,
load_balance_search), scans, selection, gather / scatter / permute, joins and searches on sorted data, bulk
edits, intervals and sparse products. Each is a composition of built-in
operators; where a global order is needed, `scan.segmented_scan` numbers rows
without bringing them into one task.

A column that bears the name of a result column (bucket, dest, rn, copy, the
`out` of a scan, ...) is replaced by the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import segmented_scan

DRAWN = 4096  # keys that kselect draws for its bounds
ITEMS = 4096  # work items that are one array while a row is expanded
SHARE = 1 << 26  # bytes of rows that one partition of a bucket gets

# --- partitioning and exchange


def _dealt(df: DataFrame, bucket: Column, buckets: int, name: str) -> DataFrame:
    """df with its bucket: no partition holds two, partitions follow the order of the buckets (null first).

    A bucket of more than SHARE bytes takes as many partitions as it has
    shares, so no task's part grows with it. One pass counts rows and bytes by
    bucket (only strings, binaries and nested columns are read for that). A
    row's share comes from its values and the task that has it, which a task
    that is run again finds the same; equal rows of many tasks are spread too.
    """
    rows = df.withColumn(name, bucket.cast("long"))
    own, fixed, loose = [], 16, []
    for f in rows.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.NumericType | T.BooleanType | T.DateType | T.TimestampType | T.TimestampNTZType):
            fixed += 8
        else:
            loose.append(F.coalesce(F.octet_length(c if isinstance(f.dataType, T.StringType | T.BinaryType) else c.cast("string")), F.lit(0)).cast("long"))
        if not any(x in f.dataType.simpleString() for x in ("map<", "variant")):  # these have no hash
            own.append(c)
    size = sum(loose, F.lit(fixed).cast("long"))
    found = sorted(rows.groupBy(F.col(f"`{name}`").alias("b")).agg(F.sum(size).alias("s")).collect(), key=lambda r: (r["b"] is not None, r["b"]))
    table, first = [], 0
    for r in found:  # one row a bucket
        table.append((r["b"], first, shares := -(-r["s"] // SHARE)))
        first += shares
    table = F.broadcast(df.sparkSession.createDataFrame(table, "__b long, __first long, __shares long"))
    share = F.pmod(F.xxhash64(*own) + F.spark_partition_id(), F.col("__shares"))
    placed = rows.join(table, F.col(f"`{name}`").eqNullSafe(F.col("__b"))).withColumn("__to", (F.col("__first") + share).cast("int"))
    return placed.repartitionById(max(first, buckets), F.col("__to")).drop("__b", "__first", "__shares", "__to")


def multisplit(df: DataFrame, bucket: Column, buckets: int, name: str = "bucket") -> DataFrame:
    """df with its bucket, dealt to one partition a bucket, or several of SHARE bytes where it holds more; `buckets` partitions at least."""
    return _dealt(df, bucket, buckets, name)


def multisplit_counts(df: DataFrame, bucket: Column, name: str = "bucket") -> DataFrame:
    """(bucket, n, offset): sizes and first places of the buckets. One row a bucket, so a window over them is small."""
    counts = df.groupBy(bucket.cast("long").alias(name)).agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy(name).rowsBetween(W.unboundedPreceding, -1))
    return counts.select(name, "n", F.coalesce(before, F.lit(0)).cast("long").alias("offset"))


def split_table(df: DataFrame, source: Column, target: Column) -> DataFrame:
    """(src, dest, n): rows that go from each source to each target."""
    return df.groupBy(source.cast("long").alias("src"), target.cast("long").alias("dest")).agg(F.count("*").alias("n"))


def exchange(df: DataFrame, target: Column, targets: int) -> DataFrame:
    """All-to-all: rows move to the partition of their target (of several where it gets more than SHARE bytes)."""
    return _dealt(df, target, targets, "dest")


def validate_exchange(table: DataFrame, sent: DataFrame, received: DataFrame) -> DataFrame:
    """Rows that disagree: sent (src, n) and received (dest, n) against the split table; empty if all is well."""
    by_src = table.groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("planned")).join(sent.select(F.col("src").alias("node"), "n"), "node", "full").withColumn("side", F.lit("sent"))
    by_dest = table.groupBy(F.col("dest").alias("node")).agg(F.sum("n").alias("planned")).join(received.select(F.col("dest").alias("node"), "n"), "node", "full").withColumn("side", F.lit("received"))
    return by_src.unionByName(by_dest).where(~F.col("planned").eqNullSafe(F.col("n")))


# --- global order


def numbered(df: DataFrame, order: list[str], out: str = "rn", segment: list[str] | None = None) -> DataFrame:
    """df with a row number from 0 in the order given (which must be total), by segment."""
    one = df.withColumn("__one", F.lit(1).cast("long"))
    return segmented_scan(one, segment or [], order, "__one", out, inclusive=False).drop("__one")


def distributed_merge(a: DataFrame, b: DataFrame, order: list[str]) -> DataFrame:
    """The rows of both in one global order (range-partitioned, sorted, numbered as rn)."""
    return numbered(a.unionByName(b), order)


def remerge(df: DataFrame, range_col: str, order: list[str]) -> DataFrame:
    """Each range's rows in order, numbered from 0; a range may be of any size."""
    return numbered(df, order, segment=[range_col])


def kselect(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """The k-th row (from 0) in the order given, nulls first; none beyond the end or before the start.

    A sample of DRAWN keys gives two bounds around the k-th; one pass counts
    what lies below and between, and only rows between are sorted. Where the
    bounds miss or hold more than half of the rows (few distinct keys), all are.
    """
    n = df.count()
    if not 0 <= k < n:
        return df.limit(0)
    if n > 4 * DRAWN:
        key = F.struct(*(F.col(f"`{c}`") for c in order))
        names = [f"k{i}" for i in range(len(order))]
        drawn = df.select(*(F.col(f"`{c}`").alias(a) for a, c in zip(names, order, strict=True))).sample(DRAWN / n, 17).orderBy(*names).limit(2 * DRAWN).collect()
        at, margin = k * len(drawn) // n, 4 * int(len(drawn) ** 0.5) + 1
        bound = lambda r: F.struct(*(F.lit(v).cast(df.schema[c].dataType).alias(c) for v, c in zip(r, order, strict=True)))
        low = key < bound(drawn[at - margin]) if at >= margin else F.lit(False)
        high = key > bound(drawn[at + margin]) if at + margin < len(drawn) else F.lit(False)
        below, above = df.agg(F.count_if(low), F.count_if(high)).first()
        if below <= k < n - above and 2 * (below + above) >= n:
            return numbered(df.where(~low & ~high), order).where(F.col("rn") == k - below).drop("rn")
    return numbered(df, order).where(F.col("rn") == k).drop("rn")


def partition_points(sides: list[DataFrame], order: list[str], diagonals: list[int]) -> DataFrame:
    """(diagonal, from_0, from_1, ...): how many of the first `diagonal` merged rows come from each of any number of sides.

    An earlier side comes first on ties. The differences of two rows are the
    counts that a merge with outputs of prescribed sizes takes from each side.
    Diagonals of 0 or beyond the end give no row, repeated ones a single row.
    """
    ends = sorted({d for d in diagonals if d > 0})
    both = sides[0].select(*order, F.lit(0).cast("long").alias("_side"))
    for i, side in enumerate(sides[1:], 1):
        both = both.unionByName(side.select(*order, F.lit(i).cast("long").alias("_side")))
    if not ends:
        both, ends = both.limit(0), [1]
    upto = F.array(*(F.lit(d).cast("long") for d in ends))
    first = F.size(F.filter(upto, lambda d: d <= F.col("rn")))  # the first diagonal that takes the row
    counts = numbered(both, [*order, "_side"]).groupBy(first.alias("_i"), "_side").agg(F.count("*").alias("n")).where(F.col("_i") < len(ends))
    taken = counts.select("_side", "n", F.explode(F.slice(upto, F.col("_i") + 1, len(ends))).alias("diagonal"))  # a row a diagonal and side
    of = [F.coalesce(F.sum(F.when(F.col("_side") == i, F.col("n"))), F.lit(0)).cast("long").alias(f"from_{i}") for i in range(len(sides))]
    return taken.groupBy("diagonal").agg(*of, F.sum("n").alias("_all")).where("_all = diagonal").drop("_all")


def merge_path_split(a: DataFrame, b: DataFrame, order: list[str], diagonals: list[int]) -> DataFrame:
    """(diagonal, from_a, from_b): partition_points of two sides; a before b on ties."""
    return partition_points([a, b], order, diagonals).withColumnsRenamed({"from_0": "from_a", "from_1": "from_b"})


def binary_search_partitions(df: DataFrame, key: str, count: int, spacing: int, bound: str = "lower") -> DataFrame:
    """(index, at, place): for the targets at = 0, spacing, 2 * spacing, ..., count how many keys are smaller (lower) or not greater (upper).

    The last target is `count` itself. Null keys are not counted.
    """
    if count < 0 or spacing < 1:
        raise ValueError("count must not be negative, spacing at least 1")
    targets = df.sparkSession.range(-(-count // spacing) + 1).select(F.col("id").alias("index"), F.least(F.col("id") * spacing, F.lit(count)).alias("at"))
    return sorted_search(targets, "at", df.select(F.col(f"`{key}`").alias("_key")), "_key", bound).select("index", "at", "place")


# --- segments


def _expanded(df: DataFrame, times: Column, out: str) -> DataFrame:
    """Each row `times` times, with its copy's number as `out`; an array holds ITEMS of them at most, whatever the count."""
    n = times.cast("long")
    blocks = df.where(n > 0).select("*", n.alias("__n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / ITEMS).cast("long"))).alias("__block"))
    first = F.col("__block") * ITEMS
    return blocks.withColumn(out, F.explode(F.sequence(first, F.least(first + ITEMS, F.col("__n")) - 1))).drop("__n", "__block")


def segmented_sort(df: DataFrame, segment: str, order: list[str], out: str = "rn") -> DataFrame:
    """df with each row's place in its segment."""
    return numbered(df, order, out, [segment])


def segmented_reduce(df: DataFrame, segment: list[str], **folds: Column) -> DataFrame:
    """A fold by segment, map-side first."""
    return df.groupBy(*segment).agg(*(f.alias(n) for n, f in folds.items()))


def reduce(df: DataFrame, **folds: Column) -> DataFrame:
    return df.agg(*(f.alias(n) for n, f in folds.items()))


def histogram(df: DataFrame, bucket: Column) -> DataFrame:
    return df.groupBy(bucket.cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def load_balance_search(segments: DataFrame, segment: str, count: str) -> DataFrame:
    """(segment, rank): one row for each of a segment's `count` work items, rank from 0."""
    return _expanded(segments.select(segment, count), F.col(count), "rank").select(segment, "rank")


def transform_lbs(segments: DataFrame, segment: str, count: str, f) -> DataFrame:
    """(segment, rank, value): value = f(segment column, rank column) for each work item."""
    work = load_balance_search(segments, segment, count)
    return work.withColumn("value", f(F.col(segment), F.col("rank")))


def lbs_segreduce(segments: DataFrame, segment: str, count: str, f, fold=F.sum, init=0) -> DataFrame:
    """(segment, value): a fold of f(segment column, rank column) over each segment's work items.

    `segment` must tell the segments apart (equal values are folded together; a
    null one is one as well). Segments without items, or whose values are all
    null, have `init`. Items are folded before they are shuffled, so a long
    segment sends one row a task.
    """
    work = transform_lbs(segments, segment, count, f).select(segment, "value")
    none = segments.select(segment, F.lit(None).cast(work.schema["value"].dataType).alias("value"))
    return none.unionByName(work).groupBy(segment).agg(F.coalesce(fold("value"), F.lit(init)).alias("value"))


def workcreate(df: DataFrame, count: Column) -> DataFrame:
    """Each row `count` times, with the number of the copy; rows with 0 or less (or null) vanish."""
    return _expanded(df, count, "copy")


# --- scans and selection


def inclusive_scan(df: DataFrame, order: list[str], value: str, out: str, kind: str = "sum", segment: list[str] | None = None) -> DataFrame:
    return segmented_scan(df, segment or [], order, value, out, kind, True)


def exclusive_scan(df: DataFrame, order: list[str], value: str, out: str, kind: str = "sum", segment: list[str] | None = None) -> DataFrame:
    return segmented_scan(df, segment or [], order, value, out, kind, False)


def transform_scan(df: DataFrame, order: list[str], f: Column, out: str, kind: str = "sum", segment: list[str] | None = None, inclusive: bool = False) -> DataFrame:
    """df with the scan of f, an expression over its columns."""
    return segmented_scan(df.withColumn("__f", f), segment or [], order, "__f", out, kind, inclusive).drop("__f")


def scan_event(df: DataFrame, order: list[str], value: Column, out: str, kind: str = "sum", segment: list[str] | None = None, inclusive: bool = False) -> tuple[DataFrame, DataFrame]:
    """The scan, and apart from it (segment..., total): each segment's reduction, for which no scan has to run.

    Without rows the totals are empty, or one null where there is no segment.
    """
    fold = {"sum": F.sum, "max": F.max}[kind]
    return transform_scan(df, order, value, out, kind, segment, inclusive), df.groupBy(*(segment or [])).agg(fold(value).alias("total"))


def compact(df: DataFrame, flag: Column) -> DataFrame:
    """Stream compaction by a flag or predicate."""
    return df.where(flag)


def heads(df: DataFrame, segment: list[str], order: list[str], value: str) -> DataFrame:
    """df with head: whether `value` differs from the row before in the segment (the first always); null equals null."""
    w = W.partitionBy(*segment).orderBy(*order)
    return df.withColumn("head", F.lag(F.lit(1)).over(w).isNull() | ~F.lag(value).over(w).eqNullSafe(F.col(value)))


def neighbours_differ(df: DataFrame, segment: list[str], order: list[str], value: str) -> DataFrame:
    """df with unique: whether `value` differs from both neighbours in the segment; null equals null."""
    w = W.partitionBy(*segment).orderBy(*order)
    same = lambda f: f(F.lit(1)).over(w).isNotNull() & f(value).over(w).eqNullSafe(F.col(value))
    return df.withColumn("unique", ~same(F.lag) & ~same(F.lead))


def write_if_eq(df: DataFrame, column: str, old, new) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) == F.lit(old), F.lit(new)).otherwise(F.col(column)))


# --- by position


def gather(index: DataFrame, source: DataFrame, at: str, key: str, default=None) -> DataFrame:
    """index with source's row at each `at`; `default` fills the columns where there is none."""
    out = index.join(source.withColumnRenamed(key, at), at, "left")
    return out if default is None else out.fillna(default, [c for c in source.columns if c != key])


def scatter(rows: DataFrame, target: DataFrame, key: str, value: str) -> DataFrame:
    """target (key, value) with the values that rows bring for some keys."""
    fresh = rows.select(key, F.col(value).alias("_fresh"))
    return target.join(fresh, key, "left").select(key, F.coalesce("_fresh", value).alias(value))


def permute(rows: DataFrame, permutation: DataFrame, key: str, to: str) -> DataFrame:
    """rows with key replaced by permutation(key -> to)."""
    return rows.join(permutation.select(key, to), key).drop(key).withColumnRenamed(to, key)


# --- joins and searches on sorted data


def inner_join(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """All pairs with equal keys."""
    return a.join(b, on)


def sorted_search(needles: DataFrame, needle: str, haystack: DataFrame, key: str, bound: str = "lower") -> DataFrame:
    """needles with place: how many keys are smaller (lower) or not greater (upper).

    Needles and keys are sorted together once; a running count of keys is each
    needle's place, so neither side is sent out whole. A null needle has a null
    place; null keys are not counted.
    """
    first = 1 if bound == "lower" else 0  # keys after equal needles, or before
    hay = haystack.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("_n")).select("_k", "_n", F.lit(first).alias("_order"))
    own = needles.select(F.col(needle).alias("_k")).where("_k is not null").distinct().select("_k", F.lit(0).cast("long").alias("_n"), F.lit(1 - first).alias("_order"))
    at = segmented_scan(hay.unionByName(own), [], ["_k", "_order"], "_n", "place").where(F.col("_order") == 1 - first)
    return needles.join(at.select(F.col("_k").alias(needle), "place"), needle, "left")


def bulk_insert(df: DataFrame, position: str, inserts: DataFrame, before: str) -> DataFrame:
    """Rows of `inserts` placed before the rows that stand at `before` in df; all are numbered anew from 0.

    Several inserts before one place keep the order of their other columns.
    """
    old = df.withColumn("_place", F.col(position).cast("long")).withColumn("_late", F.lit(1))
    new = inserts.withColumn("_place", F.col(before).cast("long")).withColumn("_late", F.lit(0)).drop(before)
    both = old.drop(position).unionByName(new)
    rest = [c for c in both.columns if c not in ("_place", "_late")]
    return numbered(both, ["_place", "_late", *rest], position).drop("_place", "_late")


def bulk_remove(df: DataFrame, position: str, removed: DataFrame, at: str) -> DataFrame:
    """df without the rows at the given positions, numbered anew from 0."""
    left = df.join(removed.select(F.col(at).alias(position)).distinct(), position, "left_anti")
    return numbered(left.withColumnRenamed(position, "_place"), ["_place"], position).drop("_place")


def interval_expand(intervals: DataFrame, count: str, value: str) -> DataFrame:
    """(value) as often as counted."""
    return workcreate(intervals.select(value, count), F.col(count)).select(value, "copy")


def interval_gather(intervals: DataFrame, start: str, count: str, source: DataFrame, key: str, segment: str) -> DataFrame:
    """(segment, rank, ...): for each interval, source's rows start, start + 1, ..."""
    work = load_balance_search(intervals.select(segment, count), segment, count).join(intervals.select(segment, start), segment)
    return work.withColumn(key, F.col(start) + F.col("rank")).join(source, key).drop(start)


def interval_scatter(intervals: DataFrame, start: str, count: str, source: DataFrame, key: str, segment: str) -> DataFrame:
    """source's rows 0, 1, ... dealt to the intervals one after the other: key becomes the place they go to."""
    sized = segmented_scan(intervals.select(segment, start, count), [], [segment], count, "_from", inclusive=False)
    work = load_balance_search(sized.select(segment, count), segment, count).join(sized.select(segment, start, "_from"), segment)
    return work.withColumn(key, F.col("_from") + F.col("rank")).join(source, key).withColumn(key, F.col(start) + F.col("rank")).drop(start, "_from", "rank", segment)


def interval_move(intervals: DataFrame, source_start: str, target_start: str, count: str, source: DataFrame, key: str, segment: str) -> DataFrame:
    """source's rows of each interval at the interval's target."""
    got = interval_gather(intervals.select(segment, source_start, count), source_start, count, source, key, segment)
    return got.join(intervals.select(segment, target_start), segment).withColumn(key, F.col(target_start) + F.col("rank")).drop(target_start, "rank", segment)


def spmv(matrix: DataFrame, vector: DataFrame, row: str, col: str, value: str, x: str) -> DataFrame:
    """(row, y): sums of matrix value times vector value."""
    return matrix.join(vector, col).groupBy(row).agg(F.sum(F.col(value) * F.col(x)).alias("y"))
