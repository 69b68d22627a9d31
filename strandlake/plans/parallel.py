"""Queries of the data-parallel primitives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import range_bucket, rank_bucket, sample_index, sample_position
from ..operators import primitives as P

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
DIAGONALS = [1, 100, 1000, 5000, 20000]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        ORACLE[f.__name__] = sql
        return f

    return add


@query("SELECT bucket, n, CAST(coalesce(sum(n) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset FROM (SELECT least(l_orderkey // 1000, 7) AS bucket, count(*) AS n FROM lineitem GROUP BY 1)")
def multisplit_counts(t):
    return P.multisplit_counts(t("lineitem"), range_bucket(F.col("l_orderkey"), 1000, 8))


@query("SELECT least(l_orderkey // 1000, 7) AS bucket, l_orderkey, l_linenumber FROM lineitem")
def multisplit_rows(t):
    return P.multisplit(t("lineitem").select("l_orderkey", "l_linenumber"), range_bucket(F.col("l_orderkey"), 1000, 8), 8)


@query("SELECT least(o_orderkey // 2000, 7) AS src, CAST(least(floor((o_custkey - 1) / 200.0), 7) AS BIGINT) AS dest, count(*) AS n FROM orders GROUP BY 1, 2")
def split_table(t):
    return P.split_table(t("orders"), range_bucket(F.col("o_orderkey"), 2000, 8), rank_bucket(F.col("o_custkey"), 200, 8))


@query("SELECT o_orderkey, least(o_custkey // 200, 7) AS dest FROM orders")
def exchange(t):
    return P.exchange(t("orders").select("o_orderkey", "o_custkey"), range_bucket(F.col("o_custkey"), 200, 8), 8).select("o_orderkey", "dest")


@query("SELECT CAST(NULL AS BIGINT) AS node, CAST(NULL AS BIGINT) AS planned, CAST(NULL AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS side WHERE false")
def validate_exchange(t):
    orders, src, dest = t("orders"), range_bucket(F.col("o_orderkey"), 2000, 8), range_bucket(F.col("o_custkey"), 200, 8)
    sent, received = (orders.groupBy(c.alias(n)).agg(F.count("*").alias("n")) for c, n in ((src, "src"), (dest, "dest")))
    return P.validate_exchange(P.split_table(orders, src, dest), sent, received).select("node", "planned", "n", "side")


@query("SELECT key, side, line, row_number() OVER (ORDER BY key, side, line) - 1 AS rn FROM (SELECT o_orderkey AS key, CAST(0 AS BIGINT) AS side, CAST(0 AS BIGINT) AS line FROM orders UNION ALL SELECT l_orderkey, 1, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) FROM lineitem)")
def distributed_merge(t):
    a = t("orders").select(F.col("o_orderkey").alias("key"), F.lit(0).cast("long").alias("side"), F.lit(0).cast("long").alias("line"))
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    b = P.segmented_sort(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"], "line")
    return P.distributed_merge(a, b.select(F.col("l_orderkey").alias("key"), F.lit(1).cast("long").alias("side"), (F.col("line") + 1).alias("line")), ["key", "side", "line"])


@query("SELECT flag, l_orderkey, rn FROM (SELECT CAST(ascii(l_returnflag) AS BIGINT) AS flag, l_orderkey, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey) - 1 AS rn FROM lineitem)")
def remerge_ranges(t):
    rows = t("lineitem").select(F.ascii("l_returnflag").cast("long").alias("flag"), "l_orderkey")
    return P.remerge(rows, "flag", ["l_orderkey"])


@query("SELECT l_extendedprice FROM lineitem ORDER BY l_extendedprice LIMIT 1 OFFSET 1000")
def kselect(t):
    return P.kselect(t("lineitem").select("l_extendedprice"), ["l_extendedprice"], 1000)


@query(f"SELECT rn AS diagonal, rn - from_b AS from_a, from_b FROM (SELECT row_number() OVER (ORDER BY key, side) AS rn, CAST(sum(side) OVER (ORDER BY key, side ROWS UNBOUNDED PRECEDING) AS BIGINT) AS from_b FROM (SELECT o_orderkey AS key, 0 AS side FROM orders UNION ALL SELECT l_orderkey, 1 FROM lineitem)) WHERE rn IN ({', '.join(map(str, DIAGONALS))})")
def merge_path_split(t):
    return P.merge_path_split(t("orders").select(F.col("o_orderkey").alias("key")), t("lineitem").select(F.col("l_orderkey").alias("key")), ["key"], DIAGONALS)


@query("SELECT rn AS diagonal, from_0, from_1, from_2 FROM (SELECT row_number() OVER w AS rn, count(*) FILTER (WHERE side = 0) OVER w AS from_0, count(*) FILTER (WHERE side = 1) OVER w AS from_1, count(*) FILTER (WHERE side = 2) OVER w AS from_2 FROM (SELECT o_orderkey AS key, 0 AS side FROM orders UNION ALL SELECT l_orderkey, 1 FROM lineitem UNION ALL SELECT p_partkey, 2 FROM part) WINDOW w AS (ORDER BY key, side ROWS UNBOUNDED PRECEDING)) WHERE rn IN (1, 100, 1000, 5000, 20000)")
def partition_points(t):
    sides = [t("orders").select(F.col("o_orderkey").alias("key")), t("lineitem").select(F.col("l_orderkey").alias("key")), t("part").select(F.col("p_partkey").alias("key"))]
    return P.partition_points(sides, ["key"], DIAGONALS)


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events")
def segmented_sort(t):
    return P.segmented_sort(t("events").select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"]).drop("ts")


@query("SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, count(*) AS n, max(l_extendedprice) AS most FROM lineitem GROUP BY l_orderkey")
def segmented_reduce(t):
    return P.segmented_reduce(t("lineitem"), ["l_orderkey"], quantity=F.sum(F.col("l_quantity").cast("long")), n=F.count("*"), most=F.max("l_extendedprice"))


@query("SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, count(*) AS n, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem")
def reduce_all(t):
    return P.reduce(t("lineitem"), quantity=F.sum(F.col("l_quantity").cast("long")), n=F.count("*"), least=F.min("l_extendedprice"), most=F.max("l_extendedprice"))


@query("SELECT CAST(least(p_size // 10, 4) AS BIGINT) AS bucket, count(*) AS n FROM part GROUP BY 1")
def histogram(t):
    return P.histogram(t("part"), range_bucket(F.col("p_size"), 10, 5))


@query("SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT) * p_size) AS BIGINT) AS y FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def spmv(t):
    m = t("lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("long").alias("a"))
    return P.spmv(m, t("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("long").alias("x")), "l_orderkey", "l_partkey", "a", "x")


@query("SELECT user_id, event_id, max(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS top FROM events")
def scan_inclusive_max(t):
    e = t("events").select("user_id", "ts", "event_id", F.floor("value").cast("long").alias("v"))
    return P.inclusive_scan(e, ["ts", "event_id"], "v", "top", "max", ["user_id"]).select("user_id", "event_id", "top")


@query("SELECT event_id, CAST(coalesce(sum(CAST(floor(value) AS BIGINT)) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM events")
def scan_exclusive_sum(t):
    e = t("events").select("ts", "event_id", F.floor("value").cast("long").alias("v"))
    return P.exclusive_scan(e, ["ts", "event_id"], "v", "before").select("event_id", "before")


@query("SELECT event_id, coalesce(lag(event_type) OVER w <> event_type, true) AS head FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def segment_heads(t):
    return P.heads(t("events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "head")


@query('SELECT event_id, NOT coalesce(lag(event_type) OVER w = event_type, false) AND NOT coalesce(lead(event_type) OVER w = event_type, false) AS "unique" FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)')
def compact_flags(t):
    return P.neighbours_differ(t("events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "unique")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def write_if_eq(t):
    return P.write_if_eq(t("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "F", "done")


@query("SELECT event_id, value FROM events WHERE value > 50")
def stream_compact(t):
    return P.compact(t("events").select("event_id", "value"), F.col("value") > 50)


@query("SELECT o_orderkey, o_custkey, coalesce(c_name, 'none') AS c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey + 100")
def gather(t):
    index = t("orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") + 100).alias("at"))
    return P.gather(index, t("customer").select("c_custkey", "c_name"), "at", "c_custkey", "none").select("o_orderkey", "o_custkey", "c_name")


@query("SELECT c_custkey, coalesce(total, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def scatter(t):
    fresh = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return P.scatter(fresh, t("customer").select("c_custkey", "c_acctbal"), "c_custkey", "c_acctbal")


@query("SELECT p_name, (SELECT count(*) FROM part) + 1 - p_partkey AS p_partkey FROM part")
def permute(t):
    rows = t("part").select("p_partkey", "p_name")
    n = rows.count()
    return P.permute(rows, rows.select("p_partkey", (F.lit(n + 1) - F.col("p_partkey")).alias("to")), "p_partkey", "to")


@query("SELECT o_orderkey, o_custkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def inner_join_sorted(t):
    a = t("orders").select(F.col("o_orderkey").alias("key"), "o_custkey")
    return P.inner_join(a, t("lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber"), "key").withColumnRenamed("key", "o_orderkey")


def _search(t, bound):
    return P.sorted_search(t("customer").select("c_custkey", F.col("c_acctbal").alias("x")), "x", t("orders").select(F.col("o_totalprice").alias("k")), "k", bound).select("c_custkey", "place")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_totalprice < c_acctbal) AS place FROM customer")
def sorted_search_lower(t):
    return _search(t, "lower")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_totalprice <= c_acctbal) AS place FROM customer")
def sorted_search_upper(t):
    return _search(t, "upper")


@query("SELECT row_number() OVER (ORDER BY place, late, name) - 1 AS pos, name FROM (SELECT CAST(n_nationkey AS BIGINT) AS place, 1 AS late, n_name AS name FROM nation UNION ALL SELECT r_regionkey * 5, 0, r_name FROM region)")
def bulk_insert(t):
    rows = t("nation").select(F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("name"))
    return P.bulk_insert(rows, "pos", t("region").select((F.col("r_regionkey") * 5).cast("long").alias("before"), F.col("r_name").alias("name")), "before").select("pos", "name")


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS pos, n_name FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey * 3 FROM region)")
def bulk_remove(t):
    rows = t("nation").select(F.col("n_nationkey").cast("long").alias("pos"), "n_name")
    return P.bulk_remove(rows, "pos", t("region").select((F.col("r_regionkey") * 3).cast("long").alias("at")), "at").select("pos", "n_name")


@query("SELECT p_name, CAST(unnest(range(0, p_size % 4)) AS BIGINT) AS copy FROM part")
def interval_expand(t):
    return P.interval_expand(t("part").select("p_name", (F.col("p_size") % 4).alias("n")), "n", "p_name")


@query("SELECT p_partkey, CAST(unnest(range(0, p_size % 4)) AS BIGINT) AS rank FROM part")
def load_balance_search(t):
    return P.load_balance_search(t("part").select("p_partkey", (F.col("p_size") % 4).alias("n")), "p_partkey", "n")


@query("SELECT p_partkey, rank, p_partkey * 100 + rank AS value FROM (SELECT p_partkey, CAST(unnest(range(0, p_size % 4)) AS BIGINT) AS rank FROM part)")
def transform_lbs(t):
    return P.transform_lbs(t("part").select("p_partkey", (F.col("p_size") % 4).alias("n")), "p_partkey", "n", lambda s, r: s * 100 + r)


@query("SELECT p_partkey, CAST(unnest(range(0, p_size % 3)) AS BIGINT) AS copy FROM part")
def workcreate(t):
    return P.workcreate(t("part").select("p_partkey", "p_size"), F.col("p_size") % 3).select("p_partkey", "copy")


def _intervals(t):
    r = F.col("r_regionkey").cast("long")
    return t("region").select(r.alias("seg"), (r * 4).alias("src"), (r * 10).alias("dst"), (r % 3 + 1).alias("n")), t("nation").select(F.col("n_nationkey").cast("long").alias("key"), "n_name")


_INTERVALS = "(SELECT seg, src, dst, CAST(unnest(range(0, n)) AS BIGINT) AS rank, before FROM (SELECT seg, src, dst, n, CAST(coalesce(sum(n) OVER (ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM (SELECT CAST(r_regionkey AS BIGINT) AS seg, CAST(r_regionkey * 4 AS BIGINT) AS src, CAST(r_regionkey * 10 AS BIGINT) AS dst, CAST(r_regionkey % 3 + 1 AS BIGINT) AS n FROM region)))"


@query(f"SELECT seg, rank, src + rank AS key, n_name FROM {_INTERVALS} JOIN nation ON n_nationkey = src + rank")
def interval_gather(t):
    i, s = _intervals(t)
    return P.interval_gather(i.select("seg", "src", "n"), "src", "n", s, "key", "seg").select("seg", "rank", "key", "n_name")


@query(f"SELECT dst + rank AS key, n_name FROM {_INTERVALS} JOIN nation ON n_nationkey = before + rank")
def interval_scatter(t):
    i, s = _intervals(t)
    return P.interval_scatter(i.select("seg", "dst", "n"), "dst", "n", s, "key", "seg").select("key", "n_name")


@query(f"SELECT dst + rank AS key, n_name FROM {_INTERVALS} JOIN nation ON n_nationkey = src + rank")
def interval_move(t):
    i, s = _intervals(t)
    return P.interval_move(i, "src", "dst", "n", s, "key", "seg").select("key", "n_name")


@query("SELECT l_orderkey AS p, (l_orderkey // 2) * 3 + l_orderkey % 2 + 1 AS pos, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def sample_index_map(t):
    rows = t("lineitem").groupBy(F.col("l_orderkey").alias("p")).agg(F.count("*").alias("n")).withColumn("pos", sample_position(F.col("p")))
    return rows.select(sample_index(F.col("pos")).alias("p"), "pos", "n")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, k, sum(l_quantity) OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_extendedprice, k ROWS UNBOUNDED PRECEDING) AS total FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_extendedprice, l_returnflag ORDER BY l_partkey, l_quantity) AS k FROM lineitem)")
def scan_double(t):
    """Doubles by a string segment; quantities are whole numbers, so any order of addition gives the same sum."""
    rows = P.numbered(t("lineitem"), ["l_partkey", "l_quantity"], "k", ["l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag"]).withColumn("k", F.col("k") + 1)
    rows = rows.withColumn("q", F.col("l_quantity").cast("double"))
    return P.inclusive_scan(rows, ["l_orderkey", "l_linenumber", "l_extendedprice", "k"], "q", "total", segment=["l_returnflag"]).select("l_orderkey", "l_linenumber", "l_extendedprice", "k", "total")


@query("SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS rn FROM orders")
def segmented_sort_string(t):
    return P.segmented_sort(t("orders").select("o_orderstatus", "o_orderkey"), "o_orderstatus", ["o_orderkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 <> 0 THEN (SELECT count(*) FROM supplier WHERE s_acctbal < c_acctbal) END AS place FROM customer")
def sorted_search_nulls(t):
    needles = t("customer").select("c_custkey", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")).alias("x"))
    return P.sorted_search(needles, "x", t("supplier").select("s_acctbal"), "s_acctbal").select("c_custkey", "place")


@query("SELECT event_id, CAST(sum(2 * CAST(floor(value) AS BIGINT) + 1) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM events")
def transform_scan(t):
    rows = t("events").select("user_id", "ts", "event_id", "value")
    return P.transform_scan(rows, ["ts", "event_id"], 2 * F.floor("value").cast("long") + 1, "total", segment=["user_id"], inclusive=True).select("event_id", "total")


@query("SELECT event_id, CAST(coalesce(sum(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, CAST(sum(v) OVER (PARTITION BY user_id) AS BIGINT) AS total FROM (SELECT *, CAST(floor(value) AS BIGINT) AS v FROM events)")
def scan_event(t):
    rows = t("events").select("user_id", "ts", "event_id", "value")
    scan, totals = P.scan_event(rows, ["ts", "event_id"], F.floor("value").cast("long"), "before", segment=["user_id"])
    return scan.join(totals, "user_id").select("event_id", "before", "total")


@query("SELECT p_partkey, CAST(coalesce(sum(p_partkey * 100 + rank), 0) AS BIGINT) AS value FROM part LEFT JOIN (SELECT p_partkey AS k, unnest(range(0, p_size % 4)) AS rank FROM part) ON k = p_partkey AND rank IS NOT NULL GROUP BY p_partkey, k IS NULL")
def lbs_segreduce(t):
    return P.lbs_segreduce(t("part").select("p_partkey", (F.col("p_size") % 4).alias("n")), "p_partkey", "n", lambda s, r: s * 100 + r)


def _targets(sign: str) -> str:
    return f"SELECT i AS index, least(i * 40, 1010) AS at, (SELECT count(*) FROM orders WHERE o_custkey {sign} least(i * 40, 1010)) AS place FROM (SELECT unnest(range(0, 27)) AS i)"


@query(_targets("<"))
def binary_search_partitions_lower(t):
    return P.binary_search_partitions(t("orders"), "o_custkey", 1010, 40)


@query(_targets("<="))
def binary_search_partitions_upper(t):
    return P.binary_search_partitions(t("orders"), "o_custkey", 1010, 40, "upper")
