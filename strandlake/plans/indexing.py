"""Queries of suffix arrays, transforms and the stages of their construction."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import as_bytes, byte_at
from ..operators import primitives as P
from ..operators import suffix as S

TABLES = {"part_names": ("part", "p_partkey", "p_name"), "benchmark": ("benchmark", "item_id", "text")}
STEP = 6  # bytes of the stage queries' keys


def texts(spark, sf_dir: str, name: str) -> DataFrame:
    table, key, text = TABLES[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))


def _sa(name: str, strategy: str, spark, sf_dir: str) -> DataFrame:
    return S.suffix_array(texts(spark, sf_dir, name), strategy=strategy)


def _isa(name: str, spark, sf_dir: str) -> DataFrame:
    return S.inverse_suffix_array(texts(spark, sf_dir, name))


def _sa_isa(name: str, spark, sf_dir: str) -> DataFrame:
    return S.sa_isa(texts(spark, sf_dir, name))


def _bwt(name: str, spark, sf_dir: str) -> DataFrame:
    return S.bwt(texts(spark, sf_dir, name)).withColumn("bwt", F.hex("bwt"))


def _bwt_isa(name: str, spark, sf_dir: str) -> DataFrame:
    b, isa = S.bwt_isa(texts(spark, sf_dir, name))
    whole = isa.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "isa"))).alias("r"))
    return b.join(whole.hint("merge"), "doc_id").select("doc_id", F.hex("bwt").alias("bwt"), "primary_index", F.array_join(F.transform("r", lambda x: x["isa"].cast("string")), ",").alias("isa"))


def _bwt_aux(name: str, spark, sf_dir: str) -> DataFrame:
    return S.bwt_aux(texts(spark, sf_dir, name), 4)[1]


def _bwt_rows(name: str, spark, sf_dir: str) -> DataFrame:
    return S.bwt_rows(texts(spark, sf_dir, name))


def sa_documents(spark, sf_dir: str) -> DataFrame:
    return S.suffix_array(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def bwt_documents(spark, sf_dir: str) -> DataFrame:
    return S.bwt(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", F.sha2("bwt", 256).alias("bwt_sha256"), "primary_index")


def sa_global_names(spark, sf_dir: str) -> DataFrame:
    """One text of all distinct part names: 64 of them, whatever the scale."""
    names = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").distinct()
    one = names.agg(F.array_join(F.array_sort(F.collect_list("p_name")), "\n").alias("text")).select(F.lit(0).cast("long").alias("doc_id"), "text")
    return S.suffix_array(one, strategy="doubling")


def sa_global_parts(spark, sf_dir: str) -> DataFrame:
    """One text of all rows of part, which grows with the table."""
    return S.joined_suffix_array(spark.read.parquet(f"{sf_dir}/part.parquet"), ["p_partkey"], "p_name")


def kmer_rank(spark, sf_dir: str) -> DataFrame:
    return S.initial_ranks(S.suffixes(texts(spark, sf_dir, "benchmark"), "doc_id", "text", STEP), "doc_id")


def initial_buckets(spark, sf_dir: str) -> DataFrame:
    return kmer_rank(spark, sf_dir).select("doc_id", "rank", "n").distinct()


def compact_nonunique(spark, sf_dir: str) -> DataFrame:
    return S.compact(kmer_rank(spark, sf_dir))


def fetch_rank_h(spark, sf_dir: str) -> DataFrame:
    now = kmer_rank(spark, sf_dir)
    return S.fetch_ranks(S.compact(now), now, "doc_id", STEP).select("doc_id", "pos", "rank", "rank_h")


def rebucket_h(spark, sf_dir: str) -> DataFrame:
    return S.rebucket(fetch_rank_h(spark, sf_dir), "doc_id")


def isa_delta(spark, sf_dir: str) -> DataFrame:
    """What a doubling step has to write: the positions whose rank changed."""
    return rebucket_h(spark, sf_dir).withColumnRenamed("rank", "new").join(fetch_rank_h(spark, sf_dir).select("doc_id", "pos", "rank"), ["doc_id", "pos"]).where("new <> rank").select("doc_id", "pos", F.col("new").alias("rank"))


def sample_s12(spark, sf_dir: str) -> DataFrame:
    return S.sample_ranks(texts(spark, sf_dir, "benchmark"), "doc_id", "text")


def sample_s0(spark, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir, "benchmark")
    ahead = S.sample_ranks(docs, "doc_id", "text").select("doc_id", (F.col("pos") - 1).alias("pos"), F.col("rank").alias("r1"))
    data = docs.select("doc_id", as_bytes(F.col("text")).alias("b")).where(F.length("b") > 0)
    rows = data.select("doc_id", "b", F.explode(F.sequence(F.lit(0), F.length("b") - 1, F.lit(3))).alias("p"))
    rows = rows.select("doc_id", F.col("p").cast("long").alias("pos"), byte_at(F.col("b"), F.col("p")).alias("c0")).join(ahead, ["doc_id", "pos"], "left").fillna(0, ["r1"])
    return P.numbered(rows, ["c0", "r1"], "rank", ["doc_id"]).select("doc_id", "pos", "rank")


QUERIES = {"sa_documents": sa_documents, "bwt_documents": bwt_documents, "sa_global_names": sa_global_names, "sa_global_parts": sa_global_parts, "kmer_rank": kmer_rank, "initial_buckets": initial_buckets, "compact_nonunique": compact_nonunique, "fetch_rank_h": fetch_rank_h, "rebucket_h": rebucket_h, "isa_delta": isa_delta, "sample_s12": sample_s12, "sample_s0": sample_s0}
ORACLE: dict[str, str] = {}


def _scaffold(source: str) -> str:
    return f"WITH d AS ({source}), s AS (SELECT doc_id, x, unnest(range(0, length(x) // 2)) AS pos FROM d), r AS (SELECT doc_id, x, row_number() OVER (PARTITION BY doc_id ORDER BY substr(x, 2 * pos + 1)) - 1 AS rank, pos FROM s)"


for _name, (_table, _key, _text) in TABLES.items():
    _with = _scaffold(f"SELECT CAST({_key} AS BIGINT) AS doc_id, hex(encode({_text})) AS x FROM {_table}")
    QUERIES |= {f"sa_{_name}": partial(_sa, _name, "local"), f"sa_doubling_{_name}": partial(_sa, _name, "doubling"), f"sa_dc3_{_name}": partial(_sa, _name, "dc3"), f"isa_{_name}": partial(_isa, _name), f"sa_isa_{_name}": partial(_sa_isa, _name), f"bwt_{_name}": partial(_bwt, _name), f"bwt_rows_{_name}": partial(_bwt_rows, _name), f"bwt_isa_{_name}": partial(_bwt_isa, _name), f"bwt_aux_r4_{_name}": partial(_bwt_aux, _name)}
    _bwt_of = "max(right(x, 2)) || coalesce(string_agg(substr(x, 2 * pos - 1, 2), '' ORDER BY rank) FILTER (WHERE pos > 0), '') AS bwt, max(CASE WHEN pos = 0 THEN rank + 1 END) AS primary_index"
    ORACLE |= {f"sa_{p}{_name}": f"{_with} SELECT doc_id, rank, pos FROM r" for p in ("", "doubling_", "dc3_")}
    ORACLE |= {
        f"isa_{_name}": f"{_with} SELECT doc_id, pos, rank AS isa FROM r",
        f"sa_isa_{_name}": f"{_with} SELECT a.doc_id, a.rank AS i, a.pos AS sa, b.rank AS isa FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.rank = b.pos",
        f"bwt_{_name}": f"{_with} SELECT doc_id, {_bwt_of} FROM r GROUP BY doc_id",
        f"bwt_rows_{_name}": f"{_with}, z AS (SELECT doc_id, rank AS z FROM r WHERE pos = 0) SELECT doc_id, CAST(CASE WHEN rank < z THEN rank + 1 ELSE rank END AS BIGINT) AS row, substr(x, 2 * pos - 1, 2) AS ch FROM r JOIN z USING (doc_id) WHERE pos > 0 UNION ALL SELECT doc_id, CAST(0 AS BIGINT), right(x, 2) FROM d WHERE x <> ''",
        f"bwt_isa_{_name}": f"{_with} SELECT doc_id, {_bwt_of}, string_agg(CAST(rank AS VARCHAR), ',' ORDER BY pos) AS isa FROM r GROUP BY doc_id",
        f"bwt_aux_r4_{_name}": f"{_with} SELECT doc_id, pos // 4 AS j, rank + 1 AS idx FROM r WHERE pos % 4 = 0",
    }

_bench = _scaffold("SELECT CAST(item_id AS BIGINT) AS doc_id, hex(encode(text)) AS x FROM benchmark")
_k = f"{_bench}, k AS (SELECT doc_id, pos, rank() OVER (PARTITION BY doc_id ORDER BY substr(x, 2 * pos + 1, {2 * STEP})) AS rank, count(*) OVER (PARTITION BY doc_id, substr(x, 2 * pos + 1, {2 * STEP})) AS n FROM s)"
_f = f"{_k}, f AS (SELECT a.doc_id, a.pos, a.rank, coalesce(b.rank, 0) AS rank_h FROM k a LEFT JOIN k b ON a.doc_id = b.doc_id AND b.pos = a.pos + {STEP} WHERE a.n > 1)"
_r = f"{_f}, g AS (SELECT doc_id, pos, rank AS old, rank + rank() OVER (PARTITION BY doc_id, rank ORDER BY rank_h) - 1 AS rank, count(*) OVER (PARTITION BY doc_id, rank, rank_h) AS n FROM f)"
ORACLE |= {
    "sa_global_names": _scaffold("SELECT CAST(0 AS BIGINT) AS doc_id, hex(encode(string_agg(p_name, chr(10) ORDER BY p_name))) AS x FROM (SELECT DISTINCT p_name FROM part)") + " SELECT doc_id, rank, pos FROM r",
    "sa_global_parts": _scaffold("SELECT CAST(0 AS BIGINT) AS doc_id, hex(encode(string_agg(p_name || chr(10), '' ORDER BY p_partkey))) AS x FROM part") + " SELECT rank, pos FROM r",
    "kmer_rank": f"{_k} SELECT doc_id, pos, rank, n FROM k",
    "initial_buckets": f"{_k} SELECT DISTINCT doc_id, rank, n FROM k",
    "compact_nonunique": f"{_k} SELECT doc_id, pos, rank, n FROM k WHERE n > 1",
    "fetch_rank_h": f"{_f} SELECT doc_id, pos, rank, rank_h FROM f",
    "rebucket_h": f"{_r} SELECT doc_id, pos, rank, n FROM g",
    "isa_delta": f"{_r} SELECT doc_id, pos, rank FROM g WHERE rank <> old",
    "sample_s12": f"{_bench} SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS rank FROM r WHERE pos % 3 <> 0",
    "sample_s0": f"{_bench} SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY rank) - 1 AS rank FROM r WHERE pos % 3 = 0",
}
