"""Suffix arrays, inverse suffix arrays and Burrows-Wheeler transforms.

All take a DataFrame with a long id and a text (string or binary) and work on
its bytes: unsigned order, a prefix before the longer string. Strategies:

local       texts are sorted where they are read, many at a time, by prefix
            doubling in numpy; nothing is shuffled. For texts that fit a task.
doubling    distributed prefix doubling: any text length, one text or many.
dc3         the two thirds of positions not divisible by 3 are ranked by
            doubling, the others by them, and both are merged by counting.
definition  a window over whole suffixes; for tests.

A null or empty text has no rows. Ids must be distinct and not null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import as_bytes, byte_at, kmer
from ..metrics import Recorder
from ..session import settled
from .scan import segmented_scan

K = 16
SLICE_BYTES = 1 << 18
BLOCK = 1 << 16  # bytes of a text that one row holds before it becomes a row a byte
SPREAD = 1 << 19  # bytes of text that one task makes a row a byte
HEX = [f"{c:02X}" for c in range(256)]
FEW = 1 << 17  # active rows (of some 32 bytes) that are sent to all executors


# --- local kernel


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    a = col.cast(pa.large_string()).cast(pa.large_binary()) if pa.types.is_string(col.type) else col.cast(pa.large_binary())
    a = pc.fill_null(a, b"")
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]] if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def sort_suffixes(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Positions (in data) of all suffixes, by text and then by order in it.

    A key is one number: the text, then as many bytes as fit, each as its place
    among the bytes in use (0 behind the end, so shorter suffixes sort first
    and end marks are not needed). Ranks then double the depth, and only
    suffixes that are not alone yet are sorted again.
    """
    n, counts = int(off[-1]), np.diff(off)
    if not n:
        return np.zeros(0, np.int64)
    texts = len(counts)
    text = np.repeat(np.arange(texts), counts)
    used = np.flatnonzero(np.bincount(data[:n], minlength=256))
    code = np.zeros(256, np.uint64)
    code[used] = np.arange(1, len(used) + 1)
    bits = len(used).bit_length()
    depth = (64 - texts.bit_length()) // bits
    at = np.arange(n) + text * depth  # each text is followed by `depth` zeros
    spaced = np.zeros(n + texts * depth + depth, np.uint64)
    spaced[at] = code[data[:n]]
    key = np.zeros(len(spaced) - depth, np.uint64)
    for j in range(depth):
        key = (key << np.uint64(bits)) | spaced[j : j + len(key)]
    key = key[at] | (text.astype(np.uint64) << np.uint64(bits * depth))
    sa = np.argsort(key)
    key = key[sa]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    seg = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[sa] = seg
    act = np.flatnonzero(~(new & np.r_[new[1:], True]))
    rows, seg, end, h = sa[act], seg[act], off[1:][text], depth
    while len(act):
        to = rows + h
        both = seg * (n + 2) + np.where(to < end[rows], rank[np.minimum(to, n - 1)] + 1, 0)
        order = np.argsort(both)
        rows, both = rows[order], both[order]
        sa[act] = rows
        fresh = np.ones(len(rows), bool)
        fresh[1:] = both[1:] != both[:-1]
        seg = np.maximum.accumulate(np.where(fresh, act, 0))
        rank[rows] = seg
        left = ~(fresh & np.r_[fresh[1:], True])
        act, rows, seg = act[left], rows[left], seg[left]
        h *= 2
    return sa


def single_suffix_array(data: bytes) -> np.ndarray:
    """The suffix array of one text in this process, without Spark: what the distributed strategies are measured against."""
    return sort_suffixes(np.frombuffer(data, np.uint8), np.array([0, len(data)], np.int64))


def _slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield b.slice(at, end - at)
            at = end


def _by_byte(df: DataFrame, id_col: str, text_col: str, columns: str, of: Callable[..., list[pa.Array]]) -> DataFrame:
    """(id, columns) with as many rows a text as it has bytes: of(data, off, start, sa) for the texts of a slice.

    start: where each row's text begins in data; sa: the positions in data, in order.
    """
    names = [id_col, *(c.split()[0] for c in columns.split(", "))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, text_col):
            data, off = _flat(b.column(text_col))
            n = np.diff(off)
            ids = b.column(id_col).cast(pa.int64()).take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([ids, *of(data, off, np.repeat(off[:-1], n), sort_suffixes(data, off))], names=names)

    return df.select(id_col, text_col).mapInArrow(rows, f"`{id_col}` long, {columns}")


def _local(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return _by_byte(df, id_col, text_col, "rank long, pos long", lambda data, off, start, sa: [pa.array(np.arange(len(sa)) - start), pa.array(sa - start)])


def _inverse(sa: np.ndarray) -> np.ndarray:
    isa = np.empty_like(sa)
    isa[sa] = np.arange(len(sa))
    return isa


def _sa_isa_local(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return _by_byte(df, id_col, text_col, "i long, sa long, isa long", lambda data, off, start, sa: [pa.array(np.arange(len(sa)) - start), pa.array(sa - start), pa.array(_inverse(sa) - start)])


def _bwt_rows_local(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def of(data: np.ndarray, off: np.ndarray, start: np.ndarray, sa: np.ndarray) -> list[pa.Array]:
        at, whole = np.arange(len(sa)), sa == start
        row = at - start + (at < _inverse(sa)[start])
        row[whole] = 0  # the suffix at 0 has no row; the text's last byte takes its place
        end = np.repeat(off[1:], np.diff(off))
        return [pa.array(row), pa.array(HEX).take(pa.array(data[np.where(whole, end, sa) - 1]))]

    return _by_byte(df, id_col, text_col, "row long, ch string", of)


# --- distributed


def positions(df: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, pos, _b, _p): a row for each byte, with a block in which it and the next size - 1 bytes stand from _p on.

    A small file may hold texts for many tasks, so blocks are dealt out by the
    bytes of all texts first: what a task counts or sorts does not grow with them.
    """
    data = df.select(F.col(id_col).cast("long").alias(id_col), as_bytes(F.col(text_col)).alias("_t")).where(F.length("_t") > 0)
    total = data.agg(F.sum(F.length("_t"))).first()[0] or 0
    cut = data.select(id_col, "_t", F.explode(F.sequence(F.lit(0), F.length("_t") - 1, F.lit(BLOCK))).alias("_at"))
    blocks = cut.select(id_col, "_at", F.substring("_t", F.col("_at") + 1, F.lit(BLOCK + size - 1)).alias("_b"))
    if total > SPREAD:
        blocks = blocks.repartition(-(-total // SPREAD), id_col, "_at")
    rows = blocks.select(id_col, "_at", "_b", F.explode(F.sequence(F.lit(0), F.least(F.length("_b"), F.lit(BLOCK)) - 1)).alias("_p"))
    return rows.select(id_col, (F.col("_at") + F.col("_p")).cast("long").alias("pos"), "_b", "_p")


def suffixes(df: DataFrame, id_col: str, text_col: str, size: int = K) -> DataFrame:
    """(id, pos, key): each position with its first `size` bytes."""
    return positions(df, id_col, text_col, size).select(id_col, "pos", kmer(F.col("_b"), F.col("_p"), size).alias("key"))


def initial_ranks(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, pos, rank, n): 1 + the number of smaller keys in the text, and how many share the key.

    Equal keys are counted first, so a key of any weight is one row in the scan.
    The ranks go back by merge: Spark takes exploded rows for as small as the
    texts and would send them out whole.
    """
    groups = rows.groupBy(id_col, "key").agg(F.count("*").alias("n"))
    ranked = segmented_scan(groups, [id_col], ["key"], "n", "before", inclusive=False)
    return rows.join(ranked.select(id_col, "key", "n", (F.col("before") + 1).alias("rank")).hint("merge"), [id_col, "key"]).select(id_col, "pos", "rank", "n")


def fetch_ranks(active: DataFrame, isa: DataFrame, id_col: str, h: int) -> DataFrame:
    """active with rank_h: the rank h bytes further on, 0 past the end."""
    ahead = isa.select(id_col, (F.col("pos") - h).alias("pos"), F.col("rank").alias("_r"))
    return active.join(ahead.hint("merge"), [id_col, "pos"], "left").withColumn("rank_h", F.coalesce("_r", F.lit(0))).drop("_r")


def fetch_ranks_of_few(active: DataFrame, isa: DataFrame, ends: DataFrame, id_col: str, h: int) -> DataFrame:
    """fetch_ranks where the active rows are few enough to be sent out: isa is scanned where it lies.

    An inner join, as an outer one cannot send out its outer side. Active rows
    share h bytes with another, so none lies further than h before its text's
    end: ends (id, pos = the text's length, rank 0) stands for what is there.
    """
    ahead = isa.unionByName(ends).select(id_col, (F.col("pos") - h).alias("pos"), F.col("rank").alias("rank_h"))
    return ahead.join(F.broadcast(active), [id_col, "pos"]).select(*active.columns, "rank_h")


def rebucket(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, pos, rank, n) where equal (rank, rank_h) share a new bucket inside the old one."""
    groups = rows.groupBy(id_col, "rank", "rank_h").agg(F.count("*").alias("n"))
    ranked = segmented_scan(groups, [id_col, "rank"], ["rank_h"], "n", "before", inclusive=False)
    ranked = ranked.select(id_col, F.col("rank").alias("_old"), "rank_h", "n", (F.col("rank") + F.col("before")).alias("rank"))
    return rows.select(id_col, "pos", F.col("rank").alias("_old"), "rank_h").join(ranked, [id_col, "_old", "rank_h"]).select(id_col, "pos", "rank", "n")


def compact(rows: DataFrame) -> DataFrame:
    """Rows whose bucket has others."""
    return rows.where("n > 1")


def doubled_ranks(rows: DataFrame, id_col: str, h: int, recorder: Recorder | None = None) -> DataFrame:
    """(id, pos, rank), all ranks distinct, for rows (id, pos, key) with keys of h bytes.

    The recorder gets each round's rows that still tie and, as the stage
    `segments`, the number of buckets they are in.
    """
    recorder = recorder or Recorder()
    with recorder.stage("initial_ranks") as note:
        now = settled(initial_ranks(rows, id_col), "ranks")
        left, note["rows"] = _tied(now, recorder, 0), now.count()
    ends = rows.groupBy(id_col).agg(F.max(F.col("pos") + F.length("key")).alias("pos")).withColumn("rank", F.lit(0).cast("long"))
    ends = settled(ends, "ends") if left else ends
    done = now.where("n = 1").select(id_col, "pos", "rank")
    active = compact(now)
    step = 0
    while left:
        step += 1
        with recorder.stage("doubling", step) as note:
            isa = done.unionByName(active.select(id_col, "pos", "rank"))
            found = fetch_ranks_of_few(active, isa, ends, id_col, h) if left <= FEW else fetch_ranks(active, isa, id_col, h)
            now = settled(rebucket(found, id_col), "ranks")
            note["rows"], left = left, _tied(now, recorder, step)
        done = done.unionByName(now.where("n = 1").select(id_col, "pos", "rank"))
        done = settled(done, "done") if step % 4 == 0 else done
        active = compact(now)
        h *= 2
    return done


def _tied(now: DataFrame, recorder: Recorder, step: int) -> int:
    """How many rows share their bucket; the number of their buckets goes to the recorder."""
    left, segments = compact(now).agg(F.count("*"), F.sum(1 / F.col("n"))).first()
    recorder.found.append(("segments", step, 0.0, round(segments or 0)))
    return left


def joined_suffixes(df: DataFrame, order: list[str], text_col: str, separator: str = "\n", size: int = K, block: int = BLOCK) -> DataFrame:
    """(doc_id = 0, pos, key): the suffixes of one text, all rows in the order given with a separator behind each.

    The text is never one value. A running sum of lengths places the rows, and
    each goes in slices to the blocks that it overlaps, a block being followed
    by the first size - 1 bytes of the next, so a key may span any number of
    rows. Null texts count as empty; the order must be total.
    """
    data = F.concat(as_bytes(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), as_bytes(F.lit(separator)))
    placed = df.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(order)), data.alias("b")).withColumn("n", F.length("b").cast("long")).where("n > 0")
    placed = segmented_scan(placed, [], [f"k{i}" for i in range(len(order))], "n", "at", inclusive=False)
    first = F.floor(F.greatest(F.col("at") - (size - 1), F.lit(0)) / block).cast("long")
    parts = placed.select("b", "at", "n", F.explode(F.sequence(first, F.floor((F.col("at") + F.col("n") - 1) / block).cast("long"))).alias("blk"))
    start = F.greatest(F.col("blk") * block - F.col("at"), F.lit(0))
    stop = F.least((F.col("blk") + 1) * block + (size - 1) - F.col("at"), F.col("n"))
    cut = parts.select("blk", "at", F.substring("b", (start + 1).cast("int"), (stop - start).cast("int")).alias("s"))
    whole = cut.groupBy("blk").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).alias("r"))  # at most block + size bytes, by as many slices
    text = whole.select("blk", F.aggregate("r", F.lit(b""), lambda acc, x: F.concat(acc, x["s"])).alias("_b"))
    rows = text.select("blk", "_b", F.explode(F.sequence(F.lit(0), F.least(F.length("_b"), F.lit(block)) - 1)).alias("_p"))
    return rows.select(F.lit(0).cast("long").alias("doc_id"), (F.col("blk") * block + F.col("_p")).alias("pos"), kmer(F.col("_b"), F.col("_p"), size).alias("key"))


def joined_suffix_array(df: DataFrame, order: list[str], text_col: str, separator: str = "\n", recorder: Recorder | None = None) -> DataFrame:
    """(rank, pos) of the suffixes of all rows as one text of any length (joined_suffixes)."""
    ranks = doubled_ranks(settled(joined_suffixes(df, order, text_col, separator), "suffixes"), "doc_id", K, recorder)
    return ranks.select((F.col("rank") - 1).alias("rank"), "pos")


def _doubling(df: DataFrame, id_col: str, text_col: str, recorder: Recorder | None = None) -> DataFrame:
    ranks = doubled_ranks(suffixes(df, id_col, text_col), id_col, K, recorder)
    return ranks.select(id_col, (F.col("rank") - 1).alias("rank"), "pos")


def sample_ranks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, rank) of the positions not divisible by 3, ranked among themselves.

    Steps are multiples of 3, so a sample position is always followed by one.
    """
    return doubled_ranks(suffixes(df, id_col, text_col, 6).where("pos % 3 <> 0"), id_col, 6)


def merge_by_counting(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The whole order from the sample's: each suffix counts the smaller ones of the other kind.

    A suffix at a multiple of 3 compares with one at 1 mod 3 by (first byte,
    rank of the next), with one at 2 mod 3 by (two bytes, rank of the one
    after). Both keys are unique among all suffixes compared.
    """
    sample = settled(sample_ranks(df, id_col, text_col), "sample")
    pos = positions(df, id_col, text_col, 2)
    pos = pos.select(id_col, "pos", byte_at(F.col("_b"), F.col("_p")).alias("c0"), F.coalesce(byte_at(F.col("_b"), F.col("_p") + 1), F.lit(-1)).alias("c1"))
    ahead = lambda k: sample.select(id_col, (F.col("pos") - k).alias("pos"), F.col("rank").alias(f"r{k}")).hint("merge")
    rows = pos.join(ahead(1), [id_col, "pos"], "left").join(ahead(2), [id_col, "pos"], "left").join(ahead(0), [id_col, "pos"], "left").fillna(0, ["r1", "r2"])
    rows = settled(rows.withColumn("cls", F.col("pos") % 3), "merge")
    one = rows.where("cls <> 2").withColumn("w0", (F.col("cls") == 0).cast("long")).withColumn("w1", (F.col("cls") == 1).cast("long"))
    two = rows.where("cls <> 1").withColumn("w0", (F.col("cls") == 0).cast("long")).withColumn("w1", (F.col("cls") == 2).cast("long"))

    def counted(part: DataFrame, keys: list[str]) -> DataFrame:
        zeros = segmented_scan(part, [id_col], keys, "w0", "zeros", inclusive=False)
        return segmented_scan(zeros, [id_col], keys, "w1", "others", inclusive=False)

    c1, c2 = settled(counted(one, ["c0", "r1"]), "merge"), settled(counted(two, ["c0", "c1", "r2"]), "merge")
    zero = c1.where("cls = 0").select(id_col, "pos", "zeros", F.col("others").alias("ones")).join(c2.where("cls = 0").select(id_col, "pos", F.col("others").alias("twos")).hint("merge"), [id_col, "pos"])
    final = zero.select(id_col, (F.col("zeros") + F.col("ones") + F.col("twos")).alias("rank"), "pos")
    for c, cls in ((c1, 1), (c2, 2)):
        final = final.union(c.where(F.col("cls") == cls).select(id_col, (F.col("r0") - 1 + F.col("zeros")).alias("rank"), "pos"))
    return final


def _definition(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    data = df.select(F.col(id_col).cast("long").alias(id_col), as_bytes(F.col(text_col)).alias("_b")).where(F.length("_b") > 0)
    rows = data.select(id_col, "_b", F.explode(F.sequence(F.lit(0), F.length("_b") - 1)).alias("_p"))
    rows = rows.select(id_col, F.col("_p").cast("long").alias("pos"), F.substring("_b", F.col("_p") + 1, F.length("_b")).alias("s"))
    return rows.select(id_col, (F.row_number().over(W.partitionBy(id_col).orderBy("s")) - 1).cast("long").alias("rank"), "pos")


STRATEGIES = {"local": _local, "doubling": _doubling, "dc3": merge_by_counting, "definition": _definition}


def suffix_array(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", strategy: str = "local") -> DataFrame:
    """(id, rank, pos): suffix `pos` is the rank-th of its text, from 0.

    `local` sorts each row's text alone, whatever its id. The other strategies
    know a text by its id only, so null or repeated ids raise ValueError.
    """
    if strategy != "local" and not df.groupBy(F.col(id_col).alias("id")).count().where("id is null or count > 1").isEmpty():
        raise ValueError(f"{strategy} needs distinct ids that are not null")
    return STRATEGIES[strategy](df, id_col, text_col)


def inverse_suffix_array(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", strategy: str = "local") -> DataFrame:
    """(id, pos, isa)."""
    return suffix_array(df, id_col, text_col, strategy).select(id_col, "pos", F.col("rank").alias("isa"))


def sa_isa(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", strategy: str = "local") -> DataFrame:
    """(id, i, sa, isa): both arrays by index. A null id has no rows."""
    if strategy == "local":
        return _sa_isa_local(df.where(F.col(id_col).isNotNull()), id_col, text_col)
    sa = suffix_array(df, id_col, text_col, strategy)
    isa = sa.select(id_col, F.col("pos").alias("i"), F.col("rank").alias("isa"))
    return sa.select(id_col, F.col("rank").alias("i"), F.col("pos").alias("sa")).join(isa.hint("merge"), [id_col, "i"])


def bwt_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", strategy: str = "local") -> DataFrame:
    """(id, row, ch): the transform without the end mark's row; ch is an upper-case hex byte.

    Row 0 is the last byte (what precedes the end mark); the suffix at 0 has no row.
    """
    if strategy == "local":
        return _bwt_rows_local(df, id_col, text_col)
    data = df.select(F.col(id_col).cast("long").alias(id_col), as_bytes(F.col(text_col)).alias("_b")).where(F.length("_b") > 0)
    sa = suffix_array(df, id_col, text_col, strategy)
    zero = sa.where("pos = 0").select(id_col, F.col("rank").alias("_z"))
    rows = sa.where("pos > 0").join(zero, id_col).join(data, id_col)
    rows = rows.select(id_col, (F.col("rank") + F.when(F.col("rank") < F.col("_z"), 1).otherwise(0)).cast("long").alias("row"), F.hex(F.substring("_b", F.col("pos"), F.lit(1))).alias("ch"))
    return rows.union(data.select(id_col, F.lit(0).cast("long"), F.hex(F.substring("_b", F.length("_b"), F.lit(1)))))


def _bwt_local(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, text_col):
            data, off = _flat(b.column(text_col))
            sa, ids, out = sort_suffixes(data, off), b.column(id_col).to_pylist(), []
            for k, (i, j) in enumerate(zip(off[:-1], off[1:], strict=True)):
                if i < j:
                    own = sa[i:j]
                    out.append((ids[k], bytes([data[j - 1]]) + data[own[own > i] - 1].tobytes(), int(np.flatnonzero(own == i)[0]) + 1))
            c = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.binary()), pa.array(c[2], pa.int64())], names=[id_col, "bwt", "primary_index"])

    return df.select(id_col, text_col).mapInArrow(rows, f"`{id_col}` long, bwt binary, primary_index long")


def bwt(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", strategy: str = "local") -> DataFrame:
    """(id, bwt, primary_index): n bytes; the row of the whole text is left out and counted by the primary index (ISA[0] + 1)."""
    if strategy == "local":
        return _bwt_local(df, id_col, text_col)
    rows = settled(bwt_rows(df, id_col, text_col, strategy), "bwt")
    whole = rows.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("row", "ch"))).alias("r"))
    whole = whole.select(id_col, F.unhex(F.array_join(F.transform("r", lambda x: x["ch"]), "")).alias("bwt"))
    first = inverse_suffix_array(df, id_col, text_col, strategy).where("pos = 0").select(id_col, (F.col("isa") + 1).alias("primary_index"))
    return whole.join(first, id_col)


def bwt_isa(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", strategy: str = "local") -> tuple[DataFrame, DataFrame]:
    """The transform and the inverse suffix array."""
    return bwt(df, id_col, text_col, strategy), inverse_suffix_array(df, id_col, text_col, strategy)


def auxiliary_indexes(isa: DataFrame, r: int, id_col: str = "doc_id") -> DataFrame:
    """(id, j, idx): ISA[j * r] + 1. r: a power of two, 2 at least."""
    if r < 2 or r & (r - 1):
        raise ValueError("r must be a power of two and at least 2")
    return isa.where(F.col("pos") % r == 0).select(id_col, F.floor(F.col("pos") / r).cast("long").alias("j"), (F.col("isa") + 1).alias("idx"))


def bwt_aux(df: DataFrame, r: int, id_col: str = "doc_id", text_col: str = "text", strategy: str = "local") -> tuple[DataFrame, DataFrame]:
    """The transform and the sampled inverse suffix array."""
    return bwt(df, id_col, text_col, strategy), auxiliary_indexes(inverse_suffix_array(df, id_col, text_col, strategy), r, id_col)
