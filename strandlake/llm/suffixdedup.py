"""Removal of byte strings that already start in a document with a smaller id.

Depth-limited radix sort of suffixes, most significant digit first: suffixes
are ordered only through the threshold depth, groups of one drop out after
each digit, and equal groups at full depth are exactly the repeated windows.

Not every suffix is sorted. Of each window of DEPTH bytes, the 24-byte grams
with the least hash are its anchors; equal windows have equal anchors at equal
places, so it is enough to sort around anchors:

1. The first digit is an anchor's gram. Each chunk of documents names its
   distinct grams; grams of one document drop out.
2. For the others, each chunk sends the bytes around (26 before, 26 behind),
   once for equal surroundings. A radix sort over all these bytes finds the
   documents that have a smaller one with the same surroundings: all windows
   of such an anchor repeat. What is left is sorted for each of the 27 windows
   that hold the anchor, through DEPTH bytes.
3. Each chunk merges the repeated windows of its documents and cuts them out.

Bytes are compared, never only hashes. Documents travel once, in chunks by a
hash of the id; a group's members meet after each chunk has reduced its own to
one, so copies in any number cost a row a chunk.

Defined results: a null text is empty; texts under DEPTH bytes lose nothing;
rows with the same doc_id don't count as smaller than each other; a null
doc_id counts as larger than all others; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import U, flat, mix

DEPTH, GRAM = 50, 24
SIDE = DEPTH - GRAM  # bytes before and behind a gram; windows of SIDE + 1 grams
ROW = 8 * -(-(2 + 2 * SIDE + GRAM) // 8)
CHUNK_BYTES, LEAST_CHUNK = 8 << 20, 1 << 20
_P = [pow(0x9E3779B97F4A7C15 | 1, 1 << i, 1 << 64) for i in range(5)]
_BYTES = np.random.default_rng(50).integers(1, 2**63, 256, dtype=np.uint64)
NULL_ID = 2**63 - 1


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    h1 = _BYTES[b]
    h2 = h1[:-1] * U(_P[0]) + h1[1:]
    h4 = h2[:-2] * U(_P[1]) + h2[2:]
    h8 = h4[:-4] * U(_P[2]) + h4[4:]
    h16 = h8[:-8] * U(_P[3]) + h8[8:]
    return mix(h16[:-8] * U(_P[3]) + h8[16:])


def _sliding(op, h: np.ndarray, n: int) -> np.ndarray:
    """op over h[i : i + n]."""
    have, size = h, 1
    while 2 * size <= n:
        have, size = op(have[:-size], have[size:]), 2 * size
    return op(have[: len(h) - n + 1], have[n - size : n - size + len(h) - n + 1])


def anchors(buf: np.ndarray, off: np.ndarray, piece: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, document, gram hash) of the grams that are least in some window of SIDE + 1 grams."""
    n = int(off[-1])
    halo = SIDE
    b = np.concatenate([np.zeros(halo, np.uint8), buf[:n], np.zeros(halo + GRAM, np.uint8)])
    places, hashes = [], []
    for a in range(0, n, piece):
        z = min(a + piece, n)
        h = _gram_hashes(b[a : z + 2 * halo + GRAM - 1])  # grams a - halo .. z + halo
        least = _sliding(np.minimum, h, SIDE + 1)  # from gram a - halo on
        own = h[halo : halo + z - a]
        top = _sliding(np.maximum, least, SIDE + 1)[: z - a]
        at = np.flatnonzero(own == top)
        places.append(at + a)
        hashes.append(own[at])
    place = np.concatenate(places) if places else np.zeros(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    doc = np.searchsorted(off, place, "right") - 1
    ok = place + GRAM <= off[doc + 1]
    return place[ok], doc[ok], h[ok]


def radix_groups(digits: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Group numbers after all digits (columns, most significant first) within the given groups.

    Rows that are alone after a digit drop out: they get numbers of their own
    and are not looked at again.
    """
    out = np.full(len(group), -1, np.int64)
    rows, g, fresh = np.arange(len(group)), group, 0
    for d in range(digits.shape[1] + 1):
        if d:
            key = digits[rows, d - 1]
            order = np.lexsort((key, g))
            k, s = key[order], g[order]
            new = np.ones(len(order), bool)
            new[1:] = (s[1:] != s[:-1]) | (k[1:] != k[:-1])
        else:
            order = np.argsort(g, kind="stable")
            s = g[order]
            new = np.ones(len(order), bool)
            new[1:] = s[1:] != s[:-1]
        rows, g = rows[order], np.cumsum(new) - 1
        alone = np.bincount(g, minlength=1)[g] == 1 if len(g) else np.zeros(0, bool)
        out[rows[alone]] = fresh + np.arange(int(alone.sum()))
        fresh += int(alone.sum())
        rows, g = rows[~alone], g[~alone]
        if not len(rows):
            return out
    out[rows] = fresh + np.unique(g, return_inverse=True)[1]
    return out


def _least(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The least document of each row's group."""
    least = np.full(int(group.max()) + 1 if len(group) else 0, NULL_ID, np.int64)
    np.minimum.at(least, group, doc)
    return least[group]


def _all_windows(before: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Bit o: the window that starts o bytes before the anchor lies in the document."""
    o = np.arange(SIDE + 1)
    ok = (o <= before[:, None]) & (SIDE - o <= behind[:, None])
    return (ok.astype(np.uint64) << o.astype(np.uint64)).sum(1, dtype=np.uint64)


def _words(b: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(b).view(">u8").astype(np.uint64)


def surroundings(buf: np.ndarray, off: np.ndarray, place: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """ROW bytes an anchor: its gram, SIDE bytes before, SIDE behind (zeros outside the document), how many there are of each."""
    before = np.minimum(SIDE, place - off[doc])
    behind = np.minimum(SIDE, off[doc + 1] - place - GRAM)
    out = np.zeros((len(place), ROW), np.uint8)
    b = np.concatenate([np.zeros(SIDE, np.uint8), buf, np.zeros(SIDE, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(b, 2 * SIDE + GRAM)[place] if len(place) else np.zeros((0, 2 * SIDE + GRAM), np.uint8)
    out[:, :GRAM] = around[:, SIDE : SIDE + GRAM]
    i = np.arange(SIDE)
    out[:, GRAM : GRAM + SIDE] = np.where(i >= SIDE - before[:, None], around[:, :SIDE], 0)
    out[:, GRAM + SIDE : GRAM + 2 * SIDE] = np.where(i < behind[:, None], around[:, SIDE + GRAM :], 0)
    out[:, GRAM + 2 * SIDE], out[:, GRAM + 2 * SIDE + 1] = before, behind
    return out


def repeated_windows(rows: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each anchor the windows (bits, by start before it) that a smaller document has too."""
    n = len(rows)
    before, behind = rows[:, GRAM + 2 * SIDE].astype(np.int64), rows[:, GRAM + 2 * SIDE + 1].astype(np.int64)
    full = _all_windows(before, behind)
    words = _words(rows).reshape(n, ROW // 8)
    gram = radix_groups(words[:, : GRAM // 8], np.zeros(n, np.int64))
    same = radix_groups(words[:, GRAM // 8 :], gram)
    least = _least(same, doc)
    mask = np.where(doc > least, full, U(0))
    # one for each distinct surroundings, where the gram has several
    rep = np.full(int(same.max()) + 1 if n else 0, -1, np.int64)
    left = np.flatnonzero(doc == least)
    rep[same[left]] = left
    rep = rep[rep >= 0]
    many = np.bincount(gram[rep], minlength=1)[gram[rep]] > 1 if len(rep) else np.zeros(0, bool)
    act = rep[many]
    found = np.zeros(n, np.uint64)
    for o in range(SIDE + 1):
        i = act[(before[act] >= o) & (behind[act] >= SIDE - o)]
        if len(i) < 2:
            continue
        rest = np.zeros((len(i), 8 * -(-SIDE // 8)), np.uint8)
        rest[:, :o] = rows[i, GRAM + SIDE - o : GRAM + SIDE]
        rest[:, o:SIDE] = rows[i, GRAM + SIDE : GRAM + 2 * SIDE - o]
        g = radix_groups(_words(rest).reshape(len(i), -1), gram[i])
        found[i[doc[i] > _least(g, doc[i])]] |= U(1 << o)
    by_same = np.zeros(len(np.unique(same)) if n else 0, np.uint64)
    by_same[same[act]] = found[act]
    return np.where(doc > least, full, by_same[same]) if n else mask


def _chunk(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, bytes, offsets) of a chunk in a fixed order, however its rows arrived."""
    ids = table["doc_id"].cast(pa.int64()).fill_null(NULL_ID)
    t = pa.table({"doc_id": ids, "text": table["text"].cast(pa.large_string()).fill_null("")}).sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return t["doc_id"].to_numpy(), *flat(t["text"])


def _pack6(h: np.ndarray) -> bytes:
    return np.ascontiguousarray((h.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack6(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def _split(order_key: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    order = np.argsort(order_key, kind="stable")
    k = order_key[order]
    cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    ends = np.r_[cut[1:], len(k)] if len(k) else cut
    return order, [(int(k[i]), int(i), int(j)) for i, j in zip(cut, ends, strict=True)]


def _table(schema: list[tuple[str, pa.DataType]], found: list[tuple]) -> pa.Table:
    c = list(zip(*found, strict=True)) if found else [[] for _ in schema]
    return pa.table({n: pa.array(x, k) for (n, k), x in zip(schema, c, strict=True)})


def dedup_spans(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, spans (array of (start, end): maximal removed runs) and kept (the other bytes), a row a row."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    at_least = min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // LEAST_CHUNK)
    chunks = max(1, total // chunk_bytes, at_least)
    parts = chunks
    chunked = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).alias("chunk"), F.col("doc_id").cast("long"), "text").repartition(chunks, "chunk")
    by_chunk = chunked.groupBy("chunk")

    def grams(key: tuple, table: pa.Table) -> pa.Table:
        ids, buf, off = _chunk(table)
        _, doc, h = anchors(buf, off)
        h = h >> U(16)
        order = np.argsort(h, kind="stable")
        s, d = h[order], ids[doc[order]]
        new = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
        s, several = s[new], (np.minimum.reduceat(d, new) != np.maximum.reduceat(d, new)) if len(new) else np.zeros(0, bool)
        order, cuts = _split((s % U(parts)).astype(np.int64))
        s, several = s[order], several[order]
        return _table([("bucket", pa.int64()), ("chunk", pa.int64()), ("grams", pa.binary()), ("several", pa.binary())], [(b, key[0].as_py(), _pack6(s[i:j]), np.packbits(several[i:j]).tobytes()) for b, i, j in cuts])

    def shared(key: tuple, table: pa.Table) -> pa.Table:
        g = [_unpack6(x) for x in table["grams"].to_pylist()]
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(y)).astype(bool) for x, y in zip(table["several"].to_pylist(), g, strict=True)])
        owner = np.repeat(table["chunk"].to_numpy(), [len(x) for x in g])
        g = np.concatenate(g)
        _, inv, count = np.unique(g, return_inverse=True, return_counts=True)
        hot = (count > 1) | (np.bincount(inv, several) > 0)
        hot = hot[inv]
        g, owner = g[hot], owner[hot]
        order, cuts = _split(owner)
        return _table([("chunk", pa.int64()), ("grams", pa.binary())], [(c, _pack6(g[order[i:j]])) for c, i, j in cuts])

    kinds = [("bucket", pa.int64()), ("chunk", pa.int64()), ("rows", pa.binary()), ("doc", pa.binary()), ("at", pa.binary()), ("mask", pa.binary())]

    def around(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table(kinds, [])
        hot = np.sort(np.concatenate([_unpack6(x) for x in right["grams"].to_pylist()]))
        ids, buf, off = _chunk(left)
        place, doc, h = anchors(buf, off)
        h = h >> U(16)
        k = np.searchsorted(hot, h)
        own = (k < len(hot)) & (hot[np.minimum(k, len(hot) - 1)] == h)
        place, doc, h = place[own], doc[own], h[own]
        rows = surroundings(buf, off, place, doc)
        same = radix_groups(_words(rows).reshape(len(rows), -1), np.zeros(len(rows), np.int64))
        least = _least(same, ids[doc])
        done = ids[doc] > least  # an equal place in this chunk has a smaller document
        at = np.stack([doc, place - off[doc]], 1).astype("<i4")
        full = _all_windows(rows[:, GRAM + 2 * SIDE].astype(np.int64), rows[:, GRAM + 2 * SIDE + 1].astype(np.int64))
        chunk, found = key[0].as_py(), []
        if done.any():
            found.append((-1 - chunk, chunk, b"", b"", at[done].tobytes(), full[done].astype("<u8").tobytes()))
        rest = np.flatnonzero(~done)
        rest = rest[np.argsort(h[rest], kind="stable")]  # like beside like, for the packer
        order, cuts = _split((h[rest] % U(parts)).astype(np.int64))
        rest = rest[order]
        pack = zstandard.ZstdCompressor(level=1).compress
        for b, i, j in cuts:
            r = rest[i:j]
            found.append((b, chunk, pack(rows[r].tobytes()), pack(ids[doc[r]].astype("<i8").tobytes()), pack(at[r].tobytes()), b""))
        return _table(kinds, found)

    out_kinds = [("chunk", pa.int64()), ("at", pa.binary()), ("mask", pa.binary())]

    def resolve(key: tuple, table: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return table.select(["chunk", "at", "mask"]).cast(pa.schema(out_kinds))
        unpack = zstandard.ZstdDecompressor().decompress
        rows = np.frombuffer(b"".join(unpack(x) for x in table["rows"].to_pylist()), np.uint8).reshape(-1, ROW)
        docs_ = [unpack(x) for x in table["doc"].to_pylist()]
        doc = np.frombuffer(b"".join(docs_), "<i8")
        at = np.frombuffer(b"".join(unpack(x) for x in table["at"].to_pylist()), "<i4").reshape(-1, 2)
        owner = np.repeat(table["chunk"].to_numpy(), [len(x) // 8 for x in docs_])
        mask = repeated_windows(rows, doc)
        i = np.flatnonzero(mask)
        order, cuts = _split(owner[i])
        i = i[order]
        return _table(out_kinds, [(c, at[i[a:b]].tobytes(), mask[i[a:b]].astype("<u8").tobytes()) for c, a, b in cuts])

    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, buf, off = _chunk(left)
        n = int(off[-1])
        delta = np.zeros(n + DEPTH + 1, np.int32)
        for at, mask in zip(right["at"].to_pylist(), right["mask"].to_pylist(), strict=True):
            at, mask = np.frombuffer(at, "<i4").reshape(-1, 2).astype(np.int64), np.frombuffer(mask, "<u8")
            place = off[at[:, 0]] + at[:, 1]
            for o in range(SIDE + 1):
                s = place[(mask >> U(o)) & U(1) == 1] - o
                np.add.at(delta, s, 1)
                np.add.at(delta, s + DEPTH, -1)
        gone = np.cumsum(delta[:n]) > 0
        edge = np.diff(np.r_[False, gone, False].astype(np.int8))
        # runs never cross documents: an end at each document's end, a start at each start
        first = np.zeros(n + 1, bool)
        first[off] = True
        inner = np.flatnonzero(first[:n] & gone & np.r_[False, gone[:-1]]) if n else np.zeros(0, np.int64)
        starts = np.sort(np.concatenate([np.flatnonzero(edge == 1), inner]))
        ends = np.sort(np.concatenate([np.flatnonzero(edge == -1), inner]))
        so = np.searchsorted(starts, off)
        spans = pa.ListArray.from_arrays(pa.array(so, pa.int32()), pa.StructArray.from_arrays([pa.array(starts - off[np.searchsorted(off, starts, "right") - 1]), pa.array(ends - off[np.searchsorted(off, starts, "right") - 1])], names=["start", "end"]))
        kept = buf[:n][~gone]
        ko = np.concatenate([[0], np.cumsum(~gone)])[off]
        kept = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(ko.astype(np.int64)), pa.py_buffer(kept.tobytes())]).cast(pa.binary())
        return pa.table({"doc_id": pa.array(ids, mask=ids == NULL_ID), "n_bytes": pa.array(np.diff(off)), "spans": spans, "kept": kept})

    a = by_chunk.applyInArrow(grams, "bucket long, chunk long, grams binary, several binary")
    hot = a.repartition(parts, "bucket").groupBy("bucket").applyInArrow(shared, "chunk long, grams binary")
    b = by_chunk.cogroup(hot.repartition(chunks, "chunk").groupBy("chunk")).applyInArrow(around, "bucket long, chunk long, rows binary, doc binary, at binary, mask binary")
    masks = b.repartition(parts, "bucket").groupBy("bucket").applyInArrow(resolve, "chunk long, at binary, mask binary")
    return by_chunk.cogroup(masks.repartition(chunks, "chunk").groupBy("chunk")).applyInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
