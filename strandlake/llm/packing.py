"""Vector bin packing of examples into sequences with several limits.

Examples carry three sizes: tokens, segments and loss-bearing tokens. The
dot-product heuristic fills one sequence at a time: of the examples that still
fit under every limit it takes the one whose size vector points most along
what is left of the sequence. Each task packs its own rows in windows, so
memory is bounded and nothing is shuffled.

Defined results: a null text is empty and still yields its end id; rows with a
null or repeated doc_id are packed row by row; an empty table gives no rows;
extra input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .textkit import flat, id_column, slices
from .tokens import crc32_of, default_vocabulary, encoder

SEQUENCE_TOKENS = 1024
MAX_SEGMENTS = 64
#: Examples that are packed together.
WINDOW = 8192
#: Sequences filled less than this are dissolved into the gaps of others where cutting is allowed.
DISSOLVE_BELOW = 0.97
LEAST_GAP = 8


def pack_vectors(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Bin of each example (rows of `sizes`). An example beyond a limit is an error."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    if (sizes > limits).any():
        raise ValueError("an example exceeds a limit of the sequence")
    kinds, kind_of = np.unique(sizes, axis=0, return_inverse=True)
    kind_of = kind_of.reshape(-1)
    order = np.argsort(kind_of, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(kind_of, minlength=len(kinds)))])
    left = np.diff(first).copy()
    scaled = kinds / limits
    out = np.empty(len(sizes), np.int64)
    live = np.arange(len(kinds))
    bin_, placed = 0, 0
    room = limits.astype(np.int64).copy()
    while placed < len(sizes):
        fit = (kinds[live] <= room).all(1)
        if not fit.any():
            bin_ += 1
            room = limits.astype(np.int64).copy()
            continue
        score = np.where(fit, scaled[live] @ (room / limits), -1.0)
        k = live[int(score.argmax())]
        left[k] -= 1
        out[order[first[k] + left[k]]] = bin_
        room -= kinds[k]
        placed += 1
        if not left[k]:
            live = live[left[live] > 0]
    return out


def _fill_gaps(bins: np.ndarray, lens: np.ndarray, limit: int, max_segments: int) -> list[tuple[int, int, int, int]]:
    """(example, start in it, length, bin): poorly filled bins are cut into the gaps of the others."""
    n = int(bins.max()) + 1 if len(bins) else 0
    used, segments = np.bincount(bins, lens, n).astype(np.int64), np.bincount(bins, minlength=n)
    members = np.argsort(bins, kind="stable")
    at = np.searchsorted(bins[members], np.arange(n + 1))
    worst = [int(b) for b in np.argsort(used, kind="stable") if used[b] < DISSOLVE_BELOW * limit]
    gap = np.where((limit - used >= LEAST_GAP) & (segments < max_segments), limit - used, 0)
    dissolved: set[int] = set()
    total = int(gap.sum())
    need = 0
    for b in worst:
        total -= int(gap[b])
        need += int(used[b])
        if need > total:
            break
        dissolved.add(b)
    out = [(int(m), 0, int(lens[m]), b) for b in range(n) if b not in dissolved for m in members[at[b] : at[b + 1]]]
    holes = [b for b in np.argsort(-gap, kind="stable") if gap[b] > 0 and int(b) not in dissolved]
    extra: list[tuple[int, int]] = []
    h = 0
    for b in sorted(dissolved):
        for m in members[at[b] : at[b + 1]]:
            done = 0
            while done < lens[m]:
                if h == len(holes):
                    extra.append((int(m), done))
                    break
                hole = int(holes[h])
                take = int(min(gap[hole], lens[m] - done))
                out.append((int(m), done, take, hole))
                done += take
                gap[hole] -= take
                segments[hole] += 1
                if gap[hole] < 1 or segments[hole] >= max_segments:
                    h += 1
    bin_, room, seg = n, limit, 0
    for m, done in extra:  # only where the limit on segments closed a gap early
        size = int(lens[m]) - done
        if size > room or seg == max_segments:
            bin_, room, seg = bin_ + 1, limit, 0
        out.append((m, done, size, bin_))
        room -= size
        seg += 1
    return out


def pack_examples(examples: DataFrame, id_col: str, token_col: str, segment_col: str, loss_col: str, max_tokens: int = SEQUENCE_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = SEQUENCE_TOKENS, window: int = WINDOW) -> DataFrame:
    """(id, sequence_id, offset): whole examples, none cut. Null sizes count as 0; an example beyond a limit is an error."""
    limits = np.array([max_tokens, max_segments, max_loss])
    kind = examples.schema[id_col].dataType.simpleString()
    arrow_id = None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal arrow_id
        base, held = TaskContext.get().partitionId() << 40, []
        def flush():
            nonlocal base, held
            ids = pa.concat_arrays([h[0] for h in held])
            sizes = np.concatenate([h[1] for h in held])
            held = []
            bins = pack_vectors(sizes, limits)
            order = np.argsort(bins, kind="stable")
            b, t = bins[order], sizes[order, 0]
            c = np.cumsum(t) - t
            offset = c - c[np.searchsorted(b, b)]
            out = pa.RecordBatch.from_arrays([ids.take(pa.array(order)), pa.array(b + base), pa.array(offset)], names=[id_col, "sequence_id", "offset"])
            base += int(bins.max()) + 1
            return out
        for batch in batches:
            for i in range(0, batch.num_rows, window):
                part = batch.slice(i, window)
                held.append((part.column(id_col), np.stack([part.column(c).fill_null(0).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in (token_col, segment_col, loss_col)], 1)))
                if sum(len(h[1]) for h in held) >= window:
                    yield flush()
        if held and sum(len(h[1]) for h in held):
            yield flush()

    return examples.select(id_col, token_col, segment_col, loss_col).mapInArrow(rows, f"`{id_col}` {kind}, sequence_id long, offset long")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack_documents(docs: DataFrame, vocabulary: str | None = None, max_tokens: int = SEQUENCE_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """Pieces of the documents' ids (each document with an end id) and their places in sequences.

    A document's full-length pieces are sequences of their own; what is left
    of it is packed with that of others. All ids are loss-bearing.
    """
    vocabulary = vocabulary or default_vocabulary()
    limits = np.array([max_tokens, max_segments, max_loss or max_tokens])
    whole = int(min(limits[0], limits[2]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sequence = encoder(vocabulary), TaskContext.get().partitionId() << 40
        tails: list[tuple] = []  # doc_id, start, doc_tokens, ids

        def out(found: list[tuple]) -> pa.RecordBatch:
            c = list(zip(*found, strict=True)) if found else [[]] * 8
            arrays = [pa.array(x, pa.int64()) for x in (c[0], c[1], [len(i) for i in c[3]], [crc32_of(i) for i in c[3]], c[2], c[4], c[5], [len(i) for i in c[3]])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
            if with_ids:
                arrays.append(pa.array([i.tolist() for i in c[3]], pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        def flush() -> pa.RecordBatch:
            nonlocal sequence, tails
            lens = np.array([len(t[3]) for t in tails], np.int64)
            bins = pack_vectors(np.stack([lens, np.ones_like(lens), lens], 1), limits)
            placed = sorted(_fill_gaps(bins, lens, whole, max_segments), key=lambda p: (p[3], p[0], p[1]))
            found, at, number, last = [], 0, sequence - 1, None
            for m, start, size, b in placed:
                if b != last:
                    number, at, last = number + 1, 0, b
                doc, first, total, ids = tails[m]
                found.append((doc, first + start, total, ids[start : start + size], number, at))
                at += size
            sequence, tails = number + 1, []
            return out(found)

        for b in slices(batches):
            ids, ioff = enc.encode(*flat(b.column("text")))
            found = []
            for doc, i, j in zip(id_column(b).to_pylist(), ioff[:-1].tolist(), ioff[1:].tolist(), strict=True):
                for k in range(i, j, whole):
                    piece = ids[k : min(k + whole, j)]
                    if len(piece) == whole:
                        found.append((doc, k - i, j - i, piece, sequence, 0))
                        sequence += 1
                    else:
                        tails.append((doc, k - i, j - i, piece))
            if found:
                yield out(found)
            if len(tails) >= window:
                yield flush()
        if tails:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(rows, PIECES + (", ids array<int>" if with_ids else ""))


def op2_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
