"""Brown class-based bigram language model over the whole corpus.

Every word of the training texts has a class of its own. Exchange clustering
starts it: the most frequent words are units, all other words share a unit by a
hash of their last bytes. Then each other word's neighbours are counted by their
classes of that start, over all training texts, and the word goes to the class
where the model makes its occurrences likeliest. Only words that no training
text has stay with the class of their ending. A word's probability is that of
its class after the class before it, times that of the word in its class, both
smoothed:

  log P(text) = sum log P(class | class before) + log (c(w) + 1/2) / (N_class + (V_class + 1) / 2)

What executors hold does not grow with the corpus: units and classes. Counts
and classes of the other words are never sent out as a table: texts, in pieces,
send by buckets of words which words they have, how often and between which
classes; each bucket counts its words, chooses their classes and returns both
to the pieces. Class bigrams are counted again from the classes chosen.

Words are 64-bit hashes. Defined results: a null or empty text has one token,
the end; a null doc_id belongs to the training fold; rows with equal ids are
scored one by one; an empty table gives no rows; with no training text all
counts are 0; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import LOWER, SPACE, U, flat, slices, span_hash, words, written

FREQUENT, TAILS, CLASSES, TAIL_BYTES = 768, 512, 64, 3
END = U(0x454E44)  # the hash of the end token
SWEEPS = 6


@dataclass
class Units:
    """The frequent words (sorted hashes), their counts, and the class of each unit."""

    words: np.ndarray
    counts: np.ndarray

    @property
    def size(self) -> int:
        return len(self.words) + TAILS

    def of(self, h: np.ndarray, tail: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return tail.astype(np.int64)
        i = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[i] == h, i, len(self.words) + tail.astype(np.int64))


def token_hashes(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, tail number, offsets) with an end token behind each text."""
    low = LOWER[buf]
    starts, ends, woff = words(low, off, SPACE)
    lens = ends - starts
    h = span_hash(low, starts, lens)
    short = np.minimum(lens, TAIL_BYTES)
    t = (span_hash(low, ends - short, short, 3) % U(TAILS)).astype(np.int64)
    n = len(off) - 1
    toff = woff + np.arange(n + 1)
    at = np.arange(len(h)) + np.repeat(np.arange(n), np.diff(woff))
    hashes, tails = np.full(len(h) + n, END, np.uint64), np.zeros(len(h) + n, np.int64)
    hashes[at], tails[at] = h, t
    return hashes, tails, toff


def exchange(counts: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit. Units start by rank; in each sweep every unit moves to
    the class where the bigram likelihood sum n(a,b) log n(a,b) - sum n(a) log n(a) - sum n(b) log n(b) is largest."""
    n = len(counts)
    mass = counts.sum(0) + counts.sum(1)
    rank = np.argsort(-mass, kind="stable")
    cls = np.empty(n, np.int64)
    cls[rank] = np.arange(n) % classes
    xlogx = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    member = np.zeros((n, classes))
    member[np.arange(n), cls] = 1
    right = counts @ member  # unit -> class
    left = counts.T @ member  # class -> unit, by unit
    table = member.T @ right
    for _ in range(sweeps):
        moved = 0
        for u in rank:
            if not mass[u]:
                continue
            a = cls[u]
            r, c, self_ = right[u].copy(), left[u].copy(), counts[u, u]
            r[a] -= self_
            c[a] -= self_
            base = table.copy()
            base[a] -= r
            base[:, a] -= c
            base[a, a] -= self_
            rs, cs = base.sum(1), base.sum(0)
            # gain of putting u into class k: rows k and columns k change
            rows = xlogx(base + r[None, :]).sum(1) - xlogx(base).sum(1)
            cols = xlogx(base + c[:, None]).sum(0) - xlogx(base).sum(0)
            d = np.diag(base)
            corner = xlogx(d + r + c + self_) - xlogx(d + r) - xlogx(d + c) + xlogx(d)
            tr, tc = r.sum() + self_, c.sum() + self_
            gain = rows + cols + corner - (xlogx(rs + tr) - xlogx(rs)) - (xlogx(cs + tc) - xlogx(cs))
            # units that follow u or come before it change the margins of their classes, too, but by the same amount everywhere
            k = int(gain.argmax())
            if gain[k] <= gain[a] + 1e-9:
                k = a
            table = base
            table[k] += r
            table[:, k] += c
            table[k, k] += self_
            if k != a:
                cls[u] = k
                right[:, a] -= counts[:, u]
                right[:, k] += counts[:, u]
                left[:, a] -= counts[u]
                left[:, k] += counts[u]
                moved += 1
        if not moved:
            break
    return cls


def _train_flag(ids: DataFrame, folds: int, held: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held, F.lit(True))


def _marked(docs: DataFrame, folds: int, held: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").withColumn("train", _train_flag(docs, folds, held)).withColumn("row", F.monotonically_increasing_id())


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c) of all tokens of the training rows, ends included."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=6 << 20):
            u, c = np.unique(token_hashes(*flat(b.column("text")))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(c)], names=["h", "c"])

    return docs.where("train").select("text").mapInArrow(rows, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def unit_bigrams(docs: DataFrame, units: Units) -> np.ndarray:
    """Counts of unit pairs in training texts; each starts after an end token. At most units^2 numbers come to the driver."""
    held = docs.sparkSession.sparkContext.broadcast(units)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        total = np.zeros(m.size * m.size, np.int64)
        end = int(m.of(np.array([END]), np.zeros(1, np.int64))[0])
        for b in slices(batches):
            h, t, toff = token_hashes(*flat(b.column("text")))
            u = m.of(h, t)
            before = np.r_[end, u[:-1]]
            before[toff[:-1]] = end
            total += np.bincount(before * m.size + u, minlength=len(total))
        i = np.flatnonzero(total)
        for k in range(0, len(i), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(i[k : k + 100_000]), pa.array(total[i[k : k + 100_000]])], names=["pair", "c"])

    got = docs.where("train").select("text").mapInArrow(rows, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(units.size * units.size)
    out[got["pair"].to_numpy()] = got["c"].to_numpy()
    return out.reshape(units.size, units.size)


def planes(x: np.ndarray) -> bytes:
    """All first bytes, then all second ones and so on, which compresses better."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(raw: bytes, kind: str) -> np.ndarray:
    n = np.dtype(kind).itemsize
    return np.frombuffer(raw, np.uint8).reshape(n, -1).T.copy().view(kind).ravel()


def transitions(table: np.ndarray, live: np.ndarray) -> np.ndarray:
    """log10 P(class | class before) from counts of class pairs."""
    k = int(live.sum())
    backoff = (table.sum(0) + 0.5 * live) / (table.sum() + 0.5 * k)
    p = (table + k * 0.1 * backoff) / (table.sum(1, keepdims=True) + k * 0.1)
    return np.log10(np.maximum(p, 1e-300))


@dataclass
class Start:
    """The units, their classes, and what a word's class is chosen by: log10 P(class | class before) / N_class and log10 P(class after | class)."""

    units: Units
    cls: np.ndarray
    live: np.ndarray
    before: np.ndarray
    after: np.ndarray


def start(marked: DataFrame, frequent: int = FREQUENT, classes: int = CLASSES) -> Start:
    if not 0 < classes <= 256:
        raise ValueError("1 to 256 classes")
    is_end = F.col("h") == int(END)
    picked = sorted((r.h & (2**64 - 1), r.c) for r in word_counts(marked).orderBy(F.desc(is_end), F.desc("c"), "h").limit(frequent + 1).collect())
    units = Units(np.array([p[0] for p in picked], np.uint64), np.array([p[1] for p in picked], np.int64))
    big = unit_bigrams(marked, units)
    cls = exchange(big, classes)
    member = np.zeros((units.size, classes))
    member[np.arange(units.size), cls] = 1
    table = member.T @ big @ member
    live = np.bincount(cls, big.sum(0) > 0, classes) > 0
    live[cls[len(units.words) :]] = True  # a class with a tail can always be met
    log = transitions(table, live)
    before = np.where(live[None, :], log - np.log10(table.sum(0) + 0.5)[None, :], -1e9)
    return Start(units, cls, live, before, log)


def best_classes(left: np.ndarray, right: np.ndarray, model: Start) -> np.ndarray:
    """Class of each word from the counts of the classes before and behind it; the first of equals."""
    return np.round(left @ model.before + right @ model.after.T, 9).argmax(1).astype(np.uint8)


def deal(marked: DataFrame, model: Start, parts: int) -> DataFrame:
    """A row a piece of texts (bucket -1): its tokens by number; and a row for each bucket that it has words for."""
    held = marked.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        top = len(m.units.words)
        end = int(m.cls[m.units.of(np.array([END]), np.zeros(1, np.int64))[0]])
        for b in slices(batches, limit=6 << 20):
            h, t, toff = token_hashes(*flat(b.column("text")))
            train = b.column("train").to_numpy(zero_copy_only=False).astype(bool)
            ids = m.units.of(h, t)
            c = m.cls[ids].astype(np.uint8)
            before = np.r_[c[:0], np.uint8(end), c[:-1]]
            before[toff[:-1]] = end
            after = np.r_[c[1:], np.uint8(end)]
            at = np.flatnonzero(ids >= top)
            u, first, inv = np.unique(h[at], return_index=True, return_inverse=True)
            order = np.argsort(u % U(parts), kind="stable")
            rank = np.empty(len(u), np.int64)
            rank[order] = np.arange(len(u))
            word = rank[inv]
            ids[at] = top + word
            w, unseen = u[order], c[at[first[order]]]
            learn = np.repeat(train, np.diff(toff))[at]
            seen = np.bincount(word[learn], minlength=len(w))
            places = at[learn][np.argsort(word[learn], kind="stable")]
            till = np.r_[0, np.cumsum(seen)]
            bucket = (w % U(parts)).astype(np.int64)
            cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(w) else np.zeros(0, np.int64)
            piece, n = b.column("row")[0].as_py(), len(cut)
            cols = [[], [], [], []]
            for i, j in zip(cut, np.r_[cut[1:], len(w)], strict=True) if n else ():
                p = places[till[i] : till[j]]
                for col, value in zip(cols, (w[i:j].tobytes(), planes(seen[i:j].astype("<u4")), before[p].tobytes(), after[p].tobytes()), strict=True):
                    col.append(value)
            none = [None] * n
            whole = (planes(ids.astype("<u4")), toff.astype("<i8").tobytes(), train.tobytes(), unseen.tobytes())
            arrays = [pa.array([piece] * (n + 1), pa.int64()), pa.array([*bucket[cut].tolist(), -1], pa.int64()), *(pa.array([*col, None], pa.binary()) for col in cols), *(pa.array([*none, x], pa.binary()) for x in whole), pa.array([*none, b.column("doc_id").to_pylist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["piece", "bucket", "w", "seen", "before", "after", "ids", "toff", "train", "unseen", "docs"])

    return marked.select("doc_id", "row", "train", "text").mapInArrow(rows, "piece long, bucket long, w binary, seen binary, before binary, after binary, ids binary, toff binary, train binary, unseen binary, docs array<long>")


def word_classes(dealt: DataFrame, model: Start, parts: int) -> DataFrame:
    """(piece, bucket, cls, total) for each piece's words of a bucket; and a row a bucket without piece: its distinct seen words and their tokens by class."""
    held = dealt.sparkSession.sparkContext.broadcast(model)

    def choose(key: tuple, table: pa.Table) -> pa.Table:
        m = held.value
        k = len(m.before)
        w = [np.frombuffer(x, "<u8") for x in table["w"].to_pylist()]
        u, inv = np.unique(np.concatenate(w), return_inverse=True)
        seen = np.concatenate([unplanes(x, "<u4") for x in table["seen"].to_pylist()]).astype(np.int64)
        total = np.bincount(inv, seen, len(u)).astype(np.int64)
        before, after = (np.frombuffer(b"".join(table[n].to_pylist()), np.uint8) for n in ("before", "after"))
        order = np.argsort(np.repeat(inv, seen), kind="stable")
        till = np.r_[0, np.cumsum(total)]
        cls = np.zeros(len(u), np.uint8)
        for i in range(0, len(u), 1 << 15):
            j = min(i + (1 << 15), len(u))
            at, word = order[till[i] : till[j]], np.repeat(np.arange(j - i), total[i:j])
            left, right = (np.bincount(word * k + x[at], minlength=(j - i) * k).reshape(-1, k).astype(float) for x in (before, after))
            cls[i:j] = best_classes(left, right, m)
        pieces, cut = [], np.r_[0, np.cumsum([len(x) for x in w])]
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            pieces.append((cls[inv[i:j]].tobytes(), planes(total[inv[i:j]].astype("<u8"))))
        sums = (np.bincount(cls, total > 0, k).astype("<i8").tobytes(), np.bincount(cls, total, k).astype("<i8").tobytes())
        c = list(zip(*pieces, sums, strict=True))
        return pa.table({"piece": pa.array([*table["piece"].to_pylist(), None], pa.int64()), "bucket": pa.array([key[0].as_py()] * (len(w) + 1), pa.int64()), "cls": pa.array(c[0], pa.binary()), "total": pa.array(c[1], pa.binary())})

    some = dealt.where("bucket >= 0").select("piece", "bucket", "w", "seen", "before", "after")
    return some.repartition(parts, "bucket").groupBy("bucket").applyInArrow(choose, "piece long, bucket long, cls binary, total binary")


def class_texts(dealt: DataFrame, chosen: DataFrame, model: Start) -> DataFrame:
    """A row a piece: the class of each token, and of each text the sum of log10 (c(w) + 1/2) and how many tokens have c > 0."""
    held = dealt.sparkSession.sparkContext.broadcast(model)

    def gather(key: tuple, whole: pa.Table, shares: pa.Table) -> pa.Table:
        m = held.value
        one = whole.to_pylist()[0]
        got = sorted(shares.to_pylist(), key=lambda r: r["bucket"])
        total = np.concatenate([m.units.counts, *(unplanes(r["total"], "<u8") for r in got)]).astype(np.int64)
        top = len(m.units.words)
        rare = np.frombuffer(b"".join(r["cls"] for r in got), np.uint8)
        cls = np.r_[m.cls[:top].astype(np.uint8), np.where(total[top:] > 0, rare, np.frombuffer(one["unseen"], np.uint8))]
        ids, at = unplanes(one["ids"], "<u4"), np.frombuffer(one["toff"], "<i8")[:-1]
        s, known = np.add.reduceat(np.log10(total + 0.5)[ids], at), np.add.reduceat((total > 0).astype(np.int64)[ids], at)
        return pa.table({"docs": whole["docs"], "toff": whole["toff"], "train": whole["train"], "cls": pa.array([cls[ids].tobytes()], pa.binary()), "s": pa.array([s.tobytes()], pa.binary()), "known": pa.array([known.tobytes()], pa.binary())})

    whole = dealt.where("bucket < 0").select("piece", "ids", "toff", "train", "unseen", "docs")
    shares = chosen.where("piece is not null")
    return whole.groupBy("piece").cogroup(shares.groupBy("piece")).applyInArrow(gather, "docs array<long>, toff binary, train binary, cls binary, s binary, known binary")


def _steps(row: dict, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class before, class, offsets) of a piece's tokens."""
    cls, toff = np.frombuffer(row["cls"], np.uint8), np.frombuffer(row["toff"], "<i8")
    before = np.r_[cls[:0], np.uint8(end), cls[:-1]]
    before[toff[:-1]] = end
    return before, cls, toff


def class_bigrams(texts: DataFrame, end: int, classes: int) -> np.ndarray:
    """Counts of class pairs in training texts; classes^2 numbers come to the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for b in batches:
            for row in b.to_pylist():
                before, cls, toff = _steps(row, end)
                learn = np.repeat(np.frombuffer(row["train"], bool), np.diff(toff))
                total += np.bincount(before[learn].astype(np.int64) * classes + cls[learn], minlength=len(total))
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[i])], names=["pair", "c"])

    got = texts.select("toff", "train", "cls").mapInArrow(rows, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(classes * classes)
    out[got["pair"].to_numpy()] = got["c"].to_numpy()
    return out.reshape(classes, classes)


def lm_scores(docs: DataFrame, folds: int = 5, held: int = 1, frequent: int = FREQUENT, classes: int = CLASSES) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score, perplexity; a row a row.

    Learns from rows whose crc32(doc_id as text) mod `folds` is not `held`.
    """
    spark = docs.sparkSession
    marked = _marked(docs, folds, held)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(max(1, size // (10 << 20), min(int(spark.conf.get("spark.sql.shuffle.partitions")), size >> 20)))
    model = start(marked, frequent, classes)
    top = len(model.units.words)
    dealt = written(deal(marked, model, parts), "pieces")
    chosen = written(word_classes(dealt, model, parts), "chosen")
    texts = written(class_texts(dealt, chosen, model), "classes")
    v, n = np.bincount(model.cls[:top], minlength=classes), np.bincount(model.cls[:top], model.units.counts, classes).astype(np.int64)
    for r in chosen.where("piece is null").collect():  # a row a bucket
        v, n = v + np.frombuffer(r.cls, "<i8"), n + np.frombuffer(r.total, "<i8")
    end = int(model.cls[model.units.of(np.array([END]), np.zeros(1, np.int64))[0]])
    live = model.live | (v > 0)
    step = transitions(class_bigrams(texts, end, classes), live) - np.log10(n + 0.5 * (v + 1))
    total = int(n.sum())
    base = float(np.log10(total + 0.5 * (int(v.sum()) + 1)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                before, cls, toff = _steps(row, end)
                s, known = np.frombuffer(row["s"], "<f8"), np.frombuffer(row["known"], "<i8")
                lens = np.diff(toff)
                score = s + np.add.reduceat(step[before, cls], toff[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(row["docs"], pa.int64()), pa.array(np.frombuffer(row["train"], bool)), pa.array(lens), pa.array(known), pa.array(np.full(len(lens), total)), pa.array(s - lens * base), pa.array(score), pa.array(10.0 ** (-score / lens))], names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return texts.mapInArrow(rows, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    out = lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
