"""Quality rules: document statistics, plain base rules, and boosted trees over the statistics.

Defined results: a null or empty text has no words, zero statistics and fails
the base rules. Rows with a null or repeated doc_id are judged one by one.
Extra columns of the input are ignored by `quality_verdicts`. With no labelled
rows the trees are constant and keep what the base rules keep.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbdt
from .textkit import SPACE, U, flat, id_column, mix, ngram_hash, slices, span_hash, windows, words

#: Rows of the labelled sample that the trees learn from, at most.
SAMPLE_ROWS = 8000
MIN_WORDS = 50
MAX_REPEAT_SHARE = 50

FEATURES = ("log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punct_share", "pipe_share", "bang_share", "words_per_line", "distinct_share", "high_share", "lone_share")
#: More of these never makes a text better.
MONOTONE = {2: -1, 3: -1, 4: -1, 8: -1, 9: -1}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _lut(chars) -> np.ndarray:
    t = np.zeros(256, np.int64)
    t[list(chars)] = 1
    return t


_CHAR = np.ones(256, np.int64)
_CHAR[0x80:0xC0] = 0
_CHAR[SPACE] = 0
_ALNUM = _lut(c for c in range(256) if c >= 0x80 or chr(c).isalnum())
#: Byte classes to count: code points in words, symbols, upper case, digits, punctuation, pipes, exclamation marks, non-ASCII.
_CLASSES = np.stack([_CHAR, _lut(b"#*$%&|<>"), _lut(range(65, 91)), _lut(b"0123456789"), _lut(c for c in range(33, 127) if not chr(c).isalnum()), _lut(b"|"), _lut(b"!"), _lut(range(0xC0, 256))], 1)


def statistics(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(base counts, features), a row a text."""
    n, data = len(off) - 1, buf[: off[-1]]
    starts, ends, woff = words(buf, off, SPACE)
    n_words = np.diff(woff)
    wh = span_hash(buf, starts, ends - starts)
    wdoc = np.repeat(np.arange(n), n_words)
    # words in 3-word windows that occur twice or more in their text
    at, text = windows(woff, 3)
    key = mix(ngram_hash(wh, 3)[at] + text.astype(np.uint64) * U(0xD6E8FEB86659FD93)) if len(at) else np.zeros(0, np.uint64)
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    again = np.zeros(len(s), bool)
    again[1:] |= same
    again[:-1] |= same
    hit = np.zeros(len(wh), bool)
    for j in range(3):
        hit[at[order[again]] + j] = True
    n_repeat = np.bincount(wdoc[hit], minlength=n)
    # lines
    brk = np.flatnonzero(data == 10)
    first = np.unique(np.concatenate([off[:-1], brk + 1]))
    first = first[first < len(data)]
    owner = np.searchsorted(off, first, "right") - 1
    after = brk[np.minimum(np.searchsorted(brk, first), max(len(brk) - 1, 0))] if len(brk) else np.full(len(first), len(data))
    after = np.where((after >= first) & (after < off[owner + 1]), after, off[owner + 1])
    has_word = np.searchsorted(starts, after) > np.searchsorted(starts, first)
    lh = mix(span_hash(buf, first, after - first, 7) + owner.astype(np.uint64) * U(0xD6E8FEB86659FD93))[has_word]
    lowner = owner[has_word]
    _, seen = np.unique(lh, return_index=True)
    dup = np.ones(len(lh), bool)
    dup[seen] = False
    n_dup, n_lines = np.bincount(lowner[dup], minlength=n), np.bincount(lowner, minlength=n)
    counts = np.stack([np.bincount(data[i:j], minlength=256) for i, j in zip(off[:-1], off[1:], strict=True)]) @ _CLASSES if n else np.zeros((0, 8), np.int64)
    chars, symbols, upper, digits, punct, pipes, bangs, high = counts.T
    whk = np.unique(mix(wh + wdoc.astype(np.uint64) * U(0xD6E8FEB86659FD93)), return_index=True)[1]
    distinct = np.bincount(wdoc[whk], minlength=n)
    inner = np.cumsum(_ALNUM.astype(np.int32)[buf[: len(data) + 1]], dtype=np.int32)
    lone = np.bincount(wdoc[(inner[ends - 1] == inner[starts]) & (_ALNUM[buf[starts]] == 0)], minlength=n)
    w, c = np.maximum(n_words, 1), np.maximum(chars, 1)
    x = np.stack([np.log1p(n_words), chars / w, symbols / w, n_dup / np.maximum(n_lines, 1), n_repeat / w, upper / c, digits / c, punct / c, pipes / c, bangs / c, n_words / np.maximum(n_lines, 1), distinct / w, high / c, lone / w], 1)
    return np.stack([n_words, chars, symbols, n_dup, n_repeat], 1).astype(np.int64), x.astype(float)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        base, x = statistics(*flat(b.column("text")))
        yield pa.RecordBatch.from_arrays([id_column(b), b.column("label").cast(pa.int64()), *(pa.array(x[:, j]) for j in range(x.shape[1]))], names=["doc_id", "label", *FEATURES])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> gbdt.Forest:
    """Learns P(quality = 1) from the `sample_rows` labelled rows with the least hash of their id.

    The sample is chosen among the labels, so its size bounds the broadcast
    and what comes to the driver (a few numbers a row). Texts stay where they
    are read. Where a doc_id repeats, its least statistics stand for it.
    """
    chosen = labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("long").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(_feature_rows, "doc_id long, label long, " + ", ".join(f"{f} double" for f in FEATURES))
    got = rows.groupBy("doc_id", "label").agg(F.min(F.struct(*FEATURES)).alias("x")).select("label", "x.*").toPandas().sort_values(["label", *FEATURES])
    return gbdt.fit(got[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), got["label"].to_numpy(float), MONOTONE)


def _judge(forest: gbdt.Forest, threshold: float, min_words: int, max_repeat: int, base: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    failed = (base[:, 0] < min_words) | (100 * base[:, 4] > max_repeat * base[:, 0])
    p = forest.probability(x)
    return failed, p, ~failed & (p >= threshold)


def quality_verdicts(docs: DataFrame, forest: gbdt.Forest, threshold: float = 0.5, min_words: int = MIN_WORDS, max_repeat_share: int = MAX_REPEAT_SHARE) -> DataFrame:
    """doc_id, the five base counts, base_failed, kept and the trees' probability; one row a row."""
    held = docs.sparkSession.sparkContext.broadcast(forest)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            base, x = statistics(*flat(b.column("text")))
            failed, p, kept = _judge(held.value, threshold, min_words, max_repeat_share, base, x)
            yield pa.RecordBatch.from_arrays([id_column(b), *(pa.array(base[:, j]) for j in range(5)), pa.array(failed), pa.array(kept), pa.array(p)], names=["doc_id", *BASE, "base_failed", "kept", "quality_score"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, kept boolean, quality_score double")


def keep_good(docs: DataFrame, forest: gbdt.Forest, threshold: float = 0.5, min_words: int = MIN_WORDS, max_repeat_share: int = MAX_REPEAT_SHARE) -> DataFrame:
    """The rows of docs, with all their columns, that pass base rules and trees; nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(forest)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            base, x = statistics(*flat(b.column("text")))
            yield b.filter(pa.array(_judge(held.value, threshold, min_words, max_repeat_share, base, x)[2]))

    return docs.mapInArrow(rows, docs.schema)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_verdicts(docs, train(docs, labels))
