"""Vectorised byte-level text helpers shared by the operators of this subpackage.

All functions work on one flat byte buffer that holds many texts end to end
and an array of offsets; a null text counts as an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..session import shared_path

PAD = 64
#: Bytes beyond which a span is hashed alone.
LONG_SPAN = 4096
U = np.uint64
_K1, _K2, _K3 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [2**64 - 1], dtype=np.uint64)

#: Bytes that separate words in `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that separate words in `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (after lower-casing A-Z).
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with PAD zeros behind them, offsets) of a string or binary column."""
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    a = a.cast(pa.large_string() if pa.types.is_string(a.type) else a.type)
    if pa.types.is_large_string(a.type) or pa.types.is_binary(a.type):
        a = a.cast(pa.large_binary())
    if a.null_count:
        a = pc.fill_null(a, b"")
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]] if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return np.concatenate([data, np.zeros(PAD, np.uint8)]), off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def words(buf: np.ndarray, off: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, word offsets by text) of all words; words never cross texts."""
    n = int(off[-1])
    m = ~sep[buf[:n]]
    first = np.zeros(n + 1, bool)
    first[off] = True
    start, end = m.copy(), m.copy()
    start[1:] &= ~m[:-1] | first[1:n]
    end[:-1] &= ~m[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(32))
    h *= _K2
    h ^= h >> U(29)
    h *= _K3
    h ^= h >> U(32)
    return h


def span_hash(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans; depends on the bytes and the length only."""
    v = np.ndarray((len(buf) - 7,), "<u8", buffer=buf, strides=(1,))
    h = lens.astype(np.uint64) * _K1 + U(seed)
    h = mix(h ^ (v[starts] & _KEEP[np.minimum(lens, 8)])) if len(starts) else h
    for k in np.flatnonzero(lens > LONG_SPAN):
        h[k] = int.from_bytes(hashlib.blake2b(buf[starts[k] : starts[k] + lens[k]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    i, at = np.flatnonzero((lens > 8) & (lens <= LONG_SPAN)), 8
    while i.size:
        h[i] = mix(h[i] * _K1 ^ (v[starts[i] + at] & _KEEP[np.minimum(lens[i] - at, 8)]))
        at += 8
        i = i[lens[i] > at]
    return h


def ngram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of items i..i+n-1 at i; the last n-1 items have none."""
    size = max(0, len(h) - n + 1)
    out = np.zeros(size, np.uint64)
    for j in range(n):
        out = out * _K1 + h[j : j + size]
    return mix(out)


def windows(woff: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first item, text) of all windows of n items within texts, in order."""
    count = np.maximum(np.diff(woff) - n + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    return np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + woff[:-1][text], text


def expand(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for lens[0] items, then the next."""
    total = int(lens.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(lens) - lens), lens)


def column(values, kind: pa.DataType) -> pa.Array:
    return pa.array(values, type=kind)


def written(df, name: str):
    """Cuts lineage: writes df as Parquet in the shared folder and reads it again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def discard(*frames) -> None:
    """Deletes what `written` wrote; nothing may read these frames any more."""
    for df in frames:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(conf).delete(path, True)


def id_column(batch: pa.RecordBatch, name: str = "doc_id") -> pa.Array:
    return batch.column(name).cast(pa.int64())
