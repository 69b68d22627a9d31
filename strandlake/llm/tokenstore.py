"""Token ids in files of independent zstandard frames with a trailing seek table.

A file: MAGIC, the frames, the seek table (one SEEK row a frame), the document
table (one DOC row a document, in order), FOOTER. A frame holds the ids of
whole documents, little-endian, two bytes an id where the vocabulary allows
it, else four. The seek table has each frame's place, sizes and CRC-32, so a
reader fetches and checks only the frames of the documents asked for.

Defined results: a null text is empty and has only its end id; a null doc_id
sorts first and reads back as null; equal doc_ids stay separate documents; an
empty table gives no files and no rows; extra input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_path
from .textkit import flat, id_column, slices
from .tokens import crc32_of, default_vocabulary, encoder

MAGIC = b"STRNDTK1"
SEEK = np.dtype([("offset", "<u8"), ("packed", "<u8"), ("raw", "<u8"), ("crc", "<u4"), ("docs", "<u4")])
DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("tokens", "<u8")])
FOOTER = np.dtype([("frames", "<u8"), ("docs", "<u8"), ("width", "<u4"), ("crc", "<u4"), ("magic", "S8")])
#: Raw bytes after which a frame ends.
FRAME_BYTES = 1 << 20


def filesystem(uri: str):
    """pyarrow's file system and path for a Hadoop-style URI; it reaches the shared folder, local or not."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


class Writer:
    def __init__(self, out, width: int, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.out, self.width, self.frame_bytes = out, width, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level)
        self.at, self.held, self.size = out.write(MAGIC) or len(MAGIC), [], 0
        self.at = len(MAGIC)
        self.seek: list[tuple] = []
        self.docs: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = np.ascontiguousarray(ids, f"<u{self.width}").tobytes()
        self.held.append(raw)
        self.size += len(raw)
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        if self.size >= self.frame_bytes:
            self._frame()

    def _frame(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            packed = self.packer.compress(raw)
            self.out.write(packed)
            self.seek.append((self.at, len(packed), len(raw), zlib.crc32(raw), len(self.held)))
            self.at += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self._frame()
        tables = np.array(self.seek, SEEK).tobytes() + np.array(self.docs, DOC).tobytes()
        self.out.write(tables)
        self.out.write(np.array([(len(self.seek), len(self.docs), self.width, zlib.crc32(tables), MAGIC)], FOOTER).tobytes())


class Reader:
    """Random access: `documents()` for all, `ids(k)` for document number k alone."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        end = source.size()
        foot = np.frombuffer(source.read_at(FOOTER.itemsize, end - FOOTER.itemsize), FOOTER)[0]
        if foot["magic"] != MAGIC:
            raise ValueError("not a token file")
        size = int(foot["frames"]) * SEEK.itemsize + int(foot["docs"]) * DOC.itemsize
        tables = source.read_at(size, end - FOOTER.itemsize - size)
        if zlib.crc32(tables) != foot["crc"]:
            raise ValueError("the seek table is damaged")
        cut = int(foot["frames"]) * SEEK.itemsize
        self.seek, self.docs, self.width = np.frombuffer(tables[:cut], SEEK), np.frombuffer(tables[cut:], DOC), int(foot["width"])
        self.first = np.concatenate([[0], np.cumsum(self.seek["docs"].astype(np.int64))])

    def frame(self, k: int) -> np.ndarray:
        s = self.seek[k]
        raw = self.unpacker.decompress(self.source.read_at(int(s["packed"]), int(s["offset"])), max_output_size=int(s["raw"]))
        if zlib.crc32(raw) != s["crc"]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, f"<u{self.width}")

    def ids(self, number: int) -> np.ndarray:
        k = int(np.searchsorted(self.first, number, "right")) - 1
        sizes = self.docs["tokens"][self.first[k] : number + 1].astype(np.int64)
        return self.frame(k)[int(sizes[:-1].sum()) : int(sizes.sum())]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.seek)):
            ids, at = self.frame(k), 0
            for d in self.docs[self.first[k] : self.first[k + 1]]:
                yield None if d["null"] else int(d["doc_id"]), ids[at : at + int(d["tokens"])]
                at += int(d["tokens"])


def write_tokens(docs: DataFrame, out_dir: str, vocabulary: str | None = None, frame_bytes: int = FRAME_BYTES) -> list[tuple[str, int, int]]:
    """Writes all documents in ascending doc_id order; (file, documents, ids) of each file, in order.

    Documents are dealt by ranges of doc_id, one file a range. A task writes
    under a name of its own and renames at the end, so a repeated task leaves
    one whole file. One row a file comes to the driver.
    """
    vocabulary = vocabulary or default_vocabulary()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(vocabulary), TaskContext.get()
        store, folder = filesystem(out_dir)
        store.create_dir(folder, recursive=True)
        name = f"part-{task.partitionId():06d}.tok"
        draft = f"{folder}/.{name}.{task.taskAttemptId()}"
        width = 2 if enc.whole.get_vocab_size() <= 1 << 16 else 4
        writer, stream, total = None, None, 0
        for b in slices(batches, limit=4 << 20):
            if writer is None:
                stream = store.open_output_stream(draft)
                writer = Writer(stream, width, frame_bytes)
            ids, ioff = enc.encode(*flat(b.column("text")))
            for doc, i, j in zip(id_column(b).to_pylist(), ioff[:-1].tolist(), ioff[1:].tolist(), strict=True):
                writer.add(doc, ids[i:j])
            total += len(ids)
        if writer is not None:
            writer.close()
            stream.close()
            store.move(draft, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int64()), pa.array([f"{out_dir}/{name}"]), pa.array([len(writer.docs)], pa.int64()), pa.array([total], pa.int64())], names=["part", "file", "docs", "tokens"])

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return [(r.file, r.docs, r.tokens) for r in sorted(ordered.mapInArrow(rows, "part long, file string, docs long, tokens long").collect(), key=lambda r: r.part)]


def read_tokens(spark, files: list[tuple[str, int, int]], with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of all documents of the files; start counts all ids before."""
    starts, total = [], 0
    for _, _, tokens in files:
        starts.append(total)
        total += tokens
    table = spark.createDataFrame([(f, s) for (f, _, _), s in zip(files, starts, strict=True)], "file string, start long").repartition(max(1, len(files)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple]) -> pa.RecordBatch:
            c = list(zip(*found, strict=True))
            arrays = [pa.array(x, pa.int64()) for x in c[:4]]
            if with_ids:
                arrays.append(pa.array([x.tolist() for x in c[4]], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

        for batch in batches:
            for file, at in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                store, path = filesystem(file)
                found, held = [], 0
                with store.open_input_file(path) as source:
                    for doc, ids in Reader(source).documents():
                        found.append((doc, at, len(ids), crc32_of(ids), ids))
                        at += len(ids)
                        held += len(ids)
                        if held >= 1 << 20:
                            yield out(found)
                            found, held = [], 0
                if found:
                    yield out(found)

    return table.mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def op5_token_store(spark, sf_dir: str) -> DataFrame:
    files = write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_path(spark, "tokens"))
    return read_tokens(spark, files, with_ids=False)
