"""Byte sources and sinks for suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_files(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """(path, text): whole files as bytes, cut after max_bytes if given. A missing path is an error; an empty file has no row, as its text has no suffixes."""
    content = F.col("content") if max_bytes is None else F.substring("content", 1, max_bytes)
    return spark.read.format("binaryFile").load(path).select("path", content.alias("text"))


def write_text(sa: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Decimal positions, one a line, in the order of (id, rank)."""
    sa.repartitionByRange(id_col, "rank").sortWithinPartitions(id_col, "rank").select(F.col("pos").cast("string")).write.text(path)


def pack_positions(sa: DataFrame, id_col: str = "doc_id", width: int = 4) -> DataFrame:
    """(id, sa): each text's positions as little-endian unsigned integers of 4 or 8 bytes, in order of rank.

    Rows of a text stay in order through a sorted partition; a text's array is one value and must fit one.
    """
    if width not in (4, 8):
        raise ValueError("width must be 4 or 8")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        one = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.concatenate(held).astype(f"<u{width}").tobytes()])], names=[id_col, "sa"])
        for b in batches:
            ids, pos = b.column(id_col).to_numpy(), b.column("pos").to_numpy()
            for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ids)) + 1):
                if len(part) and ids[part[0]] != now:
                    if held:
                        yield one()
                    now, held = int(ids[part[0]]), []
                held.append(pos[part])
        if held:
            yield one()

    dealt = sa.select(id_col, "rank", "pos").repartition(id_col).sortWithinPartitions(id_col, "rank").select(id_col, "pos")
    return dealt.mapInArrow(rows, f"`{id_col}` long, sa binary")


def write_binary(sa: DataFrame, path: str, id_col: str = "doc_id", width: int = 4) -> None:
    pack_positions(sa, id_col, width).write.parquet(path)


def read_binary(spark: SparkSession, path: str, id_col: str = "doc_id", width: int = 4) -> DataFrame:
    """(id, rank, pos) of what write_binary wrote."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in zip(b.column(id_col).to_pylist(), b.column("sa").to_pylist(), strict=True):
                pos = np.frombuffer(x, f"<u{width}").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pos), i, np.int64)), pa.array(np.arange(len(pos))), pa.array(pos)], names=[id_col, "rank", "pos"])

    return spark.read.parquet(path).select(id_col, "sa").mapInArrow(rows, f"`{id_col}` long, rank long, pos long")
