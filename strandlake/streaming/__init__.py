"""Suffix arrays of texts that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.suffix import suffix_array


def index_stream(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The streaming (id, rank, pos) of each new text; texts are sorted where they are read, without state."""
    return suffix_array(texts, id_col, text_col, "local")


def write_index(texts: DataFrame, path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text"):
    """Starts the query that appends the index to Parquet; file sink and checkpoint make each text count once."""
    return index_stream(texts, id_col, text_col).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
