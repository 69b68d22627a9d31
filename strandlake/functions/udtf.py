"""SQL surface: SELECT doc_id, s.* FROM documents, LATERAL suffix_array(text) s."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class _SuffixArray:
    def eval(self, text):
        from ..operators.suffix import sort_suffixes

        data = np.frombuffer((text.encode() if isinstance(text, str) else bytes(text or b"")), np.uint8)
        for rank, pos in enumerate(sort_suffixes(data, np.array([0, len(data)])).tolist()):
            yield rank, pos


class _Bwt:
    def eval(self, text):
        from ..operators.suffix import sort_suffixes

        data = np.frombuffer((text.encode() if isinstance(text, str) else bytes(text or b"")), np.uint8)
        if len(data):
            sa = sort_suffixes(data, np.array([0, len(data)]))
            yield bytes([data[-1]]) + data[sa[sa > 0] - 1].tobytes(), int(np.flatnonzero(sa == 0)[0]) + 1


def register(spark: SparkSession) -> None:
    """Table functions suffix_array(text) and bwt(text) for this session."""
    spark.udtf.register("suffix_array", udtf(_SuffixArray, returnType="rank bigint, pos bigint"))
    spark.udtf.register("bwt", udtf(_Bwt, returnType="bwt binary, primary_index bigint"))
