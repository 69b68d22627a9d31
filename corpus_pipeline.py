"""The corpus pipeline: operators of strandlake.llm, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from strandlake.llm import decontaminate, jaccard, packing, pii, quality
from strandlake.llm.textkit import written


def quality_rules(spark, docs, sf_dir):
    """Documents that pass the base rules and the trees learned from labels."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def jaccard_join(spark, docs, sf_dir):
    """One document of each group of near copies (five words a shingle, 0.8): the one with the least id."""
    return jaccard.one_of_each(docs, 5, 80)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents of which less than a twentieth is benchmark text, without that text."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_pseudonyms(spark, docs, sf_dir):
    """All documents with pseudonyms for personal data."""
    return pii.replace_pii(docs, pii.secret_key(spark, pii.DEMO_KEY))


def vector_packing(spark, docs, sf_dir):
    """All documents' ids in sequences of 1024 at most."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", quality_rules), ("jaccard_join", jaccard_join), ("benchmark_decontamination", benchmark_decontamination), ("pii_pseudonyms", pii_pseudonyms), ("vector_packing", vector_packing)]
#: Trees, pseudonyms and packing are beyond SQL; tests/llm/test_dedup.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Applies all stages to documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
