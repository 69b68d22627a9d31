"""Every registered query against its SQL on the small tables."""

import pytest

from strandlake import registry

from .conftest import same


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, sf_dir, duck, name):
    same(registry.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(registry.ORACLE[name]).df())


def test_entry_points(spark, sf_dir):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_whole_documents(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sa = registry.QUERIES["sa_documents"](spark, sf_dir)
    assert sa.count() == docs.agg(F.sum(F.octet_length("text"))).first()[0]
    per = sa.groupBy("doc_id").agg(F.countDistinct("pos").alias("p"), F.countDistinct("rank").alias("r"), F.max("rank").alias("m"))
    assert per.where("p <> r or m <> r - 1").count() == 0
