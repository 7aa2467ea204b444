"""Queries at the smallest scale against their SQL."""

import pytest
from compare import duck, rows
from pyspark.sql import functions as F

import meshframe.llm.catalog as catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_same_rows(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name in catalog.SQL:
        r = duck(SF).execute(catalog.SQL[name])
        cols = [x[0] for x in r.description]
        assert sorted(cols) == sorted(df.columns)
        assert rows(df.columns, got) == rows(cols, r.fetchall())


def test_mixture_has_many_windows(spark):
    """At scale 0.01, the targets hold in several windows before a source runs dry."""
    x = catalog.p6_mixture(spark, "/root/testdata/sf0.01").where(F.col("source").isin(*catalog.P6_TARGETS))
    assert x.groupBy("source").agg(F.max("window").alias("last")).agg(F.min("last")).first()[0] >= 4
