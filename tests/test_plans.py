"""The plans that the operators are meant to get."""

import re

import pytest

from sonoquarry.operators import catalogue, nested, references
from sonoquarry.session import spread


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "mal")
    spark.createDataFrame([(i, float(i), 2000 + i, "x" * 50) for i in range(100)], "mal_id long, score double, start_year int, synopsis string").write.parquet(path)
    return path


def test_filters_and_columns_reach_the_scan(spark, stored):
    p = plan(spark.read.parquet(stored).filter("score >= 7.5").groupBy("start_year").count())
    assert "GreaterThanOrEqual(score,7.5)" in p and re.search(r"ReadSchema: struct<score:double,start_year:int>", p)


def test_nested_projection_has_no_shuffle(spark):
    p = plan(nested.level_rows(spark.createDataFrame([(1, "{}")], "record_id long, payload string")))
    assert "Exchange" not in p and p.count("Generate") == 1


def test_first_rows_are_limited_before_the_shuffle(spark, stored):
    p = plan(catalogue.keep_first(spark.read.parquet(stored), "start_year", "mal_id"))
    assert p.count("WindowGroupLimit") == 2


def test_references_never_cross(spark, stored):
    m = spark.read.parquet(stored).selectExpr("mal_id as k", "timestamp_ntz '2024-01-01' as at", "cast(null as timestamp_ntz) as gone")
    p = plan(references.orphans(m, ["k"], "k", "at", m, ["k"], "at", "gone", ref_table="r"))
    assert "NestedLoop" not in p and "Cartesian" not in p


def test_spread(spark, stored):
    assert spread(spark.read.parquet(stored).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
