from math import comb

import pytest
from pyspark.sql import functions as F

from sonoquarry.functions import scores
from sonoquarry.operators.evaluate import expected_reciprocal

NM = [(10, 1), (10, 3), (50, 1), (50, 7), (617, 1), (617, 4), (617, 60)]
KS = [1, 3, 5, 10, 20, 50, 100]


def test_recall_is_hypergeometric(spark):
    cases = [(n, m, k) for n, m in NM for k in KS] + [(100, 0, 10), (100, 5, 0), (10, 10, 1), (10, 1, 50)]
    df = spark.createDataFrame(cases, "n long, m long, k int").withColumn("x", scores.random_recall(F.col("n"), F.col("m"), F.col("k")))
    for r in df.collect():
        k = min(r.k, r.n)
        expected = 0.0 if r.m <= 0 or r.k <= 0 else 1 - comb(r.n - r.m, k) / comb(r.n, k)
        assert r.x == pytest.approx(expected, abs=1e-9), r


def test_mrr_closed_form(spark):
    df = spark.createDataFrame(NM + [(20, 0), (5, 5)], "n long, m long").withColumn("x", scores.random_mrr(F.col("n"), F.col("m")))
    for r in df.collect():
        expected = sum(comb(r.n - i, r.m - 1) / comb(r.n, r.m) / i for i in range(1, r.n - r.m + 2)) if r.m else 0.0
        assert r.x == pytest.approx(expected, abs=1e-9) and expected_reciprocal(r.n, r.m) == pytest.approx(expected, abs=1e-9)


def test_blocks_of_the_sum():
    assert expected_reciprocal(5000, 2, step=64) == pytest.approx(expected_reciprocal(5000, 2))
