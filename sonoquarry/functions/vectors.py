"""Vector expressions over ``array<double>`` columns, all on the JVM side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DegenerateVectors


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of the same length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column, length: Column) -> Column:
    """``v`` divided by its length, which is worked out once a row (inside of a lambda it would be for every value)."""
    return F.zip_with(v, F.array_repeat(length, F.size(v)), lambda x, n: x / n)


def usable(v: Column, dims: int | None = None) -> Column:
    """Whether a vector is there, complete, finite and not all zero (and of ``dims`` values)."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    if dims is not None:
        good = good & (F.size(v) == dims)
    return F.coalesce(good, F.lit(False))


def element_means(df: DataFrame, vector: str) -> DataFrame:
    """``pos, mean``: the mean of every coordinate. Rows of null vectors don't count."""
    return df.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"))


def mean_offdiagonal_cosine(df: DataFrame, unit_vector: str) -> DataFrame:
    """``n, mean_cosine`` over all pairs of different rows, in linear time: (|sum of units|^2 - n) / (n (n - 1)). Null below two rows."""
    sums = df.select(F.posexplode(unit_vector).alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("s"), F.count("x").alias("n"))
    total = sums.agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q"))
    n = F.col("n").cast("double")
    return total.select("n", F.when(n > 1, (F.col("q") - n) / (n * (n - 1))).alias("mean_cosine"))


def check_vectors(df: DataFrame, ident: str, vector: str) -> int:
    """Dimension of the vectors; DegenerateVectors for none, ragged or zero ones (up to ten ids are named)."""
    sizes = df.agg(F.min(F.size(vector)).alias("a"), F.max(F.size(vector)).alias("b")).first()
    if sizes.a is None:
        raise DegenerateVectors("no vectors")
    if sizes.a != sizes.b:
        raise DegenerateVectors(f"ragged vectors: lengths {sizes.a} to {sizes.b}")
    bad = [r[0] for r in df.filter(~(norm(F.col(vector)) > 0)).select(ident).orderBy(ident).limit(10).collect()]
    if bad:
        raise DegenerateVectors(f"zero norm vectors, for example {bad}")
    return sizes.a
