"""Top N items within every group (problem 4), by two-stage salted ranking.

Each group is hashed into subgroups; every subgroup keeps at most N rows, and only these survivors
are ranked per group. The subgroup is chosen by the de-duplication key, so all rows that could
replace one another meet in the first stage. A subgroup's N best after its own de-duplication and
capping are enough: a row below them has N better rows left in the whole group too, because for each
cap key at least as many better rows survive the whole group's cap as survived the subgroup's.

The first window drops repeated keys and is limited before its shuffle (map side), so a hot pair of group and key never travels
whole; rows without a key are limited by all their values instead. A second shuffle brings the subgroups together: it can't be the first one's, as only a shuffle by the whole
key allows the limit before it. A group of any size is spread over ``salts`` tasks.

Defined results: rows without group, item or score (null or NaN) are left out, with ``exclude_self`` also rows whose item
is the group itself. Null de-duplication keys are never merged, null cap keys never capped. Equal
scores order by item, then by key; repeated rows with null key each count. Empty input: empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n(
    rows: DataFrame, group: str, item: str, score: str, *, unique: str, cap: str, n: int = 10, per_cap: int = 5, salts: int = 32, exclude_self: bool = False,
) -> DataFrame:
    """``group, rank_no, item``: the first ``n`` rows per group, one per ``unique`` key and ``per_cap`` per ``cap`` key."""
    if min(n, per_cap, salts) < 1:
        raise ValueError("n, per_cap and salts must be at least 1")
    r = rows.select(F.col(group).alias("_g"), F.col(item).alias("_i"), F.col(score).alias("_s"), F.col(unique).alias("_u"), F.col(cap).alias("_c"))
    r = r.filter("_s is not null and not isnan(_s) and _i is not null and _g is not null")
    if exclude_self:
        r = r.filter("_i <> _g")

    def place(*by: str):
        return F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_s").desc(), F.col("_i").asc(), F.col("_u").asc_nulls_last()))

    def rank(d: DataFrame, *by: str) -> DataFrame:
        capped = d.withColumn("_n", place(*by, "_c")).filter((F.col("_n") <= per_cap) | F.col("_c").isNull())
        return capped.withColumn("_n", place(*by)).filter(F.col("_n") <= n)

    one = r.filter("_u is not null").withColumn("_n", place("_g", "_u")).filter("_n = 1").drop("_n")
    # of rows alike without a key no more than n can come out
    alike = r.filter("_u is null").withColumn("_n", place("_g", "_i", "_s", "_c")).filter(F.col("_n") <= n).drop("_n")
    every = one.unionByName(alike)
    salted = every.withColumn("_salt", F.pmod(F.when(F.col("_u").isNull(), F.xxhash64("_i", "_s", "_c")).otherwise(F.xxhash64("_u")), F.lit(salts)).cast("int"))
    survivors = rank(salted.repartition("_g", "_salt"), "_g", "_salt").drop("_salt", "_n")
    ranked = rank(survivors.repartition("_g"), "_g")
    return ranked.select(F.col("_g").alias(group), F.col("_n").cast("int").alias("rank_no"), F.col("_i").alias(item))
