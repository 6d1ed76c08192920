"""References to records that do not exist (problem 5).

References are grouped by the null mask of their key; each mask is checked on its non-null columns
by a left anti join, under declared match semantics:

- ``simple``: a key with any null is no reference.
- ``partial``: the non-null columns must be found together in one target row; all null is no reference.
- ``full``: all null is no reference; a key null only in part is an orphan (reason ``mixed_null``).

The target is first reduced to the disjoint spans of time in which a key was there. Spans are merged
in two stages, salted within the key and then across its salts, so that a key that holds a large
share of all target rows is reduced by many tasks. A reference meets at most one span; a hot
referring key is split by adaptive skew handling.

Defined results: no ``ingested_at`` on the target row: it is never there, but its key isn't missing.
No ``ingested_at`` on the referring row: an orphan with null period, ``missing`` or ``late``.
Repeated referring rows each give a row; an empty target makes every reference ``missing``.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MATCHES = ("simple", "partial", "full")
#: End of a span that hasn't ended.
_FOREVER = "9999-12-31 00:00:00"


def _merge(spans: DataFrame, by: list[str]) -> DataFrame:
    """Union of the spans ``[since, until)`` within each group, as disjoint spans."""
    w = Window.partitionBy(*by).orderBy("since", "until")
    before = F.max("until").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_new", F.when(before.isNull() | (F.col("since") > before), 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_island").agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("_island")


def presence(target: DataFrame, keys: list[str], since: str, until: str | None, salts: int = 16) -> DataFrame:
    """Disjoint spans of time in which each key had a row: ``keys, since, until``."""
    forever = F.lit(_FOREVER).cast("timestamp_ntz")
    end = F.coalesce(F.col(until).cast("timestamp_ntz"), forever) if until else forever
    rows = target.select(*keys, F.col(since).cast("timestamp_ntz").alias("since"), end.alias("until"))
    # rows with the same start: the longest holds the others; map-side combined, so repeated rows go before the shuffle
    rows = rows.filter("since is not null and until > since").groupBy(*keys, "since").agg(F.max("until").alias("until"))
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("since"), F.lit(salts)).cast("int"))
    return _merge(_merge(rows, [*keys, "_salt"]).drop("_salt"), keys)


def orphans(
    refs: DataFrame, ref_keys: list[str], ref_id: str, ref_time: str,
    target: DataFrame, target_keys: list[str], since: str, until: str | None,
    *, ref_table: str, match: str = "simple", salts: int = 16,
) -> DataFrame:
    """``ref_table, row_id, reason, period`` of every reference whose target wasn't there at the time of the referring row."""
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}, got {match!r}")
    if len(ref_keys) != len(target_keys) or not ref_keys:
        raise ValueError("ref_keys and target_keys must pair up")
    names = [f"_k{i}" for i in range(len(ref_keys))]
    r = refs.select(F.col(ref_id).alias("row_id"), F.col(ref_time).cast("timestamp_ntz").alias("_at"), *[F.col(c).alias(n) for c, n in zip(ref_keys, names)])
    t = target.select(*[F.col(c).alias(n) for c, n in zip(target_keys, names)], F.col(since).alias("_since"), (F.col(until) if until else F.lit(None).cast("timestamp")).alias("_until"))
    found = []
    for mask in product((False, True), repeat=len(names)):  # True: the column is null
        held = [n for n, null in zip(names, mask) if not null]
        if not held or match == "simple" and any(mask):
            continue
        part = r
        for n, null in zip(names, mask):
            part = part.filter(F.col(n).isNull() if null else F.col(n).isNotNull())
        if match == "full" and any(mask):
            found.append(part.select("row_id", F.lit("mixed_null").alias("reason"), "_at"))
            continue
        known = t
        for n in held:
            known = known.filter(F.col(n).isNotNull())
        spans = presence(known, held, "_since", "_until", salts).select(*[F.col(n).alias(f"_t{n}") for n in held], "since", "until")
        on = [F.col(n) == F.col(f"_t{n}") for n in held]
        gone = part.join(spans, [*on, F.col("_at") >= F.col("since"), F.col("_at") < F.col("until")], "left_anti")
        first = known.groupBy(*[F.col(n).alias(f"_t{n}") for n in held]).agg(F.min(F.col("_since").cast("timestamp_ntz")).alias("_first"), F.lit(True).alias("_known"))
        reason = F.when(F.col("_known").isNull(), "missing").when(F.col("_first") <= F.col("_at"), "deleted").otherwise("late")
        found.append(gone.join(first, on, "left").select("row_id", reason.alias("reason"), "_at"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.lit(ref_table).alias("ref_table"), "row_id", "reason", F.date_format("_at", "yyyy-MM").alias("period"))


def report(found: DataFrame) -> DataFrame:
    """Orphans per table, period and reason: ``ref_table, period, reason, n_orphans``."""
    return found.groupBy("ref_table", "period", "reason").agg(F.count(F.lit(1)).alias("n_orphans"))
