"""Metadata similarity, labels and closed-form random baselines as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config

# How strongly metadata counts in each mode.
MODES = {"purist": 0.0, "discovery": 1.0, "comfort": 2.0}


def mode_scale(mode: str) -> float:
    """How strongly metadata counts in ``mode``; ValueError for a name that isn't in ``MODES``."""
    scale = MODES.get(mode)
    if scale is None:
        raise ValueError(f"{mode!r} is no mode of ranking; there are " + ", ".join(MODES))
    return scale


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets without nulls; 0 for null or two empty ones."""
    x, y = F.filter(F.coalesce(a, F.array()), lambda v: v.isNotNull()), F.filter(F.coalesce(b, F.array()), lambda v: v.isNotNull())
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Whether two arrays share an element that isn't null; null arrays share none."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def same(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def era_match(a: Column, b: Column, window: int) -> Column:
    """Years at most ``window`` apart; an unknown year never matches."""
    return F.coalesce(F.abs(F.nanvl(a.cast("double"), F.lit(None)) - F.nanvl(b.cast("double"), F.lit(None))) <= window, F.lit(False))


def metadata_weight(same_anime: Column, same_artist: Column, era: Column, genre: Column, cfg: Config) -> Column:
    """Weighted sum of the four signals over its largest value (not normalised where that is 0 or less)."""
    raw = cfg.w_anime * same_anime.cast("double") + cfg.w_artist * same_artist.cast("double") + cfg.w_era * era.cast("double") + cfg.alpha_genre * genre
    return raw / cfg.w_max if cfg.w_max > 0 else raw


def theme_label(kind: Column, sequence: Column) -> Column:
    """Type and whole-number sequence, as OP2; a missing type prints None."""
    return F.concat(F.coalesce(kind, F.lit("None")), F.coalesce(sequence.cast("int").cast("string"), F.lit("")))


def artist_text(names: Column) -> Column:
    return F.coalesce(F.array_join(names, ", "), F.lit(""))


def normal_name(name: Column) -> Column:
    """Lower case, only a-z and digits; used as a key only where not empty."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "")


def half(group: Column) -> Column:
    """Stable half (0 or 1) of a group id: the parity of its digest."""
    return (F.conv(F.right(F.md5(group.cast("string")), F.lit(1)), 16, 10).cast("int") % 2).cast("int")


def random_recall(pool: Column, relevant: Column, k: Column) -> Column:
    """Chance that a random ranking of ``pool`` items has one of ``relevant`` in its first ``k``."""
    n, m = pool.cast("double"), relevant.cast("double")
    steps = F.least(k, pool).cast("int")
    miss = F.aggregate(F.sequence(F.lit(0), F.greatest(steps - 1, F.lit(0))), F.lit(1.0), lambda p, r: p * F.greatest(F.lit(0.0), (n - m - r) / F.greatest(n - r, F.lit(1.0))))
    return F.when((relevant <= 0) | (k <= 0), F.lit(0.0)).otherwise(1 - miss)


def random_mrr(pool: Column, relevant: Column) -> Column:
    """Expected reciprocal rank of the first relevant item in a random ranking."""
    n, m = pool.cast("double"), relevant.cast("double")
    start = F.struct(F.lit(1.0).alias("miss"), F.lit(0.0).alias("sum"))

    def step(s: Column, r: Column) -> Column:
        left = s["miss"] * F.greatest(F.lit(0.0), (n - m - (r - 1)) / F.greatest(n - (r - 1), F.lit(1.0)))
        return F.struct(left.alias("miss"), (s["sum"] + (s["miss"] - left) / r).alias("sum"))

    last = F.greatest((pool - relevant + 1).cast("int"), F.lit(1))
    return F.when(relevant <= 0, F.lit(0.0)).otherwise(F.aggregate(F.sequence(F.lit(1), last), start, step)["sum"])


def random_first_rank(pool: Column, relevant: Column) -> Column:
    return (pool + 1) / (relevant + 1)


def lift(value: Column, baseline: Column) -> Column:
    """value / baseline; null where the baseline isn't positive."""
    return F.when((baseline > 0) & ~F.isnan(baseline), value / baseline)
