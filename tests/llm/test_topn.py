import random

import pytest

from sonoquarry.llm import topn

from ..conftest import rows

SCHEMA = "seed long, theme_id long, final double, audio_id long, mal_id long, _g int"


def brute(data, n, cap):
    out = []
    for seed in {r[0] for r in data if r[0] is not None}:
        own = [r for r in data if r[0] == seed and r[1] is not None and r[1] != seed and r[2] is not None and r[2] == r[2]]
        own.sort(key=lambda r: (-r[2], r[1], r[3] is None, r[3] or 0))
        heard, per, kept = set(), {}, []
        for r in own:
            if r[3] is not None and r[3] in heard:
                continue
            heard.add(r[3])
            if r[4] is not None:
                per[r[4]] = per.get(r[4], 0) + 1
                if per[r[4]] > cap:
                    continue
            kept.append(r)
        out += [(seed, i + 1, r[1]) for i, r in enumerate(kept[:n])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    some = [None, *range(6)]
    data = [(rng.choice([None, 1, 1, 1, 2, 3]), rng.choice([None, *range(20)]), rng.choice([None, float("nan"), 0.1, 0.5, 0.5, 0.9, rng.random()]), rng.choice(some), rng.choice(some), 0) for _ in range(300)]
    data += data[:40]
    df = spark.createDataFrame(data, SCHEMA)
    got = topn.top_n(df, "seed", "theme_id", "final", unique="audio_id", cap="mal_id", n=7, per_cap=2, salts=3, exclude_self=True)
    assert rows(got) == brute(data, 7, 2)


def test_rows_without_keys_are_never_merged_or_capped(spark):
    df = spark.createDataFrame([(1, 5, 0.5, None, None, 0)] * 4, SCHEMA)
    assert rows(topn.top_n(df, "seed", "theme_id", "final", unique="audio_id", cap="mal_id", n=10, per_cap=1)) == [(1, i, 5) for i in (1, 2, 3, 4)]


def test_empty_and_refused(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rows(topn.top_n(df, "seed", "theme_id", "final", unique="audio_id", cap="mal_id")) == []
    own = spark.createDataFrame([(1, 1, 0.5, 1, 1, 0)], SCHEMA)
    assert rows(topn.top_n(own, "seed", "theme_id", "final", unique="audio_id", cap="mal_id")) == [(1, 1, 1)]
    with pytest.raises(ValueError):
        topn.top_n(df, "seed", "theme_id", "final", unique="audio_id", cap="mal_id", n=0)
