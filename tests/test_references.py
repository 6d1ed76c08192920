import datetime as dt
import random

import pytest

from sonoquarry.operators import references

from .conftest import rows


def t(day):
    return None if day is None else dt.datetime(2024, 1, 1) + dt.timedelta(days=day)


def run(spark, refs, targets, match="simple", keys=1, salts=3):
    ks = [f"k{i}" for i in range(keys)]
    kinds = ", ".join(f"{k} long" for k in ks)
    r = spark.createDataFrame([(i, *k, t(d), "x") for i, (k, d) in enumerate(refs)], f"id long, {kinds}, at timestamp_ntz, reason string")
    g = spark.createDataFrame([(*k, t(a), t(b), 1) for k, a, b in targets], f"{kinds}, since timestamp_ntz, gone timestamp_ntz, row_id int")
    return {x[1]: x[2] for x in rows(references.orphans(r, ks, "id", "at", g, ks, "since", "gone", ref_table="refs", match=match, salts=salts))}


def test_reasons(spark):
    targets = [((1,), 0, None), ((2,), 0, 5), ((3,), 9, None), ((4,), None, None), ((2,), 20, None)]
    refs = [((1,), 0), ((1,), 40), ((2,), 4), ((2,), 5), ((2,), 20), ((3,), 8), ((9,), 1), ((None,), 1), ((4,), 3), ((1,), None), ((9,), None)]
    assert run(spark, refs, targets) == {3: "deleted", 5: "late", 6: "missing", 8: "late", 9: "late", 10: "missing"}


def test_period_and_report(spark):
    r = spark.createDataFrame([(1, 5, t(40)), (2, 5, t(40))], "id long, k long, at timestamp_ntz")
    g = spark.createDataFrame([], "k long, since timestamp_ntz, gone timestamp_ntz")
    got = references.orphans(r, ["k"], "id", "at", g, ["k"], "since", "gone", ref_table="refs")
    assert rows(got) == [("refs", 1, "missing", "2024-02"), ("refs", 2, "missing", "2024-02")]
    assert rows(references.report(got)) == [("refs", "2024-02", "missing", 2)]


def test_composite_keys_with_nulls(spark):
    targets = [((1, 2), 0, None), ((3, None), 0, None)]
    refs = [((1, 2), 1), ((1, None), 1), ((None, 2), 1), ((None, 7), 1), ((None, None), 1), ((3, None), 1), ((1, 9), 1)]
    assert run(spark, refs, targets, "simple", 2) == {6: "missing"}
    assert run(spark, refs, targets, "partial", 2) == {3: "missing", 6: "missing"}
    assert run(spark, refs, targets, "full", 2) == {1: "mixed_null", 2: "mixed_null", 3: "mixed_null", 5: "mixed_null", 6: "missing"}


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    def day():
        return rng.choice([None, *range(12)])
    targets = [((rng.randrange(4) if rng.random() < 0.5 else 0,), day(), day()) for _ in range(40)]  # one hot key
    refs = [((rng.choice([None, 0, 0, 1, 2, 3, 4]),), rng.randrange(14)) for _ in range(80)]
    expected = {}
    for i, ((k,), d) in enumerate(refs):
        own = [(a, b) for (x,), a, b in targets if x == k]
        if k is None or any(a is not None and a <= d and (b is None or b > d) for a, b in own):
            continue
        expected[i] = "missing" if not own else "deleted" if any(a is not None and a <= d for a, b in own) else "late"
    assert run(spark, refs, targets) == expected


def test_refuses_unknown_semantics(spark):
    with pytest.raises(ValueError):
        run(spark, [], [], "fuzzy")
