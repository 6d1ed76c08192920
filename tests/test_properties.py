"""Properties over generated inputs."""

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from sonoquarry.config import Config
from sonoquarry.operators import pairs
from sonoquarry.operators.evaluate import expected_reciprocal, resampled

row = st.tuples(
    st.integers(0, 4), st.integers(0, 6), st.one_of(st.none(), st.lists(st.one_of(st.none(), st.integers(0, 5)), max_size=4)),
    st.one_of(st.none(), st.lists(st.one_of(st.none(), st.sampled_from("abcd")), max_size=4)), st.one_of(st.none(), st.integers(1990, 2000)),
)


@settings(max_examples=60, deadline=None)
@given(st.lists(row, min_size=2, max_size=15), st.booleans())
def test_scores(rows, exclude):
    rng = np.random.default_rng(len(rows))
    u = rng.normal(size=(len(rows), 4))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    f = pd.DataFrame([(i + 1, *r, u[i]) for i, r in enumerate(rows)], columns=["theme_id", "mal_id", "audio_id", "artist_ids", "genres", "start_year", "u"])
    f["start_year"] = f["start_year"].astype("Int64")
    side = pairs.Side.of(f)
    for s in pairs.score(side, side, Config(), 2.0, exclude, step=4):
        assert s.weight.min() >= 0 and s.weight.max() <= 1 + 1e-12
        for i in range(len(s.final)):
            a = s.at.start + i
            for b in range(len(rows)):
                same = rows[a][0] == rows[b][0]
                assert s.allowed[i, b] == (a != b and not (exclude and same))
                x, y = ({v for v in (r[2] or []) if v is not None} for r in (rows[a], rows[b]))
                assert s.partner[i, b] == bool(x & y)
                g, h = ({v for v in (r[3] or []) if v is not None} for r in (rows[a], rows[b]))
                assert abs(s.jaccard[i, b] - (len(g & h) / len(g | h) if g | h else 0)) < 1e-12
                known = rows[a][4] is not None and rows[b][4] is not None
                assert s.era[i, b] == (known and abs(rows[a][4] - rows[b][4]) <= 2)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 300), st.integers(0, 300))
def test_random_reciprocal_grows_with_relevant_items(pool, relevant):
    relevant = min(relevant, pool)
    here = expected_reciprocal(pool, relevant)
    assert 0 <= here <= 1 + 1e-12
    if relevant < pool:
        assert expected_reciprocal(pool, relevant + 1) >= here - 1e-12


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=40))
def test_intervals_hold_order_and_range(values):
    low, high = resampled(np.array(values))
    assert min(values) - 1e-9 <= low <= high <= max(values) + 1e-9
