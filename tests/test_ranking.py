"""Rankings over stored blocks against the dense scores of all pairs."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from sonoquarry.functions import scores
from sonoquarry.operators import evaluate, pairs, ranking, recommend
from sonoquarry.session import cut

from .test_retrieval import CFG, corpus

RECOMMENDED = {
    "recommend_cap1": dict(max_per_anime=1),
    "recommend_comfort": dict(mode="comfort"),
    "recommend_exclude_same": dict(exclude_same_anime=True),
    "recommend_whitened": dict(),
    "recommend_cap5": dict(max_per_anime=5),
    "recommend_discovery": dict(mode="discovery"),
    "recommend_no_dedup": dict(dedup_audio=False),
    "recommend_purist": dict(mode="purist"),
}


def table(n=400, dims=6, seed=5, names=9):
    """Rows with shared recordings, anime and artists, missing values and vectors that occur several times."""
    rng = np.random.default_rng(seed)
    u = rng.normal(size=(n, dims))
    u[rng.integers(0, n, n // 4)] = u[0]
    u /= np.linalg.norm(u, axis=1)[:, None]
    some = lambda kind: [None if rng.random() < 0.1 else [kind(rng.integers(0, names)) for _ in range(rng.integers(0, 4))] for _ in range(n)]
    near = some(lambda x: f"m{x}")
    return pa.table({
        "theme_id": pa.array(rng.permutation(n) + 1), "mal_id": pa.array(rng.integers(0, n // 5, n)), "audio_id": pa.array(rng.integers(0, n // 2, n)), "artist_ids": pa.array(some(int), pa.list_(pa.int64())),
        "genres": pa.array(some(lambda x: f"g{x}"), pa.list_(pa.string())), "start_year": pa.array([None if y == 2000 else int(y) for y in rng.integers(1995, 2006, n)], pa.int32()), "u": pa.array(list(u)),
        "mbids": pa.array([[f"m{x}"] for x in rng.integers(0, names, n)], pa.list_(pa.string())), "near_mbids": pa.array(near, pa.list_(pa.string())),
    })


def dense(t, scale, exclude):
    side = pairs.Side.of(t.to_pandas())
    out = []
    for s in pairs.score(side, side, CFG, scale, exclude):
        i, j = np.nonzero(s.allowed)
        out.append(pd.DataFrame({"seed": side.theme_id[s.at][i], "theme_id": side.theme_id[j], "mal": side.mal_id[j], "audio": side.audio_id[j], "final": s.final[i, j]}))
    return pd.concat(out).sort_values(["seed", "final", "theme_id"], ascending=[True, False, True])


@pytest.mark.parametrize("name", RECOMMENDED)
@pytest.mark.parametrize("blocks", [1, 4])
def test_first_are_those_of_all_pairs(name, blocks):
    kw = {"mode": "discovery", "exclude_same_anime": False, "dedup_audio": True, "max_per_anime": None} | RECOMMENDED[name]
    t, scale = table(), scores.mode_scale(kw["mode"])
    d = dense(t, scale, kw["exclude_same_anime"])
    if kw["dedup_audio"]:
        d = d[d.groupby(["seed", "audio"]).cumcount() == 0]
    if kw["max_per_anime"]:
        d = d[d.groupby(["seed", "mal"]).cumcount() < kw["max_per_anime"]]
    wanted = d[d.groupby("seed").cumcount() < 20].groupby("seed")["theme_id"].apply(list).to_dict()
    a = ranking.Rows(t, seeds=True)
    first = ranking.First(a.n, 20, kw["dedup_audio"], kw["max_per_anime"], ranking.margin(6, CFG, scale))
    block = t["audio_id"].to_numpy() % blocks
    for b in range(blocks):
        for s in ranking.Cell(a, ranking.Rows(t.filter(pa.array(block == b)), seeds=False), CFG, scale, kw["exclude_same_anime"]).slices():
            first.offer(s, s.near())
    got = pd.concat([pd.DataFrame({"seed": a.theme[f["row"]], "theme_id": f["theme"], "place": f["place"]}) for f in first.results()]).sort_values(["seed", "place"])
    assert got.groupby("seed")["theme_id"].apply(list).to_dict() == wanted


@pytest.mark.parametrize("name", RECOMMENDED)
def test_no_row_is_copied_for_each_line(spark, monkeypatch, name):
    """The disk that a ranking takes: every candidate is stored once, and nothing is exchanged after that."""
    rng = np.random.default_rng(2)
    c = recommend.prepare(corpus(spark, rng.normal(size=(80, 8)), audio=rng.integers(0, 60, 80).tolist())).cache()
    monkeypatch.setattr(pairs, "CANDIDATES", 17)
    stored, store = [], pairs._store
    monkeypatch.setattr(pairs, "_store", lambda df, by: stored.append(store(df, by)) or stored[-1])
    found = recommend.recommend(c, CFG, **RECOMMENDED[name])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and sum(spark.read.parquet(x).count() for x in stored) == 80
    assert found.count() == 80 * 20


def seed_rows(t, scale, exclude, control_k):
    """The evaluation of every seed out of the dense scores."""
    f = t.to_pandas().sort_values("theme_id")
    side = pairs.Side.of(f)
    own, near = ([{x for x in v if x is not None} if v is not None else set() for v in f[c]] for c in ("mbids", "near_mbids"))
    out = []
    for s in pairs.score(side, side, CFG, scale, exclude):
        for i in range(len(s.final)):
            a = s.at.start + i
            d = pd.DataFrame({"theme": side.theme_id, "audio": side.audio_id, "final": s.final[i], "artist": s.partner[i], "behavioural": [bool(own[j] & (near[a] - own[a])) and not own[j] & own[a] for j in range(len(f))],
                              "share": s.jaccard[i] > 0, "jaccard": s.jaccard[i], "near": s.era[i]})[s.allowed[i]].sort_values(["final", "theme"], ascending=[False, True]).drop_duplicates("audio").reset_index(drop=True)
            row = {"seed": side.theme_id[a], "pool": len(d)}
            for x in ("artist", "behavioural"):
                row |= {f"n_{x}": d[x].sum(), f"{x}_rank": d.index[d[x]][0] + 1 if d[x].any() else 0}
            out.append(row | {f"{x}_at": d[x][:control_k].mean() for x in ("share", "jaccard", "near")} | {f"{x}_pool": d[x].mean() for x in ("share", "jaccard", "near")})
    return pd.DataFrame(out).set_index("seed").sort_index().astype(float)


def line_of(t, blocks, scale, exclude, spread=()):
    line = evaluate._Line(ranking.Rows(t, seeds=True, carry=True), CFG, scale, exclude, 10)
    audio, theme = t["audio_id"].to_numpy(), t["theme_id"].to_numpy()
    hot = np.isin(audio, spread)
    block = np.where(hot, theme, audio) % blocks
    parts = [t.append_column("hot", pa.array(hot)).filter(pa.array(block == b)) for b in range(blocks)]
    for p in parts:
        line.seek(p)
    line.between()
    for p in parts:
        line.rank(p)
    return line.table(10)


@pytest.mark.parametrize("mode", scores.MODES)
@pytest.mark.parametrize("blocks,spread", [(1, ()), (3, ()), (3, (4, 7))])
def test_seed_table_is_that_of_all_pairs(mode, blocks, spread):
    t, scale = table(n=300), scores.mode_scale(mode)
    got = line_of(t, blocks, scale, True, spread).set_index("seed").sort_index()
    wanted = seed_rows(t, scale, True, 10)
    assert len(got) == len(wanted) == 300
    assert np.abs(got[wanted.columns].fillna(0).astype(float) - wanted).max().max() < 1e-9


#: Each query that is made of ``seed_table``, with the modes that it ranks in.
EVALUATED = {
    "artist_first_hit": ("purist",),
    "bootstrap_ci_large": ("purist",),
    "lift_table": ("purist",),
    "paired_delta": ("purist", "comfort"),
    "recall_at_k": ("purist",),
    "sweep_vectors": ("purist",),
    "bootstrap_bounds": ("purist",),
    "controls": ("purist",),
    "median_ranks": ("purist",),
    "random_mrr": ("purist",),
    "related_first_hit": ("purist",),
    "variant_sweep": tuple(scores.MODES),
    "bootstrap_ci": ("purist",),
    "eval_seed_table": ("purist",),
    "mrr": ("purist",),
    "random_recall": ("purist",),
}


@pytest.mark.parametrize("mode", sorted({m for x in EVALUATED.values() for m in x}))
def test_few_pairs_are_scored_exactly(monkeypatch, mode):
    """The time that an evaluation takes: the bound settles nearly all pairs."""
    scored, exact = [], ranking.Slice.exact
    monkeypatch.setattr(ranking.Slice, "exact", lambda s, r, c: scored.append(len(r)) or exact(s, r, c))
    t = table(n=3000, dims=32, names=200)
    rng = np.random.default_rng(9)
    u = rng.normal(size=(3000, 32))
    t = t.set_column(t.column_names.index("u"), "u", pa.array(list(u / np.linalg.norm(u, axis=1)[:, None])))
    assert len(line_of(t, 2, scores.mode_scale(mode), True)) == 3000
    assert sum(scored) < 0.1 * 3000 * 3000


#: Rankings whose disk is watched.
STORED = ["recommend_comfort", "recommend_exclude_same", "recommend_whitened", "recommend_cap5", "recommend_discovery", "recommend_no_dedup", "recommend_purist"]


@pytest.mark.parametrize("name", STORED)
def test_blocks_are_stored_without_another_copy(spark, monkeypatch, name):
    """The disk that a query takes besides its blocks: vectors are written as they came, unit vectors only into the blocks, and without an exchange."""
    from sonoquarry.plans import retrieval_queries

    written, plans, cut, store = [], [], retrieval_queries.cut, pairs._store
    monkeypatch.setattr(retrieval_queries, "cut", lambda df: written.extend(df.columns) or cut(df))
    monkeypatch.setattr(pairs, "_store", lambda df, by: plans.append(df._jdf.queryExecution().executedPlan().toString()) or store(df, by))
    found = retrieval_queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert written and "u" not in written
    assert len(plans) == 1 and "Exchange" not in plans[0] and "FileScan" in plans[0]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


#: Queries made of ``seed_table`` of which the scores' way through the cache is watched.
TILED = ["bootstrap_ci_large", "lift_table", "paired_delta", "recall_at_k", "sweep_vectors", "bootstrap_bounds", "controls", "median_ranks", "random_mrr", "related_first_hit", "variant_sweep", "bootstrap_ci", "eval_seed_table", "mrr", "random_recall"]


@pytest.mark.parametrize("name", TILED)
def test_scores_are_made_and_judged_some_columns_at_a_time(monkeypatch, name):
    """Only a line's first block is scored whole, and one comparison finds the few candidates before early first hits."""
    widths, near, mode = [], ranking.Slice.near, EVALUATED[name][-1]
    monkeypatch.setattr(ranking.Slice, "near", lambda s, low=0, high=None: widths.append(((s.width if high is None else high) - low, s.width)) or near(s, low, high))
    monkeypatch.setattr(ranking, "TILE", 40, raising=False)
    t, scale = table(n=400), scores.mode_scale(mode)
    got = line_of(t, 4, scale, True).set_index("seed").sort_index()
    wanted = seed_rows(t, scale, True, 10)
    assert np.abs(got[wanted.columns].fillna(0).astype(float) - wanted).max().max() < 1e-9
    slices = -(-400 // ranking.STEP)
    assert sum(w == whole for w, whole in widths) == slices < len(widths)


def test_large_intervals_draw_once_a_seed(spark):
    """Weights are of a seed, whatever the number of its metrics."""
    values = spark.createDataFrame([(m, s, float(s % 7)) for m in ("a", "b", "c") for s in range(60)], "name string, seed long, value double")
    plan = evaluate.intervals_large(values, resamples=50)._jdf.queryExecution().executedPlan().toString()
    got = {r.name: (r.ci_low, r.ci_high) for r in evaluate.intervals_large(values, resamples=50).collect()}
    weights = np.stack([np.random.default_rng([evaluate.SEED, s]).poisson(1.0, 50) for s in range(60)])
    low, high = np.percentile((weights * (np.arange(60) % 7)[:, None]).sum(0) / weights.sum(0), [2.5, 97.5])
    assert set(got) == {"a", "b", "c"} and all(abs(x - low) < 1e-9 and abs(y - high) < 1e-9 for x, y in got.values())
    assert "hashpartitioning(seed" in plan


#: Rankings whose way past the metadata is watched.
LOOKED_UP = ["recommend_exclude_same", "recommend_whitened", "recommend_cap5", "recommend_discovery", "recommend_no_dedup", "recommend_purist"]


@pytest.mark.parametrize("name", LOOKED_UP)
def test_metadata_is_looked_up_for_few_pairs(monkeypatch, name):
    """Whole scores of all pairs are made of a line's first block only; after it, of the pairs that metadata could lift to a seed's limit."""
    kw = {"mode": "discovery", "exclude_same_anime": False, "dedup_audio": True, "max_per_anime": None} | RECOMMENDED[name]
    n, dims, blocks, k = 1200, 32, 4, 5
    u = np.random.default_rng(3).normal(size=(n, dims))
    t = table(n=n, dims=dims, names=40)
    t = t.set_column(t.column_names.index("u"), "u", pa.array(list(u / np.linalg.norm(u, axis=1)[:, None])))
    scale = scores.mode_scale(kw["mode"])
    d = dense(t, scale, kw["exclude_same_anime"])
    if kw["dedup_audio"]:
        d = d[d.groupby(["seed", "audio"]).cumcount() == 0]
    if kw["max_per_anime"]:
        d = d[d.groupby(["seed", "mal"]).cumcount() < kw["max_per_anime"]]
    wanted = d[d.groupby("seed").cumcount() < k].groupby("seed")["theme_id"].apply(list).to_dict()
    monkeypatch.setattr(ranking, "TILE", 96)
    whole, near = [], ranking.Slice.near
    monkeypatch.setattr(ranking.Slice, "near", lambda s, low=0, high=None: whole.append((s.e - s.s) * ((s.width if high is None else high) - low)) or near(s, low, high))
    a = ranking.Rows(t, seeds=True)
    first = ranking.First(a.n, k, kw["dedup_audio"], kw["max_per_anime"], ranking.margin(dims, CFG, scale))
    block = t["audio_id"].to_numpy() % blocks
    for b in range(blocks):
        for s in ranking.Cell(a, ranking.Rows(t.filter(pa.array(block == b)), seeds=False), CFG, scale, kw["exclude_same_anime"]).slices():
            first.search(s)
    got = pd.concat([pd.DataFrame({"seed": a.theme[f["row"]], "theme_id": f["theme"], "place": f["place"]}) for f in first.results()]).sort_values(["seed", "place"])
    assert got.groupby("seed")["theme_id"].apply(list).to_dict() == wanted
    assert sum(whole) == n * (block == 0).sum()


def test_whitened_vectors_are_stored_without_those_they_are_made_of(spark, monkeypatch):
    """The disk of ``recommend_whitened`` besides its blocks: vectors once as they came, once whitened."""
    from sonoquarry.operators import whitening
    from sonoquarry.plans import retrieval_queries

    written, cut = [], whitening.cut
    monkeypatch.setattr(whitening, "cut", lambda df: written.append(df.columns) or cut(df))
    retrieval_queries.recommend_whitened(spark, "/root/testdata/sf0.001")
    assert len(written) == 1 and "whitened" in written[0] and "embedding" not in written[0]


#: Queries made of ``seed_table`` of which the counts of many candidates are watched.
COUNTED = ["paired_delta", "variant_sweep", "lift_table", "recall_at_k", "sweep_vectors", "bootstrap_bounds", "controls", "median_ranks", "random_mrr", "related_first_hit", "bootstrap_ci", "eval_seed_table", "mrr", "random_recall"]


@pytest.mark.parametrize("name", COUNTED)
def test_counted_scores_are_listed_only_where_some_are_too_near_to_tell(monkeypatch, name):
    """Where many stand before a seed's limits they are counted twice, below and above the margin; and genres are taken once a genre set, not once a seed."""
    mode, n = EVALUATED[name][-1], 400
    t, scale = table(n=n, dims=32), scores.mode_scale(mode)
    u = np.random.default_rng(4).normal(size=(n, 32))
    t = t.set_column(t.column_names.index("u"), "u", pa.array(list(u / np.linalg.norm(u, axis=1)[:, None])))
    monkeypatch.setattr(evaluate, "MANY", 1 << 40)
    monkeypatch.setattr(ranking, "TILE", 40)
    listed, places, taken, take = [], ranking.places, [], np.take
    monkeypatch.setattr(ranking, "places", lambda flags: listed.append(flags.size) or places(flags))
    monkeypatch.setattr(np, "take", lambda *x, **kw: taken.append(1) or take(*x, **kw))
    slices, near = [], ranking.Slice.near
    monkeypatch.setattr(ranking.Slice, "near", lambda s, low=0, high=None: slices.append(len(np.unique(s.cell.a.kind[s.s:s.e]))) or near(s, low, high))
    got = line_of(t, 4, scale, True).set_index("seed").sort_index()
    wanted = seed_rows(t, scale, True, 10)
    assert np.abs(got[wanted.columns].fillna(0).astype(float) - wanted).max().max() < 1e-9
    assert len(taken) == (sum(slices) if scale else 0)
    assert sum(listed) < 1.95 * n * n


@pytest.mark.parametrize("name", ["paired_delta", "variant_sweep"])
def test_modes_read_the_same_blocks(spark, monkeypatch, name):
    """The catalogue is prepared and stored once, whatever the number of modes."""
    from sonoquarry.plans import retrieval_queries

    stored, store = [], pairs._store
    monkeypatch.setattr(pairs, "_store", lambda df, by: stored.append(by) or store(df, by))
    retrieval_queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert len(stored) == 1 < len(EVALUATED[name])


@pytest.mark.parametrize("name", [
    "recommend_cap5",
    "recommend_discovery",
    "recommend_no_dedup",
    "recommend_purist",
])
def test_shuffle_files_go_with_the_write(spark, name):
    """What was shuffled for the candidates doesn't lie on disk beside their blocks and the ranking."""
    def shuffled():
        held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {held.apply(i).getName() for i in range(held.length())}

    before = shuffled()
    rows = cut(spark.range(20_000).selectExpr("id as theme_id", "id % 7 as mal_id", "id % 900 as audio_id").groupBy("theme_id", "mal_id", "audio_id").count())
    rows = rows.selectExpr("*", "array(mal_id) as artist_ids", "array('a') as genres", "2000 as start_year", "array(1D, 0D) as u").repartition(3)
    pairs._store(rows.withColumn("_block", rows["theme_id"] % 2), "_block")
    assert not {x for x in shuffled() - before if x.startswith("shuffle_")}
