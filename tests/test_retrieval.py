import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoquarry.config import Config
from sonoquarry.errors import DegenerateVectors, NothingToDo, StaleEmbeddings
from sonoquarry.functions import scores, vectors
from sonoquarry.operators import evaluate, pairs, recommend, whitening

from .conftest import rows

CFG = dataclasses.replace(Config(), whiten_components=0)
SCHEMA = (
    "theme_id long, mal_id long, audio_id long, title string, theme_type string, theme_sequence int, song_title string, artist_ids array<bigint>, artist_names array<string>, "
    "start_year int, score double, genres array<string>, embedding array<float>, embed_model string, embed_version string"
)


def corpus(spark, vecs, mal=None, audio=None, artists=None, years=None, genres=None):
    n = len(vecs)
    data = []
    for i in range(n):
        a = artists[i] if artists else []
        data.append((
            i + 1, mal[i] if mal else i + 1, audio[i] if audio else 101 + i, f"Anime {i}", "OP", 1, f"Song {i}", a, [f"artist{x}" for x in a or []],
            years[i] if years else 2010, 7.5, genres[i] if genres else ["Action"], [float(x) for x in vecs[i]], CFG.embed_model, CFG.embed_version,
        ))
    return spark.createDataFrame(data, SCHEMA)


def line(n, gap, dims=8):
    """Vectors ever further from the first."""
    v = np.zeros((n, dims))
    v[:, 0] = 1 - gap * np.arange(n)
    v[:, 1] = np.sqrt(np.maximum(1e-6, 1 - v[:, 0] ** 2))
    v[0] = np.eye(dims)[0]
    return v


def ids(df, seed=1, **kw):
    d = recommend.prepare(df)
    got = recommend.recommend(d, CFG, seeds=d.filter(F.col("theme_id") == seed), **kw)
    return [r.theme_id for r in got.orderBy("rank").collect()]


@pytest.mark.parametrize("gap", [0.1, 0.005])
def test_order_and_self_exclusion(spark, gap):
    assert ids(corpus(spark, line(6, gap)), mode="purist") == [2, 3, 4, 5, 6]


def test_siblings_dedup_and_caps(spark):
    assert set(ids(corpus(spark, line(6, 0.1), mal=[1, 1, 1, 2, 2, 3]), mode="purist", exclude_same_anime=True)) == {4, 5, 6}
    shared = corpus(spark, line(4, 0.1), audio=[101, 202, 202, 404])
    assert ids(shared, mode="purist") == [2, 4] and ids(shared, mode="purist", dedup_audio=False) == [2, 3, 4]
    pile = corpus(spark, line(9, 0.05), mal=[99, 7, 7, 7, 7, 7, 7, 8, 9])
    assert ids(pile, mode="purist", max_per_anime=2) == [2, 3, 8, 9] and len(ids(pile, mode="purist", max_per_anime=None)) == 8


def test_seed_recording_may_return_under_another_theme(spark):
    assert ids(corpus(spark, line(3, 0.1), audio=[1, 1, 2]), mode="purist") == [2, 3]


def test_ties_go_to_the_smaller_id(spark):
    same = np.tile(np.eye(4)[0], (5, 1))
    assert ids(corpus(spark, same), seed=3, mode="purist", k=3) == [1, 2, 4]


def test_comfort_lifts_siblings(spark):
    c = corpus(spark, line(6, 0.05), mal=[1, 2, 3, 4, 5, 1], artists=[[5], [], [], [], [], [5, None]])
    assert ids(c, mode="comfort").index(6) < ids(c, mode="purist").index(6)


def test_smoke(spark):
    c = recommend.prepare(corpus(spark, line(6, 0.05), mal=[1, 2, 3, 4, 5, 1], artists=[[5], [], [], [], [], [5]]))
    assert set(recommend.smoke(c, CFG).values()) == {True}


def test_variants(spark):
    from sonoquarry.errors import DataError
    from sonoquarry.operators import variants

    layers = variants.explode_layers(spark.createDataFrame([(1, [[1.0], [2.0]]), (2, [[3.0], None])], "theme_id long, layers array<array<float>>"))
    assert rows(layers) == [(1, "layer00", [1.0]), (1, "layer01", [2.0]), (2, "layer00", [3.0])]
    assert rows(variants.complete_ids(layers)) == [(1,)]
    got = variants.replace_vectors(corpus(spark, line(2, 0.1)), layers, "m", "v")
    assert rows(got, "theme_id", "variant", "embedding", "embed_version") == [(1, "layer00", [1.0], "v-layer00"), (1, "layer01", [2.0], "v-layer01")]
    with pytest.raises(DataError):
        variants.complete_ids(layers.limit(0))


def test_unknown_mode_and_guards(spark):
    c = corpus(spark, line(3, 0.1))
    with pytest.raises(ValueError):
        ids(c, mode="party")
    with pytest.raises(NothingToDo):
        recommend.check(c.limit(0), CFG)
    with pytest.raises(StaleEmbeddings):
        recommend.check(c.withColumn("embed_version", F.lit("old")), CFG)
    with pytest.raises(DegenerateVectors, match="zero norm"):
        recommend.check(corpus(spark, np.vstack([line(3, 0.1), np.zeros(8)])), CFG)
    with pytest.raises(DegenerateVectors, match="ragged"):
        recommend.check(c.withColumn("embedding", F.when(F.col("theme_id") == 1, F.array(F.lit(1.0).cast("float"))).otherwise(F.col("embedding"))), CFG)


def test_weights_stay_between_0_and_1(spark):
    c = corpus(spark, line(8, 0.05), artists=[[1], None, [1, 2], [], [None], [2], [1], [3]], years=[2000, None, 2001, 2010, None, 2002, 1990, 2000],
               genres=[["a", "b"], None, ["a"], [], [None], ["b", "b"], ["c"], ["a", "b"]])
    d = recommend.prepare(c)
    w = [r.l2_weight for r in recommend.recommend(d, CFG).collect()]
    assert len(w) == 56 and min(w) >= 0 and max(w) <= 1


def test_blocks_give_the_same_as_one(spark, monkeypatch):
    rng = np.random.default_rng(1)
    n = 60
    c = recommend.prepare(corpus(spark, rng.normal(size=(n, 8)), mal=list(rng.integers(0, 9, n).tolist()), audio=rng.integers(0, 40, n).tolist(), artists=[[int(x)] for x in rng.integers(0, 7, n)])).cache()
    one = rows(recommend.recommend(c, CFG, max_per_anime=2, k=7)), rows(evaluate.seed_table(c, CFG))
    for size in (17, 31, 60):
        monkeypatch.setattr(pairs, "CANDIDATES", size)
        monkeypatch.setattr(pairs, "SEEDS", size - 4)
        many = rows(recommend.recommend(c, CFG, max_per_anime=2, k=7)), rows(evaluate.seed_table(c, CFG))
        assert one == many


@pytest.mark.parametrize("dims", [3, 64, 768, 3000])
def test_inner_products_do_not_depend_on_the_order_of_summation(dims):
    rng = np.random.default_rng(dims)
    u = rng.normal(size=(40, dims))
    u /= np.linalg.norm(u, axis=1)[:, None]
    upper, lower = pairs.halves(u)
    dot = upper @ upper.T + np.hstack([upper, lower]) @ np.hstack([lower, upper]).T
    assert np.abs(dot - u @ u.T).max() < 1e-12
    for _ in range(3):
        p = rng.permutation(dims)
        a, b = upper[:, p], lower[:, p]
        one = np.array([[a[i] @ a[j] + np.concatenate([a[i], b[i]]) @ np.concatenate([b[j], a[j]]) for j in range(40)] for i in range(40)])
        assert (one == dot).all()


@pytest.mark.parametrize("missing", [False, True])
def test_a_hot_recording_is_spread_over_cells(spark, monkeypatch, missing):
    rng = np.random.default_rng(4)
    n = 60
    audio = [(None if missing else 7) if i % 3 == 0 else 100 + int(rng.integers(0, 30)) for i in range(n)]
    c = recommend.prepare(corpus(spark, rng.normal(size=(n, 8)), mal=rng.integers(0, 6, n).tolist(), audio=audio, artists=[[int(x)] for x in rng.integers(0, 7, n)])).cache()
    near = [[f"m{int(x)}"] for x in rng.integers(0, 7, n)]
    m = spark.createDataFrame([(i + 1, [f"m{i % 7}"], [x for x in near[i] if x != f"m{i % 7}"]) for i in range(n)], "theme_id long, mbids array<string>, near_mbids array<string>")
    e = c.join(m, "theme_id").cache()

    def results():
        asked = [dict(k=7), dict(k=7, max_per_anime=1), dict(k=4, max_per_anime=2, exclude_same_anime=True), dict(k=7, dedup_audio=False, max_per_anime=2)]
        return [rows(recommend.recommend(c, CFG, **a), "seed", "rank", "theme_id") for a in asked], rows(evaluate.seed_table(e, CFG))

    one = results()
    monkeypatch.setattr(pairs, "CANDIDATES", 17)
    monkeypatch.setattr(pairs, "SEEDS", 13)
    monkeypatch.setattr(pairs, "HOT", 8, raising=False)
    many = results()
    assert one[0] == many[0] and len(one[1]) == len(many[1]) == n
    for a, b in zip(one[1], many[1]):
        assert a == pytest.approx(b)


@pytest.mark.parametrize("hot", [None, 7])
def test_no_cell_holds_all_of_a_hot_recording(spark, monkeypatch, hot):
    c = recommend.prepare(corpus(spark, line(60, 0.01), audio=[hot if i % 3 == 0 else 100 + i for i in range(60)]))
    monkeypatch.setattr(pairs, "CANDIDATES", 17)
    monkeypatch.setattr(pairs, "HOT", 8, raising=False)

    def size(asking, candidates):
        return candidates.assign(n=candidates["audio_id"].isna() | (candidates["audio_id"] == 7)).groupby("asks")["n"].sum().reset_index()[["n"]]

    cells = [r.n for r in pairs.grid(c, None, size, "n long").collect()]
    assert max(cells) <= 12 and sum(cells) % 20 == 0


def test_presented_columns(spark):
    c = corpus(spark, line(3, 0.1)).withColumn("artist_names", F.lit(None).cast("array<string>"))
    d = recommend.prepare(c)
    out = recommend.present(recommend.recommend(d, CFG), c)
    first = out.filter("seed = 1 and rank = 1").first()
    assert (first.theme_label, first.artist_names, first.year) == ("OP1", "", 2010)
    assert "Anime" in recommend.console(out).first().line


def test_vector_functions(spark):
    c = corpus(spark, line(5, 0.2)).select("theme_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    x = np.array([r.v for r in c.orderBy("theme_id").collect()])
    assert [r[0] for r in c.orderBy("theme_id").select(vectors.norm(F.col("v"))).collect()] == pytest.approx(np.linalg.norm(x, axis=1).tolist())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = vectors.mean_offdiagonal_cosine(c.withColumn("u", vectors.unit(F.col("v"), vectors.norm(F.col("v")))), "u").first()
    assert got.mean_cosine == pytest.approx(((u @ u.T).sum() - 5) / 20)
    assert vectors.mean_offdiagonal_cosine(c.limit(1), "v").first().mean_cosine is None


def anisotropic(n=40, d=16, seed=0):
    return 1 + np.random.default_rng(seed).normal(0, 0.05, (n, d))


def whiten(spark, x, k):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "theme_id long, e array<double>")
    w = whitening.fit(df, "e", k)
    out = whitening.apply(df, "e", w).orderBy("theme_id").collect()
    return w, np.array([r.whitened for r in out])


def off(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    n = len(u)
    return ((u @ u.T).sum() - n) / (n * (n - 1))


def test_whitening_matches_svd(spark):
    x = anisotropic()
    w, y = whiten(spark, x, 8)
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    expected = c @ vt[:8].T / (s[:8] / np.sqrt(len(x)) + 1e-5)
    def cos(m):
        u = m / np.linalg.norm(m, axis=1, keepdims=True)
        return u @ u.T
    assert np.abs(cos(y) - cos(expected)).max() < 1e-8
    assert w.variance_kept == pytest.approx((s[:8] ** 2).sum() / (s ** 2).sum())
    assert off(x) > 0.9 and abs(off(y)) < 0.1


def test_whitening_clamp_off_and_collapse(spark):
    w, y = whiten(spark, anisotropic(10, 6), 10_000)
    assert w.components == 6 and y.shape == (10, 6)
    w, y = whiten(spark, anisotropic(5, 4), 0)
    assert not w.enabled and y.shape == (5, 4)
    with pytest.raises(DegenerateVectors, match="collapsed"):
        whiten(spark, np.ones((6, 8)), 4)


def test_near_duplicates_survive_whitening(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 12))
    x[1] = x[0] + rng.normal(0, 0.001, 12)
    _, y = whiten(spark, x, 8)
    u = y / np.linalg.norm(y, axis=1, keepdims=True)
    g = u @ u.T - 2 * np.eye(20)
    assert g[0].argmax() == 1 and g[1].argmax() == 0


def partners(spark, gap):
    v = np.zeros((8, 4))
    v[:, 0] = [1, 1 - gap, *(0.7 - 0.02 * np.arange(6))]
    v[:, 1] = np.sqrt(1 - v[:, 0] ** 2)
    return recommend.prepare(corpus(spark, v, artists=[[10], [10], *[[20 + i] for i in range(6)]]))


@pytest.mark.parametrize("gap, rank", [(0.02, 1), (0.9, 7)])
def test_known_ranks(spark, gap, rank):
    t = evaluate.seed_table(partners(spark, gap), CFG, control_k=3)
    got = rows(evaluate.family_scores(t, "artist"))
    assert got[0] == (1, rank, 7, 1)
    m = {r.name: r for r in evaluate.metrics(evaluate.per_seed(t)).collect()}
    assert m["artist_recall@1"].baseline == pytest.approx(1 / 7)
    if rank == 1:
        assert m["artist_mrr"].value == 1 and got == [(1, 1, 7, 1), (2, 1, 7, 1)]
    with pytest.raises(ValueError):
        evaluate.family_scores(t, "critics")


def test_small_pools_are_left_out(spark):
    assert evaluate.seed_table(partners(spark, 0.1), CFG, control_k=8).count() == 0


def test_related_excludes_own_artists(spark):
    c = partners(spark, 0.1)
    mbids = spark.createDataFrame([("artist10", "m10"), ("artist20", "m20"), ("artist21", "m21")], "name string, mbid string")
    near = spark.createDataFrame([("m10", "m21"), ("m10", "m10"), ("m20", "m10")], "mbid string, near string")
    t = evaluate.seed_table(evaluate.with_mbids(c, mbids, near), CFG, control_k=3)
    got = {r.seed: r.n_rel for r in evaluate.family_scores(t, "behavioural").collect()}
    assert got == {1: 1, 2: 1, 3: 2}


def test_paired(spark):
    a = spark.createDataFrame([(1, 2), (2, 4), (3, 1)], "seed long, rank long")
    b = spark.createDataFrame([(1, 1), (2, 8), (9, 1)], "seed long, rank long")
    d = evaluate.paired(a, b)
    s = evaluate.paired_summary(d).first()
    assert (s.delta, s.better, s.worse, s.n_seeds) == (pytest.approx((0.5 - 0.125) / 2), 1, 1, 2)
    low, high = evaluate.resampled(np.array([0.5, -0.125]))
    got = evaluate.paired_interval(d).first()
    assert (got.ci_low, got.ci_high) == (low, high)
    with pytest.raises(ValueError):
        evaluate.paired(a, b.filter("seed = 9"))
    assert evaluate.paired(a, b.limit(0)).isEmpty()


def test_intervals_in_pieces_equal_one_draw():
    v = np.random.default_rng(4).random(5000)
    idx = np.random.default_rng(0).integers(0, 5000, size=(1000, 5000))
    assert evaluate.resampled(v) == tuple(np.percentile(v[idx].mean(axis=1), [2.5, 97.5]))


def test_large_intervals_agree(spark):
    v = np.random.default_rng(5).random(400)
    df = spark.createDataFrame([("m", i, float(x)) for i, x in enumerate(v)], "name string, seed long, value double")
    exact, approx = evaluate.intervals(df).first(), evaluate.intervals_large(df).first()
    assert exact.ci_low == pytest.approx(approx.ci_low, abs=0.01) and exact.ci_high == pytest.approx(approx.ci_high, abs=0.01)


def test_sweep_selects_on_the_tuning_half(spark):
    ranks = spark.createDataFrame([(v, s, r) for s in range(40) for v, r in (("a", 4), ("b", 2), ("c", 2))], "variant string, seed long, rank long")
    groups = spark.createDataFrame([(s, s) for s in range(40)], "seed long, mal_id long")
    got = {r.variant: r for r in evaluate.sweep(ranks, groups, "a").collect()}
    assert got["b"].selected and not got["c"].selected and got["a"].is_reference and got["b"].tune_mrr == 0.5
    with pytest.raises(ValueError):
        evaluate.sweep(ranks.limit(0), groups, "a")
    assert "different winners" in evaluate.agreement({"artist": "a", "behavioural": "b"})


def test_fingerprint(spark):
    import hashlib

    df = spark.createDataFrame([(i,) for i in (30, 2, 100)], "theme_id long")
    assert evaluate.fingerprint(df).first()[0] == hashlib.sha256(b"2,30,100").hexdigest()[:16]


def test_labels(spark):
    df = spark.createDataFrame([(None, None), ("ED", 3)], "k string, s int")
    assert [r[0] for r in df.select(scores.theme_label(F.col("k"), F.col("s"))).collect()] == ["None", "ED3"]
