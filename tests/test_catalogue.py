import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonoquarry import schemas
from sonoquarry.config import Config
from sonoquarry.errors import DataError, NothingToDo, StaleEmbeddings
from sonoquarry.functions import scores
from sonoquarry.operators import artists, audio, catalogue
from sonoquarry.plans import pipeline
from sonoquarry.sources import files, rest, store
from sonoquarry.streaming import incremental

from .conftest import rows

CFG = Config()


def emb(spark, *ids, model=CFG.embed_model, version=CFG.embed_version):
    return spark.createDataFrame([(i, i + 100, [1.0, 2.0], model, version, 3, 90.0) for i in ids], schemas.EMBEDDINGS)


def test_config_env():
    assert Config().embed_version == "sr24000-c30x3s30-L6"
    c = Config.from_env({"EMBED_LAYER": "-1", "KEEP_AUDIO": "Off", "W_ERA": "0.2"})
    assert c.embed_version == "sr24000-c30x3s30" and c.keep_audio is False and c.w_era == 0.2
    with pytest.raises(ValueError):
        Config.from_env({"TARGET_SR": ""})


def test_store(spark, tmp_path):
    p = str(tmp_path / "e")
    assert store.read_embeddings(spark, p).count() == 0
    store.guard(spark, p, CFG.embed_model, CFG.embed_version)
    assert store.append(emb(spark), p) == 0 and not os.path.exists(p)
    assert store.append(emb(spark, 1, 2), p) == 2 and store.append(emb(spark, 3), p) == 1
    legacy = str(tmp_path / "old.parquet")
    emb(spark, 9).drop("n_chunks_used").write.parquet(legacy)
    assert rows(store.read_embeddings(spark, p, legacy), "theme_id") == [(1,), (2,), (3,), (9,)]
    assert len(store.shards(spark, p)) >= 2 and store.shards(spark, p) == sorted(store.shards(spark, p)) and store.shards(spark, str(tmp_path / "none")) == []
    store.guard(spark, p, CFG.embed_model, CFG.embed_version)
    store.append(emb(spark, 4, version="sr16000-c10x1s10"), p)
    with pytest.raises(StaleEmbeddings, match="sr16000"):
        store.guard(spark, p, CFG.embed_model, CFG.embed_version)
    store.guard(spark, p, CFG.embed_model, CFG.embed_version, force=True)
    assert store.read_embeddings(spark, p).count() == 0
    store.write_ids(emb(spark, 30, 4), "theme_id", str(tmp_path / "ids"))
    assert rows(store.read_ids(spark, str(tmp_path / "ids"))) == [(30,), (4,)]


def test_variants(spark, tmp_path):
    for n in ("layer01", "layer02"):
        emb(spark, 1).write.parquet(str(tmp_path / f"{n}.parquet"))
    assert rows(store.read_variants(spark, str(tmp_path)), "variant", "theme_id") == [("layer01", 1), ("layer02", 1)]


def test_dataset_and_exclusions(spark):
    t = spark.createDataFrame([(1, 10, 101, "a"), (2, 10, 102, "b"), (3, 11, 103, "a"), (4, 99, 104, "c")], "theme_id long, mal_id long, audio_id long, audio_basename string")
    m = spark.createDataFrame([(10, "x"), (11, "y")], "mal_id long, title string")
    e = emb(spark, 1, 2, 3)
    lost = spark.createDataFrame([(102,)], "audio_id long")
    failed = spark.createDataFrame([(3,), (None,)], "theme_id long")
    out = catalogue.excluded_themes(t, lost, failed)
    assert rows(out) == [(2,), (3,)]
    assert rows(catalogue.build_dataset(t, m, e, out), "theme_id", "title") == [(1, "x")]
    assert rows(catalogue.join_loss(t, m, e)) == [(4, 1, 1, 3)]
    assert rows(catalogue.todo(t, e), "theme_id") == [(4,)]
    with pytest.raises(NothingToDo):
        catalogue.build_dataset(t, m, emb(spark))
    assert rows(catalogue.duplicate_basenames(t)) == [("a", 2)]
    with pytest.raises(DataError):
        catalogue.check_basenames(t)


def test_metadata_documents(spark, tmp_path):
    doc = {"mal_id": 1500, "title": "T", "aired": {"from": "2020"}, "genres": [{"mal_id": 1, "name": "Action"}, {"mal_id": None, "name": ""}, {"mal_id": 2, "name": None}], "studios": None}
    for key, text in ((1500, json.dumps(doc)), (7, "{}"), (8, "{broken")):
        path = files.cache_path(str(tmp_path), key)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)
    cached = files.read_cache(spark, str(tmp_path))
    out = catalogue.metadata_rows(cached)
    assert rows(out, "mal_id", "aired_from", "aired_to", "genres", "genre_ids", "studios") == [(1500, "2020", None, ["Action"], [1, 2], [])]
    keys = spark.createDataFrame([(1500,), (8,), (8,), (None,)], "mal_id long")
    assert rows(files.missing(keys, cached)) == [(8,)]
    ranked = spark.createDataFrame([(1, 3, 1), (2, 1, 2), (3, None, 3)], "mal_id long, popularity long, rank long")
    assert [r[0] for r in catalogue.top_ids(ranked, 2).collect()] == [2, 1]
    assert [r[0] for r in catalogue.top_ids(ranked, 1, "score").collect()] == [1]
    with pytest.raises(ValueError):
        catalogue.top_ids(ranked, 1, "fame")


def page(*ids, after=None):
    def video(i):
        return {"nc": True, "resolution": 720, "audio": {"id": i + 100, "link": f"l{i}", "basename": f"b{i}.ogg", "size": None, "path": "p"}}
    anime = [{"slug": f"s{i}", "resources": [{"site": catalogue.SITE, "external_id": i}], "animethemes": [{"id": i, "type": "OP", "sequence": None, "slug": "OP", "song": None, "animethemeentries": [{"videos": [video(i)]}]}]} for i in ids]
    return {"anime": anime, "links": {"next": after}}


def test_pages_and_limits():
    held = {"/anime": page(1, after="http://x/p2"), "http://x/p2": page(2)}
    got = list(rest.pages(lambda u, p: held[u], "/anime"))
    assert [a["slug"] for g in got for a in g["anime"]] == ["s1", "s2"]
    assert len(list(rest.pages(lambda u, p: held[u], "/anime", limit=1))) == 1
    calls, slept = [], []
    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("later")
        return 5
    assert rest.retrying(flaky, sleep=slept.append)() == 5 and slept == [1.0, 2.0]
    now = [0.0]
    limit = rest.RateLimit(2.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(3):
        limit.wait()
    assert now[0] == pytest.approx(1.0)


def test_lookup_reports_what_is_missing(spark):
    def fetch():
        return lambda k: {"id": k} if k != 2 else None
    keys = spark.createDataFrame([(1,), (2,), (2,), (None,)], "mal_id long")
    got = rest.lookup(keys, "mal_id", fetch)
    assert rows(got) == [(1, '{"id": 1}'), (2, None)] and rows(rest.not_found(keys, got, "mal_id")) == [(2,)]


def test_matches_by_site(spark):
    held = {"5": [{"slug": "a"}, {"slug": "b"}], "6": []}
    def fetch():
        return rest.site_matches(lambda url, p: {"anime": held.get(p["filter[external_id]"])}, catalogue.SITE)
    keys = spark.createDataFrame([(5,), (6,), (7,), (5,)], "mal_id long")
    found = rest.matches(keys, "mal_id", fetch)
    assert rows(rest.first_matches(found)) == [(5, '{"slug": "a"}')] and rows(rest.ambiguous(found, "mal_id")) == [(5, 2)] and rows(rest.not_found(keys, found, "mal_id")) == [(6,), (7,)]


def test_site_source_is_read_by_pushed_keys(spark, tmp_path):
    (tmp_path / "5.json").write_text(json.dumps({"anime": [{"slug": "a"}, {"slug": "b"}]}))
    rest.register(spark)
    d = spark.read.format("site_catalogue").options(site=catalogue.SITE, folder=str(tmp_path), parallel="2").load()
    assert rows(d.filter("external_id in (5, 6)")) == [(5, 0, '{"slug": "a"}'), (5, 1, '{"slug": "b"}')] and rows(d.filter("external_id = 6")) == []
    (tmp_path / "7.json").write_text(json.dumps({"anime": [{"slug": "c"}]}))
    assert rows(d.filter("external_id = 7"), "payload") == [('{"slug": "c"}',)]
    with pytest.raises(Exception, match="by key"):
        spark.read.format("site_catalogue").options(site=catalogue.SITE, folder=str(tmp_path)).load().collect()


def test_ranked_ids():
    pages = {1: {"data": [{"mal_id": 3}, {"mal_id": None}, {"mal_id": 3}], "pagination": {"has_next_page": True}}, 2: {"data": [{"mal_id": 8}], "pagination": {"has_next_page": False}}}
    asked = []
    def fetch(url, p):
        asked.append(p)
        return pages[p["page"]]
    assert rest.ranked_ids(fetch, 2) == [3, 3] and asked == [{"limit": 25, "page": 1, "filter": "bypopularity"}]
    assert rest.ranked_ids(fetch, 9, "score") == [3, 3, 8] and "filter" not in asked[-1]
    with pytest.raises(ValueError):
        rest.ranked_ids(fetch, 1, "fame")


def test_artist_service(spark):
    answers = {"A B": [{"id": "m1", "name": "Other"}, {"id": "m2", "name": "x", "aliases": [{"name": "a-b", "sort-name": None}]}], "C": None}
    def fetch():
        return rest.artist_candidates(lambda url, p: {"artists": answers[p["query"]]})
    q = spark.createDataFrame([("A B",), ("C",)], "query string")
    found = artists.candidate_rows(rest.matches(q, "query", fetch))
    assert rows(artists.resolve(q, found)) == [("A B", "m2", "x"), ("C", None, None)]


def test_cache_is_filled_with_what_it_lacks(spark, tmp_path):
    folder = str(tmp_path)
    calls = []
    def write(key, text):
        path = files.cache_path(folder, key)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)
    write(1, json.dumps({"mal_id": 1, "title": "one"}))
    write(2, "{")  # unreadable: fetched again
    write(3, "{}")  # known to be absent
    keys = spark.createDataFrame([(1,), (2,), (3,), (4000,), (5,), (5,), (None,)], "mal_id long")
    todo = files.missing(keys, files.read_cache(spark, folder))
    assert rows(todo) == [(2,), (4000,), (5,)]
    got = files.fill_cache(todo, folder, lambda: lambda k: {"mal_id": k, "title": f"t{k}"} if k != 5 else None)
    assert got.count() == 3 and os.path.exists(files.cache_path(folder, 4000)) and "/0004/" in files.cache_path(folder, 4000)
    assert rows(files.missing(keys, files.read_cache(spark, folder))) == [] and rows(catalogue.metadata_rows(files.read_cache(spark, folder)), "mal_id", "title") == [(1, "one"), (2, "t2"), (4000, "t4000")]


def test_pipeline_end_to_end(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "anime.json").write_text(json.dumps(page(1, 2, after="/p2")))
    (pages / "p2.json").write_text(json.dumps(page(3, 1)))
    root = str(tmp_path / "data")
    paths = pipeline.Paths(root, str(pages))
    for i in (1, 2, 3):
        path = files.cache_path(paths.cache, i)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            json.dump({"mal_id": i, "title": f"T{i}", "popularity": i}, f)
    os.makedirs(paths.files)

    def fetch(link, to):
        if link == "l3":
            raise OSError("gone")
        with open(to, "w") as f:
            f.write(link)

    def embedder():
        def run(path):
            with open(path) as f:
                if f.read() == "l2":
                    raise RuntimeError("x" * 900)
            return [1.0, 2.0]
        return run

    services = pipeline.Services(fetch_file=fetch, embedder=embedder)
    def stage(name, **kw):
        return pipeline.run_stage(spark, name, paths, CFG, services, **kw)
    assert stage("themes") == 3 and stage("mal") == 3
    assert stage("audio") == 2 and stage("audio") == 0  # complete files are skipped
    assert rows(files.listed(spark, paths.files), "audio_basename") == [("b1.ogg",), ("b2.ogg",)]
    assert stage("embed") == 1 and rows(files.listed(spark, paths.files), "audio_basename") == [("b2.ogg",)]
    errors = store.read_table(spark, paths.embed_errors, schemas.EMBED_ERRORS)
    assert {r.theme_id for r in errors.collect()} == {2, 3} and max(len(r.error_message) for r in errors.collect()) == 500
    assert stage("join") == 1 and rows(spark.read.parquet(paths.dataset), "theme_id", "title") == [(1, "T1")]
    assert stage("themes", top_n=2) == 2 and stage("themes", limit_pages=1) == 2
    # with services: the ranking's anime by site id, metadata that the cache lacks, all stages in a row
    ranking = lambda url, p: {"data": [{"mal_id": 2}, {"mal_id": 1}, {"mal_id": 77}], "pagination": {}}
    by_site = lambda: lambda k: page(k)["anime"] * 2 if k != 77 else []
    def metadata():
        return lambda k: {"mal_id": k, "title": f"N{k}"}
    paths = pipeline.Paths(str(tmp_path / "other"))
    os.makedirs(paths.files)
    full = pipeline.Services(fetch_file=fetch, embedder=lambda: lambda path: audio.Pooled([1.0, float(len(path))], 2, 55.5), ranking=ranking, by_site=by_site, metadata=metadata)
    assert pipeline.run_stage(spark, "all", paths, CFG, full, top_n=3) == 2
    assert rows(spark.read.parquet(paths.dataset), "theme_id", "title", "n_chunks_used", "total_seconds_used") == [(1, "N1", 2, 55.5), (2, "N2", 2, 55.5)]
    assert os.listdir(paths.files) == []  # recordings aren't kept unless asked for
    with pytest.raises(ValueError):
        stage("themes", top_n=1, limit_pages=1)
    with pytest.raises(ValueError):
        stage("mastering")


def test_stream_skips_what_is_done(spark, tmp_path):
    kind = "theme_id long, audio_id long, content string"
    incoming, folder = str(tmp_path / "in"), str(tmp_path / "e")
    def go():
        incremental.embed_stream(spark, incoming, kind, folder, str(tmp_path / "cp"), lambda: lambda c: [float(len(c))], CFG.embed_model, CFG.embed_version).awaitTermination()
    spark.createDataFrame([(1, 101, "ab"), (2, 102, "c")], kind).write.mode("append").parquet(incoming)
    go()
    spark.createDataFrame([(2, 102, "zzz"), (3, 103, "d")], kind).write.mode("append").parquet(incoming)
    go()
    assert rows(store.read_embeddings(spark, folder), "theme_id", "embedding") == [(1, [2.0]), (2, [1.0]), (3, [1.0])]


def test_chunks_lengths_and_pooling(spark):
    df = spark.createDataFrame([(1, [float(x) for x in range(7)]), (2, [1.0]), (3, [])], "i long, s array<double>")
    got = {r.i: [(c.chunk_no, c.real_len, c.chunk) for c in r.c] for r in df.select("i", audio.split_chunks(F.col("s"), 3, 3, 2).alias("c")).collect()}
    assert got == {1: [(0, 3, [0, 1, 2]), (1, 3, [2, 3, 4]), (2, 3, [4, 5, 6])], 2: [(0, 1, [1, 0, 0])], 3: []}
    lengths = spark.createDataFrame([(100,), (1,), (10_000,)], "n long").select("n", audio.feature_length(F.col("n"), [(10, 5), (3, 2)], F.lit(50)).alias("f"))
    assert {r.n: r.f for r in lengths.collect()} == {100: 9, 1: 1, 10_000: 50}
    means = audio.mean_vectors(spark.createDataFrame([(1, [1.0, 3.0]), (1, [3.0, 5.0])], "g long, v array<double>"), "g", "v")
    assert rows(means) == [(1, [2.0, 4.0])]
    assert audio.pooled_stats(np.array([[1.0, 3.0], [2.0, 2.0]])).tolist() == [2, 2, 1, 0]


def test_artist_tables(spark):
    themes = spark.createDataFrame([(1, ["A", "B", None]), (2, ["A"]), (3, None)], "theme_id long, artist_names array<string>")
    assert rows(artists.frequency(themes)) == [("A", 2), ("B", 1)]
    assert rows(artists.coverage(themes, spark.createDataFrame([("B",)], "name string"))) == [(3, pytest.approx(1 / 3))]
    q = spark.createDataFrame([("Tokyo-Go",), ("漢字",), ("nobody",)], "query string")
    alias = "array<struct<name:string,sort_name:string>>"
    c = spark.createDataFrame([("Tokyo-Go", 1, "m1", "Kyoto", [("x", "TOKYO GO")]), ("Tokyo-Go", 0, "m0", "Other", None), ("Tokyo-Go", 2, "m2", "tokyo go", None), ("漢字", 0, "m9", "文字", None)], f"query string, pos int, mbid string, mb_name string, aliases {alias}")
    assert rows(artists.resolve(q, c)) == [("Tokyo-Go", "m1", "Kyoto"), ("nobody", None, None), ("漢字", None, None)]
    lists = spark.createDataFrame([("a", [("x", "", 1.0), (None, "", 9.0), ("y", "", None), ("z", "", 1.0)])], "mbid string, similar array<struct<mbid:string,name:string,score:double>>")
    assert rows(artists.neighbours(lists)) == [("a", "x"), ("a", "z")]
    sizes = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("c", "1"), ("c", "2"), ("c", "3")], "mbid string, near string")
    assert rows(artists.list_sizes(sizes)) == [(3, 2, 3)]
    text = spark.createDataFrame([(json.dumps({"A": {"mbid": "m"}, "B": None}), json.dumps({"m": [{"mbid": "n", "score": 1}], "k": None}))], "a string, s string")
    assert rows(artists.artist_map(text, "a")) == [("A", "m")] and rows(artists.similar_map(text, "s"), "mbid") == [("m",)]
    payload = spark.createDataFrame([(json.dumps([{"artist_mbid": "p"}, {"name": "q"}]),), (json.dumps({"data": [{"artist_mbid": "w"}]}),), (json.dumps({"similar_artists": [{"artist_mbid": "v"}], "data": []}),)], "payload string")
    assert [[x.mbid for x in r.similar] for r in artists.similar_payload(payload).collect()] == [["p"], ["w"], ["v"]]


def test_masked_pooling(spark):
    rng = np.random.default_rng(0)
    hidden, real = rng.normal(size=(3, 2, 9, 4)), np.array([100, 31])
    layers = [(10, 5), (3, 2)]
    made = audio.pool_layers(hidden, real, layers)
    n = [9, 2]
    assert made.shape == (3, 4) and np.allclose(made, np.stack([hidden[:, c, :n[c]].mean(axis=1) for c in (0, 1)]).mean(axis=0))
    df = spark.createDataFrame([([(100, hidden[1, 0].tolist()), (31, hidden[1, 1].tolist())],), ([],)], "c array<struct<real_len:int,frames:array<array<double>>>>")
    got = [r.v for r in df.select(audio.pool_chunks(F.col("c"), layers).alias("v")).collect()]
    assert np.allclose(got[0], made[1]) and got[1] is None
    assert audio.check_sample_rate(24000, None) == audio.check_sample_rate(24000, 24000) == 24000
    with pytest.raises(DataError):
        audio.check_sample_rate(24000, 16000)


def test_hash_half(spark):
    import hashlib

    df = spark.range(50).select("id", scores.half(F.col("id")).alias("h"))
    assert all(r.h == int(hashlib.md5(str(r.id).encode()).hexdigest(), 16) % 2 for r in df.collect())


def test_embed_keeps_going(spark):
    df = spark.createDataFrame([(1, 1, "a"), (2, 2, "bad")], "theme_id long, audio_id long, content string")
    def embedder():
        return lambda c: 1 / 0 if c == "bad" else [1.0]
    assert rows(audio.embed(df, embedder, "m", "v"), "theme_id", "embedding", "error_class") == [(1, [1.0], None), (2, None, "ZeroDivisionError")]
