"""Registered queries of the retrieval, evaluation and catalogue operators, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..config import Config
from ..functions import scores, vectors
from ..operators import artists, audio, catalogue, evaluate, nested, recommend, variants, whitening
from ..session import checkpoint_dir, cut, spread, table
from ..sources import files, store
from .core_queries import _P1, _listed

CFG = Config()
DIMS = 64
#: Added before rounding means of few values, so that exact halves round alike in every engine.
_NUDGE = 1e-9


# --- the model's tables from the data folder ------------------------------------------------------------


def themes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "animethemes").filter("theme_id is not null and mal_id is not null and audio_id is not null")
    return catalogue.keep_first(rows, "theme_id", "ingest_pos")


def metadata(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "mal").filter("mal_id is not null").select("ingest_pos", "mal_id", "title", "start_year", "score", "genres")
    return catalogue.keep_first(rows, "mal_id", "ingest_pos").drop("ingest_pos")


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "theme_vectors").filter((F.col("embed_version") == CFG.embed_version) & F.col("theme_id").isNotNull() & vectors.usable(F.col("embedding"), DIMS))
    return catalogue.keep_first(rows, "theme_id", "ingest_pos").select("theme_id", "audio_id", "embedding", "embed_model", "embed_version", "n_chunks_used", "total_seconds_used")


def dataset(spark: SparkSession, sf: str) -> DataFrame:
    return catalogue.build_dataset(themes(spark, sf).drop("ingest_pos", "ingested_at", "deleted_at"), metadata(spark, sf), embeddings(spark, sf))


def _whole(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors (as they are stored: unit vectors take twice the room) and metadata, written once: several passes read it."""
    return cut(dataset(spark, sf).select("theme_id", "mal_id", "audio_id", "artist_ids", "artist_names", "genres", "start_year", "embedding"))


def prepared(spark: SparkSession, sf: str) -> DataFrame:
    """Unit vectors and metadata."""
    return recommend.prepare(_whole(spark, sf)).drop("embedding")


def _six(name: str, alias: str | None = None):
    return F.round(F.col(name), 6).alias(alias or name)


# --- vectors ---------------------------------------------------------------------------------------------


def vec_norm(spark, sf):
    e = spread(embeddings(spark, sf).select("theme_id", "embedding"))
    return e.select("theme_id", F.round(vectors.norm(F.transform("embedding", lambda x: x.cast("double"))), 6).alias("norm"))


def guard_zero_norm(spark, sf):
    """Themes whose vector can't be used (missing, incomplete, not finite or zero)."""
    rows = spread(table(spark, sf, "theme_vectors").select("ingest_pos", "theme_id", "embedding"))
    return rows.filter(~vectors.usable(F.col("embedding"), DIMS)).select("ingest_pos", "theme_id")


def vec_mean(spark, sf):
    return vectors.element_means(embeddings(spark, sf), "embedding").select("pos", _six("mean"))


def mean_offdiag_cosine(spark, sf):
    return vectors.mean_offdiagonal_cosine(prepared(spark, sf), "u").select("n", _six("mean_cosine"))


def cosine_consecutive(spark, sf):
    """Cosine of each theme to the one before it within its anime."""
    u = prepared(spark, sf).select("theme_id", "mal_id", "u")
    w = Window.partitionBy("mal_id").orderBy("theme_id")
    p = u.select("theme_id", F.lag("theme_id").over(w).alias("before"), "u", F.lag("u").over(w).alias("v")).filter("before is not null")
    return p.select("theme_id", "before", F.round(vectors.dot(F.col("u"), F.col("v")), 6).alias("cosine"))


def metadata_weight(spark, sf):
    """The four signals and the weight of each theme against the one before it within its year."""
    d = dataset(spark, sf).select("theme_id", "mal_id", "artist_ids", "genres", "start_year")
    w = Window.partitionBy("start_year").orderBy("theme_id")
    names = ("theme_id", "mal_id", "artist_ids", "genres", "start_year")
    p = d.select("*", *[F.lag(c).over(w).alias(f"b_{c}") for c in names]).filter("b_theme_id is not null")
    p = p.select(
        "theme_id", F.col("b_theme_id").alias("before"), scores.same(F.col("mal_id"), F.col("b_mal_id")).alias("same_anime"), scores.overlap(F.col("artist_ids"), F.col("b_artist_ids")).alias("same_artist"),
        scores.era_match(F.col("start_year"), F.col("b_start_year"), CFG.era_window_years).alias("era"), scores.jaccard(F.col("genres"), F.col("b_genres")).alias("jaccard"),
    )
    weight = scores.metadata_weight(F.col("same_anime"), F.col("same_artist"), F.col("era"), F.col("jaccard"), CFG)
    return p.select("theme_id", "before", "same_anime", "same_artist", "era", _six("jaccard"), F.round(weight, 6).alias("weight"))


def gram(spark, sf):
    """Gram matrix of the centred vectors."""
    e = embeddings(spark, sf).select("embedding")
    means = [r["mean"] for r in vectors.element_means(e, "embedding").orderBy("pos").collect()]
    import numpy as np

    g = whitening.gram(spread(e), "embedding", np.array(means))
    rows = [(i, j, float(g[i, j])) for i in range(len(g)) for j in range(len(g))]
    return spark.createDataFrame(rows, "i int, j int, x double").select("i", "j", F.round("x", 4).alias("x"))


def whiten_gram(spark, sf):
    """Covariance of the vectors whitened to all components: the identity."""
    import numpy as np

    e = spread(embeddings(spark, sf).select("theme_id", "embedding"))
    w = whitening.apply(e, "embedding", whitening.fit(e, "embedding", DIMS))
    n, mean = whitening.moments(w, "whitened")
    g = np.round(whitening.gram(w, "whitened", mean) / n, 3) + 0.0
    return spark.createDataFrame([(i, j, float(g[i, j])) for i in range(DIMS) for j in range(DIMS)], "i int, j int, x double")


def whiten_variance(spark, sf):
    """Components and share of the variance kept when none is left out."""
    fitted = whitening.fit(spread(embeddings(spark, sf).select("embedding")), "embedding", 10 * DIMS)
    return spark.createDataFrame([(fitted.components, round(fitted.variance_kept, 6))], "components int, variance_kept double")


def whiten_project(spark, sf):
    """Squared length of each vector whitened to all components (without the stabiliser): its distance to the mean by the covariance."""
    e = spread(embeddings(spark, sf).select("theme_id", "embedding"))
    w = whitening.apply(e, "embedding", whitening.fit(e, "embedding", CFG.whiten_components, eps=0.0))
    return w.select("theme_id", F.size("whitened").alias("components"), F.round(F.pow(vectors.norm(F.col("whitened")), 2), 6).alias("length2"))


# --- recommendations -------------------------------------------------------------------------------------


def _recommend(found: DataFrame) -> DataFrame:
    return found.select("seed", "rank", "theme_id", _six("l1_cos"), _six("l2_weight"), _six("final"))


def _mode(mode: str, **kw):
    return lambda spark, sf: _recommend(recommend.recommend(prepared(spark, sf), CFG, mode=mode, **kw))


def recommend_one_seed(spark, sf):
    """The presented recommendations of the smallest theme_id."""
    d = cut(recommend.prepare(dataset(spark, sf)).select("theme_id", "mal_id", "audio_id", "artist_ids", "artist_names", "genres", "start_year", "title", "theme_type", "theme_sequence", "song_title", "score", "u"))
    found = recommend.recommend(d, CFG, seeds=d.orderBy("theme_id").limit(1), max_per_anime=CFG.max_per_anime)
    return recommend.present(found, d).select("seed", "rank", "theme_id", "mal_id", "audio_id", "title", "theme_label", "song_title", "artist_names", "year", "anime_score", _six("l1_cos"), _six("l2_weight"), _six("final"))


def recommend_whitened(spark, sf):
    d = _whole(spark, sf)
    w = whitening.apply(d, "embedding", whitening.fit(d, "embedding", CFG.whiten_components, CFG.whiten_alpha, 0.0), keep=False)
    return _recommend(recommend.recommend(recommend.prepare(w, "whitened").drop("whitened"), CFG))


# --- catalogue -------------------------------------------------------------------------------------------


def flatten_nested(spark, sf):
    anime = nested.typed_anime(spread(table(spark, sf, "anime_payloads").select("record_id", "payload")))
    rows = catalogue.theme_rows(anime, ("record_id", "anime_pos"))
    return catalogue.keep_first(rows, "theme_id", "record_id", "anime_pos", "theme_pos").drop("theme_pos")


def pick_audio(spark, sf):
    """The recording of every theme of every record."""
    anime = nested.typed_anime(spread(table(spark, sf, "anime_payloads").select("record_id", "payload")))
    t = anime.select("record_id", "anime_pos", F.posexplode("animethemes").alias("theme_pos", "t")).filter("t is not null")
    t = t.withColumn("b", catalogue.best_audio(F.col("t.animethemeentries"))).filter("b is not null")
    return t.select("record_id", "anime_pos", "theme_pos", F.col("b.audio.id").alias("audio_id"), F.col("b.nc").alias("nc"), F.col("b.resolution").alias("resolution"))


def dedup_keep_first(spark, sf):
    rows = table(spark, sf, "animethemes").filter("theme_id is not null").select("theme_id", "ingest_pos", "audio_id", "song_title")
    return catalogue.keep_first(rows, "theme_id", "ingest_pos")


def build_dataset(spark, sf):
    d = dataset(spark, sf)
    return d.select("theme_id", "mal_id", "audio_id", "title", "theme_type", "theme_sequence", "song_title", "artist_ids", "artist_names", "start_year", "score", "genres", "embed_model", "embed_version")


def _errors(spark, sf):
    lost = table(spark, sf, "animethemes").filter("audio_link is null and audio_id is not null").select("audio_id").distinct()
    failed = guard_zero_norm(spark, sf).filter("theme_id is not null").select("theme_id").distinct()
    return lost, failed


def exclude_errors(spark, sf):
    t = themes(spark, sf)
    out = catalogue.excluded_themes(t.select("theme_id", "audio_id"), *_errors(spark, sf))
    return t.join(out, "theme_id", "left_anti").select("theme_id", "audio_id")


def join_loss(spark, sf):
    return catalogue.join_loss(themes(spark, sf), metadata(spark, sf), embeddings(spark, sf))


def staleness_offenders(spark, sf):
    return catalogue.stale(table(spark, sf, "theme_vectors"), CFG.embed_model, CFG.embed_version)


def incremental_todo(spark, sf):
    return catalogue.todo(themes(spark, sf), embeddings(spark, sf)).select("theme_id", "audio_id")


def dup_basenames(spark, sf):
    """Names of several recordings, were files named by their anime only."""
    rows = table(spark, sf, "animethemes").select("audio_id", F.split("audio_basename", "-")[0].alias("audio_basename"))
    return catalogue.duplicate_basenames(rows)


def _shared_folder(spark, name: str) -> str:
    """A folder of this application's, deleted with it."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def shard_union(spark, sf):
    """Vectors appended to a store in shards, and a single older file without one of the columns, counted by version."""
    e = table(spark, sf, "theme_vectors").select("theme_id", "audio_id", "embedding", "embed_model", "embed_version", "n_chunks_used", "total_seconds_used")
    now, old = _shared_folder(spark, "store"), _shared_folder(spark, "legacy")
    for part in (F.col("theme_id") % 2 == 0, F.col("theme_id") % 2 != 0, F.col("theme_id").isNull()):
        store.append(e.filter((F.col("embed_version") == CFG.embed_version) & part), now)
    store.overwrite(e.filter(F.col("embed_version") != CFG.embed_version).drop("n_chunks_used"), old)
    return store.read_embeddings(spark, now, old).groupBy("embed_version").agg(F.count(F.lit(1)).alias("n"), F.count("n_chunks_used").alias("n_with_chunks"))


def download_targets(spark, sf):
    return files.download_targets(table(spark, sf, "animethemes"))


def metadata_flatten(spark, sf):
    """Metadata documents (as the service would give them) to rows."""
    def refs(names, ids=None):
        if ids is None:
            return F.transform(names, lambda x: F.struct(F.lit(None).cast("long").alias("mal_id"), x.alias("name")))
        held = F.coalesce(names, F.array().cast("array<string>")), F.coalesce(ids, F.array().cast("array<bigint>"))
        return F.zip_with(*held, lambda n, i: F.struct(i.alias("mal_id"), n.alias("name")))

    m = table(spark, sf, "mal").filter("mal_id is not null")
    doc = F.to_json(F.struct(
        "mal_id", "title", F.struct(F.col("aired_from").alias("from"), F.col("aired_to").alias("to")).alias("aired"), F.col("start_year").alias("year"), F.col("mal_rank").alias("rank"), "score",
        refs("genres", "genre_ids").alias("genres"), refs("studios", "studio_ids").alias("studios"), refs("themes").alias("themes"),
    ))
    rows = m.select("ingest_pos", F.from_json(doc, schemas.MAL_DOC).alias("d")).select("ingest_pos", "d.*")
    out = catalogue.metadata_rows(rows.withColumn("synopsis", F.col("ingest_pos").cast("string")))
    return out.select(F.col("synopsis").cast("long").alias("ingest_pos"), "mal_id", "title", "aired_from", "aired_to", "year", "rank", "score", "genres", "genre_ids", "studios", "studio_ids", "themes")


def embed_capture(spark, sf):
    """Themes embedded by a model that passes whole vectors through and fails on others."""
    def model():
        def run(v):
            if v is None or len(v) != DIMS or not all(x is not None and abs(x) < float("inf") for x in v):
                raise ValueError("not a whole vector")
            return audio.Pooled(v, len(v) // 8, len(v) / 2)
        return run

    rows = spread(table(spark, sf, "theme_vectors").select("ingest_pos", "embedding"))
    out = audio.embed(rows, model, CFG.embed_model, CFG.embed_version, columns="ingest_pos long", source="embedding")
    return out.select("ingest_pos", "embed_version", F.size("embedding").alias("dims"), "n_chunks_used", "total_seconds_used", "error_class", "error_message")


def pool_frames(spark, sf):
    """Vectors as eight frames of eight values each, of which the first few are real."""
    e = embeddings(spark, sf).select("theme_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    frames = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("v", i * 8 + 1, F.lit(8)))
    p = e.select("theme_id", audio.masked_mean(frames, F.col("theme_id") % 8 + 1).alias("m"))
    return p.select("theme_id", F.round(F.element_at("m", 1), 6).alias("first"), F.round(F.aggregate("m", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def scan_prune(spark, sf):
    """Years of well-rated anime: filter and two columns reach the scan."""
    m = table(spark, sf, "mal").filter("score >= 7.5")
    return m.groupBy("start_year").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


def top_popular(spark, sf):
    return catalogue.top_ids(table(spark, sf, "mal"), 100, "popularity")


def fingerprint(spark, sf):
    return evaluate.fingerprint(dataset(spark, sf).select("theme_id"))


def hash_split(spark, sf):
    return metadata(spark, sf).select("mal_id", scores.half(F.col("mal_id")).alias("half"))


def split_chunks(spark, sf):
    """Vectors as if they were samples: three pieces of 30 values, 20 apart."""
    e = spread(embeddings(spark, sf).select("theme_id", F.transform("embedding", lambda x: x.cast("double")).alias("s")))
    c = e.select("theme_id", F.explode(audio.split_chunks(F.col("s"), 30, 3, 20)).alias("c"))
    return c.select("theme_id", "c.chunk_no", "c.real_len", F.round(F.aggregate("c.chunk", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def pool_mean(spark, sf):
    """Mean vector of each anime, as its length and first value."""
    d = dataset(spark, sf).select("mal_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    p = audio.mean_vectors(d, "mal_id", "v")
    return p.select("mal_id", F.size("pooled").alias("dims"), F.round(F.element_at("pooled", 1), 6).alias("first"), F.round(vectors.norm(F.col("pooled")), 6).alias("norm"))


def feature_lengths(spark, sf):
    """Frames of each recording's used seconds after two strided convolutions, at most 1500."""
    v = table(spark, sf, "theme_vectors").filter("total_seconds_used is not null")
    samples = F.round(F.col("total_seconds_used") * 100).cast("long")
    return v.select("ingest_pos", audio.feature_length(samples, [(10, 5), (3, 2)], F.lit(1500)).cast("long").alias("frames"))


# --- artists ---------------------------------------------------------------------------------------------


def artist_frequency(spark, sf):
    return artists.frequency(table(spark, sf, "animethemes"))


def normalize_name(spark, sf):
    return table(spark, sf, "mb_artists").select("mb_row", scores.normal_name(F.col("query")).alias("key"))


def artist_resolve(spark, sf):
    """Credited names against the looked-up artists, as candidates by name or alias."""
    names = table(spark, sf, "animethemes").select(F.explode("artist_names").alias("query")).filter("query is not null").distinct().withColumn("k", scores.normal_name(F.col("query"))).filter("k <> ''")
    mb = table(spark, sf, "mb_artists").filter("mbid is not null").select("mb_row", "mbid", "mb_name", F.col("query").alias("alias"))
    by = mb.withColumn("k", F.explode(F.array_distinct(F.array(scores.normal_name(F.col("mb_name")), scores.normal_name(F.col("alias"))))))
    c = names.join(by, "k").select("query", F.col("mb_row").alias("pos"), "mbid", "mb_name", F.array(F.struct(F.col("alias").alias("name"), F.lit(None).cast("string").alias("sort_name"))).alias("aliases"))
    return artists.resolve(names, c)


def _similar(spark, sf):
    """Each artist's list of similar ones: the next five rows of its country."""
    mb = table(spark, sf, "mb_artists").select("mb_row", "mbid", "mb_name", "score", "country")
    w = Window.partitionBy("country").orderBy("mb_row").rowsBetween(1, 5)
    lists = mb.withColumn("similar", F.collect_list(F.struct("mbid", F.col("mb_name").alias("name"), F.col("score").cast("double").alias("score"))).over(w)).filter("mbid is not null")
    return catalogue.keep_first(lists, "mbid", "mb_row").select("mbid", "similar")


def top3_neighbours(spark, sf):
    return artists.neighbours(_similar(spark, sf))


def neighbour_sizes(spark, sf):
    return artists.list_sizes(top3_neighbours(spark, sf))


def _resolved(spark, sf):
    return table(spark, sf, "mb_artists").filter("mbid is not null").select(F.col("query").alias("name"), "mbid")


def artist_coverage(spark, sf):
    return artists.coverage(table(spark, sf, "animethemes").filter("theme_id is not null"), _resolved(spark, sf)).select("n_themes", _six("share"))


def neighbours_in_corpus(spark, sf):
    return artists.in_corpus(top3_neighbours(spark, sf), table(spark, sf, "animethemes"), _resolved(spark, sf))


def artist_map(spark, sf):
    """Resolved artists by way of the JSON map that a run keeps them in."""
    mb = table(spark, sf, "mb_artists").filter("query is not null")
    entry = F.when(F.col("mbid").isNotNull(), F.struct("query", "mbid", "mb_name", "country", F.col("artist_type").alias("type"), "score"))
    path = _shared_folder(spark, "artists")
    one = mb.agg(F.map_from_entries(F.collect_list(F.struct("query", entry.alias("entry")))).alias("m"))  # one document, as the map's file is
    one.select(F.to_json("m").alias("value")).write.text(path)
    return artists.artist_map(store.read_map(spark, _shared_folder(spark, "none"), path))


def similar_payloads(spark, sf):
    """Similar artists as the service gives them (a plain list or a wrapped one), back to lists, then the nearest three."""
    lists = _similar(spark, sf)
    rows = F.transform("similar", lambda x: F.struct(x["mbid"].alias("artist_mbid"), x["name"].alias("name"), x["score"].alias("score")))
    wrapped = F.when(F.xxhash64("mbid") % 2 == 0, F.to_json(rows)).otherwise(F.to_json(F.struct(rows.alias("data"))))
    return artists.neighbours(artists.similar_payload(lists.select("mbid", wrapped.alias("payload"))))


# --- variants --------------------------------------------------------------------------------------------


def _layers(spark, sf):
    """Two variants of every vector: its halves."""
    e = embeddings(spark, sf).select("theme_id", F.array(F.slice("embedding", 1, DIMS // 2), F.slice("embedding", DIMS // 2 + 1, DIMS // 2)).alias("layers"))
    return variants.explode_layers(spread(e))


def variant_layers(spark, sf):
    """Variants written as files of a folder each, read back together."""
    folder = _shared_folder(spark, "variants")
    v = cut(_layers(spark, sf))
    for name in ("layer00", "layer01"):
        store.overwrite(v.filter(F.col("variant") == name).drop("variant"), f"{folder}/{name}.parquet")
    rows = store.read_variants(spark, folder).withColumn("n", vectors.norm(F.transform("embedding", lambda x: x.cast("double"))))
    return rows.groupBy("variant").agg(F.count(F.lit(1)).alias("n_themes"), F.round(F.avg("n"), 6).alias("mean_norm"))


def variant_complete(spark, sf):
    """Themes of which both halves of a vector are whole."""
    rows = table(spark, sf, "theme_vectors").filter("theme_id is not null").select("theme_id", F.array(F.slice("embedding", 1, DIMS // 2), F.slice("embedding", DIMS // 2 + 1, DIMS // 2)).alias("layers"))
    return variants.complete_ids(variants.explode_layers(rows).filter(vectors.usable(F.col("embedding"), DIMS // 2)))


def variant_dataset(spark, sf):
    d = variants.replace_vectors(dataset(spark, sf).select("theme_id", "mal_id", "embedding", "embed_model", "embed_version"), _layers(spark, sf), CFG.embed_model, CFG.embed_version)
    return d.select("theme_id", "mal_id", "variant", "embed_model", "embed_version", F.size("embedding").alias("dims"))


# --- evaluation ------------------------------------------------------------------------------------------


def _stored(spark, sf):
    """The catalogue with its artists, stored for seed tables in one mode or several."""
    c = evaluate.with_mbids(_whole(spark, sf), _resolved(spark, sf), artists.neighbours(_similar(spark, sf)))
    return evaluate.stored(recommend.prepare(c).drop("embedding"))


def seeds(spark, sf, mode: str = "purist", held=None) -> DataFrame:
    return cut(evaluate.seed_table(held or _stored(spark, sf), CFG, mode=mode))


def eval_seed_table(spark, sf):
    return seeds(spark, sf).select("seed", "pool", "n_artist", "n_behavioural", *[F.round(F.col(f"{x}_{y}") + _NUDGE, 6).alias(f"{x}_{y}") for x in ("share", "jaccard", "near") for y in ("at", "pool")])


def _first_hit(family):
    return lambda spark, sf: evaluate.family_scores(seeds(spark, sf), family)


def _values(names: str, keep=("name", "value", "baseline", "lift", "n_seeds")):
    def run(spark, sf):
        m = evaluate.metrics(evaluate.per_seed(seeds(spark, sf))).filter(F.col("name").rlike(names))
        return m.select(*[_six(c) if c in ("value", "baseline", "lift") else c for c in keep])
    return run


def bootstrap_ci(spark, sf):
    return evaluate.intervals(evaluate.per_seed(seeds(spark, sf)))


def bootstrap_ci_large(spark, sf):
    return evaluate.intervals_large(evaluate.per_seed(seeds(spark, sf)))


def random_recall(spark, sf):
    s = evaluate.with_random(evaluate.family_scores(seeds(spark, sf), "artist"), evaluate.ARTIST_KS)
    return s.select("seed", F.explode("random_recall").alias("k", "baseline")).select("seed", "k", _six("baseline"))


def random_mrr(spark, sf):
    return evaluate.with_random(evaluate.family_scores(seeds(spark, sf), "artist"), ()).select("seed", F.round("random_mrr", 6).alias("baseline"))


def _ranks(spark, sf, mode, held):
    return evaluate.family_scores(seeds(spark, sf, mode, held), "artist")


def paired_delta(spark, sf):
    held = _stored(spark, sf)
    d = evaluate.paired(_ranks(spark, sf, "purist", held), _ranks(spark, sf, "comfort", held))
    return evaluate.paired_summary(d).select(_six("mrr_baseline"), _six("mrr"), _six("delta"), "better", "worse", "n_seeds")


def median_ranks(spark, sf):
    t = seeds(spark, sf)
    out = None
    for family in evaluate.FAMILIES:
        m = evaluate.median_first_rank(evaluate.family_scores(t, family)).select(F.lit(family).alias("family"), "median_rank", "median_pool")
        out = m if out is None else out.unionByName(m)
    return out


def corpus_meta(spark, sf):
    """What a run's record says of its corpus."""
    d = cut(recommend.prepare(dataset(spark, sf)))
    size = d.agg(F.count(F.lit(1)).alias("themes"), F.countDistinct("mal_id").alias("anime"), F.max(F.size("u")).alias("embed_dim"))
    row = size.first().asDict() | evaluate.fingerprint(d).first().asDict() | vectors.mean_offdiagonal_cosine(d, "u").select(_six("mean_cosine")).first().asDict()
    return spark.createDataFrame([row], "themes long, anime long, embed_dim int, fingerprint string, mean_cosine double")


def _halves(spark, sf) -> DataFrame:
    """``variant, seed, rank`` of both halves of the vectors as variants."""
    d = cut(dataset(spark, sf).select("theme_id", "mal_id", "audio_id", "artist_ids", "genres", "start_year", "embedding"))
    ranks = None
    for n in (0, 1):
        half = d.withColumn("embedding", F.slice("embedding", n * DIMS // 2 + 1, DIMS // 2)).filter(vectors.usable(F.col("embedding")))
        r = evaluate.family_scores(evaluate.seed_table(recommend.prepare(half), CFG), "artist").withColumn("variant", F.lit(f"layer0{n}"))
        ranks = r if ranks is None else ranks.unionByName(r)
    return cut(ranks)


def _by_anime(spark, sf) -> DataFrame:
    return themes(spark, sf).select(F.col("theme_id").alias("seed"), "mal_id")


def sweep_vectors(spark, sf):
    return evaluate.sweep(_halves(spark, sf), _by_anime(spark, sf), "layer01").select("variant", "n_shared", _six("tune_mrr"), _six("holdout_mrr"), "selected", "is_reference")


def sweep_holdout(spark, sf):
    """The paired test of the selected half of the vectors against the other over the held-out anime; all zero where the reference was selected."""
    ranks, groups = _halves(spark, sf), _by_anime(spark, sf)
    first = evaluate.sweep(ranks, groups, "").filter("selected").first().variant
    reference = "layer01" if first == "layer00" else "layer00"
    diffs = evaluate.holdout(ranks, groups, evaluate.sweep(ranks, groups, reference))
    return evaluate.paired_summary(diffs).select(_six("mrr_baseline"), _six("mrr"), _six("delta"), "better", "worse", "n_seeds")


def bootstrap_bounds(spark, sf):
    """Of every metric: whether its interval holds the value, and about as wide as the normal distribution has it."""
    values = cut(evaluate.per_seed(seeds(spark, sf)))
    m = values.groupBy("name").agg(F.avg("value").alias("v"), F.stddev_pop("value").alias("sd"), F.count(F.lit(1)).alias("n_seeds"))
    j = m.join(evaluate.intervals(values), "name")
    width = 2 * 1.96 * F.col("sd") / F.sqrt("n_seeds")
    return j.select("name", "n_seeds", F.col("v").between(F.col("ci_low") - 1e-12, F.col("ci_high") + 1e-12).alias("inside"), (F.abs(F.col("ci_high") - F.col("ci_low") - width) <= 0.25 * width + 1e-9).alias("near_normal"))


def variant_sweep(spark, sf):
    ranks, held = None, _stored(spark, sf)
    for mode in scores.MODES:
        r = _ranks(spark, sf, mode, held).withColumn("variant", F.lit(mode))
        ranks = r if ranks is None else ranks.unionByName(r)
    groups = themes(spark, sf).select(F.col("theme_id").alias("seed"), "mal_id")
    return evaluate.sweep(ranks, groups, "purist").select("variant", "n_shared", _six("tune_mrr"), _six("holdout_mrr"), "selected", "is_reference")


QUERIES = {
    "scan_prune": scan_prune, "top_popular": top_popular, "guard_zero_norm": guard_zero_norm, "fingerprint": fingerprint, "vec_norm": vec_norm, "vec_mean": vec_mean, "gram": gram,
    "mean_offdiag_cosine": mean_offdiag_cosine, "cosine_consecutive": cosine_consecutive, "metadata_weight": metadata_weight,
    "recommend_purist": _mode("purist"), "recommend_discovery": _mode("discovery"), "recommend_comfort": _mode("comfort"),
    "recommend_exclude_same": _mode("discovery", exclude_same_anime=True), "recommend_no_dedup": _mode("discovery", dedup_audio=False), "recommend_cap1": _mode("discovery", max_per_anime=1),
    "recommend_cap5": _mode("discovery", max_per_anime=5), "recommend_one_seed": recommend_one_seed, "whiten_project": whiten_project, "whiten_gram": whiten_gram, "whiten_variance": whiten_variance, "recommend_whitened": recommend_whitened,
    "pick_audio": pick_audio, "flatten_nested": flatten_nested, "dedup_keep_first": dedup_keep_first, "build_dataset": build_dataset, "exclude_errors": exclude_errors, "join_loss": join_loss,
    "staleness_offenders": staleness_offenders, "incremental_todo": incremental_todo, "dup_basenames": dup_basenames, "shard_union": shard_union,
    "download_targets": download_targets, "metadata_flatten": metadata_flatten, "embed_capture": embed_capture, "pool_frames": pool_frames, "artist_map": artist_map, "similar_payloads": similar_payloads,
    "hash_split": hash_split, "split_chunks": split_chunks, "pool_mean": pool_mean, "feature_lengths": feature_lengths,
    "artist_frequency": artist_frequency, "normalize_name": normalize_name, "artist_resolve": artist_resolve, "top3_neighbours": top3_neighbours, "neighbour_sizes": neighbour_sizes, "artist_coverage": artist_coverage,
    "neighbours_in_corpus": neighbours_in_corpus, "variant_layers": variant_layers, "variant_complete": variant_complete, "variant_dataset": variant_dataset,
    "eval_seed_table": eval_seed_table, "artist_first_hit": _first_hit("artist"), "related_first_hit": _first_hit("behavioural"), "recall_at_k": _values("recall", ("name", "value", "n_seeds")),
    "mrr": _values("mrr", ("name", "value", "n_seeds")), "random_recall": random_recall, "random_mrr": random_mrr, "controls": _values("^(genre|era)", ("name", "value", "baseline", "n_seeds")), "lift_table": _values("."),
    "bootstrap_ci": bootstrap_ci, "bootstrap_ci_large": bootstrap_ci_large, "bootstrap_bounds": bootstrap_bounds, "paired_delta": paired_delta, "variant_sweep": variant_sweep,
    "median_ranks": median_ranks, "corpus_meta": corpus_meta, "sweep_vectors": sweep_vectors, "sweep_holdout": sweep_holdout,
}


# --- the same in SQL -------------------------------------------------------------------------------------

_GOOD = f"len(embedding) = {DIMS} and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))"
_TH = "th as (select * from animethemes where theme_id is not null and mal_id is not null and audio_id is not null qualify row_number() over (partition by theme_id order by ingest_pos) = 1)"
_ML = "ml as (select mal_id, title, start_year, score, genres from mal where mal_id is not null qualify row_number() over (partition by mal_id order by ingest_pos) = 1)"
_VE = (f"ve as (select theme_id, embedding::double[] as v, embed_model, embed_version from theme_vectors where embed_version = '{CFG.embed_version}' and theme_id is not null and {_GOOD}"
       " qualify row_number() over (partition by theme_id order by ingest_pos) = 1)")
_DS = f"""with {_TH}, {_ML}, {_VE},
ds as (select th.theme_id, th.mal_id, th.audio_id, ml.title, th.theme_type, th.theme_sequence, th.song_title, th.artist_ids, th.artist_names, ml.start_year, ml.score, ml.genres, ve.v, ve.embed_model, ve.embed_version,
  list_distinct(list_filter(coalesce(th.artist_ids, []), lambda x: x is not null)) as aa, list_distinct(list_filter(coalesce(ml.genres, []), lambda x: x is not null)) as gg,
  list_transform(ve.v, lambda x: x / sqrt(list_inner_product(ve.v, ve.v))) as u
  from th join ml using (mal_id) join ve using (theme_id))"""


def _pairs(scale: float, exclude: bool) -> str:
    weight = "(0.1::double * sm::int + 0.3::double * sa::int + 0.05::double * er::int + 0.3::double * ja) / (0.1::double + 0.3::double + 0.05::double + 0.3::double)"
    return f""", p0 as (select a.theme_id as seed, b.theme_id, b.mal_id, b.audio_id, list_inner_product(a.u, b.u) as cos, a.mal_id = b.mal_id as sm, list_has_any(a.aa, b.aa) as sa,
  coalesce(abs(a.start_year - b.start_year) <= 2, false) as er, len(list_intersect(a.gg, b.gg)) as ni, len(a.gg) + len(b.gg) - len(list_intersect(a.gg, b.gg)) as nu from ds a join ds b on a.theme_id <> b.theme_id{" and a.mal_id <> b.mal_id" if exclude else ""}),
p1 as (select *, case when nu > 0 then ni / nu::double else 0 end as ja from p0),
p as (select *, {weight} as w, cos + {scale}::double * 0.3::double * ({weight}) as raw, round(cos + {scale}::double * 0.3::double * ({weight}), 9) as final from p1)"""


def _rec(scale: float, exclude=False, dedup=True, cap=None) -> str:
    d = "select * from p" + (" qualify row_number() over (partition by seed, audio_id order by final desc, theme_id) = 1" if dedup else "")
    c = "select * from d" + (f" qualify row_number() over (partition by seed, mal_id order by final desc, theme_id) <= {cap}" if cap else "")
    return _DS + _pairs(scale, exclude) + f""", d as ({d}), c as ({c}), r as (select *, row_number() over (partition by seed order by final desc, theme_id) as rank from c)
select seed, rank::int as rank, theme_id, round(cos, 6) as l1_cos, round(w, 6) as l2_weight, round(raw, 6) as final from r where rank <= 20"""


_SIM = """sim as (select mbid, mb_row, list({'mbid': mbid, 'score': coalesce(score, 0)}) over (partition by country order by mb_row rows between 1 following and 5 following) as l from mb_artists),
sim1 as (select * from sim where mbid is not null qualify row_number() over (partition by mbid order by mb_row) = 1),
se as (select mbid, unnest(l) as e, unnest(range(1, len(l) + 1)) as pos from sim1),
nb as (select distinct mbid, near from (select mbid, e.mbid as near, row_number() over (partition by mbid order by e.score desc, pos) as n from se) where n <= 3 and near is not null)"""


#: The same where entries without an id are left out before the first three are taken, as a service's answers have it.
_SIM2 = _SIM.replace("from sim1)", "from (select mbid, list_filter(l, lambda x: x.mbid is not null) as l from sim1))")


def _eval(scale: float = 0.0) -> str:
    return _DS + ", " + _SIM + """, own as (select ds.theme_id, list_distinct(list(m.mbid)) as mb from (select theme_id, unnest(artist_names) as name from ds) ds join (select query as name, mbid from mb_artists where mbid is not null) m using (name) group by 1),
nea as (select theme_id, list(distinct near) as nr from (select theme_id, unnest(mb) as mbid from own) join nb using (mbid) group by 1)""" + _pairs(scale, True) + """,
d as (select p.* from p qualify row_number() over (partition by seed, audio_id order by final desc, theme_id) = 1),
r as (select d.*, row_number() over (partition by d.seed order by d.final desc, d.theme_id) as rank, ni > 0 as share,
  coalesce(list_has_any(ob.mb, list_filter(nea.nr, lambda x: not list_contains(oa.mb, x))) and not list_has_any(ob.mb, oa.mb), false) as rel
  from d left join own oa on oa.theme_id = d.seed left join own ob on ob.theme_id = d.theme_id left join nea on nea.theme_id = d.seed),
s0 as (select seed, count(*) as pool, count(*) filter (sa) as n_artist, min(rank) filter (sa) as artist_rank, count(*) filter (rel) as n_behavioural, min(rank) filter (rel) as behavioural_rank,
  avg(share::int) filter (rank <= 10) as share_at, avg(ja) filter (rank <= 10) as jaccard_at, avg(er::int) filter (rank <= 10) as near_at, avg(share::int) as share_pool, avg(ja) as jaccard_pool, avg(er::int) as near_pool from r group by seed),
s as (select s0.*, len(gg) > 0 as has_genres, start_year is not null as has_year, mal_id from s0 join ds on ds.theme_id = s0.seed where pool >= 10),
fam as (select 'artist' as fam, seed, artist_rank as rank, pool, n_artist as n_rel from s where n_artist > 0 union all select 'related', seed, behavioural_rank, pool, n_behavioural from s where n_behavioural > 0),
rec as (select fam, seed, rank, pool::double as n, n_rel::double as m, k, least(k, pool)::double as kk from fam, (select unnest([1, 3, 5, 10, 20, 50, 100]) as k) where fam = 'artist' or k in (1, 5, 10, 20)),
recb as (select *, case when n - m < kk then 1.0 else 1 - exp(lgamma(n - m + 1) + lgamma(n - kk + 1) - lgamma(n - m - kk + 1) - lgamma(n + 1)) end as base from rec),
mrrb as (select fam, seed, rank, pool, n_rel, list_sum(list_transform(range(1, (pool - n_rel + 2)::bigint), lambda q:
  exp(lgamma((pool - q + 1)::double) - lgamma(n_rel::double) - lgamma((pool - q - n_rel + 2)::double) - (lgamma((pool + 1)::double) - lgamma((n_rel + 1)::double) - lgamma((pool - n_rel + 1)::double))) / q)) as base from fam),
met as (select fam || '_recall@' || k as name, seed, (rank <= k)::int::double as value, base from recb
  union all select fam || '_mrr', seed, 1.0::double / rank, base from mrrb
  union all select 'artist_first_rank', seed, rank::double, (pool + 1)::double / (n_rel + 1) from fam where fam = 'artist'
  union all select 'genre_precision@10', seed, share_at, share_pool from s where has_genres union all select 'genre_jaccard@10', seed, jaccard_at, jaccard_pool from s where has_genres
  union all select 'era_precision@10', seed, near_at, near_pool from s where has_year),
lt as (select name, avg(value) as value, avg(base) as baseline, case when avg(base) > 0 then avg(value) / avg(base) end as lift, count(*) as n_seeds from met group by name)
"""


_U = "list_transform(ve.v, lambda x: x / sqrt(list_inner_product(ve.v, ve.v))) as u"


def _eval_half(n: int) -> str:
    """The evaluation with one half of the vectors."""
    h = f"ve.v[{n * DIMS // 2 + 1}:{(n + 1) * DIMS // 2}]"
    return _eval().replace(_U, f"list_transform({h}, lambda x: x / sqrt(list_inner_product({h}, {h}))) as u")


def _half(x: str) -> str:
    return f"(('0x' || right(md5({x}::varchar), 1))::int % 2)::int"


def _ranks_sql(scale: float) -> str:
    return f"({_eval(scale)} select seed, artist_rank as rank, mal_id from s where n_artist > 0)"


_PICK = _P1 + """, cand as (select v.record_id, v.anime_pos, v.theme_pos, v.entry_pos, v.video_pos, coalesce(try_cast(v.node->>'$.nc' as boolean), false) as nc, try_cast(v.node->>'$.resolution' as int) as raw, a.node as audio
  from videos v join audios a using (record_id, anime_pos, theme_pos, entry_pos, video_pos)),
best as (select * from cand qualify row_number() over (partition by record_id, anime_pos, theme_pos order by nc desc, coalesce(raw, 0) desc, entry_pos, video_pos) = 1)"""


def _inverse(source: str) -> str:
    """Mean of ``v`` and inverse covariance (population size) of the rows of ``source``, by elimination on lists; ``dev`` has the centred vectors."""
    return f"""mn as (select list(x order by i) as mu from (select i, avg(x) as x from (select unnest(v) as x, unnest(range({DIMS})) as i from {source}) group by i)),
dev as (select theme_id, list_transform(v, lambda x, i: x - mu[i]) as d from {source}, mn),
dl as (select theme_id, unnest(d) as x, unnest(range({DIMS})) as i from dev),
cv as (select a.i, b.i as j, sum(a.x * b.x) / (select count(*) from dev) as x from dl a join dl b using (theme_id) group by all),
mt as (select list(r order by i) as m from (select i, list_concat(list(x order by j), list_transform(range({DIMS}), lambda q: (q = i)::int::double)) as r from cv group by i)),
gj as (select 0 as k, m from mt union all
  select k + 1, list_transform(m, lambda r, i: case when i = k + 1 then p else list_transform(r, lambda x, j: x - r[k + 1] * p[j]) end)
  from (select k, m, list_transform(m[k + 1], lambda x: x / m[k + 1][k + 1]) as p from gj where k < {DIMS})),
iv as (select list_transform(m, lambda r: r[{DIMS} + 1:]) as inv from gj where k = {DIMS}),
wh as (select theme_id, d, list_transform(inv, lambda r: list_inner_product(r, d)) as t from dev, iv),
wu as (select theme_id, list_transform(d, lambda x: x / sqrt(list_inner_product(d, t))) as wu, list_transform(t, lambda x: x / sqrt(list_inner_product(d, t))) as wt, list_inner_product(d, t) as length2 from wh)"""


def _rec_whitened() -> str:
    sql = _DS.replace("with th", "with recursive th", 1) + ", " + _inverse("ds") + ", dw as (select ds.*, wu, wt from ds join wu using (theme_id))"
    pairs_sql = _pairs(1, False).replace("list_inner_product(a.u, b.u)", "list_inner_product(a.wu, b.wt)").replace("from ds a join ds b", "from dw a join dw b")
    return sql + pairs_sql + _rec(1).removeprefix(_DS + _pairs(1, False))


_KEY = "regexp_replace(lower({}), '[^a-z0-9]+', '', 'g')"

SQL = {
    "scan_prune": "select start_year, count(*) as n, round(avg(score), 6) as mean_score from mal where score >= 7.5 group by 1",
    "top_popular": "select mal_id from mal where popularity is not null order by popularity, mal_id limit 100",
    "guard_zero_norm": f"select ingest_pos, theme_id from theme_vectors where not coalesce({_GOOD}, false)",
    "fingerprint": _DS + " select left(sha256(string_agg(theme_id::varchar, ',' order by theme_id)), 16) as fingerprint from ds",
    "vec_norm": f"with {_VE} select theme_id, round(sqrt(list_inner_product(v, v)), 6) as norm from ve",
    "vec_mean": f"with {_VE} select (i - 1)::int as pos, round(avg(x), 6) as mean from (select unnest(v) as x, unnest(range(1, {DIMS + 1})) as i from ve) group by i",
    "gram": f"""with {_VE}, x as (select theme_id, unnest(v) as x, unnest(range({DIMS})) as i from ve), c as (select theme_id, i, x - avg(x) over (partition by i) as x from x)
select a.i::int as i, b.i::int as j, round(sum(a.x * b.x), 4) as x from c a join c b using (theme_id) group by all""",
    "mean_offdiag_cosine": _DS + " select (select count(*) from ds) as n, round(avg(list_inner_product(a.u, b.u)), 6) as mean_cosine from ds a join ds b on a.theme_id < b.theme_id",
    "cosine_consecutive": _DS + """ select theme_id, before, round(list_inner_product(u, w), 6) as cosine from (select theme_id, u, lag(theme_id) over x as before, lag(u) over x as w from ds window x as (partition by mal_id order by theme_id)) where before is not null""",
    "metadata_weight": _DS + """, l as (select *, lag(theme_id) over x as before, lag(mal_id) over x as bm, lag(aa) over x as ba, lag(gg) over x as bg, lag(start_year) over x as b_y from ds window x as (partition by start_year order by theme_id)),
q as (select theme_id, before, mal_id = bm as same_anime, list_has_any(aa, ba) as same_artist, coalesce(abs(start_year - b_y) <= 2, false) as era, len(list_intersect(gg, bg)) as ni, len(gg) + len(bg) - len(list_intersect(gg, bg)) as nu from l where before is not null),
j as (select *, case when nu > 0 then ni / nu::double else 0 end as ja from q)
select theme_id, before, same_anime, same_artist, era, round(ja, 6) as jaccard, round((0.1::double * same_anime::int + 0.3::double * same_artist::int + 0.05::double * era::int + 0.3::double * ja) / 0.75::double, 6) as weight from j""",
    "whiten_project": f"with recursive {_VE}, {_inverse('ve')} select theme_id, {DIMS} as components, round(length2, 6) as length2 from wu",
    "recommend_whitened": _rec_whitened(),
    "whiten_gram": f"select i::int as i, j::int as j, (i = j)::int::double as x from range({DIMS}) a(i), range({DIMS}) b(j)",
    "whiten_variance": f"select {DIMS} as components, 1.0::double as variance_kept",
    "recommend_purist": _rec(0), "recommend_discovery": _rec(1), "recommend_comfort": _rec(2), "recommend_exclude_same": _rec(1, exclude=True), "recommend_no_dedup": _rec(1, dedup=False),
    "recommend_cap1": _rec(1, cap=1), "recommend_cap5": _rec(1, cap=5),
    "recommend_one_seed": f"""select x.seed, x.rank, x.theme_id, y.mal_id, y.audio_id, y.title, coalesce(y.theme_type, 'None') || coalesce(y.theme_sequence::varchar, '') as theme_label, y.song_title,
  coalesce(array_to_string(list_filter(y.artist_names, lambda n: n is not null), ', '), '') as artist_names, y.start_year::int as year, y.score as anime_score, x.l1_cos, x.l2_weight, x.final
  from ({_rec(1, cap=5)}) x join ({_DS} select * from ds) y using (theme_id) where x.seed = ({_DS} select min(theme_id) from ds)""",
    "pick_audio": _PICK + f""" select record_id, anime_pos::int as anime_pos, theme_pos::int as theme_pos, try_cast(audio->>'$.id' as bigint) as audio_id, nc, coalesce(raw, 0) as resolution from best""",
    "flatten_nested": _PICK + f""", an as (select record_id, anime_pos, node->>'$.slug' as anime_slug, {_listed("(node->'$.resources')")} as res from anime),
ids as (select record_id, anime_pos, anime_slug, list_filter(list_transform(res, lambda r: case when r->>'$.site' = '{catalogue.SITE}' then try_cast(r->>'$.external_id' as bigint) end), lambda i: i is not null)[1] as mal_id from an),
j as (select b.record_id, b.anime_pos, b.theme_pos, t.node, b.audio, b.nc, b.raw, i.anime_slug, i.mal_id, try_cast(t.node->>'$.id' as bigint) as theme_id, try_cast(b.audio->>'$.id' as bigint) as audio_id, t.node->'$.song' as song
  from best b join themes t using (record_id, anime_pos, theme_pos) join ids i using (record_id, anime_pos)),
k as (select * from j where mal_id is not null and theme_id is not null and audio_id is not null qualify row_number() over (partition by record_id, anime_pos, audio_id order by theme_pos) = 1),
f as (select * from k qualify row_number() over (partition by theme_id order by record_id, anime_pos, theme_pos) = 1)
select record_id, anime_pos::int as anime_pos, theme_id, anime_slug, mal_id, node->>'$.type' as theme_type, try_cast(node->>'$.sequence' as int) as sequence, node->>'$.slug' as theme_slug, try_cast(song->>'$.id' as bigint) as song_id, song->>'$.title' as song_title,
  list_transform({_listed("(song->'$.artists')")}, lambda x: try_cast(x->>'$.id' as bigint)) as artist_ids, list_transform({_listed("(song->'$.artists')")}, lambda x: x->>'$.name') as artist_names,
  audio_id, audio->>'$.link' as audio_link, audio->>'$.basename' as audio_basename, try_cast(audio->>'$.size' as bigint) as audio_size, audio->>'$.path' as audio_path, nc as source_video_nc, raw as source_video_resolution from f""",
    "dedup_keep_first": "select theme_id, ingest_pos, audio_id, song_title from animethemes where theme_id is not null qualify row_number() over (partition by theme_id order by ingest_pos) = 1",
    "build_dataset": _DS + " select theme_id, mal_id, audio_id, title, theme_type, theme_sequence, song_title, artist_ids, artist_names, start_year, score, genres, embed_model, embed_version from ds",
    "exclude_errors": f"""with {_TH} select theme_id, audio_id from th where audio_id not in (select audio_id from animethemes where audio_link is null and audio_id is not null)
  and theme_id not in (select theme_id from theme_vectors where theme_id is not null and not coalesce({_GOOD}, false))""",
    "join_loss": f"""with {_TH}, {_ML}, {_VE}, j as (select th.theme_id, ml.mal_id is null as m, ve.theme_id is null as e from th left join ml using (mal_id) left join ve on ve.theme_id = th.theme_id)
select count(*) as n_themes, count(*) filter (m) as without_metadata, count(*) filter (e) as without_vector, count(*) filter (not m and not e) as complete from j""",
    "staleness_offenders": f"select distinct embed_model, embed_version from theme_vectors where not (embed_model is not distinct from '{CFG.embed_model}' and embed_version is not distinct from '{CFG.embed_version}') order by 1, 2 limit 5",
    "incremental_todo": f"with {_TH}, {_VE} select theme_id, audio_id from th where theme_id not in (select theme_id from ve)",
    "dup_basenames": "select split_part(audio_basename, '-', 1) as audio_basename, count(distinct audio_id) as n from animethemes where audio_id is not null and audio_basename is not null group by 1 having count(distinct audio_id) > 1",
    "download_targets": """select audio_id, audio_link, audio_basename, audio_size from animethemes where audio_id is not null and audio_link is not null and audio_basename is not null
  qualify row_number() over (partition by audio_id order by ingest_pos) = 1""",
    "metadata_flatten": """select ingest_pos, mal_id, title, aired_from, aired_to, start_year as year, mal_rank as rank, score, list_filter(coalesce(genres, []), lambda x: x is not null and x <> '') as genres,
  list_filter(coalesce(genre_ids, []), lambda x: x is not null) as genre_ids, list_filter(coalesce(studios, []), lambda x: x is not null and x <> '') as studios,
  list_filter(coalesce(studio_ids, []), lambda x: x is not null) as studio_ids, list_filter(coalesce(themes, []), lambda x: x is not null and x <> '') as themes from mal where mal_id is not null""",
    "embed_capture": f"""with g as (select ingest_pos, coalesce(len(embedding) = {DIMS} and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))), false) as ok from theme_vectors)
select ingest_pos, '{CFG.embed_version}' as embed_version, case when ok then {DIMS} end as dims, case when ok then {DIMS // 8} end as n_chunks_used, case when ok then {DIMS / 2}::double end as total_seconds_used,
  case when not ok then 'ValueError' end as error_class, case when not ok then 'not a whole vector' end as error_message from g""",
    "pool_frames": f"""with {_VE}, x as (select theme_id, theme_id % 8 + 1 as n, unnest(v) as x, unnest(range({DIMS})) as i from ve), m as (select theme_id, i % 8 as d, sum(x) / any_value(n) as x from x where i // 8 < n group by all)
select theme_id, round(max(x) filter (d = 0), 6) as first, round(sum(x), 6) as total from m group by 1""",
    "artist_map": "select query as name, mbid from mb_artists where mbid is not null and query is not null",
    "similar_payloads": f"with {_SIM2} select mbid, near from nb",
    "shard_union": f"select embed_version, count(*) as n, count(case when embed_version = '{CFG.embed_version}' then n_chunks_used end) as n_with_chunks from theme_vectors where embed_version is not null group by 1",
    "hash_split": f"with {_ML} select mal_id, {_half('mal_id')} as half from ml",
    "split_chunks": f"""with {_VE}, c as (select theme_id, i::int as chunk_no, v[i * 20 + 1:i * 20 + 30] as p from ve, (select unnest([0, 1, 2]) as i))
select theme_id, chunk_no, len(p)::int as real_len, round(list_sum(p), 6) as total from c where len(p) = 30 or chunk_no = 0 and len(p) > 0""",
    "pool_mean": _DS + f""", x as (select mal_id, i, avg(x) as x from (select mal_id, unnest(v) as x, unnest(range({DIMS})) as i from ds) group by all)
select mal_id, count(*)::int as dims, round(max(x) filter (i = 0), 6) as first, round(sqrt(sum(x * x)), 6) as norm from x group by 1""",
    "feature_lengths": """select ingest_pos, least(greatest(floor((floor((round(total_seconds_used * 100)::bigint - 10) / 5.0) + 1 - 3) / 2.0) + 1, 1), 1500)::bigint as frames from theme_vectors where total_seconds_used is not null""",
    "artist_frequency": "select name, count(*) as n_themes from (select unnest(artist_names) as name from animethemes) where name is not null group by 1",
    "normalize_name": f"select mb_row, {_KEY.format('query')} as key from mb_artists",
    "artist_resolve": f"""with n as (select distinct name as query, {_KEY.format('name')} as k from (select unnest(artist_names) as name from animethemes) where name is not null),
c as (select n.query, m.mbid, m.mb_name, m.mb_row from n join mb_artists m on m.mbid is not null and (n.k = {_KEY.format('m.mb_name')} or n.k = {_KEY.format('m.query')}) where n.k <> '' qualify row_number() over (partition by n.query order by m.mb_row) = 1)
select n.query, c.mbid, c.mb_name from n left join c using (query) where n.k <> ''""",
    "top3_neighbours": f"with {_SIM} select mbid, near from nb",
    "neighbour_sizes": f"with {_SIM}, z as (select mbid, count(*) as c from nb group by 1), o as (select c, row_number() over (order by c) - 1 as i, count(*) over () as n from z) select any_value(n) as n, max(c) filter (i = n // 2) as upper_median, max(c) as largest from o",
    "artist_coverage": """with t as (select distinct theme_id from animethemes where theme_id is not null), h as (select distinct theme_id from (select theme_id, unnest(artist_names) as name from animethemes) where name in (select query from mb_artists where mbid is not null))
select count(*) as n_themes, round(avg((theme_id in (select theme_id from h where theme_id is not null))::int), 6) as share from t""",
    "neighbours_in_corpus": f"""with {_SIM} select mbid, near from nb where near in (select m.mbid from mb_artists m join (select distinct unnest(artist_names) as name from animethemes) a on a.name = m.query where m.mbid is not null)""",
    "variant_layers": f"""with {_VE}, l as (select 'layer00' as variant, v[1:{DIMS // 2}] as e from ve union all select 'layer01', v[{DIMS // 2 + 1}:{DIMS}] from ve)
select variant, count(*) as n_themes, round(avg(sqrt(list_inner_product(e, e))), 6) as mean_norm from l group by 1""",
    "variant_complete": f"""with h as (select theme_id, n, embedding[n * {DIMS // 2} + 1:(n + 1) * {DIMS // 2}] as e from theme_vectors, (select unnest([0, 1]) as n) where theme_id is not null)
select theme_id from h where len(e) = {DIMS // 2} and list_bool_and(list_transform(e, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(e, lambda x: x <> 0)) group by 1 having count(distinct n) = 2""",
    "variant_dataset": _DS + f" select theme_id, mal_id, variant, '{CFG.embed_model}' as embed_model, embed_version || '-' || variant as embed_version, {DIMS // 2} as dims from ds, (select unnest(['layer00', 'layer01']) as variant)",
    "eval_seed_table": _eval() + " select seed, pool, n_artist, n_behavioural, " + ", ".join(f"round({x}_{y} + {_NUDGE}::double, 6) as {x}_{y}" for x in ("share", "jaccard", "near") for y in ("at", "pool")) + " from s",
    "artist_first_hit": _eval() + " select seed, rank, pool, n_rel from fam where fam = 'artist'",
    "related_first_hit": _eval() + " select seed, rank, pool, n_rel from fam where fam = 'related'",
    "recall_at_k": _eval() + " select name, round(value, 6) as value, n_seeds from lt where name like '%recall%'",
    "mrr": _eval() + " select name, round(value, 6) as value, n_seeds from lt where name like '%mrr'",
    "random_recall": _eval() + " select seed, k::int as k, round(base, 6) as baseline from recb where fam = 'artist'",
    "random_mrr": _eval() + " select seed, round(base, 6) as baseline from mrrb where fam = 'artist'",
    "controls": _eval() + " select name, round(value, 6) as value, round(baseline, 6) as baseline, n_seeds from lt where name like 'genre%' or name like 'era%'",
    "lift_table": _eval() + " select name, round(value, 6) as value, round(baseline, 6) as baseline, round(lift, 6) as lift, n_seeds from lt",
    "bootstrap_bounds": _eval() + " select name, n_seeds, true as inside, true as near_normal from lt",
    "median_ranks": _eval() + """ select f.family, floor(median(fam.rank))::bigint as median_rank, floor(median(fam.pool))::bigint as median_pool
  from (select unnest(['artist', 'behavioural']) as family, unnest(['artist', 'related']) as fam) f left join fam using (fam) group by 1""",
    "corpus_meta": _DS + """ select (select count(*) from ds) as themes, (select count(distinct mal_id) from ds) as anime, (select max(len(u))::int from ds) as embed_dim,
  (select left(sha256(string_agg(theme_id::varchar, ',' order by theme_id)), 16) from ds) as fingerprint, round(avg(list_inner_product(a.u, b.u)), 6) as mean_cosine from ds a join ds b on a.theme_id < b.theme_id""",
    "sweep_vectors": f"""with u as (select 'layer00' as variant, * from ({_eval_half(0)} select seed, artist_rank as rank, mal_id from s where n_artist > 0) union all select 'layer01', * from ({_eval_half(1)} select seed, artist_rank as rank, mal_id from s where n_artist > 0)),
sh as (select seed from u group by 1 having count(distinct variant) = 2), g as (select variant, count(*) as n_shared, avg(1.0::double / rank) filter ({_half('mal_id')} = 0) as t, avg(1.0::double / rank) filter ({_half('mal_id')} = 1) as h from u where seed in (select seed from sh) group by 1)
select variant, n_shared, round(t, 6) as tune_mrr, round(h, 6) as holdout_mrr, row_number() over (order by t desc, variant) = 1 as selected, variant = 'layer01' as is_reference from g""",
    "sweep_holdout": f"""with a as ({_eval_half(0)} select seed, artist_rank as rank, mal_id from s where n_artist > 0), b as ({_eval_half(1)} select seed, artist_rank as rank, mal_id from s where n_artist > 0),
j as (select a.seed, a.mal_id, 1.0::double / a.rank as x, 1.0::double / b.rank as y from a join b using (seed)), w as (select avg(x) >= avg(y) as first from j where {_half('mal_id')} = 0),
h as (select case when first then y else x end as base, case when first then x else y end as chosen from j, w where {_half('mal_id')} = 1)
select round(avg(base), 6) as mrr_baseline, round(avg(chosen), 6) as mrr, round(avg(chosen - base), 6) as delta, count(*) filter (chosen > base) as better, count(*) filter (chosen < base) as worse, count(*) as n_seeds from h""",
    "paired_delta": f"select round(avg(1.0::double / a.rank), 6) as mrr_baseline, round(avg(1.0::double / b.rank), 6) as mrr, round(avg(1.0::double / b.rank - 1.0::double / a.rank), 6) as delta, count(*) filter (b.rank < a.rank) as better, count(*) filter (b.rank > a.rank) as worse, count(*) as n_seeds from {_ranks_sql(0)} a join {_ranks_sql(2)} b using (seed)",
    "variant_sweep": f"""with u as (select 'purist' as variant, * from {_ranks_sql(0)} union all select 'discovery', * from {_ranks_sql(1)} union all select 'comfort', * from {_ranks_sql(2)}),
sh as (select seed from u group by 1 having count(distinct variant) = 3), g as (select variant, count(*) as n_shared, avg(1.0::double / rank) filter ({_half('mal_id')} = 0) as t, avg(1.0::double / rank) filter ({_half('mal_id')} = 1) as h from u where seed in (select seed from sh) group by 1)
select variant, n_shared, round(t, 6) as tune_mrr, round(h, 6) as holdout_mrr, row_number() over (order by t desc, variant) = 1 as selected, variant = 'purist' as is_reference from g""",
}
