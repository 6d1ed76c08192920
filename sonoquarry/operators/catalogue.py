"""Catalogue ETL: pages to themes, documents to metadata, the joined dataset with its accounting and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import DataError, NothingToDo, StaleEmbeddings

# Fixed value: the site whose ids tie themes to metadata.
SITE = "MyAnimeList"


def site_id(resources: Column) -> Column:
    """The first id that ``SITE`` gives and that isn't null, else null."""
    return F.try_element_at(F.filter(resources, lambda r: (r["site"] == SITE) & r["external_id"].isNotNull()), F.lit(1))["external_id"]


def best_audio(entries: Column) -> Column:
    """``struct(nc, resolution, audio, raw_resolution)`` of the best video with audio: creditless first, then resolution, then the first met. Null if none."""
    videos = F.flatten(F.transform(F.coalesce(entries, F.array().cast("array<struct<videos:array<struct<nc:boolean,resolution:int,audio:struct<id:bigint,link:string,basename:string,size:bigint,path:string>>>>>")), lambda e: F.coalesce(e["videos"], F.array().cast("array<struct<nc:boolean,resolution:int,audio:struct<id:bigint,link:string,basename:string,size:bigint,path:string>>>"))))
    heard = F.filter(videos, lambda v: v["audio"].isNotNull())
    ranked = F.transform(heard, lambda v, i: F.struct(F.coalesce(v["nc"], F.lit(False)).alias("nc"), F.coalesce(v["resolution"], F.lit(0)).alias("resolution"), (-i).alias("place"), v["audio"].alias("audio"), v["resolution"].alias("raw_resolution")))
    return F.array_max(ranked)


def theme_rows(anime: DataFrame, keys: tuple[str, ...] = ("ingest_pos",)) -> DataFrame:
    """Theme rows of catalogue objects (columns ``keys, slug, resources, animethemes``), with ``theme_pos``.

    Objects without a site id and themes without id or audio are dropped; within one object the first theme per recording stays.
    """
    a = anime.withColumn("mal_id", site_id(F.col("resources"))).filter("mal_id is not null")
    t = a.select(*keys, "mal_id", F.col("slug").alias("anime_slug"), F.posexplode("animethemes").alias("theme_pos", "t")).filter("t.id is not null")
    t = t.withColumn("best", best_audio(F.col("t.animethemeentries"))).filter("best.audio.id is not null")
    first = Window.partitionBy(*keys, "best.audio.id").orderBy("theme_pos")
    t = t.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    artists = F.coalesce(F.col("t.song.artists"), F.array().cast("array<struct<id:bigint,name:string>>"))
    return t.select(
        *keys, "theme_pos", F.col("t.id").alias("theme_id"), "anime_slug", "mal_id", F.col("t.type").alias("theme_type"), F.col("t.sequence").alias("sequence"), F.col("t.slug").alias("theme_slug"),
        F.col("t.song.id").alias("song_id"), F.col("t.song.title").alias("song_title"), F.transform(artists, lambda x: x["id"]).alias("artist_ids"), F.transform(artists, lambda x: x["name"]).alias("artist_names"),
        F.col("best.audio.id").alias("audio_id"), F.col("best.audio.link").alias("audio_link"), F.col("best.audio.basename").alias("audio_basename"), F.col("best.audio.size").alias("audio_size"),
        F.col("best.audio.path").alias("audio_path"), F.col("best.nc").alias("source_video_nc"), F.col("best.raw_resolution").alias("source_video_resolution"),
    )


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row per key in the given order (limited map side, so repeated keys don't travel)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def ref_names(refs: Column) -> Column:
    """Names of referenced objects, empty and null ones left out; a null list is empty."""
    return F.filter(F.transform(F.coalesce(refs, F.array().cast("array<struct<mal_id:bigint,name:string>>")), lambda x: x["name"]), lambda n: n != "")


def ref_ids(refs: Column) -> Column:
    return F.filter(F.transform(F.coalesce(refs, F.array().cast("array<struct<mal_id:bigint,name:string>>")), lambda x: x["mal_id"]), lambda i: i.isNotNull())


def metadata_rows(docs: DataFrame) -> DataFrame:
    """Metadata rows of documents read with ``schemas.MAL_DOC``; documents without an id (``{}``: not found) are dropped."""
    plain = ["mal_id", "title", "title_english", "title_japanese", "type", "episodes", "status"]
    rest = ["season", "year", "score", "scored_by", "rank", "popularity", "members", "favorites", "source", "rating", "synopsis"]
    return docs.filter("mal_id is not null").select(
        *plain, F.col("aired.from").alias("aired_from"), F.col("aired.to").alias("aired_to"), *rest,
        ref_names(F.col("genres")).alias("genres"), ref_ids(F.col("genres")).alias("genre_ids"), ref_names(F.col("themes")).alias("themes"),
        ref_names(F.col("demographics")).alias("demographics"), ref_names(F.col("studios")).alias("studios"), ref_ids(F.col("studios")).alias("studio_ids"),
    )


def build_dataset(themes: DataFrame, metadata: DataFrame, embeddings: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """themes joined with metadata on mal_id and vectors on theme_id, without the excluded theme ids.

    Column pruning and join order are the optimizer's; exclusion comes before the joins. No vectors: NothingToDo.
    """
    if embeddings.isEmpty():
        raise NothingToDo("no embeddings to join")
    t = themes if excluded is None else themes.join(excluded.select("theme_id"), "theme_id", "left_anti")
    return t.join(metadata, "mal_id").join(embeddings.drop("audio_id"), "theme_id")


def excluded_themes(themes: DataFrame, download_errors: DataFrame, embed_errors: DataFrame) -> DataFrame:
    """``theme_id`` of themes whose recording couldn't be fetched or embedded."""
    lost = themes.join(download_errors.select("audio_id"), "audio_id", "left_semi").select("theme_id")
    return lost.unionByName(embed_errors.select("theme_id")).filter("theme_id is not null").distinct()


def join_loss(themes: DataFrame, metadata: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``n_themes, without_metadata, without_vector, complete`` in one pass of left joins on distinct keys."""
    m = metadata.select("mal_id").distinct().withColumn("_m", F.lit(True))
    e = embeddings.select("theme_id").distinct().withColumn("_e", F.lit(True))
    j = themes.select("theme_id", "mal_id").join(m, "mal_id", "left").join(e, "theme_id", "left")
    return j.agg(
        F.count(F.lit(1)).alias("n_themes"), F.count_if(F.col("_m").isNull()).alias("without_metadata"), F.count_if(F.col("_e").isNull()).alias("without_vector"),
        F.count_if(F.col("_m").isNotNull() & F.col("_e").isNotNull()).alias("complete"),
    )


def todo(themes: DataFrame, done: DataFrame) -> DataFrame:
    """Themes that have no vector yet."""
    return themes.join(done.select("theme_id"), "theme_id", "left_anti")


def stale(embeddings: DataFrame, model: str, version: str) -> DataFrame:
    """Up to five different model and version pairs that aren't the expected ones."""
    other = ~(F.col("embed_model").eqNullSafe(model) & F.col("embed_version").eqNullSafe(version))
    return embeddings.filter(other).select("embed_model", "embed_version").distinct().orderBy("embed_model", "embed_version").limit(5)


def check_stale(embeddings: DataFrame, model: str, version: str) -> None:
    bad = [tuple(r) for r in stale(embeddings, model, version).collect()]
    if bad:
        raise StaleEmbeddings(f"the store holds {bad}, expected {(model, version)}; rebuild it")


def duplicate_basenames(themes: DataFrame) -> DataFrame:
    """``audio_basename, n`` of file names that several recordings share."""
    targets = themes.select("audio_id", "audio_basename").dropna().distinct()
    return targets.groupBy("audio_basename").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_basenames(themes: DataFrame) -> None:
    bad = [r.audio_basename for r in duplicate_basenames(themes).orderBy("audio_basename").limit(10).collect()]
    if bad:
        raise DataError(f"file names of several recordings: {bad}")


def top_ids(metadata: DataFrame, n: int, by: str = "popularity") -> DataFrame:
    """``mal_id`` of the first ``n`` by popularity or score rank (ordinals: lower is better); other ``by``: ValueError."""
    column = {"popularity": "popularity", "score": "mal_rank" if "mal_rank" in metadata.columns else "rank"}.get(by)
    if column is None:
        raise ValueError(f"by must be popularity or score, got {by!r}")
    return metadata.filter(F.col(column).isNotNull()).orderBy(column, "mal_id").limit(n).select("mal_id")
