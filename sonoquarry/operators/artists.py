"""Artists: frequencies, resolution to ids among service candidates, similar-artist neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scores


def frequency(themes: DataFrame, names: str = "artist_names") -> DataFrame:
    """``name, n_themes`` of every artist name that isn't null; order by n_themes descending, name."""
    return themes.select(F.explode(names).alias("name")).filter("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n_themes"))


def resolve(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """``query, mbid, mb_name``: the first candidate whose name, alias or sort name equals the query by its key.

    ``candidates``: ``query, pos, mbid, mb_name, aliases array<struct<name, sort_name>>``. Queries whose key is empty
    (no letter a-z or digit) resolve to none.
    """
    key = scores.normal_name(F.col("query"))
    alias = F.exists(F.coalesce("aliases", F.array().cast("array<struct<name:string,sort_name:string>>")), lambda a: (scores.normal_name(a["name"]) == F.col("_k")) | (scores.normal_name(a["sort_name"]) == F.col("_k")))
    fits = candidates.withColumn("_k", key).filter((F.col("_k") != "") & (F.coalesce(scores.normal_name(F.col("mb_name")) == F.col("_k"), F.lit(False)) | F.coalesce(alias, F.lit(False))))
    best = fits.groupBy("query").agg(F.min_by(F.struct("mbid", "mb_name"), F.col("pos")).alias("b"))
    return queries.select("query").distinct().join(best, "query", "left").select("query", "b.mbid", "b.mb_name")


def candidate_rows(found: DataFrame, query: str = "query") -> DataFrame:
    """The rows that ``resolve`` compares, of service answers (``query, place, payload``: one candidate artist each)."""
    kind = "struct<mbid:string,mb_name:string,country:string,type:string,score:int,aliases:array<struct<name:string,sort_name:string>>>"
    return found.select(F.col(query).alias("query"), F.col("place").alias("pos"), F.from_json("payload", kind).alias("a")).select("query", "pos", "a.*")


def neighbours(lists: DataFrame, top: int = 3) -> DataFrame:
    """``mbid, near``: of each artist's similar list the first ``top`` by score (null counts 0, the list's order among equals).

    ``lists``: ``mbid, similar array<struct<mbid, name, score>>``. Entries without an id use up their place and then drop.
    """
    e = lists.select("mbid", F.posexplode("similar").alias("pos", "s")).filter("s is not null")
    w = Window.partitionBy("mbid").orderBy(F.coalesce("s.score", F.lit(0.0)).desc(), "pos")
    return e.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") <= top) & F.col("s.mbid").isNotNull()).select("mbid", F.col("s.mbid").alias("near")).distinct()


def artist_map(text: DataFrame, column: str = "value") -> DataFrame:
    """``name, mbid`` of a JSON map name -> resolved entry or null."""
    m = text.select(F.explode(F.from_json(column, schemas.ARTIST_MAP)).alias("name", "e"))
    return m.filter("e.mbid is not null").select("name", "e.mbid")


def similar_map(text: DataFrame, column: str = "value") -> DataFrame:
    """``mbid, similar`` of a JSON map id -> list or null."""
    return text.select(F.explode(F.from_json(column, schemas.SIMILAR_MAP)).alias("mbid", "similar")).filter("similar is not null")


def similar_payload(payload: DataFrame, column: str = "payload") -> DataFrame:
    """Similar artists of a service answer, a plain list or one wrapped as ``data`` or ``similar_artists``; entries need ``artist_mbid``."""
    kind = "array<struct<artist_mbid:string,name:string,score:double>>"
    plain = F.from_json(column, kind)
    wrapped = F.from_json(column, f"struct<data:{kind},similar_artists:{kind}>")
    held = F.when(F.size(wrapped["data"]) > 0, wrapped["data"]).otherwise(F.coalesce(wrapped["similar_artists"], wrapped["data"]))
    rows = F.when(F.ltrim(column).startswith("["), plain).otherwise(held)
    return payload.select("*", F.transform(F.filter(rows, lambda r: r["artist_mbid"].isNotNull()), lambda r: F.struct(r["artist_mbid"].alias("mbid"), r["name"].alias("name"), r["score"].alias("score"))).alias("similar"))


def in_corpus(near: DataFrame, themes: DataFrame, resolved: DataFrame) -> DataFrame:
    """Neighbour rows (``mbid, near``) whose neighbour is credited in the corpus under a resolved name (``name, mbid``)."""
    named = themes.select(F.explode("artist_names").alias("name")).distinct().join(resolved.dropna().distinct(), "name")
    return near.join(named.select(F.col("mbid").alias("near")).distinct(), "near", "left_semi").select("mbid", "near")


def coverage(themes: DataFrame, resolved: DataFrame) -> DataFrame:
    """``n_themes, share``: themes with at least one resolved artist."""
    hit = themes.select("theme_id", F.explode("artist_names").alias("name")).join(resolved.select("name").distinct(), "name", "left_semi").select("theme_id").distinct().withColumn("_h", F.lit(1.0))
    return themes.select("theme_id").distinct().join(hit, "theme_id", "left").agg(F.count(F.lit(1)).alias("n_themes"), F.avg(F.coalesce("_h", F.lit(0.0))).alias("share"))


def list_sizes(lists: DataFrame) -> DataFrame:
    """``n, upper_median, largest`` of the neighbour lists (the element at n // 2 of the sorted sizes; nulls for no list).

    The sizes are counted first; only the few different ones come together in one row.
    """
    sizes = lists.groupBy("mbid").agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("c"))
    one = sizes.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.max("size").alias("largest"), F.array_sort(F.collect_list(F.struct("size", "c"))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("up"), F.lit(None).cast("long").alias("found"))
    def step(s, x):
        up = s["up"] + x["c"]
        return F.struct(up.alias("up"), F.coalesce(s["found"], F.when(up > F.floor(F.col("n") / 2), x["size"])).alias("found"))

    return one.select("n", F.aggregate("all", start, step)["found"].alias("upper_median"), "largest")
