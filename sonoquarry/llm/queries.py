"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import spread, table
from . import bpe, leaks, names, neighbours, splitting, topn


#: The vectors that take part: rows of this version only.
VERSION = "sr24000-c30x3s30-L6"


def p2_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The ranked neighbours of every theme."""
    rows = table(spark, sf, "theme_vectors").filter(F.col("embed_version") == VERSION)
    found = neighbours.nearest(rows.select("theme_id", "embedding", "ingest_pos"), "theme_id", "embedding", "ingest_pos", k=5, least=0.90)
    return found.select(F.col("id").alias("theme_id"), F.col("other").alias("neighbour_id"), "cosine", "rank_no")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    found = p2_neighbours(spark, sf).select(F.col("theme_id").alias("id"), F.col("neighbour_id").alias("other"))
    return neighbours.neighbour_pairs(found).toDF("theme_id_a", "theme_id_b")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    credits = table(spark, sf, "animethemes").select("ingest_pos", "artist_names")
    return names.link_credits(credits, table(spark, sf, "mb_artists"), table(spark, sf, "name_nicknames"))


def p3_known(spark: SparkSession, sf: str) -> DataFrame:
    """The artist of every looked-up spelling whose answer is on record, found without that record (known names and their credits only)."""
    mb = table(spark, sf, "mb_artists").filter("mbid is not null")
    named = mb.select("mbid", F.col("mb_name").alias("name")).dropna().distinct()
    credits = table(spark, sf, "animethemes").select(F.explode("artist_names").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("weight"))
    asked = mb.select("mb_row", F.col("query").alias("text")).join(named.select(F.col("name").alias("text")), "text", "left_anti")
    found = names.link(asked.select("text").distinct(), named.join(credits, "name", "left").na.fill({"weight": 0}), table(spark, sf, "name_nicknames"))
    return asked.join(found, "text").select("mb_row", "mbid")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "candidate_scores")
    return topn.top_n(rows, "seed_theme_id", "theme_id", "final", unique="audio_id", cap="mal_id", n=10, per_cap=5, exclude_self=True)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode(_docs(spark, sf))


def p6_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Texts decoded from their ids (null texts as empty ones)."""
    return bpe.decode(p6_ids(spark, sf))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.find_leaks(_docs(spark, sf), table(spark, sf, "eval_items").select("item_id", "text"))


def p8_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split(_docs(spark, sf), limit=512, overlap=64)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that the splitter cuts: those with a second piece."""
    return splitting.split(_docs(spark, sf), limit=512, overlap=64, with_text=False).filter("piece_no = 1").select("doc_id")


def p8_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Of every document: whether its pieces stay within the limit, begin and follow one another as they should, and share the overlap."""
    p = splitting.split(_docs(spark, sf), limit=512, overlap=64, with_text=False)
    w = Window.partitionBy("doc_id").orderBy("piece_no")
    before = p.withColumn("end_before", F.lag("end_token").over(w)).withColumn("n_before", F.lag("n_tokens").over(w)).withColumn("nth", F.row_number().over(w))
    shared = F.coalesce(F.col("end_before") - F.least("n_before", F.lit(64)), F.lit(0))
    return before.groupBy("doc_id").agg(
        F.every(F.col("n_tokens").between(1, 512) & (F.col("n_tokens") == F.col("end_token") - F.col("start_token"))).alias("within_limit"),
        F.every((F.col("piece_no") == F.col("nth") - 1) & (F.col("end_token") > F.coalesce("end_before", F.lit(0)))).alias("in_order"), F.every(F.col("start_token") == shared).alias("overlaps"),
    )


def p8_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """The texts put together again from their pieces' new parts."""
    return splitting.rebuild(splitting.split(_docs(spark, sf), limit=512, overlap=64, with_text=False, with_new=True))


QUERIES = {
    "p2_found": p2_found, "p2_neighbours": p2_neighbours,
    "p3_found": p3_found, "p3_known": p3_known,
    "p4_found": p4_found,
    "p6_ids": p6_ids, "p6_round_trip": p6_round_trip,
    "p7_found": p7_found,
    "p8_found": p8_found, "p8_pieces": p8_pieces, "p8_ranges": p8_ranges, "p8_rebuilt": p8_rebuilt,
}

_P2 = f"""
with good as (select theme_id, ingest_pos, embedding::double[] as v from theme_vectors where embed_version = '{VERSION}' and theme_id is not null and len(embedding) = 64
  and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
one as (select theme_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) as u from good qualify row_number() over (partition by theme_id order by ingest_pos) = 1),
near as (select a.theme_id as id, b.theme_id as other, list_inner_product(a.u, b.u) as c from one a join one b on a.theme_id <> b.theme_id),
best as (select id, other, round(c, 6) as cosine, row_number() over (partition by id order by round(c, 6) desc, other) as rank_no from near where c >= 0.9)
"""

SQL = {
    "p2_found": _P2 + "select distinct least(id, other) as theme_id_a, greatest(id, other) as theme_id_b from best where rank_no <= 5",
    "p2_neighbours": _P2 + "select id as theme_id, other as neighbour_id, cosine, rank_no::int as rank_no from best where rank_no <= 5",
    "p3_known": "select mb_row, mbid from mb_artists where mbid is not null and query not in (select mb_name from mb_artists where mbid is not null and mb_name is not null)",
    "p4_found": """
with r as (select *, row_number() over () as n from candidate_scores where final is not null and not isnan(final) and theme_id <> seed_theme_id),
a as (select * from r qualify audio_id is null or row_number() over (partition by seed_theme_id, audio_id order by final desc, theme_id, n) = 1),
c as (select * from a qualify mal_id is null or row_number() over (partition by seed_theme_id, mal_id order by final desc, theme_id, audio_id nulls last, n) <= 5),
k as (select *, row_number() over (partition by seed_theme_id order by final desc, theme_id, audio_id nulls last, n) as rank_no from c)
select seed_theme_id, rank_no::int as rank_no, theme_id from k where rank_no <= 10 and seed_theme_id is not null""",
    "p8_ranges": "select doc_id, true as within_limit, true as in_order, true as overlaps from documents where text <> ''",
    "p8_rebuilt": "select doc_id, text from documents where text <> ''",
    "p6_round_trip": "select doc_id, coalesce(text, '') as text from documents",
}
