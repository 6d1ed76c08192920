"""Registered queries of the core's data-preparation operators (p1, p5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested, references
from ..session import spread, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.level_rows(spread(table(spark, sf, "anime_payloads").select("record_id", "payload")))


def _p1_table(level: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return nested.flat_table(spread(table(spark, sf, "anime_payloads").select("record_id", "payload")), level)
    return run


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    themes, mal, vectors = (table(spark, sf, t) for t in ("animethemes", "mal", "theme_vectors"))
    a = references.orphans(themes, ["mal_id"], "ingest_pos", "ingested_at", mal, ["mal_id"], "ingested_at", "deleted_at", ref_table="animethemes")
    b = references.orphans(vectors, ["theme_id"], "ingest_pos", "ingested_at", themes, ["theme_id"], "ingested_at", "deleted_at", ref_table="theme_vectors")
    return a.unionByName(b)


def p5_report(spark: SparkSession, sf: str) -> DataFrame:
    return references.report(p5_found(spark, sf))


def p5_composite(spark: SparkSession, sf: str) -> DataFrame:
    """Themes by the two columns (theme_id, audio_id) of their vectors, on those that aren't null (MATCH PARTIAL)."""
    themes, vectors = table(spark, sf, "animethemes"), table(spark, sf, "theme_vectors")
    return references.orphans(vectors, ["theme_id", "audio_id"], "ingest_pos", "ingested_at", themes, ["theme_id", "audio_id"], "ingested_at", "deleted_at", ref_table="theme_vectors", match="partial")


QUERIES = {
    "p1_found": p1_found,
    "p1_themes": _p1_table("theme"), "p1_entries": _p1_table("entry"), "p1_videos": _p1_table("video"), "p1_audios": _p1_table("audio"),
    "p5_found": p5_found, "p5_report": p5_report, "p5_composite": p5_composite,
}


def _listed(x: str) -> str:
    """SQL: JSON list of ``x`` in any encoding."""
    inner = f"(case when json_type({x}) = 'VARCHAR' then case when json_valid({x}->>'$') then ({x}->>'$')::json end else {x} end)"
    return f"(case json_type({inner}) when 'ARRAY' then {inner}::json[] when 'OBJECT' then [{inner}] else [] end)"


def _level(source: str, expr: str, keys: str, own: str) -> str:
    """SQL: the objects of one level with their positions."""
    return (
        f"select {keys}, node, i - 1 as {own} from (select {keys}, unnest(l) as node, unnest(range(1, len(l) + 1)) as i"
        f" from (select {keys}, {_listed(expr)} as l from {source}))"
    )


_ID = "coalesce(try_cast(node->>'$.id' as bigint), -1)"
_P1 = f"""
with docs as (select record_id, payload::json as doc from anime_payloads where json_valid(payload) and json_type(payload) = 'OBJECT'),
anime as (
  select record_id, node, i - 1 as anime_pos from (select record_id, unnest(l) as node, unnest(range(1, len(l) + 1)) as i from (
    select record_id, case when json_exists(doc, '$.anime') then {_listed("(doc->'$.anime')")} else [doc] end as l from docs))
  where json_type(node) = 'OBJECT'),
themes as (select * from ({_level("anime", "(node->'$.animethemes')", "record_id, anime_pos", "theme_pos")}) where json_type(node) = 'OBJECT'),
entries as (select * from ({_level("themes", "(node->'$.animethemeentries')", "record_id, anime_pos, theme_pos", "entry_pos")}) where json_type(node) = 'OBJECT'),
videos as (select * from ({_level("entries", "(node->'$.videos')", "record_id, anime_pos, theme_pos, entry_pos", "video_pos")}) where json_type(node) = 'OBJECT'),
audios as (select * exclude (node), node->'$.audio' as node from videos where json_type(node->'$.audio') = 'OBJECT')
"""


def _orphan_sql(ref: str, key: str, target: str) -> str:
    return f"""
select '{ref}' as ref_table, r.ingest_pos as row_id,
  case when t.first is null and t.n is null then 'missing' when t.first <= r.ingested_at then 'deleted' else 'late' end as reason,
  strftime(r.ingested_at, '%Y-%m') as period
from {ref} r left join (select {key}, min(ingested_at) as first, count(*) as n from {target} group by all) t using ({key})
where r.{key} is not null and not exists (select 1 from {target} x where x.{key} = r.{key} and x.ingested_at <= r.ingested_at
  and (x.deleted_at is null or x.deleted_at > r.ingested_at))"""


_P5 = _orphan_sql("animethemes", "mal_id", "mal") + " union all " + _orphan_sql("theme_vectors", "theme_id", "animethemes")

_PARTIAL = """
select 'theme_vectors' as ref_table, r.ingest_pos as row_id,
  case when not exists (select 1 from animethemes x where {on}) then 'missing'
       when exists (select 1 from animethemes x where {on} and x.ingested_at <= r.ingested_at) then 'deleted' else 'late' end as reason,
  strftime(r.ingested_at, '%Y-%m') as period
from theme_vectors r where {mask} and not exists (select 1 from animethemes x where {on} and x.ingested_at <= r.ingested_at
  and (x.deleted_at is null or x.deleted_at > r.ingested_at))"""

SQL = {
    "p1_found": _P1 + f"""
select record_id, anime_pos::int as anime_pos, 'theme' as level, theme_pos::int as theme_pos, -1 as entry_pos, -1 as video_pos, {_ID} as object_id from themes
union all select record_id, anime_pos::int, 'entry', theme_pos::int, entry_pos::int, -1, -1::bigint from entries
union all select record_id, anime_pos::int, 'video', theme_pos::int, entry_pos::int, video_pos::int, -1::bigint from videos
union all select record_id, anime_pos::int, 'audio', theme_pos::int, entry_pos::int, video_pos::int, {_ID} from audios""",
    "p1_themes": _P1 + f"""
select record_id, anime_pos::int as anime_pos, theme_pos::int as theme_pos, {_ID} as theme_id, node->>'$.type' as theme_type,
  try_cast(node->>'$.sequence' as int) as theme_sequence, node->>'$.slug' as theme_slug, try_cast(node->>'$.song.id' as bigint) as song_id, node->>'$.song.title' as song_title
from themes""",
    "p1_entries": _P1 + "select record_id, anime_pos::int as anime_pos, theme_pos::int as theme_pos, entry_pos::int as entry_pos, node->>'$.episodes' as episodes, try_cast(node->>'$.version' as int) as version from entries",
    "p1_videos": _P1 + """
select record_id, anime_pos::int as anime_pos, theme_pos::int as theme_pos, entry_pos::int as entry_pos, video_pos::int as video_pos,
  try_cast(node->>'$.nc' as boolean) as nc, try_cast(node->>'$.resolution' as int) as resolution from videos""",
    "p1_audios": _P1 + f"""
select record_id, anime_pos::int as anime_pos, theme_pos::int as theme_pos, entry_pos::int as entry_pos, video_pos::int as video_pos, {_ID} as audio_id,
  node->>'$.link' as link, node->>'$.basename' as basename, try_cast(node->>'$.size' as bigint) as size, node->>'$.path' as path from audios""",
    "p5_found": _P5,
    "p5_report": f"select ref_table, period, reason, count(*) as n_orphans from ({_P5}) group by all",
    "p5_composite": " union all ".join(
        _PARTIAL.format(on=on, mask=mask) for on, mask in (
            ("x.theme_id = r.theme_id and x.audio_id = r.audio_id", "r.theme_id is not null and r.audio_id is not null"),
            ("x.theme_id = r.theme_id", "r.theme_id is not null and r.audio_id is null"),
            ("x.audio_id = r.audio_id", "r.theme_id is null and r.audio_id is not null"),
        )
    ),
}
