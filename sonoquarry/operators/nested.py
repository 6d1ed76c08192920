"""Deeply nested catalogue payloads to related flat tables (problem 1).

A payload is parsed once to VARIANT; nested ``transform`` calls attach the ancestor keys and
positions, ``flatten`` joins the levels' arrays, and one ``inline`` per target table emits rows.
There is no shuffle: every record is projected where it is read.

Defined results
- null, blank, truncated or otherwise invalid JSON, or JSON with trailing text: no rows. So for a
  payload that is a list or scalar. Of a key that an object repeats, the last value counts.
- a list may come as a list, as one object in its place (position 0) or as a string that holds
  either as JSON; anything else counts as an empty list.
- null and non-object elements keep their position and give no row.
- repeated records each give their rows; extra input columns are ignored.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Fields read from the objects of each level (all kept as VARIANT until they are typed in the flat tables).
_ANIME = "struct<slug:variant,name:variant,year:variant,animethemes:variant>"
_THEME = "struct<id:variant,type:variant,sequence:variant,slug:variant,song:variant,animethemeentries:variant>"
_ENTRY = "struct<episodes:variant,version:variant,videos:variant>"
_VIDEO = "struct<nc:variant,resolution:variant,audio:variant>"
_AUDIO = "struct<id:variant,link:variant,basename:variant,size:variant,path:variant>"

LEVELS = ("theme", "entry", "video", "audio")


def _get(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def parse_whole(text: Column) -> Column:
    """The VARIANT of a text that is exactly one JSON value, else null.

    The JSON parser stops after the first value; wrapped as the only element of a list that must be
    closed again, a text with anything behind its value doesn't parse.
    """
    wrapped = F.try_parse_json(F.concat(F.lit('{"w":['), text, F.lit('],"z":0}')))
    held = F.try_variant_get(wrapped, "$.w", "array<variant>")
    return F.when(F.size(held) == 1, F.element_at(held, 1))


@contextmanager
def _repeated_keys(df: DataFrame):
    """A repeated key is valid JSON; by default the parser refuses it. Plans keep the setting they were made under, so the session's is put back."""
    conf, name = df.sparkSession.conf, "spark.sql.variant.allowDuplicateKeys"
    before = conf.get(name)
    conf.set(name, "true")
    try:
        yield
    finally:
        conf.set(name, before)


def as_list(v: Column) -> Column:
    """``array<variant>`` of a list in any encoding (see the module's text)."""
    def plain(x: Column) -> Column:
        listed = _get(x, "array<variant>")
        is_object = _get(x, "struct<id:variant>").isNotNull()
        return F.coalesce(listed, F.when(is_object, F.array(x)))

    direct = plain(v)
    decoded = plain(parse_whole(_get(v, "string")))
    return F.coalesce(direct, decoded, F.array().cast("array<variant>"))


def _objects(holder: Column, list_of, kind: str, keys: tuple[str, ...], own: str) -> Column:
    """Rows of one level: for each holder its children that are objects, with inherited keys and own position."""
    def children(h: Column) -> Column:
        return F.transform(
            list_of(h["node"]),
            lambda c, i: F.struct(*[h[k].alias(k) for k in keys], i.cast("int").alias(own), _get(c, kind).alias("node")),
        )

    return F.filter(F.flatten(F.transform(holder, children)), lambda r: r["node"].isNotNull())


def project(payloads: DataFrame, record: str = "record_id", payload: str = "payload") -> DataFrame:
    """One row per record with an array of keyed objects for each level (``themes`` .. ``audios``)."""
    with _repeated_keys(payloads):
        return _project(payloads, record, payload)


def _project(payloads: DataFrame, record: str, payload: str) -> DataFrame:
    root = payloads.select(F.col(record).alias("record_id"), parse_whole(F.col(payload)).alias("doc"))
    top = root.select("record_id", _get(F.col("doc"), "struct<anime:variant,animethemes:variant>").alias("top"), "doc")
    one = F.array(F.struct(F.lit(0).alias("anime_pos"), _get(F.col("doc"), _ANIME).alias("node")))
    many = F.transform(as_list(F.col("top.anime")), lambda a, i: F.struct(i.cast("int").alias("anime_pos"), _get(a, _ANIME).alias("node")))
    animes = F.when(F.col("top.anime").isNotNull(), many).otherwise(one)
    out = top.filter(F.col("top").isNotNull()).select("record_id", F.filter(animes, lambda a: a["node"].isNotNull()).alias("animes"))
    out = out.withColumn("themes", _objects(F.col("animes"), lambda n: as_list(n["animethemes"]), _THEME, ("anime_pos",), "theme_pos"))
    out = out.withColumn("entries", _objects(F.col("themes"), lambda n: as_list(n["animethemeentries"]), _ENTRY, ("anime_pos", "theme_pos"), "entry_pos"))
    out = out.withColumn("videos", _objects(F.col("entries"), lambda n: as_list(n["videos"]), _VIDEO, ("anime_pos", "theme_pos", "entry_pos"), "video_pos"))
    audios = F.transform(
        F.col("videos"),
        lambda v: F.struct(*[v[k].alias(k) for k in ("anime_pos", "theme_pos", "entry_pos", "video_pos")], _get(v["node"]["audio"], _AUDIO).alias("node")),
    )
    return out.withColumn("audios", F.filter(audios, lambda r: r["node"].isNotNull()))


def object_id(v: Column) -> Column:
    """Numeric id of an object (a number, or a text of digits; no truth value), -1 if it has none."""
    return F.coalesce(F.when(F.schema_of_variant(v) != "BOOLEAN", F.try_variant_get(v, "$", "bigint")), F.lit(-1).cast("bigint"))


def level_rows(payloads: DataFrame, record: str = "record_id", payload: str = "payload") -> DataFrame:
    """``record_id, anime_pos, level, theme_pos, entry_pos, video_pos, object_id``: one row per object of any level."""
    p = project(payloads, record, payload)
    none = F.lit(-1)

    def rows(arr: str, level: str, have: int, with_id: bool) -> Column:
        return F.transform(
            F.col(arr),
            lambda r: F.struct(
                r["anime_pos"].alias("anime_pos"), F.lit(level).alias("level"), r["theme_pos"].alias("theme_pos"),
                (r["entry_pos"] if have > 1 else none).alias("entry_pos"), (r["video_pos"] if have > 2 else none).alias("video_pos"),
                (object_id(r["node"]["id"]) if with_id else none.cast("bigint")).alias("object_id"),
            ),
        )

    every = F.concat(rows("themes", "theme", 1, True), rows("entries", "entry", 2, False), rows("videos", "video", 3, False), rows("audios", "audio", 3, True))
    return p.select("record_id", F.inline(every))


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def flat_tables(payloads: DataFrame, record: str = "record_id", payload: str = "payload") -> dict[str, DataFrame]:
    """All four flat tables from one parse: the keyed objects are written once, each table reads its own level's column."""
    p = cut(project(payloads, record, payload).drop("animes"))
    return {level: _flat(p, level) for level in LEVELS}


def flat_table(payloads: DataFrame, level: str, record: str = "record_id", payload: str = "payload") -> DataFrame:
    """The flat table of one level with its ancestor keys and typed fields; one ``inline`` emits its rows.

    Columns are the record, the positions down to the level, and the level's own fields. A field
    that is missing, null or of another type is null. Unknown ``level``: ValueError.
    """
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}, got {level!r}")
    return _flat(project(payloads, record, payload), level)


def _flat(p: DataFrame, level: str) -> DataFrame:
    def n(name, kind="string"):
        return F.try_variant_get(F.col(f"node.{name}"), "$", kind).alias(name)
    if level == "theme":
        rows = p.select("record_id", F.inline("themes"))
        song = F.col("node.song")
        return rows.select(
            "record_id", "anime_pos", "theme_pos", object_id(F.col("node.id")).alias("theme_id"), n("type").alias("theme_type"), n("sequence", "int").alias("theme_sequence"),
            n("slug").alias("theme_slug"), F.try_variant_get(song, "$.id", "bigint").alias("song_id"), F.try_variant_get(song, "$.title", "string").alias("song_title"),
        )
    if level == "entry":
        return p.select("record_id", F.inline("entries")).select("record_id", "anime_pos", "theme_pos", "entry_pos", n("episodes"), n("version", "int"))
    if level == "video":
        return p.select("record_id", F.inline("videos")).select("record_id", "anime_pos", "theme_pos", "entry_pos", "video_pos", n("nc", "boolean"), n("resolution", "int"))
    rows = p.select("record_id", F.inline("audios"))
    return rows.select(
        "record_id", "anime_pos", "theme_pos", "entry_pos", "video_pos", object_id(F.col("node.id")).alias("audio_id"),
        n("link"), n("basename"), n("size", "bigint"), n("path"),
    )


def typed_anime(payloads: DataFrame, record: str = "record_id", payload: str = "payload") -> DataFrame:
    """``record_id, anime_pos, slug, resources, animethemes``: one row per anime object with its lists in declared types, whatever encoding they came in.

    Elements that are no objects become null and keep their place.
    """
    def text(v, name):
        return F.try_variant_get(v, f"$.{name}", "string").alias(name)

    def number(v, name, kind="bigint"):
        return F.try_variant_get(v, f"$.{name}", kind).alias(name)

    def part(v, name):
        return F.try_variant_get(v, f"$.{name}", "variant")

    def is_object(v):
        return _get(v, "struct<id:variant>").isNotNull()

    def audio(v):
        return F.when(is_object(v), F.struct(number(v, "id"), text(v, "link"), text(v, "basename"), number(v, "size"), text(v, "path")))

    def video(v):
        return F.when(is_object(v), F.struct(number(v, "nc", "boolean"), number(v, "resolution", "int"), audio(part(v, "audio")).alias("audio")))

    def entry(v):
        return F.when(is_object(v), F.struct(F.transform(as_list(part(v, "videos")), video).alias("videos")))

    def song(v):
        artists = F.transform(as_list(part(v, "artists")), lambda a: F.struct(number(a, "id"), text(a, "name")))
        return F.when(is_object(v), F.struct(number(v, "id"), text(v, "title"), artists.alias("artists")))

    def theme(v):
        entries = F.transform(as_list(part(v, "animethemeentries")), entry).alias("animethemeentries")
        return F.when(is_object(v), F.struct(number(v, "id"), text(v, "type"), number(v, "sequence", "int"), text(v, "slug"), song(part(v, "song")).alias("song"), entries))

    def resource(v):
        return F.struct(text(v, "site"), number(v, "external_id"))

    with _repeated_keys(payloads):
        return _typed(payloads, record, payload, part, is_object, text, resource, theme)


def _typed(payloads: DataFrame, record: str, payload: str, part, is_object, text, resource, theme) -> DataFrame:
    p = payloads.select(F.col(record).alias("record_id"), parse_whole(F.col(payload)).alias("doc"))
    p = p.withColumn("many", part(F.col("doc"), "anime")).filter(is_object(F.col("doc")))
    p = p.select("record_id", F.posexplode(F.when(F.col("many").isNotNull(), as_list(F.col("many"))).otherwise(F.array("doc"))).alias("anime_pos", "a")).filter(is_object(F.col("a")))
    a = F.col("a")
    return p.select(
        "record_id", "anime_pos", text(a, "slug"), F.transform(as_list(part(a, "resources")), resource).alias("resources"), F.transform(as_list(part(a, "animethemes")), theme).alias("animethemes"),
    )
