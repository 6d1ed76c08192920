import json

import pytest

from sonoquarry.operators import catalogue, nested

from .conftest import rows


def found(spark, *payloads):
    df = spark.createDataFrame([(i, p, "x", 7) for i, p in enumerate(payloads)], "record_id long, payload string, doc string, theme_pos int")
    return rows(nested.level_rows(df))


AUDIO = {"id": 9, "link": "l", "basename": "b", "size": 3, "path": "p"}


def test_levels_positions_and_ids(spark):
    anime = {"slug": "a", "animethemes": [None, {"id": "12", "animethemeentries": [{"videos": [None, {"audio": AUDIO}, {"audio": None}]}, None]}, 5]}
    assert found(spark, json.dumps(anime)) == [
        (0, 0, "audio", 1, 0, 1, 9), (0, 0, "entry", 1, 0, -1, -1), (0, 0, "theme", 1, -1, -1, 12), (0, 0, "video", 1, 0, 1, -1), (0, 0, "video", 1, 0, 2, -1),
    ]


def test_any_encoding_of_a_list(spark):
    videos = [{"audio": {"id": "no number"}}]
    one = {"animethemes": {"animethemeentries": {"videos": json.dumps(videos)}}}
    many = json.dumps({"anime": [None, one]})
    expected = [("audio", 0, 0, 0, -1), ("entry", 0, 0, -1, -1), ("theme", 0, -1, -1, -1), ("video", 0, 0, 0, -1)]
    assert [(r[2], *r[3:]) for r in found(spark, json.dumps(one))] == expected
    got = found(spark, many)
    assert {r[1] for r in got} == {1} and [(r[2], *r[3:]) for r in got] == expected
    assert {r[1] for r in found(spark, json.dumps({"anime": one}))} == {0}


@pytest.mark.parametrize("bad", [None, "", "  ", "[]", "7", "{", '{"animethemes":[{"id":1}', '{"animethemes":[{"id":1}]} x', '{"animethemes":[{"id":1}]},{}', '{"animethemes":[{"id":1}]}]', "<html>"])
def test_unusable_payloads_have_no_rows(spark, bad):
    assert found(spark, bad) == []


def test_odd_ids_and_repeated_keys(spark):
    p = '{"animethemes":[{"id":true},{"id":" 5 "},{"id":"1e3"},{"id":null},{"id":[1]},{"id":1,"id":2}]}'
    assert [r[6] for r in sorted(found(spark, p), key=lambda r: r[3])] == [-1, 5, -1, -1, -1, 2]


def test_repeated_records_count_and_empty_input(spark):
    p = json.dumps({"animethemes": [{"id": 1}]})
    assert len(found(spark, p, p)) == 2
    assert rows(nested.level_rows(spark.createDataFrame([], "record_id long, payload string"))) == []


def test_long_lists(spark):
    p = json.dumps({"animethemes": [{"id": i} for i in range(5000)]})
    assert len(found(spark, p)) == 5000


def test_flat_tables_link_to_their_parents(spark):
    p = json.dumps({"animethemes": [{"id": 1, "type": "OP", "sequence": 2, "song": {"id": 5, "title": "t"}, "animethemeentries": [{"version": 1, "videos": [{"nc": True, "resolution": "720", "audio": AUDIO}]}]}]})
    df = spark.createDataFrame([(1, p)], "record_id long, payload string")
    assert rows(nested.flat_table(df, "theme")) == [(1, 0, 0, 1, "OP", 2, None, 5, "t")]
    assert rows(nested.flat_table(df, "video")) == [(1, 0, 0, 0, 0, True, 720)]
    assert rows(nested.flat_table(df, "audio")) == [(1, 0, 0, 0, 0, 9, "l", "b", 3, "p")]
    with pytest.raises(ValueError):
        nested.flat_table(df, "page")


def video(nc, resolution, audio):
    return {"nc": nc, "resolution": resolution, "audio": audio and {"id": audio}}


def themes_of(spark, *anime):
    df = spark.createDataFrame([(i, json.dumps(a)) for i, a in enumerate(anime)], "record_id long, payload string")
    return catalogue.theme_rows(nested.typed_anime(df), ("record_id", "anime_pos"))


def test_best_audio_and_site_id(spark):
    site = [{"site": "Other", "external_id": 1}, {"site": catalogue.SITE, "external_id": None}, {"site": catalogue.SITE, "external_id": 77}]
    def theme(i, *videos):
        return {"id": i, "animethemeentries": [{"videos": list(videos)}]}
    a = {"slug": "s", "resources": site, "animethemes": [
        theme(1, video(False, 1080, 10), video(True, None, 11), video(True, None, 12)),  # creditless wins, first of equals
        theme(2, video(None, 720, None)),  # no audio
        theme(3, video(True, 1, 11)),  # a recording met before in this anime
        theme(4, video(None, None, 13)),
    ]}
    got = themes_of(spark, a, {"slug": "no id", "animethemes": [theme(9, video(True, 1, 1))]})
    assert rows(got, "theme_id", "mal_id", "audio_id", "source_video_nc") == [(1, 77, 11, True), (4, 77, 13, False)]


def test_keep_first(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, 2, "a"), (2, 9, "c")], "theme_id long, ingest_pos long, v string")
    assert rows(catalogue.keep_first(df, "theme_id", "ingest_pos"), "theme_id", "v") == [(1, "a"), (2, "c")]


def test_the_session_keeps_its_settings_and_tables_share_a_parse(spark):
    name = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name)
    df = spark.createDataFrame([(1, '{"animethemes": [{"id": 3, "id": 4, "animethemeentries": [{"videos": [{"nc": true, "audio": {"id": 9}}]}]}]}'), (2, "{")], "record_id long, payload string")
    one = {level: rows(nested.flat_table(df, level)) for level in nested.LEVELS}
    assert {level: rows(t) for level, t in nested.flat_tables(df).items()} == one and spark.conf.get(name) == before
    assert [len(t) for t in one.values()] == [1, 1, 1, 1] and one["theme"][0][3] == 4
