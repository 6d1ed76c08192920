import pytest

from sonoquarry.llm import names

from ..conftest import rows

KNOWN = [("m1", "Alvareth Nimodor"), ("m2", "Sutabei Korrinfal"), ("m3", "The Copper Lanterns"), ("m4", "The Velvet Harbor Ensemble"), ("m5", "Alvareth Petrunko"), ("m6", "Alwareth Petrunko")]


def linked(spark, *texts, nicks=(("Alvy", "Alvareth"),), known=KNOWN, weights=None):
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    k = spark.createDataFrame([(m, n, float((weights or {}).get(m, 1))) for m, n in known], "mbid string, name string, weight double")
    n = spark.createDataFrame(list(nicks), "nick string, given_name string")
    got = {}
    for text, mbid in rows(names.link(t, k, n)):
        got.setdefault(text, set()).add(mbid)
    return got


def test_variants(spark):
    cases = {
        "Nimodor Alvareth": {"m1"}, "NIMODOR, Alvareth": {"m1"}, "alvarethnimodor": {"m1"}, "Alvarteh Nimodr": {"m1"}, "Ａｌｖａｒｅｔｈ Ｎｉｍｏｄｏｒ": {"m1"}, "Álvàreth Nimödor": {"m1"},
        "A1vareth N1modor": {"m1"}, "Alvy Nimodor": {"m1"}, "\"Alvy\" Nimodor": {"m1"}, "A. Nimodor": {"m1"}, "Nimodor A.": {"m1"}, "Alvar. Nimodor": {"m1"}, "Alvareth・Nimodor": {"m1"},
        "Hero (CV: Alvareth Nimodor)": {"m1"}, "Alvareth Nimodor as Hero": {"m1"}, "DJ Alvareth Nimodor": {"m1"}, "Alvareth Nimodor-san": {"m1"}, "vo. Alvareth Nimodor [Hero]": {"m1"},
        "Copper Lanterns": {"m3"}, "Lanterns, Copper, The": {"m3"}, "Copper Lantern (band)": {"m3"}, "T.C.L.": {"m3"}, "VHE": {"m4"}, "Ensemble: Velvet Harbor": {"m4"}, "The Velvet Harbor Ens.": {"m4"},
        "Alvareth Nimodor & The Copper Lanterns": {"m1", "m3"}, "Sutabei Korrinfal feat. Alvy Nimodor": {"m1", "m2"}, "Sutabei Korinfar": {"m2"},
    }
    assert linked(spark, *cases) == cases


def test_others_are_not_linked(spark):
    others = [None, "", "   ", "-", "N/A", "TBA", "???", "Alvareth Korrinfal", "Sutabei Nimodor", "A.", "Nimodor", "The Copper Harbors", "Velvet Harbor", "漢字", "a" * 5000, "x " * 3000]
    assert linked(spark, *others) == {}


def test_equal_candidates_go_by_weight(spark):
    assert linked(spark, "A. Petrunko") == {}
    assert linked(spark, "A. Petrunko", weights={"m5": 9}) == {"A. Petrunko": {"m5"}}
    assert linked(spark, "alvareth petrunko", "alwareth petrunko") == {"alvareth petrunko": {"m5"}, "alwareth petrunko": {"m6"}}


def test_empty_sides(spark):
    assert linked(spark) == {}
    assert linked(spark, "Alvareth Nimodor", known=[]) == {}
    with pytest.raises(ValueError):
        names.link(spark.createDataFrame([], "text string"), spark.createDataFrame([], "mbid string, name string, weight double"), spark.createDataFrame([("a", "b")], "nick string, given_name string"), most_nicknames=0)


def test_credits(spark):
    credits = spark.createDataFrame([(1, ["Alvareth Nimodor", "nimodor alvareth", None, ""]), (2, None), (3, []), (1, ["nimodor alvareth"])], "ingest_pos long, artist_names array<string>")
    artists = spark.createDataFrame([(7, "Alvareth Nimodor", "m1", "Alvareth Nimodor"), (8, "A. Nimodor", None, None), (9, "Alvy Nimodor", "m1", "Alvareth Nimodor"), (10, None, None, None)], "mb_row long, query string, mbid string, mb_name string")
    nicks = spark.createDataFrame([], "nick string, given_name string")
    assert rows(names.link_credits(credits, artists, nicks)) == [("animethemes", 1, 0, "m1"), ("animethemes", 1, 1, "m1"), ("mb_artists", 8, 0, "m1")]


def test_letters_of_all_scripts(spark):
    assert names.mentions("宇多田ヒカル") == ["宇多田ヒカル"] and names.mentions("Кино") == ["кино"] and names.mentions("が") == ["が"]
    assert names.words_of("Ørsted Lønn, Łukasz Żal; Straße Æsir") == ["orsted", "lonn", "lukasz", "zal", "strasse", "aesir"]
    known = [("a", "宇多田ヒカル"), ("b", "Виктор Цой"), ("c", "Łukasz Żal"), ("d", "Ørsted Straße")]
    assert linked(spark, "宇多田 ヒカル", "Цой Виктор", "Lukasz Zal", "Strasse Orsted", known=known) == {"宇多田 ヒカル": {"a"}, "Цой Виктор": {"b"}, "Lukasz Zal": {"c"}, "Strasse Orsted": {"d"}}


def test_best_assignment_of_any_number_of_words(spark):
    known = [("m1", "John James Paul"), ("m2", "John James Paul George"), ("m3", "Amber Bella Clara Doris Elena Fiona")]
    assert linked(spark, "J. John Paul", "J. John Paul George", "Elena F. Doris C. Bella Amber", "ambrebellaclaradoriselenafiona", nicks=(), known=known) == {
        "J. John Paul": {"m1"}, "J. John Paul George": {"m2"}, "Elena F. Doris C. Bella Amber": {"m3"}, "ambrebellaclaradoriselenafiona": {"m3"}}
    import itertools
    import random

    rng = random.Random(0)
    for n in (2, 3, 4, 5):
        for _ in range(20):
            t = [[rng.choice((-9.0, 0.6, 0.8, 1.0, rng.random())) for _ in range(n)] for _ in range(n)]
            assert sum(t[i][j] for i, j in enumerate(names.assign(t))) == pytest.approx(max(sum(t[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(n))))


def test_variants_of_an_unknown_name_go_to_its_own_star(spark):
    texts = [("Alvorotha Nimodor", 9.0), ("Alvorota Nimodor", 1.0), ("Alvareth Nimodorr", 1.0), ("Alvoroth Nimodor", 1.0)]  # the last is close to both
    t = spark.createDataFrame(texts, "text string, n double")
    k = spark.createDataFrame([("m1", "Alvareth Nimodor", 1.0)], "mbid string, name string, weight double")
    got = rows(names.link(t, k, spark.createDataFrame([], "nick string, given_name string")))
    assert got == [("Alvareth Nimodorr", "m1")]


def test_star_cover(spark):
    # a path of growing weights 1 - 2 - 3 - 4 - 5: centres 5 and 3 and 1
    e = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.9), (3, 4, 0.9), (4, 5, 0.9), (7, 9, 0.8), (8, 9, 0.8), (7, 8, 0.8)], "member long, centre long, s double")
    assert rows(names.star_cover(e), "member", "centre") == [(2, 3), (4, 5), (7, 9), (8, 9)]
    assert rows(names.star_cover(e.limit(0))) == []


def test_bands_follow_the_collision_curve():
    bands, n = names.bands_for(0.45, 0.97)
    assert 1 - (1 - 0.45 ** n) ** bands >= 0.97
    hashing = names.MinHash(bands, n)
    words = ["alvareth", "nimodor"]
    made = hashing.keys([words, words[::-1], ["other"]])
    assert made.shape == (3, bands) and (made[0] == made[1]).all() and not (made[0] == made[2]).any() and len(hashing.keys([])) == 0
    import random

    rng = random.Random(0)
    met = 0
    for _ in range(200):
        a = ["".join(rng.choice("aeioukrstn") for _ in range(8)) for _ in range(2)]
        b = [a[0][:3] + "x" + a[0][4:], a[1]]
        met += bool(set(hashing.keys([a])[0]) & set(hashing.keys([b])[0]))
    assert met >= 198
    with pytest.raises(ValueError):
        names.bands_for(1.5, 0.9)
    with pytest.raises(ValueError):
        names.bands_for(0.02, 0.97)  # 64 bands aren't enough


def test_edits():
    pairs = [("abc", "abc"), ("abc", "acb"), ("abc", "abx"), ("abcd", "axyd"), ("a", "abcd"), ("", "ab"), ("ab", "")]
    assert names.edits([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [0, 1, 1, 2, 3, 2, 2]
    assert names.edits([], []).tolist() == []


def test_every_mention_of_a_band_can_be_a_centre(spark, monkeypatch):
    """Not only a band's heaviest, which may be like none of the others."""
    monkeypatch.setattr(names, "bands_for", lambda similarity, recall: (2, 1))
    hashing = names.MinHash(2, 1)
    known, star, member, heavy = "Alvareth Nimodor", "Alvorotha Nimodor", "Alvoroth Nimodor", "Alvorotha Nimodor Pell"
    at = dict(zip((known, star, member, heavy), hashing.keys([names.words_of(x) for x in (known, star, member, heavy)]).tolist()))
    assert at[known][1] == at[member][1] and at[star][0] == at[member][0] == at[heavy][0] and at[star][1] != at[member][1]
    t = spark.createDataFrame([(heavy, 99.0), (star, 9.0), (member, 1.0), ("Alvareth Nimodorr", 1.0), ("Alvorota Nimodor", 1.0)], "text string, n double")
    k = spark.createDataFrame([("m1", known, 1.0)], "mbid string, name string, weight double")
    assert rows(names.link(t, k, spark.createDataFrame([], "nick string, given_name string"))) == [("Alvareth Nimodorr", "m1")]
