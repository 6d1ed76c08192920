import random

import numpy as np
import pytest

from sonoquarry.llm import folding, leaks

from ..conftest import rows

WORDS = ["".join(p) for p in ((a + b + c) for a in ("ka", "lo", "mi", "zu", "pe", "ra", "shi") for b in ("nor", "vel", "dra", "tsu", "gal", "wen") for c in ("to", "ri", "ma", "sen", "kyu"))]
ITEM = WORDS[3:200:7][:28]


def edit(words, where, kind):
    out = list(words)
    for w in sorted(where, reverse=True):
        if kind == "change":
            out[w] = "changed"
        elif kind == "drop":
            del out[w]
        else:
            out.insert(w, "added")
    return out


def brute(region, item, least=16):
    """Whether any span of the item and of the text are within one edit in eight words."""
    n, m = len(item), len(region)
    for i in range(n - least + 1):
        for j in range(m):
            old = list(range(min(n - i, 40) + 1))
            for y in range(j, min(m, j + 45)):
                new = [y - j + 1] + [0] * (len(old) - 1)
                for x in range(1, len(old)):
                    new[x] = min(old[x] + 1, new[x - 1] + 1, old[x - 1] + (item[i + x - 1] != region[y]))
                    if x >= least and 8 * new[x] <= x:
                        return True
                old = new
    return False


@pytest.mark.parametrize("seed", range(60))
def test_alignment_against_brute_force(seed):
    rng = random.Random(seed)
    item = [rng.randrange(9 if seed % 2 else 60) for _ in range(rng.randint(16, 34))]
    a = rng.randint(0, len(item) - 12)
    part = item[a:a + rng.randint(12, 30)]
    for _ in range(rng.randint(0, 4)):
        k = rng.randrange(len(part))
        part = edit(part, [k], rng.choice(["change", "drop", "add"])) if rng.random() < 0.9 else part
    part = [x if isinstance(x, int) else 1000 for x in part]
    region = [rng.randrange(60) for _ in range(rng.randint(0, 10))] + part + [rng.randrange(60) for _ in range(rng.randint(0, 10))]
    got = leaks.leaked(np.array([region]), np.array([item + [-3] * 4]))[0]
    assert bool(got) == brute(region, item)


def filler(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def find(spark, docs, items):
    d = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    e = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    return rows(leaks.find_leaks(d, e))


def test_whole_partial_and_disguised(spark):
    rng = random.Random(1)
    def doc(words):
        return " ".join(filler(rng, 50) + list(words) + filler(rng, 50))
    part = ITEM[5:21]
    bold = "".join(chr(0x1D41A + ord(c) - 97) if "a" <= c <= "z" else c for c in " ".join(part))
    look = " ".join(part).replace("a", "а").replace("o", "о")  # letters of another script
    leaking = [
        doc(ITEM), doc(part), doc(edit(part, [8], "change")), doc(edit(part, [4, 11], "drop")), doc(edit(part, [3, 9], "add")), doc(p.upper() for p in part), doc(p + "," for p in part),
        "<p>" + "</p><p>".join(part) + "</p>", doc([f"**{p}**" for p in part]), bold, look, doc([p[:2] + "​" + p[2:] for p in part]), doc([x for i, p in enumerate(part) for x in ([p, f"[{i}]"] if i % 3 == 0 else [p])]),
        " ".join(filler(rng, 4000) + ITEM + filler(rng, 4000)), doc(ITEM[-16:]), " ".join(ITEM[:16]),
    ]
    clean = [None, "", "   ", doc(ITEM[:13]), doc(edit(part, [2, 7, 12], "change")), doc(rng.sample(ITEM, len(ITEM))), doc(filler(rng, 60)), doc(ITEM[:8] + filler(rng, 10) + ITEM[8:16]), "漢字。" * 50]
    docs = list(enumerate(leaking + clean)) + [(0, leaking[0])]
    got = find(spark, docs, [(1, " ".join(ITEM)), (2, " ".join(filler(rng, 40))), (3, "too short"), (4, None), (5, " ".join(ITEM))])
    assert [d for d, i in got if i == 1] == sorted(range(len(leaking)), key=lambda d: repr((d, 1)))
    assert {i for _, i in got} == {1, 5}


def test_empty_sides(spark):
    assert find(spark, [], [(1, " ".join(ITEM))]) == []
    assert find(spark, [(1, " ".join(ITEM))], []) == []
    assert find(spark, [(1, " ".join(ITEM))], [(1, "few words")]) == []


def test_blocks_of_items_give_the_same(spark):
    rng = random.Random(2)
    items = [(i, " ".join(filler(rng, 30))) for i in range(7)]
    docs = [(i, " ".join(filler(rng, 20)) + " " + items[i % 7][1] + " " + " ".join(filler(rng, 20))) for i in range(12)]
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert rows(leaks.find_leaks(d, e, passages_at_once=5)) == rows(leaks.find_leaks(d, e, group_chars=300)) == rows(leaks.find_leaks(d, e)) == sorted(((i, i % 7) for i in range(12)), key=repr)


def test_randomised_svd(spark):
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 40, 24).tolist() for _ in range(80)]
    idf = rng.uniform(1, 3, 40).astype(np.float32)
    v = leaks.randomised_svd(spark.createDataFrame([(p,) for p in parts], "ids array<int>").repartition(3), idf, 12)
    a = leaks.weigh([np.array(p) for p in parts], idf)
    exact = np.linalg.svd(a, full_matrices=False)[1]
    assert v.shape == (40, 12) and np.allclose(v.T @ v, np.eye(12), atol=1e-4)
    assert np.linalg.norm(a @ v) ** 2 >= 0.97 * (exact[:12] ** 2).sum()


def test_folding():
    assert folding.fold_text("Ａﬁ’s É​x—Ω") == "afis ex ω" or folding.fold_text("Ａﬁ’s É​x—Ω").split()[0] == "afis"
    import pyarrow as pa

    w = folding.Words(pa.array(["<b>Bold</b> &amp; 3,573 it's", None, "[12] (3) x"]))
    words = [bytes(x).decode("utf-32-le") for x in w.coded.to_pylist()]
    assert words == ["bold", "3573", "its", "x"] and w.row_first.tolist() == [0, 3, 3, 4]


def folded(*texts):
    import pyarrow as pa

    w = folding.Words(pa.array(texts, pa.string()))
    words = [bytes(x).decode("utf-32-le") for x in w.coded.to_pylist()]
    return [words[a:b] for a, b in zip(w.row_first, w.row_first[1:])]


@pytest.mark.parametrize("text, words", [
    ('didn&#39;t <span class="hl">the</span> end', "didnt the end"),
    ("isn&apos;t isn&rsquo;t isn&#x2019;t isn&#8217;t isn&amp;#39;t", "isnt isnt isnt isnt isnt"),
    ('a&nbsp;b <span&nbsp;class="hl">c</span> &quot;d&quot; caf&eacute; &unknown; e', "a b c d cafe e"),
    ("<a href='x?y=1&amp;z=2' title=\"one > two\">f</a><br/>g<img alt=it's>h", "f g h"),
    ("&lt;span class=&quot;hl&quot;&gt;i&lt;/span&gt; j", "i j"),
    ("x < y and z > w, a <|end|> b", "x y and z w a end b"),
    ("x <y and what follows here is still a whole sentence with z> w", "x and what follows here is still a whole sentence with z w"),
    ("a [b](https://x.org/c-d_(e)?f=g \"h i\") ![j](k.png) [l](#m) n(o) [p] (q)", "a b l n o p q"),
    ("[b]a[/b] [url=http://x.y/z]b[/url] [[Target page|c]] [[d]] <!-- e --> f", "a b c d f"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ \u0420\u0435\u0445 \u04bb\u0456 \u0585\u0578 Ørsted \u0141\u00f3d\u017a ᴋᴀɴᴏʀ 🅱", "abezhikmnoptyx pex hi on orsted lodz kanor b"),
    ("Stra\u00dfe STRASSE tsop-\nonpefa some-\r\nthing 3-\n4 a - b well-known", "strasse strasse tsoponpefa something 3 4 a b well known"),
    ("<b>Q</b>&amp;A R&D AT&T; <b unclosed", "q a r d at unclosed"),
])
def test_markup_and_entities_are_no_words(text, words):
    assert folded("first", text, None, text) == [["first"], words.split(), [], words.split()]


def test_leaks_under_attributes_and_entities(spark):
    """The form of doc_id 10588 of the test data: tags with attributes and apostrophes as entities."""
    item = ("Past the brittle island a harmonica soared; Foluuva Chaheti didn't notice the puddles. Toward the sunken hallway a piano swayed; "
            "Sudrolbil Vahuudromu didn't notice the shadows. I've heard Tavirseifo Shigelouko turn hesitant choirs into a broadcast backwards.")
    doc = ("The storyboard puts a kitchen beyond 1990 credits, which Past&nbsp;the&nbsp;brittle island a harmonica soared; Foluuva Chaheti didn&#39;t notice "
           '<span class="hl">the</span> puddles. Toward the sunken hallway a piano swayed; Sudrolbil Vahuudromu <i>didn&#39;t</i> <b>notice</b> the '
           '<span class="hl">shadows.</span> I&#39;ve heard Tavirseifo Shigelouko turn <i>hesitant</i> choirs into a broadcast backwards."  Salt Jeiwoul colors instead.')
    rng = random.Random(3)
    part = ITEM[2:18]
    docs = [
        doc, " ".join(filler(rng, 30) + [f'<span class="hl" id=\'n{i}\'>{p[:1]}&rsquo;{p[1:]}</span>' for i, p in enumerate(part)] + filler(rng, 30)),
        " ".join(filler(rng, 30) + [f'<img src="x.png" alt="{" ".join(part)}">'] + filler(rng, 30)), " ".join(ITEM[2:10] + ['<span class="hl">'] + filler(rng, 8) + ["</span>"] + ITEM[10:18]),
    ]
    assert find(spark, list(enumerate(docs)), [(1, item), (2, " ".join(ITEM))]) == [(0, 1), (1, 2), (2, 2)]


def test_disguises_of_every_fourth_word(spark):
    rng = random.Random(5)
    part = ITEM[3:21]
    greek = str.maketrans("ABEHIKMNOPTXYZ", "ΑΒΕΗΙΚΜΝΟΡΤΧΥΖ")
    docs = [
        [f'<span class="hl">{p}</span>' if i % 4 == 0 else p for i, p in enumerate(part)], [f"[{p}](https://x.org/a/b-{i})" if i % 5 == 0 else p for i, p in enumerate(part)],
        [p.upper().translate(greek) for p in part], [f"[url=http://x.y/z]{p}[/url]" if i % 4 == 0 else p for i, p in enumerate(part)], [p[:2] + "-\n" + p[2:] if i % 3 == 0 else p for i, p in enumerate(part)],
    ]
    texts = [(i, " ".join(filler(rng, 30) + d + filler(rng, 30))) for i, d in enumerate(docs)]
    assert find(spark, texts, [(1, " ".join(ITEM))]) == [(i, 1) for i in range(len(docs))]


def test_long_items_are_searched_whole(spark):
    rng = random.Random(6)
    words = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(900)]
    docs = [(a, " ".join(filler(rng, 20) + words[a:a + 16] + filler(rng, 20))) for a in range(0, 884, 13)]
    assert find(spark, docs, [(1, " ".join(words))]) == sorted(((a, 1) for a, _ in docs), key=repr)
    assert all(any((p[i:i + 34] == np.arange(900)[a:a + 34]).all() for p in leaks.in_parts(np.arange(900)) for i in range(len(p) - 33)) for a in range(0, 866, 7))


def test_common_subsequence():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 6, (20, 15)), rng.integers(0, 6, (20, 12))
    for x, y, got in zip(a, b, leaks.common(a, b)):
        t = np.zeros((16, 13), int)
        for i in range(15):
            for j in range(12):
                t[i + 1, j + 1] = t[i, j] + 1 if x[i] == y[j] else max(t[i, j + 1], t[i + 1, j])
        assert got == t[-1, -1]


def test_paraphrases_need_the_answer(spark):
    rng = random.Random(7)
    item, answer = ITEM[:24], ["kanorto", "lovelri"]
    told = [p for i, p in enumerate(item) if i % 4 != 1]  # too much is changed for a passage
    told = [x for i, p in enumerate(told) for x in ([p, rng.choice(WORDS[:9])] if i % 6 == 0 else [p])]
    docs = [(1, item), (2, told[:9] + answer + told[9:]), (3, told), (4, told[:9] + answer[:1] + told[9:]), (5, answer)]
    d = spark.createDataFrame([(i, " ".join(filler(rng, 30) + w + filler(rng, 30))) for i, w in docs], "doc_id long, text string")
    e = spark.createDataFrame([(9, " ".join(item), " ".join(answer)), (8, " ".join(filler(rng, 30)), None)], "item_id long, text string, answer string")
    assert rows(leaks.find_leaks(d, e, item_answer="answer")) == [(1, 9, "passage"), (2, 9, "paraphrase")]
    assert rows(leaks.find_leaks(d, e)) == [(1, 9)]
