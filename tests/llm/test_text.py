import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sonoquarry.llm import bpe, pretokens, splitting

from ..conftest import rows

FOLDER = bpe.TOKENIZERS
ODD = ["don't 'S 's't  're", " a  b   \n\n c\td　e", "!!!'s ' s '", "​́é★♡ 漢字 123４５", "<|endoftext|> hi", "   ", "\n", "x \n", " \r\n y", "a" * 3000 + "ab" * 700, "👩‍👧 ½²Ⅷ", "'ll'll 'l l"]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def model():
    return bpe.held(f"{FOLDER}/{bpe.BYTE_BPE_50K}")


def texts(n, seed=0):
    rng = random.Random(seed)
    letters = " '  stremvld\n\t.,!?aAé漢1２　\xa0-<>&"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ids_equal_the_public_library(model, reference):
    held = texts(4000)
    batch, at, ids = model.encode_batch(pa.array(held))
    first = at[batch.doc_first]
    for k, e in enumerate(reference.encode_batch(held, add_special_tokens=False)):
        assert ids[first[k]:first[k + 1]].tolist() == e.ids, held[k]


def test_words_split_at_slices_and_offsets(model):
    held = pa.array(["no", None, "", "héllo  world", "x"] * 3)
    one = model.encode_batch(held)
    assert np.array_equal(one[2], model.encode_batch(pa.concat_arrays([held, held]).slice(15))[2])
    rows = pa.RecordBatch.from_arrays([held, held], names=["a", "b"])
    parts = list(pretokens.slices(rows, 1, limit=6))
    assert sum(map(len, parts)) == 15 and len(parts) > 3
    assert np.array_equal(one[2], np.concatenate([model.encode_batch(p.column(1))[2] for p in parts]))


def test_spark_round_trip(spark, reference):
    held = [(i, t, i) for i, t in enumerate([None, "", *texts(50, 3)])]
    df = spark.createDataFrame(held, "doc_id long, text string, ids int")
    encoded = bpe.encode(df)
    got = dict(rows(encoded))
    assert got[0] == [] and got[1] == []
    assert all(got[i] == reference.encode(t, add_special_tokens=False).ids for i, t, _ in held[2:])
    assert dict(rows(bpe.decode(encoded))) == {i: t or "" for i, t, _ in held}
    assert rows(bpe.encode(df.limit(0))) == []


def test_decode_refuses_foreign_ids(model):
    with pytest.raises(ValueError):
        model.decode_bytes(np.array([10 ** 6]))


def naive_merge(sizes, strength, limit, overlap):
    """Merge the weakest boundary that fits, by looking at all of them again each time."""
    runs = [[i] for i in range(len(sizes))]
    def total(r):
        return sum(sizes[i] for i in r)
    while True:
        best = None
        for k in range(len(runs) - 1):
            both = total(runs[k]) + total(runs[k + 1])
            if both + (0 if k == 0 else overlap) <= limit:
                key = (strength[runs[k + 1][0]], both, runs[k][0])
                if best is None or key < best[0]:
                    best = key, k
        if best is None:
            return [r[0] for r in runs]
        k = best[1]
        runs[k:k + 2] = [runs[k] + runs[k + 1]]


@pytest.mark.parametrize("seed", range(20))
def test_heap_equals_rescanning(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 40)
    sizes, strength = [rng.randint(1, 9) for _ in range(n)], [rng.randint(0, 4) for _ in range(n)]
    assert splitting.merge(sizes, strength, 20, 5, True)[0] == naive_merge(sizes, strength, 20, 5)


@pytest.mark.parametrize("limit, overlap", [(40, 8), (12, 0), (5, 4)])
def test_pieces_tile_and_overlap(spark, reference, limit, overlap):
    prose = "One two three, four five. Six seven!\n\nEight nine ten; eleven. " * 12
    held = [(0, None), (1, ""), (2, prose), (3, "z" * 900), (4, "漢字。" * 80), (5, "short"), (6, "<p>A b c.</p>" * 30), (7, " " * 500), (8, prose)]
    df = spark.createDataFrame(held, "doc_id long, text string")
    got = {}
    for r in splitting.split(df, limit=limit, overlap=overlap).orderBy("doc_id", "piece_no").collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, text in held:
        n = len(reference.encode(text or "", add_special_tokens=False).ids)
        own = got.get(i, [])
        assert bool(own) == bool(n)
        if not own:
            continue
        assert own[0].start_token == 0 and own[-1].end_token == n and [p.piece_no for p in own] == list(range(len(own)))
        assert all(0 < p.n_tokens <= limit and p.n_tokens == p.end_token - p.start_token for p in own)
        assert (len(own) > 1) == (n > limit)
        for a, b in zip(own, own[1:]):
            assert a.end_token - b.start_token == min(overlap, a.n_tokens) and b.end_token > a.end_token
    assert [tuple(p)[1:] for p in got[2]] == [tuple(p)[1:] for p in got[8]]
    assert splitting.split(df.limit(0), limit=limit, overlap=overlap).count() == 0
    again = splitting.rebuild(splitting.split(df, limit=limit, overlap=overlap, with_text=False, with_new=True))
    assert dict(rows(again)) == {i: t for i, t in held if t}


def test_cuts_prefer_strong_boundaries(spark):
    text = ("Alpha beta gamma delta. Epsilon zeta eta theta.\n\n" * 4).strip()
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    kinds = {r.boundary for r in splitting.split(df, limit=40, overlap=4).filter("piece_no > 0").collect()}
    assert kinds == {"paragraph"}


def test_refuses_an_overlap_that_leaves_no_room(spark):
    with pytest.raises(ValueError):
        splitting.split(spark.createDataFrame([], "doc_id long, text string"), limit=10, overlap=10)


def strengths_of(text):
    import pyarrow as pa

    b = pretokens.Batch(pa.array(["Some other text. And mo", text, None, text]))
    k = splitting.strengths(b)
    out = []
    for row in (1, 3):
        a, e = b.doc_first[row], b.doc_first[row + 1]
        out.append([("".join(map(chr, b.cp[b.starts[i]:b.starts[i + 1]])), splitting.NAMES[k[i]]) for i in range(a + 1, e)])
    assert out[0] == out[1]
    return [(p.strip(), n) for p, n in out[0] if n in ("clause", "sentence", "line", "paragraph")]


@pytest.mark.parametrize("text, expected", [
    ("Call x->y now. Then a=>b ok; see p>q and c <d> e", [("Then", "sentence"), ("see", "clause")]),
    ("Dr. Who met J. R. Smith at 9 p.m. in St. Ives. \"No.\" Yes! Mr. Vol. 3 vs. Ep. 4 U.S. Navy. End", [("in", "clause"), ("\"", "sentence"), ("Yes", "sentence"), ("Mr", "sentence"), ("Navy", "clause"), ("End", "sentence")]),
    ("<p>One <b>two</b> three</p><i>four</i> five<br/> six <span class=\"hl\">seven</span> eight", [("One", "line"), ("four", "line"), ("six", "line")]),
    ("if a <b and c> d then <div class='x'>e", [("e", "line")]),
    ("One two\nthree.\n\nFour", [("three", "line"), ("Four", "paragraph")]),
])
def test_strengths(text, expected):
    assert strengths_of(text) == [(a, b) for a, b in expected]


@pytest.mark.parametrize("seed", range(30))
def test_sentences_first_equals_merging_from_atoms(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 120)
    sizes = [rng.choice((1, 1, 2, 3, 30 if seed % 3 == 0 else 4)) for _ in range(n)]
    strength = [rng.choice((1, 2, 2, 2, 3, 4, 5, 6)) for _ in range(n)]
    at = np.concatenate([[0], np.cumsum(sizes)])
    limit, overlap = rng.choice(((20, 5), (12, 0), (25, 8)))
    offsets, marks, room = [], [], limit - overlap
    for i, size in enumerate(sizes):  # atoms: pre-tokens, tokens of those that are too large
        whole = size <= room
        offsets += [int(at[i])] if whole else list(range(int(at[i]), int(at[i + 1])))
        marks += [strength[i]] + ([] if whole else [0] * (size - 1))
    own = np.diff(offsets + [int(at[-1])]).tolist()
    atoms = [offsets[i] for i in splitting.merge(own, marks, limit, overlap, True)[0]] if at[-1] > limit else [0]
    assert splitting.cuts(at, np.array(strength), limit, overlap)[0] == atoms
