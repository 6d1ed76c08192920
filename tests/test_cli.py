import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sonoquarry import cli

from .test_retrieval import corpus, line

TITLES = ["Coda〜Death note", "R★O★C★K★S", "Tokyo Ghoul √A", "Chikatto Chika Chika♡"]


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cli") / "d")
    c = corpus(spark, line(14, 0.04), artists=[[i // 2] for i in range(14)])
    titles = F.array(*map(F.lit, TITLES))
    c.withColumn("title", F.element_at(titles, (F.col("theme_id") % 4 + 1).cast("int"))).write.parquet(path)
    return path


def test_recommend(spark, dataset, capsys):
    cli.main(["recommend", "--dataset", dataset, "--seed", "1", "--k", "3", "--whiten", "0", "--mode", "purist"], spark)
    out = capsys.readouterr().out.splitlines()
    assert len(out) == 3 and out[0].startswith(" 1") and any(t in out[0] for t in TITLES)
    with pytest.raises(SystemExit):
        cli.main(["recommend", "--dataset", dataset, "--seed", "99", "--whiten", "0"], spark)


def test_smoke(spark, dataset, capsys):
    assert cli.main(["recommend", "--dataset", dataset, "--smoke", "--whiten", "0"], spark) == 0
    assert capsys.readouterr().out.count("passed") == 3


def maps(tmp_path):
    names = {f"artist{i}": {"query": f"artist{i}", "mbid": f"m{i}", "mb_name": "x"} for i in range(7)} | {"nobody": None}
    near = {f"m{i}": [{"mbid": f"m{(i + 1) % 7}", "name": "y", "score": 5}, {"mbid": None, "score": 9}] for i in range(7)} | {"m9": None}
    for n, v in (("a.json", names), ("s.json", near)):
        (tmp_path / n).write_text(json.dumps(v, indent=1))
    return ["--artist-map", str(tmp_path / "none.json"), "--artist-map", str(tmp_path / "a.json"), "--similar-map", str(tmp_path / "s.json")]


def test_evaluate_compare_and_save(spark, dataset, capsys, tmp_path):
    ids, out = str(tmp_path / "ids"), str(tmp_path / "run.json")
    cli.main(["evaluate", "--dataset", dataset, "--whiten", "0", "--compare-to", dataset, "--dump-ids", ids, "--json", out, "--label", "one", "--control-k", "5", *maps(tmp_path)], spark)
    shown = capsys.readouterr().out
    with open(out, encoding="utf-8") as f:
        run = json.load(f)
    assert {m["name"] for m in run["artist"]} >= {"artist_mrr", "artist_recall@10", "artist_first_rank"} and {m["name"] for m in run["behavioural"]} == {"related_mrr", *(f"related_recall@{k}" for k in (1, 5, 10, 20))}
    assert {m["name"] for m in run["controls"]} == {"genre_precision@5", "genre_jaccard@5", "era_precision@5"}
    meta = run["meta"]
    assert meta["label"] == "one" and meta["themes"] == 14 and len(meta["corpus_sha256"]) == 16 and meta["embed_dim"] == 8 and meta["exclude_same_anime"] is True
    assert set(meta["paired"]) == {"artist", "behavioural"} and all(c["delta"] == 0 and not c["significant"] and c["mrr"] == c["mrr_baseline"] for c in meta["paired"].values())
    assert len(run["artist_ranks"]) == run["artist"][0]["n_seeds"] == 14 and len(run["behavioural_ranks"]) == run["behavioural"][0]["n_seeds"]
    assert "artist agreement" in shown and "behavioural agreement" in shown and "not significant" in shown and "opposite" not in shown
    assert spark.read.text(ids).count() == 14


def test_evaluate_without_maps_and_with_siblings(spark, dataset, capsys, tmp_path):
    out = str(tmp_path / "run.json")
    cli.main(["evaluate", "--dataset", dataset, "--whiten", "4", "--include-same-anime", "--json", out], spark)
    with open(out, encoding="utf-8") as f:
        run = json.load(f)
    assert run["behavioural"] == [] and run["behavioural_ranks"] == [] and run["meta"]["exclude_same_anime"] is False and run["meta"]["embed_dim"] == 4
    assert "behavioural agreement" not in capsys.readouterr().out


def test_sweep(spark, dataset, capsys, tmp_path):
    d = spark.read.parquet(dataset)
    d.write.parquet(str(tmp_path / "layer12.parquet"))
    turned = F.transform(F.col("embedding"), lambda x, i: F.when(i < 2, x).otherwise(F.sin(F.col("theme_id") * (i + 1)).cast("float")))
    d.withColumn("embedding", turned).write.parquet(str(tmp_path / "layer06.parquet"))
    cli.main(["sweep", "--dir", str(tmp_path), "--whiten", "0", *maps(tmp_path)], spark)
    out = capsys.readouterr().out
    assert "layer06" in out and "reference" in out and "selected" in out and ("winner" in out or "families could be scored" in out)
    cli.main(["sweep", "--dir", str(tmp_path), "--whiten", "0", "--reference", "layer06", "--family", "artist"], spark)
    assert "behavioural" not in capsys.readouterr().out


def test_pipeline_arguments(spark):
    for bad in (["pipeline", "mastering", "--root", "x"], ["pipeline", "themes", "--root", "x", "--top-n", "1", "--limit-pages", "1"], ["pipeline", "--top-by", "fame", "--root", "x"], ["recommend", "--dataset", "x"]):
        with pytest.raises(SystemExit):
            cli.main(bad, spark)


def test_entry_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
