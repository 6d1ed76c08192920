"""Command line: recommend and evaluate over a dataset, sweep variants, run the pipeline's stages."""

from __future__ import annotations

import argparse
import dataclasses
import io
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions import scores
from .operators import evaluate, recommend, whitening
from .plans import pipeline, report
from .session import cut
from .sources import store


def _any_script(name: str) -> None:
    """Let a standard stream print titles in any script, whatever the console's encoding."""
    held = getattr(sys, name)
    if isinstance(held, io.TextIOWrapper):
        held.reconfigure(encoding="utf-8", errors="replace")


def load(spark: SparkSession, path: str, cfg: Config, strict: bool = True) -> DataFrame:
    """A checked dataset with unit vectors, whitened as configured. Older names of the year and sequence columns are accepted."""
    d = spark.read.parquet(path)
    for old, new in (("year", "start_year"), ("sequence", "theme_sequence")):
        if old in d.columns and new not in d.columns:
            d = d.withColumnRenamed(old, new)
    recommend.check(d, cfg, strict)
    fitted = whitening.fit(d, "embedding", cfg.whiten_components, cfg.whiten_alpha, cfg.whiten_eps)
    return cut(recommend.prepare(whitening.apply(d, "embedding", fitted), "whitened").drop("embedding", "whitened"))


def _recommend(spark: SparkSession, a: argparse.Namespace, cfg: Config) -> int:
    d = load(spark, a.dataset, cfg, not a.any_version)
    if a.smoke:
        checks = recommend.smoke(d, cfg)
        for name, good in checks.items():
            print(f"{name}: {'passed' if good else 'FAILED'}")
        return 0 if all(checks.values()) else 1
    seed = d.filter(F.col("theme_id") == a.seed)
    if seed.isEmpty():
        raise SystemExit(f"no theme {a.seed} among the dataset's {d.count()}")
    found = recommend.recommend(d, cfg, mode=a.mode, k=a.k, seeds=seed, exclude_same_anime=a.exclude_same_anime, dedup_audio=not a.no_dedup, max_per_anime=a.max_per_anime)
    for r in recommend.console(recommend.present(found, d)).orderBy("rank").collect():
        print(r.line)
    return 0


def _maps(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame | None, DataFrame | None]:
    return tuple(store.read_map(spark, *paths) if paths else None for paths in (a.artist_map, a.similar_map))


def _evaluate(spark: SparkSession, a: argparse.Namespace, cfg: Config) -> int:
    maps = _maps(spark, a)
    d = load(spark, a.dataset, cfg, not a.any_version)
    how = dict(mode=a.mode, exclude_same_anime=not a.include_same_anime, control_k=a.control_k)
    record, table = report.run(report.with_behaviour(d, *maps), cfg, label=a.label, dataset=a.dataset, **how)
    if a.compare_to:  # the other dataset is the baseline
        other = report.with_behaviour(load(spark, a.compare_to, cfg, not a.any_version), *maps)
        record["meta"] |= {"compared_to": a.compare_to, "paired": report.compare(cut(evaluate.seed_table(other, cfg, **how)), table)}
    print(report.text(record))
    if a.dump_ids:
        store.write_ids(d, "theme_id", a.dump_ids)
    if a.json:
        report.save(spark, record, a.json)
    return 0


def _sweep(spark: SparkSession, a: argparse.Namespace, cfg: Config) -> int:
    maps = _maps(spark, a)
    vectors = store.read_variants(spark, a.dir)
    names = [r.variant for r in vectors.select("variant").distinct().orderBy("variant").collect()]
    if not names:
        raise SystemExit(f"{a.dir} holds no variants")
    families = evaluate.FAMILIES if a.family == "both" else (a.family,)
    made = {n: report.with_behaviour(load(spark, f"{a.dir}/{n}.parquet", cfg, False), *maps) for n in names}
    print(report.sweep_text(report.sweep(made, cfg, a.reference, mode=a.mode, families=families)))
    return 0


def _pipeline(spark: SparkSession, a: argparse.Namespace, cfg: Config) -> int:
    services = pipeline.Services(base=a.base, metadata_base=a.metadata_base)
    print(pipeline.run_stage(spark, a.stage, pipeline.Paths(a.root, a.pages), cfg, services, top_n=a.top_n, top_by=a.top_by, limit_pages=a.limit_pages, force=a.force_reembed))
    return 0


def parser(cfg: Config) -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sonoquarry")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("recommend")
    what = r.add_mutually_exclusive_group(required=True)
    what.add_argument("--seed", type=int)
    what.add_argument("--smoke", action="store_true", help="check the wiring on a seed of the dataset")
    r.add_argument("--k", type=int, default=cfg.recommend_k)
    r.add_argument("--exclude-same-anime", action="store_true")
    r.add_argument("--no-dedup", action="store_true")
    r.add_argument("--max-per-anime", type=int, default=cfg.max_per_anime, help="0: no cap")
    e = sub.add_parser("evaluate")
    e.add_argument("--compare-to")
    e.add_argument("--dump-ids")
    e.add_argument("--control-k", type=int, default=10)
    e.add_argument("--include-same-anime", action="store_true")
    e.add_argument("--label", default="current")
    e.add_argument("--json")
    w = sub.add_parser("sweep")
    w.add_argument("--dir", required=True)
    w.add_argument("--reference", default="layer12")
    w.add_argument("--family", choices=[*evaluate.FAMILIES, "both"], default="both")
    for q, mode in ((r, cfg.recommend_mode), (e, "purist"), (w, "purist")):
        if q is not w:
            q.add_argument("--dataset", required=True)
            q.add_argument("--any-version", action="store_true")
        if q is not r:
            q.add_argument("--artist-map", action="append", help="JSON map of artist names; given several times, the first that is there counts")
            q.add_argument("--similar-map", action="append", help="JSON map of similar artists")
        q.add_argument("--mode", choices=list(scores.MODES), default=mode)
        q.add_argument("--whiten", type=int, default=cfg.whiten_components)
    s = sub.add_parser("pipeline")
    s.add_argument("stage", choices=[*pipeline.STAGES, pipeline.ALL], nargs="?", default=pipeline.ALL)
    s.add_argument("--root", required=True)
    s.add_argument("--pages")
    s.add_argument("--base", default="")
    s.add_argument("--metadata-base", default="")
    s.add_argument("--force-reembed", action="store_true")
    s.add_argument("--keep-audio", action="store_true", default=cfg.keep_audio)
    s.add_argument("--top-by", choices=["popularity", "score"], default="popularity")
    only = s.add_mutually_exclusive_group()
    only.add_argument("--top-n", type=int)
    only.add_argument("--limit-pages", type=int)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    for name in ("stdout", "stderr"):
        _any_script(name)
    cfg = Config.from_env()
    a = parser(cfg).parse_args(argv)
    cfg = dataclasses.replace(cfg, keep_audio=a.keep_audio) if a.command == "pipeline" else dataclasses.replace(cfg, whiten_components=a.whiten)
    spark = spark or SparkSession.builder.appName("sonoquarry").getOrCreate()
    return {"recommend": _recommend, "evaluate": _evaluate, "sweep": _sweep, "pipeline": _pipeline}[a.command](spark, a, cfg)


if __name__ == "__main__":
    sys.exit(main())
