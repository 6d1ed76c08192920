"""Evaluation runs as a whole: their meta data, metrics of both families and controls, comparisons, as records and as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..errors import DataError
from ..functions import vectors
from ..operators import artists, evaluate
from ..session import cut
from ..sources import store

_TITLES = {
    "artist": "artist agreement: relevant are themes of other anime that share an artist",
    "behavioural": "behavioural agreement: relevant are themes by other artists whom listeners put near",
    "controls": "controls (random is near the ceiling here: to be watched, not to be raised)",
}


def with_behaviour(catalogue: DataFrame, artist_map: DataFrame | None, similar_map: DataFrame | None) -> DataFrame:
    """The catalogue with the artists' ids and neighbours, if both maps (``value``: JSON text) are there."""
    if artist_map is None or similar_map is None:
        return catalogue
    return evaluate.with_mbids(catalogue, artists.artist_map(artist_map), artists.neighbours(artists.similar_map(similar_map)))


def run(catalogue: DataFrame, cfg: Config, *, label: str = "current", dataset: str = "", mode: str = "purist", exclude_same_anime: bool = True, control_k: int = 10) -> tuple[dict, DataFrame]:
    """A run's record (``meta``, ``artist``, ``controls``, ``behavioural``, ranks) and its seed table. ``catalogue``: prepared rows with ``embed_model`` and ``embed_version``."""
    table = cut(evaluate.seed_table(catalogue, cfg, mode=mode, exclude_same_anime=exclude_same_anime, control_k=control_k))
    values = cut(evaluate.per_seed(table, control_k))
    metrics = evaluate.metrics(values).join(evaluate.intervals(values), "name").collect()
    first = catalogue.select("embed_model", "embed_version", F.size("u").alias("dim")).first()
    size = catalogue.agg(F.count(F.lit(1)).alias("themes"), F.countDistinct("mal_id").alias("anime")).first()
    record = {"meta": {
        "label": label, "dataset": dataset, "themes": size.themes, "anime": size.anime, "corpus_sha256": evaluate.fingerprint(catalogue).first()[0], "embed_model": first.embed_model,
        "embed_version": first.embed_version, "embed_dim": first.dim, "mode": mode, "exclude_same_anime": exclude_same_anime, "mean_offdiag_cosine": vectors.mean_offdiagonal_cosine(catalogue, "u").first()["mean_cosine"],
    }}

    def place(name: str) -> tuple:
        family, _, k = name.partition("@")
        return {"artist_recall": 0, "related_recall": 0, "artist_mrr": 1, "related_mrr": 1, "artist_first_rank": 2}.get(family, 3), int(k or 0), name

    rows = sorted((r.asDict() for r in metrics), key=lambda r: place(r["name"]))
    for part, start in (("artist", "artist_"), ("behavioural", "related_"), ("controls", ("genre_", "era_"))):
        record[part] = [r for r in rows if r["name"].startswith(start)]
    for family in evaluate.FAMILIES:
        scored = evaluate.family_scores(table, family)
        m = evaluate.median_first_rank(scored).first()
        record["meta"] |= {f"{family}_median_rank": m.median_rank, f"{family}_median_pool": m.median_pool}
        record[f"{family}_ranks"] = [r["rank"] for r in scored.orderBy("seed").select("rank").collect()]  # a number a seed, as the record lists them
    return record, table


def _difference(diffs: DataFrame) -> dict:
    """Summary of paired differences, their interval and whether it excludes 0."""
    interval = evaluate.paired_interval(diffs).drop("name").withColumn("significant", evaluate.significant(F.col("ci_low"), F.col("ci_high")))
    return evaluate.paired_summary(diffs).first().asDict() | interval.first().asDict()


def compare(baseline: DataFrame, table: DataFrame) -> dict[str, dict]:
    """Paired differences of reciprocal ranks by family, with their intervals; families without shared seeds are left out."""
    out = {}
    for family in evaluate.FAMILIES:
        a, b = evaluate.family_scores(baseline, family), evaluate.family_scores(table, family)
        try:
            diffs = cut(evaluate.paired(a, b))
        except DataError:
            continue
        if diffs.isEmpty():
            continue
        out[family] = _difference(diffs)
    return out


def _lines(part: str, rows: list[dict]) -> list[str]:
    out = ["", _TITLES[part] + (f", {rows[0]['n_seeds']} seeds" if rows else ", no seeds")]
    for r in rows:
        lift = None if r["lift"] is None else 1 / r["lift"] if r["name"].endswith("first_rank") and r["lift"] else r["lift"]  # a lower rank is better
        digits = 1 if r["name"].endswith("first_rank") else 3
        out.append(f"  {r['name']:<20} {r['value']:>8.{digits}f}  [{r['ci_low']:.{digits}f}, {r['ci_high']:.{digits}f}]  random {r['baseline']:.{digits}f}  lift " + ("-" if lift is None else f"{lift:.2f}"))
    return out


def text(record: dict) -> str:
    """A run's record for people."""
    meta = record["meta"]
    out = [f"{k}: {v}" for k, v in meta.items() if k != "paired" and v is not None]
    for part in ("artist", "behavioural", "controls"):
        if record[part] or part != "behavioural":
            out += _lines(part, record[part])
    for family, c in meta.get("paired", {}).items():
        out += ["", f"{family} against the baseline over {c['n_seeds']} shared seeds: MRR {c['mrr_baseline']:.4f} to {c['mrr']:.4f}, {c['delta']:+.4f} [{c['ci_low']:+.4f}, {c['ci_high']:+.4f}], "
                + ("significant" if c["significant"] else "not significant") + f"; {c['better']} seeds better, {c['worse']} worse"]
    if evaluate.signs_differ({f: c["delta"] for f, c in meta.get("paired", {}).items()}):
        out += ["", "The families' differences have opposite signs: what this change is for decides which of them counts."]
    return "\n".join(out)


def sweep(catalogues: dict[str, DataFrame], cfg: Config, reference: str, *, mode: str = "purist", families: tuple[str, ...] = evaluate.FAMILIES) -> dict[str, dict]:
    """Each family's table of variants, the selected one and its paired test over the held-out half."""
    tables = {name: cut(evaluate.seed_table(c, cfg, mode=mode)) for name, c in sorted(catalogues.items())}
    groups = None
    for c in catalogues.values():
        own = c.select(F.col("theme_id").alias("seed"), "mal_id")
        groups = own if groups is None else groups.unionByName(own)
    out: dict[str, dict] = {}
    for family in families:
        ranks = None
        for name, t in tables.items():
            own = evaluate.family_scores(t, family).select(F.lit(name).alias("variant"), "seed", "rank")
            ranks = own if ranks is None else ranks.unionByName(own)
        try:
            table = cut(evaluate.sweep(ranks, groups, reference))
        except DataError as e:
            out[family] = {"error": str(e), "selected": None}
            continue
        rows = [r.asDict() for r in table.orderBy("variant").collect()]
        found = {"variants": rows, "selected": next(r["variant"] for r in rows if r["selected"])}
        diffs = evaluate.holdout(ranks, groups, table)
        if diffs is not None and not diffs.isEmpty():
            found["holdout"] = _difference(diffs)
        out[family] = found
    return out


def sweep_text(found: dict[str, dict]) -> str:
    out = []
    for family, f in found.items():
        out += [f"{family}: " + (f["error"] if "error" in f else f"{f['variants'][0]['n_shared']} seeds that all variants share")]
        for r in f.get("variants", ()):
            mark = " selected" * bool(r["selected"]) + " reference" * bool(r["is_reference"])
            out.append(f"  {r['variant']:<12} tune {r['tune_mrr'] or 0:.4f}  hold-out {r['holdout_mrr'] or 0:.4f}{mark}")
        h = f.get("holdout")
        if h:
            out.append(f"  hold-out over {h['n_seeds']} seeds: {h['delta']:+.4f} [{h['ci_low']:+.4f}, {h['ci_high']:+.4f}], " + ("significant" if h["significant"] else "not significant: the reference stays"))
    if len(found) > 1:
        out.append(evaluate.agreement({family: f["selected"] for family, f in found.items()}))
    return "\n".join(out)


def save(spark, record: dict, path: str) -> None:
    """The record as one JSON file."""
    import json

    store.write_text(spark, path, json.dumps(record, ensure_ascii=False, indent=1))
