"""Recommendations for every seed: cosine blended with metadata, de-duplicated, capped, ranked.

Order of steps: drop the seed (and its siblings on request), keep the best row per recording, keep
the first ``max_per_anime`` per anime, keep the first ``k``, number them. A task keeps the first ``k`` of its seeds over the blocks of
candidates read so far, and the best row of each recording that is spread over several blocks, which takes no other's place
before it is known to be the best of all. Equal scores order by theme_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..errors import NothingToDo, StaleEmbeddings
from ..functions import scores, vectors
from . import pairs, ranking

def prepare(dataset: DataFrame, vector: str = "embedding") -> DataFrame:
    """The catalogue with unit vectors ``u``; rows whose vector can't be used are refused by ``vectors.check_vectors``."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    return dataset.withColumn("_v", v).withColumn("u", vectors.unit(F.col("_v"), vectors.norm(F.col("_v")))).drop("_v")


def check(dataset: DataFrame, cfg: Config, strict: bool = True, vector: str = "embedding") -> None:
    """The eager guards: rows, one model and version (if ``strict``), whole vectors, unique themes."""
    if dataset.isEmpty():
        raise NothingToDo("the dataset is empty")
    if strict:
        bad = dataset.filter(~(F.col("embed_model").eqNullSafe(cfg.embed_model) & F.col("embed_version").eqNullSafe(cfg.embed_version)))
        named = [tuple(r) for r in bad.select("embed_model", "embed_version").distinct().limit(5).collect()]
        if named:
            raise StaleEmbeddings(f"vectors of another model or version: {named}; expected {(cfg.embed_model, cfg.embed_version)}")
    vectors.check_vectors(dataset, "theme_id", vector)


def recommend(
    catalogue: DataFrame, cfg: Config | None = None, *, mode: str = "discovery", k: int = 20, seeds: DataFrame | None = None,
    exclude_same_anime: bool = False, dedup_audio: bool = True, max_per_anime: int | None = None,
) -> DataFrame:
    """``seed, rank, theme_id, l1_cos, l2_weight, final`` for every seed (``prepare``d rows; all of them if ``seeds`` is None)."""
    cfg = cfg or Config()
    scale = scores.mode_scale(mode)
    cap = max_per_anime if max_per_anime and max_per_anime > 0 else None

    def each(asking: pa.Table, blocks: Callable[[], Iterator[pa.Table]]) -> Iterator[pd.DataFrame]:
        a = ranking.Rows(asking, seeds=True)
        first = ranking.First(a.n, k, dedup_audio, cap, ranking.margin(a.u32.shape[1], cfg, scale))
        for block in blocks():
            for s in ranking.Cell(a, ranking.Rows(block, seeds=False), cfg, scale, exclude_same_anime).slices():
                first.search(s)
        for f in first.results():
            yield pd.DataFrame({"seed": a.theme[f["row"]], "rank": (f["place"] + 1).astype(np.int32), "theme_id": f["theme"], "l1_cos": f["cosine"], "l2_weight": f["weight"], "final": f["raw"]})

    return pairs.lines(catalogue, seeds, each, "seed long, rank int, theme_id long, l1_cos double, l2_weight double, final double")


def present(found: DataFrame, dataset: DataFrame) -> DataFrame:
    """Recommendations with the columns that are shown."""
    shown = dataset.select(
        "theme_id", "mal_id", "audio_id", "title", scores.theme_label(F.col("theme_type"), F.col("theme_sequence")).alias("theme_label"), "song_title",
        scores.artist_text(F.col("artist_names")).alias("artist_names"), F.col("start_year").cast("int").alias("year"), F.col("score").alias("anime_score"),
    )
    return found.join(shown, "theme_id").select(
        "seed", "rank", "theme_id", "mal_id", "audio_id", "title", "theme_label", "song_title", "artist_names", "year", "anime_score", "l1_cos", "l2_weight", "final",
    )


def console(presented: DataFrame) -> DataFrame:
    """Lines for a terminal: shortened titles, scores with sign."""
    line = F.format_string(
        "%2d  %s  %s  %s  %s  %s  cos %+.3f  w %+.3f  final %+.3f", F.col("rank"), F.substring(F.coalesce("title", F.lit("")), 1, 40), F.col("theme_label"),
        F.substring(F.coalesce("song_title", F.lit("")), 1, 30), F.substring("artist_names", 1, 30), F.coalesce(F.col("year").cast("string"), F.lit("-")),
        F.col("l1_cos"), F.col("l2_weight"), F.col("final"),
    )
    return presented.select("seed", "rank", line.alias("line"))


def smoke(catalogue: DataFrame, cfg: Config | None = None, k: int = 20) -> dict[str, bool]:
    """Whether vectors are similar to themselves, and whether comfort shows a sibling among its first ``k``, no lower than purist does.

    The seed is the smallest theme_id that has a sibling with another recording; without one the sibling checks pass.
    """
    length = vectors.dot(F.col("u"), F.col("u"))
    whole = catalogue.agg(F.min(length)).first()[0]
    group = catalogue.groupBy("mal_id").agg(F.countDistinct("audio_id").alias("n"), F.min("theme_id").alias("theme_id")).filter("n > 1")
    seed = group.orderBy("theme_id").select("theme_id").first()
    out = {"self_similar": whole is not None and whole >= 0.999, "sibling_in_comfort": True, "comfort_not_below_purist": True}
    if seed:
        asking = catalogue.filter(F.col("theme_id") == seed.theme_id)
        siblings = catalogue.join(asking.select("mal_id"), "mal_id", "left_semi").select("theme_id")
        rank = {m: recommend(catalogue, cfg, mode=m, k=k, seeds=asking).join(siblings, "theme_id", "left_semi").agg(F.min("rank")).first()[0] for m in ("purist", "comfort")}
        out["sibling_in_comfort"] = rank["comfort"] is not None
        out["comfort_not_below_purist"] = rank["purist"] is None or rank["comfort"] is not None and rank["comfort"] <= rank["purist"]
    return out
