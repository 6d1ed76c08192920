"""Variant vectors of one catalogue: layers of a model, complete ids, datasets with replaced vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DataError


def explode_layers(rows: DataFrame, layers: str = "layers") -> DataFrame:
    """One row per theme and layer of ``layers array<array<float>>``: ``theme_id, variant`` (layer00, ..), ``embedding``. Null layers are left out."""
    e = rows.select("theme_id", F.posexplode(layers).alias("n", "embedding")).filter("embedding is not null")
    return e.select("theme_id", F.format_string("layer%02d", "n").alias("variant"), "embedding")


def complete_ids(vectors: DataFrame) -> DataFrame:
    """``theme_id`` of themes that every variant has. No variant: DataError."""
    n = vectors.select("variant").distinct().count()
    if n == 0:
        raise DataError("no variants")
    return vectors.groupBy("theme_id").agg(F.countDistinct("variant").alias("v")).filter(F.col("v") == n).select("theme_id")


def replace_vectors(dataset: DataFrame, vectors: DataFrame, model: str, version: str) -> DataFrame:
    """The dataset once per variant with its vectors, model and version in place; only themes that all variants have."""
    kept = vectors.join(complete_ids(vectors), "theme_id", "left_semi")
    base = dataset.drop("embedding", "embed_model", "embed_version")
    return base.join(kept.select("theme_id", "variant", "embedding"), "theme_id").withColumns({"embed_model": F.lit(model), "embed_version": F.concat_ws("-", F.lit(version), "variant")})
