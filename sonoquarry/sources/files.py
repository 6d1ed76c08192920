"""Cached documents and audio files: bucketed JSON cache, file listing, parallel fetch with completeness check."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from . import rest


_DONE, _SKIPPED, _FAILED = "done", "skipped", "failed"


def cache_path(folder: str, key: int) -> str:
    """Place of a cached document: buckets of a thousand ids."""
    return f"{folder}/{key // 1000:04d}/{key}.json"


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """All cached metadata documents with the key of their file in ``cache_key``; unreadable ones are dropped, so they are fetched again. An empty
    document (the service has none) has a row of nulls."""
    read = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    doc = F.from_json("value", schemas.MAL_DOC + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    key = F.regexp_extract(F.col("_metadata.file_path"), r"(\d+)\.json$", 1)
    return read.select(F.when(key != "", key).cast("long").alias("cache_key"), doc.alias("d")).filter("d._bad is null and cache_key is not null").select("d.*", "cache_key").drop("_bad")


def missing(keys: DataFrame, cached: DataFrame | None, key: str = "mal_id") -> DataFrame:
    """Different keys that no readable cached document is for."""
    asked = keys.select(key).filter(f"{key} is not null").distinct()
    return asked if cached is None else asked.join(cached.select(F.col("cache_key").alias(key)), key, "left_anti")


def fill_cache(keys: DataFrame, folder: str, fetch: Callable[[], Callable[[int], dict | None]], parallel: int = 1, rate: float = 0.0, key: str = "mal_id") -> DataFrame:
    """Fetch the documents of ``keys`` into the cache (a shared folder); ``{}`` stands for those that aren't there. Gives ``key, payload``."""
    def written(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k, text in zip(f[key], f["payload"]):
                path = cache_path(folder, int(k))
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path + ".part", "w", encoding="utf-8") as out:
                    out.write(text if text is not None else "{}")
                os.replace(path + ".part", path)
            yield f

    return rest.lookup(keys, key, fetch, parallel, rate).mapInPandas(written, f"{key} {dict(keys.dtypes)[key]}, payload string")


def held_sizes(folder: str, names: Iterable[str]) -> dict[str, int]:
    """Sizes of those of the named files that are in a folder."""
    found = {}
    for name in names:
        try:
            found[name] = os.stat(os.path.join(folder, name)).st_size
        except FileNotFoundError:
            pass
    return found


def _fetched(row, folder: str, fetch: Callable[[str, str], None]) -> int:
    """Size of a file that was fetched beside its place and moved there only when whole."""
    target = os.path.join(folder, row.audio_basename)
    fetch(row.audio_link, f"{target}.part")
    os.replace(f"{target}.part", target)
    return os.stat(target).st_size


def download(targets: DataFrame, folder: str, fetch: Callable[[str, str], None], parallel: int = 8) -> DataFrame:
    """Fetch ``audio_id, audio_link, audio_basename, audio_size`` into a shared folder.

    Files that are there in their known size (or with any content, if it is unknown) are skipped. The result has a row per recording
    with ``state`` (done, skipped, failed), ``size_differs`` and the error.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            held = f["audio_basename"].map(held_sizes(folder, f["audio_basename"]))
            whole = (held == f["audio_size"]) | f["audio_size"].isna() & (held > 0)
            out = f[["audio_id", "audio_link", "audio_basename"]].assign(state=_SKIPPED, size_differs=False, error_class=None, error_message=None)
            for at, row in zip(f.index[~whole], f[~whole].itertuples(index=False)):
                try:
                    size = _fetched(row, folder, fetch)
                    out.loc[at, ["state", "size_differs"]] = [_DONE, pd.notna(row.audio_size) and size != row.audio_size]
                except Exception as e:  # noqa: BLE001 - one file's failure is its row
                    out.loc[at, ["state", "error_class", "error_message"]] = [_FAILED, type(e).__name__, str(e)[:500]]
            yield out

    one = targets.select("audio_id", "audio_link", "audio_basename", "audio_size").repartition(parallel, "audio_id")
    return one.mapInPandas(run, "audio_id long, audio_link string, audio_basename string, state string, size_differs boolean, error_class string, error_message string")


def remove(names: DataFrame, folder: str) -> int:
    """Delete the files named in ``audio_basename``; returns how many there were."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            there = list(held_sizes(folder, f["audio_basename"]))
            for name in there:
                os.unlink(os.path.join(folder, name))
            yield pd.DataFrame({"n": [len(there)]})

    return names.select("audio_basename").dropna().distinct().mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def download_targets(themes: DataFrame) -> DataFrame:
    """One row per recording that has a link."""
    from ..operators.catalogue import keep_first

    return keep_first(themes.filter("audio_id is not null and audio_link is not null and audio_basename is not null"), "audio_id", "ingest_pos" if "ingest_pos" in themes.columns else "theme_id").select("audio_id", "audio_link", "audio_basename", "audio_size")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """``audio_basename, size`` of the files in a folder; contents aren't read."""
    return spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("audio_basename"), F.col("length").alias("size"))
