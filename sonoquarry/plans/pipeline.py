"""Stage runner: themes, metadata, audio, embeddings, joined dataset; each stage hands over a table on disk."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import Config
from ..operators import audio, catalogue
from ..session import cut
from ..sources import files, rest, store

_LOG = logging.getLogger(__name__)
STAGES = ("themes", "mal", "audio", "embed", "join")
ALL = "all"


@dataclass
class Paths:
    """Where the stages read and write; all under one shared folder."""

    root: str
    pages: str | None = None  # saved catalogue pages instead of the service

    def __getattr__(self, name: str) -> str:
        places = {"themes": "raw/themes", "mal": "raw/mal", "cache": "cache", "files": "audio", "download_errors": "raw/download_errors", "embed_errors": "raw/embed_errors", "embeddings": "embeddings", "dataset": "processed/dataset"}
        if name not in places:
            raise AttributeError(name)
        return f"{self.root}/{places[name]}"


@dataclass
class Services:
    """What reaches outside: replaced in tests and offline runs. Functions that make functions are called once per worker."""

    base: str = ""
    metadata_base: str = ""
    fetch_file: Callable[[str, str], None] | None = None
    embedder: Callable | None = None
    options: dict = field(default_factory=dict)
    ranking: rest.Fetch | None = None
    by_site: Callable[[], Callable[[int], list[dict]]] | None = None
    metadata: Callable[[], Callable[[int], dict | None]] | None = None

    def __post_init__(self):
        base, about = self.base, self.metadata_base
        if base and self.by_site is None:
            self.by_site = lambda: rest.site_matches(rest.http(base), catalogue.SITE)
        if about and self.ranking is None:
            self.ranking = rest.http(about)
        if about and self.metadata is None:
            def metadata():
                get = rest.http(about)
                return lambda key: get(f"/anime/{key}/full", None).get("data")

            self.metadata = metadata


_ANIME = schemas.PAGE.split("anime array<", 1)[1].rsplit(">, links", 1)[0]


def _themes_of(payloads: DataFrame) -> DataFrame:
    """Theme rows of ``ingest_pos, payload``, the first of each theme."""
    anime = payloads.select("ingest_pos", F.from_json("payload", _ANIME).alias("a")).select("ingest_pos", "a.*")
    return catalogue.keep_first(catalogue.theme_rows(anime), "theme_id", "ingest_pos", "theme_pos").drop("ingest_pos", "theme_pos")


def fetch_themes(spark: SparkSession, paths: Paths, services: Services, limit_pages: int | None, page_size: int = 100) -> DataFrame:
    """Themes of all pages of the catalogue, or of the first ones."""
    rest.register(spark)
    options = {"base": services.base, "page_size": str(page_size), **services.options} | ({"folder": paths.pages} if paths.pages else {}) | ({"limit_pages": str(limit_pages)} if limit_pages else {})
    return _themes_of(spark.read.format("paged_catalogue").options(**options).load())


def fetch_top_themes(spark: SparkSession, services: Services, n: int, by: str, rate: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Themes of the ``n`` first anime of the service's ranking, the keys that were looked up and those with several matches."""
    ids = rest.ranked_ids(services.ranking, n, by)
    asked = spark.createDataFrame(list(enumerate(ids)), "ingest_pos long, mal_id long")
    found = cut(rest.matches(asked, "mal_id", services.by_site, 1, rate))
    first = rest.first_matches(found).join(asked.groupBy("mal_id").agg(F.min("ingest_pos").alias("ingest_pos")), "mal_id")
    return _themes_of(first.select("ingest_pos", "payload")), rest.not_found(asked, found, "mal_id"), rest.ambiguous(found, "mal_id")


def _stage_themes(spark: SparkSession, paths: Paths, cfg: Config, services: Services, top_n: int | None, top_by: str, limit_pages: int | None) -> int:
    if top_n is not None and services.ranking is not None and services.by_site is not None:
        rows, lost, several = fetch_top_themes(spark, services, top_n, top_by, cfg.metadata_rate)
        for what, some in (("no record", lost), ("several records, the first is taken", several)):
            n = some.count()
            if n:
                _LOG.warning("%d of %d anime have %s, for example %s", n, top_n, what, [r.mal_id for r in some.select("mal_id").orderBy("mal_id").limit(10).collect()])
    else:
        rows = fetch_themes(spark, paths, services, limit_pages, cfg.page_size)
        if top_n is not None:  # offline: the ranks of the metadata that is there
            rows = rows.join(catalogue.top_ids(store.read_table(spark, paths.mal, schemas.MAL), top_n, top_by), "mal_id", "left_semi").select(*rows.columns)
    store.overwrite(rows, paths.themes)
    return spark.read.parquet(paths.themes).count()


def _stage_mal(spark: SparkSession, paths: Paths, cfg: Config, services: Services) -> int:
    """Metadata of the themes' anime: what the cache lacks is fetched first (documents that aren't there are remembered as empty ones)."""
    cached = files.read_cache(spark, paths.cache) if store.exists(spark, paths.cache) else None
    if services.metadata is not None:
        lacking = files.missing(store.read_table(spark, paths.themes, schemas.THEMES), cached)
        files.fill_cache(lacking, paths.cache, services.metadata, 1, cfg.metadata_rate).count()
        cached = files.read_cache(spark, paths.cache)
    if cached is None:
        raise ValueError("no cached metadata, and no service to fetch it from")
    wanted = store.read_table(spark, paths.themes, schemas.THEMES).select("mal_id").distinct() if store.exists(spark, paths.themes) else None
    rows = catalogue.metadata_rows(cached)
    store.overwrite(rows if wanted is None else rows.join(wanted, "mal_id", "left_semi").select(*rows.columns), paths.mal)
    return spark.read.parquet(paths.mal).count()


def run_stage(
    spark: SparkSession, stage: str, paths: Paths, cfg: Config | None = None, services: Services | None = None,
    *, top_n: int | None = None, top_by: str = "popularity", limit_pages: int | None = None, force: bool = False,
) -> int:
    """Run one stage, or ``all`` one after the other, and return the rows that it (the last) wrote. ``top_n`` and ``limit_pages`` exclude each other; unknown stages are refused."""
    cfg, services = cfg or Config(), services or Services()
    if stage not in (*STAGES, ALL):
        raise ValueError(f"{stage!r} is no stage; there are {', '.join(STAGES)} and {ALL}")
    if top_n is not None and limit_pages is not None:
        raise ValueError("top_n and limit_pages exclude each other")
    if stage == ALL:
        return [run_stage(spark, s, paths, cfg, services, top_n=top_n, top_by=top_by, limit_pages=limit_pages, force=force) for s in STAGES][-1]
    if stage == "themes":
        return _stage_themes(spark, paths, cfg, services, top_n, top_by, limit_pages)
    if stage == "mal":
        return _stage_mal(spark, paths, cfg, services)
    themes = store.read_table(spark, paths.themes, schemas.THEMES)
    if stage == "audio":
        catalogue.check_basenames(themes)
        if services.fetch_file is None:
            raise ValueError("the audio stage needs fetch_file")
        done = files.download(files.download_targets(themes), paths.files, services.fetch_file, cfg.download_workers).persist()
        failed = done.filter("state = 'failed'").select("audio_id", "audio_link", "audio_basename", "error_class", "error_message")
        store.overwrite(failed, paths.download_errors)  # of this run only
        n = done.filter("state = 'done'").count()
        done.unpersist()
        return n
    if stage == "embed":
        store.guard(spark, paths.embeddings, cfg.embed_model, cfg.embed_version, force)
        if services.embedder is None:
            raise ValueError("the embed stage needs an embedder")
        work = catalogue.todo(themes, store.read_embeddings(spark, paths.embeddings)).withColumn("content", F.concat(F.lit(f"{paths.files}/"), "audio_basename"))
        out = audio.embed(work, services.embedder, cfg.embed_model, cfg.embed_version).persist()
        store.append(out.filter("error_class is not null").select("theme_id", "audio_id", "error_class", "error_message"), paths.embed_errors)
        good = out.filter("error_class is null").select("theme_id", "audio_id", "embedding", "embed_model", "embed_version", "n_chunks_used", "total_seconds_used")
        n = store.append(good, paths.embeddings)
        if n and not cfg.keep_audio:  # recordings that no theme needs any more
            done = good.select("audio_id").distinct().join(catalogue.todo(themes, store.read_embeddings(spark, paths.embeddings)).select("audio_id"), "audio_id", "left_anti")
            files.remove(themes.join(done, "audio_id", "left_semi"), paths.files)
        out.unpersist()
        return n
    lost = store.read_table(spark, paths.download_errors, schemas.DOWNLOAD_ERRORS)
    failed = store.read_table(spark, paths.embed_errors, schemas.EMBED_ERRORS)
    vectors = store.read_embeddings(spark, paths.embeddings)
    store.overwrite(catalogue.build_dataset(themes, store.read_table(spark, paths.mal, schemas.MAL), vectors, catalogue.excluded_themes(themes, lost, failed)), paths.dataset)
    return spark.read.parquet(paths.dataset).count()
