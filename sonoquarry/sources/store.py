"""The embedding store: a folder of Parquet shards, appended to and guarded against mixed versions; JSON and text sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..operators import catalogue


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A Parquet table with its declared schema; an empty one if nothing is there yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(path)


def shards(spark: SparkSession, folder: str, pattern: str = "part*.parquet") -> list[str]:
    """Names of a store's shards in order; other files don't count."""
    if not exists(spark, folder):
        return []
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place) or []
    return sorted(f.getPath().getName() for f in found)


def read_embeddings(spark: SparkSession, folder: str, legacy: str | None = None) -> DataFrame:
    """All shards and the single file of older stores."""
    out = read_table(spark, folder, schemas.EMBEDDINGS)
    return out.unionByName(read_table(spark, legacy, schemas.EMBEDDINGS), allowMissingColumns=True) if legacy and exists(spark, legacy) else out


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first path that is there: a local file before the pinned copy."""
    return next((p for p in paths if exists(spark, p)), None)


def append(rows: DataFrame, path: str) -> int:
    """Append rows as new shards; no rows write no file. Returns their number."""
    rows = rows.persist()
    try:
        n = rows.count()
        if n:
            rows.write.mode("append").parquet(path)
        return n
    finally:
        rows.unpersist()


def overwrite(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def guard(spark: SparkSession, folder: str, model: str, version: str, force: bool = False) -> None:
    """Refuse a store with rows of another model or version, or empty it if ``force``. An empty store passes."""
    held = read_embeddings(spark, folder)
    if force and not catalogue.stale(held, model, version).isEmpty():
        p = spark._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        return
    catalogue.check_stale(held, model, version)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file (a report) on any file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def read_map(spark: SparkSession, *paths: str) -> DataFrame | None:
    """``value``: a JSON map as one text, from the first of the paths that is there (a local file before the pinned copy); None if none is."""
    path = first_existing(spark, *paths)
    return None if path is None else spark.read.text(path, wholetext=True)


def write_ids(df: DataFrame, ident: str, path: str) -> None:
    """One id per line, ascending."""
    df.select(df[ident].cast("string").alias("value"), df[ident].alias("_i")).orderBy("_i").select("value").write.mode("overwrite").text(path)


def read_ids(spark: SparkSession, path: str, ident: str = "theme_id") -> DataFrame:
    """Ids of a text file, blank lines left out."""
    t = spark.read.text(path)
    return t.filter("trim(value) <> ''").selectExpr(f"cast(trim(value) as bigint) as {ident}")


def read_variants(spark: SparkSession, folder: str) -> DataFrame:
    """All variant files ``layer*.parquet`` of a folder, with their names in ``variant``."""
    from pyspark.sql import functions as F

    rows = spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(folder)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"(layer[^/]*?)\.parquet", 1)
    return rows.select("*", name.alias("variant")).filter("variant <> ''")
