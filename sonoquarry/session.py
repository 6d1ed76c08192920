"""Session helpers: table access, shared checkpoint folder, spreading of work."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import DataError


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage, as the cluster names it.

    ``spark.checkpoint.dir`` wins, then a folder set on the context. Where neither is set, a local master (tests, a single machine) gets a
    temporary folder; on a cluster that would be a folder which other machines don't see, so it is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise DataError("a cluster needs a shared folder: set spark.checkpoint.dir")
    made = tempfile.mkdtemp(prefix="sonoquarry-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def write(df: DataFrame, target: str, *by: str) -> None:
    """Write ``df`` as Parquet. Shuffle files that it was made of go with the end of the write: the driver else keeps them until it happens to
    collect its garbage, beside all that follows on disk."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        df.write.partitionBy(*by).parquet(target) if by else df.write.parquet(target)
    finally:
        conf.unset(name) if before is None else conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared folder and read it back: computed once, safe when executors are lost, and later
    scans read only the columns they need. The table is deleted when the application's file system closes."""
    spark = df.sparkSession
    target = f"{checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/cut-{uuid.uuid4().hex}"
    write(df, target)
    place = spark._jvm.org.apache.hadoop.fs.Path(target)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(target)


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """Spread rows over the cluster's cores before heavy per-row work on an input of few files."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, 1)
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def fan_out(df: DataFrame) -> DataFrame:
    """Spread few but costly rows evenly over all cores; tasks are sized by their work, not bytes, so adaptive coalescing must not
    join them (a repartition by the columns that the input is already hashed by would be optimised away)."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application, by way of the shared folder if the cluster names one."""
    import io
    import os
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_sonoquarry_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("sonoquarry", os.path.relpath(path, root)))
    target = f"{checkpoint_dir(spark).rstrip('/')}/{sc.applicationId}/sonoquarry.zip"
    place = sc._jvm.org.apache.hadoop.fs.Path(target)
    out = place.getFileSystem(sc._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(target)
    sc._sonoquarry_shipped = True
