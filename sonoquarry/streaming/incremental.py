"""An addition beyond the batch operators: embed newly arriving themes as a file stream, skipping those that are done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import audio, catalogue
from ..sources import store


def embed_stream(
    spark: SparkSession, incoming: str, schema, folder: str, checkpoint: str, embedder: Callable, model: str, version: str, source: str = "content",
) -> StreamingQuery:
    """Every micro-batch appends the vectors of themes that the store lacks; run until the files are used up."""
    def each(batch: DataFrame, _: int) -> None:
        work = catalogue.todo(batch.dropDuplicates(["theme_id"]), store.read_embeddings(spark, folder))
        done = audio.embed(work, embedder, model, version, source=source).filter("error_class is null")
        rows = done.select("theme_id", "audio_id", "embedding", "embed_model", "embed_version", "n_chunks_used", "total_seconds_used")
        store.append(rows, folder)

    return spark.readStream.schema(schema).parquet(incoming).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
