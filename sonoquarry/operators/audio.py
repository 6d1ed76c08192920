"""Array forms of the audio steps: chunking, feature lengths, pooling; a pluggable embedder for inference."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import DataError


def split_chunks(samples: Column, chunk: int, n_chunks: int, stride: int) -> Column:
    """``array<struct<chunk_no, real_len, chunk>>``: up to ``n_chunks`` pieces; a short first one is padded with zeros, short later ones are dropped."""
    pieces = F.transform(F.sequence(F.lit(0), F.lit(n_chunks - 1)), lambda i: F.struct(i.alias("chunk_no"), F.slice(samples, i * stride + 1, F.lit(chunk)).alias("p")))
    kept = F.filter(pieces, lambda s: (F.size(s["p"]) == chunk) | ((s["chunk_no"] == 0) & (F.size(s["p"]) > 0)))
    return F.transform(kept, lambda s: F.struct(s["chunk_no"], F.size(s["p"]).alias("real_len"), F.concat(s["p"], F.array_repeat(F.lit(0.0), F.lit(chunk) - F.size(s["p"]))).alias("chunk")))


def feature_length(samples: Column, layers: list[tuple[int, int]], most: Column) -> Column:
    """Frames that ``samples`` values give through convolutions of (kernel, stride), between 1 and ``most``."""
    out = samples.cast("long")
    for kernel, stride in layers:
        out = F.floor((out - kernel) / stride) + 1
    return F.least(F.greatest(out, F.lit(1)), most)


def mean_vectors(df: DataFrame, group: str, vector: str) -> DataFrame:
    """``group, pooled``: the mean of a group's vectors, coordinate by coordinate (partial sums map side)."""
    x = df.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.avg("x").alias("x"))
    return x.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("pooled"))


def masked_mean(frames: Column, valid: Column) -> Column:
    """Mean of the first ``valid`` vectors of ``array<array<double>>``, coordinate by coordinate; one at least counts."""
    n = F.greatest(F.least(valid.cast("int"), F.size(frames)), F.lit(1))
    total = F.aggregate(F.slice(frames, 2, F.greatest(n - 1, F.lit(0))), F.element_at(frames, 1), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / n)


def pool_chunks(chunks: Column, layers: list[tuple[int, int]]) -> Column:
    """One vector of ``array<struct<real_len, frames array<array<double>>>>``: the masked mean of each chunk's frames (as many as its real
    samples give through the convolutions ``layers``), then the mean over the chunks. Null for no chunks."""
    means = F.transform(chunks, lambda c: masked_mean(c["frames"], feature_length(c["real_len"], layers, F.size(c["frames"]))))
    return F.when(F.size(chunks) > 0, masked_mean(means, F.size(chunks)))


def pool_layers(hidden: np.ndarray, real_lengths: np.ndarray, layers: list[tuple[int, int]]) -> np.ndarray:
    """The same for all layers of a model at once: ``hidden`` is layers x chunks x frames x dims, the result layers x dims."""
    n = np.asarray(real_lengths)
    for kernel, stride in layers:
        n = (n - kernel) // stride + 1
    held = np.arange(hidden.shape[2]) < np.clip(n, 1, hidden.shape[2])[:, None]
    return (np.einsum("lctd,ct->lcd", hidden, held) / held.sum(axis=1)[:, None]).mean(axis=1)


def check_sample_rate(expected: int, model: int | None) -> int:
    """The sample rate to use; DataError if the model was made for another one than is configured."""
    if model and model != expected:
        raise DataError(f"the model takes {model} samples a second, {expected} are configured: set target_sr and embed again, or choose another model")
    return model or expected


class Pooled(NamedTuple):
    """What an embedder gives beside the vector: the chunks and seconds that went into it."""

    vector: Any
    n_chunks: int | None = None
    seconds: float | None = None


def pooled_stats(frames: np.ndarray) -> np.ndarray:
    """Mean and population deviation over time, one behind the other."""
    return np.concatenate([frames.mean(axis=1), frames.std(axis=1)])


def embed(rows: DataFrame, embedder: Callable[[], Callable[[pd.Series], list]], model: str, version: str, columns: str = "theme_id long, audio_id long", source: str = "content") -> DataFrame:
    """Vectors of ``rows`` by a pluggable model, loaded once per worker; a failing row gives its error, not a failed task.

    ``embedder()`` returns a function from one value of ``source`` to a vector or ``Pooled``. The result has the ids, ``embedding``,
    ``embed_model``, ``embed_version``, ``n_chunks_used``, ``total_seconds_used`` (null where the model doesn't tell), ``error_class`` and ``error_message`` (500
    characters at most).
    """
    names = [c.split()[0] for c in columns.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model_of = embedder()
        for f in frames:
            out = []
            for row in f.itertuples(index=False):
                ids = [getattr(row, n) for n in names]
                try:
                    made = model_of(getattr(row, source))
                    made = made if isinstance(made, Pooled) else Pooled(made)
                    out.append((*ids, [float(x) for x in made.vector], model, version, made.n_chunks, made.seconds, None, None))
                except Exception as e:  # noqa: BLE001 - any failure of a model is that row's error
                    out.append((*ids, None, model, version, None, None, type(e).__name__, str(e)[:500]))
            done = pd.DataFrame(out, columns=[*names, "embedding", "embed_model", "embed_version", "n_chunks_used", "total_seconds_used", "error_class", "error_message"])
            yield done.astype({"n_chunks_used": "Int32", "total_seconds_used": "Float64"})

    return rows.select(*names, source).mapInPandas(run, f"{columns}, embedding array<float>, embed_model string, embed_version string, n_chunks_used int, total_seconds_used double, error_class string, error_message string")
