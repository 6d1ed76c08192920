"""Whitening of a vector column: two passes for mean and Gram matrix, a driver eigen-decomposition of D x D, a projection.

The sums are added up over the partitions, so only a few arrays of D x D numbers ever reach the driver. Population size N
is used (not N - 1); eigenvalues are clipped at 0; ``components`` is clamped to min(N, D).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from ..errors import DegenerateVectors
from ..functions import vectors
from ..session import cut

#: Partial sums that reach the driver at most.
FAN_IN = 16


@dataclass
class Whitening:
    enabled: bool
    components: int = 0
    variance_kept: float = 1.0
    mean: np.ndarray | None = None
    projection: np.ndarray | None = None  # D x k, already divided by the scales


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _summed(df: DataFrame, vector: str, each) -> np.ndarray:
    """Sum over all rows of what ``each`` makes of a matrix of vectors: one array per partition, added up in two steps, so that
    the driver receives a few arrays only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if len(b):
                part = each(_rows(b.column(0)))
                total = part if total is None else total + part
        yield pa.RecordBatch.from_arrays([pa.array([] if total is None else [total.tobytes()], pa.binary())], names=["total"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x) for b in batches for x in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([np.sum(held, axis=0).tobytes()] if held else [], pa.binary())], names=["total"])

    parts = df.select(vector).mapInArrow(run, "total binary")
    found = parts.repartition(FAN_IN).mapInArrow(add, "total binary").collect()  # at most FAN_IN arrays
    return np.sum([np.frombuffer(r.total) for r in found], axis=0) if found else np.zeros(0)


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray]:
    """Number of vectors and their mean."""
    total = _summed(df, vector, lambda m: np.append(m.sum(axis=0), len(m)))
    return (int(total[-1]), total[:-1] / total[-1]) if len(total) else (0, total)


def gram(df: DataFrame, vector: str, mean: np.ndarray) -> np.ndarray:
    """Sum of the outer products of the centred vectors."""
    d = len(mean)
    return _summed(df, vector, lambda m: ((m - mean).T @ (m - mean)).ravel()).reshape(d, d)


def fit(df: DataFrame, vector: str, components: int, alpha: float = 1.0, eps: float = 1e-5) -> Whitening:
    """The projection of all vectors; ``components`` <= 0 switches whitening off."""
    if components <= 0:
        return Whitening(False)
    n, mean = moments(df, vector)
    values, basis = np.linalg.eigh(gram(df, vector, mean))
    order = np.argsort(values)[::-1]
    squares, basis = np.clip(values[order], 0.0, None), basis[:, order]
    squares[squares < squares.max() * len(squares) * np.finfo(float).eps] = 0.0  # what rounding leaves of nothing
    k = min(components, n, len(mean))
    total = squares.sum()
    scale = (np.sqrt(squares[:k]) / np.sqrt(n)) ** alpha + eps
    return Whitening(True, k, float(squares[:k].sum() / total) if total > 0 else 0.0, mean, basis[:, :k] / scale)


def apply(df: DataFrame, vector: str, fitted: Whitening, ident: str = "theme_id", into: str = "whitened", keep: bool = True) -> DataFrame:
    """``df`` with the projected vectors in ``into`` (without those they are made of unless ``keep``), projected once and written to the shared folder; refused where a vector collapses to zero."""
    if not fitted.enabled:
        out = df.withColumn(into, F.transform(F.col(vector), lambda x: x.cast("double")))
        return out if keep else out.drop(vector)
    mean, projection = fitted.mean, fitted.projection
    kept = df.drop(into)
    at = kept.columns.index(vector)
    stays = [i for i in range(len(kept.columns)) if keep or i != at]
    schema = StructType([*[kept.schema.fields[i] for i in stays], StructField(into, ArrayType(DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = (_rows(b.column(at)) - mean) @ projection if len(b) else np.zeros((0, projection.shape[1]))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * projection.shape[1], pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in stays], values], names=[*[b.schema.names[i] for i in stays], into])

    made = cut(kept.mapInArrow(run, schema))
    bad = [r[0] for r in made.filter(~(vectors.norm(F.col(into)) > 1e-9)).select(ident).orderBy(ident).limit(10).collect()]
    if bad:
        raise DegenerateVectors(f"whitened vectors collapsed to zero, for example {bad}")
    return made
