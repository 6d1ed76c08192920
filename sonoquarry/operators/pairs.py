"""All-pairs scoring of seeds against candidates in blocks.

Candidates fall into blocks (by their recording, so that rows which may replace one another in de-duplication share a block), which are
written once into the shared folder. A recording with more than ``HOT`` rows is spread over all blocks by its themes: its rows are marked
``hot``, and the callers find the best of them over all blocks. Each task has a line of seeds and reads block after block; nothing is
broadcast, no row is copied per line and no pair leaves its task (see ``ranking``). The number of pairs is quadratic by definition of an exact
ranking; ``nearest`` vectors of large collections belong to an index, not here.

Scores equal to nine decimals tie; the smaller theme_id comes first. Inner products are exact sums (see ``halves``), so a
score doesn't depend on the blocks, the order of a matrix product or the number of cores.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..session import checkpoint_dir, write

SEEDS, CANDIDATES = 16384, 16384
#: Rows of one recording beyond which it is spread over the column blocks; so at most two a block on average.
HOT = CANDIDATES // 2
#: What a row of the catalogue must hold for scoring; ``u`` is a unit vector.
COLUMNS = ("theme_id", "mal_id", "audio_id", "artist_ids", "genres", "start_year", "u")


def halves(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two parts of unit vectors whose products add up without rounding, in any order.

    The upper part is a multiple of 2^-26, the lower one of 2^-48 (less for more than 1024 values). Partial sums of upper by upper stay
    within 1 and are multiples of 2^-52; those of upper by lower stay below 2^-26 times the root of the number of values and are multiples of 2^-74:
    all of them fit in 53 bits. Lower by lower is below the precision of the result.
    """
    upper = np.round(u * 2.0 ** 26) / 2.0 ** 26
    fine = 2.0 ** (48 - max(0, math.ceil(math.log2(max(u.shape[1], 1)) / 2 - 5)))
    return upper, np.round((u - upper) * fine) / fine


@dataclass
class Side:
    """One side of a cell as arrays."""

    theme_id: np.ndarray
    mal_id: np.ndarray
    audio_id: np.ndarray
    year: np.ndarray
    upper: np.ndarray
    lower: np.ndarray
    artists: list
    genres: list
    hot: np.ndarray

    @classmethod
    def of(cls, f: pd.DataFrame) -> "Side":
        def sets(col):
            return [{x for x in v if x is not None and x == x} if v is not None else set() for v in f[col]]

        f = f.sort_values("theme_id", kind="stable")
        u = np.stack(f["u"].to_numpy()).astype(np.float64) if len(f) else np.zeros((0, 1))
        return cls(f["theme_id"].to_numpy(np.int64), f["mal_id"].to_numpy(), f["audio_id"].to_numpy(), f["start_year"].to_numpy(np.float64, na_value=np.nan), *halves(u), [set(map(int, s)) for s in sets("artist_ids")], sets("genres"), f["hot"].to_numpy(bool) if "hot" in f else np.zeros(len(f), bool))


def _incidence(sets: list[set], known: dict) -> np.ndarray:
    out = np.zeros((len(sets), len(known)))
    for row, s in zip(out, sets):
        for x in s:
            if x in known:
                row[known[x]] = 1
    return out


@dataclass
class Scores:
    """Scores of a slice of seeds (rows) against the candidates of a cell (columns)."""

    seeds: Side
    candidates: Side
    at: slice
    cosine: np.ndarray
    weight: np.ndarray
    raw: np.ndarray
    final: np.ndarray  # to nine decimals, which decide the order
    allowed: np.ndarray
    partner: np.ndarray
    jaccard: np.ndarray
    era: np.ndarray


def score(seeds: Side, candidates: Side, cfg: Config, scale: float, exclude_same: bool, step: int = 256) -> Iterator[Scores]:
    genres = {g: i for i, g in enumerate(sorted(set().union(*candidates.genres, *seeds.genres)))}
    own, other = _incidence(seeds.genres, genres), _incidence(candidates.genres, genres)
    own_size, other_size = own.sum(1), other.sum(1)
    holders: dict[int, list[int]] = {}
    for j, s in enumerate(candidates.artists):
        for a in s:
            holders.setdefault(a, []).append(j)
    columns = {a: np.array(x) for a, x in holders.items()}
    crossed = np.hstack([candidates.lower, candidates.upper]).T
    for s in range(0, len(seeds.theme_id), step):
        at = slice(s, min(s + step, len(seeds.theme_id)))
        cosine = seeds.upper[at] @ candidates.upper.T + np.hstack([seeds.upper[at], seeds.lower[at]]) @ crossed
        inter = own[at] @ other.T
        union = own_size[at][:, None] + other_size - inter
        jaccard = np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)
        same = seeds.mal_id[at][:, None] == candidates.mal_id
        partner = np.zeros(cosine.shape, bool)
        for i, artists in enumerate(seeds.artists[at]):
            for a in artists:
                if a in columns:
                    partner[i, columns[a]] = True
        with np.errstate(invalid="ignore"):
            era = np.abs(seeds.year[at][:, None] - candidates.year) <= cfg.era_window_years
        weight = cfg.w_anime * same + cfg.w_artist * partner + cfg.w_era * era + cfg.alpha_genre * jaccard
        if cfg.w_max > 0:
            weight = weight / cfg.w_max
        raw = cosine + scale * cfg.alpha_blend * weight
        allowed = seeds.theme_id[at][:, None] != candidates.theme_id
        if exclude_same:
            allowed &= ~same
        yield Scores(seeds, candidates, at, cosine, weight, raw, np.round(raw, 9), allowed, partner, jaccard, era)


def _store(df: DataFrame, by: str) -> str:
    """Write ``df`` into the shared folder, a folder for each value of ``by``; deleted when the application ends.

    Nothing is exchanged for that (a second copy on disk): each task writes a file into every folder, so tasks should be few."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/blocks-{uuid.uuid4().hex}")
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    write(df, place.toString(), by)
    fs.deleteOnExit(place)
    return fs.makeQualified(place).toString()


def _few(df: DataFrame, blocks: int) -> DataFrame:
    """``df`` in as many parts as keep all cores busy, of 16 blocks' rows at most on average."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(blocks / 16)))


def _load(folder: str, n: int) -> pa.Table | None:
    """One block of a stored table; None if it has no rows."""
    import pyarrow.fs as pfs
    import pyarrow.parquet as pq

    fs, path = pfs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)
    found = sorted(f.path for f in fs.get_file_info(pfs.FileSelector(f"{path}/_block={n}", allow_not_found=True)) if f.path.endswith(".parquet"))
    parts = []
    for f in found:
        with fs.open_input_file(f) as source:
            parts.append(pq.ParquetFile(source).read(use_threads=False))
    out = pa.concat_tables(parts) if parts else None
    return out if out is not None and len(out) else None


@dataclass
class Stored:
    """Candidates in blocks, which several rankings may read."""

    spark: SparkSession
    folder: str
    blocks: int


def stored(rows: DataFrame, carry: tuple[str, ...] = ()) -> Stored:
    """Write the candidates' blocks; ``carry``: further columns that a ranking needs."""
    columns = column_blocks(rows)
    spread = hot(rows, columns)
    own = F.pmod(F.when(spread, F.xxhash64("theme_id")).otherwise(F.xxhash64("audio_id")), F.lit(columns)).cast("int")
    return Stored(rows.sparkSession, _store(_few(rows.select(*COLUMNS, *carry, spread.alias("hot"), own.alias("_block")), columns), "_block"), columns)


def lines(rows: DataFrame | Stored, seeds: DataFrame | None, each: Callable[[pa.Table, Callable[[], Iterator[pa.Table]]], Iterator[pd.DataFrame]], schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``each(asking, blocks)`` to every line of seeds; ``blocks()`` reads the candidates' blocks one by one. ``seeds``: the rows that ask (all
    if None); ``carry``: further columns that both sides need."""
    held = rows if isinstance(rows, Stored) else stored(rows, carry)
    spark, folder, columns = held.spark, held.folder, held.blocks
    wanted = 2 * spark.sparkContext.defaultParallelism
    if seeds is None:
        asked, n, parts = folder, columns, max(1, math.ceil(CANDIDATES / SEEDS), -(-wanted // columns))
    else:
        n_asking = seeds.count()
        n, parts = max(1, math.ceil(n_asking / SEEDS), min(n_asking, wanted)), 1
        line = F.pmod(F.xxhash64("theme_id"), F.lit(n)).cast("int")
        asked = _store(_few(seeds.select(*COLUMNS, *carry, line.alias("_block")), n), "_block")

    def blocks() -> Iterator[pa.Table]:
        for b in range(columns):
            if (t := _load(folder, b)) is not None:
                yield t

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in f["id"].tolist():
                t = _load(asked, i // parts)
                if t is not None and parts > 1:
                    t = t.take(np.arange(i % parts, len(t), parts))
                if t is not None and len(t):
                    yield from each(t, blocks)

    return spark.range(0, n * parts, 1, n * parts).mapInPandas(run, schema)


def grid(rows: DataFrame, seeds: DataFrame | None, each: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``each(seeds, candidates)`` to every line and block."""
    def cells(asking: pa.Table, blocks: Callable[[], Iterator[pa.Table]]) -> Iterator[pd.DataFrame]:
        a = asking.to_pandas().assign(asks=True)
        for block in blocks():
            yield each(a, block.to_pandas().assign(asks=False))

    return lines(rows, seeds, cells, schema, carry)


def column_blocks(rows: DataFrame) -> int:
    """Number of blocks that the candidates are divided into."""
    return max(1, math.ceil(rows.count() / CANDIDATES))


def hot(rows: DataFrame, columns: int) -> Column:
    """Whether a row's recording (null is one as well) has too many rows for one block."""
    if columns == 1:
        return F.lit(False)
    many = [r.audio_id for r in rows.groupBy("audio_id").count().filter(F.col("count") > HOT).select("audio_id").collect()]  # a bounded share of the rows
    named = [x for x in many if x is not None]
    found = F.coalesce(F.col("audio_id").isin(named), F.lit(False)) if named else F.lit(False)
    return found | F.col("audio_id").isNull() if None in many else found
