"""Most similar vectors for every vector (problem 2): stable projections, a kd-tree and chi-square stopping.

Unit vectors are projected on a few random Gaussian directions. These are 2-stable: the difference of two vectors at
distance d has independent N(0, d^2) coordinates there. A kd-tree halves the projections one direction after the
other. Its upper levels divide the vectors into cells, one task each; in a task the tree goes on down to leaves of
``leaf`` points. The cells' levels are fitted, at most ``STEP_LEVELS`` at a time, on a sample of ``PER_CELL`` rows
a cell, node by node on the executors, so the depth follows the number of vectors and the driver holds the splits only.

A query takes the leaves by growing distance of their boxes, each scaled by its chi-square bound. A point in a box that lies
apart by gaps of the squared sum D^2 in c directions needs displacements of that sum, each to the right side, which has a
probability of at most 2^-c * P(chi^2_c >= D^2 / d^2) for a point at distance d. Where this falls below a threshold for
d = the distance of the k-th best found so far, the search stops: no leaf further on can hold a better one. The
threshold is set so that neighbours simulated by 2-stable displacements are missed with a probability of ``LEAF_RISK`` in
all. In a leaf, points whose projections are within the chi-square bound of all directions are verified by their
exact cosine, which tightens d for the leaves that follow. d begins with the distance at the least cosine that counts.

Two rounds carry the bound over the cells. In the first every query searches the cell that holds it. In the second it goes, with
the bound that it has reached, to those other cells that the stopping test leaves. So the members of a dense group, however
large, stay near home. A cell with many visitors is divided into blocks of queries by the load that a sample of the rows
predicts from their bounds. A task returns no more than k rows a query, and a pair found from one side counts for both.

Vectors of exactly the same direction are one class; only its first vector is searched and the class's
smallest ids stand for it, so a hot group of copies costs no more than one vector.

Defined results: rows without an id, with a null vector, another length, a null, NaN or infinite value, or
all zeros don't take part; of repeated ids the row with the smallest position counts. Cosines equal to six decimals tie,
the smaller id first. Empty input: empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

DIRECTIONS = 16
#: Mean vectors of a cell for few and for many vectors, points of a leaf, queries of a block and those searched at a time.
CELL, LARGE_CELL, LEAF, ASKING, AT_ONCE = 32768, 131072, 1024, 131072, 32768
#: Sample rows per cell that the splits are fitted on, levels fitted at a time, rows that calibrate the stopping threshold.
PER_CELL, STEP_LEVELS, CALIBRATION = 32, 10, 4096
#: Probability that a neighbour's leaf isn't visited, and that its projection lies beyond the bound of all directions.
LEAF_RISK, POINT_RISK = 0.005, 0.005
_NOBODY = np.iinfo(np.int64).max


def chi2_survival(x: float, dof: int) -> float:
    """P(chi^2_dof >= x), from the closed recurrences for whole degrees of freedom."""
    if x <= 0:
        return 1.0
    q = math.erfc(math.sqrt(x / 2)) if dof % 2 else math.exp(-x / 2)
    k = 1 if dof % 2 else 2
    term = math.exp(-x / 2) * (math.sqrt(2 * x / math.pi) if k == 1 else x / 2)
    while k < dof:
        q += term
        k += 2
        term *= x / k
    return min(q, 1.0)


def chi2_bound(risk: float, dof: int) -> float:
    """The x with P(chi^2_dof >= x) = risk; 0 for a risk of 1 or more."""
    if risk >= 1:
        return 0.0
    low, high = 0.0, 400.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_survival(mid, dof) > risk else (low, mid)
    return high


def fit_levels(p: np.ndarray, first: int, levels: int) -> list[np.ndarray]:
    """Medians that halve the rows ``p``, level by level; level ``first + i`` looks at direction ``(first + i) % p.shape[1]``."""
    cuts, node = [], np.zeros(len(p), np.int64)
    for i in range(levels):
        x = p[:, (first + i) % p.shape[1]]
        order = np.lexsort((x, node))
        count = np.bincount(node, minlength=1 << i)
        begin = np.cumsum(count) - count
        middle = order[np.minimum(begin + count // 2, max(len(order) - 1, 0))] if len(order) else np.zeros(1 << i, np.int64)
        cuts.append(np.where(count > 0, x[middle], 0.0) if len(order) else np.zeros(1 << i))
        node = 2 * node + (x >= cuts[i][node])
    return cuts


def descend(p: np.ndarray, cuts: list[np.ndarray], first: int = 0) -> np.ndarray:
    """The node below all ``cuts`` that holds each row."""
    node = np.zeros(len(p), np.int64)
    for i, at in enumerate(cuts):
        node = 2 * node + (p[:, (first + i) % p.shape[1]] >= at[node])
    return node


def threshold(gaps: np.ndarray, radius2, risk: float = LEAF_RISK) -> float:
    """The probability below which a box is left out, from the ``gaps`` between queries and the boxes of neighbours simulated at the squared
    distances ``radius2``."""
    crossed, ratio = (gaps > 0).sum(axis=1), (gaps * gaps).sum(axis=1) / radius2
    chance = np.array([2.0 ** -c * chi2_survival(x, c) if c else 1.0 for c, x in zip(crossed.tolist(), ratio.tolist())])
    return float(np.quantile(chance, risk, method="lower")) if len(chance) else 1.0


def limits(tau: float) -> np.ndarray:
    """By the number of directions with a gap: squared gaps over squared distance up to which a box is visited."""
    return np.array([np.inf] + [chi2_bound(tau * 2.0 ** c, c) for c in range(1, DIRECTIONS + 1)])


class Tree:
    """The cells' levels of the kd-tree: splits, stopping limits and the blocks of each cell."""

    def __init__(self, dims: int, radius2: float, seed: int = 7):
        self.radius2 = radius2
        self.directions = np.random.default_rng(seed).standard_normal((dims, DIRECTIONS))
        self.cuts: list[np.ndarray] = []
        self.limit = limits(1.0)
        self.point_limit = chi2_bound(POINT_RISK, DIRECTIONS)
        self.blocks = np.ones(1, np.int64)

    @property
    def cells(self) -> int:
        return 1 << len(self.cuts)

    def home(self, p: np.ndarray) -> np.ndarray:
        return descend(p, self.cuts)

    def calibrate(self, p: np.ndarray, seed: int = 3) -> None:
        """Set the limits by simulated neighbours of the rows ``p`` at the largest distance that counts."""
        target = p + np.random.default_rng(seed).standard_normal(p.shape) * math.sqrt(self.radius2)
        low, high, node = np.full(p.shape, -np.inf), np.full(p.shape, np.inf), np.zeros(len(p), np.int64)
        for level, at in enumerate(self.cuts):
            d, c = level % DIRECTIONS, at[node]
            right = target[:, d] >= c
            low[:, d] = np.where(right, np.maximum(low[:, d], c), low[:, d])
            high[:, d] = np.where(right, high[:, d], np.minimum(high[:, d], c))
            node = 2 * node + right
        self.limit = limits(threshold(np.maximum(np.maximum(low - p, p - high), 0), self.radius2))

    def visits(self, p: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the other cells that each visits, for squared distances ``bound`` that they have reached."""
        reach = np.maximum.accumulate(self.limit[:0:-1])[::-1]  # the most that any further gap may allow
        row, node, off = np.arange(len(p)), np.zeros(len(p), np.int64), np.zeros(p.shape)
        for level, at in enumerate(self.cuts):
            d = level % DIRECTIONS
            t = p[row, d] - at[node]
            near = 2 * node + (t >= 0)
            far = off.copy()
            far[:, d] = np.abs(t)
            crossed = (far > 0).sum(axis=1)
            go = (far * far).sum(axis=1) <= bound[row] * reach[np.maximum(crossed, 1) - 1]
            row, node, off = np.concatenate([row, row[go]]), np.concatenate([near, (near ^ 1)[go]]), np.concatenate([off, far[go]])
        away = node != self.home(p)[row]
        with np.errstate(invalid="ignore"):
            fits = (off * off).sum(axis=1) <= bound[row] * self.limit[(off > 0).sum(axis=1)]
        return row[away & fits], node[away & fits]


class Counts:
    """What a search has done, for measurements."""

    def __init__(self):
        self.compared = self.verified = 0


def search(tree: Tree, points: np.ndarray, point_ids: np.ndarray, asking: np.ndarray, asking_ids: np.ndarray, bound: np.ndarray, k: int, least: float, leaf: int, counts: Counts | None = None):
    """For the queries of a cell, up to ``k`` of its points: query ids, point ids, cosines to six decimals.

    ``bound``: the squared distance that each query has reached; it is tightened from leaf to leaf.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not len(points) or not len(asking):
        return none
    first, levels = len(tree.cuts), max(0, math.ceil(math.log2(len(points) / leaf)))
    pp = points @ tree.directions
    cuts = fit_levels(pp, first, levels)
    at = descend(pp, cuts, first)
    order = np.argsort(at, kind="stable")
    points, point_ids, pp = points[order], point_ids[order], pp[order]
    held = np.flatnonzero(np.bincount(at, minlength=1 << levels))
    begin = np.searchsorted(at[order], held)
    end = np.append(begin[1:], len(order))
    low, high = np.minimum.reduceat(pp, begin), np.maximum.reduceat(pp, begin)
    limit = np.full(DIRECTIONS + 1, np.inf)
    if len(held) > 1:  # the stopping threshold of this cell's leaves: neighbours simulated at the distances that some of its points have to their k-th best
        rng = np.random.default_rng(5)
        some = rng.permutation(len(pp))[:CALIBRATION // 16]
        dots = points[some] @ points.T
        far = min(k, len(points) - 1)
        d2 = np.repeat(np.clip(2 - 2 * np.partition(dots, -far - 1, axis=1)[:, -far - 1], 1e-9, tree.radius2), 16)
        some = np.repeat(some, 16)
        place = descend(pp[some] + rng.standard_normal((len(some), DIRECTIONS)) * np.sqrt(d2)[:, None], cuts, first)
        box = np.minimum(np.searchsorted(held, place), len(held) - 1)
        limit = limits(threshold(np.maximum(np.maximum(low[box] - pp[some], pp[some] - high[box]), 0), d2))

    grown = np.hstack([-2 * pp, np.einsum("ij,ij->i", pp, pp)[:, None], np.ones((len(pp), 1))]).astype(np.float32)
    leaves = begin, end, low, high, limit, grown
    found = [_ask(tree, points, point_ids, leaves, asking[s:s + AT_ONCE], asking_ids[s:s + AT_ONCE], bound[s:s + AT_ONCE], k, least, counts) for s in range(0, len(asking), AT_ONCE)]
    return tuple(np.concatenate(x) for x in zip(*found))


def _ask(tree: Tree, points: np.ndarray, point_ids: np.ndarray, leaves: tuple, asking: np.ndarray, asking_ids: np.ndarray, bound: np.ndarray, k: int, least: float, counts: Counts | None):
    """The search of some queries among the points, which lie leaf by leaf."""
    begin, end, low, high, limit, grown = leaves
    pq = asking @ tree.directions
    need = np.empty((len(pq), len(begin)), np.float32)  # the squared distance down to which a leaf must be visited
    for s in range(0, len(pq), 1024):
        x = pq[s:s + 1024, None, :]
        gap = np.maximum(np.maximum(low - x, x - high), 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            n = (gap * gap).sum(axis=2) / limit[(gap > 0).sum(axis=2)]
        need[s:s + 1024] = np.where(np.isnan(n), np.inf, n)
    turn = np.argsort(need, axis=1, kind="stable").astype(np.int32)
    need = np.take_along_axis(need, turn, axis=1)
    # one product gives |q|^2 - 2 q p + |p|^2 less the chi-square bound of q
    pq2 = np.einsum("ij,ij->i", pq, pq)
    pq = np.hstack([pq, np.ones((len(pq), 2))]).astype(np.float32)
    bound = np.minimum(bound, tree.radius2)
    best = np.full((len(pq), k), -2.0)
    who = np.full((len(pq), k), _NOBODY, np.int64)
    for j in range(len(begin)):
        active = np.flatnonzero(need[:, j] <= bound)
        if not len(active):
            break
        mine = turn[active, j]
        by = np.argsort(mine, kind="stable")
        active, mine = active[by], mine[by]
        starts = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
        hits = [], [], []
        for s, e in zip(starts, np.append(starts[1:], len(mine))):
            a, b = begin[mine[s]], end[mine[s]]
            for t in range(s, e, 8192):
                q = active[t:min(t + 8192, e)]
                left = pq[q]
                left[:, -1] = pq2[q] - bound[q] * tree.point_limit - 1e-4  # what rounding may add
                x, y = np.divmod(np.flatnonzero(left @ grown[a:b].T <= 0), b - a)
                if counts is not None:
                    counts.compared += len(q) * (b - a)
                    counts.verified += len(x)
                for u in range(0, len(x), 1 << 17):
                    i, p = q[x[u:u + (1 << 17)]], a + y[u:u + (1 << 17)]
                    cosine = np.einsum("ij,ij->i", asking[i], points[p])
                    rounded = np.round(cosine, 6)
                    good = (cosine >= least) & (asking_ids[i] != point_ids[p]) & (rounded >= best[i, -1])
                    for x_, y_ in zip(hits, (i[good], point_ids[p[good]], rounded[good])):
                        x_.append(y_)
        if not hits[0] or not sum(map(len, hits[0])):
            continue
        i, p, c = (np.concatenate(x) for x in hits)
        own = np.unique(i)
        i, p, c = np.concatenate([i, np.repeat(own, k)]), np.concatenate([p, who[own].ravel()]), np.concatenate([c, best[own].ravel()])
        by = np.lexsort((p, -c, i))
        i, p, c = i[by], p[by], c[by]
        nth = np.arange(len(i)) - np.searchsorted(i, i, "left")
        top = nth < k
        best[i[top], nth[top]], who[i[top], nth[top]] = c[top], p[top]
        full = own[best[own, -1] > -2]
        bound[full] = np.minimum(bound[full], 2 - 2 * (best[full, -1] - 1e-6))  # room for ties
    row, nth = np.nonzero(who != _NOBODY)
    return asking_ids[row], who[row, nth], best[row, nth]


def _matrix(column, dims: int) -> np.ndarray:
    """Unit vectors of a column of packed float32 vectors."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dims).astype(np.float64)
    return raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]


def usable(rows: DataFrame, vector_id: str, vector: str, position: str, dims: int) -> DataFrame:
    """``id, pos, vec, dir``: packed vectors that can take part, and a digest of their direction."""
    v = F.col(vector)
    infinity = F.lit(float("inf"))
    good = (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinity)) & F.exists(v, lambda x: x != 0)
    kept = rows.select(F.col(vector_id).cast("long").alias("id"), F.col(position).cast("long").alias("pos"), v.alias("v")).filter(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            # scaled by a power of two first: no overflow or underflow of the squares
            scaled = raw / np.exp2(np.floor(np.log2(np.abs(raw).max(axis=1))))[:, None] if len(raw) else raw
            unit = scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None] if len(raw) else raw
            digest = [hashlib.blake2b((np.round(u, 10) + 0.0).tobytes(), digest_size=16).digest() for u in unit]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in scaled.astype(np.float32)], pa.binary()), pa.array(digest, pa.binary())], names=["id", "pos", "vec", "dir"])

    return kept.mapInArrow(pack, "id long, pos long, vec binary, dir binary")


class _Source:
    """The packed vectors that count, all or about a ``share`` of them by their ids (chosen before anything is packed)."""

    def __init__(self, rows: DataFrame, vector_id: str, vector: str, position: str, dims: int):
        self.rows, self.ident, self.args = rows, F.col(vector_id).cast("long"), (vector_id, vector, position, dims)

    def packed(self, share: float = 1.0) -> DataFrame:
        chosen = F.pmod(F.xxhash64(self.ident, F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30))
        return usable(self.rows.filter(chosen) if share < 1 else self.rows, *self.args)

    def among(self, some: DataFrame, share: float = 1.0) -> DataFrame:
        """Those of ``some`` (``id, pos, dir`` and what else is wanted of them)."""
        return self.packed(share).join(some, ["id", "pos", "dir"])  # by broadcast while these few bytes a row are small enough


def _fit(source: _Source, reps: DataFrame, tree: Tree, total: int, depth: int, dims: int) -> None:
    """Split the space into ``2 ** depth`` cells of about the same number of vectors."""
    while len(tree.cuts) < depth:
        first = len(tree.cuts)
        levels = min(STEP_LEVELS, depth - first)
        sent = reps.sparkSession.sparkContext.broadcast(tree)  # eight bytes a node

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = sent.value
            for b in batches:
                p = _matrix(b.column(0), dims) @ t.directions
                yield pa.RecordBatch.from_arrays([pa.array(t.home(p), pa.int64()), pa.array([x.tobytes() for x in p], pa.binary())], names=["node", "p"])

        def split(key, table):
            p = np.frombuffer(b"".join(table.column("p").to_pylist())).reshape(-1, DIRECTIONS)
            return pa.table({"node": pa.array([key[0].as_py()], pa.int64()), "cuts": pa.array([np.concatenate(fit_levels(p, first, levels))], pa.list_(pa.float64()))})

        rows = source.among(reps, PER_CELL * 2 ** (first + levels) / total).select("vec").mapInArrow(project, "node long, p binary")
        found = {r.node: np.array(r.cuts) for r in rows.groupBy("node").applyInArrow(split, "node long, cuts array<double>").collect()}
        none = np.zeros((1 << levels) - 1)
        every = np.stack([found.get(n, none) for n in range(1 << first)])
        for i in range(levels):
            tree.cuts.append(every[:, (1 << i) - 1:(2 << i) - 1].ravel())


def _load(source: _Source, asks: DataFrame, tree: Tree, total: int, dims: int, asking: int) -> None:
    """Divide each cell's visitors into blocks, by the visits that a sample of the rows makes with its bounds."""
    share = min(1.0, PER_CELL * tree.cells / total)
    sent = asks.sparkSession.sparkContext.broadcast(tree)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        for b in batches:
            for s in range(0, len(b), 2048):
                part = b.slice(s, 2048)
                _, cell = t.visits(_matrix(part.column(0), dims) @ t.directions, part.column(1).to_numpy())
                ids, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["cell", "n"])

    visits = source.among(asks, share).select("vec", "bound").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # a row a cell
    tree.blocks = np.ones(tree.cells, np.int64)
    for r in visits:
        tree.blocks[r.cell] = max(1, math.ceil(r.n / share / asking))


def cell_size(total: int) -> int:
    """Mean vectors of a cell: with more vectors fewer copies travel if the cells are larger, up to what a task should hold."""
    return min(LARGE_CELL, max(CELL, 32 * math.isqrt(total)))


def _salt(ids: np.ndarray) -> np.ndarray:
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)


def _in_cells(placed: DataFrame, parts: int, sent, dims: int, k: int, least: float, leaf: int) -> DataFrame:
    """Search every cell: its points (role 0) and its queries (role 1; 2: both)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, rows = sent.value, list(batches)  # one cell
        if not rows or not sum(map(len, rows)):
            return
        table = pa.Table.from_batches(rows)
        role, ids, bound = (table.column(c).to_numpy() for c in ("role", "id", "bound"))
        _, one = np.unique(np.stack([ids, role]), axis=1, return_index=True)  # rows repeated exactly
        unit, role, ids, bound = _matrix(table.column("vec"), dims)[one], role[one], ids[one], bound[one]
        p, q = role != 1, role != 0
        a, b, c = search(t, unit[p], ids[p], unit[q], ids[q], bound[q], k, least, leaf)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], names=["a", "b", "cosine"])

    # a partition for each cell: hashing would put several into one task
    return placed.repartitionById(parts, F.col("cell").cast("int")).mapInArrow(run, "a long, b long, cosine double")


_PLACED = "cell long, role byte, id long, vec binary, bound double"


def _placed(cell, role, ids, vec, bound) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(role, pa.int8()), ids, vec, pa.array(bound, pa.float64())], names=["cell", "role", "id", "vec", "bound"])


def _links(source: _Source, reps: DataFrame, total: int, dims: int, k: int, least: float, cell: int | None, leaf: int, asking: int) -> DataFrame:
    """``a, b, cosine`` of the vectors found near each other, of those in ``reps`` (``id, pos, dir``)."""
    spark = reps.sparkSession
    tree = Tree(dims, 2 - 2 * least)
    depth = max(0, math.ceil(math.log2(total / (cell or cell_size(total)))))
    if depth:
        _fit(source, reps, tree, total, depth, dims)
        some = source.among(reps, 2 * CALIBRATION / total).select("vec").limit(CALIBRATION).toArrow()
        tree.calibrate(_matrix(some.column("vec"), dims) @ tree.directions)
    sent = spark.sparkContext.broadcast(tree)  # eight bytes a node: one for ``cell`` vectors
    radius2 = tree.radius2

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        for b in batches:
            own = t.home(_matrix(b.column(1), dims) @ t.directions)
            yield _placed(own, np.full(len(b), 2), b.column(0), b.column(1), np.full(len(b), radius2))

    found = _in_cells(source.among(reps).select("id", "vec").mapInArrow(at_home, _PLACED), tree.cells, sent, dims, k, least, leaf)
    if not depth:
        return found
    found = cut(found)
    reached = found.groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("c")).filter(F.col("n") >= k).select("id", (2 - 2 * (F.col("c") - 1e-6)).alias("bound"))
    asks = cut(reps.join(reached, "id", "left").select("id", "pos", "dir", F.coalesce(F.least("bound", F.lit(radius2)), F.lit(radius2)).alias("bound")))
    _load(source, asks, tree, total, dims, asking)
    sent = spark.sparkContext.broadcast(tree)
    begins = np.cumsum(tree.blocks) - tree.blocks

    def on_visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = sent.value
        for whole in batches:
            for s in range(0, len(whole), 2048):
                b = whole.slice(s, 2048)
                p, bound = _matrix(b.column(1), dims) @ t.directions, b.column(2).to_numpy()
                own = t.home(p)
                copies = t.blocks[own]
                point = np.repeat(np.arange(len(b)), copies)
                block = np.arange(len(point)) - np.repeat(np.cumsum(copies) - copies, copies)
                row, other = t.visits(p, bound)
                asked = begins[other] + _salt(b.column(0).to_numpy()[row]) % t.blocks[other]
                pick = np.concatenate([point, row])
                yield _placed(np.concatenate([begins[own[point]] + block, asked]), np.repeat([0, 1], [len(point), len(row)]), b.column(0).take(pa.array(pick)), b.column(1).take(pa.array(pick)), bound[pick])

    visited = source.among(asks).select("id", "vec", "bound").mapInArrow(on_visit, _PLACED)
    return found.unionByName(_in_cells(visited, int(tree.blocks.sum()), sent, dims, k, least, leaf))


def nearest(rows: DataFrame, vector_id: str, vector: str, position: str, *, dims: int = 64, k: int = 5, least: float = 0.90, cell: int | None = None, leaf: int = LEAF, asking: int = ASKING) -> DataFrame:
    """``id, other, cosine, rank_no``: up to ``k`` most similar vectors of every vector, with a cosine of ``least`` or more.

    ``cell``: mean vectors of a task's cell (``cell_size`` if None), ``leaf``: points of a leaf, ``asking``: visitors of a task. They set costs, not results.
    """
    spark = rows.sparkSession
    source = _Source(rows, vector_id, vector, position, dims)
    one = Window.partitionBy("id").orderBy("pos", "dir")
    by_id = Window.partitionBy("dir").orderBy("id")
    held = source.packed().select("id", "pos", "dir").withColumn("_n", F.row_number().over(one)).filter("_n = 1")
    held = cut(held.withColumn("nth", F.row_number().over(by_id)).select("id", "pos", "dir", "nth"))
    reps = held.filter("nth = 1").select("id", "pos", "dir")
    total = reps.count()
    if total == 0:
        return spark.createDataFrame([], "id long, other long, cosine double, rank_no int")
    found = _links(source, reps, total, dims, k, least, cell, leaf, asking)
    both = found.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"), "cosine").select("x.a", "x.b", "cosine")
    both = both.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))

    def first(d: DataFrame, n: int, by: str, ident: str) -> DataFrame:
        w = Window.partitionBy(by).orderBy(F.col("cosine").desc(), F.col(ident))
        return d.withColumn("rank_no", F.row_number().over(w)).filter(F.col("rank_no") <= n)

    linked = first(both, k, "a", "b").drop("rank_no")
    few = held.filter(F.col("nth") <= k + 1).select("id", "dir", "nth")  # the ids that stand for a class
    names = reps.select(F.col("id").alias("rep"), F.col("dir").alias("d"))
    # classes beside a class, then its own copies, as ids with a cosine
    near = linked.join(names.withColumnRenamed("rep", "b").withColumnRenamed("d", "bd"), "b").join(names.withColumnRenamed("rep", "a"), "a")
    others = near.join(few.select(F.col("dir").alias("bd"), F.col("id").alias("other")), "bd").select("d", "other", "cosine")
    copied = few.filter("nth = 2").select(F.col("dir").alias("d"))
    own = few.select(F.col("dir").alias("d"), F.col("id").alias("other"), F.lit(1.0).alias("cosine")).join(copied, "d", "left_semi")
    listed = first(others.unionByName(own), k + 1, "d", "other").drop("rank_no")
    every = held.select("id", F.col("dir").alias("d")).join(listed, "d").filter("id <> other").select("id", "other", "cosine")
    return first(every, k, "id", "other")


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """``a, b`` with a < b: pairs where one is among the most similar of the other."""
    return found.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
