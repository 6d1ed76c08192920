"""Exact rankings without a row per pair: lines of seeds over stored blocks of candidates.

Candidates are written once, by block, into the shared folder. A task holds a line of seeds and reads one block after the other, so only
results leave it. A single-precision product bounds every score; pairs that the bound can't settle are scored exactly (``pairs.halves``).
Metadata signals come from tables of genre sets and from look-ups of shared keys, not from a pass over all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

from ..config import Config
from . import pairs

#: Seeds that are compared with a block at a time, pairs that are scored exactly at a time.
STEP, EXACT = 128, 1 << 14
#: Columns that are scored at a time: a processor's cache holds the scores, and 255 words of flags add up without overflow.
TILE = 2040
#: Pairs that metadata could lift to a limit are looked up one by one where they are at most one in so many.
FEW = 32
#: Stands for no recording and no anime.
NONE = np.iinfo(np.int64).min


# --- sides of a comparison --------------------------------------------------------------------------------


def _keys(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().cast(pa.int64()).fill_null(NONE).to_numpy(zero_copy_only=False)


def _lists(table: pa.Table, name: str) -> "tuple[np.ndarray, pa.Array]":
    """Row numbers and values of a list column without nulls, every value once a row."""
    import pyarrow.compute as pc

    a = table[name].combine_chunks()
    at, values = pc.list_parent_indices(a), pc.list_flatten(a)
    if isinstance(at, pa.ChunkedArray):
        at, values = at.combine_chunks(), values.combine_chunks()
    known = pc.is_valid(values)
    return at.filter(known).to_numpy(zero_copy_only=False).astype(np.int64), values.filter(known)


@dataclass
class Keys:
    """Which rows hold which keys: ``key`` and ``row``, sorted by row; strings are numbered by ``names``."""

    row: np.ndarray
    key: np.ndarray
    names: dict | None = None

    @classmethod
    def of(cls, row: np.ndarray, values: pa.Array) -> "Keys":
        if pa.types.is_integer(values.type):
            return cls(row, values.cast(pa.int64()).to_numpy(zero_copy_only=False))
        d = values.dictionary_encode()
        return cls(row, d.indices.to_numpy(zero_copy_only=False).astype(np.int64), {x: i for i, x in enumerate(d.dictionary.to_pylist())})

    def at(self, new: np.ndarray) -> "Keys":
        """The same with rows renumbered: row i becomes ``new[i]``."""
        row = new[self.row]
        order = np.argsort(row, kind="stable")
        return Keys(row[order], self.key[order], self.names)

    def like(self, other: "Keys") -> "Keys":
        """The same by the other's numbers, without keys that the other hasn't."""
        if self.names is None or other.names is None:
            return self
        to = np.full(len(self.names) + 1, -1, np.int64)
        for x, i in self.names.items():
            to[i] = other.names.get(x, -1)
        key = to[self.key]
        return Keys(self.row[key >= 0], key[key >= 0])


class Shared:
    """Pairs of rows that share a key, worked out for a few rows of the left side at a time."""

    def __init__(self, left: Keys, right: Keys, width: int):
        self.left, self.width = left.like(right), width
        order = np.argsort(right.key, kind="stable")
        self.key, self.row = right.key[order], right.row[order]
        self.low, self.high = np.searchsorted(self.key, self.left.key), np.searchsorted(self.key, self.left.key, side="right")

    def of(self, s: int, e: int) -> np.ndarray:
        """Sorted places (row - s) * width + column of the pairs of rows s to e."""
        a, b = np.searchsorted(self.left.row, (s, e))
        low, n = self.low[a:b], self.high[a:b] - self.low[a:b]
        if not n.sum():
            return np.zeros(0, np.int64)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        found = np.sort(np.repeat((self.left.row[a:b] - s) * self.width, n) + self.row[np.repeat(low, n) + within])
        return found[np.append(True, found[1:] != found[:-1])]


def among(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which of ``x`` are among sorted ``places``."""
    if not len(places):
        return np.zeros(len(x), bool)
    return places[np.minimum(np.searchsorted(places, x), len(places) - 1)] == x


def places(flags: np.ndarray) -> "tuple[np.ndarray, np.ndarray]":
    """Rows and columns where a contiguous matrix of few true values is true, row by row: looked for in words of eight."""
    flat = flags.reshape(-1)
    n = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:n].view(np.uint64) != 0)
    at = np.flatnonzero(flat[:n].reshape(-1, 8)[words])
    at = words[at >> 3] * 8 + (at & 7)
    if n < len(flat):
        at = np.append(at, n + np.flatnonzero(flat[n:]))
    row = at // flags.shape[1]
    return row, at - row * flags.shape[1]


def tiles(low: int, high: int) -> "list[tuple[int, int]]":
    return [(x, min(x + TILE, high)) for x in range(low, high, TILE)]


class Rows:
    """Rows of a table as arrays. Seeds lie by genres and year; candidates by recording: first those of recordings with one row in
    the block (by genres), then the others (first row of each, second row, ...), then the rows of recordings that are spread over blocks."""

    def __init__(self, table: pa.Table, seeds: bool, carry: bool = False):
        theme, audio = _keys(table, "theme_id"), _keys(table, "audio_id")
        n = len(theme)
        hot = table["hot"].combine_chunks().to_numpy(zero_copy_only=False) if "hot" in table.column_names else np.zeros(n, bool)
        year = table["start_year"].combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False).astype(np.float64)
        row, values = _lists(table, "genres")
        genres = Keys.of(row, values)
        held = np.zeros((n, max(1, len(genres.names))), bool)
        held[genres.row, genres.key] = True
        packed = np.packbits(held, axis=1)
        _, first, kind = np.unique(np.ascontiguousarray(packed).view(f"V{packed.shape[1]}").ravel(), return_index=True, return_inverse=True)
        self.sets, self.names = held[first].astype(np.float64), genres.names
        if seeds:
            order = np.lexsort((theme, year, kind))
        else:
            order = self._by_recording(theme, audio, hot, kind)
        new = np.empty(n, np.int64)
        new[order] = np.arange(n)
        self.n, self.theme, self.audio, self.hot, self.year, self.kind = n, theme[order], audio[order], hot[order], year[order], kind[order]
        self.mal = _keys(table, "mal_id")[order]
        u = table["u"].combine_chunks()
        u = u.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)[order]
        self.upper, self.lower = pairs.halves(u)
        self.u32 = u.astype(np.float32)
        known = np.flatnonzero(self.mal != NONE)
        self.own, self.anime = Keys(np.arange(n), self.theme), Keys(known, self.mal[known])
        self.artists = Keys.of(*_lists(table, "artist_ids")).at(new)
        if carry:
            self.mbids, self.near = Keys.of(*_lists(table, "mbids")).at(new), Keys.of(*_lists(table, "near_mbids")).at(new)

    def _by_recording(self, theme: np.ndarray, audio: np.ndarray, hot: np.ndarray, kind: np.ndarray) -> np.ndarray:
        cold = np.flatnonzero(~hot)
        _, code, sizes = np.unique(audio[cold], return_inverse=True, return_counts=True)
        size = sizes[code]
        order = np.lexsort((theme[cold], code, -size))
        slot = self._slots(code[order])
        single = size[order] == 1
        alone, shared = order[single], order[~single]
        alone = alone[np.argsort(kind[cold[alone]], kind="stable")]
        slot = slot[~single]
        by_slot = np.argsort(slot, kind="stable")  # of each slot: recordings by falling number of rows
        counts = np.bincount(slot) if len(slot) else np.zeros(0, np.int64)
        self.singles, self.slots = len(alone), [int(x) for x in counts]
        warm = np.flatnonzero(hot)
        warm = warm[np.lexsort((theme[warm], audio[warm]))]
        self.cold = len(cold)
        return np.concatenate([cold[alone], cold[shared[by_slot]], warm])

    @staticmethod
    def _slots(code: np.ndarray) -> np.ndarray:
        """Place of each row within its run of equal codes."""
        starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        return np.arange(len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code))))

    def begins(self) -> np.ndarray:
        """First column of each slot, and the end."""
        return self.singles + np.append(0, np.cumsum(self.slots)).astype(np.int64)


def jaccards(a: Rows, b: Rows) -> np.ndarray:
    """Similarity of every genre set of ``a`` to every one of ``b``."""
    names = {x: i for i, x in enumerate(sorted({*a.names, *b.names}))}

    def spread(r: Rows) -> np.ndarray:
        out = np.zeros((len(r.sets), max(1, len(names))))
        for x, i in r.names.items():
            out[:, names[x]] = r.sets[:, i]
        return out

    own, other = spread(a), spread(b)
    inter = own @ other.T
    union = own.sum(1)[:, None] + other.sum(1) - inter
    return np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)


class Cell:
    """A line of seeds against a block of candidates. Without ``weights`` they aren't worked out where no score needs them."""

    def __init__(self, a: Rows, c: Rows, cfg: Config, scale: float, exclude_same: bool, weights: bool = True):
        self.a, self.c, self.cfg, self.scale, self.exclude_same = a, c, cfg, scale, exclude_same
        self.jaccard = jaccards(a, c)
        self.partners, self.same, self.self_ = Shared(a.artists, c.artists, c.n), Shared(a.anime, c.anime, c.n), Shared(a.own, c.own, c.n)
        #: Metadata's share of the final score, by which signals are multiplied.
        self.unit = scale * cfg.alpha_blend / (cfg.w_max if cfg.w_max > 0 else 1)
        self.weights = weights or bool(self.unit)
        self.room, self.flags = np.empty(STEP * c.n, np.float32), np.empty(STEP * c.n, bool)  # used by slice after slice
        self.eras: dict[float, np.ndarray] = {}
        self.closests: dict[tuple[int, int], np.ndarray] = {}

    def era(self, year: float) -> np.ndarray:
        """What nearness of years adds to the scores of a seed of ``year``."""
        if year not in self.eras:
            if len(self.eras) >= 128:
                self.eras.clear()
            with np.errstate(invalid="ignore"):
                self.eras[year] = (np.abs(self.c.year - year) <= self.cfg.era_window_years) * np.float32(self.unit * self.cfg.w_era)
        return self.eras[year]

    def closest(self, low: int, high: int) -> np.ndarray:
        """The largest similarity of each of the seeds' genre sets to one of the columns from ``low`` to ``high``."""
        if (low, high) not in self.closests:
            self.closests[low, high] = self.jaccard[:, np.unique(self.c.kind[low:high])].max(axis=1, initial=0)
        return self.closests[low, high]

    def slices(self) -> Iterator["Slice"]:
        for i, s in enumerate(range(0, self.a.n, STEP)):
            yield Slice(self, i, s, min(s + STEP, self.a.n))


def margin(dims: int, cfg: Config, scale: float) -> float:
    """What the single-precision score may differ from the exact one by, twice the bound for the sum of ``dims`` products."""
    most = abs(cfg.w_anime) + abs(cfg.w_artist) + abs(cfg.w_era) + abs(cfg.alpha_genre)
    return (dims + 16) * 2.0 ** -23 * (1 + abs(scale * cfg.alpha_blend) * most / (cfg.w_max if cfg.w_max > 0 else 1)) + 2e-9


class Slice:
    """Some seeds of a cell. Pairs are named by place: row * number of candidates + column."""

    def __init__(self, cell: Cell, i: int, s: int, e: int):
        self.cell, self.i, self.s, self.e, self.width = cell, i, s, e, cell.c.n
        itself = cell.self_.of(s, e)
        self.off = np.union1d(itself, self.same) if cell.exclude_same else itself

    @cached_property
    def partner(self) -> np.ndarray:
        return self.cell.partners.of(self.s, self.e)

    @cached_property
    def same(self) -> np.ndarray:
        return self.cell.same.of(self.s, self.e)

    @cached_property
    def _kinds(self) -> "tuple[np.ndarray, np.ndarray, np.ndarray]":
        """First rows of the runs of seeds with the same genres, their ends, and what genres add to the scores by the candidate's genre set."""
        cell, k = self.cell, self.cell.a.kind[self.s:self.e]
        new = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        return new, np.append(new[1:], len(k)), (cell.unit * cell.cfg.alpha_genre * cell.jaccard[k[new]]).astype(np.float32)

    @cached_property
    def _years(self) -> "list[tuple[int, int, float]]":
        """First rows, ends and years of the runs of seeds with the same known year."""
        y = self.cell.a.year[self.s:self.e]
        new = np.flatnonzero(np.append(True, y[1:] != y[:-1]))
        return [(p, q, y[p]) for p, q in zip(new, np.append(new[1:], len(y))) if not np.isnan(y[p])]

    def spare(self, low: int, high: int) -> np.ndarray:
        """What genres and nearness of years add to a seed's scores at most, of the columns from ``low`` to ``high``."""
        cell = self.cell
        genres = cell.unit * cell.cfg.alpha_genre * cell.closest(low, high)[cell.a.kind[self.s:self.e]]
        return np.maximum(genres, 0) + max(cell.unit * cell.cfg.w_era, 0) * ~np.isnan(cell.a.year[self.s:self.e])

    @cached_property
    def _added(self) -> "list[tuple[np.ndarray, np.ndarray, np.float32]]":
        """Rows and columns, by column, of the pairs whose scores something is added to, and what."""
        cell, out = self.cell, []
        more = [(self.partner, cell.unit * cell.cfg.w_artist), (self.same, cell.unit * cell.cfg.w_anime)] if cell.unit else []
        for where, x in [*more, (self.off, -np.inf)]:
            r, c = np.divmod(where, self.width)
            order = np.argsort(c, kind="stable")
            out.append((r[order], c[order], np.float32(x)))
        return out

    def bare(self, low: int = 0, high: int | None = None) -> np.ndarray:
        """Scores without what genres and nearness of years add, of all pairs (of the columns from ``low`` to ``high``) within ``margin``; -inf where not allowed. They hold until the next call."""
        cell, a, c = self.cell, self.cell.a, self.cell.c
        high = c.n if high is None else high
        out = cell.room[:(self.e - self.s) * (high - low)].reshape(self.e - self.s, high - low)
        np.matmul(a.u32[self.s:self.e], c.u32[low:high].T, out=out)
        for r, col, x in self._added:
            i, j = np.searchsorted(col, (low, high))
            out[r[i:j], col[i:j] - low] += x
        return out

    def dress(self, out: np.ndarray, low: int, high: int) -> None:
        """Add what genres and nearness of years do to the scores of ``bare``."""
        cell, kind = self.cell, self.cell.c.kind[low:high]
        bias = np.empty(high - low, np.float32)
        for p, q, t in zip(*self._kinds):
            np.take(t, kind, out=bias, mode="clip")
            out[p:q] += bias
        for p, q, year in self._years:
            out[p:q] += cell.era(year)[low:high]

    def near(self, low: int = 0, high: int | None = None) -> np.ndarray:
        """Whole scores of all pairs (of the columns from ``low`` to ``high``) within ``margin``; -inf where not allowed. They hold until the next call."""
        out = self.bare(low, high)
        if self.cell.unit:
            self.dress(out, low, low + out.shape[1])
        return out

    def reaching(self, low: int, high: int, limit: np.ndarray) -> "tuple[np.ndarray, np.ndarray]":
        """Rows and columns of the pairs (of the columns from ``low`` to ``high``) whose scores are ``limit`` of the row at least, within ``margin``.

        Genres and years are looked up for the few pairs that they could lift to the limit; for all pairs where these are many."""
        out, unit = self.bare(low, high), self.cell.unit
        flags = self.cell.flags[:out.size].reshape(out.shape)
        if not unit:
            r, c = places(np.greater_equal(out, limit[:, None], out=flags))
            return r, low + c
        np.greater_equal(out, (limit - self.spare(low, high) - 1e-6).astype(np.float32)[:, None], out=flags)
        if np.count_nonzero(flags) * FEW > flags.size:
            self.dress(out, low, high)
            r, c = places(np.greater_equal(out, limit[:, None], out=flags))
            return r, low + c
        r, c = places(flags)
        x = out[r, c]
        c = low + c
        jaccard, era = self.alike(r, c)
        lifted = x + unit * (self.cell.cfg.alpha_genre * jaccard + self.cell.cfg.w_era * era) >= limit[r]
        return r[lifted], c[lifted]

    def approximate(self, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The same for single pairs."""
        x = np.empty(len(r), np.float64)
        for at in range(0, len(r), EXACT):
            p = slice(at, at + EXACT)
            x[p] = np.einsum("ij,ij->i", self.cell.a.u32[self.s + r[p]], self.cell.c.u32[c[p]])
        return x + self.cell.unit * self.signals(r, c)[0] if self.cell.unit else x

    def alike(self, r: np.ndarray, c: np.ndarray) -> "tuple[np.ndarray, np.ndarray]":
        """Jaccard similarity and whether the years are near."""
        cell = self.cell
        with np.errstate(invalid="ignore"):
            era = np.abs(cell.a.year[self.s + r] - cell.c.year[c]) <= cell.cfg.era_window_years
        return cell.jaccard[cell.a.kind[self.s + r], cell.c.kind[c]], era

    def signals(self, r: np.ndarray, c: np.ndarray) -> "tuple[np.ndarray, np.ndarray, np.ndarray]":
        """Sum of the weighted signals (0 if nothing needs it), Jaccard similarity and whether the years are near."""
        cfg, place = self.cell.cfg, r * self.width + c
        jaccard, era = self.alike(r, c)
        if not self.cell.weights:
            return np.zeros(len(r)), jaccard, era
        return cfg.w_anime * among(place, self.same) + cfg.w_artist * among(place, self.partner) + cfg.w_era * era + cfg.alpha_genre * jaccard, jaccard, era

    def exact(self, r: np.ndarray, c: np.ndarray) -> dict[str, np.ndarray]:
        """Exact scores and what results need of single pairs."""
        cell, a, b = self.cell, self.cell.a, self.cell.c
        cosine = np.empty(len(r))
        for at in range(0, len(r), EXACT):
            i, j = self.s + r[at:at + EXACT], c[at:at + EXACT]
            up, low, other_up, other_low = a.upper[i], a.lower[i], b.upper[j], b.lower[j]
            cosine[at:at + EXACT] = np.einsum("ij,ij->i", up, other_up) + (np.einsum("ij,ij->i", up, other_low) + np.einsum("ij,ij->i", low, other_up))
        weight, jaccard, era = self.signals(r, c)
        if cell.cfg.w_max > 0:
            weight = weight / cell.cfg.w_max
        raw = cosine + cell.scale * cell.cfg.alpha_blend * weight
        return {"row": r, "column": c, "final": np.round(raw, 9), "theme": b.theme[c], "mal": b.mal[c], "audio": b.audio[c], "hot": b.hot[c], "cosine": cosine, "weight": weight, "raw": raw, "jaccard": jaccard, "era": era.astype(float)}


# --- the first few of each seed ----------------------------------------------------------------------------


def take(found: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[which] for k, v in found.items()}


def join(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _places(*keys: np.ndarray) -> np.ndarray:
    """Place of each row among those with the same keys, in the rows' order."""
    order = np.lexsort(keys[::-1])
    new = np.append(True, np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)) if len(order) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return out


def firsts(found: dict[str, np.ndarray], *keys: str) -> dict[str, np.ndarray]:
    """The best of each combination of keys, the smallest theme_id among equals."""
    f = take(found, np.lexsort((found["theme"], -found["final"], found["row"])))
    return take(f, _places(*[f[k] for k in keys]) == 0)


class First:
    """The first ``k`` candidates of each seed of a line, over blocks: the best row of each recording, then at most ``cap`` an anime.

    Rows of a recording that is spread over blocks are kept apart until the end (the best of each), as they take no other's place before they are known to be the best.
    What scores below the k-th of the others can't be among the first."""

    def __init__(self, n: int, k: int, dedup: bool, cap: int | None, margin: float):
        self.k, self.dedup, self.cap, self.margin = k, dedup, cap, margin
        self.least = np.full(n, -np.inf)
        self.held: dict[int, dict[str, np.ndarray]] = {}

    def reduce(self, found: dict[str, np.ndarray], last: bool = False) -> dict[str, np.ndarray]:
        f = take(found, np.lexsort((found["theme"], -found["final"], found["row"])))
        if self.dedup:
            f = take(f, _places(f["row"], f["audio"]) == 0)
        apart = f["hot"] & self.dedup & (not last)
        hot, f = take(f, apart), take(f, ~apart)
        if self.cap:
            f = take(f, _places(f["row"], f["mal"]) < self.cap)
        place = _places(f["row"])
        f = take(f | {"place": place}, place < self.k)
        return f if last else join([f, hot | {"place": np.full(len(hot["row"]), -1)}])

    def search(self, s: Slice) -> None:
        """Take in a slice's candidates, some columns at a time if all of its seeds have enough so far."""
        if self.few(s):
            self.offer(s, s.near())
            return
        limit = self.limit(s)
        self.add(s, [s.reaching(low, high, limit) for low, high in tiles(0, s.width)])

    def few(self, s: Slice) -> bool:
        """Whether some seeds of the slice have fewer than ``k`` candidates so far."""
        return bool(np.isneginf(self.least[s.s:s.e]).any())

    def limit(self, s: Slice) -> np.ndarray:
        """The score from which a candidate may be among the first, of the seeds that have enough so far."""
        with np.errstate(over="ignore"):
            limit = (self.least[s.s:s.e] - self.margin).astype(np.float32)
        limit[np.isneginf(limit)] = np.inf
        return limit

    def add(self, s: Slice, found: "list[tuple[np.ndarray, np.ndarray]]") -> None:
        """Take in candidates, given as rows and columns."""
        r, c = (np.concatenate(x) for x in zip(*found))
        if len(r):
            self._keep(s, s.exact(r, c))

    def offer(self, s: Slice, near: np.ndarray) -> None:
        least = self.least[s.s:s.e]
        self.add(s, [places(np.greater_equal(near, self.limit(s)[:, None], out=s.cell.flags[:near.size].reshape(near.shape)))])
        todo, want = np.flatnonzero(np.isneginf(least)), 2 * self.k + 16
        while len(todo):  # too few so far: the best of the block, more of them where recordings and caps leave too few
            few = near[todo] if len(todo) < len(near) else near
            floor = np.partition(few, s.width - want, axis=1)[:, s.width - want] if want < s.width else np.full(len(todo), -np.inf, np.float32)
            r, c = places(few >= np.maximum(floor, np.finfo(np.float32).min)[:, None])
            if len(r):
                self._keep(s, s.exact(todo[r], c))
            done = (self.least[s.s + todo] >= floor.astype(np.float64) + 2 * self.margin) | np.isneginf(floor)
            todo, want = todo[~done], want * 4

    def _keep(self, s: Slice, new: dict[str, np.ndarray]) -> None:
        new.pop("column")
        old = self.held.get(s.i)
        if old is not None:
            new = join([{k: v for k, v in old.items() if k != "place"}, new])
            if not self.dedup:  # offered twice
                order = np.lexsort((new["theme"], new["row"]))
                t, r = new["theme"][order], new["row"][order]
                new = take(new, order[np.append(True, (t[1:] != t[:-1]) | (r[1:] != r[:-1]))])
        self.held[s.i] = f = self.reduce(new)
        full = f["place"] == self.k - 1
        self.least[s.s + f["row"][full]] = f["final"][full]

    def results(self) -> Iterator[dict[str, np.ndarray]]:
        """The first of each slice's seeds in their order, with rows numbered within the line."""
        for i, f in self.held.items():
            f = self.reduce({x: v for x, v in f.items() if x != "place"}, last=True)
            yield f | {"row": f["row"] + i * STEP}
