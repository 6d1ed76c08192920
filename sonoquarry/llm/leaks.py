"""Evaluation texts that leak into training texts (problem 7), by latent semantic retrieval.

1. Texts are folded to words (see ``folding``); each document is encoded once as the ids of the words that the items
   use, whatever their number, and written to the shared folder.
2. Document frequencies are counted over all documents.
3. The items' TF-IDF passages, made where the items are read, get a randomised SVD whose products are summed over the
   partitions; the right vectors map any passage to a latent space of low rank.
4. Every window of every document is mapped there and compared by cosine with all item passages.
   Windows overlap so that a leak of ``least`` words lies in one of them but for two words at most.
5. Each pair found is checked: first whether enough of the item's words stand close together, then
   by a longest common subsequence in the limits of the definition: at least ``least`` item words in
   order, at most one in eight changed, added or dropped.
6. Where items have answers (``item_answer``), the closest of the remaining pairs are looked at as paraphrases: the longest common subsequence
   without limits must hold a share of the window, and the answer's words must stand in the stretch one behind the other.

A leak always contains a part of at most 31 item words with at most three edits (cut it into spans of
16 and one last longer one: were every span over its share, so would be the whole), so the check
looks at those only, and items longer than ``PART`` words are searched as parts that overlap by more than that. Item parts are taken in blocks
of ``passages_at_once`` passages, which bounds what is sent to every executor; each block is a pass over the encoded ids. Items of more than ``group_chars``
characters in all are encoded against in groups. Nothing grows with the corpus outside Spark.

Defined results: null, empty and short texts and items leak nothing. Repeated documents each count, as do items
with the same text. Rows without an id are left out. Empty inputs give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .folding import Words, vocabulary
from .pretokens import slices

#: Words in a window and between the starts of neighbouring windows (documents, items).
WINDOW, STEP, ITEM_STEP = 24, 12, 8
RANK, COSINE = 128, 0.60
#: Words beside a window that the check looks at; words of an item's part and those that neighbouring parts share.
MARGIN, PART, SHARED = 24, 256, 40
#: A paraphrase's least cosine, and the share of a window's words that it has in common with the item in order.
PARAPHRASE, COMMON = 0.75, 0.5
_NONE = -99


def window_starts(n: int, step: int) -> np.ndarray:
    """Starts of the windows that cover ``n`` words."""
    return np.append(np.arange(0, max(n - WINDOW, 0), step), max(n - WINDOW, 0))


def passages(item_ids: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The items' windows, and the item of each."""
    parts, owner = [], []
    for k, ids in enumerate(item_ids):
        for a in window_starts(len(ids), ITEM_STEP) if len(ids) else ():
            parts.append(ids[a:a + WINDOW])
            owner.append(k)
    return parts, np.array(owner, np.int32)


def weigh(parts: list[np.ndarray], idf: np.ndarray) -> np.ndarray:
    """Dense TF-IDF rows of a few passages."""
    out = np.zeros((len(parts), len(idf)), np.float32)
    for row, ids in zip(out, parts):
        np.add.at(row, ids[ids >= 0], idf[ids[ids >= 0]])
    return out


def randomised_svd(rows: DataFrame, idf: np.ndarray, rank: int, rounds: int = 2, seed: int = 0) -> np.ndarray:
    """Right singular vectors (words x rank) of the TF-IDF matrix of ``rows`` (``ids array<int>``, a passage each).

    Each round multiplies a random range by A^T A: every partition sends only its words x rank product,
    summed by word, so the passages may be many and are never collected.
    """
    words = len(idf)
    width = min(rank + 10, words)
    basis = np.random.default_rng(seed).standard_normal((words, width)).astype(np.float32)

    def product(q: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((words, q.shape[1]), np.float32)
            for b in batches:
                lists = b.column(0).to_pylist()
                for s in range(0, len(lists), 512):
                    a = weigh([np.array(x, np.int64) for x in lists[s:s + 512]], idf)
                    total += a.T @ (a @ q)
            used = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(list(total[used]), pa.list_(pa.float32()))], names=["word", "v"])

        parts = rows.mapInArrow(run, "word int, v array<float>")
        out = np.zeros((words, q.shape[1]))
        for w, v in _sum_vectors(parts):
            out[w] = v
        return out

    for _ in range(rounds):
        basis, _r = np.linalg.qr(product(basis))
        basis = basis.astype(np.float32)
    small = basis.T @ product(basis)  # Q^T A^T A Q
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(values)[::-1][:min(rank, int((values > 1e-6 * max(values.max(), 1e-30)).sum()) or 1)]
    return (basis @ vectors[:, best]).astype(np.float32)


def _sum_vectors(parts: DataFrame) -> list[tuple[int, np.ndarray]]:
    """Sum of the vectors of each word; bounded by words x width."""
    def run(key, table):
        total = np.sum(np.stack([np.array(x, np.float64) for x in table.column("v").to_pylist()]), axis=0)
        return pa.table({"word": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([total.tolist()], pa.list_(pa.float64()))})

    return [(r.word, np.array(r.v)) for r in parts.groupBy("word").applyInArrow(run, "word int, v array<double>").collect()]


def leaked(region: np.ndarray, items: np.ndarray, least: int = 16) -> np.ndarray:
    """For pairs of a stretch of document words and an item (both padded with different negative ids):
    whether the stretch holds ``least`` or more item words in order with at most one in eight edited.

    ``reach[e, j]`` is the most item words that an alignment ending at item word j has taken with e edits.
    """
    pairs, width = items.shape
    edits = 3
    reach = np.full((edits + 1, pairs, width + 1), _NONE, np.int16)
    done = np.zeros(pairs, bool)
    need = [max(least, 8 * e) for e in range(edits + 1)]
    for x in region.T:
        same = items == x[:, None]
        new = np.full_like(reach, _NONE)
        for e in range(edits + 1):
            taken = reach[e, :, :-1] + 1
            if e == 0:
                taken = np.maximum(taken, 1)  # an alignment may begin with any equal word
            new[e, :, 1:] = np.where(same, taken, _NONE)
            if e:
                step = np.maximum(reach[e - 1, :, :-1], new[e - 1, :, :-1]) + 1  # changed or dropped
                new[e, :, 1:] = np.maximum(new[e, :, 1:], step)
                new[e] = np.maximum(new[e], reach[e - 1])  # added
        reach = new
        for e in range(edits + 1):
            done |= reach[e].max(axis=1) >= need[e]
    return done


def common(region: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each stretch and item (padded with different negative ids)."""
    got = np.zeros((len(items), items.shape[1] + 1), np.int16)
    for x in region.T:
        same = items == x[:, None]
        got[:, 1:] = np.maximum.accumulate(np.where(same, got[:, :-1] + 1, got[:, 1:]), axis=1)
    return got[:, -1]


def answered(region: np.ndarray, answer: np.ndarray) -> bool:
    """Whether the words of an answer stand in a stretch, one behind the other."""
    n = len(answer)
    if not n or n > len(region):
        return False
    return bool((np.lib.stride_tricks.sliding_window_view(region, n) == answer).all(axis=1).any())


def in_parts(ids: np.ndarray) -> list[np.ndarray]:
    """An item's words in parts of ``PART`` that share ``SHARED``: any leak's decisive span lies in one of them."""
    return [ids[a:a + PART] for a in range(0, max(len(ids) - SHARED, 1), PART - SHARED)]


class Search:
    """The part of the search that runs on one batch of documents, for one block of item parts."""

    def __init__(self, item_ids: list[np.ndarray], vectors: np.ndarray, idf: np.ndarray, least: int, cosine: float, answers: list[np.ndarray] | None = None):
        self.least, self.cosine, self.answers = least, cosine, answers
        words = len(idf)
        parts, self.owner = passages(item_ids)
        latent = weigh(parts, idf) @ vectors
        self.latent = np.ascontiguousarray((latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).T)
        self.map = np.vstack([vectors * idf[:, None], np.zeros((1, vectors.shape[1]), np.float32)]).astype(np.float32)
        # the words of each part, as sorted keys
        self.words = words + 1
        self.held = np.unique(np.concatenate([k * self.words + ids.astype(np.int64) for k, ids in enumerate(item_ids)]))
        self.items = np.full((len(item_ids), max(map(len, item_ids))), -3, np.int32)
        for k, ids in enumerate(item_ids):
            self.items[k, :len(ids)] = ids

    def candidates(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, window start and item of every window and item whose passages are close enough."""
        rows, starts = [], []
        length = np.diff(first)
        for r in np.flatnonzero(length >= self.least - 3):
            a = window_starts(length[r], STEP) + first[r]
            starts.append(a)
            rows.append(np.full(len(a), r))
        none = np.zeros(0, np.int64)
        if not rows:
            return none, none, none
        row, start = np.concatenate(rows), np.concatenate(starts)
        # a window with a leak holds at least so many of the items' words
        held = np.concatenate([[0], np.cumsum(ids >= 0)])
        stop = np.minimum(start + WINDOW, first[row + 1])
        rich = held[stop] - held[start] >= self.least - 5
        row, start, stop = row[rich], start[rich], stop[rich]
        found = [], [], []
        step = max(256, min(8192, (1 << 25) // self.latent.shape[1]))
        for s in range(0, len(row), step):
            a, b = start[s:s + step], stop[s:s + step]
            latent = np.zeros((len(a), self.map.shape[1]), np.float32)
            for k in range(WINDOW):
                at = a + k
                latent += self.map[np.where(at < b, ids[np.minimum(at, len(ids) - 1)], -1)]
            latent /= np.maximum(np.sqrt(np.einsum("ij,ij->i", latent, latent)), 1e-9)[:, None]
            i, j = np.divmod(np.flatnonzero((latent @ self.latent).ravel() >= self.cosine), self.latent.shape[1])
            found[0].append(row[s + i])
            found[1].append(a[i])
            found[2].append(self.owner[j].astype(np.int64))
        return tuple(np.concatenate(x) for x in found) if found[0] else (none, none, none)

    def pairs(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and item parts (two columns, each pair once) of the leaks among the candidates, and of the paraphrases."""
        row, start, item = self.candidates(ids, first)
        keys = np.unique(np.stack([row, start, item], 1), axis=0) if len(row) else np.zeros((0, 3), np.int64)
        hits, told = [], []
        span = WINDOW + 2 * MARGIN
        offset = np.arange(-MARGIN, WINDOW + MARGIN)
        for s in range(0, len(keys), 65536):
            r, a, k = keys[s:s + 65536].T
            at = a[:, None] + offset
            inside = (at >= first[r][:, None]) & (at < first[r + 1][:, None])
            region = np.where(inside, ids[np.clip(at, 0, len(ids) - 1)], -1)
            wanted = k[:, None] * self.words + region
            near = (region >= 0) & (self.held[np.minimum(np.searchsorted(self.held, wanted), len(self.held) - 1)] == wanted)
            count = np.concatenate([np.zeros((len(k), 1), np.int16), np.cumsum(near, axis=1, dtype=np.int16)], axis=1)
            size = self.least + 2
            dense = (count[:, size:] - count[:, :-size]).max(axis=1) >= self.least - 2 if span >= size else near.any(1)
            hits.append((r[dense], k[dense], region[dense]))
            if self.answers is not None:
                told.append(self._told(r, k, region))
        if not hits:
            return np.zeros((0, 2), np.int64), np.zeros((0, 2), np.int64)
        r, k, region = (np.concatenate(x) for x in zip(*hits))
        good = np.zeros(len(r), bool)
        for s in range(0, len(r), 512):
            good[s:s + 512] = leaked(region[s:s + 512], self.items[k[s:s + 512]], self.least)
        return np.unique(np.stack([r[good], k[good]], 1), axis=0), np.concatenate(told) if told else np.zeros((0, 2), np.int64)

    def _told(self, r: np.ndarray, k: np.ndarray, region: np.ndarray) -> np.ndarray:
        """Of candidates: those that have enough in common with the item and hold its answer."""
        window = region[:, MARGIN:MARGIN + WINDOW]
        latent = self.map[window].sum(axis=1)
        latent /= np.maximum(np.linalg.norm(latent, axis=1), 1e-9)[:, None]
        close = np.zeros(len(k))
        np.maximum.at(close, np.arange(len(k)), [float((latent[i] @ self.latent[:, self.owner == x]).max()) for i, x in enumerate(k.tolist())])
        own = [i for i in np.flatnonzero(close >= PARAPHRASE).tolist() if answered(region[i], self.answers[k[i]])]
        if not own:
            return np.zeros((0, 2), np.int64)
        enough = common(window[own], self.items[k[own]]) >= COMMON * (window[own] > -2).sum(axis=1)
        return np.stack([r[own], k[own]], 1)[enough]


def _word_ids(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """``doc_id, ids`` (16- or 32-bit ids of the items' words, -1 for others) and a row per part with document frequencies (null ``doc_id``)."""
    kind = np.int16 if len(known) < 32767 else np.int32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, n = np.zeros(len(known), np.int64), 0
        for rows in (part for b in batches for part in slices(b, 1)):
            words = Words(rows.column(1))
            ids, first = words.ids(known), words.row_first
            n += len(rows)
            doc = np.repeat(np.arange(len(rows), dtype=np.int64), np.diff(first))
            seen = np.unique(doc[ids >= 0] * len(known) + ids[ids >= 0])
            count += np.bincount(seen % max(len(known), 1), minlength=len(known))
            packed = ids.astype(kind)
            offsets = (first * packed.itemsize).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays([rows.column(0), binary], names=["doc_id", "ids"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([np.append(count, n).tobytes()], pa.binary())], names=["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id long, ids binary")


def _frequencies(coded: DataFrame, words: int) -> np.ndarray:
    """Document frequency of each word, and the number of documents behind them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(words + 1, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(words + 1), pa.int32()), pa.array(total, pa.int64())], names=["word", "n"])

    rows = coded.filter("doc_id is null").select("ids").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(words + 1, np.int64)
    for r in rows:
        out[r.word] = r.n
    return out


def find_leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text",
    *, item_answer: str | None = None, least: int = 16, rank: int = RANK, cosine: float = COSINE, passages_at_once: int = 65536, group_chars: int = 16_000_000,
) -> DataFrame:
    """``doc_id, item_id`` of every document that holds a passage of an item (see the module's text).

    With ``item_answer``, a column of ``items``, also ``kind``: ``passage``, or ``paraphrase`` for a rewritten passage with the item's answer.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).cast("string").alias("text")).filter("doc_id is not null")
    answer = F.col(item_answer).cast("string") if item_answer else F.lit(None).cast("string")
    held = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"), answer.alias("answer")).filter("item_id is not null and text is not null")
    groups = max(1, -(-(held.agg(F.sum(F.length("text"))).first()[0] or 0) // group_chars))
    found = None
    for g in range(groups):
        own = held.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g) if groups > 1 else held
        for part in _group(d, own, least, rank, cosine, passages_at_once, item_answer is not None):
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], "doc_id long, item_id long, kind string")
    return found.groupBy("doc_id", "item_id").agg(F.min("kind").alias("kind")) if item_answer else found.select("doc_id", "item_id").distinct()


def _group(d: DataFrame, items: DataFrame, least: int, rank: int, cosine: float, at_once: int, with_answers: bool) -> Iterator[DataFrame]:
    """One encoding of the documents, and a search for each block of the group's item parts."""
    spark = d.sparkSession
    rows = items.orderBy("item_id", "text").collect()  # bounded by ``group_chars``
    known, both = vocabulary([r.text for r in rows] + [r.answer for r in rows])
    whole, answers = both[:len(rows)], both[len(rows):]
    parts, names, told = [], [], []
    for r, ids, answer in zip(rows, whole, answers):
        for part in in_parts(ids) if len(ids) >= least else ():
            parts.append(part)
            names.append(r.item_id)
            told.append(answer)
    if not parts:
        return
    coded = cut(_word_ids(d, known))
    counts = _frequencies(coded, len(known))
    idf = (np.log((counts[-1] + 1) / (counts[:-1] + 1)) + 1).astype(np.float32)
    vectors = randomised_svd(cut(_passages(items, spark.sparkContext.broadcast(known), least)), idf, rank)
    kind = np.int16 if len(known) < 32767 else np.int32
    sizes = np.cumsum([len(window_starts(len(p), ITEM_STEP)) for p in parts])
    block = (sizes - 1) // at_once
    for b in np.unique(block):
        pick = np.flatnonzero(block == b)
        made = spark.sparkContext.broadcast(([parts[k] for k in pick], [told[k] for k in pick] if with_answers else None, [names[k] for k in pick], vectors, idf))  # bounded by the block

        def run(batches: Iterator[pa.RecordBatch], made=made) -> Iterator[pa.RecordBatch]:
            ids_of, answers_of, own, v, w = made.value
            search, own = Search(ids_of, v, w, least, cosine, answers_of), np.array(own, np.int64)
            for batch in batches:
                for rows in slices(batch, 1, 1 << 20):
                    lists = rows.column(1)
                    sizes = np.array([len(x) // np.dtype(kind).itemsize for x in lists.to_pylist()], np.int64)
                    ids = np.frombuffer(b"".join(lists.to_pylist()), kind).astype(np.int64)
                    for name, got in zip(("passage", "paraphrase"), search.pairs(ids, np.concatenate([[0], np.cumsum(sizes)]))):
                        yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(got[:, 0])), pa.array(own[got[:, 1]], pa.int64()), pa.array([name] * len(got), pa.string())], names=["doc_id", "item_id", "kind"])

        yield coded.filter("doc_id is not null").mapInArrow(run, "doc_id long, item_id long, kind string")


def _passages(items: DataFrame, known, least: int) -> DataFrame:
    """``ids array<int>``: the passages of all item parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = Words(b.column(0))
            ids = words.ids(known.value)
            whole = [ids[a:e] for a, e in zip(words.row_first, words.row_first[1:]) if e - a >= least]
            made, _ = passages([p for w in whole for p in in_parts(w)])
            yield pa.RecordBatch.from_arrays([pa.array([p.tolist() for p in made], pa.list_(pa.int32()))], names=["ids"])

    return items.select("text").mapInArrow(run, "ids array<int>")
