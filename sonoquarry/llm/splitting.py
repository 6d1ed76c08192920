"""Splitting of oversized texts at natural boundaries with an overlap (problem 8).

Sizes are tokens of a public byte-level vocabulary. A text that is too large becomes atomic segments;
pairs of neighbours wait in a heap and the weakest boundary is merged first while the combined size
plus the overlap fits. Boundaries, strongest first: paragraph, line, sentence, clause, word, other
place between pre-tokens, between tokens.

Merging by strength joins all words of a sentence that fits before any sentence end is looked at.
So a segment starts as a whole sentence, and only one that is too large is taken apart into its
clauses, then words and so on, which gives the same pieces with fewer segments. Among equal
boundaries the pair with the smaller combined size merges first, then the earlier.

A piece holds the tokens from ``start_token`` to ``end_token``; every piece but the first begins
``overlap`` tokens before the end of the piece before it, so neighbours share exactly that many
(all of the piece before, should it be shorter). The token ranges without overlap tile the text.

Defined results: null and empty texts give no piece; a text within the limit is one piece. A piece
that begins or ends inside a character shows U+FFFD there in ``text``. A limit not above the overlap: ValueError.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _path, held
from .pretokens import SPACE, Batch, classes, slices

PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, PIECE, TOKEN = 6, 5, 4, 3, 2, 1, 0
NAMES = ("token", "piece", "word", "clause", "sentence", "line", "paragraph", "text")

# Characters that end sentences and clauses, and those that may close them.
_ENDS = ".!?…"
_ENDS_WIDE = "。！？"
_CLAUSE = ",;:—–"
_CLAUSE_WIDE = "、，；："
_CLOSERS = "\"'”’»)]」』）】"
# Tags that begin or end a block of text, abbreviations that a name follows, and a number.
_BLOCKS = frozenset("address article aside blockquote body br caption dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
_SHORT = ("mr", "mrs", "ms", "dr", "prof", "rev", "hon", "st", "mt", "ft", "feat", "vs", "cf", "ca", "approx", "gen", "col", "capt", "sgt", "lt", "gov", "sen", "rep", "messrs")
_NUMBERED = ("no", "nr", "nos", "vol", "fig", "ep", "ch", "pp", "op", "sec", "eq", "art")


def _codes(chars: str) -> np.ndarray:
    return np.array([ord(c) for c in chars], np.uint32)


def _word_code(letters: np.ndarray) -> np.ndarray:
    """Numbers for words of at most 6 letters in lower case (rows of code points, 0 before the word)."""
    low = np.where((letters >= 65) & (letters <= 90), letters + 32, letters).astype(np.int64)
    digit = np.where((low >= 97) & (low <= 122), low - 96, np.where(low == 0, 0, 31))
    return digit @ (32 ** np.arange(letters.shape[1] - 1, -1, -1, dtype=np.int64))


def after_blocks(batch: Batch) -> np.ndarray:
    """Whether each character closes a tag that begins or ends a block (or an inline tag straight behind one)."""
    cp = batch.cp
    out = np.zeros(len(cp), bool)
    close = np.flatnonzero(cp == ord(">"))
    if not len(close):
        return out
    place = np.arange(len(cp))
    opened = np.maximum.accumulate(np.where(cp == ord("<"), place, -1))[close]
    first = batch.doc_at[np.searchsorted(batch.doc_at, close, "right") - 1]
    good = (opened >= first) & (opened > np.append(-1, close[:-1])) & (close - opened < 4096)
    last, flagged = -1, False
    for a, b in zip(opened[good].tolist(), close[good].tolist()):
        head = "".join(map(chr, cp[a + 1:min(b, a + 14)].tolist()))
        name = head.lstrip("/").split(" ")[0].split("/")[0].split("\n")[0]
        if not name[:1].isalpha():
            continue  # a comparison or an arrow
        inner = cp[a + 1:b]
        if " " in head.strip("/ ") and not (inner == ord("=")).any():
            continue
        flagged = name.lower() in _BLOCKS or flagged and a == last + 1
        last = b
        out[b] = flagged
    return out


def _abbreviated(batch: Batch, dot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of full stops: whether an initial or a known abbreviation stands before, and whether a dotted one (p.m.) does."""
    cp = batch.cp
    letter = classes()[cp] == 0
    place = np.arange(len(cp))
    edge = np.where(letter, -1, place)
    begins = batch.doc_at[:-1][batch.doc_at[:-1] < len(cp)]
    edge[begins] = np.where(letter[begins], begins - 1, begins)
    gap = np.maximum.accumulate(edge)[np.maximum(dot - 1, 0)]
    size = dot - 1 - gap
    back = dot[:, None] - np.arange(6, 0, -1)
    word = np.where(back > gap[:, None], cp[np.maximum(back, 0)], 0)
    code = _word_code(word)

    def among(words: tuple[str, ...]) -> np.ndarray:
        return np.isin(code, _word_code(np.array([[0] * (6 - len(w)) + [ord(c) for c in w] for w in words])))

    number = classes()[cp[np.minimum(dot + 2, len(cp) - 1)]] == 1
    dotted = (size == 1) & (gap >= 1) & (cp[np.maximum(gap, 0)] == ord(".")) & letter[np.maximum(gap - 1, 0)]
    return ((size == 1) & ~dotted) | (size > 1) & (size <= 6) & (among(_SHORT) | among(_NUMBERED) & number), dotted


def strengths(batch: Batch) -> np.ndarray:
    """Strength of the boundary before each pre-token (within its text).

    Full stops behind initials and titles end no sentence, those of dotted abbreviations (p.m.) a clause at most; a tag is a line's end only
    where it begins or ends a block.
    """
    cp, n, at = batch.cp, len(batch.cp), batch.starts[:-1]
    out = np.full(len(at), PIECE, np.int8)
    if not len(at):
        return out
    before = cp[np.maximum(at - 1, 0)]
    two = cp[np.maximum(at - 2, 0)]
    here = cp[at]
    blank = classes()[here] == SPACE
    out[blank] = WORD
    closed = np.isin(before, _codes(_CLOSERS))
    last = np.where(closed, two, before)
    out[blank & np.isin(last, _codes(_CLAUSE)) | np.isin(last, _codes(_CLAUSE_WIDE))] = CLAUSE
    out[blank & np.isin(last, _codes(_ENDS)) | np.isin(last, _codes(_ENDS_WIDE))] = SENTENCE
    stop = np.flatnonzero(blank & (last == ord(".")))
    if len(stop):
        short, dotted = _abbreviated(batch, at[stop] - 1 - closed[stop])
        out[stop[short]] = WORD
        out[stop[dotted]] = CLAUSE
    out[(before == ord(">")) & (at > 0) & after_blocks(batch)[np.maximum(at - 1, 0)]] = LINE
    # white space up to here that holds line ends: count them over the run before the boundary
    spaced = classes()[before] == SPACE
    i = np.flatnonzero(spaced & ~blank)
    if len(i):
        newline = np.concatenate([[0], np.cumsum(cp == 0x0A)])
        solid = np.concatenate([[0], np.maximum.accumulate(np.where(classes()[cp] != SPACE, np.arange(1, n + 1), 0))])
        count = newline[at[i]] - newline[solid[at[i]]]
        out[i[count == 1]] = LINE
        out[i[count > 1]] = PARAGRAPH
    # a boundary inside white space is no better than a word's: the one behind the white space counts
    out[blank & spaced] = WORD
    # line ends glued to nothing: the place before them is no boundary of its own
    out[blank & ~spaced & (here != 0x20)] = np.minimum(out[blank & ~spaced & (here != 0x20)], WORD)
    return out


def merge(sizes: list[int], strength: list[int], limit: int, overlap: int, is_first: bool) -> tuple[list[int], list[int]]:
    """Agglomerative merging of segments: ``strength[i]`` is the boundary before segment ``i``.

    Returns the indices of the segments that begin the merged runs, and their boundaries' strengths.
    """
    n = len(sizes)
    size = list(sizes)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(strength[i + 1], size[i] + size[i + 1], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    dead = bytearray(n + 1)
    while heap:
        s, both, a, b = heapq.heappop(heap)
        if dead[a] or dead[b] or after[a] != b or both != size[a] + size[b]:
            continue
        if both + (0 if a == 0 and is_first else overlap) > limit:
            continue  # sizes only grow: it will never fit
        size[a], dead[b] = both, 1
        c = after[a] = after[b]
        if c < n:
            before[c] = a
            heapq.heappush(heap, (strength[c], both + size[c], a, c))
        p = before[a]
        if p >= 0:
            heapq.heappush(heap, (strength[a], size[p] + both, p, a))
    firsts = [i for i in range(n) if not dead[i]]
    return firsts, [strength[i] for i in firsts]


def cuts(at: np.ndarray, strength: np.ndarray, limit: int, overlap: int) -> tuple[list[int], list[int]]:
    """Token offsets at which the pieces of one text begin (without overlap), and the boundaries there.

    ``at``: token offset of each pre-token (one longer, from 0); ``strength``: boundary before each.
    """
    room = limit - overlap
    total = int(at[-1])
    if total <= limit:
        return [0], [len(NAMES) - 1]

    def segments(lo: int, hi: int, level: int) -> tuple[list[int], list[int]]:
        """Begins and strengths of the segments of pre-tokens ``lo:hi`` cut at boundaries of at least ``level``."""
        inner = lo + 1 + np.flatnonzero(strength[lo + 1:hi] >= level)
        begins = np.concatenate([[lo], inner])
        ends = np.append(inner, hi)
        sizes = at[ends] - at[begins]
        if sizes.max() <= room:
            return at[begins].tolist(), strength[begins].tolist()
        offsets: list[int] = []
        marks: list[int] = []
        for a, b, size in zip(begins.tolist(), ends.tolist(), sizes.tolist()):
            if size <= room:
                offsets.append(int(at[a]))
                marks.append(int(strength[a]))
            elif level > PIECE and b - a > 1:
                o, m = segments(a, b, level - 1)
                offsets += o
                marks += [int(strength[a])] + m[1:]
            else:  # one pre-token above the limit: its tokens
                offsets += range(int(at[a]), int(at[b]))
                marks += [int(strength[a])] + [TOKEN] * (size - 1)
        return offsets, marks

    offsets, marks = segments(0, len(at) - 1, SENTENCE)
    sizes = np.diff(np.append(offsets, total)).tolist()
    keep, kind = merge(sizes, marks, limit, overlap, True)
    kind[0] = len(NAMES) - 1
    return [offsets[i] for i in keep], kind


def split(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, limit: int = 512, overlap: int = 64, with_text: bool = True, with_new: bool = False, tokenizers: str | None = None,
) -> DataFrame:
    """``doc_id, piece_no, start_token, end_token, n_tokens, boundary[, text][, new_bytes]``: ordered pieces of every text.

    ``boundary`` names the place where the piece's new part begins (``text`` for the first piece); ``new_bytes`` is that
    part without the overlap, so that the parts of a text joined in order are the text.
    """
    if limit <= overlap or overlap < 0:
        raise ValueError("limit must be above overlap, and overlap not negative")
    path = _path(tokenizers)
    schema = "doc_id long, piece_no int, start_token int, end_token int, n_tokens int, boundary string" + (", text string" if with_text else "") + (", new_bytes binary" if with_new else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held(path)
        for rows in (part for b in batches for part in slices(b, 1)):
            batch, at, ids = bpe.encode_batch(rows.column(1))
            strength = strengths(batch)
            keys = rows.column(0).to_pylist()
            first = batch.doc_first
            who, no, begin, stop, names, texts, news = [], [], [], [], [], [], []
            for k, key in enumerate(keys):
                a, b = int(first[k]), int(first[k + 1])
                if a == b:
                    continue
                own = at[a:b + 1] - at[a]
                offsets, marks = cuts(own, strength[a:b], limit, overlap)
                ends = offsets[1:] + [int(own[-1])]
                starts = [0] + [max(prior, o - overlap) for prior, o in zip([0] + [max(0, x - overlap) for x in offsets[1:]], offsets[1:])]
                who += [key] * len(offsets)
                no += range(len(offsets))
                begin += starts
                stop += ends
                names += [NAMES[m] for m in marks]
                if with_text or with_new:
                    data, where = bpe.decode_bytes(ids[at[a]:at[b]])
                if with_new:
                    news += [data[where[s]:where[e]].tobytes() for s, e in zip(offsets, ends)]
                if with_text:
                    texts += [data[where[s]:where[e]].tobytes().decode("utf-8", "replace") for s, e in zip(starts, ends)]
            cols = [pa.array(who, pa.int64()), pa.array(no, pa.int32()), pa.array(begin, pa.int32()), pa.array(stop, pa.int32()), pa.array(np.subtract(stop, begin), pa.int32()), pa.array(names, pa.string())]
            labels = ["doc_id", "piece_no", "start_token", "end_token", "n_tokens", "boundary"]
            if with_text:
                cols.append(pa.array(texts, pa.string()))
                labels.append("text")
            if with_new:
                cols.append(pa.array(news, pa.binary()))
                labels.append("new_bytes")
            yield pa.RecordBatch.from_arrays(cols, names=labels)

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(run, schema)


def rebuild(pieces: DataFrame) -> DataFrame:
    """``doc_id, text`` from pieces with ``new_bytes``: the exact inverse of ``split`` for texts that aren't empty."""
    parts = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", F.hex("new_bytes").alias("h")))).alias("p"))
    return parts.select("doc_id", F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")), "UTF-8").alias("text"))
