"""Vectorised splitting of many texts at once into the byte-level pre-tokens of a public tokenizer.

Works on the code points of a whole Arrow batch with NumPy: every code point has a class (letter,
number, white space, other); runs of one class and a few rules about the blank before a run, white
space before a word and English contractions give exactly the pieces of the vocabulary's splitting
pattern. No Python object is made per piece.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
# Contractions that the pattern splits off.
_SHORT = "stmd"
_LONG = ("re", "ve", "ll")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for cls, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            table[a:b + 1] = cls
    table[0xD800:0xE000] = OTHER
    return table


class Batch:
    """Code points of the non-null texts of an Arrow array, with the positions of texts and pre-tokens.

    ``cp`` code points; ``bytes_at`` byte offset of each code point (one longer); ``doc_at`` first code
    point of each row (one longer, null rows are empty); ``starts`` first code point of each pre-token
    (one longer); ``doc_first`` index of the first pre-token of each row (one longer).
    """

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        filled = texts.fill_null(b"") if texts.null_count else texts
        filled = pa.concat_arrays([filled])
        offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset:filled.offset + len(filled) + 1]
        raw = filled.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.empty(0, np.uint8)
        self.data = data
        self.cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        self.bytes_at = np.append(lead, len(data)).astype(np.int64)
        self.doc_at = np.searchsorted(self.bytes_at, offsets - offsets[0])
        self._split()

    def _split(self) -> None:
        cp, n = self.cp, len(self.cp)
        if not n:
            self.starts, self.doc_first = np.zeros(1, np.int64), np.zeros(len(self.doc_at), np.int64)
            return
        cls = classes()[cp]
        begins = np.zeros(n + 1, bool)  # first character of a text, and the end
        begins[self.doc_at] = True
        run = np.empty(n, bool)
        run[0] = True
        np.not_equal(cls[1:], cls[:-1], out=run[1:])
        run |= begins[:n]
        start = run.copy()
        at = np.flatnonzero(run)  # run starts
        end = np.append(at[1:], n)
        kind = cls[at]
        before_word = ~begins[end]  # another run of the same text follows
        # the last of several white-space characters before a word is split off
        spaces = kind == SPACE
        several = spaces & (end - at > 1) & before_word
        start[end[several] - 1] = True
        # a single blank belongs to the word behind it
        glued = np.zeros(len(at), bool)
        glued[1:] = ~spaces[1:] & ~begins[at[1:]] & (cp[at[1:] - 1] == 0x20)
        start[at[glued]] = False
        # contractions: a lone apostrophe that starts a piece, then letters
        q = np.flatnonzero((kind == OTHER) & (cp[at] == 0x27) & (end - at == 1) & ~glued & before_word)
        q = q[kind[np.minimum(q + 1, len(kind) - 1)] == LETTER]
        if len(q):
            p, stop = at[q], end[q + 1]
            a, b = cp[p + 1], cp[np.minimum(p + 2, n - 1)]
            short = np.isin(a, [ord(c) for c in _SHORT])
            long = np.zeros(len(q), bool)
            for x, y in _LONG:
                long |= (a == ord(x)) & (b == ord(y))
            long &= stop - p > 2
            size = np.where(short, 2, np.where(long, 3, 0))
            hit = size > 0
            p, stop, size = p[hit], stop[hit], size[hit]
            start[p + 1] = False
            rest = p + size
            start[rest[rest < stop]] = True
        self.starts = np.append(np.flatnonzero(start), n)
        self.doc_first = np.searchsorted(self.starts, self.doc_at)

    def pieces(self) -> pa.DictionaryArray:
        """Bytes of all pre-tokens, dictionary-encoded."""
        offsets = self.bytes_at[self.starts]
        arr = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(self.data))])
        return arr.dictionary_encode()


def slices(rows: pa.RecordBatch, column: int, limit: int = 4 << 20):
    """Parts of a batch with at most ``limit`` bytes of text each (one row at least), so that a worker's memory stays bounded."""
    sizes = pa.compute.binary_length(rows.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    at, end = 0, np.cumsum(sizes, dtype=np.int64)
    while at < len(end):
        stop = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + limit, "right")))
        yield rows.slice(at, stop - at)
        at = stop
