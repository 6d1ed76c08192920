"""Encoding with a public byte-level BPE vocabulary by backtracking (problem 6).

For each pre-token an Aho-Corasick automaton gives the longest vocabulary entry that starts at every
byte. The encoder walks from left to right, takes the longest entry whose boundary to its left
neighbour could survive the merges (a lazily filled table of compatible pairs), falls back to the next
shorter prefix that is an entry, and steps back when none is left. Each position is given up at most
once, so the time is linear in the length, also for texts without any blank. The result equals the
merges by rank.

Pre-tokens of a batch are dictionary-encoded first, so each different one is encoded once per worker
and batch at most; what remains per token is array arithmetic. Decoding gathers the bytes of the ids
through one offset table.

Defined results: null and empty texts give an empty list; a text that looks like a special token is
ordinary text. An id outside the vocabulary raises ``ValueError`` in decoding; a null list decodes to "".
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import Batch, slices

#: Folder of the public vocabularies; a parameter everywhere.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"

_HELD: dict[str, "Bpe"] = {}


def held(path: str) -> "Bpe":
    """The vocabulary of a file, loaded once per Python worker."""
    if path not in _HELD:
        _HELD[path] = Bpe(path)
    return _HELD[path]


class Bpe:
    """A byte-level vocabulary whose ids are its merge ranks."""

    #: Different pre-tokens kept per worker; beyond it the memory starts anew.
    KEEP = 400_000

    def __init__(self, path: str):
        with open(path, "rb") as f:
            entries = [line.split() for line in f if line.strip()]
        self.tokens: list[bytes] = [b""] * (1 + max(int(r) for _, r in entries))
        for word, rank in entries:
            self.tokens[int(rank)] = base64.b64decode(word)
        self.ids = {t: i for i, t in enumerate(self.tokens) if t}
        self.size = [len(t) for t in self.tokens]
        #: decoding: bytes of all entries, and where each begins
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.blob_at = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.automaton = ahocorasick.Automaton()
        self.shorter = [-1] * len(self.tokens)  # the longest entry that is a proper prefix
        for t, i in self.ids.items():
            self.automaton.add_word(t.decode("latin-1"), i)
            for k in range(len(t) - 1, 0, -1):
                if (j := self.ids.get(t[:k], -1)) >= 0:
                    self.shorter[i] = j
                    break
        self.automaton.make_automaton()
        self.merged: dict[tuple[int, int], int] = {}  # pair of entries -> the entry that their merge gives
        self.halves: list[tuple[int, int] | None] = [None] * len(self.tokens)
        for i, t in enumerate(self.tokens):  # by rank: the halves of an entry come before it
            if len(t) > 1:
                pair = self._halves(t)
                self.halves[i] = pair
                if pair:
                    self.merged[pair] = i
        self.fits: dict[int, bool] = {}
        self.words: dict[bytes, np.ndarray] = {}

    def _halves(self, t: bytes) -> tuple[int, int] | None:
        """The last two parts of an entry's own merges."""
        parts = [self.ids[t[k:k + 1]] for k in range(len(t))]
        while len(parts) > 2:
            best = min((self.merged.get(p, 1 << 30), k) for k, p in enumerate(zip(parts, parts[1:])))
            if best[0] == 1 << 30:
                return None
            parts[best[1]:best[1] + 2] = [best[0]]
        return tuple(parts)

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` followed by ``b`` is what the merges leave of their joined bytes.

        Looks back in time: undo the later of the two entries' last merges; whenever the two
        neighbours at the boundary could have merged before that moment, the pair cannot stand.
        """
        key = a << 20 | b
        known = self.fits.get(key)
        if known is not None:
            return known
        left, right, until = a, b, 1 << 30
        while True:
            over = self.merged.get((left, right), 1 << 30)
            if over < until:
                good = False
                break
            undo_left, undo_right = self.halves[left], self.halves[right]
            if undo_right and (right >= left or not undo_left):
                until, right = right + 1, undo_right[0]
            elif undo_left:
                until, left = left, undo_left[1]
            else:
                good = True
                break
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[key] = good
        return good

    def encode_word(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ids.get(word)
        if whole is not None:
            return [whole]
        n, size, shorter = len(word), self.size, self.shorter
        longest = [-1] * n
        for end, i in self.automaton.iter(word.decode("latin-1")):
            at = end - size[i] + 1
            if longest[at] < 0 or size[i] > size[longest[at]]:
                longest[at] = i
        open_at = bytearray([1]) * (n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            if token < 0:  # nothing fits here: give the position up and shorten the entry before it
                open_at[pos] = 0
                token = out.pop()
                pos -= size[token]
                token = shorter[token]
            elif open_at[pos + size[token]] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                pos += size[token]
                token = longest[pos] if pos < n else -1
            else:
                token = shorter[token]
        return out

    def encode_dictionary(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For different pre-tokens: the number of ids of each, and all ids one behind the other."""
        keep = self.words
        if len(keep) > self.KEEP:
            keep.clear()
        found = []
        for w in words:
            ids = keep.get(w)
            if ids is None:
                ids = self.encode_word(w)
                if len(w) <= 64:
                    keep[w] = ids
            found.append(ids)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.int32, int(counts.sum()))
        return counts, flat

    def encode_batch(self, texts: pa.Array) -> tuple[Batch, np.ndarray, np.ndarray]:
        """The batch, the number of ids before each pre-token (one longer) and all ids."""
        batch = Batch(texts)
        coded = batch.pieces()
        which = coded.indices.to_numpy(zero_copy_only=False)
        counts, flat = self.encode_dictionary(coded.dictionary.to_pylist())
        first = np.concatenate([[0], np.cumsum(counts)])
        each = counts[which]
        at = np.concatenate([[0], np.cumsum(each)])
        pick = np.repeat(first[which] - at[:-1], each) + np.arange(at[-1])
        return batch, at, flat[pick]

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ``ids``, and the byte offset of each id (one longer)."""
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.tokens)):
            raise ValueError("id outside the vocabulary")
        begin = self.blob_at[ids]
        size = self.blob_at[ids + 1] - begin
        at = np.concatenate([[0], np.cumsum(size)])
        return self.blob[np.repeat(begin - at[:-1], size) + np.arange(at[-1])], at


def _path(tokenizers: str | None) -> str:
    return os.path.join(tokenizers or TOKENIZERS, BYTE_BPE_50K)


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizers: str | None = None) -> DataFrame:
    """``doc_id, ids``: token ids of every text (see the module's text for null and empty ones)."""
    path = _path(tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held(path)
        for rows in (part for b in batches for part in slices(b, 1)):
            batch, at, ids = bpe.encode_batch(rows.column(1))
            offsets = at[batch.doc_first]
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column(0), lists], names=["doc_id", "ids"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizers: str | None = None) -> DataFrame:
    """``doc_id, text`` back from ``doc_id, ids``; exact for every text that was encoded."""
    path = _path(tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = held(path)
        for rows in batches:
            lists = rows.column(1)
            sizes = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
            data, at = bpe.decode_bytes(lists.flatten().to_numpy(zero_copy_only=False))
            ends = at[np.concatenate([[0], np.cumsum(sizes)])]
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
