"""Variant spellings of names typed by people (problem 3): MinHash banding, Monge-Elkan, star clustering.

1. A credit is read into mentions (see ``Reading``): collaborations are split, voice credits give the person behind the
   character, titles and honorifics go, letters of all scripts are folded, digits that stand for letters
   are read back, words that were glued together by case are parted.
2. Mentions and known names become sets of padded q-grams of their words. Their MinHash signatures are cut
   into bands; bands and rows are chosen from the collision curve 1-(1-s^r)^b for the similarity and
   recall asked for. Equal bands make candidates (initials of several words have a band of their own).
3. Candidates are verified by Monge-Elkan similarity: the mean over words of the similarity to a word of the other name, in the best
   assignment one to one, where a word may be a typo, another romanisation, a known nickname
   or an abbreviation. Every word must find its partner, and half of them at least must be written out.
4. Star clustering of the similarity graph. Known artists are centres; mentions without any known neighbour stand for entities of their own,
   so the heaviest (most credited) of them in each band is a possible centre, and the centres among these are taken greedily by weight until no mention is left undecided.
   Every mention joins the star whose centre is most similar. One nearer to an unknown centre than to a known artist means the unknown. Between known
   centres that are alike the one with three quarters of the clear credits or more takes it; else it stays alone.

Texts are reduced to different ones, mentions to different keys, before anything is compared, so a credit
that fills a third of the rows costs one comparison. Mentions meet known names and at most one mention per band, so no bucket emits the
pairs of its members.

Defined results: null and blank texts and texts without letters mean nobody. An empty list of
known names: empty result. Repeated rows each count; a credit names an artist once.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, fan_out

Q, SIMILARITY, RECALL = 2, 0.45, 0.97
#: Least similarity of words that differ by typing errors (1 - edits / length), and of names whose words were joined or parted.
TYPO, GLUED = 0.71, 0.75
#: How much nearer an unknown centre must be to take a mention from a known one.
MARGIN = 0.02
_MIX = np.uint64(0x9E3779B97F4A7C15)  # odd, so multiplication permutes
# Letters that have no decomposition, spellings that romanisations share.
_LETTERS = str.maketrans({"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "đ": "d", "ø": "o", "ł": "l", "ı": "i", "ħ": "h", "ŧ": "t"})
_SOUNDS = (("l", "r"), ("ou", "o"), ("ei", "e"), ("sy", "sh"), ("si", "shi"), ("zy", "j"), ("zi", "ji"), ("ti", "chi"), ("ty", "ch"), ("tu", "tsu"), ("hu", "fu"))


@dataclass(frozen=True)
class Reading:
    """How credits are read. All lists are in lower case."""

    joiners: tuple[str, ...] = ("&", "+", "/", "x", "×", "feat", "ft", "featuring", "with", "and", "vs")
    voices: tuple[str, ...] = ("cv",)
    titles: tuple[str, ...] = ("dj", "mc", "vo", "mr", "mrs", "ms", "dr", "prod")
    honorifics: tuple[str, ...] = ("san", "sama", "kun", "chan", "sensei")
    articles: tuple[str, ...] = ("the",)
    placeholders: tuple[str, ...] = ()
    digits: tuple[str, str] = ("013457", "oleast")
    made: dict = field(default_factory=dict, compare=False, repr=False)

    def pattern(self, name: str) -> regex.Pattern:
        if name not in self.made:
            def any_of(words):
                return "|".join(regex.escape(w) for w in sorted(words, key=len, reverse=True)) or "(?!)"

            self.made.update(
                joined=regex.compile(rf"\s+(?:{any_of(self.joiners)})\.?\s+", regex.I), voice=regex.compile(rf"\(\s*(?:{any_of(self.voices)})\s*[.:]?\s*([^()]*?\p{{L}}[^()]*)\)", regex.I),
                title=regex.compile(rf"^\s*(?:{any_of(self.titles)})\.?\s+(?=\S+\s+\S)", regex.I), honour=regex.compile(rf"-(?:{any_of(self.honorifics)})\b", regex.I),
            )
        return self.made[name]

    def __reduce__(self):
        return Reading, (self.joiners, self.voices, self.titles, self.honorifics, self.articles, self.placeholders, self.digits)


PLAIN = Reading()
_ASIDE = regex.compile(r"\([^()]*\)|\[[^\[\]]*\]|\s+as\s+.*$", regex.I)
_WORD = regex.compile(r"([\p{L}\p{N}\p{M}]+)(\.?)")
_CASE = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})")
_QUOTES = regex.compile(r"['’`\"“”]")
_VOICED = "\u3099\u309a"  # marks that make other letters of kana


def fold(text: str) -> str:
    """Lower case without marks; compatibility forms and letters with strokes become plain letters."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", text).lower() if not unicodedata.combining(c) or c in _VOICED)
    return unicodedata.normalize("NFC", bare).translate(_LETTERS)


def words_of(text: str, reading: Reading = PLAIN) -> list[str]:
    """Folded words of any script; one that a point follows keeps it, as it may be an abbreviation. Articles are left out."""
    parted = _CASE.sub(" ", unicodedata.normalize("NFC", unicodedata.normalize("NFKC", text)))
    digits = str.maketrans(*reading.digits)
    out = []
    for w, point in _WORD.findall(_QUOTES.sub("", fold(parted))):
        if not w.isdigit() and not w.isalpha():
            w = w.translate(digits)
        if w not in reading.articles:
            out.append(w + point)
    return out


@lru_cache(maxsize=200_000)
def name_words(name: str) -> tuple[str, ...]:
    """Words of a known name, without points."""
    return tuple(w.rstrip(".") for w in words_of(name))


def mentions(text: str | None, reading: Reading = PLAIN) -> list[str]:
    """Keys of the names in a credit: sorted words, or ``#`` and the letters of an acronym."""
    if text is None:
        return []
    t = "".join(c for c in unicodedata.normalize("NFKC", text) if unicodedata.category(c) != "Cf")
    keys = []
    for part in reading.pattern("joined").split(t):
        voice = reading.pattern("voice").search(part)
        if voice:
            part = voice.group(1)
        part = reading.pattern("honour").sub("", reading.pattern("title").sub("", _ASIDE.sub(" ", part))).strip()
        if reading.placeholders and " ".join(w for w, _ in _WORD.findall(fold(part))) in reading.placeholders:
            continue
        if regex.fullmatch(r"(?:[A-Za-z]\.){2,}[A-Za-z]?\.?|[A-Z]{3,6}", part):
            keys.append("#" + part.replace(".", "").lower())
            continue
        words = words_of(part, reading)
        if any(len(w.rstrip(".")) > 1 or not w.isascii() for w in words) and any(c.isalpha() for w in words for c in w):
            keys.append(" ".join(sorted(words)))
    return list(dict.fromkeys(keys))


def initials(name: str, reading: Reading = PLAIN) -> list[str]:
    """Acronyms of a name of three words or more, with and without its articles."""
    words = [w for w, _ in _WORD.findall(fold(name))]
    rest = [w for w in words if w not in reading.articles]
    return list(dict.fromkeys("".join(w[0] for w in ws) for ws in (words, rest) if len(ws) >= 3))


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, most: int = 64) -> tuple[int, int]:
    """Bands and rows: the most rows for which ``most`` bands reach ``recall`` at ``similarity`` on the collision curve. ValueError if none do."""
    if not 0 < similarity < 1 or not 0 < recall < 1:
        raise ValueError("similarity and recall must lie between 0 and 1")
    fits = [(math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows)), rows) for rows in range(1, 9)]
    fits = [(bands, rows) for bands, rows in fits if bands <= most]
    if not fits:
        raise ValueError(f"{most} bands can't reach a recall of {recall} at a similarity of {similarity}")
    return fits[-1]


def grams(words: list[str]) -> set[str]:
    """Padded q-grams of each word, so that the order of words doesn't matter."""
    return {p[i:i + Q] for w in words for p in [f"^{w.rstrip('.')}$"] for i in range(len(p) - Q + 1)}


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 11):
        self.bands, self.rows = bands, rows
        self.salt = np.random.default_rng(seed).integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def _mixed(self, x: np.ndarray) -> np.ndarray:
        for _ in range(2):  # multiply and shift, wrapping
            x = x * _MIX
            x ^= x >> np.uint64(32)
        return x

    def keys(self, names: list[list[str]]) -> np.ndarray:
        """64-bit buckets of many names (rows) in all bands (columns). Each different gram is hashed once."""
        if not names:
            return np.zeros((0, self.bands), np.int64)
        number: dict[str, int] = {}
        lists = [[number.setdefault(g, len(number)) for g in grams(words)] for words in names]
        table = self._mixed(np.array([xxhash.xxh64_intdigest(g) for g in number], np.uint64)[:, None] ^ self.salt) if number else np.zeros((1, len(self.salt)), np.uint64)
        out = np.empty((len(names), self.bands), np.int64)
        for s in range(0, len(names), 2048):
            part = [x or [0] for x in lists[s:s + 2048]]
            size = np.array([len(x) for x in part])
            low = np.minimum.reduceat(table[np.concatenate(part)], np.cumsum(size) - size, axis=0).reshape(len(part), self.bands, self.rows)
            mixed = np.full((len(part), self.bands), np.uint64(self.bands)) ^ np.arange(self.bands, dtype=np.uint64)
            for r in range(self.rows):
                mixed = self._mixed(mixed ^ low[:, :, r] + np.uint64(r + 1))
            out[s:s + 2048] = mixed.view(np.int64)
        return out


@lru_cache(maxsize=200_000)
def sound(word: str) -> str:
    """A word as several romanisations write it alike."""
    for a, b in _SOUNDS:
        word = word.replace(a, b)
    return regex.sub(r"([aeiou])\1+", r"\1", word)


@lru_cache(maxsize=400_000)
def letters(word: str) -> int:
    """The set of a word's letters as bits. An edit changes two of them at most."""
    bits = 0
    for c in word:
        bits |= 1 << ord(c) % 61
    return bits


def _codes(words: list[str], width: int) -> np.ndarray:
    return np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), width)


def edits(a: list[str], b: list[str]) -> np.ndarray:
    """Insertions, deletions, changes and swaps of neighbours from each word of ``a`` to its partner in ``b``, for all pairs at once."""
    if not a:
        return np.zeros(0, np.int16)
    na, nb = np.array([len(w) for w in a]), np.array([len(w) for w in b])
    x, y = _codes(a, max(na.max(), 1)), _codes(b, max(nb.max(), 1))
    width = y.shape[1]
    older, old = None, np.broadcast_to(np.arange(width + 1, dtype=np.int16)[:, None], (width + 1, len(a))).copy()
    out = np.where(na == 0, nb, 0).astype(np.int16)
    for i in range(1, x.shape[1] + 1):
        new = np.empty_like(old)
        new[0] = i
        for j in range(1, width + 1):
            d = np.minimum(np.minimum(old[j], new[j - 1]) + 1, old[j - 1] + (x[:, i - 1] != y[:, j - 1]))
            if i > 1 and j > 1:
                swapped = (x[:, i - 1] == y[:, j - 2]) & (x[:, i - 2] == y[:, j - 1])
                d = np.where(swapped, np.minimum(d, older[j - 2] + 1), d)
            new[j] = d
        done = na == i
        out[done] = new[nb[done], np.flatnonzero(done)]
        older, old = old, new
    return out


#: What a similarity of two words rests on: none, written out, not written out, written with errors.
_NONE, _WRITTEN, _SHORT, _ERROR = 0, 1, 2, 3


class Words:
    """Similarities of words, each different pair worked out once, typing errors for many pairs at a time."""

    def __init__(self, nicks: dict[str, frozenset[str]]):
        self.nicks = nicks
        self.known: dict[tuple[str, str], tuple[float, int]] = {}
        self.partners: dict[str, set[str]] = {}  # by word, the names' words that are similar to it at all

    def _plain(self, word: str, ref: str) -> tuple[float, int] | None:
        """Similarity by other reasons than typing errors; None if there are none."""
        m = word.rstrip(".")
        if m == ref:
            return 1.0, _WRITTEN
        if ref in self.nicks.get(m, ()):
            return 0.93, _SHORT
        if m + "s" == ref:
            return 0.95, _WRITTEN
        if not m or len(m) == 1 and m.isascii():
            return (0.6, _SHORT) if m and ref[:1] == m else (0.0, _NONE)
        if word.endswith(".") and m[0] == ref[:1] and len(m) < len(ref):
            if ref.startswith(m):
                return 0.85, _SHORT
            rest = iter(ref)
            if 2 * len(m) <= len(ref) + 2 and all(c in rest for c in m):
                return 0.8, _SHORT
        if len(m) >= 3 and ref.startswith(m) and len(ref) - len(m) >= 3:
            return 0.82, _SHORT
        if sound(m) == sound(ref):
            return 0.96, _ERROR
        return None

    def learn(self, pairs: set[tuple[str, str]]) -> None:
        """Work out the similarities of new pairs; most are ruled out by lengths and sets of letters, all at once."""
        if len(self.known) > 2_000_000:
            self.known.clear()
            self.partners.clear()
        new = list(pairs - self.known.keys())
        for s in range(0, len(new), 1 << 17):
            self._learn(new[s:s + (1 << 17)])
        for p in new:
            if self.known[p][0] > 0:
                self.partners.setdefault(p[0], set()).add(p[1])

    def partnered(self, words: list[str], refs: list[tuple[str, ...]]) -> list[bool]:
        """Of the names: whether every word of the mention has a partner in it."""
        held = [self.partners.get(w) for w in words]
        return [not any(h.isdisjoint(ref) for h in held) for ref in refs] if all(held) else [False] * len(refs)

    def _learn(self, new: list[tuple[str, str]]) -> None:
        words, refs = ({x: i for i, x in enumerate(dict.fromkeys(p[k] for p in new))} for k in (0, 1))
        wi, ri = (np.fromiter((at[p[k]] for p in new), np.int64, len(new)) for k, at in ((0, words), (1, refs)))
        bare, named = [w.rstrip(".") for w in words], list(refs)
        heard_m, heard_r = [sound(m) for m in bare], [sound(r) for r in named]

        def of(values, at, kind=np.int64):
            return np.array(values, kind)[at]

        lm, lr = of([len(m) for m in bare], wi), of([len(r) for r in named], ri)
        width = max(int(min(lm.max(), lr.max())), 1)
        alike = _codes([m[:width] for m in bare], width)[wi] == _codes([r[:width] for r in named], width)[ri]
        agree = np.where(alike.all(axis=1), width, alike.argmin(axis=1))
        number: dict[str, int] = {}
        sm, sr = (of([number.setdefault(x, len(number)) for x in xs], at) for xs, at in ((heard_m, wi), (heard_r, ri)))
        marked = of([w.endswith(".") or w.rstrip(".") in self.nicks for w in words], wi, bool)
        plain = (agree >= np.minimum(lm, lr)) & (lm <= lr) | marked | (sm == sr) | (lm <= 1)
        for i in np.flatnonzero(plain).tolist():
            s = self._plain(*new[i])
            plain[i] = s is not None
            self.known[new[i]] = s or (0.0, _NONE)
        rest = np.flatnonzero(~plain)
        size = np.maximum(lm, lr)

        def typed(at: np.ndarray, a: list[str], b: list[str], price: float) -> np.ndarray:
            """1 - errors / (length + 2) of the pairs ``at`` where few enough, else 0; ``a`` and ``b`` stand for the words and names."""
            out = np.zeros(len(at))
            least = np.maximum(np.abs(of([len(x) for x in a], wi[at]) - of([len(x) for x in b], ri[at])), (np.bitwise_count(of([letters(x) for x in a], wi[at]) ^ of([letters(x) for x in b], ri[at])).astype(np.int64) + 1) >> 1)
            few = np.flatnonzero(1 - (least + price) / np.maximum(size[at], 1) >= TYPO)
            d = edits([a[i] for i in wi[at[few]].tolist()], [b[i] for i in ri[at[few]].tolist()]) + price
            n = size[at[few]]
            out[few] = np.where(1 - d / np.maximum(n, 1) >= TYPO, 1 - d / (n + 2), 0.0)
            return out

        # words, their sounds (at a price), and words that lost a last s
        best = typed(rest, bare, named, 0.0)
        left = best == 0
        best[left] = typed(rest[left], heard_m, heard_r, 0.5)
        left = (best == 0) & of([r.endswith("s") for r in named], ri[rest], bool) & ~of([m.endswith("s") for m in bare], wi[rest], bool)
        best[left] = np.maximum(typed(rest[left], [m + "s" for m in bare], named, 0.0) - 0.04, 0.0)
        self.known.update((new[i], (s, _ERROR) if s > 0 else (0.0, _NONE)) for i, s in zip(rest.tolist(), best.tolist()))

    def inner(self, word: str, ref: str, spelled: frozenset[str]) -> tuple[float, bool]:
        """Similarity of a mention's word to a name's, and whether it is written out. A word of ``spelled`` (of the candidates' names) is no error for another."""
        s, kind = self.known[word, ref]
        return (0.0, False) if not s or kind == _ERROR and word.rstrip(".") in spelled else (s, kind != _SHORT)


def assign(table: list[list[float]]) -> list[int]:
    """The column of each row in the one-to-one assignment of the greatest sum (shortest augmenting paths)."""
    n = len(table)
    u, v, match, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j = i, 0
        low, used = [math.inf] * (n + 1), [False] * (n + 1)
        while match[j]:
            used[j] = True
            row, step, nxt = match[j], math.inf, 0
            for k in range(1, n + 1):
                if not used[k]:
                    cost = -table[row - 1][k - 1] - u[row] - v[k]
                    if cost < low[k]:
                        low[k], way[k] = cost, j
                    if low[k] < step:
                        step, nxt = low[k], k
            for k in range(n + 1):
                if used[k]:
                    u[match[k]] += step
                    v[k] -= step
                else:
                    low[k] -= step
            j = nxt
        while j:
            match[j] = match[way[j]]
            j = way[j]
    out = [0] * n
    for k in range(1, n + 1):
        out[match[k] - 1] = k - 1
    return out


def orders(words: tuple[str, ...]) -> list[str]:
    """A name's words joined: in order and rotated, in both directions."""
    return list(dict.fromkeys("".join(ws[i:] + ws[:i]) for ws in (words, words[::-1]) for i in range(len(words))))


def monge_elkan(words: list[str], ref: tuple[str, ...], known: Words, spelled: frozenset[str]) -> float:
    """Mean similarity of the words in the best assignment; 0 where any word has no partner or too few are written out. For as many words on both sides."""
    if len(words) != len(ref) or not ref:
        return 0.0
    table = []
    for w in words:
        row = [known.inner(w, r, spelled) for r in ref]
        if max(row)[0] <= 0:
            return 0.0
        table.append(row)
    best = assign([[s if s > 0 else -9.0 * len(ref) for s, _ in row] for row in table]) if len(ref) > 1 else [0]
    pairs = [table[i][j] for i, j in enumerate(best)]
    if any(s <= 0 for s, _ in pairs) or 2 * sum(written for _, written in pairs) < len(ref) or len(ref) == 1 and pairs[0][0] <= 0.85:
        return 0.0
    return sum(s for s, _ in pairs) / len(pairs)


def similarities(groups: list[tuple[list[str], list[tuple[str, ...]]]], known: Words) -> list[list[float]]:
    """Monge-Elkan similarities of many mentions, each to the names that are its candidates."""
    known.learn({(w, r) for words, refs in groups for ref in refs if len(ref) == len(words) for w in words for r in ref})
    glued, where = [], []
    for g, (words, refs) in enumerate(groups):
        n = len(words)
        whole = "".join(w.rstrip(".") for w in words)
        for k, ref in enumerate(refs):
            if (len(ref) == 1) != (n == 1):  # one side joined to a word
                size = sum(map(len, ref))
                if abs(size - len(whole)) <= (1 - GLUED) * max(size, len(whole)):
                    made = [(whole, o) for o in orders(ref)] if len(words) == 1 else [(o, ref[0]) for o in orders(tuple(w.rstrip(".") for w in words))]
                    glued += made
                    where += [(g, k)] * len(made)
    close: dict[tuple[int, int], float] = {}
    for (a, b), at, d in zip(glued, where, edits([a for a, _ in glued], [b for _, b in glued]).tolist()):
        if 1 - d / max(len(a), len(b)) >= GLUED:
            close[at] = max(close.get(at, 0.0), 0.97 - 0.05 * d)
    out = []
    for g, (words, refs) in enumerate(groups):
        found = known.partnered(words, refs)
        spelled = frozenset(w for ref in refs for w in ref) if any(found) else frozenset()
        out.append([close.get((g, k), 0.0) if len(ref) != len(words) else monge_elkan(words, ref, known, spelled) if found[k] else 0.0 for k, ref in enumerate(refs)])
    return out


def star(edges: list[tuple[str, float, float]], share: float = 0.75, near: float = MARGIN) -> str | None:
    """The known centre that a mention joins, of ``(centre, similarity, weight)``; None if no one or no single one."""
    if not edges:
        return None
    best = max(s for _, s, _ in edges)
    alike: dict[str, float] = {}
    for c, s, w in edges:
        if s >= best - near and not (best == 1.0 and s < 1.0):
            alike[c] = max(alike.get(c, 0.0), w)
    top = max(alike, key=lambda c: (alike[c], c))
    return top if len(alike) == 1 or alike[top] > 0 and alike[top] >= share * sum(alike.values()) else None


def star_cover(edges: DataFrame) -> DataFrame:
    """``member, centre, s`` of ``edges`` (``member, centre, s``, each towards a heavier vertex) whose centre is no member itself: greedily
    by weight, a vertex is a centre unless a heavier centre is its neighbour."""
    rest = cut(edges)
    taken = None
    while not rest.isEmpty():
        # vertices without a heavier neighbour among the undecided are centres; their neighbours are members
        centres = rest.select(F.col("centre").alias("v")).distinct().join(rest.select(F.col("member").alias("v")).distinct(), "v", "left_anti")
        new = cut(rest.join(centres.withColumnRenamed("v", "centre"), "centre", "left_semi"))
        taken = new if taken is None else taken.unionByName(new)
        members = new.select(F.col("member").alias("v")).distinct()
        rest = cut(rest.join(members.withColumnRenamed("v", "member"), "member", "left_anti").join(members.withColumnRenamed("v", "centre"), "centre", "left_anti"))
    return edges.limit(0) if taken is None else taken.select("member", "centre", "s")


def link(
    texts: DataFrame, known: DataFrame, nicknames: DataFrame, *, similarity: float = SIMILARITY, recall: float = RECALL, most_nicknames: int = 200_000, reading: Reading = PLAIN,
) -> DataFrame:
    """``text, mbid``: the known artists that each text means.

    ``texts``: different texts in column ``text``, and their number of credits in ``n`` if there is one. ``known``: ``mbid, name, weight`` (clear credits of
    the artist). ``nicknames``: ``nick, given_name``; it is sent to all executors, so more than ``most_nicknames`` rows are refused.
    """
    rows = nicknames.select("nick", "given_name").dropna().distinct().limit(most_nicknames + 1).collect()
    if len(rows) > most_nicknames:
        raise ValueError("too many nicknames to send to every executor; raise most_nicknames if they fit")
    nicks: dict[str, set[str]] = {}
    for r in rows:
        for w in words_of(r.nick)[:1]:
            nicks.setdefault(w.rstrip("."), set()).update(words_of(r.given_name))
    given = {n: frozenset(g) for n, g in nicks.items()}
    hashing = MinHash(*bands_for(similarity, recall))

    def acronym(letters: str) -> int:
        return xxhash.xxh64_intdigest("#" + letters, 1 << 20) - (1 << 63)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(t, k, n) for t, n in zip(f["text"], f["n"]) for k in mentions(t, reading)]
            yield pd.DataFrame(found, columns=["text", "key", "n"])

    def bucketed(keys: list[str], kids, others: dict) -> pd.DataFrame:
        """Each key's buckets in all bands, of its own words and with nicknames read as given names."""
        of, forms, own = [], [], []
        for key, kid in zip(keys, kids):
            if key[0] == "#":
                own.append((kid, acronym(key[1:])))
                continue
            words = key.split(" ")
            for form in [words] + [words[:i] + [g] + words[i + 1:] for i, w in enumerate(words) for g in sorted(others.get(w.rstrip("."), ()))]:
                of.append(kid)
                forms.append(form)
        made = hashing.keys(forms)
        return pd.DataFrame({"id": np.concatenate([np.repeat(np.array(of, np.int64), hashing.bands), np.array([k for k, _ in own], np.int64)]), "bucket": np.concatenate([made.ravel(), np.array([b for _, b in own], np.int64)])}).drop_duplicates()

    def buckets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield bucketed(f["key"].tolist(), f["kid"].tolist(), given)

    def name_buckets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            names = f["name"].tolist()
            made = hashing.keys([words_of(n, reading) for n in names])
            short = [(r, acronym(a)) for r, n in zip(f["rid"].tolist(), names) for a in initials(n, reading)]
            yield pd.DataFrame({"rid": np.concatenate([np.repeat(f["rid"].to_numpy(np.int64), hashing.bands), np.array([r for r, _ in short], np.int64)]), "bucket": np.concatenate([made.ravel(), np.array([b for _, b in short], np.int64)])}).drop_duplicates()

    def by_key(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Frames of whole keys, out of rows that are sorted by key."""
        held = None
        for f in frames:
            f = f if held is None else pd.concat([held, f], ignore_index=True)
            last = f["kid"].ne(f["kid"].iloc[-1]) if len(f) else None
            if last is None or not last.any():
                held = f
                continue
            yield f[last]
            held = f[~last]
        if held is not None and len(held):
            yield held

    def compare(frames: Iterator[pd.DataFrame], other: str, each) -> Iterator[pd.DataFrame]:
        memory = Words(given)
        for f in by_key(frames):
            kids = f["kid"].to_numpy()
            cuts_ = np.flatnonzero(np.append(True, kids[1:] != kids[:-1]))
            keys, others = f["key"].tolist(), f[other].tolist()
            groups = list(zip(cuts_, np.append(cuts_[1:], len(f))))
            plain = [(a, b) for a, b in groups if keys[a][0] != "#"]
            scored = dict(zip(plain, similarities([(keys[a].split(" "), [each(x) for x in others[a:b]]) for a, b in plain], memory)))
            s = np.concatenate([scored.get((a, b)) if (a, b) in scored else [0.9 * (keys[a][1:] in initials(x, reading)) if other == "name" else 0.0 for x in others[a:b]] for a, b in groups])
            yield f.assign(s=s)[s > 0]

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in compare(frames, "name", name_words):
            out = [(k, star(list(zip(g["mbid"], g["s"], g["weight"]))), float(g["s"].max())) for k, g in f.groupby("kid", sort=False)]
            yield pd.DataFrame(out, columns=["kid", "mbid", "best"])

    def verify_mentions(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in compare(frames, "other", lambda k: tuple(w.rstrip(".") for w in k.split(" "))):
            yield f[["kid", "centre", "s"]].rename(columns={"kid": "member"})

    def sorted_by_key(d: DataFrame) -> DataFrame:
        n = max(d.sparkSession.sparkContext.defaultParallelism, 1)
        return d.repartition(max(n, int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "kid").sortWithinPartitions("kid")

    counted = texts.select("text", (F.col("n").cast("double") if "n" in texts.columns else F.lit(1.0)).alias("n"))
    read_out = cut(fan_out(counted).mapInPandas(read, "text string, key string, n double"))
    keys = cut(read_out.groupBy("key").agg(F.sum("n").alias("n")).withColumn("kid", F.xxhash64("key")))
    placed = cut(fan_out(keys.select("key", "kid")).mapInPandas(buckets, "id long, bucket long"))
    refs = known.select("mbid", "name", F.col("weight").cast("double").alias("weight")).dropna(subset=["mbid", "name"]).withColumn("rid", F.xxhash64("mbid", "name"))
    ref_buckets = refs.select("rid", "name").mapInPandas(name_buckets, "rid long, bucket long")
    pairs = placed.join(ref_buckets, "bucket").select(F.col("id").alias("kid"), "rid").distinct()
    meet = pairs.join(refs, "rid").join(keys.select("kid", "key"), "kid").select("kid", "key", "mbid", "name", "weight")
    joined = cut(sorted_by_key(meet).mapInPandas(verify, "kid long, mbid string, best double"))

    # mentions near no known name are possible centres for all that share a band with them: lighter ones of their kind, and mentions that known names would take
    free = keys.filter(~F.col("key").startswith("#")).join(joined.select("kid"), "kid", "left_anti").select("kid", "key", "n")
    free_placed = placed.withColumnRenamed("id", "kid").join(free.select("kid", "n"), "kid")
    taken = placed.withColumnRenamed("id", "kid").join(joined.filter("mbid is not null").select("kid", F.lit(None).cast("double").alias("n")), "kid")
    near = taken.unionByName(free_placed).join(free_placed.select("bucket", F.col("kid").alias("centre"), F.col("n").alias("c")), "bucket")
    near = near.filter(F.col("n").isNull() | (F.struct("c", "centre") > F.struct(F.col("n").alias("c"), F.col("kid").alias("centre")))).select("kid", "centre").distinct()
    met = near.join(keys.select("kid", "key"), "kid").join(free.select(F.col("kid").alias("centre"), F.col("key").alias("other")), "centre").select("kid", "key", "centre", "other")
    edges = cut(sorted_by_key(met).mapInPandas(verify_mentions, "member long, centre long, s double"))
    weight = free.select("kid", "n")
    among = edges.join(weight.withColumnRenamed("kid", "member").withColumnRenamed("n", "m"), "member").join(weight.withColumnRenamed("kid", "centre").withColumnRenamed("n", "c"), "centre")
    cover = star_cover(among.filter(F.struct("c", "centre") > F.struct("m", "member")).select("member", "centre", "s"))
    centres = cover.select("centre").distinct()
    drawn = edges.join(centres, "centre", "left_semi").groupBy(F.col("member").alias("kid")).agg(F.max("s").alias("away"))
    stay = joined.filter("mbid is not null").join(drawn, "kid", "left").filter(F.coalesce(F.col("away"), F.lit(0.0)) <= F.col("best") + MARGIN)
    meant = stay.select("kid", "mbid").join(keys.select("kid", "key"), "kid")
    return read_out.join(meant, "key").select("text", "mbid").distinct()


def link_credits(credits: DataFrame, artists: DataFrame, nicknames: DataFrame, reading: Reading = PLAIN) -> DataFrame:
    """``src_table, row_id, item_pos, mbid`` for the credits in lists (``ingest_pos, artist_names``) and the
    looked-up names without an answer (``mb_row, query, mbid, mb_name``); see the problem for what counts."""
    listed = credits.select(F.lit("animethemes").alias("src_table"), F.col("ingest_pos").cast("long").alias("row_id"), F.posexplode("artist_names").alias("item_pos", "text"))
    asked = artists.filter("mbid is null").select(F.lit("mb_artists").alias("src_table"), F.col("mb_row").cast("long").alias("row_id"), F.lit(0).alias("item_pos"), F.col("query").alias("text"))
    every = listed.unionByName(asked).filter("text is not null")
    resolved = artists.filter("mbid is not null")
    spelled = resolved.select(F.col("mb_name").alias("text"), "mbid").unionByName(resolved.select(F.col("query").alias("text"), "mbid")).dropna().groupBy("text").agg(F.min("mbid").alias("mbid"))
    counted = every.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    weights = counted.join(spelled, "text").groupBy("mbid").agg(F.sum("n").alias("weight"))
    known = resolved.select("mbid", F.col("mb_name").alias("name")).dropna().distinct().join(weights, "mbid", "left").na.fill({"weight": 0})
    meant = link(counted.join(spelled, "text", "left_anti"), known, nicknames, reading=reading)
    return every.join(meant, "text").select("src_table", "row_id", F.col("item_pos").cast("int").alias("item_pos"), "mbid")
