"""Vectorised folding of texts to words that survive changes of case, look, punctuation and mark-up.

Letters are folded to their base letter in lower case: look-alikes of other scripts (by code point, so before the case is dropped) and Latin
letters in any dress (strokes, small capitals, mathematical, circled) to the plain Latin letter; marks, zero-width characters, soft hyphens
and apostrophes vanish, as do hyphens that break a word at a line's end; points, commas and colons between digits vanish; everything else that is
no letter or digit separates words. Before that, mark-up is blanked: tags with their attributes, comments, link targets, forum tags; entities
become the characters they stand for, escaped ones too. Names of unknown entities and bracketed note numbers are no words.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache
from html.entities import html5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Letters of other scripts that look like Latin ones (Greek, Cyrillic, Armenian, Cherokee), and ligatures.
_LOOK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳαγεικνορτυχϲ", "ABEZHIKMNOPTYXCjayeikvoptuxc"))
_LOOK |= dict(zip("АВЕКМНОРСТУХІЅЈҮҺԚԜӀЬаевкмнорстухіѕјүһԁԛԝӏьѵг", "ABEKMHOPCTYXISJYHQWIbaebkmhopctyxisjyhdqwlbvr"))
_LOOK |= dict(zip("ՕՍՏԼօոսհցզյ", "OUSLonuhgqj"))
_LOOK |= dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃᎩ", "ABCDEGHJKLMPRSTVWZY"))
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ß": "ss", "ẞ": "ss"}
_APOSTROPHES = "'’‘`´ʼ＇"
_BREAK, _VANISH = 0, 1  # codes below the first letter
_LATIN = re.compile(r"LATIN (?:CAPITAL|SMALL|LETTER SMALL CAPITAL)(?: LETTER)?(?: SCRIPT| DOTLESS)? ([A-Z])(?: WITH .*)?$")
# A tag up to its closing '>' (one in quotes doesn't close it, unless a quote is left open) or a comment, an entity.
_TAG = re.compile(r"""</?[A-Za-z](?:[^<>"']|"[^"<]*"|'[^'<]*')*+>|</?[A-Za-z/][^<>]*>|<!--.*?-->""", re.S)
# Targets of links (the shown text stays), pictures, forum tags.
_PICTURE = re.compile(r"""!\[([^\[\]]*)\]\([^()\s]*(?:\s+["'][^"']*["'])?\)""")
_LINK = re.compile(r"""(?<!!)\[([^\[\]]*)\]\(<?(?:[a-z][a-z0-9+.-]*:|[/#.]|www\.)[^()\s]*(?:\([^()\s]*\)[^()\s]*)?(?:\s+["'][^"']*["'])?\)""", re.I)
_WIKI = re.compile(r"\[\[[^\[\]|]*\|([^\[\]|]*)\]\]")
_FORUM = re.compile(r"\[/?(?:b|i|u|s|url|img|quote|color|size|font|code|list|spoiler|center|sup|sub|\*)(?:=[^\[\]]*)?\]", re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7};?|#[xX][0-9a-fA-F]{1,6};|[A-Za-z][A-Za-z0-9]{1,31};)")
_MARKED = r"<[A-Za-z/!]|&[#A-Za-z]|\]\(|\[\[|\[/?[A-Za-z*]+[\]=]"  # what any of these holds
#: Words from which on a tag may hold a passage, and what keeps such tags apart from what stands before them.
_LONG, _APART = 12, " ꙮꙮ ꙮꙮ ꙮꙮ ꙮꙮ "


@lru_cache(maxsize=1)
def folds() -> np.ndarray:
    """Folded code point of each code point; 0 separates, 1 vanishes."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if 0xAC00 <= c < 0xD7A4 or 0x3400 <= c < 0xA000 or 0x20000 <= c < 0x32000:
            table[c] = c
            continue
        if 0xD800 <= c < 0xF900:
            continue
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind[0] == "M" or kind == "Cf" or ch in _APOSTROPHES:
            table[c] = _VANISH
        elif kind[0] == "L" or kind == "Nd" or kind == "So" and (ch != unicodedata.normalize("NFKD", ch) or _LATIN.search(unicodedata.name(ch, ""))):
            base = unicodedata.normalize("NFKD", ch)[0]
            base = _LOOK.get(base, base)
            named = _LATIN.search(unicodedata.name(base, ""))
            base = (named.group(1) if named else base).lower()[0]
            table[c] = ord(base) if base.isalnum() else _BREAK
    return table


def fold_text(text: str) -> str:
    """Folded characters of a text, with a blank for every separator (for the small side)."""
    for a, b in _LIGATURES.items():
        text = text.replace(a, b)
    codes = folds()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    return "".join(" " if c == _BREAK else chr(c) for c in codes if c != _VANISH)


def _character(m: re.Match) -> str:
    name = m.group()
    return html.unescape(name) if name[1] == "#" else html5.get(name[1:], name)


def _without_tags(text: str) -> str:
    aside = []

    def blank(m: re.Match) -> str:
        tag = m.group()
        if len(tag) < 2 * _LONG or len(re.findall(r"\w+", tag)) < _LONG:
            return " "
        if "=" not in tag:  # a comparison in a sentence rather than a tag
            return tag
        aside.append(tag[1:-1])
        return " "

    text = _TAG.sub(blank, text)
    return _APART.join([text, *aside]) if aside else text


def _without_targets(text: str) -> str:
    if "](" in text:
        text = _LINK.sub(r" \1 ", _PICTURE.sub(lambda m: f" {m.group(1)} " if len(m.group(1).split()) >= _LONG else " ", text))
    return _FORUM.sub("", _WIKI.sub(r" \1 ", text)) if "[" in text else text


def unmark(text: str) -> str:
    """A text without tags, link targets and entities. What long attributes say (descriptions of images) goes behind the text."""
    text = _without_targets(_without_tags(text))
    if "&" in text:
        for _ in range(2):  # entities are at times escaped again
            text = _ENTITY.sub(_character, text)
        text = _without_tags(text)
    return text


def _unmarked(texts: pa.Array) -> pa.Array:
    texts = texts.cast(pa.large_string())
    marked = pc.fill_null(pc.match_substring_regex(texts, _MARKED), False)
    if not pc.any(marked).as_py():
        return texts
    return pc.replace_with_mask(texts, marked, pa.array([unmark(t) for t in texts.filter(marked).to_pylist()], pa.large_string()))


class Words:
    """Words of the rows of an Arrow string array: ``coded`` (dictionary-encoded folded words, UTF-32),
    ``row_first`` index of the first word of each row (one longer)."""

    def __init__(self, texts: pa.Array):
        filled = pa.concat_arrays([_unmarked(texts).cast(pa.large_binary()).fill_null(b"")])
        offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset:filled.offset + len(filled) + 1]
        raw = filled.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.empty(0, np.uint8)
        cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        row_at = np.searchsorted(lead, offsets - offsets[0])
        if len(cp) and cp.max() >= 0xDF and np.isin(cp, [ord(a) for a in _LIGATURES]).any():
            cp, row_at = self._expand(cp, row_at)
        folded = folds()[cp]
        digit = (folded >= 0x30) & (folded <= 0x39)
        if len(cp) > 2:  # a point, comma or colon between digits
            mid = digit[:-2] & digit[2:] & np.isin(cp[1:-1], [0x2E, 0x2C, 0x3A])
            folded[1:-1][mid] = _VANISH
            self._join_lines(cp, folded, digit)
        stay = folded != _VANISH
        keep_at = np.concatenate([[0], np.cumsum(stay)])
        row_at = keep_at[row_at]
        letters, source = folded[stay], cp[stay]
        n = len(letters)
        inside = letters != _BREAK
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        firsts = row_at[:-1]
        firsts = firsts[firsts < n]
        begin[firsts] |= inside[firsts]
        start = np.flatnonzero(begin)
        stop_flag = np.append(inside, False)
        ends = np.flatnonzero(inside & (~stop_flag[1:] | np.append(begin[1:], False))) + 1
        good = self._real(source, start, ends, n)
        start, ends = start[good], ends[good]
        # pack the words one behind the other, four bytes a letter
        size = ends - start
        at = np.concatenate([[0], np.cumsum(size)])
        packed = letters[np.repeat(start - at[:-1], size) + np.arange(at[-1])].astype("<u4")
        arr = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer((at * 4).astype(np.int64)), pa.py_buffer(packed)])
        self.coded = arr.dictionary_encode()
        self.row_first = np.searchsorted(start, row_at)

    @staticmethod
    def _join_lines(cp: np.ndarray, folded: np.ndarray, digit: np.ndarray) -> None:
        """A hyphen between a letter and a line's end that a letter follows: both vanish."""
        letter = (folded > _VANISH) & ~digit
        for end in ([0x0A], [0x0D, 0x0A]):
            n = len(end) + 1
            at = 1 + np.flatnonzero(np.isin(cp[1:-n], [0x2D, 0x2010]) & letter[:-n - 1] & letter[n + 1:])
            for k, c in enumerate(end, 1):
                at = at[cp[at + k] == c]
            for k in range(n):
                folded[at + k] = _VANISH

    @staticmethod
    def _expand(cp: np.ndarray, row_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = np.ones(len(cp), np.int64)
        for a, b in _LIGATURES.items():
            size[cp == ord(a)] = len(b)
        at = np.concatenate([[0], np.cumsum(size)])
        out = np.repeat(cp, size)
        for a, b in _LIGATURES.items():
            where = at[:-1][cp == ord(a)]
            for k, ch in enumerate(b):
                out[where + k] = ord(ch)
        return out, at[row_at]

    @staticmethod
    def _real(source: np.ndarray, start: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
        """Words that are no tag name, entity or bracketed note number."""
        if not len(start):
            return np.zeros(0, bool)
        pad = np.concatenate([[0, 0], source, [0]])
        before, two, after = pad[start + 1], pad[start], pad[ends + 2]
        tag = (before == ord("<")) | (before == ord("/")) & (two == ord("<"))
        tag &= np.isin(after, [ord(">"), ord("/"), 0x20])
        entity = np.isin(before, [ord("&"), ord("#")]) & (after == ord(";"))
        digits = np.concatenate([[0], np.cumsum((source >= 0x30) & (source <= 0x39))])
        note = (digits[ends] - digits[start] == ends - start) & (ends - start <= 3)
        note &= (before == ord("[")) & (after == ord("]")) | (before == ord("(")) & (after == ord(")"))
        return ~(tag | entity | note)

    def ids(self, vocabulary: dict[bytes, int]) -> np.ndarray:
        """Id of every word in ``vocabulary`` (keys in UTF-32), -1 for other words."""
        known = np.fromiter((vocabulary.get(w, -1) for w in self.coded.dictionary.to_pylist()), np.int32, len(self.coded.dictionary))
        return known[self.coded.indices.to_numpy(zero_copy_only=False)] if len(self.coded) else np.zeros(0, np.int32)


def vocabulary(texts: list[str | None]) -> tuple[dict[bytes, int], list[np.ndarray]]:
    """Ids for the words of a small set of texts, and each text as ids."""
    words = Words(pa.array([t or "" for t in texts], pa.string()))
    known = {w: i for i, w in enumerate(words.coded.dictionary.to_pylist())}
    ids = words.ids(known)
    return known, [ids[a:b] for a, b in zip(words.row_first, words.row_first[1:])]
