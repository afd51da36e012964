"""Byte-level pre-tokenization of many texts at once.

The split that byte-level BPE vocabularies use is decided by four classes of characters (white space,
letter, number, other), so it can be found for a whole batch with array operations: the runs of equal
class are the pieces, but for a space before a piece, which joins it, and for English contractions, which
are settled by the pattern itself.
"""

from __future__ import annotations

import re

import numpy as np

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
_BLOCK = 1 << 14
_CODE_POINTS = 0x110000
_CONTRACTION = re.compile(r"'(?:s|t|re|ve|m|ll|d)")


def character_classes(tokenizer) -> bytes:
    """The class of each code point as the tokenizer's own pre-tokenizer sees it, one byte each.

    A provisional table comes from Python's character database; the pre-tokenizer then splits all
    characters of a provisional class written in one row. What it leaves together is confirmed, and each
    character that it cut off is probed alone between known neighbours.
    """
    split = tokenizer.pre_tokenizer.pre_tokenize_str
    classes = np.full(_CODE_POINTS, OTHER, np.uint8)
    points = [c for c in range(_CODE_POINTS) if not 0xD800 <= c < 0xE000]
    groups = {LETTER: [], NUMBER: [], OTHER: []}
    doubtful = []
    for c in points:
        s = chr(c)
        if s.isspace():
            doubtful.append(c)
        elif s.isalpha():
            groups[LETTER].append(c)
        elif s.isnumeric():
            groups[NUMBER].append(c)
        else:
            groups[OTHER].append(c)
    sample = {LETTER: "a", NUMBER: "1", OTHER: "!"}
    for kind, members in groups.items():
        classes[members] = kind
        # the pre-tokenizer needs hundreds of bytes for a character: a block of them at once
        for first in range(0, len(members), _BLOCK):
            block = members[first : first + _BLOCK]
            # the leading sample shows which class the first piece has
            pieces = split(sample[kind] + "".join(map(chr, block)))
            for i, (_, (start, end)) in enumerate(pieces):
                cut = block[max(0, start - 1) : end - 1]
                if i and not _same_class(split, sample[kind], chr(cut[0])):
                    doubtful.extend(cut)
    for c in doubtful:
        classes[c] = next((k for k, s in sample.items() if _same_class(split, s, chr(c))), SPACE)
    return classes.tobytes()


def _same_class(split, sample: str, char: str) -> bool:
    return len(split(sample + char + sample)) == 1


class Pieces:
    """The pieces of a batch of texts: joined[starts[i]:ends[i]], per_text of them for each text. The code points
    and the classes stay at hand for whoever needs them."""

    def __init__(self, texts: list[str], classes: np.ndarray):
        self.joined = "".join(texts)
        self.points = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.starts, self.per_text = _starts(self.joined, self.points, texts, classes)
        self.ends = np.append(self.starts[1:], len(self.points)) if len(self.starts) else self.starts

    def strings(self, which=slice(None)) -> list[str]:
        joined = self.joined
        return [joined[a:b] for a, b in zip(self.starts[which].tolist(), self.ends[which].tolist())]


def split_batch(texts: list[str], classes: np.ndarray) -> tuple[list[str], np.ndarray]:
    """All pieces of the texts in order, and how many pieces each text has."""
    found = Pieces(texts, classes)
    return found.strings(), found.per_text


def _starts(joined: str, points: np.ndarray, texts: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    if not joined:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    kinds = classes[points]
    n = len(points)
    text_starts = np.cumsum(lengths) - lengths
    text_starts = text_starts[lengths > 0]
    # runs of one class, cut at the starts of texts
    cut = np.empty(n, bool)
    cut[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=cut[1:])
    cut[text_starts] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], n)
    first = np.zeros(n + 1, bool)
    first[text_starts] = True
    first[n] = True
    white = kinds[starts] == SPACE
    # white space that ends its text stays whole; else its last character leaves it, and a space joins what follows
    inner = white & ~first[ends]
    last = ends[inner] - 1
    cut[last] = True
    joins = last[points[last] == 0x20]
    cut[joins + 1] = False
    # contractions: a lone apostrophe before letters, not joined to a space
    marks = np.flatnonzero((points == 0x27) & cut)
    marks = marks[marks + 1 < n]
    marks = marks[(kinds[marks + 1] == LETTER) & ~first[marks + 1]]
    for i in marks.tolist():
        # shorter than the pattern's longest match: it can't reach into the next text
        if found := _CONTRACTION.match(joined, i, i + 3):
            end = found.end()
            if first[i + 2 : end].any():
                found = _CONTRACTION.match(joined, i, i + 2)
                if not found:
                    continue
                end = found.end()
            cut[i + 1] = False
            if end < n:
                cut[end] = True
    starts = np.flatnonzero(cut)
    counts = np.diff(np.append(np.searchsorted(starts, text_starts), len(starts)))
    per_text = np.zeros(len(texts), np.int64)
    per_text[lengths > 0] = counts
    return starts, per_text
