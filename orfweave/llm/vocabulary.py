"""Byte-level BPE vocabularies: what is proved about them offline, and encoding in batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held, release
from .pretokenize import Pieces, character_classes

#: Bytes of texts that are dealt with at once; several arrays of eight bytes for each of them are alive then.
CHUNK_BYTES = 150_000
#: Slots of a worker's table of pieces, and the most tokens of a piece that it keeps.
SLOTS, KEPT = 1 << 19, 8
#: Tokens that are proved at once.
PROVED = 1000
_SEPARATOR = "\0"


class Vocabulary:
    """A byte-level BPE vocabulary in the form the workers need: plain values that can be broadcast. Its size
    is bounded by the vocabulary file."""

    #: by path; a vocabulary file is taken not to change while the program runs
    _read: dict[str, Vocabulary] = {}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        if path not in cls._read:
            cls._read[path] = cls(path)
        return cls._read[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        tokenizer = Tokenizer.from_file(path)
        added = tokenizer.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in added.items()}
        if any(t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("added tokens that take in their surroundings aren't supported")
        self.classes = character_classes(tokenizer)
        byte_of = {c: b for b, c in byte_characters().items()}
        self._require_order(path)
        # what was read of the file and of the proof is given back: a driver reads this late in a program
        release()
        self.ranks = {bytes(byte_of[c] for c in s): i for s, i in tokenizer.get_vocab(with_added_tokens=False).items() if s not in self.special}
        self.whole = self._prove(tokenizer)
        del tokenizer
        release()

    @staticmethod
    def _require_order(path: str) -> None:
        """Merging by the lowest id is merging by the first rule only if later rules make higher ids."""
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        vocab, merges = model["vocab"], model["merges"]
        ids = np.fromiter((vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges), np.int64, len(merges))
        if (np.diff(ids) <= 0).any():
            raise ValueError(f"the ids of {path} aren't in the order of its merges")

    def _prove(self, tokenizer) -> dict[str, int]:
        """Strings of the vocabulary that alone encode as their one token, with its id."""
        named = {}
        for token, rank in self.ranks.items():
            try:
                named[token.decode()] = rank
            except UnicodeDecodeError:
                continue
        strings, whole = list(named), {}
        for k in range(0, len(strings), PROVED):
            some = strings[k : k + PROVED]
            encoded = tokenizer.encode_batch(some, add_special_tokens=False)
            whole |= {s: named[s] for s, e in zip(some, encoded) if e.ids == [named[s]]}
        return whole


def byte_characters() -> dict[int, str]:
    """Byte-level vocabularies write each byte as a printable character: itself, or the next unused one from 256."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    """Encodes batches of texts, special strings as their own tokens.

    A piece is looked up by two 64-bit hashes of its characters in a table with one entry a slot. Every piece has two slots
    that it may lie in. Whole tokens hold one of theirs for good, all of them: where two want one slot, one moves to its
    other slot, and on with what lies there. The rest are merged when first met and take the place of what had their
    slot, so the table never grows. Whole tokens of over LONG characters are known by their characters. Each hash multiplies random 64-bit values of the characters by powers of an odd number, with
    values and powers of its own. Other pieces of over LONG characters are merged each time; below that
    the powers cancel 26 low bits at worst, so two pieces are taken for one another with a chance of 2**-76 at most.
    """

    LONG = 64
    _BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)

    @classmethod
    def of(cls, vocabulary: Vocabulary) -> Encoder:
        """The process's encoder of the vocabulary; what it remembers changes its speed only."""
        return held(f"encoder {vocabulary.path}", lambda: cls(vocabulary))

    def __init__(self, vocabulary: Vocabulary):
        import tiktoken

        self.vocabulary = vocabulary
        self.classes = np.frombuffer(vocabulary.classes, np.uint8)
        self._special = re.compile("(" + "|".join(re.escape(s) for s in sorted(vocabulary.special, key=len, reverse=True)) + ")") if vocabulary.special else None
        # pieces are encoded side by side, with a separator that is a token by itself
        merger = tiktoken.Encoding("pieces", pat_str=r"[^\x00]+|\x00", mergeable_ranks=vocabulary.ranks, special_tokens={})
        self._merge, self._merge_one = merger.encode_ordinary, merger._encode_single_piece
        self._separator = vocabulary.ranks[_SEPARATOR.encode()]
        random = np.random.default_rng(20_240_229)
        self._values = [random.integers(0, 1 << 64, 0x110000, np.uint64) for _ in self._BASES]
        self._powers(CHUNK_BYTES + 1)
        self.keys, self.checks = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        self.lengths = np.zeros(SLOTS, np.int16)
        self.ids = np.zeros((SLOTS, KEPT), np.uint16 if max(vocabulary.ranks.values()) < 1 << 16 else np.uint32)
        self.pinned = np.zeros(SLOTS, bool)
        self.long = {s: i for s, i in vocabulary.whole.items() if len(s) > self.LONG}
        whole = [(s, i) for s, i in vocabulary.whole.items() if len(s) <= self.LONG]
        hashes, checks = self._hash(Pieces([s for s, _ in whole], self.classes))
        slots = self._home(hashes)
        self.keys[slots], self.checks[slots], self.lengths[slots] = hashes, checks, 1
        self.ids[slots, 0] = [i for _, i in whole]
        self.pinned[slots] = True

    def _powers(self, n: int) -> None:
        self._up, self._down = [], []
        for base in self._BASES:
            up, down = np.full(n, np.uint64(base)), np.full(n, np.uint64(pow(base, -1, 1 << 64)))
            up[0] = down[0] = 1
            self._up.append(np.multiply.accumulate(up))
            self._down.append(np.multiply.accumulate(down))

    def _hash(self, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
        n = len(pieces.points)
        if n > len(self._up[0]):
            self._powers(n)
        found = []
        for values, up, down in zip(self._values, self._up, self._down):
            running = np.zeros(n + 1, np.uint64)
            np.cumsum(values[pieces.points] * up[:n], out=running[1:])
            found.append((running[pieces.ends] - running[pieces.starts]) * down[pieces.starts])
        return found[0] | np.uint64(1), found[1]  # 0 marks an empty slot

    @staticmethod
    def _slot(hashes: np.ndarray, second: bool = False) -> np.ndarray:
        factor = np.uint64(0xA24BAED4963EE407 if second else 0xD6E8FEB86659FD93)
        return ((hashes * factor) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)

    def _home(self, hashes: np.ndarray) -> np.ndarray:
        """A slot of its own for each piece, one of its two."""
        both = np.stack([self._slot(hashes), self._slot(hashes, True)], 1)
        out = both[:, 0].copy()
        first = np.zeros(len(out), bool)
        first[np.unique(out, return_index=True)[1]] = True
        lies = dict(zip(out[first].tolist(), np.flatnonzero(first).tolist()))
        for k in np.flatnonzero(~first).tolist():
            slot = int(both[k, 1])
            for _ in range(1000):
                k, lies[slot] = lies.get(slot), k
                out[lies[slot]] = slot
                if k is None:
                    break
                slot = int(both[k].sum() - slot)
            else:
                raise RuntimeError("the table is too small for the vocabulary")
        return out

    def _find(self, hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots, and whether the piece lies there."""
        slots = self._slot(hashes)
        hit = (self.keys[slots] == hashes) & (self.checks[slots] == checks)
        rest = np.flatnonzero(~hit)
        other = self._slot(hashes[rest], True)
        slots[rest] = other
        hit[rest] = (self.keys[other] == hashes[rest]) & (self.checks[other] == checks[rest])
        return slots, hit

    def _put(self, hashes: np.ndarray, checks: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        slots, starts = self._slot(hashes), np.cumsum(lengths) - lengths
        slots = np.where(self.pinned[slots], self._slot(hashes, True), slots)
        keep = np.flatnonzero((lengths <= KEPT) & ~self.pinned[slots])
        # of pieces with the same slot the last one gets it, in all arrays
        keep = keep[len(keep) - 1 - np.unique(slots[keep][::-1], return_index=True)[1]]
        slots, starts, lengths = slots[keep], starts[keep], lengths[keep]
        self.keys[slots], self.checks[slots], self.lengths[slots] = hashes[keep], checks[keep], lengths
        columns = np.arange(KEPT)
        mask = columns < lengths[:, None]
        rows = np.zeros((len(keep), KEPT), self.ids.dtype)
        rows[mask] = ids[(starts[:, None] + columns)[mask]]
        self.ids[slots] = rows

    def _merged(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts and all tokens of pieces, found by merging."""
        plain = [k for k, s in enumerate(strings) if _SEPARATOR not in s and s not in self.long]
        ids = np.array(self._merge(_SEPARATOR.join([strings[k] for k in plain])), np.int64)
        cuts = np.flatnonzero(ids == self._separator)
        if len(plain) == len(strings):
            if not strings:
                return np.zeros(0, np.int64), ids
            return np.diff(np.concatenate(([-1], cuts, [len(ids)]))) - 1, ids[ids != self._separator]
        # a piece that holds the separator is merged by itself
        lists = dict(zip(plain, np.split(ids, cuts))) if plain else {}
        out = []
        for k, s in enumerate(strings):
            if k in lists:
                out.append(lists[k][lists[k] != self._separator])
            else:
                out.append(np.array([self.long[s]] if s in self.long else self._merge_one(s), np.int64))
        return np.array([len(x) for x in out]), np.concatenate(out)

    def encode(self, texts: list[str], want_ids: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """For each text its tokens and how many of them needed no merging; all tokens in a row, if wanted."""
        owner, special = None, None
        segments = texts
        if self._special and any(s in t for s in self.vocabulary.special for t in texts):
            parts = [self._special.split(t) for t in texts]
            owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
            special = np.concatenate([np.arange(len(p)) % 2 == 1 for p in parts])
            segments = [s if k % 2 == 0 else "" for p in parts for k, s in enumerate(p)]
            special_ids = [self.vocabulary.special[s] for p in parts for s in p[1::2]]
        pieces = Pieces(segments, self.classes)
        lengths, ids = self._encode_pieces(pieces, want_ids)
        edges = np.append(0, np.cumsum(pieces.per_text))
        running = np.append(0, np.cumsum(lengths))
        tokens = np.diff(running[edges])
        whole = np.diff(np.append(0, np.cumsum(lengths == 1))[edges])
        if owner is None:
            return tokens, whole, ids
        if want_ids:
            ids = np.insert(ids, running[edges[:-1]][special], special_ids)
        tokens[special] = whole[special] = 1
        count = lambda x: np.bincount(owner, x, len(texts)).astype(np.int64)
        return count(tokens), count(whole), ids

    def _encode_pieces(self, pieces: Pieces, want_ids: bool) -> tuple[np.ndarray, np.ndarray | None]:
        hashes, checks = self._hash(pieces)
        short = pieces.ends - pieces.starts <= self.LONG
        slots, hit = self._find(hashes, checks)
        hit &= short
        lengths = self.lengths[slots].astype(np.int64)
        rest = np.flatnonzero(~hit)
        # the short ones among the rest once each, every long one by itself
        near = rest[short[rest]]
        first, back = _distinct(hashes[near], checks[near])
        chosen = np.concatenate([near[first], rest[~short[rest]]])
        found, found_ids = self._merged(pieces.strings(chosen))
        which = np.zeros(len(hashes), np.int64)
        which[near], which[chosen[len(first) :]] = back, np.arange(len(first), len(chosen))
        lengths[rest] = found[which[rest]] if len(rest) else 0
        ids = None
        if want_ids:
            starts = np.cumsum(lengths) - lengths
            ids = np.empty(int(lengths.sum()), self.ids.dtype)
            known = np.flatnonzero(hit)
            for k in range(KEPT):
                known = known[lengths[known] > k]
                ids[starts[known] + k] = self.ids[slots[known], k]
            if len(rest):
                from_, many = (np.cumsum(found) - found)[which[rest]], lengths[rest]
                step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                ids[np.repeat(starts[rest], many) + step] = found_ids[np.repeat(from_, many) + step]
        if len(first):
            self._put(hashes[near[first]], checks[near[first]], found[: len(first)], found_ids)
        return lengths, ids


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct pair (a, b), and for every place the number of its pair."""
    order = np.lexsort((b, a))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[slice, list[str]]]:
    """Consecutive texts of at most limit bytes together, a longer text alone; only these are made Python strings."""
    sizes = pc.binary_length(texts).to_pylist()
    start, total = 0, 0
    for k, size in enumerate([*sizes, limit + 1]):
        if k > start and (total + size > limit):
            yield slice(start, k), texts[start:k].to_pylist()
            start, total = k, 0
        total += size
