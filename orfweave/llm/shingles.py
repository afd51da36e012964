"""Sets of word shingles of many texts at once, as sorted hashes of 64 bits.

Words are runs of bytes other than ASCII white space, A-Z in lower case. A word's hash is a sum of random values of its
bytes times powers of an odd number; words of over LONG bytes, whose powers may cancel, have XXH64 instead. A shingle's
hash mixes those of its words in order. Two shingles of words up to LONG bytes are taken for one another with a
chance of 2**-38 at worst (words that alternate like a Thue-Morse sequence), of some 2**-63 otherwise.
"""

from __future__ import annotations

import numpy as np

SEED = 42
LONG = 64
_ODD = 0x9E3779B97F4A7C15
_TABLES: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of bytes (0 for white space), powers and inverse powers up to n: one copy a process."""
    if "value" not in _TABLES:
        value = np.random.default_rng(2_718_281).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        value[[0x20, *range(0x09, 0x0E)]] = 0
        _TABLES["value"] = value
    if len(_TABLES.get("up", ())) < n:
        up, down = np.full(n, np.uint64(_ODD)), np.full(n, np.uint64(pow(_ODD, -1, 1 << 64)))
        up[:1] = down[:1] = 1
        _TABLES["up"], _TABLES["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _TABLES["value"], _TABLES["up"], _TABLES["down"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the text's number of each word of all texts."""
    from xxhash import xxh64_intdigest

    parts = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    joined = b"\n".join(parts) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    value, up, down = _tables(len(data) + 1)
    own = value[data]
    edge = np.flatnonzero(np.diff(own != 0, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(own * up[: len(data)], out=running[1:])
    hashes = _mixed((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        hashes[k] = xxh64_intdigest(joined[starts[k] : ends[k]], SEED)
    first = np.append(0, np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1))
    return hashes, np.searchsorted(first, starts, "right") - 1


def sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles of width words, sorted; of fewer words the whole sequence; none without words."""
    words, owner = _words(texts)
    counts = np.bincount(owner, minlength=len(texts))
    begins = np.append(0, np.cumsum(counts)).tolist()
    n = max(0, len(words) - width + 1)
    run = np.zeros(n, np.uint64)
    for k in range(width):
        run = (run + words[k : n + k]) * np.uint64(_ODD)
        run ^= run >> np.uint64(29)
    run = _mixed(run)
    out = []
    for k in range(len(texts)):
        a, b = begins[k], begins[k + 1]
        if b - a >= width:
            out.append(np.unique(run[a : b - width + 1]))
        elif b > a:
            h = np.zeros(1, np.uint64)
            for w in words[a:b]:
                h = (h + w) * np.uint64(_ODD)
                h ^= h >> np.uint64(29)
            # how many words there are keeps these apart from full shingles
            out.append(_mixed(h + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
