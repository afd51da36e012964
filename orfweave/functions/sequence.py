"""Column expressions over nucleotide sequences in lower case."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The complement of each nucleotide code.
CODES, COMPLEMENTS = "acgtnryswkmbvdh", "tgcanyrswmkvbhd"

# Offsets in the reversed window at which a motif may begin, and the ladder of motifs from the best down.
OFFSETS = {"A": (5, 10), "B": (3, 4), "C": (11, 12), "D": (13, 15)}
_SIX = ("ggacga", "ggatga", "ggaaga", "ggcgga", "ggggga", "ggtgga")
_BROKEN = ("ggtgg", "ggggg", "ggcgg")
_FOUR = ("agga", "gagg", "ggag")
_THREE = ("agg", "gag", "gga")
_WEAK = ("gaaga", "gatga", "gacga")
RBS_LADDER = (
    (27, "A", ("ggagga",)),
    (26, "B", ("ggagga",)),
    (25, "C", ("ggagga",)),
    (24, "A", ("ggagg",)),
    (23, "B", ("ggagg",)),
    (22, "A", ("gagga",)),
    (21, "B", ("gagga",)),
    (20, "C", ("gagga", "ggagg")),
    (19, "A", _SIX),
    (18, "B", _SIX),
    (17, "C", _SIX),
    (16, "A", ("ggag", "gagg")),
    (15, "A", ("agga",)),
    (14, "A", _BROKEN),
    (13, "A", _THREE),
    (12, "C", _FOUR),
    (11, "B", _FOUR),
    (10, "D", ("gagga", "ggagg", "ggagga")),
    (9, "A", _WEAK),
    (8, "B", _BROKEN),
    (7, "C", _BROKEN),
    (6, "C", _THREE),
    (5, "B", _WEAK),
    (4, "C", _WEAK),
    (3, "D", _FOUR),
    (2, "D", (*_THREE, "ggaaga", "ggatga", "ggacga", *_BROKEN)),
    (1, "B", _THREE),
)
RBS_BINS = 28
RBS_WINDOW = 21

# Amino acids by codon, nucleotides in the order t, c, a, g.
NUCLEOTIDES = "tcag"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def revcomp(seq: Column) -> Column:
    return F.translate(F.reverse(seq), CODES, COMPLEMENTS)


def normalise(seq: Column) -> Column:
    """Strong ambiguity codes become g, everything else that is no nucleotide a. Letters only are met."""
    return F.regexp_replace(F.translate(F.lower(seq), "sbv", "ggg"), "[^acgt]", "a")


def letters_to_bases(seq: Column) -> Column:
    """One table over the alphabet in lower case: bases stay, strong codes become g, all other letters a; what is no letter
    stays as it is."""
    strong = "sbv"
    other = "".join(c for c in "abcdefghijklmnopqrstuvwxyz" if c not in "acgt" + strong)
    return F.translate(seq, strong + other, "g" * len(strong) + "a" * len(other))


def codon_table() -> dict[str, str]:
    codons = (a + b + c for a in NUCLEOTIDES for b in NUCLEOTIDES for c in NUCLEOTIDES)
    return dict(zip(codons, AMINO_ACIDS))


def rbs_branches() -> list[tuple[int, list[tuple[int, int, str]]]]:
    """(score, [(1-based start, length, motif)]): the motif must lie in that stretch of the reversed window."""
    out = []
    for score, group, motifs in RBS_LADDER:
        low, high = OFFSETS[group]
        out.append((score, [(low + 1, high - low + len(m), m) for m in motifs]))
    return out


def rbs_score(window: Column) -> Column:
    """0 to 27 for a window of RBS_WINDOW bases upstream; shorter ones just lack motifs."""
    s = F.reverse(window)
    case = None
    for score, places in rbs_branches():
        hit = None
        for start, length, motif in places:
            found = F.contains(F.substring(s, start, length), F.lit(motif))
            hit = found if hit is None else hit | found
        case = F.when(hit, score) if case is None else case.when(hit, score)
    return case.otherwise(0)


MOTIF = 6


def motif_scores() -> list[tuple]:
    """(six letters, best score in each group of offsets) for all that begin a motif; n is any letter but a, c, g, t.

    The ladder falls, so a window's score is the best over its offsets of what begins there: a table of words and a
    few sliding maxima stand for the ladder."""
    from itertools import product

    out = []
    for word in map("".join, product("acgtn", repeat=MOTIF)):
        best = dict.fromkeys(OFFSETS, 0)
        for score, group, motifs in RBS_LADDER:
            if word.startswith(motifs):
                best[group] = max(best[group], score)
        if any(best.values()):
            out.append((word, *best.values()))
    return out


def rbs_score_sql(window: str) -> str:
    """The same in SQL."""
    branches = (f"WHEN {' OR '.join(f"contains(substring(s, {a}, {n}), '{m}')" for a, n, m in places)} THEN {score}" for score, places in rbs_branches())
    return f"(SELECT CASE {' '.join(branches)} ELSE 0 END FROM (SELECT reverse({window}) AS s))"


def max_index(a: Column, b: Column, c: Column) -> Column:
    """Of the largest, from 1; ties go to the later one."""
    most = F.greatest(a, b, c)
    return F.when(c == most, 3).when(b == most, 2).otherwise(1)


def min_index(a: Column, b: Column, c: Column) -> Column:
    """Of the smallest, from 1; ties go to the earlier one."""
    return F.array_position(F.array(a, b, c), F.least(a, b, c)).cast("int")


def stop_chance(a: Column, t: Column, g: Column) -> Column:
    """That three bases drawn with these frequencies are a stop codon."""
    return t * a * a + t * g * a + t * a * g


def translate_codons(seq: Column) -> Column:
    """The protein of a coding sequence, stop codons as *; codons with other letters are X."""
    return F.pandas_udf(_proteins, "string")(seq)


#: Letters as numbers, and of codons of them (to the base 5) the amino acids.
_LETTER = np.full(256, 4, np.int16)
_LETTER[list(NUCLEOTIDES.encode())] = range(4)
_AMINO = np.full(125, ord("X"), np.uint8)
for _codon, _amino in codon_table().items():
    _AMINO[sum(5 ** (2 - k) * NUCLEOTIDES.index(b) for k, b in enumerate(_codon))] = ord(_amino)


def _proteins(seqs: pd.Series) -> pd.Series:
    """All sequences of a batch in one go."""
    whole = [None if s is None else s[: len(s) // 3 * 3] for s in seqs]
    letters = _LETTER[np.frombuffer("".join(s for s in whole if s).encode("ascii", "replace"), np.uint8)].reshape(-1, 3)
    text, at, out = _AMINO[letters @ np.array([25, 5, 1], np.int16)].tobytes().decode(), 0, []
    for s in whole:
        n = len(s) // 3 if s else 0
        out.append(None if s is None else text[at : at + n])
        at += n
    return pd.Series(out, dtype=object)


def entropy(protein: Column) -> Column:
    """Of a protein's amino acids, by tens; * counts in the total only. Null where there is nothing else."""
    return F.pandas_udf(_entropies, "double")(protein)


def _entropies(proteins: pd.Series) -> pd.Series:
    sizes = np.array([len(p) if p else 0 for p in proteins], np.int64)
    letters = np.frombuffer("".join(p for p in proteins if p).encode("ascii", "replace"), np.uint8).astype(np.int64)
    n = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * 128 + letters, minlength=128 * len(sizes)).reshape(-1, 128)
    total = np.maximum(n.sum(1), 1)
    n[:, ord("*")] = 0
    share = n / total[:, None]
    found = -(share * np.log10(np.where(n > 0, share, 1))).sum(1)
    return pd.Series([x if any_ else None for x, any_ in zip(found.tolist(), n.any(1).tolist())], dtype=object)


def sign(x: Column) -> Column:
    return F.when(x < 0, -1).otherwise(1)


def gap_cost(length: Column, direction: Column, p: Column, linear: int = 300, chance: float = 0.05) -> Column:
    """Of a stretch without genes. Over linear bases the length itself counts, and the strand no longer does."""
    short = 1 / F.pow(1 - p, length / 3) + F.when(direction == "diff", 1 / chance).otherwise(0.0)
    return F.when(length > linear, F.pow(1 - p, F.lit(100.0)) + length).otherwise(short)


def overlap_cost(length: Column, direction: Column, p: Column, chance: float = 0.05) -> Column:
    return 1 / F.pow(1 - p, length) + F.when(direction == "diff", 1 / chance).otherwise(0.0)
