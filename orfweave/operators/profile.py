"""What is measured of every contig before genes are looked for: base frequencies and motif background."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orfweave.functions.sequence import MOTIF, OFFSETS, RBS_BINS, RBS_WINDOW, motif_scores, stop_chance

#: Shorter contigs have no genes.
SHORTEST = 6


def chunks(contigs: DataFrame, size: int, reach_before: int, reach_after: int) -> DataFrame:
    """contig_id, length, first (position before the chunk), before (how many bases of context come first), context,
    chunk_length. A contig is cut once; no row carries all of it along. Both reaches must be within size."""
    if max(reach_before, reach_after) > size:
        raise ValueError(f"a chunk of {size} bases is shorter than what windows reach")
    # contigs are dealt out before they become pieces: what is grouped by contig then needs no exchange
    n = int(contigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = contigs.repartition(n, "contig_id").select("contig_id", "length", F.regexp_extract_all("seq", F.lit(f".{{1,{size}}}"), F.lit(0)).alias("parts"))
    part = F.transform("parts", lambda c, k: F.struct((k * size).alias("first"), F.when(k > 0, F.right(F.get("parts", k - 1), F.lit(reach_before))).otherwise("").alias("head"), c.alias("chunk"), F.coalesce(F.left(F.get("parts", k + 1), F.lit(reach_after)), F.lit("")).alias("tail")))
    rows = cut.select("contig_id", "length", F.inline(part))
    return rows.select("contig_id", "length", "first", F.length("head").alias("before"), F.concat("head", "chunk", "tail").alias("context"), F.length("chunk").alias("chunk_length"))


def base_frequencies(contigs: DataFrame) -> DataFrame:
    """contig_id, length, and counts on both strands: n_a, n_t, n_c, n_g; pstop, null for empty contigs."""
    # strong ambiguity codes stand for g, all others for a (see sequence.normalise)
    counted = contigs.select("contig_id", "length", F.length("seq").alias("own"), F.pandas_udf(_strong, "int")("seq").alias("strong"))
    at, cg = F.col("own") - F.col("strong"), F.col("strong")
    rate = lambda n: F.try_divide(n, 2 * F.col("length"))
    counted = counted.select("contig_id", "length", at.alias("n_a"), at.alias("n_t"), cg.alias("n_c"), cg.alias("n_g"))
    return counted.withColumn("pstop", stop_chance(rate(F.col("n_a")), rate(F.col("n_t")), rate(F.col("n_g"))))


def _strong(seqs: pd.Series) -> pd.Series:
    """How many letters are c, g or strong ambiguity codes."""
    sizes = ((len(b), len(b.translate(None, b"cgsbvCGSBV"))) if b is not None else None for b in (None if s is None else s.encode("utf-8", "surrogatepass") for s in seqs))
    return pd.Series([None if x is None else x[0] - x[1] for x in sizes], dtype="Int32")


def motif_tables() -> dict[str, np.ndarray]:
    """Of each group of offsets, the best score of a motif that begins a word; words are numbers of letters a, c, g, t, n to the
    base 5."""
    tables = {g: np.zeros(5**MOTIF, np.int8) for g in OFFSETS}
    for word, *scores in motif_scores():
        at = 0
        for letter in word:
            at = 5 * at + "acgtn".index(letter)
        for g, score in zip(OFFSETS, scores):
            tables[g][at] = score
    return tables


_MOTIFS: dict[str, np.ndarray] = {}


def _short_scores(tails: pd.Series) -> pd.Series:
    """Motif scores of a contig's last 1, 2, ... bases, up to all of its tail; windows of all tails at once."""
    if not _MOTIFS:
        _MOTIFS.update(motif_tables())
    tails = [t or "" for t in tails]
    sizes = np.fromiter(map(len, tails), np.int64, len(tails))
    most = int(sizes.max()) if len(sizes) else 0
    letters = np.full((len(tails), RBS_WINDOW + MOTIF), 4, np.int32)
    code = {c: k for k, c in enumerate("acgt")}
    for k, t in enumerate(tails):
        letters[k, : len(t)] = [code.get(c, 4) for c in reversed(t)]
    scores = np.zeros((len(tails), most), np.int32)
    for n in range(1, most + 1):
        own = letters.copy()
        own[:, n:] = 4
        for g, (low, high) in OFFSETS.items():
            for o in range(low, high + 1):
                word = own[:, o]
                for k in range(1, MOTIF):
                    word = 5 * word + own[:, o + k]
                np.maximum(scores[:, n - 1], _MOTIFS[g][word], out=scores[:, n - 1])
    return pd.Series([row[:n].tolist() for row, n in zip(scores, sizes.tolist())], dtype=object)


def rbs_background(contigs: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
    """contig_id, score, background: the share of each motif score among all windows of both strands, each of the
    RBS_BINS counted once more than it was met. scanned: sites.scan(contigs), if it is at hand; else motifs alone are
    measured."""
    if scanned is None:
        # that module cuts contigs by this one
        from orfweave.operators import sites

        scanned = sites.scan_scores(contigs)
    counts = scanned.select("contig_id", F.posexplode("scores").alias("score", "n")).where("n > 0").groupBy("contig_id", "score").agg(F.sum("n").alias("n"))
    # windows that the contig's end cuts short: fewer than RBS_WINDOW a contig
    tails = contigs.select("contig_id", F.right("seq", F.lit(RBS_WINDOW - 1)).alias("tail"))
    tails = tails.select("contig_id", F.explode(F.pandas_udf(_short_scores, "array<int>")("tail")).alias("score"))
    short = tails.groupBy("contig_id", "score").agg(F.count(F.lit(1)).alias("n"))
    return shares(counts.unionByName(short).groupBy("contig_id", "score").agg(F.sum("n").alias("n")), contigs, "background")


def shares(counts: DataFrame, contigs: DataFrame, name: str) -> DataFrame:
    """contig_id, score and the smoothed share."""
    bins = F.explode(F.sequence(F.lit(0), F.lit(RBS_BINS - 1))).alias("score")
    total = counts.groupBy("contig_id").agg(F.map_from_entries(F.collect_list(F.struct("score", "n"))).alias("n"), F.sum("n").alias("total"))
    full = contigs.select("contig_id").join(total, "contig_id", "left").select("contig_id", "n", F.coalesce("total", F.lit(0)).alias("total"), bins)
    return full.select("contig_id", "score", ((F.coalesce(F.col("n")[F.col("score")], F.lit(0)) + 1.0) / (F.col("total") + float(RBS_BINS))).alias(name))
