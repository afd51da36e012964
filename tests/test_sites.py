"""Pieces: contigs of several pieces give what one long look at the sequence gives."""

import random

import pytest
from pyspark.sql import functions as F

from orfweave.functions.sequence import CODES, COMPLEMENTS, max_index, min_index
from orfweave.operators import orfs, sites
from orfweave.params import Params

LENGTHS = {"six": 6, "short": 40, "whole": sites.PIECE, "over": sites.PIECE + 1, "many": 3 * sites.PIECE + 1234}


@pytest.fixture(scope="module")
def sequences():
    rng = random.Random(5)
    # ambiguous letters are rare; the strong ones count as g in windows
    return {name: "".join(rng.choices("acgtnsr", [30, 20, 20, 30, 1, 1, 1], k=n)) for name, n in LENGTHS.items()}


@pytest.fixture(scope="module")
def scanned(spark, sequences):
    rows = [(k, v, len(v)) for k, v in sequences.items()]
    return sites.scan(spark.createDataFrame(rows, "contig_id string, seq string, length int")).cache()


def _pair(seq, pos):
    """The pair of windows at a position (from 1), forward and backward."""
    half = Params().gc_window // 3 // 2
    gc = [sum(seq[q - 1] in "gcsbv" for q in range(p - 3 * (half - 1), p + 3 * half + 1, 3) if 1 <= q <= len(seq)) for p in (pos, pos + 1, pos + 2)]
    out = []
    for w in (gc, gc[::-1]):
        out.append((max(range(3), key=lambda k: (w[k], k)) + 1, min(range(3), key=lambda k: (w[k], k)) + 1))
    return out


def test_events_of_pieces(scanned, sequences):
    """Counts at every event, by going along the whole contig."""
    found = orfs.events(scanned).collect()
    assert {r.contig_id for r in found} == set(LENGTHS)
    back = str.maketrans(CODES, COMPLEMENTS)
    known = {*Params().starts, *Params().stops}
    for name, seq in sequences.items():
        rows = {r.pos: r for r in found if r.contig_id == name}
        expected = {p for p in range(1, len(seq) - 1) if p <= 3 or p >= len(seq) - 4 or seq[p - 1 : p + 2] in known or seq[p - 1 : p + 2][::-1].translate(back) in known}
        assert set(rows) == expected
        pairs = [_pair(seq, p) for p in range(1, len(seq) - 1)]
        running = {(f, s): [0] * 9 for f in range(3) for s in (0, 1)}
        bases = [0] * 4
        for p in range(1, len(seq) - 1):
            forward, backward = running[p % 3, 0], running[p % 3, 1]
            before = list(forward)
            for s, counts in enumerate((forward, backward)):
                counts[sites.PAIRS.index(pairs[p - 1][s])] += 1
            if p in rows:
                codon = seq[p - 1 : p + 2]
                ended = [n + codon.count(b) for n, b in zip(bases, sites.BASES)]
                assert rows[p].codon == codon and rows[p].frame == (p - 1) % 3 + 1
                assert list(rows[p].n) == [*bases, *ended, *before, *backward]
            if seq[p - 1] in sites.BASES:
                bases[sites.BASES.index(seq[p - 1])] += 1


def test_counts_at_any_place(spark, scanned, sequences):
    seq = sequences["many"]
    places = [("many", s, p, p) for s in (1, -1) for p in (1, 2, 3, sites.PIECE, sites.PIECE + 1, sites.PIECE + 2, 7001, len(seq) - 2)]
    got = orfs.counts_at(spark.createDataFrame(places, "contig_id string, strand int, pos int, own int"), scanned).collect()
    assert len(got) == len(places)
    pairs = [_pair(seq, p) for p in range(1, len(seq) - 1)]
    for r in got:
        met = [pairs[p - 1][r.strand < 0] for p in range((r.pos - 1) % 3 + 1, r.pos + (r.strand < 0), 3)]
        assert list(r.n) == [met.count(k) for k in sites.PAIRS]


def test_empty_and_too_short(spark):
    rows = spark.createDataFrame([("a", "", 0), ("b", "atgca", 5)], "contig_id string, seq string, length int")
    assert sites.scan(rows).count() == 0
    assert orfs.enumerate_orfs(sites.scan(rows)).count() == 0


def test_windows_and_codons_at_every_base(spark, sequences):
    """Rows a base come from the pieces that calls are made of: also contigs that are too short for genes."""
    every = {**sequences, "five": "gcatg", "three": "atg", "one": "g", "none": ""}
    contigs = spark.createDataFrame([(k, v, len(v)) for k, v in every.items()], "contig_id string, seq string, length int")
    expected = {(name, p) for name, seq in every.items() for p in range(1, len(seq) - 1)}
    triplets = sites.gc_triplets(contigs)
    columns = [F.col(f"g{k}") for k in (1, 2, 3)]
    indices = [max_index(*columns), min_index(*columns), max_index(*columns[::-1]), min_index(*columns[::-1])]
    rows = triplets.select("*", *(x.alias(n) for x, n in zip(indices, ("max_f", "min_f", "max_r", "min_r")))).collect()
    assert len(rows) == len(expected) and {(r.contig_id, r.pos) for r in rows} == expected
    half = Params().gc_window // 3 // 2
    for r in rows:
        seq = every[r.contig_id]
        gc = lambda p: sum(seq[q - 1] in "gcsbv" for q in range(p - 3 * (half - 1), p + 3 * half + 1, 3) if 1 <= q <= len(seq))
        assert (r.frame, r.g1, r.g2, r.g3) == ((r.pos - 1) % 3 + 1, gc(r.pos), gc(r.pos + 1), gc(r.pos + 2))
    key = lambda rows: sorted((r.contig_id, r.pos, r.frame, r.max_f, r.min_f, r.max_r, r.min_r) for r in rows)
    assert key(rows) == key(sites.gc_indices(sites.scan(contigs, shortest=0)).collect())
    found = orfs.codons(contigs).collect()
    assert len(found) == len(expected) and {(r.contig_id, r.pos) for r in found} == expected
    back, starts, stops = str.maketrans(CODES, COMPLEMENTS), Params().starts, Params().stops
    for r in found:
        codon = every[r.contig_id][r.pos - 1 : r.pos + 2]
        other = codon[::-1].translate(back)
        kind = "fs" if codon in starts else "rs" if other in starts else "fe" if codon in stops else "re" if other in stops else None
        assert (r.codon, r.frame, r["class"]) == (codon, (r.pos - 1) % 3 + 1, kind)


def test_orfs_over_long_frames(spark):
    """An ORF through many pieces, and frames without any stop: the work and the shuffle follow the pieces, not pairs of events."""
    n = sites.PIECE
    seqs = {"open": "atgccc" * n, "stop": "atg" + "ccc" * (2 * n) + "tag" + "ccc" * 100, "back": "cta" + "ggg" * (2 * n) + "cat" + "ggg" * 7}
    contigs = spark.createDataFrame([(k, v, len(v)) for k, v in seqs.items()], "contig_id string, seq string, length int")
    scanned = sites.scan(contigs)
    found = orfs.enumerate_orfs(scanned)
    # a frame that ends at a partition's last row is gone through again for each of its rows
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower().replace(" ", "").replace("$", "")
    rows = {(r.contig_id, r.strand, r.start, r.stop): r for r in found.where("frame IN (1, -1)").collect()}
    assert rows["stop", 1, 1, 6 * n + 4].length == 6 * n + 6 and sum(rows["stop", 1, 1, 6 * n + 4].n) == 2 * n + 1
    assert rows["back", -1, 6 * n + 4, 1].length == 6 * n + 6 and sum(rows["back", -1, 6 * n + 4, 1].n) == 2 * n + 1
    # starts that meet no stop end with the frame's last codon
    last = len(seqs["open"]) - 2
    assert sum(k[0] == "open" and k[1] > 0 and k[3] == last for k in rows) >= n - 30
    assert sorted(map(tuple, orfs.join_pieces(sites.scan_pairs(contigs)).collect())) == sorted(map(tuple, found.collect()))


def test_contigs_are_made_once(spark):
    """Letters of any text become the nucleotides that expressions give; an annotation's sequences are a table."""
    from orfweave.functions import sequence
    from orfweave.operators import profile
    from orfweave.plans.annotate import Annotation
    from orfweave.sources import readers

    texts = ["The Quick Brown Fox jumps OVER the lazy dog. Zz " * 9, "", None, "éaKB\U0001d400ſK-x9\n", "ggagga" * 9 + "aaGGAG", "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    letters = F.translate(F.lower(F.regexp_replace("text", "[^A-Za-z]", "")), readers.LETTERS, readers.NUCLEOTIDES)
    want = {tuple(r) for r in docs.select("doc_id", letters, F.length(letters)).collect()}
    found = readers.contigs_from_text(docs)
    assert {tuple(r) for r in found.collect()} == want
    run = Annotation(found)
    assert all("-contigs" in f for f in run.contigs.inputFiles()) and run.contigs.count() == 2
    run.release()
    # base counts with ambiguity codes, and windows that the end cuts short, as expressions give them
    odd = spark.createDataFrame([(1, "acgtnryswkmbvdh" * 3, 45), (2, "aggaggagatggaggta", 17), (3, "ggagga", 6)], "contig_id bigint, seq string, length int")
    norm = sequence.normalise(F.col("seq"))
    gc = odd.select("contig_id", F.length(F.regexp_replace(norm, "[at]", "")), F.length(F.regexp_replace(norm, "[cg]", "")))
    assert {tuple(r) for r in gc.collect()} == {(r.contig_id, r.n_g, r.n_a) for r in profile.base_frequencies(odd).collect()}
    tails = odd.select(F.right("seq", F.lit(20)).alias("tail"))
    short = tails.select(F.pandas_udf(profile._short_scores, "array<int>")("tail").alias("found"), F.explode(F.sequence(F.lit(1), F.length("tail"))).alias("n"), "tail")
    rows = short.select(F.col("found")[F.col("n") - 1].alias("a"), sequence.rbs_score(F.expr("right(tail, n)")).alias("b")).collect()
    assert len(rows) == 43 and all(r.a == r.b for r in rows) and any(r.a for r in rows)


def test_counters_side_by_side():
    """Counters of a whole piece don't run into each other, and ties of windows go as expressions have them."""
    import numpy as np

    tool = sites._Pieces(Params())
    for letter, at in (("a", 0), ("c", 3)):
        (first, *_) = tool.measure(letter * (tool.left + sites.PIECE + tool.right), tool.left, sites.PIECE, 30000, 10**6)
        totals = sites._unpacked(np.array([first[0]], np.int64), 1)[0].tolist()
        assert totals[:4] == [sites.PIECE * (k == at) for k in range(4)]
        # three equal windows: the last is the richest, the first the poorest
        assert totals[4:] == [sites.PIECE // 3 * (k % 9 == 6) for k in range(18)]
    abc = np.array([(a, b, c) for a in range(3) for b in range(3) for c in range(3)]).T
    want = [[sites.PAIRS.index((3 - w[::-1].index(max(w)), 1 + w.index(min(w)))) for w in map(list, (x[::way] for x in abc.T))] for way in (1, -1)]
    assert [p.tolist() for p in sites._places(*abc)] == want


def test_pieces_are_measured_together(monkeypatch):
    """Calls go along many pieces at once, and each gets what it gets alone, also with letters that are no bases."""
    import pyarrow as pa

    rng = random.Random(8)
    made = ["".join(rng.choices("acgtnry", (9, 5, 5, 9, 1, 1, 1), k=n)) for n in (1, 2, 5, 7, 2998, 2999, 3000, 3001, 7300)] + ["nnnnnn", "atgaaatag" * 40]
    tool, rows = sites._Pieces(Params()), []
    for k, s in enumerate(made):
        for first in range(0, len(s), sites.PIECE):
            head, part = s[max(0, first - tool.left) : first], s[first : first + sites.PIECE]
            rows.append((k, len(s), first, len(head), head + part + s[first + sites.PIECE :][: tool.right], len(part)))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32())
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["contig_id", "length", "first", "before", "context", "chunk_length"])
    alone = [list(sites._scanner(Params())([batch.slice(k, 1)])) for k in range(len(rows))]
    asked = []
    motif = sites._Pieces._motif
    monkeypatch.setattr(sites._Pieces, "_motif", lambda *a: asked.append(1) or motif(*a))
    together = list(sites._scanner(Params())([batch]))
    assert len(asked) == 2
    assert [r for b in together for r in b.to_pylist()] == [r for one in alone for b in one for r in b.to_pylist()]
