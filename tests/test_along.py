"""What goes along a contig once: starts that meet stops pieces away, genes cut out, proteins."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from orfweave.functions import sequence
from orfweave.operators import orfs, profile, sites
from orfweave.sinks import formats


def test_starts_meet_stops_pieces_away(spark):
    """A contig's open starts are settled in the pass over its pieces, with no window or exchange after it."""
    rng = random.Random(4)
    no_stops = "".join(rng.choice(["atg", "gtg", "gcc", "cat", "cac", "acg"]) for _ in range(5000))
    made = [no_stops, no_stops + "taa" + no_stops, "".join(rng.choices("acgt", (5, 2, 2, 2), k=13000)), "c" * 9001, "tta" + no_stops[:6000] + "c", "".join(rng.choices("acgtn", k=2999)), "acgtac"]
    contigs = spark.createDataFrame([(k, s, len(s)) for k, s in enumerate(made)], "contig_id bigint, seq string, length int")
    along = orfs.join_pieces(sites.scan_pairs(contigs))
    plan = along._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange") == 1
    found = sorted(map(tuple, along.collect()))
    assert found == sorted(map(tuple, orfs.enumerate_orfs(sites.scan(contigs)).collect()))
    assert max(r[5] for r in found) > 3 * sites.PIECE


def test_cut(spark):
    rng = random.Random(6)
    seqs = {k: "".join(rng.choices("acgtnr", k=n)) for k, n in enumerate((60, 333, 700))}
    genes = []
    for k, s in seqs.items():
        for number in range(40):
            left = rng.randrange(1, 6) if number < 5 else rng.randrange(1, len(s) - 10)
            right = len(s) - number if number < 5 else rng.randrange(left, len(s) + 1)
            genes.append((k, number, rng.choice([1, -1]), left, right))
    rows = formats.cut(spark.createDataFrame(genes, "contig_id bigint, number int, strand int, left int, right int"), spark.createDataFrame(list(seqs.items()), "contig_id bigint, seq string"))
    # a gene's slice doesn't begin at the contig's first base: that took time by the square of the contig
    assert "MapInArrow" in rows._jdf.queryExecution().executedPlan().toString()
    want = []
    for k, number, strand, left, right in genes:
        s = seqs[k]
        dna = s[left - 1 : right]
        dna = dna if strand > 0 else dna[::-1].translate(str.maketrans(sequence.CODES, sequence.COMPLEMENTS))
        want.append((k, len(s), number, strand, left, right, dna, s[: left - 1] if left <= 3 else "", s[right : right + 3] if right > len(s) - 3 else ""))
    assert sorted(map(tuple, rows.collect())) == sorted(want)


def test_proteins(spark):
    dnas = [None, "", "at", "atgtaa", "atgnnnaag", "tagtga", "atggcttaaacgacgacg", "ATGatg", "atéatg"]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(dnas)], "k int, dna string").withColumn("protein", sequence.translate_codons(F.col("dna")))
    got = rows.withColumn("entropy", sequence.entropy(F.col("protein"))).orderBy("k").collect()
    table = sequence.codon_table()
    for r in got:
        want = None if r.dna is None else "".join(table.get(r.dna[k : k + 3], "X") for k in range(0, len(r.dna) // 3 * 3, 3))
        assert r.protein == want
        counts = Counter(want or "")
        shares = [n / counts.total() for x, n in counts.items() if x != "*"]
        assert (r.entropy is None) == (not shares)
        assert not shares or abs(r.entropy + sum(p * math.log10(p) for p in shares)) < 1e-12


def test_background_measures_motifs_alone(spark, monkeypatch):
    """The background of motif scores doesn't ask for windows, pairs and events of all pieces."""
    rng = random.Random(12)
    made = ["".join(rng.choices("acgtn", (5, 2, 6, 2, 1), k=n)) for n in (6, 20, 21, 40, 2999, 3001, 9500)] + ["ggagga" * 1200]
    contigs = spark.createDataFrame([(k, s, len(s)) for k, s in enumerate(made)], "contig_id bigint, seq string, length int")
    want = sorted(map(tuple, profile.rbs_background(contigs, sites.scan(contigs)).collect()))
    monkeypatch.setattr(sites, "scan", None)
    assert sorted(map(tuple, profile.rbs_background(contigs).collect())) == want
