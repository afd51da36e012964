"""FASTA read in byte ranges: the pieces of whole contigs, whatever the ranges."""

import random

import pytest

from orfweave.operators import orfs, profile, sites
from orfweave.sources import readers


def written(tmp_path, records, width=37, name="x.fasta"):
    lines = ["lost text"] + [x for head, seq in records for x in [f">{head}", *(seq[k : k + width] for k in range(0, len(seq), width))]]
    (tmp_path / name).write_text("\n".join(lines) + "\n")


@pytest.fixture()
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_pieces_of_ranges(spark, tmp_path, small_ranges):
    rng = random.Random(5)
    dna = lambda n: "".join(rng.choices("ACGTacgtn", k=n))
    folder = tmp_path / "f"
    folder.mkdir()
    records = [("one first of all", dna(5000)), ("two", dna(10)), ("none", ""), ("three x", dna(640)), ("four", dna(2500))]
    written(folder, records, name="a.fasta")
    more = [("five", dna(1)), ("six", dna(3001))]
    written(folder, more, width=1200, name="b.fasta")
    # one sequence is read by many tasks
    assert spark.read.text(str(folder)).rdd.getNumPartitions() > 12
    contigs = readers.fasta(spark, str(folder)).where("length > 0")
    assert contigs.count() == 6
    for size, left, right in ((100, 20, 23), (30, 30, 30), (3000, 61, 62)):
        columns = ["contig_id", "length", "first", "before", "context", "chunk_length"]
        want = sorted(map(tuple, profile.chunks(contigs, size, left, right).select(columns).collect()))
        got = sorted(map(tuple, readers.fasta_pieces(spark, str(folder), size, left, right).select(columns).collect()))
        assert got == want


def test_orfs_of_pieces(spark, tmp_path, small_ranges):
    """Genes' candidates from pieces alone are those of whole sequences."""
    rng = random.Random(6)
    written(tmp_path, [("long", "".join(rng.choices("acgt", (3, 2, 2, 2), k=7000)))])
    path = str(tmp_path / "x.fasta")
    whole = sites.scan(readers.fasta(spark, path))
    parts = sites.scan_pieces(readers.fasta_pieces(spark, path, sites.PIECE, *sites.reaches()))
    rows = lambda s: sorted((r.strand, r.start, r.stop, r.rbs_score, tuple(r.n)) for r in orfs.enumerate_orfs(s).collect())
    assert rows(parts) == rows(whole) and len(rows(whole)) > 20


def test_name_that_comes_twice(spark, tmp_path):
    written(tmp_path, [("a", "ACGT"), ("a", "GG")])
    with pytest.raises(Exception, match="comes twice"):
        readers.fasta_pieces(spark, str(tmp_path / "x.fasta"), 10, 1, 1).collect()
