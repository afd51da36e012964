"""Writers' text on hand-made calls, FASTA files in one task, and the command line."""

import math
import random

import pytest

from orfweave import __main__ as command
from orfweave.sinks import formats
from orfweave.sources import readers

SEQ = "ccatgaaatagtt" + "a" * 60


@pytest.fixture(scope="module")
def calls(spark):
    rows = [("one", 0, "CDS", 1, 3, 11, -12.5), ("one", 1, "CDS", -1, 20, 28, -0.25), ("one", 2, "tRNA", 1, 40, 60, -20.0)]
    return spark.createDataFrame(rows, "contig_id string, number int, gene string, strand int, left int, right int, score double")


@pytest.fixture(scope="module")
def contigs(spark):
    return spark.createDataFrame([("one", SEQ, len(SEQ))], "contig_id string, seq string, length int")


def lines(df):
    return [r.line for r in df.orderBy("place").collect()]


def test_tabular(calls):
    assert lines(formats.tabular(calls)) == ["#id:\tone", "#START\tSTOP\tFRAME\tCONTIG\tSCORE", "3\t11\t+\tone\t-1.250000E+01", "28\t20\t-\tone\t-2.500000E-01"]


def test_scores_beyond_doubles(spark):
    rows = [("c", "CDS", 1, 1, 90, float("-inf"), 1000.0), ("c", "CDS", 1, 100, 190, -2.0, 0.7), ("c", "CDS", 1, 200, 290, float("-inf"), math.log(10) * 1000 - 1e-9)]
    calls = spark.createDataFrame(rows, "contig_id string, gene string, strand int, left int, right int, score double, ln_score double")
    assert [line.split("\t")[4] for line in lines(formats.tabular(calls))[2:]] == ["-1.970071E+434", "-2.000000E+00", "-1.000000E+1000"]


def test_gff(calls):
    assert lines(formats.gff3(calls))[0] == "one\torfweave\tCDS\t3\t11\t-1.250000E+01\t+\t0\tID=one_CDS_1;note=score:-1.250000E+01"
    assert lines(formats.gff3(calls, "2"))[1] == 'one\torfweave\tCDS\t20\t28\t-2.500000E-01\t-\t0\tgene_id "one_2"'


def test_fna_and_faa(calls, contigs):
    assert lines(formats.fna(calls, contigs)) == [">one_CDS_[3..11] [note=score:-1.250000E+01]\natgaaatag", ">one_CDS_[complement(20..28)] [note=score:-2.500000E-01]\nttttttttt"]
    assert lines(formats.faa(calls, contigs)) == [">one_CDS_[3..11] [note=score:-1.250000E+01]\nMK*", ">one_CDS_[complement(20..28)] [note=score:-2.500000E-01]\nFFF"]


def test_genbank(calls, contigs):
    got = "\n".join(lines(formats.genbank(calls, contigs))).split("\n")
    assert got[0] == "LOCUS       one                   73 bp " and got[1] == "FEATURES             Location/Qualifiers"
    assert got[2:6] == ["     CDS             3..11", " " * 21 + "/note=score:-1.250000E+01", "     CDS             complement(20..28)", " " * 21 + "/note=score:-2.500000E-01"]
    assert got[8] == "ORIGIN" and got[9] == "        1 ccatgaaata gttaaaaaaa aaaaaaaaaa aaaaaaaaaa aaaaaaaaaa aaaaaaaaaa"
    assert got[10] == "       61 aaaaaaaaaa aaa" and got[11] == "//"


def test_partial_tabular(spark, calls, contigs):
    more = contigs.union(spark.createDataFrame([("two", "acgt", 4)], contigs.schema))
    got = {r.contig_id: [] for r in more.collect()}
    for r in formats.partial_tabular(calls, more).orderBy("contig_id", "place").collect():
        got[r.contig_id].append(r.line)
    # the second gene has neither a start nor a stop codon
    assert got == {"one": ["3\t11\t+\tone\t-1.250000E+01", ">73\t<1\t-\tone\t-2.500000E-01"], "two": ["#id:\ttwo NO ORFS FOUND"]}


def test_edge_dump(spark):
    node = "struct<gene:string,type:string,frame:int,position:int>"
    edges = spark.createDataFrame([("one", ("CDS", "start", 1, 3), ("CDS", "stop", 1, 9), -1.5)], f"contig_id string, source {node}, target {node}, cost double")
    assert formats.edge_dump(edges).first().line == "Node('CDS','start',1,3)\tNode('CDS','stop',1,9)\t-1500.0"


def test_preambles_of_many_files(spark, tmp_path):
    """Eight files that one task reads: what stands before each first header is no contig."""
    for k in range(8):
        (tmp_path / f"f{k}.fa").write_text(("lost line\nmore\n" if k % 2 else "") + f">c{k} text\nACGT\n>d{k}\nGG\nTT\n")
    got = {(r.contig_id, r.description, r.seq) for r in readers.fasta(spark, str(tmp_path)).collect()}
    assert got == {x for k in range(8) for x in ((f"c{k}", "text", "acgt"), (f"d{k}", "", "ggtt"))}


def test_command(spark, tmp_path, capsys):
    rng = random.Random(5)
    gene = lambda: "atg" + "".join(rng.choices("acg", k=297)) + "taa"
    path = tmp_path / "in.fa"
    path.write_text(f"preamble\n>b first\n{gene()}\n>a\n{gene()}\n")
    out = tmp_path / "out.txt"
    assert command.main([str(path), "-o", str(out)]) == 0
    text = out.read_text().splitlines()
    assert text[0] == "#id:\tb" and text[1].startswith("#START") and text[2].startswith("1\t303\t+\tb\t-") and "#id:\ta" in text
    assert command.main([str(path), "-f", "fasta"]) == 0 and capsys.readouterr().out.startswith(">b_CDS_[1..303] [note=score:-")
    assert command.main([str(path), "-d"]) == 0
    dumped = capsys.readouterr().out.splitlines()
    assert dumped and all(line.count("\t") == 2 and line.startswith("Node(") for line in dumped)
    (tmp_path / "none.fa").write_text("nothing\n")
    assert command.main([str(tmp_path / "none.fa")]) == 0 and "no sequences" in capsys.readouterr().out
    with pytest.raises(FileNotFoundError):
        command.main([str(tmp_path / "missing.fa")])


def test_partial_genes(spark):
    """Genes at the edges of a contig, on both strands, as the older formats have them."""
    seq = "cc" + "gccaaatag" + "atgaaataa" + "ttaaaacat" + "ttaaaagcc" + "aaaaaaaaa" + "a"
    contigs = spark.createDataFrame([("one", seq, len(seq))], "contig_id string, seq string, length int")
    rows = [(1, 3, 11), (1, 12, 20), (-1, 21, 29), (-1, 30, 38), (1, 39, 47)]
    calls = spark.createDataFrame([("one", k, "CDS", s, a, b, -(1234.5 * 10.0**k)) for k, (s, a, b) in enumerate(rows)], "contig_id string, number int, gene string, strand int, left int, right int, score double")
    trna = spark.createDataFrame([("one", 9, "tRNA", -1, 5, 12, -20.0)], calls.schema)
    got = [r.line for r in formats.partial_fasta(calls.unionByName(trna), contigs).orderBy("place").collect()]
    assert got == [
        ">one.9 [START=<1] [SCORE=-1.234500E+03]\nccgccaaatag",
        ">one.20 [START=12] [SCORE=-1.234500E+04]\natgaaataa",
        ">one.21 [START=29] [SCORE=-1.234500E+05]\natgttttaa",
        # no start codon on the other strand, but not near the edge: its own bases
        ">one.30 [START=>48] [SCORE=-1.234500E+06]\nggcttttaa",
        ">one.45 [START=39] [SCORE=-1.234500E+07]\naaaaaaaaa",
    ]
    got = "\n".join(r.line for r in formats.partial_genbank(calls.unionByName(trna), contigs).orderBy("place").collect()).split("\n")
    assert got[:4] == ["LOCUS       one        48 bp    DNA             PHG", "DEFINITION  one", "FEATURES             Location/Qualifiers", "     source          1..48"]
    assert got[4:6] == ["     CDS             <1..11", " " * 21 + '/note="weight=-1.23E+3;"']
    assert "     tRNA            complement(5..10)" in got and "     CDS             complement(30..>48)" in got and "     CDS             complement(21..29)" in got
    assert got[-1] == "//" and got[-2] == "        1 ccgccaaata gatgaaataa ttaaaacatt taaaagccaa aaaaaaaa"
    # codons are the run's own
    from orfweave.params import Params, start_weights

    own = Params(starts=start_weights("gcc:1"), stops=("tag",))
    assert formats.partial_tabular(calls, contigs, own).orderBy("place").first().line.startswith("3\t11\t+")
