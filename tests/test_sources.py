"""Sources that have bad lines, graphs that go to a file and back, spans that don't overlap, stop chances by place."""

import random

import pytest
from pyspark.sql import functions as F

from orfweave.operators import graph, orfs
from orfweave.operators.graph_api import Graph
from orfweave.sources import readers


def test_bad_lines(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("g\t10\t20\tA-B\nhead\tstop\tlen\tcallers\n\nshort\t1\ng\t7\t\tA\n")
    assert [(r.genome, r.stop, r.length, r.callers) for r in readers.callers(spark, str(tmp_path / "c.tsv")).collect()] == [("g", 10, 20, "A-B")]
    good = "\t".join(["r1", "g.1", *"12345678", "1e-20", "50"])
    (tmp_path / "a.tsv").write_text(f"# x\n{good}\nr2\n\n" + good.replace("1e-20", "none") + "\n")
    assert [(r.read, r.orf, r.e_value) for r in readers.alignments(spark, str(tmp_path / "a.tsv")).collect()] == [("r1", "g.1", 1e-20)]
    (tmp_path / "n.tsv").write_text("all\tp1\t7\nphan\tp2\t0\n")
    assert [tuple(r) for r in readers.counts(spark, str(tmp_path / "n.tsv")).collect()] == [("all", "p1", 7), ("phan", "p2", 0)]
    (tmp_path / "l.json").write_text('{"a": [1, 2], "b": []}')
    assert sorted(tuple(r) for r in readers.length_map(spark, str(tmp_path / "l.json")).collect()) == [("a", 1), ("a", 2)]


def test_trnas(spark, tmp_path):
    (tmp_path / "t.txt").write_text(">one extra\n2 genes found\n1   tRNA-Phe   [30,100]   34  (gaa)\n\n2   tRNA-Leu   c[300,380]   35  (tag)\nodd\n>two\n0 genes found\nName\ttRNA\tBegin\tEnd\ntwo \t1\t40\t110\tAla\ntwo\t2\tx\ty\tAla\n")
    got = sorted(tuple(r) for r in readers.trnas(spark, str(tmp_path / "t.txt")).select("contig_id", "start", "stop").collect())
    assert got == [("one", 30, 100), ("one", 380, 300), ("two", 40, 110)]


def test_graph_files(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.5)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([("lone",)], "node string")
    for directed in (True, False):
        g = Graph.of(edges, directed, nodes)
        path = str(tmp_path / f"g{directed}")
        g.save(path, "mine")
        assert Graph.load(spark, path).equals(g)
        assert readers.graph_head(spark, path) == {"NAME": "mine", "DIRECTED": str(directed), "V": "4", "E": "2"}
    assert {r.line for r in g.ncol().collect()} == {"# a\nb", "# b\nc 2.5", "# c", "# lone"}
    assert {r.line for r in g.lgl().collect()} == {"a b", "b c 2.5"}
    assert {r.line for r in Graph.of(edges).shown().collect()} == {"a: b(1.0)", "b: c(2.5)"}
    with pytest.raises(ValueError, match="loops"):
        g.add_edges(spark.createDataFrame([("a", "a", 1.0)], edges.schema))
    with pytest.raises(ValueError, match="parallel"):
        g.add_edges(edges.limit(1))


def test_disjoint_spans(spark):
    rng = random.Random(7)

    def spans():
        out = []
        for _ in range(60):
            a, n = rng.randrange(200), rng.choice((0, 1, 5, 30))
            out.append((rng.randrange(3), *((a, a + n) if rng.random() < 0.5 else (a + n, a))))
        return out

    schema = "contig_id int, start int, stop int"
    for _ in range(3):
        first, second = spans()[:25], spans()
        low = lambda s: (min(s[1:]), max(s[1:]))
        free = [s for s in second if not any(t[0] == s[0] and low(t)[0] < low(s)[1] and low(t)[1] > low(s)[0] for t in first)]
        got = graph.disjoint_trnas(spark.createDataFrame(first, schema), spark.createDataFrame(second, schema))
        assert sorted(map(tuple, got.collect())) == sorted(first + free)


def test_positional_stop_chance(spark, monkeypatch):
    rng = random.Random(3)
    seq = "".join(rng.choices("acgtn", (3, 2, 2, 2, 0.2), k=800))
    rows = []
    for _ in range(40):
        a = rng.randrange(1, 600)
        b = a + 3 * rng.randrange(1, 60)
        rows.append((1, 1, a, b) if rng.random() < 0.5 else (1, -1, b, a))
    rows = sorted(set(rows))
    monkeypatch.setattr(orfs.pieces, "PIECE", 60)
    found = orfs.positional_stop_chance(spark.createDataFrame(rows, "contig_id int, strand int, start int, stop int"), spark.createDataFrame([(1, seq, len(seq))], "contig_id int, seq string, length int"))
    for r in found.collect():
        dna = seq[min(r.start, r.stop) - 1 : max(r.start, r.stop) + 2]
        if r.strand < 0:
            dna = dna[::-1].translate(str.maketrans("acgtn", "tgcan"))
        parts = [[c for c in dna[k::3] if c != "n"] for k in range(3)]
        f = lambda k, c: parts[k].count(c) / len(parts[k])  # noqa: B023, E731
        want = f(0, "t") * (f(1, "a") * f(2, "a") + f(1, "g") * f(2, "a") + f(1, "a") * f(2, "g"))
        assert r.pp_stop == pytest.approx(want, abs=1e-12)
    assert found.count() == len(rows)


def test_positional_stop_chance_of_shared_places(spark):
    """ORFs that share a stop share its lookup: texts of pieces aren't counted again for each ORF."""
    seq = "atg" * 500 + "tag"
    rows = [(1, 1, a, 1501) for a in range(1, 1400, 3)]
    found = orfs.positional_stop_chance(spark.createDataFrame(rows, "contig_id int, strand int, start int, stop int"), spark.createDataFrame([(1, seq, len(seq))], "contig_id int, seq string, length int"))
    assert "translate(" not in found._jdf.queryExecution().toString()
    got = {r.start: r.pp_stop for r in found.collect()}
    n = 501
    # one t first, one a second (the stop's), a g third in all codons
    assert len(got) == len(rows) and got[1] == pytest.approx(1 / n * (1 / n * 0 + 500 / n * 0 + 1 / n * 1))
