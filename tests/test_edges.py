"""Edges between nodes within reach, against the rules in plain Python."""

import itertools
import random

import pytest

from orfweave.operators import graph
from orfweave.plans.annotate import Annotation


def kind_of(l, r):
    """The edge between two nodes of a contig, l before r; each gene, type, frame, other and position."""
    same, differ = l["frame"] * r["frame"] > 0, l["type"] != r["type"]
    opens, ahead = l["type"] == "start", l["frame"] > 0
    ends = not opens if ahead else opens
    nested = r["position"] < l["other"] and r["other"] < l["position"]
    if "tRNA" in (l["gene"], r["gene"]):
        return "gap_same" if ends and same == differ else None
    if same and differ:
        return "gap_same" if ends else "overlap_same" if l["frame"] != r["frame"] and nested else None
    if not same and not differ and not opens:
        return "gap_diff" if r["frame"] < 0 else "overlap_diff" if nested and r["other"] + 3 < l["position"] else None
    if not same and not differ:
        return ("gap_diff" if r["position"] - l["position"] > 2 else None) if r["frame"] > 0 else "overlap_diff" if nested else None
    return None


def made(rng, n, span, names):
    rows = []
    for _ in range(n):
        gene = rng.choice(["CDS"] * 9 + ["tRNA"])
        frame = rng.choice([1, 2, 3, -1, -2, -3] if gene == "CDS" else [4, -4])
        position = rng.randrange(1, span)
        rows.append((rng.choice(names), gene, rng.choice(["start", "stop"]), frame, position, max(1, position + rng.randrange(-700, 700)), rng.random() / 10, span, 0.03))
    return rows


@pytest.mark.parametrize("kind,names,stretch", [("bigint", [1, 2, 3], 32768), ("string", ["a", "b"], 700), ("string", ["a", None], 100)])
def test_connections(spark, monkeypatch, kind, names, stretch):
    monkeypatch.setattr(graph, "STRETCH", stretch)
    schema = f"contig_id {kind}, gene string, type string, frame int, position int, other int, p double, contig_length int, pgap double"
    rows = made(random.Random(5), 500, 3000, names)
    nodes = spark.createDataFrame(rows, schema).repartition(7)
    want = []
    named = [dict(zip([c.split()[0] for c in schema.split(", ")], r)) for r in rows]
    for l, r in itertools.permutations(named, 2):
        if l["contig_id"] is not None and l["contig_id"] == r["contig_id"] and 0 < r["position"] - l["position"] < 500 and (k := kind_of(l, r)):
            first, second = (l, r) if k.startswith("gap") else (r, l)
            p = l["pgap"] if k.startswith("gap") else (l["p"] + r["p"]) / 2
            key = lambda x: (x["gene"], x["type"], x["frame"], x["position"])
            want.append((l["contig_id"], *key(first), *key(second), k, round(p, 12)))
    found = graph.connections(nodes)
    key = lambda x: (x.contig_id, *x.source, *x.target, x.kind, round(x.p, 12))
    assert sorted(map(key, found.collect())) == sorted(want)
    some = graph.connections(nodes, kinds=("overlap_diff",)).collect()
    assert sorted(map(key, some)) == sorted(w for w in want if w[-2] == "overlap_diff")


def test_dense_starts(spark):
    """Starts side by side on one strand have no edges with each other, so none of their pairs may be looked at."""
    rows = [(1, "CDS", "start", 1, 1 + 3 * k, 30001, 0.1, 31000, 0.1) for k in range(10000)]
    nodes = spark.createDataFrame(rows, "contig_id bigint, gene string, type string, frame int, position int, other int, p double, contig_length int, pgap double")
    found = graph.connections(nodes)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 0


def test_edges_counted_unwritten(spark):
    """What only counts edges doesn't write them."""
    dna = "".join(random.Random(8).choices("acgt", k=3000))
    run = Annotation(spark.createDataFrame([(1, dna, len(dna))], "contig_id bigint, seq string, length int"))
    n = run.passing_edges().count()
    assert "edges" not in run._made and n > 0
    assert run.edges.count() == n and run.passing_edges() is run.edges
