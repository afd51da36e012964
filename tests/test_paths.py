"""Paths by blocks against paths by contigs."""

import random

import pytest
from pyspark.sql import functions as F

from orfweave.plans import paths
from orfweave.plans.annotate import Annotation, solve
from orfweave.plans.scratch import Scratch

NODE = "struct<gene: string, type: string, frame: int, position: int>"
EDGES = f"contig_id bigint, source {NODE}, target {NODE}, cost double, ln_score double"


def random_edges(contig, rng, n, length):
    """Edges on, back and far ahead between nodes of a contig, in whole costs of which many tie. Potentials keep cycles dear."""
    nodes = sorted({(rng.choice(("start", "stop")), rng.choice((-2, -1, 1, 2)), rng.randrange(1, length)) for _ in range(n)}, key=lambda x: x[2])
    nodes = [("CDS", *x) for x in nodes]
    source, target = ("source", "source", 0, 0), ("target", "target", 0, length + 1)
    height = {x: rng.randint(-20, 20) for x in nodes} | {source: 0, target: 0}
    out = {}
    for k, a in enumerate(nodes):
        for b in rng.sample(nodes[max(0, k - 4) : k + 9], min(4, len(nodes[max(0, k - 4) : k + 9]))) + rng.sample(nodes[k:], 1):
            if a != b:
                # far jumps cost more than steps
                out[a, b] = rng.randint(1, 3) + abs(b[3] - a[3]) // 5 * 2 + height[b] - height[a]
    for a in nodes[:6]:
        out[source, a] = rng.randint(1, 3) + height[a]
    for a in nodes[-6:]:
        out[a, target] = rng.randint(1, 3) - height[a]
    return [(contig, a, b, float(w), None) for (a, b), w in out.items()]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("contig_id", "number", "gene", "frame", "left", "right").collect())


def test_random_graphs(spark):
    rng = random.Random(4)
    rows = [r for c in range(6) for r in random_edges(c, rng, 20 + 25 * c, 900)]
    # a contig that has no path
    rows += [r for r in random_edges(9, rng, 40, 900) if r[2][0] != "target"]
    edges = spark.createDataFrame(rows, EDGES).repartition(3)
    want = rows_of(solve(edges))
    assert {r[0] for r in want} == set(range(6)) and len(want) > 20
    assert rows_of(paths.solve_blocks(edges, block=90)) == want


def test_negative_cycle(spark):
    node = lambda p: ("CDS", "start", 1, p)
    source, target = ("source", "source", 0, 0), ("target", "target", 0, 401)
    rows = [(1, source, node(10), 1.0, None), (1, node(10), node(300), -5.0, None), (1, node(300), node(10), 1.0, None), (1, node(300), target, 1.0, None)]
    with pytest.raises(Exception, match="negative cycle"):
        paths.solve_blocks(spark.createDataFrame(rows, EDGES), block=100).count()


def test_contigs_in_blocks(spark):
    """Ten blocks and more, with stretches without genes, and edges back between overlapping ones."""
    rng = random.Random(2)
    dna = lambda n: "".join(rng.choices("acgt", (3, 2, 2, 2), k=n))
    # stop codons in all six frames
    bare = "tagttaattaactaacta" * 40
    seqs = [dna(3300) + bare + dna(1900) + bare + dna(500), dna(5000), dna(300)]
    contigs = spark.createDataFrame([(k, s, len(s)) for k, s in enumerate(seqs)], "contig_id bigint, seq string, length int")
    whole, parts = Annotation(contigs), Annotation(contigs, block=500)
    kinds = {r.kind for r in whole.edges.select("kind").distinct().collect()}
    assert {"long_gap_same", "overlap_same", "gap_same", "orf"} <= kinds
    want = rows_of(solve(whole.edges))
    assert len(want) > 20
    # the same edges for both
    parts._made = whole._made
    got = parts.calls.select("contig_id", "number", "gene", F.when(F.col("strand") < 0, -1).otherwise(1).alias("strand"), "left", "right").collect()
    assert sorted((r.contig_id, r.number, r.gene, r.left, r.right) for r in got) == [(c, n, g, left, right + 2) for c, n, g, _, left, right in want]


def test_no_task_sees_a_contig(spark):
    """Groups of the blocks' steps are blocks and tables between them."""
    rng = random.Random(6)
    edges = spark.createDataFrame(random_edges(1, rng, 400, 6000), EDGES)
    rows = Scratch(spark, "test").write(paths._leveled(edges, 100), "leveled")
    assert rows.agg(F.max("level")).first()[0] == 6
    own = rows.where("level = 0").groupBy("block").count().agg(F.max("count")).first()[0]
    assert own < rows.count() / 20


def test_costs_and_nodes_of_many(spark):
    """Costs are those of one after another, next to whole thousandths as well; nodes' numbers sort as their texts do."""
    import numpy as np
    from pyspark.sql import functions as F

    rng = random.Random(8)
    some = [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-5, 30) for _ in range(3000)] + [k / 1000 for k in range(-2000, 2000)]
    some += [float(np.nextafter(k / 1000, way)) for k in range(-500, 500) for way in (-9, 9)] + [float("-inf")]
    logs = [float("nan")] * (len(some) - 1) + [800.25]
    assert paths.whole_costs(np.array(some), np.array(logs)) == [paths.whole_cost(c, x) for c, x in zip(some, logs)]
    nodes = [(p, f, t, g) for p in (0, 1, 9, 10, 123456) for f in (-4, -3, -2, -1, 0, 1, 2, 3, 4) for t in ("source", "start", "stop", "target") for g in ("CDS", "source", "tRNA", "target")]
    rows = spark.createDataFrame(nodes, "position int, frame int, type string, gene string").select(F.struct("gene", "type", "frame", "position").alias("node"))
    both = [tuple(r) for r in rows.select(paths.node_key(F.col("node")), paths.node_number(F.col("node"))).collect()]
    assert [k for k, _ in sorted(both)] == [k for k, _ in sorted(both, key=lambda r: r[1])] and len({n for _, n in both}) == len(nodes)


def test_contigs_across_batches():
    """A task has a contig at a time: batches that cut one are put together, and a contig without a target has no path."""
    import numpy as np
    import pyarrow as pa

    source, (a, b, end) = 65, ((p * 144 + (3 + 4) * 16 + k * 4) for p, k in ((5, 1), (50, 2), (90, 3)))
    end = 90 * 144 + 4 * 16 + 3 * 4 + 3
    edges = [(c, *e) for c in (1, 2, 7) for e in ((source, a, 1.0), (a, b, -2.0), (b, end, 1.0)) if (c, e[1]) != (2, end)]
    for size in (1, 2, 3, 8):
        batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in (*zip(*edges[k : k + size]), [float("nan")] * len(edges[k : k + size]))], ["contig_id", "s", "t", "cost", "ln_score"]) for k in range(0, len(edges), size)]
        found = [r for some in paths.contig_batches(iter(batches)) for r in paths.calls_of(some).to_pylist()]
        assert [tuple(r.values()) for r in found] == [(1, 0, "CDS", 3, 5, 50), (7, 0, "CDS", 3, 5, 50)]
