"""Calls whose edges are made where contigs are solved, against those of the written table of edges."""

import random

from pyspark.sql import functions as F

from orfweave.operators import graph
from orfweave.plans import paths
from orfweave.plans.annotate import Annotation, solve


def made(spark, trnas=None, **more):
    rng = random.Random(11)
    bare = "tagttaattaactaacta" * 40
    dna = lambda n: "".join(rng.choices("acgt", (4, 3, 2, 3), k=n))
    seqs = [dna(rng.randrange(200, 1500)) for _ in range(25)] + [dna(900) + bare + dna(1100), bare, dna(4000)]
    contigs = spark.createDataFrame([(k, s, len(s)) for k, s in enumerate(seqs)], "contig_id bigint, seq string, length int").repartition(3)
    return Annotation(contigs, trnas, **more)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_edges_along(spark):
    """The same edges and costs, with tRNAs and stretches without genes; a contig's lie next to each other."""
    trnas = spark.createDataFrame([(2, 40, 130), (25, 700, 610), (27, 2000, 2090)], "contig_id bigint, start int, stop int")
    run = made(spark, trnas)
    flat = run.edges.select("contig_id", graph.number(F.col("source")).alias("s"), graph.number(F.col("target")).alias("t"), "cost", "ln_score", (F.col("kind") == "orf").alias("orf"))
    found = graph.edges_along(run.nodes, run.scored, graph_longest(run), run.profile, run.params)
    assert rows_of(found) == rows_of(flat) and {"tRNA", "long_gap_same"} <= {r.kind for r in run.edges.select("kind").distinct().collect()}
    for part in found.select("contig_id").rdd.glom().collect():
        ids = [r.contig_id for r in part]
        assert sum(a != b for a, b in zip(ids, ids[1:])) == max(0, len(set(ids)) - 1)
    run.release()


def graph_longest(run):
    from orfweave.operators import orfs

    return orfs.longest(run.orfs)


def test_calls_write_no_edges(spark):
    """No edge is written or moved, and what only the scores need goes when they are there."""
    run = made(spark)
    calls = run.calls
    assert not {"edges", "pieces"} & set(run._made)
    got = rows_of(calls.select("contig_id", "number", "gene", "strand", "left", "right", "score", "ln_score"))
    own = run.scored.select("contig_id", "frame", F.least("start", "stop").alias("left"), F.greatest("start", "stop").alias("right"), "score", "ln_score")
    want = solve(run.edges).join(own, ["contig_id", "frame", "left", "right"], "left")
    want = want.select("contig_id", "number", "gene", F.when(F.col("frame") < 0, -1).otherwise(1).alias("strand"), "left", F.col("right") + 2, F.coalesce("score", F.lit(0.0)), "ln_score")
    assert got == rows_of(want) and sum(r[-1] is not None for r in got) > 20
    run.release()


def test_orfs_of_pairs():
    """Pairs that are no ORF's ends have no score; an ORF that is there twice gives its pair twice."""
    import numpy as np

    node = lambda p, f, k: (p * 9 + f) * 16 + k * 4
    pairs = np.array([(node(5, 5, 1), node(50, 5, 2)), (node(60, 5, 1), node(90, 5, 2)), (node(5, 5, 1), node(50, 5, 2))])
    s, t = np.array([node(5, 5, 1), node(5, 5, 1), node(5, 6, 1)]), np.array([node(50, 5, 2), node(50, 5, 2), node(50, 6, 2)])
    row, orf = paths._orfs_of(np.array([0, 0, 9]), pairs, np.array([0, 0, 0]), s, t)
    assert row.tolist() == [0, 0, 1, 2] and orf.tolist() == [0, 1, -1, -1]
    row, orf = paths._orfs_of(np.array([0, 0, 9]), pairs, *(np.zeros(0, np.int64),) * 3)
    assert row.tolist() == [0, 1, 2] and orf.tolist() == [-1, -1, -1]
