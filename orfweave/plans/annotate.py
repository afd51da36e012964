"""From contigs to gene calls."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orfweave.operators import graph, orfs, profile, sites
from orfweave.params import DEFAULT, Params
from orfweave.plans import paths
from orfweave.plans.scratch import Scratch

_CALLS = "contig_id {kind}, number int, gene string, frame int, left int, right int"


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in paths.contig_batches(batches):
        yield paths.calls_of(some)


def solve(edges: DataFrame, kind: str = "bigint") -> DataFrame:
    """The cheapest path of every contig as disjoint pairs of nodes: contig_id, number, gene, frame, left, right. A task goes
    along its contigs one after another and has one in memory at a time; see paths for long ones. Contigs without a path
    have no rows."""
    flat = edges.select("contig_id", paths.node_number(F.col("source")).alias("s"), paths.node_number(F.col("target")).alias("t"), "cost", "ln_score")
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return flat.repartition(n, "contig_id").sortWithinPartitions("contig_id").mapInArrow(_solved, _CALLS.format(kind=kind))


class Annotation:
    """The tables of a run over contigs (contig_id, seq in lower case, length), each worked out once when first asked for.
    trnas (contig_id, start, stop), where given, are masked. Paths of contigs of over block bases are found in blocks."""

    def __init__(self, contigs: DataFrame, trnas: DataFrame | None = None, params: Params = DEFAULT, block: int = paths.BLOCK):
        self._given, self.trnas, self.params = contigs.where(F.col("length") >= profile.SHORTEST), trnas, params
        self.block = block
        self._scratch = Scratch(contigs.sparkSession, "annotation")
        self._made: dict[str, DataFrame] = {}

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            # written, not cached: the next step's plan starts anew, and a lost executor loses nothing
            self._made[name] = self._scratch.write(make(), name)
        return self._made[name]

    def release(self) -> None:
        for df in self._made.values():
            self._scratch.drop(df)
        self._made = {}

    @property
    def contigs(self) -> DataFrame:
        """Sequences are made once; steps that need their lengths alone read no more than those."""
        return self._once("contigs", lambda: self._given.select("contig_id", "seq", "length"))

    @property
    def profile(self) -> DataFrame:
        return self._once("profile", lambda: profile.base_frequencies(self.contigs))

    @property
    def sites(self) -> DataFrame:
        return self._once("sites", lambda: sites.scan(self.contigs, self.params))

    @property
    def pieces(self) -> DataFrame:
        """sites without events, with what starts and stops of a piece gave instead."""
        return self._once("pieces", lambda: sites.scan_pairs(self.contigs, self.params))

    @property
    def orfs(self) -> DataFrame:
        return self._once("orfs", lambda: orfs.join_pieces(self.pieces, self.params))

    @property
    def weights(self) -> DataFrame:
        return self._once("weights", lambda: orfs.rbs_weights(self.orfs, profile.rbs_background(self.contigs, self.pieces), self.contigs))

    @property
    def training(self) -> DataFrame:
        return self._once("training", lambda: orfs.gc_training(self.orfs, self.pieces, self.contigs))

    @property
    def scored(self) -> DataFrame:
        # the score is worked out from its logarithm where it is read
        return self._once("scored", self._scored).withColumn("score", -F.exp("ln_score"))

    def _scored(self) -> DataFrame:
        # what moves the most comes first, beside as few tables as can be
        training = self.training
        made = orfs.score_orfs(self.orfs, self.weights, training, self.params).drop("n", "score")
        # the largest table by far; the three that are learnt from it are there
        if "pieces" in self._made:
            self._scratch.drop(self._made.pop("pieces"))
        return made

    @property
    def nodes(self) -> DataFrame:
        return self._once("nodes", lambda: graph.nodes(self.orfs, self.profile, self.trnas))

    @property
    def edges(self) -> DataFrame:
        return self._once("edges", self._edges)

    def _edges(self) -> DataFrame:
        return graph.build(self.scored, self.nodes, self.profile, orfs.longest(self.orfs), self.trnas, self.params)

    def passing_edges(self) -> DataFrame:
        """edges for what reads them once: they aren't written for it."""
        return self.edges if "edges" in self._made else self._edges()

    @property
    def calls(self) -> DataFrame:
        """contig_id, gene, strand, left, right (inclusive, whole codons), score (0 where the pair is no edge), ln_score (of an
        ORF's score's size)."""
        return self._once("calls", self._calls)

    def _calls(self) -> DataFrame:
        kind = self.contigs.schema["contig_id"].dataType.simpleString()
        # one of so many bases at most: all others are told by leaving these out
        long = F.broadcast(self.contigs.where(F.col("length") > self.block).select("contig_id"))
        some = lambda df, how: df.join(long, "contig_id", how)
        scored = self.scored
        of = lambda how: (some(self.nodes, how), some(scored, how), some(orfs.longest(self.orfs), how), some(self.profile, how))
        # edges are made where contigs are solved: they are neither moved nor written
        found = graph.edges_along(*of("left_anti"), self.params).mapInArrow(_solved, _CALLS.format(kind=kind) + ", score double, ln_score double")
        if not long.isEmpty():
            nodes, own, longest, about = of("left_semi")
            edges = some(self.edges, "left_semi") if "edges" in self._made else graph.build(own, nodes, about, longest, some(self.trnas, "left_semi") if self.trnas is not None else None, self.params)
            own = own.select("contig_id", "frame", F.least("start", "stop").alias("left"), F.greatest("start", "stop").alias("right"), "score", "ln_score")
            found = found.unionByName(paths.solve_blocks(edges, kind, self.block).join(own, ["contig_id", "frame", "left", "right"], "left"))
        score = F.coalesce("score", F.when(F.col("gene") == "tRNA", graph.TRNA_WEIGHT).otherwise(0.0))
        return found.select("contig_id", "number", "gene", F.when(F.col("frame") < 0, -1).otherwise(1).alias("strand"), "left", (F.col("right") + 2).alias("right"), score.alias("score"), "ln_score")
