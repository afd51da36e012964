"""Graphs as a pair of tables: nodes (node) and edges (src, dst, weight)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orfweave.sources import readers


def inverted(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")


def canonical(edges: DataFrame) -> DataFrame:
    """Ends in ascending order, as undirected edges have them."""
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")


def ordered(edges: DataFrame) -> DataFrame:
    return edges.orderBy("weight", "src", "dst")


@dataclass(frozen=True)
class Graph:
    """No loops and no parallel edges; an undirected graph holds each edge once, ends in ascending order."""

    nodes: DataFrame
    edges: DataFrame
    directed: bool = True

    @classmethod
    def of(cls, edges: DataFrame, directed: bool = True, nodes: DataFrame | None = None) -> Graph:
        edges = edges.select("src", "dst", "weight")
        if not directed:
            edges = canonical(edges)
        ends = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node")))
        return cls((ends if nodes is None else ends.union(nodes.select("node"))).distinct(), edges, directed)

    def validate(self) -> Graph:
        if not self.edges.where("src = dst").isEmpty():
            raise ValueError("loops are not allowed")
        if not self.edges.groupBy("src", "dst").count().where("count > 1").isEmpty():
            raise ValueError("parallel edges are not allowed")
        return self

    def v(self) -> int:
        return self.nodes.count()

    def e(self) -> int:
        return self.edges.count()

    def add_node(self, nodes: DataFrame) -> Graph:
        return Graph(self.nodes.union(nodes.select("node")).distinct(), self.edges, self.directed)

    def has_node(self, nodes: DataFrame) -> DataFrame:
        return nodes.join(self.nodes, "node", "left_semi")

    def del_node(self, nodes: DataFrame) -> Graph:
        """Takes the edges at the nodes away as well."""
        gone = nodes.select("node").distinct()
        kept = self.edges.join(gone, self.edges["src"] == gone["node"], "left_anti")
        kept = kept.join(gone, kept["dst"] == gone["node"], "left_anti")
        return Graph(self.nodes.join(gone, "node", "left_anti"), kept, self.directed)

    def add_edges(self, edges: DataFrame) -> Graph:
        return Graph.of(self.edges.unionByName(edges.select("src", "dst", "weight")), self.directed, self.nodes).validate()

    def _ends(self, edges: DataFrame) -> DataFrame:
        return (edges if self.directed else canonical(edges.select("src", "dst", F.lit(0.0).alias("weight")))).select("src", "dst")

    def del_edges(self, edges: DataFrame) -> Graph:
        return Graph(self.nodes, self.edges.join(self._ends(edges), ["src", "dst"], "left_anti"), self.directed)

    def has_edge(self, edges: DataFrame) -> DataFrame:
        """Those that the graph has, whatever their weight."""
        return self._ends(edges).join(self.edges, ["src", "dst"], "left_semi")

    def weights(self, edges: DataFrame) -> DataFrame:
        """With the graph's weight, 0 where it has no such edge."""
        found = self._ends(edges).join(self.edges, ["src", "dst"], "left")
        return found.select("src", "dst", F.coalesce("weight", F.lit(0.0)).alias("weight"))

    def out_edges(self) -> DataFrame:
        """From each end, for an undirected graph both ways."""
        return self.edges if self.directed else self.edges.unionByName(inverted(self.edges))

    def adjacent(self, node) -> DataFrame:
        return self.out_edges().where(F.col("src") == node).select(F.col("dst").alias("node"))

    def in_edges(self, node) -> DataFrame:
        return self.out_edges().where(F.col("dst") == node)

    def transpose(self) -> Graph:
        return Graph(self.nodes, inverted(self.edges), self.directed) if self.directed else self

    def _degrees(self, edges: DataFrame, end: str, name: str) -> DataFrame:
        counts = edges.groupBy(F.col(end).alias("node")).agg(F.count(F.lit(1)).alias(name))
        return self.nodes.join(counts, "node", "left").fillna(0, [name])

    def out_degree(self) -> DataFrame:
        return self._degrees(self.out_edges(), "src", "out_degree")

    def in_degree(self) -> DataFrame:
        return self._degrees(self.out_edges(), "dst", "in_degree")

    def degree(self) -> DataFrame:
        if self.directed:
            raise ValueError("only undirected graphs have degrees")
        return self._degrees(self.out_edges(), "src", "degree")

    def equals(self, other: Graph) -> bool:
        if self.directed != other.directed:
            return False
        same = lambda a, b: a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
        return same(self.nodes, other.nodes) and same(self.edges, other.edges)

    def difference(self, other: Graph) -> DataFrame:
        """side (left, right) and edges that only one of the graphs has, or has at another weight."""
        one = lambda a, b, side: a.edges.exceptAll(b.edges).select(F.lit(side).alias("side"), "src", "dst", "weight")
        return one(self, other, "left").unionByName(one(other, self, "right"))

    def union(self, other: Graph) -> Graph:
        if self.directed != other.directed:
            raise ValueError("a directed and an undirected graph can't be united")
        return self.add_node(other.nodes).add_edges(other.edges)

    def copy(self) -> Graph:
        return Graph(self.nodes, self.edges, self.directed)

    def _weight(self, sep: str = " ") -> Column:
        return F.when(F.col("weight") != 1, F.concat(F.lit(sep), F.col("weight").cast("string"))).otherwise("")

    def lines(self, name: str = "graph") -> DataFrame:
        """Headers, edges and nodes without edges; a weight of 1 isn't written. place orders the lines."""
        spark = self.edges.sparkSession
        head = spark.createDataFrame([(0, f"# NAME={name}"), (1, f"# DIRECTED={self.directed}")], "place int, line string")
        sizes = self.nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit(2).alias("place"), F.concat(F.lit("# V="), "n").alias("line")).union(self.edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit(3), F.concat(F.lit("# E="), "n")))
        body = self.edges.select(F.lit(4).alias("place"), F.concat(F.concat_ws(" ", "src", "dst"), self._weight()).alias("line"))
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("node"))
        alone = self.nodes.join(ends, "node", "left_anti").select(F.lit(5).alias("place"), F.col("node").cast("string").alias("line"))
        return head.union(sizes).union(body).union(alone)

    def save(self, path: str, name: str = "graph") -> None:
        """A text file that load() reads."""
        self.lines(name).coalesce(1).sortWithinPartitions("place", "line").select("line").write.text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        """Nodes are texts."""
        edges, directed = readers.graph(spark, path)
        return cls.of(edges, directed, readers.graph_nodes(spark, path))

    def lgl(self) -> DataFrame:
        if self.directed:
            raise ValueError("the format has no directed graphs")
        return self.edges.select(F.concat(F.concat_ws(" ", "src", "dst"), self._weight()).alias("line"))

    def ncol(self) -> DataFrame:
        """# node for each node, then its neighbours that come after it, if any; a node's lines are one row."""
        if self.directed:
            raise ValueError("the format has no directed graphs")
        near = F.sort_array(F.collect_list(F.concat(F.col("dst").cast("string"), self._weight())))
        found = self.edges.groupBy(F.col("src").alias("node")).agg(near.alias("near"))
        rows = self.nodes.join(found, "node", "left")
        return rows.select(F.array_join(F.concat(F.array(F.concat(F.lit("# "), F.col("node").cast("string"))), F.coalesce("near", F.array().cast("array<string>"))), "\n").alias("line"))

    def shown(self) -> DataFrame:
        near = F.sort_array(F.collect_list(F.concat(F.col("dst").cast("string"), F.lit("("), F.col("weight").cast("string"), F.lit(")"))))
        return self.out_edges().groupBy("src").agg(F.concat(F.col("src"), F.lit(": "), F.array_join(near, " ")).alias("line")).select("line")
