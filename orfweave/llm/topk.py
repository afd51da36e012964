"""Operator 7, exact top-k search by inner product with dual cover trees.

A bounded sample gives pivots, the top level of the search: every vector, query or not, belongs to the cell of its
nearest pivot. A cell of over BLOCK vectors is cut into shells by the distance from its pivot, and a shell that still
is too large into parts by hash. A shell's pivot c, radius r and greatest norm bound the score of a query q in it,

    q.x <= min(q.c + |q| r, |q| max |x|).

Each query first searches the shell of its highest bound, which gives it a kth score so far, and then all shells whose
bound reaches that; the others are pruned. Within a task both sides are cover trees: every point of a node lies within
its radius, children are centred further apart than half their parent's reach, and pairs of nodes are pruned by
the same kind of bound against the worst kth score of the node's queries. Scores are inner products of whole numbers
in double precision; where they could reach 2**53 the search is refused, so results are exact. Ties go to the smaller
id, and pairs that tie with the kth are not pruned.

Where neighbours are hardly nearer than anything else, as among random directions in 64 dimensions, no bound of this
kind prunes and the search compares (nearly) all pairs in blocks; README has figures.

Rows without an id and vectors that are null or hold null or non-finite components take no part; shorter vectors count as
filled up with zeros; rows that repeat an id are candidates and queries each, and a query's own row, not its id, is left
out; fewer candidates than k give fewer rows; an empty table gives none. Only the id and the vector are read, so
further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

K = 10
SCALE = 1024
#: Pivots at most, vectors of a block, queries of a slice, points of a leaf; a cell for so many vectors; shells of a cell.
PIVOTS, BLOCK, SLICE, LEAF = 128, 8192, 2048, 64
CELL, SHELLS = 2048, 16
SAMPLE = 4096
_ROW = "row bigint, id bigint, query boolean, vector array<bigint>"


class Tree:
    """A cover tree over the rows of an array, in flat lists: centre, radius, children, rows of a leaf."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.centre, self.radius, self.norm, self.children, self.rows = [], [], [], [], []
        if len(points):
            self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray) -> int:
        node = len(self.centre)
        points = self.points[rows]
        # the row nearest to the mean is the centre, so that a node's centre is one of its points
        centre = points[np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1))]
        reach = np.sqrt(((points - centre) ** 2).sum(axis=1))
        self.centre.append(centre)
        # rounding must not make a bound too low
        self.radius.append(float(reach.max()) * (1 + 1e-12))
        self.norm.append(float(np.sqrt(centre @ centre)))
        self.children.append([])
        self.rows.append(rows)
        if len(rows) > self.leaf and self.radius[node] > 0:
            parts = self._cover(points, self.radius[node] / 2)
            if len(parts) > 1:
                self.children[node] = [self._build(rows[p]) for p in parts]
        return node

    def _cover(self, points: np.ndarray, reach: float) -> list[np.ndarray]:
        """Places in parts, each within reach of its first one and those further apart than reach. In many dimensions few
        points are near one another; what would be a crowd of tiny parts is dealt to the nearest of the first centres."""
        most = max(2, len(points) // self.leaf)
        near = np.full(len(points), np.inf)
        owner = np.zeros(len(points), np.int64)
        next_, count = 0, 0
        while True:
            distance = np.sqrt(((points - points[next_]) ** 2).sum(axis=1))
            closer = distance < near
            owner[closer], near[closer] = count, distance[closer]
            count += 1
            next_ = int(np.argmax(near))
            if near[next_] <= reach or count >= most:
                break
        return [p for p in (np.flatnonzero(owner == c) for c in range(count)) if len(p)]


class Search:
    """The best k so far of some queries; candidates of several trees may be added one after another. rows tell a query
    from the other rows of its id."""

    def __init__(self, rows: np.ndarray, points: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.tree, self.own, self.k = Tree(points), rows, k
        self.scores = np.full((len(rows), k), -np.inf)
        self.found = np.full((len(rows), k), np.iinfo(np.int64).max)
        #: scores that k candidates elsewhere have reached already
        self.floor = np.full(len(rows), -np.inf) if floor is None else floor
        #: pairs whose scores were worked out
        self.compared = 0

    def add(self, rows: np.ndarray, ids: np.ndarray, points: np.ndarray) -> None:
        other = Tree(points)
        if not len(ids) or not len(self.own):
            return
        stack = [(self._bound(0, other, 0), 0, 0)]
        while stack:
            bound, q, x = stack.pop()
            if bound < self._worst(q):
                continue
            split_q, split_x = self.tree.children[q], other.children[x]
            if not split_q and not split_x:
                self._compare(self.tree.rows[q], other.rows[x], rows, ids, points)
                continue
            # the wider node is split, or the one that can be
            if split_x and (not split_q or other.radius[x] >= self.tree.radius[q]):
                pairs = [(q, c) for c in split_x]
            else:
                pairs = [(c, x) for c in split_q]
            # the most promising pair is taken first
            stack.extend(sorted((self._bound(a, other, b), a, b) for a, b in pairs))

    def _bound(self, q: int, other: Tree, x: int) -> float:
        own = self.tree
        value = float(own.centre[q] @ other.centre[x]) + own.norm[q] * other.radius[x] + other.norm[x] * own.radius[q] + own.radius[q] * other.radius[x]
        return value + 1e-9 * abs(value) + 1e-6

    def _worst(self, q: int) -> float:
        rows = self.tree.rows[q]
        return float(np.maximum(self.scores[rows, -1], self.floor[rows]).min())

    def _compare(self, queries: np.ndarray, places: np.ndarray, rows: np.ndarray, ids: np.ndarray, points: np.ndarray) -> None:
        scores = self.tree.points[queries] @ points[places].T
        self.compared += scores.size
        scores[self.own[queries][:, None] == rows[places][None, :]] = -np.inf
        least = np.maximum(self.scores[queries, -1], self.floor[queries])
        for i in np.flatnonzero(scores.max(axis=1) >= least).tolist():
            q = queries[i]
            new = np.flatnonzero((scores[i] >= least[i]) & (scores[i] > -np.inf))
            all_scores = np.concatenate((self.scores[q], scores[i, new]))
            all_ids = np.concatenate((self.found[q], ids[places[new]]))
            order = np.lexsort((all_ids, -all_scores))[: self.k]
            self.scores[q], self.found[q] = all_scores[order], all_ids[order]


def _rows(vectors: DataFrame, id_column: str, vector_column: str, every: int) -> DataFrame:
    v = F.transform(F.col(vector_column), lambda x: x.cast("double"))
    finite = F.col(vector_column).isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    whole = F.transform(v, lambda x: F.floor(x * SCALE))
    return vectors.where(finite & F.col(id_column).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(id_column) % every == 0, F.lit(False)).alias("query"), whole.alias("vector"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    lengths = np.diff(column.offsets.to_numpy())
    if len(lengths):
        out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def search(vectors: DataFrame, every: int = 100, k: int = K, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by every, the k best of the others."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = scratch.write(_rows(vectors, id_column, vector_column, every), "rows")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width"), F.max(square).alias("square")).first()
    if (size["square"] or 0.0) >= 1 << 53:
        raise ValueError("scores could reach 2**53 and would not be exact")
    width = size["width"] or 0
    sample = rows.orderBy(F.xxhash64("id", "vector")).limit(min(SAMPLE, PIVOTS * 16)).select("vector").toPandas()
    points = np.array([[*v, *[0] * (width - len(v))] for v in sample["vector"]], float).reshape(len(sample), width)
    pivots = points[_spread(points, int(np.clip(size["n"] // CELL, 1, PIVOTS)))] if len(points) else points
    placed = scratch.write(_placed(rows, pivots, width), "placed")
    blocks, shells = _blocks(placed, scratch)
    asking = placed.where("query").select("row", "vector", F.lit(float("-inf")).alias("floor"), F.array().cast("array<int>").alias("done"))
    first = scratch.write(_asked(asking, shells, pivots, width, True), "first")
    near = _searched(blocks, shells, first, width, k, scratch)
    kth = near.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth"))
    floor = F.when(F.col("n") >= k, F.col("kth").cast("double")).otherwise(F.lit(float("-inf")))
    asking = first.select("row", "vector", F.array("shell").alias("done")).join(kth.select("row", floor.alias("floor")), "row", "left").fillna(float("-inf"), ["floor"])
    far = _searched(blocks, shells, _asked(asking, shells, pivots, width, False), width, k, scratch)
    best = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
    ranked = near.union(far).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    queries = placed.where("query").select("row", F.col("id").alias("query_id"))
    return ranked.join(queries, "row").select("query_id", "rank", "vec_id", "score")


def _blocks(placed: DataFrame, scratch: Scratch) -> tuple[DataFrame, list]:
    """The vectors with the number of their shell and part; and of each shell its number, cell, reach (greatest distance
    from the pivot), norm (the greatest) and parts. There are PIVOTS * SHELLS shells at most."""
    shares = F.array(*(F.lit((j + 1) / SHELLS) for j in range(SHELLS - 1)))
    cuts = placed.groupBy("cell").agg(F.when(F.count(F.lit(1)) > BLOCK, F.percentile_approx("distance", shares)).otherwise(F.array().cast("array<double>")).alias("cuts"))
    # PIVOTS rows at most
    shelled = placed.join(F.broadcast(cuts), "cell").withColumn("shell", (F.col("cell") * SHELLS + F.size(F.filter("cuts", lambda c: c < F.col("distance")))).cast("int"))
    shelled = scratch.write(shelled.select("row", "id", "vector", "cell", "shell", "distance", "norm"), "shells")
    sums = shelled.groupBy("shell").agg(F.first("cell").alias("cell"), F.max("distance").alias("reach"), F.max("norm").alias("norm"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    return shelled, sums.orderBy("shell").collect()


def _asked(asking: DataFrame, shells: list, pivots: np.ndarray, width: int, first: bool) -> DataFrame:
    """row, vector, floor and shell: of each query the shell of its highest bound, or all but those done whose bound reaches
    its floor."""
    numbers = np.array([s["shell"] for s in shells], np.int32)
    centres = pivots[[s["cell"] for s in shells]] if shells else pivots
    reach, norms = (np.array([s[c] for s in shells]) for c in ("reach", "norm"))
    shared = asking.sparkSession.sparkContext.broadcast((numbers, centres, reach, norms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, centres, reach, norms = shared.value
        for batch in batches:
            points = _matrix(batch.column(1), width)
            own = np.sqrt((points**2).sum(axis=1))[:, None]
            bound = np.minimum(points @ centres.T + own * reach, own * norms)
            # rounding must not make a bound too low
            bound += 1e-9 * np.abs(bound) + 1e-6
            if first:
                chosen = [numbers[[j]] for j in bound.argmax(axis=1)]
            else:
                reached = bound >= batch.column(2).to_numpy()[:, None]
                chosen = [np.setdiff1d(numbers[r], done) for r, done in zip(reached, batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(chosen, pa.list_(pa.int32()))], ["row", "vector", "floor", "shells"])

    found = asking.select("row", "vector", "floor", "done").mapInArrow(run, "row bigint, vector array<bigint>, floor double, shells array<int>")
    return found.select("row", "vector", "floor", F.explode("shells").alias("shell"))


def _spread(points: np.ndarray, count: int) -> list[int]:
    """Places of points far from one another: each the furthest from those before."""
    chosen, near = [0], np.full(len(points), np.inf)
    while len(chosen) < min(count, len(points)):
        near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        if near.max() == 0:
            break
        chosen.append(int(np.argmax(near)))
    return chosen


def _placed(rows: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """With the nearest pivot's number, the distance to it and the norm. pivots: PIVOTS vectors at most."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            points = _matrix(batch.column(3), width)
            near = np.stack([((points - c) ** 2).sum(axis=1) for c in centres], axis=1)
            cell = near.argmin(axis=1)
            distance, norm = np.sqrt(near[np.arange(len(cell)), cell]), np.sqrt((points**2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(distance), pa.array(norm)], ["row", "id", "query", "vector", "cell", "distance", "norm"])

    return rows.mapInArrow(run, f"{_ROW}, cell int, distance double, norm double")


def _searched(blocks: DataFrame, shells: list, asked: DataFrame, width: int, k: int, scratch: Scratch) -> DataFrame:
    """row, vec_id and score: the k best of each query within the shells that it asks. A task has one part of a shell and one
    slice of the queries that ask it; queries go to the blocks, which are the larger side."""
    spark = blocks.sparkSession
    # PIVOTS * SHELLS rows at most
    parts = F.broadcast(spark.createDataFrame([(s["shell"], s["parts"]) for s in shells], "shell int, parts int"))
    sent = scratch.write(asked, "asked")
    slices = sent.groupBy("shell").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))
    slices = F.broadcast(scratch.write(slices, "slices"))
    keys = ["shell", "part", "slice"]
    left = sent.join(parts, "shell").join(slices, "shell").withColumn("slice", F.pmod(F.xxhash64("row"), F.col("slices")).cast("int"))
    left = left.select("row", "vector", "floor", "shell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "slice")
    right = blocks.join(parts, "shell").join(slices, "shell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    right = right.select("row", "id", "vector", "shell", "part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        left, right = left.combine_chunks(), right.combine_chunks()
        found = Search(left["row"].to_numpy(), _matrix(left["vector"].combine_chunks(), width), k, left["floor"].to_numpy())
        found.add(right["row"].to_numpy(), right["id"].to_numpy(), _matrix(right["vector"].combine_chunks(), width))
        q, place = np.nonzero(found.scores > -np.inf)
        return pa.table({"row": found.own[q], "vec_id": found.found[q, place], "score": found.scores[q, place].astype(np.int64)})

    both = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    return scratch.write(both.applyInArrow(run, "row bigint, vec_id bigint, score bigint"), "found")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the 10 best of every vector for those whose id is divisible by 100."""
    return search(table(spark, sf_dir, "embeddings")).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE_SQL = f"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(CAST(x AS DOUBLE)), false)))
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= {K}
"""
