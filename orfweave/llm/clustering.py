"""Operator 13, centroid clustering: Delta Lloyd over whole numbers.

The state of a vector, its owner and the distance from it, is kept in a table beside the vector, and the sums and counts of
all clusters by the driver (as many as there are centroids). A round broadcasts the centroids and which of them changed. A
vector whose owner stayed where it was is compared with changed centroids only; one whose owner moved, with all.
Vectors that change hands are all that the sums need: each is taken from its old cluster and added to its new one, a
signed sum of whole numbers, so that sums stay exact and late rounds move next to nothing. A round is one pass in which
rows don't move; each writes its table, so a lost executor repeats tasks of one round only.

Components become floor(SCALE * x). Vectors that are null, of other lengths, or that hold null or non-finite components take
no part. Components beyond 2**26 after scaling, whose distances a long might not hold, are refused with an error. Centroids
begin as the vectors with the smallest sha256 of `2:<id>`; rows with null ids come last, and repeated ids are told
apart by their components. Of fewer vectors than centroids each is a centroid; an empty table gives no rows.
Ties go to the smaller number, a centroid without vectors stays where it is. Rows that repeat are clustered each. Other
columns than the id and the vector aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

CENTROIDS, ROUNDS, SCALE, SIZE = 40, 5, 256, 64
#: Components up to here have exact distances as doubles, and up to here as longs.
_DOUBLE, _MOST = 1 << 22, 1 << 26
#: Vectors compared at once.
_BLOCK = 4096
_STATE = "id {kind}, x array<bigint>, cluster int, distance bigint, before int"


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact: by products of matrices, as doubles where those hold them."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= _DOUBLE:
        x, centroids = x.astype(np.float64), centroids.astype(np.float64)
    own, other = (x * x).sum(1), (centroids * centroids).sum(1)
    return (own[:, None] - 2 * (x @ centroids.T) + other).astype(np.int64)


def compare(x: np.ndarray, cluster: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """New owners and distances, and how many pairs were compared."""
    cluster, distance = cluster.copy(), distance.copy()
    moved = (cluster < 0) | changed[cluster]
    pairs = 0
    if moved.any():
        found = distances(x[moved], centroids)
        cluster[moved], distance[moved] = found.argmin(1), found.min(1)
        pairs += found.size
    rest, near = np.flatnonzero(~moved), np.flatnonzero(changed)
    if len(rest) and len(near):
        found = distances(x[rest], centroids[near])
        best, least = near[found.argmin(1)], found.min(1)
        wins = (least < distance[rest]) | ((least == distance[rest]) & (best < cluster[rest]))
        cluster[rest[wins]], distance[rest[wins]] = best[wins], least[wins]
        pairs += found.size
    return cluster, distance, pairs


def whole_vectors(vectors: DataFrame, id_column: str, vector_column: str, size: int, scale: int) -> DataFrame:
    """id, x: those that take part, as whole numbers."""
    v = F.col(vector_column)
    finite = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    scaled = F.transform(v, lambda e: scale * e.cast("double"))
    kept = vectors.select(F.col(id_column).alias("id"), F.when((F.size(v) == size) & finite, scaled).alias("x")).where("x IS NOT NULL")
    bound = F.assert_true(F.forall("x", lambda e: F.abs(e) < float(_MOST)), F.lit(f"components beyond {_MOST} can't be clustered"))
    return kept.select("id", F.transform("x", lambda e: F.floor(F.when(bound.isNull(), e))).alias("x"))


class DeltaLloyd:
    """Clusters of a table (id, x). Between rounds there are a table of states, and numbers for each centroid."""

    def __init__(self, vectors: DataFrame, centroids: int, size: int):
        self.spark, self.size = vectors.sparkSession, size
        self.scratch = Scratch(self.spark, "clusters")
        self.kind = vectors.schema["id"].dataType.simpleString()
        self.state = self.scratch.write(vectors.select("id", "x", F.lit(-1).alias("cluster"), F.lit(0).cast("bigint").alias("distance"), F.lit(-1).alias("before")), "vectors")
        order = F.sha2(F.concat(F.lit("2:"), F.col("id").cast("string")), 256)
        chosen = self.state.orderBy(order.asc_nulls_last(), "x").limit(centroids).select("x").collect()
        self.centroids = np.array([r["x"] for r in chosen], np.int64).reshape(len(chosen), size)
        self.changed = np.ones(len(chosen), bool)
        # exact, whatever their size
        self.sums = [[0] * size for _ in chosen]
        self.counts = [0] * len(chosen)

    def assign(self) -> None:
        """Each vector to its nearest centroid."""
        shared = self.spark.sparkContext.broadcast((self.centroids, self.changed))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, changed = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, _BLOCK):
                    some = batch.slice(at, _BLOCK)
                    x = some.column("x").flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1)
                    before = some.column("cluster").to_numpy(zero_copy_only=False)
                    cluster, distance, _ = compare(x, before, some.column("distance").to_numpy(zero_copy_only=False), centroids, changed)
                    yield pa.RecordBatch.from_arrays([some.column("id"), some.column("x"), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(before.astype(np.int32))], ["id", "x", "cluster", "distance", "before"])

        rows = self.state.select("id", "x", "cluster", "distance").mapInArrow(run, _STATE.format(kind=self.kind))
        before, self.state = self.state, self.scratch.write(rows, "states")
        self.scratch.drop(before)

    def update(self) -> None:
        """Moves the sums by what changed hands, then the centroids."""
        ends = F.array(F.struct(F.col("before").alias("k"), F.lit(-1).alias("sign")), F.struct(F.col("cluster").alias("k"), F.lit(1).alias("sign")))
        moved = self.state.where("before <> cluster").select(F.inline(ends), "x").where("k >= 0")
        # a row a centroid at most
        for r in moved.groupBy("k").agg(F.sum("sign").alias("n"), *(F.sum(F.col("sign") * F.col("x")[d]).alias(f"d{d}") for d in range(self.size))).collect():
            self.counts[r["k"]] += r["n"]
            self.sums[r["k"]] = [a + r[f"d{d}"] for d, a in enumerate(self.sums[r["k"]])]
        new = np.array([[s // n for s in own] if n else c for own, n, c in zip(self.sums, self.counts, self.centroids.tolist())], np.int64)
        self.changed = (new != self.centroids).any(axis=1)
        self.centroids = new


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, id_column: str = "vec_id", vector_column: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """The id, cluster, distance, cluster_inertia, inertia and centroid (its components) of each vector that takes part."""
    run = DeltaLloyd(whole_vectors(vectors, id_column, vector_column, size, scale), centroids, size)
    if len(run.centroids):
        for _ in range(rounds):
            run.assign()
            run.update()
        run.assign()
    # a row a centroid
    of = run.state.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    of = of.withColumn("inertia", F.sum("cluster_inertia").over(Window.partitionBy()))
    places = run.spark.createDataFrame([(k, c) for k, c in enumerate(run.centroids.tolist())], "cluster int, centroid array<bigint>")
    found = run.state.select("id", "cluster", "distance").join(F.broadcast(of), "cluster").join(F.broadcast(places), "cluster")
    return found.select(F.col("id").alias(id_column), "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: embeddings in 40 clusters after 5 rounds."""
    rows = cluster(table(spark, sf_dir, "embeddings"))
    return rows.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.transform("centroid", lambda c: c.cast("string")), ","), 256).alias("centroid_sha256"))


def _sql() -> str:
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"parts AS MATERIALIZED (SELECT vec_id, unnest(range({SIZE})) AS d, unnest(x) AS v FROM kept)",
        f"c0 AS MATERIALIZED (SELECT k, d, v FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k FROM kept) USING (vec_id) WHERE k < {CENTROIDS})",
    ]
    for i in range(ROUNDS + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT * FROM (SELECT vec_id, k, sum((p.v - c.v) * (p.v - c.v)) AS far FROM parts p JOIN c{i} c USING (d) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY far, k) = 1)")
        if i < ROUNDS:
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT k, d, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT k, d, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v FROM parts JOIN a{i} USING (vec_id) GROUP BY ALL) m USING (k, d))")
    return f"WITH {', '.join(parts)} SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(far AS BIGINT) AS distance, CAST(sum(far) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(far) OVER () AS BIGINT) AS inertia, sha AS centroid_sha256 FROM a{ROUNDS} JOIN (SELECT k, sha256(string_agg(v, ',' ORDER BY d)) AS sha FROM c{ROUNDS} GROUP BY k) USING (k)"


ORACLE_SQL = _sql()
