"""Operator 10, toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters and digits, lower-cased. A text's features are its words, the same cut to stems of
four to six letters (inflected forms are too rare each to be learnt), pairs of neighbouring words and pairs
with one or two words between, hashed to 2**BITS coordinates, each present or not. FTRL gives each
coordinate its own rate; its L1 term leaves most weights at zero, so the model is a short list of (coordinate,
weight) that every task gets by broadcast, bounded by 2**BITS.

The model is fitted in one task on at most MAX_ROWS labelled rows, the first by a hash of the id (a documented
bound); a lost executor repeats that task with the same rows in the same order and so with the same result. It
then scores every whole text. Without labelled rows all scores are 0. Null texts are empty: their score is the
intercept's. Of several labels of an id the highest holds, of several texts the one with the smallest hash; null
labels and ids are left out of the fit. Each row gives one row; columns other than the id and the text are no inputs
and pass through. A very long text is dealt with alone, in arrays of some 60 times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, release, small_batches, table, whole_text
from .vocabulary import chunks

BITS = 22
MAX_ROWS = 16_384
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 0.1
#: What a row of label 1 weighs beside one of label 0.
POSITIVE = 3.0
THRESHOLD = 0.5
FOLDS = 5
#: How many words apart the two words of a pair may be.
DISTANCES = (1, 2, 3)
#: Letters to which longer words are cut.
STEMS = (4, 5, 6)
_CODE_POINTS = 0x110000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Features:
    """Hashed features of many texts at once, found with array operations. The tables are the same in every process."""

    @classmethod
    def of(cls) -> Features:
        """The process's own tables."""
        return held("features", cls)

    def __init__(self):
        # lower case, one character for one; the rest of the characters stand for themselves
        self.value = np.zeros(_CODE_POINTS, np.uint64)
        random = np.random.default_rng(1_618_033).integers(1, 1 << 63, _CODE_POINTS, np.uint64)
        letters = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000 and chr(c).isalnum()]
        lower = np.array([ord(low) if len(low := chr(c).lower()) == 1 else c for c in letters])
        self.value[letters] = random[lower]
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        up, down = np.full(n, _ODD), np.full(n, _INVERSE)
        up[0] = down[0] = 1
        self._up, self._down = np.multiply.accumulate(up), np.multiply.accumulate(down)

    def __call__(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Arrays of (text, coordinate) that together hold each feature once or more."""
        # a character that is in no word keeps the texts apart
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        if n > len(self._up):
            self._grow(n)
        value = self.value[points]
        within = value != 0
        edge = np.flatnonzero(np.diff(within, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        running = np.append(np.uint64(0), np.cumsum(value * self._up[:n]))
        words = (running[ends] - running[starts]) * self._down[starts]
        begins = np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1))
        text = np.searchsorted(begins, starts, "right") - 1
        yield text, self._coordinate(words)
        # the word cut to a stem stands in for its inflected forms
        for k in STEMS:
            long = ends - starts > k
            at = starts[long]
            yield text[long], self._coordinate((running[at + k] - running[at]) * self._down[at] + np.uint64(k))
        for k, factor in zip(DISTANCES, (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63)):
            same = text[k:] == text[:-k]
            # unlike factors keep the order of the two words
            yield text[k:][same], self._coordinate((words[:-k] * np.uint64(factor) + words[k:] * _ODD)[same])

    @staticmethod
    def _coordinate(hashes: np.ndarray) -> np.ndarray:
        hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (hashes >> np.uint64(64 - BITS)).astype(np.uint32)


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over rows of (coordinates, label): the coordinates with a weight, their weights and the intercept. The
    intercept has no penalty."""
    z, squares = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    bias_z = bias_squares = bias = 0.0
    for _ in range(epochs):
        for coordinates, label in rows:
            own, total = z[coordinates], squares[coordinates]
            weights = _weights(own, total)
            p = _sigmoid(float(weights.sum()) + bias)
            gradient = (p - label) * (POSITIVE if label else 1.0)
            if not gradient:
                continue
            change = np.sqrt(total + gradient * gradient) - np.sqrt(total)
            z[coordinates] = own + gradient - change / ALPHA * weights
            squares[coordinates] = total + gradient * gradient
            bias_z += gradient - (np.sqrt(bias_squares + gradient * gradient) - np.sqrt(bias_squares)) / ALPHA * bias
            bias_squares += gradient * gradient
            bias = -bias_z / ((BETA + np.sqrt(bias_squares)) / ALPHA)
    kept = np.flatnonzero((z > L1) | (z < -L1))
    return kept, _weights(z[kept], squares[kept]), float(bias)


def _weights(z: np.ndarray, squares: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(squares)) / ALPHA + L2))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def held_out(id_column: str | Column) -> Column:
    """Every fifth row by checksum of its id; null ids are in no fold that is learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(True))


class Model:
    """The nonzero weights and the intercept; without an intercept all scores are 0."""

    def __init__(self, coordinates: np.ndarray, weights: np.ndarray, bias: float | None):
        self.coordinates, self.weights, self.bias = coordinates, weights, bias

    def __len__(self) -> int:
        return len(self.coordinates)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Model) and self.bias == other.bias and np.array_equal(self.coordinates, other.coordinates) and np.array_equal(self.weights, other.weights)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """Learns from the rows that aren't held out."""
    small_batches(docs.sparkSession)
    known = labels.where(~held_out(id_column) & F.col(label_column).isNotNull())
    known = known.groupBy(F.col(id_column).alias("key")).agg(F.max(label_column).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(max_rows)
    # chosen has max_rows rows at most
    rows = docs.select(F.col(id_column).alias("key"), whole_text(text_column).alias("text")).join(F.broadcast(chosen), "key")
    # an id has one row, however often it repeats: the task that learns has max_rows rows at most
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first")
    rows = rows.groupBy("key", "label").agg(one).select(F.xxhash64("key").alias("place"), F.col("first.text").alias("text"), "label")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = None
        for batch in batches:
            find = find or Features.of()
            for part, texts in chunks(batch.column(1)):
                pairs = [np.concatenate(x) for x in zip(*find(texts))]
                keys = np.unique(pairs[0].astype(np.uint64) << np.uint64(BITS) | pairs[1])
                cuts = np.searchsorted(keys >> np.uint64(BITS), np.arange(part.stop - part.start))
                coordinates = (keys & np.uint64((1 << BITS) - 1)).astype("<u4")
                found = [x.tobytes() for x in np.split(coordinates, cuts[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array(found, pa.binary()), batch.column(2)[part]], ["place", "found", "label"])
        release()

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            if b.num_rows:
                # views of the batch's own memory; nothing is copied
                found = b.column(1).cast(pa.binary())
                edges = np.frombuffer(found.buffers()[1], np.int32)[found.offset :]
                data = np.frombuffer(found.buffers()[2] or b"", np.uint8)
                rows += [(p, bytes(data[x : x + 64]), data[x:y].view("<u4"), label) for p, x, y, label in zip(b.column(0).to_pylist(), edges, edges[1:], b.column(2).to_pylist())]
        if not rows:
            return
        # rows of one place are told apart by what they hold
        rows.sort(key=lambda r: (r[0], r[1], len(r[2]), r[3]))
        kept, weights, bias = fit([(f, y) for _, _, f, y in rows])
        # coordinate -1 is the intercept
        yield pa.RecordBatch.from_arrays([pa.array(np.append(kept, -1)), pa.array(np.append(weights, bias))], ["coordinate", "weight"])
        rows.clear()
        release()

    found = rows.mapInArrow(features, "place bigint, found binary, label int")
    model = found.repartition(1).mapInArrow(learn, "coordinate bigint, weight double")
    learnt = model.toPandas()
    own = learnt["coordinate"] >= 0
    bias = learnt["weight"][~own]
    return Model(learnt["coordinate"][own].to_numpy(np.int32), learnt["weight"][own].to_numpy(np.float32), float(bias.iloc[0]) if len(bias) else None)


#: The column that score_column() adds.
SCORE = "orfweave_toxicity"


def score_column(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The documents with all their columns and a score from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.array(np.concatenate([np.zeros(0), *(scorer(texts) for _, texts in chunks(batch))]))
        del scorer
        release()

    return docs.withColumn(SCORE, score(whole_text(text_column)))


class Scorer:
    def __init__(self, model: Model):
        self.find = Features.of()
        self.weights, self.bias = np.zeros(1 << BITS, np.float32), model.bias
        self.weights[model.coordinates] = model.weights
        self.some = self.weights != 0

    def __call__(self, texts: list[str]) -> np.ndarray:
        if self.bias is None:
            return np.zeros(len(texts))
        # of the features only those with a weight count, once a text
        keys = [t[k].astype(np.uint64) << np.uint64(BITS) | c[k] for t, c in self.find(texts) for k in [np.flatnonzero(self.some[c])]]
        keys = np.unique(np.concatenate(keys))
        sums = np.bincount((keys >> np.uint64(BITS)).astype(np.int64), self.weights[keys & np.uint64((1 << BITS) - 1)], len(texts))
        return _sigmoid(sums + self.bias)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: a model learnt from labels, and its score of all documents."""
    docs = table(spark, sf_dir, "documents")
    scored = score_column(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), F.col(SCORE).alias("score"), (F.col(SCORE) >= THRESHOLD).cast("int").alias("predicted"))
