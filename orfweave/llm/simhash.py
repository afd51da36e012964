"""Operator 8, SimHash near-dedup by covering locality-sensitive hashing.

A text's fingerprint has 64 bits, each set if it is set in over half the hashes of the text's shingles of
words. Two texts are linked if their fingerprints differ in RADIUS bits or fewer. Every bit position has a
nonzero vector of RADIUS + 1 bits, dealt out evenly; table v keeps the positions whose vector has an odd product
with v. RADIUS differing positions span at most RADIUS dimensions, so some v is orthogonal to all of them: in
table v the two fingerprints agree. The 2**(RADIUS + 1) - 1 tables therefore miss no pair within the radius.

Only distinct fingerprints go into the tables. A task gets whole buckets in a row, compares all pairs of a
bucket as arrays and gives out a spanning forest of what it found linked, not the pairs. Buckets over LARGE
members are handed on in blocks, each pair of blocks a task of its own, so no task holds more than two blocks
and no pair is dropped. Components are found on the forest.

Null texts are empty and have fingerprint zero, linked like any other; each row gives one row (repeated rows
repeat it); an empty table gives none; columns other than the id and the text aren't read. Memory: a batch of
texts, hashes of SLICE shingles at a time, and a bucket or two blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, partitions, release, small_batches, table, whole_text
from .components import components
from .shingles import sets as shingle_sets
from .vocabulary import chunks

BITS = 64
RADIUS = 4
SHINGLE = 5
SEED = 42
SLICE = 1 << 16
LARGE = 4096
BLOCK_PAIRS = 1 << 20


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """The 64 bits as a signed number; 0 without words."""
    words = _words(text)
    counts, n = np.zeros(BITS, np.int64), 0
    for hashes in _shingle_hashes(words, width):
        counts += _set_bits(hashes)
        n += len(hashes)
    return _majority(counts, n)


def _words(text: str) -> list[bytes]:
    # bytes are lower-cased and split as ASCII
    return text.encode("utf-8", "surrogatepass").lower().split()


def _shingle_hashes(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Hashes of all shingles, repeats included, SLICE at a time; of the whole sequence if it is shorter."""
    from xxhash import xxh64_intdigest

    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n], ends[min(width, len(words)) - 1 :]
    for k in range(0, n, SLICE):
        yield np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[k : k + SLICE].tolist(), ends[k : k + SLICE].tolist())], np.uint64)


def _set_bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _majority(counts: np.ndarray, n: int) -> int:
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id column as id, and fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["id", "fp"])

    rows = docs.select(F.col(id_column).alias("id"), whole_text(text_column).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The masks of the covering tables, as signed numbers."""
    vectors = (1 << (radius + 1)) - 1
    own = [k % vectors + 1 for k in range(bits)]
    out = []
    for v in range(1, vectors + 1):
        mask = sum(1 << k for k in range(bits) if (own[k] & v).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _distances(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Differing bits of all pairs, some rows of left at a time: about BLOCK_PAIRS pairs are in memory, however many there
    are."""
    step = max(1, BLOCK_PAIRS // max(1, len(right)))
    for k in range(0, len(left), step):
        yield slice(k, k + step), np.bitwise_count(left[k : k + step, None] ^ right[None, :])


def forest(values: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Values with the first one of their component, where that is another one; links go from places left to places right."""
    label, none = np.arange(len(values)), len(values)
    while True:
        new = label.copy()
        for rows, far in _distances(values[left], values[right]):
            near, own = far <= radius, left[rows]
            new[own] = np.minimum(new[own], np.where(near, label[right][None, :], none).min(axis=1, initial=none))
            new[right] = np.minimum(new[right], np.where(near, label[own][:, None], none).min(axis=0, initial=none))
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def _pairs(runs: list[np.ndarray], radius: int, choose) -> tuple[np.ndarray, np.ndarray]:
    """What choose takes of the links in whole buckets."""
    found = [(np.zeros(0, np.uint64),) * 2]
    twos = [r for r in runs if len(r) == 2]
    if twos:
        both = np.stack(twos)
        near = np.bitwise_count(both[:, 0] ^ both[:, 1]) <= radius
        found.append((both[near, 1], both[near, 0]))
    for run in runs:
        if len(run) > 2:
            places = np.arange(len(run))
            found.append(choose(run, places, places, radius))
    return tuple(np.concatenate(x) for x in zip(*found))


def _batch(a: np.ndarray, b: np.ndarray, block: np.ndarray | None = None) -> pa.RecordBatch:
    block = pa.nulls(len(a), pa.int32()) if block is None else pa.array(block, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), block], ["a", "b", "block"])


def _bucket_links(radius: int, large: int, choose=forest):
    """A function over rows (bucket, fp) that lie sorted by bucket: rows (a, b, block), which are links where block is
    null, and else members a of bucket b that wait for the comparison of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = fps = np.zeros(0, np.uint64)
        given = 0  # blocks of the first bucket that were handed on already
        for batch in chain(batches, [None]):
            if batch is not None:
                new_keys, new_fps = (batch.column(k).to_numpy().view(np.uint64) for k in (0, 1))
                keys, fps = np.concatenate((keys, new_keys)), np.concatenate((fps, new_fps))
            if not len(keys):
                continue
            edges = np.flatnonzero(np.diff(keys)) + 1
            # the last bucket may go on in the next batch
            ended = len(keys) if batch is None else (edges[-1] if len(edges) else 0)
            edges = np.unique(np.concatenate(([0], edges[edges < ended], [ended])))
            runs = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()) if given else _several(edges):
                before, given = given, 0
                if before or b - a > large:
                    yield _batch(fps[a:b], keys[a:b], before + np.arange(b - a) // large)
                elif b - a > 1:
                    runs.append(fps[a:b])
            if runs:
                yield _batch(*_pairs(runs, radius, choose))
            keys, fps = keys[ended:], fps[ended:]
            if len(keys) > 2 * large:
                full = len(keys) - len(keys) % large
                yield _batch(fps[:full], keys[:full], given + np.arange(full) // large)
                given += full // large
                keys, fps = keys[full:], fps[full:]

    return run


def _several(edges: np.ndarray) -> list[tuple[int, int]]:
    """The runs of more than one row."""
    k = np.flatnonzero(np.diff(edges) > 1)
    return list(zip(edges[k].tolist(), edges[k + 1].tolist()))


def _between_blocks(waiting: DataFrame, radius: int, choose=forest) -> DataFrame:
    """Links within buckets that were too large for one task: every pair of blocks of a bucket is compared in a task."""
    blocks = waiting.groupBy("b").agg((F.max("block") + 1).alias("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = waiting.join(blocks, "b").select("a", "b", "block", other)
    rows = rows.select("a", "b", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compare(pdf):
        import pandas as pd

        values = pdf["a"].to_numpy().view(np.uint64)
        left, right = np.flatnonzero(pdf["block"] == pdf["i"]), np.flatnonzero(pdf["block"] == pdf["j"])
        a, b = choose(values, left, right, radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return rows.groupBy("b", "i", "j").applyInPandas(compare, "a bigint, b bigint")


def near_groups(prints: DataFrame, scratch: Scratch, radius: int = RADIUS, large: int = LARGE) -> DataFrame:
    """id and fp to fp and component_id, the smallest id among all rows whose fingerprints hang together."""
    spark = prints.sparkSession
    distinct = scratch.write(prints.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    tables = F.explode(F.array(*(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(masks(radius)))))
    rows = distinct.select(tables.alias("bucket"), "fp").repartition(4 * partitions(spark), "bucket").sortWithinPartitions("bucket")
    found = scratch.write(rows.mapInArrow(_bucket_links(radius, large), "a bigint, b bigint, block int"), "links")
    links, waiting = found.where("block IS NULL").select("a", "b"), found.where("block IS NOT NULL")
    if waiting.limit(1).count():
        links = links.union(_between_blocks(waiting, radius))
    labels = components(links, scratch)
    scratch.drop(found)
    named = scratch.write(distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("label", "fp").alias("label")), "named")
    names = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return scratch.write(named.join(names, "label").select("fp", "component_id"), "groups")


def link_documents(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id, fingerprint (16 hex digits) and component_id."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.write(fingerprints(docs, width, id_column, text_column), "fingerprints")
    groups = near_groups(prints, scratch, radius)
    return prints.join(groups, "fp").select(F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Near copies: from which Jaccard similarity of the sets of shingles texts are copies; how many texts are looked at for
#: common shingles and how many of those are put last (both change how much is compared, never the result).
SIMILARITY = 0.8
SAMPLE = 16_384
COMMON = 50_000
#: Rounds in which each node is compared with some leaders, before all pairs that are left are; leaders of a shingle;
#: how many of them a node is compared with.
LEADING = 3
LEADERS = 8
NEAREST = 4
PARITY_WORDS = 8
#: Rows of up to 40 bytes that are broadcast at once at most, and how many times so many one join takes.
FEW = 1 << 18
BANDS = 8
_SLACK = 1e-9


def _node(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.array([xxh64_intdigest(hashes.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def _parities(hashes: np.ndarray, most: int | None = PARITY_WORDS) -> np.ndarray:
    """A set's parities: bit h mod 64w is set if an odd number of shingles h fall on it, w words being a power of two that
    gives two bits a shingle, most at most. The parities of two sets differ in no more bits than the sets in
    shingles, and those of w words folded in the middle by exclusive or are those of w / 2."""
    words = 1 << max(0, (len(hashes) - 1) // 32).bit_length()
    words = words if most is None else min(most, words)
    odd = np.bincount((hashes & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _apart(x: Column, y: Column) -> Column:
    """Differing bits of two sets' parities, the longer one folded; sizes further apart than twice count as 0."""
    fold = lambda v: F.zip_with(F.slice(v, F.lit(1), (F.size(v) / 2).cast("int")), F.slice(v, (F.size(v) / 2).cast("int") + 1, (F.size(v) / 2).cast("int")), lambda a, b: a.bitwiseXOR(b))
    differ = lambda v, w: F.aggregate(F.zip_with(v, w, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, b: t + b)
    same, longer = F.size(x) == F.size(y), F.size(x) == 2 * F.size(y)
    return F.when(same, differ(x, y)).when(longer, differ(fold(x), y)).when(F.size(y) == 2 * F.size(x), differ(x, fold(y))).otherwise(0)


class _Order:
    """The order of shingles that all texts share: those that aren't common by hash, then the common ones, the most frequent
    last. common: shingles, the most frequent last."""

    def __init__(self, common: np.ndarray):
        by_hash = np.argsort(common)
        self.hashes, self.ranks = common[by_hash], by_hash

    def prefix(self, hashes: np.ndarray, similarity: float) -> np.ndarray:
        """The first shingles of a sorted set. Two sets of the similarity or more have one of their prefixes' shingles in
        common."""
        n = len(hashes)
        if not n:
            return hashes
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[at] == hashes
            hashes = np.concatenate((hashes[~known], hashes[known][np.argsort(self.ranks[at[known]])]))
        return hashes[: n - math.ceil(similarity * n - _SLACK) + 1]


def _common_shingles(rows: DataFrame, width: int, scratch: Scratch) -> np.ndarray:
    """Shingles of several texts of a sample of bounded size, the most frequent last."""
    total = max(1, rows.count())
    share = F.lit(min(1 << 20, math.ceil((1 << 20) * SAMPLE / total)))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in chunks(batch.column(0)):
                found = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(texts, width)])
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["shingle"])
        release()

    sample = rows.where(F.pmod(F.xxhash64("text", F.lit(SEED)), F.lit(1 << 20)) < share).select("text")
    often = sample.mapInArrow(shingles, "shingle bigint").groupBy("shingle").count().where("count > 2")
    frequent = F.desc("count"), F.col("shingle")
    top = scratch.write(often.orderBy(*frequent).limit(COMMON), "common").orderBy(*frequent).toPandas()["shingle"]
    return top.to_numpy(np.int64)[::-1].copy().view(np.uint64)


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Groups of near copies, per row: id, key (of the text), node (of its set of shingles) and group_id, group_key of the row
    that stands for the group, the one with the smallest id.

    Texts are linked if the Jaccard similarity of their sets of distinct shingles (as hashes of 64 bits) is high
    enough, worked out from the whole sets; equal sets are one node. What is compared comes in rounds, each over
    pairs that the rounds before haven't brought together: pairs of the covering tables over the sets'
    fingerprints; LEADING rounds of each node with the nearest ones among the leaders of its prefix's
    shingles, first the most central nodes and then some by hash, so that a large group hangs together after a few
    comparisons a node; and last
    every pair that shares a shingle of both prefixes (see _Order.prefix) and whose sizes, places of that
    shingle and parities (see _parities) allow the similarity. Any two similar sets share such a shingle, so after the last round no link
    between groups is missing, however large a bucket is.

    Null texts are empty; texts without words are one node. Null ids come last. An empty table gives no rows. A very
    long text is one array of its shingles, 8 bytes a word.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "near")
    rows = docs.select(F.col(id_column).alias("id"), whole_text(text_column).alias("text"))
    common = _common_shingles(rows, width, scratch)

    shared_order = spark.sparkContext.broadcast(_Order(common))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared_order.value
        for batch in batches:
            for part, texts in chunks(batch.column(2)):
                sets = shingle_sets(texts, width)
                found = {
                    "id": batch.column(0)[part],
                    "key": batch.column(1)[part],
                    "node": pa.array([_node(s) for s in sets], pa.int64()),
                    "fp": pa.array([_majority(_set_bits(s), len(s)) if len(s) else 0 for s in sets], pa.int64()),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "parities": pa.array([_parities(s) for s in sets], pa.list_(pa.int64())),
                    "wide": pa.array([_parities(s, None) for s in sets], pa.list_(pa.int64())),
                    "prefix": pa.array([order.prefix(s, similarity).view(np.int64) for s in sets], pa.list_(pa.int64())),
                }
                yield pa.RecordBatch.from_arrays(list(found.values()), list(found))
        release()

    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.select("id", F.xxhash64("text").alias("key"), "text")
    own = scratch.write(rows.mapInArrow(prints, f"id {kind}, key bigint, node bigint, fp bigint, n bigint, parities array<bigint>, wide array<bigint>, prefix array<bigint>"), "prints")
    # any row of a node has its set
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "fp", "n")).alias("first")
    nodes = own.groupBy("node").agg(first, F.min("parities").alias("parities"))
    nodes = scratch.write(nodes.select("node", "first.none", "first.id", "first.key", "first.fp", "first.n", "parities"), "nodes")
    met = _met(own, nodes, scratch)
    covering = _covering_pairs(nodes, scratch)

    links = _similar(rows, own, nodes, covering, scratch, similarity, width)
    labels = components(links, scratch)
    for turn in range(LEADING):
        rank = F.xxhash64("node", "shingle", F.lit(turn)).cast("double") if turn else F.col("central")
        found = _similar(rows, own, nodes, _leading_pairs(met, labels, rank, scratch, similarity), scratch, similarity, width)
        links = links.union(found)
        labels = components(links, scratch)
    found = _similar(rows, own, nodes, _other_pairs(met, labels, scratch, similarity), scratch, similarity, width)
    labels = components(links.union(found), scratch)
    scratch.drop(met)

    named = scratch.write(nodes.join(labels.withColumnRenamed("node", "own"), F.col("node") == F.col("own"), "left").select("node", "none", "id", "key", F.coalesce("label", "node").alias("label")), "named")
    least = named.groupBy("label").agg(F.min(F.struct("none", "id", "key")).alias("first"))
    groups = scratch.write(named.join(least, "label").select("node", F.col("first.id").alias("group_id"), F.col("first.key").alias("group_key")), "groups")
    return own.select("id", "key", "node").join(groups, "node")


def _covering_pairs(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """A forest over the sets' fingerprints, each with the smallest one that a covering table links it to at RADIUS, and nodes
    of one fingerprint with the first of them. A link that fails is made good by the rounds that follow."""
    prints = nodes.where("n > 0").groupBy("fp").agg(F.min("node").alias("first"))
    prints = scratch.write(prints, "fingerprints")
    tables = F.explode(F.array(*(F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(m))) for k, m in enumerate(masks()))))
    buckets = prints.select(tables.alias("bucket"), "fp").repartition(4 * partitions(nodes.sparkSession), "bucket").sortWithinPartitions("bucket")
    found = scratch.write(buckets.mapInArrow(_bucket_links(RADIUS, LARGE), "a bigint, b bigint, block int"), "covering")
    pairs, waiting = found.where("block IS NULL").select("a", "b"), found.where("block IS NOT NULL")
    if waiting.limit(1).count():
        pairs = pairs.union(_between_blocks(waiting, RADIUS))
    # the forest within a bucket leads to its first member; over the tables the smallest of those is taken
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).groupBy("a").agg(F.min("b").alias("b"))
    left, right = (prints.select(F.col("fp").alias(k), F.col("first").alias(f"first_{k}")) for k in "ab")
    between = pairs.join(left, "a").join(right, "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    within = nodes.where("n > 0").join(prints, "fp").select(F.col("node").alias("a"), F.col("first").alias("b")).where("a <> b")
    return scratch.write(between.union(within), "pairs")


def _able(similarity: float) -> Column:
    """Whether the sizes n, m of two sets, the places of a shingle, if it is the first that they share, and their parities
    allow the similarity."""
    n, m = F.col("n"), F.col("m")
    most = F.lit(1) + F.least(n - F.col("place") - 1, m - F.col("spot") - 1)
    sized = F.least(n, m) >= similarity * F.greatest(n, m) - _SLACK
    placed = most >= similarity / (1 + similarity) * (n + m) - _SLACK
    return sized & placed & (_apart(F.col("parities"), F.col("other")) <= _most_apart(n, m, similarity))


def _most_apart(n: Column, m: Column, similarity: float) -> Column:
    """In how many shingles sets of n and m that are similar differ at most."""
    return (1 - similarity) / (1 + similarity) * (n + m) + _SLACK


def _met(own: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Of each node that shares a shingle of its prefix with another: node, n, parities, places (shingle and place of those),
    and central: how many nodes have them, on average. In a group of near copies that is highest for what was copied,
    which is nearer to the copies than they are to one another."""
    # both uses take the nodes that are no null, so that prefixes are moved once
    prefixes = own.where("node IS NOT NULL").groupBy("node").agg(F.min("prefix").alias("prefix")).select("node", F.posexplode("prefix").alias("place", "shingle"))
    # a node has each of its shingles once
    shared = prefixes.groupBy("shingle").agg(F.count(F.lit(1)).alias("spread")).where("spread > 1")
    met = prefixes.join(shared, "shingle")
    # a node's list is no longer than its prefix
    met = met.groupBy("node").agg(F.collect_list(F.struct("shingle", "place")).alias("places"), F.avg("spread").alias("central"))
    return scratch.write(met.join(nodes.select("node", "n", "parities"), "node"), "met")


_SIDE = ("label", "node", "n", "place", "parities")
_OTHER = ("label_b", "b", "m", "spot", "other")


def _labelled(met: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each shingle of a node, with the node's label."""
    found = []
    for k, band in enumerate(_bands(labels, "node")):
        met = met.join(band.select(F.col("node").alias(f"own_{k}"), F.col("label").alias(f"label_{k}")), F.col("node") == F.col(f"own_{k}"), "left")
        found.append(F.col(f"label_{k}"))
    return met.select(F.coalesce(*found, "node").alias("label"), "node", "n", "parities", "central", F.inline("places"))


def _leading_pairs(met: DataFrame, labels: DataFrame, rank: Column, scratch: Scratch, similarity: float) -> DataFrame:
    """Each node with some of other components: of the leaders of its shingles the NEAREST ones by their parities. A
    shingle's nodes are dealt into LEADERS by hash, and the one of the highest rank leads each."""
    rows = _labelled(met, labels)
    dealt = F.pmod(F.xxhash64("shingle", "node", F.lit(SEED)), F.lit(LEADERS))
    # side by side in a row, so that they lie where the join looks for them
    firsts = [F.max(F.when(dealt == k, F.struct(rank.alias("rank"), *_SIDE))).alias(f"first_{k}") for k in range(LEADERS)]
    lead = rows.groupBy("shingle").agg(*firsts).select("shingle", F.inline(F.array_compact(F.array(*(f"first_{k}" for k in range(LEADERS))))))
    lead = lead.select("shingle", *(F.col(c).alias(name) for c, name in zip(_SIDE, _OTHER)))
    both = rows.join(lead, "shingle").where((F.col("label") != F.col("label_b")) & _able(similarity))
    # a node has at most LEADERS times its prefix's length of them
    one = F.struct(_apart(F.col("parities"), F.col("other")).alias("apart"), "b")
    nearest = both.groupBy("node").agg(F.slice(F.array_sort(F.collect_set(one)), 1, NEAREST).alias("nearest"))
    pairs = nearest.select(F.col("node").alias("a"), F.explode("nearest.b").alias("b"))
    return scratch.write(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")


def _other_pairs(met: DataFrame, labels: DataFrame, scratch: Scratch, similarity: float) -> DataFrame:
    """All pairs of different components that share a shingle and may be similar. Of a shingle, rows outside its first
    component meet all others, so its own rows, which may be many, aren't compared with each other."""
    rows = _labelled(met, labels).drop("central")
    # the component with the most rows of a shingle that has several
    sizes = rows.groupBy("shingle", "label").count().groupBy("shingle").agg(F.max(F.struct("count", "label")).alias("most"), F.count(F.lit(1)).alias("several"))
    sides = scratch.write(rows.join(sizes.where("several > 1").select("shingle", F.col("most.label").alias("main")), "shingle"), "sides")
    outside = sides.where("label <> main").select("shingle", *(F.col(c).alias(name) for c, name in zip(_SIDE, _OTHER)))
    apart = (F.col("label") != F.col("label_b")) & ((F.col("label") == F.col("main")) | (F.col("node") < F.col("b")))
    both = sides.join(outside, "shingle").where(apart & _able(similarity))
    pairs = scratch.write(both.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct(), "pairs")
    scratch.drop(sides)
    return pairs


def _bands(df: DataFrame, *key: str, most: int = BANDS) -> list[DataFrame]:
    """A written table of narrow rows in parts of about FEW, dealt by hash of key, each to be broadcast, so that what it is
    joined with needn't move; more than most of them are one part, which isn't broadcast."""
    n = max(1, -(-df.count() // FEW))
    if n > most:
        return [df]
    dealt = F.pmod(F.xxhash64(F.lit(SEED), *key), F.lit(n))
    return [F.broadcast(df if n == 1 else df.where(dealt == k)) for k in range(n)]


def _turns(pairs: DataFrame) -> list[DataFrame]:
    """Written pairs in parts whose ends are about FEW at most."""
    n = max(1, -(-2 * pairs.count() // FEW))
    return [pairs if n == 1 else pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(n)) == k) for k in range(n)]


def _similar(rows: DataFrame, own: DataFrame, nodes: DataFrame, pairs: DataFrame, scratch: Scratch, similarity: float, width: int) -> DataFrame:
    """The pairs of nodes whose sets are similar enough, from the whole sets. Pairs that the parities of two bits a shingle
    rule out have no sets made. Texts aren't moved, and a set only to its pairs: some FEW nodes are asked for at once, in a
    pass over the texts each."""
    sizes = nodes.select("node", "n")
    pairs = pairs.join(sizes.withColumnsRenamed({"node": "a", "n": "n_a"}), "a").join(sizes.withColumnsRenamed({"node": "b", "n": "n_b"}), "b")
    pairs = scratch.write(pairs.where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - _SLACK), "sized")
    close = []
    for some in _turns(pairs):
        needed = some.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wide = own.join(F.broadcast(needed), "node", "left_semi").select("node", "wide").dropDuplicates(["node"])
        left, right = (wide.select(F.col("node").alias(k), F.col("wide").alias(f"wide_{k}")) for k in "ab")
        near = some.join(left, "a").join(right, "b").where(_apart(F.col("wide_a"), F.col("wide_b")) <= _most_apart(F.col("n_a"), F.col("n_b"), similarity))
        close.append(scratch.write(near.select("a", "b", "n_a", "n_b"), "close"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own in chunks(batch.column(1)):
                found = [s.view(np.int64) for s in shingle_sets(own, width)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array(found, pa.list_(pa.int64()))], ["pairs", "hashes"])
        release()

    one = "STRUCT<a: BIGINT, b: BIGINT, n_a: BIGINT, n_b: BIGINT, first: BOOLEAN>"
    links = []
    for some in _turns(reduce(DataFrame.union, close)):
        end = lambda node, first: F.struct(F.col(node).alias("node"), F.struct("a", "b", "n_a", "n_b", F.lit(first).alias("first")).alias("pair"))
        ends = some.select(F.inline(F.array(end("a", True), end("b", False)))).groupBy("node").agg(F.collect_list("pair").alias("pairs"))
        needed = ends.join(nodes.select("node", F.col("id").alias("own"), F.col("key").alias("own_key")), "node")
        # rows that repeat both give the same text
        texts = rows.join(F.broadcast(needed), F.col("id").eqNullSafe(F.col("own")) & (F.col("key") == F.col("own_key"))).select("pairs", "text")
        whole = texts.mapInArrow(sets, f"pairs ARRAY<{one}>, hashes ARRAY<BIGINT>").select(F.explode("pairs").alias("pair"), "hashes")
        whole = whole.select("pair.*", "hashes").repartition(partitions(rows.sparkSession), "a", "b")
        both = whole.groupBy("a", "b", "n_a", "n_b").agg(*(F.first(F.when(F.col("first") == own_, F.col("hashes")), True).alias(name) for own_, name in ((True, "set_a"), (False, "set_b"))))
        both = both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("set_a", "set_b")).alias("shared"))
        links.append(scratch.write(both.where(F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")) >= similarity).select("a", "b"), "similar"))
    return reduce(DataFrame.union, links)


def kept_documents(docs: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each group of near copies, with all columns: the one with the smallest id (null ids last). Rows that
    repeat both the id and the text are one document, and stay or go together."""
    groups = near_copies(docs, similarity, width, id_column, text_column)
    stands = F.col("id").eqNullSafe(F.col("group_id")) & (F.col("key") == F.col("group_key"))
    own, gone_id, gone_key = fresh(docs, "key", "gone_id", "gone_key")
    gone = groups.where(~stands).select(F.col("id").alias(gone_id), F.col("key").alias(gone_key)).distinct()
    kept = docs.withColumn(own, F.xxhash64(whole_text(text_column)))
    for some in _bands(Scratch(docs.sparkSession, "gone").write(gone, "gone"), gone_id, gone_key):
        kept = kept.join(some, F.col(id_column).eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_key)), "left_anti")
    return kept.drop(own)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: documents linked at 4 or fewer differing bits, over shingles of 4 words."""
    return link_documents(table(spark, sf_dir, "documents"), width=4, radius=4)
