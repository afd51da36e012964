"""Operator 12, language-model scoring with a log-frequency Bloom filter of n-gram counts.

Counts are summed up in tasks, dealt out by slices of the n-grams' hashes and summed up again, so a slice is as even as
hashes are, whatever the texts. A count c becomes the level q = 1 + floor(log(c) / log(BASE)), and the n-gram is put into
its slice of the filter q times, with the levels 1 to q. To read a count, levels are probed one after another until one
isn't there: a count is never read too low, and too high by a level with the chance of a false hit. An n-gram never
counts more than its parts do. Probabilities follow from such counts, order by order, with a Dirichlet prior:

    p(w) = (c(w) + 1/2) / (N + (V + 1) / 2),    p(w | h) = (c(h w) + PRIOR p(w | h')) / (c(h) + PRIOR).

A text is its words and an end; what stands before its first word is an end, too.

The filter has BITS bits for each entry, so it grows with the corpus. Up to MAX_BYTES it is broadcast whole. A larger one is
cut into bands of whole slices up to that size: each pass over the texts has one band in memory and adds the levels
that it finds, a byte a token and order, and the last pass scores. The results are the same, for one more pass a band.

base_score and n_known are exact. The counts of at most HOT words, those from some count on, are broadcast as
sorted hashes; all other words of a text are joined with the table of counts by a shuffle, once a text and word.

Words are told apart by 64-bit hashes (see shingles). Null texts are empty: one token, the end. Null ids belong to the
rows that are learnt from. Repeated rows count and are scored each. Very long texts are read whole; a chunk of CHUNK bytes
of texts, or one longer text, is worked on at once. Nothing to learn from gives N = V = 0. An empty table gives no
rows. Columns other than the id and the text aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, forget, held, partitions, release, small_batches, table, whole_text
from .shingles import _mixed, _words
from .vocabulary import chunks

ORDER, BASE, BITS, HASHES, PRIOR = 2, 1.5, 10, 5, 400.0
#: Words whose counts are broadcast at most; bytes of a band of the filter at most; slices at most, and for each partition.
HOT, MAX_BYTES, SLICES, FINE = 1 << 17, 128 << 20, 1 << 16, 4
#: Bytes of the filter that the driver has at hand at once; a slice isn't cut.
PART = 16 << 20
#: Bytes of texts worked on at once, and tokens that a task sums up at once.
CHUNK, FLUSH = 1 << 20, 1 << 22
#: The hash that stands for an end.
END = np.uint64(0xA0761D6478BD642F)
_ODD, _STEP, _PROBE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


def levels(base: float) -> np.ndarray:
    """The least count of each level, from 1."""
    return np.unique(np.ceil(base ** np.arange(0, int(62 * math.log(2) / math.log(base))) - 1e-9).astype(np.int64))


def typical(base: float) -> np.ndarray:
    """What a count of each level is taken for: 0, then the mean of the level's ends, in proportion."""
    low = levels(base)
    high = np.append(low[1:] - 1, low[-1] * base)
    return np.append(0.0, np.sqrt(low * high))


class Texts:
    """The tokens of a chunk of texts, an end before each text's first and after each text's last."""

    def __init__(self, texts: list[str], order: int):
        words, owner = _words(texts)
        counts = np.bincount(owner, minlength=len(texts)).astype(np.int64)
        #: tokens of each text, its end counted
        self.counts = counts + 1
        # the first end of all, then each text with its end
        self.tokens = np.append(END, np.insert(words, np.cumsum(counts), END))
        self.owner = np.repeat(np.arange(len(texts)), self.counts)
        place = np.arange(len(self.owner)) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        #: of each order, the hashes of n-grams that end at a token, and whether the n-gram lies within its text
        self.keys, self.inside = [self.tokens], [np.ones(len(self.tokens), bool)]
        for m in range(2, order + 1):
            before = np.append(np.uint64(0), self.keys[-1][:-1])
            self.keys.append(_mixed(before * _ODD + self.tokens + np.uint64(m)))
            self.inside.append(np.append(False, place >= m - 2))


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their sums. Keys without counts are sorted where they are."""
    if counts is None:
        keys.sort()
    else:
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    sums = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first) if len(first) else counts
    return keys[first], sums.astype(np.int64)


def _slice(keys: np.ndarray, slices: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


_COUNTS = "slice int, words binary, word_counts binary, grams binary, gram_counts binary"


def _count(slices: int, order: int):
    """Texts to counts, by slices, summed up as far as a task can."""

    def rows(keys: list[list[np.ndarray]]) -> pa.RecordBatch:
        parts = []
        for own in keys:
            joined = np.concatenate(own)
            # no key is kept twice while the others are summed up
            own.clear()
            key, n = _summed(joined)
            del joined
            edges = np.searchsorted(_slice(key, slices), np.arange(slices + 1))
            parts += [(key.astype("<u8"), edges), (n.astype("<u4"), edges)]
        columns = [pa.array([x[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()) for x, edges in parts]
        return pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), *columns], ["slice", "words", "word_counts", "grams", "gram_counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = lambda: [[], [np.zeros(0, np.uint64)]]
        # an earlier model's filter may still be there
        forget()
        held_, n = fresh(), 0
        for batch in batches:
            for _, texts in chunks(batch.column(0), CHUNK):
                own = Texts(texts, order)
                held_[0].append(own.tokens[1:])
                held_[1] += [k[i] for k, i in zip(own.keys[1:], own.inside[1:])]
                n += len(own.owner)
                if n >= FLUSH:
                    yield rows(held_)
                    held_, n = fresh(), 0
        if n:
            yield rows(held_)
        held_ = None
        release()

    return run


def _entries(keys: np.ndarray, counts: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Hashes of the entries of n-grams: one for each level up to that of the count."""
    level = np.searchsorted(low, counts, "right")
    step = np.arange(int(level.sum())) - np.repeat(np.cumsum(level) - level, level)
    return _at(np.repeat(keys, level), step + 1)


def _at(keys: np.ndarray, level: np.ndarray | int) -> np.ndarray:
    return _mixed(keys + np.asarray(level).astype(np.uint64) * _STEP)


def _again(entries: np.ndarray) -> np.ndarray:
    return _mixed(entries ^ _PROBE) | np.uint64(1)


def _place(entries: np.ndarray, again: np.ndarray, j: int, size: np.ndarray | int) -> np.ndarray:
    """Where an entry's bit of its hash j is."""
    return ((entries + np.uint64(j) * again) % np.asarray(size).astype(np.uint64)).astype(np.int64)


_SLICES = "slice int, size bigint, bits binary, words array<bigint>, counts array<bigint>"


def _fill(base: float, bits: int, hashes: int):
    """A slice's counts to its bits, and its words with their counts."""
    low = levels(base)

    def one(rows: pa.Table) -> pa.Table:
        read = lambda name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in rows[name].to_pylist())])
        words, n = _summed(read("words", "<u8"), read("word_counts", "<u4").astype(np.int64))
        grams, m = _summed(read("grams", "<u8"), read("gram_counts", "<u4").astype(np.int64))
        size, parts = 0, []
        for keys, counts in ((words, n), (grams, m)):
            parts.append(_entries(keys, counts, low))
            size += len(parts[-1])
        size = -(-max(1, size * bits) // 64) * 64
        field = np.zeros(size, bool)
        for entries in parts:
            again = _again(entries)
            for j in range(hashes):
                field[_place(entries, again, j, size)] = True
        packed = np.packbits(field, bitorder="little").tobytes()
        lists = [pa.array([x.astype(np.int64)], pa.list_(pa.int64())) for x in (words.view(np.int64), n)]
        return pa.Table.from_arrays([rows["slice"].slice(0, 1), pa.array([size], pa.int64()), pa.array([packed], pa.binary()), *lists], ["slice", "size", "bits", "words", "counts"])

    return one


class Filter:
    """A band of slices of the filter: what lies outside has level 0."""

    def __init__(self, sizes: np.ndarray, first: int, bits: bytes | bytearray, base: float, hashes: int):
        """sizes: bits of all slices; first: the band's first slice; bits: the band's slices in a row."""
        self.sizes, self.hashes, self.most = sizes, hashes, len(levels(base))
        start = np.cumsum(sizes) - sizes
        self.start = start - (start[first] if len(start) else 0)
        self.bits = np.frombuffer(bits, np.uint8)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each n-gram, probed from 1 on."""
        out = np.zeros(len(keys), np.uint8)
        if not len(self.sizes) or not len(keys):
            return out
        own = _slice(keys, len(self.sizes))
        start, size = self.start[own], self.sizes[own]
        open_ = np.flatnonzero((start >= 0) & (start < 8 * len(self.bits)))
        for level in range(1, self.most + 1):
            if not len(open_):
                break
            entries = _at(keys[open_], level)
            again = _again(entries)
            for j in range(self.hashes):
                at = _place(entries, again, j, size[open_]) + start[open_]
                hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                open_, entries, again = open_[hit], entries[hit], again[hit]
            out[open_] = level
        return out


def _bands(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(first, last) of runs of slices of at most so many bytes together; a slice isn't cut."""
    out, first, total = [], 0, 0
    for k, size in enumerate((sizes // 8).tolist()):
        if k > first and total + size > most:
            out.append((first, k))
            first, total = k, 0
        total += size
    return [*out, (first, len(sizes))]


class Shared:
    """A band of the filter as tasks get it: broadcast parts, put together by the process that asks for it."""

    def __init__(self, sizes, first: int, parts: list, base: float, hashes: int):
        self.sizes, self.first, self.parts, self.base, self.hashes = sizes, first, parts, base, hashes

    def filter(self) -> Filter:
        sizes = self.sizes.value
        bits = bytearray()
        for part in self.parts:
            bits += part.value
            # the process has the part's bytes in the filter now
            vars(part).pop("_value", None)
        return Filter(sizes, self.first, bits, self.base, self.hashes)


class Model:
    """What a corpus taught: a table of slices and the sums that all probabilities need."""

    def __init__(self, rows: DataFrame, order: int, base: float, bits: int, hashes: int, prior: float, max_bytes: int, hot: int):
        """rows: text, whole texts to learn from."""
        spark = rows.sparkSession
        self.spark, self.scratch = spark, Scratch(spark, "model")
        self.order, self.base, self.hashes, self.prior = order, base, hashes, prior
        # several slices a task, one at a time: what a task has in memory is a slice
        slices = min(SLICES, FINE * max(partitions(spark), rows.rdd.getNumPartitions()))
        counted = rows.mapInArrow(_count(slices, order), _COUNTS)
        self.table = self.scratch.write(counted.groupBy("slice").applyInArrow(_fill(base, bits, hashes), _SLICES), "slices")
        self.words = self.table.select(F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))))
        one = self.table.agg(F.coalesce(F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)), F.lit(0)), F.coalesce(F.sum(F.size("counts")), F.lit(0))).first()
        self.tokens, self.distinct = one
        # a number a slice; slices without n-grams have no row
        found = dict(self.table.select("slice", "size").collect())
        self.sizes = np.array([found.get(k, 64) for k in range(slices)], np.int64)
        self.bands = _bands(self.sizes, max_bytes)
        self.hot_words, self.hot_counts = self._hot(hot)

    def _hot(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The words of the highest counts, as many as there may be with all of a count or none; sorted."""
        step = F.floor(F.log2("n") * 4)
        sizes, least, total = self.words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).collect(), None, 0
        for r in sorted(sizes, key=lambda r: -r["step"]):
            total += r["words"]
            if total > most:
                break
            least = r["step"]
        if least is None:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        rows = self.words.where(step >= least).toArrow()
        words = rows.column("word").to_numpy().view(np.uint64)
        order = np.argsort(words)
        return words[order], rows.column("n").to_numpy()[order]

    def band(self, k: int) -> Shared:
        """A band of the filter, broadcast in parts: the driver's program holds one part at a time."""
        first, last = self.bands[k]
        context = self.spark.sparkContext
        parts = [context.broadcast(self._bits(first + a, first + b)) for a, b in _bands(self.sizes[first:last], PART)]
        return Shared(context.broadcast(self.sizes), first, parts, self.base, self.hashes)

    def _bits(self, first: int, last: int) -> bytes:
        """Slices in a row; those without n-grams have no row."""
        rows = self.table.where((F.col("slice") >= first) & (F.col("slice") < last)).select("slice", "bits").toArrow()
        bits = dict(zip(rows.column("slice").to_pylist(), rows.column("bits")))
        return b"".join(bits[n].as_buffer() if n in bits else bytes(8) for n in range(first, last))


def _levels_of(own: Texts, filter_: Filter, before: list[bytes | None]) -> np.ndarray:
    """Levels of the chunk's n-grams, a row an order; before: what earlier bands found, for each text."""
    out = np.zeros((len(own.keys), len(own.tokens)), np.uint8)
    for m, (keys, inside) in enumerate(zip(own.keys, own.inside)):
        some = np.flatnonzero(inside)
        distinct, back = np.unique(keys[some], return_inverse=True)
        out[m, some] = filter_.levels(distinct)[back]
    if before and before[0] is not None:
        # of texts one after another, each a row an order, the first end of all before each
        at = 1
        for n, old in zip(own.counts.tolist(), before):
            np.maximum(out[:, at - 1 : at + n], np.frombuffer(old, np.uint8).reshape(len(out), -1), out=out[:, at - 1 : at + n])
            at += n
    return out


def _look(shared: Shared, name: str) -> Filter:
    return held(name, shared.filter)


_LEVELS = "row bigint, text string, levels binary"


def _pass(model: Model, k: int, name: str):
    """Adds a band's levels to what earlier bands found."""
    shared, order = model.band(k), model.order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filter_ = _look(shared, name)
            for part, texts in chunks(batch.column(1), CHUNK):
                own = Texts(texts, order)
                found = _levels_of(own, filter_, batch.column(2)[part].to_pylist())
                ends = np.cumsum(own.counts).tolist()
                out = [found[:, b - n : b + 1].tobytes() for n, b in zip(own.counts.tolist(), ends)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], batch.column(1)[part], pa.array(out, pa.binary())], ["row", "text", "levels"])
        release()

    return run


_SCORED = "row bigint, n_tokens bigint, known bigint, base double, score double, words array<bigint>, times array<bigint>"


def _score(model: Model, k: int, name: str):
    """Scores texts; words whose counts aren't at hand are listed, with how often they are met."""
    shared, hot = model.band(k), model.spark.sparkContext.broadcast((model.hot_words, model.hot_counts))
    order, prior, sizes = model.order, model.prior, typical(model.base)
    tokens, whole = model.tokens, model.tokens + 0.5 * (model.distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = hot.value
        for batch in batches:
            filter_ = _look(shared, name)
            for part, texts in chunks(batch.column(1), CHUNK):
                own = Texts(texts, order)
                n = len(texts)
                count = sizes[_levels_of(own, filter_, batch.column(2)[part].to_pylist())]
                p = (np.minimum(count[0], tokens) + 0.5) / whole
                for m in range(1, order):
                    context = np.append(0.0, count[m - 1][:-1])
                    met = np.minimum(count[m], np.minimum(context, count[m - 1]))
                    p = np.where(own.inside[m], (met + prior * p) / (context + prior), p)
                score = np.bincount(own.owner, np.log10(p[1:]), n)
                token = own.tokens[1:]
                at = np.minimum(np.searchsorted(words, token), max(0, len(words) - 1))
                hit = words[at] == token if len(words) else np.zeros(len(token), bool)
                c = counts[at[hit]]
                known = np.bincount(own.owner[hit], minlength=n)
                base = np.bincount(own.owner[hit], np.log10((c + 0.5) / whole), n).astype(np.float64)
                # the rest once a text and word
                rest, of = token[~hit], own.owner[~hit]
                by = np.lexsort((rest, of))
                rest, of = rest[by], of[by]
                first = np.flatnonzero(np.append(True, (rest[1:] != rest[:-1]) | (of[1:] != of[:-1]))) if len(rest) else np.zeros(0, np.int64)
                ends = np.append(0, np.cumsum(np.bincount(of[first], minlength=n))).astype(np.int32)
                times = np.diff(np.append(first, len(rest)))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (rest[first].view(np.int64), times.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], pa.array(own.counts), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score), *lists], ["row", "n_tokens", "known", "base", "score", "words", "times"])
        release()

    return run


def score(docs: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text", order: int = ORDER, base: float = BASE, bits: int = BITS, hashes: int = HASHES, prior: float = PRIOR, max_bytes: int = MAX_BYTES, hot: int = HOT) -> DataFrame:
    """Per row: the id, learnt (whether learn holds for it), n_tokens, n_known, train_tokens, base_score and score."""
    learnt = F.coalesce(learn, F.lit(False))
    text = whole_text(text_column).alias("text")
    model = Model(docs.where(learnt).select(text), order, base, bits, hashes, prior, max_bytes, hot)
    # what a row is called is written down
    rows = model.scratch.write(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), learnt.alias("learnt"), text), "texts")
    texts = rows.select("row", "text", F.lit(None).cast("binary").alias("levels"))
    name = f"filter {model.scratch.root}"
    for k in range(len(model.bands) - 1):
        texts = model.scratch.write(texts.mapInArrow(_pass(model, k, f"{name} {k}"), _LEVELS), "levels")
    last = len(model.bands) - 1
    scored = model.scratch.write(texts.mapInArrow(_score(model, last, f"{name} {last}"), _SCORED), "scored")
    listed = scored.select("row", F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("times").alias("times"))))
    n = F.coalesce("n", F.lit(0))
    one = F.log10((n + 0.5) / F.lit(model.tokens + 0.5 * (model.distinct + 1)))
    rest = listed.join(model.words, "word", "left").groupBy("row").agg(F.sum(F.col("times") * one).alias("more"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("also"))
    out = rows.select("row", "id", "learnt").join(scored.drop("words", "times"), "row").join(rest, "row", "left")
    known = (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known")
    exact = (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score")
    return out.select(F.col("id").alias(id_column), "learnt", "n_tokens", known, F.lit(model.tokens).cast("bigint").alias("train_tokens"), exact, "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: all documents scored by what four fifths of them teach."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    rows = score(docs, F.coalesce(~held_out, F.lit(True)))
    return rows.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
