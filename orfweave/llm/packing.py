"""Operator 9, cost-balanced packing.

Documents become tokens and an end id. Every full sequence's worth of a document is a sequence of its own;
what is left over is packed: a window of such remainders is placed in descending length, each into the
sequence of the lowest cost so far that still has room, cost being a*length + b*length**2 of each piece.
As many sequences are opened as the window's tokens fill, so a remainder that finds no room whole is cut
over the roomiest ones, and a window wastes less than one sequence.

Windows are runs of rows of one input partition; partitions are first joined until they hold LEAST_BYTES of text on
average, so that the sequence which a partition's last window may waste is a small share. There is no shuffle,
memory is bounded by WINDOW remainders and one chunk of texts (a longer text alone: arrays of some 60 times its
bytes), and a repeated task gives the same sequences. Null texts are empty (the end id alone), each row, whatever its
id, is a document of its own even if rows repeat, an empty table gives no rows, and columns other than the id and the
text aren't read, so they may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, small_batches, table, whole_text
from .vocabulary import Encoder, Vocabulary, chunks

CAPACITY = 1024
END_ID = 0
WINDOW = 4096
#: Cost of a piece of n tokens: n for what is linear in it, n * n / QUADRATIC for attention within it.
QUADRATIC = 6144.0
#: Bytes of text that a partition has at least, on average: some 1000 sequences.
LEAST_BYTES = 4 << 20
#: Sequences are numbered from the partition's number times this.
PER_PARTITION = 1 << 40


def place(lengths: np.ndarray, capacity: int = CAPACITY, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Places remainders (1 to capacity - 1 tokens): (remainder, start in it, length, sequence, offset)."""
    room = np.full(-(-int(lengths.sum()) // capacity), capacity)
    cost = np.zeros(len(room))
    out, homeless = [], []

    def put(k: int, start: int, n: int, j: int) -> None:
        out.append((k, start, n, j, capacity - int(room[j])))
        room[j] -= n
        cost[j] += n + n * n / quadratic

    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        j = int(np.argmin(np.where(room >= n, cost, np.inf)))
        if room[j] >= n:
            put(k, 0, n, j)
        else:
            homeless.append(k)
    for k in homeless:
        start = 0
        while start < lengths[k]:
            j = int(np.argmax(room))
            n = int(min(room[j], lengths[k] - start))
            put(k, start, n, j)
            start += n
    return out


class _Packer:
    def __init__(self, first_sequence: int, capacity: int, window: int):
        self.next, self.capacity, self.window = first_sequence, capacity, window
        self.rows: list[tuple] = []
        self.waiting: list[tuple] = []

    def add(self, key: pa.Scalar, ids: np.ndarray) -> None:
        total, capacity = len(ids), self.capacity
        full = total - total % capacity
        for start in range(0, full, capacity):
            self.rows.append((key, start, ids[start : start + capacity].tobytes(), total, self.next, 0))
            self.next += 1
        if total > full:
            self.waiting.append((key, full, ids[full:].copy(), total))
        if len(self.waiting) >= self.window:
            self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        lengths = np.array([len(w[2]) for w in self.waiting])
        for k, start, n, j, offset in place(lengths, self.capacity):
            key, before, ids, total = self.waiting[k]
            self.rows.append((key, before + start, ids[start : start + n].tobytes(), total, self.next + j, offset))
        self.next += -(-int(lengths.sum()) // self.capacity)
        self.waiting = []


def pack(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """Per piece: the id, start (its document's tokens before it), length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens (with the end id), sequence_id and offset there."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(TaskContext.get().partitionId() * PER_PARTITION, capacity, window)
        encoder = kind = None
        for batch in batches:
            encoder, kind = encoder or Encoder.of(shared.value), batch.schema.field(0).type
            keys = batch.column(0)
            for part, texts in chunks(batch.column(1)):
                counts, _, ids = encoder.encode(texts)
                edges = np.cumsum(counts)
                # the end id after each document's tokens
                ids = np.insert(ids.astype("<u4"), edges, end_id)
                edges = np.append(0, edges + np.arange(1, len(counts) + 1)).tolist()
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    packer.add(keys[part.start + k].as_py(), ids[a:b])
                if len(packer.rows) >= 1024:
                    yield _batch(packer, kind)
        packer.flush()
        if packer.rows:
            yield _batch(packer, kind)
        release()

    rows = docs.select(F.col(id_column).alias("id"), whole_text(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.coalesce(max(1, total // LEAST_BYTES))
    out = rows.mapInArrow(run, f"id {kind}, start bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
    return out.select(F.col("id").alias(id_column), "start", (F.octet_length("ids") / 4).cast("long").alias("length"), "ids", "doc_tokens", "sequence_id", "offset")


def _batch(packer: _Packer, kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*packer.rows))
    packer.rows = []
    types = [kind, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["id", "start", "ids", "doc_tokens", "sequence_id", "offset"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: documents packed into sequences of 1024 tokens; the ids as a checksum."""
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
