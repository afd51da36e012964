"""Operator 11, drifted schema rewrite: sorted files of many schemas turned into files of one, by field id.

Rows are keyed pairs of an RDD. A custom partitioner deals them out by ranges of the crc32 of their id and each partition
is sorted (repartitionAndSortWithinPartitions); what stands before a partition, one count each, gives every row its rank. A
second partitioner deals ranked rows out by file_no, with the rank as the second sort key, and each task writes its files
one after another, row group by row group. The rewrite reads row groups of drifted files in many tasks, matches columns
by Parquet field id, deals the rows out by file_no again with their place in the file as the second key, and writes
evolved files to a folder beside; they replace the old ones when all are whole. Tasks write under a name of their
own and then rename, so that a repeated task does no harm; a file that needs no change isn't touched.

Order: crc32 of the id as text, then the id; rows of one id by a hash of the whole row, so that only equal rows tie. Ids of
more rows than a partition's share are split by that hash (at most as many ids as partitions). To the driver go one
count a partition, these ids, and a line for each of the files, which are 1000 at most; nothing there grows with the input.
A task holds ROWS rows of a file and what Python's external sorter keeps in memory.

Null ids come last (`?` in digests), null values stay null, texts are whole, an empty table makes no files, repeated rows
are kept, columns other than the ten aren't read. Balances that aren't finite are written in digests as Python does.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orfweave.plans.scratch import shared_folder

from .common import partitions, table

#: The evolved schema; ids are places, from 1.
NAMES = ("client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance")
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.timestamp("us"), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.float64())
#: What columns that a file lacks become.
FILL = {"nation_id": -1, "city": "none"}
#: Files at most, and rows of a row group.
FILES, ROWS = 1000, 65536
#: Drift by the bits of a version.
SWAPPED, REVERSED, MISSING, NARROW = 1, 2, 4, 8
_ID = b"PARQUET:field_id"
_LAST = 1 << 32


def _field(number: int, name: str, kind: pa.DataType) -> pa.Field:
    return pa.field(name, kind, True, {_ID: str(number).encode()})


def evolved() -> pa.Schema:
    return pa.schema([_field(k, n, t) for k, (n, t) in enumerate(zip(NAMES, _TYPES), 1)])


def drifted(version: int) -> pa.Schema:
    """The schema of a starting file; ids tell what a column holds, whatever its name."""
    fields = list(evolved())
    if version & SWAPPED:
        other = {"name": "email", "email": "name"}
        fields = [f.with_name(other.get(f.name, f.name)) for f in fields]
    if version & NARROW:
        small = {10: pa.float32(), 8: pa.int32()}
        fields = [f.with_type(small.get(int(f.metadata[_ID]), f.type)) for f in fields]
    if version & MISSING:
        fields = [f for f in fields if int(f.metadata[_ID]) not in (7, 8)]
    if version & REVERSED:
        fields = [fields[0], *fields[:0:-1]]
    return pa.schema(fields)


def version_of(file_no: int) -> int:
    version = zlib.crc32(f"7:{file_no}".encode()) % 24
    return version if version <= 15 else 0


def _ids(schema: pa.Schema) -> list[int]:
    return [int(f.metadata[_ID]) for f in schema]


def _folder(uri: str):
    """The file system and the path in it, in the driver and in tasks alike."""
    from pyarrow import fs

    if "://" in uri and not uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")


def _key(row: tuple) -> tuple[int, int, int]:
    """(crc32 of the id, id, hash of the row); null ids last."""
    own = row[0]
    tie = int.from_bytes(hashlib.blake2b(repr(row).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big")
    return (_LAST, 0, tie) if own is None else (zlib.crc32(str(own).encode()), own, tie)


def _cuts(n: int, hot: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The first keys of partitions after the first: equal ranges of crc32, and those that split hot ids into shares."""
    out = {(k * _LAST // n, -(1 << 63), 0) for k in range(1, n)}
    for crc, own, shares in hot:
        out |= {(crc, own, k * (1 << 64) // shares) for k in range(shares + 1)}
    return sorted(out)


def _rows(clients: DataFrame) -> DataFrame:
    """The ten columns; the time as microseconds since 1970, as it is written."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(updated_at AS TIMESTAMP_NTZ))")
    kinds = {"client_id": "long", "master_id": "long", "nation_id": "long", "balance": "double"}
    return clients.select(*((micros.alias(n) if n == "updated_at" else F.col(n).cast(kinds.get(n, "string")).alias(n)) for n in NAMES))


def ranked(clients: DataFrame) -> tuple[RDD, int]:
    """(rank, row) of every client in the order of crc32, id and row, and how many there are."""
    rows = _rows(clients)
    n = partitions(clients.sparkSession)
    total = rows.count()
    share = max(1, -(-total // n))
    # ids of over a share of the rows: fewer than there are partitions
    hot = rows.groupBy("client_id").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > share).collect()
    cuts = _cuts(n, [(*_key((r["client_id"],))[:2], -(-r["rows"] // share)) for r in hot])
    keyed = rows.rdd.map(lambda r: (_key(tuple(r)), tuple(r)))
    dealt = keyed.repartitionAndSortWithinPartitions(len(cuts) + 1, lambda key: bisect.bisect_right(cuts, key))
    counts = dict(dealt.mapPartitionsWithIndex(lambda k, some: [(k, sum(1 for _ in some))]).collect())
    before, first = {}, 0
    for k in sorted(counts):
        before[k], first = first, first + counts[k]
    return dealt.mapPartitionsWithIndex(lambda k, some: ((rank, row) for rank, (_, row) in enumerate(some, before[k]))), total


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows of the evolved schema as the columns that a schema has, by id; a time is a number."""
    out = []
    for number, kind in zip(_ids(schema), schema.types):
        values = [r[number - 1] for r in rows]
        array = pa.array(values, pa.int64() if pa.types.is_timestamp(kind) else pa.float64() if pa.types.is_floating(kind) else kind)
        out.append(array.cast(kind, safe=False))
    return pa.RecordBatch.from_arrays(out, schema=schema)


def _write(folder: str, name: str, schema: pa.Schema, rows: Iterable[tuple]) -> int:
    """A file of the folder, row group by row group, under its name when it is whole."""
    system, path = _folder(folder)
    own = f"{path}-parts/{name}-{uuid.uuid4().hex}"
    system.create_dir(f"{path}-parts")
    n, held = 0, []
    with system.open_output_stream(own) as out, pq.ParquetWriter(out, schema) as writer:
        for row in rows:
            held.append(row)
            if len(held) == ROWS:
                writer.write_batch(_columns(held, schema))
                n, held = n + len(held), []
        if held:
            writer.write_batch(_columns(held, schema))
    system.create_dir(path)
    system.move(own, f"{path}/{name}")
    return n + len(held)


def _name(file_no: int) -> str:
    return f"clients-{file_no:04d}.parquet"


def _write_files(pairs: RDD, files: int, n: int, folder: str, schema_of) -> list[tuple[int, int]]:
    """((file_no, place), row) to a file for each number, dealt out by file_no and sorted by place: (file_no, rows)."""

    def write(some: Iterator[tuple]) -> Iterator[tuple[int, int]]:
        for file_no, own in groupby(some, lambda pair: pair[0][0]):
            yield file_no, _write(folder, _name(file_no), schema_of(file_no), (row for _, row in own))

    dealt = pairs.repartitionAndSortWithinPartitions(n, lambda key: key[0] * n // files)
    return dealt.mapPartitions(write).collect()


def write_drifted(clients: DataFrame, folder: str) -> int:
    """Writes the clients in their order as files of drifted schemas; gives the number of files."""
    rows, total = ranked(clients)
    size = 1 + total // FILES
    files = -(-total // size)
    if files:
        n = min(files, partitions(clients.sparkSession))
        _write_files(rows.map(lambda pair: ((pair[0] // size, pair[0]), pair[1])), files, n, folder, lambda k: drifted(version_of(k)))
    return files


def _groups(folder: str, file_no: int) -> Iterator[tuple[int, int, int]]:
    """(file_no, row group, rows before it) of a file whose schema isn't the evolved one."""
    system, path = _folder(folder)
    with system.open_input_file(f"{path}/{_name(file_no)}") as source:
        file, first = pq.ParquetFile(source), 0
        if file.schema_arrow.equals(evolved(), check_metadata=True):
            return
        for k in range(file.num_row_groups):
            yield file_no, k, first
            first += file.metadata.row_group(k).num_rows


def _values(batch: pa.RecordBatch) -> Iterator[tuple]:
    """A batch's rows in the evolved schema: columns by id, what is missing filled in."""
    place = {number: k for k, number in enumerate(_ids(batch.schema))}
    columns = []
    for number, (name, kind) in enumerate(zip(NAMES, _TYPES), 1):
        if number in place:
            column = batch.column(place[number]).cast(kind)
            columns.append((column.cast(pa.int64()) if pa.types.is_timestamp(kind) else column).to_pylist())
        else:
            columns.append([FILL.get(name)] * batch.num_rows)
    return zip(*columns)


def _read(folder: str, file_no: int, group: int, first: int) -> Iterator[tuple]:
    system, path = _folder(folder)
    with system.open_input_file(f"{path}/{_name(file_no)}") as source:
        for batch in pq.ParquetFile(source).iter_batches(8192, row_groups=[group]):
            for row in _values(batch):
                yield (file_no, first), row
                first += 1


def rewrite(spark: SparkSession, folder: str, files: int) -> set[int]:
    """Turns the files of a folder into files of the evolved schema; gives the numbers of those that were rewritten."""
    if not files:
        return set()
    n = min(files, partitions(spark))
    numbers = spark.sparkContext.parallelize(range(files), n)
    groups = numbers.flatMap(lambda k: _groups(folder, k)).repartition(n)
    beside = f"{folder}-evolved"
    done = _write_files(groups.flatMap(lambda g: _read(folder, *g)), files, n, beside, lambda k: evolved())
    system, path = _folder(folder)
    # all are whole: at most FILES renames, which may be repeated
    for file_no, _ in done:
        system.move(f"{path}-evolved/{_name(file_no)}", f"{path}/{_name(file_no)}")
    return {file_no for file_no, _ in done}


def _text(name: str, value) -> str:
    if value is None:
        return "?"
    if name == "balance":
        return str(math.floor(1048576 * value)) if math.isfinite(value) else str(value)
    return str(value)


def digest(folder: str, file_no: int) -> tuple[int, int, str, str, str]:
    """n_rows, n_nulls, ids_sha256, rows_sha256 and the columns' names of a file, read batch by batch."""
    ids, rows, n, nulls = hashlib.sha256(), hashlib.sha256(), 0, 0
    system, path = _folder(folder)
    with system.open_input_file(f"{path}/{_name(file_no)}") as source:
        file = pq.ParquetFile(source)
        for batch in file.iter_batches(8192):
            for row in _values(batch):
                nulls += row.count(None)
                fields = [_text(name, value) for name, value in zip(NAMES, row)]
                ids.update(("," * (n > 0) + fields[0]).encode())
                rows.update(("\n" * (n > 0) + "|".join(fields)).encode("utf-8", "surrogatepass"))
                n += 1
        return n, nulls, ids.hexdigest(), rows.hexdigest(), ",".join(file.schema_arrow.names)


_RESULT = "file_no bigint, version bigint, n_rows bigint, n_nulls bigint, ids_sha256 string, rows_sha256 string, start_columns string, columns string, path string, rewritten boolean"


def drift_and_rewrite(clients: DataFrame) -> DataFrame:
    """Writes drifted files in a new folder, rewrites them there, and describes each final file as it is read again."""
    spark = clients.sparkSession
    folder = f"{shared_folder(spark)}/orfweave-rewrite-{uuid.uuid4().hex}/clients"
    files = write_drifted(clients, folder)
    done = rewrite(spark, folder, files)

    def describe(file_no: int) -> tuple:
        version = version_of(file_no)
        n, nulls, ids, rows, names = digest(folder, file_no)
        return file_no, version, n, nulls, ids, rows, ",".join(drifted(version).names), names, f"{folder}/{_name(file_no)}", file_no in done

    return spark.createDataFrame(spark.sparkContext.parallelize(range(files), max(1, min(files, partitions(spark)))).map(describe), _RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: clients in drifted files, rewritten to the evolved schema."""
    return drift_and_rewrite(table(spark, sf_dir, "clients"))
