"""The drifted schema rewrite against plain Python over all rows."""

import datetime
import hashlib
import math
import os
import zlib

import pyarrow.parquet as pq

from orfweave.llm import schema_rewrite as op

SCHEMA = "client_id bigint, master_id bigint, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double, Name_ string"


def people(n):
    start = datetime.datetime(2024, 1, 1)
    out = []
    for k in range(n):
        row = [k, k // 2, f"s{k % 3}", start + datetime.timedelta(hours=k, microseconds=k), f"näme {k}", f"e{k}@x", f"c{k % 7}", k % 25, "retail", k / 7 - 20, "extra"]
        if k % 5:
            row[1 + k % 9] = None
        out.append(tuple(row))
    return out


def brute(rows):
    """By file: the lines of the final file."""
    rows = sorted(rows, key=lambda r: (r[0] is None, zlib.crc32(str(r[0]).encode()), r[0] or 0))
    size, out = 1 + len(rows) // 1000, {}
    for rank, r in enumerate(rows):
        version = zlib.crc32(f"7:{rank // size}".encode()) % 24
        version = 0 if version > 15 else version
        r = list(r[:10])
        if version & 4:
            r[6], r[7] = "none", -1
        if version & 8 and r[9] is not None:
            import numpy as np

            r[9] = float(np.float32(r[9]))
        if r[3] is not None:
            r[3] = (r[3] - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
        if r[9] is not None:
            r[9] = math.floor(1048576 * r[9])
        out.setdefault((rank // size, version), []).append(r)
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_rewrite(spark):
    rows = people(2300)
    got = {r.file_no: r for r in op.drift_and_rewrite(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    want = brute(rows)
    assert sorted(got) == sorted(k for k, _ in want) == list(range(767))
    text = lambda x: "?" if x is None else str(x)
    versions = set()
    for (k, version), lines in want.items():
        r = got[k]
        versions.add(version)
        assert (r.version, r.n_rows, r.rewritten) == (version, len(lines), version != 0)
        assert r.n_nulls == sum(x is None for line in lines for x in line)
        assert r.ids_sha256 == sha(",".join(text(line[0]) for line in lines))
        assert r.rows_sha256 == sha("\n".join("|".join(map(text, line)) for line in lines))
        assert r.columns == ",".join(op.NAMES)
        path = r.path.removeprefix("file://")
        # read by a plain reader: the evolved schema with its ids
        assert pq.ParquetFile(path).schema_arrow.equals(op.evolved(), check_metadata=True)
    assert versions == set(range(16))
    folder = os.path.dirname(path)
    assert sorted(os.listdir(folder)) == [f"clients-{k:04d}.parquet" for k in range(767)]
    columns = got[next(k for k, v in want if v == 7)].start_columns
    assert columns == "client_id,balance,segment,name,email,updated_at,source,master_id"


def test_untouched_and_row_groups(spark, monkeypatch):
    """Files without drift keep their bytes; files of many row groups keep their order."""
    from orfweave.plans.scratch import shared_folder

    folder = f"{shared_folder(spark)}/rewrite-test/clients"
    rows = [(None, r[1], *r[2:]) if k % 9 == 0 else r for k, r in enumerate(people(60))]
    evolved = [tuple([*r[:3], None, *r[4:10]]) for r in rows]
    for k, version in enumerate((0, 15, 6)):
        monkeypatch.setattr(op, "ROWS", 7)
        op._write(folder, op._name(k), op.drifted(version), evolved)
    path = folder.removeprefix("file://")
    before = os.stat(f"{path}/{op._name(0)}")
    starts = [pq.read_table(f"{path}/{op._name(k)}") for k in range(3)]
    assert pq.ParquetFile(f"{path}/{op._name(1)}").num_row_groups == 9
    assert op.rewrite(spark, folder, 3) == {1, 2}
    after = os.stat(f"{path}/{op._name(0)}")
    assert (before.st_ino, before.st_mtime_ns) == (after.st_ino, after.st_mtime_ns)
    # again: nothing to do
    assert op.rewrite(spark, folder, 3) == set()
    for k, start in enumerate(starts):
        table = pq.read_table(f"{path}/{op._name(k)}")
        assert table.column("client_id").to_pylist() == start.column("client_id").to_pylist() == [r[0] for r in rows]
        # names are swapped in the file of version 15, not what they hold
        assert table.column("email").to_pylist() == [r[5] for r in rows] == start.column("name" if k == 1 else "email").to_pylist()
        assert table.column("city").to_pylist() == ([r[6] for r in rows] if k == 0 else ["none"] * 60)


def test_hot_and_empty(spark):
    """One client with most rows is dealt out to several partitions; ranks stay whole. Repeated rows are kept."""
    hot = [(7, k // 3, "x", None, None, None, None, None, None, None, None) for k in range(900)]
    rows = hot + people(100) + [(None,) * 11] * 2
    ranked, total = op.ranked(spark.createDataFrame(rows, SCHEMA))
    got = ranked.collect()
    assert total == len(rows) and [k for k, _ in got] == list(range(total))
    assert [r[0] for _, r in got] == [r[0] for r in sorted(rows, key=lambda r: (r[0] is None, zlib.crc32(str(r[0]).encode()), r[0] or 0))]
    assert max(ranked.glom().map(len).collect()) < 500
    assert op.drift_and_rewrite(spark.createDataFrame([], SCHEMA)).count() == 0
