"""Shared plumbing of the text operators: reading tables, and small helpers."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orfweave.plans.scratch import Scratch  # noqa: F401

#: ASCII white space as the contracts define it, for Java and RE2 alike.
WHITESPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(column: str | Column = "text") -> Column:
    """The text, null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each made unlike all columns of df, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Python workers of this session get rows of whole texts in batches of so many at most: both sides hold a batch at
    once, and texts may be long. A setting that is smaller already stays."""
    if int(spark.conf.get(_BATCH)) > rows:
        spark.conf.set(_BATCH, str(rows))


_HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """What make() gives, kept by this process for the next task that asks for the same name. Workers live longer than tasks
    and serve several operators, so tables of one name only are kept at a time."""
    if name not in _HELD:
        _HELD.clear()
        release()
        _HELD[name] = make()
    return _HELD[name]


def forget() -> None:
    """Gives up what held() keeps, for tasks of a step that needs none of it."""
    _HELD.clear()
    release()


def release() -> None:
    """Gives memory that this process no longer uses back to the machine, where allocators would keep it for a next task that
    may be one of another operator."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
