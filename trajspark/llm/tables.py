"""Reading the tables, cutting lineage, and going through sorted partitions in a stream."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm import words
from trajspark.session import shared_path

#: Texts go to and from Python in batches of about this size: a task holds a few of them.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the folder that all executors share, and read again.

    What follows starts from that table, so a lost executor costs no more than its tasks.
    """
    path = shared_path(df.sparkSession, name)
    with _small_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _small_batches(spark: SparkSession):
    """Arrow batches of at most ``BATCH_BYTES`` while a table is written; the session keeps its own setting."""
    before = spark.conf.get(_BATCH_SETTING)
    spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_SETTING, before)


def give_back() -> None:
    """Return the memory of a finished task to the system: the worker process lives on for other tasks."""
    words.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def set_aside(docs: DataFrame, *own: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but ``own`` under names that no operator uses, and what names them back."""
    names = [c if c in own else f"_held{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns)]


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """Apply ``function`` to every Arrow batch of ``df``."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)
        give_back()

    return df.mapInArrow(run, schema)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of rows with the same first ``keys`` columns, in a partition sorted by them.

    A run comes as the list of its slices. Only for groups that are known to be bounded.
    """
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:]):
            key = tuple(c[lo] for c in columns)
            if held and key != last:
                yield held
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield held


def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An array of lists: the first ``counts[0]`` of ``values``, the next ``counts[1]``, and so on."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


FILTER_BITS = 1 << 26
_BITMAP = 1 << 15


class IdFilter:
    """A bitmap of fixed size (8 MB) that holds every id of a table, and some others.

    It spares most rows of a large table the way through a shuffle; a join removes the rest.
    """

    def __init__(self, ids: DataFrame, column: str):
        cell = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
        maps = (
            ids.select((cell / _BITMAP).cast("int").alias("bucket"), (cell % _BITMAP).alias("bit"))
            .groupBy("bucket")
            .agg(F.bitmap_construct_agg("bit").alias("bits"))
        )
        whole = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        size = _BITMAP // 8
        for row in maps.collect():
            whole[row.bucket * size : (row.bucket + 1) * size] = np.frombuffer(bytes(row.bits), dtype=np.uint8)
        self.bits = ids.sparkSession.sparkContext.broadcast(whole)

    @staticmethod
    def cell(column: str):
        return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))

    def keep(self, cells: pa.Array) -> pa.Array:
        """Which rows may be in the table, by their ``cell``."""
        at = cells.to_numpy()
        return pa.array((self.bits.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)


def split(df: DataFrame, ids: DataFrame, column: str, named: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` that may have their ``column`` in ``ids`` (there ``named``), and those that surely have not."""
    wanted = IdFilter(ids, named or column)
    marked = df.withColumn("_cell", IdFilter.cell(column))
    schema = df.schema

    def part(inside: bool) -> DataFrame:
        def take(batch):
            kept = wanted.keep(batch.column(batch.num_columns - 1))
            kept = kept if inside else pa.compute.invert(kept)
            yield batch.filter(kept).select(list(range(batch.num_columns - 1)))

        return map_arrow(marked, take, schema)

    return part(True), part(False)
