"""Approximate nearest neighbours by a permutation index.

A bounded sample of vectors are pivots. Every vector is represented by the order of the
pivots, nearest first, and is filed under its nearest pivot; a file is cut into blocks of
about ``BLOCK_ROWS`` vectors. A query visits the files of its nearest pivots until they
hold ``probe`` of all vectors. In a block, vectors are ranked by the footrule distance of
their permutation to the query's, and the nearest ``keep`` of them are reranked by their
exact inner product. Blocks are read into memory one at a time and queries stream past.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajspark.llm.tables import map_arrow, sorted_groups, written

PIVOTS = 64
ROWS_PER_PIVOT = 4
BLOCK_ROWS = 2048
#: Files are visited until they hold so many times the wanted number, at least.
LEAST_TIMES = 10
NEAREST = 20
PROBE = 0.8
KEEP = 0.4


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``v`` (doubles) of all vectors that can be searched.

    Left out: null ids; vectors that are null, zero, or hold a null or a number that is not
    finite; vectors of another length than most have. An id with several vectors counts
    once, with the smallest.
    """
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & sound & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is not None:
        rows = rows.filter(F.size("v") == sizes["size"])
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def _orders(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Pivots of every vector, the nearest first."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")


def _ranks(order: np.ndarray) -> np.ndarray:
    """The place of every pivot in the permutations."""
    rank = np.empty(order.shape, dtype=np.int16)
    np.put_along_axis(rank, order, np.arange(order.shape[1], dtype=np.int16)[None, :], axis=1)
    return rank


def search(
    vectors: DataFrame,
    is_query,
    nearest: int = NEAREST,
    pivots: int = PIVOTS,
    probe: float = PROBE,
    keep: float = KEEP,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of the ``nearest`` found for each query.

    ``is_query`` is a condition on ``vec_id``. All usable vectors but the query's own are
    candidates; equal scores are ranked by ``vec_id``. See ``usable`` for vectors that take
    no part. Other columns are ignored. Without usable vectors the result is empty.
    """
    rows = written(usable(vectors), "vectors")
    total = rows.count()
    count = max(1, min(pivots, total // ROWS_PER_PIVOT))
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(count).collect()
    centre = np.array([r.v for r in chosen], dtype=float)
    if len(chosen):
        centre /= np.sqrt((centre**2).sum(axis=1, keepdims=True))

    def file(batch):
        order = _orders(_matrix(batch.column(1)), centre)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(order[:, 0].astype(np.int32))], ["vec_id", "v", "file"])

    filed = written(map_arrow(rows, file, "vec_id bigint, v array<double>, file int"), "filed")
    sizes = np.zeros(count, dtype=np.int64)
    for r in filed.groupBy("file").count().collect():  # one row for each pivot
        sizes[r.file] = r["count"]
    blocks = np.maximum(1, -(-sizes // BLOCK_ROWS))

    def visit(batch):
        order = _orders(_matrix(batch.column(1)), centre)
        held = np.cumsum(sizes[order], axis=1)
        files = 1 + (held < max(np.ceil(probe * total), min(total, LEAST_TIMES * nearest))).sum(axis=1)
        for i, n in enumerate(np.minimum(files, count).tolist()):
            at = order[i, :n]
            file = np.repeat(at, blocks[at])
            block = np.concatenate([np.arange(b) for b in blocks[at]])
            one = batch.slice(i, 1)
            take = pa.array(np.zeros(len(file), dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(file.astype(np.int32)), pa.array(block.astype(np.int32)), one.column(0).take(take), one.column(1).take(take)],
                ["file", "block", "vec_id", "v"],
            )

    cuts = F.array(*[F.lit(int(b)) for b in blocks])
    posted = filed.select(
        "file", F.pmod(F.xxhash64("vec_id"), F.get(cuts, F.col("file"))).cast("int").alias("block"), F.lit(0).alias("kind"), "vec_id", "v"
    )
    asked = map_arrow(rows.filter(is_query), visit, "file int, block int, vec_id bigint, v array<double>")
    asked = asked.select("file", "block", F.lit(1).alias("kind"), "vec_id", "v")

    def rank(batches: Iterator[pa.RecordBatch]):
        ids = x = ranks = None
        at = None
        for group in _runs(batches):
            table = pa.Table.from_batches(group).combine_chunks()
            key = (table.column(0)[0].as_py(), table.column(1)[0].as_py())
            names, here = table.column(3).to_numpy(), _matrix(table.column(4).combine_chunks())
            if table.column(2)[0].as_py() == 0:
                at, ids, x = key, names, here
                ranks = _ranks(_orders(x, centre))
                continue
            if at != key:
                continue
            for name, v, r in zip(names, here, _ranks(_orders(here, centre))):
                foot = np.abs(ranks - r).sum(axis=1, dtype=np.int32)
                near = np.argsort(foot, kind="stable")[: max(nearest + 1, int(np.ceil(keep * len(ids))))]
                near = near[ids[near] != name]
                score = (x[near] * v).sum(axis=1)
                best = np.lexsort((ids[near], -score))[:nearest]
                if len(best):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(best), name)), pa.array(ids[near][best]), pa.array(score[best])], ["query_id", "vec_id", "score"]
                    )

    def _runs(batches):
        """Vectors of a block together; its queries in slices."""
        held, last = [], None
        for batch in batches:
            for group in sorted_groups(iter([batch]), 3):
                key = tuple(group[0].column(k)[0].as_py() for k in range(3))
                if held and (key != last or key[2] == 1):
                    yield held
                    held = []
                held += group
                last = key
        if held:
            yield held

    met = posted.union(asked).repartition("file", "block").sortWithinPartitions("file", "block", "kind", "vec_id")
    found = met.mapInArrow(rank, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")
