"""Joins of a large table with a lookup table whose size is checked first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.functions.slots import any_null
from trajspark.session import materialize

# A lookup row holds a few keys and at most a dozen numbers, so this many rows
# stay well below Spark's own limits for a broadcast table.
BROADCAST_ROWS = 500_000
# A key with more rows than this is too much for one task of a shuffle join.
HOT_ROWS = 2_000_000


def lookup_join(
    fact: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_rows: int | None = None,
    hot_rows: int | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Join ``lookup`` (unique on ``on``) to ``fact`` so that no hot key fills a task.

    The lookup table is computed once and counted. Up to ``max_rows`` rows it is
    broadcast and ``fact`` does not move. Beyond that the fact table is split, see
    ``split_join``. Both ways give the same rows, for ``left``, ``inner``,
    ``left_semi`` and ``left_anti``. ``rows`` passes on the number of rows of a lookup
    table that is in the shared folder already.
    """
    if rows is None:
        lookup = materialize(lookup)
        rows = lookup.count()
    if rows <= (BROADCAST_ROWS if max_rows is None else max_rows):
        return fact.join(F.broadcast(lookup), list(on), how)
    return split_join(fact, lookup, on, how, hot_rows)


def split_join(
    fact: DataFrame, lookup: DataFrame, on: Sequence[str], how: str, hot_rows: int | None = None
) -> DataFrame:
    """Join with a lookup table that is too large to broadcast.

    Keys with more than ``hot_rows`` fact rows are counted out first. There are at most
    ``rows / hot_rows`` of them, so their lookup rows are broadcast and their fact rows
    stay where they are; so do fact rows with a null key, which match nothing. All
    other keys are small enough for a shuffle join.
    """
    on = list(on)
    limit = HOT_ROWS if hot_rows is None else hot_rows
    sizes = fact.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    hot = materialize(sizes.filter(F.col("_rows") > limit).select(*on))
    marked = fact.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on, "left")
    stays = F.col("_hot").isNotNull() | any_null([F.col(c) for c in on])
    hot_lookup = lookup.join(F.broadcast(hot), on, "left_semi")
    in_place = marked.filter(stays).drop("_hot").join(F.broadcast(hot_lookup), on, how)
    shuffled = marked.filter(~stays).drop("_hot").join(lookup, on, how)
    return in_place.unionByName(shuffled)
