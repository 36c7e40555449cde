"""Ranks, running sums and fixed-size samples for groups that may be very large.

A window that is partitioned by trajectory or by timepoint alone would sort a large
part of the table in one task. The functions here split such a group first.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.operators.joins import lookup_join
from trajspark.schema import BARCODE, require
from trajspark.session import materialize


#: A larger sample of a group is taken by ranks in slices.
LARGEST_SAMPLE = 100_000
#: Parts of a group that are sampled before the group is.
SAMPLE_SALTS = 32
#: Hexadecimal digits of a digest by which a large sample is cut.
PREFIX = 3


def ordered_rank(
    df: DataFrame,
    partition: Sequence[str],
    order: Sequence[str],
    rank: str = "rank",
    running: Mapping[str, str] | None = None,
) -> DataFrame:
    """Row number, and running sums, within ``partition`` in the order of ``order``.

    ``order`` must be unique within the partition. Rows are range-partitioned on
    partition and order and written out, so every slice is a contiguous piece. Each
    slice is ranked by itself; the counts and sums of the slices before it, a table
    with one row per slice and partition value, are added. ``running`` maps an output
    name to the column that is summed.
    """
    running = dict(running or {})
    partition, order = list(partition), list(order)
    # as one struct, null keys are equal to each other and survive the join
    part = F.struct(*partition) if partition else F.lit("")
    sliced = materialize(
        df.repartitionByRange(*[F.col(c) for c in partition + order])
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_part", part)
    )

    sizes = sliced.groupBy("_part", "_slice").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(src).alias(f"_sum_{out}") for out, src in running.items()],
    )
    earlier = Window.partitionBy("_part").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part",
        "_slice",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        *[F.coalesce(F.sum(f"_sum_{out}").over(earlier), F.lit(0)).alias(f"_before_{out}") for out in running],
    )

    within = Window.partitionBy("_slice", "_part").orderBy(*order)
    so_far = within.rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumn("_local", F.row_number().over(within).cast("bigint"))
    for out, src in running.items():
        local = local.withColumn(f"_local_{out}", F.sum(src).over(so_far))
    joined = lookup_join(local, offsets, ["_part", "_slice"], "inner")
    return joined.select(
        *df.columns,
        (F.col("_local") + F.col("_before")).alias(rank),
        *[(F.col(f"_local_{out}") + F.col(f"_before_{out}")).alias(out) for out in running],
    )


def sample_order(seed: int) -> Column:
    """Repeatable random order of cells: a digest of barcode and seed."""
    return F.md5(F.concat(F.col(BARCODE), F.lit(f"|{seed}")))


def first_rows(keyed: DataFrame, size: int, largest: int, limit: Column | None = None) -> DataFrame:
    """The first ``size`` rows of every ``_group`` by ``_digest`` and ``_row``; of a group with a ``limit``, no more than that.

    Every partition keeps its first rows of a group, these are merged in ``SAMPLE_SALTS`` parts
    of the group, then the parts. So no task sees more of a group than a few samples. Samples
    of more than ``largest`` rows come from ranks in range slices instead.
    """
    last = F.lit(size) if limit is None else F.least(F.lit(size), limit)
    order = ["_digest", "_row"]
    if size > largest:
        # equal rows are told apart, as the order must be unique
        numbered = keyed.withColumn("_number", F.monotonically_increasing_id())
        return ordered_rank(numbered, ["_group"], [*order, "_number"], rank="_place").filter(F.col("_place") <= last)
    parts = Window.partitionBy("_group", F.pmod("_row", F.lit(SAMPLE_SALTS))).orderBy(*order)
    whole = Window.partitionBy("_group").orderBy(*order)
    firsts = keyed.withColumn("_place", F.row_number().over(parts)).filter(F.col("_place") <= size)
    kept = firsts.withColumn("_place", F.row_number().over(whole)).filter(F.col("_place") <= size)
    return kept if limit is None else kept.filter(F.col("_place") <= last)


def take_per_group(
    df: DataFrame, by: Sequence[str], size: int | None, seed: int, largest: int = LARGEST_SAMPLE
) -> DataFrame:
    """Keep ``size`` random rows of every group; all rows of a smaller group.

    ``size=None`` takes as many rows of every group as the smallest group has.

    The order is the digest of the barcode, then of the whole row, so the same rows come out
    at any partitioning. A sample of a given size is made in one pass, see ``first_rows``.
    For samples as large as the smallest group, or of more than ``largest`` rows, the table
    is written once with the first ``PREFIX`` digits of the digests. Their counts tell which
    prefixes of a group are kept whole and which one is cut: only rows of that one are
    ranked, all others stay where they are.
    """
    require(df, BARCODE, *by)
    # as one struct, null keys are equal to each other
    group = F.struct(*by)
    row = F.xxhash64(*df.columns)
    if size is not None and size <= largest:
        keyed = df.withColumns({"_group": group, "_digest": sample_order(seed), "_row": row})
        return first_rows(keyed, size, largest).select(*df.columns)

    # no barcode, no digest: before all others, as nulls are
    prefix = F.coalesce(F.substring(sample_order(seed), 1, PREFIX), F.lit(""))
    held = materialize(df.withColumn("_prefix", prefix)).withColumn("_group", group)
    counts = materialize(held.groupBy("_group", "_prefix").agg(F.count(F.lit(1)).alias("n")))
    if size is None:
        size = counts.groupBy("_group").agg(F.sum("n").alias("n")).agg(F.min("n")).first()[0] or 0
    earlier = Window.partitionBy("_group").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # the one prefix with the first row too many; a group without it is kept whole
    cuts = materialize(
        placed.filter((F.col("_before") <= size) & (F.col("_before") + F.col("n") > size)).select(
            "_group", F.col("_prefix").alias("_cut"), (F.lit(size) - F.col("_before")).alias("_left")
        )
    )
    found = cuts.agg(F.count(F.lit(1)).alias("rows"), F.max("_left").alias("most")).first()
    marked = lookup_join(held, cuts, ["_group"], "left", rows=found["rows"])
    whole = marked.filter(F.col("_cut").isNull() | (F.col("_prefix") < F.col("_cut")))
    if not found["most"]:
        return whole.select(*df.columns)
    cut = marked.filter((F.col("_prefix") == F.col("_cut")) & (F.col("_left") > 0))
    keyed = cut.withColumns({"_digest": sample_order(seed), "_row": row})
    ranked = first_rows(keyed, found["most"], largest, F.col("_left"))
    return whole.select(*df.columns).unionByName(ranked.select(*df.columns))
