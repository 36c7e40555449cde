"""Which clones take part in the clustering, and which are outliers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.functions.slots import any_of, slots
from trajspark.operators.joins import lookup_join
from trajspark.schema import (
    CLONE,
    K,
    MIN_C,
    MIN_CELLS,
    MIN_FC,
    OTHER,
    OUTLIER_MIN_PERC,
    OUTLIER_SDS,
    PATIENT,
    TRB_AA,
    require,
)


def is_dynamic(width: int, baseline: int, min_fc: float = MIN_FC, min_c: float = MIN_C) -> Column:
    """Whether a clone of ``clone_changes`` expanded or contracted enough at any timepoint.

    A clone that peaks after the baseline must grow, one that peaks at it must shrink.
    """
    fc, diff = slots("delta_fc", width), slots("delta_c", width)
    grew = any_of([(f > float(min_fc)) & (d > float(min_c)) for f, d in zip(fc, diff)])
    shrank = any_of([(f < 1.0 / min_fc) & (d < -float(min_c)) for f, d in zip(fc, diff)])
    return F.when(F.col("timepoint_max") == baseline, shrank).otherwise(grew)


def dynamic_clones(
    changed: DataFrame,
    timepoints: Sequence[int],
    min_fc: float = MIN_FC,
    min_c: float = MIN_C,
    baseline: int | None = None,
) -> DataFrame:
    """Keep the clones that expanded or contracted."""
    require(changed, "delta_fc", "delta_c", "timepoint_max")
    first = timepoints[0] if baseline is None else baseline
    return changed.filter(is_dynamic(len(timepoints), first, min_fc, min_c))


def clones_with_flag(cells: DataFrame, flag: str | Column) -> DataFrame:
    """Distinct clones with at least one cell for which ``flag`` is true."""
    if isinstance(flag, str):
        require(cells, flag)
        flag = F.col(flag)
    return cells.filter(flag & F.col(CLONE).isNotNull()).select(CLONE).distinct()


def flagged_clones(vectors: DataFrame, cells: DataFrame, flag: str | Column, exempt: DataFrame | None = None) -> DataFrame:
    """Keep clones with a flagged cell, and the exempt clones.

    Both sides have one row per clone, so no key of this join is hot.
    """
    wanted = clones_with_flag(cells, flag)
    if exempt is not None:
        wanted = wanted.union(exempt.select(CLONE)).distinct()
    return vectors.join(wanted, CLONE, "left_semi")


def mark_exempt(vectors: DataFrame, exempt: DataFrame | None) -> DataFrame:
    """Add ``exempt``: true for the clones listed in the ``exempt`` table."""
    if exempt is None:
        return vectors.withColumn("exempt", F.lit(False))
    listed = exempt.select(CLONE).distinct().withColumn("_listed", F.lit(True))
    return (
        vectors.join(listed, CLONE, "left")
        .withColumn("exempt", F.col("_listed").isNotNull())
        .drop("_listed")
    )


def on_allowlist(vectors: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Keep clones whose patient and TRB sequence are listed together."""
    require(vectors, PATIENT, TRB_AA)
    require(allowlist, PATIENT, TRB_AA)
    keys = [PATIENT, TRB_AA]
    return lookup_join(vectors, allowlist.select(*keys).distinct(), keys, "left_semi")


def min_clone_size(vectors: DataFrame, min_cells: int = MIN_CELLS) -> DataFrame:
    """Keep clones that reach ``min_cells`` at some timepoint, and exempt clones if marked."""
    large = F.col("n_max") >= min_cells
    if "exempt" in vectors.columns:
        large = large | F.col("exempt")
    return vectors.filter(large)


def ordinary_clones(
    stats: DataFrame,
    min_perc: float = OUTLIER_MIN_PERC,
    min_cells: int = MIN_CELLS,
    sds: float = OUTLIER_SDS,
) -> DataFrame:
    """Clones with a sizeable share at some timepoint and none above the outlier cutoff.

    The cutoff is mean plus ``sds`` standard deviations of the sizeable shares. With
    fewer than two such shares no clone is an outlier.
    """
    require(stats, "perc", "n_max")
    sizeable = stats.filter((F.col("perc") > min_perc) & (F.col("n_max") >= min_cells))
    cutoff = sizeable.agg(F.avg("perc") + F.lit(float(sds)) * F.stddev_samp("perc")).scalar()
    peaks = sizeable.groupBy(CLONE).agg(F.max("perc").alias("_peak"))
    return peaks.filter(F.coalesce(F.col("_peak") < cutoff, F.lit(True))).select(CLONE)


def relabel_outliers(df: DataFrame, ordinary: DataFrame) -> DataFrame:
    """Set ``k`` to ``Other`` for all clones that are not in ``ordinary``; works on cells and stats.

    Cells without a clone keep their null label.
    """
    require(df, CLONE, K)
    kept = ordinary.select(CLONE, F.lit(True).alias("_kept"))
    marked = lookup_join(df, kept, [CLONE], "left")
    unchanged = F.col(CLONE).isNull() | F.col("_kept").isNotNull()
    return marked.withColumn(K, F.when(unchanged, F.col(K)).otherwise(F.lit(OTHER))).select(*df.columns)
