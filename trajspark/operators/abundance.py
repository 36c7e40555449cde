"""Clone sizes and shares: long counts and one row per clone with a slot per timepoint."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.functions.slots import largest, long_rows, smallest, with_slots
from trajspark.operators.joins import lookup_join
from trajspark.operators.ordering import take_per_group
from trajspark.schema import (
    CELL_TYPE,
    CLONE,
    K,
    MKI67,
    PATIENT,
    RESPONSE,
    TIMEPOINT,
    TRB_AA,
    TREATMENT,
    present,
    require,
)
from trajspark.session import materialize

COUNT_KEYS = (PATIENT, TIMEPOINT, TREATMENT, CLONE, RESPONSE, TRB_AA)


def observed_timepoints(cells: DataFrame, declared: Sequence[int] | None = None) -> list[int]:
    """The declared timepoints, else those in the data in numeric order."""
    require(cells, TIMEPOINT)
    if declared is not None:
        return list(declared)
    found = cells.filter(F.col(TIMEPOINT).isNotNull()).select(F.col(TIMEPOINT).cast("int").alias("t")).distinct()
    return [row.t for row in found.orderBy("t").collect()]


def min_sample_cells(cells: DataFrame, min_cells: int, weight: str | None = None) -> DataFrame:
    """Keep cells of samples (patient and timepoint) with at least ``min_cells`` cells."""
    require(cells, PATIENT, TIMEPOINT)
    if min_cells <= 1:
        return cells
    n = F.sum(weight) if weight else F.count(F.lit(1))
    large = cells.groupBy(PATIENT, TIMEPOINT).agg(n.alias("_n")).filter(F.col("_n") >= min_cells)
    return lookup_join(cells, large.select(PATIENT, TIMEPOINT), [PATIENT, TIMEPOINT], "left_semi")


def downsample_samples(cells: DataFrame, size: int, seed: int = 19) -> DataFrame:
    """``size`` random cells of every sample (patient and timepoint)."""
    return take_per_group(cells, [PATIENT, TIMEPOINT], size, seed)


def downsample_to_smallest(cells: DataFrame, by: Sequence[str], seed: int = 19) -> DataFrame:
    """As many random cells of every group as the smallest group has."""
    return take_per_group(cells, list(by), None, seed)


def clone_counts(cells: DataFrame) -> DataFrame:
    """Cells per clone and timepoint, by whichever of the known keys the table has."""
    require(cells, CLONE)
    return cells.filter(F.col(CLONE).isNotNull()).groupBy(*present(cells, COUNT_KEYS)).agg(
        F.count(F.lit(1)).alias("n")
    )


def cell_profile(cells: DataFrame) -> DataFrame:
    """Cells and cycling cells per clone, timepoint and cell type.

    The compact form of the cell table that vectors and composition reports read, so
    that the cells are scanned and shuffled once.
    """
    require(cells, PATIENT, TREATMENT, CLONE, TIMEPOINT, CELL_TYPE, MKI67)
    keys = [PATIENT, TREATMENT, *present(cells, [RESPONSE, TRB_AA]), CLONE, TIMEPOINT, CELL_TYPE]
    return cells.filter(F.col(CLONE).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col(MKI67) > 0).alias("n_cycling")
    )


def wide_counts(
    cells: DataFrame, timepoints: Sequence[int], carry: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """One row per clone with its count at every timepoint in the columns ``_n0``, ``_n1`` ...

    ``carry`` names further columns to keep. Where one differs inside a clone the counts
    are summed and its smallest value stays. ``weight`` names a column with numbers of
    cells, for a table that is already aggregated.
    """
    require(cells, PATIENT, TREATMENT, CLONE, TIMEPOINT, *carry)
    cell = F.col(weight) if weight else F.lit(1)
    keys = [PATIENT, TREATMENT, CLONE]
    counters = [
        F.sum(F.when(F.col(TIMEPOINT) == F.lit(t), cell).otherwise(0)).alias(f"_n{i}")
        for i, t in enumerate(timepoints)
    ]
    kept = cells.filter(F.col(CLONE).isNotNull() & F.col(TIMEPOINT).isin(*timepoints))
    counted = kept.groupBy(*keys, *carry).agg(*counters)
    if carry:
        counted = counted.groupBy(*keys).agg(
            *[F.min(c).alias(c) for c in carry],
            *[F.sum(f"_n{i}").alias(f"_n{i}") for i in range(len(timepoints))],
        )
    return counted


def clone_vectors(
    cells: DataFrame, timepoints: Sequence[int], carry: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """One row per clone: arrays ``n``, ``n_tcells_tp``, ``perc`` and the clone's size range.

    A slot is 0 where the sample has cells but none of this clone, and null where the
    patient has no cell at all at that timepoint. Clones are written out once; the
    sample totals come from them and are joined as a size-checked lookup table. Raises
    if a clone has cells under two treatments.
    """
    width = len(timepoints)
    counted = materialize(wide_counts(cells, timepoints, carry, weight))
    totals = materialize(
        counted.groupBy(PATIENT, TREATMENT).agg(*[F.sum(f"_n{i}").alias(f"_total{i}") for i in range(width)])
    )
    rows = check_one_vector_per_clone(counted, totals)
    joined = lookup_join(counted, totals, [PATIENT, TREATMENT], "inner", rows=rows)
    totals_of = [F.col(f"_total{i}") for i in range(width)]
    counts_of = [F.col(f"_n{i}") for i in range(width)]
    joined, size = with_slots(joined, "_size", [F.when(t > 0, t) for t in totals_of])
    joined, n = with_slots(joined, "_count", [F.when(t > 0, c) for t, c in zip(totals_of, counts_of)])
    joined, perc = with_slots(joined, "_perc", [F.try_divide(c, t) * 100 for t, c in zip(totals_of, counts_of)])
    return joined.select(
        PATIENT,
        TREATMENT,
        *carry,
        CLONE,
        F.array(*n).alias("n"),
        F.array(*size).alias("n_tcells_tp"),
        F.array(*perc).alias("perc"),
        largest(n).alias("n_max"),
        smallest(n).alias("n_min"),
        (largest(n) - smallest(n)).alias("range"),
        (largest(perc) - smallest(perc)).alias("range_perc"),
    )


def check_one_vector_per_clone(counted: DataFrame, totals: DataFrame) -> int:
    """Raise if a clone has cells under two treatments; its changes would be ill-defined.

    Only a patient with two treatments, which the small table of totals tells, can have
    such a clone. Returns the number of rows of the totals.
    """
    rows = totals.agg(F.count(F.lit(1)).alias("all"), F.countDistinct(PATIENT).alias("patients")).first()
    if rows["all"] == rows["patients"]:
        return rows["all"]
    twice = counted.groupBy(CLONE).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > 1)
    example = twice.select(CLONE).first()
    if example is not None:
        raise ValueError(f"clone {example[0]} has cells under more than one treatment")
    return rows["all"]


def clone_stats(vectors: DataFrame, timepoints: Sequence[int], extra: Sequence[str] = ()) -> DataFrame:
    """Long form of the vectors: one row per clone and timepoint, with any ``extra`` columns."""
    return vectors.select(
        PATIENT,
        TREATMENT,
        *present(vectors, [RESPONSE, TRB_AA, K]),
        CLONE,
        *extra,
        "n_max",
        "n_min",
        "range",
        "range_perc",
        long_rows(list(timepoints), TIMEPOINT, [(a, a) for a in ("n", "n_tcells_tp", "perc")]),
    )
