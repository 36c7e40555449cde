"""Cleaning of the cell table: recoding, exclusion, sample tables, sample-size control."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.functions.names import is_listed
from trajspark.functions.slots import any_of
from trajspark.operators.joins import lookup_join
from trajspark.schema import (
    PATIENT,
    SAMPLE_FLOOR,
    TIMEPOINT,
    TIMEPOINT_LABEL,
    TIMEPOINT_WEEKS,
    TIMEPOINTS,
    TRA_NT,
    TRB_NT,
    TREATMENT,
    require,
)
from trajspark.session import materialize


def recode_timepoint(
    cells: DataFrame,
    source: str = TIMEPOINT_LABEL,
    target: str = TIMEPOINT,
    weeks: Mapping[str, int] = TIMEPOINT_WEEKS,
) -> DataFrame:
    """Replace a sample label by its week, as text; labels without an entry stay as they are."""
    require(cells, source)
    entries = [F.lit(x) for label, week in weeks.items() for x in (label, str(week))]
    return cells.withColumn(target, F.coalesce(F.try_element_at(F.create_map(*entries), F.col(source)), F.col(source)))


def exclude_patients(cells: DataFrame, patients: Sequence[str]) -> DataFrame:
    """Drop the listed patients; rows without a patient stay."""
    require(cells, PATIENT)
    return cells.filter(~is_listed(PATIENT, patients))


def keep_timepoints(cells: DataFrame, timepoints: Sequence[int] = TIMEPOINTS) -> DataFrame:
    """Keep the listed timepoints and add ``tp_idx``, their position in the list."""
    require(cells, TIMEPOINT)
    week = F.col(TIMEPOINT).try_cast("int")
    position = F.array_position(F.array(*[F.lit(t) for t in timepoints]), week) - 1
    return (
        cells.filter(week.isin(*timepoints))
        .withColumn(TIMEPOINT, week)
        .withColumn("tp_idx", position.cast("int"))
    )


def keep_paired_chains(cells: DataFrame) -> DataFrame:
    """Keep cells with both chains and add ``tcr_name``: both sequences, then the patient."""
    require(cells, TRA_NT, TRB_NT, PATIENT)
    return cells.filter(F.col(TRA_NT).isNotNull() & F.col(TRB_NT).isNotNull()).withColumn(
        "tcr_name", F.concat(TRA_NT, TRB_NT, PATIENT)
    )


def contingency(cells: DataFrame, by: str, levels: Mapping[str, Sequence]) -> DataFrame:
    """Counts for every value of ``by`` and every combination of levels, 0 without a cell.

    Levels are the declared ones and all that the cells have; a null is no level. Cells are
    read once and counted before the shuffle; the rest works on that small table.
    """
    require(cells, by, *levels)
    counted = materialize(cells.groupBy(by, *levels).agg(F.count(F.lit(1)).alias("n")))
    grid = counted.select(by).distinct()
    for column, declared in levels.items():
        kind = counted.schema[column].dataType
        listed = F.array(*[F.lit(v).cast(kind) for v in declared]) if declared else F.array().cast(f"array<{kind.simpleString()}>")
        # levels only: as many as the cells have different ones
        found = counted.agg(F.array_union(listed, F.collect_set(column))).scalar()
        grid = grid.withColumn(column, F.explode(found))
    # as one struct, a null value of ``by`` is equal to itself
    key = [F.struct(by).alias("_by"), *levels]
    sizes = counted.select(*key, "n")
    whole = grid.select(by, *key).join(sizes, ["_by", *levels], "left")
    return whole.select(by, *levels, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def sample_counts(cells: DataFrame, timepoints: Sequence[int] = TIMEPOINTS) -> DataFrame:
    """Cells per patient and timepoint, empty samples included."""
    return contingency(cells, PATIENT, {TIMEPOINT: timepoints})


def treatment_counts(cells: DataFrame, treatments: Sequence[str]) -> DataFrame:
    """Cells per patient and treatment, zero where a patient did not get a treatment."""
    return contingency(cells, PATIENT, {TREATMENT: treatments})


def sample_treatment_counts(
    cells: DataFrame, treatments: Sequence[str], timepoints: Sequence[int] = TIMEPOINTS
) -> DataFrame:
    """Cells per patient, timepoint and treatment on the full grid."""
    return contingency(cells, PATIENT, {TIMEPOINT: timepoints, TREATMENT: treatments})


def failing_patients(
    cells: DataFrame,
    floor: int = SAMPLE_FLOOR,
    exempt_treatment: str | None = None,
    timepoints: Sequence[int] = TIMEPOINTS,
) -> DataFrame:
    """Patients with fewer than ``floor`` cells at any timepoint and no cell of the exempt treatment.

    A timepoint without any cell counts as 0 cells.
    """
    require(cells, PATIENT, TIMEPOINT, TREATMENT)
    exempt = F.count_if(F.col(TREATMENT) == F.lit(exempt_treatment)) if exempt_treatment else F.lit(0)
    sizes = cells.groupBy(PATIENT).agg(
        *[F.count_if(F.col(TIMEPOINT) == F.lit(t)).alias(f"_n{i}") for i, t in enumerate(timepoints)],
        exempt.alias("_exempt"),
    )
    too_small = any_of([F.col(f"_n{i}") < F.lit(floor) for i in range(len(timepoints))])
    return sizes.filter(too_small & (F.col("_exempt") == 0)).select(PATIENT)


def sample_qc(
    cells: DataFrame,
    floor: int = SAMPLE_FLOOR,
    exempt_treatment: str | None = None,
    timepoints: Sequence[int] = TIMEPOINTS,
) -> DataFrame:
    """Drop all cells of the ``failing_patients``."""
    return lookup_join(cells, failing_patients(cells, floor, exempt_treatment, timepoints), [PATIENT], "left_anti")
