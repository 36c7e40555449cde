"""Change from one timepoint to the next, per clone, on the clone's own row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.functions.slots import any_null, label_of, largest, long_rows, slots, smallest, with_slots
from trajspark.schema import CLONE, PATIENT, RESPONSE, TIMEPOINT, TRB_AA, TREATMENT, present, require

CHANGE_COLUMNS = (
    "min_perc",
    "max_perc",
    "timepoint_max",
    "timepoint_min",
    "delta_fc_max",
    "delta_fc_min",
    "delta_c_max",
    "delta_c_min",
)


def fold_change(now: Column, before: Column, reg: float) -> Column:
    """``now / before``; infinite when growing from zero, 1 when undefined."""
    top, bottom = (now + float(reg), before + float(reg)) if reg else (now, before)
    grown = F.when((bottom == 0) & (top > 0), F.lit(float("inf")))
    return F.coalesce(F.when(bottom > 0, top / bottom), grown, F.lit(1.0))


def clone_changes(vectors: DataFrame, timepoints: Sequence[int], reg: float = 0.0) -> DataFrame:
    """Add the arrays ``delta_fc``, ``delta_c``, ``avg_freq`` and their extremes per clone.

    At the first timepoint the fold change is 1, the difference 0 and the mean null.
    ``min_perc`` and ``max_perc`` are null if any timepoint has no sample; all other
    extremes ignore such timepoints. Needs no shuffle.
    """
    require(vectors, "perc")
    perc = slots("perc", len(timepoints))
    pairs = list(zip(perc[1:], perc[:-1]))
    fc = [F.lit(1.0), *[fold_change(now, before, reg) for now, before in pairs]]
    diff = [F.lit(0.0), *[F.coalesce(now - before, F.lit(0.0)) for now, before in pairs]]
    mean = [F.lit(None).cast("double"), *[(now + before) / 2 for now, before in pairs]]
    stepped, fc = with_slots(vectors, "_fc", fc)
    stepped, diff = with_slots(stepped, "_diff", diff)
    incomplete = any_null(perc)
    return stepped.select(
        *vectors.columns,
        F.array(*fc).alias("delta_fc"),
        F.array(*diff).alias("delta_c"),
        F.array(*mean).alias("avg_freq"),
        F.when(~incomplete, smallest(perc)).alias("min_perc"),
        F.when(~incomplete, largest(perc)).alias("max_perc"),
        label_of(perc, timepoints, largest).alias("timepoint_max"),
        label_of(perc, timepoints, smallest).alias("timepoint_min"),
        largest(fc).alias("delta_fc_max"),
        smallest(fc).alias("delta_fc_min"),
        largest(diff).alias("delta_c_max"),
        smallest(diff).alias("delta_c_min"),
    )


def dynamics_table(changed: DataFrame, timepoints: Sequence[int]) -> DataFrame:
    """Long form of ``clone_changes``: one row per clone and timepoint."""
    arrays = ("n", "n_tcells_tp", "perc", "delta_fc", "delta_c", "avg_freq")
    return changed.select(
        PATIENT,
        TREATMENT,
        *present(changed, [RESPONSE, TRB_AA]),
        CLONE,
        "n_max",
        "n_min",
        "range",
        "range_perc",
        *CHANGE_COLUMNS,
        long_rows(list(timepoints), TIMEPOINT, [(a, a) for a in arrays]),
    )
