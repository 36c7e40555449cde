"""From the raw cell table to the cells that enter the analysis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from trajspark.operators import qc
from trajspark.schema import SAMPLE_FLOOR, TIMEPOINT_LABEL, TIMEPOINTS


def clean_cells(
    cells: DataFrame,
    timepoints: Sequence[int] = TIMEPOINTS,
    drop_patients: Sequence[str] = (),
    floor: int | None = SAMPLE_FLOOR,
    exempt_treatment: str | None = None,
) -> DataFrame:
    """Recode the timepoint, drop patients, keep timepoints and paired chains, control sample sizes.

    All steps up to the last are projections and filters on the scan. ``floor=None``
    leaves out the control of sample sizes.
    """
    out = qc.recode_timepoint(cells) if TIMEPOINT_LABEL in cells.columns else cells
    if drop_patients:
        out = qc.exclude_patients(out, drop_patients)
    out = qc.keep_paired_chains(qc.keep_timepoints(out, timepoints))
    if floor is not None:
        out = qc.sample_qc(out, floor, exempt_treatment, timepoints)
    return out
