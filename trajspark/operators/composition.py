"""Cell-type composition of the trajectories against the first timepoint, and cycling cells.

One parameterised report serves all three levels: over all patients, by treatment, and
by treatment and patient. Cells are first counted by timepoint, treatment, patient,
trajectory and cell type; every later step works on that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.functions.names import is_listed
from trajspark.operators.abundance import downsample_to_smallest
from trajspark.operators.area import drop_last_trajectory
from trajspark.operators.joins import lookup_join
from trajspark.schema import (
    CELL_TYPE,
    CLONE,
    CYCLING_CAP,
    K,
    LABEL_CUTOFF,
    MKI67,
    OTHER,
    PATIENT,
    REGULARIZATION,
    TIMEPOINT,
    TREATMENT,
    present,
    require,
)
from trajspark.session import materialize

LEVELS = {"all": (), "treatment": (TREATMENT,), "patient": (TREATMENT, PATIENT)}
MODES = ("delta", "fc", "abs")
# Treatments and the names shown for them, matched in this order. The
# first must be the whole name, the others may be part of it.
WHOLE_TREATMENT_NAMES = {"aPD1": "(prior ipi)\naPD-1"}
PART_TREATMENT_NAMES = {"aPD-1 (naive)": "\naPD-1", "aCTLA-4": "\naCTLA-4", "Combination": "\nCombination"}


def treatment_display(column: str = TREATMENT) -> Column:
    """Display name of a treatment."""
    name = F.col(column)
    for old, new in WHOLE_TREATMENT_NAMES.items():
        name = F.when(name == old, F.lit(new)).otherwise(name)
    for old, new in PART_TREATMENT_NAMES.items():
        name = F.replace(name, F.lit(old), F.lit(new))
    return name


def type_counts(cells: DataFrame, timepoints: Sequence[int]) -> DataFrame:
    """Cells and cycling cells by sample, trajectory and cell type, ``Other`` included.

    Takes labelled cells, or a labelled ``cell_profile`` with its numbers of cells.
    ``share`` is the percentage of the sample's cells; the sample includes ``Other``.
    A sample has at most trajectories times cell types rows here, so the window over it
    is small. The result is written out once.
    """
    require(cells, TIMEPOINT, TREATMENT, PATIENT, K, CELL_TYPE)
    if "n_cells" in cells.columns:
        n, cycling = F.sum("n_cells"), F.sum("n_cycling")
    else:
        require(cells, MKI67)
        n, cycling = F.count(F.lit(1)), F.count_if(F.col(MKI67) > 0)
    kept = cells.filter(F.col(K).isNotNull() & F.col(TIMEPOINT).isin(*timepoints))
    counted = kept.groupBy(TIMEPOINT, TREATMENT, PATIENT, K, CELL_TYPE).agg(
        n.alias("n_cells"), cycling.alias("n_cycling")
    )
    sample = Window.partitionBy(TIMEPOINT, TREATMENT, PATIENT)
    return materialize(counted.withColumn("n_sample", F.sum("n_cells").over(sample)))


def clone_type_frequency(cells: DataFrame, timepoints: Sequence[int]) -> DataFrame:
    """Share of every labelled clone and cell type in its sample; the sample includes ``Other``.

    Cells are counted by clone and type first; sample totals come from those counts.
    """
    keys = [TIMEPOINT, TREATMENT, PATIENT]
    n = F.sum("n_cells") if "n_cells" in cells.columns else F.count(F.lit(1))
    kept = cells.filter(F.col(K).isNotNull() & F.col(TIMEPOINT).isin(*timepoints))
    counted = materialize(kept.groupBy(*keys, K, CLONE, CELL_TYPE).agg(n.alias("n_cells")))
    samples = counted.groupBy(*keys).agg(F.sum("n_cells").alias("n_sample"))
    return lookup_join(counted.filter(F.col(K) != OTHER), samples, keys, "inner").select(
        *keys, K, CLONE, CELL_TYPE, (F.col("n_cells") / F.col("n_sample")).alias("freq")
    )


def cycling_percent(n_cycling: Column, n_cells: Column) -> Column:
    """Percentage of cycling cells, at most 10; null without cells."""
    return F.when(n_cells > 0, F.least(n_cycling * 100 / n_cells, F.lit(CYCLING_CAP)))


def cycling_table(counts: DataFrame, level: str = "all") -> DataFrame:
    """Cycling percentage by timepoint, trajectory, cell type and the keys of ``level``."""
    keys = [TIMEPOINT, *LEVELS[level], K, CELL_TYPE]
    summed = counts.filter(F.col(K) != OTHER).groupBy(*keys).agg(
        F.sum("n_cells").alias("num"), F.sum("n_cycling").alias("cycling_count")
    )
    return summed.withColumn("cycling", cycling_percent(F.col("cycling_count"), F.col("num")))


def complete_grid(counts: DataFrame, timepoints: Sequence[int], by: Sequence[str]) -> DataFrame:
    """Every patient with every timepoint, trajectory and cell type; absent ones are 0.

    ``by`` holds the columns that stay together (patient, or treatment and patient, so
    that no patient appears under a foreign treatment). The zero rows are the patients
    exploded over the observed levels, added to the counts and summed with them.
    """

    def level(column: str) -> Column:
        return F.explode(counts.agg(F.collect_set(F.struct(column))).scalar())

    values = ["n_cells", "n_cycling", "share"]
    keys = [*by, TIMEPOINT, K, CELL_TYPE]
    zero = (
        counts.select(*by)
        .distinct()
        .withColumn(TIMEPOINT, F.explode(F.array(*[F.lit(t) for t in timepoints])))
        .withColumn("_k", level(K))
        .withColumn("_type", level(CELL_TYPE))
        .select(
            *by,
            TIMEPOINT,
            F.col(f"_k.{K}").alias(K),
            F.col(f"_type.{CELL_TYPE}").alias(CELL_TYPE),
            F.lit(0).cast("bigint").alias("n_cells"),
            F.lit(0).cast("bigint").alias("n_cycling"),
            F.lit(0.0).alias("share"),
        )
    )
    shares = counts.withColumn("share", F.col("n_cells") / F.col("n_sample") * 100)
    return shares.select(*keys, *values).unionByName(zero).groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def against_baseline(rows: DataFrame, group: Sequence[str], baseline: int, mode: str, reg: float) -> DataFrame:
    """Add ``delta``: difference or log2 fold change to the baseline row of the group, or ``n`` itself.

    A group has one row per timepoint.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if mode == "abs":
        return rows.withColumn("delta", F.col("n"))
    first = F.max(F.when(F.col(TIMEPOINT) == baseline, F.col("n"))).over(Window.partitionBy(*group))
    r = F.lit(float(reg))
    change = F.log2((F.col("n") + r) / (first + r)) if mode == "fc" else F.col("n") - first
    return rows.withColumn("delta", change)


def composition(
    cells: DataFrame,
    timepoints: Sequence[int],
    level: str = "treatment",
    mode: str = "delta",
    regularization: float = REGULARIZATION,
    exclude_last: bool = False,
    selected: Sequence[str] | None = None,
    treatments: Sequence[str] | None = None,
    trajectories: Sequence[str] | None = None,
    keep_types: Sequence[str] | None = None,
    drop_types: Sequence[str] | None = None,
    drop_rows: Sequence[dict[str, str]] = (),
    top_n: int | None = None,
    equalize: bool = False,
    seed: int = 19,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Composition of the trajectories over time.

    ``level`` is ``all``, ``treatment`` or ``patient``. Below the patient level, ``delta``
    is averaged over patients, those without cells included as 0. A patient without a
    sample at some timepoint counts as 0 there.

    At patient level ``selected``, ``treatments`` and ``drop_rows`` apply before the grid
    is completed, so they shape it; elsewhere ``selected`` applies after it. ``drop_rows``
    are combinations of column values to leave out. ``equalize`` first takes equally many
    random cells of every timepoint (and treatment), which needs single cells. ``counts``
    passes on the result of ``type_counts`` where several reports are made from the same
    cells.
    """
    if level not in LEVELS:
        raise ValueError(f"level must be one of {', '.join(LEVELS)}")
    by_patient = level == "patient"
    if not by_patient and (treatments is not None or drop_rows):
        raise ValueError("treatments and drop_rows need level='patient'")
    if equalize:
        if counts is not None:
            raise ValueError("equalize needs cells, not counts")
        with_clone = cells.filter(F.col(K).isNotNull() & F.col(TIMEPOINT).isin(*timepoints))
        cells = downsample_to_smallest(with_clone, [TIMEPOINT, *LEVELS[level][:1]], seed)
    counted = type_counts(cells, timepoints) if counts is None else counts
    # the last trajectory leaves the samples, too, so their totals are taken again
    if exclude_last:
        sample = Window.partitionBy(TIMEPOINT, TREATMENT, PATIENT)
        counted = materialize(
            drop_last_trajectory(counted).withColumn("n_sample", F.sum("n_cells").over(sample))
        )
    rows = counted.filter(F.col(K) != OTHER)
    if by_patient:
        if selected is not None:
            rows = rows.filter(is_listed(K, selected))
        if treatments is not None:
            rows = rows.filter(is_listed(TREATMENT, treatments))
        for combination in drop_rows:
            hit = F.lit(True)
            for column, value in combination.items():
                hit = hit & F.col(column).eqNullSafe(F.lit(value))
            rows = rows.filter(~hit)

    keys = LEVELS[level]
    together = [PATIENT] if level == "all" else [TREATMENT, PATIENT]
    if level == "all":
        # a patient's sample is not split by treatment here
        whole = Window.partitionBy(TIMEPOINT, PATIENT)
        rows = (
            counted.withColumn("n_sample", F.sum("n_cells").over(whole))
            .filter(F.col(K) != OTHER)
        )
    grid = complete_grid(rows, timepoints, together).withColumnRenamed("share", "n")
    if selected is not None and not by_patient:
        grid = grid.filter(is_listed(K, selected))
    changed = against_baseline(grid, [*together, K, CELL_TYPE], timepoints[0], mode, regularization)
    if by_patient:
        cycling = cycling_percent(F.col("n_cycling"), F.col("n_cells"))
        out = changed.select(TIMEPOINT, *keys, K, CELL_TYPE, "n", cycling.alias("cycling"), "delta")
    else:
        averaged = changed.groupBy(TIMEPOINT, *keys, K, CELL_TYPE).agg(
            F.sum("n_cycling").alias("_c"), F.sum("n_cells").alias("_n"), F.avg("delta").alias("delta")
        )
        cycling = cycling_percent(F.col("_c"), F.col("_n"))
        out = averaged.select(TIMEPOINT, *keys, K, CELL_TYPE, cycling.alias("cycling"), "delta")
    return type_filters(out, keep_types, drop_types, top_n, trajectories)


def type_filters(
    report: DataFrame,
    keep_types: Sequence[str] | None = None,
    drop_types: Sequence[str] | None = None,
    top_n: int | None = None,
    trajectories: Sequence[str] | None = None,
) -> DataFrame:
    """Keep or drop cell types, keep those that change most, keep trajectories."""
    out = report
    if keep_types is not None:
        out = out.filter(is_listed(CELL_TYPE, keep_types))
    if drop_types is not None:
        out = out.filter(~is_listed(CELL_TYPE, drop_types))
    if top_n is not None:
        out = top_types(out, top_n)
    if trajectories is not None:
        out = out.filter(is_listed(K, trajectories))
    return out


def top_types(report: DataFrame, top_n: int) -> DataFrame:
    """Rows of the ``top_n`` cell types by summed absolute ``delta``; ties with the last are kept."""
    weights = materialize(report.groupBy(CELL_TYPE).agg(F.sum(F.abs("delta")).alias("_weight")))
    least = weights.orderBy(F.desc("_weight")).limit(top_n).agg(F.min("_weight")).scalar()
    top = weights.filter(F.col("_weight") >= least).select(CELL_TYPE)
    return report.join(top, CELL_TYPE, "left_semi")


def peak_labels(report: DataFrame, cutoff: float = LABEL_CUTOFF) -> DataFrame:
    """Per cell type, trajectory and treatment, the row that changed most, if above ``cutoff``.

    The earliest row among equals. A group has one row per timepoint.
    """
    group = [CELL_TYPE, *present(report, [TREATMENT, PATIENT]), K]
    w = Window.partitionBy(*group).orderBy(F.abs("delta").desc_nulls_last(), TIMEPOINT)
    ranked = report.withColumn("_rank", F.row_number().over(w))
    return ranked.filter((F.col("_rank") == 1) & (F.col("delta") > F.lit(float(cutoff)))).drop("_rank")
