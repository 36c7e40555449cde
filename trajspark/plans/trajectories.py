"""The main analysis: from cells to labelled clones and cells."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.operators import abundance, clones, cluster, dynamics, selection, vectors
from trajspark.schema import (
    CLONE,
    K,
    MIN_C,
    MIN_CELLS,
    MIN_FC,
    N_CLUSTERS,
    OTHER,
    RESPONSE,
    TIMEPOINT,
    TRB_AA,
    present,
    rename_timepoint,
    require,
)
from trajspark.session import materialize


@dataclass(frozen=True)
class Config:
    """Parameters of ``find_trajectories``.

    ``timepoints`` are the declared timepoints in order; without them those in the data
    are used. ``baseline`` defaults to the first. ``flag`` selects clones by a flag
    column of the cells instead of by their change. ``unique_barcodes`` says that no two
    cells share a barcode, which saves the search for such cells. ``weight`` names the
    column with numbers of cells if the input is a ``cell_profile`` instead of cells.
    """

    clusters: int = N_CLUSTERS
    min_cells: int = MIN_CELLS
    scale: bool = True
    chains: str = "nt"
    ambiguity: str = "combine"
    unique_barcodes: bool = False
    method: str = "hclust"
    correlation: str = "pearson"
    timepoint_column: str = TIMEPOINT
    timepoints: Sequence[int] | None = None
    baseline: int | None = None
    downsample: bool = False
    seed: int = 19
    min_sample_cells: int = 1
    fill_missing: bool = True
    reg: float = 0.0
    min_fc: float = MIN_FC
    min_c: float = MIN_C
    flag: str | Column | None = None
    custom_order: Sequence[int] | None = None
    weight: str | None = None


@dataclass(frozen=True)
class Trajectories:
    """Results of ``find_trajectories``; every table stays a DataFrame.

    ``vectors`` has one row per clone, with ``k``; ``stats`` and ``dynamics`` are its
    long forms. ``units`` holds scaled and unit vectors of the selected clones.
    ``source`` are the cells with ``clone_id``; ``cells`` adds ``k`` when asked for.
    """

    timepoints: tuple[int, ...]
    source: DataFrame
    vectors: DataFrame
    units: DataFrame
    labels: DataFrame

    @cached_property
    def cells(self) -> DataFrame:
        """All cells with ``clone_id`` and ``k``."""
        return cluster.label_cells(self.source, self.labels)

    @property
    def stats(self) -> DataFrame:
        return abundance.clone_stats(self.vectors, self.timepoints)

    @property
    def dynamics(self) -> DataFrame:
        return dynamics.dynamics_table(self.vectors, self.timepoints)

    def summary(self) -> DataFrame:
        """Counts of a run, one row per measure."""
        rows = F.count(F.lit(1))
        cells = self.cells.agg(
            rows.alias("cells"),
            F.count(CLONE).alias("cells_with_clone"),
            F.count_if(F.col(K) != OTHER).alias("cells_labelled"),
        )
        clone_rows = self.vectors.agg(rows.alias("clones"), F.count_if(F.col(K) != OTHER).alias("clones_labelled"))
        chosen = self.units.agg(
            rows.alias("clones_selected"), F.count_if(F.col("u").isNull()).alias("clones_undefined")
        )
        out = None
        for row in (cells, clone_rows, chosen):
            long = row.select(
                F.inline(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in row.columns]))
            )
            out = long if out is None else out.unionByName(long)
        return out


def select_clones(
    changed: DataFrame,
    cells: DataFrame,
    timepoints: Sequence[int],
    config: Config,
    allowlist: DataFrame | None = None,
    exempt: DataFrame | None = None,
) -> DataFrame:
    """Clones that take part in the clustering."""
    if config.flag is None:
        chosen = selection.dynamic_clones(changed, timepoints, config.min_fc, config.min_c, config.baseline)
    else:
        chosen = selection.flagged_clones(changed, cells, config.flag, exempt)
    if allowlist is not None:
        chosen = selection.on_allowlist(chosen, allowlist)
    if exempt is not None:
        chosen = selection.mark_exempt(chosen, exempt)
    return selection.min_clone_size(chosen, config.min_cells)


def find_trajectories(
    cells: DataFrame,
    config: Config = Config(),
    allowlist: DataFrame | None = None,
    exempt: DataFrame | None = None,
) -> Trajectories:
    """Group cells into clones, follow their shares over time and label each clone and cell.

    Cells are scanned once into one row per clone, which is written out. All later steps
    read that table: change and selection on the row itself, then small sums for scaling
    and for the clustering. ``allowlist`` limits the selected clones to listed patient
    and TRB pairs; ``exempt`` lists clones that need no minimum size.
    """
    require(cells, config.timepoint_column)
    source = rename_timepoint(cells, config.timepoint_column)
    if CLONE not in source.columns:
        source = clones.assign_clones(
            source, config.chains, config.ambiguity, unique_barcodes=config.unique_barcodes
        )
    source = source.drop(K)
    with_clone = clones.cells_with_clone(source)
    kept = abundance.min_sample_cells(with_clone, config.min_sample_cells, config.weight)
    if config.downsample:
        if config.weight:
            raise ValueError("downsample needs single cells")
        kept = abundance.downsample_samples(kept, config.min_sample_cells, config.seed)
    timepoints = abundance.observed_timepoints(kept, config.timepoints)
    width = len(timepoints)

    carry = present(source, [RESPONSE, TRB_AA])
    sized = abundance.clone_vectors(kept, timepoints, carry, config.weight)
    changed = dynamics.clone_changes(sized, timepoints, config.reg)
    chosen = select_clones(changed, with_clone, timepoints, config, allowlist, exempt)
    matrix = vectors.abundance_matrix(chosen, width, config.fill_missing)
    if config.flag is not None or allowlist is not None or exempt is not None:
        matrix = materialize(matrix)  # these read further tables, once
    if config.scale:
        matrix = vectors.scaled_matrix(matrix, width)
    units = vectors.unit_vectors(matrix, width, config.correlation)
    if config.method != "absolute":
        units = materialize(units)  # the clusterings read them several times
    labels = cluster.trajectory_labels(
        units, width, config.method, config.clusters, config.correlation, config.custom_order
    )
    return Trajectories(
        timepoints=tuple(timepoints),
        source=source,
        vectors=cluster.label_clones(changed, labels),
        units=units,
        labels=labels,
    )


def without_outliers(found: Trajectories, **limits) -> Trajectories:
    """Label clones with an extreme share, and those never sizeable, as ``Other`` everywhere."""
    ordinary = materialize(selection.ordinary_clones(found.stats, **limits))
    return replace(
        found,
        vectors=selection.relabel_outliers(found.vectors, ordinary),
        labels=found.labels.join(ordinary, CLONE, "left_semi"),
    )
