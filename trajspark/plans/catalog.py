"""One registered query per operator, on the test tables; see ``trajspark.plans.oracles`` for the SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.functions.profiles import profile_width
from trajspark.operators import (
    abundance,
    area,
    clones,
    cluster,
    composition,
    dynamics,
    qc,
    selection,
    vectors,
)
from trajspark.plans.cleaning import clean_cells
from trajspark.plans.trajectories import Config, Trajectories, find_trajectories, without_outliers
from trajspark.schema import (
    BARCODE,
    CELL_TYPE,
    CLONE,
    K,
    PATIENT,
    RESPONSE,
    TIMEPOINT,
    TIMEPOINT_LABEL,
    TIMEPOINTS,
    TRB_AA,
    TREATMENT,
)
from trajspark.session import materialize, shared_path
from trajspark.sources import tables, testbed

Query = Callable[[SparkSession, str], DataFrame]

WIDTH = len(TIMEPOINTS)
# parameters of the queries; the SQL texts use the same
DROPPED_PATIENTS = ["NATION_3", "NATION_7"]
FLOOR = 250
EXEMPT = "ASIA"
SAMPLE_SIZE = 50
#: Weeks of all sample labels of the test tables, those before the baseline included.
ALL_WEEKS = {"Baseline": 0} | {f"Follow Up {k}": 3 * k for k in range(-9, 10) if k}
SEED = 19
CUSTOM_ORDER = [3, 1, 4, 2]
WARD_ORDER = [3, 1, 2, 6, 5, 4]
MIN_ABS_COR = 0.95
SELECTED = ["Traj 1", "Traj 3"]
SOME_TREATMENTS = ["AFRICA", "ASIA", "EUROPE"]
SOME_TYPES = ["AF", "NO", "RF", "AO"]
ONE_PATIENT = "NATION_4"
SOME_TRB = ["Brand#1", "Brand#2", "Brand#11", "Brand#22"]
SOME_PATIENTS = ["NATION_1", "NATION_4", "NATION_8", "NATION_14"]
# treatment names of the published run, put in place of the regions for one query
PUBLISHED_TREATMENTS = {
    "AFRICA": "aPD1",
    "AMERICA": "aPD-1 (naive)",
    "ASIA": "aCTLA-4",
    "EUROPE": "Combination",
}


def rounded(*columns: str | Column) -> list[Column]:
    """Doubles to six places, so that both engines give the same text."""
    out = []
    for c in columns:
        col = F.col(c) if isinstance(c, str) else c
        out.append(F.round(col, 6).alias(c) if isinstance(c, str) else F.round(col, 6))
    return out


def finite(column: str) -> list[Column]:
    """A fold change as a finite number or null, and whether it grew from zero."""
    infinite = F.col(column) == F.lit(float("inf"))
    return [F.round(F.when(~infinite, F.col(column)), 6).alias(column), infinite.alias("from_zero")]


def base_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean cells with their clone. The mapping makes barcodes unique."""
    cleaned = clean_cells(testbed.raw_cells(spark, sf_dir), floor=None)
    return clones.assign_clones(cleaned, unique_barcodes=True)


def whole_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells of all weeks with their clone, null where a chain is missing."""
    cells = qc.recode_timepoint(testbed.raw_cells(spark, sf_dir), weeks=ALL_WEEKS)
    cells = cells.withColumn(TIMEPOINT, F.col(TIMEPOINT).try_cast("int"))
    return clones.assign_clones(cells, unique_barcodes=True)


def base_vectors(
    spark: SparkSession, sf_dir: str, floor: int = 1, carry: Sequence[str] = ()
) -> DataFrame:
    cells = abundance.min_sample_cells(base_cells(spark, sf_dir), floor)
    return abundance.clone_vectors(cells, TIMEPOINTS, carry)


def base_changes(spark: SparkSession, sf_dir: str, floor: int = 1, carry: Sequence[str] = ()) -> DataFrame:
    return dynamics.clone_changes(base_vectors(spark, sf_dir, floor, carry), TIMEPOINTS)


def base_dynamics(spark: SparkSession, sf_dir: str, floor: int = 1) -> DataFrame:
    return dynamics.dynamics_table(base_changes(spark, sf_dir, floor), TIMEPOINTS)


def run(spark: SparkSession, sf_dir: str, method: str = "absolute", **options) -> Trajectories:
    """The main analysis on single cells."""
    config = Config(method=method, timepoints=TIMEPOINTS, **options)
    return find_trajectories(base_cells(spark, sf_dir), config)


def run_on_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled profile: cells are scanned once, for the labels and for the reports."""
    profile = materialize(abundance.cell_profile(base_cells(spark, sf_dir)))
    found = find_trajectories(profile, Config(method="absolute", timepoints=TIMEPOINTS, weight="n_cells"))
    return cluster.label_clones(profile, found.labels)


def chosen_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = base_changes(spark, sf_dir)
    chosen = selection.min_clone_size(selection.dynamic_clones(changed, TIMEPOINTS))
    return vectors.abundance_matrix(chosen, WIDTH)


# sources


def expr_gene_lookup(spark, sf_dir):
    cells = testbed.raw_cells(spark, sf_dir).drop("mki67")
    joined = tables.with_gene_count(cells, testbed.expression(spark, sf_dir))
    return joined.select(BARCODE, CELL_TYPE, "mki67")


def stats_csv_roundtrip(spark, sf_dir):
    table = base_dynamics(spark, sf_dir)
    path = tables.write_dynamics_csv(table, shared_path(spark, "stats"), "absolute")
    back = tables.read_stats_csv(spark, path, table.schema)
    return back.select(
        PATIENT, TREATMENT, CLONE, TIMEPOINT, "n", "n_max", *rounded("perc", "delta_c"), *finite("delta_fc")
    )


def cells_reread(spark, sf_dir):
    """Cells and allow-list written as files and read with their declared columns."""
    cells, listed = shared_path(spark, "cells"), shared_path(spark, "allowlist")
    testbed.raw_cells(spark, sf_dir).write.parquet(cells)
    tables.write_csv(testbed.allowlist(spark, sf_dir), listed)
    found = tables.read_cells(spark, cells).join(tables.read_allowlist(spark, listed), [PATIENT, TRB_AA], "left_semi")
    return found.groupBy(PATIENT, TRB_AA, TIMEPOINT_LABEL, RESPONSE).agg(F.count(F.lit(1)).alias("n"))


def stage_roundtrip(spark, sf_dir):
    rows = base_dynamics(spark, sf_dir)
    return tables.save_stage(rows, shared_path(spark, "stage")).select(CLONE, TIMEPOINT, "n", *rounded("perc", "delta_c"))


def observed_timepoints(spark, sf_dir):
    """All weeks of the cells in their order."""
    cells = whole_cells(spark, sf_dir)
    order = abundance.observed_timepoints(cells, None)
    place = F.array_position(F.array(*[F.lit(t) for t in order]), F.col(TIMEPOINT))
    return cells.groupBy(TIMEPOINT).agg(F.count(F.lit(1)).alias("n")).withColumn("place", place)


def run_summary(spark, sf_dir):
    return run(spark, sf_dir).summary()


# cleaning


def timepoint_recode(spark, sf_dir):
    recoded = qc.recode_timepoint(testbed.raw_cells(spark, sf_dir))
    return recoded.groupBy(TIMEPOINT_LABEL, TIMEPOINT).agg(F.count(F.lit(1)).alias("n"))


def exclude_subjects(spark, sf_dir):
    kept = qc.exclude_patients(testbed.raw_cells(spark, sf_dir), DROPPED_PATIENTS)
    return kept.groupBy(PATIENT).agg(F.count(F.lit(1)).alias("n"))


def timepoint_subset(spark, sf_dir):
    cells = qc.keep_timepoints(qc.recode_timepoint(testbed.raw_cells(spark, sf_dir)))
    return cells.groupBy(PATIENT, TIMEPOINT, "tp_idx").agg(F.count(F.lit(1)).alias("n"))


def paired_chain_filter(spark, sf_dir):
    cells = qc.keep_paired_chains(testbed.raw_cells(spark, sf_dir))
    return cells.groupBy("tcr_name").agg(F.count(F.lit(1)).alias("n"))


def sample_counts(spark, sf_dir):
    return qc.sample_counts(whole_cells(spark, sf_dir))


def sample_qc(spark, sf_dir):
    kept = clean_cells(testbed.raw_cells(spark, sf_dir), floor=FLOOR, exempt_treatment=EXEMPT)
    return kept.groupBy(PATIENT, TREATMENT, TIMEPOINT).agg(F.count(F.lit(1)).alias("n"))


def treatment_counts(spark, sf_dir):
    return qc.treatment_counts(whole_cells(spark, sf_dir), testbed.TREATMENTS)


def contingency3(spark, sf_dir):
    return qc.sample_treatment_counts(whole_cells(spark, sf_dir), testbed.TREATMENTS)


# clones


def clone_assign(spark, sf_dir):
    cells = qc.recode_timepoint(testbed.raw_cells(spark, sf_dir), weeks=ALL_WEEKS)
    cells = cells.withColumn(TIMEPOINT, F.col(TIMEPOINT).try_cast("int"))
    return clones.assign_clones(cells).select(BARCODE, PATIENT, TIMEPOINT, CLONE)


def clone_key_nt(spark, sf_dir):
    keyed = clones.with_clone_key(testbed.raw_cells(spark, sf_dir))
    return keyed.groupBy(CLONE).agg(F.count(F.lit(1)).alias("n"))


def clone_key_aa(spark, sf_dir):
    keyed = clones.with_clone_key(testbed.raw_cells(spark, sf_dir), chains="aa")
    return keyed.groupBy(CLONE).agg(F.count(F.lit(1)).alias("n"))


def clone_assign_aa(spark, sf_dir):
    cells = testbed.raw_cells(spark, sf_dir, shared_barcodes=True)
    done = clones.assign_clones(cells, chains="aa")
    return done.groupBy(BARCODE, CLONE).agg(F.count(F.lit(1)).alias("n"))


def receptor_columns_dropped(spark, sf_dir):
    return clones.drop_receptor_columns(testbed.raw_cells(spark, sf_dir)).drop("flagged", "mki67")


def ambiguous_count(spark, sf_dir):
    return clones.ambiguous_cells(testbed.raw_cells(spark, sf_dir, shared_barcodes=True))


def _resolved(spark, sf_dir, ambiguity):
    cells = testbed.raw_cells(spark, sf_dir, shared_barcodes=True)
    done = clones.assign_clones(cells, ambiguity=ambiguity)
    return done.groupBy(BARCODE, CLONE).agg(F.count(F.lit(1)).alias("n"))


def ambiguity_combine(spark, sf_dir):
    return _resolved(spark, sf_dir, "combine")


def ambiguity_drop(spark, sf_dir):
    return _resolved(spark, sf_dir, "drop")


# abundance


def min_sample_cells(spark, sf_dir):
    kept = abundance.min_sample_cells(whole_cells(spark, sf_dir), FLOOR)
    return kept.groupBy(PATIENT, TIMEPOINT).agg(F.count(F.lit(1)).alias("n"))


def downsample_fixed(spark, sf_dir):
    kept = abundance.downsample_samples(whole_cells(spark, sf_dir), SAMPLE_SIZE, SEED)
    return kept.select(BARCODE, PATIENT, TIMEPOINT, CLONE)


def downsample_to_min(spark, sf_dir):
    kept = abundance.downsample_to_smallest(whole_cells(spark, sf_dir), [TIMEPOINT, TREATMENT], SEED)
    return kept.select(BARCODE, TREATMENT, TIMEPOINT, CLONE)


def clone_counts(spark, sf_dir):
    return abundance.clone_counts(whole_cells(spark, sf_dir))


def clone_counts_complete(spark, sf_dir):
    rows = abundance.clone_stats(base_vectors(spark, sf_dir), TIMEPOINTS)
    return rows.select(PATIENT, TREATMENT, CLONE, TIMEPOINT, "n")


def zero_fill_missing_sample(spark, sf_dir):
    rows = abundance.clone_stats(base_vectors(spark, sf_dir, FLOOR), TIMEPOINTS)
    return rows.select(PATIENT, TREATMENT, CLONE, TIMEPOINT, "n", "n_tcells_tp", *rounded("perc"))


def clone_perc(spark, sf_dir):
    rows = abundance.clone_stats(base_vectors(spark, sf_dir), TIMEPOINTS)
    return rows.select(PATIENT, TREATMENT, CLONE, TIMEPOINT, "n", "n_tcells_tp", *rounded("perc"))


def clone_size_stats(spark, sf_dir):
    found = base_vectors(spark, sf_dir, FLOOR, carry=(RESPONSE, TRB_AA))
    return found.select(
        PATIENT, TREATMENT, RESPONSE, TRB_AA, CLONE, "n_max", "n_min", "range", *rounded("range_perc")
    )


def stats_with_label(spark, sf_dir):
    found = run(spark, sf_dir)
    cells = found.cells.drop("mki67")
    rows = abundance.clone_stats(abundance.clone_vectors(cells, TIMEPOINTS), TIMEPOINTS)
    carried = cluster.label_clones(rows, cluster.labels_of(cells))
    return carried.select(CLONE, TIMEPOINT, "n", K)


# change over time


def delta_fc(spark, sf_dir):
    return base_dynamics(spark, sf_dir).select(CLONE, TIMEPOINT, *finite("delta_fc"))


def delta_c(spark, sf_dir):
    return base_dynamics(spark, sf_dir).select(CLONE, TIMEPOINT, *rounded("delta_c"))


def avg_freq(spark, sf_dir):
    return base_dynamics(spark, sf_dir, FLOOR).select(CLONE, TIMEPOINT, *rounded("avg_freq"))


def perc_min_max(spark, sf_dir):
    return base_changes(spark, sf_dir, FLOOR).select(CLONE, *rounded("min_perc", "max_perc"))


def peak_trough_timepoint(spark, sf_dir):
    return base_changes(spark, sf_dir, FLOOR).select(CLONE, "timepoint_max", "timepoint_min")


def delta_extremes(spark, sf_dir):
    changed = base_changes(spark, sf_dir, FLOOR)
    return changed.select(CLONE, *rounded("delta_fc_min", "delta_c_max", "delta_c_min"), *finite("delta_fc_max"))


# selection


def _ids(df, *columns):
    return df.select(PATIENT, CLONE, "n_max", *columns)


def dynamic_clones(spark, sf_dir):
    return _ids(selection.dynamic_clones(base_changes(spark, sf_dir), TIMEPOINTS))


def flagged_clones(spark, sf_dir):
    cells = base_cells(spark, sf_dir)
    return _ids(selection.flagged_clones(base_vectors(spark, sf_dir), cells, "flagged"))


def _exempt(spark, sf_dir):
    """Clones of the Brand#5 sequence stand for annotated clones."""
    return base_cells(spark, sf_dir).filter(F.col(TRB_AA) == "Brand#5").select(CLONE)


def exempt_clones(spark, sf_dir):
    marked = selection.mark_exempt(base_vectors(spark, sf_dir), _exempt(spark, sf_dir))
    return _ids(selection.min_clone_size(marked), "exempt")


def allowlist_semi(spark, sf_dir):
    found = base_vectors(spark, sf_dir, carry=(TRB_AA,))
    return _ids(selection.on_allowlist(found, testbed.allowlist(spark, sf_dir)), TRB_AA)


def min_clone_size(spark, sf_dir):
    return _ids(selection.min_clone_size(base_vectors(spark, sf_dir)))


def outlier_clones(spark, sf_dir):
    return without_outliers(run(spark, sf_dir)).vectors.select(PATIENT, CLONE, K)


# vectors and correlations


def clone_matrix(spark, sf_dir):
    wide = vectors.wide_matrix(chosen_matrix(spark, sf_dir), TIMEPOINTS)
    return wide.select(CLONE, *rounded(*[f"t{t}" for t in TIMEPOINTS]))


def complete_clones(spark, sf_dir):
    found = vectors.abundance_matrix(base_vectors(spark, sf_dir, FLOOR), WIDTH, fill_missing=False)
    return vectors.wide_matrix(found, TIMEPOINTS).select(CLONE, *rounded(*[f"t{t}" for t in TIMEPOINTS]))


def scaled_matrix(spark, sf_dir):
    scaled = vectors.scaled_matrix(materialize(chosen_matrix(spark, sf_dir)), WIDTH)
    wide = vectors.wide_matrix(scaled, TIMEPOINTS)
    return wide.select(CLONE, *rounded(*[f"t{t}" for t in TIMEPOINTS]))


def _correlations(spark, sf_dir, method):
    found = run(spark, sf_dir, correlation=method)
    means = vectors.mean_correlations(found.units, found.labels, profile_width(method, WIDTH))
    return means.select(CLONE, K, *rounded("mean_cor"))


def corr_pearson(spark, sf_dir):
    return _correlations(spark, sf_dir, "pearson")


def corr_spearman(spark, sf_dir):
    return _correlations(spark, sf_dir, "spearman")


def corr_kendall(spark, sf_dir):
    return _correlations(spark, sf_dir, "kendall")


def corr_anchor_rows(spark, sf_dir):
    found = run(spark, sf_dir)
    ranked = area.ranked_clones(found.vectors)
    largest = ranked.groupBy(K).agg(F.max("clone_rank").alias("clone_rank"))
    anchors = ranked.join(largest, [K, "clone_rank"])
    rows = vectors.anchor_correlations(found.units, anchors, WIDTH)
    return rows.select(CLONE, "anchor_id", *rounded("cor"))


def corr_row_distance(spark, sf_dir):
    found = run(spark, sf_dir)
    projection = vectors.row_projection(found.units, WIDTH)
    return vectors.row_distances(found.units, projection).select(CLONE, *rounded("mean_sq_dist"))


def corr_block_means(spark, sf_dir):
    found = run(spark, sf_dir)
    return vectors.block_means(found.units, found.labels, WIDTH).select(K, "k_other", *rounded("mean_cor"))


def corr_pairs(spark, sf_dir):
    pairs = vectors.correlated_profiles(run(spark, sf_dir).units, WIDTH, MIN_ABS_COR)
    return pairs.select(CLONE, "other_id", "clones", "others", *rounded("cor"))


def corr_pairs_kendall(spark, sf_dir):
    units = run(spark, sf_dir, correlation="kendall").units
    pairs = vectors.correlated_profiles(units, profile_width("kendall", WIDTH), MIN_ABS_COR)
    return pairs.select(CLONE, "other_id", "clones", "others", *rounded("cor"))


def corr_profile_members(spark, sf_dir):
    return vectors.profile_members(run(spark, sf_dir).units)


# trajectories


def _labels(spark, sf_dir, method, **options):
    return run(spark, sf_dir, method, **options).labels.select(CLONE, K)


def traj_hclust(spark, sf_dir):
    return _labels(spark, sf_dir, "hclust")


def traj_pam(spark, sf_dir):
    return _labels(spark, sf_dir, "pam")


def traj_hcpc(spark, sf_dir):
    return _labels(spark, sf_dir, "hcpc")


def traj_hclust_kendall(spark, sf_dir):
    return _labels(spark, sf_dir, "hclust", correlation="kendall")


def traj_hclust_custom(spark, sf_dir):
    return _labels(spark, sf_dir, "hclust", custom_order=WARD_ORDER)


def traj_pam_custom(spark, sf_dir):
    return _labels(spark, sf_dir, "pam", custom_order=WARD_ORDER)


def traj_medoids(spark, sf_dir):
    found = cluster.medoid_clusters(run(spark, sf_dir).units, WIDTH)
    return found.groupBy(K, "medoid").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("distance"), 6).alias("distance")
    )


def traj_ward_loss(spark, sf_dir):
    return cluster.ward_loss(run(spark, sf_dir).units, WIDTH).select("clones", *rounded("lost", "within"))


def traj_sampled(spark, sf_dir):
    """Trajectories of listed clones in samples of equal size."""
    config = Config(
        method="absolute", timepoints=TIMEPOINTS, downsample=True, min_sample_cells=FLOOR, seed=SEED, min_cells=2
    )
    found = find_trajectories(base_cells(spark, sf_dir), config, allowlist=testbed.allowlist(spark, sf_dir))
    return found.labels.select(CLONE, K)


def heatmap_rows(spark, sf_dir):
    return cluster.ordered_labels(run(spark, sf_dir).labels)


def traj_absolute(spark, sf_dir):
    return _labels(spark, sf_dir, "absolute")


def traj_relabel(spark, sf_dir):
    return cluster.relabel(run(spark, sf_dir).labels, CUSTOM_ORDER, WIDTH)


def label_cells(spark, sf_dir):
    return run(spark, sf_dir).cells.select(BARCODE, CLONE, K)


def label_stats(spark, sf_dir):
    return run(spark, sf_dir).stats.select(PATIENT, CLONE, TIMEPOINT, "n", *rounded("perc"), K)


def traj_sizes(spark, sf_dir):
    return cluster.trajectory_sizes(run(spark, sf_dir).labels)


# abundance reports


def rank_in_traj(spark, sf_dir):
    rows = area.long_shares(area.ranked_clones(run(spark, sf_dir).vectors), TIMEPOINTS)
    return rows.select(K, CLONE, TIMEPOINT, "n_max", "rank_cl")


def rank_by_column(spark, sf_dir):
    found = run(spark, sf_dir)
    ordered = area.order_by_column(found.vectors, RESPONSE)
    rows = area.rank_by_column(area.long_shares(ordered, TIMEPOINTS), RESPONSE)
    return rows.select(RESPONSE, CLONE, TIMEPOINT, "rank_cl", "clone_ord")


def cumsum_labels(spark, sf_dir):
    rows = area.running_labels(run(spark, sf_dir).vectors, TIMEPOINTS)
    return rows.select(K, CLONE, TIMEPOINT, *rounded("perc", "csum"))


def area_base(spark, sf_dir):
    rows = area.area_base(run(spark, sf_dir).vectors, TIMEPOINTS)
    return rows.select(PATIENT, TREATMENT, K, CLONE, TIMEPOINT, *rounded("perc"), "rank_cl", "clone_ord")


def exclude_last_traj(spark, sf_dir):
    kept = area.drop_last_trajectory(run(spark, sf_dir).vectors)
    return kept.select(CLONE, K)


def _shares(spark, sf_dir, **options):
    found = run(spark, sf_dir).vectors
    out = area.area_shares(found, TIMEPOINTS, **options)
    return out.select(*[c for c in out.columns if c != "perc"], *rounded("perc"))


def area_by_patient(spark, sf_dir):
    return _shares(spark, sf_dir)


def area_by_patient_mean(spark, sf_dir):
    return _shares(spark, sf_dir, summary=F.avg)


def area_normalized(spark, sf_dir):
    return _shares(spark, sf_dir, normalize=True, selected=SELECTED)


def area_selected(spark, sf_dir):
    return _shares(spark, sf_dir, by=(K,), selected=SELECTED, exclude_last=True)


def area_filtered(spark, sf_dir):
    return _shares(
        spark, sf_dir, by=(PATIENT, RESPONSE, K), drop_null=RESPONSE, values=(PATIENT, SOME_PATIENTS)
    )


def area_tcr(spark, sf_dir):
    return _shares(spark, sf_dir, by=(PATIENT, K, TRB_AA), patient=ONE_PATIENT, tcrb=SOME_TRB)


def area_allowlist(spark, sf_dir):
    return _shares(spark, sf_dir, by=(TREATMENT, K), allowlist=testbed.allowlist(spark, sf_dir))


def area_by_treatment(spark, sf_dir):
    return _shares(spark, sf_dir, by=(TREATMENT, K))


def area_by_response(spark, sf_dir):
    return _shares(spark, sf_dir, by=(RESPONSE, K), split_response=True)


def patient_order(spark, sf_dir):
    return area.patient_order(run(spark, sf_dir).vectors, testbed.TREATMENTS)


# composition reports


def _cycling(spark, sf_dir, level):
    counts = composition.type_counts(run_on_profile(spark, sf_dir), TIMEPOINTS)
    out = composition.cycling_table(counts, level)
    return out.select(*[c for c in out.columns if c != "cycling"], *rounded("cycling"))


def cycling_pct(spark, sf_dir):
    return _cycling(spark, sf_dir, "all")


def cycling_pct_treatment(spark, sf_dir):
    return _cycling(spark, sf_dir, "treatment")


def cycling_pct_patient(spark, sf_dir):
    return _cycling(spark, sf_dir, "patient")


def ctype_freq(spark, sf_dir):
    out = composition.clone_type_frequency(run_on_profile(spark, sf_dir), TIMEPOINTS)
    return out.select(TIMEPOINT, TREATMENT, PATIENT, K, CLONE, CELL_TYPE, *rounded("freq"))


def treatment_labels(spark, sf_dir):
    cells = whole_cells(spark, sf_dir)
    names = [F.lit(x) for pair in PUBLISHED_TREATMENTS.items() for x in pair]
    published = F.coalesce(F.try_element_at(F.create_map(*names), F.col(TREATMENT)), F.col(TREATMENT))
    shown = cells.withColumn(TREATMENT, published).withColumn("display", composition.treatment_display())
    return shown.groupBy(TREATMENT, "display").agg(F.count(F.lit(1)).alias("n"))


def _report(spark, sf_dir, **options):
    out = composition.composition(run_on_profile(spark, sf_dir), TIMEPOINTS, **options)
    doubles = [c for c in ("n", "cycling", "delta") if c in out.columns]
    return out.select(*[c for c in out.columns if c not in doubles], *rounded(*doubles))


def _grid(spark, sf_dir, by):
    counts = composition.type_counts(run_on_profile(spark, sf_dir), TIMEPOINTS)
    rows = counts.filter(F.col(K) != "Other")
    return composition.complete_grid(rows, TIMEPOINTS, by).select(
        *by, TIMEPOINT, K, CELL_TYPE, "n_cells", *rounded("share")
    )


def ctype_complete(spark, sf_dir):
    return _grid(spark, sf_dir, [PATIENT])


def ctype_complete_nested(spark, sf_dir):
    return _grid(spark, sf_dir, [TREATMENT, PATIENT])


def ctype_abs(spark, sf_dir):
    return _report(spark, sf_dir, level="all", mode="abs")


def ctype_delta(spark, sf_dir):
    return _report(spark, sf_dir, level="all", mode="delta")


def ctype_log2fc(spark, sf_dir):
    return _report(spark, sf_dir, level="all", mode="fc", exclude_last=True)


def ctype_treatment(spark, sf_dir):
    return _report(spark, sf_dir)


def ctype_treatment_fc(spark, sf_dir):
    return _report(spark, sf_dir, mode="fc", selected=SELECTED)


def ctype_equalized(spark, sf_dir):
    cells = run(spark, sf_dir).cells
    out = composition.composition(cells, TIMEPOINTS, equalize=True, seed=SEED)
    return out.select(TIMEPOINT, TREATMENT, K, CELL_TYPE, *rounded("cycling", "delta"))


def ctype_treatment_patient(spark, sf_dir):
    return _report(
        spark, sf_dir, level="patient", mode="fc", selected=SELECTED, treatments=SOME_TREATMENTS, keep_types=SOME_TYPES
    )


def ctype_filtered(spark, sf_dir):
    return _report(spark, sf_dir, drop_types=["NO"], trajectories=SELECTED)


def ctype_topn(spark, sf_dir):
    return _report(spark, sf_dir, top_n=2)


def ctype_exclude_cell(spark, sf_dir):
    triple = {PATIENT: ONE_PATIENT, K: "Traj 1", CELL_TYPE: "NO"}
    return _report(spark, sf_dir, level="patient", mode="abs", drop_rows=[triple])


def ctype_peak_label(spark, sf_dir):
    out = composition.peak_labels(composition.composition(run_on_profile(spark, sf_dir), TIMEPOINTS))
    return out.select(TIMEPOINT, TREATMENT, K, CELL_TYPE, *rounded("cycling", "delta"))


QUERIES: tuple[Query, ...] = (
    expr_gene_lookup,
    stats_csv_roundtrip,
    cells_reread,
    stage_roundtrip,
    observed_timepoints,
    run_summary,
    timepoint_recode,
    exclude_subjects,
    timepoint_subset,
    paired_chain_filter,
    sample_counts,
    sample_qc,
    treatment_counts,
    contingency3,
    clone_assign,
    clone_key_nt,
    clone_key_aa,
    clone_assign_aa,
    receptor_columns_dropped,
    ambiguous_count,
    ambiguity_combine,
    ambiguity_drop,
    min_sample_cells,
    downsample_fixed,
    downsample_to_min,
    clone_counts,
    clone_counts_complete,
    zero_fill_missing_sample,
    clone_perc,
    clone_size_stats,
    stats_with_label,
    delta_fc,
    delta_c,
    avg_freq,
    perc_min_max,
    peak_trough_timepoint,
    delta_extremes,
    dynamic_clones,
    flagged_clones,
    exempt_clones,
    allowlist_semi,
    min_clone_size,
    outlier_clones,
    clone_matrix,
    complete_clones,
    scaled_matrix,
    corr_pearson,
    corr_spearman,
    corr_kendall,
    corr_anchor_rows,
    corr_row_distance,
    corr_block_means,
    corr_pairs,
    corr_pairs_kendall,
    corr_profile_members,
    traj_hclust,
    traj_pam,
    traj_hcpc,
    traj_hclust_kendall,
    traj_hclust_custom,
    traj_pam_custom,
    traj_medoids,
    traj_ward_loss,
    traj_sampled,
    heatmap_rows,
    traj_absolute,
    traj_relabel,
    label_cells,
    label_stats,
    traj_sizes,
    rank_in_traj,
    rank_by_column,
    cumsum_labels,
    area_base,
    exclude_last_traj,
    area_by_patient,
    area_by_patient_mean,
    area_normalized,
    area_selected,
    area_filtered,
    area_tcr,
    area_allowlist,
    area_by_treatment,
    area_by_response,
    patient_order,
    cycling_pct,
    cycling_pct_treatment,
    cycling_pct_patient,
    ctype_freq,
    treatment_labels,
    ctype_complete,
    ctype_complete_nested,
    ctype_abs,
    ctype_delta,
    ctype_log2fc,
    ctype_treatment,
    ctype_treatment_fc,
    ctype_equalized,
    ctype_treatment_patient,
    ctype_filtered,
    ctype_topn,
    ctype_exclude_cell,
    ctype_peak_label,
)


def queries() -> dict[str, Query]:
    return {q.__name__: q for q in QUERIES}
