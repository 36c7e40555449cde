"""Hand-computed abundance, change and selection."""

import math

import pytest
from pyspark.sql import functions as F

from trajspark.operators import abundance, dynamics, selection, vectors
from trajspark.plans.trajectories import Config, find_trajectories

T2 = (0, 3)
TWO_PATIENTS = {
    ("P1", "A", "c1", 0): 5,
    ("P1", "A", "c2", 0): 3,
    ("P1", "A", "c3", 0): 2,
    ("P1", "A", "c1", 3): 1,
    ("P1", "A", "c2", 3): 3,
    ("P1", "A", "c3", 3): 16,
    ("P2", "B", "d1", 0): 1,
    ("P2", "B", "d2", 0): 1,
    ("P2", "B", "d3", 0): 2,
    ("P2", "B", "d1", 3): 1,
    ("P2", "B", "d2", 3): 6,
    ("P2", "B", "d3", 3): 1,
}


def changes(cells, timepoints, reg=0.0):
    return dynamics.clone_changes(abundance.clone_vectors(cells, timepoints), timepoints, reg)


def by_clone(df):
    return {row.clone_id: row for row in df.collect()}


def test_shares_and_changes(make_cells):
    rows = by_clone(changes(make_cells(TWO_PATIENTS), T2))
    assert rows["c1"].perc == [50.0, 5.0]
    assert rows["c1"].delta_fc == [1.0, 0.1]
    assert rows["c1"].delta_c == [0.0, -45.0]
    assert rows["c3"].perc == [20.0, 80.0]
    assert rows["c3"].delta_fc == [1.0, 4.0]
    assert rows["c3"].avg_freq == [None, 50.0]
    assert rows["d2"].perc == [25.0, 75.0]
    assert (rows["c3"].n_max, rows["c3"].n_min, rows["c3"].range, rows["c3"].range_perc) == (16, 2, 14, 60.0)
    assert (rows["c1"].timepoint_max, rows["c1"].timepoint_min) == (0, 3)
    for i in range(2):
        assert sum(rows[c].perc[i] for c in ("c1", "c2", "c3")) == pytest.approx(100)


def test_missing_sample_is_null_not_zero(make_cells):
    counts = {k: v for k, v in TWO_PATIENTS.items() if not (k[0] == "P2" and k[3] == 3)}
    cells = make_cells(counts)
    rows = by_clone(changes(cells, T2))
    assert rows["d1"].n == [1, None]
    assert rows["d1"].perc == [25.0, None]
    assert rows["d1"].min_perc is None and rows["d1"].max_perc is None
    assert rows["c1"].min_perc == 5.0
    assert rows["d1"].delta_fc == [1.0, 1.0] and rows["d1"].delta_c == [0.0, 0.0]
    assert rows["d1"].avg_freq == [None, None]
    assert rows["d1"].range_perc == 0.0
    found = abundance.clone_vectors(cells, T2)
    assert by_clone(vectors.abundance_matrix(found, 2))["d1"].x == [25.0, 0.0]
    complete = vectors.abundance_matrix(found, 2, fill_missing=False)
    assert set(by_clone(complete)) == {"c1", "c2", "c3"}


def test_absent_clone_is_zero(make_cells):
    counts = {k: v for k, v in TWO_PATIENTS.items() if not (k[2] == "d1" and k[3] == 3)}
    assert by_clone(changes(make_cells(counts), T2))["d1"].n == [1, 0]


THREE = (0, 3, 6)
FROM_ZERO = {
    ("P", "A", "grow", 3): 5,
    ("P", "A", "late", 6): 4,
    ("P", "A", "gone", 0): 4,
    ("P", "A", "rest", 0): 16,
    ("P", "A", "rest", 3): 15,
    ("P", "A", "rest", 6): 16,
}


def test_growth_from_zero(make_cells):
    changed = changes(make_cells(FROM_ZERO), THREE)
    rows = by_clone(changed)
    assert rows["grow"].delta_fc == [1.0, math.inf, 0.0]
    assert rows["late"].delta_fc == [1.0, 1.0, math.inf]
    assert rows["gone"].delta_fc == [1.0, 0.0, 1.0]
    assert set(by_clone(selection.dynamic_clones(changed, THREE))) == {"grow", "late", "gone"}
    damped = by_clone(changes(make_cells(FROM_ZERO), THREE, reg=5.0))
    assert damped["grow"].delta_fc[1] == pytest.approx((25 + 5) / 5)
    # a clone that peaks later does not count as contracting
    assert set(by_clone(selection.dynamic_clones(changed, THREE, baseline=3))) == {"late"} | {"grow"}


def test_first_of_equal_peaks(make_cells):
    counts = {("P", "A", "c", t): n for t, n in zip(THREE, (2, 4, 4))}
    counts |= {("P", "A", "d", t): n for t, n in zip(THREE, (8, 6, 6))}
    rows = by_clone(changes(make_cells(counts), THREE))
    assert (rows["c"].timepoint_max, rows["c"].timepoint_min) == (3, 0)
    assert (rows["d"].timepoint_max, rows["d"].timepoint_min) == (0, 3)


def test_timepoints_in_numeric_order(make_cells):
    cells = make_cells({("P", "A", "c", 12): 1, ("P", "A", "c", 3): 2, ("P", "A", "c", 0): 3})
    assert abundance.observed_timepoints(cells) == [0, 3, 12]
    assert abundance.observed_timepoints(cells, [12, 0]) == [12, 0]
    row = by_clone(abundance.clone_vectors(cells, [0, 3, 12]))["c"]
    assert row.n == [3, 2, 1]


def test_keys_follow_the_columns(make_cells):
    cells = make_cells({("P", "A", "c", 0): 2})
    assert abundance.clone_counts(cells).columns == ["patient_alias", "timepoint", "treatment", "clone_id", "n"]
    more = cells.withColumn("response", F.lit("CR"))
    assert "response" in abundance.clone_counts(more).columns


def test_differing_sequences_inside_a_clone_are_summed(make_cells):
    cells = make_cells({("P", "A", "c", 0): 4}).withColumn(
        "TRB_chain_cdr3", F.when(F.col("barcode") == "b0", "Y").otherwise("X")
    )
    row = abundance.clone_vectors(cells, (0,), carry=["TRB_chain_cdr3"]).collect()
    assert len(row) == 1 and row[0].n == [4] and row[0].TRB_chain_cdr3 == "X"


def test_clone_under_two_treatments_is_refused(make_cells):
    cells = make_cells({("P", "A", "c", 0): 1, ("P", "B", "c", 3): 1})
    with pytest.raises(ValueError, match="clone c"):
        abundance.clone_vectors(cells, T2)
    apart = make_cells({("P", "A", "c", 0): 1, ("P", "B", "d", 3): 1})
    assert abundance.clone_vectors(apart, T2).count() == 2


def test_outlier_cutoff(spark):
    rows = [(f"c{i}", 1.0 + i / 100, 9) for i in range(30)]
    rows += [("huge", 60.0, 50), ("tiny", 0.1, 50), ("small", 5.0, 2)]
    stats = spark.createDataFrame(rows, "clone_id string, perc double, n_max bigint")
    kept = {r.clone_id for r in selection.ordinary_clones(stats).collect()}
    assert kept == {f"c{i}" for i in range(30)}
    relabelled = selection.relabel_outliers(
        stats.withColumn("k", F.lit("Traj 1")), selection.ordinary_clones(stats)
    )
    others = {r.clone_id for r in relabelled.filter("k = 'Other'").collect()}
    assert others == {"huge", "tiny", "small"}


def test_outlier_cutoff_needs_two_shares(spark):
    stats = spark.createDataFrame([("c", 9.0, 9), ("d", None, 9)], "clone_id string, perc double, n_max bigint")
    assert [r.clone_id for r in selection.ordinary_clones(stats).collect()] == ["c"]


def test_selection_by_flag_allowlist_and_exemption(spark, make_cells):
    cells = make_cells(TWO_PATIENTS).withColumn("flagged", F.col("barcode") == "b0").withColumn(
        "TRB_chain_cdr3", F.concat(F.lit("seq-"), "clone_id")
    )
    found = abundance.clone_vectors(cells, T2, carry=["TRB_chain_cdr3"])
    assert set(by_clone(selection.flagged_clones(found, cells, "flagged"))) == {"c1"}
    exempt = spark.createDataFrame([("d1",)], "clone_id string")
    assert set(by_clone(selection.flagged_clones(found, cells, "flagged", exempt))) == {"c1", "d1"}
    marked = selection.mark_exempt(found, exempt)
    assert set(by_clone(selection.min_clone_size(marked, 5))) == {"c1", "c3", "d1", "d2"}
    allowed = spark.createDataFrame([("P1", "seq-c2"), ("P1", "seq-d2")], "patient_alias string, TRB_chain_cdr3 string")
    assert set(by_clone(selection.on_allowlist(found, allowed))) == {"c2"}
    with pytest.raises(ValueError, match="nothing"):
        selection.clones_with_flag(cells, "nothing")


def test_main_analysis_end_to_end(make_cells):
    cells = make_cells(TWO_PATIENTS | {("P1", "A", None, 0): 2}).withColumnRenamed("timepoint", "visit")
    config = Config(method="absolute", timepoint_column="visit", min_cells=1)
    found = find_trajectories(cells.withColumn("k", F.lit("old")), config)
    assert found.timepoints == (0, 3)
    labels = {r.clone_id: r.k for r in found.labels.collect()}
    assert set(labels) == {"c1", "c3", "d2", "d3"}
    assert {labels["c3"], labels["d2"]} == {"Traj 2"} and {labels["c1"], labels["d3"]} == {"Traj 1"}
    stats = found.stats.collect()
    assert len(stats) == 6 * 2 and {r.k for r in stats} == {"Traj 1", "Traj 2", "Other"}
    per_cell = found.cells.groupBy("clone_id", "k").count().collect()
    assert {(r.clone_id, r.k) for r in per_cell} >= {(None, None), ("c2", "Other"), ("c3", "Traj 2")}
    assert found.cells.count() == cells.count()
    assert {r.measure: r.value for r in found.summary().collect()}["cells"] == cells.count()


def test_main_analysis_on_a_profile(make_cells):
    cells = make_cells(TWO_PATIENTS).withColumn("metaclusters_exh", F.lit("CM")).withColumn("mki67", F.lit(0))
    config = Config(method="absolute", min_cells=1, timepoints=T2)
    direct = find_trajectories(cells, config)
    profile = abundance.cell_profile(cells)
    weighed = find_trajectories(profile, Config(method="absolute", min_cells=1, timepoints=T2, weight="n_cells"))
    columns = ["clone_id", "n", "perc", "k"]
    assert sorted(direct.vectors.select(columns).collect()) == sorted(weighed.vectors.select(columns).collect())


def test_minimum_sample_and_fixed_size_sample(make_cells):
    cells = make_cells({("P1", "A", "c", 0): 9, ("P2", "A", "d", 0): 4})
    assert abundance.min_sample_cells(cells, 5).count() == 9
    once = sorted(r.barcode for r in abundance.downsample_samples(cells, 3).collect())
    again = sorted(r.barcode for r in abundance.downsample_samples(cells.repartition(7), 3).collect())
    assert len(once) == 6 and once == again
    assert once != sorted(r.barcode for r in abundance.downsample_samples(cells, 3, seed=20).collect())
