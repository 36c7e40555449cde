"""Hand-computed composition and abundance reports."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajspark.operators import area, composition

TIMES = (0, 3)
# patient, treatment, k, clone, timepoint, type: cells, cycling cells
CELLS = {
    ("P1", "A", "Traj 1", "c1", 0, "CM"): (2, 0),
    ("P1", "A", "Other", "c2", 0, "CM"): (8, 8),
    ("P1", "A", "Traj 1", "c1", 3, "CM"): (6, 0),
    ("P1", "A", "Traj 1", "c1", 3, "IFN"): (2, 1),
    ("P1", "A", "Other", "c2", 3, "CM"): (2, 0),
    ("P2", "A", "Traj 1", "d1", 0, "CM"): (10, 0),
    ("P2", "A", "Traj 2", "d2", 3, "CM"): (5, 0),
    ("P2", "A", "Other", "d3", 3, "SCM"): (5, 0),
    ("P3", "B", "Traj 2", "e1", 0, "CM"): (20, 1),
    ("P3", "B", "Traj 2", "e1", 3, "CM"): (20, 4),
}


@pytest.fixture(scope="module")
def cells(spark):
    rows = []
    for (patient, treatment, k, clone, t, kind), (n, cycling) in CELLS.items():
        rows += [(f"b{len(rows) + i}", patient, treatment, k, clone, t, kind, int(i < cycling)) for i in range(n)]
    return spark.createDataFrame(
        rows,
        "barcode string, patient_alias string, treatment string, k string, clone_id string, "
        "timepoint int, metaclusters_exh string, mki67 int",
    )


def table(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_treatment_level(cells):
    got = table(
        composition.composition(cells, TIMES), "timepoint", "treatment", "k", "metaclusters_exh"
    )
    # 2 treatments, 2 timepoints, 2 trajectories, types CM and IFN (SCM only occurs in Other)
    assert len(got) == 2 * 2 * 2 * 2
    # P1: 20 % -> 60 %, P2: 100 % -> 0 %
    assert got[3, "A", "Traj 1", "CM"].delta == pytest.approx((40 - 100) / 2)
    assert got[0, "A", "Traj 1", "CM"].delta == 0
    assert got[3, "A", "Traj 2", "CM"].delta == pytest.approx((0 + 50) / 2)
    assert got[3, "A", "Traj 1", "IFN"].delta == pytest.approx((20 + 0) / 2)
    # capped at 10; null without cells
    assert got[3, "A", "Traj 1", "IFN"].cycling == 10
    assert got[0, "B", "Traj 2", "CM"].cycling == 5
    assert got[3, "B", "Traj 2", "CM"].cycling == 10
    assert got[0, "A", "Traj 1", "IFN"].cycling is None
    assert got[3, "B", "Traj 1", "CM"].delta == 0


def test_fold_change_adds_the_constant(cells):
    got = table(composition.composition(cells, TIMES, mode="fc"), "timepoint", "treatment", "k", "metaclusters_exh")
    p1, p2 = math.log2(62 / 22), math.log2(2 / 102)
    assert got[3, "A", "Traj 1", "CM"].delta == pytest.approx((p1 + p2) / 2)
    other = table(
        composition.composition(cells, TIMES, mode="fc", regularization=1), "timepoint", "treatment", "k", "metaclusters_exh"
    )
    assert other[3, "A", "Traj 1", "CM"].delta == pytest.approx((math.log2(61 / 21) + math.log2(1 / 101)) / 2)


def test_all_level_averages_over_every_patient(cells):
    got = table(composition.composition(cells, TIMES, level="all", mode="abs"), "timepoint", "k", "metaclusters_exh")
    assert got[0, "Traj 1", "CM"].delta == pytest.approx((20 + 100 + 0) / 3)
    assert got[0, "Traj 2", "CM"].cycling == 5


def test_patient_level_filters_shape_the_grid(cells):
    got = composition.composition(
        cells, TIMES, level="patient", mode="abs", selected=["Traj 2"], treatments=["A"]
    )
    rows = table(got, "patient_alias", "timepoint", "k", "metaclusters_exh")
    assert set(rows) == {("P2", 0, "Traj 2", "CM"), ("P2", 3, "Traj 2", "CM")}
    assert rows["P2", 3, "Traj 2", "CM"].n == 50 and rows["P2", 0, "Traj 2", "CM"].n == 0
    dropped = composition.composition(
        cells, TIMES, level="patient", mode="abs",
        drop_rows=[{"patient_alias": "P1", "k": "Traj 1", "metaclusters_exh": "IFN"}],
    )
    assert {r.metaclusters_exh for r in dropped.collect()} == {"CM"}
    with pytest.raises(ValueError):
        composition.composition(cells, TIMES, treatments=["A"])
    with pytest.raises(ValueError):
        composition.composition(cells, TIMES, mode="ratio")
    with pytest.raises(ValueError):
        composition.composition(cells, TIMES, level="clone")


def test_a_patient_has_rows_for_its_own_treatment_only(cells):
    rows = composition.composition(cells, TIMES, level="patient").collect()
    assert {(r.patient_alias, r.treatment) for r in rows} == {("P1", "A"), ("P2", "A"), ("P3", "B")}


def test_last_trajectory_leaves_the_samples(cells):
    got = table(composition.composition(cells, TIMES, mode="abs", exclude_last=True), "timepoint", "treatment", "k", "metaclusters_exh")
    assert {key[2] for key in got} == {"Traj 1"}
    # without Traj 2, P2 has 5 cells at week 3, none of them labelled
    assert got[3, "A", "Traj 1", "CM"].delta == pytest.approx((60 + 0) / 2)


def test_type_filters_and_labels(cells):
    report = composition.composition(cells, TIMES)
    top = composition.type_filters(report, top_n=1)
    assert {r.metaclusters_exh for r in top.collect()} == {"CM"}
    assert composition.type_filters(report, top_n=9).count() == report.count()
    kept = composition.type_filters(report, keep_types=["IFN"], trajectories=["Traj 1"])
    assert {(r.metaclusters_exh, r.k) for r in kept.collect()} == {("IFN", "Traj 1")}
    assert {r.metaclusters_exh for r in composition.type_filters(report, drop_types=["IFN"]).collect()} == {"CM"}
    labels = table(composition.peak_labels(report), "treatment", "k", "metaclusters_exh")
    assert set(labels) == {("A", "Traj 2", "CM"), ("A", "Traj 1", "IFN")}
    assert labels["A", "Traj 2", "CM"].timepoint == 3


def test_equal_numbers_of_cells(cells):
    got = composition.composition(cells, TIMES, level="all", mode="abs", equalize=True)
    # 40 cells at each timepoint, so nothing is left out
    plain = composition.composition(cells, TIMES, level="all", mode="abs")
    assert sorted(got.collect(), key=str) == sorted(plain.collect(), key=str)
    # two cells more under B are left out again, whichever they are
    more = cells.union(cells.filter("patient_alias = 'P3'").limit(2).withColumn("barcode", F.concat(F.lit("x"), "barcode")))
    counts = composition.composition(more, TIMES, level="patient", mode="abs", equalize=True)
    assert counts.filter("patient_alias = 'P3' and n > 0").count() == 2
    with pytest.raises(ValueError):
        composition.composition(cells, TIMES, equalize=True, counts=composition.type_counts(cells, TIMES))


def test_clone_share_includes_other(cells):
    got = table(composition.clone_type_frequency(cells, TIMES), "clone_id", "timepoint", "metaclusters_exh")
    assert got["c1", 0, "CM"].freq == pytest.approx(0.2)
    assert ("c2", 0, "CM") not in got


CLONES = [
    # patient, treatment, response, TRB, clone, n_max, k, share at 0, 3
    ("P1", "A", "CR", "S1", "c1", 5, "Traj 2", [50.0, 10.0]),
    ("P1", "A", "CR", "S2", "c2", 5, "Traj 2", [30.0, 20.0]),
    ("P1", "A", "CR", "S1", "c3", 2, "Traj 10", [0.0, 40.0]),
    ("P2", "A", "PD", "S1", "d1", 1, "Traj 2", [1.0, None]),
    ("P3", "B", None, "S1", "e1", 9, "Traj 2", [7.0, 8.0]),
    ("P3", "B", None, "S3", "e2", 9, "Other", [70.0, 80.0]),
]


@pytest.fixture(scope="module")
def clones(spark):
    df = spark.createDataFrame(
        CLONES,
        "patient_alias string, treatment string, response string, TRB_chain_cdr3 string, clone_id string, "
        "n_max bigint, k string, perc array<double>",
    )
    zero = F.array(F.lit(0).cast("bigint"), F.lit(0).cast("bigint"))
    return df.withColumns(
        {"n": zero, "n_tcells_tp": zero, "n_min": F.lit(0), "range": F.lit(0), "range_perc": F.lit(0.0)}
    )


def test_ranks_and_stacking(clones):
    got = table(area.area_base(clones, TIMES), "clone_id", "timepoint")
    assert {key: r.rank_cl for key, r in got.items()} == {
        ("d1", 0): 1,
        ("c1", 0): 3,
        ("c1", 3): 4,
        ("c2", 0): 5,
        ("c2", 3): 6,
        ("e1", 0): 7,
        ("e1", 3): 8,
        ("c3", 0): 1,
        ("c3", 3): 2,
    }
    # Traj 2 comes before Traj 10
    assert {key[0]: r.clone_ord for key, r in got.items()} == {"d1": 1, "c1": 2, "c2": 3, "e1": 4, "c3": 5}


def test_last_trajectory_is_the_highest_number(clones):
    assert {r.k for r in area.drop_last_trajectory(clones).collect()} == {"Traj 2", "Other"}


def test_order_by_column_puts_nulls_last(clones):
    got = {r.clone_id: r.clone_ord for r in area.order_by_column(clones, "response").collect()}
    assert got == {"c1": 1, "c2": 2, "c3": 3, "d1": 4, "e1": 5}


def test_shares(clones):
    got = table(area.area_shares(clones, TIMES), "patient_alias", "k", "timepoint")
    assert got["P1", "Traj 2", 0].perc == 80 and got["P1", "Traj 10", 3].perc == 40
    assert ("P2", "Traj 2", 3) not in got
    scaled = table(area.area_shares(clones, TIMES, normalize=True), "patient_alias", "k", "timepoint")
    # two patients under A, one under B
    assert scaled["P1", "Traj 2", 0].perc == 40 and scaled["P3", "Traj 2", 0].perc == 7
    # patients are counted before the filters
    few = area.area_shares(clones, TIMES, normalize=True, selected=["Traj 10"])
    assert table(few, "patient_alias", "timepoint")["P1", 3].perc == 20
    with pytest.raises(ValueError):
        area.area_shares(clones, TIMES, by=("k",), normalize=True)


def test_share_filters(clones, spark):
    split = table(area.area_shares(clones, TIMES, by=("k",), split_response=True), "response", "k", "timepoint")
    assert set(split) == {
        ("R", "Traj 2", 0), ("R", "Traj 2", 3), ("R", "Traj 10", 0), ("R", "Traj 10", 3), ("NR", "Traj 2", 0)
    }
    one = area.area_shares(clones, TIMES, by=("k",), patient="P1", tcrb=["S1"])
    assert table(one, "k", "timepoint")["Traj 2", 0].perc == 50
    values = area.area_shares(clones, TIMES, by=("response",), values=("response", ["CR"]), exclude_last=True)
    assert table(values, "response", "timepoint")["CR", 3].perc == 30
    nulls = area.area_shares(clones, TIMES, by=("response",), drop_null="response")
    assert {r.response for r in nulls.collect()} == {"CR", "PD"}
    allowed = spark.createDataFrame([("P1", "S2")], "patient_alias string, TRB_chain_cdr3 string")
    listed = area.area_shares(clones, TIMES, by=("k",), allowlist=allowed)
    assert {(r.k, r.perc) for r in listed.collect()} == {("Traj 2", 30.0), ("Traj 2", 20.0)}


def test_any_summary_function(clones):
    highest = table(area.area_shares(clones, TIMES, summary=F.max), "patient_alias", "k", "timepoint")
    assert highest["P1", "Traj 2", 0].perc == 50

    @F.pandas_udf("double")
    def spread(values: pd.Series) -> float:
        return float(values.max() - values.min())

    spreads = table(area.area_shares(clones, TIMES, summary=spread), "patient_alias", "k", "timepoint")
    assert spreads["P1", "Traj 2", 0].perc == 20


def test_running_labels(clones):
    got = {r.clone_id: r.csum for r in area.running_labels(clones, TIMES).collect()}
    # d1 has one row: 1; c1: +50 +10; c2: +30 +20; e1: +7 +8
    assert got == {"c1": 61.0, "c2": 111.0, "e1": 126.0, "c3": 40.0}
    narrowed = {r.clone_id: r.csum for r in area.running_labels(clones, TIMES, patient="P1", tcrb=["S2"]).collect()}
    assert narrowed == {"c2": 50.0}


def test_patient_order(clones):
    got = {r.patient_alias: r.patient_ord for r in area.patient_order(clones).collect()}
    assert got == {"P1": 1, "P2": 2, "P3": 3}
    turned = {r.patient_alias: r.patient_ord for r in area.patient_order(clones, ["B", "A"]).collect()}
    assert turned == {"P3": 1, "P1": 2, "P2": 3}
