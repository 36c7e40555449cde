"""Clone keys, ambiguous barcodes, cleaning and sample control."""

import pytest
from pyspark.sql import functions as F

from trajspark import clean_cells
from trajspark.operators import clones, composition, qc
from trajspark.schema import drop_columns, rename_timepoint, require

KEYS = "barcode string, patient_alias string, TRA_chain_cdr3_nt string, TRB_chain_cdr3_nt string, TRB_chain_cdr3 string"


def resolved(df):
    return sorted((r.barcode, r.clone_id) for r in df.collect())


def test_keys(spark):
    cells = spark.createDataFrame(
        [
            ("a", "P1", "1A", "B", "CAS"),
            ("b", "P11", "A", "B", "CA0S"),
            ("c", "P1", None, "B", None),
            ("d", "P1", "A", None, "0"),
        ],
        KEYS,
    )
    nt = {r.barcode: r.clone_id for r in clones.with_clone_key(cells).collect()}
    assert nt == {"a": "P1:1A:B", "b": "P11:A:B", "c": None, "d": None}
    literal = {r.barcode: r.clone_id for r in clones.with_clone_key(cells, missing_chain="literal").collect()}
    assert literal["c"] == "P1:NA:B" and literal["d"] == "P1:A:NA"
    aa = {r.barcode: r.clone_id for r in clones.with_clone_key(cells, "aa").collect()}
    assert aa == {"a": "P1:CAS", "b": None, "c": None, "d": None}
    with pytest.raises(ValueError):
        clones.with_clone_key(cells, "protein")


@pytest.fixture
def shared(spark):
    return spark.createDataFrame(
        [
            ("two", "P", "B", "x", "S"),
            ("two", "P", "A", "x", "S"),
            ("same", "P", "A", "x", "S"),
            ("same", "P", "A", "x", "S"),
            ("one", "P", "A", "x", "S"),
            ("half", "P", "A", "x", "S"),
            ("half", "P", None, "x", "S"),
            ("none", "P", None, None, "S"),
        ],
        KEYS,
    )


def test_combine(shared):
    done = clones.assign_clones(shared)
    assert done.columns == [*shared.columns, "clone_id"]
    assert resolved(done) == sorted(
        [
            ("two", "P:A:x|P:B:x"),
            ("two", "P:A:x|P:B:x"),
            ("same", "P:A:x"),
            ("same", "P:A:x"),
            ("one", "P:A:x"),
            ("half", "P:A:x"),
            ("half", "P:A:x"),
            ("none", None),
        ],
        key=lambda r: (r[0], r[1] or ""),
    )


def test_drop(shared):
    done = {}
    for r in clones.assign_clones(shared, ambiguity="drop").collect():
        done.setdefault(r.barcode, set()).add(r.clone_id)
    assert done["two"] == done["same"] == done["none"] == {None}
    assert done["one"] == {"P:A:x"} and done["half"] == {"P:A:x", None}
    by_sequence = clones.assign_clones(shared, chains="aa", ambiguity="drop")
    assert {r.clone_id for r in by_sequence.filter("barcode = 'one'").collect()} == {"P:S"}


def test_ambiguous_count(shared):
    assert clones.ambiguous_cells(shared).first().n_ambiguous == 2


def test_unique_barcodes_shortcut(shared):
    cells = shared.filter("barcode in ('one', 'none')")
    assert resolved(clones.assign_clones(cells)) == resolved(clones.assign_clones(cells, unique_barcodes=True))


def test_column_helpers(shared):
    assert clones.drop_receptor_columns(shared.withColumn("my_tcr", F.lit(1))).columns == ["barcode", "patient_alias"]
    assert drop_columns(shared, "k", "barcode").columns == shared.columns[1:]
    assert "timepoint" in rename_timepoint(shared.withColumnRenamed("barcode", "visit"), "visit").columns
    with pytest.raises(ValueError, match="nope"):
        require(shared, "barcode", "nope")


RAW = "barcode string, patient_alias string, timepoint_label string, treatment string, TRA_chain_cdr3_nt string, TRB_chain_cdr3_nt string"


def test_recode_is_exact(spark):
    labels = ["Baseline", "Follow Up 1", "Follow Up 6", "Follow Up 10", "other", None]
    cells = spark.createDataFrame([(x,) for x in labels], "timepoint_label string")
    got = {r.timepoint_label: r.timepoint for r in qc.recode_timepoint(cells).collect()}
    assert got == {
        "Baseline": "0",
        "Follow Up 1": "3",
        "Follow Up 6": "18",
        "Follow Up 10": "Follow Up 10",
        "other": "other",
        None: None,
    }


def test_exclusion_keeps_null(spark):
    cells = spark.createDataFrame([("a",), ("b",), (None,)], "patient_alias string")
    kept = {r.patient_alias for r in qc.exclude_patients(cells, ["a"]).collect()}
    assert kept == {"b", None}
    assert qc.exclude_patients(cells, []).count() == 3


def raw_cells(spark, sizes):
    rows = []
    for (patient, label, treatment), n in sizes.items():
        rows += [(f"{patient}-{label}-{i}", patient, label, treatment, "A", "B") for i in range(n)]
    return spark.createDataFrame(rows, RAW)


def test_sample_control(spark):
    cells = raw_cells(
        spark,
        {
            ("full", "Baseline", "x"): 3,
            ("full", "Follow Up 1", "x"): 3,
            ("small", "Baseline", "x"): 3,
            ("small", "Follow Up 1", "x"): 2,
            ("absent", "Baseline", "x"): 9,
            ("naive", "Baseline", "exempt"): 1,
        },
    )
    kept = clean_cells(cells, timepoints=(0, 3), floor=3, exempt_treatment="exempt")
    assert {r.patient_alias for r in kept.collect()} == {"full", "naive"}
    no_exemption = clean_cells(cells, timepoints=(0, 3), floor=3)
    assert {r.patient_alias for r in no_exemption.collect()} == {"full"}
    timed = qc.keep_timepoints(qc.recode_timepoint(cells), (0, 3))
    table = {(r.patient_alias, r.timepoint): r.n for r in qc.sample_counts(timed, (0, 3)).collect()}
    assert len(table) == 8 and table["absent", 3] == 0 and table["small", 3] == 2
    treated = {(r.patient_alias, r.treatment): r.n for r in qc.treatment_counts(timed, ["x", "exempt"]).collect()}
    assert treated["naive", "x"] == 0 and treated["naive", "exempt"] == 1
    cube = qc.sample_treatment_counts(timed, ["x", "exempt"], (0, 3)).collect()
    assert len(cube) == 4 * 2 * 2 and sum(r.n for r in cube) == 21


def test_declared_order_gives_the_index(spark):
    cells = spark.createDataFrame([("12",), ("0",), ("3",), ("x",)], "timepoint string")
    got = {r.timepoint: r.tp_idx for r in qc.keep_timepoints(cells, (12, 0, 3)).collect()}
    assert got == {12: 0, 0: 1, 3: 2}


def test_treatment_display(spark):
    names = ["aPD1", "aPD-1 (naive)", "aCTLA-4", "Combination", "xaPD1"]
    df = spark.createDataFrame([(n,) for n in names], "treatment string")
    got = {r.treatment: r.d for r in df.select("treatment", composition.treatment_display().alias("d")).collect()}
    assert got == {
        "aPD1": "(prior ipi)\naPD-1",
        "aPD-1 (naive)": "\naPD-1",
        "aCTLA-4": "\naCTLA-4",
        "Combination": "\nCombination",
        "xaPD1": "xaPD1",
    }


def test_contingency_keeps_levels_that_are_not_declared(spark):
    cells = spark.createDataFrame([("p", 0), ("p", 12), ("q", 0), ("q", None)], "patient_alias string, timepoint int")
    got = {(r.patient_alias, r.timepoint): r.n for r in qc.sample_counts(cells, (0, 3)).collect()}
    assert got == {("p", 0): 1, ("p", 3): 0, ("p", 12): 1, ("q", 0): 1, ("q", 3): 0, ("q", 12): 0}
