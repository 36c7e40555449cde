"""Every registered query against its SQL text, and what the plans must not contain."""

import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from trajspark.plans import catalog, oracles  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "supplier", "part", "lineitem")
QUERIES = catalog.queries()
SQL = oracles.oracle_sql()
TYPES = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    yield con
    con.close()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


# At least one query per operator module; TRAJSPARK_ALL_QUERIES=1 runs all of them.
CORE = (
    "expr_gene_lookup",
    "stats_csv_roundtrip",
    "run_summary",
    "timepoint_recode",
    "sample_qc",
    "sample_counts",
    "treatment_counts",
    "contingency3",
    "clone_assign",
    "ambiguity_combine",
    "ambiguity_drop",
    "clone_key_aa",
    "clone_counts",
    "min_sample_cells",
    "downsample_fixed",
    "downsample_to_min",
    "zero_fill_missing_sample",
    "clone_perc",
    "delta_fc",
    "delta_extremes",
    "flagged_clones",
    "exempt_clones",
    "outlier_clones",
    "corr_pearson",
    "corr_kendall",
    "corr_row_distance",
    "corr_pairs",
    "corr_profile_members",
    "traj_hclust",
    "traj_hclust_kendall",
    "traj_pam",
    "traj_medoids",
    "traj_hcpc",
    "traj_ward_loss",
    "traj_sampled",
    "heatmap_rows",
    "cells_reread",
    "observed_timepoints",
    "clone_assign_aa",
    "receptor_columns_dropped",
    "treatment_labels",
    "label_cells",
    "rank_by_column",
    "cumsum_labels",
    "area_normalized",
    "area_by_response",
    "cycling_pct_treatment",
    "ctype_log2fc",
    "ctype_treatment",
    "ctype_treatment_patient",
    "ctype_topn",
)
CHOSEN = sorted(SQL) if os.environ.get("TRAJSPARK_ALL_QUERIES") else CORE


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, sql, name):
    got = QUERIES[name](spark, SF_DIR)
    result = sql.execute(SQL[name])
    columns = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    assert {f.name: TYPES[f.dataType.simpleString()] for f in got.schema} == types
    assert canonical(got.columns, got.collect()) == canonical(columns, result.fetchall())


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


def test_names_agree():
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["patient_alias", "treatment", "clone_id", "timepoint", "n", "perc", "k"]
    assert df.count() > 0


# one query per kind of plan
PLANS = ("clone_assign", "clone_perc", "dynamic_clones", "sample_qc", "traj_hclust", "corr_pearson", "area_base", "ctype_treatment")


@pytest.mark.parametrize("name", PLANS)
def test_plan(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert node not in plan


def test_cells_are_scanned_with_the_columns_needed(spark):
    from trajspark.plans import catalog

    plan = catalog.base_cells(spark, SF_DIR).select("clone_id").distinct()._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "lineitem" in line and "FileScan" in line)
    assert "l_quantity" not in scan and "l_orderkey" not in scan
