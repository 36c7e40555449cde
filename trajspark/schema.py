"""Column names, source schemas and the checks made while a plan is built."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column names of the cell table and of the results.
BARCODE = "barcode"
PATIENT = "patient_alias"
TIMEPOINT_LABEL = "timepoint_label"
TIMEPOINT = "timepoint"
TREATMENT = "treatment"
RESPONSE = "response"
TRA_NT = "TRA_chain_cdr3_nt"
TRB_NT = "TRB_chain_cdr3_nt"
TRB_AA = "TRB_chain_cdr3"
CELL_TYPE = "metaclusters_exh"
MKI67 = "mki67"
CLONE = "clone_id"
K = "k"

# How trajectories are named.
OTHER = "Other"
TRAJ_PREFIX = "Traj "

# The published run's timepoints (weeks), QC floor and thresholds.
TIMEPOINTS = (0, 3, 6, 9)
SAMPLE_FLOOR = 380
MIN_FC = 2.0
MIN_C = 0.25
MIN_CELLS = 5
N_CLUSTERS = 6
OUTLIER_MIN_PERC = 0.25
OUTLIER_SDS = 2.5
CYCLING_CAP = 10.0
LABEL_CUTOFF = 0.5
REGULARIZATION = 2.0

# Sample labels and the week each one stands for.
TIMEPOINT_WEEKS = {"Baseline": 0, **{f"Follow Up {i}": 3 * i for i in range(1, 7)}}

CELLS_SCHEMA = T.StructType(
    [
        T.StructField(BARCODE, T.StringType(), False),
        T.StructField(PATIENT, T.StringType(), False),
        T.StructField(TIMEPOINT_LABEL, T.StringType(), True),
        T.StructField(TREATMENT, T.StringType(), True),
        T.StructField(RESPONSE, T.StringType(), True),
        T.StructField(TRA_NT, T.StringType(), True),
        T.StructField(TRB_NT, T.StringType(), True),
        T.StructField(TRB_AA, T.StringType(), True),
        T.StructField(CELL_TYPE, T.StringType(), True),
    ]
)

EXPRESSION_SCHEMA = T.StructType(
    [
        T.StructField(BARCODE, T.StringType(), False),
        T.StructField("gene", T.StringType(), False),
        T.StructField("count", T.IntegerType(), False),
    ]
)

ALLOWLIST_SCHEMA = T.StructType(
    [
        T.StructField(PATIENT, T.StringType(), False),
        T.StructField(TRB_AA, T.StringType(), False),
    ]
)

STATS_SCHEMA = T.StructType(
    [
        T.StructField(PATIENT, T.StringType(), False),
        T.StructField(TREATMENT, T.StringType(), True),
        T.StructField(CLONE, T.StringType(), False),
        T.StructField(TIMEPOINT, T.IntegerType(), False),
        T.StructField("n", T.LongType(), True),
        T.StructField("n_tcells_tp", T.LongType(), True),
        T.StructField("perc", T.DoubleType(), True),
        T.StructField("n_max", T.LongType(), True),
        T.StructField("n_min", T.LongType(), True),
        T.StructField("range", T.LongType(), True),
        T.StructField("range_perc", T.DoubleType(), True),
        T.StructField("delta_fc", T.DoubleType(), True),
        T.StructField("delta_c", T.DoubleType(), True),
        T.StructField("avg_freq", T.DoubleType(), True),
        T.StructField("min_perc", T.DoubleType(), True),
        T.StructField("max_perc", T.DoubleType(), True),
        T.StructField("timepoint_max", T.IntegerType(), True),
        T.StructField("timepoint_min", T.IntegerType(), True),
        T.StructField("delta_fc_max", T.DoubleType(), True),
        T.StructField("delta_fc_min", T.DoubleType(), True),
        T.StructField("delta_c_max", T.DoubleType(), True),
        T.StructField("delta_c_min", T.DoubleType(), True),
    ]
)


def require(df: DataFrame, *columns: str) -> None:
    """Raise ``ValueError`` naming every column that ``df`` lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s): {', '.join(missing)}")


def present(df: DataFrame, columns: Iterable[str]) -> list[str]:
    """Those of ``columns`` that ``df`` has, in the order given."""
    return [c for c in columns if c in df.columns]


def drop_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Drop columns where present."""
    return df.drop(*columns)


def rename_timepoint(df: DataFrame, column: str) -> DataFrame:
    """Give a differently named timepoint column its standard name."""
    require(df, column)
    if column == TIMEPOINT:
        return df
    return df.drop(TIMEPOINT).withColumnRenamed(column, TIMEPOINT)
