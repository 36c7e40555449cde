"""Cell, expression and allow-list tables derived from the order tables used for testing.

A shipped line is a cell, the supplier's nation its patient, the region the treatment,
the ship year the timepoint, and brand and type of the part the two receptor chains.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.schema import (
    BARCODE,
    CELL_TYPE,
    PATIENT,
    RESPONSE,
    TIMEPOINT_LABEL,
    TRA_NT,
    TRB_AA,
    TRB_NT,
    TREATMENT,
)

FIRST_YEAR = 1995
TREATMENTS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


# the columns that are read; a declared schema saves a job per table
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_brand string, p_type string, p_size int",
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_discount double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _barcode(full: bool = True):
    parts = ["l_orderkey", "l_linenumber"]
    if full:
        parts += ["l_partkey", "l_suppkey"]
    columns = [F.col(p).cast("string") for p in parts]
    if full:
        columns.append(F.col("l_quantity").cast("int").cast("string"))
    return F.concat_ws("-", *columns)


def raw_cells(spark: SparkSession, sf_dir: str, shared_barcodes: bool = False) -> DataFrame:
    """All cells with their sample label. ``shared_barcodes`` leaves barcodes that several cells share."""
    year = F.year("l_shipdate")
    response = F.element_at(
        F.array(*[F.lit(r).cast("string") for r in ("CR", "PR", "SD", "PD", None)]), F.col("n_nationkey") % 5 + 1
    )
    label = F.when(year == FIRST_YEAR, F.lit("Baseline")).otherwise(
        F.concat(F.lit("Follow Up "), (year - FIRST_YEAR).cast("string"))
    )
    nations = _table(spark, sf_dir, "nation").join(
        _table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    return (
        _table(spark, sf_dir, "lineitem")
        .join(_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .join(_table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            _barcode(not shared_barcodes).alias(BARCODE),
            F.col("n_name").alias(PATIENT),
            label.alias(TIMEPOINT_LABEL),
            F.col("r_name").alias(TREATMENT),
            response.alias(RESPONSE),
            F.nullif("p_brand", F.lit("Brand#13")).alias(TRA_NT),
            F.nullif("p_type", F.lit("PROMO")).alias(TRB_NT),
            F.col("p_brand").alias(TRB_AA),
            F.concat("l_returnflag", "l_linestatus").alias(CELL_TYPE),
            F.greatest(F.col("l_quantity").cast("int") - 47, F.lit(0)).alias("mki67"),
            (F.col("l_discount") >= 0.09).alias("flagged"),
        )
    )


def expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long, sparse expression table with two genes."""
    quantity = F.col("l_quantity").cast("int")
    rows = F.inline(
        F.array(
            F.struct(F.lit("MKI67").alias("gene"), F.greatest(quantity - 47, F.lit(0)).alias("count")),
            F.struct(F.lit("CD8A").alias("gene"), (quantity % 7).alias("count")),
        )
    )
    lines = _table(spark, sf_dir, "lineitem").select(_barcode().alias(BARCODE), rows)
    return lines.filter(F.col("count") > 0)


def allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patient and TRB pairs: every nation with the brands of large parts."""
    brands = _table(spark, sf_dir, "part").filter(F.col("p_size") >= 45)
    pairs = (
        _table(spark, sf_dir, "lineitem")
        .join(brands, F.col("l_partkey") == F.col("p_partkey"))
        .join(_table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    return pairs.select(F.col("n_name").alias(PATIENT), F.col("p_brand").alias(TRB_AA)).distinct()
