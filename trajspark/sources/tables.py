"""Reading and writing: cell, expression and allow-list tables, statistics as CSV, stage results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.schema import ALLOWLIST_SCHEMA, BARCODE, CELLS_SCHEMA, EXPRESSION_SCHEMA, MKI67, STATS_SCHEMA, require

GENE = "MKI67"


def read_table(spark: SparkSession, path: str, schema: T.StructType, format: str = "parquet") -> DataFrame:
    """A table with a declared schema, from Parquet or from CSV with a header."""
    reader = spark.read.schema(schema)
    if format == "csv":
        return reader.option("header", True).csv(path)
    if format == "parquet":
        return reader.parquet(path)
    raise ValueError("format must be 'parquet' or 'csv'")


def read_cells(spark: SparkSession, path: str, format: str = "parquet", extra: T.StructType | None = None) -> DataFrame:
    """The cell table; ``extra`` declares further columns, such as flags."""
    schema = T.StructType(CELLS_SCHEMA.fields + (extra.fields if extra else []))
    return read_table(spark, path, schema, format)


def read_expression(spark: SparkSession, path: str, gene: str = GENE, format: str = "parquet") -> DataFrame:
    """Counts of one gene; the filter and the two columns reach the Parquet scan."""
    return one_gene(read_table(spark, path, EXPRESSION_SCHEMA, format), gene)


def read_allowlist(spark: SparkSession, path: str, format: str = "csv") -> DataFrame:
    return read_table(spark, path, ALLOWLIST_SCHEMA, format)


def one_gene(expression: DataFrame, gene: str = GENE) -> DataFrame:
    """Barcode and count of one gene of a long expression table."""
    require(expression, BARCODE, "gene", "count")
    return expression.filter(F.col("gene") == gene).select(BARCODE, "count")


def with_gene_count(cells: DataFrame, expression: DataFrame, gene: str = GENE, column: str = MKI67) -> DataFrame:
    """Add a gene's count to every cell, 0 where the table has no row. Barcodes are unique."""
    counts = one_gene(expression, gene).withColumnRenamed("count", "_count")
    joined = cells.drop(column).join(counts, BARCODE, "left")
    return joined.withColumn(column, F.coalesce("_count", F.lit(0))).drop("_count")


def dynamics_file_name(n_timepoints: int, method: str) -> str:
    """Fixed format: the name of the file with the clone dynamics."""
    return f"fold change vs abs change_{n_timepoints}_{method}.csv"


def write_csv(df: DataFrame, path: str) -> None:
    """Write a table as CSV with a header, in as many part files as it has partitions."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_dynamics_csv(dynamics: DataFrame, folder: str, method: str, n_timepoints: int | None = None) -> str:
    """Write the clone dynamics under their usual name; returns the path.

    Without ``n_timepoints`` the timepoints in the table are counted first.
    """
    if n_timepoints is None:
        n_timepoints = dynamics.select("timepoint").distinct().count()
    path = f"{folder.rstrip('/')}/{dynamics_file_name(n_timepoints, method)}"
    write_csv(dynamics, path)
    return path


def read_stats_csv(spark: SparkSession, path: str, like: T.StructType = STATS_SCHEMA) -> DataFrame:
    """Read statistics back with declared types; ``Infinity`` stays infinite."""
    return (
        spark.read.schema(like)
        .option("header", True)
        .option("enforceSchema", False)
        .option("positiveInf", "Infinity")
        .option("negativeInf", "-Infinity")
        .csv(path)
    )


def save_stage(df: DataFrame, path: str) -> DataFrame:
    """Write a stage's result as Parquet and go on from the written table."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
