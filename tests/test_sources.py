"""Sources and sinks."""

import pytest
from pyspark.sql import functions as F

from trajspark.schema import ALLOWLIST_SCHEMA, CELLS_SCHEMA
from trajspark.session import shared_path
from trajspark.sources import tables


def test_expression_lookup_and_pushdown(spark, tmp_path):
    rows = [("a", "MKI67", 3), ("a", "CD8A", 9), ("b", "CD8A", 1)]
    path = str(tmp_path / "expression")
    spark.createDataFrame(rows, "barcode string, gene string, count int").write.parquet(path)
    counts = tables.read_expression(spark, path)
    assert [tuple(r) for r in counts.collect()] == [("a", 3)]
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gene,MKI67)" in plan
    cells = spark.createDataFrame([("a",), ("b",), ("c",)], "barcode string")
    long = spark.read.parquet(path)
    got = {r.barcode: r.mki67 for r in tables.with_gene_count(cells, long).collect()}
    assert got == {"a": 3, "b": 0, "c": 0}
    cd8 = tables.with_gene_count(cells, long, "CD8A", "cd8a")
    assert {r.barcode: r.cd8a for r in cd8.collect()} == {"a": 9, "b": 1, "c": 0}


@pytest.mark.parametrize("format", ["parquet", "csv"])
def test_cell_table(spark, tmp_path, format):
    rows = [("a", "P", "Baseline", "A", None, "AA", "CC", "S", "CM")]
    df = spark.createDataFrame(rows, CELLS_SCHEMA).withColumn("flag", F.lit(True))
    path = str(tmp_path / format)
    df.write.option("header", True).format(format).save(path)
    from pyspark.sql import types as T

    extra = T.StructType([T.StructField("flag", T.BooleanType())])
    back = tables.read_cells(spark, path, format, extra)
    assert back.columns == df.columns and back.collect() == df.collect()
    assert tables.read_cells(spark, path, format).columns == CELLS_SCHEMA.names
    with pytest.raises(ValueError):
        tables.read_cells(spark, path, "rds")


def test_allowlist(spark, tmp_path):
    path = str(tmp_path / "allowed")
    tables.write_csv(spark.createDataFrame([("P", "S")], ALLOWLIST_SCHEMA), path)
    assert [tuple(r) for r in tables.read_allowlist(spark, path).collect()] == [("P", "S")]


def test_infinity_and_null_survive_csv(spark, tmp_path):
    df = spark.createDataFrame([(0, float("inf"), None), (3, 1.5, 2.0)], "timepoint int, delta_fc double, perc double")
    path = tables.write_dynamics_csv(df, str(tmp_path), "hclust")
    assert path.endswith("/fold change vs abs change_2_hclust.csv")
    assert sorted(tables.read_stats_csv(spark, path, df.schema).collect()) == sorted(df.collect())


def test_stage_result_cuts_the_plan(spark):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    kept = tables.save_stage(df, shared_path(spark, "stage"))
    assert sorted(kept.collect()) == sorted(df.collect())
    assert "Range" not in kept._jdf.queryExecution().executedPlan().toString()
