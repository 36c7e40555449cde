"""Operators that split large groups give the same as the plain forms."""

import hashlib
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trajspark.operators import clones, joins, ordering


@pytest.fixture(scope="module")
def fact(spark):
    rng = random.Random(4)
    keys = ["hot"] * 300 + ["warm"] * 60 + [None] * 40 + [f"k{i}" for i in range(200)]
    rng.shuffle(keys)
    return spark.createDataFrame([(k, i, rng.randint(0, 9)) for i, k in enumerate(keys)], "k string, id int, v int")


@pytest.fixture(scope="module")
def lookup(spark):
    return spark.createDataFrame(
        [("hot", 1), ("warm", 2), ("absent", 3)] + [(f"k{i}", i) for i in range(0, 200, 2)], "k string, w int"
    )


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_split_join_equals_broadcast(fact, lookup, how):
    plain = sorted(fact.join(lookup, ["k"], how).collect(), key=str)
    small = joins.lookup_join(fact, lookup, ["k"], how)
    split = joins.lookup_join(fact, lookup, ["k"], how, max_rows=10, hot_rows=50)
    assert sorted(small.collect(), key=str) == plain
    assert sorted(split.collect(), key=str) == plain


@pytest.mark.parametrize("partition", [["k"], []])
def test_ordered_rank_equals_window(fact, partition):
    got = ordering.ordered_rank(fact, partition, ["v", "id"], running={"s": "v"})
    w = Window.partitionBy(*partition).orderBy("v", "id")
    want = fact.withColumn("rank", F.row_number().over(w).cast("bigint")).withColumn(
        "s", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    assert got.columns == want.columns
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


@pytest.mark.parametrize("largest", [3, 100_000])
@pytest.mark.parametrize("size", [1, 7, 150, None])
def test_sample_equals_window(fact, size, largest):
    cells = fact.select("k", F.col("id").cast("string").alias("barcode"))
    got = ordering.take_per_group(cells.repartition(6), ["k"], size, seed=5, largest=largest)
    place = F.row_number().over(Window.partitionBy("k").orderBy(ordering.sample_order(5)))
    smallest = min(r["count"] for r in cells.groupBy("k").count().collect())
    want = cells.withColumn("p", place).filter(F.col("p") <= (size or smallest)).drop("p")
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)


def test_sample_with_repeated_barcodes(spark):
    rows = [("a", "b1", i) for i in range(5)] + [("a", "b2", 9), ("b", "b1", 1), ("b", "b1", 1), ("b", "b1", 1)]
    cells = spark.createDataFrame(rows, "k string, barcode string, v int")
    for size, largest in ((1, 9), (2, 9), (3, 9), (2, 1)):
        got = ordering.take_per_group(cells.repartition(3), ["k"], size, seed=5, largest=largest)
        counts = {r["k"]: r["count"] for r in got.groupBy("k").count().collect()}
        assert counts == {"a": size, "b": size}


def test_a_sample_scans_its_table_once(spark, fact):
    cells = fact.select("k", F.col("id").cast("string").alias("barcode"))
    got = ordering.take_per_group(cells, ["k"], 7, seed=5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("WindowGroupLimit") >= 4


def test_one_barcode_in_most_rows(spark):
    rows = [("a", "b1", i % 50) for i in range(4000)] + [("a", f"c{i}", i) for i in range(300)]
    cells = spark.createDataFrame(rows, "k string, barcode string, v int").repartition(5)
    for size in (5, 1000, 4100):
        kept = ordering.take_per_group(cells, ["k"], size, seed=5)
        again = ordering.take_per_group(cells.repartition(2), ["k"], size, seed=5, largest=3)
        assert kept.count() == size
        assert sorted(kept.collect()) == sorted(again.collect())


@pytest.mark.parametrize("largest", [3, 100_000])
def test_a_sample_as_large_as_the_smallest_group_moves_few_rows(spark, monkeypatch, largest):
    ranked, plain = [], ordering.first_rows
    monkeypatch.setattr(ordering, "first_rows", lambda keyed, *a: ranked.append(keyed) or plain(keyed, *a))
    rows = [(k, None if i % 900 == 0 else f"{k}{i}", i) for k, n in (("a", 6000), ("b", 4000), (None, 3000)) for i in range(n)]
    cells = spark.createDataFrame(rows, "k string, barcode string, v int").repartition(5)
    got = ordering.take_per_group(cells, ["k"], None, seed=5, largest=largest)
    order = Window.partitionBy("k").orderBy(ordering.sample_order(5), F.xxhash64(*cells.columns))
    want = cells.withColumn("p", F.row_number().over(order)).filter("p <= 3000").drop("p")
    assert sorted(got.collect(), key=str) == sorted(want.collect(), key=str)
    assert sum(keyed.count() for keyed in ranked) < 100


def test_cuts_are_read_by_column_and_removed(spark):
    from pathlib import Path

    from trajspark import session

    session.remove_cuts(spark)
    cut = session.materialize(spark.range(100).selectExpr("id", "id * 2 as twice"))
    scan = cut.select("twice")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in scan and "id#" not in scan
    folder = Path(cut.inputFiles()[0].removeprefix("file://")).parent
    assert folder.exists() and session.remove_cuts(spark) == 1 and not folder.exists()
    assert session.remove_cuts(spark) == 0


def test_a_barcode_with_a_million_clones(spark):
    hot = spark.range(1_000_000).selectExpr("'hot' as barcode", "concat('P:', lpad(id, 7, '0')) as clone_id")
    few = spark.createDataFrame([("x", "P:2"), ("x", "P:1"), ("x", "P:2"), ("y", None), ("z", "P:3")], "barcode string, clone_id string")
    joint = clones.combined_clones(hot.union(hot.limit(1000)).union(few))
    rows = {r.barcode: (r.n, r.first, r.last) for r in joint.selectExpr(
        "barcode", "size(split(clone_id, '[|]')) as n", "substring_index(clone_id, '|', 1) as first", "substring_index(clone_id, '|', -1) as last"
    ).collect()}
    assert rows == {"hot": (1_000_000, "P:0000000", "P:0999999"), "x": (2, "P:1", "P:2"), "z": (1, "P:3", "P:3")}
    text = joint.filter("barcode = 'hot'").select(F.sha2("clone_id", 256).alias("h")).first().h
    want = "|".join(f"P:{i:07d}" for i in range(1_000_000))
    assert text == hashlib.sha256(want.encode()).hexdigest()


def test_combined_keys_too_long_to_broadcast(spark, monkeypatch):
    rows = [("b1", "P", "a", "b"), ("b1", "P", "c", "d"), ("b1", "P", None, "d"), ("b2", "P", "a", "b"), (None, "P", "a", "b")]
    cells = spark.createDataFrame(rows, "barcode string, patient_alias string, TRA_chain_cdr3_nt string, TRB_chain_cdr3_nt string")
    plain = sorted(clones.assign_clones(cells).collect(), key=str)
    monkeypatch.setattr(clones, "BROADCAST_BYTES", 0)
    assert sorted(clones.assign_clones(cells).collect(), key=str) == plain
    assert [r.clone_id for r in plain if r.barcode == "b1"] == ["P:a:b|P:c:d"] * 3
