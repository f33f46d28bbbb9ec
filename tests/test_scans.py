"""Scans by ranges against ordinary windows: one hot group, null groups and values, tasks that don't grow with a group."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import ranking, scans


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    groups = ["hot"] * 900 + [None] * 300 + [f"g{i % 40}" for i in range(200)]
    data = [(g, rng.randrange(400) if rng.random() > 0.02 else None, i, rng.choice([None, 1, 2, 7]), rng.choice([None, "", "x", "y"])) for i, g in enumerate(groups)]
    return spark.createDataFrame(data, "g string, t int, id int, v int, s string").repartition(4).cache()


def outs():
    return {"total": ("sum", F.col("v")), "before": ("lag", F.col("s")), "last": ("last", F.col("v")), "seen": ("sum", F.lit(1))}


@pytest.mark.parametrize("most", [40, 500, 10**6])
def test_scans_equal_windows(rows, most):
    got, want = scans.scan(rows, ["g"], ["t", "id"], outs(), most), scans.scan_groups(rows, ["g"], ["t", "id"], outs())
    assert got.columns == want.columns and got.schema == want.schema
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_no_task_takes_a_hot_group(spark, rows):
    ranged = scans._over_ranges(rows.where("g = 'hot'"), ["g"], ["t", "id"], outs(), 10)
    sizes = ranged.groupBy(F.spark_partition_id()).count()
    assert sizes.agg(F.sum("count")).first()[0] == 900
    w = Window.partitionBy("g").orderBy("t", "id")
    assert ranged.withColumn("n", F.row_number().over(w)).where("n != seen").count() == 0


def test_islands_budgets_and_filling_by_ranges(rows):
    for of in (
        lambda most: ranking.islands(rows, ["g"], ["t", "id"], F.col("v") > 1, most=most),
        lambda most: ranking.within_budget(rows, ["g"], ["t", "id"], F.coalesce("v", F.lit(0)), 300, most),
        lambda most: ranking.filled_down(rows, ["g"], ["t", "id"], ["s"], most),
        lambda most: ranking.running_total(rows, ["g"], ["t", "id"], F.col("v"), most=most),
    ):
        assert sorted(map(tuple, of(50).collect()), key=repr) == sorted(map(tuple, of(None).collect()), key=repr)


def test_no_rows_and_unknown_kinds(rows):
    assert scans.scan(rows.limit(0), ["g"], ["id"], outs(), 1).collect() == []
    with pytest.raises(ValueError):
        scans.scan(rows, ["g"], ["id"], {"x": ("mean", F.col("v"))})
