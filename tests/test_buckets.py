"""Tables of buckets: what an update leaves alone keeps its files, and the result is that of a whole rewrite."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkloom.sources.buckets import BUCKET, Buckets


def files(path):
    out = {}
    for p in Path(path).rglob("part-*.parquet"):
        out.setdefault(p.parent.name, set()).add(p.name)
    return out


@pytest.fixture
def store(spark, tmp_path):
    rows = [(i // 3, i, f"v{i}") for i in range(300)] + [(None, 1, "null key")]
    return Buckets(spark, str(tmp_path / "t"), "k", 16).create(spark.createDataFrame(rows, "k long, i int, v string"))


def test_an_upsert_writes_touched_buckets_only(spark, store):
    before, rows = files(store.path), store.read().count()
    new = spark.createDataFrame([(5, 0, "new"), (5, 1, "new"), (1000, 0, "new")], "k long, i int, v string")
    touched = {f"{BUCKET}={r[0]}" for r in store._hashed(new).select(BUCKET).distinct().collect()}
    assert store.upsert(new) == {"added": 1, "replaced": 1, "rows": 3, "removed": 3}
    after = files(store.path)
    assert all(after[b] == before[b] for b in before if b not in touched) and all(after[b] != before.get(b) for b in touched) and len(touched) <= 2
    assert store.read().count() == rows
    got = sorted(tuple(r) for r in store.lookup(new).collect())
    assert got == [(5, 0, "new"), (5, 1, "new"), (1000, 0, "new")]
    assert store.upsert(new)["replaced"] == 2 and store.read().count() == rows  # run again


def test_deletes_empty_buckets_too(spark, store):
    keys = spark.range(100).withColumnRenamed("id", "k")
    assert store.delete(keys.where("k < 50")) == {"removed": 150} and store.read().count() == 151
    assert store.delete(keys) == {"removed": 150}
    assert [r.v for r in store.read().collect()] == ["null key"]
    assert store.delete(keys) == {"removed": 0}


def test_another_table_isnt_overwritten(spark, store):
    with pytest.raises(Exception, match="already exists"):
        store.create(spark.range(3).select(F.col("id").alias("k")))
