"""Streams over several batches against their batch results: repeated keys, known keys, late and unordered rows, open runs, metrics."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkloom.streaming import ingest, progress, runs

T0 = datetime(2024, 1, 1)


@pytest.fixture
def stream_of(spark, tmp_path):
    """A stream that takes the given batches one after the other."""

    def make(batches, schema):
        path = tmp_path / f"in{random.random()}"
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{i:03d}")
        import os
        import time

        files = sorted(p for p in path.rglob("part-*.parquet"))
        for i, f in enumerate(files):  # in the order of their times
            os.utime(f, (time.time() - 1000 + i, time.time() - 1000 + i))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path))

    return make


def test_ingest_counts_by_batch_and_keeps_the_first(spark, stream_of):
    batches = [[("a", 1), ("a", 2), ("b", 3)], [("b", 4), ("c", 5), ("k", 6)], [("a", 7), ("c", 8)], [(None, 9), (None, 10)]]
    known = spark.createDataFrame([("k",), ("z",)], "key string")
    table, counts = ingest.ingest(stream_of(batches, "id string, n int"), F.col("id"), known)
    assert [tuple(r) for r in counts.orderBy("batch").collect()] == [(0, 3, 2, 1), (1, 3, 1, 2), (2, 2, 0, 2), (3, 2, 1, 1)]
    got = {r.key: (r.n, r.batch) for r in table.collect()}
    assert set(got) == {"a", "b", "c", None} and got["a"][0] in (1, 2) and got["b"] == (3, 0) and got["c"] == (5, 1)


def test_keys_are_forgotten_after_the_watermark(stream_of):
    at = lambda h: T0 + timedelta(hours=h)
    batches = [[("a", at(0))], [("a", at(1)), ("b", at(50))], [("x", at(50))], [("a", at(51)), ("a", at(2))]]
    _, counts = ingest.ingest(stream_of(batches, "id string, t timestamp"), F.col("id"), ts="t", within="10 hours")
    assert [r.added for r in counts.orderBy("batch").collect()] == [1, 1, 1, 1]  # the last a is new again, the late one is skipped


def plain(events, limit, now):
    """By definition: a start is done if its key has a finish within the limit, stuck if the watermark passed the limit, else untold."""
    out = []
    for key, at, what in events:
        if what == "s":
            if any(k == key and w == "f" and timedelta(0) <= t - at <= limit for k, t, w in events):
                out.append((key, at, "done"))
            elif at + limit < now:
                out.append((key, at, "stuck"))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_equal_their_definition_over_unordered_batches(stream_of, seed):
    rng = random.Random(seed)
    events = [(rng.choice("abcd"), T0 + timedelta(minutes=rng.randrange(6000)), rng.choice("ssfx")) for _ in range(160)]
    events += [("a", T0, "s"), ("a", T0, "s"), ("a", T0, "f"), ("lone", T0 + timedelta(minutes=5), "s"), ("end", T0 + timedelta(minutes=7000), "s")]
    # Unordered within and between batches by up to 20 hours; the watermark is 40 hours behind.
    events.sort(key=lambda e: e[1] + timedelta(minutes=rng.randrange(1200)))
    batches = [events[i : i + 30] for i in range(0, len(events), 30)]
    found = runs.stuck_runs(stream_of(batches, "k string, t timestamp, w string"), "k", "t", F.col("w") == "s", F.col("w") == "f", 90, "40 hours")
    got = sorted((r.key, T0 + timedelta(microseconds=r.started - 1704067200 * 10**6), r.status) for r in ingest.appended(found).collect())
    now = max(t for _, t, _ in events) - timedelta(hours=40)
    assert got == plain(events, timedelta(minutes=90), now) and len({s for *_, s in got}) == 2


def test_progress_tells_each_batch(spark, stream_of):
    stream = stream_of([[(1, 2.0), (2, 3.0)], [(3, 5.0)]], "id int, v double")
    found = progress.run(progress.observed(stream, "m", F.count("*").alias("n"), F.sum("v").alias("v")))
    got = [tuple(r) for r in progress.table(spark, found["m"], "n long, v double").collect() if r["n"]]
    assert got == [(0, 2, 5.0), (1, 1, 5.0)]
