"""The stored indexes against plain search: BM25 over segments, cosine over cells; odd rows, ties, empty tables."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import cells, clusters, lexical, retrieval, segments, vectors

PATTERN = "[a-z0-9]+"


def hits(df, digits=6):
    return sorted((r["q"], r["rank"], r["id"], round(r["score"], digits)) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 200]))) for _ in range(900)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(901, None), (902, ""), (903, texts[5]), (904, texts[5]), (905, "x " * 5000)]
    asked = [(i, " ".join(rng.choices(words, k=n))) for i, n in enumerate([1, 2, 3, 8, 30, 300])] + [(90, None), (91, ""), (92, "w1 w1 w1 w2"), (93, "absent zzz")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3).cache()
    return docs, spark.createDataFrame(asked, "q long, text string").cache()


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize("k", [1, 7, 2000])
def test_segments_equal_all_pairs(corpus, plain, k):
    docs, asked = corpus
    filled = docs.na.fill("", ["text"])
    pairs = (lexical.bm25_plain if plain else lexical.bm25)(filled, asked.na.fill("", ["text"]), "id", "q", pattern=PATTERN)
    index = segments.build(docs, "id", pattern=PATTERN, rows=200)
    assert hits(index.search(asked, "q", "id", k, plain=plain, block=4)) == hits(lexical.best(pairs, "q", "id", k))


def test_an_index_is_read_again_and_has_the_statistics(spark, corpus, tmp_path):
    docs, asked = corpus
    segments.build(docs, "id", pattern=PATTERN, path=str(tmp_path / "index"), words=500)
    index = segments.read(spark, str(tmp_path / "index"), PATTERN)
    df = lexical.postings(docs, "id", "text", PATTERN).groupBy("term").agg(F.count("*").alias("df"))
    assert sorted(map(tuple, index.frequencies().collect())) == sorted(map(tuple, df.collect()))
    got = index.corpus().first()
    texts = [r.text or "" for r in docs.collect()]
    assert got["n"] == len(texts) and got["avgchars"] == pytest.approx(np.mean([len(t) for t in texts]))
    assert got["avgdl"] == pytest.approx(np.mean([len([w for w in t.split() if len(w) > 1]) for t in texts]))
    assert hits(index.search(asked, "q", "id", 3)) == hits(segments.build(docs, "id", pattern=PATTERN).search(asked, "q", "id", 3))


def test_blocks_are_passed_over(spark):
    """One document is far better than all others; blocks of common terms can't reach it."""
    lists = [["rare", "common"]] + [["common"] + ["pad"] * (20 + i % 50) for i in range(1000)]
    part = segments.segment(pa.array(lists), np.full(len(lists), 10))
    row = {c: np.asarray(v) for c, v in part.items() if c != "terms"} | {"terms": part["terms"].to_pylist(), "keys": list(range(len(lists)))}
    found = segments.Best(1)
    scorer = segments.Scorer(40.0)
    assert segments.search_segment(row, [{"rare": 5.0, "common": 0.1}], scorer, False, found) == (16, 0)
    again = segments.search_segment(row, [{"rare": 5.0, "common": 0.1}], scorer, False, found)
    assert again == (16, 15) and found.found[0][0][2] == 0


def test_string_keys_ties_and_no_rows(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one two"), ("c", "two")], "id string, text string")
    asked = spark.createDataFrame([("x", "one")], "q string, text string")
    assert [r["id"] for r in segments.build(docs, "id").search(asked, "q", "id", 2).orderBy("rank").collect()] == [None, "a"]
    assert segments.build(docs.limit(0), "id").search(asked, "q", "id", 2).collect() == []
    assert segments.build(docs, "id").search(asked.limit(0), "q", "id", 2).collect() == []


@pytest.mark.parametrize("strategy", ["hybrid", "advanced"])
def test_staged_retrieval_equals_its_steps_over_all_pairs(corpus, strategy):
    docs, asked = (vectors.hashed_vectors(x.na.fill("", ["text"]), "text", 16) for x in corpus)
    plan = retrieval.default_plan(strategy).override(candidates=40, fused=30, results=8)
    near = vectors.top_k(docs, asked, "id", "vector", "q", "vector", 40)
    words = lexical.best(lexical.bm25(docs, asked, "id", "q"), "q", "id", 40)
    want = retrieval.hybrid(near, words, "q", "id", plan.weights, plan.fused)
    if strategy == "advanced":
        pairs = want.join(docs.select("id", F.col("text").alias("d")), "id").join(asked.select("q", F.col("text").alias("a")), "q")
        want = lexical.keyword_rerank(pairs, "a", "d", "q", "id", 8)
    got = retrieval.retrieve(docs, asked, plan, "id", "q")
    assert hits(got) == hits(want.where("rank <= 8"))
    shared = segments.build(docs, "id")
    assert hits(retrieval.retrieve(docs, asked, plan, "id", "q", index=shared)) == hits(got)


# Cells


def clustered(spark, n=1500, dimension=16, groups=12, seed=3):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dimension)) * 4
    sizes = [n // 2] + [n // 2 // (groups - 1)] * (groups - 1)  # one group has half of all rows
    x = np.concatenate([m + rng.normal(size=(s, dimension)) for m, s in zip(middles, sizes, strict=True)])
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(3).cache()


def test_cells_find_neighbours_and_read_few_rows(spark):
    df = clustered(spark)
    index = cells.CellIndex(df, "id", "v", parts=8)
    asked = df.where("id % 25 = 0").select(F.col("id").alias("q"), F.col("v").alias("a"))
    got = index.report(asked, "q", "a", 10).first()
    assert got["recall"] >= 0.9 and got["share_read"] <= 0.1 and got["rows"] == df.count() and got["exact"] == asked.count() * 10
    sizes = [r["n"] for r in index.codes.groupBy("cell").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == df.count() and max(sizes) <= 6 * df.count() / len(sizes)


def test_heavy_cells_are_split_again(spark):
    df = clustered(spark)
    few = cells.CellIndex(df, "id", "v", cells=4, heavy=100.0)
    split = cells.CellIndex(df, "id", "v", cells=4, heavy=1.2)
    largest = [max(r["n"] for r in i.codes.groupBy("cell").agg(F.count("*").alias("n")).collect()) for i in (few, split)]
    assert len(split.books.centres) > len(few.books.centres) == 4 and largest[1] < largest[0]


def test_all_cells_and_all_rows_rescored_are_the_exact_search(spark):
    df = clustered(spark, 300)
    asked = df.where("id % 50 = 0").select(F.col("id").alias("q"), F.col("v").alias("a"))
    index = cells.CellIndex(df, "id", "v")
    got = index.search(asked, "q", "a", 5, rescored=df.count(), probe=1000, block=4)
    assert hits(got, 5) == hits(vectors.top_k(df, asked, "id", "v", "q", "a", 5), 5)


def test_odd_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 2.0])], "id long, v array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, None)], "q long, a array<float>")
    assert [r["id"] for r in cells.CellIndex(df, "id", "v").search(asked, "q", "a", 2).orderBy("rank").collect()] == [3, 3]
    none = cells.CellIndex(df.limit(0), "id", "v")
    assert none.search(asked, "q", "a", 2).collect() == [] and none.report(asked, "q", "a", 2).first()["exact"] == 0


def test_files_of_an_index_have_row_groups_of_few_segments(spark, tmp_path):
    """Spark's reader decodes a row group at a time; one with all segments of a file filled an executor."""
    docs = spark.range(4000).select("id", F.concat_ws(" ", F.lit("word"), F.col("id").cast("string")).alias("text")).coalesce(1)
    index = segments.build(docs, "id", pattern=PATTERN, path=str(tmp_path / "index"), rows=100)
    groups = [pq.ParquetFile(f).metadata for f in (tmp_path / "index").glob("*.parquet")]
    sizes = [m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)]
    assert sum(sizes) == 40 and max(sizes) <= segments.ROW_GROUP
    assert hits(index.search(spark.createDataFrame([(1, "3999")], "q long, text string"), "q", "id", 3))[0][2] == 3999


@pytest.mark.parametrize("scores", [1, 40, 1 << 19])
def test_a_task_keeps_the_nearest_of_each_query_only(monkeypatch, scores):
    """Batches went on with k rows for each query and batch, and all scores of a batch were held at once."""
    monkeypatch.setattr(vectors, "SCORES", scores)
    rng = np.random.default_rng(2)
    keys, x, asked = rng.permutation(500), rng.integers(-2, 3, (500, 4)).astype(np.float64), rng.integers(-2, 3, (7, 4)).astype(np.float64)

    class Shared:
        value = [f"q{i}" for i in range(7)], asked

    batches = [pa.RecordBatch.from_arrays([pa.array([None if k == 3 else f"k{k:03}" for k in keys[a : a + 90]]), pa.array(list(x[a : a + 90]))], ["__key", "__vector"]) for a in range(0, 500, 90)]
    got = [tuple(r.values()) for b in vectors._nearest(Shared, 5, "q", "id")(iter(batches)) for r in b.to_pylist()]
    score = np.round(asked @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).T, 6)
    want = []
    for i in range(7):
        rows = sorted((-s, "" if k == 3 else f"k{k:03}") for s, k in zip(score[i], keys, strict=True))[:5]
        want += [(f"q{i}", k or None, -s) for s, k in rows]
    assert got == want


def test_no_task_reads_a_whole_cluster(spark):
    rows = [(i, [float(i % 3) * 100 + i * 0.001, 1.0]) for i in range(60)] + [(100, [9000.0, 1.0])]
    found = clusters.kmeans(spark.createDataFrame(rows, "k long, v array<double>"), "v", k=4, starts=1)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.k for r in found.collect()} == set(range(60))  # a cluster of one is dropped
