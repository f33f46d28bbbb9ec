"""The pipeline's stages, each against what its operator decides, and the whole."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline as P
from sparkloom.llm import common, components, decontamination, packing, quality, simhash, toxicity
from sparkloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="module")
def quick(request):
    """Networks trained for a moment: the stages' decisions are held against the same weights."""
    patch = pytest.MonkeyPatch()
    request.addfinalizer(patch.undo)
    for module in (quality, toxicity):
        train = module.train
        patch.setattr(module, "train", lambda sample, train=train: train(sample, seen=100))


def test_filters_follow_their_scores(spark, docs, sf_dir, quick):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    w = quality.fit(docs, labels)
    good = {i for i, t in texts.items() if quality.score(w, [t.encode()])[0] >= 0.3}
    kept = P.drop_poor(spark, docs, sf_dir)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == good
    w = toxicity.fit(docs, labels)
    clean = {i for i, t in texts.items() if toxicity.score(w, [t])[0] < 0.5}
    assert {r.doc_id for r in P.drop_toxic(spark, docs, sf_dir).collect()} == clean


def test_contaminated_documents_go(spark, docs, sf_dir):
    items = [decontamination.normalized(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in P.drop_contaminated(spark, docs, sf_dir).collect()}
    held = {r.doc_id for r in docs.collect() if any(x in decontamination.normalized(r.text) for x in items if len(x) >= decontamination.MIN_CHARS)}
    assert held and not held & kept and len(kept) >= docs.count() - len(held) - 1


def test_the_whole(spark, docs, sf_dir, quick):
    assert [n for n, _ in P.STAGES] == ["quality", "toxicity", "near_dedup", "decontamination", "packing"]
    got = P.run(spark, sf_dir).toPandas()
    assert 0 < got.doc_id.nunique() < docs.count()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= packing.CAPACITY
    one = got[got.doc_id == got.doc_id.iloc[0]]
    encoder = packing.words.loaded(tokenizer_path("word_bpe_49k.json"))
    assert one.length.sum() == len(encoder.ids(texts[one.doc_id.iloc[0]])) + 1


def test_stages_take_empty_tables(spark, docs, sf_dir, quick):
    for _, stage in P.STAGES[1:]:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_near_copies_go_by_fingerprints_and_by_shingles(spark, sf_dir):
    refrain = [f"w{i}" for i in range(20)] * 40
    base = [f"b{i}" for i in range(400)]
    block = base[:133] + [f"n{i}" for i in range(50)] + base[133:]
    rows = [(1, refrain + [f"x{i}" for i in range(12)]), (2, refrain + [f"y{i}" for i in range(12)]), (3, base), (4, block), (5, [f"z{i}" for i in range(300)])]
    sets = {i: {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} for i, ws in rows}
    likeness = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    bits = lambda i, j: (simhash.simhash(" ".join(dict(rows)[i])) ^ simhash.simhash(" ".join(dict(rows)[j]))).bit_count()
    assert likeness(1, 2) < 0.5 and bits(1, 2) <= simhash.RADIUS  # found by operator 3 alone
    assert likeness(3, 4) >= 0.8 and bits(3, 4) > simhash.RADIUS  # found by the exact check alone
    df = spark.createDataFrame([(i, " ".join(ws)) for i, ws in rows] + [(6, ""), (7, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in P.drop_near_copies(spark, df, sf_dir).collect()) == [1, 3, 5, 6]


def test_near_copies_keep_one_of_each_group_of_operator_3(spark, docs, sf_dir):
    groups = simhash.near_groups_table(docs).collect()
    kept = {r.doc_id for r in P.drop_near_copies(spark, docs, sf_dir).collect()}
    exact = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert kept <= {r.component_id for r in groups} and kept <= exact and len(kept) < docs.count()


def test_near_copies_broadcast_no_table_by_its_guessed_size(spark, docs, sf_dir, monkeypatch):
    """Spark sized the deal of fingerprints and the bitmaps of shingle sets too low, broadcast them, and the driver ran out of memory."""
    plans = []
    for module in (simhash, components):
        monkeypatch.setattr(module, "staged", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or common.staged(df, name))
        monkeypatch.setattr(module, "sized", lambda table, rows=0: table.hint("merge"), raising=False)
    kept = P.drop_near_copies(spark, docs, sf_dir)
    plans.append(("kept", kept._jdf.queryExecution().executedPlan().toString()))
    assert {"buckets", "hooks", "alike", "pairs", "near", "wanted", "shingles", "linked", "rest", "gone"} <= {name for name, _ in plans}
    assert [name for name, plan in plans if "Broadcast" in plan] == []


def test_packing_encodes_a_megabyte_of_texts_at_a_time(spark, docs, monkeypatch):
    assert packing.words.GROUP <= 1 << 20
    sizes = []
    batch = packing.words.WordIds.batch
    monkeypatch.setattr(packing.words.WordIds, "batch", lambda self, texts: sizes.append(sum(len(t.encode()) for t in texts)) or batch(self, texts))
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(600)), "text": ["some words " * 500] * 600})
    encoder = packing.words.loaded(tokenizer_path("word_bpe_49k.json"))
    for part in packing.by_bytes(rows, 1, packing.words.GROUP):
        encoder.batch(part.column(1).to_pylist())
    assert len(sizes) > 3 and max(sizes) <= 1 << 20


def test_stages_hand_texts_to_python_by_bytes(spark, docs, sf_dir, quick):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    default = spark.conf.get(key)
    rows = spark.range(0, 3000, numPartitions=1).selectExpr("id as doc_id", "repeat('some words ', 400) as text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes], "rows": [batch.num_rows]})

    try:
        for _, stage in P.STAGES:
            spark.conf.set(key, default)
            stage(spark, docs, sf_dir)
            got = rows.mapInArrow(sizes, "bytes long, rows long").collect()
            assert sum(r.rows for r in got) == 3000 and max(r.bytes for r in got) <= 2.5e6
    finally:
        spark.conf.set(key, default)
