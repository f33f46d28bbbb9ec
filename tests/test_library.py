"""The library without the training-data operators: every query against its SQL on the smallest tables, and small cases of the rest."""

import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import repair, text
from sparkloom.operators import chunking, filters, joins, ranking, retrieval, stats, tables, vectors
from sparkloom.plans import catalog
from sparkloom.sources import files, nested

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr), [columns[i] for i in order]


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.sql(SQL[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["r3_cell_recall", "r15_staged_retrieval", "k1_kmeans", "x4_stream_stuck", "u6_chunk_table_function", "r17_multi_hop", "c18_signature_scores"])
def test_queries_without_sql_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_cells_find_most_of_the_exact_neighbours(spark, sf_dir):
    assert QUERIES["r3_cell_recall"](spark, sf_dir).first()["recall"] >= 0.9


def test_entry_runs_without_the_llm_folder(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


# Chunks


@pytest.mark.parametrize("strategy", list(chunking.STRATEGIES))
def test_chunks_hold_all_text_within_the_size(spark, sf_dir, strategy):
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect():
        chunks = chunking.chunk_text(r.text, strategy, 120, tables=False)
        assert "".join("".join(c for _, c, _ in chunks).split()) == "".join(r.text.split())
        assert all(n == chunking.tokens(c) for _, c, n in chunks)
        assert all(n <= 120 or len(chunking._SENTENCE.split(c)) == 1 for _, c, n in chunks)


def test_overlap_repeats_the_tail():
    text_ = " ".join(f"Sentence number {i} is here." for i in range(40))
    plain_, over = chunking.by_sentence(text_, 40), chunking.by_sentence(text_, 40, 15)
    assert len(plain_) == len(over) > 3 and all(b.endswith(a) and len(b) > len(a) for a, b in zip(plain_[1:], over[1:], strict=True))


def test_tables_are_chunks_of_their_own():
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | x |" for i in range(25))
    got = chunking.chunk_text(f"before\n\n{table}\n\nafter", "block", 400)
    assert [k for k, _, _ in got] == ["text", "table", "table", "table", "text"]
    assert all(c.startswith("| a | b |\n| --- | --- |") for k, c, _ in got if k == "table")


def test_budget_chunks_mark_table_groups():
    got = chunking.by_token_budget("one two three.\na | b\nc | d\nlast words", 350, 50)
    assert [(g, c) for c, g, _ in got] == [(0, "one two three."), (1, "a | b\nc | d"), (2, "last words")]
    assert chunking.by_token_budget("") == [] and chunking.by_characters("") == []


# Tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def grid(rows_):
    return F.array(*[F.array(*[F.lit(c) for c in r]) for r in rows_])


def test_header_detection_and_flattening(spark):
    t = grid([["Item", "2024년", ""], ["", "amount", "rate"], ["a", "10", "5%"], ["b", "20", "6%"]])
    assert one(spark, tables.header_rows(t)) == 2
    assert one(spark, tables.flat_header(t, F.lit(2))) == ["Item", "2024년_amount", "2024년_rate"]


def test_cells_are_padded_filled_and_cleaned(spark):
    t = F.array(F.array(F.lit("A"), F.lit("B"), F.lit("")), F.array(F.lit(""), F.lit("E")), F.array(F.lit("F"), F.lit("G"), F.lit("H"), F.lit("I")))
    p = tables.padded(t, 3)
    assert one(spark, p) == [["A", "B", ""], ["", "E", ""], ["F", "G", "H"]]
    assert one(spark, tables.filled(p, "dash"))[0] == ["A", "B", "-"]
    assert one(spark, tables.filled(p, "inherit"))[1] == ["A", "E", ""]
    assert one(spark, tables.filled(p, "null"))[1] == [None, "E", None]
    assert one(spark, text.clean_cell(F.lit(" a\nb |  c "))) == r"a b \| c" and one(spark, text.clean_cell(F.lit(None).cast("string"))) == ""


def test_valid_tables(spark):
    ok = lambda *r: one(spark, tables.valid(grid(r)))
    assert ok(["a", "b"], ["c", "d"]) and not ok(["a", "b"]) and not ok(["a"], ["b"]) and not ok(["a", "", ""], ["", "", ""])


def test_hierarchy_paths(spark):
    assert one(spark, tables.hierarchy_paths(F.array(F.array(F.lit("A")), F.array(F.lit(""), F.lit("B")), F.array(F.lit(""), F.lit(""), F.lit("C"))))) == ["A", "A > B", "A > B > C"]


def test_tables_inside_text_alone_are_normalized(spark):
    df = spark.createDataFrame([(1, "no table"), (2, "x\n| h | n |\n|---|---|\n| a | 1 |\n|  | 2 |\ny"), (3, None)], "k int, t string")
    got = tables.normalized_tables(df, "k", "t").collect()
    assert [(r.k, r.markdown) for r in got] == [(2, "| h | n |\n| --- | --- |\n| a | 1 |\n| a | 2 |")]


def test_merged_tables_need_a_likely_continuation(spark):
    part = lambda p, rows_: (1, p, 0, rows_)
    df = spark.createDataFrame([part(1, [["k", "v"], ["a", "1"]]), part(2, [["k", "v"], ["b", "2"]]), part(3, [["other", "head", "three"], ["c", "3", "x"]])], "doc_id int, page_num int, table_index int, rows array<array<string>>")
    got = tables.merged_across_pages(df).orderBy("chain").collect()
    assert [(r.parts, r.removed_headers, len(r.rows)) for r in got] == [(2, 1, 3), (1, 0, 2)]


# The rest


def test_filter_language(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "a int, b string")
    ids = lambda where: [r.a for r in df.where(filters.condition(where)).collect()]
    assert ids(None) == ids({}) == [1, 2, 3] and ids({"b": "x"}) == [1] and ids({"$or": [{"a": 3}, {"b": {"$in": ["y"]}}]}) == [2, 3]
    assert ids({"$and": [{"a": {"$gte": 1}}, {"a": {"$lt": 2}}]}) == [1]


def test_week_keys_like_strftime(spark):
    import datetime

    days = [datetime.date(y, m, d) for y in (2023, 2024, 2025) for m, d in ((1, 1), (1, 2), (1, 6), (1, 7), (1, 8), (12, 31))]
    df = spark.createDataFrame([(x,) for x in days], "d date")
    assert [r[0] for r in df.select(stats.week_key(F.col("d"))).collect()] == [x.strftime("%Y-W%W") for x in days]


def test_fusion_and_budget(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "q int, k string, rank int")
    b = spark.createDataFrame([(1, "y", 1)], "q int, k string, rank int")
    got = {r.k: r.score for r in ranking.fused([a, b], "q", "k", "rank", [0.6, 0.4]).collect()}
    assert got["y"] == pytest.approx(0.6 / 62 + 0.4 / 61) and got["x"] == pytest.approx(0.6 / 61)
    sizes = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 1)], "g int, o int, n int")
    assert [r.o for r in ranking.within_budget(sizes, ["g"], ["o"], F.col("n"), 10).collect()] == [1]


def test_vector_search_in_blocks(spark):
    df = spark.createDataFrame([(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(50)], "id int, v array<double>")
    asked = df.where("id < 7").select(F.col("id").alias("q"), F.col("v").alias("w"))
    whole = vectors.top_k(df, asked, "id", "v", "q", "w", 3).orderBy("q", "rank").collect()
    assert whole == vectors.top_k(df, asked, "id", "v", "q", "w", 3, block=2).orderBy("q", "rank").collect() and len(whole) == 21
    assert vectors.top_k(df, asked.limit(0), "id", "v", "q", "w", 3).count() == 0


def test_rerank_falls_back(spark):
    pairs = spark.createDataFrame([(1, 1, 1, "a", "b"), (1, 2, 2, "a", "c")], "q int, d int, rank int, query string, text string")
    broken = lambda qs, ts: [1 / 0]
    got = retrieval.rerank(pairs, broken, "q", "d", "query", "text", 5).orderBy("rank").collect()
    assert [(r.d, r.score, r.rank_change) for r in got] == [(1, 0.5, 0), (2, 0.5, 0)]


def test_a_rerank_that_failed_is_told_from_one_that_scored(spark):
    pairs = spark.createDataFrame([(1, 1, 1, "a", "b"), (1, 2, 2, "a", "c")], "q int, d int, rank int, query string, text string").coalesce(1)
    rerank = lambda score, **k: retrieval.rerank(pairs, score, "q", "d", "query", "text", 5, **k).orderBy("rank").collect()
    half, short, broken = lambda qs, ts: [0.5 for _ in qs], lambda qs, ts: [0.7], lambda qs, ts: [1 / 0]
    assert [(r.score, r.failed) for r in rerank(half)] == [(0.5, False)] * 2
    assert [(r.score, r.failed) for r in rerank(short)] == [(r.score, r.failed) for r in rerank(broken)] == [(0.5, True)] * 2
    for score in (short, broken):
        with pytest.raises(Exception, match="scores for|division by zero"):
            rerank(score, fallback=None)


def test_model_rerank_scores_odd_rows_as_its_sql(spark, tmp_path):
    """One null text made all pairs of its batch 0.5."""
    import duckdb

    docs = [(1, "red green blue"), (1, None), (2, "red\u00a0green red"), (3, "green\x0bblue green"), (4, "blue"), (5, None), *((i, f"pad{i}") for i in range(6, 30))]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "red green blue"), (2, None), (3, "pad7 blue")], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    got = catalog.queries()["r11_model_rerank"](spark, str(tmp_path))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = con.execute(catalog.oracle_sql()["r11_model_rerank"])
    assert got.columns == [c[0] for c in want.description]
    assert sorted({(r.item_id, r.doc_id, r.score) for r in got.collect()}) == sorted({r[:3] for r in want.fetchall()})


def test_prefixes_join_by_equality(spark):
    left, right = spark.createDataFrame([("abc",), ("ab",), ("x",), (None,)], "c string"), spark.createDataFrame([("ab",), ("abc",), ("q",)], "p string")
    assert sorted((r.c, r.p) for r in joins.prefix_join(left, right, "c", "p").collect()) == [("ab", "ab"), ("abc", "ab"), ("abc", "abc")]


def test_numerals_and_encodings(spark):
    assert one(spark, repair.zeros(F.lit("1ㅇ0, 2ㅇㅇ원 그리고 ㅇㅇ"))) == "100, 200원 그리고 ㅇㅇ"
    for c in ("utf-8", "euc-kr", "utf-16"):
        assert files.decode("한글 text".encode(c))[0] == "한글 text"


def test_document_text_variants(spark):
    cases = ['{"extracted_text": "a", "text": "b"}', '{"content": {"text": "c"}}', '{"text": "d"}', '{"sections": [{"content": "e"}, {"content": ""}, {"content": "f"}], "text": "g"}', "not json", '{"content": "h"}']
    df = spark.createDataFrame([(c,) for c in cases], "raw string").select(nested.document_text(F.col("raw")))
    assert [r[0] for r in df.collect()] == ["a", "c", "d", "e\n\nf", "not json", "h"]


def test_prefixes_of_all_lengths_join(spark):
    codes = spark.createDataFrame([("x" * n,) for n in range(1, 1501)] + [("",), (None,)], "code string")
    got = joins.prefix_join(spark.createDataFrame([("x" * 1400,), ("y",), (None,)], "full string"), codes, "full", "code")
    assert got.count() == 1400 and got.columns == ["full", "code"]
    assert joins.prefix_join(spark.createDataFrame([("x",)], "full string"), codes.limit(0), "full", "code").count() == 0


def test_signatures_of_headers(spark):
    from difflib import SequenceMatcher

    cases = [(["Name", "Total", "2024"], ["name", "Totals", "x"], [0.5, 0.3, 0.2], [0.5, 0.35, 0.15]), (["A", "B"], ["A", "B"], [0.5, 0.5], [0.5, 0.5]), (["A"], ["A", "B", "C"], None, [0.2]), ([], ["A"], [], [])]
    for with_widths in (True, False):
        rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, x array<string>, y array<string>, p array<double>, q array<double>")
        for c, names, widths in (("a", "x", "p"), ("b", "y", "q")):
            rows = rows.withColumn(c, tables.signature(F.col(names)))
            rows = rows.withColumn(c, F.col(c).withField("widths", F.col(widths))) if with_widths else rows
        for r in tables.signature_score(rows, "a", "b").collect():
            x, y, p, q = cases[r.i]
            x, y = [s.lower() for s in x], [s.lower() for s in y]
            ratios = [SequenceMatcher(None, s, t).ratio() for s, t in zip(x, y, strict=False)]
            count = 1 - abs(len(x) - len(y)) / max(len(x), len(y))
            names = sum(v for v in ratios if v >= 0.8) / len(ratios) * len(ratios) / max(len(x), len(y)) if ratios else 0
            widths = sum(max(0, 1 - abs(s - t) / 0.15) for s, t in zip(p, q, strict=False)) / min(len(p), len(q)) if with_widths and p and q else 1
            assert abs(r.score - (0.25 * count + 0.45 * names + 0.15 * widths + 0.15 * (x == y))) < 1e-9


def test_no_cluster_without_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from sparkloom.sources import staging

    none = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: SimpleNamespace(isEmpty=lambda: True)))
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(_jsc=none, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_dir(cluster)


def test_runs_that_see_no_other_event_are_stuck_once_the_watermark_is_past_them(spark, tmp_path):
    from sparkloom.streaming import ingest

    path = str(tmp_path / "events.parquet")
    rows_ = [(1, "2024-01-01 00:00:00", "start"), (2, "2024-01-01 00:00:00", "start"), (2, "2024-01-01 00:10:00", "end"), (3, "2024-01-09 00:00:00", "start"), (4, None, "start")]
    spark.createDataFrame(rows_, "k int, ts string, what string").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema("k int, ts string, what string").parquet(path)
    found = ingest.appended(ingest.stuck_runs(stream, "k", "ts", F.col("what") == "start", F.col("what") == "end"))
    assert sorted((r.key, r.status) for r in found.collect()) == [(1, "stuck"), (2, "done")]


def test_batches_that_run_again_add_nothing(spark, tmp_path):
    from sparkloom.streaming import ingest

    path = str(tmp_path / "kept")
    for ids in ([1, 2], [1, 2, 3]):
        ingest._keep(spark.createDataFrame([(i,) for i in ids], "k int"), path, 0)
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_search_and_text_functions_plug_in(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "d int, text string")
    asked = spark.createDataFrame([(7, "a"), (8, None)], "q int, text string")
    search = lambda queries, k: queries.crossJoin(docs.select("d")).select("q", "d", F.lit(1.0).alias("score"), F.col("d").alias("rank")).where(F.col("rank") <= k)
    got = retrieval.retrieve(docs, asked, retrieval.default_plan("basic"), "d", "q", search=search)
    assert sorted((r.q, r.d) for r in got.collect()) == [(7, 1), (7, 2), (8, 1), (8, 2)]
    said = retrieval.answered(asked, lambda systems, prompts: [p.upper() for p in prompts], "text")
    assert sorted((r.q, r.answer) for r in said.collect()) == [(7, "A"), (8, None)]


def test_attached_files_need_the_whole_stem(spark):
    asked = spark.createDataFrame([(1, "re:port of the year and of much more"), (2, "x"), (3, ""), (4, None), (5, "report")], "k int, name string")
    files_ = spark.createDataFrame([("b/07_re_port of the year and of much.pdf",), ("a/1_re_port of the year.pdf",), ("c/x.txt",), (None,)], "path string")
    got = joins.attached_files(asked, files_, "name", "path").orderBy("k").collect()
    assert [r.file for r in got] == ["b/07_re_port of the year and of much.pdf", "c/x.txt", None, None, None]


def test_tables_of_both_kinds_are_found_without_overlaps():
    text_ = "a\n<!-- 표 1 -->\n\n| h | n |\n|---|---|\n| x | 1 |\n\nb\n<!-- 표 2 -->[표 데이터]\n- k: v\n\nafter"
    got = chunking.detected_tables(text_)
    assert [(t.kind, t.title, t.headers, t.rows) for t in got] == [("piped", "표 1", ["h", "n"], [["x", "1"]]), ("list", "표 2", ["k"], [["v"]])]
    assert "".join(c for _, c in chunking.segments(text_)) == text_ and chunking.detected_tables("") == []


def test_a_task_holds_the_chunks_of_few_texts():
    texts = ["a b. " * 20_000] * 40 + [None, "", "c d"]  # 100,000 characters each
    batch = pa.RecordBatch.from_arrays([pa.array(range(43)), pa.array(texts)], ["doc_id", "text"])
    cut = lambda t: [(t[a : a + 1000],) for a in range(0, len(t), 1000)]
    got = list(chunking._spreader("doc_id", cut, pa.schema([("content", pa.string())]))(iter([batch])))
    assert max(b.num_rows for b in got) <= 1200  # all 4,001 at once before
    rows = [r for b in got for r in b.to_pylist()]
    assert [(r["doc_id"], r["chunk_index"], r["content"]) for r in rows] == [(i, j, c) for i, t in enumerate(texts) for j, (c,) in enumerate(cut(t or ""))]


def test_a_fifth_of_the_overlap_is_exact(spark):
    box = lambda *x: F.array(*map(F.lit, x))
    found = spark.range(1).select(tables.position_score(box(0.0, 0.0, 304.5, 0.0), box(20.0, 999.0, 320.0, 999.0), F.lit(800.0)))
    assert found.first()[0] == 56.9 / 320


def test_titles_with_references_equal_their_sql(spark, tmp_path):
    import duckdb

    titles = ["&quot;a&quot; &amp;lt; b", "&nbsp;x &lt;y&gt; &#39;z&apos;&nbsp;", "\n t &amp;amp; "]
    pages = spark.createDataFrame([(i, f'u{i}', f'<html lang="en"><head><title>{t}</title></head></html>') for i, t in enumerate(titles)], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got, want = QUERIES["c31_page_structure"](spark, str(tmp_path)), con.sql(SQL["c31_page_structure"])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
