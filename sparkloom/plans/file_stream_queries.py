"""Files written out of the tables and read again; streams over the tables against their batch results."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import stats, vectors
from sparkloom.plans.registry import Registry, table
from sparkloom.sources import files, nested
from sparkloom.sources.staging import fresh_path
from sparkloom.streaming import ingest, progress, runs

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


@R.add("i1_chunk_files", "SELECT source AS org, lang AS board, '2024-01' AS month, doc_id, text FROM documents")
def _(spark, d):
    path = fresh_path(spark, "chunks")
    docs = table(spark, d, "documents")
    # A file for about a hundred documents, however many a group has; either form by turns.
    sizes = docs.groupBy("source", "lang").agg(F.ceil(F.count("*") / 100).alias("files"))
    docs = docs.join(sizes, ["source", "lang"]).withColumn("k", F.pmod(F.xxhash64("doc_id"), F.col("files")))
    each = docs.groupBy("source", "lang", "k").agg(F.collect_list(F.struct("doc_id", "text")).alias("c"))
    body = F.when(F.col("k") % 2 == 0, F.to_json("c")).otherwise(F.to_json(F.struct(F.col("c").alias("chunks"))))
    each.select(body.alias("value"), "source", "lang", F.lit("2024-01").alias("month"), "k").repartition("source", "lang", "k").write.partitionBy("source", "lang", "month", "k").text(path)
    found = files.read_chunk_files(spark, path, "doc_id:bigint,text:string", r"/source=([^/]+)/lang=([^/]+)/month=([^/]+)/[^/]+/[^/]*$")
    return found.select("org", "board", "month", "doc_id", "text")


@R.add("i2_inventory")
def _(spark, d):
    path = fresh_path(spark, "extracted")
    table(spark, d, "documents").select("source", "lang", "doc_id", "text").hint("rebalance", "source", "lang").write.partitionBy("source", "lang").json(path)
    return files.inventory(spark, path, r"/source=([^/]+)/lang=([^/]+)/[^/]*$")


@R.add("i4_table_cache", "SELECT n_name AS pdf_hash, n_regionkey AS page_num, 0 AS table_index, c::INT AS cell, c AS row_start, n_nationkey % 2 = 0 AS is_merged FROM nation, (VALUES (0), (1)) t(c)")
def _(spark, d):
    path = fresh_path(spark, "tables")
    cell = lambda i: F.struct(F.array(F.lit(i), F.lit(i + 1)).alias("row_span"), F.array(F.lit(0), F.lit(1)).alias("col_span"), F.array(F.lit(0.0), F.lit(1.0)).alias("bbox"), (F.col("n_nationkey") % 2 == 0).alias("is_merged"))
    table(spark, d, "nation").select(F.col("n_name").alias("pdf_hash"), F.col("n_regionkey").alias("page_num"), F.lit(0).alias("table_index"), F.array(cell(0), cell(1)).alias("cells")).repartition("pdf_hash").write.option("maxRecordsPerFile", 1).json(path)
    return files.read_table_cache(spark, path).select("pdf_hash", "page_num", "table_index", "cell", F.col("row_span")[0].alias("row_start"), "is_merged")


@R.add("i6_formats", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'html' ELSE 'hwp' END AS declared, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'html' ELSE 'html' END AS actual FROM pages")
def _(spark, d):
    k = F.col("page_id") % 4
    name = F.when(k == 0, "a.pdf").when(k == 1, "b.DOCX").when(k == 2, "c.html").otherwise("d.hwp")
    head = F.when(k == 0, F.unhex(F.lit("255044462D"))).when(k == 1, F.unhex(F.lit("504B030414"))).otherwise(F.encode("html", "UTF-8"))
    declared, actual = files.actual_format(head, name)
    return table(spark, d, "pages").select("page_id", declared.alias("declared"), actual.alias("actual"))


@R.add("i7_decoded", "SELECT page_id, html AS text, CASE WHEN page_id % 2 = 0 THEN 'utf-8' ELSE 'utf-16' END AS charset FROM pages")
def _(spark, d):
    content = F.when(F.col("page_id") % 2 == 0, F.encode("html", "UTF-8")).otherwise(F.encode("html", "UTF-16"))
    return files.decoded(table(spark, d, "pages").select("page_id", content.alias("content")), "page_id", "content")


# Pages written as files of other kinds and charsets, then told apart and read by what is in them.
@R.add("i6_file_heads", """SELECT page_id, ['pdf', 'docx', 'html', 'hwp', 'xlsx'][page_id % 5 + 1] AS kind, CASE page_id % 5 WHEN 0 THEN 5 WHEN 1 THEN 16 WHEN 2 THEN 5 WHEN 3 THEN 28 ELSE 14 END + octet_length(encode(html)) AS length FROM pages""")
def _(spark, d):
    ole = "D0CF11E0" + "FileHeader".encode("utf-16-le").hex()
    marks = ["255044462D", "504B0304" + b"word/doc.xml".hex(), b"<html".hex(), ole + "00000000", "504B0304" + b"xl/book.x~".hex()]
    mark = F.unhex(F.element_at(F.array(*map(F.lit, marks)), (F.col("page_id") % 5 + 1).cast("int")))
    path = fresh_path(spark, "heads")
    rows = table(spark, d, "pages").select("page_id", F.base64(F.concat(mark, F.encode("html", "UTF-8"))).alias("body"))
    files.write_each(rows, "page_id", "body", path)
    found = files.heads(spark, path, 64)
    kind = F.coalesce(files.container_kind(F.col("head")), files.actual_format(F.col("head"), F.col("path"))[1])
    return found.select(F.regexp_extract("path", r"(\d+)$", 1).cast("long").alias("page_id"), kind.alias("kind"), "length")


@R.add("i7_decoded_files", "SELECT doc_id, ['utf-8', 'euc-kr', 'cp949', 'utf-16'][doc_id % 4 + 1] AS charset, '한국어 문서 ' || CASE doc_id % 4 WHEN 2 THEN '똠햏뷁샾뙇 ' ELSE '' END || doc_id AS text FROM documents")
def _(spark, d):
    path = fresh_path(spark, "charsets")
    text = F.concat(F.lit("한국어 문서 "), F.when(F.col("doc_id") % 4 == 2, "똠햏뷁샾뙇 ").otherwise(""), F.col("doc_id").cast("string"))
    rows = table(spark, d, "documents").select("doc_id", text.alias("text"), F.element_at(F.array(*map(F.lit, ("utf-8", "euc-kr", "cp949", "utf-16"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("charset"))
    files.write_each(files.encoded(rows, "text", "charset", "body"), "doc_id", "body", path)
    contents = files.heads(spark, path, -1).select(F.regexp_extract("path", r"(\d+)$", 1).cast("long").alias("doc_id"), F.col("head").alias("content"))
    return files.decoded(contents, "doc_id", "content")


@R.add("i8_partitioned_save", "SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2")
def _(spark, d):
    path = fresh_path(spark, "saved")
    files.save(table(spark, d, "documents").hint("rebalance", "lang", "source"), path, ["lang", "source"])
    return spark.read.parquet(path).groupBy("lang", "source").agg(F.count("*").alias("n"))


@R.add("i11_migrated", "SELECT c_custkey::VARCHAR AS id, c_name AS name, c_acctbal AS balance FROM customer")
def _(spark, d):
    path = fresh_path(spark, "store")
    record = F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    entries = F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string"), record)))
    customers = table(spark, d, "customer")
    stores = customers.agg(F.ceil(F.count("*") / 100).alias("stores"))
    dealt = customers.crossJoin(F.broadcast(stores)).withColumn("k", F.pmod(F.xxhash64("c_custkey"), F.col("stores")))  # about a hundred entries a store
    dealt.groupBy("k").agg(F.to_json(entries).alias("value")).select("value").repartition("value").write.option("maxRecordsPerFile", 1).text(path)
    return files.migrate(spark, path, "name:string,balance:double")


@R.add("i20_delimited", "SELECT p_partkey, p_name, p_size FROM part")
def _(spark, d):
    path = fresh_path(spark, "delimited")
    table(spark, d, "part").select("p_partkey", "p_name", "p_size").write.csv(path, sep="|")
    return files.read_delimited(spark, path, "p_partkey long, p_name string, p_size int")


@R.add("i21_records", "SELECT event_id, event_type AS kind FROM events")
def _(spark, d):
    record = F.struct(F.col("event_type").alias("kind"))
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.to_json(F.struct(F.struct(F.array(record).alias("items")).alias("data")))).when(k == 1, F.to_json(F.struct(F.array(record).alias("results")))).otherwise(F.to_json(record))
    found = nested.records(raw, ["$.data.items", "$.results", "$.data"], "kind:string")
    return table(spark, d, "events").select("event_id", F.explode(found).alias("r")).select("event_id", "r.kind")


@R.add("x1_stream_ingest", "SELECT substr(sha256(regexp_replace(url, '[?#].*$', '')), 1, 16) AS key, count(*) AS kept FROM (SELECT DISTINCT regexp_replace(url, '[?#].*$', '') AS url FROM pages) GROUP BY 1")
def _(spark, d):
    return _ingested(spark, d)[0].groupBy("key").agg(F.count("*").alias("kept"))


def _ingested(spark, d):
    key = F.substring(F.sha2(F.regexp_replace("url", "[?#].*$", ""), 256), 1, 16)
    return ingest.ingest(ingest.source(spark, f"{d}/pages.parquet").select("page_id", "url"), key)


@R.add("x1_ingest_counts", """WITH u AS (SELECT count(*) AS seen, count(DISTINCT regexp_replace(url, '[?#].*$', '')) AS added FROM pages) SELECT seen, added, seen - added AS skipped FROM u""")
def _(spark, d):
    return _ingested(spark, d)[1].agg(*[F.sum(c).alias(c) for c in ("seen", "added", "skipped")])


@R.add("x1_ingest_of_event_kinds", """WITH k AS (SELECT user_id || event_type AS key, user_id % 5 = 0 AS known FROM events)
 SELECT count(*) AS seen, count(DISTINCT CASE WHEN NOT known THEN key END) AS added, count(*) - count(DISTINCT CASE WHEN NOT known THEN key END) AS skipped FROM k""")
def _(spark, d):
    key = F.concat(F.col("user_id").cast("string"), "event_type")
    known = table(spark, d, "events").where("user_id % 5 = 0").select(key.alias("key")).distinct()
    found = ingest.ingest(ingest.source(spark, f"{d}/events.parquet"), key, known, "ts", "60 days")[1]
    return found.agg(*[F.sum(c).alias(c) for c in ("seen", "added", "skipped")])


@R.add("x2_stream_timeline", "SELECT strftime(ts, '%Y-%m-%d') || ' 00:00' AS start, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    return ingest.final_table(ingest.tumbling(ingest.source(spark, f"{d}/events.parquet"), "ts"))


@R.add("x3_stream_failures", """SELECT strftime(w, '%Y-%m-%d %H:%M') AS start, count(*) AS runs, count(*) FILTER (event_type = 'error') AS failed, round(100.0 * count(*) FILTER (event_type = 'error') / count(*), 1) AS rate
 FROM (SELECT event_type, date_trunc('hour', ts) - to_hours(h) AS w FROM events, range(0, 24) t(h)) GROUP BY w""")
def _(spark, d):
    return ingest.final_table(ingest.sliding_failures(ingest.source(spark, f"{d}/events.parquet"), "ts", F.col("event_type") == "error"))


# A run is stuck once the last event is more than two days after its limit.
_RUNS = """WITH s AS (SELECT user_id AS key, ts FROM events WHERE event_type = 'view'), f AS (SELECT user_id AS key, ts FROM events WHERE event_type = 'purchase'), n AS (SELECT max(ts) - INTERVAL 2 DAY AS now FROM events),
 e AS (SELECT s.key, s.ts, f.ts AS finish FROM s ASOF LEFT JOIN f ON s.key = f.key AND s.ts <= f.ts),
 r AS (SELECT key, epoch_us(ts) AS started, CASE WHEN finish <= ts + INTERVAL 1 DAY THEN 'done' WHEN ts + INTERVAL 1 DAY < now THEN 'stuck' END AS status FROM e, n)"""


def _runs(spark, d):
    found = runs.stuck_runs(ingest.source(spark, f"{d}/events.parquet"), "user_id", "ts", F.col("event_type") == "view", F.col("event_type") == "purchase", 24 * 60)
    return ingest.appended(found)


@R.add("x4_stream_stuck", f"{_RUNS} SELECT key, status, count(*) AS n FROM r WHERE status IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return _runs(spark, d).groupBy("key", "status").agg(F.count("*").alias("n"))


@R.add("x4_stream_runs", f"{_RUNS} SELECT key, started, status FROM r WHERE status IS NOT NULL")
def _(spark, d):
    return _runs(spark, d).select("key", "started", "status")


@R.add("x5_stream_embedding", "SELECT doc_id, 64 AS dimension FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    known = table(spark, d, "labels").select("doc_id").distinct()
    embed = lambda df: vectors.hashed_vectors(df, "text").select("doc_id", "vector")
    return ingest.embed_new(ingest.source(spark, f"{d}/documents.parquet").select("doc_id", "text"), "doc_id", embed, known).select("doc_id", F.size("vector").alias("dimension"))


@R.add("x6_stream_progress", "SELECT count(*) AS processed, count(*) FILTER (event_type = 'error') AS failed, round(sum(value), 2) AS cost FROM events")
def _(spark, d):
    stream = ingest.source(spark, f"{d}/events.parquet")
    metrics = [F.count("*").alias("processed"), F.count_if(F.col("event_type") == "error").alias("failed"), F.sum("value").alias("cost")]
    found = progress.run(progress.observed(stream, "totals", *metrics))["totals"]
    batches = progress.table(spark, found, "processed long, failed long, cost double")
    return batches.agg(F.sum("processed").alias("processed"), F.sum("failed").alias("failed"), F.round(F.sum("cost"), 2).alias("cost"))
