"""Filters, joins, windows, reports and set operations on the relational tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import filters, joins, keywords, ranking, scans, stats
from sparkloom.plans.registry import Registry, table
from sparkloom.sources.buckets import Buckets
from sparkloom.sources.staging import fresh_path

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


# Filters


@R.add("p1_metadata_filter", "SELECT doc_id, lang, source FROM documents WHERE lang = 'en' AND (source IN ('src1', 'src2') OR n_chars > 5000)")
def _(spark, d):
    where = {"lang": "en", "$or": [{"source": {"$in": ["src1", "src2"]}}, {"n_chars": {"$gt": 5000}}]}
    return table(spark, d, "documents").where(filters.condition(where)).select("doc_id", "lang", "source")


@R.add("p2_tag_filter", "SELECT p_partkey, p_name FROM part WHERE list_has_any(string_split(p_name, ' '), ['cold', 'large']) AND p_size < 20")
def _(spark, d):
    return table(spark, d, "part").where(filters.any_tag(F.split("p_name", " "), ["cold", "large"]) & (F.col("p_size") < 20)).select("p_partkey", "p_name")


@R.add("p3_flat_metadata", "SELECT o_orderkey, coalesce(array_to_string(list_sort(list(l_partkey)), ','), '') AS parts, coalesce(max(o_orderpriority), '') AS priority FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(spark, d):
    parts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list("l_partkey")).alias("parts"))
    joined = table(spark, d, "orders").join(parts, F.col("o_orderkey") == F.col("k"), "left")
    return joined.select("o_orderkey", F.coalesce(F.array_join(F.col("parts").cast("array<string>"), ","), F.lit("")).alias("parts"), F.coalesce("o_orderpriority", F.lit("")).alias("priority"))


@R.add("p4_facet_filter", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') AND strftime(ts, '%Y-%m') BETWEEN '2024-01' AND '2024-12' AND user_id < 50 GROUP BY 1")
def _(spark, d):
    kept = table(spark, d, "events").where(filters.condition({"event_type": {"$in": ["click", "view"]}, "user_id": {"$lt": 50}}) & filters.month_range("ts", "2024", "2024"))
    return kept.groupBy("event_type").agg(F.count("*").alias("n"))


@R.add("p5_filtered_count", "SELECT count(*) AS n FROM documents WHERE lang IN ('fr', 'de')")
def _(spark, d):
    return table(spark, d, "documents").where(filters.condition({"lang": {"$in": ["fr", "de"]}})).agg(F.count("*").alias("n"))


@R.add("p6_filtered_rows", "SELECT doc_id, source, n_chars FROM documents WHERE lang = 'es' ORDER BY doc_id LIMIT 50")
def _(spark, d):
    return ranking.page(table(spark, d, "documents").where("lang = 'es'").select("doc_id", "source", "n_chars"), [F.col("doc_id")], 50)


@R.add("p7_exists_map", "SELECT vec_id, vec_id IN (SELECT vec_id FROM embeddings WHERE label < 5) AS found FROM (SELECT unnest(range(0, 1000, 7)) AS vec_id)")
def _(spark, d):
    return filters.exists_map(spark.range(0, 1000, 7).withColumnRenamed("id", "vec_id"), table(spark, d, "embeddings").where("label < 5"), "vec_id")


@R.add("p8_delete_report", "SELECT count(*) FILTER (label = 3) AS deleted, count(*) FILTER (label <> 3) AS remaining FROM embeddings")
def _(spark, d):
    return filters.delete_report(table(spark, d, "embeddings"), F.col("label") == 3)


@R.add("p9_clear", "SELECT doc_id, lang FROM documents WHERE false")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").where("false")


@R.add("p10_patch", "SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 3 = 0 THEN 'xx' END, lang) AS lang, source FROM documents d")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    patches = docs.where("doc_id % 3 = 0").select("doc_id", F.lit("xx").alias("lang"), F.lit(None).cast("string").alias("source"))
    return filters.patched(docs, patches, "doc_id", ["lang", "source"])


@R.add("p11_document_filter", "SELECT doc_id FROM documents WHERE contains(text, 'idiot') AND lang = 'en'")
def _(spark, d):
    return table(spark, d, "documents").where(F.col("text").contains("idiot") & (F.col("lang") == "en")).select("doc_id")


@R.add("p12_range_gate", """WITH s AS (SELECT *, o_orderdate < TIMESTAMP '1997-01-01' AS stop FROM orders), q AS (SELECT *, coalesce(max(stop::INT) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM s)
 SELECT o_orderkey, CASE WHEN seen = 1 THEN 'skip' WHEN stop THEN 'stop' WHEN o_orderdate > TIMESTAMP '2000-01-01' THEN 'skip' ELSE 'keep' END AS gate FROM q""")
def _(spark, d):
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    return filters.range_gate(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], F.col("o_orderdate"), t("1997-01-01 00:00:00"), t("2000-01-01 00:00:00")).select("o_orderkey", "gate")


@R.add("p13_extension_filter", "SELECT p_partkey FROM part WHERE lower(regexp_extract(p_name || '.' || split_part(p_brand, '#', 2) || 'A', '\\.([A-Za-z0-9]+)$', 1)) IN ('13a', '5a')")
def _(spark, d):
    name = F.concat("p_name", F.lit("."), F.element_at(F.split("p_brand", "#"), 2), F.lit("A"))
    return table(spark, d, "part").where(filters.allowed_extension(name, [".13A", "5a"])).select("p_partkey")


@R.add("p14_chunk_page", "SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS rank, (SELECT count(*) FROM documents WHERE lang = 'en') AS total FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 20 OFFSET 20")
def _(spark, d):
    docs = table(spark, d, "documents").where("lang = 'en'")
    # The page's 40 rows alone are numbered; the total is counted over all.
    first = docs.select("doc_id", "n_chars").orderBy("doc_id").limit(40).withColumn("rank", F.row_number().over(Window.orderBy("doc_id")).cast("long")).where("rank > 20")
    return first.crossJoin(F.broadcast(docs.agg(F.count("*").alias("total"))))


@R.add("p15_taxonomy_search", "SELECT p_partkey, p_name, p_type FROM part WHERE p_size > 25 AND (contains(lower(p_name), 'bolt') OR contains(lower(p_type), 'promo')) ORDER BY p_partkey LIMIT 50")
def _(spark, d):
    hit = F.lower("p_name").contains("bolt") | F.lower("p_type").contains("promo")
    return table(spark, d, "part").where((F.col("p_size") > 25) & hit).select("p_partkey", "p_name", "p_type").orderBy("p_partkey").limit(50)


@R.add("p16_cascade_lookup", """WITH k AS (SELECT * FROM (VALUES ('cold widget'), ('bolt'), ('nothing at all'), ('small gear')) k(word)),
 h AS (SELECT word, p_name, p_type, 1 AS tier FROM k JOIN part ON p_name = word UNION ALL SELECT word, p_name, p_type, 2 FROM (SELECT word, unnest(string_split(word, ' ')) AS w FROM k) JOIN (SELECT p_name, p_type, unnest(string_split(p_name, ' ')) AS w FROM part) USING (w)),
 o AS (SELECT word, p_name, p_type, min(tier) AS tier FROM h GROUP BY 1, 2, 3)
 SELECT word, p_name, p_type, tier, row_number() OVER (PARTITION BY word ORDER BY p_name, p_type)::INT AS rank FROM (SELECT * FROM o QUALIFY tier = min(tier) OVER (PARTITION BY word)) QUALIFY row_number() OVER (PARTITION BY word ORDER BY p_name, p_type) <= 10""")
def _(spark, d):
    words = spark.createDataFrame([("cold widget",), ("bolt",), ("nothing at all",), ("small gear",)], "word string")
    tiers = [(F.array("word"), F.array("p_name")), (F.split("word", " "), F.split("p_name", " "))]
    return filters.cascade(words, table(spark, d, "part").select("p_name", "p_type"), tiers, "word", ["p_name", "p_type"], 10)


@R.add("p17_stuck_runs", "SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 30 MINUTE THEN 'failed' ELSE event_type END AS status FROM events")
def _(spark, d):
    stuck = (F.col("event_type") == "view") & (F.col("ts") < F.lit("2024-01-20 12:00:00").cast("timestamp_ntz") - F.expr("interval 30 minutes"))
    return table(spark, d, "events").select("event_id", F.when(stuck, "failed").otherwise(F.col("event_type")).alias("status"))


@R.add("p18_retention", "SELECT o_orderstatus, count(*) AS deleted, round(sum(o_totalprice), 2) AS freed FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderdate < TIMESTAMP '2000-01-01' - INTERVAL 7 DAY GROUP BY 1")
def _(spark, d):
    old = F.col("o_orderdate") < F.lit("2000-01-01 00:00:00").cast("timestamp_ntz") - F.expr("interval 7 days")
    return table(spark, d, "orders").where(old & F.col("o_orderstatus").isin("F", "O")).groupBy("o_orderstatus").agg(F.count("*").alias("deleted"), F.round(F.sum("o_totalprice"), 2).alias("freed"))


@R.add("p19_select_unprocessed", "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src1' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def _(spark, d):
    return table(spark, d, "documents").where("lang = 'en' and source = 'src1'").join(table(spark, d, "labels"), "doc_id", "left_anti").select("doc_id")


@R.add("p20_field_search", "SELECT p_partkey FROM part WHERE (p_brand IN ('Brand#13', 'Brand#5')) AND (lower(p_name) LIKE '%cold%' OR lower(p_name) LIKE '%small%') AND regexp_matches(p_type, '(?i)^eco|promo$')")
def _(spark, d):
    parts = table(spark, d, "part")
    wanted = {"p_brand": ("exact", ["Brand#13", "Brand#5"]), "p_name": ("contains", ["COLD", "small"]), "p_type": ("regex", ["^eco", "promo$"]), "missing": ("exact", ["x"])}
    return parts.where(filters.field_search(parts, wanted)).select("p_partkey")


@R.add("p22_date_window", "SELECT o_orderkey, strftime(o_orderdate::DATE - 30, '%Y%m%d') AS d8, strftime(o_orderdate::DATE - 30, '%Y-%m-%d') AS iso, strftime(o_orderdate::DATE - 30, '%Y.%m.%d') AS dotted, strftime(o_orderdate::DATE - 30, '%Y/%m/%d') AS slashed FROM orders")
def _(spark, d):
    start = F.date_sub(F.to_date("o_orderdate"), 30)
    return table(spark, d, "orders").select("o_orderkey", *[F.date_format(start, f).alias(n) for n, f in (("d8", "yyyyMMdd"), ("iso", "yyyy-MM-dd"), ("dotted", "yyyy.MM.dd"), ("slashed", "yyyy/MM/dd"))])


# Joins


@R.add("j2_inner_join", "SELECT o_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS bytes FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 13 GROUP BY 1")
def _(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "orders").where("o_custkey = 13"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("bytes"))


@R.add("j1_left_join_sizes", "WITH f AS (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice) AS b FROM lineitem GROUP BY 1) SELECT o_custkey, count(*) AS documents, coalesce(sum(n), 0)::BIGINT AS attachments, round(coalesce(sum(b), 0), 2) AS bytes FROM orders LEFT JOIN f ON l_orderkey = o_orderkey GROUP BY 1")
def _(spark, d):
    found = stats.board_stats(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", ["o_custkey"], "o_orderdate", F.col("l_extendedprice"), "2000-06-30 00:00:00")
    return found.select("o_custkey", "documents", "attachments", "bytes")


@R.add("j3_latest_rows", "SELECT user_id, event_id, event_type FROM events QUALIFY rank() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1")
def _(spark, d):
    return stats.latest_per_group(table(spark, d, "events"), "user_id", "ts").select("user_id", "event_id", "event_type")


@R.add("j4_existing_ids", "SELECT count(*) FILTER (l.doc_id IS NULL) AS new, count(*) FILTER (l.doc_id IS NOT NULL) AS known FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def _(spark, d):
    docs, known = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    return docs.join(known, "doc_id", "left_anti").agg(F.count("*").alias("new")).crossJoin(docs.join(known, "doc_id", "left_semi").agg(F.count("*").alias("known")))


@R.add("j5_board_status", """WITH s AS (SELECT o_custkey, count(*) AS documents, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last FROM orders GROUP BY 1)
 SELECT c_custkey, n_name, coalesce(documents, 0) AS documents, CASE WHEN c_acctbal < 0 THEN 'disabled' WHEN last = 'O' THEN 'running' WHEN last = 'P' THEN 'error' WHEN documents = 1 THEN 'warning' WHEN documents > 0 THEN 'active' ELSE 'never' END AS status
 FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN s ON o_custkey = c_custkey""")
def _(spark, d):
    docs = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("documents"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("last"))
    joined = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(docs, F.col("o_custkey") == F.col("c_custkey"), "left")
    status = joins.status_ladder(F.col("c_acctbal") >= 0, F.col("last") == "O", F.col("last") == "P", F.col("documents") == 1, F.coalesce("documents", F.lit(0)))
    return joined.select("c_custkey", "n_name", F.coalesce("documents", F.lit(0)).alias("documents"), status.alias("status"))


@R.add("j6_enriched_errors", "SELECT event_id, c_name, n_name, r_name FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE event_type = 'error'")
def _(spark, d):
    orgs = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    boards = table(spark, d, "customer").join(F.broadcast(orgs), F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, d, "events").where("event_type = 'error'").join(boards, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_name", "n_name", "r_name")


@R.add("j7_schedule_targets", "SELECT target, arg_max(p_partkey, p_partkey) AS schedule, count(*) AS schedules FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS target FROM part) GROUP BY 1")
def _(spark, d):
    parts = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("targets"), F.col("p_partkey").alias("pos"))
    return joins.latest_target(parts, "targets", "p_partkey", "pos")


@R.add("j8_chunk_vectors", "SELECT doc_id, lang, label, round(embedding[1]::DOUBLE, 6) AS first FROM documents JOIN embeddings ON doc_id = vec_id")
def _(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    return joined.select("doc_id", "lang", "label", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@R.add("j9_prefix_join", "SELECT p_partkey, code FROM part JOIN (VALUES ('Brand#1'), ('Brand#2'), ('Brand#13'), ('Brand#')) m(code) ON starts_with(p_brand, code)")
def _(spark, d):
    majors = spark.createDataFrame([("Brand#1",), ("Brand#2",), ("Brand#13",), ("Brand#",)], "code string")
    return joins.prefix_join(table(spark, d, "part"), majors, "p_brand", "code").select("p_partkey", "code")


@R.add("j10_contained_prefix", "SELECT p_partkey, w AS prefix FROM (SELECT p_partkey, unnest(list_distinct(regexp_extract_all(p_name, '[a-z]+'))) AS w FROM part) JOIN (VALUES ('cold'), ('bolt'), ('gear')) u(prefix) ON w = prefix")
def _(spark, d):
    units = spark.createDataFrame([("cold",), ("bolt",), ("gear",)], "prefix string")
    words = table(spark, d, "part").select("p_partkey", F.explode(F.array_distinct(F.regexp_extract_all("p_name", F.lit("[a-z]+"), 0))).alias("prefix"))
    return words.join(F.broadcast(units), "prefix").select("p_partkey", "prefix")


_NUMBERED = """WITH f AS (SELECT p_partkey, 'No. ' || CASE WHEN p_size % 2 = 0 THEN 'I-' ELSE 'c-' END || substr(upper(p_name), 1, 1 + p_partkey % 3) || p_size AS number FROM part),
 u AS (SELECT n_nationkey, 'I-' || substr(n_name, 1, 2) || n_nationkey || '~' || 'i-' || substr(n_name, 1, 1) || '9, c-S' || n_nationkey AS ranges FROM nation)"""


@R.add("j10_number_ranges", f"""{_NUMBERED}, p AS (SELECT n_nationkey, regexp_replace(unnest(regexp_extract_all(ranges, '[ICic]-[A-Za-z0-9]+')), '[0-9]+$', '') AS prefix FROM u)
 SELECT DISTINCT p_partkey, n_nationkey FROM f JOIN p ON contains(number, prefix)""")
def _(spark, d):
    size = F.col("p_size").cast("string")
    number = F.concat(F.lit("No. "), F.when(F.col("p_size") % 2 == 0, "I-").otherwise("c-"), F.substr(F.upper("p_name"), F.lit(1), (1 + F.col("p_partkey") % 3).cast("int")), size)
    key = F.col("n_nationkey").cast("string")
    ranges = F.concat(F.lit("I-"), F.substring("n_name", 1, 2), key, F.lit("~i-"), F.substring("n_name", 1, 1), F.lit("9, c-S"), key)
    facilities, units = table(spark, d, "part").select("p_partkey", number.alias("number")), table(spark, d, "nation").select("n_nationkey", ranges.alias("ranges"))
    return joins.by_number_range(facilities, units, "number", "ranges").select("p_partkey", "n_nationkey")


@R.add("j11_tree", """WITH l AS (SELECT c_nationkey, string_agg(c_name, ',' ORDER BY c_name) AS leaves FROM customer WHERE c_acctbal > 9000 GROUP BY 1), u AS (SELECT n_regionkey, n_name || ':' || coalesce(leaves, '') AS x, n_name FROM nation LEFT JOIN l ON c_nationkey = n_nationkey)
 SELECT r_name AS major, string_agg(x, ';' ORDER BY n_name) AS units FROM region LEFT JOIN u ON n_regionkey = r_regionkey GROUP BY 1""")
def _(spark, d):
    found = joins.tree(table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "customer").where("c_acctbal > 9000"), "r_regionkey", "n_nationkey", "n_regionkey", "c_nationkey", "c_name", "r_name", "n_name")
    return found.select("major", F.array_join(F.transform("units", lambda u: F.concat(u["unit"], F.lit(":"), F.array_join(u["leaves"], ","))), ";").alias("units"))


@R.add("j13_keyword_hits", "SELECT doc_id, word FROM documents JOIN (VALUES ('idiot'), ('License'), ('token')) k(word) ON contains(lower(text), lower(word))")
def _(spark, d):
    return keywords.keyword_hits(table(spark, d, "documents"), "text", spark.createDataFrame([("idiot",), ("License",), ("token",)], "word string"), "word").select("doc_id", "word")


_LONG_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]{7,}')) AS word FROM benchmark"


@R.add("j13_benchmark_words", f"SELECT doc_id, word FROM documents JOIN ({_LONG_WORDS}) ON contains(lower(text), lower(word))")
def _(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{7,}"), 0)).alias("word")).distinct()
    return keywords.keyword_hits(table(spark, d, "documents").select("doc_id", "text"), "text", words, "word").select("doc_id", "word")


@R.add("j14_change_counts", """SELECT n_name, count(DISTINCT c_custkey) AS boards, count(o_orderkey) AS changes FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON o_custkey = c_custkey GROUP BY 1""")
def _(spark, d):
    changes = table(spark, d, "orders").where("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    boards = table(spark, d, "customer").join(changes, F.col("o_custkey") == F.col("c_custkey"), "left")
    orgs = boards.join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return orgs.groupBy("n_name").agg(F.count("*").alias("boards"), F.coalesce(F.sum("n"), F.lit(0)).alias("changes"))


@R.add("j15_record_linkage", """WITH a AS (SELECT p_partkey AS a_id, p_name AS a_name, p_brand AS a_brand, p_size AS a_size FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_partkey AS b_id, p_name AS b_name, p_brand AS b_brand, p_size AS b_size FROM part WHERE p_partkey % 2 = 1),
 p AS (SELECT a_id, b_id FROM a JOIN b ON a_name = b_name UNION SELECT a_id, b_id FROM a JOIN b ON a_brand = b_brand AND a_size = b_size),
 s AS (SELECT a_id, b_id, (CASE WHEN a_name = b_name THEN 80 ELSE 0 END + CASE WHEN a_brand = b_brand THEN 50 ELSE 0 END + CASE WHEN a_size = b_size THEN 20 ELSE 0 END) AS score FROM p JOIN a USING (a_id) JOIN b USING (b_id))
 SELECT a_id, b_id, score FROM s WHERE score >= 70 QUALIFY row_number() OVER (PARTITION BY a_id ORDER BY score DESC, b_id) = 1""")
def _(spark, d):
    parts = table(spark, d, "part")
    side = lambda s, r: parts.where(f"p_partkey % 2 = {r}").select(*[F.col(f"p_{c}").alias(f"{s}_{n}") for c, n in (("partkey", "id"), ("name", "name"), ("brand", "brand"), ("size", "size"))])
    points = {c: (F.col(f"a_{c}"), F.col(f"b_{c}"), n) for c, n in (("name", 80), ("brand", 50), ("size", 20))}
    found = joins.linked_by_agreement(side("a", 0), side("b", 1), points, [("name",), ("brand", "size")], "a_id", "b_id", 70)
    return found.select("a_id", "b_id", "score")


# Windows


@R.add("w1_adjacent_pairs", "SELECT l_orderkey, l_linenumber, l_partkey, lag(l_partkey) OVER w AS previous, l_quantity - lag(l_quantity) OVER w AS change FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)")
def _(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    last = F.lag(F.struct("l_partkey", "l_quantity")).over(w)
    return table(spark, d, "lineitem").withColumn("p", last).select("l_orderkey", "l_linenumber", "l_partkey", F.col("p.l_partkey").alias("previous"), (F.col("l_quantity") - F.col("p.l_quantity")).alias("change"))


@R.add("w2_chains", """WITH f AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
 c AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS chain FROM f) SELECT user_id, chain::BIGINT AS chain, count(*) AS n, min(event_id) AS first FROM c GROUP BY 1, 2""")
def _(spark, d):
    events = table(spark, d, "events")
    gap = scans.scan(events, ["user_id"], ["ts", "event_id"], {"previous": ("lag", F.col("ts"))})
    near = F.col("ts") - F.col("previous") <= F.expr("interval 6 hours")
    return ranking.islands(gap, ["user_id"], ["ts", "event_id"], near, most=scans.MOST).groupBy("user_id", "chain").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@R.add("w3_rank_change", "SELECT c_custkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name, c_custkey))::INT AS change FROM customer")
def _(spark, d):
    w = Window.partitionBy("c_nationkey")
    return table(spark, d, "customer").select("c_custkey", (F.row_number().over(w.orderBy(F.desc("c_acctbal"), "c_custkey")) - F.row_number().over(w.orderBy("c_name", "c_custkey"))).alias("change"))


@R.add("w4_running_total", "SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS total FROM events")
def _(spark, d):
    found = ranking.running_total(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("value"), most=scans.MOST)
    return found.select("user_id", "event_id", F.round("total", 2).alias("total"))


@R.add("w4_running_total_of_all", "SELECT event_id, sum(event_id % 1000) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS total, lag(event_type) OVER (ORDER BY ts, event_id) AS previous FROM events")
def _(spark, d):
    one = table(spark, d, "events").withColumn("all", F.lit(0))  # one group: a thousand rows a task
    outs = {"total": ("sum", F.col("event_id") % 1000), "previous": ("lag", F.col("event_type"))}
    return scans.scan(one, ["all"], ["ts", "event_id"], outs, 1000).select("event_id", "total", "previous")


@R.add("w5_latest_n", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id)::INT AS rank FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 10")
def _(spark, d):
    return ranking.top_n(table(spark, d, "events"), ["user_id"], ranking.order([F.desc("ts")], "event_id"), 10).select("user_id", "event_id", "rank")


@R.add("w6_context_budget", """WITH c AS (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s FROM documents) SELECT source, count(*) AS docs, max(doc_id) AS last FROM c WHERE s <= 8000 GROUP BY 1""")
def _(spark, d):
    kept = ranking.within_budget(table(spark, d, "documents"), ["source"], ["doc_id"], F.col("n_chars"), 8000, scans.MOST)
    return kept.groupBy("source").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))


@R.add("w7_row_blocks", "SELECT l_suppkey, ((row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1) // 10)::BIGINT AS block, l_orderkey FROM lineitem")
def _(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return table(spark, d, "lineitem").select("l_suppkey", F.floor((F.row_number().over(w) - 1) / 10).alias("block"), "l_orderkey")


@R.add("w8_down_fill", "SELECT event_id, last_value(CASE WHEN event_type <> 'view' THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS event_type FROM events")
def _(spark, d):
    holes = table(spark, d, "events").withColumn("event_type", F.when(F.col("event_type") != "view", F.col("event_type")).otherwise(""))
    return ranking.filled_down(holes, ["user_id"], ["ts", "event_id"], ["event_type"], scans.MOST).select("event_id", "event_type")


@R.add("w11_min_max", "SELECT vec_id, round(CASE WHEN max(x) OVER w - min(x) OVER w < 1e-10 THEN 0.5 ELSE (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) END, 6) AS norm FROM (SELECT vec_id, label, embedding[1]::DOUBLE AS x FROM embeddings) WINDOW w AS (PARTITION BY label)")
def _(spark, d):
    scored = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding")[0].cast("double").alias("x"))
    return ranking.min_max(scored, "label", "x").select("vec_id", F.round("norm", 6).alias("norm"))


# Reports


@R.add("t1_ordered_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey < 100 ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def _(spark, d):
    return ranking.page(table(spark, d, "orders").where("o_custkey < 100"), [F.desc("o_orderdate"), F.col("o_orderkey")], 25, 50).select("o_orderkey", "o_totalprice")


@R.add("t2_most_recent", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 50")
def _(spark, d):
    return ranking.page(table(spark, d, "events"), [F.desc("ts"), F.col("event_id")], 50).select("event_id", "event_type")


@R.add("t3_error_page", "SELECT event_id, class, total FROM (SELECT *, CASE WHEN value < 20 THEN 'timeout' ELSE 'http' END AS class FROM events WHERE event_type = 'error') , (SELECT count(*) AS total FROM events WHERE event_type = 'error' AND value < 20) WHERE class = 'timeout' ORDER BY ts DESC, event_id LIMIT 20")
def _(spark, d):
    errors = table(spark, d, "events").where("event_type = 'error'").withColumn("class", F.when(F.col("value") < 20, "timeout").otherwise("http")).where("class = 'timeout'")
    return ranking.page(errors, [F.desc("ts"), F.col("event_id")], 20).crossJoin(errors.agg(F.count("*").alias("total"))).select("event_id", "class", "total")


@R.add("t4_pending_queue", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 100")
def _(spark, d):
    return ranking.page(table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderkey"), [F.col("o_orderkey")], 100)


@R.add("t5_running", "SELECT event_id, user_id FROM events WHERE event_type = 'view' AND ts > TIMESTAMP '2024-01-29' ORDER BY ts DESC")
def _(spark, d):
    return table(spark, d, "events").where("event_type = 'view' and ts > timestamp_ntz '2024-01-29 00:00:00'").orderBy(F.desc("ts")).select("event_id", "user_id")


@R.add("t8_jobs_of_type", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority = '5-LOW' ORDER BY o_orderdate DESC, o_orderkey LIMIT 10")
def _(spark, d):
    return ranking.page(table(spark, d, "orders").where("o_orderpriority = '5-LOW'"), [F.desc("o_orderdate"), F.col("o_orderkey")], 10).select("o_orderkey", "o_orderstatus")


@R.add("t9_named_order", "SELECT n_name, row_number() OVER (ORDER BY n_name)::INT AS pos FROM nation")
def _(spark, d):
    return table(spark, d, "nation").withColumn("pos", F.row_number().over(Window.orderBy(F.collate("n_name", "UTF8_BINARY")))).select("n_name", "pos")


@R.add("t10_rejoined_fragments", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text, arg_min(role, turn) AS first_role, count(*) AS parts FROM conversations GROUP BY 1")
def _(spark, d):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(parts, "\n").alias("text"), F.min_by("role", "turn").alias("first_role"), F.count("*").alias("parts"))


@R.add("t11_repeating_classes", """WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)[ >]', 1)) AS class FROM pages), c AS (SELECT page_id, class, count(*) AS n FROM t WHERE length(class) BETWEEN 1 AND 29 AND class NOT IN ('br') GROUP BY 1, 2 HAVING count(*) BETWEEN 3 AND 100)
 SELECT page_id, class, n, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, class)::INT AS rank FROM c QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, class) <= 10""")
def _(spark, d):
    tokens = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)[ >]"), 1)).alias("class"))
    counts = tokens.where("length(class) between 1 and 29 and class not in ('br')").groupBy("page_id", "class").agg(F.count("*").alias("n")).where("n between 3 and 100")
    return ranking.top_n(counts, ["page_id"], [F.desc("n"), F.col("class")], 10)


# Sets and versions


@R.add("s2_union_all", "SELECT doc_id, 'a' AS q FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, 'b' FROM documents WHERE n_chars > 3000")
def _(spark, d):
    docs = table(spark, d, "documents")
    return docs.where("lang = 'en'").select("doc_id", F.lit("a").alias("q")).unionByName(docs.where("n_chars > 3000").select("doc_id", F.lit("b").alias("q")))


@R.add("s4_except_existing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@R.add("s5_union_schemas", "SELECT doc_id AS id, lang, NULL::VARCHAR AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages")
def _(spark, d):
    docs, pages = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang"), table(spark, d, "pages").select(F.col("page_id").alias("id"), "url")
    return docs.unionByName(pages, allowMissingColumns=True)


@R.add("s7_ingest_dedup", """WITH k AS (SELECT page_id, substr(sha256(regexp_replace(regexp_replace(url, '^https?://(www\\.)?', ''), '[?#].*$', '')), 1, 16) AS key FROM pages) SELECT 'doc_p_' || key AS doc_id, min(page_id) AS page_id, count(*) AS copies FROM k GROUP BY 1""")
def _(spark, d):
    key = F.substring(F.sha2(F.regexp_replace(F.regexp_replace("url", r"^https?://(www\.)?", ""), r"[?#].*$", ""), 256), 1, 16)
    return table(spark, d, "pages").groupBy(F.concat(F.lit("doc_p_"), key).alias("doc_id")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))


@R.add("s8_upsert_latest", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def _(spark, d):
    return ranking.latest_version(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@R.add("s9_replace_chunks", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_orderkey % 10 <> 0 UNION ALL SELECT l_orderkey, l_partkey, l_quantity + 1 FROM lineitem WHERE l_orderkey % 10 = 0")
def _(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    store = Buckets(spark, fresh_path(spark, "chunks"), "l_orderkey", 16).create(items)
    store.upsert(items.where("l_orderkey % 10 = 0").withColumn("l_quantity", F.col("l_quantity") + 1))
    return store.read()


@R.add("s9_chunks_removed", "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey % 10 <> 0 GROUP BY 1")
def _(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    store = Buckets(spark, fresh_path(spark, "chunks"), "l_orderkey", 16).create(items)
    store.delete(items.where("l_orderkey % 10 = 0"))
    return store.read().groupBy("l_orderkey").agg(F.count("*").alias("n"))


@R.add("i9_upsert_vectors", "SELECT count(*) FILTER (label > 5) AS added, count(*) FILTER (label IN (4, 5)) AS updated, count(*) AS total FROM embeddings")
def _(spark, d):
    v = table(spark, d, "embeddings")
    store = Buckets(spark, fresh_path(spark, "vectors"), "vec_id", 16).create(v.where("label <= 5"))
    counts = store.upsert(v.where("label >= 4 and embedding is not null"))
    return store.read().agg(F.lit(counts["added"]).cast("long").alias("added"), F.lit(counts["replaced"]).cast("long").alias("updated"), F.count("*").alias("total"))


@R.add("i10_bulk_upsert", "SELECT vec_id, CASE WHEN label >= 4 THEN label + 100 ELSE label END AS label, lang FROM embeddings LEFT JOIN documents ON doc_id = vec_id")
def _(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label")
    merged = ranking.upsert(v.where("label <= 5"), v.where("label >= 4").withColumn("label", F.col("label") + 100), ["vec_id"])
    return merged.join(table(spark, d, "documents"), F.col("doc_id") == F.col("vec_id"), "left").select("vec_id", "label", "lang")


@R.add("i12_sync_fallback", "SELECT vec_id, coalesce(lang, split_part('doc_' || vec_id || '_zz', '_', -1)) AS lang, coalesce(source, split_part('doc_' || vec_id || '_zz', '_', -2)) AS source FROM embeddings LEFT JOIN (SELECT * FROM documents WHERE doc_id % 2 = 0) ON doc_id = vec_id")
def _(spark, d):
    parts = F.split(F.concat(F.lit("doc_"), F.col("vec_id").cast("string"), F.lit("_zz")), "_")
    joined = table(spark, d, "embeddings").join(table(spark, d, "documents").where("doc_id % 2 = 0"), F.col("doc_id") == F.col("vec_id"), "left")
    return joined.select("vec_id", F.coalesce("lang", F.element_at(parts, -1)).alias("lang"), F.coalesce("source", F.element_at(parts, -2)).alias("source"))
