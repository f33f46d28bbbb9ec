"""Statistics: orders stand for documents of boards (customers), line items for attachments, events for run logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import stats
from sparkloom.plans.registry import Registry, table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
AS_OF = "2024-01-20 12:00:00"
ORDERS_AS_OF = "2000-06-30 00:00:00"


@R.add("a1_global_counts", "SELECT (SELECT count(*) FROM orders) AS documents, (SELECT count(DISTINCT o_custkey) FROM orders) AS boards, count(*) AS attachments, count(*) FILTER (l_linestatus = 'O') AS pending FROM lineitem")
def _(spark, d):
    return stats.global_counts(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_custkey", F.col("l_linestatus") == "O")


@R.add("a2_status_summary", f"""SELECT count(*) AS total, count(*) FILTER (ts::DATE = DATE '2024-01-20') AS today, count(*) FILTER (event_type = 'view') AS running,
 round(100.0 * count(*) FILTER (event_type = 'error' AND r) / count(*) FILTER (r), 1) AS failure_rate, round(sum(value), 2) AS bytes
 FROM (SELECT *, ts BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND TIMESTAMP '{AS_OF}' AS r FROM events)""")
def _(spark, d):
    return stats.status_summary(table(spark, d, "events"), "ts", F.col("event_type") == "error", F.col("event_type") == "view", F.col("value"), AS_OF)


def _timeline(unit, key, calendar):
    both = f"""WITH a AS (SELECT {key.format('o_orderdate')} AS bucket, count(*) AS n FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1998-01-31' AND DATE '1998-12-15' GROUP BY 1),
 b AS (SELECT {key.format('l_shipdate')} AS bucket, count(*) AS n FROM lineitem WHERE l_shipdate::DATE BETWEEN DATE '1998-01-31' AND DATE '1998-12-15' GROUP BY 1), c AS ({calendar})
 SELECT c.bucket, coalesce(a.n, 0) AS documents, coalesce(b.n, 0) AS attachments FROM c LEFT JOIN a USING (bucket) LEFT JOIN b USING (bucket)"""

    @R.add(f"a3_timeline_{unit}", both)
    def _(spark, d):
        return stats.timeline(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderdate", "l_shipdate", "1998-01-31", "1998-12-15", unit)


_timeline("day", "strftime({}, '%Y-%m-%d')", "SELECT strftime(x, '%Y-%m-%d') AS bucket FROM generate_series(TIMESTAMP '1998-01-31', TIMESTAMP '1998-12-15', INTERVAL 1 DAY) t(x)")
_timeline("month", "strftime({}, '%Y-%m')", "SELECT strftime(x, '%Y-%m') AS bucket FROM generate_series(TIMESTAMP '1998-01-01', TIMESTAMP '1998-12-15', INTERVAL 1 MONTH) t(x)")
_timeline("week", "strftime({}, '%Y-W%W')", "SELECT bucket FROM a UNION SELECT bucket FROM b")


@R.add("a4_type_stats", "SELECT lower(event_type) AS type, count(*) AS n, round(sum(value), 2) AS bytes, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS share FROM events GROUP BY 1")
def _(spark, d):
    return stats.type_stats(table(spark, d, "events"), F.col("event_type"), F.col("value"))


@R.add("a5_board_stats", f"""WITH f AS (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice) AS b FROM lineitem GROUP BY 1)
 SELECT o_custkey, o_orderstatus, count(*) AS documents, strftime(max(o_orderdate), '%Y-%m-%d') AS last_seen, count(*) FILTER (o_orderdate >= TIMESTAMP '{ORDERS_AS_OF}' - INTERVAL 7 DAY) AS recent,
 coalesce(sum(n), 0)::BIGINT AS attachments, round(coalesce(sum(b), 0), 2) AS bytes FROM orders LEFT JOIN f ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def _(spark, d):
    return stats.board_stats(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", ["o_custkey", "o_orderstatus"], "o_orderdate", F.col("l_extendedprice"), ORDERS_AS_OF)


@R.add("a6_board_daily", "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS runs, count(*) FILTER (event_type <> 'error') AS succeeded, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 1) AS success_rate, round(sum(CASE WHEN event_type <> 'error' THEN value ELSE 0 END), 2) AS amount FROM events WHERE ts >= TIMESTAMP '2024-01-01' GROUP BY 1, 2")
def _(spark, d):
    runs = table(spark, d, "events").where("ts >= timestamp_ntz '2024-01-01 00:00:00'").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return stats.success_rates(runs, ["user_id", "day"], F.col("event_type") != "error", F.col("value"))


@R.add("a7_success_rate", "SELECT user_id, count(*) AS runs, count(*) FILTER (event_type <> 'error') AS succeeded, round(100.0 * count(*) FILTER (event_type <> 'error') / count(*), 1) AS success_rate, round(sum(CASE WHEN event_type <> 'error' THEN value ELSE 0 END), 2) AS amount FROM events GROUP BY 1")
def _(spark, d):
    return stats.success_rates(table(spark, d, "events"), ["user_id"], F.col("event_type") != "error", F.col("value"))


_CLASS_SQL = "CASE WHEN value < 20 THEN 'timeout' WHEN value < 60 THEN 'http' WHEN value < 120 THEN 'network' ELSE 'unknown' END"


@R.add("a8_error_stats", f"""WITH e AS (SELECT *, {_CLASS_SQL} AS class FROM events WHERE event_type = 'error'),
 l AS (SELECT user_id, {_CLASS_SQL} AS class FROM events WHERE event_type = 'error' QUALIFY true), m AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events),
 p AS (SELECT {_CLASS_SQL} AS class, count(DISTINCT user_id) AS pending FROM m WHERE k = 1 AND event_type = 'error' GROUP BY 1),
 c AS (SELECT class, count(*) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY) AS last_day, count(*) FILTER (ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS last_week FROM e GROUP BY 1)
 SELECT n.class, coalesce(last_day, 0) AS last_day, coalesce(last_week, 0) AS last_week, coalesce(pending, 0) AS pending FROM (VALUES ('timeout'), ('http'), ('parsing'), ('network'), ('dom'), ('unknown')) n(class) LEFT JOIN c USING (class) LEFT JOIN p USING (class)""")
def _(spark, d):
    v = F.col("value")
    of = F.when(v < 20, "timeout").when(v < 60, "http").when(v < 120, "network").otherwise("unknown")
    return stats.error_stats(table(spark, d, "events"), "user_id", "ts", F.col("event_type") == "error", of, ["timeout", "http", "parsing", "network", "dom", "unknown"], AS_OF)


@R.add("a9_distribution", "SELECT coalesce(source, 'unknown') AS value, count(*) AS n FROM documents GROUP BY 1")
def _(spark, d):
    return stats.distribution(table(spark, d, "documents"), "source")


@R.add("a10_profile_distribution", "SELECT coalesce(c_mktsegment, 'unknown') AS value, count(*) AS n FROM customer GROUP BY 1")
def _(spark, d):
    return stats.distribution(table(spark, d, "customer"), "c_mktsegment")


@R.add("a11_tag_counts", "SELECT tag, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS tag FROM part) GROUP BY 1")
def _(spark, d):
    return stats.tag_counts(table(spark, d, "part"), F.split("p_name", " "))


@R.add("a12_facets", """SELECT o_orderstatus AS org, o_orderpriority AS board, CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END AS kind, grouping_id(org, board, kind)::INT AS level, count(*) AS n,
 min(strftime(o_orderdate, '%Y-%m')) AS first_month, max(strftime(o_orderdate, '%Y-%m')) AS last_month FROM orders GROUP BY GROUPING SETS ((org), (org, board), (kind), ())""")
def _(spark, d):
    orders = table(spark, d, "orders").withColumn("size", F.when(F.col("o_totalprice") > 200000, "large").otherwise("small"))
    return stats.facet_stats(orders, "o_orderstatus", "o_orderpriority", "size", F.date_format("o_orderdate", "yyyy-MM"))


@R.add("a13_progress", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus = 'P') AS failed, round(sum(o_totalprice), 2) AS amount, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*))::INT AS done_rate, round(100.0 * count(*) FILTER (o_orderstatus = 'P') / count(*))::INT AS failed_rate, round(100.0 * count(*) FILTER (o_orderstatus NOT IN ('F', 'P')) / count(*))::INT AS open_rate FROM orders")
def _(spark, d):
    return stats.progress_stats(table(spark, d, "orders"), "o_orderstatus", "F", "P", F.col("o_totalprice"))


@R.add("a14_chunk_rollup", "SELECT l_orderkey, count(*) AS chunks, count(*) FILTER (l_returnflag = 'N') AS text_chunks, count(*) FILTER (l_returnflag <> 'N') AS table_chunks, sum(l_quantity::BIGINT)::BIGINT AS tokens FROM lineitem GROUP BY 1")
def _(spark, d):
    is_text = F.col("l_returnflag") == "N"
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("chunks"), F.count_if(is_text).alias("text_chunks"), F.count_if(~is_text).alias("table_chunks"), F.sum(F.col("l_quantity").cast("long")).alias("tokens"))


@R.add("a15_hierarchy", """SELECT r_name, n_name, c_mktsegment, grouping_id(r_name, n_name, c_mktsegment)::INT AS level, count(*) AS files, round(sum(c_acctbal), 2) AS bytes
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""")
def _(spark, d):
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = table(spark, d, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return stats.hierarchy_totals(joined, ["r_name", "n_name", "c_mktsegment"], F.col("c_acctbal"))


@R.add("a16_cost_history", """WITH c AS (SELECT strftime(x, '%Y-%m-%d') AS bucket FROM generate_series(TIMESTAMP '2024-01-05', TIMESTAMP '2024-02-03', INTERVAL 1 DAY) t(x)),
 u AS (SELECT strftime(ts, '%Y-%m-%d') AS bucket, count(*) AS requests, sum(value) AS cost, count(DISTINCT event_type) AS models FROM events WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-02-03' GROUP BY 1)
 SELECT bucket, coalesce(requests, 0) AS requests, coalesce(models, 0) AS models, round(coalesce(cost, 0), 2) AS cost, round(sum(coalesce(cost, 0)) OVER (ORDER BY bucket), 2) AS running_cost FROM c LEFT JOIN u USING (bucket)""")
def _(spark, d):
    return stats.cost_history(table(spark, d, "events"), "ts", "event_type", "value", "2024-01-05", "2024-02-03")


@R.add("a17_model_totals", f"SELECT event_type AS model, count(*) AS requests, round(sum(value), 2) AS total, round(sum(CASE WHEN ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN value ELSE 0 END), 2) AS week, round(sum(CASE WHEN ts >= TIMESTAMP '2024-01-01' THEN value ELSE 0 END), 2) AS month FROM events GROUP BY 1")
def _(spark, d):
    return stats.model_totals(table(spark, d, "events"), "ts", "event_type", "value", AS_OF)


@R.add("a18_usage_meter", "SELECT strftime(ts, '%Y-%m') AS month, round(sum(CASE WHEN event_type = 'click' THEN value * 1000 / 1e6 * 2.5 ELSE 0 END), 6) AS click, round(sum(CASE WHEN event_type = 'view' THEN value * 1000 / 1e6 * 0.5 ELSE 0 END), 6) AS view FROM events WHERE event_type IN ('click', 'view') GROUP BY 1")
def _(spark, d):
    rates = spark.createDataFrame([("click", 2.5), ("view", 0.5)], "provider string, rate double")
    return stats.usage_meter(table(spark, d, "events"), "ts", "event_type", ["click", "view"], F.col("value") * 1000, rates)


@R.add("a19_running_stats", "SELECT count(*) FILTER (event_type <> 'error') AS processed, count(*) FILTER (event_type = 'error') AS failed, sum(user_id)::BIGINT AS tokens, round(sum(user_id) / 1e6 * 0.13, 6) AS cost FROM events")
def _(spark, d):
    return stats.running_stats(table(spark, d, "events"), F.col("event_type") != "error", F.col("user_id"), 0.13)


@R.add("a21_facility_summary", """WITH u AS (SELECT l_suppkey AS process, 'emission' AS kind FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT l_suppkey, 'other' FROM lineitem WHERE l_returnflag = 'N' UNION ALL SELECT l_suppkey, 'prevention' FROM lineitem WHERE l_returnflag = 'R')
 SELECT process, count(*) FILTER (kind = 'emission') AS emission, count(*) FILTER (kind = 'other') AS other, count(*) FILTER (kind = 'prevention') AS prevention, count(*) AS total FROM u GROUP BY 1""")
def _(spark, d):
    items = table(spark, d, "lineitem")
    kinds = {"emission": "A", "other": "N", "prevention": "R"}
    parts = [items.where(F.col("l_returnflag") == v).select(F.col("l_suppkey").alias("process"), F.lit(k).alias("kind")) for k, v in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("process").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds], F.count("*").alias("total"))


@R.add("a22_zero_filled", "SELECT s.c_mktsegment, count(c.c_custkey) AS n FROM (SELECT DISTINCT c_mktsegment FROM customer) s LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9500) c USING (c_mktsegment) GROUP BY 1")
def _(spark, d):
    customers = table(spark, d, "customer")
    return stats.zero_filled(customers, customers.where("c_acctbal > 9500"), "c_mktsegment")


@R.add("a23_nested_sizes", "SELECT l_orderkey, len(list(l_partkey)) AS parts, bool_or(l_quantity > 45) AS has_large, count(*) FILTER (l_returnflag = 'R') AS returned FROM lineitem GROUP BY 1")
def _(spark, d):
    nested = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_quantity", "l_returnflag")).alias("items"))
    returned = F.size(F.filter("items", lambda x: x["l_returnflag"] == "R")).cast("long")
    return nested.select("l_orderkey", F.size("items").cast("long").alias("parts"), F.exists("items", lambda x: x["l_quantity"] > 45).alias("has_large"), returned.alias("returned"))


@R.add("a24_session_listing", "SELECT user_id, count(*) AS items, count(DISTINCT event_type) AS kinds, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest FROM events GROUP BY 1 ORDER BY newest DESC, user_id LIMIT 20")
def _(spark, d):
    sessions = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("items"), F.countDistinct("event_type").alias("kinds"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("newest"))
    return sessions.orderBy(F.desc("newest"), "user_id").limit(20)


@R.add("a25_group_schedules", "SELECT p_type, array_to_string(list_sort(list_distinct(flatten(list(string_split(p_name, ' '))))), ',') AS targets, array_to_string(list_sort(list(p_brand)), ',') AS names FROM part GROUP BY 1")
def _(spark, d):
    found = stats.group_by_key(table(spark, d, "part").withColumn("words", F.split("p_name", " ")), "p_type", "words", "p_brand")
    return found.select("p_type", F.array_join("targets", ",").alias("targets"), F.array_join("names", ",").alias("names"))


@R.add("a26_cost_estimate", "SELECT model, tokens, round(tokens / 1e6 * rate, 6) AS cost FROM (SELECT sum(ceil(length(text) / 4))::BIGINT AS tokens FROM documents), (VALUES ('small', 0.02::DOUBLE), ('large', 0.13)) r(model, rate)")
def _(spark, d):
    rates = spark.createDataFrame([("small", 0.02), ("large", 0.13)], "model string, rate double")
    return stats.cost_estimate(table(spark, d, "documents"), F.ceil(F.char_length("text") / 4), rates)


@R.add("a27_first_sources", """WITH s AS (SELECT lang, source, min(doc_id) AS p FROM documents GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY p, source) AS k FROM s)
 SELECT lang, string_agg(source, ',' ORDER BY k) AS sources FROM t WHERE k <= 5 GROUP BY 1""")
def _(spark, d):
    return stats.first_distinct(table(spark, d, "documents"), "lang", "source", "doc_id").select("lang", F.array_join("values", ",").alias("sources"))


@R.add("a28_primary_method", """WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)
 SELECT user_id, event_type AS mode, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""")
def _(spark, d):
    return stats.most_common(table(spark, d, "events"), "user_id", "event_type", "event_id")


@R.add("a29_executive_summary", "SELECT count(*) AS total, count(*) FILTER (value > 0.7 * 500) AS high_priority, count(*) FILTER (value <= 0.7 * 500) AS remainder FROM events")
def _(spark, d):
    high = F.col("value") > 0.7 * 500
    return table(spark, d, "events").agg(F.count("*").alias("total"), F.count_if(high).alias("high_priority"), F.count_if(~high).alias("remainder"))


@R.add("a30_storage_inventory", """WITH k AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS org, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS board FROM pages)
 SELECT org, board, grouping_id(org, board)::INT AS level, count(*) AS files FROM k GROUP BY ROLLUP (org, board)""")
def _(spark, d):
    keys = table(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("org"), F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1).alias("board"))
    return keys.rollup("org", "board").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("files"))


@R.add("a31_format_stats", """SELECT CASE l_returnflag WHEN 'A' THEN 'archive' WHEN 'N' THEN 'text' ELSE 'other' END AS format, count(*) AS total, count(*) FILTER (l_linestatus = 'F') AS success, count(*) FILTER (l_linestatus <> 'F') AS failed,
 round(100.0 * count(*) FILTER (l_linestatus = 'F') / count(*), 1) AS success_rate FROM lineitem GROUP BY 1""")
def _(spark, d):
    family = F.coalesce(F.create_map(F.lit("A"), F.lit("archive"), F.lit("N"), F.lit("text"))[F.col("l_returnflag")], F.lit("other"))
    ok = F.col("l_linestatus") == "F"
    return table(spark, d, "lineitem").groupBy(family.alias("format")).agg(F.count("*").alias("total"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"), stats.share(F.count_if(ok), F.count("*")).alias("success_rate"))
