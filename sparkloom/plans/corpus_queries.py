"""Chunks and tables: documents as texts, orders and nations as tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import chunking, classify, tables
from sparkloom.plans.registry import Registry, table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


def _chunks(name, strategy, size, overlap):
    @R.add(name)
    def _(spark, d):
        return chunking.chunked(table(spark, d, "documents"), strategy=strategy, size=size, overlap=overlap)


_chunks("c1_chunked", "recursive", 800, 0)
_chunks("c2_recursive", "recursive", 200, 20)
_chunks("c3_sentences", "sentence", 200, 30)
_chunks("c4_blocks", "block", 200, 30)
_chunks("c5_headers", "header", 200, 0)


@R.add("c36_character_chunks")
def _(spark, d):
    return chunking.chunked_by(table(spark, d, "documents"), chunking.by_characters, "content:string")


@R.add("c37_token_budget")
def _(spark, d):
    return chunking.chunked_by(table(spark, d, "documents"), chunking.by_token_budget, "content:string,table_group:int,continued:boolean")


@R.add("c3b_sentence_counts", "SELECT doc_id, len(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS sentences FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(F.split("text", r"(?<=[.!?])\s+", -1)).cast("long").alias("sentences"))


def _orders_as_table(spark, d):
    """rows of one table for each customer: header and the orders as strings."""
    row = F.struct("o_orderkey", F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("cells"))
    body = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["cells"])
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.concat(F.array(F.array(F.lit("key"), F.lit("status"), F.lit("date"))), body).alias("rows"))


_ROW = "'| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || strftime(o_orderdate, '%Y-%m-%d') || ' |'"
_MARKDOWN = f"SELECT o_custkey, '| key | status | date |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg({_ROW}, chr(10) ORDER BY o_orderkey) AS markdown FROM orders GROUP BY 1"


@R.add("c15_markdown", _MARKDOWN)
def _(spark, d):
    return _orders_as_table(spark, d).select("o_custkey", tables.to_markdown(F.col("rows")).alias("markdown"))


@R.add("c9_parsed_markdown", "SELECT o_custkey, count(*) + 1 AS n, 'key|status|date' AS header, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1")
def _(spark, d):
    rows = tables.parse_markdown(tables.to_markdown(F.col("rows")))
    parsed = _orders_as_table(spark, d).select("o_custkey", rows.alias("rows"))
    return parsed.select("o_custkey", F.size("rows").cast("long").alias("n"), F.array_join(F.col("rows")[0], "|").alias("header"), F.array_join(F.transform(F.slice("rows", 2, F.size("rows")), lambda r: r[0]), ",").alias("keys"))


@R.add("c8_table_blocks", f"""WITH r AS (SELECT o_custkey, o_orderkey, {_ROW} AS line, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 10 AS block FROM orders)
 SELECT o_custkey, block::BIGINT AS block, '| key | status | date |' || chr(10) || string_agg(line, chr(10) ORDER BY o_orderkey) AS content, block = 0 AS first FROM r GROUP BY o_custkey, block""")
def _(spark, d):
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("o_orderkey").cast("string"), "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM-dd")), F.lit(" |"))
    block = F.floor((F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1) / 10)
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", line.alias("line"), block.alias("block"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda r: r["line"]), "\n")
    return rows.groupBy("o_custkey", "block").agg(F.concat(F.lit("| key | status | date |\n"), lines).alias("content")).withColumn("first", F.col("block") == 0)


@R.add("c13_merged_cells", "SELECT n_nationkey, r AS row, c AS col, CASE WHEN r = 0 AND c = 0 THEN n_name ELSE '' END AS text FROM nation, range(0, 3) a(r), range(0, 4) b(c) WHERE r < 1 + n_nationkey % 3 AND c < 1 + n_nationkey % 4")
def _(spark, d):
    cells = table(spark, d, "nation").select("n_nationkey", F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("col"), (1 + F.col("n_nationkey") % 3).alias("rs"), (1 + F.col("n_nationkey") % 4).alias("cs"), F.col("n_name").alias("text"))
    return tables.expanded(cells, "n_nationkey", "row", "col", "rs", "cs", "text")


@R.add("c14_valid_tables", "SELECT l_orderkey, count(*) >= 2 AND count(*) FILTER (l_returnflag <> 'N') + count(*) >= 0.6 * 2 * count(*) AS valid FROM lineitem GROUP BY 1")
def _(spark, d):
    row = F.array(F.col("l_partkey").cast("string"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(row).alias("rows")).select("l_orderkey", tables.valid(F.col("rows"), 2, 2, 0.6).alias("valid"))


@R.add("c20_column_kinds", "SELECT o_custkey, c AS col, CASE c WHEN 0 THEN 'numeric' WHEN 1 THEN 'date' WHEN 2 THEN 'percentage' ELSE 'text' END AS kind FROM (SELECT DISTINCT o_custkey FROM orders), range(0, 4) t(c)")
def _(spark, d):
    cells = F.array(F.col("o_totalprice").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit("%")), F.col("o_orderstatus"))
    each = table(spark, d, "orders").select("o_custkey", F.posexplode(cells).alias("col", "text")).withColumn("col", F.col("col").cast("long"))
    return tables.column_kinds(each, "o_custkey", "col", "text")


@R.add("c21_position_score", """WITH x AS (SELECT p_partkey, p_size * 1.5 AS l1, 300.0 + p_partkey % 50 AS r1, 600.0 + p_size * 4 AS bottom, 20.0 AS l2, 310.0 AS r2, p_size * 10.0 AS top, CASE WHEN p_partkey % 9 > 0 THEN 800.0 END AS h FROM part)
 SELECT p_partkey, round(CASE WHEN h IS NULL THEN 0.5 ELSE least(1.0, CASE WHEN bottom >= h * 0.85 THEN 0.4 ELSE 0 END + CASE WHEN top <= h * 0.15 THEN 0.4 ELSE 0 END
  + 0.2 * (least(r1, r2) - greatest(l1, l2)) / (greatest(r1, r2) - least(l1, l2))) END, 6)::DOUBLE AS score FROM x""")
def _(spark, d):
    size = F.col("p_size").cast("double")
    first = F.array(size * 1.5, F.lit(50.0), 300.0 + F.col("p_partkey") % 50, 600.0 + size * 4)
    second = F.array(F.lit(20.0), size * 10, F.lit(310.0), F.lit(790.0))
    height = F.when(F.col("p_partkey") % 9 > 0, 800.0)
    return table(spark, d, "part").select("p_partkey", F.round(tables.position_score(first, second, height), 6).alias("score"))


@R.add("c24_linearized", "SELECT n_nationkey, 'key: ' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN ' | name: ' || n_name ELSE '' END || ' | region: ' || n_regionkey AS line FROM nation")
def _(spark, d):
    headers = F.array(F.lit("key"), F.lit("name"), F.lit("region"))
    row = F.array(F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(""), F.col("n_regionkey").cast("string"))
    return table(spark, d, "nation").select("n_nationkey", tables.linearized(headers, row).alias("line"))


@R.add("c39_records", "SELECT n_nationkey, n_name AS name, n_regionkey::VARCHAR AS region FROM nation")
def _(spark, d):
    m = tables.records(F.array(F.lit("name"), F.lit("region")), F.array("n_name", F.concat(F.col("n_regionkey").cast("string"), F.lit(".0")), F.lit("extra")))
    return table(spark, d, "nation").select("n_nationkey", m["name"].alias("name"), m["region"].alias("region"))


@R.add("c26_mapped_fields", "SELECT p_partkey, p_brand AS brand, p_retailprice AS price, NULL::VARCHAR AS missing FROM part")
def _(spark, d):
    fields = tables.mapped(F.array(F.lit("Part Brand"), F.lit("Retail Price")), F.array("p_brand", F.col("p_retailprice").cast("string")), {"brand": ["brand"], "price": ["cost", "price"], "missing": ["weight"]})
    return table(spark, d, "part").select("p_partkey", fields["brand"].alias("brand"), fields["price"].cast("double").alias("price"), fields["missing"].alias("missing"))


@R.add("c25_table_types", "SELECT p_type, CASE WHEN contains(lower(p_type), 'promo') THEN 'offer' WHEN contains(lower(p_type), 'eco') OR contains(lower(p_type), 'std') THEN 'plain' ELSE 'unknown' END AS kind, count(*) AS n FROM part GROUP BY 1, 2")
def _(spark, d):
    rules = [("offer", ["promo"], []), ("plain", [], ["eco", "std"])]
    return table(spark, d, "part").select("p_type", classify.first_rule(F.array(F.lower("p_type"), F.lit("size")), rules).alias("kind")).groupBy("p_type", "kind").agg(F.count("*").alias("n"))


@R.add("c38_side_by_side", "SELECT n_nationkey AS sheet, unnest([1, 2])::INT AS span, unnest([0, 3])::BIGINT AS first, unnest([1, 3])::BIGINT AS last FROM nation")
def _(spark, d):
    row = F.array("n_name", F.col("n_regionkey").cast("string"), F.lit(""), F.lit("x"), F.lit(" "))
    cells = table(spark, d, "nation").select(F.col("n_nationkey").alias("sheet"), F.lit(0).alias("row"), F.posexplode(row).alias("col", "text")).withColumn("col", F.col("col").cast("long"))
    return tables.separators(cells, "sheet", "row", "col", "text")


def _pages(spark, d):
    """Each customer's table split into pages of four rows, under the same header."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, d, "orders").withColumn("page_num", F.floor((F.row_number().over(w) - 1) / 4).cast("int"))
    row = F.struct("o_orderkey", F.array(F.col("o_orderkey").cast("string"), "o_orderstatus").alias("cells"))
    body = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["cells"])
    return rows.groupBy(F.col("o_custkey").alias("doc_id"), "page_num").agg(F.concat(F.array(F.array(F.lit("key"), F.lit("status"))), body).alias("rows")).withColumn("table_index", F.lit(0))


@R.add("c23_merged_across_pages", "SELECT o_custkey AS doc_id, 1::BIGINT AS chain, 0 AS first_page, ceil(count(*) / 4)::INT AS parts, (count(*) + 1)::INT AS n_rows, (ceil(count(*) / 4) - 1)::INT AS removed_headers, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1")
def _(spark, d):
    found = tables.merged_across_pages(_pages(spark, d))
    keys = F.array_join(F.transform(F.slice("rows", 2, F.size("rows")), lambda r: r[0]), ",")
    return found.select("doc_id", "chain", "first_page", "parts", F.size("rows").alias("n_rows"), "removed_headers", keys.alias("keys"))


# Four orders a page; pages of even customers change the kind of a column, some change its header, lie apart, or are placed on the page.
_CONTINUITY = """WITH r AS (SELECT o_custkey AS c, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS p FROM orders),
 s AS (SELECT DISTINCT c AS doc_id, p AS page, 1 + c % 3 AS gap, ((c + p) % 3 = 0) = ((c + p - 1) % 3 = 0) AS repeated, CASE WHEN c % 2 = 0 THEN 0.5 ELSE 1 END AS pattern,
  CASE WHEN c % 4 = 0 THEN CASE WHEN p % 2 = 1 THEN 0.4 ELSE 0 END + 0.4 + 0.2 * 0.98 ELSE 0.5 END AS position FROM r WHERE p > 0),
 t AS (SELECT *, CASE WHEN gap > 2 THEN 0 ELSE (0.3 + 0.25 * CASE WHEN repeated THEN 1 ELSE 0.625 END + 0.2 * position + 0.15 * pattern + CASE WHEN repeated THEN 0.1 ELSE 0 END) * pow(0.9, gap - 1) END AS score FROM s)
 SELECT doc_id, page::INT AS page, repeated, round(score, 6)::DOUBLE AS score, round(score, 6) >= 0.7 OR (round(score, 6) >= 0.595 AND (repeated OR gap = 1)) AS accepted FROM t"""


@R.add("c19_continuity", _CONTINUITY)
def _(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    c, p = F.col("o_custkey"), F.col("p")
    rows = table(spark, d, "orders").withColumn("p", F.floor((F.row_number().over(w) - 1) / 4).cast("int"))
    second = F.when((c % 2 == 0) & (p % 2 == 1), F.floor("o_totalprice").cast("string")).otherwise(F.col("o_orderstatus"))
    head = F.array(F.array(F.lit("key"), F.when((c + p) % 3 == 0, "total").otherwise("status")))
    body = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", F.array(F.col("o_orderkey").cast("string"), second).alias("cells")))), lambda r: r["cells"])
    pages = rows.groupBy("o_custkey", "p").agg(body.alias("body")).withColumn("rows", F.concat(head, "body"))
    left = (10 * (p % 2)).cast("double")
    box = F.when(c % 4 == 0, F.array(left, F.lit(100.0), F.lit(500.0), F.when(p % 2 == 0, 800.0).otherwise(500.0)))
    pages = pages.withColumn("own", F.struct((p * (1 + c % 3)).alias("page"), "rows", box.alias("box"))).withColumn("height", F.lit(900.0))
    pages = pages.withColumn("before", F.lag("own").over(Window.partitionBy("o_custkey").orderBy("p"))).where("before is not null")
    found = tables.continuity(pages, "before", "own", "height")
    return found.select(c.alias("doc_id"), p.alias("page"), F.col("continuity.repeated").alias("repeated"), F.round("continuity.score", 6).alias("score"), F.col("continuity.accepted").alias("accepted"))


@R.add("c22_duplicate_headers", "SELECT o_custkey, count(*) FILTER (o_orderkey % 3 = 0)::INT AS removed_headers, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1")
def _(spark, d):
    row = F.array(F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"))
    each = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.array(F.lit(" KEY"), F.lit("total  Price")), row)).otherwise(F.array(row))  # a header again before every third key
    rows = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", each.alias("r")))), lambda x: x["r"]))
    found = table(spark, d, "orders").groupBy("o_custkey").agg(rows.alias("rows")).withColumn("head", F.array(F.array(F.lit("key"), F.lit("total price"))))
    found = tables.without_duplicate_headers(found, "rows", "head", F.lit(False))
    return found.select("o_custkey", "removed_headers", F.array_join(F.transform("rows", lambda r: r[0]), ",").alias("keys"))


@R.add("c18_signature_scores")
def _(spark, d):
    names = lambda s: tables.signature(F.array("p_name", "p_type", F.lit(s))).alias("sig")
    a = table(spark, d, "part").select("p_partkey", "p_size", names("Price ($)"))
    w = Window.partitionBy("p_size").orderBy("p_partkey")
    pairs = a.withColumn("before", F.lag("sig").over(w)).where("before is not null")
    return tables.signature_score(pairs, "before", "sig").select("p_partkey", F.round("score", 6).alias("score"))


@R.add("c10_normalized_tables", f"WITH m AS ({_MARKDOWN}) SELECT o_custkey, 0 AS table_index, markdown FROM m WHERE length(markdown) > 0")
def _(spark, d):
    texts = _orders_as_table(spark, d).select("o_custkey", F.concat(F.lit("before\n"), tables.to_markdown(F.col("rows")), F.lit("\nafter")).alias("text"))
    return tables.normalized_tables(texts, "o_custkey", "text").select("o_custkey", "table_index", "markdown")


# A text of each customer with orders: a tagged piped table of them, for each third an untagged one, a tagged list.
def _with_tables(spark, d):
    rows = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda r: F.array(r["o_orderkey"].cast("string"), r["o_orderstatus"]))
    each = table(spark, d, "orders").groupBy("o_custkey").agg(rows.alias("rows"))
    k = F.col("o_custkey")
    number = k.cast("string")
    lines = F.array_join(F.transform("rows", lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))), "\n")
    third = F.when(k % 3 == 0, F.concat(F.lit("\n\nthen\n| x | y |\n|---|---|\n| "), number, F.lit(" | 1 |\nend"))).otherwise("")
    text_ = F.concat(F.lit("before "), number, F.lit("\n<!-- 표 1 -->\n\n| key | status |\n|---|---|\n"), lines, F.lit("\n\nbetween"), third, F.lit("\n<!-- 표 2 -->[표 데이터]\n항목 1:\n- 부서: a"), number, F.lit("\n- 이름: b\n항목 2:\n- 부서: c\n- 이름: d"))
    return each.select("o_custkey", text_.alias("text"))


@R.add("c6_detected_tables", """WITH o AS (SELECT o_custkey AS k, string_agg(o_orderkey || ',' || o_orderstatus, ';' ORDER BY o_orderkey) AS cells FROM orders GROUP BY 1)
 SELECT k AS o_custkey, 0 AS table_index, 'piped' AS kind, '표 1' AS title, 'key,status' AS headers, cells FROM o UNION ALL SELECT k, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END, 'list', '표 2', '부서,이름', 'a' || k || ',b;c,d' FROM o
 UNION ALL SELECT k, 1, 'piped', NULL, 'x,y', k || ',1' FROM o WHERE k % 3 = 0""")
def _(spark, d):
    found = chunking.table_list(_with_tables(spark, d), "o_custkey")
    return found.select("o_custkey", "table_index", "kind", "title", F.array_join("headers", ",").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("cells"))


@R.add("c7_segments", """WITH k AS (SELECT DISTINCT o_custkey AS k FROM orders), s AS (SELECT k, unnest([{'i': 0, 'kind': 'text', 'start': 'before ' || k}, {'i': 1, 'kind': 'table', 'start': '<!-- 표 1 -->'}, {'i': 2, 'kind': 'text', 'start': 'between'},
 {'i': 3, 'kind': 'table', 'start': '| x | y |'}, {'i': 4, 'kind': 'text', 'start': 'end'}, {'i': 5, 'kind': 'table', 'start': '<!-- 표 2 -->[표 데이터]'}]) AS x FROM k)
 SELECT k AS o_custkey, CASE WHEN k % 3 > 0 AND x.i = 5 THEN 3 ELSE x.i END AS segment, x.kind, x.start FROM s WHERE k % 3 = 0 OR x.i NOT IN (3, 4)""")
def _(spark, d):
    found = chunking.segmented(_with_tables(spark, d), "o_custkey")
    first = F.get(F.split(F.trim(F.regexp_replace("content", "^\\n+", "")), "\n"), 0)
    return found.select("o_custkey", "segment", "kind", first.alias("start"))


@R.add("c11_normalized_texts", """SELECT o_custkey, 'before ' || o_custkey || chr(10) || '<!-- 표 1 -->' || repeat(chr(10), 2) || '| key | status |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || o_orderkey || ' | ' || o_orderstatus || ' |', chr(10) ORDER BY o_orderkey)
 || repeat(chr(10), 2) || 'between' || CASE WHEN o_custkey % 3 = 0 THEN repeat(chr(10), 2) || 'then' || chr(10) || '| x | y |' || chr(10) || '|---|---|' || chr(10) || '| ' || o_custkey || ' | 1 |' || chr(10) || 'end' ELSE '' END
 || chr(10) || '<!-- 표 2 -->[표 데이터]' || chr(10) || '항목 1:' || chr(10) || '- 부서: a' || o_custkey || chr(10) || '- 이름: b' || chr(10) || '항목 2:' || chr(10) || '- 부서: c' || chr(10) || '- 이름: d' AS text FROM orders GROUP BY 1""")
def _(spark, d):
    return tables.normalized_texts(_with_tables(spark, d), "text").select("o_custkey", F.col("normalized").alias("text"))


@R.add("c6_table_counts", "SELECT doc_id, len(string_split(text, ' | ')) - 1 AS pipes, len(list_filter(string_split(text, chr(10)), lambda p: contains(p, '|'))) AS lines FROM documents")
def _(spark, d):
    lines = F.filter(F.split("text", "\n", -1), lambda p: p.contains("|"))
    return table(spark, d, "documents").select("doc_id", (F.size(F.split("text", r" \| ", -1)) - 1).cast("long").alias("pipes"), F.size(lines).cast("long").alias("lines"))
