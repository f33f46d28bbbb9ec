"""The rest: repairs, page structure, surrogate searches, hops, contexts, table headers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.functions import pages, repair, table_functions, text
from sparkloom.operators import classify, clusters, joins, lexical, linkage, ranking, retrieval, tables, vectors
from sparkloom.plans.registry import Registry, table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


# Damage in the five contexts, and where the letter stays.
_NUMERALS = ["총 {n}ㅇㅇㅇ원 외 ㅇㅇ시", "{n}ㅇ{n} 그리고 {n}ㅇㅇ", "값 {n}.{n}ㅇㅇ, ㅇ{n}시", "{n}ㅇ번지 ㅇㅇㅇ 님", "({n}ㅇ) {n}ㅇ월 {n}ㅇ말", "ㅇ{n} {n}ㅇ{n}ㅇ{n} ㅇ"]
_REPAIRED = ["총 {n}000원 외 ㅇㅇ시", "{n}0{n} 그리고 {n}00", "값 {n}.{n}00, 0{n}시", "{n}0번지 ㅇㅇㅇ 님", "({n}0) {n}0월 {n}ㅇ말", "0{n} {n}0{n}ㅇ{n} ㅇ"]
_MENDED = [3, 3, 3, 1, 2, 2]


def _of_orders(templates):
    return "CASE o_orderkey % 6 " + " ".join(f"WHEN {i} THEN replace('{t}', '{{n}}', (o_orderkey % 7 + 1)::VARCHAR)" for i, t in enumerate(templates)) + " END"


@R.add("s15_numeral_repair", f"SELECT o_orderkey, {_of_orders(_REPAIRED)} AS text, ([{', '.join(map(str, _MENDED))}])[o_orderkey % 6 + 1]::BIGINT AS repaired FROM orders")
def _(spark, d):
    digit = (1 + F.col("o_orderkey") % 7).cast("string")
    damaged = F.element_at(F.array(*[F.replace(F.lit(t), F.lit("{n}"), digit) for t in _NUMERALS]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", repair.zeros_and_count(damaged).alias("r")).select("o_orderkey", "r.text", "r.repaired")


@R.add("s16_space_garbage", """SELECT o_orderkey, '주문 ' || o_orderkey || ' 확인' || CASE o_orderkey % 4 WHEN 0 THEN ' 문서' WHEN 1 THEN '문 서' WHEN 2 THEN ' 漢字 문서' ELSE ' 문서 x' END AS text,
 CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 2 END::BIGINT AS removed FROM orders""")
def _(spark, d):
    # A known sequence and a character; a unit in Hangul, one of a letter; common Han stays; units without Hangul near, not in Han.
    tails = ["漠杳杰문서", "\u6F20문\u5B20서", "\u3000 漢字 문서", "\u4020\u2003문서 x"]
    tail = F.element_at(F.array(*map(F.lit, tails)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    r = repair.without_space_garbage(F.concat(F.lit("주문 "), F.col("o_orderkey").cast("string"), F.lit(" 확인"), tail)).alias("r")
    return table(spark, d, "orders").select("o_orderkey", r).select("o_orderkey", "r.text", "r.removed")


@R.add("s16_stray_characters", "SELECT doc_id, md5(text) AS text FROM documents WHERE length(text) > 100")
def _(spark, d):
    damaged = F.concat(F.lit("漠"), "text", F.lit("桤灧"))
    return table(spark, d, "documents").where(F.char_length("text") > 100).select("doc_id", F.md5(repair.without_stray_han(damaged)).alias("text"))


@R.add("s17_misread_text", "SELECT doc_id, md5(regexp_replace(text, '[^ -~]', 'x', 'g') || repeat(' ', length(text) % 2)) AS text FROM documents")
def _(spark, d):
    plain = F.regexp_replace("text", "[^ -~]", "x")
    even = F.concat(plain, F.repeat(F.lit(" "), F.char_length(plain) % 2))
    wrecked = F.when(F.col("doc_id") % 3 == 0, F.decode(F.encode(even, "US-ASCII"), "UTF-16LE")).otherwise(even)
    return table(spark, d, "documents").select("doc_id", F.md5(repair.reread(wrecked)).alias("text"))


@R.add("p21_response_fields", "SELECT o_orderkey AS \"order.key\", c_name AS name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    from sparkloom.sources.nested import flattened

    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    nested = joined.select(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")).alias("order"), F.struct(F.col("c_name").alias("Name_")).alias("customer"))
    flat = flattened(nested)
    wanted = {"order.key": "order.key", "name": "name"}
    plain = lambda s: s.split(".")[-1].replace("_", "").replace(" ", "").lower()
    found = {out: next(c for c in flat.columns if c == w or plain(c) == plain(w)) for out, w in wanted.items()}
    return flat.select(*[F.col(f"`{c}`").alias(out) for out, c in found.items()])


@R.add("c31_page_metadata", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, len(regexp_extract_all(html, '<li>')) AS items FROM pages")
def _(spark, d):
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(h, '<html lang="([a-z]+)"', 1).alias("lang"), text.count(h, "<li>").cast("long").alias("items"))


@R.add("c31_page_structure", """SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS title, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS language, 'About ' || page_id AS description, 'a, b' || page_id AS keywords, 'Who' || page_id AS author,
 '1. one' || chr(10) || '2. ' || page_id AS last_list, 'k | v ' || page_id || chr(10) || ' | w' AS last_table, len(regexp_extract_all(html, '(?s)<ul>.*?</ul>|<ol>.*?</ol>')) + 1 AS lists FROM pages""")
def _(spark, d):
    number = F.col("page_id").cast("string")
    metas = F.concat(F.lit("<head><META content='About "), number, F.lit("' Name='description'/><meta name=\"keywords\" content=\"old\"><meta\nname=keywords content=\"a, b"), number, F.lit("\"><meta name=author content=Who"), number, F.lit(">"))
    end = F.concat(F.lit("<TABLE class=x><tr><th>k</th><td> <b>v</b> "), number, F.lit("</td></tr><tr><td></td></tr><tr><td></td><td>w</td></tr></TABLE><ol start=1><li>one</li><li><i>"), number, F.lit("</i></li></ol>"))
    html = F.concat(F.replace("html", F.lit("<head>"), metas), end)
    each = table(spark, d, "pages").select("page_id", html.alias("html"))
    found = each.select("page_id", pages.metadata(F.col("html")).alias("m"), pages.lists(F.col("html")).alias("l"), pages.tables(F.col("html")).alias("t"))
    return found.select("page_id", "m.*", F.try_element_at("l", F.lit(-1)).alias("last_list"), F.try_element_at("t", F.lit(-1)).alias("last_table"), F.size("l").cast("long").alias("lists"))


@R.add("c34_batch_classified", "SELECT doc_id, lang, CASE WHEN contains(lower(text), 'license') THEN 'law' ELSE 'other' END AS type FROM documents")
def _(spark, d):
    c = classify.classify(F.col("text"), {"law": ["license"]}, {"none": ["\x00"]}, {"any": ["the "]})
    return table(spark, d, "documents").withColumn("class", c).select("doc_id", "lang", F.col("class.type").alias("type"))


# The first row, then a row with a word of headers, a sparse one with or without such a word, one of numbers, or one of words.
@R.add("c16_header_rows", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 3 END AS header_rows FROM orders""")
def _(spark, d):
    key, price = F.col("o_orderkey").cast("string"), F.floor("o_totalprice").cast("string")
    a = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    seconds = [a(key, price, "Item No.", price), a("", "", "", "O"), a("", "", "", "unit"), a(key, price, "7%", "F"), a("open", "paid", key, "x")]
    second = F.element_at(F.array(*seconds), (F.col("o_orderkey") % 5 + 1).cast("int"))
    third = F.when(F.col("o_orderkey") % 5 == 4, a("합계", key, price, price)).otherwise(a(key, price, "1.5", "-"))
    rows = F.array(a(key, key, key, key), second, third, a("name", "name", "name", "name"))
    return table(spark, d, "orders").select("o_orderkey", tables.header_rows(rows).alias("header_rows"))


@R.add("c17_flat_headers", "SELECT n_nationkey, n_name || '_amount|' || n_name || '_rate|name' AS header FROM nation")
def _(spark, d):
    a = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    rows = F.array(a(F.col("n_name"), "", "name"), a("amount", "rate", "name"), a("1", "2", "3"))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(tables.flat_header(rows, F.lit(2)), "|").alias("header"))


@R.add("w9_left_fill", "SELECT n_nationkey, n_name || ',' || n_name || ',x' AS cells FROM nation")
def _(spark, d):
    rows = F.array(F.array("n_name", F.lit(""), F.lit("x")), F.array(F.lit(""), F.lit(""), F.lit("")))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(tables.flat_header(rows, F.lit(2)), ",").alias("cells"))


@R.add("c22_filled_cells", "SELECT n_nationkey, n_name || ',-' || ';' || '-,' || n_regionkey AS dash, n_name || ',a' || ';' || n_name || ',' || n_regionkey AS inherited FROM nation")
def _(spark, d):
    cells = lambda first: F.array(F.array("n_name", F.lit(first)), F.array(F.lit(""), F.col("n_regionkey").cast("string")))
    flat = lambda rows: F.array_join(F.transform(rows, lambda r: F.array_join(r, ",")), ";")
    return table(spark, d, "nation").select("n_nationkey", flat(tables.filled(cells(""), "dash")).alias("dash"), flat(tables.filled(cells("a"), "inherit")).alias("inherited"))


@R.add("c10b_hierarchy", "SELECT n_nationkey, n_name || ';' || n_name || ' > sub;' || n_name || ' > sub > leaf' AS paths FROM nation")
def _(spark, d):
    rows = F.array(F.array(F.col("n_name")), F.array(F.lit(""), F.lit("sub")), F.array(F.lit(""), F.lit(""), F.lit("leaf")))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(tables.hierarchy_paths(rows), ";").alias("paths"))


@R.add("c16_header_rows_of_orders", "SELECT o_orderkey, least(3, 1 + o_orderkey % 5)::INT AS header_rows FROM orders")
def _(spark, d):  # up to five rows of words before the numbers, of which three count
    words = F.transform(F.sequence(F.lit(0), F.col("o_orderkey") % 5), lambda i: F.array(F.col("o_orderstatus"), F.lit("total"), F.lit("price")))
    numbers = F.array(F.array(F.col("o_orderkey").cast("string"), F.floor("o_totalprice").cast("string"), F.col("o_orderstatus")))
    return table(spark, d, "orders").select("o_orderkey", tables.header_rows(F.concat(words, numbers, words)).alias("header_rows"))


@R.add("c17_flat_headers_of_parts", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand || '_size,' || p_brand || '_price,' || p_type ELSE p_brand || '_size,' || p_type || '_price,' || p_type END AS header FROM part")
def _(spark, d):
    upper = F.array("p_brand", F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_type")), "p_type")
    rows = F.array(upper, F.array(F.lit("size"), F.lit("price"), F.col("p_type")), F.array(F.lit("1"), F.lit("2"), F.lit("3")))
    return table(spark, d, "part").select("p_partkey", F.array_join(tables.flat_header(rows, F.lit(2)), ",").alias("header"))


@R.add("c10_hierarchy_of_parts", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand || ';' || p_type WHEN 1 THEN p_brand || ';' || p_brand || ' > ' || p_type ELSE p_brand || ';' || p_brand || ' > ' || p_type || ';' || p_brand || ' > ' || p_type || ' > ' || p_size END AS paths FROM part")
def _(spark, d):
    first, second = F.array(F.array("p_brand")), F.array(F.array(F.lit(""), "p_type"))
    third = F.array(F.array(F.lit(""), F.lit(""), F.col("p_size").cast("string")))
    k = F.col("p_partkey") % 3
    rows = F.when(k == 0, F.concat(first, F.array(F.array("p_type")))).when(k == 1, F.concat(first, second)).otherwise(F.concat(first, second, third))
    return table(spark, d, "part").select("p_partkey", F.array_join(tables.hierarchy_paths(rows), ";").alias("paths"))


@R.add("c13_merged_cells_of_orders", """WITH s AS (SELECT o_orderkey AS k, 1 + o_orderkey % 2 AS h, 1 + o_orderkey % 3 AS w, o_orderstatus AS t FROM orders)
 SELECT k AS o_orderkey, r::INT AS row, c::INT AS column, CASE WHEN r = 0 AND c = 0 THEN t ELSE '' END AS text FROM s, range(0, 2) a(r), range(0, 3) b(c) WHERE r < h AND c < w""")
def _(spark, d):
    k = F.col("o_orderkey")
    cells = table(spark, d, "orders").select(k, F.lit(0).alias("row"), F.lit(0).alias("column"), (1 + k % 2).cast("int").alias("h"), (1 + k % 3).cast("int").alias("w"), F.col("o_orderstatus").alias("text"))
    return tables.expanded(cells, "o_orderkey", "row", "column", "h", "w", "text")


@R.add("c34_batch_classified_by_words", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'sale' WHEN 'error' THEN 'fault' ELSE 'other' END AS type FROM events")
def _(spark, d):
    c = classify.classify(F.concat(F.lit("an "), "event_type", F.lit(" event")), {"sale": ["purchase"], "fault": ["error"]}, {"none": ["\x00"]}, {"any": ["an "]})
    return table(spark, d, "events").withColumn("class", c).select("event_id", F.col("class.type").alias("type"))


@R.add("u6_chunk_table_function")
def _(spark, d):
    table_functions.register(spark)
    return table(spark, d, "documents").alias("d").lateralJoin(table_functions.ChunkText(F.col("text").outer(), F.lit(200)).alias("c")).select("d.doc_id", "c.chunk_index", "c.kind", "c.tokens", "c.content")


# Cosines of some vectors with all; a surrogate keeps a part of the components.
_NEAR = """q AS (SELECT vec_id AS g, {kept} AS a FROM embeddings WHERE vec_id % 100 = 0), n AS (SELECT g, v.vec_id, round(list_cosine_similarity(a::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM q, embeddings v),
 {name} AS (SELECT g, vec_id, score, row_number() OVER (PARTITION BY g ORDER BY score DESC, vec_id)::INT AS rank FROM n QUALIFY row_number() OVER (PARTITION BY g ORDER BY score DESC, vec_id) <= 50)"""


def _near(name, kept):
    return f"{name} AS (WITH {_NEAR.format(kept=kept, name='r')} SELECT * FROM r)"


_EVEN = "list_transform(embedding, lambda x, i: CASE WHEN i % 2 = 1 THEN x ELSE 0 END)"
_HALF = "list_transform(embedding, lambda x, i: CASE WHEN i <= 32 THEN x ELSE 0 END)"
_HOP = """h{i} AS (WITH n AS (SELECT query_id, v.vec_id, round(list_cosine_similarity(a::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM {asked}, embeddings v)
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, {i} AS hop FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5)"""


def _hops(n):
    ask = "(SELECT vec_id AS query_id, embedding AS a FROM embeddings WHERE vec_id % 100 = 0)"
    views = []
    for i in range(n):
        views.append(_HOP.format(i=i, asked=ask))
        ask = f"(SELECT query_id, embedding AS a FROM h{i} JOIN embeddings USING (vec_id) WHERE rank = 2)"
    return f"WITH {', '.join(views)} " + " UNION ALL ".join(f"SELECT * FROM h{i}" for i in range(n))


@R.add("r13_surrogate_search", f"""WITH {_near('x', 'embedding')}, {_near('y', _EVEN)}, u AS (SELECT g, vec_id, count(*) AS matches, max(score) AS score FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY 1, 2)
 SELECT g AS "group", vec_id, matches, score, row_number() OVER (PARTITION BY g ORDER BY matches DESC, score DESC, vec_id)::INT AS rank FROM u QUALIFY row_number() OVER (PARTITION BY g ORDER BY matches DESC, score DESC, vec_id) <= 20""")
def _(spark, d):
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("group"), F.explode(F.array(F.col("embedding"), F.transform("embedding", lambda x, i: F.when(i % 2 == 0, x).otherwise(F.lit(0.0)).cast("float")))).alias("asked")).withColumn("query_id", F.xxhash64("asked"))
    hits = vectors.top_k(v, asked, "vec_id", "embedding", "query_id", "asked", 50).join(asked.select("query_id", "group").distinct(), "query_id")
    return retrieval.multi_query(hits, "group", "vec_id", 20)


@R.add("r14_direct_and_surrogate", f"""WITH {_near('x', 'embedding')}, {_near('y', _HALF)},
 u AS (SELECT g AS query_id, vec_id, round(sum(part), 8) AS score FROM (SELECT g, vec_id, 0.6::DOUBLE / (60 + rank) AS part FROM x UNION ALL SELECT g, vec_id, 0.4::DOUBLE / (60 + rank) FROM y) GROUP BY 1, 2)
 SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM u QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""")
def _(spark, d):
    v = table(spark, d, "embeddings")
    ask = lambda f: v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.transform("embedding", f).alias("asked"))
    direct = vectors.top_k(v, ask(lambda x: x), "vec_id", "embedding", "query_id", "asked", 50)
    surrogate = vectors.top_k(v, ask(lambda x, i: F.when(i < 32, x).otherwise(F.lit(0.0).cast("float"))), "vec_id", "embedding", "query_id", "asked", 50)
    return lexical.best(ranking.fused([direct, surrogate], "query_id", "vec_id", "rank", [0.6, 0.4]).drop("lists"), "query_id", "vec_id", 20, 8)


@R.add("r17_multi_hop", _hops(3))
def _(spark, d):
    v = table(spark, d, "embeddings")
    first = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))
    search = lambda q: vectors.top_k(v, q, "vec_id", "embedding", "query_id", "asked", 5)
    onward = lambda hits: hits.where("rank = 2").join(v, "vec_id").select("query_id", F.col("embedding").alias("asked"))
    return retrieval.multi_hop(first, search, onward, 3)


@R.add("r18_analysis_context", "WITH c AS (SELECT source, doc_id, text, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s FROM documents) SELECT source, md5(string_agg(text, chr(10) ORDER BY doc_id)) AS context, count(*) AS parts FROM c WHERE s <= 8000 GROUP BY 1")
def _(spark, d):
    kept = ranking.within_budget(table(spark, d, "documents"), ["source"], ["doc_id"], F.char_length("text"), 8000)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"])
    return kept.groupBy("source").agg(F.md5(F.array_join(parts, "\n")).alias("context"), F.count("*").alias("parts"))


@R.add("k8_filtered_clusters")
def _(spark, d):
    found = clusters.kmeans(table(spark, d, "embeddings").where("label < 5"), "embedding", k=5, starts=1)
    return found.groupBy("cluster").agg(F.count("*").alias("size"), F.countDistinct("label").alias("labels"))


@R.add("j12_file_stems", "SELECT p_partkey, count(*) AS files FROM part JOIN (SELECT DISTINCT regexp_replace(lower(p_name || '_' || p_brand), '[^a-z0-9]+', '_', 'g')[1:30] AS stem FROM part) f ON regexp_replace(lower(p_name || '_' || p_brand), '[^a-z0-9]+', '_', 'g')[1:30] = stem GROUP BY 1")
def _(spark, d):
    stem = F.substring(F.regexp_replace(F.lower(F.concat_ws("_", "p_name", "p_brand")), "[^a-z0-9]+", "_"), 1, 30)
    parts = table(spark, d, "part").select("p_partkey", stem.alias("stem"))
    return parts.join(parts.select("stem").distinct(), "stem").groupBy("p_partkey").agg(F.count("*").alias("files"))


@R.add("j12_attached_files", """WITH a AS (SELECT p_partkey, replace(p_name, ' ', ':') || '*' || p_brand AS name, regexp_replace(replace(p_name, ' ', ':') || '*' || p_brand, '[:*]', '_', 'g')[1:30] AS stem FROM part),
 f AS (SELECT DISTINCT 'out/' || p_size || '_' || replace(p_name, ' ', '_') || '_' || p_brand || '.pdf' AS path FROM part WHERE p_partkey % 3 = 0) SELECT p_partkey, name, min(path) AS file FROM a LEFT JOIN f ON contains(split_part(path, '/', 2), stem) GROUP BY 1, 2""")
def _(spark, d):
    part = table(spark, d, "part")
    asked = part.select("p_partkey", F.concat(F.translate("p_name", " ", ":"), F.lit("*"), "p_brand").alias("name"))
    files_ = part.where("p_partkey % 3 = 0").select(F.concat(F.lit("out/"), F.col("p_size").cast("string"), F.lit("_"), F.translate("p_name", " ", "_"), F.lit("_"), "p_brand", F.lit(".pdf")).alias("path"))
    return joins.attached_files(asked, files_, "name", "path").select("p_partkey", "name", "file")


@R.add("t9_locale_order", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(c_mktsegment), c_mktsegment DESC, c_custkey)::INT AS pos FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment FROM customer)")
def _(spark, d):
    name = F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))
    named = table(spark, d, "customer").select("c_custkey", "c_nationkey", name.alias("name"))
    return named.withColumn("pos", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(*ranking.named_order("name"), "c_custkey"))).select("c_custkey", "pos")


@R.add("i14_import_backup", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'old' END AS version FROM documents")
def _(spark, d):
    docs = vectors.hashed_vectors(table(spark, d, "documents").select("doc_id", "text"), "text").select("doc_id", "vector")
    old, new = docs.withColumn("version", F.lit("old")), docs.where("doc_id % 4 = 0").withColumn("version", F.lit("new"))
    return ranking.upsert(old, new, ["doc_id"]).select("doc_id", "version")


@R.add("j10b_prefix_tree", "SELECT code, count(*) AS n FROM part JOIN (VALUES ('ECO'), ('PRO'), ('STA')) m(code) ON starts_with(p_type, code) GROUP BY 1")
def _(spark, d):
    codes = spark.createDataFrame([("ECO",), ("PRO",), ("STA",)], "code string")
    return joins.prefix_join(table(spark, d, "part"), codes, "p_type", "code").groupBy("code").agg(F.count("*").alias("n"))


# Endpoints of parts: names, base names and targets that some rows share; every second row is described on either side.
_ENDPOINTS = """WITH e AS (SELECT p_partkey AS id, CASE WHEN p_size % 7 > 0 THEN '/api/' || lower(p_type) || '/' || replace(p_brand, '#', '') || p_size || '.do' END AS path,
  p_name || CASE WHEN p_partkey % 4 < 3 THEN ' ' || p_brand || ' ' || p_size ELSE '' END AS name, CASE WHEN p_partkey % 3 = 0 THEN '{"target":"' || p_type || p_size || p_brand || '"}' END AS params,
  CASE WHEN p_partkey % 5 = 0 THEN [p_type, p_name] ELSE [] END AS fields FROM part),
 f AS (SELECT *, params::JSON->>'$.target' AS target, lower(name) AS low, replace(regexp_extract(path, '[^/]*$'), '.do', '') AS base FROM e)"""
_WORDS = ["bolt", "gear", "ring", "small", "hot", "brand"]
_POINTS = """(CASE WHEN l.path = r.path THEN 100 ELSE 0 END + CASE WHEN l.base = r.base THEN 80 ELSE 0 END + CASE WHEN l.target = r.target THEN 50 ELSE 0 END + CASE WHEN l.name = r.name THEN 40 ELSE 0 END
  + CASE WHEN contains(l.low, r.low) OR contains(r.low, l.low) THEN 20 ELSE 0 END + {words})""".format(words=" + ".join(f"CASE WHEN contains(l.low, '{w}') AND contains(r.low, '{w}') THEN 10 ELSE 0 END" for w in _WORDS))


@R.add("j15_merged_endpoints", f"""{_ENDPOINTS},
 a AS (SELECT * FROM f WHERE id % 2 = 0), b AS (SELECT * FROM f WHERE id % 2 = 1),
 m AS (SELECT l.id, arg_max({{'id': r.id, 'score': {_POINTS}, 'path': r.path, 'params': r.params, 'fields': r.fields}}, ({_POINTS}, -r.id)) AS r FROM a l, b r WHERE {_POINTS} >= 30 GROUP BY 1),
 g AS (SELECT l.id, l.name, coalesce(l.path, m.r.path) AS path, coalesce(l.params, m.r.params) AS params, CASE WHEN len(l.fields) > 0 THEN l.fields ELSE coalesce(m.r.fields, l.fields) END AS fields, m.r.id AS matched, m.r.score AS score FROM a l LEFT JOIN m ON m.id = l.id),
 h AS (SELECT *, params::JSON->>'$.target' AS target, lower(name) AS low, replace(regexp_extract(path, '[^/]*$'), '.do', '') AS base FROM g),
 u AS (SELECT b.*, row_number() OVER (ORDER BY b.id) AS n FROM b WHERE id NOT IN (SELECT r.id FROM h l, b r WHERE {_POINTS} >= 50)),
 e2 AS (SELECT r.n, list(l.n) FILTER ({_POINTS} >= 50) AS before FROM u r LEFT JOIN u l ON l.n < r.n GROUP BY 1),
 k AS (WITH RECURSIVE k(n, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT k.n + 1, CASE WHEN list_has_any(kept, coalesce(before, [])) THEN kept ELSE list_append(kept, k.n + 1) END FROM k JOIN e2 ON e2.n = k.n + 1)
  SELECT unnest(arg_max(kept, n)) AS n FROM k)
 SELECT id, name, path, params, array_to_string(fields, ',') AS fields, matched, score::INT AS score, false AS appended FROM h
 UNION ALL SELECT id, name, path, params, array_to_string(fields, ','), NULL, NULL, true FROM u JOIN k USING (n)""")
def _(spark, d):
    size = F.col("p_size").cast("string")
    every = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") % 7 > 0, F.concat(F.lit("/api/"), F.lower("p_type"), F.lit("/"), F.regexp_replace("p_brand", "#", ""), size, F.lit(".do"))).alias("path"),
        F.concat("p_name", F.when(F.col("p_partkey") % 4 < 3, F.concat(F.lit(" "), "p_brand", F.lit(" "), size)).otherwise("")).alias("name"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('{"target":"'), "p_type", size, "p_brand", F.lit('"}'))).alias("params"),
        F.when(F.col("p_partkey") % 5 == 0, F.array("p_type", "p_name")).otherwise(F.array().cast("array<string>")).alias("fields"),
    )
    by = linkage.Linkage(params="params", keywords=tuple(_WORDS))
    found = linkage.merged(every.where("id % 2 = 0"), every.where("id % 2 = 1"), by, ("fields",), ("path", "params"))
    return found.withColumn("fields", F.array_join("fields", ","))
