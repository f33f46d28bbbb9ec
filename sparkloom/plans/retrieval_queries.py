"""Retrieval, fusion, clusters and classification: benchmark texts and the first vectors stand for queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sparkloom.operators import cells, classify, clusters, lexical, ranking, retrieval, segments, vectors
from sparkloom.plans.registry import Registry, table
from sparkloom.sources.staging import staged

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
PATTERN = "[a-z0-9]+"

_TERMS = """d AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 2)) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY 1, 2),
 q AS (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 2)) AS term FROM benchmark), a AS (SELECT item_id, term, count(*) AS qtf FROM q GROUP BY 1, 2)"""
_BM25 = f"""{_TERMS}, l AS (SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 2)) AS dl FROM documents), g AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM l),
 f AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, g GROUP BY term, n), i AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM f) ELSE raw END AS idf FROM f),
 s AS (SELECT item_id, doc_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM a JOIN i USING (term) JOIN p USING (term) JOIN l USING (doc_id), g GROUP BY 1, 2)"""


@R.add("r4_terms", f"WITH {_TERMS} SELECT doc_id, count(*) AS terms, sum(tf)::BIGINT AS total FROM p GROUP BY 1")
def _(spark, d):
    return lexical.postings(table(spark, d, "documents"), "doc_id", "text", PATTERN).groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("total"))


@R.add("r5_bm25_top10", f"WITH {_BM25} SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10")
def bm25_top10(spark, d):
    index = segments.build(table(spark, d, "documents"), "doc_id", pattern=PATTERN)
    return index.search(table(spark, d, "benchmark"), "item_id", "doc_id", 10)


@R.add("r6_bm25_plain", f"""WITH {_TERMS}, g AS (SELECT avg(length(text)) AS avgdl FROM documents),
 s AS (SELECT item_id, doc_id, round(sum(tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length(text) / avgdl))), 6) AS score FROM (SELECT DISTINCT item_id, term FROM q) JOIN p USING (term) JOIN documents USING (doc_id), g GROUP BY 1, 2)
 SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""")
def _(spark, d):
    index = segments.build(table(spark, d, "documents"), "doc_id", pattern=PATTERN)
    return index.search(table(spark, d, "benchmark"), "item_id", "doc_id", 10, plain=True)


_COS = "round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6)"
_TOP = f"SELECT q.vec_id AS query_id, v.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS} DESC, v.vec_id)::INT AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0"


def _asked(v):
    return v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"))


@R.add("r1_vector_top10", f"SELECT * FROM ({_TOP}) WHERE rank <= 10")
def _(spark, d):
    v = table(spark, d, "embeddings")
    return vectors.top_k(v, _asked(v), "vec_id", "embedding", "query_id", "asked", 10)


@R.add("r2_filtered_top5", f"SELECT * FROM ({_TOP} AND v.label < 5) WHERE rank <= 5")
def _(spark, d):
    v = table(spark, d, "embeddings")
    return vectors.top_k(v.where("label < 5"), _asked(v), "vec_id", "embedding", "query_id", "asked", 5)


@R.add("r3_cell_recall")
def _(spark, d):
    v = table(spark, d, "embeddings")
    return cells.CellIndex(v, "vec_id", "embedding").report(_asked(v), "query_id", "asked", 10)


@R.add("c12_collection_info", "SELECT count(*) AS count, max(len(embedding)) AS dimension, min(len(embedding)) = max(len(embedding)) AS uniform FROM embeddings")
def _(spark, d):
    return vectors.collection_info(table(spark, d, "embeddings"), "embedding")


@R.add("d10_cosine", "WITH f AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 5) AS score FROM embeddings, f")
def _(spark, d):
    v = table(spark, d, "embeddings")
    one = v.where("vec_id = 0").select(F.col("embedding").alias("e"))
    return v.crossJoin(F.broadcast(one)).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("e")), 5).alias("score"))


@R.add("d11_similarity", f"SELECT query_id, vec_id, round(1 - (1 - score), 6) AS similarity FROM ({_TOP}) WHERE rank = 1")
def _(spark, d):
    v = table(spark, d, "embeddings")
    found = vectors.top_k(v, _asked(v), "vec_id", "embedding", "query_id", "asked", 1).withColumn("distance", 1 - F.col("score"))
    return found.select("query_id", "vec_id", F.round(1 - F.col("distance"), 6).alias("similarity"))


@R.add("r7_rank_fusion", """WITH x AS (SELECT vec_id, label, embedding[1]::DOUBLE AS s, embedding[2]::DOUBLE AS l FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rs, row_number() OVER (PARTITION BY label ORDER BY l DESC, vec_id) AS rl FROM x),
 f AS (SELECT label, vec_id, round(0.6::DOUBLE / (60 + rs) + 0.4::DOUBLE / (60 + rl), 8) AS score FROM r) SELECT label, vec_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id)::INT AS rank FROM f QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) <= 20""")
def _(spark, d):
    v = table(spark, d, "embeddings")
    side = lambda i: v.select("label", "vec_id", F.col("embedding")[i].cast("double").alias("score"))
    return retrieval.hybrid(side(0), side(1), "label", "vec_id", (0.6, 0.4), 20)


@R.add("r8_weighted_fusion", """WITH x AS (SELECT vec_id, label, embedding[1] AS a, embedding[2] AS b, embedding[3] AS c FROM embeddings), u AS (
 SELECT label, vec_id, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY label ORDER BY a DESC, vec_id)) AS s, row_number() OVER (PARTITION BY label ORDER BY a DESC, vec_id) AS k FROM x UNION ALL SELECT label, vec_id, 0.5::DOUBLE / (60 + row_number() OVER (PARTITION BY label ORDER BY b DESC, vec_id)), row_number() OVER (PARTITION BY label ORDER BY b DESC, vec_id) FROM x
 UNION ALL SELECT label, vec_id, 0.25::DOUBLE / (60 + row_number() OVER (PARTITION BY label ORDER BY c DESC, vec_id)), row_number() OVER (PARTITION BY label ORDER BY c DESC, vec_id) FROM x) SELECT label, vec_id, round(sum(s), 8) AS score, count(*) AS lists FROM u WHERE k <= 10 GROUP BY 1, 2""")
def _(spark, d):
    v = table(spark, d, "embeddings")
    lists = [ranking.top_n(v, ["label"], [F.col("embedding")[i].desc(), F.col("vec_id")], 10) for i in range(3)]
    return ranking.fused(lists, "label", "vec_id", "rank", [1.0, 0.5, 0.25]).withColumn("score", F.round("score", 8))


@R.add("s1_merged_results", f"WITH t AS ({_TOP}) SELECT query_id % 300 AS query, vec_id, count(*) AS matches, max(score) AS score FROM t WHERE rank <= 20 GROUP BY 1, 2")
def _(spark, d):
    v = table(spark, d, "embeddings")
    hits = vectors.top_k(v, _asked(v), "vec_id", "embedding", "query_id", "asked", 20).withColumn("query", F.col("query_id") % 300)
    return ranking.merged([("vector", hits)], "query", "vec_id", "score").drop("sources")


@R.add("r12_multi_query", f"WITH t AS ({_TOP}), m AS (SELECT query_id % 300 AS query, vec_id, count(*) AS matches, max(score) AS score FROM t WHERE rank <= 30 GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY query ORDER BY matches DESC, score DESC, vec_id)::INT AS rank FROM m QUALIFY row_number() OVER (PARTITION BY query ORDER BY matches DESC, score DESC, vec_id) <= 80")
def _(spark, d):
    v = table(spark, d, "embeddings")
    hits = vectors.top_k(v, _asked(v), "vec_id", "embedding", "query_id", "asked", 30).withColumn("query", F.col("query_id") % 300)
    return retrieval.multi_query(hits, "query", "vec_id", 80)


@R.add("r10_keyword_rerank", f"""WITH {_BM25}, h AS (SELECT item_id, doc_id FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10),
 c AS (SELECT item_id, doc_id, b.text AS q, d.text FROM h JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id)), w AS (SELECT item_id, doc_id, text, unnest(list_distinct(list_filter(regexp_extract_all(lower(q), '[a-z0-9]+'), lambda w: length(w) >= 2))) AS w FROM c),
 k AS (SELECT item_id, doc_id, round(sum(CASE WHEN contains(lower(text), w) THEN 1.3 ELSE 0 END + CASE WHEN contains(lower(substr(text, 1, 200)), w) THEN 0.5 ELSE 0 END)::DOUBLE, 6) AS score FROM w GROUP BY 1, 2)
 SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM k QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 5""")
def _(spark, d):
    asked = table(spark, d, "benchmark").select("item_id", F.col("text").alias("q"))
    hits = bm25_top10(spark, d).select("item_id", "doc_id")
    pairs = table(spark, d, "documents").join(hits, "doc_id").join(asked, "item_id")
    return lexical.keyword_rerank(pairs, "q", "text", "item_id", "doc_id", 5, PATTERN).select("item_id", "doc_id", "score", "rank")


@R.add("r9_hybrid_search")
def _(spark, d):
    docs, asked = vectors.hashed_vectors(table(spark, d, "documents"), "text"), vectors.hashed_vectors(table(spark, d, "benchmark"), "text")
    return retrieval.retrieve(docs, asked, retrieval.default_plan("hybrid"), "doc_id", "item_id")


@R.add("r15_staged_retrieval")
def _(spark, d):
    docs, asked = vectors.hashed_vectors(table(spark, d, "documents"), "text"), vectors.hashed_vectors(table(spark, d, "benchmark"), "text")
    return retrieval.retrieve(docs, asked, retrieval.default_plan("advanced").override(results=10), "doc_id", "item_id")


@R.add("r11_model_rerank", f"""WITH {_BM25}, h AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS old FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10),
 o AS (SELECT item_id, doc_id, old, list_distinct(list_filter(regexp_split_to_array(b.text, '\\s+'), lambda w: w <> '')) AS q, list_distinct(list_filter(regexp_split_to_array(substr(d.text, 1, 2000), '\\s+'), lambda w: w <> '')) AS t
  FROM h JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id)), z AS (SELECT item_id, doc_id, old, round(len(list_intersect(q, t))::DOUBLE / (1 + len(q)), 6) AS score FROM o)
 SELECT item_id, doc_id, score, row_number() OVER w::INT AS rank, (old - row_number() OVER w)::INT AS rank_change FROM z WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER w <= 5""")
def _(spark, d):
    hits = bm25_top10(spark, d).join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").join(table(spark, d, "benchmark").select("item_id", F.col("text").alias("query")), "item_id")
    return retrieval.rerank(hits, _overlap, "item_id", "doc_id", "query", "text", 5, fallback=None).drop("failed")


def _overlap(queries, texts):
    """Shared words to the query's words; a null text has none, a null query no score."""
    words = lambda t: set(re.split(r"[\t\n\f\r ]+", t or "")) - {""}
    return [None if q is None else len(words(q) & words(t)) / (1 + len(words(q))) for q, t in zip(queries, texts, strict=True)]


@R.add("k3_representatives", """WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2), x AS (SELECT label, vec_id, round(sqrt(sum((embedding[i]::DOUBLE - m) ** 2)), 6) AS distance FROM embeddings JOIN c USING (label) GROUP BY 1, 2)
 SELECT label, vec_id, distance, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id)::INT AS rank FROM x QUALIFY row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) <= 5""")
def _(spark, d):
    return clusters.representatives(table(spark, d, "embeddings"), "label", "vec_id", "embedding")


_KEYS = "w AS (SELECT source, doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 2)) AS term FROM documents), f AS (SELECT source, term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM w GROUP BY 1, 2)"


@R.add("k4_keywords", f"WITH {_KEYS} SELECT source, term, tf::DOUBLE AS score, row_number() OVER (PARTITION BY source ORDER BY tf DESC, term)::INT AS rank FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY tf DESC, term) <= 10")
def _(spark, d):
    return lexical.group_keywords(table(spark, d, "documents"), "source", "doc_id", "text", 10, PATTERN)


@R.add("k5_keywords_enhanced", f"""WITH {_KEYS}, n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
 s AS (SELECT source, term, round(tf * ln(n / df + 1) * CASE WHEN length(term) BETWEEN 3 AND 4 THEN 1.2::DOUBLE ELSE 1 END * pow(1.3, CASE WHEN contains('ertionthe', term) THEN 1 ELSE 0 END + CASE WHEN contains('theand', term) THEN 1 ELSE 0 END), 6) AS score FROM f JOIN n USING (source))
 SELECT source, term, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, term)::INT AS rank FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, term) <= 10""")
def _(spark, d):
    return lexical.group_keywords(table(spark, d, "documents"), "source", "doc_id", "text", 10, PATTERN, compounds=["ertionthe", "theand"], enhanced=True)


@R.add("t6_top_terms", "WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), f AS (SELECT lang, term, count(*) AS n FROM w WHERE length(term) >= 2 GROUP BY 1, 2) SELECT lang, term, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term)::INT AS rank FROM f QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) <= 10")
def _(spark, d):
    words = table(spark, d, "documents").select("lang", F.explode(lexical.terms(F.col("text"), PATTERN)).alias("term")).groupBy("lang", "term").agg(F.count("*").alias("n"))
    return ranking.top_n(words, ["lang"], [F.desc("n"), F.col("term")], 10)


@R.add("t7_multi_key_order", "SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id % 3 DESC, round(embedding[1]::DOUBLE, 6) DESC, vec_id)::INT AS rank FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id % 3 DESC, round(embedding[1]::DOUBLE, 6) DESC, vec_id) <= 10")
def _(spark, d):
    by = [(F.col("vec_id") % 3).desc(), F.round(F.col("embedding")[0].cast("double"), 6).desc(), F.col("vec_id")]
    return ranking.top_n(table(spark, d, "embeddings"), ["label"], by, 10).select("label", "vec_id", "rank")


@R.add("k1_kmeans")
def _(spark, d):
    found = clusters.kmeans(table(spark, d, "embeddings"), "embedding", k=10)
    return found.groupBy("cluster").agg(F.count("*").alias("size"), F.countDistinct("label").alias("labels"), F.round(F.avg("distance"), 4).alias("mean_distance"))


@R.add("k2_silhouette")
def _(spark, d):
    found = clusters.kmeans(table(spark, d, "embeddings"), "embedding", k=10, starts=1)
    return found.agg(F.count("*").alias("rows"), F.countDistinct("cluster").alias("clusters")).withColumn("silhouette", F.lit(round(clusters.silhouette(found, "embedding"), 4)))


@R.add("k6_candidates")
def _(spark, d):
    docs = clusters.kmeans(vectors.hashed_vectors(table(spark, d, "documents"), "text"), "vector", k=8, starts=1)
    return _flat(clusters.candidates(docs, "cluster", "doc_id", "text", ["source", "lang"], "vector"))


def _flat(found):
    """Candidates with their lists as texts."""
    sources = F.array_join(F.transform("sources", lambda s: F.concat_ws("_", s["source"], s["lang"])), ",")
    return found.withColumns({"keywords": F.array_join("keywords", ","), "ids": F.array_join(F.transform("ids", lambda i: i.cast("string")), ","), "sources": sources, "score": F.col("scores.total")}).drop("scores")


# Labels of the vectors stand for clusters of the documents of the same number.
_GROUPS = """g AS (SELECT doc_id, text, source, lang, label, embedding AS v FROM documents JOIN embeddings ON doc_id = vec_id),
 w AS (SELECT label, doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+|[0-9]+'), lambda w: length(w) >= 2)) AS term FROM g),
 t AS (SELECT label, term, count(*) AS tf, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, term) AS rank FROM w GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, term) <= 10),
 m AS (SELECT label, i, avg(v[i]::DOUBLE) AS x FROM g, range(1, 65) r(i) GROUP BY 1, 2), e AS (SELECT g.label, doc_id, round(sqrt(sum((v[i]::DOUBLE - x) ** 2)), 6) AS distance FROM g JOIN m ON m.label = g.label GROUP BY 1, 2),
 n AS (SELECT label, doc_id, row_number() OVER (PARTITION BY label ORDER BY distance, doc_id) AS rank FROM e QUALIFY row_number() OVER (PARTITION BY label ORDER BY distance, doc_id) <= 5),
 s AS (SELECT n.label, n.doc_id, round(sum(CASE WHEN contains(lower(text), term) THEN 1.3 ELSE 0 END + CASE WHEN contains(lower(substr(text, 1, 200)), term) THEN 0.5 ELSE 0 END)::DOUBLE, 6) AS score
  FROM n JOIN g USING (doc_id) JOIN t ON t.label = n.label AND t.rank <= 5 GROUP BY 1, 2),
 b AS (SELECT label, doc_id, row_number() OVER (PARTITION BY label ORDER BY score DESC, doc_id)::INT AS rank FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, doc_id) <= 3)"""


def _grouped(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", F.col("embedding").alias("vector"))
    return staged(table(spark, d, "documents").select("doc_id", "text", "source", "lang").join(v, "doc_id"), "grouped")  # read several times, joined once


@R.add("k3_reranked", f"WITH {_GROUPS} SELECT label, doc_id, rank FROM b")
def _(spark, d):
    docs = _grouped(spark, d)
    near = clusters.representatives(docs, "label", "doc_id", "vector").select("label", "doc_id", "rank")
    return clusters.reranked(docs, near, lexical.group_keywords(docs, "label", "doc_id", "text", 10), "label", "doc_id", "text")


@R.add("k6_candidates_of_labels", f"""WITH {_GROUPS}, z AS (SELECT label, count(*) AS size FROM g GROUP BY 1 ORDER BY size DESC, label LIMIT 4),
 k AS (SELECT label, list(term ORDER BY rank) AS ks FROM t GROUP BY 1), r AS (SELECT b.label, list(doc_id ORDER BY rank) AS ids, list(trim(substr(text, 1, 200)) ORDER BY rank)[1:2] AS heads, list(source || '_' || lang ORDER BY rank) AS ss FROM b JOIN g USING (doc_id) GROUP BY 1)
 SELECT z.label, 'Cluster ' || (z.label + 1) || ': ' || array_to_string(ks[1:3], ', ') AS title, array_to_string(list_filter(heads, lambda h: h <> ''), ' | ') AS summary, array_to_string(ks, ',') AS keywords, array_to_string(ids, ',') AS ids, size,
 array_to_string(list_filter(ss, lambda x, i: list_position(ss, x) = i), ',') AS sources, 0.5::DOUBLE AS score FROM z JOIN k ON k.label = z.label JOIN r ON r.label = z.label""")
def _(spark, d):
    return _flat(clusters.candidates(_grouped(spark, d), "label", "doc_id", "text", ["source", "lang"], "vector", 4))


@R.add("k7_discovery")
def _(spark, d):
    docs = clusters.kmeans(vectors.hashed_vectors(table(spark, d, "documents").where("lang = 'en'"), "text"), "vector", k=8, starts=1)
    scores = docs.join(table(spark, d, "labels"), "doc_id").groupBy("cluster").agg(F.avg("quality").alias("good"), F.avg("toxic").alias("bad"))
    scored = _flat(clusters.candidates(docs, "cluster", "doc_id", "text", ["source", "lang"], "vector")).join(scores, "cluster", "left")
    return scored.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.7 * F.coalesce("good", F.lit(0.0)) + 0.3 * (1 - F.coalesce("bad", F.lit(0.0)))))).orderBy(F.desc("score"), "cluster")


_BY = classify.Dictionary(
    types={"law": ["license", "apache"], "secret": ["token", "key ="], "insult": ["idiot", "clown", "moron"]},
    sectors={"phone": ["555-"], "mail": ["@"], "table": [" | "]},
    depths={"agency": ["1"], "local": ["2", "3"]},
    phases={"deep": ["therefore", "theand"], "plain": ["the ", " en "], "short": ["site"]},
)


def _classes(groups, text):
    """What each group has in a text, in SQL: how many of its words."""
    return {g: " + ".join(f"contains({text}, '{w}')::INT" for w in words) for g, words in groups.items()}


def _first(groups, text, default):
    return "CASE " + " ".join(f"WHEN {n} > 0 THEN '{g}'" for g, n in _classes(groups, text).items()) + f" ELSE {default} END"


_MOST = "greatest(" + ", ".join(_BY.types) + ")"
_CLASS = f"""WITH x AS (SELECT doc_id, source, concat(source, ' ', lang, ' ', text) AS t FROM documents),
 n AS (SELECT doc_id, source, t, {', '.join(f'{n} AS {g}' for g, n in _classes(_BY.types, 't').items())},
  list_filter([{', '.join(f"CASE WHEN {n} > 0 THEN '{g}' END" for g, n in _classes(_BY.sectors, 't').items())}], lambda s: s IS NOT NULL) AS found FROM x),
 s AS (SELECT *, CASE WHEN len(found) = 0 THEN ['general'] ELSE found END AS sectors FROM n),
 c AS (SELECT doc_id, CASE WHEN {_MOST} = 0 THEN 'other' {' '.join(f"WHEN {g} = {_MOST} THEN '{g}'" for g in _BY.types)} END AS type, sectors,
  {_first(_BY.depths, 'source', "'headquarters'")} AS depth, {_first(_BY.phases, 't', 'NULL')} AS phase, round(least(1.0, ({_MOST} + len(sectors)) / 5), 6)::DOUBLE AS confidence,
  list_filter([{', '.join(f"CASE WHEN contains(t, '{w}') THEN '{w}' END" for g in (_BY.types, _BY.sectors) for ws in g.values() for w in ws)}], lambda w: w IS NOT NULL)[1:10] AS keywords FROM s)"""


def _classified(spark, d):
    found = classify.classified(table(spark, d, "documents"), "text", "source", "lang", _BY)
    return found.select("doc_id", "classified.*").withColumn("confidence", F.round("confidence", 6))


@R.add("c33_classified", f"{_CLASS} SELECT doc_id, type, array_to_string(sectors, ',') AS sectors, depth, phase, confidence, array_to_string(keywords, ',') AS keywords FROM c")
def _(spark, d):
    return _classified(spark, d).withColumns({c: F.array_join(c, ",") for c in ("sectors", "keywords")})


@R.add("a20_classification_stats", f"{_CLASS} SELECT type, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, sum(len(sectors))::BIGINT AS tags FROM c GROUP BY 1")
def _(spark, d):
    found = _classified(spark, d).groupBy("type")
    return found.agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.sum(F.size("sectors")).alias("tags"))
