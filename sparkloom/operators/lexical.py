"""Lexical retrieval for many queries at once: an inverted index as a DataFrame, joined to the queries' terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Runs of Hangul, of Latin letters, of digits.
TERMS = r"[\x{AC00}-\x{D7AF}]+|[a-z]+|[0-9]+"


def terms(x: Column, pattern: str = TERMS, shortest: int = 2) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(x), F.lit(pattern), 0), lambda w: F.char_length(w) >= shortest)


def postings(docs: DataFrame, key: str, text: str, pattern: str = TERMS) -> DataFrame:
    """key, term, tf."""
    return docs.select(key, F.explode(terms(F.col(text), pattern)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, doc_key: str, query_key: str, text: str = "text", pattern: str = TERMS, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query_key, doc_key, score of every pair that shares a term; a term that a query repeats counts as often.

    idf = ln(N - df + 0.5) - ln(df + 0.5); where negative, a quarter of the mean over all terms. Only postings of the queries' terms meet the
    queries; the sums over the corpus (N, mean length, mean idf) are single rows.
    """
    index = postings(docs, doc_key, text, pattern)
    lengths = docs.select(doc_key, F.size(terms(F.col(text), pattern)).alias("dl"))
    corpus = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = index.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(corpus))
    df = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.agg(F.avg("raw").alias("mean_idf"))
    asked = queries.select(query_key, F.explode(terms(F.col(text), pattern)).alias("term")).groupBy(query_key, "term").agg(F.count("*").alias("qtf"))
    idf = df.join(asked.select("term").distinct(), "term", "left_semi").crossJoin(F.broadcast(mean)).select("term", "avgdl", F.when(F.col("raw") < 0, 0.25 * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    hits = asked.join(idf, "term").join(index, "term").join(lengths, doc_key)
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy(query_key, doc_key).agg(F.sum(part).alias("score"))


def bm25_plain(docs: DataFrame, queries: DataFrame, doc_key: str, query_key: str, text: str = "text", pattern: str = TERMS, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Without idf; a document's length is its characters; each term of a query counts once."""
    index = postings(docs, doc_key, text, pattern)
    lengths = docs.select(doc_key, F.char_length(text).alias("dl"))
    mean = lengths.agg(F.avg("dl").alias("avgdl"))
    asked = queries.select(query_key, F.explode(F.array_distinct(terms(F.col(text), pattern))).alias("term"))
    hits = asked.join(index, "term").join(lengths, doc_key).crossJoin(F.broadcast(mean))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hits.groupBy(query_key, doc_key).agg(F.sum(part).alias("score"))


def best(scored: DataFrame, query_key: str, doc_key: str, n: int, digits: int = 6) -> DataFrame:
    """The n best of each query, by rounded score, then id."""
    rounded = scored.withColumn("score", F.round("score", digits))
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), F.col(doc_key))
    return rounded.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def keyword_rerank(candidates: DataFrame, query: str, text: str, query_key: str, doc_key: str, n: int, pattern: str = TERMS, head: int = 200) -> DataFrame:
    """1 a term that occurs, 0.5 more if in the first characters, 0.3 more for being in a line; the n best of each query."""
    words = F.array_distinct(terms(F.col(query), pattern))
    low, start = F.lower(text), F.lower(F.substring(text, 1, head))
    hits = F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.when(F.contains(low, w), 1.3).otherwise(0.0) + F.when(F.contains(start, w), 0.5).otherwise(0.0))
    return best(candidates.withColumn("score", hits), query_key, doc_key, n)


def group_keywords(docs: DataFrame, group: str, key: str, text: str, n: int, pattern: str = TERMS, stop: list[str] | None = None, compounds: list[str] | None = None, enhanced: bool = False) -> DataFrame:
    """The n top terms of each group: by frequency, or (enhanced) by tf ln(N / df + 1), 1.2 times for 3 or 4 letters and 1.3 times for each compound they are in."""
    words = docs.select(group, key, F.explode(terms(F.col(text), pattern)).alias("term")).where(~F.col("term").isin(stop or [""]))
    tf = words.groupBy(group, "term").agg(F.count("*").alias("tf"), *[F.countDistinct(key).alias("df")] * enhanced)
    score = F.col("tf").cast("double")
    if enhanced:
        size = docs.groupBy(group).agg(F.count("*").alias("n_docs"))
        tf = tf.join(size, group)
        length = F.when(F.char_length("term").between(3, 4), 1.2).otherwise(1.0)
        inside = sum((F.when(F.contains(F.lit(c), F.col("term")), 1).otherwise(0) for c in compounds or []), F.lit(0))
        score = F.col("tf") * F.log(F.col("n_docs") / F.col("df") + 1) * length * F.pow(F.lit(1.3), inside)
    return best(tf.withColumn("score", score), group, "term", n).select(group, "term", "score", "rank")
