"""Clusters of a collection: k-means on vectors, representatives, keywords and scored candidates."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.lexical import group_keywords, keyword_rerank
from sparkloom.operators.vectors import dot
from sparkloom.sources.staging import staged


def kmeans(df: DataFrame, vector: str, k: int = 15, seed: int = 42, starts: int = 10, least: int = 3) -> DataFrame:
    """``df`` with cluster and distance; the best of several starts; clusters under ``least`` rows are dropped. k shrinks to a third of the rows.

    Rows are written once with their vectors; only vectors are kept for the fit.
    """
    df = staged(df, "vectors")
    features = array_to_vector(F.col(vector).cast("array<double>")).alias("__features")
    rows = df.select(features).persist()
    n = rows.count()
    if n < k:
        k = max(2, n // 3)
    models = [KMeans(k=k, seed=seed + i, featuresCol="__features", predictionCol="cluster").fit(rows) for i in range(starts)]
    model = min(models, key=lambda m: m.summary.trainingCost)
    rows.unpersist()
    centres = df.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centroid array<double>")
    found = model.transform(df.select("*", features)).drop("__features").join(F.broadcast(centres), "cluster")
    difference = F.zip_with(vector, "centroid", lambda a, b: a.cast("double") - b)
    found = found.withColumn("distance", F.sqrt(dot(difference, difference)))
    large = found.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return found.join(F.broadcast(large.select("cluster")), "cluster", "left_semi")  # a row for each cluster: no task has to read one whole


def silhouette(clustered: DataFrame, vector: str) -> float:
    return ClusteringEvaluator(featuresCol="__features", predictionCol="cluster").evaluate(clustered.withColumn("__features", array_to_vector(F.col(vector).cast("array<double>"))))


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vector of each group, a row for each."""
    each = df.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def representatives(df: DataFrame, group: str, key: str, vector: str, n: int = 5) -> DataFrame:
    """The n rows nearest to each group's mean."""
    joined = df.select(group, key, vector).join(centroids(df, group, vector), group)
    difference = F.zip_with(vector, "centroid", lambda a, b: a.cast("double") - b)
    near = joined.withColumn("distance", F.round(F.sqrt(dot(difference, difference)), 6))
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("distance", key))).where(F.col("rank") <= n).select(group, key, "distance", "rank")


def _few(df: DataFrame) -> DataFrame:
    """A few rows a group, written and then broadcast, so that the texts they are joined to aren't shuffled."""
    return F.broadcast(staged(df, "few"))


def reranked(df: DataFrame, near: DataFrame, keywords: DataFrame, group: str, key: str, text: str, top: int = 3, words: int = 5) -> DataFrame:
    """group, key, rank: the ``top`` of each group's representatives ``near`` (group, key, rank), by how well their texts meet its first keywords.

    ``keywords``: group, term, rank. Groups of ``top`` representatives or fewer, or without keywords, keep their order.
    """
    query = keywords.where(F.col("rank") <= words).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("q"))  # at most ``words`` a group
    query = query.select(group, F.array_join(F.transform("q", lambda s: s["term"]), " ").alias("__query"))
    texts = staged(df.select(key, F.col(text).alias("__text")).join(_few(near), key), "texts").join(F.broadcast(query), group, "left")
    texts = texts.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(group)))
    scored = (F.col("__n") > top) & F.col("__query").isNotNull()
    again = keyword_rerank(texts.where(scored), "__query", "__text", group, key, top).select(group, key, "rank")
    kept = texts.where(~scored).where(F.col("rank") <= top).select(group, key, "rank")
    return again.unionByName(kept)


def candidates(df: DataFrame, group: str, key: str, text: str, sources: list[str], vector: str, n: int = 10, words: int = 10, label: str = "Cluster") -> DataFrame:
    """The n largest groups as issues: title, summary, keywords, ids of the representatives, size, sources and first scores.

    title: the group's number from 1 and its first three keywords; summary: the first 200 characters of two representatives; sources: the
    distinct ones of the representatives, in their order, five at most. A group has five representatives, reranked to three, so nothing
    that is collected grows with it. Scores are those before any model has judged. ``df`` is evaluated several times: stage what is costly.
    """
    top = df.groupBy(group).agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), group).limit(n)
    df = df.join(F.broadcast(top.select(group)), group, "left_semi")
    terms = staged(group_keywords(df, group, key, text, words), "keywords")
    near = representatives(df, group, key, vector).select(group, key, "rank")
    reps = reranked(df, near, terms, group, key, text)
    of = df.select(key, F.substring(text, 1, 200).alias("__text"), F.struct(*sources).alias("__source")).join(_few(reps), key)
    listed = of.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(key).alias("id"), "__text", "__source"))).alias("r"))
    named = terms.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]).alias("keywords"))
    heads = F.filter(F.transform(F.slice("r", 1, 2), lambda s: F.trim(F.substring(F.coalesce(s["__text"], F.lit("")), 1, 200))), lambda t: t != "")
    rows = top.join(listed, group, "left").join(named, group, "left")
    empty = F.array().cast("array<string>")
    return rows.select(
        group, F.concat(F.lit(f"{label} "), (F.col(group) + 1).cast("string"), F.lit(": "), F.array_join(F.slice(F.coalesce("keywords", empty), 1, 3), ", ")).alias("title"),
        F.when(F.size(heads) > 0, F.array_join(heads, " | ")).alias("summary"), F.coalesce("keywords", empty).alias("keywords"), F.transform("r", lambda s: s["id"]).alias("ids"), "size",
        F.slice(F.array_distinct(F.transform("r", lambda s: s["__source"])), 1, 5).alias("sources"),
        F.struct(F.lit(0.5).alias("total"), *[F.lit(0.0).alias(c) for c in ("legal_mandatory", "novelty", "impact", "international")]).alias("scores"),
    )
