"""Staged retrieval for a set of queries: candidates, fusion, rerank; and the slots where models plug in.

Slots: an ``embed(DataFrame, text, out)`` function, a ``score(pairs) -> pairs with score`` function. The library ships deterministic stand-ins only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import lexical, ranking, segments, vectors
from sparkloom.sources.staging import staged


@dataclass(frozen=True)
class Plan:
    """What a retrieval does; ``replace`` gives another."""

    strategy: str = "hybrid"  # basic: vectors alone; hybrid: and BM25, fused; advanced: and reranked
    candidates: int = 50
    fused: int = 80
    results: int = 15
    hybrid_over: int = 20
    rerank_over: int = 5
    weights: tuple[float, float] = (0.6, 0.4)

    def override(self, **changes) -> Plan:
        return replace(self, **changes)


def default_plan(strategy: str) -> Plan:
    return {"basic": Plan("basic", results=10), "hybrid": Plan("hybrid"), "advanced": Plan("advanced", candidates=80)}[strategy]


def multi_query(hits: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """Hits of several queries of a group as one list: by how many found it, then the best score."""
    merged = hits.groupBy(group, key).agg(F.count("*").alias("matches"), F.max("score").alias("score"))
    return ranking.top_n(merged, [group], [F.desc("matches"), F.desc("score"), F.col(key)], n)


def hybrid(semantic: DataFrame, lexical_hits: DataFrame, query_key: str, key: str, weights: tuple[float, float], n: int) -> DataFrame:
    """Both lists rank every candidate of either (those without a score last), then reciprocal ranks are fused."""
    a, b = semantic.select(query_key, key, F.col("score").alias("s")), lexical_hits.select(query_key, key, F.col("score").alias("l"))
    both = a.join(b, [query_key, key], "full_outer").na.fill(0.0, ["s", "l"])
    w = Window.partitionBy(query_key)
    ranked = both.withColumn("rs", F.row_number().over(w.orderBy(F.desc("s"), F.col(key)))).withColumn("rl", F.row_number().over(w.orderBy(F.desc("l"), F.col(key))))
    score = weights[0] / (60 + F.col("rs")) + weights[1] / (60 + F.col("rl"))
    return lexical.best(ranked.withColumn("score", score).select(query_key, key, "score"), query_key, key, n, 8)


def retrieve(
    docs: DataFrame, queries: DataFrame, plan: Plan, doc_key: str, query_key: str, text: str = "text", vector: str = "vector",
    search: Callable[[DataFrame, int], DataFrame] | None = None, index: segments.Index | None = None,
) -> DataFrame:
    """query_key, doc_key, score, rank. Steps apply per query: fusion only where there are over ``hybrid_over`` candidates, rerank over ``rerank_over``.

    ``search(queries, k)`` may take the place of the exact vector search: it gives query_key, doc_key, score, rank of at most k rows a query; filters go into it.
    ``index`` is a stored one of ``docs``; without one it is built, which reads the texts once. Hits are written once and read by all steps.
    """
    found = search(queries, plan.candidates) if search else vectors.top_k(docs, queries, doc_key, vector, query_key, vector, plan.candidates)
    if plan.strategy == "basic":
        return found.where(F.col("rank") <= plan.results).select(query_key, doc_key, "score", "rank")
    found = staged(found.select(query_key, doc_key, "score", "rank"), "hits")
    many = found.withColumn("__n", F.count("*").over(Window.partitionBy(query_key)))
    asked = queries.join(many.where(F.col("__n") > plan.hybrid_over).select(query_key).distinct(), query_key, "left_semi")
    words = (index or segments.build(docs, doc_key, text)).search(asked, query_key, doc_key, plan.candidates, text)
    fused = hybrid(many.join(asked.select(query_key), query_key, "left_semi"), words, query_key, doc_key, plan.weights, plan.fused)
    few = many.where(F.col("__n") <= plan.hybrid_over).select(query_key, doc_key, "score", "rank")
    found = staged(fused.select(query_key, doc_key, "score", "rank").unionByName(few), "fused")
    if plan.strategy == "hybrid":
        return found.where(F.col("rank") <= plan.results)
    counted = found.withColumn("__n", F.count("*").over(Window.partitionBy(query_key)))
    pairs = counted.where(F.col("__n") > plan.rerank_over).join(docs.select(doc_key, F.col(text).alias("__doc")), doc_key).join(queries.select(query_key, F.col(text).alias("__query")), query_key)
    again = lexical.keyword_rerank(pairs, "__query", "__doc", query_key, doc_key, plan.results).select(query_key, doc_key, "score", "rank")
    return again.unionByName(counted.where(F.col("__n") <= plan.rerank_over).select(query_key, doc_key, "score", "rank"))


def rerank(
    pairs: DataFrame, score: Callable[[list[str], list[str]], list[float]], query_key: str, key: str, query: str, text: str, n: int, longest: int = 2000, fallback: float | None = 0.5,
) -> DataFrame:
    """Model rerank: pairs scored in batches by ``score(queries, texts)``. Adds rank, rank_change from the rank before, and failed.

    A batch that fails, or gets another number of scores than it has pairs, scores ``fallback``, and ``failed`` tells its rows from scored ones; without a fallback the job ends with the error.
    """

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                found = [None if x is None else float(x) for x in score(b["__q"].tolist(), b["__t"].str[:longest].tolist())]
                if len(found) != len(b):
                    raise ValueError(f"{len(found)} scores for {len(b)} pairs")
                b["score"], b["failed"] = pd.Series(found, b.index, "float64"), False
            except Exception:
                if fallback is None:
                    raise
                b["score"], b["failed"] = fallback, True
            yield b[[query_key, key, "__old", "score", "failed"]]

    kinds = {c: pairs.schema[c].dataType.simpleString() for c in (query_key, key)}
    rows = pairs.select(query_key, key, F.col("rank").alias("__old"), F.col(query).alias("__q"), F.col(text).alias("__t"))
    found = rows.mapInPandas(scored, f"{query_key} {kinds[query_key]}, {key} {kinds[key]}, __old int, score double, failed boolean")
    return lexical.best(found, query_key, key, n).withColumn("rank_change", F.col("__old") - F.col("rank")).drop("__old")


def answered(prompts: DataFrame, answer: Callable[[list[str], list[str]], list[str]], prompt: str, system: str | None = None, out: str = "answer") -> DataFrame:
    """``prompts`` with what ``answer(systems, prompts)`` says to each, a batch at a time; null prompts get null, a batch that fails gets nulls. No model is shipped."""

    @F.pandas_udf("string")
    def said(systems: pd.Series, asked: pd.Series) -> pd.Series:
        have = asked.notna()
        result = pd.Series([None] * len(asked), dtype=object)
        try:
            result[have] = list(answer(systems[have].fillna("").tolist(), asked[have].tolist()))
        except Exception:
            result[:] = None
        return result

    return prompts.withColumn(out, said(F.col(system) if system else F.lit(""), F.col(prompt)))


def multi_hop(first: DataFrame, search: Callable[[DataFrame], DataFrame], next_queries: Callable[[DataFrame], DataFrame], hops: int = 3) -> DataFrame:
    """Hits of each hop, numbered; ``next_queries`` makes the next hop's queries out of the hits. The number of hops is fixed and small."""
    queries, found = first, None
    for hop in range(hops):
        hits = search(queries).withColumn("hop", F.lit(hop))
        found = hits if found is None else found.unionByName(hits)
        queries = next_queries(hits)
    return found
