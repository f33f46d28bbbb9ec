"""Windows, ordered reports, top-k, fusion and de-duplication of ranked lists, upserts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import scans


def order(by: list[Column], tie: str) -> list[Column]:
    """The sort keys with the id last, so that ties come out alike every time."""
    return [*by, F.col(tie).asc()]


def top_n(df: DataFrame, group: list[str], by: list[Column], n: int, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*by))).where(F.col(out) <= n)


def page(df: DataFrame, by: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*by).offset(offset).limit(limit)


def islands(df: DataFrame, group: list[str], by: list[str], continues: Column, out: str = "chain", most: int | None = None) -> DataFrame:
    """Numbers runs of rows: a row where ``continues`` isn't true begins a new one. ``continues`` may use windows.

    Here and below, ``most`` says how many rows of a group one task may take (``scans``, which reads ``df`` more than once).
    """
    begins = df.withColumn("__new", F.when(continues, 0).otherwise(1))
    return _scanned(begins, group, by, {out: ("sum", F.col("__new"))}, most).drop("__new")


def within_budget(df: DataFrame, group: list[str], by: list[str], size: Column, limit: int, most: int | None = None) -> DataFrame:
    """Rows in order until the sum of sizes would exceed ``limit``; nothing after the first that doesn't fit."""
    return _scanned(df, group, by, {"__sum": ("sum", size)}, most).where(F.col("__sum") <= limit).drop("__sum")


def filled_down(df: DataFrame, group: list[str], by: list[str], columns: list[str], most: int | None = None) -> DataFrame:
    """Empty cells (null or "") take the last value above."""
    outs = {f"__{c}": ("last", F.nullif(F.col(c), F.lit(""))) for c in columns}
    filled = _scanned(df, group, by, outs, most).withColumns({c: F.col(f"__{c}") for c in columns})
    return filled.drop(*outs)


def running_total(df: DataFrame, group: list[str], by: list[str], value: Column, out: str = "total", most: int | None = None) -> DataFrame:
    return _scanned(df, group, by, {out: ("sum", value)}, most)


def _scanned(df: DataFrame, group: list[str], by: list[str], outs: scans.Outs, most: int | None) -> DataFrame:
    return scans.scan(df, group, by, outs, most) if most else scans.scan_groups(df, group, by, outs)


def min_max(df: DataFrame, group: str, score: str, out: str = "norm") -> DataFrame:
    """Scores to 0..1 within each group; 0.5 where all are alike."""
    w = Window.partitionBy(group)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return df.withColumn(out, F.when(hi - lo < 1e-10, 0.5).otherwise((F.col(score) - lo) / (hi - lo)))


def fused(lists: list[DataFrame], query: str, key: str, rank: str, weights: list[float] | None = None, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion: the sum over lists of weight / (k + rank)."""
    weights = weights or [1.0] * len(lists)
    parts = [x.select(query, key, (F.lit(w) / (k + F.col(rank))).alias("__part"), F.lit(i).alias("__list")) for i, (x, w) in enumerate(zip(lists, weights, strict=True))]
    return reduce(DataFrame.unionByName, parts).groupBy(query, key).agg(F.sum("__part").alias("score"), F.count("*").alias("lists"))


def merged(lists: list[tuple[str, DataFrame]], query: str, key: str, score: str) -> DataFrame:
    """Union of result lists by id: how many hold it, the best score, and which."""
    parts = [x.select(query, key, score, F.lit(name).alias("__source")) for name, x in lists]
    return reduce(DataFrame.unionByName, parts).groupBy(query, key).agg(F.count("*").alias("matches"), F.max(score).alias("score"), F.array_sort(F.collect_set("__source")).alias("sources"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` over ``old`` by key (a version of the table; nothing is changed in place). Keys in ``new`` should be unique."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def latest_version(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """One row for each key: the first by ``by``."""
    return top_n(df, keys, by, 1, "__n").drop("__n")


def upsert_report(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """How many keys of ``new`` are added, updated, and the total then."""
    flagged = new.select(key).distinct().join(old.select(F.col(key), F.lit(1).alias("__old")).distinct(), key, "left")
    counts = flagged.agg(F.count_if(F.col("__old").isNull()).alias("added"), F.count_if(F.col("__old").isNotNull()).alias("updated"))
    return counts.crossJoin(old.agg(F.countDistinct(key).alias("__n"))).select("added", "updated", (F.col("__n") + F.col("added")).alias("total"))


def named_order(*names: str, locale: str = "ko") -> list[Column]:
    """What to order by for names as a reader of the locale expects them: letters of any case together, the small one first."""
    return [F.collate(F.col(n), locale) for n in names]


def best_of_engines(results: DataFrame, file: str, engine: str, order: str, quality: str, enough: float) -> DataFrame:
    """file, engine, quality, tried: engines are tried in order until one reaches ``enough``; of those tried the best, the first of equal ones.

    An engine that failed has a null quality and is tried all the same; a file that all failed on has nulls.
    """
    row = F.struct(F.col(order).alias("o"), F.col(engine).alias("e"), F.col(quality).alias("q"))
    first = F.min_by(row, F.when(F.col(quality) >= enough, F.col(order)))
    best = F.max_by(row, F.when(F.col(quality).isNotNull(), F.struct(F.col(quality), -F.col(order))))
    found = results.groupBy(file).agg(first.alias("__first"), best.alias("__best"), F.array_sort(F.collect_list(order)).alias("__orders"))  # engines of a file are few
    tried = F.size(F.filter("__orders", lambda o: F.col("__first").isNull() | (o <= F.col("__first.o"))))
    chosen = F.coalesce("__first", "__best")
    return found.select(file, chosen["e"].alias(engine), chosen["q"].alias(quality), tried.cast("long").alias("tried"))
