"""Filters as data: dictionaries of conditions compiled to Columns, which Catalyst pushes to the scan."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def condition(where: dict[str, Any] | None) -> Column:
    """{"a": 1, "b": {"$in": [..]}, "$or": [..], "$and": [..]} as a Column; nothing is no filter."""
    parts = []
    for key, value in (where or {}).items():
        if key in ("$and", "$or"):
            inner = [condition(x) for x in value]
            if inner:
                parts.append(reduce(lambda a, b: a & b if key == "$and" else a | b, inner))
        elif isinstance(value, dict):
            ops = {"$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$in": lambda c, v: c.isin(list(v)), "$nin": lambda c, v: ~c.isin(list(v)), "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v, "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v}
            parts += [ops[op](F.col(key), v) for op, v in value.items()]
        else:
            parts.append(F.col(key) == value)
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def any_tag(tags: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(tags, F.array(*map(F.lit, wanted)))


def month_range(ts: str, start: str | None, end: str | None, first: str = "2020-01", last: str = "2030-12") -> Column:
    """Months between two bounds, given as YYYY or YYYY-MM: a year alone is its January as a start, its December as an end."""
    lo = first if not start else start if len(start) == 7 else f"{start}-01"
    hi = last if not end else end if len(end) == 7 else f"{end}-12"
    return F.date_format(ts, "yyyy-MM").between(lo, hi)


def exists_map(ids: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Every id asked for, and whether the collection has it."""
    found = df.select(key).distinct().withColumn("__found", F.lit(True))
    return ids.join(found, key, "left").select(key, F.coalesce("__found", F.lit(False)).alias("found"))


def delete_report(df: DataFrame, gone: Column) -> DataFrame:
    return df.agg(F.count_if(gone).alias("deleted"), F.count_if(~F.coalesce(gone, F.lit(False))).alias("remaining"))


def patched(df: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New values over current ones; columns that a patch leaves null stay."""
    p = patches.select(F.col(key), *[F.col(c).alias(f"__{c}") for c in columns])
    return df.join(p, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def range_gate(df: DataFrame, group: list[str], by: list[Column], day: Column, start: Column, end: Column) -> DataFrame:
    """gate: ``keep``, ``skip`` (after the range, or behind a stop) or ``stop`` (the first before it), in order, newest first; undated rows are kept until then."""
    w = Window.partitionBy(*group).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    stops = F.when(day < start, 1).otherwise(0)
    seen = df.withColumn("__stop", stops).withColumn("__seen", F.coalesce(F.max("__stop").over(w), F.lit(0)))
    return seen.withColumn("gate", F.when(F.col("__seen") == 1, "skip").when(F.col("__stop") == 1, "stop").when(day > end, "skip").otherwise("keep")).drop("__stop", "__seen")


def allowed_extension(name: Column, allowed: list[str]) -> Column:
    """The file's extension is one of ``allowed``, dots and case aside; an empty list allows all."""
    if not allowed:
        return F.lit(True)
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)).isin([x.lower().replace(".", "") for x in allowed])


def field_search(df: DataFrame, fields: dict[str, tuple[str, list[str]]]) -> Column:
    """AND over fields, OR over keywords; modes exact, regex (any case) and contains (any case). Null passes, as do fields that aren't there."""
    parts = [F.lit(True)]
    for name, (mode, words) in fields.items():
        if name not in df.columns or not words:
            continue
        c = F.col(name).cast("string")
        tests = {"exact": lambda w, c=c: c == w, "regex": lambda w, c=c: c.rlike(f"(?i){w}"), "contains": lambda w, c=c: F.lower(c).contains(w.lower())}
        parts.append(c.isNull() | reduce(lambda a, b: a | b, [tests[mode](w) for w in words]))
    return reduce(lambda a, b: a & b, parts)


def cascade(keywords: DataFrame, rows: DataFrame, tiers: list[tuple[Column, Column]], word: str, key: list[str], n: int) -> DataFrame:
    """For each keyword the rows of the first tier that has any, at most n, one for each key. tiers: (key of keywords, key of rows), joined by equality."""
    found = None
    for i, (a, b) in enumerate(tiers):
        hit = keywords.select(word, F.explode(a).alias("__k")).join(rows.withColumn("__k", F.explode(b)), "__k").drop("__k").withColumn("tier", F.lit(i + 1))
        found = hit if found is None else found.unionByName(hit)
    one = found.groupBy(word, *key).agg(F.min("tier").alias("tier"))
    best = one.withColumn("__best", F.min("tier").over(Window.partitionBy(word))).where("tier = __best").drop("__best")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(word).orderBy(*key))).where(F.col("rank") <= n)
