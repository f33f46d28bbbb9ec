"""Collection statistics over a catalog (documents, attachments, run logs) as DataFrames.

Times are compared with an explicit ``as_of``, never with the clock, so that runs can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percentage of part in whole, rounded; 0 if there is nothing."""
    return F.when(whole > 0, F.round(100.0 * part / whole, digits)).otherwise(F.lit(0.0))


def global_counts(docs: DataFrame, files: DataFrame, board: str, pending: Column) -> DataFrame:
    """Documents, distinct boards, attachments and those pending: one pass over either table."""
    return docs.agg(F.count("*").alias("documents"), F.countDistinct(board).alias("boards")).crossJoin(files.agg(F.count("*").alias("attachments"), F.count_if(pending).alias("pending")))


def status_summary(runs: DataFrame, ts: str, failed: Column, running: Column, size: Column, as_of: str, hours: int = 24) -> DataFrame:
    """Totals, today's runs, those running, the failure rate of the last hours (in %), and bytes."""
    now = F.lit(as_of).cast("timestamp_ntz")
    recent = F.col(ts).between(now - F.expr(f"interval {hours} hours"), now)
    return runs.agg(
        F.count("*").alias("total"), F.count_if(F.to_date(ts) == F.to_date(now)).alias("today"), F.count_if(running).alias("running"),
        share(F.count_if(recent & failed), F.count_if(recent)).alias("failure_rate"), F.round(F.coalesce(F.sum(size), F.lit(0.0)), 2).alias("bytes"),
    )


def week_key(day: Column) -> Column:
    """Year and Monday-first, zero-based week of the year, as ``%Y-W%W``."""
    week = F.floor((F.dayofyear(day) - 1 + 7 - F.weekday(day)) / 7)
    return F.concat(F.year(day).cast("string"), F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))


def bucket_key(ts: str, unit: str) -> Column:
    return {"day": F.date_format(ts, "yyyy-MM-dd"), "month": F.date_format(ts, "yyyy-MM"), "week": week_key(F.to_date(ts))}[unit]


def calendar(spark, start: str, end: str, unit: str) -> DataFrame:
    """bucket: every day or month between two dates; from the month's first, so that short months aren't skipped."""
    first = F.trunc(F.lit(start).cast("date"), "month") if unit == "month" else F.lit(start).cast("date")
    step = F.expr(f"interval 1 {unit}")
    return spark.range(1).select(F.explode(F.sequence(first, F.lit(end).cast("date"), step)).alias("day")).select(F.date_format("day", "yyyy-MM" if unit == "month" else "yyyy-MM-dd").alias("bucket"))


def timeline(docs: DataFrame, files: DataFrame, doc_ts: str, file_ts: str, start: str, end: str, unit: str = "day") -> DataFrame:
    """Documents and attachments by day, week or month; days and months without any are there with 0, weeks aren't."""
    within = lambda df, ts: df.where((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.to_date(ts) <= F.lit(end).cast("date"))).select(bucket_key(ts, unit).alias("bucket"))
    a = within(docs, doc_ts).groupBy("bucket").agg(F.count("*").alias("documents"))
    b = within(files, file_ts).groupBy("bucket").agg(F.count("*").alias("attachments"))
    both = a.join(b, "bucket", "full_outer")
    if unit != "week":
        both = calendar(docs.sparkSession, start, end, unit).join(both, "bucket", "left")
    return both.select("bucket", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("attachments", F.lit(0)).alias("attachments"))


def type_stats(files: DataFrame, kind: Column, size: Column) -> DataFrame:
    """Count, bytes and share of each type; blank types are ``unknown``."""
    name = F.coalesce(F.nullif(F.trim(F.lower(kind)), F.lit("")), F.lit("unknown"))
    found = files.groupBy(name.alias("type")).agg(F.count("*").alias("n"), F.round(F.sum(size), 2).alias("bytes"))
    total = F.sum("n").over(Window.partitionBy())  # as many rows as types
    return found.select("type", "n", "bytes", share(F.col("n"), total).alias("share"))


def board_stats(docs: DataFrame, files: DataFrame, doc_id: str, file_doc: str, board: list[str], ts: str, size: Column, as_of: str, days: int = 7) -> DataFrame:
    """Documents, last one, recent ones, attachments and bytes of each board, including boards whose documents have no attachment.

    Attachments are summed up by document before the join, so the join carries one row for a document.
    """
    recent = F.col(ts) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"interval {days} days")
    per_doc = files.groupBy(F.col(file_doc).alias("__doc")).agg(F.count("*").alias("__n"), F.sum(size).alias("__bytes"))
    joined = docs.join(per_doc, docs[doc_id] == per_doc["__doc"], "left")
    return joined.groupBy(*board).agg(
        F.count("*").alias("documents"), F.date_format(F.max(ts), "yyyy-MM-dd").alias("last_seen"), F.count_if(recent).alias("recent"),
        F.coalesce(F.sum("__n"), F.lit(0)).alias("attachments"), F.round(F.coalesce(F.sum("__bytes"), F.lit(0.0)), 2).alias("bytes"),
    )


def success_rates(runs: DataFrame, by: list[str], ok: Column, amount: Column) -> DataFrame:
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), F.count_if(ok).alias("succeeded"), share(F.count_if(ok), F.count("*")).alias("success_rate"), F.round(F.sum(F.when(ok, amount).otherwise(0.0)), 2).alias("amount"))


def latest_per_group(df: DataFrame, key: str, ts: str) -> DataFrame:
    """The latest rows of each key; rows that tie are all there."""
    return df.withColumn("__rank", F.rank().over(Window.partitionBy(key).orderBy(F.col(ts).desc()))).where("__rank = 1").drop("__rank")


def error_stats(runs: DataFrame, key: str, ts: str, failed: Column, error_class: Column, classes: list[str], as_of: str) -> DataFrame:
    """By error class (each there, with 0 if need be): errors of the last day and week, and keys whose latest run failed so."""
    now = F.lit(as_of).cast("timestamp_ntz")
    errors = runs.where(failed).withColumn("class", error_class)
    counts = errors.groupBy("class").agg(F.count_if(F.col(ts) >= now - F.expr("interval 1 day")).alias("last_day"), F.count_if(F.col(ts) >= now - F.expr("interval 7 days")).alias("last_week"))
    pending = latest_per_group(runs, key, ts).where(failed).withColumn("class", error_class).groupBy("class").agg(F.countDistinct(key).alias("pending"))
    names = runs.sparkSession.createDataFrame([(c,) for c in classes], "class string")
    joined = names.join(counts, "class", "left").join(pending, "class", "left")
    return joined.select("class", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("last_day", "last_week", "pending")])


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows by value; null is ``unknown``."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))


def tag_counts(df: DataFrame, tags: Column) -> DataFrame:
    """Rows by tag of a multi-valued column."""
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def facet_stats(df: DataFrame, org: str, board: str, kind: str, month: Column) -> DataFrame:
    """Counts by org, by org and board, by kind, and overall, with the range of months: grouping sets in one pass."""
    df = df.select(F.col(org).alias("org"), F.col(board).alias("board"), F.col(kind).alias("kind"), month.alias("month"))
    found = df.groupingSets([["org"], ["org", "board"], ["kind"], []], "org", "board", "kind")
    return found.agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))


def hierarchy_totals(df: DataFrame, levels: list[str], size: Column) -> DataFrame:
    """Files and bytes at every level of a hierarchy, up to the whole: a rollup."""
    return df.rollup(*levels).agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("files"), F.round(F.sum(size), 2).alias("bytes"))


def progress_stats(df: DataFrame, status: str, done: str, failed: str, amount: Column) -> DataFrame:
    rate = lambda x: F.when(F.count("*") > 0, F.round(100.0 * x / F.count("*"))).otherwise(0).cast("int")
    is_done, is_failed = F.count_if(F.col(status) == done), F.count_if(F.col(status) == failed)
    return df.agg(F.count("*").alias("total"), is_done.alias("done"), is_failed.alias("failed"), F.round(F.sum(amount), 2).alias("amount"), rate(is_done).alias("done_rate"), rate(is_failed).alias("failed_rate"), rate(F.count("*") - is_done - is_failed).alias("open_rate"))


def cost_history(usage: DataFrame, ts: str, model: str, cost: str, start: str, end: str, unit: str = "day") -> DataFrame:
    """Cost and requests by bucket, zero-filled, with the running total. The window is over the calendar's rows."""
    within = usage.where(F.to_date(ts).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    found = within.groupBy(bucket_key(ts, unit).alias("bucket")).agg(F.count("*").alias("requests"), F.sum(cost).alias("cost"), F.countDistinct(model).alias("models"))
    filled = calendar(usage.sparkSession, start, end, unit).join(found, "bucket", "left").na.fill(0)
    running = F.sum("cost").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return filled.select("bucket", "requests", "models", F.round("cost", 2).alias("cost"), F.round(running, 2).alias("running_cost"))


def model_totals(usage: DataFrame, ts: str, model: str, cost: str, as_of: str) -> DataFrame:
    """All-time, last-week and this-month cost by model."""
    now = F.lit(as_of).cast("timestamp_ntz")
    week, month = F.col(ts) >= now - F.expr("interval 7 days"), F.col(ts) >= F.date_trunc("month", now).cast("timestamp_ntz")
    total = lambda c: F.round(F.sum(F.when(c, F.col(cost)).otherwise(0.0)), 2)
    return usage.groupBy(F.col(model).alias("model")).agg(F.count("*").alias("requests"), total(F.lit(True)).alias("total"), total(week).alias("week"), total(month).alias("month"))


def usage_meter(usage: DataFrame, ts: str, provider: str, providers: list[str], tokens: Column, rates: DataFrame) -> DataFrame:
    """Cost by month with a column for each provider; ``rates``: provider, rate per million tokens (a row each, so it is broadcast)."""
    priced = usage.withColumn("provider", F.col(provider)).join(F.broadcast(rates), "provider").withColumn("cost", tokens / 1e6 * F.col("rate"))
    return priced.groupBy(F.date_format(ts, "yyyy-MM").alias("month")).pivot("provider", providers).agg(F.round(F.sum("cost"), 6)).na.fill(0.0)


def running_stats(usage: DataFrame, ok: Column, tokens: Column, rate: float) -> DataFrame:
    """Totals recomputed from the append-only facts."""
    return usage.agg(F.count_if(ok).alias("processed"), F.count_if(~ok).alias("failed"), F.sum(tokens).cast("long").alias("tokens"), F.round(F.sum(tokens) / 1e6 * rate, 6).alias("cost"))


def group_by_key(df: DataFrame, key: str, targets: str, name: str) -> DataFrame:
    """Rows of equal key as one: their names and the union of their targets, both sorted. Targets are made distinct before any key gathers them."""
    distinct = df.select(key, F.explode(targets).alias("__t")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("__t")).alias("targets"))
    names = df.groupBy(key).agg(F.array_sort(F.collect_list(name)).alias("names"))  # what was asked for: all names, one each
    none = F.array().cast(df.schema[targets].dataType)
    return names.join(distinct, key, "left").select(key, F.coalesce("targets", none).alias("targets"), "names")


def cost_estimate(df: DataFrame, tokens: Column, rates: DataFrame) -> DataFrame:
    """What a corpus costs with each model; ``rates``: model, rate per million tokens."""
    total = df.agg(F.sum(tokens).cast("long").alias("tokens"))
    return rates.crossJoin(F.broadcast(total)).select("model", "tokens", F.round(F.col("tokens") / 1e6 * F.col("rate"), 6).alias("cost"))


def first_distinct(df: DataFrame, group: str, value: str, pos: str, n: int = 5) -> DataFrame:
    """The first n distinct values of each group in order of appearance."""
    seen = df.groupBy(group, value).agg(F.min(pos).alias("__pos"))
    top = seen.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy("__pos", value))).where(F.col("__n") <= n)
    return top.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__n", F.col(value).alias("v")))), lambda x: x["v"]).alias("values"))


def most_common(df: DataFrame, group: str, value: str, pos: str) -> DataFrame:
    """The most frequent value of each group; of several, the one that came first."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("__n"), F.min(pos).alias("__first"))
    return counts.groupBy(group).agg(F.max_by(value, F.struct("__n", -F.col("__first"))).alias("mode"), F.max("__n").alias("n"))


def zero_filled(dim: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Rows by key, keys of ``dim`` without rows too."""
    return dim.select(key).distinct().join(df.groupBy(key).agg(F.count("*").alias("n")), key, "left").na.fill(0, ["n"])
