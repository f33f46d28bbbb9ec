"""Incremental versions of ingest and monitoring with Structured Streaming.

Every function takes a streaming DataFrame; ``run_to_end`` runs one over what is there now. State and sinks live in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.buckets import Buckets
from sparkloom.sources.staging import fresh_path
from sparkloom.streaming import progress, runs
from sparkloom.streaming.runs import stuck_runs as stuck_runs  # also found here


def source(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A stream over the Parquet files of a table, ``files`` of them in a batch. The path is given as a pattern, so that it may also be a single file."""
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(pattern)


def run_to_end(stream: DataFrame, batch: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    where = fresh_path(stream.sparkSession, "stream")
    stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()


def final_table(stream: DataFrame) -> DataFrame:
    """The result of an aggregation in complete mode after the last batch."""
    spark, path = stream.sparkSession, fresh_path(stream.sparkSession, "complete")
    run_to_end(stream, lambda df, _: df.write.mode("overwrite").parquet(path), "complete")
    return spark.read.parquet(path)


def tumbling(stream: DataFrame, ts: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows by window; rows later than the watermark are dropped where windows are appended."""
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    counts = timed.groupBy(F.window("__ts", width)).agg(F.count("*").alias("n"))
    return counts.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "n")


def sliding_failures(stream: DataFrame, ts: str, failed: Column, width: str = "24 hours", step: str = "1 hour", late: str = "2 days") -> DataFrame:
    timed = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    found = timed.groupBy(F.window("__ts", width, step)).agg(F.count("*").alias("runs"), F.count_if(failed).alias("failed"))
    return found.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "runs", "failed", F.round(100.0 * F.col("failed") / F.col("runs"), 1).alias("rate"))


def _keep(df: DataFrame, path: str, number: int) -> None:
    """A batch in a folder of its own: one that is run again replaces what it wrote before."""
    df.write.mode("overwrite").parquet(f"{path}/batch={number}")


def ingest(stream: DataFrame, key: Column, known: DataFrame | None = None, ts: str | None = None, within: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is new, in this stream and against ``known`` (a table with column key), with the number of their batch; and batch, seen, added, skipped.

    Of equal keys the first batch counts, and in a batch any one row. Keys are remembered by the stream's state, so no batch reads what
    earlier ones wrote. With ``ts`` and ``within`` a key is remembered for so long by event time and rows later than that are skipped;
    without, for good. A batch that is run again changes nothing. Counts are observed in the query, not read from the table.
    """
    spark, path = stream.sparkSession, fresh_path(stream.sparkSession, "catalog")
    spark.conf.set(*runs.PROVIDER)
    rows = progress.observed(stream.withColumn("key", key), "seen", F.count(F.lit(1)).alias("n"))
    if ts:
        rows = rows.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", within).dropDuplicatesWithinWatermark(["key"]).drop("__ts")
    else:
        rows = rows.dropDuplicates(["key"])
    if known is not None:
        rows = rows.join(known.select("key"), "key", "left_anti")
    rows = progress.observed(rows, "added", F.count(F.lit(1)).alias("n"))
    found = progress.run(rows, lambda df, number: _keep(df, path, number))
    seen, added = ({b: r["n"] for b, r in found.get(name, {}).items()} for name in ("seen", "added"))
    counts = [(b, n, added.get(b, 0), n - added.get(b, 0)) for b, n in sorted(seen.items()) if n]
    return spark.read.parquet(path), spark.createDataFrame(counts, "batch long, seen long, added long, skipped long")


def appended(stream: DataFrame) -> DataFrame:
    """What an append-mode stream wrote, after the last batch."""
    spark, path = stream.sparkSession, fresh_path(stream.sparkSession, "appended")
    run_to_end(stream, lambda df, number: _keep(df, path, number))
    return spark.read.parquet(path).drop("batch")


def embed_new(stream: DataFrame, key: str, embed: Callable[[DataFrame], DataFrame], known: DataFrame, buckets: int = 64) -> DataFrame:
    """Vectors of rows that ``known`` doesn't have yet, upserted a batch at a time into a table of buckets, of which a batch writes those that it
    touches; of a key that comes again, the vector of its last batch (in one batch: of its greatest row)."""
    spark = stream.sparkSession
    store = Buckets(spark, fresh_path(spark, "vectors"), key, buckets)
    made = False

    def add(df: DataFrame, number: int) -> None:
        nonlocal made
        rest = [c for c in df.columns if c != key]
        last = df.groupBy(key).agg(F.max(F.struct(*rest)).alias("__row")).select(key, "__row.*")
        vectors = embed(last.join(known.select(key), key, "left_anti"))
        if made:
            store.upsert(vectors)
        else:
            store.create(vectors)
            made = True

    run_to_end(stream, add)
    return store.read()
