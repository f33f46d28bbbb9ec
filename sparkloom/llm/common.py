"""What the operators share: staged tables, folds, gapless ranks and bounded samples of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.staging import staged as staged  # written once, read by all operators

FOLDS = 5


def held_out(key: Column) -> Column:
    """True for the fold that no label is learned from: crc32 of the key as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, row_bytes: int, id_col="doc_id", text_col="text"):
    """At most ``rows`` (text, label) pairs on the driver, half of them of either label where there are enough.

    Only training folds; keys are drawn in the order of a hash, whatever the partitions. The keys drawn, ``rows`` at most, are
    broadcast; texts over ``row_bytes`` bytes are then left out, and of several texts of a key the least is taken, so the sample has at most
    rows * row_bytes bytes. Only keys and the texts drawn are shuffled.
    """
    known = labels.select(F.col(id_col).alias("__key"), F.col(label).cast("int").alias("__label")).where("__label in (0, 1)").where(~held_out(F.col("__key")))
    known = known.join(docs.select(F.col(id_col).alias("__key")), "__key", "left_semi").groupBy("__key").agg(F.min("__label").alias("__label"))
    drawn = []
    for value in (0, 1):
        part = known.where(F.col("__label") == value).select("__key", "__label", F.xxhash64(F.col("__key").cast("string")).alias("__at")).orderBy("__at", "__key").limit(rows // 2)
        drawn += [tuple(r) for r in part.collect()]
    if not drawn:
        return []
    drawn = docs.sparkSession.createDataFrame(drawn, part.schema)
    texts = docs.select(F.col(id_col).alias("__key"), F.col(text_col).alias("__text")).where(F.col("__text").isNotNull() & (F.octet_length("__text") <= row_bytes))
    found = texts.join(F.broadcast(drawn), "__key").groupBy("__at", "__key", "__label").agg(F.min("__text").alias("__text")).collect()
    return [(r["__text"], r["__label"]) for r in sorted(found, key=lambda r: (r["__label"], r["__at"], r["__text"]))]


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have, whatever case is."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def by_bytes(batch: pa.RecordBatch, column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of the batch's rows with at most ``limit`` bytes in a text column, a longer row alone, so that a task holds few texts as objects."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy()
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(ends.searchsorted((ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs flat[starts[i] : starts[i] + lengths[i]] end to end."""
    ends = np.cumsum(lengths)
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(len(at))
    return flat[at]


def broadcast_if_small(keys: DataFrame, rows: int = 500_000) -> DataFrame:
    """A staged table of keys, to be broadcast if it has at most ``rows`` rows (tens of MB); else joined as Spark sees fit."""
    return F.broadcast(keys) if keys.limit(rows + 1).count() <= rows else keys


def sized(table: DataFrame, rows: int = 100_000) -> DataFrame:
    """A staged table as a side of a join: broadcast if it has at most ``rows`` rows, surely not if it has more.

    Spark goes by the bytes of files, in which repeated values take next to nothing, counts an array as one item, and takes explodes and Python
    steps to give as many rows as they get. Tables that it sizes too low fill the driver; where a side isn't staged, joins say ``hint("merge")``.
    """
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table.hint("merge")


def with_slots(df: DataFrame, group: str, order: list[str], out: str, salts: int = 64) -> DataFrame:
    """A gapless number from 0 within each value of ``group``, though no task reads more than a ``salts``-th of a group.

    Groups must be few (their number times ``salts`` is the size of what is broadcast). Rows of a group are numbered
    by salt, then by ``order``; rows that tie get different numbers. ``df`` is evaluated twice: stage what is costly.
    """
    salted = df.withColumn("__salt", salt_of(order[0], salts))
    sizes = salted.groupBy(group, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(group).alias("__g"), F.col("__salt").alias("__s"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    rank = F.row_number().over(Window.partitionBy(group, "__salt").orderBy(*order)) - 1
    ranked = salted.withColumn("__rank", rank)
    joined = ranked.join(F.broadcast(starts), (ranked[group] == starts["__g"]) & (ranked["__salt"] == starts["__s"]))
    return joined.withColumn(out, (F.col("__start") + F.col("__rank")).cast("long")).drop("__g", "__s", "__start", "__rank", "__salt")


def salt_of(key: str, salts: int) -> Column:
    """A salt that SQL elsewhere can compute too: the first 8 hex digits of the key's md5, modulo ``salts``."""
    return (F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % salts).cast("int")
