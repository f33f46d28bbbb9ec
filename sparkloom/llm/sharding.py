"""Sharding by rendezvous hashing: every record ranks all shards by a hash of (key, shard) and takes the best one.

The key and the set of shards decide alone. A new shard takes only the records that now rank it first, so nothing moves
between old shards; a shard of weight w holds about w / sum(weights) of the records.

Edge cases: a null key hashes as the empty text; a null text has no bytes; equal keys share a shard, and rows that repeat get
slots of their own; an empty table gives an empty result. Columns besides key and text aren't read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import with_slots

#: Bytes that count for each record besides its text.
OVERHEAD = 16


def shard_scores(key: Column, weights: Sequence[float]) -> Column:
    """array<struct<score, shard>>: -ln(u) / weight, u uniform from 52 bits of md5("key:shard"); the least wins."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    each = F.array(*[F.struct(F.lit(float(w)).alias("w"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0])
    bits = lambda s: F.conv(F.substring(F.md5(F.concat(text, F.lit(":"), s["shard"].cast("string"))), 1, 13), 16, 10).cast("double")
    return F.transform(each, lambda s: F.struct((-F.log((bits(s) + 0.5) / float(1 << 52)) / s["w"]).alias("score"), s["shard"].alias("shard")))


def assign(df: DataFrame, weights: Sequence[float], id_col="doc_id", out="shard") -> DataFrame:
    """``df`` with the shard of each record. ``weights``: one per shard; shards of weight 0 get nothing."""
    return df.withColumn(out, F.array_min(shard_scores(F.col(id_col), weights))["shard"])


def shard_table(docs: DataFrame, weights: Sequence[float], grown: float | None = 1.0, id_col="doc_id", text_col="text", salts: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; ``grown``: weight of one more shard (None: no column value).

    Slots are dealt by (shard, salt), so that neither a large shard nor repeated keys make one long task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"))
    more = [*weights, grown] if grown else list(weights)
    rows = rows.withColumn("__scores", shard_scores(F.col("doc_id"), more))
    shard = lambda n: F.array_min(F.slice("__scores", 1, n))["shard"]
    n, total = sum(w > 0 for w in weights), sum(w > 0 for w in more)
    rows = rows.withColumn("shard", shard(n)).withColumn("grown_shard", shard(total) if grown else F.lit(None).cast("int")).drop("__scores")
    rows = with_slots(rows, "shard", ["doc_id", "text_crc32"], "slot", salts)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
