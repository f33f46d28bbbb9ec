"""A corpus pipeline of five stages: quality, toxicity, near-duplicates, decontamination, packing.

Each stage takes what its predecessor kept and returns the columns of documents; the last returns the packed pieces.

Executors and their Python workers live through all stages and keep the memory of the largest batch of texts that they had. So each
stage has its session cut batches by bytes (``BATCH_BYTES``, rows whole); the setting stays, as tables are worked out after a stage returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontamination, packing, quality, simhash, toxicity
from sparkloom.llm.common import staged
from sparkloom.llm.queries import tokenizer_path

#: Bytes of rows that go to a Python worker at once (Spark's own limit is 10,000 rows or 64 MB).
BATCH_BYTES = 2 << 20


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that the quality classifier scores under 0.3 go."""
    _small_batches(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the toxicity classifier scores 0.5 or more go."""
    _small_batches(spark)
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of each group of documents linked by fingerprints at 4 or fewer differing bits, the one of the least id stays.

    Fingerprints miss many links between alike shingle sets, so an exact check follows: documents whose 5-word shingles have a similarity of 0.8 or more link too.
    """
    _small_batches(spark)
    return simhash.keep_one(docs, radius=simhash.RADIUS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that hold a passage within the edit budget of a benchmark item go."""
    _small_batches(spark)
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: sequences of at most 2,048 tokens."""
    _small_batches(spark)
    return packing.packed_table(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", drop_poor), ("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontamination", drop_contaminated), ("packing", pack)]

#: Trained networks and a tokenizer: SQL can't express them; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
