"""Tables that are changed by key without being rewritten: hashed into buckets, of which an update writes the touched ones only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.staging import staged

BUCKET = "__bucket"


@dataclass(frozen=True)
class Buckets:
    """A table at ``path`` whose rows lie in ``n`` folders by a hash of ``key``. One writer at a time.

    What an update leaves is written to the shared folder first and then takes the place of the touched folders, so the table isn't read
    while it is replaced, and an update that runs again gives the same table. Large buckets are split into files by Spark's rebalancing.
    """

    spark: SparkSession
    path: str
    key: str
    n: int = 64

    def _hashed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(BUCKET, F.pmod(F.xxhash64(self.key), F.lit(self.n)).cast("int"))

    def _put(self, df: DataFrame, mode: str) -> None:
        df.hint("rebalance", BUCKET).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)

    def create(self, df: DataFrame) -> Buckets:
        self._put(self._hashed(df), "errorifexists")
        return self

    def _rows(self) -> DataFrame:
        return self.spark.read.option("mergeSchema", "false").parquet(self.path)

    def read(self) -> DataFrame:
        return self._rows().drop(BUCKET)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, out of their buckets alone."""
        wanted = staged(self._hashed(keys.select(self.key).distinct()), "keys")
        return self._of(wanted).join(wanted.select(self.key), self.key, "left_semi").drop(BUCKET)

    def _of(self, keys: DataFrame) -> DataFrame:
        touched = [r[0] for r in keys.select(BUCKET).distinct().collect()]  # at most n
        return self._rows().where(F.col(BUCKET).isin(touched))

    def _change(self, keys: DataFrame, added: DataFrame | None) -> dict[str, int]:
        old = self._of(keys)
        gone = old.join(keys.select(self.key), self.key, "left_semi")
        left = old.join(keys.select(self.key), self.key, "left_anti")
        counts = {"replaced": gone.select(self.key).distinct().count(), "removed": gone.count()}
        left = staged(left if added is None else left.unionByName(added.select(*left.columns)), "buckets")
        self._put(left, "overwrite")
        filled = {r[0] for r in left.select(BUCKET).distinct().collect()}
        for b in {r[0] for r in keys.select(BUCKET).distinct().collect()} - filled:  # dynamic overwriting leaves what gets no rows
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={b}")
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        return counts

    def upsert(self, new: DataFrame) -> dict[str, int]:
        """All rows of the keys of ``new`` give way to its rows (several of a key too); how many keys are new and replaced, how many rows came and went."""
        new = staged(self._hashed(new), "new")
        keys = new.select(self.key, BUCKET).distinct()
        counts = self._change(keys, new)
        return {"added": keys.count() - counts["replaced"], "replaced": counts["replaced"], "rows": new.count(), "removed": counts["removed"]}

    def delete(self, keys: DataFrame) -> dict[str, int]:
        """Rows of these keys go; how many."""
        return {"removed": self._change(staged(self._hashed(keys.select(self.key).distinct()), "keys"), None)["removed"]}
