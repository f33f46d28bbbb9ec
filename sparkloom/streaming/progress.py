"""What a stream did, batch by batch: metrics observed inside the query and told to a listener, without a sink of their own."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import StructType

from sparkloom.sources.staging import fresh_path


class Progress(StreamingQueryListener):
    """Collects the observed metrics of one query (by its run): a row for each batch and name."""

    def __init__(self) -> None:
        self.found: dict[str, dict[int, Row]] = {}
        self.run_id: str | None = None
        self._held: list = []
        self._ended: set[str] = set()
        self._change = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        with self._change:
            self._held.append((str(event.progress.runId), event.progress.batchId, dict(event.progress.observedMetrics)))

    def onQueryTerminated(self, event) -> None:
        with self._change:
            self._ended.add(str(event.runId))
            self._change.notify_all()

    def wait(self, run_id: str, seconds: float = 60) -> dict[str, dict[int, Row]]:
        """All metrics of a query that has ended: events come later than the query ends, in order, its end last."""
        with self._change:
            if not self._change.wait_for(lambda: run_id in self._ended, seconds):
                raise TimeoutError("the end of the query wasn't told")
            for run, batch, metrics in self._held:
                if run == run_id:
                    for name, row in metrics.items():
                        self.found.setdefault(name, {})[batch] = row
        return self.found


def observed(stream: DataFrame, name: str, *metrics: Column) -> DataFrame:
    """``stream`` with named aggregates of each batch (no distinct ones)."""
    return stream.observe(name, *metrics)


def run(stream: DataFrame, batch: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> dict[str, dict[int, Row]]:
    """Run a stream over what is there now; metrics by name and batch. Without ``batch`` rows are only counted on."""
    spark, listener = stream.sparkSession, Progress()
    spark.streams.addListener(listener)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", fresh_path(spark, "stream")).trigger(availableNow=True)
        query = (writer.foreachBatch(batch) if batch else writer.format("noop")).start()
        query.awaitTermination()
        return listener.wait(str(query.runId))
    finally:
        spark.streams.removeListener(listener)


def table(spark: SparkSession, found: dict[int, Row], schema: str) -> DataFrame:
    """batch and metrics, a row for each batch; batches without rows have none."""
    rows = [(batch, *row) for batch, row in sorted(found.items())]
    return spark.createDataFrame(rows, StructType.fromDDL(f"batch long, {schema}"))
