"""Table functions for SQL: ``SELECT ... FROM docs, LATERAL chunk_text(text, 200)`` once registered."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from sparkloom.operators.chunking import chunk_text


@udtf(returnType="chunk_index: int, kind: string, content: string, tokens: int")
class ChunkText:
    def eval(self, text: str, size: int):
        for i, (kind, content, n) in enumerate(chunk_text(text or "", "recursive", size)):
            yield i, kind, content, n


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk_text", ChunkText)
