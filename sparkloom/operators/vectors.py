"""Vector retrieval for many queries at once, exact by block products (``cells`` has the approximate one)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkloom.operators.lexical import best, terms

SCORES = 1 << 19  # of rows with queries that a task holds at once


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, guard: float = 1e-10) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + guard)


def collection_info(df: DataFrame, vector: str) -> DataFrame:
    """count, dimension, whether all have it."""
    n = F.size(vector)
    return df.agg(F.count("*").alias("count"), F.max(n).cast("long").alias("dimension"), (F.min(n) == F.max(n)).alias("uniform"))


def top_k(df: DataFrame, queries: DataFrame, key: str, vector: str, query_key: str, query_vector: str, k: int, block: int = 4096) -> DataFrame:
    """query_key, key, score, rank: the k rows of largest cosine for each query, exactly.

    Queries come in blocks of ``block``, each broadcast; a task multiplies some rows at a time by a block, so that it holds at most ``SCORES``
    scores besides the k best rows of each query so far; what is shuffled is k rows a query and task. Filter ``df`` before: a filter after top-k has another meaning.
    """
    kind, query_kind = (x.schema[c].dataType.simpleString() for x, c in ((df, key), (queries, query_key)))
    found = None
    rows = df.select(F.col(key).alias("__key"), F.col(vector).alias("__vector")).where("__vector is not null")
    for part in _blocks(queries.select(query_key, query_vector).where(F.col(query_vector).isNotNull()), block):
        ids, matrix = [r[0] for r in part], np.array([r[1] for r in part], np.float64)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-30)
        shared = df.sparkSession.sparkContext.broadcast((ids, matrix))

        hits = rows.mapInArrow(_nearest(shared, k, query_key, key, to_arrow_type(queries.schema[query_key].dataType)), f"{query_key} {query_kind}, {key} {kind}, score double")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = df.sparkSession.createDataFrame([], f"{query_key} {query_kind}, {key} {kind}, score double")
    return best(found, query_key, key, k)


def _nearest(shared, k: int, query_key: str, key: str, kind: pa.DataType | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        found, step = Nearest(len(ids), k), max(1, SCORES // max(1, len(ids)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = part.column("__vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                found.add(np.round(matrix @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).T, 6), part.column("__key"))
        found.reduce()
        if len(found.queries):
            yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q in found.queries.tolist()], kind), found.keys, pa.array(found.scores)], [query_key, key, "score"])

    return run


class Nearest:
    """The k best rows of each query so far, by score, then key (nulls first). Waiting rows are held until they are ``SCORES`` in number."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.queries, self.scores, self.keys = np.zeros(0, np.int64), np.zeros(0), None
        self.waiting: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

    def add(self, scores: np.ndarray, keys: pa.Array) -> None:
        """Scores of all queries (rows) with these keys (columns)."""
        least = self.least
        if scores.shape[1] > self.k and np.isneginf(least).any():
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        # NaN stays: it is above all other scores in Spark's order.
        q, row = np.nonzero(~(scores < least[:, None]))
        self.waiting.append((q, scores[q, row], keys.take(pa.array(row))))
        if sum(len(w[0]) for w in self.waiting) > SCORES:
            self.reduce()

    def reduce(self) -> None:
        if not self.waiting:
            return
        parts = [(self.queries, self.scores, self.keys)] * (self.keys is not None) + self.waiting
        q, score = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        keys, self.waiting = pa.concat_arrays([p[2] for p in parts]), []
        rank = pc.rank(keys, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort((rank, -np.where(np.isnan(score), np.inf, score), q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = order[place < self.k]
        last = place == self.k - 1
        self.least[q[last]] = np.nan_to_num(score[order[last]], nan=np.inf, posinf=np.inf, neginf=-np.inf)
        self.queries, self.scores, self.keys = q[place < self.k], score[kept], keys.take(pa.array(kept))


def _blocks(queries: DataFrame, size: int):
    block = []
    for row in queries.toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def hashed_vectors(docs: DataFrame, text: str, dimension: int = 64, out: str = "vector") -> DataFrame:
    """A deterministic stand-in for an embedding model: normalized counts of hashed terms."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array

    tf = HashingTF(numFeatures=dimension, inputCol="__terms", outputCol="__tf").transform(docs.withColumn("__terms", terms(F.coalesce(text, F.lit("")))))
    return Normalizer(inputCol="__tf", outputCol="__unit").transform(tf).withColumn(out, vector_to_array("__unit")).drop("__terms", "__tf", "__unit")
