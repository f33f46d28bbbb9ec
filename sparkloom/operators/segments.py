"""A stored inverted index for lexical retrieval: segments of documents, postings in blocks, top-k that skips blocks.

A segment is one row: some hundred documents as they come, their lengths, and for each of their terms the documents that hold it and how
often. Postings are cut into blocks of ``BLOCK`` neighbouring documents; a block keeps its largest frequency and its shortest length, so
the most that a term can add to a score there is known before its postings are looked at. A search takes the queries in broadcast
groups; a task goes through its segments, keeps the k best of each query so far, and passes over blocks whose bounds together stay below
the k-th. Building and searching are narrow: texts are tokenized once, nothing is shuffled but k rows a query and task.

Document frequencies and mean lengths come out of the segments. A row is a document; a null text is an empty one; a null or repeated key
stands as it is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from heapq import nsmallest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.lexical import TERMS, best, terms
from sparkloom.sources.staging import fresh_path

BLOCK = 64  # documents of a block of postings
ROW_GROUP = 2  # segments of a row group: readers decode one at a time, so a task holds few segments, however long a file is
_INTS = ("lengths", "chars", "dfs", "docs", "tfs", "parts", "blocks", "most", "least_length", "least_chars")

# Building


def _cuts(sizes: np.ndarray, rows: int, words: int) -> Iterator[tuple[int, int]]:
    """Runs of at most ``rows`` documents and ``words`` terms; a longer document alone."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        end = int(ends.searchsorted((ends[at - 1] if at else 0) + words, "right"))
        end = min(max(at + 1, end), at + rows)
        yield at, end
        at = end


def segment(found: pa.ListArray, chars: np.ndarray, block: int = BLOCK) -> dict[str, np.ndarray | pa.Array]:
    """The arrays of a segment out of the term lists of its documents (``dfs`` counts postings, ``parts`` blocks of each term)."""
    lengths = pc.fill_null(pc.list_value_length(found), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = found.flatten().dictionary_encode()
    words, n = coded.dictionary, len(lengths)
    pairs, tfs = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + np.repeat(np.arange(n), lengths), return_counts=True)
    of, docs = np.divmod(pairs, max(n, 1))
    starts = np.flatnonzero(np.append(True, np.diff(of * n + docs // block * block) != 0)[: len(of)])
    out = {"lengths": lengths, "chars": chars, "dfs": np.bincount(of, minlength=len(words)), "docs": docs, "tfs": tfs}
    out |= {"parts": np.bincount(of[starts], minlength=len(words)), "blocks": docs[starts] // block}
    if len(starts):
        out |= {"most": np.maximum.reduceat(tfs, starts), "least_length": np.minimum.reduceat(lengths[docs], starts), "least_chars": np.minimum.reduceat(chars[docs], starts)}
    else:
        out |= dict.fromkeys(("most", "least_length", "least_chars"), np.zeros(0, np.int64))
    return out | {"terms": words}


def _segmented(rows: int, words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column("terms")), 0).to_numpy(zero_copy_only=False)
            for a, b in _cuts(sizes, rows, words):
                part = batch.slice(a, b - a)
                out = segment(part.column("terms"), part.column("chars").to_numpy(zero_copy_only=False).astype(np.int64))
                lists = {c: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v if isinstance(v, pa.Array) else pa.array(v, pa.int32())) for c, v in out.items()}
                keys = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), part.column("key"))
                yield pa.RecordBatch.from_arrays([keys, lists["terms"], *(lists[c] for c in _INTS)], ["keys", "terms", *_INTS])

    return run


def build(docs: DataFrame, key: str, text: str = "text", pattern: str = TERMS, path: str | None = None, rows: int = 1024, words: int = 1 << 20) -> Index:
    """Write the index of ``docs`` to ``path`` (else to the shared folder): one job, each text tokenized once.

    A segment has some MB. Files get row groups of ``ROW_GROUP`` segments; Spark's reader would else decode all segments of a file at once.
    """
    path = path or fresh_path(docs.sparkSession, "segments")
    kind = docs.schema[key].dataType.simpleString()
    texts = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.col(key).alias("key"), terms(texts, pattern).alias("terms"), F.char_length(texts).alias("chars"))
    schema = f"keys array<{kind}>, terms array<string>, " + ", ".join(f"{c} array<int>" for c in _INTS)
    found.mapInArrow(_segmented(rows, words), schema).write.mode("overwrite").option("parquet.block.row.count.limit", ROW_GROUP).parquet(path)
    return read(docs.sparkSession, path, pattern)


def read(spark: SparkSession, path: str, pattern: str = TERMS) -> Index:
    return Index(spark.read.parquet(path), pattern)


# Searching


@dataclass
class Scorer:
    """The part of a score that a posting has, of its frequency and its document's length against the mean."""

    mean: float
    k1: float = 1.5
    b: float = 0.75

    def __call__(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.mean))


@dataclass
class Best:
    """The k best documents of each query so far, by rounded score, then key."""

    k: int
    digits: int = 6
    found: dict[int, list[tuple]] = field(default_factory=dict)

    def least(self, q: int) -> float:
        """Scores under this can't enter."""
        rows = self.found.get(q, ())
        return -rows[-1][0] - 10.0**-self.digits if len(rows) == self.k else -np.inf

    def add(self, q: int, scores: np.ndarray, keys: list) -> None:
        rows = [(-s, key is not None, key) for s, key in zip(np.round(scores, self.digits).tolist(), keys, strict=True)]
        self.found[q] = nsmallest(self.k, self.found.get(q, []) + rows)


def search_segment(row: dict, asked: list[dict[str, float]], scorer: Scorer, plain: bool, best_of: Best, block: int = BLOCK) -> tuple[int, int]:
    """Put the best documents of a segment into ``best_of``; the numbers of blocks that queries meet and of those they passed over."""
    number = {t: i for i, t in enumerate(row["terms"])}
    lengths, short = (row["chars"], row["least_chars"]) if plain else (row["lengths"], row["least_length"])
    starts, parts = (np.concatenate(([0], np.cumsum(row[c]))) for c in ("dfs", "parts"))
    top = scorer(row["most"], short)
    n, known, met, passed = len(lengths), {}, 0, 0
    blocks = -(-n // block)
    for q, weights in enumerate(asked):
        mine = [(number[t], w) for t, w in weights.items() if t in number]
        if not mine:
            continue
        bounds, held = np.zeros(blocks), np.zeros(blocks, bool)
        for t, w in mine:
            at = row["blocks"][parts[t] : parts[t + 1]]
            held[at] = True
            if w > 0:
                bounds[at] += w * top[parts[t] : parts[t + 1]]
        alive = held & (bounds >= best_of.least(q))
        met, passed = met + int(held.sum()), passed + int(held.sum() - alive.sum())
        if not alive.any():
            continue
        scores, touched = np.zeros(n), np.zeros(n, bool)
        for t, w in mine:
            if t not in known:
                docs = row["docs"][starts[t] : starts[t + 1]]
                known[t] = docs, scorer(row["tfs"][starts[t] : starts[t + 1]], lengths[docs])
            docs, part = known[t]
            scores[docs] += w * part
            touched[docs] = True
        touched &= np.repeat(alive, block)[:n] & (scores >= best_of.least(q))
        at = np.flatnonzero(touched)
        if len(at) > best_of.k:
            edge = np.partition(scores[at], len(at) - best_of.k)[len(at) - best_of.k]
            at = at[scores[at] >= edge - 10.0**-best_of.digits]
        if len(at):
            best_of.add(q, scores[at], [row["keys"][i] for i in at.tolist()])
    return met, passed


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in _INTS}
            yield row | {c: batch.column(c)[i].values.to_pylist() for c in ("keys", "terms")}


@dataclass
class Index:
    frame: DataFrame
    pattern: str = TERMS

    def frequencies(self) -> DataFrame:
        """term, df."""
        each = self.frame.select(F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("dfs").alias("df"))).alias("x"))
        return each.groupBy("x.term").agg(F.sum("x.df").alias("df"))

    def corpus(self) -> DataFrame:
        """n, avgdl, avgchars: one row."""
        total = lambda c: F.sum(F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)).cast("double")
        n = F.sum(F.size("keys"))
        return self.frame.agg(n.alias("n"), (total("lengths") / n).alias("avgdl"), (total("chars") / n).alias("avgchars"))

    def weights(self, n: int) -> DataFrame:
        """term, idf: ln(n - df + 0.5) - ln(df + 0.5); where negative, a quarter of the mean over all terms."""
        raw = self.frequencies().withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        mean = raw.agg((0.25 * F.avg("raw")).alias("low"))  # one row
        return raw.crossJoin(F.broadcast(mean)).select("term", F.when(F.col("raw") < 0, F.col("low")).otherwise(F.col("raw")).alias("idf"))

    def search(self, queries: DataFrame, query_key: str, key: str, k: int, text: str = "text", plain: bool = False, k1: float = 1.5, b: float = 0.75, block: int = 512) -> DataFrame:
        """query_key, key, score, rank: the k best documents of each query among those that share a term with it.

        BM25; ``plain`` is its simple form (no idf, lengths in characters, each term of a query once). Queries come in blocks of
        ``block``, each broadcast with the weights of its terms.
        """
        spark = self.frame.sparkSession
        kind, query_kind = self.frame.schema["keys"].dataType.elementType.simpleString(), queries.schema[query_key].dataType.simpleString()
        schema = f"{query_key} {query_kind}, {key} {kind}, score double"
        corpus = self.corpus().first()
        scorer = Scorer((corpus["avgchars"] if plain else corpus["avgdl"]) or 1.0, k1, b)
        asked = queries.select(F.col(query_key).alias("q"), terms(F.coalesce(F.col(text), F.lit("")), self.pattern).alias("terms")).where(F.size("terms") > 0)
        idf = None if plain else self.weights(corpus["n"]).join(asked.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi").persist()
        out = None
        for rows in _grouped(asked.toLocalIterator(), block):
            counts = [Counter(dict.fromkeys(r["terms"], 1)) if plain else Counter(r["terms"]) for r in rows]
            if plain:
                weights = [{t: 1.0 for t in c} for c in counts]
            else:
                wanted = spark.createDataFrame([(t,) for t in sorted(set().union(*counts))], "term string")
                known = dict(idf.join(F.broadcast(wanted), "term").collect())
                weights = [{t: m * known[t] for t, m in c.items() if t in known} for c in counts]
            shared = spark.sparkContext.broadcast(([r["q"] for r in rows], weights))
            found = self.frame.mapInArrow(_searched(shared, scorer, plain, k, query_key, key), schema)
            out = found if out is None else out.unionByName(found)
        if idf is not None:
            idf.unpersist()
        return best(out if out is not None else spark.createDataFrame([], schema), query_key, key, k)


def _searched(shared, scorer: Scorer, plain: bool, k: int, query_key: str, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, weights = shared.value
        found, kind = Best(k), None
        for batch in batches:
            kind = batch.schema.field("keys").type.value_type
            for row in _rows([batch]):
                search_segment(row, weights, scorer, plain, found)
        if found.found:
            rows = [(ids[q], r[2], -r[0]) for q, of in found.found.items() for r in of]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.float64())], [query_key, key, "score"])

    return run


def _grouped(rows: Iterator, size: int) -> Iterator[list]:
    group = []
    for row in rows:
        group.append(row)
        if len(group) == size:
            yield group
            group = []
    if group:
        yield group
