"""Approximate vector search: cells, product-quantised codes, exact rescoring of a few rows.

Rows are dealt to the cells of k-means centres, about the square root of their number; cells that hold much more than their share are
split again by centres of their own, so a cell's size follows the data's and not its hot spots. What is left of a unit vector after its
centre is cut into parts, and each part is kept as the number of the nearest of at most 256 entries. A query compares codes by tables of
its products with all entries, in the cells nearest to it; the best ``rescored`` rows of a query are then scored by their vectors.

Centres and entries are fitted on the driver on a sample of at most ``sample`` rows (split cells: at most ``sample`` in all); every row is
indexed. How many cells a query looks into is measured on that sample too: enough for ``target`` of the true neighbours there, whose
distances are larger than in the whole table. On data without clusters that is most of the cells, and the codes alone make it cheap.

Null vectors aren't indexed; zero vectors are like nothing (score 0). Repeated keys stand as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.lexical import best
from sparkloom.operators.vectors import SCORES, top_k
from sparkloom.sources.staging import staged

MOST_CELLS = 4096
MOST_ENTRIES = 256


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def lloyd(x: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    """k-means centres of a sample (rows of x); fewer where x has fewer rows."""
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.permutation(len(x))[:k])].copy()
    for _ in range(rounds):
        at = nearest(x, centres)
        sizes = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        centres[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the nearest centre of each row; some rows at a time, so that ``SCORES`` distances are held."""
    step, norms = max(1, SCORES // len(centres)), (centres**2).sum(1)[None]
    return np.concatenate([(norms - 2 * x[at : at + step] @ centres.T).argmin(1) for at in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit(flat.reshape(len(column), -1)) if len(column) else np.zeros((0, 0))


@dataclass
class Books:
    """What is fitted: centres of the cells, entries of each part."""

    centres: np.ndarray
    entries: list[np.ndarray]

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.entries), axis=1)

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and its code."""
        cell = nearest(x, self.centres)
        return cell, np.stack([nearest(p, e) for p, e in zip(self.split(x - self.centres[cell]), self.entries, strict=True)], axis=1).astype(np.uint8)

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of queries with centres (query, cell), and with entries (query, part, entry)."""
        width = max(map(len, self.entries))
        out = np.zeros((len(q), len(self.entries), width), np.float32)
        for i, (p, e) in enumerate(zip(self.split(q), self.entries, strict=True)):
            out[:, i, : len(e)] = p @ e.T
        return (q @ self.centres.T).astype(np.float32), out


class CellIndex:
    def __init__(self, df: DataFrame, key: str, vector: str, cells: int | None = None, parts: int = 32, heavy: float = 4.0, sample: int = 20_000, target: float = 0.98, seed: int = 42):
        self.key, self.vector = key, vector
        self.rows = df.select(F.col(key), F.col(vector).alias("__vector")).where("__vector is not null")
        self.count = self.rows.count()
        drawn = self._drawn(self.rows, sample)
        self.books = None
        if not len(drawn):
            return
        centres = lloyd(drawn, cells or min(MOST_CELLS, int(np.ceil(np.sqrt(self.count)))), seed)
        centres = self._split_again(centres, heavy, sample, seed)
        rest = drawn - centres[nearest(drawn, centres)]
        parts = min(parts, drawn.shape[1])
        self.books = Books(centres, [lloyd(p, MOST_ENTRIES, seed + i, 8) for i, p in enumerate(np.array_split(rest, parts, axis=1))])
        self.probe = _probes(drawn, centres, target)
        kind = df.schema[key].dataType.simpleString()
        self.codes = staged(self.rows.mapInArrow(_coder(self.books, key), f"{key} {kind}, cell int, code binary"), "codes")

    @staticmethod
    def _drawn(rows: DataFrame, n: int) -> np.ndarray:
        """At most n rows, in the order of a hash of the vector."""
        found = rows.orderBy(F.xxhash64("__vector")).limit(n).select("__vector").collect()
        return unit(np.array([r[0] for r in found], np.float64)) if found else np.zeros((0, 0))

    def _split_again(self, centres: np.ndarray, heavy: float, sample: int, seed: int) -> np.ndarray:
        """Cells of over ``heavy`` times the mean size get centres of their own, as many as means fit into them."""
        sizes = {r["cell"]: r["n"] for r in self._celled(centres).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        mean = self.count / len(centres)
        large = {c: n for c, n in sizes.items() if n > heavy * mean}
        if not large:
            return centres
        kept = [c for i, c in enumerate(centres) if i not in large]
        per_cell = max(1, sample // len(large))
        # A share of each large cell by a hash, about per_cell rows; its rows over that share stay where they are.
        share = F.when(F.lit(False), 0.0)
        for c, n in large.items():
            share = share.when(F.col("cell") == c, min(1.0, per_cell / n))
        drawn = self._celled(centres, keep=True).where(F.pmod(F.xxhash64("__vector"), F.lit(1 << 20)) < share * (1 << 20)).select("cell", "__vector").collect()
        for c, n in large.items():
            mine = [r["__vector"] for r in drawn if r["cell"] == c]
            kept += list(lloyd(unit(np.array(mine, np.float64)), int(np.ceil(n / mean)), seed)) if mine else [centres[c]]
        return np.array(kept)

    def _celled(self, centres: np.ndarray, keep: bool = False) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    cell = pa.array(nearest(_matrix(b.column(0)), centres).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([cell, b.column(0)] if keep else [cell], ["cell", "__vector"][: 1 + keep])

        kind = self.rows.schema["__vector"].dataType.simpleString()
        return self.rows.select("__vector").mapInArrow(run, f"cell int, __vector {kind}" if keep else "cell int")

    def search(self, queries: DataFrame, query_key: str, query_vector: str, k: int, rescored: int | None = None, probe: int | None = None, block: int = 256) -> DataFrame:
        """query_key, key, score, rank of the k best rows by cosine among the ``rescored`` (4 k) best by their codes."""
        near = self.candidates(queries, query_key, query_vector, rescored or 4 * k, probe, block)
        asked = queries.select(query_key, F.col(query_vector).alias("__asked"))
        rows = near.join(self.rows, self.key).join(asked, query_key)
        scored = rows.select(query_key, self.key, _cosine("__asked", "__vector").alias("score"))
        return best(scored, query_key, self.key, k)

    def candidates(self, queries: DataFrame, query_key: str, query_vector: str, n: int, probe: int | None = None, block: int = 256) -> DataFrame:
        """query_key, key: the n best rows of each query by their codes. Queries come in blocks, each broadcast with its tables."""
        schema = f"{query_key} {queries.schema[query_key].dataType.simpleString()}, {self.key} {self.rows.schema[self.key].dataType.simpleString()}, score double"
        spark, out = self.rows.sparkSession, None
        if self.books is not None:
            for ids, q in _blocks(queries.select(query_key, query_vector).where(F.col(query_vector).isNotNull()), block):
                by_cell, by_entry = self.books.tables(q)
                probed = np.zeros(by_cell.shape, bool)
                np.put_along_axis(probed, np.argsort(-by_cell, axis=1, kind="stable")[:, : probe or self.probe], True, axis=1)
                shared = spark.sparkContext.broadcast((ids, by_cell, by_entry, probed))
                cells = np.flatnonzero(probed.any(0))
                mine = self.codes.where(F.col("cell").isin(cells.tolist())) if len(cells) < min(1000, probed.shape[1]) else self.codes
                found = mine.mapInArrow(_compared(shared, n, query_key, self.key), schema)
                out = found if out is None else out.unionByName(found)
        return best(out if out is not None else spark.createDataFrame([], schema), query_key, self.key, n).select(query_key, self.key)

    def report(self, queries: DataFrame, query_key: str, query_vector: str, k: int, rescored: int | None = None) -> DataFrame:
        """One row: true neighbours, the share found, the share of rows whose vectors a query reads, and whose codes it compares, cells and those probed."""
        exact = top_k(self.rows, queries, self.key, "__vector", query_key, query_vector, k)
        found = self.search(queries, query_key, query_vector, k, rescored)
        hit = exact.select(query_key, self.key).join(found.select(query_key, self.key, F.lit(1).alias("__hit")), [query_key, self.key], "left")
        measured = hit.agg(F.count(F.lit(1)).alias("exact"), F.round(F.avg(F.coalesce("__hit", F.lit(0))), 4).alias("recall"))
        read = self.candidates(queries, query_key, query_vector, rescored or 4 * k).groupBy(query_key).agg(F.count(F.lit(1)).alias("n")).agg(F.avg("n").alias("n"))
        share = read.select(F.round(F.col("n") / self.count, 4).alias("share_read"))
        cells = len(self.books.centres) if self.books else 0
        return measured.crossJoin(F.broadcast(share)).withColumns({"cells": F.lit(cells), "probed": F.lit(min(self.probe, cells) if cells else 0), "rows": F.lit(self.count)})


def _cosine(a: str, b: str):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def _probes(drawn: np.ndarray, centres: np.ndarray, target: float, k: int = 10, queries: int = 256) -> int:
    """How many cells, nearest first, hold ``target`` of the k nearest neighbours of some sampled rows."""
    q = drawn[:: max(1, len(drawn) // queries)]
    near = np.argsort(-(q @ drawn.T), axis=1, kind="stable")[:, 1 : k + 1]
    order = np.argsort(-(q @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :].repeat(len(q), 0), axis=1)
    found = np.sort(np.take_along_axis(place, nearest(drawn, centres)[near], axis=1).ravel())
    return int(found[min(len(found) - 1, int(np.ceil(target * len(found))))]) + 1 if len(found) else 1


def _coder(books: Books, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, code = books.coded(_matrix(b.column("__vector")))
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array(cell.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], [key, "cell", "code"])

    return run


def _compared(shared, n: int, query_key: str, key: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The n best rows of each query in a task, by sums of table entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, by_cell, by_entry, probed = shared.value
        kept_scores, kept_keys, kind = np.full((len(ids), 0), -np.inf, np.float32), np.zeros((len(ids), 0), object), None
        step = max(n, SCORES // max(1, len(ids)))
        for b in (batch.slice(at, step) for batch in batches for at in range(0, batch.num_rows, step)):
            kind = b.column(key).type
            cell = b.column("cell").to_numpy()
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1)
            score = by_cell[:, cell]
            for p in range(code.shape[1]):
                score = score + by_entry[:, p, code[:, p]]
            score[~probed[:, cell]] = -np.inf
            keys = np.empty(b.num_rows, object)
            keys[:] = b.column(key).to_pylist()
            kept_scores, every = np.hstack((kept_scores, score)), np.hstack((kept_keys, np.broadcast_to(keys, score.shape)))
            top = np.argsort(-kept_scores, axis=1, kind="stable")[:, :n]
            kept_scores, kept_keys = np.take_along_axis(kept_scores, top, 1), np.take_along_axis(every, top, 1)
        q, at = np.nonzero(np.isfinite(kept_scores))
        if len(q):
            columns = [pa.array([ids[i] for i in q.tolist()]), pa.array(kept_keys[q, at].tolist(), kind), pa.array(kept_scores[q, at].astype(np.float64))]
            yield pa.RecordBatch.from_arrays(columns, [query_key, key, "score"])

    return run


def _blocks(queries: DataFrame, size: int) -> Iterator[tuple[list, np.ndarray]]:
    block = []
    for row in queries.toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield [r[0] for r in block], unit(np.array([r[1] for r in block], np.float64))
            block = []
    if block:
        yield [r[0] for r in block], unit(np.array([r[1] for r in block], np.float64))
