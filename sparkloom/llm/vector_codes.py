"""Operator 11: vectors as codes of their parts, by k-means in exact integer arithmetic.

Components are integers floor(scale * x). A part's dot products with its codebook are float64 matrix products over limbs: integers
are broken into as many limbs as they need, so small that every sum of products stays below 2^53; the products are put together
again in int64. Rows so large that a distance could reach 2^63 are worked out in Python's integers instead, with the same result.

Each round is one job: tasks assign their rows and add them up by entry, Spark adds the tasks' sums, and the driver sees the sums of
``parts * entries`` entries only, whatever the number of rows.

Odd input: rows whose vector is null or holds null or non-finite components go; an empty vector is kept (all zeros). Vectors of
different lengths are filled up with zeros to the longest one, and that to a multiple of ``parts``: this changes no distance. Null ids
come last in the order of ids; rows of one id stand in the order of their bytes; with fewer rows than entries there are fewer entries.
A distance that no long holds gives a null error, and so do the sums it is part of. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import staged

LONG = 1 << 63
#: A label with more than this share of all rows is hot: fewer than 1 / share labels can be.
HOT = 1e-3
_LIMB = 32  # bits of the limbs that sums travel in

# Arithmetic in tasks


def _limbs(x: np.ndarray, bits: int, count: int) -> list[np.ndarray]:
    """``count`` limbs of int64 values, the lowest first, as float64: all are in [0, 2^bits) but the last, which has the sign."""
    return [(x >> (bits * i) & (1 << bits) - 1 if i < count - 1 else x >> (bits * i)).astype(np.float64) for i in range(count)]


def dots(x: np.ndarray, c: np.ndarray, bits: int | None = None) -> np.ndarray:
    """x @ c.T of int64 matrices, exact where results fit in int64 (else modulo 2^64), by products of float64 limbs."""
    if not x.size or not c.size:
        return np.zeros((len(x), len(c)), np.int64)
    bits = bits or (53 - max(1, x.shape[1]).bit_length()) // 2
    most = max(int(np.abs(x).max()), int(np.abs(c).max())).bit_length()
    count = max(1, math.ceil(most / bits))
    # One product over stacked limbs; every entry is a sum of x.shape[1] products below 2^(2 * bits), so it stays below 2^53.
    found = np.vstack(_limbs(x, bits, count)) @ np.vstack(_limbs(c, bits, count)).T
    found = found.reshape(count, len(x), count, len(c)).astype(np.int64)
    out = np.zeros((len(x), len(c)), np.int64)
    for i in range(count):
        for j in range(count):
            if bits * (i + j) < 64:
                out += found[i, :, j] << (bits * (i + j))
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the first of the nearest rows of c, and the squared distance; int64, or Python's integers where they are needed."""
    if x.dtype == object or c.dtype == object:
        d = ((x[:, None, :].astype(object) - c[None, :, :].astype(object)) ** 2).sum(axis=2) if x.shape[1] else np.zeros((len(x), len(c)), object)
        at = np.array([min(range(len(r)), key=r.__getitem__) for r in d], np.int64)
    else:
        d = (x * x).sum(axis=1)[:, None] - 2 * dots(x, c) + (c * c).sum(axis=1)[None, :]
        at = d.argmin(axis=1)  # the first one
    return at, d[np.arange(len(x)), at]


def _fits(width: int, *matrices: np.ndarray) -> bool:
    """Whether all distances between rows of these int64 matrices stay below 2^63."""
    most = max((int(np.abs(m).max()) for m in matrices if m.size), default=0)
    return width * (2 * most) ** 2 < LONG


def _padded(flat: np.ndarray, lengths: np.ndarray, dim: int) -> np.ndarray:
    if (lengths == dim).all():
        return flat.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim), flat.dtype)
    out[np.arange(dim) < lengths[:, None]] = flat
    return out


def _blocks(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrices of a staged batch: narrow rows as int64, wide ones as Python's integers."""
    narrow = batch.column("ints").is_valid().to_numpy(zero_copy_only=False)
    if narrow.any():
        kept = batch.column("ints").filter(pa.array(narrow))
        flat = np.frombuffer(b"".join(kept.to_pylist()), "<i4").astype(np.int64)
        yield np.flatnonzero(narrow), _padded(flat, batch.column("size").to_numpy()[narrow], dim)
    if not narrow.all():
        wide = [[int(v) for v in t.split(",")] for t in batch.column("wide").filter(pa.array(~narrow)).to_pylist()]
        yield np.flatnonzero(~narrow), np.array([r + [0] * (dim - len(r)) for r in wide], object).reshape(len(wide), dim)


def _assigned(x: np.ndarray, books: list[np.ndarray], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each part: its components, the entry of each row and the distance."""
    for p, c in enumerate(books):
        part = x[:, p * width : (p + 1) * width]
        if part.dtype != object and (c.dtype == object or not _fits(width, part, c)):
            part = part.astype(object)
        yield (part, *nearest(part, c))


def _sums_of(books: list[np.ndarray], width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per task: for each entry the number of rows (position -1) and the sums of their components, as limbs of 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(c), width + 1), object) for c in books]
        for batch in batches:
            for _, x in _blocks(batch, width * len(books)):
                for p, (part, at, _) in enumerate(_assigned(x, books, width)):
                    for entry in np.unique(at):
                        mine = part[at == entry]
                        sums[p][entry, 0] += len(mine)
                        sums[p][entry, 1:] += np.array([int(v) for v in mine.sum(axis=0)], object)
        rows = []
        for p, table in enumerate(sums):
            for (entry, at), v in np.ndenumerate(table):
                place = 0
                while v:
                    low = v if -(1 << _LIMB - 1) <= v < 1 << _LIMB - 1 else v & (1 << _LIMB) - 1
                    rows.append((p, entry, at - 1, place, int(low)))
                    v, place = (v - low) >> _LIMB, place + 1
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "entry", "at", "place", "v"), r, strict=True)) for r in rows], _SUMS)

    return run


_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("at", pa.int32()), ("place", pa.int32()), ("v", pa.int64())])


def _coded(books: list[np.ndarray], width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = np.zeros((batch.num_rows, len(books)), np.uint8), np.zeros(batch.num_rows, object)
            for rows, x in _blocks(batch, width * len(books)):
                for p, (_, at, d) in enumerate(_assigned(x, books, width)):
                    codes[rows, p] = at
                    errors[rows] += d.astype(object)
            texts = [bytes(r).hex() for r in codes]
            longs = [int(v) if v < LONG else None for v in errors]
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(texts, pa.string()), pa.array(longs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return run


def _floored(scale: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """floor(scale * x) of finite vectors: little-endian int32, or decimal text for rows with larger values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(over="ignore"):
                scaled = np.floor(flat * scale)
            ends = np.cumsum(sizes)
            ints, wide = [], []
            small = np.abs(scaled) < 1 << 31
            whole = np.where(small, scaled, 0).astype("<i4")
            for a, b in zip(ends - sizes, ends, strict=True):
                fits = small[a:b].all()
                ints.append(whole[a:b].tobytes() if fits else None)
                wide.append(None if fits else ",".join(str(_floor(v, scale)) for v in flat[a:b].tolist()))
            columns = [batch.column("vec_id"), batch.column("label"), pa.array(sizes), pa.array(ints, pa.binary()), pa.array(wide, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "size", "ints", "wide"])

    return run


def _floor(x: float, scale: int) -> int:
    top, bottom = x.as_integer_ratio()
    return top * scale // bottom


# Jobs


def _finite(v: Column) -> Column:
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _fit(kept: DataFrame, parts: int, entries: int, rounds: int) -> tuple[list[np.ndarray], int]:
    """Codebooks (a matrix for each part) and the width of a part; no rows give no codebooks."""
    longest = kept.agg(F.max("size")).first()[0]
    if longest is None:
        return [], 0
    width = -(-longest // parts)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "ints", "wide").limit(entries).select("size", "ints", "wide").collect()
    rows = [np.frombuffer(r["ints"], "<i4").tolist() if r["ints"] is not None else [int(v) for v in r["wide"].split(",")] for r in first]
    books = [_matrix([(r + [0] * (width * parts - len(r)))[p * width : (p + 1) * width] for r in rows], width) for p in range(parts)]
    for _ in range(rounds):
        found = kept.mapInArrow(_sums_of(books, width), "part int, entry int, at int, place int, v long")
        totals = {}
        for r in found.groupBy("part", "entry", "at", "place").agg(F.sum("v").alias("v")).collect():
            key = r["part"], r["entry"], r["at"]
            totals[key] = totals.get(key, 0) + (r["v"] << _LIMB * r["place"])
        for p, book in enumerate(books):
            rows = book.tolist()
            for entry in range(len(rows)):
                if n := totals.get((p, entry, -1)):
                    rows[entry] = [totals.get((p, entry, i), 0) // n for i in range(width)]
            books[p] = _matrix(rows, width)
    return books, width


def _matrix(rows: list[list[int]], width: int) -> np.ndarray:
    """int64 where all distances between such values fit, else Python's integers."""
    most = max((abs(v) for r in rows for v in r), default=0)
    return np.array(rows, np.int64 if width * (2 * most) ** 2 < LONG else object).reshape(len(rows), width)


def code_table(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256 of ``vectors`` (vec_id, embedding, label; other columns are ignored)."""
    if not 0 < entries <= 256:
        raise ValueError("an entry's number is two hex digits: 1 to 256 entries")
    ids, labels = vectors.schema["vec_id"].dataType.simpleString(), vectors.schema["label"].dataType.simpleString()
    kept = vectors.where(_finite(F.col("embedding"))).select("vec_id", "label", "embedding")
    kept = staged(kept.mapInArrow(_floored(scale), f"vec_id {ids}, label {labels}, size int, ints binary, wide string"), "vectors")
    books, width = _fit(kept, parts, entries, rounds)
    digest = hashlib.sha256(",".join(str(v) for c in books for v in c.ravel().tolist()).encode()).hexdigest()
    coded = kept.mapInArrow(_coded(books, width), f"vec_id {ids}, label {labels}, code string, error long")
    return with_sums(staged(coded, "codes")).withColumn("codebooks_sha256", F.lit(digest))


def with_sums(coded: DataFrame) -> DataFrame:
    """label_error: errors summed over the rows of a label, nulls together; null where one is null or no long holds the sum.

    Labels with over a thousandth of all rows, of which there are fewer than a thousand, are broadcast, so no task gets such a label
    whole; the others are joined by their key.
    """
    whole = F.when(F.count("error") == F.count(F.lit(1)), F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long"))
    sums = staged(coded.groupBy(F.col("label").alias("__label")).agg(whole.alias("label_error"), F.count(F.lit(1)).alias("__n")), "label_errors")
    total = coded.count()
    same = F.col("label").eqNullSafe(F.col("__label"))
    hot, cold = sums.where(F.col("__n") > total * HOT), sums.where(F.col("__n") <= total * HOT)
    of_hot = coded.join(F.broadcast(hot), same).select(*coded.columns, "label_error")
    rest = coded.join(F.broadcast(hot.select("__label")), same, "left_anti")
    return of_hot.unionByName(rest.join(cold, same).select(*coded.columns, "label_error"))
