"""Best-fit packing of documents into sequences by matching large items.

1. Every document becomes pieces of at most ``capacity`` tokens (only longer documents are cut).
2. The plan sees only how many pieces there are of each length, at most ``capacity`` numbers. Large pieces, over a third of the
   capacity, go at most two to a sequence: from the longest down, each is matched with the longest other that still fits.
   Small pieces, from the longest down, go where they leave the smallest gap; new sequences open when none has room. All
   is done for runs of like sequences at once, so the plan's size is bounded by the capacity, not by the corpus.
3. Each piece gets a number among the pieces of its length (no task counts all of them, see ``with_slots``) and looks
   up its place in the plan.

Edge cases: a null or empty text is a document of the end id alone; rows that repeat are packed once each; equal lengths are
dealt by a hash of the id; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import words
from sparkloom.llm.common import by_bytes, staged, with_slots

CAPACITY, END_ID = 2048, 0


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut where longer than ``capacity``.

    ``tokenizer``: path of the word-end BPE file, the same on every executor.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = rows.schema["doc_id"].dataType.simpleString()
    width, end = 4 * capacity, int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = words.loaded(tokenizer)
        for batch in batches:
            for part in by_bytes(batch, 1, words.GROUP):
                own, piece, length, crc = [], [], [], []
                for i, ids in enumerate(encoder.batch(part.column(1).to_pylist())):
                    ids = ids.astype("<u4").tobytes() + end
                    for k in range(0, len(ids), width):
                        x = ids[k : k + width]
                        own.append(i)
                        piece.append(k // width)
                        length.append(len(x) // 4)
                        crc.append(crc32(x))
                p = np.array(piece, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(own, pa.int64())), pa.array(p.astype(np.int32)), pa.array(p * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return rows.mapInArrow(cut, f"doc_id {key}, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Runs of like sequences, (number of sequences, [(length, pieces of it), ...]), that hold ``counts`` pieces of each length."""
    left = {n: k for n, k in counts.items() if k > 0}
    third = capacity / 3
    gaps: dict[int, list[tuple[int, list]]] = {}
    free: list[int] = []  # the gaps that there are, sorted

    def put(gap: int, n: int, holds: list) -> None:
        if n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(free, gap)
            gaps[gap].append((n, holds))

    large = sorted(n for n in left if n > third)
    while large:
        a = large.pop()
        while left[a]:
            k = bisect.bisect_right(large, capacity - a) - 1
            b = a if 2 * a <= capacity and left[a] > 1 else large[k] if k >= 0 else None  # the longest that fits
            if b is None:
                put(capacity - a, left[a], [(a, 1)])
                left[a] = 0
            elif b == a:
                put(capacity - 2 * a, left[a] // 2, [(a, 2)])
                left[a] %= 2
            else:
                n = min(left[a], left[b])
                put(capacity - a - b, n, [(a, 1), (b, 1)])
                left[a] -= n
                left[b] -= n
                if not left[b]:
                    large.pop(k)
    for s in sorted((n for n in left if n <= third), reverse=True):
        while left[s]:
            k = bisect.bisect_left(free, s)
            if k == len(free):  # no room anywhere: open what is needed
                each = capacity // s
                n, rest = divmod(left[s], each)
                put(capacity - each * s, n, [(s, each)])
                put(capacity - rest * s, 1 if rest else 0, [(s, rest)])
                left[s] = 0
                break
            gap = free[k]
            n, holds = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], free[k]
            each = gap // s  # the tightest gap takes as many as it can
            full, rest = divmod(left[s], each)
            if full >= n:
                full, rest = n, 0
            put(gap - each * s, full, [*holds, (s, each)])
            if rest:
                put(gap - rest * s, 1, [*holds, (s, rest)])
            put(gap, n - full - bool(rest), holds)
            left[s] -= full * each + rest
    return [x for runs in gaps.values() for x in runs]


def lookup(runs: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """By length: rows of (first number, first sequence, pieces in each sequence, offset of the first)."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    first = 0
    for n, holds in sorted(runs, key=lambda r: (r[1], r[0])):
        offset = 0
        for length, each in holds:
            rows.setdefault(length, []).append((used.get(length, 0), first, each, offset))
            used[length] = used.get(length, 0) + n * each
            offset += length * each
        first += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(cut: DataFrame, capacity: int = CAPACITY, salts: int = 64) -> DataFrame:
    """``cut`` (as from ``pieces``; evaluated several times) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = lookup(plan(counts, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        length, number = length.to_numpy(), number.to_numpy()
        out = np.zeros((2, len(length)), np.int64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            start, first, each, offset = places[n][np.searchsorted(places[n][:, 0], number[at], "right") - 1].T
            out[0, at] = first + (number[at] - start) // each
            out[1, at] = offset + (number[at] - start) % each * n
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    numbered = with_slots(cut, "length", ["doc_id", "piece", "ids_crc32"], "__number", salts)
    return numbered.withColumn("__place", place("length", "__number")).select(*cut.columns, "__place.sequence_id", "__place.offset")


def packed_table(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return pack(staged(pieces(docs, tokenizer, capacity, id_col=id_col, text_col=text_col), "pieces"), capacity)
