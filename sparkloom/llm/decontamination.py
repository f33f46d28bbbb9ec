"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as normalized text: lower case, every run of characters that are neither letters nor digits one space.
A test item of n characters may differ from a passage by ``budget(n)`` edits (an insertion, deletion or change of one character).
It is cut into budget + 1 pieces of equal length; whatever the edits, one piece stays whole, so every passage within the budget shows
an exact hit of some piece at about its place. Items of under ``EXACT_UNDER`` characters are one piece: they have to be there as they are, as whole words. All pieces are looked up in one pass over a document (Aho-Corasick); around each hit
Myers' bit-parallel algorithm finds the least distance between the item and any part of the document, exactly.

The benchmark is read in blocks of at most ``block_bytes`` of text, and each block meets all documents, so none is cut. A task holds one block
at a time; the blocks themselves stay broadcast until the job ends, that is the benchmark's text once on each executor, on disk where memory is short. Items are first reduced to distinct texts.

Edge cases: null or empty items and those without ``min_chars`` (12) normalized characters, which say too little, aren't searched for; null texts have no hits;
rows that repeat are reported each; no documents or no items give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE, MIN_CHARS, MIN_PIECE, EXACT_UNDER = 0.1, 12, 12, 40

_GAP = re.compile(r"[\W_]+")


def normalized(text: str | None) -> str:
    return _GAP.sub(" ", (text or "").lower()).strip()


def budget(n: int, share: float = SHARE) -> int:
    """Edits allowed for n characters: a share of them, and so few that no piece is shorter than MIN_PIECE; none under EXACT_UNDER."""
    return 0 if n < EXACT_UNDER else max(0, min(int(n * share), n // MIN_PIECE - 1))


#: Scripts written without spaces (Thai to Khmer, and from the CJK radicals on, but for Hangul).
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\uabff\ud7b0-\ud7ff\uf900-\ufaff\U00020000-\U0003ffff]")


def whole_words(text: str, start: int, end: int) -> bool:
    """Whether a part of the normalized text begins and ends with a word; where a script has no spaces, any place will do."""
    edge = lambda out, at: not 0 <= out < len(text) or text[out] == " " or bool(_UNSPACED.match(text[at]))
    return edge(start - 1, start) and edge(end, end - 1)


def cut(item: str, edits: int) -> list[tuple[int, str]]:
    """(place, piece) of edits + 1 pieces whose lengths differ by one at most."""
    n, k = len(item), edits + 1
    ends = [n * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def myers(pattern_bits: dict[str, int], m: int, text: str, limit: int) -> tuple[int, int] | None:
    """The least edit distance between the pattern and any part of ``text``, and where that part ends; None if over ``limit``."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = limit + 1, -1
    for j, c in enumerate(text):
        eq = pattern_bits.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return (best, end) if end >= 0 else None


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[str, str]], share: float):
        import ahocorasick

        self.items, self.automaton = [], ahocorasick.Automaton()
        self.share = share
        at: dict[str, list[tuple[int, int]]] = {}
        for number, text in items:
            bits: dict[str, int] = {}
            for i, c in enumerate(text):
                bits[c] = bits.get(c, 0) | 1 << i
            edits = budget(len(text), share)
            for place, piece in cut(text, edits):
                at.setdefault(piece, []).append((len(self.items), place))
            self.items.append((number, text, bits, edits))
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str, first: bool = False) -> list[tuple[str, int, int, int, int]]:
        """(item, distance, edits allowed, characters, end) of each item that some part of the normalized text matches: its nearest part.

        ``first``: of one such item, whichever is found first.
        """
        spans: dict[int, list[tuple[int, int]]] = {}
        exact: dict[int, int] = {}
        for end, (n, where) in self.automaton.iter(text):
            for i, place in where:
                m, edits = len(self.items[i][1]), self.items[i][3]
                if m < EXACT_UNDER:
                    if i not in exact and whole_words(text, end + 1 - n, end + 1):
                        exact[i] = end + 1
                    continue
                start = end + 1 - n - place
                spans.setdefault(i, []).append((max(0, start - edits), min(len(text), start + m + edits)))
        out = [(self.items[i][0], 0, 0, len(self.items[i][1]), end) for i, end in exact.items()]
        if out and first:
            return out[:1]
        for i, found in spans.items():
            number, item, bits, edits = self.items[i]
            best = None
            found.sort()
            a, b = found[0]
            for x, y in [*found[1:], (len(text) + 1, 0)]:
                if x <= b:
                    b = max(b, y)
                    continue
                hit = myers(bits, len(item), text[a:b], edits if best is None else best[0] - 1)
                if hit:
                    best = (hit[0], a + hit[1])
                    if not hit[0]:
                        break
                a, b = x, y
            if best:
                out.append((number, best[0], edits, len(item), best[1]))
                if first:
                    return out
        return out


def _normalized(c: str):
    @F.pandas_udf("string")
    def norm(texts: pd.Series) -> pd.Series:
        return texts.map(normalized)

    return norm(c)


def _blocks(items: DataFrame, min_chars: int, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """(key, text) of the distinct items, in blocks that end once they hold ``block_bytes``."""
    block, size = [], 0
    for row in items.where(F.char_length("__norm") >= min_chars).select("__key", "__norm").distinct().orderBy("__key").toLocalIterator():
        block.append((row["__key"], row["__norm"]))
        size += len(row["__norm"].encode())
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item_id, __norm, __key: key is the md5 of the normalized text."""
    return benchmark.select(F.col(item_col).alias("item_id"), _normalized(text_col).alias("__norm")).withColumn("__key", F.md5("__norm"))


def matches(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, min_chars: int = MIN_CHARS, block_bytes: int = 1 << 22, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """doc_id, item_id, distance, allowed, n_chars, end_at: every document and item where some passage is within the budget.

    distance: of the nearest passage, in edits; allowed: the budget; n_chars: of the normalized item; end_at: where the passage ends in the normalized text.
    """
    spark = docs.sparkSession
    items = _items(benchmark, item_col, item_text_col)
    key = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    schema = f"doc_id {key}, __key string, distance int, allowed int, n_chars int, end_at long"
    found = spark.createDataFrame([], schema)
    for block in _blocks(items, min_chars, block_bytes):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, share)
            for batch in batches:
                rows = [(i, *hit) for i, text in enumerate(batch.column(1).to_pylist()) for hit in matcher.find(normalized(text))]
                own, keys, distance, allowed, chars, end = zip(*rows, strict=True) if rows else ((),) * 6
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(own, pa.int64())), pa.array(keys, pa.string()), *(pa.array(x, pa.int32()) for x in (distance, allowed, chars)), pa.array(end, pa.int64())],
                    ["doc_id", "__key", "distance", "allowed", "n_chars", "end_at"],
                )

        found = found.union(texts.mapInArrow(search, schema))
    return found.join(items.select("item_id", "__key"), "__key").select("doc_id", "item_id", "distance", "allowed", "n_chars", "end_at")


def keep_clean(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, min_chars: int = MIN_CHARS, block_bytes: int = 1 << 22, text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """``docs`` without the documents that hold a passage within the budget of any item; columns as they were."""
    for block in _blocks(_items(benchmark, item_col, item_text_col), min_chars, block_bytes):
        docs = docs.where(_clean(docs.sparkSession.sparkContext.broadcast(block), share)(text_col))
    return docs


def _clean(block, share: float):
    """A UDF: whether no passage of the text matches an item of the broadcast ``block``."""

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(block.value, share)
        for texts in batches:
            yield pd.Series([t is None or not matcher.find(normalized(t), first=True) for t in texts], dtype=bool)

    return clean
