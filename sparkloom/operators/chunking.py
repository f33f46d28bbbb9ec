"""Chunking of documents: one Arrow pass, a row for each chunk.

A chunk has its text, its place, its kind and a token estimate. Splitters pack greedily up to ``size`` tokens and carry over an overlap.
A sentence or part that is larger than ``size`` by itself is a chunk of its own, unless the splitter can cut it further.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

_HANGUL = re.compile("[가-힯ᄀ-ᇿ㄰-㆏]")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+")
# Fixed formats: a piped table (header, rule, rows), the tag of a table, a tagged list of ``- key: value`` and where it ends, its items.
_PIPED = re.compile(r"^[ \t]*\|[^\n]+\|[ \t]*\n[ \t]*\|[ \t:|-]+\|[ \t]*\n(?:[ \t]*\|[^\n]+\|[ \t]*(?:\n|\Z))+", re.M)
_TAG = re.compile(r"<!-- 표 (\d+) -->")
_LIST_TAG = re.compile(r"<!-- 표 (\d+) -->\[표 데이터\]")
_LIST_END = re.compile(r"<!-- 표 \d+ -->|\n\n(?![항목\[\-])|\n\n\n|\Z")
_ITEM = re.compile(r"(?=항목 \d+:|\n\[)")
_PAIR = re.compile(r"- ([^:：]+)[：:]\s*([^\n]+)")
_HEADER = re.compile(r"^(?:#{1,6}[ \t]+\S|[IVX]+\.[ \t]|§)", re.M)
_BLOCK = re.compile(r"\n[ \t]*\n|\n(?=[ \t]*(?:[-*•]|\d+[.)])[ \t])")


def tokens(text: str) -> int:
    script = len(_HANGUL.findall(text))
    units = len(text) + sum(c > "￿" for c in text)
    return math.ceil(script / 1.7 + (units - script) / 4)


def tail(text: str, size: int) -> str:
    """The last sentences, up to and with the one that reaches ``size`` tokens."""
    out: list[str] = []
    have = 0
    for s in reversed(_SENTENCE.split(text)):
        if have >= size:
            break
        have += tokens(s)
        out.insert(0, s)
    return " ".join(out)


def packed(parts: list[str], size: int, glue: str) -> list[str]:
    """Neighbours joined while they fit."""
    out: list[str] = []
    for p in parts:
        if not p.strip():
            continue
        if out and tokens(out[-1] + glue + p) <= size:
            out[-1] += glue + p
        else:
            out.append(p)
    return out


def overlapped(chunks: list[str], size: int, glue: str = " ") -> list[str]:
    """Each chunk after the tail of the one before."""
    if size <= 0:
        return chunks
    return chunks[:1] + [f"{t}{glue}{c}" if (t := tail(before, size)) else c for before, c in zip(chunks, chunks[1:], strict=False)]


def recursive(text: str, size: int, overlap: int = 0, separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")) -> list[str]:
    """By the coarsest separator first; parts that are too large by the next. Overlap is put at every level that packs."""
    if tokens(text) <= size:
        return [text] if text.strip() else []
    if not separators:
        step = max(1, size * 2)
        return [text[i : i + step] for i in range(0, len(text), step)]
    glue, *rest = separators
    pieces = text.split(glue)
    pieces = [p + (glue.rstrip() if i + 1 < len(pieces) and glue.strip() else "") for i, p in enumerate(pieces)]
    out: list[str] = []
    group: list[str] = []
    for p in [*pieces, None]:
        if p is not None and tokens(p) <= size:
            group.append(p)
            continue
        out += overlapped(packed(group, size, glue if not glue.strip() else " "), overlap)
        group = []
        if p is not None:
            out += recursive(p, size, overlap, tuple(rest))
    return out


def by_sentence(text: str, size: int, overlap: int = 0) -> list[str]:
    parts = _SENTENCE.split(text)
    if len(parts) == 1:
        parts = text.split("\n")
    return overlapped(packed(parts, size, " "), overlap)


def by_block(text: str, size: int, overlap: int = 0) -> list[str]:
    """Paragraphs and list items; those too large by sentence; small neighbours joined."""
    parts = [s for b in _BLOCK.split(text) for s in (by_sentence(b, size) if tokens(b) > size else [b])]
    return overlapped(packed(parts, size, "\n\n"), overlap)


def by_header(text: str, size: int, overlap: int = 0) -> list[str]:
    """Sections at headers, with what stands before the first; sections too large, and texts without headers, by block."""
    starts = [m.start() for m in _HEADER.finditer(text)]
    if not starts:
        return by_block(text, size, overlap)
    bounds = ([0] if starts[0] else []) + [*starts, len(text)]
    parts = [text[a:b].strip() for a, b in zip(bounds, bounds[1:], strict=False)]
    return [c for p in parts if p for c in ([p] if tokens(p) <= size else by_block(p, size, overlap))]


STRATEGIES = {"recursive": recursive, "sentence": by_sentence, "block": by_block, "header": by_header}


def table_chunks(table: str, rows: int = 10) -> list[str]:
    """Blocks of at most ``rows`` data rows of a piped table, each under its header and what stands before it; a tagged list is one block."""
    m = _PIPED.search(table)
    if not m and _LIST_TAG.match(table.strip()):
        return [table.strip()]
    lead, piped = (table[: m.start()].strip(), m[0]) if m else ("", table)
    lines = [x.strip() for x in piped.strip().split("\n")]
    head = lines[:2] if len(lines) > 1 and re.fullmatch(r"[|\s:-]+", lines[1]) else lines[:1]
    body = lines[len(head) :]
    head = [lead, *head] if lead else head
    return ["\n".join(head + body[i : i + rows]) for i in range(0, len(body), rows)] or ["\n".join(head)]


@dataclass(frozen=True)
class Table:
    start: int
    end: int
    kind: str  # piped or list
    title: str | None
    headers: list[str]
    rows: list[list[str]]


def _cells(line: str) -> list[str]:
    return [c.strip() for c in line.split("|") if c.strip()]


def _piped_tables(text: str) -> Iterator[Table]:
    """Piped tables. One after a tag begins at the tag, at the first of several since the table before, and has its number for a title."""
    tags, at = [(m.start(), m[1]) for m in _TAG.finditer(text)], 0
    for m in _PIPED.finditer(text):
        lines = m[0].strip().split("\n")
        start, title = m.start(), None
        if at < len(tags) and tags[at][0] < start:
            start, title = tags[at][0], f"표 {tags[at][1]}"
        while at < len(tags) and tags[at][0] < m.end():
            at += 1
        yield Table(start, m.end(), "piped", title, _cells(lines[0]), [c for x in lines[2:] if (c := _cells(x))])


def _list_tables(text: str) -> Iterator[Table]:
    """Tagged lists of keys and values: a row for each item, headed by the keys of the first."""
    at = 0
    for m in _LIST_TAG.finditer(text):
        if m.start() < at:
            continue
        at = _LIST_END.search(text, m.end()).start()
        items = [{k.strip(): v.strip() for k, v in _PAIR.findall(x) if k.strip() and v.strip()} for x in _ITEM.split(text[m.end() : at].strip())]
        items = [x for x in items if x]
        yield Table(m.start(), at, "list", f"표 {m[1]}", list(items[0]) if items else [], [list(x.values()) for x in items])


def detected_tables(text: str) -> list[Table]:
    """Tables of both kinds in order; of those that overlap the one that starts first, a piped one before a list."""
    out: list[Table] = []
    for t in sorted([*_piped_tables(text), *_list_tables(text)], key=lambda t: t.start):
        if not out or (t.start >= out[-1].end and t.end > out[-1].end):
            out.append(t)
    return out


def tagged_parts(text: str) -> list[dict[str, str]]:
    """The text as stretches up to and with a tag and an empty line, each with the piped table that comes next before any other tag ("" at the end, or if there is none)."""
    out, at = [], 0
    tags = list(_TAG.finditer(text))
    for m, following in zip(tags, [*tags[1:], None], strict=True):
        t = _PIPED.search(text, m.end(), following.start() if following else len(text))
        if t and not text[m.end() : t.start()].strip():
            piped = t[0].rstrip("\n")
            out.append({"before": text[at : m.end()] + "\n\n", "piped": piped})
            at = t.start() + len(piped)
    return [*out, {"before": text[at:], "piped": ""}]


def table_list(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, table_index, kind, title, headers, rows, start, end (in characters) of every table of every text. Null texts have none."""

    @F.pandas_udf("array<struct<kind:string,title:string,headers:array<string>,rows:array<array<string>>,start:int,end:int>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[asdict(t) for t in detected_tables(x or "")] for x in texts])

    return docs.select(key, F.posexplode(found(text)).alias("table_index", "t")).select(key, "table_index", "t.kind", "t.title", "t.headers", "t.rows", "t.start", "t.end")


def segments(text: str, tables: bool = True) -> list[tuple[str, str]]:
    """(kind, text): tables, and what is between them, blank stretches left out."""
    out, at = [], 0
    for t in detected_tables(text) if tables else ():
        out += [("text", text[at : t.start]), ("table", text[t.start : t.end])]
        at = t.end
    return [(k, t) for k, t in [*out, ("text", text[at:])] if t.strip()]


def segmented(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, segment, kind, content: texts cut around their tables. Null and blank texts have no segment."""

    @F.pandas_udf("array<struct<kind:string,content:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "content": c} for k, c in segments(t or "")] for t in texts])

    return docs.select(key, F.posexplode(cut(text)).alias("segment", "s")).select(key, "segment", "s.kind", "s.content")


def chunk_text(text: str, strategy: str = "recursive", size: int = 800, overlap: int = 0, rows: int = 10, tables: bool = True) -> list[tuple[str, str, int]]:
    """(kind, text, tokens) of each chunk, in order."""
    out = []
    for kind, part in segments(text, tables):
        out += [(kind, c, tokens(c)) for c in (table_chunks(part, rows) if kind == "table" else STRATEGIES[strategy](part, size, overlap))]
    return out


def by_characters(text: str, size: int = 1500, words: int = 40) -> list[str]:
    """Paragraphs packed by characters; each next chunk starts with the last words of the one before."""
    out: list[str] = []
    for p in (x.strip() for x in text.split("\n") if x.strip()):
        if out and len(out[-1]) + 1 + len(p) <= size:
            out[-1] += "\n" + p
        else:
            out.append(" ".join([*out[-1].split()[-words:], "\n" + p]) if out else p)
    return out


def by_token_budget(text: str, size: int = 350, overlap: int = 50) -> list[tuple[str, int, bool]]:
    """(text, group, continued): paragraphs within a budget, long ones by sentence, then by characters; paragraphs with tabs or pipes are table groups."""
    out: list[tuple[str, int, bool]] = []
    group, was_table = 0, None
    run: list[str] = []

    def flush() -> None:
        chunks = overlapped(packed(run, size, "\n"), 0 if was_table else overlap)
        out.extend((c, group, i > 0) for i, c in enumerate(chunks))
        run.clear()

    for p in (x for x in text.split("\n") if x.strip()):
        is_table = "\t" in p or "|" in p
        if was_table is not None and is_table != was_table:
            flush()
            group += 1
        was_table = is_table
        run += [p] if tokens(p) <= size else [c for s in packed(_SENTENCE.split(p), size, " ") for c in recursive(s, size, 0, (" ",))]
    if run:
        flush()
    return out


PIECE = 1 << 20  # characters of texts whose chunks a task holds at once; a longer text alone


def _spread(docs: DataFrame, key: str, text: str, cut: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """key, chunk_index and the columns of ``schema``: a row for each that ``cut(text)`` gives."""
    fields = DataType.fromDDL(f"struct<{schema}>")
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select(key, F.col(text).cast("string")).mapInArrow(_spreader(key, cut, to_arrow_schema(fields)), f"`{key}` {docs.schema[key].dataType.simpleString()}, chunk_index int, {given}")


def _spreader(key: str, cut: Callable[[str], list[tuple]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows go on after each ``PIECE`` of texts, however many a batch has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.columns
            at, index, rows, held = [], [], [], 0
            for i in range(batch.num_rows):
                whole = texts[i].as_py() or ""
                found = cut(whole)
                at += [i] * len(found)
                index += range(len(found))
                rows += found
                held += len(whole)
                if held >= PIECE or i == batch.num_rows - 1:
                    columns = [pa.array([r[j] for r in rows], f.type) for j, f in enumerate(schema)]
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(index, pa.int32()), *columns], [key, "chunk_index", *schema.names])
                    at, index, rows, held = [], [], [], 0

    return run


def chunked(docs: DataFrame, key: str = "doc_id", text: str = "text", strategy: str = "recursive", size: int = 800, overlap: int = 0, rows: int = 10, tables: bool = True) -> DataFrame:
    """key, chunk_id, chunk_index, kind, tokens, content of every chunk of every document. Null texts have none."""

    each = _spread(docs, key, text, lambda t: chunk_text(t, strategy, size, overlap, rows, tables), "kind:string,content:string,tokens:int")
    label = F.concat(F.col(key).cast("string"), F.lit("_"), F.col("kind"), F.lit("_"), F.lpad(F.col("chunk_index").cast("string"), 3, "0"))
    return each.select(key, F.when(F.col("chunk_index") > 999, F.concat(F.col(key).cast("string"), F.lit("_"), F.col("kind"), F.lit("_"), F.col("chunk_index").cast("string"))).otherwise(label).alias("chunk_id"), "chunk_index", "kind", "tokens", "content")


def chunked_by(docs: DataFrame, splitter, schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The same with a splitter of one's own: ``splitter(text)`` gives rows of ``schema``."""

    return _spread(docs, key, text, lambda t: [r if isinstance(r, tuple) else (r,) for r in splitter(t)], schema)
