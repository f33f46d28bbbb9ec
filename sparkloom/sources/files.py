"""Files in and out: JSON stores, inventories, formats and character sets, partitioned and versioned writes."""

from __future__ import annotations

import base64
import fnmatch
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What files of each format begin with.
MAGIC = {"25504446": "pdf", "504B0304": "zip", "D0CF11E0": "ole", "89504E47": "png", "FFD8FFE0": "jpg", "EFBBBF3C": "html", "3C21444F": "html", "3C68746D": "html"}
FAMILIES = {"pdf": "pdf", "docx": "zip", "xlsx": "zip", "hwpx": "zip", "zip": "zip", "hwp": "ole", "doc": "ole", "xls": "ole", "png": "png", "jpg": "jpg", "html": "html", "htm": "html"}


def read_chunk_files(spark: SparkSession, path: str, schema: str, pattern: str = r"/([^/]+)/([^/]+)/([^/]+)/[^/]*$") -> DataFrame:
    """Chunks out of JSON files, either {"chunks": [..]} or a bare list, with org, board and month out of their path."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("__file", F.input_file_name())
    each = f"array<struct<{schema}>>"
    bare = F.when(F.ltrim("value").startswith("["), F.from_json("value", each))
    found = raw.select("__file", F.explode(F.coalesce(bare, F.from_json("value", f"chunks {each}")["chunks"])).alias("c"))
    return found.select(*[F.regexp_extract("__file", pattern, i + 1).alias(n) for i, n in enumerate(("org", "board", "month"))], "c.*")


def inventory(spark: SparkSession, path: str, pattern: str = r"/([^/]+)/([^/]+)/[^/]+/[^/]*$", glob: str = "*.json") -> DataFrame:
    """Files and bytes by org and board; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length")
    keys = [F.regexp_extract("path", pattern, i + 1).alias(n) for i, n in enumerate(("org", "board"))]
    return files.select(*keys, "length").groupBy("org", "board").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def read_table_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cells of cached table structures: pdf_hash, page_num, table_index, cell, row_span, col_span, bbox, is_merged."""
    schema = "pdf_hash string, page_num int, table_index int, cells array<struct<row_span:array<int>,col_span:array<int>,bbox:array<double>,is_merged:boolean>>"
    raw = spark.read.schema(schema).json(path, multiLine=True, recursiveFileLookup=True)
    return raw.select("pdf_hash", "page_num", "table_index", F.posexplode("cells").alias("cell", "c")).select("pdf_hash", "page_num", "table_index", "cell", "c.*")


def actual_format(content: Column, name: Column) -> tuple[Column, Column]:
    """(declared, actual) format of a file: by its extension, and by its first four bytes; zip and ole families go by the extension."""
    declared = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    family = F.element_at(F.create_map(*[F.lit(x) for kv in MAGIC.items() for x in kv]), F.hex(F.substring(content, 1, 4)))
    own = F.element_at(F.create_map(*[F.lit(x) for kv in FAMILIES.items() for x in kv]), declared)
    return declared, F.when(family == own, declared).otherwise(F.coalesce(family, F.lit("unknown")))


#: What contents are tried as, in this order.
CHARSETS = ("utf-8", "euc-kr", "cp949", "utf-16", "utf-16-le", "utf-16-be", "latin-1")
_MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))


def decoding_score(text: str) -> float:
    """As ``quality.decoding_score``, for a text at hand: 0.6 valid + 0.4 (1 - replaced)."""
    if not text:
        return 0.0
    invalid = sum(c < " " and c not in "\t\n\r" or c == "\x7f" or "\ue000" <= c <= "\uf8ff" for c in text)
    return (len(text) - invalid) / len(text) * 0.6 + (1 - text.count("\ufffd") / len(text)) * 0.4


def _tried(content: bytes, charset: str) -> str | None:
    """Strictly, else with replacements if they are a tenth at most."""
    try:
        return content.decode(charset)
    except UnicodeDecodeError:
        text = content.decode(charset, "replace")
        return None if text.count("\ufffd") > 0.1 * max(len(text), 1) else text
    except LookupError:
        return None


def decode(content: bytes, charsets: tuple[str, ...] = CHARSETS, enough: float = 0.9) -> tuple[str, str]:
    """(text, charset): by a byte-order mark; else what a meta tag names, if all of it fits; else the candidate of the best score, the first over ``enough``."""
    for mark, charset in _MARKS:
        if content.startswith(mark) and (text := _tried(content, charset)) is not None:
            return text, charset.removesuffix("-sig")
    named = re.search(rb"charset=[\"']?([A-Za-z0-9_-]+)", content[:4096])
    if named:
        try:
            return content.decode(named[1].decode()), named[1].decode().lower()
        except (UnicodeDecodeError, LookupError):
            pass
    best = ("", "", -1.0)
    for charset in charsets:
        text = _tried(content, charset)
        if text and (score := decoding_score(text)) > best[2]:
            best = (text, charset, score)
            if score > enough:
                break
    return best[0], best[1] or charsets[0]


def decoded(df: DataFrame, key: str, content: str, limit: int = 4 << 20) -> DataFrame:
    """key, text, charset of binary contents; a task holds about ``limit`` bytes as texts, or one longer content."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())).to_numpy()
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(ends.searchsorted((ends[at - 1] if at else 0) + limit, "right")))
                part = batch.slice(at, end - at)
                found = [decode(x.as_py()) if x.is_valid else ("", "") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t for t, _ in found], pa.string()), pa.array([c for _, c in found], pa.string())], [key, "text", "charset"])
                at = end

    return df.select(key, F.col(content).alias("__content")).mapInArrow(run, f"{key} {kind}, text string, charset string")


def encoded(df: DataFrame, text: str, charset: str, out: str) -> DataFrame:
    """``df`` with the base64 of each text in its own charset; characters that it lacks become question marks."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, charsets: pd.Series) -> pd.Series:
        return pd.Series([base64.b64encode(t.encode(c, "replace")).decode() if t is not None else None for t, c in zip(texts, charsets, strict=True)], dtype=object)

    return df.withColumn(out, run(text, charset))


def _store(path: str):
    """The file system of a path, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_each(df: DataFrame, key: str, content: str, path: str, each: int = 1000) -> None:
    """A file for each row, named by its key, in numbered folders of about ``each`` files under one that executors share; contents are base64. A task that runs again replaces its files."""

    def run(rows) -> None:
        store, root = _store(path)
        made = set()
        for r in rows:
            if r[2] not in made:
                store.create_dir(f"{root}/{r[2]}")
                made.add(r[2])
            with store.open_output_stream(f"{root}/{r[2]}/{r[0]}") as f:
                f.write(base64.b64decode(r[1] or ""))

    folders = max(1, -(-df.count() // each))  # small ones, so that tasks can list them side by side
    _store(path)[0].create_dir(_store(path)[1])
    df.select(key, content, F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(folders)).alias("__folder")).foreachPartition(run)


def save(df: DataFrame, path: str, by: list[str], format: str = "parquet") -> None:
    df.write.partitionBy(*by).format(format).save(path)


def migrate(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a JSON store that maps ids to records: id and the record's fields."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", f"map<string,struct<{schema}>>")).alias("id", "r")).select("id", "r.*")


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = "|") -> DataFrame:
    return spark.read.csv(path, schema=schema, sep=sep, header=False)


class Heads(DataSource):
    """Files as path, length and their first bytes (option ``bytes``, 4096; -1: all): for heads, contents are opened, not read through.

    ``spark.read.format("heads").option("bytes", 8).load(folder)``. The driver lists the folder itself; what is under its folders is listed
    and read in tasks, each of which knows only its own folders. As in Spark's sources, names that begin with _ or . are passed over.
    """

    @classmethod
    def name(cls) -> str:
        return "heads"

    def schema(self) -> str:
        return "path string, length long, head binary"

    def reader(self, schema) -> DataSourceReader:
        return _HeadReader(self.options)


class _HeadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.n, self.glob = options["path"], int(options.get("bytes", "4096")), options.get("glob", "*")

    def _listed(self, at: str, deep: bool) -> list[tuple[str, bool]]:
        """Paths under ``at`` (itself, if it is a file), and whether they are folders."""
        from pyarrow import fs

        store = _store(self.path)[0]
        if store.get_file_info(at).type == fs.FileType.File:
            return [(at, False)]
        found = [(x.path, x.type == fs.FileType.Directory) for x in store.get_file_info(fs.FileSelector(at, recursive=deep))]
        return [(p, d) for p, d in found if not any(part[0] in "_." for part in p[len(at) :].split("/") if part)]

    def partitions(self) -> list[InputPartition]:
        top = self._listed(_store(self.path)[1].rstrip("/"), False)
        folders, own = sorted(p for p, d in top if d), sorted(p for p, d in top if not d)
        together = -(-len(folders) // 1000) or 1
        cut = lambda paths, n: [InputPartition(paths[i : i + n]) for i in range(0, len(paths), n)]
        return cut(folders, together) + cut(own, 1000) or [InputPartition([])]

    def read(self, partition: InputPartition):
        store, root = _store(self.path)
        scheme = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        rows, held = [], 0
        for at in partition.value:
            for path, folder in self._listed(at, True):
                if folder or not fnmatch.fnmatchcase(path.rsplit("/", 1)[-1], self.glob):
                    continue
                with store.open_input_file(path) as f:
                    rows.append((scheme + path, f.size(), f.read(self.n) if self.n >= 0 else f.read()))
                held += len(rows[-1][2])
                if len(rows) == 1000 or held >= 4 << 20:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
        path, length, head = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(length, pa.int64()), pa.array(head, pa.binary())], ["path", "length", "head"])


def heads(spark: SparkSession, path: str, n: int = 8, glob: str = "*") -> DataFrame:
    """path, length, head: the first ``n`` bytes (-1: all) of each file under a folder."""
    spark.dataSource.register(Heads)
    return spark.read.format("heads").option("bytes", n).option("glob", glob).load(path)


#: Entries that only some kinds of ZIP and OLE files have.
ZIP_KINDS = (("hwpx", b"mimetypeapplication/hwp+zip"), ("docx", b"word/"), ("xlsx", b"xl/"), ("pptx", b"ppt/"))
OLE_KINDS = (("hwp", "FileHeader"), ("doc", "WordDocument"), ("xls", "Workbook"), ("ppt", "PowerPoint Document"))


def container_kind(head: Column) -> Column:
    """What a ZIP or OLE file is by names in its first bytes (some kilobytes): hwpx, docx, xlsx, pptx, hwp, doc, xls, ppt; else zip, ole or null."""
    text = F.hex(head)
    wide = lambda name: name.encode("utf-16-le").hex().upper()
    has = lambda bytes_hex: F.locate(bytes_hex, text) > 0
    zipped, ole = F.lit("zip"), F.lit("ole")
    for kind, name in reversed(ZIP_KINDS):
        zipped = F.when(has(name.hex().upper()), kind).otherwise(zipped)
    for kind, name in reversed(OLE_KINDS):
        ole = F.when(has(wide(name)), kind).otherwise(ole)
    return F.when(text.startswith("504B0304"), zipped).when(text.startswith("D0CF11E0"), ole)
