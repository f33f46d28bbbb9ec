"""Nested records: documents out of JSON variants, flattening, keys out of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def document_text(raw: Column) -> Column:
    """The text of a stored document: its sections joined by blank lines, else extracted_text, content.text, content or text; what isn't JSON is text itself."""
    sections = F.from_json(F.get_json_object(raw, "$.sections"), "array<struct<content:string>>")
    joined = F.nullif(F.array_join(F.filter(F.transform(sections, lambda s: s["content"]), lambda c: F.coalesce(c, F.lit("")) != ""), "\n\n"), F.lit(""))
    found = [F.nullif(F.get_json_object(raw, p), F.lit("")) for p in ("$.extracted_text", "$.content.text", "$.content", "$.text")]
    return F.coalesce(joined, *found, raw)


def flattened(df: DataFrame, prefix: str = "") -> DataFrame:
    """Struct fields, at any depth, as columns named by their dotted path. Only the schema is walked on the driver."""

    def walk(schema: StructType, path: list[str]) -> list[tuple[list[str], str]]:
        out = []
        for f in schema.fields:
            at = [*path, f.name]
            out += walk(f.dataType, at) if isinstance(f.dataType, StructType) else [(at, prefix + ".".join(at))]
        return out

    return df.select(*[F.col(".".join(f"`{p}`" for p in path)).alias(name) for path, name in walk(df.schema, [])])


def path_keys(path: Column, org: str, board: str) -> list[Column]:
    """org and board out of a storage path, back slashes as slashes."""
    clean = F.translate(path, "\\", "/")
    return [F.regexp_extract(clean, org, 1).alias("org"), F.regexp_extract(clean, board, 1).alias("board")]


def records(raw: Column, paths: list[str], schema: str) -> Column:
    """array<struct> out of an API response: the first of the paths that holds an array, else the response as one record."""
    each = f"array<struct<{schema}>>"
    found = [F.from_json(F.get_json_object(raw, p), each) for p in paths]
    some = [F.when(F.substring(F.ltrim(F.get_json_object(raw, p)), 1, 1) == "[", x) for p, x in zip(paths, found, strict=True)]
    return F.coalesce(*some, F.array(F.from_json(raw, f"struct<{schema}>")))
