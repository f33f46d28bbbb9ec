"""Tables inside documents: rows of cells as array<array<string>>, mostly array functions; fuzzy comparisons in Arrow UDFs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions.text import clean_cell
from sparkloom.operators.chunking import detected_tables, tagged_parts
from sparkloom.operators.ranking import islands

NUMERIC = r"^[-+]?[0-9][0-9,]*(\.[0-9]+)?%?$"


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with x worked out once, wherever in it x stands."""
    return F.get(F.transform(F.array(x), use), 0)


def parse_markdown(x: Column) -> Column:
    """Rows of a piped table without its separator line."""
    lines = F.filter(F.split(x, "\n"), lambda p: p.contains("|") & ~p.rlike(r"^[\s|:\-]+$"))
    return F.transform(lines, lambda p: F.transform(F.split(F.regexp_replace(F.trim(p), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))


def to_markdown(rows: Column) -> Column:
    """A piped table; short rows are padded, cells cleaned."""

    def lines(width: Column) -> Column:
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda i: clean_cell(F.get(r, i))), " | "), F.lit(" |"))
        rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
        return F.concat_ws("\n", line(rows[0]), rule, F.array_join(F.transform(F.slice(rows, 2, F.size(rows)), line), "\n"))

    return _let(F.array_max(F.transform(rows, lambda r: F.size(r))), lines)


def padded(rows: Column, width: int | Column) -> Column:
    """Every row of the width: cut, or filled with ""."""
    return F.transform(rows, lambda r: F.transform(F.sequence(F.lit(0), F.lit(width) - 1 if isinstance(width, int) else width - 1), lambda i: F.coalesce(F.get(r, i), F.lit(""))))


def filled(rows: Column, policy: str) -> Column:
    """Empty cells as ``-`` (dash), null (null), or what the row above has (inherit)."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    if policy == "dash":
        return F.transform(rows, lambda r: F.transform(r, lambda c: F.when(blank(c), "-").otherwise(c)))
    if policy == "null":
        return F.transform(rows, lambda r: F.transform(r, lambda c: F.when(~blank(c), c)))
    start = F.array().cast("array<array<string>>")
    return F.aggregate(rows, start, lambda acc, r: F.concat(acc, F.array(F.transform(r, lambda c, i: F.when(blank(c) & (F.size(acc) > 0), F.get(F.element_at(F.when(F.size(acc) > 0, acc).otherwise(F.array(r)), -1), i)).otherwise(c)))))


def numeric_share(row: Column) -> Column:
    return F.size(F.filter(row, lambda c: F.trim(c).rlike(NUMERIC))) / F.greatest(F.size(F.filter(row, lambda c: F.trim(c) != "")), F.lit(1))


#: Words of header cells, as expressions over lower case.
HEADER_WORDS = "번호|항목|구분|분류|명칭|단위|합계|소계|총|계|no|item|category|name|unit"


def is_header_row(row: Column, words: str = HEADER_WORDS) -> Column:
    """Whether a row other than the first is header: a cell has a word of headers; else unless over 0.7 of the cells are empty, more cells are text than numbers."""
    cells = F.transform(row, lambda c: F.trim(F.coalesce(c, F.lit(""))))
    filled = F.filter(cells, lambda c: c != "")

    def judged(f: Column) -> Column:
        numbers = F.size(F.filter(f, lambda c: c.rlike(r"^[0-9,.\-+%]+$")))
        worded = F.exists(f, lambda c: F.lower(c).rlike(words))
        sparse = F.size(row) - F.size(f) > 0.7 * F.size(row)
        return F.when(F.size(f) == 0, F.lit(False)).when(worded, F.lit(True)).when(sparse, F.lit(False)).otherwise(F.size(f) > 2 * numbers)

    return _let(filled, judged)


def header_rows(rows: Column, most: int = 3, words: str = HEADER_WORDS) -> Column:
    """How many rows are header: the first, and those after it that are, to the first that isn't; ``most`` at most."""
    flags = F.transform(F.slice(rows, 2, most - 1), lambda r: is_header_row(r, words))
    first = F.array_position(F.transform(flags, lambda x: F.coalesce(x, F.lit(False))), F.lit(False)).cast("int")
    return F.coalesce(F.when(first > 0, first).otherwise(F.size(flags) + 1), F.lit(1))


def flat_header(rows: Column, n: Column) -> Column:
    """One name for each column out of n header rows: levels joined by ``_``, empty cells of upper levels from the left, repeats once."""
    head = F.slice(rows, 1, n)
    left = F.transform(head, lambda r: F.aggregate(r, F.array().cast("array<string>"), lambda acc, c: F.concat(acc, F.array(F.when((c == "") & (F.size(acc) > 0), F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(""))).otherwise(c)))))
    levels = F.transform(F.sequence(F.lit(0), F.size(rows[0]) - 1), lambda i: F.array_distinct(F.filter(F.concat(F.transform(F.slice(left, 1, n - 1), lambda r: F.get(r, i)), F.array(F.get(F.element_at(head, -1), i))), lambda c: F.coalesce(c, F.lit("")) != "")))
    return F.transform(levels, lambda x: F.array_join(x, "_"))


def valid(rows: Column, least_rows: int = 2, least_columns: int = 2, least_filled: float = 0.3) -> Column:
    """A table worth keeping: enough rows and columns, enough of the cells with something in them."""
    width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
    solid = F.size(F.filter(F.flatten(rows), lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""))
    return (F.size(rows) >= least_rows) & (width >= least_columns) & (solid / F.greatest(F.size(rows) * width, F.lit(1)) >= least_filled)


def expanded(cells: DataFrame, table: str, row: str, column: str, row_span: str, column_span: str, text: str) -> DataFrame:
    """table, row, column, text of every place of the grid; places that a merged cell covers are ""."""
    each = cells.select(table, row, column, text, F.explode(F.sequence(F.lit(0), F.col(row_span) - 1)).alias("__r"), column_span)
    each = each.select(table, row, column, text, "__r", F.explode(F.sequence(F.lit(0), F.col(column_span) - 1)).alias("__c"))
    here = (F.col("__r") == 0) & (F.col("__c") == 0)
    return each.select(table, (F.col(row) + F.col("__r")).alias(row), (F.col(column) + F.col("__c")).alias(column), F.when(here, F.col(text)).otherwise("").alias(text))


def linearized(headers: Column, row: Column) -> Column:
    """``header: value | header: value``; empty values are left out."""
    pairs = F.zip_with(headers, row, lambda h, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(h, F.lit(": "), v)))
    return F.array_join(F.array_compact(pairs), " | ")


def column_kinds(cells: DataFrame, table: str, column: str, text: str) -> DataFrame:
    """What over half of each column's filled cells are: percentage, numeric, date, else text."""
    c = F.trim(text)
    flags = cells.where(c != "").select(table, column, c.rlike("^[-+]?[0-9.,]+ ?%$").alias("p"), c.rlike(r"^[-+]?[0-9][0-9,]*(\.[0-9]+)?$").alias("n"), c.rlike("^[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}$").alias("d"))
    share = lambda x: F.avg(F.col(x).cast("int")) > 0.5
    return flags.groupBy(table, column).agg(F.when(share("p"), "percentage").when(share("n"), "numeric").when(share("d"), "date").otherwise("text").alias("kind"))


def position_score(a: Column, b: Column, height: Column) -> Column:
    """Whether a table of box ``a`` (left, top, right, bottom) may go on in one of box ``b`` on the next page: 0.4 if it ends in the page's last
    0.15, 0.4 if the other begins in the first 0.15, and 0.2 times the overlap of their widths over both; 0.5 if something is unknown."""
    at = F.get
    overlap = F.least(at(a, 2), at(b, 2)) - F.greatest(at(a, 0), at(b, 0))
    union = F.greatest(at(a, 2), at(b, 2)) - F.least(at(a, 0), at(b, 0))
    ends = F.when(at(a, 3) >= height * 0.85, 0.4).otherwise(0.0)
    begins = F.when(at(b, 1) <= height * 0.15, 0.4).otherwise(0.0)
    found = F.least(F.lit(1.0), ends + begins + F.when(union > 0, overlap / 5 / union).otherwise(0.0))  # a fifth, as 0.2 is a bit more
    return F.when(height.isNull() | (height == 0) | a.isNull() | b.isNull(), 0.5).otherwise(found)


def similarity(a: str, b: str):
    """UDF columns: edit likeness of two strings, 0 to 1."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, p or "", q or "").ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)


def signature(headers: Column) -> Column:
    """struct<n, names, print> of a header."""
    names = F.transform(headers, lambda h: F.lower(F.regexp_replace(h, r"[^A-Za-z0-9\x{AC00}-\x{D7AF}]", "")))
    return F.struct(F.size(headers).alias("n"), names.alias("names"), F.substring(F.md5(F.array_join(names, "|")), 1, 16).alias("print"))


def signature_score(pairs: DataFrame, a: str, b: str, out: str = "score", tolerance: float = 0.15) -> DataFrame:
    """0.25 count + 0.45 names + 0.15 widths + 0.15 print of two signatures.

    count: one less the share of columns that one side lacks. names: a name counts its likeness to the one at its place, if 0.8 or more; the mean over the shorter header, times the
    share of the longer that it is. widths: columns' shares of the width; each counts one less its difference over ``tolerance``; where a signature has none (no field ``widths``), 1.
    """
    has_widths = all("widths" in pairs.schema[c].dataType.names for c in (a, b))

    @F.pandas_udf("double")
    def names(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(p, q):
            likeness = [1.0 if s == t else SequenceMatcher(None, s, t).ratio() for s, t in zip(p, q, strict=False)]
            return sum(x for x in likeness if x >= 0.8) / max(len(p), len(q)) if likeness else 0.0

        return pd.Series([one(p, q) if p is not None and q is not None else 0.0 for p, q in zip(x, y, strict=True)], dtype="float64")

    f = lambda s, c: F.col(f"{s}.{c}")
    count = F.least(f(a, "n"), f(b, "n")) / F.greatest(f(a, "n"), f(b, "n"), F.lit(1))
    widths = F.lit(1.0)
    if has_widths:
        shorter = F.least(F.size(f(a, "widths")), F.size(f(b, "widths")))
        each = F.zip_with(F.slice(f(a, "widths"), 1, shorter), F.slice(f(b, "widths"), 1, shorter), lambda x, y: F.greatest(F.lit(0.0), 1 - F.abs(x - y) / tolerance))
        widths = F.when((F.size(f(a, "widths")) > 0) & (F.size(f(b, "widths")) > 0), F.aggregate(each, F.lit(0.0), lambda n, x: n + x) / shorter).otherwise(1.0)
    same = (f(a, "print") == f(b, "print")).cast("double")
    return pairs.withColumn(out, 0.25 * count + 0.45 * names(f(a, "names"), f(b, "names")) + 0.15 * widths + 0.15 * same)


def _alike(row: list, other: list, blank: str) -> bool:
    """Rows of one length whose cells (any case, white space as ``blank``) are alike by 0.9 in 0.9 of the places."""
    if len(row) != len(other):
        return False
    hits = 0
    for s, t in zip(row, other, strict=True):
        s, t = (blank.join((x or "").lower().split()) for x in (s, t))
        hits += s == t or bool(s and t and SequenceMatcher(None, s, t).ratio() >= 0.9)
    return hits >= 0.9 * len(row)


def repeats_header(header: Column, rows: Column) -> Column:
    """True if a row of ``header`` is alike to the row of ``rows`` in its place."""

    @F.pandas_udf("boolean")
    def found(heads: pd.Series, tables: pd.Series) -> pd.Series:
        return pd.Series([a is not None and b is not None and any(_alike(h, r, "") for h, r in zip(a, b, strict=False)) for a, b in zip(heads, tables, strict=True)], dtype=bool)

    return found(header, rows)


def duplicate_headers(header: Column, rows: Column, first: Column) -> Column:
    """Places (from 0) of rows that repeat ``header``: at the start, row by row until one differs, unless ``first``; after that, whole headers anywhere.

    Of a first table the header itself stays; headers of no rows repeat nowhere.
    """

    def places(head: list, table: list, keep: bool) -> list[int]:
        depth = len(head)
        if not depth:
            return []
        at, out = depth if keep else 0, []
        while not keep and at < min(depth, len(table)) and _alike(table[at], head[at], " "):
            out.append(at)
            at += 1
        while at + depth <= len(table):
            if all(_alike(r, h, " ") for r, h in zip(table[at : at + depth], head, strict=True)):
                out += range(at, at + depth)
                at += depth
            else:
                at += 1
        return out

    @F.pandas_udf("array<int>")
    def found(heads: pd.Series, tables: pd.Series, keeps: pd.Series) -> pd.Series:
        return pd.Series([places(h, t, k) for h, t, k in zip(heads, tables, keeps, strict=True)])

    return found(header, rows, first)


def without_duplicate_headers(tables: DataFrame, rows: str, header: str, first: Column, removed: str = "removed_headers") -> DataFrame:
    """``tables`` with the rows that repeat the header taken out, and their number."""
    marked = tables.withColumn("__places", duplicate_headers(F.col(header), F.col(rows), first))
    kept = F.filter(rows, lambda r, i: ~F.array_contains("__places", i))
    return marked.withColumn(rows, kept).withColumn(removed, F.size("__places")).drop("__places")


#: What a cell is by its look, in this order; text if none fits.
CELL_KINDS = [("percentage", r"^[0-9,.]+\s*%$"), ("numeric", r"^[0-9,.\-+]+$"), ("date", r"^[0-9]{4}[-/년][0-9]{1,2}[-/월]?[0-9]{0,2}")]


def data_patterns(rows: Column) -> Column:
    """array<struct<kind, share>>, one for each column of the first row: what over half of its filled cells are, with their share; text else; empty."""
    kind_of = lambda c: F.coalesce(*[F.when(c.rlike(p), k) for k, p in CELL_KINDS], F.lit("text"))
    cells = F.transform(F.sequence(F.lit(0), F.size(F.get(rows, 0)) - 1), lambda i: F.transform(F.filter(F.transform(rows, lambda r: F.trim(F.coalesce(F.get(r, i), F.lit("")))), lambda c: c != ""), kind_of))

    def pattern(kinds: Column) -> Column:
        share = lambda k: F.size(F.filter(kinds, lambda x: x == k)) / F.size(kinds)
        of = lambda k: F.struct(F.lit(k).alias("kind"), share(k).alias("share"))
        empty = F.struct(F.lit("empty").alias("kind"), F.lit(1.0).alias("share"))
        chosen = F.when(F.size(kinds) == 0, empty)
        for k, _ in CELL_KINDS:
            chosen = chosen.when(share(k) > 0.5, of(k))
        return chosen.otherwise(of("text"))

    return F.when(F.size(F.get(rows, 0)) > 0, F.transform(cells, pattern)).otherwise(F.array().cast("array<struct<kind:string,share:double>>"))


def with_features(df: DataFrame, s: str) -> DataFrame:
    """``df`` with the struct ``s`` (page, rows, where known widths and box) as what ``continuity`` compares: without the rows, but for the first three."""
    names = df.schema[s].dataType.names
    rows, depth, head, shares = (F.col(f"__{s}_{c}") for c in ("rows", "depth", "head", "shares"))
    no_widths = F.array().cast("array<double>")
    total = F.aggregate(f"{s}.widths", F.lit(0.0), lambda n, x: n + x) if "widths" in names else None
    # Each a column of its own, so that none is worked out again wherever it is used.
    df = df.withColumn(f"__{s}_rows", F.coalesce(F.col(f"{s}.rows"), F.array().cast("array<array<string>>")))
    df = df.withColumn(f"__{s}_depth", F.when(F.size(rows) > 0, header_rows(rows)).otherwise(0))
    df = df.withColumn(f"__{s}_shares", F.coalesce(F.transform(f"{s}.widths", lambda x: x / total), no_widths) if total is not None else no_widths)
    width = F.coalesce(F.size(F.get(rows, 0)), F.lit(0))
    df = df.withColumn(f"__{s}_head", F.when((F.size(rows) > 0) & (width > 0), flat_header(rows, depth)).otherwise(F.array().cast("array<string>")))
    sig = signature(head)
    body = F.slice(rows, depth + 1, F.greatest(F.size(rows), F.lit(1)))
    found = F.struct(
        F.col(f"{s}.page").alias("page"), *[F.col(f"{s}.{c}").alias(c) for c in ("box",) if c in names], depth.alias("depth"), width.alias("width"), F.size(body).alias("body"),
        data_patterns(body).alias("patterns"), shares.alias("shares"), F.slice(rows, 1, 3).alias("top"),
        F.struct(sig["n"].alias("n"), sig["names"].alias("names"), sig["print"].alias("print"), shares.alias("widths")).alias("signature"),
    )
    return df.withColumn(s, F.when(F.col(s).isNotNull(), found)).drop(*[f"__{s}_{c}" for c in ("rows", "depth", "head", "shares")])


#: The weights of the parts of a continuity score.
CONTINUITY = {"columns": 0.30, "header": 0.25, "position": 0.20, "pattern": 0.15, "repeated": 0.10}


def continuity(pairs: DataFrame, a: str, b: str, height: str | None = None, least_columns: float = 0.85, accept: float = 0.70, gaps: int = 1, tolerance: float = 0.15) -> DataFrame:
    """``pairs`` with a struct ``continuity``: gap, columns, header, repeated, position, pattern, score, accepted, and depth (header rows of ``a``).

    a, b: structs with ``page`` and ``rows``, and where known ``widths`` (array<double>) and ``box`` (array<double>: left, top, right, bottom).
    columns: the fewer over the more, with widths 0.6 of that and 0.4 their likeness. header: ``signature_score``. repeated: ``b`` begins with a
    header row of ``a``. position: 0.4 for an end in the page's last 0.15, 0.4 for a beginning in its first 0.15, 0.2 by the horizontal overlap; 0.5
    if unknown. pattern: the mean over columns of 1 (same kind and share), 0.7 (same kind), 0; 0.5 without data. The sum is taken times 0.9 for every
    page after the first; over ``gaps`` + 1 pages it is 0. Accepted, with columns of ``least_columns``: a score of ``accept``; of 0.85 of it with a repeated header, or on the next
    page with columns of 0.95 and pattern of 0.5. Null rows and tables without rows or columns are never accepted.
    """
    f = lambda s, c: F.col(f"{s}.{c}")
    has = lambda c: all(c in pairs.schema[s].dataType.names for s in (a, b))
    for s in (a, b):
        if "signature" not in pairs.schema[s].dataType.names:
            pairs = with_features(pairs, s)
    side = lambda name: {s: f(s, name) for s in (a, b)}
    depth, width, shares = map(side, ("depth", "width", "shares"))
    pairs = signature_score(pairs.withColumns({f"__{s}_sig": f(s, "signature") for s in (a, b)}), f"__{a}_sig", f"__{b}_sig", "__header", tolerance).drop(f"__{a}_sig", f"__{b}_sig")

    columns = F.least(width[a], width[b]) / F.greatest(width[a], width[b], F.lit(1))
    near = F.zip_with(F.slice(shares[a], 1, F.size(shares[b])), F.slice(shares[b], 1, F.size(shares[a])), lambda x, y: F.greatest(F.lit(0.0), 1 - F.abs(x - y) / tolerance))
    likeness = F.aggregate(near, F.lit(0.0), lambda n, x: n + x) / F.size(near)
    columns = F.when((F.size(shares[a]) > 0) & (F.size(shares[b]) > 0) & (columns > 0), 0.6 * columns + 0.4 * likeness).otherwise(columns)

    position = position_score(f(a, "box"), f(b, "box"), F.col(height)) if height and has("box") else F.lit(0.5)

    alike = F.zip_with(f(a, "patterns"), f(b, "patterns"), lambda x, y: F.when(x == y, 1.0).when(x["kind"] == y["kind"], 0.7).when(x.isNotNull() & y.isNotNull(), 0.0))
    pairs = pairs.withColumn("__alike", F.array_compact(alike))
    both = F.col("__alike")
    pattern = F.when((f(a, "body") == 0) | (f(b, "body") == 0), 0.5).when(F.size(both) == 0, 0.0).otherwise(F.aggregate(both, F.lit(0.0), lambda n, x: n + x) / F.size(both))

    parts = F.struct(
        F.abs(f(b, "page") - f(a, "page")).alias("gap"), columns.alias("columns"), F.col("__header").alias("header"),
        repeats_header(F.slice(f(a, "top"), 1, depth[a]), f(b, "top")).alias("repeated"), position.alias("position"), pattern.alias("pattern"), depth[a].alias("depth"),
    )
    pairs = pairs.withColumn("__parts", parts)
    c = lambda name: F.col(f"__parts.{name}")
    total = sum((w * c(name).cast("double") for name, w in CONTINUITY.items()), F.lit(0.0)) * F.pow(F.lit(0.9), F.greatest(c("gap") - 1, F.lit(0)))
    score = F.when(c("gap") <= gaps + 1, total).otherwise(0.0)
    pairs = pairs.withColumn("__score", score)
    lowered = c("repeated") | ((c("columns") >= 0.95) & (c("pattern") >= 0.5) & (c("gap") == 1))
    fits = (c("columns") >= least_columns) & ((F.col("__score") >= accept) | (lowered & (F.col("__score") >= 0.85 * accept)))
    fields = [c(n).alias(n) for n in ("gap", "columns", "header", "repeated", "position", "pattern", "depth")]
    return pairs.withColumn("continuity", F.struct(*fields, F.col("__score").alias("score"), F.coalesce(fits, F.lit(False)).alias("accepted"))).drop("__parts", "__score", "__header", "__alike")


def merged_across_pages(tables: DataFrame, doc: str = "doc_id", page: str = "page_num", index: str = "table_index", rows: str = "rows", accept: float = 0.70) -> DataFrame:
    """Tables that go on over pages as one: doc, chain, first_page, parts, rows, removed_headers.

    A table continues the one before, in page order, if their ``continuity`` is accepted. Of those that continue, rows that repeat the first table's
    header are dropped, at the start and inside. Columns ``widths``, ``box`` and ``height`` count where ``tables`` has them.
    """
    w = Window.partitionBy(doc).orderBy(page, index)
    extra = [F.col(c) for c in ("widths", "box") if c in tables.columns]
    t = with_features(tables.withColumn("__own", F.struct(F.col(page).alias("page"), F.col(rows).alias("rows"), *extra)), "__own")  # once for each table
    t = t.withColumn("__before", F.lag("__own").over(w))
    t = continuity(t, "__before", "__own", "height" if "height" in tables.columns else None, accept=accept)
    t = islands(t, [doc], [page, index], F.coalesce(F.col("__before").isNotNull() & F.col("continuity.accepted"), F.lit(False)))
    no_rows = F.array().cast("array<array<string>>")
    own = F.coalesce(F.col(rows), no_rows)
    chain = Window.partitionBy(doc, "chain").orderBy(page, index)
    t = t.select(doc, "chain", page, index, own.alias("__rows"), F.first(F.when(F.size(own) > 0, F.slice(own, 1, header_rows(own))).otherwise(no_rows)).over(chain).alias("__head"), F.row_number().over(chain).alias("__part"))
    t = without_duplicate_headers(t, "__rows", "__head", F.col("__part") == 1)
    parts = F.array_sort(F.collect_list(F.struct("__part", "__rows")))
    merged = t.groupBy(doc, "chain").agg(F.min(page).alias("first_page"), F.count("*").cast("int").alias("parts"), F.flatten(F.transform(parts, lambda x: x["__rows"])).alias("rows"), F.sum("removed_headers").cast("int").alias("removed_headers"))
    return merged.select(doc, "chain", "first_page", "parts", "rows", "removed_headers")


def separators(cells: DataFrame, sheet: str, row: str, column: str, text: str, first_rows: int = 20, empty: float = 0.9) -> DataFrame:
    """Spans of columns that are tables: columns ``empty`` or more empty in the first rows separate them. sheet, span, first, last."""
    near = cells.where(F.col(row) < first_rows)
    share = near.groupBy(sheet, column).agg(F.avg((F.trim(F.coalesce(text, F.lit(""))) == "").cast("int")).alias("__empty"))
    solid = islands(share.withColumn("__sep", F.col("__empty") >= empty), [sheet], [column], ~F.col("__sep") & ~F.lag("__sep", 1, True).over(Window.partitionBy(sheet).orderBy(column)), "__span")
    spans = solid.where(~F.col("__sep")).groupBy(sheet, "__span").agg(F.min(column).alias("first"), F.max(column).alias("last"))
    return spans.withColumn("span", F.row_number().over(Window.partitionBy(sheet).orderBy("first"))).drop("__span")


def records(names: Column, row: Column) -> Column:
    """map of name to value; whole floats as integers."""
    tidy = lambda c: F.regexp_replace(c, r"^(-?[0-9]+)\.0+$", "$1")
    return F.map_from_arrays(names, F.transform(F.slice(row, 1, F.size(names)), tidy))


def mapped(headers: Column, row: Column, fields: dict[str, list[str]]) -> dict[str, Column]:
    """For each field the cell under the first header that has one of its words; null if none has."""

    def cell(words: list[str]) -> Column:
        hit = F.transform(headers, lambda h: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(h), w)))
        return F.get(row, F.nullif(F.array_position(hit, F.lit(True)), F.lit(0)).cast("int") - 1)

    return {name: cell(words) for name, words in fields.items()}


def hierarchy_paths(rows: Column, sep: str = " > ") -> Column:
    """The path of each row of an indented table: leading empty cells are its depth."""
    depth = lambda r: F.size(r) - F.size(F.filter(F.transform(r, lambda c, i: F.exists(F.slice(r, 1, i + 1), lambda x: x != "")), lambda b: b))
    stacks = F.aggregate(rows, F.array().cast("array<array<string>>"), lambda acc, r: F.concat(acc, F.array(F.concat(F.slice(F.when(F.size(acc) > 0, F.element_at(F.when(F.size(acc) > 0, acc).otherwise(F.array(r)), -1)).otherwise(F.array().cast("array<string>")), 1, depth(r)), F.array(F.coalesce(F.get(r, depth(r)), F.lit("")))))))
    return F.transform(stacks, lambda s: F.array_join(s, sep))


def normalized(rows: Column, policy: str = "inherit") -> Column:
    """A piped table of rows of cells: rows of one width, header rows as one, empty cells filled. Null where there are no rows."""

    def table(even: Column) -> Column:
        head = lambda n: F.concat(F.array(flat_header(even, n)), filled(F.slice(even, n + 1, F.size(even)), policy))
        return _let(_let(header_rows(even), head), to_markdown)

    even = lambda x: _let(F.array_max(F.transform(x, lambda r: F.size(r))), lambda width: padded(x, width))
    return _let(rows, lambda x: F.when(F.size(x) > 0, _let(even(x), table)))


def normalized_tables(texts: DataFrame, key: str, text: str, policy: str = "inherit") -> DataFrame:
    """key, table_index, header, markdown of every piped table inside a text, tagged or not."""

    @F.pandas_udf("array<string>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([[s[t.start : t.end] for t in detected_tables(s) if t.kind == "piped"] for s in (y or "" for y in x)])

    each = texts.select(key, F.posexplode(found(text)).alias("table_index", "__t")).withColumn("__rows", parse_markdown(F.col("__t"))).where(F.size("__rows") > 0)
    each = each.withColumn("__rows", padded(F.col("__rows"), F.array_max(F.transform("__rows", lambda r: F.size(r)))))
    return each.select(key, "table_index", flat_header(F.col("__rows"), header_rows(F.col("__rows"))).alias("header"), normalized(F.col("__rows"), policy).alias("markdown"))


def normalized_texts(texts: DataFrame, text: str, policy: str = "inherit", out: str = "normalized") -> DataFrame:
    """``texts`` with every tagged piped table in the text written anew, after its tag and an empty line; all else stays as it is. Null stays null."""

    @F.pandas_udf("array<struct<before:string,piped:string>>")
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([None if s is None else tagged_parts(s) for s in x])

    rows = lambda p: parse_markdown(p["piped"])
    each = F.transform("__parts", lambda p: F.concat(p["before"], F.coalesce(normalized(rows(p), policy), p["piped"])))
    return texts.withColumn("__parts", parts(text)).withColumn(out, F.array_join(each, "")).drop("__parts")
