"""Web pages: metadata, lists and tables by native expressions. Tags in any case, attributes in any order, quoted either way or not at all.

Null pages give nulls (empty arrays for lists and tables). Lists inside lists are read with the outer one's first end; no page is parsed as a tree here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute inside a tag's text, or null."""
    pattern = rf"(?is)[\s\"']{name}{_VALUE}"
    return F.when(tag.rlike(pattern), F.concat(*[F.coalesce(F.regexp_extract(tag, pattern, i), F.lit("")) for i in (1, 2, 3)]))


#: Character references that pages use most; ``&amp;`` last, so that none is read twice.
REFERENCES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")]


def plain(html: Column) -> Column:
    """Text without tags, the commonest character references decoded, trimmed."""
    found = F.regexp_replace(html, "(?s)<[^>]*>", "")
    for name, c in REFERENCES:
        found = F.replace(found, F.lit(name), F.lit(c))
    return F.regexp_replace(found, r"^\s+|\s+$", "")


def tags(html: Column, name: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))


def elements(html: Column, name: str) -> Column:
    """The elements of a name, each up to its first end tag."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>"), F.lit(0))


def metadata(html: Column) -> Column:
    """struct<title, language, description, keywords, author>; of several metas of a name the last that has content; null where there is none."""
    metas = tags(html, "meta")

    def meta(name: str) -> Column:
        named = F.filter(metas, lambda t: (F.lower(attribute(t, "name")) == name) & (attribute(t, "content") != ""))
        return F.when(F.size(named) > 0, attribute(F.get(named, F.size(named) - 1), "content"))

    title, page = F.get(elements(html, "title"), 0), F.get(tags(html, "html"), 0)
    return F.struct(plain(title).alias("title"), attribute(page, "lang").alias("language"), *[meta(n).alias(n) for n in ("description", "keywords", "author")])


def lists(html: Column) -> Column:
    """array<string>: each list, a line for each item that isn't empty: ``• item``, or its number in an ordered list."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<ul\b[^>]*>.*?</ul\s*>|<ol\b[^>]*>.*?</ol\s*>"), F.lit(0))

    def lines(x: Column) -> Column:
        item = lambda t, i: F.when(plain(t) != "", F.concat(F.when(x.rlike(r"(?i)^<ol\b"), F.concat((i + 1).cast("string"), F.lit(". "))).otherwise("• "), plain(t)))
        return F.array_join(F.transform(elements(x, "li"), item), "\n")

    return F.coalesce(F.transform(found, lines), F.array().cast("array<string>"))


def tables(html: Column) -> Column:
    """array<string>: each table, its cells joined by `` | ``, a line for each row that has text."""
    cells = lambda row: F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]\s*>"), F.lit(1)), plain)
    line = lambda row: F.when(F.exists(cells(row), lambda c: c != ""), F.array_join(cells(row), " | "))
    found = F.transform(elements(html, "table"), lambda t: F.array_join(F.transform(elements(t, "tr"), line), "\n"))
    return F.coalesce(found, F.array().cast("array<string>"))
