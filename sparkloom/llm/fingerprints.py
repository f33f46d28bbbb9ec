"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections, in DataFrame expressions alone.

Leaves are runs of at most ``LEAF`` characters within a line; a paragraph is a line; a section is a run of paragraphs that
ends at a paragraph whose hash is 0 modulo ``SECTION`` or at the document's end, so that inserting or deleting a
paragraph changes only the section around it. Each node hashes its children's hashes in order.

Each hash is an md5. The tree is kept as text, ``root;section;section...``, where a section is ``hash:paragraph,paragraph...``
and a paragraph is its leaves' hashes, joined by dots; all but the root are cut to 8 hex digits there. Equal texts give equal fingerprints; differing roots say that texts differ, and
the sections whose hashes differ say where. Likeness is the share of leaves that two trees have in common.

Edge cases: null and empty texts have the tree of no leaves (all alike: likeness 1; with any other text 0); equal ids
order by a hash of the text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAF, SECTION, HEX = 48, 8, 8


def fingerprint(text: Column, leaf: int = LEAF, section: int = SECTION) -> Column:
    """The text's Merkle tree as a string, see the module's text."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    short = lambda h: F.substring(h, 1, HEX)

    def paragraph(line: Column) -> Column:
        hashes = F.transform(F.regexp_extract_all(line, F.lit(rf"(?s).{{1,{leaf}}}"), 0), lambda x: F.md5(x))
        return _with(hashes, lambda hs: F.struct(F.array_join(F.transform(hs, short), ".").alias("leaves"), F.md5(F.array_join(hs, "")).alias("h")))

    def sections(ps: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(ps)), lambda i: (i == F.size(ps)) | (F.conv(short(F.element_at(ps, i)["h"]), 16, 10).cast("long") % section == 0))
        start = lambda es, j: F.when(j > 0, F.get(es, j - 1)).otherwise(0)
        return _with(ends, lambda es: F.transform(es, lambda e, j: F.slice(ps, start(es, j) + 1, e - start(es, j))))

    def render(ss: Column) -> Column:
        hashed = F.transform(ss, lambda s: F.struct(F.md5(F.array_join(F.transform(s, lambda n: n["h"]), "")).alias("h"), F.array_join(F.transform(s, lambda n: n["leaves"]), ",").alias("body")))
        return _with(hashed, lambda hs: F.concat(F.md5(F.array_join(F.transform(hs, lambda s: s["h"]), "")), F.lit(";"), F.array_join(F.transform(hs, lambda s: F.concat(short(s["h"]), F.lit(":"), s["body"])), ";")))

    return _with(F.transform(lines, paragraph), lambda ps: _with(sections(ps), render))


def _with(x: Column, f) -> Column:
    """f(x), with x evaluated once."""
    return F.transform(F.array(x), f)[0]


def root(fp: Column) -> Column:
    return F.substring_index(fp, ";", 1)


def leaves(fp: Column) -> Column:
    """array<string>: the distinct leaves of a fingerprint."""
    parts = F.split(fp, rf";[0-9a-f]{{{HEX}}}:|[.,]")
    return F.array_distinct(F.filter(F.slice(parts, 2, F.size(parts)), lambda x: x != ""))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 if the roots are equal, else twice the shared leaves over both trees' leaves (without repeats)."""
    shared = lambda t: F.coalesce(2.0 * F.size(F.array_intersect(t["a"], t["b"])) / F.nullif(F.size(t["a"]) + F.size(t["b"]), F.lit(0)), F.lit(0.0))
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(_with(F.struct(leaves(a).alias("a"), leaves(b).alias("b")), shared))


def changed_sections(a: Column, b: Column) -> Column:
    """array<int>: the sections of ``a`` (from 0) whose hash is in no section of ``b``: the branches to follow to an edit."""
    hashes = lambda fp: F.transform(F.slice(F.split(fp, ";"), 2, F.size(F.split(fp, ";")) - 1), lambda s: F.substring_index(s, ":", 1))
    return _with(F.struct(hashes(a).alias("a"), hashes(b).alias("b")), lambda t: F.filter(F.transform(t["a"], lambda h, i: F.when(~F.array_contains(t["b"], h), i)), lambda i: i.isNotNull()))


def _ranges(rows: DataFrame, key: str, tie: str, ranges: int) -> DataFrame:
    """``rows`` with ``__range``, an array of numbers: a range of the order by descending key (null last), then ``tie`` (a long hash).

    Quantiles of the keys cut coarse ranges, quantiles within these the fine ones (so that neither step needs many). A key that spans several
    ranges, and rows without a key, are cut by ``tie``. What goes to all tasks is one number a range.
    """
    coarse = max(1, round(ranges**0.5))
    fine = -(-ranges // coarse)
    above = lambda cuts, k: F.size(F.filter(cuts, lambda c: c >= k))
    steps = lambda n: [i / n for i in range(1, n)]
    found = sorted(set(rows.approxQuantile(key, steps(coarse), 0.1 / coarse))) if coarse > 1 else []
    first = above(F.array(*map(F.lit, found)), F.col(key)) if found else F.lit(0)
    rows = rows.withColumn("__coarse", F.when(F.col(key).isNotNull(), first).cast("int"))
    if fine > 1:
        each = rows.where(F.col(key).isNotNull()).groupBy("__coarse").agg(F.percentile_approx(key, steps(fine), 20 * fine).alias("cuts"))
        rows = rows.crossJoin(F.broadcast(each.agg(F.map_from_entries(F.collect_list(F.struct("__coarse", "cuts"))).alias("__cuts"))))
        cuts = F.col("__cuts")[F.col("__coarse")]
        rows = rows.withColumn("__fine", above(cuts, F.col(key))).withColumn("__hot", F.size(F.filter(cuts, lambda c: c == F.col(key))) > 1).drop("__cuts")
    else:
        rows = rows.withColumn("__fine", F.lit(0)).withColumn("__hot", F.lit(False))
    part = F.floor((F.col(tie) / F.lit(2.0**64) + F.lit(0.5)) * ranges)  # a hot key is the first of its range
    by_tie = F.when(F.coalesce("__hot", F.col(key).isNull()), part).otherwise(F.lit(ranges))
    number = F.array(F.coalesce("__coarse", F.lit(coarse)).cast("long"), F.coalesce("__fine", F.lit(0)).cast("long"), by_tie.cast("long"))
    return rows.withColumn("__range", number).drop("__coarse", "__fine", "__hot")


def with_next(rows: DataFrame, key: str, text: str, ranges: int, add) -> DataFrame:
    """``add(rows)`` with ``__next``, a struct of all its columns of the row that follows by descending key (after the last: the first).

    Rows (columns ``key``, numeric, and ``text``) are dealt by ranges, and each range is a window of its own. The first row of a range is also put
    at the end of the range before it, so that it follows there too. Null keys come last; equal keys order by a hash of the text.
    """
    dealt = _ranges(rows.withColumn("__tie", F.xxhash64(text)), key, "__tie", ranges)
    # The first row of each range, by key and tie alone, and the range before it.
    heads = dealt.groupBy("__range").agg(F.max(F.struct(F.col(key), F.bitwise_not("__tie").alias("t"))).alias("h"))
    whole = Window.orderBy("__range")
    last = F.last("__range").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.col("h")[key].alias("__head"), F.bitwise_not(F.col("h")["t"]).alias("__head_tie"), F.col("__range").alias("__own"), F.coalesce(F.lag("__range").over(whole), last).alias("__to"))
    dealt = dealt.select(key, text, "__tie", "__range")
    at_head = dealt.join(F.broadcast(heads), (F.col("__range") == F.col("__own")) & F.col(key).eqNullSafe(F.col("__head")) & (F.col("__tie") == F.col("__head_tie")))
    one = at_head.groupBy("__own").agg(F.first("__to").alias("__range"), F.min(F.struct(key, text, "__tie")).alias("r")).select("r.*", "__range")
    both = add(dealt.withColumn("__added", F.lit(0)).union(one.withColumn("__added", F.lit(1))))
    columns = [c for c in both.columns if c not in ("__tie", "__range", "__added")]
    within = Window.partitionBy("__range").orderBy("__added", F.col(key).desc_nulls_last(), "__tie", text)
    both = both.repartition(-(-ranges // 2), "__range")  # so that tasks grow in number, not in size
    return both.withColumn("__next", F.lead(F.struct(*columns)).over(within)).where("__added = 0").select(*columns, "__next")


def fingerprint_table(docs: DataFrame, id_col="doc_id", text_col="text", ranges: int | None = None, range_bytes: int = 32 << 20) -> DataFrame:
    """Fingerprints of every text and of its edited text: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Edited: the last floor(n_chars / 3) characters give way to the first as many of the next document, by descending id (a number). ``ranges``:
    windows that the documents are dealt to; one for each ``range_bytes`` of text if not given, and twice as many as shuffle partitions at least.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if ranges is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        ranges = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    rows = with_next(rows, "doc_id", "text", ranges, lambda df: df.withColumn("fingerprint", fingerprint(F.col("text"))))
    rows = rows.select("doc_id", "text", "fingerprint", F.col("__next.text").alias("next_text"), F.col("__next.fingerprint").alias("next_fingerprint"))
    n, cut = F.char_length("text"), F.floor(F.char_length("text") / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut)))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
