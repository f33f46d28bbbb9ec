"""Joins of a catalog: lookups, latest rows, trees by code prefixes, keyword hits, record linkage.

Theta joins are written as equi-joins on derived keys with a filter after; sides that are broadcast are dimensions whose size the
caller knows, and Spark is left to choose elsewhere.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.keywords import keyword_hits


def prefix_join(left: DataFrame, right: DataFrame, code: str, prefix: str) -> DataFrame:
    """Rows of ``left`` with each row of ``right`` whose ``prefix`` is the whole ``code`` or begins it.

    The code is exploded into its prefixes of the lengths that occur, which then join by equality: no nested loop. What all tasks get is the one
    row of those lengths, at most as many as the longest prefix has characters.
    """
    lengths = right.where(F.length(prefix) > 0).agg(F.array_sort(F.collect_set(F.length(prefix))).alias("__lengths"))
    cut = F.array_distinct(F.transform("__lengths", lambda n: F.substr(F.col(code), F.lit(1), n)))
    keyed = left.crossJoin(F.broadcast(lengths)).withColumn("__prefix", F.explode(cut)).drop("__lengths")
    return keyed.join(right, keyed["__prefix"] == right[prefix]).drop("__prefix")


def number_prefixes(ranges: Column, pattern: str = "(?i)[IC]-[A-Z0-9]+") -> Column:
    """What ranges of management numbers begin with: the numbers in a text without their last digits, each once."""
    return F.array_distinct(F.transform(F.regexp_extract_all(ranges, F.lit(pattern), 0), lambda r: F.regexp_replace(r, "[0-9]+$", "")))


def by_number_range(facilities: DataFrame, units: DataFrame, number: str, ranges: str) -> DataFrame:
    """Each facility with each unit in whose ranges is a prefix that the facility's number contains, once.

    The prefixes are a dictionary that one automaton looks for in each number; facilities and units then meet by equality.
    """
    keyed = units.withColumn("__prefix", F.explode(number_prefixes(F.col(ranges))))
    known = keyed.select("__prefix").distinct()
    met = keyword_hits(facilities, number, known, "__prefix", fold=False)
    columns = [*facilities.columns, *units.columns]
    return met.join(keyed, "__prefix").select(*columns).distinct()


def tree(major: DataFrame, unit: DataFrame, leaf: DataFrame, major_key: str, unit_key: str, unit_parent: str, leaf_parent: str, leaf_name: str, major_name: str, unit_name: str) -> DataFrame:
    """major, units: array<struct<unit, leaves: array<string>>>; sorted, majors and units without children too."""
    leaves = leaf.select(leaf_parent, leaf_name).groupBy(F.col(leaf_parent).alias("__u")).agg(F.array_sort(F.collect_list(leaf_name)).alias("leaves"))
    units = unit.join(leaves, unit[unit_key] == leaves["__u"], "left").withColumn("leaves", F.coalesce("leaves", F.array().cast("array<string>")))
    grouped = units.groupBy(F.col(unit_parent).alias("__m")).agg(F.array_sort(F.collect_list(F.struct(F.col(unit_name).alias("unit"), "leaves"))).alias("units"))
    return major.join(grouped, major[major_key] == grouped["__m"], "left").select(F.col(major_name).alias("major"), "units")


def status_ladder(enabled: Column, running: Column, last_failed: Column, partial: Column, documents: Column) -> Column:
    """disabled > running > error > warning > active > never."""
    return F.when(~enabled, "disabled").when(running, "running").when(last_failed, "error").when(partial, "warning").when(documents > 0, "active").otherwise("never")


def latest_target(schedules: DataFrame, targets: str, schedule: str, pos: str) -> DataFrame:
    """Each target with its schedule; of several, the later one."""
    return schedules.select(F.explode(targets).alias("target"), schedule, pos).groupBy("target").agg(F.max_by(schedule, F.struct(pos, schedule)).alias("schedule"), F.count("*").alias("schedules"))


def file_stem(name: Column, n: int = 30) -> Column:
    """The first ``n`` characters of a file name, characters that paths can't have as ``_``."""
    return F.substring(F.regexp_replace(name, r'[\\\\/:*?"<>|]', "_"), 1, n)


def attached_files(attachments: DataFrame, files: DataFrame, name: str, path: str, longest: int = 255) -> DataFrame:
    """``attachments`` with the first file, by path, whose name contains the stem of theirs (column ``file``); null if none does or the stem is empty.

    Stems meet file names by their first 1, 2, 4, 8 or 16 characters, the most they have, at any place of the name, so both sides join by equality; then the
    whole stem is looked for. Only file names of up to ``longest`` characters are cut up, which is all that file systems allow; a longer one raises. Null paths are no files.
    """
    stem = file_stem(F.col(name))
    size = lambda n: F.when(n >= 16, 16).when(n >= 8, 8).when(n >= 4, 4).when(n >= 2, 2).otherwise(1)
    asked = attachments.select(F.col(name).alias("__name"), stem.alias("__stem")).where("__stem != ''").distinct()
    asked = asked.withColumn("__key", F.substr("__stem", F.lit(1), size(F.char_length("__stem"))))
    own = F.regexp_extract(path, r"([^/\\]*)$", 1)
    named = files.select(F.col(path).alias("__path"), own.alias("__own")).where(F.col(path).isNotNull()).distinct()
    named = named.withColumn("__own", F.when(F.char_length("__own") > longest, F.raise_error(F.lit("a file name is too long"))).otherwise(F.col("__own")))
    cuts = F.flatten(F.transform(F.array(*map(F.lit, (1, 2, 4, 8, 16))), lambda g: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("__own") - g + 1, F.lit(1))), lambda i: F.substr(F.col("__own"), i, g))))
    wanted = asked.select("__key").distinct()
    pieces = named.withColumn("__key", F.explode(F.array_distinct(cuts))).join(wanted, "__key", "left_semi")
    found = asked.join(pieces, "__key").where(F.contains("__own", "__stem")).groupBy("__name").agg(F.min("__path").alias("file"))
    return attachments.join(found, attachments[name].eqNullSafe(found["__name"]), "left").drop("__name")


def linked(left: DataFrame, right: DataFrame, blocks: list[tuple[Column, Column]], score: Column, left_id: str, right_id: str, at_least: float) -> DataFrame:
    """Pairs that share a blocking key, scored once each, and of every left row the best of at least ``at_least``.

    blocks: (key of the left side, key of the right side). Null keys block nothing.
    """
    found = []
    for a, b in blocks:
        x, y = left.select(left_id, a.alias("__k")).where("__k is not null").distinct(), right.select(right_id, b.alias("__k")).where("__k is not null").distinct()
        found.append(x.join(y, "__k").select(left_id, right_id))
    pairs = reduce(DataFrame.union, found).distinct()
    scored = pairs.join(left, left_id).join(right, right_id).withColumn("score", score).where(F.col("score") >= at_least)
    best = Window.partitionBy(left_id).orderBy(F.desc("score"), F.col(right_id))
    return scored.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")


def agreements(left: DataFrame, right: DataFrame, points: dict[str, tuple[Column, Column, int]], blocks: list[tuple[str, ...]], left_id: str, right_id: str, at_least: int) -> DataFrame:
    """left_id, right_id, score: for each left row the first right row of every set of parts in which both agree.

    A row for each set of parts that holds a block and is worth ``at_least``, at most. Right rows are reduced to the first of each class of equal
    parts before they are joined, so that pairs grow with the left rows, not with the square of a hot key.
    """
    found = []
    for chosen in (c for n in range(1, len(points) + 1) for c in combinations(points, n)):
        worth = sum(points[c][2] for c in chosen)
        if worth < at_least or not any(set(b) <= set(chosen) for b in blocks):
            continue
        keys = [f"__{i}" for i in range(len(chosen))]
        a = left.select(left_id, *[points[c][0].alias(k) for c, k in zip(chosen, keys, strict=True)])
        b = right.select(right_id, *[points[c][1].alias(k) for c, k in zip(chosen, keys, strict=True)])
        first = b.na.drop("any", subset=keys).groupBy(*keys).agg(F.min(right_id).alias(right_id))
        found.append(a.join(first, keys).select(left_id, right_id, F.lit(worth).alias("score")))
    return reduce(DataFrame.unionByName, found)


def linked_by_agreement(left: DataFrame, right: DataFrame, points: dict[str, tuple[Column, Column, int]], blocks: list[tuple[str, ...]], left_id: str, right_id: str, at_least: int) -> DataFrame:
    """``linked`` where a score is a sum of positive ``points`` for parts that agree: left_id, right_id, score of the same best pairs.

    points: (part of the left side, of the right side, what agreement is worth). blocks: parts of which one set must agree. Nulls agree with
    nothing. Ids are unique. The best pair is the first of the class of right rows that agree in just its parts: rows of that class that agree
    in more would be better.
    """
    best = Window.partitionBy(left_id).orderBy(F.desc("score"), F.col(right_id))
    found = agreements(left, right, points, blocks, left_id, right_id, at_least)
    return found.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")
