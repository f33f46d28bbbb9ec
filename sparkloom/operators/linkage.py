"""Record linkage of described endpoints: score, enrichment of the left rows, right rows that nothing matches.

A pair scores 100 for equal paths, 80 for equal base names of paths, 50 for equal targets, 40 for equal names, 20 if a name holds the
other, and 10 for each keyword that both names hold. All rows of a hot base name would pair with each other; but points add up, so a
right row can be stood for by the first row that agrees in as much. Right rows are therefore reduced to the first of each class, a class
being a combination of path, base name and target with the set of keywords or with the name; a left row meets a bounded number of
classes (at most 64 sets of keywords for each of six combinations, and six for each name that holds its name or is held by it), so pairs
grow with the rows, and the best pair is the same as over all pairs. Names that hold each other are found by equal pieces of theirs, and
only where the pair shares a keyword, a base name or a target: without these it can't reach any limit.

Nulls agree with nothing, an empty target or name neither; base names of non-empty paths may be empty and then agree. Of equal scores the
first right row in order counts. Orders must be different and not null.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.staging import staged

#: Words of names that count, and what agreement is worth.
KEYWORDS = ("법령", "판례", "행정규칙", "행정심판", "본문", "목록")
PATH, BASE, TARGET, NAME, HELD, WORD = 100, 80, 50, 40, 20, 10
#: Combinations in which right rows are told apart; a base name follows from its path.
_KINDS = ((), ("path",), ("base",), ("target",), ("path", "target"), ("base", "target"))
_PIECES = (1, 2, 4, 8, 16)


def base_name(path: Column, suffix: str = ".do") -> Column:
    """What follows the last slash, without the first ``suffix``; null for an empty path."""
    last = F.element_at(F.split(path, "/", -1), -1)
    at = F.locate(suffix, last)
    return F.when(F.length(path) > 0, F.when(at > 0, F.concat(F.substr(last, F.lit(1), at - 1), F.substr(last, at + len(suffix)))).otherwise(last))


@dataclass(frozen=True)
class Linkage:
    """Columns of both sides: ``order`` (long), ``path``, ``name``, and ``params``, a JSON text that has the target under ``target_path``."""

    order: str = "id"
    path: str = "path"
    name: str = "name"
    params: str = "fixed_params"
    target_path: str = "$.target"
    keywords: tuple[str, ...] = KEYWORDS

    def features(self, df: DataFrame) -> DataFrame:
        """id, path, base, target, name, low, mask: what is compared, one row for each row."""
        filled = lambda c: F.when(F.length(c) > 0, c)
        low = F.lower(filled(F.col(self.name)))
        mask = reduce(lambda a, b: a + b, [F.when(F.contains("low", F.lit(w)), 1 << i).otherwise(0) for i, w in enumerate(self.keywords)], F.lit(0))
        rows = df.select(
            F.col(self.order).alias("id"), filled(F.col(self.path)).alias("path"), base_name(F.col(self.path)).alias("base"),
            filled(F.get_json_object(self.params, self.target_path)).alias("target"), filled(F.col(self.name)).alias("name"), low.alias("low"),
        )
        return rows.withColumn("mask", F.coalesce(mask, F.lit(0)))


def _agree(c: str) -> Column:
    return F.coalesce(F.col(f"l_{c}") == F.col(f"r_{c}"), F.lit(False))


def score() -> Column:
    """The points of a pair with columns l_ and r_ of the features."""
    names = F.col("l_low").isNotNull() & F.col("r_low").isNotNull()
    held = names & (F.contains("l_low", F.col("r_low")) | F.contains("r_low", F.col("l_low")))
    points = [(_agree("path"), PATH), (_agree("base"), BASE), (_agree("target"), TARGET), (_agree("name"), NAME), (held, HELD)]
    out = F.bit_count(F.col("l_mask").bitwiseAND(F.col("r_mask"))) * WORD
    for met, n in points:
        out = out + F.when(met, n).otherwise(0)
    return out.cast("int")


def _named(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in df.columns])


def holding_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """l_low, r_low: different names of which one holds the other and that share a keyword, base name or target. Distinct."""
    pairs = None
    for long, short, names in ((left, right, ("l_low", "r_low")), (right, left, ("r_low", "l_low"))):
        a, b = (_featured(x).distinct() for x in (long, short))
        size = reduce(lambda out, g: F.when(F.char_length("low") >= g, g).otherwise(out), _PIECES, F.lit(0))
        b = b.withColumn("piece", F.substr("low", F.lit(1), size))
        sizes = F.array(*map(F.lit, _PIECES))
        cuts = F.flatten(F.transform(sizes, lambda g: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("low") - g + 1, F.lit(1))), lambda i: F.substr(F.col("low"), i, g))))
        wanted = b.select("feature", "piece").distinct()
        a = a.withColumn("piece", F.explode(F.array_distinct(cuts))).join(wanted, ["feature", "piece"], "left_semi")
        met = a.withColumnRenamed("low", "__long").join(b.withColumnRenamed("low", "__short"), ["feature", "piece"])
        found = met.where(F.contains("__long", F.col("__short")) & (F.col("__long") != F.col("__short"))).select(F.col("__long").alias(names[0]), F.col("__short").alias(names[1]))
        pairs = found if pairs is None else pairs.unionByName(found)
    return pairs.distinct()


def _bits(mask: Column) -> Column:
    """The positions of the bits that are set."""
    return F.filter(F.sequence(F.lit(0), F.lit(30)), lambda i: F.getbit(mask, i) == 1)


def _featured(df: DataFrame) -> DataFrame:
    """low, feature: a name with each thing that it can share."""
    words = F.transform(_bits(F.col("mask")), lambda i: F.concat(F.lit("w"), i.cast("string")))
    others = F.array_compact(F.array(F.concat(F.lit("b"), F.col("base")), F.concat(F.lit("t"), F.col("target"))))
    return df.where("low is not null").select("low", F.explode(F.concat(words, others)).alias("feature"))


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """l_id, r_id: for each left row the first right row of every class that it meets, ``left`` and ``right`` being features."""
    found = []
    related = staged(holding_names(left, right).unionByName(left.where("low is not null").select(F.col("low").alias("l_low"), F.col("low").alias("r_low")).distinct()), "names")
    for kind in _KINDS:
        keys = list(kind)
        whole = reduce(lambda a, c: a & F.col(c).isNotNull(), keys, F.lit(True))
        a, b = left.where(whole), right.where(whole)
        # By keywords: a class is what both sides agree in, with the set of the right row's keywords.
        by_mask = b.groupBy(*keys, F.col("mask").alias("r_mask")).agg(F.min("id").alias("r_id"))
        if keys:
            met = a.select(F.col("id").alias("l_id"), *keys).join(by_mask, keys)
        else:  # a keyword must be shared: at most 2^keywords rows, each with its keywords
            words = by_mask.select("r_id", F.explode(_bits(F.col("r_mask"))).alias("word"))
            met = a.select(F.col("id").alias("l_id"), F.explode(_bits(F.col("mask"))).alias("word")).join(F.broadcast(words), "word")
        found.append(met.select("l_id", "r_id"))
        # By name: the right row's name is the left one's, or one holds the other.
        by_name = b.where("low is not null").groupBy(*keys, F.col("low").alias("r_low"), F.col("name").alias("r_name")).agg(F.min("id").alias("r_id"))
        named = a.where("low is not null").select(F.col("id").alias("l_id"), *keys, F.col("low").alias("l_low")).join(related, "l_low")
        found.append(named.join(by_name, [*keys, "r_low"]).select("l_id", "r_id"))
    return reduce(DataFrame.unionByName, found).distinct()


def matches(left: DataFrame, right: DataFrame, at_least: int = 30) -> DataFrame:
    """l_id, r_id, score: of each left row the best right row of at least ``at_least`` points; features as they come from ``Linkage``."""
    if at_least <= HELD:
        raise ValueError("pairs that only hold each other's names aren't looked for")
    pairs = candidates(left, right).join(_named(left, "l"), "l_id").join(_named(right, "r"), "r_id").withColumn("score", score()).where(F.col("score") >= at_least)
    pairs = pairs.groupBy("l_id", "score").agg(F.min("r_id").alias("r_id"))  # of numbers alone, so rows aren't sorted; a left row has few scores
    return pairs.groupBy("l_id").agg(F.max_by(F.struct("r_id", "score"), F.struct("score", -F.col("r_id"))).alias("x")).select("l_id", "x.r_id", "x.score")


def _same_keys(df: DataFrame, keywords: int) -> DataFrame:
    """id, key: rows with an equal key score 50 or more with each other: base name, target, name, or five keywords."""
    fives = [m for m in range(1 << keywords) if m.bit_count() == 5]
    shared = F.filter(F.array(*map(F.lit, fives)).cast("array<int>"), lambda m: F.col("mask").bitwiseAND(m) == m)
    masks = F.transform(shared, lambda m: F.concat(F.lit("m"), m.cast("string")))
    keys = F.array_compact(F.array(F.concat(F.lit("b"), F.col("base")), F.concat(F.lit("t"), F.col("target")), F.concat(F.lit("n"), F.col("name"))))
    return df.select("id", F.explode(F.concat(keys, masks)).alias("key"))


def _strong_names(left: DataFrame, right: DataFrame, words: int = 3) -> DataFrame:
    """l_low, r_low: names that hold each other, different or not, and share enough keywords for 50 points."""
    pairs = holding_names(left, right).unionByName(left.where("low is not null").select(F.col("low").alias("l_low"), F.col("low").alias("r_low")).distinct())
    masks = [x.where("low is not null").select(F.col("low").alias(f"{s}_low"), F.col("mask").alias(f"{s}_mask")).distinct() for s, x in (("l", left), ("r", right))]
    return pairs.join(masks[0], "l_low").join(masks[1], "r_low").where(F.bit_count(F.col("l_mask").bitwiseAND(F.col("r_mask"))) >= words).select("l_low", "r_low").distinct()


def unmatched(left: DataFrame, right: DataFrame, keywords: int = len(KEYWORDS)) -> DataFrame:
    """id: right rows that score under 50 with every left row, and with every right row before them that is kept."""
    by_name = right.join(_strong_names(left, right).select(F.col("r_low").alias("low")).distinct(), "low", "left_semi").select("id")
    keys = staged(_same_keys(right, keywords), "keys")
    met = keys.join(_same_keys(left, keywords).select("key").distinct(), "key", "left_semi").select("id").unionByName(by_name).distinct()
    rest = staged(right.join(met, "id", "left_anti"), "unmatched")
    # Rows whose different names hold each other meet in a key of that pair of names.
    strong = staged(_strong_names(rest, rest).where("l_low <= r_low"), "strong")
    each = strong.select(F.explode(F.array("l_low", "r_low")).alias("low"), F.concat(F.lit("h"), F.col("l_low"), F.lit("\x00"), F.col("r_low")).alias("key")).distinct()
    keys = keys.join(rest.select("id"), "id", "left_semi").unionByName(rest.join(each, "low").select("id", "key"))
    return first_independent(rest.select("id"), keys)


def first_independent(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """id: the rows that stay if each, in order, goes that shares a key (id, key) with one that stayed before.

    In each round the rows that are first in all of their keys stay and what shares a key with them goes; the first of all is one of
    them, so rounds end. They are few unless rows hang together in long chains.
    """
    open_rows, kept = staged(rows, "open"), []
    while not open_rows.isEmpty():
        mine = keys.join(open_rows, "id", "left_semi")
        first = mine.groupBy("key").agg(F.min("id").alias("first"))
        later = mine.join(first, "key").where("id > first").select("id").distinct()
        stay = staged(open_rows.join(later, "id", "left_anti"), "kept")
        kept.append(stay)
        gone = mine.join(mine.join(stay, "id", "left_semi").select("key").distinct(), "key", "left_semi").select("id").distinct()
        open_rows = staged(open_rows.join(gone, "id", "left_anti").join(stay, "id", "left_anti"), "open")
    return reduce(DataFrame.unionByName, kept) if kept else rows.where(F.lit(False))


def merged(left: DataFrame, right: DataFrame, by: Linkage | None = None, arrays: tuple[str, ...] = ("request_params", "response_fields"), texts: tuple[str, ...] = ("path", "fixed_params", "variable_params")) -> DataFrame:
    """Left rows, what is null or empty in them filled from their match; then right rows that match nothing. Adds matched (the right row's
    order, null without one), score and appended. Both sides have the same columns; orders of appended rows are the right side's."""
    by = by or Linkage()
    a, b = staged(by.features(left), "left"), staged(by.features(right), "right")
    best = staged(matches(a, b), "matches")
    given = right.select(F.col(by.order).alias("r_id"), *[F.col(c).alias(f"__{c}") for c in (*arrays, *texts)])
    rows = left.join(best.withColumnRenamed("l_id", by.order), by.order, "left").join(given, "r_id", "left")
    for c in arrays:
        rows = rows.withColumn(c, F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.col(c)).otherwise(F.coalesce(f"__{c}", F.col(c))))
    for c in texts:
        rows = rows.withColumn(c, F.when(F.length(c) > 0, F.col(c)).otherwise(F.coalesce(f"__{c}", F.col(c))))
    rows = rows.select(*left.columns, F.col("r_id").alias("matched"), "score", F.lit(False).alias("appended"))
    rest = unmatched(staged(by.features(rows), "enriched"), b, len(by.keywords)).withColumnRenamed("id", by.order)
    added = right.join(rest, by.order, "left_semi").select(*left.columns, F.lit(None).cast("long").alias("matched"), F.lit(None).cast("int").alias("score"), F.lit(True).alias("appended"))
    return rows.withColumn("matched", F.col("matched").cast("long")).unionByName(added)
