"""Running totals, last values and neighbours along an order, though one group may hold most of the rows.

A window puts a whole group into one task. Here groups of more than ``most`` rows are dealt to ranges of their order instead: each range is
summed alone, what its predecessors carry is added up over the ranges (a row for each range and group), and then the rows of each range
are finished with what it was handed. Other groups take an ordinary window. Results are the same; only the sums of doubles may be added
in another order. ``most`` is raised to a ten-thousandth of all rows, so that at most 10,000 groups are broadcast as such.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.staging import staged

MOST = 1_000_000
_HOT = 10_000

#: What a scan gives each row: ``sum`` of the values up to it, ``last`` value that isn't null up to it, ``lag``: the value of the row before.
Outs = dict[str, tuple[str, Column]]


def scan(df: DataFrame, group: list[str], by: list[str], outs: Outs, most: int = MOST) -> DataFrame:
    """``df`` with a column for each of ``outs``. Rows of a group are in the ascending order of ``by`` (nulls first), which should leave no ties.

    ``df`` is read three times where there is a large group, twice else: stage what is costly.
    """
    if any(kind not in ("sum", "last", "lag") for kind, _ in outs.values()):
        raise ValueError("kinds are sum, last, lag")
    sizes = staged(df.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")), "sizes")
    rows = sizes.agg(F.sum("__n")).first()[0] or 0
    large = sizes.where(F.col("__n") > max(most, rows // _HOT))
    found = large.agg(F.sum("__n")).first()[0] or 0
    if not found:
        return scan_groups(df, group, by, outs)
    keys = large.select(*[F.col(c).alias(f"__{c}") for c in group])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in group], F.lit(True))
    small = df.join(F.broadcast(keys), same, "left_anti")
    hot = df.join(F.broadcast(keys), same, "left_semi")
    return scan_groups(small, group, by, outs).unionByName(_over_ranges(hot, group, by, outs, -(-found // most)))


def _window(group: list[str], by: list[str]):
    return Window.partitionBy(*group).orderBy(*by)


def _local(kind: str, x: Column, w) -> Column:
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return {"sum": F.sum(x).over(upto), "last": F.last(x, ignorenulls=True).over(upto), "lag": F.lag(x).over(w)}[kind]


def scan_groups(df: DataFrame, group: list[str], by: list[str], outs: Outs) -> DataFrame:
    """The same by ordinary windows, each group in one task; ``df`` is read once."""
    w = _window(group, by)
    return df.withColumns({name: _local(kind, x, w) for name, (kind, x) in outs.items()})


def _over_ranges(df: DataFrame, group: list[str], by: list[str], outs: Outs, ranges: int) -> DataFrame:
    # Written, so that all steps see the same ranges.
    df = staged(df.repartitionByRange(ranges, *group, *by).withColumn("__range", F.spark_partition_id()), "ranges")
    place = F.struct(*by)
    totals = {"sum": lambda x: F.sum(x), "last": lambda x: F.max_by(x, F.when(x.isNotNull(), place)), "lag": lambda x: F.max_by(F.struct(x.alias("v")), place)}
    carried = df.groupBy(*group, "__range").agg(*[totals[kind](x).alias(f"__{name}") for name, (kind, x) in outs.items()])
    before = _window(group, ["__range"]).rowsBetween(Window.unboundedPreceding, -1)
    hand = lambda kind, c: F.sum(c).over(before) if kind == "sum" else F.last(c, ignorenulls=True).over(before)
    carried = carried.select(*[F.col(c).alias(f"__{c}_of") for c in group], F.col("__range").alias("__r"), *[hand(kind, f"__{name}").alias(f"__{name}") for name, (kind, _) in outs.items()])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}_of")) for c in group], F.col("__range") == F.col("__r"))
    w = _window([*group, "__range"], by)
    rows = df.withColumns({name: _local(kind, x, w) for name, (kind, x) in outs.items()} | {"__at": F.row_number().over(w)}).join(carried, same)
    for name, (kind, _) in outs.items():
        own, handed = F.col(name), F.col(f"__{name}")
        if kind == "sum":
            done = F.when(own.isNull(), handed).otherwise(own + F.coalesce(handed, F.lit(0)))
        elif kind == "last":
            done = F.coalesce(own, handed)
        else:
            done = F.when(F.col("__at") == 1, handed["v"]).otherwise(own)
        rows = rows.withColumn(name, done.cast(rows.schema[name].dataType))
    return rows.select(*df.drop("__range").columns, *outs)
