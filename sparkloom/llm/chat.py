"""Chat formatting: minimum-cost repair of the roles of a conversation, then rendering.

Legal conversations are those of an automaton: an optional system turn, then user and assistant in turn, an assistant last. Each
given turn may be kept (free), joined to the turn before (``MERGE``), given another role (``RELABEL``, also on top of a
merge), or have an empty turn put before it (``INSERT``); the end may need empty turns too. Dynamic programming over the automaton's states
finds the cheapest repair of the whole conversation; costs that tie are decided by a hash of the turns, so the same
turns are repaired alike however Spark deals them.

No task needs a whole conversation: rows are sorted by conversation and turn across partitions, a run of turns within one partition
is summed up as a matrix of costs between states (min-plus), the few matrices of a conversation (one per partition at most) are
multiplied to fix the state at each run's start and end, and each run is then repaired for itself.

Edge cases: rows without a conversation id form one conversation; null turns come first, equal turns order by role and text; a
null role, or one that isn't system, user or assistant, has to be relabelled; a null text is empty; text that spells a mark is broken
up by a space; repeated rows are turns of their own; no rows give no rows. Columns besides the four named aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import staged

MERGE, INSERT, RELABEL = 1, 2, 3
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = ["", "system", "user", "assistant"]
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"

Cost = tuple[int, int]
NEVER: Cost = (1 << 60, 0)


def _actions() -> dict[int, list[tuple[int, int, int, str, tuple[int, ...]]]]:
    """By given role (0: unknown): (state, state after, cost, action, empty turns put before)."""
    out = {}
    for given in range(4):
        found = []
        for s in range(4):
            if s != START:
                found.append((s, s, MERGE + RELABEL * (given != s), "merge", ()))
            for x in NEXT[s]:
                found.append((s, x, RELABEL * (given != x), "keep" if given == x else "relabel", ()))
                found += [(s, y, INSERT + RELABEL * (given != y), "insert" if given == y else "insert+relabel", (x,)) for y in NEXT[x]]
        out[given] = found
    return out


ACTIONS = _actions()
#: Empty turns that end a conversation, by state.
ENDING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def _tie(seed: int, k: int) -> int:
    return crc32(b"%d:%d" % (seed, k))


def _add(a: Cost, b: Cost) -> Cost:
    return (a[0] + b[0], a[1] + b[1])


def summed(turns: list[tuple[int, int]] | Iterator[tuple[int, int]]) -> list[list[Cost]]:
    """Least cost between any two states over turns (role, seed)."""
    best = [[(0, 0) if i == j else NEVER for j in range(4)] for i in range(4)]
    for role, seed in turns:
        ties = [_tie(seed, k) for k in range(len(ACTIONS[role]))]
        new = []
        for row in best:
            out = [NEVER] * 4
            for k, (s, to, cost, *_) in enumerate(ACTIONS[role]):
                if row[s] < NEVER:
                    out[to] = min(out[to], (row[s][0] + cost, row[s][1] + ties[k]))
            new.append(out)
        best = new
    return best


def repaired(turns: list[tuple[int, int]], start: int, end: int) -> list[tuple[int, int]]:
    """(state before, number of the action) of each turn, along the cheapest way from state ``start`` to ``end``."""
    togo = [NEVER] * 4
    togo[end] = (0, 0)
    choices = []
    for role, seed in reversed(turns):
        new, choice = [NEVER] * 4, [0] * 4
        for k, (s, to, cost, *_) in enumerate(ACTIONS[role]):
            if togo[to] < NEVER and (c := (togo[to][0] + cost, togo[to][1] + _tie(seed, k))) < new[s]:
                new[s], choice[s] = c, k
        choices.append(choice)
        togo = new
    out, s = [], start
    for (role, _), choice in zip(turns, reversed(choices), strict=True):
        out.append((s, choice[s]))
        s = ACTIONS[role][choice[s]][1]
    return out


def boundaries(matrices: list[list[list[Cost]]]) -> list[int]:
    """The states before the first run, between runs and after the last, along the cheapest whole repair."""
    togo = [(INSERT * len(ENDING[s]), 0) for s in range(4)]
    tables = [togo]
    for m in reversed(matrices):
        togo = [min((_add(m[s][t], togo[t]) for t in range(4) if m[s][t] < NEVER and togo[t] < NEVER), default=NEVER) for s in range(4)]
        tables.append(togo)
    tables.reverse()
    out = [START]
    for m, after in zip(matrices, tables[1:], strict=True):
        out.append(min((t for t in range(4) if m[out[-1]][t] < NEVER and after[t] < NEVER), key=lambda t: (_add(m[out[-1]][t], after[t]), t)))
    return out


def fragment(role: int, action: tuple, before: int, text: str, last: bool) -> str:
    """What a turn adds to the rendered conversation; all turns' fragments in order, end to end, are the whole."""
    _, to, _, name, empty = action
    text = text.replace("<|", "< |")
    out = "\n" + text if name == "merge" else (CLOSE if before != START else "") + "".join(OPEN.format(NAMES[x]) + CLOSE for x in empty) + OPEN.format(NAMES[to]) + text
    return out + (CLOSE + "".join(OPEN.format(NAMES[x]) + CLOSE for x in ENDING[to]) if last else "")


def repair(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text", partitions: int | None = None) -> DataFrame:
    """conv_id, turn, seq, role, new_role, action, inserted, cost, fragment: a row for each given turn.

    seq: place in the conversation, from 0; inserted: roles of the empty turns before it; cost: of the repair of this turn
    (with the ending, at the last); fragment: its part of the rendered text.
    """
    spark = turns.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["__conv", "__turn", "__role", "__tie"]
    rows = turns.select(F.col(conv_col).alias("__conv"), F.col(turn_col).alias("__turn"), F.col(role_col).alias("__role"), F.coalesce(text_col, F.lit("")).alias("__text"))
    rows = rows.withColumn("__tie", F.xxhash64("__text"))
    rows = staged(rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "turns")
    kind = {c: rows.schema[c].dataType.simpleString() for c in rows.columns}
    role = F.coalesce(F.create_map(*[x for n, k in ROLES.items() for x in (F.lit(n), F.lit(k))])[F.col("__role")], F.lit(0))
    seed = F.crc32(F.concat_ws(":", F.col("__conv").cast("string"), F.col("__turn").cast("string"), "__role", F.col("__tie").cast("string")))
    rows = rows.withColumn("__given", role).withColumn("__seed", seed)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A run's matrix for each (conversation, partition): its turns come one after the other."""
        open_key, best, n, out = None, None, 0, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for key, own in groupby(zip(*columns, strict=True), lambda r: r[:2]):
                own = [r[2:] for r in own]
                m = summed(own)
                if key == open_key:
                    best = [[min((_add(best[i][j], m[j][k]) for j in range(4) if best[i][j] < NEVER and m[j][k] < NEVER), default=NEVER) for k in range(4)] for i in range(4)]
                    n += len(own)
                    continue
                if open_key is not None:
                    out.append((*open_key, n, best))
                open_key, best, n = key, m, len(own)
            yield packed(out)
            out = []
        if open_key is not None:
            yield packed([(*open_key, n, best)])

    def packed(out: list) -> pa.RecordBatch:
        flat = [[str(x) for row in m for cost in row for x in cost] for *_, m in out]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], arrow), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int64()), pa.array(flat, pa.list_(pa.string()))], ["__conv", "__part", "n", "costs"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(rows.schema["__conv"].dataType)
    # Whole runs go to one task: a run is at most what one partition held.
    alone = rows.drop("__text").repartition(partitions, "__conv", "__part").sortWithinPartitions("__conv", "__part", *order[1:])
    pieces = alone.select("__conv", "__part", "__given", "__seed").mapInArrow(runs, f"__conv {kind['__conv']}, __part int, n long, costs array<string>")

    @F.pandas_udf("array<struct<part:int,at:int,first:long,start:int,stop:int,last:boolean>>")
    def fixed(runs: pd.Series) -> pd.Series:
        out = []
        for found in runs:
            found = sorted(found, key=lambda r: r["part"])
            matrices = [[[(int(r["costs"][8 * i + 2 * j]), int(r["costs"][8 * i + 2 * j + 1])) for j in range(4)] for i in range(4)] for r in found]
            states, first = boundaries(matrices), 0
            rows = []
            for i, r in enumerate(found):
                rows.append({"part": r["part"], "at": i, "first": first, "start": states[i], "stop": states[i + 1], "last": i + 1 == len(found)})
                first += r["n"]
            out.append(rows)
        return pd.Series(out)

    known = pieces.groupBy("__conv").agg(F.collect_list(F.struct(F.col("__part").alias("part"), "n", "costs")).alias("runs")).select("__conv", F.explode(fixed("runs")).alias("r")).select(F.col("__conv").alias("__c"), "r.*")
    joined = rows.join(known, rows["__conv"].eqNullSafe(known["__c"]) & (rows["__part"] == known["part"]))

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, key = [], None
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key is not None and (r[0], r[8]) != key:
                    yield finished(kept)
                    kept = []
                key = (r[0], r[8])
                kept.append(r)
        if kept:
            yield finished(kept)

    def finished(kept: list) -> pa.RecordBatch:
        conv, _, _, _, _, _, start, stop, _, first, last, _ = kept[0]
        way = repaired([(r[4], r[5]) for r in kept], start, stop)
        rows = []
        for i, (r, (before, k)) in enumerate(zip(kept, way, strict=True)):
            action = ACTIONS[r[4]][k]
            end = last and i + 1 == len(kept)
            rows.append((r[0], r[1], first + i, r[2], NAMES[action[1]], action[3], [NAMES[x] for x in action[4]], action[2] + (INSERT * len(ENDING[action[1]]) if end else 0), fragment(r[4], action, before, r[3], end)))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    types = [arrow, to_arrow_type(rows.schema["__turn"].dataType), pa.int64(), to_arrow_type(rows.schema["__role"].dataType), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string()]
    names = ["conv_id", "turn", "seq", "role", "new_role", "action", "inserted", "cost", "fragment"]
    within = joined.select("__conv", "__turn", "__role", "__text", "__given", "__seed", "start", "stop", "__part", "first", "last", "__tie")
    dealt = within.repartition(partitions, "__conv", "__part").sortWithinPartitions("__conv", "__part", "__turn", "__role", "__tie")
    return dealt.mapInArrow(rendered, f"conv_id {kind['__conv']}, turn {kind['__turn']}, seq long, role {kind['__role']}, new_role string, action string, inserted array<string>, cost int, fragment string")
