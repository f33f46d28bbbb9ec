"""Many keywords at once: an automaton over a dictionary runs once over each text, whatever the number of words.

A dictionary may be a table of any size: it comes to the tasks in blocks of words, each broadcast, and a block's automaton is built once
per Python worker. Matching is exact and by characters; fold case on both sides before if it shouldn't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a block.
BLOCK = 100_000
_built: dict[int, ahocorasick.Automaton] = {}


def automaton(words: list[str]) -> ahocorasick.Automaton:
    """Finds the positions of words in their list; empty words are left out."""
    found = ahocorasick.Automaton()
    for i, w in enumerate(words):
        if w:
            found.add_word(w, i)
    found.make_automaton()
    return found


def matcher(spark, words: list[str]) -> Callable[[Column], Column]:
    """text -> array<int>: the positions in ``words`` of those that a text contains, ascending; a word that is listed twice has its last position. Null texts contain nothing."""
    shared = spark.sparkContext.broadcast(list(words))
    number = shared._jbroadcast.id() if shared._jbroadcast is not None else id(shared)

    @F.pandas_udf("array<int>")
    def found(texts: pd.Series) -> pd.Series:
        if number not in _built:
            _built.clear()
            _built[number] = automaton(shared.value)
        machine = _built[number]
        if not len(machine):
            return pd.Series([[]] * len(texts))
        return pd.Series([sorted({i for _, i in machine.iter(t)}) if isinstance(t, str) else [] for t in texts], dtype=object)

    return found


def keyword_hits(docs: DataFrame, text: str, keywords: DataFrame, word: str, block: int = BLOCK, fold: bool = True) -> DataFrame:
    """Documents with each row of ``keywords`` whose word their text contains, in any case (unless ``fold`` is false).

    Texts are read once for each block of words. The words found then join the dictionary by equality. An empty word is in every text,
    a null one in none; null texts hold nothing.
    """
    spark = docs.sparkSession
    case = F.lower if fold else F.col
    known = keywords.withColumn("__word", case(word)).where("__word is not null")
    out = None
    for words in _blocks(known.select("__word").distinct().toLocalIterator(), block):
        find = matcher(spark, words)
        listed = spark.createDataFrame(list(enumerate(words)), "__at int, __word string")
        rows = docs.withColumn("__found", find(case(text)))
        if "" in words:
            rows = rows.withColumn("__found", F.when(F.col(text).isNotNull(), F.array_append("__found", F.lit(words.index("")))).otherwise(F.col("__found")))
        found = rows.withColumn("__at", F.explode("__found")).drop("__found").join(F.broadcast(listed), "__at").drop("__at")  # a block of words
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.withColumn("__word", F.lit(None).cast("string")).where(F.lit(False))
    return out.join(known, "__word").drop("__word")


def _blocks(rows: Iterator, size: int) -> Iterator[list[str]]:
    block = []
    for row in rows:
        block.append(row[0])
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block
