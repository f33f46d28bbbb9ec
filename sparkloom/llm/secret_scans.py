"""Operator 13: secrets in texts, by a trigram index, in DataFrame expressions alone.

Each rule is a regular expression. From it follows a Boolean query of trigrams that every match must hold (of the lower-cased text).
``trigram_index`` keeps for each trigram that some query asks for, and each block of some thousand texts, the keys of the texts that
hold it; ``candidates`` intersects and unites these postings as the queries say. Only candidates are then searched with a rule's
expression; a rule without mandatory trigrams (``hex``) searches all texts.

A key is half of the text's sha256, so copies share one posting and one entry of the candidates. Candidates are broadcast if they are
at most half a million; else they are joined by key and salt, so that copies of one text spread over tasks.

Odd input: a null text is empty, an empty text has no spans, an empty table gives an empty one; ids may be null or repeat, every row
gives a row. Positions count code points. Only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import broadcast_if_small, staged


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched for from left to right without overlaps; matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Fixed values. ``{16,}`` and ``{14,}`` find what ``+`` finds after matches under 16 and 18 characters are dropped: a match is the
#: rest of its run of characters, and what is left of a run that is too short is shorter still.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Forms of keys and tokens that their issuers document.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("url", r"[A-Za-z][A-Za-z0-9+.-]{0,20}://[^\x00-\x20/:@]{1,100}:[^\x00-\x20/:@]{1,100}@"),
)
BLOCK = 4096  # texts of a block of postings, about

# Queries of trigrams: a trigram, ("and" | "or", parts), or None where nothing is mandatory


def trigram_query(pattern: str):
    """What every match of ``pattern`` must hold, in lower case."""
    runs, parts = _walk(_parser.parse(pattern))
    return _all([*parts, _spelled(runs)])


def _walk(nodes, most: int = 64) -> tuple[set[str], list]:
    """The strings that the end of a sequence can be, and queries for what comes before; runs of over ``most`` strings are closed early."""
    runs, parts = {""}, []
    for node in nodes:
        strings, inner = _one(*node)
        joined = {a + b for a, b in product(runs, strings)} if strings is not None else None
        if joined is None or len(joined) > most:
            parts.append(_spelled(runs))
            runs = strings if strings is not None and len(strings) <= most else {""}
        else:
            runs = joined
        parts += inner
    return runs, parts


def _one(kind, value) -> tuple[set[str] | None, list]:
    """The strings that a node can be, in lower case (None: too many to say), and queries for what it must hold besides."""
    if kind is op.LITERAL:
        return {chr(value).lower()}, []
    if kind is op.IN and all(k in (op.LITERAL, op.RANGE) for k, _ in value):
        chars = {chr(c).lower() for k, v in value for c in ((v,) if k is op.LITERAL else range(v[0], min(v[1], v[0] + 200) + 1))}
        return (chars, []) if len(chars) <= 8 else (None, [])
    if kind is op.SUBPATTERN:
        return _whole(value[3])
    if kind is op.BRANCH:
        each = [_whole(b) for b in value[1]]
        if all(s is not None and not q for s, q in each):
            return set().union(*(s for s, _ in each)), []
        return None, [_any([_all([*q, _spelled(s or {""})]) for s, q in each])]
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, nodes = value
        strings, parts = _whole(nodes)
        if most == 1 and strings is not None and not parts:
            return strings | {""} if least == 0 else strings, []
        return None, [*parts, _spelled(strings or {""})] if least else []
    return ({""}, []) if kind is op.AT else (None, [])


def _whole(nodes) -> tuple[set[str] | None, list]:
    runs, parts = _walk(nodes)
    return (runs, []) if not parts else (None, [*parts, _spelled(runs)])


def _spelled(strings: set[str]):
    """The query of texts that hold one of the strings."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) if len(s) > 2 else None for s in sorted(strings)])


def _all(parts: list):
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    flat = list(dict.fromkeys(x for p in parts for x in (p[1] if isinstance(p, tuple) and p[0] == "and" else (p,))))
    return None if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def _any(parts: list):
    if not parts or any(p is None for p in parts):
        return None
    flat = list(dict.fromkeys(parts))
    needs = {p: {p} if isinstance(p, str) else set(p[1]) for p in flat if isinstance(p, str) or p[0] == "and"}
    # What asks for more than another part does adds no text.
    flat = [p for p in flat if p not in needs or not any(q != p and needs[q] < needs[p] for q in needs)]
    return flat[0] if len(flat) == 1 else ("or", tuple(flat))


def trigrams(query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


# Index and candidates


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def text_key(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _at_each_place(wanted: set[str]) -> str:
    """An expression that looks for the wanted trigrams at each place of a text, by their first characters; one pass whatever their number."""
    by_first: dict[str, list[str]] = {}
    for gram in sorted(wanted):
        by_first.setdefault(gram[0], []).append(re.escape(gram[1:]))
    return "(?=(" + "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in by_first.items()) + "))"


def trigram_index(docs: DataFrame, wanted: set[str], blocks: int) -> DataFrame:
    """block, gram, keys: the distinct texts of a block that hold a trigram, for the wanted trigrams."""
    grams = F.array_distinct(F.regexp_extract_all(F.lower(_text()), F.lit(_at_each_place(wanted)), 1))
    rows = docs.select(text_key(_text()).alias("key"), F.explode(grams).alias("gram")).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
    return rows.groupBy("block", "gram").agg(F.collect_set("key").alias("keys"))


def _postings(query, of: Column) -> Column:
    if isinstance(query, str):
        return F.coalesce(of[query], F.array().cast("array<binary>"))
    parts = [_postings(q, of) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = F.array_intersect(out, p) if query[0] == "and" else F.array_union(out, p)
    return out


def candidates(index: DataFrame, queries: dict[str, object]) -> DataFrame:
    """key, rules: the rules whose query a text's trigrams meet, by intersecting postings block by block."""
    of = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("of"))
    each = F.array(*[F.struct(F.lit(kind).alias("rule"), _postings(q, F.col("of")).alias("keys")) for kind, q in queries.items()])
    pairs = of.select(F.explode(each).alias("x")).select("x.rule", F.explode("x.keys").alias("key"))
    return pairs.groupBy("key").agg(F.collect_set("rule").alias("rules"))


# Spans


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    r"""array<struct<begin,rank,end,kind>>: the rule's matches. ``\G`` makes gap and match follow on each other, in one pass."""
    pattern = F.lit(rf"\G([\s\S]*?)({rule.pattern})")
    sizes = lambda group: F.transform(F.regexp_extract_all(text, pattern, group), F.length)
    found = F.arrays_zip(sizes(1).alias("gap"), sizes(2).alias("whole"), sizes(rule.group + 2).alias("part"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,rank:int,end:int,kind:string>>").alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        first, after = acc["at"] + m["gap"], acc["at"] + m["gap"] + m["whole"]
        span = F.array(F.struct(first.alias("begin"), F.lit(order).alias("rank"), after.alias("end"), F.lit(rule.kind).alias("kind")))
        return F.struct(after.alias("at"), F.when(m["part"] >= rule.least, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(found, begin, step, lambda acc: acc["spans"])


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")


def _number(spans: Column, rank: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")


def secret_table(docs: DataFrame, more: tuple[Rule, ...] = MORE, block: int = BLOCK) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of ``docs`` (doc_id, text)."""
    rules = BASE + more
    for rule in rules:
        re.compile(rule.pattern)
    asked = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    blocks = max(1, -(-docs.count() // block))
    index = staged(trigram_index(docs, set().union(*map(trigrams, asked.values())), blocks), "trigrams")
    found = staged(candidates(index, asked), "candidates")
    texts = docs.select("doc_id", _text().alias("text"))
    texts = _with_rules(texts, found)
    empty = F.array().cast("array<struct<begin:int,rank:int,end:int,kind:string>>")
    each = []
    for order, rule in enumerate(rules):
        worth = F.array_contains("rules", rule.kind) if rule.kind in asked else F.col("text").rlike(rule.pattern)
        each.append(F.when(worth, spans_of(F.col("text"), rule, order)).otherwise(empty))
    rows = texts.select("doc_id", F.array_sort(F.flatten(F.array(*each))).alias("__spans"))
    base = F.filter("__spans", lambda s: s["rank"] < len(BASE))
    counts = [_number(F.col("__spans"), k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("__spans")).alias("spans"))


def _with_rules(texts: DataFrame, found: DataFrame, salts: int = 16) -> DataFrame:
    """The rules that each text is a candidate of, null for none."""
    small = broadcast_if_small(found)
    keyed = texts.withColumn("key", text_key(F.col("text")))
    if small is not found:
        return keyed.join(small, "key", "left")
    keyed = keyed.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    return keyed.join(found.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["key", "__salt"], "left")
