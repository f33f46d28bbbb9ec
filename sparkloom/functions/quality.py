"""Rule-based text quality: scores out of counts of patterns, all native. The script's character class is an argument.

Counts are taken once for each text; the rules are steps over them. Null texts are empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import count, count_chars

HANGUL = r"[\x{AC00}-\x{D7A3}]"
LATIN = "[A-Za-z]"
#: What isn't text, and the marks of list items.
BROKEN = r"[\x{FFFD}\x00-\x08\x0b\x0c\x0e-\x1f]"
BULLETS = "-•○※ㅇ□▶▷◆◇★☆►◎⦁⦾"
#: White space as in Unicode.
_WS = r"\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_S, _X = f"[{_WS}]", f"[^{_WS}]"
_SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"  # the same
_LINE_WS = rf"[{_WS}&&[^\n]]"
_PRIVATE = r"[\x{E000}-\x{F8FF}]"
_NOISE = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFD}-\x{FFFF}]"
_ODD = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{E000}-\x{F8FF}\x{FFFD}-\x{FFFF}]"  # holds BROKEN, private ones and noise
_PAIRS = r"([A-Z])\1([A-Z])\2([A-Z])\3([A-Z])\4|([0-9])\5([0-9])\6([0-9])\7([0-9])\8"
_LINE = rf"{_X}(?:[^\n]*{_X})?"
_LISTED = rf"(?md)^{_LINE_WS}*(?:[{BULLETS}]{_LINE_WS}*{_X}|[0-9]+[.)]|\([가-힣0-9]+\))"


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x evaluated once."""
    return F.transform(F.array(x), use)[0]


def _counts(x: Column, script: str, names: str, use: Callable[[Column], Column]) -> Column:
    """use(struct of the counts of these names), with ``x`` and each count evaluated once.

    Letters and words are many, so they aren't listed to be counted. What only odd characters raise is looked for where there are some; Hangul counts beside
    private characters alone (or as the ``script``).
    """

    def of(x: Column, spaced: Column, odd: Column) -> Column:
        some = lambda c: F.when(odd > 0, c).otherwise(0)
        found = {
            "n": lambda: F.char_length(x), "solid": lambda: F.char_length(F.replace(spaced, F.lit(" "), F.lit(""))), "script": lambda: count_chars(x, script), "digits": lambda: count_chars(x, r"\p{Nd}"),
            "latin": lambda: count_chars(x, LATIN), "hangul": lambda: some(count_chars(x, HANGUL)), "broken": lambda: some(count_chars(x, BROKEN)), "private": lambda: some(count_chars(x, _PRIVATE)),
            "noise": lambda: some(count_chars(x, _NOISE)), "stripped": lambda: F.char_length(F.btrim(spaced)), "words": lambda: count(spaced, "[^ ]+"), "lines": lambda: F.char_length(x) - F.char_length(F.replace(x, F.lit("\n"), F.lit(""))) + 1,
            "table_lines": lambda: count(x, r"(?md)^[^\n|]*\|[^\n|]*\|"), "list_lines": lambda: count(x, _LISTED), "ends": lambda: count(spaced, "[.!?。] "), "full_lines": lambda: count(x, _LINE),
            "in_lines": lambda: F.char_length(x) - F.char_length(F.regexp_replace(x, _LINE, "")), "runs": lambda: count(x, r"([^\n])\1{4,}"), "tags": lambda: count(x, "<[^>]+>"), "pairs": lambda: count(x, _PAIRS),
            "unseen": lambda: count_chars(x, r"[\x00-\x1f]"),
        }
        return F.struct(*[found[k]().cast("double").alias(k) for k in names.split()])

    given = lambda x: F.struct(x.alias("x"), F.translate(x, _SPACES, " " * len(_SPACES)).alias("spaced"), count_chars(x, _ODD).alias("odd"))
    return _let(_let(_let(F.coalesce(x, F.lit("")), given), lambda g: of(g["x"], g["spaced"], g["odd"])), use)


#: What the scores need.
_MISENCODED = "n solid hangul private pairs noise"
_DETAILS = f"{_MISENCODED} script digits latin broken stripped words lines table_lines list_lines ends full_lines in_lines runs"


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _steps(x: Column, steps: list[tuple[float, float]], rest: float) -> Column:
    """The value of the first step that x reaches."""
    out = F.lit(rest)
    for least, value in reversed(steps):
        out = F.when(x >= least, value).otherwise(out)
    return out


def _script_score(ratio: Column, low: list[tuple[float, float]], rest: float) -> Column:
    """1 from 0.55 to 0.90, 0.7 a little under or above, less below; ``rest`` over 0.95."""
    return F.when(ratio > 0.95, rest).when(ratio > 0.90, 0.7).otherwise(_steps(ratio, [(0.55, 1.0), (0.40, 0.7), *low], rest))


def _sentence_score(c: Column) -> Column:
    each = c["words"] / c["ends"]
    return F.when(each.between(5, 30), 1.0).when(each.between(3, 50), 0.7).otherwise(0.4)


def _misencoded(c: Column) -> Column:
    rare = (_share(c["hangul"], c["solid"]) < 0.01) & (_share(c["private"], c["solid"]) > 0.3)
    return (c["n"] >= 100) & (c["solid"] > 0) & ((c["pairs"] >= 5) | (_share(c["noise"], c["n"]) > 0.10) | rare)


def misencoded(x: Column) -> Column:
    """Whether a text of 100 characters or more is surely of another encoding: doubled letters or digits in runs of four, five times;
    over a tenth broken characters; or hardly any Hangul and over three tenths private characters."""
    return _counts(x, HANGUL, _MISENCODED, _misencoded)


def _structure(c: Column) -> Column:
    """Tables and lists are as good as sentences; then lines of a fair length."""
    mean_line = c["in_lines"] / c["full_lines"]
    lines = F.when((c["full_lines"] >= 5) & mean_line.between(10, 200), 0.7).otherwise(0.5)
    sentences = F.when(c["ends"] > 0, _sentence_score(c)).otherwise(lines)
    listed = F.when(c["list_lines"] >= 3, F.when(c["list_lines"] / c["lines"] >= 0.2, 1.0).otherwise(0.85)).otherwise(sentences)
    tables = F.when(c["table_lines"] >= 3, F.when(c["table_lines"] / c["lines"] >= 0.2, 1.0).otherwise(0.9)).otherwise(listed)
    return F.when(c["words"] < 10, 0.5).otherwise(tables)


def _broken_score(c: Column) -> Column:
    return 1 - F.least(_share(c["broken"], c["n"]) * 5, F.lit(1.0))


def _parts(c: Column) -> dict[str, Column]:
    ratio = _share(c["script"], c["solid"])
    technical = (_share(c["digits"], c["solid"]) > 0.15) | (_share(c["latin"], c["solid"]) > 0.20)
    usual = _script_score(ratio, [(0.25, 0.5), (0.15, 0.3)], 0.1)
    return {
        "script": F.when(technical & (ratio >= 0.05), _steps(ratio, [(0.20, 1.0), (0.10, 0.8)], 0.6)).otherwise(usual), "broken": _broken_score(c), "sentence": _structure(c),
        "repetition": F.greatest(F.lit(0.0), 1 - c["runs"] / F.greatest(c["n"] / 100, F.lit(1.0)) * 0.2), "encoding": F.when(_misencoded(c), 0.0).otherwise(1.0),
    }


#: What each part weighs.
WEIGHTS = {"script": 0.30, "broken": 0.25, "sentence": 0.15, "repetition": 0.10, "encoding": 0.20}


def details(x: Column, script: str = HANGUL) -> Column:
    """struct of the parts (0 to 1) and ``overall``, their weighted sum to four digits; texts under ten characters have 0 overall."""

    def of(c: Column) -> Column:
        parts = _parts(c)
        total = sum((WEIGHTS[k] * v for k, v in parts.items()), F.lit(0.0))
        return F.struct(*[v.alias(k) for k, v in parts.items()], F.when(c["stripped"] < 10, 0.0).otherwise(F.round(total, 4)).alias("overall"))

    return _counts(x, script, _DETAILS, of)


def score(x: Column, script: str = HANGUL) -> Column:
    return details(x, script)["overall"]


def page_score(x: Column, script: str = HANGUL) -> Column:
    """For text out of pages: 0.30 script + 0.25 broken + 0.20 sentences + 0.15 (a tenth off for each tag left, 0.3 at least) + 0.10."""

    def of(c: Column) -> Column:
        ratio = _share(c["script"], c["solid"])
        sentence = F.when((c["ends"] > 0) & (c["words"] >= 10), _sentence_score(c)).otherwise(0.5)
        tags = F.greatest(F.lit(0.3), 1 - c["tags"] * 0.1)
        total = 0.30 * _script_score(ratio, [(0.25, 0.4)], 0.1) + 0.25 * _broken_score(c) + 0.20 * sentence + 0.15 * tags + 0.10
        return F.when(c["stripped"] < 10, 0.0).otherwise(F.round(total, 4))

    return _counts(x, script, "n solid script broken stripped words ends tags", of)


def gate(x: Column, script: str = HANGUL) -> Column:
    """struct<valid, score, reason>: short, doubled, broken, private, invalid or poor; reason is null for valid texts."""

    def of(c: Column) -> Column:
        ratio, broken = _share(c["script"], c["solid"]), _share(c["noise"], c["n"])
        fit = _share(c["n"] - c["unseen"] - c["private"], c["n"])
        total = fit * 0.5 + ratio * 0.3 + (1 - broken) * 0.2
        rules = [
            ((c["stripped"] < 10) | (c["solid"] == 0), 0.0, "short"), (c["pairs"] >= 5, 0.1, "doubled"), (broken > 0.1, 0.2, "broken"),
            (_share(c["private"], c["solid"]) > 0.15, 0.2, "private"), ((ratio < 0.05) & (fit < 0.5), 0.3, "invalid"), (total < 0.5, None, "poor"),
        ]
        points, reason = total, F.lit(None).cast("string")
        for met, value, name in reversed(rules):
            points = F.when(met, value if value is not None else total).otherwise(points)
            reason = F.when(met, name).otherwise(reason)
        return F.struct(reason.isNull().alias("valid"), F.round(points, 6).alias("score"), reason.alias("reason"))

    return _counts(x, script, "n solid script stripped pairs private noise unseen", of)


def decoding_score(x: Column) -> Column:
    """0.6 valid + 0.4 (1 - replaced) of a decoded text: control characters (but tab and line ends), delete and private ones aren't valid; 0 if empty."""
    n = F.char_length(x)
    invalid = count(x, rf"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]|{_PRIVATE}")
    return F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).otherwise((n - invalid) / n * 0.6 + (1 - count(x, r"\x{FFFD}") / n) * 0.4)


def advice(scores: dict[str, Column], at_least: float, knobs: dict[str, str]) -> Column:
    """The settings to change, for the scores that fall short."""
    return F.array_compact(F.array(*[F.when(scores[k] < at_least, v) for k, v in knobs.items()]))
