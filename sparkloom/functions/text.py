"""Text expressions: Column in, Column out, all built-in functions (UDFs only where a module says so).

Patterns keep to what Java and RE2 share, unless noted, and script-specific classes are arguments.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: Hangul syllables, Jamo and compatibility Jamo.
HANGUL = r"[\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}\x{3130}-\x{318F}]"


def count(x: Column, pattern: str) -> Column:
    return F.regexp_count(x, F.lit(pattern))


def count_chars(x: Column, chars: str) -> Column:
    """How many characters are of a class, ``chars`` as in a pattern: by what is left without them, as ``count`` makes an array of all matches."""
    return F.char_length(x) - F.char_length(F.regexp_replace(x, f"{chars}+", ""))


def all_matches(x: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), group)


def first_match(x: Column, pattern: str, group: int = 0) -> Column:
    """The first match; null if there is none."""
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def first_of(*found: Column) -> Column:
    return F.coalesce(*found)


def token_estimate(x: Column, script: str = HANGUL, per_script: float = 1.7, per_other: float = 4.0) -> Column:
    """ceil(script / per_script + others / per_other); others in UTF-16 units, so characters beyond the basic plane count twice."""
    n = count(x, script)
    units = F.char_length(x) + count(x, r"[\x{10000}-\x{10FFFF}]")
    return F.ceil(n / per_script + (units - n) / per_other)


def token_estimate_words(x: Column, script: str = HANGUL) -> Column:
    """ceil(2.5 script + 0.4 Latin words + 0.5 others), others being neither script, Latin letters nor white space."""
    return F.ceil(2.5 * count(x, script) + 0.4 * count(x, "[A-Za-z]+") + 0.5 * count(F.regexp_replace(x, script, ""), r"[^A-Za-z\s]"))


def without_controls(x: Column) -> Column:
    """No control or private-use characters; tab, line feed and carriage return stay."""
    return F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{E000}-\x{F8FF}]", "")


def squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def error_class(message: Column) -> Column:
    """The first of timeout, http, parsing, network, dom that the message speaks of, else unknown."""
    m = F.lower(message)
    rules = [("timeout", r"timeout|timed out"), ("http", r"http|status code|\b[45][0-9][0-9]\b"), ("parsing", r"pars|json|syntax"), ("network", r"network|econn|socket|dns"), ("dom", r"selector|element|dom\b")]
    return reduce(lambda done, rule: F.when(m.rlike(rule[1]), rule[0]).otherwise(done), reversed(rules), F.lit("unknown"))


def normalized_url(url: Column) -> Column:
    """https, no ``www.``, query parameters sorted, no slash at the end; what doesn't look like a URL stays as it is."""
    ok = url.rlike(r"^https?://[^/?#]+")
    host = F.lower(F.regexp_replace(F.regexp_extract(url, r"^https?://([^/?#]+)", 1), r"^www\.", ""))
    path = F.regexp_replace(F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1), "/$", "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    ordered = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: p != "")), "&")
    return F.when(ok, F.concat(F.lit("https://"), host, path, F.when(ordered != "", F.concat(F.lit("?"), ordered)).otherwise(""))).otherwise(url)


def post_id(url: Column, params: list[str], words: str = "view|board|detail|read|notice") -> Column:
    """Id of a post: the first of the query parameters, then the number after a path word, then a number that ends the path."""
    found = [first_match(url, rf"[?&]{p}=([^&#]+)", 1) for p in params]
    return first_of(*found, first_match(url, rf"/(?:{words})/([0-9]+)", 1), first_match(url, r"/([0-9]+)/?(?:[?#].*)?$", 1))


def stable_id(prefix: Column, seed: Column, digits: int = 16) -> Column:
    return F.concat(F.lit("doc_"), prefix, F.lit("_"), F.substring(F.sha2(seed, 256), 1, digits))


def name_key(x: Column) -> Column:
    """Lower case, letters and digits alone."""
    return F.lower(F.regexp_replace(x, r"[^A-Za-z0-9\x{AC00}-\x{D7AF}]", ""))


def clean_cell(x: Column) -> Column:
    """One line, pipes escaped, spaces collapsed; null is ""."""
    return F.coalesce(F.trim(F.regexp_replace(F.replace(F.regexp_replace(x, r"[\r\n]+", " "), F.lit("|"), F.lit(r"\|")), r"\s+", " ")), F.lit(""))


def replaced(x: Column, rules: list[tuple[str, str]]) -> Column:
    """Regex rules in order."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, x)


def half_width(x: Column) -> Column:
    """Full-width ASCII as ASCII."""
    return F.translate(x, "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)), "".join(map(chr, range(0x21, 0x7F))))


def html_cleaned(x: Column) -> Column:
    """Common entities decoded, zero-width characters gone, lines trimmed, at most one blank line in a row."""
    decoded = reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")], x)
    lines = F.transform(F.split(F.regexp_replace(decoded, r"[\x{200B}-\x{200D}\x{FEFF}]", ""), "\n", -1), lambda p: F.trim(F.regexp_replace(p, r"[ \t]+", " ")))
    return F.trim(F.regexp_replace(F.array_join(lines, "\n"), r"\n\n\n+", "\n\n"))


def citations(x: Column, patterns: list[str], longest: int = 200, n: int = 15) -> Column:
    """Matches of all patterns, trimmed, distinct in order, not ``longest`` or longer, the first n."""
    found = F.flatten(F.array(*[all_matches(x, p, 1) for p in patterns]))
    return F.slice(F.array_distinct(F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: (s != "") & (F.char_length(s) < longest))), 1, n)


def confidence(x: Column, sources: Column, law: str) -> Column:
    """0.5, and 0.05 a source up to 0.2, 0.05 each for a year, an amount and a percentage, 0.1 for a term of law; 1 at most."""
    bonus = lambda pattern, points: F.when(x.rlike(pattern), points).otherwise(0.0)
    return F.least(F.lit(1.0), 0.5 + F.least(0.05 * sources, F.lit(0.2)) + bonus("(19|20)[0-9][0-9]", 0.05) + bonus("[0-9] ?(USD|EUR|[$])|[$] ?[0-9]", 0.05) + bonus("[0-9] ?%", 0.05) + bonus(law, 0.1))


def keywords(x: Column, pattern: str, stop: list[str], shortest: int = 2) -> Column:
    words = all_matches(F.lower(x), pattern)
    return F.filter(words, lambda w: (F.char_length(w) >= shortest) & ~w.isin(stop))


def expanded(x: Column, synonyms: list[tuple[str, str]], suffixes: list[str], pattern: str, stop: list[str], n: int = 5) -> Column:
    """The query, synonyms put in both ways, its first two keywords paired, and with suffixes; distinct, n + 1 at most."""
    swaps = [F.when(x.contains(a), F.replace(x, F.lit(a), F.lit(b))) for p in synonyms for a, b in (p, p[::-1])]
    k = F.transform(F.array(keywords(x, pattern, stop)), lambda ks: F.when(F.size(ks) > 1, F.concat_ws(" ", ks[0], ks[1])))[0]
    tails = [F.concat(k, F.lit(" "), F.lit(s)) for s in suffixes]
    return F.slice(F.array_distinct(F.array_compact(F.array(x, *swaps, *tails))), 1, n + 1)


def decomposed(title: Column, summary: Column, templates: list[str], pattern: str, n: int = 6) -> Column:
    """Templates filled with the title, then with the first words of the summary; the first n."""
    filled = [F.replace(F.lit(t), F.lit("{}"), title) for t in templates]
    more = F.transform(F.slice(all_matches(summary, pattern), 1, 3), lambda w: F.concat(title, F.lit(" "), w))
    return F.slice(F.concat(F.array(*filled), more), 1, n)


def summary(parts: Column, default: str, length: int = 200, n: int = 2) -> Column:
    text = F.array_join(F.transform(F.slice(parts, 1, n), lambda p: F.substring(p, 1, length)), " | ")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


#: Date notations, the more specific first.
DATES = [("iso", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"), ("dotted", r"[0-9]{4}\.[0-9]{1,2}\.[0-9]{1,2}"), ("slashed", r"[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}"), ("hangul", r"[0-9]{4}년 ?[0-9]{1,2}월 ?[0-9]{1,2}일"), ("short", r"\b[0-9]{2}\.[0-9]{2}\.[0-9]{2}\b"), ("compact", r"\b20[0-9]{6}\b")]


def date_notations(x: Column, at_least: int = 3) -> Column:
    """Names of the notations that occur often enough."""
    return F.array_compact(F.array(*[F.when(count(x, p) >= at_least, n) for n, p in DATES]))


def first_date(x: Column) -> Column:
    return first_of(*[first_match(x, p) for _, p in DATES])


def parsed_date(x: Column) -> Column:
    """The first of Y-M-D (also with dots and slashes), YY-M-D (20YY) and the Hangul form, as a date; null if none is a day."""
    y4 = r"([0-9]{4})[-./]([0-9]{1,2})[-./]([0-9]{1,2})"
    y2 = r"(?:^|[^0-9])([0-9]{2})[-./]([0-9]{1,2})[-./]([0-9]{1,2})"
    ko = r"([0-9]{4})년 ?([0-9]{1,2})월 ?([0-9]{1,2})일"
    part = lambda p, i: F.regexp_extract(x, p, i)
    made = lambda p, century="": F.when(x.rlike(p), F.try_to_date(F.concat(F.lit(century), part(p, 1), F.lit("-"), F.lpad(part(p, 2), 2, "0"), F.lit("-"), F.lpad(part(p, 3), 2, "0")), "yyyy-MM-dd"))
    return F.coalesce(made(y4), made(ko), made(y2, "20"))


def extracted_number(x: Column) -> Column:
    """The first number of a cell, thousands separators aside; null if there is none."""
    return first_match(F.replace(x, F.lit(","), F.lit("")), r"-?[0-9]+(?:\.[0-9]+)?").try_cast("double")


def unit(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(x, F.lit(","), F.lit("")), r"-?[0-9]+(?:\.[0-9]+)?", ""))


def boolean(x: Column, true: list[str]) -> Column:
    return F.coalesce(F.lower(F.trim(x)).isin(true), F.lit(False))


def empty_cell(x: Column) -> Column:
    return F.coalesce(F.trim(x).isin("", "-", "–", "N/A"), F.lit(True))


def weighted(scores: dict[str, float]) -> Column:
    """Weighted sum of columns, held to 0..1; null counts 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in scores.items()])))


def impact(score: Column) -> Column:
    return F.when(score > 0.7, "high").when(score > 0.4, "medium").otherwise("low")


def _cron(cron: Column) -> tuple[Column, Column, Column, Column]:
    """(five fields?, minutes of the day, day of month, weekday); a field that isn't a number counts as 0, ``*`` as null."""
    part = F.split(F.trim(cron), " ")
    number = lambda i: F.coalesce(F.regexp_extract(F.get(part, i), r"^([0-9]{1,4})", 1).try_cast("int"), F.lit(0))
    day = lambda i: F.when(F.get(part, i) != "*", number(i))
    return F.size(part) == 5, number(1) * 60 + number(0), day(2), day(4)


def _at(day: Column, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes, day.cast("timestamp"))


def next_run(cron: Column, as_of: Column) -> Column:
    """The first time after ``as_of`` of a cron text that is daily, on a weekday (0 is Sunday) or on a day of the month, in any month; null for all others.

    A day that the month lacks runs over into the next month.
    """
    ok, minutes, day, weekday = _cron(cron)
    any_month = F.get(F.split(F.trim(cron), " "), 3) == "*"
    today = as_of.cast("date")
    later = lambda first, second: F.when(_at(first, minutes) > as_of, _at(first, minutes)).otherwise(_at(second, minutes))
    on_weekday = F.date_add(today, F.pmod(weekday - (F.dayofweek(today) - 1), F.lit(7)))
    in_month = F.date_add(F.trunc(today, "month"), day - 1)
    after = F.date_add(F.add_months(F.trunc(in_month, "month"), 1), F.day(in_month) - 1)
    weekly = F.when(weekday <= 6, later(on_weekday, F.date_add(on_weekday, 7)))
    return F.when(ok & any_month, F.when(day.isNotNull(), later(in_month, after)).when(weekday.isNotNull(), weekly).otherwise(later(today, F.date_add(today, 1))))


def next_runs(cron: Column, as_of: Column, n: int = 7, days: int = 30) -> Column:
    """The first ``n`` times after ``as_of`` within ``days`` days, its own the first; the month's field isn't looked at, a day of month goes before a weekday."""
    ok, minutes, day, weekday = _cron(cron)
    times = F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: _at(F.date_add(as_of.cast("date"), i), minutes))
    fits = lambda x: F.when(day.isNotNull(), F.day(x) == day).when(weekday.isNotNull(), F.dayofweek(x) - 1 == weekday).otherwise(True)
    return F.when(ok, F.slice(F.filter(times, lambda x: fits(x) & (x > as_of)), 1, n)).otherwise(F.array().cast("array<timestamp>"))


def json_array(x: Column, n: int = 10) -> Column:
    """array<string> out of free text: the JSON array in it, else its lines without bullets that are over three characters."""
    found = F.from_json(F.regexp_extract(x, r"(?s)\[.*\]", 0), "array<string>")
    lines = F.filter(F.transform(F.split(x, "\n"), lambda p: F.trim(F.regexp_replace(p, r"^\s*(?:[-*•]|[0-9]+[.)])\s*", ""))), lambda p: F.char_length(p) > 3)
    return F.slice(F.coalesce(found, lines), 1, n)


def json_object(x: Column, schema: str) -> Column:
    """A struct out of free text: the fenced block, else from the first brace to the last; null if neither parses."""
    strict = {"mode": "PERMISSIVE"}
    return F.coalesce(F.from_json(first_match(x, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), schema, strict), F.from_json(first_match(x, r"(?s)\{.*\}"), schema, strict))


def actions(x: Column, categories: list[str], n: int = 5) -> Column:
    """array<struct<text, category>>: the numbered items, each with the category of its place."""
    items = F.slice(all_matches(x, r"(?m)^\s*[0-9]+[.)]\s*(.+)$", 1), 1, n)
    names = F.array(*map(F.lit, categories))
    return F.transform(items, lambda t, i: F.struct(F.trim(t).alias("text"), F.get(names, F.least(i, F.lit(len(categories) - 1))).alias("category")))
