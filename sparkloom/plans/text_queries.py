"""Text expressions, dates and rule-based quality on documents, pages, orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import quality, text
from sparkloom.operators import ranking
from sparkloom.plans.registry import Registry, table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


def _text():
    return F.col("text")



def _docs(name, column, sql, out="x"):
    """A query of one expression over whole documents."""

    @R.add(name, f"SELECT doc_id, {sql} AS {out} FROM documents")
    def _(spark, d):
        return table(spark, d, "documents").select("doc_id", column().alias(out))


N = lambda p: f"len(regexp_extract_all(text, '{p}'))"

_docs("s10_token_estimate", lambda: text.token_estimate(_text(), "[aeiou]"), f"ceil({N('[aeiou]')} / 1.7 + (length(text) + {N('[^\\x00-\\x{FFFF}]')} - {N('[aeiou]')}) / 4.0)::BIGINT")
_docs("s11_token_fallback", lambda: F.floor(F.char_length("text") / 2), "(length(text) // 2)::BIGINT")
_docs("s12_without_controls", lambda: F.md5(text.without_controls(F.concat(_text(), F.lit("\x01\x0b")))), "md5(text)")
_docs("s13_squeezed", lambda: F.md5(text.squeezed(_text())), "md5(trim(regexp_replace(text, '\\s+', ' ', 'g')))")
_docs("s22_clean_cell", lambda: F.md5(text.clean_cell(_text())), "md5(trim(regexp_replace(replace(regexp_replace(text, '[\\r\\n]+', ' ', 'g'), '|', '\\|'), '\\s+', ' ', 'g')))")
_docs("s23_postprocessed", lambda: F.md5(text.half_width(text.replaced(_text(), [(r"\*\*\*|%%%|###|&&&", ""), (r"[ \t]+", " "), (r"\n\n+", "\n")]))), "md5(regexp_replace(regexp_replace(regexp_replace(text, '\\*\\*\\*|%%%|###|&&&', '', 'g'), '[ \\t]+', ' ', 'g'), '\\n\\n+', chr(10), 'g'))")
_docs("s25_citations", lambda: F.array_join(text.citations(_text(), ["(Th[a-z]+)", "([A-Z]{3,})"]), "|"), "array_to_string((list_filter(x, lambda v, i: list_position(x, v) = i))[1:15], '|') AS x FROM (SELECT doc_id, list_filter(list_transform(list_concat(regexp_extract_all(text, '(Th[a-z]+)', 1), regexp_extract_all(text, '([A-Z]{3,})', 1)), lambda s: trim(s)), lambda s: s <> '' AND length(s) < 200) AS x FROM documents) --")
_docs("s29_keyword_count", lambda: F.size(text.keywords(_text(), "[a-z0-9]+", ["the", "and", "of"])).cast("long"), "len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 2 AND w NOT IN ('the', 'and', 'of')))")
_docs("s33_token_estimate_words", lambda: text.token_estimate_words(_text(), "[àâçéèêëîïôûùüÿñæœäöß]"), f"ceil(2.5 * {N('[àâçéèêëîïôûùüÿñæœäöß]')} + 0.4 * {N('[A-Za-z]+')} + 0.5 * len(regexp_extract_all(regexp_replace(text, '[àâçéèêëîïôûùüÿñæœäöß]', '', 'g'), '[^A-Za-z\\s]')))::BIGINT")
_docs("c30_decoding_score", lambda: F.round(quality.decoding_score(_text()), 6), "round(0.6 * (length(text) - len(regexp_extract_all(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f\\x{E000}-\\x{F8FF}]'))) / length(text) + 0.4 * (1 - len(regexp_extract_all(text, '\\x{FFFD}')) / length(text)), 6)")

_BULLETS = "-•○※ㅇ□▶▷◆◇★☆►◎⦁⦾"


def _rules(frm, key, script="[A-Za-z]"):
    """Counts (k), scores of the parts (s) and the total (t) by the published steps; doubled letters are spelled out, as backreferences are unknown here."""
    n = lambda p: f"len(regexp_extract_all(text, '{p}'))"
    doubled = lambda chars: "(?:" + "|".join(c + c for c in chars) + "){4}"
    control = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{FFFD}]"
    listed = f"(?m)^[ \\t\\r\\f]*(?:[{_BULLETS}][ \\t\\r\\f]*\\S|[0-9]+[.)]|\\([가-힣0-9]+\\))"
    average = "CASE WHEN words / ends BETWEEN 5 AND 30 THEN 1.0 WHEN words / ends BETWEEN 3 AND 50 THEN 0.7 ELSE 0.4 END"
    return f"""d AS ({frm}),
 u AS (SELECT {key}, ch, i, lag(ch) OVER w AS before, lead(ch) OVER w AS c1, lead(ch, 2) OVER w AS c2, lead(ch, 3) OVER w AS c3, lead(ch, 4) OVER w AS c4
  FROM (SELECT {key}, unnest(string_split(text, '')) AS ch, unnest(range(length(text))) AS i FROM d) WINDOW w AS (PARTITION BY {key} ORDER BY i)),
 r AS (SELECT {key}, count(*) AS runs FROM u WHERE ch <> chr(10) AND before IS DISTINCT FROM ch AND ch = c1 AND ch = c2 AND ch = c3 AND ch = c4 GROUP BY 1),
 k AS (SELECT {key}, text, length(text)::DOUBLE AS n, {n('\\S')}::DOUBLE AS solid, {n(script)}::DOUBLE AS script, {n('[가-힣]')}::DOUBLE AS hangul, {n('[0-9]')}::DOUBLE AS digits, {n('[A-Za-z]')}::DOUBLE AS latin,
  {n(control)}::DOUBLE AS broken, length(trim(text, ' ' || chr(9) || chr(10) || chr(13))) AS stripped, {n('\\S+')}::DOUBLE AS words, {n('\\n')} + 1.0 AS lines, {n('(?m)^[^\\n|]*[|][^\\n|]*[|]')}::DOUBLE AS table_lines,
  {n(listed)}::DOUBLE AS list_lines, {n('[.!?。]\\s')}::DOUBLE AS ends, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ' || chr(9) || chr(13))), lambda l: l <> '') AS filled,
  coalesce(runs, 0)::DOUBLE AS runs, {n('<[^>]+>')} AS tags, {n(doubled('ABCDEFGHIJKLMNOPQRSTUVWXYZ') + '|' + doubled('0123456789'))} AS pairs, {n('[\\x{E000}-\\x{F8FF}]')}::DOUBLE AS private,
  {n('[\\x00-\\x1f]')}::DOUBLE AS unseen FROM d LEFT JOIN r USING ({key})),
 s AS (SELECT *, script / solid AS ratio, CASE WHEN (digits / solid > 0.15 OR latin / solid > 0.20) AND script / solid >= 0.05 THEN CASE WHEN script / solid >= 0.20 THEN 1.0 WHEN script / solid >= 0.10 THEN 0.8 ELSE 0.6 END
   WHEN script / solid BETWEEN 0.55 AND 0.90 THEN 1.0 WHEN script / solid BETWEEN 0.40 AND 0.95 THEN 0.7 WHEN script / solid > 0.95 THEN 0.1 WHEN script / solid >= 0.25 THEN 0.5 WHEN script / solid >= 0.15 THEN 0.3 ELSE 0.1 END AS p_script,
  1.0 - least(broken / n * 5, 1.0) AS p_broken, greatest(0.0, 1.0 - runs / greatest(n / 100, 1.0) * 0.2) AS p_repetition,
  CASE WHEN n >= 100 AND (pairs >= 5 OR broken / n > 0.1 OR hangul / solid < 0.01 AND private / solid > 0.3) THEN 0.0 ELSE 1.0 END AS p_encoding,
  CASE WHEN words < 10 THEN 0.5 WHEN table_lines >= 3 THEN CASE WHEN table_lines / lines >= 0.2 THEN 1.0 ELSE 0.9 END WHEN list_lines >= 3 THEN CASE WHEN list_lines / lines >= 0.2 THEN 1.0 ELSE 0.85 END
   WHEN ends > 0 THEN {average} WHEN len(filled) >= 5 AND list_avg(list_transform(filled, lambda l: length(l))) BETWEEN 10 AND 200 THEN 0.7 ELSE 0.5 END AS p_sentence,
  CASE WHEN script / solid BETWEEN 0.55 AND 0.90 THEN 1.0 WHEN script / solid BETWEEN 0.40 AND 0.95 THEN 0.7 WHEN script / solid BETWEEN 0.25 AND 0.40 THEN 0.4 ELSE 0.1 END AS page_script,
  CASE WHEN ends > 0 AND words >= 10 THEN {average} ELSE 0.5 END AS page_sentence, CASE WHEN tags = 0 THEN 1.0 ELSE greatest(0.3, 1.0 - tags * 0.1) END AS page_tags FROM k)"""


_OF_DOCS = _rules("SELECT doc_id, text FROM documents", "doc_id")
_OVERALL = "CASE WHEN stripped < 10 THEN 0.0 ELSE round((0.30 * p_script + 0.25 * p_broken + 0.15 * p_sentence + 0.10 * p_repetition + 0.20 * p_encoding)::DOUBLE, 4) END"


@R.add("c27_quality_score", f"WITH {_OF_DOCS} SELECT doc_id, {', '.join(f'round(p_{p}::DOUBLE, 4) AS {p}' for p in quality.WEIGHTS)}, {_OVERALL} AS overall FROM s")
def _(spark, d):
    found = table(spark, d, "documents").select("doc_id", quality.details(_text(), quality.LATIN).alias("q"))
    return found.select("doc_id", *[F.round(F.col("q")[p], 4).alias(p) for p in quality.WEIGHTS], "q.overall")


# A third of the texts is damaged: doubled capitals, controls, private characters.
_DAMAGED = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN text || repeat('AABBCCDD 1 ', 5) WHEN 1 THEN text || repeat(chr(1), (length(text) / 3)::INT) WHEN 2 THEN text || repeat(chr(57345), (length(text) // 2)::INT)
 WHEN 3 THEN left(text, 8) ELSE text END AS text FROM documents"""


@R.add("c29_quality_gate", f"""WITH {_rules(_DAMAGED, 'doc_id')}, g AS (SELECT *, (n - unseen - private) / n AS fit FROM s),
 h AS (SELECT *, fit * 0.5 + ratio * 0.3 + (1 - broken / n) * 0.2 AS total FROM g),
 v AS (SELECT doc_id, CASE WHEN stripped < 10 THEN 'short' WHEN pairs >= 5 THEN 'doubled' WHEN broken / n > 0.1 THEN 'broken' WHEN private / solid > 0.15 THEN 'private' WHEN ratio < 0.05 AND fit < 0.5 THEN 'invalid' WHEN total < 0.5 THEN 'poor' END AS reason, total FROM h)
 SELECT doc_id, reason IS NULL AS valid, round(CASE reason WHEN 'short' THEN 0 WHEN 'doubled' THEN 0.1 WHEN 'broken' THEN 0.2 WHEN 'private' THEN 0.2 WHEN 'invalid' THEN 0.3 ELSE total END, 6)::DOUBLE AS score, reason FROM v""")
def _(spark, d):
    third = F.col("doc_id") % 6
    tail = lambda x, n: F.concat(_text(), F.repeat(F.lit(x), n))
    text = F.when(third == 0, tail("AABBCCDD 1 ", F.lit(5))).when(third == 1, tail("\x01", F.round(F.char_length("text") / 3).cast("int")))
    text = text.when(third == 2, tail("\ue001", F.floor(F.char_length("text") / 2).cast("int"))).when(third == 3, F.left("text", F.lit(8))).otherwise(_text())
    return table(spark, d, "documents").select("doc_id", quality.gate(text, quality.LATIN).alias("g")).select("doc_id", "g.*")


@R.add("c35_retry_advice", f"""WITH {_OF_DOCS} SELECT doc_id, array_to_string(list_filter([CASE WHEN p_script < 0.9 THEN 'language' END, CASE WHEN p_sentence < 0.9 THEN 'layout' END, CASE WHEN p_repetition < 0.9 THEN 'engine' END], lambda x: x IS NOT NULL), ',') AS advice FROM s""")
def _(spark, d):
    scored = table(spark, d, "documents").select("doc_id", quality.details(_text(), quality.LATIN).alias("q"))
    found = quality.advice({p: F.col("q")[p] for p in quality.WEIGHTS}, 0.9, {"script": "language", "sentence": "layout", "repetition": "engine"})
    return scored.select("doc_id", F.array_join(found, ",").alias("advice"))


@R.add("c28_page_quality", f"""WITH {_rules('SELECT page_id, html AS text FROM pages', 'page_id')} SELECT page_id, CASE WHEN stripped < 10 THEN 0.0 ELSE round((0.30 * page_script + 0.25 * p_broken + 0.20 * page_sentence + 0.15 * page_tags + 0.10)::DOUBLE, 4) END AS score FROM s""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", quality.page_score(F.col("html"), quality.LATIN).alias("score"))


# Documents of a source and language are what engines made of one file, in the order of their numbers; every seventh failed.
@R.add("c32_best_engine", """WITH c AS (SELECT source || '/' || lang AS file, doc_id, CASE WHEN doc_id % 7 > 0 THEN round(1.0 * len(regexp_extract_all(text, '[A-Za-z]')) / greatest(length(text), 1), 6) END AS q FROM documents),
 b AS (SELECT file, min(doc_id) FILTER (q >= 0.81) AS first, arg_max(doc_id, (q, -doc_id)) FILTER (q IS NOT NULL) AS best FROM c GROUP BY 1)
 SELECT b.file, coalesce(first, best) AS best, q AS quality, (SELECT count(*) FROM c x WHERE x.file = b.file AND (first IS NULL OR x.doc_id <= first)) AS tried FROM b LEFT JOIN c ON c.file = b.file AND doc_id = coalesce(first, best)""")
def _(spark, d):
    q = F.round(1.0 * text.count(_text(), "[A-Za-z]") / F.greatest(F.char_length("text"), F.lit(1)), 6)
    c = table(spark, d, "documents").select(F.concat_ws("/", "source", "lang").alias("file"), "doc_id", F.when(F.col("doc_id") % 7 > 0, q).alias("q"))
    return ranking.best_of_engines(c, "file", "doc_id", "doc_id", "q", 0.81).select("file", F.col("doc_id").alias("best"), F.col("q").alias("quality"), "tried")


_MESSAGE = "CASE event_id % 7 WHEN 0 THEN 'Request timed out' WHEN 1 THEN 'got 503 from host' WHEN 2 THEN 'JSON syntax' WHEN 3 THEN 'ECONNRESET on socket' WHEN 4 THEN 'no such element' WHEN 5 THEN 'odd' ELSE event_type END"


@R.add("s14_error_class", f"""SELECT event_id, CASE WHEN regexp_matches(m, 'timeout|timed out') THEN 'timeout' WHEN regexp_matches(m, 'http|status code|\\b[45][0-9][0-9]\\b') THEN 'http' WHEN regexp_matches(m, 'pars|json|syntax') THEN 'parsing' WHEN regexp_matches(m, 'network|econn|socket|dns') THEN 'network' WHEN regexp_matches(m, 'selector|element|dom\\b') THEN 'dom' ELSE 'unknown' END AS class FROM (SELECT event_id, lower({_MESSAGE}) AS m FROM events)""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", text.error_class(F.expr(_MESSAGE)).alias("class"))


@R.add("s18_normalized_url", """SELECT page_id, 'https://' || lower(regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '')) || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/$', '')
 || CASE WHEN regexp_extract(url, '\\?([^#]*)', 1) <> '' THEN '?' || array_to_string(list_sort(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')), '&') ELSE '' END AS url FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", text.normalized_url(F.col("url")).alias("url"))


@R.add("s6_distinct_urls", "SELECT min(page_id) AS page_id, lower(regexp_replace(url, '[?#].*$', '')) AS url FROM pages GROUP BY 2")
def _(spark, d):
    return table(spark, d, "pages").groupBy(F.lower(F.regexp_replace("url", "[?#].*$", "")).alias("url")).agg(F.min("page_id").alias("page_id"))


@R.add("s19_post_id", "SELECT page_id, coalesce(nullif(regexp_extract(url, '[?&]id=([^&#]+)', 1), ''), nullif(regexp_extract(url, '[?&]no=([^&#]+)', 1), ''), nullif(regexp_extract(url, '/(?:view|board)/([0-9]+)', 1), ''), nullif(regexp_extract(url, '/([0-9]+)/?(?:[?#].*)?$', 1), '')) AS post FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", text.post_id(F.col("url"), ["id", "no"], "view|board").alias("post"))


@R.add("s20_stable_ids", "SELECT doc_id, 'doc_' || source || '_' || substr(sha256(text), 1, 16) AS key, substr(md5(text), 1, 16) AS print FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.stable_id(F.col("source"), _text()).alias("key"), F.substring(F.md5("text"), 1, 16).alias("print"))


@R.add("s21_name_key", "SELECT p_partkey, lower(regexp_replace(p_name || ' ' || p_brand, '[^A-Za-z0-9]', '', 'g')) AS key FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", text.name_key(F.concat_ws(" ", "p_name", "p_brand")).alias("key"))


@R.add("s24_html_cleaned", """WITH c AS (SELECT page_id, replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS x FROM pages)
 SELECT page_id, md5(trim(regexp_replace(array_to_string(list_transform(string_split(x, chr(10)), lambda p: trim(regexp_replace(p, '[ \\t]+', ' ', 'g'))), chr(10)), '\\n\\n\\n+', chr(10) || chr(10), 'g'))) AS x FROM c""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.html_cleaned(F.col("html"))).alias("x"))


@R.add("s26_confidence", "SELECT doc_id, round(least(1.0, 0.5 + least(0.05 * len(list_distinct(regexp_extract_all(text, '[A-Z]{4,}'))), 0.2) + CASE WHEN regexp_matches(text, '(19|20)[0-9][0-9]') THEN 0.05 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9] ?(USD|EUR|[$])|[$] ?[0-9]') THEN 0.05 ELSE 0 END + CASE WHEN regexp_matches(text, '[0-9] ?%') THEN 0.05 ELSE 0 END + CASE WHEN regexp_matches(text, 'License') THEN 0.1 ELSE 0 END), 6)::DOUBLE AS score FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(text.confidence(_text(), F.size(F.array_distinct(text.all_matches(_text(), "[A-Z]{4,}"))), "License"), 6).alias("score"))


@R.add("s3_ordered_distinct", "SELECT doc_id, array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), ' ') AS words FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+') AS x FROM documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_distinct(text.all_matches(_text(), "[A-Z][a-z]+")), " ").alias("words"))


@R.add("s27_expanded_query", """WITH x AS (SELECT item_id, lower(text) AS x FROM benchmark), k AS (SELECT item_id, x, list_filter(regexp_extract_all(x, '[a-z]+'), lambda w: length(w) >= 2 AND w NOT IN ('the', 'of')) AS ks FROM x),
 a AS (SELECT item_id, list_filter([x, CASE WHEN contains(x, 'the') THEN replace(x, 'the', 'this') END, CASE WHEN contains(x, 'this') THEN replace(x, 'this', 'the') END, CASE WHEN contains(x, 'and') THEN replace(x, 'and', 'also') END,
  CASE WHEN contains(x, 'also') THEN replace(x, 'also', 'and') END, CASE WHEN len(ks) > 1 THEN ks[1] || ' ' || ks[2] || ' law' END, CASE WHEN len(ks) > 1 THEN ks[1] || ' ' || ks[2] || ' plan' END], lambda q: q IS NOT NULL) AS qs FROM k),
 d AS (SELECT item_id, list_filter(qs, lambda q, i: list_position(qs, q) = i)[1:6] AS qs FROM a) SELECT item_id, (i - 1)::INT AS pos, qs[i] AS query FROM d, unnest(range(1, len(qs) + 1)) t(i)""")
def _(spark, d):
    found = text.expanded(F.lower("text"), [("the", "this"), ("and", "also")], ["law", "plan"], "[a-z]+", ["the", "of"])
    return table(spark, d, "benchmark").select("item_id", F.posexplode(found).alias("pos", "query"))


@R.add("s28_decomposed_query", "SELECT item_id, array_to_string(list_concat(['what is ' || t, 'why ' || t, t || ' effects', t || ' costs'], list_transform(regexp_extract_all(text, '[A-Z][a-z]{3,}')[1:3], lambda w: t || ' ' || w))[1:6], '|') AS queries FROM (SELECT item_id, text, substr(text, 1, 20) AS t FROM benchmark)")
def _(spark, d):
    found = text.decomposed(F.substring("text", 1, 20), _text(), ["what is {}", "why {}", "{} effects", "{} costs"], "[A-Z][a-z]{3,}")
    return table(spark, d, "benchmark").select("item_id", F.array_join(found, "|").alias("queries"))


@R.add("s30_summary", "SELECT source, coalesce(nullif(string_agg(substr(text, 1, 200), ' | ' ORDER BY doc_id), ''), 'none') AS summary FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 2) GROUP BY 1")
def _(spark, d):
    from sparkloom.operators.ranking import top_n

    two = top_n(table(spark, d, "documents"), ["source"], [F.col("doc_id")], 2)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "text"))), lambda x: x["text"])
    return two.groupBy("source").agg(text.summary(parts, "none").alias("summary"))


_DATED = "strftime(o_orderdate, '%Y-%m-%d') || ' to ' || strftime(o_orderdate + INTERVAL 3 DAY, '%Y.%m.%d') || ' and ' || strftime(o_orderdate + INTERVAL 5 DAY, '%Y-%m-%d') || ', ' || strftime(o_orderdate + INTERVAL 9 DAY, '%Y-%m-%d')"


def _dated():
    day = lambda n, f: F.date_format(F.date_add(F.to_date("o_orderdate"), n), f)
    return F.concat(day(0, "yyyy-MM-dd"), F.lit(" to "), day(3, "yyyy.MM.dd"), F.lit(" and "), day(5, "yyyy-MM-dd"), F.lit(", "), day(9, "yyyy-MM-dd"))


@R.add("s31_date_notations", f"SELECT o_orderkey, array_to_string(list_filter([CASE WHEN len(regexp_extract_all(x, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) >= 3 THEN 'iso' END, CASE WHEN len(regexp_extract_all(x, '[0-9]{{4}}\\.[0-9]{{1,2}}\\.[0-9]{{1,2}}')) >= 3 THEN 'dotted' END], lambda v: v IS NOT NULL), ',') AS notations FROM (SELECT o_orderkey, {_DATED} AS x FROM orders)")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.array_join(text.date_notations(_dated()), ",").alias("notations"))


@R.add("s32_first_date", f"SELECT o_orderkey, regexp_extract(x, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AS found FROM (SELECT o_orderkey, {_DATED} AS x FROM orders)")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.first_date(_dated()).alias("found"))


@R.add("s34_search_queries", "SELECT item_id, t || ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z]{5,}')[1:3], ' ') || CASE WHEN contains(lower(text), 'that') THEN ' law' ELSE '' END AS query FROM (SELECT item_id, text, substr(text, 1, 12) AS t FROM benchmark)")
def _(spark, d):
    words = F.array_join(F.slice(text.all_matches(F.lower("text"), "[a-z]{5,}"), 1, 3), " ")
    return table(spark, d, "benchmark").select("item_id", F.concat(F.substring("text", 1, 12), F.lit(" "), words, F.when(F.lower("text").contains("that"), " law").otherwise("")).alias("query"))


@R.add("s35_id_fallback", "SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END, ''), nullif(c_mktsegment, ''), 'none') AS title FROM customer")
def _(spark, d):
    name = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise("")
    return table(spark, d, "customer").select("c_custkey", F.coalesce(F.nullif(name, F.lit("")), F.nullif("c_mktsegment", F.lit("")), F.lit("none")).alias("title"))


_FORMS = "CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y.%-m.%-d') WHEN 2 THEN strftime(o_orderdate, '%Y') || '년 ' || strftime(o_orderdate, '%-m') || '월 ' || strftime(o_orderdate, '%-d') || '일' ELSE 'no date' END"


@R.add("d1_parsed_date", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders")
def _(spark, d):
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    form = F.when(k == 0, F.date_format(day, "yyyy-MM-dd")).when(k == 1, F.date_format(day, "yyyy.M.d")).when(k == 2, F.concat(F.year(day).cast("string"), F.lit("년 "), F.month(day).cast("string"), F.lit("월 "), F.day(day).cast("string"), F.lit("일"))).otherwise("no date")
    return table(spark, d, "orders").select("o_orderkey", F.date_format(text.parsed_date(form), "yyyy-MM-dd").alias("day"))


@R.add("d2_published_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def _(spark, d):
    loose = F.date_format("o_orderdate", "yyyy/M/d")
    part = lambda i: F.lpad(F.regexp_extract(loose, "([0-9]{4})[./-]([0-9]{1,2})[./-]([0-9]{1,2})", i), 2 if i > 1 else 4, "0")
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws("-", part(1), part(2), part(3)).alias("day"))


@R.add("d3_month_sequence", "SELECT o_custkey, strftime(unnest(generate_series(date_trunc('month', min(o_orderdate)), max(o_orderdate), INTERVAL 1 MONTH)), '%Y-%m') AS month FROM orders GROUP BY 1")
def _(spark, d):
    bounds = table(spark, d, "orders").groupBy("o_custkey").agg(F.trunc(F.to_date(F.min("o_orderdate")), "month").alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    return bounds.select("o_custkey", F.explode(F.transform(F.sequence("a", "b", F.expr("interval 1 month")), lambda x: F.date_format(x, "yyyy-MM"))).alias("month"))


@R.add("d4_calendar_keys", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m') AS month, ts::DATE >= DATE '2024-01-30' - 7 AS last_7, ts::DATE >= DATE '2024-01-30' - 30 AS last_30 FROM events")
def _(spark, d):
    since = lambda n: F.to_date("ts") >= F.date_sub(F.lit("2024-01-30").cast("date"), n)
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy-MM").alias("month"), since(7).alias("last_7"), since(30).alias("last_30"))


@R.add("d5_next_run", "SELECT n_nationkey, strftime(TIMESTAMP '2024-01-20' + to_hours(n_nationkey % 24) + CASE WHEN n_nationkey % 24 > 12 THEN INTERVAL 0 DAY ELSE INTERVAL 1 DAY END, '%Y-%m-%d %H:%M') AS next FROM nation")
def _(spark, d):
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    today = F.timestamp_add("HOUR", (F.col("n_nationkey") % 24), F.date_trunc("day", now))
    nxt = F.when(today > now, today).otherwise(F.timestamp_add("DAY", F.lit(1), today))
    return table(spark, d, "nation").select("n_nationkey", F.date_format(nxt, "yyyy-MM-dd HH:mm").alias("next"))


@R.add("d16_next_runs", "SELECT n_nationkey, strftime(x, '%Y-%m-%d') AS day FROM (SELECT n_nationkey, unnest(generate_series(TIMESTAMP '2024-01-20', TIMESTAMP '2024-02-18', INTERVAL 1 DAY)) AS x FROM nation) WHERE dayofweek(x) = n_nationkey % 7 QUALIFY row_number() OVER (PARTITION BY n_nationkey ORDER BY x) <= 3")
def _(spark, d):
    start = F.lit("2024-01-20").cast("date")
    days = F.filter(F.sequence(start, F.date_add(start, 29), F.expr("interval 1 day")), lambda x: F.dayofweek(x) - 1 == F.col("n_nationkey") % 7)
    return table(spark, d, "nation").select("n_nationkey", F.explode(F.transform(F.slice(days, 1, 3), lambda x: F.date_format(x, "yyyy-MM-dd"))).alias("day"))


# Cron texts out of the order keys: daily, weekly, on a day of the month, and in one month alone; as of the order's day and a minute of it.
_CRON = """SELECT o_orderkey, o_orderkey % 4 AS form, to_minutes((o_orderkey // 7) % 24 * 60 + (o_orderkey // 4) % 60) AS clock, o_orderkey % 7 AS weekday, (o_orderkey % 31)::INT AS day,
 date_trunc('day', o_orderdate) AS today, date_trunc('day', o_orderdate) + to_minutes(o_orderkey % 1440) AS now FROM orders"""


def _crons(spark, d):
    k = F.col("o_orderkey")
    whole = lambda x: x.cast("long").cast("string")
    time = F.concat_ws(" ", whole(F.floor(k / 4) % 60), whole(F.floor(k / 7) % 24))
    weekday, day = whole(k % 7), whole(k % 31 + 1)
    rest = F.when(k % 4 == 0, F.lit("* * *")).when(k % 4 == 1, F.concat(F.lit("* * "), weekday)).when(k % 4 == 2, F.concat(day, F.lit(" * *"))).otherwise(F.concat(day, F.lit(" 3 *")))
    now = F.timestamp_add("MINUTE", (k % 1440).cast("int"), F.date_trunc("day", "o_orderdate").cast("timestamp"))
    return table(spark, d, "orders").select("o_orderkey", F.concat_ws(" ", time, rest).alias("cron"), now.alias("now"))


@R.add("d5_next_run_of_crons", f"""WITH c AS ({_CRON}), b AS (SELECT *, today + to_days(((weekday - dayofweek(today) + 7) % 7)::INT) AS w, date_trunc('month', today) + to_days(day) AS m FROM c)
 SELECT o_orderkey, strftime(CASE form WHEN 0 THEN CASE WHEN today + clock > now THEN today + clock ELSE today + INTERVAL 1 DAY + clock END WHEN 1 THEN CASE WHEN w + clock > now THEN w + clock ELSE w + INTERVAL 7 DAY + clock END
 WHEN 2 THEN CASE WHEN m + clock > now THEN m + clock ELSE date_trunc('month', m) + INTERVAL 1 MONTH + to_days(day(m)::INT - 1) + clock END END, '%Y-%m-%d %H:%M') AS next FROM b""")
def _(spark, d):
    return _crons(spark, d).select("o_orderkey", F.date_format(text.next_run(F.col("cron"), F.col("now")), "yyyy-MM-dd HH:mm").alias("next"))


@R.add("d16_next_runs_of_crons", f"""WITH c AS ({_CRON}), r AS (SELECT o_orderkey, form, weekday, day, now, today + to_days(i::INT) + clock AS x FROM c, range(0, 30) t(i))
 SELECT o_orderkey, strftime(x, '%Y-%m-%d %H:%M') AS next FROM r WHERE x > now AND CASE form WHEN 0 THEN true WHEN 1 THEN dayofweek(x) = weekday ELSE day(x) = day + 1 END QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY x) <= 7""")
def _(spark, d):
    runs = text.next_runs(F.col("cron"), F.col("now"))
    return _crons(spark, d).select("o_orderkey", F.explode(F.transform(runs, lambda x: F.date_format(x, "yyyy-MM-dd HH:mm"))).alias("next"))


@R.add("d6_weighted_score", "SELECT doc_id, round(least(1, greatest(0, 0.6 * quality + 0.5 * toxic)), 6)::DOUBLE AS score FROM labels")
def _(spark, d):
    return table(spark, d, "labels").select("doc_id", F.round(text.weighted({"quality": 0.6, "toxic": 0.5}), 6).alias("score"))


@R.add("d7_number_and_unit", "SELECT p_partkey, round(p_retailprice, 2) AS number, 'kg' AS unit FROM part")
def _(spark, d):
    cell = F.concat(F.format_number("p_retailprice", 2), F.lit(" kg"))
    return table(spark, d, "part").select("p_partkey", text.extracted_number(cell).alias("number"), text.unit(cell).alias("unit"))


@R.add("d8_booleans", "SELECT l_orderkey, l_linenumber, l_partkey, lower(l_returnflag) IN ('a', 'r') AS flag, l_linestatus = 'O' AS empty FROM lineitem")
def _(spark, d):
    status = F.when(F.col("l_linestatus") == "O", F.lit(" - ")).otherwise("x")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.boolean(F.concat(F.lit(" "), "l_returnflag"), ["a", "r"]).alias("flag"), text.empty_cell(status).alias("empty"))


@R.add("d9_impact", "SELECT event_id, CASE WHEN value / 500 > 0.7 THEN 'high' WHEN value / 500 > 0.4 THEN 'medium' ELSE 'low' END AS impact FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", text.impact(F.col("value") / 500).alias("impact"))


@R.add("d12_json_array", """WITH f AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN [regexp_replace(substr(text, 1, 20), '[\\\\"\\n]', ' ', 'g'), 'two']
  ELSE list_filter(list_transform(string_split(concat('1. first line', chr(10), '- ', substr(text, 1, 30), chr(10), 'no'), chr(10)), lambda p: trim(regexp_replace(p, '^\\s*(?:[-*•]|[0-9]+[.)])\\s*', ''))), lambda p: length(p) > 3) END[1:10] AS xs FROM benchmark)
 SELECT item_id, (i - 1)::INT AS pos, xs[i] AS item FROM f, unnest(range(1, len(xs) + 1)) t(i)""")
def _(spark, d):
    free = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit('Sure: ["'), F.regexp_replace(F.substring("text", 1, 20), '[\\\\"\\n]', " "), F.lit('", "two"] done'))).otherwise(F.concat(F.lit("1. first line\n- "), F.substring("text", 1, 30), F.lit("\nno")))
    return table(spark, d, "benchmark").select("item_id", F.posexplode(text.json_array(free)).alias("pos", "item"))


@R.add("d13_json_object", "SELECT event_id, event_type AS kind, round(value, 2) AS score FROM events")
def _(spark, d):
    body = F.to_json(F.struct(F.col("event_type").alias("kind"), F.round("value", 2).alias("score")))
    free = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```\nbye"))).otherwise(F.concat(F.lit("I think "), body, F.lit(" fits")))
    found = text.json_object(free, "kind string, score double")
    return table(spark, d, "events").select("event_id", found["kind"].alias("kind"), found["score"].alias("score"))


@R.add("d14_metadata_map", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def _(spark, d):
    m = F.from_json(F.to_json(F.from_json("props", "map<string,string>")), "map<string,string>")
    return table(spark, d, "events").select("event_id", m["k"].cast("long").alias("k"))


@R.add("d15_actions", """WITH l AS (SELECT doc_id, array_to_string(list_transform(string_split(text, '. '), lambda p, i: i || '. ' || p), chr(10)) AS t FROM documents),
 m AS (SELECT doc_id, regexp_extract_all(t, '(?m)^\\s*[0-9]+[.)]\\s*(.+)$', 1)[1:5] AS xs FROM l) SELECT doc_id, trim(xs[i]) AS text, (['now', 'soon', 'later'])[least(i, 3)] AS category FROM m, unnest(range(1, len(xs) + 1)) t(i)""")
def _(spark, d):
    lines = F.array_join(F.transform(F.split("text", r"\. "), lambda p, i: F.concat((i + 1).cast("string"), F.lit(". "), p)), "\n")
    return table(spark, d, "documents").select("doc_id", F.inline(text.actions(lines, ["now", "soon", "later"])))


@R.add("i17_flattened", "SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS \"props.k\" FROM events")
def _(spark, d):
    from sparkloom.sources.nested import flattened

    return flattened(table(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k long").alias("props")))


@R.add("i18_nested_value", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@R.add("i5_path_keys", "SELECT page_id, regexp_extract(url, '^https?://([^/]+)/', 1) AS org, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS board FROM pages")
def _(spark, d):
    from sparkloom.sources.nested import path_keys

    return table(spark, d, "pages").select("page_id", *path_keys(F.col("url"), r"^https?://([^/]+)/", r"^https?://[^/]+/([a-z]+)/"))


@R.add("i3_coalesced_text", "SELECT doc_id, text FROM documents")
def _(spark, d):
    from sparkloom.sources.nested import document_text

    k = F.col("doc_id") % 5
    raw = F.when(k == 0, F.to_json(F.struct(_text().alias("extracted_text")))).when(k == 1, F.to_json(F.struct(F.struct(_text().alias("text")).alias("content")))).when(k == 2, F.to_json(F.struct(_text().alias("text")))).when(k == 3, F.to_json(F.struct(F.array(F.struct(_text().alias("content"))).alias("sections"), F.lit("other").alias("text")))).otherwise(_text())
    return table(spark, d, "documents").select("doc_id", document_text(raw).alias("text"))


@R.add("i15_export_rows", "SELECT doc_id, replace(text, chr(10), '\\n') AS content, vec_id IS NOT NULL AS has_embedding FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def _(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "embeddings").select("vec_id"), F.col("vec_id") == F.col("doc_id"), "left")
    return joined.select("doc_id", F.replace("text", F.lit("\n"), F.lit("\\n")).alias("content"), F.col("vec_id").isNotNull().alias("has_embedding"))


@R.add("i16_export_preview", "SELECT count(*) AS chunks, sum(ceil(length(text) / 4))::BIGINT AS tokens, round(avg(length(text)), 2) AS mean_length, round(count(*) * (avg(length(text)) + 500), 0) AS json_bytes, round(count(*) * (avg(length(text)) + 200), 0) AS csv_bytes FROM documents")
def _(spark, d):
    n, mean = F.count("*"), F.avg(F.char_length("text"))
    return table(spark, d, "documents").agg(n.alias("chunks"), F.sum(F.ceil(F.char_length("text") / 4)).alias("tokens"), F.round(mean, 2).alias("mean_length"), F.round(n * (mean + 500), 0).alias("json_bytes"), F.round(n * (mean + 200), 0).alias("csv_bytes"))


@R.add("i13_backup", "SELECT vec_id, label, len(embedding) AS dimension FROM embeddings")
def _(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.size("embedding").cast("long").alias("dimension"))


@R.add("i19_taxonomy", "WITH u AS (SELECT p_type AS code, 1 AS level, min(p_partkey) AS first FROM part GROUP BY 1 UNION ALL SELECT p_type || '/' || p_name, 2, min(p_partkey) FROM part GROUP BY 1) SELECT code, level, first FROM u")
def _(spark, d):
    from sparkloom.operators.ranking import latest_version

    parts = table(spark, d, "part")
    levels = parts.select(F.col("p_type").alias("code"), F.lit(1).alias("level"), F.col("p_partkey").alias("first")).unionByName(parts.select(F.concat_ws("/", "p_type", "p_name").alias("code"), F.lit(2).alias("level"), F.col("p_partkey").alias("first")))
    return latest_version(levels, ["code"], [F.col("first")])
