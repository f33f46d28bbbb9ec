"""DuckDB SQL for the queries that SQL can express, over the same tables."""

OP4 = r"""WITH k AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS crc),
 d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, '') AS key FROM documents),
 c AS (SELECT doc_id, key, strlen(text) + 16 AS size, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1]), 4294967295)) AS text_crc32 FROM d, k),
 r AS (SELECT doc_id, key, size, text_crc32, s, -ln((('0x' || md5(key || ':' || s)[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) AS score FROM c, range(41) t(s)),
 g AS (SELECT doc_id, key, size, text_crc32, arg_min(s, (score, s)) FILTER (s < 40)::INT AS shard, arg_min(s, (score, s))::INT AS grown_shard FROM r GROUP BY 1, 2, 3, 4)
 SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY ('0x' || md5(key)[1:8])::BIGINT % 64, doc_id, text_crc32) - 1 AS slot, grown_shard FROM g"""

OP6 = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
 x AS (SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS following, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS following_id FROM d WINDOW w AS (ORDER BY doc_id DESC, text ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 t AS (SELECT doc_id, 0 AS edited, text FROM d UNION ALL SELECT doc_id, 1, substr(text, 1, n - n // 3) || substr(following, 1, n // 3) FROM x),
 p AS (SELECT doc_id, edited, text, list_transform(string_split(text, chr(10)), lambda line: list_transform(regexp_extract_all(line, '(?s).{1,48}'), lambda s: md5(s))) AS leaves FROM t),
 n AS (SELECT doc_id, edited, text, list_transform(leaves, lambda hs: {'body': array_to_string(list_transform(hs, lambda h: h[1:8]), '.'), 'h': md5(array_to_string(hs, ''))}) AS ps, list_distinct(list_transform(flatten(leaves), lambda h: h[1:8])) AS known FROM p),
 e AS (SELECT *, list_filter(range(1, len(ps) + 1), lambda i: i = len(ps) OR ('0x' || ps[i].h[1:8])::BIGINT % 8 = 0) AS ends FROM n),
 s AS (SELECT *, list_transform(range(1, len(ends) + 1), lambda j: ps[CASE WHEN j > 1 THEN ends[j - 1] ELSE 0 END + 1:ends[j]]) AS runs FROM e),
 h AS (SELECT *, list_transform(runs, lambda r: {'h': md5(array_to_string(list_transform(r, lambda q: q.h), '')), 'body': array_to_string(list_transform(r, lambda q: q.body), ',')}) AS ss FROM s),
 f AS (SELECT doc_id, edited, text, known, md5(array_to_string(list_transform(ss, lambda q: q.h), '')) || ';' || array_to_string(list_transform(ss, lambda q: q.h[1:8] || ':' || q.body), ';') AS fp FROM h)
 SELECT x.doc_id, x.n AS n_chars, sha256(b.text) AS edited_sha256, a.fp AS fingerprint, b.fp AS edited_fingerprint,
 CASE WHEN a.fp[1:32] = b.fp[1:32] THEN 1.0 ELSE coalesce(2.0 * len(list_intersect(a.known, b.known)) / nullif(len(a.known) + len(b.known), 0), 0) END::DOUBLE AS near_edited,
 CASE WHEN a.fp[1:32] = c.fp[1:32] THEN 1.0 ELSE coalesce(2.0 * len(list_intersect(a.known, c.known)) / nullif(len(a.known) + len(c.known), 0), 0) END::DOUBLE AS near_next
 FROM x JOIN f a ON a.doc_id = x.doc_id AND a.edited = 0 JOIN f b ON b.doc_id = x.doc_id AND b.edited = 1 JOIN f c ON c.doc_id = x.following_id AND c.edited = 0"""

OP7 = r"""WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)(?:</article>|$)', 1), '</?b>', '', 'g'), '<[^>]*(>|$)', ' ', 'g') AS x FROM pages),
 e AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM a)
 SELECT page_id, url, text, length(text) AS n_chars FROM e"""


OP12 = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
 w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
 f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
  FROM w, range(1, 5) t(m)) GROUP BY 1, 2, 3),
 c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1 AND f >= 30),
 k AS (SELECT c.*, k, array_to_string(ws[1:k], ' ') AS first_part, array_to_string(ws[k + 1:], ' ') AS rest FROM c, range(1, 4) t(k) WHERE k < m),
 s AS (SELECT k.lang, k.phrase, a, min({'score': (2000000::HUGEINT * a // (x.f + y.f)::HUGEINT)::BIGINT, 'k': k, 'l': x.f, 'r': y.f}) AS b
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = first_part AND x.m = k JOIN f y ON y.lang = k.lang AND y.phrase = rest AND y.m = k.m - k GROUP BY 1, 2, 3),
 i AS (SELECT lang, phrase, max(a) AS longest FROM (SELECT lang, a, array_to_string(ws[j:j + n - 1], ' ') AS phrase FROM c, range(2, 4) t(n), range(1, 4) u(j) WHERE n < m AND j + n - 1 <= m) GROUP BY 1, 2),
 t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1),
 r AS (SELECT s.lang, s.phrase, a, b, row_number() OVER (PARTITION BY s.lang ORDER BY b.score DESC, a DESC, encode(s.phrase)) AS rank
  FROM s LEFT JOIN i ON i.lang = s.lang AND i.phrase = s.phrase WHERE longest IS NULL OR 100 * longest < 80 * a)
 SELECT r.lang, rank, phrase, a, b.l AS l, b.r AS r, n, b.score AS score FROM r JOIN t ON t.lang = r.lang WHERE rank <= 2000"""


def _op11(entries: int = 16, parts: int = 8, rounds: int = 6) -> str:
    """k-means of the parts in whole numbers, a few views for each round; every sum fits in 64 bits on the given tables."""
    steps = [
        f"""b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM v
  WHERE vec_id IN (SELECT DISTINCT vec_id FROM v ORDER BY 1 LIMIT {entries}))"""
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""a{i} AS MATERIALIZED (SELECT vec_id, p, min({{'d': d, 'e': e}}) AS best FROM (SELECT v.vec_id, v.p, b.e,
  list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i]))) AS d FROM v JOIN b{i} b ON b.p = v.p) GROUP BY 1, 2)"""
        )
        if i < rounds:
            steps.append(
                f"""s{i} AS (SELECT a.p, a.best.e AS e, j, sum(v.x[j]) AS s, count(*) AS n FROM a{i} a JOIN v ON v.vec_id = a.vec_id AND v.p = a.p,
  range(1, {64 // parts} + 1) t(j) GROUP BY 1, 2, 3),
 m{i} AS (SELECT p, e, list(((s - ((s % n + n) % n)) // n)::BIGINT ORDER BY j) AS x FROM s{i} GROUP BY 1, 2),
 b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m ON m.p = b.p AND m.e = b.e)"""
            )
    return f"""WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 v AS MATERIALIZED (SELECT vec_id, p, x[len(x) // {parts} * p + 1:len(x) // {parts} * (p + 1)] AS x FROM k, range({parts}) t(p)),
 {(',' + chr(10) + ' ').join(steps)},
 c AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY 1),
 h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
 SELECT vec_id, k.label, code, error, sum(error) OVER (PARTITION BY k.label)::BIGINT AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), h"""


def _op13() -> str:
    """Every rule over every text: a lazy gap before each match gives the matches' places."""
    from sparkloom.llm.secret_scans import BASE, MORE

    either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    keys = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
    assign = f"({keys})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    each = []
    for rank, rule in enumerate(BASE + MORE):
        pattern = (assign if rule.kind == "assign" else rule.pattern).replace("'", "''")
        sizes = lambda g, p=pattern: f"list_transform(regexp_extract_all(text, '(?s:(.*?))({p})', {g}), lambda x: length(x))"
        each.append(
            f"SELECT id, {rank} AS rank, '{rule.kind}' AS kind, {rule.least} AS least, {sizes(1)} AS gap, {sizes(2)} AS whole, {sizes(rule.group + 2)} AS part FROM d"
        )
    return f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
 m AS ({' UNION ALL '.join(each)}),
 x AS (SELECT id, rank, kind, least, part[i] AS part, list_sum(gap[1:i])::BIGINT + coalesce(list_sum(whole[1:i - 1])::BIGINT, 0) AS b, whole[i] AS n FROM m, unnest(range(1, len(gap) + 1)) t(i)),
 s AS (SELECT id, rank, b, kind || ':' || b || ':' || (b + n) AS span FROM x WHERE part >= least),
 g AS (SELECT id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
  string_agg(span, ',' ORDER BY b, rank) FILTER (rank < 3) AS base, string_agg(span, ',' ORDER BY b, rank) AS spans FROM s GROUP BY 1)
 SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
 coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.id = d.id"""


#: By query. OP4 builds the CRC-32 table from its rule; OP7 reads the article by its tags, where the operator infers wrappers.
ORACLES = {"op4_sharding": OP4, "op6_fingerprints": OP6, "op7_html_text": OP7, "op11_vector_codes": _op11(), "op12_collocations": OP12, "op13_secret_scans": _op13()}
