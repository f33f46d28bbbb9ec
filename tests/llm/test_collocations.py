"""Collocations against plain counting; chunks that give every phrase once; nulls, ties, repeats, long pieces, empty tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import collocations
from sparkloom.llm.oracles import ORACLES
from sparkloom.llm.queries import queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALL = np.full(1 << collocations.BITS - 3, 255, np.uint8)


def pieces(text):
    for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
        if words := re.findall(r"[^ \t]+", piece):
            yield words


def counted(rows):
    f = [defaultdict(Counter) for _ in range(5)]
    for lang, text in rows:
        for words in pieces(text):
            for m in range(1, 5):
                f[m]["und" if lang is None else lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    return f


def plain(rows, least, share=80, top=2000):
    f, out = counted(rows), set()
    for lang in f[1]:
        n = f[1][lang].total()
        many = {p: c for m in (2, 3, 4) for p, c in f[m][lang].items() if c >= least}
        longest = defaultdict(int)
        for p, c in many.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longest[p[i : i + m]] = max(longest[p[i : i + m]], c)
        kept = []
        for p, a in many.items():
            cuts = [(2_000_000 * a // (f[k][lang][p[:k]] + f[len(p) - k][lang][p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if 100 * longest[p] < share * a or p not in longest:
                kept.append((-score, -a, " ".join(p).encode(), f[k][lang][p[:k]], f[len(p) - k][lang][p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n, -score))
    return out


def found(spark, rows, **settings):
    df = spark.createDataFrame([(i, lang, text, 7, "x") for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, n long, phrase string")
    got = [tuple(r) for r in collocations.collocations(df.repartition(3), **settings).collect()]
    assert len(set(got)) == len(got)
    return set(got)


def totals(chunks, m):
    langs, texts, last = zip(*chunks, strict=True)
    times = np.array(list(chunks.values()))
    rows = collocations.phrases(pa.array([c.decode() for c in texts]), pa.array(langs), np.array(last), times, m, ALL).to_pylist()
    got = {(r["lang"], r["phrase"]): r["f"] for r in rows}
    assert len(got) == len(rows)
    return got


def invented(seed, texts=40, words=9):
    rng = random.Random(seed)
    vocabulary = ["Of", "the", "sea", "çA", "ß", "A", "to", "'s", "中文", "x y"][:words]
    for _ in range(texts):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "!?", " , "]) for _ in range(rng.randrange(80)))
        yield rng.choice(["en", "de", None, "und", ""]), text


@pytest.mark.parametrize("every", [1, 2, 5, 16, 10**6])
def test_each_phrase_is_counted_once(every):
    rows = list(invented(every)) + [("en", "a " * 5000), ("en", "one")] + [("en", "x y z w v u t " * 30)] * 3
    chunks = Counter()
    for n, chunk, last in collocations.chunks([t for _, t in rows], every):
        chunks["und" if rows[n][0] is None else rows[n][0], chunk, last] += 1
    want = counted(rows)
    for m in range(1, 5):
        got = totals(chunks, m)
        assert got == {(lang, " ".join(p)): c for lang, by in want[m].items() for p, c in by.items()}


def test_phrases_of_one_hash_stay_apart(monkeypatch):
    chunks = Counter()
    rows = list(invented(9))
    for n, chunk, last in collocations.chunks([t for _, t in rows], 5):
        chunks["und" if rows[n][0] is None else rows[n][0], chunk, last] += 1
    want = [totals(chunks, m) for m in range(1, 5)]
    monkeypatch.setattr(collocations, "_joined", lambda h, word: np.zeros_like(h))
    assert [totals(chunks, m) for m in range(1, 5)] == want


def test_equal_passages_give_equal_chunks():
    rng = random.Random(3)
    passage = " ".join(f"w{rng.randrange(50)}" for _ in range(400))
    around = [" ".join(f"v{rng.randrange(50)}" for _ in range(rng.randrange(1, 60))) for _ in range(20)]
    texts = [f"{a} {passage} {b}" for a, b in zip(around, around[1:], strict=False)]
    by = Counter(c for _, c, _ in collocations.chunks(texts, 16))
    assert sum(1 for c, n in by.items() if n == len(texts)) >= 15 and all(c in (t + " ").encode() for t, c in [(texts[0], next(iter(by)))])


@pytest.mark.parametrize("least", [2, 5])
def test_ranks_equal_plain_counting(spark, least):
    rows = list(invented(11, 60, 6)) * 2 + [("en", "of the sea of the sea. the of, the of"), ("de", None), ("fr", ""), ("fr", "...")]
    assert found(spark, rows, least=least) == plain(rows, least)
    assert found(spark, rows, least=least, top=3, salts=2, every=2) == plain(rows, least, top=3)


def test_scores_stay_exact_where_products_pass_64_bits(spark):
    big = 1 << 45
    tables = [[("en", "a", big + 1), ("en", "b", big + 2)], [("en", "a b", big - 1)], [], []]
    frames = [spark.createDataFrame(t, "lang string, phrase string, f long") for t in tables]
    r = collocations._scored(frames).first()
    assert r.score == 2_000_000 * (big - 1) // (2 * big + 3)


def test_no_candidates_and_no_rows(spark):
    assert found(spark, [("en", "a b c d"), (None, None)]) == set()
    df = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(df).collect() == []


def test_the_query_equals_plain_counting_and_its_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    rows = con.sql("SELECT lang, text FROM documents").fetchall()
    got = {tuple(r) for r in queries()["op12_collocations"](spark, folder).collect()}
    assert got == plain(rows, 30) and got == set(con.sql(ORACLES["op12_collocations"]).fetchall())
