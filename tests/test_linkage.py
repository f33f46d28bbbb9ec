"""Linkage against all pairs in plain Python, hot keys and their pairs, order of ties; keywords and classes against plain search."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import classify, joins, keywords, linkage

SCHEMA = "id long, path string, name string, fixed_params string, variable_params string, request_params array<string>, response_fields array<string>"
FIELDS = SCHEMA.replace(",", "").split()[::2]


def rows_of(rng, ids, paths, names, targets):
    for i in ids:
        target = rng.choice(targets)
        params = None if target is None else json.dumps({"target": target} if target != "-" else {"other": 1})
        yield (i, rng.choice(paths), rng.choice(names), params, rng.choice([None, "", "v"]), rng.choice([None, [], ["p"]]), rng.choice([[], ["r", "s"]]))


def base(path):
    return path.split("/")[-1].replace(".do", "", 1) if path else None


def points(a, b, words):
    target = [json.loads(x["fixed_params"]).get("target") if x["fixed_params"] else None for x in (a, b)]
    n = 100 * bool(a["path"] and a["path"] == b["path"]) + 80 * bool(a["path"] and b["path"] and base(a["path"]) == base(b["path"])) + 50 * bool(target[0] and target[0] == target[1])
    if a["name"] and b["name"]:
        x, y = a["name"].lower(), b["name"].lower()
        n += 40 * (a["name"] == b["name"]) + 20 * (x in y or y in x) + 10 * sum(w in x and w in y for w in words)
    return n


def plain(left, right, words):
    out, now = [], []
    for a in left:
        best, score = None, 0
        for b in right:
            if (s := points(a, b, words)) > score:
                best, score = b, s
        a = dict(a)
        if score >= 30:
            a |= {c: a[c] or (a[c] if best[c] is None else best[c]) for c in FIELDS[1:] if c != "name"}
        now.append(a)
        out.append((a["id"], best["id"] if score >= 30 else None, score if score >= 30 else None, False, a["path"], a["fixed_params"], a["request_params"]))
    for b in right:
        if all(points(a, b, words) < 50 for a in now):
            now.append(b)
            out.append((b["id"], None, None, True, b["path"], b["fixed_params"], b["request_params"]))
    return out


def found(spark, left, right, words):
    frames = [spark.createDataFrame(x, SCHEMA).repartition(3) for x in (left, right)]
    got = linkage.merged(*frames, linkage.Linkage(keywords=words))
    return [tuple(r) for r in got.select("id", "matched", "score", "appended", "path", "fixed_params", "request_params").collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    words = ("법령", "판례", "본문", "목록", "one", "two")
    names = [None, "", "법령 목록", "법령 목록 본문", "판례", "판례 one two 본문 목록 법령", "Two One", "ONE two", "x", "xy", "법령 본문 목록 판례 two", "행정 one"]
    paths = [None, "", "/", "/a/b.do", "/c/b.do", "/a/c.do.do", "/d/", "b", "/q/e.do", "/q/f"] + [f"/p/{i}.do" for i in range(6)]
    left = list(rows_of(rng, range(25), paths, names, [None, "-", "t1", "t2", "", "t3"]))
    own = [f"r{i} name {i}" for i in range(30)] + ["r1", "법령 r2 판례 name 본문", "법령 r2 판례 name 본문 x", "R2"]
    right = list(rows_of(rng, range(100, 125), paths, names, [None, "-", "t1", "t4"]))
    right += rows_of(rng, range(125, 165), [None, *(f"/s/r{i}.do" for i in range(20))], own, [None, None, *(f"r{i}" for i in range(12))])
    want = plain([dict(zip(FIELDS, r, strict=True)) for r in left], [dict(zip(FIELDS, r, strict=True)) for r in right], words)
    got = found(spark, left, right, words)
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(r[3] for r in got) and any(r[1] for r in got)


def test_pairs_grow_with_the_rows_where_all_share_a_base_name(spark):
    def pairs(n):
        of = lambda s: spark.range(n).select("id", F.concat(F.lit(f"/{s}/"), F.col("id") % 7, F.lit("/same.do")).alias("path"), F.concat(F.lit("name "), "id").alias("name"), F.lit('{"target":"t"}').alias("fixed_params"))
        a, b = (linkage.Linkage().features(of(s)) for s in ("l", "r"))
        assert linkage.matches(a, b).select("l_id", "r_id", "score").where("r_id = l_id or score = 130").count() == n
        return linkage.candidates(a, b).count()

    few, many = pairs(300), pairs(1200)
    assert many <= 5 * few and many <= 30 * 1200


def test_empty_sides(spark):
    row = [(1, "/a.do", "n", None, None, None, ["r"])]
    assert found(spark, [], row, ("w",)) == [(1, None, None, True, "/a.do", None, None)]
    assert found(spark, row, [], ("w",)) == [(1, None, None, False, "/a.do", None, None)]


def test_first_independent_keeps_what_a_walk_in_order_keeps(spark):
    rng = random.Random(2)
    keys = [(i, f"k{rng.randrange(40)}") for i in range(100) for _ in range(rng.randrange(3))] + [(i, f"c{i // 2}") for i in range(200, 220)] + [(i, f"d{(i + 1) // 2}") for i in range(200, 220)]
    ids = [*range(100), *range(200, 220), 999]
    kept, used = [], set()
    for i in ids:
        mine = {k for j, k in keys if j == i}
        if not mine & used:
            kept.append(i)
            used |= mine
    got = linkage.first_independent(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(keys, "id long, key string"))
    assert sorted(r.id for r in got.collect()) == kept


# Keywords


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_keyword_hits_equal_contains(spark, block):
    docs = spark.createDataFrame([(1, "She sells SEA shells"), (2, ""), (3, None), (4, "he İstanbul ß 법령집")], "id long, text string")
    words = spark.createDataFrame([("he", 1), ("she", 2), ("HE", 3), ("sea s", 4), ("", 5), (None, 6), ("법령", 7), ("ß", 8), ("absent", 9)], "word string, n int")
    got = keywords.keyword_hits(docs, "text", words, "word", block)
    want = docs.join(words, F.contains(F.lower("text"), F.lower("word")))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert keywords.keyword_hits(docs, "text", words.limit(0), "word").collect() == []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_classes_of_the_fixed_dictionary(spark):
    rows = [
        (1, "환경부", "공지", "입찰 공고 및 고시, 대기 수질 온실가스"), (2, "한국환경공단", "자료", "보도자료와 회의"), (3, None, None, None),
        (4, "서울시청 공단", "x", "시행령 제정 예고"), (5, "abc", "", "reach REACH ESG"), (6, "x", "y", "제정 개정 시행 점검"),
    ]
    df = spark.createDataFrame(rows, "id int, org string, board string, text string")
    by = classify.Dictionary()

    def plain(org, board, text):
        org, full = org or "", f"{org or ''} {board or ''} {text or ''}"
        score, kind = max(((sum(w in full for w in ws), -i), t) for i, (t, ws) in enumerate(by.types.items()))
        sectors = [s for s, ws in by.sectors.items() if any(w in full for w in ws)] or ["general"]
        depth = next((d for d, ws in by.depths.items() if any(w in org for w in ws)), "headquarters")
        phase = next((p for p, ws in by.phases.items() if any(w in full for w in ws)), None)
        told = dict.fromkeys(w for g in (by.types, by.sectors) for ws in g.values() for w in ws)
        return (kind if score[0] else "other", sectors, depth, phase, min(1.0, (score[0] + len(sectors)) / 5), [w for w in told if w in full][:10])

    got = {r["id"]: tuple(r["classified"]) for r in classify.classified(df, "text", "org", "board").collect()}
    assert got == {r[0]: plain(*r[1:]) for r in rows}
    assert got[3] == ("other", ["general"], "headquarters", None, 0.2, []) and got[4][2] == "agency"


def test_best_agreement_equals_all_pairs(spark):
    rng = random.Random(3)
    draw = lambda: (rng.choice(["n1", "n2", "n3", None]), rng.choice(["b1", "b2", None]), rng.choice([1, 2, None]))
    left, right = [(i, *draw()) for i in range(80)], [(i, *draw()) for i in range(80)]
    a, b = (spark.createDataFrame(x, f"{s}_id long, {s}_name string, {s}_brand string, {s}_size int") for s, x in (("a", left), ("b", right)))
    points = {c: (F.col(f"a_{c}"), F.col(f"b_{c}"), n) for c, n in (("name", 80), ("brand", 50), ("size", 20))}
    given = points, [("name",), ("brand", "size")], "a_id", "b_id", 70
    want = {}
    for x in left:
        scored = [(sum(n for i, n in ((1, 80), (2, 50), (3, 20)) if x[i] is not None and x[i] == y[i]), -y[0]) for y in right]
        if max(scored)[0] >= 70:
            want[x[0]] = max(scored)
    assert {r.a_id: (r.score, -r.b_id) for r in joins.linked_by_agreement(a, b, *given).collect()} == want
    assert joins.agreements(a, b, *given).count() <= 5 * len(left)  # all pairs of a hot key before
