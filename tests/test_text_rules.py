"""Quality and repair rules against their statements in plain Python, over Hangul, tables, lists, damage and odd white space."""

import base64
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import quality, repair
from sparkloom.operators import joins, ranking, tables
from sparkloom.sources import files

BULLETS = "-•○※ㅇ□▶▷◆◇★☆►◎⦁⦾"


def sample(seed):
    rng = random.Random(seed)
    parts = ["환경부 고시", "water quality", "2024", "1,234", "| a | b |", "- 항목", "1) 첫째", "(가) 둘째", "3.2 절", "끝났다. ", "Is it? ", "\n", "\n\n", "\t", " ", "　", "!!!!!!", "=====", "�", "\x01", "", "AABBCCDD", "11223344", "<b>", "漢字", "·"]
    weights = [rng.choice([0, 1, 1, 5]) for _ in parts]
    return "".join(rng.choices(parts, weights=[w + 0.01 for w in weights], k=rng.choice([1, 3, 20, 60, 200])))


TEXTS = [sample(i) for i in range(150)] + [None, "", "짧다", "가" * 9, "가나다라마바사아자차", "가 나 " * 30, "\n".join(["가나다라마바사아자차카타파하"] * 6), "문장이 끝난다. " * 12, "AABBCCDD EEFFGGHH 11223344 IIJJKKLL MMNNOOPP " + "x" * 80, "" * 200, "\x02" * 30 + "y" * 90]


def steps(ratio, low, rest):
    if 0.55 <= ratio <= 0.90:
        return 1.0
    if 0.40 <= ratio < 0.55 or 0.90 < ratio <= 0.95:
        return 0.7
    return next((v for least, v in low if least <= ratio < 0.40), rest)


def by_sentences(words, ends):
    mean = len(words) / len(ends)
    return 1.0 if 5 <= mean <= 30 else 0.7 if 3 <= mean <= 50 else 0.4


DOUBLED = re.compile(r"([A-Z])\1([A-Z])\2([A-Z])\3([A-Z])\4|([0-9])\5([0-9])\6([0-9])\7([0-9])\8")


def plain(text):
    text = text or ""
    solid, n, words, lines = re.sub(r"\s", "", text), len(text), text.split(), text.split("\n")
    ratio = len(re.findall("[가-힣]", text)) / len(solid) if solid else 0.0
    share = lambda f: sum(map(f, solid)) / len(solid) if solid else 0.0
    script = steps(ratio, [(0.25, 0.5), (0.15, 0.3)], 0.1)
    if (share(str.isdigit) > 0.15 or share(lambda c: c.isascii() and c.isalpha()) > 0.20) and ratio >= 0.05:
        script = 1.0 if ratio >= 0.20 else 0.8 if ratio >= 0.10 else 0.6
    broken = 1 - min(5 * (len(re.findall(r"[�\x00-\x08\x0b\x0c\x0e-\x1f]", text)) / n if n else 0), 1)
    ends = re.findall(r"[.!?。]\s", text)
    tabled = sum(line.count("|") >= 2 for line in lines)
    listed = sum(bool(re.match(rf"\s*[{BULLETS}]\s*\S", line) or re.match(r"\s*(\d+[.)]|\([가-힣\d]+\))", line)) for line in lines)
    full = [x.strip() for x in lines if x.strip()]
    if len(words) < 10:
        sentence = 0.5
    elif tabled >= 3:
        sentence = 1.0 if tabled / len(lines) >= 0.2 else 0.9
    elif listed >= 3:
        sentence = 1.0 if listed / len(lines) >= 0.2 else 0.85
    elif ends:
        sentence = by_sentences(words, ends)
    else:
        sentence = 0.7 if len(full) >= 5 and 10 <= sum(map(len, full)) / len(full) <= 200 else 0.5
    runs = len(re.findall(r"(.)\1{4,}", text))
    noise = sum(c < " " and c not in "\n\r\t" or c in "�￾￿" for c in text) / n if n else 0
    private = share(lambda c: "" <= c <= "")
    bad = n >= 100 and bool(solid) and (len(DOUBLED.findall(text)) >= 5 or noise > 0.1 or ratio < 0.01 and private > 0.3)
    parts = (script, broken, sentence, max(0, 1 - runs / max(n / 100, 1) * 0.2), 0.0 if bad else 1.0)
    total = round(sum(w * p for w, p in zip((0.30, 0.25, 0.15, 0.10, 0.20), parts, strict=True)), 4) if len(text.strip()) >= 10 else 0.0
    tags = len(re.findall("<[^>]+>", text))
    page = 0.3 * steps(ratio, [(0.25, 0.4)], 0.1) + 0.25 * broken + 0.2 * (by_sentences(words, ends) if ends and len(words) >= 10 else 0.5) + 0.15 * max(0.3, 1 - tags * 0.1) + 0.1
    fit = sum(c >= " " and not "" <= c <= "" for c in text) / n if n else 0
    points = fit * 0.5 + ratio * 0.3 + (1 - noise) * 0.2
    if len(text.strip()) < 10 or not solid:
        gate = (0.0, "short")
    elif len(DOUBLED.findall(text)) >= 5:
        gate = (0.1, "doubled")
    elif noise > 0.1:
        gate = (0.2, "broken")
    elif private > 0.15:
        gate = (0.2, "private")
    elif ratio < 0.05 and fit < 0.5:
        gate = (0.3, "invalid")
    else:
        gate = (points, None if points >= 0.5 else "poor")
    return parts, total, page if len(text.strip()) >= 10 else 0.0, gate


def test_scores_follow_the_rules(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    t = F.col("t")
    kinds = set()
    for r in df.select("i", quality.details(t).alias("d"), quality.page_score(t).alias("p"), quality.gate(t).alias("g"), quality.decoding_score(t).alias("c")).collect():
        parts, total, page, (points, reason) = plain(TEXTS[r.i])
        assert tuple(r.d)[:5] == pytest.approx(parts), (r.i, TEXTS[r.i])
        assert r.d.overall == pytest.approx(total, abs=1.1e-4) and r.p == pytest.approx(page, abs=1.1e-4)
        assert (r.g.valid, r.g.reason) == (reason is None, reason) and r.g.score == pytest.approx(points, abs=1e-6)
        assert r.c == pytest.approx(files.decoding_score(TEXTS[r.i] or ""))
        kinds.add(reason)
    assert kinds == {None, "short", "doubled", "broken", "private", "poor"} or {"short", "doubled", "broken", "private"} <= kinds


def test_repairs(spark):
    cases = {
        "1ㅇ5 2ㅇㅇ5": ("105 2005", 3), "1ㅇ5ㅇ3": ("105ㅇ3", 1), "총 1ㅇ 약 1ㅇㅇ.": ("총 10 약 100.", 3), "3.1ㅇ 0.ㅇ5": ("3.10 0.05", 2), "ㅇ5시": ("05시", 1), "ㅇㅇ구 ㅇㅇ동": ("ㅇㅇ구 ㅇㅇ동", 0), None: (None, 0),
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: tuple(r.z) for r in df.select("t", repair.zeros_and_count(F.col("t")).alias("z")).collect()} == cases
    doubled = "AABBCCDD " * 14  # even in bytes: each second byte twice
    han = "뷁" * 10 + "\x01" * 30 + "".join(chr(ord(b) << 8 | ord(a)) for a, b in zip("helloworldoftext"[::2], "helloworldoftext"[1::2], strict=True)) * 9
    got = spark.createDataFrame([(doubled,), (han,), ("fine text " * 20,), (None,)], "t string").select(repair.utf16_repaired(F.col("t")).alias("r")).collect()
    assert got[0].r.repaired and got[2].r == ("fine text " * 20, False) and got[3].r.text is None
    assert got[1].r.repaired and "helloworldoftext" in got[1].r.text


def test_decoding(spark):
    text = "한국어 문서입니다. 안녕하세요"
    assert files.decode(text.encode("euc-kr")) == (text, "euc-kr") and files.decode(text.encode()) == (text, "utf-8")
    assert files.decode("똠햏뷁샾".encode("cp949")) == ("똠햏뷁샾", "cp949") and files.decode(b"\xef\xbb\xbfx") == ("x", "utf-8")
    assert files.decode(text.encode("utf-16")) == (text, "utf-16") and files.decode(b"") == ("", "utf-8")
    assert files.decode(b"<meta charset=euc-kr>" + text.encode("euc-kr"))[1] == "euc-kr"


def test_containers_are_told_apart(spark):
    ole = bytes.fromhex("D0CF11E0") + b"\0" * 40
    heads = [b"PK\x03\x04" + b"...word/document.xml", b"PK\x03\x04mimetypeapplication/hwp+zip", b"PK\x03\x04x", ole + "FileHeader".encode("utf-16-le"), ole + "WordDocument".encode("utf-16-le"), ole, b"%PDF", b"", None]
    df = spark.createDataFrame([(i, bytearray(h) if h is not None else None) for i, h in enumerate(heads)], "i int, h binary")
    got = {r.i: r.k for r in df.select("i", files.container_kind(F.col("h")).alias("k")).collect()}
    assert [got[i] for i in range(9)] == ["docx", "hwpx", "zip", "hwp", "doc", "ole", None, None, None]


def test_header_rows_of_the_published_case(spark):
    rows = [["구분", "2024년", ""], ["", "금액", "증가율", "금액", "증가율"], ["A", "100", "10%", "120", "15%"]]
    df = spark.createDataFrame([(rows,), ([["a"]],), ([],), (None,)], "r array<array<string>>")
    assert [r.n for r in df.select(tables.header_rows(F.col("r")).alias("n")).collect()] == [2, 1, 1, 1]


def test_engines_stop_at_the_first_that_is_good_enough(spark):
    rows = [("a", i, q) for i, q in enumerate([0.2, None, 0.9, 0.95])] + [("b", i, q) for i, q in enumerate([0.5, 0.7, 0.7])] + [("c", 0, None)]
    df = spark.createDataFrame(rows, "f string, e int, q double")
    got = {tuple(r) for r in ranking.best_of_engines(df, "f", "e", "e", "q", 0.85).collect()}
    assert got == {("a", 2, 0.9, 3), ("b", 1, 0.7, 3), ("c", None, None, 1)}


def test_number_ranges(spark):
    units = spark.createDataFrame([(1, "I-A01~I-A05, C-B2"), (2, "i-a9"), (3, None), (4, "no numbers")], "u int, ranges string")
    facilities = spark.createDataFrame([(1, "I-A07"), (2, "X C-B99"), (3, "i-a1"), (4, None)], "f int, number string")
    got = {(r.f, r.u) for r in joins.by_number_range(facilities, units, "number", "ranges").collect()}
    assert got == {(1, 1), (2, 1), (3, 2)}


def test_letters_are_counted_without_a_list_of_them(spark):
    every = "".join(chr(i) for i in [*range(1, 0x3100), 0xAC00, 0xE001, 0xFFFD, 0xFFFE, 0x1F600])
    texts = [every, " \x0b\x85 ", "", "ab 1\x1c2 c", *filter(None, TEXTS)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    names = "n solid words stripped lines script digits broken private noise"
    for r in df.select("t", quality._counts(F.col("t"), quality.LATIN, names, lambda c: c).alias("c")).collect():
        spaces = re.compile(r"[\s\x1c-\x1f\x85\xa0]")
        solid = spaces.sub("", r.t)
        assert (r.c.n, r.c.solid, r.c.words) == (len(r.t), len(solid), len([w for w in spaces.split(r.t) if w]))
        assert (r.c.stripped, r.c["lines"], r.c.script, r.c.digits) == (len(r.t.strip()), r.t.count("\n") + 1, len(re.findall("[A-Za-z]", r.t)), len(re.findall(r"\d", r.t)))
        assert (r.c.broken, r.c.private, r.c.noise) == tuple(len(re.findall(p, r.t)) for p in ("[�\x00-\x08\x0b\x0c\x0e-\x1f]", "[-]", "[\x00-\x08\x0b\x0c\x0e-\x1f�-￿]"))
    plan = df.select(quality.details(F.col("t"), quality.LATIN))._jdf.queryExecution().toString()
    assert f"regexp_extract_all(x, {quality.LATIN}" not in plan and "regexp_extract_all" in plan and quality.LATIN not in "".join(re.findall(r"regexp_extract_all\([^,]*, [^,]*,", plan))


def test_each_row_has_a_file_and_all_are_read(spark, tmp_path):
    rows = [(i, base64.b64encode(b"x" * i).decode()) for i in range(50)] + [(50, None)]
    df = spark.createDataFrame(rows, "k long, body string")
    for path in (str(tmp_path / "a"), f"file://{tmp_path}/b"):
        files.write_each(df, "k", "body", path, 7)
        root = path.removeprefix("file://")
        assert max(len(names) for _, _, names in os.walk(root)) < 30 and len(os.listdir(root)) > 1  # no folder has them all
        for name in ("one.txt", "_hidden", ".hidden"):
            with open(f"{root}/{name}", "wb") as f:
                f.write(b"top")
        whole = {r.path: (r.length, bytes(r["head"])) for r in files.heads(spark, path, -1).collect()}
        assert all(p.startswith(path) for p in whole) and sorted(x for _, x in whole.values()) == sorted([b"top", b"", *[b"x" * i for i in range(50)]])
        assert {(n, x) for n, x in whole.values()} - {(3, b"top")} == {(i, b"x" * i) for i in range(50)}
        assert {bytes(r["head"]) for r in files.heads(spark, path, 2).collect()} == {b"to", b"", b"x", b"xx"}
        assert files.heads(spark, path, 8, "*.txt").count() == files.heads(spark, f"{path}/one.txt").count() == 1
    os.makedirs(tmp_path / "none")
    assert files.heads(spark, str(tmp_path / "none")).count() == 0


def test_decoding_holds_few_contents_as_texts(spark):
    texts = ["가나다" * n for n in range(40)] + [None]
    df = spark.createDataFrame([(i, None if t is None else bytearray(t.encode("cp949" if i % 2 else "utf-8"))) for i, t in enumerate(texts)], "k long, c binary")
    got = {r.k: r.text for r in files.decoded(df, "k", "c", limit=100).collect()}
    assert got == {i: t or "" for i, t in enumerate(texts)}
