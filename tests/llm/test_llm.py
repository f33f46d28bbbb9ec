"""The operators against brute force, exact round trips and held-out accuracy; nulls, ties, repeats, empty tables, clashing names."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from sparkloom.llm import chat, common, components, decontamination, fingerprints, html_text, packing, quality, sharding, simhash, token_counts, toxicity, words
from sparkloom.llm.common import labelled_sample
from sparkloom.llm.queries import tokenizer_path

#: Nulls, an empty text, repeats, a very long line, extra columns whose names other code might use.
ROWS = [(1, "a b c d e f", "x", 1), (2, None, None, 2), (3, "", "x", None), (1, "a b c d e f", "x", 1), (None, "null id here", "y", 5), (7, "long " * 20000, "z", 7), (8, "ünï ços\n\nß 中文 " * 3, "z", 8)]
SCHEMA = "doc_id long, text string, score string, bucket long"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


# Sharding


def test_shards_follow_the_key_and_move_only_into_the_new_one(documents, odd, none):
    got = sharding.shard_table(documents, [1.0] * 40).toPandas()
    texts = dict(documents.select("doc_id", "text").collect())
    assert len(got) == len(texts)
    for r in got.itertuples():
        assert r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        hashes = [int(hashlib.md5(f"{r.doc_id}:{k}".encode()).hexdigest()[:13], 16) for k in range(41)]
        assert r.shard == max(range(40), key=lambda k: hashes[k]) and r.grown_shard == max(range(41), key=lambda k: hashes[k])
    assert ((got.grown_shard == got.shard) | (got.grown_shard == 40)).all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    got = sharding.shard_table(odd, [1.0] * 3).toPandas()
    assert len(got) == len(ROWS) and all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert sharding.shard_table(none, [1.0] * 3).count() == 0


def test_weights_set_the_shares(spark):
    got = sharding.assign(spark.range(20000).withColumnRenamed("id", "doc_id"), [1.0, 3.0, 0.0]).groupBy("shard").count().toPandas().set_index("shard")["count"]
    assert set(got.index) == {0, 1} and abs(got[1] / 20000 - 0.75) < 0.02


# Fingerprints


def test_fingerprints_equal_for_equal_texts_and_next_document(documents, odd, none):
    got = fingerprints.fingerprint_table(documents, ranges=7).toPandas().set_index("doc_id")
    rows = sorted(documents.select("doc_id", "text").collect(), reverse=True)
    by_text = {}
    for (i, text), (_, following) in zip(rows, [*rows[1:], rows[0]], strict=True):
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        r = got.loc[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert 0 <= r.near_next <= 1 and (r.near_edited == 1) == (edited == text)
    assert len(set(by_text.values())) == len(by_text)
    assert got.near_edited.median() > 0.5 > 0.1 > got.near_next.median()
    assert len(fingerprints.fingerprint_table(odd, ranges=3).collect()) == len(ROWS)
    assert fingerprints.fingerprint_table(none, ranges=3).count() == 0


def test_hot_and_missing_ids_are_dealt_by_their_texts(spark):
    from pyspark.sql import functions as F

    rows = [(k, f"text {k}") for k in range(60)] + [(30, f"hot {k}") for k in range(90)] + [(None, f"lost {k}") for k in range(80)] + [(7, "text 7")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    order = sorted(((r.doc_id is None, -(r.doc_id or 0), r.h), r.doc_id, r.text) for r in df.collect())
    want = sorted((str(a[1]), a[2], str(b[1]), b[2]) for a, b in zip(order, [*order[1:], order[0]], strict=True))
    for ranges in (1, 4, 30):
        got = fingerprints.with_next(df.drop("h"), "doc_id", "text", ranges, lambda x: x)
        assert sorted((str(r.doc_id), r.text, str(r["__next"].doc_id), r["__next"].text) for r in got.collect()) == want
    sizes = [r["count"] for r in fingerprints._ranges(df, "doc_id", "h", 30).groupBy("__range").count().collect()]
    assert max(sizes) <= 40


def test_branches_locate_an_edit(spark):
    lines = [f"paragraph number {i} says something of its own" for i in range(60)]
    other = lines[:30] + ["an inserted paragraph"] + lines[30:]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string").select(fingerprints.fingerprint("a").alias("a"), fingerprints.fingerprint("b").alias("b"))
    from pyspark.sql import functions as F

    changed, n, same = df.select(fingerprints.changed_sections(F.col("a"), F.col("b")), F.size(F.split("a", ";")) - 1, fingerprints.changed_sections(F.col("a"), F.col("a"))).first()
    assert same == [] and 1 <= len(changed) <= 2 < n


# SimHash


def brute_simhash(text):
    import xxhash

    ws = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not ws:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(pairs):
    """Least id of each row's group, from (id, fingerprint)."""
    fps = sorted({f for _, f in pairs})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 4 and find(a) != find(b):
            root[find(a)] = find(b)
    least = {}
    for i, f in pairs:
        least[find(f)] = min(x for x in (least.get(find(f)), i) if x is not None) if i is not None else least.get(find(f))
    return {f: least[find(f)] for f in fps}


@pytest.mark.parametrize("bucket", [2000, 3])
def test_simhash_groups_as_brute_force(documents, odd, none, bucket):
    for df in (documents, odd):
        rows = df.select("doc_id", "text").collect()
        pairs = [(i, brute_simhash(t)) for i, t in rows]
        want = brute_groups(pairs)
        got = simhash.near_groups(df, bucket=bucket).toPandas()
        assert len(got) == len(rows)
        for r in got.itertuples():
            assert (None if np.isnan(r.component) else int(r.component)) == want[r.fp % (1 << 64)]
        assert sorted(x % (1 << 64) for x in got.fp) == sorted(f for _, f in pairs)
    assert simhash.near_groups(none).count() == 0


def test_covering_masks_leave_no_pair_out():
    ms = simhash.masks(list(range(64)))
    random.seed(3)
    for _ in range(3000):
        differ = sum(1 << b for b in random.sample(range(64), 4))
        assert any(not m & differ for m in ms)


def test_hot_buckets_find_the_same_links(spark):
    random.seed(5)
    base = random.getrandbits(64)
    fps = {base ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 5))) for _ in range(400)} | {random.getrandbits(64) for _ in range(200)}
    df = spark.createDataFrame([(0, f - (1 << 64) if f >> 63 else f) for f in fps], "part int, fp long")
    from sparkloom.llm.components import components

    want = brute_groups([(i, f) for i, f in enumerate(sorted(fps))])
    groups = {}
    for f, g in want.items():
        groups.setdefault(g, set()).add(f)
    for bucket in (2000, 10):
        got = {}
        for r in components(simhash.near_links(df, bucket=bucket)).collect():
            got.setdefault(r.root, set()).add(r.node % (1 << 64))
        assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that simhash and components write, when no table counts as small."""
    seen = []
    for module in (simhash, components):
        monkeypatch.setattr(module, "staged", lambda df, name: seen.append((name, df._jdf.queryExecution().executedPlan().toString())) or common.staged(df, name))
        monkeypatch.setattr(module, "sized", lambda table, rows=0: table.hint("merge"), raising=False)
    return seen


def test_operator_3_broadcasts_no_table_by_its_guessed_size(spark, documents, plans):
    """The deal is 31 rows for one; sized as the fingerprints that it is made of, it was broadcast and filled the driver."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"
    found = simhash.near_groups_table(documents)
    plans.append(("result", found._jdf.queryExecution().executedPlan().toString()))
    assert {"buckets", "hooks", "roots"} <= {name for name, _ in plans}
    assert [name for name, plan in plans if "Broadcast" in plan] == []


def test_small_tables_are_told_by_their_rows(spark, tmp_path):
    spark.range(0, 5000, 1, 1).selectExpr("id", "7 as root").write.parquet(str(tmp_path / "table"))
    table, rows = spark.read.parquet(str(tmp_path / "table")), spark.range(10)
    plan = lambda most: rows.join(common.sized(table, most), "id", "left")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(5000) and "SortMergeJoin" in plan(4999) and "Broadcast" not in plan(4999)


def brute_copies(rows):
    """Least id of each row's group by the exact similarity of shingle sets."""
    sets = {}
    for _, text in rows:
        ws = __import__("re").split(r"[ \t-\r]+", (text or "").lower().strip())
        sets[text or ""] = {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}
    texts = sorted(sets)
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in itertools.combinations(texts, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and find(a) != find(b):
            root[find(a)] = find(b)
    least = {}
    for i, text in rows:
        if i is not None:
            least[find(text or "")] = min(i, least.get(find(text or ""), i))
    return least


def test_one_of_each_group_of_near_copies_stays(spark, documents, odd, none):
    random.seed(9)
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    long = [t for _, t in rows if len(t.split()) > 80][:12]
    for k, t in enumerate(long):  # copies of every kind: a word changed here and there, a line put in front, the same text
        for j in range(4):
            ws = t.split(" ")
            for _ in range(max(1, len(ws) // 90)):
                ws[random.randrange(len(ws))] = random.choice(["the", "xyz", "und"])
            rows.append((5000 + 10 * k + j, " ".join(ws)))
        rows.append((5000 + 10 * k + 9, t))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.keep_one(df)
    assert {r.doc_id for r in kept.collect()} == set(brute_copies(rows).values())
    assert simhash.keep_one(documents).columns == documents.columns
    assert sorted(str(r.doc_id) for r in simhash.keep_one(odd).collect()) == ["1", "1", "2", "7", "8", "None"]
    assert simhash.keep_one(none).count() == 0


def block_edited(base, new):
    """Copies of a text of distinct words at 0.8 and more: cut off, a block put in, a block replaced; and one cut off at under 0.8."""
    n = len(base)
    cut, put, swapped = base[: n * 85 // 100], base[: n // 3] + new[: n // 7] + base[n // 3 :], base[: n // 2] + new[: n // 16] + base[n // 2 + n // 16 :]
    return [cut, put, swapped], base[: n * 76 // 100]


def test_block_edited_copies_go(spark):
    rows = []
    for k in range(12):
        base = [f"w{k}x{i}" for i in range(120 + 40 * k)]
        near, far = block_edited(base, [f"n{k}x{i}" for i in range(200)])
        rows += [(100 * k + j, " ".join(ws)) for j, ws in enumerate([base, *near[:2]])]
        rows += [(100 * k + 50, " ".join(f"{w}y" for w in base)), (100 * k + 51, " ".join(f"{w}y" for w in near[2])), (100 * k + 52, " ".join(f"{w}y" for w in far))]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(brute_copies(rows).values())
    assert kept >= {100 * k for k in range(12)} and not kept & {100 * k + j for k in range(12) for j in (1, 2, 51)}


def test_copies_among_texts_of_the_same_words(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for k in range(60):  # one word set throughout, so one sketch of it; pairs of copies with a word changed here and there
        ws = [*rng.permutation(vocabulary), *rng.choice(vocabulary, 540)]
        rows.append((2 * k, " ".join(ws)))
        for at in range(70, 600, 60):
            ws[at] = ws[at - 7]
        rows.append((2 * k + 1, " ".join(ws)))
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(brute_copies(rows).values()) == set(range(0, 120, 2))


def test_copies_of_copies_in_a_large_group(spark):
    rng = np.random.default_rng(6)
    base = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(base))]
    for k in range(1, 61):  # edited twice: the first edit is a near copy of the base, the second of the first only
        ws = list(base)
        for step, key in ((6, 1000 + k), (9, 2000 + k)):
            for at in rng.choice(390, step, replace=False):
                ws[at] = f"e{key}x{at}"
            if k % 3 or key > 2000:
                rows.append((key, " ".join(ws)))
    roots = brute_copies(rows)
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(roots.values()) and 1 < len(kept) < len(rows) - 20


# Packing


def test_word_ids_equal_whole_texts(documents):
    encoder = words.WordIds(tokenizer_path("word_bpe_49k.json"))
    random.seed(1)
    pool = list("abcABC019 \t\n\r\x0b\x0c\x1c\x85  'stTdmlv.,!_-*|é́ÉñßİıΣςσÅ½²³ª中文가ㄱ😀‍٠ǅ𝔄") + ["'s", "'LL", "<|endoftext|>"]
    texts = ["".join(random.choices(pool, k=random.randint(0, 14))) for _ in range(3000)] + [t for (t,) in documents.select("text").limit(100).collect()]
    got = [x for i in range(0, len(texts), 50) for x in encoder.batch(texts[i : i + 50])]
    for t, x in zip(texts, got, strict=True):
        assert x.tolist() == encoder.whole.encode(t, add_special_tokens=False).ids, t


def test_packing_is_whole_gapless_and_tight(documents, odd, none):
    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = words.WordIds(path).whole
    for df in (documents, odd):
        got = packing.packed_table(df, path).toPandas()
        want = []
        for i, t in df.select("doc_id", "text").collect():
            ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
            want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())) for k in range(0, len(ids), 2048)]
        clean = [tuple(None if x != x else int(x) for x in r) for r in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
        assert sorted(clean, key=str) == sorted(want, key=str)
        for _, g in got.sort_values("offset").groupby("sequence_id"):
            assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
        assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1 + (got.length > 1024).sum() // 50
    assert packing.packed_table(none, path).count() == 0


def test_plan_puts_two_large_pieces_at_most():
    random.seed(2)
    for _ in range(200):
        capacity = random.choice([10, 64, 100])
        counts = {random.randint(1, capacity): random.randint(1, 30) for _ in range(random.randint(1, 12))}
        runs = packing.plan(counts, capacity)
        held = {}
        for n, holds in runs:
            assert n > 0 and sum(a * k for a, k in holds) <= capacity and sum(k for a, k in holds if a > capacity / 3) <= 2
            for a, k in holds:
                held[a] = held.get(a, 0) + n * k
        assert held == counts


# Classifiers


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.9), (toxicity, "toxic", 0.65)])
def test_classifiers_on_the_held_out_fold(spark, module, label, least, odd, none, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    weights = module.train(labelled_sample(docs, labels, label, 1000, 1 << 16), seen=9000)
    rows = docs.join(labels, "doc_id").where(f"{label} is not null").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    score = (lambda ts: module.score(weights, [t.encode() for t in ts])) if module is quality else (lambda ts: module.score(weights, ts))
    p, y = score([r.text for r in held]), np.array([r[label] for r in held])
    assert (p[y == 1][:, None] > p[y == 0][None]).mean() >= least  # area under the curve
    # Whole texts count: bad ends show, whatever came before; a text scores alike in any company.
    assert np.allclose(score([held[0].text, held[1].text])[0], score([held[0].text])[0])
    scored = module.with_score(odd, weights, out="__p").toPandas()
    assert len(scored) == len(ROWS) and scored["__p"].between(0, 1).all() and list(scored.columns[:4]) == odd.columns
    assert module.with_score(none, weights).count() == 0
    empty = module.fit(docs, labels.limit(0), label)
    assert np.isfinite(score(["a"])).all() and len(empty)


def test_a_long_texts_parts_score_as_the_whole(monkeypatch):
    rng = np.random.default_rng(0)
    w = quality.train([("good text here", 1), ("!!!! ####", 0)] * 4, seen=50)
    text = bytes(rng.integers(32, 120, 40_000, np.uint8))
    whole = quality.score(w, [text])
    monkeypatch.setattr(quality, "BLOCK", 1 << 12)
    assert np.allclose(quality.score(w, [text]), whole, atol=1e-6)


def test_toxicity_windows_cover_every_word():
    for n in range(200):
        place, first = toxicity.windows([n, 3])
        assert set(place[: first[1]].ravel()) - {-1} == set(range(n)) and set(place[first[1] :].ravel()) - {-1} == set(range(n, n + 3))


def test_toxicity_gradient():
    w = {k: v.astype(np.float64) for k, v in toxicity.initial(3).items()}
    rng = np.random.default_rng(0)
    vectors, ids, y, s = rng.normal(size=(20, toxicity.DIM)), rng.integers(-1, 20, (toxicity.WINDOW, 5)), np.array([1, 0, 1, 0, 1.0]), np.ones(5) / 5

    def loss():
        p = 1 / (1 + np.exp(-toxicity.read(w, toxicity._inputs(w, vectors, ids), toxicity._mask(ids))))
        return -(s * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    g, _, _ = toxicity.gradient(w, vectors, ids, y, s)
    for k in ("x0", "x1", "u0", "u1", "b0", "attend", "focus", "out", "prior"):
        i = tuple(rng.integers(0, n) for n in w[k].shape)
        old = w[k][i]
        w[k][i] = old + 1e-3
        up = loss()
        w[k][i] = old - 1e-3
        down = loss()
        w[k][i] = old
        assert abs((up - down) / 2e-3 - g[k][i]) < 1e-4


# Decontamination


def brute_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    random.seed(4)
    for _ in range(400):
        p, t = "".join(random.choices("ab c", k=random.randint(1, 90))), "".join(random.choices("ab c", k=random.randint(0, 120)))
        bits = {}
        for i, c in enumerate(p):
            bits[c] = bits.get(c, 0) | 1 << i
        want = brute_distance(p, t)
        for limit in (len(p), want, want - 1):
            got = decontamination.myers(bits, len(p), t, limit)
            assert (got and got[0]) == (want if want <= limit and t else None) or not t


def test_edited_passages_are_found_and_clean_documents_left(spark, documents, odd, none):
    random.seed(6)
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()
    clean = [r.text for r in documents.limit(40).collect()]
    rows, want = [], set()
    matcher = decontamination.Matcher([(str(i), decontamination.normalized(x.text)) for i, x in enumerate(items)], decontamination.SHARE)
    base = {k for k, t in enumerate(clean) if matcher.find(decontamination.normalized(t))}
    for k, t in enumerate(clean):
        rows.append((k, t))
        want |= {k} if k in base else set()
    for k, item in enumerate(items):
        text = list(item.text)
        for _ in range(decontamination.budget(len(decontamination.normalized(item.text))) // 2):
            text[random.randrange(len(text))] = random.choice("abcxyz")
        rows.append((1000 + k, clean[k % 40][:300] + " " + "".join(text) + " " + clean[(k + 1) % 40][:300]))
        want.add(1000 + k)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    benchmark = spark.createDataFrame([(x.item_id, x.text) for x in items] + [(900, None), (901, ""), (902, "short")], "item_id long, text string")
    for block in (1 << 22, 1000):  # one block, and many
        got = decontamination.matches(docs, benchmark, block_bytes=block).toPandas()
        assert set(got.doc_id) == want and {(1000 + k, x.item_id) for k, x in enumerate(items)} <= set(zip(got.doc_id, got.item_id, strict=True))
        assert (got.distance <= got.allowed).all()
        assert {r.doc_id for r in decontamination.keep_clean(docs, benchmark, block_bytes=block).collect()} == {r[0] for r in rows} - want
    for r in got[got.doc_id >= 1000].head(5).itertuples():
        text = next(t for i, t in rows if i == r.doc_id)
        assert r.distance == brute_distance(decontamination.normalized(items[[x.item_id for x in items].index(r.item_id)].text), decontamination.normalized(text))
    assert decontamination.matches(odd, benchmark).count() == 0 and decontamination.keep_clean(odd, benchmark).count() == len(ROWS)
    assert decontamination.matches(none, benchmark).count() == 0 and decontamination.matches(docs, benchmark.limit(0)).count() == 0


def edited(rng, text, edits):
    """The text after so many insertions, deletions and changes of a character."""
    x = list(text)
    for _ in range(edits):
        at, kind = rng.randrange(1, len(x) - 1), rng.choice("idc")
        x[at : at + (kind != "i")] = [] if kind == "d" else [rng.choice("abcdefgh")]
    return "".join(x)


def test_all_edits_up_to_the_budget_against_dynamic_programming(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    items = [" ".join(word() for _ in range(n)) for n in (4, 5, 7, 9, 12, 20, 30)]
    docs, base = [], [" ".join(word() for _ in range(25)) for _ in range(12)]
    for item in items:
        for edits in (0, 1, decontamination.budget(len(item)), decontamination.budget(len(item)) + 1, decontamination.budget(len(item)) + 3):
            at = rng.randrange(len(base))
            docs.append(f"{base[at]} {edited(rng, item, edits)} {base[at - 1]}")
    docs += [base[0] + items[0] + base[1], items[1].upper().replace(" ", " -- "), items[0][1:], None, ""]
    limit = [decontamination.budget(len(x)) for x in items]
    want = set()
    for d, text in enumerate(docs):
        norm = decontamination.normalized(text)
        for i, item in enumerate(items):
            if f" {item} " in f" {norm} " if len(item) < decontamination.EXACT_UNDER else brute_distance(item, norm) <= limit[i]:
                want.add((d, i))
    got = decontamination.matches(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 20 and any(len(x) < decontamination.EXACT_UNDER for x in items)
    chinese = "这是一个没有空格的基准问题请回答"
    got = decontamination.matches(spark.createDataFrame([(0, f"前文{chinese}后文"), (1, chinese[1:])], "doc_id long, text string"), spark.createDataFrame([(0, chinese)], "item_id long, text string"))
    assert [r.doc_id for r in got.collect()] == [0]


# Chat


def brute_cost(roles):
    """The cheapest repair by trying everything."""
    best = {chat.START: 0}
    for r in roles:
        new = {}
        for s, c in best.items():
            for before, to, cost, *_ in chat.ACTIONS[chat.ROLES.get(r, 0)]:
                if before == s:
                    new[to] = min(new.get(to, 1 << 30), c + cost)
        best = new
    return min(c + chat.INSERT * len(chat.ENDING[s]) for s, c in best.items())


def test_repairs_are_legal_cheapest_and_dealt_alike(spark):
    random.seed(7)
    rows = [(c, t, random.choice(["user", "assistant", "system", "tool", None]), random.choice(["hi", "", None, "<|user|> x"])) for c in range(60) for t in range(random.randint(1, 9))]
    rows += [(None, 0, "user", "lost"), (None, None, "assistant", "first"), *[(99, 5, "user", "same")] * 40]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("__x", __import__("pyspark").sql.functions.lit(1)).withColumnRenamed("__x", "part")
    got = chat.repair(df, partitions=3).toPandas()
    other = chat.repair(df, partitions=29).toPandas()
    key = ["conv_id", "seq"]
    assert got.sort_values(key).fragment.tolist() == other.sort_values(key).fragment.tolist() and len(got) == len(rows)
    for c, g in got.sort_values(key).groupby("conv_id", dropna=False):
        own = sorted([r for r in rows if (r[0] is None and c != c) or r[0] == c], key=lambda r: (r[1] is not None, r[1] or 0))
        assert g.seq.tolist() == list(range(len(own)))
        order = [None if x is None or x != x else x for x in g.role]
        assert g.cost.sum() == brute_cost(order)
        whole = "".join(g.fragment)
        marks = __import__("re").findall(r"<\|(\w+)\|>", whole)
        roles = marks[::2]
        assert set(marks[1::2]) == {"end"} and roles[-1] == "assistant"
        body = roles[1:] if roles[0] == "system" else roles
        assert body == ["user", "assistant"] * (len(body) // 2)
    assert chat.repair(df.limit(0), partitions=3).count() == 0


def test_legal_conversations_stay(spark, sf_dir):
    got = chat.repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"), partitions=5).toPandas()
    kept = got[got.action == "keep"]
    assert len(kept) and (kept.cost == chat.INSERT * 0).mean() > 0.5


# Token counts


def test_trees_count_edited_texts(documents, odd, none):
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    encoder = token_counts.Encoder(path, kept=1000)
    full = lambda t: len(encoder.encoding.encode_ordinary(t))
    random.seed(8)
    pool = [*"ab' \n\t1.,é  ", "'re", "'ll", " the", "   "]
    text = lambda n: "".join(random.choices(pool, k=random.randint(0, n)))
    for _ in range(4000):
        t = text(random.choice([3, 12, 60, 400]))
        tree, edits, at = token_counts.Tree.of(t, encoder), [], 0
        for _ in range(random.randint(0, 3)):
            at += random.randint(0, max(1, len(t) // 3))
            edits.append((at, random.randint(0, 6), text(8)))
            at += edits[-1][1]
        want = t
        for a, d, x in reversed(edits):
            want = want[: min(a, len(want))] + x + want[min(a, len(t)) + d :] if a <= len(t) else want + x
        new, _ = token_counts.apply_edits(tree, t, edits, encoder)
        assert tree.tokens == full(new) and tree.sums[1, 0] == len(new)
    for df in (documents, odd):
        for r in token_counts.update_trees(token_counts.sample_edits(df), path).collect():
            assert r.edited_tokens == full(r.edited_text) and r.reencoded <= 60 + sum(map(len, r.lengths)) // 10
        # Kept trees, edited later, say the same.
        kept = token_counts.build_trees(df, path).drop("n_tokens").dropDuplicates(["doc_id"]).where("doc_id is not null")
        later = token_counts.update_trees(token_counts.sample_edits(df.dropDuplicates(["doc_id"])).join(kept, "doc_id"), path).select("doc_id", "edited_tokens", "reencoded").collect()
        now = {r.doc_id: (r.edited_tokens, r.reencoded) for r in token_counts.update_trees(token_counts.sample_edits(df), path).collect()}
        assert all(now[r.doc_id] == (r.edited_tokens, r.reencoded) for r in later) and len(later) > 4
    assert token_counts.token_counts_table(none, path).count() == 0


# Pages


def test_wrappers_read_articles(spark, sf_dir):
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.main_text_table(pages).collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", source[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split()) and r.n_chars == len(r.text)


def test_wrapper_without_article_mark_and_odd_pages(spark):
    page = '<html><body><div class="top-menu"><a href=x>Home</a></div><div id=w><div class="body2"><h1>T&eacute;st</h1><p>One <b>bo</b>ld{}<p>Two &amp; three<br>four<script>if (a</b>) "</p>"</script></div><div class="comments"><p>nice one</p></div></div><form><p>Sign up</p></form><footer>f</footer></body></html>'
    rows = [(i, f"https://h.example/{i}", page.format(" and more words of the article" * (i + 1))) for i in range(6)]
    rows += [(10, None, None), (11, "odd", ""), (12, "https://h.example/9", "no tags & at all"), (13, "https://h.example/8", "<article>cut <p"), (13, "https://h.example/8", "<article>cut <p")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "'p' as paths")
    got = {r.page_id: r.text for r in html_text.main_text_table(df).collect()}
    for i in range(6):
        assert got[i] == "Tést One bold" + " and more words of the article" * (i + 1) + " Two & three four"
    assert got[10] == got[11] == "" and got[12] == "no tags & at all" and got[13] == "cut"
    assert html_text.main_text_table(df.limit(0)).count() == 0


def test_wrapper_alignment_is_union_free():
    a = html_text.shape("<body><h1>t</h1><p>x</p><p>y</p><ul><li>1</li></ul></body>")
    b = html_text.shape("<body><p>x</p><div>z</div><ul><li>1</li><li>2</li></ul></body>")
    got = html_text.expression(html_text.merge(a, b))
    assert got == "<body>(<h1>=</h1>)?(<p>#</p>)+(<div>=</div>)?<ul>(<li>#</li>)+</ul></body>" and "|" not in got


def html_of(spark, pages):
    rows = [(i, f"http://h{i}.example/p", p) for i, p in enumerate(pages)]
    return [r.text for r in html_text.main_text_table(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_words_of_layout_leave_the_article(spark):
    body = '<h1>T</h1><h2 id="related-work">Related</h2><section id="discussion"><p>one two three four five</p></section><p>six seven eight nine ten</p>'
    want = "T Related one two three four five six seven eight nine ten"
    shells = ['<body class="single has-sidebar">{}<div class="sidebar"><p>x</p></div></body>', '<body><div class="has-sidebar"><article>{}</article></div><div>other text here</div></body>',
              '<body><article><div class="content search">{}</div></article></body>', '<body><main class="overlay">{}<div class="comments"><p>no</p></div></main></body>']
    assert html_of(spark, [s.format(body) for s in shells]) == [want] * len(shells)


def test_self_closed_and_unclosed_tags_swallow_nothing(spark):
    cases = [("<p>one <svg class=\"i\"/> two</p><p>three</p>", "one two three"), ("<p>one <math/> two</p><p>three</p>", "one two three"), ("<p>one <svg><text>no</text></svg> two</p>", "one two"),
             ("<p>one <math><mi>x</mi></math> two</p>", "one x two"), ("<p>one</p><object><p>two</p></object><p>three</p>", "one two three"), ("<p>one</p><select><p>two</p>", "one two"), ("<p>one</p><script>two", "one")]
    assert html_of(spark, [f"<body><article>{c}" for c, _ in cases]) == [want for _, want in cases]


def bare_pages(n=8):
    """Pages of a host that marks nothing: a page header, a template's text in bare divs around a short body."""
    page = '<html><body><header>Site of things</header><div>We are a fine site and this text says so on every page of it, at length.</div><div><h2>Facts</h2><p>Only page {0} says {1}.</p><div class="social">On social studies {1}.</div></div><div>All rights, and all wrongs, are reserved by somebody who is not here.</div></body></html>'
    return [page.format(k, "word" * (k + 1)) for k in range(n)], [f"Facts Only page {k} says {'word' * (k + 1)}. On social studies {'word' * (k + 1)}." for k in range(n)]


def test_the_article_is_what_differs_between_pages_of_a_host(spark, monkeypatch):
    pages, want = bare_pages()
    got = lambda ps: [r.text for r in html_text.main_text_table(spark.createDataFrame([(i, f"http://one.example/{i}", p) for i, p in enumerate(ps)], "page_id long, url string, html string").repartition(3)).orderBy("page_id").collect()]
    assert got(pages) == want
    # The template's divs beside paragraphs, in one group with them; and an article that is marked keeps what all pages say.
    inline = ["<body><div><div>Same on all pages, and no more than that.</div><p>one {0}</p><p>two {0}</p></div></body>".format("x" * k) for k in range(1, 6)]
    assert got(inline) == [f"one {'x' * k} two {'x' * k}" for k in range(1, 6)]
    marked = [f"<body><article><h2>Same</h2><div>Always</div><div class='share'>Share this</div><div class='search'>found {k}</div><p>{k}</p><div class='comments'>me {k}</div></article></body>" for k in range(5)]
    assert got(marked) == [f"Same Always found {k} {k}" for k in range(5)]
    assert got(pages[:1]) != want[:1] and got([pages[0]] * 3) == got(pages[:1]) * 3  # one page tells nothing of its host
    # Without alignment the template isn't told from the article.
    monkeypatch.setattr(html_text, "merge", lambda a, b: a)
    root = None
    for p in pages:
        root = html_text.shape(p) if root is None else html_text.merge(root, html_text.shape(p))
    assert html_text.main_text(pages[0], html_text.Reading(root).paths) != want[0]


def test_very_deep_pages(spark):
    for n in (1500, 10_000):
        deep = ["<body>" + "<div>" * n + f"<nav>no</nav>text {k}" + "</div>" * n + "</body>" for k in range(2)]
        assert html_of(spark, deep) == ["text 0", "text 1"]
