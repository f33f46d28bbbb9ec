"""Vector codes against plain Python integers; nulls, ties, repeats, wide values, uneven lengths, empty tables, clashing names."""

import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from sparkloom.llm import vector_codes
from sparkloom.llm.oracles import ORACLES
from sparkloom.llm.queries import queries


def plain(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(id, code, error) of each kept row by the definition, with unbounded integers, and the codebooks' digest."""
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    longest = max((len(v) for _, v in kept), default=0)
    width = -(-longest // parts)
    ints = [[math.floor(Fraction(x) * scale) for x in v] + [0] * (width * parts - len(v)) for _, v in kept]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in ints]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0))
    books = [[cut[k][p] for k in order[:entries]] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for v in cut:
                mine[best(v[p], books[p])[1]].append(v[p])
            for e, found in mine.items():
                books[p][e] = [sum(column) // len(found) for column in zip(*found, strict=True)]
    out = []
    for (i, _), v in zip(kept, cut, strict=True):
        found = [best(v[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    return out, hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()


def coded(spark, rows, kind="float", **settings):
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], f"vec_id long, embedding array<{kind}>, label string, error int").repartition(3)
    return vector_codes.code_table(df, **settings).collect()


@pytest.mark.parametrize("bits", [None, 3, 7, 12])
@pytest.mark.parametrize("size", [1, 10, 20, 29])
def test_limb_products_are_exact(bits, size):
    rng = np.random.default_rng(size)
    x, c = (rng.integers(-(1 << size), 1 << size, (n, 8)) for n in (40, 16))
    x[0], c[0] = (1 << size) - 1, -(1 << size)
    assert (vector_codes.dots(x, c, bits) == np.array(x.astype(object) @ c.astype(object).T, np.int64)).all()
    at, d = vector_codes.nearest(x, c)
    full = ((x[:, None, :].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
    assert d.tolist() == [min(r) for r in full] and at.tolist() == [list(r).index(min(r)) for r in full]


def test_limbs_keep_products_under_53_bits():
    for width in (1, 2, 7, 8, 100, 5000):
        bits = (53 - width.bit_length()) // 2
        assert width * ((1 << bits) - 1) ** 2 < 1 << 53 and bits >= 20 - width.bit_length() // 2


@pytest.mark.parametrize("reach", [1.0, 3e4, 1e7, 3e37])
def test_codes_equal_unbounded_arithmetic(spark, reach):
    """At 3e4 values need several limbs, at 1e7 distances pass 64 bits, at 3e37 sums pass what decimals hold."""
    rng = random.Random(7)
    rows = [(i, [float(np.float32(rng.uniform(-reach, reach))) for _ in range(16)]) for i in range(60)]
    got = coded(spark, rows, entries=5, rounds=3)
    want, digest = plain(rows, entries=5, rounds=3)
    assert sorted((r.vec_id, r.code) for r in got) == sorted((i, code) for i, code, _ in want)
    assert {r.vec_id: r.error for r in got} == {i: e if e < 1 << 63 else None for i, _, e in want}
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0] * 8), (5, [1.0] * 8), (2, None), (3, [nan] * 8), (4, [inf] + [0.0] * 7), (6, [None] + [0.0] * 7), (7, []), (None, [0.5] * 8), (1, [-0.5, 0.25, 3.0]), (9, [2.0] * 8)]
    got = coded(spark, rows, entries=3, rounds=2)
    want, digest = plain(rows, entries=3, rounds=2)
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.vec_id, r.code, r.error) for r in got), key=key) == sorted(want, key=key) and {r.codebooks_sha256 for r in got} == {digest}
    assert {r.label_error for r in got} == {sum(e for _, _, e in want)}
    assert coded(spark, [(1, None), (2, [nan])]) == [] and coded(spark, [(1, [])])[0].code == "00" * 8
    with pytest.raises(ValueError):
        coded(spark, rows, entries=257)


def test_ties_go_to_the_lower_index(spark):
    rows = [(0, [0.0] * 8), (1, [0.0] * 8), (2, [1.0] * 8), (3, [0.5] * 8)]
    got = {r.vec_id: r.code for r in coded(spark, rows, entries=3, rounds=0)}
    assert got == {0: "00" * 8, 1: "00" * 8, 2: "02" * 8, 3: "00" * 8}


def test_sums_of_hot_rare_and_null_labels(spark):
    rows = [(i, "00", 3, "hot") for i in range(3000)] + [(i, "00", 5, None) for i in range(10)] + [(i, "00", i, f"l{i % 700}") for i in range(700)] + [(1, "00", None, "l3")]
    df = spark.createDataFrame(rows, "vec_id long, code string, error long, label string")
    got = {r.label: r.label_error for r in vector_codes.with_sums(df).collect()}
    assert vector_codes.with_sums(df).count() == len(rows)
    assert got["hot"] == 9000 and got[None] == 50 and got["l3"] is None and got["l699"] == 699 and len(got) == 702
    big = spark.createDataFrame([(1, "00", (1 << 63) - 1, 1), (2, "00", 1, 1)], "vec_id long, code string, error long, label int")
    assert {r.label_error for r in vector_codes.with_sums(big).collect()} == {None}


def test_the_query_equals_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got, want = queries()["op11_vector_codes"](spark, sf_dir), con.sql(ORACLES["op11_vector_codes"])
    assert sorted(map(tuple, got.select(sorted(got.columns)).collect())) == sorted(want.select(*sorted(want.columns)).fetchall())
