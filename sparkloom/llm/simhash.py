"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint is the bitwise majority of the 64-bit hashes of a text's word shingles. Fingerprints link at ``radius`` or fewer
differing bits. To find all links, each bit gets a vector of radius + 1 bits that isn't zero; each of the 2^(radius+1) - 1
vectors v that aren't zero makes a table whose mask holds the bits with <vector, v> odd. The vectors of any ``radius``
bits span less than the space, so some v is orthogonal to all of them: its mask holds none of these bits, and two
fingerprints that differ in them alone meet in its table. No link is missed, whatever the data.

Copies are one fingerprint before any of this. A bucket of more than ``BUCKET`` fingerprints is dealt again by masks over the bits
that its mask leaves out, by the same guarantee; after three deals at most 10 bits are free, so at most
1,024 fingerprints meet. Within a bucket only the edges of a spanning forest come out (all links, where it has a few members), never all pairs.

``near_groups`` are the components of these links. ``near_copies`` are documents whose shingle sets are alike: an exact prefix filter
proposes pairs, which are then held against the sets. With a ``radius`` the links of fingerprints come first and this check follows for
what they left apart; without one no fingerprint decides there.

Edge cases: null and empty texts have fingerprint zero and are linked like any other; texts with fewer words than a shingle hash
whole; a null id is a document like any other (component ids ignore it); no documents give no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import sized, staged
from sparkloom.llm.components import components

BITS, RADIUS, WORDS, SEED, BUCKET = 64, 4, 4, 42, 2000


def simhash(text: str | None, words: int = WORDS) -> int:
    """The unsigned 64-bit fingerprint: a bit is 1 where over half of the shingles' XXH64 have it."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and 09-0D and 20
    if not ws:
        return 0
    joined = b" ".join(ws)
    digest = xxhash.xxh64_digest
    if len(ws) <= words:
        hashes = digest(joined, SEED)
        n = 1
    else:
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(ws) - words + 1
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)])
    return int.from_bytes(np.packbits(2 * _bit_counts(hashes, n) > n).tobytes(), "big")


def _bit_counts(hashes: bytes, n: int) -> np.ndarray:
    """How many of the n 8-byte hashes have each bit, highest first."""
    x = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    total = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 14):  # bounded memory for very long texts
        total += np.unpackbits(x[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.uint16)
    return total


def with_fingerprint(docs: DataFrame, text_col="text", out="fingerprint", words: int = WORDS) -> DataFrame:
    """``docs`` with the fingerprint as a signed long (its 64 bits)."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, words) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(out, fp(text_col))


#: A primitive polynomial over GF(2) for each degree.
PRIMITIVE = {2: 0b111, 3: 0b1011, 4: 0b10011, 5: 0b100101, 6: 0b1000011, 7: 0b10000011, 8: 0b100011101}


def masks(bits: list[int], radius: int = RADIUS) -> list[int]:
    """The covering masks over these bits: any ``radius`` of them miss one mask at least.

    The bits' vectors are the powers of a generator, so any radius + 1 neighbours are independent and no mask holds few of the bits.
    """
    degree = radius + 1
    vectors, x = [], 1
    for _ in bits:
        vectors.append(x)
        x <<= 1
        if x >> degree:
            x ^= PRIMITIVE[degree]
    return [sum(1 << b for b, a in zip(bits, vectors, strict=True) if (a & v).bit_count() % 2) for v in range(1, 1 << degree)]


def _forest(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Edges (by place) of a spanning forest of the links within one bucket: breadth first, a row of distances at a time.

    It begins at the fingerprint nearest to the majority of the bucket: among copies of one text, the text itself.
    """
    counts = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0)
    centre = np.packbits(2 * counts > len(fps)).view(">u8").astype(np.uint64)[0]
    free = np.ones(len(fps), bool)
    u, v = [], []
    for seed in np.argsort(np.bitwise_count(fps ^ centre), kind="stable"):
        if not free[seed]:
            continue
        free[seed] = False
        queue = [int(seed)]
        for at in queue:
            near = np.flatnonzero(free & (np.bitwise_count(fps ^ fps[at]) <= radius))
            free[near] = False
            u += [at] * len(near)
            v += near.tolist()
            queue += near.tolist()
    return u, v


@functools.cache
def _held(way: int, radius: int) -> int:
    """The bits that a way holds: its digits, base 2^(radius + 1), are the masks taken deal by deal (plus one)."""
    if not way:
        return 0
    before, k = divmod(way, 1 << (radius + 1))
    held = _held(before, radius)
    return held | masks([b for b in range(BITS) if not held >> b & 1], radius)[k - 1]


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _links(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """All links within one bucket, by place."""
    u, v = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None]) <= radius, 1))
    return u.tolist(), v.tolist()


def near_links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, complete: int = 2) -> DataFrame:
    """Edges part, u, v among the distinct fingerprints (columns part int, fp long) of each part; their components are those of all links.

    A bucket of up to ``complete`` fingerprints gives all its links, a larger one a spanning forest of them.

    Buckets meet by a 64-bit key of (part, way, held bits); were two buckets to share a key, they would only be looked through together.
    """
    tables = (1 << (radius + 1)) - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each fingerprint once for every mask over the bits that aren't held yet."""
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = batch.slice(at, 4096)
                part, fp, way = (rows.column(i).to_numpy() for i in range(3))
                fp = fp.view(np.uint64)
                held = np.empty((len(fp), tables), np.uint64)
                for w in np.unique(way):
                    held[way == w] = [_held(int(w) * (tables + 1) + k + 1, radius) for k in range(tables)]
                ways = (way[:, None].astype(np.int64) * (tables + 1) + np.arange(1, tables + 1)).ravel()
                fp, part = np.repeat(fp, tables), np.repeat(part, tables)
                key = _mixed(_mixed((fp & held.ravel()) + np.uint64(0x9E3779B97F4A7C15)) ^ (ways.astype(np.uint64) << np.uint64(20)) ^ part.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(fp.view(np.int64)), pa.array(ways), pa.array(key.view(np.int64))], ["part", "fp", "way", "key"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, us, vs = [], [], []
            members = batch.column(1)
            flat, offsets = members.values.to_numpy(), members.offsets.to_numpy()
            for p, a, b in zip(batch.column(0).to_numpy(), offsets[:-1], offsets[1:], strict=True):
                x = np.sort(flat[a:b])
                u, v = (_links if len(x) <= complete else _forest)(x.view(np.uint64), radius)
                us.append(x[u])
                vs.append(x[v])
                parts += [p] * len(u)
            empty = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(np.concatenate(us or empty)), pa.array(np.concatenate(vs or empty))], ["part", "u", "v"])

    edges = None
    level = fps.select("part", "fp", F.lit(0).cast("long").alias("way"))
    for last in (False, False, True):
        dealt = level.mapInArrow(deal, "part int, fp long, way long, key long")
        shared = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        met = staged(dealt.join(shared.hint("merge"), "key"), "buckets")  # Spark takes the deal to have as many rows as the level
        few = met if last else met.where(F.col("n") <= bucket)
        found = few.groupBy("part", "key").agg(F.collect_set("fp").alias("fps")).select("part", "fps").mapInArrow(links, "part int, u long, v long")
        edges = found if edges is None else edges.union(found)
        level = met.where(F.col("n") > bucket).select("part", "fp", "way")
        if last or level.isEmpty():
            return edges.distinct()


def _rooted(own: DataFrame, least: str, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """fp, least (of the column of that name), root: of every distinct fingerprint of ``own``, root being one of its component."""
    fps = staged(own.groupBy("fp").agg(F.min(least).alias("least")), "distinct")
    roots = components(near_links(fps.select(F.lit(0).alias("part"), "fp"), radius, bucket).select("u", "v"))
    return fps.join(sized(roots).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_groups(docs: DataFrame, id_col="doc_id", text_col="text", words: int = WORDS, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """__id, fp (signed long), component: of every document, component being the least id of its group."""
    own = staged(with_fingerprint(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text", "fp", words).drop("__text"), "fingerprints")
    rooted = _rooted(own, "__id", radius, bucket)
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    groups = staged(rooted.select("fp", "root").join(least.hint("merge"), "root").select("fp", "component"), "groups")
    return own.join(sized(groups), "fp")


def near_groups_table(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id of every document."""
    found = near_groups(docs, id_col, text_col)
    return found.select(F.col("__id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct word shingles of a text (the whole of it, if it has fewer words)."""
    ws = (text or "").lower().encode("utf-8", "surrogatepass").split()  # of bytes: 09-0D and 20
    x = np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws))
    span, n = (words, len(ws) - words + 1) if len(ws) >= words else (len(ws), 1)
    h = np.full(n, span, np.uint64)
    for i in range(span):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[i : i + n]
    return np.unique(_mixed(h))


def _key(tokens: np.ndarray) -> int:
    """What stands for a shingle set: a signed 64-bit hash of it."""
    return int(np.array(xxhash.xxh64_intdigest(tokens.tobytes()), np.uint64).view(np.int64))


def _bitmap(tokens: np.ndarray) -> np.ndarray:
    """2,048 bits, one set for each value of the shingles' highest bits: bits that one of two sets alone has count shingles that it alone has."""
    bits = np.zeros(2048, bool)
    bits[tokens >> np.uint64(53)] = True
    return np.packbits(bits).view(np.int64)


def _prefix_length(size: int, similarity: float) -> int:
    """Two sets at the similarity share one of so many first members of either, in any order that both keep to."""
    return size - math.ceil(similarity * size - 1e-9) + 1


def _tokens_by(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[int, np.ndarray]]:
    """key and shingles of each text (column 0), a set once in a task."""
    seen = set()
    for batch in batches:
        for text in batch.column(0):
            tokens = shingles(text.as_py(), words)
            key = _key(tokens)
            if key not in seen:
                seen.add(key)
                yield key, tokens


def _common_shingles(texts: DataFrame, words: int, least: int = 4, most: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that recur in a sample of the texts, with their counts. They only set the order in which shingles are looked at: any order finds all pairs."""
    every = min(16, max(1, texts.count() // 2000))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _tokens_by(batches, words):
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64))], ["token"])

    counts = texts.where(F.pmod(F.xxhash64("__text"), F.lit(every)) == 0).mapInArrow(tokens, "token long").groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("n"))
    found = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(most).toArrow()
    token, n = found.column("token").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(token)
    return token[order], n[order]


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Columns of rows sorted by the first column, never parting rows of one value; where each row's bucket starts, and its size."""
    held: list[pa.RecordBatch] = []

    def columns(rows: pa.Table):
        x = [c.to_numpy() for c in rows.columns]
        starts = np.flatnonzero(np.concatenate(([True], x[0][1:] != x[0][:-1])))
        sizes = np.diff(np.append(starts, len(x[0])))
        return x, np.repeat(starts, sizes), np.repeat(sizes, sizes)

    for batch in batches:
        if not batch.num_rows:
            continue
        token = batch.column(0).to_numpy()
        if held and held[-1].column(0)[-1].as_py() != token[0]:
            yield columns(pa.Table.from_batches(held))
            held = []
        cut = int(np.searchsorted(token, token[-1]))
        if cut:
            yield columns(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield columns(pa.Table.from_batches(held))


def near_copies(docs: DataFrame, id_col="doc_id", text_col="text", words: int = 5, similarity: float = 0.8, radius: int | None = None) -> DataFrame:
    """__id, component: of every document, component being the least id of its group of near copies.

    Documents link if the Jaccard similarity of their sets of ``words``-word shingles is ``similarity`` or more; groups are the components of all
    such links, and none is missed. Two such sets share a member within the first 1 - ``similarity`` of each, in any fixed order (a prefix filter);
    shingles that recur come last, so few unlike texts meet. Texts of one shingle set are one throughout (told by 64 bits). Where many meet at a
    shingle, all are first held against the two whose shingles the others share most; then all that meet and aren't in one component yet against
    each other. Sizes and the places of the shared shingle leave out pairs that can't reach the similarity, so do bitmaps of the sets; the rest are held against the sets.

    With a ``radius`` documents also link if their fingerprints do (as in ``near_groups``). These links are found first; what they
    join isn't held against each other again.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    texts = rows.select("__text")
    common, times = _common_shingles(texts, words)

    @F.pandas_udf("key long, size int, bits array<long>")
    def signature(texts: pd.Series) -> pd.DataFrame:
        found = [shingles(t, words) for t in texts]
        return pd.DataFrame({"key": np.array([_key(x) for x in found], np.int64), "size": np.array([len(x) for x in found], np.int32), "bits": [_bitmap(x) for x in found]})

    own = rows if radius is None else with_fingerprint(rows, "__text", "fp")
    own = own.select("__id", F.md5("__text").alias("__md5"), signature("__text").alias("s"), *own.columns[2:])
    own = staged(own.select("__id", "__md5", F.col("s.key").alias("__key"), "s.size", "s.bits", *own.columns[3:]), "keys")
    least = own.groupBy("__key").agg(F.min("__id").alias("__least"))
    known = staged(own.groupBy("__key").agg(F.min("__md5").alias("__md5"), F.first("size").alias("size"), F.first("bits").alias("bits")), "sets")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], ["token", "key", "size", "pos"])
        rows, waiting = [], 0
        for key, tokens in _tokens_by(batches, words):
            n = len(tokens)
            if len(common):
                at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
                seen = np.where(common[at] == tokens, times[at], 0)
                tokens = tokens[np.argsort(seen, kind="stable")]
            first = tokens[: _prefix_length(n, similarity)].view(np.int64)
            rows.append((first, np.full(len(first), key), np.full(len(first), n, np.int32), np.arange(len(first), dtype=np.int32)))
            waiting += len(first)
            if waiting >= 1 << 15:
                yield batch_of(rows)
                rows, waiting = [], 0
        if rows:
            yield batch_of(rows)

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of shingles that several sets have, each set once, with their number."""
        for (token, key, size, pos), _, _ in _whole_buckets(batches):
            once = np.concatenate(([True], (token[1:] != token[:-1]) | (key[1:] != key[:-1])))
            token, key, size, pos = token[once], key[once], size[once], pos[once]
            _, inverse, counts = np.unique(token, return_inverse=True, return_counts=True)
            n = counts[inverse]
            many = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(c[many]) for c in (token, key, size, pos, n.astype(np.int64))], ["token", "key", "size", "pos", "n"])

    def pairs_of(key: np.ndarray, size: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        """The pairs of places that may reach the similarity."""
        a, b = size[i].astype(np.int64), size[j].astype(np.int64)
        shared = np.minimum(a - pos[i], b - pos[j])  # at most, if this is the first shingle that both have
        fit = (key[i] != key[j]) & (shared * (1 + similarity) >= similarity * (a + b) - 1e-6)
        u, v = key[i[fit]], key[j[fit]]
        found = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["u", "v"])

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All pairs of up to four; of more, those with the first two."""
        for (_, key, size, pos, _), start, n in _whole_buckets(batches):
            at = np.arange(len(key))
            few, i, j = n <= 4, [], []
            for d in (1, 2, 3):
                ok = few & (at - start >= d)
                i.append(at[ok])
                j.append(at[ok] - d)
            for d in (0, 1):
                ok = ~few & (at - start > d)
                i.append(at[ok])
                j.append(start[ok] + d)
            yield pairs_of(key, size, pos, np.concatenate(i), np.concatenate(j))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All pairs of different components."""
        for (_, key, size, pos, root), start, n in _whole_buckets(batches):
            i, j, waiting = [], [], 0
            for s in np.unique(start):
                e = s + n[s]
                if (root[s:e] == root[s]).all():
                    continue
                for at in range(s, e):
                    j.append(np.flatnonzero(root[at + 1 : e] != root[at]) + at + 1)
                    i.append(np.full(len(j[-1]), at))
                    waiting += len(j[-1])
                    if waiting >= 1 << 18:
                        yield pairs_of(key, size, pos, np.concatenate(i), np.concatenate(j))
                        i, j, waiting = [], [], 0
            if waiting:
                yield pairs_of(key, size, pos, np.concatenate(i), np.concatenate(j))

    met = texts.mapInArrow(prefixes, "token long, key long, size int, pos int").repartition("token").sortWithinPartitions("token", "key")
    met = staged(met.mapInArrow(meeting, "token long, key long, size int, pos int, n long"), "met")
    central = met.groupBy("key").agg((F.sum("n") / F.first("size")).alias("weight"))
    dealt = met.join(central.hint("merge"), "key").select("token", "key", "size", "pos", "weight").repartition("token").sortWithinPartitions("token", F.desc("weight"), "key")
    pairs = dealt.mapInArrow(stars, "u long, v long").distinct()
    if radius is not None:  # the sets of a component of fingerprints, each linked to the least of them
        groups = own.select("__key", "fp").distinct().join(_rooted(own, "__key", radius).select("fp", "root").hint("merge"), "fp").select("root", "__key").distinct()
        first = groups.groupBy("root").agg(F.min("__key").alias("u"))
        known_links = staged(groups.join(first.hint("merge"), "root").where("u <> __key").select("u", F.col("__key").alias("v")).distinct(), "alike")
        joined = sized(components(known_links))
        side = lambda k: joined.select(F.col("node").alias(k), F.col("root").alias(f"root_{k}"))
        pairs = pairs.join(side("u"), "u", "left").join(side("v"), "v", "left").where("root_u is null or root_v is null or root_u <> root_v").select("u", "v")
    pairs = staged(pairs, "pairs")

    @F.pandas_udf("array<long>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, words).view(np.int64) for t in texts])

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs at the similarity: first by bounds from bitmaps of the sets, then, for what is left, by the sets, each made once."""
        side = lambda k, a: known.select(F.col("__key").alias(k), F.col("size").alias(f"n{a}"), F.col("bits").alias(a))
        lacks = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda n, x: n + x)
        most = F.least(F.col("na") - lacks("a", "b"), F.col("nb") - lacks("b", "a"))  # a bit that one side alone has is a shingle that it alone has
        near = pairs.join(side("u", "a").hint("merge"), "u").join(side("v", "b").hint("merge"), "v").where(most * (1 + similarity) >= similarity * (F.col("na") + F.col("nb")) - 1e-6)
        near = staged(near.select("u", "v"), "near")
        wanted = near.select(F.col("u").alias("__key")).union(near.select("v")).distinct().join(known.select("__key", "__md5").hint("merge"), "__key")
        wanted = sized(staged(wanted, "wanted"), 500_000)  # so that the other texts aren't shuffled
        made = texts.withColumn("__md5", F.md5("__text")).join(wanted, "__md5").dropDuplicates(["__key"])
        made = staged(made.select("__key", sets("__text").alias("set")), "shingles")
        side = lambda k, a: made.select(F.col("__key").alias(k), F.col("set").alias(a)).hint("merge")
        both = near.join(side("u", "a"), "u").join(side("v", "b"), "v")
        shared = F.size(F.array_intersect("a", "b"))
        return staged(both.where(shared >= similarity * (F.size("a") + F.size("b") - shared)).select("u", "v"), "linked")

    linked = verified(pairs)
    if radius is not None:
        linked = staged(linked.union(known_links), "linked")
    roots = sized(components(linked))
    large = met.where("n > 4").join(roots.withColumnRenamed("node", "key"), "key", "left")
    large = large.select("token", "key", "size", "pos", F.coalesce("root", "key").alias("root")).repartition("token").sortWithinPartitions("token")
    rest = staged(large.mapInArrow(across, "u long, v long").distinct().join(pairs.hint("merge"), ["u", "v"], "left_anti"), "rest")
    more = verified(rest)
    if not more.isEmpty():
        roots = sized(components(linked.union(more)))
    rooted = least.join(roots.select(F.col("node").alias("__key"), "root"), "__key", "left").withColumn("root", F.coalesce("root", "__key"))
    groups = rooted.groupBy("root").agg(F.min("__least").alias("component"))
    groups = staged(rooted.join(groups.hint("merge"), "root").select("__key", "component"), "groups")
    return own.join(sized(groups), "__key").select("__id", "component")


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", words: int = 5, similarity: float = 0.8, radius: int | None = None) -> DataFrame:
    """``docs`` with one document of each group of near copies (with a ``radius``, of fingerprints too): the one of the least id.

    Rows without an id all stay; rows that repeat an id that stays, stay.
    """
    gone = near_copies(docs, id_col, text_col, words, similarity, radius).where(F.col("__id") != F.col("component")).select("__id").distinct()
    gone = sized(staged(gone, "gone"), 500_000)
    return docs.join(gone, docs[id_col] == gone["__id"], "left_anti")
