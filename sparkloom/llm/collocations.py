"""Operator 12: phrases that occur together, by prefix-free parsing.

Every piece of text (a run of words between separators) is cut into chunks where its content says so: a window of three words whose
hash is a multiple of ``every`` ends one chunk and begins the next, which therefore share these three words. Equal passages give equal
chunks wherever they stand, so the table of distinct chunks with their frequencies is small where texts repeat. Phrases of at most
four words are then counted inside distinct chunks only, times the frequency; one that starts in the three words that a chunk shares
with its successor is left to the successor, so each occurrence counts once.

Phrases are counted by length. One of n words can reach ``least`` only if both its parts of n - 1 words did; a bitmap of the parts
that did (2^27 bits of 16 MB at any size; a false hit costs a row, never a result) leaves the others out before they are shuffled.
No task holds the phrases of a language: counts are by (language, phrase), and ranks are taken in 64 shares of a language first.

Odd input: a null text is empty and gives nothing, a null language is ``und``, texts that repeat count as often as they occur, a piece
of one word gives a word. A language without candidates gives no rows, an empty table gives an empty one. Separators, spaces and case
are those of ASCII alone. Only ``text`` and ``lang`` are read, so other columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import by_bytes, ragged, staged

LONGEST = 4  # words of a phrase
SHARED = LONGEST - 1  # words that neighbouring chunks share
BITS = 27  # of the bitmap's size
_SEP, _DOC = b"\xff", b"\xfe"  # never in UTF-8
_CLEAN = bytes.maketrans(bytes(range(65, 91)) + b"\t.,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + b" " + _SEP * 10)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(29))

# Hashes of words and phrases: they place triggers and prune; what is counted as one phrase is compared byte by byte


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, 1 << size of each."""
    base = int(_MIX[0])
    return tuple(np.cumprod(np.full(1 << size, x, np.uint64)) for x in (base, pow(base, -1, 1 << 64)))


def _values() -> np.ndarray:
    values = np.arange(1, 257, dtype=np.uint64)
    values[[32, 254, 255]] = 0
    return values


_VALUE, _WINDOW = _values(), 1 << 17


def _word_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the words of a buffer that begin at ``starts``, each up to the next one's start without spaces: a polynomial of its bytes.

    In windows of 128 KB, so that little is held at a time; a longer word alone.
    """
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        end = max(at + 1, int(starts.searchsorted(starts[at] + _WINDOW, "right")) - 1) if starts[-1] > starts[at] + _WINDOW else len(starts)
        a, b = int(starts[at]), int(starts[end]) if end < len(starts) else len(data)
        up, down = _powers(max(17, (b - a).bit_length()))
        out[at:end] = np.add.reduceat(_VALUE[data[a:b]] * up[: b - a], starts[at:end] - a) * down[starts[at:end] - a]
        at = end
    out ^= out >> _MIX[2]
    return out * _MIX[1]


def _joined(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase with one more word."""
    x = (h ^ (h >> _MIX[2])) * _MIX[0] + word
    x ^= x >> _MIX[2]
    return x * _MIX[1]


# Chunks of texts


def chunks(texts: list[str], every: int) -> list[tuple[int, bytes, bool]]:
    """(number of the text, words of the chunk with spaces between, whether it is its piece's last) of all texts."""
    raw = (b" " + _DOC + b" ").join(t.encode().translate(_CLEAN).replace(_SEP, b" \xff ") for t in texts)
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    raw = raw.strip(b" ")
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return []
    starts = np.concatenate(([0], np.flatnonzero(data == 32) + 1))
    ends = np.append(starts[1:] - 1, len(data))
    kind = data[starts]
    text = np.cumsum(kind == _DOC[0])
    cuts = np.concatenate(([-1], np.flatnonzero(kind >= _DOC[0]), [len(starts)]))
    first, beyond = cuts[:-1] + 1, cuts[1:]
    first, beyond = first[beyond > first], beyond[beyond > first]
    if not len(first):
        return []
    sizes = beyond - first
    inside = np.zeros(len(starts), bool)  # where a window of shared words starts, not at its piece's start
    at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    inside[at] = (at > np.repeat(first, sizes)) & (at + SHARED <= np.repeat(beyond, sizes))
    hashes = _word_hashes(data, starts)
    window = hashes.copy()
    for k in range(1, SHARED):
        window[:-k] = _joined(window[:-k], hashes[k:])
    begins = np.sort(np.concatenate((first, np.flatnonzero(inside & (window % np.uint64(every) == 0)))))
    piece = np.searchsorted(first, begins, "right") - 1
    last = np.append(piece[1:] != piece[:-1], True)
    stops = np.where(last, beyond[piece], np.append(begins[1:], 0) + SHARED)
    cut = [raw[a:b] for a, b in zip(starts[begins].tolist(), ends[stops - 1].tolist(), strict=True)]
    return list(zip(text[begins].tolist(), cut, last.tolist(), strict=True))


def _chunked(every: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, whole.schema.get_field_index("text"), 1 << 20):
                langs = batch.column("lang").to_pylist()
                found = Counter((langs[n], chunk, last) for n, chunk, last in chunks(batch.column("text").to_pylist(), every))
                columns = [*(zip(*found, strict=True) if found else ((), (), ())), found.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t).cast(k) for c, t, k in zip(columns, _AS, _CHUNKS.types, strict=True)], schema=_CHUNKS)

    return run


_CHUNKS = pa.schema([("lang", pa.string()), ("chunk", pa.string()), ("last", pa.bool_()), ("n", pa.int64())])
_AS = (pa.string(), pa.binary(), pa.bool_(), pa.int64())


def parsed(docs: DataFrame, every: int = 16) -> DataFrame:
    """The dictionary: distinct chunks of each language (lang, chunk, last, n), n being how often each occurs."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(_chunked(every), "lang string, chunk string, last boolean, n long").groupBy("lang", "chunk", "last").agg(F.sum("n").alias("n"))


# Phrases of chunks


class Texts:
    """Strings of words with single spaces between, in one buffer: where words start and end, whose they are, their hashes with the language."""

    def __init__(self, strings: pa.Array, langs: pa.Array):
        offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1].astype(np.int64)
        self.data = np.frombuffer(strings.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets -= offsets[0]
        self.starts = np.sort(np.concatenate((offsets[:-1], np.flatnonzero(self.data == 32) + 1)))
        self.first = np.searchsorted(self.starts, offsets)
        self.lengths = np.diff(self.first)
        self.ends = np.append(self.starts[1:], len(self.data)) - 1
        self.ends[self.first[1:] - 1] += 1
        coded = langs.dictionary_encode()
        self.langs, self.code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        salts = np.array([xxhash.xxh64_intdigest(x.encode()) for x in self.langs.to_pylist()], np.uint64)
        self.hashes = _joined(_word_hashes(self.data, self.starts), np.repeat(salts[self.code], self.lengths))

    def joined(self, n: int) -> np.ndarray:
        """Hashes of the n words from each word on, whether or not they are of one string."""
        h = self.hashes
        for k in range(1, n):
            h = _joined(h[:-1], self.hashes[k:])
        return h


def _known(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> bool:
    """Whether the bytes at a and at b are the same, ``size`` of them each; eight at a time."""
    padded = np.append(data, np.zeros(8, np.uint8))
    eights = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    part = a != b
    a, b, size = a[part], b[part], size[part]
    while len(a):
        unread = (np.maximum(0, 8 - size) * 8).astype(np.uint64)  # bits beyond the end
        if ((eights[a] ^ eights[b]) << unread).any():
            return False
        part = size > 8
        a, b, size = a[part] + 8, b[part] + 8, size[part] - 8
    return True


def phrases(strings: pa.Array, langs: pa.Array, last: np.ndarray, times: np.ndarray, n: int, bits: np.ndarray | None) -> pa.RecordBatch:
    """lang, phrase, f of the phrases of n words in chunks (each occurs ``times`` times), without those that have a part outside ``bits``."""
    t = Texts(strings, langs)
    row = np.repeat(np.arange(len(strings)), t.lengths)
    at = np.arange(len(row))
    room = t.first[1:][row] - at  # words from here on
    good = (room >= n) & (room > np.where(last, 0, SHARED)[row])
    if n > 1:
        alive = _known(bits, t.joined(n - 1))
        good[: max(0, len(alive) - 1)] &= alive[:-1] & alive[1:]
    at = np.flatnonzero(good)
    h = t.joined(n)[at]
    order = np.argsort(h)
    at, h = at[order], h[order]
    new = np.append(True, h[1:] != h[:-1])[: len(h)]
    begin, size, lang = t.starts[at], t.ends[at + n - 1] - t.starts[at], t.code[row[at]]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]  # the first of the same hash
    if not (np.array_equal(size, size[head]) and np.array_equal(lang, lang[head]) and _equal(t.data, begin, begin[head], size)):
        # Different phrases of one hash: grouped by what they are.
        spelled: dict = {}
        group = np.array([spelled.setdefault((x, t.data[b : b + s].tobytes()), len(spelled)) for x, b, s in zip(lang.tolist(), begin.tolist(), size.tolist(), strict=True)], np.int64)
        order = np.argsort(group, kind="stable")
        at, begin, size, lang = at[order], begin[order], size[order], lang[order]
        new = np.append(True, np.diff(group[order]) != 0)
    where = np.flatnonzero(new)
    sums = np.add.reduceat(times[row[at]], where) if len(where) else np.zeros(0, np.int64)
    offsets = np.concatenate(([0], np.cumsum(size[where]))).astype(np.int32)
    text = pa.StringArray.from_buffers(len(where), pa.py_buffer(offsets), pa.py_buffer(ragged(t.data, begin[where], size[where])))
    return pa.RecordBatch.from_arrays([t.langs.take(pa.array(lang[where])), text, pa.array(sums, pa.int64())], schema=_COUNTS)


def _counted(n: int, bits, bytes_at_once: int = 2 << 20) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Phrases of n words of a task's chunks, added up over some megabytes of chunks at a time."""

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        chunk, lang, last, times = (pa.concat_arrays([b.column(c) for b in held]) for c in ("chunk", "lang", "last", "n"))
        return phrases(chunk, lang, last.to_numpy(zero_copy_only=False), times.to_numpy(zero_copy_only=False), n, bits.value if bits else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for whole in batches:
            for batch in by_bytes(whole, whole.schema.get_field_index("chunk"), bytes_at_once):
                held.append(batch)
                size += pc.sum(pc.binary_length(batch.column("chunk"))).as_py() or 0
                if size >= bytes_at_once:
                    yield out(held)
                    held, size = [], 0
        if size:
            yield out(held)

    return run


_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def _places(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Where phrases of n words stand in the bitmap, counted from 1 as Spark's bitmaps do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                h = Texts(batch.column("phrase"), batch.column("lang")).joined(n)[::n]
                yield pa.RecordBatch.from_arrays([pa.array((h >> np.uint64(64 - BITS)).astype(np.int64) + 1)], ["place"])

    return run


def _bitmap(frequent: DataFrame, n: int):
    """A broadcast bitmap of 2^BITS bits of phrases of n words; it comes to the driver in blocks of 4 KB, 16 MB in all."""
    places = frequent.select("lang", "phrase").mapInArrow(_places(n), "place long")
    blocks = places.groupBy(F.expr("bitmap_bucket_number(place)").alias("block")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("bits"))
    bits = np.zeros(1 << BITS - 3, np.uint8)
    for r in blocks.collect():
        begin = (r["block"] - 1) << 12
        bits[begin : begin + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    return frequent.sparkSession.sparkContext.broadcast(bits)


def frequencies(docs: DataFrame, least: int = 30, every: int = 16) -> tuple[list[DataFrame], DataFrame]:
    """For one to four words the phrases (lang, phrase, f) with f >= ``least``, and the number of all words (lang, n)."""
    dictionary = staged(parsed(docs, every), "chunks")
    words = staged(dictionary.mapInArrow(_counted(1, None), _DDL).groupBy("lang", "phrase").agg(F.sum("f").alias("f")), "words")
    found = [words.where(F.col("f") >= least)]
    for n in range(2, LONGEST + 1):
        bits = _bitmap(found[-1], n - 1)
        counted = dictionary.mapInArrow(_counted(n, bits), _DDL).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        found.append(staged(counted.where(F.col("f") >= least), f"phrases{n}"))
        bits.unpersist()
    return found, words.groupBy("lang").agg(F.sum("f").alias("n"))


_DDL = "lang string, phrase string, f long"

# Scores


def _part(first: int, words: int) -> Column:
    return F.array_join(F.slice("words", first, words), " ")


def _scored(found: list[DataFrame]) -> DataFrame:
    """Candidates (lang, phrase, words, a, l, r, score): the cut with the lowest score, of equal ones that after fewer words."""
    big = lambda c: F.col(c).cast("decimal(20,0)")
    out = None
    for n in range(2, LONGEST + 1):
        rows = found[n - 1].select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
        for k in range(1, n):
            left = found[k - 1].select("lang", F.col("phrase").alias("__first"), F.col("f").alias(f"l{k}"))
            right = found[n - k - 1].select("lang", F.col("phrase").alias("__rest"), F.col("f").alias(f"r{k}"))
            rows = rows.withColumns({"__first": _part(1, k), "__rest": _part(k + 1, n - k)}).join(left, ["lang", "__first"]).join(right, ["lang", "__rest"])
            rows = rows.withColumn("__sum", (big(f"l{k}") + big(f"r{k}")).cast("decimal(21,0)")).withColumn("__top", (F.lit(2_000_000).cast("decimal(7,0)") * big("a")).cast("decimal(28,0)"))
            rows = rows.withColumn(f"s{k}", F.expr("__top div __sum")).drop("__first", "__rest", "__sum", "__top")
        best = F.array_min(F.array(*[F.struct(F.col(f"s{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, n)]))
        rows = rows.withColumn("__best", best).select("lang", "phrase", "words", "a", "__best.l", "__best.r", "__best.score")
        out = rows if out is None else out.unionByName(rows)
    return out


def _inside(found: list[DataFrame]) -> DataFrame:
    """(lang, phrase, longest): the largest frequency of a longer candidate that each phrase of two words or more lies in."""
    out = None
    for n in range(3, LONGEST + 1):
        parts = F.array_distinct(F.array(*[_part(at, m) for m in range(2, n) for at in range(1, n - m + 2)]))
        rows = found[n - 1].withColumn("words", F.split("phrase", " ")).select("lang", F.explode(parts).alias("phrase"), "f")
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))


def collocations(docs: DataFrame, least: int = 30, share: int = 80, top: int = 2000, every: int = 16, salts: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language of ``docs`` (text, lang).

    A candidate goes if a longer one around it has at least ``share`` hundredths of its frequency. ``top`` is a feature of the report.
    """
    found, totals = frequencies(docs, least, every)
    rows = _scored(found).drop("words").join(_inside(found), ["lang", "phrase"], "left")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    rows = rows.where(F.col("longest").isNull() | (100 * wide("longest") < share * wide("a"))).drop("longest")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(salts))
    rows = rows.withColumn("__salt", salt).withColumn("__at", F.row_number().over(Window.partitionBy("lang", "__salt").orderBy(*order))).where(F.col("__at") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
