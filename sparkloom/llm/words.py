"""Ids of the word-end BPE tokenizer for many texts at once: equal to encoding each whole text, and several times as fast.

That tokenizer normalizes (NFC, white space, lower case), cuts at a pattern and merges within each piece only, so a piece's
ids don't depend on its neighbours. A group of texts is cut into pieces by the classes of its characters and these are reduced to distinct
ones (Arrow), which are merged together in numpy, a merge of each piece at a time. Nothing is remembered from one group to the next.
Texts that spell a special token, and pieces over ``WIDE`` bytes, go through the tokenizer itself.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from sparkloom.llm.common import ragged

#: The tokenizer's special tokens, and the classes of its pre-token pattern, 's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3

#: Special tokens, and what the tokenizer takes for symbols, but Python for white space.
SEEN_WHOLE = (*SPECIAL, "\x1c", "\x1d", "\x1e", "\x1f")
#: Bytes of a piece that is merged here, pieces merged at once, and characters that a group of texts has at most (a longer text is a group).
WIDE, COLUMNS, GROUP = 64, 4096, 1 << 20
_NEVER = np.int32(np.iinfo(np.int32).max)


@functools.cache
def _classes() -> np.ndarray:
    """Of every character, by its number."""
    every = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    found = np.full(len(every), OTHER, np.uint8)
    for pattern, kind in ((r"\s+", SPACE), (r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, every):
            found[m.start() : m.end()] = kind
    return found


def cut(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of the text without white space, where each piece of it begins among them, and at which character of the text."""
    if text.isascii():
        chars = np.frombuffer(text.encode(), np.uint8)
        sizes = None
    else:
        chars = np.frombuffer(text.encode("utf-32-le"), "<u4")
        sizes = 1 + (chars >= 0x80) + (chars >= 0x800).view(np.int8) + (chars >= 0x10000)
    kind = _classes()[chars]
    before = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))
    begins = (kind != SPACE) & ((kind != before) | (kind == NUMBER))
    quote = np.flatnonzero(begins & (chars == ord("'")))
    if len(quote):
        last = len(chars) - 1
        one = np.where(quote < last, chars[np.minimum(quote + 1, last)], 0)
        two = np.where(quote < last - 1, chars[np.minimum(quote + 2, last)], 0)
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = ((two == ord("e")) & np.isin(one, [ord("r"), ord("v")])) | ((one == ord("l")) & (two == ord("l")))
        begins[quote[single | double] + 1] = False
        after = np.concatenate((quote[single] + 2, quote[double] + 3))
        after = after[after < len(chars)]
        begins[after] |= kind[after] == LETTER
    kept = kind != SPACE
    at = np.flatnonzero(begins)
    if sizes is None:
        data = chars[kept]
        starts = (np.cumsum(kept, dtype=np.int32) - 1)[at]
    else:
        raw = np.frombuffer(text.encode(), np.uint8)
        data = raw[np.repeat(kept, sizes)]
        sizes *= kept
        starts = (np.cumsum(sizes, dtype=np.int32) - sizes)[at]
    return data, starts, at


class WordIds:
    """The tokenizer of a file; holds the vocabulary's tables alone (some 20 MB)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        spec["normalizer"] = None
        spec["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
        spec["added_tokens"] = []
        self.piece = Tokenizer.from_str(json.dumps(spec))
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_letters()
        self.first = np.array([[vocab[c] for c in letters], [vocab[c + suffix] for c in letters]], np.int32)  # of a byte; of a piece's last byte
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pairs, self.ranks = _table(np.array([vocab[a] << 16 | vocab[b] for a, b in merges], np.uint64))
        self.made = np.array([vocab[a + b.removesuffix(suffix) + (suffix if b.endswith(suffix) else "")] for a, b in merges], np.int32)

    def ids(self, text: str) -> np.ndarray:
        """The text's ids (int32)."""
        return self.batch([text])[0]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """``ids`` of each text."""
        return list(chain.from_iterable(self._group(g) for g in grouped(texts)))

    def _group(self, texts: list[str]) -> list[np.ndarray]:
        normal = [_normal(t) for t in texts]
        lengths = np.array([0 if t is None else len(t) + 1 for t in normal])
        data, starts, at = cut(" ".join([t for t in normal if t is not None]))
        offsets = np.append(starts, len(data)).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        flat, begin, sizes = self._pieces(coded.dictionary)
        of = coded.indices.to_numpy()
        each = sizes[of]
        every = ragged(flat, begin[of], each)
        ends = np.concatenate(([0], np.cumsum(each)))[np.searchsorted(at, np.concatenate(([0], np.cumsum(lengths))))]
        whole = lambda t: np.array(self.whole.encode(t, add_special_tokens=False).ids, np.int32)
        return [whole(t) if n is None else every[a:b] for t, n, a, b in zip(texts, normal, ends[:-1], ends[1:], strict=True)]

    def _pieces(self, pieces: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the pieces, those of like size together; where each piece's begin, and their number."""
        begin = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
        sizes = np.diff(begin)
        parts = []
        starts, lengths = np.zeros((2, len(pieces)), np.int64)
        done = 0
        for size in np.unique(sizes[sizes <= WIDE]):
            at = np.flatnonzero(sizes == size)
            for some in np.array_split(at, -(-len(at) // COLUMNS)):
                ids, n = self._merged(data[begin[some][:, None] + np.arange(size)])
                parts.append(ids)
                lengths[some] = n
                starts[some] = done + np.cumsum(n) - n
                done += len(ids)
        for i in np.flatnonzero(sizes > WIDE):
            ids = np.array(self.piece.encode(pieces[i].as_py(), add_special_tokens=False).ids, np.int32)
            parts.append(ids)
            lengths[i], starts[i] = len(ids), done
            done += len(ids)
        return np.concatenate(parts or [np.zeros(0, np.int32)]), starts, lengths

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each pair among the merges, or _NEVER."""
        key = a.astype(np.uint64) << np.uint64(16) | b.astype(np.uint64)
        slot = _slot(key)
        found = self.pairs[slot]
        rank = np.where(found == key, self.ranks[slot], _NEVER)
        more = np.nonzero((found != key) & (found != _EMPTY))
        while len(more[0]):  # taken by another pair: the next slots
            slot[more] = (slot[more] + 1) % SLOTS
            found = self.pairs[slot[more]]
            rank[more] = np.where(found == key[more], self.ranks[slot[more]], _NEVER)
            on = (found != key[more]) & (found != _EMPTY)
            more = tuple(m[on] for m in more)
        return rank

    def _merged(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of one size (a row of bytes each) end to end, and how many each has.

        Of each piece the leftmost pair of the least rank is merged, until none is left: a column of ``sym`` is a piece.
        """
        size = rows.shape[1]
        sym = np.concatenate([self.first[0][rows[:, :-1].T], self.first[1][rows[:, -1:].T]])
        left = np.full(sym.shape[1], size)
        if size > 1:
            rank = self._rank(sym[:-1], sym[1:])
            live = np.arange(sym.shape[1])
            s = sym
            while len(live):
                at = rank.argmin(0)
                column = np.arange(len(live))
                least = rank[at, column]
                on = least != _NEVER
                if not on.all():
                    sym[:, live] = s
                    live, at, least, s, rank = live[on], at[on], least[on], s[:, on], rank[:, on]
                    column = np.arange(len(live))
                    if not len(live):
                        break
                left[live] -= 1
                s[at, column] = self.made[least]
                behind = np.arange(len(s) - 1)[:, None] > at  # what follows the pair moves up
                s[:-1] = np.where(behind, s[1:], s[:-1])
                s[-1] = -1
                rank[:-1] = np.where(behind[:-1], rank[1:], rank[:-1])
                rank[-1] = _NEVER
                for d in (-1, 0):
                    i = at + d
                    ok = np.flatnonzero((i >= 0) & (i + 1 < left[live]))
                    i = i[ok]
                    rank[i, ok] = self._rank(s[i, ok], s[i + 1, ok])
                gone = np.flatnonzero(at == left[live] - 1)
                rank[at[gone], gone] = _NEVER
        kept = np.arange(size)[:, None] < left
        return sym.T[kept.T], left


SLOTS = 1 << 18
_EMPTY = np.uint64(np.iinfo(np.uint64).max)


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)


def _table(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash table: keys and their places in ``keys``, each in the first free slot from its own on."""
    pairs, ranks = np.full(SLOTS, _EMPTY), np.full(SLOTS, _NEVER)
    slot, left = _slot(keys), np.arange(len(keys))
    while len(left):
        free = left[pairs[slot[left]] == _EMPTY]
        _, one = np.unique(slot[free], return_index=True)
        won = free[one]
        pairs[slot[won]], ranks[slot[won]] = keys[won], won
        left = left[pairs[slot[left]] != keys[left]]
        slot[left] = (slot[left] + 1) % SLOTS
    return pairs, ranks


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 itself, the rest from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


def grouped(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of at most GROUP characters together, a longer text alone."""
    group, size = [], 0
    for t in texts:
        if group and size + len(t) > GROUP:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


def _normal(text: str) -> str | None:
    """The text as the tokenizer normalizes it, but for its white space; None if the tokenizer has to see the text whole."""
    if any(x in text for x in SEEN_WHOLE):
        return None
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()  # letter by letter: no final sigma


_LOADED: dict[str, WordIds] = {}


def loaded(path: str) -> WordIds:
    """One per worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]
