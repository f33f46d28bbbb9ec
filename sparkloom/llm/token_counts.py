"""Edit-aware token counts: a tree of counts over a document's pre-tokens, kept so that an edit costs what it touches.

A byte-level BPE cuts a text into pre-tokens by a pattern and merges within each alone. The tree's leaves are blocks of pre-tokens (their
lengths in characters and their token counts); inner nodes hold sums, the root the document's. An edit (place, characters
deleted, text inserted) goes down the tree to the pre-tokens around it, cuts and encodes again from a little before the edit to
the first old boundary behind it, changes the blocks in between and the sums above them. Everything else is kept as it was.

How far before: the pattern looks two characters past the end of what it matches at most, so boundaries up to three characters
before the edit hold. How far behind: matching has no memory, so from the first boundary that both texts share, they agree.

Edge cases: null and empty texts have no pre-tokens and count 0; places beyond the text are its end; the edits of a document don't overlap
and give places in the text before all of them (of two at one place, the later in the list comes later in the text); a document without edits
keeps its tree; no documents give no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import by_bytes

BLOCK, LOOK = 64, 3
#: Fixed value: the pre-token pattern of the 50k byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token counts of pre-tokens, of which at most ``kept`` are remembered."""

    def __init__(self, path: str, kept: int = 300_000):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)
        self.kept, self.known = kept, {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[p] for p in pieces]
        except KeyError:
            pass
        new = {p: len(self.encoding.encode_ordinary(p)) for p in set(pieces).difference(known)}
        if len(known) + len(new) > self.kept:
            known.clear()
        out = [new[p] if p in new else known[p] if p in known else len(self.encoding.encode_ordinary(p)) for p in pieces]
        known.update((p, n) for p, n in new.items() if len(p) <= 40 and len(known) < self.kept)
        return out


class Tree:
    """blocks: (lengths, counts) of the pre-tokens; sums: (characters, tokens) by node, node i's children being 2i and 2i + 1."""

    def __init__(self, blocks: list[tuple[list[int], list[int]]]):
        self.blocks = blocks or [([], [])]
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        for i, (lengths, counts) in enumerate(self.blocks):
            self.sums[self.width + i] = sum(lengths), sum(counts)
        n = self.width
        while n > 1:  # a level at a time
            self.sums[n // 2 : n] = self.sums[n : 2 * n : 2] + self.sums[n + 1 : 2 * n : 2]
            n //= 2

    @classmethod
    def of(cls, text: str, encoder: Encoder) -> Tree:
        pieces = encoder.pattern.findall(text)
        lengths, counts = list(map(len, pieces)), encoder.counts(pieces)
        return cls([(lengths[i : i + BLOCK], counts[i : i + BLOCK]) for i in range(0, len(lengths), BLOCK)])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, at: int) -> tuple[int, int]:
        """The block that holds character ``at`` (the last with any, beyond the end), and the characters before it."""
        at = min(at, int(self.sums[1, 0]) - 1)
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if at - before >= self.sums[node, 0]:
                before += int(self.sums[node, 0])
                node += 1
        return max(0, min(node - self.width, len(self.blocks) - 1)), before

    def edit(self, old: str, new: str, at: int, deleted: int, inserted: int, encoder: Encoder) -> int:
        """Make this the tree of ``new``, which is ``old`` with ``deleted`` characters at ``at`` replaced by ``inserted``; the pre-tokens encoded again."""
        first, start = self.find(max(0, at - LOOK))
        lengths = self.blocks[first][0]
        keep = 0
        while keep < len(lengths) and start + lengths[keep] <= max(0, at - LOOK):
            start += lengths[keep]
            keep += 1
        # Old boundaries from there, as they come; block and place of each.
        block, place, old_at = first, keep, start
        pieces, now, shift = [], start, inserted - deleted
        while True:
            while old_at + shift < now or old_at < at + deleted:
                while block < len(self.blocks) and place >= len(self.blocks[block][0]):
                    block, place = block + 1, 0
                if block == len(self.blocks):
                    break
                old_at += self.blocks[block][0][place]
                place += 1
            if old_at + shift == now and old_at >= at + deleted or now >= len(new):
                break
            m = encoder.pattern.match(new, now)
            pieces.append(m[0])
            now = m.end()
        if now >= len(new):
            block, place = len(self.blocks), 0
        counts = encoder.counts(pieces)
        tail = ([], [])
        if block < len(self.blocks):
            tail = self.blocks[block][0][place:], self.blocks[block][1][place:]
        head = self.blocks[first][0][:keep], self.blocks[first][1][:keep]
        self.blocks[first] = head[0] + list(map(len, pieces)) + tail[0], head[1] + counts + tail[1]
        changed = range(first, min(block + 1, len(self.blocks)))
        for i in changed[1:]:
            self.blocks[i] = ([], [])
        if len(self.blocks[first][0]) > 8 * BLOCK:  # grown too large: cut it, which makes a new tree of the same blocks
            a, b = self.blocks[first]
            self.__init__(self.blocks[:first] + [(a[i : i + BLOCK], b[i : i + BLOCK]) for i in range(0, len(a), BLOCK)] + [x for x in self.blocks[first + 1 :] if x[0]])
            return len(pieces)
        nodes = np.array([self.width + i for i in changed])
        for node in nodes:
            lengths, tokens = self.blocks[node - self.width]
            self.sums[node] = sum(lengths), sum(tokens)
        while nodes[0] > 1:
            nodes = np.unique(nodes // 2)
            self.sums[nodes] = self.sums[2 * nodes] + self.sums[2 * nodes + 1]
        return len(pieces)


def apply_edits(tree: Tree, text: str, edits: list[tuple[int, int, str]], encoder: Encoder) -> tuple[str, int]:
    """The edited text, and how many pre-tokens were encoded again. From the last edit to the first, so that places hold."""
    again = 0
    for _, (at, deleted, inserted) in sorted(enumerate(edits), key=lambda e: (e[1][0], e[0]), reverse=True):
        at = min(max(0, at), len(text))
        deleted = min(max(0, deleted), len(text) - at)
        new = text[:at] + inserted + text[at + deleted :]
        again += tree.edit(text, new, at, deleted, len(inserted), encoder)
        text = new
    return text, again


_LOADED: dict[str, Encoder] = {}


def _loaded(path: str) -> Encoder:
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


TREE = "lengths array<array<int>>, counts array<array<int>>"


def build_trees(docs: DataFrame, vocabulary: str, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, lengths, counts, n_tokens: each document's tree by its blocks, to be kept beside the documents."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _loaded(vocabulary)
        kind = pa.list_(pa.list_(pa.int32()))
        for batch in batches:
            for part in by_bytes(batch, 1):
                trees = [Tree.of(t, encoder) for t in part.column(1).to_pylist()]
                blocks = [pa.array([[b[k] for b in t.blocks] for t in trees], kind) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *blocks, pa.array([t.tokens for t in trees], pa.int64())], ["doc_id", "lengths", "counts", "n_tokens"])
        encoder.known.clear()  # workers are reused

    return rows.mapInArrow(build, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {TREE}, n_tokens long")


def update_trees(edited: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, edited_text, lengths, counts, n_tokens, edited_tokens, n_pretokens, reencoded.

    ``edited`` has doc_id, text, edits (array<struct<at:int,deleted:int,inserted:string>>) and, where trees were kept, lengths and counts;
    without them each tree is built first. Only pre-tokens around edits are encoded (``reencoded`` says how many).
    """
    kept = {"lengths", "counts"} <= set(edited.columns)
    rows = edited.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.transform(F.coalesce("edits", F.array()), lambda e: F.struct(e["at"].alias("at"), e["deleted"].alias("deleted"), F.coalesce(e["inserted"], F.lit("")).alias("inserted"))).alias("edits"), *(["lengths", "counts"] if kept else []))

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _loaded(vocabulary)
        for batch in batches:
            for part in by_bytes(batch, 1):
                columns = [c.to_pylist() for c in part.columns[1:]]
                out = []
                for text, edits, *tree in zip(*columns, strict=True):
                    tree = Tree([(a, b) for a, b in zip(*tree, strict=True)]) if kept and tree[0] is not None else Tree.of(text, encoder)
                    before = tree.tokens
                    new, again = apply_edits(tree, text, [(e["at"], e["deleted"], e["inserted"]) for e in edits or []], encoder)
                    out.append((new, [b[0] for b in tree.blocks], [b[1] for b in tree.blocks], before, tree.tokens, sum(len(b[0]) for b in tree.blocks), again))
                kinds = [pa.string(), *[pa.list_(pa.list_(pa.int32()))] * 2, *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], ["doc_id", "edited_text", "lengths", "counts", "n_tokens", "edited_tokens", "n_pretokens", "reencoded"])
        encoder.known.clear()  # workers are reused

    return rows.mapInArrow(update, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, edited_text string, {TREE}, n_tokens long, edited_tokens long, n_pretokens long, reencoded long")


def sample_edits(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, text, edits: three edits of each document, at a quarter, half and three quarters of its characters.

    The first deletes 7 characters, the second inserts the first 20 characters of the text, the third changes 5 characters to the id.
    """
    n = F.char_length(F.coalesce(text_col, F.lit("")))
    edit = lambda k, deleted, inserted: F.struct(F.floor(n * k / 4).cast("int").alias("at"), F.lit(deleted).alias("deleted"), inserted.alias("inserted"))
    edits = F.array(edit(1, 7, F.lit("")), edit(2, 0, F.substring(F.coalesce(text_col, F.lit("")), 1, 20)), edit(3, 5, F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    # Short texts: edits that would overlap are left out.
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.when(n >= 32, edits).otherwise(F.slice(edits, 2, 1)).alias("edits"))


def token_counts_table(docs: DataFrame, vocabulary: str, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_tokens, edited_tokens, n_pretokens, reencoded, edited_sha256 of every document and its sample edits."""
    found = update_trees(sample_edits(docs, id_col, text_col), vocabulary)
    return found.select("doc_id", "n_tokens", "edited_tokens", "n_pretokens", "reencoded", F.sha2("edited_text", 256).alias("edited_sha256"))
