"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text is its lower-cased words. A word's input is a learned vector of the word itself (hashed) plus those of its character
runs (``GRAMS`` bytes long, word ends included, hashed), so inflected and unseen words share what they are made of. The network
reads windows of ``WINDOW`` words that start every ``STEP`` words, to the last word, both ways; attention over a window's states gives
the window's score, and the document's score is that of its worst window.

It is fitted on a bounded sample of labelled rows on the driver: labels are of whole documents, so each step learns from the worst window
of each document. The weights (about 3 MB, whatever the corpus) go to the executors. Same sample, same weights.

Edge cases: null and empty texts are one window of padding; labels other than 0 and 1 are ignored, without both labels every score is 0;
rows that repeat score alike; no documents give no rows.
"""

from __future__ import annotations

import re
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import free_name, held_out, labelled_sample, ragged

WINDOW, STEP, DIM, HIDDEN, ATTENTION, GRAMS = 32, 24, 12, 10, 8, (3, 4, 6)
BUCKETS = 1 << 15
#: Documents, words and windows that a task handles at once.
DOCS, WORDS, WINDOWS = 400, 40_000, 4096

Weights = dict[str, np.ndarray]
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def gram_ids(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed inputs of each word, and where each word's begin: the word itself, then its character runs."""
    marked = [b"^" + w.encode("utf-8", "surrogatepass") + b"$" for w in words]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    flat = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(words)), lengths)
    last = np.repeat(np.cumsum(lengths), lengths)  # one past the word's end
    ids = [np.fromiter(map(crc32, marked), np.uint32, len(marked)) % BUCKETS]
    of = [np.arange(len(words))]
    for n in GRAMS:
        h = np.full(max(0, len(flat) - n + 1), n, np.uint32)
        for k in range(n):
            h = (h ^ flat[k : k + len(h)]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        fits = np.arange(len(h)) + n <= last[: len(h)]
        ids.append(h[fits] % BUCKETS + BUCKETS)
        of.append(owner[: len(h)][fits])
    of, ids = np.concatenate(of), np.concatenate(ids).astype(np.int64)
    order = np.argsort(of, kind="stable")
    return ids[order], np.searchsorted(of[order], np.arange(len(words)))


def word_vectors(w: Weights, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Mean over each word's inputs, scaled by the square root of their number."""
    n = np.diff(np.append(starts, len(ids)))
    return np.add.reduceat(w["table"][ids], starts, axis=0) / np.sqrt(n)[:, None].astype(np.float32)


def window_counts(n: np.ndarray) -> np.ndarray:
    """How many windows cover n words."""
    return np.maximum(1, -(-(n - WINDOW) // STEP) + 1)


def windows(counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places (one per window and word; -1: padding) in the documents' words end to end, and each document's first window."""
    n = np.array(counts)
    per = window_counts(n)
    first = np.concatenate(([0], np.cumsum(per)))
    within = np.arange(first[-1]) - np.repeat(first[:-1], per)
    at = within[:, None] * STEP + np.arange(WINDOW)
    base = np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), per)
    return np.where(at < np.repeat(n, per)[:, None], at + base[:, None], -1), first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _run(x: np.ndarray, u: np.ndarray, backwards: bool, keep: list | None = None) -> np.ndarray:
    """States (step, window, HIDDEN) of one direction; x: (step, window, 3 HIDDEN) inputs. ``keep`` gets what the gradient needs."""
    h = np.zeros((x.shape[1], HIDDEN), np.float32)
    out = np.empty((x.shape[0], x.shape[1], HIDDEN), np.float32)
    for t in range(x.shape[0] - 1, -1, -1) if backwards else range(x.shape[0]):
        a = h @ u
        gates = _sigmoid(x[t, :, : 2 * HIDDEN] + a[:, : 2 * HIDDEN])
        r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
        new = np.tanh(x[t, :, 2 * HIDDEN :] + r * a[:, 2 * HIDDEN :])
        if keep is not None:
            keep.append((t, h, r, z, new, a[:, 2 * HIDDEN :]))
        h = new + z * (h - new)
        out[t] = h
    return out


def read(w: Weights, inputs: tuple[np.ndarray, np.ndarray], mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logit of each window. inputs: (step, window, 3 HIDDEN) for either direction; mask: (step, window), True at words."""
    kept = ([], []) if keep is not None else (None, None)
    states = np.concatenate([_run(inputs[0], w["u0"], False, kept[0]), _run(inputs[1], w["u1"], True, kept[1])], axis=2)
    hidden = np.tanh(states @ w["attend"] + w["attend_bias"])
    e = np.where(mask, hidden @ w["focus"], -1e9)
    e = np.exp(e - e.max(0))
    share = e / e.sum(0)
    context = (share[:, :, None] * states).sum(0)
    if keep is not None:
        keep |= {"runs": kept, "states": states, "hidden": hidden, "share": share, "context": context}
    return context @ w["out"] + w["prior"]


def _inputs(w: Weights, vectors: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids: (step, window) rows of ``vectors``; -1 is padding, whose vector is zero."""
    both = []
    for k in (0, 1):
        x = np.concatenate([vectors @ w[f"x{k}"], np.zeros((1, 3 * HIDDEN), np.float32)]) + w[f"b{k}"]
        both.append(x[ids])
    return both[0], both[1]


def _mask(ids: np.ndarray) -> np.ndarray:
    mask = ids >= 0
    mask[0] = True  # a window of padding alone attends to its first place
    return mask


def _grouped(lists: list[list[str]]):
    """Runs of documents of at most DOCS documents and WORDS words, a longer document alone."""
    at = 0
    while at < len(lists):
        end, size = at, 0
        while end < len(lists) and end - at < DOCS and (end == at or size + len(lists[end]) <= WORDS):
            size += len(lists[end])
            end += 1
        yield at, end
        at = end


def numbered(lists: list[list[str]]) -> tuple[list[str], np.ndarray]:
    """The distinct words, and all words end to end as places among them."""
    place = dict.fromkeys(chain.from_iterable(lists))
    place.update(zip(place, range(len(place)), strict=True))
    return list(place), np.fromiter(map(place.__getitem__, chain.from_iterable(lists)), np.int64)


def logits(w: Weights, lists: list[list[str]]) -> list[np.ndarray]:
    """For each document, given as words, the logits of all its windows."""
    out: list[np.ndarray] = []
    for a, b in _grouped(lists):
        some = lists[a:b]
        known, flat = numbered(some)
        vectors = np.concatenate([word_vectors(w, *gram_ids(known[i : i + WORDS])) for i in range(0, len(known), WORDS)] or [np.zeros((0, DIM), np.float32)])
        place, first = windows([len(ws) for ws in some])
        flat = np.append(flat, -1)
        found = []
        for i in range(0, len(place), WINDOWS):
            ids = np.ascontiguousarray(flat[place[i : i + WINDOWS]].T)
            found.append(read(w, _inputs(w, vectors, ids), _mask(ids)))
        each = np.concatenate(found)
        out += [each[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]
    return out


def score(w: Weights, texts: list[str | None]) -> np.ndarray:
    """Probability that the label is 1, of each whole text: its worst window's."""
    lists = [words_of(t) for t in texts]
    worst = np.array([x.max() for x in logits(w, lists)], np.float64)
    return _sigmoid(np.clip(worst, -30, 30))


def initial(seed: int = 1) -> Weights:
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    w = {"table": np.zeros((2 * BUCKETS, DIM), np.float32), "attend": normal(2 * HIDDEN, ATTENTION), "attend_bias": np.zeros(ATTENTION, np.float32), "focus": normal(ATTENTION), "out": normal(2 * HIDDEN), "prior": np.zeros(1, np.float32)}
    for k in (0, 1):
        w |= {f"x{k}": normal(DIM, 3 * HIDDEN), f"u{k}": normal(HIDDEN, 3 * HIDDEN), f"b{k}": np.zeros(3 * HIDDEN, np.float32)}
    return w


def gradient(w: Weights, vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[Weights, np.ndarray, np.ndarray]:
    """Gradients of the weighted log loss of windows ``ids`` (step, window), those of ``vectors``, and the logits."""
    keep: dict = {}
    mask = _mask(ids)
    inputs = _inputs(w, vectors, ids)
    logit = read(w, inputs, mask, keep)
    d = ((_sigmoid(logit) - labels) * weight).astype(np.float32)
    states, share, hidden, context = keep["states"], keep["share"], keep["hidden"], keep["context"]
    g: Weights = {"prior": d.sum(keepdims=True), "out": context.T @ d}
    dc = d[:, None] * w["out"]
    ds = share[:, :, None] * dc
    dshare = (states * dc).sum(2)
    de = share * (dshare - (share * dshare).sum(0)) * mask
    g["focus"] = np.einsum("tb,tba->a", de, hidden)
    dh = de[:, :, None] * w["focus"] * (1 - hidden**2)
    g["attend"], g["attend_bias"] = np.einsum("tbs,tba->sa", states, dh), dh.sum((0, 1))
    ds = ds + dh @ w["attend"].T
    dv = np.zeros((len(vectors) + 1, DIM), np.float32)
    for k in (0, 1):
        u, down = w[f"u{k}"], ds[:, :, k * HIDDEN : (k + 1) * HIDDEN]
        dx, du, carry = np.zeros_like(inputs[k]), np.zeros_like(u), np.zeros((ids.shape[1], HIDDEN), np.float32)
        for t, h, r, z, new, an in reversed(keep["runs"][k]):
            dh_t = down[t] + carry
            dnew = dh_t * (1 - z) * (1 - new**2)
            dz = dh_t * (h - new) * z * (1 - z)
            dr = dnew * an * r * (1 - r)
            dx[t] = np.concatenate([dr, dz, dnew], axis=1)
            da = np.concatenate([dr, dz, dnew * r], axis=1)
            du += h.T @ da
            carry = dh_t * z + da @ u.T
        g[f"u{k}"], g[f"b{k}"] = du, dx.sum((0, 1))
        by_word = np.zeros((len(vectors) + 1, 3 * HIDDEN), np.float32)
        rows, sums = summed(ids.ravel(), dx.reshape(-1, 3 * HIDDEN))
        by_word[rows] = sums  # -1 is the last row: padding
        g[f"x{k}"] = vectors.T @ by_word[:-1]
        dv += by_word @ w[f"x{k}"].T
    return g, dv[:-1], logit


class Sample:
    """Labelled texts as places among their distinct words, and the hashed inputs of each such word."""

    def __init__(self, texts: list[str]):
        lists = [words_of(t) for t in texts]
        known, flat = numbered(lists)
        self.counts = np.array([len(ws) for ws in lists])
        self.begin = np.cumsum(self.counts) - self.counts
        self.flat = flat.astype(np.int32)
        parts = [gram_ids(known[i : i + WORDS]) for i in range(0, len(known), WORDS)]
        self.ids = np.concatenate([ids.astype(np.int32) for ids, _ in parts] or [np.zeros(0, np.int32)])
        self.sizes = np.concatenate([np.diff(np.append(starts, len(ids))) for ids, starts in parts] or [np.zeros(0, np.int64)])
        self.starts = np.cumsum(self.sizes) - self.sizes

    def inputs_of(self, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``gram_ids``, of these words."""
        return ragged(self.ids, self.starts[known], self.sizes[known]), np.cumsum(self.sizes[known]) - self.sizes[known]

    def places(self, docs: np.ndarray, window: np.ndarray) -> np.ndarray:
        """(step, window): words of one window of each of ``docs``; -1 is padding."""
        at = window * STEP + np.arange(WINDOW)[:, None]
        held = at < self.counts[docs]
        out = np.full(at.shape, -1)
        out[held] = self.flat[(self.begin[docs] + at)[held]]
        return out

    def worst(self, w: Weights) -> np.ndarray:
        """The window of each document that scores highest."""
        vectors = [word_vectors(w, *self.inputs_of(np.arange(i, min(i + WORDS, len(self.sizes))))) for i in range(0, len(self.sizes), WORDS)]
        inputs = [np.concatenate([v @ w[f"x{k}"] for v in vectors] + [np.zeros((1, 3 * HIDDEN), np.float32)]) + w[f"b{k}"] for k in (0, 1)]
        per = window_counts(self.counts)
        ends = np.cumsum(per)
        found = np.empty(ends[-1], np.float32)
        for i in range(0, len(found), WINDOWS):
            number = np.arange(i, min(i + WINDOWS, len(found)))
            docs = np.searchsorted(ends, number, "right")
            ids = self.places(docs, number - (ends - per)[docs])
            found[number] = read(w, (inputs[0][ids], inputs[1][ids]), _mask(ids))
        return np.array([found[a:b].argmax() for a, b in zip(ends - per, ends, strict=True)])


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``rows``, and the sum of ``values`` over each."""
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return ordered[first], np.add.reduceat(values[order], first, axis=0)


def train(sample: list[tuple[str, int]], seed: int = 1, seen: int = 24_000, batch: int = 32, rate: float = 0.01, table_rate: float = 0.05, decay: float = 0.003, toxic_share: float = 0.3) -> Weights:
    """Weights by Adam (Adagrad with decay for the table), over about ``seen`` documents in 8 to 60 epochs.

    The first epoch learns from windows at random, for a start, each later one from every document's worst window at its beginning.
    Label 1 weighs ``toxic_share`` of all, whatever its share of the sample.
    """
    w = initial(seed)
    labels = np.array([y for _, y in sample], np.float32)
    if len(set(labels.tolist())) < 2:
        w["out"][:], w["prior"][:] = 0, -30
        return w
    rng = np.random.default_rng(seed)
    texts = Sample([t for t, _ in sample])
    weight = np.where(labels == 1, toxic_share / labels.mean(), (1 - toxic_share) / (1 - labels.mean())).astype(np.float32)
    dense = [k for k in w if k != "table"]
    m, v = ({k: np.zeros_like(w[k]) for k in dense} for _ in range(2))
    seen_sq = np.full(2 * BUCKETS, 1e-6, np.float32)
    epochs, step = min(60, max(8, seen // len(sample))), 0
    for epoch in range(epochs):
        slow = 1 - epoch / epochs
        worst = texts.worst(w) if epoch else None
        order = rng.permutation(len(sample))
        for at in range(0, len(order), batch):
            docs = order[at : at + batch]
            if epoch:
                window = worst[docs]
            else:
                docs = np.repeat(docs, 4)
                window = rng.integers(0, window_counts(texts.counts[docs]))
            place = texts.places(docs, window)
            known, ids = np.unique(place[place >= 0], return_inverse=True)
            place[place >= 0] = ids
            inputs, starts = texts.inputs_of(known)
            vectors = word_vectors(w, inputs, starts) if len(known) else np.zeros((0, DIM), np.float32)
            g, dv, _ = gradient(w, vectors, place, labels[docs], weight[docs] / len(docs))
            step += 1
            for k in dense:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                w[k] -= rate * slow * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            if len(known):
                n = texts.sizes[known]
                touched, dt = summed(inputs, np.repeat(dv / np.sqrt(n)[:, None].astype(np.float32), n, axis=0))
                seen_sq[touched] += (dt**2).mean(1)
                w["table"][touched] -= table_rate * slow * dt / np.sqrt(seen_sq[touched])[:, None]
            w["table"] *= 1 - decay * slow
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 4000, row_bytes: int = 1 << 16, id_col="doc_id", text_col="text") -> Weights:
    """Train on at most ``rows`` labelled training-fold documents of at most ``row_bytes`` bytes each."""
    return train(labelled_sample(docs, labels, label, rows, row_bytes, id_col, text_col))


def with_score(docs: DataFrame, weights: Weights, text_col="text", out="score") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        w = shared.value
        return pd.Series(np.concatenate([score(w, texts[i : i + DOCS].tolist()) for i in range(0, len(texts), DOCS)] or [np.zeros(0)]), dtype="float64")

    return docs.withColumn(out, scored(text_col))


def toxicity_table(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = with_score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), fit(docs, labels, id_col=id_col, text_col=text_col))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` without the documents that score ``threshold`` or more; columns as they were."""
    name = free_name(docs, "__score")
    scored = with_score(docs, fit(docs, labels, id_col=id_col, text_col=text_col), text_col, name)
    return scored.where(F.col(name) < threshold).drop(name)
