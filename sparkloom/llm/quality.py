"""Quality classifier: a convolutional network over a document's bytes, in numpy.

The UTF-8 bytes are cut into overlapping chunks (``2 * STRIDE`` bytes, every ``STRIDE`` bytes) to the last byte. A chunk's input is
the learned vectors of its bytes and how much the chunk repeats itself (the best share of bytes equal to those ``lag``
bytes before, over lags of up to ``LAGS``). Learned filters over the chunks, max-pooled over all chunks of the document,
are combined into one probability.

It is fitted on a bounded sample of labelled rows (``rows`` of at most ``row_bytes`` bytes) on the driver; the weights, about
100 KB whatever the corpus, go to the executors. The same sample and seed give the same weights.

Edge cases: null and empty texts are scored as one empty chunk; labels other than 0 and 1 are ignored, and without any labelled row
every score is the prior of 0.5; rows that repeat score alike; no documents give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import free_name, held_out, labelled_sample

STRIDE, DIM, FILTERS, LAGS = 16, 6, 24, 24
#: Bytes scored at once in a task, which bounds its memory; a longer document goes through in parts of this size.
BLOCK = 1 << 20

Weights = dict[str, np.ndarray]


def chunk_inputs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in rows of STRIDE with each document padded (value 256), the repeat share of each chunk, and the documents' first rows.

    A document of r rows has chunks of rows (i, i + 1) for i < r - 1; it has two rows at least.
    """
    counts = np.array([max(2, -(-len(t) // STRIDE)) for t in texts])
    first = np.concatenate(([0], np.cumsum(counts)))
    flat = np.full(first[-1] * STRIDE, 256, np.int16)
    for t, at in zip(texts, first[:-1] * STRIDE, strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
    best = np.zeros(first[-1], np.uint8)
    for lag in range(1, LAGS + 1):
        same = np.zeros(len(flat), np.uint8)
        np.equal(flat[lag:], flat[:-lag], out=same[lag:].view(bool))
        np.maximum(best, same.reshape(-1, STRIDE).sum(1, dtype=np.uint8), out=best)
    best[first[1:-1]] = 0  # reaches into the document before
    rows = flat.reshape(-1, STRIDE)
    best[(rows == 256).all(1)] = 0
    return rows, np.minimum(best[:-1], best[1:]).astype(np.float32) / STRIDE, first


def forward(w: Weights, rows: np.ndarray, repeat: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each chunk's filters before pooling (crossing chunks at -inf), and the pooled filters of each document."""
    x = w["bytes"][rows].reshape(len(rows), -1)
    y = x[:-1] @ w["left"] + x[1:] @ w["right"] + repeat[:, None] * w["repeat"] + w["bias"]
    y[first[1:-1] - 1] = -np.inf  # from one document into the next
    return y, np.maximum.reduceat(y, first[:-1], axis=0)


def _logit(w: Weights, pooled: np.ndarray) -> np.ndarray:
    return np.tanh(pooled) @ w["out"] + w["prior"]


def score(w: Weights, texts: list[bytes]) -> np.ndarray:
    """Probability that the label is 1, of each whole text."""
    out = np.empty(len(texts))
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= BLOCK):
            size += len(texts[end])
            end += 1
        if size > BLOCK:  # one long text: parts that overlap by a stride, pooled together
            parts = [texts[at][i : i + BLOCK + STRIDE] for i in range(0, size, BLOCK)]
            pooled = np.max([forward(w, *chunk_inputs([p]))[1][0] for p in parts], axis=0)[None]
        else:
            pooled = forward(w, *chunk_inputs(texts[at:end]))[1]
        out[at:end] = _logit(w, pooled)
        at = end
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(sample: list[tuple[str, int]], seed: int = 1, seen: int = 40_000, batch: int = 32, rate: float = 0.01, prior: float = 0.5) -> Weights:
    """Weights by Adam on the mean log loss, over about ``seen`` documents in 12 to 60 epochs; both labels weigh alike."""
    epochs = min(60, max(12, seen // max(1, len(sample))))
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    w = {"bytes": rng.normal(0, 0.5, (257, DIM)).astype(np.float32), "left": normal(STRIDE * DIM, FILTERS), "right": normal(STRIDE * DIM, FILTERS), "repeat": normal(1, FILTERS)[0], "bias": np.zeros(FILTERS, np.float32), "out": normal(FILTERS), "prior": np.zeros(1, np.float32)}
    texts, labels = [t.encode("utf-8", "surrogatepass") for t, _ in sample], np.array([y for _, y in sample], np.float32)
    if len(set(labels.tolist())) < 2:
        w["out"][:] = 0
        w["prior"][:] = np.log(prior / (1 - prior))
        return w
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    first_moment, second_moment = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            rows, repeat, first = chunk_inputs([texts[i] for i in some])
            y, pooled = forward(w, rows, repeat, first)
            act = np.tanh(pooled)
            p = 1 / (1 + np.exp(-np.clip(act @ w["out"] + w["prior"], -30, 30)))
            d = ((p - labels[some]) * weight[some] / len(some)).astype(np.float32)
            g = {"out": act.T @ d + 1e-4 * w["out"], "prior": np.array([d.sum()], np.float32)}
            dp = d[:, None] * w["out"] * (1 - act**2)  # documents x filters: goes to the chunk that was largest
            arg = np.array([a + y[a : b - 1].argmax(0) for a, b in zip(first[:-1], first[1:], strict=True)])
            g |= {"bias": dp.sum(0), "repeat": (dp * repeat[arg]).sum(0), "bytes": np.zeros_like(w["bytes"])}
            for side, shift in (("left", 0), ("right", 1)):
                at_rows = rows[arg + shift]  # documents x filters x STRIDE
                g[side] = np.einsum("df,dfk->kf", dp, w["bytes"][at_rows].reshape(*arg.shape, -1), optimize=True)
                back = (dp[:, :, None] * w[side].T).reshape(-1, DIM)
                g["bytes"] += np.stack([np.bincount(at_rows.ravel(), back[:, k], 257) for k in range(DIM)], 1).astype(np.float32)
            step += 1
            for k in w:
                first_moment[k] += 0.1 * (g[k] - first_moment[k])
                second_moment[k] += 0.001 * (g[k] ** 2 - second_moment[k])
                w[k] -= rate * (1 - epoch / epochs) * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second_moment[k] / (1 - 0.999**step)) + 1e-8)
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 3000, row_bytes: int = 1 << 16, id_col="doc_id", text_col="text") -> Weights:
    """Train on at most ``rows`` labelled training-fold documents of at most ``row_bytes`` bytes each."""
    return train(labelled_sample(docs, labels, label, rows, row_bytes, id_col, text_col))


def with_score(docs: DataFrame, weights: Weights, text_col="text", out="score") -> DataFrame:
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(score(weights, [(t or "").encode("utf-8", "surrogatepass") for t in texts]), dtype="float64")

    return docs.withColumn(out, scored(text_col))


def quality_table(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = with_score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), fit(docs, labels, id_col=id_col, text_col=text_col))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` without the documents that score below ``threshold``; columns as they were."""
    name = free_name(docs, "__score")
    scored = with_score(docs, fit(docs, labels, id_col=id_col, text_col=text_col), text_col, name)
    return scored.where(F.col(name) >= threshold).drop(name)
