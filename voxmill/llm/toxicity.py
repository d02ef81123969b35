"""Toxicity scores: the largest logit of all overlapping windows of a text, calibrated on texts the network didn't learn from."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.gru import CHARS, WORDS, Adam, Network, Words, joined, read_words, sigmoid, windows
from voxmill.llm.text import slices

SAMPLE = 2400  # labelled texts that the network is fitted on, at most half of either class
EPOCHS, BATCH, RATE = 5, 64, 0.01
STEPS = 240  # a small sample gets more epochs, up to as many batches
FOLDS = 5


@dataclass
class Model:
    """Network and calibration; without both labels in the sample there is no network, only the base rate."""

    base: float
    network: Network | None = None
    slope: tuple[float, float, float] = (0.0, 1.0, 0.0)  # constant, largest logit, log of the number of windows

    def score(self, top: np.ndarray, count: np.ndarray) -> np.ndarray:
        c, a, b = self.slope
        s = sigmoid(c + a * top.astype(np.float64) + b * np.log1p(count))
        return np.where(count > 0, s, self.base)


def tops(network: Network, w: Words) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, ...], np.ndarray]:
    """Largest logit and number of windows of each text, the windows and their logits."""
    text, start, size = windows(w.rows)
    n = len(w.rows) - 1
    logit = network.logits(w, start, size) if len(start) else np.zeros(0, np.float32)
    top = np.full(n, -np.inf, np.float32)
    np.maximum.at(top, text, logit)
    return top, np.bincount(text, minlength=n), (text, start, size), logit


def log_odds(ids: np.ndarray, text: np.ndarray, label: np.ndarray, buckets: int) -> np.ndarray:
    """Smoothed log-odds of the label for texts that hold an id."""
    pairs = np.unique(np.stack([ids, text]), axis=1)
    bad = label[pairs[1]] > 0
    yes, no = np.bincount(pairs[0][bad], minlength=buckets), np.bincount(pairs[0][~bad], minlength=buckets)
    n_yes, n_no = max(label.sum(), 1), max((1 - label).sum(), 1)
    return np.log((yes + 2) / (n_yes + 4)) - np.log((no + 2) / (n_no + 4)) - np.log(2 / (n_yes + 4)) + np.log(2 / (n_no + 4))


def calibrate(top: np.ndarray, count: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Weighted logistic regression on the largest logit and the log of the number of windows, drawn to slope 1."""
    x = np.stack([np.ones(len(top)), top, np.log1p(count)], 1).astype(np.float64)
    b, prior, ridge = np.array([0.0, 1.0, 0.0]), np.array([0.0, 1.0, 0.0]), np.diag([0.01, 1.0, 1.0])

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float(weight @ (np.logaddexp(0, z) - label * z) + (b - prior) @ ridge @ (b - prior) / 2)

    for _ in range(100):
        p = sigmoid(x @ b)
        grad = x.T @ (weight * (p - label)) + ridge @ (b - prior)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, grad)
        size = 1.0
        while size > 1e-6 and loss(b - size * step) > loss(b):
            size /= 2
        b = b - size * step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(b)


def fit(texts: list[str | None], labels: list[int], weights: list[float], seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Fit on a bounded sample. Each epoch learns from each toxic text's likeliest window, and from
    the likeliest and another window of each clean text. A quarter of the sample only calibrates."""
    label, weight = np.array(labels, np.float64), np.array(weights, np.float64)
    base = float((label * weight).sum() / weight.sum()) if len(label) else 0.0
    w = joined([read_words(data, at) for _, data, at in slices(pa.array(texts, pa.large_string()))])
    if not 0 < label.sum() < len(label) or not len(w.at):
        return Model(base)
    rng = np.random.default_rng(seed)
    learn = np.ones(len(label), bool)
    for c in (0, 1):  # of each class a quarter, if that leaves some
        own = rng.permutation(np.flatnonzero(label == c))
        learn[own[: len(own) // 4]] = False
    of_text = np.repeat(np.arange(len(label)), np.diff(w.rows))
    net = Network.new(rng)
    seen = learn[of_text]
    word_odds = log_odds(w.word[w.at][seen], of_text[seen], label, WORDS)
    grams_of = np.diff(w.ends)
    first = np.unique(np.stack([w.at[seen], of_text[seen]]), axis=1)
    size = grams_of[first[0]]
    spread = np.repeat(w.ends[:-1][first[0]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    char_odds = log_odds(w.grams[spread], np.repeat(first[1], size), label, CHARS)
    # the first coordinate of each embedding starts as what it says by itself
    net.params["word"][:, 0] = word_odds / 2
    net.params["char"][:, 0] = char_odds / 2
    text, start, size = windows(w.rows)
    hint = net.inputs(w)[:, 0] + net.inputs(w)[:, net.params["word"].shape[1]]
    total = np.concatenate([[0.0], np.cumsum(np.maximum(hint, 0)[w.at].astype(np.float64))])
    value = (total[start + size] - total[start]) / np.sqrt(size)
    optimiser = Adam(RATE)
    batches = -(-int((learn * np.where(label > 0, 1, 2)).sum()) // BATCH)
    epochs = max(epochs, -(-STEPS // max(batches, 1)))
    for epoch in range(epochs):
        if epoch:
            value = net.logits(w, start, size)
        order = np.lexsort((-value, text))
        best = order[np.unique(text[order], return_index=True)[1]]
        best = best[learn[text[best]]]
        other = rng.permutation(len(text))
        other = other[np.unique(text[other], return_index=True)[1]]
        other = other[learn[text[other]] & (label[text[other]] == 0)]
        chosen = rng.permutation(np.concatenate([best, other]))
        optimiser.rate = RATE * (1 - epoch / epochs)
        for lo in range(0, len(chosen), BATCH):
            i = chosen[lo : lo + BATCH]
            optimiser.update(net.params, net.gradients(w, start[i], size[i], label[text[i]]))
    top, count, _, _ = tops(net, w)
    held = ~learn & (count > 0)
    if not 0 < label[held].sum() < held.sum():
        held = count > 0
    scale = held.sum() / weight[held].sum()
    return Model(base, net, calibrate(top[held], count[held], label[held], weight[held] * scale))


def held_out(doc_id: F.Column) -> F.Column:
    """crc32 of the id as text is divisible by FOLDS; null ids are held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled texts outside the held-out fold, chosen by hash, and weigh
    either class by its share of all of them. Contradicting labels of an id count as toxic."""
    y = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    y = y.where(~held_out(F.col("doc_id")))
    counts = dict(y.groupBy("y").count().collect())
    chosen = [y.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample // 2) for c in (0, 1)]
    ids = chosen[0].union(chosen[1])  # of a fixed size
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((r for pdf in batches for r in pdf.itertuples(index=False)), key=lambda r: r[0])
        got = {c: sum(r[2] == c for r in rows) for c in (0, 1)}
        model = fit([r[1] for r in rows], [r[2] for r in rows], [counts[r[2]] / got[r[2]] for r in rows])
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    # the sample has a fixed bound, so one task can hold it; the driver gets the weights alone
    text = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))  # of several texts of an id always the same one
    fitted = texts.groupBy("doc_id", "y").agg(text.alias("t")).select("doc_id", "t.text", "y").repartition(1).mapInPandas(run, "model binary")
    weights = fitted.first()  # none if Spark knows the sample to be empty
    return pickle.loads(weights[0]) if weights else Model(0.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` it needs, doc_id and text, to (doc_id, held_out, score, predicted, windows)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            for first, data, at in slices(batch.column(2)):
                n = len(at) - 1
                if m.network is None:
                    s, count = np.full(n, m.base), np.zeros(n, np.int64)
                else:
                    top, count, _, _ = tops(m.network, read_words(data, at))
                    s = m.score(np.where(count > 0, top, 0), count)
                arrays = [batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), pa.array(count, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "score", "predicted", "windows"])

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return ready.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, windows long")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted, windows) for every row of ``docs``.

    Reads doc_id and text of ``docs`` and doc_id and toxic of ``labels``; other
    columns are ignored. Every whole text is scored, in windows of 64 words that
    overlap by half. Null and blank texts have no window and get the base rate of
    the label, as do all texts if the labels lack a class. Null labels are ignored;
    repeated rows stay; an empty table gives no rows.
    """
    return score(docs, train(docs, labels, sample))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model doesn't predict to be toxic, with all their columns; no shuffle."""
    sent, at_text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            keep = []
            for _, data, at in slices(batch.column(at_text)):
                n = len(at) - 1
                if m.network is None:
                    keep.append(np.full(n, m.base < 0.5))
                else:
                    top, count, _, _ = tops(m.network, read_words(data, at))
                    keep.append(m.score(np.where(count > 0, top, 0), count) < 0.5)
            if keep:
                yield batch.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
