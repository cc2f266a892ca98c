"""Toxicity categories by a chain of linear classifiers.

The categories are predicted one after another.  Each is a logistic regression
on word presence, on the text's shares of marks, capitals, digits and distinct
words, and on the log-odds of the categories before it.  While training, those come out of fold: a document's
earlier probabilities are from models that have not seen it, so a later model
learns how far an earlier one is to be trusted on new documents.

Training uses at most `max_train` labelled documents, those with the least
hash of their id; it is the one bounded sample here.  One task trains on the
hashed words of these documents, and the weights go to the driver.  Every document is
scored, each by its whole text.

Defined results: a null or empty text has no words and is scored by its shape
alone; ids without a label are scored like others; where a category has only
one class in the sample, its probability is that class's.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

BUCKETS = 1 << 22
_WORD = re.compile(r"\w+")
SHAPES = 4
_MARK = re.compile(r"[^\w\s.,]")
_UPPER = re.compile(r"[A-Z]")
_DIGIT = re.compile(r"\d")


class Model(NamedTuple):
    buckets: np.ndarray  # word buckets, ascending
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # buckets, shapes, earlier categories, bias


def features(text: str | None, memo: dict[str, int]) -> tuple[np.ndarray, list[float]]:
    """Buckets of the distinct words, ascending, and shape measures."""
    text = text or ""
    words = set(_WORD.findall(text.lower()))
    if len(memo) > 100_000:
        memo.clear()
    new = words.difference(memo)
    for w in new:
        memo[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
    ids = np.unique(np.fromiter(map(memo.__getitem__, words), np.int32, len(words)))
    n = max(len(text), 1)
    return ids, [len(_MARK.findall(text)) / n, len(_UPPER.findall(text)) / n, len(_DIGIT.findall(text)) / n, np.log1p(len(words)) - np.log1p(text.count(" "))]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _select(docs: list[np.ndarray], y: np.ndarray, keep: int, least: float) -> np.ndarray:
    """Buckets whose presence depends most on the class, by the G statistic."""
    n1, n0 = max(y.sum(), 1), max(len(y) - y.sum(), 1)
    a = np.bincount(np.concatenate([docs[i] for i in np.flatnonzero(y)] or [[0]]).astype(int), minlength=BUCKETS)
    b = np.bincount(np.concatenate([docs[i] for i in np.flatnonzero(y == 0)] or [[0]]).astype(int), minlength=BUCKETS)
    seen = np.flatnonzero(a + b >= 3)
    a, b = a[seen].astype(float), b[seen].astype(float)

    def part(obs: np.ndarray, exp: np.ndarray) -> np.ndarray:
        return obs * np.log(np.maximum(obs, 1e-9) / np.maximum(exp, 1e-9))

    p = (a + b) / (n0 + n1)
    g = 2 * (part(a, n1 * p) + part(n1 - a, n1 * (1 - p)) + part(b, n0 * p) + part(n0 - b, n0 * (1 - p)))
    best = np.argsort(-g, kind="stable")[:keep]
    return np.sort(seen[best[g[best] >= least]])


def _matrix(docs: list[np.ndarray], shapes: np.ndarray, earlier: np.ndarray, m: Model) -> np.ndarray:
    k = len(m.buckets)
    x = np.zeros((len(docs), k + SHAPES + earlier.shape[1] + 1))
    for i, d in enumerate(docs):
        if k:
            at = np.searchsorted(m.buckets, d)
            hit = at[(at < k) & (m.buckets[np.minimum(at, k - 1)] == d)]
            x[i, hit] = 1
    # an odd share says no more than the edge of the usual range
    x[:, k : k + SHAPES] = np.clip((shapes - m.center) / m.scale, -2.5, 2.5)
    x[:, k + SHAPES : -1] = earlier
    x[:, -1] = 1
    return x


def _fit(docs: list[np.ndarray], shapes: np.ndarray, earlier: np.ndarray, y: np.ndarray, keep: int, ridge: float) -> Model:
    m = Model(_select(docs, y, keep, 10.0), shapes.mean(0), shapes.std(0) + 1e-6, np.zeros(0))
    x = _matrix(docs, shapes, earlier, m)
    w = np.zeros(x.shape[1])
    rate = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    w[-1] = np.log(rate / (1 - rate))
    k = len(m.buckets)
    penalty = np.full(len(w), ridge)
    penalty[k : k + SHAPES] = 10 * ridge  # words count for more than shapes
    if 0 < y.sum() < len(y):
        for _ in range(12):  # Newton steps
            p = _sigmoid(x @ w)
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
            w += step
            if np.abs(step).max() < 1e-5:
                break
    return m._replace(weights=w)


def train(docs: list[np.ndarray], shapes: np.ndarray, labels: np.ndarray, fold: np.ndarray, keep: int = 160, ridge: float = 1.0) -> list[Model]:
    """One model for each column of labels, in order."""
    chain, earlier = [], np.zeros((len(docs), 0))
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        chain.append(_fit(docs, shapes, earlier, y, keep, ridge))
        if c + 1 < labels.shape[1]:
            out = np.zeros(len(docs))
            for f in np.unique(fold):
                on, off = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                on = on if len(on) else off
                m = _fit([docs[i] for i in on], shapes[on], earlier[on], y[on], keep, ridge)
                out[off] = np.clip(_matrix([docs[i] for i in off], shapes[off], earlier[off], m) @ m.weights, -8, 8)
            earlier = np.column_stack([earlier, out])
    return chain


def predict(chain: list[Model], docs: list[np.ndarray], shapes: np.ndarray) -> np.ndarray:
    """Probabilities, a column for each category."""
    earlier = np.zeros((len(docs), 0))
    for m in chain:
        earlier = np.column_stack([earlier, np.clip(_matrix(docs, shapes, earlier, m) @ m.weights, -8, 8)])
    return _sigmoid(earlier)


def fit(documents: DataFrame, labels: DataFrame, categories: list[str], *, id_col: str = "doc_id", text_col: str = "text", max_train: int = 20_000, folds: int = 5) -> list[Model]:
    """Train on labelled documents; categories are 0/1 columns of labels."""
    key = F.xxhash64(F.col("k"))
    some = labels.select(labels[id_col].alias("k"), *(labels[c].cast("int").alias(f"y{i}") for i, c in enumerate(categories))).dropna()
    some = some.groupBy("k").agg(*(F.max(f"y{i}").alias(f"y{i}") for i in range(len(categories))))
    some = F.broadcast(some.orderBy(key, "k").limit(max_train))  # at most max_train rows of ids and labels
    rows = documents.select(documents[id_col].alias("k"), documents[text_col].cast("string").alias("t")).join(some, "k")
    n = len(categories)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for b in batches:
            found = [features(t, memo) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([x[0] for x in found], pa.list_(pa.int32())), pa.array([x[1] for x in found], pa.list_(pa.float64()))], names=["h", *(f"y{i}" for i in range(n)), "words", "shapes"])

    names = [f"y{i}" for i in range(n)]
    found = rows.select("t", key.alias("h"), *names).mapInArrow(run, f"h long, {', '.join(f'{y} int' for y in names)}, words array<int>, shapes array<double>")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        chain = _trained(pa.Table.from_batches(got) if got else None, names, folds)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps([tuple(m) for m in chain])], pa.binary())], names=["model"])

    # one task trains on the bounded sample; the driver gets the weights
    (row,) = found.repartition(1).mapInArrow(learn, "model binary").collect()
    return [Model(*m) for m in pickle.loads(row["model"])]  # noqa: S301  made just now


def _trained(got: pa.Table | None, names: list[str], folds: int) -> list[Model]:
    if got is None or not got.num_rows:
        return train([np.zeros(0, np.int32)], np.zeros((1, SHAPES)), np.zeros((1, len(names))), np.zeros(1))
    hashed = got["h"].to_numpy()
    order = np.argsort(hashed, kind="stable")
    words = got["words"].combine_chunks()
    flat, ends = words.values.to_numpy(), words.offsets.to_numpy()
    docs = [flat[ends[i] : ends[i + 1]] for i in order.tolist()]
    shapes = got["shapes"].combine_chunks().flatten().to_numpy().reshape(-1, SHAPES)[order]
    y = np.column_stack([got[c].to_numpy() for c in names])[order]
    return train(docs, shapes, y, (hashed[order].view(np.uint64) >> np.uint64(7)) % np.uint64(folds))


def score(documents: DataFrame, chain: list[Model], categories: list[str], *, text_col: str = "text", prefix: str = "p_") -> DataFrame:
    """documents with the probability of each category in p_<category>."""

    @F.arrow_udf("array<double>")
    def chances(texts: pa.Array) -> pa.Array:
        memo = _MEMO
        found = [features(t, memo) for t in texts.to_pylist()]
        if not found:
            return pa.array([], pa.list_(pa.float64()))
        p = predict(chain, [x[0] for x in found], np.array([x[1] for x in found]))
        return pa.array(list(p), pa.list_(pa.float64()))

    (tmp,) = fresh(documents, "__chances__")
    out = documents.withColumn(tmp, chances(documents[text_col].cast("string")))
    for i, c in enumerate(categories):
        out = out.withColumn(f"{prefix}{c}", F.col(tmp)[i])
    return out.drop(tmp)


_MEMO: dict[str, int] = {}
CATEGORIES = ["low_quality", "toxic"]


def fitted(documents: DataFrame, labels: DataFrame) -> list[Model]:
    return fit(documents, labels.select("doc_id", (1 - labels["quality"]).alias("low_quality"), labels["toxic"]), CATEGORIES)


def classify(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the chain's probabilities, and whether the document counts as toxic."""
    scored = score(documents.select(documents["doc_id"].cast("long"), documents["text"]), fitted(documents, labels), CATEGORIES)
    return scored.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= threshold).alias("toxic"))
