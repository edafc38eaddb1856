"""Toxicity grades by cumulative-link ordinal regression.

One weight vector over sparse text features serves all thresholds: the chance of a grade
above k is ``sigmoid(w . x - t_k)`` with ordered thresholds t_1 < t_2 < ..., and the
expected severity is the sum of those chances. Features are the words of a text and the
first letters of its words; those that tell the grades apart best are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mdforge.llm.common import map_batches

#: Labelled texts that fit the model: chosen by a hash of the id (a documented bound).
FIT_TEXTS = 20_000
#: Features kept, letters of a stem, weight decay, and steps of the fit.
FEATURES, STEMS, DECAY, STEPS = 3_000, (4, 5, 6), 3e-4, 400

_WORDS = re.compile(r"[^\W\d_]+")


def features_of(text: str | None) -> set[str]:
    """Distinct lower-cased words, and stems marked by a star, of a whole text."""
    words = set(_WORDS.findall(text.lower())) if text else set()
    return words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in STEMS))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Sparse:
    """Rows of feature numbers, as flat arrays."""

    def __init__(self, rows: list[list[int]]) -> None:
        self.n, self.at = len(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.feature = np.fromiter(chain.from_iterable(rows), np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, w[self.feature], self.n)

    def sums(self, g: np.ndarray, features: int) -> np.ndarray:
        """Gradient of the weights from the gradient of every row's score."""
        return np.bincount(self.feature, g[self.at], features)


class Ordinal:
    """Features with shared weights, and ordered thresholds."""

    def __init__(self, features: list[str], weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.number = {f: k for k, f in enumerate(features)}
        self.weights, self.thresholds = weights, thresholds

    def rows(self, texts: list[str | None]) -> Sparse:
        get = self.number
        return Sparse([[get[f] for f in features_of(t) if f in get] for t in texts])

    def above(self, x: Sparse) -> np.ndarray:
        """Chance of a grade above each threshold, rows x thresholds."""
        return sigmoid(x.dot(self.weights)[:, None] - self.thresholds[None, :])


def select(texts: list[str], grades: np.ndarray, n: int = FEATURES) -> list[str]:
    """The features whose presence is most correlated with the grade, either way."""
    seen, sums = Counter(), Counter()
    for t, y in zip(texts, grades, strict=True):
        f = features_of(t)
        seen.update(f)
        if y:
            for x in f:
                sums[x] += float(y)
    size, mean, spread = len(texts), float(np.mean(grades)), float(np.std(grades)) or 1.0
    z = {f: (sums[f] - c * mean) / (spread * np.sqrt(c * max(1 - c / size, 1e-9))) for f, c in seen.items() if c >= 3}
    return sorted(sorted(z, key=lambda f: (-abs(z[f]), f))[:n])


def fit_ordinal(texts: list[str], grades: np.ndarray, top: int) -> Ordinal:
    """Maximum likelihood with weight decay, by adaptive gradient steps on all rows.

    Thresholds are a first one and positive gaps, so they stay ordered.
    """
    features = select(texts, grades)
    model = Ordinal(features, np.zeros(len(features)), np.zeros(top))
    x = model.rows(texts)
    share = np.clip([(grades >= k).mean() for k in range(1, top + 1)], 1e-4, 1 - 1e-4)
    start = -np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    params = np.concatenate([model.weights, start[:1], gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    y = np.asarray(grades, int)
    for step in range(1, STEPS + 1):
        w, t = params[: len(features)], np.cumsum(np.concatenate([params[len(features) :][:1], np.exp(params[len(features) + 1 :])]))
        p = np.column_stack([np.ones(len(y)), sigmoid(x.dot(w)[:, None] - t), np.zeros(len(y))])
        here, beyond = p[np.arange(len(y)), y], p[np.arange(len(y)), y + 1]
        chance = np.maximum(here - beyond, 1e-12)
        # d log chance / d score, and / d each threshold that bounds the grade.
        d_here, d_beyond = here * (1 - here) / chance, beyond * (1 - beyond) / chance
        g_w = -x.sums(d_here - d_beyond, len(features)) / len(y) + DECAY * w / 10
        g_t = np.zeros(top)
        np.add.at(g_t, y[y > 0] - 1, d_here[y > 0] / len(y))
        np.add.at(g_t, y[y < top], -d_beyond[y < top] / len(y))
        g_tail = np.cumsum(g_t[::-1])[::-1].copy()
        g_tail[1:] *= np.exp(params[len(features) + 1 :])
        g = np.concatenate([g_w, g_tail])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params = params - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    w, t = params[: len(features)], np.cumsum(np.concatenate([params[len(features) :][:1], np.exp(params[len(features) + 1 :])]))
    return Ordinal(features, w, t)


def graded(texts: list[str], toxic: np.ndarray) -> np.ndarray:
    """Grades 0..2 from a yes/no label: toxic texts with many words that mark toxic texts are severe.

    A word or stem marks toxic texts if it is at least twenty times as frequent there. A
    toxic text is severe if it has more such words than half of the toxic texts.
    """
    yes, no = Counter(), Counter()
    for t, y in zip(texts, toxic, strict=True):
        (yes if y else no).update(features_of(t))
    n, k = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    marks = {f for f, c in yes.items() if c >= 3 and c / n >= 20 * (no[f] + 0.5) / k}
    many = np.array([len(features_of(t) & marks) if y else 0 for t, y in zip(texts, toxic, strict=True)])
    middle = np.median(many[toxic > 0]) if toxic.any() else 0
    return np.where(toxic > 0, 1 + (many > middle), 0)


def fit(docs: DataFrame, labels: DataFrame, fit_texts: int = FIT_TEXTS) -> Ordinal | None:
    """The model of texts (doc_id, text) and labels (doc_id, grade) or yes/no (doc_id, toxic).

    Documents without text or label are left out. The first ``fit_texts`` labels by a hash
    of the id are broadcast (at most so many rows), so the texts are scanned and not
    shuffled; the chosen ones meet in the one task that fits the model, whose features,
    weights and thresholds reach the driver. None without labelled texts.
    """
    grade = "grade" if "grade" in labels.columns else "toxic"
    rows = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(grade).cast("int").alias("y")).where("_id is not null and y >= 0")
    rows = rows.groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_id", F.lit(9)), "_id").limit(fit_texts)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").where("text is not null")
    chosen = texts.join(F.broadcast(rows), "_id").select("text", "y").repartition(1)

    def run(batches):
        texts, y = [], []
        for b in batches:
            texts.extend(b.column("text").to_pylist())
            y.extend(b.column("y").to_pylist())
        y = np.array(y, int)
        if not len(y):
            return
        if grade == "toxic":
            y = graded(texts, np.minimum(y, 1))
        top = max(1, int(y.max()))
        model = fit_ordinal(texts, y, top)
        names = [*model.number, *(f"threshold {k}" for k in range(top))]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate([model.weights, model.thresholds]))], ["name", "value"])

    got = chosen.mapInArrow(run, "name string, value double").toArrow()
    names, values = got.column("name").to_pylist(), got.column("value").to_numpy()
    top = sum(x.startswith("threshold ") for x in names)
    return Ordinal(names[:-top], values[:-top], values[-top:]) if top else None


def severities(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, severity, p_toxic, toxic) for every whole text of ``docs``.

    ``severity``: expected grade; ``p_toxic``: chance of a grade above 0; ``toxic``: that
    it is a half or more. A null or empty text has severity 0, as has every text when
    nothing is labelled. Ids may be null or repeat; other columns are left out.
    """
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, own = b.column("text").to_pylist(), shared.value
        p = own.above(own.rows(texts)) if own else np.zeros((len(texts), 1))
        p[[not t for t in texts]] = 0
        cols = [b.column("doc_id"), pa.array(p.sum(1)), pa.array(p[:, 0]), pa.array(p[:, 0] >= 0.5)]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "severity", "p_toxic", "toxic"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, severity double, p_toxic double, toxic boolean")
