"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are the distinct words of a text (letters only, lower case) and their beginnings of 3 to 6
letters, so that inflected forms share what they have in common. The model has one weight a feature and
ordered thresholds that share these weights: P(grade <= k) = 1 / (1 + exp(w.x - t_k)). It is fitted by
accelerated proximal gradient steps with an L1 penalty on the ``KEPT`` features that part the labels most
clearly. The result is the expected severity, the sum over k of P(grade > k).

``labels`` only says toxic or not. Grade 0 is a text labelled not toxic; toxic texts are graded 1 to 3 by
thirds of the density of telling features, those whose share among toxic texts exceeds that among
others most clearly.

The fit uses a bounded sample of labelled rows (``SAMPLE``, those of smallest hash) and the features
that at least ``LEAST_DOCS`` of them hold; the decision threshold parts this sample best. Scoring reads
all words of all texts.

Defined cases: a null or empty text has no feature and takes the severity of the intercepts; a null
label is left out; repeated labels count each; without any label of one kind nothing is toxic and the
severity is 0; a null doc_id is scored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 5000
LEAST_DOCS = 5
#: Features that the fit may give a weight.
KEPT = 1000
GRADES = 4

_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_LETTERS.findall(text.lower())) if text else set()


def word_features(word: str) -> list[int]:
    """Hashes of the word itself, marked by a closing blank, and of its beginnings."""
    return [crc32(x.encode()) for x in (word + " ", *(word[:n] for n in range(3, min(6, len(word)) + 1)))]


def features(text: str | None) -> np.ndarray:
    """The distinct features of a text, sorted."""
    return np.array(sorted({x for w in words_of(text) for x in word_features(w)}), dtype=np.uint32)


@dataclass
class OrdinalModel:
    """weights by feature, ordered thresholds, and the severity from which a text is toxic."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = (np.inf,) * (GRADES - 1)
    cut: float = 0.5

    def severity(self, texts: pd.Series) -> np.ndarray:
        weights, known = self.weights, getattr(self, "_known", None)
        if known is None:
            known = self._known = {}
        sums = np.zeros(len(texts))
        for i, text in enumerate(texts):
            if len(known) > 150_000:
                known.clear()
            found: set[int] = set()
            for word in words_of(text):
                own = known.get(word)
                if own is None:
                    own = known[word] = tuple(x for x in word_features(word) if x in weights)
                found.update(own)
            sums[i] = sum(weights[x] for x in sorted(found))
        return self.expected(sums)

    def expected(self, sums: np.ndarray) -> np.ndarray:
        return sum((_sigmoid(sums - t) for t in self.thresholds), np.zeros(len(sums)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return (x > -np.inf) / (1 + np.exp(-np.clip(x, -50, 50)))


def telling(rows: list[np.ndarray], toxic: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Features that ``least`` rows hold, and how far their share among toxic rows is from that among the others, in standard errors."""
    found, hot, n1 = np.concatenate(rows), np.repeat(toxic, [len(x) for x in rows]), int(toxic.sum())
    names, which, counts = np.unique(found, return_inverse=True, return_counts=True)
    bad = np.bincount(which.ravel(), hot, len(names))
    n0 = len(rows) - n1
    p = counts / len(rows)
    score = (bad / n1 - (counts - bad) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    return names[counts >= least], score[counts >= least]


def grades(rows: list[np.ndarray], toxic: np.ndarray, names: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Grades 0 to 3."""
    best = np.lexsort((names, -score))[:100]
    marks = names[best[score[best] > 0]]
    density = np.array([np.isin(x, marks).sum() / np.sqrt(1 + len(x)) if bad else 0.0 for x, bad in zip(rows, toxic, strict=True)])
    low, high = np.quantile(density[toxic == 1], [1 / 3, 2 / 3])
    return np.where(toxic == 1, 1 + (density > low) + (density > high), 0)


def fit(rows: list[np.ndarray], toxic: np.ndarray, penalty: float = 1e-3, steps: int = 300, least: int = LEAST_DOCS, most: int = KEPT) -> OrdinalModel:
    """The model of rows of distinct features and 0/1 labels."""
    if len(rows) == 0 or not toxic.any() or toxic.all():
        return OrdinalModel()
    names, score = telling(rows, toxic, least)
    y = grades(rows, toxic, names, score)
    vocabulary = np.sort(names[np.lexsort((names, -np.abs(score)))[:most]])
    cols = [np.flatnonzero(np.isin(vocabulary, x, assume_unique=True)) for x in rows]
    col = np.concatenate(cols)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in cols])
    n, v, k = len(rows), len(vocabulary), GRADES - 1
    share = np.array([(y > j).mean() for j in range(k)]).clip(1e-4, 1 - 1e-4)
    t = np.log(1 - share) - np.log(share)
    balance = np.where(y > 0, min(5.0, (y == 0).sum() / (y > 0).sum()), 1.0)
    u = np.ones(v) / np.sqrt(max(1, v))  # the largest curvature, by power iteration
    for _ in range(20):
        u = np.bincount(col, (balance * np.bincount(row, u[col], n))[row], v) / n
        curvature = float(np.linalg.norm(u)) or 1.0
        u /= curvature
    step = 1 / (0.5 * curvature + 1e-6)
    w, wm, tm, momentum = np.zeros(v), np.zeros(v), t.copy(), 1.0
    w_old, t_old = w.copy(), t.copy()
    for _ in range(steps):
        s = np.bincount(row, wm[col], n)
        edges = np.concatenate([[-np.inf], tm, [np.inf]])
        upper, lower = _sigmoid(edges[y + 1] - s), _sigmoid(edges[y] - s)
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        gw = np.bincount(col, (balance * (du - dl) / n)[row], v)
        gt = np.array([(balance * (dl * (y == j + 1) - du * (y == j))).sum() / n for j in range(k)])
        w = wm - step * gw
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        t = np.maximum.accumulate(tm - step * gt)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        wm, tm = w + (momentum - 1) / after * (w - w_old), t + (momentum - 1) / after * (t - t_old)
        w_old, t_old, momentum = w, t, after
    model = OrdinalModel({int(vocabulary[i]): float(w[i]) for i in np.flatnonzero(w)}, tuple(float(x) for x in t))
    model.cut = best_cut(model.expected(np.bincount(row, w[col], n)), toxic)
    return model


def best_cut(severity: np.ndarray, toxic: np.ndarray) -> float:
    """The severity that parts the labels with the best F1, in the middle of the gap there."""
    order = np.argsort(-severity, kind="stable")
    hits = np.cumsum(toxic[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + toxic.sum())
    ends = np.append(severity[order][1:] < severity[order][:-1], True)
    best = int(np.argmax(np.where(ends, f1, -1)))
    below = severity[order][best + 1] if best + 1 < len(order) else 0.0
    return float((severity[order][best] + below) / 2)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """The model fitted on at most ``sample`` labelled rows."""
    spark = docs.sparkSession
    chosen = labels.where("toxic is not null and doc_id is not null").select("doc_id", F.col("toxic").cast("int")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample).collect()
    if not chosen:
        return OrdinalModel()
    few = spark.createDataFrame([(r[0], r[1]) for r in chosen], "doc_id long, toxic int")
    texts = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("doc_id", "toxic", "text")  # at most ``sample`` rows

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch.doc_id, "toxic": batch.toxic, "found": [features(x).tobytes() for x in batch.text]})

    found = texts.mapInPandas(rows, "doc_id long, toxic int, found binary").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "found").limit(sample).toPandas()
    return fit([np.frombuffer(x, np.uint32) for x in found.found], found.toxic.to_numpy(dtype=np.int64))


def severity(model: OrdinalModel):
    """Column function of the expected severity of a text column."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(model.severity(texts))

    return run


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """(doc_id, severity, grade, is_toxic) of every document."""
    graded = docs.select("doc_id", severity(model)("text").alias("severity"))
    return graded.select("doc_id", "severity", F.round("severity").cast("int").alias("grade"), (F.col("severity") >= F.lit(model.cut)).alias("is_toxic"))


def without_toxic(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    return docs.where(severity(model)("text") < F.lit(model.cut))
