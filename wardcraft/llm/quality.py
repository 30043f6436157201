"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

A document becomes a vector of transformed statistics (logs, square roots and logits of counts and shares).
Each class has a mean and a covariance, shrunk towards the pooled covariance and its diagonal. A score is the logistic of
the difference of the classes' Gaussian log-densities, from Mahalanobis distances by Cholesky factors that are
computed once. The moments are sums over all labelled training rows, taken by partial aggregation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardcraft.llm.text import as_batch, is_held_out, per_batch, table, table_of, texts
from wardcraft.plans.shared import materialise

TO_POOLED, TO_DIAGONAL, RIDGE, THRESHOLD = 0.05, 0.05, 1e-3, 0.7
_CLASSES = [table_of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), table_of("abcdefghijklmnopqrstuvwxyz"), table_of("0123456789"), table_of(" \t\n\r\x0b\x0c"), table_of(".,;:?'\"-"), table_of("!")]
_SYMBOL = ~np.logical_or.reduce(_CLASSES)
_SYMBOL[128:] = False
_CODE = np.full(256, len(_CLASSES) + 1, np.uint8)  # others: bytes of characters past ASCII
for _k, _t in enumerate([*_CLASSES, _SYMBOL]):
    _CODE[_t] = _k
_WORD = re.compile(rb"[^\s]+")
NAMES = ("log_bytes", "log_words", "word_length", "upper", "lower", "digit", "space", "point", "bang", "symbol", "high", "distinct", "top_word", "lines", "line_copies", "bare")


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of a text in UTF-8, in the order of NAMES. The empty text has the value of zero counts."""
    n = len(text)
    share = np.bincount(_CODE[np.frombuffer(text, np.uint8)], minlength=8)[:8] / max(1, n)
    words = text.split()
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    k = max(1, len(words))
    bare = counts.get(b"|", 0) + counts.get(b"-", 0)
    logit = lambda p: float(np.log((p + 0.01) / (1.01 - p)))
    return [
        float(np.log1p(n)),
        float(np.log1p(len(words))),
        float(np.log1p(n / k)),
        *[logit(float(p)) for p in share],
        logit(min(1.0, (len(counts) + 5) / (k**0.8 + 5))),
        float(np.sqrt(max(counts.values(), default=0) / k)),
        float(np.log1p(len(lines) / k * 20)),
        float(np.sqrt(1 - len(set(lines)) / max(1, len(lines)))),
        float(np.sqrt(bare / k)),
    ]


def _statistics(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = [statistics(x) for x in texts(batch)]
    return as_batch(["doc_id", "x"], [pa.int64(), pa.list_(pa.float64())], [batch.column("doc_id"), rows])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, x: the statistics of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(per_batch(_statistics), "doc_id long, x array<double>")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one partition and class: count, sums and sums of products, as (label, index, value)."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        label = np.array(batch.column("label").to_pylist(), np.int64)
        x = np.array(batch.column("x").to_pylist(), float).reshape(len(label), -1)
        for k in np.unique(label):
            own = np.c_[np.ones((label == k).sum()), x[label == k]]
            total[int(k)] = total.get(int(k), 0) + (own.T @ own).ravel()
    for k, v in total.items():
        yield as_batch(["label", "i", "v"], [pa.int64(), pa.int64(), pa.float64()], [[k] * len(v), list(range(len(v))), v.tolist()])


class Discriminant:
    """Means, inverse Cholesky factors and log-determinants of the classes 0 and 1."""

    def __init__(self, moments: dict[int, np.ndarray], to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL, ridge: float = RIDGE):
        n = {k: m[0, 0] for k, m in moments.items()}
        every = sum(moments.values()) if moments else None
        self.only = None if len(moments) == 2 else float(max(moments, default=1))
        if self.only is not None:
            return
        mean = every[0, 1:] / every[0, 0]
        scale = np.sqrt(np.maximum(np.diag(every)[1:] / every[0, 0] - mean**2, 1e-12))
        self.mean, self.scale = mean, scale
        centres, spreads = {}, {}
        for k, m in moments.items():
            c = m[0, 1:] / n[k]
            spreads[k] = (m[1:, 1:] / n[k] - np.outer(c, c)) / np.outer(scale, scale)
            centres[k] = (c - mean) / scale
        pooled = sum(n[k] * spreads[k] for k in spreads) / sum(n.values())
        self.parts = []
        for k in (0, 1):
            s = (1 - to_pooled) * spreads[k] + to_pooled * pooled
            s = (1 - to_diagonal) * s + to_diagonal * np.diag(np.diag(s)) + ridge * np.eye(len(s))
            factor = np.linalg.cholesky(s)
            self.parts.append((centres[k], np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(n[k] / sum(n.values()))))

    def score(self, x: np.ndarray) -> np.ndarray:
        """For rows of statistics: the probability of class 1. With one class in training: that class; with none: 1."""
        if self.only is not None:
            return np.full(len(x), self.only)
        z = (x - self.mean) / self.scale
        log = [prior - 0.5 * ((((z - c) @ inverse.T) ** 2).sum(1) + det) for c, inverse, det, prior in self.parts]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(rows: DataFrame) -> Discriminant:
    """From rows(label 0 or 1, x). What comes to the driver are two matrices."""
    sums = rows.select(F.col("label").cast("long").alias("label"), "x").where("label in (0, 1)").mapInArrow(_moments, "label long, i long, v double").groupBy("label", "i").agg(F.sum("v").alias("v")).collect()
    size = len(NAMES) + 1
    moments: dict[int, np.ndarray] = {}
    for r in sums:
        moments.setdefault(r.label, np.zeros(size * size))[r.i] = r.v
    return Discriminant({k: m.reshape(size, size) for k, m in moments.items()})


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """documents, labels(doc_id, quality) -> doc_id, held_out, score, predicted; one row per row of docs.

    Trained on the labelled rows that aren't held out; null labels and ids train nothing; labels that are repeated or disagree count once each. A
    null text counts as empty and is scored like any other. Other columns are ignored.
    """
    made = materialise(spark, document_statistics(docs).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "x"), "statistics")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("label")).distinct()
    model = fit(made.where("not held_out").join(marks, "doc_id").select("label", "x"))
    held = spark.sparkContext.broadcast(model)  # two matrices of the statistics' size

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array(batch.column("x").to_pylist(), float).reshape(batch.num_rows, -1)
        s = held.value.score(x)
        return as_batch(["doc_id", "held_out", "score", "predicted"], [pa.int64(), pa.bool_(), pa.float64(), pa.int32()], [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))])

    return made.mapInArrow(per_batch(run), "doc_id long, held_out boolean, score double, predicted int")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
