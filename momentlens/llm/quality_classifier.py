"""Quality: positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are labelled documents of quality 1; the unlabelled side is a sample of the documents
themselves, whatever their label; negative labels are never used. With the class prior pi, a small network g minimises
pi * E_p[l(g, +)] + max(0, E_u[l(g, -)] - pi * E_p[l(g, -)]), l the logistic loss; where the second part
falls below zero, only its gradient is followed, upwards. sigmoid(g) is the score.

The prior is estimated from positives and unlabelled rows alone: one half of both fits a network that tells them apart, and on the other half
pi is the least ratio, over thresholds, of the shares of unlabelled rows and of positives above a threshold, each with its
sampling error (the best bin: above it, unlabelled rows are positives).

Fitting uses at most ``MOST_ROWS`` positives and about as many unlabelled documents (whole texts), of which only
the measures below leave the tasks; scoring reads all rows. Unlabelled rows are drawn row by row, without a shuffle; of a positive id one row is read.

Defined cases: a null or blank text has all measures 0 and is scored by them; very long texts are measured whole; repeated rows are scored
each; null labels and ids are not learnt from; with no usable positive every score is 0, the fewer positives or unlabelled rows, the nearer is the prior to 0.5, which counts like ``PRIOR_ROWS`` rows; an empty table gives an
empty result; further columns of ``docs`` stay, one named ``c_score`` is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from momentlens.llm.common import documents, fold, in_arrow, text_chunks
from momentlens.llm.labelled import sample
from momentlens.llm.quality_rules import STOP_WORDS

MOST_ROWS = 6000
HIDDEN = 16
ROUNDS = 600
PRIOR_ROWS = 20
SEED = 7
_STOPS = frozenset(w.encode() for ws in STOP_WORDS.values() for w in ws.split())
_KEEP = {k: bytes(b for b in range(256) if b not in set(v)) for k, v in {"upper": range(65, 91), "digit": range(48, 58), "symbol": b"#*$%&|<>@~^=_{}[]\\", "stop": b".,;:?", "bang": b"!"}.items()}
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MEASURES = 13


def measures(text: bytes) -> list[float]:
    """Shares and logarithms that describe a text, none of them by what it is about."""
    words = text.translate(_LOWER).split()
    n = len(words)
    if not n:
        return [0.0] * MEASURES
    size = sum(map(len, words))
    count = {k: len(text.translate(None, drop)) for k, drop in _KEEP.items()}
    lines = [x for x in text.split(b"\n") if x.strip()]
    often = Counter(words)
    return [
        np.log1p(n), size / n, count["upper"] / size, count["digit"] / size, count["symbol"] / n, count["stop"] / n, count["bang"] / n,
        sum(v for k, v in often.items() if k in _STOPS) / n, len(often) / n, max(often.values()) / n, len(set(lines)) / len(lines), n / len(lines) / 50, sum(1 for w in words if len(w) == 1) / n,
    ]


class Network:
    """One hidden layer over standardised measures."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, rng: np.random.Generator):
        self.mean, self.spread = mean, spread
        k = len(mean)
        self.w = [rng.normal(0, 1 / np.sqrt(k), (k, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        h = np.tanh(z @ self.w[0] + self.w[1])
        return h @ self.w[2] + self.w[3], h, z

    def gradient(self, into: np.ndarray, h: np.ndarray, z: np.ndarray) -> list[np.ndarray]:
        """Of a sum over rows, by each row's derivative ``into``."""
        back = into[:, None] * self.w[2] * (1 - h * h)
        return [z.T @ back, back.sum(axis=0), h.T @ into, into.sum(keepdims=True)]

    def score(self, texts: list[bytes]) -> np.ndarray:
        g = self.forward(np.array([measures(t) for t in texts]).reshape(-1, MEASURES))[0]
        return 1 / (1 + np.exp(-np.clip(g, -500, 500)))


def apart(positive: np.ndarray, unlabelled: np.ndarray) -> Network:
    """A network that tells positives from unlabelled rows, by the logistic loss."""
    return fit(positive, unlabelled, 0.0, 1.0)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """The share of positives among unlabelled rows, by the best bin, drawn towards one half by as much as ``PRIOR_ROWS`` rows weigh against those at hand."""
    rows = min(len(positive), len(unlabelled))
    if rows < 2:  # nothing to hold out, so one half is all that is known
        return 0.5
    net = apart(positive[::2], unlabelled[::2])
    p, u = (np.sort(net.forward(x[1::2])[0]) for x in (positive, unlabelled))
    above = lambda x: 1 - np.searchsorted(x, p, side="left") / len(x)
    error = np.sqrt(np.log(4 / confidence) / 2 / len(u)) + np.sqrt(np.log(4 / confidence) / 2 / len(p))
    best = int(np.argmin((above(u) + error) / above(p)))
    found = float(np.clip(above(u)[best] / above(p)[best], 0.05, 0.95))
    return (rows * found + PRIOR_ROWS * 0.5) / (rows + PRIOR_ROWS)


def risk(gp: np.ndarray, gu: np.ndarray, prior: float, weight: float) -> tuple[float, float]:
    """Of outputs on positives and unlabelled rows: the part of the positives, which counts ``weight``, and that of the negatives, which the positives among the unlabelled are taken from."""
    return weight * float(np.logaddexp(0, -gp).mean()), float(np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean())


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, weight: float | None = None) -> Network:
    """``weight``: of the positives' loss, the prior unless given."""
    weight = prior if weight is None else weight
    rng = np.random.default_rng(SEED)
    net = Network(unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6, rng)
    first, second = [np.zeros_like(w) for w in net.w], [np.zeros_like(w) for w in net.w]
    sigmoid = lambda g: 1 / (1 + np.exp(-np.clip(g, -50, 50)))
    for step in range(1, ROUNDS + 1):
        p, u = (x[rng.integers(0, len(x), min(len(x), 1024))] for x in (positive, unlabelled))
        gp, hp, zp = net.forward(p)
        gu, hu, zu = net.forward(u)
        _, negative = risk(gp, gu, prior, weight)
        # derivatives of l(g, -) = log(1 + e^g) and l(g, +) = log(1 + e^-g)
        of_negative = [a - b for a, b in zip(net.gradient(sigmoid(gu) / len(gu), hu, zu), net.gradient(prior * sigmoid(gp) / len(gp), hp, zp), strict=True)]
        of_positive = net.gradient(-weight * sigmoid(-gp) / len(gp), hp, zp)
        gradient = [a + b for a, b in zip(of_positive, of_negative, strict=True)] if negative >= 0 else [-x for x in of_negative]
        for k, g in enumerate(gradient):
            g = g + 1e-4 * net.w[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            net.w[k] = net.w[k] - 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


def _measured(docs: DataFrame, text_col: str) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_chunks(batches, text_col):
            yield pa.RecordBatch.from_arrays([pa.array([measures(t) for t in texts], pa.list_(pa.float64()))], names=["m"])

    rows = in_arrow(docs.select(text_col), run, "m array<double>").toPandas()["m"]
    return np.array(rows.tolist(), float).reshape(-1, MEASURES)


def scored(docs: DataFrame, labels: DataFrame, usable: F.Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = MOST_ROWS) -> DataFrame:
    """``docs`` with ``c_score``. ``usable``: which label rows may be learnt from."""
    docs = docs.drop("c_score")
    chosen = sample(labels, label_col, usable, most, id_col).where("label = 1")
    others = docs.where(usable & F.col(id_col).isNotNull())
    some = others.where(F.rand(SEED) < most / max(1, others.count()))
    positive = _measured(docs.join(F.broadcast(chosen), id_col, "left_semi").dropDuplicates([id_col]), text_col)
    unlabelled = _measured(some, text_col)
    if not len(positive) or not len(unlabelled):
        return docs.withColumn("c_score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(fit(positive, unlabelled, class_prior(positive, unlabelled)))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_chunks(batches, text_col):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(texts))], names=[*names, "c_score"])

    return in_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField("c_score", T.DoubleType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document's quality; fold 2 of 4 is held out."""
    of = fold(F.col("doc_id"), 4)
    d = scored(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"), of != 2)
    return d.select("doc_id", (of == 2).alias("held_out"), F.col("c_score").alias("score"), (F.col("c_score") >= 0.7).cast("int").alias("predicted"))
