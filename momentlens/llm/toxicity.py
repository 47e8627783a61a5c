"""Toxicity: class-conditional Kneser-Ney bigram models, compared by length-normalised log-likelihood.

Both classes have interpolated bigrams with absolute discounts,
p_k(w | u) = max(c_k(u w) - D_k, 0) / c_k(u) + b_k(u) * P_k(w), over their own continuation counts,
P_k(w) = max(N_k(w) - D'_k, 0) / N_k + b_k * P(w), over continuation rates that both classes share, each class
weighing one half, P(w) = ((N_0(w) / N_0 + N_1(w) / N_1) / 2 + 1 / (N_0 + N_1)) / its sum; the b are what the discounts leave
over. D = n1 / (n1 + 2 n2), by class and level. An expression keeps counts of its own if the mean of its two rates (of a bigram: among all
bigrams) isn't under a cut-off and one class's rate (of a bigram: in its context) is some times the other's, to which one occurrence is
added; else both classes leave it to what they share, so that neither rare expressions nor those of a language or a topic that one class has a
little more often are evidence. Both limits come from ``CUTS`` by the log-loss on labelled texts that the counts left out, which also
fit the logistic curve that turns evidence into a probability. As rates and not counts are compared, class sizes don't change what is kept.
Equal texts are learnt from once, and a bigram counts once in each text, so that neither copies nor repeated lines make up
evidence. A text's evidence is (log p(text | toxic) - log p(text | ordinary)) / words.

Fitting uses at most ``PER_CLASS`` labelled documents of each class (whole texts); scoring reads all rows.
The model that is sent to the tasks has at most ``MOST_NGRAMS`` bigrams and as many words, those of the highest rates.

Defined cases: a null text, or one without words, has evidence 0 and gets the score of that evidence; very long texts are
read whole, in time that grows with their length; repeated rows are scored each; documents without a label or with a null one are not
learnt from; with no usable labels of one class every score is the share of toxic labels, at most 0.49 (0 with none); an empty
table gives an empty result; further columns of ``docs`` stay, one named ``t_score`` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from momentlens.llm.common import documents, fold, in_arrow, text_chunks, written
from momentlens.llm.labelled import sample

PER_CLASS = 4000
MOST_NGRAMS = 200_000
#: Limits that are tried: so many occurrences in the smaller class, or as high a rate in the other one; and so many times the other class's rate.
CUTS = tuple((least, apart) for apart in (2, 4, 8, 16) for least in (4, 8, 16, 32, 64))
#: One in so many sampled documents fits the curve and not the counts.
CURVE = 4
#: A-Z to a-z; bytes that are no letters, digits, apostrophes or parts of other characters to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 or b == 39 else 32 for b in range(256))
_JVM_WORDS = r"[\x00-\x26\x28-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Model:
    """Counts by word number (0: any other word) and by bigram; two columns: ordinary, toxic."""

    def __init__(self, words: list[str], kinds: np.ndarray, all_kinds: np.ndarray, context: np.ndarray, bigrams: np.ndarray, counts: np.ndarray, all_counts: np.ndarray, discount: np.ndarray):
        """``kinds``: continuation counts; ``all_kinds`` and ``all_counts``: their and the bigrams' sums, over what isn't in the model too; ``discount``: of continuations and bigrams, by class."""
        self.number = {w.encode(): k for k, w in enumerate(words, 1)}
        n = len(words) + 1
        self.kinds, self.all_kinds, self.all_counts = np.vstack((np.zeros((1, 2)), kinds)), np.maximum(all_kinds, 1), np.maximum(all_counts, 1)
        self.context, self.discount = np.vstack((np.zeros((1, 2)), context)), discount
        self.key = bigrams[:, 0] * n + bigrams[:, 1]
        order = np.argsort(self.key)
        self.key, self.counts = self.key[order], counts[order].astype(float).reshape(-1, 2)
        self.slope, self.offset = 1.0, 0.0
        self.cut(*CUTS[0])

    @staticmethod
    def _apart(counts: np.ndarray, of: np.ndarray, times: float) -> np.ndarray:
        rate, most = counts / np.maximum(of, 1), (counts + 1) / (of + 1)
        return (rate >= times * most[:, ::-1]).any(axis=1)

    def cut(self, least: float, apart: float) -> None:
        """Leave n-grams of a mean rate under ``least`` occurrences in the smaller class, or whose rates aren't ``apart`` times each other, to what both classes share."""
        n, of = len(self.kinds), self.all_kinds
        shared = (self.kinds / of).mean(axis=1) + 1 / of.sum()  # of word 0: an expression that is seen once at most
        shared /= shared.sum()
        common = ((self.kinds / of).mean(axis=1) >= least / 2 / of.min()) & self._apart(self.kinds, of, apart)
        kept = np.where(common[:, None], np.maximum(self.kinds - self.discount[0], 0), 0) / of
        self.word = kept + (1 - kept.sum(axis=0)) * shared[:, None]
        size = self.context[self.key // n]
        common = ((self.counts / self.all_counts).mean(axis=1) >= least / 2 / self.all_counts.min()) & self._apart(self.counts, size, apart)
        self.arc = np.where(common[:, None], np.maximum(self.counts - self.discount[1], 0), 0) / np.maximum(size, 1)
        self.backoff = np.ones((n, 2))
        np.subtract.at(self.backoff, self.key // n, self.arc)
        self.backoff = np.maximum(self.backoff, 1e-9)

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        split = [t.translate(_FOLD).split() for t in texts]
        get, n = self.number.get, len(self.word)
        lengths = np.array([len(w) for w in split], np.int64)
        ids = np.fromiter((get(w, 0) for ws in split for w in ws), np.int64, int(lengths.sum()))
        if not len(ids):
            return np.zeros(len(texts))
        before = np.concatenate(([0], ids[:-1]))
        starts = np.cumsum(lengths) - lengths
        before[starts[lengths > 0]] = 0
        p = self.backoff[before] * self.word[ids]
        if len(self.key):
            key = before * n + ids
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            seen = self.key[at] == key
            p[seen] += self.arc[at[seen]]
        sums = np.concatenate(([0], np.cumsum(np.log(p[:, 1]) - np.log(p[:, 0]))))
        return (sums[starts + lengths] - sums[starts]) / np.maximum(lengths, 1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.evidence(texts) + self.offset, -500, 500)))


def counted(texts: DataFrame) -> DataFrame:
    """(label, u, w, n): how many ``texts`` (text, label) of a class have a bigram; u is empty before a first word."""
    words = F.filter(F.split(F.translate("text", _UPPER, _UPPER.lower()), _JVM_WORDS), lambda x: x != "")
    # pairs as texts, as finding distinct structs compares all with all
    pairs = F.array_distinct(F.zip_with(F.concat(F.array(F.lit("")), F.slice("ws", F.lit(1), F.size("ws") - 1)), "ws", lambda u, w: F.concat(u, F.lit(" "), w)))
    found = texts.select("label", words.alias("ws")).where(F.size("ws") > 0).select("label", F.explode(pairs).alias("p")).groupBy("label", "p").agg(F.count(F.lit(1)).alias("n"))
    return found.select("label", F.substring_index("p", " ", 1).alias("u"), F.substring_index("p", " ", -1).alias("w"), "n")


def _by_class(name: str, value: F.Column) -> list[F.Column]:
    return [F.coalesce(F.sum(F.when(F.col("label") == k, value)), F.lit(0)).cast("long").alias(f"{name}{k}") for k in (0, 1)]


def _sums(counts: DataFrame) -> np.ndarray:
    """By class, of (label, n): how many there are, their sum, and how many are one and two."""
    got = {r["label"]: r[1:] for r in counts.groupBy("label").agg(F.sum("n"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).collect()}
    return np.array([got.get(k, (0, 0, 0)) for k in (0, 1)], float).T


def fit(docs: DataFrame, chosen: DataFrame, prior: float, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """``chosen``: (id, label), a bounded sample; ``prior``: the share of toxic documents."""
    texts = docs.join(F.broadcast(chosen), id_col).select(F.coalesce(text_col, F.lit("")).alias("text"), "label", (F.pmod(F.xxhash64(F.lit("curve"), id_col), F.lit(CURVE)) == 0).alias("curve"))
    texts = written(texts.groupBy("label", "text").agg(F.min("curve").alias("curve")).repartition(docs.sparkSession.sparkContext.defaultParallelism * 2), "labelled-texts")
    counts = written(counted(texts.where("not curve")), "bigrams")
    kinds = written(counts.groupBy("label", "w").agg(F.count(F.lit(1)).alias("n")), "continuations")
    (all_counts, *ones), (all_kinds, *single) = _sums(counts), _sums(kinds)
    discount = np.array([a / np.maximum(a + 2 * b, 1) for a, b in (single, ones)])
    rate = lambda name, sums: sum(F.col(f"{name}{k}") / float(max(sums[k], 1)) for k in (0, 1))
    by_word = kinds.groupBy("w").agg(*_by_class("k", F.col("n"))).where("k0 + k1 > 1").orderBy(rate("k", all_kinds).desc(), "w").limit(MOST_NGRAMS)
    by_context = counts.groupBy(F.col("u").alias("w")).agg(*_by_class("c", F.col("n")))
    words = by_word.join(by_context, "w", "left").select("w", "k0", "k1", F.coalesce("c0", F.lit(0)).alias("c0"), F.coalesce("c1", F.lit(0)).alias("c1")).toPandas()
    pairs = counts.where("u != ''").groupBy("u", "w").agg(*_by_class("n", F.col("n"))).where("n0 + n1 > 1").orderBy(rate("n", all_counts).desc(), "u", "w").limit(MOST_NGRAMS).toPandas()
    number = {w: k for k, w in enumerate(words["w"], 1)}
    u, w = pairs["u"].map(number).fillna(0).astype(int), pairs["w"].map(number).fillna(0).astype(int)
    known = ((u > 0) & (w > 0)).to_numpy()
    model = Model(
        words["w"].tolist(), words[["k0", "k1"]].to_numpy(), all_kinds, words[["c0", "c1"]].to_numpy(),
        np.stack((u, w), axis=1)[known].reshape(-1, 2), pairs[["n0", "n1"]].to_numpy()[known].reshape(-1, 2), all_counts, discount,
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = copy(shared.value)
        for batch, t in text_chunks(batches):
            x = []
            for limits in CUTS:
                of.cut(*limits)
                x.append(of.evidence(t))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(np.stack(x, axis=1).tolist(), pa.list_(pa.float64()))], names=["label", "x"])

    held = in_arrow(texts.where("curve").select("text", "label"), measure, "label int, x array<double>").toPandas()
    x, y = np.array(held["x"].tolist(), float).reshape(-1, len(CUTS)), held["label"].to_numpy(float)
    curves = [logistic(x[:, k], y, prior) for k in range(len(CUTS))]
    losses = [log_loss(x[:, k], y, prior, *curve) for k, curve in enumerate(curves)]
    best = int(np.argmin(losses))
    model.cut(*CUTS[best])
    model.slope, model.offset = curves[best]
    return model


def _class_weights(y: np.ndarray, prior: float) -> np.ndarray:
    return np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum()))


def log_loss(x: np.ndarray, y: np.ndarray, prior: float, slope: float, offset: float) -> float:
    """Of the curve on labelled evidence; classes weigh as ``prior`` says."""
    g = slope * x + offset
    return float((_class_weights(y, prior) * np.logaddexp(0, np.where(y == 1, -g, g))).sum())


def logistic(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset on the log-odds scale; classes weigh as ``prior`` says."""
    if not len(x) or y.min() == y.max():
        return 1.0, float(np.log(max(min(prior, 0.49), 1e-6) / (1 - min(prior, 0.49))))
    prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
    scale = max(float(x.std()), 1e-9)
    a = np.stack((x / scale, np.ones_like(x)), axis=1)
    weight = _class_weights(y, prior) * len(y)
    theta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -50, 50)))
        gradient = a.T @ (weight * (p - y)) + np.array([1e-2, 0]) * theta
        hessian = (a * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a + np.diag([1e-2, 1e-9])
        step = np.linalg.solve(hessian, gradient)
        theta -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0] / scale), float(theta[1])


def scored(docs: DataFrame, labels: DataFrame, usable: F.Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` with ``t_score``. ``usable``: which label rows may be learnt from."""
    docs = docs.drop("t_score")
    of = labels.where(usable)
    toxic, all_ = of.agg(F.count_if(F.col(label_col) == 1), F.count_if(F.col(label_col).isin(0, 1))).first()
    prior = toxic / max(1, all_)
    names, schema = docs.columns, T.StructType([*docs.schema.fields, T.StructField("t_score", T.DoubleType())])
    if 0 < toxic < all_:
        shared = docs.sparkSession.sparkContext.broadcast(fit(docs, sample(labels, label_col, usable, per_class, id_col), prior, id_col, text_col))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, texts in text_chunks(batches, text_col):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(texts))], names=[*names, "t_score"])

        return in_arrow(docs, run, schema)
    return docs.withColumn("t_score", F.lit(min(prior, 0.49)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every document's toxicity; fold 0 of 5 is held out."""
    of = fold(F.col("doc_id"), 5)
    d = scored(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"), of != 0)
    return d.select("doc_id", (of == 0).alias("held_out"), F.col("t_score").alias("score"), (F.col("t_score") >= 0.5).cast("int").alias("predicted"))
