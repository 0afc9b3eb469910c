"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; all else that the classifier learns from is unlabelled text of the
corpus. With the class prior p, the risk p * E_P[l(f)] + max(0, E_U[l(-f)] - p * E_P[l(-f)]) is minimised: the second
part estimates the risk on negatives, and is kept from going below zero, which a flexible model would drive it to. f is
linear in surface features of the whole text; l is the logistic loss. The prior is the share of good rows among the
labelled ones of the training part; where these hold no other rows, it is estimated from positives and unlabelled texts
alone. Labels, language, source and id are no inputs of the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, sampled_rows
from .text_features import NAMES, surface

#: Rows of each kind that the classifier is fitted on, about: those whose hash is in the share that gives as many. Their
#: features, 28 numbers each and no texts, go to the driver.
FIT_ROWS = 10_000


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, features: np.ndarray) -> np.ndarray:
        f = np.clip((features - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(f, -50, 50)))


def remainder(doc_id: Column, modulus: int) -> Column:
    """CRC-32 of the id as text, modulo; null ids have the remainder of the empty text, 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Minimises the non-negative risk by full-batch Adam. Where the estimated risk on negatives is below zero, the step
    goes against it, as the estimator's authors do."""
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    p, u = (np.hstack([x, np.ones((len(x), 1))]) for x in (p, u))
    w, m, v = np.zeros(p.shape[1]), np.zeros(p.shape[1]), np.zeros(p.shape[1])
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -50, 50)))
    for step in range(1, steps + 1):
        fp, fu = p @ w, u @ w
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        on_negative = u.T @ sigmoid(fu) / len(u) - prior * (p.T @ sigmoid(fp)) / len(p)
        grad = -on_negative if negative < 0 else -prior * (p.T @ sigmoid(-fp)) / len(p) + on_negative
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w[:-1], float(w[-1]))


def tail_ratio(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.5) -> float:
    """An upper bound of the class prior from scores: a tail that holds the share a of the positives and b of the
    unlabelled texts has p * a <= b; the least b / a over tails with `least` of the positives or more."""
    positive, unlabelled = np.sort(positive), np.sort(unlabelled)
    at = np.unique(positive[: max(1, int((1 - least) * len(positive)))])
    a = 1 - np.searchsorted(positive, at) / len(positive)
    b = 1 - np.searchsorted(unlabelled, at) / len(unlabelled)
    return float(np.min(b / a))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, rounds: int = 2, start: float = 0.95) -> float:
    """The class prior without labelled negatives: a model fitted with too high a prior separates what it can, and the
    tail ratio of its scores is the next, lower estimate."""
    prior = start
    for _ in range(rounds):
        model = fit(positive, unlabelled, prior)
        prior = min(max(tail_ratio(model.scores(positive), model.scores(unlabelled)), 0.05), prior)
    return prior


def feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, a text in UTF-8 or null, by its features."""
    for batch in batches:
        rows = [surface(t.as_py() or b"") for t in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], names=[*batch.schema.names[:-1], "features"])


def features_of(rows: DataFrame) -> np.ndarray:
    found = rows.select(F.col("text").cast("binary").alias("body")).mapInArrow(feature_batches, "features array<double>").collect()
    return np.array([r["features"] for r in found]).reshape(-1, len(NAMES))


def train(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Model | None:
    """Fits on docs (doc_id, text) and labels (doc_id, quality), both of the training part alone. None without a
    positive or an unlabelled row."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    good, total = known.agg(F.coalesce(F.sum((F.col("quality") == 1).cast("int")), F.lit(0)), F.count("*")).first()
    texts = docs.select("doc_id", "text")
    rows = texts.count()
    if not good or not rows:
        return None
    trusted = known.where("quality = 1").select("doc_id")
    positive = features_of(sampled_rows(texts, limit / good).join(trusted, "doc_id", "left_semi"))
    unlabelled = features_of(sampled_rows(texts, limit / rows))
    if not len(positive) or not len(unlabelled):
        return None
    prior = min(max(good / total, 0.05), 0.98) if good < total else estimated_prior(positive, unlabelled)
    return fit(positive, unlabelled, prior)


def score_column(docs: DataFrame, model: Model | None, name: str) -> DataFrame:
    """Adds a score of the given name to the rows of docs; every other column is passed on. Null and empty texts are scored as empty ones;
    without a model all scores are 0.5."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features = np.array([surface(t.as_py() or b"") for t in batch.column(batch.num_columns - 1)]).reshape(-1, len(NAMES))
            scores = model.scores(features) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores)], names=[*names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.withColumn(fresh(docs, "__body"), F.col("text").cast("binary")).mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, limit: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs (doc_id, text, ...).

    Labels are learnt from rows whose remainder isn't `held` alone. Null texts are scored as empty ones, long texts whole;
    without good labels all scores are 0.5; repeated rows are scored alike; null ids belong to remainder 0; an empty table
    gives no rows; other columns are not looked at.
    """
    own = lambda df: df.where(remainder(F.col("doc_id"), modulus) != held)
    model = train(own(docs), own(labels), limit)
    scored = score_column(docs.select("doc_id", "text"), model, "score")
    return scored.select("doc_id", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, modulus: int = 3, held: int = 1, limit: int = FIT_ROWS) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that the classifier doesn't reject, all columns as they are. Null texts are
    judged as empty ones, long texts whole, repeated rows alike; without good labels every row stays; an empty table stays
    empty; columns of any name are passed on."""
    own = lambda df: df.where(remainder(F.col("doc_id"), modulus) != held)
    model = train(own(docs), own(labels), limit)
    score = fresh(docs, "__score")
    return score_column(docs, model, score).where(F.col(score) >= 0.5).drop(score)
