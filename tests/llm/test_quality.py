import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import quality
from shelfspark.llm.queries import op7_quality
from shelfspark.llm.text_features import NAMES, surface

MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    return op7_quality(spark, MEDIUM).toPandas()


def test_held_out_accuracy(spark, scored):
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").toPandas()
    both = scored.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert len(scored) == 1000 and (held.predicted == held.quality).mean() > 0.93
    assert (scored.held_out == scored.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    assert scored.score.between(0, 1).all() and ((scored.score >= 0.5) == (scored.predicted == 1)).all()


def test_held_out_labels_are_not_learnt(spark, scored):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality.remainder(F.col("doc_id"), 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.score_documents(docs, flipped).toPandas().sort_values("doc_id").score.to_numpy()
    assert np.allclose(again, scored.sort_values("doc_id").score.to_numpy())


def test_the_risk_on_negatives_stays_above_zero():
    """Positives and negatives apart on one axis: the unlabelled half that looks like no positive is told apart."""
    rng = np.random.default_rng(0)
    good, bad = rng.normal(2, 1, (500, 2)), rng.normal(-2, 1, (500, 2))
    model = quality.fit(good[:250], np.concatenate([good[250:], bad]), 1 / 3)
    assert (model.scores(good) >= 0.5).mean() > 0.95 and (model.scores(bad) >= 0.5).mean() < 0.05


def risk(w, positive, unlabelled, prior, decay):
    """The stated risk with its penalty; the last column of the inputs is the constant one."""
    loss = lambda z: np.logaddexp(0, -z)
    negative = loss(-(unlabelled @ w)).mean() - prior * loss(-(positive @ w)).mean()
    return prior * loss(positive @ w).mean() + max(0.0, negative) + decay / 2 * (w[:-1] ** 2).sum()


def test_fit_against_a_slow_minimisation():
    """Steepest descent with numeric derivatives on the stated risk doesn't get below what fit() reaches."""
    rng = np.random.default_rng(2)
    good, bad = rng.normal(0.7, 1, (300, 3)), rng.normal(-0.7, 1, (300, 3))
    positive, unlabelled = good[:150], np.concatenate([good[150:], bad])
    model = quality.fit(positive, unlabelled, 1 / 3, steps=4000, decay=0.05)
    scaled = lambda x: np.hstack([np.clip((x - model.mean) / model.scale, -8, 8), np.ones((len(x), 1))])
    p, u, w, step = scaled(positive), scaled(unlabelled), np.zeros(4), 0.5
    for _ in range(3000):
        grad = np.array([(risk(w + d, p, u, 1 / 3, 0.05) - risk(w - d, p, u, 1 / 3, 0.05)) / 2e-5 for d in np.eye(4) * 1e-5])
        while step > 1e-9 and risk(w - step * grad, p, u, 1 / 3, 0.05) >= risk(w, p, u, 1 / 3, 0.05):
            step /= 2
        w = w - step * grad
        step = min(step * 1.5, 1.0)
    reached = risk(np.append(model.weights, model.bias), p, u, 1 / 3, 0.05)
    assert reached <= risk(w, p, u, 1 / 3, 0.05) + 2e-3
    assert np.abs(model.scores(unlabelled) - 1 / (1 + np.exp(-(u @ w)))).max() < 0.05


def test_scores_against_a_plain_computation():
    rng = np.random.default_rng(4)
    model = quality.Model(rng.normal(size=len(NAMES)), rng.uniform(0.5, 2, len(NAMES)), rng.normal(size=len(NAMES)), 0.3)
    for text in (b"", b"Plain words here.", b"BUY NOW!!! BUY NOW!!! | # $"):
        total = 0.3
        for x, mean, scale, weight in zip(surface(text), model.mean, model.scale, model.weights):
            total += min(max((x - mean) / scale, -8), 8) * weight
        assert model.scores(np.array([surface(text)]))[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_prior_without_negatives():
    rng = np.random.default_rng(6)
    for share in (0.4, 0.7, 0.9):
        good, bad = rng.normal(2, 1, (4000, 2)), rng.normal(-2, 1, (int(4000 * (1 - share)), 2))
        unlabelled = np.concatenate([good[2000 : 2000 + int(2000 * share)], bad[: 2000 - int(2000 * share)]])
        assert quality.estimated_prior(good[:2000], unlabelled) == pytest.approx(share, abs=0.08)
    assert quality.tail_ratio(np.array([0.9, 0.8]), np.array([0.1, 0.95, 0.2, 0.3])) == 0.25


def test_labels_without_negatives(spark):
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    again = quality.score_documents(docs, labels.where("quality = 1")).toPandas().merge(labels.toPandas(), on="doc_id")
    held = again[again.held_out]
    assert (held.predicted == held.quality).mean() > 0.9


def test_features_are_finite_for_any_bytes():
    for text in (b"", b" ", b"\xff\x00", b"A" * 100_000, b"!!! ||| ###", "東京".encode()):
        values = surface(text)
        assert len(values) == len(NAMES) and np.isfinite(values).all()


def test_edges(spark, edge_docs, no_docs, no_labels):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 1), (9, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score_documents(edge_docs, labels).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in quality.score_documents(edge_docs, no_labels).collect()} == {0.5}
    kept = quality.keep_good(edge_docs, no_labels)
    assert kept.columns == edge_docs.columns and kept.count() == 12
    assert quality.score_documents(no_docs, labels).count() == 0 and quality.keep_good(no_docs, labels).count() == 0
