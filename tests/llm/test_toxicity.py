import zlib

import numpy as np
import pytest

from shelfspark.llm import toxicity

LARGE = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    from shelfspark.llm.queries import op10_toxicity

    scored = op10_toxicity(spark, LARGE).toPandas()
    labels = spark.read.parquet(f"{LARGE}/labels.parquet").toPandas()
    held = scored.merge(labels, on="doc_id").query("held_out")
    assert len(scored) == 10_000 and (held.predicted == held.toxic).mean() > 0.96
    assert held[held.toxic == 1].predicted.mean() > 0.9 and held[held.toxic == 0].predicted.mean() < 0.02
    assert (scored.held_out == scored.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()


def test_held_out_labels_are_not_learnt(spark):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(toxicity.remainder(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda known: toxicity.score_documents(docs, known).toPandas().sort_values("doc_id").score.to_numpy()
    assert np.allclose(score(labels), score(flipped))


def test_all_held_out_abuse_that_words_can_show_is_found(spark):
    """Labels of this data are wrong for some texts without any abuse; of those with a word that only toxic texts of the
    training part hold (20 of them or more), nine in ten are found."""
    import re

    from shelfspark.llm.queries import op10_toxicity

    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "toxic").toPandas()
    words = [set(re.findall(r"[a-zà-ÿ]+", (t or "").lower())) for t in rows.text]
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id])
    hits = {0: {}, 1: {}}
    for w, y, h in zip(words, rows.toxic, held):
        for x in w if not h else ():
            hits[y][x] = hits[y].get(x, 0) + 1
    abuse = {w for w, n in hits[1].items() if n >= 20 and not hits[0].get(w)}
    shown = rows[held & (rows.toxic == 1) & np.array([bool(w & abuse) for w in words])]
    predicted = op10_toxicity(spark, LARGE).toPandas().set_index("doc_id").predicted
    assert len(shown) > 40 and predicted[shown.doc_id].mean() >= 0.9


def slow_objective(w, bias, own, swapped, toxic, l1, fairness, scale):
    """The stated objective, text by text."""
    total = 0.0
    for x, y in zip(own, toxic):
        z = bias + sum(w[i] for i in x)
        total += np.logaddexp(0, -z) if y else np.logaddexp(0, z)
    pairs = [(a, b) for a, b in zip(own, swapped) if b is not None]
    change = sum((sum(w[i] for i in a) - sum(w[i] for i in b)) ** 2 for a, b in pairs)
    return total / len(own) + l1 * sum(abs(v / s) for v, s in zip(w, scale) if s) + fairness * change / max(1, len(pairs))


def test_fit_against_a_slow_minimisation():
    """Coordinate search on the stated objective finds nothing better than fit() does."""
    rng = np.random.default_rng(3)
    width, own, toxic = 6, [], []
    for i in range(150):
        y = i % 3 == 0
        own.append(sorted({j for j in range(width) if rng.random() < (0.5 if j < 2 and y else 0.25)}))
        toxic.append(int(y))
    swapped = [sorted(set(x) ^ {2, 3}) if 2 in x or 3 in x else None for x in own]
    l1, fairness, y, n = 1e-3, 2.0, np.array(toxic), len(own)
    weights, bias = toxicity.fit(own, swapped, y, width, l1=l1, fairness=fairness, steps=4000)
    count = lambda rows: np.array([sum(j in x for x in rows) for j in range(width)], float)
    odds = lambda hits, total: np.log((hits + 0.5) / (total + 1))
    scale = odds(count([x for x, t in zip(own, toxic) if t]), y.sum()) - odds(count([x for x, t in zip(own, toxic) if not t]), n - y.sum())
    value = lambda w, b: slow_objective(w, b, own, swapped, toxic, l1, fairness, scale)
    reached, w, b, step = value(weights, bias), np.array(weights), bias, 0.5
    while step > 1e-3:
        better = False
        for j in range(width + 1):
            for d in (step, -step):
                v, c = w.copy(), b + (d if j == width else 0)
                if j < width:
                    v[j] += d
                if value(v, c) < value(w, b) - 1e-12:
                    w, b, better = v, c, True
        step = step if better else step / 2
    assert reached <= value(w, b) + 1e-4


def test_swaps_stay_within_a_kind():
    assert toxicity.swaps({b"women", b"x"}) == {b"women": b"men"}
    assert toxicity.swaps({b"women", b"men"}) == {b"women": b"girls", b"men": b"girls"}
    assert toxicity.swaps({b"word"}) == {}


def test_names_of_groups_lose_their_weight():
    """Abuse in the training texts mostly names one group; neutral mentions of it must not be taken for abuse."""
    rng = np.random.default_rng(0)
    filler = [f"f{c}{d}" for c in "abcdefgh" for d in "abcdefgh"]
    texts, labels = [], []
    for i in range(1200):
        words = list(rng.choice(filler, 12))
        toxic = i % 3 == 0
        if toxic:
            words += ["slur"] * (rng.random() < 0.7) + ["muslims"] * (rng.random() < 0.9)
        elif rng.random() < 0.05:
            words += ["muslims"]
        elif rng.random() < 0.3:
            words += ["christians"]
        texts.append(" ".join(words))
        labels.append(int(toxic))
    both = [toxicity.both_versions(t.encode(), toxicity.IDENTITY_TERMS) for t in texts]
    chosen = sorted({f for fs, other in both for f in fs | (other or set())})
    place = {f: i for i, f in enumerate(chosen)}
    own, swapped = [sorted(place[f] for f in fs) for fs, _ in both], [None if o is None else sorted(place[f] for f in o) for _, o in both]

    def model(fairness):
        weights, bias = toxicity.fit(own, swapped, np.array(labels), len(chosen), fairness=fairness, steps=600)
        return toxicity.Model(dict(zip(chosen, weights.tolist())), bias)

    plain, fair = model(0.0), model(20.0)
    logit = lambda m, name: np.log(m.score(name, {}) / (1 - m.score(name, {})))
    gap = lambda m: abs(logit(m, b"muslims") - logit(m, b"christians"))
    assert gap(fair) < 0.3 * gap(plain)
    assert fair.score(b"fab muslims fac", {}) < plain.score(b"fab muslims fac", {}) and fair.score(b"fab muslims fac", {}) < 0.5
    assert fair.score(b"fab slur fac", {}) > 0.5


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(1, 0, 0), (5, 0, 1), (None, 1, 1), (2, None, None), (7, 1, 1), (9, 1, 0), (8, 1, 0)]])
def test_edges(spark, edge_docs, no_docs, labels):
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = toxicity.score_documents(edge_docs, known).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    if len(labels) < 2:
        assert {r["score"] for r in rows} == {0.0}
    assert toxicity.score_documents(no_docs, known).count() == 0


def test_beginnings_count_by_how_many_words_have_them():
    one, three = toxicity.features({b"abcdx"}), toxicity.features({b"abcdx", b"abcdy", b"abcdz"})
    stem = toxicity.place(b"<abcd")
    assert {stem} == one & {stem, stem + 1, stem + 2, stem + 3} and {stem, stem + 1, stem + 2} == three & {stem, stem + 1, stem + 2, stem + 3}
    model = toxicity.Model({stem + 2: 3.0, toxicity.place(b"=abcdx"): 1.0}, 0.0)
    logit = lambda text: round(float(np.log(1 / (1 / model.score(text, {}) - 1))), 9)
    assert [logit(t) for t in (b"", b"abcdx", b"abcdx abcdx abcdy", b"abcdy abcdz abcdw", b"ABCDX abcdy abcdz")] == [0, 1, 1, 3, 4]
