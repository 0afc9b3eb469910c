"""Overlaps against a count of all pairs, and how many rows the joins meet when something is shared by all."""

import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import overlap


def brute(left, right, least, k, same=True):
    out = []
    for s in {s for s, _ in left}:
        mine = {m for x, m in left if x == s}
        score = {}
        for t, m in right:
            if m in mine and not (same and t == s):
                score[t] = score.get(t, 0) + 1
        out += [(s, t, n) for t, n in sorted(score.items(), key=lambda x: (-x[1], x[0])) if n >= least][:k]
    return sorted(out)


def frames(spark, left, right):
    return spark.createDataFrame(left, "source_id long, member long"), spark.createDataFrame(right, "target_id long, member long")


@pytest.mark.parametrize("seed, least, k, hot, same", [(1, 2, 3, 4, True), (2, 3, 5, 10, True), (3, 1, 2, 0, False), (4, 2, 100, 6, True), (5, 2, 3, 10_000, True), (6, 4, 1, 3, False)])
def test_against_all_pairs(spark, seed, least, k, hot, same):
    rng = random.Random(seed)
    left = sorted({(rng.randrange(25), int(rng.random() ** 2 * 30)) for _ in range(260)} | {(s, 0) for s in range(25)})
    right = sorted({(rng.randrange(40), int(rng.random() ** 2 * 30)) for _ in range(330)} | {(t, m) for t in range(40) for m in (0, 1)})
    got = overlap.top_overlaps(*frames(spark, left, right), least, k, hot=hot, same=same)
    assert sorted(map(tuple, got.collect())) == brute(left, right, least, k, same)


def test_nothing_in_common(spark):
    for left, right in (([], [(1, 1)]), ([(1, 1)], []), ([(1, 1)], [(1, 1)]), ([(1, 1)], [(2, 2)])):
        for hot in (0, 5):
            assert overlap.top_overlaps(*frames(spark, left, right), 1, 3, hot=hot).collect() == []


def test_what_all_share_brings_no_pairs(spark, monkeypatch):
    """600 users who all read one book, and a few others in pairs: 360,000 pairs share the one."""
    users = 600
    shelf = [(u, 0) for u in range(users)] + [(u, 1 + u // 2) for u in range(users)] + [(u, 10_000 + u // 2) for u in range(users)]
    left, right = frames(spark, shelf, shelf)
    met = []
    count = overlap.first
    monkeypatch.setattr(overlap, "first", lambda pairs, k: met.append(pairs.count()) or count(pairs, k))
    cut = overlap.cut
    monkeypatch.setattr(overlap, "cut", lambda df: met.append((out := cut(df)).count()) or out)
    got = overlap.top_overlaps(left, right, 2, 200, hot=100)
    assert sorted(map(tuple, got.collect())) == sorted((u, u ^ 1, 3) for u in range(users))
    assert max(met) <= 4 * users


@pytest.mark.parametrize("users, piles, most", [(1024, 8192, 500), (7, 11, 4), (3, 40, 1)])
def test_top_shared_for_cells_of_any_size(spark, monkeypatch, users, piles, most):
    from shelfspark.operators import signatures

    monkeypatch.setattr(signatures, "USERS", users)
    monkeypatch.setattr(signatures, "SIGNATURES", piles)
    rng = random.Random(9)
    sets = {i: rng.sample("abcdefghij", rng.randint(1, 6)) for i in range(50)}
    left = spark.createDataFrame([(i, g) for i, g in sets.items() if i % 3], "source_id long, genres array<string>")
    right = spark.createDataFrame([(i, g) for i, g in sets.items() if i % 4], "target_id long, genres array<string>")
    want = []
    for s in sets:
        near = sorted((-len(set(sets[s]) & set(sets[t])), t) for t in sets if t % 4 and t != s and len(set(sets[s]) & set(sets[t])) >= 2)
        want += [(s, t, -n) for n, t in near[:most] if s % 3]
    assert sorted(map(tuple, signatures.top_shared(left, right, 2, most).drop("nth").collect())) == sorted(want)
    assert signatures.top_shared(left.limit(0), right, 2, most).count() == signatures.top_shared(left, right.limit(0), 2, most).count() == 0


def test_rankings_are_fetched_as_far_as_they_can_reach(spark):
    from shelfspark.operators import signatures

    ranked = spark.range(100).select(F.lit("k").alias("key"), F.col("id").alias("item"), (100.0 - F.col("id")).alias("value"), (F.col("id") + 1).cast("int").alias("nth"))
    asked = spark.createDataFrame([(1, "k", 50, 99.5), (2, "k", 50, 90.0), (3, "k", 3, 0.0), (4, "k", 50, 101.0), (5, "none", 9, 0.0)], "user int, key string, need int, least double")
    needs = {r["user"]: r["need"] for r in signatures.narrowed(asked, ranked, "key", "value", F.col("least")).collect()}
    assert needs == {1: 4, 2: 12, 3: 3, 4: 0}
