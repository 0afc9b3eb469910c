"""Cells of chunks against all pairs, and what leaves them."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfspark.functions import expressions as X
from shelfspark.operators import chunks, personal, signatures
from shelfspark.operators import profile as P
from shelfspark.sources.catalogue import catalogue as opened
from tests.oracle import SMALL
from tests.test_overlap import brute


@pytest.mark.parametrize("seed, least, k, pairs, same", [(1, 2, 3, 1, True), (2, 1, None, 50, True), (3, 3, 100, 4_000_000, False)])
def test_overlaps_of_chunks(spark, monkeypatch, seed, least, k, pairs, same):
    """Ids that are dense, far apart and negative; a chunk's pairs in many blocks or in one; texts as ids."""
    monkeypatch.setattr(chunks, "LEAST_BITS", 2)
    monkeypatch.setattr(chunks, "PAIRS", pairs)
    rng = random.Random(seed)
    ids = [*range(9), -5, -1, 10**12, 2**40]
    left = sorted({(rng.choice(ids), rng.randrange(12)) for _ in range(90)})
    right = sorted({(rng.choice(ids), rng.randrange(14)) for _ in range(90)})
    want = brute(left, right, least, 10**6 if k is None else k, same)
    got = chunks.overlaps(spark.createDataFrame(left, "source_id long, member long"), spark.createDataFrame(right, "target_id long, member long"), least, k, same)
    assert sorted(map(tuple, got.collect())) == want
    text = chunks.overlaps(spark.createDataFrame([(str(s), str(m)) for s, m in left], "source_id string, member string"), spark.createDataFrame([(t, str(m)) for t, m in right], "target_id long, member string"), least, k, False)
    assert sorted(map(tuple, text.collect())) == sorted((str(s), t, n) for s, t, n in brute(left, right, least, 10**6 if k is None else k, False))


def test_members_are_sent_to_a_chunk_once(spark):
    """p07_for_you, p17_home: 1,000 neighbours who read the same 20 books. 20 lists are met; 20,000,000 pairs were shuffled before."""
    shelf = spark.range(1000).withColumn("member", F.explode(F.sequence(F.lit(1), F.lit(20))))
    met = []
    cell = chunks._overlap_cell(2, 3, True)
    left, right = shelf.withColumnRenamed("id", "source_id"), shelf.withColumnRenamed("id", "target_id")
    plan = chunks.overlaps(left, right, 2, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "count(1)" not in plan
    got = chunks.overlaps(left, right, 2, 3).collect()
    assert len(got) == 3000 and {r["score"] for r in got} == {20} and sorted(r["target_id"] for r in got if r["source_id"] == 1) == [0, 2, 3]
    lists = pa.table({"member": pa.array(range(1, 21)), "targets": [list(range(1000))] * 20})
    sources = pa.table({"source_id": pa.array(np.repeat(np.arange(1000), 20)), "member": pa.array(list(range(1, 21)) * 1000)})
    met.append(len(cell(sources, lists)))
    assert met == [3000]


def test_rounding_is_sparks(spark):
    rng = random.Random(3)
    values = [rng.random() for _ in range(5000)] + [i / 2_000_000 for i in range(1, 4000, 2)] + [0.0, 0.1234565, 0.1234564999999, 1.0000005]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 6)).collect()
    assert [round(r[0] * 1e6) for r in got] == chunks.six(np.array(values)).tolist()


@pytest.mark.parametrize("piles, pairs", [(8192, 4_000_000), (3, 10)])
def test_for_you_of_cells(spark, monkeypatch, piles, pairs):
    """Against every book of every user: small and large cells, blocks of one user, several piles."""
    monkeypatch.setattr(chunks, "LEAST_BITS", 3)
    monkeypatch.setattr(chunks, "PAIRS", pairs)
    monkeypatch.setattr(signatures, "SIGNATURES", piles)
    cat = opened(spark, SMALL)
    shown = personal._shown(cat, F.coalesce("avg_rating", F.lit(0.0)).alias("average")).join(cat.book_genres, "book_id")
    liked = P.genre_weights(cat).join(shown, "genre_id").groupBy("user_id", "book_id", "average").agg((F.sum("raw") / F.max("total")).alias("genre_score"))
    readers = personal.collaborative(cat)
    most = readers.groupBy("user_id").agg(F.max("readers").alias("most"))
    both = liked.join(P.excluded(cat), ["user_id", "book_id"], "left_anti").join(readers, ["user_id", "book_id"], "left").join(most, "user_id", "left")
    score = X.six(F.col("genre_score") * 0.6 + F.coalesce(F.col("readers") / F.col("most"), F.lit(0.0)) * 0.25 + F.col("average") / 5.0 * 0.15)
    want = personal.ranked(both.withColumn("score", score), 20, F.desc("score"))
    assert sorted(map(tuple, personal.for_you(cat).collect())) == sorted(map(tuple, want.collect()))
    like = readers.where("readers >= 2").join(personal._shown(cat, "avg_rating"), "book_id").withColumn("score", F.col("readers"))
    want = personal.ranked(like, 20, F.desc("score"), F.desc_nulls_last("avg_rating"))
    assert sorted(map(tuple, personal.readers_like_you(cat).collect())) == sorted(map(tuple, want.collect()))


def test_only_the_best_leave_the_cells_of_for_you(spark, monkeypatch):
    """What is ranked at last has 2 * k rows a user at most; all books of similar users and of genre sets before."""
    cat = opened(spark, SMALL)
    met = []
    ranked = personal.ranked
    monkeypatch.setattr(personal, "ranked", lambda scored, k, *order: (met.append(scored.groupBy("user_id").count().agg(F.max("count")).first()[0]), ranked(scored, k, *order))[1])
    personal.for_you(cat, 5)
    personal.readers_like_you(cat, 5)
    assert max(met) <= 10


def test_authors_of_one_set_of_genres_are_compared_once(spark, monkeypatch):
    """c05_authors_by_genre: against all pairs, for sources that are among the candidates and that aren't; targets in slices.
    What is compared are sets of genres; each author met every other one before."""
    from shelfspark.operators import similar
    from tests.test_operators import book, catalogue

    met, top = [], signatures.top_shared
    monkeypatch.setattr(signatures, "top_shared", lambda *a, **k: met.append((out := top(*a, **k)).count()) or out)
    monkeypatch.setattr(similar, "CANDIDATES", 6)
    n, kinds = 60, ["abc", "abd", "ae", "bcde"]
    books = [book(i, ol_rating_count=600 if i % 5 else 1, language="de" if i % 7 == 0 else "en") for i in range(1, n + 1)]
    genres = {i: sorted(kinds[i % 4]) for i in range(1, n + 1)}
    cat = catalogue(spark, books, [])
    cat.book_authors = spark.createDataFrame([(i, 1 + i // 2) for i in genres], "book_id long, author_id long")
    cat.book_genres = spark.createDataFrame([(i, g) for i, gs in genres.items() for g in gs], "book_id long, genre_id string")
    every, english, count = {}, {}, {}
    for b in books:
        author = 1 + b["book_id"] // 2
        every.setdefault(author, set()).update(genres[b["book_id"]])
        if b["language"] == "en":
            english.setdefault(author, set()).update(genres[b["book_id"]])
            count[author] = count.get(author, 0) + 1
    want = []
    for (source,) in similar.eligible_authors(cat).collect():
        near = sorted((-len(every[source] & english[t]), t) for t in english if t != source and len(every[source] & english[t]) >= 2)[:6]
        best = sorted(((s / (len(every[source]) + len(every[t]) + s), -count[t], t) for s, t in near))[:3]
        want += [(source, rank, t, round(-score, 6)) for rank, (score, _, t) in enumerate(best, 1)]
    assert sorted(map(tuple, similar.authors_by_genre(cat, 3).collect())) == sorted(want) != []
    assert met[0] <= 7 * len({frozenset(g) for g in every.values()}) < 60  # some 30 * 6 before


def test_shared_genres_in_slices(spark, monkeypatch):
    """Many targets with ties: slices, thresholds and groups of genres don't change what a cell passes on."""
    rng = np.random.default_rng(4)
    sets = lambda n, key: pa.table({key: rng.permutation(n), "genres": [[f"g{g}" for g in rng.permutation(30)[: rng.integers(0, 20)]] for _ in range(n)]})
    left, right = sets(40, "source_id"), sets(700, "target_id")
    whole = signatures._shared_cell(2, 11, True)(left, right).to_pylist()
    of = dict(zip(right.column("target_id").to_pylist(), map(set, right.column("genres").to_pylist())))
    want = []
    for s, genres in zip(left.column("source_id").to_pylist(), left.column("genres").to_pylist()):
        want += [{"source_id": s, "target_id": t, "shared": -n} for n, t in sorted((-len(of[t] & set(genres)), t) for t in of if t != s and len(of[t] & set(genres)) >= 2)[:11]]
    key = lambda r: tuple(r.values())
    assert sorted(whole, key=key) == sorted(want, key=key)
    monkeypatch.setattr(signatures, "SLICE", 64)
    monkeypatch.setattr(signatures, "SCORED_USERS", 7)
    assert sorted(signatures._shared_cell(2, 11, True)(left, right).to_pylist(), key=key) == sorted(want, key=key)


def test_sections_of_home_by_lists_and_in_tasks_by_rows(spark, monkeypatch):
    """p17_home: books of favourite authors against all pairs; what few bytes hold isn't one task's; who has read what is
    gathered once."""
    from shelfspark.operators import common

    cat = opened(spark, SMALL)
    theirs = P.authors_read(cat).join(cat.book_authors, "author_id").select("user_id", "book_id").distinct()
    left = theirs.join(P.excluded(cat), ["user_id", "book_id"], "left_anti").join(personal._shown(cat, F.col("avg_rating").alias("score")), "book_id")
    want = personal.ranked(left, 20, F.desc_nulls_last("score"))
    found = personal.from_favorite_authors(cat)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) != []
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    assert personal._gone(cat) is personal._gone(cat)
    monkeypatch.setattr(common, "TASK_ROWS", 10)
    assert common.spread(spark.range(20), 30, "id").rdd.getNumPartitions() == 3  # 4, and then 1, before
