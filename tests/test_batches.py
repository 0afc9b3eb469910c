"""Operators over batches, merges and games against plain versions."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import expressions as X
from shelfspark.operators import batch, merge, sampling, search, signatures, similar
from shelfspark.plans import queries
from shelfspark.sources.catalogue import Catalogue
from shelfspark.streaming import counters
from tests.oracle import SMALL


def test_packs_are_those_of_the_plain_version(spark):
    cat = Catalogue(spark, SMALL)
    pool = sampling.collected_pools(sampling.pools(cat, 42))
    got = {}
    for r in sampling.packs(cat, 42).collect():
        got.setdefault(r["user_id"], []).append((r["place"], r["tier"], r["book_id"]))
    users = [r["user_id"] for r in cat.users.collect()]
    assert sorted(got) == sorted(users) and len(users) > 100
    for user in users:
        assert [(t, b) for _, t, b in sorted(got[user])] == sampling.open_pack(pool, f"42:{user}")


def test_no_packs_without_enough_books(spark):
    cat = Catalogue(spark, SMALL)
    few = SimpleNamespace(books=cat.books.where("book_id < 6"), users=cat.users, spark=spark)
    assert sampling.packs(few, 42).count() == 0


@pytest.mark.parametrize("text, slug", [("José Ñandú", "jose-nandu"), ("Straße Œuvre", "strasse-oeuvre"), ("Война и мир", "voina-i-mir"), ("Ά Οδύσσεια", "a-odusseia"), ("  The -- Book! ", "the-book"), ("Ё Й", "io-i"), ("İstanbul", "istanbul")])
def test_slugs_of_other_scripts(spark, text, slug):
    assert spark.range(1).select(X.slug_ascii(F.lit(text))).first()[0] == slug


def test_slugs_of_scripts_without_letters_are_hashes(spark):
    found = spark.createDataFrame([("東京",), ("",), (None,)], "t string").select(X.slug_ascii(F.col("t"))).collect()
    assert len(found[0][0]) == 16 and found[1][0] == found[2][0] == ""


def test_query_and_documents_have_one_analysis(spark):
    for text in ("àéî snake_case", "Żółć 12.5 don't", "ÇA VA"):
        assert search.query_terms(text) == spark.range(1).select(search.terms(F.lit(text))).first()[0]
    docs = spark.createDataFrame([(1, "aei snake"), (2, "other")], "id int, text string")
    assert [r["doc"] for r in search.bm25(docs, "id", "text", "àéî").collect()] == [1]


def test_last_change_is_settled_by_values(spark):
    rows = [(1, "b", 5), (1, "c", 5), (1, "a", 4), (2, None, None), (2, "x", None)]
    for order in (rows, rows[::-1]):
        got = merge.last_by(spark.createDataFrame(order, "id int, status string, at int"), ["id"], "at")
        assert sorted((r["id"], r["status"]) for r in got.collect()) == [(1, "c"), (2, "x")]


def test_a_writer_that_ended_between_two_moves(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    merge.replace(spark.range(3).toDF("id"), path)
    (tmp_path / "t").rename(tmp_path / "t.old-abc")
    assert merge.recovered(spark, path) and spark.read.parquet(path).count() == 3
    assert not merge.recovered(spark, f"file://{tmp_path}/none")
    sink = counters.fold_counts(path)
    (tmp_path / "t").rename(tmp_path / "t.old-abc")
    spark.range(3).toDF("entity_id").write.mode("overwrite").parquet(f"file://{tmp_path}/t.old-abc")
    sink(spark.createDataFrame([(1,), (9,)], "entity_id long"), 0)
    assert sorted(r[0] for r in spark.read.parquet(path).collect()) == [0, 1, 2, 9]


def test_ranked_prefixes(spark):
    ranked = spark.range(200).select(F.lit("k").alias("key"), F.col("id").alias("item"), (F.col("id") + 1).cast("int").alias("nth")).unionByName(spark.createDataFrame([("other", 7, 1)], "key string, item long, nth int"))
    asked = spark.createDataFrame([(1, "k", 0), (2, "k", 1), (3, "k", 16), (4, "k", 17), (5, "other", 40), (6, "none", 3), (7, "k", 500)], "user int, key string, need int")
    got = {r["user"]: r["n"] for r in signatures.first_of(asked, ranked, "key").groupBy("user").agg(F.count("*").alias("n")).collect()}
    assert got == {2: 1, 3: 16, 4: 17, 5: 1, 7: 200}


@pytest.mark.parametrize("users, piles", [(1, 1), (7, 3)])
def test_best_signatures_hold_the_best_books(spark, monkeypatch, users, piles):
    """Against all books of all signatures, with ties, for cells of any size."""
    import random

    rng = random.Random(1)
    monkeypatch.setattr(signatures, "USERS", 5)
    names = ["|".join(sorted(rng.sample("abcdefgh", rng.randint(1, 3)))) for _ in range(60)]
    names = sorted(set(names))
    books = {n: sorted(((rng.randint(0, 8) / 2, 100 * i + j) for j in range(rng.randint(1, 9))), key=lambda b: (-b[0], b[1])) for i, n in enumerate(names)}
    people = [(u, [(g, rng.randint(1, 6) / 2) for g in rng.sample("abcdefgh", 4)], rng.choice([1, 5, 30, 1000])) for u in range(users)]
    left = spark.createDataFrame([(u, [dict(genre_id=g, raw=r) for g, r in t], sum(r for _, r in t), need) for u, t, need in people], "user_id long, tastes array<struct<genre_id:string,raw:double>>, total double, need int")
    right = spark.createDataFrame([(n, b[0][0], b[0][1], len(b)) for n, b in books.items()], "signature string, best double, first long, n int")
    found = {}
    for r in signatures.best_signatures(left, right, users, signatures.SIGNATURES * piles, 0.6, 0.15).collect():
        found.setdefault(r["user_id"], []).append(r)
    for u, tastes, need in people:
        raw = dict(tastes)
        score = lambda n: sum(raw.get(g, 0) for g in n.split("|")) / sum(raw.values())
        every = sorted((-round(score(n) * 0.6 + a / 5 * 0.15, 6), i) for n, bs in books.items() if score(n) > 0 for a, i in bs)
        seen = sorted((-round(r["genre_score"] * 0.6 + a / 5 * 0.15, 6), i) for r in found.get(u, []) for a, i in books[r["signature"]][: r["need"]] if round(r["genre_score"] * 0.6 + a / 5 * 0.15, 6) >= r["floor"])
        assert seen[:need] == every[:need]


def test_cleaning_leaves_out_records_without_a_title(spark):
    schema = "seq long, title string, language string, description string, first_sentence string, original_publication_year int, primary_cover_url string, open_library_id string, google_books_id string, series struct<name:string,position:double>, formats array<string>, isbn array<string>, publisher string, number_of_pages int, external_ids map<string,string>, authors array<struct<name:string>>, genres array<struct<name:string>>"
    rows = [(1, None, *[None] * 15), (2, "", *[None] * 15), (3, "x" * 600, "EN", *[None] * 10, -1, None, None, None)]
    got = batch.clean_books(spark.createDataFrame(rows, schema)).collect()
    assert [(r["seq"], len(r["title"]), r["language"], r["number_of_pages"], r["isbn"], r["external_ids"]) for r in got] == [(3, 500, "en", None, [], {})]


def test_similar_by_genre_when_the_source_is_or_is_not_among_candidates(spark, monkeypatch):
    """With few candidates, sources beyond them see the first ones, sources among them one more."""
    monkeypatch.setattr(similar, "CANDIDATES", 3)
    cat = Catalogue(spark, SMALL)
    got = {}
    for r in similar.similar_by_genre(cat, 2).collect():
        got.setdefault(r["source_id"], []).append((r["rank"], r["target_id"], r["score"]))
    genres = {}
    for r in cat.book_genres.collect():
        genres.setdefault(r["book_id"], set()).add(r["genre_id"])
    rows = {r["book_id"]: r for r in cat.books.withColumn("n", X.total_ratings()).withColumn("shown", X.listable()).collect()}
    targets = [b for b, r in rows.items() if r["language"] == "en" and r["n"] >= 50]
    for source in [b for b, r in rows.items() if r["shown"] and r["n"] >= 500]:
        near = sorted((-len(genres[source] & genres[t]), t) for t in targets if t != source and len(genres[source] & genres[t]) >= 2)[:3]
        want = sorted(((-k) / len(genres[source] | genres[t]), rows[t]["rating_count"] or 0, t) for k, t in near if rows[t]["shown"])
        want = sorted(want, key=lambda x: (-x[0], -x[1], x[2]))[:2]
        assert [(t, s) for _, t, s in sorted(got.get(source, []))] == [(t, round(s, 6)) for s, _, t in want], source


def test_new_queries_have_rows(spark):
    for name in ("k05_edit_comments", "c13_read_sections", "c14_cold_sections", "d02b_irrelevant_authors", "g09_tiers_in_range", "u12_resolved_names"):
        assert queries.QUERIES[name](spark, SMALL).limit(1).count() == 1, name
