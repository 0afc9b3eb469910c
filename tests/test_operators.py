"""Small fixtures, each for one trap of the operators' semantics."""

from datetime import datetime
from types import SimpleNamespace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfspark.functions import expressions as X
from shelfspark.functions import text as T
from shelfspark.operators import browse, cleanup, ingest, lists, merge, personal, profile, sampling, search, similar, userdata
from shelfspark.sources import dumps
from shelfspark.sources.catalogue import Catalogue
from shelfspark.streaming import counters
from tests.oracle import SMALL

BOOK = (
    "book_id long, title string, slug string, language string, primary_cover_url string, number_of_pages int, original_publication_year int, series_id string, series_position double, isbn string, publisher string, description string, "
    "created_at timestamp, rating_count long, avg_rating double, ol_rating_count long, ol_avg_rating double, ol_want_to_read_count long, ol_currently_reading_count long, ol_already_read_count long, view_count long"
)
NOW = datetime(2026, 1, 1)


def book(i, **other):
    row = dict(
        book_id=i, title=f"book {i}", slug=f"book-{i}", language="en", primary_cover_url="c", number_of_pages=300, original_publication_year=1990, series_id=None, series_position=None, isbn="1", publisher="p", description="d",
        created_at=NOW, rating_count=0, avg_rating=None, ol_rating_count=0, ol_avg_rating=None, ol_want_to_read_count=0, ol_currently_reading_count=0, ol_already_read_count=0, view_count=0,
    )
    return row | other


def catalogue(spark, books=(), shelves=(), authors=(), links=(), genres=(), ratings=(), comments=(), users=()):
    make = spark.createDataFrame
    cat = SimpleNamespace(
        spark=spark,
        books=make(list(books), BOOK),
        bookshelves=make(list(shelves), "user_id long, book_id long, status string, is_favorite boolean, updated_at timestamp"),
        authors=make(list(authors), "author_id long, name string, slug string, photo_url string, view_count long"),
        book_authors=make(list(links), "book_id long, author_id long"),
        book_genres=make(list(genres), "book_id long, genre_id string"),
        ratings=make(list(ratings), "user_id long, book_id long, overall_rating double, " + ", ".join(f"{d} double" for d in X.DIMENSIONS) + ", created_at timestamp"),
        comments=make(list(comments), "comment_id long, user_id long, book_id long, body string, is_spoiler boolean, created_at timestamp"),
        users=make(list(users), "user_id long, username string"),
    )
    for name in ("app_readers", "author_names", "genres"):
        setattr(cat, name, getattr(Catalogue, name).func(cat))
    return cat


def rows(df, *columns):
    return [tuple(r) if len(columns) != 1 else r[0] for r in df.select(*(columns or df.columns)).collect()]


def test_a_book_counts_once_however_many_authors(spark):
    cat = catalogue(
        spark, [book(1), book(2)], [(u, 1, "read", True, NOW) for u in (1, 2)] + [(u, 2, "reading", True, NOW) for u in (1, 2, 3)], [(a, f"a{a}", f"a{a}", None, 0) for a in (1, 2, 3)], [(1, 1), (1, 2), (1, 3)]
    )
    assert rows(lists.user_favorites(cat), "book_id", "score") == [(2, 3.0), (1, 2.0)]
    assert rows(lists.user_favorites(cat, compat=True), "book_id", "score") == [(1, 6.0), (2, 3.0)]
    assert rows(lists.user_favorites(cat), "author_names") == ["", "a1, a2, a3"]


def test_ties_go_to_the_smaller_id_and_nulls_come_last(spark):
    cat = catalogue(spark, [book(i, ol_rating_count=30, ol_avg_rating=v) for i, v in ((5, 4.0), (3, 4.0), (1, None), (4, 4.5))])
    assert rows(lists.community_top_rated(cat), "book_id") == [4, 3, 5, 1]


def test_lists_leave_out_other_languages_and_books_without_covers(spark):
    cat = catalogue(spark, [book(1, language="de"), book(2, primary_cover_url=None), book(3)])
    assert rows(lists.most_rated(cat), "book_id") == [3]


def test_unrated_books_have_a_drawn_in_average(spark):
    df = spark.range(1).select(X.bayesian(F.lit(0), F.lit(0.0)).alias("none"), X.bayesian(F.lit(10), F.lit(5.0)).alias("ten"))
    assert rows(df) == [(3.0, 4.0)]


def test_averages_round_half_up_in_whole_numbers(spark):
    df = spark.range(1).select(X.average_of_halves(F.lit(214), F.lit(40)).alias("a"), X.average_of_halves(F.lit(1), F.lit(1)).alias("b"))
    assert rows(df) == [(2.68, 0.5)]


@pytest.mark.parametrize("rating, n, tier", [(4.66, 25, "legendary"), (4.65, 25, "ultra_rare"), (4.5, 15, "super_rare"), (4.0, 8, "rare"), (3.25, 3, "uncommon"), (2.25, 1, "common"), (4.9, 3, None), (0.0, 0, None)])
def test_tiers_at_their_bounds(spark, rating, n, tier):
    cat = catalogue(spark, [book(1, rating_count=n, avg_rating=rating)])
    assert rows(cat.books.select(sampling.pool_tier().alias("tier"))) == [(tier,)]


def test_genre_keywords_match_inside_words(spark):
    cat = catalogue(spark, genres=[(1, "gloves"), (2, "true-crime")])
    assert set(rows(browse.category_genres(cat), "genre_id", "category")) == {("gloves", "romance"), ("true-crime", "mystery-thriller")}


def test_category_search_takes_wildcards_as_themselves(spark):
    cat = catalogue(spark, [book(1)], genres=[(1, "red")])
    assert rows(search.search_categories(cat, "%")) == []
    assert rows(search.search_categories(cat, "RE"), "book_id") == [1]


def test_abandoned_books_are_excluded_but_their_authors_are_not_read(spark):
    cat = catalogue(spark, [book(1), book(2)], [(7, 1, "abandoned", False, NOW), (7, 2, "read", False, NOW)], links=[(1, 1), (2, 2)])
    assert rows(profile.shelf_profile(cat), "read_ids") == [[1, 2]]
    assert rows(profile.authors_read(cat), "author_id") == [2]


def test_series_over_two_languages_is_in_progress(spark):
    cat = catalogue(spark, [book(1, series_id="s"), book(2, series_id="s", language="de")], [(7, 1, "read", False, NOW)])
    assert rows(profile.series_in_progress(cat)) == [(7, "s", 1, 2)]
    assert rows(personal.continue_series(cat)) == []


def test_genre_weights_add_up_to_one(spark):
    cat = Catalogue(spark, SMALL)
    sums = profile.genre_weights(cat).groupBy("user_id").agg(F.sum("weight").alias("w")).agg(F.min("w"), F.max("w")).first()
    assert sums[0] == pytest.approx(1) and sums[1] == pytest.approx(1)


def test_jaccard_is_symmetric_and_bounded(spark):
    cat = catalogue(spark, [book(i, ol_rating_count=600, ol_avg_rating=4.0) for i in (1, 2, 3)], genres=[(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "c")])
    assert rows(similar.similar_by_genre(cat).orderBy("source_id"), "source_id", "target_id", "score") == [(1, 2, 0.666667), (2, 1, 0.666667)]


def test_book_comments_by_exact_rating_leave_out_the_unrated(spark):
    none = [None] * 8
    cat = catalogue(spark, [book(1)], ratings=[(1, 1, 4.5, *none, NOW)], comments=[(10, 1, 1, "x", False, NOW), (11, 2, 1, "y", True, NOW)], users=[(1, "one")])
    assert rows(userdata.book_comments(cat, rating=4.5), "comment_id", "username") == [(10, "one")]
    assert rows(userdata.book_comments(cat), "comment_id", "total") == [(10, 2), (11, 2)]
    assert rows(userdata.book_comments(cat, spoilers=False), "comment_id") == [10]


def test_rating_profile_has_all_dimensions(spark):
    cat = catalogue(spark, [book(1)], ratings=[(1, 1, 4.5, 5.0, *[None] * 7, NOW)])
    found = userdata.rating_profile(cat).first()
    assert len(found["dimensions"]) == 8 and found["dimensions"]["humor"].n == 0 and found["dimensions"]["emotional_impact"].avg == "5.00"


def test_upserts_are_idempotent_and_keep_what_is_not_supplied(spark):
    cat = catalogue(spark, ratings=[(1, 1, 4.0, 5.0, *[None] * 7, NOW)])
    change = spark.createDataFrame([(1, 1, 3.0, None, NOW), (2, 1, 2.0, 1.0, NOW)], "user_id long, book_id long, overall_rating double, emotional_impact double, created_at timestamp")
    once = merge.upsert_ratings(cat.ratings, change, X.DIMENSIONS)
    twice = merge.upsert_ratings(once, change, X.DIMENSIONS)
    assert sorted(rows(once, "user_id", "overall_rating", "emotional_impact")) == [(1, 3.0, 5.0), (2, 2.0, 1.0)]
    assert sorted(rows(once, "user_id", "overall_rating", "emotional_impact")) == sorted(rows(twice, "user_id", "overall_rating", "emotional_impact"))


def test_toggling_a_favourite_shelves_a_missing_book(spark):
    cat = catalogue(spark, shelves=[(1, 1, "read", True, NOW)])
    toggles = spark.createDataFrame([(1, 1, NOW), (1, 2, NOW), (2, 2, NOW), (2, 2, NOW)], "user_id long, book_id long, updated_at timestamp")
    assert sorted(rows(merge.toggle_favorites(cat.bookshelves, toggles), "user_id", "book_id", "status", "is_favorite")) == [(1, 1, "read", False), (1, 2, "want_to_read", True), (2, 2, "want_to_read", False)]


def test_merge_policies(spark):
    table = spark.createDataFrame([(1, "a", ["x"], {"k": "1", "m": "2"}, 3)], "id int, s string, l array<string>, m map<string,string>, n int")
    new = spark.createDataFrame([(1, "b", ["x", "y"], {"k": "9"}, 4), (2, "c", None, None, 5)], table.schema)
    out = {r["id"]: r for r in merge.merged(table, new, ["id"], {"s": "fill", "l": "union", "m": "map", "n": "add"}).collect()}
    assert tuple(out[1]) == (1, "a", ["x", "y"], {"k": "9", "m": "2"}, 7)
    assert tuple(out[2]) == (2, "c", None, None, 5)
    assert merge.merged(table, new, ["id"], {}, insert=False).count() == 1


def test_replace_swaps_a_table_that_is_read(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    merge.replace(spark.range(3).toDF("id"), path)
    merge.replace(spark.read.parquet(path).where("id > 0"), path)
    assert sorted(rows(spark.read.parquet(path), "id")) == [1, 2]
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_cleanup_rules(spark):
    old, poor = dict(created_at=datetime(2020, 1, 1)), dict(description=None, primary_cover_url=None, isbn=None, publisher=None, number_of_pages=None)
    cat = catalogue(spark, [book(1, **old, **poor), book(2, **poor), book(3, **old, **poor, view_count=1), book(4, **old, **poor, ol_rating_count=30), book(5, **old)], authors=[(1, "a", "a", None, 0), (2, "b", "b", None, 3)], links=[(1, 1), (1, 2)])
    assert rows(cleanup.low_quality_books(cat, "2026-01-01"), "book_id") == [1]
    gone = cleanup.low_relevance_authors(cat)
    assert rows(gone, "author_id") == [1] and rows(cleanup.sole_author_books(cat, gone)) == []
    genres = spark.createDataFrame([("g1", "Sci-Fi 2"), ("g2", "Crème")], "genre_id string, name string")
    assert rows(cleanup.invalid_genres(genres), "genre_id") == ["g2"]


def test_small_and_nameless_series(spark):
    cat = catalogue(spark, [book(i, series_id=s) for i, s in enumerate(["a"] * 2 + ["b"] * 3 + ["unknown-x"] * 3)])
    assert sorted(rows(cleanup.small_series(cat), "series_id")) == ["a", "unknown-x"]


# ---- text helpers


@pytest.mark.parametrize(
    "text, slug", [("  The Left-Hand: of  Darkness! ", "the-left-hand-of-darkness"), ("", ""), (None, ""), ("A" * 300, "a" * 200), ("--a--", "a")]
)
def test_slugs(spark, text, slug):
    assert spark.createDataFrame([(text,)], "t string").select(X.slug_ascii(F.col("t"))).first()[0] == slug


def test_punctuation_alone_gets_a_steady_slug(spark):
    df = spark.createDataFrame([("!!!",), ("!!!",), ("???",)], "t string").select(X.slug_ascii(F.col("t")).alias("s"))
    a, b, c = rows(df, "s")
    assert a == b != c and len(a) == 16


def test_accents_fold(spark):
    assert spark.createDataFrame([("Ünï Ça",)], "t string").select(X.slug_ascii(T.folded(F.col("t")))).first()[0] == "uni-ca"


@pytest.mark.parametrize(
    "text, clean",
    [
        ("<b>Bold</b> &amp; **strong** [1] text:", "Bold & strong text"),
        ("Good.\n-----\nrest", "Good."),
        ("A\n\n\n\nB  C", "A\n\nB C"),
        ("see https://x.y/z now", "see now"),
        ("  ", None),
        (None, None),
        ("Story.\nSee also: this\nand that", "Story."),
        ("# Title\nText", "Title\nText"),
    ],
)
def test_descriptions(spark, text, clean):
    assert spark.createDataFrame([(text,)], "t string").select(T.clean_description(F.col("t"))).first()[0] == clean


@pytest.mark.parametrize("text, date", [("1984", "1984-01-01"), ("1984-07-01", "1984-07-01"), ("July 4, 1999", "1999-07-04"), ("unknown", None), ("not a date", None), (None, None), ("March 2001", "2001-03-01")])
def test_dates(spark, text, date):
    got = spark.createDataFrame([(text,)], "t string").select(X.parse_date(F.col("t")).cast("string")).first()[0]
    assert got == date


@pytest.mark.parametrize("text, name, number", [("Dune #1.5", "Dune", 1.5), ("Dune, 2", "Dune", 2.0), ("Dune", "Dune", None), ("Dune #1000", "Dune", None)])
def test_series_strings(spark, text, name, number):
    got = spark.createDataFrame([(text,)], "t string").select(X.series_name(F.col("t")), X.clamp_position(X.series_number(F.col("t")))).first()
    assert tuple(got) == (name, number)


def test_small_parsers(spark):
    df = spark.createDataFrame([("/works/OL123W", "Q42", "Kindle Edition", "1999-03", "Jo.Doe!!")], "a string, b string, c string, d string, e string")
    out = df.select(X.work_number(F.col("a")), X.is_qid(F.col("b")), X.book_format(F.col("c")), X.year_of(F.col("d")), X.username_candidate(F.col("e"))).first()
    assert tuple(out) == (123, True, "ebook", 1999, "jo_doe")


# ---- import

AUTHOR_LINES = [
    '/type/author\t/authors/OL1A\t1\t2020\t{"key":"/authors/OL1A","name":"Ann Lee","bio":{"value":"Writes."},"birth_date":"1970","photos":[-1,7],"remote_ids":{"wikidata":"Q1","x":""}}',
    '/type/author\t/authors/OL2A\t1\t2020\t{"key":"/authors/OL2A","name":"No Body"}',
    "/type/author\tbroken",
    "/type/author\t/authors/OL3A\t1\t2020\t{broken",
    '/type/work\t/works/OL1W\t1\t2020\t{"key":"/works/OL1W"}',
]


def text(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def test_author_import(spark):
    found = ingest.authors(dumps.records(text(spark, AUTHOR_LINES), "/type/author", dumps.AUTHOR))
    row = found.first()
    assert found.count() == 1 and (row["open_library_id"], row["slug"], row["bio"], row["wikidata_id"]) == ("OL1A", "ann-lee", "Writes.", "Q1")
    assert row["photo_url"].endswith("/7-L.jpg") and row["remote_ids"] == {"wikidata": "Q1"}


def test_work_and_edition_import(spark):
    authors = ingest.authors(dumps.records(text(spark, AUTHOR_LINES), "/type/author", dumps.AUTHOR))
    work = '/type/work\t/works/OL{0}W\t1\t2020\t{{"key":"/works/OL{0}W","title":"{1}","description":"Long\\tstory.","covers":[{0}],"subjects":["A","b","c","d","e","f"],"authors":[{{"author":{{"key":"/authors/{2}"}}}}]}}'
    works = ingest.works(dumps.records(text(spark, [work.format(1, "First Book", "OL1A"), work.format(2, "Orphan", "OL9A")]), "/type/work", dumps.WORK), authors)
    assert rows(works, "open_library_id", "slug", "author_slugs") == [("OL1W", "first-book", ["ann-lee"])]
    assert sorted(rows(ingest.genre_rows(works), "genre_slug")) == ["a", "b", "c", "d", "e"]
    edition = '/type/edition\t/books/OL{0}M\t1\t2020\t{{"key":"/books/OL{0}M","title":"T{0}","works":[{{"key":"/works/OL1W"}}],"languages":[{{"key":"/languages/{1}"}}],"isbn_13":["{2}"],"number_of_pages":{3}}}'
    lines = [edition.format(1, "eng", "i1", 0), edition.format(2, "eng", "i2", 99), edition.format(3, "eng", "i3", 98), edition.format(4, "ger", "i4", 10)]
    best = ingest.best_editions(dumps.records(text(spark, lines), "/type/edition", dumps.EDITION), works)
    assert sorted(rows(best, "language", "edition", "number_of_pages", "isbn")) == [("de", "OL4M", 10, ["i4"]), ("en", "OL2M", 99, ["i2", "i3", "i1"])]
    books = works.select("open_library_id", "language", "title", F.array().cast("array<string>").alias("isbn"), F.lit(5).alias("number_of_pages"), F.lit(None).cast("string").alias("publisher"))
    out = sorted(rows(ingest.merge_editions(books, best), "language", "title", "isbn", "number_of_pages"))
    assert out == [("de", "T4", ["i4"], 10), ("en", "First Book", ["i2", "i3", "i1"], 5)]


def test_rating_and_reading_log_import(spark):
    found = ingest.work_ratings(dumps.ratings(text(spark, ["/works/OL1W\t\t5\t2020", "/works/OL1W\t\t4\t2020", "/works/OL1W\t\t9\t", "OL1W\tx", "/works/OL2W\t\tx\t"])))
    assert rows(found) == [("OL1W", 2, 4.5)]
    shelves = ingest.work_shelves(dumps.reading_log(text(spark, ["/works/OL1W\t\tWant to Read\t2020", "/works/OL1W\t\tAlready Read", "/works/OL1W\t\tElsewhere"])))
    assert rows(shelves) == [("OL1W", 1, 0, 1)]
    books = spark.createDataFrame([("OL1W", 7), ("OL2W", 8)], "open_library_id string, ol_want_to_read_count long")
    assert sorted(rows(ingest.apply_counts(books, shelves.select("work", "ol_want_to_read_count"), reset=True))) == [("OL1W", 1), ("OL2W", 0)]


def test_phases_resume(spark, tmp_path):
    phases = {"a": lambda: spark.range(2).toDF("id"), "b": lambda: spark.read.parquet(f"file://{tmp_path}/a")}
    assert ingest.run_phases(phases, f"file://{tmp_path}", spark) == ["a", "b"]
    assert ingest.run_phases(phases, f"file://{tmp_path}", spark) == []


# ---- games

POOL = {"legendary": [1], "ultra_rare": [2, 3], "super_rare": [], "rare": [4, 5, 6], "uncommon": list(range(10, 30)), "common": list(range(30, 60))}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 25))
def test_packs_are_distinct_and_hold_a_rare_book(seed, length):
    pack = sampling.open_pack(POOL, seed, length)
    assert len(pack) == length == len({b for _, b in pack})
    assert any(t in sampling.GUARANTEED for t, _ in pack)
    assert all(b in POOL[t] for t, b in pack)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9))
def test_the_commonest_reel_is_the_winners_tier(seed):
    reels, (tier, won) = sampling.spin_slots(POOL, seed)
    names = [t.name for t in sampling.TIERS]
    assert max(map(names.index, reels)) == names.index(tier) and won in POOL[tier] and len(reels) == 3


def test_rolls_follow_the_chances():
    got = [sampling.roll(s, 0) for s in range(20_000)]
    for tier in sampling.TIERS:
        assert got.count(tier.name) / len(got) == pytest.approx(tier.chance, abs=0.015)


def test_fallback_takes_the_more_common_of_two_first():
    assert sampling.fallback_order("rare") == ["uncommon", "super_rare", "common", "ultra_rare", "legendary"]


# ---- search and streams


def test_bm25_and_typos(spark):
    docs = spark.createDataFrame([(1, "green apple pie"), (2, "green green"), (3, "blue sky"), (4, None)], "id int, text string")
    exact = {r["doc"]: r["score"] for r in search.bm25(docs, "id", "text", "green").collect()}
    assert set(exact) == {1, 2} and exact[2] > exact[1]
    assert rows(search.bm25(docs, "id", "text", "gren")) == []
    assert {r["doc"] for r in search.bm25(docs, "id", "text", "gren", fuzzy=True).collect()} == {1, 2}
    assert rows(search.bm25(docs, "id", "text", "?!")) == []


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    folder, root = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    event = lambda k: ("view", f'{{"k": {k}}}', NOW)
    make = lambda keys: spark.createDataFrame([event(k) for k in keys], "event_type string, props string, ts timestamp").coalesce(1)
    make([1, 1, 2]).write.mode("append").parquet(folder)
    for more in ([1, 3], []):
        counters.drain(counters.view_counts(counters.event_stream(spark, folder)), counters.fold_counts(f"{root}/t"), f"{root}/c")
        if more:
            make(more).write.mode("append").parquet(folder)
    assert sorted(rows(spark.read.parquet(f"{root}/t"), "entity_id", "view_count")) == [(1, 3), (2, 1), (3, 1)]


def test_the_best_row_does_not_depend_on_batches(spark, tmp_path):
    sink = counters.fold_best(f"file://{tmp_path}/best", ["k"], ["less", "id"])
    batches = [[("a", 3, 1), ("a", 2, 2), ("b", 5, 3)], [("a", 2, 1), ("c", 1, 9)], [("b", 6, 1)]]
    for i in (0, 1, 1, 2):
        sink(spark.createDataFrame(batches[i], "k string, less int, id int"), i)
    assert sorted(rows(spark.read.parquet(f"file://{tmp_path}/best"), "k", "less", "id")) == [("a", 2, 1), ("b", 5, 3), ("c", 1, 9)]


def test_isbns_keep_their_first_place_and_stop_at_twenty(spark):
    many = [("w", "en", 9 - i, f"k{i}", [f"i{2 * i}", f"i{2 * i + 1}", "i0"], None) for i in range(12)] + [("v", "en", 1, "k", None, None)]
    found = ingest.first_isbns(spark.createDataFrame(many, "work string, language string, score int, key string, isbn_13 array<string>, isbn_10 array<string>"))
    assert rows(found, "work", "isbn") == [("w", [f"i{i}" for i in range(20)])]


def test_slots_use_the_nearest_pool_and_rarer_reels(spark):
    cat = catalogue(spark, books=[book(i, rating_count=30, avg_rating=3.9) for i in range(1, 6)], users=[(i, f"u{i}") for i in range(60)])
    found = rows(sampling.spins(cat, 7), "user_id", "tier", "book_id", "reels")
    assert len(found) == 60 and {t for _, t, _, _ in found} == {"rare"} and {b for _, _, b, _ in found} == {1, 2, 3, 4, 5}
    assert all(r.split().count("rare") >= 1 and set(r.split()) <= {"legendary", "ultra_rare", "super_rare", "rare"} for *_, r in found)
    assert rows(sampling.spins(catalogue(spark, users=[(1, "u")]), 7)) == []


def test_touched_keys_are_recomputed(spark, tmp_path):
    path = f"file://{tmp_path}/stats"
    source = spark.createDataFrame([(1, 1, 4.0), (2, 1, 5.0), (1, 2, 3.0)], "user_id long, book_id long, overall_rating double")
    merge.replace(spark.createDataFrame([(1, 1, 4.0), (2, 9, 1.0)], "book_id long, rating_count long, avg_rating double"), path)
    counters.recompute_touched(lambda: source, userdata.book_rating_stats, "book_id", path)(source.where("book_id = 1"), 0)
    assert sorted(rows(spark.read.parquet(path))) == [(1, 2, 4.5), (2, 9, 1.0)]


def test_changed_since_moves_its_watermark(spark):
    df = spark.createDataFrame([(1, datetime(2026, 1, 1)), (2, datetime(2026, 1, 3))], "id int, at timestamp")
    first, mark = counters.changed_since(df, "at", None)
    again, _ = counters.changed_since(df, "at", mark)
    assert first.count() == 2 and again.count() == 0


def test_lists_are_built_in_isolation(spark, tmp_path, monkeypatch):
    cat = catalogue(spark, [book(1)])
    monkeypatch.setitem(lists.LISTS, "most_read", ("book", lambda cat, k: 1 / 0))
    failed = lists.build_all(cat, f"file://{tmp_path}", keys=("most_read", "most_wanted"))
    assert failed["most_read"] and failed["most_wanted"] is None
    assert rows(lists.page(spark.read.parquet(f"file://{tmp_path}/list=most_wanted"), 1), "book_id", "total") == [(1, 1)]
