"""The stored index against searches that analyse all documents anew."""

import random

import pytest
from pyspark.sql import functions as F

from shelfspark.functions.stem import stem as stem_of
from shelfspark.operators import index as index_module
from shelfspark.operators import search
from shelfspark.operators.index import LONG, SearchIndex, asked_keys, term_keys
from tests.test_operators import book, catalogue


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def texts_of(spark, docs):
    return spark.createDataFrame([(f"book/en/{f}", d, t, f == "title") for d, fields in docs.items() for f, t in fields.items()], "field string, doc string, text string, stem boolean")


def keys_of(spark, docs):
    return spark.createDataFrame([(d,) for d in docs], "doc string")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed_word(rng, word, edits):
    for _ in range(edits):
        at = rng.randrange(len(word) + 1)
        kind = rng.randrange(3)
        word = word[:at] + (rng.choice("abé") if kind < 2 else "") + word[at + (kind > 0) :]
    return word


def test_every_word_within_reach_has_a_key_in_common(spark):
    rng = random.Random(5)
    words = [w for n in (1, 2, 3, 4, 5, 6, 9, 14, 30, 31, 32, 33, 34, 35, 40, 71) for w in ("".join(rng.choice("abcdeé") for _ in range(n)) for _ in range(12))]
    terms = sorted({v for w in words for e in (0, 1, 2) if (v := changed_word(rng, w, e))})
    keys = {r["t"]: set(r["k"]) for r in spark.createDataFrame([(t,) for t in terms], "t string").select("t", term_keys(F.col("t")).alias("k")).collect()}
    assert max(len(k) for t, k in keys.items() if len(t) > LONG) == 3
    for w in words:
        edits = search.fuzzy_edits(w)
        asked = asked_keys(w, edits)
        missed = [t for t in terms if distance(w, t) <= edits and not asked & keys[t]]
        assert not missed, (w, missed)


DOCS = {
    "1": {"title": "Running with wolves", "slug": "running-with-wolves"},
    "2": {"title": "The Wolf runs; the wolf RAN", "slug": "wolf"},
    "3": {"title": "Été à la mer", "slug": "ete"},
    "4": {"title": None, "slug": ""},
    "5": {"title": "the the the", "slug": "the-story"},
}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    out = SearchIndex(spark, f"file://{tmp_path_factory.mktemp('index')}/i", 8)
    assert out.apply(texts_of(spark, DOCS), keys_of(spark, DOCS), 0)
    return out


@pytest.mark.parametrize("query", ["wolf", "wolfs running", "ete", "the", "runing woolves", "zzz", "?!", "storry"])
@pytest.mark.parametrize("stem", [False, True])
def test_same_scores_as_without_an_index(spark, index, query, stem):
    docs = spark.createDataFrame([(d, f["title"], f["slug"]) for d, f in DOCS.items()], "id string, title string, slug string")
    want = rows(search.best_field(docs, "id", {"title": 3.0, "slug": 1.0}, query, stemmed_fields=("title",) if stem else ()).select("doc", F.round("score", 9)))
    got = rows(index.best_field({"book/en/title" + "~" * stem: 3.0, "book/en/slug": 1.0}, query).select("doc", F.round("score", 9)))
    assert got == want


def test_a_query_reads_the_buckets_of_its_words_alone(index):
    near = index.near(["wolf"])
    assert rows(near) == [("wolf", "wolf"), ("wolf", "wolv")]
    some = index._read("postings", [index.postings.bucket_of("wolf")])
    assert 0 < len(some.inputFiles()) < len(index._read("postings").inputFiles())
    assert len(index._read("typos", {index.typos.bucket_of(k) for k in asked_keys("at", 0)}).inputFiles()) <= 1


def everything(index):
    lengths = index._read("lengths").groupBy("field").agg(F.sum("documents").alias("n"), F.sum("words").alias("w")).where("n <> 0")
    return rows(index.held(), "field", "term", "doc", "tf", "length"), rows(lengths)


CHANGES = [
    {"1": {"title": "Walking with wolves", "slug": "walking-with-wolves"}, "6": {"title": "New one", "slug": "new"}},
    {"2": {}, "4": {"title": "no longer empty", "slug": "x"}, "99": {}},
    {"6": {"title": "new NEW one", "slug": "new"}, "1": DOCS["1"], "2": {"title": "Back again", "slug": "back"}},
]


def test_changes_give_what_a_rebuild_gives(spark, tmp_path):
    index, now = SearchIndex(spark, f"file://{tmp_path}/i", 4), dict(DOCS)
    index.apply(texts_of(spark, DOCS), keys_of(spark, DOCS), 0)
    for batch, change in enumerate(CHANGES, 1):
        if batch == 2:  # a writer that is lost after the first of its tables
            commit, index._commit = index._commit, lambda batch: (_ for _ in ()).throw(OSError("lost"))
            before = everything(index)
            with pytest.raises(OSError):
                index.apply(texts_of(spark, change), keys_of(spark, change), batch)
            index._commit = commit
            assert everything(index) == before  # readers see nothing of it
        assert index.apply(texts_of(spark, change), keys_of(spark, change), batch)
        assert not index.apply(texts_of(spark, change), keys_of(spark, change), batch)
        now |= change
    fresh = SearchIndex(spark, f"file://{tmp_path}/fresh", 4)
    fresh.apply(texts_of(spark, now), keys_of(spark, now), 0)
    assert everything(index) == everything(fresh)
    rows_before, held = index._read("postings").count(), everything(index)
    index.compact()
    assert everything(index) == held and index._read("postings").count() == len(held[0]) < rows_before
    assert rows(index.near(["wolvs"])) == rows(fresh.near(["wolvs"])) != []


def test_an_empty_index(spark, tmp_path):
    index = SearchIndex(spark, f"file://{tmp_path}/i", 4)
    assert rows(index.best_field({"book/en/title": 1.0}, "wolf")) == []
    index.apply(texts_of(spark, {}), keys_of(spark, {}), 0)
    assert rows(index.best_field({"book/en/title": 1.0}, "wolf")) == []


def test_searches_of_a_catalogue(spark, tmp_path):
    cat = catalogue(
        spark, [book(1, title="Green apples", series_id="Trees"), book(2, title="Grün", language="de"), book(3, title="Apple tree", rating_count=9, avg_rating=5.0)], authors=[(7, "Ann Green", "ann", None, 0)], links=[(1, 7), (3, 7)]
    )
    index = SearchIndex(spark, f"file://{tmp_path}/i", 4)
    texts = search.all_texts(cat)
    index.apply(texts, texts.select("doc"), 0)
    for stem in (False, True):
        assert rows(search.federated(cat, "gren apple", stem=stem, index=index)) == rows(search.federated(cat, "gren apple", stem=stem)) != []
    assert rows(search.search_books(cat, "grün", "de", index=index)) == rows(search.search_books(cat, "grün", "de")) != []


def test_terms_are_stemmed_and_keyed_by_several_tasks(spark, monkeypatch):
    """Terms are few bytes, which adaptive execution puts in one task; only words of letters are stemmed."""
    monkeypatch.setattr(index_module, "STEMMED_IN_TASK", 50)
    monkeypatch.setattr(index_module, "KEYED_IN_TASK", 50)
    words = sorted({f"wor{chr(97 + i % 26)}{chr(97 + i // 26)}king" for i in range(400)})
    terms = spark.createDataFrame([(w,) for w in [*words, *map(str, range(100))]], "term string").distinct()
    largest = lambda df, column: max(r["n"] for r in df.select(F.spark_partition_id().alias("p"), column).distinct().groupBy("p").agg(F.count("*").alias("n")).collect())
    found = index_module.stems(terms)
    assert sorted(r["term"] for r in found.collect()) == words and all(r["stem"] == stem_of(r["term"]) for r in found.collect())
    assert largest(found, "term") <= 110
    keys = index_module.dictionary_rows(terms)
    assert largest(keys, "term") <= 110
    assert {r["term"] for r in keys.collect()} == {*words, *map(str, range(100))}
