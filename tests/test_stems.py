"""English stems in the search for books."""

import pytest

from shelfspark.functions.stem import stem
from shelfspark.operators import search
from tests.test_operators import book, catalogue, rows


@pytest.mark.parametrize("words", ["run running runs", "story stories", "hope hoping hoped", "relate related relational", "general generally", "caress caresses"])
def test_inflected_forms_share_a_stem(words):
    assert len({stem(w) for w in words.split()}) == 1


def test_stems_of_the_paper():
    words = "ponies ties cats feed agreed plastered bled motoring sing conflated troubled sized hopping falling hissing fizzed failing filing happy sky adoption replacement controll roll"
    stems = "poni ti cat feed agre plaster bled motor sing conflat troubl size hop fall hiss fizz fail file happi sky adopt replac control roll"
    assert [stem(w) for w in words.split()] == stems.split()
    assert [stem(w) for w in ("is", "b12s", "東京", "cafés")] == ["is", "b12s", "東京", "cafés"]


def test_books_are_found_by_stems(spark):
    docs = spark.createDataFrame([(1, "Run home"), (2, "Running runs"), (3, "A story")], "id int, text string")
    assert {r["doc"] for r in search.bm25(docs, "id", "text", "running", stem=True).collect()} == {1, 2}
    assert {r["doc"] for r in search.bm25(docs, "id", "text", "stories", stem=True).collect()} == {3}
    cat = catalogue(spark, [book(1, title="Run", slug="a1"), book(2, title="Walk", slug="a2")])
    assert rows(search.search_books(cat, "running"), "id") == ["1"]
    assert rows(search.search_books(cat, "running", stem=False)) == []
