from shelfspark.operators import cleanup
from tests.test_operators import book, catalogue, rows


def test_links_of_any_book_keep_a_genre(spark):
    cat = catalogue(spark, [book(1), book(500)], genres=[(1, "mystery"), (500, "poetry")])
    cat.genres = cat.genres.unionByName(cat.genres.limit(1).selectExpr("'lost' AS genre_id"), allowMissingColumns=True)
    assert rows(cleanup.unlinked_genres(cat), "genre_id") == ["lost"]
