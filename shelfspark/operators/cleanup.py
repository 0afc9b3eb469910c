"""What quality rules take out of a catalogue. All give the ids to delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import expressions as X
from shelfspark.sources.catalogue import Catalogue

#: A book below this score may go; ratings and readers below which it may; books of an author, series or genre up to which these may.
LEAST_SCORE, FEW, FEW_AUTHOR_BOOKS, FEW_SERIES_BOOKS, FEW_GENRE_BOOKS = 4, 30, 2, 2, 5


def quality_scores(cat: Catalogue) -> DataFrame:
    """(book_id, score): of eight things that make a complete record, how many there are."""
    has_author = cat.book_authors.select("book_id").distinct().withColumn("has_author", F.lit(True))
    has_genre = cat.book_genres.select("book_id").distinct().withColumn("has_genre", F.lit(True))
    joined = cat.books.join(has_author, "book_id", "left").join(has_genre, "book_id", "left")
    there = (X.filled(F.col("description")), F.col("primary_cover_url").isNotNull(), F.col("has_author"), F.col("has_genre"), F.col("original_publication_year").isNotNull(), X.filled(F.col("isbn")), F.col("number_of_pages") > 0, X.filled(F.col("publisher")))
    return joined.select("book_id", X.truthy_count(*there).alias("score"))


def _shelved(cat: Catalogue) -> DataFrame:
    return cat.bookshelves.groupBy("book_id").agg(F.count("*").alias("shelves"))


def low_quality_books(cat: Catalogue, as_of: str, least_score: int = LEAST_SCORE, few: int = FEW) -> DataFrame:
    """Incomplete books that nobody looks at, rates or shelves, and that aren't new."""
    old = F.col("created_at") < F.lit(as_of).cast("timestamp") - F.expr("interval 1 day")
    quiet = (F.col("view_count") == 0) & (X.total_ratings() < few) & old
    books = cat.books.where(quiet).select("book_id", "ol_already_read_count").join(_shelved(cat), "book_id", "left")
    unread = books.where(F.col("ol_already_read_count") + F.coalesce("shelves", F.lit(0)) < few)
    return unread.join(quality_scores(cat).where(F.col("score") < least_score), "book_id").select("book_id", "score")


def low_relevance_authors(cat: Catalogue, few_books: int = FEW_AUTHOR_BOOKS, few: int = FEW) -> DataFrame:
    """Authors of few books that nobody looks at, rates or shelves."""
    links = cat.book_authors.join(cat.books.select("book_id", X.total_ratings().alias("n")), "book_id").join(_shelved(cat), "book_id", "left")
    sums = links.groupBy("author_id").agg(F.count("*").alias("books"), F.sum("n").alias("ratings"), F.sum(F.coalesce("shelves", F.lit(0))).alias("shelves"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = cat.authors.where("view_count = 0").join(sums, "author_id", "left")
    return joined.where((zero("books") <= few_books) & (zero("ratings") < few) & (zero("shelves") < few)).select("author_id", zero("books").cast("long").alias("books"))


def sole_author_books(cat: Catalogue, authors: DataFrame) -> DataFrame:
    """Books all of whose authors go; they go with them."""
    gone = cat.book_authors.join(authors.select("author_id", F.lit(True).alias("gone")), "author_id", "left")
    return gone.groupBy("book_id").agg(F.bool_and(F.coalesce("gone", F.lit(False))).alias("all_gone")).where("all_gone").select("book_id")


def small_series(cat: Catalogue, few: int = FEW_SERIES_BOOKS) -> DataFrame:
    """Series of few books, and nameless ones that nobody rates or reads."""
    books = cat.books.where("series_id is not null").join(_shelved(cat), "book_id", "left")
    sums = books.groupBy("series_id").agg(F.count("*").alias("books"), F.sum(X.total_ratings()).alias("ratings"), F.sum(X.library_readers() + F.coalesce("shelves", F.lit(0))).alias("readers"))
    low = F.lower(F.trim("series_id"))
    nameless = (low == "unknown") | low.like("unknown-%")
    return sums.where((F.col("books") <= few) | (nameless & (F.col("ratings") == 0) & (F.col("readers") == 0))).select("series_id", "books")


def unlinked_genres(cat: Catalogue) -> DataFrame:
    """Genres without a link in the whole table."""
    return orphan_genres(cat.genres, cat.book_genres)


def orphan_genres(genres: DataFrame, book_genres: DataFrame) -> DataFrame:
    return genres.join(book_genres, "genre_id", "left_anti").select("genre_id")


def small_genres(cat: Catalogue, few: int = FEW_GENRE_BOOKS) -> DataFrame:
    counts = cat.book_genres.groupBy("genre_id").agg(F.count("*").alias("books"))
    return cat.genres.join(counts, "genre_id", "left").where(F.coalesce("books", F.lit(0)) <= few).select("genre_id", F.coalesce("books", F.lit(0)).cast("long").alias("books"))


def invalid_genres(genres: DataFrame) -> DataFrame:
    """Genres whose names hold anything but letters, digits, blanks and hyphens."""
    return genres.where(F.col("name").rlike("[^a-zA-Z0-9 -]")).select("genre_id")


def cycle(cat: Catalogue, as_of: str) -> dict[str, DataFrame]:
    """All rules in their order, each on what those before it leave of the ids it gives."""
    books = low_quality_books(cat, as_of)
    authors = low_relevance_authors(cat)
    return {"books": books.select("book_id").union(sole_author_books(cat, authors)).distinct(), "authors": authors, "series": small_series(cat), "genres": small_genres(cat).select("genre_id").union(invalid_genres(cat.genres)).distinct()}
