"""Faceted random discovery."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import expressions as X
from shelfspark.operators.browse import with_readers
from shelfspark.sources.catalogue import Catalogue

#: Facets by name.
LENGTHS = {"short": (None, 199), "medium": (200, 400), "long": (401, 600), "epic": (601, None)}
ERAS = {"classic": (None, 1949), "modern": (1950, 1999), "contemporary": (2000, None)}


def within(value: Column, bounds: tuple[int | None, int | None]) -> Column:
    low, high = bounds
    out = value.isNotNull()
    if low is not None:
        out = out & (value >= low)
    if high is not None:
        out = out & (value <= high)
    return out


@dataclass(frozen=True)
class Facets:
    """What a reader asks for; unknown values of a facet ask for nothing."""

    language: str = "en"
    length: str = ""
    era: str = ""
    quality: str = ""
    popularity: str = ""
    series: str = ""
    genres: tuple[str, ...] = ()
    dimension: str = ""
    exclude: tuple[int, ...] = ()


def candidates(cat: Catalogue, facets: Facets) -> DataFrame:
    """Books that meet all facets."""
    rating, ratings = X.combined_rating(None), X.total_ratings()
    books = with_readers(cat, cat.books.where(F.col("language") == facets.language))
    if facets.length in LENGTHS:
        books = books.where(within(F.col("number_of_pages"), LENGTHS[facets.length]))
    if facets.era in ERAS:
        books = books.where(within(F.col("original_publication_year"), ERAS[facets.era]))
    bands = {"high": rating > 4, "medium": (rating > 3) & (rating <= 4), "low": (rating > 2) & (rating <= 3), "very_low": rating <= 2}
    if facets.quality in bands:
        books = books.where((ratings > 0) & bands[facets.quality])
    fame = {"popular": F.col("total_readers") > 100, "hidden_gem": (F.col("total_readers") < 50) & (ratings > 0) & (rating > 3.5)}
    if facets.popularity in fame:
        books = books.where(fame[facets.popularity])
    kinds = {"standalone": F.col("series_id").isNull(), "series": F.col("series_id").isNotNull()}
    if facets.series in kinds:
        books = books.where(kinds[facets.series])
    if facets.genres:
        books = books.join(cat.book_genres.where(F.col("genre_id").isin(*facets.genres)).select("book_id").distinct(), "book_id", "left_semi")
    if facets.dimension in X.DIMENSIONS:
        stats = cat.ratings.where(F.col(facets.dimension).isNotNull()).groupBy("book_id").agg(F.avg(facets.dimension).alias("mean"), F.count("*").alias("n"))
        books = books.join(stats.where("mean >= 3.5 and n >= 3").select("book_id"), "book_id", "left_semi")
    if facets.exclude:
        books = books.where(~F.col("book_id").isin(*facets.exclude))
    return books


def pick(cat: Catalogue, facets: Facets, seed: int, n: int = 1) -> DataFrame:
    """The first n candidates in the order of a seed, with the number of all candidates."""
    found = candidates(cat, facets)
    total = found.count()
    return found.orderBy(X.seeded_order(F.col("book_id"), seed), "book_id").limit(n).select("book_id", "title", X.six(X.combined_rating(None)).alias("combined_rating"), F.col("total_readers").cast("long").alias("total_readers"), F.lit(total).cast("long").alias("candidates"))
