"""Taste profiles of all users: shelves, genre weights, ratings, series in progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions import expressions as X
from shelfspark.sources.catalogue import Catalogue

COLD_START = 5
TOP_GENRES = 3


def shelf_profile(cat: Catalogue) -> DataFrame:
    """user_id, read_ids (read, reading and abandoned), want_ids, favorite_ids, shelved."""
    ids = lambda c: F.array_sort(F.collect_set(F.when(c, F.col("book_id"))))
    return cat.bookshelves.groupBy("user_id").agg(
        ids(F.col("status").isin("read", "reading", "abandoned")).alias("read_ids"), ids(F.col("status") == "want_to_read").alias("want_ids"), ids(F.col("is_favorite")).alias("favorite_ids"), F.count("*").alias("shelved")
    )


def excluded(cat: Catalogue) -> DataFrame:
    """(user_id, book_id) that recommendations leave out: read, being read, or given up."""
    return cat.bookshelves.where(F.col("status").isin("read", "reading", "abandoned")).select("user_id", "book_id")


def authors_read(cat: Catalogue) -> DataFrame:
    """(user_id, author_id) of books read or being read."""
    reads = cat.bookshelves.where(F.col("status").isin(*X.READ_SHELVES))
    return reads.join(cat.book_authors, "book_id").select("user_id", "author_id").distinct()


def shelf_weight() -> Column:
    rated = F.col("overall_rating")
    by_status = (
        F.when((F.col("status") == "read") & (rated >= 4), 3.0)
        .when((F.col("status") == "read") & rated.isNotNull(), 1.0)
        .when(F.col("status") == "read", 1.5)
        .when(F.col("status") == "reading", 1.5)
        .when(F.col("status") == "want_to_read", 0.5)
        .when(F.col("status") == "abandoned", -1.0)
        .otherwise(0.0)
    )
    return by_status + F.when(F.col("is_favorite"), 2.0).otherwise(0.0)


def genre_weights(cat: Catalogue) -> DataFrame:
    """(user_id, genre_id, weight, rank, raw, total): positive sums of shelf weights, scaled to add up to one per user.
    Sums over a user's genres are taken of raw, which is in halves and so exact in any order."""
    rated = cat.ratings.select("user_id", "book_id", "overall_rating")
    weighed = cat.bookshelves.join(rated, ["user_id", "book_id"], "left").withColumn("weight", shelf_weight())
    sums = weighed.join(cat.book_genres, "book_id").groupBy("user_id", "genre_id").agg(F.sum("weight").alias("raw")).where("raw > 0")
    user = Window.partitionBy("user_id")
    scaled = sums.withColumn("total", F.sum("raw").over(user))
    rank = F.row_number().over(user.orderBy(F.desc("raw"), "genre_id"))
    return scaled.select("user_id", "genre_id", (F.col("raw") / F.col("total")).alias("weight"), rank.alias("rank"), "raw", "total")


def anchors(cat: Catalogue) -> DataFrame:
    """(user_id, anchor_id): each user's best rated book, the smaller id among equals."""
    best = F.max(F.struct("overall_rating", (-F.col("book_id")).alias("key")))
    return cat.ratings.groupBy("user_id").agg(best.alias("best")).select("user_id", (-F.col("best.key")).alias("anchor_id"))


def dimension_means(cat: Catalogue, least: int = 2) -> DataFrame:
    """(user_id, dimension, mean, n) of dimensions rated `least` times."""
    return unpivoted(cat).groupBy("user_id", "dimension").agg(F.avg("value").alias("mean"), F.count("*").alias("n")).where(F.col("n") >= least)


def unpivoted(cat: Catalogue) -> DataFrame:
    """One row for each rating and dimension that it fills in."""
    return cat.ratings.unpivot(["user_id", "book_id"], list(X.DIMENSIONS), "dimension", "value").where("value is not null")


def series_in_progress(cat: Catalogue) -> DataFrame:
    """(user_id, series_id, read_count, total): series of which the user has read some, and not all, books."""
    members = cat.books.where("series_id is not null").select("book_id", "series_id")
    totals = members.groupBy("series_id").agg(F.count("*").alias("total"))
    reads = cat.bookshelves.where(F.col("status").isin(*X.READ_SHELVES)).join(members, "book_id")
    return reads.groupBy("user_id", "series_id").agg(F.count("*").alias("read_count")).join(totals, "series_id").where("read_count < total").select("user_id", "series_id", "read_count", "total")


def profiles(cat: Catalogue) -> DataFrame:
    """One wide row per user; cold marks those with fewer than COLD_START books on their shelves."""
    genres = genre_weights(cat).where(F.col("rank") <= TOP_GENRES).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rank", "genre_id", "weight"))).alias("top"))
    shelves = shelf_profile(cat)
    joined = shelves.join(genres, "user_id", "left").join(anchors(cat), "user_id", "left")
    return joined.select("user_id", "read_ids", "want_ids", "favorite_ids", "shelved", F.col("top.genre_id").alias("top_genres"), "anchor_id", (F.col("shelved") < COLD_START).alias("cold"))


def active_users(cat: Catalogue, least: int = COLD_START) -> DataFrame:
    return cat.bookshelves.groupBy("user_id").agg(F.count_distinct("book_id").alias("n")).where(F.col("n") >= least).select("user_id")
