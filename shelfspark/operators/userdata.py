"""Statistics over shelves, ratings and comments, and their paged lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions import expressions as X
from shelfspark.operators.profile import unpivoted
from shelfspark.sources.catalogue import Catalogue


def shelf_stats(cat: Catalogue) -> DataFrame:
    return shelf_stats_of(cat.bookshelves)


def shelf_stats_of(shelves: DataFrame) -> DataFrame:
    """Per user: books on each shelf and favourites."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return shelves.groupBy("user_id").agg(n("want_to_read"), n("reading"), n("read"), n("abandoned"), F.count_if("is_favorite").alias("favorites"))


def rating_counts(cat: Catalogue) -> DataFrame:
    return cat.ratings.groupBy("user_id").agg(F.count("*").alias("ratings"))


def comment_counts(cat: Catalogue) -> DataFrame:
    return cat.comments.groupBy("user_id").agg(F.count("*").alias("comments"))


def user_stats(cat: Catalogue) -> DataFrame:
    """All counters of all users that have any."""
    joined = shelf_stats(cat).join(rating_counts(cat), "user_id", "full").join(comment_counts(cat), "user_id", "full")
    names = ("want_to_read", "reading", "read", "abandoned", "favorites", "ratings", "comments")
    return joined.select("user_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])


def book_rating_stats(ratings: DataFrame) -> DataFrame:
    """Per book: number and average of ratings."""
    halves = F.sum(F.col("overall_rating") * 2).cast("long")
    return ratings.groupBy("book_id").agg(F.count("*").alias("rating_count"), halves.alias("halves")).select("book_id", "rating_count", X.average_of_halves(F.col("halves"), F.col("rating_count")).alias("avg_rating"))


def dimension_stats(cat: Catalogue) -> DataFrame:
    """Per book and rated dimension: number and average."""
    sums = unpivoted(cat).groupBy("book_id", "dimension").agg(F.count("*").alias("n"), F.sum(F.col("value") * 2).cast("long").alias("halves"))
    return sums.select("book_id", "dimension", "n", X.average_of_halves(F.col("halves"), F.col("n")).alias("average"))


def rating_distribution(ratings: DataFrame) -> DataFrame:
    """Per book: how often each value was given."""
    return ratings.groupBy("book_id", F.col("overall_rating").alias("value")).agg(F.count("*").alias("n"))


def rating_profile(cat: Catalogue) -> DataFrame:
    """Book statistics as maps: distribution and all eight dimensions, those without ratings with zeros."""
    distribution = rating_distribution(cat.ratings).groupBy("book_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("value").cast("string"), "n")))).alias("distribution"))
    entry = F.struct(F.col("dimension"), F.struct(F.format_number("average", 2).alias("avg"), "n").alias("stats"))
    rated = dimension_stats(cat).groupBy("book_id").agg(F.map_from_entries(F.collect_list(entry)).alias("rated"))
    every = F.map_from_entries(F.array(*[F.struct(F.lit(d), F.coalesce(F.col("rated")[d], F.struct(F.lit("0.00").alias("avg"), F.lit(0).cast("long").alias("n")))) for d in X.DIMENSIONS]))
    return book_rating_stats(cat.ratings).join(distribution, "book_id").join(rated, "book_id", "left").withColumn("dimensions", every).drop("rated")


def paged(rows: DataFrame, partition: str, order: list[Column], limit: int, offset: int) -> DataFrame:
    whole = Window.partitionBy(partition)
    numbered = rows.withColumn("position", F.row_number().over(whole.orderBy(*order)).cast("int")).withColumn("total", F.count("*").over(whole))
    return numbered.where((F.col("position") > offset) & (F.col("position") <= offset + limit))


def user_shelves(cat: Catalogue, status: str = "", favorites: bool = False, sort: str = "updated_at", limit: int = 10, offset: int = 0) -> DataFrame:
    """A page of every user's shelf, the newest first; optional filters by status and favourites."""
    rows = cat.bookshelves
    if status:
        rows = rows.where(F.col("status") == status)
    if favorites:
        rows = rows.where("is_favorite")
    key = {"status": F.asc("status"), "is_favorite": F.desc("is_favorite")}.get(sort, F.desc("updated_at"))
    return paged(rows, "user_id", [key, F.asc("book_id")], limit, offset).select("user_id", "position", "book_id", "status", "total")


def user_ratings(cat: Catalogue, low: float = 0.0, high: float = 0.0, limit: int = 10, offset: int = 0) -> DataFrame:
    """A page of every user's ratings, the best first; bounds of 0 mean none."""
    rows = cat.ratings
    if low > 0:
        rows = rows.where(F.col("overall_rating") >= low)
    if high > 0:
        rows = rows.where(F.col("overall_rating") <= high)
    return paged(rows, "user_id", [F.desc("overall_rating"), F.asc("book_id")], limit, offset).select("user_id", "position", "book_id", "overall_rating", "total")


def user_comments(cat: Catalogue, book_id: int | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
    rows = cat.comments if book_id is None else cat.comments.where(F.col("book_id") == book_id)
    return paged(rows, "user_id", [F.desc("created_at"), F.desc("comment_id")], limit, offset).select("user_id", "position", "comment_id", "book_id", "total")


#: Sort keys of a book's comments.
COMMENT_SORTS = ("created_at", "overall_rating", *X.DIMENSIONS)


def book_comments(cat: Catalogue, spoilers: bool = True, rating: float = 0.0, sort: str = "overall_rating", limit: int = 10, offset: int = 0) -> DataFrame:
    """A page of every book's comments with their writers' ratings and names. Asking for an exact rating leaves out
    writers who haven't rated."""
    rows = cat.comments if spoilers else cat.comments.where("not is_spoiler")
    rated = cat.ratings.drop("created_at")
    if rating > 0:
        joined = rows.join(rated.where(F.col("overall_rating") == rating), ["user_id", "book_id"])
    else:
        joined = rows.join(rated, ["user_id", "book_id"], "left")
    key = sort if sort in COMMENT_SORTS else "created_at"
    named = joined.join(cat.users, "user_id", "left")
    page = paged(named, "book_id", [F.desc_nulls_last(key), F.desc("created_at"), F.desc("comment_id")], limit, offset)
    return page.select("book_id", "position", "comment_id", F.coalesce("username", F.lit("")).alias("username"), "overall_rating", "is_spoiler", "total")


def public_profile(cat: Catalogue) -> DataFrame:
    """Counters of all users, zeros for those without any."""
    names = ("want_to_read", "reading", "read", "abandoned", "favorites", "ratings", "comments")
    return cat.users.join(user_stats(cat), "user_id", "left").select("user_id", "username", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names])


def user_book_info(cat: Catalogue, user_id: int, book_id: int) -> DataFrame:
    """What one user holds of one book: shelf, rating, comments."""
    mine = lambda df: df.where((F.col("user_id") == user_id) & (F.col("book_id") == book_id))
    shelf = mine(cat.bookshelves).select("user_id", "book_id", "status", "is_favorite")
    return shelf.join(mine(cat.ratings).select("user_id", "book_id", "overall_rating"), ["user_id", "book_id"], "full").join(mine(cat.comments).select("user_id", "book_id", "body"), ["user_id", "book_id"], "full")


def hydrate(cat: Catalogue, ids: DataFrame) -> DataFrame:
    """Titles, slugs, covers and authors of rows (position, book_id), in their order."""
    meta = cat.books.select("book_id", "title", "slug", F.coalesce("primary_cover_url", F.lit("")).alias("cover_url"))
    return ids.join(meta, "book_id").join(cat.author_names, "book_id", "left").orderBy("position")


def resolved(cat: Catalogue, names: DataFrame) -> DataFrame:
    """Rows (username, slug, language) with the user_id and book_id that they name; null where there is none."""
    users = cat.users.select("user_id", "username")
    books = cat.books.select("book_id", "slug", "language")
    return names.join(users, "username", "left").join(books, ["slug", "language"], "left")


def point_reads(cat: Catalogue, pairs: DataFrame) -> DataFrame:
    """What users hold of books, for rows (user_id, book_id): status, is_favorite, overall_rating, comments (their
    number); one row for each pair asked for, nulls where there is nothing."""
    keys = ["user_id", "book_id"]
    shelves = cat.bookshelves.select(*keys, "status", "is_favorite")
    said = cat.comments.groupBy(*keys).agg(F.count("*").alias("comments"))
    return pairs.distinct().join(shelves, keys, "left").join(cat.ratings.select(*keys, "overall_rating"), keys, "left").join(said, keys, "left").withColumn("comments", F.coalesce("comments", F.lit(0)))


def affected_users(cat: Catalogue, book_ids: DataFrame) -> DataFrame:
    """Users with anything on one of the books."""
    tables = (cat.bookshelves, cat.ratings, cat.comments)
    return reduce(DataFrame.union, [t.join(book_ids, "book_id", "left_semi").select("user_id") for t in tables]).distinct()
