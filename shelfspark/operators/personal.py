"""Personal sections for all users at once: (user_id, rank, book_id, score)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions import expressions as X
from shelfspark.operators import chunks as C
from shelfspark.operators import profile as P
from shelfspark.operators import signatures as S
from shelfspark.operators.common import broadcast_if_small, cut, spread
from shelfspark.operators.overlap import top_overlaps
from shelfspark.sources.catalogue import Catalogue, once

LIMIT = 20
SIMILAR_USERS = 200
READERS = 500


def ranked(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy(*order, "book_id"))
    return scored.withColumn("rank", nth).where(F.col("rank") <= k).select("user_id", "rank", "book_id", X.six(F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("score"))


def _shown(cat: Catalogue, *columns: str) -> DataFrame:
    return cat.books.where(X.listable()).select("book_id", *columns)


def _reads(cat: Catalogue) -> DataFrame:
    return cat.bookshelves.where(F.col("status").isin(*X.READ_SHELVES)).select("user_id", "book_id")


def similar_users(cat: Catalogue, least: int = 2, most: int = SIMILAR_USERS) -> DataFrame:
    """(user_id, other_id): the users who read most of what the user has read or given up."""
    mine = P.excluded(cat).select(F.col("user_id").alias("source_id"), F.col("book_id").alias("member"))
    theirs = _reads(cat).select(F.col("user_id").alias("target_id"), F.col("book_id").alias("member"))
    return top_overlaps(mine, theirs, least, most).select(F.col("source_id").alias("user_id"), F.col("target_id").alias("other_id"))


def _met(cat: Catalogue, others: DataFrame) -> int:
    """How many reads of others' (user_id, other_id) there are."""
    sizes = _reads(cat).groupBy(F.col("user_id").alias("other_id")).agg(F.count("*").alias("n"))
    return others.join(sizes, "other_id").agg(F.sum("n")).first()[0] or 0


def collaborative(cat: Catalogue, others: DataFrame | None = None) -> DataFrame:
    """(user_id, book_id, readers): how many similar users read a book that the user hasn't. A user's rows are together,
    in tasks as many as the rows need."""
    others = cut(similar_users(cat)) if others is None else others
    met = others.join(_reads(cat).withColumnRenamed("user_id", "other_id"), "other_id").select("user_id", "book_id", F.lit(True).alias("met"))
    both = spread(met.unionByName(P.excluded(cat).withColumn("met", F.lit(False))), _met(cat, others), "user_id")
    return both.groupBy("user_id", "book_id").agg(F.count("*").alias("readers"), F.min("met").alias("met")).where("met").drop("met")


def _needs(cat: Catalogue, users: DataFrame, k: int) -> DataFrame:
    """users (user_id, ...) with `need`: of any ranking that all users share, the first `need` books hold k that
    the user hasn't read or given up."""
    gone = _gone(cat).select("user_id", F.size("gone").alias("gone"))
    return users.join(gone, "user_id", "left").withColumn("need", (F.coalesce("gone", F.lit(0)) + k).cast("int")).drop("gone")


def _deepest(cat: Catalogue, k: int) -> int:
    """The largest need of any user."""
    return (_gone(cat).agg(F.max(F.size("gone"))).first()[0] or 0) + k


def _best_of_both(base: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """The best k of each user. base has at least the best books by a part of the score that other parts only add to;
    exact has the books to which something is added, or the best k of them, so a book in both counts by its exact score."""
    both = base.select("user_id", "book_id", "score").unionByName(exact.select("user_id", "book_id", "score"))
    both = both.repartition("user_id").groupBy("user_id", "book_id").agg(F.max("score").alias("score"))
    return ranked(both, k, F.desc("score"))


def _gone(cat: Catalogue) -> DataFrame:
    """(user_id, gone): the books that each user has read or given up."""
    return once(cat, "gone", lambda: P.excluded(cat).groupBy("user_id").agg(F.collect_list("book_id").alias("gone")))


class _Chosen:
    """The best k of a block's rows, user by user (read_by_others)."""

    COLUMNS: dict[str, pa.DataType] = {}

    def __init__(self, k: int):
        self.k = k

    def empty(self) -> pa.Table:
        return pa.schema(list(self.COLUMNS.items())).empty_table()


class _ForYou(_Chosen):
    """By the score of for_you."""

    SCHEMA = S.GENRE_SCORED
    COLUMNS = {"user_id": pa.int64(), "book_id": pa.int64(), "readers": pa.int64(), "most": pa.int64(), "average": pa.float64(), "genre_score": pa.float64()}

    def __call__(self, user: np.ndarray, book: np.ndarray, readers: np.ndarray, most: np.ndarray, item: np.ndarray, users: pa.Table, items: pa.StructArray) -> pa.Table:
        out, at, edges = [], pa.array(item), np.arange(user[0], user[-1] + S.SCORED_USERS + 1, S.SCORED_USERS)
        rows = pa.table({"user_id": users.column("user_id").take(pa.array(user)), "book_id": book, "readers": readers, "most": most, "average": items.field("average").take(at), "signature": items.field("signature").dictionary_encode().take(at)})
        shown = rows.column("average").is_valid().to_numpy()  # of the others, readers count for the most alone
        for begin, low, high in zip(edges, *(np.searchsorted(user, e) for e in (edges[:-1], edges[1:]))):
            if low < high:
                found = S._scored_cell(rows.slice(low, high - low).filter(pa.array(shown[low:high])), users.slice(begin, S.SCORED_USERS))
                score = lambda c: found.column(c).to_numpy()
                total = C.six(score("genre_score") * 0.6 + score("readers") / score("most") * 0.25 + score("average") / 5.0 * 0.15)
                out.append(found.take(pa.array(C.firsts(score("user_id"), self.k, -total, score("book_id")))))
        return pa.concat_tables(out).cast(pa.schema(list(self.COLUMNS.items())))


class _ByAverage(_Chosen):
    """Shown books by average; with BY_READERS, by readers first."""

    SCHEMA = "user_id long, book_id long, readers long, avg_rating double"
    COLUMNS = {"user_id": pa.int64(), "book_id": pa.int64(), "readers": pa.int64(), "avg_rating": pa.float64()}
    LEAST, BY_READERS = 1, False

    def __call__(self, user: np.ndarray, book: np.ndarray, readers: np.ndarray, most: np.ndarray, item: np.ndarray, users: pa.Table, items: pa.StructArray) -> pa.Table:
        shown = items.field("shown").take(pa.array(item)).is_valid().to_numpy(zero_copy_only=False) & (readers >= self.LEAST)
        user, book, readers, item = user[shown], book[shown], readers[shown], item[shown]
        average = items.field("avg_rating").take(pa.array(item)).to_numpy(zero_copy_only=False).astype(float)  # none: NaN, which sorts last
        best = C.firsts(user, self.k, *([-readers] if self.BY_READERS else []), -average, book)
        return pa.table({"user_id": users.column("user_id").take(pa.array(user[best])), "book_id": book[best], "readers": readers[best], "avg_rating": items.field("avg_rating").take(pa.array(item[best]))})


class _ReadMost(_ByAverage):
    """Shown books that two or more have read, by readers, then average."""

    LEAST, BY_READERS = 2, True


def for_you(cat: Catalogue, k: int = LIMIT, weights: DataFrame | None = None, others: DataFrame | None = None) -> DataFrame:
    """0.6 genre weight + 0.25 readers among similar users, of the most of any book + 0.15 average of five.

    Only books that similar users read get the second part. Among all others a user's best are the best by genres and
    average: best_signatures names the genre sets that hold them, and their books are fetched by rank."""
    weights = P.genre_weights(cat) if weights is None else weights
    others = cut(similar_users(cat)) if others is None else others
    tastes = weights.groupBy("user_id").agg(F.collect_list(F.struct("genre_id", "raw")).alias("tastes"), F.max("total").alias("total"))
    users = cut(tastes.join(_gone(cat), "user_id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<long>"))))
    shown = _shown(cat, F.coalesce("avg_rating", F.lit(0.0)).alias("average")).join(S.signed(cat), "book_id")
    books = S.numbered(shown, "signature", _deepest(cat, k), F.desc("average"), F.asc("book_id"))
    n_users = cat.users.count()
    score = lambda part: X.six(F.col("genre_score") * 0.6 + part * 0.25 + F.col("average") / 5.0 * 0.15)
    base = S.best_books(users, books, n_users, S.signed(cat).select("signature").distinct().count(), k, 0.6, 0.15).withColumn("score", score(F.lit(0.0)))
    read = _reads(cat).withColumnRenamed("user_id", "other_id").join(broadcast_if_small(shown), "book_id", "left")
    known = C.read_by_others(users, others, read, n_users, _ForYou(k), _ForYou.SCHEMA)
    return _best_of_both(base, known.withColumn("score", score(F.col("readers") / F.col("most"))), k)


def because_you_liked(cat: Catalogue, k: int = LIMIT) -> DataFrame:
    """Half the Jaccard of genres with the user's anchor, half the readers that they share, of the most of any book.

    By genres alone, anchors of one genre set have one ranking: it is made once for each set, as deep as its users need,
    from signatures in order of similarity. Books that share readers with the anchor are few, and scored exactly."""
    anchors, out, signed = P.anchors(cat), P.excluded(cat), S.signed(cat)
    own = signed.select(F.col("book_id").alias("anchor_id"), F.col("signature").alias("source_signature"))
    asked = _needs(cat, anchors.join(own, "anchor_id"), k + 1)  # the anchor itself is one more
    deepest = asked.groupBy("source_signature").agg(F.max("need").alias("deepest"))
    shown = _shown(cat).join(signed, "book_id")
    books = S.numbered(shown, "signature", _deepest(cat, k + 1), F.asc("book_id")).withColumnRenamed("signature", "target_signature")
    sizes = books.groupBy("target_signature").agg(F.count("*").alias("n"))
    pairs = S.signature_pairs(deepest.select(F.col("source_signature").alias("signature")), sizes.select(F.col("target_signature").alias("signature")), 1)
    levels = pairs.withColumn("score", X.six(F.col("score") * 0.5 + 0.0)).join(sizes, "target_signature").join(deepest, "source_signature")
    tasks = int(cat.spark.conf.get("spark.sql.shuffle.partitions")) if hasattr(cat, "spark") else 1
    levels = levels.repartition(tasks, "source_signature")  # few bytes and many rows
    levels = levels.withColumn("need", F.least(F.col("n"), F.col("deepest") - S.before("score", "n", "source_signature")))
    candidates = S.first_of(levels.select("source_signature", "target_signature", "score", "need"), books, "target_signature")
    place = F.row_number().over(Window.partitionBy("source_signature").orderBy(F.desc("score"), "book_id"))
    ranking = candidates.select("source_signature", "book_id", "score").withColumn("nth", place)
    base = S.first_of(asked, ranking, "source_signature").where("anchor_id <> book_id").join(out, ["user_id", "book_id"], "left_anti")
    reads = _reads(cat)
    nth = F.row_number().over(Window.partitionBy("anchor_id").orderBy("other_id"))
    fans = reads.select(F.col("book_id").alias("anchor_id"), F.col("user_id").alias("other_id")).join(anchors.select("anchor_id").distinct(), "anchor_id", "left_semi")
    fans = fans.withColumn("nth", nth).where(F.col("nth") <= READERS).drop("nth")
    read = reads.select(F.col("book_id").alias("target_id"), F.col("user_id").alias("member"))
    together = C.overlaps(fans.select(F.col("anchor_id").alias("source_id"), F.col("other_id").alias("member")), read, 2, None)
    together = together.select(F.col("source_id").alias("anchor_id"), F.col("target_id").alias("book_id"), F.col("score").alias("readers"))
    shared = anchors.join(together, "anchor_id").join(out, ["user_id", "book_id"], "left_anti").withColumn("most", F.max("readers").over(Window.partitionBy("user_id")))
    known = shared.join(_shown(cat), "book_id", "left_semi").join(own, "anchor_id", "left").join(signed, "book_id", "left")
    a, b = S.genres_of(F.col("source_signature")), S.genres_of(F.col("signature"))
    common = F.size(F.array_intersect(a, b))
    jaccard = F.coalesce(F.when(common > 0, common / (F.size(a) + F.size(b) - common)), F.lit(0.0))
    exact = known.withColumn("score", X.six(jaccard * 0.5 + F.col("readers") / F.col("most") * 0.5))
    return _best_of_both(base, exact, k)


def continue_series(cat: Catalogue, k: int = LIMIT) -> DataFrame:
    """The first k books, by position, of all series in progress. Each series is ranked once for all users; of it a user
    needs k places and one for each of its books that the user has read or given up.

    With m series, the first k / m left of each are k books or more, so none of the first k comes after the last of these."""
    members = cat.books.where("series_id is not null").select("book_id", "series_id")
    gone = F.when(F.col("status").isin("read", "reading", "abandoned"), F.col("book_id"))
    shelved = spread(cat.bookshelves.join(members, "book_id"), cat.bookshelves.count(), "user_id")  # all that follows has a user's rows together
    counted = shelved.groupBy("user_id", "series_id").agg(F.count_if(F.col("status").isin(*X.READ_SHELVES)).alias("read_count"), F.collect_list(gone).alias("gone"))
    totals = broadcast_if_small(members.groupBy("series_id").agg(F.count("*").alias("total")))
    asked = counted.join(totals, "series_id").where("read_count > 0 AND read_count < total").drop("read_count", "total")
    shown = _shown(cat, "series_id", F.col("series_position").alias("score")).where("series_id is not null")
    deepest = (cat.bookshelves.where(gone.isNotNull()).join(members, "book_id").groupBy("user_id", "series_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) + k
    place = F.struct(F.col("score").isNull().alias("last"), F.col("score"), F.col("book_id"))
    places = cut(S.numbered(shown, "series_id", deepest, F.asc_nulls_last("score"), F.asc("book_id")).select("series_id", "nth", place.alias("place")))
    user = Window.partitionBy("user_id")
    part = F.ceil(F.lit(float(k)) / F.count("*").over(user)).cast("int")
    edges = broadcast_if_small(places.select("series_id", F.col("nth").alias("edge_nth"), F.col("place").alias("edge")))
    bounded = asked.withColumn("edge_nth", part + F.size("gone")).join(edges, ["series_id", "edge_nth"], "left")
    short = F.count_if(F.col("edge").isNull()).over(user) > 0  # a series that has no such place bounds nothing
    bounded = bounded.withColumn("upto", F.when(~short, F.max("edge").over(user))).withColumn("need", (F.size("gone") + k).cast("int"))
    packed = places.groupBy("series_id", F.floor((F.col("nth") - 1) / S.PACK).cast("int").alias("pack")).agg(F.min("place").alias("first"), F.collect_list(F.struct("nth", "place")).alias("items"))
    packs = bounded.select("user_id", "series_id", "gone", "upto", "need", F.explode(F.sequence(F.lit(0), F.floor((F.col("need") - 1) / S.PACK).cast("int"))).alias("pack"))
    met = packs.join(broadcast_if_small(packed), ["series_id", "pack"]).where("upto IS NULL OR first <= upto")
    left = F.filter("items", lambda i: (i["nth"] <= F.col("need")) & (F.col("upto").isNull() | (i["place"] <= F.col("upto"))) & ~F.array_contains("gone", i["place"]["book_id"]))
    return ranked(met.select("user_id", F.explode(left).alias("i")).select("user_id", "i.place.book_id", "i.place.score"), k, F.asc_nulls_last("score"))


def from_favorite_authors(cat: Catalogue, k: int = LIMIT) -> DataFrame:
    """Books of authors that the user has read, by average. Authors' books are met by chunks of users."""
    authors = P.authors_read(cat).withColumnRenamed("author_id", "other_id")
    shown = _shown(cat, "avg_rating").withColumn("shown", F.lit(True))
    books = cat.book_authors.withColumnRenamed("author_id", "other_id").join(shown, "book_id")
    users = authors.select("user_id").distinct().join(_gone(cat), "user_id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<long>")))
    found = C.read_by_others(users, authors, books, cat.users.count(), _ByAverage(k), _ByAverage.SCHEMA)
    return ranked(found.withColumn("score", F.col("avg_rating")), k, F.desc_nulls_last("score"))


def _in_genres(cat: Catalogue, top: int, books: DataFrame, k: int, weights: DataFrame | None, *order: Column) -> DataFrame:
    """Books of each user's first genres that the user hasn't read: enough of each genre to hold the user's best k. Each
    genre's books are ranked once for all users, and met in packs where the user's rows are."""
    weights = P.genre_weights(cat) if weights is None else weights
    deepest = _deepest(cat, k)
    best = S.numbered(cat.book_genres.join(books, "book_id"), "genre_id", deepest, *order, F.asc("book_id"))
    item = F.struct("nth", *[c for c in best.columns if c not in ("genre_id", "nth")])
    packed = broadcast_if_small(best.groupBy("genre_id", F.floor((F.col("nth") - 1) / S.PACK).cast("int").alias("pack")).agg(F.collect_list(item).alias("items")))
    first = weights.where(F.col("rank") <= top).select("user_id", "genre_id")
    asked = first.join(_gone(cat), "user_id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<long>"))).withColumn("need", F.size("gone") + k)
    each = (_gone(cat).agg(F.sum(F.size("gone"))).first()[0] or 0) // max(1, cat.users.count()) + k
    asked = spread(asked, cat.users.count() * top * each, "user_id")
    packs = asked.withColumn("pack", F.explode(F.sequence(F.lit(0), F.floor((F.col("need") - 1) / S.PACK).cast("int"))))
    left = F.filter("items", lambda i: (i["nth"] <= F.col("need")) & ~F.array_contains("gone", i["book_id"]))
    return packs.join(packed, ["genre_id", "pack"]).select("user_id", F.explode(left).alias("i")).select("user_id", "i.*").drop("nth").distinct()


def top_in_genre(cat: Catalogue, k: int = LIMIT, weights: DataFrame | None = None) -> DataFrame:
    books = _shown(cat, F.col("avg_rating").alias("score"), "rating_count").where("score is not null")
    order = (F.desc("score"), F.desc("rating_count"))
    return ranked(_in_genres(cat, 1, books, k, weights, *order), k, *order)


def want_to_read_picks(cat: Catalogue, k: int = LIMIT) -> DataFrame:
    wanted = cat.bookshelves.where("status = 'want_to_read'").select("user_id", "book_id")
    return ranked(wanted.join(_shown(cat, F.col("avg_rating").alias("score"), "ol_already_read_count"), "book_id"), k, F.desc_nulls_last("score"), F.desc("ol_already_read_count"))


def readers_like_you(cat: Catalogue, k: int = LIMIT, others: DataFrame | None = None) -> DataFrame:
    others = cut(similar_users(cat)) if others is None else others
    shown = broadcast_if_small(_shown(cat, "avg_rating").withColumn("shown", F.lit(True)))
    read = _reads(cat).withColumnRenamed("user_id", "other_id").join(shown, "book_id", "left")
    found = C.read_by_others(_gone(cat), others, read, cat.users.count(), _ReadMost(k), _ReadMost.SCHEMA)
    return ranked(found.withColumn("score", F.col("readers")), k, F.desc("score"), F.desc_nulls_last("avg_rating"))


def hidden_gems(cat: Catalogue, k: int = LIMIT, weights: DataFrame | None = None) -> DataFrame:
    rare = F.col("rating_count").between(3, 20) & (F.col("avg_rating") >= 4.0) & (F.col("view_count") < 500)
    books = cat.books.where(X.listable() & rare).select("book_id", F.col("avg_rating").alias("score"), "rating_count")
    order = (F.desc("score"), F.desc("rating_count"))
    return ranked(_in_genres(cat, P.TOP_GENRES, books, k, weights, *order), k, *order)


def you_might_like(cat: Catalogue, book_id: int, k: int = LIMIT) -> DataFrame:
    """For each user, books that share genres with one book, by the user's weight of these genres.

    Books sharing the same of its genres score alike, so each such part of the set is scored once for a user, and parts
    are opened from the best on until the user's need is met."""
    genres = cat.book_genres.where(F.col("book_id") == book_id).select("genre_id")
    tagged = cat.book_genres.where(F.col("book_id") != book_id).join(genres, "genre_id", "left_semi")
    parts = tagged.groupBy("book_id").agg(F.array_join(F.array_sort(F.collect_set("genre_id")), "|").alias("part"))
    order = (F.desc_nulls_last("avg_rating"), F.asc("book_id"))
    books = S.numbered(parts.join(_shown(cat, "avg_rating"), "book_id"), "part", _deepest(cat, k), *order)
    sizes = books.groupBy("part").agg(F.count("*").alias("n"))
    weights = P.genre_weights(cat).join(genres, "genre_id", "left_semi").select("user_id", "genre_id", "raw", "total")
    liked = weights.join(sizes.select("part", "n", F.explode(S.genres_of(F.col("part"))).alias("genre_id")), "genre_id")
    scored = liked.groupBy("user_id", "part", "n").agg(X.six(F.sum("raw") / F.max("total")).alias("score"))
    asked = _needs(cat, scored, k).withColumn("need", F.least(F.col("n"), F.col("need") - S.before("score", "n", "user_id")))
    left = S.first_of(asked, books, "part").join(P.excluded(cat), ["user_id", "book_id"], "left_anti")
    return ranked(left, k, F.desc("score"), F.desc_nulls_last("avg_rating"))


def unread_by_author(cat: Catalogue, author_id: int, user_id: int, k: int = LIMIT) -> DataFrame:
    """The author's books that are on none of one user's shelves."""
    theirs = cat.book_authors.where(F.col("author_id") == author_id).select("book_id").join(_shown(cat, F.col("avg_rating").alias("score")), "book_id")
    shelved = cat.bookshelves.where((F.col("user_id") == user_id) & F.col("status").isin("read", "reading", "abandoned", "want_to_read"))
    left = theirs.join(shelved.select("book_id"), "book_id", "left_anti").withColumn("user_id", F.lit(user_id).cast("long"))
    return ranked(left, k, F.desc_nulls_last("score"))


SECTIONS = {
    "for_you": for_you,
    "because_you_liked": because_you_liked,
    "continue_series": continue_series,
    "from_favorite_authors": from_favorite_authors,
    "top_in_genre": top_in_genre,
    "want_to_read_picks": want_to_read_picks,
    "readers_like_you": readers_like_you,
    "hidden_gems": hidden_gems,
}


def home(cat: Catalogue, k: int = LIMIT) -> DataFrame:
    """All sections of all users with enough books: (section, user_id, rank, book_id, score). Weights and similar users
    are found once for all sections that go by them."""
    weights, others = cut(P.genre_weights(cat)), cut(similar_users(cat))
    shared = {"for_you": {"weights": weights, "others": others}, "top_in_genre": {"weights": weights}, "readers_like_you": {"others": others}, "hidden_gems": {"weights": weights}}
    warm = P.active_users(cat)
    parts = [build(cat, k, **shared.get(key, {})).select(F.lit(key).alias("section"), "user_id", "rank", "book_id", "score") for key, build in SECTIONS.items()]
    return reduce(DataFrame.unionByName, parts).join(warm, "user_id", "left_semi")
