"""Contextual similarity between books, authors and series, for all sources at once.

Genre similarity needs only sets of genres: books with the same set are one signature, signatures are compared, and
their books are ranked per source. Co-reading goes through shelves: a self-join on the reader, counted per pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions import expressions as X
from shelfspark.operators import signatures as S
from shelfspark.operators.common import SMALL_ROWS, broadcast_if_small, cut
from shelfspark.operators.overlap import top_overlaps
from shelfspark.sources.catalogue import Catalogue

TOP = 20
CANDIDATES = 500
READERS = 500
LEAST_RATINGS = 50
SOURCE_RATINGS = 500


def ranked(pairs: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k targets of each source: source_id, rank, target_id, score."""
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy(*order, "target_id"))
    return pairs.withColumn("rank", nth).where(F.col("rank") <= k).select("source_id", "rank", "target_id", X.six(F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("score"))


def eligible_books(cat: Catalogue, least: int = SOURCE_RATINGS) -> DataFrame:
    return cat.books.where(X.listable() & (X.total_ratings() >= least)).select(F.col("book_id").alias("source_id"))


def eligible_authors(cat: Catalogue, least: int = SOURCE_RATINGS) -> DataFrame:
    rated = cat.book_authors.join(cat.books.where("language = 'en'").select("book_id", X.total_ratings().alias("n")), "book_id")
    return rated.groupBy(F.col("author_id").alias("source_id")).agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("source_id")


def eligible_series(cat: Catalogue, least: int = SOURCE_RATINGS) -> DataFrame:
    return cat.books.where((X.total_ratings() >= least) & F.col("series_id").isNotNull() & (F.col("language") == "en")).select(F.col("series_id").alias("source_id")).distinct()


def more_by_author(cat: Catalogue, k: int = TOP, sources: DataFrame | None = None) -> DataFrame:
    """Books that share an author with an eligible book, by average. Here and below, sources (source_id) are asked for
    in place of all eligible ones."""
    sources = cat.book_authors.join(eligible_books(cat) if sources is None else sources, F.col("book_id") == F.col("source_id")).select("source_id", "author_id")
    targets = cat.book_authors.withColumnRenamed("book_id", "target_id")
    pairs = sources.join(targets, "author_id").where("source_id <> target_id").select("source_id", "target_id").distinct()
    shown = cat.books.where(X.listable()).select(F.col("book_id").alias("target_id"), F.col("avg_rating").alias("score"))
    return ranked(pairs.join(shown, "target_id"), k, F.desc_nulls_last("score"))


def more_from_series(cat: Catalogue, k: int = TOP, sources: DataFrame | None = None) -> DataFrame:
    """Other books of an eligible book's series, by position.

    A series has one ranking for all its books: its first k + 1 books hold the first k of each, which follow from the
    places there, without a ranking of each book's own."""
    sources = cat.books.join(eligible_books(cat) if sources is None else sources, F.col("book_id") == F.col("source_id")).where("series_id is not null").select("source_id", "series_id")
    shown = cat.books.where(X.listable()).select(F.col("book_id").alias("target_id"), "series_id", F.col("series_position").alias("score")).where("series_id is not null")
    places = S.numbered(shown, "series_id", k + 1, F.asc_nulls_last("score"), F.asc("target_id"))
    heads = broadcast_if_small(places.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("nth", "target_id", "score"))).alias("head")))
    place = F.array_position("head.target_id", F.col("source_id"))  # 0: not among them
    found = sources.join(heads, "series_id").select("source_id", place.alias("place"), F.explode("head").alias("t")).where("source_id <> t.target_id")
    rank = (F.col("t.nth") - F.when((F.col("place") > 0) & (F.col("place") < F.col("t.nth")), 1).otherwise(0)).cast("int")
    return found.select("source_id", rank.alias("rank"), "t.target_id", X.six(F.coalesce(F.col("t.score").cast("double"), F.lit(0.0))).alias("score")).where(F.col("rank") <= k)


def similar_by_genre(cat: Catalogue, k: int = TOP) -> DataFrame:
    """English books by Jaccard of genres, among the first CANDIDATES by genres shared.

    All sources of one signature have the same candidates but for themselves, so two short rankings for each signature
    answer for all its books: of the first CANDIDATES, for books that aren't among them, and of one more candidate."""
    signed = S.signed(cat)
    sources = signed.join(eligible_books(cat), F.col("book_id") == F.col("source_id")).select("source_id", F.col("signature").alias("source_signature"))
    rated = cat.books.where((F.col("language") == "en") & (X.total_ratings() >= LEAST_RATINGS)).select(F.col("book_id").alias("target_id"), "rating_count", X.listable().alias("shown"))
    targets = rated.join(signed.select(F.col("book_id").alias("target_id"), F.col("signature").alias("target_signature")), "target_id")
    books = cut(S.numbered(targets, "target_signature", CANDIDATES + 1, F.asc("target_id")))
    sizes = books.groupBy("target_signature").agg(F.count("*").alias("held"))
    pairs = S.signature_pairs(sources.select(F.col("source_signature").alias("signature")), sizes.select(F.col("target_signature").alias("signature")))
    levels = pairs.join(sizes, "target_signature").withColumn("need", F.least(F.col("held"), F.lit(CANDIDATES + 1) - S.before("shared", "held", "source_signature")))
    found = S.first_of(levels, books, "target_signature").drop("nth", "need", "held")
    per_signature = F.row_number().over(Window.partitionBy("source_signature").orderBy(F.desc("shared"), "target_id"))
    candidates = cut(found.withColumn("nth", per_signature).where(F.col("nth") <= CANDIDATES + 1))  # three joins go through them
    among = sources.join(candidates.where(F.col("nth") <= CANDIDATES).select("source_signature", F.col("target_id").alias("source_id"), F.lit(True).alias("among")), ["source_signature", "source_id"], "left")
    best = Window.partitionBy("source_signature").orderBy(F.desc_nulls_last("score"), F.desc_nulls_last("rating_count"), "target_id")
    first = lambda n, most, among: candidates.where(F.col("shown") & (F.col("nth") <= n)).withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).withColumn("with_self", F.lit(among))
    short = first(CANDIDATES, k, False).unionByName(first(CANDIDATES + 1, k + 1, True))
    own = among.withColumn("with_self", F.coalesce("among", F.lit(False))).join(short, ["source_signature", "with_self"]).where("source_id <> target_id")
    return ranked(own, k, F.desc_nulls_last("score"), F.desc_nulls_last("rating_count"))


def _read_together(sources: DataFrame, targets: DataFrame, least: int = 3, same: bool = True, most: int = CANDIDATES) -> DataFrame:
    """(source_id, target_id, score): how many of the readers of a source, the first READERS by id, also read a target; of
    each source the first CANDIDATES targets.

    sources: (source_id, user_id); targets: (target_id, user_id); both distinct."""
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy("user_id"))
    some = sources.withColumn("nth", nth).where(F.col("nth") <= READERS).select("source_id", F.col("user_id").alias("member"))
    return top_overlaps(some, targets.select("target_id", F.col("user_id").alias("member")), least, most, same=same)


def _reads(cat: Catalogue) -> DataFrame:
    return cat.bookshelves.where(F.col("status").isin(*X.READ_SHELVES)).select("user_id", "book_id")


def readers_also_enjoyed(cat: Catalogue, k: int = TOP) -> DataFrame:
    reads = _reads(cat)
    sources = reads.join(eligible_books(cat), F.col("book_id") == F.col("source_id")).select("source_id", "user_id")
    pairs = _read_together(sources, reads.withColumnRenamed("book_id", "target_id"))
    shown = cat.books.where(X.listable() & (X.total_ratings() >= LEAST_RATINGS)).select(F.col("book_id").alias("target_id"), "avg_rating")
    return ranked(pairs.join(shown, "target_id"), k, F.desc("score"), F.desc_nulls_last("avg_rating"))


def _author_books(cat: Catalogue) -> DataFrame:
    english = cat.books.where("language = 'en'").select("book_id")
    return cat.book_authors.join(english, "book_id").groupBy(F.col("author_id").alias("target_id")).agg(F.count("*").alias("book_count"))


def authors_by_genre(cat: Catalogue, k: int = TOP, sources: DataFrame | None = None) -> DataFrame:
    """Authors by Jaccard of genre sets; what is shared counts the candidate's English books only.

    As in similar_by_genre, sources of one set of genres have two short rankings together: of the first CANDIDATES, for
    those who aren't among them, and of one more candidate."""
    linked = cat.book_authors.join(cat.book_genres, "book_id")
    every = linked.select("author_id", "genre_id").distinct()
    english = linked.join(cat.books.where("language = 'en'").select("book_id"), "book_id", "left_semi").select(F.col("author_id").alias("target_id"), "genre_id").distinct()
    sizes = every.groupBy(F.col("author_id").alias("target_id")).agg(F.count("*").alias("m"))
    genres = F.array_sort(F.collect_set("genre_id")).alias("genres")
    asked = cut(every.join(eligible_authors(cat) if sources is None else sources, F.col("author_id") == F.col("source_id")).groupBy("source_id").agg(genres))
    sets = cut(asked.select("genres").distinct().withColumn("set", F.monotonically_increasing_id()))  # numbers hold as they are written
    shared = S.top_shared(sets.select(F.col("set").alias("source_id"), "genres"), cut(english.groupBy("target_id").agg(genres)), 2, CANDIDATES + 1, same=False).withColumnRenamed("source_id", "set")
    n, m = broadcast_if_small(sets.select("set", F.size("genres").alias("n"))), broadcast_if_small(sizes.join(_author_books(cat), "target_id", "left"), 10 * SMALL_ROWS)
    score = F.try_divide(F.col("shared").cast("double"), (F.col("n") + F.col("m") - F.col("shared")).cast("double"))
    candidates = cut(shared.join(n, "set").join(m, "target_id").select("set", "target_id", "nth", score.alias("score"), "book_count"))
    best = Window.partitionBy("set").orderBy(F.desc_nulls_last("score"), F.desc_nulls_last("book_count"), "target_id")
    first = lambda n, most, among: candidates.where(F.col("nth") <= n).withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).withColumn("among", F.lit(among)).drop("nth", "place")
    short = first(CANDIDATES, k, False).unionByName(first(CANDIDATES + 1, k + 1, True))
    placed = candidates.where(F.col("nth") <= CANDIDATES).select("set", F.col("target_id").alias("source_id"), F.lit(True).alias("among"))
    own = asked.join(sets, "genres").select("source_id", "set").join(placed, ["set", "source_id"], "left").withColumn("among", F.coalesce("among", F.lit(False)))
    return ranked(own.join(short, ["set", "among"]).where("source_id <> target_id"), k, F.desc_nulls_last("score"), F.desc_nulls_last("book_count"))


def fans_also_read(cat: Catalogue, k: int = TOP) -> DataFrame:
    reads = _reads(cat).join(cat.book_authors, "book_id").select("author_id", "user_id").distinct()
    sources = reads.join(eligible_authors(cat), F.col("author_id") == F.col("source_id")).select("source_id", "user_id")
    pairs = _read_together(sources, reads.withColumnRenamed("author_id", "target_id"))
    return ranked(pairs.join(_author_books(cat), "target_id", "left"), k, F.desc("score"), F.desc_nulls_last("book_count"))


def _series_of(cat: Catalogue) -> DataFrame:
    return cat.books.where("series_id is not null").select("book_id", "series_id")


def series_more_by_author(cat: Catalogue, k: int = TOP, sources: DataFrame | None = None) -> DataFrame:
    """Books outside the series by its authors, by average."""
    writers = _series_of(cat).join(cat.book_authors, "book_id").select(F.col("series_id").alias("source_id"), "author_id").distinct().join(eligible_series(cat) if sources is None else sources, "source_id")
    pairs = writers.join(cat.book_authors.withColumnRenamed("book_id", "target_id"), "author_id").select("source_id", "target_id").distinct()
    shown = cat.books.where(X.listable()).select(F.col("book_id").alias("target_id"), F.col("avg_rating").alias("score"), "series_id")
    return ranked(pairs.join(shown, "target_id").where(~F.col("series_id").eqNullSafe(F.col("source_id"))), k, F.desc_nulls_last("score"))


def series_by_genre(cat: Catalogue, k: int = TOP) -> DataFrame:
    """Books outside the series by Jaccard of their genres and all genres of the series: signatures are compared with
    series, and only their first books are fetched, as many as a series may have among its candidates and one for each
    of its own."""
    members = _series_of(cat)
    own = members.join(cat.book_genres, "book_id").select(F.col("series_id").alias("source_id"), "genre_id").distinct().join(eligible_series(cat), "source_id")
    sizes = own.groupBy("source_id").agg(F.count("*").alias("n")).join(members.groupBy(F.col("series_id").alias("source_id")).agg(F.count("*").alias("members")), "source_id")
    rated = cat.books.where((F.col("language") == "en") & (X.total_ratings() >= LEAST_RATINGS)).select(F.col("book_id").alias("target_id"), "series_id", "rating_count", X.listable().alias("shown"))
    targets = rated.join(S.signed(cat).withColumnRenamed("book_id", "target_id"), "target_id")
    deepest = (sizes.agg(F.max("members")).first()[0] or 0) + CANDIDATES
    books = S.numbered(targets, "signature", deepest, F.asc("target_id"))
    held = books.groupBy("signature").agg(F.count("*").alias("held"))
    tagged = held.select("signature", "held", F.size(S.genres_of(F.col("signature"))).alias("m"), F.explode(S.genres_of(F.col("signature"))).alias("genre_id"))
    shared = own.join(tagged, "genre_id").groupBy("source_id", "signature", "held", "m").agg(F.count("*").alias("shared")).where("shared >= 2").join(sizes, "source_id")
    asked = shared.withColumn("need", F.least(F.col("held"), F.col("members") + CANDIDATES - S.before("shared", "held", "source_id")))
    found = S.first_of(asked, books, "signature").drop("nth").where(~F.col("series_id").eqNullSafe(F.col("source_id")))
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("shared"), "target_id"))
    scored = found.withColumn("nth", nth).where((F.col("nth") <= CANDIDATES)).where("shown").withColumn("score", F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")))
    return ranked(scored, k, F.desc_nulls_last("score"), F.desc_nulls_last("rating_count"))


def series_readers_also_enjoyed(cat: Catalogue, k: int = TOP) -> DataFrame:
    reads = _reads(cat)
    sources = reads.join(_series_of(cat), "book_id").select(F.col("series_id").alias("source_id"), "user_id").distinct().join(eligible_series(cat), "source_id")
    outside = cat.books.select(F.col("book_id").alias("target_id"), "series_id", "avg_rating", (X.listable() & (X.total_ratings() >= LEAST_RATINGS)).alias("shown"))
    # A series' own books are no candidates, and may be many: so as many more are asked for.
    own = cat.books.where("series_id IS NOT NULL").groupBy("series_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    pairs = _read_together(sources, reads.withColumnRenamed("book_id", "target_id"), same=False, most=CANDIDATES + own)
    pairs = pairs.join(outside, "target_id").where(~F.col("series_id").eqNullSafe(F.col("source_id")))
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), "target_id"))
    return ranked(pairs.withColumn("nth", nth).where(F.col("nth") <= CANDIDATES).where("shown"), k, F.desc("score"), F.desc_nulls_last("avg_rating"))


#: Sections by kind of entity, in the order in which pages show them.
SECTIONS = {
    "book": {"more_by_author": more_by_author, "more_from_series": more_from_series, "similar_by_genre": similar_by_genre, "readers_also_enjoyed": readers_also_enjoyed},
    "author": {"similar_by_genre": authors_by_genre, "fans_also_read": fans_also_read},
    "series": {"more_by_author": series_more_by_author, "similar_by_genre": series_by_genre, "readers_also_enjoyed": series_readers_also_enjoyed},
}


def precompute(cat: Catalogue, k: int = TOP) -> DataFrame:
    """(entity_type, entity_id, section_key, similar_ids) of all eligible entities; sections without targets have no row."""
    parts = []
    for kind, sections in SECTIONS.items():
        for key, build in sections.items():
            parts.append(_listed(build(cat, k), kind, key))
    return reduce(DataFrame.unionByName, parts)


#: Sections that are built at once for an entity without precomputed ones.
COLD = {"book": {"more_by_author": more_by_author, "more_from_series": more_from_series}, "author": {"similar_authors": authors_by_genre}, "series": {"more_by_author": series_more_by_author}}


def _listed(found: DataFrame, kind: str, key: str) -> DataFrame:
    rows = found.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("rank", "target_id"))).alias("found"))
    return rows.select(F.lit(kind).alias("entity_type"), F.col("source_id").cast("string").alias("entity_id"), F.lit(key).alias("section_key"), F.col("found.target_id").alias("similar_ids"))


def cold_sections(cat: Catalogue, asked: DataFrame, precomputed: DataFrame, k: int = TOP) -> DataFrame:
    """(entity_type, entity_id, section_key, similar_ids) of the entities asked for (entity_type, entity_id) that have no
    precomputed section: the few sections that don't depend on readers."""
    cold = asked.select("entity_type", "entity_id").distinct().join(precomputed.select("entity_type", "entity_id"), ["entity_type", "entity_id"], "left_anti")
    parts = []
    for kind, sections in COLD.items():
        ids = cold.where(F.col("entity_type") == kind).select(F.col("entity_id").alias("source_id") if kind == "series" else F.col("entity_id").try_cast("long").alias("source_id"))
        parts += [_listed(build(cat, k, ids), kind, key) for key, build in sections.items()]
    return reduce(DataFrame.unionByName, parts)


def read_sections(cat: Catalogue, sections: DataFrame, k: int = TOP) -> DataFrame:
    """(entity_type, entity_id, section_key, rank, target_id, title, slug): the first k targets of sections, named, in
    the order in which they are listed; targets that no longer are in the catalogue are left out."""
    listed = sections.select("entity_type", "entity_id", "section_key", F.posexplode(F.slice("similar_ids", 1, k)).alias("pos", "target_id"))
    named = cat.books.select(F.lit(False).alias("person"), F.col("book_id").alias("target_id"), "title", "slug").unionByName(cat.authors.select(F.lit(True).alias("person"), F.col("author_id").alias("target_id"), F.col("name").alias("title"), "slug"))
    found = listed.withColumn("person", F.col("entity_type") == "author").join(named, ["person", "target_id"])
    return found.select("entity_type", "entity_id", "section_key", (F.col("pos") + 1).alias("rank"), "target_id", "title", "slug")
