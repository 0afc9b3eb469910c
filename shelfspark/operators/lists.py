"""Ranked lists of books and authors.

A list filters, takes the top k by its own score (ties by id), and only then looks up authors and readers of those k.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import expressions as X
from shelfspark.operators import similar
from shelfspark.sources.catalogue import Catalogue, once
from shelfspark.sources.versions import Files

SIZE = 50
#: The lists of the home page.
HOME_BOOKS = ("most_read", "most_wanted", "trending_reads", "most_viewed", "highest_rated", "community_top_rated", "most_rated", "recently_added", "classics", "user_favorites")
HOME_AUTHORS = ("top_authors", "popular_authors")


def decorated(cat: Catalogue, top: DataFrame) -> DataFrame:
    """Book items of rows of the book table with a score and any other columns of their own (kept as prefix)."""
    items = top.join(cat.author_names, "book_id", "left").join(cat.app_readers, "book_id", "left")
    return items.withColumn("readers", X.library_readers() + F.coalesce("app_readers", F.lit(0)))


def item_columns() -> list[Column | str]:
    return [
        "book_id",
        "title",
        "slug",
        "language",
        F.coalesce("primary_cover_url", F.lit("")).alias("cover_url"),
        X.six(X.combined_rating()).alias("avg_rating"),
        X.total_ratings().cast("long").alias("rating_count"),
        F.coalesce("author_names", F.lit("")).alias("author_names"),
        F.coalesce("author_slugs", F.lit("")).alias("author_slugs"),
        F.col("readers").cast("long").alias("readers"),
        X.six(F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("score"),
    ]


def book_list(cat: Catalogue, books: DataFrame, score: Column, k: int = SIZE, then: tuple[Column, ...] = ()) -> DataFrame:
    """The k listable books with the highest score; a null score counts as lowest."""
    top = books.where(X.listable()).withColumn("score", score).orderBy(F.desc_nulls_last("score"), *then, "book_id").limit(k)
    return decorated(cat, top).select(*item_columns())


def by_counter(cat: Catalogue, column: str, k: int = SIZE) -> DataFrame:
    return book_list(cat, cat.books, F.col(column), k)


def highest_rated(cat: Catalogue, k: int = SIZE, least: int = 3) -> DataFrame:
    return book_list(cat, cat.books.where(X.total_ratings() >= least), X.combined_rating(), k)


def community_top_rated(cat: Catalogue, k: int = SIZE, least: int = 20) -> DataFrame:
    return book_list(cat, cat.books.where(F.col("ol_rating_count") >= least), F.col("ol_avg_rating"), k)


def most_rated(cat: Catalogue, k: int = SIZE) -> DataFrame:
    return book_list(cat, cat.books, X.total_ratings(), k)


def recently_added(cat: Catalogue, k: int = SIZE) -> DataFrame:
    return book_list(cat, cat.books, F.unix_micros(F.col("created_at").cast("timestamp")) / F.lit(1e6), k)


def classics(cat: Catalogue, k: int = SIZE, before: int = 1980) -> DataFrame:
    old = cat.books.where((F.col("original_publication_year") < before) & ((F.col("ol_already_read_count") >= 100) | (F.col("avg_rating") >= 4.0)))
    return book_list(cat, old, F.col("ol_already_read_count"), k, (F.desc_nulls_last("avg_rating"),))


def shelved(cat: Catalogue, condition: Column, score: Column, k: int = SIZE, compat: bool = False) -> DataFrame:
    """Books by their shelf rows that meet a condition. compat counts each row once for each author, as a count after
    joining authors does."""
    scored = cat.bookshelves.where(condition).groupBy("book_id").agg(score.alias("shelf_score"))
    books = cat.books.join(scored, "book_id")
    if not compat:
        return book_list(cat, books, F.col("shelf_score"), k)
    authors = cat.book_authors.groupBy("book_id").agg(F.count("*").alias("authors"))
    return book_list(cat, books.join(authors, "book_id", "left"), F.col("shelf_score") * F.greatest(F.coalesce("authors", F.lit(0)), F.lit(1)), k)


def user_favorites(cat: Catalogue, k: int = SIZE, compat: bool = False) -> DataFrame:
    return shelved(cat, F.col("is_favorite"), F.count("*"), k, compat)


def recently_finished(cat: Catalogue, k: int = SIZE) -> DataFrame:
    return shelved(cat, F.col("status") == "read", F.unix_micros(F.max(F.col("updated_at").cast("timestamp"))) / F.lit(1e6), k)


def currently_reading(cat: Catalogue, k: int = SIZE, compat: bool = False) -> DataFrame:
    return shelved(cat, F.col("status") == "reading", F.count("*"), k, compat)


def dimension_sums(cat: Catalogue) -> DataFrame:
    """(book_id, and of each dimension its ratings and twice their sum), from one pass for all lists."""
    sums = [f for d in X.DIMENSIONS for f in (F.count(d).alias(f"{d}_n"), F.sum(F.col(d) * 2).cast("long").alias(f"{d}_halves"))]
    return once(cat, "dimension_sums", lambda: cat.ratings.groupBy("book_id").agg(*sums))


def best_dimension(cat: Catalogue, dimension: str, k: int = SIZE, least: int = 3) -> DataFrame:
    stats = dimension_sums(cat).select("book_id", F.col(f"{dimension}_n").alias("n"), F.col(f"{dimension}_halves").alias("halves"))
    stats = stats.where(F.col("n") >= least).select("book_id", X.average_of_halves(F.col("halves"), F.col("n")).alias("dimension_avg"))
    return book_list(cat, cat.books.join(stats, "book_id"), F.col("dimension_avg"), k)


def author_rollup(cat: Catalogue, links: DataFrame | None = None) -> DataFrame:
    """Per author with a link: number of English books, average rating, readers, ratings, and reads of those books."""
    links = cat.book_authors if links is None else links
    english = cat.books.where("language = 'en'").select("book_id", X.rating_points().alias("points"), X.total_ratings().alias("n"), X.library_readers().alias("library"), "ol_already_read_count")
    per = links.join(english.join(cat.app_readers, "book_id", "left"), "book_id", "left").groupBy("author_id").agg(
        F.count("n").alias("book_count"),
        F.sum("points").alias("points"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rating_count"),
        (F.coalesce(F.sum("library"), F.lit(0)) + F.coalesce(F.sum("app_readers"), F.lit(0))).alias("readers"),
        F.coalesce(F.sum("ol_already_read_count"), F.lit(0)).alias("already_read"),
    )
    return per.withColumn("avg_rating", F.coalesce(F.try_divide(F.col("points"), F.col("rating_count").cast("double")), F.lit(0.0))).drop("points")


def author_items(cat: Catalogue, authors: DataFrame) -> DataFrame:
    return authors.select(
        "author_id",
        "name",
        "slug",
        F.coalesce("photo_url", F.lit("")).alias("photo_url"),
        F.coalesce("book_count", F.lit(0)).cast("long").alias("book_count"),
        X.six(F.coalesce("avg_rating", F.lit(0.0))).alias("avg_rating"),
        F.coalesce("rating_count", F.lit(0)).cast("long").alias("rating_count"),
        F.coalesce("readers", F.lit(0)).cast("long").alias("readers"),
        X.six(F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("score"),
    )


def top_authors(cat: Catalogue, k: int = SIZE) -> DataFrame:
    """Authors with books by reads of these."""
    ranked = cat.authors.join(author_rollup(cat), "author_id").withColumn("score", F.col("already_read"))
    return author_items(cat, ranked.orderBy(F.desc("score"), "author_id").limit(k))


def popular_authors(cat: Catalogue, k: int = SIZE) -> DataFrame:
    """All authors by views of their own page; the rollup is made for the k that are shown."""
    top = cat.authors.withColumn("score", F.col("view_count")).orderBy(F.desc("score"), "author_id").limit(k)
    links = cat.book_authors.join(top.select("author_id"), "author_id", "left_semi")
    return author_items(cat, top.join(author_rollup(cat, links), "author_id", "left"))


#: Every list: key, whether it holds books or authors, and how it is built.
LISTS: dict[str, tuple[str, Callable[..., DataFrame]]] = {
    "most_read": ("book", partial(by_counter, column="ol_already_read_count")),
    "most_wanted": ("book", partial(by_counter, column="ol_want_to_read_count")),
    "trending_reads": ("book", partial(by_counter, column="ol_currently_reading_count")),
    "most_viewed": ("book", partial(by_counter, column="view_count")),
    "highest_rated": ("book", highest_rated),
    "community_top_rated": ("book", community_top_rated),
    "most_rated": ("book", most_rated),
    "recently_added": ("book", recently_added),
    "classics": ("book", classics),
    "user_favorites": ("book", user_favorites),
    "recently_finished": ("book", recently_finished),
    "currently_reading": ("book", currently_reading),
    "best_writing": ("book", partial(best_dimension, dimension="writing_quality")),
    "most_emotional": ("book", partial(best_dimension, dimension="emotional_impact")),
    "funniest": ("book", partial(best_dimension, dimension="humor")),
    "most_thought_provoking": ("book", partial(best_dimension, dimension="intellectual_depth")),
    "most_rereadable": ("book", partial(best_dimension, dimension="rereadability")),
    "top_authors": ("author", top_authors),
    "popular_authors": ("author", popular_authors),
}


def build_all(cat: Catalogue, root: str, k: int = SIZE, now: str = "1970-01-01 00:00:00", keys: tuple[str, ...] | None = None, builders: dict[str, Callable[..., DataFrame]] | None = None) -> dict[str, str | None]:
    """Writes every list as a snapshot under root; a list that fails doesn't keep the others from being built. Gives the
    error of each, None for those written. builders: what builds some lists in place of LISTS."""
    failed: dict[str, str | None] = {}
    for key in keys or tuple(LISTS):
        try:
            build = (builders or {}).get(key) or LISTS[key][1]
            build(cat, k=k).withColumn("built_at", F.lit(now).cast("timestamp")).write.mode("overwrite").parquet(f"{root}/list={key}")
            failed[key] = None
        except Exception as e:  # isolation is the feature
            failed[key] = str(e).splitlines()[0]
    return failed


class Refresh:
    """All lists of a catalogue under one root, refreshed as a whole. A run writes its lists into a folder of its own; a
    manifest that comes last names, for each list, the run whose folder holds it: this one, or for a list that failed the
    one before. Readers of a manifest never see half a run."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def manifest(self) -> dict:
        """{run, lists: {list: run}, errors: {list: error}} of the last run that is whole."""
        names = [n for n in self.files.names() if n.startswith("lists-")]
        return json.loads(self.files.text(names[-1])) if names else {"run": 0, "lists": {}, "errors": {}}

    def run(self, cat: Catalogue, k: int = SIZE, now: str = "1970-01-01 00:00:00", keys: tuple[str, ...] | None = None, builders: dict[str, Callable[..., DataFrame]] | None = None) -> dict:
        """Builds all lists and then the sections of the books and authors on them that hang on no reader. What an earlier,
        broken off run has left under the same number is written over."""
        last = self.manifest()
        number = last["run"] + 1
        errors = {key: e for key, e in build_all(cat, f"{self.root}/run={number}", k, now, keys, builders).items() if e is not None}
        wanted = keys or tuple(LISTS)
        lists = last["lists"] | {key: number for key in wanted if key not in errors}
        ids = [self._read(key, at).select(F.lit(LISTS[key][0]).alias("entity_type"), F.col(f"{LISTS[key][0]}_id").cast("string").alias("entity_id")) for key, at in lists.items()]
        if ids:
            listed = reduce(DataFrame.unionByName, ids).distinct()
            similar.cold_sections(cat, listed, listed.limit(0)).write.mode("overwrite").parquet(f"{self.root}/run={number}/sections")
        self.files.put(f"lists-{number:09}.json", json.dumps({"run": number, "lists": lists, "errors": errors}))
        return self.manifest()

    def _read(self, key: str, run: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/run={run}/list={key}")

    def read(self, key: str) -> DataFrame | None:
        """A list as its last run that didn't fail has left it."""
        run = self.manifest()["lists"].get(key)
        return None if run is None else self._read(key, run)

    def sections(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/run={self.manifest()['run']}/sections")

    def status(self) -> DataFrame:
        """(list, version, rows, error) of every list: the run that it comes from, and why the last one failed."""
        now = self.manifest()
        none = F.lit(None).cast("string")
        parts = [self._read(key, run).agg(F.count("*").alias("rows")).select(F.lit(key).alias("list"), F.lit(run).alias("version"), "rows", F.lit(now["errors"][key]).alias("error") if key in now["errors"] else none.alias("error")) for key, run in now["lists"].items()]
        parts += [self.spark.createDataFrame([(key, None, 0, e)], "list string, version int, rows long, error string") for key, e in now["errors"].items() if key not in now["lists"]]
        return reduce(DataFrame.unionByName, parts)


def page(items: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of a list, with the list's whole length as total."""
    total = items.count()
    return items.orderBy(F.desc("score"), items.columns[0]).offset(offset).limit(limit).withColumn("total", F.lit(total).cast("long"))


def home_page(cat: Catalogue, limit: int = 10) -> DataFrame:
    """The first items of each of the home page's lists, as (category, position, id, title, score)."""
    parts = []
    for key in HOME_BOOKS + HOME_AUTHORS:
        kind, build = LISTS[key]
        items = build(cat, k=limit)
        named = items.select(F.lit(key).alias("category"), F.col(f"{kind}_id").alias("item_id"), F.col("title" if kind == "book" else "name").alias("title"), "score")
        parts.append(named)
    return reduce(DataFrame.unionByName, parts)
