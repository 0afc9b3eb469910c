"""Detail pages, paged book lists of authors and series, and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions import expressions as X
from shelfspark.sources.catalogue import Catalogue

#: Categories by slug: name, keywords in a genre's name, slugs of genres.
CATEGORIES: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    "fantasy": ("Fantasy", ("fantasy", "magic", "dragons", "wizard", "witches", "mythology", "fairies", "epic fantasy", "high fantasy", "urban fantasy", "sword and sorcery"), ("fantasy", "high-fantasy", "urban-fantasy", "epic-fantasy")),
    "science-fiction": ("Science Fiction", ("science fiction", "sci-fi", "space", "aliens", "cyberpunk", "dystopian", "futuristic", "time travel", "space opera", "post-apocalyptic"), ("science-fiction", "sci-fi")),
    "romance": ("Romance", ("romance", "love", "contemporary romance", "historical romance", "romantic fantasy", "romantasy"), ("romance", "love-story")),
    "mystery-thriller": ("Mystery & Thriller", ("mystery", "thriller", "suspense", "crime", "detective", "murder", "psychological thriller", "true crime", "police procedural"), ("mystery", "thriller", "crime", "suspense")),
    "horror": ("Horror", ("horror", "scary", "ghosts", "haunted", "macabre", "supernatural", "paranormal", "gothic"), ("horror", "supernatural-horror")),
    "historical-fiction": ("Historical Fiction", ("historical fiction", "history", "world war", "tudor", "ancient", "medieval", "regency", "victorian"), ("historical-fiction", "history")),
    "young-adult": ("Young Adult", ("young adult", "ya fiction", "teen fiction", "coming of age", "high school"), ("young-adult", "ya", "teen")),
    "classics": ("Classics", ("classic", "literary fiction", "literature", "canonical", "19th century", "20th century literature"), ("classics", "classic-literature", "literary-fiction")),
    "adventure": ("Adventure", ("adventure", "action", "quest", "exploration", "survival", "treasure hunt"), ("adventure", "action-adventure")),
    "biography": ("Biography & Memoir", ("biography", "memoir", "autobiography", "life story", "true story", "personal narrative"), ("biography", "memoir", "autobiography", "biography-memoir")),
    "self-help": ("Self-Help", ("self-help", "personal development", "productivity", "motivation", "self-improvement", "mindfulness", "habits"), ("self-help", "personal-development")),
    "business": ("Business & Economics", ("business", "economics", "entrepreneurship", "finance", "investing", "management", "leadership", "marketing"), ("business", "economics", "finance")),
    "science-nature": ("Science & Nature", ("science", "physics", "biology", "chemistry", "astronomy", "nature", "environment", "popular science", "natural history"), ("science", "nature", "popular-science")),
    "graphic-novels": ("Graphic Novels & Comics", ("graphic novel", "comics", "manga", "illustrated", "sequential art"), ("graphic-novel", "graphic-novels", "comics", "manga")),
}



def _sorts() -> dict[str, Column]:
    """Sort keys that pages accept; others fall back to the combined rating."""
    return {"combined_rating": X.combined_rating(), "publication_year": F.col("original_publication_year"), "readers_count": F.col("total_readers"), "series_position": F.col("series_position")}


def shelf_counts(cat: Catalogue) -> DataFrame:
    """(book_id, want_to_read, reading, read) over shelves, the abandoned ones apart."""
    if isinstance(cat, Catalogue):
        return cat.book_sums.where("want_to_read + reading + read > 0").select("book_id", "want_to_read", "reading", "read")
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return cat.bookshelves.where("status <> 'abandoned'").groupBy("book_id").agg(n("want_to_read"), n("reading"), n("read"))


def total_readers() -> Column:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return X.library_readers() + zero("want_to_read") + zero("reading") + zero("read")


def with_readers(cat: Catalogue, books: DataFrame) -> DataFrame:
    return books.join(shelf_counts(cat), "book_id", "left").withColumn("total_readers", total_readers())


def book_details(cat: Catalogue) -> DataFrame:
    """Every book with its authors, genres, series and shelves as text."""
    genres = cat.book_genres.groupBy("book_id").agg(F.array_join(F.array_sort(F.collect_set("genre_id")), ", ").alias("genres"))
    wide = with_readers(cat, cat.books).join(cat.author_names, "book_id", "left").join(genres, "book_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return wide.select("book_id", "title", "slug", "language", empty("author_names"), empty("genres"), empty("series_id"), "series_position", zero("want_to_read"), zero("reading"), zero("read"), F.col("total_readers").cast("long").alias("total_readers"), X.six(X.combined_rating(None)).alias("combined_rating"))


def author_arrays(cat: Catalogue) -> DataFrame:
    """(book_id, authors): id, name, slug and photo of each book's authors, in order of their ids; an empty array where
    there are none."""
    linked = cat.book_authors.join(cat.authors, "author_id").select("book_id", F.struct("author_id", "name", "slug", F.coalesce("photo_url", F.lit("")).alias("photo_url")).alias("a"))
    arrays = linked.groupBy("book_id").agg(F.array_sort(F.collect_set("a")).alias("authors"))
    empty = F.array().cast("array<struct<author_id:bigint,name:string,slug:string,photo_url:string>>")
    return cat.books.select("book_id").join(arrays, "book_id", "left").select("book_id", F.coalesce("authors", empty).alias("authors"))


def book_by_slug(cat: Catalogue, slug: str, language: str = "en") -> DataFrame:
    return book_details(cat).where((F.col("slug") == slug) & (F.col("language") == language))


def author_details(cat: Catalogue) -> DataFrame:
    """Every author with a book: books, weighted average, ratings, readers, and genres of three books or more."""
    links = cat.book_authors.join(with_readers(cat, cat.books), "book_id")
    sums = links.groupBy("author_id").agg(F.count("*").alias("book_count"), F.sum(X.rating_points()).alias("points"), F.sum(X.total_ratings()).alias("rating_count"), F.sum("total_readers").alias("readers"))
    often = cat.book_authors.join(cat.book_genres, "book_id").groupBy("author_id", "genre_id").agg(F.count_distinct("book_id").alias("n")).where("n >= 3")
    genres = often.groupBy("author_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "genre_id"))).alias("g")).select("author_id", F.array_join(F.col("g.genre_id"), ", ").alias("genres"))
    average = F.coalesce(F.try_divide(F.col("points"), F.col("rating_count").cast("double")), F.lit(0.0))
    joined = cat.authors.select("author_id", "name", "slug").join(sums, "author_id").join(genres, "author_id", "left")
    return joined.select("author_id", "name", "slug", F.col("book_count").cast("long").alias("book_count"), X.six(average).alias("avg_rating"), F.col("rating_count").cast("long").alias("rating_count"), F.col("readers").cast("long").alias("readers"), F.coalesce("genres", F.lit("")).alias("genres"))


def paged(books: DataFrame, partition: str, sort: str, descending: bool, limit: int, offset: int, *then: Column) -> DataFrame:
    """A page of each partition's books, with the partition's whole number of books."""
    key = _sorts().get(sort, _sorts()["combined_rating"])
    order = key.desc_nulls_last() if descending else key.asc_nulls_last()
    whole = Window.partitionBy(partition)
    at = F.row_number().over(whole.orderBy(order, *then, "book_id"))
    numbered = books.withColumn("position", at).withColumn("total", F.count("*").over(whole))
    return numbered.where((F.col("position") > offset) & (F.col("position") <= offset + limit)).select(partition, F.col("position").cast("int").alias("position"), "book_id", "title", X.six(X.combined_rating()).alias("combined_rating"), F.col("total_readers").cast("long").alias("total_readers"), "original_publication_year", "total")


def author_books(cat: Catalogue, sort: str = "combined_rating", descending: bool = True, limit: int = 10, offset: int = 0, language: str = "en") -> DataFrame:
    books = cat.book_authors.join(with_readers(cat, cat.books.where(F.col("language") == language)), "book_id")
    return paged(books, "author_id", sort, descending, limit, offset)


def series_details(cat: Catalogue, language: str = "en") -> DataFrame:
    books = with_readers(cat, cat.books.where((F.col("language") == language) & F.col("series_id").isNotNull()))
    sums = books.groupBy("series_id").agg(F.count("*").alias("book_count"), F.sum(X.rating_points()).alias("points"), F.sum(X.total_ratings()).alias("rating_count"), F.sum("total_readers").alias("readers"))
    average = F.coalesce(F.try_divide(F.col("points"), F.col("rating_count").cast("double")), F.lit(0.0))
    return sums.select("series_id", F.col("book_count").cast("long").alias("book_count"), X.six(average).alias("avg_rating"), F.col("rating_count").cast("long").alias("rating_count"), F.col("readers").cast("long").alias("readers"))


def series_books(cat: Catalogue, sort: str = "series_position", descending: bool = False, limit: int = 10, offset: int = 0, language: str = "en") -> DataFrame:
    books = with_readers(cat, cat.books.where((F.col("language") == language) & F.col("series_id").isNotNull()))
    return paged(books, "series_id", sort, descending, limit, offset, F.asc_nulls_last("created_at"))


def category_genres(cat: Catalogue, categories: dict = CATEGORIES) -> DataFrame:
    """(category, genre_id): a genre belongs where its slug is listed, or its name holds a keyword anywhere."""
    parts = []
    for slug, (_, keywords, exact) in categories.items():
        holds = F.col("slug").isin(*exact) if exact else F.lit(False)
        for word in keywords:
            holds = holds | F.lower("name").contains(word)
        parts.append(F.when(holds, F.lit(slug)))
    return cat.genres.select("genre_id", F.explode(F.array_compact(F.array(*parts))).alias("category"))


def category_books(cat: Catalogue, sort: str = "popularity", limit: int = 20, offset: int = 0, language: str = "en", categories: dict = CATEGORIES) -> DataFrame:
    """A page of the books of every category: by ratings, by average, or by reads where the sort is neither."""
    books = cat.book_genres.join(category_genres(cat, categories), "genre_id").select("category", "book_id").distinct().join(cat.books.where(F.col("language") == language), "book_id")
    key = {"popularity": X.total_ratings(), "rating": X.combined_rating()}.get(sort, F.col("ol_already_read_count"))
    whole = Window.partitionBy("category")
    numbered = books.withColumn("position", F.row_number().over(whole.orderBy(key.desc_nulls_last(), "book_id"))).withColumn("total", F.count("*").over(whole))
    return numbered.where((F.col("position") > offset) & (F.col("position") <= offset + limit)).select("category", F.col("position").cast("int").alias("position"), "book_id", "title", X.total_ratings().cast("long").alias("rating_count"), X.six(X.combined_rating()).alias("combined_rating"), "total")


def category_cache(cat: Catalogue, top: int = 20, categories: dict = CATEGORIES) -> DataFrame:
    """The first books of every category in both sorts."""
    return category_books(cat, "popularity", top, categories=categories).withColumn("sort", F.lit("popularity")).unionByName(category_books(cat, "rating", top, categories=categories).withColumn("sort", F.lit("rating")))


def coverage(cat: Catalogue, external_total: int) -> DataFrame:
    """English books, their share of an outside total in percent, and the numbers of authors and genres."""
    counts = cat.books.agg(F.count_if(F.col("language") == "en").alias("books")).withColumn("coverage_percent", X.six(F.col("books") * 100.0 / external_total))
    return counts.withColumn("authors", F.lit(cat.authors.count()).cast("long")).withColumn("genres", F.lit(cat.genres.count()).cast("long"))
