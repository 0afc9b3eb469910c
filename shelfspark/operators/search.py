"""Full-text search: inverted index, BM25 with typo tolerance, and a boost by drawn-in averages."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions import expressions as X
from shelfspark.functions.stem import stem as stem_of
from shelfspark.sources.catalogue import Catalogue

if TYPE_CHECKING:
    from shelfspark.operators.index import SearchIndex

K1, B = 1.2, 0.75
BOOST = 4.0
EXPANDED_SCORE = 0.4


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, Latin letters without their accents."""
    return F.regexp_extract_all(X.fold_accents(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def query_terms(text: str) -> list[str]:
    """terms() of a query."""
    folded = text.lower().translate(str.maketrans(X.ACCENTED, X.PLAIN))
    kinds = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in folded)
    return kinds.split()


def stemmed(words: Column) -> Column:
    """English stems of an array of terms."""
    return F.udf(lambda found: [stem_of(w) for w in found], "array<string>", useArrow=True)(words)


def fuzzy_edits(term: str) -> int:
    """Edits that a query term may be away: none up to 2 letters, one up to 5, else two."""
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def best_field(docs: DataFrame, doc: str, fields: dict[str, float], query: str, fuzzy: bool = True, stemmed_fields: tuple[str, ...] = ()) -> DataFrame:
    """(doc, score) of documents with a term of the query, or one near it: the best of the fields' BM25 scores, each
    times its weight. Terms of stemmed fields, and the query's there, are English stems.

    All fields go through one pass of postings. The index is narrowed to the query's terms where documents are read;
    document frequencies come from the narrowed rows, a row of statistics for each field from lengths. A term found through
    edits counts once for each query term, at its best."""
    asked = query_terms(query)
    wanted = {f: sorted({stem_of(w) for w in asked} if f in stemmed_fields else set(asked)) for f in fields}
    if not asked:
        return docs.select(F.col(doc).alias("doc"), F.lit(0.0).alias("score")).limit(0)
    found = {f: stemmed(terms(F.col(f))) if f in stemmed_fields else terms(F.col(f)) for f in fields}
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(float(w)).alias("weight"), found[f].alias("terms")) for f, w in fields.items()]))
    rows = docs.select(F.col(doc).alias("doc"), each.alias("f")).select("doc", "f.*").withColumn("length", F.size("terms"))
    statistics = rows.where("length > 0").groupBy("field").agg(F.count("*").cast("double").alias("n"), F.avg("length").alias("average"))

    def near(term: Column, w: str) -> Column:
        return F.levenshtein(term, F.lit(w), fuzzy_edits(w)).between(0, fuzzy_edits(w)) if fuzzy else term == w

    def hits(term: Column) -> Column:
        """The query terms that a term of the row's field stands for."""
        by_field = [F.when(F.col("field") == f, F.array_compact(F.array(*[F.when(near(term, w), F.lit(w)) for w in ws]))) for f, ws in wanted.items()]
        return F.coalesce(*by_field)

    hit = rows.select("doc", "field", "weight", "length", F.explode("terms").alias("term")).withColumn("asked", F.explode(hits(F.col("term"))))
    return scored(hit.groupBy("doc", "field", "weight", "length", "term", "asked").agg(F.count("*").alias("tf")), statistics)


def scored(matched: DataFrame, statistics: DataFrame) -> DataFrame:
    """(doc, score) of matched (doc, field, weight, length, term, asked, tf), all postings of the terms that stand for a
    query term, and statistics (field, n, average)."""
    frequency = matched.groupBy("field", "term").agg(F.count_distinct("doc").alias("df"))
    weighed = matched.join(frequency, ["field", "term"]).join(F.broadcast(statistics), "field")  # a row for each field
    idf = F.log(F.lit(1.0) + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    saturation = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("average")))
    per_asked = weighed.withColumn("part", idf * saturation).groupBy("doc", "field", "weight", "asked").agg(F.max("part").alias("part"))
    per_field = per_asked.groupBy("doc", "field", "weight").agg((F.sum("part") * F.col("weight")).alias("score"))
    return per_field.groupBy("doc").agg(F.max("score").alias("score"))


def bm25(docs: DataFrame, doc: str, field: str, query: str, fuzzy: bool = False, stem: bool = False) -> DataFrame:
    """(doc, score) by one field."""
    return best_field(docs, doc, {field: 1.0}, query, fuzzy, (field,) if stem else ())


def book_documents(cat: Catalogue, since: str | None = None) -> DataFrame:
    """Search documents of books; since leaves out books that haven't changed."""
    books = cat.books if since is None else cat.books.where(F.col("created_at") > F.lit(since).cast("timestamp"))
    named = books.join(cat.author_names, "book_id", "left")
    return named.select(
        "book_id", "title", "slug", "language", "primary_cover_url", F.coalesce("author_names", F.lit("")).alias("authors_names"), F.coalesce("series_id", F.lit("")).alias("series_name"), X.total_ratings().alias("n"),
        X.six(X.bayesian(X.total_ratings(), X.combined_rating())).alias("bayesian_score"),
    )


def _rollup(rows: DataFrame, *keys: str) -> DataFrame:
    sums = rows.groupBy(*keys).agg(F.count_distinct("book_id").alias("book_count"), F.sum(X.total_ratings()).alias("n"), F.sum(X.rating_points()).alias("points"))
    average = F.coalesce(F.try_divide(F.col("points"), F.col("n").cast("double")), F.lit(0.0))
    return sums.select(*keys, "book_count", "n", X.six(X.bayesian(F.col("n"), average)).alias("bayesian_score"))


def author_documents(cat: Catalogue) -> DataFrame:
    """Search documents of authors, one for each language of their books."""
    rolled = _rollup(cat.book_authors.join(cat.books, "book_id"), "author_id", "language")
    return rolled.join(cat.authors.select("author_id", "name", "slug"), "author_id")


def series_documents(cat: Catalogue) -> DataFrame:
    return _rollup(cat.books.where("series_id is not null"), "series_id", "language").withColumn("name", F.col("series_id")).withColumn("slug", F.lower(F.replace("series_id", F.lit(" "), F.lit("-"))))


#: Fields of each kind of document with their weights, its key and its title.
BOOK_FIELDS, NAME_FIELDS = {"title": 3.0, "authors_names": 2.0, "series_name": 1.0, "slug": 1.0}, {"name": 3.0, "slug": 1.0}
STEMMED = ("title", "authors_names", "series_name")


def index_texts(docs: DataFrame, kind: str, key: str, fields: Iterable[str]) -> DataFrame:
    """Search documents as an index takes them: (field, doc, text, stem), one row for each field."""
    each = F.array(*[F.struct(F.concat_ws("/", F.lit(kind), F.coalesce("language", F.lit("")), F.lit(f)).alias("field"), F.col(f).alias("text"), F.lit(kind == "book" and f in STEMMED).alias("stem")) for f in fields])
    return docs.select(F.concat_ws("/", F.lit(kind), F.coalesce("language", F.lit("")), F.col(key).cast("string")).alias("doc"), F.explode(each).alias("f")).select("f.field", "doc", "f.text", "f.stem")


def all_texts(cat: Catalogue) -> DataFrame:
    """What an index holds of a catalogue."""
    return (
        index_texts(book_documents(cat), "book", "book_id", BOOK_FIELDS)
        .unionByName(index_texts(author_documents(cat), "author", "author_id", NAME_FIELDS))
        .unionByName(index_texts(series_documents(cat), "series", "series_id", NAME_FIELDS))
    )


def _hits(docs: DataFrame, kind: str, key: str, title: str, fields: dict[str, float], query: str, stemmed_fields: tuple[str, ...] = (), index: SearchIndex | None = None, language: str = "en") -> DataFrame:
    """From the index, if one is given; else the documents are analysed for the query."""
    docs = docs.where(F.col("language") == language)
    if index is None:
        found = best_field(docs, key, fields, query, stemmed_fields=stemmed_fields)
    else:
        named = {f"{kind}/{language}/{f}" + "~" * (f in stemmed_fields): w for f, w in fields.items()}
        found = index.best_field(named, query).withColumn("doc", F.substring("doc", len(f"{kind}/{language}/") + 1, 1_000).cast(dict(docs.dtypes)[key]))
    scored = found.join(docs.withColumnRenamed(key, "doc"), "doc")
    return scored.select(F.lit(kind).alias("type"), F.col("doc").cast("string").alias("id"), F.col(title).alias("title"), X.six(F.col("score") + BOOST * F.col("bayesian_score")).alias("score"))


def search_books(cat: Catalogue, query: str, language: str = "en", stem: bool = True, index: SearchIndex | None = None) -> DataFrame:
    """Hits among books; titles, authors and series are compared by English stems unless stem is false, slugs never are."""
    return _hits(book_documents(cat), "book", "book_id", "title", BOOK_FIELDS, query, STEMMED if stem else (), index, language)


def search_authors(cat: Catalogue, query: str, language: str = "en", index: SearchIndex | None = None) -> DataFrame:
    """Names are compared with their accents folded, as titles are."""
    return _hits(author_documents(cat), "author", "author_id", "name", NAME_FIELDS, query, index=index, language=language)


def search_series(cat: Catalogue, query: str, language: str = "en", index: SearchIndex | None = None) -> DataFrame:
    return _hits(series_documents(cat), "series", "series_id", "name", NAME_FIELDS, query, index=index, language=language)


def top_books_of(cat: Catalogue, links: DataFrame, key: str, each: int = 3, language: str = "en") -> DataFrame:
    """(key, book_id, title): the best-rated books of each of an author's or a series' links."""
    books = links.join(cat.books.where(F.col("language") == language), "book_id")
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(X.total_ratings()), F.desc_nulls_last("avg_rating"), "book_id"))
    return books.withColumn("nth", nth).where(F.col("nth") <= each).select(key, "nth", "book_id", "title")


def search_categories(cat: Catalogue, query: str, language: str = "en") -> DataFrame:
    """Books with a genre whose slug or name holds the text, % and _ as themselves, most rated first."""
    low = query.lower()
    genres = cat.genres.where(F.lower("slug").contains(low) | F.lower("name").contains(low)).select("genre_id")
    ids = cat.book_genres.join(genres, "genre_id", "left_semi").select("book_id").distinct()
    return cat.books.where(F.col("language") == language).join(ids, "book_id", "left_semi").select("book_id", "title", X.total_ratings().cast("long").alias("rating_count"), X.six(F.coalesce("avg_rating", F.lit(0.0))).alias("avg_rating"), "created_at")


def federated(cat: Catalogue, query: str, limit: int = 10, kind: str = "all", language: str = "en", stem: bool = True, index: SearchIndex | None = None) -> DataFrame:
    """Hits of all kinds in one list; books are compared by stems unless stem is false. With kind all, authors and series found bring their best books at a fixed low
    score; of hits of one thing the best counts."""
    parts = []
    if kind in ("all", "books"):
        parts.append(search_books(cat, query, language, stem, index))
    if kind in ("all", "authors"):
        parts.append(authors := search_authors(cat, query, language, index).orderBy(F.desc("score"), "id").limit(limit * 2))
    if kind in ("all", "series"):
        parts.append(series := search_series(cat, query, language, index).orderBy(F.desc("score"), "id").limit(limit * 2))
    if kind == "all":
        found = cat.book_authors.join(authors.select(F.col("id").cast("long").alias("author_id")), "author_id", "left_semi")
        mine = cat.books.where("series_id is not null").select("book_id", F.col("series_id").alias("found_series")).join(series.select(F.col("id").alias("found_series")), "found_series", "left_semi")
        for links, key in ((found, "author_id"), (mine, "found_series")):
            more = top_books_of(cat, links, key, language=language)
            parts.append(more.select(F.lit("book").alias("type"), F.col("book_id").cast("string").alias("id"), "title", F.lit(EXPANDED_SCORE).alias("score")))
    if kind == "categories":
        parts.append(search_categories(cat, query, language).select(F.lit("book").alias("type"), F.col("book_id").cast("string").alias("id"), "title", F.lit(1.0).alias("score")))
    best = reduce(DataFrame.unionByName, parts).groupBy("type", "id").agg(F.max("title").alias("title"), F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "type", "id").limit(limit)
