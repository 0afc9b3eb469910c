"""Batches of book records: parsing of API answers, cleaning, and their upsert into the catalogue's tables.

Tables of a batch import are keyed by slug: authors, genres and series by theirs, books by language and slug; links hold
slugs. `seq` is a record's place in its batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions import expressions as X
from shelfspark.functions.text import clean_description
from shelfspark.operators.ingest import COVER, GENRES, ISBNS, picture
from shelfspark.operators.merge import insert_links, last_by, merged
from shelfspark.sources.dumps import text_value

TITLE, PUBLISHER, URL, GENRE_NAME, GENRE_SLUG = 500, 500, 1000, 100, 150
STRINGS = "array<string>"
WORK = (
    "title string, description string, subjects array<string>, covers array<bigint>, first_publish_date string, "
    "editions struct<entries: array<struct<physical_format: string>>>"
)
EDITIONS = (
    "entries array<struct<isbn_10: array<string>, isbn_13: array<string>, number_of_pages: int, publishers: array<string>, covers: array<bigint>, series: array<string>, identifiers: map<string, array<string>>>>"
)


def api_series(text: Column) -> tuple[Column, Column]:
    """(name, position) of an API's series text: what is before a #, and the number after it."""
    whole = F.trim(text)
    marked = whole.contains("#")
    before, after = F.split(whole, "#")[0], F.trim(F.get(F.split(whole, "#"), F.lit(1)))
    name = F.when(marked, F.trim(F.regexp_replace(F.trim(before), ",+$", ""))).otherwise(whole)
    number = F.when(after.contains("."), after).otherwise(F.get(F.split(after, r"\s+"), F.lit(0)))
    return name, F.when(marked, number.try_cast("double"))


def api_format(text: Column) -> Column:
    """Format of an edition's description, or null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(low.contains("hardcover"), "hardcover")
        .when(low.contains("paperback") | low.contains("softcover"), "paperback")
        .when(low.contains("ebook") | low.contains("kindle"), "ebook")
        .when(low.contains("audio"), "audiobook")
    )


def api_books(records: DataFrame) -> DataFrame:
    """Book records (see clean_books) of rows (seq, key, work, editions, authors): the JSON of a work and of its
    editions, and the authors found for it. Works without a key, details or title are left out."""
    none = F.array().cast(STRINGS)
    parsed = records.where(X.filled(F.col("key"))).select("seq", "key", "authors", F.from_json("work", WORK).alias("w"), F.from_json("editions", EDITIONS).alias("e")).where("w is not null").select("seq", "key", "authors", "w.*", F.col("w.editions.entries").alias("shapes"), F.col("e.entries").alias("entries"))
    known = lambda values: F.filter(F.coalesce(values, none), X.filled)
    isbns = F.flatten(F.transform(F.coalesce("entries", F.array().cast(EDITIONS.removeprefix("entries "))), lambda e: F.concat(known(e["isbn_10"]), known(e["isbn_13"]))))
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    score = lambda e: F.size(known(e["isbn_10"])) + F.size(known(e["isbn_13"])) + one(e["number_of_pages"] > 0) + one(F.size(e["publishers"]) > 0) + one(F.size(e["covers"]) > 0)
    ranked = F.transform("entries", lambda e, i: F.struct((-score(e)).alias("k"), i.alias("i"), e["number_of_pages"].alias("pages"), F.get(e["publishers"], F.lit(0)).alias("publisher"), F.to_json(e["identifiers"]).alias("ids")))
    series = F.get(F.filter(F.transform("entries", lambda e: F.get(e["series"], F.lit(0))), X.filled), F.lit(0))
    name, position = api_series(series)
    formats = F.array_sort(F.array_distinct(F.array_compact(F.transform(F.slice(F.coalesce("shapes", F.array().cast("array<struct<physical_format:string>>")), 1, 10), lambda s: api_format(s["physical_format"])))))
    rows = parsed.withColumn("best", F.array_min(ranked)).where(X.filled(F.col("title")))
    identifiers = F.from_json("best.ids", "map<string, array<string>>")
    first_ids = F.map_filter(F.transform_values(identifiers, lambda _, v: F.get(v, F.lit(0))), lambda _, v: v.isNotNull())
    return rows.select(
        "seq",
        "title",
        F.lit("en").alias("language"),
        text_value("description").alias("description"),
        F.lit(None).cast("string").alias("first_sentence"),
        F.when(F.col("first_publish_date").rlike(r"^\d{4}"), X.year_of(F.col("first_publish_date"))).alias("original_publication_year"),
        picture(F.col("covers"), COVER).alias("primary_cover_url"),
        F.regexp_extract("key", r"([^/]+)$", 1).alias("open_library_id"),
        F.lit(None).cast("string").alias("google_books_id"),
        F.when(series.isNotNull(), F.struct(name.alias("name"), position.alias("position"))).alias("series"),
        F.when(F.size(formats) > 0, formats).otherwise(F.array(F.lit("paperback"))).alias("formats"),
        F.slice(F.array_distinct(isbns), 1, ISBNS).alias("isbn"),
        F.substring("best.publisher", 1, PUBLISHER).alias("publisher"),
        F.when(F.col("best.pages") > 0, F.col("best.pages")).alias("number_of_pages"),
        F.coalesce(first_ids, F.create_map().cast("map<string,string>")).alias("external_ids"),
        "authors",
        F.transform(F.slice(F.coalesce("subjects", none), 1, GENRES), lambda s: F.struct(s.alias("name"))).alias("genres"),
    )


#: Column that tells the batches of records apart that are imported together, and orders them.
AT = "__at"


def _at(df: DataFrame) -> list[str]:
    return [AT] if AT in df.columns else []


def in_turn(changes: DataFrame, keys: list[str], policies: dict[str, str], default: str = "overwrite") -> DataFrame:
    """One change for each key in place of those of several batches (one row for each key and batch): merged() with it
    leaves what merged() with one batch after the other would. Changes of one batch are given back as they are."""
    if not _at(changes):
        return changes
    pick = {
        "overwrite": lambda c: F.max_by(c, AT),
        "keep": lambda c: F.min_by(c, AT),
        "fill": lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(AT))),
        "supplied": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(AT))),
    }
    return changes.groupBy(*keys).agg(*[pick[policies.get(c, default)](c).alias(c) for c in changes.columns if c not in (*keys, AT)])


def clean_books(records: DataFrame) -> DataFrame:
    """Records fit for the tables, with their slugs; those without a title are left out."""
    none = F.array().cast(STRINGS)
    return records.where(X.filled(F.col("title"))).select(
        *_at(records),
        "seq",
        F.substring("title", 1, TITLE).alias("title"),
        F.lower(F.coalesce("language", F.lit("en"))).alias("language"),
        X.slug_ascii(F.col("title")).alias("slug"),
        clean_description(F.col("description")).alias("description"),
        "first_sentence",
        "original_publication_year",
        F.substring("primary_cover_url", 1, URL).alias("primary_cover_url"),
        "open_library_id",
        "google_books_id",
        F.when(X.filled(F.col("series.name")), X.slug_ascii(F.col("series.name"))).alias("series_slug"),
        F.col("series.position").alias("series_position"),
        F.col("series.name").alias("series_name"),
        F.transform(F.coalesce("formats", none), F.lower).alias("formats"),
        F.coalesce("isbn", none).alias("isbn"),
        F.substring("publisher", 1, PUBLISHER).alias("publisher"),
        F.when(F.col("number_of_pages") > 0, F.col("number_of_pages")).alias("number_of_pages"),
        F.coalesce("external_ids", F.create_map().cast("map<string,string>")).alias("external_ids"),
        "authors",
        "genres",
    )


def first_of_batch(rows: DataFrame, key: str) -> DataFrame:
    """Of rows (seq, key, ...) the first of each key in its batch."""
    keys = [key, *_at(rows)]
    others = [c for c in rows.columns if c not in (*keys, "seq")]
    return rows.where(X.filled(F.col(key))).groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct("seq", *others)).alias("f")).select(*keys, *[F.col(f"f.{c}").alias(c) for c in others])


def genre_name(name: Column) -> Column:
    return F.substring(F.lower(name), 1, GENRE_NAME)


def genre_links(cleaned: DataFrame) -> DataFrame:
    """(seq, language, slug, genre_slug, name) of each record's genres."""
    each = cleaned.select(*_at(cleaned), "seq", "language", "slug", F.explode("genres").alias("g")).withColumn("name", genre_name(F.col("g.name")))
    return each.select(*_at(cleaned), "seq", "language", "slug", X.slug_ascii(F.col("name"), GENRE_SLUG).alias("genre_slug"), "name").where(X.filled(F.col("genre_slug")))


def author_links(cleaned: DataFrame) -> DataFrame:
    """(seq, language, slug, author_slug, a) of each record's authors."""
    each = cleaned.select(*_at(cleaned), "seq", "language", "slug", F.explode("authors").alias("a"))
    return each.select(*_at(cleaned), "seq", "language", "slug", X.slug_ascii(F.col("a.name")).alias("author_slug"), "a").where(X.filled(F.col("author_slug")))


def upsert_genres(table: DataFrame, new: DataFrame) -> DataFrame:
    """table (slug, name) and rows (seq, slug, name): a new name replaces the old one; the first of a batch counts."""
    return merged(table, in_turn(first_of_batch(new, "slug"), ["slug"], {}), ["slug"], {})


def upsert_series(table: DataFrame, new: DataFrame) -> DataFrame:
    """table (slug, name, description) and rows (seq, slug, name, description): names stay, descriptions are replaced."""
    keep = {"name": "keep"}
    return merged(table, in_turn(first_of_batch(new, "slug"), ["slug"], keep), ["slug"], keep)


def upsert_books(table: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Books by language and slug, the last record of a batch counts. Old ones get the new description, ids, ISBNs,
    publisher, pages and formats; a first sentence only where there is none; the rest stays."""
    keys = ["language", "slug"]
    last = last_by(cleaned, [*keys, *_at(cleaned)], "seq")
    stay = ("title", "original_publication_year", "primary_cover_url", "series_slug", "series_position")
    policies = {"first_sentence": "fill"} | dict.fromkeys(stay, "keep")
    return merged(table, in_turn(last.select(*_at(last), *[c for c in table.columns if c in last.columns]), keys, policies), keys, policies)


def import_batch(tables: dict[str, DataFrame], records: DataFrame) -> dict[str, DataFrame]:
    """tables (genres, series, authors, books, book_genres, book_authors) with a batch of records: dimensions first, then
    books, then links between slugs. Records that can't be cleaned change nothing. Records with a column AT are those of
    several batches, and the tables are what these leave when they are imported one after the other by AT."""
    cleaned = clean_books(records)
    genres, authors = genre_links(cleaned), author_links(cleaned)
    series = cleaned.where(X.filled(F.col("series_slug"))).select(*_at(cleaned), "seq", F.col("series_slug").alias("slug"), F.col("series_name").alias("name"), F.lit(None).cast("string").alias("description"))
    people = first_of_batch(authors.select(*_at(authors), "seq", F.col("author_slug").alias("slug"), "a"), "slug").select("slug", *_at(authors), "a.*")
    fill = dict.fromkeys(("bio", "birth_date", "death_date", "photo_url", "wikidata_id", "wikipedia_url"), "fill") | {"name": "keep"}
    return {
        "genres": upsert_genres(tables["genres"], genres.select(*_at(genres), "seq", F.col("genre_slug").alias("slug"), "name")),
        "series": upsert_series(tables["series"], series),
        "authors": merged(tables["authors"], in_turn(people.select(*_at(people), *[c for c in tables["authors"].columns if c in people.columns]), ["slug"], fill), ["slug"], fill),
        "books": upsert_books(tables["books"], cleaned),
        "book_genres": insert_links(tables["book_genres"], genres.select("language", "slug", "genre_slug")),
        "book_authors": insert_links(tables["book_authors"], authors.select("language", "slug", "author_slug")),
    }
