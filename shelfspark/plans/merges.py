"""Queries of batch imports, keyed merges, section reads, slugs and analysers, and the SQL that states their results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import expressions as X
from shelfspark.functions import text as T
from shelfspark.operators import batch, browse, cleanup, ingest, merge, sampling, search, similar, userdata
from shelfspark.plans.oracle import sql
from shelfspark.sources import dumps
from shelfspark.sources.catalogue import Catalogue, catalogue, shared_dir
from shelfspark.sources.versions import BucketedTable
from shelfspark.streaming import counters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SEED = 42


def add(key: str, build: Callable[[Catalogue], DataFrame], oracle: str | None = None) -> None:
    QUERIES[key] = lambda spark, sf_dir: build(catalogue(spark, sf_dir))
    if oracle:
        ORACLE_SQL[key] = oracle


def text_map(column: str) -> Column:
    """A map as text, its keys in order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias(column)


def joined(column: str) -> Column:
    return F.array_join(F.col(column), ",").alias(column)


# ---- comments


def _comment_changes(cat: Catalogue) -> DataFrame:
    """Two updates of every third comment, a delete of every fifth, and an update of every seventh by someone else."""
    c = cat.comments.select("comment_id", "user_id", "created_at")
    change = lambda rows, kind, body, spoiler, at, user="user_id": rows.select("comment_id", F.expr(user).alias("user_id"), F.lit(kind).alias("kind"), F.lit(body).alias("body"), F.lit(spoiler).alias("is_spoiler"), (F.col("created_at") + F.expr(f"interval {at} seconds")).alias("updated_at"))
    third = c.where("comment_id % 3 = 0")
    parts = (change(third, "update", "first", False, 1), change(third, "update", "second", True, 2), change(c.where("comment_id % 5 = 0"), "delete", None, None, 1), change(c.where("comment_id % 7 = 0"), "update", "stranger", True, 9, "user_id + 1"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


add(
    "k05_edit_comments",
    lambda cat: merge.edit_comments(cat.comments.select("comment_id", "user_id", "book_id", "body", "is_spoiler"), _comment_changes(cat)),
    sql("SELECT comment_id, user_id, book_id, CASE WHEN comment_id % 3 = 0 THEN 'second' ELSE body END AS body, CASE WHEN comment_id % 3 = 0 THEN true ELSE is_spoiler END AS is_spoiler FROM comments WHERE comment_id % 5 <> 0"),
)

# ---- batches of records


def _records(cat: Catalogue) -> DataFrame:
    """Records made of parts, several of a title; some without a title."""
    p = F.col("p_partkey")
    person = F.struct(F.concat(F.lit("Writer "), p % 7).alias("name"), F.when(p % 2 == 0, F.concat(F.lit("bio "), p)).alias("bio"))
    return cat.table("part").select(
        p.alias("seq"),
        F.when(p % 11 != 0, F.concat("p_name", F.lit(" é"), p % 4)).alias("title"),
        F.when(p % 4 == 0, "EN").when(p % 4 == 1, "De").alias("language"),
        F.when(p % 6 != 0, F.concat(F.lit(" About <b>"), "p_name", F.lit("</b> "))).alias("description"),
        F.when(p % 2 == 0, F.concat(F.lit("It began at "), p)).alias("first_sentence"),
        (F.lit(1900) + p % 100).cast("int").alias("original_publication_year"),
        F.concat(F.lit("cover/"), p).alias("primary_cover_url"),
        F.concat(F.lit("OL"), p, F.lit("W")).alias("open_library_id"),
        F.lit(None).cast("string").alias("google_books_id"),
        F.when(p % 3 == 0, F.struct(F.col("p_brand").alias("name"), F.col("p_size").cast("double").alias("position"))).alias("series"),
        F.array(F.lit("HardCover")).alias("formats"),
        F.when(p % 5 != 0, F.array(F.concat(F.lit("i"), p))).alias("isbn"),
        F.col("p_brand").alias("publisher"),
        (F.col("p_size").cast("int") * 10 - 100).alias("number_of_pages"),
        F.create_map(F.lit("x"), p.cast("string")).alias("external_ids"),
        F.array(person).alias("authors"),
        F.array(F.struct(F.upper("p_type").alias("name")), F.struct(F.concat(F.lit("Size "), F.col("p_size")).alias("name"))).alias("genres"),
    )


SLUG = r"trim(regexp_replace(regexp_replace(replace(lower({}), 'é', 'e'), '[^a-z0-9_\s-]', '', 'g'), '[-\s]+', '-', 'g'), '-')"
RECORDS = f"""
  SELECT p_partkey AS seq, p_name || ' é' || (p_partkey % 4) AS title, CASE p_partkey % 4 WHEN 1 THEN 'de' ELSE 'en' END AS language, {SLUG.format("p_name || ' é' || (p_partkey % 4)")} AS slug,
    CASE WHEN p_partkey % 6 <> 0 THEN 'About ' || p_name END AS description, CASE WHEN p_partkey % 2 = 0 THEN 'It began at ' || p_partkey END AS first_sentence, CAST(1900 + p_partkey % 100 AS INTEGER) AS original_publication_year,
    'cover/' || p_partkey AS primary_cover_url, 'OL' || p_partkey || 'W' AS open_library_id, CASE WHEN p_partkey % 3 = 0 THEN {SLUG.format("p_brand")} END AS series_slug, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) END AS series_position,
    CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS series_name, 'hardcover' AS formats, CASE WHEN p_partkey % 5 <> 0 THEN 'i' || p_partkey ELSE '' END AS isbn, p_brand AS publisher,
    CASE WHEN p_size * 10 > 100 THEN CAST(p_size AS INTEGER) * 10 - 100 END AS number_of_pages, 'x=' || p_partkey AS external_ids, p_type, p_size
  FROM part WHERE p_partkey % 11 <> 0"""
BOOK_COLUMNS = ("language", "slug", "title", "description", "first_sentence", "original_publication_year", "primary_cover_url", "open_library_id", "series_slug", "series_position", "publisher", "number_of_pages")


def _flat(books: DataFrame) -> DataFrame:
    return books.select(*BOOK_COLUMNS, joined("formats"), joined("isbn"), text_map("external_ids"))


add(
    "z16_clean_books",
    lambda cat: batch.clean_books(_records(cat)).select("seq", *BOOK_COLUMNS, "series_name", joined("formats"), joined("isbn"), text_map("external_ids")),
    f"SELECT * EXCLUDE (p_type, p_size) FROM ({RECORDS})",
)


LAST = f"SELECT * FROM ({RECORDS}) QUALIFY row_number() OVER (PARTITION BY language, slug ORDER BY seq DESC) = 1"
add(
    "k09_upsert_books",
    lambda cat: _flat(batch.upsert_books(_even_books(cat), batch.clean_books(_records(cat)))),
    f"""
SELECT language, slug, CASE WHEN old THEN 'Old' ELSE title END AS title, description, CASE WHEN old AND length(slug) % 4 = 0 THEN 'Old first.' ELSE first_sentence END AS first_sentence, CASE WHEN old THEN 1800 ELSE original_publication_year END AS original_publication_year,
  CASE WHEN old THEN 'old cover' ELSE primary_cover_url END AS primary_cover_url, open_library_id, CASE WHEN old THEN 'old-series' ELSE series_slug END AS series_slug, CASE WHEN old THEN 1.0::DOUBLE ELSE series_position END AS series_position,
  publisher, number_of_pages, formats, isbn, external_ids
FROM (SELECT *, length(slug) % 2 = 0 AS old FROM ({LAST}))""",
)


def _even_books(cat: Catalogue) -> DataFrame:
    """Books that were there before a batch: those of its titles whose slug has an even length."""
    old = batch.clean_books(_records(cat)).where(F.length("slug") % 2 == 0).select("language", "slug").distinct()
    return old.select(
        "language", "slug", F.lit("Old").alias("title"), F.lit("old text").alias("description"), F.when(F.length("slug") % 4 == 0, "Old first.").alias("first_sentence"), F.lit(1800).alias("original_publication_year"), F.lit("old cover").alias("primary_cover_url"),
        F.lit("old").alias("open_library_id"), F.lit("old-series").alias("series_slug"), F.lit(1.0).alias("series_position"), F.array(F.lit("ebook")).alias("formats"), F.array(F.lit("old")).alias("isbn"), F.lit("old").alias("publisher"), F.lit(7).alias("number_of_pages"), F.create_map(F.lit("y"), F.lit("z")).alias("external_ids"),
    )


GENRE_ROWS = f"SELECT seq, language, slug, {SLUG.format('name')} AS genre_slug, name FROM (SELECT seq, language, slug, unnest([lower(p_type), 'size ' || p_size]) AS name FROM ({RECORDS}))"


def _old_genres(cat: Catalogue) -> DataFrame:
    sizes = cat.table("part").select((F.col("p_size") % 20).alias("n")).distinct()
    return sizes.select(F.concat(F.lit("size-"), F.col("n")).alias("slug"), F.lit("Old").alias("name"))


OLD_GENRES = "SELECT DISTINCT 'size-' || (p_size % 20) AS slug, 'Old' AS name FROM part"
GENRES = f"SELECT slug, coalesce(n.name, o.name) AS name FROM ({OLD_GENRES}) o FULL JOIN (SELECT genre_slug AS slug, arg_min(name, {{'s': seq, 'n': name}}) AS name FROM ({GENRE_ROWS}) GROUP BY 1) n USING (slug)"
add("k08_upsert_genres", lambda cat: batch.upsert_genres(_old_genres(cat), batch.genre_links(batch.clean_books(_records(cat))).select("seq", F.col("genre_slug").alias("slug"), "name")), GENRES)
add(
    "k08_upsert_series",
    lambda cat: batch.upsert_series(
        cat.table("part").where("p_partkey % 3 = 0 and p_size < 10").select(X.slug_ascii(F.col("p_brand")).alias("slug"), F.lit("Old").alias("name"), F.lit("old").alias("description")).distinct(),
        cat.table("part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("seq"), X.slug_ascii(F.col("p_brand")).alias("slug"), F.col("p_brand").alias("name"), F.concat(F.lit("from "), F.col("p_partkey")).alias("description")),
    ),
    f"""SELECT slug, coalesce(o.name, n.name) AS name, coalesce(n.description, o.description) AS description FROM (SELECT DISTINCT {SLUG.format('p_brand')} AS slug, 'Old' AS name, 'old' AS description FROM part WHERE p_partkey % 3 = 0 AND p_size < 10) o
FULL JOIN (SELECT {SLUG.format('p_brand')} AS slug, p_brand AS name, 'from ' || min(p_partkey) AS description FROM part WHERE p_partkey % 4 = 0 GROUP BY 1, 2) n USING (slug)""",
)


def _imported(cat: Catalogue) -> DataFrame:
    """All tables after a batch, as (table, key, value)."""
    none = lambda schema: cat.spark.createDataFrame([], schema)
    tables = {
        "genres": _old_genres(cat), "series": none("slug string, name string, description string"), "authors": none("slug string, name string, bio string"), "books": _even_books(cat),
        "book_genres": none("language string, slug string, genre_slug string"), "book_authors": none("language string, slug string, author_slug string"),
    }
    out = batch.import_batch(tables, _records(cat))
    value = {"genres": "name", "series": "name", "authors": "bio", "books": "title", "book_genres": "genre_slug", "book_authors": "author_slug"}
    row = lambda name, df: df.select(F.lit(name).alias("table"), F.concat_ws("/", *[c for c in ("language", "slug") if c in df.columns]).alias("key"), F.col(value[name]).alias("value"))
    parts = [row(name, df) for name, df in out.items()]
    first = parts[0]
    for part in parts[1:]:
        first = first.unionByName(part)
    return first


add(
    "k24_import_batch",
    _imported,
    f"""
WITH r AS ({RECORDS})
SELECT 'genres' AS "table", slug AS key, name AS value FROM ({GENRES})
UNION ALL SELECT DISTINCT 'series', series_slug, series_name FROM r WHERE series_slug IS NOT NULL
UNION ALL SELECT 'authors', 'writer-' || (seq % 7), arg_min({{'b': CASE WHEN seq % 2 = 0 THEN 'bio ' || seq END}}, seq).b FROM r GROUP BY 2
UNION ALL SELECT 'books', language || '/' || slug, CASE WHEN length(slug) % 2 = 0 THEN 'Old' ELSE arg_max(title, seq) END FROM r GROUP BY language, slug
UNION ALL SELECT DISTINCT 'book_genres', language || '/' || slug, genre_slug FROM ({GENRE_ROWS})
UNION ALL SELECT DISTINCT 'book_authors', language || '/' || slug, 'writer-' || (seq % 7) FROM r""",
)

# ---- answers of a books API


def _answers(cat: Catalogue) -> DataFrame:
    p = F.col("p_partkey")
    edition = lambda n: F.struct(
        F.array(F.concat(F.lit(f"a{n}-"), p % 5), F.lit("same")).alias("isbn_10"), F.when(p % 2 == n % 2, F.array(F.concat(F.lit(f"b{n}-"), p))).alias("isbn_13"), F.when(p % 3 == n, p).cast("int").alias("number_of_pages"),
        F.when(p % 4 == n, F.array(F.concat(F.lit("pub"), F.lit(n)))).alias("publishers"), F.when(p % 5 == n, F.array(F.concat("p_name", F.when(p % 2 == 0, F.concat(F.lit(", #"), F.col("p_size"), F.lit(" of many"))).otherwise("")))).alias("series"),
        F.create_map(F.lit("goodreads"), F.array(F.concat(F.lit(f"g{n}-"), p))).alias("identifiers"),
    )
    work = F.struct(
        F.when(p % 13 != 0, F.col("p_name")).alias("title"), F.struct(F.concat(F.lit("About "), F.col("p_name")).alias("value")).alias("description"), F.array("p_type", "p_brand", F.lit("c"), F.lit("d"), F.lit("e"), F.lit("f")).alias("subjects"), F.array(p).alias("covers"),
        F.when(p % 2 == 0, "1984-05").otherwise("May 1984").alias("first_publish_date"), F.struct(F.array(F.struct(F.when(p % 3 == 0, "Mass Market Paperback").when(p % 3 == 1, "Kindle").otherwise("leaf").alias("physical_format")))).alias("x"),
    )
    return cat.table("part").select(p.alias("seq"), F.concat(F.lit("/works/OL"), p, F.lit("W")).alias("key"), F.to_json(work.withField("editions", F.struct(F.col("p_partkey").alias("size"), work["x"]["col1"].alias("entries"))).dropFields("x")).alias("work"), F.to_json(F.struct(F.array(edition(0), edition(1)).alias("entries"))).alias("editions"), F.array(F.struct(F.lit("A").alias("name"))).alias("authors"))


add(
    "e08_api_books",
    lambda cat: batch.api_books(_answers(cat)).select("seq", "title", "open_library_id", "description", "original_publication_year", "primary_cover_url", F.col("series.name").alias("series_name"), F.col("series.position").alias("series_position"), joined("formats"), joined("isbn"), "publisher", "number_of_pages", text_map("external_ids"), F.array_join("genres.name", "|").alias("genres")),
    """
SELECT p AS seq, p_name AS title, 'OL' || p || 'W' AS open_library_id, 'About ' || p_name AS description, CASE WHEN p % 2 = 0 THEN 1984 END AS original_publication_year, 'https://covers.openlibrary.org/b/id/' || p || '-L.jpg' AS primary_cover_url,
  CASE WHEN p % 5 <= 1 THEN p_name END AS series_name, CASE WHEN p % 5 <= 1 AND p % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS series_position, CASE p % 3 WHEN 1 THEN 'ebook' ELSE 'paperback' END AS formats,
  'a0-' || (p % 5) || ',same' || CASE WHEN p % 2 = 0 THEN ',b0-' || p ELSE '' END || ',a1-' || (p % 5) || CASE WHEN p % 2 = 1 THEN ',b1-' || p ELSE '' END AS isbn,
  CASE WHEN p % 4 = best THEN 'pub' || best END AS publisher, CASE WHEN p % 3 = best THEN CAST(p AS INTEGER) END AS number_of_pages, 'goodreads=g' || best || '-' || p AS external_ids, p_type || '|' || p_brand || '|c|d|e' AS genres
FROM (SELECT *, p_partkey AS p, CASE WHEN (p_partkey % 2 = 0)::INT + (p_partkey % 3 = 0)::INT + (p_partkey % 4 = 0)::INT >= (p_partkey % 2 = 1)::INT + (p_partkey % 3 = 1)::INT + (p_partkey % 4 = 1)::INT THEN 0 ELSE 1 END AS best FROM part)
WHERE p_partkey % 13 <> 0""",
)

# ---- editions into books, and fields filled in


def _edition_books(cat: Catalogue) -> DataFrame:
    p = F.col("p_partkey")
    return cat.table("part").where(p % 3 != 0).select(
        F.concat(F.lit("OL"), p, F.lit("W")).alias("open_library_id"), F.when(p % 10 == 0, "fr").otherwise("en").alias("language"), F.col("p_name").alias("title"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug"), F.lit(1900).alias("original_publication_year"), F.array(F.lit("old")).alias("isbn"),
        F.when(p % 2 == 0, 1).alias("number_of_pages"), F.when(p % 5 == 0, "own").alias("publisher"), F.lit(None).cast("string").alias("primary_cover_url"), F.array(F.lit("hardcover")).alias("formats"), F.when(p % 4 == 0, "own-series").alias("series_slug"), F.lit(None).cast("double").alias("series_position"),
    )


def _merged_editions(cat: Catalogue) -> DataFrame:
    from shelfspark.plans import imports

    return ingest.merge_editions(_edition_books(cat), imports.imported_editions(cat), own_titles=False).withColumn("isbn", F.array_join("isbn", "|")).withColumn("formats", joined("formats"))


def _edition_sql() -> str:
    from shelfspark.plans import imports

    own = """SELECT p_partkey AS p, 'OL' || p_partkey || 'W' AS work, CASE WHEN p_partkey % 10 = 0 THEN 'fr' ELSE 'en' END AS language, p_name AS title, replace(p_name, ' ', '-') AS slug, CASE WHEN p_partkey % 2 = 0 THEN 1 END AS pages, CASE WHEN p_partkey % 5 = 0 THEN 'own' END AS pub,
      CASE WHEN p_partkey % 4 = 0 THEN 'own-series' END AS sid FROM part WHERE p_partkey % 3 <> 0"""
    both = f"SELECT o.*, e.edition IS NOT NULL AS hit, e.isbn, e.number_of_pages, e.publisher, e.primary_cover_url, e.format, e.series_position FROM ({own}) o LEFT JOIN ({imports.EDITIONS}) e ON e.work = o.work AND e.language = o.language"
    new = f"SELECT o.*, e.language AS lang, e.isbn, e.number_of_pages, e.publisher, e.primary_cover_url, e.format, e.series_position FROM ({imports.EDITIONS}) e JOIN ({own}) o ON o.work = e.work WHERE o.language = 'en' AND e.language <> 'en'"
    return f"""
SELECT work AS open_library_id, language, title, slug, 1900 AS original_publication_year, CASE WHEN coalesce(isbn, '') <> '' THEN isbn ELSE 'old' END AS isbn, coalesce(pages, number_of_pages) AS number_of_pages, coalesce(pub, publisher) AS publisher, primary_cover_url,
  CASE WHEN hit AND format <> 'hardcover' THEN 'hardcover,' || format ELSE 'hardcover' END AS formats, coalesce(sid, CASE WHEN hit THEN 'saga' END) AS series_slug, series_position FROM ({both})
UNION ALL SELECT work, lang, title, slug, 1900, CASE WHEN isbn <> '' THEN isbn END, number_of_pages, publisher, primary_cover_url, format, 'saga', series_position FROM ({new})"""


add("k11_merge_editions", _merged_editions, _edition_sql())
add(
    "k12_clone_links",
    lambda cat: ingest.clone_links(cat.book_genres, cat.books.where("book_id % 5 = 0").select((F.col("book_id") + 10_000_000).alias("book_id"), F.col("book_id").alias("source_book_id"))),
    sql("SELECT book_id, genre_id FROM book_genres UNION ALL SELECT book_id + 10000000, genre_id FROM book_genres WHERE book_id % 5 = 0"),
)
add(
    "k15_fill_wikidata",
    lambda cat: ingest.fill_wikidata(
        cat.authors.select("author_id", F.when(F.col("author_id") % 3 != 0, F.concat(F.lit("Q"), F.col("author_id"))).alias("wikidata_id"), F.when(F.col("author_id") % 2 == 0, "here").alias("nationality"), F.lit(None).cast("string").alias("birth_place"), F.lit(None).cast("string").alias("wikipedia_url")),
        cat.authors.where("author_id % 4 < 2").select(F.concat(F.lit("Q"), F.col("author_id")).alias("wikidata_id"), F.lit("there").alias("nationality"), F.when(F.col("author_id") % 5 == 0, "town").alias("birth_place"), F.lit(None).cast("string").alias("wikipedia_url")),
    ),
    sql(
        """SELECT author_id, CASE WHEN author_id % 3 <> 0 THEN 'Q' || author_id END AS wikidata_id, CASE WHEN author_id % 2 = 0 THEN 'here' WHEN author_id % 3 <> 0 AND author_id % 4 < 2 THEN 'there' END AS nationality,
  CASE WHEN author_id % 3 <> 0 AND author_id % 4 < 2 AND author_id % 5 = 0 THEN 'town' END AS birth_place, CAST(NULL AS VARCHAR) AS wikipedia_url FROM authors"""
    ),
)
add(
    "k21_partial_update",
    lambda cat: merge.partial_update(
        cat.books.select("book_id", "title", "publisher", "number_of_pages"),
        cat.books.where("book_id % 4 = 0").select("book_id", F.when(F.col("book_id") % 8 == 0, "New").alias("title"), F.lit("new").alias("publisher")).unionByName(cat.spark.createDataFrame([(-1, "nowhere", "x")], "book_id long, title string, publisher string")),
        ["book_id"],
    ),
    sql("SELECT book_id, CASE WHEN book_id % 8 = 0 THEN 'New' ELSE title END AS title, CASE WHEN book_id % 4 = 0 THEN 'new' ELSE publisher END AS publisher, number_of_pages FROM books"),
)
add(
    "k23_delete_authors",
    lambda cat: merge.delete_authors({"authors": cat.authors, "book_authors": cat.book_authors, "books": cat.books}, cat.authors.where("author_id % 4 = 0").select("author_id"))["book_authors"],
    sql("SELECT book_id, author_id FROM book_authors WHERE author_id % 4 <> 0"),
)

# ---- sections read back, and those of entities that have none


def _sections(cat: Catalogue) -> DataFrame:
    """Precomputed sections of books by their authors' and series' books."""
    return similar._listed(similar.more_by_author(cat), "book", "more_by_author").unionByName(similar._listed(similar.more_from_series(cat), "book", "more_from_series"))


def _ranked(pairs: str, order: str, k: int) -> str:
    return f"SELECT source_id, target_id, row_number() OVER (PARTITION BY source_id ORDER BY {order}, target_id) AS rank FROM ({pairs}) QUALIFY rank <= {k}"


BY_AUTHOR = "SELECT DISTINCT a.book_id AS source_id, b.book_id AS target_id, r.avg_rating AS score FROM book_authors a JOIN book_authors b USING (author_id) JOIN rated r ON r.book_id = b.book_id WHERE a.book_id <> b.book_id AND r.listable AND a.book_id {}"
IN_SERIES = "SELECT a.book_id AS source_id, b.book_id AS target_id, b.series_position AS score FROM rated a JOIN rated b ON a.series_id = b.series_id AND a.book_id <> b.book_id WHERE b.listable AND a.book_id {}"
WARM = "IN (SELECT book_id FROM rated WHERE listable AND total_ratings >= 500)"
add(
    "c13_read_sections",
    lambda cat: similar.read_sections(cat, _sections(cat), 5).withColumn("rank", F.col("rank").cast("long")),
    sql(
        f"""
SELECT 'book' AS entity_type, CAST(source_id AS VARCHAR) AS entity_id, section_key, rank, target_id, title, slug FROM (
  SELECT 'more_by_author' AS section_key, * FROM ({_ranked(BY_AUTHOR.format(WARM), 'score DESC NULLS LAST', 5)}) UNION ALL SELECT 'more_from_series', * FROM ({_ranked(IN_SERIES.format(WARM), 'score ASC NULLS LAST', 5)})) JOIN books ON book_id = target_id"""
    ),
)


def _cold(cat: Catalogue) -> DataFrame:
    asked = cat.books.where("book_id % 3 = 0").select(F.lit("book").alias("entity_type"), F.col("book_id").cast("string").alias("entity_id"))
    series = cat.books.where("series_id is not null").select(F.lit("series").alias("entity_type"), F.col("series_id").alias("entity_id"))
    found = similar.cold_sections(cat, asked.unionByName(series).distinct(), _sections(cat).unionByName(series.where("entity_id > 'Brand#3'").select("entity_type", "entity_id", F.lit("x").alias("section_key"), F.array().cast("array<bigint>").alias("similar_ids"))), 5)
    return found.withColumn("similar_ids", F.array_join(F.col("similar_ids").cast("array<string>"), ","))


HAS_SECTION = f"(SELECT source_id FROM ({BY_AUTHOR.format(WARM)}) UNION SELECT source_id FROM ({IN_SERIES.format(WARM)}))"
COLD = f"% 3 = 0 AND a.book_id NOT IN {HAS_SECTION}"
SERIES_AUTHORS = "SELECT DISTINCT s.series_id AS source_id, b.book_id AS target_id, t.avg_rating AS score FROM rated s JOIN book_authors a ON a.book_id = s.book_id JOIN book_authors b USING (author_id) JOIN rated t ON t.book_id = b.book_id WHERE s.series_id <= 'Brand#3' AND t.listable AND t.series_id IS DISTINCT FROM s.series_id"
add(
    "c14_cold_sections",
    _cold,
    sql(
        f"""
SELECT entity_type, entity_id, section_key, string_agg(target_id, ',' ORDER BY rank) AS similar_ids FROM (
  SELECT 'book' AS entity_type, CAST(source_id AS VARCHAR) AS entity_id, 'more_by_author' AS section_key, target_id, rank FROM ({_ranked(BY_AUTHOR.format(COLD), 'score DESC NULLS LAST', 5)})
  UNION ALL SELECT 'book', CAST(source_id AS VARCHAR), 'more_from_series', target_id, rank FROM ({_ranked(IN_SERIES.format(COLD), 'score ASC NULLS LAST', 5)})
  UNION ALL SELECT 'series', source_id, 'more_by_author', target_id, rank FROM ({_ranked(SERIES_AUTHORS, 'score DESC NULLS LAST', 5)})) GROUP BY ALL"""
    ),
)

# ---- user data by key


def _pairs(cat: Catalogue) -> DataFrame:
    """Pairs that users hold, and as many that they may not."""
    held = cat.bookshelves.where("user_id % 10 = 3").select("user_id", "book_id")
    return held.unionByName(held.select("user_id", (F.col("book_id") + 1).alias("book_id"))).unionByName(cat.comments.where("user_id % 10 = 3").select("user_id", "book_id"))


PAIRS = "(SELECT user_id, book_id FROM bookshelves WHERE user_id % 10 = 3 UNION SELECT user_id, book_id + 1 FROM bookshelves WHERE user_id % 10 = 3 UNION SELECT user_id, book_id FROM comments WHERE user_id % 10 = 3)"
add(
    "u09_point_reads",
    lambda cat: userdata.point_reads(cat, _pairs(cat)),
    sql(f"SELECT p.user_id, p.book_id, status, is_favorite, overall_rating, coalesce(n, 0) AS comments FROM {PAIRS} p LEFT JOIN bookshelves USING (user_id, book_id) LEFT JOIN (SELECT user_id, book_id, overall_rating FROM ratings) USING (user_id, book_id) LEFT JOIN (SELECT user_id, book_id, count(*) AS n FROM comments GROUP BY 1, 2) USING (user_id, book_id)"),
)
add(
    "u11_hydrate",
    lambda cat: userdata.hydrate(cat, cat.bookshelves.where("user_id = 7").select(F.row_number().over(_by_book()).alias("position"), "book_id")),
    sql("SELECT CAST(row_number() OVER (ORDER BY book_id) AS INTEGER) AS position, book_id, title, slug, coalesce(primary_cover_url, '') AS cover_url, author_names, author_slugs FROM bookshelves JOIN books USING (book_id) LEFT JOIN names USING (book_id) WHERE user_id = 7"),
)


def _by_book():
    from pyspark.sql import Window

    return Window.partitionBy("user_id").orderBy("book_id")


add(
    "u12_resolved_names",
    lambda cat: userdata.resolved(cat, cat.books.select(F.concat(F.lit("reader"), F.col("book_id") * 2).alias("username"), "slug", F.lit("en").alias("language"))),
    sql("SELECT 'reader' || (b.book_id * 2) AS username, b.slug, 'en' AS language, u.user_id, e.book_id FROM books b LEFT JOIN users u ON u.username = 'reader' || (b.book_id * 2) LEFT JOIN books e ON e.slug = b.slug AND e.language = 'en'"),
)
add("s02_book_by_slug", lambda cat: browse.book_by_slug(cat, cat.books.where("book_id = 8").select("slug").first()[0]).select("book_id", "title"), sql("SELECT book_id, title FROM books WHERE slug = (SELECT slug FROM books WHERE book_id = 8) AND language = 'en'"))

# ---- games

IN_RANGE = "CASE " + " ".join(f"WHEN combined > {t.low} AND combined <= {t.high} AND total_ratings >= {t.ratings} THEN '{t.name}'" for t in sampling.TIERS) + " END"
NEAREST = ", ".join(f"('{t.name}', '{n}', {i})" for t in sampling.TIERS for i, n in enumerate([t.name, *sampling.fallback_order(t.name)]))
add(
    "g04_book_in_range",
    lambda cat: sampling.book_in_range(cat, 3.25, 4.0, 8, SEED),
    sql("SELECT book_id, title, round(combined, 6) AS combined_rating FROM rated WHERE language = 'en' AND total_ratings >= 8 AND combined > 3.25 AND combined <= 4 ORDER BY md5(book_id || ':42'), book_id LIMIT 1"),
)
add(
    "g09_tiers_in_range",
    lambda cat: sampling.tiers_in_range(cat, SEED),
    sql(
        f"""SELECT rolled, arg_min(tier, distance) AS tier, arg_min(book_id, distance) AS book_id FROM (VALUES {NEAREST}) n(rolled, tier, distance)
JOIN (SELECT {IN_RANGE} AS tier, arg_min(book_id, {{'m': md5(book_id || ':42'), 'b': book_id}}) AS book_id FROM rated WHERE language = 'en' GROUP BY 1) USING (tier) GROUP BY 1"""
    ),
)

# ---- text

ACCENTS = [("José Ñandú", "jose-nandu"), ("Œuvre Straße", "oeuvre-strasse"), ("Łódź Ørsted", "lodz-orsted"), ("Война и мир", "voina-i-mir"), ("Οδύσσεια", "odusseia"), ("Ça va, Zoë!", "ca-va-zoe")]
add(
    "z01_slug_scripts",
    lambda cat: cat.books.select("book_id", X.slug_ascii(F.concat(F.coalesce(*[F.when(F.col("book_id") % len(ACCENTS) == i, F.lit(a)) for i, (a, _) in enumerate(ACCENTS)]), F.lit(" "), F.col("title"))).alias("slug")),
    sql("SELECT book_id, CASE " + " ".join(f"WHEN book_id % {len(ACCENTS)} = {i} THEN '{b}'" for i, (_, b) in enumerate(ACCENTS)) + " END || '-' || replace(lower(title), ' ', '-') AS slug FROM books"),
)
add(
    "z02_clean_descriptions",
    lambda cat: cat.books.select("book_id", T.clean_description(F.concat(F.lit("  <b>"), F.col("title"), F.lit("</b> &amp; [1] more: https://x.org/y  **bold** _it_\n\n\n\nend\n-----\ngone"))).alias("text")),
    sql("SELECT book_id, title || ' & more: bold it' || chr(10) || chr(10) || 'end' AS text FROM books"),
)
add(
    "q04_analyzer",
    lambda cat: cat.books.select("book_id", F.array_join(search.stemmed(search.terms(F.concat(F.lit("Crème_brûlée STORIES, running "), F.col("book_id").cast("string")))), " ").alias("terms")),
    sql("SELECT book_id, 'creme brule stori run ' || book_id AS terms FROM books"),
)
add("d02b_irrelevant_authors", lambda cat: cleanup.low_relevance_authors(_with_unread(cat), few_books=12, few=6000), sql("SELECT author_id, CAST(0 AS BIGINT) AS books FROM (SELECT s_suppkey + 1000000 AS author_id FROM supplier WHERE s_suppkey % 2 = 0)"))


def _with_unread(cat: Catalogue):
    """The catalogue with authors of no book and no view added."""

    class Wider:
        books, book_authors, bookshelves, spark = cat.books, cat.book_authors, cat.bookshelves, cat.spark
        authors = cat.authors.where("view_count > 0").unionByName(cat.authors.where("author_id % 2 = 0").select((F.col("author_id") + 1_000_000).alias("author_id"), "name", "slug", "photo_url", F.lit(0).cast("long").alias("view_count")))

    return Wider


add(
    "x09_author_arrays",
    lambda cat: browse.author_arrays(cat).select("book_id", F.to_json("authors").alias("authors")),
    sql("SELECT book_id, coalesce(a, '[]') AS authors FROM books LEFT JOIN (SELECT book_id, CAST(to_json(list({'author_id': author_id, 'name': name, 'slug': slug, 'photo_url': coalesce(photo_url, '')} ORDER BY author_id)) AS VARCHAR) AS a FROM book_authors JOIN authors USING (author_id) GROUP BY 1) USING (book_id)"),
)

# ---- searches, comments and cases in other forms


def _federated_sql(query: str, stemmed: tuple[str, ...] = ()) -> str:
    """Hits of books, the first twenty authors and series, and these two's best books at a fixed score."""
    from shelfspark.plans import queries as q

    books = q.hits_sql("book", q.ORACLE_SQL["q01_book_docs"], "book_id", "title", q.BOOK_FIELDS, query, stemmed)
    authors = q.hits_sql("author", q.ORACLE_SQL["q02_author_rollup"], "author_id", "name", q.NAME_FIELDS, query)
    series = q.hits_sql("series", q.ORACLE_SQL["q03_series_rollup"], "series_id", "name", q.NAME_FIELDS, query)
    best = "SELECT book_id, title FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY total_ratings DESC, avg_rating DESC NULLS LAST, book_id) AS nth FROM {t} WHERE language = 'en') WHERE nth <= 3"
    return sql(
        f"""
SELECT type, id, max(title) AS title, max(score) AS score FROM (
  SELECT * FROM b UNION ALL SELECT * FROM a UNION ALL SELECT * FROM s
  UNION ALL SELECT 'book', CAST(book_id AS VARCHAR), title, 0.4::DOUBLE FROM ({best.format(k='author_id', t='book_authors JOIN rated USING (book_id) JOIN (SELECT CAST(id AS BIGINT) AS author_id FROM a) USING (author_id)')})
  UNION ALL SELECT 'book', CAST(book_id AS VARCHAR), title, 0.4::DOUBLE FROM ({best.format(k='series_id', t='rated JOIN (SELECT id AS series_id FROM s) USING (series_id)')}))
GROUP BY 1, 2 ORDER BY score DESC, type, id LIMIT 10""",
        b=books,
        a=f"SELECT * FROM ({authors}) ORDER BY score DESC, id LIMIT 20",
        s=f"SELECT * FROM ({series}) ORDER BY score DESC, id LIMIT 20",
    )


def add_after_queries() -> None:
    """Queries whose SQL is made of that of queries registered before."""
    from shelfspark.plans import queries as q

    for key, query in (("q09b_search_unstemmed", "gren brand"), ("q09c_search_names", "supplier 12")):
        add(key, lambda cat, query=query: search.federated(cat, query, stem=False, index=q._index(cat)), _federated_sql(query))
    ORACLE_SQL["q09_search"] = _federated_sql("green large", search.STEMMED)
    add("g06_cases", _cases, _cases_sql())


def _rated_comments(cat: Catalogue) -> DataFrame:
    """Comments of the shelves' own users, so that some have ratings, by exact rating."""
    said = cat.ratings.where("user_id % 3 = 0").select((F.col("user_id") * 1_000_000 + F.col("book_id")).alias("comment_id"), "user_id", "book_id", F.lit("x").alias("body"), (F.col("book_id") % 2 == 0).alias("is_spoiler"), F.timestamp_seconds(F.col("book_id")).alias("created_at"))

    class Wider:
        comments, ratings, users = said, cat.ratings, cat.users

    return userdata.book_comments(Wider, rating=4.5, limit=3)


add(
    "u08_exact_rating",
    _rated_comments,
    sql(
        """SELECT book_id, CAST(position AS INTEGER) AS position, comment_id, username, overall_rating, is_spoiler, total FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY overall_rating DESC NULLS LAST, created_at DESC, comment_id DESC) AS position, count(*) OVER (PARTITION BY book_id) AS total
  FROM (SELECT user_id * 1000000 + book_id AS comment_id, book_id, coalesce(username, '') AS username, overall_rating, book_id % 2 = 0 AS is_spoiler, to_timestamp(book_id) AS created_at FROM ratings LEFT JOIN users USING (user_id) WHERE user_id % 3 = 0 AND overall_rating = 4.5)) WHERE position <= 3"""
    ),
)


def _cases(cat: Catalogue) -> DataFrame:
    """A case for each user: the winner of a spin."""
    return sampling.spins(cat, SEED).select("user_id", "tier", "book_id")


def _cases_sql() -> str:
    from shelfspark.plans import queries as q

    return f"SELECT user_id, tier, book_id FROM ({q.ORACLE_SQL['g10_slots']})"


# ---- input that is damaged, phases that are resumed, streams that go on


def _damaged(cat: Catalogue) -> DataFrame:
    """Dump lines of authors of which some are cut off, lack fields, or are of another kind."""
    from shelfspark.plans import imports

    lines = imports.author_lines(cat).select("value", F.regexp_extract("value", r"OL(\d+)A", 1).cast("long").alias("n"))
    damaged = F.when(F.col("n") % 4 == 0, F.substring("value", 1, 40)).when(F.col("n") % 4 == 1, F.replace("value", F.lit("\t"), F.lit(" "))).when(F.col("n") % 4 == 2, F.replace("value", F.lit("/type/author"), F.lit("/type/edition"))).otherwise(F.col("value"))
    return dumps.records(lines.select(damaged.alias("value")), "/type/author", dumps.AUTHOR).select("key", "name")


add("s04_damaged_lines", _damaged, "SELECT '/authors/OL' || s_suppkey || 'A' AS key, s_name AS name FROM supplier WHERE s_suppkey % 4 = 3")


def _phases(cat: Catalogue) -> DataFrame:
    """Which phases run: a broken run first, then the resumed one, then one with nothing left to do."""
    root = f"{shared_dir(cat.spark)}/phases-{uuid.uuid4().hex}"
    first = lambda: cat.genres.select("genre_id")
    second = lambda: cat.spark.read.parquet(f"{root}/genres").agg(F.count("*").alias("n"))

    def broken() -> DataFrame:
        raise OSError("broken off")

    runs = []
    for phases in ({"genres": first, "counts": broken}, {"genres": first, "counts": second}, {"genres": first, "counts": second}):
        try:
            runs.append(ingest.run_phases(phases, root, cat.spark))
        except OSError:
            runs.append(["broken"])
    found = cat.spark.read.parquet(f"{root}/counts")
    return found.select(F.lit("/".join("+".join(r) for r in runs)).alias("runs"), "n")


add("e07_resumed_phases", _phases, sql("SELECT 'broken/counts/' AS runs, count(*) AS n FROM genres"))


def _resumed_views(cat: Catalogue) -> DataFrame:
    """Views counted by a stream that takes one file at a time, ends, and goes on when more files are there."""
    root = f"{shared_dir(cat.spark)}/resumed-{uuid.uuid4().hex}"
    events, made = cat.table("events"), BucketedTable(cat.spark, f"{root}/table", ["entity_id"])
    for part in range(4):
        events.where(F.col("event_id") % 4 == part).coalesce(1).write.mode("append").parquet(f"{root}/in")
        if part % 2:
            stream = counters.event_stream(cat.spark, f"{root}/in", 1)
            counters.drain(counters.view_counts(stream), counters.fold_counts(made), f"{root}/checkpoint")
    return made.read().select("entity_id", "view_count")


add("m05_resumed_views", _resumed_views, """SELECT CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS entity_id, count(*) AS view_count FROM events WHERE event_type = 'view' GROUP BY 1""")
