"""Queries of the import: dump lines made of the test tables go through the readers and phases, and SQL states what has to
come out; and the parsers' expressions, each over a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import expressions as X
from shelfspark.operators import ingest, merge
from shelfspark.operators.common import in_line_tasks
from shelfspark.plans.oracle import sql
from shelfspark.sources import dumps
from shelfspark.sources.catalogue import Catalogue, catalogue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def add(key: str, build: Callable[[Catalogue], DataFrame], oracle: str) -> None:
    QUERIES[key] = lambda spark, sf_dir: build(catalogue(spark, sf_dir))
    ORACLE_SQL[key] = oracle


def line(kind: str, key: Column, *fields: Column) -> Column:
    """A dump line."""
    return F.concat_ws("\t", F.lit(f"/type/{kind}"), key, F.lit("1"), F.lit("2020-01-01"), F.to_json(F.struct(key.alias("key"), *fields)))


def _id(kind: str, number: Column | str, letter: str) -> Column:
    return F.concat(F.lit(f"/{kind}/OL"), (F.col(number) if isinstance(number, str) else number).cast("string"), F.lit(letter))


# ---- authors


def author_lines(cat: Catalogue) -> DataFrame:
    s, name = F.col("s_suppkey"), F.col("s_name")
    return in_line_tasks(cat.table("supplier"), "s_suppkey").select(
        line(
            "author",
            _id("authors", s, "A"),
            name.alias("name"),
            F.when(s % 3 != 0, F.concat(F.lit("Bio of "), name)).alias("bio"),
            F.when(s % 4 == 1, "1931").when(s % 4 == 2, "1900-07-01").when(s % 4 == 3, "unknown").alias("birth_date"),
            F.when(s % 5 == 0, F.array(F.lit(-1))).otherwise(F.array(F.lit(-1), s + 100)).alias("photos"),
            F.struct(F.concat(F.when(s % 2 == 0, "Q").otherwise("bad"), s).alias("wikidata"), F.lit("").alias("viaf")).alias("remote_ids"),
            F.when(s % 7 == 0, F.array(F.concat(F.lit("alt "), name))).otherwise(F.array().cast("array<string>")).alias("alternate_names"),
        ).alias("value")
    )


def imported_authors(cat: Catalogue) -> DataFrame:
    return ingest.authors(dumps.records(author_lines(cat), "/type/author", dumps.AUTHOR))


AUTHORS = """
  SELECT 'OL' || s_suppkey || 'A' AS open_library_id, s_name AS name, regexp_replace(lower(s_name), '[^a-z0-9_-]', '', 'g') AS slug,
    CASE WHEN s_suppkey % 3 <> 0 THEN 'Bio of ' || s_name END AS bio,
    CASE s_suppkey % 4 WHEN 1 THEN '1931-01-01' WHEN 2 THEN '1900-07-01' END AS birth_date,
    CASE WHEN s_suppkey % 5 <> 0 THEN 'https://covers.openlibrary.org/a/id/' || (s_suppkey + 100) || '-L.jpg' END AS photo_url,
    CASE WHEN s_suppkey % 2 = 0 THEN 'Q' || s_suppkey END AS wikidata_id,
    CAST((s_suppkey % 3 <> 0)::INT + (s_suppkey % 5 <> 0)::INT + (s_suppkey % 2 = 0)::INT + (s_suppkey % 4 IN (1, 2))::INT + (s_suppkey % 7 = 0)::INT AS INTEGER) AS score
  FROM supplier"""
add(
    "e01_authors",
    lambda cat: imported_authors(cat).select("open_library_id", "name", "slug", "bio", F.col("birth_date").cast("string").alias("birth_date"), "photo_url", "wikidata_id", "score"),
    f"SELECT * FROM ({AUTHORS}) WHERE score >= 2",
)



def _known_authors(cat: Catalogue) -> DataFrame:
    """Authors of even number as a table that was there before the import."""
    s = F.col("s_suppkey")
    return cat.table("supplier").where(s % 2 == 0).select(
        X.slug_ascii(F.col("s_name")).alias("slug"), F.lit("old").alias("open_library_id"), F.when(s % 4 == 0, "old bio").alias("bio"), F.when(s % 3 == 0, "old photo").alias("photo_url"), s.cast("string").alias("view_count")
    )


add(
    "k07_merge_authors",
    lambda cat: ingest.merge_authors(_known_authors(cat), imported_authors(cat)),
    f"""
SELECT slug, coalesce(n.open_library_id, o.open_library_id) AS open_library_id, coalesce(o.bio, n.bio) AS bio, coalesce(o.photo_url, n.photo_url) AS photo_url, CAST(view_count AS VARCHAR) AS view_count
FROM (SELECT regexp_replace(lower(s_name), '[^a-z0-9_-]', '', 'g') AS slug, 'old' AS open_library_id, CASE WHEN s_suppkey % 4 = 0 THEN 'old bio' END AS bio, CASE WHEN s_suppkey % 3 = 0 THEN 'old photo' END AS photo_url, s_suppkey AS view_count FROM supplier WHERE s_suppkey % 2 = 0) o
FULL JOIN (SELECT * FROM ({AUTHORS}) WHERE score >= 2) n USING (slug)""",
)
add(
    "k10_insert_links",
    lambda cat: merge.insert_links(cat.book_authors, cat.book_authors.select((F.col("book_id") + 1).alias("book_id"), "author_id")),
    sql("SELECT book_id, author_id FROM book_authors UNION SELECT book_id + 1, author_id FROM book_authors"),
)
add(
    "k23_delete_series",
    lambda cat: merge.unlink_series(cat.books.select("book_id", "series_id", "series_position"), cat.books.where("book_id % 30 = 0").select("series_id")),
    sql("SELECT book_id, CASE WHEN gone IS NULL THEN series_id END AS series_id, CASE WHEN gone IS NULL THEN series_position END AS series_position FROM books LEFT JOIN (SELECT DISTINCT series_id AS gone FROM books WHERE book_id % 30 = 0) ON gone = series_id"),
)
add(
    "e10_enrichment",
    lambda cat: ingest.enrichment_candidates(cat.books),
    sql("SELECT book_id, title FROM books WHERE description IS NULL OR length(description) < 100 ORDER BY ol_already_read_count DESC NULLS LAST, book_id LIMIT 5"),
)

# ---- works


def work_lines(cat: Catalogue) -> DataFrame:
    """Works of two authors each; some name none but an unknown one. Titles repeat."""
    p = F.col("p_partkey")
    author = lambda number: F.struct(F.struct(_id("authors", number, "A").alias("key")).alias("author"))
    return in_line_tasks(cat.table("part"), "p_partkey").select(
        line(
            "work",
            _id("works", p, "W"),
            F.concat("p_name", F.lit(" "), (p % 10).cast("string")).alias("title"),
            F.when(p % 6 != 0, F.struct(F.concat(F.lit("About "), F.col("p_name")).alias("value"))).alias("description"),
            F.when(p % 10 != 0, F.array(p)).otherwise(F.array().cast("array<bigint>")).alias("covers"),
            F.when(p % 8 != 0, F.array("p_type", "p_brand", F.lit("one"), F.lit("two"), F.lit("three"), F.lit("four"))).alias("subjects"),
            F.when(p % 3 == 0, "1984").when(p % 3 == 1, "1984-07-01").otherwise("May 1984").alias("first_publish_date"),
            F.when(p % 7 == 0, F.array(author(p + 10_000_000))).otherwise(F.array(author(p % 10 + 1), author(p % 4 + 1))).alias("authors"),
        ).alias("value")
    )


def imported_works(cat: Catalogue) -> DataFrame:
    return ingest.works(dumps.records(work_lines(cat), "/type/work", dumps.WORK), imported_authors(cat))


WORKS = f"""
  SELECT * FROM (
    SELECT 'OL' || p_partkey || 'W' AS open_library_id, p_name || ' ' || (p_partkey % 10) AS title, replace(p_name, ' ', '-') || '-' || (p_partkey % 10) AS slug,
      CASE WHEN p_partkey % 6 <> 0 THEN 'About ' || p_name END AS description,
      CASE WHEN p_partkey % 10 <> 0 THEN 'https://covers.openlibrary.org/b/id/' || p_partkey || '-L.jpg' END AS primary_cover_url,
      CASE WHEN p_partkey % 3 <> 2 THEN 1984 END AS original_publication_year,
      CASE WHEN p_partkey % 8 <> 0 THEN p_type || '|' || p_brand || '|one|two|three' ELSE '' END AS genres,
      (SELECT string_agg(DISTINCT slug, '|' ORDER BY slug) FROM ({AUTHORS}) WHERE score >= 2 AND p_partkey % 7 <> 0 AND open_library_id IN ('OL' || (p_partkey % 10 + 1) || 'A', 'OL' || (p_partkey % 4 + 1) || 'A')) AS authors,
      CAST((p_partkey % 6 <> 0)::INT + (p_partkey % 10 <> 0)::INT + (p_partkey % 8 <> 0)::INT AS INTEGER) AS score
    FROM part)
  WHERE score >= 2 AND authors IS NOT NULL QUALIFY row_number() OVER (PARTITION BY slug ORDER BY open_library_id DESC) = 1"""
add(
    "e03_works",
    lambda cat: imported_works(cat).select(
        "open_library_id", "title", "slug", "description", "primary_cover_url", "original_publication_year", F.array_join("genres", "|").alias("genres"), F.array_join("author_slugs", "|").alias("authors"), "score"
    ),
    WORKS,
)

# ---- editions


def edition_lines(cat: Catalogue) -> DataFrame:
    order, n = F.col("l_orderkey"), F.col("l_linenumber")
    key = lambda kind, name: F.array(F.struct(F.lit(f"/{kind}/{name}").alias("key")))
    return cat.table("lineitem").select(
        line(
            "edition",
            _id("books", order * 10 + n, "M"),
            F.concat(F.lit("Line "), n.cast("string")).alias("title"),
            F.array(F.struct(_id("works", "l_partkey", "W").alias("key"))).alias("works"),
            F.when(F.col("l_returnflag") == "R", key("languages", "eng")).when(F.col("l_returnflag") == "N", key("languages", "ger")).when(n == 1, key("languages", "xyz")).alias("languages"),
            F.when(n % 3 != 0, F.array(F.concat(F.lit("978"), (order % 50).cast("string")))).alias("isbn_13"),
            F.when(n % 2 == 0, F.array(F.concat(n.cast("string"), F.lit("X")), F.concat((order % 7).cast("string"), F.lit("X")))).alias("isbn_10"),
            F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("int") * 10).otherwise(0).alias("number_of_pages"),
            F.when(F.col("l_suppkey") % 2 == 0, F.array(F.concat(F.lit("pub"), F.col("l_suppkey").cast("string")))).alias("publishers"),
            F.when(order % 3 == 0, F.array(order + 1)).alias("covers"),
            F.when(n % 2 == 1, "Hardcover").when(n == 2, "Kindle Edition").alias("physical_format"),
            F.array(F.concat(F.lit("Saga"), F.when(n % 2 == 0, F.concat(F.lit(" #"), n.cast("string"))).otherwise(""))).alias("series"),
        ).alias("value")
    )


def imported_editions(cat: Catalogue) -> DataFrame:
    known = cat.table("part").where("p_partkey % 3 <> 0").select(F.concat(F.lit("OL"), F.col("p_partkey"), F.lit("W")).alias("open_library_id"))
    return ingest.best_editions(dumps.records(edition_lines(cat), "/type/edition", dumps.EDITION), known)


EDITIONS = """
WITH e AS (
  SELECT 'OL' || l_partkey || 'W' AS work, CASE WHEN l_returnflag = 'N' THEN 'de' ELSE 'en' END AS language, '/books/OL' || (l_orderkey * 10 + l_linenumber) || 'M' AS key, l_orderkey AS o, l_linenumber AS n, l_suppkey AS s,
    CASE WHEN l_quantity > 25 THEN CAST(l_quantity AS INTEGER) * 10 END AS pages,
    (CASE WHEN l_linenumber % 3 <> 0 THEN ['978' || (l_orderkey % 50)] ELSE [] END) || (CASE WHEN l_linenumber % 2 = 0 THEN [l_linenumber || 'X', (l_orderkey % 7) || 'X'] ELSE [] END) AS isbns
  FROM lineitem WHERE l_partkey % 3 <> 0),
r AS (SELECT *, CAST((len(isbns) > 0)::INT + (pages IS NOT NULL)::INT + (s % 2 = 0)::INT + (o % 3 = 0)::INT + (n % 2 = 1 OR n = 2)::INT AS INTEGER) AS score FROM e),
i AS (SELECT work, language, isbn, row_number() OVER (PARTITION BY work, language ORDER BY place) AS nth FROM (
  SELECT work, language, isbn, min(nth * 10 + pos) AS place FROM (
    SELECT work, language, unnest(isbns) AS isbn, generate_subscripts(isbns, 1) AS pos, nth FROM (SELECT *, row_number() OVER (PARTITION BY work, language ORDER BY score DESC, key) AS nth FROM r)) GROUP BY ALL)),
l AS (SELECT work, language, string_agg(isbn, '|' ORDER BY nth) AS isbn FROM i WHERE nth <= 20 GROUP BY ALL)
SELECT work, language, key[8:] AS edition, 'Line ' || n AS title, score, pages AS number_of_pages, CASE WHEN s % 2 = 0 THEN 'pub' || s END AS publisher,
  CASE WHEN o % 3 = 0 THEN 'https://covers.openlibrary.org/b/id/' || (o + 1) || '-L.jpg' END AS primary_cover_url,
  CASE WHEN n % 2 = 1 THEN 'hardcover' WHEN n = 2 THEN 'ebook' ELSE 'paperback' END AS format, 'Saga' AS series, CASE WHEN n % 2 = 0 THEN CAST(n AS DOUBLE) END AS series_position, coalesce(isbn, '') AS isbn
FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY work, language ORDER BY score DESC, key) = 1) LEFT JOIN l USING (work, language)
"""
add("e04_editions", lambda cat: imported_editions(cat).drop("description").withColumn("isbn", F.array_join("isbn", "|")), EDITIONS)
add(
    "z12_edition_scores",
    lambda cat: dumps.records(edition_lines(cat), "/type/edition", dumps.EDITION).select("key", ingest.edition_score().alias("score")),
    """
SELECT '/books/OL' || (l_orderkey * 10 + l_linenumber) || 'M' AS key,
  CAST((l_linenumber % 3 <> 0 OR l_linenumber % 2 = 0)::INT + (l_quantity > 25)::INT + (l_suppkey % 2 = 0)::INT + (l_orderkey % 3 = 0)::INT + (l_linenumber % 2 = 1 OR l_linenumber = 2)::INT AS INTEGER) AS score
FROM lineitem""",
)
add(
    "z26_isbn_union",
    lambda cat: ingest.first_isbns(
        cat.table("lineitem").select(
            F.col("l_partkey").alias("work"), F.lit("en").alias("language"), F.col("l_linenumber").alias("score"), F.col("l_orderkey").alias("key"), F.array(F.col("l_suppkey").cast("string")).alias("isbn_13"), F.array(F.col("l_returnflag")).alias("isbn_10")
        )
    ).select("work", F.array_join("isbn", "|").alias("isbn")),
    """
SELECT work, string_agg(isbn, '|' ORDER BY nth) AS isbn FROM (
  SELECT work, isbn, row_number() OVER (PARTITION BY work ORDER BY first, isbn) AS nth FROM (
    SELECT work, isbn, min({'k': -n, 'key': o, 'pos': pos}) AS first
    FROM (SELECT l_partkey AS work, l_linenumber AS n, l_orderkey AS o, unnest([CAST(l_suppkey AS VARCHAR), l_returnflag]) AS isbn, unnest([0, 1]) AS pos FROM lineitem) GROUP BY work, isbn))
WHERE nth <= 20 GROUP BY work""",
)

# ---- ratings and reading logs


def work_ratings(cat: Catalogue) -> DataFrame:
    lines = cat.table("lineitem").select(F.concat_ws("\t", _id("works", "l_partkey", "W"), F.lit(""), F.col("l_linenumber").cast("string"), F.lit("2020")).alias("value"))
    return ingest.work_ratings(dumps.ratings(lines))


def work_shelves(cat: Catalogue) -> DataFrame:
    flag = F.col("l_returnflag")
    shelf = F.when(F.col("l_linenumber") == 7, "Lost").when(flag == "R", "Already Read").when(flag == "N", "Want to Read").otherwise("Currently Reading")
    return ingest.work_shelves(dumps.reading_log(cat.table("lineitem").select(F.concat_ws("\t", _id("works", "l_partkey", "W"), F.lit(""), shelf, F.lit("2020")).alias("value"))))


RATINGS = "SELECT 'OL' || l_partkey || 'W' AS work, count(*) AS ol_rating_count, ((sum(l_linenumber) * 200 + count(*)) // (count(*) * 2))::DOUBLE / 100 AS ol_avg_rating FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1"
SHELVES = "SELECT 'OL' || l_partkey || 'W' AS work, " + ", ".join(f"count(*) FILTER (WHERE l_returnflag = '{f}' AND l_linenumber <> 7) AS ol_{n}_count" for f, n in (("N", "want_to_read"), ("A", "currently_reading"), ("R", "already_read"))) + " FROM lineitem GROUP BY 1 HAVING count(*) FILTER (WHERE l_linenumber <> 7) > 0"
add("e05_ratings", work_ratings, RATINGS)
add("e06_reading_log", work_shelves, SHELVES)


def _counted_books(cat: Catalogue) -> DataFrame:
    return cat.table("part").select(F.concat(F.lit("OL"), F.col("p_partkey"), F.lit("W")).alias("open_library_id"), F.lit(3).cast("long").alias("ol_rating_count"), F.lit(2.5).alias("ol_avg_rating"), F.lit(9).cast("long").alias("ol_already_read_count"))


add(
    "k13_update_ratings",
    lambda cat: ingest.apply_counts(_counted_books(cat), work_ratings(cat).where("ol_rating_count % 2 = 0")),
    f"SELECT 'OL' || p_partkey || 'W' AS open_library_id, coalesce(r.ol_rating_count, 3) AS ol_rating_count, coalesce(r.ol_avg_rating, 2.5::DOUBLE) AS ol_avg_rating, 9::BIGINT AS ol_already_read_count FROM part LEFT JOIN (SELECT * FROM ({RATINGS}) WHERE ol_rating_count % 2 = 0) r ON work = 'OL' || p_partkey || 'W'",
)
add(
    "k14_reset_shelves",
    lambda cat: ingest.apply_counts(_counted_books(cat), work_shelves(cat).select("work", "ol_already_read_count").where("ol_already_read_count % 2 = 1"), reset=True).select("open_library_id", "ol_already_read_count"),
    f"SELECT 'OL' || p_partkey || 'W' AS open_library_id, coalesce(s.ol_already_read_count, 0) AS ol_already_read_count FROM part LEFT JOIN (SELECT * FROM ({SHELVES}) WHERE ol_already_read_count % 2 = 1) s ON work = 'OL' || p_partkey || 'W'",
)

# ---- parsers


def parsed(key: str, value: Callable[[Column, Column], Column], expected: str) -> None:
    """A query that applies an expression of a part's key and name over part."""
    add(key, lambda cat: cat.table("part").select("p_partkey", value(F.col("p_partkey"), F.col("p_name")).alias("value")), f"SELECT p_partkey, {expected} AS value FROM part")


parsed("z03_dates", lambda p, name: X.parse_date(F.when(p % 4 == 0, "1984").when(p % 4 == 1, "July 4, 1976").when(p % 4 == 2, "not a date")).cast("string"), "CASE p_partkey % 4 WHEN 0 THEN '1984-01-01' WHEN 1 THEN '1976-07-04' END")
parsed("z04_series_position", lambda p, name: X.clamp_position(F.when(p % 5 == 0, "x").otherwise((p * 7 - 100).cast("string"))), "CASE WHEN p_partkey % 5 <> 0 AND p_partkey * 7 - 100 BETWEEN 0 AND 999 THEN CAST(p_partkey * 7 - 100 AS DOUBLE) END")
add(
    "z05_text_value",
    lambda cat: cat.table("part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.to_json(F.struct(F.col("p_name").alias("value")))).alias("raw")).select("p_partkey", dumps.text_value("raw").alias("value")),
    "SELECT p_partkey, p_name AS value FROM part",
)
parsed("z06_cover_url", lambda p, name: ingest.picture(F.array(F.lit(-1), p % 3, p), ingest.COVER), "CASE WHEN p_partkey > 0 THEN 'https://covers.openlibrary.org/b/id/' || (CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 3 ELSE p_partkey END) || '-L.jpg' END")
parsed("z07_remote_ids", lambda p, name: F.array_join(F.array_sort(F.map_keys(F.map_filter(F.create_map(F.lit("a"), name, F.lit("b"), F.when(p % 2 == 0, "").otherwise("q"), F.lit("c"), F.when(p % 3 == 0, "x")), lambda _, v: X.filled(v)))), ","), "'a' || CASE WHEN p_partkey % 2 = 1 THEN ',b' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN ',c' ELSE '' END")
parsed("z08_languages", lambda p, name: ingest.language_of(F.when(p % 5 == 0, "/languages/eng").when(p % 5 == 1, "/languages/ger").when(p % 5 == 2, "/languages/fre").when(p % 5 == 3, "/languages/xxx")), "CASE p_partkey % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'fr' END")


def series(p: Column) -> Column:
    return F.concat("p_brand", F.when(p % 3 == 0, F.concat(F.lit(" #"), F.col("p_size"))).when(p % 3 == 1, F.concat(F.lit(", "), F.col("p_size"), F.lit(".5"))).otherwise(""))


SERIES_SQL = "(p_brand || CASE p_partkey % 3 WHEN 0 THEN ' #' || p_size WHEN 1 THEN ', ' || p_size || '.5' ELSE '' END)"
SERIES_PATTERN = r"'^(.+?)(?:\s*[#,]\s*(\d+(?:\.\d+)?))?$'"
parsed("z09_series_names", lambda p, name: X.series_name(series(p)), f"regexp_extract({SERIES_SQL}, {SERIES_PATTERN}, 1)")
parsed("z09_series_numbers", lambda p, name: X.series_number(series(p)), f"TRY_CAST(regexp_extract({SERIES_SQL}, {SERIES_PATTERN}, 2) AS DOUBLE)")
parsed("z10_work_numbers", lambda p, name: X.work_number(F.concat(F.lit("OL"), F.when(p % 4 == 0, "x").otherwise(p.cast("string")), F.lit("W"))), "CASE WHEN p_partkey % 4 <> 0 THEN p_partkey END")
parsed("z11_qids", lambda p, name: X.is_qid(F.when(p % 3 == 0, F.concat(F.lit("Q"), p)).when(p % 3 == 1, F.concat(p, F.lit("Q")))), "p_partkey % 3 = 0")
parsed("z14_formats", lambda p, name: X.book_format(F.when(p % 6 == 0, "Hardcover").when(p % 6 == 1, "Softcover book").when(p % 6 == 2, "KINDLE").when(p % 6 == 3, "Audio CD").when(p % 6 == 4, name)), "CASE p_partkey % 6 WHEN 0 THEN 'hardcover' WHEN 2 THEN 'ebook' WHEN 3 THEN 'audiobook' ELSE 'paperback' END")
parsed("z15_years", lambda p, name: X.year_of(F.when(p % 3 == 0, "1984-07-01").when(p % 3 == 1, "2001").otherwise("May 1984")), "CASE p_partkey % 3 WHEN 0 THEN 1984 WHEN 1 THEN 2001 END")
parsed("z20_labels", lambda p, name: X.title_label(F.replace(name, F.lit(" "), F.lit("-"))), "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')")
parsed("z24_usernames", lambda p, name: X.username_candidate(F.concat(F.lit("__"), F.upper(name), F.lit("!! "), p)), r"replace(lower(p_name), ' ', '_') || '_' || p_partkey")
