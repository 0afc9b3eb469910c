"""Queries of whole jobs: imports in batches, dumps read from a record on, refreshed lists, dates in free text, packs."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.dates import fuzzy_date
from shelfspark.operators import jobs, lists, sampling, search, similar
from shelfspark.plans import merges
from shelfspark.plans.oracle import sql
from shelfspark.sources import dumps
from shelfspark.sources.catalogue import Catalogue, catalogue, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SEED = 42


def add(key: str, build: Callable[[Catalogue], DataFrame], oracle: str | None = None) -> None:
    QUERIES[key] = lambda spark, sf_dir: build(catalogue(spark, sf_dir))
    if oracle:
        ORACLE_SQL[key] = oracle


def root(cat: Catalogue, name: str) -> str:
    return f"{shared_dir(cat.spark)}/{name}-{uuid.uuid4().hex}"


# ---- E9: imports in batches

KINDS = {
    "genres": "slug string, name string",
    "series": "slug string, name string, description string",
    "authors": "slug string, name string, bio string",
    "books": "language string, slug string, title string, description string, first_sentence string, original_publication_year int, primary_cover_url string, open_library_id string, series_slug string, series_position double, formats array<string>, isbn array<string>, publisher string, number_of_pages int, external_ids map<string,string>",
    "book_genres": "language string, slug string, genre_slug string",
    "book_authors": "language string, slug string, author_slug string",
}
BATCH = 1200


def import_source(cat: Catalogue) -> DataFrame:
    """Records of two sources; the third record is broken."""
    records = merges._records(cat).withColumn("source", F.when(F.col("seq") % 3 == 0, "dump").otherwise("api"))
    return records.withColumn("title", F.when(F.col("seq") == 3, F.raise_error(F.lit("record 3 is broken")).cast("string")).otherwise(F.col("title")))


def _ingested(cat: Catalogue) -> DataFrame:
    """Books by title, their genres, and the batches set aside, after two runs over the same records."""
    job, records = jobs.ImportJob(cat.spark, root(cat, "import"), KINDS, BATCH, 4), import_source(cat)
    taken = [job.run(records) for _ in range(2)]
    books = job.table("books").select(F.lit("books").alias("table"), F.concat_ws("/", "language", "slug").alias("key"), F.col("title").alias("value"))
    genres = job.table("book_genres").select(F.lit("book_genres"), F.concat_ws("/", "language", "slug"), "genre_slug")
    dead = job.dead_letters().select(F.lit("dead"), F.concat_ws("/", "source", "batch"), F.concat("records", F.lit(" "), F.col("error").contains("record 3 is broken").cast("string")))
    again = cat.spark.range(1).select(F.lit("second run"), F.lit("batches"), F.lit(str(len(taken[1]))))
    return books.union(genres).union(dead).union(again)


SOURCED = f"SELECT *, CASE WHEN seq % 3 = 0 THEN 'dump' ELSE 'api' END AS source, seq // {BATCH} AS batch FROM ({{}})"
WHOLE = "NOT (source = 'dump' AND batch = 0)"
add(
    "e09_ingest_job",
    _ingested,
    f"""
WITH r AS ({SOURCED.format(merges.RECORDS)}), g AS ({SOURCED.format(merges.GENRE_ROWS)}), p AS ({SOURCED.format('SELECT p_partkey AS seq FROM part')})
SELECT 'books' AS "table", language || '/' || slug AS key, title AS value FROM (SELECT * FROM r WHERE {WHOLE} QUALIFY row_number() OVER (PARTITION BY language, slug ORDER BY source, batch, seq DESC) = 1)
UNION ALL SELECT DISTINCT 'book_genres', language || '/' || slug, genre_slug FROM g WHERE {WHOLE}
UNION ALL SELECT 'dead', 'dump/0', count(*) || ' true' FROM p WHERE NOT {WHOLE}
UNION ALL SELECT 'second run', 'batches', '0'""",
)

# ---- S4: dumps from a record on, and drawn lines

WORK = "/type/work"


def _dump(cat: Catalogue) -> str:
    """Lines of works in files, by number: among them other kinds, lines that are cut short, and damaged JSON."""
    p = F.col("p_partkey")
    kind = F.when(p % 5 == 0, "/type/page").otherwise(WORK)
    json = F.concat(F.lit('{"key": "/works/OL'), p, F.lit('W", "title": "'), "p_name", F.when(p % 7 == 0, "").otherwise('"}'))
    line = F.when(p % 11 == 0, F.concat_ws("\t", kind, p)).otherwise(F.concat_ws("\t", kind, p, F.lit(1), F.lit("then"), json))
    at = root(cat, "dump")
    cat.table("part").select(p, line.alias("value")).repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey").select("value").write.text(at)
    return at


def _from_a_record_on(cat: Catalogue) -> DataFrame:
    at, schema = _dump(cat), dumps.WORK
    late = dumps.records_after(cat.spark, at, WORK, schema, 25).select(F.lit("skip").alias("how"), "key")
    drawn = dumps.records_after(cat.spark, at, WORK, schema, 10, 0.4, SEED).select(F.lit("drawn").alias("how"), "key")
    return late.unionByName(drawn)


add(
    "s04_skip_records",
    _from_a_record_on,
    f"""
WITH l AS (
  SELECT p_partkey, '{WORK}' || chr(9) || p_partkey || chr(9) || '1' || chr(9) || 'then' || chr(9) || '{{"key": "/works/OL' || p_partkey || 'W", "title": "' || p_name || CASE WHEN p_partkey % 7 = 0 THEN '' ELSE '"}}' END AS line
  FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 11 <> 0),
d AS (SELECT * FROM l WHERE ('0x' || substr(md5('{SEED}:' || line), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 0.4),
n AS (SELECT 'skip' AS how, p_partkey, row_number() OVER (ORDER BY p_partkey) > 25 AS late FROM l UNION ALL SELECT 'drawn', p_partkey, row_number() OVER (ORDER BY p_partkey) > 10 FROM d)
SELECT how, '/works/OL' || p_partkey || 'W' AS key FROM n WHERE late AND p_partkey % 7 <> 0""",
)

# ---- Z3: dates in free text

#: How a date d is written, and what can be read of it: its day, its month or its year; `us` if a day up to 12 counts as
#: the month; `short` if a number up to 31 counts as a day, and there is no year then; `none` if nothing can.
SHAPES = [
    ("date_format(d, 'yyyy-MM-dd')", "day"),
    ("date_format(d, 'yyyy/M/d')", "day"),
    ("date_format(d, 'yyyy.MM.dd')", "day"),
    ("date_format(d, 'yyyyMMdd')", "day"),
    ("concat(date_format(d, 'yyyy-MM-dd'), 'T10:30:00Z')", "day"),
    ("concat(date_format(d, 'yyyy-MM-dd'), ' 23:59:59.123+02:00')", "day"),
    ("date_format(d, 'MMMM d, yyyy')", "day"),
    ("date_format(d, 'MMM d, yyyy')", "day"),
    ("date_format(d, 'MMM. d yyyy')", "day"),
    ("upper(date_format(d, 'd MMMM yyyy'))", "day"),
    ("date_format(d, 'd MMM yyyy')", "day"),
    ("date_format(d, 'd-MMM-yyyy')", "day"),
    ("date_format(d, 'd-MMM-yy')", "day"),
    ("date_format(d, 'd MMM yy')", "day"),
    ("date_format(d, 'MMM d yy')", "day"),
    ("concat(date_format(d, 'MMMM d, '), '''', date_format(d, 'yy'))", "day"),
    ("concat(date_format(d, 'MMMM d'), 'th, ', date_format(d, 'yyyy'))", "day"),
    ("concat(date_format(d, 'd'), 'st of ', date_format(d, 'MMMM yyyy'))", "day"),
    ("concat('the ', date_format(d, 'd'), 'nd day of ', date_format(d, 'MMMM, yyyy'))", "day"),
    ("date_format(d, 'EEEE, MMMM d, yyyy')", "day"),
    ("date_format(d, 'EEE d MMM yyyy')", "day"),
    ("concat(date_format(d, 'EEE MMM d '), '10:30:00 ', date_format(d, 'yyyy'))", "day"),
    ("concat('Published on ', date_format(d, 'MMMM d, yyyy'), ' by the press')", "day"),
    ("concat(date_format(d, 'yyyy MMMM d'), ' (second edition)')", "day"),
    ("concat('  ', date_format(d, 'yyyy - MM - dd'), ' ')", "day"),
    ("date_format(d, 'MM/dd/yyyy')", "day"),
    ("date_format(d, 'M-d-yyyy')", "day"),
    ("date_format(d, 'M/d/yy')", "day"),
    ("date_format(d, 'dd/MM/yyyy')", "us"),
    ("date_format(d, 'dd.MM.yyyy')", "us"),
    ("date_format(d, 'MMMM yyyy')", "month"),
    ("date_format(d, 'MMM yyyy')", "month"),
    ("date_format(d, 'yyyy MMM')", "month"),
    ("concat('Sept. ', date_format(d, 'yyyy'))", "september"),
    ("date_format(d, 'MMM yy')", "short"),
    ("concat(date_format(d, 'MMM '), '’', date_format(d, 'yy'))", "month"),
    ("date_format(d, 'yyyy-MM')", "month"),
    ("date_format(d, 'MM/yyyy')", "month"),
    ("date_format(d, 'M.yyyy')", "month"),
    ("date_format(d, 'yyyy')", "year"),
    ("concat('c. ', date_format(d, 'yyyy'))", "year"),
    ("concat('circa ', date_format(d, 'yyyy'))", "year"),
    ("concat('©', date_format(d, 'yyyy'))", "year"),
    ("concat('[', date_format(d, 'yyyy'), '?]')", "year"),
    ("concat(date_format(d, 'yyyy'), '-', 2005)", "year"),
    ("concat('Spring ', date_format(d, 'yyyy'))", "year"),
    ("concat('printed in ', date_format(d, 'yyyy'), ', 3rd printing')", "year"),
    ("'no date'", "none"),
    ("concat('volume ', day(d))", "none"),
    ("concat('February 30, ', date_format(d, 'yyyy'))", "none"),
    ("concat('13/13/', date_format(d, 'yyyy'))", "none"),
    ("'0000'", "none"),
    ("''", "none"),
    ("cast(null as string)", "none"),
]


def _fuzzy_dates(cat: Catalogue) -> DataFrame:
    days = cat.table("orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    texts = F.explode(F.array(*[F.struct(F.lit(k).alias("shape"), F.expr(e).alias("text")) for k, (e, _) in enumerate(SHAPES)]))
    return days.select("d", texts.alias("t")).select(F.col("d").cast("string").alias("day"), "t.shape", fuzzy_date(F.col("t.text")).cast("string").alias("read"))


READ = {
    "day": "d",
    "month": "date_trunc('month', d)",
    "year": "date_trunc('year', d)",
    "us": "CASE WHEN day(d) > 12 THEN d ELSE make_date(year(d), day(d), month(d)) END",
    "short": "CASE WHEN year(d) % 100 NOT BETWEEN 1 AND 31 THEN date_trunc('month', d) END",
    "september": "make_date(year(d), 9, 1)",
    "none": "NULL",
}
add(
    "z03_fuzzy_dates",
    _fuzzy_dates,
    "WITH t AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), s AS (SELECT * FROM (VALUES "
    + ", ".join(f"({k}, '{kind}')" for k, (_, kind) in enumerate(SHAPES))
    + ") AS v(shape, kind))\nSELECT CAST(d AS VARCHAR) AS day, shape, CASE "
    + " ".join(f"WHEN kind = '{kind}' THEN CAST(CAST({value} AS DATE) AS VARCHAR)" for kind, value in READ.items())
    + " END AS read FROM t, s",
)

# ---- L21: all lists refreshed as one version


def _broken(cat: Catalogue, k: int) -> DataFrame:
    return cat.books.withColumn("score", F.raise_error(F.lit("no such counter")).cast("double")).limit(k)


def _refreshed(cat: Catalogue) -> DataFrame:
    """Every list after a whole run and a second one over three of them, of which one fails."""
    refresh = lists.Refresh(cat.spark, root(cat, "lists"))
    refresh.run(cat)
    refresh.run(cat, keys=("most_read", "most_wanted", "top_authors"), builders={"most_wanted": _broken})
    return refresh.status().select("list", "version", "rows", F.col("error").contains("no such counter").alias("failed"))


def add_after_queries(sql_of: dict[str, str]) -> None:
    """Queries whose SQL is made of that of queries registered before."""
    named = {re.sub(r"^l\d+_", "", name): query for name, query in sql_of.items() if re.match(r"l\d+_", name)}
    parts = []
    for key in lists.LISTS:
        version, failed = (2 if key in ("most_read", "top_authors") else 1), ("true" if key == "most_wanted" else "NULL")
        parts.append(f"SELECT '{key}' AS list, {version} AS version, (SELECT count(*) FROM ({named[key]})) AS rows, CAST({failed} AS BOOLEAN) AS failed")
    add("l21_refresh", _refreshed, "\nUNION ALL ".join(parts))
    listed = lambda kind, section, query, named, key, title: f"SELECT '{kind}' AS entity_type, CAST(source_id AS VARCHAR) AS entity_id, '{section}' AS section_key, CAST(rank AS BIGINT) AS rank, target_id, {title} AS title, slug FROM ({query}) JOIN ({named}) ON {key} = target_id WHERE rank <= 5"
    people, books = sql("SELECT author_id, name, slug FROM authors"), sql("SELECT book_id, title, slug FROM books")
    parts = [
        listed("author", "similar_by_genre", sql_of["c05_authors_by_genre"], people, "author_id", "name"),
        listed("author", "fans_also_read", sql_of["c06_fans_also_read"], people, "author_id", "name"),
        listed("series", "more_by_author", sql_of["c07_series_more_by_author"], books, "book_id", "title"),
    ]
    add("c13b_read_other_sections", _other_sections, "\nUNION ALL ".join(parts))


# ---- C13: sections of authors and series


def _other_sections(cat: Catalogue) -> DataFrame:
    found = [similar._listed(build(cat), kind, key) for kind, key, build in (("author", "similar_by_genre", similar.authors_by_genre), ("author", "fans_also_read", similar.fans_also_read), ("series", "more_by_author", similar.series_more_by_author))]
    return similar.read_sections(cat, found[0].unionByName(found[1]).unionByName(found[2]), 5).withColumn("rank", F.col("rank").cast("long"))


# ---- Q4: titles as they are indexed

add(
    "q04b_analysed_titles",
    lambda cat: cat.books.select("book_id", F.array_join(search.stemmed(search.terms(F.col("title"))), " ").alias("terms")),
    sql("SELECT book_id, replace(lower(title), 'large', 'larg') AS terms FROM books"),
)

# ---- G9: packs from the whole table

add("g09_packs_from_table", lambda cat: sampling.table_packs(cat, SEED))
