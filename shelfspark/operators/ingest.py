"""Bulk import of authors, works, editions, ratings and reading logs from dump records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions import expressions as X
from shelfspark.functions.text import clean_description
from shelfspark.operators.merge import last_by, merged
from shelfspark.sources.dumps import short_key, text_value

LEAST_AUTHOR_SCORE, LEAST_WORK_SCORE, GENRES, ISBNS = 2, 2, 5, 20
COVER = "https://covers.openlibrary.org/b/id/%s-L.jpg"
PHOTO = "https://covers.openlibrary.org/a/id/%s-L.jpg"
#: Languages of editions by their three-letter codes.
LANGUAGES = dict(
    eng="en", fre="fr", fra="fr", ger="de", deu="de", spa="es", ita="it", por="pt", rus="ru", jpn="ja", chi="zh", zho="zh", kor="ko", ara="ar", hin="hi", tur="tr", pol="pl", dut="nl", nld="nl", swe="sv", nor="no",
    dan="da", fin="fi", gre="el", ell="el", heb="he", tha="th", vie="vi", ukr="uk", ces="cs", cze="cs", rum="ro", ron="ro", hun="hu", cat="ca", bul="bg", hrv="hr", srp="sr", slk="sk", slo="sk", slv="sl", lit="lt",
    lav="lv", est="et", ind="id", may="ms", msa="ms", per="fa", fas="fa", ben="bn", tam="ta", tel="te", mar="mr", guj="gu", kan="kn", mal="ml", pan="pa", urd="ur", lat="la", glg="gl", eus="eu", baq="eu", wel="cy",
    cym="cy", gle="ga", iri="ga", ice="is", isl="is", geo="ka", kat="ka", arm="hy", hye="hy", mac="mk", mkd="mk", alb="sq", sqi="sq", bos="bs", afr="af", swa="sw", amh="am", tgl="tl", fil="tl", mlt="mt",
)


def picture(ids: Column, template: str) -> Column:
    """The picture of the first positive id."""
    some = F.get(F.filter(ids, lambda i: i > 0), F.lit(0))
    return F.when(some.isNotNull(), F.format_string(template, some.cast("string")))


def language_of(code: Column) -> Column:
    """Two letters for a key like /languages/eng; null for unknown ones."""
    codes = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(codes, F.regexp_replace(code, "^/languages/", ""))


def authors(records: DataFrame, least: int = LEAST_AUTHOR_SCORE) -> DataFrame:
    """Authors good enough to import, one for each slug."""
    rows = records.select(
        short_key("key").alias("open_library_id"),
        F.trim("name").alias("name"),
        X.slug_ascii(F.col("name")).alias("slug"),
        clean_description(text_value("bio")).alias("bio"),
        X.parse_date(F.col("birth_date")).alias("birth_date"),
        X.parse_date(F.col("death_date")).alias("death_date"),
        picture(F.col("photos"), PHOTO).alias("photo_url"),
        F.map_filter("remote_ids", lambda _, v: X.filled(v)).alias("remote_ids"),
        F.when(X.is_qid(F.col("remote_ids")["wikidata"]), F.col("remote_ids")["wikidata"]).alias("wikidata_id"),
        "alternate_names",
    ).where(X.filled(F.col("name")))
    score = X.truthy_count(X.filled(F.col("bio")), F.col("photo_url").isNotNull(), X.filled(F.col("wikidata_id")), F.col("birth_date").isNotNull(), F.size("alternate_names") > 0)
    return last_by(rows.withColumn("score", score).where(F.col("score") >= least), ["slug"], "open_library_id")


def merge_authors(table: DataFrame, new: DataFrame) -> DataFrame:
    fill = dict.fromkeys(("bio", "birth_date", "death_date", "photo_url", "wikidata_id"), "fill")
    return merged(table, new.select(*[c for c in table.columns if c in new.columns]), ["slug"], fill)


def works(records: DataFrame, known_authors: DataFrame, least: int = LEAST_WORK_SCORE) -> DataFrame:
    """Works with a known author, good enough to import: one English book for each slug, with its authors' slugs and
    first subjects as genres."""
    named = records.select("*", F.explode("authors").alias("a")).select("key", F.regexp_replace("a.author.key", "^/authors/", "").alias("open_library_id"))
    resolved = named.join(known_authors.select("open_library_id", F.col("slug").alias("author")), "open_library_id").groupBy("key").agg(F.array_sort(F.collect_set("author")).alias("author_slugs"))
    # What takes work is done where the lines are read: behind the join its few bytes lie in few tasks.
    rows = records.select(
        "key",
        short_key("key").alias("open_library_id"),
        F.trim("title").alias("title"),
        X.slug_ascii(F.col("title")).alias("slug"),
        F.lit("en").alias("language"),
        clean_description(text_value("description")).alias("description"),
        picture(F.col("covers"), COVER).alias("primary_cover_url"),
        X.year_of(F.col("first_publish_date")).alias("original_publication_year"),
        F.slice(F.coalesce("subjects", F.array().cast("array<string>")), 1, GENRES).alias("genres"),
    )
    score = X.truthy_count(X.filled(F.col("description")), F.col("primary_cover_url").isNotNull(), F.size("genres") > 0)
    kept = rows.where(X.filled(F.col("title"))).withColumn("score", score).where(F.col("score") >= least)
    kept = kept.join(resolved, "key").select("open_library_id", "title", "slug", "language", "description", "primary_cover_url", "original_publication_year", "genres", "author_slugs", "score")
    return last_by(kept, ["language", "slug"], "open_library_id")


def genre_rows(books: DataFrame) -> DataFrame:
    """(open_library_id, genre_slug, genre_name) of works' genres; of a slug's names the first in order."""
    rows = books.select("open_library_id", F.explode("genres").alias("name")).withColumn("genre_slug", X.slug_ascii(F.col("name"), 150)).where("genre_slug <> ''")
    return rows.withColumn("genre_name", F.min("name").over(Window.partitionBy("genre_slug"))).select("open_library_id", "genre_slug", "genre_name").distinct()


def edition_score() -> Column:
    isbns = F.size(F.coalesce("isbn_10", F.array())) + F.size(F.coalesce("isbn_13", F.array())) > 0
    return X.truthy_count(isbns, F.col("number_of_pages") > 0, F.size("publishers") > 0, F.size("covers") > 0, X.filled(F.col("description")), X.filled(F.col("physical_format")))


def bests_and_isbns(rows: DataFrame, best: Column, most: int = ISBNS) -> DataFrame:
    """(work, language, best, isbn) of editions (work, language, score, key, isbn_13, isbn_10): `best` of the best one, and
    different ISBNs of all, those of the best edition first (by place in it, then by ISBN, where editions share their
    key). Each ISBN's first place is found before any of a work's are brought together, and only so many of them are,
    whatever the number of its editions. Editions are looked at once: each gives a row for itself and one for each ISBN."""
    none = F.array().cast("array<string>")
    isbns = F.concat(F.coalesce("isbn_13", none), F.coalesce("isbn_10", none))
    own = F.struct(F.lit(False).alias("listed"), F.lit(None).cast("string").alias("one"), F.lit(0).alias("pos"), best.alias("best"))
    each = F.transform(isbns, lambda one, pos: F.struct(F.lit(True).alias("listed"), one.alias("one"), pos.alias("pos"), F.when(F.lit(False), best).alias("best")))
    parts = rows.select("work", "language", (-F.col("score")).alias("k"), "key", F.explode(F.concat(F.array(own), each)).alias("p")).select("work", "language", "k", "key", "p.*")
    first = parts.groupBy("work", "language", "listed", "one").agg(F.min(F.struct("k", "key", "pos")).alias("first"), F.min_by("best", F.struct("k", "key")).alias("best"))
    nth = F.row_number().over(Window.partitionBy("work", "language").orderBy("listed", "first", "one"))
    kept = first.withColumn("nth", nth).where(F.col("nth") <= most + 1)
    found = F.collect_list(F.when(F.col("listed"), F.struct("nth", "one")))
    return kept.groupBy("work", "language").agg(F.first("best", ignorenulls=True).alias("best"), F.transform(F.array_sort(found), lambda p: p["one"]).alias("isbn"))


def first_isbns(rows: DataFrame, most: int = ISBNS) -> DataFrame:
    """(work, language, isbn) of bests_and_isbns() where there are any."""
    return bests_and_isbns(rows, F.col("key"), most).where(F.size("isbn") > 0).select("work", "language", "isbn")


def best_editions(records: DataFrame, known_works: DataFrame) -> DataFrame:
    """The best edition of each known work and language, with the ISBNs of all of them (20 at most, the best's first).

    Best-of is over all editions, however many there are between two of a work."""
    rows = records.select("*", F.regexp_replace(F.get(F.col("works"), F.lit(0))["key"], "^/works/", "").alias("work"))
    rows = rows.join(known_works.select(F.col("open_library_id").alias("work")), "work", "left_semi")
    language = F.coalesce(language_of(F.get(F.col("languages"), F.lit(0))["key"]), F.lit("en"))
    rows = rows.withColumn("language", language).withColumn("score", edition_score())
    grouped = bests_and_isbns(rows, F.struct("key", "title", "number_of_pages", "publishers", "covers", "description", "physical_format", "series", "score"))
    series = F.get(F.col("best.series"), F.lit(0))
    return grouped.select(
        "work",
        "language",
        short_key("best.key").alias("edition"),
        F.col("best.title").alias("title"),
        F.col("best.score").alias("score"),
        F.when(F.col("best.number_of_pages") > 0, F.col("best.number_of_pages")).alias("number_of_pages"),
        F.get(F.col("best.publishers"), F.lit(0)).alias("publisher"),
        picture(F.col("best.covers"), COVER).alias("primary_cover_url"),
        clean_description(text_value("best.description")).alias("description"),
        X.book_format(F.col("best.physical_format")).alias("format"),
        X.series_name(series).alias("series"),
        X.clamp_position(X.series_number(series)).alias("series_position"),
        "isbn",
    )


def merge_editions(books: DataFrame, editions: DataFrame, own_titles: bool = True) -> DataFrame:
    """Books (open_library_id of the work, language, ...) with their best editions: ISBNs replaced where there are any;
    pages, publisher, cover, description, first sentence and series filled in; formats joined; external ids added. Only
    columns that both sides have change. Languages without a book get one, made from the English one: its slug and year,
    its title unless own_titles, and what the edition lacks of description, cover and series."""
    new = editions.withColumnRenamed("work", "open_library_id").withColumn("isbn", F.when(F.size("isbn") > 0, F.col("isbn")))
    if "format" in new.columns:
        new = new.withColumn("formats", F.when(F.col("format").isNotNull(), F.array("format")))
    if "series" in new.columns:
        new = new.withColumn("series_slug", F.when(X.filled(F.col("series")), X.slug_ascii(F.col("series"))))
    policies = {"isbn": "supplied", "formats": "union", "external_ids": "map"} | dict.fromkeys(("number_of_pages", "publisher", "primary_cover_url", "description", "first_sentence", "series_slug", "series_position"), "fill")
    columns = [c for c in policies if c in books.columns and c in new.columns]
    keys = ["open_library_id", "language"]
    updated = merged(books, new.select(*keys, *columns), keys, policies, insert=False)
    english = books.where("language = 'en'").drop("language")
    missing = new.join(books.select(*keys), keys, "left_anti").select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    own = {c: F.coalesce(f"__{c}", c) for c in ("description", "primary_cover_url", "series_slug") if c in columns}
    own |= {c: F.col(f"__{c}") for c in columns if c not in own}
    if own_titles and "title" in new.columns:
        missing = missing.join(new.select(*keys, F.col("title").alias("__title")), keys)
        own["title"] = F.coalesce("__title", "title")
    if "series_position" in columns:
        own["series_position"] = F.when(F.col("__series_slug").isNull(), F.col("series_position")).otherwise(F.col("__series_position"))
    kept = ("title", "slug", "original_publication_year")
    kinds = dict(books.dtypes)
    value = lambda c: F.col(c) if c in keys else own.get(c, F.col(c) if c in kept else F.lit(None)).cast(kinds[c])
    return updated.unionByName(missing.join(english, "open_library_id").select(*[value(c).alias(c) for c in books.columns]))


def clone_links(links: DataFrame, new_rows: DataFrame) -> DataFrame:
    """links (book_id, ...) with those of each source book given to its new row (book_id, source_book_id) as well."""
    more = new_rows.select(F.col("book_id").alias("__new"), F.col("source_book_id").alias("book_id")).join(links, "book_id").drop("book_id").withColumnRenamed("__new", "book_id")
    return links.unionByName(more.select(*links.columns)).dropDuplicates()


def fill_wikidata(authors: DataFrame, found: DataFrame) -> DataFrame:
    """Authors with what is found for their wikidata_id (nationality, birth_place, wikipedia_url) where they lack it."""
    names = ("nationality", "birth_place", "wikipedia_url")
    some = found.where(" or ".join(f"{n} is not null" for n in names))
    return merged(authors, last_by(some, ["wikidata_id"], "nationality"), ["wikidata_id"], dict.fromkeys(names, "fill"), insert=False)


def work_ratings(rows: DataFrame) -> DataFrame:
    """(work, ol_rating_count, ol_avg_rating) of rows (work, rating); the average is rounded half up in whole numbers."""
    sums = rows.groupBy("work").agg(F.count("*").alias("n"), F.sum("rating").alias("total"))
    return sums.select("work", F.col("n").alias("ol_rating_count"), (F.floor((F.col("total") * 200 + F.col("n")) / (F.col("n") * 2)).cast("double") / 100.0).alias("ol_avg_rating"))


def work_shelves(rows: DataFrame) -> DataFrame:
    """Counts of the three shelves for each work."""
    n = lambda s: F.count_if(F.col("shelf") == s)
    return rows.groupBy("work").agg(n("want").alias("ol_want_to_read_count"), n("currently").alias("ol_currently_reading_count"), n("already").alias("ol_already_read_count"))


def apply_counts(books: DataFrame, counts: DataFrame, reset: bool = False) -> DataFrame:
    """Books with new counters by work; reset gives books of other works zeros."""
    names = [c for c in counts.columns if c != "work"]
    new = counts.select(F.col("work").alias("open_library_id"), *[F.col(c).alias(f"__{c}") for c in names], F.lit(True).alias("__new"))
    joined = books.join(new, "open_library_id", "left")
    other = lambda c: F.lit(0).cast(dict(books.dtypes)[c]) if reset else F.col(c)
    return joined.select(*[F.when(F.col("__new"), F.col(f"__{c}")).otherwise(other(c)).alias(c) if c in names else F.col(c) for c in books.columns])


def enrichment_candidates(books: DataFrame, short: int = 100, k: int = 5) -> DataFrame:
    """The most read books whose description is missing or short."""
    wanting = books.where(F.col("description").isNull() | (F.length("description") < short))
    return wanting.orderBy(F.desc_nulls_last("ol_already_read_count"), "book_id").limit(k).select("book_id", "title")


def run_phases(phases: dict[str, Callable[[], DataFrame]], root: str, spark) -> list[str]:
    """Runs phases in order, each writing its result under root; those whose result is complete are skipped, so a run
    that was broken off goes on where it stood. Gives the phases that ran."""
    ran = []
    for name, phase in phases.items():
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/_SUCCESS")
        if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            continue
        phase().write.mode("overwrite").parquet(f"{root}/{name}")
        ran.append(name)
    return ran
