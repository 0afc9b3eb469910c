"""The registered queries over the catalogue, and the SQL that states their results."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions import expressions as X
from shelfspark.functions import text as T
from shelfspark.operators import browse, cleanup, discover, lists, merge, personal, profile, sampling, search, similar, userdata
from shelfspark.operators.common import cut
from shelfspark.operators.index import SearchIndex
from shelfspark.plans.oracle import sql
from shelfspark.sources.catalogue import Catalogue, catalogue, shared_dir
from shelfspark.sources.versions import BucketedTable
from shelfspark.streaming import counters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
AS_OF = "2030-01-01"
SEED = 42


def add(key: str, build: Callable[[Catalogue], DataFrame], oracle: str | None = None) -> None:
    QUERIES[key] = lambda spark, sf_dir: build(catalogue(spark, sf_dir))
    if oracle:
        ORACLE_SQL[key] = oracle


# ---- ranked lists


def list_sql(score: str, where: str = "true", joins: str = "", then: str = "", k: int = lists.SIZE) -> str:
    return sql(
        f"""
SELECT book_id, title, slug, language, coalesce(primary_cover_url, '') AS cover_url, round(coalesce(combined, 0), 6) AS avg_rating, CAST(total_ratings AS BIGINT) AS rating_count,
  coalesce(author_names, '') AS author_names, coalesce(author_slugs, '') AS author_slugs, CAST(library_readers + coalesce(app_readers, 0) AS BIGINT) AS readers, round(coalesce(CAST(score AS DOUBLE), 0), 6) AS score
FROM top LEFT JOIN names USING (book_id) LEFT JOIN app_readers USING (book_id)""",
        top=f"SELECT rated.*, {score} AS score FROM rated {joins} WHERE listable AND {where} ORDER BY score DESC NULLS LAST, {then} book_id LIMIT {k}",
    )


def shelf_sql(score: str, where: str) -> str:
    return list_sql("s.n", joins=f"JOIN (SELECT book_id AS b, {score} AS n FROM bookshelves WHERE {where} GROUP BY 1) s ON s.b = rated.book_id")


def dimension_sql(name: str) -> str:
    stats = f"SELECT book_id AS b, CAST((CAST(sum({name} * 2) AS BIGINT) * 100 + count(*)) // (count(*) * 2) AS DOUBLE) / 100 AS n FROM ratings WHERE {name} IS NOT NULL GROUP BY 1 HAVING count(*) >= 3"
    return list_sql("s.n", joins=f"JOIN ({stats}) s ON s.b = rated.book_id")


AUTHOR_ROLLUP = """
  SELECT author_id, count(total_ratings) AS book_count, sum(points) AS points, coalesce(sum(total_ratings), 0) AS rating_count,
    coalesce(sum(library_readers), 0) + coalesce(sum(app_readers), 0) AS readers, coalesce(sum(ol_already_read_count), 0) AS already_read
  FROM book_authors LEFT JOIN (SELECT * FROM rated LEFT JOIN app_readers USING (book_id) WHERE language = 'en') USING (book_id) GROUP BY 1"""


def author_sql(score: str, how: str) -> str:
    return sql(
        f"""
SELECT author_id, name, slug, coalesce(photo_url, '') AS photo_url, CAST(coalesce(book_count, 0) AS BIGINT) AS book_count,
  round(CASE WHEN rating_count > 0 THEN points / CAST(rating_count AS DOUBLE) ELSE 0 END, 6) AS avg_rating,
  CAST(coalesce(rating_count, 0) AS BIGINT) AS rating_count, CAST(coalesce(readers, 0) AS BIGINT) AS readers, round(CAST({score} AS DOUBLE), 6) AS score
FROM authors {how} JOIN rollup USING (author_id) ORDER BY score DESC, author_id LIMIT 50""",
        rollup=AUTHOR_ROLLUP,
    )


EPOCH = "epoch_us({}) / 1e6::DOUBLE"
LIST_SQL = {
    "most_read": list_sql("ol_already_read_count"),
    "most_wanted": list_sql("ol_want_to_read_count"),
    "trending_reads": list_sql("ol_currently_reading_count"),
    "most_viewed": list_sql("view_count"),
    "highest_rated": list_sql("combined", "total_ratings >= 3"),
    "community_top_rated": list_sql("ol_avg_rating", "ol_rating_count >= 20"),
    "most_rated": list_sql("total_ratings"),
    "recently_added": list_sql(EPOCH.format("created_at")),
    "classics": list_sql("ol_already_read_count", "original_publication_year < 1980 AND (ol_already_read_count >= 100 OR avg_rating >= 4.0)", then="avg_rating DESC NULLS LAST,"),
    "user_favorites": shelf_sql("count(*)", "is_favorite"),
    "recently_finished": shelf_sql(EPOCH.format("max(updated_at)"), "status = 'read'"),
    "currently_reading": shelf_sql("count(*)", "status = 'reading'"),
    "best_writing": dimension_sql("writing_quality"),
    "most_emotional": dimension_sql("emotional_impact"),
    "funniest": dimension_sql("humor"),
    "most_thought_provoking": dimension_sql("intellectual_depth"),
    "most_rereadable": dimension_sql("rereadability"),
    "top_authors": author_sql("already_read", ""),
    "popular_authors": author_sql("view_count", "LEFT"),
}
for number, (name, (_, build)) in enumerate(lists.LISTS.items(), 1):
    add(f"l{number:02d}_{name}", build, LIST_SQL[name])


def home_sql() -> str:
    parts = []
    for name in lists.HOME_BOOKS:
        parts.append(f"SELECT '{name}' AS category, book_id AS item_id, title, score FROM l_{name}")
    for name in lists.HOME_AUTHORS:
        parts.append(f"SELECT '{name}' AS category, author_id AS item_id, name AS title, score FROM l_{name}")
    # Each list is a query of its own with all tables, cut to ten rows.
    named = {f"l_{n}": f"{LIST_SQL[n].replace('LIMIT 50', 'LIMIT 10')}" for n in lists.HOME_BOOKS + lists.HOME_AUTHORS}
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in named.items()) + "\n" + "\nUNION ALL ".join(parts)


add("l22_home", lists.home_page, home_sql())

# ---- similarity

ELIGIBLE_BOOKS = "SELECT book_id AS source_id FROM rated WHERE listable AND total_ratings >= 500"
ELIGIBLE_AUTHORS = "SELECT author_id AS source_id FROM book_authors JOIN rated USING (book_id) WHERE language = 'en' GROUP BY 1 HAVING sum(total_ratings) >= 500"
ELIGIBLE_SERIES = "SELECT DISTINCT series_id AS source_id FROM rated WHERE series_id IS NOT NULL AND language = 'en' AND total_ratings >= 500"
READS = "SELECT user_id, book_id FROM bookshelves WHERE status IN ('read', 'reading')"


def ranked_sql(pairs: str, order: str, **more: str) -> str:
    """pairs: SELECT source_id, target_id, score and what the order needs."""
    return sql(
        f"""
SELECT source_id, CAST(rank AS INTEGER) AS rank, target_id, round(coalesce(CAST(score AS DOUBLE), 0), 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY {order}, target_id) AS rank FROM pairs) WHERE rank <= 20""",
        **more,
        pairs=pairs,
    )


add(
    "c01_more_by_author",
    similar.more_by_author,
    ranked_sql(
        "SELECT source_id, target_id, avg_rating AS score FROM (SELECT DISTINCT a.book_id AS source_id, b.book_id AS target_id FROM book_authors a JOIN book_authors b USING (author_id) WHERE a.book_id <> b.book_id) JOIN eligible USING (source_id) JOIN rated ON rated.book_id = target_id WHERE listable",
        "score DESC NULLS LAST",
        eligible=ELIGIBLE_BOOKS,
    ),
)
add(
    "c02_more_from_series",
    similar.more_from_series,
    ranked_sql("SELECT a.book_id AS source_id, b.book_id AS target_id, b.series_position AS score FROM rated a JOIN eligible ON source_id = a.book_id JOIN rated b ON a.series_id = b.series_id AND a.book_id <> b.book_id WHERE b.listable", "score ASC NULLS LAST", eligible=ELIGIBLE_BOOKS),
)
add(
    "c03_similar_by_genre",
    similar.similar_by_genre,
    ranked_sql(
        """SELECT source_id, target_id, shared / CAST(n + m - shared AS DOUBLE) AS score, rating_count FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY shared DESC, target_id) AS nth FROM shared)
    JOIN sizes ON sizes.book_id = source_id JOIN (SELECT book_id, n AS m FROM sizes) t ON t.book_id = target_id JOIN rated ON rated.book_id = target_id WHERE nth <= 500 AND listable""",
        "score DESC NULLS LAST, rating_count DESC NULLS LAST",
        eligible=ELIGIBLE_BOOKS,
        sizes="SELECT book_id, count(*) AS n FROM book_genres GROUP BY 1",
        shared="SELECT source_id, b.book_id AS target_id, count(*) AS shared FROM book_genres a JOIN eligible ON source_id = a.book_id JOIN book_genres b USING (genre_id) JOIN rated r ON r.book_id = b.book_id WHERE r.language = 'en' AND r.total_ratings >= 50 AND b.book_id <> source_id GROUP BY 1, 2 HAVING count(*) >= 2",
    ),
)

READER_PAIRS = """SELECT source_id, target_id, count(*) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY user_id) AS nth FROM source_reads) JOIN target_reads USING (user_id)
    WHERE nth <= 500 GROUP BY 1, 2 HAVING count(*) >= 3"""
CANDIDATES = "(SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) AS nth FROM together WHERE {})"
add(
    "c04_readers_also_enjoyed",
    similar.readers_also_enjoyed,
    ranked_sql(
        f"SELECT source_id, target_id, score, avg_rating FROM {CANDIDATES.format('source_id <> target_id')} JOIN rated ON book_id = target_id WHERE nth <= 500 AND listable AND total_ratings >= 50",
        "score DESC, avg_rating DESC NULLS LAST",
        eligible=ELIGIBLE_BOOKS,
        reads=READS,
        source_reads="SELECT book_id AS source_id, user_id FROM reads JOIN eligible ON source_id = book_id",
        target_reads="SELECT book_id AS target_id, user_id FROM reads",
        together=READER_PAIRS,
    ),
)
AUTHOR_BOOKS = "SELECT author_id AS target_id, count(*) AS book_count FROM book_authors JOIN rated USING (book_id) WHERE language = 'en' GROUP BY 1"
add(
    "c05_authors_by_genre",
    similar.authors_by_genre,
    ranked_sql(
        """SELECT source_id, target_id, shared / CAST(a.n + b.n - shared AS DOUBLE) AS score, book_count FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY shared DESC, target_id) AS nth FROM shared)
    JOIN sizes a ON a.author_id = source_id JOIN sizes b ON b.author_id = target_id LEFT JOIN author_books USING (target_id) WHERE nth <= 500""",
        "score DESC NULLS LAST, book_count DESC NULLS LAST",
        eligible=ELIGIBLE_AUTHORS,
        author_books=AUTHOR_BOOKS,
        tagged="SELECT DISTINCT author_id, genre_id, language FROM book_authors JOIN book_genres USING (book_id) JOIN rated USING (book_id)",
        every="SELECT DISTINCT author_id, genre_id FROM tagged",
        sizes="SELECT author_id, count(*) AS n FROM every GROUP BY 1",
        shared="SELECT source_id, t.author_id AS target_id, count(*) AS shared FROM every JOIN eligible ON source_id = every.author_id JOIN tagged t USING (genre_id) WHERE t.language = 'en' AND t.author_id <> source_id GROUP BY 1, 2 HAVING count(*) >= 2",
    ),
)
add(
    "c06_fans_also_read",
    similar.fans_also_read,
    ranked_sql(
        f"SELECT source_id, target_id, score, book_count FROM {CANDIDATES.format('source_id <> target_id')} LEFT JOIN author_books USING (target_id) WHERE nth <= 500",
        "score DESC, book_count DESC NULLS LAST",
        eligible=ELIGIBLE_AUTHORS,
        author_books=AUTHOR_BOOKS,
        reads="SELECT DISTINCT author_id, user_id FROM bookshelves JOIN book_authors USING (book_id) WHERE status IN ('read', 'reading')",
        source_reads="SELECT author_id AS source_id, user_id FROM reads JOIN eligible ON source_id = author_id",
        target_reads="SELECT author_id AS target_id, user_id FROM reads",
        together=READER_PAIRS,
    ),
)
add(
    "c07_series_more_by_author",
    similar.series_more_by_author,
    ranked_sql(
        """SELECT source_id, target_id, avg_rating AS score FROM (SELECT DISTINCT series_id AS source_id, b.book_id AS target_id FROM rated JOIN book_authors a USING (book_id) JOIN book_authors b USING (author_id) WHERE series_id IS NOT NULL)
    JOIN eligible USING (source_id) JOIN rated t ON t.book_id = target_id WHERE t.listable AND t.series_id IS DISTINCT FROM source_id""",
        "score DESC NULLS LAST",
        eligible=ELIGIBLE_SERIES,
    ),
)
add(
    "c08_series_by_genre",
    similar.series_by_genre,
    ranked_sql(
        """SELECT source_id, target_id, shared / CAST(n + m - shared AS DOUBLE) AS score, rating_count FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY shared DESC, target_id) AS nth FROM shared)
    JOIN (SELECT source_id, count(*) AS n FROM own GROUP BY 1) USING (source_id) JOIN (SELECT book_id, count(*) AS m FROM book_genres GROUP BY 1) g ON g.book_id = target_id JOIN rated r ON r.book_id = target_id WHERE nth <= 500 AND listable""",
        "score DESC NULLS LAST, rating_count DESC NULLS LAST",
        eligible=ELIGIBLE_SERIES,
        own="SELECT DISTINCT series_id AS source_id, genre_id FROM rated JOIN book_genres USING (book_id) JOIN eligible ON source_id = series_id",
        shared="SELECT source_id, b.book_id AS target_id, count(*) AS shared FROM own JOIN book_genres b USING (genre_id) JOIN rated r ON r.book_id = b.book_id WHERE r.language = 'en' AND r.total_ratings >= 50 AND r.series_id IS DISTINCT FROM source_id GROUP BY 1, 2 HAVING count(*) >= 2",
    ),
)
add(
    "c09_series_readers_also_enjoyed",
    similar.series_readers_also_enjoyed,
    ranked_sql(
        "SELECT source_id, target_id, score, avg_rating FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) AS nth FROM together JOIN rated ON book_id = target_id WHERE series_id IS DISTINCT FROM source_id) WHERE nth <= 500 AND listable AND total_ratings >= 50",
        "score DESC, avg_rating DESC NULLS LAST",
        eligible=ELIGIBLE_SERIES,
        reads=READS,
        source_reads="SELECT DISTINCT series_id AS source_id, user_id FROM reads JOIN rated USING (book_id) JOIN eligible ON source_id = series_id",
        target_reads="SELECT book_id AS target_id, user_id FROM reads",
        together=READER_PAIRS,
    ),
)
SECTION_KEYS = {
    "c01_more_by_author": ("book", "more_by_author"),
    "c02_more_from_series": ("book", "more_from_series"),
    "c03_similar_by_genre": ("book", "similar_by_genre"),
    "c04_readers_also_enjoyed": ("book", "readers_also_enjoyed"),
    "c05_authors_by_genre": ("author", "similar_by_genre"),
    "c06_fans_also_read": ("author", "fans_also_read"),
    "c07_series_more_by_author": ("series", "more_by_author"),
    "c08_series_by_genre": ("series", "similar_by_genre"),
    "c09_series_readers_also_enjoyed": ("series", "readers_also_enjoyed"),
}
add(
    "c12_precompute",
    lambda cat: similar.precompute(cat).withColumn("similar_ids", F.array_join(F.col("similar_ids").cast("array<string>"), ",")),
    "\nUNION ALL ".join(
        f"SELECT '{kind}' AS entity_type, CAST(source_id AS VARCHAR) AS entity_id, '{section}' AS section_key, string_agg(target_id, ',' ORDER BY rank) AS similar_ids FROM ({ORACLE_SQL[key]}) GROUP BY source_id" for key, (kind, section) in SECTION_KEYS.items()
    ),
)

# ---- taste profiles and personal sections

EXCLUDED = "SELECT user_id, book_id FROM bookshelves WHERE status IN ('read', 'reading', 'abandoned')"
WEIGHTS = """
  SELECT user_id, genre_id, w / total AS weight, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, genre_id) AS rank, w, total FROM (SELECT *, sum(w) OVER (PARTITION BY user_id) AS total FROM (
    SELECT user_id, genre_id, sum(CASE WHEN status = 'read' AND overall_rating >= 4 THEN 3.0::DOUBLE WHEN status = 'read' AND overall_rating IS NOT NULL THEN 1.0 WHEN status IN ('read', 'reading') THEN 1.5 WHEN status = 'want_to_read' THEN 0.5 WHEN status = 'abandoned' THEN -1.0 ELSE 0.0 END
      + CASE WHEN is_favorite THEN 2.0 ELSE 0.0 END) AS w
    FROM bookshelves LEFT JOIN (SELECT user_id, book_id, overall_rating FROM ratings) USING (user_id, book_id) JOIN book_genres USING (book_id) GROUP BY 1, 2) WHERE w > 0)"""
ANCHORS = "SELECT user_id, book_id AS anchor_id FROM ratings QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY overall_rating DESC, book_id) = 1"
IN_PROGRESS = """SELECT user_id, series_id, count(*) AS read_count, any_value(total) AS total FROM bookshelves JOIN books USING (book_id) JOIN (SELECT series_id, count(*) AS total FROM books WHERE series_id IS NOT NULL GROUP BY 1) USING (series_id)
    WHERE status IN ('read', 'reading') GROUP BY 1, 2 HAVING count(*) < any_value(total)"""
SIMILAR_USERS = """SELECT user_id, other_id FROM (SELECT e.user_id, r.user_id AS other_id, row_number() OVER (PARTITION BY e.user_id ORDER BY count(*) DESC, r.user_id) AS nth FROM excluded e JOIN reads r ON e.book_id = r.book_id AND e.user_id <> r.user_id
    GROUP BY 1, 2 HAVING count(*) >= 2) WHERE nth <= 200"""
COLLABORATIVE = "SELECT user_id, book_id, count(*) AS readers FROM (SELECT s.user_id, r.book_id FROM similar_users s JOIN reads r ON r.user_id = s.other_id) ANTI JOIN excluded USING (user_id, book_id) GROUP BY 1, 2"
PROFILE = {"excluded": EXCLUDED, "reads": READS, "weights": WEIGHTS}


def personal_sql(scored: str, order: str, **more: str) -> str:
    return sql(
        f"""
SELECT user_id, CAST(rank AS INTEGER) AS rank, book_id, round(coalesce(CAST(score AS DOUBLE), 0), 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}, book_id) AS rank FROM scored) WHERE rank <= 20""",
        **PROFILE,
        **more,
        scored=scored,
    )


joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
add(
    "p01_shelf_profile",
    lambda cat: profile.shelf_profile(cat).select("user_id", joined("read_ids"), joined("want_ids"), joined("favorite_ids"), "shelved"),
    sql(
        """
SELECT user_id, coalesce(string_agg(CASE WHEN status IN ('read', 'reading', 'abandoned') THEN book_id END, ',' ORDER BY book_id), '') AS read_ids,
  coalesce(string_agg(CASE WHEN status = 'want_to_read' THEN book_id END, ',' ORDER BY book_id), '') AS want_ids, coalesce(string_agg(CASE WHEN is_favorite THEN book_id END, ',' ORDER BY book_id), '') AS favorite_ids, count(*) AS shelved
FROM bookshelves GROUP BY 1"""
    ),
)
add("p02_authors_read", profile.authors_read, sql("SELECT DISTINCT user_id, author_id FROM reads JOIN book_authors USING (book_id)", reads=READS))
add(
    "p03_genre_weights",
    lambda cat: profile.genre_weights(cat).select("user_id", "genre_id", X.six(F.col("weight")).alias("weight"), "rank"),
    sql("SELECT user_id, genre_id, round(weight, 6) AS weight, CAST(rank AS INTEGER) AS rank FROM weights", weights=WEIGHTS),
)
add(
    "p04_dimension_means",
    lambda cat: profile.dimension_means(cat).select("user_id", "dimension", X.six(F.col("mean")).alias("mean"), "n"),
    sql(" UNION ALL ".join(f"SELECT user_id, '{d}' AS dimension, round(avg({d}), 6) AS mean, count({d}) AS n FROM ratings GROUP BY 1 HAVING count({d}) >= 2" for d in X.DIMENSIONS)),
)
add("p04_anchors", profile.anchors, sql(ANCHORS))
add("p05_series_in_progress", profile.series_in_progress, sql(IN_PROGRESS))
add(
    "p06_profiles",
    lambda cat: profile.profiles(cat).select("user_id", F.size("read_ids").cast("long").alias("n_read"), F.size("want_ids").cast("long").alias("n_want"), F.size("favorite_ids").cast("long").alias("n_favorite"), "shelved", F.coalesce(F.array_join("top_genres", ","), F.lit("")).alias("top_genres"), "anchor_id", "cold"),
    sql(
        """
SELECT user_id, count(*) FILTER (WHERE status IN ('read', 'reading', 'abandoned')) AS n_read, count(*) FILTER (WHERE status = 'want_to_read') AS n_want, count(*) FILTER (WHERE is_favorite) AS n_favorite, count(*) AS shelved,
  coalesce(any_value(g), '') AS top_genres, any_value(anchor_id) AS anchor_id, count(*) < 5 AS cold
FROM bookshelves LEFT JOIN (SELECT user_id, string_agg(genre_id, ',' ORDER BY rank) AS g FROM weights WHERE rank <= 3 GROUP BY 1) USING (user_id) LEFT JOIN anchors USING (user_id) GROUP BY 1""",
        weights=WEIGHTS,
        anchors=ANCHORS,
    ),
)
add(
    "p07_for_you",
    personal.for_you,
    personal_sql(
        """SELECT user_id, book_id, round(genre_score * 0.6::DOUBLE + coalesce(readers / CAST(most AS DOUBLE), 0) * 0.25::DOUBLE + coalesce(avg_rating, 0) / 5.0::DOUBLE * 0.15::DOUBLE, 6) AS score
    FROM genre_side LEFT JOIN (SELECT *, max(readers) OVER (PARTITION BY user_id) AS most FROM collaborative) USING (user_id, book_id) JOIN rated USING (book_id)""",
        "score DESC",
        similar_users=SIMILAR_USERS,
        collaborative=COLLABORATIVE,
        genre_side="SELECT user_id, book_id, sum(w) / any_value(total) AS genre_score FROM weights JOIN book_genres USING (genre_id) JOIN (SELECT book_id FROM rated WHERE listable) USING (book_id) ANTI JOIN excluded USING (user_id, book_id) GROUP BY 1, 2",
    ),
)
add(
    "p08_because_you_liked",
    personal.because_you_liked,
    personal_sql(
        """SELECT user_id, book_id, round(coalesce(genre_score, 0) * 0.5::DOUBLE + coalesce(reader_score, 0) * 0.5::DOUBLE, 6) AS score FROM genre_side FULL JOIN reader_side USING (user_id, book_id) SEMI JOIN (SELECT book_id FROM rated WHERE listable) USING (book_id)""",
        "score DESC",
        anchors=ANCHORS,
        sizes="SELECT book_id, count(*) AS n FROM book_genres GROUP BY 1",
        jaccard="""SELECT anchor_id, t.book_id, shared / CAST(a.n + t.n - shared AS DOUBLE) AS genre_score FROM (SELECT x.book_id AS anchor_id, y.book_id, count(*) AS shared FROM book_genres x JOIN book_genres y USING (genre_id) WHERE x.book_id IN (SELECT anchor_id FROM anchors) AND x.book_id <> y.book_id GROUP BY 1, 2) s
    JOIN sizes a ON a.book_id = anchor_id JOIN sizes t ON t.book_id = s.book_id""",
        genre_side="SELECT user_id, book_id, genre_score FROM anchors JOIN jaccard USING (anchor_id) ANTI JOIN excluded USING (user_id, book_id)",
        fans="SELECT book_id AS anchor_id, user_id AS other_id FROM reads WHERE book_id IN (SELECT anchor_id FROM anchors) QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY user_id) <= 500",
        together="SELECT anchor_id, r.book_id, count(*) AS readers FROM fans JOIN reads r ON r.user_id = other_id AND r.book_id <> anchor_id GROUP BY 1, 2 HAVING count(*) >= 2",
        reader_side="SELECT user_id, book_id, readers / CAST(max(readers) OVER (PARTITION BY user_id) AS DOUBLE) AS reader_score FROM (SELECT user_id, book_id, readers FROM anchors JOIN together USING (anchor_id) ANTI JOIN excluded USING (user_id, book_id))",
    ),
)
add("p09_continue_series", personal.continue_series, personal_sql("SELECT user_id, book_id, series_position AS score FROM progress JOIN (SELECT * FROM rated WHERE listable) USING (series_id) ANTI JOIN excluded USING (user_id, book_id)", "score ASC NULLS LAST", progress=IN_PROGRESS))
add(
    "p10_from_favorite_authors",
    personal.from_favorite_authors,
    personal_sql("SELECT user_id, book_id, avg_rating AS score FROM (SELECT DISTINCT r.user_id, b.book_id FROM reads r JOIN book_authors a USING (book_id) JOIN book_authors b ON a.author_id = b.author_id) ANTI JOIN excluded USING (user_id, book_id) JOIN (SELECT * FROM rated WHERE listable) USING (book_id)", "score DESC NULLS LAST"),
)
IN_GENRES = "(SELECT DISTINCT user_id, book_id FROM weights JOIN book_genres USING (genre_id) WHERE rank <= {}) ANTI JOIN excluded USING (user_id, book_id) JOIN (SELECT * FROM rated WHERE listable AND {}) USING (book_id)"
add("p11_top_in_genre", personal.top_in_genre, personal_sql(f"SELECT user_id, book_id, avg_rating AS score, rating_count FROM {IN_GENRES.format(1, 'avg_rating IS NOT NULL')}", "score DESC, rating_count DESC"))
add("p12_want_to_read_picks", personal.want_to_read_picks, personal_sql("SELECT user_id, book_id, avg_rating AS score, ol_already_read_count FROM bookshelves JOIN (SELECT * FROM rated WHERE listable) USING (book_id) WHERE status = 'want_to_read'", "score DESC NULLS LAST, ol_already_read_count DESC"))
add(
    "p13_readers_like_you",
    personal.readers_like_you,
    personal_sql("SELECT user_id, book_id, readers AS score, avg_rating FROM collaborative JOIN (SELECT * FROM rated WHERE listable) USING (book_id) WHERE readers >= 2", "score DESC, avg_rating DESC NULLS LAST", similar_users=SIMILAR_USERS, collaborative=COLLABORATIVE),
)
add("p14_hidden_gems", personal.hidden_gems, personal_sql(f"SELECT user_id, book_id, avg_rating AS score, rating_count FROM {IN_GENRES.format(3, 'rating_count BETWEEN 3 AND 20 AND avg_rating >= 4 AND view_count < 500')}", "score DESC, rating_count DESC"))
add(
    "p15_you_might_like",
    partial(personal.you_might_like, book_id=7),
    personal_sql(
        "SELECT user_id, book_id, round(score, 6) AS score, avg_rating FROM (SELECT user_id, book_id, sum(w) / any_value(total) AS score FROM weights JOIN book_genres USING (genre_id) WHERE book_id <> 7 AND genre_id IN (SELECT genre_id FROM book_genres WHERE book_id = 7) GROUP BY 1, 2) ANTI JOIN excluded USING (user_id, book_id) JOIN (SELECT * FROM rated WHERE listable) USING (book_id)",
        "score DESC, avg_rating DESC NULLS LAST",
    ),
)
add(
    "p16_unread_by_author",
    partial(personal.unread_by_author, author_id=3, user_id=7),
    personal_sql("SELECT CAST(7 AS BIGINT) AS user_id, book_id, avg_rating AS score FROM book_authors JOIN (SELECT * FROM rated WHERE listable) USING (book_id) WHERE author_id = 3 AND book_id NOT IN (SELECT book_id FROM bookshelves WHERE user_id = 7)", "score DESC NULLS LAST"),
)
HOME_KEYS = ("p07_for_you", "p08_because_you_liked", "p09_continue_series", "p10_from_favorite_authors", "p11_top_in_genre", "p12_want_to_read_picks", "p13_readers_like_you", "p14_hidden_gems")
add(
    "p17_home",
    personal.home,
    f"SELECT section, user_id, rank, book_id, score FROM ({sql('SELECT user_id FROM bookshelves GROUP BY 1 HAVING count(DISTINCT book_id) >= 5')}) warm JOIN ("
    + "\nUNION ALL ".join(f"SELECT '{key[4:]}' AS section, * FROM ({ORACLE_SQL[key]})" for key in HOME_KEYS)
    + ") USING (user_id)",
)
add("p19_active_users", profile.active_users, sql("SELECT user_id FROM bookshelves GROUP BY 1 HAVING count(DISTINCT book_id) >= 5"))

# ---- search

BAYES = "round((n * {a} + 30.0::DOUBLE) / (n + 10.0::DOUBLE), 6) AS bayesian_score"
add(
    "q01_book_docs",
    search.book_documents,
    sql(f"SELECT book_id, title, slug, language, primary_cover_url, coalesce(author_names, '') AS authors_names, coalesce(series_id, '') AS series_name, n, {BAYES.format(a='coalesce(combined, 0)')} FROM (SELECT *, total_ratings AS n FROM rated LEFT JOIN names USING (book_id))"),
)
ROLL = "SELECT {k}, language, count(DISTINCT book_id) AS book_count, CAST(sum(total_ratings) AS BIGINT) AS n, sum(points) AS points FROM {t} GROUP BY ALL"
AVG = "coalesce(points / nullif(CAST(n AS DOUBLE), 0), 0)"
add("q02_author_rollup", search.author_documents, sql(f"SELECT author_id, language, book_count, n, {BAYES.format(a=AVG)}, name, slug FROM ({ROLL.format(k='author_id', t='book_authors JOIN rated USING (book_id)')}) JOIN authors USING (author_id)"))
add("q03_series_rollup", search.series_documents, sql(f"SELECT series_id, language, book_count, n, {BAYES.format(a=AVG)}, series_id AS name, lower(replace(series_id, ' ', '-')) AS slug FROM ({ROLL.format(k='series_id', t='(SELECT * FROM rated WHERE series_id IS NOT NULL)')})"))
TEXT_QUERY = "the and with"


def _index(cat: Catalogue) -> SearchIndex:
    """The catalogue's search index, written to the shared folder when it is first asked for."""
    if "search_index" not in cat.__dict__:
        index, texts = SearchIndex(cat.spark, f"{shared_dir(cat.spark)}/index-{uuid.uuid4().hex}"), cut(search.all_texts(cat))  # read twice
        index.apply(texts, texts.select("doc"), 0)
        cat.__dict__["search_index"] = index
    return cat.__dict__["search_index"]


def _text_index(cat: Catalogue) -> SearchIndex:
    """An index of the documents' texts, for words as they are."""
    if "text_index" not in cat.__dict__:
        index = SearchIndex(cat.spark, f"{shared_dir(cat.spark)}/texts-{uuid.uuid4().hex}", fuzzy=False)
        texts = cat.table("documents").select(F.lit("text").alias("field"), F.col("doc_id").cast("string").alias("doc"), "text", F.lit(False).alias("stem"))
        index.apply(texts, texts.select("doc"), 0)
        cat.__dict__["text_index"] = index
    return cat.__dict__["text_index"]


add(
    "q05_bm25",
    lambda cat: _text_index(cat).best_field({"text": 1.0}, TEXT_QUERY).select(F.col("doc").cast("long").alias("doc_id"), X.six(F.col("score")).alias("score")),
    r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(lower(coalesce(text, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\p{L}\p{N}]+') AS terms FROM documents),
s AS (SELECT count(*) AS n, avg(len(terms)) AS average FROM t WHERE len(terms) > 0),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(length) AS length FROM (SELECT doc_id, len(terms) AS length, unnest(terms) AS term FROM t) WHERE term IN ('the', 'and', 'with') GROUP BY 1, 2),
d AS (SELECT term, count(*) AS df FROM p GROUP BY 1)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / average)))), 6) AS score FROM p JOIN d USING (term), s GROUP BY 1
""",
)


#: What Porter's rules make of the words in the test titles that they change.
STEMS = {"large": "larg"}


def field_sql(source: str, key: str, field: str, weight: float, query: str, stem: bool = False) -> str:
    """BM25 of one field with typo tolerance, times its weight."""
    words = [STEMS.get(w, w) if stem else w for w in query.split()]
    asked = " UNION ALL ".join(f"SELECT '{w}' AS asked, {search.fuzzy_edits(w)} AS edits" for w in words)
    term = f"CASE term {' '.join(f"WHEN '{w}' THEN '{to}'" for w, to in STEMS.items())} ELSE term END" if stem else "term"
    return f"""(WITH t AS (SELECT {key} AS doc, regexp_extract_all(lower({field}), '[\\p{{L}}\\p{{N}}]+') AS terms FROM {source}),
  s AS (SELECT count(*) AS n, avg(len(terms)) AS average FROM t WHERE len(terms) > 0),
  p AS (SELECT doc, {term} AS term, length, count(*) AS tf FROM (SELECT doc, len(terms) AS length, unnest(terms) AS term FROM t) GROUP BY ALL),
  m AS (SELECT * FROM p JOIN ({asked}) ON levenshtein(term, asked) <= edits),
  d AS (SELECT term, count(DISTINCT doc) AS df FROM m GROUP BY 1),
  b AS (SELECT doc, asked, max(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / average)))) AS part FROM m JOIN d USING (term), s GROUP BY 1, 2)
  SELECT doc, sum(part) * {weight}::DOUBLE AS score FROM b GROUP BY 1)"""


def hits_sql(kind: str, source: str, key: str, title: str, fields: dict[str, float], query: str, stemmed: tuple[str, ...] = ()) -> str:
    parts = " UNION ALL ".join(f"SELECT * FROM {field_sql('docs', key, f, w, query, f in stemmed)}" for f, w in fields.items())
    return f"""WITH docs AS (SELECT * FROM ({source}) WHERE language = 'en')
SELECT '{kind}' AS type, CAST(doc AS VARCHAR) AS id, {title} AS title, round(score + 4.0::DOUBLE * bayesian_score, 6) AS score FROM (SELECT doc, max(score) AS score FROM ({parts}) GROUP BY 1) JOIN docs ON docs.{key} = doc"""


BOOK_FIELDS, NAME_FIELDS = search.BOOK_FIELDS, search.NAME_FIELDS
add("q06_search_books", lambda cat: search.search_books(cat, "gren small", stem=False, index=_index(cat)), hits_sql("book", ORACLE_SQL["q01_book_docs"], "book_id", "title", BOOK_FIELDS, "gren small"))
add("q06b_search_books_stemmed", lambda cat: search.search_books(cat, "gren small", index=_index(cat)), hits_sql("book", ORACLE_SQL["q01_book_docs"], "book_id", "title", BOOK_FIELDS, "gren small", search.STEMMED))
add("q07_search_authors", lambda cat: search.search_authors(cat, "supplier", index=_index(cat)), hits_sql("author", ORACLE_SQL["q02_author_rollup"], "author_id", "name", NAME_FIELDS, "supplier"))
add("q08_search_series", lambda cat: search.search_series(cat, "brend 23", index=_index(cat)), hits_sql("series", ORACLE_SQL["q03_series_rollup"], "series_id", "name", NAME_FIELDS, "brend 23"))
add("q09_search", lambda cat: search.federated(cat, "green large", index=_index(cat)))  # its SQL is in merges.py


def texts_sql() -> str:
    """(field, doc, term, tf, length) of all fields without stems."""
    parts = []
    for kind, key, fields in (("book", "book_id", BOOK_FIELDS), ("author", "author_id", NAME_FIELDS), ("series", "series_id", NAME_FIELDS)):
        source = ORACLE_SQL[{"book": "q01_book_docs", "author": "q02_author_rollup", "series": "q03_series_rollup"}[kind]]
        parts += [f"SELECT '{kind}/' || language || '/{f}' AS field, '{kind}/' || language || '/' || {key} AS doc, {f} AS text FROM ({source})" for f in fields]
    return f"""
SELECT field, doc, term, count(*) AS tf, any_value(length) AS length FROM (
  SELECT field, doc, len(terms) AS length, unnest(terms) AS term FROM (SELECT field, doc, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS terms FROM ({' UNION ALL '.join(parts)})))
GROUP BY field, doc, term"""


def _unstemmed(index: SearchIndex) -> DataFrame:
    return index.held().where(~F.col("field").endswith("~"))


add("k17_search_index", lambda cat: _unstemmed(_index(cat)).select("field", "doc", "term", "tf", "length"), texts_sql())
add(
    "k17_dictionary",
    lambda cat: _index(cat).dictionary().where("term <> 'larg'").select("term", "key"),
    f"""
WITH t AS (SELECT DISTINCT term, length(term) AS n FROM ({texts_sql()})),
i AS (SELECT term, n, unnest(range(1, n + 1)) AS i FROM t WHERE n > 1),
once AS (SELECT term, n, i, substr(term, 1, i - 1) || substr(term, i + 1) AS key FROM i),
twice AS (SELECT term, substr(key, 1, j - 1) || substr(key, j + 1) AS key FROM (SELECT *, unnest(range(1, n)) AS j FROM once WHERE n > 3))
SELECT term, term AS key FROM t UNION SELECT term, key FROM once UNION SELECT term, key FROM twice""",
)


def _reindexed_texts(cat: Catalogue) -> DataFrame:
    """The index of another state of the catalogue (titles that were different, books that weren't there or are no longer)
    after three batches of changes, of which one comes twice."""
    texts = cut(search.all_texts(cat))  # four batches read it
    number = F.when(F.col("doc").startswith("book/"), F.regexp_extract("doc", "[0-9]+$", 0).cast("long"))
    of = lambda rest: texts.where(F.coalesce(number % 6 == rest, F.lit(False)))
    older = F.when(F.coalesce(number % 6 == 1, F.lit(False)), F.concat(F.lit("older "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    gone = texts.where(F.coalesce(number % 6 == 3, F.lit(False))).withColumn("doc", F.concat("doc", F.lit("0000000")))
    then = texts.where(F.coalesce(number % 6 != 2, F.lit(True))).withColumn("text", older).unionByName(gone)
    index = SearchIndex(cat.spark, f"{shared_dir(cat.spark)}/reindex-{uuid.uuid4().hex}", 8)
    index.apply(then, then.select("doc"), 0)
    for batch, (new, docs) in enumerate([(of(1), of(1)), (of(2), of(2)), (of(2), of(2)), (gone.limit(0), gone)]):
        index.apply(new, docs.select("doc"), (1, 2, 2, 3)[batch])
    return _unstemmed(index).select("field", "doc", "term", "tf", "length")


add("m02_reindex", _reindexed_texts, texts_sql())
add(
    "q10_category_search",
    lambda cat: search.search_categories(cat, "Red").select("book_id", "title", "rating_count", "avg_rating"),
    sql("SELECT book_id, title, CAST(total_ratings AS BIGINT) AS rating_count, round(coalesce(avg_rating, 0), 6) AS avg_rating FROM rated WHERE language = 'en' AND book_id IN (SELECT book_id FROM book_genres WHERE contains(genre_id, 'red') OR contains(replace(genre_id, '-', ' '), 'red'))"),
)
add(
    "q11_top_books",
    lambda cat: search.top_books_of(cat, cat.book_authors, "author_id"),
    sql("SELECT author_id, CAST(nth AS INTEGER) AS nth, book_id, title FROM (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY total_ratings DESC, avg_rating DESC NULLS LAST, book_id) AS nth FROM book_authors JOIN rated USING (book_id) WHERE language = 'en') WHERE nth <= 3"),
)

# ---- browsing

SHELF_COUNTS = "SELECT book_id, count(*) FILTER (WHERE status = 'want_to_read') AS want_to_read, count(*) FILTER (WHERE status = 'reading') AS reading, count(*) FILTER (WHERE status = 'read') AS read FROM bookshelves GROUP BY 1"
READERS = "SELECT r.*, coalesce(want_to_read, 0) AS want_to_read, coalesce(reading, 0) AS reading, coalesce(read, 0) AS read, CAST(library_readers + coalesce(want_to_read, 0) + coalesce(reading, 0) + coalesce(read, 0) AS BIGINT) AS total_readers FROM rated r LEFT JOIN shelf_counts USING (book_id)"
BROWSE = {"shelf_counts": SHELF_COUNTS, "wide": READERS}
add(
    "q12_book_details",
    browse.book_details,
    sql(
        "SELECT book_id, title, slug, language, coalesce(author_names, '') AS author_names, coalesce(g, '') AS genres, coalesce(series_id, '') AS series_id, series_position, want_to_read, reading, read, total_readers, round(combined, 6) AS combined_rating FROM wide LEFT JOIN names USING (book_id) LEFT JOIN (SELECT book_id, string_agg(genre_id, ', ' ORDER BY genre_id) AS g FROM book_genres GROUP BY 1) USING (book_id)",
        **BROWSE,
    ),
)
SUMS = "CAST(count(*) AS BIGINT) AS book_count, round(coalesce(sum(points) / nullif(CAST(sum(total_ratings) AS DOUBLE), 0), 0), 6) AS avg_rating, CAST(sum(total_ratings) AS BIGINT) AS rating_count, CAST(sum(total_readers) AS BIGINT) AS readers"
add(
    "q13_author_details",
    browse.author_details,
    sql(
        f"""
SELECT author_id, name, slug, s.* EXCLUDE (author_id), coalesce(genres, '') AS genres FROM authors JOIN (SELECT author_id, {SUMS} FROM book_authors JOIN wide USING (book_id) GROUP BY 1) s USING (author_id)
LEFT JOIN (SELECT author_id, string_agg(genre_id, ', ' ORDER BY n DESC, genre_id) AS genres FROM (SELECT author_id, genre_id, count(DISTINCT book_id) AS n FROM book_authors JOIN book_genres USING (book_id) GROUP BY 1, 2 HAVING count(DISTINCT book_id) >= 3) GROUP BY 1) USING (author_id)""",
        **BROWSE,
    ),
)


def page_sql(key: str, source: str, order: str, low: int = 0, high: int = 10) -> str:
    return sql(
        f"SELECT {key}, CAST(position AS INTEGER) AS position, book_id, title, round(coalesce(combined, 0), 6) AS combined_rating, total_readers, original_publication_year, total FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}, book_id) AS position, count(*) OVER (PARTITION BY {key}) AS total FROM {source}) WHERE position > {low} AND position <= {high}",
        **BROWSE,
    )


MINE = "(SELECT * FROM book_authors JOIN wide USING (book_id) WHERE language = 'en')"
add("q14_author_books", browse.author_books, page_sql("author_id", MINE, "coalesce(combined, 0) DESC NULLS LAST"))
add("q14_author_books_by_year", partial(browse.author_books, sort="publication_year", descending=False, limit=3, offset=2), page_sql("author_id", MINE, "original_publication_year ASC NULLS LAST", 2, 5))
SERIES = "(SELECT * FROM wide WHERE series_id IS NOT NULL AND language = 'en')"
add("q15_series_details", browse.series_details, sql(f"SELECT series_id, {SUMS} FROM {SERIES} GROUP BY 1", **BROWSE))
add("q16_series_books", browse.series_books, page_sql("series_id", SERIES, "series_position ASC NULLS LAST, created_at ASC NULLS LAST"))
#: Categories that the test genres fall into; the fixed ones hold none of them.
TEST_CATEGORIES = {"metals": ("Metals", ("steel", "brass", "tin"), ("copper",)), "colours": ("Colours", ("red", "blue", "green"), ()), "sizes": ("Sizes", ("size",), ("small",))}


def _category_case() -> str:
    parts = []
    for slug, (_, words, exact) in TEST_CATEGORIES.items():
        holds = [f"contains(lower(replace(genre_id, '-', ' ')), '{w}')" for w in words] + [f"genre_id = '{e}'" for e in exact]
        parts.append(f"SELECT '{slug}' AS category, genre_id FROM genres WHERE {' OR '.join(holds)}")
    return " UNION ALL ".join(parts)


def category_sql(order: str, k: int = 20) -> str:
    return f"SELECT category, CAST(position AS INTEGER) AS position, book_id, title, CAST(total_ratings AS BIGINT) AS rating_count, round(coalesce(combined, 0), 6) AS combined_rating, total FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {order} DESC NULLS LAST, book_id) AS position, count(*) OVER (PARTITION BY category) AS total FROM tagged JOIN rated USING (book_id) WHERE language = 'en') WHERE position <= {k}"


CATEGORY = {"mapping": _category_case(), "tagged": "SELECT DISTINCT category, book_id FROM mapping JOIN book_genres USING (genre_id)"}
add("q17_category_genres", partial(browse.category_genres, categories=TEST_CATEGORIES), sql("SELECT genre_id, category FROM mapping", **CATEGORY))
add("q18_category_books", partial(browse.category_books, categories=TEST_CATEGORIES), sql(category_sql("total_ratings"), **CATEGORY))
add("q18_category_books_by_rating", partial(browse.category_books, sort="rating", categories=TEST_CATEGORIES), sql(category_sql("coalesce(combined, 0)"), **CATEGORY))
add("q20_category_cache", partial(browse.category_cache, categories=TEST_CATEGORIES), sql(f"SELECT *, 'popularity' AS sort FROM ({category_sql('total_ratings')}) UNION ALL SELECT *, 'rating' AS sort FROM ({category_sql('coalesce(combined, 0)')})", **CATEGORY))
FACETS = discover.Facets(length="medium", era="modern", quality="high")
FOUND = "SELECT * FROM wide WHERE language = 'en' AND number_of_pages BETWEEN 200 AND 400 AND original_publication_year BETWEEN 1950 AND 1999 AND total_ratings > 0 AND combined > 4"
add("q21_count", lambda cat: discover.candidates(cat, FACETS).agg(F.count("*").alias("candidates")), sql(f"SELECT count(*) AS candidates FROM ({FOUND})", **BROWSE))
add(
    "q21_pick",
    partial(discover.pick, facets=FACETS, seed=SEED, n=5),
    sql(f"SELECT book_id, title, round(combined, 6) AS combined_rating, total_readers, (SELECT count(*) FROM found) AS candidates FROM found ORDER BY md5(book_id || ':42'), book_id LIMIT 5", **BROWSE, found=FOUND),
)
OTHER = discover.Facets(popularity="popular", series="standalone", dimension="pacing", genres=("small", "large", "red"))
add(
    "q21_other_facets",
    lambda cat: discover.candidates(cat, OTHER).select("book_id", "title", F.col("total_readers").cast("long").alias("total_readers")),
    sql(
        "SELECT book_id, title, total_readers FROM wide WHERE language = 'en' AND total_readers > 100 AND series_id IS NULL AND book_id IN (SELECT book_id FROM book_genres WHERE genre_id IN ('small', 'large', 'red')) AND book_id IN (SELECT book_id FROM ratings WHERE pacing IS NOT NULL GROUP BY 1 HAVING avg(pacing) >= 3.5 AND count(*) >= 3)",
        **BROWSE,
    ),
)
add("q23_coverage", partial(browse.coverage, external_total=100_000), sql("SELECT count(*) FILTER (WHERE language = 'en') AS books, round(count(*) FILTER (WHERE language = 'en') * 100.0::DOUBLE / 100000, 6) AS coverage_percent, (SELECT count(*) FROM authors) AS authors, (SELECT count(*) FROM genres) AS genres FROM books"))

# ---- games

TIERED = """SELECT *, CASE WHEN combined > 4.65 AND total_ratings >= 25 THEN 'legendary' WHEN combined > 4.5 AND combined <= 4.65 AND total_ratings >= 20 THEN 'ultra_rare' WHEN combined > 4 AND combined <= 4.5 AND total_ratings >= 15 THEN 'super_rare'
    WHEN combined > 3.25 AND combined <= 4 AND total_ratings >= 8 THEN 'rare' WHEN combined > 2.25 AND combined <= 3.25 AND total_ratings >= 3 THEN 'uncommon' WHEN combined <= 2.25 AND total_ratings >= 1 THEN 'common' END AS tier FROM rated WHERE listable"""
SIZES = "CASE tier " + " ".join(f"WHEN '{t}' THEN {n}" for t, n in sampling.POOL_SIZES.items()) + " END"
add("g01_tiers", sampling.tier_counts, sql("SELECT tier, count(*) AS books FROM tiered WHERE tier IS NOT NULL GROUP BY 1", tiered=TIERED))
add(
    "g02_pools",
    partial(sampling.pools, seed=SEED),
    sql(f"SELECT tier, CAST(nth AS INTEGER) AS nth, book_id, title, round(combined, 6) AS combined_rating FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY md5(book_id || ':42'), book_id) AS nth FROM tiered WHERE tier IS NOT NULL) WHERE nth <= {SIZES}", tiered=TIERED),
)
SLOTS = "CASE tier " + " ".join(f"WHEN '{t}' THEN {n}" for t, n in sampling.DISPLAY.items()) + " END"
add(
    "g07_display",
    partial(sampling.display, winner=11, seed=SEED),
    sql(f"SELECT book_id, tier, title FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY md5(book_id || ':42'), book_id) AS nth FROM tiered WHERE tier IS NOT NULL AND book_id <> 11) WHERE nth <= {SLOTS} + 24 ORDER BY nth > {SLOTS}, md5(book_id || ':42'), book_id LIMIT 24", tiered=TIERED),
)
add("g08_packs", partial(sampling.packs, seed=SEED))
UNIFORM = "(('0x' || substr(md5('42:{}:' || user_id), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


def tier_sql(what: str, tiers: tuple[sampling.Tier, ...] = sampling.TIERS) -> str:
    """The tier that a user rolls for something, among the tiers given."""
    upto = [sum(t.chance for t in tiers[: i + 1]) for i in range(len(tiers))]
    return "CASE " + " ".join(f"WHEN {UNIFORM.format(what)} * {upto[-1]!r}::DOUBLE < {c!r}::DOUBLE THEN '{t.name}'" for t, c in zip(tiers, upto)) + f" ELSE '{tiers[-1].name}' END"


add("g03_rolls", partial(sampling.rolls, seed=SEED), sql(f"SELECT user_id, {tier_sql('roll')} AS tier FROM users"))
NEAREST = ", ".join(f"('{t.name}', '{n}', {i})" for t in sampling.TIERS for i, n in enumerate([t.name, *sampling.fallback_order(t.name)]))
REELS = {k: "CASE tier " + " ".join(f"WHEN '{t.name}' THEN {tier_sql(k, sampling.TIERS[: i + 1])}" for i, t in enumerate(sampling.TIERS)) + " END" for k in ("reel-1", "reel-2")}
add(
    "g10_slots",
    partial(sampling.spins, seed=SEED),
    sql(
        f"""
SELECT user_id, tier, book_id, array_to_string(list_transform(list_sort([
    {{'at': {UNIFORM.format('place-reel-0')}, 'tier': tier}}, {{'at': {UNIFORM.format('place-reel-1')}, 'tier': {REELS['reel-1']}}}, {{'at': {UNIFORM.format('place-reel-2')}, 'tier': {REELS['reel-2']}}}]), lambda p: p.tier), ' ') AS reels
FROM (SELECT user_id, {tier_sql('roll')} AS rolled FROM users)
JOIN (SELECT rolled, arg_min(tier, distance) AS tier, arg_min(size, distance) AS size FROM (VALUES {NEAREST}) n(rolled, tier, distance) JOIN (SELECT tier, count(*) AS size FROM pool GROUP BY 1) USING (tier) GROUP BY 1) USING (rolled)
JOIN pool USING (tier) WHERE nth = CAST(floor({UNIFORM.format('book')} * size) AS BIGINT) + 1""",
        tiered=TIERED,
        pool=f"SELECT tier, nth, book_id FROM (SELECT tier, book_id, row_number() OVER (PARTITION BY tier ORDER BY md5(book_id || ':42'), book_id) AS nth FROM tiered WHERE tier IS NOT NULL) WHERE nth <= {SIZES}",
    ),
)

# ---- user data

add("u01_shelf_stats", userdata.shelf_stats, sql("SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("want_to_read", "reading", "read", "abandoned")) + ", count(*) FILTER (WHERE is_favorite) AS favorites FROM bookshelves GROUP BY 1"))
add("u02_rating_counts", userdata.rating_counts, sql("SELECT user_id, count(*) AS ratings FROM ratings GROUP BY 1"))
add("u03_comment_counts", userdata.comment_counts, sql("SELECT user_id, count(*) AS comments FROM comments GROUP BY 1"))
HALVES = "CAST((CAST(sum({c} * 2) AS BIGINT) * 100 + count(*)) // (count(*) * 2) AS DOUBLE) / 100"
add("u04_book_rating_stats", lambda cat: userdata.book_rating_stats(cat.ratings), sql(f"SELECT book_id, count(*) AS rating_count, {HALVES.format(c='overall_rating')} AS avg_rating FROM ratings GROUP BY 1"))
add("u04_dimension_stats", userdata.dimension_stats, sql(" UNION ALL ".join(f"SELECT book_id, '{d}' AS dimension, count(*) AS n, {HALVES.format(c=d)} AS average FROM ratings WHERE {d} IS NOT NULL GROUP BY 1" for d in X.DIMENSIONS)))
add("u04_distribution", lambda cat: userdata.rating_distribution(cat.ratings), sql("SELECT book_id, overall_rating AS value, count(*) AS n FROM ratings GROUP BY 1, 2"))


def user_page_sql(source: str, columns: str, order: str, key: str = "user_id", high: int = 10) -> str:
    return sql(f"SELECT {columns}, CAST(position AS INTEGER) AS position, total FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS position, count(*) OVER (PARTITION BY {key}) AS total FROM {source}) WHERE position <= {high}")


add("u05_user_shelves", userdata.user_shelves, user_page_sql("bookshelves", "user_id, book_id, status", "updated_at DESC, book_id"))
add("u05_reading", partial(userdata.user_shelves, status="reading", limit=3), user_page_sql("(SELECT * FROM bookshelves WHERE status = 'reading')", "user_id, book_id, status", "updated_at DESC, book_id", high=3))
add("u06_user_ratings", partial(userdata.user_ratings, low=2.5, high=4.5), user_page_sql("(SELECT * FROM ratings WHERE overall_rating BETWEEN 2.5 AND 4.5)", "user_id, book_id, overall_rating", "overall_rating DESC, book_id"))
add("u07_user_comments", userdata.user_comments, user_page_sql("comments", "user_id, comment_id, book_id", "created_at DESC, comment_id DESC"))
COMMENTED = "(SELECT c.comment_id, c.user_id, c.book_id, c.is_spoiler, c.created_at, coalesce(username, '') AS username, overall_rating FROM comments c LEFT JOIN ratings r ON r.user_id = c.user_id AND r.book_id = c.book_id LEFT JOIN users u ON u.user_id = c.user_id {})"
add("u08_book_comments", userdata.book_comments, user_page_sql(COMMENTED.format(""), "book_id, comment_id, username, overall_rating, is_spoiler", "overall_rating DESC NULLS LAST, created_at DESC, comment_id DESC", "book_id"))
add("u08_no_spoilers", partial(userdata.book_comments, spoilers=False, sort="created_at"), user_page_sql(COMMENTED.format("WHERE NOT is_spoiler"), "book_id, comment_id, username, overall_rating, is_spoiler", "created_at DESC, comment_id DESC", "book_id"))
STATS = """SELECT user_id, """ + ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("want_to_read", "reading", "read", "abandoned", "favorites", "ratings", "comments"))
STAT_TABLES = {
    "shelf_stats": "SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in ("want_to_read", "reading", "read", "abandoned")) + ", count(*) FILTER (WHERE is_favorite) AS favorites FROM bookshelves GROUP BY 1",
    "rating_stats": "SELECT user_id, count(*) AS ratings FROM ratings GROUP BY 1",
    "comment_stats": "SELECT user_id, count(*) AS comments FROM comments GROUP BY 1",
}
add("u09_user_stats", userdata.user_stats, sql(f"{STATS} FROM shelf_stats FULL JOIN rating_stats USING (user_id) FULL JOIN comment_stats USING (user_id)", **STAT_TABLES))
add("u10_public_profile", userdata.public_profile, sql(f"{STATS}, username FROM users LEFT JOIN shelf_stats USING (user_id) LEFT JOIN rating_stats USING (user_id) LEFT JOIN comment_stats USING (user_id)", **STAT_TABLES))

# ---- expressions

add(
    "z01_slug",
    lambda cat: cat.books.select("book_id", X.slug_ascii(F.concat(F.lit(" The "), F.col("title"), F.lit(": a  Life! "))).alias("slug")),
    sql(r"SELECT book_id, trim(regexp_replace(regexp_replace(lower(' The ' || title || ': a  Life! '), '[^a-z0-9_\s-]', '', 'g'), '[-\s]+', '-', 'g'), '-') AS slug FROM books"),
)
add("z02_clean_text", lambda cat: cat.table("pages").select("page_id", T.clean_description(F.col("html")).alias("text")))
add(
    "z13_quality_scores",
    cleanup.quality_scores,
    sql("SELECT book_id, CAST((description IS NOT NULL)::INT + (primary_cover_url IS NOT NULL)::INT + (book_id IN (SELECT book_id FROM book_authors))::INT + (book_id IN (SELECT book_id FROM book_genres))::INT + 1 + (isbn IS NOT NULL)::INT + coalesce(number_of_pages > 0, false)::INT + (publisher IS NOT NULL)::INT AS INTEGER) AS score FROM books"),
)
add("z21_rarity", lambda cat: cat.books.select("book_id", X.rarity(X.combined_rating()).alias("rarity")), sql("SELECT book_id, CASE WHEN c >= 4.75 THEN 'legendary' WHEN c >= 4.5 THEN 'ultra_rare' WHEN c >= 4 THEN 'super_rare' WHEN c >= 3.25 THEN 'rare' WHEN c >= 2.25 THEN 'uncommon' ELSE 'common' END AS rarity FROM (SELECT book_id, coalesce(combined, 0) AS c FROM rated)"))

# ---- clean-up

SHELVED = "SELECT book_id, count(*) AS shelves FROM bookshelves GROUP BY 1"
SCORES = "SELECT book_id, CAST((description IS NOT NULL)::INT + (primary_cover_url IS NOT NULL)::INT + (book_id IN (SELECT book_id FROM book_authors))::INT + (book_id IN (SELECT book_id FROM book_genres))::INT + 1 + (isbn IS NOT NULL)::INT + coalesce(number_of_pages > 0, false)::INT + (publisher IS NOT NULL)::INT AS INTEGER) AS score FROM books"
add(
    "d01_low_quality_books",
    partial(cleanup.low_quality_books, as_of=AS_OF, least_score=7, few=60),
    sql("SELECT book_id, score FROM rated JOIN scores USING (book_id) LEFT JOIN shelved USING (book_id) WHERE score < 7 AND view_count = 0 AND total_ratings < 60 AND ol_already_read_count + coalesce(shelves, 0) < 60 AND created_at < TIMESTAMP '2030-01-01' - INTERVAL 1 DAY", shelved=SHELVED, scores=SCORES),
)
add(
    "d02_low_relevance_authors",
    partial(cleanup.low_relevance_authors, few_books=12, few=6000),
    sql("SELECT author_id, CAST(coalesce(n, 0) AS BIGINT) AS books FROM authors LEFT JOIN (SELECT author_id, count(*) AS n, sum(total_ratings) AS r, sum(coalesce(shelves, 0)) AS s FROM book_authors JOIN rated USING (book_id) LEFT JOIN shelved USING (book_id) GROUP BY 1) USING (author_id) WHERE view_count = 0 AND coalesce(n, 0) <= 12 AND coalesce(r, 0) < 6000 AND coalesce(s, 0) < 6000", shelved=SHELVED),
)
add("d03_small_series", partial(cleanup.small_series, few=26), sql("SELECT series_id, count(*) AS books FROM books WHERE series_id IS NOT NULL GROUP BY 1 HAVING count(*) <= 26"))
add(
    "d04_orphan_genres",  # brands stand for genre rows without a book
    lambda cat: cleanup.orphan_genres(cat.genres.select("genre_id").unionByName(cat.table("part").select(F.lower("p_brand").alias("genre_id")).distinct()), cat.book_genres),
    sql("SELECT genre_id FROM (SELECT genre_id FROM genres UNION ALL SELECT DISTINCT lower(p_brand) FROM part) WHERE genre_id NOT IN (SELECT genre_id FROM book_genres)"),
)
add("d04b_unlinked_genres", cleanup.unlinked_genres, sql("SELECT genre_id FROM genres WHERE genre_id NOT IN (SELECT genre_id FROM book_genres)"))
add("d05_small_genres", partial(cleanup.small_genres, few=250), sql("SELECT genre_id, count(*) AS books FROM book_genres GROUP BY 1 HAVING count(*) <= 250"))
add("d06_invalid_genres", lambda cat: cleanup.invalid_genres(cat.genres.withColumn("name", F.replace("name", F.lit("Size"), F.lit("Size #")))), sql("SELECT genre_id FROM genres WHERE contains(genre_id, 'size')"))

# ---- merges: events change tables, compared by what the table holds afterwards


def _changes(cat: Catalogue) -> DataFrame:
    """Shelf changes from events: the user moves a book to the reading shelf."""
    events = cat.table("events").where("event_type = 'purchase'")
    return events.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("book_id"), F.lit("reading").alias("status"), F.col("ts").alias("updated_at"), "event_id")


CHANGES = """SELECT user_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS book_id, ts, event_id FROM events WHERE event_type = 'purchase'"""
add(
    "k01_upsert_shelves",
    lambda cat: merge.upsert_shelves(cat.bookshelves, _changes(cat).drop("event_id")).select("user_id", "book_id", "status", "is_favorite", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("at")),
    sql("SELECT coalesce(b.user_id, c.user_id) AS user_id, coalesce(b.book_id, c.book_id) AS book_id, CASE WHEN c.user_id IS NULL THEN status ELSE 'reading' END AS status, coalesce(is_favorite, false) AS is_favorite, epoch_us(coalesce(last, updated_at)) AS at FROM bookshelves b FULL JOIN (SELECT user_id, book_id, max(ts) AS last FROM changes GROUP BY 1, 2) c ON b.user_id = c.user_id AND b.book_id = c.book_id", changes=CHANGES),
)
add(
    "k02_toggle_favorites",
    lambda cat: merge.toggle_favorites(cat.bookshelves, _changes(cat)).select("user_id", "book_id", "status", "is_favorite"),
    sql("SELECT coalesce(b.user_id, c.user_id) AS user_id, coalesce(b.book_id, c.book_id) AS book_id, coalesce(status, 'want_to_read') AS status, coalesce(is_favorite, false) <> coalesce(odd, false) AS is_favorite FROM bookshelves b FULL JOIN (SELECT user_id, book_id, count(*) % 2 = 1 AS odd FROM changes GROUP BY 1, 2) c ON b.user_id = c.user_id AND b.book_id = c.book_id", changes=CHANGES),
)
add(
    "k03_upsert_ratings",
    lambda cat: merge.upsert_ratings(
        cat.ratings, _changes(cat).select("user_id", "book_id", F.lit(4.5).alias("overall_rating"), F.lit(1.0).alias("pacing"), F.lit(None).cast("double").alias("humor"), F.col("updated_at").alias("created_at")), X.DIMENSIONS
    ).select("user_id", "book_id", "overall_rating", "pacing", "humor"),
    sql("SELECT coalesce(r.user_id, c.user_id) AS user_id, coalesce(r.book_id, c.book_id) AS book_id, CASE WHEN c.user_id IS NULL THEN overall_rating ELSE 4.5 END AS overall_rating, CASE WHEN c.user_id IS NULL THEN pacing ELSE 1.0 END AS pacing, humor FROM ratings r FULL JOIN (SELECT DISTINCT user_id, book_id FROM changes) c ON r.user_id = c.user_id AND r.book_id = c.book_id", changes=CHANGES),
)
add(
    "k04_insert_comments",
    lambda cat: merge.insert_comments(cat.comments.select("comment_id", "user_id", "book_id"), _changes(cat).select((F.col("event_id") + 1_000_000).alias("comment_id"), "user_id", "book_id"))[0],
    sql("SELECT comment_id, user_id, book_id FROM comments UNION ALL SELECT min(event_id) + 1000000 AS comment_id, user_id, book_id FROM changes ANTI JOIN comments USING (user_id, book_id) GROUP BY 2, 3", changes=CHANGES),
)
add("k06_delete_user", lambda cat: merge.deleted(cat.bookshelves, cat.users.where("user_id % 10 = 0").select("user_id")).select("user_id", "book_id", "status"), sql("SELECT user_id, book_id, status FROM bookshelves WHERE user_id % 10 <> 0"))
add(
    "k20_fold_views",
    lambda cat: cat.books.join(cat.view_counts.select(F.col("entity_id").alias("book_id"), F.col("view_count").alias("more")), "book_id", "left").select("book_id", (F.col("view_count") + F.coalesce("more", F.lit(0))).alias("view_count")),
    sql("SELECT book_id, b.view_count + coalesce(v.view_count, 0) AS view_count FROM books b LEFT JOIN view_counts v ON entity_id = book_id"),
)
add(
    "k22_delete_books",
    lambda cat: merge.delete_books({"bookshelves": cat.bookshelves, "ratings": cat.ratings, "comments": cat.comments}, cat.books.where("book_id % 50 = 0").select("book_id"))[1],
    sql(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS deleted FROM {t} WHERE book_id % 50 = 0 AND book_id IN (SELECT book_id FROM books)" for t in ("bookshelves", "ratings", "comments"))),
)
add(
    "u00_affected_users",
    lambda cat: userdata.affected_users(cat, cat.books.where("book_id % 50 = 0").select("book_id")),
    sql("SELECT user_id FROM bookshelves WHERE book_id % 50 = 0 UNION SELECT user_id FROM ratings WHERE book_id % 50 = 0 UNION SELECT user_id FROM comments WHERE book_id % 50 = 0"),
)

# ---- incremental work: what it has made of a table when it has gone through it


def _reindexed(cat: Catalogue) -> DataFrame:
    """Events in the pass that indexes them: those there at first, then those changed since."""
    events = cat.table("events").select("event_id", "ts")
    half = events.where("ts < timestamp_ntz'2024-01-15'")
    first, mark = counters.changed_since(half, "ts", None)
    then, _ = counters.changed_since(events, "ts", mark)
    return first.select("event_id", F.lit(1).alias("pass")).unionByName(then.select("event_id", F.lit(2).alias("pass")))


add("m02_changed_since", _reindexed, "SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 1 ELSE 2 END AS pass FROM events")


def _streamed(cat: Catalogue, table: str, key: str, sink: Callable[[BucketedTable], Callable[[DataFrame, int], None]], change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The table, in buckets by key, that a sink has made of another, streamed."""
    root = f"{shared_dir(cat.spark)}/stream-{uuid.uuid4().hex}"
    stream = cat.spark.readStream.schema(cat.table(table).schema).option("pathGlobFilter", f"{table}.parquet").parquet(cat.sf_dir)
    made = BucketedTable(cat.spark, f"{root}/table", [key])
    counters.drain(change(stream), sink(made), f"{root}/checkpoint", "append")
    return made.read()


add(
    "m06_best_lines",
    lambda cat: _streamed(
        cat,
        "lineitem",
        "book_id",
        lambda to: counters.fold_best(to, ["book_id"], ["less", "l_orderkey", "l_linenumber"]),
        lambda lines: lines.select(F.col("l_partkey").alias("book_id"), (-F.col("l_quantity")).alias("less"), "l_orderkey", "l_linenumber"),
    ).select("book_id", "l_orderkey", "l_linenumber"),
    "SELECT l_partkey AS book_id, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber) = 1",
)
add(
    "m07_touched_stats",
    lambda cat: _streamed(
        cat, "events", "user_id", lambda to: counters.recompute_touched(lambda: cat.bookshelves, userdata.shelf_stats_of, "user_id", to), lambda events: events.where("event_type = 'purchase'").select("user_id")
    ),
    sql("SELECT shelf_stats.* FROM shelf_stats WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')", **STAT_TABLES),
)

# ---- streaming: what a stream over the events has counted when it has drained them


def _drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream, folded into a table of running counts."""
    root = f"{shared_dir(spark)}/views-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    made = BucketedTable(spark, f"{root}/table", ["entity_id"])
    counters.drain(counters.view_counts(stream), counters.fold_counts(made), f"{root}/checkpoint")
    return made.read().select("entity_id", "view_count", F.unix_micros(F.col("last_viewed_at").cast("timestamp")).alias("last_viewed"))


QUERIES["m03_view_counts"] = _drained
ORACLE_SQL["m03_view_counts"] = """
SELECT CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS entity_id, count(*) AS view_count, epoch_us(max(ts)) AS last_viewed FROM events WHERE event_type = 'view' GROUP BY 1"""

from shelfspark.plans import imports, jobs, merges  # noqa: E402

merges.add_after_queries()
jobs.add_after_queries(ORACLE_SQL)
QUERIES |= imports.QUERIES | merges.QUERIES | jobs.QUERIES
ORACLE_SQL |= imports.ORACLE_SQL | merges.ORACLE_SQL | jobs.ORACLE_SQL
