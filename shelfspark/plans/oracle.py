"""The catalogue's tables in SQL, as common table expressions over the test tables, for checks by another engine."""

from __future__ import annotations

from shelfspark.functions.expressions import DIMENSIONS

_DIMS = ",\n    ".join(
    f"{'CASE WHEN book_id % 4 <> 0 THEN ' if d == 'humor' else ''}least(greatest(overall_rating + ((user_id + book_id + {i}) % 3 - 1) * 0.5::DOUBLE, 0.5::DOUBLE), 5.0::DOUBLE){' END' if d == 'humor' else ''} AS {d}"
    for i, d in enumerate(DIMENSIONS)
)

TABLES = {
    "bookshelves": """
  SELECT o_custkey AS user_id, l_partkey AS book_id,
    CASE WHEN o_orderstatus = 'F' THEN 'read' WHEN o_orderstatus = 'O' THEN 'reading' WHEN l_returnflag = 'R' THEN 'abandoned' ELSE 'want_to_read' END AS status,
    l_quantity >= 46 AS is_favorite, o_orderdate AS updated_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  QUALIFY row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY o_orderdate DESC, l_orderkey DESC, l_linenumber DESC, o_orderstatus DESC, l_returnflag DESC, l_quantity DESC) = 1""",
    "ratings": f"""
  SELECT user_id, book_id, overall_rating,
    {_DIMS},
    updated_at AS created_at
  FROM (SELECT *, least(greatest(round((0.5::DOUBLE + 4.5::DOUBLE * ((book_id * 37) % 100) / 99.0::DOUBLE + ((user_id * 7 + book_id * 3) % 5 - 2) * 0.5::DOUBLE) * 2) / 2, 0.5::DOUBLE), 5.0::DOUBLE) AS overall_rating
    FROM bookshelves WHERE status IN ('read', 'reading') AND (user_id + book_id) % 2 = 0 AND book_id % 9 <> 0)""",
    "view_counts": """
  SELECT CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS entity_id, count(*) AS view_count FROM events WHERE event_type = 'view' GROUP BY 1""",
    "books": """
  SELECT p_partkey AS book_id, p_name AS title, replace(p_name, ' ', '-') || '-' || p_partkey AS slug,
    CASE WHEN p_partkey % 7 = 0 THEN 'de' ELSE 'en' END AS language,
    CASE WHEN p_partkey % 10 <> 0 THEN 'cover/' || p_partkey END AS primary_cover_url,
    CASE WHEN p_partkey % 11 <> 0 THEN p_size * 20 END AS number_of_pages,
    1900 + p_partkey % 125 AS original_publication_year,
    CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS series_id,
    CASE WHEN p_partkey % 3 = 0 AND p_partkey % 13 <> 0 THEN CAST(p_size AS DOUBLE) END AS series_position,
    CASE WHEN p_partkey % 5 <> 0 THEN 'isbn' || p_partkey END AS isbn,
    CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS publisher,
    CASE WHEN p_partkey % 6 <> 0 THEN 'About ' || p_name END AS description,
    created_at, coalesce(rating_count, 0) AS rating_count,
    CAST((halves * 100 + rating_count) // (rating_count * 2) AS DOUBLE) / 100 AS avg_rating,
    CASE WHEN p_partkey % 18 <> 0 THEN coalesce(c, 0) * (1 + p_partkey % 40) ELSE 0 END AS ol_rating_count,
    CASE WHEN p_partkey % 18 <> 0 THEN round(0.5::DOUBLE + 4.5::DOUBLE * ((p_partkey * 37) % 100) / 99.0::DOUBLE, 2) END AS ol_avg_rating,
    coalesce(n, 0) * (1 + p_partkey % 40) AS ol_want_to_read_count,
    coalesce(a, 0) * (1 + p_partkey % 40) AS ol_currently_reading_count,
    coalesce(r, 0) * (1 + p_partkey % 40) AS ol_already_read_count,
    coalesce(view_count, 0) AS view_count
  FROM part
  LEFT JOIN (SELECT l_partkey, count(*) FILTER (WHERE l_returnflag = 'R') AS r, count(*) FILTER (WHERE l_returnflag = 'N') AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS a,
      count(*) AS c, min(o_orderdate) AS created_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) ON l_partkey = p_partkey
  LEFT JOIN (SELECT book_id AS rated_book, count(*) AS rating_count, CAST(sum(overall_rating * 2) AS BIGINT) AS halves FROM ratings GROUP BY 1) ON rated_book = p_partkey
  LEFT JOIN view_counts ON entity_id = p_partkey""",
    "authors": """
  SELECT s_suppkey AS author_id, s_name AS name, 'author-' || s_suppkey AS slug, CASE WHEN s_suppkey % 4 <> 0 THEN 'photo/' || s_suppkey END AS photo_url, coalesce(view_count, 0) AS view_count
  FROM supplier LEFT JOIN view_counts ON entity_id = s_suppkey""",
    "book_authors": """
  SELECT DISTINCT l_partkey AS book_id, l_suppkey AS author_id FROM lineitem WHERE l_linenumber = 1 AND l_quantity >= 46""",
    "book_genres": """
  SELECT DISTINCT p_partkey AS book_id, lower(replace(unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), p_type, 'size' || (p_size // 10)]), ' ', '-')) AS genre_id FROM part""",
    "genres": """
  SELECT DISTINCT genre_id, genre_id AS slug FROM book_genres""",
    "users": """
  SELECT c_custkey AS user_id, 'reader' || c_custkey AS username FROM customer""",
    "comments": """
  SELECT CAST(conv_id AS BIGINT) * 100 + turn AS comment_id, CAST(conv_id AS BIGINT) AS user_id, (CAST(conv_id AS BIGINT) * 8 + turn) % (SELECT max(p_partkey) FROM part) + 1 AS book_id,
    text AS body, turn % 3 = 0 AS is_spoiler, to_timestamp(1700000000 + CAST(conv_id AS BIGINT) * 3600 + turn) AS created_at
  FROM conversations WHERE role = 'user'""",
    "app_readers": """
  SELECT book_id, count(*) AS app_readers FROM bookshelves WHERE status IN ('want_to_read', 'reading', 'read') GROUP BY 1""",
    "names": """
  SELECT book_id, string_agg(DISTINCT name, ', ' ORDER BY name) AS author_names, string_agg(DISTINCT slug, ', ' ORDER BY slug) AS author_slugs FROM book_authors JOIN authors USING (author_id) GROUP BY 1""",
    "rated": """
  SELECT *, coalesce(rating_count, 0) + coalesce(ol_rating_count, 0) AS total_ratings, coalesce(avg_rating, 0) * coalesce(rating_count, 0) + coalesce(ol_avg_rating, 0) * coalesce(ol_rating_count, 0) AS points,
    ol_want_to_read_count + ol_currently_reading_count + ol_already_read_count AS library_readers,
    primary_cover_url IS NOT NULL AND language = 'en' AS listable,
    CASE WHEN coalesce(rating_count, 0) + coalesce(ol_rating_count, 0) > 0 THEN (coalesce(avg_rating, 0) * coalesce(rating_count, 0) + coalesce(ol_avg_rating, 0) * coalesce(ol_rating_count, 0)) / CAST(coalesce(rating_count, 0) + coalesce(ol_rating_count, 0) AS DOUBLE) END AS combined
  FROM books""",
}


def sql(query: str, **more: str) -> str:
    """query with the catalogue's tables, and further named ones, before it."""
    named = TABLES | more
    return "WITH " + ",\n".join(f"{name} AS ({body})" for name, body in named.items()) + "\n" + query.strip()
