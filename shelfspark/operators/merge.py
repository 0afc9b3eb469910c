"""Keyed merges: what an upsert, a partial update or a delete leaves of a table.

Tables are immutable; a merge gives the new table, and replace() writes it aside and swaps folders. Of several changes
to a key the last by sequence counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def last_by(changes: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """The last change of each key. Of several at one place in the sequence the greatest counts, by the other columns in
    their order, so the result never depends on how rows arrive."""
    kinds = dict(changes.dtypes)
    ties = [F.desc_nulls_last(F.to_json(c) if kinds[c].startswith("map") else F.col(c)) for c in changes.columns if c not in keys and c != sequence]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(sequence), *ties))
    return changes.withColumn("__nth", nth).where("__nth = 1").drop("__nth")


#: How a column of a merged row comes about from the old and the new value.
POLICIES = {
    "overwrite": lambda old, new: new,
    "fill": lambda old, new: F.coalesce(old, new),
    "supplied": lambda old, new: F.coalesce(new, old),
    "keep": lambda old, new: old,
    "add": lambda old, new: F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0)),
    "union": lambda old, new: F.array_distinct(F.concat(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>")))),
    "map": lambda old, new: F.map_from_entries(
        F.concat(F.map_entries(F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~F.coalesce(F.map_contains_key(new, k), F.lit(False)))), F.map_entries(F.coalesce(new, F.create_map().cast("map<string,string>"))))
    ),
}


def merged(table: DataFrame, changes: DataFrame, keys: list[str], policies: dict[str, str], default: str = "overwrite", insert: bool = True) -> DataFrame:
    """table with changes applied by key, one row for each key on either side; columns that changes lack keep their
    value, or are null in new rows. Without insert only rows that exist are updated."""
    new = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in changes.columns if c not in keys], F.lit(True).alias("__changed"))
    joined = table.withColumn("__had", F.lit(True)).join(new, keys, "full" if insert else "left")

    def value(name: str) -> Column:
        if name in keys or name not in changes.columns:
            return F.col(name)
        by_policy = POLICIES[policies.get(name, default)](F.col(name), F.col(f"__{name}"))
        return F.when(F.col("__changed") & F.col("__had"), by_policy).when(F.col("__changed"), F.col(f"__{name}")).otherwise(F.col(name)).alias(name)

    return joined.select(*[value(c) for c in table.columns])


def upsert_shelves(shelves: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (user_id, book_id, status, updated_at): a new status and time; favourites stay as they are."""
    last = last_by(changes, ["user_id", "book_id"], "updated_at")
    return merged(shelves, last, ["user_id", "book_id"], {}).withColumn("is_favorite", F.coalesce("is_favorite", F.lit(False)))


def toggle_favorites(shelves: DataFrame, toggles: DataFrame) -> DataFrame:
    """toggles (user_id, book_id, updated_at): flips the flag as often as asked; a book that isn't shelved is put on the
    wanted shelf."""
    counted = toggles.groupBy("user_id", "book_id").agg((F.count("*") % 2 == 1).alias("flip"), F.max("updated_at").alias("at"))
    joined = shelves.join(counted, ["user_id", "book_id"], "full")
    flag = F.coalesce("is_favorite", F.lit(False)) != F.coalesce("flip", F.lit(False))
    return joined.select("user_id", "book_id", F.coalesce("status", F.lit("want_to_read")).alias("status"), flag.alias("is_favorite"), F.coalesce("updated_at", "at").alias("updated_at"))


def upsert_ratings(ratings: DataFrame, changes: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """A new overall rating; of the dimensions only those that a change supplies."""
    return merged(ratings, last_by(changes, ["user_id", "book_id"], "created_at"), ["user_id", "book_id"], {d: "supplied" for d in dimensions})


def insert_comments(comments: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table with comments by users who hadn't any on the book, new comments that are refused)."""
    first = last_by(new.withColumn("__order", -F.col("comment_id")), ["user_id", "book_id"], "__order").drop("__order")
    taken = first.join(comments, ["user_id", "book_id"], "left_anti")
    refused = new.join(taken.select("comment_id"), "comment_id", "left_anti")
    return comments.unionByName(taken.select(*comments.columns)), refused


def deleted(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, keys.columns, "left_anti")


def edit_comments(comments: DataFrame, changes: DataFrame) -> DataFrame:
    """comments (comment_id, user_id, body, is_spoiler, ...) after changes (comment_id, user_id, kind, body, is_spoiler,
    updated_at): the last update sets text and flag, a delete takes the row out for good. Only its writer changes a
    comment; changes to unknown comments are ignored."""
    keys = ["comment_id", "user_id"]
    last = last_by(changes.where("kind = 'update'"), keys, "updated_at").select(*keys, "body", "is_spoiler")
    left = deleted(comments, changes.where("kind = 'delete'").select(*keys).distinct())
    return merged(left, last, keys, {}, insert=False)


def partial_update(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """table with the values that changes supply; null means no change, unknown keys are ignored."""
    return merged(table, changes, keys, {}, default="supplied", insert=False)


def delete_authors(tables: dict[str, DataFrame], author_ids: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of these authors: they themselves and their links; their books stay."""
    return {name: deleted(df, author_ids.select("author_id")) if "author_id" in df.columns else df for name, df in tables.items()}


def insert_links(links: DataFrame, new: DataFrame) -> DataFrame:
    return links.unionByName(new.select(*links.columns)).dropDuplicates()


def append_missing(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return table.unionByName(last_by(new, keys, keys[0]).join(table, keys, "left_anti").select(*table.columns))


def delete_books(tables: dict[str, DataFrame], book_ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables with a book_id without the rows of these books, and how many rows of each went."""
    left, counts = {}, []
    for name, df in tables.items():
        left[name] = deleted(df, book_ids.select("book_id"))
        counts.append(df.join(book_ids, "book_id", "left_semi").agg(F.lit(name).alias("table"), F.count("*").alias("deleted")))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return left, out


def unlink_series(books: DataFrame, series: DataFrame) -> DataFrame:
    """Books of which those in deleted series (series_id) have no series and no place in one."""
    gone = series.select("series_id").distinct().withColumn("__gone", F.lit(True))
    joined = books.join(gone, "series_id", "left")
    return joined.select(*[F.when(F.col("__gone"), None).otherwise(F.col(c)).alias(c) if c in ("series_id", "series_position") else F.col(c) for c in books.columns])


def replace(df: DataFrame, path: str) -> None:
    """Writes df beside the folder at path and swaps them; readers of the old files finish undisturbed."""
    spark = df.sparkSession
    jvm = spark._jvm
    aside, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(aside)
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    had = files.exists(at(path))
    if had and not files.rename(at(path), at(old)):
        raise OSError(f"{path} couldn't be moved away")
    if not files.rename(at(aside), at(path)):
        if had:
            files.rename(at(old), at(path))
        raise OSError(f"{aside} couldn't be renamed to {path}")
    files.delete(at(old), True)


def recovered(spark: SparkSession, path: str) -> bool:
    """Whether the folder at path is there. If a writer ended between the two moves of replace(), the last table is moved
    back first; call it before reading what replace() writes."""
    jvm = spark._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(at(path)):
        return True
    left = sorted((s.getModificationTime(), s.getPath().toString()) for s in files.globStatus(at(f"{path}.old-*")) or [])
    return bool(left) and files.rename(at(left[-1][1]), at(path))
