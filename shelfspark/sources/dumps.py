"""Dump files: lines of tab-separated fields, one of them JSON; ratings and reading-log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspark.operators.common import broadcast_if_small

AUTHOR = "key string, name string, bio string, birth_date string, death_date string, photos array<bigint>, alternate_names array<string>, remote_ids map<string,string>, wikipedia string"
WORK = "key string, title string, description string, subjects array<string>, covers array<bigint>, first_publish_date string, authors array<struct<author:struct<key:string>>>"
EDITION = (
    "key string, title string, works array<struct<key:string>>, languages array<struct<key:string>>, isbn_10 array<string>, isbn_13 array<string>, number_of_pages int, publishers array<string>, covers array<bigint>, "
    "description string, physical_format string, series array<string>, publish_date string"
)
SHELVES = {"Want to Read": "want", "Currently Reading": "currently", "Already Read": "already"}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines of files or folders, gzip or plain."""
    return spark.read.text(path)


def kind_lines(text: DataFrame, kind: str, share: float | None = None, seed: int = 0) -> DataFrame:
    """Rows (value, ...) of five fields, the first the kind, with the last as `raw`; of a share of them, if one is given,
    drawn by a hash of the line."""
    fields = text.withColumn("f", F.split("value", "\t", 5)).where((F.size("f") == 5) & (F.get("f", 0) == kind))
    if share is not None:
        digest = F.md5(F.concat(F.lit(f"{seed}:"), "value").cast("binary"))
        fields = fields.where(F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52) < share)
    return fields.withColumn("raw", F.get("f", 4)).drop("f")


def parsed(raw: DataFrame, schema: str) -> DataFrame:
    """JSON records of rows (raw); damaged ones are left out."""
    return raw.select(F.from_json("raw", schema, {"mode": "PERMISSIVE"}).alias("r")).where("r is not null and r.key is not null").select("r.*")


def records(text: DataFrame, kind: str, schema: str) -> DataFrame:
    """JSON records of one kind from rows (value): five fields, the first the kind, the last JSON. Lines of fewer fields
    or of damaged JSON are left out."""
    return parsed(kind_lines(text, kind), schema)


def records_after(spark: SparkSession, path: str, kind: str, schema: str, skip: int = 0, share: float | None = None, seed: int = 0) -> DataFrame:
    """records() of the files at path behind the first `skip` lines of the kind (damaged JSON counts), in the order of
    file names and of lines; share and seed draw lines before they are counted.

    Lines aren't sorted. Each split of a file counts its own; a split's offset is the sum of the counts before it, over
    a table of splits; a line's number is that and its place in its split, as Spark reads a split in one task."""
    meta, at = F.col("_metadata"), ["file", "start"]
    placed = lines(spark, path).select("value", meta["file_path"].alias("file"), meta["file_block_start"].alias("start"))
    found = kind_lines(placed, kind, share, seed).withColumn("place", F.monotonically_increasing_id())
    splits = found.groupBy(*at).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    upto = Window.orderBy(*at).rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each split
    offsets = broadcast_if_small(splits.withColumn("offset", F.sum("n").over(upto) - F.col("n")))
    numbered = found.join(offsets, at).withColumn("number", F.col("offset") + F.col("place") - F.col("first"))
    return parsed(numbered.where(F.col("number") >= skip), schema)


def text_value(raw: str) -> Column:
    """A field that is a text, or an object with the text as its value."""
    return F.coalesce(F.get_json_object(F.col(raw), "$.value"), F.col(raw))


def short_key(column: str) -> Column:
    return F.regexp_replace(column, r"^/(works|books|authors)/", "")


def ratings(text: DataFrame) -> DataFrame:
    """(work, rating) of lines work, anything, rating, ...; ratings that aren't whole numbers from 1 to 5 are left out."""
    f = text.select(F.split("value", "\t").alias("f")).where(F.size("f") >= 3)
    return f.select(F.regexp_replace(F.get("f", 0), r"^/(works|books)/", "").alias("work"), F.get("f", 2).try_cast("int").alias("rating")).where("rating between 1 and 5 and work <> ''")


def reading_log(text: DataFrame) -> DataFrame:
    """(work, shelf) of lines work, anything, shelf, ...; unknown shelves are left out."""
    f = text.select(F.split("value", "\t").alias("f")).where(F.size("f") >= 3)
    shelf = F.coalesce(*[F.when(F.trim(F.get("f", 2)) == name, F.lit(short)) for name, short in SHELVES.items()])
    return f.select(F.regexp_replace(F.get("f", 0), r"^/(works|books)/", "").alias("work"), shelf.alias("shelf")).where("shelf is not null")
