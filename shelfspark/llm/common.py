"""What the training-data operators share: reading tables, cutting lineage, keeping rows apart."""

from __future__ import annotations

import re

import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the warehouse where it is unset (tests)."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder; what follows survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bits of a row number that hold the place in the file, for a few files and for very many; the rest tells files apart.
PLACE_BITS, MANY_FILES_PLACE_BITS, MANY_FILES = 32, 24, 50_000


def _plain(path: str) -> str:
    return re.sub(r"^file:/+", "file:/", path)


def file_salt(paths: list[str], bits: int) -> int:
    """The first salt with which no two paths have the same `bits` highest hash bits."""
    for salt in range(1000):
        if len({xxhash.xxh64_intdigest(f"{salt}:{p}", 42) >> (64 - bits) for p in paths}) == len(paths):
            return salt
    raise ValueError(f"{len(paths)} files can't be told apart by {bits} bits")


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Adds a number that tells equal rows apart and doesn't depend on how files are split: it is made of the row's file
    and place there, so each job that reads df again gives the same rows the same numbers.

    df is a Parquet read, at most selected and filtered. Rows that come from elsewhere are numbered once and written to
    the shared folder with their numbers."""
    try:
        where = df.metadataColumn("_metadata")
        df.select(where["file_path"], where["row_index"])
    except AnalysisException:
        return cut(df.withColumn(name, F.monotonically_increasing_id()))
    paths = sorted({_plain(p) for p in df.inputFiles()})
    place = PLACE_BITS if len(paths) <= MANY_FILES else MANY_FILES_PLACE_BITS
    salt = file_salt(paths, 63 - place)
    path = F.regexp_replace(where["file_path"], "^file:/+", "file:/")
    number = F.shiftrightunsigned(F.xxhash64(F.concat(F.lit(f"{salt}:"), path)), place + 1)
    at = where["row_index"]
    fits = F.when(at < F.lit(1 << place), at).otherwise(F.raise_error(F.lit(f"a file has more than 2^{place} rows")).cast("long"))
    return df.withColumn(name, F.shiftleft(number, place) + fits)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def numbered(docs: DataFrame, *columns: Column | str, row_id: str | None = None) -> DataFrame:
    """(row_id, *columns) of docs: the numbers are those of the column named row_id, or new ones (see with_row_id)."""
    if row_id:
        return docs.select(F.col(row_id).alias("row_id"), *columns)
    return with_row_id(docs.select(*columns), "row_id").select("row_id", *[F.col(c) if isinstance(c, str) else c for c in columns])


def without_rows(rows: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """The rows whose number (column name) isn't in the one column of gone, without their numbers."""
    out = fresh(rows, "__gone_row")
    gone = broadcast_if_small(gone.toDF(out), SMALL_IDS)
    return rows.join(gone, F.col(name) == F.col(out), "left_anti").drop(name)


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_crc(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts alone: 52 bits of their MD5."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


#: Rows that are broadcast at most, and rows of a few numbers each (24 MB of them, about 100 MB as a hash table).
SMALL_ROWS, SMALL_IDS = 100_000, 1_000_000


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df, written out and counted: marked for broadcast with `rows` rows or fewer, else left to a shuffled join. What is
    written is counted by a task for each core, however many tasks wrote it."""
    df = cut(df)
    few = df.coalesce(df.sparkSession.sparkContext.defaultParallelism)
    return F.broadcast(df) if few.limit(rows + 1).count() <= rows else df


def drawn(df: DataFrame, name: str, share: float) -> DataFrame:
    """The rows of df (doc_id, ...) whose hash is in the given share of all hashes, with their number; repeated rows are
    drawn one by one."""
    hit = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", name), F.lit(1 << 40)) < F.lit(int(min(1.0, share) * (1 << 40)))
    return with_row_id(df, name).where(hit)


def sampled_rows(df: DataFrame, share: float) -> DataFrame:
    return drawn(df, "__drawn", share).drop("__drawn")


def labelled_sample(docs: DataFrame, known: DataFrame, share: float) -> DataFrame:
    """The drawn rows of docs (doc_id, text) that known (doc_id, one row each, ...) has, with known's other columns.
    Ids alone are shuffled; the numbers of the rows found then go to where the texts are read."""
    marks = broadcast_if_small(drawn(docs.select("doc_id"), "__drawn", share).join(known, "doc_id").drop("doc_id"))
    return with_row_id(docs.select("doc_id", "text"), "__drawn").join(marks, "__drawn").drop("__drawn")
