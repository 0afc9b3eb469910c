"""Incremental jobs: view counters, statistics of touched keys, search documents of changed books."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfspark.operators.merge import recovered, replace
from shelfspark.sources.versions import BucketedTable


def view_counts(events: DataFrame) -> DataFrame:
    """Running counts of views by entity, of a stream or a table (event_type, props, ts)."""
    views = events.where("event_type = 'view'")
    key = F.get_json_object("props", "$.k").cast("long").alias("entity_id")
    return views.groupBy(key).agg(F.count("*").alias("view_count"), F.max("ts").alias("last_viewed_at"))


def windowed_views(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Views by entity and window of event time; a window is given once it can get no more events."""
    stamped = events.where("event_type = 'view'").withColumn("ts", F.col("ts").cast("timestamp"))
    key = F.get_json_object("props", "$.k").cast("long").alias("entity_id")
    return stamped.withWatermark("ts", late).groupBy(F.window("ts", every), key).agg(F.count("*").alias("view_count")).select("entity_id", F.col("window.start").alias("start"), "view_count")


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 8) -> DataFrame:
    """The parquet files of a folder as a stream; backpressure by files per trigger."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def drain(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Runs a stream over all that is there and stops; with the same checkpoint the next run goes on from there."""
    query = df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class PlainTable:
    """A folder of files that is written as a whole; a small table that others read by its path."""

    def __init__(self, path: str):
        self.path = path

    def touched(self, rows: DataFrame) -> None:
        """All of it."""

    def read(self, buckets: None = None) -> DataFrame | None:
        spark = SparkSession.active()
        return spark.read.parquet(self.path) if recovered(spark, self.path) else None

    def write(self, rows: DataFrame, touched: None = None) -> None:
        replace(rows, self.path)


def _state(to: str | BucketedTable) -> PlainTable | BucketedTable:
    return PlainTable(to) if isinstance(to, str) else to


def fold_counts(to: str | BucketedTable) -> Callable[[DataFrame, int], None]:
    """A sink that keeps a table equal to the running counts: updated keys replace their rows. Running counts are states,
    not increments, so a batch that is delivered twice changes nothing. Of a table in buckets only those that hold keys of
    the batch are read and written."""
    table = _state(to)

    def sink(batch: DataFrame, batch_id: int) -> None:
        new = batch.persist()
        touched = table.touched(new)
        if touched != []:
            old = table.read(touched)
            table.write(new if old is None else old.join(new, "entity_id", "left_anti").unionByName(new), touched)
        new.unpersist()

    return sink


def fold_best(to: str | BucketedTable, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink that keeps, for each key, the row that comes first by the order, over all batches so far. The first of
    firsts is the first, so neither the cut into batches nor a batch that is delivered twice changes the table."""
    table = _state(to)

    def best(rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("__best")).select(*keys, *[F.col("__best")[c].alias(c) for c in others])

    def sink(batch: DataFrame, batch_id: int) -> None:
        new = best(batch).persist()
        touched = table.touched(new)
        if touched != []:
            old = table.read(touched)
            table.write(new if old is None else best(old.unionByName(new)), touched)
        new.unpersist()

    return sink


def recompute_touched(source: Callable[[], DataFrame], compute: Callable[[DataFrame], DataFrame], key: str, to: str | BucketedTable) -> Callable[[DataFrame, int], None]:
    """A sink that recomputes statistics of the keys in a batch of changes from the whole source, and leaves the rest of
    the table alone: other keys, and of a table in buckets the buckets without keys of the batch."""
    table = _state(to)

    def sink(batch: DataFrame, batch_id: int) -> None:
        keys = batch.select(key).distinct().persist()
        touched = table.touched(keys)
        if touched != []:
            new, old = compute(source().join(keys, key, "left_semi")), table.read(touched)
            table.write(new if old is None else old.join(keys, key, "left_anti").unionByName(new), touched)
        keys.unpersist()

    return sink


def changed_since(table: DataFrame, column: str, last: str | None) -> tuple[DataFrame, str | None]:
    """Rows changed after a watermark, and the next one."""
    rows = table if last is None else table.where(F.col(column) > F.lit(last).cast("timestamp"))
    top = rows.agg(F.max(F.col(column).cast("string"))).first()[0]
    return rows, top or last
