"""Cutting lineage, and broadcasts of checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.sources.catalogue import shared_dir

#: Rows that are broadcast at most.
SMALL_ROWS = 100_000
#: Rows that a task of a spread table gets, about.
TASK_ROWS = 100_000
#: Rows of which a task makes or parses lines, about.
LINE_ROWS = 10_000


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder; what follows survives the loss of any executor."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df, written out and counted: marked for broadcast with `rows` rows or fewer, else left to a shuffled join."""
    df = cut(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys over as many tasks as its rows, about `rows`, need, so that a task's share doesn't grow with them."""
    return df.repartition(max(1, -(-rows // TASK_ROWS)), *keys)  # a number, which isn't lowered for a table of few bytes


def in_line_tasks(df: DataFrame, *keys: str) -> DataFrame:
    """A table of narrow rows dealt by keys to tasks of about LINE_ROWS, if it has more: a line that is made or parsed of
    a row takes far more than reading it, and files of few bytes hold many rows. The rows are written, as filters on lines
    would else be put before the exchange, with all the work."""
    tasks = -(-df.count() // LINE_ROWS)
    return cut(df.repartition(tasks, *keys)) if tasks > 1 else df
