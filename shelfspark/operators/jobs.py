"""Imports in batches: each committed once and whole, or set aside with its error.

Records have a source and a number `seq` that grows within it; a batch is what one source has in one stretch of numbers,
`size` records at most. Of each of the six tables a batch reads and writes only the buckets that hold its keys. All that
a batch changes is worked out and written before the job's manifest names the new versions, so a batch that fails at any
point leaves the tables as they were and goes to the dead letters, and the next batch goes on from them. A run takes up
what the manifest doesn't name yet. Batches in a row are worked out together, with the result that one after the other
would have, as long as none of them fails.
"""

from __future__ import annotations

import json
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.batch import AT, import_batch
from shelfspark.operators.common import cut
from shelfspark.sources.versions import BucketedTable, Files

#: Keys of the tables; links lie with their books.
KEYS = {"genres": ["slug"], "series": ["slug"], "authors": ["slug"], "books": ["language", "slug"], "book_genres": ["language", "slug"], "book_authors": ["language", "slug"]}
SIZE = 100_000
DEAD = "source string, batch long, records long, error string"


class ImportJob:
    """Tables at root, and what has been imported into them. `kinds` gives the columns of each table."""

    def __init__(self, spark: SparkSession, root: str, kinds: dict[str, str], size: int = SIZE, buckets: int = 64):
        self.spark, self.root, self.size = spark, root.rstrip("/"), size
        self.tables = {name: BucketedTable(spark, f"{self.root}/{name}", keys, buckets, kinds[name]) for name, keys in KEYS.items()}
        self.files = Files(spark, self.root)

    def manifest(self) -> dict:
        """{at, versions: {table: version}, done: {source: [batch, ...]}, dead: [[source, batch, records, error], ...]}."""
        names = [n for n in self.files.names() if n.startswith("job-")]
        return json.loads(self.files.text(names[-1])) if names else {"at": 0, "versions": dict.fromkeys(KEYS, 0), "done": {}, "dead": []}

    def _commit(self, now: dict) -> None:
        self.files.put(f"job-{now['at'] + 1:09}.json", json.dumps(now | {"at": now["at"] + 1}))

    def table(self, name: str) -> DataFrame:
        table = self.tables[name]
        rows = table.read(version=self.manifest()["versions"][name])
        return self.spark.createDataFrame([], table.kind) if rows is None else rows

    def dead_letters(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(d) for d in self.manifest()["dead"]], DEAD)

    def fill(self, tables: dict[str, DataFrame]) -> None:
        """What the tables hold before the first batch."""
        now = self.manifest()
        for name, rows in tables.items():
            self.tables[name].write(rows, base=0)
            now["versions"][name] = self.tables[name].manifest()["version"]
        self._commit(now)

    def _apply(self, records: DataFrame, now: dict) -> dict[str, int]:
        """Versions of the tables with a batch. Its keys, and with them the buckets, are those of its tables alone."""
        empty = {name: self.spark.createDataFrame([], t.kind) for name, t in self.tables.items()}
        versions = {}
        records = cut(records)
        keys = {name: rows.select(*KEYS[name]) for name, rows in import_batch(empty, records).items()}
        touched = {name: self.tables[name].touched(rows) for name, rows in keys.items()}
        old = {name: self.tables[name].read(touched[name], now["versions"][name]) for name in KEYS}
        for name, rows in import_batch({n: empty[n] if df is None else df for n, df in old.items()}, records).items():
            if touched[name]:
                self.tables[name].write(rows, touched[name], base=now["versions"][name])
                versions[name] = self.tables[name].manifest()["version"]
        return now["versions"] | versions

    def run(self, records: DataFrame) -> list[tuple[str, int]]:
        """Imports all batches of records (source, seq, ...) that aren't done, in order, and names them. A batch that was
        set aside is tried again by retry() alone."""
        placed = records.withColumn("batch", F.floor(F.col("seq") / self.size))
        found = [(r["source"], r["batch"], r["n"]) for r in placed.groupBy("source", "batch").agg(F.count("*").alias("n")).orderBy("source", "batch").collect()]  # a row for each batch
        done = self.manifest()["done"]
        taken = [(source, number, n) for source, number, n in found if number not in done.get(source, [])]
        if taken:
            self._take(placed, taken)
        return [(source, number) for source, number, _ in taken]

    def _take(self, placed: DataFrame, some: list[tuple[str, int, int]]) -> None:
        """Imports batches (source, batch, records) together, as one after the other would be; if that fails, each half by
        itself, until the batch that fails is alone and is set aside. So a run takes as many imports as the logarithm of
        its batches for each that fails."""
        now = self.manifest()
        by_source: dict[str, list[int]] = {}
        for source, number, _ in some:
            by_source.setdefault(source, []).append(number)
        wanted = reduce(or_, [(F.col("source") == source) & F.col("batch").isin(numbers) for source, numbers in by_source.items()])
        try:
            now["versions"] = self._apply(placed.where(wanted).withColumn(AT, F.struct("source", "batch")).drop("source", "batch"), now)
        except Exception as e:  # isolation is the feature
            if len(some) > 1:
                self._take(placed, some[: len(some) // 2])
                self._take(placed, some[len(some) // 2 :])
                return
            now["dead"].append([*some[0], _cause(e)])
        for source, number, _ in some:
            now["done"].setdefault(source, []).append(number)
        self._commit(now)

    def retry(self, records: DataFrame) -> list[tuple[str, int]]:
        """Takes the batches that were set aside out of the dead letters, and runs."""
        now = self.manifest()
        for source, number, *_ in now["dead"]:
            now["done"][source].remove(number)
        self._commit(now | {"dead": []})
        return self.run(records)


def _cause(error: Exception) -> str:
    """What a task has said, in one line."""
    text = str(error)
    said = [line.strip() for line in text.splitlines() if "[" in line and "]" in line]
    return (said or text.splitlines() or [type(error).__name__])[0][:300]
