"""Token counts as delta-maintained rollups.

Totals of documents and tokens by source, language and tokenizer version are never recomputed from the corpus. Changes
come in batches: an insert adds a document's count, a delete takes it away, a revision takes the old count away and adds
the new one. A batch is summed by key, partly before the shuffle, and committed as one folder named by the batch; a
batch whose folder exists has been counted, so committing it again does nothing. Totals are the sum over the folders.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import utf8_size, word_count
from .tokens import ByteBpe

KEYS = ("source", "lang", "tokenizer")
DAY = 86_400
CHANGES = "kind string, source string, lang string, tokenizer string, tokens long, old_tokens long"
DELTAS = "source string, lang string, tokenizer string, documents long, tokens long"
#: Tokenizer versions that SQL functions count: words parted by ASCII white space, and single bytes.
COUNTERS = {"words-1": word_count, "bytes-1": utf8_size}


def counted(docs: DataFrame, counters: dict = COUNTERS) -> DataFrame:
    """(doc_id, source, lang, tokenizer, tokens) of each row of docs (doc_id, source, lang, text, ...) and tokenizer version.

    Null and empty texts have no tokens, long texts are counted whole; null ids, sources and languages are values like
    others; repeated rows count each; an empty table gives no rows; other columns, whatever their names, are not looked at."""
    docs = docs.select("doc_id", "source", "lang", "text")
    each = F.array(*[F.struct(F.lit(name).alias("tokenizer"), count(F.col("text")).alias("tokens")) for name, count in counters.items()])
    return docs.select("doc_id", "source", "lang", F.explode(each).alias("t")).select("doc_id", "source", "lang", "t.tokenizer", "t.tokens")


BPE = "byte_bpe_50k"


def bpe_batches(batches: Iterator[pa.RecordBatch], texts: int, vocabulary: str | None, ranks: str | None) -> Iterator[pa.RecordBatch]:
    """Replaces the last `texts` columns, texts or null, by their numbers of tokens. Equal texts of a row are counted once."""
    bpe = ByteBpe(vocabulary, ranks)
    for batch in batches:
        kept, names = batch.columns[:-texts], batch.schema.names
        sizes = []
        for row in zip(*(c.to_pylist() for c in batch.columns[-texts:])):
            known = {t: len(bpe.ids(t or "")) for t in set(row)}
            sizes.append([known[t] for t in row])
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array([r[i] for r in sizes], pa.int64()) for i in range(texts))], names=names)


def bpe_counted(docs: DataFrame, version: str = BPE, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """counted() for a version that takes a vocabulary: tokens of the public byte-level BPE. Null, empty and very long
    texts, null ids, repeated rows and other columns as there."""
    rows = docs.select("doc_id", "source", "lang", F.lit(version).alias("tokenizer"), F.col("text").alias("tokens"))
    kind = ", ".join(f"{c} {t}" for c, t in rows.dtypes[:-1])
    return rows.mapInArrow(lambda batches: bpe_batches(batches, 1, vocabulary, ranks), f"{kind}, tokens long")


def counted_twice(docs: DataFrame, revised: Column, counters: dict = COUNTERS, version: str = BPE, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """(doc_id, source, lang, tokenizer, old_tokens, tokens) of each row of docs and tokenizer version, those of counters
    and of a vocabulary: tokens of its text and of its revised text, in one pass over docs. Edge cases are those of counted()."""
    native = [c(t).alias(f"{when}_{i}") for i, c in enumerate(counters.values()) for when, t in (("old", F.col("text")), ("new", F.col("revised")))]
    rows = docs.select("doc_id", "source", "lang", "text", revised.alias("revised")).select("doc_id", "source", "lang", *native, F.col("text").alias("old"), F.col("revised").alias("new"))
    kind = ", ".join(f"{c} {t}" for c, t in rows.dtypes[:-2])
    found = rows.mapInArrow(lambda batches: bpe_batches(batches, 2, vocabulary, ranks), f"{kind}, old long, new long")
    names = [*((name, f"old_{i}", f"new_{i}") for i, name in enumerate(counters)), (version, "old", "new")]
    each = F.array(*[F.struct(F.lit(n).alias("tokenizer"), F.col(a).alias("old_tokens"), F.col(b).alias("tokens")) for n, a, b in names])
    return found.select("doc_id", "source", "lang", F.explode(each).alias("t")).select("doc_id", "source", "lang", "t.*")


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums by key of changes (CHANGES; more columns may follow).

    kind is insert (+tokens), delete (-tokens) or revise (tokens - old_tokens, same number of documents); a revision that
    moves a document between keys is a delete and an insert. Null counts are 0, null keys are keys of their own, repeated
    rows count each time, unknown kinds fail.
    """
    new, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    kinds = {"insert": (F.lit(1), new), "delete": (F.lit(-1), -new), "revise": (F.lit(0), new - old)}
    fail = F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce("kind", F.lit("null")))).cast("long")
    pick = lambda i: F.coalesce(*[F.when(F.col("kind") == kind, x[i].cast("long")) for kind, x in kinds.items()], fail)
    return changes.groupBy(*KEYS).agg(F.sum(pick(0)).alias("documents"), F.sum(pick(1)).alias("tokens"))


class TokenRollup:
    """Totals kept in a folder that all of the cluster shares."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(at)

    def _files(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folder(self, batch: str) -> str:
        if not batch or not all(c.isalnum() or c in "-_" for c in batch):
            raise ValueError(f"a batch is named by letters, digits, - and _: {batch!r}")
        return f"{self.root}/batches/batch={batch}"

    def committed(self, batch: str) -> bool:
        return self._files().exists(self._path(self._folder(batch)))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Counts a batch, unless it has been counted before; says whether it did. Its deltas are written aside and
        then renamed in one step that fails if another writer was first."""
        if self.committed(batch):
            return False
        aside = f"{self.root}/aside/{uuid.uuid4().hex}"
        deltas(changes).write.parquet(aside)
        files, target = self._files(), self._path(self._folder(batch))
        files.mkdirs(target.getParent())
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else files.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(aside), target, options)
        except Exception:
            if not self.committed(batch):
                raise
            files.delete(self._path(aside), True)
            return False
        return True

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._files().listStatus(at)) if self._files().exists(at) else []

    def _state(self) -> tuple[str | None, set[str]]:
        """The newest sum of batches, and the batches that it holds."""
        sums = [n for n in self._names("sums") if n.startswith("sum=")]
        if not sums:
            return None, set()
        at = f"{self.root}/sums/{sums[-1]}"
        return at, {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{at}/batches").collect()}  # a row for each batch, no data

    def compact(self) -> None:
        """Sums up what is committed in one folder, so that totals don't read every batch for ever. It comes with the names
        of its batches and counts only when it is whole; the batches' folders stay, so that none is counted twice. One
        writer compacts at a time. What writers left aside more than a day ago is removed."""
        at, held = self._state()
        names = [n.removeprefix("batch=") for n in self._names("batches")]
        number = int(at.rpartition("=")[2]) + 1 if at else 0
        aside = f"{self.root}/aside/{uuid.uuid4().hex}"
        self._summed(at, held, names).write.parquet(f"{aside}/totals")
        self.spark.createDataFrame([(n,) for n in names], "batch string").coalesce(1).write.parquet(f"{aside}/batches")
        files = self._files()
        files.mkdirs(self._path(f"{self.root}/sums"))
        if not files.rename(self._path(aside), self._path(f"{self.root}/sums/sum={number:09d}")):
            raise OSError(f"{aside} couldn't be renamed")
        for left in files.listStatus(self._path(f"{self.root}/aside")) if files.exists(self._path(f"{self.root}/aside")) else ():
            if left.getModificationTime() < (time.time() - DAY) * 1000:
                files.delete(left.getPath(), True)

    def _summed(self, at: str | None, held: set[str], names: list[str]) -> DataFrame:
        paths = [f"{self.root}/batches/batch={n}" for n in names if n not in held] + ([f"{at}/totals"] if at else [])
        if not paths:
            return self.spark.createDataFrame([], DELTAS)
        parts = self.spark.read.schema(DELTAS).option("recursiveFileLookup", "true").parquet(*paths)
        return parts.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, documents, tokens over all committed batches; keys whose documents are all gone have
        no row. Renames make a batch appear whole where the store renames folders in one step; an object store that
        doesn't needs a committer of its own."""
        if not self._names("batches"):
            return self.spark.createDataFrame([], DELTAS)
        return self._present(self._summed(*self._state(), [n.removeprefix("batch=") for n in self._names("batches")]))

    def _present(self, sums: DataFrame) -> DataFrame:
        return sums.where((F.col("documents") != 0) | (F.col("tokens") != 0))
