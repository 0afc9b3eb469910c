"""Tables in buckets by key, and their versions.

Rows lie in one of `buckets` folders by a hash of their key. A change writes the buckets that it touches into a new folder
and then a manifest, a small file that names the folders of every bucket; the other buckets' folders are named again as
they are. A manifest comes into place by one rename, readers take the one with the greatest number, so there is a whole
version at every moment, and a writer that is lost leaves nothing but files that no manifest names. One writer at a
time: a second one that would write the same number fails.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
#: Versions whose files stay; readers of older ones have ended.
KEPT = 3


class Files:
    """A folder of whatever file system its path names."""

    def __init__(self, spark: SparkSession, root: str):
        self.root = root.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, name: str = "") -> list[str]:
        try:
            return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name)))
        except Py4JJavaError as e:
            if "FileNotFoundException" in str(e.java_exception):
                return []
            raise

    def text(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """A file that is there whole or not at all; fails if there is one of that name."""
        aside = self._at(f".{name}-{uuid.uuid4().hex}")
        stream = self._fs.create(aside)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self._fs.exists(self._at(name)) or not self._fs.rename(aside, self._at(name)):
            self._fs.delete(aside, False)
            raise OSError(f"{self.root}/{name} is there: another writer was faster")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class BucketedTable:
    """A table at root with the rows of a key in one bucket. `kind` ("a long, b string") or the first rows written give
    its columns. Null keys are keys like others."""

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = BUCKETS, kind: str | None = None):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), keys, buckets
        self.files = Files(spark, self.root)
        self.kind = StructType.fromDDL(kind) if kind else None

    def bucket(self, *keys: Column) -> Column:
        parts = [F.coalesce(k.cast("string"), F.lit("\0")) for k in keys or map(F.col, self.keys)]
        return F.pmod(F.crc32(F.concat_ws("\1", *parts).cast("binary")), F.lit(self.buckets)).cast("int")

    def bucket_of(self, *key: object) -> int:
        """bucket() of texts, whole numbers or None."""
        return zlib.crc32("\1".join("\0" if k is None else str(k) for k in key).encode()) % self.buckets

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of the rows' keys, as many as there are buckets at most."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def manifest(self, version: int | None = None) -> dict:
        """{version, kind, folders: {bucket: [folder, ...]}, done: {writer: last batch}} of the last version or one of
        those kept; version 0 before any."""
        if version is not None:
            return json.loads(self.files.text(f"manifest-{version:09}.json"))
        numbers = [n for n in self.files.names() if n.startswith("manifest-")]
        return json.loads(self.files.text(numbers[-1])) if numbers else self._nothing()

    @staticmethod
    def _nothing() -> dict:
        return {"version": 0, "kind": None, "folders": {}, "done": {}}

    def read(self, buckets: Iterable[int] | None = None, version: int | None = None) -> DataFrame | None:
        """The rows, of some buckets alone if these are given, of the last version unless one is named; None while there
        is no version. What is filtered and selected of it is pushed down to its files."""
        now = self.manifest(version) if version != 0 else self._nothing()
        if not now["version"]:
            return None
        some = now["folders"] if buckets is None else {str(b) for b in buckets} & now["folders"].keys()
        kind = StructType.fromJson(now["kind"])
        paths = [f"{self.root}/{folder}/bucket={b}" for b in sorted(some, key=int) for folder in now["folders"][b]]
        return self.spark.read.schema(kind).parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def write(self, rows: DataFrame, touched: list[int] | None = None, append: bool = False, writer: str | None = None, batch: int | None = None, base: int | None = None) -> bool:
        """A new version: rows are all that the touched buckets hold from now on (all buckets, if none are named), or with
        append come beside what they hold. A batch whose number isn't above the writer's last one changes nothing. It goes
        on from the last version, or from the one named as base: those since are left behind."""
        last = self.manifest()
        now = last if base is None else self.manifest(base) if base else self._nothing()
        if writer is not None and batch <= now["done"].get(writer, -1):
            return False
        folder = f"data-{uuid.uuid4().hex}"
        kind = self.kind or (StructType.fromJson(now["kind"]) if now["kind"] else rows.schema)
        if "bucket" in map(str.lower, kind.names):
            raise ValueError("the column bucket is the table's own")
        placed = rows.select(*[F.col(f"`{c}`").cast(kind[c].dataType).alias(c) for c in kind.names]).withColumn("bucket", self.bucket())
        placed.hint("rebalance", "bucket").sortWithinPartitions("bucket", *self.keys).write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        new = [n.split("=")[1] for n in self.files.names(folder) if "=" in n]
        folders = {b: paths for b, paths in now["folders"].items() if append or touched is not None and int(b) not in touched}
        for b in new:
            folders[b] = [*folders.get(b, []), folder]
        done = now["done"] | ({writer: batch} if writer is not None else {})
        version = last["version"] + 1
        self.files.put(f"manifest-{version:09}.json", json.dumps({"version": version, "kind": kind.jsonValue(), "folders": folders, "done": done}))
        self._forget(version)
        return True

    def _forget(self, version: int) -> None:
        """Deletes what only versions older than the last KEPT name."""
        names = self.files.names()
        manifests = [n for n in names if n.startswith("manifest-")]
        old, held = manifests[:-KEPT], {f for n in manifests[-KEPT:] for paths in json.loads(self.files.text(n))["folders"].values() for f in paths}
        gone = {f for n in old for paths in json.loads(self.files.text(n))["folders"].values() for f in paths} - held
        for name in (*gone, *old):
            self.files.delete(name)
