"""Exact deduplication by composable polynomial fingerprints.

A text is cut into chunks of fixed length. A chunk of bytes c has the hash sum(c[i] * B^(len-1-i)) mod P, in two bases;
the hash of a text a then b is hash(a) * B^len(b) + hash(b), so chunks of a huge document are hashed on their own and
combined. Texts of one fingerprint and length are then compared with one of them, chunk against chunk; a text that
differs (two texts with one fingerprint) goes into another round with those that differ like it, until none is left.
Texts whose fingerprint no other has are hashed where they are read and never moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_IDS, broadcast_if_small, cut, fresh, lower_ascii, numbered, with_row_id, without_rows

CHUNK = 1 << 18
#: A prime of 31 bits and two bases.
PRIME = (1 << 31) - 1
BASES = (1_000_003, 998_244_353 % PRIME)
BLOCK = 2048
#: Rows of a fingerprint that are compared in one piece of work.
LANE = 500


@cache
def powers(base: int, prime: int) -> np.ndarray:
    out = np.ones(BLOCK, np.int64)
    for i in range(BLOCK - 2, -1, -1):
        out[i] = out[i + 1] * base % prime
    return out


def chunk_hash(data: bytes, base: int, prime: int = PRIME) -> int:
    """Hash of one chunk: blocks by a dot product each, then combined by their length."""
    values = np.frombuffer(data, np.uint8).astype(np.int64)
    table, head = powers(base, prime), len(values) % BLOCK
    total = int(values[:head] @ table[BLOCK - head :] % prime) if head else 0
    shift = pow(base, BLOCK, prime)
    for part in values[head:].reshape(-1, BLOCK) @ table % prime if len(values) >= BLOCK else ():
        total = (total * shift + int(part)) % prime
    return total


def hash_batches(prime: int):
    """Rows (row_id, doc_id, sha256, nth, piece) with the piece replaced by its length, hashes and shifts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = [c.as_py() for c in batch.column(4)]
            columns = [*batch.columns[:4], pa.array([len(c) for c in chunks], pa.int64())]
            for base in BASES:
                columns += [pa.array([chunk_hash(c, base, prime) for c in chunks], pa.int64()), pa.array([pow(base, len(c), prime) for c in chunks], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["row_id", "doc_id", "sha256", "nth", "bytes", "h0", "s0", "h1", "s1"])

    return run


def chunks_of(body: Column, chunk: int) -> Column:
    """The chunks of a binary column, in order, with their numbers; an empty text is one empty chunk."""
    last = F.floor(F.greatest(F.octet_length(body) - 1, F.lit(0)) / chunk).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("nth"), F.substring(body, i * chunk + 1, F.lit(chunk)).alias("piece")))


def combine(parts: Column, h: str, shift: str, prime: int) -> Column:
    return F.aggregate(parts, F.lit(0).cast("long"), lambda total, p: (total * p[shift] + p[h]) % prime)


def fingerprints(bodies: DataFrame, chunk: int = CHUNK, prime: int = PRIME) -> DataFrame:
    """(row_id, doc_id, sha256, bytes, h0, h1) of rows (row_id, doc_id, body binary); the digest is taken in passing."""
    digest = F.unhex(F.sha2("body", 256)).alias("sha256")
    cut_up = bodies.select("row_id", "doc_id", digest, F.explode(chunks_of(F.col("body"), chunk)).alias("c")).select("row_id", "doc_id", "sha256", "c.nth", "c.piece")
    hashed = cut_up.mapInArrow(hash_batches(prime), "row_id long, doc_id long, sha256 binary, nth int, bytes long, h0 long, s0 long, h1 long, s1 long")
    parts = hashed.groupBy("row_id", "doc_id").agg(F.min("sha256").alias("sha256"), F.sum("bytes").alias("bytes"), F.array_sort(F.collect_list(F.struct("nth", "h0", "s0", "h1", "s1"))).alias("parts"))
    return parts.select("row_id", "doc_id", "sha256", "bytes", combine(F.col("parts"), "h0", "s0", prime).alias("h0"), combine(F.col("parts"), "h1", "s1", prime).alias("h1"))


def compare(members: DataFrame, bodies: DataFrame, chunk: int) -> DataFrame:
    """(row_id, same) of rows (row_id, model_id, lane): whether each text equals its model's.

    Only texts of these rows and of their models leave the scan. The model's chunks go once to each lane of its group, so
    a group of any size is compared in pieces of LANE rows."""
    texts = bodies.select("row_id", "body")

    def pieces(rows: DataFrame, piece: str, *keep: str) -> DataFrame:
        return rows.select(*keep, F.explode(chunks_of(F.col("body"), chunk)).alias("c")).select(*keep, "c.nth", F.col("c.piece").alias(piece))

    asked = broadcast_if_small(members, SMALL_IDS)
    lanes = broadcast_if_small(members.select(F.col("model_id").alias("row_id"), "lane").distinct(), SMALL_IDS)
    own = pieces(texts.join(asked, "row_id"), "piece", "row_id", "model_id", "lane")
    models = pieces(texts.join(lanes, "row_id"), "model_piece", "row_id", "lane").withColumnRenamed("row_id", "model_id")
    held = own.join(models, ["model_id", "lane", "nth"], "left")
    return held.groupBy("row_id").agg(F.min(F.col("piece").eqNullSafe(F.col("model_piece")).cast("int")).alias("same"))


def equal_texts(docs: DataFrame, chunk: int = CHUNK, prime: int = PRIME, row_id: str | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text, ...): row_id (that of the column named so, or a new one), doc_id,
    sha256, model_id (the row_id that stands for all rows with this text, that of the largest doc_id), keep_id (its
    doc_id), group_size.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Null ids come below all others. Of
    repeated rows that with the largest row_id stands for them. Long texts are hashed and compared by chunks. An empty
    table gives no rows; other columns are not looked at.
    """
    rows = numbered(docs, F.col("doc_id").cast("long").alias("doc_id"), "text", row_id=row_id)
    bodies = rows.select("row_id", "doc_id", F.coalesce(lower_ascii(F.col("text")), F.lit("")).cast("binary").alias("body"))
    key, settled = ["bytes", "h0", "h1"], None
    waiting = cut(fingerprints(bodies, chunk, prime))
    while True:
        rank = F.struct(F.col("doc_id").isNotNull(), "doc_id", "row_id")
        groups = cut(waiting.groupBy(*key).agg(F.count("*").alias("n"), F.max(rank).alias("model")))
        placed = cut(waiting.join(groups, key).select("row_id", *key, "doc_id", "sha256", "n", F.col("model.row_id").alias("model_id"), F.col("model.doc_id").alias("keep_id")))
        lane = F.pmod(F.xxhash64("row_id"), F.ceil(F.col("n") / LANE)).cast("int")
        members = placed.where("row_id <> model_id").select("row_id", "model_id", lane.alias("lane"))
        different = cut(compare(members, bodies, chunk).where("same = 0").select("row_id"))
        if different.isEmpty():
            done = placed.select("row_id", "doc_id", "sha256", "model_id", "keep_id", F.col("n").alias("group_size"))
            return done if settled is None else settled.union(done)
        waiting = cut(placed.join(different, "row_id", "left_semi").select("row_id", *key, "doc_id", "sha256", "model_id"))
        fewer = waiting.groupBy("model_id").agg(F.count("*").alias("gone"))
        agreed = placed.join(different, "row_id", "left_anti").join(fewer, "model_id", "left")
        agreed = cut(agreed.select("row_id", "doc_id", "sha256", "model_id", "keep_id", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("group_size")))
        settled = agreed if settled is None else settled.union(agreed)


def mark_exact_duplicates(docs: DataFrame, chunk: int = CHUNK, prime: int = PRIME) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs; see equal_texts."""
    found = equal_texts(docs, chunk, prime)
    return found.select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("model_id")).alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, chunk: int = CHUNK, prime: int = PRIME) -> DataFrame:
    """The rows of docs (doc_id, text, ...) without those whose text another, kept row has, all columns as they are.

    Null texts are equal to empty ones; of a group the row with the largest doc_id stays, null ids below all others, of
    rows repeated whole one; an empty table stays empty; columns of any name are passed on."""
    name = fresh(docs, "__row")
    rows = with_row_id(docs, name)
    return without_rows(rows, name, equal_texts(rows, chunk, prime, name).where("row_id <> model_id").select("row_id"))
