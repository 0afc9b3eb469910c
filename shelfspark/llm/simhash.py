"""SimHash near-duplicates, found through Golay-code fuzzy hashing.

A fingerprint has 64 bits, cut into segments of 22, 21 and 21 bits. Each segment, filled up with zeros to 23 bits, is
decoded with the perfect binary Golay code (23, 12): every 23-bit word lies within 3 bits of exactly one of 4096 code
words. A segment's keys are the indices of the words that it and its neighbours at one bit decode to, six at most. Two
segments at two bits or fewer have a word between them, a neighbour of both, and so share a key; of two at one bit, the
one's own index is among the other's keys.

Pigeonhole: if fingerprints differ in 4 bits or fewer, some two segments differ in 2 or fewer together. Either both
differ in at most one bit, then (own index of one segment, any key of the other) meets its counterpart; or one is the
same and both others differ in two, then (segment itself, any key of the next) does. So all links are found by
equality of keys of 24 bits and more, and verified on the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, fresh, numbered, with_row_id, without_rows
from .components import components

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Members of a key that are compared in one piece; a larger key is dealt out in pairs of pieces.
PIECE = 16_384
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fixed value: a generator polynomial of the (23, 12) code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles of a text in UTF-8; A-Z count as a-z, words are parted by ASCII white space."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, 1 << 16):
        stop = min(n, at + (1 << 16))
        hashes = np.array([digest(joined[b:e], SEED) for b, e in zip(starts[at:stop], ends[at + shingle - 1 : stop + shingle - 1])], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, a text in UTF-8 or null, by its fingerprint as a signed long."""
    for batch in batches:
        prints = np.array([fingerprint(t.as_py() or b"") for t in batch.column(batch.num_columns - 1)], np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], names=[*batch.schema.names[:-1], "print"])


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """(syndrome of each word of 23 bits by byte, error pattern of each syndrome)."""
    single = []
    for bit in range(23):
        word = 1 << bit
        for high in range(22, 10, -1):
            if word >> high & 1:
                word ^= GENERATOR << (high - 11)
        single.append(word)
    by_byte = np.zeros((3, 256), np.int64)
    for part in range(3):
        for value in range(256):
            for bit in range(8):
                if value >> bit & 1 and part * 8 + bit < 23:
                    by_byte[part, value] ^= single[part * 8 + bit]
    errors = np.full(2048, -1, np.int64)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            at = 0
            for b in bits:
                at ^= single[b]
            errors[at] = sum(1 << b for b in bits)
    return by_byte, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index (0 to 4095) of the code word nearest to each 23-bit word."""
    by_byte, errors = golay()
    syndrome = by_byte[0][words & 255] ^ by_byte[1][words >> 8 & 255] ^ by_byte[2][words >> 16]
    return (words ^ errors[syndrome]) >> 11


def nearby(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted indices that each word and its neighbours at one of the low bits decode to, and which of them are first of their kind."""
    flips = np.array([0, *(1 << b for b in range(bits))], np.int64)
    found = np.sort(decode(words[:, None] ^ flips[None, :]), axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    return found, first


def fuzzy_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of every fingerprint (uint64)."""
    parts = [(prints >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    own = [decode(p) for p in parts]
    near = [nearby(p, n) for p, (_, n) in zip(parts, SEGMENTS)]
    rows, keys = [], []

    def put(family: int, codes: np.ndarray, mask: np.ndarray) -> None:
        r, c = np.nonzero(mask)
        rows.append(r)
        keys.append(family << 40 | codes[r, c])

    for family, (i, j) in enumerate(combinations(range(3), 2)):
        put(family, near[i][0] << 12 | own[j][:, None], near[i][1])
        put(family, own[i][:, None] << 12 | near[j][0], near[j][1] & (near[j][0] != own[j][:, None]))
    for i in range(3):
        j = (i + 1) % 3
        put(3 + i, parts[i][:, None] << 12 | near[j][0], near[j][1])
    return np.concatenate(rows), np.concatenate(keys)


def key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(prints), 4096):
            rows, keys = fuzzy_keys(prints[at : at + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints[at : at + 4096][rows].view(np.int64))], names=["key", "print"])


def forest(prints: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Pairs of places at max_bits or fewer, enough to join all places that are joined by such pairs.

    First come stars: the free place nearest to the majority of each bit takes all others within reach. As long as
    stars are large this is the bulk of the work, one pass for each. Then every place outside the largest component is
    held against all places; a link between two components always has an end outside the largest.
    """
    n, pairs = len(prints), []
    comp = np.arange(n)

    def merge(at: int, others: np.ndarray) -> None:
        labels = np.unique(comp[others])
        for lab in labels[labels != comp[at]]:
            pairs.append((at, int(others[np.argmax(comp[others] == lab)])))
        comp[np.isin(comp, labels)] = comp[at]

    free = np.ones(n, bool)
    for _ in range(16 if n > 64 else 0):
        left = np.flatnonzero(free)
        if len(left) < 32:
            break
        bits = np.unpackbits(prints[left].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        middle = np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(left), bitorder="little").view(np.uint64)[0]
        at = int(left[np.argmin(np.bitwise_count(prints[left] ^ middle))])
        reach = np.flatnonzero(np.bitwise_count(prints ^ prints[at]) <= max_bits)
        merge(at, reach)
        free[reach] = False
        if len(reach) < 32:
            break
    values, sizes = np.unique(comp, return_counts=True)
    for at in np.flatnonzero(comp != values[np.argmax(sizes)]) if n > 64 else range(n):
        if len(reach := np.flatnonzero(np.bitwise_count(prints ^ prints[at]) <= max_bits)) > 1:
            merge(int(at), reach)
    return pairs


def link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, cell, print) sorted by key and cell; gives the links (a, b) of each group. A group has 2 * PIECE rows
    at most; only the last group of a batch waits for the next."""
    kept = np.empty((0, 3), np.int64)

    def links(rows: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.any(rows[1:, :2] != rows[:-1, :2], axis=1)) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(rows)]])
        a, b, sizes = [], [], ends - starts
        prints = rows[:, 2].copy().view(np.uint64)
        two = starts[sizes == 2]  # most groups
        near = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= MAX_BITS]
        a.extend(rows[near, 2].tolist())
        b.extend(rows[near + 1, 2].tolist())
        for s, e in zip(starts[sizes > 2], ends[sizes > 2]):
            for x, y in forest(prints[s:e]):
                a.append(int(rows[s + x, 2]))
                b.append(int(rows[s + y, 2]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        rows = np.concatenate([kept, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
        change = np.flatnonzero(np.any(rows[1:, :2] != rows[:-1, :2], axis=1))
        upto = int(change[-1]) + 1 if len(change) else 0
        kept = rows[upto:]
        if upto:
            yield links(rows[:upto])
    if len(kept):
        yield links(kept)


def fingerprint_links(prints: DataFrame, piece: int = PIECE) -> DataFrame:
    """Links (a, b) between different fingerprints (column print, distinct) at 4 bits or fewer: not all of them, but
    enough that linked fingerprints stay connected."""
    emitted = prints.select("print").mapInArrow(key_batches, "key long, print long")
    counted = emitted.groupBy("key").agg(F.count("*").alias("n"))
    large = cut(counted.where(F.col("n") > piece).select("key", F.ceil(F.col("n") / piece).cast("int").alias("pieces")))
    own = F.pmod(F.xxhash64("print"), F.col("pieces")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda o: (F.least(o, own) * F.col("pieces") + F.greatest(o, own)).cast("long"))
    if large.isEmpty():
        dealt = emitted.select("key", F.lit(0).cast("long").alias("cell"), "print")
    else:
        dealt = emitted.join(large, "key", "left").select("key", F.explode(F.when(F.col("pieces").isNull(), F.array(F.lit(0).cast("long"))).otherwise(cells)).alias("cell"), "print")
    return dealt.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(link_batches, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, row_id: str | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text, ...): row_id (that of the column named so, or a new one), doc_id,
    print, component_id (smallest doc_id linked to it, itself included), keeps (true for one row of each component).

    Null and blank texts have fingerprint 0 and are linked like any other; long texts are hashed whole, some shingles at
    a time; null ids never are the smallest, a component of none but null ids has the id null; repeated rows are in one
    component; an empty table gives no rows; other columns are not looked at.
    """
    if shingle != SHINGLE:
        raise ValueError("fingerprints are of four-word shingles")
    rows = numbered(docs, "doc_id", "text", row_id=row_id).select("row_id", "doc_id", F.col("text").cast("binary").alias("body"))
    rows = cut(rows.mapInArrow(fingerprint_batches, "row_id long, doc_id long, print long"))
    prints = cut(rows.groupBy("print").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")).alias("first")))
    linked = components(fingerprint_links(prints)).withColumnsRenamed({"node": "print"})
    members = cut(prints.join(linked, "print"))
    ids = members.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min("first")["row_id"].alias("kept_row"))
    # Written first: the join with a hot component is then between two exchanges, which adaptive execution can split.
    named = members.join(broadcast_if_small(ids), "component").select("print", "component_id", "kept_row")
    by_print = cut(prints.join(named, "print", "left").select("print", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("kept_row", "first.row_id").alias("kept_row")))
    return rows.join(by_print, "print").select("row_id", "doc_id", "print", "component_id", (F.col("row_id") == F.col("kept_row")).alias("keeps"))


def near_pairs(docs: DataFrame, row_id: str) -> DataFrame:
    """Candidates (a, b) of docs (doc_id, text, ...) by the numbers of the column row_id: rows of one fingerprint with the
    first of them, and first rows of fingerprints at 4 bits or fewer. Not all such pairs, but enough that rows whose
    fingerprints are linked stay connected."""
    rows = numbered(docs, "doc_id", "text", row_id=row_id).select("row_id", "doc_id", F.col("text").cast("binary").alias("body"))
    rows = cut(rows.mapInArrow(fingerprint_batches, "row_id long, doc_id long, print long"))
    first = broadcast_if_small(rows.groupBy("print").agg(F.min("row_id").alias("first")))
    same = rows.join(first, "print").where("first <> row_id").select(F.col("first").alias("a"), F.col("row_id").alias("b"))
    end = lambda name: first.withColumnsRenamed({"print": name, "first": f"row_{name}"})
    linked = fingerprint_links(first).distinct().join(end("a"), "a").join(end("b"), "b")
    return same.union(linked.select(F.col("row_a").alias("a"), F.col("row_b").alias("b")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text, ...) of which each component keeps one, that of the smallest id; all columns as
    they are. Nulls, blanks and repeats as in near_duplicates; an empty table stays empty; columns of any name are
    passed on."""
    name = fresh(docs, "__row")
    rows = with_row_id(docs, name)
    return without_rows(rows, name, near_duplicates(rows, row_id=name).where("not keeps").select("row_id"))


def hex_print(column: str = "print") -> Column:
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
