"""Near-duplicates by the Jaccard similarity of word shingles: MinHash bands find candidates, the sets themselves decide.

A signature has BANDS * ROWS minima; two texts share a band with probability similarity ** ROWS, so a pair at 0.8 is a
candidate with probability 1 - (1 - 0.8 ** 5) ** 25, above 0.9999. First every member of a bucket is held against the
bucket's smallest row. Then the rows of a bucket that this left in different components, and whose signatures don't speak
against a partner there, meet with their whole sets in one task (or, of a large bucket, in pairs of pieces), which gives
only the links that join components: as many as rows, however many pairs are similar or nearly so. Both times the whole
shingle sets are compared, so no link is below the similarity asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_IDS, broadcast_if_small, cut, fresh, numbered, with_row_id, without_rows
from .components import components

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
BANDS, ROWS = 25, 5
#: A pair's share of equal minima may fall this far below the similarity, more than five standard deviations.
SLACK = 0.2
#: Members of a bucket that are compared in one piece; a larger bucket is dealt out in pairs of pieces.
PIECE = 4096
#: Rows, and hashes of their sets, that are compared exactly in one piece.
SET_PIECE, SET_HASHES = 2048, 2_000_000
#: Rows held against one copy of a set.
LANE = 500
_DRAW = np.random.default_rng(SEED)
#: Multipliers and offsets of the hash orders, and of a band's minima.
TIMES = _DRAW.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
PLUS = _DRAW.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
MIX = _DRAW.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(data: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text in UTF-8; A-Z count as a-z, words are parted by ASCII white
    space. A text of fewer words is one shingle."""
    words = data.lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = list(accumulate(map(len, words), lambda at, n: at + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[b:e], SEED) for b, e in zip(starts, ends[shingle - 1 :])], np.uint64))


def signature(hashes: np.ndarray) -> np.ndarray:
    low, out = hashes.astype(np.uint32), np.full(len(TIMES), (1 << 32) - 1, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(out, (low[at : at + 512, None] * TIMES + PLUS).min(axis=0), out=out)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """One key for each band of each signature."""
    keys = (minima.reshape(-1, BANDS, ROWS).astype(np.uint64) * MIX).sum(axis=2, dtype=np.uint64)
    return keys ^ (keys >> np.uint64(31))


def signature_batches(shingle: int):
    """Replaces a text (last column, UTF-8 or null) by its signature and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            minima = np.stack([signature(shingle_set(t.as_py() or b"", shingle)) for t in batch.column(batch.num_columns - 1)])
            keys = pa.ListArray.from_arrays(pa.array(np.arange(len(minima) + 1, dtype=np.int32) * BANDS), pa.array(band_keys(minima).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([m.tobytes() for m in minima], pa.binary()), keys], names=["row_id", "doc_id", "minima", "keys"])

    return run


def set_batches(shingle: int):
    """Replaces a text by its shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py() or b"", shingle).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["row_id", "hashes"])

    return run


def grouped_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first two columns, in tables that hold groups of these whole."""
    kept: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if kept is None else pa.concat_tables([kept, rows])
        first, second = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        change = np.flatnonzero((first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        upto = int(change[-1]) + 1 if len(change) else 0
        kept = rows.slice(upto)
        if upto:
            yield rows.slice(0, upto)
    if kept is not None:
        yield kept


def groups_of(rows: pa.Table) -> Iterator[tuple[int, int]]:
    first, second = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    edge = (np.flatnonzero((first[1:] != first[:-1]) | (second[1:] != second[:-1])) + 1).tolist()
    yield from zip([0, *edge], [*edge, rows.num_rows])


def pair_batches(similarity: float, rows_only: bool = False):
    """Rows (key, cell, row_id, component, minima) sorted by key and cell; gives the pairs (a, b) of each group that are
    in different components and have enough minima in common, or just the rows (key, row_id, component) of such pairs."""
    least = int(np.ceil((similarity - SLACK) * BANDS * ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_batches(batches):
            rows = np.stack([table.column(c).to_numpy() for c in range(4)], axis=1)
            minima = np.frombuffer(b"".join(table.column(4).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)
            found, hit = [], np.zeros(len(rows), bool)
            for s, e in groups_of(table):
                for i in range(s, e - 1):
                    others = i + 1 + np.flatnonzero(rows[i + 1 : e, 3] != rows[i, 3])
                    others = others[np.count_nonzero(minima[others] == minima[i], axis=1) >= least]
                    if len(others) and not rows_only:
                        found.append(np.stack([np.minimum(rows[i, 2], rows[others, 2]), np.maximum(rows[i, 2], rows[others, 2])], axis=1))
                    hit[i] |= len(others) > 0
                    hit[others] = True
            if rows_only:
                yield pa.RecordBatch.from_arrays([pa.array(rows[hit, c]) for c in (0, 2, 3)], names=["key", "row_id", "component"])
            else:
                out = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two sets share: hashes of many sets through products of 0/1 matrices, the others pair by pair."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(x) for x in sets])
    _, place, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.zeros((n, n), np.float32)  # counts below 2^24, exact
    often = np.flatnonzero(df >= 16)
    rank = np.full(len(df), -1, np.int64)
    rank[often] = np.arange(len(often))
    column = rank[place]
    for at in range(0, len(often), 1024):
        inside = (column >= at) & (column < at + 1024)
        part = np.zeros((n, min(1024, len(often) - at)), np.float32)
        part[row[inside], column[inside] - at] = 1
        shared += part @ part.T
    order = np.argsort(place, kind="stable")
    starts = np.concatenate([[0], np.cumsum(df)[:-1]])
    for d in range(2, 16):
        holders = row[order][starts[df == d][:, None] + np.arange(d)[None, :]]
        for i in range(d):
            for j in range(d):
                if i != j and len(holders):
                    np.add.at(shared, (holders[:, i], holders[:, j]), 1)
    return shared


def set_links(ids: np.ndarray, components_of: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between rows of the similarity, enough to join all components that such links join."""
    sizes, shared = np.array([len(x) for x in sets], np.float64), overlaps(sets)
    label, out = components_of.copy(), []
    for i in range(len(ids)):
        close = np.flatnonzero((shared[i] >= similarity * (sizes[i] + sizes - shared[i]) - 1e-9) & (label != label[i]))
        labels, first = np.unique(label[close], return_index=True)
        out += [(int(ids[i]), int(ids[close[f]])) for f in first]
        label[np.isin(label, labels)] = label[i]
    return out


def set_link_batches(similarity: float):
    """Rows (key, cell, row_id, component, hashes) sorted by key and cell to the links (a, b) of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_batches(batches):
            ids, label, links = table.column(2).to_numpy(), table.column(3).to_numpy(), []
            for s, e in groups_of(table):
                if e - s > 1:
                    sets = [x.values.to_numpy().view(np.uint64) for x in table.column(4).slice(s, e - s)]
                    links += set_links(ids[s:e], label[s:e], sets, similarity)
            a, b = zip(*links) if links else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def shingle_sets(rows: DataFrame, bodies: DataFrame, shingle: int) -> DataFrame:
    """(row_id, hashes) of the rows (row_id, distinct), written out."""
    named = broadcast_if_small(rows, SMALL_IDS)
    return cut(bodies.join(named, "row_id", "left_semi").select("row_id", "body").mapInArrow(set_batches(shingle), "row_id long, hashes array<long>"))


def verified(pairs: DataFrame, bodies: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the similarity. Texts are read for the rows that pairs name; a row of
    many pairs goes once to each lane of them."""
    sets = shingle_sets(pairs.select(F.col("a").alias("row_id")).union(pairs.select(F.col("b").alias("row_id"))).distinct(), bodies, shingle)
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / LANE).alias("lanes")).where("lanes > 1")  # a row for LANE pairs at most
    lane = F.coalesce(F.pmod(F.xxhash64("b"), F.col("lanes")), F.lit(0).cast("long"))
    dealt = cut(pairs.join(broadcast_if_small(many), "a", "left").select("a", "b", lane.alias("lane")))
    left = dealt.select("a", "lane").distinct().join(sets.select(F.col("row_id").alias("a"), F.col("hashes").alias("x")), "a")
    right = dealt.join(sets.select(F.col("row_id").alias("b"), F.col("hashes").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return right.join(left, ["a", "lane"]).where(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b")


def in_cells(rows: DataFrame, pieces: Column) -> DataFrame:
    """rows (key, row_id, ...) with the cells in which each piece of a key's rows meets each other one."""
    own = F.pmod(F.xxhash64("row_id"), pieces).cast("int")
    cells = F.transform(F.sequence(F.lit(0), pieces - 1), lambda o: (F.least(o, own) * pieces + F.greatest(o, own)).cast("long"))
    return rows.withColumn("cell", F.explode(cells))


def closer_links(open_rows: DataFrame, bodies: DataFrame, similarity: float, shingle: int, piece: int) -> DataFrame:
    """Links (a, b) of rows (key, n, row_id, component, minima) in different components of one bucket."""
    dealt = in_cells(open_rows, F.ceil(F.col("n") / piece).cast("int")).select("key", "cell", "row_id", "component", "minima")
    suspects = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(pair_batches(similarity, rows_only=True), "key long, row_id long, component long")
    suspects = cut(suspects.distinct())
    sets = shingle_sets(suspects.select("row_id").distinct(), bodies, shingle)
    # Bands that hold the same rows are looked at once.
    mark = lambda seed: F.xxhash64(F.lit(seed), "row_id")
    kinds = suspects.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(mark(1)).alias("x"), F.bit_xor(mark(2)).alias("y"))
    once = broadcast_if_small(kinds.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), SMALL_IDS)
    entries = cut(suspects.join(once, "key", "left_semi").join(sets.select("row_id", F.size("hashes").cast("long").alias("size")), "row_id"))
    parts = F.greatest(F.ceil(F.count("*") / F.lit(min(piece, SET_PIECE))), F.ceil(F.sum("size") / F.lit(SET_HASHES))).cast("int")
    large = broadcast_if_small(entries.groupBy("key").agg(parts.alias("pieces")).where("pieces > 1"))
    placed = in_cells(entries.join(large, "key", "left"), F.coalesce("pieces", F.lit(1))).select("key", "cell", "row_id", "component")
    with_sets = placed.join(sets, "row_id").select("key", "cell", "row_id", "component", "hashes")
    return with_sets.repartition("key", "cell").sortWithinPartitions("key", "cell").mapInArrow(set_link_batches(similarity), "a long, b long")


def similar_links(signed: DataFrame, bodies: DataFrame, similarity: float, shingle: int, piece: int = PIECE, near: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between rows (row_id, minima, keys) of the similarity, enough that linked rows stay connected. Pairs
    near (a, b) are candidates, too."""
    emitted = signed.select(F.explode("keys").alias("key"), "row_id")
    buckets = cut(emitted.groupBy("key").agg(F.min("row_id").alias("a"), F.count("*").alias("n")).where("n > 1"))
    shared = cut(emitted.join(buckets, "key").select("key", "a", F.col("row_id").alias("b"), "n"))
    stars = shared.where("a <> b").select("a", "b")
    stars = cut((stars if near is None else stars.union(near.select("a", "b"))).distinct())
    links = cut(verified(stars, bodies, similarity, shingle))
    label = components(links).withColumnsRenamed({"node": "b"})
    placed = cut(shared.join(label, "b", "left").select("key", "n", F.col("b").alias("row_id"), F.coalesce("component", "b").alias("component")))
    mixed = cut(placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key"))
    open_rows = placed.join(mixed, "key", "left_semi").join(signed.select("row_id", "minima"), "row_id")
    return links.union(cut(closer_links(open_rows, bodies, similarity, shingle, piece)))


def _grouped(docs: DataFrame, similarity: float, shingle: int, piece: int, row_id: str | None, near: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(row_id, doc_id) of all rows, and (row_id, component_id, kept_row) of those that have a partner."""
    if not SLACK < similarity <= 1:
        raise ValueError(f"similarity is above {SLACK} and at most 1")
    bodies = numbered(docs, "doc_id", "text", row_id=row_id).select("row_id", "doc_id", F.col("text").cast("binary").alias("body"))
    signed = cut(bodies.mapInArrow(signature_batches(shingle), "row_id long, doc_id long, minima binary, keys array<long>"))
    rows = signed.select("row_id", "doc_id")
    label = components(similar_links(signed, bodies, similarity, shingle, piece, near)).withColumnsRenamed({"node": "row_id"})
    members = cut(rows.join(label, "row_id"))
    first = members.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_id"))["row_id"].alias("kept_row"))
    # Written first: the join with a hot component is then between two exchanges, which adaptive execution can split.
    return rows, members.join(broadcast_if_small(first), "component").select("row_id", "component_id", "kept_row")


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, piece: int = PIECE, row_id: str | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text, ...): row_id (that of the column named so, or a new one), doc_id,
    component_id (smallest doc_id that pairs of the similarity connect it with, itself included), keeps (true for one
    row of each component).

    Null and blank texts are equal; whole texts are compared, long ones too; null ids never are the smallest; repeated
    rows are partners; an empty table gives no rows; other columns are not looked at.
    """
    rows, grouped = _grouped(docs, similarity, shingle, piece, row_id)
    keeps = F.coalesce(F.col("row_id") == F.col("kept_row"), F.lit(True))
    return rows.join(grouped, "row_id", "left").select("row_id", "doc_id", F.coalesce("component_id", "doc_id").alias("component_id"), keeps.alias("keeps"))


def drop_similar_documents(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, near: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """The rows of docs (doc_id, text, ...) of which each component keeps one, that of the smallest id; all columns as
    they are. Nulls, blanks, long texts and repeats as in similar_documents; an empty table stays empty; columns of any
    name are passed on. near takes the rows and the name of their numbers' column, and gives candidates (a, b) that are
    verified with those of the bands."""
    name = fresh(docs, "__row")
    rows = with_row_id(docs, name)
    pairs = near(rows, name) if near else None
    return without_rows(rows, name, _grouped(rows, similarity, shingle, PIECE, name, pairs)[1].where("row_id <> kept_row").select("row_id"))
