"""Exact top-k by inner product with block-at-a-time pruning.

Rows are ordered by the nearest of a few pivots and cut into ranges of BLOCK rows. A block keeps its rows (the forward
index) and the largest and smallest value of each component. A query's bound for a block sums, over the components,
the query's value times the block's largest, or smallest where the query's value is negative. The query takes the
blocks in order of their bounds, scores their rows and stops at the first bound below its k-th score.

Blocks that follow one another are a pile, with bounds of its own; there are MAX_PILES at most, whatever the number of
rows. A query is searched in the pile of its highest bound first. What it finds there is the floor for all others: it goes
only to piles whose bound reaches its k-th score, and where that is equal, whose smallest id could still win. Within a
pile queries come in chunks, so a pile that many ask for is searched by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, with_row_id

BLOCK = 256
#: Blocks of a pile at least; piles at most; queries that search a pile together.
PILE, MAX_PILES = 64, 1024
CHUNK = 2048
#: Rows that blocks are ordered by; those with the smallest hash. All rows are indexed and all are scored or bounded.
PIVOTS = 128
LOW = np.iinfo(np.int64).min
BLANK = np.iinfo(np.int64).max  # null ids rank last
PAIRS = "query_row long, query_id long, row_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(row_id, vec_id, v) with v = floor(scale * x) of each component; vectors that are null, or hold a null or
    non-finite component, are left out."""
    rows = with_row_id(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("x")), "row_id")
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where(F.col("x").isNotNull() & F.coalesce(fine, F.lit(False))).select("row_id", "vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """The lists of a column as rows of int64, filled up with zeros (or cut, which loses only products with zero)."""
    lists = column.to_pylist()
    width = max(map(len, lists), default=0) if width is None else width
    out = np.zeros((len(lists), width), np.int64)
    for i, x in enumerate(lists):
        n = min(width, len(x))
        out[i, :n] = x[:n]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers: through float64 where that is exact."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most >= 2.0**63:
        raise OverflowError("components are too large for scores of 64 bits")
    return a @ b.T


def nearest_batches(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = (pivots.astype(np.float64) ** 2).sum(axis=1)
        for batch in batches:
            if pivots.size:
                v = matrix(batch.column("v"), pivots.shape[1]).astype(np.float64)
                near = np.argmin(norms[None, :] - 2 * (v @ pivots.T.astype(np.float64)), axis=1)
            else:
                near = np.zeros(batch.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names=[*batch.schema.names, "pivot"])

    return run


def block_batches(block: int):
    """Sorted rows (row_id, vec_id, v, pivot) to one row for each block, with its bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made, held = TaskContext.get().partitionId() << 32, 0, []

        def flush() -> pa.RecordBatch:
            nonlocal made
            longs = pa.list_(pa.int64())
            row = {"block": base + made, "row_ids": [r[0] for r in held], "vec_ids": [r[1] for r in held], "vs": [r[2] for r in held]}
            v = matrix(pa.array(row["vs"], pa.list_(pa.int64())))
            row |= {"first_id": min(BLANK if i is None else i for i in row["vec_ids"]), "hi": v.max(axis=0), "lo": v.min(axis=0)}
            made += 1
            held.clear()
            return pa.RecordBatch.from_pylist([row], pa.schema([("block", pa.int64()), ("row_ids", longs), ("vec_ids", longs), ("vs", pa.list_(longs)), ("first_id", pa.int64()), ("hi", longs), ("lo", longs)]))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (len(held) == block or held[-1][3] != row[3]):
                    yield flush()
                held.append(row)
        if held:
            yield flush()

    return run


class Best:
    """The k best rows of each query so far, and the score that a row has to reach."""

    def __init__(self, queries: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.q = np.empty(0, np.int64)
        self.score, self.vec, self.row = (np.empty(0, np.int64) for _ in range(3))
        self.worst_id = np.full(queries, np.iinfo(np.int64).max)

    def add(self, q: np.ndarray, score: np.ndarray, vec: np.ndarray, row: np.ndarray) -> None:
        q, score, vec, row = (np.concatenate(x) for x in ((self.q, q), (self.score, score), (self.vec, vec), (self.row, row)))
        order = np.lexsort((row, vec, -score, q))
        q = q[order]
        starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
        nth = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        keep = order[nth < self.k]
        last = order[nth == self.k - 1]
        self.q, self.score, self.vec, self.row = q[nth < self.k], score[keep], vec[keep], row[keep]
        at = q[nth == self.k - 1]
        self.floor[at] = np.maximum(self.floor[at], score[last])
        self.worst_id[at] = np.where(self.floor[at] == score[last], vec[last], np.iinfo(np.int64).max)


def search(queries: np.ndarray, query_rows: np.ndarray, blocks: list[tuple], k: int, floor: np.ndarray) -> tuple[Best, int]:
    """Scores queries against blocks (row_ids, vec_ids, vectors); also gives the number of (query, block) pairs scored."""
    best, scored = Best(len(queries), k, floor), 0
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    bounds = products(up, np.stack([v.max(axis=0) for _, _, v in blocks])) + products(down, np.stack([v.min(axis=0) for _, _, v in blocks]))
    order = np.argsort(-bounds, axis=1, kind="stable")
    first_id = np.array([ids.min() for _, ids, _ in blocks])
    for turn in range(len(blocks)):
        at = order[:, turn]
        bound = bounds[np.arange(len(queries)), at]
        if not np.any(bound >= best.floor):
            break
        wanted = np.flatnonzero((bound > best.floor) | (bound == best.floor) & (first_id[at] <= best.worst_id))
        found = []
        for b in np.unique(at[wanted]):
            rows, ids, v = blocks[b]
            q = wanted[at[wanted] == b]
            score = products(queries[q], v)
            score[query_rows[q][:, None] == rows[None, :]] = LOW
            least = best.floor[q]
            if score.shape[1] > k:
                least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k])
            i, j = np.nonzero((score >= least[:, None]) & (score > LOW))
            found.append((q[i], score[i, j], ids[j], rows[j]))
            scored += len(q)
        if found:
            best.add(*(np.concatenate(x) for x in zip(*found)))
    return best, scored


def cell_search(k: int, pivots: np.ndarray, pivot_rows: np.ndarray):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: the blocks of a cell; right: its queries (row_id, vec_id, v, floor)."""
        names = [x.split()[0] for x in PAIRS.split(", ")]
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        queries = matrix(right.column("v"))
        query_rows, query_ids = right.column("row_id").to_numpy(), right.column("vec_id").to_pylist()
        blocks = [
            (np.array(r), np.array([BLANK if x is None else x for x in i]), matrix(pa.array(v), queries.shape[1]))
            for r, i, v in zip(left.column("row_ids").to_pylist(), left.column("vec_ids").to_pylist(), left.column("vs").to_pylist())
        ]
        floor = right.column("floor").to_numpy().copy()
        if len(pivot_rows) > k:
            near = products(queries, matrix(pa.array(pivots.tolist()), queries.shape[1]))
            near[query_rows[:, None] == pivot_rows[None, :]] = LOW
            floor = np.maximum(floor, np.partition(near, -k, axis=1)[:, -k])
        best, _ = search(queries, query_rows, blocks, k, floor)
        ids = [None if x == BLANK else int(x) for x in best.vec]
        return pa.table(
            {"query_row": pa.array(query_rows[best.q]), "query_id": pa.array([query_ids[q] for q in best.q], pa.int64()), "row_id": pa.array(best.row), "vec_id": pa.array(ids, pa.int64()), "score": pa.array(best.score)}
        )

    return run


@dataclass(frozen=True)
class Piles:
    """Bounds of all piles, MAX_PILES at most."""

    first_id: np.ndarray
    hi: np.ndarray
    lo: np.ndarray

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        fit = lambda m: np.pad(m, ((0, 0), (0, max(0, queries.shape[1] - m.shape[1]))))[:, : queries.shape[1]]
        return products(np.maximum(queries, 0), fit(self.hi)) + products(np.minimum(queries, 0), fit(self.lo))


def pile_bounds(blocks: DataFrame, n: int) -> Piles:
    """Bounds of n piles from blocks (pile, first_id, hi, lo). Each component's extremes are aggregated by pile before
    the shuffle; a block without a component counts there as zero."""
    width = blocks.agg(F.max(F.size("hi"))).first()[0] or 0
    zero = F.lit(0).cast("long")
    pairs = F.transform(F.sequence(F.lit(0), F.lit(max(0, width - 1))), lambda i: F.struct(F.coalesce(F.get("hi", i), zero).alias("hi"), F.coalesce(F.get("lo", i), zero).alias("lo")))
    each = blocks.select("pile", "first_id", F.posexplode(pairs).alias("at", "x"))
    found = each.groupBy("pile", "at").agg(F.min("first_id").alias("first_id"), F.max("x.hi").alias("hi"), F.min("x.lo").alias("lo")).collect()  # MAX_PILES * width numbers at most
    first, hi, lo = np.full(n, BLANK), np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
    for r in found:
        first[r["pile"]] = r["first_id"]
        if width:
            hi[r["pile"], r["at"]], lo[r["pile"], r["at"]] = r["hi"], r["lo"]
    return Piles(first, hi, lo)


def first_piles(piles: Piles):
    """Queries (row_id, vec_id, v) to (..., floor, pile): the pile of the highest bound, no floor yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best = np.argmax(piles.bounds(matrix(batch.column("v"))), axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.full(len(best), LOW + 1)), pa.array(best)], names=["row_id", "vec_id", "v", "floor", "pile"])

    return run


def other_piles(piles: Piles):
    """Queries (row_id, vec_id, v, floor, worst_id) to (row_id, vec_id, v, floor, pile) for each other pile that can hold
    one of their best rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                floor, worst = part.column("floor").to_numpy()[:, None], part.column("worst_id").to_numpy()[:, None]
                bound = piles.bounds(matrix(part.column("v")))
                wanted = (bound > floor) | (bound == floor) & (piles.first_id[None, :] <= worst)
                wanted[np.arange(len(wanted)), np.argmax(bound, axis=1)] = False
                rows, pile = np.nonzero(wanted)
                for lo in range(0, len(rows), 4096):
                    some = pa.array(rows[lo : lo + 4096])
                    yield pa.RecordBatch.from_arrays([*(part.column(c).take(some) for c in range(4)), pa.array(pile[lo : lo + 4096].astype(np.int32))], names=["row_id", "vec_id", "v", "floor", "pile"])

    return run


ASKED = "row_id long, vec_id long, v array<long>, floor long, pile int"


def searched(blocks: DataFrame, asked: DataFrame, k: int, pivots: np.ndarray, pivot_rows: np.ndarray) -> DataFrame:
    """(PAIRS): the best of each pile for the queries (ASKED) that ask for it. Piles that none asks for stay where they
    are; one that many ask for goes to each chunk of them."""
    chunks = F.broadcast(cut(asked.groupBy("pile").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))))  # a row for each pile
    left = blocks.join(chunks, "pile").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks", "hi", "lo", "first_id")
    right = asked.join(chunks, "pile").withColumn("chunk", F.pmod(F.xxhash64("row_id"), F.col("chunks")).cast("int")).drop("chunks")
    return left.groupBy("pile", "chunk").cogroup(right.groupBy("pile", "chunk")).applyInArrow(cell_search(k, pivots, pivot_rows), PAIRS)


def top_k(vectors: DataFrame, queries: str = "vec_id % 50 = 0", k: int = 5, block: int = BLOCK, pile: int = PILE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors (vec_id, embedding, ...) with the highest integer inner
    product for each row that satisfies the SQL condition `queries`, its own row left out; ties go to the smaller vec_id.

    Vectors that are null or hold null or non-finite components neither ask nor are found; a shorter vector counts as
    filled up with zeros; a null vec_id never asks and ranks behind others; repeated rows are rows like others; fewer than
    k others give all of them; an empty table gives no rows; other columns are not looked at. Very long vectors are held
    whole by a task, a block of them at a time. Scores are exact; components so large that one might reach 2^63 fail.
    """
    rows = cut(quantised(vectors))
    sample = rows.orderBy(F.xxhash64("vec_id", "row_id"), "row_id").limit(PIVOTS).collect()  # PIVOTS rows at most
    width = max((len(r["v"]) for r in sample), default=0)
    pivots = np.array([r["v"] + [0] * (width - len(r["v"])) for r in sample], np.int64).reshape(len(sample), width)
    pivot_rows = np.array([r["row_id"] for r in sample], np.int64)
    near = rows.mapInArrow(nearest_batches(pivots), "row_id long, vec_id long, v array<long>, pivot int")
    ordered = near.repartitionByRange("pivot", "vec_id", "row_id").sortWithinPartitions("pivot", "vec_id", "row_id")
    blocks = cut(ordered.mapInArrow(block_batches(block), "block long, row_ids array<long>, vec_ids array<long>, vs array<array<long>>, first_id long, hi array<long>, lo array<long>"))
    made = sorted((r["part"], r["n"]) for r in blocks.groupBy(F.shiftright("block", 32).cast("int").alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each partition
    total = sum(n for _, n in made)
    per = max(pile, -(-total // MAX_PILES))
    starts = rows.sparkSession.createDataFrame([(part, sum(n for p, n in made if p < part)) for part, _ in made], "part int, start long")
    placed = blocks.withColumn("part", F.shiftright("block", 32).cast("int")).join(F.broadcast(starts), "part")  # a row for each partition
    placed = placed.withColumn("pile", F.floor((F.col("start") + F.col("block").bitwiseAND(F.lit((1 << 32) - 1))) / per).cast("int")).drop("part", "start", "block")
    piles = pile_bounds(placed, max(1, -(-total // per)))
    asked = rows.where(queries)
    found = cut(searched(placed, asked.mapInArrow(first_piles(piles), ASKED), k, pivots, pivot_rows))
    blank = lambda c: F.coalesce(c, F.lit(BLANK))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row_id")
    last = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == k).select(F.col("query_row").alias("row_id"), F.col("score").alias("floor"), blank(F.col("vec_id")).alias("worst_id"))
    floored = asked.join(last, "row_id", "left").select("row_id", "vec_id", "v", F.coalesce("floor", F.lit(LOW + 1)).alias("floor"), blank(F.col("worst_id")).alias("worst_id"))
    more = searched(placed, cut(floored.mapInArrow(other_piles(piles), ASKED)), k, pivots, pivot_rows)
    rank = F.row_number().over(order)
    return found.union(more).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
