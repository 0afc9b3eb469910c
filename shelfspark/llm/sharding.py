"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a 64-bit ring; they cut it into arcs. A row belongs to the arc of its key's
hash and is offered to the shard that owns the arc's end. A shard takes rows up to its capacity; what a full shard
can't take goes on clockwise to the next point whose shard has room. Only the number of rows in each (arc, lane)
reaches the driver: arcs * lanes numbers, however many rows there are. There the offers are played through on
counts, which gives for each arc consecutive ranges of its rows and their shards; the rows find theirs by a join
with these ranges.
"""

from __future__ import annotations

import bisect
import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_crc, utf8_size, with_row_id

VNODES = 64
LANES = 16


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes in ring order; a shard's points don't depend on the other shards."""
    points = []
    for shard in range(shards):
        for v in range(vnodes):
            digest = hashlib.blake2b(f"shard-{shard}/{v}".encode(), digest_size=8).digest()
            points.append((int.from_bytes(digest, "big") - (1 << 63), shard))
    return sorted(points)


@dataclass(frozen=True)
class Span:
    """Rows lo..hi-1 of an arc, in the arc's order, and the shard that takes them."""

    arc: int
    lo: int
    hi: int
    shard: int


def capacities(total: int, shards: int, load_factor: float) -> list[int]:
    """Rows that each shard takes at most. At load factor 1 they add up to the total, so that counts are at most one
    apart; above 1 fewer rows leave the shard that their hash names."""
    if load_factor <= 1:
        return [total // shards + (s < total % shards) for s in range(shards)]
    return [-int(-total * load_factor // shards)] * shards


def offer(counts: list[int], points: list[tuple[int, int]], room: list[int]) -> list[Span]:
    """Plays the offers on counts. Step k offers what is left of each arc to the point k places clockwise, so rows
    nearest to their own point come first."""
    room, n, spans = list(room), len(points), []
    left = {a: (0, c) for a, c in enumerate(counts) if c}
    for step in range(n):
        for arc in list(left):
            lo, hi = left[arc]
            shard = points[(arc + step) % n][1]
            if take := min(room[shard], hi - lo):
                spans.append(Span(arc, lo, lo + take, shard))
                room[shard] -= take
                if lo + take == hi:
                    del left[arc]
                else:
                    left[arc] = (lo + take, hi)
        if not left:
            break
    if left:
        raise ValueError("the shards have less room than there are rows")
    return spans


def arc_of(position: Column, points: list[tuple[int, int]]) -> Column:
    """The number of the first point at or after a position; past the last one it is the first. The ring's positions
    are a literal array, its size fixed by shards * vnodes; a binary search over it takes log2 steps."""
    marks = F.array(*[F.lit(p) for p, _ in points])
    n, steps = len(points), max(1, len(points)).bit_length()
    lo, hi = F.lit(0), F.lit(n)
    state = F.struct(lo.alias("lo"), hi.alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        below = (s["lo"] < s["hi"]) & (F.get(marks, mid) < position)
        return F.struct(
            F.when(below, mid + 1).otherwise(s["lo"]).alias("lo"),
            F.when(below | (s["lo"] >= s["hi"]), s["hi"]).otherwise(mid).alias("hi"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, halve, lambda s: s["lo"] % n)


def assign(keyed: DataFrame, shards: int, load_factor: float = 1.0, vnodes: int = VNODES, lanes: int = LANES) -> DataFrame:
    """Adds `shard` and `slot` (0, 1, ... in each shard) to rows with a long `position`, a long `row_id` that tells
    rows apart, and any other columns. Rows of one position spread over lanes by row_id, so that a key with a third of
    all rows isn't sorted by one task."""
    points = ring(shards, vnodes)
    placed = cut(keyed.withColumn("arc", arc_of(F.col("position"), points)).withColumn("lane", F.pmod(F.xxhash64("position", "row_id"), F.lit(lanes)).cast("int")))
    lane_rows = {(r["arc"], r["lane"]): r["n"] for r in placed.groupBy("arc", "lane").agg(F.count("*").alias("n")).collect()}  # arcs * lanes rows at most
    counts = [sum(lane_rows.get((a, x), 0) for x in range(lanes)) for a in range(len(points))]
    spans = offer(counts, points, capacities(sum(counts), shards, load_factor))
    filled, by_arc = [0] * shards, {}
    for s in spans:
        by_arc.setdefault(s.arc, []).append((s.lo, s.hi, s.shard, filled[s.shard]))
        filled[s.shard] += s.hi - s.lo
    pieces = []
    for arc, cuts in by_arc.items():
        cuts.sort()
        begin = 0
        for lane in range(lanes):
            end = begin + lane_rows.get((arc, lane), 0)
            k = bisect.bisect_right([c[1] for c in cuts], begin)
            while k < len(cuts) and cuts[k][0] < end:
                lo, hi, shard, slot = cuts[k]
                a, b = max(lo, begin), min(hi, end)
                pieces.append((arc, lane, a - begin, b - begin, shard, slot + a - lo))
                k += 1
            begin = end
    spark = keyed.sparkSession
    ranges = spark.createDataFrame(pieces, "arc int, lane int, lo long, hi long, shard int, slot0 long")
    nth = F.row_number().over(Window.partitionBy("arc", "lane").orderBy("position", "row_id")) - 1
    return (
        placed.withColumn("nth", nth.cast("long"))
        .join(F.broadcast(ranges), ["arc", "lane"])  # arcs * lanes rows and one more for each cut
        .where((F.col("nth") >= F.col("lo")) & (F.col("nth") < F.col("hi")))
        .withColumn("slot", F.col("slot0") + F.col("nth") - F.col("lo"))
        .drop("arc", "lane", "nth", "lo", "hi", "slot0")
    )


def shard_documents(docs: DataFrame, shards: int = 8, load_factor: float = 1.0, vnodes: int = VNODES) -> DataFrame:
    """Puts every row of docs (doc_id, text, ...) into a shard.

    Returns doc_id, size, text_crc32, shard, slot. Null ids hash like any other value; null texts have size 1 and the
    CRC of the empty text; repeated rows are placed one by one; an empty table gives no rows; other columns are not
    looked at. Rows are placed singly: equal texts aren't kept together, as one such group may exceed a shard. Of a very
    long text only size and CRC are worked out, where it is read.
    """
    keyed = with_row_id(docs.select("doc_id", "text"), "row_id").select(
        "doc_id",
        (utf8_size(F.col("text")) + 1).alias("size"),
        text_crc(F.col("text")).alias("text_crc32"),
        "row_id",
        F.xxhash64(F.lit("ring"), F.col("doc_id")).alias("position"),
    )
    return assign(keyed, shards, load_factor, vnodes).select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
