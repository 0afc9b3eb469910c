"""Periodic runs of words in whole texts, and texts without their repetitions.

A run is a stretch of words with smallest period q that is at least max(`least_words`, `least_exponent` * q) words long
and that no neighbouring word extends. By the runs theorem, each run holds the longest Lyndon word that begins at one of
its words, under the order of the words' numbers or under the opposite one, and that Lyndon word is as long as the period.
So for both orders

* suffixes are ranked by prefix doubling; a longest Lyndon word ends before the next suffix of smaller rank;
* the word is extended to the right by the longest common prefix of the suffixes at its start and behind its end, and to
  the left by that of the reversed text; both are minima over a range of the LCP array, taken from a sparse table.

Lyndon words have no border, so a period found this way is the smallest. Before that, `windows` leaves out words that no
run can reach: in a run every three words come again within a period, so a stretch of T words whose next three words
come again holds periods of (T + 2) / (least_exponent - 1) at most, and what comes again later than that ends it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS, LEAST_EXPONENT = 6, 4
#: Passes of `windows`; more of them would leave out more, never change a result.
ROUNDS = 8
NONE = np.empty((0, 3), np.int64)


def windows(ids: np.ndarray, exponent: int = LEAST_EXPONENT) -> list[tuple[int, int]]:
    """Stretches [from, to) of ids, apart from each other, such that each run lies within one of them."""
    n = len(ids) - 2
    if n < 1:
        return []
    w = ids.astype(np.uint64)
    three = (w[:-2] * np.uint64(0x9E3779B97F4A7C15) + w[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + w[2:]  # equal by chance: only less is left out
    order = np.argsort(three, kind="stable")
    again = three[order[1:]] == three[order[:-1]]
    distance = np.full(n, n, np.int64)
    distance[order[:-1][again]] = (order[1:] - order[:-1])[again]
    live = distance < n
    for _ in range(ROUNDS):
        edges = np.flatnonzero(np.diff(live, prepend=False, append=False))
        first, last = edges[::2], edges[1::2]
        most = (last - first + 2) // (exponent - 1)
        near = distance[live] <= np.repeat(most, last - first)
        if near.all():
            break
        live[live] = near
    out: list[tuple[int, int]] = []
    for a, b in zip(first.tolist(), np.minimum(last + most + 2, len(ids)).tolist()):
        if out and a < out[-1][1]:  # else a window might hold part of a run of another one
            a, b = out[-1][0], max(b, out.pop()[1])
        out.append((a, b))
    return out


def ranks(ids: np.ndarray) -> list[np.ndarray]:
    """For 1, 2, 4, ... words, the rank from 1 of what begins at each place, up to ranks of whole suffixes; each with a 0
    for the end, which comes before all words."""
    n, k = len(ids), 1
    rank = np.unique(ids, return_inverse=True)[1] + 1
    levels = [np.append(rank, 0)]
    while rank.max() < n:
        behind = np.zeros(n, np.int64)
        behind[: max(0, n - k)] = rank[k:]
        rank = np.unique(rank * (n + 1) + behind, return_inverse=True)[1] + 1
        levels.append(np.append(rank, 0))
        k *= 2
    return levels


class CommonPrefix:
    """Lengths of common prefixes of any two suffixes: the LCP array of their order, and its minima over 1, 2, 4, ... places."""

    def __init__(self, levels: list[np.ndarray]):
        self.rank = levels[-1][:-1] - 1
        order = np.argsort(self.rank)
        a, b = order[:-1].copy(), order[1:].copy()
        for k in range(len(levels) - 1, -1, -1):
            step = (levels[k][a] == levels[k][b]).astype(np.int64) << k
            a += step
            b += step
        self.minima = [(a - order[:-1]).astype(np.int32)]
        while len(self.minima[-1]) > 1 << (len(self.minima) - 1):
            low, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(low[:-half], low[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of the suffixes at i and j (arrays, i != j everywhere)."""
        low, high = np.minimum(self.rank[i], self.rank[j]), np.maximum(self.rank[i], self.rank[j])
        out, k = np.zeros(len(i), np.int64), np.frexp(high - low)[1] - 1
        for level in np.unique(k):
            at = k == level
            row = self.minima[level]
            out[at] = np.minimum(row[low[at]], row[high[at] - (1 << int(level))])
        return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """The next place with a smaller value, or the number of values."""
    out, open_at, listed = [len(values)] * len(values), [], values.tolist()
    for at, value in enumerate(listed):
        while open_at and listed[open_at[-1]] > value:
            out[open_at.pop()] = at
        open_at.append(at)
    return np.array(out, np.int64)


def window_runs(ids: np.ndarray, least_words: int, exponent: int) -> np.ndarray:
    """(start, length, period) of the runs of ids, in order."""
    n = len(ids)
    ordered, opposite = ranks(ids), ranks(-ids)
    ahead, back = CommonPrefix(ordered), CommonPrefix(ranks(ids[::-1]))
    found = []
    for suffix in (ordered, opposite):
        i = np.arange(n)
        j = next_smaller(suffix[-1][:-1])
        some = (j < n) & ((j - i) * exponent <= n)  # a run of two periods and more also holds a root that ends before its end
        i, j = i[some], j[some]
        left = np.zeros(len(i), np.int64)
        left[i > 0] = back(n - i[i > 0], n - j[i > 0])
        start, length, period = i - left, j + ahead(i, j) - (i - left), j - i
        long = length >= np.maximum(least_words, exponent * period)
        found.append(np.stack([start[long], length[long], period[long]], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def runs(ids: np.ndarray, least_words: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """(start, length, period) of all runs of a text, given its words' numbers: in order of start, then period."""
    if least_words < 5 or exponent < 2:
        raise ValueError("runs have five words and two periods at least")
    parts = [window_runs(ids[a:b], least_words, exponent) + [a, 0, 0] for a, b in windows(ids, exponent) if b - a >= least_words]
    out = np.unique(np.concatenate([NONE, *parts]), axis=0)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def kept_words(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """Without the words that a run holds behind its first period."""
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, found[:, 0] + found[:, 2], 1)
    np.add.at(depth, found[:, 0] + found[:, 1], -1)
    return [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def run_batches(batches: Iterator[pa.RecordBatch], least_words: int, exponent: int) -> Iterator[pa.RecordBatch]:
    """Of (id, text in UTF-8 or null)."""
    for batch in batches:
        n_words, spans, texts = [], [], []
        for text in batch.column(1):
            words = (text.as_py() or b"").split()
            number: dict[bytes, int] = defaultdict(count().__next__)
            found = runs(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), least_words, exponent)
            n_words.append(len(words))
            spans.append([{"start": s, "length": n, "period": q} for s, n, q in found.tolist()])
            texts.append(b" ".join(kept_words(words, found) if len(found) else words))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, SPANS), pa.array(texts, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """(doc_id, n_words, runs: array of start, length, period, collapsed: the text without repetitions) of each row.

    Words are parted by ASCII white space and compared as they are. A null, empty or blank text has no words, no runs and
    an empty collapsed text; repeated rows and rows without an id each get a row of their own; other columns of docs are
    not looked at, an empty table gives an empty one. Texts are read whole, each in one task: memory follows the longest
    text, and beyond its words' numbers only stretches that come again (n log n numbers for such a stretch of n words).
    """
    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"
    found = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(lambda batches: run_batches(batches, least_words, least_exponent), kind)
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def strongest(found: Column) -> Column:
    """The run of greatest length / period, compared exactly; of equal ones the first (they are in order). Null if none."""
    better = lambda best, run: run["length"] * best["period"] > best["length"] * run["period"]
    return F.aggregate(found, F.get(found, F.lit(0)), lambda best, run: F.when(better(best, run), run).otherwise(best))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of what find_runs returns."""
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))))
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
