"""Sum-of-squares online packing of token sequences into windows of fixed length.

A document of more than a window's tokens fills whole windows first; its rest, shorter than a window, is placed online.
With N(h) windows filled to level h, 0 < h < capacity, it goes to the level that makes the sum of N(h)^2 least, which
keeps windows of all levels at hand and so finds a fitting one for most lengths. Levels are one array; the windows of a
level form a stack.

Each Spark task packs the rows of its split in their order with levels of its own: no shuffle, memory for one batch of
texts and the open windows' numbers. When a task's rows are over, its partly filled windows are closed up: pieces of the
emptiest ones are cut to fill the fullest ones, so that one window at most stays partly filled. Tasks number their
windows by split, so a task that runs again gives the same rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import ByteBpe

CAPACITY = 2048
END = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Open windows by level. place() gives the window and offset for a rest of 0 < size < capacity tokens."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)  # counts[h] windows at level h; 0 and capacity aren't counted
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.windows = 0

    def new_window(self) -> int:
        self.windows += 1
        return self.windows - 1

    def best_level(self, size: int) -> int:
        """The level whose growth by size adds least to the sum of squares; level 0 is a new window. Among equals the
        fullest."""
        c, n = self.counts, self.capacity
        levels = np.flatnonzero(c[1 : n - size + 1]) + 1
        added = 2 * (c[levels + size] - c[levels]) + 2  # both levels change by one
        if len(levels) and levels[-1] == n - size:
            added[-1] = 1 - 2 * c[n - size]  # a full window isn't counted any more
        if not len(levels) or 2 * c[size] + 1 < added.min():
            return 0
        return int(levels[len(added) - 1 - np.argmin(added[::-1])])

    def place(self, size: int) -> tuple[int, int]:
        level = self.best_level(size)
        if level:
            window = self.open[level].pop()
            self.counts[level] -= 1
        else:
            window = self.new_window()
        if level + size < self.capacity:
            self.open[level + size].append(window)
            self.counts[level + size] += 1
        return window, level

    def leftover(self) -> list[tuple[int, int]]:
        """(level, window) of the partly filled windows."""
        return [(h, w) for h in range(self.capacity) for w in self.open[h]]


def close_up(levels: list[tuple[int, int]], held: dict[int, list], capacity: int) -> None:
    """Moves what the emptiest windows hold into the room of the fullest ones, cutting pieces where they don't fit. held:
    the pieces [document, start, ids, tokens] of each partly filled window, in order; changed in place."""
    order = sorted(levels, reverse=True)
    room = {w: capacity - h for h, w in order}
    i, j = 0, len(order) - 1
    while i < j:
        to, source = order[i][1], order[j][1]
        if not room[to]:
            i += 1
            continue
        if not held[source]:
            del held[source]
            j -= 1
            continue
        doc, start, ids, tokens = held[source].pop()
        fits = min(len(ids), room[to])
        held[to].append([doc, start, ids[:fits], tokens])
        room[to] -= fits
        room[source] += fits
        if fits < len(ids):
            held[source].append([doc, start + fits, ids[fits:], tokens])


def pack(documents: Iterable[tuple[int | None, np.ndarray]], capacity: int = CAPACITY) -> Iterator[tuple]:
    """Packs (doc_id, ids); gives (doc_id, start, length, crc, doc_tokens, window, offset) of each piece."""
    levels, held = SumOfSquares(capacity), {}

    def rows(window: int, pieces: list) -> Iterator[tuple]:
        at = 0
        for doc, start, ids, tokens in pieces:
            yield doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, window, at
            at += len(ids)

    for doc, ids in documents:
        n, start = len(ids), 0
        while n - start >= capacity:
            yield from rows(levels.new_window(), [[doc, start, ids[start : start + capacity], n]])
            start += capacity
        if start < n:
            window, at = levels.place(n - start)
            held.setdefault(window, []).append([doc, start, ids[start:], n])
            if at + n - start == capacity:
                yield from rows(window, held.pop(window))
    close_up(levels.leftover(), held, capacity)
    for window, pieces in held.items():
        yield from rows(window, pieces)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """Tokenises docs (doc_id, text, ...), adds the end id to each document and packs all into windows.

    Returns the pieces (SCHEMA): the ids start..start+length-1 of a document lie at offset.. of sequence_id. A null or
    empty text is the end id alone; null ids are kept; repeated rows are packed one by one; an empty table gives no
    rows; other columns are not looked at. A very long text is tokenised whole in its task and fills windows of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, bpe = TaskContext.get().partitionId() << 36, ByteBpe(vocabulary, ranks)

        def documents() -> Iterator[tuple]:
            for batch in batches:
                for doc, text in zip(batch.column(0), batch.column(1)):
                    yield doc.as_py(), np.append(bpe.ids(text.as_py() or ""), np.uint32(END))

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        rows = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(names)
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)
            rows.clear()
            return out

        for doc, start, length, crc, tokens, window, at in pack(documents(), capacity):
            rows.append((doc, start, length, crc, tokens, first + window, at))
            if len(rows) == 20_000:
                yield flush()
        yield flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
