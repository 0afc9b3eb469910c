import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.llm import packing
from shelfspark.llm.queries import op3_packing
from shelfspark.llm.tokens import ByteBpe, slow_tokenizer
from tests.oracle import SMALL


def slow_ids(text):
    return slow_tokenizer(ByteBpe().vocabulary).encode(text, add_special_tokens=False).ids


def check(rows, ids_of, capacity=2048):
    """rows (doc_id, start, length, crc, doc_tokens, window, offset) hold each id once, in gapless windows."""
    by_doc, by_window = {}, {}
    for r in rows:
        by_doc.setdefault(r[0], []).append(r)
        by_window.setdefault(r[5], []).append((r[6], r[2]))
    assert set(by_doc) == set(ids_of)
    for doc, pieces in by_doc.items():
        at, ids = 0, ids_of[doc]
        for _, start, length, crc, tokens, *_ in sorted(pieces, key=lambda p: p[1]):
            assert start == at and tokens == len(ids) and crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    fills = []
    for pieces in by_window.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        fills.append(at)
    return fills


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=60))
def test_pieces_are_whole(lengths):
    docs = [(i, np.arange(n, dtype=np.uint32)) for i, n in enumerate(lengths)]
    fills = check(list(packing.pack(docs, 16)), {i: list(range(n)) for i, n in enumerate(lengths)}, 16)
    assert sum(f < 16 for f in fills) <= 1  # only the last window is padded


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 15), min_size=1, max_size=80))
def test_levels_minimise_the_sum_of_squares(sizes):
    levels = packing.SumOfSquares(16)
    for size in sizes:
        before = levels.counts[1:16].copy()

        def after(level):
            n = before.copy()
            if level:
                n[level - 1] -= 1
            if level + size < 16:
                n[level + size - 1] += 1
            return int((n.astype(int) ** 2).sum())

        allowed = [0] + [h for h in range(1, 17 - size) if before[h - 1]]
        level = levels.best_level(size)
        assert level in allowed and after(level) == min(after(h) for h in allowed)
        levels.place(size)
        assert levels.counts[1:16].tolist() == [len(levels.open[h]) for h in range(1, 16)]


def test_ids_are_those_of_tokenizers():
    bpe, rng = ByteBpe(), np.random.default_rng(3)
    latin = "".join(map(chr, range(256)))
    texts = ["", " ", "a\n\n b", "it's we'll\t\tx  ", "<|endoftext|> x", "東京 naïve 😀", latin, latin[::-1], "²³ ½x\x85y\xa0z \x1c\x1d"]
    texts += ["".join(rng.choice(list(latin), 40)) for _ in range(400)]
    for text in texts:
        assert bpe.ids(text).tolist() == slow_ids(text), repr(text)


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    rows = [tuple(r) for r in op3_packing(spark, SMALL).collect()]
    fills = check(rows, {r["doc_id"]: [*slow_ids(r["text"]), 1] for r in docs})
    assert sum(2048 - f for f in fills) / sum(fills) < 0.02


def test_edges(edge_docs, no_docs):
    from tests.llm.conftest import ROWS

    rows = [tuple(r) for r in packing.pack_documents(edge_docs).collect()]
    for doc, text in ROWS:
        ids = [*slow_ids(text or ""), 1]
        mine = [r for r in rows if r[0] == doc and r[4] == len(ids)]
        copies = sum((d, len(slow_ids(t or ""))) == (doc, len(ids) - 1) for d, t in ROWS)
        assert sum(r[2] for r in mine) == copies * len(ids)
    windows = {}
    for r in rows:
        windows.setdefault(r[5], []).append((r[6], r[2]))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(no_docs).count() == 0


@pytest.mark.parametrize("capacity", [2, 3])
def test_tiny_windows(capacity):
    docs = [(i, np.ones(n, np.uint32)) for i, n in enumerate([1, 2, 3, 1, 1])]
    check(list(packing.pack(docs, capacity)), {i: [1] * n for i, n in enumerate([1, 2, 3, 1, 1])}, capacity)
