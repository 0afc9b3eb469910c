import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfspark.llm import runs as R
from shelfspark.llm.queries import op13_runs
from tests.llm.conftest import LONG, ROWS
from tests.oracle import SMALL


def brute_runs(words, least=6, exponent=4):
    """Every period at every place, word by word."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - i + q
            smaller = any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q))
            if length >= max(least, exponent * q) and not smaller:
                out.append((i, length, q))
            i = end
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, planted=True):
    words = (text or "").encode().split()
    n = len(words)
    if planted and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words) if len(words) < 3000 else [tuple(r) for r in R.window_runs(np.unique(words, return_inverse=True)[1], 6, 4).tolist()]
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    spans = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *tail, digest(spans.encode()), digest(b" ".join(w for k, w in enumerate(words) if k not in gone)))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_runs_of_few_words(words):
    assert [tuple(r) for r in R.runs(np.array(words, np.int64)).tolist()] == brute_runs(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 9), min_size=1, max_size=7), st.integers(1, 9)), max_size=8), st.integers(2, 5), st.integers(5, 9))
def test_runs_of_repeated_stretches(parts, exponent, least):
    words = [w for some, times in parts for w in some * times]
    assert [tuple(r) for r in R.runs(np.array(words, np.int64), least, exponent).tolist()] == brute_runs(words, least, exponent)


def test_windows_leave_out_what_no_run_reaches():
    rng = np.random.default_rng(3)
    loose = rng.integers(0, 400, 5000)
    ids = np.concatenate([loose, [1001, 1002, 1003] * 6, loose])
    assert sum(b - a for a, b in R.windows(ids)) < 100
    assert [5000, 18, 3] in R.runs(ids).tolist()


def test_very_long_run_and_long_text():
    assert R.runs(np.zeros(200_000, np.int64)).tolist() == [[0, 200_000, 1]]
    assert R.runs(np.arange(300_000) % 977).tolist() == [[0, 300_000, 977]]


def test_bounds_of_parameters():
    with pytest.raises(ValueError):
        R.runs(np.zeros(9, np.int64), 4, 4)
    with pytest.raises(ValueError):
        R.runs(np.zeros(9, np.int64), 6, 1)


def test_edge_rows(spark, edge_docs, no_docs):
    got = R.digests(R.find_runs(edge_docs)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute_row(i, t, planted=False) for i, t in ROWS), key=str)
    assert next(r for r in got if r.doc_id == 5).period == 977 and LONG.startswith("w0 w1 ")
    assert R.digests(R.find_runs(no_docs)).count() == 0


def test_collapsed_text(spark):
    docs = spark.createDataFrame([(1, "so  so so so so so good\nand on and on and on and on it goes")], "doc_id long, text string")
    row = R.find_runs(docs).collect()[0]
    assert row.collapsed == "so good and on it goes" and row.n_words == 17
    assert [tuple(r) for r in row.runs] == [(0, 6, 1), (7, 8, 2)]


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where(F.length("text") < 3000).select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in op13_runs(spark, SMALL).collect()}
    assert len(got) == spark.read.parquet(f"{SMALL}/documents.parquet").count()
    wrong = [r.doc_id for r in docs if got[r.doc_id] != brute_row(r.doc_id, r.text)]
    assert not wrong
    assert sum(r[1] > 0 for r in got.values()) >= 5
