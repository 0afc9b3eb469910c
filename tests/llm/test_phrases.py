import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfspark.llm import phrases as P
from shelfspark.llm.queries import ORACLE_SQL, op11_phrases
from tests.oracle import SMALL, assert_same, connection

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows, longest):
    f = Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(FOLD)):
            words = re.findall("[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang or "und" if lang is None else lang, tuple(words[i : i + m])] += 1
    return f


def brute(rows, least, longest=5, percent=100, limit=None):
    f = brute_counts(rows, longest)
    n, found = Counter(), {}
    for (lang, p), a in f.items():
        n[lang] += a * (len(p) == 1)
    for (lang, p), a in f.items():
        if len(p) > 1 and a >= least:
            found[lang, p] = (a, *min(((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]])), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))))
    gone = {(lang, p[i:j]) for (lang, p), (a, *_) in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * a >= percent * f[lang, p[i:j]]}
    out = [(lang, " ".join(p), a, left, right, n[lang], score) for (lang, p), (a, score, _, left, right) in found.items() if (lang, p) not in gone]
    ranked = []
    for lang in {r[0] for r in out}:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(lang, k, *r[1:]) for k, r in enumerate(mine[:limit], 1)]
    return sorted(ranked)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=12), min_size=1, max_size=8), st.integers(1, 3), st.integers(0, 3))
def test_intervals_count_every_phrase(pieces, least, more):
    longest = least + more
    ids = np.array([w for p in pieces for w in [*p, 0]], np.int32)
    want = Counter(tuple(p[i : i + m]) for p in pieces for m in range(least, longest + 1) for i in range(len(p) - m + 1))
    got = {tuple(ids[at : at + n].tolist()): times for n, places, counts in P.intervals(ids, least, longest) for at, times in zip(places.tolist(), counts.tolist())}
    assert got == want


def test_chains():
    ids, joined = np.array([1, 2, 3, 0, 4, 0, 5, 6], np.int32), np.array([True, True, False, False, False, False, True, False])
    assert P.chains(ids, joined, 2).tolist() == [1, 2, 3, 0, 5, 6, 0]
    assert P.chains(ids, joined, 3).tolist() == [1, 2, 3, 0]
    assert P.chains(ids, joined, 4).tolist() == []


TEXTS = [
    ("en", "New York City is big. New York City, NEW YORK city! york new"),
    ("en", "a a a a a a a; a a"),
    ("en", "the cat sat\ton the mat\nthe cat sat on the dog\x0bthe cat"),
    ("en", "the cat sat on the mat"),
    ("de", "der Ärger der Ärger der ärger"),
    (None, "the cat the cat"),
    ("und", "the cat"),
    ("", "the cat the cat"),
    ("fr", None),
    ("fr", ""),
    ("fr", " ., \t"),
    ("fr", "mot"),
]


@pytest.mark.parametrize("least,longest,percent,shard", [(1, 5, 100, 1 << 20), (2, 5, 100, 7), (2, 3, 60, 1), (3, 2, 100, 30)])
def test_small_texts(spark, least, longest, percent, shard):
    docs = spark.createDataFrame([(*r, "junk", 1) for r in TEXTS], "lang string, text string, phrase string, f int").repartition(3)
    got = P.best_of_each(P.collocations(docs, least, longest, percent, shard_words=shard, most_bits=10), 10_000)
    assert rows_of(got) == brute(TEXTS, least, longest, percent)


def test_limit_and_ties(spark):
    docs = spark.createDataFrame(TEXTS, "lang string, text string")
    assert rows_of(P.best_of_each(P.collocations(docs, 1), 3)) == brute(TEXTS, 1, limit=3)


def test_no_rows(spark, no_docs):
    assert rows_of(P.best_of_each(P.collocations(no_docs))) == []


def test_awkward_rows(spark, edge_docs):
    rows = [(r.lang, r.text) for r in edge_docs.collect()]
    assert rows_of(P.best_of_each(P.collocations(edge_docs, 60), 50)) == brute(rows, 60, limit=50)


def test_products_beyond_64_bits(spark):
    score = spark.sql("SELECT (1000BD * CAST(9000000000000000 AS DECIMAL(16, 0)) * CAST(9000000000000001 AS DECIMAL(16, 0))) div (CAST(9000000000000000 AS DECIMAL(16, 0)) * CAST(9007199254740993 AS DECIMAL(16, 0))) AS s").first().s
    assert score == 1000 * 9000000000000000 * 9000000000000001 // (9000000000000000 * 9007199254740993)


def test_query_against_sql_and_brute_force(spark):
    got = op11_phrases(spark, SMALL)
    assert_same(got, connection().execute(ORACLE_SQL["op11_phrases"]).df())
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("lang", "text").collect()]
    assert rows_of(got) == brute(rows, 100, limit=2000) and got.count() > 20
