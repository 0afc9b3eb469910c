import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfspark.llm import sharding
from shelfspark.llm.queries import op1_sharding
from tests.oracle import SMALL


def gapless(rows):
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    return all(sorted(s) == list(range(len(s))) for s in by.values())


def test_query(spark):
    rows = op1_sharding(spark, SMALL).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()}
    loads = Counter(r["shard"] for r in rows)
    assert set(loads) == set(range(8)) and max(loads.values()) - min(loads.values()) <= 1
    assert gapless(rows) and {r["law"] for r in rows} == {"rows"}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=24, max_size=24), st.sampled_from([1.0, 1.1, 1.5]))
def test_offers_follow_the_ring_row_by_row(counts, factor):
    """Against rows that are offered one at a time."""
    points = sharding.ring(3, 8)
    room = sharding.capacities(sum(counts), 3, factor)
    left, want = list(room), []
    rows = [(a, i) for a, n in enumerate(counts) for i in range(n)]
    for step in range(len(points)):
        for arc, i in list(rows):
            shard = points[(arc + step) % len(points)][1]
            if left[shard]:
                left[shard] -= 1
                want.append((arc, i, shard))
                rows.remove((arc, i))
    got = [(s.arc, i, s.shard) for s in sharding.offer(counts, points, room) for i in range(s.lo, s.hi)]
    assert sorted(got) == sorted(want)


def test_too_little_room_fails():
    with pytest.raises(ValueError):
        sharding.offer([5] * 16, sharding.ring(2, 8), [3, 3])


def test_arcs(spark):
    points = sharding.ring(4, 16)
    marks = [p for p, _ in points]
    probes = [-(1 << 63), (1 << 63) - 1, 0, *marks, *[m + 1 for m in marks if m < (1 << 63) - 1]]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in probes], "p long").select(sharding.arc_of(F.col("p"), points)).collect()]
    assert got == [next((i for i, m in enumerate(marks) if m >= p), 0) for p in probes]


def test_loose_bounds_move_few_rows(spark):
    """With a quarter of room, a ninth shard takes about a ninth of the rows and few others move."""
    keyed = spark.range(20_000).select("id", F.col("id").alias("row_id"), F.xxhash64("id").alias("position"))
    before, after = ({r["id"]: r["shard"] for r in sharding.assign(keyed, n, 1.25).collect()} for n in (8, 9))
    assert max(Counter(before.values()).values()) <= 20_000 * 1.25 / 8 + 1
    assert sum(before[i] != after[i] for i in before) < 0.3 * len(before)


def test_one_id_in_a_third_of_rows(spark, tmp_path):
    path = f"file://{tmp_path}/hot"
    spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text")).write.parquet(path)
    rows = sharding.shard_documents(spark.read.parquet(path)).collect()
    assert len(rows) == 3000 and gapless(rows) and set(Counter(r["shard"] for r in rows).values()) == {375}


def test_edges(edge_docs, no_docs):
    rows = sharding.shard_documents(edge_docs, 3).collect()
    assert len(rows) == 12 and gapless(rows) and set(Counter(r["shard"] for r in rows).values()) == {4}
    assert {r["size"] for r in rows if r["doc_id"] in (2, 3)} == {1}
    assert sharding.shard_documents(no_docs).count() == 0
