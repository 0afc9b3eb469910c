import math

import numpy as np
import pytest

from shelfspark.llm import topk
from shelfspark.llm.queries import ORACLE_SQL, op4_topk
from tests.oracle import SMALL, assert_same, connection


def brute(rows, k=5):
    """rows (vec_id, embedding)."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, v) in enumerate(kept):
        if q is None or q % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), math.inf if i is None else i, n) for n, (i, w) in enumerate(kept) if n != at)
        out += [(q, r, None if i == math.inf else i, -s) for r, (s, i, _) in enumerate(scored[:k], 1)]
    return out


def key(row):
    return tuple((x is None, x) for x in row)


def test_query_matches_sql(spark):
    assert_same(op4_topk(spark, SMALL), connection().execute(ORACLE_SQL["op4_topk"]).df())


@pytest.mark.parametrize("block", [3, 64])
def test_nulls_ties_repeats_and_clashing_columns(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(400, 520)]  # ties
    rows += [(50, rows[50][1]), (50, rows[50][1]), (None, [9.0] * 6), (1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1050, [float("nan")] * 6), (1100, [float("inf")] * 6), (1150, []), (1200, [1.0, 2.0])]
    path = f"file://{tmp_path}/v"
    spark.createDataFrame([(i, v, "x", "y", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, block string, rank int").write.parquet(path)
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted((tuple(r) for r in topk.top_k(spark.read.parquet(path), block=block).collect()), key=key)
    assert got == sorted(brute(rows), key=key)


def test_few_rows_and_none(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(make([(0, [1.0]), (7, [2.0])])).collect()] == [(0, 1, 7, 256 * 512)]
    assert topk.top_k(make([(0, [1.0])])).count() == 0 and topk.top_k(make([])).count() == 0


def test_large_values_are_exact():
    a, b = np.array([[1 << 30, 3]]), np.array([[1 << 30, 5], [7, 11]])
    assert topk.products(a, b).tolist() == [[(1 << 60) + 15, 7 * (1 << 30) + 33]]


def test_blocks_below_the_kth_score_are_skipped():
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(20, 16)) * 100
    blocks = [(np.arange(64) + 64 * b, np.arange(64) + 64 * b, (middles[b] + rng.normal(size=(64, 16)) * 5).astype(np.int64)) for b in range(20)]
    queries = np.concatenate([v[:2] for _, _, v in blocks])
    rows = np.concatenate([r[:2] for r, _, _ in blocks])
    best, scored = topk.search(queries, rows, blocks, 5, np.full(len(queries), topk.LOW + 1))
    assert scored < 0.6 * len(queries) * len(blocks)
    everything = np.concatenate([v for _, _, v in blocks])
    for q in range(len(queries)):
        s = everything @ queries[q]
        s[rows[q]] = topk.LOW + 1
        order = np.lexsort((np.arange(len(s)), -s))[:5]
        assert best.vec[best.q == q].tolist() == order.tolist()


@pytest.mark.parametrize("pile, chunk", [(1, 7), (3, 2048)])
def test_many_piles_and_chunks_against_brute_force(spark, tmp_path, monkeypatch, pile, chunk):
    monkeypatch.setattr(topk, "CHUNK", chunk)
    monkeypatch.setattr(topk, "MAX_PILES", 40)
    rng = np.random.default_rng(pile)
    rows = [(i, [float(x) for x in rng.normal(size=5) + 6 * (i % 7)]) for i in range(600)] + [(i, [1.0] * 5) for i in range(600, 700)]
    path = f"file://{tmp_path}/v"
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(path)
    got = sorted((tuple(r) for r in topk.top_k(spark.read.parquet(path), "vec_id % 50 = 0", block=8, pile=pile).collect()), key=key)
    assert got == sorted(brute(rows), key=key)


def test_queries_go_to_piles_that_can_reach_their_floor():
    """Of piles apart from each other nearly none besides the first is asked; of equal bounds only those whose ids could win."""
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(50, 12)) * 200
    members = [(m + rng.normal(size=(100, 12)) * 5).astype(np.int64) for m in middles]
    piles = topk.Piles(np.arange(50) * 100, np.stack([v.max(axis=0) for v in members]), np.stack([v.min(axis=0) for v in members]))
    queries = np.concatenate([v[:3] for v in members])
    first = np.argmax(piles.bounds(queries), axis=1)
    floors = np.array([np.sort(members[p] @ q)[-5] for p, q in zip(first, queries)])
    batch = topk.pa.RecordBatch.from_arrays([topk.pa.array(range(len(queries))), topk.pa.array(range(len(queries))), topk.pa.array(queries.tolist()), topk.pa.array(floors), topk.pa.array([topk.BLANK] * len(queries))], names=["row_id", "vec_id", "v", "floor", "worst_id"])
    sent = [(r["row_id"], r["pile"]) for out in topk.other_piles(piles)(iter([batch])) for r in out.to_pylist()]
    assert len(sent) < 0.05 * len(queries) * 50
    for q in range(len(queries)):
        needed = {p for p in range(50) if p != first[q] and (members[p] @ queries[q]).max() >= floors[q]}
        assert needed <= {p for i, p in sent if i == q}
    same = topk.Piles(np.array([10, 20, 30]), np.array([[5], [5], [5]]), np.array([[5], [5], [5]]))
    asked = topk.pa.RecordBatch.from_arrays([topk.pa.array([0]), topk.pa.array([0]), topk.pa.array([[1]]), topk.pa.array([5]), topk.pa.array([20])], names=["row_id", "vec_id", "v", "floor", "worst_id"])
    assert [r["pile"] for out in topk.other_piles(same)(iter([asked])) for r in out.to_pylist()] == [1]


def test_scores_beyond_64_bits_fail():
    big = np.array([[1 << 40, 1 << 30]], np.int64)
    assert topk.products(big, big >> 20).tolist() == [[(1 << 60) + (1 << 40)]]
    with pytest.raises(OverflowError):
        topk.products(big, big)
