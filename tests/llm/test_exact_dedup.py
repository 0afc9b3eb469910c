import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfspark.llm import exact_dedup
from shelfspark.llm.queries import ORACLE_SQL, op8_exact_dedup
from tests.oracle import SMALL, assert_same, connection

P = exact_dedup.PRIME


def normal(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_query_matches_sql(spark):
    assert_same(op8_exact_dedup(spark, SMALL), connection().execute(ORACLE_SQL["op8_exact_dedup"]).df())


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=9000), st.integers(0, 9000))
def test_hashes_compose(data, cut):
    a, b = data[:cut], data[cut:]
    for base in exact_dedup.BASES:
        whole = 0
        for byte in data:
            whole = (whole * base + byte) % P
        h = exact_dedup.chunk_hash
        assert h(data, base) == whole == (h(a, base) * pow(base, len(b), P) + h(b, base)) % P


@pytest.mark.parametrize("chunk, prime", [(3, P), (7, 5), (1 << 18, 2)])
def test_equal_fingerprints_are_compared(spark, tmp_path, chunk, prime):
    """With few residues nearly all texts of one length have one fingerprint, and still only equal texts are joined."""
    texts = [f"text {i % 23:02d}" for i in range(120)] + ["TEXT 05", "", None, "é", "É"]
    path = f"file://{tmp_path}/d"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    got = exact_dedup.mark_exact_duplicates(spark.read.parquet(path), chunk, prime).collect()
    groups, last = Counter(map(normal, texts)), {normal(t): i for i, t in enumerate(texts)}
    want = {i: (last[normal(t)], groups[normal(t)], last[normal(t)] == i, hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in enumerate(texts)}
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(texts)


def test_a_third_of_rows_are_copies(spark, tmp_path):
    path = f"file://{tmp_path}/hot"
    spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text")).write.parquet(path)
    found = exact_dedup.mark_exact_duplicates(spark.read.parquet(path))
    assert found.where("kept").count() == 4001 and found.where("group_size = 2000 and keep_id = 5997").count() == 2000


def test_edges(edge_docs, no_docs):
    from tests.llm.conftest import ROWS

    rows = exact_dedup.mark_exact_duplicates(edge_docs, chunk=1000).collect()
    groups = Counter(normal(t) for _, t in ROWS)
    assert len(rows) == 12 and sum(r["kept"] for r in rows) == len(groups)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by[1]["keep_id"] == 6 and by[1]["group_size"] == 3 and by[2]["keep_id"] == 3 and by[2]["group_size"] == 3
    assert {r["keep_id"] for r in rows if r["doc_id"] is None} == {None, 3}
    kept = exact_dedup.drop_exact_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns and Counter(normal(r["text"]) for r in kept.collect()) == Counter(groups.keys())
    assert exact_dedup.mark_exact_duplicates(no_docs).count() == 0 and exact_dedup.drop_exact_duplicates(no_docs).count() == 0
