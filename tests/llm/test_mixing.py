from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shelfspark.llm import mixing
from shelfspark.llm.queries import ORACLE_SQL, op6_mixing
from tests.oracle import SMALL, assert_same, connection


def reshared(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Targets by sharing, cutting and sharing again."""
    weight = {s: weights[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, full, target = share * sum(sizes.values()), set(), {}
    while True:
        left = total - sum(most * sizes[s] for s in full)
        open_ = [s for s in sizes if s not in full]
        target = {s: most * sizes[s] for s in full} | {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        above = {s for s in open_ if target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def test_query_matches_sql(spark):
    assert_same(op6_mixing(spark, SMALL), connection().execute(ORACLE_SQL["op6_mixing"]).df())


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.one_of(st.none(), st.text("abcé", min_size=1, max_size=3)), st.integers(0, 10_000), min_size=1, max_size=12))
def test_targets_are_those_of_repeated_sharing(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    assert got == pytest.approx(reshared(sizes))


def test_takes_are_near_targets_and_repeatable(spark):
    df = spark.range(30_000).selectExpr("id AS doc_id", "concat('s', cast(if(id % 3 = 0, 0, id % 7) as string)) AS source", "20 + id % 60 AS size")
    rows = mixing.mix_rates(df).collect()
    assert rows == mixing.mix_rates(df).collect() or sorted(rows) == sorted(mixing.mix_rates(df).collect())
    taken, target = Counter(), {}
    for r in rows:
        taken[r["source"]] += r["size"] * r["copies"]
        target[r["source"]] = r["target"]
        assert r["copies"] in (0, 1, 2)
    assert all(abs(taken[s] / target[s] - 1) < 0.05 for s in target)


def test_repeated_rows_follow_the_copies(edge_docs, no_docs):
    mixed = mixing.mix_documents(edge_docs).collect()
    assert len(mixed) == 12 and {r["size"] for r in mixed if r["doc_id"] in (2, 3, 4)} == {0}
    want = Counter()
    for r in mixed:
        want[r["doc_id"]] += r["copies"]
    out = mixing.repeat_documents(edge_docs)
    assert out.columns == edge_docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) == +want
    assert mixing.mix_documents(no_docs).count() == 0 and mixing.repeat_documents(no_docs).count() == 0
