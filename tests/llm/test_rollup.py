import pytest

from shelfspark.llm import rollup
from shelfspark.llm.queries import ORACLE_SQL, op5_token_rollup, op5b_rollup_without_vocabulary
from tests.oracle import SMALL, assert_same, connection


def changes(spark, *rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], f"{rollup.CHANGES}, batch string")


def totals(r):
    return sorted((tuple(x) for x in r.totals().collect()), key=str)


def test_query_matches_sql(spark):
    want = connection().execute(ORACLE_SQL["op5b_rollup_without_vocabulary"]).df()
    assert_same(op5b_rollup_without_vocabulary(spark, SMALL), want)
    assert_same(op5_token_rollup(spark, SMALL).where("tokenizer <> 'byte_bpe_50k'"), want)


def test_vocabulary_rows_against_brute_force(spark):
    from tests.llm.test_packing import slow_ids

    bad = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 0").collect()}
    want = {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        if r["doc_id"] not in bad:
            n, tokens = want.get((r["source"], r["lang"]), (0, 0))
            want[r["source"], r["lang"]] = n + 1, tokens + len(slow_ids(" ".join(w for w in (r["text"] or "").encode().decode().translate(dict.fromkeys((9, 10, 11, 12, 13), " ")).split(" ") if w)))
    got = {(r["source"], r["lang"]): (r["documents"], r["tokens"]) for r in op5_token_rollup(spark, SMALL).where("tokenizer = 'byte_bpe_50k'").collect()}
    assert got == want


def test_both_counts_of_awkward_rows(edge_docs, no_docs):
    from pyspark.sql import functions as F

    both = rollup.counted_twice(edge_docs, F.concat("text", F.lit(" end")))
    old = sorted((str(tuple(r)) for r in rollup.counted(edge_docs).unionByName(rollup.bpe_counted(edge_docs)).collect()))
    assert sorted(str((r["doc_id"], r["source"], r["lang"], r["tokenizer"], r["old_tokens"])) for r in both.collect()) == old
    assert all(r["tokens"] >= r["old_tokens"] for r in both.collect()) and rollup.counted_twice(no_docs, F.col("text")).count() == 0


def test_batches_count_once(spark, tmp_path):
    r = rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    assert totals(r) == []
    first = changes(spark, ("insert", "a", "en", "t", 10, None), ("insert", "a", "en", "t", 5, None), ("insert", None, None, "t", None, None), ("insert", "b", "en", "t", 1, None))
    assert r.commit("one", first) and not r.commit("one", first) and not r.commit("one", changes(spark))
    assert totals(r) == sorted([("a", "en", "t", 2, 15), (None, None, "t", 1, 0), ("b", "en", "t", 1, 1)], key=str)
    assert r.commit("two", changes(spark, ("revise", "a", "en", "t", 7, 10), ("delete", "b", "en", "t", 1, None)))
    assert totals(r) == sorted([("a", "en", "t", 2, 12), (None, None, "t", 1, 0)], key=str)
    assert r.commit("empty", changes(spark)) and len(totals(r)) == 2
    assert rollup.TokenRollup(spark, f"file://{tmp_path}/r").committed("two")


def test_a_batch_that_failed_leaves_nothing(spark, tmp_path):
    r = rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    with pytest.raises(Exception, match="unknown kind"):
        r.commit("bad", changes(spark, ("upsert", "a", "en", "t", 1, None)))
    assert not r.committed("bad") and totals(r) == []
    assert r.commit("bad", changes(spark, ("insert", "a", "en", "t", 1, None)))
    with pytest.raises(ValueError):
        r.commit("../x", changes(spark))


def test_compaction_changes_nothing(spark, tmp_path):
    r = rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    r.commit("one", changes(spark, ("insert", "a", "en", "t", 10, None), ("insert", "b", "en", "t", 4, None)))
    r.commit("two", changes(spark, ("delete", "b", "en", "t", 4, None)))
    before = totals(r)
    r.compact()
    assert totals(r) == before == [("a", "en", "t", 1, 10)]
    assert not r.commit("one", changes(spark, ("insert", "a", "en", "t", 10, None))) and totals(r) == before
    r.commit("three", changes(spark, ("insert", "a", "en", "t", 1, None)))
    r.compact()
    assert totals(r) == [("a", "en", "t", 2, 11)] == totals(rollup.TokenRollup(spark, f"file://{tmp_path}/r"))


def test_vocabulary_tokens(edge_docs, no_docs):
    from tests.llm.test_packing import slow_ids

    got = sorted((str(r["doc_id"]), r["tokens"]) for r in rollup.bpe_counted(edge_docs).collect())
    assert got == sorted((str(d["doc_id"]), len(slow_ids(d["text"] or ""))) for d in edge_docs.collect())
    assert rollup.bpe_counted(no_docs).count() == 0


@pytest.mark.parametrize("documents, labels", [(1, 0), (0, 1), (0, 0), (1, 2)])
def test_query_plan_on_awkward_tables(spark, edge_docs, no_docs, tmp_path, documents, labels):
    """Empty tables, null ids, clashing columns, all documents deleted."""
    (edge_docs if documents else no_docs).withColumn("tokens", rollup.F.lit(5)).withColumn("tokenizer", rollup.F.lit("x")).withColumn("kind", rollup.F.lit("y")).withColumn("tidy", rollup.F.lit("z")).write.parquet(f"file://{tmp_path}/documents.parquet")
    rows = [[], [(1, 0, 0), (None, 0, 0), (5, None, None)], [(i, 0, 0) for i in range(1, 10)]][labels]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    got = sorted(((r["source"], r["tokenizer"], r["documents"]) for r in op5_token_rollup(spark, f"file://{tmp_path}").collect()), key=str)
    left = [d for d in edge_docs.collect() if documents and d["doc_id"] not in {r[0] for r in rows if r[1] == 0 and r[0] is not None}]
    want = {(d["source"], t): 0 for d in left for t in (*rollup.COUNTERS, rollup.BPE)}
    for d in left:
        for t in rollup.COUNTERS:
            want[d["source"], t] += 1
    assert got == sorted(((s, t, n) for (s, t), n in want.items()), key=str)


def test_edges(edge_docs, no_docs):
    rows = rollup.counted(edge_docs).collect()
    assert len(rows) == 24
    assert {(r["tokenizer"], r["tokens"]) for r in rows if r["doc_id"] in (2, 3)} == {("words-1", 0), ("bytes-1", 0)}
    assert {(r["tokenizer"], r["tokens"]) for r in rows if r["doc_id"] == 5} == {("words-1", 60_000), ("bytes-1", len(__import__("tests.llm.conftest", fromlist=["LONG"]).LONG))}
    assert rollup.counted(no_docs).count() == 0
