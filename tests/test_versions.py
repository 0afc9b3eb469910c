"""Tables in buckets: what a change writes, what readers see."""

import json

import pytest
from pyspark.sql import functions as F

from shelfspark.sources.versions import KEPT, BucketedTable
from shelfspark.streaming import counters


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


def files(folder):
    return {str(p.relative_to(folder)) for p in folder.rglob("*.parquet")}


def counts(spark, pairs):
    return spark.createDataFrame(pairs, "entity_id long, view_count long")


def test_only_touched_buckets_are_written(spark, tmp_path):
    table = BucketedTable(spark, f"file://{tmp_path}/t", ["entity_id"], 16)
    sink = counters.fold_counts(table)
    sink(counts(spark, [(i, 1) for i in range(400)]), 0)
    first = files(tmp_path / "t")
    assert len({f.split("bucket=")[1].split("/")[0] for f in first}) == 16
    sink(counts(spark, [(7, 5), (1000, 2)]), 1)
    new = files(tmp_path / "t") - first
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in new} == {table.bucket_of(7), table.bucket_of(1000)}
    assert sorted(rows(table.read())) == sorted([(i, 5 if i == 7 else 1) for i in range(400)] + [(1000, 2)])
    sink(counts(spark, [(7, 5)]), 1)  # delivered twice
    sink(counts(spark, []), 2)
    assert table.manifest()["version"] == 3 and sorted(rows(table.read()))[7] == (7, 5)


def test_a_read_of_some_buckets_opens_their_files_alone(spark, tmp_path):
    table = BucketedTable(spark, f"file://{tmp_path}/t", ["entity_id"], 16)
    table.write(counts(spark, [(i, i) for i in range(400)]))
    some = table.read([table.bucket_of(7)])
    assert len(some.inputFiles()) == 1 < len(table.read().inputFiles()) and (7, 7) in rows(some)
    assert rows(table.read([])) == []


def test_buckets_are_the_same_in_both_languages(spark, tmp_path):
    table = BucketedTable(spark, f"file://{tmp_path}/t", ["a", "b"], 64)
    keys = [("x", 1), ("é", None), (None, 3), (None, None), ("", -5)]
    got = rows(spark.createDataFrame(keys, "a string, b long").select("a", "b", table.bucket()))
    assert [r[2] for r in got] == [table.bucket_of(*r[:2]) for r in got]


def test_a_lost_writer_changes_nothing(spark, tmp_path):
    table = BucketedTable(spark, f"file://{tmp_path}/t", ["entity_id"], 4)
    assert table.read() is None
    table.write(counts(spark, [(1, 1)]))
    counts(spark, [(1, 9)]).write.parquet(f"file://{tmp_path}/t/data-lost/bucket=0")
    (tmp_path / "t" / ".manifest-000000002.json-x").write_text("{")
    assert rows(table.read()) == [(1, 1)]


def test_a_second_writer_of_a_version_fails(spark, tmp_path, monkeypatch):
    table = BucketedTable(spark, f"file://{tmp_path}/t", ["entity_id"], 4)
    table.write(counts(spark, [(1, 1)]))
    before = table.manifest()
    table.write(counts(spark, [(2, 2)]))
    monkeypatch.setattr(table, "manifest", lambda: before)
    with pytest.raises(OSError):
        table.write(counts(spark, [(3, 3)]))
    monkeypatch.undo()
    assert rows(table.read()) == [(2, 2)]


def test_batches_append_once(spark, tmp_path):
    table = BucketedTable(spark, f"file://{tmp_path}/t", ["entity_id"], 4)
    for batch in (0, 1, 1, 0, 2):
        table.write(counts(spark, [(batch, 1), (9, 1)]), append=True, writer="w", batch=batch)
    assert sorted(rows(table.read().groupBy("entity_id").agg(F.sum("view_count")))) == [(0, 1), (1, 1), (2, 1), (9, 3)]


def test_old_versions_go(spark, tmp_path):
    table = BucketedTable(spark, f"file://{tmp_path}/t", ["entity_id"], 4)
    for i in range(KEPT + 3):
        table.write(counts(spark, [(i, i)]))
    names = [p.name for p in (tmp_path / "t").iterdir() if not p.name.startswith(".")]
    assert sum(n.startswith("manifest") for n in names) == KEPT and sum(n.startswith("data") for n in names) == KEPT
    held = {f for p in (tmp_path / "t").glob("manifest-*.json") for f in sum(json.loads(p.read_text())["folders"].values(), [])}
    assert held == {n for n in names if n.startswith("data")}


def test_columns_are_held_to(spark, tmp_path):
    table = BucketedTable(spark, f"file://{tmp_path}/t", ["k"], 4, "k string, n long")
    table.write(spark.createDataFrame([(3, "x", True)], "n int, k string, more boolean"))
    assert table.read().dtypes == [("k", "string"), ("n", "bigint")] and rows(table.read()) == [("x", 3)]
    with pytest.raises(ValueError):
        BucketedTable(spark, f"file://{tmp_path}/u", ["k"]).write(spark.createDataFrame([("x", 1)], "k string, bucket int"))


def test_best_rows_in_buckets(spark, tmp_path):
    table = BucketedTable(spark, f"file://{tmp_path}/best", ["k"], 8)
    sink = counters.fold_best(table, ["k"], ["less", "id"])
    batches = [[("a", 3, 1), ("a", 2, 2), ("b", 5, 3)], [("a", 2, 1), ("c", 1, 9)], [("b", 6, 1)]]
    for i in (0, 1, 1, 2):
        sink(spark.createDataFrame(batches[i], "k string, less int, id int"), i)
    assert sorted(rows(table.read(), "k", "less", "id")) == [("a", 2, 1), ("b", 5, 3), ("c", 1, 9)]
