"""Imports in batches, refreshed lists, dumps from a record on, dates in free text, packs from the whole table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.functions.dates import fuzzy_date
from shelfspark.functions.expressions import parse_date
from shelfspark.operators import jobs, lists, sampling
from shelfspark.plans.jobs import KINDS
from shelfspark.sources import dumps
from tests.test_operators import book, catalogue

RECORD = (
    "source string, seq long, title string, language string, description string, first_sentence string, original_publication_year int, primary_cover_url string, open_library_id string, google_books_id string, "
    "series struct<name:string,position:double>, formats array<string>, isbn array<string>, publisher string, number_of_pages int, external_ids map<string,string>, authors array<struct<name:string,bio:string>>, genres array<struct<name:string>>"
)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


def record(source, seq, title, genre="novel"):
    return (source, seq, title, "en", *[None] * 12, [("Ann", None)], [(genre,)])


def test_batches_are_isolated_and_taken_up(spark, tmp_path):
    good = spark.createDataFrame([record("a", i, f"Book {i}", f"genre {i % 2}") for i in range(5)] + [record("b", 0, "Book 1", "other"), record("b", 9, "Last")], RECORD)
    broken = good.withColumn("title", F.when((F.col("source") == "a") & (F.col("seq") == 2), F.raise_error(F.lit("seq 2 is bad")).cast("string")).otherwise(F.col("title")))
    job = jobs.ImportJob(spark, f"file://{tmp_path}/job", KINDS, size=2, buckets=4)
    job.fill({"genres": spark.createDataFrame([("novel", "Old"), ("kept", "Kept")], KINDS["genres"])})
    assert job.run(broken) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 4)]
    assert rows(job.table("books"), "slug") == [("book-0",), ("book-1",), ("book-4",), ("last",)]
    assert rows(job.table("genres")) == [("genre-0", "genre 0"), ("genre-1", "genre 1"), ("kept", "Kept"), ("novel", "novel"), ("other", "other")]
    [(source, batch, n, error)] = rows(job.dead_letters())
    assert (source, batch, n) == ("a", 1, 2) and "seq 2 is bad" in error
    assert job.run(broken) == []
    versions = job.manifest()["versions"]
    assert job.retry(good) == [("a", 1)] and rows(job.dead_letters()) == []
    assert rows(job.table("books"), "slug") == [("book-0",), ("book-1",), ("book-2",), ("book-3",), ("book-4",), ("last",)]
    assert job.manifest()["versions"]["books"] > versions["books"]
    more = good.unionByName(spark.createDataFrame([record("c", 0, "New")], RECORD))
    assert job.run(more) == [("c", 0)] and ("new",) in rows(job.table("books"), "slug")


def test_a_batch_that_fails_between_two_tables_changes_nothing(spark, tmp_path, monkeypatch):
    job = jobs.ImportJob(spark, f"file://{tmp_path}/job", KINDS, size=10, buckets=4)
    first, second = (spark.createDataFrame([record(s, 0, f"Book {s}", f"genre {s}")], RECORD) for s in "ab")
    job.run(first)
    write = job.tables["books"].write
    monkeypatch.setattr(job.tables["books"], "write", lambda *a, **k: 1 / 0)
    assert job.run(second) == [("b", 0)]
    monkeypatch.setattr(job.tables["books"], "write", write)
    assert rows(job.table("genres"), "slug") == [("genre-a",)] and rows(job.dead_letters(), "error") == [("division by zero",)]
    job.run(spark.createDataFrame([record("c", 0, "Book c", "genre c")], RECORD))
    assert rows(job.table("genres"), "slug") == [("genre-a",), ("genre-c",)]  # nothing of b


def test_lists_are_refreshed_as_one_version(spark, tmp_path):
    cat = catalogue(spark, [book(1, ol_already_read_count=5), book(2, ol_already_read_count=9)], authors=[(1, "A", "a", None, 0)], links=[(1, 1), (2, 1)])
    refresh = lists.Refresh(spark, f"file://{tmp_path}/lists")
    keys = ("most_read", "most_wanted")
    assert refresh.read("most_read") is None
    assert refresh.run(cat, keys=keys)["lists"] == {"most_read": 1, "most_wanted": 1}
    later = catalogue(spark, [book(3, ol_already_read_count=7)])
    fails = {"most_wanted": lambda cat, k: 1 / 0}
    assert refresh.run(later, keys=(*keys, "classics"), builders=fails | {"classics": lambda cat, k: 1 / 0})["lists"] == {"most_read": 2, "most_wanted": 1}
    assert rows(refresh.read("most_read"), "book_id") == [(3,)] and len(rows(refresh.read("most_wanted"), "book_id")) == 2
    assert rows(refresh.status()) == sorted([("most_read", 2, 1, None), ("most_wanted", 1, 2, "division by zero"), ("classics", None, 0, "division by zero")], key=str)
    before = refresh.manifest()
    lists.build_all(cat, f"file://{tmp_path}/lists/run=3", keys=keys)  # a run that is lost before its manifest
    assert refresh.manifest() == before
    assert refresh.run(cat, keys=keys)["run"] == 3 and len(rows(refresh.read("most_read"))) == 2
    assert rows(refresh.sections(), "entity_type", "entity_id", "section_key", "similar_ids") == [("book", "1", "more_by_author", [2]), ("book", "2", "more_by_author", [1])]


@pytest.mark.parametrize("per_split", [60, 400, 10_000])
def test_records_behind_the_first(spark, tmp_path, per_split):
    """Files of a few splits: all line numbers are those of a reader who goes through the files."""
    kept, folder = [], tmp_path / "dump"
    folder.mkdir()
    for f in range(3):
        lines = []
        for i in range(40):
            kind, json = ("x" if i % 3 else "y"), f'{{"key": "{f}-{i}"}}'[: 5 if i % 7 == 0 else None]
            lines.append(f"{kind}\t{i}\t1\tt\t{json}" if i % 5 else f"{kind}\tshort")
            if i % 5 and kind == "x":
                kept.append(f"{f}-{i}" if i % 7 else None)
        (folder / f"part-{f}.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(per_split))
    try:
        for skip in (0, 1, 17, 1000):
            got = [r["key"] for r in dumps.records_after(spark, f"file://{folder}", "x", "key string", skip).collect()]
            assert sorted(got) == sorted(k for k in kept[skip:] if k)
        half = [{r["key"] for r in dumps.records_after(spark, f"file://{folder}", "x", "key string", 0, 0.5, seed).collect()} for seed in (1, 1, 2)]
        assert half[0] == half[1] != half[2] and 0 < len(half[0]) < len(kept)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


DATES = {
    "1984": "1984-01-01", "July 4, 1976": "1976-07-04", "4th of July, 1976": "1976-07-04", "Sept 1999": "1999-09-01", "Jan 8 '99": "1999-01-08", "8 Jan 49": "2049-01-08", "8 Jan 50": "1950-01-08",
    "1999-02-30": None, "2000-02-29": "2000-02-29", "13/12/1999": "1999-12-13", "12/13/1999": "1999-12-13", "1/2/99": "1999-01-02", "31.12.1999": "1999-12-31", "Mayor 1999": "1999-01-01", "in May": None, "May 8": None,
    "Saturday": None, "10:30": None, "1850-1900": "1850-01-01", "12345": None, "©1999, 2003": "1999-01-01", "Mon Jan 01 00:00:00 UTC 2001": "2001-01-01", "JAN-99": "1999-01-01", "１９９９": None, "": None, "  ": None, None: None,
}


def test_fuzzy_dates(spark):
    got = spark.createDataFrame([(t,) for t in DATES], "t string").select("t", fuzzy_date(F.col("t")).cast("string").alias("d"), parse_date(F.col("t")).cast("string").alias("p")).collect()
    assert {r["t"]: r["d"] for r in got} == DATES
    assert {r["t"]: r["p"] for r in got} == DATES


def test_permutations_have_every_place_once():
    for size in (1, 2, 3, 5, 16, 17, 1000):
        for key in (0, 7, 2**63 + 5):
            got = sampling.permuted(np.arange(size), np.full(size, size), np.full(size, key, np.uint64))
            assert sorted(got.tolist()) == list(range(size))
    one, other = (sampling.permuted(np.arange(50), np.full(50, 10**9), np.full(50, k, np.uint64)).tolist() for k in (1, 2))
    assert len(set(one)) == len(set(other)) == 50 and not set(one) & set(other)


def tier_books(sizes):
    averages = dict(zip([t.name for t in sampling.TIERS], (4.9, 4.6, 4.2, 3.5, 2.5, 1.0)))
    out = []
    for tier, n in sizes.items():
        out += [book(len(out) + i + 1, rating_count=100, avg_rating=averages[tier]) for i in range(n)]
    return out


def test_books_of_a_tier_are_numbered_without_gaps(spark):
    cat = catalogue(spark, tier_books({"rare": 40, "common": 3}))
    got = rows(sampling.numbered_tiers(sampling.in_tiers(cat), 7), "tier", "place")
    assert got == sorted([("rare", i) for i in range(40)] + [("common", i) for i in range(3)], key=str)


@pytest.mark.parametrize("sizes, length", [({"common": 50, "rare": 30, "legendary": 2}, 8), ({"common": 4, "uncommon": 3, "super_rare": 1}, 8), ({"common": 30}, 5), ({"legendary": 1, "common": 24}, 25)])
def test_packs_from_the_table(spark, sizes, length):
    """Against draws one by one, by the same rolls."""
    cat = catalogue(spark, tier_books(sizes), users=[(u, f"u{u}") for u in range(40)])
    got = {}
    for r in sampling.table_packs(cat, 7, length).collect():
        got.setdefault(r["user_id"], []).append((r["place"], r["tier"], r["book_id"]))
    tier_of = {r["book_id"]: r["tier"] for r in sampling.in_tiers(cat).collect()}
    assert len(got) == 40
    for user, pack in got.items():
        pack = sorted(pack)
        assert [p for p, *_ in pack] == list(range(length)) and len({b for *_, b in pack}) == length
        assert all(tier_of[b] == t for _, t, b in pack)
        want = []
        for i in range(length):
            rolled = sampling.roll(f"7:{user}", i)
            want.append(next(t for t in [rolled, *sampling.fallback_order(rolled)] if want.count(t) < sizes.get(t, 0)))
        if not any(t in sampling.GUARANTEED for t in want):
            order = [t.name for t in sampling.TIERS]
            lowest = max(range(length), key=lambda i: (order.index(want[i]), -i))
            want[lowest] = next((t for t in reversed(sampling.GUARANTEED) if sizes.get(t, 0)), want[lowest])
        assert [t for _, t, _ in pack] == want
    assert len({tuple(p) for p in got.values()}) > 20


def test_no_pack_without_enough_books(spark):
    cat = catalogue(spark, tier_books({"common": 7}), users=[(1, "u")])
    assert rows(sampling.table_packs(cat, 7)) == []
