"""Sections and jobs whose work must grow no faster than their input."""

import pyarrow as pa
import pytest

from shelfspark.operators import common, jobs, personal, sampling, signatures, similar
from shelfspark.plans import imports
from shelfspark.plans.jobs import KINDS
from shelfspark.sources.catalogue import catalogue as opened
from tests.oracle import SMALL
from tests.test_jobs import RECORD
from tests.test_operators import NOW, book, catalogue, rows


def series_catalogue(spark, n=60):
    """Three series with ties, gaps in positions, an unlisted book, and users who read and gave up some."""
    books = [book(i, series_id="abc"[i % 3], series_position=None if i % 7 == 0 else float(i % 5), language="de" if i == 8 else "en", ol_rating_count=600) for i in range(1, n + 1)]
    books += [book(n + 1, series_id="short", ol_rating_count=600), book(n + 2, series_id="short", ol_rating_count=600), book(n + 3)]
    shelves = [(1, 1, "read", False, NOW), (1, 2, "reading", False, NOW), (1, 5, "abandoned", False, NOW), (1, 4, "want_to_read", False, NOW), (2, n + 1, "read", False, NOW), (2, 3, "read", False, NOW), (3, 6, "abandoned", False, NOW)]
    shelves += [(4, i, "read", False, NOW) for i in range(1, n // 2)] + [(5, n + 1, "read", False, NOW), (5, n + 2, "read", False, NOW)]
    return books, shelves, catalogue(spark, books, shelves)


def in_order(books):
    return sorted(books, key=lambda b: (b["series_position"] is None, b["series_position"] or 0.0, b["book_id"]))


@pytest.mark.parametrize("k", [1, 2, 5, 20])
def test_series_in_progress_go_on_with_their_first_books(spark, k):
    books, shelves, cat = series_catalogue(spark)
    shown = {r[0] for r in personal._shown(cat).collect()}
    want = []
    for user in range(1, 6):
        gone = {s[1] for s in shelves if s[0] == user and s[2] in ("read", "reading", "abandoned")}
        reads = {s[1] for s in shelves if s[0] == user and s[2] in ("read", "reading")}
        some = [name for name in ("a", "b", "c", "short") if 0 < len({b["book_id"] for b in books if b["series_id"] == name} & reads) < sum(b["series_id"] == name for b in books)]
        left = [b for b in in_order(books) if b["series_id"] in some and b["book_id"] in shown - gone][:k]
        want += [(user, nth, b["book_id"], b["series_position"] or 0.0) for nth, b in enumerate(left, 1)]
    assert sorted(rows(personal.continue_series(cat, k))) == want


@pytest.mark.parametrize("k", [1, 3, 20])
def test_more_of_a_series_is_its_first_books_without_itself(spark, k):
    books, _, cat = series_catalogue(spark)
    shown = {r[0] for r in personal._shown(cat).collect()}
    want = []
    for b in sorted(books, key=lambda b: b["book_id"]):
        if b["series_id"] and b["book_id"] in shown:
            others = [t for t in in_order(books) if t["series_id"] == b["series_id"] and t["book_id"] in shown - {b["book_id"]}][:k]
            want += [(b["book_id"], nth, t["book_id"], t["series_position"] or 0.0) for nth, t in enumerate(others, 1)]
    assert sorted(rows(similar.more_from_series(cat, k))) == want


@pytest.fixture
def met(spark, monkeypatch):
    """Rows of the largest input of any ranking of all pairs, by what ranked() is given."""
    seen = []
    for module in (personal, similar):
        before = module.ranked
        monkeypatch.setattr(module, "ranked", lambda scored, k, *order, before=before: (seen.append(scored.count()), before(scored, k, *order))[1])
    return seen


def test_series_are_not_met_book_by_book(spark, met):
    books, shelves, _ = series_catalogue(spark, 900)
    cat = catalogue(spark, books, shelves[:7])
    personal.continue_series(cat, 5).count()
    assert met and max(met) <= 3 * 3 * 8  # three users, three series, k books and the few that are gone; 900 books before
    del met[:]
    similar.more_from_series(cat, 5).count()
    assert sum(met) == 0  # follows from the series' rankings; 300 * 300 * 3 pairs before


def test_batches_together_leave_what_one_after_the_other_does(spark, tmp_path):
    """Old rows, keys in several batches and sources, nulls that come first or last; and few imports for many batches."""
    out = []
    for source in "ab":
        for i in range(12):
            sentence, bio, name = (None if (i + len(out)) % 3 else f"It began {source}{i}"), (None if i % 2 else f"bio {source}{i}"), f"Genre{'!' * (i % 4)}"
            series = (("Saga" + "?" * (i % 3), float(i)) if i % 4 else None)
            out.append((source, i, f"Book {i % 5}{'!' * (i % 2)}", "en", None if i % 5 else f"d {source}{i}", sentence, 1900 + i, f"cover{i}", f"OL{source}{i}", None, series, ["pdf"], [f"i{i}"], None, i, {"x": str(i)} if i % 2 else None, [("Ann" + "." * (i % 3), bio)], [(name,)]))
    records = spark.createDataFrame(out, RECORD)
    tables = {}
    for how in ("together", "alone"):
        job = jobs.ImportJob(spark, f"file://{tmp_path}/{how}", KINDS, size=6, buckets=1)
        job.fill({"genres": spark.createDataFrame([("genre", "Old")], KINDS["genres"]), "authors": spark.createDataFrame([("ann", "Old Ann", None)], KINDS["authors"])})
        if how == "together":
            assert len(job.run(records)) == 4 and job.manifest()["at"] == 2  # one import; four before
        else:
            for source in "ab":
                for at in range(0, 12, 6):
                    assert len(job.run(records.where(f"source = '{source}' AND seq >= {at} AND seq < {at + 6}"))) == 1
        tables[how] = {name: sorted(map(str, job.table(name).collect())) for name in jobs.KEYS}
    assert tables["together"] == tables["alone"]
    assert all(tables["alone"].values())


def test_one_bad_batch_takes_few_imports(spark, tmp_path, monkeypatch):
    job, tried = jobs.ImportJob(spark, f"file://{tmp_path}/job", KINDS, size=1, buckets=2), []

    def apply(records, now):
        tried.append(sorted(r["seq"] for r in records.select("seq").collect()))
        if 11 in tried[-1]:
            raise ValueError("[11] is bad")
        return now["versions"]

    monkeypatch.setattr(job, "_apply", apply)
    assert len(job.run(spark.range(32).selectExpr("'a' AS source", "id AS seq"))) == 32
    assert [d[:3] for d in job.manifest()["dead"]] == [["a", 11, 1]] and job.run(spark.range(32).selectExpr("'a' AS source", "id AS seq")) == []
    assert len(tried) == 11  # 32 before
    assert sorted(sum((t for t in tried if 11 not in t), [])) == [i for i in range(32) if i != 11]


def test_more_books_at_the_top_ask_for_fewer_signatures():
    """One user, 100 genre sets that the user likes alike, in order of their best averages."""
    users = pa.table({"user_id": [1], "tastes": [[{"genre_id": "g", "raw": 1.0}]], "total": [1.0], "need": pa.array([40], pa.int32())})
    sets = {"signature": [f"g|{i:02}" for i in range(100)], "best": [5.0 - i / 25 for i in range(100)], "first": list(range(100)), "n": pa.array([20] * 100, pa.int32())}
    run = signatures._best_cell(0.6, 0.15)
    one, many = run(users, pa.table(sets)), run(users, pa.table(sets | {"ties": pa.array([20] * 100, pa.int32())}))
    assert len(one) == 40 and many.column("signature").to_pylist() == ["g|00", "g|01"]  # 2 * 20 books; 40 sets before
    assert many.column("floor")[0].as_py() <= 0.6 + 0.15 * sets["best"][1] / 5


def test_personal_tables_are_spread_by_their_rows(spark, monkeypatch):
    """Tasks of the table of similar users' reads are as many as its rows need, whatever the session's shuffle has."""
    monkeypatch.setattr(common, "TASK_ROWS", 100)
    cat = opened(spark, SMALL)
    found = personal.collaborative(cat)
    assert found.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    reads, out, want = {}, {}, {}
    for r in cat.bookshelves.collect():
        if r["status"] in ("read", "reading"):
            reads.setdefault(r["user_id"], set()).add(r["book_id"])
        if r["status"] in ("read", "reading", "abandoned"):
            out.setdefault(r["user_id"], set()).add(r["book_id"])
    for r in personal.similar_users(cat).collect():
        for b in reads.get(r["other_id"], set()) - out.get(r["user_id"], set()):
            want[r["user_id"], b] = want.get((r["user_id"], b), 0) + 1
    assert {(r["user_id"], r["book_id"]): r["readers"] for r in found.collect()} == want


def test_home_finds_similar_users_once(spark, monkeypatch):
    calls, find = [], personal.similar_users
    monkeypatch.setattr(personal, "similar_users", lambda *a: calls.append(1) or find(*a))
    personal.home(opened(spark, SMALL))
    assert len(calls) == 1


def test_genre_scores_of_chunks(spark, monkeypatch):
    """Users in several chunks; users without rows, rows without users, genres that nobody weighs."""
    monkeypatch.setattr(signatures, "SCORED_USERS", 2)
    users = spark.createDataFrame([(u, [("a", 0.5 * u), ("b", 1.0)], 0.5 * u + 1.0) for u in range(1, 8)], "user_id long, tastes array<struct<genre_id: string, raw: double>>, total double")
    rows = [(u, b, 2, 3, 4.0, s) for u in (1, 2, 3, 5, 9) for b, s in enumerate(("a", "a|b", "b|c", "c"))]
    got = signatures.genre_scores(spark.createDataFrame(rows, "user_id long, book_id long, readers long, most long, average double, signature string"), users, 7)
    weigh = lambda u, s: sum({"a": 0.5 * u, "b": 1.0}.get(g, 0.0) for g in s.split("|")) / (0.5 * u + 1.0)
    assert sorted(map(tuple, got.collect())) == sorted((u, b, n, m, a, weigh(u, s)) for u, b, n, m, a, s in rows if u < 8 and weigh(u, s) > 0)


def test_packs_are_drawn_in_many_tasks(spark, monkeypatch):
    """A table of users is a small file, and their draws are not one task's work."""
    monkeypatch.setattr(sampling, "TASK_USERS", 10)
    cat = opened(spark, SMALL)
    assert sampling.packs(cat, 42).rdd.getNumPartitions() == -(-cat.users.count() // 10) > 4
    assert sampling._dealt_users(cat).count() == cat.users.count()


def test_lines_are_parsed_once_and_by_several_tasks(spark, monkeypatch):
    """A file of few bytes and many rows isn't one task's; editions aren't parsed once for the best and once for ISBNs."""
    cat = opened(spark, SMALL)
    monkeypatch.setattr(common, "LINE_ROWS", 50)
    assert imports.work_lines(cat).rdd.getNumPartitions() == -(-cat.table("part").count() // 50) > 1
    assert imports.author_lines(cat).rdd.getNumPartitions() == max(1, -(-cat.table("supplier").count() // 50))
    plan = imports.imported_editions(cat)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2  # editions and works, each once


def test_lines_and_orders_meet_once_for_books_and_shelves(spark):
    """q21_other_facets: books, ratings and shelves come from one join of lines and orders, and one pass sums them by book."""
    from shelfspark.plans import queries
    from shelfspark.sources.catalogue import catalogue, release
    from tests.oracle import SMALL

    release(spark, SMALL)
    cat = catalogue(spark, SMALL)
    queries.QUERIES["q21_other_facets"](spark, SMALL)
    assert cat.purchases.storageLevel.useMemory and cat.book_sums.storageLevel.useMemory


def test_dimension_lists_share_one_pass(spark):
    """l21_refresh: the sums of all dimensions and the readers of all books are made once for all lists."""
    from shelfspark.operators import lists
    from shelfspark.sources.catalogue import catalogue
    from tests.oracle import SMALL

    cat = catalogue(spark, SMALL)
    assert lists.dimension_sums(cat) is lists.dimension_sums(cat) and cat.app_readers.storageLevel.useDisk


def test_postings_are_counted_in_their_rows(spark):
    """q05_bm25: a text's words are counted where it is read; no table of all words and documents is shuffled or held."""
    from shelfspark.operators.index import plain_postings

    rows = [("f", "1", "b a b c A b"), ("f", "2", None), ("g", "1", ""), ("g", "3", "x"), ("f", "4", "z z z")]
    found = plain_postings(spark.createDataFrame(rows, "field string, doc string, text string"))
    want = {("a", "f", "1", 6, 2), ("b", "f", "1", 6, 3), ("c", "f", "1", 6, 1), ("x", "g", "3", 1, 1), ("z", "f", "4", 3, 3)}
    assert sorted(map(tuple, found.select("term", "field", "doc", "length", "tf").collect())) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
