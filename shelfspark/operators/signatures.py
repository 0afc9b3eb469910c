"""Books by their sets of genres, and ranked prefixes.

Books of one genre set are one signature. What depends on genres alone is found for signatures, which are far fewer than
books; the books of a signature are ranked once, and only as many of them are fetched as an answer can hold.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.operators import chunks as C
from shelfspark.sources.catalogue import Catalogue

#: Ranked rows that are fetched together.
PACK = 16
#: Users and signatures that meet in one cell, about.
USERS, SIGNATURES = 1024, 8192
#: Places of a ranking between two of which its value is known before its rows are fetched.
STEP = 4


def signed(cat: Catalogue) -> DataFrame:
    """(book_id, signature): each book's sorted genres, joined."""
    return cat.book_genres.groupBy("book_id").agg(F.array_join(F.array_sort(F.collect_set("genre_id")), "|").alias("signature"))


def genres_of(signature: Column) -> Column:
    return F.split(signature, r"\|")


def signature_pairs(left: DataFrame, right: DataFrame, least: int = 2) -> DataFrame:
    """(source_signature, target_signature, shared, score) of distinct signatures with `least` genres in common; score is
    the Jaccard similarity."""
    genre = lambda df, name: df.select(F.col("signature").alias(name)).distinct().withColumn("all", genres_of(F.col(name)))
    a = genre(left, "source_signature").withColumn("n", F.size("all")).select("source_signature", "n", F.explode("all").alias("genre"))
    b = genre(right, "target_signature").withColumn("m", F.size("all")).select("target_signature", "m", F.explode("all").alias("genre"))
    shared = a.join(b, "genre").groupBy("source_signature", "target_signature", "n", "m").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    return shared.select("source_signature", "target_signature", "shared", (F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("score"))


def numbered(rows: DataFrame, key: str, deepest: int, *order: Column) -> DataFrame:
    """The first `deepest` rows of each key with their place nth. The bound is a constant, so rows beyond it go before
    the shuffle, and a key with a third of all rows brings each task that many at most."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("nth", nth).where(F.col("nth") <= deepest)


def first_of(asked: DataFrame, ranked: DataFrame, key: str, need: str = "need") -> DataFrame:
    """Rows of ranked (key, nth, ...) up to the place that each row of asked (key, need, ...) names. They are joined by
    packs of PACK places, so nothing beyond the last pack is met, however many rows a key has."""
    wanted = asked.where(F.col(need) > 0).withColumn("pack", F.explode(F.sequence(F.lit(0), F.floor((F.col(need) - 1) / PACK).cast("int"))))
    placed = ranked.withColumn("pack", F.floor((F.col("nth") - 1) / PACK).cast("int"))
    return wanted.join(placed, [key, "pack"]).where(F.col("nth") <= F.col(need)).drop("pack")


def narrowed(asked: DataFrame, ranked: DataFrame, key: str, value: str, least: Column) -> DataFrame:
    """asked (key, need, ...) with `need` lowered to the places of its key's ranking whose value can be `least` or more.
    Rankings fall by value; each is known here by its value at every STEP-th place."""
    steps = ranked.where((F.col("nth") - 1) % STEP == 0).groupBy(key).agg(F.sort_array(F.collect_list(value), asc=False).alias("__steps"))
    some = asked.withColumn("__least", least).join(steps, key)
    held = F.size(F.filter("__steps", lambda v: v >= F.col("__least"))) * STEP
    return some.withColumn("need", F.least("need", held)).drop("__steps", "__least")


def before(value: str, rows: str, key: str) -> Column:
    """Sum of `rows` over the rows of the key with a higher value."""
    upto = Window.partitionBy(key).orderBy(F.desc(value)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum(rows).over(upto) - F.sum(rows).over(Window.partitionBy(key, value))


FOUND = "user_id long, signature string, genre_score double, need int, floor double"


def _weighed(users: pa.Table) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """By genre the places of the users who weigh it, and their sums."""
    _, sizes, flat = C._lists(users.column("tastes"))
    codes, genres = C._coded(flat.field("genre_id"))
    order, ends = np.argsort(codes, kind="stable"), np.cumsum(np.bincount(codes, minlength=len(genres)))[:-1]
    rows, raws = np.repeat(np.arange(len(users)), sizes)[order], flat.field("raw").to_numpy(zero_copy_only=False)[order]
    return dict(zip(genres.to_pylist(), zip(np.split(rows, ends), np.split(raws, ends))))


def _sums(users: pa.Table, names: list[str]) -> np.ndarray:
    """What each user's tastes add up to over the genres of each signature: sums of halves, exact in any order."""
    weighed, holding = _weighed(users), {}
    for column, name in enumerate(names):
        for genre in name.split("|"):
            holding.setdefault(genre, []).append(column)
    both = sorted(weighed.keys() & holding.keys())
    if len(both) <= SCORED_USERS:
        tastes, held = np.zeros((len(users), len(both))), np.zeros((len(both), len(names)))
        for at, genre in enumerate(both):
            tastes[weighed[genre][0], at], held[at, holding[genre]] = weighed[genre][1], 1
        return tastes @ held
    sums = np.zeros((len(users), len(names)))
    for genre in both:
        rows, raws = weighed[genre]
        sums[np.ix_(rows, holding[genre])] += raws[:, None]
    return sums


def _best(left: pa.Table, right: pa.Table, weight: float, average_weight: float) -> tuple[np.ndarray, ...]:
    """Places of users and of signatures, genre scores, needs and floors; see best_signatures."""
    out: tuple[list, ...] = ([np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)], [np.empty(0, np.int32)], [np.empty(0)])
    names = right.column("signature").to_pylist()
    sums = _sums(left, names)
    scores = sums / left.column("total").to_numpy()[:, None] if len(left) else sums
    best, first, n = (right.column(c).to_numpy() for c in ("best", "first", "n"))
    ties = right.column("ties").to_numpy() if "ties" in right.column_names else np.ones(len(names), np.int64)
    bound = np.where(sums > 0, np.floor((scores * weight + best / 5.0 * average_weight) * 1e6 + 0.5), -1.0)
    for row, need in enumerate(left.column("need").to_pylist()):
        # Each signature has a best book, so none below the `need` best ones by more than a rounding counts.
        lowest = np.partition(bound[row], -need - 1)[-need - 1] - 1 if 0 <= need < len(names) else 0.0
        some = np.flatnonzero(bound[row] >= max(lowest, 0.0))
        some = some[np.lexsort((first[some], -bound[row, some]))]
        bounds, upto = bound[row, some], np.cumsum(ties[some])
        enough = int(np.searchsorted(upto, need))  # the best books of the signatures up to here are `need` or more
        least = bounds[enough] if enough < len(some) else -1.0
        # Ahead of a signature's first book are all best books of those above it, and the first ones of its equals; a
        # few more against roundings at the edge.
        above = np.searchsorted(-bounds, -(bounds + 2), side="right")
        ahead = np.where(above > 0, upto[np.maximum(above, 1) - 1], 0) + np.arange(len(some)) - above
        some = some[(bounds >= least - 1) & (ahead < need + 16)]
        for column, values in zip(out, (np.full(len(some), row), some, scores[row, some], np.minimum(need, n[some]).astype(np.int32), np.full(len(some), (least - 2) / 1e6))):
            column.append(values)
    return tuple(map(np.concatenate, out))


def _best_cell(weight: float, average_weight: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: users (user_id, tastes, total, need); right: signatures (signature, best, first, n, maybe ties)."""
        row, column, score, need, floor = _best(left, right, weight, average_weight)
        return pa.table({"user_id": left.column("user_id").take(pa.array(row)), "signature": right.column("signature").take(pa.array(column)), "genre_score": score, "need": need, "floor": floor})

    return run


def best_signatures(users: DataFrame, signatures: DataFrame, n_users: int, n_signatures: int, weight: float, average_weight: float) -> DataFrame:
    """(FOUND): for each user the signatures that can hold one of the user's best `need` books by weight * genre_score +
    average_weight * average / 5, how many books of each to look at, and a bound that the best `need` books reach.

    users: (user_id, tastes: [(genre_id, raw)], total, need); signatures: (signature, best average, its first book, number
    of books, number of those with the best average, 1 if it isn't given). Chunks of users meet piles of signatures, so neither side is ever
    whole in one place. A signature ranks by its best books; it can hold one of the best `need` books only if fewer than
    that are in those ahead, so the more books a signature has, the fewer signatures a user needs."""
    chunks, piles = max(1, -(-n_users // USERS)), max(1, -(-n_signatures // SIGNATURES))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = users.withColumn("chunk", F.pmod(F.xxhash64("user_id"), F.lit(chunks)).cast("int")).withColumn("pile", spread(piles))
    right = signatures.withColumn("pile", F.pmod(F.xxhash64("signature"), F.lit(piles)).cast("int")).withColumn("chunk", spread(chunks))
    return left.groupBy("chunk", "pile").cogroup(right.groupBy("chunk", "pile")).applyInArrow(_best_cell(weight, average_weight), FOUND)


#: Users whose rows are scored in one cell.
SCORED_USERS = 256
GENRE_SCORED = "user_id long, book_id long, readers long, most long, average double, genre_score double"


def _scored_cell(left: pa.Table, right: pa.Table) -> pa.Table:
    """left: rows (user_id, book_id, readers, most, average, signature); right: users (user_id, tastes, total)."""
    signatures = C._whole(left.column("signature")).dictionary_encode()
    users = right.column("user_id").to_numpy()
    sums = _sums(right, signatures.dictionary.to_pylist())
    order = np.argsort(users)
    asked = left.column("user_id").to_numpy()
    at = np.minimum(np.searchsorted(users[order], asked), max(len(users) - 1, 0))
    known = users[order][at] == asked if len(users) else np.zeros(len(asked), bool)
    row = order[at[known]] if len(users) else np.empty(0, np.int64)
    raw = sums[row, signatures.indices.to_numpy()[known]]
    some = np.flatnonzero(known)[raw > 0]
    out = left.take(pa.array(some)).select(["user_id", "book_id", "readers", "most", "average"])
    return out.append_column("genre_score", pa.array(raw[raw > 0] / right.column("total").to_numpy()[row[raw > 0]]))


def genre_scores(rows: DataFrame, users: DataFrame, n_users: int) -> DataFrame:
    """(GENRE_SCORED): the rows (user_id, book_id, readers, most, average, signature) whose genres the user weighs, with
    the sum of these weights. users: (user_id, tastes, total), distinct. Chunks of users are scored by themselves."""
    chunk = F.pmod(F.xxhash64("user_id"), F.lit(max(1, -(-n_users // SCORED_USERS)))).cast("int").alias("chunk")
    left = rows.select(chunk, "user_id", "book_id", "readers", "most", "average", "signature")
    right = users.select(chunk, "user_id", "tastes", "total")
    return left.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(_scored_cell, GENRE_SCORED)


def _books_cell(k: int, weight: float, average_weight: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: users (user_id, tastes, total, gone); right: signatures (signature, books: [(nth, average, book_id)])."""
        starts, sizes, flat = C._lists(right.column("books"))
        averages, ids = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("average", "book_id"))
        top, known = averages[starts], np.unique(ids)
        ties = np.add.reduceat(averages == np.repeat(top, sizes), starts, dtype=np.int64) if len(right) else sizes
        stats = pa.table({"signature": C._whole(right.column("signature")), "best": top, "first": ids[starts], "n": sizes, "ties": ties})
        lowest, wide = averages.min(initial=0.0), averages.max(initial=5.0) - averages.min(initial=0.0) + 2
        fall = np.repeat(np.arange(len(right)) * wide, sizes) - averages  # rises from place to place and from ranking to ranking
        _, n_gone, gone_ids = C._lists(left.column("gone"))
        left = left.append_column("need", pa.array((n_gone + k).astype(np.int32)))
        at = C._place(gone_ids, pa.array(known))
        gone = np.unique((np.repeat(np.arange(len(left)), n_gone) * len(known) + at)[at >= 0])
        out = [pa.table({"user_id": pa.array([], pa.int64()), "book_id": pa.array([], pa.int64()), "genre_score": pa.array([], pa.float64()), "average": pa.array([], pa.float64())})]
        for begin in range(0, len(left) if len(right) else 0, SCORED_USERS):
            row, column, score, need, floor = _best(left.slice(begin, SCORED_USERS), stats, weight, average_weight)
            # A book's average has to make up for what its genres leave to the floor; roundings are far below the margin.
            least = np.clip((floor - score * weight) / average_weight * 5.0 - 1e-4, lowest - 0.5, lowest + wide)
            taken = np.minimum(need, np.maximum(np.searchsorted(fall, column * wide - least, side="right") - starts[column], 0))
            place = C._spans(starts[column], taken)
            user, genre_score, book = np.repeat(row + begin, taken), np.repeat(score, taken), ids[place]
            if len(gone):
                key = user * len(known) + np.searchsorted(known, book)
                new = gone[np.minimum(np.searchsorted(gone, key), len(gone) - 1)] != key
                user, genre_score, book, place = user[new], genre_score[new], book[new], place[new]
            best = C.firsts(user, k, -C.six(genre_score * weight + averages[place] / 5.0 * average_weight), book)
            out.append(pa.table({"user_id": left.column("user_id").take(pa.array(user[best])), "book_id": book[best], "genre_score": genre_score[best], "average": averages[place[best]]}))
        return pa.concat_tables(out)

    return run


def best_books(users: DataFrame, books: DataFrame, n_users: int, n_signatures: int, k: int, weight: float, average_weight: float) -> DataFrame:
    """(user_id, book_id, genre_score, average): books that aren't gone, of each user and pile of signatures the first k by
    weight * genre_score + average_weight * average / 5, then id.

    users: (user_id, tastes: [(genre_id, raw)], total, gone), one row each; books: (signature, nth, average, book_id),
    ranked by average, then id, at least as deep as a user with most books gone needs. Chunks of users meet piles of
    signatures as in best_signatures; the books are fetched there too, so no more than k of a user leave a cell."""
    piles = max(1, -(-n_signatures // SIGNATURES))
    chunk, chunks = C.chunk_of("user_id", dict(users.dtypes)["user_id"], n_users)
    left = users.withColumn("chunk", chunk)
    spread = left.withColumn("pile", F.explode(F.sequence(F.lit(0), F.lit(piles - 1))))
    ranked = books.groupBy("signature").agg(F.sort_array(F.collect_list(F.struct("nth", "average", "book_id"))).alias("books"))
    right = ranked.withColumn("pile", F.pmod(F.xxhash64("signature"), F.lit(piles)).cast("int")).join(F.broadcast(left.select(F.col("chunk").alias("cell")).distinct()))
    cell = _books_cell(k, weight, average_weight)
    dealt = lambda df, key: df.repartition(chunks * piles, key, "pile").groupBy(key, "pile")
    return dealt(spread, "chunk").cogroup(dealt(right, "cell")).applyInArrow(lambda a, b: cell(a, b), "user_id long, book_id long, genre_score double, average double")


SHARED = "source_id {source}, target_id {target}, shared int"


def _shared_cell(least: int, most: int, same: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: (source_id, genres), right: (target_id, genres): the first `most` targets of each source in this cell.

        Targets come by id, so once a source has `most` of them only those with more in common than its last one count."""
        right = right.sort_by("target_id")
        _, n_left, a = C._lists(left.column("genres"))
        _, n_right, b = C._lists(right.column("genres"))
        codes, genres = C._coded(a)
        columns, have = C._place(b, genres), C._place(C._whole(left.column("source_id")), C._whole(right.column("target_id"))) if same else np.full(len(left), -1)
        ends_left, ends_right = np.concatenate([[0], np.cumsum(n_left)]), np.concatenate([[0], np.cumsum(n_right)])
        none = np.empty(0, np.int64)
        out: tuple[list[np.ndarray], ...] = ([none], [none], [none])
        for top in range(0, len(left), SCORED_USERS):
            rows = min(SCORED_USERS, len(left) - top)
            at, mine = np.repeat(np.arange(rows), n_left[top : top + rows]), codes[ends_left[top] : ends_left[top + rows]]
            found, bar = (none, none, none), np.full(rows, least - 1)
            for begin in range(0, len(right), SLICE):
                wide = min(SLICE, len(right) - begin)
                to, theirs = np.repeat(np.arange(wide), n_right[begin : begin + wide]), columns[ends_right[begin] : ends_right[begin + wide]]
                shared = np.zeros((rows, wide), np.float32)  # counts, exact
                for low in range(0, len(genres), SCORED_USERS):
                    some, others = (mine >= low) & (mine < low + SCORED_USERS), (theirs >= low) & (theirs < low + SCORED_USERS)
                    x, y = np.zeros((rows, min(SCORED_USERS, len(genres) - low)), np.float32), np.zeros((min(SCORED_USERS, len(genres) - low), wide), np.float32)
                    x[at[some], mine[some] - low] = 1
                    y[theirs[others] - low, to[others]] = 1
                    shared += x @ y
                itself = np.flatnonzero((have[top : top + rows] >= begin) & (have[top : top + rows] < begin + wide))
                shared[itself, have[top + itself] - begin] = -1
                least_here = bar.copy()
                if wide > most and np.count_nonzero(shared > bar[:, None]) > 2 * rows * most:
                    for row in range(rows):  # what `most` targets of this slice reach
                        reached = np.cumsum(np.bincount(np.maximum(shared[row], 0).astype(np.int64))[::-1])[::-1]
                        least_here[row] = max(bar[row], np.flatnonzero(reached >= most)[-1] - 1)
                r, c = np.nonzero(shared > least_here[:, None])
                r, c, n = (np.concatenate(pair) for pair in zip(found, (r, c + begin, shared[r, c].astype(np.int64))))
                best = C.firsts(r, most, -n, c)
                found = r[best], c[best], n[best]
                held = np.bincount(found[0], minlength=rows)
                last = np.cumsum(held) - 1
                bar = np.where(held >= most, found[2][last] if len(best) else 0, least - 1)
            for column, values in zip(out, (found[0] + top, found[1], found[2])):
                column.append(values)
        r, c, n = map(np.concatenate, out)
        return pa.table({"source_id": left.column("source_id").take(pa.array(r)), "target_id": right.column("target_id").take(pa.array(c)), "shared": n.astype(np.int32)})

    return run


#: Sources and targets that meet in one cell of top_shared, and targets of a cell that are compared at once.
SETS, TARGETS, SLICE = 8192, 131_072, 32_768


def top_shared(left: DataFrame, right: DataFrame, least: int, most: int, same: bool = True) -> DataFrame:
    """(source_id, target_id, shared, nth): of the targets with `least` genres in common or more, the first `most` of each
    source by genres in common, then id; with `same`, ids are of one kind and none is its own target.

    left: (source_id, genres), right: (target_id, genres), one row for each id. Chunks of sources meet piles of targets,
    and a cell passes on `most` targets of each source."""
    chunks, piles = max(1, -(-left.count() // SETS)), max(1, -(-right.count() // TARGETS))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumn("chunk", F.pmod(F.xxhash64("source_id"), F.lit(chunks)).cast("int")).withColumn("pile", spread(piles))
    b = right.withColumn("pile", F.pmod(F.xxhash64("target_id"), F.lit(piles)).cast("int")).withColumn("chunk", spread(chunks))
    kind = SHARED.format(source=dict(left.dtypes)["source_id"], target=dict(right.dtypes)["target_id"])
    dealt = lambda df: df.repartition(2 * chunks * piles, "chunk", "pile").groupBy("chunk", "pile")
    cell = _shared_cell(least, most, same)
    found = dealt(a).cogroup(dealt(b)).applyInArrow(lambda x, y: cell(x, y), kind)
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("shared"), "target_id"))
    return found.withColumn("nth", nth).where(F.col("nth") <= most)
