"""Rarity tiers, stratified pools, and the seeded draws of the games."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.functions import expressions as X
from shelfspark.operators.common import cut
from shelfspark.sources.catalogue import Catalogue


@dataclass(frozen=True)
class Tier:
    """Tier of a draw: averages in (low, high], ratings at least; the chance of its roll."""

    name: str
    low: float
    high: float
    ratings: int
    chance: float


#: Tiers of draws, rarest first.
TIERS = (
    Tier("legendary", 4.75, 5.01, 30, 0.015),
    Tier("ultra_rare", 4.50, 4.75, 20, 0.035),
    Tier("super_rare", 4.00, 4.50, 15, 0.10),
    Tier("rare", 3.25, 4.00, 8, 0.20),
    Tier("uncommon", 2.25, 3.25, 3, 0.30),
    Tier("common", 0.00, 2.25, 1, 0.35),
)
#: Size of each tier's pool; places on a display; tiers one of which a pack always holds.
POOL_SIZES = {"legendary": 20, "ultra_rare": 30, "super_rare": 50, "rare": 80, "uncommon": 110, "common": 150}
DISPLAY = {"legendary": 1, "ultra_rare": 1, "super_rare": 2, "rare": 5, "uncommon": 7, "common": 8}
GUARANTEED = ("legendary", "ultra_rare", "super_rare")
#: Users whose packs one task draws, about.
TASK_USERS = 5_000


def pool_tier() -> Column:
    """Tier of a book in pools, which also asks for ratings; null where no tier takes it."""
    r, n = X.combined_rating(None), X.total_ratings()
    return (
        F.when((r > 4.65) & (n >= 25), "legendary")
        .when((r > 4.5) & (r <= 4.65) & (n >= 20), "ultra_rare")
        .when((r > 4) & (r <= 4.5) & (n >= 15), "super_rare")
        .when((r > 3.25) & (r <= 4) & (n >= 8), "rare")
        .when((r > 2.25) & (r <= 3.25) & (n >= 3), "uncommon")
        .when((r <= 2.25) & (n >= 1), "common")
    )


def tiered(cat: Catalogue, language: str = "en") -> DataFrame:
    return cat.books.where((F.col("language") == language) & F.col("primary_cover_url").isNotNull()).withColumn("tier", pool_tier()).where("tier is not null")


def tier_counts(cat: Catalogue, language: str = "en") -> DataFrame:
    return tiered(cat, language).groupBy("tier").agg(F.count("*").alias("books"))


def stratified(books: DataFrame, sizes: dict[str, int], seed: int) -> DataFrame:
    """Of each tier as many books as its size says, in the order of the seed."""
    size = F.coalesce(*[F.when(F.col("tier") == name, F.lit(n)) for name, n in sizes.items()])
    nth = F.row_number().over(Window.partitionBy("tier").orderBy(X.seeded_order(F.col("book_id"), seed), "book_id"))
    return books.withColumn("nth", nth).where(F.col("nth") <= size)


def pools(cat: Catalogue, seed: int, language: str = "en") -> DataFrame:
    return stratified(tiered(cat, language), POOL_SIZES, seed).select("tier", "nth", "book_id", "title", X.six(X.combined_rating()).alias("combined_rating"))


def display(cat: Catalogue, winner: int, seed: int, language: str = "en", places: int = 24) -> DataFrame:
    """Books shown beside a winner: some of every tier, filled up to all places with what comes next in any tier."""
    others = tiered(cat, language).where(F.col("book_id") != winner)
    nth = F.row_number().over(Window.partitionBy("tier").orderBy(X.seeded_order(F.col("book_id"), seed), "book_id"))
    size = F.coalesce(*[F.when(F.col("tier") == name, F.lit(n)) for name, n in DISPLAY.items()])
    ranked = others.withColumn("nth", nth).withColumn("filler", (F.col("nth") > size).cast("int")).where(F.col("nth") <= size + places)
    return ranked.orderBy("filler", X.seeded_order(F.col("book_id"), seed), "book_id").limit(places).select("book_id", "tier", "title")


# ---- draws over pools, which hold 440 books at most


def uniform(*parts: object) -> float:
    """A number in [0, 1) from a seed and what is drawn."""
    return int.from_bytes(hashlib.md5(":".join(map(str, parts)).encode()).digest()[:6], "big") / (1 << 48)


def roll(seed: int, draw: object, tiers: tuple[Tier, ...] = TIERS) -> str:
    """A tier by the chances, scaled to those of the tiers given."""
    at, total = uniform(seed, "roll", draw) * sum(t.chance for t in tiers), 0.0
    for tier in tiers:
        total += tier.chance
        if at < total:
            return tier.name
    return tiers[-1].name


def fallback_order(name: str) -> list[str]:
    """Other tiers by distance, the more common of two first."""
    names = [t.name for t in TIERS]
    at = names.index(name)
    near = [i for d in range(1, len(names)) for i in (at + d, at - d)]
    return [names[i] for i in near if 0 <= i < len(names)]


Pool = dict[str, list[int]]


def collected_pools(pool_rows: DataFrame) -> Pool:
    out: Pool = {t.name: [] for t in TIERS}
    for row in pool_rows.orderBy("tier", "nth").select("tier", "book_id").collect():  # sum(POOL_SIZES) rows at most
        out[row["tier"]].append(row["book_id"])
    return out


def draw(pool: Pool, seed: int, nth: object, used: frozenset[int] = frozenset()) -> tuple[str, int] | None:
    """(tier, book) of one draw: the rolled tier, or the nearest with a book that isn't used."""
    tier = roll(seed, nth)
    for name in [tier, *fallback_order(tier)]:
        if left := [b for b in pool.get(name, []) if b not in used]:
            return name, left[int(uniform(seed, "book", nth) * len(left))]
    return None


def open_case(pool: Pool, seed: int) -> tuple[str, int] | None:
    return draw(pool, seed, 0)


def open_pack(pool: Pool, seed: int, length: int = 8) -> list[tuple[str, int]] | None:
    """Different books; where none is of a guaranteed tier, the most common one is exchanged for one that is."""
    if not 1 <= length <= 25:
        raise ValueError("a pack has 1 to 25 books")
    got: list[tuple[str, int]] = []
    for i in range(length):
        found = draw(pool, seed, i, frozenset(b for _, b in got))
        if found is None:
            return None
        got.append(found)
    if not any(t in GUARANTEED for t, _ in got):
        names = [t.name for t in TIERS]
        lowest = max(range(length), key=lambda i: (names.index(got[i][0]), -i))
        used = {b for i, (_, b) in enumerate(got) if i != lowest}
        for name in reversed(GUARANTEED):
            if left := [b for b in pool.get(name, []) if b not in used]:
                got[lowest] = (name, left[int(uniform(seed, "upgrade") * len(left))])
                break
    return got


def spin_slots(pool: Pool, seed: int) -> tuple[list[str], tuple[str, int]] | None:
    """Three reels, the most common of which is the winner's tier, and the winner."""
    winner = draw(pool, seed, 0)
    if winner is None:
        return None
    names = [t.name for t in TIERS]
    upto = TIERS[: names.index(winner[0]) + 1]
    reels = [winner[0], roll(seed, "reel-1", upto), roll(seed, "reel-2", upto)]
    return sorted(reels, key=lambda r: uniform(seed, "place", r, reels.index(r))), winner


# ---- the same draws for many players at once


def uniform_column(*parts: Column) -> Column:
    """uniform() of columns."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def tier_at(at: Column, tiers: tuple[Tier, ...] = TIERS) -> Column:
    """The tier of a place in [0, 1) on the chances of the tiers given, scaled to one."""
    scaled, total = at * sum(t.chance for t in tiers), 0.0
    out = None
    for tier in tiers[:-1]:
        total += tier.chance
        out = F.when(scaled < total, tier.name) if out is None else out.when(scaled < total, tier.name)
    return F.lit(tiers[0].name) if out is None else out.otherwise(tiers[-1].name)


def rolls(cat: Catalogue, seed: int) -> DataFrame:
    """The tier that each user rolls."""
    return cat.users.select("user_id", tier_at(uniform_column(F.lit(seed), F.lit("roll"), F.col("user_id"))).alias("tier"))


def spins(cat: Catalogue, seed: int) -> DataFrame:
    """A spin for each user: a book from the pool of the rolled tier, or the nearest that isn't empty, and three reels:
    that tier and two rolled among it and the rarer ones, shuffled. Pools hold sum(POOL_SIZES) books at most, so they
    are broadcast; without any book no one spins."""
    pool = pools(cat, seed).select("tier", "nth", "book_id")
    sizes = pool.groupBy("tier").agg(F.count("*").alias("size"))
    names = [t.name for t in TIERS]
    nearest = cat.spark.createDataFrame([(t, n, i) for t in names for i, n in enumerate([t, *fallback_order(t)])], "rolled string, tier string, distance int")
    given = nearest.join(F.broadcast(sizes), "tier").groupBy("rolled").agg(F.min_by(F.struct("tier", "size"), "distance").alias("given")).select("rolled", "given.*")
    at = lambda what: uniform_column(F.lit(seed), F.lit(what), F.col("user_id"))
    rolled = rolls(cat, seed).withColumnRenamed("tier", "rolled").join(F.broadcast(given), "rolled")
    won = rolled.withColumn("nth", (F.floor(at("book") * F.col("size")) + 1).cast("int")).join(F.broadcast(pool), ["tier", "nth"])

    def reel(name: str) -> Column:
        return F.coalesce(*[F.when(F.col("tier") == t, tier_at(at(name), TIERS[: i + 1])) for i, t in enumerate(names)])

    reels = {"reel-0": F.col("tier"), "reel-1": reel("reel-1"), "reel-2": reel("reel-2")}
    placed = F.array_sort(F.array(*[F.struct(at(f"place-{k}").alias("at"), v.alias("tier")) for k, v in reels.items()]))
    return won.select("user_id", "tier", "book_id", F.array_join(F.transform(placed, lambda p: p["tier"]), " ").alias("reels"))


def book_in_range(cat: Catalogue, low: float, high: float, ratings: int, seed: int, language: str = "en") -> DataFrame:
    """A seeded draw of one book whose average is in (low, high] and that has as many ratings."""
    fits = (X.combined_rating(None) > low) & (X.combined_rating(None) <= high) & (X.total_ratings() >= ratings) & (F.col("language") == language)
    return cat.books.where(fits).orderBy(X.seeded_order(F.col("book_id"), seed), "book_id").limit(1).select("book_id", "title", X.six(X.combined_rating()).alias("combined_rating"))


def tiers_in_range(cat: Catalogue, seed: int, language: str = "en") -> DataFrame:
    """For each tier the book that a case opened from the table draws: one in the tier's range with its ratings, or of the
    nearest tier that has any, the more common of two first."""
    r, n = X.combined_rating(None), X.total_ratings()
    tier = F.coalesce(*[F.when((r > t.low) & (r <= t.high) & (n >= t.ratings), t.name) for t in TIERS])
    fitting = cat.books.where(F.col("language") == language).withColumn("tier", tier).where("tier is not null")
    drawn = fitting.groupBy("tier").agg(F.min_by("book_id", F.struct(X.seeded_order(F.col("book_id"), seed), "book_id")).alias("book_id"))
    names = [t.name for t in TIERS]
    nearest = cat.spark.createDataFrame([(t, name, i) for t in names for i, name in enumerate([t, *fallback_order(t)])], "rolled string, tier string, distance int")
    given = nearest.join(F.broadcast(drawn), "tier")  # a row for each tier
    return given.groupBy("rolled").agg(F.min_by(F.struct("tier", "book_id"), "distance").alias("given")).select("rolled", "given.*")


def _dealt_users(cat: Catalogue) -> DataFrame:
    """(user_id) in tasks of TASK_USERS: a file of users is small, and would be one task with all their draws."""
    return cat.users.select("user_id").repartition(max(1, -(-cat.users.count() // TASK_USERS)), "user_id")


def _draws(own: Column, length: int, book: bool = True) -> Column:
    """[(rolled, at)]: the tier and the place that each draw of a pack rolls, hashed once; they are looked at often."""
    rolls = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.struct(uniform_column(own, F.lit("roll"), i).alias("roll"), (uniform_column(own, F.lit("book"), i) if book else F.lit(0.0)).alias("at")))
    return F.transform(rolls, lambda r: F.struct(tier_at(r["roll"]).alias("rolled"), r["at"].alias("at")))


def packs(cat: Catalogue, seed: int, length: int = 8) -> DataFrame:
    """A pack for each user: (user_id, place, tier, book_id) of `length` different books, as open_pack() draws them with
    the seed '<seed>:<user_id>'. Pools hold sum(POOL_SIZES) books at most, so a row with all of them is broadcast; a
    pack's draws are a fold over its places. Without enough books no one gets a pack."""
    if not 1 <= length <= 25:
        raise ValueError("a pack has 1 to 25 books")
    names = [t.name for t in TIERS]
    books = pools(cat, seed).select("tier", "nth", "book_id")
    held = lambda t: F.transform(F.array_sort(F.collect_list(F.when(F.col("tier") == t, F.struct("nth", "book_id")))), lambda p: p["book_id"]).alias(t)
    pool = books.agg(*[held(t) for t in names]).withColumn("one", F.lit(1))
    rows = _dealt_users(cat).withColumn("one", F.lit(1)).join(F.broadcast(pool), "one").drop("one")
    own = F.concat(F.lit(f"{seed}:"), F.col("user_id").cast("string"))
    taken = "array<struct<tier:string,book_id:bigint>>"

    def pick(order: list[str], used: Column, what: Column) -> Column:
        """The first tier in order with a book that isn't used, and one of these books."""
        options = []
        for t in order:
            left = F.array_except(t, used)
            options.append(F.when(F.size(left) > 0, F.struct(F.lit(t).alias("tier"), F.get(left, F.floor(what * F.size(left)).cast("int")).alias("book_id"))))
        return F.coalesce(*options)

    def draw_next(got: Column, d: Column) -> Column:
        used = F.transform(got, lambda g: g["book_id"])
        found = F.coalesce(*[F.when(d["rolled"] == t, pick([t, *fallback_order(t)], used, d["at"])) for t in names])
        return F.concat(got, F.array(found))

    drawn = rows.withColumn("got", F.aggregate(_draws(own, length), F.array().cast(taken), draw_next)).where(F.forall("got", lambda g: g.isNotNull()))
    level = lambda g: F.coalesce(*[F.when(g["tier"] == t, F.lit(i)) for i, t in enumerate(names)])
    lowest = F.array_min(F.transform("got", lambda g, i: F.struct((-level(g)).alias("level"), i.alias("i"))))["i"]
    used = F.transform(F.filter("got", lambda _, i: i != F.col("lowest")), lambda g: g["book_id"])
    better = pick(list(reversed(GUARANTEED)), used, uniform_column(own, F.lit("upgrade")))
    lucky = F.exists("got", lambda g: g["tier"].isin(*GUARANTEED))
    final = drawn.withColumn("lowest", lowest).withColumn("better", F.when(~lucky, better))
    swapped = F.transform("got", lambda g, i: F.when(F.col("better").isNotNull() & (i == F.col("lowest")), F.col("better")).otherwise(g))
    return final.select("user_id", F.posexplode(swapped).alias("place", "b")).select("user_id", "place", "b.tier", "b.book_id")


# ---- packs from the whole table


def numbered_tiers(books: DataFrame, parts: int = 256) -> DataFrame:
    """(tier, place, book_id): the books of each tier numbered from 0 without a gap. They are numbered within `parts` parts
    of a tier, and each part goes on where those before it end, so no task holds a tier."""
    dealt = books.select("tier", "book_id", F.pmod(F.xxhash64("book_id"), F.lit(parts)).alias("part"))
    own = F.row_number().over(Window.partitionBy("tier", "part").orderBy("book_id")) - 1
    upto = Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = dealt.groupBy("tier", "part").agg(F.count("*").alias("n")).withColumn("offset", F.sum("n").over(upto) - F.col("n")).drop("n")
    return dealt.withColumn("own", own).join(F.broadcast(offsets), ["tier", "part"]).select("tier", (F.col("offset") + F.col("own")).alias("place"), "book_id")  # parts rows a tier


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def permuted(nth: np.ndarray, size: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """The nth place of a permutation of 0 to size - 1 that the key names: different for different nth. A Feistel network
    over the next even number of bits; places beyond the size go through it again until they are within."""
    bits = np.maximum(2, np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64))
    half = ((bits + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = nth.astype(np.uint64).copy(), np.ones(len(nth), bool)
    while todo.any():
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = out[todo] >> h, out[todo] & m
        for r in range(rounds):
            left, right = right, left ^ (_mixed(right + k * np.uint64(2 * r + 1)) & m)
        out[todo] = left << h | right
        todo[todo] = out[todo] >= size[todo].astype(np.uint64)
    return out.astype(np.int64)


def _permuted_batches(batches):
    for batch in batches:
        columns = {n: batch.column(n).to_numpy() for n in ("nth", "size", "key")}
        place = permuted(columns["nth"], columns["size"], columns["key"].view(np.uint64))
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("user_id", "at", "tier")), pa.array(place)], names=["user_id", "at", "tier", "place"])


def in_tiers(cat: Catalogue, language: str = "en") -> DataFrame:
    """Books with the tier whose range their average is in and for which they have the ratings."""
    r, n = X.combined_rating(None), X.total_ratings()
    tier = F.coalesce(*[F.when((r > t.low) & (r <= t.high) & (n >= t.ratings), t.name) for t in TIERS])
    return cat.books.where(F.col("language") == language).withColumn("tier", tier).where("tier is not null")


def table_packs(cat: Catalogue, seed: int, length: int = 8, language: str = "en") -> DataFrame:
    """(user_id, place, tier, book_id): a pack of `length` different books for each user, drawn from the whole table.

    Each draw rolls a tier; where the user has already drawn all books of it, the nearest that still has one gives the
    book, the more common of two first. A pack without a book of a guaranteed tier gets one in place of its most common
    book, if there is any. A user's nth draw from a tier is the nth place of a permutation of the tier of the user's own,
    so books differ without knowing each other, and only the places drawn are looked up. Without `length` books in all
    tiers together no one gets a pack."""
    if not 1 <= length <= 25:
        raise ValueError("a pack has 1 to 25 books")
    names = [t.name for t in TIERS]
    books = cut(numbered_tiers(in_tiers(cat, language)))
    sizes = dict.fromkeys(names, 0) | {r["tier"]: r["n"] for r in books.groupBy("tier").agg(F.count("*").alias("n")).collect()}  # six rows
    if sum(sizes.values()) < length:
        return cat.users.limit(0).select("user_id", F.lit(0).alias("place"), F.lit("").alias("tier"), F.lit(0).cast("long").alias("book_id"))
    own = F.concat(F.lit(f"{seed}:"), F.col("user_id").cast("string"))
    drawn = lambda got, t: F.size(F.filter(got, lambda g: g["tier"] == t))

    def pick(order: list[str], got: Column) -> Column:
        """The first tier in order of which a book is left, and how many the user has had of it."""
        return F.coalesce(*[F.when(drawn(got, t) < sizes[t], F.struct(F.lit(t).alias("tier"), drawn(got, t).alias("nth"))) for t in order])

    def draw_next(got: Column, d: Column) -> Column:
        return F.concat(got, F.array(F.coalesce(*[F.when(d["rolled"] == t, pick([t, *fallback_order(t)], got)) for t in names])))

    rows = _dealt_users(cat).withColumn("got", F.aggregate(_draws(own, length, book=False), F.array().cast("array<struct<tier:string,nth:int>>"), draw_next))
    level = lambda g: F.coalesce(*[F.when(g["tier"] == t, F.lit(i)) for i, t in enumerate(names)])
    lucky = F.exists("got", lambda g: g["tier"].isin(*GUARANTEED))
    rows = rows.withColumn("lowest", F.array_min(F.transform("got", lambda g, i: F.struct((-level(g)).alias("level"), i.alias("i"))))["i"]).withColumn("better", F.when(~lucky, pick(list(reversed(GUARANTEED)), F.col("got"))))
    swapped = F.transform("got", lambda g, i: F.when(F.col("better").isNotNull() & (i == F.col("lowest")), F.col("better")).otherwise(g))
    size = F.coalesce(*[F.when(F.col("tier") == t, F.lit(n)) for t, n in sizes.items()]).cast("long")
    asked = rows.select("user_id", F.posexplode(swapped).alias("at", "b")).select("user_id", "at", "b.tier", F.col("b.nth").cast("long").alias("nth"))
    keyed = asked.select("user_id", "at", "tier", "nth", size.alias("size"), F.xxhash64(F.lit(seed), "user_id", "tier").alias("key"))
    places = keyed.mapInArrow(_permuted_batches, f"user_id {dict(cat.users.dtypes)['user_id']}, at int, tier string, place long")
    return places.join(books, ["tier", "place"]).select("user_id", F.col("at").alias("place"), "tier", "book_id")
