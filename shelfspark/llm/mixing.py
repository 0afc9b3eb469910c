"""Mixing sources to target weights by whole documents.

Tokens are summed by source, each source gets a target, and target / tokens is the rate at which its documents repeat:
floor(rate) whole copies and one more with the probability of the fraction, drawn from a hash of seed and document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, fresh, unit_hash, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in order of code points, null last, have the weights in turn. They share `share` times all tokens by weight;
    none gets more than `most` times its own, and what is above goes to the others by weight until none is above. The
    sources in order of most * size / weight are full up to some place; the level at which the rest shares what is left
    is the first that its own source can hold, so one pass over the ordered sources finds what repeated sharing ends in.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    per = per.withColumn("level", left / F.sum("weight").over(after)).withColumn("nth", F.row_number().over(order))
    holds = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("nth", "level"))
    per = per.withColumn("level", F.min(holds).over(whole)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("level") * F.col("weight"), F.col("cap")))
    return per.select("source", "source_size", target.alias("target"))


def copies(rate: Column, *key: Column) -> Column:
    """floor(rate) and one more if the key's hash is below the fraction."""
    whole = F.floor(rate)
    return F.coalesce((whole + (unit_hash(*key) < rate - whole).cast("int")).cast("long"), F.lit(0).cast("long"))


def mix_rates(sized: DataFrame, seed: str = SEED, **kinds) -> DataFrame:
    """Adds source_size, target and copies to rows (doc_id, source, size, ...)."""
    goal = broadcast_if_small(targets(sized, **kinds).withColumnRenamed("source", "goal_source"))
    joined = sized.join(goal, sized["source"].eqNullSafe(goal["goal_source"]), "left").drop("goal_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return joined.withColumn("copies", copies(rate, F.lit(seed), F.col("doc_id")))


def mix_documents(docs: DataFrame, seed: str = SEED, **kinds) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for each row of docs (doc_id, text, source, ...).

    size counts words (null text: 0). A source without words has the target 0; null is a source of its own; repeated
    rows with one id are drawn alike; an empty table gives no rows; other columns are not looked at. The texts are read
    once, long ones whole: ids, sources and sizes go through the shared folder.
    """
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mix_rates(sized, seed, **kinds).select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def repeat_documents(docs: DataFrame, seed: str = SEED, **kinds) -> DataFrame:
    """The mix itself: every row of docs (doc_id, text, source, ...) as many times as its copies say, all columns as they
    are. Null texts have size 0, null is a source of its own, rows with one id are drawn alike, a source without words
    goes; long texts are counted whole; an empty table stays empty; columns of any name are passed on."""
    source, rate, copy = (fresh(docs, c) for c in ("__source", "__rate", "__copy"))
    goal = targets(docs.select("source", word_count(F.col("text")).alias("size")), **kinds)
    goal = broadcast_if_small(goal.select(F.col("source").alias(source), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias(rate)))
    rated = docs.join(goal, docs["source"].eqNullSafe(goal[source]), "left")
    times = copies(F.col(rate), F.lit(seed), F.col("doc_id")).cast("int")
    return rated.withColumn(copy, F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)
