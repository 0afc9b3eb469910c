"""Exact top-k by overlap: for each source the targets that share most members with it.

Members are ordered by the number of targets that they bring, the most first. Where none has more than HOT targets, chunks
of sources meet the lists of their members (chunks.py). Else a member of up to HOT targets is met by a plain join. One with more (a reader of everything, a book that all have read) is only met where it can matter:

* with at least `least` shared members asked for, no target is found by a source's `least` - 1 hottest members alone;
* once a source has k targets with a count of t or more by its other members, targets that share only its t - 1 hottest
  members can't be among the first k any more. These members bring no candidates; they are counted for the candidates
  that can still reach t.

Hot members that do bring candidates are joined in salted cells, so none is a task of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.operators.chunks import overlaps
from shelfspark.operators.common import cut

#: Targets of a member up to which it is joined plainly.
HOT = 5_000
#: Cells over which the targets of a hot member are dealt.
CELLS = 64


def counted(left: DataFrame, right: DataFrame) -> DataFrame:
    """(source_id, target_id, score) by a plain join."""
    return left.join(right, "member").groupBy("source_id", "target_id").agg(F.count("*").alias("score"))


def first(pairs: DataFrame, k: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), "target_id"))
    return pairs.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


def top_overlaps(left: DataFrame, right: DataFrame, least: int, k: int, hot: int = HOT, same: bool = True) -> DataFrame:
    """(source_id, target_id, score): of the targets with `least` or more members in common the first k of each source by
    score (descending), then id.

    left: (source_id, member), right: (target_id, member), both distinct. With `same`, sources and targets are of one
    kind, and none is its own target. Sources without targets have no row."""
    apart = (lambda df: df.where("source_id <> target_id")) if same else (lambda df: df)
    frequency = right.groupBy("member").agg(F.count("*").alias("df"))
    many = frequency.where(F.col("df") > hot)
    if many.isEmpty():
        return overlaps(left, right, least, k, same)
    many = cut(many)
    marked = left.join(many, "member", "left")  # hot members are rare: reads / hot of them at most
    plain = cut(apart(counted(marked.where("df IS NULL").select("source_id", "member"), right)))
    nth = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score")))
    reached = plain.withColumn("nth", nth).where(F.col("nth") == k).select("source_id", F.greatest("score", F.lit(least)).alias("bar"))
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("df"), "member"))
    hottest = marked.where("df IS NOT NULL").join(reached, "source_id", "left").withColumn("bar", F.coalesce("bar", F.lit(least))).withColumn("place", place)
    hottest = cut(hottest.select("source_id", "member", "bar", (F.col("place") < F.col("bar")).alias("skipped")))
    cell = F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1)))
    asked = hottest.where("NOT skipped").select("source_id", "member", cell.alias("cell"))
    dealt = right.join(many.select("member"), "member", "left_semi").withColumn("cell", F.pmod(F.xxhash64("target_id"), F.lit(CELLS)).cast("int"))
    more = apart(asked.join(dealt, ["member", "cell"]).groupBy("source_id", "target_id").agg(F.count("*").alias("score")))
    partial = plain.unionByName(more).groupBy("source_id", "target_id").agg(F.sum("score").alias("score"))
    bars = hottest.groupBy("source_id").agg(F.first("bar").alias("bar"), F.count_if("skipped").alias("left"), F.collect_list(F.when(F.col("skipped"), F.col("member"))).alias("members"))
    known = partial.join(bars, "source_id", "left")
    able = known.where(F.col("score") + F.coalesce("left", F.lit(0)) >= F.coalesce("bar", F.lit(least)))
    able = cut(able)
    again = able.select("source_id", "target_id", F.explode("members").alias("member")).join(dealt.select("target_id", "member"), ["target_id", "member"], "left_semi")
    extra = again.groupBy("source_id", "target_id").agg(F.count("*").alias("score"))
    total = able.select("source_id", "target_id", "score").unionByName(extra).groupBy("source_id", "target_id").agg(F.sum("score").alias("score"))
    return first(total.where(F.col("score") >= least), k)
