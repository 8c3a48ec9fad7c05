"""Connected components as shrinking joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallycast.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _ranked(column: str, turn: int) -> Column:
    return F.struct(F.xxhash64(F.col(column), F.lit(turn)).alias("rank"), F.col(column).alias("id"))


def components(edges: DataFrame) -> DataFrame:
    """``[id, component]`` for every id of the edges ``[a, b]``; a component is named by its smallest id.

    Each turn lets every id follow the neighbour of the smallest random rank, itself included, and keeps only
    the edges between different targets. Ranks change every second turn: new ones let chains shrink by a constant
    factor, so the number of turns is logarithmic; old ones let a star, whose centre now has the smallest rank, end
    in its second turn. Sums per id are combined before the shuffle and large ids are
    left to adaptive skew joins. Loops, repeated edges and an empty table are allowed; null ends are ignored.
    """
    left = written(edges.where("a is not null and b is not null and a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    steps, turn = [], 0
    while not left.isEmpty():
        ends = left.select(F.col("a").alias("id"), _ranked("b", turn // 2).alias("to")).unionByName(
            left.select(F.col("b").alias("id"), _ranked("a", turn // 2).alias("to")))
        best = ends.groupBy("id").agg(F.min("to").alias("to"))
        step = written(best.select("id", F.least(_ranked("id", turn // 2), F.col("to"))["id"].alias("target")), "step")
        follow_a = step.select(F.col("id").alias("a"), F.col("target").alias("ta"))
        follow_b = step.select(F.col("id").alias("b"), F.col("target").alias("tb"))
        moved = left.join(follow_a, "a").join(follow_b, "b").where("ta <> tb")
        left = written(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        steps.append(step)
        turn += 1
    if not steps:
        return left.select(F.col("a").alias("id"), F.col("b").alias("component"))
    root = steps[0]
    for step in steps[1:]:
        later = step.select(F.col("id").alias("target"), F.col("target").alias("next"))
        root = root.join(later, "target", "left").select("id", F.coalesce("next", "target").alias("target"))
    root = written(root, "roots")
    names = written(root.groupBy("target").agg(F.min("id").alias("component")), "names")
    return root.join(names, "target").select("id", "component")
