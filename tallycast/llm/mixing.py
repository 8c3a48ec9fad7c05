"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallycast.llm.graph import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
REPEATS = 3
SLICES = 4096


def _targets(sizes: DataFrame, weights: Sequence[int], repeats: int) -> DataFrame:
    """``[source, k, weight, source_size, target]``: shares of all words by weight, none above ``repeats`` times its source.

    Filling by weight closes sources in the order of cap over weight; the level at which the rest shares what the closed
    ones leave is known in closed form, so no loop over reshared excess is needed. One row per source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("k", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    caps = numbered.withColumn("weight", weight).withColumn("cap", F.col("source_size") * repeats)
    filling = W.orderBy(F.col("cap") / F.col("weight"), "k")
    before, onward = filling.rowsBetween(W.unboundedPreceding, -1), filling.rowsBetween(0, W.unboundedFollowing)
    left = F.sum("source_size").over(W.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    level = caps.withColumn("level", left / F.sum("weight").over(onward))
    share = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "k", "level"))).over(
        W.partitionBy())["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(share, F.lit(0.0)) * F.col("weight"))
    return level.select("source", "k", "weight", "source_size", target.alias("target"))


def _crossing(copies: DataFrame, bucket: Column, budget: int, base: int) -> tuple[int, int] | None:
    """The bucket in which the running total passes the budget, and the total before it."""
    totals = copies.groupBy(bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    running = F.sum("words").over(W.orderBy("bucket")) + base
    over = totals.withColumn("running", running).where(F.col("running") > budget).orderBy("bucket").first()
    return None if over is None else (over["bucket"], over["running"] - over["words"])


def mix_sources(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS,
) -> DataFrame:
    """One row per document: ``[id_column, size, source_size, target, taken, copies, virtual_finish]``.

    Documents of a source are shuffled by a hash of their id. A document's virtual finish time is the words of its
    source up to and including it, divided by the target of the source; each further pass over the source adds the
    source's size. All passes together are ordered by (virtual finish, source, hash, id) and cut where the running total
    passes the total budget, the words of all documents. ``taken`` counts the words of the copies before the cut.

    Running totals never need a whole source in one task: a source is cut into 4096 slices of the hash, whose sums
    are added up per source, and only a slice is sorted. The cut is found by two histograms of the virtual finish; only the
    documents of one bucket are ordered row by row. One row per source passes through one task.

    Null text has size 0 and takes nothing; a null source is a source of its own, the last one; an empty table or
    one without words has zero targets. Equal rows with the same id share one place. Other columns are ignored.
    """
    return _mixed(docs, id_column, text_column, source_column, weights, repeats).drop("__source")


def _size(text_column: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_column).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _mixed(docs: DataFrame, id_column: str, text_column: str, source_column: str, weights: Sequence[int], repeats: int) -> DataFrame:
    """The rows of ``mix_sources`` with ``__source``; rows of one id, source and size share one place."""
    order = F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    sized = written(docs.select(
        F.col(id_column).alias("id"), F.col(source_column).alias("source"), _size(text_column).alias("size"), order.alias("order")), "sizes")
    targets = written(_targets(sized, weights, repeats), "targets")
    placed = sized.join(targets.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    placed = placed.withColumn("slice", F.conv(F.substring("order", 1, 3), 16, 10).cast("int"))
    slices = placed.groupBy("k", "slice").agg(F.sum("size").alias("words"))
    earlier = F.coalesce(F.sum("words").over(W.partitionBy("k").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = written(slices.select("k", "slice", earlier.alias("start")), "slices")
    inside = F.sum("size").over(W.partitionBy("k", "slice").orderBy("order", "id", "size"))
    queued = written(placed.join(starts, ["k", "slice"]).withColumn("upto", F.col("start") + inside).drop("start", "slice", "weight"), "queue")

    finish = lambda turn: F.when(F.col("target") > 0, (F.col("upto") + turn * F.col("source_size")) / F.col("target"))
    copies = queued.where("size > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn(
        "finish", finish(F.col("turn")))
    budget = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words")).first()["words"]
    last = _last_taken(copies, budget)
    key = lambda turn: F.struct(finish(turn).alias("finish"), "k", "order", "id")
    if last is None:
        n = F.lit(repeats)
    else:
        cut = F.struct(F.lit(last["finish"]).alias("finish"), F.lit(last["k"]).alias("k"), F.lit(last["order"]).alias("order"), F.lit(last["id"]).alias("id"))
        n = sum((F.when(key(F.lit(turn)) <= cut, 1).otherwise(0) for turn in range(repeats)), F.lit(0))
    n = F.when(F.col("size") > 0, n).otherwise(0).cast("int")
    return queued.select(
        F.col("id").alias(id_column), "size", "source_size", "target", (n * F.col("size")).cast("long").alias("taken"),
        n.alias("copies"), finish(F.lit(0)).alias("virtual_finish"), F.col("source").alias("__source"))


def _last_taken(copies: DataFrame, budget: int):
    """The last copy before the cut, in the order of virtual finish; None if the budget takes all."""
    coarse = F.least(F.floor(F.col("finish") * SLICES), F.lit(4 * SLICES))
    found = _crossing(copies, coarse, budget, 0)
    if found is None:
        return None
    bucket, base = found
    inner = copies.where(coarse == bucket)
    fine = F.least(F.floor((F.col("finish") * SLICES - bucket) * SLICES), F.lit(4 * SLICES))
    sub_bucket, sub_base = _crossing(inner, fine, budget, base)
    total = F.sum("size").over(W.orderBy("finish", "k", "order", "id")) + sub_base
    order = [F.col(c).desc() for c in ("finish", "k", "order", "id")]
    last = inner.where(fine == sub_bucket).withColumn("total", total).where(F.col("total") <= budget).orderBy(*order).first()
    if last is not None:
        return last
    before = copies.where((coarse < bucket) | ((coarse == bucket) & (fine < sub_bucket)))
    return before.orderBy(*order).first() or {"finish": -1.0, "k": 0, "order": "", "id": None}


def mixed_documents(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS,
) -> DataFrame:
    """The documents of the mix with their columns, each as often as it is taken, in ranges of virtual finish.

    Rows that share an id, also a null one, are taken each as often as the mix takes that row.
    """
    chosen = _mixed(docs, id_column, text_column, source_column, weights, repeats).where("copies > 0")
    one_pass = F.col("source_size") / F.col("target")
    chosen = chosen.groupBy(F.col(id_column).alias("__id"), "__source", F.col("size").alias("__words")).agg(
        F.min("copies").alias("__copies"), F.min("virtual_finish").alias("__finish"), F.min(one_pass).alias("__pass"))
    sized = docs.withColumn("__size", _size(text_column))
    taken = sized.join(chosen, F.col(id_column).eqNullSafe(F.col("__id")) & F.col(source_column).eqNullSafe(F.col("__source")) & (
        F.col("__size") == F.col("__words")))
    repeated = taken.withColumn("__turn", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    queued = repeated.withColumn("__finish", F.col("__finish") + F.col("__turn") * F.col("__pass"))
    return queued.repartitionByRange("__finish", "__id").sortWithinPartitions("__finish", "__id").select(*docs.columns)
