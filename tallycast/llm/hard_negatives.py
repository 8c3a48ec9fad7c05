"""Hard negatives of anchor vectors, found by bounds from summaries of vector segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tallycast.llm.graph import written

POSITIVES, NEGATIVES = 5, 10
LEAST_PERCENT, MOST_PERCENT = 30, 90
SEGMENTS = (4, 16)
ANCHORS = 512  # of a block
SLICE_VALUES = 1 << 20  # vector components of a slice of rows
TILE = 4096  # rows that a task bounds at a time


def segment_edges(width: int) -> list[np.ndarray]:
    """Per level the starts of the segments, from coarse to fine; segments of a level differ in length by one at most."""
    return [np.arange(n) * width // n for n in sorted({min(n, width) for n in SEGMENTS})]


def summaries(vectors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level the mean and the deviation of every segment, both times the root of the segment's length."""
    out, width = [], vectors.shape[1]
    for starts in segment_edges(width):
        lengths = np.diff(np.append(starts, width))
        means = np.add.reduceat(vectors, starts, axis=1) / lengths
        apart = vectors - np.repeat(means, lengths, axis=1)
        deviations = np.sqrt(np.add.reduceat(apart * apart, starts, axis=1) / lengths)
        out.append((means * np.sqrt(lengths), deviations * np.sqrt(lengths)))
    return out


def _summarised(width: int):
    """Rows with the integer vector in full width and its stored summaries, all levels in one array each."""

    def run(batches):
        for batch in batches:
            column = batch.column("code")
            rows = np.zeros((len(column), width), dtype=np.int64)
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            lengths = np.diff(offsets)
            at = np.repeat(np.arange(len(rows)) * width - (offsets[:-1] - offsets[0]), lengths) + np.arange(lengths.sum())
            rows.ravel()[at] = values[offsets[0] : offsets[-1]]
            if len(rows) and float((rows.astype(np.float64) ** 2).sum(axis=1).max()) >= 2.0**62:
                raise ValueError("a vector is so long that its scores leave 64 bits")
            levels = summaries(rows.astype(np.float64))
            stored = [np.concatenate(parts, axis=1) for parts in zip(*levels)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("key", "id", "label", "anchor")], *[_listed(x) for x in (rows, *stored)]],
                names=["key", "id", "label", "anchor", "code", "means", "deviations"])

    return run


def _listed(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


class _Side:
    """The rows of one side of a group as matrices."""

    def __init__(self, table: pa.Table):
        self.key, self.id, self.label = (table.column(c).to_numpy() for c in ("key", "id", "label"))
        self.code, self.means, self.deviations = (
            table.column(c).combine_chunks().flatten().to_numpy().reshape(len(self.id), -1) for c in ("code", "means", "deviations"))
        values = self.code.astype(np.float64)
        self.values, self.norm = values, np.sqrt((values**2).sum(axis=1))

    def level(self, at: slice, rows: slice):
        return self.means[rows, at], self.deviations[rows, at]


def _pairwise(a: np.ndarray, b: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Inner products of rows of ``a`` with rows of ``b`` where ``alive``; anything elsewhere."""
    if alive.mean() > 0.2:
        return a @ b.T
    out = np.zeros(alive.shape, dtype=a.dtype)
    i, j = np.nonzero(alive)
    out[i, j] = np.einsum("ij,ij->i", a[i], b[j])
    return out


def _levels(width: int):
    at = 0
    for starts in segment_edges(width):
        yield slice(at, at + len(starts))
        at += len(starts)


def _exact(anchors: _Side, rows: _Side, some: slice, alive: np.ndarray) -> np.ndarray:
    """Integer inner products; floating point is exact while every partial sum stays below 2**53."""
    if anchors.norm.max(initial=0) * rows.norm[some].max(initial=0) < 2.0**52:
        return np.rint(_pairwise(anchors.values, rows.values[some], alive)).astype(np.int64)
    return _pairwise(anchors.code, rows.code[some], alive)


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of every row, minus infinity where a row has fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


def search(anchors: _Side, rows: _Side, allowed, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per anchor and window ``(anchor, window, scores, ids)`` of its k best allowed rows with a score from ``low`` to ``high``.

    Ties go to the smaller id. For every tile the summaries bound all scores from coarse to fine segments. A row stays while it may lie
    in a window and its upper bound reaches the k-th best of the exact scores so far and of the lower bounds of rows
    that certainly lie inside. What is left is scored exactly.
    """
    best = {}
    reached = np.full(low.shape, -np.inf)
    for start in range(0, len(rows.id), TILE):
        some = slice(start, start + TILE)
        may = allowed(some)
        alive = [may & True for _ in range(low.shape[1])]
        slack = 1e-10 * anchors.norm[:, None] * rows.norm[None, some] + 1e-6
        for at in _levels(anchors.code.shape[1]):
            union = np.logical_or.reduce(alive)
            if not union.any():
                break
            (am, ad), (rm, rd) = anchors.level(at, slice(None)), rows.level(at, some)
            middle = _pairwise(am, rm, union)
            spread = _pairwise(ad, rd, union) + slack
            least, most = middle - spread, middle + spread
            for w in range(low.shape[1]):
                inside = alive[w] & (least >= low[:, w : w + 1]) & (most <= high[:, w : w + 1])
                bar = np.maximum(_kth(np.where(inside, least, -np.inf), k), reached[:, w])
                alive[w] &= (most >= np.maximum(low[:, w], bar)[:, None]) & (least <= high[:, w : w + 1])
        union = np.logical_or.reduce(alive)
        if not union.any():
            continue
        scores = _exact(anchors, rows, some, union)
        ids = rows.id[some]
        for w in range(low.shape[1]):
            hit = alive[w] & (scores >= low[:, w : w + 1]) & (scores <= high[:, w : w + 1]) & (scores >= reached[:, w : w + 1])
            for i in np.flatnonzero(hit.any(axis=1)):
                at = np.flatnonzero(hit[i])
                own, names = scores[i, at], ids[at]
                if (i, w) in best:
                    own, names = np.concatenate([best[i, w][0], own]), np.concatenate([best[i, w][1], names])
                order = np.lexsort((names, -own))[:k]
                best[i, w] = own[order], names[order]
                if len(order) == k:
                    reached[i, w] = own[order[-1]]
    return [(i, w, *found) for (i, w), found in best.items()]


def _found(anchors: _Side | None, hits: list) -> pa.Table:
    sizes = [len(scores) for _, _, scores, _ in hits]
    columns = {
        "key": np.repeat(np.array([anchors.key[i] for i, _, _, _ in hits], dtype=np.int64), sizes),
        "place": np.repeat(np.array([w for _, w, _, _ in hits], dtype=np.int32), sizes),
        "score": np.concatenate([s for _, _, s, _ in hits]) if hits else np.zeros(0, dtype=np.int64),
        "other": np.concatenate([n for _, _, _, n in hits]) if hits else np.zeros(0, dtype=np.int64),
    }
    return pa.table(columns)


def _positives(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        anchors, rows = _Side(left), _Side(right)
        everything = np.full((len(anchors.id), 1), -np.inf), np.full((len(anchors.id), 1), np.inf)

        def same(some):
            return (anchors.label[:, None] == rows.label[None, some]) & (anchors.id[:, None] != rows.id[None, some])

        return _found(anchors, search(anchors, rows, same, *everything, k))

    return run


def _negatives(k: int, n_positives: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        anchors, rows = _Side(left), _Side(right)
        low, high = (left.column(c).combine_chunks().flatten().to_numpy().reshape(len(anchors.id), n_positives).astype(np.float64) for c in ("low", "high"))
        return _found(anchors, search(anchors, rows, lambda some: anchors.label[:, None] != rows.label[None, some], low, high, k))

    return run


def _blocked(anchors: DataFrame, rows: DataFrame, blocks: int, slices: int, function) -> DataFrame:
    """Every block of anchors with every slice of rows, as a group of bounded size each."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return function(left, right) if len(left) and len(right) else _found(None, [])

    own = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks)).cast("int")
    left = anchors.withColumn("block", own).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    part = F.pmod(F.xxhash64("key", F.lit(2)), F.lit(slices)).cast("int")
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # columns of its own, although both sides come from one table
    right = rows.withColumn("slice", part).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = left.groupBy("block", "slice").cogroup(right.groupBy("block", "slice"))
    return pairs.applyInArrow(both, "key long, place int, score long, other long")


def _first(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("key", "place").orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def mine_hard_negatives(
    vectors: DataFrame, anchor: Column, id_column: str = "vec_id", label_column: str = "label", vector_column: str = "code",
    n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, least_percent: int = LEAST_PERCENT, most_percent: int = MOST_PERCENT,
) -> DataFrame:
    """``[anchor_id, positive_id, rank, negative_id, positive_score, negative_score]`` of integer vectors.

    A score is the inner product with the anchor, ties go to the smaller id. Rows that meet ``anchor`` are anchors; their positives are their best
    ``n_positives`` rows of the same label and another id. For each positive the best ``n_negatives`` rows of other labels whose
    score is ``least_percent`` to ``most_percent`` of the positive's are returned.

    The mean and deviation of every segment of every vector are stored, in 4 and in 16 segments. Over a segment the product of the
    means plus or minus that of the deviations, times the length, bounds the inner product. Blocks of anchors meet
    slices of rows in tasks; coarse bounds, then fine ones leave few pairs to be scored, exactly and in 64 bits.

    Rows with a null id, label or vector, or a null component, take no part. Shorter vectors are filled up with zeros. Rows that repeat an id
    are rows of their own, but no positives of each other. A vector whose squared length reaches 2**62 is an error. Other columns are ignored, and an
    empty table gives no rows.
    """
    source = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).cast("array<long>").alias("code"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"))
    source = source.where("id is not null and label is not null and code is not null and forall(code, x -> x is not null)")
    source = written(source.withColumn("key", F.monotonically_increasing_id()), "codes")
    n, n_anchors, width = source.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("anchor").cast("int")), F.lit(0)), F.coalesce(F.max(F.size("code")), F.lit(0))).first()
    width = max(width, 1)
    index = written(source.mapInArrow(
        _summarised(width), "key long, id long, label long, anchor boolean, code array<long>, means array<double>, deviations array<double>"), "summaries")
    blocks, slices = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n * width // SLICE_VALUES))
    anchors, rows = index.where("anchor").drop("anchor"), index.drop("anchor")
    positives = written(_first(_blocked(anchors, rows, blocks, slices, _positives(n_positives)), n_positives).select(
        "key", F.col("rank").alias("place"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    least = F.ceil(F.lit(least_percent) * F.col("positive_score").cast("decimal(20,0)") / 100).cast("long")
    most = F.floor(F.lit(most_percent) * F.col("positive_score").cast("decimal(20,0)") / 100).cast("long")
    window = F.struct("place", least.alias("low"), most.alias("high"))
    windows = positives.groupBy("key").agg(F.array_sort(F.collect_list(window)).alias("windows"))

    def padded(name: str, empty: int) -> Column:
        filled = F.concat(F.transform("windows", lambda x: x[name]), F.array_repeat(F.lit(empty).cast("long"), n_positives))
        return F.slice(filled, 1, n_positives).alias(name)

    asked = anchors.join(windows.select("key", padded("low", 1), padded("high", 0)), "key")
    negatives = _first(_blocked(asked, rows, blocks, slices, _negatives(n_negatives, n_positives)), n_negatives)
    names = anchors.select("key", F.col("id").alias("anchor_id"))
    return negatives.withColumn("place", F.col("place") + 1).join(positives, ["key", "place"]).join(names, "key").select(
        "anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
