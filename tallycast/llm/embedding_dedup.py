"""Near-duplicate embeddings by counting collisions of one-dimensional projections."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallycast.llm.graph import components, written

COSINE = 0.98
PROJECTIONS, HALF_WIDTH, RECALL = 40, 1.75, 0.9999
LEADS, LEAD_WIDTH = 2, 4.2
BLOCK, QUERIES = 1024, 128


def collisions_needed(projections: int = PROJECTIONS, half_width: float = HALF_WIDTH, recall: float = RECALL) -> int:
    """The largest number of window collisions that a pair at the wanted cosine reaches with the wanted probability.

    Along a Gaussian direction two unit vectors at distance d differ by a normal value of deviation d. A window of
    ``half_width`` deviations is hit with probability p, and the hits over independent directions are binomial.
    """
    p = math.erf(half_width / math.sqrt(2))
    reached, count = 0.0, projections + 1
    while reached < recall and count > 0:
        count -= 1
        reached += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
    return count


@lru_cache(maxsize=8)
def directions(size: int) -> np.ndarray:
    return np.random.default_rng(8_000_003 + size).standard_normal((size, PROJECTIONS))


def _deviation(cosine: float) -> float:
    return math.sqrt(max(2 - 2 * cosine, 1e-12))


def window_counts(queries: np.ndarray, others: np.ndarray, half: float) -> np.ndarray:
    """Per query (row) and other (column), in how many projections the other lies in the window around the query."""
    counts = np.zeros(len(queries) * len(others), dtype=np.uint8)
    base = np.arange(len(queries)) * len(others)
    for j in range(queries.shape[1]):
        order = np.argsort(others[:, j], kind="stable")
        line = others[order, j]
        low, high = np.searchsorted(line, queries[:, j] - half, "left"), np.searchsorted(line, queries[:, j] + half, "right")
        sizes = high - low
        ends = np.cumsum(sizes)
        inside = np.repeat(low - (ends - sizes), sizes) + np.arange(ends[-1])
        counts[np.repeat(base, sizes) + order[inside]] += 1
    return counts.reshape(len(queries), len(others))


def _placed(cosine: float):
    """Vectors with their cell: the leading projections in steps that a linked pair does not cross twice."""

    def run(batches):
        step = LEAD_WIDTH * _deviation(cosine)
        for batch in batches:
            ids, vectors = batch.column("id").to_pylist(), batch.column("vector")
            values, offsets = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            cells = np.zeros((len(ids), LEADS), dtype=np.int32)
            for i in range(len(ids)):
                v = values[offsets[i] : offsets[i + 1]]
                cells[i] = np.floor((v / _norm(v)) @ directions(len(v))[:, :LEADS] / step)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *[pa.array(cells[:, i]) for i in range(LEADS)]], names=["id", "x", "y"])

    return run


def _norm(v: np.ndarray) -> float:
    """The length of a vector, safe against overflow and underflow of its squares."""
    top = np.abs(v).max()
    return float(top * np.sqrt(((v / top) ** 2).sum()))


def _linked(cosine: float):
    """Links inside one pair of blocks: per vector the links, weighed by copies, and a root of its local component."""
    half, needed = HALF_WIDTH * _deviation(cosine), collisions_needed()

    def run(table: pa.Table) -> pa.Table:
        ids, copies, own = (table.column(c).to_numpy() for c in ("id", "copies", "own"))
        vectors = table.column("vector").combine_chunks()
        rows = vectors.values.to_numpy().reshape(len(ids), -1)
        unit = rows / np.array([_norm(v) for v in rows])[:, None]
        lines = unit @ directions(unit.shape[1])
        same = bool((table.column("same").to_numpy() == 1).all())
        a = np.arange(len(ids)) if same else np.flatnonzero(own == 0)
        b = np.arange(len(ids)) if same else np.flatnonzero(own == 1)
        links, root, touched = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids)), []
        if len(a) and len(b):
            for at in range(0, len(a), QUERIES):
                part = a[at : at + QUERIES]
                near, other = np.nonzero(window_counts(lines[part], lines[b], half) >= needed)
                left, right = part[near], b[other]
                close = np.einsum("ij,ij->i", unit[left], unit[right]) >= cosine
                left, right = left[close], right[close]
                apart = left != right
                left, right = left[apart], right[apart]
                np.add.at(links, left, copies[right])
                if not same:
                    np.add.at(links, right, copies[left])
                touched.append(np.stack([left, right]))
        pairs = np.concatenate(touched, axis=1) if touched else np.zeros((2, 0), dtype=np.int64)
        while True:
            before = root.copy()
            np.minimum.at(root, pairs[0], before[pairs[1]])
            np.minimum.at(root, pairs[1], before[pairs[0]])
            root = root[root]
            if (root == before).all():
                break
        some = np.flatnonzero(links > 0)
        return pa.table({"id": ids[some], "n": links[some], "root": ids[root[some]]})

    return run


def near_duplicate_vectors(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", cosine: float = COSINE,
) -> DataFrame:
    """One row per vector: ``[id_column, n_links, component_id, kept]``.

    Vectors of the same label and length link at the cosine or above, in double precision. Equal vectors are one node
    with copies. Each node lies in a cell of two leading projections; only blocks of equal or neighbouring cells meet, at most 1024 by
    1024 vectors a task, as many tasks as a hot label needs. There every projection is sorted, the window around each query
    counts a collision for all inside, and pairs with enough of 40 collisions are verified by their cosine. A pair at 0.98 is counted
    with probability 0.9999. Tasks return numbers of links and local roots, never pairs.

    Null, zero or empty vectors, ones with null or non-finite components and null labels link with nothing and are kept. Null ids are
    kept and link with nothing. Rows that repeat an id are vectors of their own that count as links of each other if equal. Other columns
    are ignored.
    """
    vector = F.col(vector_column).cast("array<double>")
    source = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0)
    plain = F.transform("vector", lambda x: x + F.lit(0.0))
    good = source.where(usable).withColumn("vector", plain).withColumn("print", F.xxhash64("vector")).withColumn("size", F.size("vector"))
    nodes = good.groupBy("label", "print", "vector").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("class"), "node", "label", "print", "vector", "copies"), "nodes")
    cells = nodes.select(F.col("class").alias("id"), "vector").mapInArrow(_placed(cosine), "id long, x int, y int")
    placed = written(nodes.join(cells.withColumnRenamed("id", "class"), "class").withColumn("size", F.size("vector")), "cells")
    cell = ["label", "size", "x", "y"]
    filled = written(placed.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "blocks")
    here = placed.join(filled, cell).withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    around = here.withColumn("step", F.explode(steps)).select(
        F.col("class").alias("id"), "copies", "vector", "label", "size", "x", "y", "block", (F.col("x") + F.col("step.dx")).alias("ox"),
        (F.col("y") + F.col("step.dy")).alias("oy"))
    there = filled.select("label", "size", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("blocks").alias("others"))
    meet = around.join(there, ["label", "size", "ox", "oy"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    mine, theirs = F.struct("x", "y", "block"), F.struct(F.col("ox").alias("x"), F.col("oy").alias("y"), F.col("other").alias("block"))
    tasks = meet.select(
        "label", "size", F.least(mine, theirs).alias("low"), F.greatest(mine, theirs).alias("high"), (mine > theirs).cast("int").alias("own"),
        (mine == theirs).cast("int").alias("same"), "id", "copies", "vector")
    found = written(tasks.groupBy("label", "size", "low", "high").applyInArrow(_linked(cosine), "id long, n long, root long"), "links")
    by_class = found.groupBy("id").agg(F.sum("n").alias("n"))
    named = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    grouped = nodes.select("class", "node", "label", "print", "vector", "copies").join(
        by_class.withColumnRenamed("id", "class"), "class", "left").join(named.withColumnRenamed("id", "class"), "class", "left")
    grouped = written(grouped.withColumn("component", F.coalesce("component", "class")), "classes")
    first = written(grouped.groupBy("component").agg(F.min("node").alias("first")), "components")
    classes = written(grouped.join(first, "component").select(
        "label", "print", "vector", "first", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    linked = good.join(classes, ["label", "print", "vector"]).select("id", "n_links", F.col("first").alias("component_id"))
    alone = source.where(~F.coalesce(usable, F.lit(False))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return linked.unionByName(alone).select(F.col("id").alias(id_column), "n_links", "component_id", kept.alias("kept"))
