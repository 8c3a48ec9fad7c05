"""Near-duplicate documents by fast similarity sketching (Dahlgaard, Knudsen and Thorup, 2017)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallycast.llm.graph import components, written
from tallycast.llm.text import _STEPS, as_bytes, chunks, lists, map_arrow, mix, shingle_set, signed, words

BANDS, ROWS = 32, 5
PERCENT = 75
SMALL_BUCKET = 48
BLOCK = 256
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_ROUND_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def fast_similarity_sketch(items: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """One 64-bit coordinate per bin for a set of hashed items; equal coordinates estimate the Jaccard similarity.

    In round ``r < size`` every item falls into one random bin with a random value; a bin keeps the smallest
    (round, value). From round ``size`` on, round ``r`` throws every item into bin ``r - size``, so that after
    ``2 * size`` rounds each coordinate is filled. Rounds stop as soon as all bins are.
    """
    out = np.full(size, _EMPTY, dtype=np.uint64)
    open_bins = size
    for turn in range(2 * size):
        value = mix(items ^ _ROUND_SEEDS[turn])
        ranked = (value & np.uint64(0xFFFFFFFF)) | np.uint64(turn << 32)
        if turn < size:
            thrown = np.full(size, _EMPTY, dtype=np.uint64)
            np.minimum.at(thrown, ((value >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32), ranked)
            np.minimum(out, thrown, out=out)
        elif out[turn - size] == _EMPTY:
            out[turn - size] = ranked.min()
        open_bins = int((out == _EMPTY).sum())
        if not open_bins:
            break
    return out


def band_hashes(sketch: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        grid = sketch.reshape(BANDS, ROWS) * _STEPS[:ROWS]
        return mix(grid.sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _STEPS[-1])


def _sketched(rows):
    """Per document: the size and a 128-bit fingerprint of its shingle set, and its band hashes."""
    for held in chunks((key, text or b"") for key, text in rows):
        _, _, hashes, offsets = words([text for _, text in held])
        sizes, high, low, bands = [], [], [], []
        for i in range(len(held)):
            items = shingle_set(hashes[offsets[i] : offsets[i + 1]])
            sizes.append(len(items))
            high.append(items.sum(dtype=np.uint64))
            low.append(mix(items ^ _STEPS[7]).sum(dtype=np.uint64))
            bands.append(band_hashes(fast_similarity_sketch(items)) if len(items) else items)
        yield [
            pa.array([key for key, _ in held], pa.int64()), np.array(sizes, dtype=np.int64), signed(np.array(high, dtype=np.uint64)),
            signed(np.array(low, dtype=np.uint64)), lists(signed(np.concatenate(bands)), map(len, bands)),
        ]


def _shingled(rows):
    for held in chunks((key, text or b"") for key, text in rows):
        _, _, hashes, offsets = words([text for _, text in held])
        sets = [shingle_set(hashes[offsets[i] : offsets[i + 1]]) for i in range(len(held))]
        yield [pa.array([key for key, _ in held], pa.int64()), lists(signed(np.concatenate(sets)), map(len, sets))]


def _common(rows):
    a_ids, b_ids = [], []
    for a, b, a_set, b_set in rows:
        x, y = np.array(a_set, dtype=np.int64), np.array(b_set, dtype=np.int64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        if 100 * both >= PERCENT * (len(x) + len(y) - both):
            a_ids.append(a)
            b_ids.append(b)
        if len(a_ids) == 4096:
            yield [pa.array(a_ids, pa.int64()), pa.array(b_ids, pa.int64())]
            a_ids, b_ids = [], []
    yield [pa.array(a_ids, pa.int64()), pa.array(b_ids, pa.int64())]


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``[a, b]`` whose full shingle sets ``[id, items]`` reach the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("a_items"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("b_items"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "a_items", "b_items")
    return map_arrow(joined, _common, "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: ``[id_column, n_shingles, component_id, kept]``.

    Sets of distinct 5-word shingles are sketched, cut into 32 bands of 5 coordinates and compared inside equal
    bands; a pair at similarity 0.75 shares a band with probability 0.9998. A link needs a similarity of 0.75 on the full
    sets. Documents with equal sets are one node. Inside a band value, all are first compared with one centre, the
    document that shares most band values. What is still in different components of that value is compared pair by
    pair: in a small value as pairs, in a large one by blocks of documents inside tasks, so no link is given up.

    Null, empty or blank text: no shingles, linked with nothing, kept. Fewer than five words: the whole sequence is the one
    shingle. A null id keeps its row, is its own component and links nothing. Extra columns are ignored. Repeated ids count as one
    document each row, in one component.
    """
    source = docs.select(F.col(id_column).cast("long").alias("id"), as_bytes(text_column).alias("text"))
    nodes = written(map_arrow(source, _sketched, "id long, n long, high long, low long, bands array<long>"), "sketches")
    known = nodes.where("id is not null and n > 0")
    first = known.groupBy("high", "low", "n").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"))
    copies = written(known.select("id", "high", "low", "n").join(
        written(first.where("copies > 1"), "classes"), ["high", "low", "n"]).select("id", "node"), "copies")
    members = copies.where("id <> node").select("id")
    heads = known.join(members, "id", "left_anti").select("id", F.posexplode("bands").alias("band", "value"))
    buckets = heads.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = written(heads.join(written(buckets, "buckets"), ["band", "value"]), "band_rows").where("size > 1")
    links = _links(rows, source)
    same = links.unionByName(copies.select(F.col("id").alias("a"), F.col("node").alias("b")))
    named = written(components(same), "components")
    joined = nodes.select("id", "n").join(named, "id", "left")
    component = F.coalesce(F.col("component"), F.col("id"))
    return joined.select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def _links(rows: DataFrame, source: DataFrame) -> DataFrame:
    """Confirmed links that connect everything the bands ``[id, band, value, size]`` bring together."""
    degree = rows.groupBy("id").agg(F.sum("size").alias("degree"))
    sets = written(
        map_arrow(source.join(degree, "id", "left_semi").distinct(), _shingled, "id long, items array<long>"), "sets")
    central = rows.join(degree, "id").groupBy("band", "value").agg(
        F.max_by("id", F.struct(F.col("degree"), -F.col("id"))).alias("centre"))
    spokes = rows.join(written(central, "centres"), ["band", "value"]).where("id <> centre")
    tried = written(spokes.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct(), "pairs")
    links = written(confirmed(tried, sets), "links")
    rows = _unsettled(rows, links)
    small, large = rows.where(F.col("size") <= SMALL_BUCKET), rows.where(F.col("size") > SMALL_BUCKET)
    left = small.select("band", "value", F.col("id").alias("x"), F.col("component").alias("cx"))
    right = small.select("band", "value", F.col("id").alias("y"), F.col("component").alias("cy"))
    rest = left.join(right, ["band", "value"]).where("x < y and cx <> cy").select(
        F.col("x").alias("a"), F.col("y").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    links = links.unionByName(confirmed(written(rest, "pairs"), sets))
    return links if large.isEmpty() else links.unionByName(_links_by_blocks(large, sets))


def _unsettled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of band values that still hold more than one component, with the component."""
    now = rows.join(components(links), "id", "left").withColumn("component", F.coalesce("component", "id"))
    now = written(now, "band_rows")
    spans = now.groupBy("band", "value").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return written(now.join(written(spans.select("band", "value"), "open_buckets"), ["band", "value"], "left_semi"), "band_rows")


def _links_by_blocks(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that join the components inside large band values: first inside blocks of documents, then what is
    still apart block against block. Only links that join two components leave a task, so they grow with the documents.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = rows.withColumn("own", F.pmod(F.xxhash64("id"), blocks).cast("int"))
    key = ["band", "value", "i", "j"]
    inside = own.select("band", "value", F.col("own").alias("i"), F.col("own").alias("j"), "own", "id", "component")
    links = written(inside.join(sets, "id").groupBy(*key).applyInArrow(_compared, "a long, b long"), "links")
    known = own.select(F.col("id").alias("a"), F.col("component").alias("b")).distinct()
    left = _unsettled(own.drop("component"), links.unionByName(known))
    if left.isEmpty():
        return links
    paired = left.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).where("own <> other").select(
        "band", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component")
    return links.unionByName(paired.join(sets, "id").groupBy(*key).applyInArrow(_compared, "a long, b long"))


def _compared(table: pa.Table) -> pa.Table:
    """Links between the documents of a block, or of two, that are in different components: one less than the components they join."""
    ids, groups, own = (table.column(name).to_numpy() for name in ("id", "component", "own"))
    items = table.column("items").combine_chunks()
    starts, ends = items.offsets.to_numpy()[:-1], items.offsets.to_numpy()[1:]
    _, flat = np.unique(items.values.to_numpy(), return_inverse=True)
    sizes, marked = ends - starts, np.zeros(len(flat) + 1, dtype=np.int64)
    _, member = np.unique(groups, return_inverse=True)
    across = own.min() != own.max()
    asking = np.flatnonzero(own == own.min() if across else member != np.bincount(member).argmax())
    against = own == own.max() if across else np.ones(len(ids), dtype=bool)
    a_ids, b_ids = [], []
    for x in asking:
        wanted = np.flatnonzero(against & (member != member[x]))
        if not len(wanted):
            continue
        mine = flat[starts[x] : ends[x]]
        marked[mine] = 1
        total = np.concatenate([[0], np.cumsum(marked[flat])])
        marked[mine] = 0
        both = total[ends[wanted]] - total[starts[wanted]]
        near = wanted[100 * both >= PERCENT * (sizes[x] + sizes[wanted] - both)]
        near = near[np.unique(member[near], return_index=True)[1]]
        a_ids.extend([ids[x]] * len(near))
        b_ids.extend(ids[near])
        member[np.isin(member, member[near])] = member[x]
    return pa.table({"a": pa.array(a_ids, pa.int64()), "b": pa.array(b_ids, pa.int64())})
