"""Exact repeated strings of a given length, by merging Burrows-Wheeler transforms of shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallycast.llm.bitmap import bitmap, marked
from tallycast.llm.graph import written
from tallycast.llm.text import _BASE, _INVERSE, as_bytes, gathered, map_arrow, mix, powers, signed

LENGTH = 400
SHARD_BYTES, MERGE_BYTES = 1 << 18, 1 << 20
STEPS = 4
STARTS = 64
CONTENTS = 4096


def _sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=out[1:])
    return out


def _hash(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((sums[stop] - sums[start]) * powers(_INVERSE, len(sums))[start])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` values in a row, by running minima from both ends of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def anchored(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Units of a text: key, content hash, first start and number of starts.

    Every string of ``length`` bytes belongs to its anchor, the smallest hashed gram among its first half. The strings of
    one anchor that start in the same 64 bytes before it are a unit; its key hashes the bytes that all strings from those
    64 starts share. Equal strings have equal keys, and other texts share a key only if they share some 337 bytes.
    """
    n, width = len(text), max(length // 2, 1)
    if n < length:
        return tuple(np.zeros(0, dtype=kind) for kind in (np.uint64, np.uint64, np.int64, np.int64))
    data = np.frombuffer(text, dtype=np.uint8)
    sums = _sums(data)
    starts = n - length + 1
    places = np.arange(starts + width - 1)
    gram = min(12, length - width + 1)
    grams = _hash(sums, places, places + gram)
    low = np.uint64((1 << 28) - 1)
    anchor = (_least((grams & ~low) | places.astype(np.uint64), width) & low).astype(np.int64)
    size = max(1, min(STARTS, length // 4))
    block = (anchor - np.arange(starts)) // size
    first = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
    count = np.diff(first, append=starts)
    latest = anchor[first] - block[first] * size
    key = _hash(sums, latest, latest + length - size + 1) + block[first].astype(np.uint64)
    return key, _hash(sums, first, first + count + length - 1) + count.astype(np.uint64), first, count


def _spots(length: int):
    def run(rows):
        parts, size = [], 0
        for row, text in rows:
            if text and len(text) >= length:
                key, content, first, count = anchored(text, length)
                parts.append((signed(key), signed(content), np.full(len(key), row, dtype=np.int64), first, count.astype(np.int32)))
                size += len(key)
            if size > 50_000:
                yield [np.concatenate(c) for c in zip(*parts)]
                parts, size = [], 0
        if parts:
            yield [np.concatenate(c) for c in zip(*parts)]

    return run


def _texts(length: int):
    def run(rows):
        cut = (
            (u["key"], u["content"], u["n"], u["blocks"], text[u["at"] : u["at"] + u["n"] + length - 1]) for text, units in rows for u in units)
        yield from gathered(cut, [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()], weigh=lambda row: len(row[4]) + 64)

    return run


def _order(ranks: np.ndarray) -> np.ndarray:
    """A stable sort of ranks by two counting passes."""
    low = np.argsort((ranks & 0xFFFF).astype(np.uint16), kind="stable")
    if len(ranks) and ranks.max() < 1 << 16:
        return low
    return low[np.argsort((ranks[low] >> 16).astype(np.uint16), kind="stable")]


class Shard:
    """A transform of many strings: the suffixes in order of their context and the symbol before each.

    A symbol is a block of ``step`` bytes, named by its rank among all blocks of the merge; name 0 marks blocks that reach the
    end mark of a string. The order looks at ``steps`` blocks.
    """

    def __init__(self, names: np.ndarray, ends: np.ndarray, begins: np.ndarray, step: int, steps: int):
        self.suffixes = np.arange(len(names), dtype=np.int32)
        for i in range(steps - 1, -1, -1):
            ahead = self.suffixes + i * step
            inside = ahead < ends[self.suffixes]
            self.suffixes = self.suffixes[_order(np.where(inside, names[np.minimum(ahead, len(names) - 1)], 0))]
        before = self.suffixes - step
        self.has_before = before >= begins[self.suffixes]
        self.before = np.where(self.has_before, names[np.maximum(before, 0)], 0)
        self.tails = int((names == 0).sum())


def merge_shards(shards: list[Shard], step: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards' suffixes in the merged transform, and the common prefix with the row before.

    Suffixes are not sorted again. The interleave says only from which shard each merged row comes. One refinement
    sends every row to the bucket of the block before it, which sorts the suffixes by one more block; rows that stay together keep
    a common prefix of that many blocks. A border that first shows in round ``i`` has a common prefix of ``i - 1`` blocks;
    prefixes of ``steps`` blocks and more are reported as that.
    """
    kind = np.int16 if len(shards) < 1 << 15 else np.int32
    source = np.repeat(np.arange(len(shards), dtype=kind), [len(s.suffixes) for s in shards])
    tails = np.repeat(np.arange(len(shards), dtype=kind), [s.tails for s in shards])
    block = np.zeros(len(source), dtype=np.int32)
    prefix = np.full(len(source), steps * step, dtype=np.int32)
    open_rows = np.ones(len(source), dtype=bool)
    for turn in range(steps):
        symbol, valid = np.empty(len(source), dtype=np.int32), np.empty(len(source), dtype=bool)
        for i, shard in enumerate(shards):
            mine = source == i
            symbol[mine], valid[mine] = shard.before, shard.has_before
        rows = np.flatnonzero(valid)
        rows = rows[_order(symbol[rows])]
        bucket, old = symbol[rows], block[rows]
        source = np.concatenate([tails, source[rows]])
        fresh = np.ones(len(source), dtype=bool)
        fresh[len(tails) + 1 :] = (bucket[1:] != bucket[:-1]) | (old[1:] != old[:-1])
        block = np.cumsum(fresh, dtype=np.int32)
        prefix[fresh & open_rows] = turn * step
        open_rows &= ~fresh
    return source, prefix


def repeated_starts(texts: list[bytes], counts: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each string, which of its first ``counts`` starts open a string of ``length`` bytes that starts in another place too."""
    step = next(s for s in range(max(1, length // STEPS), 0, -1) if length % s == 0)
    steps = length // step
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int32)  # each string has an end mark
    data = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    ends, begins = np.repeat(offsets[1:], sizes), np.repeat(offsets[:-1], sizes)
    full = np.flatnonzero(np.arange(len(data)) + step < ends)
    names = np.zeros(len(data), dtype=np.int32)
    names[full] = np.unique(_hash(_sums(data), full, full + step), return_inverse=True)[1] + 1
    cuts = np.unique(np.searchsorted(offsets, np.arange(0, len(data), SHARD_BYTES)))
    cuts = np.append(cuts, len(texts))
    bounds = [(offsets[a], offsets[b]) for a, b in zip(cuts[:-1], cuts[1:]) if a < b]
    shards = [Shard(names[a:b], ends[a:b] - a, begins[a:b] - a, step, steps) for a, b in bounds]
    source, prefix = merge_shards(shards, step, steps)
    alike = prefix >= length
    repeated = alike | np.append(alike[1:], False)
    found = np.zeros(len(data), dtype=bool)
    for i, (shard, (a, _)) in enumerate(zip(shards, bounds)):
        found[a + shard.suffixes] = repeated[source == i]
    return [found[at : at + n] for at, n in zip(offsets, counts)]


def _merged(length: int):
    """Units arrive in order of their groups; whole groups are gathered up to the merge size and merged together.

    A content that stands in several groups at hand enters once.
    """

    def ranges(held):
        starts = repeated_starts([u[3] for u in held], np.array([u[2] for u in held]), length)
        out = [(u[1], a, b) for u, hit in zip(held, starts) for a, b in _pairs(hit)]
        return [pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))]

    def run(rows):
        held, size, last = {}, 0, None
        for unit in rows:
            if unit[0] != last and size >= MERGE_BYTES:
                yield ranges(list(held.values()))
                held, size = {}, 0
            if unit[1] not in held:
                size += len(unit[3])
            held[unit[1]] = unit
            last = unit[0]
        if held:
            yield ranges(list(held.values()))

    return run


def _pairs(flags: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(flags.astype(np.int8), prepend=np.int8(0), append=np.int8(0))).reshape(-1, 2)


def repeated_ranges(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """``[row, start, stop]``: byte ranges covered by repeated strings, of texts ``[row, text]``.

    Units whose key occurs once are left out through a bitmap of fixed size. Equal units are one string with a number of
    copies, so a text copied a million times is merged once; a key with one content repeats as a whole if it has copies. The
    other contents of a key meet in one task, where shards of a quarter megabyte are transformed and merged. A key with more than
    4096 contents is dealt out in blocks, of which every two meet in a task.
    """
    spots = written(map_arrow(rows, _spots(length), "key long, content long, row long, at long, n int"), "spots")
    twice = spots.groupBy("key").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")
    slots = written(bitmap(twice, "key"), "bitmap")
    near = written(marked(spots, slots, "key").where("marked").drop("marked"), "candidates")
    contents = near.groupBy("key", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "at", "n")).alias("one"))
    contents = written(contents.select("key", "content", "copies", "one.*"), "contents")
    mixed = contents.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CONTENTS).cast("int").alias("blocks"), F.count(F.lit(1)).alias("contents"))
    mixed = written(contents.join(written(mixed.where("contents > 1"), "mixed_keys"), "key"), "mixed_units")
    units = mixed.groupBy("row").agg(F.collect_list(F.struct("key", "content", "blocks", "at", "n")).alias("units"))
    holders = marked(rows, written(bitmap(mixed, "row", 22), "bitmap"), "row", 22).where("marked")
    one_each = holders.dropDuplicates(["row"]).join(units, "row").select("text", "units")
    cut = map_arrow(one_each, _texts(length), "key long, content long, n int, blocks int, text binary")
    own = F.pmod(F.xxhash64("content"), F.col("blocks"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("key", F.least(own, "other"), F.greatest(own, "other")).alias("group"), "content", "n", "text")
    sorted_units = dealt.repartition("group").sortWithinPartitions("group")
    inside = map_arrow(sorted_units, _merged(length), "content long, first int, past int")
    whole = contents.where("copies > 1").select("content", F.lit(0).alias("first"), F.col("n").alias("past"))
    hits = written(inside.unionByName(whole), "repeated_units")
    return near.join(hits, "content").select("row", (F.col("at") + F.col("first")).alias("start"),
                                             (F.col("at") + F.col("past") + (length - 1)).alias("stop"))


def _kept(text: bytes, ranges: list[dict]) -> tuple[list[tuple[int, int]], bytes]:
    spans: list[list[int]] = []
    for start, stop in sorted((r["start"], r["stop"]) for r in ranges):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], stop)
        else:
            spans.append([start, stop])
    ends = [0, *[stop for _, stop in spans]]
    starts = [*[start for start, _ in spans], len(text)]
    return spans, b"".join(text[a:b] for a, b in zip(ends, starts))


def _spanned(rows):
    cut = ((key, text, *_kept(text, ranges or [])) for key, text, ranges in rows)
    spanned = ((key, len(text), [a for a, _ in spans], [b for _, b in spans], left) for key, text, spans, left in cut)
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    yield from gathered(spanned, kinds, weigh=lambda row: len(row[4]) + 64)


def drop_repeated_strings(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: ``[id_column, n_bytes, span_starts, span_stops, kept]``.

    Each byte covered by a string of ``length`` bytes that also starts anywhere else, in the same or another document, is
    removed, overlaps included; strings are judged on the input. ``kept`` is what remains, as bytes; spans are the maximal
    removed runs. Null and empty texts have no bytes and no spans. A repeated row is a document of its own and a copy of
    the other. Null ids keep their rows; other columns are ignored. Equality rests on 64-bit hashes of blocks.
    """
    text = F.coalesce(as_bytes(text_column), F.lit(b""))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(id_column, text_column).alias("row"), text.alias("text"))
    ranges = written(repeated_ranges(rows.select("row", "text"), length).groupBy("row").agg(
        F.collect_set(F.struct("start", "stop")).alias("ranges")), "ranges")
    flagged = marked(rows, written(bitmap(ranges, "row", 22), "bitmap"), "row", 22)
    none = F.array().cast("array<bigint>")
    whole = flagged.where("not marked").select(
        "id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("span_starts"), none.alias("span_stops"), F.col("text").alias("kept"))
    some = flagged.where("marked").join(ranges, "row", "left").select("id", "text", "ranges")
    cut = map_arrow(some, _spanned, "id long, n_bytes long, span_starts array<long>, span_stops array<long>, kept binary")
    return whole.unionByName(cut).withColumnRenamed("id", id_column)
