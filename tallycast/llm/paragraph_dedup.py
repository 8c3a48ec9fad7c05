"""Removal of passages that repeat across documents: paragraph MinHash banding with exact verification."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from tallycast.llm.bitmap import bitmap, marked
from tallycast.llm.graph import components, written
from tallycast.llm.minhash_dedup import SMALL_BUCKET, _links_by_blocks, _unsettled
from tallycast.llm.text import CHUNK_BYTES, SHINGLE, _BASE, _INVERSE, _STEPS, as_bytes, chunks, lists, map_arrow, mix, powers, shingles, signed, words

#: A paragraph starts at the smallest word-pair hash of any 20 in a row and ends where the next one starts.
WINDOW = 20
#: Runs of repeated paragraphs under 16 words stay.
MIN_RUN = 16
PERCENT, RECALL = 75, 0.98
#: MinHash values that make up a band: two leave few pairs that are not similar in a band value.
ROWS = 2
LEFT, RIGHT = 0, 1
AROUND = "id long, start int, stop int, fp long, side int, words array<long>"
BANDED = "band int, value long, fp long, id long, start int, stop int"


def bands_for(similarity: float = PERCENT / 100, recall: float = RECALL, rows: int = 1) -> int:
    """The number of bands with which a pair at the similarity collides with at least the wanted probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


BANDS = bands_for(rows=ROWS)


def paragraphs(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and end of every paragraph of a text that has at least one shingle.

    Borders depend on the words around them only, so a repeated passage is cut alike wherever it stands, but for the
    paragraphs at its ends. Paragraphs do not overlap and have up to 20 words; those under five words are left out.
    """
    n = len(hashes)
    borders = np.zeros(1, dtype=np.int64)
    if n > WINDOW:
        with np.errstate(over="ignore"):
            pairs = mix(hashes[:-1] * _STEPS[0] + hashes[1:] * _STEPS[1])
        least = sliding_window_view(pairs, WINDOW).argmin(axis=1) + np.arange(n - WINDOW)
        borders = np.unique(np.concatenate([borders, least]))
    ends = np.append(borders[1:], n)
    full = ends - borders >= SHINGLE
    return borders[full], ends[full]


def least_places(values: np.ndarray, window: int) -> np.ndarray:
    """The place of the first smallest value in every ``window`` values in a row, by windows of doubled width."""
    places, width = np.arange(len(values), dtype=np.int32), 1
    while width < window:
        step = min(width, window - width)
        right = values[step:] < values[:-step]
        values = np.where(right, values[step:], values[:-step])
        places = np.where(right, places[step:], places[:-step])
        width += step
    return places


def prints(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of the words of each range."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * powers(_BASE, len(hashes)), out=sums[1:])
        return mix((sums[end] - sums[start]) * powers(_INVERSE, len(hashes) + 1)[start] + (end - start).astype(np.uint64))


def _chunked(rows):
    """Keys, word hashes and word offsets of many texts at a time."""
    for held in chunks((key, text) for key, text in rows if text):
        _, _, hashes, offsets = words([text for _, text in held])
        yield [key for key, _ in held], hashes, offsets


def paragraphs_of(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The paragraphs of many texts at once, as :func:`paragraphs` gives them: first words and ends among all words, and the first paragraph of each text."""
    counts = np.diff(offsets)
    owner = np.repeat(np.arange(len(counts)), counts)
    borders = offsets[:-1][counts > 0]
    if len(hashes) > WINDOW:
        with np.errstate(over="ignore"):
            pairs = mix(hashes[:-1] * _STEPS[0] + hashes[1:] * _STEPS[1])
        inside = owner[: len(hashes) - WINDOW] == owner[WINDOW:]
        is_border = np.zeros(len(hashes), dtype=bool)
        is_border[borders] = True
        is_border[least_places(pairs, WINDOW)[inside]] = True
        borders = np.flatnonzero(is_border)
    ends = np.append(borders[1:], len(hashes))
    if len(borders):
        ends = np.minimum(ends, offsets[1:][owner[borders]])
    full = ends - borders >= SHINGLE
    borders, ends = borders[full], ends[full]
    return borders, ends, np.searchsorted(borders, offsets)


def _valued(rows):
    """Of the paragraphs of many texts at a time: the texts' keys, word offsets and first paragraphs, then starts and ends among all words,
    fingerprints, and one row of values per band."""
    for keys, hashes, offsets in _chunked(rows):
        start, end, first = paragraphs_of(hashes, offsets)
        if not len(start):
            continue
        flat = np.append(shingles(hashes), np.uint64(0))
        cuts = np.stack([start, end - 4], axis=1).ravel()
        values = []
        with np.errstate(over="ignore"):
            for band in range(BANDS):
                least = [np.minimum.reduceat(mix(flat ^ _STEPS[8 + band * ROWS + i]), cuts)[::2] * _STEPS[i] for i in range(ROWS)]
                values.append(mix(sum(least) + np.uint64(band)))
        yield keys, offsets, first, start, end, prints(hashes, start, end), np.stack(values)


def _values(rows):
    """Of every text with a paragraph: its key, starts and ends, their fingerprints, and one row of values per band."""
    for keys, offsets, first, start, end, own, values in _valued(rows):
        for i, key in enumerate(keys):
            a, b = first[i], first[i + 1]
            if a < b:
                yield key, start[a:b] - offsets[i], end[a:b] - offsets[i], own[a:b], values[:, a:b]


def _placed(rows):
    """Of the paragraphs of many texts at a time: key, start and end in the text, fingerprint, and one row of values per band."""
    for keys, offsets, first, start, end, own, values in _valued(rows):
        counts = np.diff(first)
        begin = np.repeat(offsets[:-1], counts)
        yield np.repeat(np.array(keys, dtype=np.int64), counts), start - begin, end - begin, own, values


def _met(rows):
    """``[value, who]``: every band value with the paragraph's fingerprint, and every fingerprint with a hash of its place."""
    for key, start, _, own, values in _placed(rows):
        with np.errstate(over="ignore"):
            place = mix(key.view(np.uint64) * _STEPS[2] + start.astype(np.uint64) * _STEPS[3])
        yield [signed(np.append(values.ravel(), own)), signed(np.append(np.tile(own, BANDS), place))]


def _banded(rows):
    """One row per paragraph and band, and one more, numbered as the band after the last, with the fingerprint as its value."""
    for key, start, end, own, values in _placed(rows):
        n = BANDS + 1
        yield [np.repeat(np.arange(n, dtype=np.int32), len(start)), signed(np.append(values.ravel(), own)), signed(np.tile(own, n)),
               np.tile(key, n), np.tile(start.astype(np.int32), n), np.tile(end.astype(np.int32), n)]


def _sets(rows):
    """``[id, items]``: the fingerprint and the different shingles of every paragraph."""
    for _, hashes, offsets in _chunked(rows):
        start, end, _ = paragraphs_of(hashes, offsets)
        if not len(start):
            continue
        flat, sizes = shingles(hashes), end - 4 - start
        at = np.arange(sizes.sum()) + np.repeat(start - np.cumsum(sizes) + sizes, sizes)
        items, owner = flat[at], np.repeat(np.arange(len(start)), sizes)
        again = np.zeros(len(items), dtype=bool)
        for step in range(1, sizes.max()):
            again[step:] |= (items[step:] == items[:-step]) & (owner[step:] == owner[:-step])
        yield [signed(prints(hashes, start, end)), lists(signed(items[~again]), np.bincount(owner[~again], minlength=len(start)))]


def _runs(covered: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of true, in turn."""
    return np.flatnonzero(np.diff(covered.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))


def around(hashes: np.ndarray, offsets: np.ndarray, text: np.ndarray, start: np.ndarray, stop: np.ndarray, side: np.ndarray) -> list[np.ndarray]:
    """For each paragraph and side, the words before it, nearest first, or after it, as far as a border of it may be cut otherwise elsewhere.

    ``start`` and ``stop`` are places among the words of all texts, ``text`` the text's number. The words reach past the next
    whole paragraph that is cut alike wherever all of these words stand, so a repeated passage
    that goes on beyond them has a repeated paragraph there. A border depends on the words within a window on either side.
    """
    starts, ends, first = paragraphs_of(hashes, offsets)
    margin = WINDOW + 1
    after, before = np.searchsorted(starts, stop + margin), np.searchsorted(ends, start - margin, side="right") - 1
    low, high = offsets[text], offsets[text + 1]
    last = np.where(after < first[text + 1], np.minimum(np.append(ends, 0)[after] + margin, high), high)
    begin = np.where(before >= first[text], np.maximum(np.append(starts, 0)[before] - margin, low), low)
    return [hashes[b:s][::-1] if one == LEFT else hashes[e:z] for b, s, e, z, one in zip(begin, start, stop, last, side)]


def _reach(hashes: np.ndarray, at: np.ndarray, step: int, room: np.ndarray, other: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each place, how many words from it on, ``step`` by step and at most ``room``, equal ``other[first : first + size]`` one by one."""
    n = np.minimum(size, room)
    ends = np.cumsum(n)
    turn = np.arange(n.sum()) - np.repeat(ends - n, n)
    unlike = np.flatnonzero(hashes[np.repeat(at, n) + step * turn] != other[np.repeat(first, n) + turn])
    next_ = np.searchsorted(unlike, ends - n)
    stop = np.append(unlike, n.sum())[next_]
    return np.minimum(stop, ends) - (ends - n)


def _cut_texts(texts: list[bytes], text: np.ndarray, ranges: dict[str, np.ndarray]):
    """Of each text: words, removed words, removed runs and the text without its word ranges.

    ``text`` has the number of the text of each of the ``ranges``, given by column: start, stop, fp, side, and its words around as the
    places ``first`` and ``size`` in ``around``. A range counts only where its words have the fingerprint it was found with. It goes on
    word by word as long as the words are those around the kept copy. Fewer than five words between two ranges go with them;
    then runs under 16 words stay.
    """
    start, end, hashes, offsets = words(texts)
    base = np.cumsum([0] + [len(t) + 1 for t in texts])
    fit = np.flatnonzero(ranges["stop"] <= np.diff(offsets)[text])
    begin, stop = offsets[text[fit]] + ranges["start"][fit], offsets[text[fit]] + ranges["stop"][fit]
    good = signed(prints(hashes, begin, stop)) == ranges["fp"][fit]
    fit, begin, stop = fit[good], begin[good], stop[good]
    low, high = offsets[text[fit]], offsets[text[fit] + 1]
    other, first, size = ranges["around"].view(np.uint64), ranges["first"][fit], ranges["size"][fit]
    left = ranges["side"][fit] == LEFT
    before = _reach(hashes, begin - 1, -1, begin - low, other, first, np.where(left, size, 0))
    behind = _reach(hashes, stop, 1, high - stop, other, first, np.where(left, 0, size))
    steps = np.bincount(begin - before, minlength=len(hashes) + 1) - np.bincount(stop + behind, minlength=len(hashes) + 1)
    covered = np.cumsum(steps)[:-1] > 0
    for i, own in enumerate(texts):
        a, b = offsets[i], offsets[i + 1]
        edges = _runs(covered[a:b])
        if len(edges):
            between = edges[2::2] - edges[1:-1:2]
            joined = np.repeat(between < SHINGLE, 2)
            edges = edges[~np.concatenate([[False], joined, [False]])]
            edges = edges[np.repeat(edges[1::2] - edges[0::2] >= MIN_RUN, 2)]
        kept, at = [], 0
        for first_word, last_word in zip(edges[0::2], edges[1::2]):
            kept.append(own[at : start[a + first_word] - base[i]])
            at = end[a + last_word - 1] - base[i]
        yield b - a, int((edges[1::2] - edges[0::2]).sum()), len(edges) // 2, b"".join([*kept, own[at:]]) if kept else own


def repeated_paragraphs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``[id, start, stop, fp, kept]``: the word ranges that repeat a paragraph, and the place and fingerprint of the kept copy.

    Each paragraph has two MinHash values of its 5-word shingles per band, as many bands as the wanted recall needs. Equal
    fingerprints are one class, of which the first by (id, word) stays. Classes that share a value are linked at similarity
    0.75 of their full shingle sets, whatever the number of them that share it (``_links``); of every component the first by (id, word) stays.

    Values and fingerprints that two paragraphs share are counted over all rows, and only their rows are shuffled whole.
    """
    source = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), as_bytes(text_column).alias("text"))
    met = map_arrow(source, _met, "value long, who long").groupBy("value").agg(F.min("who").alias("low"), F.max("who").alias("high"))
    shared = written(met.where("low <> high").select("value"), "shared_values")
    slots = written(bitmap(shared, "value"), "bitmap")
    found = marked(map_arrow(source, _banded, BANDED), slots, "value").where("marked").drop("marked")
    found = written(found.join(shared, "value", "left_semi"), "band_rows")
    places = found.groupBy("fp").agg(F.min(F.struct("id", "start", "stop")).alias("at"))
    places = written(places, "places")
    equal = found.where(F.col("band") == BANDS)
    again = equal.join(places, "fp").where(F.struct("id", "start", "stop") != F.col("at")).select(
        "id", "start", "stop", "fp", F.struct("at.*", "fp").alias("kept"))
    classes = found.where(F.col("band") < BANDS).select("band", "value", F.col("fp").alias("id")).distinct()
    sizes = classes.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = written(classes.join(sizes, ["band", "value"]), "class_rows")
    named = components(_links(rows, source))
    best = written(places.join(named, F.col("fp") == F.col("id")).select("fp", "at", "component"), "members")
    first = written(best.groupBy("component").agg(F.min(F.struct("at.*", "fp")).alias("kept")), "first_members")
    similar = best.join(first, "component").where(F.col("fp") != F.col("kept.fp")).select("at.id", "at.start", "at.stop", "fp", "kept")
    return again.unionByName(similar).distinct()


def _links(rows: DataFrame, source: DataFrame) -> DataFrame:
    """Links ``[a, b]`` that connect every two similar classes of a band value, of ``[id, band, value, size]``.

    All classes of a value are first compared with one centre. Those still in different components are then compared as pairs
    in a small value, block against block in a large one.
    """
    wanted = written(rows.groupBy("id").agg(F.sum("size").alias("degree")), "classes")
    slots = written(bitmap(wanted, "id"), "bitmap")
    sets = marked(map_arrow(source, _sets, "id long, items array<long>"), slots, "id").where("marked")
    sets = written(sets.groupBy("id").agg(F.first("items").alias("items")).join(wanted, "id", "left_semi"), "sets")
    central = rows.join(wanted, "id").groupBy("band", "value").agg(
        F.max_by("id", F.struct(F.col("degree"), -F.col("id"))).alias("centre"))
    spokes = rows.join(written(central, "centres"), ["band", "value"]).where("id <> centre")
    tried = written(spokes.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct(), "pairs")
    links = written(_linked(tried, sets), "links")
    rows = _unsettled(rows, links)
    small, large = rows.where(F.col("size") <= SMALL_BUCKET), rows.where(F.col("size") > SMALL_BUCKET)
    left = small.select("band", "value", F.col("id").alias("a"), F.col("component").alias("ca"))
    right = small.select("band", "value", F.col("id").alias("b"), F.col("component").alias("cb"))
    rest = left.join(right, ["band", "value"]).where("a < b and ca <> cb").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    links = links.unionByName(_linked(written(rest, "pairs"), sets))
    return links if large.isEmpty() else links.unionByName(_links_by_blocks(large, sets))


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    joined = pairs.join(sets.toDF("a", "a_items"), "a").join(sets.toDF("b", "b_items"), "b")
    both = F.size(F.array_intersect("a_items", "b_items"))
    return joined.where(100 * both >= PERCENT * (F.size("a_items") + F.size("b_items") - both)).select("a", "b")


def _with_words_around(ranges: DataFrame, source: DataFrame) -> DataFrame:
    """``[id, start, stop, fp, side, words]``: a row per open side of a range, with the words on that side of its kept copy.

    A side is open if no other range of the document borders on it. A range without an open side has one row without words.
    """
    near = W.partitionBy("id").orderBy("start", "stop")
    left = F.when(F.coalesce(F.lag("stop").over(near) < F.col("start"), F.lit(True)), LEFT)
    right = F.when(F.coalesce(F.lead("start").over(near) > F.col("stop"), F.lit(True)), RIGHT)
    sides = ranges.withColumn("sides", F.array_compact(F.array(left, right)))
    sides = written(sides.withColumn("side", F.explode_outer("sides")).drop("sides"), "sides")
    key = ["kept", "side"]
    wanted = written(sides.where("side is not null").select(*key).distinct(), "wanted")
    wanted = wanted.withColumn("id", F.col("kept.id"))
    slots = written(bitmap(wanted, "id", 22), "bitmap")
    holders = marked(source, slots, "id", 22).where("marked").drop("marked")
    asked = wanted.groupBy("id").agg(F.collect_list(F.struct("kept.start", "kept.stop", "kept.fp", "side")).alias("asked"))
    words_ = map_arrow(holders.join(asked, "id").select("id", "text", "asked"), _words_around, AROUND)
    one_each = words_.groupBy("id", "start", "stop", "fp", "side").agg(F.min("words").alias("words"))
    around_ = written(one_each.select(F.struct("id", "start", "stop", "fp").alias("kept"), "side", "words"), "around")
    return sides.join(around_, key, "left").select("id", "start", "stop", "fp", "side", "words")


def _words_around(rows):
    for held in chunks((text or b"", text or b"", key, asked) for key, text, asked in rows):
        _, _, hashes, offsets = words([text for text, *_ in held])
        found = [(i, key, one["start"], one["stop"], one["fp"], one["side"]) for i, (_, _, key, asked) in enumerate(held) for one in asked]
        text, key, start, stop, fp, side = (np.array(c, dtype=np.int64) for c in zip(*found))
        fit = stop <= np.diff(offsets)[text]
        text, key, start, stop, fp, side = (c[fit] for c in (text, key, start, stop, fp, side))
        right = signed(prints(hashes, start + offsets[text], stop + offsets[text])) == fp
        text, key, start, stop, fp, side = (c[right] for c in (text, key, start, stop, fp, side))
        if len(key):
            parts = around(hashes, offsets, text, start + offsets[text], stop + offsets[text], side)
            yield [key, start.astype(np.int32), stop.astype(np.int32), fp, side.astype(np.int32), lists(signed(np.concatenate(parts)), map(len, parts))]


def drop_repeated_paragraphs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the repeated paragraphs cut out of the text, and ``n_words``, ``n_removed``
    and ``n_spans``: words of the text, words removed, and runs of them.

    Of each group of equal or similar paragraphs the first by (id, word) stays; the others go with the words around them that
    are the same as around the one that stays. Texts without a removed range are not shuffled.
    Null text stays null, empty text empty, with zero counts. Rows with a null id are neither compared nor cut. Rows that
    share an id are cut where their own words match. Input columns named like the three counts are replaced.
    """
    docs = docs.drop("n_words", "n_removed", "n_spans")
    ranges = written(repeated_paragraphs(docs, id_column, text_column), "ranges")
    source = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), as_bytes(text_column).alias("text"))
    slots = written(bitmap(ranges, "id", 22), "bitmap")
    flagged = marked(docs.withColumn("__id", F.col(id_column).cast("long")), slots, "__id", 22)
    count = F.coalesce(F.regexp_count(F.col(text_column).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = flagged.where(~F.col("marked")).select(*columns, count.alias("n_words"), zero.alias("n_removed"), zero.alias("n_spans"))
    by_doc = _with_words_around(ranges, source).groupBy("id").agg(F.collect_set(F.struct("start", "stop", "fp", "side", "words")).alias("__ranges")).withColumnRenamed("id", "__id")
    some = flagged.where("marked").join(by_doc, "__id", "left")
    return whole.unionByName(_without_ranges(some, docs, text_column))


def _slices(batch: pa.RecordBatch):
    """The rows of a batch in parts of about the usual number of bytes of text."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    part = total // CHUNK_BYTES
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def _cut_rows(texts: pa.Array, ranges: pa.Array) -> list[pa.Array]:
    """The columns that :func:`_cut_texts` makes of texts and their lists of ranges."""
    flat = ranges.flatten()
    text = np.repeat(np.arange(len(ranges)), pc.fill_null(pc.list_value_length(ranges), 0).to_numpy(zero_copy_only=False))
    columns = {name: flat.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("start", "stop", "fp")}
    columns["side"] = flat.field("side").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    around_ = flat.field("words")
    columns["size"] = pc.fill_null(pc.list_value_length(around_), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    columns["around"] = np.ascontiguousarray(around_.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
    columns["first"] = np.cumsum(columns["size"]) - columns["size"]
    null = texts.is_null().to_numpy(zero_copy_only=False)
    counts, removed, spans, left = zip(*_cut_texts([x or b"" for x in texts.to_pylist()], text, columns))
    return [*(pa.array(c, pa.int64()) for c in (counts, removed, spans)), pa.array([None if n else x for n, x in zip(null, left)], pa.binary())]


def _without_ranges(some: DataFrame, docs: DataFrame, text_column: str) -> DataFrame:
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_column]).alias("others")
    carried = some.select(others, as_bytes(text_column).alias("text"), F.col("__ranges").alias("ranges"))

    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                rows = _cut_rows(part.column("text"), part.column("ranges"))
                yield pa.RecordBatch.from_arrays([part.column("others"), *rows], names=["others", "n_words", "n_removed", "n_spans", "left"])

    schema = T.StructType([carried.schema["others"], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_removed", "n_spans")],
                           T.StructField("left", T.BinaryType())])
    done = carried.mapInArrow(run, schema)
    text = F.col("left").cast("string").alias(text_column)
    return done.select(*[text if c == text_column else F.col(f"others.`{c}`") for c in docs.columns], "n_words", "n_removed", "n_spans")
