"""Phrases of two to five words that occur together more often than their parts, counted in quotient filters."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from tallycast.llm.graph import written
from tallycast.llm.quotient_filter import CountingFilter, pack, unpack
from tallycast.llm.text import _BASE, _INVERSE, as_bytes, chunks, lists, map_arrow, mix, powers, signed
from tallycast.operators.dictionary import dense_ids

LONGEST, LEAST, TOP = 5, 100, 2000
NO_LANGUAGE = "und"
DICTIONARY = 1 << 22  # words a task looks up at a time
HELD_WORDS, HELD_KEYS = 200_000, 1 << 21  # counters that a task holds before it hands them on
PART = 1 << 20  # word ids that a task counts at a time
BUCKET = 1 << 20  # occurrences that one merging group is meant for
LEAST_BITS, MOST_BITS = 16, 27  # of the bitmap of frequent phrases, at most 16 MB
_PIECE, _SPACE = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_PIECE[[10, 11, 12, 13, *b".,;:!?"]] = True
_SPACE[[9, 32]] = True


def _words(held: list[tuple[str, bytes]]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased texts joined by line ends; start, end and hash of every word; whether a piece ends before it.

    A hash is that of the word in its language. A-Z are lower-cased.
    """
    joined = b"\n".join(text for _, text in held).lower() + b"\n"
    data = np.frombuffer(joined, dtype=np.uint8)
    piece = _PIECE[data]
    edge = np.flatnonzero(np.diff((piece | _SPACE[data]).view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    start, end = edge[0::2], edge[1::2]
    of_text = np.diff(np.searchsorted(start, np.cumsum([0] + [len(text) + 1 for _, text in held])))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=sums[1:])
        hashes = (sums[end] - sums[start]) * powers(_INVERSE, len(data))[start]
        hashes = mix(hashes + np.repeat(np.array([_name(lang) for lang, _ in held], dtype=np.uint64), of_text))
    ends = np.concatenate([[0], np.cumsum(piece)])
    new = np.ones(len(start), dtype=bool)
    new[1:] = ends[start[1:]] > ends[end[:-1]]
    return joined, start, end, np.maximum(hashes, np.uint64(1)), new


def _name(lang: str) -> int:
    """A random number for a language, unrelated to the hash of any word."""
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _counted(rows) -> Iterator[list]:
    """``[lang, word, hash, n]``: the words of a task, counted in pieces of bounded size."""
    known, counts, names = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=object)
    for held in chunks(rows):
        joined, start, end, hashes, _ = _words(held)
        langs = np.repeat(np.arange(len(held)), np.diff(np.searchsorted(start, np.cumsum([0] + [len(t) + 1 for _, t in held]))))
        found, first, n = np.unique(hashes, return_index=True, return_counts=True)
        at = np.searchsorted(known, found)
        old = np.zeros(len(found), dtype=bool) if not len(known) else known[np.minimum(at, len(known) - 1)] == found
        counts[at[old]] += n[old]
        fresh = np.empty(int((~old).sum()), dtype=object)
        fresh[:] = [(held[langs[i]][0], joined[start[i] : end[i]]) for i in first[~old]]
        known, counts, names = (np.concatenate(x) for x in ((known, found[~old]), (counts, n[~old]), (names, fresh)))
        order = np.argsort(known, kind="stable")
        known, counts, names = known[order], counts[order], names[order]
        if len(known) >= HELD_WORDS:
            yield [pa.array([x[0] for x in names], pa.string()), pa.array([x[1] for x in names], pa.binary()), signed(known), counts]
            known, counts, names = known[:0], counts[:0], names[:0]
    if len(known):
        yield [pa.array([x[0] for x in names], pa.string()), pa.array([x[1] for x in names], pa.binary()), signed(known), counts]


def count_words(docs: DataFrame) -> DataFrame:
    """``[lang, word, hash, n]`` for every word (as bytes) of every language of the documents ``[lang, text]``."""
    parts = map_arrow(docs.select("lang", "text"), _counted, "lang string, word binary, hash long, n long")
    return parts.groupBy("lang", "word").agg(F.min("hash").alias("hash"), F.sum("n").alias("n"))


def _hashed(rows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes of texts in order, with a zero before every piece, and the length of each text."""
    for held in chunks(rows):
        _, start, _, hashes, new = _words(held)
        at = np.arange(len(hashes)) + np.cumsum(new)
        out = np.zeros(len(hashes) + int(new.sum()), dtype=np.uint64)
        out[at] = hashes
        first = np.searchsorted(start, np.cumsum([0] + [len(text) + 1 for _, text in held]))
        yield out, np.diff(np.append(at, len(out) + 1)[first] - 1)


def _looked_up(hashes: np.ndarray, names: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The id of each hash, zero where it has none; ``names`` are sorted."""
    if not len(names):
        return np.zeros(len(hashes), dtype=np.int64)
    at = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
    return np.where(names[at] == hashes, ids[at], 0)


def encode_words(docs: DataFrame, vocabulary: DataFrame, size: int) -> DataFrame:
    """``[ids]``: each text as an array of word ids, with zeros before every piece and for other words.

    Tasks look up at most 4 million words at a time. A larger vocabulary takes one pass over the hashes of the words for each 4 million.
    """
    spark = docs.sparkSession

    def dictionary(low: int):
        part = vocabulary.where((F.col("id") > low) & (F.col("id") <= low + DICTIONARY)).select("hash", "id").toArrow()
        names, ids = part.column("hash").to_numpy().view(np.uint64), part.column("id").to_numpy()
        order = np.argsort(names)
        return spark.sparkContext.broadcast((names[order], ids[order]))

    def whole(rows):
        for hashes, lengths in _hashed(rows):
            yield [lists(_looked_up(hashes, *table.value), lengths)]

    def kept(rows):
        for hashes, lengths in _hashed(rows):
            yield [lists(signed(hashes), lengths), lists(np.zeros(len(hashes), dtype=np.int64), lengths)]

    if size <= DICTIONARY:
        table = dictionary(0)
        return written(map_arrow(docs.select("lang", "text"), whole, "ids array<long>"), "coded")
    coded = written(map_arrow(docs.select("lang", "text"), kept, "hashes array<long>, ids array<long>"), "hashed")
    for low in range(0, size, DICTIONARY):
        table = dictionary(low)

        def filled(batches, table=table):
            for batch in batches:
                hashes, ids = batch.column("hashes"), batch.column("ids")
                now = np.maximum(ids.flatten().to_numpy(), _looked_up(hashes.flatten().to_numpy().view(np.uint64), *table.value))
                yield pa.RecordBatch.from_arrays([hashes, lists(now, np.diff(ids.offsets.to_numpy()))], names=["hashes", "ids"])

        coded = written(coded.mapInArrow(filled, "hashes array<long>, ids array<long>"), "hashed")
    return coded.select("ids")


def _bit(words: list[np.ndarray], bits: int) -> np.ndarray:
    return words[0] >> np.uint64(64 - bits)


def _bitmap(phrases: DataFrame) -> tuple[np.ndarray, int]:
    """The frequent phrases ``[key]`` as bits of their quotients, at most 16 MB: a false hit costs counters, not results."""
    n = max(phrases.count(), 1)
    bits = min(max(math.ceil(math.log2(16 * n)), LEAST_BITS), MOST_BITS)
    slot = F.shiftrightunsigned("key", 64 - bits)
    words = phrases.select((slot / 64).cast("int").alias("slot"), F.expr("shiftleft(1L, cast(%s as int))" % f"shiftrightunsigned(key, {64 - bits}) % 64").alias("one"))
    part = words.groupBy("slot").agg(F.bit_or("one").alias("word")).toArrow()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[part.column("slot").to_numpy()] = part.column("word").to_numpy().view(np.uint64)
    return out, bits


def count_phrases(coded: DataFrame, size: int, id_bits: int, buckets: int, least: int, shorter: DataFrame | None) -> DataFrame:
    """``[ids, f, key]`` of the phrases of ``size`` words that occur ``least`` times: filters of tasks, merged by quotient.

    A phrase is counted only if both phrases of one word less that it holds may be among ``shorter``.
    """
    spark, columns = coded.sparkSession, -(-size // (64 // id_bits))
    seen = None if shorter is None else spark.sparkContext.broadcast(_bitmap(shorter))
    quotient_bits = max(buckets - 1, 0).bit_length()
    names = [f"w{i}" for i in range(columns)]

    def frequent(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        bitmap, bits = seen.value
        bit = _bit(pack([ids[at + i] for i in range(size - 1)], id_bits), bits)
        return (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1

    def emitted(counted: CountingFilter):
        runs = list(counted.by_quotient(quotient_bits))
        lengths = [len(run) for _, run in runs]
        for a in range(0, len(runs), 64):
            some, n = runs[a : a + 64], lengths[a : a + 64]
            yield [pa.array([q for q, _ in some], pa.int32()), *[lists(signed(np.concatenate([run.words[i] for _, run in some])), n) for i in range(columns)],
                   lists(np.concatenate([run.counts for _, run in some]).astype(np.int64), n)]

    def parts(batches):
        for batch in batches:
            column = batch.column("ids")
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
            cuts = np.unique(np.searchsorted(offsets, np.arange(offsets[0], offsets[-1] + PART, PART)).clip(0, len(offsets) - 1))
            for a, b in zip(cuts[:-1], cuts[1:]):
                yield values[offsets[a] : offsets[b]]

    def counted(batches):
        filters, held = [], 0
        for ids in parts(batches):
            if len(ids) < size:
                continue
            below = size if seen is None else size - 1
            known = ids > 0
            at = np.flatnonzero(np.logical_and.reduce([known[i : len(ids) - below + 1 + i] for i in range(below)]))
            if seen is not None:
                usual = np.zeros(len(ids) + 1, dtype=bool)
                usual[at[frequent(ids, at)]] = True
                at = np.flatnonzero(usual[:-1] & usual[1:])
            if not len(at):
                continue
            filters.append(CountingFilter.of(pack([ids[at + i] for i in range(size)], id_bits)))
            held += len(filters[-1])
            if held >= HELD_KEYS:
                filters = [CountingFilter.merged(filters)]
                held = len(filters[0])
                if held >= HELD_KEYS // 2:
                    yield from emitted(filters[0])
                    filters, held = [], 0
        if filters:
            yield from emitted(CountingFilter.merged(filters))

    def merged(table: pa.Table) -> pa.Table:
        columns_of = [table.column(name).combine_chunks().flatten().to_numpy() for name in (*names, "counts")]
        out = CountingFilter.of([w.view(np.uint64) for w in columns_of[:-1]], columns_of[-1]).at_least(least)
        ids = np.stack(unpack(out.words, size, id_bits), axis=1).astype(np.int64).ravel()
        return pa.table({"ids": lists(ids, [size] * len(out)), "f": out.counts, "key": signed(out.words[0])})

    schema = ", ".join(["bucket int", *[f"{name} array<long>" for name in names], "counts array<long>"])
    columns_out = [part.split()[0] for part in schema.split(", ")]
    shards = coded.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays(c, names=columns_out) for c in counted(batches)), schema)
    return written(shards.groupBy("bucket").applyInArrow(merged, "ids array<long>, f long, key long"), f"phrases{size}")


def mine_collocations(
    docs: DataFrame, text_column: str = "text", lang_column: str = "lang", longest: int = LONGEST, least: int = LEAST, top: int | None = TOP,
) -> DataFrame:
    """The best phrases of each language: ``[lang, rank, phrase, a, l, r, n, score]``.

    Texts are cut into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and tabs; A-Z are lower-cased, a null text is empty
    and a null language is ``und``. A phrase lies inside one piece and occurs ``least`` times. Of all cuts into two parts the one
    of the lowest ``score = floor(1000 * a * n / (l * r))`` counts, where ``a``, ``l`` and ``r`` are occurrences of the phrase and its
    parts and ``n`` of all words of the language; of equal scores the shortest first part. A phrase inside a longer one that occurs as
    often is left out. ``top`` phrases a language are returned, all for None, by score, then ``a``, then the bytes of the phrase.

    Words that occur ``least`` times get ids over all languages; phrases of two, three, ... words are packed ids in counting
    quotient filters, one a task, merged by quotient. Words are told apart by hashes of 64 bits, phrases by their ids, without loss.
    Every text is read whole; repeated rows count each time; other columns are ignored; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_column), F.lit(NO_LANGUAGE)).alias("lang"), F.coalesce(as_bytes(text_column), F.lit(b"")).alias("text"))
    counts = written(count_words(texts), "words")
    totals = written(counts.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    frequent = counts.where(F.col("n") >= least)
    vocabulary = written(dense_ids(frequent.select("lang", "word", "hash", "n"), ["lang", "word", "hash", "n"], "id").withColumn("id", F.col("id") + 1), "vocabulary")
    size = vocabulary.count()
    words, in_all = vocabulary.select(F.array("id").alias("ids"), F.col("n").alias("f")), totals.agg(F.sum("total")).first()[0] or 0
    coded = encode_words(texts, vocabulary, size)
    buckets, id_bits = max(1, in_all // BUCKET), max(1, size.bit_length())
    levels = []
    for n in range(2, longest + 1):
        levels.append(count_phrases(coded, n, id_bits, buckets, least, levels[-1].select("key") if levels else None))
    phrases = levels[0].select("ids", "f")
    for level in levels[1:]:
        phrases = phrases.unionByName(level.select("ids", "f"))
    scored = _scored(_independent(phrases), words.unionByName(phrases), vocabulary, totals)
    return _ranked(scored, vocabulary, top)


def _independent(phrases: DataFrame) -> DataFrame:
    """The phrases that no longer one explains. It is enough to look at those longer by a word: a phrase in between occurs no less often."""
    inner = F.explode(F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)")))
    inside = phrases.where(F.size("ids") > 2).select("f", inner.alias("ids")).groupBy("ids").agg(F.max("f").alias("covered"))
    return phrases.join(inside, "ids", "left").where("covered is null or 100 * covered < 100 * f").select("ids", "f")


def _scored(phrases: DataFrame, parts: DataFrame, vocabulary: DataFrame, totals: DataFrame) -> DataFrame:
    """``[ids, lang, a, l, r, n, score]`` by the cut of the lowest score."""
    known = vocabulary.select(F.col("id").alias("head"), "lang").join(totals, "lang")
    named = phrases.withColumn("head", F.col("ids")[0]).join(known, "head")
    cuts = named.withColumn("cut", F.explode(F.expr("sequence(1, size(ids) - 1)")))
    cuts = cuts.withColumn("first", F.expr("slice(ids, 1, cut)")).withColumn("rest", F.expr("slice(ids, cut + 1, size(ids))"))
    both = cuts.join(parts.select(F.col("ids").alias("first"), F.col("f").alias("l")), "first").join(
        parts.select(F.col("ids").alias("rest"), F.col("f").alias("r")), "rest")
    # Products of three counts fit into 38 digits and are divided as integers.
    score = F.expr("cast(1000 * cast(f as decimal(18, 0)) * cast(total as decimal(16, 0)) as decimal(38, 0)) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))")
    best = both.withColumn("score", score).groupBy("ids", "lang", "f", "total").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("ids", "lang", F.col("f").alias("a"), "best.l", "best.r", F.col("total").alias("n"), "best.score")


def _ranked(scored: DataFrame, vocabulary: DataFrame, top: int | None) -> DataFrame:
    scored = written(scored, "scored")
    if top is not None:
        place = F.rank().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
        scored = scored.withColumn("place", place).where(F.col("place") <= top)
    spelt = scored.select("*", F.posexplode("ids").alias("at", "id")).join(vocabulary.select("id", "word"), "id")
    phrase = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))), lambda x: x["word"]), " ")
    whole = spelt.groupBy("ids", "lang", "a", "l", "r", "n", "score").agg(phrase.alias("phrase"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.col("phrase").cast("binary"))).cast("long")
    ranked = whole.withColumn("rank", rank)
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
