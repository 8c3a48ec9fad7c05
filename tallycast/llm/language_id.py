"""Language identification by cross-parsing: the language whose sample needs the fewest normalised phrases."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tallycast.llm.text import as_bytes, chunks

SAMPLE_SYMBOLS, SAMPLE_CHARS = 24_000, 600
MAX_LANGUAGES, MAX_TOTAL_SYMBOLS = 128, 1_000_000
ALPHABET, SEGMENT = 62, 1024
GAP, RARE = 0, 1


def held_out(id_column: str = "doc_id") -> Column:
    """The fifth of the documents that the model never learns from."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Languages:
    """Suffix automata of all languages in one transition table, and the alphabet they share.

    A state is the offset of its row; a negative entry ``~row`` means that a new phrase begins with this symbol. From
    ``starts``, the state before any text and after an unknown symbol, every symbol begins one.
    """

    names: list[str]
    letters: str
    table: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    def symbols(self, text: str) -> np.ndarray:
        """Lower-cased letters as symbols, each run of anything else as one gap."""
        codes = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32)
        out = _symbol_table(self.letters)[codes]
        keep = np.ones(len(out), dtype=bool)
        keep[1:] = (out[1:] != GAP) | (out[:-1] != GAP)
        return out[keep]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Number of greedy longest-match phrases per text (rows) and language (columns).

        Texts are cut into segments of 1024 symbols, each parsed on its own; all segments and languages advance
        together, one symbol a step, in NumPy.
        """
        owner, parts = [], []
        for i, text in enumerate(texts):
            for at in range(0, len(text), SEGMENT):
                owner.append(i)
                parts.append(text[at : at + SEGMENT])
        counts = np.zeros((len(texts), len(self.names)), dtype=np.int64)
        if not parts:
            return counts
        lengths = np.array([len(p) for p in parts])
        order = np.argsort(-lengths, kind="stable")
        grid = np.zeros((lengths.max(), len(parts)), dtype=np.int32)
        for lane, part in enumerate(order):
            grid[: lengths[part], lane] = parts[part]
        active = np.searchsorted(-lengths[order], -np.arange(lengths.max()), side="left")
        state = np.repeat(self.starts[:, None], len(parts), axis=1).astype(np.int32)
        found = np.zeros(state.shape, dtype=np.int32)
        for step, n in enumerate(active):
            now = self.table[state[:, :n] + grid[step, :n]]
            fresh = now < 0
            found[:, :n] += fresh
            state[:, :n] = np.where(fresh, ~now, now)
        np.add.at(counts, np.array(owner)[order], found.T)
        return counts


_symbol_tables: dict[str, np.ndarray] = {}


def _symbol_table(letters: str) -> np.ndarray:
    if letters not in _symbol_tables:
        table = np.array([RARE if chr(c).isalpha() else GAP for c in range(0x110000)], dtype=np.int8)
        for i, letter in enumerate(letters):
            table[ord(letter)] = i + 2
        _symbol_tables[letters] = table
    return _symbol_tables[letters]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that reads every substring (online construction); state 0 is the root."""
    moves, link, longest, last = [{}], [-1], [0], 0
    for symbol in symbols:
        new = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at != -1 and symbol not in moves[at]:
            moves[at][symbol] = new
            at = link[at]
        if at != -1:
            target = moves[at][symbol]
            if longest[target] == longest[at] + 1:
                link[new] = target
            else:
                copy = len(moves)
                moves.append(dict(moves[target]))
                longest.append(longest[at] + 1)
                link.append(link[target])
                while at != -1 and moves[at].get(symbol) == target:
                    moves[at][symbol] = copy
                    at = link[at]
                link[target] = link[new] = copy
        last = new
    return moves


def learn_languages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Languages:
    """Automata of a bounded sample of the labelled documents outside the held-out fifth.

    Documents are drawn by a hash of their id at a rate that gives each language a few hundred, of which the
    first 600 characters are used, up to 24,000 symbols a language, a million in all, and the 128 most frequent
    languages. Only this sample reaches the driver.
    """
    known = docs.where(F.col(lang_column).isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column))
    sizes = known.groupBy(lang_column).count().orderBy(F.desc("count"), lang_column).limit(MAX_LANGUAGES).collect()
    if not sizes:
        return Languages([], "", np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32), np.ones(0))
    quota = min(SAMPLE_SYMBOLS, MAX_TOTAL_SYMBOLS // len(sizes))
    wanted = 8 * quota // SAMPLE_CHARS
    rate = F.create_map(*[F.lit(x) for row in sizes for x in (row[0], min(1.0, wanted / row["count"]))])
    draw = F.pmod(F.xxhash64(id_column), F.lit(1 << 30)) / float(1 << 30)
    picked = known.where(draw < rate[F.col(lang_column)]).select(
        F.col(lang_column).alias("lang"), draw.alias("draw"), F.substring(F.col(text_column).cast("string"), 1, SAMPLE_CHARS).alias("text"))
    texts: dict[str, list[str]] = {}
    for row in sorted((r for r in picked.collect() if r["text"]), key=lambda r: (r["lang"], r["draw"], r["text"])):
        texts.setdefault(row["lang"], []).append(row["text"].lower())
    return _languages(texts, quota)


def _languages(texts: dict[str, list[str]], quota: int) -> Languages:
    tally: dict[str, float] = {}
    for own in texts.values():
        joined = "".join(own)
        for c in set(joined):
            if c.isalpha():
                tally[c] = tally.get(c, 0) + joined.count(c) / len(joined)
    letters = "".join(sorted(sorted(tally, key=lambda c: (-tally[c], c))[:ALPHABET]))
    width = len(letters) + 2
    out = Languages(sorted(texts), letters, np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32), np.ones(0))
    tables, starts, sizes, offset = [], [], [], 0
    for name in out.names:
        sample = np.concatenate([np.append(out.symbols(t), GAP) for t in texts[name]])[:quota]
        moves = suffix_automaton([int(s) if s != RARE else -1 for s in sample])
        unknown = len(moves)
        rows = np.full((unknown + 1, width), -1, dtype=np.int32)
        for state, targets in enumerate(moves):
            for symbol, target in targets.items():
                if symbol >= 0:
                    rows[state, symbol] = target
        begin = np.where(rows[0] >= 0, rows[0], unknown)
        places = np.where(rows >= 0, rows * width + offset, ~(begin * width + offset))
        tables.append(places.astype(np.int32).ravel())
        starts.append(offset + unknown * width)
        sizes.append(max(len(sample), 2))
        offset += places.size
    out.table, out.starts, out.sizes = np.concatenate(tables), np.array(starts, dtype=np.int32), np.array(sizes, dtype=np.float64)
    return out


def predict_language(
    docs: DataFrame, languages: Languages, id_column: str = "doc_id", text_column: str = "text", carry: list[str] | None = None,
) -> DataFrame:
    """``[id_column, held_out, lang_pred, score, bits]`` for every document, from its text alone.

    ``bits`` is the cross-parsing entropy of the best language: phrases times the bits of a place in its sample, per
    symbol. ``score`` is one minus its ratio to the second best, 1 with one language. Ties go to the first name.
    ``und`` with score 0 and null bits: null text, no letter in it, or no language learned. Repeated and null ids keep
    their rows. Whole texts are parsed; memory is bounded by one text and the tables, which are bounded by the sample.
    ``carry`` names columns to hand through; they replace the id in the result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(languages)

    def predicted(texts: list[bytes | None]):
        known = shared.value
        for held in chunks(((None, text or b"") for text in texts), 1 << 20):
            symbols = [known.symbols(text.decode(errors="replace")) for _, text in held]
            if not known.names:
                yield from [("und", 0.0, None)] * len(held)
                continue
            lengths = np.array([max(len(text), 1) for text in symbols])
            rates = known.phrases(symbols) * np.log2(known.sizes) / lengths[:, None]
            order = np.argsort(rates, axis=1, kind="stable")
            for i, text in enumerate(symbols):
                if not (text != GAP).any():
                    yield "und", 0.0, None
                    continue
                best = float(rates[i, order[i, 0]])
                yield known.names[order[i, 0]], 1.0 if len(known.names) == 1 else 1.0 - best / float(rates[i, order[i, 1]]), best

    def run(batches):
        for batch in batches:
            found = list(predicted(batch.column("__text").to_pylist()))
            names, scores, bits = zip(*found) if found else ((), (), ())
            columns = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("__carried"), *columns], names=["__carried", "lang_pred", "score", "bits"])

    carried = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.col(f"`{id_column}`"))
    source = docs.select(carried.alias("__carried"), as_bytes(text_column).alias("__text"))
    schema = T.StructType([
        source.schema["__carried"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("bits", T.DoubleType())])
    found = source.mapInArrow(run, schema)
    if carry:
        return found.select("__carried.*", "lang_pred", "score", "bits")
    return found.select(F.col(f"__carried.`{id_column}`"), held_out(f"__carried.`{id_column}`").alias("held_out"), "lang_pred", "score", "bits")
