"""Words and shingles of many documents at once, as NumPy arrays inside Spark tasks.

A word is a run of bytes other than space and 0x09-0x0D of the UTF-8 text; A-Z are lower-cased. Hashes are 64 bits:
a polynomial over the bytes with a random odd base, passed through a bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

CHUNK_BYTES = 1 << 19
SHINGLE = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEPS = np.random.default_rng(20260).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def as_bytes(column: str) -> Column:
    """The text as UTF-8 bytes, so that Arrow hands it over without decoding."""
    return F.col(column).cast("binary")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i below n; kept per process up to the usual chunk length."""
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        grown = np.full(max(n, CHUNK_BYTES + 4096 if n <= CHUNK_BYTES + 4096 else n), base, dtype=np.uint64)
        grown[0] = 1
        kept = np.cumprod(grown)
        if len(kept) <= 4 * CHUNK_BYTES:
            _powers[base] = kept
    return kept[:n]


def chunks(rows: Iterable[tuple], size: int = CHUNK_BYTES) -> Iterator[list[tuple]]:
    """Rows ``(key, bytes, ...)`` in lists of about ``size`` bytes; a longer text is a list of its own."""
    held, total = [], 0
    for row in rows:
        n = len(row[1])
        if held and total + n > size:
            yield held
            held, total = [], 0
        held.append(row)
        total += n + 1
    if held:
        yield held


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word of all texts, and the offsets of each text's words.

    Starts and ends are positions in the texts joined by one separator byte.
    """
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", dtype=np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=np.int8(1), append=np.int8(1)))
    start, end = edge[0::2], edge[1::2]
    base = np.cumsum([0] + [len(t) + 1 for t in texts])
    offsets = np.searchsorted(start, base)
    if not len(start):
        return start, end, np.zeros(0, dtype=np.uint64), offsets
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=sums[1:])
        hashes = mix((sums[end] - sums[start]) * powers(_INVERSE, len(data))[start])
    return start, end, hashes, offsets


def shingles(word_hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of every run of ``size`` words, in order; of the whole sequence if it is shorter; none without words."""
    n = len(word_hashes)
    if not n:
        return word_hashes
    with np.errstate(over="ignore"):
        if n < size:
            return mix((word_hashes * _STEPS[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n))
        out = word_hashes[: n - size + 1] * _STEPS[0]
        for i in range(1, size):
            out = out + word_hashes[i : n - size + 1 + i] * _STEPS[i]
        return mix(out)


def shingle_set(word_hashes: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    return np.unique(shingles(word_hashes, size))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, column by column and never more than one batch in memory."""
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns])


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``function`` takes the row tuples of a partition and yields lists of columns in the order of ``schema``."""

    def run(batches):
        for columns in function(rows_of(batches)):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    names = [part.split()[0] for part in schema.split(", ")]
    return df.mapInArrow(run, schema)


def gathered(rows: Iterable[tuple], kinds: list[pa.DataType], size: int = CHUNK_BYTES, weigh=lambda row: 64) -> Iterator[list[pa.Array]]:
    """Row tuples as columns, in batches of about ``size`` by the given weight."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += weigh(row)
        if total >= size:
            yield [pa.array(list(values), kind) for values, kind in zip(zip(*held), kinds)]
            held, total = [], 0
    if held:
        yield [pa.array(list(values), kind) for values, kind in zip(zip(*held), kinds)]


def lists(values: np.ndarray, lengths: Iterable[int]) -> pa.Array:
    """A column of arrays over one flat buffer."""
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(lengths, dtype=np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
