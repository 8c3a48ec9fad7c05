"""Counting quotient filters without loss: exact counters of packed ids, kept in the order of a permutation.

A tuple of ids is packed into 64-bit words and its first word is permuted by a bijection that depends on the other words.
The high bits of the permuted word, the quotient, name a slot; everything else is the remainder and is stored in full, so a counter belongs
to one tuple exactly and the tuple can be read back. Filters of shards are sorted runs and merge by one pass over both.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tallycast.llm.text import mix

# The multipliers of text.mix, to be undone here.
_FIRST, _SECOND = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_UNDO_FIRST, _UNDO_SECOND = np.uint64(pow(_FIRST, -1, 1 << 64)), np.uint64(pow(_SECOND, -1, 1 << 64))
_TWEAK = np.uint64(0xA24BAED4963EE407)


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of :func:`tallycast.llm.text.mix`."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * _UNDO_SECOND
        x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * _UNDO_FIRST
        return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def _tweak(words: list[np.ndarray]) -> np.ndarray | np.uint64:
    out = np.uint64(0)
    with np.errstate(over="ignore"):
        for word in words[1:]:
            out = mix((out ^ word) + _TWEAK)
    return out


def pack(ids: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """The permuted words of tuples given as one array of ids per place; each id has ``bits`` bits, at most 64."""
    each = 64 // bits
    words = []
    for at in range(0, len(ids), each):
        word = np.zeros(len(ids[0]), dtype=np.uint64)
        for i, values in enumerate(ids[at : at + each]):
            word |= values.astype(np.uint64) << np.uint64(bits * i)
        words.append(word)
    words[0] = mix(words[0] ^ _tweak(words))
    return words


def unpack(words: list[np.ndarray], size: int, bits: int) -> list[np.ndarray]:
    """The ids that :func:`pack` was given."""
    words = [unmix(words[0]) ^ _tweak(words), *words[1:]]
    each, mask = 64 // bits, np.uint64((1 << bits) - 1)
    return [(words[i // each] >> np.uint64(bits * (i % each))) & mask for i in range(size)]


@dataclass
class CountingFilter:
    """Distinct keys in order, as columns of 64-bit words, and the count of each."""

    words: list[np.ndarray]
    counts: np.ndarray

    def __len__(self) -> int:
        return len(self.counts)

    @classmethod
    def of(cls, words: list[np.ndarray], counts: np.ndarray | None = None) -> CountingFilter:
        """Count equal keys. Input that consists of sorted runs costs little more than merging them."""
        order = np.argsort(words[0], kind="stable")
        words = [w[order] for w in words]
        counts = np.ones(len(order), dtype=np.int64) if counts is None else counts[order]
        if not len(order):
            return cls(words, counts)
        same = words[0][1:] == words[0][:-1]
        if len(words) > 1 and (same & np.any([w[1:] != w[:-1] for w in words[1:]], axis=0)).any():
            order = np.lexsort(words[::-1])  # different keys share a first word
            words, counts = [w[order] for w in words], counts[order]
            same = words[0][1:] == words[0][:-1]
        for w in words[1:]:
            same = same & (w[1:] == w[:-1])
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        return cls([w[first] for w in words], np.add.reduceat(counts, first))

    @classmethod
    def merged(cls, filters: list[CountingFilter]) -> CountingFilter:
        return cls.of([np.concatenate(parts) for parts in zip(*[f.words for f in filters])], np.concatenate([f.counts for f in filters]))

    def by_quotient(self, bits: int):
        """``(quotient, filter)`` for every quotient in use: the runs of keys whose first ``bits`` bits agree."""
        quotient = (self.words[0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(self), dtype=np.int64)
        first = np.flatnonzero(np.concatenate([[True], quotient[1:] != quotient[:-1]])) if len(self) else []
        for a, b in zip(first, [*first[1:], len(self)]):
            yield int(quotient[a]), CountingFilter([w[a:b] for w in self.words], self.counts[a:b])

    def at_least(self, count: int) -> CountingFilter:
        enough = self.counts >= count
        return CountingFilter([w[enough] for w in self.words], self.counts[enough])
