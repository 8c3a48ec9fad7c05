"""Work and memory of the paragraphs of many texts."""

import random
import tracemalloc

from tallycast.llm import paragraph_dedup as p
from tallycast.llm.text import signed, words


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def test_values_of_paragraphs_in_little_memory():
    rng = random.Random(4)
    texts = [(i, prose(rng, 350).encode()) for i in range(2000)]
    list(p._met(texts[:2]))
    tracemalloc.start()
    rows = sum(len(batch[0]) for batch in p._met(texts))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert rows > 60_000 and peak < 40_000_000


def plain_around(hashes, start, stop):
    """Words before and after one paragraph, from the borders of its text alone."""
    starts, ends = p.paragraphs(hashes)
    after, before = [i for i, s in enumerate(starts) if s >= stop + 21], [i for i, e in enumerate(ends) if e <= start - 21]
    last = min(ends[after[0]] + 21, len(hashes)) if after else len(hashes)
    first = max(starts[before[-1]] - 21, 0) if before else 0
    return hashes[first:start][::-1], hashes[stop:last]


def test_words_around_the_ranges_of_many_texts_come_together():
    rng = random.Random(11)
    rows, expected = [], set()
    for key in range(60):
        text = prose(rng, rng.choice([5, 30, 100, 300])).encode()
        hashes = words([text])[2]
        starts, ends = p.paragraphs(hashes)
        prints = signed(p.prints(hashes, starts, ends))
        asked = [{"start": int(s), "stop": int(e), "fp": int(f), "side": side} for s, e, f in zip(starts, ends, prints) for side in (p.LEFT, p.RIGHT)]
        for one in asked:
            expected.add((key, one["start"], one["side"], tuple(signed(plain_around(hashes, one["start"], one["stop"])[one["side"]]).tolist())))
        wrong = [{"start": 0, "stop": 5, "fp": 1, "side": p.LEFT}, {"start": 2, "stop": 9999, "fp": 1, "side": p.RIGHT}]
        rows.append((key, text, asked + wrong))
    batches = list(p._words_around(rows))
    got = {(int(k), int(s), int(side), tuple(w)) for key, start, _, _, side, around in batches for k, s, side, w in zip(key, start, side, around.to_pylist())}
    assert got == expected and len(batches) == 1
