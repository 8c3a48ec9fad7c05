"""Hard negatives, phrase counting and toxicity against brute force, with awkward rows."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallycast.llm import collocations, hard_negatives, toxicity
from tallycast.llm.language_id import held_out
from tallycast.llm.quotient_filter import CountingFilter, pack, unmix, unpack
from tallycast.llm.text import mix

# --- hard negatives -----------------------------------------------------------------------------------


def coded_rows(n=300, width=19):
    rng = np.random.default_rng(3)
    rows = [(int(i), int(i % 4), [int(x) for x in rng.integers(-40, 60, width)]) for i in range(n)]
    rows += [(50, 1, rows[3][2]), (50, 1, rows[7][2]), (1000, None, rows[0][2]), (1001, 1, None), (1002, 1, [None, 1]), (None, 1, rows[0][2]),
             (1003, 2, []), (1004, 2, rows[5][2]), (1005, 3, rows[5][2]), (1006, 3, [5, 9])]
    return rows


def brute_negatives(rows, anchors, n_positives=5, n_negatives=10):
    good = [(i, l, v) for i, l, v in rows if None not in (i, l, v) and None not in v]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for at, (i, l, v) in enumerate(good):
        if i not in anchors:
            continue
        positives = sorted((-dot(v, w), j) for k, (j, m, w) in enumerate(good) if m == l and j != i)[:n_positives]
        others = sorted((-dot(v, w), j) for j, m, w in good if m != l)
        for score, j in positives:
            fit = [(s, o) for s, o in others if 30 * -score <= 100 * -s <= 90 * -score][:n_negatives]
            out += [(i, j, rank + 1, o, -score, -s) for rank, (s, o) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("slice_values", [1 << 20, 700])
def test_hard_negatives_against_all_pairs(spark, monkeypatch, slice_values):
    monkeypatch.setattr(hard_negatives, "SLICE_VALUES", slice_values)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 20)
    rows, anchors = coded_rows(), {*range(0, 300, 6), 1003, 1004, 1006}
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, code array<long>, key string, slice int")
    got = hard_negatives.mine_hard_negatives(df, F.col("vec_id").isin(*anchors))
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, anchors)


def test_scores_beyond_floating_point_and_beyond_64_bits(spark):
    big = 1 << 27
    rows = [(1, 0, [big, 1]), (2, 0, [big, 3]), (3, 0, [big, 2]), (4, 1, [big // 2, 1]), (5, 1, [big // 2, 2])]
    df = spark.createDataFrame(rows, "vec_id long, label int, code array<long>")
    got = hard_negatives.mine_hard_negatives(df, F.col("vec_id") == 1)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, {1})
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.mine_hard_negatives(df.withColumn("code", F.array(F.lit(1 << 40), F.lit(1))), F.col("vec_id") == 1).count()


def test_no_vectors_and_no_anchors(spark):
    df = spark.createDataFrame(coded_rows(20), "vec_id long, label int, code array<long>")
    assert hard_negatives.mine_hard_negatives(df.where("false"), F.col("vec_id") == 1).count() == 0
    assert hard_negatives.mine_hard_negatives(df, F.lit(None).cast("boolean")).count() == 0


def test_summaries_bound_every_product():
    rng = np.random.default_rng(1)
    for width in (1, 3, 16, 50):
        a, b = rng.integers(-900, 900, (40, width)).astype(float), rng.integers(0, 99, (30, width)).astype(float)
        apart = []
        for (am, ad), (bm, bd) in zip(hard_negatives.summaries(a), hard_negatives.summaries(b)):
            middle, spread = am @ bm.T, ad @ bd.T
            assert (np.abs(a @ b.T - middle) <= spread + 1e-6).all()
            apart.append(spread.mean())
        assert apart == sorted(apart, reverse=True)


# --- phrases ------------------------------------------------------------------------------------------


def test_packing_is_undone_and_counts_are_exact():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert (unmix(mix(x)) == x).all()
    for bits, size in ((1, 5), (7, 2), (15, 5), (22, 4), (33, 3), (40, 5)):
        top = min((1 << bits) - 1, 9)
        ids = [rng.integers(0, top + 1, 4000, dtype=np.uint64) for _ in range(size)]
        words = pack(ids, bits)
        assert all((a == b).all() for a, b in zip(unpack(words, size, bits), ids))
        truth = collections.Counter(zip(*[v.tolist() for v in ids]))
        parts = [CountingFilter.of([w[i::3] for w in words]) for i in range(3)]
        whole = CountingFilter.merged(parts)
        again = CountingFilter.merged([run for _, run in whole.by_quotient(4)])
        for counted in (whole, again):
            back = zip(*[v.tolist() for v in unpack(counted.words, size, bits)])
            assert dict(zip(back, counted.counts.tolist())) == truth


def test_keys_that_share_their_first_word_stay_apart():
    first = np.array([5, 5, 5, 7, 5], dtype=np.uint64)
    second = np.array([1, 2, 1, 1, 2], dtype=np.uint64)
    counted = CountingFilter.of([first, second])
    assert list(zip(*[w.tolist() for w in counted.words], counted.counts.tolist())) == [(5, 1, 2), (5, 2, 2), (7, 1, 1)]


def brute_phrases(rows, least, top):
    f = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().lower()):
            w = [x for x in re.split(rb"[ \t]+", piece) if x]
            for k in range(1, 6):
                f[lang or "und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        n = sum(c for g, c in counts.items() if len(g) == 1)
        candidates = {g: c for g, c in counts.items() if len(g) > 1 and c >= least}
        hidden = set()
        for g, c in candidates.items():
            for k in range(2, len(g)):
                hidden |= {p for p in (g[i : i + k] for i in range(len(g) - k + 1)) if 100 * c >= 100 * candidates[p]}
        best = []
        for g, a in candidates.items():
            if g not in hidden:
                score, k = min((1000 * a * n // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
                best.append((-score, -a, b" ".join(g), counts[g[:k]], counts[g[k:]], n))
        out += [(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r, n) in enumerate(sorted(best)[:top])]
    return sorted(out)


def phrase_rows():
    rng = random.Random(11)
    names = ["ab", "Ba", "c", "dé", "ee", "漢字", "fF", "g"]
    rows = [(" ".join(rng.choice(names) + rng.choice(["", "", "", ".", ",", "\n", "\t"]) for _ in range(rng.randrange(0, 120))), lang)
            for lang in ("en", "de", None) for _ in range(30)]
    rows += [(None, "en"), ("", "en"), ("  \t .,", None), ("ab c dé", ""), ("x" * 5000, "de"), ("one two three four five six. " * 400, "de"), ("ab " * 3000, "en")]
    return rows + rows[:10]


@pytest.mark.parametrize("least,top", [(4, 2000), (3, 7)])
def test_phrases_against_brute_force(spark, least, top):
    rows = phrase_rows()
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], "text string, lang string, ids int, word string").repartition(5)
    got = collocations.mine_collocations(df, least=least, top=top)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, least, top)


def test_large_vocabularies_and_small_tasks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "DICTIONARY", 5)
    monkeypatch.setattr(collocations, "HELD_WORDS", 3)
    monkeypatch.setattr(collocations, "HELD_KEYS", 20)
    monkeypatch.setattr(collocations, "PART", 50)
    monkeypatch.setattr(collocations, "BUCKET", 100)
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert sorted(map(tuple, collocations.mine_collocations(df, least=4).collect())) == brute_phrases(rows, 4, 2000)


def test_products_that_pass_64_bits(spark):
    """Counts of a corpus that no test can hold go through the same scoring."""
    a, l, r, n = 3_000_000_007, 4_000_000_009, 5_000_000_021, 10**15 + 37
    parts = spark.createDataFrame([([1], l), ([2], r)], "ids array<long>, f long")
    phrases = spark.createDataFrame([([1, 2], a)], "ids array<long>, f long")
    vocabulary = spark.createDataFrame([(1, "en", b"x", l), (2, "en", b"y", r)], "id long, lang string, word binary, n long")
    totals = spark.createDataFrame([("en", n)], "lang string, total long")
    row = collocations._scored(phrases, parts, vocabulary, totals).first()
    assert row.score == 1000 * a * n // (l * r) and row.a == a


def test_no_texts_no_phrases(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.mine_collocations(empty).count() == 0
    assert collocations.mine_collocations(spark.createDataFrame([(None, None), ("a b", "en")], "text string, lang string")).count() == 0


# --- toxicity -----------------------------------------------------------------------------------------


def insults(n=400):
    rng = random.Random(2)
    mild = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(150)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(mild) for _ in range(rng.randrange(20, 400))]
        bad = i % 5 == 0
        if bad:
            for at in range(0, len(w), 12):
                w[at] = rng.choice(["zonkwit", "Zonkers", "vilebrat"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_toxic_documents_are_found(spark):
    rows, labels = insults()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    truth = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, truth)).join(truth, "doc_id").where("held_out").collect()
    assert len(out) > 40 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert sum(r.predicted == r.toxic for r in out) >= 0.97 * len(out)


def test_held_out_labels_and_other_columns_change_nothing(spark):
    rows, labels = insults(200)
    docs = spark.createDataFrame([(*r, "en", "s", 5.0, 7) for r in rows], "doc_id long, text string, lang string, source string, score double, label int")
    truth = spark.createDataFrame(labels, "doc_id long, toxic int")
    flipped = truth.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumns({"lang": F.lit("x"), "source": F.lit(None).cast("string")}).repartition(7)
    score = lambda d, t: sorted((r.doc_id, round(r.score, 6)) for r in toxicity.score_toxicity(d, toxicity.train_toxicity(d, t)).collect())
    assert score(docs, truth) == score(other, flipped)


def test_awkward_rows_have_scores(spark):
    rows, labels = insults(120)
    rows += [(None, "zonkwit"), (500, None), (501, ""), (502, "vilebrat " * 40_000), (0, rows[1][1]), (503, "漢字 zonkwit"), (5, rows[5][1])]
    labels += [(None, 1), (7, None), (8, 1), (8, 0), (0, 0), (0, 1), (999, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    out = toxicity.score_toxicity(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by_id = collections.defaultdict(set)
    for r in out:
        by_id[r.doc_id].add(r.score)
    assert by_id[500] == by_id[501] and len(by_id[5]) == 1 and min(by_id[502]) > 0.5
    assert toxicity.score_toxicity(docs.where("false"), model).count() == 0


@pytest.mark.parametrize("labels,expected", [([], 0.0), ([(1, 1), (2, 1), (3, 1)], 1.0), ([(1, 0), (2, None)], 0.0)])
def test_labels_of_one_class(spark, labels, expected):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], "doc_id long, text string")
    model = toxicity.train_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score_toxicity(docs, model).collect()} == {expected}
    assert toxicity.score_toxicity(docs.where("false"), toxicity.train_toxicity(docs.where("false"), spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0


def test_ratios_and_bins_against_plain_counts():
    texts = [b"Ab ab", b"", b"abab\nabx"]
    number, bins, values = toxicity.gram_bins([(None, t) for t in texts])
    for i, text in enumerate(texts):
        padded = b" " + text.lower().replace(b"\n", b" ") + b" "
        grams = collections.Counter(padded[j : j + n] for n in toxicity.GRAMS for j in range(len(padded) - n + 1))
        assert sorted(values[number == i].round(9)) == sorted(np.sqrt(1000 * np.array(list(grams.values())) / len(padded)).round(9))
    ratio, distance = toxicity.log_count_ratios(np.array([[0.0, 4.0], [8.0, 4.0]]), np.array([[0, 3], [5, 3]]), np.array([10.0, 10.0]))
    assert np.allclose(ratio, [np.log(9 / 1), 0]) and distance[0] > 2 and distance[1] == 0


# --- links between similar documents --------------------------------------------------------------------


def test_similar_documents_of_a_block_have_spanning_links():
    import pyarrow as pa

    from tallycast.llm.minhash_dedup import _compared

    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 40, 60)
    sets = [np.append(base, rng.integers(0, 1 << 40, 3)) for _ in range(256)] + [rng.integers(0, 1 << 40, 60) for _ in range(20)]
    ids = np.arange(len(sets))
    for own in (np.zeros(len(sets), dtype=np.int32), (ids % 2).astype(np.int32)):
        found = _compared(pa.table({"id": ids, "component": ids, "own": own, "items": pa.array([s.tolist() for s in sets], pa.list_(pa.int64()))}))
        assert len(found) == 255
        root = {int(i): int(i) for i in ids}
        for a, b in zip(found.column("a").to_pylist(), found.column("b").to_pylist()):
            old, new = root[a], root[b]
            root = {k: new if r == old else r for k, r in root.items()}
        assert len({root[i] for i in range(256)}) == 1 and all(root[i] == i for i in range(256, 276))


def test_pairs_of_paragraphs_share_a_band_as_often_as_promised():
    from tallycast.llm import paragraph_dedup as p

    assert p.BANDS * p.ROWS <= 16
    assert 1 - (1 - 0.75**p.ROWS) ** p.BANDS >= 0.98 and 1 - (1 - 0.1**p.ROWS) ** p.BANDS < 0.06


def test_paragraphs_of_many_texts_are_those_of_each():
    from tallycast.llm import paragraph_dedup as p
    from tallycast.llm.text import shingles, words

    rng = random.Random(21)
    for counts in ([0, 3, 4, 5, 19, 20, 21, 22, 0, 300, 41, 1], [500], [2], [0], [26, 0, 0, 25]):
        texts = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(n)).encode() for n in counts]
        _, _, hashes, offsets = words(texts)
        start, end, first = p.paragraphs_of(hashes, offsets)
        got = {key: (s.tolist(), e.tolist(), own.tolist(), values.tolist()) for key, s, e, own, values in p._values(enumerate(texts))}
        for i in range(len(texts)):
            own = hashes[offsets[i] : offsets[i + 1]]
            s, e = p.paragraphs(own)
            a, b = first[i], first[i + 1]
            assert (start[a:b] - offsets[i]).tolist() == s.tolist() and (end[a:b] - offsets[i]).tolist() == e.tolist()
            assert (i in got) == bool(len(s))
            if len(s):
                assert got[i][:3] == (s.tolist(), e.tolist(), p.prints(own, s, e).tolist())
                assert got[i][3] == [x.tolist() for x in next(p._values([(i, texts[i])]))[4]]
        everything = [x for n, x in zip(counts, texts) if n >= 5]
        assert len(shingles(hashes)) >= sum(len(x.split()) - 4 for x in everything)
