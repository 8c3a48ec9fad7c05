"""Each document operator against brute force on small tables with awkward rows."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallycast.llm import bpe, bwt_dedup, cotraining, language_id, minhash_dedup, mixing, paragraph_dedup
from tallycast.llm.graph import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row long, ranges string, component string"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def words_of(text):
    return [w.decode(errors="replace") for w in (text or "").encode().lower().split()]


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


def awkward_texts():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (3, 30, 80, 200, 120)]
    near = base[3].split()
    near[10] = "zzz"
    far = base[3].split()
    far[::6] = ["yyy"] * len(far[::6])
    return [
        None, "", " \t\n", "One two", "one TWO", *base, base[3], base[3].upper(), " ".join(near), " ".join(far),
        base[4] + " " + base[2], "ähnlich ÄHNLICH İß 漢字 😀", "x" * 3000, "na " * 500, prose(rng, 9000), base[1] + "\n" + base[1],
    ]


@pytest.fixture(scope="module")
def texts():
    return awkward_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Extra columns clash with names that the operators use inside; ids repeat and are null."""
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None][i % 3], None if t is None else len(t), 7, 8, "r", "c") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd_docs(spark, docs):
    """The same with a repeated row, a repeated id and null ids."""
    extra = [(3, "One two", "en", "s1", 7, 0, 0, "", ""), (5, "another text under the same id", "en", "s1", 30, 0, 0, "", ""),
             (None, "no id at all", None, None, None, 0, 0, "", ""), (None, None, None, None, None, 0, 0, "", "")]
    return docs.unionByName(spark.createDataFrame(extra, SCHEMA))


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, x) for x in range(501, 540)] + [
        (rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)] + [(7, 7), (None, 3)]
    parent = {x: x for e in edges for x in e if x is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = top(a), top(b)
            parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for e in edges if None not in e and e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_near_duplicates_against_all_pairs(spark, docs, texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if r == old else r for r in root]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.near_duplicates(docs).collect()}
    assert got == {i: (len(s), root[i], root[i] == i) for i, s in enumerate(sets)}


def test_large_bands_are_compared_by_blocks(spark, monkeypatch):
    """A family around one text, many of whose members are alike only through it, with blocks of a few documents."""
    monkeypatch.setattr(minhash_dedup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    rng = random.Random(11)
    base = prose(rng, 150).split()
    texts = [" ".join(base)]
    for _ in range(60):
        own = list(base)
        for at in rng.sample(range(150), rng.choice([1, 3, 4, 5])):
            own[at] = prose(rng, 1)
        texts.append(" ".join(own))
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and root[a] != root[b]:
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if r == old else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.component_id for r in minhash_dedup.near_duplicates(df).orderBy("doc_id").collect()] == root


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(2)
    items = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for overlap in (20, 900, 1000):
        a, b = items[:1000], items[1000 - overlap : 2000 - overlap]
        size = minhash_dedup.fast_similarity_sketch(a).size
        alike = (minhash_dedup.fast_similarity_sketch(a) == minhash_dedup.fast_similarity_sketch(b)).mean()
        true = overlap / (2000 - overlap)
        assert abs(alike - true) < 5 * (true * (1 - true) / size) ** 0.5 + 1e-9
    assert (minhash_dedup.fast_similarity_sketch(items[:1]) != np.uint64(0xFFFFFFFFFFFFFFFF)).all()


def test_mixing_against_a_plain_queue(spark, docs, texts):
    sizes = [len((t or "").encode().split()) for t in texts]
    source = [["s1", "s2", None][i % 3] for i in range(len(texts))]
    order = ["s1", "s2", None]
    total = {s: sum(n for n, own in zip(sizes, source) if own == s) for s in order}
    weight = dict(zip(order, (5, 2, 1)))
    target, capped = {}, set()
    while True:
        left, free = sum(total.values()) - sum(3 * total[s] for s in capped), [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    target = {s: float(3 * total[s]) if s in capped else share[s] for s in order}
    md5 = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    copies = []
    for k, s in enumerate(order):
        upto = 0
        for i in sorted((i for i in range(len(texts)) if source[i] == s), key=md5):
            upto += sizes[i]
            copies += [((upto + turn * total[s]) / target[s], k, md5(i), i) for turn in range(3) if sizes[i]]
    taken, words = collections.Counter(), 0
    for _, _, _, i in sorted(copies):
        if words + sizes[i] > sum(sizes):
            break
        words += sizes[i]
        taken[i] += sizes[i]
    got = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    assert {i: r.size for i, r in got.items()} == dict(enumerate(sizes))
    assert all(got[i].target == pytest.approx(target[source[i]]) for i in got)
    assert {i: r.taken for i, r in got.items()} == {i: taken[i] for i in range(len(texts))}
    rows = mixing.mixed_documents(docs)
    assert rows.columns == docs.columns
    assert collections.Counter(r.doc_id for r in rows.collect()) == +collections.Counter({i: got[i].copies for i in got})


def test_rows_of_one_id_are_mixed_each_on_its_own(spark):
    rows = [(i // 3, " ".join(["w"] * (1 + i % 7 + 40 * (i % 3))), "ab"[i % 2]) for i in range(90)] + [(None, "w " * n, "a") for n in range(1, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = collections.Counter()
    for r in mixing.mix_sources(df).collect():
        plan[r.doc_id, r.size] += r.copies
    got = collections.Counter((r.doc_id, len(r.text.split())) for r in mixing.mixed_documents(df).collect())
    assert got == +plan and any(n == 0 for n in plan.values())


def brute_spans(texts, length):
    seen = collections.Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        spans = []
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                if spans and p <= spans[-1][1]:
                    spans[-1][1] = p + length
                else:
                    spans.append([p, p + length])
        out.append(spans)
    return out


@pytest.mark.parametrize("length", [400, 90])
def test_repeated_strings_against_counting(spark, docs, texts, length):
    data = [(t or "").encode() for t in texts]
    expected = brute_spans(data, length)
    got = {r.doc_id: r for r in bwt_dedup.drop_repeated_strings(docs, length=length).collect()}
    assert {i: [list(s) for s in zip(r.span_starts, r.span_stops)] for i, r in got.items()} == dict(enumerate(expected))
    for i, spans in enumerate(expected):
        gone = {p for a, b in spans for p in range(a, b)}
        assert bytes(got[i].kept) == bytes(c for p, c in enumerate(data[i]) if p not in gone)


@pytest.mark.parametrize("seed", range(6))
def test_merged_transforms_against_counting(seed, monkeypatch):
    """Strings over two letters, many shards: every repeated start is found and the common prefixes are right."""
    monkeypatch.setattr(bwt_dedup, "SHARD_BYTES", 60)
    rng = random.Random(seed)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(20, 60))) for _ in range(12)]
    strings += [strings[0], strings[1][:30] + strings[2][:25], b"ab" * 20]
    length = rng.choice([10, 12, 20])
    counts = np.array([len(s) - length + 1 for s in strings])
    found = bwt_dedup.repeated_starts(strings, counts, length)
    seen = collections.Counter(s[p : p + length] for s in strings for p in range(len(s) - length + 1))
    assert [list(f) for f in found] == [[seen[s[p : p + length]] > 1 for p in range(n)] for s, n in zip(strings, counts)]


def test_planted_passages_are_cut_and_clean_texts_stay(spark):
    rng = random.Random(3)
    passages = [prose(rng, n) for n in (56, 60, 75, 100, 140)]
    rows, planted = [], set()
    for i in range(120):
        own = prose(rng, 150).split()
        if i % 3 == 0:
            own[40:40] = passages[(i // 3) % 5].split()
            planted.add(i)
        rows.append((i, " ".join(own)))
    got = {r.doc_id: r for r in paragraph_dedup.drop_repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, r in got.items() if r.n_removed} == {i for i in planted if i >= 15}
    for i, r in got.items():
        assert len(r.text.split()) == r.n_words - r.n_removed
        assert not r.n_removed or passages[(i // 3) % 5] not in r.text


def test_repeated_passages_are_cut_to_their_last_word(spark):
    rng = random.Random(13)
    passages = [prose(rng, n) for n in (51, 55, 60, 100)] + [prose(rng, 30) + " na" * 120 + " " + prose(rng, 30)]
    rows, planted = [], []
    for i in range(40):
        own, passage = [f"{w}{i}" for w in prose(rng, 120).split()], passages[i % 5].split()
        at = rng.randrange(10, 110)
        rows.append((i, " ".join(own[:at] + passage + own[at:])))
        planted.append((" ".join(own), len(passage)))
    got = {r.doc_id: r for r in paragraph_dedup.drop_repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].text == rows[i][1] for i in range(5))
    for i, (_, n) in list(enumerate(planted))[5:]:
        # A paragraph over the border that is similar to a kept one goes whole, with a few words of the text.
        assert n <= got[i].n_removed <= n + 5 and all(w.endswith(str(i)) for w in got[i].text.split())


def test_copies_keep_one_and_awkward_texts_survive(spark, docs, texts):
    out = paragraph_dedup.drop_repeated_paragraphs(docs.withColumn("n_words", F.lit("clash")))
    assert out.columns[: len(docs.columns)] == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert got[8].text == texts[8] and got[10].n_removed == 200 and got[11].n_removed == 200
    assert got[0].text is None and got[1].text == "" and got[17].n_removed == 0
    assert all(got[i].n_words == len((t or "").encode().split()) for i, t in enumerate(texts))


def brute_removed(texts):
    """Places of the paragraphs that a comparison of all pairs would remove, among pairs that share a band value."""
    found = []
    for key, start, end, own, values in paragraph_dedup._values((i, t.encode()) for i, t in enumerate(texts)):
        split = texts[key].split()
        found.extend((key, int(s), int(e), set(v), shingle_set(" ".join(split[s:e]))) for s, e, v in zip(start, end, values.T.tolist()))
    sets = [f[4] for f in found]
    parent = list(range(len(found)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(found)), 2):
        if found[i][3] & found[j][3] and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return {found[i][:3] for i in range(len(found)) if root(i) != i}


def crowded_texts(rng, n):
    """Paragraph pairs alike but for the last word; all share a template of 14 words, so that many meet in one value."""
    template = prose(rng, 14)
    out = []
    for _ in range(n):
        tail = prose(rng, 5).split()
        out.append(" ".join([template, *tail[:4]]))
        out.append(" ".join([template, *tail]))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("small", [48, 1000])
def test_crowded_band_values_against_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(paragraph_dedup, "SMALL_BUCKET", small)
    texts = crowded_texts(random.Random(8), 100)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.id, r.start, r.stop) for r in paragraph_dedup.repeated_paragraphs(df).collect()}
    assert got == brute_removed(texts)


def test_layout_does_not_change_the_repeated_paragraphs(spark, monkeypatch):
    texts = crowded_texts(random.Random(9), 60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = []
    for slices, block, small in ((64, 256, 48), (1, 8, 2)):
        monkeypatch.setattr(paragraph_dedup, "SLICES", slices, raising=False)
        monkeypatch.setattr(minhash_dedup, "BLOCK", block)
        monkeypatch.setattr(paragraph_dedup, "SMALL_BUCKET", small, raising=False)
        found.append({(r.id, r.start, r.stop) for r in paragraph_dedup.repeated_paragraphs(df).collect()})
    assert found[0] == found[1]


def test_bands_for_recall():
    assert paragraph_dedup.bands_for(0.75, 0.98) == 3 and paragraph_dedup.bands_for(0.75, 0.9998, 5) == 32


def test_bpe_equals_the_library(spark, odd_docs):
    library = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(4)
    letters = "abcdefgh  \n\t'stre é漢字😀0123.,zqxj\u0085\u2003\u200b\x1c"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(120))) + rng.choice(["", "<|endoftext|>x"])) for i in range(400)]
    df = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc_id", F.col("doc_id") + 1000))
    coded = bpe.encode_documents(df, VOCABULARY, decode=True).collect()
    known = collections.defaultdict(list)
    for r in df.collect():
        known[r.doc_id].append(library.encode(r.text or "", add_special_tokens=False).ids)
    assert all(list(r.ids) in known[r.doc_id] and r.n_tokens == len(r.ids) for r in coded) and len(coded) == df.count()
    assert all(r.decoded == library.decode(r.ids, skip_special_tokens=False) for r in coded)
    again = bpe.decode_documents(bpe.encode_documents(df, VOCABULARY), VOCABULARY)
    assert sorted((r.doc_id or -1, r.text) for r in again.collect()) == sorted((r.doc_id or -1, r.decoded) for r in coded)
    packed = bpe.encode_documents(df.where("doc_id >= 1000"), VOCABULARY, packed=True).collect()
    assert all(np.frombuffer(bytes(r.ids), dtype="<u4").tolist() == known[r.doc_id][0] for r in packed)


def test_pair_table_against_merging():
    tables = bpe.vocabulary(open(VOCABULARY, "rb").read())
    rng = random.Random(6)
    whole = [t for t in rng.sample(range(50256), 1500) if tables.whole(t)]
    for a, b in zip(whole, whole[1:]):
        assert tables.open_border(a, b) == (tables.merged(tables.bytes_of[a] + tables.bytes_of[b]) == [a, b])


def naive_phrases(text, sample):
    n, at = 0, 0
    while at < len(text):
        size = 0
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at, n = at + max(size, 1), n + 1
    return n


def test_phrases_against_plain_parsing():
    rng = random.Random(8)
    samples = {"x": "".join(rng.choice("abc ") for _ in range(300)), "y": "".join(rng.choice("bcd ") for _ in range(200))}
    model = language_id._languages({k: [v] for k, v in samples.items()}, 1000)
    texts = ["".join(rng.choice("abcd e") for _ in range(rng.randrange(0, 400))) for _ in range(50)]
    symbols = [model.symbols(t) for t in texts]
    known = [list(np.append(model.symbols(samples[k]), language_id.GAP)) for k in model.names]
    as_text = lambda s: "".join(chr(65 + x) for x in s)
    expected = [[naive_phrases(as_text(s), as_text([x if x != language_id.RARE else 60 for x in k])) if len(s) else 0 for k in known] for s in symbols]
    got = model.phrases(symbols)
    assert [list(g) for g, s in zip(got, symbols) if len(s)] == [e for e, s in zip(expected, symbols) if len(s)]


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language_id.predict_language(docs, language_id.learn_languages(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in found if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in found)


def test_language_of_awkward_rows(spark, odd_docs, nothing):
    model = language_id.learn_languages(odd_docs)
    found = language_id.predict_language(odd_docs, model).collect()
    assert len(found) == odd_docs.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in found if r.doc_id in (0, 1, 2))
    untaught = language_id.learn_languages(odd_docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in language_id.predict_language(odd_docs, untaught).collect()} == {"und"}


def test_quality_features_against_counting():
    """Features of a whole chunk are those of each text counted word by word."""
    texts = [t.encode() for t in ("", " \n ", "one", "Ab ab AB 12, 3.\nsame\nsame\nsame", "ü É 中文 x\n\n", "A" * 5000 + " b", "w " * 900, "a b", "b a")]
    got = cotraining.text_features(texts)
    for row, text in zip(got, texts):
        parts = [w.lower() for w in re.split(rb"[\x20\x09-\x0d]+", text) if w]
        if not parts:
            assert not row.any()
            continue
        share = lambda low, high: sum(low <= c <= high for c in text) / len(text)
        lines = text.split(b"\n")
        marks = sum(33 <= c < 127 and not chr(c).isalnum() for c in text) / len(text)
        expected = [share(65, 90), share(48, 57), marks, 1 - len(set(parts)) / len(parts),
                    sum(a == b for a, b in zip(parts, parts[1:])) / max(len(parts) - 1, 1), 1 - len(set(lines)) / len(lines),
                    sum(map(len, parts)) / len(parts) / 10, np.log1p(len(parts)) / 10]
        assert np.allclose(row[-8:], expected)
        bins = np.zeros(cotraining.WORD_BINS)
        for word in parts:
            bins[int(cotraining.words([word])[2][0]) % cotraining.WORD_BINS] += 1
        assert np.allclose(row[:-8], np.sqrt(bins / len(parts)))
    alone = np.concatenate([cotraining.text_features([t]) for t in texts])
    assert np.array_equal(got, alone)


def test_quality_of_awkward_rows(spark, odd_docs, nothing):
    """The trained path: null texts and metadata, null and repeated ids, names with spaces and line ends, no rows."""
    rng = random.Random(3)
    rows = [(i, ("fine " if i % 2 else "BAD!! 9 ") * 4 + prose(rng, 15), "en", f"s{i % 2}", 40) for i in range(200)]
    rows += [(300, None, None, None, None), (300, "x", "a b\nc", "", -5), (None, "y", "en", "s0", 1), (1, "another text of id 1", "en", "s1", 2)]
    docs = spark.createDataFrame([(*r, 0.5, "m") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, label double, row string")
    labels = docs.where("doc_id < 150").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).unionByName(
        spark.createDataFrame([(1, None), (None, 1), (300, None)], "doc_id long, quality int"))
    model = cotraining.train_quality(docs, labels, rounds=1)
    assert model.views
    scored = cotraining.score_quality(docs, model).collect()
    assert sorted(str(r.doc_id) for r in scored) == sorted(str(r[0]) for r in rows)
    assert all(0 <= r.score <= 1 and r.good == (r.score >= 0.5) for r in scored)
    assert cotraining.score_quality(nothing, model).count() == 0
    assert cotraining.score_quality(odd_docs, model).count() == odd_docs.count()
    assert cotraining.train_quality(nothing, labels, rounds=1).views == {}


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = cotraining.score_quality(docs, cotraining.train_quality(docs, labels, rounds=1))
    assert out.count() == docs.count()
    held = out.where("held_out").join(labels, "doc_id").collect()
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    assert np.mean([[a > b for b in bad] for a in good]) > 0.9


def test_pseudo_labels_are_sought_in_all_documents(spark, monkeypatch):
    """The surest of a table and of a part of it differ; a bound on the pool would change the weights."""
    rng = random.Random(12)
    rows = [(i, ("good " if i % 2 else "BAD! 9 ") * rng.randrange(1, 6) + prose(rng, 20), "en", f"s{i % 2}", rng.randrange(99)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = df.where("doc_id < 60").select("doc_id", (F.col("doc_id") % 2).cast("double").alias("quality"))
    seen = []
    fit = cotraining._fit
    monkeypatch.setattr(cotraining, "EXCHANGED", 1000)
    monkeypatch.setattr(cotraining, "MAX_POOL", 20, raising=False)
    monkeypatch.setattr(cotraining, "_fit", lambda rows, view, *a: (seen.append(rows.count()), fit(rows, view, *a))[1])
    cotraining.train_quality(df, labels, rounds=1)
    assert max(seen) > 340


def test_quality_without_two_classes(spark, odd_docs, nothing):
    one = spark.createDataFrame([(1, 1, 0), (5, 1, None), (None, 0, 0)], "doc_id long, quality int, toxic int")
    odd_docs = odd_docs.withColumn("label", F.lit("x")).withColumn("margin", F.lit(1))
    for labels, share in ((one, 1.0), (one.where("false"), 0.5)):
        scores = cotraining.score_quality(odd_docs, cotraining.train_quality(odd_docs, labels)).collect()
        assert {r.score for r in scores} == {share} and len(scores) == odd_docs.count()


OPERATORS = {
    "near": minhash_dedup.near_duplicates, "mix": mixing.mix_sources, "mixed": mixing.mixed_documents, "strings": bwt_dedup.drop_repeated_strings,
    "paragraphs": paragraph_dedup.drop_repeated_paragraphs, "encode": lambda d: bpe.encode_documents(d, VOCABULARY),
    "language": lambda d: language_id.predict_language(d, language_id.learn_languages(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows_and_odd_rows(spark, odd_docs, nothing, name):
    assert OPERATORS[name](nothing).count() == 0
    n = OPERATORS[name](odd_docs).count()
    assert n == odd_docs.count() or name == "mixed"
