"""Embedding and URL operators against brute force, with awkward rows."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallycast.llm import embedding_dedup, hamming_search, url_rules

NAN, INF = float("nan"), float("inf")


def vectors(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(40):
        base = rng.standard_normal(16)
        base /= np.linalg.norm(base)
        for spread in (0, 0.15, 0.19, 0.21, 0.25):
            rows.append((len(rows), (base + spread * rng.standard_normal(16) / 4).tolist(), i % 3))
    rows += [(1000, rows[0][1], 0), (1001, rows[0][1], 1), (1002, [2 * x for x in rows[0][1]], 0), (1003, None, 0), (1004, [], 0), (1005, [0.0] * 16, 0),
             (1006, [NAN] * 16, 0), (1007, [INF] + [1.0] * 15, 0), (1008, rows[0][1], None), (1009, [None] + [1.0] * 15, 0), (1010, [1.0] * 8, 0),
             (None, rows[0][1], 0), (1011, [1e-300] * 16, 2), (1012, [1e300] * 16, 2)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, component string, size int")


def test_near_vectors_against_all_pairs(spark):
    df = vectors(spark)
    rows = [r for r in df.collect()]
    good = [r for r in rows if r.vec_id is not None and r.label is not None and r.embedding and None not in r.embedding
            and np.isfinite(r.embedding).all() and np.any(r.embedding)]
    unit = {r.vec_id: np.array(r.embedding) / np.abs(r.embedding).max() for r in good}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    label = {r.vec_id: r.label for r in good}
    links, root = dict.fromkeys(unit, 0), {i: i for i in unit}
    ids = sorted(unit)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if label[a] == label[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
                links[a] += 1
                links[b] += 1
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    got = {r.vec_id: r for r in embedding_dedup.near_duplicate_vectors(df).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        expected = (links.get(i, 0), root.get(i, i), i is None or root.get(i, i) == i)
        assert (r.n_links, r.component_id, r.kept) == expected


def test_blocks_of_a_hot_label_give_the_same(spark, monkeypatch):
    df = vectors(spark)
    whole = sorted(map(str, embedding_dedup.near_duplicate_vectors(df).collect()))
    monkeypatch.setattr(embedding_dedup, "BLOCK", 7)
    assert sorted(map(str, embedding_dedup.near_duplicate_vectors(df).collect())) == whole


def test_no_vectors(spark):
    assert embedding_dedup.near_duplicate_vectors(vectors(spark).where("false")).count() == 0
    assert hamming_search.embedding_top_k(vectors(spark).where("false")).count() == 0


def test_collisions_needed_is_a_binomial_tail():
    rng = np.random.default_rng(1)
    hits = (np.abs(rng.standard_normal((20_000, embedding_dedup.PROJECTIONS))) <= embedding_dedup.HALF_WIDTH).sum(axis=1)
    assert (hits >= embedding_dedup.collisions_needed()).mean() > 0.999


@pytest.mark.parametrize("n", [1, 5, 300])
def test_top_k_against_sorting(spark, n):
    rng = np.random.default_rng(n)
    codes = rng.integers(-(1 << 63), (1 << 63) - 1, n)
    codes[: n // 3] = codes[0]
    codes[n // 3 : n // 2] ^= 1 << rng.integers(0, 63)
    df = spark.createDataFrame([(i, int(c)) for i, c in enumerate(codes)] + [(None, 5), (9999, None)], "id long, code long")
    got = hamming_search.hamming_top_k(df, df.where("id % 7 = 0"), 6).orderBy("query_id", "rank").collect()
    expected = []
    for q in range(0, n, 7):
        near = sorted((bin(int(codes[q] ^ codes[i]) & (1 << 64) - 1).count("1"), i) for i in range(n) if i != q)[:6]
        expected += [(q, rank + 1, i, d) for rank, (d, i) in enumerate(near)]
    assert [tuple(r) for r in got] == expected


@pytest.mark.parametrize("segments", [2, 4])
def test_top_k_at_the_widths_of_large_tables(spark, monkeypatch, segments):
    """Segments of 32 and 16 bits over clusters of codes; lone codes end in the comparison with all codes."""
    monkeypatch.setattr(hamming_search, "segments_for", lambda n: segments)
    monkeypatch.setattr(hamming_search, "SCAN_BLOCK", 3)
    rng = np.random.default_rng(8)
    centres = [int(c) for c in rng.integers(-(1 << 63), (1 << 63) - 1, 30)]
    codes = [c ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))) for c in centres for _ in range(40)] + centres
    df = spark.createDataFrame(list(enumerate(codes)), "id long, code long")
    got = hamming_search.hamming_top_k(df, df.where("id % 50 = 0"), 6).orderBy("query_id", "rank").collect()
    whole = np.array(codes).view(np.uint64)
    expected = []
    for q in range(0, len(codes), 50):
        distance = np.bitwise_count(whole ^ whole[q])
        near = [i for i in np.lexsort((np.arange(len(codes)), distance)) if i != q][:6]
        expected += [(q, rank + 1, i, distance[i]) for rank, i in enumerate(near)]
    assert [tuple(r) for r in got] == expected


def test_sign_codes_of_long_and_short_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(n).tolist()) for i, n in enumerate((1, 16, 63, 64, 65, 128, 129, 300))] + [(90, []), (91, None), (92, [NAN]), (93, [None, 1.0])]
    got = hamming_search.sign_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    bits = {i: sum(1 << b for b in range(64) if sum(v[b::64]) > 0) for i, v in rows[:8]}
    assert {r.id: r.code & (1 << 64) - 1 for r in got} == bits


def test_top_k_with_repeated_ids(spark):
    """Rows that share an id: they fill no caps of their own queries and count as rows for the others."""
    rng = np.random.default_rng(4)
    rows = [(0, 77)] * 30 + [(7, 77 ^ (1 << i)) for i in range(20)] + [(14, 77)] * 3 + [(i, 77 ^ 3) for i in (1, 2, 3)]
    rows += [(i, int(c)) for i, c in enumerate(rng.integers(-(1 << 63), (1 << 63) - 1, 60), 15)]
    df = spark.createDataFrame(rows, "id long, code long")
    got = hamming_search.hamming_top_k(df, df.where("id % 7 = 0"), 6).orderBy("query_id", "rank").collect()
    expected = []
    for q in sorted({i for i, _ in rows if i % 7 == 0}):
        near = sorted((bin((c ^ d) & (1 << 64) - 1).count("1"), i) for p, c in rows if p == q for i, d in rows if i != q)[:6]
        expected += [(q, rank + 1, i, d) for rank, (d, i) in enumerate(near)]
    assert [tuple(r) for r in got] == expected


URLS = [
    "http://a.com/en/1", "https://Example.COM/en/x?q=1", "https://www.example.com/en/2#t", "http://example.com", "http://x.net/es/", "http://net/fr/9",
    "no scheme", None, "http://", "http://badnet/es/", "ftp://b.org?x://y/z", "http://C.com?en/1", "http://a.com/EN/1", "x://A.B.NET/fr/ü",
]


def test_hosts_paths_and_fixed_rules(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

    def parse(url):
        if url is None or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path

    def judge(host, path):
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[1:] if fit else None

    pages = spark.createDataFrame([(i, u, "t", 0.5) for i, u in enumerate(URLS)], "page_id long, url string, tokens string, confidence double")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in url_rules.judge_urls(pages, labels).collect():
        host, path = parse(URLS[r.page_id])
        fixed = judge(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, fixed and fixed[0], fixed[1] if fixed else "allow")
    assert url_rules.judge_urls(pages.where("false"), labels).count() == 0


def test_mined_rules_against_counting(spark):
    rng = np.random.default_rng(2)
    pages, labels = [], []
    for i in range(400):
        host, topic = rng.choice(["farm", "shop", "news"]), rng.choice(["win", "read", "pills"])
        pages.append((i, f"http://{host}.site.org/{topic}/{i}"))
        bad = (host == "farm" and topic == "pills") or (topic == "win" and rng.random() < 0.9)
        labels.append((i, int(not bad), None if i % 2 else 0))
    page_df = spark.createDataFrame(pages, "page_id long, url string")
    label_df = spark.createDataFrame(labels[:300] + [(None, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_rules.judge_urls(page_df, label_df, min_support=0.02, min_confidence=0.7).collect()}
    for i, url in pages:
        bad = "/win/" in url or ("farm" in url and "/pills/" in url)
        assert got[i].verdict == ("block" if bad else "allow")
        assert not bad or got[i].confidence >= 0.7
    own = lambda url: {t for t in re.split(r"[/.:\-_]+", re.sub(r"\d+", "0", url.split("://")[1])) if t}
    for r in got.values():
        if r.tokens:
            needed = {t.split(":", 1)[1] for t in r.tokens.split()}
            rows = [q for (i, u), (_, q, _) in zip(pages[:300], labels[:300]) if needed <= own(u)]
            assert r.confidence == pytest.approx(1 - np.mean(rows))
