"""The projection forest and the Bloom cascade against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import ann, queries, url_filter

VECTORS = "vec_id long, embedding array<float>, label int, score double"


def vectors(n, seed=0):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(5, 16))
    x = centres[draw.integers(0, 5, n)] + 0.8 * draw.normal(size=(n, 16))
    return x * draw.uniform(0.2, 3, (n, 1))


def brute(table, asked, k):
    out = {}
    ids = np.array(list(table))
    matrix = np.array(list(table.values()))
    for q in asked:
        scores = (matrix * table[q]).sum(1)
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), scores[i]) for i in order]
    return out


@pytest.mark.parametrize("chunk", [4096, 16])
def test_forest_recall(spark, chunk, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", chunk)
    x = vectors(1500).astype(np.float32).astype(float)
    x[100:160] = x[100]
    rows = [(i, v.tolist(), 1, 0.5) for i, v in enumerate(x)]
    bad = [
        (2000, None, 1, 0.5),
        (2020, [0.0] * 16, 1, 0.5),
        (2040, [None, *[1.0] * 15], 1, 0.5),
        (2060, [float("nan"), *[1.0] * 15], 1, 0.5),
        (2080, [float("inf"), *[1.0] * 15], 1, 0.5),
        (2100, [1.0] * 3, 1, 0.5),
        (2120, [], 1, 0.5),
        (None, [1.0] * 16, 1, 0.5),
    ]
    table = spark.createDataFrame(rows + bad, VECTORS)
    good = ann.usable(table)
    assert good.count() == 1500
    found = {}
    for r in ann.search(good, good.filter(F.col("vec_id") % 20 == 0), k=10).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    wanted = brute(dict(enumerate(x)), range(0, 1500, 20), 10)
    assert set(found) == set(wanted)
    hits = 0
    for q, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11))
        assert q not in [r[1] for r in rows]
        order = [(-r[2], r[1]) for r in rows]
        assert order == sorted(order)
        for _, other, score in rows:
            assert score == (x[other] * x[q]).sum()
        hits += len({r[1] for r in rows} & {i for i, _ in wanted[q]})
    assert hits >= 0.9 * 10 * len(wanted)


@pytest.mark.parametrize("chunk", [4096, 64])
def test_repeats_cost_no_neighbours(spark, chunk, monkeypatch):
    """Every row five times, and one vec_id with a third of the vectors, all near each other."""
    monkeypatch.setattr(ann, "CHUNK", chunk)
    x = vectors(800, 3).astype(np.float32).astype(float)
    hot = x[20] * 1.5 + 0.01 * np.random.default_rng(4).normal(size=(400, 16)).astype(np.float32)
    ids = np.r_[np.arange(800), np.full(400, 7)]
    matrix = np.vstack([x, hot]).astype(np.float32).astype(float)
    rows = [(int(i), v.tolist(), 1, 0.5) for i, v in zip(ids, matrix, strict=True)]
    good = ann.usable(spark.createDataFrame(rows * 5, VECTORS))
    asked = range(0, 800, 20)
    found = {q: {} for q in asked}
    for r in ann.search(good, good.filter(F.col("vec_id") % 20 == 0), k=10).collect():
        found[r["query_id"]][r["vec_id"]] = r["score"]
    hits = 0
    for q in asked:
        scores = {}
        for i, score in zip(ids.tolist(), (matrix * x[q]).sum(1).tolist(), strict=True):
            scores[i] = max(score, scores.get(i, score))
        del scores[q]
        assert len(found[q]) == 10
        assert all(scores[i] == score for i, score in found[q].items() if i != 7)
        hits += len(set(found[q]) & set(sorted(scores, key=lambda i: (-scores[i], i))[:10]))
    assert hits >= 0.9 * 10 * len(asked)


def test_few_and_no_vectors(spark):
    few = ann.usable(spark.createDataFrame([(i, [float(i + 1), 1.0], 0, 0.0) for i in range(4)], VECTORS))
    rows = ann.search(few, few.filter("vec_id = 0")).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(rows)] == [(1, 3), (2, 2), (3, 1)]
    none = ann.usable(spark.createDataFrame([], VECTORS))
    assert ann.search(none, none).count() == 0


URLS = [
    None, "", "no scheme", "http://", "http://net/", "http://a.net", "http://A.Net/x?y#z", "https://example.net/en/1",
    "https://m.example.net/en", "https://xexample.net/en/", "http://example.com/de/2?q", "http://b.example.com/DE/",
    "ftp://c.example.com/de/#frag", "http://x.org/fr/://net/", "http://org/fr/", "http://org?x/fr/", "x://y://net/",
    "http://.net/", "http://net./", "http://a..net/en/", "http://example.net/en//", "http://example.net\n/en/",
]


def plain_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    end = min([i for i in range(cut, len(rest)) if rest[i] in "?#"], default=len(rest))
    path = rest[cut:end]
    fits = [
        (len(h + p), h + p, a)
        for a, h, p in queries.URL_RULES
        if (host == h or host.endswith(f".{h}")) and path.startswith(p)
    ]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_url_rules(spark):
    rows = [(i, u, "<p>", "x") for i, u in enumerate(URLS + URLS[4:8])] + [(None, "http://net/", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, rule string")
    found = url_filter.judge(pages, url_filter.rule_table(spark, queries.URL_RULES)).collect()
    assert len(found) == len(rows)
    wanted = sorted((str(i), *map(str, plain_verdict(u))) for i, u, *_ in rows)
    assert sorted(tuple(map(str, r)) for r in found) == wanted
    empty = url_filter.judge(pages.limit(0), url_filter.rule_table(spark, queries.URL_RULES))
    assert empty.count() == 0


def test_cascade_is_exact_over_its_universe(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", 2)
    draw = random.Random(1)
    keys = [f"host{i}.example/{draw.randint(0, 9)}/" for i in range(6000)]
    listed = set(draw.sample(keys, 700))
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    table = spark.createDataFrame([(k,) for k in listed], "key string")
    levels = url_filter.cascade(table, universe, "test")
    assert len(levels) > 3
    found = universe.filter(url_filter.member(F.col("key"), levels)).collect()
    assert {r["key"] for r in found} == listed


def test_long_lists_are_judged_in_blocks(spark, monkeypatch):
    """Lists beyond the size of a filter, and more false positives than that, stay exact."""
    draw = random.Random(5)
    hosts = [f"h{i}.example{i % 9}.net" for i in range(900)]
    rules = [(draw.choice(["allow", "block"]), h, "/" + "a" * draw.randint(0, 2)) for h in draw.sample(hosts, 200)]
    rules += [("block", "example3.net", "/"), ("allow", "net", "/aa"), ("block", "h1.example1.net", "/aaa")]
    rules = list({(h, p): (a, h, p) for a, h, p in rules}.values())
    urls = [f"http://{draw.choice(hosts)}/{'a' * draw.randint(0, 3)}" for _ in range(1500)] + ["", "x", None]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "action string, host string, path string")
    monkeypatch.setattr(url_filter, "MAX_KEYS", 70)
    assert url_filter.block_count(len(rules), 0) == 3 and url_filter.block_count(4, 70 * 200) == 3
    wanted = {}
    for i, url in enumerate(urls):
        host, _, path = (url or "").partition("://")[2].partition("/")
        fits = [
            (len(h + p), len(h), h + p, a)
            for a, h, p in rules
            if host and (host == h or host.endswith(f".{h}")) and ("/" + path).startswith(p)
        ]
        wanted[i] = max(fits)[2:] if fits else (None, "allow")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, table).collect()}
    assert found == wanted
    assert len({v for v in wanted.values()}) > 20
