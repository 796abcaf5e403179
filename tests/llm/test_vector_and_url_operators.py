import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaywork.llm import elias_fano, nearest, topk, url_filter

SCHEMA = "vec_id long, embedding array<float>, label int, rank string"


def vectors():
    r = np.random.default_rng(0)
    data = [(i, [float(x) for x in r.normal(size=8).astype(np.float32)], None, "x") for i in range(600)]
    same = data[7][1]
    data += [(600 + i, same, 1, None) for i in range(300)]  # one very common vector
    data += [(900, None, 1, "x"), (1000, [0.0] * 8, 1, "x"), (1100, [1.0, None] + [0.0] * 6, 1, "x"), (1200, [float("nan")] + [0.0] * 7, 1, "x"), (1300, [float("inf")] + [0.0] * 7, 1, "x"), (1400, [1.0, 2.0], 1, "x"), (1500, [], 1, "x"), (None, same, 1, "x")]
    return data


def usable(zero):
    out = [(i, np.array(v, float)) for i, v, *_ in vectors() if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and (zero or any(v))]
    return np.array([i for i, _ in out]), np.array([v for _, v in out])


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(vectors(), SCHEMA).repartition(3)


def test_topk_is_exact(df):
    ids, x = usable(True)
    x = np.floor(1024 * x)
    got = {}
    for r in topk.search(df, F.col("vec_id") % 100 == 0, pivots=9).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = {}
    for i in np.flatnonzero(ids % 100 == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if j != i][:10]
        want[int(ids[i])] = [(k + 1, int(ids[j]), int(s[j])) for k, j in enumerate(order)]
    assert {q: sorted(v) for q, v in got.items()} == want


def test_topk_of_few_and_of_huge_values(spark):
    data = [(0, [1e30, -1e30], 0, ""), (1, [1e30, 1e30], 0, ""), (2, [1e-3, 2.0], 0, "")]
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in topk.search(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 100 == 0).collect()]
    assert sorted(got) == [(0, 1, 1), (0, 2, 2)]
    assert topk.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).collect() == []


def test_nearest_scores_are_exact_and_recall_is_high(df):
    ids, x = usable(False)
    got = {}
    for r in nearest.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    place = {int(i): k for k, i in enumerate(ids)}
    hit = n = 0
    assert set(got) == {int(i) for i in ids if i % 100 == 0}
    for q, found in got.items():
        d = np.sqrt(((x - x[place[q]]) ** 2).sum(1))
        best = [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != q][:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert all(math.isclose(s, d[place[v]], rel_tol=1e-12, abs_tol=1e-12) for _, v, s in found)
        assert [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        hit, n = hit + len({v for _, v, _ in found} & set(best)), n + 10
    assert hit / n >= 0.9
    assert 600 not in got or [v for _, v, _ in got[600]] == [7, 601, 602, 603, 604, 605, 606, 607, 608, 609]


def test_nearest_of_nothing(spark):
    assert nearest.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).collect() == []


URLS = {
    1: ("http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/", "allow"),
    2: ("https://net/", "net", "/", "net/", "block"),
    3: ("https://x.net", "x.net", "", None, "allow"),
    4: ("https://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
    5: ("https://example.com/de/1", "example.com", "/de/1", "example.com/de/", "block"),
    6: ("ftp://m.org/fr/?q=://b.net/", "m.org", "/fr/", "org/fr/", "allow"),
    7: (None, "", "", None, "allow"),
    8: ("no scheme net/", "", "", None, "allow"),
    9: ("", "", "", None, "allow"),
    10: ("x://", "", "", None, "allow"),
    11: ("x://h\n.net/a\nb?c", "h\n.net", "/a\nb", "net/", "block"),
    12: ("http://" + "a." * 20000 + "net/" + "b/" * 20000, "a." * 20000 + "net", "/" + "b/" * 20000, "net/", "block"),
}


def test_listed_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "h", "k") for i, u in URLS.items()] + [(None, "http://q.net/", "h", "k")], "page_id long, url string, html string, verdict string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, labels).collect()}
    assert got == {i: u[1:] for i, u in URLS.items()} | {None: ("q.net", "/", "net/", "block")}


def test_planted_token_is_mined(spark):
    data = [(i, f"http://site{i % 5}.example.org/{'casino' if i % 3 == 0 else 'news'}/{i}?id={i}") for i in range(300)]
    labels = [(i, 1, int(i % 3 == 0 and i % 5 != 1)) for i in range(0, 300, 2)] + [(None, None, None), (2, None, 1)]
    got = {r["page_id"]: r for r in url_filter.judge(spark.createDataFrame(data, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all((got[i]["verdict"] == "block") == (i % 3 == 0) for i in range(300) if i % 5 != 1 and i != 2)
    assert all(got[i]["score"] is None or 0.6 <= got[i]["score"] <= 1 for i in got)


def test_url_filter_of_nothing(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_elias_fano_levels():
    r = np.random.default_rng(0)
    for n, u in ((0, 1), (1, 1), (1, 5), (5, 5), (1000, 1000), (1000, 10**6), (3000, 10**12)):
        v = np.sort(r.integers(0, u, n))
        e = elias_fano.EliasFano.of(v)
        assert (e.get(np.arange(n)) == v).all()
        x = r.integers(0, u + 10, 500)
        assert (e.successor(x, np.zeros(500, np.int64), np.full(500, n)) == np.searchsorted(v, x)).all()
    k = np.unique(r.integers(0, 300, 20000) * 10**10 + r.integers(0, 40, 20000) * 10**7 + r.integers(0, 10**6, 20000))
    pair, at = np.unique(k // 10**7, return_inverse=True)
    first, of_pair = np.unique(pair // 1000, return_inverse=True)
    codes = [r.integers(1, 65535, (len(pair), 2)), r.integers(1, 65535, len(k))]
    made = elias_fano.Trie.of(first, [(of_pair, pair % 1000), (at, k % 10**7)], codes)
    trie = elias_fano.Trie.from_buffer(np.frombuffer(made.to_bytes(), np.uint8))
    one = trie.find(0, first, first)
    two = trie.find(1, one[of_pair], pair % 1000)
    three = trie.find(2, two[at], k % 10**7)
    assert (one == np.arange(len(first))).all() and (trie.codes[0][two] == codes[0]).all() and (trie.codes[1][three][:, 0] == codes[1]).all()
    assert (trie.find(2, two[at], k % 10**7 + 10**6) == -1).all() and (trie.find(2, np.full(len(at), -1), k % 10**7) == -1).all() and (trie.find(0, first, first + 5000) == -1).all()


def test_elias_fano_refuses_values_that_descend():
    with pytest.raises(ValueError):
        elias_fano.EliasFano.of(np.array([3, 7, 5]))


def test_elias_fano_finds_nothing_beyond_the_last_value():
    """Also where the high bits fill their last word."""
    for n in range(1, 200):
        v = np.arange(n) * 12 + 5
        e = elias_fano.EliasFano.of(v)
        x = np.arange(-3, n * 12 + 40)
        assert (e.successor(x, np.zeros(len(x), np.int64), np.full(len(x), n)) == np.searchsorted(v, x)).all(), n


def test_elias_fano_search_costs_no_select_a_step():
    """Against numpy's search of plain values; with the high bits selected anew in each step it took 15 times that."""
    import time

    def seconds(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    r = np.random.default_rng(2)
    n = 200_000
    v, x = np.sort(r.integers(0, 10**10, n)), np.sort(r.integers(0, 10**10, n))
    first = np.searchsorted(v, x)
    lo = np.maximum(first - r.integers(0, 200, n), 0)
    hi = np.minimum(lo + r.integers(0, 400, n), n)
    made = elias_fano.EliasFano.of(v)
    fresh = lambda: elias_fano.EliasFano(made.n, made.shift, made.low, made.high)
    assert (fresh().successor(x, lo, hi) == np.clip(first, lo, hi)).all()
    assert seconds(lambda: fresh().successor(x, lo, hi)) < 6 * seconds(lambda: np.searchsorted(v, x))
