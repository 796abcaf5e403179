"""Mined URL rules see every label, segment and query key."""

import math
import random
from itertools import combinations

import pytest

from assaywork.llm import url_filter

DEEP = {
    "path": "http://h.example.org/a/b/c/{}/9",
    "query": "http://h.example.org/a?k=1&l=2&m=3&o=4&{}=5",
    "host": "http://" + "x." * 5 + "{}." + "y." * 70 + "example.org/a",
    "far path": "http://h.example.org/" + "a/" * 70 + "{}",
}


@pytest.mark.parametrize("place", DEEP)
def test_telling_token_may_stand_anywhere(spark, place):
    pages = [(i, DEEP[place].format("casino" if i % 3 == 0 else "news")) for i in range(120)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(60)]
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rules=()).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {i: "block" if i % 3 == 0 else "allow" for i in range(120)}


def test_top_level_domain_of_many_labels(spark):
    urls = spark.createDataFrame([("http://" + "a." * 100 + "tld/",)], "url string")
    host, path = url_filter.host_and_path(urls["url"])
    assert urls.select(url_filter.tokens(urls["url"], host, path)).first()[0] == ["h:a", "h:tld"]


@pytest.mark.parametrize("fewest", [1, url_filter.FEWEST])
def test_rules_match_brute_force(spark, fewest):
    r = random.Random(3)
    rows = [(sorted(r.sample("abcdefgh", r.randrange(0, 6))), r.random() < 0.3) for _ in range(200)]
    rows = [(t, bad or {"a", "b", "c"} <= set(t) or {"d", "e"} <= set(t)) for t, bad in rows]
    got = {tuple(x["antecedent"]): x["confidence"] for x in url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.02, 0.6, fewest).collect()}
    used = [(set(t), bad) for t, bad in rows if t or bad]
    base, want = sum(b for _, b in used) / len(used), {}
    for n in (1, 2, 3):
        for c in combinations("abcdefgh", n):
            hits = [b for t, b in used if set(c) <= t]
            if sum(hits) >= max(fewest, 0.02 * len(used)) and sum(hits) / len(hits) >= 0.6 and sum(hits) / len(hits) / base > 1:
                want[c] = sum(hits) / len(hits)
    assert want and got == pytest.approx(want)


def test_long_transactions_are_mined(spark):
    """Thirty tokens that always occur together have 2^30 frequent sets; antecedents have three tokens at most."""
    rows = [([f"t{j:02}" for j in range(30)], True)] * 20 + [(["t00", "u"], False)] * 20
    got = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"))
    assert got.count() == 29 + 30 * 29 // 2 + 30 * 29 * 28 // 6


def best_of_all(rows, least, confidence, urls):
    """The confidence of the most confident rule of any length that applies to each of ``urls``, by enumeration."""
    used = [(frozenset(t), bad) for t, bad in rows if t or bad]
    base, known = sum(b for _, b in used) / len(used), {}

    def of(c):
        if c not in known:
            hits = [b for t, b in used if c <= t]
            sure = sum(hits) / len(hits) if hits else 0
            known[c] = sure if sum(hits) >= least and sure >= confidence and sure / base > 1 else None
        return known[c]

    every = lambda t: (frozenset(c) for n in range(1, len(t) + 1) for c in combinations(t, n))
    return [max((x for c in every(t) if (x := of(c)) is not None), default=None) for t in urls]


@pytest.mark.parametrize("seed", [1, 2])
def test_deciding_rules_match_all_rules_of_any_length(spark, seed):
    r = random.Random(seed)
    rows = [(sorted(r.sample("abcdefgh", r.randrange(0, 9))), r.random() < 0.15) for _ in range(400)]
    rows = [(t, bad or ({"a", "b", "c", "d"} <= set(t) and r.random() < 0.9) or {"c", "e", "f", "g", "h"} <= set(t)) for t, bad in rows]
    found = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), 0.01, 0.6, 5, longest=None)
    urls = sorted({tuple(t) for t, _ in rows})
    best = url_filter.matched(spark.createDataFrame(list(enumerate(map(list, urls))), "key long, tokens array<string>"), found)
    got = {x["key"]: x["confidence"] for x in best.collect()}
    used = sum(bool(t) or bad for t, bad in rows)
    want = best_of_all(rows, max(5, math.ceil(0.01 * used)), 0.6, urls)
    assert [got.get(i) for i in range(len(urls))] == [x if x is None else pytest.approx(x) for x in want]
    assert found.filter("size(antecedent) > 3").count()


@pytest.mark.parametrize("n", [4, 5, 6])
def test_rule_of_many_tokens_blocks(spark, n):
    """URLs are bad only if all n keys are there; each n - 1 of them are mostly in good ones."""
    pages = [(i, "http://h.example.org/?" + "&".join(f"k{'abcdefgh'[j]}={i}" for j in range(n) if i % (n + 1) != j)) for i in range(60 * (n + 1))]
    labels = [(i, 1, int(i % (n + 1) == n)) for i in range(30 * (n + 1))]
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rules=())
    assert {r["page_id"]: r["verdict"] for r in got.collect()} == {i: "block" if i % (n + 1) == n else "allow" for i, _ in pages}


def test_deciding_rules_of_long_transactions_are_few(spark):
    """Thirty tokens that always occur together decide as each of them does."""
    rows = [([f"t{j:02}" for j in range(30)], True)] * 20 + [(["t00", "u"], False)] * 20
    got = url_filter.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), longest=None).collect()
    assert {(*x["antecedent"], x["confidence"]) for x in got} == {(f"t{j:02}", 1.0) for j in range(1, 30)}
