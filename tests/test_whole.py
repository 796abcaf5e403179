"""Queries leave out no entry, moment or text: brute force over the smallest tables and small fixtures."""

import datetime as dt
import random
import re
from collections import Counter

import pytest

from assaywork.operators import citations, timeline
from assaywork.plans import catalog
from assaywork.sources.views import view
from tests.test_queries import FOLDER

QUERIES = catalog.queries()
START = dt.datetime(2024, 2, 27)


def test_every_deploy_has_its_impact(spark):
    events = [(r["ts"], r["failed"]) for r in view(spark, FOLDER, "event_traces").collect()]
    day = dt.timedelta(days=1)
    want = {}
    for r in view(spark, FOLDER, "audit").filter("action = 'rule.deploy'").collect():
        before, after = [f for t, f in events if r["ts"] - day <= t < r["ts"]], [f for t, f in events if r["ts"] <= t < r["ts"] + day]
        want[r["entry_id"]] = (r["rule_id"], len(before), len(after), before.count(False), after.count(False))
    got = {r["entry_id"]: (r["rule_id"], r["before_n"], r["after_n"], r["before_passed"], r["after_passed"]) for r in QUERIES["rule_impact"](spark, FOLDER).collect()}
    assert len(want) == 250 and got == want


def test_impact_at_edges(spark):
    r = random.Random(1)
    at = [START + dt.timedelta(seconds=30 * r.randrange(12000), microseconds=r.choice([0, 0, 1])) for _ in range(400)] + [START + dt.timedelta(days=d) for d in (0, 1, 2, 2)]
    events = [(t, r.random() < 0.5) for t in at]
    entries = at[::3] + [START + dt.timedelta(days=9)]
    got = {x["ts"]: tuple(x)[1:] for x in timeline.impact(spark.createDataFrame([(t,) for t in entries], "ts timestamp_ntz"), spark.createDataFrame(events, "ts timestamp_ntz, failed boolean")).collect()}
    day = dt.timedelta(days=1)
    want = {}
    for e in entries:
        before, after = [f for t, f in events if e - day <= t < e], [f for t, f in events if e <= t < e + day]
        want[e] = (len(before), len(after), before.count(False), after.count(False))
    assert got == want


def test_every_failing_moment_is_in_a_pattern(spark):
    want = Counter(r["failed"] for r in view(spark, FOLDER, "moments").filter("failed <> ''").collect())
    assert {r["pattern"]: r["moments"] for r in QUERIES["bulk_pattern"](spark, FOLDER).collect()} == want


def greedy(entries):
    """(tenant, first, n) by the plain walk over sorted positions."""
    out = []
    for tenant in {t for t, _ in entries}:
        xs = sorted(x for t, x in entries if t == tenant)
        width, found = int((xs[-1] - xs[0]) * 0.05), []
        for x in xs:
            if found and x - found[-1][1] <= width:
                found[-1][2] += 1
            else:
                found.append([tenant, x, 1])
        out += map(tuple, found)
    return sorted(out, key=repr)


def test_every_deploy_joins_a_cluster(spark):
    deploys = view(spark, FOLDER, "audit").filter("action = 'rule.deploy'").selectExpr("tenant_id", "unix_timestamp(ts) as x").collect()
    df = QUERIES["marker_clusters"](spark, FOLDER)
    got = sorted(((r["tenant_id"], r["first"], r["n"]) for r in df.collect()), key=repr)
    assert sum(n for *_, n in got) == len(deploys) == 250
    assert got == greedy([tuple(r) for r in deploys])
    assert dict(df.dtypes) == {"tenant_id": "string", "first": "bigint", "n": "int"}


def test_clusters_at_edges(spark):
    r = random.Random(2)
    entries = [("a", r.randrange(1000)) for _ in range(300)] + [("b", 7)] * 3 + [("c", x) for x in (0, 4, 5, 6, 10, 11, 100)] + [(None, x) for x in (-50, 50)]
    got = [(x["tenant_id"], x["first"], x["n"]) for x in timeline.clusters(spark.createDataFrame(entries, "tenant_id string, x long")).collect()]
    assert sorted(got, key=repr) == greedy(entries)
    assert timeline.clusters(spark.createDataFrame([], "tenant_id string, x long")).collect() == []


def plain_citations(text):
    """(kind, identifier, start) by the patterns, over the whole text."""
    urls = [m.start() for m in re.finditer(citations.PATTERNS["url"], text, re.ASCII)]
    out = []
    for kind, pattern in citations.PATTERNS.items():
        for m in re.finditer(pattern, text, 0 if kind == "author_year" else re.ASCII):
            name = m[0].rstrip(".,;:!?)\"'>") if kind in ("url", "doi") else m[1].strip()
            if kind != "doi" or not any(u <= m.start() and not re.search(r"\s", text[u : m.start()]) for u in urls):
                out.append((kind, name, m.start()))
    return sorted(out, key=lambda c: c[2])


def test_cited_outputs_are_whole_texts(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    outputs = {r["trace_id"]: r["output"] for r in view(spark, FOLDER, "cited_outputs").collect()}
    assert max(map(len, texts.values())) > 10000 and outputs.keys() == texts.keys()
    assert all(outputs[k].startswith(f"{t} [1] see ") for k, t in texts.items())
    want = sorted((k, *c) for k, t in outputs.items() for c in plain_citations(t))
    got = QUERIES["extract_citations"](spark, FOLDER).select("trace_id", "kind", "identifier", "start").collect()
    assert sorted(map(tuple, got)) == want
    assert {r[0] for r in QUERIES["dedupe_sources"](spark, FOLDER).collect()} == {c[2] for c in want if c[1] in ("url", "doi")}


def test_citations_of_a_long_text(spark):
    part = "word " * 100 + "http://a.org/10.1234/x, 10.1234/y [3] https://b.org/z(10.5555/q http://c.org/10.1234/w) "
    text = part * 60
    got = citations.extract(spark.createDataFrame([(1, text), (2, None), (3, "")], "trace_id long, output string"))
    assert [(r["kind"], r["identifier"], r["start"]) for r in got.orderBy("place").collect()] == plain_citations(text)
    assert got.filter("start > 300").count() == got.count()


def test_citations_meet_every_source_that_has_them(spark):
    outputs = [(1, "see http://a.org/x, 10.1234/ab. and (http://b.org/none) [1]"), (2, "10.1234/ab https://doi.org/10.1234/ab http://a.org/x"), (3, "no source (Smith, 2019)"), (4, None)]
    pages = [(10, "http://a.org/x"), (11, " http://a.org/x "), (12, "https://doi.org/10.1234/ab"), (13, "10.1234/ab"), (14, "http://c.org/"), (15, None)]
    norm = lambda x: "https://doi.org/" + x if re.match(r"10\.\d{4,9}/", x) else x
    want = []
    for k, text in outputs:
        for place, (kind, name, _) in enumerate(plain_citations(text or "")):
            if kind in ("url", "doi"):
                want += [(k, place, name, *p) for p in pages if p[1] and norm(p[1].strip()) == norm(name)] or [(k, place, name, None, None)]
    got = citations.with_sources(citations.extract(spark.createDataFrame(outputs, "trace_id long, output string")), spark.createDataFrame(pages, "page_id long, url string"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert len(want) == 11


def test_source_join_keeps_all_citations(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/pages.parquet").select("page_id", "url").collect()]
    want = Counter()
    for r in view(spark, FOLDER, "cited_outputs").collect():
        for place, (kind, name, _) in enumerate(plain_citations(r["output"])):
            if kind in ("url", "doi"):
                source = f"https://doi.org/{name}" if kind == "doi" else name
                want.update([(r["trace_id"], place, name, *p) for p in pages if p[1] == source] or [(r["trace_id"], place, name, None, None)])
    assert Counter(map(tuple, QUERIES["citation_source_join"](spark, FOLDER).collect())) == want


def test_live_pulse_rates_all_evals_of_a_day(spark):
    now = dt.datetime(1998, 6, 1)
    evals = [r["passed"] for r in view(spark, FOLDER, "evals").collect() if now - dt.timedelta(days=1) <= r["created_at"] < now]
    newest = sorted((r for r in view(spark, FOLDER, "moments").collect() if r["significance"] >= 0.4 and r["ts"] < now), key=lambda r: (-r["ts"].timestamp(), r["trace_id"]))[:50]
    assert evals and len(newest) == 50
    want = (int(1000 * sum(evals) / len(evals) + 0.5) / 1000, sum(r["kind"] != "normal-pass" for r in newest), sum(r["kind"] == "safety-violation" for r in newest))
    assert tuple(QUERIES["live_pulse"](spark, FOLDER).first()) == want
    old = sum(r["verdict"] == "pass" for r in newest) / 50
    assert abs(want[0] - old) > 0.01


@pytest.mark.parametrize("name", ["annotate_trend", "query_traces", "query_evals"])
def test_no_window_over_all_rows(spark, name):
    """What a window without partition reads is cut to a page or grouped by day before."""
    plan = [x.strip(" :+-") for x in QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    whole = [i for i, x in enumerate(plan) if x.startswith("Window [") and x.count("], [") == 1]
    assert whole
    for i in whole:
        below = next(x for x in plan[i + 1 :] if not x.startswith("Project"))
        assert below.startswith(("GlobalLimit", "Aggregate [day")), plan[i : i + 3]


def test_bucket_at_or_before(spark):
    hour = dt.timedelta(hours=1)
    days = [START + d * 24 * hour for d in (0, 1, 5)]
    entries = [(i, START + h * hour) for i, h in enumerate((-1, 0, 23, 24, 60, 119, 120, 500))]
    got = timeline.at_or_before(spark.createDataFrame(entries, "entry_id long, ts timestamp_ntz"), spark.createDataFrame([(d,) for d in days], "bucket timestamp_ntz"))
    assert {r["entry_id"]: r["bucket"] for r in got.collect()} == {i: max(d for d in days if d <= t) for i, t in entries if t >= START}
