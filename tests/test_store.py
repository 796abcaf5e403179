"""Tables kept up by period: what a late arrival touches, what a dashboard reads, what retention leaves."""

import re
from datetime import date, datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from assaywork.operators import derived
from assaywork.plans import kept
from assaywork.sources.store import KEYS, Store, beside

TRACES = "tenant_id string, trace_id long, agent_name string, ts timestamp_ntz, cost_usd double"
RESULTS = "tenant_id string, trace_id long, eval_type string, rule_no int, rule_name string, passed boolean, skipped boolean, score double, created_at timestamp_ntz"
SPANS = "tenant_id string, trace_id long, span_no int, start_time timestamp_ntz"


def on(day, hour=0):
    return datetime(2024, 3, day, hour)


@pytest.fixture
def store(spark, tmp_path):
    """Four days of six traces of two tenants, three results and a span each."""
    s = Store(spark, f"file://{tmp_path}", buckets=2)
    traces = [(f"t{i % 2}", 10 * d + i, "a", on(d, i), 0.01) for d in range(1, 5) for i in range(6)]
    results = [(t, k, ("safety", "cost")[n == 2], n, ("no_pii", "no_stub_output", "token_efficiency")[n], (k + n) % 4 > 0, k % 5 == n, 0.5, ts) for t, k, _, ts, _ in traces for n in range(3)]
    s.add_traces(spark.createDataFrame(traces, TRACES))
    s.derive(s.add_parts("results", spark.createDataFrame(results, RESULTS), "created_at"))
    s.add_parts("spans", spark.createDataFrame([(t, k, 1, ts) for t, k, _, ts, _ in traces], SPANS), "start_time")
    yield s
    spark.sql(f"drop database {s.name} cascade")


def files(tmp_path, table, day):
    return {p.name: p.stat().st_mtime_ns for p in Path(tmp_path, table, f"period=2024-03-{day:02}").glob("*.parquet")}


def ids(df):
    return sorted(r[0] for r in df.select("trace_id").collect())


def test_late_result_touches_its_trace_period_alone(spark, store, tmp_path):
    before = {d: files(tmp_path, "moments", d) for d in range(1, 5)}
    late = spark.createDataFrame([("t0", 20, "safety", 3, "no_blocklist_words", False, False, 0.0, on(4))], RESULTS)
    touched = store.add_parts("results", late, "created_at")
    assert touched == {date(2024, 3, 2)}
    store.derive(touched)
    after = {d: files(tmp_path, "moments", d) for d in range(1, 5)}
    assert [d for d in after if after[d] != before[d]] == [2]
    m = store.read("moments").filter("trace_id = 20").first()
    assert m["kind"] == "safety-violation" and "no_blocklist_words" in m["failed"]
    whole = derived.evals(store.stored("results"), "period", "detached").select(store.stored("evals").columns).exceptAll(store.stored("evals"))
    assert whole.isEmpty()


def test_same_arrival_twice(spark, store):
    again = store.stored("traces").drop("period")
    n = store.read("traces").count()
    store.add_traces(spark.createDataFrame(again.collect(), again.schema))
    assert store.read("traces").count() == n


def test_null_time_and_no_rows(spark, store):
    assert store.add_traces(spark.createDataFrame([("t0", 99, "a", None, None)], TRACES)) == {date(1970, 1, 1)}
    assert store.add_parts("results", spark.createDataFrame([], RESULTS), "created_at") == set()
    store.derive([date(1970, 1, 1)])
    assert store.read("moments").filter("trace_id = 99").first()["verdict"] == "unevaluated"


def test_derived_without_exchange_and_pruned(spark, store):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        of = lambda t: store.stored(t).filter(F.col("period") == F.lit(date(2024, 3, 2)))
        plan = derived.moments(of("traces"), of("results"), derived.evals(of("results")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert "Exchange" not in plan
    scans = re.findall(r"PartitionFilters: \[[^\]]*period[^\]]*\]", plan)
    assert len(scans) == 3


def test_meter_scans_twice(store):
    m = derived.rule_meter(store.read("moments"), *[F.lit(on(d)) for d in (1, 3, 5)])
    assert len(re.findall(r"FileScan|Scan parquet", m._jdf.queryExecution().optimizedPlan().toString() + m._jdf.queryExecution().sparkPlan().toString())) <= 2
    rows = {r["rule_name"]: r for r in m.collect()}
    plain = [r for r in store.read("moments").collect() if r["ts"] >= on(3)]
    assert rows[""]["cur"] == len(plain) and rows["no_pii"]["cur"] == sum("no_pii" in r["failed"].split(",") for r in plain)
    assert sum(rows[""][f"b{k}"] for k in range(6)) == len(plain)


def test_retention(store, tmp_path):
    kept = files(tmp_path, "moments", 4)
    # Days 1 and 2 go whole, of day 3 the hours before three.
    assert store.retain(on(3, 3)) == 15
    left = [33, 34, 35, *range(40, 46)]
    assert ids(store.read("traces")) == ids(store.read("spans")) == ids(store.read("moments")) == left
    assert store.periods("traces") == {date(2024, 3, 3), date(2024, 3, 4)} and not files(tmp_path, "traces", 1)
    results = store.read("results")
    assert results.count() == 72 and results.filter("trace_id is null").count() == 45
    assert store.read("evals").filter("trace_id is null").count() == 30
    was = {t: files(tmp_path, t, 3) for t in ("traces", "spans", "moments", "evals", "results")}
    assert store.retain(on(3, 3)) == 0
    assert was == {t: files(tmp_path, t, 3) for t in was} and files(tmp_path, "moments", 4) == kept


def test_evals_without_a_trace_stay_when_derived_again(store):
    store.retain(on(3, 3))
    before = sorted(map(repr, store.stored("evals").collect()))
    store.derive(store.periods("evals"))
    assert sorted(map(repr, store.stored("evals").collect())) == before
    assert ids(store.read("moments")) == [33, 34, 35, *range(40, 46)]


def test_retention_of_one_tenant(store):
    assert store.retain(on(3), "t0") == 6
    left = store.read("traces").filter(F.col("ts") < F.lit(on(3)))
    assert {r["tenant_id"] for r in left.collect()} == {"t1"}
    with pytest.raises(ValueError):
        store.retain(on(3), "")


def test_first_arrival_is_read_once_and_dealt_once(spark, tmp_path):
    """Rows are made once, and told apart where the write has dealt them."""
    s, made = Store(spark, f"file://{tmp_path}", buckets=2), spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            made.add(part.num_rows)
            yield part

    rows = spark.createDataFrame([("t0", i, "a", on(1 + i % 3), 0.01) for i in (*range(30), 3, 4)], TRACES)
    assert s.add_traces(rows.mapInArrow(count, rows.schema)) == {date(2024, 3, d) for d in (1, 2, 3)}
    assert made.value == 32 and s.read("traces").count() == 30
    spark.sql(f"drop database {s.name} cascade")


def test_buckets_follow_rows():
    assert [kept.buckets(n, 6) for n in (0, 600_000, 6_000_000, 36_000_000, 216_000_000)] == [4, 4, 6, 18, 108]


def test_lost_traces_are_found_without_exchange(spark, store):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lost = store.stored("traces").filter(F.col("ts") < F.lit(on(3, 3))).select("period", *KEYS)
        plans = {how: beside(store.stored("results"), lost, how)._jdf.queryExecution().executedPlan().toString() for how in ("left", "left_anti")}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert all("SortMergeJoin" in p and "Exchange" not in p for p in plans.values())
