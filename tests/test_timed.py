"""Streams with state, span trees, sketches: against plain versions and with odd input."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from assaywork.functions import sketch
from assaywork.operators import spans
from assaywork.plans import timed
from assaywork.sources import ingest
from assaywork.sources.views import view
from assaywork.streaming import jobs, stateful

FOLDER = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)
EVENTS = "run_id long, agent_name string, ts timestamp, step long, event string, name string, text string, prompt_tokens long, completion_tokens long"


def event(run, seconds, kind, step=0, text=None, tokens=None, name=None):
    return (run, "a", T0 + timedelta(seconds=seconds), step, kind, name, text, tokens, tokens)


def arrive(spark, path, rows):
    spark.createDataFrame(rows, EVENTS).write.mode("append").parquet(path)
    return spark.readStream.schema(EVENTS).parquet(path)


def by_run(df):
    return {r["run_id"]: r for r in df.collect()}


def test_runs_time_out_and_streams_resume(spark):
    """A run that goes on in a later arrival, one that never ends, one with an error, and rows that can't count."""
    root = jobs.shared_folder(spark, "test-runs")
    first = [event(1, 0, "chain_start", text="in"), event(1, 1, "tool_start", 2, "ask", name="find"), event(2, 0, "chain_start", text="x"), event(None, 5, "chain_end"), (3, "a", None, 0, "chain_end", None, None, None, None)]
    got = jobs.append_to(stateful.assembled_runs(arrive(spark, f"{root}/in", first)), root)
    assert got.collect() == []
    second = [event(1, 4, "tool_end", 2, "answer"), event(1, 5, "llm_start", 3), event(1, 7, "llm_end", 3, tokens=100), event(1, 9, "chain_end", text="out"), event(4, 9, "chain_start"), event(4, 10, "llm_end", 1, tokens=5), event(4, 12, "chain_error", text="bad")]
    got = by_run(jobs.append_to(stateful.assembled_runs(arrive(spark, f"{root}/in", second)), root))
    assert set(got) == {1, 4}
    r = got[1]
    assert (r["closed"], r["input"], r["output"], r["latency_ms"], r["prompt_tokens"], r["cost_usd"]) == ("end", "in", "out", 9000.0, 100, 0.0075)
    assert [tuple(c) for c in r["tool_calls"]] == [("find", "ask", "answer", 3000.0, "success")]
    assert [tuple(s) for s in r["spans"]] == [("find", "tool", 8000.0, "ok"), ("llm_call", "llm", 2000.0, "ok")]
    assert (got[4]["output"], got[4]["error"], got[4]["prompt_tokens"], got[4]["tool_calls"]) == ("ERROR: bad", "bad", None, None)
    third = [event(9, 7200, "chain_start")]
    got = by_run(jobs.append_to(stateful.assembled_runs(arrive(spark, f"{root}/in", third)), root))
    assert set(got) == {1, 2, 4} and got[2]["closed"] == "timeout" and got[2]["output"] is None
    batch = by_run(ingest.runs_of_callbacks(spark.createDataFrame([*first, *second], EVENTS)))
    assert {k: batch[k] for k in (1, 2, 4)} == {k: got[k].asDict() and got[k] for k in (1, 2, 4)}


def test_stream_of_runs_is_the_batch(spark):
    key = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert key(timed.stream_sessionize(spark, FOLDER)) == key(timed.ingest_callback_events(spark, FOLDER))


def test_redacted_runs_hide_content(spark):
    rows = spark.createDataFrame([event(1, 0, "chain_start", text="secret"), event(1, 3, "chain_end", text="secret")], EVENTS)
    r = ingest.runs_of_callbacks(rows, True).first()
    assert (r["input"], r["output"]) == ("[redacted]", "[redacted]")


def test_failures_come_again_after_a_while(spark):
    """Within one arrival, across arrivals, and after the state has ended."""
    root = jobs.shared_folder(spark, "test-failures")
    schema = "tenant_id string, agent_name string, rule_name string, trace_id long, ts timestamp"

    def put(*rows):
        spark.createDataFrame([("t", "a", rule, i, T0 + timedelta(hours=h)) for rule, i, h in rows], schema).write.mode("append").parquet(f"{root}/in")
        out = jobs.append_to(stateful.first_failures(spark.readStream.schema(schema).parquet(f"{root}/in"), "2 hours"), root)
        return sorted(r["trace_id"] for r in out.collect())

    assert put(("r", 1, 0), ("r", 2, 1), ("s", 3, 0), ("r", 4, 4)) == [1, 3, 4]
    assert put(("r", 5, 5), ("s", 6, 9)) == [1, 3, 4, 6]
    assert put(("r", 7, 30), ("s", 8, 30)) == [1, 3, 4, 6, 7, 8]


def plain_tree(rows):
    below, out = {}, []
    for no, parent, start in sorted(rows, key=lambda r: (r[2], r[0])):
        below.setdefault(parent, []).append(no)
    stack = [(n, 0) for n in reversed(below.get(None, []))]
    while stack:
        no, depth = stack.pop()
        out.append((no, depth))
        stack += [(x, depth + 1) for x in reversed(below.get(no, []))]
    return out or [(r[0], 0) for r in sorted(rows, key=lambda r: (r[2], r[0]))]


def test_trees_of_any_shape(spark):
    """Random forests with absent parents; a long chain; cycles, alone and beside a root; a span that is its own parent."""
    r = random.Random(6)
    traces = []
    for t in range(60):
        n = r.randrange(1, 30)
        traces.append([(i, r.choice([None, 99, *range(i)]) if i else None, r.randrange(5)) for i in range(n)])
    traces.append([(i, i - 1 if i else None, 0) for i in range(300)])
    traces.append([(0, None, 0), (1, 2, 0), (2, 1, 0), (3, 1, 0), (4, 4, 0), (5, 0, 0)])
    traces.append([(1, 2, 1), (2, 1, 0)])
    rows = [("t", t, no, parent, T0 + timedelta(days=start)) for t, own in enumerate(traces) for no, parent, start in own]
    got = spans.tree(spark.createDataFrame(rows, "tenant_id string, trace_id long, span_no int, parent_no int, start_time timestamp")).collect()
    for t, own in enumerate(traces):
        assert [(x["span_no"], x["depth"]) for x in sorted((x for x in got if x["trace_id"] == t), key=lambda x: x["place"])] == plain_tree(own), t


def test_sketches_merge_and_stay_within_their_bound(spark):
    r = random.Random(2)
    values = [r.choice([r.randrange(300), int(math.exp(r.uniform(0, 40)))]) for _ in range(4000)] + [0, 255, 256, 257, 2**62]
    rows = spark.createDataFrame([(v, i % 7, i % 2) for i, v in enumerate(values)], "v long, day int, k int")
    days = sketch.sketch(rows, F.col("v"), "k", "day")
    for per_cent in (1, 50, 95, 100):
        merged = {x["k"]: x["q"] for x in sketch.quantiles(days, ["k"], q=per_cent).collect()}
        for k in (0, 1):
            own = sorted(v for i, v in enumerate(values) if i % 2 == k)
            want = own[(len(own) * per_cent + 99) // 100 - 1]
            assert abs(merged[k] - want) <= want / 256
    buckets = rows.select("v", sketch.bucket(F.col("v")).alias("b")).orderBy("v").collect()
    assert [x["b"] for x in buckets] == sorted(x["b"] for x in buckets)
    assert days.groupBy("k", "day").count().agg(F.max("count")).first()[0] < 9000


@pytest.mark.parametrize("c", ["cast(null as long)", "-5"])
def test_sketch_of_nothing_and_of_less_than_nothing(spark, c):
    got = sketch.quantiles(sketch.sketch(spark.range(3).withColumn("k", F.lit(1)), F.expr(c), "k"), ["k"], q=50).collect()
    assert [x["q"] for x in got] in ([], [0.0])


def test_burst_counts_cross_midnight(spark):
    """The hour before a failure at ten past midnight begins the day before."""
    got = {r["trace_id"]: r["in_last_hour"] for r in timed.failure_burst(spark, FOLDER).collect()}
    rows = spark.read.parquet(f"{FOLDER}/events.parquet").filter("event_type = 'error'").select("event_id", "user_id", F.unix_timestamp("ts").alias("s"), F.get_json_object("props", "$.k").cast("long").alias("k")).collect()
    key = lambda r: (r["user_id"] % 20, (r["k"] or 0) % 5)
    assert got == {r["event_id"]: sum(key(x) == key(r) and r["s"] - 3600 <= x["s"] <= r["s"] for x in rows) for r in rows}


def test_exact_quantiles_of_odd_values(spark):
    """Negative, tiny, huge and repeated values, nulls, a null key, a group of one, a group of nothing; buckets make no difference."""
    r = random.Random(4)
    own = {"a": [r.choice([0.0, -3.5, 1e-9, 7.25, r.uniform(-5, 5), math.exp(r.uniform(0, 60))]) for _ in range(999)], "b": [0.125], None: [float(r.randrange(40)) for _ in range(500)], "none": []}
    rows = [(k, v) for k, vs in own.items() for v in [*vs, None]]
    df = spark.createDataFrame(rows, "k string, v double")
    for scale in (1, 1000):
        got = {x["k"]: (x["q50"], x["q95"], x["q100"]) for x in sketch.exact(df, F.col("v"), ["k"], scale, q50=0.5, q95=0.95, q100=1).collect()}
        assert set(got) == {"a", "b", None}
        for k, q in got.items():
            for share, value in zip((0.5, 0.95, 1), q):
                x, at = sorted(own[k]), (len(own[k]) - 1) * share
                low, high = x[math.floor(at)], x[math.ceil(at)]
                assert value == pytest.approx(low * (1 - at % 1) + high * (at % 1), rel=1e-14)


def percentile(values, share):
    x, at = sorted(v for v in values if v is not None), (sum(v is not None for v in values) - 1) * share
    return x[math.floor(at)] * (1 - at % 1) + x[math.ceil(at)] * (at % 1)


def by_key(rows, key, value):
    out = {}
    for x in rows:
        out.setdefault(x[key], []).append(x[value])
    return out


def test_calibration_has_exact_quantiles(spark):
    rows = view(spark, FOLDER, "agent_traces").filter("ts >= timestamp_ntz'1998-06-01 00:00:00' - interval 90 days and ts < timestamp_ntz'1998-06-01 00:00:00'").collect()
    own = by_key(rows, "agent_name", "cost_usd")
    got = {x["agent_name"]: (x["median_now"], x["recommended"]) for x in timed.threshold_calibration(spark, FOLDER).collect()}
    assert got == {k: pytest.approx((percentile(v, 0.5), percentile(v, 0.95)), abs=5.1e-7) for k, v in own.items()}


def test_tool_latency_has_exact_quantiles(spark):
    own = by_key(view(spark, FOLDER, "tool_calls").collect(), "tool_name", "latency_ms")
    got = {x["tool_name"]: (x["median_ms"], x["p95_ms"]) for x in timed.tool_latency(spark, FOLDER).collect()}
    assert got == {k: pytest.approx((percentile(v, 0.5), percentile(v, 0.95)), abs=5.1e-4) for k, v in own.items()}


def test_token_attribution_has_exact_medians(spark):
    rows = view(spark, FOLDER, "text_traces").select("trace_id", "agent_name", "completion_tokens").collect()
    middle = {k: percentile(v, 0.5) for k, v in by_key(rows, "agent_name", "completion_tokens").items()}
    got = {x["trace_id"]: x["ratio"] for x in timed.token_attribution(spark, FOLDER).collect()}
    assert got == {x["trace_id"]: pytest.approx(x["completion_tokens"] / middle[x["agent_name"]], abs=5.1e-4) for x in rows if x["completion_tokens"] >= 2 * middle[x["agent_name"]]}


def test_runs_of_one_bucket(spark):
    """Runs of one bucket end, fail, go on and time out apart from each other."""
    root = jobs.shared_folder(spark, "test-buckets")
    stream = lambda rows: jobs.append_to(stateful.assembled_runs(arrive(spark, f"{root}/in", rows), buckets=1), root)
    first = [event(i, i + s, k) for i in range(60) for s, k in ((0, "chain_start"), (1, "llm_start"))]
    assert stream(first).collect() == []
    second = [event(i, i + 9, ("chain_end", "chain_error", "llm_end")[i % 3], 1, f'a "{i}"') for i in range(60)]
    ended = by_run(stream(second))
    assert set(ended) == {i for i in range(60) if i % 3 < 2}
    third = [(99, "a", T0 + timedelta(hours=2), 0, "chain_start", None, None, None, None)]
    late = [(99, "b", T0 + timedelta(hours=2, seconds=1), 0, "chain_end", None, "end", None, None), event(98, 7201, "chain_start")]
    got = by_run(stream(third))
    assert set(got) == set(range(60)) and {got[i]["closed"] for i in range(2, 60, 3)} == {"timeout"}
    got = by_run(stream(late))
    assert set(got) == {*range(60), 99}
    batch = by_run(ingest.runs_of_callbacks(spark.createDataFrame([*first, *second, *third, *late[:1]], EVENTS)))
    assert batch == got


def test_runs_share_their_bucket_of_state(spark):
    root = jobs.shared_folder(spark, "test-state")
    jobs.append_to(stateful.assembled_runs(arrive(spark, f"{root}/in", [event(i, 0, "chain_start") for i in range(50)]), buckets=2), root)
    state = spark.read.format("statestore").load(f"{root}/state").select("key.bucket").collect()
    assert sorted(r["bucket"] for r in state) == [0, 1]
