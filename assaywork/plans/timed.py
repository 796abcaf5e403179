"""Queries over time: bursts, numbering, quantiles, runs of callbacks, first failures. Where the SQL of the same name in
``sqlplans`` is the oracle, it says what is wanted, not how it's split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaywork.functions import sketch
from assaywork.operators import spans
from assaywork.plans.sqlplans import AS_OF, FAILED, last
from assaywork.sources import ingest
from assaywork.sources.views import oracle, render, run_sql, view
from assaywork.streaming import jobs, stateful


def _half_up(c: Column, digits: int) -> Column:
    return F.floor(c * 10**digits + 0.5) / 10**digits


def _when(sql: str) -> str:
    return render(sql.replace("AS_OF", AS_OF), "spark")


def failure_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of the hour up to each one. Each is copied to its own hour and to the next as a halo, and counted in its own, so
    that a window holds two hours of an agent and rule at most."""
    f = run_sql(spark, sf_dir, FAILED)
    dealt = f.withColumn("halo", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("hour", F.floor(F.col("sec") / 3600) + F.col("halo"))
    own = Window.partitionBy("agent_name", "rule_name", "hour").orderBy("sec").rangeBetween(-3600, Window.currentRow)
    counted = dealt.withColumn("in_last_hour", F.count("*").over(own)).filter("halo = 0")
    per_hour = F.count("*") / F.greatest(F.lit(1.0), (F.max("sec") - F.min("sec")) / 3600.0)
    base = f.groupBy("agent_name", "rule_name").agg(per_hour.alias("per_hour"))
    found = counted.join(base, ["agent_name", "rule_name"])
    return found.select("trace_id", "agent_name", "rule_name", "in_last_hour", _half_up(F.col("per_hour"), 6).alias("baseline"), (F.col("in_last_hour") > 2 * F.col("per_hour")).alias("burst"))


def score_sparkline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evals of each agent, numbered in order of time: within an hour by a window, from the number of those of earlier hours on, a
    running sum over a table of hours. So no task holds an agent whole."""
    key = ["tenant_id", "trace_id"]
    e = view(spark, sf_dir, "evals").join(view(spark, sf_dir, "agent_traces").select(*key, "agent_name"), key)
    e = e.select("agent_name", F.date_trunc("hour", "created_at").alias("hour"), "created_at", "trace_id", "eval_type", "score")
    hours = e.groupBy("agent_name", "hour").agg(F.count("*").alias("n"))
    before = hours.select("agent_name", "hour", (F.sum("n").over(Window.partitionBy("agent_name").orderBy("hour")) - F.col("n")).alias("before"))
    own = Window.partitionBy("agent_name", "hour").orderBy("created_at", "trace_id", "eval_type")
    return e.withColumn("at", F.row_number().over(own)).join(before, ["agent_name", "hour"]).select("agent_name", (F.col("before") + F.col("at")).alias("place"), "score")


def threshold_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of each agent now and before."""
    t = view(spark, sf_dir, "agent_traces")
    now, then = F.expr(_when(last("ts", 90))), F.expr(_when("ts < @[shift:AS_OF;90]"))
    t = t.withColumn("period", F.when(now, "now").when(then, "then")).filter("period is not null")
    q = sketch.exact(t, F.col("cost_usd"), ["agent_name", "period"], 1000000, median=0.5, p95=0.95)
    rank = t.groupBy("agent_name", "period").agg(_half_up(F.avg(F.when(F.col("cost_usd") <= 0.1, 1.0).otherwise(0.0)), 4).alias("rank"))
    both = sketch.null_safe(rank, q, ["agent_name", "period"], "left")
    of = lambda p: both.filter(F.col("period") == p).select("agent_name", F.col("rank").alias(f"rank_{p}"), _half_up(F.col("median"), 6).alias(f"median_{p}"), _half_up(F.col("p95"), 6).alias(f"p95_{p}"))
    j = of("now").join(of("then"), "agent_name", "left")
    return j.select("agent_name", "rank_now", "rank_then", "median_now", "median_then", _half_up(F.col("median_now") - F.col("median_then"), 6).alias("median_shift"), F.col("p95_now").alias("recommended"))


def tool_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = view(spark, sf_dir, "tool_calls")
    q = sketch.exact(c, F.col("latency_ms"), ["tool_name"], median_ms=0.5, p95_ms=0.95)
    t = c.groupBy("tool_name").agg(F.count("*").alias("calls"), _half_up(F.avg("latency_ms"), 3).alias("avg_ms"), F.count_if(F.col("error").isNotNull()).alias("errors"))
    return sketch.null_safe(t, q, ["tool_name"], "left").select("tool_name", "calls", "avg_ms", _half_up(F.col("median_ms"), 3).alias("median_ms"), _half_up(F.col("p95_ms"), 3).alias("p95_ms"), "errors")


def token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, "text_traces")
    m = sketch.exact(t, F.col("completion_tokens"), ["agent_name"], median=0.5)
    ratio = F.col("completion_tokens") / F.col("median")
    return t.join(m, "agent_name").filter((F.col("median") > 0) & (ratio >= 2)).select("trace_id", "agent_name", _half_up(ratio, 3).alias("ratio"))


def span_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.rollup(view(spark, sf_dir, "spans"))


#: Callback events of runs of six, each a second and k milliseconds after the one before; some have no end, some end in an error.
CALLBACKS = """select cast(floor(trace_id / 6) as bigint) as run_id, agent_name, trace_id % 6 as pos, cast(floor(trace_id / 6) as bigint) * 60000 + (trace_id % 6) * 1000 + coalesce(k, 0) % 1000 as ms,
  coalesce(k, 0) as k, event_type from event_traces where not (trace_id % 6 = 5 and floor(trace_id / 6) % 11 = 0)"""


def _callbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = run_sql(spark, sf_dir, CALLBACKS)
    failed = F.col("run_id") % 5 == 0
    kinds = F.get(F.array(*map(F.lit, ("chain_start", "llm_start", "llm_end", "tool_start", "tool_end", "chain_end"))), F.col("pos").cast("int"))
    event = F.when((F.col("pos") == 5) & failed, "chain_error").otherwise(kinds)
    step = F.when(F.col("pos").isin(0, 5), 0).when(F.col("pos").isin(1, 2), 1).otherwise(2)
    tokens = lambda by: F.when(F.col("pos") == 2, F.col("k") * by)
    return e.select("run_id", F.concat(F.lit("agent-"), F.col("run_id") % 20).alias("agent_name"), F.timestamp_millis(F.lit(1704067200000) + F.col("ms")).alias("ts"), step.cast("long").alias("step"), event.alias("event"),
                    F.when(F.col("pos").isin(3, 4), F.concat(F.lit("tool-"), F.col("run_id") % 3)).alias("name"), F.concat("event_type", F.lit("-"), F.col("pos").cast("string")).alias("text"), tokens(1).cast("long").alias("prompt_tokens"), tokens(2).cast("long").alias("completion_tokens"))


def _said(runs: DataFrame) -> DataFrame:
    """Calls and spans as text."""
    text = lambda c, *names: F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[x[n].cast("long").cast("string") if n == "duration_ms" else x[n] for n in names])), ",")
    return runs.withColumns({"tool_calls": text("tool_calls", "tool_name", "input", "output", "duration_ms", "status"), "spans": text("spans", "name", "kind", "duration_ms", "status")})


def ingest_callback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(ingest.runs_of_callbacks(_callbacks(spark, sf_dir), F.col("run_id") % 7 == 0))


def stream_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs assembled as their events arrive: three arrivals, the stream resumed for each, so that runs are cut across them, and one
    late heartbeat, after which runs without an end time out."""
    e = _callbacks(spark, sf_dir)
    root = jobs.shared_folder(spark, "runs")
    bounds = e.agg(F.min("run_id"), F.max("run_id"), F.max("ts")).first()
    third = (bounds[1] - bounds[0]) // 3 + 1
    # an arrival ends within a run: its later events come with the next
    arrival = F.floor((F.col("run_id") - bounds[0] + F.when(F.col("event").endswith("_end") | (F.col("event") == "chain_error"), 1).otherwise(0)) / third)
    heartbeat = spark.range(1).select(F.lit(-1).cast("long").alias("run_id"), F.lit(None).cast("string").alias("agent_name"), (F.lit(bounds[2]) + F.expr("interval 2 days")).alias("ts"), F.lit(0).cast("long").alias("step"), F.lit("chain_start").alias("event"), *[F.lit(None).cast(t).alias(c) for c, t in (("name", "string"), ("text", "string"), ("prompt_tokens", "long"), ("completion_tokens", "long"))])
    for k in range(4):
        part = heartbeat if k == 3 else e.filter(F.least(arrival, F.lit(2)) == k)
        part.write.mode("append").parquet(f"{root}/arrivals")
        runs = jobs.append_to(stateful.assembled_runs(spark.readStream.schema(e.schema).parquet(f"{root}/arrivals"), redact=F.col("run_id") % 7 == 0), root)
    return _said(runs.filter("run_id >= 0"))


def stream_first_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of an agent's rule that had none for two days."""
    e = jobs.events(spark, sf_dir).filter("failed")
    found = stateful.first_failures(e.select("tenant_id", "agent_name", F.concat(F.lit("rule-"), F.coalesce(F.col("k"), F.lit(0)) % 5).alias("rule_name"), "trace_id", "ts"))
    return jobs.run_to_end(found, "append").select("tenant_id", "agent_name", "rule_name", "trace_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


QUERIES = {f.__name__: f for f in (failure_burst, score_sparkline, threshold_calibration, tool_latency, token_attribution, span_rollup, ingest_callback_events, stream_sessionize, stream_first_failure)}

_RUNS = f"""with c as ({CALLBACKS}), r as (
  select run_id, max(case when pos = 0 then event_type end) as t0, max(case when pos = 3 then event_type end) as t3, max(case when pos = 4 then event_type end) as t4, max(case when pos = 5 then event_type end) as t5, count_if(pos = 5) as ended,
    {', '.join(f"max(case when pos = {p} then ms end) as m{p}" for p in range(6))}, max(ms) as last_ms, min(ms) as first_ms, coalesce(max(case when pos = 2 then k end), 0) as k from c group by run_id
), x as (select *, case when ended = 0 then 'timeout' when run_id % 5 = 0 then 'error' else 'end' end as closed from r)
select run_id, concat('agent-', cast(run_id % 20 as string)) as agent_name, closed, case when run_id % 7 = 0 then '[redacted]' else concat(t0, '-0') end as input,
  case when closed = 'error' then concat('ERROR: ', t5, '-5') when run_id % 7 = 0 then '[redacted]' when closed = 'end' then concat(t5, '-5') end as output, case when closed = 'error' then concat(t5, '-5') end as error,
  cast(last_ms - first_ms as double) as latency_ms, case when closed <> 'error' then cast(k as bigint) end as prompt_tokens, case when closed <> 'error' then cast(2 * k as bigint) end as completion_tokens,
  case when closed <> 'error' then floor((k * 0.000015e0 + 2 * k * 0.00006e0) * 10000 + 0.5e0) / 10000 end as cost_usd,
  case when closed <> 'error' then case when m3 is null or m4 is null then '' else concat('tool-', cast(run_id % 3 as string), ':', t3, '-3:', t4, '-4:', cast(m4 - m3 as string), ':success') end end as tool_calls,
  concat_ws(',', case when m1 is not null then concat('llm_call:llm:', cast(coalesce(nullif(m2 - m1, 0), last_ms - m1) as string), ':ok') end, case when m3 is not null then concat('tool-', cast(run_id % 3 as string), ':tool:', cast(last_ms - m3 as string), ':ok') end) as spans from x"""
ORACLES = {
    "ingest_callback_events": oracle(_RUNS), "stream_sessionize": oracle(_RUNS),
    "stream_first_failure": oracle("""select tenant_id, agent_name, rule_name, trace_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts from (
      select *, lag(ts) over (partition by tenant_id, agent_name, rule_name order by ts, trace_id) as was from (select concat('t', cast(e.user_id % 3 as string)) as tenant_id, t.agent_name, concat('rule-', cast(coalesce(t.k, 0) % 5 as string)) as rule_name, t.trace_id, t.ts
        from event_traces t join events e on e.event_id = t.trace_id where t.failed) f) x where was is null or ts - was > interval 2 days"""),
    "span_rollup": oracle("""select s.tenant_id, s.trace_id, count(*) as spans, cast(count_if(status_code = 'ERROR') as bigint) as errors, cast(count_if(kind = 'LLM') as bigint) as llm, cast(count_if(kind = 'TOOL') as bigint) as tool,
      cast(epoch(max(end_time)) - epoch(min(start_time)) as bigint) as duration_s, cast(coalesce(max(t.depth), 0) as integer) as max_depth from spans s left join tree t on t.tenant_id = s.tenant_id and t.trace_id = s.trace_id and t.span_no = s.span_no group by 1, 2""").replace("with ", "with recursive ", 1).replace("\nselect s.tenant_id", """, tree as (
  select tenant_id, trace_id, span_no, 0 as depth from spans where parent_no is null
  union all select s.tenant_id, s.trace_id, s.span_no, t.depth + 1 from spans s join tree t on s.tenant_id = t.tenant_id and s.trace_id = t.trace_id and s.parent_no = t.span_no)
select s.tenant_id""", 1),
}
