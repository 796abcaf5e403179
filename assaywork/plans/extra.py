"""Citations, judge tables, ingestion, exports, span trees and streams over the given tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaywork.operators import citations, judge, spans, timeline
from assaywork.sources import ingest
from assaywork.plans.scoring import scored_oracle
from assaywork.plans.sqlplans import AS_OF
from assaywork.sources.views import oracle, render, view
from assaywork.streaming import jobs



def _string_ts(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def extract_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.extract(view(spark, sf_dir, "cited_outputs"))


def citation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = citations.extract(view(spark, sf_dir, "cited_outputs"))
    return c.groupBy("trace_id").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in citations.PATTERNS])


def citation_host_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select("page_id", citations.host_allowed(F.col("url")).alias("allowed"), citations.host_allowed(F.col("url"), ("example.net", "example.org")).alias("listed"))


def dedupe_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = citations.extract(view(spark, sf_dir, "cited_outputs")).filter(F.col("kind").isin("url", "doi"))
    return c.select("identifier").dropDuplicates(["identifier"])


def citation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = citations.extract(view(spark, sf_dir, "cited_outputs"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("url").alias("identifier")).distinct().withColumn("known", F.lit(True))
    c = c.join(pages, "identifier", "left").withColumn("has_source", F.coalesce("known", F.lit(False)) | (F.col("kind") == "doi"))
    c = c.withColumns({"supported": F.col("trace_id") % 3 != 0, "actual": F.lit(0.25), "pessimistic": F.when(F.col("trace_id") % 5 == 0, 0.9).otherwise(0.5)})
    return citations.verdicts(c)


def citation_source_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return citations.with_sources(citations.extract(view(spark, sf_dir, "cited_outputs")), pages)


def judge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = judge.requests(view(spark, sf_dir, "text_traces"), "correctness")
    return r.select("trace_id", F.length("user").alias("n_user"), "rejected")


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = (F.col("trace_id") % 130) / 100
    body = F.concat(F.lit('{"score": '), score.cast("string"), F.lit(', "rationale": "r", "dimensions": {"a": 0.5, "b": "x"}'), F.when(F.col("trace_id") % 2 == 0, ', "passed": true').otherwise(""), F.lit("}"))
    text = F.when(F.col("trace_id") % 7 == 0, "no object").when(F.col("trace_id") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Here: "), body))
    return view(spark, sf_dir, "text_traces").select("tenant_id", "trace_id", text.alias("response"))


def parse_judge_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = judge.parse(_responses(spark, sf_dir))
    return p.select("trace_id", "malformed", "score", "passed", F.size("dimensions").alias("n_dimensions"))


def judge_to_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = judge.parse(_responses(spark, sf_dir)).filter(~F.col("malformed"))
    return p.select("tenant_id", "trace_id", F.lit("custom").alias("eval_type"), F.lit("llm_judge:accuracy:openai/gpt-4o").alias("rule_name"), "score", "passed")


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, s, c = (view(spark, sf_dir, v) for v in ("agent_traces", "spans", "tool_calls"))
    attributes = F.struct(F.col("duration_s").alias("seconds"), (F.col("span_no") % 2 == 0).alias("even"), F.struct(F.lit("m").alias("model"), F.array(F.lit(1), F.lit(2)).alias("sizes")).alias("call"))
    event = F.struct(F.lit("started").alias("name"), _string_ts("start_time").alias("timestamp"), F.struct(F.col("span_no").alias("at")).alias("attributes"))
    span = F.struct(F.col("span_no").cast("string").alias("span_id"), F.col("parent_no").cast("string").alias("parent_span_id"), F.col("kind").alias("name"), F.when(F.col("kind") != "INTERNAL", F.col("kind")).alias("kind"),
                    F.when(F.col("status_code") != "UNSET", F.col("status_code")).alias("status_code"), F.when(F.col("status_code") == "ERROR", "failed").alias("status_message"), _string_ts("start_time").alias("start_time"), attributes.alias("attributes"), F.array(event).alias("events"))
    call = F.struct("tool_name", "latency_ms", "error", F.struct(F.col("trace_id").alias("of")).alias("input"))
    key = ["tenant_id", "trace_id"]
    own = s.groupBy(*key).agg(F.sort_array(F.collect_list(span)).alias("spans"))
    j = t.join(own, key, "left").join(c.groupBy(*key).agg(F.collect_list(call).alias("tool_calls")), key, "left")
    tokens = F.struct((F.col("trace_id") % 200).alias("prompt_tokens"), (F.col("trace_id") % 300).alias("completion_tokens"), (F.col("trace_id") % 200 + F.col("trace_id") % 300).alias("total_tokens"))
    tags = F.struct(F.concat(F.lit("request-"), F.col("trace_id").cast("string")).alias("requestId"), (F.col("trace_id") % 3).alias("shard"))
    return j.select(F.to_json(F.struct(F.col("trace_id").cast("string").alias("trace_id"), F.when(F.col("tenant_id") != "t0", F.col("tenant_id")).alias("tenant_id"), F.when(F.col("trace_id") % 11 != 0, F.col("agent_name")).alias("agent_name"), "framework", _string_ts("ts").alias("timestamp"), "latency_ms", "cost_usd",
                                       tokens.alias("token_usage"), tags.alias("metadata"), "tool_calls", F.when(F.col("trace_id") % 13 != 0, F.col("spans")).alias("spans"))).alias("value"))


def ingest_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, _ = ingest.ingest(_payloads(spark, sf_dir), F.lit("2000-01-01 00:00:00").cast("timestamp"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return t.select(
        F.col("trace_id").cast("long").alias("trace_id"), "tenant_id", "agent_name", "framework", _string_ts("ts").alias("ts"), size("spans").alias("n_spans"), size("tool_calls").alias("n_tool_calls"),
        F.col("token_usage.total_tokens").cast("long").alias("total_tokens"), F.try_variant_get(F.element_at("metadata", "requestId"), "$", "string").alias("request_id"),
        size(F.filter("spans", lambda s: s["status_message"] == "failed")).alias("n_failed"), size(F.filter("spans", lambda s: F.try_variant_get(F.element_at(s["attributes"], "even"), "$", "boolean"))).alias("n_even"))


def ingested_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls, time and errors of each tool over ingested payloads."""
    t, _ = ingest.ingest(_payloads(spark, sf_dir), F.lit(None).cast("timestamp"))
    c = ingest.explode_tool_calls(t)
    return c.groupBy("tool_name").agg(F.count("*").alias("calls"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.sum(F.round("latency_ms").cast("long")).alias("total_ms"), F.max("latency_ms").alias("slowest_ms"))


def ingest_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest(_payloads(spark, sf_dir), F.lit(None).cast("timestamp"))[1].agg(F.count("*").alias("rejects"))


def explode_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, _ = ingest.ingest(_payloads(spark, sf_dir), F.lit(None).cast("timestamp"))
    return ingest.explode_spans(t).groupBy("tenant_id", "kind", "status_code").agg(F.count("*").alias("spans"))


def parse_json_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


def _audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = view(spark, sf_dir, "audit")
    details = F.create_map(F.lit("by"), F.col("actor"), F.lit("note"), F.lit('a "b"'))
    line = F.to_json(F.struct(_string_ts("ts").alias("ts"), F.when(F.col("tenant_id") != "t0", F.col("tenant_id")).alias("tenantId"), "action", F.col("actor").alias("user"), F.when(F.col("entry_id") % 9 != 0, F.col("rule_id")).alias("ruleId"), F.col("rule_name").alias("ruleName"), details.alias("details")))
    return a.select(F.when(F.col("entry_id") % 13 == 0, F.lit("{broken")).otherwise(line).alias("value"))


def read_audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.read_audit(_audit_lines(spark, sf_dir)).groupBy("tenantId", "action").agg(F.count("*").alias("entries")).withColumnRenamed("tenantId", "tenant_id")


def export_audit_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.audit_csv(ingest.read_audit(_audit_lines(spark, sf_dir)))


def read_rules_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of deployed-rule JSON; text that can't be read has none."""
    a = view(spark, sf_dir, "audit")
    text = F.when(F.col("entry_id") % 10 == 0, "{").otherwise(F.to_json(F.struct(F.lit(1).alias("version"), F.array(F.struct(F.col("rule_id").alias("id"), F.col("event_type").alias("evalType"), F.col("enabled").alias("enabled"))).alias("rules"))))
    read = a.select(F.from_json(text, "version int, rules array<struct<id:string,evalType:string,enabled:boolean>>").alias("f"))
    return read.select(F.inline("f.rules")).groupBy(F.col("evalType").alias("eval_type")).agg(F.count("*").alias("rules"), F.count_if("enabled").alias("enabled"))


def otlp_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.otlp(ingest.ingest(_payloads(spark, sf_dir), F.lit(None).cast("timestamp"))[0])


def write_evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evals written by day and read back."""
    path = jobs.shared_folder(spark, "evals")
    e = view(spark, sf_dir, "evals").withColumn("event_date", F.to_date("created_at"))
    e.repartition("event_date").write.partitionBy("event_date").parquet(path)
    return spark.read.parquet(path).groupBy("event_date").agg(F.count("*").alias("evals")).select(F.col("event_date").cast("string").alias("event_date"), "evals")


def trace_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["tenant_id", "trace_id"]
    s = view(spark, sf_dir, "spans").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start_time", "span_no", "kind"))).alias("spans"))
    e = view(spark, sf_dir, "evals").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("created_at", "eval_type", "score")), asc=False).alias("evals"))
    t = view(spark, sf_dir, "agent_traces").join(s, key, "left").join(e, key, "left")
    return t.select(*key, F.coalesce(F.size("spans"), F.lit(0)).alias("n_spans"), F.coalesce(F.size("evals"), F.lit(0)).alias("n_evals"), F.array_join(F.transform("spans", lambda x: x["span_no"].cast("string")), ",").alias("span_order"), F.array_join(F.transform("evals", lambda x: x["eval_type"]), ",").alias("eval_order"))


def keyword_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from assaywork.functions.text import words

    a, b = F.array_distinct(words(F.col("input"), 2)), F.array_distinct(words(F.col("output"), 2))
    return view(spark, sf_dir, "conv_traces").select("trace_id", F.size(F.array_intersect(a, b)).alias("common"), F.size(F.array_union(a, b)).alias("either"))


def span_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.tree(view(spark, sf_dir, "spans"))


def _page(rows: DataFrame, order: list[Column], columns: list[str], n: int = 50) -> DataFrame:
    """The first rows in order, ranked, with the number of all."""
    top = rows.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("int"))
    return top.crossJoin(rows.agg(F.count("*").alias("total"))).select("rank", *columns, "total")


def _last_days(c: str, days: int) -> str:
    return render(f"{c} >= @[shift:{AS_OF};{days}] and {c} <= {AS_OF}", "spark")


# The SQL of the next three, in ``sqlplans``, is their oracle.
def query_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, "agent_traces").filter("agent_name = 'agent-7' and framework is not null and " + _last_days("ts", 720))
    return _page(t, [F.desc("ts"), F.asc("trace_id")], ["trace_id", "agent_name", "framework", "cost_usd", "latency_ms"])


def query_evals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = view(spark, sf_dir, "evals").filter("eval_type = 'safety' and not passed and " + _last_days("created_at", 365))
    return _page(e, [F.desc("created_at"), F.asc("trace_id"), F.asc("eval_type")], ["trace_id", "eval_type", "score", "passed"])


def annotate_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = view(spark, sf_dir, "event_traces").select(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("bucket")).distinct()
    a = view(spark, sf_dir, "audit").filter("action in ('rule.deploy', 'rule.delete')").select("entry_id", "action", "ts")
    return timeline.at_or_before(a, days).select("entry_id", "action", F.col("bucket").cast("string").alias("bucket"))


def rule_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the day before and the day from each deploy on. Its SQL, in ``sqlplans``, is the oracle."""
    a = view(spark, sf_dir, "audit").filter("action = 'rule.deploy'").select("entry_id", "rule_id", "ts")
    found = a.join(timeline.impact(a, view(spark, sf_dir, "event_traces").select("ts", "failed")), "ts").filter("before_n + after_n > 0")
    return found.groupBy("entry_id", "rule_id").agg(*[F.sum(c).alias(c) for c in ("before_n", "after_n", "before_passed", "after_passed")])


def marker_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of each tenant's deploys: positions in seconds, 5 % of the axis wide."""
    a = view(spark, sf_dir, "audit").filter("action = 'rule.deploy'").select("tenant_id", F.unix_timestamp("ts").alias("x"))
    return timeline.clusters(a).withColumn("n", F.col("n").cast("int"))


def _plain_times(df: DataFrame) -> DataFrame:
    return df.select(*[_string_ts(c).alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


def _stream(spark: SparkSession, sf_dir: str, name: str, mode: str) -> DataFrame:
    source = {"stream_score": jobs.texts, "stream_dedupe": lambda *a: jobs.with_retries(jobs.events(*a))}.get(name, jobs.events)
    return _plain_times(jobs.run_to_end(getattr(jobs, name.removesuffix("_hour").removesuffix("_day"))(source(spark, sf_dir), **WIDTHS.get(name, {})), mode))


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with late rows added up: four arrivals, the stream resumed for each."""
    return _plain_times(jobs.late_arrivals(spark, sf_dir))


WIDTHS = {"stream_trend_hour": {"width": "1 hour"}, "stream_trend_day": {"width": "1 day"}}
STREAMS = {"stream_trend_hour": "complete", "stream_trend_day": "complete", "stream_score": "append", "stream_trend": "complete", "stream_pulse": "complete", "stream_cost_alert": "complete", "stream_dedupe": "append"}
QUERIES = {f.__name__: f for f in (
    extract_citations, citation_counts, citation_host_policy, dedupe_sources, citation_verdicts, citation_source_join, judge_requests, parse_judge_response, judge_to_eval, ingest_traces, ingested_tools, ingest_rejects, explode_spans, parse_json_cols,
    read_audit_log, export_audit_csv, read_rules_file, otlp_export, write_evals, trace_detail, keyword_sets, span_tree, query_traces, query_evals, annotate_trend, rule_impact, marker_clusters, stream_late)}
QUERIES |= {k: partial(_stream, name=k, mode=m) for k, m in STREAMS.items()}

_U = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
_W = "list_distinct(list_filter(string_split_regex(lower({0}), '\\W+'), lambda w: length(w) > 2))"
_SCORE = "(trace_id % 130) / 100e0"
_GOOD = f"trace_id % 7 <> 0 and {_SCORE} <= 1"
ORACLES = {
    "citation_counts": oracle(r"""select * from (select trace_id, cast(len(regexp_extract_all(output, '\[\d{1,3}\]')) as bigint) as numbered, cast(len(regexp_extract_all(output, 'https?://[^\s)\]]+')) as bigint) as url,
      cast(len(regexp_extract_all(output, '\b10\.\d{4,9}/[^\s)\];,"''<>]+')) as bigint) as doi, cast(len(regexp_extract_all(output, '\([^()]{1,50}?,\s*(?:18|19|20)\d{2}\)')) as bigint) as author_year from cited_outputs) x"""),
    "citation_host_policy": r"select page_id, true as allowed, regexp_matches(lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)), '(^|\.)example\.(net|org)$') as listed from pages",
    "judge_requests": oracle("""select trace_id, cast(length(output) + 20 + case when input is null or input = '' then 0 else length(input) + 12 end + case when expected is null or expected = '' then 0 else length(expected) + 20 end as integer) as n_user, expected is null or expected = '' as rejected from text_traces"""),
    "parse_judge_response": oracle(f"""select trace_id, not ({_GOOD}) as malformed, case when {_GOOD} then floor({_SCORE} * 100 + 0.5e0) / 100 end as score, case when {_GOOD} then trace_id % 2 = 0 or {_SCORE} >= 0.7e0 end as passed, cast(case when {_GOOD} then 1 end as integer) as n_dimensions from text_traces"""),
    "judge_to_eval": oracle(f"""select tenant_id, trace_id, 'custom' as eval_type, 'llm_judge:accuracy:openai/gpt-4o' as rule_name, floor({_SCORE} * 100 + 0.5e0) / 100 as score, trace_id % 2 = 0 or {_SCORE} >= 0.7e0 as passed from text_traces where {_GOOD}"""),
    "ingest_traces": oracle(f"""select t.trace_id, case when t.tenant_id = 't0' then 'local' else t.tenant_id end as tenant_id, t.agent_name, t.framework, {_U.format('t.ts')} as ts, {', '.join(f"cast(case when t.trace_id % 13 = 0 then 0 else coalesce(s.{k}, 0) end as integer) as {v}" for k, v in (("n", "n_spans"), ("f", "n_failed"), ("e", "n_even")))},
      cast(coalesce(c.n, 0) as integer) as n_tool_calls, cast(t.trace_id % 200 + t.trace_id % 300 as bigint) as total_tokens, concat('request-', cast(t.trace_id as string)) as request_id
      from agent_traces t left join (select tenant_id, trace_id, count(*) as n, count_if(status_code = 'ERROR') as f, count_if(span_no % 2 = 0) as e from spans group by 1, 2) s on s.tenant_id = t.tenant_id and s.trace_id = t.trace_id
      left join (select tenant_id, trace_id, count(*) as n from tool_calls group by 1, 2) c on c.tenant_id = t.tenant_id and c.trace_id = t.trace_id where t.trace_id % 11 <> 0"""),
    "ingested_tools": oracle("select tool_name, count(*) as calls, cast(count_if(error is not null) as bigint) as errors, cast(sum(cast(round(latency_ms) as bigint)) as bigint) as total_ms, max(latency_ms) as slowest_ms from tool_calls where trace_id % 11 <> 0 group by 1"),
    "ingest_rejects": oracle("select count(*) as rejects from agent_traces where trace_id % 11 = 0"),
    "explode_spans": oracle("select case when tenant_id = 't0' then 'local' else tenant_id end as tenant_id, kind, status_code, count(*) as spans from spans where trace_id % 11 <> 0 and trace_id % 13 <> 0 group by 1, 2, 3"),
    "parse_json_cols": "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events",
    "read_audit_log": oracle("select case when tenant_id = 't0' then 'local' else tenant_id end as tenant_id, action, count(*) as entries from audit where entry_id % 13 <> 0 and entry_id % 9 <> 0 group by 1, 2"),
    "export_audit_csv": oracle(f"""select concat('"', {_U.format('ts')}, '","', case when tenant_id = 't0' then 'local' else tenant_id end, '","', action, '","', actor, '","', rule_id, '","', coalesce(rule_name, ''), '","by=', actor, ' · note=a ', repeat('"', 2), 'b', repeat('"', 3)) as line
      from audit where entry_id % 13 <> 0 and entry_id % 9 <> 0"""),
    "read_rules_file": oracle("select event_type as eval_type, count(*) as rules, cast(count_if(enabled) as bigint) as enabled from audit where entry_id % 10 <> 0 group by 1"),
    "write_evals": oracle("select cast(cast(created_at as date) as string) as event_date, count(*) as evals from evals group by 1"),
    "trace_detail": oracle("""select t.tenant_id, t.trace_id, cast(coalesce(s.n, 0) as integer) as n_spans, cast(coalesce(e.n, 0) as integer) as n_evals, s.o as span_order, e.o as eval_order from agent_traces t
      left join (select tenant_id, trace_id, count(*) as n, string_agg(cast(span_no as string), ',' order by start_time, span_no) as o from spans group by 1, 2) s on s.tenant_id = t.tenant_id and s.trace_id = t.trace_id
      left join (select tenant_id, trace_id, count(*) as n, string_agg(eval_type, ',' order by created_at desc, eval_type desc) as o from evals group by 1, 2) e on e.tenant_id = t.tenant_id and e.trace_id = t.trace_id"""),
    "keyword_sets": oracle(f"select trace_id, cast(len(list_intersect({_W.format('input')}, {_W.format('output')})) as integer) as common, cast(len(list_distinct(list_concat({_W.format('input')}, {_W.format('output')}))) as integer) as either from conv_traces"),
    "span_tree": oracle("""select tenant_id, trace_id, span_no, cast(depth as integer) as depth, cast(row_number() over (partition by tenant_id, trace_id order by path) - 1 as integer) as place from tree
      union all select s.tenant_id, s.trace_id, s.span_no, 0, cast(row_number() over (partition by s.tenant_id, s.trace_id order by s.start_time, s.span_no) - 1 as integer) from spans s where not exists (select 1 from tree t where t.tenant_id = s.tenant_id and t.trace_id = s.trace_id)""").replace("with ", "with recursive ", 1),
    "stream_score": scored_oracle("select tenant_id, trace_id, eval_type, score, passed from scored"),
    "stream_late": oracle(f"""select {_U.format('start')} as start, count(*) as traces, cast(count_if(not failed) as bigint) as passed, cast(count_if(coalesce(ts < newest - interval 2 hours, false)) as bigint) as late from (
      select e.*, time_bucket(interval 6 hours, e.ts, timestamp '1970-01-01') as start, m.newest from event_traces e left join (select k.k, max(o.ts) as newest from (select * from (values (1), (2), (3)) v(k)) k join event_traces o on o.trace_id % 4 < k.k group by k.k) m on m.k = e.trace_id % 4) x group by 1"""),
    **{f"stream_trend{name}": oracle(f"""select {_U.format(f"time_bucket(interval '{width}', ts, timestamp '1970-01-01')")} as start, count(*) as traces, cast(count_if(not failed) as bigint) as passed,
      floor(cast(sum(case when failed then 250 else trace_id % 100 * 10 end) as double) / count(*) / 1000 * 1000 + 0.5e0) / 1000 as avg_score from event_traces group by 1""") for name, width in (("", "6 hours"), ("_hour", "1 hour"), ("_day", "1 day"))},
    "stream_pulse": oracle(f"select {_U.format('date_trunc(' + chr(39) + 'hour' + chr(39) + ', ts) + to_hours(cast(h as integer))')} as \"end\", count(*) as traces, cast(count_if(not failed) as bigint) as passed from event_traces, range(1, 25) r(h) group by 1"),
    "stream_cost_alert": oracle(f"select agent_name, {_U.format('cast(cast(ts as date) as timestamp)')} as start, cast(sum(cast(round(cost_usd * 1000000) as bigint)) as bigint) as micro_usd from event_traces group by 1, 2 having sum(cast(round(cost_usd * 1000000) as bigint)) > 500000"),
    "stream_dedupe": oracle("select agent_name, event_type, cost_usd from event_traces group by agent_name, event_type, ts, cost_usd, failed, k"),
}
# The tree is a recursive relation beside the views.
ORACLES["span_tree"] = ORACLES["span_tree"].replace("\nselect tenant_id, trace_id, span_no, cast(depth", """, tree as (
  select tenant_id, trace_id, span_no, 0 as depth, [strftime(start_time, '%Y%m%d%H%M%S') || lpad(cast(span_no as string), 6, '0')] as path from spans where parent_no is null
  union all select s.tenant_id, s.trace_id, s.span_no, t.depth + 1, list_append(t.path, strftime(s.start_time, '%Y%m%d%H%M%S') || lpad(cast(s.span_no as string), 6, '0')) from spans s join tree t on s.tenant_id = t.tenant_id and s.trace_id = t.trace_id and s.parent_no = t.span_no)
select tenant_id, trace_id, span_no, cast(depth""", 1)
