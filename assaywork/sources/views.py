"""Traces, spans, rule results and events as views over the given tables.

Each view is one SELECT in the SQL that Spark and the oracle share; ``DIALECT`` has the few fragments in
which they differ. ``view`` runs it on Spark; ``with_views`` makes it the oracle's WITH clause."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DIALECT = {
    "spark": {
        "minutes40": "timestampadd(MINUTE, d.doc_id * 40, timestamp_ntz'2024-01-01 00:00:00')",
        "prop_k": "cast(get_json_object(props, '$.k') as bigint)",
        "seconds": "cast(unix_timestamp({0}) as bigint)",
        "median": "percentile({0}, 0.5)", "p95": "percentile({0}, 0.95)",
        "shift": "{0} - make_dt_interval({1})",
        "back_hours": "{0} - make_dt_interval(0, {1})",
        "join_sorted": "array_join(array_sort(collect_list({0})), ',')",
        "join_distinct": "array_join(array_sort(collect_set({0})), ',')",
        "ntz": "timestamp_ntz", "later": "{0} + make_dt_interval(0, 0, 0, {1})",
    },
    "oracle": {
        "minutes40": "timestamp '2024-01-01 00:00:00' + to_minutes(d.doc_id * 40)",
        "prop_k": "cast(json_extract_string(props, '$.k') as bigint)",
        "seconds": "cast(floor(epoch({0})) as bigint)",
        "median": "quantile_cont({0}, 0.5)", "p95": "quantile_cont({0}, 0.95)",
        "shift": "{0} - to_days(cast({1} as integer))",
        "back_hours": "{0} - to_hours(cast({1} as integer))",
        "join_sorted": "coalesce(array_to_string(list_sort(list({0}) filter (where {0} is not null)), ','), '')",
        "join_distinct": "coalesce(array_to_string(list_sort(list(distinct {0}) filter (where {0} is not null)), ','), '')",
        "ntz": "timestamp", "later": "{0} + to_seconds({1})",
    },
}
#: Lines of an order, numbered: (l_orderkey, l_linenumber) isn't unique.
_LINES = "(select l.*, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) n from lineitem l) x join orders on l_orderkey = o_orderkey"
_TENANT = "concat('t', cast(o_custkey % 3 as string))"

VIEWS = {
    "text_traces": """select concat('t', cast(d.doc_id % 3 as string)) tenant_id, d.doc_id trace_id, d.source agent_name, d.lang framework,
  case when d.doc_id % 7 = 0 then null else b.text end as input, d.text as output,
  case when d.doc_id % 5 = 0 then null else b.text end as expected,
  case when d.doc_id % 11 = 0 then null else cast(d.n_chars as double) / 20000 end as cost_usd,
  d.doc_id % 200 as prompt_tokens, cast(floor(d.n_chars / 4) as bigint) as completion_tokens,
  cast(500 + (d.doc_id * 37) % 2000 as double) as latency_ms, @[minutes40] as ts
from documents d join benchmark b on b.item_id = d.doc_id % (select count(*) from benchmark)""",
    "agent_traces": f"""select {_TENANT} tenant_id, o_orderkey trace_id, concat('agent-', cast(o_custkey % 50 as string)) agent_name,
  o_orderpriority framework, o_orderdate ts, o_totalprice / 2000000 as cost_usd, cast(o_orderkey * 37 % 5000 as double) latency_ms
from orders""",
    "spans": f"""select {_TENANT} tenant_id, l_orderkey trace_id, cast(n as int) span_no,
  case when n = 1 then (case when l_orderkey % 17 = 0 then 99 end) when n = 3 and l_orderkey % 10 = 0 then 99 else cast(floor(n / 2) as int) end parent_no,
  case n % 3 when 0 then 'LLM' when 1 then 'INTERNAL' else 'TOOL' end kind,
  case l_returnflag when 'R' then 'ERROR' when 'A' then 'OK' else 'UNSET' end status_code, l_shipdate start_time, l_quantity duration_s, @[later:cast(l_shipdate as @[ntz]);l_quantity] end_time
from {_LINES}""",
    # Calls of tools, with an error text where one failed.
    "tool_calls": f"""select {_TENANT} tenant_id, l_orderkey trace_id, concat('tool-', cast(l_suppkey % 8 as string)) tool_name, l_quantity * 20.0e0 latency_ms,
  case when l_returnflag = 'R' then 'timeout' end error
from {_LINES}""",
    "rule_results": f"""select {_TENANT} tenant_id, l_orderkey trace_id, cast(n as int) rule_no,
  case n % 4 when 0 then 'safety' when 1 then 'completeness' when 2 then 'relevance' else 'cost' end eval_type,
  case n % 4
    when 0 then (case when l_partkey % 2 = 0 then 'no_pii' else 'no_injection_patterns' end)
    when 1 then (case when l_partkey % 2 = 0 then 'min_output_length' else 'sentence_count' end)
    when 2 then (case when l_partkey % 2 = 0 then 'keyword_overlap' else 'no_hallucination_markers' end)
    else (case when l_partkey % 2 = 0 then 'cost_under_threshold' else 'token_efficiency' end) end rule_name,
  l_returnflag <> 'R' and l_suppkey % 10 <> 0 passed, l_suppkey % 10 = 0 skipped, 1 - l_discount * 10 score, o_orderdate created_at
from {_LINES}""",
    "event_traces": """select event_id trace_id, concat('agent-', cast(user_id % 20 as string)) agent_name, event_type, ts,
  value / 1000 as cost_usd, event_type = 'error' failed, @[prop_k] k from events""",
    "conv_traces": """select u.conv_id * 100 + u.turn trace_id, u.conv_id, u.text as input, a.text as output
from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1 where u.role = 'user' and a.role = 'assistant'""",
    "cited_outputs": """select d.doc_id trace_id, concat(coalesce(d.text, ''), ' [1] see ', p.url, ', also [2] 10.1234/ab.', cast(d.doc_id as string), ' (Smith et al., 2019).') as output
from documents d join pages p on p.page_id = d.doc_id % (select count(*) from pages)""",
    # Rule lifecycle entries.
    "audit": """select event_id entry_id, concat('t', cast(user_id % 3 as string)) tenant_id, ts,
  case (event_id + cast(floor(event_id / 40) as bigint)) % 4 when 0 then 'rule.deploy' when 1 then 'rule.toggle' when 2 then 'rule.update' else 'rule.delete' end action,
  concat('user-', cast(user_id % 7 as string)) actor, concat('rule-', cast((event_id * 7) % 40 as string)) rule_id,
  case when event_id % 5 = 0 then null else concat('Rule ', event_type) end rule_name, event_id % 3 <> 0 enabled, event_type from events""",
    # Rules as they stand: the latest entry of each says whether it is enabled or deleted.
    "deployed_rules": """select tenant_id, rule_id, case when k % 2 = 0 then 'safety' else 'cost' end eval_type, enabled, k,
  case k % 3 when 0 then 'min_length' when 1 then 'excludes_keywords' else 'cost_threshold' end type
from (select *, cast(substring(rule_id, 6) as int) k, row_number() over (partition by tenant_id, rule_id order by ts desc, entry_id desc) n from audit where action <> 'rule.update') x
where n = 1 and action <> 'rule.delete'""",
    # Evals of texts as an earlier set of rules left them.
    "stored_evals": """select t.tenant_id, t.trace_id, e.eval_type, cast(t.trace_id * e.f % 101 as double) / 100 score, t.trace_id * e.f % 101 >= 70 passed
from text_traces t join (select 'completeness' eval_type, 7 f union all select 'relevance', 11 union all select 'safety', 13 union all select 'cost', 17) e on t.trace_id % 19 <> e.f""",
    # One row per trace and eval type: weighted mean in millionths, so that sums are exact.
    "evals": """select tenant_id, trace_id, eval_type, created_at, n_used as rules_evaluated, n_skipped as rules_skipped, n_used = 0 as insufficient_data,
  case when n_used = 0 then 0.0e0 else floor(points / weight / 1000 + 0.5e0) / 1000 end as score,
  n_used > 0 and points / weight >= 700000 as passed, n_failed, first_failed
from (
  select tenant_id, trace_id, eval_type, min(created_at) created_at,
    cast(count_if(not skipped) as bigint) n_used, cast(count_if(skipped) as bigint) n_skipped, cast(count_if(not skipped and not passed) as bigint) n_failed,
    cast(sum(case when skipped then 0 else cast(round(score * 1000000) as bigint) * w end) as double) points,
    cast(sum(case when skipped then 0 else w end) as double) weight,
    min_by(rule_name, case when not skipped and not passed then rule_no else 1000 + rule_no end) first_failed
  from (select *, case rule_name when 'no_pii' then 4 when 'no_injection_patterns' then 4 when 'sentence_count' then 1 when 'token_efficiency' then 1 else 2 end w from rule_results) r
  group by tenant_id, trace_id, eval_type) g""",
    # One row per trace: snapshot, verdict and significance.
    "moments": """select *,
  case when verdict in ('unevaluated', 'pass') and kind = 'normal-pass' then (case when verdict = 'pass' then 0.05e0 else 0.1e0 end)
    when kind = 'safety-violation' then 1.0e0 when kind = 'cost-spike' then 0.9e0 when kind = 'rule-collision' then 0.7e0 when verdict = 'fail' then 0.5e0 else 0.4e0 end as significance
from (
  select *, case when n_safety_failed > 0 then 'safety-violation' when cost_usd >= 0.10e0 then 'cost-spike'
      when n_failed > 0 and n_failed_types >= 2 then 'rule-collision' when verdict in ('fail', 'partial') then 'normal-fail' else 'normal-pass' end as kind
  from (
    select t.tenant_id, t.trace_id, t.agent_name, t.ts, t.cost_usd, t.latency_ms, coalesce(e.n_evals, 0) eval_count, coalesce(e.mean_score, 0.0e0) overall_score,
      coalesce(e.n_failed_types, 0) n_failed_types, coalesce(r.n_failed, 0) n_failed, coalesce(r.n_skipped, 0) n_skipped, coalesce(r.n_passed, 0) n_passed, coalesce(r.n_total, 0) n_total,
      coalesce(r.n_safety_failed, 0) n_safety_failed, coalesce(r.failed, '') failed,
      case when coalesce(r.n_total, 0) - coalesce(r.n_skipped, 0) = 0 then 'unevaluated' when r.n_failed = 0 then 'pass' when r.n_passed = 0 then 'fail' else 'partial' end verdict
    from agent_traces t
    left join (select tenant_id, trace_id, count(*) n_evals, cast(count_if(not passed) as bigint) n_failed_types, cast(sum(cast(round(score * 1000) as bigint)) as double) / count(*) / 1000 mean_score from evals group by tenant_id, trace_id) e
      on e.tenant_id = t.tenant_id and e.trace_id = t.trace_id
    left join (select tenant_id, trace_id, cast(count_if(not skipped and not passed) as bigint) n_failed, cast(count_if(skipped) as bigint) n_skipped, cast(count_if(passed and not skipped) as bigint) n_passed, count(*) n_total,
        cast(count_if(not skipped and not passed and rule_name in ('no_pii', 'no_blocklist_words', 'no_injection_patterns', 'no_stub_output')) as bigint) n_safety_failed,
        @[join_distinct:case when not skipped and not passed then rule_name end] failed
      from rule_results group by tenant_id, trace_id) r
      on r.tenant_id = t.tenant_id and r.trace_id = t.trace_id) a) b""",
}
#: Views that a view reads.
NEEDS = {"deployed_rules": ["audit"], "stored_evals": ["text_traces"], "evals": ["rule_results"], "moments": ["agent_traces", "evals", "rule_results"]}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def render(sql: str, dialect: str) -> str:
    """Replaces @[name] and @[name:argument;argument], innermost first, by the dialect's fragment."""
    names = "|".join(DIALECT["spark"])
    done = ""
    while sql != done:
        done, sql = sql, re.sub(rf"@\[({names})(?::([^\[\]]*))?\]", lambda m: DIALECT[dialect][m[1]].format(*(m[2] or "").split(";")), sql)
    return sql


def _order(names: list[str]) -> list[str]:
    out: list[str] = []
    for n in names:
        for x in [*_order(NEEDS.get(n, [])), n]:
            if x not in out:
                out.append(x)
    return out


def used_views(sql: str) -> list[str]:
    return _order([v for v in VIEWS if re.search(rf"\b{v}\b", sql)])


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Runs shared SQL on Spark: views become a WITH clause over the given tables."""
    text = _with(sql, "spark")
    for t in TABLES:
        if re.search(rf"\b{t}\b", text):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(text)


def _with(sql: str, dialect: str) -> str:
    views = used_views(sql)
    own = "\n".join(f"{v} as ({VIEWS[v]})," for v in views).rstrip(",")
    sql = sql.strip()
    if views and sql.lower().startswith("with "):
        return render(f"with {own},\n{sql[5:]}", dialect)
    return render(f"with {own}\n{sql}" if views else sql, dialect)


def oracle(sql: str) -> str:
    return _with(sql, "oracle")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table that is too small to fill the cores with splits of the session's size, dealt to all of them
    by ``key``; a larger one as it is, unshuffled."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    small = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < cores * split
    return df.repartition(cores, key) if small else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"select * from {name}")
