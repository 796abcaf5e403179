"""Queries over traces, spans, evals, moments and audit entries, in the SQL that Spark and the oracle
share. "Now" is AS_OF; windows are half-open. Ordered results carry a rank."""

from __future__ import annotations

import re
from functools import partial

from assaywork.sources.views import oracle, run_sql

AS_OF = "@[ntz] '1998-06-01 00:00:00'"
EVENTS_AS_OF = "@[ntz] '2024-01-25 00:00:00'"
SAFETY = "('no_pii', 'no_blocklist_words', 'no_injection_patterns', 'no_stub_output')"
_PASS = "cast(count_if(verdict = 'pass') as double) / nullif(count_if(verdict <> 'unevaluated'), 0)"


def r(x: str, digits: int) -> str:
    """Rounded half up."""
    k = 10**digits
    return f"floor(({x}) * {k}e0 + 0.5e0) / {k}e0"


def cents(x: str) -> str:
    """An exact sum of money: in hundred-millionths, as whole numbers."""
    return f"cast(sum(cast(round(coalesce({x}, 0) * 100000000) as bigint)) as double) / 100000000"


def last(c: str, days: int) -> str:
    """The last so many days before AS_OF."""
    return f"{c} >= @[shift:AS_OF;{days}] and {c} < AS_OF"


def numbers(*values: object) -> str:
    """A table n of one column, i."""
    return f"(select * from (values {', '.join(f'({v!r})' for v in values)}) as v(i)) n"


def money(x: str, digits: int = 4) -> str:
    """Text with so many decimal digits."""
    k = 10**digits
    whole = f"cast(floor({x} * {k}.0 + 0.5) as bigint)"
    return f"concat(cast(cast(floor({whole} / {k}.0) as bigint) as string), '.', lpad(cast({whole} % {k} as string), {digits}, '0'))"


def share(n: str, total: str) -> str:
    """0 where there is nothing."""
    return f"coalesce(cast({n} as double) / nullif({total}, 0), 0.0)"


#: The rules that are built in.
BUILT_IN = ("min_output_length", "non_empty_output", "sentence_count", "expected_coverage", "keyword_overlap", "no_hallucination_markers", "topic_consistency",
            "no_pii", "no_blocklist_words", "no_injection_patterns", "no_stub_output", "cost_under_threshold", "token_efficiency")
PERIODS = """select *, case when ts >= @[shift:AS_OF;90] then 'current' else 'prior' end as win from moments where ts >= @[shift:AS_OF;180] and ts < AS_OF"""

#: Failures with the rule that failed.
FAILED = """select trace_id, agent_name, concat('rule-', cast(coalesce(k, 0) % 5 as string)) as rule_name, @[seconds:ts] as sec from event_traces where failed"""
#: Sums of scores, in thousandths, and their number, per agent and day. An agent's first thirty days are its baseline.
DAILY = """select t.agent_name, cast(e.created_at as date) as day, cast(floor(@[seconds:cast(cast(e.created_at as date) as @[ntz])] / 86400) as int) as day_no, cast(sum(cast(round(e.score * 1000) as bigint)) as bigint) as points, count(*) as n
  from evals e join agent_traces t on t.tenant_id = e.tenant_id and t.trace_id = e.trace_id group by 1, 2, 3"""
#: The moments of both periods, those of the current one in six buckets from its first to its last.
BUCKETED = f"""select p.*, case when p.win = 'current' then cast(least(5, floor((@[seconds:p.ts] - b.lo) * 6.0 / greatest(b.hi - b.lo, 1))) as int) end as bucket from ({PERIODS}) p
  join (select min(@[seconds:ts]) as lo, max(@[seconds:ts]) as hi from ({PERIODS}) q where win = 'current') b on true"""


def _meter(one: str) -> str:
    counts = [("cur", "win = 'current'"), ("pri", "win = 'prior'"), *[(f"b{k}", f"bucket = {k}") for k in range(6)]]
    return ", ".join(f"cast(sum(case when {c} then {one} else 0 end) as bigint) as {k}" for k, c in counts)


#: Periods by name, and the days that they reach back.
PERIODS_OF_STATS = (("24h", 1), ("7d", 7), ("30d", 30), ("all", 40000))


def _since(c: str) -> list[tuple[str, str]]:
    return [(name, f"{c} >= @[shift:AS_OF;{days}]") for name, days in PERIODS_OF_STATS]


def _of_period(c: str) -> str:
    """The period's column of one row that has them all."""
    return f"case p.period {' '.join(f"when '{name}' then {c}_{name}" for name, _ in PERIODS_OF_STATS)} end"


#: US dollars a million tokens, by provider and model.
PRICES = """(select * from (values ('anthropic', 'claude-opus-4', 15.0, 75.0), ('anthropic', 'claude-sonnet-4', 3.0, 15.0), ('anthropic', 'claude-haiku-4-5', 1.0, 5.0), ('anthropic', 'claude-3-5-sonnet', 3.0, 15.0), ('anthropic', 'claude-3-5-haiku', 0.8, 4.0),
  ('openai', 'gpt-4o', 2.5, 10.0), ('openai', 'gpt-4o-mini', 0.15, 0.6), ('openai', 'o1', 15.0, 60.0), ('openai', 'o1-mini', 3.0, 12.0)) as v(provider, model, input_usd, output_usd)) p"""
#: The same for judges, who are found by model alone.
JUDGE_PRICES = """(select * from (values ('anthropic', 'claude-opus-4-7', 15.0, 75.0), ('anthropic', 'claude-sonnet-4-6', 3.0, 15.0), ('anthropic', 'claude-haiku-4-5', 1.0, 5.0), ('anthropic', 'claude-haiku-4-5-20251001', 1.0, 5.0),
  ('openai', 'gpt-4o', 2.5, 10.0), ('openai', 'gpt-4o-mini', 0.15, 0.6), ('openai', 'o1-mini', 3.0, 12.0)) as v(provider, model, input_usd, output_usd)) p"""
#: Calls with the provider and model that a trace is dealt, one of them unknown.
CALLS = """(select t.*, m.provider, m.model from text_traces t join (select * from (values (0, 'openai', 'gpt-4o'), (1, 'anthropic', 'claude-haiku-4-5'), (2, 'openai', 'o1-mini'), (3, 'openai', 'unknown-model'), (4, 'anthropic', 'gpt-4o'), (5, 'anthropic', 'claude-opus-4'), (6, 'anthropic', 'claude-3-5-haiku'),
  (7, 'openai', 'o1'), (8, 'openai', 'gpt-4o-mini'), (9, 'anthropic', 'claude-sonnet-4'), (10, 'anthropic', 'claude-3-5-sonnet')) as v(k, provider, model)) m on m.k = t.trace_id % 11) c"""
#: Calls of judges.
JUDGED = """(select t.*, m.provider, m.model from text_traces t join (select * from (values (0, 'openai', 'gpt-4o'), (1, 'anthropic', 'claude-haiku-4-5'), (2, 'openai', 'o1-mini'), (3, 'openai', 'unknown-model'), (4, 'anthropic', 'claude-opus-4-7'), (5, 'anthropic', 'claude-sonnet-4-6'), (6, 'openai', 'gpt-4o-mini'),
  (7, 'anthropic', 'claude-haiku-4-5-20251001')) as v(k, provider, model)) m on m.k = t.trace_id % 8) c"""


SQL: dict[str, str] = {
    # Filters, sorts, limits
    "query_traces": """select cast(row_number() over (order by ts desc, trace_id) as int) as rank, trace_id, agent_name, framework, cost_usd, latency_ms, total from (
      select *, count(*) over () as total from agent_traces where agent_name = 'agent-7' and framework is not null and ts >= @[shift:AS_OF;720] and ts <= AS_OF order by ts desc, trace_id limit 50) x""",
    "query_traces_by_cost": """select cast(row_number() over (order by cost_usd desc, trace_id) as int) as rank, trace_id, agent_name, cost_usd from (
      select * from agent_traces order by cost_usd desc, trace_id limit 50 offset 100) x""",
    "traces_by_score": """select t.tenant_id, t.trace_id, t.agent_name from agent_traces t
      where exists (select 1 from evals e where e.tenant_id = t.tenant_id and e.trace_id = t.trace_id and e.score >= 0.9)
        and exists (select 1 from evals e where e.tenant_id = t.tenant_id and e.trace_id = t.trace_id and e.score <= 0.5)""",
    "traces_by_latest_score": """select t.tenant_id, t.trace_id, t.agent_name, l.score from agent_traces t join (
      select * from (select *, row_number() over (partition by tenant_id, trace_id order by created_at desc, eval_type) as n from evals) x where n = 1) l
      on l.tenant_id = t.tenant_id and l.trace_id = t.trace_id where l.score >= 0.8""",
    "traces_with_errors": """select tenant_id, trace_id, agent_name from agent_traces t
      where exists (select 1 from spans s where s.tenant_id = t.tenant_id and s.trace_id = t.trace_id and s.status_code = 'ERROR')""",
    "query_evals": """select cast(row_number() over (order by created_at desc, trace_id, eval_type) as int) as rank, trace_id, eval_type, score, passed, total from (
      select *, count(*) over () as total from evals where eval_type = 'safety' and not passed and created_at >= @[shift:AS_OF;365] and created_at <= AS_OF order by created_at desc, trace_id, eval_type limit 50) x""",
    "query_moments": """select cast(row_number() over (order by ts desc, trace_id) as int) as rank, trace_id, agent_name, verdict, kind, significance from (
      select * from moments where verdict = 'partial' and significance >= 0.4 and ts < AS_OF order by ts desc, trace_id limit 200) x""",
    "query_audit": """select cast(row_number() over (order by ts desc, entry_id) as int) as rank, entry_id, action, rule_id, rule_name from (
      select * from audit where action = 'rule.toggle' and ts >= @[shift:EVENTS_AS_OF;20] and (contains(lower(rule_id), 'rule-1') or contains(lower(coalesce(rule_name, '')), 'click')) order by ts desc, entry_id limit 100) x""",
    "distinct_values": """select 'agent_name' as field, agent_name as value from agent_traces where agent_name is not null group by agent_name
      union all select 'framework', framework from agent_traces where framework is not null group by framework""",
    "live_tail": """select cast(row_number() over (order by ts desc, trace_id) as int) as rank, trace_id, agent_name, latency_ms from (select * from agent_traces order by ts desc, trace_id limit 12) x""",
    "needs_attention": """select cast(row_number() over (order by ts desc, trace_id) as int) as rank, trace_id, kind, significance from (
      select * from moments where significance >= 0.4 and kind <> 'normal-pass' order by ts desc, trace_id limit 4) x""",
    "tenant_scope": """select tenant_id, count(*) as traces, """ + cents("cost_usd") + """ as cost from agent_traces where tenant_id <> '' group by tenant_id""",
    # Joins
    "error_rate_join": """select t.tenant_id, count(*) as traces, cast(count_if(e.trace_id is not null) as bigint) as with_error, """ + r("cast(count_if(e.trace_id is not null) as double) / count(*)", 4) + """ as error_rate
      from agent_traces t left join (select distinct tenant_id, trace_id from spans where status_code = 'ERROR') e on e.tenant_id = t.tenant_id and e.trace_id = t.trace_id group by t.tenant_id""",
    "recent_failures": """select cast(row_number() over (order by created_at desc, trace_id, eval_type) as int) as rank, trace_id, agent, eval_type, score, first_failed, case when length(output) > 200 then concat(substring(output, 1, 200), '...') else output end as preview from (
      select e.created_at, e.trace_id, coalesce(t.agent_name, 'unknown') as agent, e.eval_type, e.score, e.first_failed, repeat(concat('Order ', cast(e.trace_id as string), '. '), cast(e.trace_id % 40 as int)) as output
      from evals e left join agent_traces t on t.tenant_id = e.tenant_id and t.trace_id = e.trace_id where not e.passed and e.n_failed > 0 order by e.created_at desc, e.trace_id, e.eval_type limit 20) x""",
    "moments_join": """select tenant_id, trace_id, eval_count, overall_score, verdict from moments""",
    "period_compare": f"""select agent_name, cast(count_if(win = 'current') as bigint) as current_n, cast(count_if(win = 'prior') as bigint) as prior_n,
      cast(count_if(win = 'current' and verdict = 'pass') as bigint) as current_pass, cast(count_if(win = 'prior' and verdict = 'pass') as bigint) as prior_pass from ({PERIODS}) p group by agent_name""",
    "archived_anti": """select m.tenant_id, m.trace_id, m.verdict from moments m where not exists (select 1 from spans s where s.tenant_id = m.tenant_id and s.trace_id = m.trace_id and s.kind = 'LLM' and s.duration_s > 45)""",
    "archived_only": """select m.tenant_id, m.trace_id, m.verdict from moments m where exists (select 1 from spans s where s.tenant_id = m.tenant_id and s.trace_id = m.trace_id and s.kind = 'LLM' and s.duration_s > 45)""",
    "annotate_trend": """select entry_id, action, cast(bucket as string) as bucket from (
      select entry_id, action, max(bucket) over (order by at_ts, is_entry, entry_id rows between unbounded preceding and current row) as bucket, is_entry from (
        select ts as at_ts, cast(null as bigint) as entry_id, cast(null as string) as action, ts as bucket, 0 as is_entry from (select distinct cast(date_trunc('day', ts) as @[ntz]) as ts from event_traces) b
        union all select ts, entry_id, action, cast(null as @[ntz]), 1 from audit where action in ('rule.deploy', 'rule.delete')) u) w where is_entry = 1 and bucket is not null""",
    "rule_impact": """select a.entry_id, a.rule_id, cast(count_if(e.ts < a.ts) as bigint) as before_n, cast(count_if(e.ts >= a.ts) as bigint) as after_n,
      cast(count_if(e.ts < a.ts and not e.failed) as bigint) as before_passed, cast(count_if(e.ts >= a.ts and not e.failed) as bigint) as after_passed
      from (select * from audit where action = 'rule.deploy') a join event_traces e on cast(e.ts as date) >= cast(@[shift:a.ts;1] as date) and cast(e.ts as date) <= cast(@[shift:a.ts;-1] as date) and e.ts >= @[shift:a.ts;1] and e.ts < @[shift:a.ts;-1]
      group by a.entry_id, a.rule_id""",
    # Moments
    "rule_snapshot": """select tenant_id, trace_id, @[join_sorted:case when not skipped and not passed then rule_name end] as failed, @[join_sorted:case when skipped then rule_name end] as skipped,
      cast(count_if(passed and not skipped) as bigint) as n_passed, count(*) as n_total from rule_results group by tenant_id, trace_id""",
    "verdict": """select tenant_id, trace_id, verdict from moments""",
    "overall_score": """select tenant_id, trace_id, """ + r("overall_score", 6) + """ as overall_score from moments""",
    "significance": f"""select tenant_id, trace_id, kind, significance,
      case kind when 'safety-violation' then concat('Safety: ', failed_safety) when 'cost-spike' then concat('Cost: $', {money('cost_usd')}) when 'rule-collision' then concat('Multi-category fail (', cast(n_failed_types as string), ')')
        when 'normal-fail' then (case when verdict = 'fail' then concat('Fail: ', failed) else concat('Partial: ', cast(n_failed as string), ' failed') end) else (case when verdict = 'pass' then 'Pass' else 'No eval recorded' end) end as label,
      case kind when 'safety-violation' then concat(cast(n_safety_failed as string), ' safety rule(s) failed: ', failed_safety) when 'cost-spike' then concat('Cost of $', {money('cost_usd')}, ' reaches the bar of $0.1')
        when 'rule-collision' then concat('Failures in ', cast(n_failed_types as string), ' categories: ', failed_types, '; rules: ', failed)
        when 'normal-fail' then (case when verdict = 'fail' then concat('All that ran failed: ', failed) else concat(cast(n_failed as string), ' of ', cast(n_total - n_skipped as string), ' that ran failed: ', failed) end)
        else (case when verdict = 'pass' then concat('All ', cast(n_passed as string), ' that ran passed') else 'Nothing was evaluated' end) end as reason
      from (select m.*, coalesce(s.failed_safety, '') as failed_safety, coalesce(e.failed_types, '') as failed_types from moments m
        left join (select tenant_id, trace_id, @[join_distinct:case when not skipped and not passed and rule_name in {SAFETY} then rule_name end] as failed_safety from rule_results group by tenant_id, trace_id) s on s.tenant_id = m.tenant_id and s.trace_id = m.trace_id
        left join (select tenant_id, trace_id, @[join_distinct:case when not passed then eval_type end] as failed_types from evals group by tenant_id, trace_id) e on e.tenant_id = m.tenant_id and e.trace_id = m.trace_id) x""",
    "first_failure": """select a.tenant_id, a.agent_name, r.rule_name, min(a.ts) as first_ts, min_by(a.trace_id, struct_key) as first_trace from (
      select tenant_id, trace_id, rule_name from rule_results where not skipped and not passed) r
      join (select *, concat(cast(ts as string), '|', lpad(cast(trace_id as string), 12, '0')) as struct_key from agent_traces) a on a.tenant_id = r.tenant_id and a.trace_id = r.trace_id group by a.tenant_id, a.agent_name, r.rule_name""",
    "novel_pattern": """select tenant_id, agent_name, failed, min_by(trace_id, concat(cast(ts as string), '|', lpad(cast(trace_id as string), 12, '0'))) as first_trace, count(*) as times from moments where failed <> '' group by tenant_id, agent_name, failed""",
    "rule_suggestion": f"""select tenant_id, trace_id, case pick when 's' then concat('my_', first_safety, '_extension') when 'l' then 'my_min_length' when 'c' then 'my_cost_cap' else 'my_custom_rule' end as name,
      case pick when 'l' then 'completeness' when 'c' then 'cost' else 'safety' end as eval_type, case pick when 's' then 'high' when 'c' then 'high' else 'medium' end as severity,
      case pick when 'l' then 'min_length' when 'c' then 'max_length' else 'regex_no_match' end as template, case pick when 'l' then '200' when 'c' then '0.05' else '' end as config_value
      from (select m.tenant_id, m.trace_id, r.first_failed as first_safety, case when m.n_safety_failed > 0 then 's' when contains(m.failed, 'min_output_length') then 'l' when contains(m.failed, 'cost_under_threshold') then 'c' else 'o' end as pick
        from moments m join (select tenant_id, trace_id, min_by(rule_name, rule_no) as first_failed from rule_results where not skipped and not passed group by tenant_id, trace_id) r on r.tenant_id = m.tenant_id and r.trace_id = m.trace_id where m.failed <> '') x""",
    "bulk_pattern": """select failed as pattern, count(*) as moments from moments where failed <> '' group by failed""",
    # Aggregations
    "dashboard_summary": f"""select count(*) as traces, {r('avg(t.latency_ms)', 2)} as avg_latency, {cents('t.cost_usd')} as cost, {r('cast(count_if(e.trace_id is not null) as double) / count(*)', 4)} as error_rate, {r('cast(sum(coalesce(v.n_passed_evals, 0)) as double) / nullif(sum(coalesce(v.n_evals, 0)), 0)', 4)} as eval_pass_rate
      from agent_traces t left join (select distinct tenant_id, trace_id from spans where status_code = 'ERROR') e on e.tenant_id = t.tenant_id and e.trace_id = t.trace_id
      left join (select tenant_id, trace_id, count(*) n_evals, count_if(passed) n_passed_evals from evals group by tenant_id, trace_id) v on v.tenant_id = t.tenant_id and v.trace_id = t.trace_id where {last('t.ts', 365)}""",
    "traces_per_hour": """select cast(date_trunc('hour', ts) as string) as hour, count(*) as traces from event_traces group by date_trunc('hour', ts)""",
    "top_agents": """select cast(row_number() over (order by traces desc, agent_name) as int) as rank, agent_name, traces from (select agent_name, count(*) as traces from agent_traces group by agent_name order by traces desc, agent_name limit 10) x""",
    "eval_stats": f"""select p.period, {_of_period('pass_rate')} as pass_rate, {_of_period('avg_score')} as avg_score, {_of_period('n')} as total_evals, {_of_period('cost')} as total_cost, {_of_period('agents')} as agents
      from (select '24h' as period union all select '7d' union all select '30d' union all select 'all') p
      join (select {', '.join(f"coalesce({r(f'cast(count_if(passed and {c}) as double) / nullif(count_if({c}), 0)', 3)}, 0.0) as pass_rate_{k}, coalesce({r(f'cast(sum(case when {c} then cast(round(score * 1000) as bigint) else 0 end) as double) / nullif(count_if({c}), 0) / 1000', 3)}, 0.0) as avg_score_{k}, cast(count_if({c}) as bigint) as n_{k}" for k, c in _since('created_at'))}
        from evals where created_at < AS_OF and trace_id is not null) e on true
      join (select {', '.join(f"{r(cents(f'case when {c} then cost_usd end'), 4)} as cost_{k}, count(distinct case when {c} then agent_name end) as agents_{k}" for k, c in _since('ts'))} from agent_traces where ts < AS_OF) t on true""",
    "safety_violations": """select cast(count_if(r.rule_name = 'no_pii') as bigint) as pii, cast(count_if(r.rule_name = 'no_injection_patterns') as bigint) as injection, cast(count_if(r.rule_name = 'no_hallucination_markers') as bigint) as hallucination
      from rule_results r join evals e on e.tenant_id = r.tenant_id and e.trace_id = r.trace_id and e.eval_type = r.eval_type where e.eval_type = 'safety' and not e.passed and not r.passed""",
    "eval_trend": f"""select cast(date_trunc('day', created_at) as string) as bucket, {r('cast(sum(cast(round(score * 1000) as bigint)) as double) / count(*) / 1000', 3)} as avg_score, {r('cast(count_if(passed) as double) / count(*)', 3)} as pass_rate, count(*) as evals from evals where {last('created_at', 30)} group by date_trunc('day', created_at)""",
    "eval_trend_6h": f"""select cast(floor(@[seconds:created_at] / 21600) as bigint) * 21600 as bucket, {r('cast(sum(cast(round(score * 1000) as bigint)) as double) / count(*) / 1000', 3)} as avg_score, {r('cast(count_if(passed) as double) / count(*)', 3)} as pass_rate, count(*) as evals from evals where {last('created_at', 7)} group by cast(floor(@[seconds:created_at] / 21600) as bigint)""",
    "eval_trend_hour": f"""select cast(date_trunc('hour', created_at) as string) as bucket, {r('cast(sum(cast(round(score * 1000) as bigint)) as double) / count(*) / 1000', 3)} as avg_score, {r('cast(count_if(passed) as double) / count(*)', 3)} as pass_rate, count(*) as evals from evals where {last('created_at', 1)} group by date_trunc('hour', created_at)""",
    "rule_breakdown": f"""select cast(row_number() over (order by cast(count_if(passed) as double) / count(*), rule_name) as int) as rank, rule_name, count(*) as total_run, cast(count_if(not passed) as bigint) as fail_count, {r('cast(count_if(passed) as double) / count(*)', 4)} as pass_rate from rule_results where not skipped group by rule_name""",
    "verdict_mix": """select v.verdict, coalesce(m.n, 0) as moments from (select 'pass' as verdict union all select 'fail' union all select 'partial' union all select 'unevaluated') v left join (select verdict, count(*) as n from moments group by verdict) m on m.verdict = v.verdict""",
    "significance_mix": """select k.kind, coalesce(m.n, 0) as moments from (select 'safety-violation' as kind union all select 'cost-spike' union all select 'rule-collision' union all select 'normal-fail' union all select 'first-failure' union all select 'novel-pattern') k left join (select kind, count(*) as n from moments group by kind) m on m.kind = k.kind""",
    "failures_by_category": """select kind, count(*) as moments from moments where verdict <> 'pass' group by kind""",
    "top_failing_rules": """select cast(row_number() over (order by failures desc, rule_name) as int) as rank, rule_name, failures from (select rule_name, count(*) as failures from rule_results where not skipped and not passed group by rule_name order by failures desc, rule_name limit 8) x""",
    "cost_by_agent": f"""select cast(row_number() over (order by cost desc, agent_name) as int) as rank, agent_name, cost from (select agent_name, {cents('cost_usd')} as cost from agent_traces group by agent_name order by cost desc, agent_name limit 8) x""",
    "agent_summary": """select agent_name, count(*) as total, cast(count_if(verdict = 'pass') as bigint) as passed, cast(count_if(verdict = 'partial') as bigint) as partial, cast(count_if(verdict = 'fail') as bigint) as failed, cast(count_if(verdict = 'unevaluated') as bigint) as unevaluated, cast(max(ts) as string) as last_seen from moments group by agent_name""",
    "stacked_by_day": f"""select cast(d.day as string) as day, coalesce(m.passed, 0) as passed, coalesce(m.partial, 0) as partial, coalesce(m.failed, 0) as failed, coalesce(m.unevaluated, 0) as unevaluated, coalesce(m.total, 0) as total
      from (select cast(@[shift:AS_OF;n.i] as date) as day from {numbers(*range(1, 31))}) d left join (
        select cast(ts as date) as day, cast(count_if(verdict = 'pass') as bigint) as passed, cast(count_if(verdict = 'partial') as bigint) as partial, cast(count_if(verdict = 'fail') as bigint) as failed, cast(count_if(verdict = 'unevaluated') as bigint) as unevaluated, count(*) as total
        from moments where {last('ts', 30)} group by cast(ts as date)) m on m.day = d.day""",
    "per_rule_meter": f"""select n.i as rule_name, {r(share("t.cur - coalesce(f.cur, 0)", "t.cur"), 4)} as pass_rate, t.cur as total,
      case when t.pri > 0 and t.cur > 0 then {r(share("t.cur - coalesce(f.cur, 0)", "t.cur") + " - " + share("t.pri - coalesce(f.pri, 0)", "t.pri"), 4)} end as drift, {', '.join(f"{r(share(f't.b{k} - coalesce(f.b{k}, 0)', f't.b{k}'), 4)} as b{k}" for k in range(6))}
      from {numbers(*BUILT_IN)} join (select {_meter('1')} from ({BUCKETED}) p where eval_count > 0) t on true
      left join (select r.rule_name, {_meter('1')} from ({BUCKETED}) p join (select distinct tenant_id, trace_id, rule_name from rule_results where not skipped and not passed) r on r.tenant_id = p.tenant_id and r.trace_id = p.trace_id where eval_count > 0 group by r.rule_name) f on f.rule_name = n.i""",
    "agent_movers": f"""select cast(row_number() over (order by abs(delta) desc, agent_name) as int) as rank, agent_name, current_rate, prior_rate, delta, total_current, {', '.join(f'b{k}' for k in range(8))} from (
      select agent_name, {r(share("passed", "cur"), 6)} as current_rate, {r(share("pri_passed", "pri"), 6)} as prior_rate, {r(share("passed", "cur") + " - " + share("pri_passed", "pri"), 6)} as delta, cur as total_current, {', '.join(f"{r(share(f'p{k}', f'n{k}'), 4)} as b{k}" for k in range(8))} from (
        select agent_name, count_if(win = 'current') as cur, count_if(win = 'prior') as pri, count_if(win = 'current' and verdict = 'pass') as passed, count_if(win = 'prior' and verdict = 'pass') as pri_passed,
          {', '.join(f"count_if(win = 'current' and bucket = {k}) as n{k}, count_if(win = 'current' and bucket = {k} and verdict = 'pass') as p{k}" for k in range(8))}
        from (select *, cast(least(7, greatest(0, floor((@[seconds:ts] - @[seconds:@[shift:AS_OF;90]]) * 8.0 / (90 * 86400)))) as int) as bucket from ({PERIODS}) p) b group by agent_name) c
      where cur >= 3 or pri >= 3 order by abs(delta) desc, agent_name limit 5) x""",
    "change_banner": f"""select pass_rate, prior_pass_rate, {r('pass_rate - prior_pass_rate', 4)} as pass_delta, cost, prior_cost, case when prior_cost > 0 then {r('(cost - prior_cost) / prior_cost', 4)} end as cost_delta, kinds, prior_kinds, kinds - prior_kinds as kinds_delta from (
      select {r(share("count_if(win = 'current' and verdict = 'pass')", "count_if(win = 'current')"), 4)} as pass_rate, {r(share("count_if(win = 'prior' and verdict = 'pass')", "count_if(win = 'prior')"), 4)} as prior_pass_rate,
        {cents("case when win = 'current' then cost_usd end")} as cost, {cents("case when win = 'prior' then cost_usd end")} as prior_cost,
        count(distinct case when win = 'current' and verdict <> 'pass' and kind <> 'normal-pass' then kind end) as kinds, count(distinct case when win = 'prior' and verdict <> 'pass' and kind <> 'normal-pass' then kind end) as prior_kinds from ({PERIODS}) p) x""",
    "kpi_vs_prior": f"""select {r('e.rate', 4)} as pass_rate, case when e.pri > 0 then {r('e.rate - e.pri_rate', 4)} end as pass_rate_delta, e.cur as total_evals, case when e.pri > 0 then {r('cast(e.cur - e.pri as double) / e.pri', 4)} end as evals_delta,
      t.cost as total_cost, case when t.pri_cost > 0 then {r('(t.cost - t.pri_cost) / t.pri_cost', 4)} end as cost_delta, t.agents from (
        select cast(count_if(cur) as bigint) as cur, cast(count_if(not cur) as bigint) as pri, {share("count_if(cur and passed)", "count_if(cur)")} as rate, {share("count_if(not cur and passed)", "count_if(not cur)")} as pri_rate from (select passed, created_at >= @[shift:AS_OF;90] as cur from evals where {last('created_at', 180)}) v) e
      join (select {cents("case when cur then cost_usd end")} as cost, {cents("case when not cur then cost_usd end")} as pri_cost, count(distinct case when cur then agent_name end) as agents from (select cost_usd, agent_name, ts >= @[shift:AS_OF;90] as cur from agent_traces where {last('ts', 180)}) u) t on true""",
    "live_pulse": f"""select e.pass_rate, m.significant, m.safety from (select coalesce({r('cast(count_if(passed) as double) / nullif(count(*), 0)', 3)}, 0.0) as pass_rate from evals where {last('created_at', 1)}) e
      join (select cast(count_if(kind <> 'normal-pass') as bigint) as significant, cast(count_if(kind = 'safety-violation') as bigint) as safety from (select * from moments where significance >= 0.4 and ts < AS_OF order by ts desc, trace_id limit 50) x) m on true""",
    "unread_audit": """select cast(count_if(ts > @[shift:EVENTS_AS_OF;0]) as bigint) as unread, count(*) as shown from (select * from audit order by ts desc, entry_id limit 10) x""",
    "category_rollup": """select coalesce(category, 'all') as category, coalesce(rule_name, 'all') as rule_name, count(*) as runs, cast(count_if(not passed) as bigint) as failures from (
      select case when rule_name in ('no_pii', 'no_injection_patterns') then 'safety' when rule_name in ('keyword_overlap', 'no_hallucination_markers') then 'relevance' when rule_name in ('cost_under_threshold', 'token_efficiency') then 'cost' else 'completeness' end as category, rule_name, passed from rule_results where not skipped) x group by rollup (category, rule_name)""",
    "health_band": f"""select agent_name, {r(_PASS, 4)} as pass_rate, case when {_PASS} >= 0.9 then 'pass' when {_PASS} >= 0.7 then 'warn' else 'fail' end as band from moments group by agent_name""",
    "rule_band": f"""select rule_name, {r('rate', 4)} as pass_rate, case when rate >= 0.95 then 'success' when rate >= 0.85 then 'primary' when rate >= 0.70 then 'warning' else 'error' end as band from (
      select rule_name, cast(count_if(passed) as double) / count(*) as rate from rule_results where not skipped group by rule_name) x""",
    "eval_coverage": f"""select t.agent_name, {r('100.0 * count(e.trace_id) / count(*)', 2)} as coverage from agent_traces t left join (select distinct tenant_id, trace_id from evals) e on e.tenant_id = t.tenant_id and e.trace_id = t.trace_id group by t.agent_name""",
    "threshold_calibration": f"""select n.agent_name, n.rank_now, b.rank_then, n.median_now, b.median_then, {r('n.median_now - b.median_then', 6)} as median_shift, n.p95_now as recommended from (
      select agent_name, {r('avg(case when cost_usd <= 0.1 then 1.0 else 0.0 end)', 4)} as rank_now, {r('@[median:cost_usd]', 6)} as median_now, {r('@[p95:cost_usd]', 6)} as p95_now from agent_traces where {last('ts', 90)} group by agent_name) n
      left join (select agent_name, {r('avg(case when cost_usd <= 0.1 then 1.0 else 0.0 end)', 4)} as rank_then, {r('@[median:cost_usd]', 6)} as median_then from agent_traces where ts < @[shift:AS_OF;90] group by agent_name) b on b.agent_name = n.agent_name""",
    "distribution_shift": f"""select d.day, d.n, {r('d.mean', 4)} as mean, {r('d.mean - b.mean', 3)} as shift, {r('d.sd', 4)} as stddev, {r('d.sd - b.sd', 3)} as stddev_shift, {r('d.failing', 4)} as failure_rate, {r('d.failing - b.failing', 3)} as failure_shift from (
      select cast(cast(created_at as date) as string) as day, count(*) as n, cast(sum(k) as double) / count(*) / 1000 as mean, case when count(*) > 1 then sqrt(greatest(0.0, (cast(sum(k * k) as double) - cast(sum(k) as double) * cast(sum(k) as double) / count(*)) / (count(*) - 1))) / 1000 end as sd, cast(count_if(not passed) as double) / count(*) as failing from (select *, cast(round(score * 1000) as bigint) as k from evals) e where {last('created_at', 30)} group by cast(created_at as date)) d
      join (select count(*) as n, cast(sum(k) as double) / count(*) / 1000 as mean, case when count(*) > 1 then sqrt(greatest(0.0, (cast(sum(k * k) as double) - cast(sum(k) as double) * cast(sum(k) as double) / count(*)) / (count(*) - 1))) / 1000 end as sd, cast(count_if(not passed) as double) / count(*) as failing from (select *, cast(round(score * 1000) as bigint) as k from evals) e where created_at < @[shift:AS_OF;30]) b on true""",
    "tool_latency": f"""select tool_name, count(*) as calls, {r('avg(latency_ms)', 3)} as avg_ms, {r('@[median:latency_ms]', 3)} as median_ms, {r('@[p95:latency_ms]', 3)} as p95_ms, cast(count_if(error is not null) as bigint) as errors from tool_calls group by tool_name""",
    # Windows
    "latest_eval": """select tenant_id, trace_id, eval_type, score from (select *, row_number() over (partition by tenant_id, trace_id order by created_at desc, eval_type) as n from evals) x where n = 1""",
    "rolling_7d": f"""select agent_name, cast(day as string) as day, {r('rolling', 4)} as rolling_mean, {r('base', 4)} as baseline, rolling < base as alert from (
      select agent_name, day, cast(sum(points) over w as double) / sum(n) over w / 1000 as rolling, cast(first_points as double) / first_n / 1000 as base from (
        select d.*, b.points as first_points, b.n as first_n from ({DAILY}) d join (select agent_name, sum(points) as points, sum(n) as n from (
          select *, min(day_no) over (partition by agent_name) as first_day from ({DAILY}) x) y where day_no < first_day + 30 group by agent_name) b on b.agent_name = d.agent_name) z
      window w as (partition by agent_name order by day_no range between 6 preceding and current row)) q""",
    "token_attribution": f"""select x.trace_id, x.agent_name, {r('x.completion_tokens / m.median', 3)} as ratio from text_traces x join (select agent_name, @[median:completion_tokens] as median from text_traces group by agent_name) m on m.agent_name = x.agent_name where m.median > 0 and x.completion_tokens / m.median >= 2""",
    "failure_burst": f"""select w.trace_id, w.agent_name, w.rule_name, w.in_last_hour, {r('b.per_hour', 6)} as baseline, w.in_last_hour > 2 * b.per_hour as burst from (
      select trace_id, agent_name, rule_name, count(*) over (partition by agent_name, rule_name order by sec range between 3600 preceding and current row) as in_last_hour from ({FAILED}) f) w
      join (select agent_name, rule_name, count(*) / greatest(1.0, (max(sec) - min(sec)) / 3600.0) as per_hour from ({FAILED}) f group by agent_name, rule_name) b on b.agent_name = w.agent_name and b.rule_name = w.rule_name""",
    "agent_sparkline": f"""select a.agent_name, a.bucket, coalesce(x.moments, 0) as moments, coalesce(x.passed, 0) as passed, {r(share('x.passed', 'x.moments'), 4)} as pass_rate from (
      select agent_name, n.i as bucket from (select distinct agent_name from moments where {last('ts', 90)}) m join {numbers(*range(8))} on true) a
      left join (select agent_name, bucket, count(*) as moments, cast(count_if(verdict = 'pass') as bigint) as passed from (
        select agent_name, verdict, cast(least(7, greatest(0, floor((@[seconds:ts] - @[seconds:@[shift:AS_OF;90]]) * 8.0 / (90 * 86400)))) as int) as bucket from moments where {last('ts', 90)}) b group by agent_name, bucket) x on x.agent_name = a.agent_name and x.bucket = a.bucket""",
    "rule_sparkline": f"""select a.rule_name, a.bucket, coalesce(x.runs, 0) as runs, coalesce(x.passed, 0) as passed, {r(share('x.passed', 'x.runs'), 4)} as pass_rate from (
      select rule_name, n.i as bucket from (select distinct rule_name from rule_results) m join {numbers(*range(6))} on true) a
      left join (select rule_name, bucket, count(*) as runs, cast(count_if(passed) as bigint) as passed from (
        select r.rule_name, r.passed, cast(least(5, floor((@[seconds:r.created_at] - b.lo) * 6.0 / greatest(b.hi - b.lo, 1))) as int) as bucket from rule_results r join (select min(@[seconds:created_at]) as lo, max(@[seconds:created_at]) as hi from rule_results) b on true where not r.skipped) c group by rule_name, bucket) x on x.rule_name = a.rule_name and x.bucket = a.bucket""",
    "score_sparkline": """select t.agent_name, cast(row_number() over (partition by t.agent_name order by e.created_at, e.trace_id, e.eval_type) as bigint) as place, e.score from evals e join agent_traces t on t.tenant_id = e.tenant_id and t.trace_id = e.trace_id""",
    # Sets
    "agent_union": f"""select agent_name from agent_traces where {last('ts', 7)} union select agent_name from agent_traces where ts >= @[shift:AS_OF;14] and ts < @[shift:AS_OF;7]""",
    "archive_update": """select trace_id from (select trace_id from moments where kind = 'cost-spike' union select trace_id from moments where verdict = 'fail') a except select trace_id from moments where trace_id % 5 = 0""",
    # Judge and cost tables
    "price_join": f"""select c.trace_id, c.provider, c.model, {r('c.prompt_tokens * p.input_usd / 1000000.0', 6)} as input_usd, {r('c.completion_tokens * p.output_usd / 1000000.0', 6)} as output_usd, {r('(c.prompt_tokens * p.input_usd + c.completion_tokens * p.output_usd) / 1000000.0', 6)} as usd
      from {CALLS} left join {PRICES} on p.provider = c.provider and p.model = c.model""",
    "cost_batch": f"""select count(p.model) as estimated, count(*) - count(p.model) as unknown_model, {r("cast(sum(cast(round((c.prompt_tokens * p.input_usd + c.completion_tokens * p.output_usd) * 100) as bigint)) as double) / 100000000", 6)} as usd
      from {CALLS} left join {PRICES} on p.provider = c.provider and p.model = c.model""",
    "judge_cost_gate": f"""select trace_id, model, usd, coalesce(usd <= 0.25, false) as admitted, case when usd is null then 'unknown model' when usd > 0.25 then 'over the cap' end as rejected from (
      select c.trace_id, c.model, {r("ceil((length(c.input) + length(c.output) + 900) / 4.0) * p.input_usd / 1000000 + 512 * p.output_usd / 1000000", 6)} as usd from {JUDGED} left join {JUDGE_PRICES} on p.model = c.model where c.input is not null) x""",
    "judge_sampling": """select tenant_id, trace_id, eval_type, score from evals where trace_id * 2654435761 % 100 < 20 or score < 0.6""",
    "judge_spend": f"""select c.template, c.provider, c.model, count(*) as calls, cast(sum(c.prompt_tokens + c.completion_tokens) as bigint) as tokens, {r("cast(sum(cast(round((c.prompt_tokens * p.input_usd + c.completion_tokens * p.output_usd) * 100) as bigint)) as double) / 100000000", 6)} as usd
      from (select *, case trace_id % 3 when 0 then 'accuracy' when 1 then 'helpfulness' else 'safety' end as template from {JUDGED}) c left join {JUDGE_PRICES} on p.model = c.model group by c.template, c.provider, c.model""",
    # Lifecycle and retention
    "retention_traces": """select tenant_id, trace_id from agent_traces where ts >= @[shift:AS_OF;30]""",
    "retention_spans": """select s.tenant_id, s.trace_id, s.span_no from spans s where exists (select 1 from agent_traces t where t.tenant_id = s.tenant_id and t.trace_id = s.trace_id and t.ts >= @[shift:AS_OF;30])""",
    "retention_evals": """select e.tenant_id, t.trace_id, e.eval_type, e.score from evals e left join (select tenant_id, trace_id from agent_traces where ts >= @[shift:AS_OF;30]) t on t.tenant_id = e.tenant_id and t.trace_id = e.trace_id""",
    "delete_traces": """select tenant_id, trace_id from agent_traces a where not exists (select 1 from moments m where m.tenant_id = a.tenant_id and m.trace_id = a.trace_id and m.verdict = 'fail')""",
    "rule_state": """select tenant_id, rule_id, action, enabled from (select *, row_number() over (partition by tenant_id, rule_id order by ts desc, entry_id desc) as n from audit where action <> 'rule.update') x where n = 1 and action <> 'rule.delete'""",
    "rule_state_asof": """select tenant_id, rule_id from (select *, row_number() over (partition by tenant_id, rule_id order by ts desc, entry_id desc) as n from audit where action <> 'rule.update' and ts <= @[shift:EVENTS_AS_OF;10]) x where n = 1 and action <> 'rule.delete' and enabled""",
    "list_rules": """select tenant_id, rule_id, event_type as eval_type from (select *, row_number() over (partition by tenant_id, rule_id order by ts desc, entry_id desc) as n from audit) x where n = 1 and action <> 'rule.delete' and enabled and event_type <> 'view'""",
    "tenant_backfill": """select coalesce(nullif(tenant_id, 't0'), 'local') as tenant_id, count(*) as entries from audit group by 1""",
    # Spans
    "critical_self_time": """select s.tenant_id, s.trace_id, s.span_no, greatest(0.0, s.duration_s - coalesce(c.children_s, 0.0)) as self_s from spans s
      left join (select tenant_id, trace_id, parent_no, sum(duration_s) as children_s from spans where parent_no is not null group by tenant_id, trace_id, parent_no) c on c.tenant_id = s.tenant_id and c.trace_id = s.trace_id and c.parent_no = s.span_no""",
    "oqs": f"""select tenant_id, trace_id, case when unsafe > 0 then 0.0 else {r('points / weight', 3)} end as oqs from (
      select e.tenant_id, e.trace_id, cast(sum(cast(round(e.score * 1000) as bigint) * case e.eval_type when 'completeness' then 30 when 'relevance' then 30 when 'safety' then 25 else 15 end) as double) / 1000 as points,
        cast(sum(case e.eval_type when 'completeness' then 30 when 'relevance' then 30 when 'safety' then 25 else 15 end) as double) as weight, max(coalesce(u.n, 0)) as unsafe
      from evals e left join (select tenant_id, trace_id, count(*) as n from rule_results where eval_type = 'safety' and not skipped and score <= 0.0 group by tenant_id, trace_id) u on u.tenant_id = e.tenant_id and u.trace_id = e.trace_id group by e.tenant_id, e.trace_id) x""",
}
_DOUBLE = re.compile(r"(?<![\w.'])(\d+\.\d+)(?![\w'])")
SQL = {k: _DOUBLE.sub(r"\1e0", v.replace("EVENTS_AS_OF", "@E").replace("AS_OF", AS_OF).replace("@E", EVENTS_AS_OF)) for k, v in SQL.items()}

QUERIES = {k: partial(lambda spark, sf_dir, sql: run_sql(spark, sf_dir, sql), sql=v) for k, v in SQL.items()}
ORACLES = {k: oracle(v) for k, v in SQL.items()}
