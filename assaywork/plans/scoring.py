"""Rule scoring over whole texts, against SQL made from the same fixed values."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaywork.operators import custom, deployed, rules
from assaywork.sources.views import oracle, spread, view


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words(col: str, longer: int) -> str:
    return f"list_filter(string_split_regex(lower({col}), '\\W+'), lambda w: length(w) > {longer})"


def _any(text: str, phrases: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({text}, {q(p)})" for p in phrases) + ")"


def _matches(patterns: list[tuple[str, str]]) -> str:
    return "(" + " or ".join(f"regexp_matches(output, {q(p)}{f', {q(o)}' if o else ''})" for p, o in patterns) + ")"


_PII = _matches([(p.removeprefix("(?i)"), "i" if p.startswith("(?i)") else "") for p in rules.PII.values()])
_INJECTION = _matches([(p, "i") for p in rules.INJECTION])
_MARKERS = " + ".join(f"cast(contains(lower(output), {q(m)}) as int)" for m in rules.HALLUCINATION_MARKERS)
_EXPERT = q(rules.EXPERT_MARKERS.removeprefix("(?i)"))
_ISSUES = f"({_MARKERS} + cast(len(regexp_extract_all(output, '\\[\\d+\\]')) >= 3 and len(regexp_extract_all(output, {_EXPERT}, 0, 'i')) >= 2 as int))"
_SENTENCES = "len(list_filter(string_split_regex(output, '[.!?]+'), lambda s: regexp_matches(s, '\\S')))"
_MISSING = "({0} is null or {0} = '')"
_EX, _IN, _OUT = f"list_distinct({_words('expected', 2)})", f"list_distinct({_words('input', 2)})", f"list_distinct({_words('output', 2)})"
_SHARE = "cast(len(list_intersect({0}, {1})) as double) / len({0})"
_T_IN, _T_OUT = "t_in", "t_out"
#: With the words that topic_consistency compares.
_TEXTS = f"(select *, {_words('input', 3)} as t_in, {_words('output', 3)} as t_out from text_traces) texts"
_TOPIC = f"cast(len(list_filter({_T_OUT}, lambda w: list_contains({_T_IN}, w))) as double) / len({_T_OUT})"

#: rule -> (skipped, passed where it isn't skipped, score where it isn't skipped)
RULE_SQL = {
    "min_output_length": ("false", "length(output) >= 50", "case when length(output) >= 50 then 1e0 else least(length(output) / 50e0, 0.99e0) end"),
    "non_empty_output": ("false", "regexp_matches(output, '\\S')", "case when regexp_matches(output, '\\S') then 1e0 else 0e0 end"),
    "sentence_count": ("false", f"{_SENTENCES} >= 2", f"case when {_SENTENCES} >= 2 then 1e0 else least({_SENTENCES} / 2e0, 0.99e0) end"),
    "expected_coverage": (_MISSING.format("expected"), f"len({_EX}) = 0 or {_SHARE.format(_EX, _OUT)} >= 0.5e0", f"case when len({_EX}) = 0 then 1e0 else {_SHARE.format(_EX, _OUT)} end"),
    "keyword_overlap": (_MISSING.format("input"), f"len({_IN}) = 0 or {_SHARE.format(_IN, _OUT)} >= 0.35e0", f"case when len({_IN}) = 0 then 1e0 else least({_SHARE.format(_IN, _OUT)} * 2, 1e0) end"),
    "no_hallucination_markers": ("false", f"{_ISSUES} = 0", f"case when {_ISSUES} = 0 then 1e0 else greatest(0e0, 1 - {_ISSUES} * 0.3e0) end"),
    "topic_consistency": (f"{_MISSING.format('input')} or len({_T_IN}) = 0 or len({_T_OUT}) < 6", f"{_TOPIC} >= 0.1e0", f"least({_TOPIC} * 5, 1e0)"),
    "no_pii": ("false", f"not {_PII}", f"case when {_PII} then 0e0 else 1e0 end"),
    "no_blocklist_words": ("false", f"not {_any('lower(output)', rules.BLOCKLIST)}", f"case when {_any('lower(output)', rules.BLOCKLIST)} then 0e0 else 1e0 end"),
    "no_injection_patterns": ("false", f"not {_INJECTION}", f"case when {_INJECTION} then 0e0 else 1e0 end"),
    "no_stub_output": ("false", f"not {_any('upper(output)', rules.STUB_MARKERS)}", f"case when {_any('upper(output)', rules.STUB_MARKERS)} then 0e0 else 1e0 end"),
    "cost_under_threshold": ("cost_usd is null", "cost_usd <= 0.1e0", "case when cost_usd <= 0.1e0 then 1e0 else greatest(0e0, 1 - (cost_usd - 0.1e0) / 0.1e0) end"),
    "token_efficiency": ("prompt_tokens is null or completion_tokens is null or prompt_tokens = 0", "completion_tokens / prompt_tokens <= 5e0", "case when completion_tokens / prompt_tokens <= 5e0 then 1e0 else greatest(0e0, 1 - (completion_tokens / prompt_tokens - 5e0) / 5e0) end"),
}
#: topic_consistency passes with score 1 where it is skipped for a brief output.
_BRIEF = f"not {_MISSING.format('input')} and len({_T_IN}) > 0 and len({_T_OUT}) between 1 and 5"


def rule_columns(name: str) -> tuple[str, str, str]:
    """SQL of skipped, passed and score."""
    skip, ok, score = RULE_SQL[name]
    lenient = f"({_BRIEF})" if name == "topic_consistency" else "false"
    return f"coalesce({skip}, false)", f"case when coalesce({skip}, false) then {lenient} else {ok} end", f"case when coalesce({skip}, false) then case when {lenient} then 1e0 else 0e0 end else {score} end"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(view(spark, sf_dir, "text_traces"), "trace_id")


def rule_query(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scored = rules.apply_rule(texts(spark, sf_dir), name)
    return scored.select("tenant_id", "trace_id", "result.skipped", "result.passed", "result.score")


def rule_oracle(name: str) -> str:
    skip, ok, score = rule_columns(name)
    return oracle(f"select tenant_id, trace_id, {skip} as skipped, {ok} as passed, {score} as score from {_TEXTS}")


def _all_results(names: tuple[str, ...] = tuple(r.name for r in rules.BUILT_IN)) -> str:
    cols = []
    for r in (r for r in rules.BUILT_IN if r.name in names):
        skip, ok, score = rule_columns(r.name)
        cols += [f"{skip} as {r.name}_k", f"{ok} as {r.name}_p", f"{score} as {r.name}_s"]
    return f"select tenant_id, trace_id, agent_name, {', '.join(cols)} from {_TEXTS}"


def _bundle_sql(t: str) -> str:
    own = rules.rules_of(t)
    points = " + ".join(f"case when {r.name}_k then 0e0 else {r.name}_s * {r.weight}e0 end" for r in own)
    weight = " + ".join(f"case when {r.name}_k then 0e0 else {r.weight}e0 end" for r in own)
    n = " + ".join(f"cast(not {r.name}_k as int)" for r in own)
    failed = " + ".join(f"cast(not {r.name}_k and not {r.name}_p as int)" for r in own)
    return f"select tenant_id, trace_id, '{t}' as eval_type, ({n}) as n, {len(own)} - ({n}) as k, ({points}) as points, ({weight}) as weight, ({failed}) as failed from results"


BUNDLES = " union all ".join(_bundle_sql(t) for t in rules.EVAL_TYPES)
_SCORED = """select tenant_id, trace_id, eval_type, case when n = 0 then 0e0 else floor(points / weight * 1000e0 + 0.5e0) / 1000e0 end as score, n > 0 and points / weight >= 0.7e0 as passed,
  cast(n as integer) as rules_evaluated, cast(k as integer) as rules_skipped, n = 0 as insufficient_data, cast(case when n = 0 then k + 1 else failed + cast(k > 0 as int) end as integer) as n_suggestions from bundles"""


def scored_oracle(sql: str) -> str:
    return oracle(f"with results as ({_all_results()}), bundles as ({BUNDLES}), scored as ({_SCORED}) {sql}")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.evaluate(texts(spark, sf_dir))


def score_all_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("tenant_id", "trace_id", "eval_type", "score", "passed", "rules_evaluated", "rules_skipped", "insufficient_data")


def score_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.evaluate(texts(spark, sf_dir), ["safety"]).select("tenant_id", "trace_id", "score", "passed")


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("tenant_id", "trace_id", "eval_type", F.size("suggestions").alias("n_suggestions"))


def agent_eval_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk scoring end to end: pass rate of each agent and eval type."""
    t = texts(spark, sf_dir)
    e = rules.evaluate(t, keys=("tenant_id", "trace_id", "agent_name"))
    return e.groupBy("agent_name", "eval_type").agg(F.count("*").alias("evals"), F.count_if("passed").alias("passed"))


CUSTOM = (
    {"name": "says-the", "type": "regex_match", "config": {"pattern": r"(?i)\bthe\b"}},
    {"name": "no-mail", "type": "regex_no_match", "config": {"pattern": r"[a-z]+@[a-z]+"}, "weight": 2},
    {"name": "long-enough", "type": "min_length", "config": {"length": 1200}},
    {"name": "short-enough", "type": "max_length", "config": {"max_length": 3000}},
    {"name": "words", "type": "contains_keywords", "config": {"keywords": ["The", "und", "de la"], "threshold": 0.3}},
    {"name": "no-words", "type": "excludes_keywords", "config": {"keywords": ["idiot", "scum"]}},
    {"name": "cheap", "type": "cost_threshold", "config": {"max_cost": 0.05}},
    {"name": "bad", "type": "min_length", "config": {}},
)


def custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = texts(spark, sf_dir)
    c = rules.Context.of(t)
    each = F.explode(F.array(*[custom.custom_rule(d).evaluate(c) for d in CUSTOM]))
    return t.select("trace_id", each.alias("r")).select("trace_id", F.col("r.ruleName").alias("rule_name"), "r.passed", "r.score")


_CUSTOM_SQL = {
    "says-the": ("regexp_matches(output, '\\bthe\\b', 'i')", None), "no-mail": ("not regexp_matches(output, '[a-z]+@[a-z]+')", None),
    "long-enough": ("length(output) >= 1200", "length(output) / 1200e0"), "short-enough": ("length(output) <= 3000", "3000e0 / length(output)"),
    "words": ("n / 3e0 >= 0.3e0", "n / 3e0"), "no-words": ("not (contains(lower(output), 'idiot') or contains(lower(output), 'scum'))", None),
    "cheap": ("coalesce(cost_usd, 0) <= 0.05e0", None), "bad": ("false", None),
}
_CUSTOM_ORACLE = "with t as (select *, cast(contains(lower(output), 'the') as int) + cast(contains(lower(output), 'und') as int) + cast(contains(lower(output), 'de la') as int) as n from text_traces) " + " union all ".join(
    f"select trace_id, '{k}' as rule_name, {ok} as passed, " + (score if k == "words" else f"case when {ok} then 1e0 else {score or '0e0'} end") + " as score from t" for k, (ok, score) in _CUSTOM_SQL.items())


def regex_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of the pattern guard per pattern, with the texts that an accepted one meets."""
    t = texts(spark, sf_dir)
    patterns = {"plain": "Thing", "hoisted": "(?i)THING", "nested": "(a+)+$", "broken": "(", "long": "a" * 1001}
    guarded = {k: custom.guarded_pattern(p) for k, p in patterns.items()}
    counts = [F.count_if(F.col("output").rlike(p)).alias(k) if p else F.lit(-1).cast("long").alias(k) for k, (p, _) in guarded.items()]
    return t.agg(*counts)


#: Keywords that the rules which exclude some are about, by rule number.
KEYWORDS = ("idiot", "the", "und", "scum")


def _deployed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = view(spark, sf_dir, "deployed_rules")
    bound = F.pow(F.lit(2), F.col("k") % 6 + 7).cast("int")
    config = F.when(F.col("type") == "min_length", F.to_json(F.struct(bound.alias("length")))).when(F.col("type") == "cost_threshold", F.to_json(F.struct(((F.col("k") % 8) / 64).alias("max_cost"))))
    config = config.otherwise(F.to_json(F.struct(F.array(F.get(F.array(*map(F.lit, KEYWORDS)), F.col("k") % 4)).alias("keywords"))))
    text = F.concat(F.lit('{"name": "'), F.col("rule_id"), F.lit('", "type": "'), F.col("type"), F.lit('", "weight": '), (F.col("k") % 2 + 1).cast("string"), F.lit(', "config": '), config, F.lit("}"))
    return r.select("tenant_id", "rule_id", "eval_type", "enabled", text.alias("definition"))


def deployed_rule_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Safety and cost with each tenant's enabled rules."""
    e = deployed.score(texts(spark, sf_dir), _deployed(spark, sf_dir), ("safety", "cost"))
    return e.select("tenant_id", "trace_id", "eval_type", "rules_evaluated", "rules_skipped", "score", "passed")


def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored again, against its stored evals."""
    return deployed.replay(texts(spark, sf_dir), view(spark, sf_dir, "stored_evals"))


_NOW = ("safety", "cost")
_OWN = {t: [r for r in rules.BUILT_IN if r.eval_type == t] for t in _NOW}
_BASE = " union all ".join(f"""select tenant_id, trace_id, '{t}' as eval_type, {' + '.join(f"case when {r.name}_k then 0e0 else {r.name}_s * {r.weight}e0 end" for r in own)} as points,
  {' + '.join(f"case when {r.name}_k then 0e0 else {r.weight}e0 end" for r in own)} as weight, {' + '.join(f"cast({r.name}_k as int)" for r in own)} as skipped, {len(own)} as rules from results""" for t, own in _OWN.items())
_MORE = f"""select t.tenant_id, t.trace_id, d.eval_type, sum((d.k % 2 + 1) * case d.type when 'min_length' then least(1e0, length(t.output) / cast(pow(2, d.k % 6 + 7) as double))
    when 'cost_threshold' then cast(coalesce(t.cost_usd, 0) <= (d.k % 8) / 64e0 as int) else cast(not contains(lower(t.output), case d.k % 4 {' '.join(f"when {i} then {q(w)}" for i, w in enumerate(KEYWORDS))} end) as int) end) as points, sum(d.k % 2 + 1) as weight, count(*) as n
  from text_traces t join deployed_rules d on d.tenant_id = t.tenant_id and d.enabled group by 1, 2, 3"""


def _lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit's entries with the number of their rule; their times moved to those of the texts."""
    a = view(spark, sf_dir, "audit")
    return a.select("entry_id", "tenant_id", "rule_id", "action", "enabled", "event_type", F.substring("rule_id", 6, 9).cast("int").alias("k"), "ts").withColumn("eval_type", F.when(F.col("k") % 2 == 0, "safety").otherwise("cost"))


def replay_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text scored by the rules that were in force at its time, beside what stands in the store."""
    t = texts(spark, sf_dir).select("tenant_id", "trace_id", "ts", "output", "cost_usd")
    met = deployed.at_their_time(t, deployed.in_force(_lifecycle(spark, sf_dir)))
    word = F.get(F.array(*map(F.lit, KEYWORDS)), F.col("k") % 4)
    bound = F.pow(F.lit(2.0), F.col("k") % 6 + 7)
    score = F.when(F.col("k") % 3 == 0, F.least(F.lit(1.0), F.length("output") / bound)).when(F.col("k") % 3 == 1, F.when(F.contains(F.lower("output"), word), 0.0).otherwise(1.0)).otherwise(F.when(F.coalesce("cost_usd", F.lit(0.0)) <= (F.col("k") % 8) / 64, 1.0).otherwise(0.0))
    scored = met.groupBy("tenant_id", "trace_id", "eval_type").agg(F.count("*").alias("rules_in_force"), (F.floor(F.avg(score) * 1000 + 0.5) / 1000).alias("score"))
    old = view(spark, sf_dir, "stored_evals").select("tenant_id", "trace_id", "eval_type", F.col("score").alias("stored_score"))
    both = scored.join(old, ["tenant_id", "trace_id", "eval_type"], "left")
    return both.withColumn("delta", F.floor((F.col("score") - F.col("stored_score")) * 1000 + 0.5) / 1000)


#: Apart from the query: each text asks for the latest entry of each rule up to its time.
_ASOF = f"""select x.tenant_id, x.trace_id, x.eval_type, x.rules_in_force, x.score, o.score as stored_score, floor((x.score - o.score) * 1000 + 0.5e0) / 1000 as delta from (
  select tenant_id, trace_id, eval_type, count(*) as rules_in_force, floor(avg(case k % 3 when 0 then least(1e0, length(output) / pow(2e0, k % 6 + 7)) when 1 then cast(not contains(lower(output), case k % 4 {' '.join(f"when {i} then {q(w)}" for i, w in enumerate(KEYWORDS))} end) as double)
      else cast(coalesce(cost_usd, 0) <= (k % 8) / 64e0 as double) end) * 1000 + 0.5e0) / 1000 as score from (
    select t.tenant_id, t.trace_id, t.output, t.cost_usd, cast(substring(a.rule_id, 6) as int) as k, case when cast(substring(a.rule_id, 6) as int) % 2 = 0 then 'safety' else 'cost' end as eval_type, a.action, a.enabled,
      row_number() over (partition by t.trace_id, a.rule_id order by a.ts desc, a.entry_id desc) as n from text_traces t join audit a on a.tenant_id = t.tenant_id and a.ts <= t.ts and a.action <> 'rule.update') r
  where n = 1 and action <> 'rule.delete' and enabled group by 1, 2, 3) x left join stored_evals o on o.tenant_id = x.tenant_id and o.trace_id = x.trace_id and o.eval_type = x.eval_type"""


def preview_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five newest texts of the newest 1000 of a window that a proposed rule would fail, with the start of each."""
    t = texts(spark, sf_dir)
    start, end = (F.expr(f"timestamp_ntz'{d} 00:00:00'") for d in ("2024-01-05", "2024-01-25"))
    return custom.preview(t, {"name": "p", "type": "max_length", "config": {"length": 2000}}, start, end, 1000)[1]


def suggestion_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suggestions themselves, one a row, of safety and cost."""
    e = rules.evaluate(texts(spark, sf_dir), ["safety", "cost"])
    return e.select("tenant_id", "trace_id", "eval_type", F.posexplode("suggestions").alias("place", "suggestion"))


def rule_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = texts(spark, sf_dir)
    start, end = (F.expr(f"timestamp_ntz'{d} 00:00:00'") for d in ("2024-01-05", "2024-01-25"))
    return custom.preview(t, {"name": "p", "type": "max_length", "config": {"length": 2000}}, start, end)[0]


QUERIES = {f"rule_{r.name}": partial(rule_query, name=r.name) for r in rules.BUILT_IN}
ORACLES = {f"rule_{r.name}": rule_oracle(r.name) for r in rules.BUILT_IN}
QUERIES |= {
    "score_all_types": score_all_types, "score_bundle": score_bundle, "suggestions": suggestions, "agent_eval_rates": agent_eval_rates, "custom_rules": custom_rules,
    "replay_asof": replay_asof, "preview_examples": preview_examples, "suggestion_texts": suggestion_texts, "regex_flags": regex_flags, "deployed_rule_scoring": deployed_rule_scoring, "replay": replay, "rule_preview": rule_preview,
}
ORACLES |= {
    "score_all_types": scored_oracle("select * exclude (n_suggestions) from scored"),
    "score_bundle": scored_oracle("select tenant_id, trace_id, score, passed from scored where eval_type = 'safety'"),
    "suggestions": scored_oracle("select tenant_id, trace_id, eval_type, n_suggestions from scored"),
    "agent_eval_rates": scored_oracle("select r.agent_name, s.eval_type, count(*) as evals, cast(count_if(s.passed) as bigint) as passed from scored s join results r on r.tenant_id = s.tenant_id and r.trace_id = s.trace_id group by r.agent_name, s.eval_type"),
    "custom_rules": oracle(_CUSTOM_ORACLE),
    "regex_flags": oracle("select cast(count_if(contains(output, 'Thing')) as bigint) as plain, cast(count_if(contains(lower(output), 'thing')) as bigint) as hoisted, cast(-1 as bigint) as nested, cast(-1 as bigint) as broken, cast(-1 as bigint) as long from text_traces"),
    "deployed_rule_scoring": oracle(f"with results as ({_all_results(tuple(r.name for own in _OWN.values() for r in own))}), base as ({_BASE}), more as ({_MORE}) " + """select tenant_id, trace_id, eval_type, cast(n as integer) as rules_evaluated, cast(skipped as integer) as rules_skipped,
      case when n = 0 then 0e0 else floor(points / weight * 1000e0 + 0.5e0) / 1000e0 end as score, n > 0 and points / weight >= 0.7e0 as passed from (
      select b.tenant_id, b.trace_id, b.eval_type, b.skipped, b.rules - b.skipped + coalesce(m.n, 0) as n, b.points + coalesce(m.points, 0) as points, b.weight + coalesce(m.weight, 0) as weight
      from base b left join more m on m.tenant_id = b.tenant_id and m.trace_id = b.trace_id and m.eval_type = b.eval_type) x"""),
    "replay": scored_oracle("""select s.tenant_id, s.trace_id, s.eval_type, s.score, s.passed, o.score as stored_score, o.passed as stored_passed, floor((s.score - o.score) * 1000 + 0.5e0) / 1000 as delta, s.passed <> o.passed as changed
      from scored s left join stored_evals o on o.tenant_id = s.tenant_id and o.trace_id = s.trace_id and o.eval_type = s.eval_type"""),
    "replay_asof": oracle(_ASOF),
    "preview_examples": oracle("select trace_id, substring(output, 1, 200) as preview from (select * from text_traces where ts >= timestamp '2024-01-05 00:00:00' and ts < timestamp '2024-01-25 00:00:00' order by ts desc, trace_id limit 1000) t where length(output) > 2000 order by ts desc, trace_id limit 5"),
    "rule_preview": oracle("select cast(count_if(length(output) > 2000) as bigint) as would_fail, cast(count_if(length(output) <= 2000) as bigint) as would_pass, cast(0 as bigint) as would_skip from text_traces where ts >= timestamp '2024-01-05 00:00:00' and ts < timestamp '2024-01-25 00:00:00'"),
}
