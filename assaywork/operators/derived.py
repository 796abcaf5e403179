"""Evals of rule results and moments of traces, as grouped tables; both keep to (tenant, trace), so that inputs dealt by these
keys are grouped and joined where they lie."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of rules, 2 where none is given; the safety rules; the cost of a spike; the passing score.
WEIGHTS = {"no_pii": 4, "no_injection_patterns": 4, "sentence_count": 1, "token_efficiency": 1}
SAFETY = ("no_pii", "no_blocklist_words", "no_injection_patterns", "no_stub_output")
SPIKE, PASSING = 0.10, 0.7
KEYS = ("tenant_id", "trace_id")
_USED, _FAILED = "not skipped", "not skipped and not passed"


def _thousandths(c: Column) -> Column:
    return F.floor(c * 1000 + 0.5) / 1000


def evals(results: DataFrame, *carried: str) -> DataFrame:
    """One row per trace and eval type, of (tenant_id, trace_id, eval_type, rule_no, rule_name, passed, skipped, score, created_at):
    the weighted mean of the rules that weren't skipped, summed in millionths so that order doesn't matter. ``carried`` columns
    are the same for all results of a trace."""
    weight = F.coalesce(*[F.when(F.col("rule_name") == n, w) for n, w in WEIGHTS.items()], F.lit(2))
    points = F.when(F.expr(_USED), F.round(F.col("score") * 1_000_000).cast("long") * weight)
    g = results.groupBy(*KEYS, "eval_type").agg(
        F.min("created_at").alias("created_at"), F.count_if(F.expr(_USED)).alias("rules_evaluated"), F.count_if("skipped").alias("rules_skipped"), F.count_if(F.expr(_FAILED)).alias("n_failed"),
        (F.sum(points) / F.sum(F.when(F.expr(_USED), weight)) / 1_000_000).alias("mean"), F.min_by("rule_name", F.col("rule_no") + F.when(F.expr(_FAILED), 0).otherwise(1000)).alias("first_failed"),
        *[F.max(c).alias(c) for c in carried])
    none = F.col("rules_evaluated") == 0
    return g.select(*KEYS, "eval_type", "created_at", "rules_evaluated", "rules_skipped", none.alias("insufficient_data"), F.when(none, 0.0).otherwise(_thousandths(F.col("mean"))).alias("score"),
                    (~none & (F.col("mean") >= PASSING)).alias("passed"), "n_failed", "first_failed", *carried)


def moments(traces: DataFrame, results: DataFrame, evals: DataFrame) -> DataFrame:
    """One row per trace, all its columns kept: snapshot of its evals and rules, verdict, kind and significance."""
    e = evals.groupBy(*KEYS).agg(F.count("*").alias("eval_count"), F.count_if(~F.col("passed")).alias("n_failed_types"),
                                 (F.sum(F.round(F.col("score") * 1000).cast("long")) / F.count("*") / 1000).alias("overall_score"))
    r = results.groupBy(*KEYS).agg(
        F.count("*").alias("n_total"), F.count_if("skipped").alias("n_skipped"), F.count_if(F.expr(_FAILED)).alias("n_failed"), F.count_if(F.expr(_FAILED) & F.col("rule_name").isin(*SAFETY)).alias("n_safety_failed"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.expr(_FAILED), F.col("rule_name")))), ",").alias("failed"))
    counts = ["eval_count", "n_failed_types", "n_total", "n_skipped", "n_failed", "n_safety_failed"]
    m = traces.join(e, list(KEYS), "left").join(r, list(KEYS), "left").fillna(0, counts).fillna(0.0, ["overall_score"]).fillna("", ["failed"])
    m = m.withColumn("n_passed", F.col("n_total") - F.col("n_skipped") - F.col("n_failed"))
    m = m.withColumn("verdict", F.when(F.col("n_total") == F.col("n_skipped"), "unevaluated").when(F.col("n_failed") == 0, "pass").when(F.col("n_passed") == 0, "fail").otherwise("partial"))
    m = m.withColumn("kind", F.when(F.col("n_safety_failed") > 0, "safety-violation").when(F.col("cost_usd") >= SPIKE, "cost-spike").when((F.col("n_failed") > 0) & (F.col("n_failed_types") >= 2), "rule-collision")
                     .when(F.col("verdict").isin("fail", "partial"), "normal-fail").otherwise("normal-pass"))
    by_kind = F.when(F.col("kind") == "safety-violation", 1.0).when(F.col("kind") == "cost-spike", 0.9).when(F.col("kind") == "rule-collision", 0.7)
    return m.withColumn("significance", F.coalesce(by_kind, F.when(F.col("verdict") == "fail", 0.5).when(F.col("verdict") == "partial", 0.4).when(F.col("verdict") == "pass", 0.05).otherwise(0.1)))


def rule_meter(moments: DataFrame, prior: Column, current: Column, end: Column, buckets: int = 6) -> DataFrame:
    """(rule_name, cur, pri, b0 ...): moments with evals of the current period, the prior one and the current one's buckets, as they
    were counted for each rule that failed, and under '' for all. Two scans of these two periods: one for the current
    period's first and last second, one for the counts."""
    m = moments.filter((F.col("ts") >= prior) & (F.col("ts") < end))
    sec, now = F.unix_timestamp("ts"), F.col("ts") >= current
    ends = m.filter(now).agg(F.min(sec).alias("lo"), F.max(sec).alias("hi"))
    counted = m.filter("eval_count > 0").crossJoin(F.broadcast(ends))
    bucket = F.least(F.lit(buckets - 1), F.floor((sec - F.col("lo")) * float(buckets) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1))))
    names = F.concat(F.array(F.lit("")), F.filter(F.split("failed", ","), lambda x: x != ""))
    counted = counted.select(now.alias("now"), F.when(now, bucket).alias("bucket"), F.explode(names).alias("rule_name"))
    return counted.groupBy("rule_name").agg(F.count_if("now").alias("cur"), F.count_if(~F.col("now")).alias("pri"), *[F.count_if(F.col("bucket") == k).alias(f"b{k}") for k in range(buckets)])
