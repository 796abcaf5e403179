"""Queries over tables that are kept up: late arrivals, dashboards by period, retention. The given tables hold some tens of traces
a day at most, so their periods are quarters."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaywork.operators import derived
from assaywork.plans import sqlplans
from assaywork.plans.sqlplans import BUILT_IN
from assaywork.sources.store import Store
from assaywork.sources.views import oracle, view
from assaywork.streaming.jobs import shared_folder

AS_OF, MONTH_AGO, PRIOR, CURRENT = (datetime(*d) for d in ((1998, 6, 1), (1998, 5, 2), (1997, 12, 3), (1998, 3, 3)))
#: The second result and later ones of this month's traces come after it was derived.
LATE = "date_trunc('month', created_at) = timestamp_ntz'1996-03-01 00:00:00' and rule_no > 1"


#: Rows of the largest table to a bucket, in all periods: a task writes a bucket, and each of its periods is a file.
BUCKET = 2_000_000


def buckets(rows: int, cores: int) -> int:
    """As many as cores where there are rows for them, more where a task would have more than ``BUCKET``."""
    return max(4, min(cores, rows * 8 // BUCKET), -(-rows // BUCKET))


def _store(spark: SparkSession, sf_dir: str) -> Store:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    return Store(spark, shared_folder(spark, "store"), unit="quarter", buckets=buckets(rows, spark.sparkContext.defaultParallelism))


def kept(spark: SparkSession, sf_dir: str) -> Store:
    """Two arrivals: history up to a month ago, then the month and what came late for one of 1996."""
    store, traces, results = _store(spark, sf_dir), view(spark, sf_dir, "agent_traces"), view(spark, sf_dir, "rule_results")
    late = (F.col("created_at") >= F.lit(MONTH_AGO)) | F.expr(LATE)
    new = F.col("ts") >= F.lit(MONTH_AGO)
    for traces_of, results_of in ((~new, ~late), (new, late)):
        came = store.add_traces(traces.filter(traces_of))
        store.derive(came | store.add_parts("results", results.filter(results_of), "created_at"))
    return store


def evals_kept_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir).read("evals").drop("period", "created_at")


def moments_kept_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir).read("moments").drop("period", "framework", "ts")


def meter_of_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``per_rule_meter`` from the stored moments of the two periods."""
    m = kept(spark, sf_dir).read("moments").filter((F.col("period") >= F.trunc(F.lit(PRIOR), "quarter")) & (F.col("period") <= F.lit(AS_OF).cast("date")))
    counts = derived.rule_meter(m, *map(F.lit, (PRIOR, CURRENT, AS_OF)))
    places = counts.columns[1:]
    rules = spark.createDataFrame([(n,) for n in BUILT_IN], "rule_name string")
    total = counts.filter("rule_name = ''").select(*[F.col(c).alias(f"t_{c}") for c in places])
    found = rules.crossJoin(F.broadcast(total)).join(counts, "rule_name", "left").fillna(0, places)
    share = lambda c: F.when(F.col(f"t_{c}") > 0, (F.col(f"t_{c}") - F.col(c)) / F.col(f"t_{c}")).otherwise(0.0)
    four = lambda c: F.floor(c * 10000 + 0.5) / 10000
    both = (F.col("t_pri") > 0) & (F.col("t_cur") > 0)
    return found.select("rule_name", four(share("cur")).alias("pass_rate"), F.col("t_cur").alias("total"), F.when(both, four(share("cur") - share("pri"))).alias("drift"), *[four(share(c)).alias(c) for c in places[2:]])


def retention_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each tenant's rows, by table, when what is older than a month has gone; run twice, the second time in vain."""
    store = _store(spark, sf_dir)
    came = store.add_traces(view(spark, sf_dir, "agent_traces"))
    came |= store.add_parts("results", view(spark, sf_dir, "rule_results"), "created_at")
    store.add_parts("spans", view(spark, sf_dir, "spans"), "start_time")
    store.derive(came)
    store.retain(MONTH_AGO)
    again = store.retain(MONTH_AGO)
    left = [store.read(t).groupBy("tenant_id").agg(F.lit(t).alias("table_name"), F.count("*").alias("n_rows"), F.count_if(F.col("trace_id").isNull()).alias("n_detached")) for t in ("traces", "spans", "results", "evals", "moments")]
    out = left[0]
    for x in left[1:]:
        out = out.unionAll(x)
    return out.withColumn("gone_again", F.lit(again).cast("int"))


QUERIES = {f.__name__: f for f in (evals_kept_up, moments_kept_up, meter_of_kept, retention_applied)}
_MONTH = "@[shift:AS_OF;30]".replace("AS_OF", sqlplans.AS_OF)
_KEPT = f"(select tenant_id, trace_id from agent_traces where ts >= {_MONTH}) k"
_LEFT = " union all ".join(f"select x.tenant_id, '{t}' as table_name, count(*) as n_rows, cast(0 as bigint) as n_detached, cast(0 as integer) as gone_again from {v} x join {_KEPT} on k.tenant_id = x.tenant_id and k.trace_id = x.trace_id group by 1"
                           for t, v in (("traces", "agent_traces"), ("spans", "spans"), ("moments", "moments")))
_STAYS = " union all ".join(f"select x.tenant_id, '{t}' as table_name, count(*) as n_rows, cast(count_if(k.trace_id is null) as bigint) as n_detached, cast(0 as integer) as gone_again from {v} x left join {_KEPT} on k.tenant_id = x.tenant_id and k.trace_id = x.trace_id group by 1"
                            for t, v in (("results", "rule_results"), ("evals", "evals")))
ORACLES = {
    "evals_kept_up": oracle("select tenant_id, trace_id, eval_type, rules_evaluated, rules_skipped, insufficient_data, score, passed, n_failed, first_failed from evals"),
    "moments_kept_up": oracle("select tenant_id, trace_id, agent_name, cost_usd, latency_ms, eval_count, overall_score, n_failed_types, n_failed, n_skipped, n_passed, n_total, n_safety_failed, failed, verdict, kind, significance from moments"),
    "meter_of_kept": sqlplans.ORACLES["per_rule_meter"], "retention_applied": oracle(f"{_LEFT} union all {_STAYS}"),
}
