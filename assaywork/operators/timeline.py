"""Entries on a time axis: what happened within a day before and after each, and greedy clusters of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_DAY = "make_dt_interval(1)"


def impact(entries: DataFrame, events: DataFrame) -> DataFrame:
    """(ts, before_n, after_n, before_passed, after_passed) of each distinct ts of ``entries``: events, and
    those not failed, of (ts, failed), in the day up to it (exclusive) and in the day from it on.

    A count between two moments is a difference of counts since midnight; such a count is that of the
    minutes before (at most 1440 a day) and that of the steps before within the minute, so no window
    holds more than one day's minutes or one minute's distinct moments."""
    at = entries.filter("ts is not null").select("ts").distinct()
    probes = at.select("ts", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("side"))
    probes = probes.select("ts", "side", F.expr(f"case side when -1 then ts - {_DAY} when 1 then ts + {_DAY} else ts end").alias("x"))
    seen = events.filter("ts is not null").select(F.col("ts").alias("x"), F.lit(1).alias("n"), (~F.coalesce("failed", F.lit(True))).cast("int").alias("passed"))
    steps = seen.unionAll(probes.select("x", F.lit(0).alias("n"), F.lit(0).alias("passed"))).groupBy("x").agg(F.sum("n").alias("n"), F.sum("passed").alias("passed"))
    steps = steps.withColumn("minute", F.date_trunc("minute", "x"))
    minutes = steps.groupBy("minute").agg(F.sum("n").alias("n"), F.sum("passed").alias("passed"))
    day = Window.partitionBy(F.to_date("minute"))
    earlier = day.orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    minutes = minutes.select("minute", sums("n", earlier).alias("n0"), sums("passed", earlier).alias("passed0"), sums("n", day).alias("n_day"), sums("passed", day).alias("passed_day"))
    within = Window.partitionBy("minute").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.select("x", "minute", sums("n", within).alias("n1"), sums("passed", within).alias("passed1"))
    since = probes.join(steps, "x").join(minutes, "minute")

    def part(c: str, early: int):
        """Of the two days that the window meets: the rest of the first, and the second up to its end."""
        so_far, total = F.col(f"{c}0") + F.col(f"{c}1"), F.col(f"{c}_day")
        return F.sum(F.when(F.col("side") == early, total - so_far).when(F.col("side") == early + 1, so_far).otherwise(0))

    return since.groupBy("ts").agg(part("n", -1).alias("before_n"), part("n", 0).alias("after_n"), part("passed", -1).alias("before_passed"), part("passed", 0).alias("after_passed"))


def _written(df: DataFrame) -> DataFrame:
    """Written to the folder that all executors share, and read back."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="spark-assay-")
    path = f"{shared.rstrip('/')}/timeline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clusters(entries: DataFrame, share: float = 0.05) -> DataFrame:
    """(tenant_id, first, n): greedy clusters of each tenant's positions, of (tenant_id, x long): one joins
    while within ``share`` of the tenant's axis of its cluster's first position.

    Equal positions are counted first. Each round finds every tenant's next first position as a grouped
    minimum beyond the reach of the last; as firsts are more than the share apart, rounds are at most
    1 / share. The firsts are few, a cluster's members are counted by a join with them."""
    positions = entries.filter("x is not null").groupBy("tenant_id", "x").agg(F.count("*").alias("n")).persist()
    low, high = F.min("x"), F.max("x")
    last = _written(positions.groupBy("tenant_id").agg(low.alias("first"), ((high - low) * share).cast("long").alias("width")))
    firsts = last
    while not last.isEmpty():
        beyond = F.col("p.tenant_id").eqNullSafe(F.col("l.tenant_id")) & (F.col("x") > F.col("first") + F.col("width"))
        last = _written(positions.alias("p").join(last.alias("l"), beyond).groupBy("l.tenant_id", "width").agg(F.min("x").alias("first")).select("tenant_id", "first", "width"))
        firsts = firsts.unionAll(last)
    within = F.col("p.tenant_id").eqNullSafe(F.col("f.tenant_id")) & F.col("x").between(F.col("first"), F.col("first") + F.col("width"))
    found = _written(positions.alias("p").join(firsts.alias("f"), within).groupBy("f.tenant_id", "first").agg(F.sum("n").alias("n")))
    positions.unpersist()
    return found


def at_or_before(entries: DataFrame, days: DataFrame) -> DataFrame:
    """``entries`` with the latest of the distinct ``days`` (bucket) at or before their ts; without those
    before the first. Only the table of distinct days is sorted as a whole."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    known = days.select("bucket", F.col("bucket").alias("day")).unionByName(entries.select(day.alias("day")).distinct(), allowMissingColumns=True)
    known = known.groupBy("day").agg(F.max("bucket").alias("bucket")).select("day", F.max("bucket").over(Window.orderBy("day")).alias("bucket"))
    return entries.withColumn("day", day).join(known.filter("bucket is not null"), "day").drop("day")
