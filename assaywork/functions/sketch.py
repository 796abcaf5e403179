"""A mergeable quantile sketch: a histogram over log-linear buckets, 128 to each power of two.

Whole numbers below 256 have buckets of their own; above, a bucket's middle is within 1/256 of each of its numbers.
A sketch is a table of counts by key and bucket (some thousand buckets at most), so sketches of days are merged by
adding up, and no aggregation holds an agent's values. ``exact`` uses one to find the buckets in which quantiles lie, and
puts only the values of those in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(v: Column) -> Column:
    """Of a number, as a whole one from 0 on (negative ones count as 0); ascending with it."""
    whole = F.greatest(v.cast("long"), F.lit(0).cast("long"))
    more = F.greatest(F.length(F.bin(whole)) - 8, F.lit(0))
    return (more * 128 + F.call_function("shiftright", whole, more)).cast("int")


def middle(b: Column) -> Column:
    more = F.greatest(F.floor(b / 128) - 1, F.lit(0)).cast("int")
    width = F.call_function("shiftleft", F.lit(1).cast("long"), more)
    return (b - more * 128) * width + (width - 1) / 2


def sketch(df: DataFrame, value: Column, *keys: str) -> DataFrame:
    """(keys, bucket, n) of the values that aren't null."""
    return df.select(*keys, value.alias("__v")).filter("__v is not null").groupBy(*keys, bucket(F.col("__v")).alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], **per_cent: int) -> DataFrame:
    """(keys, one column for each name): the middle of the bucket of the value at that per cent, the first one at or above
    which so many of the values lie. ``sketches`` may be of more keys, whose buckets are added up."""
    merged = sketches.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(*keys)
    upto = merged.select(*keys, "bucket", F.sum("n").over(own.orderBy("bucket")).alias("upto"), F.sum("n").over(own).alias("total"))
    at = lambda p: F.min(F.when(F.col("upto") >= F.floor((F.col("total") * p + 99) / 100), F.col("bucket")))
    found = upto.groupBy(*keys).agg(*[at(p).alias(k) for k, p in per_cent.items()])
    return found.select(*keys, *[middle(F.col(k)).alias(k) for k in per_cent])


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joined by ``keys``, null being a key as others are; each key comes once."""
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(named, same, how).drop(*[f"__{k}" for k in keys])


def exact(df: DataFrame, value: Column, keys: list[str], scale: float = 1, **shares: float) -> DataFrame:
    """(keys, one column for each name): the value at that share of the values in order that aren't null, in proportion between
    the two beside it (PERCENTILE_CONT). Buckets are those of the values times ``scale``; which ones they are makes no difference to the result."""
    v = df.select(*keys, value.cast("double").alias("v")).filter("v is not null")
    place = F.when(F.isnan("v"), F.lit(2**31 - 1)).otherwise(bucket(F.floor(F.col("v") * scale)))
    counts = v.groupBy(*keys, "v").agg(F.count("*").alias("n")).withColumn("bucket", place)
    own = Window.partitionBy(*keys)
    h = counts.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    h = h.select(*keys, "bucket", "n", (F.sum("n").over(own.orderBy("bucket")) - F.col("n")).alias("before"), F.sum("n").over(own).alias("total"))
    ends = []
    for name, share in shares.items():
        at = (F.col("total") - 1) * F.lit(float(share))
        ends += [F.struct(F.lit(f"{name} {end}").alias("end"), side(at).alias("at"), (at - F.floor(at)).alias("beyond")) for end, side in (("low", F.floor), ("high", F.ceil))]
    inside = lambda x: (x["at"] >= F.col("before")) & (x["at"] < F.col("before") + F.col("n"))
    wanted = h.select(*keys, "bucket", "before", F.explode(F.filter(F.array(*ends), inside)).alias("x"))
    sought = wanted.groupBy(*keys, "bucket").agg(F.collect_list(F.struct("x.end", (F.col("x.at") - F.col("before")).alias("at"), "x.beyond")).alias("sought"))
    c = null_safe(counts, sought, [*keys, "bucket"])
    upto = F.sum("n").over(Window.partitionBy(*keys, "bucket").orderBy("v"))
    c = c.select(*keys, "v", "n", "sought", upto.alias("upto"))
    met = c.select(*keys, "v", F.explode(F.filter("sought", lambda x: (x["at"] >= F.col("upto") - F.col("n")) & (x["at"] < F.col("upto")))).alias("x"))
    of = lambda end, c: F.max(F.when(F.col("x.end") == end, F.col(c)))
    found = met.groupBy(*keys).agg(*[f for k in shares for f in (of(f"{k} low", "v").alias(f"{k} low"), of(f"{k} high", "v").alias(f"{k} high"), of(f"{k} low", "x.beyond").alias(f"{k} beyond"))])
    between = lambda k: F.when(F.col(f"{k} beyond") == 0, F.col(f"{k} low")).otherwise(F.col(f"{k} low") * (1 - F.col(f"{k} beyond")) + F.col(f"{k} high") * F.col(f"{k} beyond"))
    return found.select(*keys, *[between(k).alias(k) for k in shares])
