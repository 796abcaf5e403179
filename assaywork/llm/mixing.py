"""Mixing sources to target weights by weighted sampling without replacement.

Every document gets an Efraimidis-Spirakis key: an exponential variate, made from a digest of its
id, source and text, divided by its quality weight. Within a source documents are taken by ascending key until the
source's token budget is met. Whole epochs come first: a budget of 1.3 source sizes is one copy of
each document, then the keyed order for the remaining 0.3.

No source is sorted as a whole. A monotone map of the key cuts a source into buckets in key order; bucket sums, prefix-summed per source, show the one bucket in which the budget ends. All
documents of earlier buckets are taken, none of later ones, and only that bucket is sorted. So a
source that holds a third of all rows costs a partial aggregation, not one large task.

Only DataFrame functions are used. Defined results: a null or empty text has size 0 and is taken 0
words; a null source is a source of its own, last in order; rows of one id, or without one, are told apart by
their texts; equal keys go by that digest, so reruns agree; rows that are alike in all three are separate documents, and which
of them the cut meets makes no difference; very long texts are counted whole; an empty table gives an empty result; other
columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaywork.llm.common import stage, stage_measured, table

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: All targets together, as a share of all sizes.
SHARE = 1.5
#: No target is above this many times its source's size.
MOST = 2.0
#: Documents of a bucket of the key's range, about, and buckets of a source at least.
BUCKET, BUCKETS = 20_000, 4096
_MARKS = "0123456789!\"#$%&'()*+/:;<=>?@[\\]^_`{|}~ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """Quality weight in [0.1, 1]: the share of characters other than digits, symbols and capitals,
    which are rare in running prose."""
    kept = F.length(F.translate(text, _MARKS, ""))
    return F.greatest(F.lit(0.1), F.coalesce(kept / F.nullif(F.length(text), F.lit(0)), F.lit(0.1)))


def uniform(seed: int, *columns: Column | str) -> Column:
    """A number in (0, 1) from the digest of the columns."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("null")) for c in columns])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def row_key() -> Column:
    """A digest of id, source and text: what rows that are alike in these share."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ("doc_id", "source", "text")]
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def keyed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, source, row_key, size, key of every document. No text leaves this step."""
    sized = docs.select("doc_id", "source", row_key().alias("row_key"), word_count(F.col("text")).alias("size"), quality(F.col("text")).alias("weight"))
    return sized.withColumn("key", _key(seed)).drop("weight")


def _key(seed: int) -> Column:
    return -F.log(uniform(seed, "row_key")) / F.col("weight")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """From (source, source_size): the target of each source. Those that reach ``most`` times their
    size stop there, and the excess goes to the others by weight until none is above.

    The stop order is that of most * size / weight, so one pass of running sums finds it: a source
    is stopped if, with all before it stopped, its share of the rest is still above its stop.
    This table has a row per source."""
    n = len(weights)
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % n + 1).cast("int"))
    d = sizes.withColumn("w", w).withColumn("stop", F.lit(most) * F.col("source_size"))
    before = Window.orderBy(F.col("stop") / F.col("w"), F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    d = d.withColumns({
        "total": F.lit(share) * F.sum("source_size").over(whole),
        "stopped": F.coalesce(F.sum("stop").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open_w": F.sum("w").over(before.rowsBetween(0, Window.unboundedFollowing)),
    })
    d = d.withColumn("stops", F.col("w") * (F.col("total") - F.col("stopped")) / F.col("open_w") >= F.col("stop"))
    d = d.withColumns({
        "left": F.col("total") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("stop"))).over(whole), F.lit(0.0)),
        "left_w": F.sum(F.when(~F.col("stops"), F.col("w"))).over(whole),
    })
    return d.select("source", "source_size", F.when(F.col("stops"), F.col("stop")).otherwise(F.col("w") * F.col("left") / F.col("left_w")).alias("target"))


def mix(docs: DataFrame, seed: int = 7, buckets: int = BUCKETS, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, source, row_key, key, size, source_size, target, epochs, taken: the words the mix takes from each document,
    repeats counted. The document in which a budget ends gives only the words up to it.

    ``docs`` needs doc_id, text and source; further columns play no part."""
    k, seen = stage_measured(keyed(docs, seed), n=F.count(F.lit(1)))
    buckets = max(buckets, math.ceil(seen["n"] / BUCKET))
    bucket = F.floor(F.col("key") / (F.col("key") + 1) * buckets).cast("int")  # monotone in the key
    k = k.withColumn("bucket", F.least(bucket, F.lit(buckets - 1)))
    per_bucket = k.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    per_source = per_bucket.groupBy("source").agg(F.sum("words").alias("source_size"))
    t = targets(per_source, weights, share, most)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    # rounding could lift a stopped target a hair under its multiple; the whole epochs then absorb it
    t = t.withColumn("epochs", full.cast("long")).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    order = Window.partitionBy("source").orderBy("bucket")
    b = per_bucket.withColumn("before", F.sum("words").over(order) - F.col("words"))
    b = b.join(t, b["source"].eqNullSafe(t["source"])).select(
        b["source"].alias("b_source"), b["bucket"].alias("b_bucket"), "before", "words", "source_size", "target", "epochs", "rest")
    d = k.join(b, k["source"].eqNullSafe(b["b_source"]) & (k["bucket"] == b["b_bucket"])).drop("b_source", "b_bucket")
    ends = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest"))
    same = ["doc_id", "source", "row_key", "key", "size", "source_size", "target", "epochs"]
    outside = d.filter(~ends).select(*same, (F.col("epochs") * F.col("size") + F.when(F.col("before") + F.col("words") <= F.col("rest"), F.col("size")).otherwise(0)).alias("taken"))
    inside = Window.partitionBy("source").orderBy("key", "row_key")
    cut = d.filter(ends).withColumn("ahead", F.col("before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("rest") - F.col("ahead")))
    return outside.unionByName(cut.select(*same, (F.col("epochs") * F.col("size") + part).alias("taken")))


def mixed_rows(docs: DataFrame, mixture: DataFrame, seed: int = 7) -> DataFrame:
    """The rows of ``docs`` as often as the mixture (``mix`` with the same seed) takes them, the last time cut to the words
    left; n_chars follows the cut. Rows taken 0 words go. Rows that are alike in id, source and text are numbered
    and share out what was taken of them, the most first.

    Texts stay where they are: by its key and the place in the order of keys at which its source's budget ends, each row
    tells how often it is taken. Only the rows at that place, one of each source or those alike to it, are gathered."""
    m = stage(mixture.filter("size > 0").select("source", "row_key", "key", "size", "epochs", "taken"))
    extra = F.col("taken") > F.col("epochs") * F.col("size")
    ends = stage(m.groupBy(F.col("source").alias("of_source")).agg(F.max("epochs").alias("epochs"), F.max(F.when(extra, F.struct("key", "row_key"))).alias("end")))  # a row a source
    # a source has whole epochs, with or without one more, and one cut: three values at most
    last = m.join(ends.select("of_source", "end"), F.col("source").eqNullSafe(F.col("of_source"))).filter(F.col("row_key") == F.col("end.row_key"))
    last = last.groupBy(F.col("row_key").alias("end_key"), "size", "taken").agg(F.count("*").alias("n")).groupBy("end_key", "size").agg(F.sort_array(F.collect_list(F.struct("taken", "n")), False).alias("shares"))
    d = docs.select(row_key().alias("row_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.col("row")["text"]
    d = d.filter(text.rlike(WORD)).join(ends, F.col("row")["source"].eqNullSafe(F.col("of_source")))
    at_end = F.coalesce(F.col("row_key") == F.col("end.row_key"), F.lit(False))

    whole = d.filter(~at_end).withColumn("weight", quality(text)).withColumn("key", _key(seed))
    before = F.coalesce(F.struct("key", "row_key") < F.col("end"), F.lit(False)).cast("long")
    whole = whole.withColumn("times", F.col("epochs") + before).filter("times > 0")
    whole = whole.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row", text.alias("mixed"))

    part = d.filter(at_end).withColumn("number", F.row_number().over(Window.partitionBy("row_key").orderBy("row_key"))).join(last, F.col("row_key") == F.col("end_key"))
    start = F.struct(F.col("number").cast("long").alias("left"), F.lit(0).cast("long").alias("taken"))
    step = lambda a, x: F.struct((a["left"] - x["n"]).alias("left"), F.when((a["left"] > 0) & (a["left"] <= x["n"]), x["taken"]).otherwise(a["taken"]).alias("taken"))
    part = part.withColumn("taken", F.aggregate("shares", start, step)["taken"]).filter("taken > 0")
    part = part.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("size")))))
    left = F.least(F.col("size"), F.col("taken") - F.col("copy") * F.col("size"))
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0)), 1, left.cast("int")), "")
    part = part.select("row", F.when(left < F.col("size"), cut).otherwise(text).alias("mixed"))

    made = {"text": F.col("mixed"), "n_chars": F.length("mixed").cast("long")}
    return whole.unionAll(part).select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source")


QUERIES = {"op3_mixing": op3_mixing}
ORACLES = {
    "op3_mixing": r"""
with k as (
  select doc_id, source, row_key, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
    -ln((cast(concat('0x', substr(md5(concat('7|', row_key)), 1, 13)) as bigint) + 0.5e0) / 4503599627370496e0)
      / greatest(0.1e0, coalesce(length(translate(text, '@MARKS@', '')) / cast(nullif(length(text), 0) as double), 0.1e0)) as key
  from (select *, md5(concat_ws('|', coalesce('=' || cast(doc_id as varchar), '-'), coalesce('=' || source, '-'), coalesce('=' || text, '-'))) as row_key from documents) d
), s as (
  select source, source_size, 2e0 * source_size as stop, 1.5e0 * sum(source_size) over () as total,
    case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 5e0 when 1 then 2e0 else 1e0 end as w
  from (select source, sum(size) as source_size from k group by source)
), t as (
  select *, w * (total - coalesce(sum(stop) over (order by stop / w, source nulls last rows between unbounded preceding and 1 preceding), 0e0))
    / sum(w) over (order by stop / w, source nulls last rows between current row and unbounded following) >= stop as stops
  from s
), g as (
  select source, cast(source_size as bigint) as source_size, case when stops then stop
    else w * (total - coalesce(sum(case when stops then stop end) over (), 0e0)) / sum(case when not stops then w end) over () end as target
  from t
), e as (
  select *, cast(case when source_size > 0 then floor(target / source_size) else 0 end as bigint) as epochs from g
), a as (
  select k.doc_id, k.size, k.source, e.source_size, e.target, e.epochs, cast(round(e.target - e.epochs * e.source_size) as bigint) as rest,
    sum(k.size) over (partition by k.source order by k.key, k.row_key) - k.size as ahead
  from k join e on e.source is not distinct from k.source
)
select doc_id, size, source_size, target, cast(epochs * size + least(size, greatest(0, rest - ahead)) as bigint) as taken, source from a
""".replace("@MARKS@", _MARKS.replace("'", "''")),
}
