"""Span trees and clusters of markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_KEY = ("tenant_id", "trace_id")


def _jumped(nodes: Column, join: list[str]) -> Column:
    """Pointer jumping over an array of structs with ``up``: the place of the node above from 1 (0: none, -1: absent).
    In each step a node takes over what the node it points to has gathered (``join``: names of columns that are
    added up or put in front) and points where that one points, so the steps are log2 of the nodes."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(nodes), F.lit(1)).cast("double"))).cast("int"))

    def jump(acc: Column, _: Column) -> Column:
        def one(x: Column) -> Column:
            above = F.get(acc, x["up"] - 1)
            taken = [F.concat(above[c], x[c]).alias(c) if c == "path" else (above[c] + x[c]).alias(c) for c in join]
            return F.when(x["up"] > 0, F.struct(above["up"].alias("up"), *taken)).otherwise(F.struct(x["up"].alias("up"), *[x[c].alias(c) for c in join]))

        return F.transform(acc, one)

    return F.aggregate(steps, nodes, jump)


def tree(spans: DataFrame) -> DataFrame:
    """tenant_id, trace_id, span_no, depth, place: depth and pre-order place of each span; siblings by start, then
    number. Spans below an absent parent, and those of a cycle or below one, are dropped; a trace without any root is
    listed flat.

    One exchange, by trace: the parent's place in start order is the last one seen among the trace's numbers in order.
    A trace's spans are one array; memory grows with the sum of their depths."""
    trace = Window.partitionBy(*_KEY)
    numbered = spans.select(*_KEY, "span_no", "parent_no", F.row_number().over(trace.orderBy("start_time", "span_no")).alias("at"))
    sides = numbered.withColumn("asks", F.explode(F.array(F.lit(0), F.lit(1))))
    sides = sides.withColumn("no", F.when(F.col("asks") == 0, F.col("span_no")).otherwise(F.col("parent_no")))
    seen = F.last(F.when(F.col("asks") == 0, F.struct("span_no", "at")), ignorenulls=True).over(trace.orderBy("no", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    up = F.when(F.col("parent_no").isNull(), 0).when(F.col("seen.span_no") == F.col("parent_no"), F.col("seen.at")).otherwise(-1)
    asked = sides.withColumn("seen", seen).filter("asks = 1").select(*_KEY, F.struct("at", "span_no", F.coalesce(up, F.lit(-1)).alias("up")).alias("s"))
    own = asked.groupBy(*_KEY).agg(F.array_sort(F.collect_list("s")).alias("s"))
    # first which spans hang on a root and how deep; then, of those alone, the path of places
    own = own.withColumn("d", _jumped(F.transform("s", lambda x: F.struct(x["up"].alias("up"), F.when(x["up"] > 0, 1).otherwise(0).alias("depth"))), ["depth"]))
    step = F.transform(F.arrays_zip("s", "d"), lambda x: F.struct(F.when(x["d"]["up"] == 0, x["s"]["up"]).otherwise(-1).alias("up"), F.lpad(x["s"]["at"].cast("string"), 8, "0").alias("path")))
    own = own.withColumn("p", _jumped(step, ["path"]))
    placed = F.transform(F.arrays_zip("s", "d", "p"), lambda x: F.when(x["d"]["up"] == 0, F.struct(x["p"]["path"].alias("path"), x["s"]["span_no"].alias("span_no"), x["d"]["depth"].alias("depth"))))
    placed = F.array_sort(F.filter(placed, lambda x: x.isNotNull()))
    flat = F.transform("s", lambda x: F.struct(F.lit("").alias("path"), x["span_no"].alias("span_no"), F.lit(0).alias("depth")))
    rooted = F.exists("s", lambda x: x["up"] == 0)
    rows = own.select(*_KEY, F.posexplode(F.when(rooted, placed).otherwise(flat)).alias("place", "x"))
    return rows.select(*_KEY, "x.span_no", "x.depth", "place")


def rollup(spans: DataFrame) -> DataFrame:
    """Per trace: spans, errors, calls of models and tools, seconds from the first start to the last end, and the
    greatest depth of its tree."""
    counts = spans.groupBy(*_KEY).agg(
        F.count("*").alias("spans"), F.count_if(F.col("status_code") == "ERROR").alias("errors"), F.count_if(F.col("kind") == "LLM").alias("llm"), F.count_if(F.col("kind") == "TOOL").alias("tool"),
        (F.unix_timestamp(F.max("end_time")) - F.unix_timestamp(F.min("start_time"))).alias("duration_s"))
    return counts.join(tree(spans).groupBy(*_KEY).agg(F.max("depth").alias("max_depth")), list(_KEY), "left")


def marker_clusters(at: Column, width: Column) -> Column:
    """Greedy clusters of sorted positions: one joins while within ``width`` of its cluster's first.
    array<struct<first,n>>."""
    none = F.array().cast("array<struct<first:long,n:int>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["first"].alias("first"), (last["n"] + 1).alias("n"))))
        return F.when((F.size(acc) > 0) & (x - F.try_element_at(acc, F.lit(-1))["first"] <= width), joined).otherwise(F.concat(acc, F.array(F.struct(x.alias("first"), F.lit(1).alias("n")))))

    return F.aggregate(F.array_sort(at), none, step)
