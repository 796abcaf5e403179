"""Structured Streaming jobs over trace events. ``run_to_end`` drives one over what is there now."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaywork.operators import rules
from assaywork.sources.views import VIEWS, render

#: How late an event may come; later ones are for batch re-aggregation.
LATENESS = "2 hours"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of traces."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    return raw.select(
        F.col("event_id").alias("trace_id"), F.concat(F.lit("agent-"), (F.col("user_id") % 20).cast("string")).alias("agent_name"), "event_type", F.col("ts").cast("timestamp").alias("ts"),
        (F.col("value") / 1000).alias("cost_usd"), (F.col("event_type") == "error").alias("failed"),
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant_id"), F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.when(F.col("event_type") == "error", 0.25).otherwise(F.pmod("event_id", F.lit(100)) / 100).alias("score"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as a stream of outputs with what is known of each."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*").createOrReplaceTempView("arriving_documents")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").createOrReplaceTempView("benchmark")
    return spark.sql(render(VIEWS["text_traces"].replace("from documents d", "from arriving_documents d"), "spark"))


def stream_score(outputs: DataFrame) -> DataFrame:
    """Stateless: the evals of each output as it comes, by the rules that score a batch."""
    return rules.evaluate(outputs).select("tenant_id", "trace_id", "eval_type", "score", "passed")


def stream_trend(traces: DataFrame, width: str = "6 hours") -> DataFrame:
    """Count, passes and mean score (in thousandths added up as whole numbers) of each tumbling window: an hour, six, a day."""
    w = traces.withWatermark("ts", LATENESS).groupBy(F.window("ts", width))
    score = F.sum(F.round(F.col("score") * 1000).cast("long")) / F.count("score") / 1000
    return w.agg(F.count("*").alias("traces"), F.count_if(~F.col("failed")).alias("passed"), score.alias("score")).select(F.col("window.start").alias("start"), "traces", "passed", (F.floor(F.col("score") * 1000 + 0.5) / 1000).alias("avg_score"))


def stream_pulse(traces: DataFrame) -> DataFrame:
    """Passes of the last 24 hours, each hour."""
    w = traces.withWatermark("ts", LATENESS).groupBy(F.window("ts", "24 hours", "1 hour"))
    return w.agg(F.count("*").alias("traces"), F.count_if(~F.col("failed")).alias("passed")).select(F.col("window.end").alias("end"), "traces", "passed")


def stream_cost_alert(traces: DataFrame, budget: float = 0.5) -> DataFrame:
    """Agents and days whose cost is above the budget."""
    w = traces.withWatermark("ts", LATENESS).groupBy("agent_name", F.window("ts", "1 day"))
    return w.agg(F.sum(F.round(F.col("cost_usd") * 1000000).cast("long")).alias("micro_usd")).filter(F.col("micro_usd") > budget * 1000000).select("agent_name", F.col("window.start").alias("start"), "micro_usd")


def stream_dedupe(traces: DataFrame) -> DataFrame:
    """Retried payloads once each, within the watermark. A retry has an id of its own, so equal content tells it."""
    content = ["agent_name", "event_type", "ts", "cost_usd", "failed", "k"]
    return traces.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(content).select(*content[:2], "cost_usd")


def with_retries(traces: DataFrame) -> DataFrame:
    """The traces, every fifth sent again with another id."""
    again = F.when(F.col("trace_id") % 5 == 0, F.array(F.col("trace_id"), F.col("trace_id") + 1_000_000_000)).otherwise(F.array("trace_id"))
    return traces.withColumn("trace_id", F.explode(again))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; a local one only where the master is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir isn't set")
        shared = "file://" + tempfile.mkdtemp(prefix="spark-assay-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote. In complete mode each batch
    replaces the result, else it has a folder of its own, which a repeated batch writes again; state
    and output are in the shared folder."""
    spark = stream.sparkSession
    root = shared_folder(spark, "stream")
    out = f"{root}/out"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch-{number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out)


def append_to(stream: DataFrame, root: str) -> DataFrame:
    """Runs a stream over what has come since it ran last with the same ``root``; all that it has put out so far. A repeated batch
    replaces its own."""
    out = f"{root}/out"
    put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch-{number}")
    stream.writeStream.outputMode("append").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(out)


def trend_with_late(arriving: DataFrame, root: str, width: str = "6 hours") -> DataFrame:
    """(start, traces, passed, late) of each tumbling window over all that has arrived so far, rows beyond the
    lateness included: a batch writes its windows' partial counts, those of late rows to a side path
    (late=true), and re-aggregation adds up both. A row is late if it is older by more than LATENESS
    than the newest of the batches before. Run again with the same ``root``, it goes on where it ended;
    a repeated batch replaces its own partials. Rows without a time count in no window."""
    spark = arriving.sparkSession
    partials = "start timestamp, traces long, passed long, newest timestamp, late boolean, batch long"
    out = f"{root}/partials"
    spark.createDataFrame([], partials).write.mode("append").partitionBy("batch", "late").parquet(out)
    read = lambda: spark.read.schema(partials).parquet(out)

    def put(batch: DataFrame, number: int) -> None:
        newest = read().filter(F.col("batch") < number).agg(F.max("newest")).first()[0]
        late = F.coalesce(F.col("ts") < F.lit(newest).cast("timestamp") - F.expr(f"interval {LATENESS}"), F.lit(False))
        w = batch.filter(F.col("ts").isNotNull()).groupBy(F.window("ts", width).alias("w"), late.alias("late"))
        counts = w.agg(F.count("*").alias("traces"), F.count_if(~F.col("failed")).alias("passed"), F.max("ts").alias("newest"))
        counts.select(F.col("w.start").alias("start"), "traces", "passed", "newest", "late").write.mode("overwrite").partitionBy("late").parquet(f"{out}/batch={number}")

    arriving.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return read().groupBy("start").agg(F.sum("traces").alias("traces"), F.sum("passed").alias("passed"), F.sum(F.when(F.col("late"), F.col("traces")).otherwise(0)).alias("late"))


def late_arrivals(spark: SparkSession, sf_dir: str, slices: int = 4) -> DataFrame:
    """The events in ``slices`` arrivals, dealt by event_id, each of which is all over the time range, so that most rows
    but the first arrival's are late. The stream is stopped after each and resumed for the next."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"))
    root = shared_folder(spark, "late")
    for k in range(slices):
        events.filter(F.pmod("event_id", F.lit(slices)) == k).write.mode("append").parquet(f"{root}/arrivals")
        windows = trend_with_late(spark.readStream.schema(events.schema).parquet(f"{root}/arrivals"), root)
    return windows
