"""Traces, spans and rule results kept as tables, with the evals and moments derived from them.

Tables are partitioned by the period of the trace (``unit``: a day where days are large, a month or quarter where they hold few rows) and
bucketed by tenant and trace. So what is derived for a period reads that period alone and joins without exchange, dashboards
prune to the periods that they show, and retention drops periods. Every write replaces whole periods at once; one that was
broken off is mended by running it again."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaywork.operators import derived

KEYS = ("tenant_id", "trace_id")
#: What goes with its trace, the traces last, so that removal can be run again; and what stays without it.
CASCADES, DETACHED = ("moments", "spans", "traces"), ("results", "evals")


def beside(rows: DataFrame, lost: DataFrame, how: str) -> DataFrame:
    """``rows`` joined with the lost traces of their periods. Keys are those of the buckets alone, as a join by the period too would
    shuffle both sides, so periods are compared as a condition beside."""
    named = lost.withColumnsRenamed({c: f"lost_{c}" for c in ("period", *KEYS)})
    same = F.datediff("period", "lost_period") == 0
    for k in KEYS:
        same = (F.col(k) == F.col(f"lost_{k}")) & same
    return rows.join(named, same, how)


@dataclass
class Store:
    """``root`` is a folder that driver and executors share. ``buckets`` follows the size of a period."""

    spark: SparkSession
    root: str
    unit: str = "day"
    buckets: int = 8
    name: str = field(default_factory=lambda: f"assay_{uuid.uuid4().hex}")

    def __post_init__(self) -> None:
        self.spark.sql(f"create database if not exists {self.name} location '{self.root}'")

    def has(self, table: str) -> bool:
        return self.spark.catalog.tableExists(f"{self.name}.{table}")

    def stored(self, table: str) -> DataFrame:
        return self.spark.table(f"{self.name}.{table}")

    def read(self, table: str) -> DataFrame:
        """The rows as they are now: those that lost their trace have a null trace_id."""
        rows = self.stored(table)
        if table in DETACHED:
            rows = rows.withColumn("trace_id", F.when(~F.col("detached"), F.col("trace_id"))).drop("detached")
        return rows

    def periods(self, table: str) -> set[date]:
        """The periods that hold rows: as many as there are days or months, whatever the rows."""
        return {date.fromisoformat(r[0].removeprefix("period=")) for r in self.spark.sql(f"show partitions {self.name}.{table}").collect()}

    def period(self, ts: Column) -> Column:
        return F.date_trunc(self.unit, ts).cast("date")

    def add_traces(self, traces: DataFrame) -> set[date]:
        """Adds traces, of (tenant_id, trace_id, ts, ...); the periods that they fall in. A null ts has the period of 1970."""
        return self._append("traces", traces.withColumn("period", F.coalesce(self.period(F.col("ts")), F.lit(date(1970, 1, 1)))))

    def add_parts(self, table: str, rows: DataFrame, own_time: str) -> set[date]:
        """Adds spans or results to the periods of their traces, however late they come; the periods touched. A row without a
        stored trace goes by its ``own_time``."""
        known = self.stored("traces").select(*KEYS, F.col("period").alias("of_trace"))
        rows = rows.join(known, list(KEYS), "left").withColumn("period", F.coalesce("of_trace", self.period(F.col(own_time)), F.lit(date(1970, 1, 1)))).drop("of_trace")
        return self._append(table, rows.withColumn("detached", F.lit(False)) if table in DETACHED else rows)

    def derive(self, periods: Iterable[date]) -> None:
        """Evals and moments of these periods, anew; all other periods' files stay as they are."""
        periods = sorted(periods)
        of = lambda table: self.stored(table).filter(F.col("period").isin(periods))
        if periods:
            self._replace("evals", derived.evals(of("results"), "period", "detached"), periods)
            live = lambda table: of(table).filter("not detached")
            self._replace("moments", derived.moments(of("traces"), live("results"), live("evals")), periods)

    def retain(self, since: datetime, tenant: str | None = None) -> int:
        """Removes the traces before ``since``, of one tenant or all; how many. Spans and moments go with them, evals and results
        stay without a trace. Periods wholly before it are dropped, not read; a second run finds nothing to do."""
        if tenant == "":
            raise ValueError("an empty tenant")
        start = self.spark.range(1).select(self.period(F.lit(since))).first()[0]
        gone = F.col("ts") < F.lit(since)
        gone = gone & (F.col("tenant_id") == tenant) if tenant else gone
        found = self.stored("traces").filter((F.col("period") <= start) & gone).groupBy("period").count().collect()
        touched = {r["period"] for r in found}
        if touched:
            self._remove(gone, touched, set() if tenant else {p for p in touched if p < start})
        return sum(r["count"] for r in found)

    def _remove(self, gone: Column, touched: set[date], whole: set[date]) -> None:
        """``whole`` periods go as they are; in the others, traces that are ``gone`` and what belongs to them."""
        of = lambda table, periods: self.stored(table).filter(F.col("period").isin(sorted(periods)))
        lost = of("traces", touched).filter(gone).select("period", *KEYS)
        for table in filter(self.has, DETACHED):
            rows = beside(of(table, touched), lost, "left")
            self._replace(table, rows.withColumn("detached", F.col("detached") | F.col("lost_period").isNotNull()), touched)
        for table in filter(self.has, CASCADES):
            cut = touched - whole
            if cut:
                self._replace(table, beside(of(table, cut), lost, "left_anti"), cut)
            self._drop(table, whole)

    def _create(self, table: str, rows: DataFrame) -> None:
        columns = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes if n != "period")
        self.spark.sql(f"create table if not exists {self.name}.{table} ({columns}, period date) using parquet partitioned by (period) "
                       f"clustered by ({', '.join(KEYS)}) sorted by ({', '.join(KEYS)}) into {self.buckets} buckets")

    def _append(self, table: str, rows: DataFrame) -> set[date]:
        """Adds rows to what their periods hold, rows that are alike in all columns once: a job that was broken off is run again.
        An empty table tells by its periods what came; else rows are read for that before."""
        self._create(table, rows)
        held = self.periods(table)
        if not held:
            self._replace(table, rows, set(), once=True)
            return self.periods(table)
        came = {r[0] for r in rows.select("period").distinct().collect()}
        before = self.stored(table).filter(F.col("period").isin(sorted(came)))
        self._replace(table, before.unionByName(rows) if came & held else rows, set(), once=True)
        return came

    def _replace(self, table: str, rows: DataFrame, empty: set[date] | list[date], once: bool = False) -> None:
        """Replaces the periods of ``rows``; of those that may be ``empty`` now, the ones without rows are dropped. ``once``: rows that
        are alike in all columns are written once, told apart in their bucket."""
        self._create(table, rows)
        rows = rows.select(self.stored(table).columns).repartition(self.buckets, *KEYS)
        rows = rows.distinct() if once else rows
        with self._by_period():
            rows.write.mode("overwrite").insertInto(f"{self.name}.{table}")
        if held := set(empty) & self.periods(table):
            left = self.stored(table).filter(F.col("period").isin(sorted(held))).select("period").distinct().collect()
            self._drop(table, held - {r[0] for r in left})

    def _drop(self, table: str, periods: set[date]) -> None:
        held = sorted(periods & self.periods(table))
        if held:
            self.spark.sql(f"alter table {self.name}.{table} drop if exists " + ", ".join(f"partition (period = date'{p}')" for p in held))

    @contextmanager
    def _by_period(self):
        """insertInto takes the mode from the session alone."""
        key = "spark.sql.sources.partitionOverwriteMode"
        was = self.spark.conf.get(key)
        self.spark.conf.set(key, "dynamic")
        try:
            yield
        finally:
            self.spark.conf.set(key, was)
