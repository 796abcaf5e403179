"""Streams with state of their own: runs assembled from callback events, and failures that are the first for a while."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from assaywork.sources import ingest

#: How late an event may come.
LATENESS = "10 minutes"
#: Columns of a callback event beside its run.
EVENT = ("ts", "step", "event", "name", "text", "prompt_tokens", "completion_tokens")
ENDS = ("chain_end", "chain_error")


def _micros(rows: pd.DataFrame) -> pd.Series:
    return rows["ts"].astype("datetime64[us]").astype("int64")


def assembled_runs(events: DataFrame, timeout: str = "30 minutes", redact=False, buckets: int = 1024) -> DataFrame:
    """The runs of a stream of callback events (run_id, agent_name and the columns of EVENT), as
    ``ingest.runs_of_callbacks`` has them. A run is emitted when its end or error comes, or when nothing of it has come
    for ``timeout`` of event time (closed: timeout); its state, the events so far, ends with it. Rows without a run or
    time are left out.

    Runs are dealt to ``buckets`` (as many for as long as a stream's state is kept), as a call of Python for each run costs far more than
    its events. A bucket's state is its open runs, and its timeout that of the first of them; events stay JSON text in Python."""
    wait = int(pd.Timedelta(timeout).total_seconds() * 1000)
    emitted = "run_id long, agent_name string, closed string, events string"

    def collect(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        # of each run: agent, latest event, time to give up, events
        held = {run: tuple(of) for run, *of in json.loads(state.get[0])} if state.exists else {}
        came: dict[int, list] = {}
        if not state.hasTimedOut:
            for rows in parts:
                for run, agent, ms, event, said in zip(*[rows[c].tolist() for c in ("run_id", "agent_name", "ms", "event", "said")]):
                    if (of := came.get(run)) is None:
                        of = came[run] = [None, ms, None, []]
                    if agent is not None and (of[0] is None or agent > of[0]):
                        of[0] = agent
                    if ms > of[1]:
                        of[1] = ms
                    if event in ENDS:
                        of[2] = "error" if event == "chain_error" or of[2] == "error" else "end"
                    of[3].append(said)
        out = []
        for run, (agent, latest, closed, said) in came.items():
            if run in held:
                was, before, _, text = held.pop(run)
                agent, latest, said = max((a for a in (agent, was) if a is not None), default=None), max(latest, before), [text, *said]
            text = ",".join(said)
            if closed:
                out.append((run, agent, closed, f"[{text}]"))
            else:
                held[run] = (agent, latest, max(now + 1, latest + wait), text)
        for run in [run for run, of in held.items() if of[2] < now]:
            agent, *_, text = held.pop(run)
            out.append((run, agent, "timeout", f"[{text}]"))
        if held:
            state.update((json.dumps([(run, *of) for run, of in held.items()]),))
            state.setTimeoutTimestamp(max(now, min(of[2] for of in held.values())))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["run_id", "agent_name", "closed", "events"])

    said = F.to_json(F.struct(F.unix_micros("ts").alias("ts"), *[F.col(c) for c in EVENT[1:]]))
    kept = events.filter("run_id is not null and ts is not null").withWatermark("ts", LATENESS)
    dealt = kept.select(F.pmod(F.xxhash64("run_id"), F.lit(buckets)).alias("bucket"), "run_id", "agent_name", "ts", F.unix_millis("ts").alias("ms"), "event", said.alias("said"))
    out = dealt.groupBy("bucket").applyInPandasWithState(collect, emitted, "open string", "append", GroupStateTimeout.EventTimeTimeout)
    element = "struct<ts:long,step:long,event:string,name:string,text:string,prompt_tokens:long,completion_tokens:long>"
    return ingest.assembled(out.withColumn("events", F.from_json("events", f"array<{element}>")), redact)


def first_failures(failures: DataFrame, ttl: str = "2 days", keys: tuple[str, ...] = ("tenant_id", "agent_name", "rule_name")) -> DataFrame:
    """Of a stream of failures (keys, trace_id, ts): those before which the same keys had none for ``ttl``. State is the last
    failure's time of each key; it ends when the watermark has passed that by ``ttl``, so only keys of the last while
    are held. Rows that come out of order within the lateness count from the latest seen."""
    span = int(pd.Timedelta(ttl).total_seconds() * 1_000_000)
    columns = [*keys, "trace_id", "micros"]

    def pick(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts))
        rows = rows.assign(micros=_micros(rows)).sort_values(["micros", "trace_id"], kind="stable")
        last, out = state.get[0] if state.exists else None, []
        for trace, at in zip(rows["trace_id"].tolist(), rows["micros"].tolist()):
            if last is None or at - last > span:
                out.append((*key, trace, at))
            last = at if last is None else max(last, at)
        state.update((last,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (last + span) // 1000 + 1))
        yield pd.DataFrame(out, columns=columns)

    kept = failures.filter("ts is not null").withWatermark("ts", LATENESS)
    schema = ", ".join([*[f"{k} string" for k in keys], "trace_id long", "micros long"])
    out = kept.groupBy(*keys).applyInPandasWithState(pick, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(*keys, "trace_id", F.timestamp_micros("micros").alias("ts"))
