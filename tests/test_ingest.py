"""Ingested payloads keep all their fields, and their export has typed attributes."""

import json

from pyspark.sql import functions as F

from assaywork.sources import ingest

SPANNED = {
    "trace_id": "ABCDEF01-2345-6789-abcd-ef0123456789", "agent_name": "a", "metadata": {"env": "test", "n": 3},
    "tool_calls": [{"tool_name": "search", "input": {"q": [1, "x"]}, "latency_ms": 12.5}, {"tool_name": "search", "error": "timeout"}],
    "token_usage": {"prompt_tokens": 3, "completion_tokens": 4, "total_tokens": 7},
    "spans": [
        {"span_id": "0123456789abcdef", "name": "root", "start_time": "2024-01-01T00:00:01Z", "end_time": "2024-01-01T00:00:02.5Z"},
        {"span_id": "0123456789", "parent_span_id": "0123456789abcdef", "name": "call", "kind": "LLM", "status_code": "ERROR", "status_message": "bad", "start_time": "2024-01-01T00:00:01Z",
         "attributes": {"s": "x", "b": True, "i": 3, "d": 1.5, "l": [1, "y"], "o": {"k": 2}, "none": None}, "events": [{"name": "e", "timestamp": "2024-01-01T00:00:01Z", "attributes": {"at": 1}}]}]}
PLAIN = {"trace_id": "not hex", "agent_name": "b", "output": "y" * 5000, "input": "", "cost_usd": 0.25, "latency_ms": 1500, "token_usage": {"total_tokens": 9}, "timestamp": "2024-02-01T00:00:00Z"}
BAD = [{"agent_name": ""}, {}, {"agent_name": "a", "spans": [{"name": "x"}]}, {"agent_name": "a", "spans": [{"name": "x", "start_time": "2024-01-01", "kind": "OTHER"}]}, {"agent_name": "a", "tool_calls": [{"error": "e"}]}]


def read(spark, rows):
    return ingest.ingest(spark.createDataFrame([(x if x is None or isinstance(x, str) else json.dumps(x),) for x in rows], "value string"), F.lit("2024-01-01 00:00:00").cast("timestamp"))


def exported(spark, row):
    [r] = ingest.otlp(read(spark, [row])[0]).collect()
    [resource] = json.loads(r["payload"])["resourceSpans"]
    assert resource["resource"]["attributes"] == [{"key": "service.name", "value": {"stringValue": "agents"}}]
    return resource["scopeSpans"][0]["spans"]


def test_whole_payload(spark):
    t, rejects = read(spark, [SPANNED, PLAIN, *BAD, "{broken", None])
    assert rejects.count() == len(BAD) + 2
    got = {r["agent_name"]: r for r in t.withColumn("env", F.try_variant_get(F.element_at("metadata", "env"), "$", "string")).drop("metadata", "spans").withColumn("tool_calls", F.transform("tool_calls", lambda c: F.struct(c["tool_name"], F.to_json(c["input"]), c["latency_ms"], c["error"]))).collect()}
    assert got["a"]["env"] == "test" and got["a"]["token_usage"]["total_tokens"] == 7
    assert [tuple(c) for c in got["a"]["tool_calls"]] == [("search", '{"q":[1,"x"]}', 12.5, None), ("search", None, None, "timeout")]
    assert got["b"]["tool_calls"] is None and str(got["b"]["ts"]) == "2024-02-01 00:00:00" and str(got["a"]["ts"]) == "2024-01-01 00:00:00"


def test_minted_ids_repeat(spark):
    row = {"agent_name": "a", "spans": [{"name": "x", "start_time": "2024-01-01"}, {"name": "x", "start_time": "2024-01-01"}]}
    one, two = (read(spark, [row])[0].select("trace_id", "spans.span_id").collect() for _ in range(2))
    assert one == two and len(set(one[0]["span_id"])) == 2


def test_exported_spans(spark):
    root, call = exported(spark, SPANNED)
    assert root["traceId"] == call["traceId"] == "abcdef0123456789abcdef0123456789"
    assert (root["spanId"], call["spanId"], call["parentSpanId"]) == ("0123456789abcdef", "0123456789000000", "0123456789abcdef")
    assert "parentSpanId" not in root and root["kind"] == call["kind"] == 1 and root["attributes"] == [] and root["events"] == []
    assert (root["startTimeUnixNano"], root["endTimeUnixNano"], call["endTimeUnixNano"]) == ("1704067201000000000", "1704067202500000000", "1704067201000000000")
    assert root["status"] == {"code": 0} and call["status"] == {"code": 2, "message": "bad"}
    assert {a["key"]: a["value"] for a in call["attributes"]} == {
        "s": {"stringValue": "x"}, "b": {"boolValue": True}, "i": {"intValue": "3"}, "d": {"doubleValue": 1.5}, "l": {"arrayValue": {"values": [{"intValue": "1"}, {"stringValue": "y"}]}},
        "o": {"kvlistValue": {"values": [{"key": "k", "value": {"intValue": "2"}}]}}, "none": {"stringValue": "null"}, "agent.span_kind": {"stringValue": "LLM"}}
    assert call["events"] == [{"timeUnixNano": "1704067201000000000", "name": "e", "attributes": [{"key": "at", "value": {"intValue": "1"}}]}]


def test_trace_without_spans(spark):
    [root] = exported(spark, PLAIN)
    assert root["name"] == "b" and root["endTimeUnixNano"] == "1706745601500000000" and len(root["traceId"]) == 32 and len(root["spanId"]) == 16
    assert {a["key"]: a["value"] for a in root["attributes"]} == {
        "agent.agent_name": {"stringValue": "b"}, "agent.output": {"stringValue": "y" * 4096 + "…"}, "agent.cost_usd": {"doubleValue": 0.25}, "agent.total_tokens": {"intValue": "9"}}


def test_export_reads_a_payload_once(spark):
    """The condition on payloads doesn't read them again for each field that it names."""
    lines = spark.createDataFrame([(json.dumps(SPANNED), 1)], "value string, n int").withColumn("value", F.concat("value", F.lit(" ")))
    traces, rejects = ingest.ingest(lines, F.lit(None).cast("timestamp"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(ingest.otlp(traces)).count("from_json(") == 1 and plan(rejects).count("from_json(") == 1
