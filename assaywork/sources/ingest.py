"""Reading payloads and logs, and writing exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATTRIBUTES = "map<string,variant>"
SPAN = f"struct<span_id:string,parent_span_id:string,name:string,kind:string,status_code:string,status_message:string,start_time:string,end_time:string,attributes:{ATTRIBUTES},events:array<struct<name:string,timestamp:string,attributes:{ATTRIBUTES}>>>"
TOOL_CALL = "struct<tool_name:string,input:variant,output:variant,latency_ms:double,error:string>"
PAYLOAD = f"""trace_id string, tenant_id string, agent_name string, framework string, input string, output string, tool_calls array<{TOOL_CALL}>, latency_ms double,
  token_usage struct<prompt_tokens:double,completion_tokens:double,total_tokens:double>, cost_usd double, metadata {ATTRIBUTES}, timestamp string, spans array<{SPAN}>"""
KINDS = ("INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER", "LLM", "TOOL")
STATUSES = ("UNSET", "OK", "ERROR")
AUDIT = "ts string, tenantId string, action string, user string, ruleId string, ruleName string, details map<string,string>"
ACTIONS = ("rule.deploy", "rule.delete", "rule.toggle", "rule.update")


def ingest(lines: DataFrame, now: Column, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(traces, rejects) of payload lines. An agent name is required, of each span a name, a start and a
    known kind and status, of each tool call a name; kind, status, tenant and time have defaults; a
    missing id is a digest of the payload, so that a second run mints the same. Values of metadata and
    attributes keep their JSON types."""
    # a generated row, as a condition on a projection would be moved below it and read the payload again for each field that it names
    read = lines.select(F.col(column), F.explode(F.array(F.from_json(column, PAYLOAD))).alias("p"))
    among = lambda c, known: c.isNull() | c.isin(*known)
    whole = F.forall("p.spans", lambda s: s["name"].isNotNull() & s["start_time"].isNotNull() & among(s["kind"], KINDS) & among(s["status_code"], STATUSES))
    called = F.forall("p.tool_calls", lambda c: c["tool_name"].isNotNull())
    good = F.coalesce((F.col("p.agent_name") != "") & F.coalesce(whole, F.col("p.spans").isNull()) & F.coalesce(called, F.col("p.tool_calls").isNull()), F.lit(False))
    minted = F.md5(F.col(column).cast("binary"))
    trace_id = F.coalesce("p.trace_id", minted)
    spans = F.transform("p.spans", lambda s, i: F.struct(
        F.coalesce(s["span_id"], F.substring(F.md5(F.concat_ws("/", minted, i.cast("string")).cast("binary")), 1, 16)).alias("span_id"), s["parent_span_id"].alias("parent_span_id"), trace_id.alias("trace_id"), s["name"].alias("name"),
        F.coalesce(s["kind"], F.lit("INTERNAL")).alias("kind"), F.coalesce(s["status_code"], F.lit("UNSET")).alias("status_code"), s["status_message"].alias("status_message"),
        F.try_to_timestamp(s["start_time"]).alias("start_time"), F.try_to_timestamp(s["end_time"]).alias("end_time"), s["attributes"].alias("attributes"), s["events"].alias("events")))
    traces = read.filter(good).select(
        trace_id.alias("trace_id"), F.coalesce("p.tenant_id", F.lit("local")).alias("tenant_id"), "p.agent_name", "p.framework", "p.input", "p.output", "p.tool_calls", "p.latency_ms", "p.token_usage", "p.cost_usd", "p.metadata",
        F.coalesce(F.try_to_timestamp(F.col("p.timestamp")), now).alias("ts"), spans.alias("spans"))
    return traces, read.filter(~good).select(column)


def explode_tool_calls(traces: DataFrame) -> DataFrame:
    return traces.select("tenant_id", "trace_id", F.inline("tool_calls"))


def explode_spans(traces: DataFrame) -> DataFrame:
    return traces.select("tenant_id", F.inline("spans"))


def read_audit(lines: DataFrame, column: str = "value") -> DataFrame:
    """Entries of audit lines; lines that aren't valid are dropped; a missing tenant is ``local``."""
    a = lines.select(F.from_json(column, AUDIT).alias("a")).select("a.*")
    required = F.col("action").isin(*ACTIONS)
    for c in ("ts", "user", "ruleId"):
        required &= F.col(c).isNotNull()
    return a.filter(F.coalesce(required, F.lit(False))).withColumn("tenantId", F.coalesce("tenantId", F.lit("local")))


def audit_csv(entries: DataFrame) -> DataFrame:
    """(line): all fields quoted, quotes doubled, details flattened as ``k=v · k=v``."""
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("details")), lambda e: F.concat_ws("=", e["key"], e["value"])), " · ")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    fields = [F.col(c) for c in ("ts", "tenantId", "action", "user", "ruleId", "ruleName")] + [flat]
    return entries.select(F.concat_ws(",", *[quoted(c) for c in fields]).alias("line"))


def assembled(runs: DataFrame, redact: Column | bool = False) -> DataFrame:
    """run_id, agent_name, closed, input, output, error, latency_ms, prompt_tokens, completion_tokens, cost_usd, tool_calls
    (tool_name, input, output, duration_ms, status) and spans (name, kind, duration_ms, status) of runs (run_id, agent_name,
    closed, events: array of ts in microseconds, step, event, name, text, prompt_tokens, completion_tokens).

    Steps are paired by their number, start with end. Tokens are those of the model's answers. A call of a tool counts once it
    has ended; a span without a duration of its own lasts to the run's end. A run that ended in an error has its text as
    output, and neither tokens, cost nor calls. ``redact``: hides input and output."""
    redact = F.lit(redact) if isinstance(redact, bool) else redact
    order = lambda e: F.struct(*[e[c].alias(c) for c in ("ts", "step", "event", "name", "text", "prompt_tokens", "completion_tokens")])
    r = runs.withColumn("e", F.array_sort(F.transform("events", order)))
    of = lambda *names: F.filter("e", lambda x: x["event"].isin(*names))
    ms = lambda micros: micros / 1000
    r = r.withColumns({"start": F.coalesce(F.get(of("chain_start"), F.lit(0))["ts"], F.get("e", F.lit(0))["ts"]), "last": F.coalesce(F.get(of("chain_end", "chain_error"), F.lit(0))["ts"], F.element_at("e", -1)["ts"])})
    other = lambda x, name: F.get(F.filter("e", lambda y: (y["event"] == name) & (y["step"] == x["step"])), F.lit(0))
    calls = F.transform(F.filter(of("tool_end"), lambda x: other(x, "tool_start").isNotNull()), lambda x: F.struct(
        F.coalesce(other(x, "tool_start")["name"], F.lit("unknown_tool")).alias("tool_name"), other(x, "tool_start")["text"].alias("input"), x["text"].alias("output"), ms(x["ts"] - other(x, "tool_start")["ts"]).alias("duration_ms"), F.lit("success").alias("status")))
    spans = F.transform(of("llm_start", "tool_start"), lambda x: F.struct(
        F.when(x["event"] == "llm_start", "llm_call").otherwise(F.coalesce(x["name"], F.lit("unknown_tool"))).alias("name"), F.when(x["event"] == "llm_start", "llm").otherwise("tool").alias("kind"),
        ms(F.coalesce(F.when(x["event"] == "llm_start", F.nullif(other(x, "llm_end")["ts"] - x["ts"], F.lit(0).cast("long"))), F.col("last") - x["ts"])).alias("duration_ms"), F.lit("ok").alias("status")))
    tokens = lambda c: F.aggregate(of("llm_end"), F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(x[c].cast("long"), F.lit(0).cast("long")))
    error = F.get(of("chain_error"), F.lit(0))["text"]
    failed = F.col("closed") == "error"
    made = r.select(
        "run_id", "agent_name", "closed", F.when(redact, "[redacted]").otherwise(F.get(of("chain_start"), F.lit(0))["text"]).alias("input"),
        F.when(failed, F.concat(F.lit("ERROR: "), F.coalesce(error, F.lit("")))).when(redact, "[redacted]").otherwise(F.get(of("chain_end"), F.lit(0))["text"]).alias("output"), F.when(failed, error).alias("error"),
        ms(F.col("last") - F.col("start")).alias("latency_ms"), *[F.when(~failed, tokens(c)).alias(c) for c in ("prompt_tokens", "completion_tokens")],
        F.when(~failed, calls).alias("tool_calls"), spans.alias("spans"))
    cost = F.col("prompt_tokens") * 0.000015 + F.col("completion_tokens") * 0.00006
    return made.withColumn("cost_usd", F.floor(cost * 10000 + 0.5) / 10000)


def runs_of_callbacks(events: DataFrame, redact: Column | bool = False) -> DataFrame:
    """``assembled`` of callback events (run_id, agent_name, ts, step, event, name, text, prompt_tokens, completion_tokens); a run
    that has neither an end nor an error has timed out. A run's events are one array."""
    has = lambda name: F.count_if(F.col("event") == name) > 0
    event = F.struct(F.unix_micros("ts").alias("ts"), F.col("step").cast("long").alias("step"), "event", "name", "text", F.col("prompt_tokens").cast("long").alias("prompt_tokens"), F.col("completion_tokens").cast("long").alias("completion_tokens"))
    kept = events.filter("run_id is not null and ts is not null").groupBy("run_id")
    return assembled(kept.agg(F.max("agent_name").alias("agent_name"), F.when(has("chain_error"), "error").when(has("chain_end"), "end").otherwise("timeout").alias("closed"), F.collect_list(event).alias("events")), redact)


def typed(entries: Column, depth: int = 2) -> Column:
    """Attributes (key, value) as the export has them: values by their JSON type, arrays and objects ``depth`` deep and as JSON text below.
    The type is read once for each value."""
    known = lambda values, *more: F.transform(values, lambda v: F.struct(F.schema_of_variant(v["value"] if more else v).alias("kind"), (v["value"] if more else v).alias("value"), *[v[c].alias(c) for c in more]))
    return F.transform(known(entries, "key"), lambda e: F.struct(e["key"].alias("key"), _typed(e["value"], e["kind"], depth, known).alias("value")))


def _typed(value: Column, kind: Column, depth: int, known) -> Column:
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).when(kind == "VOID", "null")
    number = F.try_variant_get(value, "$", "double")
    is_array, is_object, names = kind.startswith("ARRAY"), kind.startswith("OBJECT"), []
    if depth:
        inner = F.transform(known(F.try_variant_get(value, "$", "array<variant>")), lambda v: _typed(v["value"], v["kind"], depth - 1, known))
        pairs = F.transform(known(F.map_entries(F.try_variant_get(value, "$", ATTRIBUTES)), "key"), lambda e: F.struct(e["key"].alias("key"), _typed(e["value"], e["kind"], depth - 1, known).alias("value")))
        names = [F.when(is_array, F.struct(inner.alias("values"))).alias("arrayValue"), F.when(is_object, F.struct(pairs.alias("values"))).alias("kvlistValue")]
    else:
        text = text.when(is_array | is_object, F.to_json(value))
    whole = kind == "BIGINT"
    real = (kind == "DOUBLE") | (kind == "FLOAT") | kind.startswith("DECIMAL")
    return F.struct(text.alias("stringValue"), F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).alias("boolValue"),
                    F.when(whole, F.try_variant_get(value, "$", "string")).alias("intValue"), F.when(real, number).alias("doubleValue"), *names)


def _hex(raw: Column, digits: int, least: int) -> Column:
    """An id of so many hex digits: one that is hex already is cut or filled with zeros, any other is hashed."""
    plain = F.lower(F.replace(raw, F.lit("-")))
    return F.when(plain.rlike(f"^[0-9a-f]{{{least},}}$"), F.rpad(F.substring(plain, 1, digits), digits, "0")).otherwise(F.substring(F.md5(raw.cast("binary")), 1, digits))


def _nanos(at: Column) -> Column:
    return F.coalesce(F.concat(F.unix_millis(at).cast("string"), F.lit("000000")), F.lit("0"))


def otlp(traces: DataFrame, service: str = "agents", prefix: str = "agent", longest: int = 4096) -> DataFrame:
    """(tenant_id, trace_id, payload): export JSON of ingested traces, one projection. Kinds and statuses
    by number, LLM and TOOL as an attribute besides; a span without an end ends where it starts; a trace
    without spans gives one of its own fields, with texts cut to ``longest`` characters."""
    def numbered(c: Column, known: tuple[str, ...], other: int) -> Column:
        found = F.lit(other)
        for i, k in enumerate(known):
            found = F.when(c == k, i).otherwise(found)
        return found

    own = lambda name, c: F.struct(F.lit(f"{prefix}.{name}").alias("key"), c.alias("value"))
    entries = lambda values: F.coalesce(F.map_entries(values), F.array())
    one = lambda name, c: F.when(c.isNotNull(), own(name, c.cast("variant")))
    cut = lambda c: F.when(F.col(c) != "", F.when(F.length(c) > longest, F.concat(F.substring(c, 1, longest), F.lit("…"))).otherwise(F.col(c)))

    def span(s: Column) -> Column:
        special = F.when(s["kind"].isin("LLM", "TOOL"), F.array(own("span_kind", s["kind"].cast("variant")))).otherwise(F.array())
        events = F.transform(s["events"], lambda e: F.struct(_nanos(F.try_to_timestamp(e["timestamp"])).alias("timeUnixNano"), e["name"].alias("name"), typed(entries(e["attributes"])).alias("attributes")))
        return F.struct(
            F.when(s["trace_id"] == F.col("trace_id"), F.col("trace_hex")).otherwise(_hex(s["trace_id"], 32, 16)).alias("traceId"), _hex(s["span_id"], 16, 8).alias("spanId"), F.when(s["parent_span_id"] != "", _hex(s["parent_span_id"], 16, 8)).alias("parentSpanId"), s["name"].alias("name"),
            numbered(s["kind"], ("", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER"), 1).alias("kind"), _nanos(s["start_time"]).alias("startTimeUnixNano"), _nanos(F.coalesce(s["end_time"], s["start_time"])).alias("endTimeUnixNano"),
            typed(F.concat(entries(s["attributes"]), special)).alias("attributes"), F.coalesce(events, F.array()).alias("events"), F.struct(numbered(s["status_code"], STATUSES, 0).alias("code"), s["status_message"].alias("message")).alias("status"))

    usage = lambda name: F.col(f"token_usage.{name}")
    whole = lambda c: F.when(c == F.floor(c), F.floor(c).cast("variant")).otherwise(c.cast("variant"))
    number = lambda name, c: F.when(c.isNotNull(), own(name, whole(c)))
    attributes = F.array(one("agent_name", F.col("agent_name")), one("framework", F.col("framework")), one("input", cut("input")), one("output", cut("output")), number("cost_usd", F.col("cost_usd")),
                         *[number(k, usage(k)) for k in ("total_tokens", "prompt_tokens", "completion_tokens")])
    end = F.timestamp_micros(F.unix_micros("ts") + F.coalesce(F.col("latency_ms") * 1000, F.lit(0)).cast("long"))
    root = F.struct(
        F.col("trace_hex").alias("traceId"), _hex(F.concat("trace_id", F.lit(":root")), 16, 8).alias("spanId"), F.lit(None).cast("string").alias("parentSpanId"), F.col("agent_name").alias("name"),
        F.lit(1).alias("kind"), _nanos(F.col("ts")).alias("startTimeUnixNano"), _nanos(end).alias("endTimeUnixNano"), typed(F.filter(attributes, lambda a: a.isNotNull())).alias("attributes"),
        F.array().alias("events"), F.struct(F.lit(0).alias("code"), F.lit(None).cast("string").alias("message")).alias("status"))
    spans = F.when(F.size("spans") > 0, F.transform("spans", span)).otherwise(F.array(root))
    named = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.lit(service).alias("stringValue")).alias("value"))).alias("attributes"))
    scope = F.struct(F.struct(F.lit(f"{prefix}.trace").alias("name")).alias("scope"), spans.alias("spans"))
    request = F.struct(F.array(F.struct(named.alias("resource"), F.array(scope).alias("scopeSpans"))).alias("resourceSpans"))
    return traces.withColumn("trace_hex", _hex(F.col("trace_id"), 32, 16)).select("tenant_id", "trace_id", F.to_json(request).alias("payload"))
