"""Rules that users define as data, and the guard on their patterns."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaywork.functions.text import ascii_boundaries, utf16_length
from assaywork.operators.rules import Context, Rule, result

#: Characters of a pattern at most.
LONGEST = 1000
_FLAGS = re.compile(r"^\(\?([imsugy]+)\)")


@F.pandas_udf(T.BooleanType())
def is_json(text: pd.Series) -> pd.Series:
    """Strict JSON: no trailing text, no NaN or Infinity. Spark's parser is laxer."""

    def refuse(word: str) -> None:
        raise ValueError(word)

    def one(t: str | None) -> bool:
        try:
            json.loads(t or "", parse_constant=refuse)
            return True
        except (ValueError, RecursionError):
            return False

    return text.map(one)


def _repeats_a_repeat(pattern: str) -> bool:
    """Whether a quantified group holds a quantifier or alternatives: such a pattern can take time
    exponential in the text."""
    open_at: list[bool] = []
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            i = pattern.find("]", i + 2)
            if i < 0:
                return False
        elif c == "(":
            open_at.append(False)
        elif c == ")":
            inner = open_at.pop() if open_at else False
            after = pattern[i + 1 : i + 2]
            many = after in ("*", "+") or (after == "{" and re.match(r"\{\d*,", pattern[i + 1 :]) is not None)
            if inner and many:
                return True
            if open_at and (inner or many):
                open_at[-1] = True
        elif c in "*+|" or (c == "{" and re.match(r"\{\d+,", pattern[i:])):
            if open_at:
                open_at[-1] = True
        i += 1
    return False


def guarded_pattern(pattern: Any, flags: str = "") -> tuple[str | None, str]:
    """(pattern for the engine, "") or (None, why it is refused). Leading inline flags are hoisted."""
    if not isinstance(pattern, str) or not pattern:
        return None, "no pattern"
    if m := _FLAGS.match(pattern):
        flags, pattern = flags + m[1], pattern[m.end() :]
    if len(pattern) > LONGEST:
        return None, "pattern too long"
    if _repeats_a_repeat(pattern):
        return None, "pattern could take exponential time"
    try:
        re.compile(pattern)
    except re.error:
        return None, "invalid pattern"
    used = "".join(f for f in "ims" if f in flags)
    anchored = r"\A(?:" + pattern + ")" if "y" in flags else pattern
    return (f"(?{used})" if used else "") + ascii_boundaries(anchored), ""


def _refused(name: str, why: str) -> Column:
    return result(name, F.lit(False), F.lit(0.0), F.lit(why))


def custom_rule(definition: Mapping[str, Any], eval_type: str = "custom") -> Rule:
    """The rule of a definition {name, type, config, weight}."""
    name, kind, config = definition["name"], definition.get("type"), definition.get("config") or {}

    def number(*keys: str) -> float | None:
        return next((config[k] for k in keys if config.get(k) is not None), None)

    def evaluate(c: Context) -> Column:
        if kind in ("regex_match", "regex_no_match"):
            pattern, why = guarded_pattern(config.get("pattern"), config.get("flags") or "")
            if pattern is None:
                return _refused(name, why)
            ok = c.output.rlike(pattern) if kind == "regex_match" else ~c.output.rlike(pattern)
            return result(name, ok, F.when(ok, 1.0).otherwise(0.0), F.lit(f"{kind} {config['pattern']}"))
        if kind in ("min_length", "max_length"):
            bound = number(kind, "length")
            if bound is None or bound <= 0:
                return _refused(name, f"{kind} needs a positive number")
            n = utf16_length(c.output)
            ok = n >= bound if kind == "min_length" else n <= bound
            score = n / float(bound) if kind == "min_length" else F.lit(float(bound)) / n
            return result(name, ok, F.when(ok, 1.0).otherwise(score), F.concat(F.lit("length "), n.cast("string")))
        if kind in ("contains_keywords", "excludes_keywords"):
            keywords = config.get("keywords")
            if not isinstance(keywords, list) or not keywords:
                return _refused(name, f"{kind} needs keywords")
            low = F.lower(c.output)
            n = sum((F.contains(low, F.lit(k.lower())).cast("int") for k in keywords), F.lit(0))
            share = n / float(len(keywords))
            ok = share >= float(config.get("threshold", 1) if config.get("threshold") is not None else 1) if kind == "contains_keywords" else n == 0
            return result(name, ok, share if kind == "contains_keywords" else F.when(ok, 1.0).otherwise(0.0), F.concat(n.cast("string"), F.lit(f" of {len(keywords)} keywords")))
        if kind == "json_schema":
            ok = is_json(c.output)
            return result(name, ok, F.when(ok, 1.0).otherwise(0.0), F.lit("JSON"))
        if kind == "cost_threshold":
            most = number("max_cost")
            if most is None or most < 0:
                return _refused(name, "cost_threshold needs max_cost")
            ok = F.coalesce(c.cost_usd, F.lit(0.0)) <= float(most)
            return result(name, ok, F.when(ok, 1.0).otherwise(0.0), F.lit(f"cost against {most}"))
        return _refused(name, f"unknown rule type: {kind}")

    return Rule(name, eval_type, float(definition["weight"]) if definition.get("weight") is not None else 1.0, evaluate)


def preview(traces: DataFrame, definition: Mapping[str, Any], start: Column, end: Column, newest: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(counts, examples) of a proposed rule over the traces of a window: would fail, pass, skip (null
    output), and the five newest that fail with the start of their output. newest: look at so many only."""
    rule = custom_rule(definition)
    rows = traces.filter((F.col("ts") >= start) & (F.col("ts") < end))
    if newest:
        rows = rows.orderBy(F.desc("ts"), "trace_id").limit(newest)
    known = F.col("output").isNotNull()
    rows = rows.withColumn("ok", rule.evaluate(Context.of(rows))["passed"])
    counts = rows.agg(*[F.count_if(c).alias(n) for n, c in (("would_fail", known & ~F.col("ok")), ("would_pass", known & F.col("ok")), ("would_skip", ~known))])
    examples = rows.filter(known & ~F.col("ok")).orderBy(F.desc("ts"), "trace_id").limit(5).select("trace_id", F.substring("output", 1, 200).alias("preview"))
    return counts, examples
