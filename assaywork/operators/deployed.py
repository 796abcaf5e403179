"""Rules deployed as data, per tenant, beside the built-in ones: as many as there are, each a row.

Deployed rules are grouped by tenant and dealt into blocks of a bounded number of rules, whose bytes bound what a task
holds. A text meets the blocks of its tenant once each: lengths and costs are compared with all bounds of a block at once,
and one multi-pattern automaton over all keywords of the block finds those that the text has in a single pass. What a block
adds to a bundle (points, weights, rules) is summed by text. Rules with a pattern, which only the engine's own
matcher can judge, are joined as rows."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaywork.functions.text import utf16_length
from assaywork.operators import custom, rules

#: Rules of a block, at most.
BLOCK = 4096
KINDS = ("min_length", "max_length", "cost_threshold", "contains_keywords", "excludes_keywords")
PATTERNS = ("regex_match", "regex_no_match")


def _bound(config: dict, *keys: str) -> float | None:
    found = next((config[k] for k in keys if config.get(k) is not None), None)
    return float(found) if isinstance(found, (int, float)) and not isinstance(found, bool) else None


class Block:
    """Rules of one tenant: (eval type, definition as JSON) each. ``points`` scores one text."""

    def __init__(self, types: Sequence[str], definitions: Sequence[str]):
        import ahocorasick

        self.types = np.array(types)
        made = [json.loads(d) for d in definitions]
        n = len(made)
        self.weight = np.array([float(d["weight"]) if d.get("weight") is not None else 1.0 for d in made])
        self.kind, self.bound, self.least = np.full(n, -1), np.full(n, np.nan), np.ones(n)
        words: dict[str, int] = {}
        of_word, of_rule = [], []
        for i, d in enumerate(made):
            kind, config = d.get("type"), d.get("config") or {}
            if kind in ("min_length", "max_length"):
                bound = _bound(config, kind, "length")
                ok = bound is not None and bound > 0
            elif kind == "cost_threshold":
                bound = _bound(config, "max_cost")
                ok = bound is not None and bound >= 0
            elif kind in ("contains_keywords", "excludes_keywords"):
                keywords = config.get("keywords")
                ok = isinstance(keywords, list) and bool(keywords)
                bound = len(keywords) if ok else None
                self.least[i] = float(config["threshold"]) if config.get("threshold") is not None else 1.0
                for w in keywords if ok else []:
                    of_word.append(words.setdefault(w.lower(), len(words)))
                    of_rule.append(i)
            else:
                ok = False
            if ok:
                self.kind[i], self.bound[i] = KINDS.index(kind), bound
        self.of_word, self.of_rule = np.array(of_word, np.int64), np.array(of_rule, np.int64)
        self.words, self.always = len(words), [k for w, k in words.items() if not w]
        self.find = ahocorasick.Automaton()
        for w, k in words.items():
            if w:
                self.find.add_word(w, k)
        if len(self.find):
            self.find.make_automaton()

    def scores(self, low: str, length: int, cost: float | None) -> np.ndarray:
        """Score of each rule for a text (lower case, length in UTF-16 units, cost). A rule that isn't valid scores 0."""
        met = np.zeros(self.words, bool)
        if len(self.find):
            met[[k for _, k in self.find.iter(low)]] = True
        met[self.always] = True
        hits = np.bincount(self.of_rule[met[self.of_word]], minlength=len(self.kind))
        with np.errstate(divide="ignore", invalid="ignore"):
            share = hits / self.bound
            by_kind = [np.where(length >= self.bound, 1.0, length / self.bound), np.where(length <= self.bound, 1.0, self.bound / length) if length else np.ones(len(self.kind)),
                       np.where((cost or 0.0) <= self.bound, 1.0, 0.0), share, np.where(hits == 0, 1.0, 0.0)]
        return np.choose(self.kind, by_kind) if (self.kind >= 0).all() else np.where(self.kind < 0, 0.0, np.choose(np.maximum(self.kind, 0), by_kind))


@lru_cache(8)
def _block(rows: tuple[tuple[str, str], ...]) -> Block:
    return Block([t for t, _ in rows], [d for _, d in rows])


def blocks(table: DataFrame, eval_types: Sequence[str], size: int = BLOCK) -> DataFrame:
    """(tenant_id, block, rules: array of eval_type and definition) of the enabled rules (tenant_id, rule_id, eval_type, enabled,
    definition as JSON) without a pattern. Rules are numbered within hashed parts of a tenant, so that no task sorts one as a whole."""
    own = table.filter(F.col("enabled") & F.col("eval_type").isin(*eval_types) & ~F.coalesce(F.get_json_object("definition", "$.type").isin(*PATTERNS), F.lit(False)))
    part = F.pmod(F.xxhash64("rule_id"), F.lit(64))
    numbered = own.withColumn("part", part).withColumn("n", F.row_number().over(Window.partitionBy("tenant_id", "part").orderBy("rule_id", "definition")))
    # few rules make one block, many as many as they need: parts are put together as their sizes allow
    sizes = numbered.groupBy("tenant_id", "part").agg(F.max("n").alias("rules")).withColumn("before", F.sum("rules").over(Window.partitionBy("tenant_id").orderBy("part")) - F.col("rules"))
    dealt = numbered.join(sizes, ["tenant_id", "part"]).withColumn("block", F.floor((F.col("before") + F.col("n") - 1) / size).cast("int"))
    return dealt.groupBy("tenant_id", "block").agg(F.array_sort(F.collect_list(F.struct("eval_type", "definition"))).alias("rules"))


def added(texts: DataFrame, table: DataFrame, eval_types: Sequence[str] = rules.EVAL_TYPES, size: int = BLOCK, keys: tuple[str, ...] = ("tenant_id", "trace_id")) -> DataFrame:
    """(keys, eval_type, points, weight, n): what each tenant's enabled rules add to a text's bundles."""
    own = texts.select(*keys, "output", "cost_usd", utf16_length(F.col("output")).cast("long").alias("__length"))
    names = [f.name for f in own.schema.fields if f.name in keys]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields if f.name in keys]) + ", eval_type string, points double, weight double, n long"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            at = []
            for i, (text, length, cost, own_rules) in enumerate(zip(batch["output"].to_pylist(), batch["__length"].to_pylist(), batch["cost_usd"].to_pylist(), batch["rules"])):
                block = _block(tuple((r["eval_type"], r["definition"]) for r in own_rules.as_py()))
                score = block.scores((text or "").lower(), length or 0, cost)
                for t in np.unique(block.types).tolist():
                    pick = block.types == t
                    at.append(i)
                    for c, v in zip(rows, (t, float((score * block.weight)[pick].sum()), float(block.weight[pick].sum()), int(pick.sum()))):
                        c.append(v)
            keyed = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[keyed[n] for n in names], pa.array(rows[0], pa.string()), pa.array(rows[1], pa.float64()), pa.array(rows[2], pa.float64()), pa.array(rows[3], pa.int64())], [*names, "eval_type", "points", "weight", "n"])

    plain = own.join(blocks(table, eval_types, size), "tenant_id").mapInArrow(judge, schema)
    return plain.unionByName(_patterns(texts, table, eval_types, keys)).groupBy(*keys, "eval_type").agg(F.sum("points").alias("points"), F.sum("weight").alias("weight"), F.sum("n").alias("n"))


def _guarded(table: DataFrame, eval_types: Sequence[str]) -> DataFrame:
    """(tenant_id, eval_type, weight, pattern, negative) of the rules with a pattern; a refused one has null."""
    def guard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [json.loads(d) for d in batch["definition"].to_pylist()]
            patterns = [custom.guarded_pattern((d.get("config") or {}).get("pattern"), (d.get("config") or {}).get("flags") or "")[0] for d in made]
            weight = [float(d["weight"]) if d.get("weight") is not None else 1.0 for d in made]
            yield pa.RecordBatch.from_arrays([batch["tenant_id"], batch["eval_type"], pa.array(weight), pa.array(patterns, pa.string()), pa.array([d["type"] == "regex_no_match" for d in made])], ["tenant_id", "eval_type", "weight", "pattern", "negative"])

    own = table.filter(F.col("enabled") & F.col("eval_type").isin(*eval_types) & F.coalesce(F.get_json_object("definition", "$.type").isin(*PATTERNS), F.lit(False)))
    return own.select("tenant_id", "eval_type", "definition").mapInArrow(guard, "tenant_id string, eval_type string, weight double, pattern string, negative boolean")


def _patterns(texts: DataFrame, table: DataFrame, eval_types: Sequence[str], keys: tuple[str, ...]) -> DataFrame:
    own = texts.select(*keys, "output").join(_guarded(table, eval_types), "tenant_id")
    ok = F.coalesce(F.expr("output rlike pattern") != F.col("negative"), F.lit(False)) & F.col("pattern").isNotNull()
    return own.groupBy(*keys, "eval_type").agg(F.sum(F.when(ok, F.col("weight")).otherwise(0.0)).alias("points"), F.sum("weight").alias("weight"), F.count("*").alias("n"))


def _bundle(points: Column, weight: Column, n: Column) -> list[Column]:
    mean = points / weight
    return [F.when(n == 0, 0.0).otherwise(F.floor(mean * 1000 + 0.5) / 1000).alias("score"), ((n > 0) & (mean >= 0.7)).alias("passed")]


def _built_in(texts: DataFrame, eval_types: Sequence[str]) -> DataFrame:
    """tenant_id, trace_id, eval_type, points, weight, n, skipped of the built-in bundles."""
    weights = F.create_map(*[F.lit(x) for r in rules.BUILT_IN for x in (r.name, float(r.weight))])
    ran = F.filter("rule_results", lambda r: ~F.coalesce(r["skipped"], F.lit(False)))
    total = lambda one: F.aggregate(ran, F.lit(0.0), lambda acc, r: acc + one(r))
    of = lambda r: F.element_at(weights, r["ruleName"])
    return rules.evaluate(texts, eval_types).select(
        "tenant_id", "trace_id", "eval_type", total(lambda r: r["score"] * of(r)).alias("points"), total(of).alias("weight"), F.size(ran).cast("long").alias("n"), (F.size("rule_results") - F.size(ran)).alias("skipped"))


def score(texts: DataFrame, table: DataFrame, eval_types: Sequence[str] = rules.EVAL_TYPES, size: int = BLOCK) -> DataFrame:
    """tenant_id, trace_id, eval_type, score, passed, rules_evaluated, rules_skipped: the built-in bundles with each tenant's enabled
    rules in those of their type."""
    key = ("tenant_id", "trace_id")
    base = _built_in(texts, eval_types)
    more = added(texts, table, eval_types, size)
    both = base.join(more.select(*key, "eval_type", *[F.col(c).alias(f"more_{c}") for c in ("points", "weight", "n")]), [*key, "eval_type"], "left")
    total = lambda c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0))
    return both.select(*key, "eval_type", *_bundle(total("points"), total("weight"), total("n")), total("n").cast("int").alias("rules_evaluated"), F.col("skipped").cast("int").alias("rules_skipped"))


def replay(texts: DataFrame, stored: DataFrame, eval_types: Sequence[str] = rules.EVAL_TYPES, table: DataFrame | None = None) -> DataFrame:
    """Scores outputs by the rules of now and sets them against stored evals (tenant_id, trace_id, eval_type,
    score, passed): delta of scores, and whether passing changed. Outputs without a stored eval have nulls."""
    now = rules.evaluate(texts, eval_types) if table is None else score(texts, table, eval_types)
    old = stored.select("tenant_id", "trace_id", "eval_type", F.col("score").alias("stored_score"), F.col("passed").alias("stored_passed"))
    both = now.select("tenant_id", "trace_id", "eval_type", "score", "passed").join(old, ["tenant_id", "trace_id", "eval_type"], "left")
    return both.withColumn("delta", F.floor((F.col("score") - F.col("stored_score")) * 1000 + 0.5) / 1000).withColumn("changed", F.col("passed") != F.col("stored_passed"))


def in_force(audit: DataFrame) -> DataFrame:
    """(tenant_id, rule_id, eval_type, k, since, until) of rule lifecycle entries: from each that leaves a rule enabled, up to the rule's next
    (exclusive; null: still). Updates change no state."""
    own = Window.partitionBy("tenant_id", "rule_id").orderBy("ts", "entry_id")
    spans = audit.filter("action <> 'rule.update'").withColumn("until", F.lead("ts").over(own))
    return spans.filter((F.col("action") != "rule.delete") & F.col("enabled")).select("tenant_id", "rule_id", "eval_type", "k", F.col("ts").alias("since"), "until").filter("until is null or until > since")


def at_their_time(texts: DataFrame, spans: DataFrame, keys: tuple[str, ...] = ("tenant_id", "trace_id")) -> DataFrame:
    """Texts with the rules in force at their time: one row for each. Spans are cut by the days that texts fall on, so the join is by
    tenant and day, and only the days of a change are compared by time."""
    bounds = texts.agg(F.to_date(F.min("ts")).alias("lo"), F.to_date(F.max("ts")).alias("hi"))
    day = lambda c: F.to_date(c)
    cut = spans.crossJoin(F.broadcast(bounds)).withColumn("a", F.greatest(day("since"), F.col("lo"))).withColumn("b", F.least(F.coalesce(day("until"), F.col("hi")), F.col("hi")))
    days = cut.filter("a <= b").withColumn("day", F.explode(F.sequence("a", "b"))).drop("a", "b", "lo", "hi")
    met = texts.withColumn("day", day("ts")).join(days, ["tenant_id", "day"])
    return met.filter((F.col("ts") >= F.col("since")) & (F.col("until").isNull() | (F.col("ts") < F.col("until")))).drop("day")
