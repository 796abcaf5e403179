"""Deployed rules as rows: against the column form of each rule, and by the thousands; rules in force at a time."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from assaywork.operators import custom, deployed, rules

TABLE = "tenant_id string, rule_id string, eval_type string, enabled boolean, definition string"
TEXTS = "tenant_id string, trace_id long, input string, output string, expected string, cost_usd double, prompt_tokens long, completion_tokens long, ts timestamp"
WORDS = ["river", "stone", "Bridge", "quiet", "morning", "glass", "ÉTÉ", "scum", "idiot"]


def definition(r, i):
    kind = r.choice(["min_length", "max_length", "cost_threshold", "contains_keywords", "excludes_keywords", "regex_match", "regex_no_match", "unknown"])
    config = {
        "min_length": lambda: r.choice([{"length": r.randrange(1, 200)}, {"min_length": 30}, {}, {"length": -1}]), "max_length": lambda: {"length": r.randrange(1, 200)},
        "cost_threshold": lambda: r.choice([{"max_cost": r.random()}, {"max_cost": 0}, {}]),
        "contains_keywords": lambda: r.choice([{"keywords": r.sample(WORDS, 3), "threshold": 0.5}, {"keywords": r.sample(WORDS, 2)}, {"keywords": []}, {"keywords": ["river", "river"], "threshold": 1}]),
        "excludes_keywords": lambda: {"keywords": r.sample(WORDS, 2)}, "regex_match": lambda: r.choice([{"pattern": "(?i)bridge"}, {"pattern": "("}, {"pattern": r"\bstone\b"}]),
        "regex_no_match": lambda: r.choice([{"pattern": "glass$"}, {"pattern": "(a+)+"}]), "unknown": dict,
    }[kind]()
    return json.dumps({"name": f"rule-{i}", "type": kind, "config": config, **({"weight": r.choice([1, 2, 0.5])} if i % 3 else {})})


def some_texts(spark, n=40):
    r = random.Random(1)
    rows = [(f"t{i % 3}", i, None, " ".join(r.choice(WORDS).lower() if r.random() < 0.5 else r.choice(WORDS) for _ in range(r.randrange(0, 25))), None, r.choice([None, 0.0, 0.3, 0.9]), 10, 20, datetime(2024, 1, 1)) for i in range(n)]
    return spark.createDataFrame([*rows, ("t1", 900, None, "", None, None, 0, 0, datetime(2024, 1, 1)), ("t9", 901, None, "no rules of its own", None, 0.1, 1, 1, datetime(2024, 1, 1))], TEXTS)


def test_rows_score_like_columns(spark):
    """Every kind of rule, valid or not, in blocks of every size, set against each rule's own column."""
    r = random.Random(7)
    table = [(f"t{r.randrange(3)}", f"rule-{i}", r.choice(["safety", "cost", "custom"]), r.random() < 0.9, definition(r, i)) for i in range(90)]
    texts = some_texts(spark)
    made = [rules.Rule(x.name, x.eval_type, x.weight, x.evaluate, (t,)) for t, _, e, on, d in table if on for x in [custom.custom_rule(json.loads(d), e)]]
    want = {(x["trace_id"], x["eval_type"]): x for x in rules.evaluate(texts, ("safety", "cost"), more=made).collect()}
    for size in (1, 7, 4096):
        got = deployed.score(texts, spark.createDataFrame(table, TABLE), ("safety", "cost"), size).collect()
        assert len(got) == len(want) == 2 * texts.count()
        for x in got:
            w = want[x["trace_id"], x["eval_type"]]
            assert (x["rules_evaluated"], x["rules_skipped"], x["passed"]) == (w["rules_evaluated"], w["rules_skipped"], w["passed"]) and abs(x["score"] - w["score"]) <= 0.001, (x, w)


def test_ten_thousand_definitions(spark):
    """No limit on their number; each tenant sees its own alone."""
    rows = [(f"t{i % 3}", f"rule-{i}", "safety", True, json.dumps({"name": f"r{i}", "type": "excludes_keywords", "config": {"keywords": [f"word{i}x", f"other{i}y"]}})) for i in range(10_000)]
    rows += [("t0", f"len-{i}", "safety", True, json.dumps({"name": f"l{i}", "type": "min_length", "config": {"length": i + 1}})) for i in range(1000)]
    texts = spark.createDataFrame([("t0", 1, "word3x and OTHER6Y but word4x"), ("t1", 2, "word4x word1x"), ("t2", 3, "nothing")], "tenant_id string, trace_id long, output string").withColumn("cost_usd", F.lit(None).cast("double"))
    table = spark.createDataFrame(rows, TABLE)
    got = {x["trace_id"]: x for x in deployed.added(texts, table, ("safety",)).collect()}
    n = len("word3x and OTHER6Y but word4x")
    assert got[1]["n"] == 3334 + 1000 and abs(got[1]["points"] - (3334 - 2 + sum(min(1, n / (i + 1)) for i in range(1000)))) < 1e-6
    assert (got[2]["n"], got[2]["points"], got[3]["n"], got[3]["points"]) == (3333, 3331.0, 3333, 3333.0)
    most = deployed.blocks(table, ("safety",), 500).select(F.max(F.size("rules")), F.sum(F.size("rules"))).first()
    assert most[0] <= 500 and most[1] == 11_000


def test_rules_in_force_at_a_time(spark):
    """Deployed, switched off and on, deleted, deployed again; at the very moment of a change; other tenants' rules."""
    t0 = datetime(2024, 1, 1)
    at = lambda d, h=0: t0 + timedelta(days=d, hours=h)
    audit = [(1, "a", "r", "rule.deploy", True, at(0)), (2, "a", "r", "rule.update", False, at(1)), (3, "a", "r", "rule.toggle", False, at(2, 6)), (4, "a", "r", "rule.toggle", True, at(4)), (5, "a", "r", "rule.delete", True, at(6)), (6, "a", "r", "rule.deploy", True, at(8)), (7, "b", "s", "rule.deploy", True, at(0)), (8, "b", "s", "rule.deploy", True, at(0))]
    entries = spark.createDataFrame([(*x, "safety", 1) for x in audit], "entry_id long, tenant_id string, rule_id string, action string, enabled boolean, ts timestamp, eval_type string, k int")
    times = [at(-1), at(0), at(1), at(2, 5), at(2, 6), at(3), at(4), at(5, 23), at(6), at(7), at(8), at(30)]
    texts = spark.createDataFrame([("a", i, t) for i, t in enumerate(times)] + [("c", 99, at(1))], "tenant_id string, trace_id long, ts timestamp")
    got = sorted((x["trace_id"], x["rule_id"]) for x in deployed.at_their_time(texts, deployed.in_force(entries)).collect())
    assert got == [(i, "r") for i in (1, 2, 3, 6, 7, 10, 11)]
