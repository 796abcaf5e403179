"""Operator 5 against FTRL-proximal written plainly: a dictionary for each state, features as tuples."""

import math
import random
import re

import numpy as np
import pytest

from assaywork.llm import toxicity


def features(text):
    w = re.findall("[a-z0-9]+", (text or "").lower())
    return {("word", x) for x in w} | {(n, x[:n]) for x in w for n in toxicity.STEMS} | {("gap", g, x, y) for g in (1, 2) for x, y in zip(w, w[g:])}


def plain(labelled, support, epochs, alpha, beta, l1):
    """A function from a text to its chance, learnt from (text, label) in the order of training."""
    seen = [(features(t), y) for t, y in labelled]
    counts = {}
    for f, _ in seen:
        for x in f:
            counts[x] = counts.get(x, 0) + 1
    z, n = {}, {}

    def weight(x):
        v, least = z.get(x, 0.0), 0 if x == "intercept" else l1
        return 0.0 if abs(v) <= least else -(v - math.copysign(least, v)) / ((beta + math.sqrt(n.get(x, 0.0))) / alpha)

    def chance(f):
        return 1 / (1 + math.exp(-sum(map(weight, f))))

    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(seen)):
            own = [*(x for x in seen[i][0] if counts[x] >= support), "intercept"]
            g = chance(own) - seen[i][1]
            for x, w in [(x, weight(x)) for x in own]:
                was = n.get(x, 0.0)
                n[x] = was + g * g
                z[x] = z.get(x, 0.0) + g - (math.sqrt(n[x]) - math.sqrt(was)) / alpha * w
    return lambda text: chance([*(x for x in features(text) if x in z), "intercept"])


@pytest.mark.parametrize("l1", [0.0, 0.5])
def test_weights_and_scores_are_those_of_plain_ftrl(spark, l1):
    r = random.Random(11)
    words = ["stone", "river", "Cloud", "meadow", "it", "x9", "harvesting", "lanterns"]
    labelled = []
    for i in range(80):
        bad = i % 4 == 0
        labelled.append((", ".join(r.choices(words + ["vilest", "vile"] * 3 * bad, k=r.randrange(1, 25))), float(bad)))
    given = {"support": 3, "epochs": 3, "alpha": 0.3, "beta": 1.0, "l1": l1}
    model = toxicity.train(spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(labelled)], "order_key long, text string, label double"), **given)
    asked = [t for t, _ in labelled] + ["", None, "vile", "a vile, VILEST river", "none of these words"]
    got = toxicity.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), model).collect()
    chance = plain(labelled, **given)
    assert {x["doc_id"]: x["score"] for x in got} == pytest.approx({i: chance(t) for i, t in enumerate(asked)}, abs=1e-9)
    scores = [x["score"] for x in sorted(got, key=lambda x: x["doc_id"])]
    assert max(scores) - min(scores) > 0.3
