import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaywork.llm import mixing, near_dedup, ngram_lm, packing, pii, suffix_dedup, toxicity
from tests.llm.conftest import SCHEMA, prose, rows

KEY = lambda r: (r[0] is None, r[0] or 0)


def strip_ids(data):
    return [(r[0], r[1]) for r in data]


# Suffix dedup


def brute_suffix(data, length):
    seen, out = {}, []
    for i, t in data:
        t = (t or "").encode()
        for p in range(len(t) - length + 1):
            k = t[p : p + length]
            seen[k] = min(seen.get(k, 2**63), 2**63 - 1 if i is None else i)
    for i, t in data:
        t, own = (t or "").encode(), 2**63 - 1 if i is None else i
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] < own:
                gone[p : p + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((i, len(t), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("length,batch,keys", [(50, 1 << 21, 600_000), (50, 2000, 300), (8, 5000, 1000)])
def test_suffix_dedup_matches_brute_force(spark, odd, length, batch, keys):
    if length == 8:
        data = [(i, prose(i % 5, 30) + "|" + "ab" * (i % 40)) for i in range(40)] + [(None, prose(2, 20))]
        docs = spark.createDataFrame(data, "doc_id long, text string")
    else:
        data, docs = strip_ids(rows()), odd
    got = [(r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs, length, batch, keys).collect()]
    sort = lambda x: sorted(x, key=lambda r: (KEY(r), r[3]))
    assert sort(got) == sort(brute_suffix(data, length))


def test_suffix_dedup_of_nothing(empty):
    assert suffix_dedup.remove_repeats(empty).collect() == []


def test_runs_of_one_byte(spark):
    data = [(1, "a" * 300), (2, "b" + "a" * 120 + "c"), (3, "a" * 49)]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in suffix_dedup.remove_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [(1, 121)], 3: []}


# Packing


def test_packing_is_whole_and_gapless(spark, odd):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    got = packing.pack(packing.pieces(odd, path, 64), 64).collect()
    t = Tokenizer.from_file(path)
    want = Counter()
    for i, text in strip_ids(rows()):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 64):
            own = ids[k : k + 64]
            want[i, k // 64, k, len(own), zlib.crc32(own.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seq = defaultdict(list)
    for r in got:
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 64


def naive_best_fit(lengths, capacity):
    """Number of sequences, and the room left in each, by looking at all of them."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, x in enumerate(left) if x >= n]
        if fits:
            left[min(fits, key=lambda k: left[k])] -= n
        else:
            left.append(capacity - n)
    return sorted(left)


@pytest.mark.parametrize("capacity", [7, 64, 2048])
def test_best_fit_matches_a_naive_one(capacity):
    r = np.random.default_rng(capacity)
    for _ in range(20):
        lengths = r.integers(1, capacity + 1, int(r.integers(1, 200)))
        sequence, offset = packing.best_fit_decreasing(lengths, capacity)
        used = np.bincount(sequence, lengths).astype(int)
        assert sorted((capacity - used).tolist()) == naive_best_fit(lengths.tolist(), capacity)
        for s in range(len(used)):
            own = sorted(zip(offset[sequence == s], lengths[sequence == s]))
            assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist()


def test_words_are_encoded_as_whole_texts_are():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    whole, words = Tokenizer.from_file(path), packing.WordTokens(path, 500)
    r = random.Random(2)
    letters = "aBcé ÑßµªºÀ.,'s-!?<|>_1²٣Σİñ\u0301ſﬁ\xad\xa0\n\t$%"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(1, 30))) for _ in range(3000)]
    for text in [*texts, "a<|endoftext|>b", "(<|startoftext|>)", "foo's, It'LL. don't..."]:
        assert words.ids(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_words_kept_are_bounded_and_frequent_ones_stay():
    words = packing.WordTokens(packing.tokenizer_path(), 100)
    made, plain = Counter(), words._made
    words._made = lambda run: made.update([run]) or plain(run)
    for k in range(200):
        words.ids("the river " + " ".join(f"w{k}x{i}" for i in range(20)))
        assert len(words) + len(words.older) <= 2 * 130
    assert made["the"] == made["river"] == made["w7x7"] == 1


def test_packing_splits_into_groups(spark):
    found = spark.range(5000).selectExpr("id as doc_id", "0 as piece", "0L as start", "1 + id % 97 as length", "id as ids_crc32")
    got = packing.pack(found, 128, group=700).collect()
    assert len(got) == 5000 and len({r["sequence_id"] >> 32 for r in got}) > 4
    used = len({r["sequence_id"] for r in got})
    assert used <= 1.02 * sum(r["length"] for r in got) / 128 + 8


def test_best_fit_takes_the_tightest():
    s, o = packing.best_fit_decreasing(np.array([60, 50, 40, 38, 12]), 100)
    assert s.tolist() == [0, 1, 0, 1, 1] and o.tolist() == [0, 0, 60, 50, 88]


def test_packing_of_nothing(empty):
    assert packing.pack(packing.pieces(empty, packing.tokenizer_path())).collect() == []


# Mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    cap = {}
    while True:
        left, lw = 1.5 * sum(sizes.values()) - sum(cap.values()), sum(w[s] for s in names if s not in cap)
        new = [s for s in names if s not in cap and left * w[s] / lw > 2 * sizes[s]]
        if not new:
            return {s: cap.get(s, left * w[s] / lw if lw else 0) for s in names}
        cap |= {s: 2.0 * sizes[s] for s in new}


def test_mixing_meets_targets(odd):
    got = mixing.mix(odd).collect()
    size = Counter()
    for r in rows():
        size[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = brute_targets(size)
    taken = Counter()
    assert len(got) == len(rows())
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    again = mixing.mix(odd.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixing_follows_the_keyed_order(spark):
    docs = spark.createDataFrame([(i, prose(i, 5 + i % 7), "ab"[i % 3 == 0]) for i in range(300)], "doc_id long, text string, source string")
    a = {r["doc_id"]: r for r in mixing.mix(docs, buckets=1).collect()}
    b = {r["doc_id"]: r for r in mixing.mix(docs, buckets=64).collect()}
    assert a == b
    keys = {r["doc_id"]: r["key"] for r in mixing.keyed(docs).collect()}
    for s in "ab":
        own = sorted((i for i in a if a[i]["source"] == s), key=lambda i: keys[i])
        extra = [a[i]["taken"] % a[i]["size"] if a[i]["taken"] < 2 * a[i]["size"] else a[i]["size"] for i in own]
        full = [x == a[i]["size"] for i, x in zip(own, extra)]
        assert full == sorted(full, reverse=True) and sum(0 < x < a[i]["size"] for i, x in zip(own, extra)) <= 1


def test_mixed_rows_take_the_words(spark):
    docs = spark.createDataFrame([(i, prose(i, 9), "a" if i else "b", "x") for i in range(20)], "doc_id long, text string, source string, more string")
    m = mixing.mix(docs)
    out = mixing.mixed_rows(docs, m)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r["doc_id"]] += len(r["text"].split())
    assert words == Counter({r["doc_id"]: r["taken"] for r in m.collect() if r["taken"]})


def test_mixed_rows_of_repeated_rows(spark):
    """Repeats of one row share out what was taken of them; rows of one id and size don't lend each other theirs."""
    data = [(i % 5, prose(i % 5, 9), "a", f"m{i}") for i in range(40)] + [(1, prose(77, 9), "a", "other"), (None, prose(3, 9), None, "x"), (None, prose(3, 9), None, "y"), (9, None, "b", "z")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, more string")
    m = mixing.mix(docs)
    out = mixing.mixed_rows(docs, m).collect()
    want = Counter()
    for r in m.collect():
        want[r["doc_id"], r["source"]] += r["taken"]
    got = Counter()
    for r in out:
        got[r["doc_id"], r["source"]] += len(r["text"].split())
    assert +got == +want


def test_mixing_moves_no_text(spark):
    """Repeats of rows anywhere in the order, ends of budgets among them; texts are exchanged only at the end of a budget."""
    r = random.Random(12)
    data = [(i, prose(i, 4 + i % 9), "abc"[i % 3] if i % 10 else None, f"m{i}") for i in range(150)]
    data += [r.choice(data) for _ in range(400)] + [(500, " \t", "a", "blank"), (501, None, "d", "none")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, more string")
    for seed in (7, 8, 9):
        m = mixing.mix(docs, seed)
        out = mixing.mixed_rows(docs, m, seed)
        want, got = Counter(), Counter()
        for x in m.collect():
            want[x["doc_id"], x["source"]] += x["taken"]
        for x in out.collect():
            got[x["doc_id"], x["source"]] += len(x["text"].split())
        assert got == +want
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin") <= 1  # the rows at the ends with their shares


def test_mixing_of_nothing(empty):
    assert mixing.mix(empty).collect() == []


# Near duplicates


def brute_classes(data, n=5, least=0.8):
    sets = {}
    for i, t in data:
        if i is None:
            continue
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        sets[i] = Counter(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else Counter()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = sum((sets[a] & sets[b]).values())
                if both / sum((sets[a] | sets[b]).values()) >= least:
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_near_duplicates_match_brute_force(spark, odd):
    data = strip_ids(rows())
    for g in range(4):
        base = prose(100 + g, 90).split()
        for k in range(25):  # chains: each differs from the one before
            base[(k * 7) % 90] = f"v{g}_{k}"
            data.append((1000 + 100 * g + k, " ".join(base)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs).collect()
    want = brute_classes(data)
    assert {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None} == want
    assert len([r for r in got if r["doc_id"] is not None]) == len(want)


def test_variants_of_one_text_match_brute_force(spark):
    """Variants of different lengths and distances from one text, some of them alike among themselves."""
    r = random.Random(5)
    base, data = prose(7, 150).split(), []
    for k in range(60):
        words = list(base) if k % 3 else prose(8, 40).split() + base[:110]
        for _ in range(r.randrange(8)):
            at = r.randrange(len(words))
            words[at : at + r.randrange(3)] = [f"x{r.randrange(10**6)}"] if r.random() < 0.6 else []
        data.append((k, " ".join(words)))
        if k % 7 == 0:
            words[3] = "other"
            data.append((500 + k, " ".join(words)))
    got = near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    want = brute_classes(data)
    assert len(set(want.values())) > 5
    assert {r["doc_id"]: r["class_id"] for r in got} == want


def test_prefix_pairs_lose_no_link(spark):
    """All pairs of at least the similarity, across roots, from sets that overlap in every degree."""
    r = np.random.default_rng(3)
    sets = {}
    for i in range(120):
        n = int(r.integers(4, 40))
        own = np.unique(r.integers(0, 60, n)) if i % 2 or not sets else np.array(sorted(set(sets[int(r.integers(0, i))].tolist()) ^ set(r.integers(0, 60, 3).tolist())))
        sets[i] = own.astype(np.int64) if len(own) else np.array([1], np.int64)
    rows = [(i, i % 50, bytearray(v.tobytes())) for i, v in sets.items()]
    df = spark.createDataFrame(rows, "id long, root long, items binary")
    for least in (0.5, 0.8):
        got = {tuple(p) for p in near_dedup.prefix_pairs(near_dedup.prefix_entries(df, least), least).collect()}
        alike = lambda a, b: len(set(sets[a].tolist()) & set(sets[b].tolist())) / len(set(sets[a].tolist()) | set(sets[b].tolist()))
        want = {(a, b) for a in sets for b in sets if a < b and a % 50 != b % 50 and alike(a, b) >= least}
        assert want and want <= got


def test_signatures_estimate_multiset_similarity():
    r = np.random.default_rng(0)
    e = r.integers(1, 2**63, 400).astype(np.uint64)
    w1, w2 = r.integers(1, 9, 400), r.integers(1, 9, 400)
    at = np.repeat([0, 1], 400)
    sig = near_dedup.bag_minhash(2, at, np.concatenate([e, e]), np.concatenate([w1, w2]), 4096)
    want = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04


def test_texts_that_are_not_wanted_stay_where_they_are(spark):
    """Marks lose no id, negative ones, null, repeated rows and full marks included; the rest is told before the exchange."""
    ids = [*range(-3000, 3000), 2**62, -(2**63), None]
    docs = spark.createDataFrame([(i, "x", "y") for i in [*ids, 6, 6, 7]], "doc_id long, text string, `__gone` string")
    wanted = [i for i in ids if i is not None and i % 3 == 0]
    w = spark.createDataFrame([(i,) for i in wanted], "doc_id long")
    for marks in (near_dedup.MARKS, 1 << 8):
        assert Counter(r["doc_id"] for r in near_dedup.within(docs.select("doc_id", "text"), w, marks).collect()) == Counter([*wanted, 6, 6])
        assert Counter(r["doc_id"] for r in near_dedup.without(docs, w, marks).collect()) == Counter([i for i in ids if i not in set(wanted)] + [7])
    assert near_dedup.without(docs, w).columns == docs.columns
    assert near_dedup.marked(docs.select("doc_id", "text"), w).filter("__perhaps").count() < len(wanted) + 10
    assert near_dedup.within(docs.select("doc_id", "text"), w.limit(0)).collect() == [] and near_dedup.without(docs, w.limit(0)).count() == len(ids) + 3
    plan = near_dedup.within(docs.select("doc_id", "text"), w)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("bitmap_construct_agg")  # the exact join is above the marks


def test_near_duplicates_of_nothing(empty):
    assert near_dedup.near_duplicates(empty).collect() == []


# Toxicity


def test_toxicity_learns_and_is_defined_everywhere(spark, odd, empty):
    docs = spark.createDataFrame([(i, prose(i, 40) + (" vilething nasty" if i % 4 == 0 else "")) for i in range(400)] + [(None, "x"), (401, None), (402, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(401, None), (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.judge(docs, labels).collect()}
    assert len(got) == 403 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [r for i, r in got.items() if i is not None and i < 400 and r["held_out"]]
    assert held and all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held)
    assert got[5]["held_out"] == (zlib.crc32(b"5") % 4 == 2) and not got[None]["held_out"]
    none = toxicity.judge(odd, labels.filter("doc_id < 0")).collect()
    assert len(none) == len(rows()) and {r["score"] for r in none} == {0.5}
    assert toxicity.judge(empty, labels).collect() == []


# Personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_base(text):
    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


TEXTS = [
    "mail a.b@c.de, x@y, a@b.c_d@e.f.g and q@w.e@r.t😀é z@z.zz",
    "ip 1.2.3.4 999.1.1.1 1.2.3.4.5.6.7.8 010.001.000.255 1.2.3",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 and 378282246310005 0000000000000000",
    "tel +49 (30) 1234-5678 +1 2 +123456789012345678 ++44 20 7946 0958.",
    "1" * 30000, "a" * 30000, "a.b@" * 5000, "1-" * 20000 + "1", "+1" * 3000, "", None, "é" * 50 + " 4111111111111111",
]


def test_base_spans_match_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.digest(pii.detect(docs)).collect()}
    for i, t in enumerate(TEXTS):
        want = brute_base(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (i, want[:5], got[i]["spans"][:200])
        for k in PATTERNS:
            assert got[i][f"n_{k}"] == sum(x.startswith(f"{k}:") for x in want)


def test_checksums_and_context_add_spans(spark):
    data = [(1, "My IBAN is GB82 WEST 1234 5698 7654 32, thanks"), (2, "IBAN GB82 WEST 1234 5698 7654 33"), (3, "call me: 555-123-4567 now"), (4, "part 555-123-4567 of the kit"), (5, "ssn 123-45-6789"), (6, "id 123-45-6789")]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.detect(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {1: ["iban"], 2: [], 3: ["tel"], 4: [], 5: ["ssn"], 6: []}


def test_redaction(spark):
    d = pii.detect(spark.createDataFrame([(1, "é a@b.cd and 4111111111111111."), (2, "clean"), (3, None)], "doc_id long, text string"))
    assert {r[0]: r[1] for r in d.select("doc_id", pii.redacted(d)).collect()} == {1: "é [EMAIL] and [CARD].", 2: "clean", 3: None}


# Language model


@pytest.mark.parametrize("batch, shard", [(1 << 21, 800_000), (3000, 800_000), (3000, 700)])
def test_language_model_matches_brute_force(spark, odd, batch, shard, monkeypatch):
    """With small shards most words are frequent ones, whose pairs and triples are dealt apart."""
    import math

    monkeypatch.setattr(ngram_lm, "SHARD", shard)
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    data = strip_ids(rows()) + [(100 + i, prose(i, 30).title()) for i in range(40)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("learn", F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True)))
    scores, model = ngram_lm.fit_and_score(docs, batch)
    tokens = [(i, [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(low)) if x] + ["\0"]) for i, t in data]
    c, pairs, ctx, triples = Counter(), Counter(), Counter(), Counter()
    for i, t in tokens:
        if i is None or i % 3:
            c.update(t)
            for u, v, w in zip(["\1", "\1", *t], ["\1", *t], t):
                triples[u, v, w] += 1
                pairs[v, w] += 1
                ctx[v] += 1
    starts = Counter({("\1", "\1"): ctx["\1"]}) + pairs
    n, v_ = sum(c.values()), len(c)
    p1 = lambda w: (c[w] + 0.5) / (n + 0.5 * (v_ + 1))
    p2 = lambda v, w: (pairs[v, w] + ngram_lm.K2 * p1(w)) / (ctx[v] + ngram_lm.K2)
    p3 = lambda u, v, w: (triples[u, v, w] + ngram_lm.K3 * p2(v, w)) / (starts[u, v] + ngram_lm.K3)
    want = sorted(((i is None, i or 0), len(t), sum(c[w] > 0 for w in t), n, sum(math.log10(p1(w)) for w in t), sum(math.log10(p3(u, v, w)) for u, v, w in zip(["\1", "\1", *t], ["\1", *t], t))) for i, t in tokens)
    got = sorted((KEY((r["doc_id"],)), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in scores.collect())
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want]) and np.allclose([g[5] for g in got], [w[5] for w in want], rtol=2e-3, atol=2e-3)
    if shard > 10**5:
        # a pair with the start before it is a pair, and so is that of two starts; ends are followed by nothing
        assert sum(r["pairs"] for r in model.collect()) == len(starts)


def test_language_model_of_frequent_pairs_in_the_shard_of_their_triples(spark):
    """One shard holds all: there a pair of two frequent words stands for itself, beside its triples that are dealt apart."""
    import math

    data = [(i, " ".join("aabaaacadaeab"[(i * 5 + k * k) % 13] for k in range(3 + i % 9))) for i in range(60)]
    tokens = [[*t.split(), "."] for _, t in data]
    c, pairs, ctx, triples = Counter(), Counter(), Counter(), Counter()
    for t in tokens:
        for u, v, w in zip(["^", "^", *t], ["^", *t], t):
            c[w] += 1
            pairs[v, w] += 1
            ctx[v] += 1
            triples[u, v, w] += 1
    starts = Counter({("^", "^"): len(data)}) + pairs
    n = sum(c.values())
    assert c["a"] > n / 4
    p1 = lambda w: (c[w] + 0.5) / (n + 0.5 * (len(c) + 1))
    p2 = lambda v, w: (pairs[v, w] + ngram_lm.K2 * p1(w)) / (ctx[v] + ngram_lm.K2)
    p3 = lambda u, v, w: (triples[u, v, w] + ngram_lm.K3 * p2(v, w)) / (starts[u, v] + ngram_lm.K3)
    want = [sum(math.log10(p3(u, v, w)) for u, v, w in zip(["^", "^", *t], ["^", *t], t)) for t in tokens]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("learn", F.lit(True))
    got = [r["score"] for r in ngram_lm.fit_and_score(docs)[0].orderBy("doc_id").collect()]
    assert np.allclose(got, want, rtol=2e-3, atol=2e-3), max(abs(g - w) for g, w in zip(got, want))


def test_language_model_without_training_or_rows(spark, empty):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").withColumn("learn", F.lit(False))
    got = {r["doc_id"]: r for r in ngram_lm.fit_and_score(docs)[0].collect()}
    assert got[1]["n_tokens"] == 3 and got[1]["n_known"] == 0 and got[1]["train_tokens"] == 0
    assert ngram_lm.fit_and_score(empty.withColumn("learn", F.lit(True)))[0].collect() == []


def test_mix_of_one_id_is_the_same_however_dealt(spark):
    """All rows have one id, or none; only their texts tell them apart."""
    made = [(7 if i % 2 else None, prose(i, 10 + i % 50), "s") for i in range(300)]
    docs = spark.createDataFrame(made, "doc_id long, text string, source string")
    runs = [sorted((r["row_key"], r["taken"]) for r in mixing.mix(docs.repartition(n)).collect()) for n in (1, 7)]
    assert runs[0] == runs[1]
    assert len({k for k, _ in runs[0]}) == 300


def test_pii_of_many_spans(spark):
    """Work follows the spans of a text; offsets, further kinds and marks as for few."""
    n = 4000
    text = "".join(f"é mail u{i}@a.bc; " + ("IBAN DE89370400440532013000. " if i % 50 == 0 else "") + ("ssn 123-45-6789 " if i % 70 == 0 else "") for i in range(n))
    d = pii.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    row = d.select("spans", pii.redacted(d).alias("out")).first()
    assert [text[s["start"] : s["end"]] for s in row["spans"]] == [s["text"] for s in row["spans"]]
    kinds = [s["kind"] for s in row["spans"]]
    assert (kinds.count("email"), kinds.count("iban"), kinds.count("ssn")) == (n, 80, 58)
    assert row["out"] == re.sub(r"DE89370400440532013000", "[IBAN]", re.sub(r"123-45-6789", "[SSN]", re.sub(r"u\d+@a\.bc", "[EMAIL]", text)))
