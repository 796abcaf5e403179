"""Token links, quality and fill-in-the-middle against plain versions."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assaywork.llm import align, fim, quality
from assaywork.llm.packing import tokenizer_path
from assaywork.llm.textkernel import chunks

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizers():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=B)


def plain_links(rows, tokenizers):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of (doc_id, text), one token at a time."""
    a, b = tokenizers
    letters = align._byte_of_letter()
    docs = []
    for i, text in rows:
        groups, n_a, n_b = [], 0, 0
        if text:
            found, ids = a.encode(" " + text, add_special_tokens=False), b.encode(text)
            a_ids, own_a = found.ids, [bytes(letters[c] for c in t) for t in found.tokens]
            own_b = [bytes([int(b.id_to_piece(t)[1:-1], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in ids]
            if b"".join(own_a) == (" " + text).encode() == b"".join(own_b):
                n_a, n_b = len(own_a), len(own_b)
                ends_a, ends_b = np.cumsum([*map(len, own_a)]).tolist(), np.cumsum([*map(len, own_b)]).tolist()
                x = y = 0
                for end in sorted({*ends_a} & {*ends_b}):
                    p, q = [], []
                    while x < n_a and ends_a[x] <= end:
                        p.append(a_ids[x])
                        x += 1
                    while y < n_b and ends_b[y] <= end:
                        q.append(ids[y])
                        y += 1
                    groups.append((p, q))
        docs.append((i, n_a, n_b, groups, Counter((p, q) for own, other in groups for p in own for q in other)))
    count = Counter(k for d in docs for k in d[4])
    best = Counter()
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    return [(i, n_a, n_b, len(g), sum(c.values()), sum(n for k, n in c.items() if count[k] == best[k[0]]), sum(n * count[k] for k, n in c.items()),
             ";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in g)) for i, n_a, n_b, g, c in docs]


ODD_TEXTS = ["<|endoftext|> <s> </s> <0x41> plain", "a▁b changed by B", "tabs\tand\r\nlines\n\n  three   spaces ", "nul\0byte", "ünï 😀 cödé é", " 　", "'s don't WE'LL 12345 !!!", "x" * 5000, "\n", " ", "日本語のテキスト", "ab" * 400]


def key(row):
    return tuple((x is None, x if x is not None else "") for x in row)


@pytest.mark.parametrize("run_bytes, fan", [(align.RUN, align.FAN), (2000, 2)])
def test_links(spark, odd, tokenizers, run_bytes, fan):
    """In one node, and in several levels of nodes."""
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(300 + i, f"the river {i % 7} under the bridge") for i in range(60)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more).repartition(5, "doc_id")
    got = [tuple(r) for r in align.links(docs, A, B, run_bytes=run_bytes, parts=3, fan=fan).collect()]
    want = plain_links([(r["doc_id"], r["text"]) for r in docs.collect()], tokenizers)
    assert sorted(got, key=key) == sorted([tuple(w) for w in want], key=key)


def test_links_of_documents(spark, tokenizers):
    """The query over a table, digests of groups included."""
    rows = duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall()
    got = sorted(tuple(r) for r in align.op11_align(spark, FOLDER).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect())
    assert got == sorted((*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for w in plain_links(rows, tokenizers))


def test_links_of_nothing(spark, empty):
    assert align.links(empty, A, B).collect() == []


def test_a_group_without_common_ends():
    """Large groups pair distinct ids, without a row for each link."""
    known = align.Encoders(A, B)
    listed, align.LISTED = align.LISTED, 0
    try:
        few = align.aligned(["the river runs", None, "ab" * 50], known, False)
    finally:
        align.LISTED = listed
    for x, y in zip(few, align.aligned(["the river runs", None, "ab" * 50], known, False)):
        assert list(map(str, x)) == list(map(str, y))


def test_runs_keep_their_records():
    r = np.random.default_rng(3)
    rows = sorted({(int(c), int(d)) for c, d in zip(r.integers(0, 40, 900) << 16 | r.integers(0, 30, 900), r.integers(0, 50, 900))})
    code, doc = np.array([c for c, _ in rows]), np.array([d for _, d in rows])
    links = r.integers(1, 9, len(rows))
    new = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    for frame in (1, 37, 10_000):
        data = align.spill(code[new], np.diff(np.append(new, len(code))), doc, links, frame)
        back = [(a << 16 | int(b), int(d)) for a, bs, n, ds, _ in align.segments(data) for b, d in zip(np.repeat(bs, n), ds)]
        assert back == rows
        assert np.concatenate([s[4] for s in align.segments(data)]).tolist() == links.tolist()


def test_merge_counts_in_order():
    none = np.zeros(0, np.int64)
    runs = [align.spill(np.array(c, np.int64), np.array(n, np.int64), none, none) for c, n in (([1 << 16 | 2, 5 << 16 | 1], [3, 1]), ([1 << 16 | 1, 1 << 16 | 2], [2, 4]), ([], []))]
    assert [(m.a, m.b.tolist(), m.count.tolist()) for m in align.merge(runs)] == [(1, [1, 2], [2, 7]), (5, [1], [1])]


def lines(text):
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def plain_fim(doc_id, text, seed=7):
    text = text or ""
    own = lines(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    x, y = sorted(k % (len(own) + 1) for k in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100:
        return len(own), "plain", None, None, text
    p, m, s = "".join(own[:x]), "".join(own[x:y]), "".join(own[y:])
    form = "spm" if h[3] % 100 < 50 else "psm"
    return len(own), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fim(spark, odd):
    r = random.Random(4)
    made = ["".join(r.choice(["\n", "a", "ü", "😀", "line of words\n", "\r\n", "\v", "日本"]) for _ in range(r.randrange(60))) for _ in range(400)]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate([*made, "has <P> in it\n", "<S>", "a\n<M>\nb", "<p>\n<s>", "\n", "\n\n\n", "no end", "é\n" * 3000])], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    out = fim.transform(docs).withColumn("back", fim.restored())
    got = [tuple(x) for x in out.collect()]
    want = [(x["doc_id"], *plain_fim(x["doc_id"], x["text"]), x["text"] or "") for x in docs.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_fim_rate(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\n").alias("text"))
    form = {r["form"]: r["count"] for r in fim.transform(docs, rate=50, spm=25).groupBy("form").count().collect()}
    assert 1800 < form["plain"] < 2200 and 350 < form["spm"] < 650
    assert fim.transform(docs.limit(0)).collect() == []


def test_fim_query_against_sql(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    want = c.sql(fim.ORACLES["op13_fim"])
    got = fim.op13_fim(spark, FOLDER).select(want.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("byte", [0, 9, 10, 11, 127, 128, 255])
def test_marks_are_exact(byte):
    data = np.random.default_rng(byte).integers(0, 256, 8000).astype(np.uint8)
    data[::3] = byte
    data[1::7] = (byte + 1) % 256
    marks = fim.Marks(fim.marks_of(data.view("<u8"), byte))
    at = np.flatnonzero(data == byte)
    assert marks.select(np.arange(1, len(at) + 1)).tolist() == at.tolist()
    place = np.arange(len(data) + 1)
    assert marks.before(place).tolist() == np.searchsorted(at, place).tolist()


def plain_features(text, bits):
    """Places with their times, from characters and words one by one."""
    from assaywork.llm.textkernel import BYTE, JOIN, PLACE, mix

    u = np.uint64

    def hashed(raw):
        return int(mix(np.array([sum(int(BYTE[b]) * int(PLACE[k]) for k, b in enumerate(raw)) % 2**64], u))[0])

    def joined(parts):
        n = len(parts)
        steps = sum(k << (8 * k) for k in range(n)) % (1 << 62)
        total = sum(p * int(JOIN[k + 8 * (n - 1) % 56]) for k, p in enumerate(parts)) + steps
        return int(mix(np.array([total % 2**64], u))[0])

    place = lambda h: h % 2**64 >> (64 - bits)
    again = lambda h, by: int(mix(np.array([(h + by) % 2**64], u))[0])
    out, words = Counter(), re.findall(r"[^\x20\x09-\x0D]+", text)
    whole = [hashed(w.encode()) for w in words]
    for w, h in zip(words, whole):
        out[place(again(h, int(quality._DONE)))] += 1
        chars = [int(quality._START), *(hashed(c.encode()) for c in w), int(quality._END)]
        for n in quality.GRAMS:
            for k in range(len(chars) - n + 1):
                out[place(again(joined(chars[k : k + n]), n))] += 1
    for x, y in zip(whole, whole[1:]):
        out[place(again(joined([x, y]), int(quality._PAIR)))] += 1
        if x == y:
            out[place(int(quality._TWICE))] += 1
    return out


def test_features_one_by_one():
    texts = ["The river ünder 😀 the the bridge", "", "a", None, " \n", "ab  cd\tef"]
    for c in chunks(pa.array(texts)):
        for text, (place, times) in zip(texts, quality._of_texts(quality.Features(c, 12))):
            assert dict(zip(place.tolist(), times.tolist())) == dict(plain_features(text or "", 12))


def test_a_step_lowers_the_loss_as_the_gradient_says():
    model = quality.Embeddings(50, 6, 1)
    model.outputs[:] = np.random.default_rng(2).normal(size=(2, 6))
    place, times = np.array([3, 7, 50]), np.array([2, 1, 1], np.float32)

    def loss(vectors, outputs):
        z = outputs @ ((times / times.sum()) @ vectors[place])
        return float(np.log(np.exp(z).sum()) - z[1])

    vectors, outputs = model.vectors.astype(float).copy(), model.outputs.astype(float).copy()
    model.learn(place, times, 1, 1e-3)
    for was, now, k in ((vectors, model.vectors, 0), (outputs, model.outputs, 1)):
        for at in ((3, 0), (7, 2), (50, 5)) if k == 0 else ((0, 1), (1, 4)):
            low, high = was.copy(), was.copy()
            low[at] -= 1e-5
            high[at] += 1e-5
            slope = (loss(*((high, outputs) if k == 0 else (vectors, high))) - loss(*((low, outputs) if k == 0 else (vectors, low)))) / 2e-5
            assert abs((was[at] - now[at]) / 1e-3 - slope) < 2e-3


def labelled(spark, n=600):
    r = random.Random(8)
    good = ["river", "stone", "morning", "walking", "bridge", "letter", "window"]
    rows = []
    for i in range(n):
        bad = r.random() < 0.3
        words = [r.choice(good) + ("$$$" if bad and r.random() < 0.5 else "") for _ in range(r.randrange(5, 60))]
        rows.append((i, " ".join(words), 0 if bad else 1))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")


def test_quality_tells_held_out_texts(spark):
    docs, labels = labelled(spark)
    out = quality.judge(docs, labels).join(labels, "doc_id")
    held = out.filter("held_out")
    assert held.count() > 100 and held.filter("predicted = quality").count() >= 0.97 * held.count()
    assert out.filter("score < 0 or score > 1").count() == 0
    assert out.select("doc_id", "held_out").filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)).eqNullSafe(1) != F.col("held_out")).count() == 0


def test_quality_learns_nothing_from_held_out_labels(spark):
    docs, labels = labelled(spark, 300)
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = [sorted(tuple(r) for r in quality.judge(docs, x).collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_quality_scores_are_the_model_s(spark):
    """The collapsed scorer against the average of vectors and the softmax."""
    docs, labels = labelled(spark, 200)
    model = quality.train(quality.labelled_sample(docs, labels))
    vectors = dict(zip(model["place"].tolist(), model["vector"]))
    mark = 1 << quality.BITS
    rows = docs.collect()
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for c in chunks(pa.array([r["text"] for r in rows])):
        for r, (place, times) in zip(rows, quality._of_texts(quality.Features(c, quality.BITS))):
            own = [(vectors[p], t) for p, t in zip(place.tolist(), times) if p in vectors and p != mark] + [(vectors[mark], 1)]
            z = model["outputs"] @ (sum(v * t for v, t in own) / sum(t for _, t in own))
            assert abs(got[r["doc_id"]] - np.exp(z[1]) / np.exp(z).sum()) < 1e-5


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, None), (4, 1), (12, 0), (12, 1), (None, 1)], "doc_id long, quality int")
    out = quality.judge(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in out)
    assert len({r["score"] for r in out if r["doc_id"] in (5, 6, 7)}) == 1  # no words
    assert quality.judge(empty, labels).collect() == []
    none = quality.judge(odd, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
