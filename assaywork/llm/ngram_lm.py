"""Language-model scoring with an n-gram trie of Elias-Fano levels.

The model is interpolated over three orders: p(w | u, v) = (c(u, v, w) + K3 p(w | v)) / (c(u, v) + K3),
p(w | v) = (c(v, w) + K2 p(w)) / (c(v) + K2), over the add-half unigram p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)).
Tries, one per shard, keep first words, pairs and triples: monotone pointers and context-relative successors as
Elias-Fano sequences, and 16-bit codes of the smoothed log probabilities c / (c(context) + K) and of the weight
K / (c + K) that a pair leaves to the order below. A task builds its shard's trie, maps it from a file and
searches successors in it.

Texts are dealt into batches. A batch asks the buckets of words, then the shards of triples, about each distinct
word or triple once, with its count in the batch's training texts; the answers are counts over all training
texts, then the codes. So a word or triple that is everywhere costs one entry per batch. A shard holds all that
follows its first words; the pairs of a frequent first word are dealt by both words, and the triples of a pair of
two frequent words by all three: their level holds the quantised count, and the batch divides by the pair's.
All training texts are counted and every text is scored whole; what is exchanged grows with the input.

Defined results: a null or empty text is the end token alone; words that no training text has are
unknown and get the unigram's share of a count of 0; with no training text every token is unknown;
rows with a null id are scored and are not held out; repeated rows are scored alike, and learnt from as
often as they are there; an empty table gives an empty result; other columns play no part. A text is worked on
whole, in one task, at about 150 bytes of memory a byte of a text that is longer than a batch.
Words are told apart by 64-bit digests.
"""

from __future__ import annotations

import math
import os
import struct
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaywork.llm.common import crc_remainder, release, stage, table
from assaywork.llm.elias_fano import Trie
from assaywork.llm.textkernel import WHITE, chunks, words

#: Bytes of text of a batch; words of a bucket and triples of a shard, about.
BATCH, BUCKET, SHARD = 2 << 20, 500_000, 800_000
#: Weights of the order below, as counts.
K2, K3 = 100.0, 4.0
#: Codes: log10 of a value, from -RANGE to RANGE in 65534 steps; 0 for none.
RANGE = 16.0
END = np.uint64(0x0E4D0E4D0E4D0E4D)
ASKED = "part int, batch int, data binary"
COUNTED = "batch int, part int, data binary, tokens long, known long"
MODEL = "shard int, pairs long, triples long, trie binary"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers from 0 on, each as the planes of its bytes, as many as the largest needs."""
    out = []
    for v in arrays:
        planes = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
        body = pa.compress(np.ascontiguousarray(v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T), codec="zstd", asbytes=True)
        out += [struct.pack("<IIB", len(v), len(body), planes), body]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n, size, planes = struct.unpack_from("<IIB", data, at)
        at += 9
        v = np.zeros((n, 8), np.uint8)
        if n:
            v[:, :planes] = np.frombuffer(pa.decompress(data[at : at + size], decompressed_size=n * planes, codec="zstd"), np.uint8).reshape(planes, n).T
        out.append(v.view("<u8").ravel())
        at += size
    return out


def encode(value: np.ndarray) -> np.ndarray:
    """Codes of values; 0 for 0."""
    with np.errstate(divide="ignore"):
        code = 1 + np.rint((np.log10(value) + RANGE) * (65534 / (2 * RANGE)))
    return np.where(value > 0, np.clip(code, 1, 65535), 0).astype(np.uint16)


def decode(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** ((code.astype(float) - 1) * (2 * RANGE / 65534) - RANGE), 0.0)


def _runs(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the runs of equal values, and one past the last of each."""
    first = np.flatnonzero(np.diff(v, prepend=v[0] - 1)) if len(v) else np.zeros(0, np.int64)
    return first, np.append(first[1:], len(v)).astype(np.int64)


def _rows(part: np.ndarray, batch: int, data: list[bytes]) -> pa.Table:
    return pa.table([pa.array(part, pa.int32()), pa.array([batch] * len(data), pa.int32()), pa.array(data, pa.binary())], names=["part", "batch", "data"])


class Batch:
    """Tokens of a batch's texts: ``word``: the distinct digests; ``at``: each token's place among
    them; ``doc``: each token's text; ``learnt``: whether its text is learnt from."""

    def __init__(self, docs: pa.Table, buckets: int):
        self.docs = docs = docs.sort_by([("doc_id", "ascending"), ("digest", "ascending")])
        tokens, owner = [], []
        for c in chunks(docs["text"]):
            w = words(c, WHITE, fold=True)
            n = c.hi - c.lo
            out = np.full(len(w.doc) + n, END)
            out[np.arange(len(w.doc)) + w.doc] = w.hash
            tokens.append(out)
            owner.append(np.repeat(np.arange(c.lo, c.hi), np.bincount(w.doc, minlength=n) + 1))
        self.doc = np.concatenate(owner)
        self.word, self.at = np.unique(np.concatenate(tokens), return_inverse=True)
        self.learnt = docs["learn"].to_numpy()[self.doc]
        step = np.uint64((1 << 64) // buckets + 1 if buckets > 1 else (1 << 64) - 1)
        self.bucket = (self.word // step).astype(np.int64)

    def ask_words(self, batch: int) -> pa.Table:
        count = np.bincount(self.at, self.learnt, len(self.word)).astype(np.uint64)
        first, end = _runs(self.bucket)
        return _rows(self.bucket[first], batch, [pack(np.diff(self.word[a:b], prepend=np.uint64(0)), count[a:b]) for a, b in zip(first, end)])

    def learn_words(self, found: pa.Table, total: int, known: int) -> None:
        """count and id (-1: unknown) of each distinct word; log10 of the unigram."""
        parts = [unpack(x) for x in found.sort_by("part")["data"].to_pylist()]
        self.count = np.concatenate([p[0] for p in parts]).astype(np.int64)
        self.id = np.full(len(self.count), -1, np.int64)
        self.id[self.count > 0] = np.concatenate([p[1] for p in parts])
        self.prior = np.log10((self.count + 0.5) / (total + 0.5 * (known + 1)))

    def triples(self, starts: int, start_id: int, shards: int, hot: float) -> None:
        """Distinct triples and pairs, and what is asked of which shard. Before a text's first token
        stand two starts, which have been met ``starts`` times; after its end stands nothing."""
        n = len(self.word)
        start, none, m = n, n + 1, n + 2
        self.all_ids, self.all_counts = np.append(self.id, [start_id, start_id + 1]), np.append(self.count, [starts, 0])
        first = np.ones(len(self.doc), bool)
        first[1:] = self.doc[1:] != self.doc[:-1]
        second = np.append(False, first[:-1]) & ~first
        self.last = np.append(np.flatnonzero(first)[1:], len(first)) - 1
        self.before = np.where(first, start, np.roll(self.at, 1))
        a = np.concatenate([np.where(first | second, start, np.roll(self.at, 2)), self.before[self.last]])
        b = np.concatenate([self.before, self.at[self.last]])
        c = np.concatenate([np.where(self.id[self.at] < 0, none, self.at), np.full(len(self.last), none)])
        pair = a * m + b
        pairs = None
        if m >= 1 << 21:  # the product of three would not fit
            pairs, pair = np.unique(pair, return_inverse=True)
        triple, self.triple = np.unique(pair * m + c, return_inverse=True)
        pair, c = triple // m, triple % m
        new, end = _runs(pair)
        self.pair_of = np.repeat(np.arange(len(new)), end - new)
        pair = pair[new] if pairs is None else pairs[pair[new]]
        a, b = pair // m, pair % m
        count = np.bincount(self.triple, np.append(self.learnt, self.learnt[self.last]), len(triple)).astype(np.int64)
        of_pair = np.add.reduceat(count, new) if len(new) else count
        ids, big = self.all_ids, self.all_counts > hot
        known = (ids[a] >= 0) & (ids[b] >= 0)
        spread = known & big[a] & big[b]
        # plain triples; those of spread pairs; the spread pairs themselves
        plain = np.flatnonzero((known & ~spread)[self.pair_of])
        apart = np.flatnonzero(spread[self.pair_of] & (c != none))
        whole = np.flatnonzero(spread)
        mixed = lambda x, y: (x ^ (y.astype(np.uint64) * _ODD >> np.uint64(7))) * _ODD
        key = ids[a].astype(np.uint64) * _ODD
        key = np.where(big[a], mixed(key, ids[b]), key)
        p = np.concatenate([self.pair_of[plain], self.pair_of[apart], whole])
        w = np.concatenate([c[plain], c[apart], np.full(len(whole), none)])
        key = np.concatenate([key[self.pair_of[plain]], mixed(key[self.pair_of[apart]], ids[c[apart]]), key[whole]])
        part = ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        section = np.repeat([0, 1, 0], [len(plain), len(apart), len(whole)])[order]
        self.part, self.asked_pair = part[order], p[order]
        self.asked_triple = np.concatenate([plain, apart, np.full(len(whole), -1)])[order]
        self.asked_word, self.asked_count = ids[w[order]], np.concatenate([count[plain], count[apart], of_pair[whole]])[order]
        # runs of one pair in one shard
        self.group, self.group_end = _runs((self.part * 2 + section) * (len(pair) + 1) + self.asked_pair)
        self.group_apart = section[self.group] == 1
        self.a, self.b, self.big = a, b, big

    def ask_triples(self, batch: int) -> pa.Table:
        data, g = [], self.group
        own_part, pair = self.part[g], self.asked_pair[g]
        # the start is twice a context, of the second start and of the first word
        context = self.all_counts[self.a] * (self.big[self.a] | (self.a == len(self.word)))
        first, end = _runs(own_part)
        sizes = self.group_end - g
        for lo, hi in zip(first, end):
            u, ue = _runs(self.a[pair[lo:hi]])
            one = pair[lo:hi][u]
            x, y = g[lo], self.group_end[hi - 1]
            data.append(pack(self.all_ids[self.a[one]], context[one], ue - u, self.all_ids[self.b[pair[lo:hi]]], self.group_apart[lo:hi], sizes[lo:hi], self.asked_word[x:y], self.asked_count[x:y]))
        return _rows(own_part[first], batch, data)

    def scores(self, codes: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: tokens, known tokens, base score, score."""
        n = self.docs.num_rows
        parts = [unpack(x) for x in codes.sort_by("part")["data"].to_pylist()]
        left, of_triple = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.uint64) for k in range(2))
        bow, p3 = np.ones(len(self.a)), np.zeros(len(self.pair_of))
        met = ~self.group_apart & (left > 0)
        bow[self.asked_pair[self.group[met]]] = decode(left[met])
        p2 = (K3 / bow - K3) / (self.all_counts[self.a] + K2)  # what a pair leaves tells its count
        pick = self.asked_triple >= 0
        p3[self.asked_triple[pick]] = decode(of_triple[pick])
        apart = self.asked_triple[np.repeat(self.group_apart, self.group_end - self.group)]
        p3[apart] *= bow[self.pair_of[apart]] / K3  # counts, over the pair's and K3
        at = np.append(self.triple[1 : len(self.doc)], 0)  # the next token's triple starts with this one's pair
        at[self.last] = self.triple[len(self.doc) :]
        context = self.all_counts[self.before]
        low = p2[self.pair_of[at]] + K2 / (context + K2) * 10.0 ** self.prior[self.at]
        own = self.triple[: len(self.doc)]
        score = np.log10(p3[own] + bow[self.pair_of[own]] * low)
        per = lambda v: np.bincount(self.doc, v, n)
        return np.bincount(self.doc, minlength=n), per((self.count > 0)[self.at].astype(float)).astype(np.int64), per(self.prior[self.at]), per(score)


def count_words(asked: pa.Table, buckets: int) -> pa.Table:
    """Counts over all batches of a bucket's words, and ids of those that were met in training, the
    frequent ones small; one answer per batch, and one row (batch -1) with the bucket's totals."""
    parts = [unpack(x) for x in asked["data"].to_pylist()]
    word = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
    cuts = np.cumsum([0, *map(len, word)])
    distinct, at = np.unique(np.concatenate(word), return_inverse=True)
    total = np.bincount(at, np.concatenate([p[1] for p in parts]).astype(float), len(distinct)).astype(np.int64)
    part, ids = asked["part"][0].as_py(), np.empty(len(total), np.int64)
    ids[np.argsort(-total, kind="stable")] = np.arange(len(total)) * buckets + part
    data = []
    for x, y in zip(cuts[:-1], cuts[1:]):
        own = total[at[x:y]]
        data.append(pack(own, ids[at[x:y]][own > 0]))
    n = len(parts)
    return pa.table([
        pa.array([*asked["batch"].to_pylist(), -1], pa.int32()), pa.array([part] * (n + 1), pa.int32()), pa.array([*data, None], pa.binary()),
        pa.array([None] * n + [int(total.sum())], pa.int64()), pa.array([None] * n + [int((total > 0).sum())], pa.int64()),
    ], names=[c.split()[0] for c in COUNTED.split(", ")])


class Shard:
    """What all batches ask of a shard: distinct first words ``u``, pairs (``pair_u``, ``v``) and
    triples (``triple_pair``, ``w``), each in order, with counts; and where each question is among them."""

    def __init__(self, asked: pa.Table):
        parts = [[x.astype(np.int64) for x in unpack(d)] for d in asked["data"].to_pylist()]
        u, context, pairs, v, apart, triples, w, count = (np.concatenate(p) for p in zip(*parts))
        self.pair_cuts, self.triple_cuts = np.cumsum([0, *[len(p[3]) for p in parts]]), np.cumsum([0, *[len(p[6]) for p in parts]])
        self.u, at = np.unique(u, return_inverse=True)
        hot = np.zeros(len(self.u), np.int64)
        np.maximum.at(hot, at, context)
        m = int(v.max()) + 1 if len(v) else 1
        pair, self.pair_at = np.unique(np.repeat(at, pairs) * m + v, return_inverse=True)
        self.pair_u, self.v = pair // m, pair % m
        m = int(w.max()) + 1 if len(w) else 1
        triple, self.triple_at = np.unique(np.repeat(self.pair_at, triples) * m + w, return_inverse=True)
        self.triple_pair, self.w = triple // m, triple % m
        # a pair's triples are all apart or none is, but for the one that stands for the pair itself, whose word no other has
        of_apart = np.zeros(len(triple), bool)
        of_apart[self.triple_at] = np.repeat(apart > 0, triples)
        self.count = np.bincount(self.triple_at, count, len(triple)).astype(np.int64)
        # triples dealt apart from their pair don't count for it
        self.pair_count = np.bincount(self.triple_pair, self.count * ~of_apart, len(pair)).astype(np.int64)
        total = np.bincount(self.pair_u, self.pair_count, len(self.u))
        self.context = np.where(hot > 0, hot, total)
        self.of_apart = of_apart

    def trie(self) -> Trie:
        """Of what was met in training."""
        t = self.count > 0
        met = np.zeros(len(self.v), bool)
        met[self.triple_pair[t]] = True
        u = np.zeros(len(self.u), bool)
        u[self.pair_u[met]] = True
        place = lambda keep: np.cumsum(keep) - 1
        c = self.pair_count[met].astype(float)
        pair = np.stack([encode(c / (self.context[self.pair_u[met]] + K2)), encode(np.where(c > 0, K3 / (c + K3), 0))], 1)
        third = np.where(self.of_apart, self.count, self.count / (self.pair_count[self.triple_pair] + K3))[t]
        return Trie.of(self.u[u], [(place(u)[self.pair_u[met]], self.v[met]), (place(met)[self.triple_pair[t]], self.w[t])], [pair, encode(third)])

    def answers(self, trie: Trie) -> list[bytes]:
        """For each batch the codes of what its pairs leave, and of its triples."""
        u = trie.find(0, self.u, self.u)
        pair = trie.find(1, u[self.pair_u], self.v)
        triple = trie.find(2, pair[self.triple_pair], self.w)
        codes = [np.append(c, np.zeros((1, c.shape[1]), np.uint16), 0) for c in trie.codes]  # a last row for -1
        of_pair, of_triple = codes[0][pair], codes[1][triple][:, 0]
        out = []
        for a, b, x, y in zip(self.pair_cuts[:-1], self.pair_cuts[1:], self.triple_cuts[:-1], self.triple_cuts[1:]):
            out.append(pack(of_pair[self.pair_at[a:b], 1], of_triple[self.triple_at[x:y]]))
        return out


def answer(asked: pa.Table) -> pa.Table:
    """The codes that each batch asks of a shard, by successor search in its mapped trie."""
    shard = Shard(asked)
    handle, path = tempfile.mkstemp(suffix=".trie")
    try:
        os.write(handle, shard.trie().to_bytes())
        os.close(handle)
        mapped = np.memmap(path, np.uint8, "r")
        data = shard.answers(Trie.from_buffer(mapped))
        del mapped
    finally:
        os.unlink(path)
    return pa.table([asked["part"], asked["batch"], pa.array(data, pa.binary())], names=["part", "batch", "data"])


def keep(asked: pa.Table) -> pa.Table:
    """A shard's row of the model table."""
    trie = Shard(asked).trie()
    return pa.table([[asked["part"][0].as_py()], [trie.values[1].n], [trie.values[2].n], [trie.to_bytes()]], schema=pa.schema([("shard", pa.int32()), ("pairs", pa.int64()), ("triples", pa.int64()), ("trie", pa.binary())]))


def fit_and_score(docs: DataFrame, batch_bytes: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """(scores, model). ``docs``: doc_id, text, learn (boolean). scores: doc_id, n_tokens, n_known,
    train_tokens, base_score, score of each row; model: shard, pairs, triples, trie, made when it's read."""
    spark = docs.sparkSession
    size = docs.select(F.sum(F.octet_length("text")), F.sum(F.col("learn").cast("long"))).first()
    total_bytes, starts = size[0] or 0, size[1] or 0
    batches = max(1, math.ceil(total_bytes / batch_bytes))
    buckets, shards = max(1, math.ceil(total_bytes / 40 / BUCKET)), max(1, math.ceil(total_bytes / 6 / SHARD))
    dealt = docs.select(F.col("doc_id").cast("long"), "text", "learn").withColumn("digest", F.xxhash64("text"))
    dealt = dealt.withColumn("batch", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("digest"))), F.lit(batches)).cast("int"))
    number = lambda t: t["batch"][0].as_py()

    counted = stage(dealt.groupBy("batch").applyInArrow(lambda t: Batch(t, buckets).ask_words(number(t)), ASKED).groupBy("part").applyInArrow(lambda t: count_words(t, buckets), COUNTED))
    release(spark)
    sums = counted.filter("batch = -1").agg(F.sum("tokens"), F.sum("known"), F.max("known")).first()
    total, known, start_id = sums[0] or 0, sums[1] or 0, ((sums[2] or 0) + 1) * buckets
    hot = total / shards / 4
    answers = counted.filter("batch >= 0").select("batch", "part", "data")

    def learnt(own: pa.Table, found: pa.Table) -> Batch:
        b = Batch(own, buckets)
        b.learn_words(found, total, known)
        b.triples(starts, start_id, shards, hot)
        return b

    def ask(own: pa.Table, found: pa.Table) -> pa.Table:
        return learnt(own, found).ask_triples(number(own)) if own.num_rows else _rows(np.zeros(0), 0, [])

    asked = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(ask, ASKED)
    codes = stage(asked.groupBy("part").applyInArrow(answer, ASKED))
    release(spark)
    both = answers.withColumn("code", F.lit(False)).unionByName(codes.withColumn("code", F.lit(True)))

    def finish(own: pa.Table, found: pa.Table) -> pa.Table:
        names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not own.num_rows:
            return pa.table([pa.array([], t) for t in (*[pa.int64()] * 4, pa.float64(), pa.float64())], names=names)
        b = learnt(own, found.filter(pc.invert(found["code"])))
        n, k, base, score = b.scores(found.filter(found["code"]))
        return pa.table([b.docs["doc_id"], pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(np.full(len(n), total, np.int64)), pa.array(base), pa.array(score)], names=names)

    scores = dealt.groupBy("batch").cogroup(both.groupBy("batch")).applyInArrow(finish, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scores, asked.groupBy("part").applyInArrow(keep, MODEL)


def op9_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learning from those that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(crc_remainder("doc_id", 5) == 1, F.lit(False))
    scores, _ = fit_and_score(docs.withColumn("learn", ~held))
    return scores.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op9_ngram_lm": op9_ngram_lm}
ORACLES: dict[str, str] = {}
