"""Removal of byte strings that repeat an earlier document, by distributed prefix doubling.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller id.
Classic prefix doubling ranks every position by ever longer prefixes: the rank at 2h is that of the
pair of ranks at i and i + h; what is unique is done. Ranking all positions of a corpus moves tens of
bytes per byte, so here

* ranks are digests, doubled inside a text (2, 4, 8, ... bytes) without any exchange, since only
  equality matters here, not order;
* only sampled positions are exchanged: of the short prefixes in each window of LENGTH bytes the least
  stands for it (a choice that depends on the content alone, so equal windows choose alike). One sample
  stands for a run of neighbouring windows, about (LENGTH - h) / 2 of them;
* first rerank: samples are sorted by the rank of their prefix and that of their whole run. A run that
  an earlier document has as well is removed whole; a prefix that no other document has is unique and
  done; the first holder of a run whose prefix also has other runs stays open;
* second rerank: the windows of open runs are sorted by their rank at LENGTH bytes, past the threshold.

Nothing is lost: equal windows have equal samples at the same place, so they meet either as equal
runs or as open ones. Documents are dealt into batches; a batch asks about each distinct key once, with
its least document, so a line that a third of all documents hold costs one key per batch.
Keys are 128 bits.

Defined results: a null or empty text has no bytes and no spans; texts shorter than LENGTH stay; a null
id counts as larger than all others; rows of one id don't remove each other; an empty table gives an
empty result; other columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaywork.llm.common import release, stage, table
from assaywork.llm.textkernel import BYTE, JOIN, chunks, mix

LENGTH = 50
#: Bytes of text of a batch, and keys of a bucket, about.
BATCH, BUCKET = 1 << 20, 200_000
#: Bytes that are worked on at once, unless a single text is longer.
PIECE = 1 << 18
_LAST = np.int64(2**63 - 1)
ASK = "bucket int, batch int, a binary, b binary, doc binary"
ANSWER = "batch int, round int, bucket int, code binary"


class Ranks:
    """Digests of the prefixes of every position, by doubling."""

    def __init__(self, data: np.ndarray):
        self.level = [BYTE[data]]
        self.n = len(data)

    def of(self, length: int) -> np.ndarray:
        """Digest of ``length`` bytes from each position that has so many."""
        while 1 << len(self.level) <= length:
            h, k = self.level[-1], 1 << (len(self.level) - 1)
            self.level.append(h[:-k] * JOIN[len(self.level)] + h[k:] if len(h) > k else h[:0])
        size = max(0, self.n - length + 1)
        total, at = np.zeros(size, np.uint64), 0
        for bit in reversed(range(length.bit_length())):
            if length >> bit & 1:
                total = total * JOIN[20 + bit] + self.level[bit][at : at + size]
                at += 1 << bit
        return total


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    k = 1
    while 2 * k <= width:
        v = np.minimum(v[:-k], v[k:])
        k *= 2
    return np.minimum(v[: len(v) - (width - k)], v[width - k :]) if width > k else v


class Runs:
    """Runs of windows of a batch that share a sample: ``doc`` (index in the batch), ``start`` (of the
    first window in its text), ``count`` of windows, and the keys ``a`` (prefix and part of the run) and
    ``b`` (run)."""

    def __init__(self, text: pa.Array, length: int):
        self.length, self.prefix = length, max(1, 2 * length // 5)
        width = length - self.prefix + 1
        parts: list[list[np.ndarray]] = [[], [], [], [], []]
        self.pieces = []
        for c in chunks(text, PIECE):
            n = len(c.data)
            if n < length:
                continue
            r = Ranks(c.data)
            name = mix(r.of(self.prefix))
            place = np.arange(len(name), dtype=np.uint64)
            # the upper half of the digest decides, then the place: the same choice in equal windows
            least = sliding_least(name >> np.uint64(32) << np.uint64(32) | place, width) & np.uint64(0xFFFFFFFF)
            valid = np.ones(n + 1, bool)
            for lo, hi in zip(c.offsets[:-1].tolist(), c.offsets[1:].tolist()):
                valid[max(lo, hi - length + 1) : hi] = False
            valid = valid[: len(least)]
            first = valid.copy()
            first[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
            start = np.flatnonzero(first)
            if not len(start):
                continue
            last = valid.copy()
            last[:-1] &= first[1:] | ~valid[1:]
            end = np.flatnonzero(last)
            whole = r.of(length)
            anchor = least[start].astype(np.int64)
            shape = ((end - start) * (2 * length) + (anchor - start)).astype(np.uint64)
            b = mix(whole[start] * JOIN[44] + whole[end] * JOIN[45] + shape)
            doc = np.searchsorted(c.offsets, start, "right") - 1
            # samples are least values, so they are mixed again to fill the buckets evenly
            for p, v in zip(parts, (doc + c.lo, start - c.offsets[doc], end - start + 1, mix(name[anchor] + JOIN[48]), b)):
                p.append(v)
        self.doc, self.start, self.count, self.a, self.b = (np.concatenate(p) if p else np.zeros(0, t) for p, t in zip(parts, (np.int64, np.int64, np.int64, np.uint64, np.uint64)))


def distinct(a: np.ndarray, b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (a, b) in order, the least document of each, and each row's place among them."""
    order = np.lexsort((b, a))
    x, y = a[order], b[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    at = np.empty(len(x), np.int64)
    at[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    least = np.minimum.reduceat(doc[order], first) if len(first) else np.zeros(0, np.int64)
    return x[first], y[first], least, at


def _bucket_edges(a: np.ndarray, buckets: int) -> np.ndarray:
    """Keys are in order of a; a bucket is a range of a."""
    step = (1 << 64) // buckets + 1
    return np.searchsorted(a, np.array([min(i * step, (1 << 64) - 1) for i in range(1, buckets)], np.uint64)) if buckets > 1 else np.zeros(0, np.int64)


def _asked(batch: int, keys: tuple[np.ndarray, np.ndarray, np.ndarray], buckets: int) -> pa.Table:
    a, b, doc = keys
    edges = np.concatenate([[0], _bucket_edges(a, buckets), [len(a)]])
    used = [i for i in range(buckets) if edges[i] < edges[i + 1]]
    cut = lambda v: pa.array([v[edges[i] : edges[i + 1]].tobytes() for i in used], pa.binary())
    return pa.table([pa.array(used, pa.int32()), pa.array([batch] * len(used), pa.int32()), cut(a), cut(b), cut(doc)], names=["bucket", "batch", "a", "b", "doc"])


def resolve(asked: pa.Table, round_: int) -> pa.Table:
    """What all batches ask of a bucket, answered: 1 if an earlier document has the same key; else, in
    the first round, 2 if the prefix has other keys in another document; else 0."""
    get = lambda name, t: [np.frombuffer(x.as_buffer(), t) for x in asked[name]]
    parts = get("a", np.uint64)
    sizes = [len(p) for p in parts]
    a, b, doc = (np.concatenate(p) for p in (parts, get("b", np.uint64), get("doc", np.int64)))
    order = np.lexsort((b, a))
    x, y, d = a[order], b[order], doc[order]
    group, key = np.ones(len(x), bool), np.ones(len(x), bool)
    group[1:] = x[1:] != x[:-1]
    key[1:] = group[1:] | (y[1:] != y[:-1])
    of_key = np.cumsum(key) - 1
    earliest = np.minimum.reduceat(d, np.flatnonzero(key))[of_key]
    code = (d > earliest).astype(np.uint8)
    if round_ == 1:
        at = np.flatnonzero(group)
        of_group = np.cumsum(group) - 1
        several = np.add.reduceat(key.astype(np.int64), at)[of_group] > 1
        mixed = np.minimum.reduceat(d, at)[of_group] < np.maximum.reduceat(d, at)[of_group]
        code[(code == 0) & several & mixed] = 2
    out = np.empty(len(x), np.uint8)
    out[order] = code
    cuts = np.cumsum([0, *sizes])
    n = len(sizes)
    return pa.table([asked["batch"], pa.array([round_] * n, pa.int32()), asked["bucket"], pa.array([out[cuts[i] : cuts[i + 1]].tobytes() for i in range(n)], pa.binary())], names=["batch", "round", "bucket", "code"])


class Batch:
    """The documents of a batch with what is known of their runs."""

    def __init__(self, docs: pa.Table, length: int):
        docs = docs.sort_by([("doc_id", "ascending"), ("digest", "ascending")])
        self.docs, self.length = docs, length
        self.text = docs["text"].combine_chunks()
        self.id = pc.fill_null(docs["doc_id"], int(_LAST)).to_numpy()
        self.runs = Runs(self.text, length)
        self.own = self.id[self.runs.doc]
        self.a, self.b, self.least, self.at = distinct(self.runs.a, self.runs.b, self.own)

    @staticmethod
    def answers(found: pa.Table, round_: int) -> np.ndarray:
        own = found.filter(pc.equal(found["round"], round_)).sort_by("bucket")
        return np.frombuffer(b"".join(own["code"].to_pylist()), np.uint8)

    def after_first(self, found: pa.Table) -> None:
        """gone: runs removed whole; open: those whose windows are asked about."""
        code = self.answers(found, 1)[self.at]
        later = self.own > self.least[self.at]
        self.gone, self.open = later | (code == 1), ~later & (code == 2)

    def windows(self) -> None:
        r, pick = self.runs, np.flatnonzero(self.open)
        n = r.count[pick]
        self.w_run = np.repeat(pick, n)
        self.w_start = np.repeat(r.start[pick], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b = np.zeros(len(self.w_run), np.uint64), np.zeros(len(self.w_run), np.uint64)
        w_doc = r.doc[self.w_run]
        for c in chunks(self.text, PIECE):
            lo, hi = np.searchsorted(w_doc, [c.lo, c.hi])
            if lo < hi:
                at = c.offsets[w_doc[lo:hi] - c.lo] + self.w_start[lo:hi]
                ranks = Ranks(c.data)
                a[lo:hi] = mix(ranks.of(self.length)[at])
                half = ranks.of(self.length // 2)
                b[lo:hi] = mix(half[at] * JOIN[46] + half[at + self.length - self.length // 2] * JOIN[47])
        self.wa, self.wb, self.w_least, self.w_at = distinct(a, b, self.own[self.w_run])

    def removed(self, found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, start, end) of the maximal removed spans, in order."""
        code = self.answers(found, 2)[self.w_at] if len(self.w_at) else np.zeros(0, np.uint8)
        late = (code == 1) | (self.own[self.w_run] > self.w_least[self.w_at])
        g = np.flatnonzero(self.gone)
        r = self.runs
        doc = np.concatenate([r.doc[g], r.doc[self.w_run[late]]])
        start = np.concatenate([r.start[g], self.w_start[late]])
        end = np.concatenate([r.start[g] + r.count[g] - 1 + self.length, self.w_start[late] + self.length])
        order = np.lexsort((start, doc))
        doc, start, end = doc[order], start[order], end[order]
        if not len(doc):
            return doc, start, end
        # running maximum of the ends, kept apart per document by an offset
        far = np.int64(max(int(end.max()), 1) + 1)
        reach = np.maximum.accumulate(end + doc * far) - doc * far
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1
        return doc[first], start[first], reach[last]


def remove_repeats(docs: DataFrame, length: int = LENGTH, batch_bytes: int = BATCH, bucket_keys: int = BUCKET) -> DataFrame:
    """doc_id, n_bytes, spans (array<struct<start,end>> of removed bytes), kept (the bytes left). One row
    per row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    batches = max(1, math.ceil(total / batch_bytes))
    buckets = max(1, math.ceil(total / (length * 3 / 10) / bucket_keys))
    digest = F.xxhash64("text")
    dealt = docs.select(F.col("doc_id").cast("long"), "text").withColumn("digest", digest)
    dealt = dealt.withColumn("batch", F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("digest"))), F.lit(batches)).cast("int"))

    def ask_runs(own: pa.Table) -> pa.Table:
        b = Batch(own, length)
        return _asked(own["batch"][0].as_py(), (b.a, b.b, b.least), buckets)

    def ask_windows(own: pa.Table, found: pa.Table) -> pa.Table:
        b = Batch(own, length) if own.num_rows else None
        if b is None:
            return _asked(0, (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),), 1)
        b.after_first(found)
        b.windows()
        return _asked(own["batch"][0].as_py(), (b.wa, b.wb, b.w_least), buckets)

    def finish(own: pa.Table, found: pa.Table) -> pa.Table:
        ids, sizes, spans, kept = [], [], [], []
        if own.num_rows:
            b = Batch(own, length)
            b.after_first(found)
            b.windows()
            doc, start, end = b.removed(found)
            cuts = np.searchsorted(doc, np.arange(own.num_rows + 1)).tolist()
            ids, start, end = b.docs["doc_id"].to_pylist(), start.tolist(), end.tolist()
            for i, text in enumerate(b.text):
                data = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
                own_spans, left, at = [], [], 0
                for k in range(cuts[i], cuts[i + 1]):
                    own_spans.append({"start": start[k], "end": end[k]})
                    left.append(data[at : start[k]])
                    at = end[k]
                left.append(data[at:])
                sizes.append(len(data))
                spans.append(own_spans)
                kept.append(b"".join(left))
        return pa.table([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    by_bucket = lambda asked, n: asked.groupBy("bucket").applyInArrow(lambda t: resolve(t, n), ANSWER)
    answers = stage(by_bucket(dealt.groupBy("batch").applyInArrow(ask_runs, ASK), 1))
    release(spark)
    second = stage(by_bucket(dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(ask_windows, ASK), 2))
    release(spark)
    known = answers.unionByName(second)
    return dealt.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(finish, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 50 bytes removed from all ``documents``."""
    d = remove_repeats(table(spark, sf_dir, "documents"))
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return d.select("doc_id", "n_bytes", size.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
ORACLES: dict[str, str] = {}
