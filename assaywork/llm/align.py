"""Links between the tokens of two tokenizers, by external spill counting.

Tokens of A and B are cut into groups wherever both end; all A-B pairs of a group are links. How good a link
is depends on the corpus: the number of documents that hold its pair of ids anywhere, and whether no other
partner of its A id is in more.

Map tasks encode documents and gather runs of a bounded amount of text. A run's pair-document records are
radix-partitioned by A id and spilt as sorted zstd frames, a row for each part. Runs of a part meet in nodes of
at most about ``FAN`` runs; a k-way heap merge takes one A id after another from all of them (side-major order),
so a node decodes a frame of each run at a time, counts each pair, knows the A id's highest count as soon as the
A id is through, and streams the pairs' contributions back to the runs' documents. With more runs than one node
takes, nodes first pass counts of distinct pairs on to nodes above, level by level; the topmost answers, and the
answers go down the same way. So no task's input grows with the corpus, however hot an A id is: a run holds a
pair once per document of its own, a node above once per node below.

Defined results: texts that are null or empty, or whose tokens' bytes are not a space and the text, have no tokens
and count in no pair; repeated rows and rows with a null id are documents of their own; an empty table gives an
empty result; other columns play no part. A text is worked on whole, in one task, at about 200 bytes of
memory a byte of a text that is longer than a megabyte; of a group with very many tokens the pairs of its
distinct ids are held, and no link is listed.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaywork.llm.common import drop_staged, stage, stage_measured, table
from assaywork.llm.ngram_lm import pack, unpack
from assaywork.llm.packing import tokenizer_path

#: Bytes of text and documents of a run, at most about; parts that a run is dealt to; records of a frame.
RUN, DOCS, PARTS, FRAME = 8 << 20, 50_000, 64, 50_000
#: Runs or nodes that a node merges, about.
FAN = 256
#: Pairs of tokens of a group that are listed as they are; of larger groups distinct ids are paired.
LISTED = 4096
ROWS = "run long, part int, data binary, doc int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string"
SPILT = "part int, child long, data binary"


def _byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the
    others in order from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoders:
    """Both tokenizers, and the bytes of each of their tokens. A's byte-level merges are run from its vocabulary as ranks,
    which gives the same ids where its merges are numbered in order; special tokens aren't known to it, so their
    strings are plain text."""

    def __init__(self, a_path: str, b_path: str):
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor
        from tiktoken import Encoding

        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, letters = model["vocab"], _byte_of_letter()
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        if [vocabulary[m] for m in merged] != [*range(256, 256 + len(merged))]:
            raise ValueError(f"{a_path}: merges aren't numbered in order")
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in vocabulary.items() if i < 256 + len(merged)}
        self.a = Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [t for t, _ in sorted(ranks.items(), key=lambda t: t[1])]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([*map(len, t)]) for t in (self.a_bytes, self.b_bytes))
        text = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        #: Ids with what stands behind them in a group, and at its end.
        self.said = (text(len(self.a_bytes), ","), text(len(self.a_bytes), "|")), (text(len(pieces), ","), text(len(pieces), ";"))

    def encode(self, text: str | None) -> tuple[list[int], list[int], int]:
        """Ids of A and B, and the bytes of a space and the text; nothing where tokens don't give these back."""
        if not text:
            return [], [], 0
        raw = (" " + text).encode()
        a, b = self.a.encode_ordinary(" " + text), self.b.encode(text)
        good = b"".join(map(self.a_bytes.__getitem__, a)) == raw == b"".join(map(self.b_bytes.__getitem__, b))
        return (a, b, len(raw)) if good else ([], [], 0)


@lru_cache(1)
def _encoders(a_path: str, b_path: str) -> Encoders:
    """One for all tasks that a Python worker runs."""
    return Encoders(a_path, b_path)


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each range, one range after another."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def aligned(texts: list[str | None], known: Encoders, digest: bool) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: tokens of A and B, groups and links (n x 4), and its groups as text or digest. Of each pair that
    a text holds: the text, the pair (a << 16 | b), and its links there."""
    a, b, size = zip(*map(known.encode, texts))
    n, start = len(texts), np.cumsum(size) - size
    n_a, n_b = np.array([*map(len, a)]), np.array([*map(len, b)])
    a, b = (np.fromiter(chain.from_iterable(x), np.int64, int(m.sum())) for x, m in ((a, n_a), (b, n_b)))
    a_end, b_end = np.cumsum(known.a_size[a]), np.cumsum(known.b_size[b])  # over all texts: both give back the same bytes
    ends = np.intersect1d(a_end, b_end, assume_unique=True)
    of_a, of_b = np.searchsorted(ends, a_end), np.searchsorted(ends, b_end)
    in_a, in_b = np.bincount(of_a, minlength=len(ends)), np.bincount(of_b, minlength=len(ends))
    doc = np.searchsorted(start + size, ends)
    counts = np.stack([n_a, n_b, np.bincount(doc, minlength=n), np.bincount(doc, in_a * in_b, n)], 1).astype(np.int64)
    first_a, first_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b

    (a_plain, a_last), (b_plain, b_last) = known.said
    out = np.empty(len(a) + len(b), object)
    out[np.arange(len(a)) + first_b[of_a]] = np.where(np.arange(len(a)) == (first_a + in_a - 1)[of_a], a_last[a], a_plain[a])
    out[np.arange(len(b)) + (first_a + in_a)[of_b]] = np.where(np.arange(len(b)) == (first_b + in_b - 1)[of_b], b_last[b], b_plain[b])
    cuts = np.append(0, np.cumsum(n_a + n_b))
    said = ["".join(out[x:y].tolist())[:-1] for x, y in zip(cuts[:-1], cuts[1:])]
    if digest:
        said = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in said]

    few = (in_a * in_b <= LISTED)[of_a]
    times = in_b[of_a][few]
    keys = [np.repeat(doc[of_a][few] << 32 | a[few] << 16, times) | b[ranges(first_b[of_a][few], times)]]
    links = [np.ones(len(keys[0]), np.int64)]
    for g in np.flatnonzero(in_a * in_b > LISTED):
        (x, m), (y, k) = (np.unique(t[f[g] : f[g] + c[g]], return_counts=True) for t, f, c in ((a, first_a, in_a), (b, first_b, in_b)))
        keys.append((doc[g] << 32 | x[:, None] << 16 | y).ravel())
        links.append((m[:, None] * k).ravel())
    held, back = np.unique(np.concatenate(keys), return_inverse=True)
    return counts, said, held >> 32, held & 0xFFFFFFFF, np.bincount(back, np.concatenate(links), len(held)).astype(np.int64)


def part_of(code: np.ndarray, parts: int) -> np.ndarray:
    """By A id alone, neighbours apart."""
    return (code >> 16) * 0x9E3779B1 % (1 << 32) * parts >> 32


def spill(code: np.ndarray, n: np.ndarray, doc: np.ndarray, links: np.ndarray, frame: int = FRAME) -> bytes:
    """Sorted distinct pairs, each with a count ``n``, and for each so many documents and links (or none at all), in
    frames that end where an A id does."""
    a = code >> 16
    last = np.flatnonzero(np.append(a[1:] != a[:-1], True)) + 1 if len(a) else np.zeros(0, np.int64)
    size = np.cumsum(n if len(doc) else np.ones(len(n), np.int64))[last - 1]
    out, x, r = [], 0, 0
    for y in last[np.append(np.flatnonzero(np.diff(size // frame)), len(size) - 1)] if len(size) else []:
        own = n[x:y]
        e = r + int(own.sum()) if len(doc) else r
        new = np.flatnonzero(np.append(True, a[x + 1 : y] != a[x : y - 1]))
        d = np.diff(doc[r:e], prepend=0)
        starts = (np.cumsum(own) - own)[:e - r]
        d[starts] = doc[r:e][starts]
        body = pack(np.diff(a[x:y][new], prepend=0), np.diff(np.append(new, y - x)), code[x:y] & 0xFFFF, own, d, links[r:e])
        out += [struct.pack("<I", len(body)), body]
        x, r = int(y), e
    return b"".join(out)


def segments(data: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, n, doc, links) of one A id after another; a frame is decoded when it's reached."""
    at = 0
    while at < len(data):
        (size,) = struct.unpack_from("<I", data, at)
        step, pairs, b, n, doc, links = (x.astype(np.int64) for x in unpack(data[at + 4 : at + 4 + size]))
        at += 4 + size
        end = np.cumsum(pairs)
        rows = np.append(0, np.cumsum(n)) if len(doc) else np.zeros(len(n) + 1, np.int64)
        if len(doc):  # documents ascend within a pair
            total = np.cumsum(doc)
            doc = total - np.repeat(total[rows[:-1]] - doc[rows[:-1]], n)
        for a, x, y in zip(np.cumsum(step).tolist(), (end - pairs).tolist(), end.tolist()):
            yield a, b[x:y], n[x:y], doc[rows[x] : rows[y]], links[rows[x] : rows[y]]


class Merged:
    """One A id of a merge: its partners, the runs that have it (``which``), their pairs one run after another (each
    pair's partner ``back``), and how many documents have each partner."""

    def __init__(self, found: list[tuple]):
        self.a = found[0][0]
        self.which, self.pairs = [f[1] for f in found], np.array([len(f[2]) for f in found])
        self.b, self.back = np.unique(np.concatenate([f[2] for f in found]), return_inverse=True)
        self.n = np.concatenate([f[3] for f in found])
        self.count = np.bincount(self.back, self.n).astype(np.int64)
        self.doc, self.links = np.concatenate([f[4] for f in found]), np.concatenate([f[5] for f in found])
        self.rows = np.array([len(f[4]) for f in found])


def merge(runs: list[bytes]) -> Iterator[Merged]:
    """The runs' A ids in order, by a heap over the runs' next ones."""
    own = lambda k, data: ((a, k, *rest) for a, *rest in segments(data))
    for _, found in groupby(heapq.merge(*[own(k, d) for k, d in enumerate(runs)], key=lambda f: f[0]), key=lambda f: f[0]):
        yield Merged(list(found))


def _table(part: int, child: list[int], data: list[bytes]) -> pa.Table:
    return pa.table([pa.array([part] * len(data), pa.int32()), pa.array(child, pa.int64()), pa.array(data, pa.binary())], names=["part", "child", "data"])


def totals(node: int, t: pa.Table) -> pa.Table:
    """What a node passes on: its distinct pairs with the number of documents below it that hold them."""
    code, count = [], []
    for m in merge(t["data"].to_pylist()):
        code.append(m.a << 16 | m.b)
        count.append(m.count)
    none = np.zeros(0, np.int64)
    return _table(t["part"][0].as_py(), [node], [spill(np.concatenate(code), np.concatenate(count), none, none)])


def settle(t: pa.Table, said: bytes | None, of_documents: bool) -> pa.Table:
    """What a node sends to those below it, from the counts and marks that it was ``said`` (none: it has them all).
    To nodes: count and mark of each of their pairs. To runs: of each document with a pair, its best links and the
    sum of counts over its links."""
    t = t.sort_by("child")
    runs = t["data"].to_pylist()
    given = [x.astype(np.int64) for x in unpack(said)] if said is not None else None
    at = 0
    out: list[list] = [[] for _ in runs]
    sums: list[list] = [[] for _ in runs]
    held = 0

    def add_up(k: int) -> None:
        doc, best, total = (np.concatenate(c) for c in zip(*sums[k]))
        own, back = np.unique(doc, return_inverse=True)
        # sums in two halves: a weight of bincount is exact up to 2**53
        parts = [np.bincount(back, x).astype(np.int64) for x in (best, total & 0xFFFFFF, total >> 24)]
        sums[k] = [(own, parts[0], parts[1] + (parts[2] << 24))]

    for m in merge(runs):
        count, best = m.count, m.count == m.count.max()
        if given is not None:
            count, best = (x[at : at + len(m.b)] for x in given)
            at += len(m.b)
        count, best = count[m.back], best[m.back].astype(np.int64)
        if not of_documents:
            for k, x, y in zip(m.which, np.cumsum(m.pairs) - m.pairs, np.cumsum(m.pairs)):
                out[k].append((count[x:y], best[x:y]))
            continue
        best, total = np.repeat(best, m.n) * m.links, np.repeat(count, m.n) * m.links
        for k, x, y in zip(m.which, np.cumsum(m.rows) - m.rows, np.cumsum(m.rows)):
            sums[k].append((m.doc[x:y], best[x:y], total[x:y]))
        held += len(total)
        if held > 1 << 20:
            held = 0
            for k in range(len(runs)):
                if sums[k]:
                    add_up(k)
    if of_documents:
        for k in range(len(runs)):
            if sums[k]:
                add_up(k)
                own, best, total = sums[k][0]
                out[k] = [(np.diff(own, prepend=0), best, total)]
    data = [pack(*(np.concatenate(c) for c in zip(*o))) if o else b"" for o in out]
    return _table(t["part"][0].as_py(), t["child"].to_pylist(), data)


def _passing_on(of_documents: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def pass_on(own: pa.Table, said: pa.Table) -> pa.Table:
        return settle(own, said["data"][0].as_py(), of_documents) if own.num_rows else _table(0, [], [])

    return pass_on


def encoded(docs: DataFrame, a_path: str, b_path: str, digest: bool, run_bytes: int = RUN, parts: int = PARTS) -> DataFrame:
    """Rows of documents (part null) with their run and number in it, and rows of runs, one for each part."""
    names = [c.split()[0] for c in ROWS.split(", ")]
    types = [pa.int64(), pa.int32(), pa.binary(), pa.int32(), *[pa.int64()] * 5, pa.string()]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, run = _encoders(a_path, b_path), TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        docs_in, bytes_in = 0, 0

        def spilt() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            doc, code, links = (np.concatenate(c) for c in zip(*held))
            held.clear()
            part = part_of(code, parts)
            order = np.argsort(part << 32 | code, kind="stable")  # documents stay in order
            doc, code, links, part = doc[order], code[order], links[order], part[order]
            for lo, hi in zip(*(lambda e: (e[:-1], e[1:]))(np.searchsorted(part, np.arange(parts + 1)))):
                if lo < hi:
                    new = np.flatnonzero(np.append(True, code[lo + 1 : hi] != code[lo : hi - 1]))
                    body = spill(code[lo:hi][new], np.diff(np.append(new, hi - lo)), doc[lo:hi], links[lo:hi])
                    yield pa.RecordBatch.from_arrays([pa.array([run]), pa.array([part[lo]], pa.int32()), pa.array([body], pa.binary()), *[pa.nulls(1, t) for t in types[3:]]], names)

        for batch in batches:
            sizes = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, sizes[lo] + (1 << 20), "right")) - 1)
                if docs_in and (bytes_in + sizes[hi] - sizes[lo] > run_bytes or docs_in + hi - lo > DOCS):
                    yield from spilt()
                    run, docs_in, bytes_in = run + 1, 0, 0
                counts, said, doc, code, links = aligned(batch["text"].slice(lo, hi - lo).to_pylist(), known, digest)
                held.append((doc + docs_in, code, links))
                n = hi - lo
                own = [pa.array(np.full(n, run)), pa.nulls(n, types[1]), pa.nulls(n, types[2]), pa.array(np.arange(docs_in, docs_in + n), pa.int32()), batch["doc_id"].slice(lo, n), *[pa.array(counts[:, k]) for k in range(4)], pa.array(said, pa.string())]
                yield pa.RecordBatch.from_arrays(own, names)
                docs_in, bytes_in, lo = docs_in + n, bytes_in + int(sizes[hi] - sizes[lo]), hi
        yield from spilt()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, ROWS)


def links(docs: DataFrame, a_path: str, b_path: str, digest: bool = False, run_bytes: int = RUN, parts: int = PARTS, fan: int = FAN) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of every document. ``groups``: A and B ids as
    ``a1,a2|b1;a3|b2,b3``, or with ``digest`` the SHA-256 of that ('' without tokens). The paths are found on every executor."""
    made, seen = stage_measured(encoded(docs, a_path, b_path, digest, run_bytes, parts), runs=F.count_if(F.col("doc") == 0))
    levels = [(made.filter("part is not null").select("part", F.col("run").alias("child"), "data"), max(1, math.ceil(seen["runs"] / fan)))]
    node = lambda nodes: F.pmod(F.xxhash64("child"), F.lit(nodes)).cast("long").alias("node")
    while levels[-1][1] > 1:
        below, nodes = levels[-1]
        up = stage(below.groupBy(node(nodes), "part").applyInArrow(lambda key, t: totals(key[0].as_py(), t), SPILT))
        levels.append((up, max(1, math.ceil(nodes / fan))))
    top, _ = levels[-1]
    flat = len(levels) == 1
    answers = top.groupBy("part").applyInArrow(lambda t: settle(t, None, flat), SPILT)
    for k in range(len(levels) - 2, -1, -1):
        below, nodes = levels[k]
        asked = below.withColumn("node", node(nodes))
        told = stage(answers).withColumnRenamed("child", "node")

        answers = asked.groupBy("part", "node").cogroup(told.groupBy("part", "node")).applyInArrow(_passing_on(k == 0), SPILT)
    answers = stage(answers)
    for up, _ in levels[1:]:
        drop_staged(up)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]

    def finish(own: pa.Table, found: pa.Table) -> pa.Table:
        sums = np.zeros((own.num_rows, 2), np.int64)
        own = own.sort_by("doc")
        for data in found["data"].to_pylist():
            step, best, total = (x.astype(np.int64) for x in unpack(data))
            sums[np.cumsum(step)] += np.stack([best, total], 1)
        return pa.table([*[own[c] for c in names], pa.array(sums[:, 0]), pa.array(sums[:, 1]), own["groups"]], names=[*names, "n_best", "count_sum", "groups"])

    rows = made.filter("part is null").drop("part", "data")
    return rows.groupBy("run").cogroup(answers.withColumnRenamed("child", "run").groupBy("run")).applyInArrow(finish, ", ".join(f"{c} long" for c in [*names, "n_best", "count_sum"]) + ", groups string")


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token links of all ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return links(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), digest=True).withColumnRenamed("groups", "groups_sha256")


QUERIES = {"op11_align": op11_align}
ORACLES: dict[str, str] = {}
