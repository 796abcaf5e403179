"""Packing documents into sequences by best-fit decreasing.

Tokenised pieces are dealt by digest into groups of a bounded number of pieces; each group is packed
on its own by best-fit decreasing. A segment tree over the remaining capacities finds the tightest
open sequence in log2(capacity) steps. A group of tens of thousands of pieces fills its sequences as
well as the whole would, up to a sequence or so a group.

Only lengths and checksums are shuffled, never ids or texts. Defined results: a null or empty text
is the single closing id; pieces of one document need not share a sequence; repeated rows are packed
once each; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaywork.llm.common import kept, lean, stage_in_small_batches, table

CAPACITY = 2048
#: Pieces of a group at most, about; a bound of the memory of a task.
GROUP = 40_000
#: Words whose ids a Python worker keeps, and as many older ones at most, about 300 bytes each.
CACHE = 500_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Characters that end a word of letters and start none of the tokenizer's own (no apostrophe, which
#: contractions begin with, and none of the marks of special tokens).
MARKS = ".,;:!?()[]{}\"-_#*/\\%&$@+=~^`"
#: The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the
#: others in order from 256 on.
_BYTES = str.maketrans({b: chr(256 + k) for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))})


class WordTokens(dict):
    """Ids of a text by a tokenizer that drops white space, lower-cases, and splits at whatever isn't a
    letter, so that each run between white space can be encoded on its own, and a word of letters apart
    from the marks around it and in lower case. The ids of runs that were met before are looked up. Beyond
    ``most`` runs it starts anew and keeps those as the older ones, of which what is met again comes over."""

    def __init__(self, path: str, most: int = CACHE):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.older: dict[str, bytes] = {}
        tokenizer = Tokenizer.from_file(path)
        self.encode, self.word, self.most = tokenizer.encode, tokenizer.model.tokenize, most
        for probe in ("(Stone),", "stone...", "ÉtéÑ!", "\"Über-\""):
            if self.ids(probe) != self._encoded(probe):
                raise ValueError(f"{path}: not a tokenizer of lower-case words")

    def _encoded(self, run: str) -> bytes:
        return np.array(self.encode(run, add_special_tokens=False).ids, "<u4").tobytes()

    def _made(self, run: str) -> bytes:
        core = run.strip(MARKS)
        if not core.isalpha() or max(core) > "\xff":
            return self._encoded(run)
        if len(core) < len(run):
            at = run.index(core)
            return self[run[:at]] + self[core] + self[run[at + len(core) :]]
        low = run.lower()
        if low != run:
            return self[low]
        return np.array([t.id for t in self.word(low if low.isascii() else low.encode().decode("latin-1").translate(_BYTES))], "<u4").tobytes()

    def __missing__(self, run: str) -> bytes:
        ids = self.older.get(run)
        if ids is None:
            ids = self._made(run)
        if len(run) <= 64:
            self[run] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if len(self) > self.most:
            self.older.clear()
            self.older.update(self)
            self.clear()
            self[""] = b""
        return b"".join(map(self.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document. ``docs`` needs doc_id
    and text; ``path``: the tokenizer's file, found on every executor."""
    closing = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = kept(path, lambda: WordTokens(path))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for i, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    ids = tokens.ids(text or "") + closing
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[a : a + 4 * capacity]
                        rows.append((i, k, a // 4, len(own) // 4, zlib.crc32(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(lean(cut, path), PIECES)


class OpenSequences:
    """Open sequences by remaining capacity. A segment tree counts, for each range of capacities,
    how many are open, so the tightest that fits is found in logarithmic time."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(self.size)]

    def _add(self, left: int, by: int) -> None:
        node = left + self.size
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, left: int, sequence: int) -> None:
        self.at[left].append(sequence)
        self._add(left, 1)

    def take(self, length: int) -> tuple[int, int]:
        """The open sequence with the least remaining capacity of at least ``length``, and that
        capacity; it's no longer open. (-1, -1) if there is none."""
        node = length + self.size
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return -1, -1
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        left = node - self.size
        self._add(left, -1)
        return self.at[left].pop(), left


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and offset of each piece. Longest first, ties by place."""
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, opened = OpenSequences(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        s, left = tree.take(n)
        if s < 0:
            s, left, opened = opened, capacity, opened + 1
        sequence[i], offset[i] = s, capacity - left
        if left > n:
            tree.put(left - n, s)
    return sequence, offset


def pack(found: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces. ``found`` is read twice."""
    total = found.count()
    groups = max(1, math.ceil(total / group))
    dealt = found.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))

    def place(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("doc_id", "piece", "start", "ids_crc32")])
        s, o = best_fit_decreasing(rows["length"].to_numpy(), capacity)
        s += rows["group"].to_numpy().astype(np.int64) << 32
        return rows.drop_columns("group").append_column("sequence_id", pa.array(s)).append_column("offset", pa.array(o))

    return dealt.groupBy("group").applyInArrow(place, f"{PIECES}, sequence_id long, offset long")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 2048 tokens."""
    return pack(stage_in_small_batches(pieces(table(spark, sf_dir, "documents"), tokenizer_path())))


QUERIES = {"op2_packing": op2_packing}
ORACLES: dict[str, str] = {}
