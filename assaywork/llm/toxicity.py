"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of words, their stems (first bytes), pairs of neighbours and pairs around
one word, hashed to 2**BITS places. Per-coordinate rates and an L1 penalty leave few weights other
than zero, which fit in a broadcast of a proven bound (2**BITS places). Training reads a bounded
sample of labelled texts (``sample`` rows, those of least digest) in one task; scoring reads every
whole text.

Defined results: a null or empty text gets the score of the intercept; rows with a null label aren't
learnt from; if a document has several labels, the largest counts; without any labelled row all
scores are 0.5; repeated rows are scored alike; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaywork.llm.common import crc_remainder, lean, small_batches, table
from assaywork.llm.textkernel import ALNUM, JOIN, Chunk, chunks, gram, mix, words

BITS = 20
#: Labelled texts that training reads at most.
SAMPLE = 12_000
#: Bytes of a word that make its stems.
STEMS = (4, 6)
#: Sampled texts that must hold a feature for it to be learnt.
SUPPORT = 5
THRESHOLD = 0.3
_APART = ~ALNUM


def features(c: Chunk, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every occurrence of a feature in a chunk."""
    w = words(c, _APART, fold=True, stems=STEMS)
    h, d = w.hash, w.doc
    at, place = [d] * (1 + len(STEMS)), [mix(h + JOIN[40]), *(mix(s + JOIN[41]) for s in w.stems)]
    for gap in (1, 2):
        same = d[gap:] == d[:-gap]
        at.append(d[gap:][same])
        place.append(gram(h, 0, gap)[same])
    return np.concatenate(at), (np.concatenate(place) >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """FTRL-proximal for logistic loss with binary features."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l2 = alpha, beta, l2
        self.z, self.n, self.l1 = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1), np.full((1 << bits) + 1, l1)
        self.l1[-1] = 0  # the intercept alone speaks for texts without evidence

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z = self.z[at]
        over = np.sign(z) * np.maximum(np.abs(z) - self.l1[at], 0)
        return -over / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(labelled: DataFrame, sample: int = SAMPLE, bits: int = BITS, support: int = SUPPORT, epochs: int = 8, alpha: float = 0.3, beta: float = 1.0, l1: float = 8.0, l2: float = 0.0) -> dict[str, np.ndarray]:
    """Weights other than zero from a table of (order_key, text, label) with at most ``sample`` rows:
    arrays ``place`` and ``weight``. The last place, 2**bits, is the intercept."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen = Ftrl(bits, alpha, beta, l1, l2), []
        texts = np.zeros((1 << bits) + 1, np.int32)
        for batch in batches:
            labels = batch["label"].to_numpy(zero_copy_only=False)
            for c in chunks(batch["text"]):
                d, place = features(c, bits)
                both = np.unique(d << (bits + 1) | place)
                cuts = np.searchsorted(both, np.arange(c.hi - c.lo + 1) << (bits + 1))
                for i in range(c.hi - c.lo):
                    own = (both[cuts[i] : cuts[i + 1]] & ((1 << (bits + 1)) - 1)).astype(np.int32)
                    own = np.append(own, np.int32(1 << bits))
                    # A text names a place once.
                    texts[own] += 1
                    seen.append((own, float(labels[c.lo + i])))
        for i, (own, label) in enumerate(seen):
            seen[i] = own[texts[own] >= support], label
        random = np.random.default_rng(5)
        for _ in range(epochs):
            for i in random.permutation(len(seen)):
                model.learn(*seen[i])
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(w[at], pa.float64())], ["place", "weight"])

    rows = labelled.orderBy("order_key").limit(sample).select("text", F.col("label").cast("double").alias("label"))
    with small_batches(labelled.sparkSession):
        got = rows.coalesce(1).mapInArrow(lean(fit), "place int, weight double").toArrow()
    return {k: got[k].to_numpy() for k in ("place", "weight")}


def _scorer(model: dict[str, np.ndarray], bits: int):
    dense = np.zeros((1 << bits) + 1)
    dense[model["place"]] = model["weight"]

    def chance(text: pa.Array) -> np.ndarray:
        out = np.zeros(len(text))
        for c in chunks(text):
            d, place = features(c, bits)
            used = dense[place] != 0
            both = np.unique(d[used] << (bits + 1) | place[used])
            total = np.bincount(both >> (bits + 1), dense[both & ((1 << (bits + 1)) - 1)], c.hi - c.lo)
            out[c.lo : c.hi] = 1 / (1 + np.exp(-np.clip(total + dense[-1], -30, 30)))
        return out

    return chance


def score(docs: DataFrame, model: dict[str, np.ndarray], bits: int = BITS) -> DataFrame:
    """(doc_id, score) of every row: the chance of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance = _scorer(sent.value, bits)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(chance(batch["text"]))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(apply), "doc_id long, score double")


def keep_clean(docs: DataFrame, model: dict[str, np.ndarray], threshold: float = THRESHOLD, bits: int = BITS) -> DataFrame:
    """The rows, all columns, whose score is under the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance = _scorer(sent.value, bits)
        for batch in batches:
            yield batch.filter(pa.array(chance(batch["text"]) < threshold))

    return docs.mapInArrow(lean(apply), docs.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from. A null id is not held out."""
    return F.coalesce(crc_remainder(doc_id, 4) == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(order_key, text, label) of at most ``sample`` documents whose labels may be learnt from. The
    ids are chosen before any text is read; so the side that is broadcast has at most that many."""
    own = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    chosen = own.select(F.col("doc_id").alias("__id"), "label", F.xxhash64(F.col("doc_id").cast("string")).alias("order_key")).orderBy("order_key", "__id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("order_key", "text", "label")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(labelled_sample(docs, labels, sample), sample)
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``."""
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}
