"""Quality: supervised subword embeddings, learnt by stochastic gradient descent.

A document is the average of the vectors of its words, of the character n-grams of its words (with marks for a
word's start and end), of its pairs of neighbouring words (a word that follows itself counts as one more pair, the same
for all words), and of one end mark, all hashed to 2**BITS places; a
softmax over two outputs gives the chance of a label. Training reads a bounded sample of labelled texts (``sample``
rows, those of least digest) in one task, in numpy. As the average is linear, scoring needs each place's product with
the outputs only, an array of a proven bound (2**BITS x 2), which is broadcast; each distinct word of a megabyte of
text is looked up once, and every whole text is scored.

Defined results: a null or empty text is the end mark alone; places that no two sampled texts have are left out, in
the average too; rows with a null label or id aren't learnt from; if a document has several labels, the largest
counts; of repeated rows of one id that are sampled each is learnt from; without any labelled row all scores are 0.5;
rows with a null id are scored and are not held out; other columns play no part. A text is worked on whole, at about
150 bytes of memory a byte of a text that is longer than a megabyte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaywork.llm.common import crc_remainder, table
from assaywork.llm.textkernel import BYTE, JOIN, PLACE, WHITE, Chunk, chunks, gram, mix

BITS, DIM = 18, 10
#: Labelled texts that training reads at most.
SAMPLE = 8_000
#: Characters of an n-gram.
GRAMS = (3, 4, 5)
THRESHOLD = 0.5
_START, _END, _PAIR, _DONE, _TWICE = (JOIN[k] for k in (30, 31, 32, 33, 34))


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def word_places(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of each run of bytes that aren't white space; none crosses from one text into the next."""
    inside = ~WHITE[c.data]
    before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
    edge = c.offsets[1:-1]
    before[edge[edge < len(inside)]] = False
    after[edge[edge > 0] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return np.searchsorted(c.offsets, start, "right") - 1, start, end


def subwords(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of the character n-grams of words, given by their bytes; a word's first and last have a mark before
    and behind."""
    at = _ranges(start, end - start)
    word = np.repeat(np.arange(len(start)), end - start)
    own = data[at]
    first = np.flatnonzero((own & 0xC0) != 0x80)
    place = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    char, of = mix(np.add.reduceat(BYTE[own] * PLACE[place & (len(PLACE) - 1)], first)), word[first]
    n = np.bincount(of, minlength=len(start)) + 2
    whole, owner = np.empty(n.sum(), np.uint64), np.repeat(np.arange(len(start)), n)
    last = np.cumsum(n) - 1
    whole[last - n + 1], whole[last] = _START, _END
    whole[_ranges(last - n + 2, n - 2)] = char
    words, hashes = [], []
    for size in GRAMS:
        g = gram(whole, *range(size))
        if len(g):
            same = owner[size - 1 :] == owner[: len(g)]
            words.append(owner[: len(g)][same])
            hashes.append(mix(g[same] + np.uint64(size)))
    return (np.concatenate(words), np.concatenate(hashes)) if words else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


class Features:
    """Places of a chunk's texts. ``word``: each token's distinct word, ``doc``: its text; ``part_of`` and ``part``: the
    distinct words' places; ``pair_doc`` and ``pair``: those of pairs of neighbours, texts ascending."""

    def __init__(self, c: Chunk, bits: int):
        shift = np.uint64(64 - bits)
        self.n = c.hi - c.lo
        self.doc, start, end = word_places(c)
        self.word = self.part_of = self.part = self.pair_doc = self.pair = np.zeros(0, np.int64)
        if not len(start):
            return
        at = _ranges(start, end - start)
        place = at - np.repeat(start, end - start)
        cuts = np.cumsum(end - start) - (end - start)
        hashes = mix(np.add.reduceat(BYTE[c.data[at]] * PLACE[place & (len(PLACE) - 1)], cuts))
        distinct, one, self.word = np.unique(hashes, return_index=True, return_inverse=True)
        of, sub = subwords(c.data, start[one], end[one])
        self.part_of = np.concatenate([np.arange(len(distinct)), of])
        self.part = (np.concatenate([mix(distinct + _DONE), sub]) >> shift).astype(np.int64)
        same = self.doc[1:] == self.doc[:-1]
        pair = (mix(gram(hashes, 0, 1)[same] + _PAIR) >> shift).astype(np.int64) if same.any() else self.pair
        twice = (hashes[1:] == hashes[:-1])[same]
        self.pair_doc = np.concatenate([self.doc[1:][same], self.doc[1:][same][twice]])
        self.pair = np.concatenate([pair, np.full(int(twice.sum()), int(_TWICE >> shift))])
        order = np.argsort(self.pair_doc, kind="stable")
        self.pair_doc, self.pair = self.pair_doc[order], self.pair[order]


def _of_texts(f: Features) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, times) of each text."""
    order = np.argsort(f.part_of, kind="stable")
    part, of = f.part[order], np.searchsorted(f.part_of[order], np.arange(int(f.part_of.max()) + 2 if len(f.part_of) else 1))
    cuts, pair_cuts = np.searchsorted(f.doc, np.arange(f.n + 1)), np.searchsorted(f.pair_doc, np.arange(f.n + 1))
    for i in range(f.n):
        word, times = np.unique(f.word[cuts[i] : cuts[i + 1]], return_counts=True)
        size = of[word + 1] - of[word]
        place = np.concatenate([part[_ranges(of[word], size)], f.pair[pair_cuts[i] : pair_cuts[i + 1]]])
        weight = np.concatenate([np.repeat(times, size), np.ones(pair_cuts[i + 1] - pair_cuts[i], np.int64)])
        own, back = np.unique(place, return_inverse=True)
        yield own.astype(np.int32), np.bincount(back, weight).astype(np.float32)


class Embeddings:
    """Vectors of places and of two outputs. The last place is the end mark."""

    def __init__(self, places: int, dim: int, seed: int):
        self.vectors = np.random.default_rng(seed).uniform(-1 / dim, 1 / dim, (places + 1, dim)).astype(np.float32)
        self.outputs = np.zeros((2, dim), np.float32)

    def learn(self, place: np.ndarray, times: np.ndarray, label: int, rate: float) -> None:
        """One step of gradient descent on the text's log loss. ``place`` has the end mark."""
        share = times / times.sum()
        own = self.vectors[place]
        mean = share @ own
        z = self.outputs @ mean
        p = np.exp(z - z.max())
        g = p / p.sum()
        g[label] -= 1
        back = g @ self.outputs
        self.outputs -= rate * np.outer(g, mean)
        self.vectors[place] = own - rate * np.outer(share, back)


def train(labelled: DataFrame, bits: int = BITS, dim: int = DIM, epochs: int = 12, rate: float = 1.0, support: int = 2, seed: int = 5) -> dict[str, np.ndarray]:
    """The model of a bounded table (order_key, text, label): ``place`` and ``vector`` of what was learnt, the end mark
    having place 2**bits, and ``outputs`` (2 x dim)."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple] = []
        for batch in batches:
            labels = batch["label"].to_numpy(zero_copy_only=False)
            for c in chunks(batch["text"]):
                seen += [(p, t, int(labels[c.lo + i])) for i, (p, t) in enumerate(_of_texts(Features(c, bits)))]
        met = np.zeros((1 << bits) + 1, np.int32)
        for p, _, _ in seen:
            met[p] += 1
        often = met >= support
        mark = np.int32(1 << bits)
        seen = [(np.append(p[often[p]], mark), np.append(t[often[p]], np.float32(1)), label) for p, t, label in seen]
        model, random, step = Embeddings(1 << bits, dim, seed), np.random.default_rng(seed), 0
        for _ in range(epochs):
            for i in random.permutation(len(seen)):
                model.learn(*seen[i], rate * (1 - step / (epochs * len(seen))))
                step += 1
        place = np.append(np.flatnonzero(often), [mark, -1, -2]) if seen else np.zeros(0, np.int64)
        vectors = np.concatenate([model.vectors[place[:-2]], model.outputs]) if seen else np.zeros((0, dim), np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(place) + 1) * dim, pa.int32()), pa.array(vectors.ravel(), pa.float32()))], ["place", "vector"])

    rows = labelled.orderBy("order_key", "label").select("text", F.col("label").cast("int").alias("label"))
    got = rows.coalesce(1).mapInArrow(fit, "place int, vector array<float>").toArrow()
    place = got["place"].to_numpy()
    vector = got["vector"].combine_chunks().flatten().to_numpy().reshape(-1, dim) if len(place) else np.zeros((0, dim), np.float32)
    outputs = np.stack([vector[place == -1][0], vector[place == -2][0]]) if len(place) else np.zeros((2, dim), np.float32)
    return {"place": place[place >= 0], "vector": vector[place >= 0], "outputs": outputs}


def score(docs: DataFrame, model: dict[str, np.ndarray], bits: int = BITS) -> DataFrame:
    """(doc_id, score) of every row: the chance of label 1."""
    dense = np.zeros(((1 << bits) + 1, 3))
    dense[model["place"], :2] = model["vector"] @ model["outputs"].T
    dense[model["place"], 2] = 1  # known
    dense[-1, 2] = 1
    sent = docs.sparkSession.sparkContext.broadcast(dense)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = sent.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for c in chunks(batch["text"]):
                f = Features(c, bits)
                words = int(f.part_of.max()) + 1 if len(f.part_of) else 0
                total = np.tile(dense[-1], (f.n, 1))
                for k in range(3):
                    of_word = np.bincount(f.part_of, dense[f.part, k], words)
                    total[:, k] += np.bincount(f.doc, of_word[f.word], f.n) + np.bincount(f.pair_doc, dense[f.pair, k], f.n)
                z = (total[:, 1] - total[:, 0]) / total[:, 2]
                out[c.lo : c.hi] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(apply, "doc_id long, score double")


def held_out() -> Column:
    """Rows whose labels are never learnt from. A null id is not held out."""
    return F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(order_key, text, label) of documents whose labels may be learnt from. At most ``sample`` ids are chosen before any
    text is read; so the side that is broadcast has at most that many."""
    own = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("label"))
    chosen = own.select(F.col("doc_id").alias("__id"), "label", F.xxhash64(F.col("doc_id").cast("string")).alias("order_key")).orderBy("order_key", "__id").limit(sample)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("order_key", "text", "label")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(labelled_sample(docs, labels, sample))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``."""
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


QUERIES = {"op12_quality": op12_quality}
ORACLES: dict[str, str] = {}
