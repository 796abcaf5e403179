"""Near-duplicate detection by BagMinHash signatures of word shingles, banding and exact checks.

A text is the multiset of its shingles (five neighbouring words; a shorter text is one shingle).
BagMinHash sees a shingle of multiplicity w as a Poisson process over [0, w]: the axis is cut
into dyadic intervals, each has a process of its own seeded by the shingle and the interval, and a
point counts if it lies under w. A point has an arrival time and one of the signature's places; each
place keeps its earliest time. Two texts agree in a place with the probability of their weighted
Jaccard similarity. Points are made only up to the time by which all places are likely taken, which
depends on the total weight; texts with an empty place go on with twice that time.

Texts with the same multiset are one class from the start. Between class representatives, texts that
agree in a band are candidates. Nothing is emitted per pair of a bucket: each bucket compares its members
with one pivot, so a bucket of thousands of copies costs one comparison each. Where that leaves the others of a
bucket in several components, they are open: links between components are found by an exact prefix filter. The
shingles of a text are put in order of the number of open texts that have them; two texts of the asked
similarity share one among the first few of each, at places that leave enough in common behind them. Shingles
of one text alone come first and meet nobody. Variants of one text whose similarity to each other lies just below the
threshold do meet, nearly all of them: their pairs grow with the square of their number. Every candidate is verified on whole multisets; links are what has at least the threshold.

Defined results: texts without words are alike to nothing, each is its own class; rows with a null id
get a null class; repeated rows of one id are one document; other columns play no part. A text is worked on whole, in one task, at about 200 bytes of
memory a byte of a text that is longer than a megabyte.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaywork.llm.common import drop_staged, lean, stage, stage_in_small_batches, table
from assaywork.llm.components import components
from assaywork.llm.textkernel import JOIN, WHITE, Chunk, chunks, gram, mix, uniform, words

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 shares no band with a chance of (1 - 0.8**4)**20, about 3 in 100,000.
BANDS, ROWS = 20, 4
#: Classes of lengths between a length and the least that is as similar.
CLASSES = 8
#: Bits of the marks by which texts are told that surely aren't wanted: 8 MB, whatever the tables' size.
MARKS = 1 << 26
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _step(i: int) -> np.uint64:
    """The i-th multiple of the step, modulo 2**64."""
    return np.uint64(i * int(_STEP) & (1 << 64) - 1)


def shingles(c: Chunk, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of every shingle, texts ascending."""
    w = words(c, WHITE)
    d, h = w.doc, w.hash
    count = np.bincount(d, minlength=c.hi - c.lo)
    g = gram(h, *range(n))
    whole = d[n - 1 :] == d[: len(d) - n + 1] if len(d) >= n else np.zeros(0, bool)
    at, out = d[: len(g)][whole], g[whole]
    short = (count > 0) & (count < n)
    if short.any():
        own = short[d]
        first = np.flatnonzero(np.diff(d[own], prepend=-1))
        place = np.arange(own.sum()) - np.repeat(first, np.diff(np.append(first, own.sum())))
        one = mix(np.add.reduceat(h[own] * JOIN[50 + place], first) + np.uint64(11))
        at, out = np.concatenate([at, d[own][first]]), np.concatenate([out, one])
        order = np.argsort(at, kind="stable")
        at, out = at[order], out[order]
    return at, out


def multiset(at: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with its multiplicity."""
    order = np.lexsort((shingle, at))
    a, s = at[order], shingle[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
    first = np.flatnonzero(new)
    return a[first], s[first], np.diff(np.append(first, len(a)))


def bag_minhash(n: int, at: np.ndarray, element: np.ndarray, weight: np.ndarray, places: int) -> np.ndarray:
    """Signatures (n x places) of the weighted sets given by (text, element, weight), as arrival times;
    infinite in texts without elements."""
    total = np.bincount(at, weight, n)
    sig = np.full(n * places, np.inf)
    until = np.where(total > 0, places * (math.log(places) + 3) / np.maximum(total, 1), 0)
    levels = [(0, 0.0, 1.0, at, element, weight)]
    top = int(weight.max()) if len(weight) else 0
    k = 1
    while top > 1 << (k - 1):  # the interval (2**(k-1), 2**k]
        reach = weight > 1 << (k - 1)
        levels.append((k, float(1 << (k - 1)), float(1 << (k - 1)), at[reach], element[reach], weight[reach]))
        k += 1
    open_ = total > 0
    while open_.any():
        for k, low, width, d, e, w in levels:
            pick = open_[d]
            d, w, seed = d[pick], w[pick], mix(e[pick] + _step(k))
            t = np.zeros(len(d))
            i = 0
            while len(d):
                i += 1
                point = mix(seed + _step(i))
                t = t - np.log(uniform(point)) / width
                alive = t <= until[d]
                d, w, seed, t, point = d[alive], w[alive], seed[alive], t[alive], point[alive]
                other = mix(point ^ _STEP)
                under = low + width * uniform(other) < w
                place = (mix(other) % np.uint64(places)).astype(np.int64)
                np.minimum.at(sig, (d * places + place)[under], t[under])
        left = np.isinf(sig.reshape(n, places)).any(1) & (total > 0)
        until = np.where(left, until * 2, until)
        open_ = left
    return sig.reshape(n, places)


def copies(element: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Each element as often as its weight, the i-th copy with a value of its own."""
    i = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    return mix(np.repeat(element, weight) + i.astype(np.uint64) * _STEP)


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, weight (number of shingles), same_a, same_b (a digest of the multiset), keys (one per
    band)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coefficient = JOIN[:rows]
        for batch in batches:
            for c in chunks(batch["text"]):
                n = c.hi - c.lo
                at, s = shingles(c, shingle)
                d, e, w = multiset(at, s)
                total = np.bincount(at, minlength=n)
                digest = []
                for salt in (3, 5):
                    v = np.zeros(n, np.uint64)
                    np.add.at(v, at, mix(s + np.uint64(salt)))
                    digest.append(v.view(np.int64))
                sig = bag_minhash(n, d, e, w, bands * rows).view(np.uint64).reshape(n, bands, rows)
                key = mix(mix(sig * coefficient).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _STEP).view(np.int64)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(key.ravel()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(c.lo, n), pa.array(total), *map(pa.array, digest), keys], ["doc_id", "weight", "same_a", "same_b", "keys"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(sign), "doc_id long, weight long, same_a long, same_b long, keys array<long>")


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, items): the multiset as ascending 64-bit values, the i-th copy of a shingle having a value
    of its own, in one binary column."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch["text"]):
                n = c.hi - c.lo
                d, e, w = multiset(*shingles(c, shingle))
                d, v = np.repeat(d, w), copies(e, w)
                order = np.lexsort((v, d))
                v, cuts = v[order], np.searchsorted(d, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(c.lo, n), pa.array([v[cuts[i] : cuts[i + 1]].tobytes() for i in range(n)], pa.binary())], ["id", "items"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(gather), "id long, items binary")


def similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose multisets have at least that Jaccard similarity."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, (x, y) in enumerate(zip(batch["x"], batch["y"])):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if min(len(p), len(q)) >= least * max(len(p), len(q)):
                    z = np.sort(np.concatenate([p, q]), kind="stable")
                    both = int((z[1:] == z[:-1]).sum())
                    out[i] = both / (len(p) + len(q) - both)
            keep = pa.array(out >= least)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep), pa.array(out).filter(keep)], ["a", "b", "similarity"])

    x = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(lean(compare), "a long, b long, similarity double")


def prefix_entries(sets: DataFrame, least: float) -> DataFrame:
    """(id, root, w, item, at): the places of each multiset's items in order of their frequency in
    ``sets`` (id, root, items), as far as an item can be the first that it has in common with one as similar
    as ``least``. Items that no other has are counted, not returned."""

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                v = [np.frombuffer(x.as_buffer(), np.int64) for x in part["items"]]
                n = np.array([len(x) for x in v])
                row = pa.array(np.repeat(np.arange(len(v)), n))
                yield pa.RecordBatch.from_arrays([part["id"].take(row), part["root"].take(row), pa.array(np.repeat(n, n)), pa.array(np.concatenate(v))], ["id", "root", "w", "item"])

    flat = sets.select("id", "root", "items").mapInArrow(lean(flatten), "id long, root long, w long, item long")
    shared = flat.join(flat.groupBy("item").agg(F.count("*").alias("n")).filter("n > 1"), "item")
    of_text = Window.partitionBy("id")
    at = F.col("w") - F.count("*").over(of_text) + F.row_number().over(of_text.orderBy("n", "item")) - 1
    return shared.select("id", "root", "w", "item", at.alias("at")).filter(F.col("at") <= F.col("w") * (1 - least) + 1e-6)


def prefix_pairs(entries: DataFrame, least: float) -> DataFrame:
    """(a, b): every pair of different roots that can be as similar as ``least``. Two multisets have so
    much in common only if their first common item leaves ``part`` of both sizes from its place on in each.
    So the shorter one has it early, and the longer one at a place that bounds the shorter one's length from
    above. Lengths are dealt in classes, and roots are matched before their texts are, so that texts of one
    component don't meet."""
    part = least / (1 + least)
    size_class = lambda n: F.floor(F.log(n) * (CLASSES / -math.log(least)))
    short = entries.filter(F.col("w") - F.col("at") >= 2 * part * F.col("w") - 1e-6).select(
        "item", size_class(F.col("w").cast("double")).alias("size"), F.col("root").alias("s_root"), F.col("id").alias("s_id"), F.col("w").alias("s_w"), F.col("at").alias("s_at"))
    upper = F.least(F.col("w").cast("double"), (F.col("w") - F.col("at")) / part - F.col("w") + 1e-6)
    lower = F.greatest(F.lit(1.0), F.col("w") * least - 1e-6)
    long = entries.withColumn("upper", upper).filter(F.col("upper") >= lower).withColumn("size", F.explode(F.sequence(size_class(lower), size_class(F.col("upper")))))
    roots = short.select("item", "size", "s_root").distinct()
    met = long.join(roots, ["item", "size"]).filter("root <> s_root").join(short, ["item", "size", "s_root"])
    enough = F.least(F.col("w") - F.col("at"), F.col("s_w") - F.col("s_at")) >= part * (F.col("w") + F.col("s_w")) - 1e-6
    ordered = (F.col("s_w") < F.col("w")) | ((F.col("s_w") == F.col("w")) & (F.col("s_id") < F.col("id")))
    return met.filter(enough & ordered).select(F.least("id", "s_id").alias("a"), F.greatest("id", "s_id").alias("b")).distinct()


def marked(docs: DataFrame, wanted: DataFrame, marks: int = MARKS) -> DataFrame:
    """``docs`` with __perhaps: true where doc_id is in ``wanted`` and for few others, those whose bit, by a hash of the id, one of ``wanted``
    has set. No text is shuffled for it; where ``wanted`` fills the marks, more others are true."""
    at = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(marks))
    row, bit = F.call_function("shiftright", at, F.lit(15)), (at % 32768).cast("int")  # a row of marks has 32,768 bits
    rows = wanted.select(row.alias("__row"), bit.cast("long").alias("bit")).distinct().repartition("__row").groupBy("__row").agg(F.bitmap_construct_agg("bit").alias("__marks"))
    byte = F.conv(F.hex(F.substring("__marks", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = docs.join(F.broadcast(rows), row == F.col("__row"), "left")
    return found.select(*docs.columns, F.coalesce(F.getbit(byte, bit % 8) == 1, F.lit(False)).alias("__perhaps"))


def within(docs: DataFrame, wanted: DataFrame, marks: int = MARKS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``wanted`` (distinct). Only those that are marked are shuffled; an inner
    join, as Spark would move a semi join below the marks."""
    return marked(docs, wanted, marks).filter("__perhaps").join(wanted, "doc_id").select(docs.columns)


def without(docs: DataFrame, gone: DataFrame, marks: int = MARKS) -> DataFrame:
    """The other rows, null ids among them; further columns may have any names."""
    d = marked(docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), gone, marks)
    checked = d.filter("__perhaps").join(gone.withColumn("__gone", F.lit(True)), "doc_id", "left").filter("__gone is null")
    return d.filter("not __perhaps").select("row").unionAll(checked.select("row")).select("row.*")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, class_id, copy_of: the class (least id of all that it is linked with, itself included)
    and the least id among those with the same multiset of shingles. One row per document."""
    docs = docs.select("doc_id", "text")
    signed = stage_in_small_batches(signatures(docs, bands, rows, shingle))
    same = ["same_a", "same_b", "weight"]
    firsts = stage(signed.filter("weight > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("copy_of"), F.min_by("keys", "doc_id").alias("keys")))
    member = firsts.select(F.col("copy_of").alias("id"), F.explode("keys").alias("key"))
    sizes = member.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stage(member.join(sizes, "key"))
    # A bucket's pivot is the member that shares buckets with the most others: in a group of copies
    # that is what they were made from, which most of them are linked with.
    central = shared.groupBy("id").agg(F.struct(F.sum("n").alias("n"), (-F.col("id")).alias("i")).alias("rank"))
    pivot = shared.join(central, "id").groupBy("key").agg(F.max_by("id", "rank").alias("pivot"))
    buckets = stage(shared.join(pivot, "key").select("key", "id", "pivot"))
    wanted = buckets.select(F.col("id").alias("doc_id")).distinct()
    sets = stage_in_small_batches(shingle_sets(within(docs, wanted).dropDuplicates(["doc_id"]), shingle))
    drop_staged(shared)

    stars = buckets.filter("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    links = stage_in_small_batches(similar(stars, sets, least))
    root = stage(components(links))
    # Buckets whose members are in more than one component, beside the pivot, which all were compared with.
    labelled = buckets.filter("id <> pivot").join(root, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))
    spread = labelled.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("key")
    open_ = labelled.join(spread, "key", "left_semi").select("id", "root").distinct()
    entries = stage_in_small_batches(prefix_entries(sets.join(open_, "id"), least))
    pairs = stage(prefix_pairs(entries, least))
    found = stage_in_small_batches(similar(pairs, sets, least))
    final = stage(components(links.unionByName(found)))
    for used in (buckets, sets, links, root, entries, pairs, found):
        drop_staged(used)

    r = final.withColumnRenamed("id", "copy_of")
    of_first = firsts.select(*same, "copy_of").join(r, "copy_of", "left").select(*same, "copy_of", F.coalesce("root", "copy_of").alias("class_id"))
    out = signed.select("doc_id", *same).dropDuplicates(["doc_id"]).join(of_first, same, "left")
    own = F.col("weight") == 0
    return out.select("doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(own, F.col("doc_id")).otherwise(F.col("copy_of")).alias("copy_of"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op4_near_dedup": op4_near_dedup}
ORACLES: dict[str, str] = {}
