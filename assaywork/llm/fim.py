"""Fill-in-the-middle transformation: documents cut at line ends into prefix, middle and suffix, and put together anew.

Line ends are found in the UTF-8 bytes read as unsigned 64-bit words: arithmetic on a word marks each of its bytes
that ends a unit (SWAR), a bit count gives how many, a search in the running counts finds the word of the k-th, and
clearing lower marks selects the byte in that word. Characters are counted the same way, by their first bytes.
The cuts and the form come from a digest of the seed and the id, so reruns agree.

Defined results: a null text counts as empty; an empty text, and one that contains a marker, stays as it is (form
plain); a null id is drawn as an empty one; repeated rows are cut alike; ids may tie freely; an empty table gives an empty result; other
columns play no part, whatever their names. A text is worked on whole, at about 12 bytes of memory a byte of a text
that is longer than a megabyte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaywork.llm.common import table
from assaywork.llm.textkernel import Chunk, chunks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 7, 100, 50
MADE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_LOW7, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def marks_of(words: np.ndarray, byte: int) -> np.ndarray:
    """The top bit of each byte that equals ``byte``; exact, as no sum carries into the next byte."""
    y = words ^ np.uint64(byte * 0x0101010101010101)
    return ~(((y & _LOW7) + _LOW7) | y | _LOW7)


def firsts_of(words: np.ndarray) -> np.ndarray:
    """The top bit of each byte that starts a character: all but 10xxxxxx."""
    return (~words | words << np.uint64(1)) & _HIGH


class Marks:
    """Marked bytes of a buffer: how many stand before a place, and where the k-th is."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.until = np.append(0, np.cumsum(np.bitwise_count(marks).astype(np.int64)))

    def before(self, place: np.ndarray) -> np.ndarray:
        word, byte = place >> 3, (place & 7).astype(np.uint64)
        own = np.append(self.marks, np.uint64(0))[word] & ((np.uint64(1) << (byte << np.uint64(3))) - np.uint64(1))
        return self.until[word] + np.bitwise_count(own)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th mark, from 1."""
        word = np.searchsorted(self.until, k, "left") - 1
        mark, left = self.marks[word], k - self.until[word]
        for r in range(2, 9):  # a word has eight marks at most
            mark = np.where(left >= r, mark & (mark - np.uint64(1)), mark)
        lowest = mark & (~mark + np.uint64(1))
        return word * 8 + (np.bitwise_count(lowest - np.uint64(1)) >> 3)


def words_of(c: Chunk) -> np.ndarray:
    """The bytes of a chunk as little-endian words, filled up with zeros."""
    filled = np.zeros(-(-len(c.data) // 8) * 8, np.uint8)
    filled[: len(c.data)] = c.data
    return filled.view("<u8")


def line_cuts(c: Chunk, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, first, second, chars) of each text: its lines, the bytes at which prefix and middle end, from the chunk's
    start, and the characters of both (texts x 2). ``draws``: two numbers a text."""
    words = words_of(c)
    ends, starts = Marks(marks_of(words, 10)), Marks(firsts_of(words))
    lo, hi = c.offsets[:-1], c.offsets[1:]
    seen = ends.before(lo)
    lines = ends.before(hi) - seen
    some = hi > lo
    open_ = some & (c.data[np.maximum(hi, 1) - 1] != 10 if len(c.data) else False)
    n = lines + open_
    unit = np.sort(draws % (n + 1)[:, None], axis=1)

    def after(k: np.ndarray) -> np.ndarray:
        out = np.where(k == 0, lo, hi)
        pick = (k > 0) & (k <= lines)
        out[pick] = ends.select(seen[pick] + k[pick]) + 1
        return out

    first, second = after(unit[:, 0]), after(unit[:, 1])
    a, b, e = starts.before(lo), starts.before(first), starts.before(second)
    return n, first, second, np.stack([b - a, e - b], 1)


def draw(seed: int, doc_id: Column, i: int) -> Column:
    """The i-th group of eight hex digits, as an unsigned number, of the digest of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 8 * i - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every document. rate: per cent of the documents that
    are transformed at all; spm: per cent of those that put the suffix first."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in MADE.split(", ")]
        p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
        for batch in batches:
            text = pc.fill_null(batch["text"], "")
            marked = np.zeros(batch.num_rows, bool)
            for mark in (PREFIX, SUFFIX, MIDDLE):
                marked |= pc.match_substring(text, mark).to_numpy(zero_copy_only=False)
            h = np.stack([batch[f"h{i}"].to_numpy() for i in (1, 2, 3, 4)], 1)
            for c in chunks(text):
                own = h[c.lo : c.hi]
                n, first, second, chars = line_cuts(c, own[:, :2])
                plain = marked[c.lo : c.hi] | (np.diff(c.offsets) == 0) | (own[:, 2] % 100 >= rate)
                turned = own[:, 3] % 100 < spm
                raw, out = c.data.tobytes(), []
                for lo, x, y, hi, stays, turns in zip(c.offsets[:-1].tolist(), first.tolist(), second.tolist(), c.offsets[1:].tolist(), plain.tolist(), turned.tolist()):
                    if stays:
                        out.append(raw[lo:hi])
                    elif turns:
                        out.append(b"".join((s, raw[y:hi], p, raw[lo:x], m, raw[x:y])))
                    else:
                        out.append(b"".join((p, raw[lo:x], s, raw[y:hi], m, raw[x:y])))
                form = np.where(plain, "plain", np.where(turned, "spm", "psm"))
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].slice(c.lo, c.hi - c.lo), pa.array(n.astype(np.int64)), pa.array(form.tolist(), pa.string()),
                    *[pa.array(chars[:, k].astype(np.int64), mask=plain) for k in range(2)], pa.array(out, pa.binary()).cast(pa.string())], names)

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[draw(seed, F.col("doc_id"), i).alias(f"h{i}") for i in (1, 2, 3, 4)])
    return d.mapInArrow(cut, MADE)


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that an output was made from: its pieces stand behind the markers, which the text has none of."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    pieces = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    out = output
    for k, places in order.items():
        out = F.when(form == k, F.concat(*[F.get(pieces, F.lit(i)) for i in places])).otherwise(out)
    return out


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` with a middle to fill in, each checked by what can be restored of it."""
    made = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"))


QUERIES = {"op13_fim": op13_fim}
ORACLES = {
    # The k-th line end by positions of line ends in a list of lines.
    "op13_fim": r"""
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as lines, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents
), r as (
  select *, len(lines) as n, cast('0x' || h[1:8] as bigint) % (len(lines) + 1) as k1, cast('0x' || h[9:16] as bigint) % (len(lines) + 1) as k2,
    text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or cast('0x' || h[17:24] as bigint) % 100 >= 100 as plain, cast('0x' || h[25:32] as bigint) % 100 < 50 as turned from d
), c as (
  select doc_id, text, n, plain, turned, list_aggregate(list_slice(lines, 1, least(k1, k2)), 'string_agg', '') as p, list_aggregate(list_slice(lines, least(k1, k2) + 1, greatest(k1, k2)), 'string_agg', '') as m,
    list_aggregate(list_slice(lines, greatest(k1, k2) + 1, n), 'string_agg', '') as s from r
), f as (select doc_id, text, n, plain, turned, coalesce(p, '') as p, coalesce(m, '') as m, coalesce(s, '') as s from c)
select doc_id, n, case when plain then 'plain' when turned then 'spm' else 'psm' end as form, case when not plain then cast(length(p) as bigint) end as prefix_chars, case when not plain then cast(length(m) as bigint) end as middle_chars,
  sha256(case when plain then text when turned then '<S>' || s || '<P>' || p || '<M>' || m else '<P>' || p || '<S>' || s || '<M>' || m end) as output_sha256, sha256(text) as restored_sha256 from f
""",
}
