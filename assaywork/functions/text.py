"""Text and number semantics that the rules share, as columns.

Word characters and boundaries are ASCII; white space is the wide set that trimming uses; rounding is
half up in the floor form."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An ASCII word boundary: the engine's own is wider.
BOUNDARY = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
WHITE = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


#: What a boundary is before an item that is a word character, and after one.
_STARTS = re.compile(r"\\b(?=(?:\(\?:)?(?:\\d|\[A-Z\]|[A-Za-z0-9]))")
_ENDS = re.compile(r"((?:\\d|\[A-Z0-9\])(?:\{\d+(?:,\d+)?\})\)?|[a-z]{2})\\b")


def ascii_boundaries(pattern: str) -> str:
    return pattern.replace(r"\b", BOUNDARY)


def one_sided(pattern: str) -> str:
    """``ascii_boundaries`` of a pattern in which a boundary beside a word character is never beside an
    optional one: looks at the other side only."""
    return ascii_boundaries(_ENDS.sub(r"\1(?!\\w)", _STARTS.sub(r"(?<!\\w)", pattern)))


def ascii_lower(text: Column) -> Column:
    """A-Z as a-z, nothing else changed."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def literal_of(pattern: str) -> str:
    """The longest literal that every match of a pattern of plain letters, groups and escapes has, in lower
    case; empty if there is none."""
    bare = re.sub(r"\((?:[^()]|\([^()]*\))*\)[?*]?|\\\w[*+?]?|\.[*+?]", "\0", pattern)
    return max(re.findall(r"[A-Za-z0-9 :]+", bare), key=len, default="").lower()


def not_blank(text: Column) -> Column:
    return text.rlike(f"[^{WHITE}]")


def words(text: Column, longer_than: int) -> Column:
    """Lower-case runs of word characters of more than so many characters, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"\\w{{{longer_than + 1},}}"), F.lit(0))


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return F.length(text) + F.regexp_count(text, F.lit("[\\x{10000}-\\x{10FFFF}]"))


def half_up(x: Column, digits: int) -> Column:
    k = float(10**digits)
    return F.floor(x * k + 0.5) / k


def fixed(x: Column, digits: int) -> Column:
    """Decimal text with so many digits, rounded half up (for x >= 0)."""
    k = 10**digits
    n = F.floor(x * float(k) + 0.5).cast("long")
    return F.concat(F.floor(n / k).cast("string"), F.lit("."), F.lpad((n % k).cast("string"), digits, "0"))


def missing(text: Column) -> Column:
    """Null or empty."""
    return text.isNull() | (text == "")
