"""Citations in outputs: extraction with offsets, host policy, verdicts within a budget."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaywork.functions.text import half_up

# What counts as a citation of each kind, in the order in which ties stand.
PATTERNS = {
    "numbered": r"\[(\d{1,3})\]",
    "url": r"https?://[^\s)\]]+",
    "doi": r"""\b10\.\d{4,9}/[^\s)\];,"'<>]+""",
    "author_year": r"\(([^()]{1,50}?,\s*(?:18|19|20)\d{2})\)",
}
#: Host endings, and address ranges, that are never looked up.
BLOCKED_ENDINGS = ("localhost", "internal", ".local", "metadata.google", "metadata.azure")
BLOCKED_IPV4 = r"^(?:127\.|169\.254\.|10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|255\.255\.255\.255$|0\.)"
#: Characters of text around a citation.
REACH = 200
_COMPILED = {k: re.compile(p, re.ASCII if k != "author_year" else 0) for k, p in PATTERNS.items()}
_SPACE = re.compile(r"\s")
_ENDS = ".,;:!?)\"'>"
CITATION = "kind string, identifier string, start int, end int, context string"


def _found(text: str) -> list[tuple[str, str, int, int, str]]:
    out, urls = [], []
    for kind, pattern in _COMPILED.items():
        for m in pattern.finditer(text):
            start, end, name = m.start(), m.end(), m[0]
            if kind in ("url", "doi"):
                name = name.rstrip(_ENDS)
                end = start + len(name)
            else:
                name = m[1].strip()
            if kind == "url":
                urls.append(start)
            # Of the URLs that begin before a DOI, the nearest alone decides: space after it is after all.
            if kind == "doi" and (i := bisect_right(urls, start)) and not _SPACE.search(text, urls[i - 1], start):
                continue
            lo, hi = max(0, start - REACH), min(len(text), end + REACH)
            out.append((kind, name, start, end, ("…" if lo else "") + text[lo:hi] + ("…" if hi < len(text) else "")))
    return sorted(out, key=lambda c: c[2])


def extract(df: DataFrame, key: str = "trace_id", text: str = "output") -> DataFrame:
    """key, place (from 0, in reading order), kind, identifier, start, end, context: offsets from 0, end
    exclusive. Offsets are why this is an Arrow helper: Spark's functions return matches alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, *c) for k, t in zip(b["k"], b["t"]) if t for i, c in enumerate(_found(t))]
            yield pd.DataFrame(rows, columns=[key, "place", "kind", "identifier", "start", "end", "context"])

    kind = dict(df.dtypes)[key]
    return df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(run, f"{key} {kind}, place int, {CITATION}")


def source_url(name: Column) -> Column:
    """What a source is looked up by: a DOI becomes its address, anything else stays as it is."""
    name = F.regexp_replace(name, r"^\s+|\s+$", "")
    return F.when(name.rlike(r"^10\.\d{4,9}/"), F.concat(F.lit("https://doi.org/"), name)).otherwise(name)


def with_sources(cited: DataFrame, sources: DataFrame, key: str = "trace_id") -> DataFrame:
    """key, place, identifier, page_id, url of each url and doi citation, once for each of the sources
    (page_id, url) that have it; page_id and url are null where none has. One equi-join, in
    which AQE splits a hot identifier: looking distinct ones up first would extract all citations twice."""
    c = cited.filter(F.col("kind").isin("url", "doi")).select(key, "place", "identifier", source_url(F.col("identifier")).alias("source"))
    pages = sources.select("page_id", "url", source_url(F.col("url")).alias("source"))
    return c.join(pages, "source", "left").select(key, "place", "identifier", "page_id", "url")


def host_allowed(url: Column, allow: tuple[str, ...] = ()) -> Column:
    """Whether a source may be looked up: http or https, a host that is neither internal nor private, and,
    if hosts are listed, one of them or below one."""
    host = F.lower(F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    v6 = F.contains(host, F.lit(":"))
    blocked = F.lit(False)
    for e in BLOCKED_ENDINGS:
        blocked |= F.endswith(host, F.lit(e))
    blocked |= host.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$") & host.rlike(BLOCKED_IPV4)
    blocked |= v6 & host.rlike(r"^\[?(?:::1\]?$|fc|fd|fe80|::ffff:127\.)")
    ok = (host != "") & ~blocked
    if allow:
        listed = F.lit(False)
        for a in allow:
            listed |= (host == a.lower()) | F.endswith(host, F.lit("." + a.lower()))
        ok &= listed
    return ok


def verdicts(cited: DataFrame, key: str = "trace_id", most: int = 20, budget: float = 1.0, passing: float = 0.5) -> DataFrame:
    """Per output, from (key, place, kind, has_source, supported, actual, pessimistic): found, resolved,
    supported, score, passed, budget_stopped. Only the first ``most`` citations count. A citation is looked
    up while what was spent before it plus its pessimistic cost is within the budget; at the first that
    isn't, the rest is dropped."""
    w = Window.partitionBy(key).orderBy("place")
    lookup = F.col("kind").isin("url", "doi") & F.col("has_source")
    c = cited.withColumn("n", F.count("*").over(Window.partitionBy(key))).filter(F.col("place") < most)
    spent = F.coalesce(F.sum(F.when(lookup, F.col("actual"))).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    c = c.withColumn("over", lookup & (spent + F.col("pessimistic") > budget))
    c = c.withColumn("stopped", F.max(F.col("over").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    done = lookup & ~F.col("stopped")
    out = c.groupBy(key).agg(F.max("n").alias("found"), F.count_if(done).alias("resolved"), F.count_if(done & F.col("supported")).alias("supported"), F.max("stopped").alias("budget_stopped"))
    score = F.when(F.col("resolved") > 0, half_up(F.col("supported") / F.col("resolved"), 2))
    return out.withColumn("score", score).withColumn("passed", score.isNull() | (score >= passing))
