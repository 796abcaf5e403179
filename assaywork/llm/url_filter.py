"""URL filtering by listed rules and by association rules mined from labels.

Listed rules (a host with its subdomains, and a path prefix) decide first; the longest wins. The rest is
judged by association rules mined from labels: each labelled URL is a transaction of all its tokens, with
one more item if its label is bad; rules whose consequent is that item stay if their support and confidence
suffice. They're matched by an inverted index: tokens are joined with the antecedents' tokens, and a rule
applies where as many of its tokens met as it has. A URL is blocked if a rule applies.

Antecedents are mined level by level: only tokens that are frequent among bad URLs are kept, and an
antecedent grows only while it is frequent itself. Frequent tokens are at most the tokens of all labelled
URLs divided by the least count. Antecedents may be of any length. All of them are two to the power of a URL's
tokens in the worst case, as when thirty tokens always occur together; so verdicts and scores come from those that decide: ones
that fewer URLs have than any part of them (what all URLs with a part have adds nothing to it: the part has the same confidence and
applies wherever the whole does), and that have no part which only bad URLs have. Parts of deciding antecedents are deciding, so
these are mined by levels too, until none is left. URLs with the same tokens are counted and matched once.

Defined results: a null URL, or one without ``://``, has an empty host and path, no tokens, and is
allowed; without labels no rule is mined; repeated rows are judged alike; rows are neither dropped nor
merged; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import count
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaywork.llm.common import stage, table


class Listed(NamedTuple):
    block: bool
    host: str
    path: str


RULES = (Listed(True, "net", "/"), Listed(False, "example.net", "/en/"), Listed(True, "example.com", "/de/"), Listed(False, "org", "/fr/"))
#: Tokens of an antecedent at most where all rules are listed; those that decide have no limit.
LONGEST = 3
SUPPORT, CONFIDENCE = 0.005, 0.6
#: Bad labelled URLs that a rule rests on at least, however few there are in all.
FEWEST = 10


def host_and_path(url: Column) -> tuple[Column, Column]:
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, form, i), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def listed(host: Column, path: Column, rules: Sequence[Listed] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):  # the longest comes to stand first
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        name = F.when(fits, r.host + r.path).otherwise(name)
        verdict = F.when(fits, "block" if r.block else "allow").otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL, in order: the labels of its host, path segments and query keys; digits
    count as one mark."""
    plain = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    full = lambda a: F.filter(a, lambda x: x != "")
    labels = F.transform(full(F.split(host, r"\.")), lambda x: F.concat(F.lit("h:"), plain(x)))
    segments = F.transform(full(F.split(path, "/")), lambda x: F.concat(F.lit("p:"), plain(x)))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    keys = F.transform(full(F.split(query, "&")), lambda x: F.concat(F.lit("q:"), plain(F.regexp_extract(x, "(?s)^([^=]*)", 1))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.concat(labels, segments, keys))))


def _deciding(found: DataFrame, shorter: DataFrame) -> DataFrame:
    """Those of ``found`` (antecedent, n, n_bad) all of whose parts, of one token less, are in ``shorter`` and are in more URLs."""
    places = F.sequence(F.lit(0), F.size("antecedent") - 1)
    parts = F.transform(places, lambda i: F.filter("antecedent", lambda _, j: j != i))
    parted = found.select("antecedent", "n", "n_bad", F.explode(parts).alias("part"))
    rare = parted.join(shorter.select(F.col("antecedent").alias("part"), F.col("n").alias("of_part")), "part").filter("n < of_part")
    return rare.groupBy("antecedent").agg(F.first("n").alias("n"), F.first("n_bad").alias("n_bad"), F.count("*").alias("parts")).filter(F.col("parts") == F.size("antecedent")).drop("parts")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, fewest: int = FEWEST, longest: int | None = LONGEST) -> DataFrame:
    """(antecedent, confidence) of the rules for bad URLs, from (tokens, bad boolean): all of at most ``longest``
    tokens or, if that is None, those of any length that decide. The most confident rule that applies to a URL is
    as confident among these as it is among all rules of all lengths."""
    counts = [F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad")]
    sets = labelled.filter((F.size("tokens") > 0) | F.col("bad")).groupBy("tokens").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"))
    sets = stage(sets.withColumn("id", F.monotonically_increasing_id()))
    total = sets.agg(*counts).first()
    none = sets.sparkSession.createDataFrame([], "antecedent array<string>, confidence double")
    if not total["n_bad"]:
        return none
    least = max(fewest, math.ceil(support * total["n"]))
    often = F.col("n_bad") >= least
    single = sets.select("id", "n", "n_bad", F.explode("tokens").alias("token"))
    kept = single.join(single.groupBy("token").agg(*counts).filter(often).select("token"), "token")
    kept = kept.groupBy("id").agg(F.first("n").alias("n"), F.first("n_bad").alias("n_bad"), F.array_sort(F.collect_list("token")).alias("rest"))
    grown = stage(kept.groupBy("rest").agg(*counts)).select("n", "n_bad", F.array().cast("array<string>").alias("antecedent"), "rest")
    rules, shorter = none, None
    for size in count(1) if longest is None else range(1, longest + 1):
        grown = grown.select("n", "n_bad", "antecedent", "rest", F.posexplode("rest").alias("at", "token"))
        grown = grown.select("n", "n_bad", F.array_append("antecedent", F.col("token")).alias("antecedent"), F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"))
        frequent = stage(grown.groupBy("antecedent").agg(*counts).filter(often))
        if frequent.isEmpty():
            break
        if longest is None:
            frequent = stage(_deciding(frequent, shorter) if shorter else frequent.filter(F.col("n") < total["n"]))
            shorter = frequent.filter("n_bad < n")
        sure = F.col("n_bad") / F.col("n")
        rules = rules.unionAll(frequent.filter((sure >= confidence) & (sure / (total["n_bad"] / total["n"]) > 1)).select("antecedent", sure.alias("confidence")))
        if size != longest:
            kept = frequent if longest else shorter
            grown = stage(grown.join(kept.select("antecedent"), "antecedent").filter(F.size("rest") > 0).groupBy("antecedent", "rest").agg(*counts))
    return stage(rules)


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, confidence): the most confident rule that applies to each token set of (key, tokens)."""
    rule_id = F.xxhash64(F.array_sort("antecedent"))
    index = rules.select(rule_id.alias("rule_id"), F.size("antecedent").alias("need"), "confidence", F.explode("antecedent").alias("token"))
    hits = sets.select("key", F.explode("tokens").alias("token")).join(index, "token")
    whole = hits.groupBy("key", "rule_id").agg(F.count("*").alias("n"), F.first("need").alias("need"), F.first("confidence").alias("confidence")).filter("n = need")
    return whole.groupBy("key").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[Listed] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, fewest: int = FEWEST) -> DataFrame:
    """page_id, host, path, rule, verdict, score (of the mined rule, else null) of every page. Labels are
    those of the document with the page's id: bad if it's toxic or of low quality."""
    host, path = host_and_path(F.col("url"))
    p = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = listed(F.col("host"), F.col("path"), rules)
    p = p.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("listed"), tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    p = stage(p.withColumn("key", F.sha2(F.array_join("tokens", "\n").cast("binary"), 256)))
    known = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))).alias("bad"))
    mined = mine(p.join(known, p["page_id"] == known["doc_id"]).select("tokens", "bad"), support, confidence, fewest, longest=None)
    sets = p.filter("listed is null").groupBy("key").agg(F.first("tokens").alias("tokens"))
    found = matched(sets, mined).withColumnRenamed("confidence", "score")
    out = p.join(found, "key", "left")
    score = F.when(F.col("listed").isNull(), F.col("score"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("listed", F.when(F.col("score").isNotNull(), "block").otherwise("allow")).alias("verdict"), score.alias("score"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every url of ``pages``."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"))


QUERIES = {"op8_url_filter": op8_url_filter}
ORACLES: dict[str, str] = {}
