"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Only built-in column functions are used. Spark has no function that returns match offsets, so a
text is both matched and split by a pattern; the lengths of the pieces and of the matches, summed
from the left by doubling, are the offsets (code points, end exclusive). Work grows with a text's
length and with n log n in its matches.

Patterns are written so that the matcher never recurses or rescans: repeated groups are
possessive (what they take never has to be given back), and a run of characters is entered only
at its start or where the previous match ended.

Defined results: a null or empty text has no spans; kinds may overlap each other, matches of one
kind don't; rows are neither dropped nor merged, so repeated rows give repeated results; other
columns pass through untouched (a column named like the output is replaced). A text is worked on whole,
in one task: very long ones with very many spans take some hundred bytes of memory a span.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaywork.llm.common import table

_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_TEL = r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
#: Kinds beyond the base, told apart by their form.
EXTRA = rf"(?<![A-Za-z0-9+-])(?:{_IBAN}|{_SSN}|{_TEL})"

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "tel")
#: Code points of a window.
WINDOW = 1024
#: Score of a confirmed span by kind, before the words near it are looked at.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4, "tel": 0.4}
#: Words that make a kind likelier when they stand within ``reach`` characters.
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security",
    "tel": "phone|tel|call|mobile|fax",
}


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def mod97(iban: Column) -> Column:
    """ISO 7064 mod 97-10: the first four characters go last, letters count from 10, remainder 1."""
    bare = F.regexp_replace(iban, " ", "")
    turned = F.split(F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4)), "")

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(c == "", acc).when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(turned, F.lit(0), step) == 1


def _matches(text: Column, kind: str) -> Column:
    pattern = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}.get(kind, EXTRA)
    needs = {"email": "@", "ip": ".", "phone": "+"}.get(kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.contains(text, F.lit(needs)), found) if needs else found


def _scan(a: Column, both: Callable[[Column, Column], Column], none: Column) -> Column:
    """Of an array, for each place ``both`` over all up to it: in each step a place takes in the one twice as far back, so n
    places need log2(n) steps. ``none`` changes nothing."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(a), F.lit(1)).cast("double"))).cast("int"))
    return F.aggregate(steps, a, lambda acc, k: F.transform(acc, lambda x, i: both(x, F.coalesce(F.get(acc, i - F.pow(F.lit(2), k).cast("int")), none))))


def _placed(text: Column, found: Column, kind: str) -> Column:
    """array<struct<start,end,text>> of the matches, in order."""
    pattern = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}.get(kind, EXTRA)
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    ends = _scan(F.zip_with(pieces, found, lambda p, m: F.coalesce(F.length(p) + F.length(m), F.lit(0))), lambda x, y: x + y, F.lit(0))
    placed = F.zip_with(ends, found, lambda e, m: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("text")))
    return F.when(F.size(found) > 0, placed)


def _windows(text: Column) -> Column:
    """The text in windows of WINDOW code points, so that what stands at a place is found without a walk from the start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{WINDOW}}}"), F.lit(0))


def _between(windows: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` up to ``end`` (within the text, at least ``start``)."""
    first = F.floor(start / WINDOW).cast("int")
    some = F.slice(windows, first + 1, F.floor(end / WINDOW).cast("int") - first + 1)
    return F.substring(F.array_join(some, ""), start - first * WINDOW + 1, end - start)


def _confirmed(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def detect(df: DataFrame, text: str = "text", least: float = 0.5, reach: int = 40) -> DataFrame:
    """Adds ``spans``: array<struct<start,end,kind,text,score,base>>, by start, then kind as listed in
    KINDS. Base kinds always stay; the further kinds (IBAN with its checksum, national numbers)
    stay from score ``least`` and only where no base span overlaps them."""
    body = F.coalesce(F.col(text), F.lit(""))
    groups = (*BASE_KINDS, "extra")
    df = df.withColumns({f"__m_{k}": _matches(body, k) for k in groups})
    df = df.withColumns({f"__p_{k}": _placed(body, F.col(f"__m_{k}"), k) for k in groups})
    some = reduce(lambda x, y: x | y, [F.col(f"__p_{k}").isNotNull() for k in groups])
    df = df.withColumns({"__w": F.when(some, _windows(body)), "__n": F.length(body)})

    def near(kind: str, s: Column) -> Column:
        words = _between(F.col("__w"), F.greatest(s["start"] - reach, F.lit(0)), s["start"])
        after = _between(F.col("__w"), s["end"], F.least(s["end"] + reach, F.col("__n")))
        return F.lower(F.concat_ws(" ", words, after)).rlike(rf"(?<![a-z])(?:{CONTEXT[kind]})")

    def scored(kind: str, s: Column) -> Column:
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["text"].alias("text"),
            (F.lit(PRIOR[kind]) + F.when(near(kind, s), 0.2).otherwise(0.0)).alias("score"), F.lit(kind in BASE_KINDS).alias("base"),
        )

    kind_of = {"iban": lambda m: m.rlike("^[A-Z]") & mod97(m), "ssn": lambda m: m.rlike("^[0-9]{3}-[0-9]{2}-"), "tel": lambda m: m.rlike(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-]")}
    kind_type = "array<struct<start:int,end:int,rank:int,kind:string,text:string,score:double,base:boolean>>"
    none = F.array().cast(kind_type)

    def part(kind: str) -> Column:
        placed = F.col(f"__p_{kind if kind in BASE_KINDS else 'extra'}")
        keep = (lambda s: _confirmed(kind, s["text"])) if kind in BASE_KINDS else (lambda s: kind_of[kind](s["text"]))
        return F.coalesce(F.transform(F.filter(placed, keep), lambda s: scored(kind, s)), none)

    df = df.withColumn("__base", reduce(F.concat, [part(k) for k in BASE_KINDS]))
    likely = F.when(F.col("__p_extra").isNotNull(), F.filter(reduce(F.concat, [part(k) for k in KINDS[4:]]), lambda s: s["score"] >= least))
    both = F.concat(F.col("__base"), F.coalesce(likely, none))
    ordered = F.array_sort(F.transform(both, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"], s["text"], s["score"], s["base"])))
    df = df.withColumn("spans", ordered)
    # a further span stays if all base spans before it end by its start, and all behind it start at its end or later
    ended = _scan(F.transform("spans", lambda s: F.when(s["base"], s["end"]).otherwise(-1)), lambda x, y: F.greatest(x, y), F.lit(-1))
    coming = F.reverse(_scan(F.reverse(F.transform("spans", lambda s: F.when(s["base"], s["start"]).otherwise(2**31 - 1))), lambda x, y: F.least(x, y), F.lit(2**31 - 1)))
    free = F.filter(F.transform(F.arrays_zip(F.col("spans").alias("s"), ended.alias("a"), coming.alias("b")), lambda z: F.when(z["s"]["base"] | ((z["a"] <= z["s"]["start"]) & (z["b"] >= z["s"]["end"])), z["s"])), lambda s: s.isNotNull())
    df = df.withColumn("spans", F.when(F.exists("spans", lambda s: ~s["base"]), free).otherwise(F.col("spans")))
    return df.drop("__base", "__w", "__n", *[f"__{a}_{k}" for a in "mp" for k in groups])


def redacted(df: DataFrame, text: str = "text") -> Column:
    """The text of a row of ``detect`` with each span (overlapping ones together) as its kind in
    square brackets."""
    body = F.col(text)
    windows = _windows(body)
    # how far the spans before each one reach: where it starts no earlier, a new mark begins
    reach = _scan(F.transform("spans", lambda s: s["end"]), lambda x, y: F.greatest(x, y), F.lit(0))
    placed = F.zip_with("spans", F.concat(F.array(F.lit(0)), F.slice(reach, 1, F.size(reach) - 1)), lambda s, at: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), at.alias("at")))
    marks = F.filter(placed, lambda p: p["start"] >= p["at"])
    # the windows are made once, as the value that the fold over one element hands on
    out = F.element_at(F.transform(F.array(windows), lambda w: F.concat(
        F.array_join(F.transform(marks, lambda p: F.concat(_between(w, p["at"], p["start"]), F.lit("["), F.upper(p["kind"]), F.lit("]"))), ""),
        _between(w, F.element_at(reach, -1), F.length(body)))), 1)
    return F.when(F.size("spans") == 0, body).otherwise(out)


def digest(df: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans as text."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return df.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(said(base).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    return digest(detect(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {"op7_pii": op7_pii}
ORACLES: dict[str, str] = {}
