"""Personal data: regular expressions propose spans, checksums confirm them, nearby words adjust a score.

Everything is DataFrame functions on one row; no text leaves its row and nothing is shuffled.
The patterns are written with possessive quantifiers and a look-behind, so that they find the same
leftmost matches as the plain ones without going over a run of characters once for each start in it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:bigint,end:bigint,score:double>"
#: Code points on either side in which context words count.
NEAR = 40
#: A span of a kind that only its context can confirm needs this score.
LEAST = 0.5
#: What one of the context words adds to a score.
CONTEXT = 0.3


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d >= "5", 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda total, d: total + d) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code passes the mod-97 checksum: the first four characters go last, letters count from 10."""
    moved = F.split(F.concat(F.substr(code, F.lit(5)), F.left(code, F.lit(4))), "")
    value = lambda c: F.ascii(c) - F.when(c >= "A", 55).otherwise(48)
    return F.aggregate(moved, F.lit(0), lambda rest, c: (rest * F.when(c >= "A", 100).otherwise(10) + value(c)) % 97) == 1


#: Elements that one step of a running total goes over.
_STEP = 256


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), in which value is computed once, however often and in whatever lambdas it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of longs what add makes of 0 and all values before it.

    A fold that appends to an array copies it each time; steps of fixed length keep that from growing
    with the square of the array.
    """
    longs = "array<bigint>"
    fold = lambda xs, start: F.aggregate(xs, F.struct(start.alias("at"), F.array().cast(longs).alias("out")), lambda s, x: F.struct(add(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
    zero = F.lit(0).cast("bigint")

    def totals(v: Column) -> Column:
        last = F.greatest(F.ceil(F.size(v) / _STEP).cast("int") - 1, F.lit(0))
        steps = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(v, k * _STEP + 1, F.lit(_STEP)))
        return once(steps, lambda each: F.flatten(F.zip_with(each, fold(F.transform(each, lambda xs: F.aggregate(xs, zero, add)), zero), fold)))

    # few values need no steps
    return once(values, lambda v: F.when(F.size(v) <= _STEP, fold(v, zero)).otherwise(totals(v)))


def _between(low: int, high: int) -> Callable[[Column], Column]:
    return lambda value: F.length(digits(value)).between(low, high)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: float
    context: str


#: Countries by the length of their account codes.
_IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC",
}
_IBAN = "|".join(f"(?:{'|'.join(names.split())})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, names in _IBAN_COUNTRIES.items())
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: The kinds that every result has, in their order, and then those that the method adds.
BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda v: F.lit(True), 0.9, "mail|contact|write to"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), 0.6, "address|host|server|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){15,}+", lambda v: _between(16, 19)(v) & luhn(digits(v)), 0.7, "card|visa|credit|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _between(8, 15), 0.7, "phone|call|tel|mobile|fax"),
)
ADDED = (
    Kind("iban", rf"(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9])", lambda v: mod97(F.replace(v, F.lit(" "), F.lit(""))), 0.9, "iban|account|bank"),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda v: ~v.rlike("^(?:000|666|9)|-00-|-0000$"), 0.3, "social security|ssn|national id|insurance number"),
)


def _spans(text: Column, kind: Kind) -> Column:
    """The confirmed spans of one kind, by start. The pieces between matches give the offsets."""

    def span(x: Column, hit: Column) -> Column:
        near = F.lower(F.concat_ws(" ", F.right(x["before"], F.lit(NEAR)), F.left(x["after"], F.lit(NEAR))))
        score = F.least(F.lit(1.0), F.lit(kind.score) + F.when(near.rlike(kind.context), CONTEXT).otherwise(0.0))
        fits = kind.valid(hit) if kind.score >= LEAST else kind.valid(hit) & (score >= LEAST)
        return F.when(hit.isNotNull() & fits, F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(hit)).alias("end"), score.alias("score")))

    def found(both: Column) -> Column:
        pieces, hits = both["pieces"], both["hits"]
        # after the last match stands one more piece
        taken = F.zip_with(pieces, hits, lambda p, h: (F.length(p) + F.coalesce(F.length(h), F.lit(0))).cast("bigint"))
        placed = F.zip_with(pieces, running(taken, lambda a, b: a + b), lambda p, at: F.struct(p.alias("before"), (at + F.length(p)).alias("start")))
        around = F.zip_with(placed, F.slice(pieces, 2, F.size(pieces)), lambda x, after: F.struct(x["before"].alias("before"), x["start"].alias("start"), after.alias("after")))
        return F.filter(F.zip_with(around, hits, span), lambda s: s.isNotNull()).cast(f"array<{SPAN}>")

    both = F.struct(F.split(text, kind.pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("hits"))
    return F.when(text.rlike(kind.pattern), once(both, found)).otherwise(F.array().cast(f"array<{SPAN}>"))


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns base_spans and added_spans: arrays of (kind, start, end, score).

    Spans are in code points, end exclusive, ordered by kind and then start; spans of one kind do not
    overlap. A null or empty text has none. All rows and columns of docs stay; columns named
    base_spans or added_spans are replaced. An empty table stays empty.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"base_spans": F.concat(*(_spans(whole, k) for k in BASE)), "added_spans": F.concat(*(_spans(whole, k) for k in ADDED))})


#: Code points of a text that are cut out at once.
_CHUNK = 64


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    """Code points start to end of a text given as chunks, without going over all of it."""
    first = F.floor(start / _CHUNK).cast("int")
    near = F.array_join(F.slice(chunks, first + 1, F.greatest(F.ceil(end / _CHUNK).cast("int") - first, F.lit(0))), "")
    return F.substr(near, (start - first * _CHUNK + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of personal data in text replaced by its kind in brackets; spans that overlap each other go together, under the first's kind.

    A null text stays null; texts without spans are unchanged, and so are all rows and other columns
    (but for base_spans and added_spans, which are dropped). An empty table stays empty.
    """
    found = find_pii(docs, text)
    ordered = F.array_sort(F.transform(F.concat("base_spans", "added_spans"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    chunks = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))

    def put(x: Column) -> Column:
        spans, chunked = x["spans"], x["chunks"]
        ends = F.transform(spans, lambda s: s["end"])
        # how far the spans before each one reach: one that starts there or later begins a new stretch
        reach = running(ends, lambda a, b: F.greatest(a, b))
        heads = F.filter(F.zip_with(spans, reach, lambda s, r: F.when(s["start"] >= r, F.struct(r.alias("from"), s["start"].alias("to"), s["kind"].alias("kind")))), lambda h: h.isNotNull())
        told = F.transform(heads, lambda h: F.concat(_cut(chunked, h["from"], h["to"]), F.lit("["), F.upper(h["kind"]), F.lit("]")))
        return F.concat(F.array_join(told, ""), _cut(chunked, F.array_max(ends), F.length(text).cast("bigint")))

    clean = once(F.struct(ordered.alias("spans"), chunks.alias("chunks")), put)
    return found.withColumn(text, F.when(F.size("base_spans") + F.size("added_spans") > 0, clean).otherwise(F.col(text))).drop("base_spans", "added_spans")


def digest(docs: DataFrame) -> DataFrame:
    """Counts and digests of find_pii(): one row for each row of docs, whatever its other columns are."""
    found = find_pii(docs.select("doc_id", "text"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    both = F.concat("base_spans", "added_spans")
    return found.select("doc_id", *(count(k.name) for k in BASE), F.sha2(told(F.col("base_spans")), 256).alias("base_sha256"), told(both).alias("spans"), F.array_join(F.transform(both, lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))
