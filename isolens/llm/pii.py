"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checksums (Luhn for cards, mod 97 for IBANs) and number ranges confirm
them, and words within CONTEXT code points of a span raise or lower its score.  Spans of the four base kinds
are always kept; those of the added kinds need a score of at least ``least``.

Positions come from the pieces between matches: split() and regexp_extract_all() walk over a text with the
same matcher, so the lengths of pieces and matches add up to code point offsets; sums run in log2(n) passes, and
surroundings are read from blocks of the text, so that a text with very many spans takes hardly longer than its length.  The patterns are written so
that Java's matcher neither recurses over a long match nor starts again inside a run that cannot match: an
assertion admits only a run's beginning or the end of the match before it (\\G).

A null or empty text has no spans; repeated rows give a row each; columns besides the two named are ignored; an empty
table gives no rows.  A text of any length is searched whole.  Spans that begin at the same place stand in the order of the kinds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isolens.llm.spans import SPANS

CONTEXT = 40
#: Code points of the pieces in which a text is looked up.
BLOCK = 256

_LOCAL = "[A-Za-z0-9._%+-]"
_HOST = "[A-Za-z0-9-]"


class Kind(NamedTuple):
    """guard: a cheap test that every text with a match passes; near and far: words that raise and lower the score."""

    name: str
    guard: str
    pattern: str
    score: float
    near: str
    far: str


#: One digit, then digits each after at most one space or hyphen; begins where no longer run began, holds 12 digits or more.
_DIGITS = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11}(?:(?![ -](?![0-9]))[0-9 -])*+"

BASE = (
    Kind("email", "@", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?=\.{_HOST})(?:(?!\.(?!{_HOST}))[A-Za-z0-9.-])++", 0.8, "mail|contact|write|@", "example"),
    Kind("ip", r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ip|address|host|server", "version|release|section"),
    Kind("card", r"[0-9](?:[ -]?[0-9]){11}", _DIGITS, 0.7, "card|visa|credit|payment|pay", "order|isbn|serial|invoice"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", 0.7, "phone|call|tel|mobile|fax", "score|total"),
)
ADDED = (
    Kind("iban", "[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.8, "iban|bank|account|transfer", "serial"),
    Kind("ssn", "[0-9]-[0-9]{2}-[0-9]", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.4, "ssn|social|security|tax", "part|serial|order"),
)
KINDS = BASE + ADDED


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: a lambda's argument is not computed again where it is read."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What joins each value with all before it, in log2(n) passes: pass k joins with what stands 2^k places before."""
    passes = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.aggregate(passes, values, lambda acc, back: F.transform(acc, lambda x, i: F.when(i < back, x).otherwise(join(x, F.get(acc, i - back)))))


def _blocks(text: Column) -> Column:
    """The text in pieces of BLOCK code points, so that a place in it is reached without a walk from its beginning."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """The code points from start up to end, of which the text may have fewer."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor((end - 1) / BLOCK).cast("int")
    near = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.when(end <= start, F.lit("")).otherwise(F.substr(near, (start - first * BLOCK + 1).cast("int"), (end - start).cast("int")))


def _located(text: Column, kind: Kind) -> Column:
    """array of (start, end, hit) of the leftmost matches that do not overlap."""
    pieces = F.split(text, kind.pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(f"({kind.pattern})"), F.lit(1))

    def spans(hits: Column) -> Column:
        lengths = F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda p, h: F.length(p) + F.length(h))
        return F.zip_with(_running(lengths, lambda x, y: x + y), hits, lambda end, h: F.struct((end - F.length(h)).alias("start"), end.alias("end"), h.alias("hit")))

    return F.when(text.rlike(kind.guard), _let(hits, lambda h: F.when(F.size(h) > 0, spans(h)).otherwise(_none()))).otherwise(_none())


def _none() -> Column:
    return F.from_json(F.lit("[]"), "array<struct<start:int,end:int,hit:string>>")


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The check digit is right: every second digit from the right, doubled, nines cast out."""
    back = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(hit: Column) -> Column:
    """ISO 7064: the first four characters moved to the end, letters as 10 to 35, leave the remainder 1."""
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))

    def add(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(code < 58, acc * 10 + code - 48).otherwise(acc * 100 + code - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _holds(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda part: F.length(F.regexp_replace(part, "^0+(?=.)", "")) <= 3) & F.forall(F.split(hit, r"\."), lambda part: F.substring(F.regexp_replace(part, "^0+(?=.)", ""), 1, 3).cast("int") <= 255)
    if kind == "card":
        return F.length(_digits(hit)).between(12, 19) & luhn(_digits(hit))
    if kind == "phone":
        return F.length(_digits(hit)).between(9, 15)
    if kind == "iban":
        return F.length(F.replace(hit, F.lit(" "), F.lit(""))).between(15, 34) & mod97(hit)
    if kind == "ssn":
        return ~hit.rlike("^(000|666|9)|-00-|-0000$")
    return F.lit(True)


def _good(text: Column, kind: Kind) -> Column:
    return F.filter(_located(text, kind), lambda s: _holds(kind.name, s["hit"]))


def _scored(blocks: Column, span: Column, kind: Kind) -> Column:
    before = _cut(blocks, F.greatest(span["start"] - CONTEXT, F.lit(0)), span["start"])
    after = _cut(blocks, span["end"], span["end"] + CONTEXT)
    around = F.lower(F.concat(before, F.lit(" "), after))
    score = F.lit(kind.score) + F.when(around.rlike(rf"\b(?:{kind.near})"), 0.2).otherwise(0.0) - F.when(around.rlike(rf"\b(?:{kind.far})"), 0.3).otherwise(0.0)
    return F.round(F.least(score, F.lit(1.0)), 2)


def _confirmed(blocks: Column, good: Column, kind: Kind, rank: int, least: float | None) -> Column:
    full = F.transform(good, lambda s: F.struct(s["start"].cast("long").alias("start"), F.lit(rank).alias("rank"), s["end"].cast("long").alias("end"), F.lit(kind.name).alias("kind"), _scored(blocks, s, kind).alias("score")))
    return full if least is None else F.filter(full, lambda s: s["score"] >= least)


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, least: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, spans by start then rank of the kind, and their scores in that order; keep: columns of docs that stay."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = {k.name for k in BASE}
    rest = [docs[c] for c in docs.columns if c in keep]
    good = F.struct(*[_good(text, kind).alias(kind.name) for kind in kinds])

    def scored(good: Column) -> Column:
        some = reduce(Column.__or__, [F.size(good[kind.name]) > 0 for kind in kinds])
        blocks = F.when(some, _blocks(text)).otherwise(F.array().cast("array<string>"))
        return _let(blocks, lambda b: F.array_sort(F.concat(*[_confirmed(b, good[kind.name], kind, rank, None if kind.name in base else least) for rank, kind in enumerate(kinds)])))

    found = docs.select(docs["doc_id"], *rest, _let(good, scored).alias("found__"))
    return found.select("doc_id", *[c for c in docs.columns if c in keep], F.transform("found__", lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])).cast(SPANS).alias("spans"), F.transform("found__", lambda s: s["score"]).alias("scores"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span, or each union of overlapping spans, replaced by its first kind in brackets."""

    def replaced(spans: Column, blocks: Column, reach: Column) -> Column:
        # reach: how far the spans up to each one go; a union begins where a span starts no earlier than that
        begins = F.filter(F.sequence(F.lit(0), F.size(spans) - 1), lambda i: (i == 0) | (F.get(spans, i)["start"] >= F.get(reach, i - 1)))

        def piece(begins: Column, at: Column, i: Column) -> Column:
            gap = _cut(blocks, F.when(at == 0, 0).otherwise(F.get(reach, at - 1)), F.get(spans, at)["start"])
            tail = F.when(i == F.size(begins) - 1, _cut(blocks, F.element_at(reach, -1), F.greatest(F.size(blocks) * BLOCK, F.element_at(reach, -1)))).otherwise("")
            return F.concat(gap, F.lit("["), F.upper(F.get(spans, at)["kind"]), F.lit("]"), tail)

        return _let(begins, lambda b: F.array_join(F.transform(b, lambda at, i: piece(b, at, i)), ""))

    def by_blocks(spans: Column) -> Column:
        reach = _running(F.transform(spans, lambda s: s["end"]), F.greatest)
        return _let(F.struct(_blocks(text).alias("blocks"), reach.alias("reach")), lambda x: replaced(spans, x["blocks"], x["reach"]))

    return F.when(F.size(spans) == 0, text).otherwise(_let(F.array_sort(spans), by_blocks))
