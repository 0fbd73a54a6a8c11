"""Secrets in texts, by a trigram inverted index.

Each rule's regular expression is analysed once into a Boolean query over lower-cased trigrams that
every match must contain.  Texts are indexed in segments (the chunks of an Arrow batch): postings of
the trigrams that some query asks for.  A rule's query is answered by intersecting and uniting postings,
and only the texts it returns are verified with the regular expression.  A rule without a mandatory
trigram (a run of hexadecimal digits) gives the query "all" and scans every text fully.
Index and texts are read in the same pass: nothing is shuffled, and a lost task is simply run again.

A null or empty text has no spans; repeated rows give a row each; columns besides the two named are ignored; an empty
table gives no rows.  A text of any length is searched as one, and tokens of open length are found whole.  Spans that
begin at the same place stand in the order of the rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from isolens.llm import textkit
from isolens.llm.spans import SPANS

ALL = ("all",)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, and what a match must fulfil besides (by the match object)."""

    kind: str
    pattern: str
    flags: int = re.ASCII
    holds: Callable[[re.Match], bool] | None = None

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, self.flags)


def _long_value(m: re.Match) -> bool:
    return len(m[2]) >= 8


def _whole_token(m: re.Match) -> bool:
    return m[1] is not None


def _long_key(m: re.Match) -> bool:
    return len(m[0]) >= 16


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, _long_value),
    Rule("access", r"AKIA[A-Z0-9]+", holds=_long_key),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    # where no token begins, the second branch passes over the run at once: none begins later in it
    Rule("web_token", r"eyJ(?:([A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)|[A-Za-z0-9_-]*+)", holds=_whole_token),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", r"[sr]k_live_[A-Za-z0-9]{16,}+"),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]++:[^\s/:@]++@"),
)
RULES = BASE_RULES + MORE_RULES

#: An alternative or product of more literal strings than this is cut, which weakens the query and stays sound.
MOST_STRINGS = 64


def _and(parts: list) -> tuple:
    parts = list(dict.fromkeys(p for p in parts if p != ALL))
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _or(parts: list) -> tuple:
    parts = list(dict.fromkeys(parts))
    return ALL if ALL in parts or not parts else parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: set[bytes]) -> tuple:
    """At least one of the strings is in the text."""
    return _or([_and([("gram", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(items) -> tuple[set[bytes] | None, tuple]:
    """(every string that the items can match, if few; else None), and a query that holds for each match."""
    done, run, exact = [], {b""}, True

    def cut() -> None:
        nonlocal run, exact
        done.append(_of_strings(run))
        run, exact = {b""}, False

    for op, arg in items:
        strings, query = _node(op, arg)
        if strings is None:
            cut()
            done.append(query)
        elif len(run) * len(strings) > MOST_STRINGS:
            cut()
            run = strings
        else:
            run = {a + b for a in run for b in strings}
    return (run, _of_strings(run)) if exact else (None, _and([*done, _of_strings(run)]))


def _fold(code: int) -> bytes:
    return chr(code).encode().lower()


def _node(op, arg) -> tuple[set[bytes] | None, tuple]:
    if op is sre.LITERAL:
        return {_fold(arg)}, ALL
    if op is sre.IN:
        folded: set[bytes] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                folded.add(_fold(value))
            elif kind is sre.RANGE and value[1] - value[0] < MOST_STRINGS:
                folded |= {_fold(c) for c in range(value[0], value[1] + 1)}
            else:
                return None, ALL
        return (folded, ALL) if len(folded) <= 8 else (None, ALL)
    if op is sre.SUBPATTERN:
        return _walk(arg[-1])
    if op is sre.BRANCH:
        found = [_walk(branch) for branch in arg[1]]
        if all(s is not None for s, _ in found) and len(union := set().union(*(s for s, _ in found))) <= MOST_STRINGS:
            return union, ALL
        return None, _or([q for _, q in found])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        low, high, inner = arg
        strings, query = _walk(inner)
        if strings is not None and low == 0 and high == 1:
            return strings | {b""}, ALL
        return None, query if low else ALL
    if op is sre.AT or op in (sre.ASSERT, sre.ASSERT_NOT):
        return {b""}, ALL
    return None, ALL


def trigram_query(pattern: str, flags: int = re.ASCII) -> tuple:
    """("all",), ("gram", three bytes), ("and", ...) or ("or", ...): what a text with a match must contain."""
    return _walk(sre_parser.parse(pattern, flags))[1]


def grams_of(query: tuple) -> set[bytes]:
    if query[0] == "gram":
        return {query[1]}
    return set().union(*map(grams_of, query[1:])) if query[0] in ("and", "or") else set()


class Segment:
    """Postings of the texts of one chunk, for the trigrams in a lookup table."""

    def __init__(self, chunk: textkit.Chunk, ids: np.ndarray, n_ids: int) -> None:
        self.n = chunk.n
        low = textkit.LOWER[chunk.data].astype(np.int32)
        codes = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        found = ids[codes]
        at = np.flatnonzero(found >= 0)
        doc = np.searchsorted(chunk.offsets, at, side="right") - 1
        inside = at + 3 <= chunk.offsets[doc + 1]
        pairs = np.unique(found[at[inside]].astype(np.int64) * self.n + doc[inside])
        self.docs = pairs % max(self.n, 1)
        self.cuts = np.searchsorted(pairs, np.arange(n_ids + 1) * self.n)

    def search(self, query: tuple, number: dict[bytes, int]) -> np.ndarray:
        """The texts that fulfil the query, ascending."""
        if query[0] == "all":
            return np.arange(self.n)
        if query[0] == "gram":
            k = number[query[1]]
            return self.docs[self.cuts[k] : self.cuts[k + 1]]
        found = [self.search(q, number) for q in query[1:]]
        if query[0] == "or":
            return np.unique(np.concatenate(found))
        out = min(found, key=len)
        for other in found:
            out = np.intersect1d(out, other, assume_unique=True) if other is not out else out
        return out


def scan(column: pa.Array, rules: tuple[Rule, ...], plan: tuple | None = None) -> list[list[tuple]]:
    """For each text the (start, rank, end, kind) of its secrets, in code points."""
    ids, number, queries, compiled = plan or prepare(rules)
    found: list[list[tuple]] = []
    for chunk in textkit.chunks(column):
        segment = Segment(chunk, ids, len(number))
        texts = list(textkit.texts_of(chunk))
        own: list[list[tuple]] = [[] for _ in texts]
        for rank, rule in enumerate(rules):
            for i in segment.search(queries[rank], number):
                own[i] += [(m.start(), rank, m.end(), rule.kind) for m in compiled[rank].finditer(texts[i]) if rule.holds is None or rule.holds(m)]
        for spans in own:
            spans.sort()
        found += own
    return found


def prepare(rules: tuple[Rule, ...]) -> tuple:
    """Queries, and the table from a trigram's code to its number (-1: no query asks for it)."""
    queries = [trigram_query(r.pattern, r.flags) for r in rules]
    grams = sorted(set().union(*map(grams_of, queries)))
    ids = np.full(1 << 24, -1, np.int16)
    number = {g: k for k, g in enumerate(grams)}
    for g, k in number.items():
        ids[int.from_bytes(g, "big")] = k
    return ids, number, queries, [r.compiled() for r in rules]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans, a list of (start, rank, end, kind) by start then rank, for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = prepare(rules)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            found = scan(batch.column(1), rules, plan)
            rows = [[{"start": a, "rank": r, "end": b, "kind": k} for a, r, b, k in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id bigint, spans {SPANS}")
