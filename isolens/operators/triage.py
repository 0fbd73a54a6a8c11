"""Tier 0: suspicions from source text alone.

Statements are found in source files (*.sql, split at named queries; string literals of *.go), tables that some
statement mentions together with a tenant column are taken for scoped, and other statements on those tables
without that column are suspect.  Nothing here is verified.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The words and patterns by which statements are recognised, and the label of the report.
TENANT_COLUMNS = ("tenant_id", "org_id", "organization_id", "workspace_id", "account_id", "customer_id", "owner_id", "owner")
CLAUSE_WORDS = ("where", "set", "values", "on", "using", "order", "group", "limit", "offset", "returning", "join", "inner", "left", "right", "full", "outer", "cross", "natural", "as", "for", "select", "union")
VERB_PATTERN = r"(?i)^(SELECT|INSERT|UPDATE|DELETE|WITH)\b"
WRITE_PATTERN = r"(?i)\b(INSERT\s+INTO|UPDATE\s+|DELETE\s+FROM)\b"
TABLE_PATTERN = r'(?i)\b(?:FROM|JOIN|INTO|UPDATE)\s+"?(?:\w+\.)?"?(\w+)"?'
NAME_PATTERN = r"(?m)^--\s*name:\s*(\S+)\s*:\S+"
GENERATED_PATTERN = r"(?m)^// Code generated .* DO NOT EDIT\.?$"
NEEDS = {"SELECT": r"(?i)\bFROM\b", "DELETE": r"(?i)\bFROM\b", "UPDATE": r"(?i)\bSET\b", "INSERT": r"(?i)\bINTO\b", "WITH": r"(?i)\b(FROM|SET|INTO|VALUES)\b"}
SKIPPED_FOLDERS = (".git", "vendor", "node_modules", "testdata", ".terraform")
LABEL = "UNVERIFIED: syntactic triage of source text; nothing was executed and nothing below is confirmed"

STATEMENT = "file string, ordinal int, line int, name string, verb string, table string, sql string"

_NAME = re.compile(NAME_PATTERN)
_SHORT = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, '"': 34, "\\": 92}
_ESCAPE = re.compile(r"""\\(?:(?P<short>[abtnvfr"\\])|(?P<octal>[0-7]{3})|x(?P<hex>[0-9A-Fa-f]{2})|(?P<point>u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})|)""")
_TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`", re.S)


def classified(text: str) -> tuple[str, str] | None:
    """(READ or WRITE, table) of a text that has a statement's shape: verb, keyword, and a table before a clause."""
    named = _NAME.match(text)
    body = (text[text.find("\n") + 1 :] if named and "\n" in text else text).strip()
    verb = re.match(VERB_PATTERN, body)
    if not verb or not re.search(NEEDS[verb[1].upper()], body):
        return None
    table = re.search(TABLE_PATTERN, body)
    if not table or not _followed(body[table.end() :]):
        return None
    return ("WRITE" if re.search(WRITE_PATTERN, body) else "READ"), table[1].lower()


def _followed(rest: str) -> bool:
    """What comes after a table: the end of the text, punctuation after up to two words, or a clause word as first or second word."""
    blank = " \t\n\r"
    rest = rest.lstrip(blank)
    if not rest:
        return True
    words = 0
    while rest and rest[0] not in ";,(":
        word = re.match(r"(?a)\w+", rest)
        if not word or words == 2:
            return False
        if word[0].lower() in CLAUSE_WORDS:
            return True
        rest, words = rest[word.end() :].lstrip(blank), words + 1
    return bool(rest)  # words up to the end of the text are prose


def sql_blocks(text: str) -> list[tuple[int, str | None, str]]:
    """(line, name, text) of each named query of an SQL file, or of the file."""
    cuts = list(_NAME.finditer(text))
    if not cuts:
        return [(1, None, text)]
    ends = [*(m.start() for m in cuts[1:]), len(text)]
    return [(1 + text.count("\n", 0, m.start()), m[1], text[m.start() : end]) for m, end in zip(cuts, ends)]


def unquoted(literal: str) -> str:
    """The value of an interpreted string literal; the literal itself where an escape is none."""
    inner, out, at = literal[1:-1], bytearray(), 0
    for m in _ESCAPE.finditer(inner):
        out += inner[at : m.start()].encode()
        at = m.end()
        number = int(m["octal"], 8) if m["octal"] else int(m["hex"], 16) if m["hex"] else None
        point = int(m["point"][1:], 16) if m["point"] else None
        if m["short"]:
            out.append(_SHORT[m["short"]])
        elif number is not None and number < 256:
            out.append(number)  # a byte, not a character
        elif point is not None and point <= 0x10FFFF and not 0xD800 <= point <= 0xDFFF:
            out += chr(point).encode()
        else:
            return literal
    return (out + inner[at:].encode()).decode("utf-8", "replace")


def go_literals(text: str) -> list[tuple[int, str | None, str]]:
    """(line, name, value) of each string literal outside comments; none for generated files."""
    if re.search(GENERATED_PATTERN, text):
        return []
    out = []
    for m in _TOKEN.finditer(text):
        raw = m[0]
        if raw[0] == "`":
            value = raw[1:-1].replace("\r", "")
        elif raw[0] == '"':
            value = unquoted(raw)
        else:
            continue
        named = _NAME.search(value.strip())
        out.append((1 + text.count("\n", 0, m.start()), named[1] if named else None, value))
    return out


def _found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in STATEMENT.split(", ")]
    for frame in frames:
        rows = []
        for path, text in zip(frame["path"], frame["text"]):
            blocks = sql_blocks(text) if path.endswith(".sql") else go_literals(text) if path.endswith(".go") else []
            for ordinal, (line, name, block) in enumerate(blocks):
                kind = classified(block if path.endswith(".sql") else block.strip())
                if kind:
                    rows.append((path, ordinal, line, name, *kind, block.strip()))
        yield pd.DataFrame(rows, columns=columns)


def statements(sources: DataFrame) -> DataFrame:
    """Statements of the sources (path, text)."""
    skipped = F.lit(rf"(^|/)({'|'.join(re.escape(d) for d in SKIPPED_FOLDERS)})/")
    own = sources.filter(F.col("text").isNotNull() & ~F.rlike("path", skipped) & ~(F.col("path").endswith(".sql") & F.rlike("path", F.lit("(^|/)migrations/"))))
    return own.select("path", "text").mapInPandas(_found, STATEMENT)


def mentions(sql: Column, column: Column | str) -> Column:
    """The column's name occurs as a word, in any case."""
    name = F.lit(column) if isinstance(column, str) else column
    return F.rlike(sql, F.concat(F.lit(r"(?i)\b"), name, F.lit(r"\b")))


def evidence(found: DataFrame) -> DataFrame:
    """table, n, n_evidence, tenant_column (that of the first statement with one), confidence: tables with any evidence."""
    hit = F.coalesce(*[F.when(mentions(F.col("sql"), c), c) for c in TENANT_COLUMNS])
    own = found.filter(F.col("table") != "").withColumn("hit", hit)
    first = F.min(F.when(F.col("hit").isNotNull(), F.struct("file", "line", "ordinal", "hit")))
    by = own.groupBy("table").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("n_evidence"), first.alias("first"))
    return by.filter("n_evidence > 0").select("table", "n", "n_evidence", F.col("first.hit").alias("tenant_column"), F.round(F.col("n_evidence") / F.col("n"), 6).alias("confidence"))


def suspicions(found: DataFrame) -> DataFrame:
    """Ranked: writes first, then by confidence, then by place."""
    flagged = found.join(evidence(found).select("table", "tenant_column", "confidence"), "table").filter(~mentions(F.col("sql"), F.col("tenant_column")))
    by_rank = Window.orderBy(F.when(F.col("verb") == "WRITE", 0).otherwise(1), F.desc("confidence"), "file", "line", "ordinal")
    reason = F.concat(F.lit("no mention of "), F.col("tenant_column"))
    return flagged.select(F.row_number().over(by_rank).alias("rank"), "file", "line", "name", "table", "verb", "confidence", reason.alias("reason"), "sql")


def report(sources: DataFrame, root: str = ".") -> DataFrame:
    """The report as one JSON document."""
    found = statements(sources)
    files, n = sources.agg(F.count(F.lit(1)).alias("files_scanned")), found.agg(F.count(F.lit(1)).alias("statements_found"))
    tables = evidence(found).agg(F.array_sort(F.collect_set("table")).alias("known_scoped_tables"))
    listed = suspicions(found).agg(F.array_sort(F.collect_list(F.struct("rank", "file", "line", "name", "table", "verb", "confidence", "reason", "sql"))).alias("suspicions"))
    one = files.crossJoin(n).crossJoin(tables).crossJoin(listed)  # one row each
    return one.select(F.to_json(F.struct(F.lit(True).alias("unverified"), F.lit(LABEL).alias("label"), F.lit(root).alias("repo_root"), "files_scanned", "statements_found", "known_scoped_tables", "suspicions")).alias("report"))
