"""Protocol bytes: reassembling messages, reading their fields, decoding binary values."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = "conn int, dir string, number int, at bigint, type string, stmt string, portal string, sql string, formats array<int>, values array<binary>, oids array<bigint>"

# Type numbers of the server's types and the day their dates count from.
BOOL, BYTEA, INT8, INT2, INT4, TEXT, OID, FLOAT4, FLOAT8 = 16, 17, 20, 21, 23, 25, 26, 700, 701
NAME, BPCHAR, VARCHAR, DATE, TIMESTAMP, TIMESTAMPTZ, UUID = 19, 1042, 1043, 1082, 1114, 1184, 2950
EPOCH = "2000-01-01"


SSL_REQUEST, GSS_REQUEST = 80877103, 80877104
STARTUP_BOUNDS = (8, 1 << 20)


class Framer:
    """Messages (type, body) out of chunks of bytes, however they are split.

    With startup, a client's first messages, which have no type byte, come out as "startup"; requests for encryption, which are
    refused, are left out.  A startup message out of bounds ends the connection: nothing follows.
    """

    def __init__(self, startup: bool = False) -> None:
        self.held = bytearray()
        self.at = 0  # what stands before has been given out
        self.startup = startup
        self.ended = False

    def _number(self, at: int) -> int:
        return int.from_bytes(self.held[at : at + 4], "big")

    def _begin(self) -> Iterator[tuple[str, bytes]]:
        while self.startup and not self.ended and len(self.held) - self.at >= 4:
            length = self._number(self.at)
            if not STARTUP_BOUNDS[0] <= length <= STARTUP_BOUNDS[1]:
                self.ended = True
                self.held.clear()
                return
            if len(self.held) - self.at < length:
                return
            body = bytes(self.held[self.at + 4 : self.at + length])
            self.at += length
            if int.from_bytes(body[:4], "big") not in (SSL_REQUEST, GSS_REQUEST):
                self.startup = False
                yield "startup", body

    def push(self, data: bytes) -> Iterator[tuple[str, bytes]]:
        if self.ended:
            return
        del self.held[: self.at]
        self.at = 0
        self.held += data
        if self.startup:
            yield from self._begin()
            if self.startup:
                return
        while len(self.held) - self.at >= 5:
            length = self._number(self.at + 1)
            if length < 4:
                self.at += 1  # lost: try again from the next byte once more has come
                return
            if len(self.held) - self.at < 1 + length:
                return
            kind, body = chr(self.held[self.at]), bytes(self.held[self.at + 5 : self.at + 1 + length])
            self.at += 1 + length
            yield kind, body


class Reader:
    """Fields of a message body in turn; reading past the end raises."""

    def __init__(self, body: bytes) -> None:
        self.body, self.at = body, 0

    def text(self) -> str:
        end = self.body.index(b"\0", self.at)
        out, self.at = self.body[self.at : end].decode("utf-8", "replace"), end + 1
        return out

    def number(self, fmt: str) -> int:
        out = struct.unpack_from(">" + fmt, self.body, self.at)[0]
        self.at += struct.calcsize(fmt)
        return out

    def bytes(self, n: int) -> bytes:
        if self.at + n > len(self.body):
            raise ValueError("message ends early")
        out, self.at = self.body[self.at : self.at + n], self.at + n
        return out


class Message(NamedTuple):
    type: str
    stmt: str | None = None
    portal: str | None = None
    sql: str | None = None
    formats: list[int] | None = None
    values: list[bytes | None] | None = None
    oids: list[int] | None = None


def parsed(kind: str, body: bytes, direction: str) -> Message | None:
    """The message's fields; None if it is of no interest or malformed."""
    r = Reader(body)
    if kind == "startup":
        return Message(kind)
    try:
        if direction == "F":
            if kind == "P":
                return Message(kind, stmt=r.text(), sql=r.text())
            if kind == "B":
                portal, stmt = r.text(), r.text()
                codes = [r.number("H") for _ in range(r.number("H"))]
                lengths_values = [r.bytes(n) if (n := r.number("i")) >= 0 else None for _ in range(r.number("H"))]
                n = len(lengths_values)
                return Message(kind, stmt, portal, formats=codes if len(codes) == n else codes * n if len(codes) == 1 else [0] * n if not codes else codes, values=lengths_values)
            if kind in "DC" and body[:1] in (b"S", b"P"):
                target = r.bytes(1).decode()
                name = r.text()
                return Message(kind + target, stmt=name if target == "S" else None, portal=name if target == "P" else None)
            if kind == "Q":
                return Message(kind, sql=r.text())
        elif kind == "t":
            return Message(kind, oids=[r.number("I") for _ in range(r.number("H"))])
        elif kind == "T":
            oids = []
            for _ in range(r.number("H")):
                r.text()
                r.bytes(6)
                oids.append(r.number("I"))
                r.bytes(8)
            return Message(kind, oids=oids)
    except (ValueError, struct.error):
        return None
    return None


def messages(frames: DataFrame, startup: bool = False) -> DataFrame:
    """The messages of each connection and direction, from its frames (conn, seq, dir, bytes) in order; startup: captured from the beginning.

    number counts the messages of a direction, at is the frame in which one ends.  A task reads its connections one after the other from
    sorted batches, so it holds a message that has begun, never a connection.
    """
    columns = [c.split()[0] for c in MESSAGE.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, framer, number = None, Framer(), 0
        for rows in batches:
            out = []
            for conn, seq, direction, data in zip(rows["conn"], rows["seq"], rows["dir"], rows["bytes"]):
                if (conn, direction) != current:
                    current, framer, number = (conn, direction), Framer(startup and direction == "F"), 0
                for kind, body in framer.push(data or b""):
                    message = parsed(kind, body, direction)
                    if message:
                        out.append((conn, direction, number, seq, *message))
                        number += 1
            yield pd.DataFrame(out, columns=columns)

    return frames.select("conn", "seq", "dir", "bytes").repartition("conn", "dir").sortWithinPartitions("conn", "dir", "seq").mapInPandas(read, MESSAGE)


def text_of(value: Column) -> Column:
    """Bytes as text; what is not UTF-8 is replaced."""
    return F.make_valid_utf8(value.cast("string"))


def big_endian(value: Column, width: int) -> Column:
    """A signed integer of so many bytes; null for another width."""
    unsigned = F.conv(F.hex(value), 16, 10).cast("decimal(20,0)")
    half, whole = 1 << (8 * width - 1), 1 << (8 * width)
    signed = F.when(unsigned >= F.lit(str(half)).cast("decimal(20,0)"), unsigned - F.lit(str(whole)).cast("decimal(20,0)")).otherwise(unsigned)
    return F.when(F.octet_length(value) == width, signed.cast("long"))


def uuid_text(value: Column) -> Column:
    h = F.lower(F.hex(value))
    return F.when(F.octet_length(value) == 16, F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def decoded(value: Column, oid: Column) -> Column:
    """The text of a binary value of the type; null where type or width is not understood."""
    whole = F.when(oid == INT2, big_endian(value, 2)).when(oid == INT4, big_endian(value, 4)).when(oid == INT8, big_endian(value, 8)).when(oid == OID, F.when(F.octet_length(value) == 4, F.conv(F.hex(value), 16, 10).cast("long")))
    day = F.date_add(F.lit(EPOCH).cast("date"), big_endian(value, 4).cast("int")).cast("string")
    micros = big_endian(value, 8) + F.unix_micros(F.lit(EPOCH + " 00:00:00 UTC").cast("timestamp"))
    # without the zeros that end a fraction
    moment = F.concat(F.regexp_replace(F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", ""), F.lit("Z"))
    return (
        F.when(oid == BOOL, F.when(F.octet_length(value) == 1, F.when(F.hex(value) == "00", "false").otherwise("true")))
        .when(oid.isin(INT2, INT4, INT8, OID), whole.cast("string"))
        .when(oid.isin(TEXT, VARCHAR, BPCHAR, NAME), text_of(value))
        .when(oid == UUID, uuid_text(value))
        .when(oid == DATE, day)
        .when(oid.isin(TIMESTAMP, TIMESTAMPTZ), moment)
        .when(oid == BYTEA, F.concat(F.lit("\\x"), F.lower(F.hex(value))))
    )


def decoded_with_floats(value: Column, oid: Column) -> Column:
    """Like decoded, and floats too, for which the bits go through an Arrow UDF."""
    return F.coalesce(decoded(value, oid), _float(value, oid))


def _shortest(value: bytes | None, oid: int | None) -> str | None:
    """The fewest digits that read back as the same float, with an exponent from 10^6 on and below 10^-4; null for another type or width."""
    fmt = {FLOAT4: ">f", FLOAT8: ">d"}.get(oid)
    if value is None or fmt is None or len(value) != struct.calcsize(fmt):
        return None
    x = struct.unpack(fmt, value)[0]
    if x != x or abs(x) == float("inf"):
        return "NaN" if x != x else "+Inf" if x > 0 else "-Inf"
    negative, found, exponent = Decimal(str(np.float32(x)) if oid == FLOAT4 else repr(x)).as_tuple()
    whole = "".join(map(str, found))
    digits, sign = whole.rstrip("0"), "-" * negative
    if not digits:
        return sign + "0"
    power = len(whole) + exponent - 1
    if not -4 <= power < 6:
        return f"{sign}{digits[0]}{'.' * (len(digits) > 1)}{digits[1:]}e{power:+03d}"
    if power < 0:
        return f"{sign}0.{'0' * (-power - 1)}{digits}"
    left = digits[: power + 1].ljust(power + 1, "0")
    return f"{sign}{left}{'.' * (len(digits) > power + 1)}{digits[power + 1 :]}"


@F.pandas_udf(T.StringType())
def _float(value: pd.Series, oid: pd.Series) -> pd.Series:
    return pd.Series([_shortest(v, o) for v, o in zip(value, oid)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def floats(values: pd.Series, oids: pd.Series) -> pd.Series:
    """The texts of those binary values that are floats; null for all others."""
    both = zip(values, oids)
    return pd.Series([[_shortest(v, o) for v, o in zip(vs, os)] if vs is not None and os is not None else None for vs, os in both], dtype=object)
