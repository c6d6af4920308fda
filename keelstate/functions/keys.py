"""Byte forms of keys: text, bytes, whole numbers (little-endian), addresses and pairs.

Each codec has Python functions for single keys and column expressions for tables. Numbers go
through hexadecimal digits, two a byte, that are put in the other order; byte forms therefore don't
sort like their keys, and tables are always ordered by the typed columns.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelstate.errors import LogCorrupted


@dataclass(frozen=True)
class Codec:
    """to_bytes and from_bytes of one key; encode and decode of a column; the column's type."""

    name: str
    type: T.DataType
    to_bytes: Callable[[Any], bytes]
    from_bytes: Callable[[bytes], Any]
    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]


def corrupted(reason: str) -> LogCorrupted:
    return LogCorrupted(0, reason)


def _failed(reason: str) -> Column:
    return F.raise_error(F.lit(f"WAL corrupted at offset 0: {reason}"))


def _bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with the value evaluated, and planned, once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _sized(data: Column, n: int, then: Column) -> Column:
    return F.when(data.isNull(), F.lit(None)).when(F.octet_length(data) == n, then).otherwise(_failed(f"expected {n} bytes"))


def _text(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError as error:
        raise corrupted("invalid UTF-8 key") from error


def _decode_text(data: Column) -> Column:
    return F.when(data.isNull() | F.is_valid_utf8(data), data.cast("string")).otherwise(_failed("invalid UTF-8 key"))


def _swapped(digits: Column, n: int) -> Column:
    return F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n))))


def _whole(value: int) -> Column:
    return F.lit(str(value)).cast("decimal(20,0)")


def _number(name: str, n: int, signed: bool, type_: T.DataType) -> Codec:
    low, high = (-(1 << 8 * n - 1), 1 << 8 * n - 1) if signed else (0, 1 << 8 * n)

    def to_bytes(key: int) -> bytes:
        return int(key).to_bytes(n, "little", signed=signed)

    def from_bytes(data: bytes) -> int:
        if len(data) != n:
            raise corrupted(f"expected {n} bytes")
        return int.from_bytes(data, "little", signed=signed)

    def encode(key: Column) -> Column:
        wide = key.cast("decimal(20,0)")
        # Hexadecimal digits of a long show a negative number as its complement; u64 goes past a long.
        digits = F.lpad(F.conv(key.cast("string"), 10, 16) if name == "u64" else F.hex(key.cast("long")), 16, "0")
        fits = wide.between(_whole(low), _whole(high - 1))
        return F.when(key.isNull(), F.lit(None)).when(fits, F.unhex(_swapped(F.right(digits, F.lit(2 * n)), n))).otherwise(
            F.raise_error(F.lit(f"invalid key: not a {name}"))
        )

    def decode(data: Column) -> Column:
        whole = F.conv(_swapped(F.hex(data), n), 16, 10).cast("decimal(20,0)")
        if signed:
            whole = F.when(whole >= _whole(high), whole - _whole(1 << 8 * n)).otherwise(whole)
        return _sized(data, n, whole.cast(type_))

    return Codec(name, type_, to_bytes, from_bytes, encode, decode)


def _fixed(name: str, n: int, to_bytes: Callable, from_bytes: Callable, encode: Callable, render: Callable) -> Codec:
    def checked(data: bytes) -> Any:
        if len(data) != n:
            raise corrupted(f"expected {n} bytes")
        return from_bytes(data)

    return Codec(name, T.StringType(), to_bytes, checked, encode, lambda data: _sized(data, n, render(data)))


def _v4_bytes(text: Column) -> Column:
    good = text.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$")
    parts = F.split(text, "\\.")
    octets = F.concat(*(F.lpad(F.conv(parts[i], 10, 16), 2, "0") for i in range(4)))
    return F.when(text.isNull(), F.lit(None)).when(good, F.unhex(octets)).otherwise(F.raise_error(F.lit("invalid key: not an IPv4 address")))


def _v4_text(data: Column) -> Column:
    digits = F.hex(data)
    return F.concat_ws(".", *(F.conv(F.substring(digits, 2 * i + 1, 2), 16, 10) for i in range(4)))


@F.pandas_udf(T.BinaryType())
def _v6_bytes(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else ipaddress.IPv6Address(x).packed)


@F.pandas_udf(T.StringType())
def _v6_text(data: pd.Series) -> pd.Series:
    # Rows of another length are met by the length check, whichever is evaluated first.
    return data.map(lambda x: str(ipaddress.IPv6Address(bytes(x))) if x is not None and len(x) == 16 else None)


def _ip_bytes(key: str) -> bytes:
    address = ipaddress.ip_address(key)
    return bytes([address.version]) + address.packed


def _ip_from(data: bytes) -> str:
    if not data or data[0] not in (4, 6):
        raise corrupted("unknown discriminant of an address")
    if len(data) != (5 if data[0] == 4 else 17):
        raise corrupted(f"expected {4 if data[0] == 4 else 16} bytes")
    return str(ipaddress.ip_address(bytes(data[1:])))


@F.pandas_udf(T.BinaryType())
def _ip_encode(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else _ip_bytes(x))


@F.pandas_udf(T.StringType())
def _ip_decode(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else _ip_from(bytes(x)))


_WIDE = T.DecimalType(20, 0)
STRING = Codec("string", T.StringType(), str.encode, _text, lambda key: F.to_binary(key, F.lit("utf-8")), _decode_text)
BYTES = Codec("bytes", T.BinaryType(), bytes, bytes, lambda key: key, lambda data: data)
NUMBERS = {
    name: _number(name, n, name[0] == "i", kind)
    for name, n, kind in (
        ("u8", 1, T.ShortType()),
        ("u16", 2, T.IntegerType()),
        ("u32", 4, T.LongType()),
        ("u64", 8, _WIDE),
        ("i8", 1, T.ByteType()),
        ("i16", 2, T.ShortType()),
        ("i32", 4, T.IntegerType()),
        ("i64", 8, T.LongType()),
    )
}
IPV4 = _fixed(
    "ipv4", 4, lambda k: ipaddress.IPv4Address(k).packed, lambda b: str(ipaddress.IPv4Address(bytes(b))), _v4_bytes, _v4_text
)
IPV6 = _fixed(
    "ipv6", 16, lambda k: ipaddress.IPv6Address(k).packed, lambda b: str(ipaddress.IPv6Address(bytes(b))), _v6_bytes, _v6_text
)
IP = Codec("ip", T.StringType(), _ip_bytes, _ip_from, _ip_encode, _ip_decode)


def pair(a: Codec, b: Codec) -> Codec:
    """Two keys: the length of the first as eight bytes, the first, the second. Pairs nest."""
    kind = T.StructType([T.StructField("_1", a.type), T.StructField("_2", b.type)])
    length = NUMBERS["u64"]

    def to_bytes(key: tuple) -> bytes:
        first = a.to_bytes(key[0])
        return length.to_bytes(len(first)) + first + b.to_bytes(key[1])

    def from_bytes(data: bytes) -> tuple:
        if len(data) < 8:
            raise corrupted("pair key too short")
        n = length.from_bytes(data[:8])
        if len(data) < 8 + n:
            raise corrupted("pair key truncated")
        return a.from_bytes(data[8 : 8 + n]), b.from_bytes(data[8 + n :])

    def encode(key: Column) -> Column:
        first = a.encode(key["_1"])
        return F.concat(length.encode(F.octet_length(first)), first, b.encode(key["_2"]))

    def decode(data: Column) -> Column:
        def parted(data: Column) -> Column:
            size = F.octet_length(data)
            head = length.decode(F.when(size >= 8, F.substring(data, 1, 8)).otherwise(F.lit(bytes(8))))

            def found(n: Column) -> Column:
                whole = n.cast("int")
                first = _bound(data.substr(F.lit(9), whole), a.decode)
                rest = _bound(data.substr(F.lit(9) + whole, size), b.decode)
                return F.when(size - 8 < n, _failed("pair key truncated")).otherwise(F.struct(first.alias("_1"), rest.alias("_2")))

            return F.when(data.isNull(), F.lit(None)).when(size < 8, _failed("pair key too short")).otherwise(_bound(head, found))

        return _bound(data, parted)

    return Codec(f"({a.name}, {b.name})", kind, to_bytes, from_bytes, encode, decode)
