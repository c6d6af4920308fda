"""Reads and writes binary operation logs: a header, then length-prefixed, checksummed entries of operations.

An entry is a 4-byte length, a payload and its 64-bit XXH3, all little-endian; the payload is a
counted list of operations in a varint encoding: a tag (0 put, 1 delete), the collection's number,
the key and, for a put, the value, both as counted bytes. The longest valid prefix is read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from xxhash import xxh3_64_intdigest

from keelstate.errors import LogCorrupted
from keelstate.operators.replay import DELETE, PUT

#: Fixed values of the format.
MAGIC, VERSION, HEADER = b"EWAL", 3, 16

SCHEMA = "path string, commit_seq long, op_idx long, collection short, kind string, key binary, value binary"


def header() -> bytes:
    return (MAGIC + bytes([VERSION])).ljust(HEADER, b"\0")


def _size(value: int) -> bytes:
    out = bytearray()
    while value >= 0x80:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def entry(operations: Iterable[tuple[str, int, bytes, bytes | None]]) -> bytes:
    """One transaction's operations (kind, collection, key, value) as an entry; few enough for the driver."""
    parts = []
    for kind, collection, key, value in operations:
        parts.append(_size(kind == DELETE) + bytes([collection]) + _size(len(key)) + key + (b"" if kind == DELETE else _size(len(value)) + value))
    body = _size(len(parts)) + b"".join(parts)
    return len(body).to_bytes(4, "little") + body + xxh3_64_intdigest(body).to_bytes(8, "little")


def check_header(data: bytes) -> None:
    if len(data) < HEADER:
        raise LogCorrupted(0, "file too short for a header")
    if data[:4] != MAGIC:
        raise LogCorrupted(0, "bad magic")
    if data[4] != VERSION:
        raise LogCorrupted(4, f"unsupported version {data[4]}")


def entries(data: bytes) -> tuple[list[list[tuple]], int]:
    """The operations of each valid entry, and the offset up to which the file is valid."""
    check_header(data)
    out, at = [], HEADER
    while at + 4 <= len(data):
        size = int.from_bytes(data[at : at + 4], "little")
        body = data[at + 4 : at + 4 + size]
        end = at + 4 + size + 8
        if end > len(data) or xxh3_64_intdigest(body) != int.from_bytes(data[end - 8 : end], "little"):
            break
        try:
            out.append(list(_operations(body)))
        except (IndexError, ValueError):
            break
        at = end
    return out, at


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at += 1
        if byte < 0x80:
            return value, at
        shift += 7


def _counted(data: bytes, at: int) -> tuple[bytes, int]:
    size, at = _varint(data, at)
    if at + size > len(data):
        raise ValueError("cut off")
    return data[at : at + size], at + size


def _operations(body: bytes) -> Iterator[tuple]:
    n, at = _varint(body, 0)
    for _ in range(n):
        tag, at = _varint(body, at)
        if tag > 1:
            raise ValueError(f"unknown operation {tag}")
        collection, at = body[at], at + 1
        key, at = _counted(body, at)
        value = None
        if tag == 0:
            value, at = _counted(body, at)
        yield (DELETE if tag else PUT), collection, key, value


def read(files: DataFrame) -> DataFrame:
    """Log rows of binary logs, read as spark.read.format("binaryFile") gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                found, _ = entries(content.as_py())
                rows = [(path, seq, i, c, kind, key, value) for seq, ops in enumerate(found, 1) for i, (kind, c, key, value) in enumerate(ops, 1)]
                columns = list(zip(*rows)) or [()] * 7
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int16(), pa.string(), pa.binary(), pa.binary())
                names = [part.split()[0] for part in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return files.select("path", "content").mapInArrow(run, SCHEMA)
