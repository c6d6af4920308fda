"""Byte forms of keys, singly and as columns."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keelstate.errors import LogCorrupted
from keelstate.functions import keys

NUMBER_CASES = [
    (name, value)
    for name, codec in keys.NUMBERS.items()
    for bits in [int(name[1:])]
    for value in ([0, 1, (1 << bits) - 1] if name[0] == "u" else [-(1 << bits - 1), -1, 0, (1 << bits - 1) - 1])
]


@pytest.mark.parametrize("name, value", NUMBER_CASES)
def test_number_round_trip(name, value):
    codec = keys.NUMBERS[name]
    data = codec.to_bytes(value)
    assert len(data) == int(name[1:]) // 8 and codec.from_bytes(data) == value


def test_little_endian():
    assert keys.NUMBERS["u32"].to_bytes(0x01020304) == bytes([4, 3, 2, 1])


@pytest.mark.parametrize("name", keys.NUMBERS)
def test_wrong_length(name):
    with pytest.raises(LogCorrupted, match=f"expected {int(name[1:]) // 8} bytes"):
        keys.NUMBERS[name].from_bytes(bytes(3))


def test_text_and_bytes():
    assert keys.STRING.from_bytes(keys.STRING.to_bytes("é日")) == "é日"
    assert keys.BYTES.from_bytes(b"\xff\xfe") == b"\xff\xfe"
    with pytest.raises(LogCorrupted, match="invalid UTF-8"):
        keys.STRING.from_bytes(b"\xff\xfe")


def test_addresses():
    assert keys.IPV4.to_bytes("127.0.0.1") == bytes([127, 0, 0, 1])
    assert keys.IPV6.from_bytes(keys.IPV6.to_bytes("::1")) == "::1"
    assert keys.IP.to_bytes("192.168.1.100") == bytes([4, 192, 168, 1, 100])
    assert len(keys.IP.to_bytes("2001:db8::1")) == 17
    assert keys.IP.from_bytes(keys.IP.to_bytes("2001:db8::1")) == "2001:db8::1"
    for bad in (b"", b"\x05abcd"):
        with pytest.raises(LogCorrupted, match="discriminant"):
            keys.IP.from_bytes(bad)
    for codec, data in ((keys.IP, b"\x04abc"), (keys.IPV4, b"abc"), (keys.IPV6, b"abc")):
        with pytest.raises(LogCorrupted, match="expected"):
            codec.from_bytes(data)


TEXT_PAIR = keys.pair(keys.STRING, keys.STRING)


@given(st.text(), st.text())
def test_pairs(a, b):
    assert TEXT_PAIR.from_bytes(TEXT_PAIR.to_bytes((a, b))) == (a, b)


def test_nested_and_cut_pairs():
    nested = keys.pair(keys.NUMBERS["u32"], keys.pair(keys.IPV4, keys.STRING))
    assert nested.from_bytes(nested.to_bytes((42, ("10.0.0.1", "sshd")))) == (42, ("10.0.0.1", "sshd"))
    with pytest.raises(LogCorrupted, match="too short"):
        TEXT_PAIR.from_bytes(b"abc")
    with pytest.raises(LogCorrupted, match="truncated"):
        TEXT_PAIR.from_bytes((9).to_bytes(8, "little") + b"ab")


def test_number_columns(spark):
    for name, codec in keys.NUMBERS.items():
        values = [v for n, v in NUMBER_CASES if n == name]
        rows = spark.createDataFrame([(str(v),) for v in values], "t string").select(F.col("t").cast(codec.type).alias("k"))
        got = rows.select("k", codec.encode(F.col("k")).alias("b")).withColumn("back", codec.decode(F.col("b"))).collect()
        for value, row in zip(values, got):
            assert bytes(row.b) == codec.to_bytes(value) and int(row.back) == value, name


def test_other_columns(spark):
    for codec, values in (
        (keys.STRING, ["", "é日"]),
        (keys.IPV4, ["127.0.0.1", "255.0.10.9"]),
        (keys.IPV6, ["::1", "2001:db8::1"]),
        (keys.IP, ["10.0.0.1", "::1"]),
    ):
        rows = spark.createDataFrame([(v,) for v in values], "k string")
        got = rows.select("k", codec.encode(F.col("k")).alias("b")).withColumn("back", codec.decode(F.col("b"))).collect()
        for row in got:
            assert bytes(row.b) == codec.to_bytes(row.k) and row.back == row.k
    both = keys.pair(keys.STRING, keys.NUMBERS["u32"])
    rows = spark.createDataFrame([(("hello", 7),), (("", 0),)], "k struct<_1:string,_2:bigint>")
    got = rows.select("k", both.encode(F.col("k")).alias("b")).withColumn("back", both.decode(F.col("b"))).collect()
    for row in got:
        assert bytes(row.b) == both.to_bytes(tuple(row.k)) and row.back == row.k


@pytest.mark.parametrize(
    "codec, data, text",
    [
        (keys.NUMBERS["u32"], b"abc", "expected 4 bytes"),
        (keys.STRING, b"\xff\xfe", "invalid UTF-8"),
        (keys.IPV4, b"abc", "expected 4 bytes"),
        (TEXT_PAIR, b"abc", "too short"),
        (TEXT_PAIR, (9).to_bytes(8, "little") + b"ab", "truncated"),
    ],
)
def test_bad_columns(spark, codec, data, text):
    rows = spark.createDataFrame([(bytearray(data),)], "b binary")
    with pytest.raises(Exception, match=text):
        rows.select(codec.decode(F.col("b"))).collect()


def test_out_of_range_column(spark):
    with pytest.raises(Exception, match="not a u8"):
        spark.range(300, 301).select(keys.NUMBERS["u8"].encode(F.col("id"))).collect()
