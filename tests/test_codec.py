import io
import random

import pytest
from pyspark.sql import functions as F

from loomrank.functions import codec

NUMBERS = [None, 0, 1, 11, 63, 64, 127, 128, 300, 16384, 2**32 - 1, 2**60 + 1, 2**63 - 1, -1, -64, -10000, -(2**63), -(2**60) - 1]


def test_vectors():
    for n, h in ((0, "00"), (1, "02"), (11, "16"), (127, "fe"), (128, "0102"), (300, "5904"), (16384, "010102"), (4294967295, "ffffffff1e")):
        assert codec.write_varint(n).hex() == h and codec.read_varint(bytes.fromhex(h)) == (n, len(h) // 2)
    for n, h in ((-1, "82"), (0, "00"), (63, "7e"), (64, "0102"), (-64, "8102"), (-10000, "a13902")):
        assert codec.write_signed(n).hex() == h and codec.read_signed(bytes.fromhex(h)) == (n, len(h) // 2)
    for w, h in (("sigma", "9a4f6840"), ("a", "0800"), ("ab", "0880"), ("abc", "08870000"), ("", "0000")):
        assert codec.write_word(w).hex() == h and codec.read_word(bytes.fromhex(h))[0] == w
    assert codec.read_gaps(codec.write_gaps([3, 4, 900])) == ([3, 4, 900], 5)
    assert codec.read_text(codec.write_text("a b")) == ("a b", 4) and codec.read_double(codec.write_double(3.14))[0] == 3.14 and codec.read_short(codec.write_short(15)) == (15, 2)


def test_negative_numbers_end():
    assert codec.read_varint(codec.write_varint(-1))[0] == 2**64 - 1 and len(codec.write_varint(-1)) == 10


def test_number_columns(spark):
    r = random.Random(1)
    numbers = NUMBERS + [r.randrange(-(2 ** r.randrange(1, 64)), 2 ** r.randrange(1, 64)) for _ in range(800)]
    df = spark.createDataFrame([(n,) for n in numbers], "n bigint").repartition(3)
    rows = df.select("n", codec.varint("n").alias("v"), codec.signed("n").alias("s")).withColumn("v_back", codec.unvarint("v")).withColumn("s_back", codec.unsigned("s")).collect()
    assert len(rows) == len(numbers)
    for x in rows:
        if x["n"] is None:
            assert x[1:] == (None,) * 4
        else:
            assert bytes(x["v"]) == codec.write_varint(x["n"]) and bytes(x["s"]) == codec.write_signed(x["n"]) and x["v_back"] == x["s_back"] == x["n"]
    assert df.limit(0).select(codec.varint("n"), codec.unsigned(codec.signed("n"))).collect() == []


def test_other_columns(spark):
    lists = [None, [], [3, 4, 900], [1], [5, 5_000_000], None, [7, 8]]
    for x in spark.createDataFrame([(v,) for v in lists], "x array<bigint>").coalesce(1).select("x", codec.gaps("x").alias("b")).collect():
        assert (x["b"] is None) if x["x"] is None else (bytes(x["b"]) == codec.write_gaps(x["x"]))
    doubles = [None, 0.0, -0.0, 3.14, -1e300, float("inf")]
    for x in spark.createDataFrame([(v,) for v in doubles], "x double").select("x", codec.double("x").alias("b")).withColumn("y", codec.undouble("b")).collect():
        assert x["x"] == x["y"] and (x["x"] is None or bytes(x["b"]) == codec.write_double(x["x"]))
    words = [None, "", "a", "ab", "abc", "omegasig", "sigma", "abcdef"]
    made = spark.createDataFrame([(v,) for v in words], "x string").select("x", codec.packed_word(F.col("x")).alias("b"), codec.text_bytes(F.col("x")).alias("t"))
    for x in made.withColumn("y", codec.unpacked_word(F.col("b"))).withColumn("u", codec.text_of_bytes(F.col("t"))).collect():
        assert x["x"] == x["y"] == x["u"] and (x["x"] is None or bytes(x["b"]) == codec.write_word(x["x"]) and bytes(x["t"]) == codec.write_text(x["x"]))
    for n in (0, 15, 65535):
        x = spark.range(1).select(codec.short(F.lit(n)).alias("b"), codec.unshort(codec.short(F.lit(n))), codec.byte(F.lit(n)).alias("c"), codec.unbyte(codec.byte(F.lit(n)))).first()
        assert bytes(x["b"]) == codec.write_short(n) and x[1] == n and bytes(x["c"]) == bytes([n % 256]) and x[3] == n % 256


def test_bytes_that_end_too_early(spark):
    df = spark.createDataFrame([(b"\x01",), (b"",), (b"\x01" * 12,)], "b binary")
    got = df.select(codec.unvarint("b"), codec.unsigned("b"), codec.undouble(F.substring("b", 1, 5)), codec.unpacked_word(F.substring("b", 1, 3)), codec.text_of_bytes(F.col("b"))).collect()
    assert [tuple(x) for x in got] == [(None,) * 5] * 3


def test_byte_streams():
    out = io.BytesIO()
    writer = codec.ByteWriter(out)
    given = [("signed", -1), ("signed", 0), ("varint", 11), ("signed", -10000), ("varint", 13), ("double", 3.14), ("short", 15), ("byte", 56), ("word", "omegasig"), ("text", "sigma omega"), ("gaps", [2, 9])]
    at = [writer.write(k, v) for k, v in given]
    assert at[:4] == [0, 1, 2, 3] and writer.offset == len(out.getvalue())
    reader = codec.ByteReader(out.getvalue())
    for (kind, value), offset in zip(given, at):
        assert reader.offset == offset and not reader.ended and reader.peek() == out.getvalue()[offset]
        assert reader.read(kind) == value
    assert reader.ended and codec.ByteReader(out.getvalue(), at[9]).read("text") == "sigma omega"
    with pytest.raises(IndexError):
        reader.read("varint")
