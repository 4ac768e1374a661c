"""Byte encodings of numbers, words and lists; for exchange with byte-stream indexes. Parquet needs none of them.

varint: 7 bits a byte, least significant first, in the high bits; the low bit says that another byte follows.
signed: the first byte holds the sign (0x80), 6 bits and the low bit; the rest as varint.
short: two bytes, the higher first. double: the 8 bytes of the number, lowest first. text: UTF-8 and a zero byte.
packed words: 3 letters of 5 bits in two bytes, first letter highest; the low bit says that more follow.

Columns are encoded and decoded by batches (varint, signed, double, gaps) or by built-in functions (the others). A varint is
of 64 bits: a negative number is taken modulo 2**64 and read back as itself. Nulls give null, as do bytes that end too early.
"""

from __future__ import annotations

import struct
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, LongType

MOST_BYTES = 10  # of 64 bits, 7 a byte
_WHOLE = 2**64


def write_varint(n: int) -> bytes:
    out, n = bytearray(), n % _WHOLE
    while True:
        out.append((n & 127) << 1 | (n > 127))
        n >>= 7
        if not n:
            return bytes(out)


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """(number, position after it)."""
    n = shift = 0
    while True:
        b = data[at]
        n |= (b >> 1) << shift
        at, shift = at + 1, shift + 7
        if not b & 1:
            return n, at


def write_signed(n: int) -> bytes:
    rest = abs(n) >> 6
    first = (n < 0) << 7 | (abs(n) & 63) << 1 | (rest > 0)
    return bytes([first]) + (write_varint(rest) if rest else b"")


def read_signed(data: bytes, at: int = 0) -> tuple[int, int]:
    b = data[at]
    n, at = b >> 1 & 63, at + 1
    if b & 1:
        rest, at = read_varint(data, at)
        n |= rest << 6
    return (-n if b & 128 else n), at


def write_short(n: int) -> bytes:
    return struct.pack(">H", n)


def read_short(data: bytes, at: int = 0) -> tuple[int, int]:
    return struct.unpack_from(">H", data, at)[0], at + 2


def write_double(x: float) -> bytes:
    return struct.pack("<d", x)


def read_double(data: bytes, at: int = 0) -> tuple[float, int]:
    return struct.unpack_from("<d", data, at)[0], at + 8


def write_word(word: str) -> bytes:
    """word: lower-case ASCII letters. A word of 3 n letters ends with an empty group."""
    out = b""
    for i in range(0, len(word) + 1, 3):
        a, b, c = (ord(x) - 96 if x else 0 for x in (word[j : j + 1] for j in range(i, i + 3)))
        out += write_short(a << 11 | b << 6 | c << 1 | (i + 3 <= len(word)))
    return out


def read_word(data: bytes, at: int = 0) -> tuple[str, int]:
    word = ""
    while True:
        group, at = read_short(data, at)
        word += "".join(chr(x + 96) for x in (group >> 11 & 31, group >> 6 & 31, group >> 1 & 31) if x)
        if not group & 1:
            return word, at


def write_text(text: str) -> bytes:
    return text.encode() + b"\0"


def read_text(data: bytes, at: int = 0) -> tuple[str, int]:
    end = data.index(0, at)
    return data[at:end].decode(), end + 1


def write_gaps(ids: list[int]) -> bytes:
    """Ascending positive numbers as varint differences, closed by 0."""
    out, last = bytearray(), 0
    for i in ids:
        out += write_varint(i - last)
        last = i
    return bytes(out + b"\0")


def read_gaps(data: bytes, at: int = 0) -> tuple[list[int], int]:
    ids: list[int] = []
    while True:
        gap, at = read_varint(data, at)
        if not gap:
            return ids, at
        ids.append((ids[-1] if ids else 0) + gap)


# -- byte streams

KINDS = {
    "byte": (lambda n: bytes([n]), lambda data, at: (data[at], at + 1)), "short": (write_short, read_short), "varint": (write_varint, read_varint),
    "signed": (write_signed, read_signed), "double": (write_double, read_double), "word": (write_word, read_word), "text": (write_text, read_text), "gaps": (write_gaps, read_gaps),
}


class ByteWriter:
    """Values of the kinds above, one after another, into a binary file that the caller opens and closes."""

    def __init__(self, out: BinaryIO):
        self.out, self.offset = out, 0

    def write(self, kind: str, value) -> int:
        """Writes the value; returns the offset at which it begins."""
        data, at = KINDS[kind][0](value), self.offset
        self.out.write(data)
        self.offset += len(data)
        return at


class ByteReader:
    """Reads what ByteWriter wrote, from the bytes of a file or of a part of it."""

    def __init__(self, data: bytes, offset: int = 0):
        self.data, self.offset = data, offset

    @property
    def ended(self) -> bool:
        return self.offset >= len(self.data)

    def peek(self) -> int:
        """The next byte, without passing it."""
        return self.data[self.offset]

    def read(self, kind: str):
        value, self.offset = KINDS[kind][1](self.data, self.offset)
        return value


# -- columns


def _binary(offsets: np.ndarray, data: np.ndarray, null: np.ndarray) -> pa.Array:
    """Binary values of the given ends; those marked null have no bytes."""
    valid = pa.array(~null).buffers()[1] if null.any() else None
    return pa.Array.from_buffers(pa.binary(), len(null), [valid, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data.tobytes())])


def _parts(s: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts and ends, bytes, nulls) of a binary array."""
    s = s.combine_chunks() if isinstance(s, pa.ChunkedArray) else s
    ends = np.frombuffer(s.buffers()[1], dtype=np.int32, count=len(s) + s.offset + 1)[s.offset :].astype(np.int64)
    data = np.frombuffer(s.buffers()[2], dtype=np.uint8) if s.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    return ends, data, np.asarray(s.is_null())


def encode(numbers: np.ndarray, null: np.ndarray, signed_: bool) -> tuple[np.ndarray, np.ndarray]:
    """(starts and ends, bytes) of the encodings of int64 numbers; at most ten rounds over all of them."""
    if signed_:
        negative, rest = numbers < 0, np.where(numbers < 0, np.negative(numbers), numbers).view(np.uint64)
        first, rest = (rest & np.uint64(63)) << np.uint64(1) | negative.astype(np.uint64) << np.uint64(7), rest >> np.uint64(6)
        size = np.where(null, 0, 1)
    else:
        rest, size = numbers.view(np.uint64), np.where(null, 0, 1)
        first, rest = (rest & np.uint64(127)) << np.uint64(1), rest >> np.uint64(7)
    left = rest.copy()
    while (more := (left > 0) & ~null).any():
        size += more
        left >>= np.uint64(7)
    ends = np.concatenate([[0], np.cumsum(size)])
    data, at = np.zeros(int(ends[-1]), dtype=np.uint8), ends[:-1]
    data[at[~null]] = (first | (rest > 0))[~null].astype(np.uint8)
    for k in range(1, int(size.max(initial=0))):
        on = size > k
        part = rest[on]
        data[at[on] + k] = ((part & np.uint64(127)) << np.uint64(1) | (part > 127)).astype(np.uint8)
        rest[on] = part >> np.uint64(7)
    return ends, data


def decode(ends: np.ndarray, data: np.ndarray, null: np.ndarray, signed_: bool) -> tuple[np.ndarray, np.ndarray]:
    """(int64 numbers, nulls): the first number of each value; null where its bytes end too early."""
    at, end, null = ends[:-1].copy(), ends[1:], null.copy()
    value, negative = np.zeros(len(at), dtype=np.uint64), np.zeros(len(at), dtype=bool)
    open_, shift = ~null, 0
    while open_.any():
        short = open_ & ((at >= end) | (shift > 63))
        null |= short
        open_ &= ~short
        b = data[at[open_]].astype(np.uint64)
        if signed_ and shift == 0:
            negative[open_] = b >= 128
            b &= np.uint64(127)
        value[open_] |= (b >> np.uint64(1)) << np.uint64(shift)
        at[open_] += 1
        open_[open_] = (b & np.uint64(1)) > 0
        shift += 6 if signed_ and shift == 0 else 7
    out = value.view(np.int64)
    return np.where(negative, np.negative(out), out), null


def _encoder(signed_: bool):
    @F.arrow_udf(BinaryType())
    def run(s: pa.Array) -> pa.Array:
        null = np.asarray(s.is_null())
        ends, data = encode(np.array(s.cast(pa.int64()).fill_null(0)), null, signed_)
        return _binary(ends, data, null)

    return run


def _decoder(signed_: bool):
    @F.arrow_udf(LongType())
    def run(s: pa.Array) -> pa.Array:
        numbers, null = decode(*_parts(s.cast(pa.binary())), signed_)
        return pa.array(numbers, mask=null)

    return run


varint, signed = _encoder(False), _encoder(True)
unvarint, unsigned = _decoder(False), _decoder(True)


@F.arrow_udf(BinaryType())
def double(s: pa.Array) -> pa.Array:
    null = np.asarray(s.is_null())
    ends = np.concatenate([[0], np.cumsum(np.where(null, 0, 8))])
    return _binary(ends, np.array(s.fill_null(0.0), dtype="<f8")[~null].view(np.uint8), null)


@F.arrow_udf(DoubleType())
def undouble(s: pa.Array) -> pa.Array:
    ends, data, null = _parts(s.cast(pa.binary()))
    null = null | (np.diff(ends) < 8)
    at = ends[:-1][~null]
    out = np.zeros(len(null))
    out[~null] = data[at[:, None] + np.arange(8)].copy().view("<f8").ravel() if len(at) else 0.0
    return pa.array(out, mask=null)


@F.arrow_udf(BinaryType())
def gaps(s: pa.Array) -> pa.Array:
    """Lists of ascending numbers as varint differences, closed by 0; a null in a list counts as 0."""
    s = s.combine_chunks() if isinstance(s, pa.ChunkedArray) else s
    null, size = np.asarray(s.is_null()), np.asarray(s.value_lengths().fill_null(0))
    values = np.array(s.flatten().cast(pa.int64()).fill_null(0))
    first = np.cumsum(size) - size
    step = np.diff(values, prepend=0)
    step[first[size > 0]] = values[first[size > 0]]
    # every list closes with a 0
    kept = np.flatnonzero(~null)
    ends = np.cumsum(size[kept] + 1)
    all_ = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.int64)
    inside = np.ones(len(all_), dtype=bool)
    inside[ends - 1] = False
    all_[inside] = step
    at, data = encode(all_, np.zeros(len(all_), dtype=bool), False)
    of = np.zeros(len(null), dtype=np.int64)
    of[kept] = np.diff(at[np.concatenate([[0], ends])]) if len(kept) else 0
    return _binary(np.concatenate([[0], np.cumsum(of)]), data, null)


def byte(n: Column) -> Column:
    """A number modulo 2**8 as one byte."""
    return F.unhex(F.lpad(F.hex(F.pmod(n.cast("bigint"), F.lit(256))), 2, "0"))


def unbyte(b: Column) -> Column:
    return F.conv(F.hex(F.substring(b, 1, 1)), 16, 10).cast("int")


def short(n: Column) -> Column:
    """A number modulo 2**16."""
    return F.unhex(F.lpad(F.hex(F.pmod(n.cast("bigint"), F.lit(65536))), 4, "0"))


def unshort(b: Column) -> Column:
    return F.when(F.octet_length(b) >= 2, F.conv(F.hex(F.substring(b, 1, 2)), 16, 10).cast("int"))


def text_bytes(s: Column) -> Column:
    return F.concat(F.encode(s, "utf-8"), F.lit(b"\0"))


def text_of_bytes(b: Column) -> Column:
    """The text before the first zero byte; null without one."""
    code = F.hex(b)
    end = F.regexp_extract(code, "^((?:(?!00)..)*)00", 1)
    return F.when(code.rlike("^(?:(?!00)..)*00"), F.decode(F.unhex(end), "utf-8"))


def packed_word(word: Column) -> Column:
    """word: lower-case ASCII letters."""
    n = F.length(word)
    letter = lambda at: F.when(at <= n, F.ascii(F.substring(word, at, F.lit(1))) - 96).otherwise(0)
    group = lambda g: letter(3 * g + 1) * 2048 + letter(3 * g + 2) * 64 + letter(3 * g + 3) * 2 + (3 * g + 3 <= n).cast("int")
    groups = F.transform(F.sequence(F.lit(0), F.floor(n / 3).cast("int")), lambda g: F.lpad(F.hex(group(g)), 4, "0"))
    return F.unhex(F.array_join(groups, ""))


def unpacked_word(b: Column) -> Column:
    """The letters of all groups up to the first that says no more follow; null if the bytes end before that."""
    each = F.transform(F.regexp_extract_all(F.hex(b), F.lit("(....)"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("int"))
    last = F.array_position(F.transform(each, lambda g: g % 2), 0).cast("int")
    letter = lambda v: F.when(v > 0, F.chr(v + 96)).otherwise("")
    letters = F.transform(F.slice(each, 1, last), lambda g: F.concat(letter(F.shiftright(g, 11)), letter(F.shiftright(g, 6).bitwiseAND(31)), letter(F.shiftright(g, 1).bitwiseAND(31))))
    return F.when(last > 0, F.array_join(letters, ""))
