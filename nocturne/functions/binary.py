"""Fields of binary frames as column expressions over their hex text.

A frame is handled as upper-case hex so every field is a ``substring``; all of
it stays inside code generation, no Python per row. Positions count bytes of the text:
characters would be counted from its start for every field.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_hex(frame: Column, at: int, n: int = 1) -> Column:
    """Hex digits of ``n`` bytes from byte offset ``at`` (0-based)."""
    return F.substring(frame.cast("binary"), at * 2 + 1, n * 2).cast("string")


def _from_hex(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def u8(frame: Column, at: int) -> Column:
    return _from_hex(byte_hex(frame, at)).cast("int")


def uint_le(frame: Column, at: int, n: int) -> Column:
    """Little-endian unsigned integer of ``n`` bytes."""
    return _from_hex(F.concat(*[byte_hex(frame, at + i) for i in reversed(range(n))]))


def uint_be(frame: Column, at: int, n: int) -> Column:
    return _from_hex(byte_hex(frame, at, n))


def float32_bits(frame: Column, at: int) -> Column:
    """The bits of an IEEE single, big-endian."""
    return uint_be(frame, at, 4)


def _scales() -> tuple[list[float | None], list[float]]:
    """By sign and exponent of an IEEE single: what one step of its mantissa is worth, and its hidden bit."""
    steps = [2.0 ** (max(e, 1) - 150) if e < 255 else None for e in range(256)]
    return steps + [None if s is None else -s for s in steps], [8388608.0 if e else 0.0 for e in range(256)] * 2


def float32_value(bits: Column) -> Column:
    """The value of the bits of an IEEE single; NULL for infinities and NaN."""
    # two looked-up numbers instead of nested conditions: the code of a whole frame stays small enough to be compiled
    steps, hidden = (F.array(*[F.lit(v).cast("double") for v in values]) for values in _scales())
    top = F.shiftright(bits, 23).bitwiseAND(F.lit(0x1FF)).cast("int")
    return (bits.bitwiseAND(F.lit(0x7FFFFF)).cast("double") + F.get(hidden, top)) * F.get(steps, top)


def float32_be(frame: Column, at: int) -> Column:
    """IEEE single at a byte offset, big-endian."""
    return float32_value(float32_bits(frame, at))


def _crc16(data: bytes, crc: int) -> int:
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ 0xA001 if crc & 1 else crc >> 1
    return crc


def crc16_modbus(frame: Column, n_bytes: int) -> Column:
    """CRC-16/MODBUS of the first ``n_bytes`` bytes, as expressions.

    The checksum is linear in the bits: that of zeros, exclusive or one table entry for each byte at its place.
    """
    crc = F.lit(_crc16(bytes(n_bytes), 0xFFFF))
    for i in range(n_bytes):
        entries = F.array(*[F.lit(_crc16(bytes([v]) + bytes(n_bytes - 1 - i), 0)) for v in range(256)])
        crc = crc.bitwiseXOR(F.get(entries, u8(frame, i)))
    return crc


def crc32(frame: Column, at: int, n_bytes: Column) -> Column:
    """CRC-32 of ``n_bytes`` bytes from offset ``at``."""
    return F.crc32(F.unhex(F.substring(frame.cast("binary"), F.lit(at * 2 + 1), n_bytes * 2).cast("string")))
