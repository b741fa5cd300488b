"""Bounds-checked little-endian reads. Nothing here raises on bad input: what can't be read is None."""

from __future__ import annotations

_SIGN = {1: 1 << 7, 2: 1 << 15, 4: 1 << 31, 8: 1 << 63}


def word(data: bytes, at: int, size: int) -> int | None:
    """An unsigned integer of ``size`` bytes."""
    return int.from_bytes(data[at : at + size], "little") if 0 <= at and at + size <= len(data) else None


def signed(data: bytes, at: int, size: int) -> int | None:
    n = word(data, at, size)
    return n if n is None else (n ^ _SIGN[size]) - _SIGN[size]


def words(data: bytes, at: int, size: int, count: int) -> list[int] | None:
    """``count`` unsigned integers in a row, all or none."""
    if at < 0 or at + size * count > len(data):
        return None
    return [int.from_bytes(data[at + i * size : at + (i + 1) * size], "little") for i in range(count)]


def uvarint(data: bytes, at: int) -> tuple[int, int] | None:
    """Value and the offset after it; at most ten bytes, 64 bits."""
    value = 0
    for i in range(10):
        if at + i >= len(data):
            return None
        byte = data[at + i]
        value |= (byte & 0x7F) << (7 * i)
        if byte < 0x80:
            return (value & (1 << 64) - 1, at + i + 1)
    return None


def text(raw: bytes | None) -> str | None:
    """Strict UTF-8, else None."""
    try:
        return None if raw is None else raw.decode()
    except UnicodeDecodeError:
        return None


def until_nul(data: bytes, at: int) -> str | None:
    end = data.find(b"\0", at) if 0 <= at < len(data) else -1
    return text(data[at:end]) if end >= 0 else None


def align_up(n: int, to: int) -> int | None:
    return None if to == 0 else -(-n // to) * to


def wrap32(n: int) -> int:
    """As a signed 32-bit integer."""
    return (n + (1 << 31)) % (1 << 32) - (1 << 31)
