"""Build id, build information and version text of an image."""

from __future__ import annotations

import re

from golode.sources.container import Container
from golode.sources.view import align_up, text, uvarint, words

#: Markers of the format.
ID_START, ID_END, ID_SCAN, ID_LENGTH = b'\xff Go build ID: "', b'"\n \xff', 65536, 1024
INFO_MAGIC, INFO_HEADER, INFO_ALIGN = b"\xff Go buildinf:", 32, 16
MOD_START = bytes.fromhex("3077af0c9274080241e1c107e6d618e6")
MOD_END = bytes.fromhex("f932433186182072008242104116d8f2")
_VERSION = re.compile(rb"go1\.[0-9.]{1,16}")


def build_id(c: Container) -> str | None:
    """From the ELF note, else from the marker near the start of the file."""
    if c.format == "Elf":
        for offset, size in c.notes:
            found = _note(c.data[offset : offset + size])
            if found is not None:
                return found
    at = c.data[:ID_SCAN].find(ID_START)
    if at < 0:
        return None
    start = at + len(ID_START)
    end = c.data[start : start + ID_LENGTH].find(ID_END)
    return text(c.data[start : start + end]) if end >= 0 and start + end <= len(c.data) else None


def _note(data: bytes) -> str | None:
    at = 0
    while (head := words(data, at, 4, 3)) is not None:
        name_size, size, kind = head
        start = at + 12 + align_up(name_size, 4)
        if start + size > len(data):
            return None
        if (name_size, kind) == (4, 4) and data[at + 12 : at + 16] == b"Go\0\0":
            return text(data[start : start + size])
        at = start + align_up(size, 4)
    return None


def version_text(data: bytes) -> str | None:
    """The first "go1." that a digit follows, with up to 16 digits and dots of it."""
    at = 0
    while at + 8 < len(data) and (at := data.find(b"go1.", at)) >= 0:
        found = _VERSION.match(data, at)
        if found and found[0][4:5].isdigit():
            return found[0].decode()
        at += 4
    return None


def _info_at(where: bytes) -> int:
    at = -1
    while (at := where.find(INFO_MAGIC, at + 1)) >= 0:
        if at % INFO_ALIGN == 0 and at + INFO_HEADER <= len(where):
            return at
    return where.find(INFO_MAGIC)


def _prefixed(data: bytes, at: int) -> tuple[bytes, int] | None:
    head = uvarint(data, at)
    if head is None or head[1] + head[0] > len(data):
        return None
    return data[head[1] : head[1] + head[0]], head[1] + head[0]


def build_info(c: Container) -> dict | None:
    """go_version and the module text, or None without a header."""
    where = c.bytes_of("go_buildinfo", clip=True) if "go_buildinfo" in c.ranges else c.data
    at = _info_at(where) if where is not None else -1
    if at < 0:
        return None
    at += c.ranges["go_buildinfo"][0] if "go_buildinfo" in c.ranges else 0
    header = c.data[at : at + INFO_HEADER]
    if len(header) < INFO_HEADER or header[14] not in (4, 8):
        return None
    if not header[15] & 2:
        return {"go_version": version_text(c.data), "mod_text": None}
    first = _prefixed(c.data, at + INFO_HEADER)
    version = text(first[0]) if first else None
    second = _prefixed(c.data, first[1]) if version is not None else None
    if second is None:
        return None
    raw = second[0]
    raw = raw.removesuffix(MOD_END)
    raw = raw[16:] if second[0].startswith(MOD_START) else raw
    return {"go_version": version, "mod_text": text(raw) if raw else None}
