"""The runtime's module record: one layout table for its four versions."""

from __future__ import annotations

import re

from golode.sources.container import Container
from golode.sources.lines import LineTable
from golode.sources.view import word

_COMMON = (
    "pc_header", "funcnametab:3", "cutab:3", "filetab:3", "pctab:3", "pclntable:3", "ftab:3",
    "findfunctab", "minpc", "maxpc", "text", "etext", "-:8",
)
#: Words of each version's record in order; ":3" is a slice (pointer, length,
#: capacity), "-:n" are n words that are skipped.
LAYOUTS = {
    "V2": (*_COMMON, "-:3", "types", "etypes", "-:3", "typelinks:3", "itablinks:3"),
    "V3": (*_COMMON, "-:5", "types", "etypes", "rodata", "gofunc", "-:3", "typelinks:3", "itablinks:3"),
    "V4": (*_COMMON, "-:5", "types", "etypes", "rodata", "gofunc", "-:4", "typelinks:3", "itablinks:3"),
    "V5": (*_COMMON, "-:5", "types", "-:1", "etypes"),
}


def minor_of(version: str | None) -> int | None:
    found = re.match(r"go1\.\+?([0-9]+)(?:\.|\Z)", version or "")
    return int(found[1]) if found and int(found[1]) < 1 << 32 else None


def layout_of(table_version: str, minor: int | None, typelink_section: bool) -> str | None:
    if table_version == "Go12":
        return None
    if table_version in ("Go116", "Go118"):
        return "V2"
    if minor is not None and 20 <= minor <= 23:
        return "V3"
    return "V5" if minor is not None and minor > 26 and not typelink_section else "V4"


def record(data: bytes, at: int, ps: int, layout: str) -> dict | None:
    """The fields by name; slices as (pointer, length, capacity). None if it isn't all there."""
    out: dict = {"version": layout, "rodata": None, "gofunc": None, "typelinks": None, "itablinks": None}
    for entry in LAYOUTS[layout]:
        name, _, count = entry.partition(":")
        n = int(count or 1)
        if name != "-":
            got = [word(data, at + i * ps, ps) for i in range(n)]
            if None in got:
                return None
            out[name] = tuple(got) if n == 3 else got[0]
        at += n * ps
    return out


def find(c: Container, table: LineTable | None, go_version: str | None) -> dict | None:
    if table is None or not c.segments:
        return None
    layout = layout_of(table.version, minor_of(go_version), "typelink" in c.ranges)
    if layout is None:
        return None
    ps = table.ptr_size
    if "go_module" in c.ranges:
        own = c.bytes_of("go_module")
        return None if own is None else record(own, 0, ps, layout)
    if c.format != "Pe":
        return None
    va = c.va_of(table.offset)
    if va is None:
        return None
    pointer = (va % (1 << 8 * ps)).to_bytes(ps, "little")
    at = len(c.data) // 4 - 1
    while (at := c.data.find(pointer, at + 1)) >= 0:
        if at % ps == 0:
            got = record(c.data, at, ps, layout)
            if got and got["minpc"] < got["maxpc"] and got["types"] and c.file_of(got["funcnametab"][0]) is not None:
                return got
    return None
