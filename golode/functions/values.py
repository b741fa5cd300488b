"""Versions, build settings, verdicts and binary arithmetic as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Strings of the runtime that point to a Go image.
NEEDLES = (
    "runtime.main", "runtime.goexit", "runtime.mstart", "runtime.rt0_go", "fatal error: all goroutines are asleep", "runtime.gopanic", "runtime.newproc",
)
LEAST_HITS = 3
#: Magics in the order that the fast test knows them, little-endian.
FAST_MARKS = (b"\xff Go buildinf:", b"\xff Go build ID:")
FAST_MAGICS = (0xFFFFFFF1, 0xFFFFFFF0, 0xFFFFFFFA, 0xFFFFFFFB)
TIERS = ("None", "Low", "Medium", "High")


def _hex(raw: bytes) -> Column:
    return F.unhex(F.lit(raw.hex()))


def detect_format(content: Column) -> Column:
    """Elf, MachO, Pe or Unknown from the first bytes of a BINARY column."""
    head = F.hex(F.substring(content, 1, 4))
    return (
        F.when(F.octet_length(content) < 4, "Unknown")
        .when(head == "7F454C46", "Elf")
        .when(head.isin("CFFAEDFE", "CEFAEDFE", "FEEDFACF", "FEEDFACE"), "MachO")
        .when(head.startswith("4D5A"), "Pe")
        .otherwise("Unknown")
    )


@F.pandas_udf(BooleanType())
def aligned_magic(contents: pd.Series) -> pd.Series:
    """Whether a table magic stands at a multiple of four bytes."""
    return contents.map(lambda d: bool(np.isin(np.frombuffer(d, "<u4", count=len(d) // 4), FAST_MAGICS).any()) if d is not None else None)


def has_marker(content: Column) -> Column:
    return F.contains(content, _hex(FAST_MARKS[0])) | F.contains(content, _hex(FAST_MARKS[1]))


def detect(content: Column) -> Column:
    """The fast test: a marker anywhere, else an aligned magic."""
    return has_marker(content) | aligned_magic(content)


def heuristic_hits(content: Column) -> Column:
    """How many of the needles a BINARY or STRING column holds."""
    raw = content.cast("binary")
    out = F.lit(0)
    for needle in NEEDLES:
        out = out + F.contains(raw, _hex(needle.encode())).cast("int")
    return out


def heuristic_check(content: Column) -> Column:
    return heuristic_hits(content) >= LEAST_HITS


def minor_version(version: Column) -> Column:
    found = F.regexp_extract(version, r"^go1\.\+?([0-9]+)(?:\.|\z)", 1)
    return F.when(found != "", found.try_cast("int"))


def runtime_commit(version: Column) -> Column:
    found = F.regexp_extract(version, "-([0-9A-Fa-f]{7,})", 1)
    return F.when(found != "", found)


def setting(settings: Column, key: str) -> Column:
    """The first value of a key in an array of (key, value)."""
    return F.get(F.filter(settings, lambda s: s["key"] == key), F.lit(0))["value"]


def build_mode(value: Column) -> Column:
    names = {"exe": "Exe", "": "Exe", "pie": "Pie", "c-shared": "CShared", "c-archive": "CArchive", "plugin": "Plugin", "archive": "Archive", "shared": "Shared"}
    out = None
    for raw, name in names.items():
        out = F.when(value == raw, name) if out is None else out.when(value == raw, name)
    return out.otherwise(F.concat(F.lit("Other:"), value))


def build_mode_of(settings: Column) -> Column:
    """Null without any settings; Exe where none is named."""
    return F.when(F.size(settings) > 0, build_mode(F.coalesce(setting(settings, "-buildmode"), F.lit(""))))


def build_tags(settings: Column) -> Column:
    tags = F.split(setting(settings, "-tags"), ",")
    return F.coalesce(F.filter(tags, lambda t: t != ""), F.array().cast("array<string>"))


def compiler(named: Column, version: Column, has_table: Column) -> Column:
    known = F.when(named == "gc", "Gc").when(named == "gccgo", "Gccgo").when(named == "tinygo", "TinyGo")
    return known.when(F.lower(version).contains("tinygo"), "TinyGo").when(has_table, "Gc").otherwise("Unknown")


def obfuscation_tier(obfuscated: Column, total: Column, scrubbed: Column) -> Column:
    """0 none, 1 low, 2 medium, 3 high: shares of a half and a fifth, in integers."""
    half, fifth = obfuscated * 2 >= total, obfuscated * 5 >= total
    return F.when(total == 0, 0).when(half & scrubbed, 3).when(half, 2).when(fifth, 1).otherwise(0)


def zigzag(unsigned: Column) -> Column:
    half = F.shiftright(unsigned, 1)
    return F.when(unsigned % 2 == 1, -half - 1).otherwise(half)


def wrap32(value: Column) -> Column:
    """As a signed 32-bit integer, in BIGINT."""
    return F.pmod(value + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)


def align_up(value: Column, to: Column) -> Column:
    """Null for an alignment of 0."""
    return F.when(to != 0, F.floor((value + to - 1) / to).cast("bigint") * to)


def uvarint(octets: Column) -> Column:
    """Value of an array of byte values, null unless it ends with one below 128 within ten."""
    start = F.struct(F.lit(0).cast("bigint").alias("v"), F.lit(0).alias("n"), F.lit(False).alias("done"))
    step = lambda s, b: F.when(s["done"], s).otherwise(
        F.struct(
            (s["v"] + b.bitwiseAND(127).cast("bigint") * F.pow(F.lit(128.0), s["n"]).cast("bigint")).alias("v"),
            (s["n"] + 1).alias("n"),
            (b < 128).alias("done"),
        )
    )
    return F.aggregate(F.slice(octets, 1, 8), start, step, lambda s: F.when(s["done"], s["v"]))


def source_tier(path: Column) -> Column:
    """SDK or USER."""
    return F.when(path.contains("/libexec/src/") | path.contains("/go/src/") | path.contains("GOROOT"), "SDK").otherwise("USER")


def sdk_package(path: Column) -> Column:
    """The directory below the last /src/ of an SDK path."""
    below = F.regexp_extract(path, "(?s)^.*/src/(.*)$", 1)
    named = F.when(path.contains("/src/"), F.regexp_replace(below, "/[^/]*$", "")).otherwise("(other)")
    return F.when(source_tier(path) == "SDK", named)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def size_mb(length: Column) -> Column:
    return length / F.lit(1048576.0)


def hex_va(va: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(va)))


#: Kinds by their code.
KINDS = (
    "invalid bool int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr float32 float64 complex64 "
    "complex128 array chan func interface map pointer slice string struct unsafe.Pointer"
).split()


def kind_name(code: Column) -> Column:
    low = code.bitwiseAND(31)
    return F.when(low.between(1, 26), F.element_at(F.array(*[F.lit(k) for k in KINDS[1:]]), F.when(low.between(1, 26), low).otherwise(1))).otherwise("invalid")


def arch(min_lc: Column, ptr_size: Column) -> Column:
    known = {(1, 4): "X86", (1, 8): "X86_64", (4, 4): "Arm", (4, 8): "Arm64", (2, 8): "S390x"}
    out = None
    for (lc, ps), name in known.items():
        hit = (min_lc == lc) & (ptr_size == ps)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Unknown")


def version_range(version: Column) -> Column:
    """The releases that write a table version."""
    known = {"Go12": "Go 1.2 - 1.15", "Go116": "Go 1.16 - 1.17", "Go118": "Go 1.18 - 1.19", "Go120": "Go 1.20+"}
    out = None
    for v, label in known.items():
        out = F.when(version == v, label) if out is None else out.when(version == v, label)
    return out
