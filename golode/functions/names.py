"""Function and type names as Column expressions: all of them stay in whole-stage code.

Names are split by patterns with a nesting depth of at most three; generic arguments of names that
are nested deeper are found by a fold over their letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BRACKETS = r"\[(?:[^\[\]]|\[(?:[^\[\]]|\[[^\[\]]*\])*\])*\]"
_PARENS = r"\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)"
#: Package and the rest: the first dot after the last slash, past one ".v<digits>" if a dot follows.
PACKAGE = r"(?s)^((?:.*/)?[^/.]*(?:\.v[0-9]+)?)\.([^/]*)\z"
CLOSURE = r"\.(?:func|gowrap)[0-9]+(?:\.|\z)"
IN_PARENS = rf"(?s)^({_PARENS})\.(.+)\z"
BARE = rf"(?s)^([A-Za-z_][A-Za-z0-9_]*(?:{_BRACKETS}[^.\[\]]*)*)\.(.+)\z"

#: Labels of special functions by their id.
FUNC_IDS = {
    80: "abort", 81: "asmcgocall", 82: "asyncPreempt", 83: "cgocallback", 84: "debugCallV2", 85: "gcBgMarkWorker", 86: "goexit",
    87: "gogo", 88: "gopanic", 89: "handleAsyncEvent", 90: "mcall", 91: "morestack", 92: "mstart", 93: "panicwrap", 94: "rt0_go",
    95: "runfinq", 96: "runtime_main", 97: "sigpanic", 98: "systemstack", 99: "systemstack_switch", 100: "wrapper",
}
#: Functions that betray cgo and goroutines.
CGO = ("runtime.cgocall", "runtime.cgocallback", "runtime.cgocall_native", "runtime.asmcgocall", "runtime.cgoCheckPointer", "runtime._cgo_panic")
CONCURRENCY = (
    "runtime.newproc", "runtime.chansend", "runtime.chansend1", "runtime.chanrecv", "runtime.chanrecv1", "runtime.chanrecv2",
    "runtime.closechan", "runtime.selectgo",
)
INTERNAL = ("runtime", "internal/", "vendor/", "type:")


def _group(name: Column, pattern: str, group: int) -> Column:
    """A group of a match, null where there is none (regexp_extract alone gives '' then)."""
    return F.when(name.rlike(pattern), F.regexp_extract(name, pattern, group))


def package(name: Column) -> Column:
    return _group(name, PACKAGE, 1)


def short_name(name: Column) -> Column:
    return F.coalesce(_group(name, PACKAGE, 2), name)


def bit(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(mask) != 0


def is_top_frame(flags: Column) -> Column:
    return bit(flags, 1)


def is_sp_write(flags: Column) -> Column:
    return bit(flags, 2)


def is_asm(flags: Column) -> Column:
    return bit(flags, 4)


def is_closure(name: Column, flags: Column) -> Column:
    return ~is_asm(flags) & name.rlike(CLOSURE)


def _split(short: Column, group: int) -> Column:
    return F.when(short.startswith("("), _group(short, IN_PARENS, group)).otherwise(_group(short, BARE, group))


def receiver_text(name: Column, flags: Column) -> Column:
    return F.when(~is_closure(name, flags), _split(short_name(name), 1))


def method_name(name: Column, flags: Column) -> Column:
    return F.when(~is_closure(name, flags), _split(short_name(name), 2))


def is_method(name: Column, flags: Column) -> Column:
    return receiver_text(name, flags).isNotNull()


def receiver(name: Column, flags: Column) -> Column:
    """name, pointer, generic_args of a method's receiver; null for others."""
    return receiver_of(receiver_text(name, flags))


def receiver_of(text: Column) -> Column:
    """The same of the receiver's text."""
    inner = F.when(text.startswith("(") & text.endswith(")"), F.expr("null")).otherwise(text)
    inner = F.coalesce(inner, F.regexp_extract(text, r"(?s)^\((.*)\)\z", 1))
    plain = F.regexp_replace(inner, r"^\*", "")
    spec = F.struct(
        F.regexp_extract(plain, r"(?s)^([^\[]*)", 1).alias("name"),
        inner.startswith("*").alias("pointer"),
        F.when(plain.contains("["), F.regexp_extract(plain, r"(?s)(\[.*)\z", 1)).alias("generic_args"),
    )
    return F.when(text.isNotNull(), spec)


def with_method(df: DataFrame, name: str = "name", flags: str = "flags") -> DataFrame:
    """df with is_method, receiver and method_name, every name being matched once: the parts of a
    name are extracted together, and what stands in them is looked at afterwards."""
    n, f = F.col(name), F.col(flags)
    short = F.coalesce(F.regexp_extract(n, PACKAGE, 2), F.lit(""))
    short = F.when(short != "", short).otherwise(F.when(n.rlike(PACKAGE), "").otherwise(n))
    text = F.when(~is_closure(n, f), short)
    bracketed = text.startswith("(")
    # An empty match is no method: both parts of one have at least a letter.
    cut = F.when(bracketed, F.regexp_replace(text, IN_PARENS, "$1\u0000$2")).otherwise(F.regexp_replace(text, BARE, "$1\u0000$2"))
    parts = F.when(cut != text, F.split(cut, "\u0000", 2))
    found = df.withColumn("method_parts", parts)
    recv = F.get("method_parts", F.lit(0))
    return found.withColumns(
        {"is_method": F.col("method_parts").isNotNull(), "receiver": receiver_of(recv), "method_name": F.get("method_parts", F.lit(1))}
    ).drop("method_parts")


def generic_args(name: Column) -> Column:
    """The last bracketed part at depth 0 of the short name, at any depth of nesting."""
    short = short_name(name)
    found = F.regexp_extract_all(short, F.lit(f"({_BRACKETS})"), F.lit(1))
    return F.when(nested_deeper(short), _last_top_level(short)).when(F.size(found) > 0, F.element_at(found, -1))


def _last_top_level(short: Column) -> Column:
    """Counts brackets letter by letter: where the last part at depth 0 opens, and where one closes."""
    state = lambda *v: F.struct(*[F.lit(x).cast("int").alias(n) if isinstance(x, int) else x.cast("int").alias(n) for n, x in zip(("at", "depth", "opened", "closed"), v, strict=True)])

    def step(s, letter):
        at, opens, closes = s["at"] + 1, letter == "[", letter == "]"
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        opened = F.when(opens & (s["depth"] == 0), at).otherwise(s["opened"])
        return state(at, depth, opened, F.when(closes & (depth == 0), at).otherwise(s["closed"]))

    ends = F.aggregate(F.split(short, ""), state(0, 0, 0, 0), step)
    part = lambda e: F.when((e["opened"] > 0) & (e["closed"] > e["opened"]), F.substring(short, e["opened"], e["closed"] - e["opened"] + 1))
    return F.get(F.transform(F.array(ends), part), F.lit(0))


def is_runtime(name: Column) -> Column:
    return name.startswith("runtime.")


def is_internal(name: Column) -> Column:
    pkg = F.coalesce(package(name), F.lit(""))
    out = F.lit(False)
    for prefix in INTERNAL:
        out = out | pkg.startswith(prefix)
    return out


def is_stdlib(name: Column) -> Column:
    pkg = package(name)
    return ~is_internal(name) & F.coalesce(~pkg.contains("."), F.lit(False))


def tier(pkg: Column) -> Column:
    """USER, STDLIB or INTERNAL; sorts after ``tier_rank``."""
    internal = pkg == "(unknown)"
    for prefix in INTERNAL:
        internal = internal | pkg.startswith(prefix)
    return F.when((pkg == "main") | pkg.contains("."), "USER").when(internal, "INTERNAL").otherwise("STDLIB")


def tier_rank(pkg: Column) -> Column:
    return F.when(tier(pkg) == "USER", 0).when(tier(pkg) == "STDLIB", 1).otherwise(2)


def func_id_name(func_id: Column) -> Column:
    out = F.when(func_id == 0, F.lit(None).cast("string"))
    for code, label in FUNC_IDS.items():
        out = out.when(func_id == code, label)
    return out.otherwise(F.when(func_id.isNotNull(), "unknown_special"))


def is_systemstack(func_id: Column) -> Column:
    return func_id.isin(98, 99)


def is_cgo(name: Column) -> Column:
    return name.isin(*CGO)


def is_concurrency(name: Column) -> Column:
    return name.isin(*CONCURRENCY)


def is_garble_token(pkg: Column) -> Column:
    return pkg.rlike(r"^[A-Za-z0-9_]{8,16}\z") & pkg.rlike("[0-9]")


def sort_rank(name: Column, flags: Column) -> Column:
    """Methods, functions, closures: the order of reports."""
    return F.when(is_closure(name, flags), 2).when(is_method(name, flags), 0).otherwise(1)


def type_package(name: Column) -> Column:
    """The package of a qualified type name: pointers, one slice, one array and a map are stripped."""
    bare = F.regexp_replace(name, r"^\**", "")
    bare = F.regexp_replace(bare, r"^\[\]\**", "")
    bare = F.regexp_replace(bare, r"^\[[^\]]*\]\**", "")
    bare = F.regexp_replace(bare, r"^map\[", "")
    found = F.regexp_extract(bare, r"^([A-Za-z0-9/_-]+)\.", 1)
    return F.when(found != "", found)


def type_base_name(name: Column) -> Column:
    """The last part of a qualified type name, pointers stripped."""
    return F.element_at(F.split(F.regexp_replace(name, r"^\**", ""), r"\."), -1)


def type_is_exported(name: Column) -> Column:
    """Whether the first letter of the qualified name, a star skipped, is an ASCII capital."""
    return name.rlike(r"^\*?[A-Z]")


def nested_deeper(name: Column) -> Column:
    """Where the patterns may not reach: brackets or parentheses over three deep."""
    return name.rlike(r"\[[^\]]*\[[^\]]*\[[^\]]*\[") | name.rlike(r"\([^)]*\([^)]*\([^)]*\(")


def derived(df, name="name", flags="flags", func_id="func_id", deferreturn="deferreturn"):
    """df with every derived column of a function row."""
    n, f, i = F.col(name), F.col(flags), F.col(func_id)
    return with_method(df, name, flags).withColumns(
        {
            "package": package(n), "short_name": short_name(n), "generic_args": generic_args(n), "is_closure": is_closure(n, f), "is_runtime": is_runtime(n),
            "is_internal": is_internal(n), "is_stdlib": is_stdlib(n), "uses_defer": F.col(deferreturn) != 0, "is_top_frame": is_top_frame(f),
            "is_sp_write": is_sp_write(f), "is_asm": is_asm(f), "is_systemstack": is_systemstack(i), "func_id_name": func_id_name(i),
        }
    )
