"""Tables of a corpus of executables: one row in, many rows out, a family of tables per pass.

An image is a row (path, length, content). Kernels run through mapInArrow, a few images per Arrow
batch, and only the family that a query asks for is decoded; all that can be said in Column
expressions (names, verdicts, ranges) is left to Catalyst. An image's rows are its own, so every
builder works on streams too.

An image is named by a hash of its content. A corpus holds copies of files, so in batch the rows of
every table are numbered within their image and each number is kept once; ``images`` has a row for
each file. (A stream drops copies where it is read, see ``golode.streaming.ingest``.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from golode.functions import names, values
from golode.operators import schemas
from golode.sources import buildmeta, container, lines, module, runtime_types

#: Rows of a batch that a kernel hands back at once.
ROWS_OUT = 512


def read_images(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, length, content of every file below a path."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length", "content")


def prefiltered(images: DataFrame) -> DataFrame:
    """Images that the fast test takes for the toolchain's; markers are sought before the kernel."""
    return images.where(values.detect(F.col("content")))


class Parsed:
    """One image's parts, each read when first asked for."""

    def __init__(self, content: bytes):
        self.content = bytes(content)
        self.image_id = hashlib.sha256(self.content).hexdigest()
        self.container = container.read(self.content)
        self._kept: dict = {}

    def _once(self, name: str, make: Callable):
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    @property
    def info(self):
        return self._once("info", lambda: buildmeta.build_info(self.container))

    @property
    def scanned(self):
        return self._once("scanned", lambda: buildmeta.version_text(self.content))

    @property
    def version(self):
        own = self.info["go_version"] if self.info else None
        return own if own is not None else self.scanned

    @property
    def table(self):
        return self._once("table", lambda: lines.find(self.container))

    @property
    def module(self):
        return self._once("module", lambda: module.find(self.container, self.table, self.version))


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    def fit(value, kind):
        if value is None:
            return None
        if pa.types.is_decimal(kind):
            return Decimal(value)
        if pa.types.is_list(kind):
            return [fit(v, kind.value_type) for v in value]
        if pa.types.is_struct(kind):
            fields = [kind.field(i) for i in range(kind.num_fields)]
            got = value if isinstance(value, dict) else dict(zip((f.name for f in fields), value, strict=True))
            return {f.name: fit(got.get(f.name), f.type) for f in fields}
        return value

    return pa.RecordBatch.from_arrays([pa.array([fit(r.get(f.name), f.type) for r in rows], f.type) for f in schema], schema=schema)


def _family(images: DataFrame, ddl: str, rows_of: Callable[[Parsed], Iterator[dict]]) -> DataFrame:
    schema = StructType.fromDDL(f"{ddl}, nth_row bigint")
    # Column types of DECIMAL(20,0) and plain widths only, so the Arrow schema needs no session.
    arrow = pa.schema([pa.field(f.name, f.type) for f in to_arrow_schema(schema)])

    def run(batches):
        for batch in batches:
            out: list[dict] = []
            for content in batch.column(0):
                raw = content.as_py()
                parsed = Parsed(raw if raw is not None else b"")
                for nth, row in enumerate(rows_of(parsed)):
                    out.append({"image_id": parsed.image_id, "nth_row": nth} | row)
                    if len(out) >= ROWS_OUT:
                        yield _arrow(out, arrow)
                        out = []
            if out:
                yield _arrow(out, arrow)

    found = images.select("content").mapInArrow(run, schema)
    once = found if images.isStreaming else found.dropDuplicates(["image_id", "nth_row"])
    return once.drop("nth_row")


def sections(images: DataFrame) -> DataFrame:
    def rows(p: Parsed):
        for slot in ("gopclntab", "go_buildinfo", "note", "go_module", "typelink", "itablink"):
            span = p.container.ranges.get(slot)
            yield {"slot": slot, "present": slot in p.container.present} | (dict(zip(("offset", "size", "va"), span, strict=True)) if span else {})

    return _family(images, schemas.SECTIONS, rows)


def segments(images: DataFrame) -> DataFrame:
    return _family(images, schemas.SEGMENTS, lambda p: ({"ord": i, "va": a, "file_off": o, "size": s} for i, (a, o, s) in enumerate(p.container.segments)))


def notes(images: DataFrame) -> DataFrame:
    return _family(images, schemas.NOTES, lambda p: ({"ord": i, "file_off": o, "size": s} for i, (o, s) in enumerate(p.container.notes)))


def pclntab(images: DataFrame) -> DataFrame:
    def rows(p: Parsed):
        if t := p.table:
            yield {
                "offset": t.offset, "version": t.version, "min_lc": t.min_lc, "ptr_size": t.ptr_size, "nfunc": t.nfunc, "nfiles": t.nfiles,
                "funcname_offset": t.names_at, "cu_offset": t.cu_at, "filetab_offset": t.files_at, "pctab_offset": t.values_at,
                "functab_offset": t.functions_at, "arch": t.arch,
            }

    return _family(images, schemas.PCLNTAB, rows)


def source_files(images: DataFrame) -> DataFrame:
    return _family(images, schemas.SOURCE_FILES, lambda p: ({"ord": i, "path": f} for i, f in enumerate(p.table.files() if p.table else ())))


def functions(images: DataFrame, with_derived: bool = True) -> DataFrame:
    found = _family(images, schemas.FUNCTIONS, lambda p: ({"ord": i} | f for i, f in enumerate(lines.functions(p.table) if p.table else ())))
    return names.derived(found) if with_derived else found


def function_tables(images: DataFrame, strict: bool = False) -> DataFrame:
    """Functions with their decoded tables nested; user code goes on from here (applyInArrow)."""

    def rows(p: Parsed):
        for f in lines.functions(p.table) if p.table else ():
            t = p.table
            pcfile = [(pc, v & 0xFFFFFFFF) for pc, v in t.values(f["pcfile"], strict)]
            paths = [(pc, t.file(f["cu_offset"], i)) for pc, i in pcfile]
            yield {
                "func_off": f["func_off"], "name": f["name"], "pcfile": pcfile, "pcsp": list(t.values(f["pcsp"], strict)),
                "pcln": [(pc, v + f["start_line"]) for pc, v in t.values(f["pcln"], strict)], "paths": [x for x in paths if x[1] is not None],
            }

    return _family(images, schemas.FUNCTION_TABLES, rows)


def pc_values(images: DataFrame, strict: bool = False) -> DataFrame:
    """A row per entry of each table, with the range it holds for."""
    kinds = F.array(*[F.struct(F.lit(t).alias("table"), F.col(t).alias("pairs")) for t in ("pcln", "pcsp", "pcfile")])
    every = function_tables(images, strict).select("image_id", "func_off", "paths", F.explode(kinds).alias("of"))
    every = every.select("image_id", "func_off", "paths", "of.table", F.posexplode("of.pairs").alias("ord", "at"))
    path = F.when(F.col("table") == "pcfile", F.get(F.filter("paths", lambda x: x["pc"] == F.col("at.pc")), F.lit(0))["path"])
    every = every.select("image_id", "func_off", "table", "ord", F.col("at.pc").alias("pc_end"), F.col("at.value").alias("value"), path.alias("path"))
    before = Window.partitionBy("image_id", "func_off", "table").orderBy("ord")
    start = F.lag("pc_end", 1, 0).over(before)
    return every.withColumn("pc_start", start).select("image_id", "func_off", "table", "ord", "pc_start", "pc_end", "value", "path")


def inline_entries(images: DataFrame) -> DataFrame:
    def rows(p: Parsed):
        for f in lines.functions(p.table) if p.table else ():
            yield from runtime_types.inline_entries(p.container, p.table, p.module, f)

    return _family(images, schemas.INLINE, rows)


def moduledata(images: DataFrame) -> DataFrame:
    return _family(images, schemas.MODULEDATA, lambda p: iter([p.module] if p.module else []))


def types(images: DataFrame) -> DataFrame:
    found = _family(
        images, schemas.TYPES, lambda p: ({"ord": i} | t for i, t in enumerate(runtime_types.Types(p.container, p.table, p.module).rows()))
    )
    return found.withColumns({"package": names.type_package(F.col("name")), "base_name": names.type_base_name(F.col("name"))})


def struct_fields(found: DataFrame) -> DataFrame:
    return found.select("image_id", "type_va", F.posexplode("fields").alias("ord", "f")).select("image_id", F.col("type_va").alias("owner_va"), "ord", "f.*")


def iface_methods(found: DataFrame) -> DataFrame:
    return found.select("image_id", "type_va", F.posexplode("imethods").alias("ord", "m")).select("image_id", "type_va", "ord", "m.*")


def type_methods(found: DataFrame) -> DataFrame:
    return found.select("image_id", "type_va", F.posexplode("methods").alias("ord", "m")).select("image_id", "type_va", "ord", "m.*")


def func_params(found: DataFrame) -> DataFrame:
    ins = found.select("image_id", "type_va", F.lit("in").alias("way"), F.posexplode("inputs").alias("ord", "param_va"))
    return ins.unionByName(found.select("image_id", "type_va", F.lit("out").alias("way"), F.posexplode("outputs").alias("ord", "param_va")))


def type_edges(found: DataFrame) -> DataFrame:
    """from_va, to_va, role: the graph of types."""
    one = lambda column, role: found.where(F.col(column).isNotNull()).select("image_id", F.col("type_va").alias("from_va"), F.col(column).alias("to_va"), F.lit(role).alias("role"))
    inner = found.select("image_id", F.col("type_va").alias("from_va"), F.explode("fields").alias("f"))
    params = func_params(found).select("image_id", F.col("type_va").alias("from_va"), F.col("param_va").alias("to_va"), F.lit("param").alias("role"))
    return (
        one("elem_va", "elem")
        .unionByName(one("key_va", "key"))
        .unionByName(inner.select("image_id", "from_va", F.col("f.type_va").alias("to_va"), F.lit("field").alias("role")))
        .unionByName(params)
    )


def itabs(images: DataFrame) -> DataFrame:
    return _family(images, schemas.ITABS, lambda p: ({"ord": i} | t for i, t in enumerate(runtime_types.itabs(p.container, p.table, p.module))))


def implementations(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """What implements what: interface and concrete type of every pair, by address within an image."""
    iface = found.select("image_id", F.col("type_va").alias("iface_type_va"), F.col("name").alias("iface_name"))
    concrete = found.select("image_id", F.col("type_va").alias("concrete_type_va"), F.col("name").alias("concrete_name"))
    return pairs.join(iface, ["image_id", "iface_type_va"], "left").join(concrete, ["image_id", "concrete_type_va"], "left")


def go_strings(images: DataFrame) -> DataFrame:
    return _family(images, schemas.STRINGS, lambda p: runtime_types.strings(p.container, p.table, p.module))


# Build information


def _image_parts(images: DataFrame, with_names: bool = False) -> DataFrame:
    """What the verdict on an image rests on: one row each, the content no longer in it;
    ``with_names`` also the names of its functions."""
    schema = StructType.fromDDL(schemas.IMAGE_PARTS)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            out = []
            for path, length, content in zip(*(batch.column(i) for i in range(3)), strict=True):
                path, length, p = path.as_py(), length.as_py(), Parsed(content.as_py() or b"")
                held, info, table, mod = p.container.present, p.info, p.table, p.module
                hits = sum(n.encode() in p.content for n in values.NEEDLES)
                out.append(
                    {
                        "image_id": p.image_id, "path": path, "length": length, "format": p.container.format, "has_gopclntab": "gopclntab" in held,
                        "has_go_buildinfo": "go_buildinfo" in held, "has_note": "note" in held, "build_id": buildmeta.build_id(p.container),
                        "info_found": info is not None, "info_version": info["go_version"] if info else None, "mod_text": info["mod_text"] if info else None,
                        "scanned_version": None if info and info["go_version"] is not None else p.scanned, "table_version": table.version if table else None,
                        "nfunc": table.nfunc if table else None, "heuristic_hits": hits, "text_va": mod["text"] if mod else None,
                        "etext_va": mod["etext"] if mod else None,
                        "function_names": [f["name"] for f in lines.functions(table)] if with_names and table else None,
                    }
                )
            if out:
                yield _arrow(out, arrow)

    return images.select("path", "length", "content").mapInArrow(run, schema)


def report_of(parts: DataFrame) -> DataFrame:
    """tier and signals from the parts of an image, in the order in which they are looked for."""

    def signal(when: Column, kind: str, **more) -> Column:
        field = lambda name, kind_: more.get(name, F.lit(None)).cast(kind_).alias(name)
        made = F.struct(
            F.lit(kind).alias("kind"), field("detail", "string"), field("version", "string"), field("source", "string"), field("nfunc", "bigint"),
            field("hits", "int"), field("reason", "string"),
        )
        return F.when(when, made)

    c = F.col
    version = F.coalesce("info_version", "scanned_version")
    has_table = c("table_version").isNotNull()
    high = c("has_gopclntab") | c("has_go_buildinfo") | c("has_note") | c("build_id").isNotNull() | has_table
    medium = c("info_found") | version.isNotNull()
    low = c("heuristic_hits") >= values.LEAST_HITS
    signals = F.array_compact(
        F.array(
            signal(c("has_gopclntab"), "GopclntabSectionPresent"),
            signal(c("has_go_buildinfo"), "BuildinfoSectionPresent"),
            signal(c("has_note"), "BuildidNotePresent"),
            signal(c("build_id").isNotNull(), "BuildIdMarkerFound"),
            signal(c("info_found"), "BuildinfoParsed"),
            signal(~c("info_found"), "BuildinfoMissing", reason=F.lit("no build information header")),
            signal(has_table, "PclntabParsed", version=c("table_version"), nfunc=c("nfunc")),
            signal(~has_table, "PclntabMissing", reason=F.lit("no line table header or shape")),
            signal(version.isNotNull(), "GoVersionString", version=version, source=F.when(c("info_version").isNotNull(), "BuildInfoBlob").otherwise("StringScan")),
            signal(~high & ~medium & low, "HeuristicStringsMatched", hits=c("heuristic_hits")),
        )
    )
    return parts.withColumns(
        {
            "tier": F.when(high, 3).when(medium, 2).when(low, 1).otherwise(0), "signals": signals, "go_version": version,
            "version_source": F.when(c("info_version").isNotNull(), "BuildInfoBlob").when(version.isNotNull(), "StringScan"),
        }
    )


def mod_lines(parts: DataFrame) -> DataFrame:
    """image_id, ln, tag, f1, f2, f3 from the module text."""
    split = F.split("mod_text", "\r?\n")
    found = parts.where("mod_text is not null").select("image_id", F.posexplode(split).alias("ln", "line")).where("line <> ''")
    cells = F.split("line", "\t", 4)
    return found.select("image_id", "ln", *[F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(("tag", "f1", "f2", "f3"))])


def dependencies(found: DataFrame) -> DataFrame:
    """ord, path, version, sum, repl: a replacement belongs to the last dependency before it, the
    last of several counts."""
    so_far = Window.partitionBy("image_id").orderBy("ln").rowsBetween(Window.unboundedPreceding, 0)
    tied = found.where(F.col("tag").isin("dep", "=>") & F.col("f1").isNotNull()).withColumn(
        "dep_ln", F.max(F.when(F.col("tag") == "dep", F.col("ln"))).over(so_far)
    )
    repl = F.struct(F.col("f1").alias("path"), F.col("f2").alias("version"), F.col("f3").alias("sum"))
    is_dep = F.col("tag") == "dep"
    grouped = tied.where("dep_ln is not null").groupBy("image_id", "dep_ln").agg(
        F.max(F.when(is_dep, F.struct("ln", "f1", "f2", "f3"))).alias("d"), F.max_by(F.when(~is_dep, repl), F.when(~is_dep, F.col("ln"))).alias("repl")
    )
    ord_ = F.row_number().over(Window.partitionBy("image_id").orderBy("dep_ln")) - 1
    return grouped.select("image_id", ord_.alias("ord"), F.col("d.f1").alias("path"), F.col("d.f2").alias("version"), F.col("d.f3").alias("sum"), "repl")


def build_settings(found: DataFrame) -> DataFrame:
    """ord, key, value in the order written; a setting without "=" has an empty value."""
    at = F.instr("f1", "=")
    ord_ = F.row_number().over(Window.partitionBy("image_id").orderBy("ln")) - 1
    return found.where((F.col("tag") == "build") & F.col("f1").isNotNull()).select(
        "image_id", ord_.alias("ord"), F.when(at > 0, F.expr("left(f1, instr(f1, '=') - 1)")).otherwise(F.col("f1")).alias("key"),
        F.when(at > 0, F.expr("substring(f1, instr(f1, '=') + 1)")).otherwise("").alias("value"),
    )


def build_info(parts: DataFrame) -> DataFrame:
    """main_path, main_module, main_version (the last line of each tag counts) and go_version."""
    found = mod_lines(parts)
    last = lambda tag, column: F.max_by(F.when((F.col("tag") == tag) & F.col(column).isNotNull(), F.col(column)), F.when((F.col("tag") == tag) & F.col(column).isNotNull(), F.col("ln")))
    mains = found.groupBy("image_id").agg(last("path", "f1").alias("main_path"), last("mod", "f1").alias("main_module"), last("mod", "f2").alias("main_version"))
    own = parts.where("info_found").select("image_id", F.col("info_version").alias("go_version"))
    return own.join(mains, "image_id", "left")


def images(found: DataFrame, gate: bool = True) -> DataFrame:
    """The verdict on every file; with ``gate`` only on those that are the toolchain's at all. One
    pass of the kernels: all that follows looks into the arrays of a row."""
    parts = report_of(_image_parts(found, with_names=True))
    parts = parts.where("tier > 0") if gate else parts
    whole = parts.withColumn("lines", F.split("mod_text", "\r?\n")).withColumn("cells", F.transform("lines", lambda x: F.split(x, "\t", 4)))
    tagged = lambda tag: F.filter("cells", lambda c: (F.get(c, F.lit(0)) == tag) & (F.size(c) > 1))
    written = F.transform(tagged("build"), lambda c: F.get(c, F.lit(1)))
    pair = lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(F.instr(x, "=") > 0, F.substring(x, F.instr(x, "=") + 1, F.length(x))).otherwise("").alias("value"))
    code = F.col("function_names")
    user = F.filter(code, lambda n: ~names.is_runtime(n) & ~names.is_internal(n))
    packages = F.array_distinct(F.array_compact(F.transform(user, names.package)))
    whole = whole.withColumns({"settings": F.transform(written, pair), "n_deps": F.size(tagged("dep")), "packages": packages})
    whole = whole.withColumns(
        {
            "total": F.size("packages").cast("bigint"), "obfuscated": F.size(F.filter("packages", names.is_garble_token)).cast("bigint"),
            "has_cgo": F.exists(code, names.is_cgo), "uses_concurrency": F.exists(code, names.is_concurrency),
        }
    )
    has_table = F.col("table_version").isNotNull()
    obf = F.coalesce(values.obfuscation_tier(F.col("obfuscated"), F.col("total"), F.coalesce("n_deps", F.lit(0)) == 0), F.lit(0))
    return whole.select(
        "image_id", "path", "length", "format", "tier", "signals", "build_id", "go_version", "version_source",
        values.compiler(values.setting(F.col("settings"), "-compiler"), F.col("go_version"), has_table).alias("compiler"),
        values.build_mode_of(F.col("settings")).alias("buildmode"),
        F.when(obf > 0, "Garble").otherwise("None").alias("obf_kind"), obf.alias("obf_tier"),
        F.coalesce("has_cgo", F.lit(False)).alias("has_cgo"), F.coalesce("uses_concurrency", F.lit(False)).alias("uses_concurrency"),
        values.runtime_commit(F.col("go_version")).alias("runtime_commit"), "text_va", "etext_va", (F.col("etext_va") - F.col("text_va")).alias("code_size"),
        values.setting(F.col("settings"), "GOOS").alias("goos"), values.setting(F.col("settings"), "GOARCH").alias("goarch"),
        (values.setting(F.col("settings"), "CGO_ENABLED") == "1").alias("cgo_enabled"), values.setting(F.col("settings"), "vcs.revision").alias("vcs_revision"),
        (values.setting(F.col("settings"), "vcs.modified") == "true").alias("vcs_modified"), values.build_tags(F.col("settings")).alias("build_tags"),
    )


def garble_verdict(code: DataFrame, *keys: Column) -> DataFrame:
    """Per key: distinct user packages, and how many of them look scrambled."""
    name = F.col("name")
    user = ~names.is_runtime(name) & ~names.is_internal(name)
    pkg = F.when(user, names.package(name))
    return code.select(*keys, pkg.alias("pkg")).distinct().groupBy(*keys).agg(
        F.count("pkg").alias("total"), F.count(F.when(names.is_garble_token(F.col("pkg")), 1)).alias("obfuscated")
    )
