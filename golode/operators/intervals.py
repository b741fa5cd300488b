"""Address and PC-range algebra: range lookups, running values, runs, as-of and ancestor joins.

All keys carry the image (or table) they belong to, so every join is an equi-join and no plan needs
a nested loop. A range is sought through bins of its own size, an as-of join is a running last value
over both sides in one order, and ancestors are found by doubling: nothing gathers all ranges of a
key in one row, and no work is a product of ranges and probes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Walks to a root stop after so many steps; a power of two.
DEEPEST = 32
#: Ordinals of a chunk in which runs are sought at once.
CHUNK = 1 << 16
LAST_ADDRESS = "18446744073709551615BD"


def _free(taken, name: str) -> str:
    while name in taken:
        name += "_"
    return name


def _looked_up(segments: DataFrame, addresses: DataFrame, key: str, at: str, start: str, to: str, out: str) -> DataFrame:
    """A segment lies in at most two bins of the least power of two that holds its size; an address
    asks one bin of each such size that its key has (there are at most 65)."""
    wide = lambda c: c.cast("decimal(20,0)")
    segs = segments.select(F.col(key), "ord", F.col(start).alias("lo"), F.col(to).alias("to"), F.col("size").alias("held"))
    beyond = wide(F.col("lo")) + wide(F.col("held")) > F.expr(LAST_ADDRESS)
    ends = segs.where(beyond).groupBy(key).agg(F.min("ord").alias("stop"))
    width = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("held").cast("double")))).cast("decimal(38,0)")
    fine = segs.where(~beyond & (F.col("held") > 0)).withColumn("width", width)
    fine = fine.withColumn("width", F.when(F.col("width") < F.col("held"), F.col("width") * 2).otherwise(F.col("width")).cast("decimal(38,0)"))
    bin_of = lambda c: (c.cast("decimal(38,0)") - c.cast("decimal(38,0)") % F.col("width")).cast("decimal(38,0)")
    first = bin_of(F.col("lo"))
    binned = fine.withColumn("bin", F.explode(F.array(first, (first + F.col("width")).cast("decimal(38,0)"))))
    sizes = fine.groupBy(key).agg(F.collect_set("width").alias("widths"))
    probes = addresses.select(F.col(key), F.col(at).alias("at")).distinct()
    asked = probes.join(sizes, key).select(key, "at", F.explode("widths").alias("width")).withColumn("bin", bin_of(F.col("at")))
    met = asked.join(binned, [key, "width", "bin"]).where((F.col("at") >= F.col("lo")) & (F.col("at") < F.col("lo") + F.col("held")))
    best = met.groupBy(key, "at").agg(F.min_by(F.struct("ord", (F.col("to") + F.col("at") - F.col("lo")).alias("value")), "ord").alias("hit"))
    best = best.join(ends, key, "left").where(F.col("stop").isNull() | (F.col("hit.ord") < F.col("stop")))
    # Names of the addresses' own columns stay free.
    hit = best.select(F.col(key), F.col("at").alias(at), F.col("hit.value").alias(out))
    return addresses.drop(out).join(hit, [key, at], "left") if at != out else addresses.join(hit, [key, at], "left")


def va_to_file(segments: DataFrame, addresses: DataFrame, key: str = "image_id", va: str = "va", out: str = "file_off") -> DataFrame:
    """addresses with the file offset, by the first segment that holds the address; null without
    one, or where a segment before it ends beyond the address space."""
    return _looked_up(segments, addresses, key, va, "va", "file_off", out)


def file_to_va(segments: DataFrame, offsets: DataFrame, key: str = "image_id", offset: str = "file_off", out: str = "va") -> DataFrame:
    return _looked_up(segments, offsets, key, offset, "file_off", "va", out)


def last_per_slot(rows: DataFrame, keys: list[str], value: str, ordinal: str, out: str) -> DataFrame:
    """Of rows of one key the value of the last."""
    return rows.groupBy(*keys).agg(F.max_by(value, ordinal).alias(out))


def first_per_key(rows: DataFrame, keys: list[str], value: str, ordinal: str, out: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min_by(value, ordinal).alias(out))


def _in_order(keys: list[str], ordinal: str):
    return Window.partitionBy(*keys).orderBy(ordinal)


def until_terminator(deltas: DataFrame, keys: list[str], ordinal: str, pc_delta: str) -> DataFrame:
    """Rows before the first whose PC delta is 0."""
    stop = F.min(F.when(F.col(pc_delta) == 0, F.col(ordinal))).over(Window.partitionBy(*keys))
    return deltas.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col(ordinal) < F.col("stop"))).drop("stop")


def wrapped(value, bits: int, signed: bool):
    """A whole number cut to so many bits, as arithmetic of that width leaves it."""
    whole = F.pmod(value.cast("decimal(38,0)"), F.lit(1 << bits).cast("decimal(38,0)"))
    cut = F.when(whole >= F.lit(1 << (bits - 1)).cast("decimal(38,0)"), whole - F.lit(1 << bits).cast("decimal(38,0)")).otherwise(whole) if signed else whole
    return cut.cast("bigint")


def running_values(deltas: DataFrame, keys: list[str], ordinal: str, vdelta: str, pc_delta: str, wrap: bool = True) -> DataFrame:
    """value, pc_start and pc_end from deltas: values start at -1 and PCs at 0. With ``wrap`` values
    are signed and PCs unsigned numbers of 32 bits."""
    so_far = _in_order(keys, ordinal).rowsBetween(Window.unboundedPreceding, 0)
    value, end = F.sum(vdelta).over(so_far) - 1, F.sum(pc_delta).over(so_far)
    found = deltas.withColumns({"value": wrapped(value, 32, True) if wrap else value, "pc_end": wrapped(end, 32, False) if wrap else end})
    return pc_ranges(found, keys, ordinal)


def pc_ranges(rows: DataFrame, keys: list[str], ordinal: str, end: str = "pc_end") -> DataFrame:
    """Half-open ranges: each starts where the one before it ends."""
    return rows.withColumn("pc_start", F.lag(end, 1, 0).over(_in_order(keys, ordinal)))


def active_at(ranges: DataFrame, probes: DataFrame, keys: list[str], pc: str = "pc", out: str = "value") -> DataFrame:
    """probes with the value of the first range (by pc_end) that ends after the PC; -1 without one.
    Both sides go through one window from the last PC to the first, in which a probe stands before
    the ranges that end at it and so takes the last value met: a sort, whatever a key holds."""
    at, of, name = (_free([*probes.columns, *keys], n) for n in ("at", "of", "met"))
    marks = ranges.select(*keys, F.col("pc_end").cast("decimal(20,0)").alias(at), F.struct(F.col("value").alias("v")).alias(of))
    asked = probes.withColumns({at: F.col(pc).cast("decimal(20,0)"), of: F.lit(None).cast(marks.schema[of].dataType)})
    order = Window.partitionBy(*keys).orderBy(F.desc(at), F.col(of).isNotNull(), F.desc(f"{of}.v")).rowsBetween(Window.unboundedPreceding, 0)
    own = _free([*probes.columns, *keys, at, of, name], "own")
    both = asked.withColumn(own, F.lit(True)).unionByName(marks.withColumn(own, F.lit(False)), allowMissingColumns=True)
    found = both.withColumn(name, F.last(of, ignorenulls=True).over(order)).where(own)
    kept = [c for c in probes.columns if c != out]
    return found.select(*kept, F.coalesce(F.col(f"{name}.v"), F.lit(-1)).alias(out))


def monotone_runs(rows: DataFrame, keys: list[str], ordinal: str, value: str) -> DataFrame:
    """run, first, length of every strictly rising run, numbered in order for each key. Rows are cut
    into chunks of CHUNK ordinals, whose summaries (a row each) say where a run goes on over a cut."""
    rows = rows.select(*keys, F.col(ordinal).alias("at"), F.col(value).alias("v")).withColumn("chunk", F.floor(F.col("at") / CHUNK))
    inside = Window.partitionBy(*keys, "chunk").orderBy("at")
    before = F.lag("v").over(inside)
    first = F.row_number().over(inside) == 1
    broken = rows.withColumn("broken", F.when(first | (F.col("v") > before), 0).otherwise(1))
    local = broken.withColumn("part", F.sum("broken").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    parts = local.groupBy(*keys, "chunk", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("length"), F.min_by("v", "at").alias("from"), F.max_by("v", "at").alias("to"))
    ends = parts.groupBy(*keys, "chunk").agg(F.min_by("from", "part").alias("from"), F.max_by("to", "part").alias("to"), F.max("part").alias("breaks"))
    chunks = Window.partitionBy(*keys).orderBy("chunk") if keys else Window.orderBy("chunk")
    starts = F.when(F.col("from") > F.lag("to").over(chunks), 0).otherwise(1)
    based = ends.withColumn("starts", starts)
    base = F.sum(F.col("starts") + F.col("breaks")).over(chunks.rowsBetween(Window.unboundedPreceding, 0)) - F.col("breaks")
    based = based.select(*keys, "chunk", base.alias("base"))
    numbered = parts.join(based, [*keys, "chunk"]).withColumn("run", F.col("base") + F.col("part"))
    return numbered.groupBy(*keys, "run").agg(F.min("first").alias("first"), F.sum("length").alias("length"))


def _cut(df: DataFrame) -> DataFrame:
    """df without its lineage: written to the session's checkpoint folder, or kept where it has none."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return df.checkpoint()
    return df.persist()


def depths(parents: DataFrame, key: str = "id", parent: str = "parent", keys: list[str] | None = None) -> DataFrame:
    """keys, key, depth: steps up to a root (a row without parent, or whose parent is unknown or
    itself), among rows of the same ``keys``. Walks stop in a cycle, and after DEEPEST steps. The
    ancestors of a row are doubled by each join with itself, so DEEPEST takes log2 of it joins."""
    keys = keys or []
    rows = parents.select(*keys, F.col(key).alias("id"), F.col(parent).alias("up"))
    known = rows.select(*keys, F.col("id").alias("up"), F.lit(True).alias("known"))
    one = F.when(F.col("known") & (F.col("up") != F.col("id")), F.array("up")).otherwise(F.expr("cast(array() as array<bigint>)"))
    walks = _cut(rows.join(known, [*keys, "up"], "left").select(*keys, "id", one.alias("path")))
    length = 1
    while length < DEEPEST:
        more = walks.select(*keys, F.col("id").alias("last"), F.col("path").alias("more"))
        full = F.when(F.size("path") == length, F.element_at("path", -1))
        joined = walks.withColumn("last", full).join(more, [*keys, "last"], "left")
        walks = _cut(joined.select(*keys, "id", F.concat("path", F.coalesce("more", F.expr("cast(array() as array<bigint>)"))).alias("path")))
        length *= 2
    whole = F.concat(F.array("id"), F.col("path"))
    # The first place of the walk that it has been at before ends it.
    again = F.filter(F.sequence(F.lit(1), F.size("path")), lambda i: F.array_contains(F.slice(whole, F.lit(1), i), F.element_at(whole, i + 1)))
    depth = F.when(F.size("path") == 0, 0).when(F.size(again) > 0, F.element_at(again, 1) - 1).otherwise(F.size("path"))
    return walks.select(*keys, F.col("id").alias(key), depth.alias("depth"))
