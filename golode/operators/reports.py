"""Reports over function, type and file tables: groups, orders and summaries of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from golode.functions import names, values


def package_or_unknown(name: Column) -> Column:
    return F.coalesce(names.package(name), F.lit("(unknown)"))


def tier_report(code: DataFrame) -> DataFrame:
    """Counts per tier and package of (name, flags, deferreturn)."""
    name, flags = F.col("name"), F.col("flags")
    pkg = package_or_unknown(name)
    return (
        code.withColumns({"package": pkg, "tier": names.tier(pkg)})
        .groupBy("tier", "package")
        .agg(
            F.count(F.lit(1)).alias("n_funcs"),
            F.count_if(names.is_method(name, flags)).alias("n_methods"),
            F.count_if(names.is_closure(name, flags)).alias("n_closures"),
            F.count_if(F.col("deferreturn") != 0).alias("n_defer"),
        )
    )


def user_code(code: DataFrame) -> DataFrame:
    """Functions that belong to neither the runtime nor its internals."""
    return code.where(~names.is_runtime(F.col("name")) & ~names.is_internal(F.col("name")))


def package_listing(code: DataFrame, total: bool = True) -> DataFrame:
    """tier, package, n_funcs and the names of a package's functions (each once, in order), in the
    order of tiers and packages; with ``total`` a last row of package null that sums the groups up."""
    pkg = package_or_unknown(F.col("name"))
    named = code.groupBy(names.tier(pkg).alias("tier"), pkg.alias("package"), "name").agg(F.count(F.lit(1)).alias("n"))
    groups = named.groupBy("tier", "package").agg(F.sum("n").alias("n_funcs"), F.array_sort(F.collect_list("name")).alias("functions"))
    if total:
        nothing = [F.lit(None).cast("string").alias(c) for c in ("tier", "package")]
        summed = named.agg(F.sum("n").alias("n_funcs")).select(*nothing, "n_funcs", F.lit(None).cast("array<string>").alias("functions"))
        groups = groups.unionByName(summed)
    rank = F.when(F.col("package").isNotNull(), names.tier_rank(F.col("package"))).otherwise(3)
    return groups.orderBy(rank, "package")


def has_no_dependencies(deps: Column) -> Column:
    """Whether a list of dependencies is empty; true where none is known."""
    return F.coalesce(F.size(deps) <= 0, F.lit(True))


def summary(code: DataFrame) -> DataFrame:
    """One row: totals over all functions; a name without package counts as its empty package."""
    name, flags = F.col("name"), F.col("flags")
    pkg = F.coalesce(names.package(name), F.lit(""))
    return code.agg(
        F.count(F.lit(1)).alias("n_funcs"),
        F.count_if(names.tier(pkg) == "USER").alias("n_user"),
        F.count_if(names.tier(pkg) == "STDLIB").alias("n_stdlib"),
        F.count_if(names.tier(pkg) == "INTERNAL").alias("n_internal"),
        F.count_if(names.is_method(name, flags)).alias("n_methods"),
        F.count_if(names.is_closure(name, flags)).alias("n_closures"),
        F.count_if(F.col("deferreturn") != 0).alias("n_defer"),
        F.countDistinct(package_or_unknown(name)).alias("n_packages"),
    )


def packages_of_both(code: DataFrame, found: DataFrame) -> DataFrame:
    """package, n_funcs, n_types: packages of functions and of types, those of one kind only too."""
    funcs = code.groupBy(package_or_unknown(F.col("name")).alias("package")).agg(F.count(F.lit(1)).alias("n_funcs"))
    kinds = found.groupBy(F.coalesce(names.type_package(F.col("name")), F.lit("(unknown)")).alias("package")).agg(F.count(F.lit(1)).alias("n_types"))
    zero = F.lit(0).cast("bigint")
    return funcs.join(kinds, "package", "full_outer").select("package", F.coalesce("n_funcs", zero).alias("n_funcs"), F.coalesce("n_types", zero).alias("n_types"))


def type_only_packages(code: DataFrame, found: DataFrame) -> DataFrame:
    funcs = code.select(package_or_unknown(F.col("name")).alias("package")).distinct()
    kinds = found.select(F.coalesce(names.type_package(F.col("name")), F.lit("(unknown)")).alias("package")).distinct()
    return kinds.join(funcs, "package", "left_anti")


def tier_breaks(found: DataFrame) -> DataFrame:
    """Packages (each once) with a mark where, in report order, the tier changes: at the first
    package of each of the three tiers."""
    tier = names.tier_rank(F.col("package"))
    firsts = found.groupBy(tier.alias("tier_rank")).agg(F.min("package").alias("first_package"))
    ranked = found.withColumn("tier_rank", tier).join(F.broadcast(firsts), "tier_rank")
    return ranked.withColumn("starts_tier", F.col("package") == F.col("first_package")).drop("tier_rank", "first_package")


def function_order(code: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """nth of each function in its group's listing: methods, functions, closures, then by name."""
    rank = names.sort_rank(F.col("name"), F.col("flags"))
    return code.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, "name", ordinal)))


def display_tags(flags: Column, deferreturn: Column, func_id: Column) -> Column:
    """What a listing says beside a function."""
    tags = F.array_compact(
        F.array(
            F.when(deferreturn != 0, F.lit("defer")),
            F.when(names.is_asm(flags), F.lit("asm")),
            F.when(names.is_top_frame(flags), F.lit("top")),
            F.when(names.is_systemstack(func_id), F.lit("systemstack")),
            names.func_id_name(func_id),
        )
    )
    return F.array_join(tags, ", ")


def source_report(files: DataFrame) -> DataFrame:
    """tier, package, n_files of (path)."""
    path = F.col("path")
    return (
        files.select(values.source_tier(path).alias("tier"), F.coalesce(values.sdk_package(path), F.lit("")).alias("package"))
        .groupBy("tier", "package")
        .agg(F.count(F.lit(1)).alias("n_files"))
    )


def text_report(found: DataFrame) -> DataFrame:
    """The images table as lines of text, ready for the text sink."""
    cell = lambda label, c: F.concat(F.lit(f"{label:<14}: "), F.coalesce(c.cast("string"), F.lit("-")))
    kinds = F.array_join(F.transform("signals", lambda s: s["kind"]), ", ")
    return found.select(
        F.concat_ws(
            "\n",
            cell("Image", F.col("path")), cell("Size (MB)", F.format_number(values.size_mb(F.col("length")), 2)), cell("Format", F.col("format")),
            cell("Go version", F.col("go_version")), cell("Compiler", F.col("compiler")), cell("Build mode", F.col("buildmode")), cell("Build id", F.col("build_id")),
            cell("Text", values.hex_va(F.col("text_va").cast("bigint"))), cell("Obfuscation", F.col("obf_kind")), cell("Signals", kinds),
        ).alias("value")
    )
