"""One query per operator over adapted tables, beside the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from golode.functions import names, values
from golode.operators import intervals, reports, tables
from golode.plans import adapters as a

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The name grammar, said again with string functions only, so that it shares nothing with the patterns.
_DIGITS = "length({x}) > 0 AND translate({x}, '0123456789', '') = ''"
F_SQL = f"""f0 AS (
  SELECT *, string_split(name, '/')[-1] AS tail, string_split(string_split(name, '/')[-1], '.') AS dotted FROM ({a.plain(a.FUNC)})),
f1 AS (
  SELECT *, CASE WHEN len(dotted) < 2 THEN NULL
                 WHEN len(dotted) > 2 AND starts_with(dotted[2], 'v') AND {_DIGITS.format(x="dotted[2][2:]")} THEN length(dotted[1]) + length(dotted[2]) + 2
                 ELSE length(dotted[1]) + 1 END AS cut FROM f0),
f AS (
  SELECT * EXCLUDE (tail, dotted, cut), left(name, length(name) - length(tail) + cut - 1) AS package, CASE WHEN cut IS NULL THEN name ELSE substr(tail, cut + 1) END AS short_name,
         (flags & 4) = 0 AND len(list_filter(string_split(name, '.')[2:], lambda p: starts_with(p, 'func') AND {_DIGITS.format(x="p[5:]")} OR starts_with(p, 'gowrap') AND {_DIGITS.format(x="p[7:]")})) > 0
           AS is_closure,
         shape IN (1, 2, 5) OR (shape = 4 AND (flags & 4) <> 0) AS is_method FROM f1)"""
_TIER = """CASE WHEN {p} = 'main' OR contains({p}, '.') THEN 'USER'
  WHEN starts_with({p}, 'runtime') OR starts_with({p}, 'internal/') OR starts_with({p}, 'vendor/') OR starts_with({p}, 'type:')
    OR {p} = '(unknown)' THEN 'INTERNAL' ELSE 'STDLIB' END"""


def _func(spark, sf_dir) -> DataFrame:
    return a.on(spark, sf_dir, a.FUNC)


@query(
    f"""WITH {F_SQL}, p AS (SELECT coalesce(package, '(unknown)') AS package, name FROM f), g AS (SELECT {_TIER.format(p="package")} AS tier, package, name FROM p)
        SELECT tier, package, count(*) AS n_funcs, array_to_string(list_sort(list(DISTINCT name)), ' ') AS functions FROM g GROUP BY 1, 2
        UNION ALL SELECT NULL, NULL, count(*), NULL FROM g"""
)
def q_package_listing(spark, sf_dir):
    return reports.package_listing(_func(spark, sf_dir)).withColumn("functions", F.array_join("functions", " "))


@query(f"WITH {F_SQL} SELECT name, count(*) AS n FROM f WHERE shape NOT IN (0, 6, 8) GROUP BY 1")
def q_user_code(spark, sf_dir):
    return reports.user_code(_func(spark, sf_dir)).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, count(*) FILTER (s_suppkey % 3 = 0) = 0 AS alone FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1")
def q_no_dependencies(spark, sf_dir):
    deps = _read(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.collect_list("s_name").alias("deps"))
    return _read(spark, sf_dir, "nation").join(deps, "n_nationkey", "left").select("n_nationkey", reports.has_no_dependencies(F.col("deps")).alias("alone"))


# Detection

_PREFIX = {0: "7F454C46", 1: "CFFAEDFE", 2: "FEEDFACF", 3: "4D5A", 4: "CEFAEDFE", 5: "FEEDFACE", 6: ""}


@query(
    """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'Elf' WHEN 3 THEN CASE WHEN strlen(text) >= 2 THEN 'Pe' ELSE 'Unknown' END
         WHEN 6 THEN CASE WHEN strlen(text) >= 4 AND starts_with(text, 'MZ') THEN 'Pe' ELSE 'Unknown' END ELSE 'MachO' END AS format
       FROM documents"""
)
def q_detect_format(spark, sf_dir):
    prefix = F.element_at(F.array(*[F.unhex(F.lit(p)) for p in _PREFIX.values()]), (F.col("doc_id") % 7 + 1).cast("int"))
    content = F.concat(prefix, F.col("text").cast("binary"))
    return _read(spark, sf_dir, "documents").select("doc_id", values.detect_format(content).alias("format"))


@query("SELECT doc_id, doc_id % 5 IN (0, 1, 2) AS is_go FROM documents")
def q_detect_fast(spark, sf_dir):
    heads = [b"x" + values.FAST_MARKS[0], b"yy" + values.FAST_MARKS[1], b"abcd\xf1\xff\xff\xff", b"abc\xf1\xff\xff\xff", b""]
    head = F.element_at(F.array(*[F.unhex(F.lit(h.hex())) for h in heads]), (F.col("doc_id") % 5 + 1).cast("int"))
    content = F.concat(head, F.col("text").cast("binary"))
    return _read(spark, sf_dir, "documents").select("doc_id", values.detect(content).alias("is_go"))


_HITS = " + ".join(f"CASE WHEN contains(text, '{n}') THEN 1 ELSE 0 END" for n in values.NEEDLES)


@query(f"SELECT id, CAST({_HITS} AS INT) AS hits, {_HITS} >= 3 AS is_go FROM ({a.plain(a.TEXT)})")
def q_heuristic_hits(spark, sf_dir):
    return a.on(spark, sf_dir, a.TEXT).select("id", values.heuristic_hits(F.col("text")).alias("hits"), values.heuristic_check(F.col("text")).alias("is_go"))


@query(
    """WITH p AS (SELECT doc_id, doc_id % 7 = 0 AS s1, doc_id % 11 = 0 AS s2, doc_id % 13 = 0 AS s3, doc_id % 17 = 0 AS bid, doc_id % 3 = 0 AS info,
                         doc_id % 6 = 0 AS iv, doc_id % 19 = 0 AS sv, doc_id % 23 = 0 AS tab, doc_id % 5 >= 3 AS hits FROM documents)
       SELECT doc_id, CASE WHEN s1 OR s2 OR s3 OR bid OR tab THEN 3 WHEN info OR iv OR sv THEN 2 WHEN hits THEN 1 ELSE 0 END AS tier,
              array_to_string(list_filter([
                CASE WHEN s1 THEN 'GopclntabSectionPresent' END, CASE WHEN s2 THEN 'BuildinfoSectionPresent' END, CASE WHEN s3 THEN 'BuildidNotePresent' END,
                CASE WHEN bid THEN 'BuildIdMarkerFound' END, CASE WHEN info THEN 'BuildinfoParsed' ELSE 'BuildinfoMissing' END,
                CASE WHEN tab THEN 'PclntabParsed' ELSE 'PclntabMissing' END, CASE WHEN iv OR sv THEN 'GoVersionString' END,
                CASE WHEN hits AND NOT (s1 OR s2 OR s3 OR bid OR tab OR info OR iv OR sv) THEN 'HeuristicStringsMatched' END
              ], lambda x: x IS NOT NULL), ',') AS signals FROM p"""
)
def q_report_tier(spark, sf_dir):
    d, null = F.col("doc_id"), F.lit(None).cast("string")
    parts = _read(spark, sf_dir, "documents").select(
        "doc_id", (d % 7 == 0).alias("has_gopclntab"), (d % 11 == 0).alias("has_go_buildinfo"), (d % 13 == 0).alias("has_note"),
        F.when(d % 17 == 0, "a/b").otherwise(null).alias("build_id"), (d % 3 == 0).alias("info_found"), F.when(d % 6 == 0, "go1.20").otherwise(null).alias("info_version"),
        F.when(d % 19 == 0, "go1.19").otherwise(null).alias("scanned_version"), F.when(d % 23 == 0, "Go120").otherwise(null).alias("table_version"),
        F.lit(5).cast("bigint").alias("nfunc"), (d % 5).cast("int").alias("heuristic_hits"),
    )
    return tables.report_of(parts).select("doc_id", "tier", F.array_join(F.transform("signals", lambda s: s["kind"]), ",").alias("signals"))


@query("SELECT p_partkey % 25 AS image, p_type AS slot, arg_max(p_size, p_partkey) AS size FROM part GROUP BY 1, 2")
def q_sections_last_wins(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select((F.col("p_partkey") % 25).alias("image"), F.col("p_type").alias("slot"), "p_size", "p_partkey")
    return intervals.last_per_slot(rows, ["image", "slot"], "p_size", "p_partkey", "size")


# Address ranges


@query(
    f"""WITH s AS ({a.plain(a.SEG)}), x AS ({a.plain(a.ADDR)})
        SELECT x.event_id, x.va, min_by(s.file_off + x.va - s.va, s.ord) AS file_off
        FROM x LEFT JOIN s ON s.image_id = x.image_id AND x.va >= s.va AND x.va < s.va + s.size GROUP BY 1, 2"""
)
def q_va_to_file(spark, sf_dir):
    found = intervals.va_to_file(a.on(spark, sf_dir, a.SEG), a.on(spark, sf_dir, a.ADDR))
    return found.select("event_id", "va", F.col("file_off").cast("bigint").alias("file_off"))


@query(
    f"""WITH s AS ({a.plain(a.SEG)}), x AS ({a.plain(a.OFFSET)})
        SELECT x.event_id, x.file_off, min_by(s.va + x.file_off - s.file_off, s.ord) AS va
        FROM x LEFT JOIN s ON s.image_id = x.image_id AND x.file_off >= s.file_off AND x.file_off < s.file_off + s.size GROUP BY 1, 2"""
)
def q_file_to_va(spark, sf_dir):
    found = intervals.file_to_va(a.on(spark, sf_dir, a.SEG), a.on(spark, sf_dir, a.OFFSET))
    return found.select("event_id", "file_off", F.col("va").cast("bigint").alias("va"))


@query(
    f"""WITH s AS ({a.plain(a.SEG)}), x AS ({a.plain(a.ADDR)})
        SELECT x.event_id, x.va FROM x WHERE x.va <> 0 AND NOT (x.va >= 50000 AND x.va < 60000) AND x.va % 5000 BETWEEN 2 AND 4096
          AND EXISTS (SELECT 1 FROM s WHERE s.image_id = x.image_id AND x.va >= s.va AND x.va < s.va + s.size)"""
)
def q_strings_filter(spark, sf_dir):
    va = F.col("va")
    kept = a.on(spark, sf_dir, a.ADDR).where((va != 0) & ~((va >= 50000) & (va < 60000)) & (va % 5000).between(2, 4096))
    return intervals.va_to_file(a.on(spark, sf_dir, a.SEG), kept).where("file_off is not null").select("event_id", "va")


@query("SELECT count(DISTINCT text) AS n_texts, count(*) AS n FROM conversations WHERE length(text) BETWEEN 2 AND 4096")
def q_strings_distinct(spark, sf_dir):
    kept = _read(spark, sf_dir, "conversations").where(F.char_length("text").between(2, 4096) & F.is_valid_utf8("text"))
    return kept.agg(F.countDistinct("text").alias("n_texts"), F.count(F.lit(1)).alias("n"))


# Names


@query(f"WITH {F_SQL} SELECT name, package, short_name, count(*) AS n FROM f GROUP BY ALL")
def q_pkg_short(spark, sf_dir):
    n = F.col("name")
    cols = [n, names.package(n).alias("package"), names.short_name(n).alias("short_name")]
    return _func(spark, sf_dir).select(*cols).groupBy("name", "package", "short_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {F_SQL}, m AS (SELECT name, flags, is_method,
          CASE WHEN is_method THEN CASE shape WHEN 1 THEN 'Client' || CAST(image_no % 7 AS STRING) WHEN 2 THEN 'Map' WHEN 5 THEN 'Time' ELSE 'main' END END AS recv,
          CASE WHEN is_method THEN shape IN (1, 2) END AS pointer, CASE WHEN shape = 2 THEN '[K, V]' END AS recv_generic,
          CASE WHEN is_method THEN CASE shape WHEN 1 THEN 'Do' WHEN 2 THEN 'Len' WHEN 5 THEN 'String' ELSE short_name[6:] END END AS method FROM f)
        SELECT *, count(*) AS n FROM m GROUP BY ALL"""
)
def q_method_receiver(spark, sf_dir):
    # Names repeat, so they are counted first and split once each.
    counted = _func(spark, sf_dir).groupBy("name", "flags").agg(F.count(F.lit(1)).alias("n"))
    r = F.col("receiver")
    return names.with_method(counted).select(
        "name", "flags", "is_method", r["name"].alias("recv"), r["pointer"].alias("pointer"), r["generic_args"].alias("recv_generic"), F.col("method_name").alias("method"), "n",
    )


@query(f"WITH {F_SQL} SELECT flags, is_closure, count(*) AS n FROM f GROUP BY ALL")
def q_closure(spark, sf_dir):
    return _func(spark, sf_dir).groupBy("flags", names.is_closure(F.col("name"), F.col("flags")).alias("is_closure")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH {F_SQL} SELECT name, flags, (flags & 1) <> 0 AS is_top_frame, (flags & 2) <> 0 AS is_sp_write, (flags & 4) <> 0 AS is_asm,
          starts_with(name, 'runtime.') AS is_runtime, shape IN (0, 6, 8) AS is_internal, shape IN (1, 4, 5, 7) AS is_stdlib,
          deferreturn <> 0 AS uses_defer, count(*) AS n FROM f GROUP BY ALL"""
)
def q_name_flags(spark, sf_dir):
    n, f = F.col("name"), F.col("flags")
    found = _func(spark, sf_dir).select(
        "name", "flags", names.is_top_frame(f).alias("is_top_frame"), names.is_sp_write(f).alias("is_sp_write"), names.is_asm(f).alias("is_asm"),
        names.is_runtime(n).alias("is_runtime"), names.is_internal(n).alias("is_internal"), names.is_stdlib(n).alias("is_stdlib"), (F.col("deferreturn") != 0).alias("uses_defer"),
    )
    return found.groupBy(found.columns).agg(F.count(F.lit(1)).alias("n"))


_IDS = " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.FUNC_IDS.items())


@query(f"WITH {F_SQL} SELECT func_id, CASE func_id WHEN 0 THEN NULL {_IDS} ELSE 'unknown_special' END AS label, func_id IN (98, 99) AS is_systemstack, count(*) AS n FROM f GROUP BY ALL")
def q_func_id(spark, sf_dir):
    i = F.col("func_id")
    return _func(spark, sf_dir).groupBy("func_id", names.func_id_name(i).alias("label"), names.is_systemstack(i).alias("is_systemstack")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '[int]' WHEN 1 THEN NULL WHEN 2 THEN '[K, map[V]W]' ELSE '[b]' END AS generic_args FROM part"""
)
def q_generic_args(spark, sf_dir):
    made = F.element_at(
        F.array(*[F.lit(x) for x in ("sort.Slice[int]", "sort.Plain", "pkg.(*Map[K, map[V]W]).Len", "pkg.T[a].F[b]")]), (F.col("p_partkey") % 4 + 1).cast("int")
    )
    return _read(spark, sf_dir, "part").select("p_partkey", names.generic_args(made).alias("generic_args"))


# Reports


@query(
    f"""WITH {F_SQL}, g AS (SELECT *, coalesce(package, '(unknown)') AS pkg FROM f)
        SELECT {_TIER.format(p="pkg")} AS tier, pkg AS package, count(*) AS n_funcs, count(*) FILTER (WHERE is_method) AS n_methods,
               count(*) FILTER (WHERE is_closure) AS n_closures, count(*) FILTER (WHERE deferreturn <> 0) AS n_defer FROM g GROUP BY 1, 2"""
)
def q_tier_report(spark, sf_dir):
    return reports.tier_report(_func(spark, sf_dir))


@query(
    f"""WITH {F_SQL}, g AS (SELECT *, {_TIER.format(p="coalesce(package, '')")} AS tier FROM f)
        SELECT count(*) AS n_funcs, count(*) FILTER (WHERE tier = 'USER') AS n_user, count(*) FILTER (WHERE tier = 'STDLIB') AS n_stdlib, count(*) FILTER (WHERE tier = 'INTERNAL') AS n_internal,
               count(*) FILTER (WHERE is_method) AS n_methods, count(*) FILTER (WHERE is_closure) AS n_closures, count(*) FILTER (WHERE deferreturn <> 0) AS n_defer,
               count(DISTINCT coalesce(package, '(unknown)')) AS n_packages FROM g"""
)
def q_summary(spark, sf_dir):
    return reports.summary(_func(spark, sf_dir))


_T_PKG = "regexp_extract(regexp_replace(regexp_replace(regexp_replace(regexp_replace(name, '^\\**', ''), '^\\[\\]\\**', ''), '^\\[[^\\]]*\\]\\**', ''), '^map\\[', ''), '^([A-Za-z0-9/_-]+)\\.', 1)"


@query(
    f"""WITH {F_SQL}, x AS (SELECT coalesce(package, '(unknown)') AS package, count(*) AS n FROM f GROUP BY 1),
        y AS (SELECT coalesce(nullif({_T_PKG}, ''), '(unknown)') AS package, count(*) AS n FROM ({a.plain(a.TYPE)}) GROUP BY 1)
        SELECT package, coalesce(x.n, 0) AS n_funcs, coalesce(y.n, 0) AS n_types FROM x FULL JOIN y USING (package)"""
)
def q_pkg_full_outer(spark, sf_dir):
    return reports.packages_of_both(_func(spark, sf_dir), a.on(spark, sf_dir, a.TYPE))


@query(
    f"""WITH {F_SQL} SELECT DISTINCT coalesce(nullif({_T_PKG}, ''), '(unknown)') AS package FROM ({a.plain(a.TYPE)})
        EXCEPT SELECT coalesce(package, '(unknown)') FROM f"""
)
def q_type_only_packages(spark, sf_dir):
    return reports.type_only_packages(_func(spark, sf_dir), a.on(spark, sf_dir, a.TYPE))


@query(
    f"""WITH {F_SQL}, p AS (SELECT DISTINCT package FROM f WHERE package IS NOT NULL),
        r AS (SELECT package, CASE {_TIER.format(p="package")} WHEN 'USER' THEN 0 WHEN 'STDLIB' THEN 1 ELSE 2 END AS k FROM p)
        SELECT package, coalesce(k <> lag(k) OVER (ORDER BY k, package), true) AS starts_tier FROM r"""
)
def q_tier_breaks(spark, sf_dir):
    found = _func(spark, sf_dir).select(names.package(F.col("name")).alias("package")).where("package is not null").distinct()
    return reports.tier_breaks(found)


@query(
    """SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END,
          CASE o_orderstatus WHEN 'F' THEN 'p.(*T).m' WHEN 'O' THEN 'p.f' ELSE 'p.f.func1' END || o_orderpriority[1], o_orderkey) AS INT) AS nth FROM orders"""
)
def q_func_sort_rank(spark, sf_dir):
    shape = F.when(F.col("o_orderstatus") == "F", "p.(*T).m").when(F.col("o_orderstatus") == "O", "p.f").otherwise("p.f.func1")
    code = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.concat(shape, F.substring("o_orderpriority", 1, 1)).alias("name"), F.lit(0).alias("flags"))
    return reports.function_order(code, ["o_custkey"], "o_orderkey").select("o_orderkey", "o_custkey", "nth")


@query(
    f"""WITH {F_SQL} SELECT flags, func_id, deferreturn, array_to_string(list_filter([CASE WHEN deferreturn <> 0 THEN 'defer' END, CASE WHEN (flags & 4) <> 0 THEN 'asm' END,
          CASE WHEN (flags & 1) <> 0 THEN 'top' END, CASE WHEN func_id IN (98, 99) THEN 'systemstack' END,
          CASE func_id WHEN 0 THEN NULL {_IDS} ELSE 'unknown_special' END], lambda x: x IS NOT NULL), ', ') AS tags, count(*) AS n FROM f GROUP BY ALL"""
)
def q_display_tags(spark, sf_dir):
    tags = reports.display_tags(F.col("flags"), F.col("deferreturn"), F.col("func_id")).alias("tags")
    return _func(spark, sf_dir).groupBy("flags", "func_id", "deferreturn", tags).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH s AS ({a.plain(a.SOURCE)}), t AS (SELECT path, CASE WHEN contains(path, '/libexec/src/') OR contains(path, '/go/src/') OR contains(path, 'GOROOT') THEN 'SDK' ELSE 'USER' END AS tier FROM s)
        SELECT tier, CASE WHEN tier = 'USER' THEN '' WHEN contains(path, '/src/') THEN regexp_replace(regexp_extract(path, '^.*/src/(.*)$', 1), '/[^/]*$', '') ELSE '(other)' END AS package,
               count(*) AS n_files FROM t GROUP BY 1, 2"""
)
def q_source_tiers(spark, sf_dir):
    return reports.source_report(a.on(spark, sf_dir, a.SOURCE))


# PC tables

_LIVE = f"""d AS ({a.plain(a.PCD)}), s AS (SELECT *, min(CASE WHEN pc_delta = 0 THEN event_id END) OVER (PARTITION BY user_id) AS stop FROM d),
  l AS (SELECT * FROM s WHERE stop IS NULL OR event_id < stop),
  r AS (SELECT user_id, event_id, CAST(-1 + sum(vdelta) OVER w AS BIGINT) AS value, CAST(sum(pc_delta) OVER w AS BIGINT) AS pc_end FROM l
        WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))"""


def _values(spark, sf_dir) -> DataFrame:
    live = intervals.until_terminator(a.on(spark, sf_dir, a.PCD), ["user_id"], "event_id", "pc_delta")
    return intervals.running_values(live, ["user_id"], "event_id", "vdelta", "pc_delta")


@query(f"WITH {_LIVE} SELECT * FROM r")
def q_pcvalue_running(spark, sf_dir):
    return _values(spark, sf_dir).select("user_id", "event_id", "value", "pc_end")


@query(f"WITH {_LIVE} SELECT user_id, count(*) AS n FROM l GROUP BY 1")
def q_pcvalue_terminated(spark, sf_dir):
    return intervals.until_terminator(a.on(spark, sf_dir, a.PCD), ["user_id"], "event_id", "pc_delta").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LIVE} SELECT user_id, event_id, lag(pc_end, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS pc_start, pc_end, value FROM r WHERE true")
def q_pc_ranges(spark, sf_dir):
    return _values(spark, sf_dir).select("user_id", "event_id", "pc_start", "pc_end", "value")


@query(f"WITH {_LIVE} SELECT user_id, coalesce(min(value), 0) AS min_line, coalesce(max(value), 0) AS max_line FROM r GROUP BY 1")
def q_line_range(spark, sf_dir):
    return _values(spark, sf_dir).groupBy("user_id").agg(F.coalesce(F.min("value"), F.lit(0)).alias("min_line"), F.coalesce(F.max("value"), F.lit(0)).alias("max_line"))


@query(f"WITH {_LIVE} SELECT e.user_id, coalesce(max(r.value), 0) AS frame FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN r USING (user_id) GROUP BY 1")
def q_frame_max(spark, sf_dir):
    users = _read(spark, sf_dir, "events").select("user_id").distinct()
    return users.join(_values(spark, sf_dir), "user_id", "left").groupBy("user_id").agg(F.coalesce(F.max("value"), F.lit(0)).alias("frame"))


@query(
    f"""WITH {_LIVE}, p AS (SELECT event_id, user_id, event_id * 31 % 300 AS pc FROM events)
        SELECT p.event_id, p.pc, coalesce(arg_min(r.value, r.pc_end), -1) AS value FROM p LEFT JOIN r ON r.user_id = p.user_id AND r.pc_end > p.pc GROUP BY 1, 2"""
)
def q_inline_active(spark, sf_dir):
    probes = _read(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") * 31 % 300).alias("pc"))
    return intervals.active_at(_values(spark, sf_dir), probes, ["user_id"]).select("event_id", "pc", "value")


_UP = f"""RECURSIVE t AS ({a.plain(a.TREE)}), u(id, above, depth) AS (SELECT id, parent, 0 FROM t UNION ALL SELECT u.id, t.parent, u.depth + 1 FROM u JOIN t ON t.id = u.above WHERE u.depth < 32),
  d AS (SELECT id, max(depth) AS depth FROM u GROUP BY id)"""


@query(f"WITH {_UP} SELECT id, depth FROM d")
def q_inline_depth(spark, sf_dir):
    return intervals.depths(a.on(spark, sf_dir, a.TREE))


@query(f"WITH {_UP} SELECT depth, count(*) AS n FROM d GROUP BY 1")
def q_depth_hist(spark, sf_dir):
    return intervals.depths(a.on(spark, sf_dir, a.TREE)).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


_RUNS = f"""r AS ({a.plain(a.RUNS)}), b AS (SELECT *, CASE WHEN v > lag(v) OVER (ORDER BY event_id) THEN 0 ELSE 1 END AS b FROM r),
  n AS (SELECT *, sum(b) OVER (ORDER BY event_id) AS run FROM b)"""


@query(f"WITH {_RUNS} SELECT CAST(run AS BIGINT) AS run, min(event_id) AS first, count(*) AS length FROM n GROUP BY 1")
def q_monotone_runs(spark, sf_dir):
    return intervals.monotone_runs(a.on(spark, sf_dir, a.RUNS), [], "event_id", "v")


@query(f"WITH {_RUNS} SELECT min(first) AS first FROM (SELECT min(event_id) AS first, count(*) AS n FROM n GROUP BY run) WHERE n >= 2")
def q_first_long_run(spark, sf_dir):
    return intervals.monotone_runs(a.on(spark, sf_dir, a.RUNS), [], "event_id", "v").where("length >= 2").agg(F.min("first").alias("first"))


# Lookups


@query("SELECT o_orderkey, coalesce(c_name, '<unknown>') AS name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON c_custkey = o_custkey")
def q_name_lookup_default(spark, sf_dir):
    known = _read(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return _read(spark, sf_dir, "orders").join(known, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.lit("<unknown>")).alias("name"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, s_name AS path, count(*) AS n FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 4 <> 0) ON p_partkey = l_partkey
       LEFT JOIN supplier ON s_suppkey = p_partkey % 100 GROUP BY ALL"""
)
def q_pcfile_two_hop(spark, sf_dir):
    units = _read(spark, sf_dir, "part").where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") % 100).alias("s_suppkey"))
    files = _read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("path"))
    found = _read(spark, sf_dir, "lineitem").join(units, "l_partkey", "left").join(files, "s_suppkey", "left")
    return found.groupBy("l_orderkey", "l_linenumber", "l_partkey", "path").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_name AS path, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = p_partkey % 200 GROUP BY 1")
def q_pcfile_inner(spark, sf_dir):
    units = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") % 200).alias("s_suppkey"))
    files = _read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("path"))
    return _read(spark, sf_dir, "lineitem").join(units, "l_partkey").join(files, "s_suppkey").groupBy("path").agg(F.count(F.lit(1)).alias("n"))


# Build information


def _mod_lines(spark, sf_dir) -> DataFrame:
    cells = F.split("line", "\t", 4)
    return a.on(spark, sf_dir, a.MOD).select(F.col("user_id").alias("image_id"), "ln", *[F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(("tag", "f1", "f2", "f3"))])


@query(
    f"""WITH m AS ({a.plain(a.MOD)}), t AS (SELECT *, max(CASE WHEN tag = 'dep' THEN ln END) OVER (PARTITION BY user_id ORDER BY ln ROWS UNBOUNDED PRECEDING) AS dep_ln
          FROM m WHERE tag IN ('dep', '=>')),
        d AS (SELECT user_id, dep_ln, max(CASE WHEN tag = '=>' THEN ln END) AS repl FROM t WHERE dep_ln IS NOT NULL GROUP BY 1, 2)
        SELECT user_id AS image_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY dep_ln) - 1 AS INT) AS ord, CAST(dep_ln % 13 AS STRING) AS path,
               'v1.' || CAST(dep_ln AS STRING) || '.0' AS version, 'h1:x=' AS sum, './r' || CAST(repl AS STRING) AS repl_path FROM d"""
)
def q_modinfo_deps(spark, sf_dir):
    return tables.dependencies(_mod_lines(spark, sf_dir)).select("image_id", "ord", "path", "version", "sum", F.col("repl.path").alias("repl_path"))


@query(
    f"""SELECT user_id AS image_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ln) - 1 AS INT) AS ord, 'k' || CAST(ln % 5 AS STRING) AS key, 'v=' || CAST(ln AS STRING) AS value
        FROM ({a.plain(a.MOD)}) WHERE tag = 'build'"""
)
def q_modinfo_settings(spark, sf_dir):
    return tables.build_settings(_mod_lines(spark, sf_dir))


@query(f"SELECT user_id AS image_id, 'k' || CAST(ln % 5 AS STRING) AS key, arg_min('v=' || CAST(ln AS STRING), ln) AS value FROM ({a.plain(a.MOD)}) WHERE tag = 'build' GROUP BY 1, 2")
def q_setting_first(spark, sf_dir):
    return intervals.first_per_key(tables.build_settings(_mod_lines(spark, sf_dir)), ["image_id", "key"], "value", "ord", "value")


@query(f"SELECT user_id AS image_id, arg_max('p' || CAST(ln AS STRING), ln) AS main_path FROM ({a.plain(a.MOD)}) WHERE tag = 'path' GROUP BY 1")
def q_modinfo_main(spark, sf_dir):
    return intervals.last_per_slot(_mod_lines(spark, sf_dir).where("tag = 'path'"), ["image_id"], "f1", "ln", "main_path")


def _settings(key: str, value: str):
    return F.array(F.struct(F.lit(key).alias("key"), F.expr(value).alias("value")))


@query(
    """SELECT p_partkey, unnest(list_filter(string_split(CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'netgo' WHEN 2 THEN 'a,,b,' || p_brand ELSE 'x,y' END, ','), lambda t: t <> '')) AS tag FROM part"""
)
def q_build_tags(spark, sf_dir):
    made = "CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'netgo' WHEN 2 THEN concat('a,,b,', p_brand) ELSE 'x,y' END"
    return _read(spark, sf_dir, "part").select("p_partkey", F.explode(values.build_tags(_settings("-tags", made))).alias("tag"))


@query(
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Exe' WHEN 1 THEN 'Pie' WHEN 2 THEN 'CShared' WHEN 3 THEN 'Exe' WHEN 4 THEN 'Other:odd' ELSE NULL END AS mode FROM part"""
)
def q_build_mode(spark, sf_dir):
    made = "CASE p_partkey % 6 WHEN 0 THEN 'exe' WHEN 1 THEN 'pie' WHEN 2 THEN 'c-shared' WHEN 4 THEN 'odd' ELSE '' END"
    some = F.when(F.col("p_partkey") % 6 == 5, F.array().cast("array<struct<key:string,value:string>>")).otherwise(_settings("-buildmode", made))
    return _read(spark, sf_dir, "part").select("p_partkey", values.build_mode_of(some).alias("mode"))


@query(f"SELECT o_orderkey, CAST(nullif(regexp_extract(version, '^go1\\.([0-9]+)(?:\\.|\\z)', 1), '') AS INT) AS minor FROM ({a.plain(a.VERSION)})")
def q_version_minor(spark, sf_dir):
    return a.on(spark, sf_dir, a.VERSION).select("o_orderkey", values.minor_version(F.col("version")).alias("minor"))


@query(f"SELECT o_orderkey, nullif(regexp_extract(version, '-([0-9A-Fa-f]{{7,}})', 1), '') AS revision FROM ({a.plain(a.VERSION)})")
def q_runtime_commit(spark, sf_dir):
    return a.on(spark, sf_dir, a.VERSION).select("o_orderkey", values.runtime_commit(F.col("version")).alias("revision"))


@query(
    f"""SELECT o_orderkey, CASE named WHEN 'gc' THEN 'Gc' WHEN 'gccgo' THEN 'Gccgo' WHEN 'tinygo' THEN 'TinyGo' ELSE
          CASE WHEN contains(lower(version), 'tinygo') THEN 'TinyGo' WHEN has_table THEN 'Gc' ELSE 'Unknown' END END AS compiler FROM ({a.plain(a.VERSION)})"""
)
def q_compiler(spark, sf_dir):
    return a.on(spark, sf_dir, a.VERSION).select("o_orderkey", values.compiler(F.col("named"), F.col("version"), F.col("has_table")).alias("compiler"))


# Verdicts


@query(
    f"""WITH g AS (SELECT DISTINCT image_no, scrubbed, split_part(name, '.', 1) AS pkg FROM ({a.plain(a.GARBLE)})),
        c AS (SELECT image_no, any_value(scrubbed) AS scrubbed, count(*) AS total, count(*) FILTER (WHERE starts_with(pkg, 'ab12cd')) AS obfuscated FROM g GROUP BY 1)
        SELECT image_no, total, obfuscated, CASE WHEN obfuscated * 2 >= total AND scrubbed THEN 3 WHEN obfuscated * 2 >= total THEN 2 WHEN obfuscated * 5 >= total THEN 1 ELSE 0 END AS obf_tier FROM c"""
)
def q_garble(spark, sf_dir):
    found = tables.garble_verdict(a.on(spark, sf_dir, a.GARBLE), F.col("image_no"), F.col("scrubbed"))
    return found.select("image_no", "total", "obfuscated", values.obfuscation_tier(F.col("obfuscated"), F.col("total"), F.col("scrubbed")).alias("obf_tier"))


@query(f"WITH {F_SQL} SELECT image_no, bool_or(name = 'runtime.cgocall') AS has_cgo FROM f GROUP BY 1")
def q_cgo(spark, sf_dir):
    return _func(spark, sf_dir).groupBy("image_no").agg(F.bool_or(names.is_cgo(F.col("name"))).alias("has_cgo"))


@query(f"WITH {F_SQL} SELECT image_no, bool_or(name = 'runtime.newproc') AS concurrent FROM f GROUP BY 1")
def q_concurrency(spark, sf_dir):
    return _func(spark, sf_dir).groupBy("image_no").agg(F.bool_or(names.is_concurrency(F.col("name"))).alias("concurrent"))


# Types

_KINDS = "[" + ", ".join(f"'{k}'" for k in values.KINDS) + "]"


@query(f"SELECT type_va, {_KINDS}[kind_code + 1] AS kind, size, CASE WHEN kind_code IN (17, 18, 22, 23) THEN elem_va END AS elem_va FROM ({a.plain(a.TYPE)})")
def q_type_detail(spark, sf_dir):
    k = F.col("kind_code")
    return a.on(spark, sf_dir, a.TYPE).select("type_va", values.kind_name(k).alias("kind"), "size", F.when(k.isin(17, 18, 22, 23), F.col("elem_va")).alias("elem_va"))


@query(f"WITH t AS ({a.plain(a.TYPE)}) SELECT x.name AS from_name, y.name AS to_name FROM t x JOIN t y ON y.type_va = x.elem_va WHERE x.kind_code IN (17, 18, 22, 23)")
def q_type_edges(spark, sf_dir):
    t = a.on(spark, sf_dir, a.TYPE)
    target = t.select(F.col("type_va").alias("elem_va"), F.col("name").alias("to_name"))
    return t.where(F.col("kind_code").isin(17, 18, 22, 23)).join(target, "elem_va").select(F.col("name").alias("from_name"), "to_name")


@query(
    f"""SELECT type_va, nullif({_T_PKG}, '') AS package, regexp_matches(name, '^\\*?[A-Z]') AS is_exported,
          list_extract(string_split(regexp_replace(name, '^\\**', ''), '.'), -1) AS base_name FROM ({a.plain(a.TYPE)})"""
)
def q_type_package(spark, sf_dir):
    n = F.col("name")
    return a.on(spark, sf_dir, a.TYPE).select("type_va", names.type_package(n).alias("package"), names.type_is_exported(n).alias("is_exported"), names.type_base_name(n).alias("base_name"))


@query(
    """SELECT n_nationkey AS type_va, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY s_suppkey) - 1 AS INT) AS ord, s_name AS name, s_suppkey % 2 = 0 AS is_embedded
       FROM nation JOIN supplier ON s_nationkey = n_nationkey"""
)
def q_struct_fields(spark, sf_dir):
    field = F.struct(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.lit(None).cast("decimal(20,0)").alias("type_va"), F.lit(None).cast("decimal(20,0)").alias("offset"), (F.col("s_suppkey") % 2 == 0).alias("is_embedded"))
    made = _read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("type_va")).agg(F.array_sort(F.collect_list(field)).alias("fields"))
    out = tables.struct_fields(made.withColumn("image_id", F.lit("x")))
    return out.select(F.col("owner_va").alias("type_va"), "ord", "name", "is_embedded")


@query(
    """SELECT c_nationkey AS type_va, c_name AS name, c_custkey % 3 = 0 OR regexp_matches(c_name, '^[A-Z]') AS is_exported FROM customer"""
)
def q_type_methods(spark, sf_dir):
    shown = (F.col("c_custkey") % 3 == 0) | F.col("c_name").rlike("^[A-Z]")
    method = F.struct(F.col("c_custkey").alias("type_off"), F.col("c_name").alias("name"), shown.alias("is_exported"))
    made = _read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("type_va")).agg(F.array_sort(F.collect_list(method)).alias("methods"))
    return tables.type_methods(made.withColumn("image_id", F.lit("x"))).select("type_va", "name", "is_exported")


@query(
    f"""WITH i AS ({a.plain(a.ITAB)}), t AS ({a.plain(a.TYPE)}) SELECT i.itab_va, x.name AS iface_name, y.name AS concrete_name
        FROM i LEFT JOIN t x ON x.type_va = i.iface_type_va LEFT JOIN t y ON y.type_va = i.concrete_type_va"""
)
def q_itab_impl(spark, sf_dir):
    pairs, found = (a.on(spark, sf_dir, s).withColumn("image_id", F.lit("x")) for s in (a.ITAB, a.TYPE))
    return tables.implementations(pairs, found).select("itab_va", "iface_name", "concrete_name")


# Arithmetic


@query("SELECT event_id, CASE WHEN event_id % 2 = 1 THEN -(event_id // 2) - 1 ELSE event_id // 2 END AS value FROM events")
def q_zigzag(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", values.zigzag(F.col("event_id")).alias("value"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE ((event_id + event_id % 4 * 4 - 1) // (event_id % 4 * 4)) * (event_id % 4 * 4) END AS aligned FROM events")
def q_align_up(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", values.align_up(F.col("event_id"), F.col("event_id") % 4 * 4).alias("aligned"))


@query("SELECT l_orderkey, l_partkey, CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE l_orderkey * 1000 + l_partkey END AS value, count(*) AS n FROM lineitem GROUP BY ALL")
def q_uvarint(spark, sf_dir):
    n = F.col("l_orderkey") * 1000 + F.col("l_partkey")
    count = F.greatest(F.lit(1), F.ceil(F.char_length(F.bin(n)) / 7)).cast("int")
    octets = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.floor(n / F.pow(F.lit(128.0), i)).cast("bigint") % 128 + F.when((i < count - 1) | (F.col("l_partkey") % 10 == 0), 128).otherwise(0))
    made = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", values.uvarint(octets).alias("value"))
    return made.groupBy("l_orderkey", "l_partkey", "value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, ((event_id * 1234567 + 2147483648) % 4294967296) - 2147483648 AS wrapped, '0x' || lower(to_hex(event_id)) AS hexed, event_id / 1048576.0::DOUBLE AS mb FROM events")
def q_wrap32(spark, sf_dir):
    e = F.col("event_id")
    return _read(spark, sf_dir, "events").select("event_id", values.wrap32(e * 1234567).alias("wrapped"), values.hex_va(e).alias("hexed"), values.size_mb(e).alias("mb"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_partkey % 2 = 0 THEN 'X86' WHEN p_size % 3 = 0 THEN 'X86_64' WHEN p_size % 3 = 2 AND p_partkey % 2 = 0 THEN 'Arm'
         WHEN p_size % 3 = 2 THEN 'Arm64' WHEN p_partkey % 2 = 1 THEN 'S390x' ELSE 'Unknown' END AS arch,
       CASE p_partkey % 4 WHEN 0 THEN 'Go 1.2 - 1.15' WHEN 1 THEN 'Go 1.16 - 1.17' WHEN 2 THEN 'Go 1.18 - 1.19' ELSE 'Go 1.20+' END AS versions FROM part"""
)
def q_arch_versions(spark, sf_dir):
    lc = F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4)), (F.col("p_size") % 3 + 1).cast("int"))
    version = F.element_at(F.array(*[F.lit(v) for v in ("Go12", "Go116", "Go118", "Go120")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return _read(spark, sf_dir, "part").select("p_partkey", values.arch(lc, F.when(F.col("p_partkey") % 2 == 0, 4).otherwise(8)).alias("arch"), values.version_range(version).alias("versions"))


# Round trips: rows of a nation are written as images, which are read again

#: Keys that an image spans at most: a nation's rows grow with the table, its images in number only.
IMAGE_KEYS = 4096


def _image_of(rows, make):
    """Images of the rows of each nation, one for each span of supplier keys."""
    import pyarrow as pa

    def one(key, group):
        content = make(group.to_pylist())
        return pa.table({"path": [str(key[0].as_py())], "length": pa.array([len(content)], pa.int64()), "content": pa.array([content], pa.binary())})

    span = F.floor(F.col("s_suppkey") / IMAGE_KEYS) if "s_suppkey" in rows.columns else F.lit(0)
    return rows.groupBy("nation", span.alias("span")).applyInArrow(one, "path string, length long, content binary")


@query(
    """SELECT concat('main.f', s_suppkey) AS name, s_suppkey * 64 AS entry_offset, CAST(s_suppkey % 500 AS INT) AS start_line, CAST(s_suppkey % 500 + 3 AS INT) AS end_line,
              CAST(s_suppkey % 101 AS INT) AS func_id, concat('/src/n', s_nationkey, '.go') AS source_file FROM supplier"""
)
def q_roundtrip_functions(spark, sf_dir):
    from golode.sources import imagegen

    def make(rows):
        rows = sorted(rows, key=lambda r: r["s_suppkey"])
        path = f"/src/n{rows[0]['nation']}.go"
        funcs = [
            {"name": f"main.f{k}", "entry": k * 64, "start_line": k % 500, "lines": [(8, k % 500), (32, k % 500 + 3), (64, k % 500 + 1)], "file": path, "func_id": k % 101}
            for k in (r["s_suppkey"] for r in rows)
        ]
        return imagegen.image(funcs, [path])

    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))
    return tables.functions(_image_of(rows, make), with_derived=False).select("name", "entry_offset", "start_line", "end_line", "func_id", "source_file")


def _whole(form, magic=0xFFFFFFF1, version="go1.22.1"):
    """Images of a nation: a function and a named type for each supplier, an interface that the first
    type of the nation implements, calls of the first function inlined into each other. Rows name the
    first of the nation where that matters; else the first of an image stands for it."""
    from golode.sources import imagegen

    def make(rows):
        rows = sorted(rows, key=lambda r: r["s_suppkey"])
        keys, path = [r["s_suppkey"] for r in rows], f"/src/n{rows[0]['nation']}.go"
        first = rows[0].get("first", keys[0])
        calls = {"inline_index": [(8, 0), (24, 1)], "inline_calls": [{"name": f"main.a{first}", "parent_pc": 30, "line": 3}, {"name": f"main.b{first}", "parent_pc": 4, "line": 5}]}
        funcs = [
            {"name": f"main.f{k}", "entry": k * 64, "start_line": k % 500, "lines": [(8, k % 500), (64, k % 500 + 1)], "file": path, **(calls if k == first and magic == 0xFFFFFFF1 else {})}
            for k in keys
        ]
        types = [{"name": f"main.T{k}", "kind": 2, "size": k % 64, "methods": [f"Do{k}"]} for k in keys] + [{"name": "main.I", "kind": 20, "size": 16}]
        return imagegen.image(funcs, [path], version, f"path\tx/n{rows[0]['nation']}\n", f"id/{rows[0]['nation']}", [f"text of {k}" for k in keys], types, [(len(types) - 1, 0)] if keys[0] == first else [], magic, True, form)

    return make


def _suppliers(spark, sf_dir):
    return _read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"))


def _with_first(rows):
    """first: the smallest key of the nation."""
    firsts = rows.groupBy(F.col("nation").alias("of")).agg(F.min("s_suppkey").alias("first"))
    return rows.join(F.broadcast(firsts), F.col("nation").eqNullSafe(F.col("of"))).drop("of")


_WHOLE_SQL = """SELECT CAST(s_nationkey AS STRING) AS nation, concat('main.f', s_suppkey) AS name, s_suppkey * 64 AS entry_offset, concat('/src/n', s_nationkey, '.go') AS source_file,
         concat('main.T', s_suppkey) AS type_name, s_suppkey % 64 AS size, 1 AS methods, 1 AS n_texts FROM supplier"""


def _whole_rows(found):
    """Functions, types with their methods, and strings of images, side by side by supplier."""
    parts = tables._image_parts(found).select("image_id", F.col("path").alias("nation"))
    key = lambda c, mark: F.regexp_extract(c, f"^{mark}([0-9]+)$", 1)
    code = tables.functions(found, with_derived=False).select("image_id", key("name", "main[.]f").alias("k"), "name", "entry_offset", "source_file")
    kinds = tables.types(found).select("image_id", key("name", "main[.]T").alias("k"), F.col("name").alias("type_name"), F.col("size").cast("bigint").alias("size"), F.size("methods").alias("methods"))
    texts = tables.go_strings(found).groupBy("image_id", key("text", "text of ").alias("k")).agg(F.countDistinct("text").alias("n_texts"))
    whole = code.join(kinds, ["image_id", "k"]).join(texts, ["image_id", "k"]).join(parts, "image_id")
    return whole.select("nation", "name", "entry_offset", "source_file", "type_name", "size", "methods", "n_texts")


@query(_WHOLE_SQL)
def q_roundtrip_macho(spark, sf_dir):
    return _whole_rows(_image_of(_suppliers(spark, sf_dir), _whole("macho")))


@query(_WHOLE_SQL)
def q_roundtrip_pe(spark, sf_dir):
    return _whole_rows(_image_of(_suppliers(spark, sf_dir), _whole("pe", version="go1.25.0")))


@query(_WHOLE_SQL)
def q_roundtrip_older(spark, sf_dir):
    """The module record of releases before 1.20."""
    return _whole_rows(_image_of(_suppliers(spark, sf_dir), _whole("elf", 0xFFFFFFF0, "go1.19.3")))


@query(
    """WITH n AS (SELECT min(s_suppkey) AS k FROM supplier GROUP BY s_nationkey)
       SELECT concat('main.a', k) AS function_name, 0 AS pc_start, 8 AS pc_end, 30 AS parent_pc, 3 AS start_line FROM n
       UNION ALL SELECT concat('main.b', k), 8, 24, 4, 5 FROM n"""
)
def q_roundtrip_inline(spark, sf_dir):
    found = tables.inline_entries(_image_of(_with_first(_suppliers(spark, sf_dir)), _whole("macho")))
    return found.select("function_name", *[F.col(c).cast("int").alias(c) for c in ("pc_start", "pc_end", "parent_pc", "start_line")])


@query("SELECT 'main.I' AS iface_name, concat('main.T', min(s_suppkey)) AS concrete_name FROM supplier GROUP BY s_nationkey")
def q_roundtrip_itabs(spark, sf_dir):
    found = _image_of(_with_first(_suppliers(spark, sf_dir)), _whole("macho"))
    return tables.implementations(tables.itabs(found), tables.types(found)).select("iface_name", "concrete_name")


@query("SELECT DISTINCT concat('/src/n', s_nationkey, '.go') AS path, 0 AS ord FROM supplier")
def q_source_files(spark, sf_dir):
    return tables.source_files(_image_of(_suppliers(spark, sf_dir), _whole("pe"))).select("path", F.col("ord").cast("int").alias("ord")).distinct()


@query(
    """SELECT f.format, concat('id/', n.nation) AS build_id, 3 AS tier, 'go1.22.1' AS go_version FROM (SELECT DISTINCT s_nationkey AS nation FROM supplier) n,
       (SELECT unnest(['Elf', 'MachO', 'Pe']) AS format) f"""
)
def q_build_id(spark, sf_dir):
    rows = _suppliers(spark, sf_dir)
    found = [tables.images(_image_of(rows, _whole(form))) for form in ("elf", "macho", "pe")]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("format", "build_id", F.col("tier").cast("int").alias("tier"), "go_version").distinct()


@query("SELECT CAST(s_nationkey AS STRING) AS nation, concat('mod/', s_name) AS path, concat('v', s_suppkey) AS version FROM supplier")
def q_roundtrip_buildinfo(spark, sf_dir):
    from golode.sources import imagegen

    make = lambda rows: imagegen.image(modinfo=f"path\t{rows[0]['nation']}\n" + "".join(f"dep\tmod/{r['s_name']}\tv{r['s_suppkey']}\th1:=\n" for r in rows))
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("nation"))
    parts = tables._image_parts(_image_of(rows, make))
    deps = tables.dependencies(tables.mod_lines(parts)).join(parts.select("image_id", F.col("path").alias("nation")), "image_id")
    return deps.select("nation", "path", "version")


@query(
    """SELECT concat('*n', n_nationkey, '.', n_name) AS name, 'pointer' AS kind, 8 AS size, concat('n', n_nationkey, '.', n_name) AS elem FROM nation"""
)
def q_roundtrip_types(spark, sf_dir):
    from golode.sources import imagegen

    def make(rows):
        name = f"n{rows[0]['nation']}.{rows[0]['n_name']}"
        return imagegen.image(types=[{"name": f"*{name}", "kind": 22, "size": 8, "elem": 1}, {"name": name, "kind": 2, "size": 16}])

    found = tables.types(_image_of(_read(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias("nation")), make))
    target = found.select("image_id", F.col("type_va").alias("elem_va"), F.col("name").alias("elem"))
    return found.where("kind = 'pointer'").join(target, ["image_id", "elem_va"]).select("name", "kind", F.col("size").cast("int").alias("size"), "elem")


@query("SELECT DISTINCT concat('text of ', s_name) AS text FROM supplier")
def q_roundtrip_strings(spark, sf_dir):
    from golode.sources import imagegen

    make = lambda rows: imagegen.image(strings=sorted(f"text of {r['s_name']}" for r in rows))
    rows = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("nation"))
    return tables.go_strings(_image_of(rows, make)).where("text like 'text of %'").select("text").distinct()


# Additions: categories of query that go beyond single images


@query("SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT s_suppkey FROM supplier WHERE s_nationkey % 2 = 0")
def q_set_ops(spark, sf_dir):
    li, s = _read(spark, sf_dir, "lineitem"), _read(spark, sf_dir, "supplier")
    flag = lambda f: li.where(F.col("l_returnflag") == f).select(F.col("l_suppkey").alias("k"))
    return flag("R").intersect(flag("A")).subtract(s.where("s_nationkey % 2 = 0").select("s_suppkey"))


@query(f"WITH {F_SQL}, g AS (SELECT coalesce(package, '(unknown)') AS pkg FROM f), t AS (SELECT pkg, {_TIER.format(p='pkg')} AS tier FROM g) SELECT tier, pkg AS package, count(*) AS n FROM t GROUP BY ROLLUP (tier, pkg)")
def q_rollup(spark, sf_dir):
    pkg = reports.package_or_unknown(F.col("name"))
    found = _func(spark, sf_dir).select(pkg.alias("package")).withColumn("tier", names.tier(F.col("package")))
    return found.rollup("tier", "package").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {F_SQL} SELECT image_no, name, n FROM (SELECT image_no, name, count(*) AS n FROM f GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY image_no ORDER BY n DESC, name) <= 3")
def q_topk(spark, sf_dir):
    counts = _func(spark, sf_dir).groupBy("image_no", "name").agg(F.count(F.lit(1)).alias("n"))
    nth = F.row_number().over(Window.partitionBy("image_no").orderBy(F.desc("n"), "name"))
    return counts.withColumn("nth", nth).where("nth <= 3").drop("nth")


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q_event_windows(spark, sf_dir):
    from golode.streaming.ingest import event_windows

    found = event_windows(_read(spark, sf_dir, "events"))
    return found.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
