"""Tables of a small corpus of images, in batch and as a stream."""

import pytest

from golode.operators import reports, tables
from golode.streaming import ingest
from golode.sources import imagegen
from tests.test_kernels import FUNCS, TYPES

TEXT = "path\tx/y\nmod\tx/y\t(devel)\ndep\ta/b\tv1\th1:x\n=>\tc/d\tv2\n=>\t./v\ndep\te/f\tv0\nbuild\t-compiler=gc\nbuild\tGOOS=linux\nbuild\t-tags=a,,b\nbuild\tbare\n"


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    at = tmp_path_factory.mktemp("corpus")
    (at / "one").write_bytes(imagegen.image(FUNCS, ["/a.go", "/b.go"], "go1.22.1", TEXT, "ab/cd", ["hello"], TYPES, [(0, 1)]))
    extra = [*FUNCS, dict(FUNCS[0], name="runtime.cgocall", entry=9000), dict(FUNCS[0], name="ab12cd34.x", entry=9064), dict(FUNCS[0], name="zz99yy88.x", entry=9128)]
    (at / "two").write_bytes(imagegen.image(extra, ["/a.go", "/b.go"], "go1.25"))
    (at / "none").write_bytes(b"no image at all")
    return str(at)


def test_images(spark, corpus):
    got = {r["path"].rsplit("/", 1)[1]: r for r in tables.images(tables.read_images(spark, corpus)).collect()}
    assert set(got) == {"one", "two"}
    one, two = got["one"], got["two"]
    assert (one["tier"], one["go_version"], one["build_id"], one["compiler"], one["buildmode"], one["goos"]) == (3, "go1.22.1", "ab/cd", "Gc", "Exe", "linux")
    assert one["build_tags"] == ["a", "b"] and one["obf_tier"] == 0 and not one["has_cgo"]
    assert two["has_cgo"] and two["obf_kind"] == "Garble" and two["obf_tier"] == 3
    assert [s["kind"] for s in one["signals"]][:3] == ["GopclntabSectionPresent", "BuildinfoSectionPresent", "BuildidNotePresent"]
    assert tables.prefiltered(tables.read_images(spark, corpus)).count() == 2


def test_build_tables(spark, corpus):
    parts = tables._image_parts(tables.read_images(spark, corpus, "one"))
    deps = [tuple(r) for r in tables.dependencies(tables.mod_lines(parts)).select("path", "version", "repl.path").orderBy("ord").collect()]
    assert deps == [("a/b", "v1", "./v"), ("e/f", "v0", None)]
    settings = [tuple(r) for r in tables.build_settings(tables.mod_lines(parts)).orderBy("ord").select("key", "value").collect()]
    assert settings == [("-compiler", "gc"), ("GOOS", "linux"), ("-tags", "a,,b"), ("bare", "")]
    assert tables.build_info(parts).first()["main_version"] == "(devel)"


def test_row_tables(spark, corpus):
    images = tables.read_images(spark, corpus, "one")
    assert tables.functions(images).count() == 5
    values = tables.pc_values(images).where("`table` = 'pcln' and func_off = (select 48)").orderBy("ord").collect()
    assert [(v["pc_start"], v["pc_end"]) for v in values] == [(0, 8), (8, 40), (40, 64)]
    assert tables.inline_entries(images).count() == 2
    types = tables.types(images)
    assert types.count() == 3 and tables.struct_fields(types).count() == 2 and tables.type_methods(types).count() == 2
    assert tables.type_edges(types).count() == 3
    assert tables.implementations(tables.itabs(images), types).first()["concrete_name"] == "main.T"
    assert tables.go_strings(images).where("text = 'hello'").count() == 1
    assert tables.pclntab(images).first()["arch"] == "X86_64" and tables.moduledata(images).first()["version"] == "V3"
    assert tables.sections(images).where("present").count() == 5 and tables.segments(images).count() == 1 and tables.notes(images).count() == 1
    assert "Compiler      : Gc" in reports.text_report(tables.images(images)).first()[0]


def test_stream(spark, corpus, tmp_path):
    query = ingest.write_functions(ingest.image_stream(spark, corpus), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 13


def test_copies_of_an_image(spark, corpus, tmp_path):
    """Equal files give one image's tables, and a verdict each."""
    import shutil

    for name in ("first", "second", "third"):
        shutil.copy(f"{corpus}/one", tmp_path / name)
    once, thrice = tables.read_images(spark, corpus, "one"), tables.read_images(spark, str(tmp_path))
    for build in (tables.functions, tables.pc_values, tables.types, tables.sections, tables.go_strings, tables.inline_entries, tables.source_files, tables.itabs):
        assert sorted(map(str, build(thrice).collect())) == sorted(map(str, build(once).collect())), build.__name__
    values = tables.pc_values(thrice).where("`table` = 'pcln' and func_off = 48").orderBy("ord").collect()
    assert [(v["pc_start"], v["pc_end"]) for v in values] == [(0, 8), (8, 40), (40, 64)]
    assert tables.images(thrice).drop("path").distinct().count() == 1 and tables.images(thrice).count() == 3


def test_one_pass_of_the_kernels(spark, corpus):
    for found in (tables.images(tables.read_images(spark, corpus)), tables.pc_values(tables.read_images(spark, corpus))):
        assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


def test_depths_and_cycles(spark):
    """A long walk, a cycle with a tail, a row that is its own parent, an unknown parent, and images apart."""
    from golode.operators import intervals

    rows = [("a", i, i - 1 if i else None) for i in range(40)] + [("b", 0, 2), ("b", 1, 0), ("b", 2, 1), ("b", 3, 2), ("b", 9, 9), ("b", 10, 77)]
    df = spark.createDataFrame(rows, "image_id string, id long, parent long")
    got = {(r["image_id"], r["id"]): r["depth"] for r in intervals.depths(df, keys=["image_id"]).collect()}
    assert all(got["a", i] == min(i, 32) for i in range(40))
    assert [got["b", i] for i in (0, 1, 2, 3, 9, 10)] == [2, 2, 2, 3, 0, 0]


def test_ranges_of_any_size_and_overlap(spark):
    """Against loops: nested and empty segments, the first in order counts, one that ends beyond the address space stops."""
    import random

    from golode.operators import intervals

    rng = random.Random(2)
    top = 2**64
    segs = [(i % 3, i, rng.randrange(5000), rng.randrange(10**6), rng.choice([0, 1, 3, 16, 700, 4096])) for i in range(60)]
    segs += [(2, 30.5, top - 10, 5, 100), (0, 99, top - 16, 64, 8), (1, 98, 0, 0, 1 << 40)]
    segs = [(k, int(o * 2), a, f, s) for k, o, a, f, s in segs]
    probes = [(k, v) for k in (0, 1, 2, 7) for v in [*range(0, 9000, 37), top - 12, top - 9, top - 1]]
    wide = "decimal(20,0)"
    from decimal import Decimal

    s = spark.createDataFrame([(k, o, Decimal(a), Decimal(f), Decimal(n)) for k, o, a, f, n in segs], f"image_id int, ord int, va {wide}, file_off {wide}, size {wide}")
    p = spark.createDataFrame([(k, Decimal(v), 1) for k, v in probes], f"image_id int, va {wide}, ord int")

    def brute(k, v):
        for _, o, a, f, n in sorted((x for x in segs if x[0] == k), key=lambda x: x[1]):
            if a + n > top - 1:
                return None
            if a <= v < a + n:
                return f + v - a
        return None

    got = {(r["image_id"], int(r["va"])): r["file_off"] for r in intervals.va_to_file(s, p).collect()}
    assert {k: None if v is None else int(v) for k, v in got.items()} == {(k, v): brute(k, v) for k, v in probes}


def test_runs_over_chunks(spark, monkeypatch):
    from golode.operators import intervals

    monkeypatch.setattr(intervals, "CHUNK", 4)
    values = [1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10, 3]
    rows = [(k, i + 5 * (i > 9), v) for k in (0, 1) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k int, i long, v int")
    want = [(1, 0, 6), (2, 6, 4), (3, 15, 2), (4, 17, 9), (5, 26, 1)]
    got = intervals.monotone_runs(df.where("k = 0"), [], "i", "v").orderBy("run").collect()
    assert [tuple(r) for r in got] == want
    assert intervals.monotone_runs(df, ["k"], "i", "v").count() == 10


def test_sums_wrap_at_32_bits(spark):
    from golode.operators import intervals

    rows = [(0, i, v, p) for i, (v, p) in enumerate([(2**31 - 1, 2**32 - 1), (1, 1), (2**31, 5)])]
    df = spark.createDataFrame(rows, "k int, i int, v long, p long")
    got = intervals.running_values(df, ["k"], "i", "v", "p").orderBy("i").collect()
    assert [(r["value"], r["pc_end"]) for r in got] == [(2**31 - 2, 2**32 - 1), (2**31 - 1, 0), (-1, 5)]
    plain = intervals.running_values(df, ["k"], "i", "v", "p", wrap=False).orderBy("i").collect()
    assert [(r["value"], r["pc_end"]) for r in plain] == [(2**31 - 2, 2**32 - 1), (2**31 - 1, 2**32), (2**32 - 1, 2**32 + 5)]
