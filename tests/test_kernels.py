"""Readers against images written from rows, and against damaged ones."""

import random

import pytest

from golode.operators import tables
from golode.sources import buildmeta, container, imagegen, lines, module, runtime_types, view

FUNCS = [
    dict(name=f"main.f{i}", entry=i * 64, start_line=10 + i, lines=[(8, 11 + i), (40, 10 + i), (64, 30 + i)], file="/b.go", args=8, flags=4, deferreturn=i % 2, sp=[(4, 0), (64, 32)])
    for i in range(5)
]
FUNCS[2] |= dict(inline_calls=[dict(name="fmt.A", parent_pc=2, line=3), dict(name="fmt.B", parent_pc=12, line=4)], inline_index=[(10, -1), (20, 0), (30, 1), (40, -1)])
TYPES = [
    dict(name="*main.T", kind=22, size=8, elem=1),
    dict(name="main.T", kind=25, size=16, fields=[dict(name="X", type=2, offset=0), dict(name="y", type=2, offset=8, flags=8)], methods=["Foo", "bar"]),
    dict(name="int", kind=2, size=8),
]
TEXT = "path\tx/y\nmod\tx/y\t(devel)\ndep\ta/b\tv1\th1:x\n"


def parts(data, version="go1.22.1"):
    c = container.read(data)
    t = lines.find(c)
    return c, t, module.find(c, t, version)


@pytest.mark.parametrize("version", ["go1.22.1", "go1.25"])
def test_round_trip(version):
    c, t, m = parts(imagegen.image(FUNCS, ["/a.go", "/b.go"], version, TEXT, "ab/cd", ["hello", "wörld"], TYPES, [(0, 1)]), version)
    assert c.format == "Elf" and buildmeta.build_id(c) == "ab/cd"
    assert buildmeta.build_info(c) == {"go_version": version, "mod_text": TEXT}
    got = list(lines.functions(t))
    assert [(f["name"], f["entry_offset"], f["start_line"], f["end_line"], f["frame_size"], f["source_file"], f["deferreturn"]) for f in got] == [
        (f["name"], f["entry"], f["start_line"], max(line for _, line in f["lines"]), 32, "/b.go", f["deferreturn"]) for f in FUNCS
    ]
    assert [e["depth"] for f in got for e in runtime_types.inline_entries(c, t, m, f)] == [0, 1]
    rows = list(runtime_types.Types(c, t, m).rows())
    assert [(r["name"], r["kind"], r["size"]) for r in rows] == [("*main.T", "pointer", 8), ("main.T", "struct", 16), ("int", "int", 8)]
    assert rows[0]["elem_va"] == rows[1]["type_va"]
    assert [(f["name"], f["offset"], f["is_embedded"]) for f in rows[1]["fields"]] == [("X", 0, False), ("y", 8, True)]
    assert [x["name"] for x in rows[1]["methods"]] == ["Foo", "bar"]
    (pair,) = runtime_types.itabs(c, t, m)
    assert (pair["iface_type_va"], pair["concrete_type_va"]) == (rows[0]["type_va"], rows[1]["type_va"])
    assert {"hello", "wörld"} <= {s["text"] for s in runtime_types.strings(c, t, m)}


def test_discovery_without_sections_or_magic():
    many = [dict(FUNCS[0], name=f"main.g{i}", entry=i * 64) for i in range(150)]
    c = container.read(imagegen.image(many, ["/a.go", "/b.go"], sections=False, magic=0))
    assert lines._by_shape(c).nfunc == lines._by_functions(c).nfunc == 150
    assert lines._by_magic(container.read(imagegen.image(FUNCS, ["/a.go", "/b.go"], sections=False))).nfunc == 5


@pytest.mark.parametrize("data", [b"", b"\x7fELF", b"\0" * 1024, b"\x7fELF" + b"\0" * 4092, b"B" * 4096, b"MZ" + b"\0" * 100, b"\xcf\xfa\xed\xfe" + b"\1" * 60])
def test_nothing_to_find(data):
    c, t, m = parts(data)
    assert t is None and m is None and buildmeta.build_info(c) is None


def test_damage_never_raises():
    random.seed(5)
    whole = imagegen.image(FUNCS, ["/a.go", "/b.go"], "go1.22", TEXT, "x/y", ["hello"], TYPES, [(0, 1)])
    for k in range(150):
        data = bytearray(whole)
        if k % 3 == 0:
            data = data[: random.randrange(len(data))]
        else:
            for _ in range(200):
                data[random.randrange(len(data))] = random.randrange(256)
        c, t, m = parts(bytes(data))
        buildmeta.build_id(c), buildmeta.build_info(c)
        list(runtime_types.Types(c, t, m).rows()), list(runtime_types.itabs(c, t, m)), list(runtime_types.strings(c, t, m))
        for f in lines.functions(t) if t else ():
            list(runtime_types.inline_entries(c, t, m, f))


def test_scalars():
    assert view.uvarint(b"\x08", 0) == (8, 1) and view.uvarint(b"\xac\x02", 0) == (300, 2)
    assert view.uvarint(b"\x80", 0) is None and view.uvarint(b"\x80" * 11, 0) is None
    assert view.align_up(13, 4) == 16 and view.align_up(0, 8) == 0 and view.align_up(3, 0) is None
    assert runtime_types.encoded_name(b"\x01\x05Hello", 0) == ("Hello", 1)
    assert runtime_types.encoded_name(b"\x00\x02\xff\xfe", 0) is None
    assert buildmeta.version_text(b"\0" * 50 + b"go1.26.1" + b"\0" * 42) == "go1.26.1"
    raw = b'\xff Go build ID: "abc123/def456"\n \xff'
    assert buildmeta.build_id(container.read(raw)) == "abc123/def456"
    assert module.layout_of("Go120", 22, True) == "V3" and module.layout_of("Go120", None, False) == "V4" and module.layout_of("Go120", 27, False) == "V5"
    assert module.minor_of("go1.22.1") == 22 and module.minor_of("go1.26rc1") is None and module.minor_of("devel go1.23") is None


@pytest.mark.parametrize("form", ["elf", "macho", "pe"])
@pytest.mark.parametrize(("magic", "version", "layout"), [(0xFFFFFFF0, "go1.19.2", "V2"), (0xFFFFFFFA, "go1.17", "V2"), (0xFFFFFFF1, "go1.22.1", "V3"), (0xFFFFFFF1, "go1.25", "V4")])
def test_all_containers_and_layouts(form, magic, version, layout):
    """The same rows come out of every container, by sections or by search, and every record layout."""
    made = imagegen.image(FUNCS, ["/a.go", "/b.go"], version, "path\tx\n", "ab/cd", ["hello"], TYPES, [(0, 1)], magic, True, form)
    p = tables.Parsed(made)
    assert p.container.format == {"elf": "Elf", "macho": "MachO", "pe": "Pe"}[form]
    assert ("gopclntab" in p.container.present) == (form != "pe")
    assert p.module["version"] == layout and p.version == version
    assert [f["name"] for f in lines.functions(p.table)] == [f["name"] for f in FUNCS]
    assert list(p.table.files()) == ["/a.go", "/b.go"] and buildmeta.build_id(p.container) == "ab/cd"
    assert [t["name"] for t in runtime_types.Types(p.container, p.table, p.module).rows()] == [t["name"] for t in TYPES]
    assert len(list(runtime_types.itabs(p.container, p.table, p.module))) == 1
    assert "hello" in {s["text"] for s in runtime_types.strings(p.container, p.table, p.module)}
    for cut in (4, 64, 200, len(made) // 3, len(made) - 40):
        list(lines.functions(table) if (table := tables.Parsed(made[:cut]).table) else ())
