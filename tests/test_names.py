"""The name grammar over a fixed corpus."""

import pytest
from pyspark.sql import functions as F

from golode.functions import names

#: name, flags -> package, short name, receiver (name, pointer, generics), method, generic args, closure
CORPUS = [
    ("runtime.sweepone", 0, "runtime", "sweepone", None, None, None, False),
    ("net/mail.(*Reader).Next", 0, "net/mail", "(*Reader).Next", ("Reader", True, None), "Next", None, False),
    ("example.org/team/tool.(*Engine).Start", 0, "example.org/team/tool", "(*Engine).Start", ("Engine", True, None), "Start", None, False),
    ("example.org/x/deep/hash.Fresh", 0, "example.org/x/deep/hash", "Fresh", None, None, None, False),
    ("example.org/codec.v12.Encode", 0, "example.org/codec.v12", "Encode", None, None, None, False),
    ("math.Angle.Sine", 0, "math", "Angle.Sine", ("Angle", False, None), "Sine", None, False),
    ("cache.(*Table[K, V]).Size", 0, "cache", "(*Table[K, V]).Size", ("Table", True, "[K, V]"), "Size", None, False),
    ("cache.Pair[bool, rune].Swap", 0, "cache", "Pair[bool, rune].Swap", ("Pair", False, "[bool, rune]"), "Swap", "[bool, rune]", False),
    ("heap.Merge[byte]", 0, "heap", "Merge[byte]", None, None, "[byte]", False),
    ("main.main.func1", 0, "main", "main.func1", None, None, None, True),
    ("main.serve.func7.gowrap2", 0, "main", "serve.func7.gowrap2", None, None, None, True),
    ("runtime.x.func1", 4, "runtime", "x.func1", ("x", False, None), "func1", None, False),
    ("shape.Line.Cross", 0, "shape", "Line.Cross", ("Line", False, None), "Cross", None, False),
    ("bareword", 0, None, "bareword", None, None, None, False),
    ("example.net/some/part", 0, None, "example.net/some/part", ("example", False, None), "net/some/part", None, False),
    ("", 0, None, "", None, None, None, False),
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, c[0], c[1], 0, 0) for i, c in enumerate(CORPUS)], "i int, name string, flags int, func_id int, deferreturn long")
    return {r["i"]: r for r in names.derived(df).collect()}


@pytest.mark.parametrize("i", range(len(CORPUS)))
def test_grammar(rows, i):
    name, _, package, short, receiver, method, generic, closure = CORPUS[i]
    r = rows[i]
    assert (r["package"], r["short_name"], r["method_name"], r["is_closure"]) == (package, short, method, closure)
    assert r["is_method"] == (method is not None)
    assert (tuple(r["receiver"]) if r["receiver"] else None) == receiver
    if "(" not in name:
        assert r["generic_args"] == generic
    if package is not None:
        assert f"{package}.{short}" == name


def test_ids_and_tokens(spark):
    df = spark.createDataFrame([(86, "ab12cd34"), (0, "abcdefgh"), (55, "a1"), (98, "ab12cd34\n")], "i int, t string")
    got = df.select(names.func_id_name(F.col("i")), names.is_garble_token(F.col("t")), names.is_systemstack(F.col("i"))).collect()
    assert [tuple(r) for r in got] == [("goexit", True, False), (None, False, False), ("unknown_special", False, False), ("systemstack", False, True)]


def last_part(short):
    """The last bracketed part at depth 0, by a walk."""
    depth, opened, closed = 0, None, None
    for i, letter in enumerate(short):
        if letter == "[":
            opened = i if depth == 0 else opened
            depth += 1
        elif letter == "]":
            depth -= 1
            closed = i if depth == 0 else closed
    return short[opened : closed + 1] if opened is not None and closed is not None and closed > opened else None


def test_deep_generics(spark):
    shorts = ["F[a[b[c[d]]]]", "F[a[b[c[d[e]]]]].M[x]", "G[[[[[]]]]][y[z]]", "H[a[b[c[d]]]][", "K[[[[", "L]]]][[[[a]]]]"]
    df = spark.createDataFrame([(x,) for x in shorts], "s string")
    assert {r[0]: r[1] for r in df.select("s", names.generic_args(F.col("s"))).collect()} == {x: last_part(x) for x in shorts}
    assert all(r[0] for r in df.select(names.nested_deeper(F.col("s"))).collect())
    assert "Python" not in df.select(names.generic_args(F.col("s")))._jdf.queryExecution().toString()
