"""Round trips over tables whose nations have many suppliers."""

import duckdb
import pytest
from pyspark.sql import functions as F

from golode.plans import queries
from golode.sources import imagegen
from golode.sources.runtime_types import encoded_name
from tests.test_entry import SF, rows

NAMES = "functions macho pe older inline itabs buildinfo strings".split()


def test_images_do_not_grow_with_the_table(spark):
    few, many = (spark.range(n).select(F.col("id").alias("s_suppkey"), (F.col("id") % 2).alias("nation")) for n in (3000, 30_000))
    found = [[r["length"] for r in queries._image_of(t, lambda held: b"x" * len(held)).collect()] for t in (few, many)]
    assert [sum(x) for x in found] == [3000, 30_000] and max(found[1]) <= queries.IMAGE_KEYS


@pytest.mark.parametrize("name", [*(f"q_roundtrip_{n}" for n in NAMES), "q_source_files", "q_build_id"])
def test_nations_of_several_images(spark, monkeypatch, tmp_path, name):
    monkeypatch.setattr(queries, "IMAGE_KEYS", 40)
    con = duckdb.connect()
    con.execute(f"CREATE TABLE supplier AS SELECT s.* REPLACE (s_suppkey + 50 * r AS s_suppkey, s_nationkey % 3 AS s_nationkey) FROM '{SF}/supplier.parquet' s, range(4) t(r)")
    con.execute(f"COPY supplier TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    found = queries.QUERIES[name](spark, str(tmp_path))
    cursor = con.execute(queries.ORACLES[name])
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows([d[0] for d in cursor.description], cursor.fetchall())


class Slices(bytes):
    """Bytes that note how much is copied out of them."""

    def __getitem__(self, at):
        got = super().__getitem__(at)
        if isinstance(at, slice):
            self.most = max(getattr(self, "most", 0), len(got))
        return got


def test_a_name_is_read_without_copying_what_is_before_it():
    data = Slices(b"\0" * 100_000 + imagegen.named("main.T", 1))
    assert encoded_name(data, 100_000) == ("main.T", 1) and data.most < 100
    assert encoded_name(Slices(data[:-1]), 100_000) is None and encoded_name(Slices(b"\1" + b"\x80" * 9 + b"\0"), 0) is None
