"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

A document is a row (doc_id, n_tokens, row, ids); rows are in ascending id order over the files (nulls
first), one file for each partition, and ``row`` numbers those of a file. ORC's version-2 integer run-length encoding packs the ids; each
stripe has a row index (minimum, maximum) and a Bloom filter on doc_id, so that a lookup by id
skips stripes and row groups, and stripes are read in parallel. Where a document's ids start among
all ids follows from sums over the n_tokens column alone: of files first, then within a file.

Defined results: null text is empty, so it has the end id alone; an empty table writes no rows;
rows that repeat an id are written each, one after another, and ``start`` follows that order; other
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from golode.llm.common import portions, scratch, shuffle_width, table, text_or_empty
from golode.llm.encoding import encoder

END_ID = 2
STRIPE_BYTES = 64 << 20
INDEX_STRIDE = 1000
FILE_SCHEMA = "doc_id long, n_tokens long, row long, ids array<int>"


#: Characters of the texts that are encoded at once: a word that they share is looked up once.
AT_ONCE = 6_000_000


def in_portions(batches, enc, end_id: int):
    """Batches of ids of batches (doc_id, text), about a million characters of texts each."""
    end = end_id.to_bytes(4, "little")
    written = 0
    for batch in batches:
        at = 0
        for texts in portions((t.as_py() for t in batch.column(1)), AT_ONCE):
            ids = enc.encode_all(texts, end)
            sizes, done = np.diff(ids.offsets.to_numpy()), 0
            for n in map(len, portions(texts)):
                numbers = pa.array(np.arange(written, written + n, dtype=np.int64))
                columns = [batch.column(0).slice(at, n), pa.array(sizes[done : done + n], pa.int64()), numbers, ids.slice(done, n)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "row", "ids"])
                at, written, done = at + n, written + n, done + n


def tokenised(docs: DataFrame, encode_name: str, end_id: int = END_ID, id_col="doc_id", text_col="text") -> DataFrame:
    def run(batches):
        yield from in_portions(batches, encoder(encode_name), end_id)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    ordered = slim.repartitionByRange(shuffle_width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(run, FILE_SCHEMA)


def write(tokens: DataFrame, path: str) -> None:
    (
        tokens.write.option("compression", "zstd")
        .option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.row.index.stride", INDEX_STRIDE)
        .option("orc.create.index", "true")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows with the file each lies in."""
    return spark.read.schema(FILE_SCHEMA).orc(path).withColumn("file", F.input_file_name())


def lookup(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """Rows of a few documents; the filter is pushed to the stripes' indexes and Bloom filters."""
    return spark.read.schema(FILE_SCHEMA).orc(path).where(F.col("doc_id").isin(ids))


def file_starts(rows: DataFrame) -> DataFrame:
    """file, base: ids in all files before it. One row per file, from the n_tokens column alone."""
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("held"), F.min("doc_id").alias("first"))
    before = Window.orderBy(F.col("first").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("file", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))


def starts(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files. A file is one partition's rows in order,
    so sums within it are windows over a bounded number of narrow rows."""

    def digests(batches):
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("ids"))
            bounds = lists.offsets.to_numpy()
            values = lists.values.to_numpy().astype("<u4", copy=False)
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "file", "row")), pa.array(np.diff(bounds), pa.int64()), pa.array(crcs, pa.int64())],
                ["doc_id", "file", "row", "n_tokens", "ids_crc32"],
            )

    narrow = rows.select("doc_id", "file", "row", "ids").mapInArrow(digests, "doc_id long, file string, row long, n_tokens long, ids_crc32 long")
    before = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    within = narrow.withColumn("within", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    placed = within.join(file_starts(rows), "file")
    return placed.select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op4(spark, sf_dir):
    path = scratch(spark, "tokens")
    write(tokenised(table(spark, sf_dir, "documents"), "byte_bpe_50k.json"), path)
    return starts(read(spark, path))
