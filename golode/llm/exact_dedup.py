"""Exact dedup by heavy-hitter split.

Texts are equal when their normalised forms (the six ASCII blanks deleted) are identical; digests
stand for them. A Misra-Gries summary per partition names the digests that can be frequent. The
few that an exact count confirms (at most ``COUNTERS``) are broadcast with their winners, and
their rows are settled map-side; the rows of all other digests are settled by an ordinary
shuffle: aggregate (with map-side combine), then join back.

Defined results: null text counts as empty; an empty table gives no rows; columns of the input
other than id and text are ignored, whatever their names; of equal texts the row with the most
code points, then the smallest id stays; rows that repeat one id share that id's fate and each
count for group_size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from golode.llm.common import staged, table, text_or_empty

#: Counters of a Misra-Gries summary, and so the most digests that are broadcast.
COUNTERS = 256

BLANKS = " \t\n\x0b\x0c\r"


def normalised(text):
    return F.translate(text, BLANKS, "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: id, digest of the normalised text, code points of the text."""
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest"),
        F.char_length(text).cast("long").alias("points"),
    )


def summarise(batches: Iterator[pa.RecordBatch], counters: int) -> dict[bytes, int]:
    """Misra-Gries, a batch at a time: what occurs over n / (counters + 1) times among the n
    values is in the result, with a count too low by at most n / (counters + 1)."""
    held: dict[bytes, int] = {}
    for batch in batches:
        for one in pc.value_counts(batch.column(0)).to_pylist():
            held[one["values"]] = held.get(one["values"], 0) + one["counts"]
        if len(held) > counters:
            cut = sorted(held.values(), reverse=True)[counters]
            held = {k: n - cut for k, n in held.items() if n > cut}
    return held


def frequent(prints: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Digests that occur over 2 n / (counters + 1) times among the n rows, at most ``counters``."""

    def per_partition(batches):
        held = summarise(batches, counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["digest", "low"]
        )

    lows = prints.select("digest").mapInArrow(per_partition, "digest binary, low long")
    return lows.groupBy("digest").agg(F.sum("low").alias("low")).orderBy(F.desc("low"), "digest").limit(counters)


def _winner():
    best = F.min(F.struct((-F.col("points")).alias("p"), F.col("id").alias("i")))
    return [best["i"].alias("keep_id"), F.count(F.lit(1)).alias("group_size")]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """id, digest, keep_id, group_size, kept: one row for each row of docs."""
    prints = staged(fingerprints(docs, id_col, text_col), "prints")
    candidates = staged(frequent(prints, counters), "candidates")  # at most `counters` rows of 40 bytes
    total = prints.count()
    heavy = staged(
        prints.join(F.broadcast(candidates.select("digest")), "digest", "left_semi")
        .groupBy("digest")
        .agg(*_winner())
        .where(F.col("group_size") * (counters + 1) > 2 * total),
        "heavy",
    )
    hot = F.broadcast(heavy)
    settled = prints.join(hot, "digest")
    rest = prints.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    others = rest.join(rest.groupBy("digest").agg(*_winner()), "digest")
    return settled.unionByName(others).select(
        "id", "digest", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept")
    )


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_dedup drops. Rows that repeat one id are copies too: the
    one with the smallest hash of the whole row stays."""
    fates = exact_dedup(docs, id_col, text_col).groupBy("id").agg(F.count_if(F.col("kept")).alias("times"))
    odd = staged(fates.where("times <> 1").withColumnRenamed("id", "__id"), "fates")  # few, so docs need no shuffle
    same = F.col(id_col).eqNullSafe(F.col("__id"))
    rest = docs.join(odd.where("times = 0"), same, "left_anti")
    repeated = odd.where("times > 1")
    if repeated.isEmpty():
        return rest
    order = Window.partitionBy(id_col).orderBy(F.xxhash64(*[F.col(c) for c in docs.columns]))
    first = rest.join(repeated, same, "left_semi").withColumn("__nth", F.row_number().over(order))
    return rest.join(repeated, same, "left_anti").unionByName(first.where("__nth = 1").select(docs.columns))


def op10(spark, sf_dir):
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP10_SQL = """
WITH p AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS kept,
       text_sha256
FROM p
"""
