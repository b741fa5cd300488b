"""Quality classifier: a factorisation machine over hashed words, structure and text metadata.

A document's features are its tokens (runs of letters or digits, lower-cased, and runs of signs)
hashed into BUCKETS, each weighing the root of its share of the tokens; statistics of structure
(signs, capitals, digits, word and line lengths, repetition); and the text's own length as
metadata. Beside linear weights every feature has RANK factors, and all pairs of features interact
through them. By the sum-of-squares identity
    sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)
a score takes time linear in the number of features.

The model is fitted on a bounded sample of labelled rows whose crc32(id as text) mod 3 is not 1: those
with the smallest hashes of their ids, at most TRAIN_ROWS of them and of TRAIN_FEATURES features in
all (a feature is eight bytes on the driver). Rows where it is 1 are held out. Neither id nor lang,
source or label is a feature. The model's size is fixed, so it is broadcast.

Defined results: null and empty texts have structure 0 and get the score of those; rows that
repeat an id are scored each; without labels of both kinds every score is the share of label 1
(0.5 without any); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from golode.llm.common import Kept, portions, staged, table, text_or_empty

BUCKETS = 1 << 15
RANK = 8
TRAIN_ROWS = 12_000
TRAIN_FEATURES = 8_000_000
EPOCHS = 12
BATCH = 128
STATS = 14
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")


#: Buckets of tokens that this process met.
_BUCKETS = Kept(lambda token: zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) & (BUCKETS - 1))


def structure(text: str, tokens: list[str]) -> list[float]:
    """STATS numbers about the form of a text, each within about 0 to 10."""
    n, count = len(text), len(tokens)
    if not n or not count:
        return [0.0] * STATS
    lines = text.split("\n")
    raw = text.encode("utf-8", "surrogatepass")
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    signs = len(raw) - len(raw.translate(None, b"!\"#$%&()*+/:;<=>?@[\\]^_`{|}~"))
    stops = raw.count(b".") + raw.count(b",")
    blanks = raw.count(b" ") + len(lines)
    distinct = len(set(tokens))
    return [
        10 * upper / n,
        10 * signs / n,
        10 * digits / n,
        10 * stops / blanks,
        n / blanks / 4,
        10 * distinct / count,
        np.log1p(n / len(lines)),
        np.log1p(len(lines)),
        10 * len(set(lines)) / len(lines),
        10 * raw.count(b"|") / blanks,
        10 * raw.count(b"!") / blanks,
        10 * sum(t.isupper() for t in tokens) / count,
        10 * (signs + stops) / count,
        np.log1p(n),
    ]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row starts, buckets and weights of the hashed tokens, and the structure of each text."""
    ids, sizes, stats = [], [], []
    for text in texts:
        tokens = _TOKEN.findall(text)
        ids.extend(map(_BUCKETS.__getitem__, tokens))
        sizes.append(len(tokens))
        stats.append(structure(text, tokens))
    sizes = np.array(sizes, np.int64)
    keys = np.repeat(np.arange(len(texts), dtype=np.int64), sizes) * BUCKETS + np.array(ids, np.int64)
    keys, counts = np.unique(keys, return_counts=True)
    rows = keys // BUCKETS
    weights = np.sqrt(counts / np.maximum(sizes, 1)[rows]).astype(np.float32)
    starts = np.searchsorted(rows, np.arange(len(texts) + 1))
    return starts, (keys % BUCKETS).astype(np.int32), weights, np.array(stats, np.float32).reshape(-1, STATS)


class Machine:
    """Weights w and factors v of BUCKETS hashed tokens, then of STATS statistics."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.w = np.zeros(BUCKETS + STATS, np.float32)
        self.v = rng.normal(0, 0.02, (BUCKETS + STATS, RANK)).astype(np.float32)
        self.mean, self.sd = np.zeros(STATS, np.float32), np.ones(STATS, np.float32)

    def scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.sd, -4, 4) / np.float32(2)

    def _sums(self, starts, ids, weights, stats):
        """Of each row: the linear term, and per factor the sum and the sum of squares."""
        n = len(starts) - 1
        linear = np.zeros(n, np.float32)
        total, squares = np.zeros((n, RANK), np.float32), np.zeros((n, RANK), np.float32)
        some = np.flatnonzero(np.diff(starts))
        if len(some):
            at = starts[some]
            linear[some] = np.add.reduceat(self.w[ids] * weights, at)
            vx = self.v[ids] * weights[:, None]
            total[some], squares[some] = np.add.reduceat(vx, at), np.add.reduceat(vx * vx, at)
        own = self.v[BUCKETS:]
        linear += stats @ self.w[BUCKETS:]
        total += stats @ own
        squares += (stats * stats) @ (own * own)
        return linear, total, squares

    def margins(self, starts, ids, weights, stats) -> np.ndarray:
        linear, total, squares = self._sums(starts, ids, weights, self.scaled(stats))
        return self.bias + linear + 0.5 * (total * total - squares).sum(1)

    def scores(self, *found) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(*found).astype(np.float64), -30, 30)))

    def fit(self, starts, ids, weights, stats, y, epochs=EPOCHS, seed=11) -> Machine:
        """AdaGrad on the logistic loss, the classes weighing the same."""
        share = float(y.mean()) if len(y) else 0.5
        if share in (0.0, 1.0) or not len(y):
            self.v[:] = 0
            self.bias = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))) if len(y) else 0.0
            return self
        self.mean, self.sd = stats.mean(0), stats.std(0) + np.float32(1e-3)
        stats = self.scaled(stats)
        cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        rng = np.random.default_rng(seed)
        gw, gv, gb = np.full_like(self.w, 1e-2), np.full_like(self.v, 1e-2), 1e-2
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), BATCH):
                rows = order[lo : lo + BATCH]
                sizes = (starts[rows + 1] - starts[rows]).astype(np.int64)
                picked = np.repeat(starts[rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
                b_ids, b_x = ids[picked], weights[picked]
                b_starts, s = np.concatenate([[0], np.cumsum(sizes)]), stats[rows]
                linear, total, squares = self._sums(b_starts, b_ids, b_x, s)
                margin = np.clip(self.bias + linear + 0.5 * (total * total - squares).sum(1), -30, 30)
                slope = (cost[rows] * (1 / (1 + np.exp(-margin)) - y[rows]) / len(rows)).astype(np.float32)
                of = np.repeat(np.arange(len(rows)), sizes)
                g = slope[of] * b_x
                uniq, back = np.unique(b_ids, return_inverse=True)
                dw = np.bincount(back, g, len(uniq)).astype(np.float32) + 1e-5 * self.w[uniq]
                inner = g[:, None] * (total[of] - self.v[b_ids] * b_x[:, None])
                dv = np.stack([np.bincount(back, inner[:, f], len(uniq)) for f in range(RANK)], 1).astype(np.float32)
                dv += 1e-5 * self.v[uniq]
                own = slice(BUCKETS, BUCKETS + STATS)
                sw = s.T @ slope + 1e-4 * self.w[own]
                sv = s.T @ (slope[:, None] * total) - ((s * s).T @ slope)[:, None] * self.v[own] + 1e-4 * self.v[own]
                for at, d, grad, par in ((uniq, dw, gw, self.w), (own, sw, gw, self.w), (uniq, dv, gv, self.v), (own, sv, gv, self.v)):
                    grad[at] += d * d
                    par[at] -= 0.1 * d / np.sqrt(grad[at])
                gb += float(slope.sum()) ** 2
                self.bias -= 0.1 * float(slope.sum()) / gb**0.5
        return self


def fold(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def training_rows(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", most=TRAIN_ROWS) -> DataFrame:
    """y and the features of at most ``most`` labelled rows outside the held-out fold, and their hash."""
    drawn = F.crc32(F.concat(F.lit("fit"), F.col("known_id").cast("string")).cast("binary"))
    known = (
        labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("known_id"))
        .agg(F.max("quality").alias("y"))
        .where(fold("known_id") != 1)
        .withColumn("drawn", drawn)
        .orderBy("drawn", "known_id")
        .limit(most)
    )

    def run(batches):
        for batch in batches:
            at = 0
            for texts in portions(t.as_py() for t in batch.column(1)):
                part = batch.slice(at, len(texts))
                at += len(texts)
                starts, ids, weights, stats = features(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int32()),
                        pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids)),
                        pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(weights)),
                        pa.array(list(stats), pa.list_(pa.float32())),
                        part.column(2),
                        part.column(3),
                    ],
                    ["y", "ids", "weights", "stats", "known_id", "drawn"],
                )

    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    found = texts.join(F.broadcast(known), F.col("id").cast("long") == F.col("known_id")).select("y", "text", "known_id", "drawn")
    return found.mapInArrow(run, "y int, ids array<int>, weights array<float>, stats array<float>, known_id long, drawn long")


def fit(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", most=TRAIN_ROWS) -> Machine:
    found = staged(training_rows(docs, labels, id_col, text_col, most), "training")
    # One number a sampled row says where the sample's features reach their bound.
    sizes = sorted(tuple(r) for r in found.select("drawn", "known_id", F.size("ids")).collect())
    held = np.cumsum([n for _, _, n in sizes])
    last = sizes[max(0, int(np.searchsorted(held, TRAIN_FEATURES, "right")) - 1)] if sizes else (0, 0, 0)
    within = F.struct("drawn", "known_id") <= F.struct(F.lit(last[0]).cast("long").alias("drawn"), F.lit(last[1]).cast("long").alias("known_id"))
    rows = found.where(within).toArrow().sort_by("known_id")
    ids, weights = rows.column("ids").combine_chunks(), rows.column("weights").combine_chunks()
    if not rows.num_rows:
        return Machine().fit(np.zeros(1, np.int64), None, None, None, np.zeros(0))
    starts = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
    stats = np.array(rows.column("stats").to_pylist(), np.float32).reshape(-1, STATS)
    y = rows.column("y").to_numpy().astype(np.float32)
    machine = Machine().fit(starts, ids.flatten().to_numpy(), weights.flatten().to_numpy(), stats, y)
    # Else Arrow keeps the pages of the sample on the driver for as long as it lives.
    del rows, ids, weights
    pa.default_memory_pool().release_unused()
    return machine


def scored(docs: DataFrame, machine: Machine, id_col="doc_id", text_col="text") -> DataFrame:
    """id, held_out, score, predicted: one row per document."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches):
        _BUCKETS.own()
        machine = model.value
        for batch in batches:
            scores = [machine.scores(*features(texts)) for texts in portions(t.as_py() for t in batch.column(2))]
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["id", "held_out", "score", "predicted"],
            )

    slim = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(fold(id_col) == 1, F.lit(False)).alias("held_out"), text_or_empty(text_col).alias("text")
    )
    return slim.mapInArrow(run, "id long, held_out boolean, score double, predicted int")


def good_only(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """docs whose score is 0.5 or more, their columns unchanged, in one pass without a join."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text_col)

    def run(batches):
        _BUCKETS.own()
        machine = model.value
        for batch in batches:
            scores = [machine.scores(*features(texts)) for texts in portions(t.as_py() or "" for t in batch.column(at))]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("id", "doc_id")
