"""Exact top-k by inner product: dual-tree search with cover trees.

Rows are dealt to cells (the nearest of at most PIVOTS sampled vectors, one for every BLOCK rows) and
cells to blocks of about BLOCK rows, by the sides of random planes through the cell on which they
lie, so that rows of a block are near each other. A block of candidates is a cover tree, built once
and kept with it: a node's points lie within its radius, its children are the node's own centre and
centres further apart than half the radius, and each point is within that half of its child. A node
whose cover would be nearly its points (under SPARSE points for each centre, as in many dimensions
without clusters), or of at most LEAF points, has no children. Queries are trees as well.

A pair of nodes (query centre a, radius r; candidate centre b, radius s) scores at most
    <a, b> + |a| s + |b| r + r s,
and is pruned when that is below the worst kth score of the queries under the query node. Each
query block first meets the blocks of its own cell, which gives its queries a kth score to beat.
The same bound on whole cells (at most PIVOTS, broadcast) and then on their blocks says which other
blocks it must meet; it meets the most promising ones first, and its kth scores go on from one to the
next. Scores are exact integers (sums below 2^53 in floating point, big integers beyond).

Defined results: rows whose id, vector or a component is null, or not finite (or a double of MOST and
more, scaled), take no part; vectors
of unequal lengths count as padded with zeros; of repeated ids no row is a candidate of a query
of that id, and each such row is a query; ties go to the smaller id; a score beyond the range of a
long is the end of that range; fewer than k candidates give fewer rows; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from golode.llm.common import shuffle_width, staged, table

#: Cells at most: 270 million rows; beyond that cells have several blocks.
PIVOTS = 4096
BLOCK = 8192
QUERY_BLOCK = 512
LEAF = 64
#: Points for each centre, below which a cover is not worth while.
SPARSE = 4
CHUNK = 2048
#: Planes that cut a cell into blocks.
SIDES = 24
SCALE = 1024
#: Scaled components from here on count as not finite: their squares are no doubles. No float reaches it.
MOST = 1e140
NONE = np.iinfo(np.int64).min


class Tree:
    """A cover tree over rows of x (float64): arrays by node, breadth first; ``order`` lists the
    rows so that those of a node are order[lo:hi]; children of node n are first[n]:first[n] + kids[n]."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        centre, radius, lo, hi, first, kids = [], [], [], [], [], []

        def node(a: int, b: int, c: int) -> None:
            away = np.sqrt(((x[self.order[a:b]] - x[c]) ** 2).sum(1))
            centre.append(c), radius.append(float(away.max(initial=0.0))), lo.append(a), hi.append(b), first.append(0), kids.append(0)

        if len(x):
            node(0, len(x), int(((x - x.mean(0)) ** 2).sum(1).argmin()))
        n = 0
        while n < len(centre):
            a, b = lo[n], hi[n]
            groups = self._cover(x, self.order[a:b], centre[n], radius[n] / 2) if b - a > leaf and radius[n] > 0 else None
            if groups:
                self.order[a:b] = np.concatenate([rows for _, rows in groups])
                first[n], kids[n] = len(centre), len(groups)
                for c, rows in groups:
                    node(a, a + len(rows), c)
                    a += len(rows)
            n += 1
        self._set(x, np.array([centre, lo, hi, first, kids], np.int64), np.array(radius))

    def _set(self, x, shape: np.ndarray, radius: np.ndarray) -> None:
        self.shape, self.radius = shape, radius
        self.centre, self.lo, self.hi, self.first, self.kids = shape
        self.at = x[self.centre] if len(x) else x
        self.norm = np.sqrt((self.at**2).sum(1))

    def packed(self) -> tuple[bytes, bytes, bytes]:
        return self.order.astype("<i4").tobytes(), self.shape.astype("<i4").tobytes(), self.radius.astype("<f8").tobytes()

    @classmethod
    def unpacked(cls, x: np.ndarray, order: bytes, shape: bytes, radius: bytes) -> Tree:
        self = cls.__new__(cls)
        self.order = np.frombuffer(order, "<i4").astype(np.int64)
        self._set(x, np.frombuffer(shape, "<i4").astype(np.int64).reshape(5, -1), np.frombuffer(radius, "<f8"))
        return self

    @staticmethod
    def _cover(x, rows, start, within):
        """Centres further than ``within`` apart, from ``start`` on, and the rows nearest to each, all
        of them within that; None if there would be under SPARSE rows for each centre."""
        points = x[rows]
        best, of, centres = np.full(len(rows), np.inf), np.zeros(len(rows), np.int64), []
        c = start
        while True:
            away = np.sqrt(((points - x[c]) ** 2).sum(1))
            nearer = away < best
            of[nearer], best[nearer] = len(centres), away[nearer]
            centres.append(c)
            far = int(best.argmax())
            if best[far] <= within:
                return [(c, rows[of == i]) for i, c in enumerate(centres)]
            # Early on, the rows that are covered tell; in the end, the number of centres.
            if len(centres) >= 16 and ((best <= within).sum() < SPARSE * len(centres) or SPARSE * len(centres) > len(rows)):
                return None
            c = int(rows[far])


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2**53:
        return (a @ b.T).astype(np.int64)
    big = lambda x: np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape)
    held = np.iinfo(np.int64)
    return np.array([[max(held.min + 1, min(held.max, v)) for v in r] for r in big(a) @ big(b).T], np.int64).reshape(len(a), len(b))


class Best:
    """The k best (score, id) of each query, those with the smaller id first among equals. ``kth``
    is the score that a candidate must reach: the floor, or the kth best once there are k."""

    def __init__(self, ids: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.k, self.kth = ids, k, floor.copy()
        self.score, self.found = [np.empty(0, np.int64)] * len(ids), [np.empty(0, np.int64)] * len(ids)

    def add(self, queries: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        hit = (scores >= self.kth[queries][:, None]) & (ids[None, :] != self.ids[queries][:, None])
        for row in np.flatnonzero(hit.any(1)):
            q, ok = queries[row], np.flatnonzero(hit[row])
            s = scores[row, ok]
            if len(ok) > 4 * self.k:  # only what reaches the kth of these
                least = np.partition(s, len(s) - self.k)[len(s) - self.k]
                ok, s = ok[s >= least], s[s >= least]
            score, found = np.concatenate([self.score[q], s]), np.concatenate([self.found[q], ids[ok]])
            top = np.lexsort((found, -score))[: self.k]
            self.score[q], self.found[q] = score[top], found[top]
            if len(top) == self.k:
                self.kth[q] = max(self.kth[q], score[top[-1]])


def dual_search(qx: np.ndarray, q: Tree, cx: np.ndarray, cids: np.ndarray, c: Tree, best: Best) -> None:
    """Adds to the best of each query what of the candidates belongs there."""
    if not len(qx) or not len(cx):
        return

    def bounds(n: int, nodes: np.ndarray) -> np.ndarray:
        r, s = q.radius[n], c.radius[nodes]
        top = c.at[nodes] @ q.at[n] + q.norm[n] * s + c.norm[nodes] * r + r * s
        return top + 1e-9 * np.abs(top) + 1e-6

    def visit(n: int, nodes: np.ndarray) -> None:
        rows = q.order[q.lo[n] : q.hi[n]]
        top = bounds(n, nodes)
        keep = top >= best.kth[rows].min()
        nodes, top = nodes[keep], top[keep]
        if not len(nodes):
            return
        inner = c.kids[nodes] > 0
        if q.kids[n]:
            below = nodes[~inner]
            if inner.any():
                below = np.concatenate([below, *[np.arange(c.first[m], c.first[m] + c.kids[m]) for m in nodes[inner]]])
            for child in range(q.first[n], q.first[n] + q.kids[n]):
                visit(child, below)
        elif inner.any():
            # The most promising inner node's children first, with the leaves, then the others'.
            visit(n, nodes[~inner]) if not inner.all() else None
            for m in nodes[inner][np.argsort(-top[inner], kind="stable")]:
                visit(n, np.arange(c.first[m], c.first[m] + c.kids[m]))
        else:
            order = np.argsort(-top, kind="stable")
            at = 0
            while at < len(order):
                if top[order[at]] < best.kth[rows].min():
                    return
                picked, size = [], 0
                while at < len(order) and size < CHUNK:
                    m = nodes[order[at]]
                    picked.append(c.order[c.lo[m] : c.hi[m]])
                    size += len(picked[-1])
                    at += 1
                points = np.concatenate(picked)
                best.add(rows, cids[points], exact_scores(qx[rows], cx[points]))

    visit(0, np.array([0]))


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, x (doubles, still to be rounded down): rows with a whole, finite vector."""
    scaled = F.transform(F.col(vector_col), lambda v: v.cast("double") * scale)
    finite = F.forall(F.col(vector_col), lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double") * scale) < MOST))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("id"), scaled.alias("x")
    )


def _matrix(lists: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = lists.value_lengths().to_numpy()
    out = np.zeros((len(sizes), dim))
    flat = lists.flatten().to_numpy()
    if (sizes == dim).all():
        return flat.reshape(-1, dim).astype(np.float64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes] or [[]]).astype(int)] = flat
    return out


BLOCK_SCHEMA = "block long, cell long, ids binary, data binary, tree_order binary, shape binary, radii binary, centre array<double>, radius double"
PACKED = ("ids", "data", "tree_order", "shape", "radii")


def blocks(rows: DataFrame, size: int, dim: int) -> DataFrame:
    """Rows (id, x, cell, sides) as blocks of about ``size`` rows of one cell each, with their trees."""
    cells = rows.groupBy("cell").count()  # one row per pivot
    splits = F.greatest(F.ceil(F.log2(F.col("count") / size)), F.lit(0)).cast("int")
    dealt = rows.join(F.broadcast(cells.select("cell", splits.alias("splits"))), "cell")
    side = F.col("sides").bitwiseAND(F.expr("shiftleft(1L, splits) - 1"))
    dealt = dealt.withColumn("block", F.col("cell") * (1 << SIDES) + side)

    def one(group: pa.Table) -> pa.Table:
        x = _matrix(group.column("x"), dim)
        ids = group.column("id").to_numpy()
        centre = x.mean(0)
        order, shape, radii = Tree(x).packed()
        row = {
            "block": group.column("block")[0].as_py(), "cell": group.column("cell")[0].as_py(), "ids": ids.astype("<i8").tobytes(),
            "data": x.astype("<f8" if np.abs(x).max(initial=0) > 2**24 else "<f4").tobytes(), "tree_order": order, "shape": shape, "radii": radii,
            "centre": centre.tolist(), "radius": float(np.sqrt(((x - centre) ** 2).sum(1)).max()),
        }
        kinds = {"block": pa.int64(), "cell": pa.int64(), "centre": pa.list_(pa.float64()), "radius": pa.float64()}
        return pa.table({k: pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()})

    return dealt.groupBy("block").applyInArrow(one, BLOCK_SCHEMA)


def _unpack(row: tuple, dim: int) -> tuple[np.ndarray, np.ndarray, Tree]:
    ids, data, *tree = row
    ids = np.frombuffer(ids, "<i8")
    kind = "<f4" if len(data) == 4 * dim * len(ids) else "<f8"
    x = np.frombuffer(data, kind).reshape(-1, dim).astype(np.float64)
    return ids, x, Tree.unpacked(x, *tree)


HITS = "q_block long, nth int, query_id long, vec_id long, score long"


def _searched(pairs: DataFrame, k: int, dim: int) -> DataFrame:
    """Hits of pairs of blocks (q_block, bound, floors or null, q_ and c_ columns of PACKED): those of
    a query block in a row, from the highest bound down, its kth scores going on from pair to pair."""
    names = ["q_block", "floors", *(f"{side}_{c}" for side in "qc" for c in PACKED)]

    def hits(q_block, best):
        nth = np.repeat(np.arange(len(best.ids)), [len(s) for s in best.score])
        if len(nth):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(nth), q_block)), pa.array(nth, pa.int32()), pa.array(best.ids[nth]), pa.array(np.concatenate(best.found)), pa.array(np.concatenate(best.score))],
                [x.split()[0] for x in HITS.split(", ")],
            )

    def run(batches):
        last, x, tree, best = None, None, None, None
        for batch in batches:
            for pair in zip(*(batch.column(n) for n in names), strict=True):
                q_block, floors, *packed = (v.as_py() for v in pair)
                if q_block != last:
                    if best is not None:
                        yield from hits(last, best)
                    last = q_block
                    ids, x, tree = _unpack(packed[: len(PACKED)], dim)
                    best = Best(ids, k, np.full(len(ids), NONE) if floors is None else np.array(floors, np.int64))
                cids, cx, ctree = _unpack(packed[len(PACKED) :], dim)
                dual_search(x, tree, cx, cids, ctree, best)
        if best is not None:
            yield from hits(last, best)

    ordered = pairs.repartition(shuffle_width(pairs.sparkSession), "q_block").sortWithinPartitions("q_block", F.desc("bound"))
    return ordered.select(*names).mapInArrow(run, HITS)


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q_block", "nth").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _worth_meeting(sums: DataFrame, at: np.ndarray, radii: np.ndarray) -> DataFrame:
    """q_block, a, r, worst, cell: the cells, but for its own, that may hold a better score for a query
    block (q_block, q_cell, a, r, worst). Pivots and radii go along: PIVOTS rows at most."""
    norms = np.sqrt((at**2).sum(1))

    def run(batches):
        for batch in batches:
            found = []
            for i, (home, a, r, worst) in enumerate(zip(*(batch.column(c) for c in ("q_cell", "a", "r", "worst")), strict=True)):
                a, r = np.array(a.as_py()), r.as_py()
                top = at @ a + np.sqrt(a @ a) * radii + norms * r + r * radii
                alive = (radii >= 0) & (top + 1e-9 * np.abs(top) + 1e-6 >= worst.as_py())
                alive[home.as_py()] = False
                cells = np.flatnonzero(alive)
                found.append((np.full(len(cells), i), cells))
            rows, cells = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
            kept = batch.select(["q_block", "a", "r", "worst"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cells, pa.int64())], ["q_block", "a", "r", "worst", "cell"])

    return sums.mapInArrow(run, "q_block long, a array<double>, r double, worst long, cell long")


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col="vec_id", vector_col="embedding", scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: exact, of all rows for the rows that ``is_query`` picks."""
    whole = staged(integer_vectors(vectors, id_col, vector_col, scale).withColumn("q", F.coalesce(is_query, F.lit(False))), "vectors")
    dim = whole.agg(F.max(F.size("x"))).first()[0] or 0
    cells = max(1, min(PIVOTS, -(-whole.count() // BLOCK)))
    pivots = whole.orderBy(F.xxhash64("id"), "id").limit(cells).select("x").toArrow()  # a bounded sample
    at = np.floor(_matrix(pivots.column("x"), dim)) if dim and len(pivots) else np.zeros((1, dim))
    planes = np.random.default_rng(5).normal(size=(dim, SIDES))

    def celled(batches):
        for batch in batches:
            x = np.floor(_matrix(batch.column(1), dim))
            near = (x @ at.T - 0.5 * (at**2).sum(1)).argmax(1)
            off = x - at[near]
            sides = ((off @ planes > 0) << np.arange(SIDES)).sum(1).astype(np.int64)
            away = np.sqrt((off**2).sum(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dim, pa.int32()), pa.array(x.ravel()))
            columns = [batch.column(0), lists, batch.column(2), pa.array(near, pa.int64()), pa.array(sides), pa.array(away)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "x", "q", "cell", "sides", "away"])

    rows = staged(whole.mapInArrow(celled, "id long, x array<double>, q boolean, cell long, sides long, away double"), "cells")
    radii = np.full(len(at), -1.0)  # of a cell without rows: -1
    for row in rows.groupBy("cell").agg(F.max("away")).collect():  # a number for each of at most PIVOTS cells
        radii[row[0]] = row[1]
    cand = staged(blocks(rows, BLOCK, dim), "candidates")
    quer = staged(blocks(rows.where("q"), QUERY_BLOCK, dim), "queries")
    c = cand.select(F.col("block").alias("c_block"), "cell", *[F.col(n).alias(f"c_{n}") for n in PACKED])
    q = quer.select(F.col("block").alias("q_block"), "cell", *[F.col(n).alias(f"q_{n}") for n in PACKED])

    # The blocks of the own cell: floors for all queries of a block.
    home = q.join(c, "cell").withColumns({"floors": F.lit(None).cast("array<long>"), "bound": F.lit(0.0)})
    first = staged(_best(_searched(home, k, dim), k).drop("rank"), "home")
    kth = first.groupBy("q_block", "nth").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(int(NONE))).alias("kth"))
    count = F.shiftright(F.octet_length("q_ids"), 3)
    every = q.select("q_block", F.explode(F.sequence(F.lit(0), count - 1)).alias("nth"))
    kth = every.join(kth, ["q_block", "nth"], "left").select("q_block", "nth", F.coalesce("kth", F.lit(int(NONE))).alias("kth"))
    floors = staged(
        kth.groupBy("q_block").agg(  # at most about QUERY_BLOCK numbers each
            F.transform(F.array_sort(F.collect_list(F.struct("nth", "kth"))), lambda v: v["kth"]).alias("floors"), F.min("kth").alias("worst")
        ),
        "floors",
    )
    # Bounds on cells, then on their blocks, a narrow row for what is left.
    sums = quer.select(F.col("block").alias("q_block"), F.col("cell").alias("q_cell"), F.col("centre").alias("a"), F.col("radius").alias("r"))
    alive = _worth_meeting(sums.join(floors.select("q_block", "worst"), "q_block"), at, radii)
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda u: F.sqrt(dot(u, u))
    bound = dot("a", "centre") + norm("a") * F.col("radius") + norm("centre") * F.col("r") + F.col("r") * F.col("radius")
    met = alive.join(cand.select("cell", F.col("block").alias("c_block"), "centre", "radius"), "cell").withColumn("bound", bound + 1e-9 * F.abs(bound) + 1e-6)
    pairs = staged(met.where(F.col("bound") >= F.col("worst")).select("q_block", "c_block", "bound"), "pairs")
    others = pairs.join(q.drop("cell"), "q_block").join(floors.select("q_block", "floors"), "q_block").join(c.drop("cell"), "c_block")
    hits = first.unionByName(_searched(others, k, dim))
    return _best(hits, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
