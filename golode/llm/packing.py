"""Hierarchical multi-length packing.

Context tiers are powers of two up to the window (256, 512, 1024, 2048). A document's full
windows become sequences of their own; what is left of it is routed to the least tier that holds
it. Within a bounded pool each tier is packed longest first: a sequence opens with its longest
document, its gap takes the longest piece of a shorter tier that fits, and when none fits a piece
is cut to fill it exactly. So every sequence but a partition's last ends up full, at the size of
its tier; the last is split over smaller tiers and only what is under the least tier is padded.
Sequences of a tier are dealt to step groups so that each group holds GROUP sequences of one tier
with about the same attention cost (sum of squared piece lengths).

A partition packs alone, in one pass and bounded memory (a pool of POOL pieces), and its
sequence ids depend on its number and order only, so a recomputed partition repeats them.

Defined results: null and empty texts are documents of the end id alone; a text of any length is
cut over as many windows as it needs; rows that repeat an id are packed each; an empty table
gives no rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from golode.llm.common import table, text_or_empty
from golode.llm.encoding import encoder

TIERS = (256, 512, 1024, 2048)
POOL = 4096
GROUP = 8
END_ID = 1
SCHEMA = (
    "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long, tier int, step_group long"
)


class Piece:
    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: bytes, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def __len__(self) -> int:
        return len(self.ids) >> 2

    def split(self, n: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc, self.start, self.ids[: 4 * n], self.total),
            Piece(self.doc, self.start + n, self.ids[4 * n :], self.total),
        )


class Pool:
    """Pieces by length; equal lengths leave in the order they came."""

    def __init__(self):
        self.keys: list[tuple[int, int]] = []
        self.pieces: dict[int, Piece] = {}
        self.count = 0

    def __len__(self) -> int:
        return len(self.keys)

    def put(self, piece: Piece) -> None:
        insort(self.keys, (len(piece), -self.count))
        self.pieces[-self.count] = piece
        self.count += 1

    def _take(self, i: int) -> Piece:
        return self.pieces.pop(self.keys.pop(i)[1])

    def longest(self) -> Piece:
        return self._take(-1)

    def fill(self, gap: int) -> Piece:
        """The longest piece that fits the gap, else a cut of the shortest piece."""
        i = bisect_right(self.keys, (gap, 1))
        if i:
            return self._take(i - 1)
        head, rest = self._take(0).split(gap)
        self.put(rest)
        return head


def tier_of(length: int, tiers=TIERS) -> int:
    return tiers[bisect_left(tiers, length)]


def sequences(documents: Iterator[tuple], tiers=TIERS, pool_size: int = POOL) -> Iterator[list[Piece]]:
    """Lists of pieces, each list a sequence, from (id, ids as bytes)."""
    window, pool = tiers[-1], Pool()

    def one() -> list[Piece]:
        seq = [pool.longest()]
        gap = tier_of(len(seq[0]), tiers) - len(seq[0])
        while gap and len(pool):
            seq.append(pool.fill(gap))
            gap -= len(seq[-1])
        return seq

    for doc, ids in documents:
        total = len(ids) >> 2
        rest = Piece(doc, 0, ids, total)
        while len(rest) >= window:
            full, rest = rest.split(window)
            yield [full]
        if len(rest):
            pool.put(rest)
        if len(pool) >= 2 * pool_size:
            while len(pool) > pool_size:
                yield one()
    while len(pool):
        seq = one()
        size = sum(map(len, seq))
        for tier in reversed(tiers):  # only the last sequence can fall short of its tier
            if size % window and size > tier:
                head, seq = take(seq, tier)
                size -= tier
                yield head
        if seq:
            yield seq


def take(seq: list[Piece], n: int) -> tuple[list[Piece], list[Piece]]:
    """The first n tokens of a sequence, and the rest."""
    head: list[Piece] = []
    rest = list(seq)
    while n:
        first = rest.pop(0)
        if len(first) > n:
            first, left = first.split(n)
            rest.insert(0, left)
        head.append(first)
        n -= len(first)
    return head, rest


class StepGroups:
    """Deals the sequences of a tier to groups of GROUP: of each GROUP * 2 in a row, the dearest
    and the cheapest go together, so that costs of groups stay level."""

    def __init__(self, base: int, size: int = GROUP):
        self.base, self.size, self.waiting, self.given = base, size, {}, 0

    def add(self, tier: int, seq) -> list[tuple]:
        waiting = self.waiting.setdefault(tier, [])
        waiting.append((sum(len(p) ** 2 for p in seq), len(waiting), seq))
        return self._deal(tier) if len(waiting) == 2 * self.size else []

    def _deal(self, tier: int) -> list[tuple]:
        ranked = sorted(self.waiting.pop(tier), key=lambda x: (-x[0], x[1]))
        first, out = self.base + self.given, []
        self.given += 2 if len(ranked) > self.size else 1
        for i, (_, _, seq) in enumerate(ranked):
            snake = i % 4 in (1, 2) and len(ranked) > self.size
            out.append((tier, seq, first + snake))
        return out

    def rest(self) -> list[tuple]:
        return [x for tier in sorted(self.waiting) for x in self._deal(tier)]


def pack(docs: DataFrame, encode_name: str, id_col="doc_id", text_col="text", tiers=TIERS) -> DataFrame:
    """One row per piece: where it comes from, the crc32 of its ids, and its place."""

    def run(batches):
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 33
        enc = encoder(encode_name)
        end = END_ID.to_bytes(4, "little")

        def documents():
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for doc, text in zip(ids, batch.column(1), strict=True):
                    yield doc, enc.encode(text.as_py()) + end

        groups, rows, number = StepGroups(base), [], 0

        def place(dealt):
            nonlocal number
            for tier, seq, group in dealt:
                offset = 0
                size = sum(map(len, seq))
                for p in seq:
                    crc = zlib.crc32(p.ids)
                    rows.append((p.doc, p.start, len(p), crc, p.total, base + number, offset, size, tier, group))
                    offset += len(p)
                number += 1

        for seq in sequences(documents(), tiers):
            place(groups.add(tier_of(sum(map(len, seq)), tiers), seq))
            if len(rows) >= 8192:
                yield batch_of(rows)
                rows.clear()
        place(groups.rest())
        if rows:
            yield batch_of(rows)

    return docs.select(docs[id_col].cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, SCHEMA)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int32() if n == "tier" else pa.int64()) for n, c in zip(names, columns, strict=True)], names
    )


def padding(lengths: np.ndarray, window: int = TIERS[-1]) -> int:
    """Padded tokens of sequences of these lengths: none at a power of two, else up to the window."""
    lengths = np.asarray(lengths)
    exact = (lengths & (lengths - 1)) == 0
    return int(np.where(exact, 0, window - lengths).sum())


def op1(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), "word_bpe_49k.json").withColumnRenamed("id", "doc_id")
