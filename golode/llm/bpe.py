"""Byte-level BPE, encoding and decoding, by DuckDB recursive queries in each partition.

A word is a match of the split pattern. Its bytes are rows (word, position, token); a recursive
query joins neighbouring tokens with the merge table (left, right -> merged, whose id is its rank)
and contracts the pair of least rank of each word, the leftmost first, until no pair merges. A
word that is itself a token is that token.

Words of over LONG bytes go by another query to the same result. Its recursion is keyed by word and
position, so only live tokens are held (the other keeps its generations, fewer than LONG, and is
twice as fast). It contracts many places in a step: every pair that no pair of lower rank stands near. A token has a bounded length, so what is further than a few of these away cannot reach the
pair before its turn, and the result is that of one contraction at a time. Of pairs of equal rank
that overlap (as in "aaa") each second one of the run contracts, from its left end; where a merge
may be followed at once by one of a lower rank, only the first such pair nearby does. Steps then
follow the length of tokens, not of the word. Decoding selects the bytes of each of a document's ids from
the list of tokens and joins them in order.

Words repeat, so a process keeps the ids of pieces and words it has met (up to a bound in bytes) and asks
DuckDB for the new words of a batch in blocks; a text's ids are those of its pieces in a row, since
the pattern never looks across the cut between pieces. Signs after a simple word are a piece of their own,
so nearly all pieces are words and each is kept once. DuckDB may not write to disk.

Defined results: null text counts as empty and has no ids; special tokens are ordinary text; rows
that repeat an id are encoded each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from golode.llm.common import portions, table, text_or_empty
from golode.llm.encoding import byte_pieces, signs_apart

#: Bytes of pieces and words of a generation that a process keeps, and bytes of words of a query.
KEPT = 128 << 20
BLOCK_BYTES = 250_000
LONG = 64
#: Characters of texts that are encoded together.
PORTION = 3_000_000
#: Ids of a decoding query.
BLOCK_IDS = 500_000

#: The pair of least rank, leftmost first, of each word, packed as rank, position and both lengths less 1.
#: Positions run through all words with one left free after each, so that a token meets its neighbour by one key.
ONE_BY_ONE = """
WITH RECURSIVE step(word, pos, size, tok, depth) AS (
    SELECT word, pos, 1::UTINYINT, tok, 0::UTINYINT FROM start
  UNION ALL
    -- The neighbours are kept apart, so that no plan joins tokens with all their merges first.
    (WITH pairs AS MATERIALIZED (
        SELECT a.word, a.pos, a.size, a.tok, b.tok AS nxt, b.size AS nxt_size FROM step a JOIN step b ON b.pos = a.pos + a.size
     ), least AS (
        SELECT p.word, min((m.merged::BIGINT << 40) | (p.pos::BIGINT << 12) | ((p.size::BIGINT - 1) << 6) | (p.nxt_size::BIGINT - 1)) AS best
        FROM pairs p JOIN merges m ON m.l = p.tok AND m.r = p.nxt GROUP BY p.word
     ), chosen AS (
        SELECT word, ((best >> 12) & 268435455)::INTEGER AS place, (((best >> 6) & 63) + 1)::UTINYINT AS lsize, ((best & 63) + 1)::UTINYINT AS rsize,
               (best >> 40)::INTEGER AS merged
        FROM least
     )
     SELECT s.word, s.pos, CASE WHEN s.pos = place THEN lsize + rsize ELSE s.size END, CASE WHEN s.pos = place THEN merged ELSE s.tok END, s.depth + 1::UTINYINT
     FROM step s JOIN chosen l ON l.word = s.word WHERE s.pos <> place + lsize)
)
SELECT s.word, list(s.tok ORDER BY s.pos) AS toks
FROM step s JOIN (SELECT word, max(depth) AS last FROM step GROUP BY word) e ON e.word = s.word AND e.last = s.depth
GROUP BY s.word
"""

#: All places at once that nothing near comes before; {near} is three times the longest token.
MANY_AT_ONCE = """
WITH RECURSIVE step(word, pos, tok) USING KEY (word, pos) AS (
    SELECT word, pos, tok FROM start
  UNION
    (WITH pairs AS (
        SELECT word, pos, tok, lag(tok) OVER w AS prv, lead(tok) OVER w AS nxt, lead(tok, 2) OVER w AS nxt2, row_number() OVER w AS nth
        FROM recurring.step WHERE tok >= 0 AND word IN (SELECT word FROM step)
        WINDOW w AS (PARTITION BY word ORDER BY pos)
     ), ranked AS (
        SELECT p.*, m.merged, coalesce(m.alone, false) AS may FROM pairs p LEFT JOIN merges m ON m.l = p.tok AND m.r = p.nxt
     ), beside AS (
        -- alone: a merge of the new token with what is beside it may come next, before others of its rank.
        SELECT word, pos, nth, merged, merged IS DISTINCT FROM lag(merged) OVER w AS new,
               may AND (lag(merged) OVER w IS NOT DISTINCT FROM merged OR lag(merged, 2) OVER w IS NOT DISTINCT FROM merged
                        OR EXISTS (FROM merges a WHERE a.l = r.merged AND a.r = r.nxt2 AND a.merged < r.merged)
                        OR EXISTS (FROM merges a WHERE a.l = r.prv AND a.r = r.merged AND a.merged < r.merged)) AS alone
        FROM ranked r WINDOW w AS (PARTITION BY word ORDER BY pos)
     ), hits AS (
        SELECT *, coalesce(merged = min(merged) OVER (PARTITION BY word ORDER BY pos RANGE BETWEEN {near} PRECEDING AND {near} FOLLOWING), false) AS hit
        FROM beside
     ), runs AS (
        SELECT *, max(CASE WHEN new THEN nth END) OVER w AS began, coalesce(max(CASE WHEN NOT hit THEN nth END) OVER w, 0) AS missed,
               alone AND coalesce(bool_or(hit) OVER (PARTITION BY word ORDER BY pos RANGE BETWEEN {near} PRECEDING AND 1 PRECEDING), false) AS late
        FROM hits WINDOW w AS (PARTITION BY word ORDER BY pos ROWS UNBOUNDED PRECEDING)
     ), cuts AS (
        SELECT word, pos, merged, hit AND (nth - began) % 2 = 0 AND missed < began AND NOT late AS cut FROM runs
     ), joined AS (
        SELECT *, coalesce(lag(cut) OVER (PARTITION BY word ORDER BY pos), false) AS gone FROM cuts
     )
     SELECT word, pos, CASE WHEN cut THEN merged ELSE -1 END FROM joined WHERE cut OR gone)
)
SELECT word, list(tok ORDER BY pos) AS toks FROM step WHERE tok >= 0 GROUP BY word
"""

#: The spelling of each id of a list; those out of the table have none.
DECODE = """
SELECT word, array_to_string(list_select(spelt, ids), '') AS spelt FROM coded, tokens
"""


class Kept:
    """Ids by key in two generations: what is added or met again is in the young one; ``turn`` makes
    that the old one once it holds over ``most`` bytes, and the old one is forgotten."""

    def __init__(self, most: int):
        self.most, self.size, self.young, self.old = most, 0, {}, {}

    def turn(self) -> None:
        if self.size > self.most:
            self.young, self.old, self.size = {}, self.young, 0

    def missing(self, keys: set) -> set:
        """Those of the keys that are not kept; the others are in the young generation then."""
        rest, old = keys.difference(self.young), self.old
        again = {k: old[k] for k in rest if k in old}
        self.add(again)
        return rest.difference(again)

    def add(self, found: dict) -> None:
        """Adds keys that the young generation has not."""
        self.young.update(found)
        self.size += 200 * len(found) + sum(map(len, found)) + sum(map(len, found.values()))


class Codec:
    """Encodes and decodes by a rank file; lives in a Python worker."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "preserve_insertion_order": False, "temp_directory": ""})
        # A character stands for each byte; the list is one row, counted from 1.
        spelt: list = [None] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            spelt[rank] = token.decode("latin-1")
        self.size = len(spelt)
        lists = pa.table({"spelt": pa.array([spelt], pa.list_(pa.string()))})  # noqa: F841  DuckDB reads it by name
        self.db.execute("CREATE TABLE tokens AS SELECT * FROM lists")
        found = [
            (self.ranks[t[:i]], self.ranks[t[i:]], rank)
            for t, rank in self.ranks.items()
            for i in range(1, len(t))
            if t[:i] in self.ranks and t[i:] in self.ranks
        ]
        lefts, rights, merged = (pa.array(x, pa.int32()) for x in zip(*found, strict=True))
        pairs = pa.table({"l": lefts, "r": rights, "merged": merged})  # noqa: F841  DuckDB reads it by name
        # alone: a merge that takes the new token ranks below it, so it must be contracted by itself.
        self.db.execute(
            "CREATE TABLE merges AS SELECT p.*, coalesce(t.least < p.merged, false) AS alone FROM pairs p LEFT JOIN "
            "(SELECT tok, min(merged) AS least FROM (SELECT l AS tok, merged FROM pairs UNION ALL SELECT r, merged FROM pairs) "
            "GROUP BY tok) t ON t.tok = p.merged"
        )
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.many_at_once = MANY_AT_ONCE.format(near=3 * max(map(len, self.ranks)))
        # Only under this pattern signs after a word are known to be matches of their own.
        self.cut = signs_apart if pattern == public_tokenizers.PATTERN else byte_pieces
        self.kept = Kept(KEPT)

    def contract(self, words: list[bytes]) -> list[bytes]:
        """The ids (little-endian unsigned 32-bit) of words that are no token themselves."""
        out: list = [None] * len(words)
        for long in (False, True):
            at = [i for i, w in enumerate(words) if (len(w) > LONG) == long]
            lo = 0
            while lo < len(at):
                hi, size = lo, 0
                while hi < len(at) and (hi == lo or size + len(words[at[hi]]) <= BLOCK_BYTES):
                    size += len(words[at[hi]])
                    hi += 1
                block = [words[i] for i in at[lo:hi]]
                word = np.repeat(np.arange(len(block), dtype=np.int32), [len(w) for w in block])
                tokens = self.single[np.frombuffer(b"".join(block), np.uint8)]
                start = pa.table({"word": word, "pos": np.arange(len(word), dtype=np.int32) + word, "tok": tokens})
                found = self._ask(self.many_at_once if long else ONE_BY_ONE, "start", start)
                lists = found.column(1).combine_chunks()
                ends = (lists.offsets.to_numpy().astype(np.int64) * 4).tolist()
                raw = lists.values.to_numpy().astype("<u4").tobytes()
                for k, word in enumerate(found.column(0).to_pylist()):
                    out[at[lo + word]] = raw[ends[k] : ends[k + 1]]
                lo = hi
        return out

    def _ask(self, sql: str, name: str, rows: pa.Table) -> pa.Table:
        self.db.register(name, rows)
        found = self.db.sql(sql).to_arrow_table()
        self.db.unregister(name)
        return found

    def expand(self, coded: list[bytes]) -> list[bytes]:
        """The bytes that lists of ids stand for."""
        out: list[bytes] = []
        while len(out) < len(coded):
            lo = hi = len(out)
            size = 0
            while hi < len(coded) and (hi == lo or size + (len(coded[hi]) >> 2) <= BLOCK_IDS):
                size += len(coded[hi]) >> 2
                hi += 1
            block = coded[lo:hi]
            ends = np.cumsum([0, *(len(x) >> 2 for x in block)]).astype(np.int32)
            ids = np.frombuffer(b"".join(block), "<i4")
            at = np.where((ids >= 0) & (ids < self.size), ids, self.size) + np.int32(1)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(at, pa.int32()))
            found = self._ask(DECODE, "coded", pa.table({"word": np.arange(len(block), dtype=np.int32), "ids": lists}))
            got = dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True))
            out += [(got[i] or "").encode("latin-1") for i in range(len(block))]
        return out

    def learn(self, pieces: set[str]) -> None:
        """Keeps the ids of pieces, and of their words."""
        cut = {p: self.pattern.findall(p) for p in pieces}
        new = list(self.kept.missing(set().union(*cut.values())))
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        whole = [self.ranks.get(w) for w in raw]
        rest = iter(self.contract([w for w, t in zip(raw, whole, strict=True) if t is None]))
        self.kept.add({w: t.to_bytes(4, "little") if t is not None else next(rest) for w, t in zip(new, whole, strict=True)})
        ids = self.kept.young.__getitem__
        self.kept.add({p: b"".join(map(ids, ws)) for p, ws in cut.items() if len(ws) > 1})

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit."""
        self.kept.turn()
        cut = [self.cut(t) for t in texts]
        new = self.kept.missing(set().union(*cut))
        if new:
            self.learn(new)
        ids = self.kept.young.__getitem__
        return [b"".join(map(ids, ps)) for ps in cut]


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(name: str, pattern: str) -> Codec:
    key = (name, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(name if "/" in name else public_tokenizers.path(name), pattern)
    return _CODECS[key]


def encode(docs: DataFrame, name: str, pattern: str = public_tokenizers.PATTERN, id_col="doc_id", text_col="text") -> DataFrame:
    """id, ids: the ids of every whole text."""

    def run(batches):
        known = codec(name, pattern)
        for batch in batches:
            at = 0
            for texts in portions((t.as_py() for t in batch.column(1)), PORTION):
                ids = [memoryview(x).cast("I").tolist() for x in known.encode_all(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])
                at += len(ids)

    return docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "id long, ids array<int>")


def decode(coded: DataFrame, name: str, pattern: str = public_tokenizers.PATTERN, id_col="id", ids_col="ids") -> DataFrame:
    """id, bytes: what id lists stand for; null lists give null, ids out of the table nothing."""

    def run(batches):
        known = codec(name, pattern)
        for batch in batches:
            lists = batch.column(1).to_pylist()
            back = known.expand([np.array(x or [], "<i4").tobytes() for x in lists])
            out = [None if x is None else b for x, b in zip(lists, back, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "bytes"])

    return coded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, bytes binary")


def digests(docs: DataFrame, name: str, pattern: str = public_tokenizers.PATTERN, id_col="doc_id", text_col="text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256: encoded, and the ids decoded, in one pass."""

    def run(batches):
        known = codec(name, pattern)
        for batch in batches:
            rows = []
            for texts in portions((t.as_py() for t in batch.column(1)), PORTION):
                coded = known.encode_all(texts)
                for ids, back in zip(coded, known.expand(coded), strict=True):
                    rows.append((len(ids) >> 2, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c) for c in zip(*rows, strict=True))], ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
                )

    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return slim.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), "byte_bpe_multi_50k.tiktoken").withColumnRenamed("id", "doc_id")
