"""Near-duplicate classes by Order MinHash, verified by banded alignment.

Words are runs between white space, lower-cased; k-mers are SHINGLE words in a row, labelled by
occurrence (the second "a b c d e" of a text is another k-mer than the first). A sample of a text's
sketch hashes every labelled k-mer, takes the ELLS smallest, and puts them back in text order; the
hash of that sequence is the sample's bucket. Two texts share a sample only where the same k-mers
are smallest *and* stand in the same order, so agreement follows edit similarity rather than set
similarity. Texts in one bucket are candidates. A candidate pair is verified by aligning the words
of both in a band: similar when 1 - (edit distance of words) / (words of the longer) >= SIMILARITY,
for which a band of (1 - SIMILARITY) of the length suffices, so the check is exact.

Copies first: texts of equal words are one class before any sketch is compared, so thousands of
copies cost one representative. Then:
 1. every text is tried against the one of the WINDOW before it (in order of length), in each bucket
    of its ordered samples, that it is most likely similar to: as many pairs as rows, whatever the
    size of a group. The links among them make the first classes;
 2. each ordered sample also has a wide bucket, of its smallest k-mer alone (and texts of under SHORT
    words, few of whose k-mers outlive an edit, buckets of three words in order). Wide buckets hold
    any pair of SIMILARITY but for a rest that ``test_recall_of_scattered_edits`` measures. A first
    pass over them keeps what bounds leave of the pairs of different classes: the pairs themselves,
    which are verified once however many buckets they share, where there are at most SPARSE for each
    row of the bucket; else the rows, and of each its likeliest pair, which is verified as well. A
    second pass, over the rows of such buckets that still are of several classes, with their words,
    aligns every pair that is not linked yet and gives a spanning forest of the links of a bucket.
    So rows grow with those of the buckets, and no link between classes is lost.
A pair is left out before the alignment only where bounds show that it can't be similar: its
lengths, or the labelled words that one text has and the other lacks (in the first pass counted in
bits by hash, at least as many bits as words; in the second exactly). A wide bucket of over BLOCK
rows (in the second pass: of over CELL_WORDS words) is dealt to all pairs of its cells, so each pair
meets in one task and no task holds more than two cells; that costs rows times cells, but the rows
of the largest class of a bucket do not meet each other, and cost only the cells of the others. The
comparisons of bits within a bucket grow with the square of its rows of like length. Components come
from alternating large-star and small-star rounds on tables in the shared folder: no links are
collected; they end when all that is left are stars. Keys that hold over 1 / HEAVY of all rows are
joined by broadcast (HEAVY rows at most). Rows of buckets, and texts, that have no partner are mostly
dropped before they are shuffled, by a filter of bounded size (``maybe_in``).

Defined results: texts of under SHINGLE words are duplicates only of texts of equal words; null
text counts as empty, and all empty texts are one class; an empty table gives no rows; of a class
the smallest id is its name; rows that repeat an id are copies of each other; a row without an id
is a class of its own (class_id null, class_size 1); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from golode.llm.common import Kept, free_name, heavy_join, maybe_in, shuffle_width, staged, table, text_or_empty

SHINGLE = 5
SIMILARITY = 0.8
ELLS = 2
SAMPLES = 16
#: Texts of fewer words also have samples of SHORT_ELLS single words.
SHORT = 80
SHORT_ELLS = 3
#: Rows before a text, in a bucket of ordered samples, that it is tried against.
WINDOW = 64
#: Rows of a cell of a large bucket, and words of one.
BLOCK = 8000
CELL_WORDS = 250_000
#: Pairs for each row of a wide bucket up to which pairs are kept in place of rows.
SPARSE = 4
#: Links of a task that writes them.
EDGES = 100_000
#: The fewest bits that stand for a text's words.
BITS = 512
_MIX = np.random.default_rng(20240229).integers(1, 2**63, SAMPLES, dtype=np.int64).astype(np.uint64) | np.uint64(1)

#: 64-bit hashes of words that this process met.
_WORDS = Kept(lambda word: xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")))


def words_of(text: str) -> list[str]:
    return text.lower().split()


def digest_of(words: list[str]) -> bytes:
    """Of the words themselves, not of their hashes: equal digests are equal words."""
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def kmers(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the runs of ``size`` words, each labelled by its occurrence."""
    n = len(words) - size + 1
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = _finish(h * np.uint64(0x100000001B3) + words[i : i + n])
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if not new.all():
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        seen = np.empty(n, np.uint64)
        seen[order] = (np.arange(n) - first).astype(np.uint64)
        h = _finish(h + seen * np.uint64(0x9E3779B97F4A7C15))
    return h


def _samples(h: np.ndarray, ells: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each sample: the hash of its ``ells`` smallest in text order, and that of the smallest alone."""
    out, least = np.empty(SAMPLES, np.uint64), np.empty(SAMPLES, np.uint64)
    step = max(1, 200_000 // len(h))
    for lo in range(0, SAMPLES, step):
        mixed = _finish(h[None, :] * _MIX[lo : lo + step, None])
        rows = np.arange(len(mixed))
        at = mixed.argmin(1)[:, None]
        key = np.arange(salt + lo, salt + lo + len(mixed), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        least[lo : lo + step] = _finish(h[at[:, 0]] + key)
        while at.shape[1] < min(ells, len(h)):
            mixed[rows, at[:, -1]] = np.uint64(2**64 - 1)
            at = np.concatenate([at, mixed.argmin(1)[:, None]], 1)
        at.sort(1)
        for c in range(at.shape[1]):
            key = _finish(key * np.uint64(0x100000001B3) + h[at[:, c]])
        out[lo : lo + step] = key
    return out, least


def sketch(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the ordered samples, and the wide ones."""
    ordered, wide = _samples(kmers(words), ELLS, 0)
    if len(words) < SHORT:
        wide = np.concatenate([wide, _samples(kmers(words, 1), SHORT_ELLS, 1000)[0]])
    return ordered, wide


def word_bits(words: np.ndarray) -> bytes:
    """The set of labelled words, as the bits of their hashes: a power of two of bits, BITS at least
    and no fewer than words. The bits of half the size are the two halves laid over each other."""
    width = max(BITS, 1 << (len(words) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(_finish(kmers(words, 1) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & np.uint64(width - 1)] = True
    return np.packbits(bits).tobytes()


def folded(data: np.ndarray, width: int) -> np.ndarray:
    """Rows of bits (64 to a number) cut to ``width`` bits."""
    while data.shape[1] * 64 > width:
        half = data.shape[1] // 2
        data = data[:, :half] | data[:, half:]
    return data


def most_edits(size):
    """The most edits of a similar pair whose longer text has ``size`` words."""
    return ((1 - SIMILARITY) * size + 1e-9).astype(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the edit distance of two word sequences is at most (1 - least) of the longer one:
    furthest-reaching diagonals, within the band that this distance allows."""
    longest = max(len(a), len(b))
    most = int((1 - least) * longest + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    n, m = len(a), len(b)
    if not n or not m:
        return n == m
    # Common ends cost nothing.
    k = min(n, m)
    same = a[:k] == b[:k]
    pre = k if same.all() else int(same.argmin())
    a, b = a[pre:], b[pre:]
    k = min(len(a), len(b))
    if k:
        same = a[len(a) - k :][::-1] == b[len(b) - k :][::-1]
        post = k if same.all() else int(same.argmin())
        a, b = a[: len(a) - post], b[: len(b) - post]
    n, m = len(a), len(b)
    if max(n, m) <= most:
        return True
    # An edit spoils at most q of the runs of q words, so what the two share bounds the distance.
    for q in (1, 2, 3):
        if max(n, m) - q + 1 - _common(_runs(a, q), _runs(b, q)) > q * most:
            return False
    return _banded(a, b, most) <= most


def _runs(a: np.ndarray, q: int) -> np.ndarray:
    n, h = max(0, len(a) - q + 1), np.zeros(max(0, len(a) - q + 1), np.uint64)
    for i in range(q if n else 0):
        h = _finish(h * np.uint64(0x100000001B3) + a[i : i + n])
    return h


def _common(a: np.ndarray, b: np.ndarray) -> int:
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    return int(np.minimum(ca[ia], cb[ib]).sum())


def _banded(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance, or more than ``most`` if it is larger. The band around the diagonal is a bit
    vector (vertical differences up and down) that moves on by a row with each word of the shorter
    sequence; whole columns are whole-number operations."""
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    at: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        at[word] = at.get(word, 0) | 1 << i
    width = 2 * most + 2
    full = (1 << width) - 1
    up, down = full << (width - most - 1) & full, 0
    distance, start = most, most + 1 - width
    diagonal, last_row = 1 << (width - 1), 1 << (width - 2)
    hopeless = most + m - (n - most)
    for j, word in enumerate(b.tolist()):
        same = at.get(word, 0)
        same = (same >> start if start >= 0 else same << -start) & full
        zero = ((same & up) + up ^ up | same | down) & full
        right_up = (down | ~(zero | up)) & full
        right_down = zero & up
        if j < n - most:
            distance += not zero & diagonal
        else:
            distance += bool(right_up & last_row) - bool(right_down & last_row)
            last_row >>= 1
        if distance > hopeless:
            return most + 1
        moved = zero >> 1
        up, down = (right_down | ~(moved | right_up)) & full, moved & right_up
        start += 1
    return distance


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, digest of the words, n_words, samples, wide samples, bits and BITS of them (none under
    SHINGLE words)."""

    def run(batches):
        _WORDS.own()
        none = np.empty(0, np.uint64)
        for batch in batches:
            digests, sizes, samples, wide, bits, brief = [], [], [], [], [], []
            for text in batch.column(1):
                plain = words_of(text.as_py())
                digests.append(digest_of(plain))
                sizes.append(len(plain))
                enough = len(plain) >= SHINGLE
                words = word_hashes(plain) if enough else none
                found = sketch(words) if enough else (none, none)
                samples.append(found[0].view(np.int64))
                wide.append(found[1].view(np.int64))
                bits.append(word_bits(words) if enough else b"")
                brief.append(folded(np.frombuffer(bits[-1], np.uint64)[None], BITS).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(digests, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(samples, pa.list_(pa.int64())),
                    pa.array(wide, pa.list_(pa.int64())),
                    pa.array(bits, pa.binary()),
                    pa.array(brief, pa.binary()),
                ],
                ["id", "digest", "n_words", "samples", "wide", "bits", "brief"],
            )

    return texts_of(docs, id_col, text_col).mapInArrow(
        run, "id long, digest binary, n_words long, samples array<long>, wide array<long>, bits binary, brief binary"
    )


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    slim = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return slim.where(F.col("id").isNotNull())


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each bucket that has several, from rows in order of bucket."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column("bucket").to_numpy()
        if not len(keys):
            continue
        starts = np.flatnonzero(np.concatenate([[last is None or keys[0] != last], keys[1:] != keys[:-1]])).tolist()
        edges = [*starts, len(keys)]
        if edges[0]:
            held.append(batch.slice(0, edges[0]))
        for lo, hi in zip(edges, edges[1:], strict=False):
            if sum(map(len, held)) > 1:
                yield pa.Table.from_batches(held)
            held = [batch.slice(lo, hi - lo)]
        last = keys[-1]
    if sum(map(len, held)) > 1:
        yield pa.Table.from_batches(held)


def columns(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows.column(c).to_numpy() for c in names]


def nearest_before(rows: pa.Table) -> tuple[list[int], list[int]]:
    """Of each text, the one of the WINDOW before it that it is most likely similar to, as ids."""
    ids, sizes = columns(rows, "id", "n_words")
    data = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(len(ids), -1)
    order = np.lexsort((ids, sizes))
    ids, sizes, data = ids[order], sizes[order], data[order]
    counts = np.bitwise_count(data).sum(1, dtype=np.int64)
    found: tuple[list[int], list[int]] = [], []
    for i in range(1, len(ids)):
        lo = max(0, i - WINDOW, int(np.searchsorted(sizes, sizes[i] - most_edits(sizes[i]))))
        if lo < i:
            least = np.maximum(counts[lo:i], counts[i]) - np.bitwise_count(data[lo:i] & data[i]).sum(1, dtype=np.int64)
            best = lo + int(least.argmin())
            if least[best - lo] <= most_edits(sizes[i]):
                found[0].append(int(ids[i]))
                found[1].append(int(ids[best]))
    return found


def open_pairs(rows: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """A row and those no longer than it that are of another class (and cell, if there are several)
    and that bounds on lengths and bits leave as possibly similar, the likeliest first."""
    classes, cells, sizes = columns(rows, "class", "cell", "n_words")
    if (classes == classes[0]).all():
        return
    order = np.argsort(sizes, kind="stable")
    classes, cells, sizes = classes[order], cells[order], sizes[order]
    most = most_edits(sizes)
    lows = np.searchsorted(sizes, sizes - most)
    if (lows == np.arange(len(sizes))).all():
        return
    apart = bool((cells != cells[0]).any())
    bits = rows.column("bits").to_pylist()
    bits = [bits[k] for k in order]
    widths = np.fromiter(map(len, bits), np.int64, len(bits)) * 8
    for width in np.unique(widths):
        # Longer texts have no fewer bits, so rows of a width stand in a row.
        lo, hi = np.searchsorted(widths, [width, width + 1])
        end = np.searchsorted(widths, 2 * width + 1)
        data = [np.frombuffer(b"".join(bits[a:b]), np.uint64) for a, b in ((lo, hi), (hi, end)) if b > a]
        wide = [folded(d.reshape(n, -1), width) for d, n in zip(data, (hi - lo, end - hi), strict=False)]
        data = np.concatenate(wide)
        counts = np.bitwise_count(data).sum(1, dtype=np.int64)
        for i in range(lo + 1, end):
            a, b = max(lo, lows[i]), min(i, hi)
            if a >= b:
                continue
            open_ = classes[a:b] != classes[i]
            if apart:
                open_ &= cells[a:b] != cells[i]
            if not open_.any():
                continue
            common = np.bitwise_count(data[a - lo : b - lo] & data[i - lo]).sum(1, dtype=np.int64)
            least = np.maximum(counts[a - lo : b - lo], counts[i - lo]) - common
            open_ &= least <= most[i]
            if open_.any():
                at = np.flatnonzero(open_)
                yield int(order[i]), order[a + at[np.argsort(least[at], kind="stable")]]


def contested(rows: pa.Table) -> np.ndarray:
    """Which rows are in an open pair."""
    mark = np.zeros(len(rows), bool)
    for i, near in open_pairs(rows):
        mark[i] = True
        mark[near] = True
    return mark


def linked(rows: pa.Table) -> tuple[list[int], list[int]]:
    """Links that connect the rows of a bucket as far as similar texts of different classes (and
    cells, if there are several) do; a pair that is connected already is not aligned."""
    classes, cells, ids, sizes = columns(rows, "class", "cell", "id", "n_words")
    if (classes == classes[0]).all():
        return [], []
    order = np.lexsort((ids, sizes))
    classes, cells, ids, sizes = classes[order], cells[order], ids[order], sizes[order]
    raw = rows.column("words").to_pylist()
    words = [np.frombuffer(raw[k], np.uint64) for k in order]
    _, codes = np.unique(np.concatenate([kmers(w, 1) for w in words]), return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    here = np.zeros(int(codes.max()) + 1, bool)
    most = most_edits(sizes)
    lows = np.searchsorted(sizes, sizes - most)
    root = np.unique(classes, return_inverse=True)[1]
    apart = bool((cells != cells[0]).any())
    found: tuple[list[int], list[int]] = [], []
    for i in range(1, len(ids)):
        lo = int(lows[i])
        open_ = root[lo:i] != root[i]
        if apart:
            open_ &= cells[lo:i] != cells[i]
        if not open_.any():
            continue
        mine = codes[starts[i] : ends[i]]
        here[mine] = True
        common = np.add.reduceat(here[codes[starts[lo] : ends[i - 1]]], starts[lo:i] - starts[lo], dtype=np.int64)
        here[mine] = False
        near = np.flatnonzero(open_ & (sizes[i] - common <= most[i]))
        for j in (lo + near[np.argsort(-common[near], kind="stable")]).tolist():
            if root[j] != root[i] and similar(words[i], words[j]):
                found[0].append(int(ids[i]))
                found[1].append(int(ids[j]))
                root[root == root[j]] = root[i]
    return found


def dealt(rows: DataFrame, weight, most: int, all_pairs: bool) -> DataFrame:
    """rows with ``cell`` (0, or in a bucket whose weights sum to over ``most``, one of its cells),
    bucket then naming a cell or, with ``all_pairs``, each pair of cells; ``home`` is the bucket.
    Most rows of buckets of one row (with ``all_pairs``, of one class) are left out."""
    mates = "class" if all_pairs else "id"
    sizes = rows.groupBy("bucket").agg(F.sum(weight).alias("size"), F.min(mates).alias("low"), F.max(mates).alias("high"))
    live = staged(sizes.where("low < high").select("bucket", "size"), "live")
    rows = maybe_in(rows, "bucket", live)
    large = live.where(F.col("size") > most).select(F.col("bucket").alias("home"), F.ceil(F.col("size") / most).alias("cells"))
    rows = rows.withColumn("home", F.col("bucket"))
    whole = F.lit(0).cast("long")
    if large.isEmpty():
        return rows.withColumn("cell", whole)
    names = [*rows.columns, "cell"]
    small = rows.join(large, "home", "left_anti").withColumn("cell", whole).select(names)
    deal = F.xxhash64("id", "home")
    if all_pairs:
        # Cells of the class of most weight come first, and meet those of the others only.
        of_class = rows.join(large, "home", "left_semi").groupBy("home", "class").agg(F.sum(weight).alias("size"))
        main = of_class.groupBy("home").agg(F.max(F.struct("size", "class")).alias("main"), F.sum("size").alias("size"))
        main = main.where(F.col("size") > F.col("main.size"))
        mains, others = F.ceil(F.col("main.size") / most), F.ceil((F.col("size") - F.col("main.size")) / most)
        main = staged(main.select("home", F.col("main.class").alias("main"), mains.alias("mains"), others.alias("others")), "main")
        split = rows.join(main, "home").withColumn("is_main", F.col("class") == F.col("main"))
        first, last = F.when(F.col("is_main"), F.col("mains")).otherwise(whole), F.col("mains") + F.col("others") - 1
        apart = F.when(F.col("is_main"), F.pmod(deal, "mains")).otherwise(F.col("mains") + F.pmod(deal, "others"))
        split = split.withColumn("cell", apart).withColumn("other", F.explode(F.sequence(first, last)))
        part = F.xxhash64("home", F.least("cell", "other"), F.greatest("cell", "other"))
    else:
        split = rows.join(large, "home").withColumn("cell", F.pmod(deal, "cells"))
        part = F.xxhash64("home", "cell")
    return small.unionByName(split.withColumn("bucket", part).select(names))


def by_bucket(rows: DataFrame, run, schema: str) -> DataFrame:
    ordered = rows.repartition(shuffle_width(rows.sparkSession), "bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(run, schema)


def links_by_bucket(find):
    """A mapInArrow function: the pairs of ids that ``find`` gives for each bucket."""

    def run(batches):
        for rows in buckets(batches):
            a, b = find(rows)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def contested_by_bucket(batches):
    """Of a bucket with few open pairs, the pairs (id, other); else its rows in open pairs (other is
    null), and of each row its likeliest open pair."""
    for rows in buckets(batches):
        mark = np.zeros(len(rows), bool)
        pairs: list[tuple[int, np.ndarray]] = []
        count, few = 0, True
        for i, near in open_pairs(rows):
            mark[i] = True
            mark[near] = True
            count += len(near)
            if few and count > SPARSE * len(rows):
                pairs, few = [(k, others[:1].copy()) for k, others in pairs], False
            pairs.append((i, near if few else near[:1].copy()))
        if not pairs:
            continue
        one = np.repeat(np.array([i for i, _ in pairs]), [len(near) for _, near in pairs])
        two = np.concatenate([near for _, near in pairs])
        ids = rows.column("id").combine_chunks()
        none = pa.nulls(len(one), pa.int64())
        names = ["home", "class", "id", "n_words", "other"]
        yield pa.RecordBatch.from_arrays([none, none, ids.take(pa.array(one)), none, ids.take(pa.array(two))], names)
        if not few:
            kept = rows.select(names[:4]).filter(pa.array(mark))
            yield from kept.append_column("other", pa.nulls(len(kept), pa.int64())).combine_chunks().to_batches()


def tried_first(reps: DataFrame) -> DataFrame:
    """a, b: the pairs of the ordered samples, as many as rows at most."""
    rows = reps.where(F.size("samples") > 0)
    rows = rows.select(F.explode("samples").alias("bucket"), "id", "n_words", F.col("brief").alias("bits"))
    pairs = by_bucket(dealt(rows, F.lit(1), BLOCK, False), links_by_bucket(nearest_before), "a long, b long")
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def pairs_and_rows(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """a, b: open pairs of the wide buckets; and the rows (bucket, class, id, n_words) of those that
    have more pairs than are kept."""
    rows = reps.where(F.size("wide") > 0).select(F.explode("wide").alias("bucket"), "class", "id", "n_words", "bits")
    schema = "home long, class long, id long, n_words long, other long"
    found = by_bucket(dealt(rows, F.lit(1), BLOCK, True), contested_by_bucket, schema)
    found = staged(found.withColumnRenamed("home", "bucket"), "contested")
    pairs = found.where("other IS NOT NULL").select(F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b"))
    return pairs.distinct(), found.where("other IS NULL").drop("other").distinct()


def linked_widely(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """a, b: links between classes among the rows of wide buckets."""
    rows = staged(dealt(rows, F.col("n_words"), CELL_WORDS, True), "dense")
    wanted = rows.select("id")

    def hashed(batches):
        _WORDS.own()
        for batch in batches:
            words = [word_hashes(words_of(text.as_py())).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], ["id", "words"])

    texts = maybe_in(texts_of(docs, id_col, text_col), "id", wanted).join(wanted, "id", "left_semi")
    words = texts.mapInArrow(hashed, "id long, words binary").groupBy("id").agg(F.min("words").alias("words"))
    words = words.withColumn("n", (F.octet_length("words") / 8).cast("long"))
    full = rows.join(words, "id").drop("n_words").withColumnRenamed("n", "n_words")
    return by_bucket(full, links_by_bucket(linked), "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose texts are similar."""

    def run(batches):
        _WORDS.own()
        for batch in batches:
            keep = [
                similar(word_hashes(words_of(x.as_py())), word_hashes(words_of(y.as_py())))
                for x, y in zip(batch.column(2), batch.column(3), strict=True)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    # Repeated ids: any row will do, for classes of ids are looked up by id.
    texts = maybe_in(texts_of(docs, id_col, text_col), "id", wanted)
    joined = pairs.join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a").join(
        texts.withColumnsRenamed({"id": "b", "text": "tb"}), "b"
    )
    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, class: the smallest id that an id of a link is connected with (ids that are smallest
    themselves are left out). Alternates large-star and small-star until all that is left are stars."""
    width = shuffle_width(links.sparkSession)

    def state(df):
        """Edges, and nodes that have several edges up, or edges up and down."""
        ends = df.select("u", F.lit(1).alias("up")).unionByName(df.select(F.col("v").alias("u"), F.lit(0).alias("up")))
        nodes = ends.groupBy("u").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
        unsettled = F.col("ups") > F.when(F.col("low") == 0, 0).otherwise(1)
        return nodes.agg(F.coalesce(F.sum("ups"), F.lit(0)), F.count(F.when(unsettled, 1))).first()

    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    count, unsettled = state(edges)
    while unsettled:
        tasks = min(width, 6 + count // EDGES)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = heavy_join(both.where("v > u"), least, "u", "n", 2 * count)
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().where("u <> v")
        large = staged(large.coalesce(tasks), "large_star")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = heavy_join(large, least, "u", "n", count)
        down = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = staged(down.where("u <> v").distinct().coalesce(tasks), "small_star")
        count, unsettled = state(edges)
    return edges.select(F.col("u").alias("id"), F.col("v").alias("class"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, class_id, class_size: one row for each row of docs."""
    found = staged(sketches(docs, id_col, text_col), "sketches")
    first = [F.first(c).alias(c) for c in ("n_words", "samples", "wide", "bits", "brief")]
    reps = staged(found.groupBy("digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), *first), "reps")
    links = staged(verified(staged(tried_first(reps), "pairs"), docs, id_col, text_col), "links")
    classes = staged(components(links), "classes")

    def labelled(rows):
        known = classes.withColumnRenamed("class", "of")
        return rows.join(known, "id", "left").withColumn("class", F.coalesce("of", "id")).drop("of")

    def joined(more):
        stars = classes.select(F.col("id").alias("a"), F.col("class").alias("b"))
        return staged(components(stars.unionByName(more)), "classes")

    pairs, rows = pairs_and_rows(labelled(reps))
    more = staged(verified(staged(pairs, "pairs"), docs, id_col, text_col), "wide_links")
    if not more.isEmpty():
        classes = joined(more)
    if not rows.isEmpty():
        more = staged(linked_widely(labelled(rows), docs, id_col, text_col), "wide_links")
        if not more.isEmpty():
            classes = joined(more)

    named = labelled(reps).select("digest", "copies", F.col("class").alias("class_id"))
    sizes = named.groupBy("class_id").agg(F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("n"))
    total = reps.count()
    named = staged(heavy_join(named, sizes, "class_id", "n", total).select("digest", "copies", "class_id", "class_size"), "named")
    out = heavy_join(found.select("id", "digest"), named, "digest", "copies", docs.count()).select("id", "class_id", "class_size")
    alone = docs.where(F.col(id_col).cast("long").isNull())
    null = F.lit(None).cast("long")
    return out.unionByName(alone.select(null.alias("id"), null.alias("class_id"), F.lit(1).cast("long").alias("class_size")))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are not the first of their class. Rows that repeat the id that
    stays are left; exact dedup takes those. Rows without an id are kept."""
    found = near_dedup(docs, id_col, text_col)
    name = free_name(docs, "gone")
    gone = staged(found.where("id <> class_id").select(F.col("id").alias(name)).distinct(), "gone")
    return docs.join(gone, docs[id_col].cast("long") == gone[name], "left_anti")


def op2(spark, sf_dir):
    return near_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
