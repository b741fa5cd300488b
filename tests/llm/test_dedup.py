import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from golode.llm import common, exact_dedup, near_dedup


def docs_of(spark, texts, **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def test_exact_cases(spark):
    texts = ["a b", "ab", " a\tb ", None, "", "x" * 50_000, "ab", "é", "é"] + ["same"] * 300
    got = {r["id"]: r for r in exact_dedup.exact_dedup(docs_of(spark, texts, keep_id=9, digest="x"), counters=4).collect()}
    assert len(got) == len(texts)
    assert {got[i]["keep_id"] for i in (0, 1, 2, 6)} == {2} and got[2]["kept"] and got[0]["group_size"] == 4
    assert got[3]["keep_id"] == got[4]["keep_id"] == 3 and got[7]["kept"] and got[8]["kept"]
    assert {got[i]["keep_id"] for i in range(9, 309)} == {9} and got[9]["group_size"] == 300


def test_exact_empty_and_repeated(spark):
    assert exact_dedup.exact_dedup(docs_of(spark, []).where("false")).count() == 0
    twice = docs_of(spark, ["a", "b"]).union(docs_of(spark, ["a", "b"]))
    assert exact_dedup.exact_dedup(twice).where("group_size = 2").count() == 4
    assert exact_dedup.keep_one_each(twice).count() == 2
    assert sorted(r["doc_id"] for r in exact_dedup.keep_one_each(docs_of(spark, ["a", " a", "b"])).collect()) == [1, 2]


def test_summary_bound():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    values = [bytes([v]) for v in np.where(rng.random(4000) < 0.3, 7, rng.integers(0, 200, 4000))]
    batches = [pa.RecordBatch.from_arrays([pa.array(values[i : i + 500], pa.binary())], ["d"]) for i in range(0, 4000, 500)]
    held = exact_dedup.summarise(batches, 9)
    true = values.count(b"\x07")
    assert len(held) <= 9 and true - 4000 / 10 <= held[b"\x07"] <= true


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
    return row[-1]


def alike(a: list[str], b: list[str]) -> bool:
    """Similar by a plain table over the words themselves; words that one lacks are edits at least."""
    if a == b:
        return True
    most = max(len(a), len(b)) // 5
    if min(len(a), len(b)) < 5 or max(len(a), len(b)) - sum((Counter(a) & Counter(b)).values()) > most:
        return False
    return distance(a, b) <= most


def brute_classes(texts):
    words = [(t or "").lower().split() for t in texts]
    of = list(range(len(texts)))

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, k in itertools.combinations(range(len(texts)), 2):
        if root(i) != root(k) and alike(words[i], words[k]):
            a, b = sorted((root(i), root(k)))
            of[b] = a
    return [root(i) for i in range(len(texts))]


def corpus():
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 7)))
    passage = [word() for _ in range(40)]
    texts = [" ".join(word() for _ in range(int(rng.integers(60, 200)))) for _ in range(20)]
    for base in range(6):
        for _ in range(5):
            ws = texts[base].split()
            for at in rng.integers(0, len(ws), max(1, len(ws) // 40)):
                ws[at] = word()
            texts.append(" ".join(ws))
    texts += [" ".join([word() for _ in range(80)] + passage) for _ in range(15)]
    return texts + [texts[0]] * 10 + ["", None, "  ", "few words", "few  WORDS", "few words more"]


def test_near_matches_brute_force(spark):
    texts = corpus()
    got = {r["id"]: r["class_id"] for r in near_dedup.near_dedup(docs_of(spark, texts, class_id=1, samples=2, digest=3)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


@pytest.mark.parametrize(("block", "words"), [(4, 2_000_000), (8000, 300), (3, 500)])
def test_large_buckets_are_split(spark, monkeypatch, block, words):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "CELL_WORDS", words)
    texts = corpus()
    got = {r["id"]: r["class_id"] for r in near_dedup.near_dedup(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


@pytest.mark.parametrize(("block", "words"), [(8000, 250_000), (4, 300)])
def test_buckets_of_many_open_pairs(spark, monkeypatch, block, words):
    monkeypatch.setattr(near_dedup, "SPARSE", 0)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "CELL_WORDS", words)
    texts = corpus()
    got = {r["id"]: r["class_id"] for r in near_dedup.near_dedup(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


@pytest.mark.parametrize("n", [100, 400])
def test_one_text_beside_a_large_class_costs_in_proportion(spark, n):
    rows = spark.range(n + 1).selectExpr("1L AS bucket", f"if(id = {n}, 1L, 0L) AS class", "id", "400L AS n_words")
    parts = near_dedup.dealt(rows, F.lit(1), 10, True).collect()
    assert len(parts) <= n + n / 10 + 1
    met = {}
    for r in parts:
        met.setdefault(r["bucket"], []).append((r["id"], r["cell"]))
    lone = [(i, c, j, d) for m in met.values() for i, c in m if i == n for j, d in m if j != n]
    assert {j for _, _, j, _ in lone} == set(range(n)) and all(c != d for _, c, _, d in lone)
    bits = near_dedup.word_bits(np.arange(400, dtype=np.uint64))
    reps = rows.select("class", "id", "n_words", F.array("bucket").alias("wide"), F.lit(bits).alias("bits"))
    pairs, dense = near_dedup.pairs_and_rows(reps)
    assert {tuple(r) for r in pairs.collect()} == {(n, i) for i in range(n)} and dense.isEmpty()


def scattered(words, share, rng):
    out = list(words)
    for at in rng.choice(len(out), int(share * len(out)), replace=False):
        out[at] = f"new{rng.integers(1 << 40)}"
    return out


def hashed(words):
    return near_dedup.word_hashes(near_dedup.words_of(" ".join(words)))


#: The least share of 200 pairs met over all lengths, by edited share of the words, as measured.
RECALL = {0.05: 1.0, 0.10: 1.0, 0.15: 0.985, 0.18: 0.975, 0.20: 0.97}


@pytest.mark.parametrize("share", RECALL)
def test_recall_of_scattered_edits(share):
    """Against all pairs of a text and its edited copy: in one bucket, and left by the bounds."""
    rng = np.random.default_rng(4)
    for n in (10, 20, 40, 60, 80, 100, 300, 1000):
        met = 0
        for _ in range(200):
            plain = [f"w{x}" for x in rng.integers(0, 1 << 40, n)]
            edited = scattered(plain, share, rng)
            assert alike(plain, edited) if n <= 100 else True
            a, b = hashed(plain), hashed(edited)
            assert near_dedup.similar(a, b)
            rows = pa.table({"class": [0, 1], "cell": [0, 0], "n_words": [n, n], "bits": [near_dedup.word_bits(x) for x in (a, b)]})
            assert near_dedup.contested(rows).all()
            met += bool(np.isin(near_dedup.sketch(a)[1], near_dedup.sketch(b)[1]).any())
        assert met >= RECALL[share] * 200, (n, met)


def test_bounds_never_lose_a_similar_pair():
    """Few different words, repeated often, of lengths around the steps of the bits."""
    rng = np.random.default_rng(5)
    for n in (6, 40, 400, 511, 513, 620, 1100):
        for _ in range(20):
            a = [f"w{x}" for x in rng.integers(0, 40, n)]
            b = list(a)
            for _ in range(int(0.1 * n)):
                at = int(rng.integers(0, len(b) + 1))
                b[at : at + int(rng.integers(0, 2))] = ["x"] * int(rng.integers(0, 2))
            sizes = [len(a), len(b)]
            ha, hb = hashed(a), hashed(b)
            rows = pa.table({"class": [0, 1], "cell": [0, 0], "n_words": sizes, "bits": [near_dedup.word_bits(x) for x in (ha, hb)]})
            full = pa.table({"class": [0, 1], "cell": [0, 0], "id": [7, 9], "n_words": sizes, "words": [x.tobytes() for x in (ha, hb)]})
            if near_dedup.similar(ha, hb):
                assert near_dedup.contested(rows).all()
                assert sorted(sum(near_dedup.linked(full), [])) == [7, 9]
            else:
                assert near_dedup.linked(full) == ([], [])


def test_words_of_colliding_checksums_differ(spark):
    texts = ["plumless " * 30, "buckeroo " * 30]
    assert {r["class_id"] for r in near_dedup.near_dedup(docs_of(spark, texts)).collect()} == {0, 1}


def test_near_nulls_repeats_and_names(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, "a b c d e f"), (None, None), (3, "a b c d e f"), (3, "a b c d e f"), (4, long), (5, long + " end"), (6, None), (7, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("gone", "id", "class", "bucket", "digest", "copies")})
    got = sorted(tuple(-1 if v is None else v for v in r) for r in near_dedup.near_dedup(df).collect())
    assert got == [(-1, -1, 1), (-1, -1, 1), (3, 3, 2), (3, 3, 2), (4, 4, 2), (5, 4, 2), (6, 6, 2), (7, 6, 2)]
    kept = near_dedup.keep_one_each(df)
    assert kept.columns == df.columns and sorted(-1 if r[0] is None else r[0] for r in kept.collect()) == [-1, -1, 3, 3, 4, 6]


def test_frequent_keys_are_joined_apart(spark):
    many = spark.range(2000).selectExpr("id", "if(id < 900, 1, id) AS k")
    few = many.groupBy("k").count()
    got = common.heavy_join(many, few, "k", "count", 2000)
    assert got.count() == 2000 and got.where("k = 1 AND count = 900").count() == 900
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()


def test_kept_results_are_bounded(monkeypatch):
    monkeypatch.setattr(common, "KEPT_BYTES", 20_000)
    kept, other = common.Kept(str.encode), common.Kept(str.encode)
    other["a"] = b"a"
    kept.own()
    assert not other
    for i in range(5000):
        assert kept[f"w{i % 700}"] == f"w{i % 700}".encode() and len(kept) + len(kept.old) < 110


@pytest.mark.parametrize("block", [5, 8000])
def test_scattered_edits_and_a_common_passage(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = np.random.default_rng(6)
    passage = [f"p{i}" for i in range(75)]
    texts = []
    for share in (0.08, 0.12, 0.16, 0.2):
        for k in range(4):
            base = [f"w{x}" for x in rng.integers(0, 1 << 40, 150)]
            texts += [" ".join(base), " ".join(scattered(base, share, rng))]
            own = [f"v{x}" for x in rng.integers(0, 1 << 40, 25)]
            texts += [" ".join(passage + own), " ".join(passage + scattered(own, 2 * share, rng))]
    got = {r["id"]: r["class_id"] for r in near_dedup.near_dedup(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_near_empty(spark):
    assert near_dedup.near_dedup(docs_of(spark, []).where("false")).count() == 0


def test_banded_alignment():
    rng = np.random.default_rng(1)
    for _ in range(600):
        a = rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint64)
        b = a.tolist()
        for _ in range(rng.integers(0, 8)):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + int(rng.integers(0, 2))] = rng.integers(0, 6, int(rng.integers(0, 2))).tolist()
        b = np.array(b, np.uint64)
        assert near_dedup.similar(a, b) == (distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9))


@pytest.mark.parametrize("n", [2, 7, 40])
def test_components_of_a_chain(spark, n):
    links = spark.createDataFrame([(i + 1, i) for i in range(n)], "a long, b long")
    assert {tuple(r) for r in near_dedup.components(links).collect()} == {(i, 0) for i in range(1, n + 1)}


def test_rows_without_a_partner_are_not_dealt(spark):
    rows = spark.range(4000).selectExpr("if(id < 40, id % 20, id) AS bucket", "id % 2 AS class", "id", "40L AS n_words")
    for all_pairs, together in ((False, set(range(40))), (True, set())):
        got = {r["id"] for r in near_dedup.dealt(rows, F.lit(1), 10, all_pairs).collect()}
        assert together <= got and len(got) < 400
    assert common.maybe_in(rows, "id", rows.where("id < 0").select("id")).isEmpty()
    some = rows.where("id % 10 = 3").select((F.col("id") - 2000).alias("id"))
    got = {r["id"] for r in common.maybe_in(rows.select((F.col("id") - 2000).alias("id"), F.lit(1).alias("filter")), "id", some).collect()}
    assert {r["id"] for r in some.collect()} <= got and len(got) < 800


def test_components_stop_at_stars(spark, monkeypatch):
    names = []
    real = near_dedup.staged
    monkeypatch.setattr(near_dedup, "staged", lambda df, name: names.append(name) or real(df, name))
    star = spark.createDataFrame([(i, 0) for i in range(1, 9)] + [(i, 20) for i in (21, 22)], "a long, b long")
    assert {tuple(r) for r in near_dedup.components(star).collect()} == {tuple(r) for r in star.collect()}
    assert names == ["edges"]
    links = [(i, i + 1) for i in range(0, 60)] + [(70, 70), (80, 90), (85, 90), (85, 99)]
    got = near_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {tuple(r) for r in got} == {(i, 0) for i in range(1, 61)} | {(i, 80) for i in (85, 90, 99)}
