import base64
import hashlib
import itertools
import random
import time
import zlib
from array import array
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from golode.llm import bpe, packing, token_files
from golode.llm.common import scratch, table
from golode.llm.encoding import encoder

TEXTS = [
    None, "", " ", "a", "a   b", "  x\n\n y \t z", "it's don't 'S we'll", "é éx İstanbul ΣΑΣ", "a\x1cb \x1c c", "<|endoftext|> x", "日本語 テキスト", "x  ", "\r\n a",
    "ABC,def. 123 4a5b", "a   b", "ß öÄ ÿ×÷ñ.. é!! x*** ÀÉ,", "aaaa" * 300, "word " * 3000, "a", "=" * 300,
]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "1 as id", "2 as start", "3 as ids")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = True
    for text in TEXTS:
        got = memoryview(encoder(name).encode(text or "")).cast("I").tolist()
        assert got == library.encode(text or "", add_special_tokens=False).ids, text


def test_words_are_kept_once_for_all_signs():
    enc = encoder("byte_bpe_50k.json")
    enc.kept.forget()
    enc.encode("one word, a word. a word\nword")
    assert " word" in enc.kept and not {" word,", " word."} & set(enc.kept)
    random.seed(4)
    marks = ["word", "été", "Été", "don't", "a1", "日本", " ", "  ", "\n", "\t", "\xa0", ",", ".", "...", "'s", "(", "\"", "_", "é", "–", "'", "\r\n", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(random.choices(marks, k=8))
        assert enc.encode(text) == array("I", enc.library.encode(text, add_special_tokens=False).ids).tobytes(), text


def test_pieces_met_again_are_not_encoded_again():
    enc = encoder("byte_bpe_50k.json")
    enc.kept.forget()
    words = ["".join(w) for w in itertools.islice(itertools.product("abcdefgh", repeat=6), 0, 120_000)]
    text = " ".join(words)
    first = enc.encode(text)
    make, calls = enc.kept.make, []
    enc.kept.make = lambda piece: calls.append(piece) or make(piece)
    try:
        assert enc.encode(text) == first and not calls
        for end in "xy":
            enc.encode(" ".join(w + end for w in words))
        assert len(calls) == 2 * len(words) and len(enc.kept) + len(enc.kept.old) < 2.5 * len(words)
    finally:
        enc.kept.make = make
        enc.kept.forget()


def test_words_of_the_word_vocabulary_are_kept_once():
    enc = encoder("word_bpe_49k.json")
    enc.kept.forget()
    enc.encode("one word, a Word. a word (wörd; wörd")
    assert {b"word", "wörd".encode()} <= set(enc.kept) and not {b"word,", b"word.", b"Word.", "wörd;".encode()} & set(enc.kept)
    random.seed(6)
    marks = ["word", "Word", "été", "É", "don't", "a1", "日本", "ā", "×", "÷", "J", "\u030c", "\u0338", "=", " ", "\n", "\xa0", "\x85", "\x1c", ",", ".", "'s", "'", "_", "İ", "Σ", "<|endoftext|>"]
    for _ in range(6000):
        text = "".join(random.choices(marks, k=7))
        assert enc.encode(text) == array("I", enc.library.encode(text, add_special_tokens=False).ids).tobytes(), text


def test_packing_is_exact(spark):
    random.seed(2)
    texts = TEXTS + [" ".join(random.choice("abcdefgh") for _ in range(random.randrange(3000))) for _ in range(60)]
    rows = packing.pack(docs_of(spark, texts), "word_bpe_49k.json").collect()
    enc = encoder("word_bpe_49k.json")
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for doc, pieces in by_doc.items():
        ids = enc.encode(texts[doc] or "") + (1).to_bytes(4, "little")
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) // 4
            at += p["length"]
            assert zlib.crc32(ids[4 * p["start"] : 4 * at]) == p["ids_crc32"]
        assert at == len(ids) // 4
    lengths = []
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and {p["sequence_length"] for p in pieces} == {at}
        lengths.append(at)
    assert packing.padding(lengths) <= 2048 * spark.sparkContext.defaultParallelism
    groups: dict = {}
    for pieces in by_sequence.values():
        groups.setdefault(pieces[0]["step_group"], set()).add(pieces[0]["tier"])
    assert all(len(t) == 1 for t in groups.values())


def test_packing_pool_is_bounded():
    docs = ((i, bytes(4 * n)) for i, n in enumerate([300, 700, 5000, 20, 2048, 1] * 200))
    seqs = list(packing.sequences(docs, pool_size=16))
    assert sum(len(p) for s in seqs for p in s) == (300 + 700 + 5000 + 20 + 2048 + 1) * 200
    full = [sum(map(len, s)) for s in seqs]
    assert sum(n not in packing.TIERS for n in full) <= 1


def test_empty_tables(spark):
    none = docs_of(spark, [""]).where("false")
    assert packing.pack(none, "word_bpe_49k.json").count() == 0
    path = scratch(spark, "none")
    token_files.write(token_files.tokenised(none, "byte_bpe_50k.json"), path)
    assert token_files.starts(token_files.read(spark, path)).count() == 0
    assert bpe.digests(none, "byte_bpe_multi_50k.tiktoken").count() == 0


def test_token_files(spark):
    path = scratch(spark, "tokens")
    token_files.write(token_files.tokenised(docs_of(spark, TEXTS), "byte_bpe_50k.json"), path)
    enc, at = encoder("byte_bpe_50k.json"), 0
    got = {r["doc_id"]: r for r in token_files.starts(token_files.read(spark, path)).collect()}
    for doc, text in enumerate(TEXTS):
        ids = enc.encode(text or "") + (2).to_bytes(4, "little")
        r = got[doc]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    found = token_files.lookup(spark, path, [7])
    assert found.count() == 1 and "doc_id" in found._jdf.queryExecution().executedPlan().toString()


def reference_encoding():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def test_long_words_equal_tiktoken():
    """One word of thousands of letters: random, of one letter, in periods; in time that follows its length."""
    library, codec = reference_encoding(), bpe.codec("byte_bpe_multi_50k.tiktoken", public_tokenizers.PATTERN)
    random.seed(9)
    mixed = lambda letters, n: "".join(random.choice(letters) for _ in range(n))
    words = [mixed("ab", 700), mixed("aeé", 900), "ab" * 3000, "abcab" * 1500, "é" * 4000, "=" * 3000, mixed("nrst", 2000)]
    words += [mixed("abcdefghijklmnopqrstuvwxyz", n) for n in (65, 66, 130, 1000)]
    for word, ids in zip(words, codec.encode_all(words), strict=True):
        assert memoryview(ids).cast("I").tolist() == library.encode_ordinary(word), word[:20]
    long = mixed("abcdefghijklmnopqrstuvwxyz", 20_000)
    began = time.process_time()
    (ids,) = codec.encode_all([long])
    assert time.process_time() - began < 20
    assert memoryview(ids).cast("I").tolist() == library.encode_ordinary(long)


def test_op3_equals_tiktoken(spark, tmp_path):
    """The query as it is registered, with nulls, repeated rows and columns of its own names."""
    library = reference_encoding()
    docs = docs_of(spark, TEXTS).selectExpr("*", "4 as n_tokens", "5 as ids_sha256")
    docs.unionByName(docs.where("doc_id > 3")).unionByName(docs.limit(1).selectExpr("cast(null as long) as doc_id", "'x y' as text", "id", "start", "ids", "n_tokens", "ids_sha256")).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in bpe.op3(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    want: Counter = Counter()
    for doc, text in [*enumerate(TEXTS), (None, "x y")]:
        ids = library.encode_ordinary(text or "")
        want[doc, len(ids), sha(array("I", ids).tobytes()), sha((text or "").encode())] += 2 if doc is not None and doc > 3 else 1
    assert got == want


SF = "/root/testdata/sf0.001"


def whole_documents(spark):
    return [(r["doc_id"], r["text"] or "") for r in table(spark, SF, "documents").select("doc_id", "text").collect()]


def test_op3_over_the_whole_table(spark):
    library = reference_encoding()
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.op3(spark, SF).collect()}
    want = {}
    for doc, text in whole_documents(spark):
        ids = library.encode_ordinary(text)
        want[doc] = len(ids), sha(array("I", ids).tobytes()), sha(text.encode())
    assert got == want


def library_ids(name, text, end):
    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = True
    return array("I", [*library.encode(text, add_special_tokens=False).ids, end]).tobytes()


def test_op4_over_the_whole_table(spark):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.op4(spark, SF).collect()}
    at, want = 0, {}
    for doc, text in sorted(whole_documents(spark)):
        ids = library_ids("byte_bpe_50k.json", text, 2)
        want[doc] = at, len(ids) // 4, zlib.crc32(ids)
        at += len(ids) // 4
    assert got == want


def test_op1_over_the_whole_table(spark):
    rows = packing.op1(spark, SF).collect()
    pieces: dict = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
    texts = dict(whole_documents(spark))
    assert pieces.keys() == texts.keys()
    for doc, text in texts.items():
        ids, at = library_ids("word_bpe_49k.json", text, 1), 0
        for r in sorted(pieces[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) // 4 and r["ids_crc32"] == zlib.crc32(ids[4 * at : 4 * (at + r["length"])])
            at += r["length"]
        assert at == len(ids) // 4


def test_repeated_ids_keep_the_order_of_the_file(spark):
    """Each row is packed and written by itself; starts follow the rows of the files."""
    texts = ["b " * 9, "a", "c d e f", "x y", "q " * 5, "", "a"]
    df = spark.createDataFrame([(None if i == 6 else i // 5, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert packing.pack(df, "word_bpe_49k.json").selectExpr("sum(length)").first()[0] == sum(len(library_ids("word_bpe_49k.json", t, 1)) // 4 for t in texts)
    path = scratch(spark, "tokens")
    token_files.write(token_files.tokenised(df, "byte_bpe_50k.json"), path)
    kept = [(r["file"], r["row"], r["doc_id"], list(r["ids"])) for r in token_files.read(spark, path).collect()]
    kept.sort(key=lambda r: (r[2] is not None, r[2] or 0, r[0], r[1]))
    at, want = 0, []
    for _, _, doc, ids in kept:
        want.append((doc, at, len(ids), zlib.crc32(array("I", ids).tobytes())))
        at += len(ids)
    got = [tuple(r) for r in token_files.starts(token_files.read(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert sorted(got, key=lambda r: r[1]) == want and len(want) == len(texts)


def test_lookups_skip_stripes(spark, tmp_path):
    """The file itself has run-length encoded ids, a row index and a Bloom filter on doc_id."""
    path = f"{tmp_path}/tokens"
    token_files.write(token_files.tokenised(spark.range(5000).selectExpr("id AS doc_id", "concat('w ', id) AS text"), "byte_bpe_50k.json"), path)
    found = token_files.lookup(spark, path, [7, 4999])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 2 and "PushedFilters: [In(doc_id" in plan
    from pyarrow import orc

    kinds = [orc.ORCFile(str(f)) for f in (tmp_path / "tokens").glob("part-*.orc")]
    assert sum(f.nrows for f in kinds) == 5000 and all(f.compression == "ZSTD" and f.row_index_stride == 1000 for f in kinds)


def test_step_groups_are_level():
    """Groups of a tier have about the same attention cost, and each has GROUP sequences but the last."""
    rng = random.Random(3)
    groups, held = packing.StepGroups(0), {}
    dealt = []
    for _ in range(400):
        cuts = sorted(rng.sample(range(1, 2048), rng.randrange(1, 9)))
        seq = [bytes(b - a) for a, b in zip([0, *cuts], [*cuts, 2048], strict=True)]
        dealt += groups.add(2048, seq)
    for _, seq, group in [*dealt, *groups.rest()]:
        held.setdefault(group, []).append(sum(len(p) ** 2 for p in seq))
    assert sum(map(len, held.values())) == 400 and {len(v) for v in held.values()} == {packing.GROUP}
    single = [c for v in held.values() for c in v]
    pairs = sorted(held)
    for a, b in zip(pairs[::2], pairs[1::2], strict=True):
        assert abs(sum(held[a]) - sum(held[b])) <= max(single)


def test_bpe_equals_tiktoken(spark):
    library = reference_encoding()
    random.seed(4)
    texts = [t or "" for t in TEXTS] + ["".join(random.choice("abcdé ") for _ in range(150)) for _ in range(20)] + ["".join(random.choice("ab") for _ in range(200))]
    codec = bpe.codec("byte_bpe_multi_50k.tiktoken", public_tokenizers.PATTERN)
    coded = codec.encode_all(texts)
    for text, ids, back in zip(texts, coded, codec.expand(coded), strict=True):
        assert memoryview(ids).cast("I").tolist() == library.encode_ordinary(text), text
        assert back == text.encode()
    coded = bpe.encode(docs_of(spark, texts), "byte_bpe_multi_50k.tiktoken")
    decoded = {r["id"]: bytes(r["bytes"]) for r in bpe.decode(coded, "byte_bpe_multi_50k.tiktoken").collect()}
    assert decoded == {i: t.encode() for i, t in enumerate(texts)}


def test_byte_bpe_keeps_a_word_once_for_all_signs():
    """Words are not kept again for each sign after them, and are asked for once."""
    codec, library = bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN), reference_encoding()
    words = ["".join(w) for w in itertools.islice(itertools.product("abcdefgh", repeat=5), 0, 3000)]
    codec.encode_all([" ".join(w + sign for w in words) for sign in (",", ".", ";", "")])
    assert sum(len(x.young) for x in vars(codec).values() if isinstance(x, bpe.Kept)) < 1.1 * len(words)
    random.seed(8)
    marks = ["word", "été", "don't", "'sand", "a1", "日本", "ā", "×", " ", "  ", "\n", "\t", "\xa0", "\x1c", ",", ".", "...", "'s", "'", "(", "_", "–", "\r\n", "İ"]
    texts = ["".join(random.choices(marks, k=8)) for _ in range(6000)]
    for text, ids in zip(texts, codec.encode_all(texts), strict=True):
        assert memoryview(ids).cast("I").tolist() == library.encode_ordinary(text), text
    turned = bpe.Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    turned.kept.most = 20_000
    for lo in range(0, 6000, 500):
        for text, ids in zip(texts[lo : lo + 500], turned.encode_all(texts[lo : lo + 500]), strict=True):
            assert memoryview(ids).cast("I").tolist() == library.encode_ordinary(text), text
    assert turned.kept.old and len(turned.kept.young) + len(turned.kept.old) < len(codec.kept.young)


def test_every_token_decodes():
    codec = bpe.codec("byte_bpe_multi_50k.tiktoken", public_tokenizers.PATTERN)
    assert codec.expand([i.to_bytes(4, "little") for i in codec.ranks.values()]) == list(codec.ranks)
    assert codec.expand([array("i", [-1, -2, 2**31 - 1, -(2**31), max(codec.ranks.values()) + 1]).tobytes(), b""]) == [b"", b""]


def test_token_files_hand_ids_over_in_portions():
    """A task does not hold the ids of a whole batch: rows go on in portions, numbered over all batches."""
    texts = [f"text {i} " + "some words, " * 30_000 for i in range(9)] + [""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(texts)], ["doc_id", "text"])
    got = list(token_files.in_portions([batch, batch], encoder("byte_bpe_50k.json"), 2))
    assert len(got) > 6 and max(b.num_rows for b in got) <= 3
    rows = [r for b in got for r in b.to_pylist()]
    assert [(r["doc_id"], r["row"]) for r in rows] == [(i % 10, i) for i in range(20)]
    for r, text in zip(rows, texts + texts, strict=True):
        ids = array("I", r["ids"]).tobytes()
        assert r["n_tokens"] == len(r["ids"]) and ids == encoder("byte_bpe_50k.json").encode(text) + (2).to_bytes(4, "little")


def test_texts_together_equal_the_library(monkeypatch):
    """Words go to the library in a row with others, each once; the ids of each text are the library's."""
    enc = encoder("byte_bpe_50k.json")
    enc.kept.forget()
    random.seed(6)
    marks = ["word", "été", "don't", "a1", "日本", " ", " ", " ", "  ", "\n", "\t", "\xa0", "\u2003", "\x1c", ",", "...", "'s", "\"", "é", "–", "\r\n", "<|endoftext|>", "Ġ", "ÿ×"]
    made = ["".join(random.choices("abcdefgé", k=6)) for _ in range(5000)]
    texts = ["".join(random.choices(marks, k=random.randrange(12))) for _ in range(3000)] + [" ".join(made)] + [t or "" for t in TEXTS]
    end = (2).to_bytes(4, "little")
    want = [[*enc.library.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    asked, ask = [], enc._after_blanks
    monkeypatch.setattr(enc, "_after_blanks", lambda words: asked.append(len(words)) or ask(words))
    assert [enc.encode_all(texts, end).to_pylist() for _ in range(2)] == [want, want] and asked[0] > 4000 and asked[1] == 0
    monkeypatch.setattr("golode.llm.encoding.LIST_BYTES", 0)
    for part in (texts[:1000], texts[1000:], texts):
        got = enc.encode_all(part, end).to_pylist()
        assert got == (want if part is texts else want[:1000] if len(part) == 1000 else want[1000:])
        assert len(enc.kept.lists[0]) <= len({w for t in part for w in t.split(" ")} | {""})
    assert enc.encode_all([], end).to_pylist() == []
