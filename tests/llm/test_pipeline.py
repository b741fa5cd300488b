"""The pipeline against its stages by brute force, on the smallest tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from golode.llm import near_dedup, quality
from golode.llm.common import clear, staged, table
from golode.llm.encoding import encoder
from tests.llm.test_dedup import brute_classes

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = table(spark, SF, "documents")
    machine = quality.fit(docs, table(spark, SF, "labels"))
    kept = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect() if machine.scores(*quality.features([r["text"] or ""]))[0] >= 0.5]
    best: dict = {}
    for doc, text in kept:
        key = "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")
        if key not in best or len(text or "") > len(best[key][1] or ""):
            best[key] = (doc, text)
    left = sorted(best.values())
    classes = brute_classes([t for _, t in left])
    last = {left[i][0]: left[i][1] for i, c in enumerate(classes) if c == i}
    got = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg({"length": "sum"}).collect()
    enc = encoder("word_bpe_49k.json")
    assert {r[0]: r[1] for r in got} == {d: len(enc.encode(t or "")) // 4 + 1 for d, t in last.items()}


def test_stages_keep_columns(spark):
    docs = table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == table(spark, SF, "documents").columns
    assert near_dedup.near_dedup(docs).where("id <> class_id").count() == 0


def test_stages_on_awkward_tables(spark):
    """Nulls in every column, repeated rows, columns of the stages' own names, and no rows at all."""
    rows = [(i, "stone river and the hill by the sea " * (i % 4 + 1), "en", "s", 5) for i in range(30)]
    rows += [(None, None, None, None, None), (3, None, "en", None, None), (4, "", None, "s", 0), (5, "stone river and the hill by the sea", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(1) for c in ("gone", "id", "keep_id", "digest", "class_id", "score")})
    for table_ in (docs, docs.where("false")):
        kept = table_
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = staged(stage(spark, kept, SF), "stage")
            assert kept.columns == docs.columns
        packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
        assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
    clear(spark)


def test_fit_leaves_no_sample_on_the_driver(spark):
    def held():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(line.split()[1]) for line in f if line.startswith(("Pss_Anon", "Pss_Shmem"))) / 1024

    docs = spark.range(150).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 20000), x -> concat('w', x * 7919 + id))) AS text")
    labels = spark.range(150).selectExpr("id AS doc_id", "1 AS quality")
    quality.fit(docs.limit(2), labels)
    before = held()
    quality.fit(docs, labels)
    assert held() - before < 15
