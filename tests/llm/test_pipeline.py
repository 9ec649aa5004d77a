import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from loomery.llm import decontaminate, source_mixing, toxicity
from test_near_join import brute as near_brute
from test_token_store import reference

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard", "decontaminate", "source_mixing", "token_store"]
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())

    one = stage["toxicity"](spark, docs, SF)
    rejected = {r.doc_id for r in toxicity.classify(docs, labels).where("predicted = 1").collect()}
    assert one.columns == docs.columns and ids(one) == [i for i in ids(docs) if i not in rejected]

    rows = [(r.doc_id, r.text) for r in one.collect()]
    two = stage["ngram_jaccard"](spark, one, SF)
    assert two.columns == docs.columns and ids(two) == sorted(i for i, (_, c) in near_brute(rows).items() if i == c)

    three = stage["decontaminate"](spark, two, SF)
    leaks = {r.doc_id for r in decontaminate.matches(two, bench).collect()}
    assert three.columns == docs.columns and ids(three) == [i for i in ids(two) if i not in leaks]

    four = stage["source_mixing"](spark, three, SF)
    drawn = {r.doc_id: r.copies for r in source_mixing.mix(three).collect()}
    assert four.columns == docs.columns and ids(four) == sorted(i for i, n in drawn.items() for _ in range(n))

    texts = sorted((r.doc_id, r.text) for r in four.collect())
    want, start = [], 0
    for (i, _), tokens in zip(texts, reference([t for _, t in texts]), strict=True):
        want.append((i, start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes())))
        start += len(tokens)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=lambda r: r[1]) == want
    assert docs.withColumn("copies", F.lit(9)).columns == stage["source_mixing"](spark, docs.withColumn("copies", F.lit(9)), SF).columns


def test_stages_on_edge_rows(spark, tmp_path):
    """Null, empty, repeated and very long texts, null ids and sources, clashing names, and empty tables."""
    fine = "the quick brown fox jumps over a lazy dog near the old stone bridge at dawn"
    rows = [(1, fine, "en", "a", 1, 0), (1, fine, "en", "a", 1, 0), (2, "", None, None, None, 1), (3, None, "en", "b", 0, 2), (None, "no id but words enough to be kept by all", "en", "b", 0, 3), (5, "w x y z " * 50_000, "de", "c", 9, 4), (6, fine.upper(), "en", None, 1, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies int")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    stage = dict(corpus_pipeline.STAGES)
    d = stage["toxicity"](spark, docs, str(tmp_path))
    assert d.columns == docs.columns and d.count() == len(rows)
    d = stage["ngram_jaccard"](spark, d, str(tmp_path))
    assert d.columns == docs.columns and sorted(str(r.doc_id) for r in d.collect()) == sorted(["1", "2", "3", "None", "5"])
    d = stage["decontaminate"](spark, d, str(tmp_path))
    assert d.count() == 5
    d = stage["source_mixing"](spark, d, str(tmp_path))
    assert d.columns == docs.columns and d.count() >= 1
    out = stage["token_store"](spark, d, str(tmp_path)).collect()
    assert len(out) == d.count()
    empty = docs.limit(0)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, str(tmp_path)).count() == 0, name
