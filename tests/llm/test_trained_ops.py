import math
import re
import zlib

import numpy as np
import pytest

from loomery.llm import bytescan, quality, toxicity

SF = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, source string, score string, y int, f double"
EDGE = [(1, "", "a", "x", 1, 0.0), (2, None, None, None, None, None), (2, None, None, None, None, None), (None, "You idiot! Fine day.", "b", "z", 3, 1.0), (5, "wort " * 200000, "b", "z", 3, 1.0)]


def accuracy(rows, truth):
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    right = sum(p == t for p, t in held)
    of1 = [p for p, t in held if t == 1]
    of0 = [p for p, t in held if t == 0]
    return right / len(held), sum(of1) / len(of1), 1 - sum(of0) / len(of0)


@pytest.mark.parametrize("module,column", [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_accuracy(spark, module, column):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = module.classify(docs, labels).collect()
    assert len(rows) == docs.count()
    got = accuracy(rows, {r.doc_id: r[column] for r in labels.collect()})
    print(column, got)
    assert min(got) > 0.85, got
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_edges(spark, module):
    docs = spark.createDataFrame(EDGE, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(30)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    assert len(module.classify(docs, labels).collect()) == len(EDGE)
    assert {r.score for r in module.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert module.classify(docs.limit(0), labels).count() == 0


def test_offending_sentences(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    mine = spark.createDataFrame([(1, "A fine day. You are a stupid idiot and pathetic scum! More of it."), (2, "A fine day.")], "doc_id long, text string")
    got = toxicity.offending(mine, model).collect()
    assert [(r.doc_id, r.sentence) for r in got] == [(1, "You are a stupid idiot and pathetic scum")]
    assert [r.doc_id for r in toxicity.clean(docs, labels).limit(3).collect()] and toxicity.clean(docs, labels).columns == docs.columns


def test_toxicity_scores_match_brute_force(spark):
    """Scores and places of sentences by plain loops over characters and words."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    weight = {}

    def weigh(word):
        raw = np.frombuffer(word, np.uint8)
        if word not in weight:
            with np.errstate(over="ignore"):
                h = bytescan.run_hashes(raw, np.array([0]), np.array([len(raw)]))
            weight[word] = float(model.weights[int(h[0] >> np.uint64(64 - toxicity.BITS))])
        return weight[word]

    def slow(text):
        clean, places, at = math.log1p(math.exp(model.leak)), [], 0
        for piece in re.split("([.!?\n]+)", text or ""):
            if piece and piece[0] not in ".!?\n":
                words = re.findall(rb"[A-Za-z\x80-\xff]+", piece.encode())
                found = [w for x in words for w in (weigh(x.lower()), *(weigh(x.lower()[:k]) for k in toxicity.STEMS if len(x) > k)) if w]
                if found:
                    z = sum(found) + model.bias
                    clean += max(z, 0) + math.log1p(math.exp(-abs(z)))
                    if z >= 0:
                        places.append(f"{at}:{at + len(piece)}")
            at += len(piece)
        return -math.expm1(-clean), ",".join(places)

    texts = [r.text for r in docs.orderBy("doc_id").limit(400).collect()] + ["", None, "ü. You idiot scum!! é pathetic\nx", "You are a stupid idiot and pathetic scum"]
    rows = toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    assert len(rows) == len(texts)
    for r in rows:
        score, places = slow(texts[r.doc_id])
        assert abs(score - r.score) < 1e-4 and r.offending == places and r.n_offending == len(list(filter(None, places.split(",")))), r.doc_id


def test_quality_scores_match_brute_force(spark):
    """The discriminant from the same features by numpy alone, with explicit inverses and determinants."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    taught = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1}
    f = {r.doc_id: np.array(r.f) for r in quality.features(docs).collect()}
    d = len(quality.NAMES)
    parts = [np.array([f[i] for i, y in taught.items() if y == c and i in f]) for c in (0, 1)]
    scatter = [(x - x.mean(0)).T @ (x - x.mean(0)) for x in parts]
    pooled = sum(scatter) / (sum(map(len, parts)) - 2)
    density = []
    for x, s in zip(parts, scatter):
        cov = (1 - quality.POOLED) * s / (len(x) - 1) + quality.POOLED * pooled
        cov = (1 - quality.ROUND) * cov + quality.ROUND * np.trace(cov) / d * np.eye(d)
        inverse, logdet = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
        density.append(lambda v, m=x.mean(0), k=inverse, c=logdet, n=len(x): -((v - m) @ k @ (v - m)) / 2 - c / 2 + math.log(n))
    for r in quality.classify(docs, labels).collect()[::7]:
        want = 1 / (1 + math.exp(-max(-500, min(500, density[1](f[r.doc_id]) - density[0](f[r.doc_id])))))
        assert abs(want - r.score) < 1e-6, r.doc_id


def test_many_neutral_sentences_are_clean(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    long = [(1, "A fine day. " * 20000), (2, "x\n" * 20000), (3, "A fine day."), (4, "A fine day. " * 10000 + "You are a stupid idiot and pathetic scum! " + "A fine day. " * 10000), (5, None)]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(long, "doc_id long, text string"), model).collect()}
    assert got[1] == got[2] == got[3] == got[5] < 0.5 and got[4] >= toxicity.THRESHOLD
