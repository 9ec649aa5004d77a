import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loomery.llm import bytescan
from loomery.llm import decontaminate as D


def slow(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (D.MATCH if x == y else D.MISMATCH), h[i - 1][j] - D.GAP, h[i][j - 1] - D.GAP)
    return max(max(r) for r in h)


def test_alignment_matches_brute_force():
    rng = np.random.default_rng(3)
    a, b = rng.integers(1, 5, (40, 9)).astype(np.uint64), rng.integers(1, 5, (40, 14)).astype(np.uint64)
    na, nb = rng.integers(1, 10, 40), rng.integers(1, 15, 40)
    best, _ = D.align(a, na, b, nb)
    assert best.tolist() == [slow(x[:n], y[:m]) for x, n, y, m in zip(a, na, b, nb)]


def test_finds_copies_and_edits_only(spark):
    rng = random.Random(9)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(4000)]
    say = lambda n: [rng.choice(pool) for _ in range(n)]
    items = [(i, say(rng.randint(14, 50))) for i in range(12)] + [(90, say(2)), (91, []), (92, None)]
    docs, want = [], set()
    for i, w in items[:12]:
        docs.append((len(docs), " ".join(say(60) + w + say(80))))
        want.add((docs[-1][0], i))
        edited = list(w)
        for k in rng.sample(range(len(w)), len(w) // 7):
            edited[k] = "new"
        del edited[len(w) // 2]
        docs.append((len(docs), " ".join(say(9) + edited).upper()))
        want.add((docs[-1][0], i))
        docs.append((len(docs), " ".join(say(150) + w[: len(w) // 4])))
    docs += [(500, ""), (501, None), (502, " ".join(items[0][1] * 40)), (502, " ".join(items[0][1] * 40)), (None, "x y z")]
    want.add((502, 0))
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(i, w and " ".join(w), 1.0) for i, w in items], "item_id long, text string, score double")
    for block in (D.BLOCK_ITEMS, 5):
        got = D.matches(d, b, block=block).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    assert D.matches(d.limit(0), b).count() == 0 and D.matches(d, b.limit(0)).count() == 0
    assert D.clean(d, b).columns == d.columns
    assert {r.doc_id for r in D.clean(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_whole_items_in_documents_are_found(spark, sf_dir):
    sf = "/root/testdata/sf0.1"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in D.matches(docs, bench).collect()}
    texts = [(r.doc_id, " ".join(r.text.lower().split())) for r in docs.collect()]
    exact = {(i, b.item_id) for b in bench.collect() for i, t in texts if " ".join(b.text.lower().split()) in t}
    assert exact and exact <= got


def test_every_pair_against_full_alignment(spark):
    """All documents and items of the small table by plain alignment of whole texts: nothing lost, nothing extra, equal scores."""
    sf = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.select("doc_id", "text", F.lit(0).alias("score"))
    got = {(r.doc_id, r.item_id): r.score for r in D.matches(docs, bench).collect()}
    words = lambda rows: D.folded_words(*bytescan.utf8(pa.array([r.text for r in rows], pa.string())))
    a, b = docs.collect(), bench.collect()
    with np.errstate(over="ignore"):
        (wa, oa), (wb, ob) = words(a), words(b)
    want = {}
    for j, item in enumerate(b):
        x = wb[ob == j]
        for i, doc in enumerate(a):
            y = wa[oa == i]
            if len(np.intersect1d(x, y)) * 2 >= len(x):  # a score of one half needs as many words in common
                best, _ = D.align(x[None, :], np.array([len(x)]), y[None, :], np.array([len(y)]))
                if best[0] / (D.MATCH * len(x)) >= D.THRESHOLD:
                    want[doc.doc_id, item.item_id] = best[0] / (D.MATCH * len(x))
    assert want and got == want


def test_long_texts_and_null_ids(spark):
    item = [f"w{k}" for k in range(400)]
    docs = [(1, "x " * 100_000 + " ".join(item) + " y" * 100_000), (2, " ".join(item[::2])), (None, " ".join(item)), (3, "z " * 300_000)]
    items = [(None, " ".join(item[:30])), (7, " ".join(item)), (8, "w1 w2")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.matches(d, b).collect()}
    assert got == {(1, None), (1, 7), (None, None), (None, 7)}
    assert sorted(r.doc_id for r in D.clean(d, b).collect()) == [2, 3]
