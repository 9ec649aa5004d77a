import numpy as np

from loomery.llm import neighbours


def brute(rows, every, top):
    known = {i: np.array(v, float) for i, v in rows}
    out = {}
    for q in known:
        if q % every == 0:
            d = sorted((float(np.sqrt(((known[q] - x) ** 2).sum())), i) for i, x in known.items() if i != q)
            out[q] = d[:top]
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(20)]
    bad = [(900, None), (1000, [0.0] * 8), (1100, [float("nan")] + [1.0] * 7), (1200, [None] + [1.0] * 7), (1300, [1.0] * 3), (None, [1.0] * 8)]
    docs = spark.createDataFrame([(i, v, 1, "a") for i, v in rows + bad + rows[:2]], "vec_id long, embedding array<float>, rank int, score string")
    got = {}
    for r in neighbours.nearest(docs).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = brute(rows, 100, 10)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for _, i in got[q]] == [i for _, i in want[q]]
        assert np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], atol=1e-12)


def test_few_and_none(spark):
    three = spark.createDataFrame([(0, [1.0, 0.0]), (100, [0.0, 1.0]), (5, [1.0, 1.0])], "vec_id long, embedding array<double>")
    rows = neighbours.nearest(three).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in rows) == [(0, 1, 5), (0, 2, 100), (100, 1, 5), (100, 2, 0)]
    assert neighbours.nearest(three.limit(0)).count() == 0
    assert neighbours.nearest(three.where("vec_id = 0")).count() == 0


def test_recall(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in d.collect()], 100, 10)
    got = {}
    for r in neighbours.nearest(d).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = np.mean([len({i for _, i in want[q]} & got[q]) / 10 for q in want])
    assert got.keys() == want.keys() and recall >= 0.95, recall


def test_rounds_go_on_until_settled(spark):
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((600, 8)))], "vec_id long, embedding array<double>")
    known = neighbours.usable(docs).cache()
    graph = neighbours.build(known, k=5, block=4)
    old = {r.id: set(r.near) for r in graph.collect()}
    new = {r.id: set(r.near) for r in neighbours._round(graph, known, 5).collect()}
    assert sum(len(new[i] - old.get(i, set())) for i in new) < 0.02 * sum(map(len, new.values()))


def test_search_follows_a_chain_to_its_top(spark):
    vectors = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(12)], "id long, x array<double>")
    chain = [(i, [j for j in (i - 1, i + 1) if 0 <= j < 12], [1.0] * (2 if 0 < i < 11 else 1)) for i in range(12)]
    graph = spark.createDataFrame(chain, neighbours.LISTS)
    rows = neighbours.search(vectors, graph, spark.createDataFrame([(0,)], "query_id long"), width=2, k=2).collect()
    assert sorted((r.rank, r.vec_id) for r in rows) == [(i, i) for i in range(1, 11)]
