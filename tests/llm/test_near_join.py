import random
import re

from pyspark.sql import functions as F

from loomery.llm import near_join
from loomery.llm.common import components


def sets(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    own = {i: sets(t) for i, t in rows}
    root = {i: i for i in own}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(own)
    for x in ids:
        for y in ids:
            if x < y and own[x] and own[y] and 100 * len(own[x] & own[y]) >= 75 * len(own[x] | own[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: (len(own[i]), find(i)) for i in own}


def got(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit(1), "tokens": F.lit("x"), "component": F.lit(2)})
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_join.join(docs).collect()}


def test_near_copies_and_edges(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4)))
    common = [word() for _ in range(14)]
    rows = [(0, ""), (1, None), (2, "Same four words here"), (3, "same FOUR  words\there"), (4, "one"), (5, "  \n")]
    i = 10
    for _ in range(6):
        text = [word() for _ in range(rng.choice([8, 30, 60]))]
        for _ in range(9):  # copies edited a little more each time: chains of links
            rows.append((i, " ".join(text + (common if i % 3 else []))))
            i += 1
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = word()
    for _ in range(20):
        rows.append((i, " ".join(common + [word() for _ in range(rng.choice([3, 6, 40]))])))
        i += 1
    assert got(spark, rows) == brute(rows)


def test_without_rows_and_ids(spark):
    assert got(spark, []) == {}
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (None, "z y x w v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in near_join.join(docs).collect()), key=str) == sorted([(None, 4), (4, 4), (None, None)], key=str)


def test_representatives(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 0), (2, "a b c d e f", 1), (3, None, 1)], "doc_id long, text string, component_id int")
    out = near_join.representatives(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_representatives_by_row(spark):
    t = "a b c d e f"
    rows = [(1, t, 0), (1, t, 1), (None, t, 2), (2, t.upper(), 3), (None, "x y z u v w", 4), (None, "x y z u v w", 5), (None, "x  y z u v w", 6)]
    rows += [(7, "p q r s t u", 7), (7, "l m n o p q", 8), (8, "", 9), (8, "", 10), (None, None, 11)]
    out = near_join.representatives(spark.createDataFrame(rows, "doc_id long, text string, component int")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == sorted([(1, t), (0, out[[r.doc_id is None and bool(r.text) for r in out].index(True)].text), (7, "p q r s t u"), (7, "l m n o p q"), (8, ""), (8, ""), (0, "")])
    assert near_join.representatives(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hot_clusters_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_join, "HOT", 4)
    monkeypatch.setattr(near_join, "BLOCK", 8)
    monkeypatch.setattr(near_join, "WIDTH", 16)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4)))
    common = [word() for _ in range(30)]
    rows = []
    for i in range(90):  # one passage with ends of their own: some links, many near misses
        rows.append((i, " ".join([word() for _ in range(rng.randint(0, 5))] + common[: rng.randint(24, 30)] + [word() for _ in range(rng.randint(0, 6))])))
    rows.append((200, " ".join(common) + " " + " ".join(word() for _ in range(200_000))))
    rows.append((201, rows[-1][1] + " end"))
    assert got(spark, rows) == brute(rows)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201), (300, 300)]
    rows = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200}
