import hashlib
import random

import numpy as np

from loomery.llm import repeats


def brute(rows):
    """Rows (id, text) -> the same row order: n_bytes, n_removed, n_spans, sha."""
    low = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        if i is not None:
            for p in range(len(b) - 49):
                w = b[p : p + 50]
                low[w] = min(low.get(w, i), i)
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - 49):
                if low[b[p : p + 50]] < i:
                    gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string")
    got = sorted((tuple(r) for r in repeats.strip(docs).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 7)))
    say = lambda n: " ".join(word() for _ in range(n))
    lines = [say(20) for _ in range(6)]
    rows = []
    for i in range(150):
        t = say(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            line = rng.choice(lines)
            a = rng.randrange(len(line) // 2)
            t += line[a : a + rng.randint(30, 120)] + say(rng.randint(0, 10))
        if rows and rng.random() < 0.3:
            t = rng.choice(rows)[1] or ""
            if rng.random() < 0.7 and t:
                k = rng.randrange(len(t))
                t = t[:k] + "#" + t[k + rng.randint(0, 2) :]
        rows.append((i, t))
    rng.shuffle(rows)
    check(spark, rows)


def test_edges(spark):
    s = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMN"
    assert len(s) == 50
    rows = [(3, s), (3, s), (1, "x" + s + "y"), (5, None), (6, ""), (None, s), (7, s[:49]), (8, "a" * 300), (9, "a" * 120 + "b"), (9, "other " + "a" * 60), (10, s * 3), (11, s + "é" * 40), (12, "é" * 40), (13, "é" * 24)]
    rows += [(20, "ab cde f " * 30_000), (21, "ab cde f " * 20_000 + "end"), (22, "".join(chr(97 + i * i % 26) + chr(97 + i * 7 % 25) + str(i) for i in range(30_000)))]
    check(spark, rows)
    check(spark, [])


def test_tables_match_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in repeats.op10_repeats(spark, sf_dir).collect())
    assert got == sorted(brute(docs)) and any(r[2] for r in got)


def test_windows_of_wide_anchors_match_too(spark, sf_dir, monkeypatch):
    """Hot anchors take the other exchange; the result is the same."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    s = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQR"
    docs += [(10_000 + i, f"{i} " * (i % 5) + s[: 54 - i % 3] + f" {i}" * 9) for i in range(60)]
    for wide, hot in ((0, 16), (3, 1)):
        monkeypatch.setattr(repeats, "WIDE", wide)
        monkeypatch.setattr(repeats, "HOT", hot)
        check(spark, docs)


def test_covered_windows_match_brute_force():
    rng = np.random.default_rng(4)
    for size in (2, 30, 200):
        gram = rng.integers(0, 2, 20)
        before, after = rng.integers(0, 31, size), rng.integers(20, 51, size)
        context = np.zeros((size, 80), np.uint8)
        for i in range(size):
            text = np.concatenate([np.minimum(rng.integers(0, 40, 30), 1), gram, np.minimum(rng.integers(0, 40, 30), 1)])
            context[i, 30 - before[i] : 30 + after[i]] = text[30 - before[i] : 30 + after[i]]
        ids = rng.integers(0, size, size)
        over, back = repeats.covered_windows(context, before, after, ids)
        got = np.zeros((size, 81), bool)
        for i, b in zip(over, back):
            got[i, 30 - b : 80 - b] = True
        want = np.zeros((size, 81), bool)
        for i in range(size):
            for b in range(31):
                if before[i] >= b and after[i] >= 50 - b and any(ids[j] < ids[i] and before[j] >= b and after[j] >= 50 - b and (context[i, 30 - b : 80 - b] == context[j, 30 - b : 80 - b]).all() for j in range(size)):
                    want[i, 30 - b : 80 - b] = True
        assert (got == want).all() and (size < 30 or want.any())


def maximal(texts):
    """Every string of 50 bytes or more that occurs twice and that no byte on either side extends in all places: its places."""
    found = {}
    for i, t in texts:
        for a in range(len(t)):
            for z in range(a + 50, len(t) + 1):
                found.setdefault(t[a:z], []).append((i, a))
    text = dict(texts)
    out = set()
    for w, at in found.items():
        left = {text[i][p - 1] if p else (i, p) for i, p in at}
        right = {text[i][p + len(w)] if p + len(w) < len(text[i]) else (i, p) for i, p in at}
        if len(at) > 1 and len(left) > 1 and len(right) > 1:
            out |= {(hashlib.sha256(w).hexdigest(), len(w), i, p) for i, p in at}
    return out


def test_groups_are_the_maximal_repeats(spark):
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefgh") for _ in range(150))
    rows = [(1, base), (2, "x" + base[20:130]), (3, base[:100] + "y" + base[60:]), (4, base[40:110]), (5, "z" * 70), (6, "ü" + base[35:105] + "ü" + "z" * 61), (7, ""), (8, None), (9, base[:49])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, length int")
    got = [tuple(r) for r in repeats.repeat_groups(docs, 400).collect()]
    want = maximal([(i, t.encode()) for i, t in rows if t])
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert repeats.repeat_groups(docs.limit(0)).count() == 0
