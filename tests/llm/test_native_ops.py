import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomery.llm import license_scan, pii, source_mixing

SCHEMA = "doc_id long, text string, source string, size int, label string"
EDGE = [
    (1, "", "a", 1, "x"),
    (2, None, "a", 1, "x"),
    (3, "word", None, 1, "x"),
    (4, "ask bo.b@mail.example.com, 10.0.0.1 or 4111 1111 1111 1111; call +1 (555) 123-4567 now", "b", 1, None),
    (4, "ask bo.b@mail.example.com, 10.0.0.1 or 4111 1111 1111 1111; call +1 (555) 123-4567 now", "b", 1, None),
    (5, "x@y.z_q@r.s 1.2.3.4.5.6.7.8 999.1.1.1 411111111111111199999999 00001.2.3.0255", None, 1, "y"),
    (None, "Licensed under CC BY-NC 4.0. All  rights reserved", "c", 1, "y"),
    (7, "7 " * 30000 + "a" * 200000 + " ü€😀 me@host.org", "c", 1, "y"),
]


def base(text):
    text = text or ""
    out = []
    for no, (kind, pat) in enumerate({"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items()):
        if kind == "email" and "@" not in text:
            continue
        for m in re.finditer(pat, text if kind != "email" else text.replace("a" * 1000, "\x01" * 1000)):
            s, d = m[0], re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]:
                out.append((m.start(), no, m.end()))
    return sorted(out)


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


def check_pii(rows, texts):
    for r in rows:
        want = base(texts[r.doc_id])
        assert [(s.start, s.kind_no, s.end) for s in r.base] == want, r.doc_id
        assert {(s.start, s.kind_no, s.end) for s in r.spans} >= set(want)


def test_pii_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = pii.find(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    check_pii(rows, texts)
    assert any(r.base for r in rows)


def test_pii_edges(edge):
    rows = pii.find(edge).collect()
    assert len(rows) == len(EDGE)
    check_pii(rows, {r[0]: r[1] for r in EDGE})
    assert pii.find(edge.limit(0)).count() == 0


def test_pii_query_digest(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in pii.op3_pii(spark, sf_dir).collect():
        want = listed(base(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(want.split(",")) <= set(r.spans.split(",")) or not want


def planted():
    """Documents with identifiers that no base pattern and no seed is, in contexts that seeds teach; and others like them that are not personal."""
    docs, want, hexed = [], set(), hashlib.sha256
    for i in range(30):
        docs.append((i, f"log {i % 7} api_key: {hexed(str(i).encode()).hexdigest()[:40]} done on day {i}"))
        docs.append((100 + i, f"please write to contact user{i}@host{i}.example.org soon, order {1234567890123456 + i} paid"))
    for i in range(20):
        key = f"Zq{i}-{hexed(str(i).encode()).hexdigest()[:9]}"
        docs.append((200 + i, f"in log {i} api_key: {key}, then room {i}b or part {key[::-1]} left"))
        want.add((200 + i, key))
        docs.append((300 + i, f"please write to contact user{i}@localhost now"))
        want.add((300 + i, f"user{i}@localhost"))
        docs.append((400 + i, f"order {2234567890123456 + i} paid on day {i} at gate {i}x"))
    return docs, want


def test_pii_finds_planted_identifiers(spark):
    docs, want = planted()
    rows = pii.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    texts = dict(docs)
    check_pii(rows, texts)
    more = {(r.doc_id, s.s) for r in rows for s in r.spans if s not in r.base}
    assert all(texts[r.doc_id][s.start : s.end] == s.s for r in rows for s in r.spans)
    keys = {(i, t.split()[3]) for i, t in docs if i < 100}  # the secrets that taught their context
    assert more == want | keys  # recall and precision of what was planted are 1
    assert {pii.KINDS[s.kind_no] for r in rows for s in r.spans if r.doc_id >= 300 and s not in r.base} == {"email"}


def brute_trust(found, rounds=pii.ROUNDS):
    edges = {}
    for r in found:
        for p in r.patterns:
            k, b = edges.get((p, r.instance), (None, False))
            edges[p, r.instance] = (max([x for x in (k, r.kind_no) if x is not None], default=None), b or r.barred)
    seeds = Counter(p for (p, _), (k, _) in edges.items() if k is not None)
    edges = {e: x for e, x in edges.items() if seeds[e[0]] >= pii.SUPPORT}
    score = {e: float(k is not None) for e, (k, _) in edges.items()}
    for last in [False] * (rounds - 1) + [True]:
        size, total = Counter(p for p, _ in edges), Counter()
        for (p, _), s in score.items():
            total[p] += s
        trust = {p: total[p] / (n + pii.SHRINK) for p, n in size.items()}
        if last:
            return {p: t for p, t in trust.items() if t >= pii.TRUST}
        left = {}
        for p, i in edges:
            left[i] = left.get(i, 1.0) * (1 - min(trust[p], 0.999))
        score = {e: 1.0 if k is not None else 0.0 if b else 1 - left[e[1]] for e, (k, b) in edges.items()}


def test_pii_trust_matches_brute_force(spark):
    for docs in (spark.createDataFrame(planted()[0], "doc_id long, text string"), spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        found = pii.instances(pii.scan(docs.select("doc_id", "text")))
        got, want = {r.pattern: r.trust for r in pii.trusted(found).collect()}, brute_trust(found.collect())
        assert want and got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_pii_candidates_side_by_side(spark):
    text = "AB12345 CD67890 key: x9 \u20acE5\u20ac, 0a"
    rows = pii.instances(pii.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).collect()
    assert [(r.start, r.instance) for r in sorted(rows)] == [(0, "AB12345"), (8, "CD67890"), (21, "x9"), (25, "E5"), (30, "0a")]
    assert rows[0].patterns[0] == "1\t^\t\tplain" and rows[1].patterns[1] == "2\t^\tab0\t"


def brute_license(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at = sorted((i, lab) for p, lab in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
    return len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


def check_license(rows, texts):
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_license(texts[r.doc_id]), r.doc_id
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_license_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = license_scan.scan(docs).collect()
    check_license(rows, {r.doc_id: r.text for r in docs.collect()})
    assert sum(r.n_base for r in rows) > 0 and any("mit" in r.labels for r in rows)


def test_license_edges(edge):
    rows = license_scan.scan(edge).collect()
    assert len(rows) == len(EDGE)
    check_license(rows, {r[0]: r[1] for r in EDGE})
    assert license_scan.scan(edge.limit(0)).count() == 0


def brute_spans(text):
    """Label and score of every verified span that is no phrase, by plain loops."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    out = set()
    for line, label in license_scan.TEMPLATES.items():
        t = line.split()
        lines = {}
        for at in range(len(w) - 1):
            for place in range(len(t) - 1):
                if w[at : at + 2] == t[place : place + 2]:
                    lines.setdefault(at - place, []).append(at)
        spans, before = [], None
        for d in sorted(lines):
            if before is None or d - before > license_scan.SLACK or lines[d][0] - lines[before][-1] - 2 > len(t):
                spans.append([])
            spans[-1] += [(at, -(at - d)) for at in lines[d]]
            before = d
        for span in spans:
            latest, best = {}, 0
            for at, back in sorted(span):
                n = 1 + max((m for q, (m, d) in latest.items() if q < -back and abs(d - at - back) <= license_scan.SLACK), default=0)
                latest[-back] = (n, at + back)
                best = max(best, n)
            if best >= license_scan.LEAST * (len(t) - 1):
                out.add((label, best / (len(t) - 1)))
    return out


def check_labels(rows, texts):
    for r in rows:
        own, want = brute_license(texts[r.doc_id])[4], brute_spans(texts[r.doc_id])
        assert r.labels == ",".join(sorted({x for x, _ in want} | set(filter(None, own.split(","))))), r.doc_id
        assert r.score == (1.0 if own else max((s for _, s in want), default=0.0)), r.doc_id


def test_license_labels_match_brute_force(spark, edge):
    full = list(license_scan.TEMPLATES)
    texts = ["under cc by under cc by licensed under", "cc by " * 40, " ".join(full), " ".join(reversed(full[0].split()))]
    texts += [" x ".join([full[k], full[k + 1]]).replace(" the ", " ") for k in range(len(full) - 1)]
    texts += [" ".join(full[k].split()[:-3] * 2) for k in range(len(full))] + ["\u212a licensed under CC BY 4.0 \u0130", "licensed under cc 4 0 by 4 0 licensed cc by"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = license_scan.scan(docs).collect()
    assert len(rows) == len(texts) and not next(r for r in rows if r.doc_id == 0).labels.startswith("cc-by-4")
    check_labels(rows, dict(enumerate(texts)))
    check_license(rows, dict(enumerate(texts)))
    check_labels(license_scan.scan(edge).collect(), {r[0]: r[1] for r in EDGE})
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_labels(license_scan.scan(small).collect(), {r.doc_id: r.text for r in small.collect()})


def test_license_edited_template(spark):
    text = "Permission is hereby granted, free of charge, to any nice person obtaining a copy of software and associated documentation files"
    r = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.labels == "mit" and r.n_base == 0 and 0.75 <= r.score < 1


def test_mixing_edges(edge):
    rows = source_mixing.mix(edge).collect()
    assert len(rows) == len(EDGE) and all(r.taken <= 2 * r.size for r in rows)
    assert source_mixing.mix(edge.limit(0)).count() == 0
    by = {r.source: r for r in rows}
    assert by["a"].source_size == 0 and by["a"].target == 0


def test_mixing_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = source_mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("m")).collect()
    for r in got:
        assert abs(r.taken - r.target) <= 0.25 * r.target + 2 * r.m
    assert source_mixing.emit(docs).columns == docs.columns
    assert source_mixing.emit(docs).count() == source_mixing.mix(docs).agg(F.sum("copies")).first()[0]
