"""N-gram Jaccard self-join by a token-group matrix: exact, in blocks that no hot token or hot group of copies can fill.

Documents are sets of hashed 5-word shingles; two link when their Jaccard similarity reaches 3/4. Equal sets are one
set from the start. The steps:

1. Who can have a partner at all. A set of n that links with another shares at least 3n/4 shingles with it, so among
   its smallest hashes ("zone", about 5n/12) a known number must also lie in the other's zone. Zones of distinct sets
   are dealt out by hash range in packed form; a shingle that two sets of one batch share is counted there and
   sent once without owners, so that hot shingles cost one entry a batch. Only documents with enough shared shingles
   go on. Passages that many documents share do not reach that number.
2. Groups of similar documents. For a few min-hash keys, each document is compared with the most central document
   of its key (one comparison a key, however large the group of copies); verified links join documents into groups.
3. Token-group matrix. A group's row is the union of its members' tokens. Tokens that only one group has
   cannot link across groups; a document whose tokens of two or more groups are too few is finished (repeated once, as
   fewer documents make fewer such tokens). The rest probe with their rarest tokens (the pigeonhole prefix): documents
   that share a token of few documents are compared directly. Documents that hot tokens hold together form clusters, cut
   into blocks of about BLOCK similar documents; of two blocks, only documents whose overlap with the other block's
   union of tokens leaves room for a partner are compared, by one matrix product, and one link for two groups is kept.
4. Classes are the connected components of all verified links.

Links inside a group are found only as far as they join documents, so copies are never expanded into all pairs.

Defined results: null text and text without words has an empty set and links with nothing; fewer than five words make
one shingle; rows that repeat an id are one document, and repeated texts are equal sets; a row without an id takes the
class of the documents with an equal set (null if none has an id) and links with nothing else; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomery.llm import bytescan
from loomery.llm.common import components, sized, staged, table

WORDS, KEYS = 5, 8
U64 = np.uint64


def _need(n):
    """Shingles that a set of n shares at least with any partner."""
    return (3 * n + 3) // 4


def _sure(n):
    """Shared shingles that the zone of a set of n makes room for."""
    return np.maximum(1, n // 6)


def _sets(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, ascending, as one array with offsets, and the counts."""
    n = len(at) - 1
    hashes, text = bytescan.words(data, at)
    tokens, owner = bytescan.distinct_by_text(*bytescan.shingles(hashes, text, n, size))
    cut = bytescan.offsets(owner, n)
    return tokens, cut, np.diff(cut)


def _per_text(ufunc: np.ufunc, values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """ufunc over each text's values; 0 for none."""
    out = np.zeros(len(cut) - 1, values.dtype)
    some = np.flatnonzero(np.diff(cut))
    if len(some):
        out[some] = ufunc.reduceat(values, cut[:-1][some])
    return out


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values.view(np.int64)))


def summaries(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id, n, d1, d2 (a digest of the set), sure (zone shingles that a partner shares at least), zone; and _k1, _k2 if docs has them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keys = [c for c in ("_k1", "_k2") if c in docs.columns]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for rows, data, at in bytescan.slices(batches):
                tokens, cut, n = _sets(data, at, size)
                zone = np.minimum(n, n // 4 + _sure(n))
                inside = np.arange(len(tokens)) - np.repeat(cut[:-1], n) < np.repeat(zone, n)
                digests = [_per_text(np.add, bytescan.mix(tokens + U64(c)), cut).view(np.int64) for c in (1, 2)]
                out = [rows.column(0), pa.array(n, pa.int64()), *map(pa.array, digests), pa.array(_sure(_need(n)), pa.int64()), _lists(tokens[inside], zone)]
                out += [rows.column(k) for k in range(2, 2 + len(keys))]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n", "d1", "d2", "sure", "zone", *keys])

    schema = f"doc_id {kind}, n long, d1 long, d2 long, sure long, zone array<long>" + "".join(f", {k} long" for k in keys)
    return docs.select("doc_id", "text", *keys).mapInArrow(scan, schema)


def full_sets(docs: DataFrame, size: int = WORDS, keys: int = KEYS) -> DataFrame:
    """doc_id, n, d1, d2, tokens (all shingle hashes) and keys (min-hash keys)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for rows, data, at in bytescan.slices(batches):
                tokens, cut, n = _sets(data, at, size)
                digests = [_per_text(np.add, bytescan.mix(tokens + U64(c)), cut).view(np.int64) for c in (1, 2)]
                least = np.column_stack([_per_text(np.minimum, bytescan.mix(tokens ^ s), cut) for s in bytescan.seeded(keys, 3)])
                out = [rows.column(0), pa.array(n, pa.int64()), *map(pa.array, digests), _lists(tokens, n), _lists(least.ravel(), np.full(len(n), keys))]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "n", "d1", "d2", "tokens", "keys"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n long, d1 long, d2 long, tokens array<long>, keys array<long>")


def _shared(rows: DataFrame, token: str, owner: str) -> DataFrame:
    """Tokens that two or more owners have."""
    return rows.groupBy(token).agg(F.min(owner).alias("_a"), F.max(owner).alias("_b")).where("_a < _b").select(token)


#: Zone shingles that one hash range holds on average.
RANGE = 1 << 20
_NOBODY = 0xFFFFFFFF
PACKED = "range int, batch long, tokens binary, owners binary, docs binary, hits binary"


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    """A batch of packed rows: numbers and binaries by the names of a schema."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _range_rows(ranges: int):
    """Batches of (doc_id, zone) -> for each hash range a row: its shingles, the documents that own some, and each shingle's owner among
    them or nobody; and one row with the hits counted here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = (np.arange(ranges, dtype=object) * (1 << 64) // ranges).astype(U64)
        for number, b in enumerate(batches):
            if not b.num_rows:
                continue
            name = (TaskContext.get().partitionId() << 32) + number
            docs = b.column(0).to_numpy()
            token = b.column(1).flatten().to_numpy().view(U64)
            owner = np.repeat(np.arange(b.num_rows, dtype=np.uint32), np.diff(b.column(1).offsets.to_numpy()))
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            first = np.flatnonzero(new)
            many = np.diff(np.append(first, len(token)))
            hits = np.bincount(owner[np.repeat(many > 1, many)], minlength=len(docs))
            token, owner, alone = token[first], owner[first], many == 1
            cut = np.append(np.searchsorted(token, edges), len(token))
            rows = []
            for k, (i, j) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
                if i < j:
                    some, place = np.unique(owner[i:j][alone[i:j]], return_inverse=True)
                    whose = np.full(j - i, _NOBODY, np.uint32)
                    whose[alone[i:j]] = place
                    rows.append((k, name, token[i:j].tobytes(), whose.tobytes(), docs[some].astype("<i8").tobytes(), None))
            some = hits > 0
            if some.any():
                rows.append((-1 - name % ranges, name, None, None, docs[some].astype("<i8").tobytes(), hits[some].astype("<i8").tobytes()))
            yield _batch(list(zip(*rows, strict=True)) or [[]] * 6, PACKED)

    return run


HITS = "batch long, docs binary, hits binary"


def _range_hits(rows: pa.Table) -> pa.Table:
    """All rows of a hash range -> for each batch, its documents with hits, packed."""
    batch, token, owner, docs, out, base = [], [], [], [], [], 0
    for name, t, o, d, h in zip(*(rows[c] for c in ("batch", "tokens", "owners", "docs", "hits")), strict=True):
        if h.is_valid:
            out.append((name.as_py(), d.as_py(), h.as_py()))
            continue
        o = np.frombuffer(o.as_py(), np.uint32).astype(np.int64)
        token.append(np.frombuffer(t.as_py(), U64))
        owner.append(np.where(o == _NOBODY, -1, o + base))
        docs.append(np.frombuffer(d.as_py(), "<i8"))
        base += len(docs[-1])
        batch.append(name.as_py())
    if token:
        token, owner = np.concatenate(token), np.concatenate(owner)
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        same = np.zeros(len(token), bool)
        same[1:] = token[1:] == token[:-1]
        shared = same.copy()
        shared[:-1] |= same[1:]
        ends = np.cumsum([len(d) for d in docs])
        hits = np.bincount(owner[shared & (owner >= 0)], minlength=ends[-1])
        for name, d, h in zip(batch, docs, np.split(hits, ends[:-1]), strict=True):
            if (h > 0).any():
                out.append((name, d[h > 0].tobytes(), h[h > 0].astype("<i8").tobytes()))
    return pa.Table.from_batches([_batch(list(zip(*out, strict=True)) or [[]] * 3, HITS)])


def _batch_hits(rows: pa.Table) -> pa.Table:
    """Packed hits of a batch from all ranges -> one row for each document."""
    docs, hits = (np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in rows[c]]) for c in ("docs", "hits"))
    docs, place = np.unique(docs, return_inverse=True)
    return pa.table({"doc_id": pa.array(docs), "hits": pa.array(np.bincount(place, hits, len(docs)).astype(np.int64))})


def _live(found: DataFrame, first: DataFrame) -> DataFrame:
    """Ids of documents whose zones leave room for a partner with another set."""
    reps = staged(first.select(F.col("rep").alias("doc_id")).where("doc_id is not null").distinct(), "near-reps")
    zones = found.where("n > 0").join(sized(reps), "doc_id", "left_semi")
    total = found.agg(F.sum(F.size("zone"))).first()[0] or 0
    rows = zones.select("doc_id", "zone").mapInArrow(_range_rows(max(1, -(-total // RANGE))), PACKED)
    hits = rows.groupBy("range").applyInArrow(_range_hits, HITS).groupBy("batch").applyInArrow(_batch_hits, "doc_id long, hits long")
    hits = hits.groupBy("doc_id").agg(F.sum("hits").alias("hits"))
    return found.select("doc_id", "sure").join(hits, "doc_id").where("hits >= sure").select("doc_id").distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those that link."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    near = pairs.join(one, "a").join(two, "b").where("4 * na >= 3 * nb and 4 * nb >= 3 * na")
    return near.where(4 * both >= 3 * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _central(sets: DataFrame) -> DataFrame:
    """(doc_id, central): how common a document's tokens are on average; the least edited copy of a text has the most common ones."""
    rows = sets.select("doc_id", F.explode("tokens").alias("token"))
    often = rows.groupBy("token").agg(F.count("*").alias("_df")).where("_df > 1")
    return rows.join(often, "token").groupBy("doc_id").agg(F.sum(F.log2("_df")).alias("_common"))


def _stars(sets: DataFrame) -> DataFrame:
    """Pairs (a, b): a document and the most central document of one of its min-hash keys."""
    rank = F.struct((-F.coalesce("_common", F.lit(0.0)) / F.col("n")).alias("c"), "doc_id")
    rows = sets.select("doc_id", "n", "keys").join(_central(sets), "doc_id", "left").select("doc_id", rank.alias("rank"), F.posexplode("keys").alias("no", "key"))
    first = rows.groupBy("no", "key").agg(F.min("rank").alias("_low"), F.max("rank").alias("_high")).where("_low.doc_id <> _high.doc_id")
    rows = rows.join(first.select("no", "key", F.col("_low.doc_id").alias("b")), ["no", "key"]).where("doc_id <> b")
    return rows.select(F.col("doc_id").alias("a"), "b").distinct()


def _suspects(rows: DataFrame) -> DataFrame:
    """Of rows (doc_id, n, grp, token), those whose document has enough tokens of two or more groups, and of them those tokens."""
    kept = rows.join(_shared(rows, "token", "grp"), "token")
    enough = kept.groupBy("doc_id", "n").agg(F.count("*").alias("_c")).where(F.col("_c") >= _need_sql(F.col("n"))).select("doc_id")
    return kept.join(enough, "doc_id")


def _need_sql(n: Column) -> Column:
    return F.floor((3 * n + 3) / 4)


#: Documents of a token beyond which its owners are compared in blocks, documents of a block, and tokens of one matrix product.
HOT, BLOCK, WIDTH = 48, 256, 4096
SIDE = ("i", "g", "n", "t")


def _common(a: np.ndarray, a_of: np.ndarray, b: np.ndarray, b_of: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Tokens that each document of one side shares with each of the other: matrix products over WIDTH tokens at a time."""
    union = np.intersect1d(a, b)
    out = np.zeros(shape, np.float64)
    (a, a_of), (b, b_of) = (((p := np.searchsorted(union, t).clip(max=len(union) - 1))[k := union[p] == t], o[k]) if len(union) else (t[:0], o[:0]) for t, o in ((a, a_of), (b, b_of)))
    sides = [(p[order := np.argsort(p, kind="stable")], o[order]) for p, o in ((a, a_of), (b, b_of))]
    for lo in range(0, len(union), WIDTH):
        has = []
        for (p, o), n in zip(sides, shape, strict=True):
            i, j = np.searchsorted(p, (lo, lo + WIDTH))
            has.append(np.zeros((n, min(WIDTH, len(union) - lo)), np.float32))
            has[-1][o[i:j], p[i:j] - lo] = 1
        out += has[0] @ has[1].T
    return out.astype(np.int64)


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks -> a link for every two groups that have one. Only documents that the other block's union leaves room for are compared."""
    for b in batches:
        for row in range(b.num_rows):
            links: dict[tuple[int, int], tuple[int, int]] = {}
            sides = []
            for k in (0, 1):
                ids, grp, n, tokens = (b.column(4 * k + i)[row].values for i in range(4))
                sides.append((ids.to_numpy(), grp.to_numpy(), n.to_numpy(), tokens.flatten().to_numpy(), np.repeat(np.arange(len(ids)), tokens.value_lengths().to_numpy())))
            opened = []
            for (ids, grp, n, t, o), other in zip(sides, (sides[1][3], sides[0][3]), strict=True):
                room = np.bincount(o[np.isin(t, other)], minlength=len(ids)) >= _need(n)
                place = np.cumsum(room) - 1
                opened.append((ids[room], grp[room], n[room], t[room[o]], place[o[room[o]]]))
            (ia, ga, na, ta, oa), (ib, gb, nb, tb, ob) = opened
            if len(ia) and len(ib):
                common = _common(ta, oa, tb, ob, (len(ia), len(ib)))
                near = (4 * common >= 3 * (na[:, None] + nb[None, :] - common)) & (ga[:, None] != gb[None, :])
                for i, j in zip(*np.nonzero(near), strict=True):
                    links.setdefault(tuple(sorted((int(ga[i]), int(gb[j])))), (int(ia[i]), int(ib[j])))
            yield pa.RecordBatch.from_arrays([pa.array([v[k] for v in links.values()], pa.int64()) for k in (0, 1)], ["a", "b"])


def _open_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks with their unions of tokens and their smallest documents -> the pairs that can hold a link."""
    for b in batches:
        ux, uy, nx, ny = (b.column(i) for i in range(2, 6))
        keep = [np.isin(ux[k].values.to_numpy(), uy[k].values.to_numpy(), assume_unique=True).sum() >= _need(max(nx[k].as_py(), ny[k].as_py())) for k in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], ["x", "y"])


def _hot_links(rows: DataFrame, hot: DataFrame, sets: DataFrame) -> DataFrame:
    """Links across groups between documents that share a hot token: clusters that hot tokens hold together, compared block by block.

    A block holds documents of near sizes (a factor of 4/3), of one large group or of some small ones. The blocks' unions
    of tokens meet first, and the documents only of pairs of blocks whose unions share enough.
    """
    owners = rows.join(hot, "token")
    low = owners.groupBy("token").agg(F.min("grp").alias("b"))
    named = components(owners.join(low, "token").select(F.col("grp").alias("a"), "b").distinct(), "near-clusters")
    docs = rows.select("doc_id", "n", "grp").distinct().join(named.withColumnRenamed("component", "cluster"), F.col("grp") == F.col("node"))
    docs = docs.select("doc_id", "grp", "cluster", F.floor(F.log(F.col("n")) / F.log(F.lit(4 / 3))).alias("class"))
    sizes = docs.groupBy("cluster", "class", "grp").agg(F.count("*").alias("_c")).withColumn("own", F.when(F.col("_c") * 2 > BLOCK, F.col("grp")))
    pieces = sizes.groupBy("cluster", "class", "own").agg(F.ceil(F.sum("_c") / BLOCK).alias("_b"))
    spread = F.when(F.col("own").isNull(), F.xxhash64("grp")).otherwise(F.xxhash64("doc_id"))
    docs = docs.join(sizes.drop("_c"), ["cluster", "class", "grp"]).alias("d").join(pieces.alias("p"), F.expr("d.cluster = p.cluster and d.class = p.class and d.own <=> p.own"))
    docs = docs.select("doc_id", "grp", F.col("d.cluster").alias("cluster"), F.col("d.class").alias("class"), F.col("d.own").alias("own"), "_b")
    docs = docs.withColumn("piece", F.pmod(spread, F.col("_b"))).select("doc_id", "grp", F.struct("cluster", "class", "own", "piece").alias("x"))
    one = F.struct(F.col("doc_id").alias("i"), F.col("grp").alias("g"), "n", F.col("tokens").alias("t"))
    blocks = docs.join(sets.select("doc_id", "n", "tokens"), "doc_id").groupBy("x").agg(F.collect_list(one).alias("m"))
    blocks = staged(blocks, "near-blocks")
    union = staged(blocks.select("x", F.array_distinct(F.flatten("m.t")).alias("u"), F.array_min("m.n").alias("least")), "near-unions")
    side = lambda c: union.select(F.col("x").alias(c), F.col("x.cluster").alias("cluster"), F.col("u").alias(f"u{c}"), F.col("least").alias(f"n{c}"), F.explode(F.array(F.col("x.class"), F.col("x.class") + 1) if c == "x" else F.array(F.col("x.class"))).alias("class"))
    # a class meets itself (each pair once) and the next one; blocks of one group have nothing to find
    pairs = side("x").join(side("y"), ["cluster", "class"]).where("(x.class < y.class or x <= y) and not coalesce(x.own = y.own, false)")
    opened = staged(pairs.select("x", "y", "ux", "uy", "nx", "ny").mapInArrow(_open_pairs, f"x {docs.schema['x'].dataType.simpleString()}, y {docs.schema['x'].dataType.simpleString()}"), "near-opened")
    for c in "xy":
        opened = opened.join(blocks.select(F.col("x").alias(c), F.col("m").alias(f"m{c}")), c)
    return opened.select(*(F.col(f"m{k}.{c}").alias(f"{c}{k}") for k in "xy" for c in SIDE)).mapInArrow(_block_links, "a long, b long")


def _across(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """Links between documents of different groups, by the token-group matrix."""
    named = sets.join(groups, F.col("doc_id") == F.col("node"), "left").withColumn("grp", F.coalesce("component", "doc_id"))
    rows = named.select("doc_id", "n", "grp", F.explode("tokens").alias("token"))
    rows = staged(_suspects(rows), "near-suspects")
    rows = staged(_suspects(rows), "near-suspects")
    if rows.isEmpty():
        return groups.select(F.col("node").alias("a"), F.col("component").alias("b")).limit(0)
    spread = rows.groupBy("token").agg(F.count("*").alias("_docs"))
    rare = Window.partitionBy("doc_id").orderBy("_docs", "token")
    ranked = rows.join(spread, "token").withColumn("_rank", F.row_number().over(rare)).withColumn("_have", F.count("*").over(Window.partitionBy("doc_id")))
    # tokens that only one group has come first and are not among the rows
    probe = staged(ranked.where(F.col("_rank") <= F.col("_have") - _need_sql(F.col("n")) + 1).select("doc_id", "n", "grp", "token", "_docs"), "near-probe")
    other = rows.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("grp").alias("gb"), "token")
    cold = probe.where(F.col("_docs") <= HOT).join(other, "token").where("grp <> gb and 4 * n >= 3 * nb and 4 * nb >= 3 * n")
    links = _verified(staged(cold.select(F.greatest("doc_id", "b").alias("a"), F.least("doc_id", "b").alias("b")).distinct(), "near-pairs"), sets)
    hot = staged(probe.where(F.col("_docs") > HOT).select("token").distinct(), "near-hot")
    return links if hot.isEmpty() else links.unionByName(_hot_links(rows, hot, sets))


def classes(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """For every row of docs (doc_id, text and, if there, its keys): n, d1, d2 (the set) and component."""
    found = staged(summaries(docs, size), "near-sets")
    first = found.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    live = staged(_live(found, first), "near-live")
    sets = full_sets(docs.join(sized(live), "doc_id", "left_semi"), size)
    sets = staged(sets.join(first.select(F.col("rep").alias("doc_id"), "d1", "d2", "n"), ["doc_id", "d1", "d2", "n"], "left_semi"), "near-live-sets")
    stars = staged(_verified(_stars(sets), sets), "near-links")
    groups = components(stars, "near-groups")
    across = staged(_across(sets, groups), "near-links")
    if not across.isEmpty():
        groups = components(stars.unionByName(across), "near-classes")
    named = found.drop("sure", "zone").join(first, ["d1", "d2", "n"], "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    return named.withColumn("component", F.coalesce("component", "rep", "doc_id")).drop("rep")


def join(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs (doc_id, text)."""
    return classes(docs, size).select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of docs for each class, columns as they are: of the smallest id, and of rows that repeat it one.

    Rows of an empty set all stay. Equal sets of which no row has an id keep one row. Decisions are by id and text, so
    other texts under an id that another text makes a copy are not touched by them.
    """
    keys = ["doc_id", "_k1", "_k2"]
    keyed = docs.withColumns({"_k1": F.xxhash64("text"), "_k2": F.xxhash64(F.lit(1), "text")})
    rows = classes(keyed).where("n > 0").groupBy(*keys, "d1", "d2", "n", "component").agg(F.count("*").alias("_c"))
    order = Window.partitionBy("doc_id", "d1", "d2", "n").orderBy("_k1", "_k2")
    rows = rows.withColumn("_stays", F.col("doc_id").eqNullSafe(F.col("component")) & (F.row_number().over(order) == 1))
    rows = staged(rows.select(*(F.col(k).alias(f"x{k}") for k in keys), "_stays", "_c"), "near-decisions")
    same = [F.col(k).eqNullSafe(F.col(f"x{k}")) for k in keys]
    kept = keyed.join(sized(rows.where("not _stays").drop("_stays", "_c")), same, "left_anti")
    again = rows.where("_stays and _c > 1").drop("_stays", "_c")
    if not again.isEmpty():
        again = sized(again)
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(keys))
    return kept.select(*docs.columns)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS (SELECT doc_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w WHERE len(w) >= 5),
g AS (SELECT doc_id, i, n, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS t FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT DISTINCT doc_id, hash(t) AS t FROM g WHERE i <= n - 4 UNION ALL SELECT doc_id, hash(array_to_string(w, ' ')) FROM w WHERE len(w) BETWEEN 1 AND 4),
s AS (SELECT w.doc_id, count(t.t) AS n FROM w LEFT JOIN t ON t.doc_id = w.doc_id GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
h AS (SELECT p.a, p.b FROM p JOIN s x ON x.doc_id = p.a JOIN s y ON y.doc_id = p.b WHERE 100 * c >= 75 * (x.n + y.n - c)),
l AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
r AS (SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reached)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, m.c AS component_id FROM s JOIN (SELECT node, min(reached) AS c FROM r GROUP BY node) m ON m.node = s.doc_id
"""
