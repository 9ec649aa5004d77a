"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

The graph holds each vector's K nearest found. It starts from blocks of vectors that lie on the same sides of some
random planes (blocks are split by id where they are large, so equal vectors don't pile up), compared inside. Then each
round joins neighbours of neighbours: the list of a vector, forward and backward, meets at that vector by a Spark
join, its members are compared with each other, and pairs that improve a member's list are merged into it. Rounds
go on until less than SETTLED of the entries of all lists are new.

A search starts from the query's own list and expands, hop by hop, the nearest unexpanded vectors of a pool by joins
with the graph (both directions) and the vectors; the pool keeps the POOL nearest. It ends when every vector of every
query's pool is expanded. Backward lists are cut to the K
nearest, in two steps (by id hash, then whole), so that a hub never fills a task. Distances that are returned are
computed in double precision from the original vectors.

Defined results: vectors that are null, zero, or hold null or non-finite components, vectors of another length than
most, and null ids take no part; of rows that repeat an id the smallest vector counts; equal distances go to the
smaller id; with fewer candidates than asked for, all are returned; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomery.llm.common import sized, staged, table

K, BLOCK, STARTS, SETTLED, POOL, WIDTH, TOP = 32, 400, 3, 0.005, 224, 56, 10


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) -> (id, x), x the components as doubles."""
    d = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("x", lambda c: c != 0)
    d = d.where(F.col("id").isNotNull() & F.col("x").isNotNull()).where(F.coalesce(fine, F.lit(False))).groupBy("id").agg(F.min("x").alias("x"))
    lengths = d.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n")
    return d.join(F.broadcast(lengths), F.size("x") == F.col("n")).select("id", "x")


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists of doubles as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _squares(x: np.ndarray) -> np.ndarray:
    """All squared distances inside x; single precision will do for the graph."""
    n = (x * x).sum(1)
    return np.maximum(n[:, None] + n[None, :] - 2 * (x @ x.T), 0)


LISTS = "id long, near array<long>, far array<double>"


def _rows(owner: np.ndarray, near: np.ndarray, far: np.ndarray, k: int) -> pa.RecordBatch:
    """(owner, near, far) pairs -> a list of the k nearest distinct ones for each owner."""
    order = np.lexsort((near, owner))
    o, n = owner[order], near[order]
    once = np.ones(len(order), bool)
    once[1:] = (o[1:] != o[:-1]) | (n[1:] != n[:-1])
    order = order[once]
    order = order[np.lexsort((near[order], far[order], owner[order]))]
    o = owner[order]
    first = np.flatnonzero(np.append(True, o[1:] != o[:-1])) if len(o) else np.zeros(0, int)
    rank = np.arange(len(o)) - np.repeat(first, np.diff(np.append(first, len(o))))
    order = order[rank < k]
    o = owner[order]
    first = np.flatnonzero(np.append(True, o[1:] != o[:-1])) if len(o) else np.zeros(0, int)
    cut = pa.array(np.append(first, len(o)), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(o[first]), pa.ListArray.from_arrays(cut, pa.array(near[order])), pa.ListArray.from_arrays(cut, pa.array(far[order], pa.float64()))], ["id", "near", "far"])


def _merge(k: int):
    """(id, near: lists, far: lists) -> one list of the k nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            near, far = (b.column(i).flatten().to_numpy(zero_copy_only=False) for i in (1, 2))
            yield _rows(np.repeat(b.column(0).to_numpy(), size), near, far, k)

    return run


def _merged(lists: DataFrame, k: int) -> DataFrame:
    both = lists.groupBy("id").agg(F.flatten(F.collect_list("near")).alias("near"), F.flatten(F.collect_list("far")).alias("far"))
    return both.mapInArrow(_merge(k), LISTS)


def _blocks(vectors: DataFrame, count: int, seed: int, k: int, block: int) -> DataFrame:
    """Lists from comparing the vectors of each block."""
    planes = max(0, int(np.ceil(np.log2(max(count, 1) / block))))

    def side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1))
            normal = np.random.default_rng(seed).standard_normal((x.shape[1], planes))
            where = ((x @ normal > 0) @ (1 << np.arange(planes))).astype(np.int64) if planes else np.zeros(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(where)], ["id", "x", "block"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, xs in zip(b.column(0), b.column(1), strict=True):
                i = ids.values.to_numpy()
                if len(i) < 2:
                    continue
                d = _squares(_matrix(xs.values))
                np.fill_diagonal(d, np.inf)
                best = np.argpartition(d, min(k, len(i) - 1) - 1, axis=1)[:, : min(k, len(i) - 1)]
                yield _rows(np.repeat(i, best.shape[1]), i[best].ravel(), np.take_along_axis(d, best, 1).ravel(), k)

    placed = vectors.select("id", F.col("x").cast("array<float>").alias("x")).mapInArrow(side, "id long, x array<float>, block long")
    sizes = placed.groupBy("block").agg(F.ceil(F.count("*") / (2 * block)).alias("parts"))
    parts = placed.join(sized(staged(sizes, "ann-blocks")), "block").withColumn("part", F.pmod(F.xxhash64("id", F.lit(seed)), "parts"))
    held = parts.groupBy("block", "part").agg(F.collect_list(F.struct("id", "x")).alias("m"))
    return held.select(F.col("m.id").alias("ids"), F.col("m.x").alias("xs")).mapInArrow(compare, LISTS)


def _pairs(graph: DataFrame, k: int) -> DataFrame:
    """(id, other) of the graph, forward, and backward to the k nearest."""
    forward = graph.select("id", F.explode(F.arrays_zip("near", "far")).alias("e")).select("id", F.col("e.near").alias("other"), F.col("e.far").alias("far"))
    back = forward.select(F.col("other").alias("id"), F.col("id").alias("other"), "far").withColumn("_salt", F.pmod(F.xxhash64("other"), F.lit(16)))
    for keys in (["id", "_salt"], ["id"]):
        order = Window.partitionBy(*keys).orderBy("far", "other")
        back = back.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")
    return forward.select("id", "other").unionByName(back.select("id", "other")).distinct()


def _round(graph: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """One NN-descent round: the members of each list are compared with each other, improvements merged."""
    worst = graph.select(F.col("id").alias("other"), F.when(F.size("far") < k, F.lit(float("inf"))).otherwise(F.element_at("far", -1)).alias("worst"))
    facts = vectors.select(F.col("id").alias("other"), F.col("x").cast("array<float>").alias("x")).join(worst, "other", "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf"))))
    members = _pairs(graph, k).join(facts, "other").groupBy("id").agg(F.collect_list(F.struct("other", "worst", "x")).alias("m"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, near, far = [], [], []
            for ids, worst, xs in zip(b.column(0), b.column(1), b.column(2), strict=True):
                i, w = ids.values.to_numpy(), worst.values.to_numpy()
                d = _squares(_matrix(xs.values))
                np.fill_diagonal(d, np.inf)
                r, c = np.nonzero(d < w[:, None])
                owner.append(i[r])
                near.append(i[c])
                far.append(d[r, c].astype(float))
            if owner:
                yield _rows(*map(np.concatenate, (owner, near, far)), k)

    better = members.select(F.col("m.other").alias("ids"), F.col("m.worst").alias("worst"), F.col("m.x").alias("xs")).mapInArrow(compare, LISTS)
    return _merged(graph.unionByName(better), k)


def changed(before: DataFrame, after: DataFrame) -> float:
    """The share of the entries of all lists after a round that were not there before it."""
    old = before.select("id", F.col("near").alias("old"))
    both = after.join(old, "id", "left").withColumn("old", F.coalesce("old", F.expr("cast(array() as array<long>)")))
    r = both.agg(F.sum(F.size(F.array_except("near", "old"))).alias("new"), F.sum(F.size("near")).alias("every")).first()
    return (r.new or 0) / (r.every or 1)


def build(vectors: DataFrame, k: int = K, settled: float = SETTLED, block: int = BLOCK) -> DataFrame:
    """The neighbour graph of usable vectors (id, x): id, near, far (squared), nearest first."""
    count = vectors.count()
    lists = _blocks(vectors, count, 1, k, block)
    if count > block:
        for seed in range(2, STARTS + 1):
            lists = lists.unionByName(_blocks(vectors, count, seed, k, block))
    graph = staged(_merged(lists, k), "ann-graph")
    moving = count > block
    while moving:  # lists only get nearer, so this ends
        before, graph = graph, staged(_round(graph, vectors, k), "ann-graph")
        moving = changed(before, graph) >= settled
    return graph


def search(vectors: DataFrame, graph: DataFrame, queries: DataFrame, top: int = TOP, pool: int = POOL, width: int = WIDTH, k: int = K) -> DataFrame:
    """queries (query_id), ids of vectors -> query_id, rank, vec_id, score."""
    links = staged(_pairs(graph, k).groupBy("id").agg(F.collect_list("other").alias("others")), "ann-links")
    asked = staged(queries.join(vectors, F.col("query_id") == F.col("id")).select("query_id", F.col("x").alias("q")), "ann-queries")

    def distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = np.sqrt(((_matrix(b.column(2)) - _matrix(b.column(3))) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d, pa.float64())], ["query_id", "id", "score"])

    best = Window.partitionBy("query_id").orderBy("score", "id")
    held = None
    front = asked.select("query_id", F.col("query_id").alias("id"))
    while held is None or not front.isEmpty():  # a vector is expanded once, so this ends
        reached = front.join(links, "id").select("query_id", F.explode("others").alias("id")).where("id <> query_id").distinct()
        if held is not None:
            reached = reached.join(held.select("query_id", "id"), ["query_id", "id"], "left_anti")
        new = reached.join(vectors, "id").join(sized(asked), "query_id").select("query_id", "id", "x", "q").mapInArrow(distance, "query_id long, id long, score double")
        new = new.withColumn("open", F.lit(True))
        every = new if held is None else held.unionByName(new)
        every = every.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= pool).drop("_r")
        turn = F.sum(F.col("open").cast("int")).over(best.rowsBetween(Window.unboundedPreceding, 0))
        held = staged(every.withColumn("now", F.col("open") & (turn <= width)), "ann-pool")
        front = held.where("now").select("query_id", "id")
        held = held.withColumn("open", F.col("open") & ~F.col("now")).drop("now")
    out = held.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def nearest(vectors: DataFrame, every: int = 100, **options) -> DataFrame:
    """The nearest of all other vectors for each id divisible by `every`."""
    known = staged(usable(vectors), "ann-vectors")
    graph = build(known)
    return search(known, graph, known.where(F.col("id") % every == 0).select(F.col("id").alias("query_id")), **options)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
