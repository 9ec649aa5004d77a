"""What the operators of this subpackage share: tables, the shared folder, connected components."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.session import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, which only a local session may leave unset."""
    return scratch(spark, name)


#: Bytes of an Arrow batch; a task holds a batch some times over, in Spark and in Python. One row may be larger.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the session's Arrow batches, unless they are bounded lower already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: written to the shared folder as Parquet and read again, so that a lost executor costs one stage."""
    spark = df.sparkSession
    small_batches(spark)
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    # Spark drops the shuffle files of finished steps when the driver collects its garbage; twice, as listeners hold the last step a moment longer
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links (a, b): component is the smallest node reached.

    Alternating large-star and small-star steps: each step keeps the components and shortens the trees,
    the number of steps grows with the logarithm of the longest path. Hot nodes are met only by min() with
    map-side combining and by equi-joins that adaptive execution can split.
    """
    edges = links.select(F.col("a").alias("a"), F.col("b").alias("b")).where("a <> b")
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    for _ in range(rounds):
        # large star: every neighbour above a node points to the smallest of the node's neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        big = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: neighbours below a node, and the node, point to the smallest of them
        least = big.groupBy("a").agg(F.min("b").alias("m"))
        small = big.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        edges = staged(small.select("x.a", "x.b").where("a <> b").distinct(), name)
        # settled once every tree is a star: all point to nodes that point nowhere, and nothing moved
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components of {name} did not settle in {rounds} rounds")
    star = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return star.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


#: Rows of a few numbers that may be broadcast: about 32 MB.
BROADCAST_ROWS = 1_000_000


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (written out, of a few numbers a row) with a broadcast hint if its counted rows allow it; else a plain shuffled join follows."""
    return F.broadcast(df) if df.count() <= rows else df
