"""Joins, set operations and latest-per-key rules over keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(d: DataFrame, keys: list[str], order: list) -> DataFrame:
    return d.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def latest(d: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write wins."""
    return keep_first(d, keys, [F.desc(order)])


def not_done(d: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return d.join(done, keys, "left_anti")


def wanted(d: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
    return d.join(keys_of, keys, "left_semi")


def with_status(jobs: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Jobs with their cached status; those without a record are missing."""
    return jobs.join(cache.select(key, "status"), key, "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def complete_siblings(d: DataFrame, key: str, slot: str) -> DataFrame:
    """Rows of keys that occur in every slot."""
    every = d.agg(F.count_distinct(slot).alias("_slots"))
    have = d.groupBy(key).agg(F.count_distinct(slot).alias("_have"))
    return d.join(have.join(F.broadcast(every), F.col("_have") == F.col("_slots")).select(key), key, "left_semi")


def content_key(version: str, *columns: str):
    """SHA-1 of the JSON list of a version and columns; a key for this engine only."""
    return F.sha1(F.to_json(F.array(F.lit(version), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))))


def carry_forward(d: DataFrame, value, order: str, *keys: str):
    return F.last(value, True).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def donors(d: DataFrame, key: str, text: str, seed: int, lanes: int = 64) -> DataFrame:
    """For each row a text of another row: the next in a hashed order inside its lane, so that no cross join is formed.

    lanes bounds a task's rows: choose it by the size of d, about one for each 100,000 rows.
    """
    from loomery.operators.sampling import seed_key

    lane = F.conv(F.substring(seed_key("lane", F.col(key)), 1, 8), 16, 10).cast("long") % lanes
    d = d.withColumn("_lane", lane).withColumn("_h", seed_key(seed, F.col(key)))
    w = Window.partitionBy("_lane").orderBy("_h", key)
    first = F.first(text).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return d.withColumn("donor", F.coalesce(F.lead(text).over(w), first)).drop("_lane", "_h")
