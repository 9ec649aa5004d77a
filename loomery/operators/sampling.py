"""Seeded orders, samples, strides, chunks and mixtures. Seeds are SHA-256 keys, so any engine draws the same."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seed_key(*parts: Column | str | int) -> Column:
    """First 64 bits of the SHA-256 of the parts joined by '|', as hex; orders as the number does."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", *(c.cast("string") for c in cols)), 256), 1, 16)


def unit(*parts: Column | str | int) -> Column:
    """A uniform number below 1 from the first 52 bits of the key."""
    return F.conv(F.substring(seed_key(*parts), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def derived_seed(base: int, prompt: Column, index: Column) -> Column:
    """Seed of a generated row: base + the first 4 bytes of the prompt's SHA-1 + index, modulo 2**31."""
    return F.pmod(F.lit(base) + F.conv(F.substring(F.sha1(prompt), 1, 8), 16, 10).cast("long") + index, F.lit(1 << 31))


def first_n(d: DataFrame, n: int, order: str) -> DataFrame:
    return d.orderBy(order).limit(n)


def end_n(d: DataFrame, n: int, order: str) -> DataFrame:
    """The last n rows; n = 0 keeps all."""
    return d if n == 0 else d.orderBy(F.desc(order)).limit(n)


def random_n(d: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """n rows of smallest seed key: local and global top-n, no full sort."""
    return d.orderBy(seed_key(seed, F.col(key)), key).limit(n)


def by_strategy(d: DataFrame, strategy: str, order: str, seed: int = 0) -> DataFrame:
    """first:N, end:N, random:N (N may be a percentage, rounded up) or all."""
    name, _, number = strategy.partition(":")
    if not number or name not in ("first", "end", "random"):
        return d
    n = math.ceil(int(number.split("%")[0]) * d.count() / 100) if "%" in number else int(number)
    return {"first": lambda: first_n(d, n, order), "end": lambda: end_n(d, n, order), "random": lambda: random_n(d, n, order, seed)}[name]()


def stratified(d: DataFrame, k: int, stratum: str, key: str, seed: int) -> DataFrame:
    w = Window.partitionBy(stratum).orderBy(seed_key(seed, F.col(key)), key)
    return d.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= k)


def placed(d: DataFrame, key: str, order: Column, rows: int, *by: str) -> DataFrame:
    """d with `place`, from 0, in the total order of a uniform hexadecimal key (then `key`), for each value of by.

    No window runs over all rows: they are counted by the first digits of the order, about 100,000 rows for each value, the counts
    are summed up (a few rows for each of them), and rows are numbered inside a value.
    """
    digits = max(1, math.ceil(math.log(max(rows, 1) / 100_000 + 1, 16)))
    d = d.withColumn("_h", order).withColumn("_b", F.substring("_h", 1, digits))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1) if by else Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(*by, "_b").agg(F.count("*").alias("_n")).select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key)) - 1
    return d.join(F.broadcast(counts), [*by, "_b"]).withColumn("place", F.col("_before") + inside).drop("_h", "_b", "_before")


def epoch_plan(d: DataFrame, key: str, seed: int, epoch: int, world: int, batch: int) -> DataFrame:
    """Order of one epoch, dealt to ranks in strides and cut in whole batches: key, rank, step."""
    n = d.count()
    keep = n // (world * batch) * world * batch
    place = placed(d.select(key), key, seed_key(seed * 1_000_003 + epoch, F.col(key)), n).where(F.col("place") < keep)
    return place.select(key, (F.col("place") % world).alias("rank"), F.floor(F.col("place") / (world * batch)).alias("step"))


def strided(d: DataFrame, place: str, lanes: int, chunk: int) -> DataFrame:
    i = F.col(place)
    return d.withColumn("lane", F.pmod(i, F.lit(lanes))).withColumn("chunk", F.floor(F.floor(i / lanes) / chunk))


def even_chunks(d: DataFrame, order: str, most: int, *keys: str) -> DataFrame:
    """ceil(n / most) chunks of near-equal size by key, the larger ones first."""
    w, all_ = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys)
    n = F.count("*").over(all_)
    parts = F.ceil(n / most)
    small, rest, i = F.floor(n / parts), n % parts, F.row_number().over(w) - 1
    cut = rest * (small + 1)
    return d.withColumn("chunk", F.when(i < cut, F.floor(i / (small + 1))).otherwise(rest + F.floor((i - cut) / small)))


def interleave(d: DataFrame, shard: str, order: str, seed: int) -> DataFrame:
    """Rounds over shards: one row of each shard per round, the shards' order anew each round: adds round and turn."""
    d = d.withColumn("round", F.row_number().over(Window.partitionBy(shard).orderBy(order)))
    return d.withColumn("turn", seed_key(seed, F.col("round"), F.col(shard)))


def weighted_order(d: DataFrame, source: str, key: str, weights: dict[str, float], seed: int) -> DataFrame:
    """Draw order of a mixture: exponential arrival times whose rate is the source's weight; runs until all are used."""
    rate = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))[F.col(source)]
    return d.withColumn("arrival", -F.log(1 - unit(seed, F.col(key))) / F.coalesce(rate, F.lit(1.0)))


def length_batches(d: DataFrame, length: str, key: str, seed: int, mega: int, batch: int) -> DataFrame:
    """Length-grouped batches: random megabatches, longest first inside, separately by the sign of the length."""
    d = placed(d.withColumn("side", F.signum(length)), key, seed_key(seed, F.col(key)), d.count(), "side")
    d = d.withColumn("mega", F.floor(F.col("place") / mega)).drop("place")
    inside = F.row_number().over(Window.partitionBy("side", "mega").orderBy(F.abs(F.col(length)).desc(), key)) - 1
    return d.withColumn("batch", F.floor(inside / batch))
