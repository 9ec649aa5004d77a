"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Within a source the documents stand in one fixed order. Each is expected `target / source size` times, the prefix
sum of these expectations plus one random offset (a hash of seed and source) runs through the whole numbers, and a
document is emitted once for each whole number that its own step crosses. The order puts documents of like length
next to each other, so that the words taken follow the target closely.

The prefix sum is in two levels, so that no task holds a source: chunks of (source, bit length of the size, two hex
digits of a hash of the id) are counted with map-side combining, counts are summed over the few thousand chunks of
a source, and a window numbers the rows inside a chunk.

Defined results: null text has size 0; a null source is a source of its own that comes last; repeated rows are
rows of their own; sources of size 0 have target 0 and give nothing; an empty table gives an empty table. Columns of
the input stay unless an output column has the same name, which then replaces it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomery.llm.common import staged, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST, SEED = 1.5, 2.0, 17


def _offset(key: Column, seed: int) -> Column:
    """Between 0 and 1, from 28 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 7), 16, 10).cast("double") / F.lit(float(16**7))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> also weight and target: a share of all sizes by weight, filled up to `most` times each size."""
    everywhere = Window.partitionBy(F.lit(0))
    by_name = everywhere.orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*map(F.lit, weights))
    d = sizes.withColumn("_rank", F.row_number().over(by_name))
    d = d.withColumn("weight", F.get(weight, (F.col("_rank") - 1) % len(weights))).withColumn("_cap", F.col("source_size") * F.lit(most))
    fill = everywhere.orderBy(F.col("_cap") / F.col("weight"), "_rank")
    total = F.sum("source_size").over(everywhere) * F.lit(share)
    before = F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    d = d.withColumn("_level", (total - before) / rest).withColumn("_place", F.row_number().over(fill))
    free = F.when(F.col("_cap") > F.col("weight") * F.col("_level"), F.col("_place"))
    d = d.withColumn("_first", F.min(free).over(everywhere))
    d = d.withColumn("_fill", F.min(F.when(F.col("_place") == F.col("_first"), F.col("_level"))).over(everywhere))
    full = F.col("_first").isNull() | (F.col("_place") < F.col("_first"))
    return d.select("source", "source_size", "weight", F.when(full, F.col("_cap")).otherwise(F.col("weight") * F.col("_fill")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, keep_text: bool = True) -> DataFrame:
    """docs with size, source_size, target, copies and taken (copies * size). copies is at most ceil(most)."""
    out = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in docs.columns if c not in out and (keep_text or c != "text")]
    key = F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.withColumn("size", size)
    d = d.select(
        *kept,
        "size",
        key.alias("_key"),
        F.length(F.bin("size")).alias("_class"),
        F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 2).alias("_h"),
    )
    chunk = ["_key", "_class", "_h"]
    counted = staged(d.groupBy(*chunk).agg(F.count("*").alias("_n"), F.sum("size").alias("_words")), "mix-chunks")
    sizes = counted.groupBy("_key").agg(F.sum("_words").alias("source_size"))
    goal = targets(sizes.withColumn("source", F.when(F.col("_key") != "0", F.substring("_key", 2, 1 << 30))), weights, share, most)
    goal = goal.withColumn("_key", F.when(F.col("source").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source")))).drop("source", "weight")
    goal = goal.withColumn("_step", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    before = Window.partitionBy("_key").orderBy("_class", "_h").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n", "_words").join(goal, "_key")
    inside = Window.partitionBy(*chunk).orderBy("size", F.col("doc_id").asc_nulls_first())
    d = d.withColumn("_i", F.row_number().over(inside)).join(base, chunk)
    place, offset = F.col("_base") + F.col("_i"), _offset(F.col("_key"), seed)
    crossed = F.floor(F.col("_step") * place + offset) - F.floor(F.col("_step") * (place - 1) + offset)
    d = d.withColumn("copies", F.least(crossed.cast("int"), F.lit(int(-(-most // 1)))))
    return d.withColumn("taken", F.col("copies") * F.col("size")).select(*kept, *out)


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: every document as often as it is drawn, with the columns of docs."""
    whole = docs.select("doc_id", "source", "text", F.struct(*(F.col(c) for c in docs.columns)).alias("_whole"))
    drawn = mix(whole, **options).where("copies > 0")
    return drawn.select("_whole", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("_whole.*")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, keep_text=False).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM s),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM r),
f AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
  / sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl, row_number() OVER (ORDER BY cap / weight, rk) AS place FROM w),
g AS (SELECT *, min(CASE WHEN cap > weight * lvl THEN place END) OVER () AS first_free FROM f),
t AS (SELECT source, source_size, CASE WHEN first_free IS NULL OR place < first_free THEN cap
  ELSE weight * min(CASE WHEN place = first_free THEN lvl END) OVER () END AS target FROM g),
n AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS step,
  row_number() OVER (PARTITION BY d.source ORDER BY length(CASE WHEN size = 0 THEN '0' ELSE bin(size) END), substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2), size, doc_id NULLS FIRST) AS i,
  ('0x' || substr(md5('17:' || CASE WHEN d.source IS NULL THEN '0' ELSE '1' || d.source END), 1, 7))::BIGINT / 268435456.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (least(floor(step * i + u) - floor(step * (i - 1) + u), 2) * size)::BIGINT AS taken FROM n
"""
