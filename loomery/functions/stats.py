"""Statistics as Column expressions and small DataFrame transforms (aggregations and windows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def arithmetic_mean(p: str) -> Column:
    return F.avg(p)


def geometric_mean(p: str) -> Column:
    """0 if any value is not positive; the guard is needed as ln(0) is null and would be skipped."""
    return F.when(F.min(p) <= 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.ln(p))))


def blend(am: Column, gm: Column, alpha: float) -> Column:
    return F.lit(alpha) * am + F.lit(1 - alpha) * gm


def all_pass(p: str, threshold: float) -> Column:
    return F.bool_and(F.col(p) >= threshold)


def mean_sem(x: str) -> tuple[Column, Column]:
    """Mean and standard error; the error of fewer than two values is null."""
    return F.avg(x), F.stddev_samp(x) / F.sqrt(F.count(x))


def share(condition: Column) -> Column:
    return F.avg(condition.cast("double"))


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def movement(delta: Column, step: float) -> dict[str, Column]:
    """Improved, degraded and unchanged counts of a difference."""
    return {"improved": count_if(delta > step), "degraded": count_if(delta < -step), "unchanged": count_if(F.abs(delta) <= step)}


def transitions(before: Column, after: Column) -> dict[str, Column]:
    return {"wrong_to_correct": count_if(~before & after), "correct_to_wrong": count_if(before & ~after)}


def confusion(correct: Column, flagged: Column) -> dict[str, Column]:
    """Positive is "looks good": not flagged. Ratios are null where nothing is counted."""
    tp, fn = count_if(correct & ~flagged), count_if(correct & flagged)
    fp, tn = count_if(~correct & ~flagged), count_if(~correct & flagged)
    return {
        "true_pos": tp, "false_neg": fn, "false_pos": fp, "true_neg": tn,
        "accuracy": F.try_divide(tp + tn, tp + tn + fp + fn), "precision": F.try_divide(tp, tp + fp),
        "recall": F.try_divide(tp, tp + fn), "specificity": F.try_divide(tn, tn + fp), "f1": F.try_divide(2 * tp, 2 * tp + fp + fn),
    }


def group_normalize(d: DataFrame, group: str, reward: str, mode: str = "std", floor: float = 0.0, eps: float = 1e-6, silent: bool = False) -> DataFrame:
    """d with advantage: centred by group, in std mode over max(std, floor) + eps.

    A group of one, or of no spread, has advantage 0 (null if silent).
    """
    if mode not in ("std", "mean"):
        raise ValueError(f"unknown mode {mode}")
    w = Window.partitionBy(group)
    spread = F.stddev_pop(reward).over(w)
    centred = F.col(reward) - F.avg(reward).over(w)
    scaled = centred / (F.greatest(spread, F.lit(floor)) + F.lit(eps)) if mode == "std" else centred
    flat = (F.count(reward).over(w) < 2) | (spread < 1e-8)
    return d.withColumn("advantage", F.when(flat, F.lit(None) if silent else F.lit(0.0)).otherwise(scaled))


def group_stats(d: DataFrame, group: str, reward: str, floor: float = 0.0) -> DataFrame:
    """Groups, those without spread, those under the floor, and the sum of the others' spreads."""
    g = d.groupBy(group).agg(F.count(reward).alias("n"), F.stddev_pop(reward).alias("s"))
    flat = (F.col("n") < 2) | (F.col("s") < 1e-8)
    return g.agg(F.count("*").alias("groups"), count_if(flat).alias("zero_var"), count_if(~flat & (F.col("s") < floor)).alias("floor"), F.coalesce(F.sum(F.when(~flat, F.col("s"))), F.lit(0.0)).alias("std_sum"))


def average_rank(value: str, *keys: str) -> Column:
    """Rank with ties at their mean place, per keys."""
    every = list(keys) or [F.lit(0)]
    return F.rank().over(Window.partitionBy(*every).orderBy(value)) + (F.count("*").over(Window.partitionBy(*every, value)) - 1) / 2


def auroc(d: DataFrame, key: str, label: str, score: str) -> DataFrame:
    """Area under the ROC by key, ties half: Mann-Whitney from average ranks, no pair is formed. Ranks come from counts by score."""
    c = d.groupBy(key, score).agg(F.sum(F.col(label).cast("long")).alias("p"), F.count("*").alias("n"))
    below = Window.partitionBy(key).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("rank", F.coalesce(F.sum("n").over(below), F.lit(0)) + (F.col("n") + 1) / 2)
    s = c.groupBy(key).agg(F.sum("p").alias("pos"), F.sum(F.col("n") - F.col("p")).alias("neg"), F.sum(F.col("p") * F.col("rank")).alias("ranks"))
    return s.select(key, F.try_divide(F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * F.col("neg")).alias("auroc"))


def correlation(x: str, y: str) -> Column:
    """Pearson; null for fewer than 3 pairs or a constant side, where corr() would raise."""
    fine = (F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)) >= 3) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return F.when(fine, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def one_way(d: DataFrame, parent: str, group: str, value: str) -> DataFrame:
    """Random-effects split by parent: within, between (at least 0), icc; parents need two groups of two."""
    g = d.groupBy(parent, group).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(value).alias("n")).where("n >= 2")
    p = g.groupBy(parent).agg(F.avg("v").alias("within"), F.var_samp("m").alias("spread"), F.avg(1 / F.col("n")).alias("inv"), F.count("*").alias("k")).where("k >= 2")
    p = p.withColumn("between", F.greatest(F.col("spread") - F.col("within") * F.col("inv"), F.lit(0.0)))
    return p.select(parent, "within", "between", F.try_divide(F.col("between"), F.col("between") + F.col("within")).alias("icc"))


def pairwise_accuracy(d: DataFrame, group: str, ref: str, lat: str, order: str) -> DataFrame:
    """Over pairs of one group with unequal reference: the share that lat puts in the same order, a tie counting half."""
    a = d.select(F.col(group).alias("g"), F.col(order).alias("o1"), F.col(ref).alias("r1"), F.col(lat).alias("l1"))
    b = d.select(F.col(group).alias("g"), F.col(order).alias("o2"), F.col(ref).alias("r2"), F.col(lat).alias("l2"))
    same = F.signum(F.col("r1") - F.col("r2")) * F.signum(F.col("l1") - F.col("l2"))
    return a.join(b, "g").where("o1 < o2 and r1 <> r2").agg(F.count("*").alias("pairs"), F.avg((same + 1) / 2).alias("accuracy"))


def best_of(d: DataFrame, group: str, ref: str, lat: str, order: str) -> DataFrame:
    """By group: reference of the member that lat picks (first of ties), of a random one (mean), and the best."""
    pick = F.max_by(ref, F.struct(F.col(lat), -F.col(order)))
    return d.groupBy(group).agg(pick.alias("picked"), F.avg(ref).alias("random"), F.max(ref).alias("oracle"))
