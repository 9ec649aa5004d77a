"""Geometry of boxes (x1, y1, x2, y2) as expressions, spatial relations, and greedy suppression by image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    wide = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    high = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(overlap(a, b), area(a) + area(b) - overlap(a, b)), F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Share of the smaller box that the overlap takes."""
    return F.coalesce(F.try_divide(overlap(a, b), F.least(area(a), area(b))), F.lit(0.0))


def relation(a: Column, b: Column, margin: float) -> Column:
    """left, right, above or below by the centres, if one axis leads by the margin; else null."""
    dx, dy = (b[0] + b[2] - a[0] - a[2]) / 2, (b[1] + b[3] - a[1] - a[3]) / 2
    return (
        F.when((dx > margin) & (dx >= F.abs(dy)), "left").when((-dx > margin) & (-dx >= F.abs(dy)), "right").when((dy > margin) & (dy > F.abs(dx)), "above").when((-dy > margin) & (-dy > F.abs(dx)), "below")
    )


def union_of(box: str) -> dict[str, Column]:
    """Corners of the union of a group's boxes."""
    c = F.col(box)
    return {"x1": F.min(c[0]), "y1": F.min(c[1]), "x2": F.max(c[2]), "y2": F.max(c[3])}


def centre_x(box: str) -> Column:
    return F.avg((F.col(box)[0] + F.col(box)[2]) / 2)


def shared_attribute(value: str, confidence: str, least: float) -> Column:
    """The value that all instances agree on, each with confidence enough; else null."""
    return F.when((F.count_distinct(value) == 1) & (F.min(confidence) >= least), F.min(value))


def suppress(d: DataFrame, image: str, box: str, score: str, limit: float = 0.5) -> DataFrame:
    """Greedy suppression by image, best score first: an array fold, as each choice depends on those before it."""
    one = F.struct((-F.col(score)).alias("s"), F.col(box).alias("b"))
    listed = d.groupBy(image).agg(F.array_sort(F.collect_list(one)).alias("m"))
    empty = F.array().cast(listed.schema["m"].dataType)
    kept = F.aggregate("m", empty, lambda acc, x: F.when(F.exists(acc, lambda k: iou(k["b"], x["b"]) > limit), acc).otherwise(F.concat(acc, F.array(x))))
    return listed.select(image, F.explode(kept).alias("k")).select(image, F.col("k.b").alias(box), (-F.col("k.s")).alias(score))
