"""Labels for the trained operators: which rows may teach, and one label for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True for the third of ids that no model may learn from; a null id is not held out, and has no label either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def teachers(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y) of labelled rows that may teach. Repeated labels of a document vote, a tie is 1; null ids and labels don't count."""
    known = labels.select("doc_id", F.col(column).cast("double").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
