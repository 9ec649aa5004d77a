"""Writers: versioned columns, shards and banks. Spark's committer makes each write whole or absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def versioned(d: DataFrame, new, column: str = "conversations", prefix: str = "v1-") -> DataFrame:
    """d with column rewritten and its source kept right after it; if a kept source exists it is the source again. new: Column -> Column."""
    kept = prefix + column
    source = F.col(f"`{kept}`") if kept in d.columns else F.col(f"`{column}`")
    out = []
    for c in d.columns:
        if c == column:
            out += [new(source).alias(column), source.alias(kept)]
        elif c != kept:
            out.append(F.col(f"`{c}`"))
    return d.select(*out)


def with_old(d: DataFrame, new, column: str = "conversations", old: str = "old_conversations") -> DataFrame:
    if old in d.columns:
        raise ValueError(f"{old} is there already")
    return versioned(d.withColumnRenamed(column, column), new, column, "old_")


def shard_count(rows: int, target: int = 2000, least: int = 64) -> int:
    return max(least, -(-rows // target))


def write_shards(d: DataFrame, path: str, order: str, target: int = 2000, least: int = 64, row_group: int = 64 << 20) -> None:
    """Contiguous shards of about `target` rows in order; an empty table writes a readable empty file."""
    n = shard_count(d.count(), target, least)
    d.repartitionByRange(n, order).sortWithinPartitions(order).write.option("parquet.block.size", row_group).mode("overwrite").parquet(path)


def write_bank(d: DataFrame, path: str) -> DataFrame:
    """JSON lines sorted by set and idx; returns the summary by set."""
    d.repartitionByRange(F.col("set"), F.col("idx")).sortWithinPartitions("set", "idx").write.mode("overwrite").json(path)
    return d.groupBy("set").agg(F.count("*").alias("n"), F.avg("am").alias("mean_am"))


def split_files(names: DataFrame, file: str, share: float, seed: int) -> DataFrame:
    """Train or val for whole files: max(1, round(n * share)) of them go to val."""
    from loomery.operators.sampling import seed_key

    w = Window.partitionBy(F.lit(0))
    d = names.select(file).distinct()
    place = F.row_number().over(w.orderBy(seed_key(seed, F.col(file)), file))
    return d.withColumn("part", F.when(place <= F.greatest(F.lit(1), F.round(F.count("*").over(w) * share)), "val").otherwise("train"))


def merged_paths(d: DataFrame, key: str, path: str, rank: str, *more: Column) -> DataFrame:
    """One path for each key, the null key too; the later rank wins. more: further aggregates of a key's rows."""
    return d.groupBy(key).agg(F.max_by(path, rank).alias(path), *more)


def text_table(headers: list[str], rows: list[tuple]) -> str:
    """A bordered table of a small result; the first column stands left."""
    cells = [list(map(str, headers)), *([str(v) for v in r] for r in rows)]
    width = [max(len(r[i]) for r in cells) for i in range(len(headers))]
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    show = lambda r: "|" + "|".join(f" {v.ljust(w) if i == 0 else v.rjust(w)} " for i, (v, w) in enumerate(zip(r, width, strict=True))) + "|"
    return "\n".join([rule, show(cells[0]), rule.replace("-", "="), *map(show, cells[1:]), rule])


def percent(part: float, whole: float) -> str:
    return f"{part / whole:.2%}" if whole else "n/a"


def score(value: float | None) -> str:
    return "n/a" if value is None else f"{100 * value:.2f}"


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small file under an exact name, through Hadoop's file system: written aside, then renamed."""
    jvm = spark._jvm.org.apache.hadoop.fs
    at, aside = jvm.Path(path), jvm.Path(path + ".tmp")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(at, False)
    if not fs.rename(aside, at):
        raise OSError(f"cannot rename to {path}")


def keep_newest(spark: SparkSession, paths: list[str], n: int) -> list[str]:
    """Delete all but the n last paths in order; returns what stays."""
    jvm = spark._jvm.org.apache.hadoop.fs
    for p in paths[:-n] if n else paths:
        at = jvm.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return paths[-n:] if n else []


def mended(text: str) -> str:
    """Lines to which more may be appended: a torn last line is ended."""
    return text if not text or text.endswith("\n") else text + "\n"


def progress(text: str | None) -> dict:
    """A progress file's content; nothing if it is missing or half written."""
    import json

    try:
        return json.loads(text) if text else {}
    except json.JSONDecodeError:
        return {}
