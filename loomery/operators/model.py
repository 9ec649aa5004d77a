"""Model calls as a step: a client behind Arrow batches, replies checked, bad ones asked again, results cached by content."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ModelClient(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class EchoClient:
    """A stand-in for tests: answers with the prompt's last line."""

    def generate(self, prompts: list[str]) -> list[str]:
        return [p.rsplit("\n", 1)[-1] for p in prompts]


def call(jobs: DataFrame, client: Callable[[], ModelClient], batch: int = 32) -> DataFrame:
    """jobs (key, prompt) -> (key, reply). A batch that runs out of memory is halved until it fits."""

    def ask(model: ModelClient, prompts: list[str]) -> list[str]:
        try:
            return model.generate(prompts)
        except MemoryError:
            if len(prompts) == 1:
                raise
            half = len(prompts) // 2
            return ask(model, prompts[:half]) + ask(model, prompts[half:])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client()
        for p in parts:
            prompts = p["prompt"].tolist()
            replies = [r for i in range(0, len(prompts), batch) for r in ask(model, prompts[i : i + batch])]
            yield pd.DataFrame({"key": p["key"], "reply": replies})

    return jobs.select("key", "prompt").mapInPandas(run, "key string, reply string")


def validated(jobs: DataFrame, client: Callable[[], ModelClient], reason, stage: Callable[[DataFrame, str], DataFrame], tries: int = 3) -> DataFrame:
    """(key, status, reply, reason, attempts). reason: Column of the reply -> why it is rejected, or null. Equal prompts are asked once.

    stage(df, name) writes an intermediate table and reads it again, as the calls must not be repeated.
    """
    open_ = jobs.groupBy("key").agg(F.min("prompt").alias("prompt"))
    done = None
    for n in range(1, tries + 1):
        got = stage(call(open_, client).withColumn("reason", reason(F.col("reply"))), f"replies-{n}")
        fine = F.col("reason").isNull()
        now = got.where(fine | F.lit(n == tries)).select("key", F.when(fine, "ok").otherwise("failed").alias("status"), "reply", "reason", F.lit(n).alias("attempts"))
        done = now if done is None else done.unionByName(now)
        again = F.concat("prompt", F.lit("\nRejected: "), "reason", F.lit("\n"), F.element_at(F.split("prompt", "\n"), -1))
        open_ = open_.join(got.where(~fine).select("key", "reason"), "key").select("key", again.alias("prompt"))
    return done


def first_reason(*rules: tuple) -> Callable:
    """Ordered rules (name, predicate on the reply): the first that holds is the reason."""

    def reason(reply):
        return F.coalesce(*(F.when(test(reply), F.lit(name)) for name, test in rules))

    return reason


def dropped_if_bad(jobs: DataFrame, client: Callable[[], ModelClient], parse) -> DataFrame:
    """(key, parsed): one try; replies that parse to null are dropped. parse: Column -> Column."""
    return call(jobs, client).select("key", parse(F.col("reply")).alias("parsed")).where(F.col("parsed").isNotNull())


def escalated(jobs: DataFrame, client: Callable[[], ModelClient], templates: list[str], reason, stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """jobs (key, question) -> (key, stage, reply, status): templates with {} are tried in turn until a reply stands; the last may ask less."""
    open_, done = jobs.select("key", "question"), None
    for n, template in enumerate(templates, 1):
        prompts = open_.select("key", F.replace(F.lit(template), F.lit("{}"), F.col("question")).alias("prompt"))
        got = stage(call(prompts, client).withColumn("reason", reason(F.col("reply"))), f"stage-{n}")
        fine = F.col("reason").isNull()
        now = got.where(fine | F.lit(n == len(templates))).select("key", F.lit(n).alias("stage"), "reply", F.when(fine, "ok").otherwise("failed").alias("status"))
        done = now if done is None else done.unionByName(now)
        open_ = open_.join(got.where(~fine).select("key"), "key", "left_semi")
    return done


def scored(d: DataFrame, key: str, items: str, scorer: Callable[[], Callable[[list], list[float]]]) -> DataFrame:
    """(key, scores): a scorer, made once a task, over lists of items."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for p in parts:
            yield pd.DataFrame({key: p[key], "scores": [score(list(x)) for x in p[items]]})

    kind = d.schema[key].dataType.simpleString()
    return d.select(key, items).mapInPandas(run, f"{key} {kind}, scores array<double>")


#: Row transforms that a job can name.
TRANSFORMS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def transform(name: str):
    """Register a row transform under a name."""

    def add(f):
        if name in TRANSFORMS:
            raise ValueError(f"{name} is registered already")
        TRANSFORMS[name] = f
        return f

    return add


def named(name: str) -> Callable[[DataFrame], DataFrame]:
    if name not in TRANSFORMS:
        raise ValueError(f"unknown transform {name}; there are {sorted(TRANSFORMS)}")
    return TRANSFORMS[name]
