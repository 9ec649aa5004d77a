"""Edge rules on literals."""

import json
import math

import pytest
from pyspark.sql import functions as F

from loomery.functions import lexicon, stats
from loomery.operators import boxes, model, sampling, turns
from loomery.sources import readers, sinks


def one(spark, column, **values):
    return spark.range(1).select(*(v.alias(k) for k, v in values.items()), column.alias("_out")).first()["_out"]


def test_scores(spark):
    d = spark.createDataFrame([("a", 0.5), ("a", 0.0), ("b", 0.25), ("b", 1.0)], "k string, p double")
    got = {r.k: r for r in d.groupBy("k").agg(stats.geometric_mean("p").alias("gm"), stats.arithmetic_mean("p").alias("am")).collect()}
    assert got["a"].gm == 0 and math.isclose(got["b"].gm, 0.5) and got["a"].am == 0.25


def test_groups_without_spread(spark):
    d = spark.createDataFrame([("one", 1.0), ("flat", 2.0), ("flat", 2.0), ("x", 1.0), ("x", 3.0)], "g string, r double")
    got = sorted((r.g, r.advantage) for r in stats.group_normalize(d, "g", "r", eps=0.0).collect())
    assert got == [("flat", 0), ("flat", 0), ("one", 0), ("x", -1), ("x", 1)]
    r = stats.group_stats(d, "g", "r", floor=2.0).first()
    assert (r.groups, r.zero_var, r.floor, r.std_sum) == (3, 2, 1, 1)
    assert stats.group_stats(d.limit(0), "g", "r").first().groups == 0
    with pytest.raises(ValueError):
        stats.group_normalize(d, "g", "r", mode="other")


def test_constant_column_has_no_correlation(spark):
    d = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 4.0)], "x double, y double")
    assert d.agg(stats.correlation("x", "y")).first()[0] is None


def test_lexicon(spark):
    words = ["children", "boxes", "cities", "glasses", "buses", "bus", "firemen", "dogs", "gas", "twelve", "7", "x"]
    d = spark.createDataFrame([(w,) for w in words], "w string").select("w", lexicon.singular(F.col("w")).alias("s"), lexicon.number_of(F.col("w")).alias("n"))
    got = {r.w: (r.s, r.n) for r in d.collect()}
    assert [got[w][0] for w in words[:9]] == ["child", "box", "city", "glass", "buse", "bus", "fireman", "dog", "gas"]
    assert [got[w][1] for w in words[9:]] == [12, 7, None]


def test_turns(spark):
    conv = F.array(turns.turn("human", F.lit("<image>\nDraw")), turns.turn("gpt", F.lit("<image>\nSelf-reflect: bad\nCorrection: Add a cat\n<image>")))
    assert one(spark, turns.correction_of(conv)) == "Add a cat"
    assert one(spark, turns.needs_correction(conv)) is True
    fine = turns.two_turns(F.lit("a"), F.lit("Correction: Looks good."))
    assert one(spark, turns.needs_correction(fine)) is False
    assert one(spark, turns.needs_correction(turns.two_turns(F.lit("a"), F.lit("no marker")))) is True
    assert one(spark, turns.asks_again(F.lit("Self-reflect: x\nCorrection: fix it\nSelf-reflect: y\nCorrection: looks good"))) is True
    assert one(spark, turns.asks_again(F.lit("Self-reflect: x\nCorrection/decision: Looks good."))) is False
    assert one(spark, turns.asks_again(F.lit("Self-reflect: x"))) is False
    assert one(spark, turns.words(F.lit(""))) == 0 and one(spark, turns.words(F.lit(" a\n b "))) == 2
    assert one(spark, turns.length_of(conv, F.lit(True))) == 128 + 2 + 8
    raw = '[{"role": "user", "content": "x"}, {"from": "gpt", "value": "y"}]'
    assert [tuple(t) for t in one(spark, turns.from_json_text(F.lit(raw)))] == [("user", "x"), ("gpt", "y")]
    assert one(spark, turns.fit_codes(F.array(F.lit(5), F.lit(6)), 3)) == [5, 6, 0]
    assert one(spark, turns.until_stop(F.array(F.lit(5), F.lit(9), F.lit(6)), [9])) == [5]
    assert one(spark, turns.clean_steps(F.array(F.lit("1. a"), F.lit(" "), F.lit("2) b")))) == ["a", "b"]
    assert one(spark, turns.answers(F.lit("Yes. no"), F.lit(3))) is None
    assert one(spark, turns.json_part(F.lit('<think>{x}</think> so {"a": {"b": 1}} end'))) == '{"a": {"b": 1}}'


def test_sampling(spark):
    d = spark.range(10).withColumnRenamed("id", "k")
    ids = lambda x: sorted(r.k for r in x.collect())
    assert ids(sampling.by_strategy(d, "end:0", "k")) == list(range(10))
    assert ids(sampling.by_strategy(d, "end:2", "k")) == [8, 9]
    assert ids(sampling.by_strategy(d, "first:25%", "k")) == [0, 1, 2]
    assert ids(sampling.by_strategy(d, "random:4", "k", 1)) == ids(sampling.by_strategy(d, "random:4", "k", 1))
    chunks = [r.chunk for r in sampling.even_chunks(d, "k", 4).orderBy("k").collect()]
    assert [chunks.count(c) for c in range(3)] == [4, 3, 3]


def test_boxes(spark):
    box = lambda *v: F.array(*map(F.lit, map(float, v)))
    assert one(spark, boxes.iou(box(0, 0, 2, 2), box(1, 0, 3, 2))) == pytest.approx(1 / 3)
    assert one(spark, boxes.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0
    d = spark.createDataFrame([(1, [0.0, 0.0, 2.0, 2.0], 0.9), (1, [0.1, 0.0, 2.0, 2.0], 0.8), (1, [5.0, 5.0, 6.0, 6.0], 0.1)], "i int, b array<double>, s double")
    assert sorted(r.s for r in boxes.suppress(d, "i", "b", "s").collect()) == [0.1, 0.9]


def test_readers(spark, tmp_path):
    assert readers.braces("a{1,2}{x,y}.json") == ["a1x.json", "a1y.json", "a2x.json", "a2y.json"]
    assert readers.variants(["conversations_10", "conversations_2", "conversations"]) == ["conversations_2", "conversations_10"]
    (tmp_path / "list.json").write_text(json.dumps([{"k": 1}, {"k": 2}], indent=1))
    (tmp_path / "lines.jsonl").write_text('{"k": 3}\n\n{"k": 4}\n')
    assert sorted(r.k for r in readers.records(spark, str(tmp_path / "list.json")).collect()) == [1, 2]
    both = readers.mixture(spark, [{"json_path": str(tmp_path / "list.json"), "sampling_strategy": "first:1"}, {"json_path": str(tmp_path / "lines.jsonl")}], "k")
    assert sorted((r.entry, r.k) for r in both.collect()) == [(0, 1), (1, 3), (1, 4)]
    (tmp_path / "c.jsonl").write_text('{"key": "a", "status": "old"}\n{"key": "a", "status": "new"}\n{"key": "b", "sta')
    assert [(r.key, r.status) for r in readers.cache(spark, str(tmp_path / "c.jsonl"), "key string, status string").collect()] == [("a", "new")]
    (tmp_path / "log.txt").write_text("ITER-1:\nTag Group: overall\nh\n 0.10 0.20 0.30\nITER-2:\nTag Group: overall\nh\n0.4 0.5 0.6\n")
    rows = readers.iteration_log(spark, str(tmp_path / "log.txt"), ["x", "y", "z"]).collect()
    assert sorted((r.iteration, r.metric, r.value) for r in rows) == [(1, "x", 0.1), (1, "y", 0.2), (1, "z", 0.3), (2, "x", 0.4), (2, "y", 0.5), (2, "z", 0.6)]
    (tmp_path / "s.txt").write_text("==== Basic ====\nm_iter1 0.5 0.6\n==== Other ====\nm_iter1 1 2\n")
    assert [tuple(r)[1:] for r in readers.sections(spark, str(tmp_path / "s.txt"), {"Basic": "basic"}).collect()] == [(1, "basic", 0.5, 0.6)]
    (tmp_path / "p.txt").write_text("# note\nfirst\n\nsecond # not a note\n")
    assert [r.prompt for r in readers.prompts(spark, str(tmp_path / "p.txt")).orderBy("at").collect()] == ["first", "second # not a note"]
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "d"))
    (tmp_path / "d/zz.parquet").write_bytes(b"PAR1 torn file")
    assert readers.parquet(spark, [str(tmp_path / "d")]).count() == 3


def test_sinks(spark):
    d = spark.createDataFrame([("x", "old", 1)], "a string, conversations string, z int")
    once = sinks.versioned(d, F.upper)
    assert once.columns == ["a", "conversations", "v1-conversations", "z"] and once.first()[1:3] == ("OLD", "old")
    assert sinks.versioned(once, lambda c: F.concat(c, F.lit("!"))).first()[1:3] == ("old!", "old")
    assert sinks.shard_count(10) == 64 and sinks.shard_count(1_000_001) == 501
    assert sinks.text_table(["a", "n"], [("x", 1)]).splitlines()[1] == "| a | n |"


def test_model_calls_retry(spark, tmp_path):
    class Stubborn:
        def generate(self, prompts):
            return ["fine" if "Rejected" in p or "easy" in p else "bad" for p in prompts]

    jobs = spark.createDataFrame([("1", "easy"), ("2", "hard"), ("2", "hard")], "key string, prompt string")

    def stage(d, name):
        d.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    got = model.validated(jobs, Stubborn, model.first_reason(("is bad", lambda r: r == "bad")), stage)
    assert sorted((r.key, r.status, r.attempts) for r in got.collect()) == [("1", "ok", 1), ("2", "ok", 2)]


def test_streams(spark, tmp_path):
    from loomery.streaming import streams

    spark.range(5).selectExpr("id", "CAST(id AS DOUBLE) AS value", "timestamp_seconds(id * 40) AS ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, value double, ts timestamp").parquet(str(tmp_path / "in"))
    streams.appended(stream, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert kept.count() == 5
    assert sorted(r.n for r in streams.windowed(kept, "ts", "1 minute", "1 minute").collect()) == [1, 2, 2]
    assert streams.epochs(kept, 3).count() == 15
