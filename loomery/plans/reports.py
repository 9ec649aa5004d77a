"""Queries for rollout trees, judge noise and text parsing, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomery.functions import lexicon, stats
from loomery.operators import turns
from loomery.plans.queries import QUERIES, SQL, query, r6  # noqa: F401
from loomery.session import table

#: Added before rounding on both sides, so that means of two-decimal values never stand on a tie.
TIE = 1e-9


@query("""WITH c AS (SELECT user_id, event_type, event_id, value, avg(value) OVER (PARTITION BY user_id, event_type) cm, value - avg(value) OVER (PARTITION BY user_id, event_type) AS inner_adv FROM events),
m AS (SELECT user_id, event_type, avg(value) cm FROM events GROUP BY 1, 2), p AS (SELECT user_id, event_type, cm - avg(cm) OVER (PARTITION BY user_id) AS outer_adv FROM m)
SELECT event_id, round(inner_adv + 1e-9, 6) AS inner_adv, round(outer_adv + 1e-9, 6) AS outer_adv FROM c JOIN p USING (user_id, event_type)""")
def two_level_advantage(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value")
    means = e.groupBy("user_id", "event_type").agg(F.avg("value").alias("m"))
    outer = means.withColumn("outer_adv", F.col("m") - F.avg("m").over(Window.partitionBy("user_id")))
    d = e.join(outer, ["user_id", "event_type"])
    return d.select("event_id", r6(F.col("value") - F.col("m") + TIE).alias("inner_adv"), r6(F.col("outer_adv") + TIE).alias("outer_adv"))


@query("SELECT event_id, round(CASE WHEN event_type = 'error' THEN value - coalesce(avg(CASE WHEN event_type <> 'error' THEN value END) OVER (PARTITION BY user_id), 0) ELSE value END, 6) AS reward FROM events")
def sibling_stop_reward(spark, sf):
    refine = F.avg(F.when(F.col("event_type") != "error", F.col("value"))).over(Window.partitionBy("user_id"))
    return table(spark, sf, "events").select("event_id", r6(F.when(F.col("event_type") == "error", F.col("value") - F.coalesce(refine, F.lit(0.0))).otherwise(F.col("value"))).alias("reward"))


@query("SELECT event_id, round(value - 0.5 * greatest(0, 200 - value), 6) AS penalised FROM events")
def stop_penalty(spark, sf):
    return table(spark, sf, "events").select("event_id", r6(F.col("value") - 0.5 * F.greatest(F.lit(0.0), 200 - F.col("value"))).alias("penalised"))


@query("""WITH g AS (SELECT user_id, event_type, var_samp(value) v, avg(value) m FROM events GROUP BY 1, 2 HAVING count(*) >= 2),
p AS (SELECT avg(v) dec, (SELECT var_samp(value) FROM events) obs FROM g) SELECT k, round(obs, 4) AS observed, round(dec, 4) AS noise, round(greatest(obs-dec, 0), 4) AS signal, round(dec/obs, 6) AS noise_share, round(greatest(obs-dec,0)/nullif(greatest(obs-dec,0)+dec/k, 0), 6) AS reliability FROM p, (SELECT unnest([1,2,4,8,16]) k)""")
def noise_reliability(spark, sf):
    e = table(spark, sf, "events")
    noise = e.groupBy("user_id", "event_type").agg(F.var_samp("value").alias("v"), F.count("*").alias("n")).where("n >= 2").agg(F.avg("v").alias("noise"))
    d = e.agg(F.var_samp("value").alias("observed")).join(noise).withColumn("signal", F.greatest(F.col("observed") - F.col("noise"), F.lit(0.0)))
    d = d.withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 4, 8, 16)))))
    reach = F.try_divide(F.col("signal"), F.col("signal") + F.col("noise") / F.col("k"))
    return d.select("k", *(F.round(c, 4).alias(c) for c in ("observed", "noise", "signal")), r6(F.col("noise") / F.col("observed")).alias("noise_share"), r6(reach).alias("reliability"))


@query("""WITH w AS (SELECT user_id, value - 245 AS x, sum(value - 245) OVER (PARTITION BY user_id) s, count(*) OVER (PARTITION BY user_id) n FROM events)
SELECT user_id, round(avg(CASE WHEN sign(x) = sign((s - x)/(n - 1)) THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS agreement FROM w WHERE n > 1 GROUP BY 1""")
def leave_one_out_sign(spark, sf):
    w = Window.partitionBy("user_id")
    d = table(spark, sf, "events").select("user_id", (F.col("value") - 245).alias("x")).withColumn("s", F.sum("x").over(w)).withColumn("n", F.count("*").over(w)).where("n > 1")
    same = F.signum("x") == F.signum((F.col("s") - F.col("x")) / (F.col("n") - 1))
    return d.groupBy("user_id").agg(r6(stats.share(same)).alias("agreement"))


@query("WITH g AS (SELECT user_id, event_type, min(value) < 250 AND max(value) > 250 AS unstable, stddev_samp(value) sd FROM events GROUP BY 1, 2) SELECT event_type, round(avg(CASE WHEN unstable THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS unstable, round(avg(sd), 4) AS sd, round(quantile_cont(sd, 0.9), 4) AS sd90 FROM g GROUP BY 1")
def question_instability(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id", "event_type").agg(((F.min("value") < 250) & (F.max("value") > 250)).alias("u"), F.stddev_samp("value").alias("sd"))
    return g.groupBy("event_type").agg(r6(stats.share(F.col("u"))).alias("unstable"), F.round(F.avg("sd"), 4).alias("sd"), F.round(F.percentile("sd", F.lit(0.9)), 4).alias("sd90"))


@query("WITH b AS (SELECT least(floor(value/100), 4)::INT b, user_id, stddev_samp(value) sd FROM events GROUP BY 1, 2) SELECT b AS bucket, round(sqrt(avg(sd*sd)), 4) AS rms FROM b GROUP BY 1")
def rms_by_bucket(spark, sf):
    b = F.least(F.floor(F.col("value") / 100), F.lit(4)).cast("int").alias("bucket")
    g = table(spark, sf, "events").groupBy(b, "user_id").agg(F.stddev_samp("value").alias("sd"))
    return g.groupBy("bucket").agg(F.round(F.sqrt(F.avg(F.col("sd") * F.col("sd"))), 4).alias("rms"))


@query("""WITH s AS (SELECT user_id, event_type, avg(value) m FROM events GROUP BY 1, 2), p AS (SELECT a.user_id, a.m - b.m d FROM s a JOIN s b ON a.user_id = b.user_id WHERE a.event_type = 'view' AND b.event_type = 'click')
SELECT count(*) AS n, round(avg(d), 4) AS mean, round(stddev_samp(d)/sqrt(count(*)), 4) AS sem, round(avg(d) - 1.96*stddev_samp(d)/sqrt(count(*)), 4) AS lo, round(avg(CASE WHEN d > 0.05 THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS improved FROM p""")
def paired_conditions(spark, sf):
    s = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("m"))
    a, b = (s.where(F.col("event_type") == k).select("user_id", F.col("m").alias(k)) for k in ("view", "click"))
    d = a.join(b, "user_id").select((F.col("view") - F.col("click")).alias("d"))
    mean, sem = stats.mean_sem("d")
    return d.agg(F.count("*").alias("n"), F.round(mean, 4).alias("mean"), F.round(sem, 4).alias("sem"), F.round(mean - 1.96 * sem, 4).alias("lo"), r6(stats.share(F.col("d") > 0.05)).alias("improved"))


@query("""WITH q AS (SELECT quality = 1 AS pos, n_chars / 10000.0::DOUBLE AS p FROM labels JOIN documents USING (doc_id)) SELECT round(avg(p) FILTER (pos), 6) AS p_pos, round(avg(p) FILTER (NOT pos), 6) AS p_neg, round(avg(CASE WHEN (p >= 0.5) = pos THEN 1.0 ELSE 0.0 END)::DOUBLE, 6) AS accuracy FROM q""")
def decision_metrics(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select((F.col("quality") == 1).alias("pos"), (F.col("n_chars") / 10000.0).alias("p"))
    return d.agg(r6(F.avg(F.when(F.col("pos"), F.col("p")))).alias("p_pos"), r6(F.avg(F.when(~F.col("pos"), F.col("p")))).alias("p_neg"), r6(stats.share((F.col("p") >= 0.5) == F.col("pos"))).alias("accuracy"))


_ITEM = "'<error><type>' || lang || '</type><original>' || substr(md5(text), 1, 6) || '</original></error><error><type>x</type><original>' || source || '</original></error>'"


@query(f"SELECT doc_id, unnest(regexp_extract_all({_ITEM}, '<type>(.*?)</type>', 1)) AS kind, unnest(regexp_extract_all({_ITEM}, '<original>(.*?)</original>', 1)) AS original FROM documents")
def error_markup(spark, sf):
    t = F.concat(F.lit("<error><type>"), "lang", F.lit("</type><original>"), F.substring(F.md5("text"), 1, 6), F.lit("</original></error><error><type>x</type><original>"), "source", F.lit("</original></error>"))
    take = lambda tag: F.regexp_extract_all("t", F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    d = table(spark, sf, "documents").select("doc_id", t.alias("t"))
    return d.select("doc_id", F.explode(F.arrays_zip(take("type").alias("kind"), take("original").alias("original"))).alias("x")).select("doc_id", "x.kind", "x.original")


@query("SELECT conv_id, turn, coalesce(nullif(trim(text), ''), '(empty)') AS text, CASE WHEN turn = 0 THEN 'd' || conv_id ELSE 'd' || conv_id || 'c' || lpad(turn::VARCHAR, 2, '0') END AS slot FROM conversations")
def slot_names(spark, sf):
    d = table(spark, sf, "conversations")
    root = F.concat(F.lit("d"), F.col("conv_id").cast("string"))
    slot = F.when(F.col("turn") == 0, root).otherwise(F.concat(root, F.lit("c"), F.lpad(F.col("turn").cast("string"), 2, "0")))
    return d.select("conv_id", "turn", F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit("(empty)")).alias("text"), slot.alias("slot"))


@query("SELECT s_suppkey, (s_suppkey % 25)::INT + (s_suppkey % 7)::INT AS raw, CASE WHEN (CASE WHEN s_suppkey % 25 <= 20 THEN s_suppkey % 25 ELSE s_suppkey % 25 END + s_suppkey % 7) = 0 THEN NULL ELSE s_suppkey % 25 + s_suppkey % 7 END::INT AS objects FROM supplier")
def requested_objects(spark, sf):
    a, b = (F.col("s_suppkey") % 25).cast("int"), (F.col("s_suppkey") % 7).cast("int")
    d = table(spark, sf, "supplier").select("s_suppkey", (a + b).alias("raw"), F.array(lexicon.number_word(a), lexicon.number_word(b), F.lit("some")).alias("w"))
    return d.select("s_suppkey", "raw", lexicon.requested_objects(F.col("w")).alias("objects"))


@query("""WITH d AS (SELECT DISTINCT event_type FROM events), u AS (SELECT DISTINCT user_id FROM events), n AS (SELECT user_id, event_type, sum(value) num, count(*) den FROM events GROUP BY 1, 2)
SELECT u.user_id, d.event_type, round(coalesce(num, 0)/greatest(coalesce(den, 0), 1) + 1e-9, 6) AS ratio FROM u CROSS JOIN d LEFT JOIN n USING (user_id, event_type)""")
def fixed_key_stats(spark, sf):
    e = table(spark, sf, "events")
    kinds = e.agg(F.array_sort(F.collect_set("event_type")).alias("kinds"))  # a handful of kinds
    keys = e.select("user_id").distinct().join(F.broadcast(kinds)).select("user_id", F.explode("kinds").alias("event_type"))
    n = e.groupBy("user_id", "event_type").agg(F.sum("value").alias("num"), F.count("*").alias("den"))
    ratio = F.coalesce("num", F.lit(0.0)) / F.greatest(F.coalesce("den", F.lit(0)), F.lit(1))
    return keys.join(n, ["user_id", "event_type"], "left").select("user_id", "event_type", r6(ratio + TIE).alias("ratio"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace('A photo of ' || text, '(?i)^a photo of \\s*', ''), '\\s+', ' ', 'g')) AS caption FROM documents".replace("\\\\", "\\"))
def plain_captions(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", turns.plain_caption(turns.strip_photo_of(F.concat(F.lit("A photo of "), "text"))).alias("caption"))
