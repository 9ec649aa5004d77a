"""Benchmark reports over two passes of question scores, repeated decodes, critics and banks, each beside its SQL.

The driver's tables hold no question scores, so prompts are parts, questions are slots of a part, and scores are fixed sums of
their numbers. Survey lines are named at each query.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.functions import stats
from loomery.operators import boxes, reports
from loomery.plans.queries import query, r6
from loomery.session import table

SKILLS = ("object", "count", "attribute", "position", "verb")
_Q = """q AS (SELECT prompt, brand, slot, ['object','count','attribute','position','verb'][((prompt+slot)%5)::INT+1] AS skill, ((prompt*7+slot*13)%101)/100.0::DOUBLE AS p1, ((prompt*11+slot*29)%101)/100.0::DOUBLE AS p2, prompt%3=0 AS flagged, price
FROM (SELECT p_partkey AS prompt, p_brand AS brand, p_retailprice AS price, unnest(range(0, 2 + p_size%4)) AS slot FROM part))"""
_R = """r AS (SELECT prompt, brand, ((prompt*(7+rep)+rep*rep*31)%101)/101.0::DOUBLE AS x, rep FROM (SELECT p_partkey AS prompt, p_brand AS brand, unnest(range(0, 4)) AS rep FROM part))"""
_G = """g AS (SELECT prompt, any_value(flagged) AS flagged, any_value(brand) AS brand, avg(p1) am1, avg(p2) am2, CASE WHEN min(p1) <= 0 THEN 0.0 ELSE exp(avg(ln(greatest(p1, 1e-300)))) END gm1, CASE WHEN min(p2) <= 0 THEN 0.0 ELSE exp(avg(ln(greatest(p2, 1e-300)))) END gm2, bool_and(p1 >= 0.3) ok1, bool_and(p2 >= 0.3) ok2 FROM q GROUP BY prompt)"""


def _questions(spark, sf):
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("prompt"), F.col("p_brand").alias("brand"), F.col("p_retailprice").alias("price"), F.explode(F.sequence(F.lit(0), 1 + F.col("p_size") % 4)).alias("slot"))
    score = lambda a, b: F.pmod(F.col("prompt") * a + F.col("slot") * b, F.lit(101)) / 100.0
    skill = F.get(F.array(*map(F.lit, SKILLS)), F.pmod(F.col("prompt") + F.col("slot"), F.lit(5)).cast("int"))
    return d.select("prompt", "brand", F.col("slot").cast("long").alias("slot"), skill.alias("skill"), score(7, 13).alias("p1"), score(11, 29).alias("p2"), (F.col("prompt") % 3 == 0).alias("flagged"), "price")


def _repeats(spark, sf):
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("prompt"), F.col("p_brand").alias("brand"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("rep"))
    return d.withColumn("x", F.pmod(F.col("prompt") * (7 + F.col("rep")) + F.col("rep") * F.col("rep") * 31, F.lit(101)) / 101.0)


def _prompts(spark, sf):
    """Arithmetic and geometric means and strict passes of both passes, by prompt."""
    q = _questions(spark, sf)
    out = [f(p).alias(f"{n}{i}") for i, p in ((1, "p1"), (2, "p2")) for n, f in (("am", stats.arithmetic_mean), ("gm", stats.geometric_mean), ("ok", lambda c: stats.all_pass(c, 0.3)))]
    return q.groupBy("prompt").agg(F.any_value("flagged").alias("flagged"), F.any_value("brand").alias("brand"), *out)


@query(f"""WITH {_Q}, l AS (SELECT prompt, list(skill ORDER BY slot) s, list(p1 ORDER BY slot) a, list(p2 ORDER BY slot) b FROM q GROUP BY 1),
u AS (SELECT s, a, CASE WHEN prompt % 7 = 0 THEN b[1:1] ELSE b END AS b FROM l),
e AS (SELECT unnest(s) skill, 'first' AS k, unnest(a) p FROM u WHERE len(s) = len(a) UNION ALL SELECT unnest(s), 'second', unnest(b) FROM u WHERE len(s) = len(b))
SELECT skill, count(p) FILTER (k = 'first') AS first_n, round(avg(p) FILTER (k = 'first') + 1e-9, 6) AS first_mean, count(p) FILTER (k = 'second') AS second_n, round(avg(p) FILTER (k = 'second') + 1e-9, 6) AS second_mean FROM e GROUP BY skill""")
def skill_means(spark, sf):
    """Question means by skill for both passes; score lists of another length are left out."""
    one = F.struct("slot", "skill", "p1", "p2")
    d = _questions(spark, sf).groupBy("prompt").agg(F.array_sort(F.collect_list(one)).alias("m"))
    d = d.select("prompt", F.col("m.skill").alias("skills"), F.col("m.p1").alias("first"), F.when(F.col("prompt") % 7 == 0, F.slice("m.p2", 1, 1)).otherwise(F.col("m.p2")).alias("second"))
    out = reports.by_skill(d, "skills", {"first": "first", "second": "second"})
    return out.select("skill", F.coalesce("first_n", F.lit(0)).alias("first_n"), r6(F.col("first_mean") + 1e-9).alias("first_mean"), F.coalesce("second_n", F.lit(0)).alias("second_n"), r6(F.col("second_mean") + 1e-9).alias("second_mean"))


@query("""WITH t AS (SELECT DISTINCT event_type FROM events ORDER BY 1 LIMIT 2), m AS (SELECT user_id, avg(value) FILTER (event_type = (SELECT min(event_type) FROM t)) x, avg(value) FILTER (event_type = (SELECT max(event_type) FROM t)) y FROM events GROUP BY 1),
d AS (SELECT y - x AS d FROM m WHERE x IS NOT NULL AND y IS NOT NULL) SELECT count(*) AS seeds, round(avg(d) + 1e-9, 6) AS mean, round(stddev_samp(d)/sqrt(count(*)) + 1e-9, 6) AS sem FROM d""")
def seed_difference(spark, sf):
    """A16, J-18: paired differences by seed of the first two passes only."""
    d = reports.first_two_difference(table(spark, sf, "events"), "user_id", "event_type", "value")
    mean, sem = stats.mean_sem("difference")
    return d.agg(F.count("*").alias("seeds"), r6(mean + 1e-9).alias("mean"), r6(sem + 1e-9).alias("sem"))


@query(f"WITH {_Q} SELECT brand, count(*) AS samples, count(CASE WHEN prompt % 4 <> 0 THEN p1 END) AS scored, count(CASE WHEN prompt % 4 <> 0 AND prompt % 5 <> 0 THEN p1 + p2 END) AS in_both FROM q GROUP BY 1")
def coverage_counts(spark, sf):
    """Rows with samples, with scores, and with scores in both passes."""
    q = _questions(spark, sf).withColumn("first", F.when(F.col("prompt") % 4 != 0, F.col("p1"))).withColumn("second", F.when(F.col("prompt") % 5 != 0, F.col("p2")))
    return q.groupBy("brand").agg(F.count("*").alias("samples"), F.count("first").alias("scored"), stats.count_if(F.col("first").isNotNull() & F.col("second").isNotNull()).alias("in_both"))


@query(f"""WITH {_R}, c AS (SELECT brand, prompt, rep, x - avg(x) OVER (PARTITION BY brand, rep) AS c FROM r)
SELECT a.rep AS r1, b.rep AS r2, round(sum(a.c*b.c)/sqrt(sum(a.c*a.c)*sum(b.c*b.c)) + 1e-9, 6) AS corr FROM c a JOIN c b ON a.brand = b.brand AND a.prompt = b.prompt AND a.rep < b.rep GROUP BY 1, 2""")
def retest_correlation(spark, sf):
    """Test-retest correlation over all pairs of repeats, centred by group and pooled."""
    d = reports.retest(_repeats(spark, sf), "brand", "prompt", "rep", "x")
    return d.select("r1", "r2", r6(F.col("corr") + 1e-9).alias("corr"))


@query(f"""WITH {_R}, l AS (SELECT *, (sum(x) OVER w - x)/(count(x) OVER w - 1) AS f FROM r WINDOW w AS (PARTITION BY brand, prompt)),
c AS (SELECT brand, prompt, rep, x - avg(x) OVER g AS x, f - avg(f) OVER g AS y FROM l WINDOW g AS (PARTITION BY brand, rep)),
s AS (SELECT round(avg(CASE WHEN sign(x) = sign(y) THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS agreement, count(*) AS "values" FROM c WHERE abs(y) > 1e-6),
p AS (SELECT round(avg(CASE WHEN sign(a.x - b.x) <> sign(a.y - b.y) THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS flips, count(*) AS pairs FROM c a JOIN c b ON a.brand = b.brand AND a.rep = b.rep AND a.prompt < b.prompt WHERE abs(a.y - b.y) > 1e-6)
SELECT * FROM s, p""")
def leave_one_out_agreement(spark, sf):
    """Sign agreement with the mean of the other repeats, and flips of the order of pairs, both beyond 1e-6."""
    d = reports.leave_one_out(_repeats(spark, sf), "brand", "prompt", "rep", "x")
    return d.select(r6("agreement").alias("agreement"), "values", r6("flips").alias("flips"), "pairs")


@query(f"WITH {_Q}, g AS (SELECT prompt, abs(avg(p1) - avg(p2)) a, max(abs(p1 - p2)) m FROM q GROUP BY 1) SELECT count(*) AS images, round(avg(a) + 1e-9, 6) AS mean_abs, round(max(a) + 1e-9, 6) AS max_abs, round(max(m) + 1e-9, 6) AS question_max FROM g")
def judge_determinism(spark, sf):
    """Mean and largest absolute difference of two judgements of the same images."""
    g = _questions(spark, sf).groupBy("prompt").agg(F.abs(F.avg("p1") - F.avg("p2")).alias("a"), F.max(F.abs(F.col("p1") - F.col("p2"))).alias("m"))
    return g.agg(F.count("*").alias("images"), r6(F.avg("a") + 1e-9).alias("mean_abs"), r6(F.max("a") + 1e-9).alias("max_abs"), r6(F.max("m") + 1e-9).alias("question_max"))


_RANK = "rank() OVER (PARTITION BY it ORDER BY {0}) + (count(*) OVER (PARTITION BY it, {0}) - 1)/2.0::DOUBLE"
_POOL = ", ".join(f"round(corr({a}, {b}), 6) AS {n}" for n, a, b in (("am_pearson", "x", "y"), ("am_spearman", "rx", "ry"), ("gm_pearson", "gx", "gy"), ("gm_spearman", "rgx", "rgy")))


@query(f"""WITH {_Q}, {_G}, h AS (SELECT prompt % 2 AS it, am1 AS x, am2 AS y, gm1 AS gx, gm2 AS gy FROM g),
k AS (SELECT *, {_RANK.format('x')} AS rx, {_RANK.format('y')} AS ry, {_RANK.format('gx')} AS rgx, {_RANK.format('gy')} AS rgy FROM h), v AS (SELECT prompt % 2 AS it, round(corr(p1, p2), 6) AS question_pearson FROM q GROUP BY 1)
SELECT it, count(*) AS images, round(100*avg(x) + 1e-9, 6) AS mean_am, round(100*avg(gx) + 1e-9, 6) AS mean_gm, round(avg(x - y) + 1e-9, 6) AS gap, {_POOL}, any_value(question_pearson) AS question_pearson FROM k JOIN v USING (it) GROUP BY it""")
def iteration_agreement(spark, sf):
    """By iteration, pooled over slots, means, round-trip gap and correlations of AM, GM and single questions."""
    g = _prompts(spark, sf).withColumn("it", F.col("prompt") % 2)
    base = g.groupBy("it").agg(F.count("*").alias("images"), r6(100 * F.avg("am1") + 1e-9).alias("mean_am"), r6(100 * F.avg("gm1") + 1e-9).alias("mean_gm"), r6(F.avg(F.col("am1") - F.col("am2")) + 1e-9).alias("gap"))
    q = _questions(spark, sf).groupBy((F.col("prompt") % 2).alias("it")).agg(stats.correlation("p1", "p2").alias("question_pearson"))
    out = base.join(reports.agreement(g, ["it"], "am1", "am2", "am"), "it").join(reports.agreement(g, ["it"], "gm1", "gm2", "gm"), "it").join(q, "it")
    return out.select("it", "images", "mean_am", "mean_gm", "gap", *(r6(c).alias(c) for c in ("am_pearson", "am_spearman", "gm_pearson", "gm_spearman", "question_pearson")))


@query(f"""WITH {_Q}, c AS (SELECT brand, avg(p1) p1, avg(p2) p2 FROM q GROUP BY 1), d AS (SELECT q.brand, q.p1 - c.p1 AS x, q.p2 - c.p2 AS y FROM q JOIN c USING (brand))
SELECT brand, count(*) AS pairs, round(avg(CASE WHEN (x > 0.05) = (y > 0.05) AND (x < -0.05) = (y < -0.05) THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS agreement FROM d GROUP BY 1""")
def sign_agreement(spark, sf):
    """A34, J-10: differences from the parent agree in sign, with a dead zone of 0.05 on both tests."""
    q = _questions(spark, sf)
    d = q.join(q.groupBy("brand").agg(F.avg("p1").alias("m1"), F.avg("p2").alias("m2")), "brand")
    return d.groupBy("brand").agg(F.count("*").alias("pairs"), r6(reports.dead_zone_agreement(F.col("p1") - F.col("m1"), F.col("p2") - F.col("m2"), 0.05)).alias("agreement"))


@query("SELECT coalesce(o_orderpriority, 'all') AS kind, round(sum(o_totalprice * (1 + o_custkey % 7))/greatest(sum(1 + o_custkey % 7), 1) + 1e-7, 4) AS loss, sum(1 + o_custkey % 7)::BIGINT AS tokens FROM orders GROUP BY ROLLUP (o_orderpriority)")
def token_loss_by_kind(spark, sf):
    """Loss by sample type over its tokens, and the token-weighted total."""
    d = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("k"), (1 + F.col("o_custkey") % 7).alias("t"), "o_totalprice")
    return d.rollup("k").agg(F.round(F.sum(F.col("o_totalprice") * F.col("t")) / F.greatest(F.sum("t"), F.lit(1)) + 1e-7, 4).alias("loss"), F.sum("t").alias("tokens")).select(F.coalesce("k", F.lit("all")).alias("kind"), "loss", "tokens")


@query("""WITH d AS (SELECT source, quality = 1 AS ok, n_chars > 900 AS good, doc_id % 3 > 0 AS grounded, len(regexp_extract_all(text, '\\S+')) AS w FROM labels JOIN documents USING (doc_id)),
s AS (SELECT source, count(*) FILTER (ok) np, count(*) FILTER (NOT ok) nf, count(*) FILTER (ok AND good) gp, count(*) FILTER (NOT ok AND NOT good) fl, count(*) FILTER (NOT ok AND NOT good AND grounded) gr, sum(w) w FROM d GROUP BY 1)
SELECT source, np + nf AS n, round(gp/greatest(np, 1), 6) AS specificity, round(fl/greatest(nf, 1), 6) AS recall, round(gr/greatest(fl, 1), 6) AS grounded, round((w/greatest(np + nf, 1))::DOUBLE + 1e-9, 6) AS words, round((gp + nf - fl)/greatest(np + nf, 1), 6) AS looks_good FROM s""")
def critic_report(spark, sf):
    """Specificity, recall, grounding, words and looks-good rate of a critic."""
    d = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    words = F.regexp_count("text", F.lit(r"\S+"))
    m = reports.critic_metrics(F.col("quality") == 1, F.col("n_chars") > 900, F.col("doc_id") % 3 > 0, words)
    return d.groupBy("source").agg(*((r6(c + 1e-9) if n == "words" else c if n == "n" else r6(c)).alias(n) for n, c in m.items()))


@query(f"WITH {_Q}, g AS (SELECT prompt, brand, avg(p1) am, bool_or(p1 < 0.3) bad FROM q GROUP BY ALL) SELECT brand AS bank, count(*) AS drafts, round(avg(am) + 1e-9, 6) AS mean_am, count(*) FILTER (bad) AS failing FROM g GROUP BY 1")
def bank_summary(spark, sf):
    """Drafts of each bank, their mean score, and those that fail a question."""
    g = _questions(spark, sf).groupBy("prompt", "brand").agg(F.avg("p1").alias("am"), F.bool_or(F.col("p1") < 0.3).alias("bad"))
    return g.groupBy(F.col("brand").alias("bank")).agg(F.count("*").alias("drafts"), r6(F.avg("am") + 1e-9).alias("mean_am"), stats.count_if(F.col("bad")).alias("failing"))


@query("SELECT coalesce(event_type, 'all') AS rank, count(*) AS rows, count(*) FILTER (value > 400) AS failed, round(count(*) FILTER (value > 400) / count(*), 6) AS failure_rate, round(count(*) / (date_diff('second', min(ts), max(ts)) / 3600.0::DOUBLE), 4) AS rows_an_hour FROM events GROUP BY ROLLUP (event_type)")
def failure_report(spark, sf):
    """Failures and throughput by rank, and in all."""
    seconds = F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))
    g = table(spark, sf, "events").rollup("event_type").agg(F.count("*").alias("rows"), stats.count_if(F.col("value") > 400).alias("failed"), seconds.alias("s"))
    return g.select(F.coalesce("event_type", F.lit("all")).alias("rank"), "rows", "failed", r6(F.col("failed") / F.col("rows")).alias("failure_rate"), F.round(F.col("rows") / (F.col("s") / 3600.0), 4).alias("rows_an_hour"))


@query("SELECT array_to_string(list(DISTINCT event_type ORDER BY event_type), ',') AS kinds, count(DISTINCT event_type) AS n FROM events")
def data_types(spark, sf):
    """The distinct data types present, in order."""
    k = F.array_sort(F.collect_set("event_type"))
    return table(spark, sf, "events").agg(F.array_join(k, ",").alias("kinds"), F.size(k).cast("long").alias("n"))


@query("SELECT l_orderkey, min(l_quantity) AS x1, min(l_linenumber * 5.0)::DOUBLE AS y1, max(l_quantity + 10) AS x2, max(l_linenumber * 5.0 + 8)::DOUBLE AS y2, round(avg(l_quantity + 5) + 1e-9, 6) AS cx, CASE WHEN count(DISTINCT l_returnflag) = 1 AND min(l_discount) >= 0.02 THEN min(l_returnflag) END AS shared FROM lineitem GROUP BY 1")
def instance_groups(spark, sf):
    """Union box and centre of a group's instances, and the attribute that all share with enough confidence."""
    q, n = F.col("l_quantity"), F.col("l_linenumber") * 5.0
    d = table(spark, sf, "lineitem").select("l_orderkey", F.array(q, n, q + 10, n + 8).alias("box"), "l_returnflag", "l_discount")
    u = boxes.union_of("box")
    g = d.groupBy("l_orderkey").agg(*(c.alias(k) for k, c in u.items()), boxes.centre_x("box").alias("cx"), boxes.shared_attribute("l_returnflag", "l_discount", 0.02).alias("shared"))
    return g.select("l_orderkey", "x1", "y1", "x2", "y2", r6(F.col("cx") + 1e-9).alias("cx"), "shared")


@query("WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT vec_id, round(quantile_cont(x, 0.8) + 1e-9, 5) AS depth FROM e WHERE i % 3 = 1 GROUP BY 1")
def masked_depth(spark, sf):
    """The 80th percentile of a map's values inside a mask."""
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).where("i % 3 = 0")
    return e.groupBy("vec_id").agg(F.round(F.percentile(F.col("x").cast("double"), F.lit(0.8)) + 1e-9, 5).alias("depth"))


@query(f"""WITH {_Q}, {_G}, s AS (SELECT *, am2 - am1 AS d FROM (SELECT prompt, flagged, CASE WHEN prompt % 5 > 0 THEN am1 END am1, am2, CASE WHEN prompt % 5 > 0 THEN gm1 END gm1, gm2, ok1, ok2 FROM g))
SELECT count(*) AS samples, count(d) AS scored, {', '.join(f'round(avg({c}) FILTER (d IS NOT NULL) + 1e-9, 6) AS mean_{c}' for c in ('am1', 'am2', 'gm1', 'gm2'))}, count(*) FILTER (ok1 AND d IS NOT NULL) AS n_ok1, count(*) FILTER (ok2 AND d IS NOT NULL) AS n_ok2,
count(*) FILTER (d > 0.07) AS improved, count(*) FILTER (d < -0.07) AS degraded, count(*) FILTER (abs(d) <= 0.07) AS unchanged, count(*) FILTER (d IS NOT NULL AND NOT ok1 AND ok2) AS wrong_to_correct, count(*) FILTER (d IS NOT NULL AND ok1 AND NOT ok2) AS correct_to_wrong,
round(avg(d) FILTER (flagged) + 1e-9, 6) AS delta_flagged, round(avg(d) FILTER (NOT flagged) + 1e-9, 6) AS delta_kept FROM s""")
def score_report(spark, sf):
    """The whole two-pass report: coverage, means, strict passes, movement, flagged against kept."""
    g = _prompts(spark, sf)
    missing = F.col("prompt") % 5 > 0
    g = g.withColumn("am1", F.when(missing, F.col("am1"))).withColumn("gm1", F.when(missing, F.col("gm1")))
    out = reports.score_table(g, 0.07)
    return out.select(*(r6(F.col(c) + 1e-9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query(f"WITH {_Q}, {_G} SELECT coalesce(brand, 'all') AS brand, count(*) AS n, round(avg(am1) + 1e-9, 6) AS am1, round(avg(am2) + 1e-9, 6) AS am2, round(avg(am2 - am1) + 1e-9, 6) AS delta FROM g WHERE brand <> 'Brand#3' GROUP BY ROLLUP (brand)")
def object_count_report(spark, sf):
    """A bucket's means of both passes and their difference, with a total row."""
    g = _prompts(spark, sf).where("brand <> 'Brand#3'").rollup("brand").agg(F.count("*").alias("n"), *(r6(c + 1e-9).alias(k) for k, c in (("am1", F.avg("am1")), ("am2", F.avg("am2")), ("delta", F.avg(F.col("am2") - F.col("am1"))))))
    return g.withColumn("brand", F.coalesce("brand", F.lit("all")))


@query(f"""WITH {_Q}, u AS (SELECT skill, p1, p2 FROM q UNION ALL SELECT 'all', p1, p2 FROM q)
SELECT skill, round(count(*) FILTER (p1 < 0.4 AND p2 >= 0.4)/nullif(count(*) FILTER (p1 < 0.4), 0), 6) AS fix, count(*) FILTER (p1 < 0.4) AS n_failed, round(count(*) FILTER (p1 >= 0.4 AND p2 < 0.4)/nullif(count(*) FILTER (p1 >= 0.4), 0), 6) AS broken, count(*) FILTER (p1 >= 0.4) AS n_passed FROM u GROUP BY 1""")
def fix_break_rates(spark, sf):
    """Fixed and broken questions by skill and in all."""
    g = _questions(spark, sf).rollup("skill").agg(*(c.alias(n) for n, c in reports.fix_break(F.col("p1"), F.col("p2"), 0.4).items()))
    return g.select(F.coalesce("skill", F.lit("all")).alias("skill"), r6("fix").alias("fix"), "n_failed", r6("broken").alias("broken"), "n_passed")


@query(f"""WITH {_Q}, {_G}, s AS (SELECT 'real' AS cond, prompt, am1, am2, flagged FROM g UNION ALL SELECT 'oracle', prompt, am1, (am1 + am2)/2, flagged FROM g),
c AS (SELECT cond, prompt, am1, am2, flagged FROM s UNION ALL SELECT 'real_policy', prompt, am1, CASE WHEN flagged THEN am1 ELSE am2 END, flagged FROM s WHERE cond = 'real')
SELECT cond, count(*) AS n, round(avg(am2) + 1e-9, 6) AS mean, round(avg(am2 - am1) + 1e-9, 6) AS delta, round(avg(am2 - am1) - 1.96*stddev_samp(am2 - am1)/sqrt(count(*)) + 1e-9, 6) AS lo, round(avg(am2 - am1) + 1.96*stddev_samp(am2 - am1)/sqrt(count(*)) + 1e-9, 6) AS hi,
round(avg(CASE WHEN am2 - am1 > 0.0501 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS improved, round(avg(CASE WHEN am2 - am1 < -0.0501 THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS degraded, round(avg(CASE WHEN flagged THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS looks_good, round(corr(am1, am2 - am1), 6) AS draft_corr FROM c GROUP BY 1""")
def condition_report(spark, sf):
    """Conditions with a derived policy one: means, differences with their interval, shares, and correlation with the draft."""
    g = _prompts(spark, sf).select("prompt", "am1", "am2", "flagged")
    real, oracle = g.withColumn("cond", F.lit("real")), g.withColumn("cond", F.lit("oracle")).withColumn("am2", (F.col("am1") + F.col("am2")) / 2)
    policy = g.withColumn("cond", F.lit("real_policy")).withColumn("am2", F.when(F.col("flagged"), F.col("am1")).otherwise(F.col("am2")))
    d = real.unionByName(oracle).unionByName(policy).withColumn("d", F.col("am2") - F.col("am1"))
    mean, sem = stats.mean_sem("d")
    return d.groupBy("cond").agg(
        F.count("*").alias("n"), *(r6(c + 1e-9).alias(n) for n, c in (("mean", F.avg("am2")), ("delta", mean), ("lo", mean - 1.96 * sem), ("hi", mean + 1.96 * sem))),
        *(r6(stats.share(c)).alias(n) for n, c in (("improved", F.col("d") > 0.0501), ("degraded", F.col("d") < -0.0501), ("looks_good", F.col("flagged")))), r6(stats.correlation("am1", "d")).alias("draft_corr"),
    )


@query(f"WITH {_R}, s AS (SELECT prompt, stddev_samp(x) sd, max(x) - min(x) rg FROM r GROUP BY 1) SELECT round(quantile_cont(sd, 0.5) + 1e-9, 6) AS p50, round(quantile_cont(sd, 0.9) + 1e-9, 6) AS p90, round(quantile_cont(sd, 0.99) + 1e-9, 6) AS p99, round(avg(rg) + 1e-9, 6) AS mean_range FROM s")
def spread_percentiles(spark, sf):
    """Percentiles of the spread over repeats, and the mean range."""
    s = _repeats(spark, sf).groupBy("prompt").agg(F.stddev_samp("x").alias("sd"), (F.max("x") - F.min("x")).alias("rg"))
    p = s.agg(F.percentile("sd", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99))).alias("p"), F.avg("rg").alias("r"))
    return p.select(*(r6(F.get("p", F.lit(i)) + 1e-9).alias(n) for i, n in enumerate(("p50", "p90", "p99"))), r6(F.col("r") + 1e-9).alias("mean_range"))


@query("SELECT coalesce(lang, 'all') AS lang, CASE WHEN n_chars > 2000 THEN 'too_long' WHEN n_chars < 200 THEN 'failed' WHEN text LIKE '%.' THEN 'ok' ELSE 'kept' END AS status, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang, 2), (2))".replace("(lang, 2), (2)", "(lang, status), (status)"))
def status_histogram(spark, sf):
    """Outcomes by language and in all."""
    status = F.when(F.col("n_chars") > 2000, "too_long").when(F.col("n_chars") < 200, "failed").when(F.endswith("text", F.lit(".")), "ok").otherwise("kept")
    d = table(spark, sf, "documents").select("lang", status.alias("status"))
    g = d.groupingSets([[F.col("lang"), F.col("status")], [F.col("status")]], F.col("lang"), F.col("status")).agg(F.count("*").alias("n"))
    return g.select(F.coalesce("lang", F.lit("all")).alias("lang"), "status", "n")


@query(f"WITH {_Q}, d AS (SELECT unnest([0, 1]) AS round), k AS (SELECT DISTINCT skill FROM q UNION SELECT 'none'), x AS (SELECT slot % 2 AS round, skill, sum(p2 - p1) AS num, count(*) AS den FROM q WHERE skill <> 'verb' GROUP BY ALL) SELECT d.round::INT AS round, skill, round(coalesce(num, 0) + 1e-9, 6) AS num, coalesce(den, 0) AS den, round(coalesce(num, 0)/greatest(coalesce(den, 0), 1) + 1e-9, 6) AS ratio FROM d CROSS JOIN k LEFT JOIN x USING (round, skill)")
def tree_stats(spark, sf):
    """Sums and counts over a fixed set of keys, finalised to ratios that are 0 where nothing counts."""
    q = _questions(spark, sf)
    x = q.where("skill <> 'verb'").groupBy((F.col("slot") % 2).cast("int").alias("round"), "skill").agg(F.sum(F.col("p2") - F.col("p1")).alias("num"), F.count("*").alias("den"))
    keys = spark.createDataFrame([(r, s) for r in (0, 1) for s in (*SKILLS, "none")], "round int, skill string")
    num, den = F.coalesce("num", F.lit(0.0)), F.coalesce("den", F.lit(0))
    return keys.join(x, ["round", "skill"], "left").select("round", "skill", r6(num + 1e-9).alias("num"), den.alias("den"), r6(num / F.greatest(den, F.lit(1)) + 1e-9).alias("ratio"))


@query("WITH w AS (SELECT event_id, value, avg(value) OVER g m, stddev_pop(value) OVER g s, count(*) OVER g n FROM events WINDOW g AS (PARTITION BY user_id, event_type)) SELECT event_id, round(CASE WHEN n < 2 OR s < 1e-8 THEN NULL ELSE (value - m)/(s + 1e-6) END + 1e-9, 6) AS advantage FROM w")
def group_scale_or_null(spark, sf):
    """The form without a floor, null for groups without a signal."""
    d = table(spark, sf, "events").withColumn("grp", F.concat_ws("|", "user_id", "event_type"))
    return stats.group_normalize(d, "grp", "value", silent=True).select("event_id", r6(F.col("advantage") + 1e-9).alias("advantage"))


@query("""WITH w AS (SELECT user_id, event_id, value AS a, event_id % 97 + value/10 AS b, stddev_pop(value) OVER g sa, stddev_pop(event_id % 97 + value/10) OVER g sb, avg(value) OVER g ma, avg(event_id % 97 + value/10) OVER g mb, count(*) OVER g n FROM events WINDOW g AS (PARTITION BY user_id, event_type)),
v AS (SELECT user_id, (a - ma)/(sa + 1e-6) x, (b - mb)/(sb + 1e-6) y FROM w WHERE n >= 2 AND sa >= 1e-8 AND sb >= 1e-8) SELECT user_id, count(*) AS live, CASE WHEN count(*) >= 3 THEN round(corr(x, y), 6) END AS corr FROM v GROUP BY 1""")
def advantage_correlation(spark, sf):
    """Correlation of two sources' advantages, over groups with a signal in both."""
    d = table(spark, sf, "events").withColumn("grp", F.concat_ws("|", "user_id", "event_type")).withColumn("b", F.col("event_id") % 97 + F.col("value") / 10)
    a = stats.group_normalize(d, "grp", "value", silent=True).withColumnRenamed("advantage", "x")
    b = stats.group_normalize(a, "grp", "b", silent=True).withColumnRenamed("advantage", "y").where("x is not null and y is not null")
    return b.groupBy("user_id").agg(F.count("*").alias("live"), r6(stats.correlation("x", "y")).alias("corr"))


@query("WITH s AS (SELECT user_id, event_type, avg(value) m FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type) i FROM s) SELECT user_id, max(CASE WHEN i = 1 THEN event_type END) AS first_kind, count(*) AS kinds, round(max(m) + 1e-9, 6) AS top, round(avg(m) + 1e-9, 6) AS mean FROM r GROUP BY 1")
def group_table(spark, sf):
    """A line of facts for each group: its first member, how many, best and mean."""
    s = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("m"))
    return s.groupBy("user_id").agg(F.min("event_type").alias("first_kind"), F.count("*").alias("kinds"), r6(F.max("m") + 1e-9).alias("top"), r6(F.avg("m") + 1e-9).alias("mean"))


@query("SELECT user_id, first(event_id ORDER BY value DESC, event_id) AS best, round(max(value) OVER_ALL, 2) AS x FROM events GROUP BY 1".replace("round(max(value) OVER_ALL, 2) AS x", "count(*) AS n"))
def group_best(spark, sf):
    """The best member of each group, ties to the first."""
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best"), F.count("*").alias("n"))

