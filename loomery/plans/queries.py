"""Queries over the driver's tables, one or more for each family of operators, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomery.functions import lexicon, stats
from loomery.operators import boxes, relations, sampling, turns
from loomery.session import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Register a query under its name, and its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def _rounded(d: DataFrame) -> DataFrame:
    return d.select(*(r6(c).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes))


_SCORES = "SELECT vec_id, label, 1/(1+exp(-unnest(embedding)::DOUBLE)) AS p FROM embeddings"


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "embeddings").select("vec_id", "label", F.explode("embedding").alias("x"))
    return d.select("vec_id", "label", (1 / (1 + F.exp(-F.col("x").cast("double")))).alias("p"))


@query(f"WITH s AS ({_SCORES}), g AS (SELECT vec_id, avg(p) am, CASE WHEN min(p) <= 0 THEN 0.0 ELSE exp(avg(ln(p))) END gm, bool_and(p >= 0.45) ok FROM s GROUP BY 1) SELECT vec_id, round(am, 6) am, round(gm, 6) gm, round(0.7*am+0.3*gm, 6) blend, ok AS all_pass FROM g")
def am_gm_scores(spark, sf):
    g = _scores(spark, sf).groupBy("vec_id").agg(stats.arithmetic_mean("p").alias("am"), stats.geometric_mean("p").alias("gm"), stats.all_pass("p", 0.45).alias("all_pass"))
    return _rounded(g.withColumn("blend", stats.blend(F.col("am"), F.col("gm"), 0.7)))


@query("WITH w AS (SELECT event_id, value, avg(value) OVER g m, stddev_pop(value) OVER g s, count(*) OVER g n FROM events WINDOW g AS (PARTITION BY user_id)) SELECT event_id, round(CASE WHEN n < 2 OR s < 1e-8 THEN 0.0 ELSE (value - m)/(greatest(s, 0.05)+1e-6) END, 6) AS advantage FROM w")
def group_normalize(spark, sf):
    return _rounded(stats.group_normalize(table(spark, sf, "events"), "user_id", "value", floor=0.05).select("event_id", "advantage"))


@query("WITH w AS (SELECT event_id, value, avg(value) OVER g m, stddev_pop(value) OVER g s, count(*) OVER g n FROM events WINDOW g AS (PARTITION BY user_id, event_type)) SELECT event_id, round(CASE WHEN n < 2 OR s < 1e-8 THEN NULL ELSE value - m END, 6) AS advantage FROM w")
def group_center_or_null(spark, sf):
    d = table(spark, sf, "events").withColumn("grp", F.concat_ws("|", "user_id", "event_type"))
    return _rounded(stats.group_normalize(d, "grp", "value", mode="mean", silent=True).select("event_id", "advantage"))


@query("WITH g AS (SELECT user_id, count(*) n, stddev_pop(value) s FROM events GROUP BY 1) SELECT count(*) AS groups, count(*) FILTER (n < 2 OR s < 1e-8) AS zero_var, count(*) FILTER (n >= 2 AND s >= 1e-8 AND s < 100) AS floor, round(sum(s) FILTER (n >= 2 AND s >= 1e-8), 6) AS std_sum FROM g")
def group_spread_stats(spark, sf):
    return _rounded(stats.group_stats(table(spark, sf, "events"), "user_id", "value", floor=100.0))


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value)/sqrt(count(value)), 6) AS sem FROM events GROUP BY 1")
def mean_sem_by_group(spark, sf):
    mean, sem = stats.mean_sem("value")
    return _rounded(table(spark, sf, "events").groupBy("event_type").agg(mean.alias("mean"), sem.alias("sem")))


_PAIR = "SELECT l.l_returnflag AS flag, o.o_totalprice / 4 AS before, l.l_extendedprice AS after FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey"


def _pair(spark, sf) -> DataFrame:
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_returnflag").alias("flag"), (F.col("o_totalprice") / 4).alias("before"), F.col("l_extendedprice").alias("after"))


@query(f"WITH p AS ({_PAIR}) SELECT flag, round(avg(after-before), 4) AS delta, count(*) FILTER (after-before > 500) AS improved, count(*) FILTER (after-before < -500) AS degraded, count(*) FILTER (abs(after-before) <= 500) AS unchanged, count(*) FILTER (NOT before >= 20000 AND after >= 20000) AS wrong_to_correct, count(*) FILTER (before >= 20000 AND NOT after >= 20000) AS correct_to_wrong FROM p GROUP BY flag")
def paired_movement(spark, sf):
    delta = F.col("after") - F.col("before")
    agg = stats.movement(delta, 500.0) | stats.transitions(F.col("before") >= 20000, F.col("after") >= 20000)
    return _pair(spark, sf).groupBy("flag").agg(F.round(F.avg(delta), 4).alias("delta"), *(c.alias(n) for n, c in agg.items()))


@query("""WITH j AS (SELECT quality = 1 AS c, n_chars > 1500 AS f FROM labels JOIN documents USING (doc_id)),
t AS (SELECT count(*) FILTER (c AND NOT f) tp, count(*) FILTER (c AND f) fn, count(*) FILTER (NOT c AND NOT f) fp, count(*) FILTER (NOT c AND f) tn FROM j)
SELECT tp AS true_pos, fn AS false_neg, fp AS false_pos, tn AS true_neg, round((tp+tn)/nullif(tp+tn+fp+fn,0), 6) AS accuracy, round(tp/nullif(tp+fp,0), 6) AS precision, round(tp/nullif(tp+fn,0), 6) AS recall, round(tn/nullif(tn+fp,0), 6) AS specificity, round(2*tp/nullif(2*tp+fp+fn,0), 6) AS f1 FROM t""")
def confusion_matrix(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return _rounded(j.agg(*(c.alias(n) for n, c in stats.confusion(F.col("quality") == 1, F.col("n_chars") > 1500).items())))


@query("""WITH j AS (SELECT lang, quality q, n_chars x FROM labels JOIN documents USING (doc_id)),
r AS (SELECT lang, q, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1)/2.0 AS r FROM j),
s AS (SELECT lang, sum(q) p, sum(1-q) n, sum(r) FILTER (q=1) rs FROM r GROUP BY lang) SELECT lang, round(((rs - p*(p+1)/2.0)/nullif(p*n, 0))::DOUBLE, 6) AS auroc FROM s""")
def auroc_rank(spark, sf):
    j = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return _rounded(stats.auroc(j, "lang", "quality", "n_chars"))


@query("""WITH r AS (SELECT p_brand, p_size::DOUBLE x, p_retailprice y, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size)-1)/2.0 rx, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice)-1)/2.0 ry FROM part)
SELECT p_brand, round(CASE WHEN count(*) >= 3 AND stddev_pop(x) > 0 AND stddev_pop(y) > 0 THEN corr(x, y) END, 6) AS pearson, round(CASE WHEN count(*) >= 3 AND stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx::DOUBLE, ry::DOUBLE) END, 6) AS spearman FROM r GROUP BY p_brand""")
def pearson_spearman(spark, sf):
    d = table(spark, sf, "part").select("p_brand", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    d = d.withColumn("rx", stats.average_rank("x", "p_brand")).withColumn("ry", stats.average_rank("y", "p_brand"))
    return _rounded(d.groupBy("p_brand").agg(stats.correlation("x", "y").alias("pearson"), stats.correlation("rx", "ry").alias("spearman")))


@query("SELECT count(*) AS pairs, round(avg((sign(a.l_extendedprice-b.l_extendedprice)*sign(a.l_quantity-b.l_quantity)+1)/2), 6) AS accuracy FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_extendedprice <> b.l_extendedprice")
def pairwise_accuracy(spark, sf):
    return _rounded(stats.pairwise_accuracy(table(spark, sf, "lineitem"), "l_orderkey", "l_extendedprice", "l_quantity", "l_linenumber"))


@query("WITH p AS (SELECT o_custkey, first(o_totalprice ORDER BY o_orderkey % 7 DESC, o_orderkey) picked, avg(o_totalprice) random, max(o_totalprice) oracle FROM orders GROUP BY 1) SELECT round(avg(picked), 4) AS picked, round(avg(random), 4) AS random, round(avg(oracle), 4) AS oracle FROM p")
def best_of_n(spark, sf):
    d = table(spark, sf, "orders").withColumn("lat", F.col("o_orderkey") % 7)
    p = stats.best_of(d, "o_custkey", "o_totalprice", "lat", "o_orderkey")
    return p.agg(*(F.round(F.avg(c), 4).alias(c) for c in ("picked", "random", "oracle")))


@query("""WITH g AS (SELECT user_id, event_type, avg(value) m, var_samp(value) v, count(value) n FROM events GROUP BY 1, 2 HAVING count(value) >= 2),
p AS (SELECT user_id, avg(v) within_var, var_samp(m) spread, avg(1.0::DOUBLE/n) inv, count(*) k FROM g GROUP BY 1 HAVING count(*) >= 2), q AS (SELECT *, greatest(spread - within_var*inv, 0) b FROM p)
SELECT user_id, round(within_var, 4) AS "within", round(b, 4) AS between_var, round(b/nullif(b+within_var, 0), 6) AS icc FROM q""")
def variance_icc(spark, sf):
    d = stats.one_way(table(spark, sf, "events"), "user_id", "event_type", "value")
    return d.select("user_id", F.round("within", 4).alias("within"), F.round("between", 4).alias("between_var"), r6("icc").alias("icc"))


@query("SELECT lang, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.9), 6) AS p90, round(quantile_cont(n_chars, 0.99), 6) AS p99 FROM documents GROUP BY 1")
def percentile_buckets(spark, sf):
    p = F.percentile("n_chars", F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)))
    d = table(spark, sf, "documents").groupBy("lang").agg(p.alias("p"))
    return d.select("lang", *(r6(F.get("p", F.lit(i))).alias(n) for i, n in enumerate(("p50", "p90", "p99"))))


@query("WITH q AS (SELECT quantile_cont(n_chars, 0.95) c FROM documents) SELECT doc_id, CASE WHEN n_chars > least(c, 20000) THEN 'too_long' ELSE 'ok' END AS status FROM documents, q")
def length_outliers(spark, sf):
    d = table(spark, sf, "documents")
    cut = d.agg(F.least(F.percentile("n_chars", F.lit(0.95)), F.lit(20000.0)).alias("cut"))
    return d.join(F.broadcast(cut)).select("doc_id", F.when(F.col("n_chars") > F.col("cut"), "too_long").otherwise("ok").alias("status"))


@query("WITH t AS (SELECT doc_id, n_chars, unnest([lang, source, 'all']) tag FROM documents) SELECT tag, count(*) AS n, round(avg(n_chars), 6) AS mean FROM t GROUP BY tag")
def tag_multi_group(spark, sf):
    d = table(spark, sf, "documents").select("n_chars", F.explode(F.array("lang", "source", F.lit("all"))).alias("tag"))
    return d.groupBy("tag").agg(F.count("*").alias("n"), r6(F.avg("n_chars")).alias("mean"))


@query("SELECT coalesce(lang, 'all') AS lang, count(*) AS n, round(sum(n_chars)/greatest(count(*), 1), 6) AS mean FROM documents GROUP BY ROLLUP(lang)")
def token_weighted_totals(spark, sf):
    d = table(spark, sf, "documents").rollup("lang").agg(F.count("*").alias("n"), r6(F.sum("n_chars") / F.greatest(F.count("*"), F.lit(1))).alias("mean"))
    return d.withColumn("lang", F.coalesce("lang", F.lit("all")))


def _conversations(spark, sf) -> DataFrame:
    """(conv_id, conv): turns in order."""
    t = F.struct("turn", F.col("role").alias("from"), F.col("text").alias("value"))
    d = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(t)).alias("c"))
    return d.select("conv_id", F.transform("c", lambda x: turns.turn(x["from"], x["value"])).alias("conv"))


@query(r"SELECT conv_id, count(*) AS turns, sum(CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END)::INT AS words, string_agg(CASE WHEN role = 'assistant' THEN text END, chr(10) ORDER BY turn) AS said FROM conversations GROUP BY 1")
def conversation_rollup(spark, sf):
    d = _conversations(spark, sf)
    said = F.nullif(turns.said(F.col("conv"), turns.ASSISTANT), F.lit(""))
    return d.select("conv_id", F.size("conv").cast("long").alias("turns"), (-turns.length_of(F.col("conv"), F.lit(False))).alias("words"), said.alias("said"))


@query("WITH f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role IN ('human','user') ORDER BY turn) r FROM conversations) SELECT conv_id, string_agg(CASE WHEN role IN ('human','user') AND r = 1 THEN 'Task: ' || text WHEN role IN ('gpt','assistant') THEN replace(text, 'Self-correction', 'Correction') ELSE text END, '|' ORDER BY turn) AS rewritten FROM f GROUP BY 1")
def first_human_prefix(spark, sf):
    d = _conversations(spark, sf).withColumn("conv", turns.prefix_first_human(F.col("conv"), "Task: "))
    return d.select("conv_id", F.array_join(F.transform("conv", lambda t: t["value"]), "|").alias("rewritten"))


@query("WITH f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role IN ('gpt','assistant') ORDER BY turn DESC) r FROM conversations) SELECT conv_id, string_agg(CASE WHEN role IN ('gpt','assistant') AND r = 1 THEN CASE WHEN text LIKE '%' || chr(10) THEN text ELSE text || chr(10) END || 'No correction.' ELSE text END, '|' ORDER BY turn) AS rewritten FROM f GROUP BY 1")
def last_assistant_suffix(spark, sf):
    d = _conversations(spark, sf).withColumn("conv", turns.suffix_last_assistant(F.col("conv"), "No correction."))
    return d.select("conv_id", F.array_join(F.transform("conv", lambda t: t["value"]), "|").alias("rewritten"))


@query("SELECT conv_id, sum(length(text)) FILTER (role IN ('gpt','assistant')) AS trained, sum(length(text)) FILTER (role NOT IN ('gpt','assistant')) AS masked FROM conversations GROUP BY 1")
def role_mask_lengths(spark, sf):
    own = F.col("role").isin(*turns.ASSISTANT)
    n = F.length("text").cast("long")
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(F.when(own, n)).alias("trained"), F.sum(F.when(~own, n)).alias("masked"))


_MARKED = "'Self-reflect: ' || text || chr(10) || 'Correction: ' || CASE WHEN doc_id % 3 = 0 THEN 'Looks good' ELSE source || lang END || chr(10) || '<image>'"


@query(rf"SELECT doc_id, nullif(trim(regexp_extract({_MARKED}, '(?s)Correction\s*:\s*(.*?)(?:<image>|$)', 1), E' \n\t'), '') AS instruction, doc_id % 3 <> 0 AS needs FROM documents")
def correction_markers(spark, sf):
    text = F.concat(F.lit("Self-reflect: "), "text", F.lit("\nCorrection: "), F.when(F.col("doc_id") % 3 == 0, "Looks good").otherwise(F.concat("source", "lang")), F.lit("\n<image>"))
    conv = turns.two_turns(F.lit("draw"), text)
    d = table(spark, sf, "documents").select("doc_id", conv.alias("conv"))
    return d.select("doc_id", F.btrim(turns.correction_of(F.col("conv")), F.lit(" \n\t")).alias("instruction"), turns.needs_correction(F.col("conv")).alias("needs"))


_KEY = "substr(sha256('{}|' || {}), 1, 16)"


@query(f"SELECT doc_id FROM documents ORDER BY {_KEY.format(7, 'doc_id')}, doc_id LIMIT 50")
def hash_topk_sample(spark, sf):
    return sampling.random_n(table(spark, sf, "documents").select("doc_id"), 50, "doc_id", 7)


@query(f"SELECT lang, doc_id, r AS pick FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {_KEY.format(3, 'doc_id')}, doc_id) r FROM documents) WHERE r <= 5")
def stratified_sample(spark, sf):
    return sampling.stratified(table(spark, sf, "documents").select("lang", "doc_id"), 5, "lang", "doc_id", 3).select("lang", "doc_id", F.col("pick").cast("long").alias("pick"))


@query(f"WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_KEY.format(5 * 1000003 + 2, 'o_orderkey')}, o_orderkey) - 1 p, count(*) OVER () n FROM orders) SELECT o_orderkey, p % 4 AS rank, p // 32 AS step FROM o WHERE p < n // 32 * 32")
def epoch_order(spark, sf):
    return sampling.epoch_plan(table(spark, sf, "orders"), "o_orderkey", 5, 2, 4, 8)


@query("SELECT o_orderkey, o_orderkey % 4 AS lane, (o_orderkey // 4) // 10 AS chunk FROM orders")
def strided_plan(spark, sf):
    return sampling.strided(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 4, 10)


@query("WITH c AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 i, count(*) OVER (PARTITION BY o_custkey) n FROM orders), d AS (SELECT *, (n + 2) // 3 AS k FROM c), e AS (SELECT *, n // k s, n % k r FROM d) SELECT o_orderkey, CASE WHEN i < r*(s+1) THEN i // (s+1) ELSE r + (i - r*(s+1)) // s END AS chunk FROM e")
def even_chunks(spark, sf):
    return sampling.even_chunks(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_orderkey", 3, "o_custkey").select("o_orderkey", F.col("chunk").cast("long").alias("chunk"))


@query(f"SELECT doc_id, round, substr(sha256('9|' || round || '|' || source), 1, 16) AS turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS round FROM documents)")
def interleave_order(spark, sf):
    return sampling.interleave(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 9).select("doc_id", F.col("round").cast("long").alias("round"), "turn")


@query("SELECT doc_id, round(-ln(1 - ('0x' || substr(sha256('4|' || doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE) / CASE lang WHEN 'en' THEN 2.0 WHEN 'de' THEN 0.5 ELSE 1.0 END, 6) AS arrival FROM documents")
def weighted_mixture(spark, sf):
    return _rounded(sampling.weighted_order(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", {"en": 2.0, "de": 0.5}, 4).select("doc_id", "arrival"))


@query("WITH p AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY substr(sha256('6|' || doc_id), 1, 16), doc_id) - 1 p FROM documents), m AS (SELECT *, p // 64 mega FROM p) SELECT doc_id, mega, (row_number() OVER (PARTITION BY mega ORDER BY n_chars DESC, doc_id) - 1) // 8 AS batch FROM m")
def length_batches(spark, sf):
    d = sampling.length_batches(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 6, 64, 8)
    return d.select("doc_id", F.col("mega").cast("long").alias("mega"), F.col("batch").cast("long").alias("batch"))


@query("SELECT md5(text) AS key, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def content_dedup(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("key"))
    return relations.keep_first(d, ["key"], ["doc_id"]).select("key", "doc_id")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_per_key(spark, sf):
    return relations.latest(table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_done(spark, sf):
    return relations.not_done(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), ["doc_id"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def semi_bank(spark, sf):
    return relations.wanted(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels").where("quality = 0").select("doc_id"), ["doc_id"])


@query("SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'ok' WHEN l.quality = 0 THEN 'failed' END, 'missing') AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def cache_status(spark, sf):
    cache = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "ok").otherwise("failed").alias("status"))
    return relations.with_status(table(spark, sf, "documents").select("doc_id"), cache, "doc_id")


@query("SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events))")
def complete_siblings(spark, sf):
    return relations.complete_siblings(table(spark, sf, "events"), "user_id", "event_type").select("event_id")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS section, lead(event_id, 2) OVER v AS ahead FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), v AS (PARTITION BY user_id ORDER BY event_id)")
def section_carry_forward(spark, sf):
    mark = F.when(F.col("event_type") == "signup", F.col("event_id"))
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf, "events").select("event_id", relations.carry_forward(None, mark, "event_id", "user_id").alias("section"), F.lead("event_id", 2).over(w).alias("ahead"))


@query("SELECT event_id, (props::JSON->>'k')::INT AS k FROM events")
def json_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("""WITH d AS (SELECT doc_id, list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2), lambda w: substr(w, 1, 5))) s FROM documents),
b AS (SELECT item_id, count(*) OVER () AS n, list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 2), lambda w: substr(w, 1, 5))) s FROM benchmark)
SELECT doc_id, item_id, round(CASE WHEN len(b.s) = 0 THEN 1.0 ELSE len(list_intersect(b.s, d.s)) / len(b.s) END, 6) AS covered FROM d JOIN b ON d.doc_id % b.n = b.item_id""")
def stem_coverage(spark, sf):
    """Each document's coverage of the benchmark item of its turn."""
    b = table(spark, sf, "benchmark").select("item_id", lexicon.prefix_stems(F.col("text")).alias("b"))
    n = b.agg(F.count("*").alias("n"))  # one row
    d = table(spark, sf, "documents").select("doc_id", lexicon.prefix_stems(F.col("text")).alias("s")).join(F.broadcast(n))
    return d.withColumn("item_id", F.col("doc_id") % F.col("n")).join(b, "item_id").select("doc_id", "item_id", r6(lexicon.coverage(F.col("b"), F.col("s"))).alias("covered"))


_WORDS = "['" + "','".join(lexicon.NUMBER_WORDS) + "']"


@query(f"SELECT p_partkey, coalesce({_WORDS}[p_size + 1], p_size::VARCHAR) AS word, CASE WHEN p_size <= 20 THEN p_size END AS back FROM part")
def number_words(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", "p_size", lexicon.number_word(F.col("p_size")).alias("word"))
    return d.select("p_partkey", "word", F.when(~F.col("word").rlike("[0-9]"), lexicon.number_of(F.col("word"))).alias("back"))


_BOX = "[l_quantity, l_linenumber * 5.0, l_quantity + 10, l_linenumber * 5.0 + 8]"


@query("""WITH b AS (SELECT l_orderkey k, l_linenumber i, l_quantity::DOUBLE x1, l_linenumber*5.0::DOUBLE y1, l_quantity+10::DOUBLE x2, l_linenumber*5.0+8::DOUBLE y2 FROM lineitem),
p AS (SELECT a.k, a.i AS a, b.i AS b, greatest(least(a.x2,b.x2)-greatest(a.x1,b.x1),0)*greatest(least(a.y2,b.y2)-greatest(a.y1,b.y1),0) AS o, (b.x1+b.x2-a.x1-a.x2)/2 dx, (b.y1+b.y2-a.y1-a.y2)/2 dy FROM b a JOIN b ON a.k=b.k AND a.i<b.i)
SELECT k AS l_orderkey, a, b, round((o/(160-o))::DOUBLE, 6) AS iou, CASE WHEN dx > 6 AND dx >= abs(dy) THEN 'left' WHEN -dx > 6 AND -dx >= abs(dy) THEN 'right' WHEN dy > 6 AND dy > abs(dx) THEN 'above' WHEN -dy > 6 AND -dy > abs(dx) THEN 'below' END AS relation FROM p""")
def spatial_relation(spark, sf):
    q, n = F.col("l_quantity"), F.col("l_linenumber") * 5.0
    d = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("i"), F.array(q, n, q + 10, n + 8).alias("box"))
    a, b = d.select("l_orderkey", F.col("i").alias("a"), F.col("box").alias("x")), d.select("l_orderkey", F.col("i").alias("b"), F.col("box").alias("y"))
    pairs = a.join(b, "l_orderkey").where("a < b")
    return pairs.select("l_orderkey", "a", "b", r6(boxes.iou(F.col("x"), F.col("y"))).alias("iou"), boxes.relation(F.col("x"), F.col("y"), 6.0).alias("relation"))


@query("SELECT o_orderkey, round(o_totalprice - first_value(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 6) AS delta, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS sibling, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS leader FROM orders")
def tree_rollup(spark, sf):
    """Sibling index, first-born flag and the difference from the own root."""
    o = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    i = F.row_number().over(o).cast("long") - 1
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") - F.first("o_totalprice").over(o), 6).alias("delta"), i.alias("sibling"), (i == 0).alias("leader"))


@query("SELECT array_to_string((string_split(p_name, ' '))[1:4], ' ') AS reason, count(*) AS n FROM part GROUP BY 1")
def reason_histogram(spark, sf):
    head = F.array_join(F.slice(F.split("p_name", " "), 1, 4), " ")
    return table(spark, sf, "part").groupBy(head.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS kind, round(sum(o_totalprice)/greatest(count(*), 1), 4) AS loss FROM orders GROUP BY 1")
def loss_by_kind(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.round(F.sum("o_totalprice") / F.greatest(F.count("*"), F.lit(1)), 4).alias("loss"))


_LANE = "('0x' || substr(sha256('lane|' || doc_id), 1, 8))::BIGINT % 8"


@query(f"""WITH l AS (SELECT doc_id, text, {_LANE} AS lane, substr(sha256('8|' || doc_id), 1, 16) AS h FROM documents),
n AS (SELECT doc_id, coalesce(lead(text) OVER w, first_value(text) OVER w) AS donor FROM l WINDOW w AS (PARTITION BY lane ORDER BY h, doc_id)) SELECT doc_id, md5(donor) AS donor FROM n""")
def donor_rows(spark, sf):
    """J-16: for each row the text of another one, without a cross join."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return relations.donors(d, "doc_id", "text", 8, lanes=8).select("doc_id", F.md5("donor").alias("donor"))


@query("""WITH RECURSIVE o AS (SELECT l_orderkey, [l_quantity, l_linenumber*5.0::DOUBLE, l_quantity + 10, l_linenumber*5.0::DOUBLE + 8] AS box, l_extendedprice AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_quantity, l_linenumber) AS i FROM lineitem),
r AS (SELECT l_orderkey, i, [box] AS kept, box, score, true AS stays FROM o WHERE i = 1 UNION ALL
SELECT l_orderkey, i, CASE WHEN stays THEN list_append(kept, box) ELSE kept END, box, score, stays FROM (SELECT o.*, r.kept, len(list_filter(r.kept, lambda k: greatest(least(k[3], o.box[3]) - greatest(k[1], o.box[1]), 0) * greatest(least(k[4], o.box[4]) - greatest(k[2], o.box[2]), 0) / (160 - greatest(least(k[3], o.box[3]) - greatest(k[1], o.box[1]), 0) * greatest(least(k[4], o.box[4]) - greatest(k[2], o.box[2]), 0)) > 0.2)) = 0 AS stays FROM r JOIN o ON o.l_orderkey = r.l_orderkey AND o.i = r.i + 1))
SELECT l_orderkey, box[1] AS x1, box[2] AS y1, score FROM r WHERE stays""")
def suppressed_boxes(spark, sf):
    """Greedy suppression by image, best score first."""
    q, n = F.col("l_quantity"), F.col("l_linenumber") * 5.0
    d = table(spark, sf, "lineitem").select("l_orderkey", F.array(q, n, q + 10, n + 8).alias("box"), F.col("l_extendedprice").alias("score"))
    return boxes.suppress(d, "l_orderkey", "box", "score", 0.2).select("l_orderkey", F.col("box")[0].alias("x1"), F.col("box")[1].alias("y1"), "score")
