"""Rollout trees and critiques of failed questions, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.functions import questions as qs
from loomery.operators import trees
from loomery.plans.curation import _pick, _q, _s_pick, _sql
from loomery.plans.queries import query, r6
from loomery.session import table

NOUNS = ["cats", "fire trucks", "boxes", "cookies", "cherries", "buses", "glasses", "dishes"]
COUNTS = ["one", "two", "three", "four"]
SKILLS = ["object", "count", "attribute", "position", "verb", "style"]


def _rows(spark, sf):
    """Prompts with six questions each: q, a, skill, p."""
    i = F.col("id")
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    one = qs.singular_ie(F.col("n"))
    d = d.withColumn("n", _pick(NOUNS, i))
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    yes = F.when(i % 6 == 0, "No").otherwise("yes")
    made = [
        (join("Are there any ", F.col("n"), " in the image?"), yes), (join("How many ", F.col("n"), " are in the image?"), _pick(COUNTS, i)), (join("Is the ", one, " red?"), F.when(i % 5 == 0, " no ").otherwise("yes")),
        (join("Are the ", F.col("n"), " to the left of the tree?"), F.lit("yes")), (join("Is the ", one, " jumping over it?"), F.lit("yes")), (F.lit("Does it look like a painting?"), F.lit("yes")),
    ]
    p = lambda s: F.pmod(i * 7 + s * 13, F.lit(101)) / 100.0
    vqa = F.array(*(F.struct(q.alias("q"), a.alias("a"), F.lit(SKILLS[s]).alias("skill"), p(s).alias("p")) for s, (q, a) in enumerate(made)))
    return d.select("id", "n", vqa.alias("v"))


def _s_one(n: str) -> str:
    last, cut = f"regexp_extract({n}, '(\\S+)$', 1)", lambda k: f"substr({n}, 1, length({n}) - {k})"
    return f"CASE WHEN list_contains({_sql(qs.IE_PLURALS)}, {last}) THEN {cut(1)} WHEN {last} LIKE '%ies' AND length({last}) > 4 THEN {cut(3)} || 'y' WHEN regexp_matches({last}, '(ss|ch|sh|x)es$') THEN {cut(2)} WHEN {last} LIKE '%s' AND NOT regexp_matches({last}, '(ss|us)$') THEN {cut(1)} ELSE {n} END"


_P = lambda s: f"((id*7 + {s}*13) % 101)/100.0::DOUBLE"
_V = f"""b AS (SELECT p_partkey AS id, {_s_pick(NOUNS, 'p_partkey')} AS n, {_s_pick(COUNTS, 'p_partkey')} AS k FROM part), o AS (SELECT *, {_s_one('n')} AS one FROM b),
f AS (SELECT id, n, one, k, id % 6 = 0 AS excluded, id % 5 = 0 AS no_red, {', '.join(f'{_P(s)} < 0.5 AS f{s}' for s in range(6))} FROM o)"""


@query(f"WITH b AS (SELECT p_partkey AS id, {_s_pick(NOUNS, 'p_partkey')} AS n FROM part) SELECT id, {_s_one('n')} AS one FROM b")
def singulars_ie(spark, sf):
    """Singulars that know plurals on -ie."""
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), _pick(NOUNS, F.col("p_partkey")).alias("n"))
    return d.select("id", qs.singular_ie(F.col("n")).alias("one"))


@query(f"""WITH {_V}, w AS (SELECT *, CASE WHEN k = 'one' THEN 'one ' || one ELSE k || ' ' || n END AS exact FROM f),
p AS (SELECT id, f0 OR f1 OR f2 OR f3 OR f4 OR f5 AS any_low, [CASE WHEN f0 THEN CASE WHEN excluded THEN 'the image shows ' || n || ', which the prompt excludes' ELSE 'there are no ' || n || ' in the image' END END,
CASE WHEN f1 AND NOT (f0 AND NOT excluded) THEN 'the image does not show exactly ' || exact END, CASE WHEN f2 THEN 'the ' || one || CASE WHEN no_red THEN ' is red' ELSE ' is not red' END END, CASE WHEN f3 THEN 'the ' || n || ' are not to the left of the tree' END,
CASE WHEN f4 THEN 'the ' || one || ' is not jumping over it' END, CASE WHEN f5 THEN 'the image does not satisfy: Does it look like a painting?' END] AS i,
[CASE WHEN f0 THEN CASE WHEN excluded THEN 'remove the ' || n ELSE 'add ' || exact END END, CASE WHEN f1 AND NOT (f0 AND NOT excluded) THEN 'make sure there ' || CASE WHEN k = 'one' THEN 'is' ELSE 'are' END || ' exactly ' || exact END,
CASE WHEN f2 THEN CASE WHEN no_red THEN 'make sure the ' || one || ' is not red' ELSE 'make the ' || one || ' red' END END, CASE WHEN f3 THEN 'move the ' || n || ' so that they are to the left of the tree' END, CASE WHEN f4 THEN 'show the ' || one || ' jumping over it' END,
CASE WHEN f5 THEN 'change the image so that the answer to "Does it look like a painting?" is yes' END] AS x FROM w)
SELECT id, CASE WHEN any_low THEN array_to_string(list_filter(i, lambda s: s IS NOT NULL), ', and ') || chr(10) || 'Correction: ' || array_to_string(list_filter(x, lambda s: s IS NOT NULL), ', and ') ELSE {_q(qs.NO_ISSUE)} END AS critique FROM p""")
def oracle_critiques(spark, sf):
    """Critiques of exactly the failed questions; a missing object silences its count."""
    return _rows(spark, sf).select("id", qs.oracle_critique(F.col("v"), 0.5).alias("critique"))


@query(f"""WITH {_V}, t AS (SELECT *, list_sort(list_distinct(list_concat(CASE WHEN f0 OR f1 THEN [n, one] ELSE []::VARCHAR[] END, CASE WHEN f2 THEN [one, {_s_one('one')}, 'red'] ELSE []::VARCHAR[] END, CASE WHEN f3 THEN [n, one, 'left', 'tree'] ELSE []::VARCHAR[] END,
CASE WHEN f4 THEN [one, {_s_one('one')}, 'jumping', 'over'] ELSE []::VARCHAR[] END, CASE WHEN f5 THEN ['look', 'like', 'painting'] ELSE []::VARCHAR[] END))) AS terms FROM f),
g AS (SELECT *, CASE id % 4 WHEN 0 THEN 'Paint it RED.' WHEN 1 THEN 'The fire truck is gone' WHEN 2 THEN 'a tree, cats' ELSE 'nothing' END AS said FROM t)
SELECT id, array_to_string(terms, ',') AS terms, list_has_any(regexp_extract_all(lower(said), '[a-z]+'), terms) OR len(list_filter(terms, lambda z: contains(z, ' ') AND contains(lower(said), z))) > 0 AS grounded FROM g""")
def critique_terms(spark, sf):
    """Terms of the failed questions, and whether a critique names one."""
    i = F.col("id")
    said = F.when(i % 4 == 0, "Paint it RED.").when(i % 4 == 1, "The fire truck is gone").when(i % 4 == 2, "a tree, cats").otherwise("nothing")
    d = _rows(spark, sf).select("id", qs.failed_terms(F.col("v"), 0.5).alias("t"), said.alias("s"))
    return d.select("id", F.array_join("t", ",").alias("terms"), qs.grounded(F.col("s"), F.col("t")).alias("grounded"))


_ANSWERS = ["Two", "no", "Yes", " NO ", "seven", "many", "twenty", "yes"]


@query(f"""WITH x AS (SELECT p_partkey AS id, p_partkey % 3 = 0 AS many, {_s_pick(_ANSWERS, 'p_partkey // 3')} AS a FROM part), y AS (SELECT *, upper(substr(a, 1, 1)) || lower(substr(a, 2)) AS c, CASE WHEN list_contains({_sql(qs.NUMBER_WORDS)}, lower(a)) THEN (list_position({_sql(qs.NUMBER_WORDS)}, lower(a)) - 1)::VARCHAR ELSE 'other' END AS d FROM x)
SELECT id, array_to_string(CASE WHEN many THEN [a, c, ' ' || a, ' ' || c, d, ' ' || d] WHEN lower(trim(a, ' ')) = 'no' THEN ['No', 'no', ' no', ' No'] ELSE ['Yes', 'yes', ' yes', ' Yes'] END, '|') AS variants FROM y""")
def answer_spellings(spark, sf):
    """Spellings of an answer by the kind of question."""
    i = F.col("id")
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    v = qs.answer_variants(F.when(i % 3 == 0, "How many cats?").otherwise("Is it?"), _pick(_ANSWERS, F.floor(i / 3)))
    return d.select("id", F.array_join(v, "|").alias("variants"))


_C = lambda a, b: f"list_transform(range(0, 4), lambda s: ((id*{a} + s*{b}) % 101)/100.0::DOUBLE)"


@query(f"""WITH x AS (SELECT p_partkey AS id, p_retailprice/2000 AS g, p_size/50.0::DOUBLE AS h FROM part), y AS (SELECT *, {_C(7, 13)} AS c, {_C(11, 29)} AS p FROM x)
SELECT id, round(0.7*list_sum(list_transform(range(1, 5), lambda s: CASE WHEN p[s] >= 0.4 THEN 2.0 ELSE 1.0 END * (c[s] - p[s])))/4 + 0.3*(g - h) + 1e-9, 6) AS reward FROM y""")
def refine_rewards(spark, sf):
    """Rewards of refinements, with broken questions weighted."""
    i = F.col("id")
    scores = lambda a, b: F.array(*(F.pmod(i * a + s * b, F.lit(101)) / 100.0 for s in range(4)))
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") / 2000).alias("g"), (F.col("p_size") / 50.0).alias("h"))
    return d.select("id", r6(qs.refine_reward(scores(7, 13), scores(11, 29), F.col("g"), F.col("h"), 0.7, 0.4, 2.0) + 1e-9).alias("reward"))


@query("""WITH RECURSIVE t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey >= 40 THEN o_orderkey // 3 END AS parent, o_totalprice AS s FROM orders), r AS (SELECT id, id AS root FROM t WHERE parent IS NULL UNION ALL SELECT t.id, r.root FROM t JOIN r ON t.parent = r.id),
l AS (SELECT r.root, t.s FROM r JOIN t USING (id) WHERE NOT EXISTS (SELECT 1 FROM t c WHERE c.parent = t.id))
SELECT root, round(avg(l.s) + 1e-7, 4) AS reward, round(avg(l.s) - any_value(o.s) + 1e-7, 4) AS delta, count(*) AS leaves FROM l JOIN t o ON o.id = l.root GROUP BY root""")
def draft_rewards(spark, sf):
    """W12, W13, J-10: a draft's reward is the mean of its descendant leaves; their difference from their own root."""
    k = F.col("o_orderkey")
    d = table(spark, sf, "orders").select(k.alias("id"), F.when(k >= 40, F.floor(k / 3)).alias("parent"), F.col("o_totalprice").alias("s"))
    out = trees.draft_rewards(d, "id", "parent", "s", 32)
    return out.select("root", F.round(F.col("reward") + 1e-7, 4).alias("reward"), F.round(F.col("delta") + 1e-7, 4).alias("delta"), "leaves")


@query("""WITH t AS (SELECT o_orderkey AS id, o_custkey AS parent, o_totalprice AS s, o_orderstatus = 'F' AS good FROM orders), p AS (SELECT parent, count(*) n, avg(s) FILTER (NOT good) m FROM t GROUP BY 1)
SELECT id, round(CASE WHEN good THEN -0.5*greatest(0, 150000 - c_acctbal) - coalesce(m, 0) ELSE s - c_acctbal END + 1e-7, 4) AS reward FROM t JOIN p USING (parent) JOIN customer ON c_custkey = parent""")
def node_rewards(spark, sf):
    """Rewards of refinements against their parent, of stops by the penalty less what refining siblings earned."""
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("s"), (F.col("o_orderstatus") == "F").alias("good"))
    m = t.where("not good").groupBy("c_custkey").agg(F.avg("s").alias("m"))
    d = t.join(table(spark, sf, "customer"), "c_custkey").join(m, "c_custkey", "left")
    stop = -0.5 * F.greatest(F.lit(0.0), 150000 - F.col("c_acctbal")) - F.coalesce("m", F.lit(0.0))
    return d.select("id", F.round(F.when(F.col("good"), stop).otherwise(F.col("s") - F.col("c_acctbal")) + 1e-7, 4).alias("reward"))
