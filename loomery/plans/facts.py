"""Counts, relations, votes and checks of detected objects and rewritten captions, each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomery.functions import facts as f
from loomery.functions import lexicon
from loomery.plans.curation import CAPTIONS, _id, _parts, _pick, _q, _s_pick, _s_singular, _sql
from loomery.plans.queries import query
from loomery.session import table

NOUNS = ["cows", "cookie", "water bottles", "children", "dog", "knives", "boxes", "sun", "cherry", "bus", "fire woman", "toy", "cactus", "sheep"]
TEXTS = [
    "The image shows two cows and the three cookies", "Add two more cows to the left", "four tall water bottles, five dogs", "by adding two cows", "one dog and two small red dogs in a row", "Remove the cow from the barn", "Remove two of the knives", "Add a second child near the house",
    "Remove the extra cookies", "Add another dog so that there are three dogs", "Replace the two cows with four cows", "Replace the two cows with two brown cows", "Remove the cows", "Add 3 cookies in total", "seven soda bottles and six water bottles", "Add cows",
]
REWRITES = ["A red cow stands to the left of exactly two wooden barns and 3 ducks.", "Three pink cookies resting on a plate", "The sign behind the old house is 2 meters tall", "A taller man sat beside the sea in front of a bench", "exactly 4 dogs and a cat's bowl", "Four children jogging near the empty house with a lovely vase"]

_S_NUM = lambda w: f"CASE WHEN regexp_matches({w}, '^[0-9]+$') THEN {w}::INT WHEN list_contains({_sql(lexicon.NUMBER_WORDS)}, {w}) THEN (list_position({_sql(lexicon.NUMBER_WORDS)}, {w}) - 1)::INT END"
_S_TOKENS = lambda t: f"regexp_extract_all(lower({t}), {_q(f.TOKEN)})"
_S_WORD = lambda w: f"(regexp_replace({w}, '^''+|''+$', '', 'g'))"
#: Arrays over the tokens w of a text t for a noun n: numbers, stops and whether each is the noun.
_S_WALK = f"""x AS (SELECT *, {_S_TOKENS('t')} AS w, string_split(lower(n), ' ') AS parts FROM b), h AS (SELECT *, list_transform([parts[len(parts)]], lambda z: {_s_singular('z')})[1] AS hd, list_transform(w, lambda z: {_S_NUM('z')}) AS num FROM x),
y AS (SELECT *, list_transform(range(1, len(w) + 1), lambda j: num[j] IS NOT NULL OR NOT regexp_matches(w[j], '^[a-z]') OR list_contains({_sql(f.PHRASE_END)}, w[j])) AS stop,
list_transform(range(1, len(w) + 1), lambda j: list_transform([{_S_WORD('w[j]')}], lambda z: {_s_singular('z')})[1] = hd AND (len(parts) = 1 OR j = 1 OR list_contains(parts, w[j - 1]) OR num[j - 1] IS NOT NULL OR list_contains({_sql(f.QUANTIFIERS)}, w[j - 1]))) AS noun FROM h)"""
_S_COUNTED = "coalesce(NOT stop[list_min(list_filter(range(k + 1, k + 5), lambda j: j <= len(w) AND (stop[j] OR noun[j])))], false)"


def _texts(spark, sf):
    d = _parts(spark, sf)
    return d.select("id", _pick(TEXTS, _id()).alias("t"), _pick(NOUNS, F.floor(_id() / 16)).alias("n"))


_B = f"b AS (SELECT p_partkey AS id, {_s_pick(TEXTS, 'p_partkey')} AS t, {_s_pick(NOUNS, 'p_partkey // 16')} AS n FROM part)"


@query(f"WITH {_B}, {_S_WALK} SELECT id, array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda k: num[k] IS NOT NULL AND num[k] <> 1 AND (k = 1 OR NOT list_contains({_sql(f.NOT_A_TOTAL)}, w[k - 1])) AND {_S_COUNTED}), lambda k: num[k]), ',') AS numbers FROM y")
def counted_numbers(spark, sf):
    """Numbers that count a noun in a text."""
    return _texts(spark, sf).select("id", F.array_join(F.transform(f.numbers_of(F.col("t"), F.col("n")), lambda n: n.cast("string")), ",").alias("numbers"))


@query(f"WITH {_B}, {_S_WALK}, z AS (SELECT id, t, list_transform(list_filter(range(1, len(w) + 1), lambda k: num[k] IS NOT NULL AND num[k] <> 1 AND {_S_COUNTED}), lambda k: num[k]) AS v FROM y) SELECT id, starts_with(t, 'Replace') AND len(v) >= 2 AND coalesce(v[1] <> v[len(v)], false) AS changes FROM z")
def replaced_counts(spark, sf):
    """Replace steps that change how many there are."""
    return _texts(spark, sf).select("id", F.coalesce(f.replace_changes_count(F.col("t"), F.col("n")), F.lit(False)).alias("changes"))


_EDIT_CHAIN = f"""c AS (SELECT *, {_S_TOKENS('t')} AS w0 FROM b), d AS (SELECT t, n, w0[1] AS op, coalesce(list_min(list_filter(range(2, len(w0) + 1), lambda j: list_contains({_sql(f.PHRASE_END)}, w0[j]) OR NOT regexp_matches(w0[j], '^[a-z0-9]'))), len(w0) + 1) AS e, w0 FROM c),
g AS (SELECT t, n, op, w0[2:e - 1] AS w, string_split(lower(n), ' ') AS parts FROM d), h2 AS (SELECT *, list_transform([parts[len(parts)]], lambda z: {_s_singular('z')})[1] AS hd, list_transform(w, lambda z: {_S_NUM('z')}) AS num, list_transform(w, lambda v: list_transform([{_S_WORD('v')}], lambda z: {_s_singular('z')})[1]) AS sg FROM g),
k AS (SELECT *, list_min(list_filter(range(1, len(w) + 1), lambda j: sg[j] = hd AND (len(parts) = 1 OR j = 1 OR list_contains(parts, w[j - 1]) OR num[j - 1] IS NOT NULL OR list_contains({_sql(f.QUANTIFIERS)}, w[j - 1])))) AS pos FROM h2),
m AS (SELECT *, w[1:pos - 1] AS own, list_filter(num[1:pos - 1], lambda z: z IS NOT NULL)[1] AS nr, sg[pos] <> w[pos] AS plural FROM k WHERE pos IS NOT NULL AND op IN ('add', 'remove')),
q AS (SELECT *, regexp_matches(array_to_string(own, ' '), {_q(f.RELATIVE)}) OR regexp_matches(t, {_q(f.TOTAL)}) AS rel, coalesce(own[1], '') AS first FROM m),
s AS (SELECT DISTINCT t, n, op, CASE WHEN nr IS NOT NULL THEN 1 WHEN first IN ('a', 'an', 'another') OR list_has_any(own, {_sql(f.ORDINALS)}) THEN 2 WHEN first = 'the' AND op = 'remove' AND NOT rel THEN 3 WHEN rel THEN 4 END AS c, nr, rel, plural FROM q)"""


@query(f"""WITH {_B}, {_EDIT_CHAIN}
SELECT b.id, CASE WHEN c > 0 THEN op END AS op, CASE c WHEN 1 THEN nr WHEN 2 THEN 1 WHEN 3 THEN CASE WHEN NOT plural THEN 1 END END AS k, CASE WHEN c IN (1, 2) THEN rel WHEN c = 3 THEN false WHEN c = 4 THEN true END AS relative, CASE WHEN c > 0 THEN c = 3 END AS definite FROM b LEFT JOIN s USING (t, n)""")
def count_edits(spark, sf):
    """What Add and Remove steps do to a noun's count."""
    d = _texts(spark, sf).select("id", f.count_edit(F.col("t"), F.col("n")).alias("e"))
    return d.select("id", "e.op", "e.k", "e.relative", "e.definite")


COUNT_TEXTS = [*TEXTS, "Change the number of cows from two to three", "Keep them at five cows in total", "Add two cows", "Remove one cow", "Replace the cow with two cows", "There are four cows"]
COUNTED = ["cows", "cookies", "water bottles", "dog"]
_NUM_LIST = "list_transform(list_filter(range(1, len(w) + 1), lambda k: num[k] IS NOT NULL AND num[k] <> 1 {free} AND " + _S_COUNTED + "), lambda k: num[k])"


@query(f"""WITH b AS (SELECT * FROM (SELECT unnest({_sql(COUNT_TEXTS)}) AS t), (SELECT unnest({_sql(COUNTED)}) AS n)), {_S_WALK.replace('x AS', 'x0 AS', 1).replace('FROM x)', 'FROM x0)')},
v AS (SELECT t, n, {_NUM_LIST.format(free=f"AND (k = 1 OR NOT list_contains({_sql(f.NOT_A_TOTAL)}, w[k - 1]))")} AS nums, {_NUM_LIST.format(free='')} AS every, list_contains(list_transform(regexp_extract_all(lower(t), '[\\w''-]+'), lambda u: list_transform([{_S_WORD('u')}], lambda z: {_s_singular('z')})[1]), hd) AS named FROM y),
{_EDIT_CHAIN}, z AS (SELECT v.t, v.n, v.nums, starts_with(v.t, 'Replace') AND len(every) >= 2 AND coalesce(every[1] <> every[len(every)], false) AS swaps, regexp_matches(v.t, {_q(f.TOTAL)}) AND named AS tot, s.op, CASE c WHEN 1 THEN nr WHEN 2 THEN 1 WHEN 3 THEN CASE WHEN NOT plural THEN 1 END END AS k, CASE WHEN c IN (1, 2) THEN rel WHEN c = 3 THEN false WHEN c = 4 THEN true END AS rel, c = 3 AS definite, c > 0 AS edit,
starts_with(v.t, 'Change') AND regexp_matches(v.t, {_q(f.COUNT_STEP)}) AS hides FROM v LEFT JOIN s ON s.t = v.t AND s.n = v.n),
r AS (SELECT p_partkey AS id, {_s_pick(COUNT_TEXTS, 'p_partkey')} AS i, {_s_pick(COUNT_TEXTS, 'p_partkey * 5 + 3')} AS a, {_s_pick(COUNT_TEXTS, 'p_partkey * 7 + 11')} AS b, {_s_pick(COUNTED, 'p_partkey // 22')} AS n, (1 + p_partkey % 4)::INT AS target, (p_size % 4)::INT AS lo, (p_size % 4 + p_partkey % 3)::INT AS hi,
CASE WHEN p_partkey % 10 = 0 THEN 'unmeasured' WHEN p_partkey % 3 = 0 THEN 'exact' ELSE 'range' END AS state FROM part),
j AS (SELECT r.*, list_filter(zi.nums, lambda q: q <> target) AS told, za.swaps AS as_, zb.swaps AS bs, za.hides AS ah, zb.hides AS bh, za.tot AND NOT coalesce(za.edit, false) OR zb.tot AND NOT coalesce(zb.edit, false) AS tot, list_filter([{{'op': za.op, 'k': za.k, 'rel': za.rel, 'def': za.definite, 'e': coalesce(za.edit, false)}}, {{'op': zb.op, 'k': zb.k, 'rel': zb.rel, 'def': zb.definite, 'e': coalesce(zb.edit, false)}}], lambda q: q.e) AS ed,
starts_with(a, 'Replace') AND list_contains(za.nums, target) OR starts_with(b, 'Replace') AND list_contains(zb.nums, target) AS replaced, state <> 'unmeasured' AND (target < lo OR target > hi) AS wrong, state = 'range' AND hi - lo = 1 AS narrow FROM r JOIN z zi ON zi.t = i AND zi.n = r.n JOIN z za ON za.t = a AND za.n = r.n JOIN z zb ON zb.t = b AND zb.n = r.n),
o AS (SELECT *, list_transform(range(lo, hi + 1), lambda q: CASE WHEN len(ed) < 1 THEN q WHEN ed[1].k IS NULL AND ed[1].rel THEN least(q, target) WHEN ed[1].k IS NULL THEN 0 WHEN ed[1].op = 'add' THEN q + ed[1].k ELSE greatest(q - ed[1].k, 0) END) AS c1 FROM j),
u AS (SELECT *, list_transform(c1, lambda q: CASE WHEN len(ed) < 2 THEN q WHEN ed[2].k IS NULL AND ed[2].rel THEN least(q, target) WHEN ed[2].k IS NULL THEN 0 WHEN ed[2].op = 'add' THEN q + ed[2].k ELSE greatest(q - ed[2].k, 0) END) AS c2 FROM o)
SELECT id, CASE WHEN ah THEN 'change' WHEN as_ THEN 'replace' WHEN bh THEN 'change' WHEN bs THEN 'replace' WHEN tot THEN 'total' WHEN wrong OR narrow THEN CASE WHEN len(list_filter(told, lambda q: NOT (state <> 'unmeasured' AND q BETWEEN lo AND hi))) > 0 THEN 'said' WHEN len(ed) > 0 THEN CASE WHEN len(list_filter(ed, lambda q: q.k IS NULL AND q.op = 'add')) > 0 THEN 'add_unknown'
WHEN NOT list_contains(c2, target) AND NOT coalesce(len(ed) = 1 AND ed[1].op = 'add' AND ed[1].k = target AND lo = 0, false) THEN 'not_end' END WHEN wrong AND target >= 2 AND NOT replaced THEN 'missing' END WHEN len(list_filter(ed, lambda q: NOT q.def AND (q.op = 'remove' OR q.rel OR NOT coalesce(q.k = target, false)))) > 0 THEN 'implies' WHEN len(told) > 0 THEN 'states' END AS reason FROM u""")
def count_reasons(spark, sf):
    """why a reply's counts disagree with the detector, first rule first."""
    i, size = F.col("p_partkey"), F.col("p_size")
    lo = (size % 4).cast("int")
    d = table(spark, sf, "part").select(
        i.alias("id"), F.array(_pick(COUNT_TEXTS, i)).alias("items"), F.array(_pick(COUNT_TEXTS, i * 5 + 3), _pick(COUNT_TEXTS, i * 7 + 11)).alias("steps"), _pick(COUNTED, F.floor(i / 22)).alias("n"), (1 + i % 4).cast("int").alias("target"),
        lo.alias("lo"), (lo + i % 3).cast("int").alias("hi"), F.when(i % 10 == 0, "unmeasured").when(i % 3 == 0, "exact").otherwise("range").alias("state"),
    )
    return d.select("id", f.count_reason(F.col("items"), F.col("steps"), F.col("n"), F.col("target"), F.col("lo"), F.col("hi"), F.col("state")).alias("reason"))


@query(f"""WITH b AS (SELECT p_partkey AS id, {_s_pick(CAPTIONS, 'p_partkey')} AS t, {_s_pick(NOUNS, 'p_partkey // 12')} AS n FROM part), x AS (SELECT *, {_S_TOKENS('t')} AS w, string_split(lower(n), ' ') AS parts FROM b),
h AS (SELECT *, list_transform([parts[len(parts)]], lambda z: {_s_singular('z')})[1] AS hd, list_transform(w, lambda v: list_transform([{_S_WORD('v')}], lambda z: {_s_singular('z')})[1]) AS sg FROM x), p AS (SELECT *, list_position(sg, hd) - len(parts) + 1 AS st, coalesce(list_position(sg, hd), 0) AS pl FROM h),
s AS (SELECT *, coalesce(list_min(list_filter([1, 2, 3], lambda k: st - k < 1 OR NOT regexp_matches(w[st - k], '^[a-z]') OR list_contains({_sql(f.PHRASE_STOP + lexicon.NUMBER_WORDS)}, w[st - k]) OR w[st - k] LIKE '%ing')) - 1, 3) AS many FROM p)
SELECT id, CASE WHEN pl = 0 OR st < 1 THEN n ELSE array_to_string(w[st - many:pl], ' ') END AS phrase FROM s""")
def noun_phrases(spark, sf):
    """A noun as the caption writes it, with the words before it."""
    d = _parts(spark, sf).select("id", _pick(CAPTIONS, _id()).alias("t"), _pick(NOUNS, F.floor(_id() / 12)).alias("n"))
    return d.select("id", f.noun_phrase(F.col("t"), F.col("n")).alias("phrase"))


_DET = """d AS (SELECT l_orderkey AS image, l_returnflag AS noun, l_linenumber AS i, l_discount * 10 AS score, [l_quantity, l_linenumber * 5.0::DOUBLE, l_quantity + 3 + l_linenumber, l_linenumber * 5.0::DOUBLE + 8] AS b FROM lineitem)"""
_IN = lambda o, i: f"greatest(least({o}[3], {i}[3]) - greatest({o}[1], {i}[1]), 0) * greatest(least({o}[4], {i}[4]) - greatest({o}[2], {i}[2]), 0) / (({i}[3] - {i}[1]) * ({i}[4] - {i}[2])) >= 0.5"


@query(f"""WITH {_DET}, w AS (SELECT x.image, x.noun, x.b, x.score, x.score >= 0.5 AS strong, (x.b[3]-x.b[1])*(x.b[4]-x.b[2]) >= 40 AS big, coalesce(bool_or({_IN('s.b', 'x.b')} OR {_IN('x.b', 's.b')}), false) AS part FROM d x LEFT JOIN d s ON s.image = x.image AND s.noun = x.noun AND s.score >= 0.5 GROUP BY x.image, x.noun, x.b, x.score, x.i),
e AS (SELECT image, noun, count(*) FILTER (strong AND big) AS lo, count(*) FILTER (strong) + count(*) FILTER (NOT strong AND NOT part) AS hi FROM w GROUP BY 1, 2), t AS (SELECT *, (image % 4)::INT AS target, CASE WHEN image % 9 = 0 OR lo = 0 OR hi > 6 THEN 'unmeasured' WHEN lo = hi THEN 'exact' ELSE 'range' END AS state FROM e)
SELECT image, noun, state, state <> 'unmeasured' AND (target < lo OR target > hi) AS decisive, state = 'range' AND hi - lo = 1 AS narrow, state <> 'unmeasured' AND target + 1 BETWEEN lo AND hi AS consistent,
'- ' || noun || ': ' || CASE WHEN state = 'unmeasured' THEN 'not measured' WHEN state = 'exact' THEN 'exactly ' || {_sql(lexicon.NUMBER_WORDS)}[lo + 1] WHEN hi - lo = 1 THEN {_sql(lexicon.NUMBER_WORDS)}[lo + 1] || ' or ' || {_sql(lexicon.NUMBER_WORDS)}[hi + 1] ELSE 'between ' || {_sql(lexicon.NUMBER_WORDS)}[lo + 1] || ' and ' || {_sql(lexicon.NUMBER_WORDS)}[hi + 1] END || ' (the caption asks for ' || {_sql(lexicon.NUMBER_WORDS)}[target + 1] || ')' AS line FROM t""")
def count_evidence(spark, sf):
    """Evidence of detectors about a count, what it decides, and its line of text."""
    d = _detections(spark, sf)
    strong = d.where("score >= 0.5").select("image", "noun", F.col("b").alias("s"))
    w = d.join(strong, ["image", "noun"], "left").groupBy("image", "noun", "i", "b", "score").agg(F.coalesce(F.bool_or(f.held_by(F.col("s"), F.col("b"), 0.5) | f.held_by(F.col("b"), F.col("s"), 0.5)), F.lit(False)).alias("part"))
    big = (F.col("b")[2] - F.col("b")[0]) * (F.col("b")[3] - F.col("b")[1]) >= 40
    high = F.col("score") >= 0.5
    e = w.groupBy("image", "noun").agg(F.count(F.when(high & big, 1)).cast("int").alias("lo"), F.count(F.when(high | ~F.col("part"), 1)).cast("int").alias("hi")).withColumn("target", (F.col("image") % 4).cast("int"))
    lo, hi, target, state = F.col("lo"), F.col("hi"), F.col("target"), F.col("state")
    e = e.withColumn("state", f.evidence_state(lo, hi, F.col("image") % 9 == 0, 6))
    return e.select("image", "noun", "state", f.decisive(state, lo, hi, target).alias("decisive"), f.narrow(state, lo, hi).alias("narrow"), f.consistent(state, lo, hi, target + 1).alias("consistent"), f.evidence_text(F.col("noun"), state, lo, hi, target).alias("line"))


def _detections(spark, sf):
    q, n = F.col("l_quantity"), F.col("l_linenumber") * 5.0
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_returnflag").alias("noun"), F.col("l_linenumber").alias("i"), (F.col("l_discount") * 10).alias("score"), F.array(q, n, q + 3 + F.col("l_linenumber"), n + 8).alias("b"))


_S_LAST = "regexp_extract(n, '(\\S+)$', 1)"
_S_IRREG = "CASE " + " ".join(f"WHEN n LIKE '%{a}' THEN substr(n, 1, length(n) - {len(a)}) || '{b}'" for a, b in f.IRREGULAR_PLURALS.items()) + " END"


@query(f"SELECT id, CASE WHEN regexp_matches(n, '(s|x|ch|sh)$') THEN n || 'es' WHEN regexp_matches(n, '([^aeiou]|^)y$') THEN substr(n, 1, length(n) - 1) || 'ies' ELSE n || 's' END AS plural, {_S_IRREG} AS irregular FROM (SELECT p_partkey AS id, {_s_pick(NOUNS, 'p_partkey')} AS n FROM part)")
def plurals(spark, sf):
    """Regular and irregular plurals."""
    n = _pick(NOUNS, _id())
    return _parts(spark, sf).select("id", f.pluralize(n).alias("plural"), f.irregular_plural(n).alias("irregular"))


_S_ESTEM = lambda w: f"list_transform([CASE WHEN {w} LIKE '%ing' AND length({w}) - 3 >= 3 THEN substr({w}, 1, length({w}) - 3) WHEN {w} LIKE '%ed' AND length({w}) - 2 >= 3 THEN substr({w}, 1, length({w}) - 2) WHEN {w} LIKE '%ly' AND length({w}) - 2 >= 3 THEN substr({w}, 1, length({w}) - 2) WHEN {w} LIKE '%s' AND length({w}) - 1 >= 3 THEN substr({w}, 1, length({w}) - 1) ELSE {w} END], lambda s: CASE WHEN s LIKE '%e' AND length(s) > 3 THEN substr(s, 1, length(s) - 1) ELSE s END)[1]"
_S_AL = lambda t: f"regexp_extract_all(lower({t}), '[a-z]+(?:''[a-z]+)?')"


@query(f"""WITH b AS (SELECT p_partkey AS id, {_s_pick(CAPTIONS, 'p_partkey')} AS o, {_s_pick(REWRITES, 'p_partkey // 12')} AS n FROM part)
SELECT id, array_to_string(list_filter(regexp_extract_all(lower(o), '[a-z0-9'']+'), lambda w: NOT list_contains(regexp_extract_all(lower(n), '[a-z0-9'']+'), w) AND NOT list_contains({_sql(f.QUANTITY + f.FUNCTION)}, w) AND NOT regexp_matches(w, '^[0-9]+$')), ' ') AS dropped,
array_to_string(list_filter({_S_AL('n')}, lambda w: NOT list_contains(list_transform({_S_AL('o')}, lambda v: {_S_ESTEM('v')}), {_S_ESTEM('w')}) AND NOT list_contains({_sql(f.FUNCTION + f.QUANTITY + f.GLUE)}, w)), ' ') AS foreign_words,
array_to_string(list_transform(regexp_extract_all(n, {_q(f.RELATION)}, 1), lambda z: lower(z)), '|') AS relations, len(list_filter(regexp_extract_all(n, '[0-9]+'), lambda z: NOT list_contains(regexp_extract_all(o, '[0-9]+'), z))) > 0 AS new_digits,
regexp_replace(CASE WHEN contains(lower(o), 'exactly') THEN n ELSE regexp_replace(n, {_q(f.EXACTLY)}, '\\1', 'g') END, '\\b3\\b(\\s+[A-Za-z])', 'three\\1', 'g') AS spelled FROM b""")
def rewrite_checks(spark, sf):
    """Words that a rewrite lost or invented, its relations and digits, and its counts in words."""
    o, n = F.col("o"), F.col("n")
    d = _parts(spark, sf).select("id", _pick(CAPTIONS, _id()).alias("o"), _pick(REWRITES, F.floor(_id() / 12)).alias("n"))
    spelled = f.spell_count(o, f.strip_exactly(o, n), F.lit(3))
    return d.select("id", F.array_join(f.dropped_words(o, n), " ").alias("dropped"), F.array_join(f.foreign_words(n, o), " ").alias("foreign_words"), F.array_join(f.relation_phrases(n), "|").alias("relations"), f.new_digits(o, n).alias("new_digits"), spelled.alias("spelled"))


ATTRIBUTES = ["dark grey", "Navy blue!", "light wood", "crimson", "see-through", "golden brown", "ivory", "wooden", "paper", "glass"]
THINGS = ["wood carving", "paper", "glass surface", "car", "golden retriever"]


@query(f"SELECT id, list_filter(list_transform(list_reverse(regexp_extract_all(lower(a), '[a-z]+')), lambda w: coalesce(MAP {{{', '.join(f'{_q(k)}: {_q(v)}' for k, v in f.COLOR_WORDS.items())}}}[w], w)), lambda w: list_contains({_sql(f.COLORS)}, w))[1] AS color, list_contains(string_split(n, ' '), a) OR list_contains(string_split(n, ' '), regexp_replace(a, '[en]+$', '')) OR len(list_filter(string_split(n, ' '), lambda w: starts_with(w, regexp_replace(a, '[en]+$', '')))) > 0 AS restates, upper(substr(n, 1, 1)) || substr(n, 2) || ' is ' || a || '.' AS fact FROM (SELECT p_partkey AS id, {_s_pick(ATTRIBUTES, 'p_partkey')} AS a, {_s_pick(THINGS, 'p_partkey // 10')} AS n FROM part)")
def attribute_words(spark, sf):
    """An attribute on the vocabulary, whether it restates the noun, and the wording of the fact."""
    a, n = _pick(ATTRIBUTES, _id()), _pick(THINGS, F.floor(_id() / 10))
    fact = F.concat(F.upper(F.substring(n, 1, 1)), F.substr(n, F.lit(2)), F.lit(" is "), a, F.lit("."))
    return _parts(spark, sf).select("id", f.normalize_word(a, f.COLOR_WORDS, f.COLORS).alias("color"), f.restates(a, n).alias("restates"), fact.alias("fact"))


@query("""WITH p AS (SELECT p_partkey AS id, p_size % 5 AS a, (p_size + p_partkey) % 5 AS b, p_partkey % 3 AS g, p_partkey % 2 = 0 AS faint FROM part)
SELECT id, (CASE WHEN a = b AND a BETWEEN 1 AND 4 THEN CASE WHEN NOT (g >= greatest(2, a // 2) OR (g > 0 AND a < 2)) THEN a END WHEN a = 1 AND g = 0 AND b = 0 AND faint THEN 1 END)::INT AS n FROM p""")
def count_votes(spark, sf):
    """The count that two detectors settle."""
    a, b, g = (F.col("p_size") % 5).cast("int"), ((F.col("p_size") + F.col("p_partkey")) % 5).cast("int"), (F.col("p_partkey") % 3).cast("int")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), f.count_vote(a, b, g, F.col("p_partkey") % 2 == 0, 4).cast("int").alias("n"))


@query(f"""WITH {_DET}, p AS (SELECT a.image, a.i AS a, c.i AS c, a.b AS x, c.b AS y, a.score AS da, c.score AS dc FROM d a JOIN d c ON a.image = c.image AND a.i < c.i AND a.noun < c.noun), m AS (SELECT *, least(x[3], y[3]) - greatest(x[1], y[1]) AS ov, least(x[3]-x[1], y[3]-y[1]) AS le, (x[1]+x[3])/2 AS cx, (y[1]+y[3])/2 AS cy FROM p)
SELECT image, a, c, CASE WHEN ov < 0.5*le AND cx < cy - 1.8 THEN 'to the left of' WHEN ov < 0.5*le AND cx > cy + 1.8 THEN 'to the right of' WHEN ov > 0.3*le AND x[4] < y[2] - 0.8 THEN 'above' WHEN ov > 0.3*le AND x[2] > y[4] + 0.8 THEN 'below' END AS flat,
CASE WHEN ov >= 0.3*le AND NOT ({_IN('x', 'y')}) AND NOT ({_IN('y', 'x')}) THEN CASE WHEN da > dc + 0.1001 THEN 'in front of' WHEN da < dc - 0.1001 THEN 'behind' END END AS deep, abs(da - dc) <= 0.1001 AS same_layer, (x[3]-x[1])*(x[4]-x[2]) > 0.02*60*40 AS background, ({_IN('x', 'y')}) OR ({_IN('y', 'x')}) AS nested FROM m""")
def box_relations(spark, sf):
    """X18, X19, X20, F30, J-19: flat and depth relations of pairs in a scene, same layer, background and nested."""
    d = _detections(spark, sf)
    a, b = d.select("image", F.col("i").alias("a"), F.col("noun").alias("na"), F.col("b").alias("x"), F.col("score").alias("da")), d.select("image", F.col("i").alias("c"), F.col("noun").alias("nc"), F.col("b").alias("y"), F.col("score").alias("dc"))
    p, x, y = a.join(b, "image").where("a < c and na < nc"), F.col("x"), F.col("y")
    area = (x[2] - x[0]) * (x[3] - x[1])
    return p.select("image", "a", "c", f.relation_2d(x, y, 60, 40).alias("flat"), f.relation_3d(x, y, F.col("da"), F.col("dc"), 0.1001).alias("deep"), (F.abs(F.col("da") - F.col("dc")) <= 0.1001).alias("same_layer"), (area > 0.02 * 60 * 40).alias("background"), (f.held_by(x, y, 0.5) | f.held_by(y, x, 0.5)).alias("nested"))


_TYPES = ["count", "position_2d", "position_3d", "support", "attribute", "comparison", "negation"]
_LEVEL = {"count": 0, "position_2d": 1, "position_3d": 1, "support": 1, "attribute": 2, "comparison": 3, "negation": 4}
_RANK = {"position_2d": 0, "support": 1, "position_3d": 2}


@query(f"""WITH c AS (SELECT l_orderkey AS row, l_linenumber AS i, l_partkey AS p, {_s_pick(_TYPES, 'l_partkey')} AS t, substr(sha256('5|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey), 1, 16) AS h FROM lineitem),
l AS (SELECT *, MAP {{{', '.join(f"'{k}': {v}" for k, v in _LEVEL.items())}}}[t] AS level, coalesce(MAP {{{', '.join(f"'{k}': {v}" for k, v in _RANK.items())}}}[t], 0) AS rk FROM c),
d AS (SELECT *, row_number() OVER (PARTITION BY row, t ORDER BY h, i, p) AS nt FROM l), k AS (SELECT * FROM d WHERE (t <> 'position_3d' OR nt <= 1) AND (t <> 'negation' OR (nt <= 1 AND row % 3 = 0))), m AS (SELECT *, row_number() OVER (PARTITION BY row, level ORDER BY rk, h, i, p) AS nl FROM k),
s AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY level, nl) AS place FROM m WHERE level <> 1 OR nl <= 2) SELECT row, place, t AS type, p AS fact FROM s WHERE place <= 3""")
def selected_facts(spark, sf):
    """Facts by priority, hashed inside a level, positions by rank, with caps by type and in all."""
    d = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("i"), F.col("l_partkey").alias("p"), _pick(_TYPES, F.col("l_partkey")).alias("t"))
    look = lambda m, c: F.element_at(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)), c)
    d = d.withColumns({"h": F.substring(F.sha2(F.concat_ws("|", F.lit("5"), "row", "i", "p"), 256), 1, 16), "level": look(_LEVEL, F.col("t")), "rk": F.coalesce(look(_RANK, F.col("t")), F.lit(0))})
    number = lambda keys, order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    d = d.withColumn("nt", number(["row", "t"], ["h", "i", "p"])).where("(t <> 'position_3d' or nt <= 1) and (t <> 'negation' or (nt <= 1 and row % 3 = 0))")
    d = d.withColumn("nl", number(["row", "level"], ["rk", "h", "i", "p"])).where("level <> 1 or nl <= 2").withColumn("place", number(["row"], ["level", "nl"])).where("place <= 3")
    return d.select("row", F.col("place").cast("long").alias("place"), F.col("t").alias("type"), F.col("p").alias("fact"))


@query(f"WITH {_DET}, r AS (SELECT image, noun, i, (b[3]-b[1])*(b[4]-b[2]) AS area FROM d), n AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY area DESC, noun, i) AS place FROM (SELECT DISTINCT * FROM r)) SELECT image, place, noun, area FROM n WHERE place <= 2")
def largest_regions(spark, sf):
    """The largest regions of an image, at most two."""
    b = F.col("b")
    d = _detections(spark, sf).select("image", "noun", "i", ((b[2] - b[0]) * (b[3] - b[1])).alias("area")).distinct()
    n = F.row_number().over(Window.partitionBy("image").orderBy(F.desc("area"), "noun", "i")).cast("long")
    return d.withColumn("place", n).where("place <= 2").select("image", "place", "noun", "area")


@query("WITH c AS (SELECT user_id, event_id, substr(sha256('7|' || event_id), 1, 16) AS h, 1 + user_id % 3 AS k FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY h, event_id) AS n FROM c) SELECT user_id, event_id, n AS place FROM r WHERE n <= k")
def error_subsets(spark, sf):
    """A random subset of 1 to N candidates of each row."""
    d = table(spark, sf, "events").select("user_id", "event_id", F.substring(F.sha2(F.concat_ws("|", F.lit("7"), "event_id"), 256), 1, 16).alias("h"))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("h", "event_id")).cast("long")
    return d.withColumn("place", n).where(F.col("place") <= 1 + F.col("user_id") % 3).select("user_id", "event_id", "place")


@query(f"""WITH t AS (SELECT p_brand AS row, {_s_pick(NOUNS, 'p_partkey')} AS n, p_partkey AS i, p_size AS v FROM part), d AS (SELECT *, row_number() OVER (PARTITION BY row, n ORDER BY i) AS k FROM t), h AS (SELECT row, n, i, v, list_transform([{_S_LAST}], lambda z: {_s_singular('z')})[1] AS hd FROM d WHERE k = 1)
SELECT row, n AS noun, v AS target, hd AS head, count(*) OVER (PARTITION BY row, hd) > 1 OR hd IN ('sun', 'moon', 'sky', 'earth', 'horizon', 'rainbow') AS ambiguous FROM h""")
def count_targets(spark, sf):
    """Targets by noun, the first wins; two with one head, or a unique thing, are ambiguous."""
    i = F.col("p_partkey")
    d = table(spark, sf, "part").select(F.col("p_brand").alias("row"), _pick(NOUNS, i).alias("noun"), i.alias("i"), F.col("p_size").alias("target"))
    d = d.withColumn("k", F.row_number().over(Window.partitionBy("row", "noun").orderBy("i"))).where("k = 1").withColumn("head", f.head(F.col("noun")))
    many = F.count("*").over(Window.partitionBy("row", "head")) > 1
    return d.select("row", "noun", "target", "head", (many | F.col("head").isin(f.UNIQUE)).alias("ambiguous"))


@query(f"""WITH {_DET}, c AS (SELECT DISTINCT x.image, CASE WHEN x.score < y.score THEN x.noun ELSE y.noun END AS noun, CASE WHEN x.score < y.score THEN x.i ELSE y.i END AS i FROM d x JOIN d y ON x.image = y.image AND x.noun < y.noun
AND greatest(least(x.b[3],y.b[3])-greatest(x.b[1],y.b[1]),0)*greatest(least(x.b[4],y.b[4])-greatest(x.b[2],y.b[2]),0)/((x.b[3]-x.b[1])*(x.b[4]-x.b[2])+(y.b[3]-y.b[1])*(y.b[4]-y.b[2])-greatest(least(x.b[3],y.b[3])-greatest(x.b[1],y.b[1]),0)*greatest(least(x.b[4],y.b[4])-greatest(x.b[2],y.b[2]),0)) > 0.6)
SELECT image, noun, count(*) AS lost FROM c GROUP BY 1, 2""")
def box_conflicts(spark, sf):
    """Boxes that two nouns claim go to the higher score; how many each noun loses."""
    from loomery.operators import boxes

    d = _detections(spark, sf)
    a, b = (d.select("image", *(F.col(k).alias(f"{k}{s}") for k in ("noun", "i", "score", "b"))) for s in (1, 2))
    p = a.join(b, "image").where("noun1 < noun2").where(boxes.iou(F.col("b1"), F.col("b2")) > 0.6)
    low = F.col("score1") < F.col("score2")
    c = p.select("image", *(F.when(low, F.col(f"{k}1")).otherwise(F.col(f"{k}2")).alias(k) for k in ("noun", "i"))).distinct()
    return c.groupBy("image", "noun").agg(F.count("*").alias("lost"))


COUNT_CAPTIONS = ["two red cows and a dog", "a group of cows near 3 dogs", "a pair of cows", "one dog, twelve cows", "a dogs show with a single dog", "several brown cows", "an old small tired grey dog", "a stack of five dogs", "cows", "a herd of two cows", "an old grey dog by ten or more big cows"]


@query(f"""WITH b AS (SELECT p_partkey AS id, {_s_pick(COUNT_CAPTIONS, 'p_partkey')} AS t, {_s_pick(['cow', 'dog'], 'p_partkey // 11')} AS n FROM part), w AS (SELECT id, n, n || 's' AS m, list_transform(string_split(t, ' '), lambda x: replace(x, ',', '')) AS w, string_split(t, ' ') AS raw FROM b),
k AS (SELECT id, n, m, w, raw, list_filter(range(1, len(w) + 1), lambda i: list_contains({_sql([*lexicon.NUMBER_WORDS[1:13], 'a', 'an', 'single'])}, w[i]) OR regexp_matches(w[i], '^[0-9]+$')) AS k FROM w),
j AS (SELECT id, n, m, w, list_filter(list_transform(k, lambda i: [i, list_min(list_filter(range(i + 1, i + 5), lambda j: j <= len(w) AND (w[j] = n OR w[j] = m) AND len(list_filter(range(i, j), lambda q: raw[q] LIKE '%,')) = 0))]), lambda z: z[2] IS NOT NULL) AS z FROM k),
v AS (SELECT id, list_filter(list_transform(z, lambda z: CASE WHEN list_has_any(w[z[1] + 1:z[2] - 1], {_sql(f.VAGUE)}) THEN NULL WHEN list_contains(w[z[1] + 1:z[2] - 1], 'pair') THEN 2 WHEN w[z[1]] IN ('a', 'an', 'single') THEN CASE WHEN w[z[2]] = n THEN 1 END WHEN regexp_matches(w[z[1]], '^[0-9]+$') THEN w[z[1]]::INT ELSE (list_position({_sql(lexicon.NUMBER_WORDS)}, w[z[1]]) - 1)::INT END), lambda x: x IS NOT NULL) AS v FROM j) SELECT id, v[1] AS n FROM v""")
def caption_counts(spark, sf):
    """The number that a caption gives an object."""
    n = F.col("n")
    d = _parts(spark, sf).select("id", _pick(COUNT_CAPTIONS, _id()).alias("t"), _pick(["cow", "dog"], F.floor(_id() / 11)).alias("n"))
    return d.select("id", f.caption_count(F.col("t"), n, F.concat(n, F.lit("s"))).cast("int").alias("n"))
