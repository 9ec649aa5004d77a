"""Curation rules over built-in captions, steps and items, dealt to the rows of `part`, each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.functions import curation as c
from loomery.functions import lexicon
from loomery.plans.queries import query, r6
from loomery.session import table

CAPTIONS = [
    "A red cow stands to the left of two wooden barns.", "Three pink cookies on a plate without a lid.", "The sign is now brighter than before, replacing the old one.", "A taller man beside the sea, no bench in sight.",
    "", "A small dog runs  behind the fence with a blue ball.", "The saturation has been increased; more vivid than the previous image.", "Four children are jogging near an empty house", "a cat", "The word 'OPEN' is painted on the door.",
    "Knives, forks and seven plates rest on the table in the kitchen.", "A bottle of water and a sandwich on the wooden desk.",
]
STEPS = [
    "1. Add a calendar and change the plates", "Remove one dog so that there are three dogs.", "Add a kiosk to the scene", "Keep the background unchanged.", "Replace the erasers and the dish with four marble erasers, a triangle", "Move the cow between the barn and the fence",
    "Add two coins to make a total of five coins", "- Change the dress to purple and adjust the lighting", "  ", "Change the sky to night, then remove the moon", "Make the red cow larger", "Paint the door blue in the image!",
    "The first image shows a cat", "Correction: add a cat", "Add a wooden barn to the left of the red cow", "Remove the lid from the plate", "Add three pink cookies on the plate", "Ensure the ball stays blue", "Add the word OPEN, a door and the paint", "Change the number of children",
    "Replace the bench with a taller man beside the sea", "Add a second bottle of water", "Move the children near the house and moving the dog", "* Remove the fence, leaving the dog behind it",
]
ITEMS = [
    "The lid should not be present", "A planet should not be present", "The cow is green instead of red", "The man is shorter instead of sitting on a throne", "The door says 'SHUT' instead of 'OPEN'", "The plate is missing", "Everything looks good", "The detector counts one cookie",
    "However, the dog is brown", "A soap bar is not mentioned in the caption", "Add a cookie", "There are four or five dogs", "The joggers are walking instead of jogging", "The man is left instead of taller", "There are no barns", "The bench is unwanted", "Only two children appear near the house",
    "The knife is a spoon instead of a unicorn", "", "The caption does not ask for water",
]
CORRECTIONS = [
    "Add a wooden barn to the left of the red cow. Keep the sky as it is.", "Change the dress to purple while maintaining the pose; remove the hat.", "Ensure the light remains consistent. Maintain the style.", "Remove the lid from the plate! Add three pink cookies, keeping the plate white.",
    "No edits are required.", "EDIT_OPERATION on the <old_thing>", "The right panel of the diptych should show a cat", "Make sure the cow is red and ensuring that the barn remains unchanged in place.",
]
TURNS = ["look <image> Self-reflect: the cow is green\nCorrection: make it red <image> ", "Correction: add a cat", "Self-reflection:  no barn \n Self-Correction : add a barn", "A plain caption without marker", "pre Self-reflect: x Correction:   ", "Correction: a Correction: b\n<image>"]


def _sql(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pick(words, key) -> F.Column:
    return F.get(F.array(*map(F.lit, words)), (key % len(words)).cast("int"))


def _s_pick(words, key: str) -> str:
    return f"{_sql(words)}[(({key}) % {len(words)})::INT + 1]"


def _parts(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"))


def _id():
    return F.col("id")


def _s_trim(x: str) -> str:
    return f"trim({x}, ' ')"


_TURN = f"regexp_extract(t, {_q(c.TURN)}, ['pre', 'm', 'sr', 'cm', 'corr', 'post'])"


@query(f"WITH x AS (SELECT p_partkey AS id, {_s_pick(TURNS, 'p_partkey')} || CASE WHEN p_partkey % 6 = 1 THEN ' of size ' || p_size ELSE '' END AS t FROM part), y AS (SELECT id, regexp_matches(t, {_q(c.TURN)}) AS ok, {_TURN} AS g FROM x) SELECT id, CASE WHEN k THEN g.pre END AS pre, CASE WHEN k AND g.m <> '' THEN trim(g.sr, ' ') END AS self_reflect, CASE WHEN k THEN trim(g.corr, ' ') END AS correction, CASE WHEN k THEN g.post END AS post FROM (SELECT *, ok AND trim(g.corr, ' ') <> '' AS k FROM y)")
def turn_parts(spark, sf):
    """A turn split into what stands before, Self-reflect, Correction and what stands after."""
    text = F.concat(_pick(TURNS, _id()), F.when(_id() % 6 == 1, F.concat(F.lit(" of size "), F.col("p_size").cast("string"))).otherwise(""))
    d = table(spark, sf, "part").withColumnRenamed("p_partkey", "id").select("id", text.alias("t"))
    d = d.select("id", c.split_turn(F.col("t")).alias("p"))
    return d.select("id", "p.pre", "p.self_reflect", "p.correction", "p.post")


@query(f"""WITH x AS (SELECT p_partkey AS id, [{_s_pick(TURNS, 'p_partkey')}, {_s_pick(TURNS, 'p_partkey // 6')}, {_s_pick(TURNS, 'p_partkey // 36')}] AS t, ['human', CASE WHEN p_partkey % 2 = 0 THEN 'gpt' ELSE 'human' END, 'gpt'] AS f FROM part),
y AS (SELECT id, f, list_transform(t, lambda v: contains(v, 'orrection') AND regexp_matches(v, {_q(c.TURN)}) AND trim(regexp_extract(v, {_q(c.TURN)}, 5), ' ') <> '') AS ok FROM x),
z AS (SELECT id, list_position(list_transform(range(1, 4), lambda i: f[i] = 'gpt' AND ok[i]), true) AS g, list_position(list_transform(range(1, 4), lambda i: f[i] = 'human' AND ok[i]), true) AS h FROM y) SELECT id, (CASE WHEN g > 0 THEN g - 1 WHEN h > 0 THEN h - 1 END)::BIGINT AS place FROM z""")
def edit_turn_place(spark, sf):
    """The turn that holds the Correction; the model's turn wins."""
    turn = lambda role, text: F.struct(role.alias("from"), text.alias("value"))
    turns = F.array(turn(F.lit("human"), _pick(TURNS, _id())), turn(F.when(_id() % 2 == 0, "gpt").otherwise("human"), _pick(TURNS, F.floor(_id() / 6))), turn(F.lit("gpt"), _pick(TURNS, F.floor(_id() / 36))))
    return _parts(spark, sf).select("id", turns.alias("t")).select("id", c.edit_turn(F.col("t")).cast("long").alias("place"))


def _s_first(rules: dict[str, str], text: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {_q(p)}) THEN '{n}'" for n, p in rules.items()) + " END"


@query(f"SELECT p_partkey AS id, {_s_first(c.JUNK, 't')} AS reason FROM (SELECT p_partkey, coalesce(CASE WHEN p_partkey % 3 > 0 THEN {_s_pick(ITEMS, 'p_partkey')} END, '') || chr(10) || {_s_pick(CORRECTIONS, 'p_partkey')} AS t FROM part)")
def junk_reasons(spark, sf):
    """the first junk pattern of a row's critique and correction."""
    return _parts(spark, sf).select("id", c.junk_reason(F.when(_id() % 3 > 0, _pick(ITEMS, _id())), _pick(CORRECTIONS, _id())).alias("reason"))


@query(f"SELECT p_partkey AS id, regexp_matches(t, {_q(c.DELTA)}) AS loose, regexp_matches(t, {_q(c.DELTA_STRICT)}) AS strict FROM (SELECT p_partkey, {_s_pick(CAPTIONS, 'p_partkey')} || CASE WHEN p_partkey % 5 = 0 THEN ' more green than red' ELSE '' END AS t FROM part)")
def caption_deltas(spark, sf):
    """captions that read as the difference of two images, by the loose and the strict pattern."""
    t = F.concat(_pick(CAPTIONS, _id()), F.when(_id() % 5 == 0, " more green than red").otherwise(""))
    return _parts(spark, sf).select("id", t.alias("t")).select("id", F.col("t").rlike(c.DELTA).alias("loose"), F.col("t").rlike(c.DELTA_STRICT).alias("strict"))


def _s_numbered(x: str) -> str:
    return f"array_to_string(list_transform(range(1, len({x}) + 1), lambda i: i || '. ' || {x}[i]), chr(10))"


@query(f"WITH x AS (SELECT p_partkey AS id, {_s_pick(STEPS, 'p_partkey')} AS a, {_s_pick(ITEMS, 'p_partkey')} AS b FROM part) SELECT id, 'pre Self-reflect:' || chr(10) || {_s_numbered('[b]')} || chr(10) || 'Correction:' || chr(10) || {_s_numbered('[a, b]')} || chr(10) || '<image>' AS turn, CASE WHEN id % 4 = 0 THEN {_q(c.NO_ISSUE_CRITIQUE)} ELSE '<image>' || chr(10) || 'Self-reflect:' || chr(10) || {_s_numbered('[b]')} || chr(10) || 'Correction:' || chr(10) || {_s_numbered('[a]')} END AS critique FROM x")
def rebuilt_turns(spark, sf):
    """A turn and a critique rebuilt with numbered items; no correction gives the fixed text."""
    d = _parts(spark, sf).select("id", _pick(STEPS, _id()).alias("a"), _pick(ITEMS, _id()).alias("b"), c.split_turn(F.lit("pre Self-reflect: x\nCorrection: y \n<image> ")).alias("p"))
    no = F.array().cast("array<string>")
    return d.select("id", c.rebuild_turn(F.col("p"), F.array("b"), F.array("a", "b")).alias("turn"), c.critique_text(F.array("b"), F.when(_id() % 4 == 0, no).otherwise(F.array("a"))).alias("critique"))


_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in c.ACTIONS.items()) + "}"
_S_FIRST = lambda s: f"regexp_extract({s}, '^\\s*(\\S+)', 1)"
_S_SECOND = lambda s: f"len(list_filter(regexp_extract_all({s}, {_q(c.SECOND_ACTION)}, 1), lambda m: coalesce({_MAP}[substr(lower(m), 1, 4)], '') <> coalesce({_MAP}[substr(lower({_S_FIRST(s)}), 1, 4)], substr(lower({_S_FIRST(s)}), 1, 4)))) > 0"
_S_MANY = lambda s: f"(list_contains({_sql(c.ONE_OBJECT)}, {_S_FIRST(s)}) AND regexp_matches(regexp_replace({s}, {_q(c.BETWEEN)}, 'between', 'g'), {_q(c.MULTI_OBJECT)}))"


@query(f"SELECT p_partkey AS id, {_S_SECOND('t')} AS second_action, {_S_MANY('t')} AS several_objects FROM (SELECT p_partkey, {_s_pick(STEPS, 'p_partkey')} || CASE WHEN p_partkey % 7 = 0 THEN ' and deleting a tree' ELSE '' END AS t FROM part)")
def step_actions(spark, sf):
    """steps that join a second action, and steps that list several objects."""
    t = F.concat(_pick(STEPS, _id()), F.when(_id() % 7 == 0, " and deleting a tree").otherwise(""))
    return _parts(spark, sf).select("id", t.alias("t")).select("id", c.second_action(F.col("t")).alias("second_action"), c.several_objects(F.col("t")).alias("several_objects"))


_S_SIMPLE = lambda s: f"trim(regexp_replace(CASE WHEN list_contains({_sql(c.ONE_OBJECT)}, {_S_FIRST(s)}) THEN regexp_replace({s}, {_q(c.COUNT_TAIL)}, '', 'g') ELSE {s} END, {_q(c.SCENE)}, '', 'g'), ' ')"


@query(f"SELECT id, CASE WHEN t = '' OR regexp_matches(t, '[.!?]$') THEN t ELSE t || '.' END AS step FROM (SELECT p_partkey AS id, {_S_SIMPLE(_s_pick(STEPS, 'p_partkey'))} AS t FROM part)")
def simplified_steps(spark, sf):
    """Steps without consequence tails and scene fillers."""
    return _parts(spark, sf).select("id", c.simplify_step(_pick(STEPS, _id())).alias("step"))


_S_SPLIT = lambda t: f"string_split(regexp_replace({_s_trim(t)}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"
_S_KEPT = lambda t: f"list_filter(list_transform(list_filter({_S_SPLIT(t)}, lambda s: NOT regexp_matches(s, {_q(c.KEEP_SENTENCE)}) AND NOT regexp_matches(s, {_q(c.ENSURE_SENTENCE)})), lambda s: regexp_replace(s, {_q(c.KEEP_CLAUSE)}, '', 'g')), lambda s: {_s_trim('s')} <> '')"
_S_EDIT = lambda t: f"CASE WHEN len({_S_KEPT(t)}) = 0 THEN {t} ELSE array_to_string({_S_KEPT(t)}, ' ') END"


@query(f"SELECT id, {_S_EDIT('t')} AS edit FROM (SELECT p_partkey AS id, {_s_pick(CORRECTIONS, 'p_partkey')} || ' ' || {_s_pick(CORRECTIONS, 'p_partkey // 8')} AS t FROM part)")
def edit_texts(spark, sf):
    """Corrections without their preservation clauses."""
    return _parts(spark, sf).select("id", F.concat_ws(" ", _pick(CORRECTIONS, _id()), _pick(CORRECTIONS, F.floor(_id() / 8))).alias("t")).select("id", c.edit_text(F.col("t")).alias("edit"))


_S_STEMS = lambda t: f"list_filter(list_distinct(list_transform(list_filter(regexp_extract_all(lower({t}), '[a-z0-9'']+'), lambda w: length(w) > 2 AND NOT list_contains({_sql(c.STOP)}, w)), lambda w: substr(w, 1, 5))), lambda w: NOT list_contains({_sql(c.META)}, w))"
_S_COVER = lambda a, b: f"CASE WHEN len({_S_STEMS(a)}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({_S_STEMS(a)}, {_S_STEMS(b)}))::DOUBLE / len({_S_STEMS(a)}) END"


@query(f"SELECT id, array_to_string(list_sort({_S_STEMS('a')}), ' ') AS stems, round({_S_COVER('a', 'b')}, 6) AS covered FROM (SELECT p_partkey AS id, {_s_pick(CORRECTIONS, 'p_partkey')} AS a, {_s_pick(STEPS, 'p_partkey')} || ' ' || {_s_pick(STEPS, 'p_partkey // 24')} AS b FROM part)")
def step_coverage(spark, sf):
    """Content stems without stop and meta words, and how many of them the steps keep."""
    a, b = _pick(CORRECTIONS, _id()), F.array(_pick(STEPS, _id()), _pick(STEPS, F.floor(_id() / 24)))
    return _parts(spark, sf).select("id", F.array_join(F.array_sort(c.content_stems(a)), " ").alias("stems"), r6(c.covers(a, b)).alias("covered"))


@query(f"""WITH x AS (SELECT p_partkey AS id, {_s_pick(CAPTIONS, 'p_partkey')} AS o, CASE WHEN p_partkey % 13 = 0 THEN NULL WHEN p_partkey % 11 = 0 THEN '<image> x' ELSE {_s_pick(CAPTIONS, 'p_partkey + (p_partkey // 12) % 3')} END AS n FROM part), y AS (SELECT id, o, trim(regexp_replace(n, '\\s+', ' ', 'g'), ' ') AS n FROM x)
SELECT id, CASE WHEN coalesce(n, '') = '' THEN 'missing' WHEN contains(n, '<image>') THEN 'image' WHEN regexp_matches(n, {_q(c.DELTA_STRICT)}) THEN 'delta' WHEN {_S_COVER('o', 'n')} < 0.5 THEN 'drops' WHEN {_S_COVER('n', 'o')} < 0.8 THEN 'adds' END AS reason FROM y""")
def caption_reasons(spark, sf):
    """why a rewritten caption is turned down, by coverage both ways."""
    new = F.when(_id() % 13 == 0, F.lit(None)).when(_id() % 11 == 0, "<image> x").otherwise(_pick(CAPTIONS, _id() + F.floor(_id() / 12) % 3))
    return _parts(spark, sf).select("id", _pick(CAPTIONS, _id()).alias("o"), new.alias("n")).select("id", c.caption_reason(F.col("n"), F.col("o")).alias("reason"))


_S_CLEAN = lambda x: f"list_filter(list_transform({x}, lambda s: regexp_replace(trim(regexp_replace(s, '\\s+', ' ', 'g'), ' '), {_q(c.NUMBERING)}, '')), lambda s: s <> '')"
_S_ANY = lambda x, p: f"len(list_filter({x}, lambda s: regexp_matches(s, {_q(p)}))) > 0"
_S_BAD = lambda x: f"CASE WHEN len(list_filter({x}, lambda s: contains(s, '<image>') OR regexp_matches(s, {_q(c.SECTION)}))) > 0 THEN 'marker' WHEN {_S_ANY(x, c.STEP_LEAK)} THEN 'leak' END"


def _reply(steps: int, items: int):
    """Steps and items of a row: places of the built-in ones."""
    take = lambda words, n, m: F.array(*(_pick(words, _id() * m + F.floor(_id() / 7) * k + k) for k in range(n)))
    return F.when(_id() % 19 == 0, F.array().cast("array<string>")).otherwise(take(STEPS, steps, 7)), F.when(_id() % 17 == 0, F.array().cast("array<string>")).otherwise(take(ITEMS, items, 3))


def _s_reply(steps: int, items: int) -> str:
    take = lambda words, n, m: "[" + ", ".join(_s_pick(words, f"p_partkey*{m} + (p_partkey // 7)*{k} + {k}") for k in range(n)) + "]"
    return f"CASE WHEN p_partkey % 19 = 0 THEN []::VARCHAR[] ELSE {take(STEPS, steps, 7)} END AS st, CASE WHEN p_partkey % 17 = 0 THEN []::VARCHAR[] ELSE {take(ITEMS, items, 3)} END AS it"


@query(f"""WITH x AS (SELECT p_partkey AS id, {_s_pick(CORRECTIONS, 'p_partkey')} AS corr, CASE WHEN p_partkey % 2 = 0 THEN {_s_pick(ITEMS, 'p_partkey')} END AS refl, {_s_reply(3, 2)} FROM part), y AS (SELECT id, corr, refl, {_S_CLEAN('st')} AS st, {_S_CLEAN('it')} AS it FROM x),
z AS (SELECT *, array_to_string(st, ' ') AS sj, array_to_string(list_concat(it, st), ' ') AS ij, list_filter(list_transform(st, lambda s: CASE WHEN {_S_SECOND('s')} THEN 'second_action' WHEN regexp_matches(s, {_q(c.KEEP_STEP)}) THEN 'keep' END), lambda r: r IS NOT NULL) AS bad FROM y), e AS (SELECT *, {_S_EDIT('corr')} AS ed FROM z)
SELECT id, coalesce({_S_BAD('st')}, {_S_BAD('it')}, CASE WHEN len(st) = 0 THEN 'empty' WHEN len(st) > 12 THEN 'too_many' WHEN refl IS NOT NULL AND (len(it) < 1 OR len(it) > 12) THEN 'reflect_size' WHEN refl IS NOT NULL AND {_S_COVER('refl', 'ij')} < 0.3 THEN 'reflect_drops' WHEN {_S_COVER('ed', 'sj')} < 0.1 THEN 'drops' ELSE bad[1] END) AS reason FROM e""")
def decompose_reasons(spark, sf):
    """why a decomposition is turned down, first rule first."""
    st, it = _reply(3, 2)
    d = _parts(spark, sf).select("id", _pick(CORRECTIONS, _id()).alias("corr"), F.when(_id() % 2 == 0, _pick(ITEMS, _id())).alias("refl"), c.clean_steps(st).alias("st"), c.clean_steps(it).alias("it"))
    return d.select("id", c.decompose_reason(F.col("st"), F.col("it"), F.col("corr"), F.col("refl"), least=0.1, least_reflect=0.3).alias("reason"))


_S_IRR = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in lexicon.IRREGULAR.items()) + "}"


def _s_singular(w: str) -> str:
    rules = "".join(f" WHEN {w} LIKE '%{end}' AND length({w}) > {len(end) + 1} THEN substr({w}, 1, length({w}) - {len(end)}) || '{new}'" for end, new in lexicon.SUFFIXES.items())
    many = "".join(f" WHEN {w} LIKE '%{k}' THEN substr({w}, 1, length({w}) - {len(k)}) || '{v}'" for k, v in lexicon.IRREGULAR.items())
    return f"CASE WHEN {_S_IRR}[{w}] IS NOT NULL THEN {_S_IRR}[{w}]{rules} WHEN {w} LIKE '%s' AND NOT regexp_matches({w}, '(ss|us|is)$') AND length({w}) > 3 THEN substr({w}, 1, length({w}) - 1){many} ELSE {w} END"


def _s_stem(w: str) -> str:
    ends = "".join(f" WHEN s LIKE '%{e}' AND length(s) > {len(e) + 3} THEN substr(s, 1, length(s) - {len(e)})" for e in ("ing", "ed", "ly", "er", "est"))
    return f"list_transform([{_s_singular(w)}], lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$') THEN s{ends} ELSE s END)[1]"


_S_GROUND = lambda t: f"list_distinct(list_transform(list_transform(list_filter(regexp_extract_all(lower({t}), '[a-z0-9][a-z0-9'']*'), lambda w: NOT list_contains({_sql(c.GROUND_STOP)}, w) AND (length(w) > 2 OR regexp_matches(w, '^[0-9]+$'))), lambda w: regexp_replace(w, '^''+|''+$', '', 'g')), lambda w: {_s_stem('w')}))"
_S_MATCH = lambda a, b: f"(len(list_filter({a}, lambda x: len(list_filter({b}, lambda y: x = y OR (length(x) >= 4 AND length(y) >= 4 AND (starts_with(x, y) OR starts_with(y, x))))) > 0)) > 0)"


@query(f"SELECT id, array_to_string(list_sort(a), ' ') AS words, {_S_MATCH('a', 'b')} AS same FROM (SELECT p_partkey AS id, {_S_GROUND(_s_pick(CAPTIONS, 'p_partkey'))} AS a, {_S_GROUND(_s_pick(ITEMS, 'p_partkey // 12'))} AS b FROM part)")
def ground_words(spark, sf):
    """Content words by the critic's stemmer, and whether two texts share one."""
    d = _parts(spark, sf).select("id", c.ground_words(_pick(CAPTIONS, _id())).alias("a"), c.ground_words(_pick(ITEMS, F.floor(_id() / 12))).alias("b"))
    return d.select("id", F.array_join(F.array_sort("a"), " ").alias("words"), c.words_match(F.col("a"), F.col("b")).alias("same"))


def _s_ungrounded(item: str, cap: str) -> str:
    excluded = f"array_to_string(regexp_extract_all({cap}, {_q(c.NEGATION)}), ' ')"
    want = f"regexp_extract({item}, {_q(c.INSTEAD_OF)}, 1)"
    tokens = lambda t: f"regexp_extract_all(lower({t}), '[a-z0-9][a-z0-9'']*')"
    quoted = f"len(list_filter(regexp_extract_all({want}, {_q(c.QUOTED)}, 1), lambda z: contains(lower({cap}), lower(z)))) > 0"
    spatial = f"(list_has_any({tokens(want)}, {_sql(c.SPATIAL)}) AND list_has_any({tokens(cap)}, {_sql(c.SPATIAL)}))"
    return f"CASE WHEN regexp_matches({item}, {_q(c.SHOULD_NOT)}) AND NOT {_S_MATCH(_S_GROUND(item), _S_GROUND(excluded))} THEN 'not_excluded' WHEN regexp_matches({item}, {_q(c.INSTEAD_OF)}) AND NOT {quoted} AND len({_S_GROUND(want)}) > 0 AND NOT {_S_MATCH(_S_GROUND(want), _S_GROUND(cap))} AND NOT {spatial} THEN 'not_asked' END"


@query(f"SELECT id, {_s_ungrounded('i', 'cap')} AS reason FROM (SELECT p_partkey AS id, {_s_pick(ITEMS, 'p_partkey')} AS i, {_s_pick(CAPTIONS, 'p_partkey // 20')} AS cap FROM part)")
def ungrounded_items(spark, sf):
    """items that fault what the caption does not ask for."""
    return _parts(spark, sf).select("id", _pick(ITEMS, _id()).alias("i"), _pick(CAPTIONS, F.floor(_id() / 20)).alias("cap")).select("id", c.ungrounded(F.col("i"), F.col("cap")).alias("reason"))


_S_STEP_SIMPLE = lambda x: f"list_transform(list_transform({x}, lambda s: {_S_SIMPLE('s')}), lambda s: CASE WHEN s = '' OR regexp_matches(s, '[.!?]$') THEN s ELSE s || '.' END)"


@query(f"""WITH x AS (SELECT p_partkey AS id, {_s_pick(CAPTIONS, 'p_partkey')} AS cap, {_s_reply(2, 1)} FROM part), y AS (SELECT id, cap, {_S_CLEAN('st')} AS st0, {_S_CLEAN('it')} AS it FROM x), v AS (SELECT *, {_S_STEP_SIMPLE('st0')} AS st FROM y),
z AS (SELECT *, list_concat(it, st) AS ev, list_filter(list_transform(it, lambda s: coalesce(CASE WHEN regexp_matches(s, {_q(c.NOT_A_PROBLEM)}) THEN 'no_problem' WHEN regexp_matches(s, {_q(c.NOT_ASKED)}) THEN 'not_asked_for' END, {_s_ungrounded('s', 'cap')}, CASE WHEN list_contains({_sql(c.VERBS)}, {_S_FIRST('s')}) THEN 'instruction' END)), lambda r: r IS NOT NULL) AS bi,
list_filter(list_transform(st, lambda s: CASE WHEN NOT list_contains({_sql(c.VERBS)}, {_S_FIRST('s')}) THEN 'verb' WHEN {_S_SECOND('s')} THEN 'second_action' WHEN {_S_MANY('s')} THEN 'several_objects' WHEN regexp_matches(s, {_q(c.KEEP_STEP)}) THEN 'keep' END), lambda r: r IS NOT NULL) AS bs FROM v)
SELECT id, coalesce({_S_BAD('st0')}, {_S_BAD('it')}, CASE WHEN len(st) = 0 AND len(it) = 0 THEN CASE WHEN id % 2 = 0 THEN 'count' END WHEN len(st) = 0 OR len(it) = 0 THEN 'one_list' WHEN {_S_ANY('ev', c.NO_ISSUE)} THEN 'no_issue'
WHEN len(list_filter(ev, lambda s: regexp_matches(s, {_q(c.DETECTOR)}) OR len(regexp_extract_all(s, '\\S+')) > 9)) > 0 THEN list_filter(list_transform(ev, lambda s: CASE WHEN regexp_matches(s, {_q(c.DETECTOR)}) THEN 'detector' WHEN len(regexp_extract_all(s, '\\S+')) > 9 THEN 'long' END), lambda r: r IS NOT NULL)[1] ELSE coalesce(bi[1], bs[1]) END) AS reason FROM z""")
def critic_reasons(spark, sf):
    """why a critic's reply is turned down, first rule first."""
    st, it = _reply(2, 1)
    d = _parts(spark, sf).select("id", _pick(CAPTIONS, _id()).alias("cap"), F.transform(c.clean_steps(st), c.simplify_step).alias("st"), c.clean_steps(it).alias("it"))
    return d.select("id", c.critic_reason(F.col("it"), F.col("st"), F.col("cap"), _id() % 2 == 0, words=9).alias("reason"))
