"""Conversations, token streams, templates, joins and orders of rows, each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomery.operators import recast
from loomery.operators.sampling import seed_key
from loomery.plans.curation import _id, _parts, _pick, _q, _s_pick
from loomery.plans.queries import query, r6
from loomery.session import table

_TURNS = "list({'from': CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END, 'value': CASE WHEN conv_id % 5 = 0 THEN '<image> ' || text ELSE text END} ORDER BY turn)"


def _conversations(spark, sf):
    role = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    value = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("<image> "), F.col("text"))).otherwise(F.col("text"))
    one = F.struct("turn", role.alias("from"), value.alias("value"))
    d = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("m"))
    return d.select("conv_id", F.transform("m", lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value"))).alias("t"))


@query("""WITH x AS (SELECT p_partkey AS id, [CASE WHEN p_size % 3 > 0 THEN p_name END, CASE WHEN p_size % 4 > 0 THEN p_brand END, CASE WHEN p_size % 5 > 0 THEN p_type END] AS v FROM part), y AS (SELECT id, list_filter(v, lambda z: z IS NOT NULL) AS w FROM x)
SELECT id, w[(id % greatest(len(w), 1))::INT + 1] AS drawn, w[1] AS first, CASE WHEN id % 2 = 0 AND id % 7 < 3 THEN 's' || id ELSE 'long ' || id END AS caption FROM y""")
def conversation_variants(spark, sf):
    """One of a row's variants, the first one for validation; the short caption for a share of rows."""
    c = lambda k, name: F.when(F.col("p_size") % k > 0, F.col(name))
    v = [c(3, "p_name"), c(4, "p_brand"), c(5, "p_type")]
    d = table(spark, sf, "part").withColumn("id", F.col("p_partkey"))
    caption = recast.short_or_long(F.concat(F.lit("long "), _id().cast("string")), F.when(_id() % 2 == 0, F.concat(F.lit("s"), _id().cast("string"))), (_id() % 7) / 6.0)
    return d.select("id", recast.variant(v, _id()).alias("drawn"), recast.variant(v).alias("first"), caption.alias("caption"))


@query(f"""WITH c AS (SELECT conv_id, {_TURNS} AS t FROM conversations GROUP BY 1), p AS (SELECT *, list_position(list_transform(t, lambda x: x['from']), 'human') AS h FROM c)
SELECT conv_id, (CASE WHEN h > 0 AND NOT contains(t[h].value, '<image>') AND NOT contains(t[h].value, 'orrection') AND trim(t[h].value, ' ') <> '' THEN h - 1 END)::INT AS place,
md5(array_to_string(list_transform(range(1, len(t) + 1), lambda i: CASE WHEN i = h THEN 'new' ELSE t[i].value END), '|')) AS replaced, md5(array_to_string(list_transform(t, lambda x: CASE WHEN x['from'] = 'gpt' THEN 'critique' ELSE x.value END), '|')) AS answers FROM p""")
def caption_turns(spark, sf):
    """The caption's turn, and turns with a new caption or new answers."""
    d, t = _conversations(spark, sf), F.col("t")
    joined = lambda x: F.md5(F.array_join(F.transform(x, lambda m: m["value"]), "|"))
    return d.select("conv_id", recast.caption_place(t).alias("place"), joined(recast.replace_caption(t, F.lit("new"))).alias("replaced"), joined(recast.replace_answers(t, F.lit("critique"))).alias("answers"))


_CORR = ["make it red", "looks good", "", "No issues here", "add a cat"]


@query(f"""WITH x AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey % 4 END AS images, {_s_pick(_CORR, 'p_partkey')} AS c FROM part)
SELECT id, CASE WHEN coalesce(images, 0) <> 2 THEN 'images' WHEN coalesce(c, '') = '' THEN 'no_instruction' WHEN regexp_matches(c, '(?i)looks\\s+good|no\\s+issues') THEN 'no_edit' END AS reason, '<image>' || chr(10) || 'Edit the image: ' || c AS pair, '<image>' || chr(10) || 'Correction: ' || c || chr(10) || '<image>' AS triple FROM x""")
def edit_rows(spark, sf):
    """Rows recast as edit pairs and refinements, and why others cannot be."""
    c = _pick(_CORR, _id())
    d = _parts(spark, sf).select("id", F.when(_id() % 7 > 0, _id() % 4).alias("images"), c.alias("c"))
    return d.select("id", recast.edit_reject(F.col("images"), F.col("c")).alias("reason"), F.get(recast.edit_pair(F.col("c")), F.lit(0))["value"].alias("pair"), F.get(recast.refine_triple(F.col("c")), F.lit(1))["value"].alias("triple"))


_TOK = "t AS (SELECT p_partkey AS id, list_transform(range(0, 16), lambda s: ((p_partkey*7 + s*s*5 + s*3) % 13)::INT) AS t FROM part)"


def _tokens(spark, sf):
    one = lambda s: F.pmod(F.col("p_partkey") * 7 + s * s * 5 + s * 3, F.lit(13)).cast("int")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(*(one(s) for s in range(16))).alias("t"))


@query(f"""WITH {_TOK}, s AS (SELECT id, t, list_transform(list_filter(range(1, 17), lambda i: t[i] = 12 AND i > 4), lambda i: [CASE WHEN i > 1 AND t[i - 1] = 11 THEN i - 1 ELSE i END, CASE WHEN i < 16 AND t[i + 1] = 10 THEN i + 2 ELSE i + 1 END]) AS p FROM t)
SELECT id, 12 - len(list_filter(range(5, 17), lambda i: len(p) > 0 AND i >= p[1][1] AND i < p[1][2])) AS first, 12 - len(list_filter(range(5, 17), lambda i: len(list_filter(p, lambda z: i >= z[1] AND i < z[2])) > 0)) AS every, CASE WHEN len(p) >= 2 THEN len(list_filter(range(5, 17), lambda i: i >= p[len(p)][1])) END AS to_last FROM s""")
def masked_labels(spark, sf):
    """Labels left when the first image, every image, or all before the last image is masked."""
    d = _tokens(spark, sf).withColumn("l", F.transform("t", lambda x, i: i >= 4))
    d = d.withColumn("s", recast.image_spans(F.col("t"), F.col("l"), 12, 11, 10))
    left = lambda m: F.size(F.filter(m, lambda x: x)).cast("long")
    to_last = recast.mask_to_last(F.col("l"), F.col("s"))
    return d.select("id", left(recast.mask_first(F.col("l"), F.col("s"))).alias("first"), left(recast.mask_all(F.col("l"), F.col("s"))).alias("every"), F.when(to_last.isNotNull(), left(to_last)).alias("to_last"))


@query(f"""WITH {_TOK}, e AS (SELECT id, t, len(t) - list_position(list_reverse(t), 9) + 1 AS e FROM t), r AS (SELECT id, list_filter(range(1, 17), lambda i: t[i] >= 6 AND (i = 1 OR t[i - 1] < 6)) AS a, list_filter(range(1, 17), lambda i: t[i] >= 6 AND (i = 16 OR t[i + 1] < 6)) AS z, t FROM t)
SELECT id, array_to_string(CASE WHEN list_contains(e.t, 9) THEN list_concat(e.t[1:e.e - 1], e.t[e.e + 1:16]) ELSE e.t END, ',') AS dropped, array_to_string(list_concat(r.t[a[1]:z[1]], [0, 0, 0, 0])[1:4], ',') AS one, array_to_string(list_concat(r.t[a[2]:z[2]], [0, 0, 0, 0])[1:4], ',') AS two, array_to_string(r.t[z[1] + 1:coalesce(a[2] - 1, 16)], ',') AS reflection,
array_to_string(list_concat([7, 7, 7, 7][1:greatest(4 - (z[1] - a[1] + 1), 0)], r.t[a[1]:z[1]])[1:4], ',') AS left_padded FROM e JOIN r USING (id) WHERE len(a) >= 2""")
def token_streams(spark, sf):
    """The last end dropped; two runs of codes, fitted, and what stands between them."""
    d = _tokens(spark, sf).withColumn("r", recast.runs(F.col("t"), lambda x: x >= 6)).where("size(r) >= 2")
    t, one, two = F.col("t"), F.get("r", F.lit(0)), F.get("r", F.lit(1))
    part = lambda a, z: F.slice(t, a + 1, z - a)
    text = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")
    return d.select("id", text(recast.drop_last(t, 9)).alias("dropped"), text(recast.fitted(part(one["a"], one["z"]), 4)).alias("one"), text(recast.fitted(part(two["a"], two["z"]), 4)).alias("two"), text(part(one["z"], two["a"])).alias("reflection"), text(recast.fitted(part(one["a"], one["z"]), 4, 7, left=True)).alias("left_padded"))


@query("""WITH m AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'Sys' END AS s, p_name AS a, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_brand END AS b FROM part)
SELECT id, s || '#' || 'USER: ' || a || '#' || CASE WHEN b IS NULL THEN 'BOT:' ELSE 'BOT: ' || b || '#' END AS single, s || '#' || 'USER: ' || a || '#' || CASE WHEN b IS NULL THEN 'BOT:' ELSE 'BOT: ' || b || '%' END AS two,
CASE WHEN s = '' THEN '' ELSE s || '#' || chr(10) END || 'USER' || chr(10) || a || '#' || chr(10) || 'BOT' || chr(10) || coalesce(b || '#' || chr(10), '') AS chatml, s || a || '#' || coalesce(b || '%', '') AS plain,
array_to_string(['u', 'answer', 'That answer was rejected: ' || a || ' Answer again with the full JSON object.'], '|') AS retried FROM m""")
def templates(spark, sf):
    """Conversations rendered by separator style, and the messages of a retry."""
    m = F.array(recast.turn("USER", F.col("p_name")), F.struct(F.lit("BOT").alias("from"), F.when(_id() % 4 > 0, F.col("p_brand")).alias("value")))
    s = F.when(_id() % 3 == 0, "").otherwise("Sys")
    d = table(spark, sf, "part").withColumn("id", F.col("p_partkey"))
    retried = recast.retry_messages(F.array(recast.turn("user", "u")), F.lit("answer"), F.col("p_name"))
    return d.select("id", *(recast.template(s, m, k, "#", "%").alias(k) for k in ("single", "two", "chatml", "plain")), F.array_join(F.transform(retried, lambda x: x["value"]), "|").alias("retried"))


_REPLIES = ["<think>hm</think> ```json\n{\"a\": 1}\n```", "<think>never ends", "  plain ", "Sure.\nYES, it is\nno", "no\nyes", "<CAPTION> a  b\n c </CAPTION><EMPTY> </EMPTY>", "<I1><I2><I3><I4><I5><I6><I7> then <I8> <image> tail", "Self-reflect: bad\nCorrection: fix"]


@query(f"""WITH r AS (SELECT p_partkey AS id, {_s_pick(_REPLIES, 'p_partkey')} AS t FROM part)
SELECT id, regexp_replace(CASE WHEN contains(t, '</think>') THEN string_split(t, '</think>')[-1] WHEN NOT contains(t, '<think>') THEN t END, '^\\s*```[a-z]*\\s*|\\s*```\\s*$|^\\s+|\\s+$', '', 'g') AS reply, nullif(lower(regexp_extract(t, '(?im)^\\s*(yes|no)\\b', 1)), '') AS answer,
nullif(trim(regexp_replace(regexp_extract(t, '(?s)<CAPTION>(.*?)</CAPTION>', 1), '\\s+', ' ', 'g'), ' '), '') AS caption, nullif(trim(regexp_replace(regexp_extract(t, '(?s)<EMPTY>(.*?)</EMPTY>', 1), '\\s+', ' ', 'g'), ' '), '') AS empty,
replace(t, '<I1><I2><I3><I4><I5><I6><I7>', '<I1><I2><... 2 image tokens omitted ...><I5><I6><I7>') AS short, array_to_string(string_split(t, '<image>'), '|') AS chunks FROM r""")
def reply_parts(spark, sf):
    """Replies without thinking and fences, answers, tags, short runs of image tokens, chunks around images."""
    d, t = _parts(spark, sf).select("id", _pick(_REPLIES, _id()).alias("t")), F.col("t")
    return d.select("id", recast.reply_text(t).alias("reply"), recast.first_yes_no(t).alias("answer"), recast.tag_text(t, "CAPTION").alias("caption"), recast.tag_text(t, "EMPTY").alias("empty"), recast.collapse_codes(t).alias("short"), F.array_join(recast.between_images(t), "|").alias("chunks"))


@query("SELECT p_partkey AS prompt, s AS sample, CASE WHEN s = 0 THEN 'img' || p_partkey ELSE 'img' || p_partkey || '_' || lpad(s::VARCHAR, 2, '0') END AS name, 'Answer each question.' || chr(10) || '1. ' || p_name || chr(10) || '2. ' || p_type AS questions FROM part, (SELECT unnest(range(0, 3)) AS s)")
def sample_grid(spark, sf):
    """Every prompt with each sample number, output names, and the prompt of its questions."""
    d = table(spark, sf, "part").withColumn("sample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    bare = F.concat(F.lit("img"), F.col("p_partkey").cast("string"))
    name = F.when(F.col("sample") == 0, bare).otherwise(F.concat(bare, F.lit("_"), F.lpad(F.col("sample").cast("string"), 2, "0")))
    return d.select(F.col("p_partkey").alias("prompt"), "sample", name.alias("name"), F.concat(F.lit("Answer each question.\n1. "), "p_name", F.lit("\n2. "), "p_type").alias("questions"))


@query("SELECT p_partkey AS prompt, k AS register, CASE k WHEN 'long' THEN p_name ELSE p_type END AS text, CASE WHEN CASE k WHEN 'long' THEN p_name ELSE p_type END LIKE '%ECONOMY%' THEN 'empty' END AS error FROM part, (SELECT unnest(['short', 'long']) AS k)")
def prompt_registers(spark, sf):
    """A prompt's registers as rows; those without a description are marked, not raised."""
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("prompt"), F.col("p_name").alias("long"), F.col("p_type").alias("short")).unpivot("prompt", ["long", "short"], "register", "text")
    return d.withColumn("error", F.when(F.col("text").contains("ECONOMY"), "empty"))


@query("SELECT doc_id, substr(sha256('3|1|' || CASE WHEN doc_id % 2 = 0 THEN 'resume|40|' ELSE '' END || doc_id), 1, 16) AS place FROM documents")
def resumed_order(spark, sf):
    """Seeded orders by epoch; a resume offset gives another order."""
    fresh, resumed = seed_key(3, 1, F.col("doc_id")), seed_key(3, 1, "resume", 40, F.col("doc_id"))
    return table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, resumed).otherwise(fresh).alias("place"))


@query("WITH n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS c FROM documents) SELECT doc_id, i % 4 AS rank, i // 4 AS step, c < 4 AS too_small FROM n")
def rank_rows(spark, sf):
    """Rows in order per set, dealt to ranks; sets with fewer rows than ranks are marked."""
    i = F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long") - 1
    c = F.count("*").over(Window.partitionBy("source"))
    return table(spark, sf, "documents").select("doc_id", i.alias("i"), c.alias("c")).select("doc_id", (F.col("i") % 4).alias("rank"), F.floor(F.col("i") / 4).alias("step"), (F.col("c") < 4).alias("too_small"))


@query("""WITH b AS (SELECT doc_id, source, doc_id // 16 AS batch, substr(sha256('b|' || source || '|' || doc_id // 16), 1, 8) AS u, substr(sha256('r|' || doc_id), 1, 16) AS h FROM documents), k AS (SELECT * FROM b WHERE ('0x' || u)::BIGINT < 1288490188),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS n FROM k) SELECT doc_id, source FROM n WHERE n <= 3""")
def batch_sample(spark, sf):
    """Rows of about 30 % of the batches, at most three of each file. Not a uniform sample."""
    batch = F.floor(F.col("doc_id") / 16)
    u = F.conv(F.substring(seed_key("b", F.col("source"), batch), 1, 8), 16, 10).cast("long")
    d = table(spark, sf, "documents").where(u < 1288490188)
    n = F.row_number().over(Window.partitionBy("source").orderBy(seed_key("r", F.col("doc_id")), "doc_id"))
    return d.select("doc_id", "source", n.alias("n")).where("n <= 3").select("doc_id", "source")


@query("WITH o AS (SELECT doc_id, CASE WHEN n_chars > 2000 THEN 0 WHEN n_chars < 300 THEN 1 ELSE 2 END AS priority, substr(sha256('p|' || doc_id), 1, 16) AS h FROM documents), r AS (SELECT doc_id, priority, row_number() OVER (ORDER BY priority, h, doc_id) AS place FROM o) SELECT doc_id, priority, place FROM r WHERE place <= 40")
def priority_rows(spark, sf):
    """The first rows by outcome, shuffled inside one."""
    p = F.when(F.col("n_chars") > 2000, 0).when(F.col("n_chars") < 300, 1).otherwise(2)
    d = table(spark, sf, "documents").select("doc_id", p.alias("priority"), seed_key("p", F.col("doc_id")).alias("h")).orderBy("priority", "h", "doc_id").limit(40)
    return d.select("doc_id", "priority", F.row_number().over(Window.orderBy("priority", "h", "doc_id")).cast("long").alias("place"))  # 40 rows


@query("""WITH r AS (SELECT o_orderkey AS i, o_orderkey % 4 AS lane, (o_orderkey // 4) // 25 AS grp FROM orders), u AS (SELECT DISTINCT lane, grp FROM r), n AS (SELECT *, row_number() OVER (ORDER BY grp, lane) - 1 AS k FROM u)
SELECT lane, grp, k % 3 AS task, (k // 3) % 2 AS worker FROM n WHERE (lane + grp) % 5 <> 0""")
def work_units(spark, sf):
    """H16, K08, J-8: units in group-major order dealt to tasks and workers before those already done are left out."""
    i = F.col("o_orderkey")
    u = table(spark, sf, "orders").select((i % 4).alias("lane"), F.floor(F.floor(i / 4) / 25).alias("grp")).distinct()
    # the number follows from the layout, so that no window runs over all units
    k = F.col("grp") * 4 + F.col("lane")
    done = u.where((F.col("lane") + F.col("grp")) % 5 == 0)
    return u.withColumn("k", k).join(done, ["lane", "grp"], "left_anti").select("lane", "grp", (F.col("k") % 3).alias("task"), (F.floor(F.col("k") / 3) % 2).alias("worker"))


@query("""WITH RECURSIVE l AS (SELECT doc_id, n_chars AS n, doc_id // 16 AS mega, row_number() OVER (PARTITION BY doc_id // 16 ORDER BY n_chars DESC, doc_id) AS i, count(*) OVER (PARTITION BY doc_id // 16) AS c FROM documents),
r AS (SELECT doc_id, mega, i, c, 1 AS chunk, [n, 0, 0, 0]::DOUBLE[] AS size, [1, 0, 0, 0] AS many FROM l WHERE i = 1 AND c % 4 = 0 UNION ALL
SELECT doc_id, mega, i, c, chunk, list_transform(range(1, 5), lambda k: CASE WHEN k = chunk THEN CASE WHEN many[k] + 1 = c / 4 THEN 1e300 ELSE size[k] + n END ELSE size[k] END), list_transform(range(1, 5), lambda k: many[k] + CASE WHEN k = chunk THEN 1 ELSE 0 END)
FROM (SELECT l.*, r.size, r.many, list_position(r.size, list_min(r.size)) AS chunk FROM r JOIN l ON l.mega = r.mega AND l.i = r.i + 1))
SELECT doc_id, mega, (chunk - 1)::INT AS chunk FROM r UNION ALL SELECT doc_id, mega, ((i - 1) % 4)::INT FROM l WHERE c % 4 <> 0""")
def balanced_chunks(spark, sf):
    """A megabatch split over chunks of like total length, greedily; dealt in strides where it cannot be even."""
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.floor(F.col("doc_id") / 16).alias("mega"))
    g = d.groupBy("mega").agg(F.array_sort(F.collect_list(F.struct((-F.col("n_chars")).alias("n"), "doc_id"))).alias("m"))
    state = "struct<size:array<double>,many:array<int>,out:array<struct<doc_id:bigint,chunk:int>>>"
    zero = F.struct(F.array(*[F.lit(0.0)] * 4).alias("size"), F.array(*[F.lit(0)] * 4).alias("many"), F.array().cast("array<struct<doc_id:bigint,chunk:int>>").alias("out")).cast(state)

    def step(acc, x):
        k = F.array_position(acc["size"], F.array_min(acc["size"])).cast("int") - 1
        full = F.get(acc["many"], k) + 1 == F.size("m") / 4
        size = F.transform(acc["size"], lambda s, i: F.when(i == k, F.when(full, 1e300).otherwise(s - x["n"])).otherwise(s))
        return F.struct(size.alias("size"), F.transform(acc["many"], lambda c, i: c + (i == k).cast("int")).alias("many"), F.concat(acc["out"], F.array(F.struct(x["doc_id"].alias("doc_id"), k.alias("chunk")))).alias("out")).cast(state)

    even = F.aggregate("m", zero, step)["out"]
    strided = F.transform("m", lambda x, i: F.struct(x["doc_id"].alias("doc_id"), (i % 4).alias("chunk")))
    return g.select("mega", F.explode(F.when(F.size("m") % 4 == 0, even).otherwise(strided)).alias("x")).select("x.doc_id", "mega", "x.chunk")


@query("""WITH a AS (SELECT o_custkey AS prompt, o_orderkey % 5 AS image, max(o_totalprice) AS s FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL), b AS (SELECT o_custkey AS prompt, o_orderkey % 5 AS image, max(o_totalprice) AS s, min(o_orderkey) % 3 AS version FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL),
j AS (SELECT prompt, image, a.s AS s1, b.s AS s2, version FROM a JOIN b USING (prompt, image)), m AS (SELECT c_custkey AS prompt, c_mktsegment AS tag, c_acctbal > 2000 AS listed FROM customer)
SELECT j.prompt, image, CASE WHEN version = 0 THEN NULL ELSE s1 END AS s1, CASE WHEN version = 0 THEN NULL ELSE s2 END AS s2, CASE WHEN listed THEN tag END AS tag, coalesce(CASE WHEN listed THEN tag END, '(missing)') AS shown FROM j LEFT JOIN m USING (prompt)""")
def iteration_pairs(spark, sf):
    """J-1, J-2, J-3, J-4, J-6, Z08, Z11: images of both passes, scores left out where the question lists differ, tags by prompt where known."""
    key = [F.col("o_custkey").alias("prompt"), (F.col("o_orderkey") % 5).alias("image")]
    o = table(spark, sf, "orders")
    a = o.where("o_orderkey % 2 = 0").groupBy(*key).agg(F.max("o_totalprice").alias("s1"))
    b = o.where("o_orderkey % 2 = 1").groupBy(*key).agg(F.max("o_totalprice").alias("s2"), (F.min("o_orderkey") % 3).alias("version"))
    m = table(spark, sf, "customer").select(F.col("c_custkey").alias("prompt"), F.when(F.col("c_acctbal") > 2000, F.col("c_mktsegment")).alias("tag"))
    d = a.join(b, ["prompt", "image"]).join(m, "prompt", "left")
    same = F.col("version") != 0
    return d.select("prompt", "image", F.when(same, F.col("s1")).alias("s1"), F.when(same, F.col("s2")).alias("s2"), "tag", F.coalesce("tag", F.lit("(missing)")).alias("shown"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 30000)
SELECT c_custkey, o_orderkey, NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_custkey = c_custkey) AS dropped FROM customer LEFT JOIN r ON r.o_custkey = c_custkey AND n = 1""")
def latest_records(spark, sf):
    """J-14, J-15, Z62: the newest compatible record of each key, and keys that the output dropped."""
    o = table(spark, sf, "orders")
    r = o.where("o_orderstatus = 'F' and o_totalprice > 30000").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    have = o.select("o_custkey").distinct().withColumn("_have", F.lit(True))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_custkey").alias("o_custkey"))
    return c.join(r, "o_custkey", "left").join(have, "o_custkey", "left").select("c_custkey", "o_orderkey", F.col("_have").isNull().alias("dropped"))


@query("WITH w AS (SELECT DISTINCT lang || '/' || source AS caption FROM documents WHERE doc_id % 3 = 0), n AS (SELECT lang || '/' || source AS caption, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n FROM documents) SELECT caption, doc_id AS image FROM n JOIN w USING (caption) WHERE n = 1")
def first_images(spark, sf):
    """J-17, Z09, Z44: the first image of each wanted caption."""
    d = table(spark, sf, "documents").select(F.concat_ws("/", "lang", "source").alias("caption"), "doc_id")
    return d.join(d.where("doc_id % 3 = 0").select("caption").distinct(), "caption", "left_semi").groupBy("caption").agg(F.min("doc_id").alias("image"))


@query("""WITH q AS (SELECT item_id, len(string_split(text, ' ')) AS n FROM benchmark), i AS (SELECT doc_id % (SELECT count(*) FROM benchmark) AS item_id, count(*) AS images FROM documents GROUP BY 1)
SELECT item_id, n AS questions, images, CASE WHEN n % 2 = 0 THEN 'sizes differ' END AS error FROM q JOIN i USING (item_id)""")
def benchmark_rows(spark, sf):
    """J-20, F26: benchmark prompts with their images and judge lists; lists of another length are marked."""
    b = table(spark, sf, "benchmark")
    q = b.select("item_id", F.size(F.split("text", " ")).cast("long").alias("questions"))
    many = b.agg(F.count("*").alias("c"))  # one row
    i = table(spark, sf, "documents").join(F.broadcast(many)).groupBy((F.col("doc_id") % F.col("c")).alias("item_id")).agg(F.count("*").alias("images"))
    return q.join(i, "item_id").withColumn("error", F.when(F.col("questions") % 2 == 0, "sizes differ"))


@query("WITH s AS (SELECT event_type, event_id, event_id % 4 AS shard, value FROM events) SELECT event_type, count(DISTINCT shard) AS shards, md5(string_agg(round(value, 2)::VARCHAR, ',' ORDER BY event_id)) AS merged FROM (SELECT event_type, event_id, shard, (value * 100)::BIGINT AS value FROM s) GROUP BY 1".replace("round(value, 2)::VARCHAR", "value::VARCHAR"))
def merged_shards(spark, sf):
    """Disjoint shards of ranks merged, lists flattened in index order."""
    cents = F.round(F.col("value") * 100).cast("long")
    parts = [table(spark, sf, "events").where(F.col("event_id") % 4 == k).select("event_type", "event_id", cents.alias("v"), F.lit(k).alias("shard")) for k in range(4)]
    d = parts[0]
    for p in parts[1:]:
        d = d.unionByName(p)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "v"))), lambda x: x["v"].cast("string"))
    return d.groupBy("event_type").agg(F.count_distinct("shard").alias("shards"), F.md5(F.array_join(listed, ",")).alias("merged"))


@query("""WITH f AS (SELECT doc_id, n_chars % 7 AS a, len(text) % 2 = 0 AS used, doc_id % 5 = 0 AS vetoed, doc_id % 3 = 0 AS chosen FROM documents) SELECT doc_id, CASE WHEN vetoed THEN 'vetoed' WHEN chosen AND a > 2 THEN 'used' WHEN chosen THEN 'skipped' ELSE 'not selected' END AS status,
CASE WHEN a IN (1, 2) THEN 'yes' WHEN a = 3 THEN 'no' ELSE 'unsure' END AS answer, NOT (a = 3 AND (doc_id % 4 <> 0 OR vetoed)) AS stays, a >= 2 AND a <= 5 AND chosen AS region_fits FROM f""")
def fact_statuses(spark, sf):
    """Statuses of facts, veto answers with unknown ones unsure, counts exempt from the veto, region claims."""
    a = F.col("n_chars") % 7
    vetoed, chosen = F.col("doc_id") % 5 == 0, F.col("doc_id") % 3 == 0
    status = F.when(vetoed, "vetoed").when(chosen & (a > 2), "used").when(chosen, "skipped").otherwise("not selected")
    answer = F.when(a.isin(1, 2), "yes").when(a == 3, "no").otherwise("unsure")
    count_fact = F.col("doc_id") % 4 == 0
    return table(spark, sf, "documents").select("doc_id", status.alias("status"), answer.alias("answer"), (~((answer == "no") & (~count_fact | vetoed))).alias("stays"), (a.between(2, 5) & chosen).alias("region_fits"))


@query("SELECT vec_id, 0.0 + round(coalesce(avg(x) FILTER (x > 0.25), 0) + 1e-9, 5) AS am, count(*) FILTER (x > 0.25) AS questions, count(*) FILTER (x > 0.25) = 0 AS to_score, bool_or(x < -0.3) AS failing FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1")
def banked_drafts(spark, sf):
    """Banked drafts with their mean anew (0 without questions), those still to score, and those that fail."""
    e = table(spark, sf, "embeddings").select("vec_id", F.explode("embedding").alias("x")).withColumn("x", F.col("x").cast("double"))
    high = F.when(F.col("x") > 0.25, F.col("x"))
    g = e.groupBy("vec_id").agg(F.avg(high).alias("m"), F.count(high).alias("questions"), F.bool_or(F.col("x") < -0.3).alias("failing"))
    return g.select("vec_id", F.round(F.coalesce("m", F.lit(0.0)) + 1e-9, 5).alias("am"), "questions", (F.col("questions") == 0).alias("to_score"), "failing")


@query("SELECT o_orderkey, o_orderkey % 250 = 0 OR o_orderkey = (SELECT max(o_orderkey) FROM orders) AS evaluates, greatest(256, 12 * max(1 + o_custkey % 40) OVER (PARTITION BY o_orderkey // 32)) AS budget FROM orders")
def evaluation_steps(spark, sf):
    """Steps that evaluate, the last one too, and the generation budget of each batch by its longest list."""
    o = table(spark, sf, "orders")
    last = o.agg(F.max("o_orderkey").alias("_last"))  # one row
    budget = F.greatest(F.lit(256).cast("long"), 12 * F.max(1 + F.col("o_custkey") % 40).over(Window.partitionBy(F.floor(F.col("o_orderkey") / 32))))
    return o.join(F.broadcast(last)).select("o_orderkey", ((F.col("o_orderkey") % 250 == 0) | (F.col("o_orderkey") == F.col("_last"))).alias("evaluates"), budget.alias("budget"))


@query("SELECT page_id, regexp_extract(url, '([^/?]+)(?:[?].*)?$', 1) AS name, coalesce(nullif(regexp_extract(url, 'utm_source=([a-z]+)', 1), ''), page_id::VARCHAR) AS id, to_base64(encode(url)) AS data FROM pages")
def page_names(spark, sf):
    """Names from paths, the first id that is there, and bytes as base64."""
    u = F.col("url")
    data = F.translate(F.base64(F.encode(u, "utf-8")), "\r\n", "")  # Spark may break base64 into lines of 76
    return table(spark, sf, "pages").select("page_id", F.regexp_extract(u, r"([^/?]+)(?:[?][^\n]*)?\z", 1).alias("name"), F.coalesce(F.nullif(F.regexp_extract(u, "utm_source=([a-z]+)", 1), F.lit("")), F.col("page_id").cast("string")).alias("id"), data.alias("data"))


@query("WITH c AS (SELECT user_id, event_id, value, event_type = 'click' AS good FROM events) SELECT user_id || '/' || (event_id % 3) AS grp, count(*) AS nodes, round(avg(value) + 1e-9, 6) AS mean, count(DISTINCT event_id % 4) FILTER (event_id % 4 > 1) AS repeats_left FROM c WHERE NOT good GROUP BY 1")
def noise_groups(spark, sf):
    """Groups of a noise study by prompt and parent, without children that look good, and repeats that are still to run."""
    d = table(spark, sf, "events").where("event_type <> 'click'").withColumn("r", F.col("event_id") % 4)
    key = F.concat(F.col("user_id").cast("string"), F.lit("/"), (F.col("event_id") % 3).cast("string"))
    return d.groupBy(key.alias("grp")).agg(F.count("*").alias("nodes"), r6(F.avg("value") + 1e-9).alias("mean"), F.count_distinct(F.when(F.col("r") > 1, F.col("r"))).alias("repeats_left"))


@query(f"SELECT doc_id, source FROM documents WHERE source IS NOT NULL AND lang = 'en' AND n_chars <= 1500 AND substr(text, 1, 1) <> {_q('x')}")
def kept_rows(spark, sf):
    """Rows of one source kind under a bound; too long ones are dropped in the scan's filter."""
    d = table(spark, sf, "documents").where("source is not null and lang = 'en' and n_chars <= 1500").where(F.substring("text", 1, 1) != "x")
    return d.select("doc_id", "source")
