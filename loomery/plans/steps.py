"""Conversation forms, checks of replies, logs, model calls and keys, each query beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.functions import lexicon
from loomery.operators import model, sampling, turns
from loomery.operators.relations import content_key
from loomery.plans.curation import _id, _pick, _q, _s_pick
from loomery.plans.queries import query, r6
from loomery.plans.storage import _lines
from loomery.session import scratch, table
from loomery.sources import readers
from loomery.streaming import streams


@query("""WITH p AS (SELECT p_partkey AS id, p_name AS n, p_brand AS b FROM part)
SELECT id, CASE WHEN id % 3 = 0 THEN n || b ELSE n END AS said, CASE WHEN id % 2 = 0 THEN 'i' || id ELSE '' END AS images, 'gpt:' || replace(n || '<image>', '<image>', '<im_start><image><im_end>') AS wrapped, CASE WHEN id % 4 > 0 THEN n ELSE b END AS first_variant,
CASE WHEN id % 2 = 0 THEN 128 + len(string_split(n, ' ')) ELSE -len(string_split(n, ' ')) END::INT AS length, coalesce(CASE WHEN id % 5 > 0 THEN 'r' || id END, id::VARCHAR) AS sample FROM p""")
def conversation_forms(spark, sf):
    """Multi-part messages flattened, JSON turns read, image marks wrapped, lengths signed by modality."""
    d = table(spark, sf, "part").withColumn("id", F.col("p_partkey"))
    part = lambda kind, text, image: F.struct(F.lit(kind).alias("type"), text.alias("text"), image.alias("image"))
    none, name = F.lit(None).cast("string"), F.concat(F.lit("i"), _id().cast("string"))
    content = F.array(part("text", F.col("p_name"), none), part("image", none, name), part("text", F.when(_id() % 3 == 0, F.col("p_brand")), none))
    content = F.when(_id() % 2 == 0, content).otherwise(F.array(content[0], content[2]))
    data = F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))
    spelled = F.to_json(F.array(F.struct(F.lit("gpt").alias("role"), F.concat("p_name", F.lit("<image>")).alias("content"))))
    wrapped = turns.wrap_images(turns.from_json_text(spelled))[0]
    names = readers.variants(["conversations_2", "conversations_1", "x"])
    picked = F.coalesce(*({"conversations_1": F.when(_id() % 4 > 0, F.col("p_name")), "conversations_2": F.col("p_brand")}[n] for n in names))
    return d.select(
        "id", turns.flatten_parts(data)[0]["value"].alias("said"), F.array_join(turns.images_of_parts(data), ",").alias("images"), F.concat_ws(":", wrapped["from"], wrapped["value"]).alias("wrapped"), picked.alias("first_variant"),
        turns.length_of(turns.two_turns(F.col("p_name"), F.lit("")), _id() % 2 == 0).alias("length"), F.coalesce(F.when(_id() % 5 > 0, F.concat(F.lit("r"), _id().cast("string"))), _id().cast("string")).alias("sample"),
    )


_REFLECTIONS = ["Self-reflect: bad\nCorrection: fix it", "Self-reflect: fine\nCorrection: Looks good.", "no marker", "Self-reflect: a\nCorrection: looks good\nSelf-reflect: b\nCorrection: fix", "Self-reflect: only"]
_ANSWERS = ["Yes\nno", "1. yes 2. NO 3. yes", "maybe", "yes yes"]
_STEPS_IN = ["1. add a cat", "  2) remove it ", "", "   ", "3.keep"]


@query(f"SELECT id, [true, false, false, false, false][(id % 5)::INT + 1] AS again, CASE WHEN len(a) = 2 THEN array_to_string(a, ',') END AS answers, CASE id % 5 WHEN 0 THEN 'add a cat' WHEN 1 THEN 'remove it' WHEN 4 THEN 'keep' ELSE '' END AS steps, name FROM (SELECT p_partkey AS id, list_transform(regexp_extract_all({_s_pick(_ANSWERS, 'p_partkey // 5')}, '(?i)\\b(yes|no)\\b', 1), lambda x: lower(x)) AS a, substr(regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9._-]+', '_', 'g'), 1, 12) AS name FROM part)")
def reply_checks(spark, sf):
    """Second passes asked for, yes and no in the right number, cleaned steps, safe file names."""
    d = table(spark, sf, "part").withColumn("id", F.col("p_partkey"))
    name = lexicon.safe_name(F.concat_ws("/", "p_name", "p_brand"), 12)
    return d.select("id", turns.asks_again(_pick(_REFLECTIONS, _id())).alias("again"), F.array_join(turns.answers(_pick(_ANSWERS, F.floor(_id() / 5)), F.lit(2)), ",").alias("answers"), F.array_join(turns.clean_steps(F.array(_pick(_STEPS_IN, _id()))), "|").alias("steps"), name.alias("name"))


_ERRORS = "'<error><type>' || lang || '</type><original>' || source || '</original><errored>' || coalesce(substr(text, 1, 5), '') || n_chars || '</errored></error>'"


@query(f"SELECT doc_id, regexp_extract(x, '<type>(.*?)</type>', 1) AS type, regexp_extract(x, '<original>(.*?)</original>', 1) AS original, regexp_extract(x, '(?s)<errored>(.*?)</errored>', 1) AS errored FROM (SELECT doc_id, unnest([{_ERRORS}, {_ERRORS}]) AS x FROM documents WHERE source IS NOT NULL)")
def error_tags(spark, sf):
    """Errors of a marked reply with their type, the original and the errored wording."""
    one = F.concat(F.lit("<error><type>"), "lang", F.lit("</type><original>"), "source", F.lit("</original><errored>"), F.coalesce(F.substring("text", 1, 5), F.lit("")), F.col("n_chars").cast("string"), F.lit("</errored></error>"))
    d = table(spark, sf, "documents").where("source is not null").select("doc_id", F.concat(one, one).alias("t"))
    take = lambda tag: F.regexp_extract_all("t", F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)).alias(tag)
    return d.select("doc_id", F.explode(F.arrays_zip(take("type"), take("original"), take("errored"))).alias("x")).select("doc_id", "x.type", "x.original", "x.errored")


@query("WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), i AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS iteration FROM (SELECT DISTINCT user_id FROM events)) SELECT i.iteration::INT AS iteration, m AS metric, i.iteration * k + 0.5::DOUBLE AS value FROM i, (VALUES ('basic', 1), ('advanced', 2), ('overall', 3)) v(m, k)")
def log_values(spark, sf):
    """Values of an evaluation log, two lines below the overall group, under the iteration before."""
    at = scratch(spark, "logs")
    n = table(spark, sf, "events").select("user_id").distinct().count()  # the null user is one too
    i = F.col("id")
    values = F.concat_ws(" ", *(F.concat((k * i).cast("string"), F.lit(".5")) for k in (1, 2, 3)))  # a double from 10**7 on would be spelled with an exponent
    run = F.concat(F.lit("ITER-"), i.cast("string"), F.lit(": run"))
    lines = F.concat_ws("\n", run, F.lit("noise 1.0\nTag Group: other\nx\n9.0 9.0\nTag Group: overall\nbasic advanced overall"), values)
    _lines(spark.range(1, n + 1).select(lines.alias("value"), i.alias("o")), f"{at}/eval.log")  # an iteration is one row, so that no file ends inside it
    return readers.iteration_log(spark, f"{at}/eval.log", ["basic", "advanced", "overall"]).select("iteration", "metric", "value")


@query("SELECT (s_suppkey % 3)::INT AS iteration, CASE WHEN s_suppkey % 2 = 0 THEN 'count' ELSE 'color' END AS section, s_suppkey + 0.25::DOUBLE AS short, s_suppkey + 0.75::DOUBLE AS long FROM supplier WHERE s_suppkey % 5 > 0")
def section_rows(spark, sf):
    """Rows of a sectioned summary; unknown sections are left out."""
    at, k = scratch(spark, "sections"), F.col("s_suppkey")
    title = F.when(k % 5 == 0, "Other").when(k % 2 == 0, "Counting").otherwise("Colors")
    row = F.concat(F.lit("model_iter"), (k % 3).cast("string"), F.lit("  "), (k + 0.25).cast("string"), F.lit(" "), (k + 0.75).cast("string"))
    d = table(spark, sf, "supplier").select(F.explode(F.array(F.concat(F.lit("==== "), title, F.lit(" ====")), F.lit("model short long"), row, F.lit(""))).alias("value"), k.alias("o"))
    _lines(d, f"{at}/summary.txt")
    return readers.sections(spark, f"{at}/summary.txt", {"Counting": "count", "Colors": "color"}).select("iteration", "section", "short", "long")


def _stage(spark):
    def stage(d: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, name)
        d.write.parquet(path)
        return spark.read.schema(d.schema).parquet(path)

    return stage


@query("SELECT 'k' || p_size AS key, CASE WHEN p_size % 3 = 0 THEN 'failed' ELSE 'ok' END AS status, 'answer ' || p_size AS reply, CASE WHEN p_size % 3 = 0 THEN 'third' END AS reason, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END AS attempts FROM part GROUP BY p_size")
def model_replies(spark, sf):
    """Equal jobs asked once, replies checked, bad ones asked again with the reason, the last state kept."""
    n = F.col("p_size")
    jobs = table(spark, sf, "part").select(F.concat(F.lit("k"), n.cast("string")).alias("key"), F.concat(F.lit("q\nanswer "), n.cast("string")).alias("prompt"))
    number = lambda reply: F.regexp_extract(reply, "([0-9]+)$", 1).cast("int")
    return model.validated(jobs, model.EchoClient, model.first_reason(("third", lambda r: number(r) % 3 == 0)), _stage(spark), tries=2)


@query("SELECT p_size::VARCHAR AS key, CASE WHEN p_size % 4 = 0 THEN 1 WHEN p_size % 2 = 0 THEN 2 ELSE 3 END AS stage, CASE WHEN p_size % 4 = 0 THEN 'a' WHEN p_size % 2 = 0 THEN 'b' ELSE 'c' END || p_size AS reply, CASE WHEN p_size % 2 = 0 OR p_size % 5 = 0 THEN 'ok' ELSE 'failed' END AS status FROM part GROUP BY p_size")
def judged_by_stages(spark, sf):
    """A judge whose templates escalate, the last one a single question."""
    jobs = table(spark, sf, "part").select(F.col("p_size").cast("string").alias("key"), F.col("p_size").cast("string").alias("question")).distinct()
    n = lambda r: F.regexp_extract(r, "([0-9]+)$", 1).cast("int")
    fine = lambda r: (r.startswith("a") & (n(r) % 4 == 0)) | (r.startswith("b") & (n(r) % 2 == 0)) | (r.startswith("c") & (n(r) % 5 == 0))
    return model.escalated(jobs, model.EchoClient, ["all\na{}", "again\nb{}", "c{}"], lambda r: F.when(~fine(r), "bad"), _stage(spark))


class _Halves:
    """A scorer for tests: half of each number."""

    def __call__(self, items: list) -> list[float]:
        return [x / 2 for x in items]


@query("SELECT p_partkey, round(p_size * 0.75 + 1e-9, 6) AS mean, CASE WHEN p_partkey % 3 > 0 THEN 'a' || p_partkey END AS parsed FROM part")
def scored_items(spark, sf):
    """A scorer behind one interface, a transform by name, a metric as an argument, replies dropped at the first failure."""
    d = table(spark, sf, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), (2 * F.col("p_size")).cast("double")).alias("items"))
    if "mean" not in model.TRANSFORMS:
        model.transform("mean")(lambda x: x.select("p_partkey", (F.aggregate("scores", F.lit(0.0), lambda a, b: a + b) / F.size("scores")).alias("mean")))
    mean = model.named("mean")(model.scored(d, "p_partkey", "items", _Halves))
    jobs = d.select(F.col("p_partkey").cast("string").alias("key"), F.concat(F.lit("q\na"), F.col("p_partkey").cast("string")).alias("prompt"))
    kept = model.dropped_if_bad(jobs, model.EchoClient, lambda r: F.when(F.substr(r, F.lit(2)).cast("int") % 3 > 0, r))
    return mean.join(kept.select(F.col("key").cast("long").alias("p_partkey"), "parsed"), "p_partkey", "left").select("p_partkey", r6(F.col("mean") + 1e-9).alias("mean"), "parsed")


@query("SELECT p_partkey, sha1('[\"v1\",' || to_json(p_name) || ',' || to_json(p_brand) || ']') AS key, (11 + ('0x' || substr(sha1(p_name), 1, 8))::BIGINT + p_partkey % 4) % 2147483648 AS seed, sha256('v1|prompt|0.5') AS version FROM part")
def content_keys(spark, sf):
    """Content keys under a version, generation seeds, and the hash that makes a cache void."""
    version = F.sha2(F.concat_ws("|", F.lit("v1"), F.lit("prompt"), F.lit("0.5")), 256)
    return table(spark, sf, "part").select("p_partkey", content_key("v1", "p_name", "p_brand").alias("key"), sampling.derived_seed(11, F.col("p_name"), F.col("p_partkey") % 4).alias("seed"), version.alias("version"))


@query("SELECT event_type AS kind, count(*) * 2 AS rows, count(DISTINCT event_id) AS distinct_rows FROM events GROUP BY 1")
def replayed_epochs(spark, sf):
    """A stream appended once, then replayed for a bounded number of epochs."""
    at = scratch(spark, "stream")
    e = table(spark, sf, "events").select("event_id", "event_type")
    e.write.parquet(f"{at}/in")
    streams.appended(spark.readStream.schema(e.schema).parquet(f"{at}/in"), f"{at}/out", f"{at}/state").awaitTermination()
    d = streams.epochs(spark.read.parquet(f"{at}/out"), 2)
    return d.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("rows"), F.count_distinct("event_id").alias("distinct_rows"))


@query(f"SELECT p_partkey AS id, {_q('k')} || p_partkey AS key, p_name AS caption, CASE WHEN p_size % 2 = 0 THEN p_type END AS critique, p_size % 2 = 0 AND p_partkey % 3 > 0 AS rewrite FROM part WHERE p_name <> ''")
def job_rows(spark, sf):
    """The projection of rows to jobs, with flags for what is asked."""
    p = table(spark, sf, "part").where("p_name <> ''")
    has = F.col("p_size") % 2 == 0
    return p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("caption"), F.when(has, F.col("p_type")).alias("critique"), (has & (F.col("p_partkey") % 3 > 0)).alias("rewrite"))
