"""Readers and sinks as round trips: tables are written out in a format and read back by the reader of that format, beside the SQL of the rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomery.operators.sampling import seed_key
from loomery.plans.queries import query, r6
from loomery.session import scratch, table
from loomery.sources import readers, sinks


def _lines(d, path: str) -> str:
    """d (one string column, and an order `o`) as text lines in order."""
    d.repartitionByRange(3, "o").sortWithinPartitions("o").select("value").write.text(path)
    return path


def _json(*columns):
    return F.to_json(F.struct(*columns))


@query("SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1 END AS entry FROM part")
def json_files(spark, sf):
    """A JSON list and JSON lines with blank ones, by a brace list."""
    at, d = scratch(spark, "json-files"), table(spark, sf, "part").select("p_partkey", "p_name")
    listed = d.where("p_partkey % 2 = 0").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("m"))
    listed.select(F.to_json("m").alias("value")).coalesce(1).write.text(f"{at}/base_a.json")
    _lines(d.where("p_partkey % 2 = 1").select(F.explode(F.array(_json("p_partkey", "p_name"), F.lit(""))).alias("value"), F.col("p_partkey").alias("o")), f"{at}/base_b.json")
    parts = [readers.records(spark, p).where("p_partkey is not null").select("p_partkey", "p_name", F.lit(i).alias("entry")) for i, p in enumerate(readers.braces(f"{at}/base_{{a,b}}.json"))]
    return parts[0].unionByName(parts[1])


@query("""WITH a AS (SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) AS i, row_number() OVER (ORDER BY p_partkey DESC) AS j, count(*) OVER () AS n, row_number() OVER (ORDER BY substr(sha256('5|' || p_partkey), 1, 16), p_partkey) AS h FROM part)
SELECT id, 0 AS entry FROM a WHERE i <= 7 UNION ALL SELECT id, 1 FROM a WHERE j <= 5 UNION ALL SELECT id, 2 FROM a WHERE h <= ceil(n * 10 / 100.0)""")
def manifest_samples(spark, sf):
    """Entries of a YAML manifest, each with its sampling strategy."""
    at = scratch(spark, "manifest")
    table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name").write.json(f"{at}/all.json")
    text = "datasets:\n" + "".join(f"  - json_path: {at}/all.json\n    sampling_strategy: {s}\n" for s in ("first:7", "end:5", "random:10%"))
    sinks.put(spark, f"{at}/mix.yaml", text)
    return readers.sampled_manifest(spark, f"{at}/mix.yaml", "id", 5).select("id", "entry")


@query("""WITH p AS (SELECT p_partkey AS id, p_name AS n FROM part), t AS (SELECT 'txt' AS kind, n AS prompt FROM p WHERE id % 9 > 0 UNION ALL SELECT 'jsonl', n FROM p UNION ALL SELECT 'loose', CASE WHEN id % 4 = 0 THEN n WHEN id % 4 = 1 THEN '{"other":"' || n || '"}' ELSE n END FROM p)
SELECT kind, prompt, count(*) AS n FROM t GROUP BY ALL""")
def prompt_files(spark, sf):
    """Prompts of text files with comments, of JSON lines, and of lines that may be either."""
    at, d, n, i = scratch(spark, "prompts"), table(spark, sf, "part"), F.col("p_name"), F.col("p_partkey")
    line = lambda c: d.select(c.alias("value"), i.alias("o"))
    _lines(line(F.when(i % 9 == 0, F.concat(F.lit("# "), n)).otherwise(n)), f"{at}/a.txt")
    _lines(line(_json(n.alias("prompt"))), f"{at}/b.jsonl")
    _lines(line(F.when(i % 4 == 0, _json(n.alias("prompt"))).when(i % 4 == 1, _json(n.alias("other"))).otherwise(n)), f"{at}/c.jsonl")
    parts = [readers.prompts(spark, f"{at}/{f}", strict=strict).select(F.lit(k).alias("kind"), "prompt") for f, k, strict in (("a.txt", "txt", True), ("b.jsonl", "jsonl", True), ("c.jsonl", "loose", False))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind", "prompt").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT 'own' AS s, 0 AS f, p_partkey AS id FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'b', 1, p_partkey FROM part WHERE p_partkey % 2 = 1 UNION ALL SELECT 'own', 2, p_partkey FROM part WHERE p_partkey % 5 = 0),
k AS (SELECT * FROM r WHERE id % 7 > 0) SELECT s AS "set", row_number() OVER (PARTITION BY s ORDER BY f, id) - 1 AS idx, 'p' || id AS prompt, 1 + id % 2 AS questions, CASE WHEN id % 3 = 0 THEN 'unknown' ELSE 'count' END AS skill FROM k""")
def prompt_sets(spark, sf):
    """Prompt sets that a manifest names; rows without questions go before the running number."""
    at, i = scratch(spark, "sets"), F.col("p_partkey")
    d = table(spark, sf, "part")
    n = F.when(i % 7 == 0, 0).otherwise(1 + i % 2).cast("int")
    pair = F.array(F.lit("q"), F.lit("yes"))
    line = _json(F.concat(F.lit(" p"), i.cast("string")).alias("prompt"), F.array_repeat(pair, n).alias("vqa_list"), F.when(i % 3 > 0, F.array_repeat(F.lit("count"), n)).alias("skills"))
    for name, keep in (("a", i % 2 == 0), ("b", i % 2 == 1), ("c", i % 5 == 0)):
        _lines(d.where(keep).select(line.alias("value"), i.alias("o")), f"{at}/{name}.jsonl")
    sinks.put(spark, f"{at}/sets.yaml", f"datasets:\n  - json_path: {at}/a.jsonl\n    logname: own\n  - json_path: {at}/b.jsonl\n  - json_path: [{at}/c.jsonl]\n    logname: own\n")
    out = readers.prompt_sets(spark, f"{at}/sets.yaml")
    return out.select("set", F.col("idx").cast("long").alias("idx"), "prompt", F.size("questions").cast("long").alias("questions"), F.get("skills", F.lit(0)).alias("skill"))


@query("SELECT n_name || '' AS folder, 'A ' || n_name AS prompt, n_name AS key FROM nation WHERE n_nationkey % 3 > 0 AND n_nationkey % 4 > 0")
def sample_folders(spark, sf):
    """Folders that hold an image and a prompt and are not done; prompts by file name up to its first dot."""
    at = scratch(spark, "folders")
    rows = table(spark, sf, "nation").select("n_nationkey", "n_name").collect()  # 25 rows
    for r in rows:
        sinks.put(spark, f"{at}/samples/{r.n_name}/prompt.txt", "x")
        sinks.put(spark, f"{at}/texts/{r.n_name}.en.txt", f"A {r.n_name}\n")
        if r.n_nationkey % 3:
            sinks.put(spark, f"{at}/samples/{r.n_name}/image.png", "png")
    done = table(spark, sf, "nation").where("n_nationkey % 4 = 0").select(F.col("n_name").alias("folder"))
    found = readers.sample_folders(spark, f"{at}/samples", done)
    texts = readers.named_texts(spark, f"{at}/texts/*.txt").select(F.col("key").alias("folder"), F.col("text").alias("prompt"), "key")
    return found.select(F.regexp_replace("folder", "%20", " ").alias("folder")).join(texts, "folder")


@query("SELECT 'k' || p_partkey AS key, p_name AS prompt FROM part WHERE p_partkey % 3 > 0")
def keyed_prompts(spark, sf):
    """A JSON object by key without what exists; a file that is not there has no rows."""
    at, d = scratch(spark, "keyed"), table(spark, sf, "part")
    key = F.concat(F.lit("k"), F.col("p_partkey").cast("string"))
    d.agg(F.map_from_entries(F.collect_list(F.struct(key, "p_name"))).alias("m")).select(F.to_json("m").alias("value")).coalesce(1).write.text(f"{at}/all.json")
    d.where("p_partkey % 3 = 0").select(key.alias("key")).write.json(f"{at}/done.jsonl")
    done = readers.at_least_empty(spark, f"{at}/done.jsonl", "key string").unionByName(readers.at_least_empty(spark, f"{at}/none.jsonl", "key string"))
    return readers.keyed_prompts(spark, f"{at}/all.json").join(done, "key", "left_anti")


@query("""WITH v AS (SELECT p_partkey AS id, p_partkey % 5 AS k FROM part) SELECT id, CASE WHEN k IN (0, 3) THEN 'b' || id END AS tag, CASE WHEN k IN (1, 4) AND id % 2 = 0 THEN 1 END AS questions, CASE k WHEN 4 THEN 1 ELSE 2 END AS slots, CASE WHEN k = 2 THEN 'not red' ELSE '' END AS reflection FROM v""")
def result_files(spark, sf):
    """Metadata, judgements, slot trees and reflections, each with its fall-back for missing or broken files."""
    i = F.col("id")
    k = i % 5
    d = table(spark, sf, "part").select(F.col("p_partkey").alias("id"))
    tag = F.to_json(F.create_map(F.lit("tag"), F.concat(F.lit("b"), i.cast("string"))))
    meta = F.when(k == 0, F.concat(F.lit("\n"), tag, F.lit("\n{bad"))).when(k == 3, tag).when(k == 1, "{broken").otherwise("")
    judged = F.when(i % 2 == 0, '{"questions": ["q"], "gts": ["yes"], "preds": ["no"]}').otherwise('{"questions": ["q"], "gts": ["yes"], "preds": []}')
    j = readers.judgement_of(F.when(k.isin(1, 4), judged).when(k == 2, "[]").otherwise("{"))
    tree = F.when(k == 4, F.lit(None)).when(k == 3, '{"iter1_slots": ["d0", "d1"], "iter2_slots": ["d0c0"]}').otherwise('{"slots": {"1": ["d0", "d1"], "2": ["d0c0"]}}')
    many = F.lit("Sample: 1\nSelf-reflect: red\nSample: 2\nSelf-reflect: not red \n\nSample: 22\nSelf-reflect: x\n")
    return d.select("id", F.element_at(readers.metadata_of(meta), "tag").alias("tag"), F.size(j["questions"]).alias("questions"), F.size(readers.slots_of(tree)["1"]).alias("slots"), F.when(k == 2, readers.reflection_of(many, F.lit("2"))).otherwise(readers.reflection_of(many, F.lit("3"))).alias("reflection"))


@query("SELECT split_part(url, '/', 4) AS prompt, page_id || '.png' AS image, page_id % 2 = 0 AS correct, page_id + 7 AS token_id, page_id::INT AS code FROM pages")
def path_results(spark, sf):
    """Results by prompt and image from their paths; image codes by token."""
    d = table(spark, sf, "pages").select("page_id", F.split_part("url", F.lit("/"), F.lit(4)).alias("p"))
    image = F.concat(F.col("page_id").cast("string"), F.lit(".png"))
    out = readers.result_paths(d.select(F.concat(F.lit("/r/1/"), "p", F.lit("/samples/"), image).alias("file"), (F.col("page_id") % 2 == 0).alias("correct")), "file", "correct")
    words = d.select(F.explode(F.array(F.concat(F.lit("<I"), F.col("page_id").cast("string"), F.lit(">")), F.lit("word"))).alias("token"), (F.col("page_id") + 7).alias("token_id"))
    return out.join(readers.image_codes(words, "token", "token_id"), F.regexp_extract("image", "[0-9]+", 0).cast("int") == F.col("code"))


@query("SELECT lang || '/' || source AS caption, 'n' || min(doc_id) AS counts, count(*) AS attempts, md5(string_agg((doc_id % 3)::VARCHAR, ',' ORDER BY doc_id)) AS reasons FROM documents WHERE source IS NOT NULL GROUP BY 1")
def rejection_log(spark, sf):
    """Rejected attempts by caption, in the order of the log."""
    at, i = scratch(spark, "rejections"), F.col("doc_id")
    caption = F.concat(F.lit("Caption: "), "lang", F.lit("/"), "source", F.lit("\nn"), i.cast("string"))
    d = table(spark, sf, "documents").where("source is not null")
    _lines(d.select(_json(caption.alias("caption"), F.lit(1).alias("attempt"), F.lit("{}").alias("reply"), (i % 3).cast("string").alias("reason")).alias("value"), i.alias("o")), f"{at}/log.jsonl")
    out = readers.rejections(spark, f"{at}/log.jsonl")
    return out.select("caption", "counts", F.size("attempts").cast("long").alias("attempts"), F.md5(F.array_join(F.transform("attempts", lambda a: a["reason"]), ",")).alias("reasons"))


@query("WITH c AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events WHERE event_id % 10 <> 3) SELECT user_id || '|' || event_type AS key, event_id AS last FROM c WHERE n = 1")
def jsonl_cache(spark, sf):
    """A cache in JSON lines with torn ones: the last whole record of a key, and keys by their lines' ends alone."""
    at, i = scratch(spark, "cache"), F.col("event_id")
    key = F.concat_ws("|", F.col("user_id").cast("string"), "event_type")
    line = F.concat(F.lit('{"key": "'), key, F.lit('", "last": '), i.cast("string"), F.lit(', "end": 1}'))
    torn = F.when(i % 10 == 3, F.substring(line, F.lit(1), F.length(line) - 5)).otherwise(line)
    _lines(table(spark, sf, "events").select(torn.alias("value"), i.alias("o")), f"{at}/r.jsonl")
    whole = readers.cache(spark, f"{at}/r.jsonl", "key string, last long, end int").select("key", "last")
    return whole.join(readers.done_keys(spark, f"{at}/r.jsonl"), "key", "left_semi")


@query("WITH p AS (SELECT o_orderkey, o_totalprice, o_orderkey // 5000 AS file, row_number() OVER (PARTITION BY o_orderkey // 5000 ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT o_orderkey, o_totalprice, i // 16 AS grp FROM p WHERE (i // 16) % 3 = 1 AND substr(sha256('2|' || o_orderkey), 1, 1) < '8'")
def striped_groups(spark, sf):
    """Shards found and probed, groups striped over ranks, wide columns read for chosen keys alone."""
    at = scratch(spark, "shards")
    d = table(spark, sf, "orders").withColumn("file", F.floor(F.col("o_orderkey") / 5000))
    d.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(f"{at}/a")
    sinks.put(spark, f"{at}/a/broken.parquet", "PAR1 but not to its end")
    keys = readers.striped(readers.parquet(spark, [f"{at}/a"], ["o_orderkey", "file"]), "file", "o_orderkey", 16, 1, 3)
    some = keys.where(F.substring(seed_key(2, F.col("o_orderkey")), 1, 1) < "8")
    out = readers.materialised(spark, [f"{at}/a"], ["o_orderkey"], lambda _: some)
    return out.select("o_orderkey", "o_totalprice", F.floor((F.col("o_orderkey") - F.col("file") * 5000) / 16).alias("grp"))


@query("SELECT p_brand AS \"set\", count(*) AS n, round(avg(p_size / 50.0::DOUBLE) + 1e-9, 6) AS mean_am, md5(string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey)) AS rows FROM part GROUP BY 1")
def bank_file(spark, sf):
    """A bank in JSON lines, sorted by set and idx, with its summary."""
    at = scratch(spark, "bank")
    d = table(spark, sf, "part").select(F.col("p_brand").alias("set"), F.col("p_partkey").alias("idx"), (F.col("p_size") / 50.0).alias("am"))
    summary = sinks.write_bank(d, f"{at}/bank.jsonl")
    back = readers.ordered_lines(spark, f"{at}/bank.jsonl").select(F.from_json("line", "set string, idx long").alias("r")).groupBy("r.set").agg(F.array_sort(F.collect_list("r.idx")).alias("m"))
    rows = F.md5(F.array_join(F.transform("m", lambda x: x.cast("string")), ",")).alias("rows")
    return summary.join(back.select("set", rows), "set").select("set", "n", r6(F.col("mean_am") + 1e-9).alias("mean_am"), "rows")


@query("WITH f AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), r AS (SELECT source, row_number() OVER (ORDER BY substr(sha256('4|' || source), 1, 16), source) AS i, count(*) OVER () AS n FROM f) SELECT source, CASE WHEN i <= greatest(1, round(n * 0.2)) THEN 'val' ELSE 'train' END AS part FROM r")
def file_split(spark, sf):
    """Whole files to train and val by a seeded order."""
    return sinks.split_files(table(spark, sf, "documents").where("source is not null"), "source", 0.2, 4)


@query("SELECT conv_id, turn, 'v2 ' || substr(text, 1, 20) AS conversations, substr(text, 1, 20) AS kept, ceil((SELECT count(*) FROM conversations) / 100.0)::INT AS shards FROM conversations")
def versioned_shards(spark, sf):
    """Rewritten shards that keep their source, also when written again; newest checkpoints and progress."""
    at = scratch(spark, "versions")
    d = table(spark, sf, "conversations").select("conv_id", "turn", F.substring("text", 1, 20).alias("conversations"))
    once = sinks.versioned(sinks.versioned(d, F.lower), lambda c: F.concat(F.lit("v2 "), c))
    sinks.write_shards(once, f"{at}/out", "conv_id", target=100, least=1)
    steps = [f"{at}/runs/checkpoint-{k}" for k in (2, 10, 30)]
    for s in steps:
        sinks.put(spark, f"{s}/{'state.json' if not s.endswith('30') else 'other'}", '{"rows": 1}')
    newest = readers.latest_checkpoint(spark, f"{at}/runs")
    if not newest.endswith("checkpoint-10") or sinks.keep_newest(spark, steps, 1) != steps[2:] or readers.latest_checkpoint(spark, f"{at}/runs") is not None:
        raise AssertionError(f"wrong checkpoint {newest}")
    shards = sinks.shard_count(d.count(), 100, 1)
    return spark.read.parquet(f"{at}/out").select("conv_id", "turn", "conversations", F.col("v1-conversations").alias("kept"), F.lit(shards).alias("shards"))


@query("SELECT label, count(*) AS prompts, round(avg(m) + 1e-9, 5) AS mean FROM (SELECT label, vec_id, avg(x) AS m FROM (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1")
def score_lists(spark, sf):
    """S24, S25, J-5: scores in benchmark order by their place, means over a prompt's images."""
    at = scratch(spark, "scores")
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    e.agg(F.array_sort(F.collect_list(F.struct("vec_id", "x"))).alias("m")).select(F.to_json(F.transform("m", lambda r: r["x"])).alias("value")).coalesce(1).write.text(f"{at}/scores.json")
    order = e.select("label", F.row_number().over(Window.orderBy("vec_id")).alias("place"))  # a benchmark's prompts, not a corpus
    s = readers.scores_by_place(spark, f"{at}/scores.json").select((F.col("place") + 1).alias("place"), (F.aggregate("scores", F.lit(0.0), lambda a, x: a + x) / F.size("scores")).alias("m"))
    return order.join(s, "place").groupBy("label").agg(F.count("*").alias("prompts"), F.round(F.avg("m") + 1e-9, 5).alias("mean"))
