r"""Personal data: base patterns, and bootstrapped contextual extraction beyond them, in DataFrame functions only.

Base spans come from four fixed patterns; a match that fails its test is dropped and not tried again. They and long
hexadecimal keys (kind `secret`) are the seeds of the bootstrap; its instances are words that hold a digit or a mail sign.
An instance has three lexical patterns: the word before it and the sign that opens it, with its make; the two words before it and the opening sign; and
the word before and the word after, with its make. Makes are coarse (with a mail sign, so many digits, digits and
such signs, hexadecimal, letters and digits, other). In each round a pattern's trust is the mean score of its distinct instances, smoothed
towards 0, and an instance's score the noisy-or of its patterns; seeds stay at 1. Numbers that a base
rule has turned down (a card number that fails its check digit, an address with a part over 255) stay at 0, count
against the patterns that they stand in, and are never extracted. Patterns whose trust reaches `trust` after the last
round, from at least `support` distinct seeds, extract the other instances of theirs, under the kind that most of their
seeds have; of several the most trusted one names the kind.

Texts are scanned once, and only spans and instances with the words beside them are written out. Distinct (pattern, instance)
rows are counted with map-side combining, so that a hot pattern or instance is one row a task; the table of patterns
with seeds is broadcast up to a checked size and joined by shuffle beyond.

Possessive and anchored forms of the patterns match the same places as the plain ones, but in linear time and without
recursion, so that very long texts are safe. Positions are code points.

Defined results: null text is empty; no spans give the hash of the empty string and an empty list; rows that repeat
are rows of their own; ids may be null; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.common import sized, staged, table

LOCAL = r"[A-Za-z0-9._%+-]"
#: kind, pattern; in this order spans of one start are listed. Spans of the last kind come from the bootstrap alone.
KINDS = ("email", "ip", "card", "phone", "secret")
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRET = len(PATTERNS)
#: Word characters; plain classes are many times faster than the negated ones that they equal.
WORD = r"[\x00-\x08\x0E-\x1F\x21-\x{10FFFF}]"
DULL = r"[\x00-\x08\x0E-\x1F\x21-\x2F\x3A-\x3F\x41-\x{10FFFF}]"
#: A word with a digit or a mail sign in it.
CANDIDATE = rf"(?<!{WORD})(?={DULL}*+[0-9@]){WORD}++"
#: What a base rule turns down if it is no base span: numbers of addresses, cards and phones.
NUMBERS = r"^(?:[0-9]+(?:\.[0-9]+){3,}|[0-9](?:[\x20-]?[0-9]){11,}|\+[0-9][\x20().0-9-]+[0-9])$"
HEX_KEY = r"^(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,}$"
#: Characters kept on each side of a match, of which the two words before and the one after are taken.
BESIDE = 64
ROUNDS, TRUST, SUPPORT, SHRINK = 3, 0.7, 5, 2.0
FOUND = "array<struct<at:int,len:int,s:string,left:string,right:string>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _holds(kind: str, s: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(s, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return _luhn(_digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    return F.lit(True)


def matches(text: Column, pattern: str) -> Column:
    """All matches as array<struct<at, len, s, left, right>>, at from 0 in code points: pieces between matches give the places.

    left and right are up to BESIDE characters beside the match; left reaches into the match before, if that is near.
    """
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    before = F.concat(F.array(F.lit("")), found)
    after = F.concat(F.slice(between, 2, F.size(between)), F.array(F.lit("")))
    following = F.concat(F.slice(found, 2, F.greatest(F.size(found), F.lit(1))), F.array(F.lit("")))
    steps = F.arrays_zip(between.alias("b"), found.alias("s"), before.alias("p"), after.alias("a"), following.alias("f"))
    zero = F.struct(F.lit(0).alias("end"), F.array().cast(FOUND).alias("out"))
    last, next_ = (lambda s: F.right(s, F.lit(BESIDE))), (lambda s: F.left(s, F.lit(BESIDE)))

    def step(acc: Column, x: Column) -> Column:
        at, n = acc["end"] + F.length(x["b"]), F.length(x["s"])
        left = last(F.concat(last(x["p"]), last(x["b"])))
        right = next_(F.concat(next_(x["a"]), next_(F.coalesce(x["f"], F.lit("")))))
        one = F.array(F.struct(at.alias("at"), n.alias("len"), x["s"].alias("s"), left.alias("left"), right.alias("right")))
        return F.struct((at + F.coalesce(n, F.lit(0))).alias("end"), F.when(n.isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    return F.when(F.regexp_like(text, F.lit(pattern)), F.aggregate(steps, zero, step)["out"]).otherwise(zero["out"])


def _valid(found: Column, no: int, kind: str) -> Column:
    held = F.filter(found, lambda m: _holds(kind, m["s"]))
    return F.transform(held, lambda m: F.struct(m["at"].alias("start"), F.lit(no).alias("kind_no"), (m["at"] + m["len"]).alias("end"), m["s"].alias("s"), m["left"].alias("left"), m["right"].alias("right")))


def _of_kind(spans: Column, no: int) -> Column:
    return F.filter(spans, lambda b: b["kind_no"] == no)


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> row (a number of its own), doc_id, base: spans (start, kind_no, end, s, left, right) in order, words: matches of CANDIDATE."""
    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = [_valid(matches(F.col("text"), pattern), no, kind) for no, (kind, pattern) in enumerate(PATTERNS.items())]
    return d.select("row", "doc_id", F.array_sort(F.concat(*parts)).alias("base"), matches(F.col("text"), CANDIDATE).alias("words"))


def _make(s: Column) -> Column:
    """The make of an instance: numbers by their length or their signs, words by what they hold."""
    made = F.when(s.contains("@"), "mail").when(s.rlike("^[0-9]+$"), F.concat(F.lit("digits "), F.length(s).cast("string")))
    made = made.when(s.rlike(r"^[\x20()+.:/0-9-]+$"), F.regexp_replace(s, "[0-9]+", "0"))
    return made.when(s.rlike("^[0-9a-f]+$"), "hex").when(s.rlike("^[0-9A-Za-z]+$"), "plain").otherwise("other")


def instances(scanned: DataFrame) -> DataFrame:
    """row, start, end, instance, kind_no (seeds), barred, patterns: base spans, and candidate words that touch none of them."""
    base = scanned.select("row", F.explode("base").alias("m")).select("row", "m.start", "m.end", F.col("m.s").alias("instance"), "m.kind_no", F.lit("").alias("open"), "m.left", "m.right")
    word = F.col("m.s")
    lead = F.regexp_extract(word, r"^([^A-Za-z0-9+(]*+)", 1)
    core = F.regexp_replace(F.substr(word, F.length(lead) + 1), r"(?<=[A-Za-z0-9)])[^A-Za-z0-9)]++$", "")
    more = scanned.select("row", "base", F.explode("words").alias("m")).select("row", "base", (F.col("m.at") + F.length(lead)).alias("start"), core.alias("instance"), F.right(lead, F.lit(1)).alias("open"), "m.left", "m.right")
    more = more.withColumn("end", F.col("start") + F.length("instance")).where(~F.exists("base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start"))))
    more = more.where("instance rlike '[0-9@]'").withColumn("kind_no", F.when(F.col("instance").rlike(HEX_KEY), SECRET))
    every = base.unionByName(more.drop("base"))
    before = F.regexp_extract_all(F.lower("left"), F.lit(rf"{WORD}++"), F.lit(0))
    word_at = lambda i: F.regexp_replace(F.coalesce(F.get(before, F.size(before) - i), F.lit("^")), "[0-9]+", "0")
    after = F.regexp_replace(F.regexp_extract(F.lower("right"), rf"({WORD}++)", 1), "[0-9]+", "0")
    make = _make(F.col("instance"))
    patterns = F.array(
        F.concat_ws("\t", F.lit("1"), word_at(1), "open", make),
        F.concat_ws("\t", F.lit("2"), word_at(2), word_at(1), "open"),
        F.concat_ws("\t", F.lit("3"), word_at(1), after, make),
    )
    return every.select("row", "start", "end", "instance", "kind_no", (F.col("kind_no").isNull() & F.col("instance").rlike(NUMBERS)).alias("barred"), patterns.alias("patterns"))


def trusted(found: DataFrame, rounds: int = ROUNDS, trust: float = TRUST, support: int = SUPPORT, shrink: float = SHRINK) -> DataFrame:
    """The pattern-instance graph scored in rounds: (pattern, kind_no, trust) of patterns that may extract."""
    edges = found.select(F.explode("patterns").alias("pattern"), "instance", "kind_no", "barred").groupBy("pattern", "instance").agg(F.max("kind_no").alias("kind_no"), F.max("barred").alias("barred"))
    seeded = edges.groupBy("pattern").agg(F.count("kind_no").alias("_seeds")).where(F.col("_seeds") >= support)
    # only patterns with enough seeds can ever extract; the others leave the graph
    edges = staged(edges.join(sized(staged(seeded, "pii-seeded")).select("pattern"), "pattern"), "pii-edges")
    own = F.when(F.col("kind_no").isNotNull(), 1.0).when(F.col("barred"), 0.0)
    scored = edges.withColumn("score", F.coalesce(own, F.lit(0.0)))
    for _ in range(rounds - 1):
        noisy = scored.join(sized(staged(_trust(scored, shrink), "pii-trust")).select("pattern", "trust"), "pattern")
        noisy = noisy.groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.least("trust", F.lit(0.999)))))).alias("_s"))
        scored = staged(edges.join(noisy, "instance").withColumn("score", F.coalesce(own, "_s")).drop("_s"), "pii-scores")
    return _trust(scored, shrink).where(F.col("trust") >= trust).select("pattern", "kind_no", "trust")


def _trust(scored: DataFrame, shrink: float) -> DataFrame:
    kinds = [F.count(F.when(F.col("kind_no") == no, 1)).alias(f"_{no}") for no in range(len(KINDS))]
    out = scored.groupBy("pattern").agg((F.sum("score") / (F.count("*") + shrink)).alias("trust"), *kinds)
    most = F.array(*(F.col(f"_{no}") for no in range(len(KINDS))))
    return out.select("pattern", (F.array_position(most, F.array_max(most)) - 1).cast("int").alias("kind_no"), "trust")


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, **options) -> DataFrame:
    """doc_id, base and all spans as arrays of (start, kind_no, end, s), ordered by start, then kind."""
    scanned = staged(scan(docs.select("doc_id", "text")), "pii-scan")
    found = staged(instances(scanned), "pii-instances")
    known = sized(staged(trusted(found, **options), "pii-trusted"))
    # base spans are there already; secret seeds are extracted like any other instance
    extra = found.where(F.coalesce(F.col("kind_no") == SECRET, ~F.col("barred"))).select("row", "start", "end", "instance", F.explode("patterns").alias("pattern"))
    best = F.max(F.struct("trust", (-F.col("kind_no")).alias("k"))).alias("_best")
    extra = extra.join(known, "pattern").groupBy("row", "start", "end", "instance").agg(best)
    extra = extra.groupBy("row").agg(F.collect_list(F.struct("start", (-F.col("_best.k")).alias("kind_no"), "end", F.col("instance").alias("s"))).alias("more"))
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["kind_no"].alias("kind_no"), b["end"].alias("end"), b["s"].alias("s")))
    out = scanned.select("row", "doc_id", base.alias("base")).join(extra, "row", "left")
    return out.select("doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    counts = [F.size(_of_kind(F.col("base"), no)).cast("long").alias(f"n_{k}") for no, k in enumerate(PATTERNS)]
    secret = F.size(_of_kind(F.col("spans"), SECRET)).cast("long").alias("n_secret")
    every = F.size("spans").cast("long").alias("n_spans")
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), secret, every)
