"""Conversations, token streams and templates recast as columns: variants, captions, masks, padding, messages and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens and wordings of the data.
IMAGE = "<image>"
EDIT_PROMPT, REFINE_PROMPT = "<image>\nEdit the image: ", "Generate and refine the image."
RETRY = "That answer was rejected: {} Answer again with the full JSON object."


def variant(columns: list[Column], pick: Column | None = None) -> Column:
    """One of the variants that are there, the first without `pick`, else the one of that number modulo how many there are."""
    there = F.filter(F.array(*columns), lambda c: c.isNotNull())
    place = F.lit(0) if pick is None else F.pmod(pick, F.greatest(F.size(there), F.lit(1))).cast("int")
    return F.get(there, place)


def short_or_long(long: Column, short: Column, u: Column, share: float = 0.5) -> Column:
    return F.when(short.isNotNull() & (u < share), short).otherwise(long)


def caption_place(turns: Column) -> Column:
    """Place of the first human turn if it is a plain caption: no image, no instruction, not blank; else null."""
    first = F.array_position(F.transform(turns, lambda t: t["from"] == "human"), True).cast("int")
    value = F.get(turns, first - 1)["value"]
    return F.when((first > 0) & ~value.contains(IMAGE) & ~value.contains("orrection") & (F.trim(value) != ""), first - 1)


def replace_caption(turns: Column, caption: Column) -> Column:
    first = F.array_position(F.transform(turns, lambda t: t["from"] == "human"), True).cast("int") - 1
    return F.transform(turns, lambda t, i: F.when(i == first, t.withField("value", caption)).otherwise(t))


def replace_answers(turns: Column, text: Column) -> Column:
    return F.transform(turns, lambda t: F.when(t["from"] == "gpt", t.withField("value", text)).otherwise(t))


def turn(role: str, value: Column | str) -> Column:
    return F.struct(F.lit(role).alias("from"), (F.lit(value) if isinstance(value, str) else value).alias("value"))


def edit_pair(correction: Column) -> Column:
    return F.array(turn("human", F.concat(F.lit(EDIT_PROMPT), correction)), turn("gpt", IMAGE))


def refine_triple(correction: Column) -> Column:
    return F.array(turn("human", REFINE_PROMPT), turn("gpt", F.concat(F.lit("<image>\nCorrection: "), correction, F.lit("\n<image>"))))


def edit_reject(images: Column, correction: Column) -> Column:
    """Why a row cannot be recast: images, no_instruction, no_edit; else null."""
    return F.when(F.coalesce(images, F.lit(0)) != 2, "images").when(F.coalesce(correction, F.lit("")) == "", "no_instruction").when(correction.rlike(r"(?i)looks\s+good|no\s+issues"), "no_edit")


def image_spans(tokens: Column, labelled: Column, image: int, start: int, end: int) -> Column:
    """Spans (a, z exclusive) of the images whose label counts, with their start and end marks."""
    at = F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: (F.get(tokens, i) == image) & F.get(labelled, i))
    one = lambda i: F.struct(F.when(F.coalesce(F.get(tokens, i - 1) == start, F.lit(False)), i - 1).otherwise(i).alias("a"), F.when(F.coalesce(F.get(tokens, i + 1) == end, F.lit(False)), i + 2).otherwise(i + 1).alias("z"))
    return F.transform(at, one)


def mask_first(labelled: Column, spans: Column) -> Column:
    s = F.get(spans, F.lit(0))
    return F.transform(labelled, lambda x, i: x & ~F.coalesce((i >= s["a"]) & (i < s["z"]), F.lit(False)))


def mask_all(labelled: Column, spans: Column) -> Column:
    return F.transform(labelled, lambda x, i: x & ~F.exists(spans, lambda s: (i >= s["a"]) & (i < s["z"])))


def mask_to_last(labelled: Column, spans: Column) -> Column:
    """Nothing before the last image counts; null with fewer than two images."""
    last = F.get(spans, F.size(spans) - 1)["a"]
    return F.when(F.size(spans) >= 2, F.transform(labelled, lambda x, i: x & (i >= last)))


def drop_last(tokens: Column, token: int) -> Column:
    """tokens without the last occurrence of one."""
    back = F.array_position(F.reverse(tokens), F.lit(token).cast("int")).cast("int")
    keep = F.size(tokens) - back
    return F.when(back > 0, F.concat(F.slice(tokens, 1, keep), F.slice(tokens, keep + 2, F.greatest(back, F.lit(1))))).otherwise(tokens)


def runs(tokens: Column, is_code) -> Column:
    """Maximal runs of codes as (a, z exclusive)."""
    n = F.size(tokens)
    code = lambda i: F.coalesce(is_code(F.get(tokens, i)), F.lit(False))
    a = F.filter(F.sequence(F.lit(0), n - 1), lambda i: code(i) & ~code(i - 1))
    z = F.filter(F.sequence(F.lit(0), n - 1), lambda i: code(i) & ~code(i + 1))
    return F.zip_with(a, z, lambda x, y: F.struct(x.alias("a"), (y + 1).alias("z")))


def fitted(items: Column, size: int, fill: int = 0, left: bool = False) -> Column:
    """items cut or padded to a length."""
    pad = F.array_repeat(F.lit(fill), F.greatest(F.lit(size) - F.size(items), F.lit(0)))
    return F.slice(F.concat(pad, items) if left else F.concat(items, pad), 1, size)


def template(system: Column, messages: Column, style: str, sep: str, sep2: str = "") -> Column:
    """A conversation (array of struct from, value) as one text: styles single, two, chatml and plain; an empty message leaves its role open."""
    blank = lambda m: F.coalesce(m["value"], F.lit("")) == ""
    ends = lambda i: F.when(i % 2 == 0, sep).otherwise(sep2) if style in ("two", "plain") else F.lit(sep)
    if style == "chatml":
        head = F.when(system == "", "").otherwise(F.concat(system, F.lit(sep + "\n")))
        body = F.transform(messages, lambda m: F.when(blank(m), F.concat(m["from"], F.lit("\n"))).otherwise(F.concat(m["from"], F.lit("\n"), m["value"], F.lit(sep + "\n"))))
    elif style == "plain":
        head, body = system, F.transform(messages, lambda m, i: F.when(blank(m), "").otherwise(F.concat(m["value"], ends(i))))
    elif style in ("single", "two"):
        head = F.concat(system, F.lit(sep))
        body = F.transform(messages, lambda m, i: F.when(blank(m), F.concat(m["from"], F.lit(":"))).otherwise(F.concat(m["from"], F.lit(": "), m["value"], ends(i))))
    else:
        raise ValueError(f"unknown style {style}")
    return F.concat(head, F.array_join(body, ""))


def retry_messages(messages: Column, answer: Column, reason: Column) -> Column:
    """A conversation (array of struct from, value) with the turned down answer and why."""
    before, after = RETRY.split("{}")
    return F.concat(messages, F.array(turn("assistant", answer), turn("user", F.concat(F.lit(before), reason, F.lit(after)))))


def tag_text(text: Column, tag: str) -> Column:
    """The text of a tag with white space collapsed; null if it is missing or empty."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1), r"\s+", " ")), F.lit(""))


def reply_text(text: Column) -> Column:
    """A reply without its thinking block and code fences; null if a thinking block does not end."""
    rest = F.when(text.contains("</think>"), F.substring_index(text, "</think>", -1)).when(~text.contains("<think>"), text)
    return F.regexp_replace(rest, r"^\s*```[a-z]*\s*|\s*```\s*$|^\s+|\s+$", "")


def first_yes_no(text: Column) -> Column:
    """The first line of a completion that begins with yes or no; null without one."""
    return F.nullif(F.lower(F.regexp_extract(text, r"(?im)^\s*(yes|no)\b", 1)), F.lit(""))


def collapse_codes(text: Column, head: int = 2, tail: int = 3) -> Column:
    """Runs of more than head + tail image tokens with their middle named."""
    one = r"<I\d+>"
    run = rf"(?:{one}){{{head + tail + 1},}}"
    between, found = F.split(text, run, -1), F.regexp_extract_all(text, F.lit(run), F.lit(0))

    def short(run_text: Column) -> Column:
        t = F.regexp_extract_all(run_text, F.lit(one), F.lit(0))
        return F.concat(F.array_join(F.slice(t, 1, head), ""), F.lit("<... "), (F.size(t) - head - tail).cast("string"), F.lit(" image tokens omitted ...>"), F.array_join(F.slice(t, -tail, tail), ""))

    return F.array_join(F.zip_with(between, F.transform(found, short), lambda b, s: F.concat(b, F.coalesce(s, F.lit("")))), "")


def between_images(text: Column) -> Column:
    """The chunks of a prompt around its image marks, in order."""
    return F.split(text, IMAGE, -1)
