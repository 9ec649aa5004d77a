"""Conversations as arrays of (from, value) structs: rewriting, parsing, masking and filters, without Python functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TURNS = "array<struct<from:string,value:string>>"
#: Names that mean the assistant and the human side.
ASSISTANT, HUMAN = ("gpt", "assistant"), ("human", "user")
#: Fixed value: words that an image counts for.
IMAGE_WORDS = 128


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def side(turn: Column, names: tuple[str, ...]) -> Column:
    return turn["from"].isin(*names)


def turn(who: str | Column, value: Column) -> Column:
    return F.struct((F.lit(who) if isinstance(who, str) else who).alias("from"), value.alias("value"))


def from_json_text(text: Column) -> Column:
    """A JSON list of turns in either spelling of its keys."""
    raw = F.from_json(text, "array<struct<`from`:string,value:string,role:string,content:string>>")
    return F.transform(raw, lambda t: turn(F.coalesce(t["from"], t["role"]), F.coalesce(t["value"], t["content"])))


def flatten_parts(data: Column) -> Column:
    """Multi-part messages to turns: text parts concatenated."""
    said = lambda m: F.array_join(F.transform(F.filter(m["content"], lambda c: c["type"] == "text"), lambda c: F.coalesce(c["text"], F.lit(""))), "")
    return F.transform(data, lambda m: turn(m["role"], said(m)))


def images_of_parts(data: Column) -> Column:
    return F.flatten(F.transform(data, lambda m: F.transform(F.filter(m["content"], lambda c: c["type"] == "image"), lambda c: c["image"])))


def first_place(conv: Column, names: tuple[str, ...]) -> Column:
    """Place from 0 of the first turn of a side; null if none."""
    at = F.array_position(F.transform(conv, lambda t: side(t, names)), F.lit(True))
    return F.when(at > 0, at - 1)


def last_place(conv: Column, names: tuple[str, ...]) -> Column:
    back = F.array_position(F.reverse(F.transform(conv, lambda t: side(t, names))), F.lit(True))
    return F.when(back > 0, F.size(conv) - back)


def map_values(conv: Column, change) -> Column:
    """change(turn, place) -> new value."""
    return F.transform(conv, lambda t, i: turn(t["from"], change(t, i)))


def prefix_first_human(conv: Column, prefix: str) -> Column:
    at = first_place(conv, HUMAN)
    return map_values(conv, lambda t, i: F.when(i == at, F.concat(F.lit(prefix), t["value"])).when(side(t, ASSISTANT), F.replace(t["value"], F.lit("Self-correction"), F.lit("Correction"))).otherwise(t["value"]))


def suffix_last_assistant(conv: Column, suffix: str) -> Column:
    """A line break goes before the suffix only where the text doesn't end with one."""
    at = last_place(conv, ASSISTANT)
    ended = lambda v: F.when(v.endswith("\n"), v).otherwise(F.concat(v, F.lit("\n")))
    return map_values(conv, lambda t, i: F.when(i == at, F.concat(ended(t["value"]), F.lit(suffix))).otherwise(t["value"]))


def wrap_images(conv: Column) -> Column:
    wrapped = F.lit("<im_start><image><im_end>")
    return map_values(conv, lambda t, _: F.when(side(t, ASSISTANT), F.replace(t["value"], F.lit("<image>"), wrapped)).otherwise(t["value"]))


def two_turns(prompt: Column, answer: Column) -> Column:
    return F.array(turn("human", prompt), turn("gpt", answer))


def said(conv: Column, names: tuple[str, ...]) -> Column:
    return F.array_join(F.transform(F.filter(conv, lambda t: side(t, names)), lambda t: t["value"]), "\n")


def words(text: Column) -> Column:
    """Count of words between white space; none in empty text."""
    x = strip(F.regexp_replace(text, r"\s+", " "))
    return F.when(x.isNull() | (x == ""), 0).otherwise(F.size(F.split(x, " ")))


def length_of(conv: Column, has_image: Column, image_tokens: int = IMAGE_WORDS) -> Column:
    """Words of all turns plus a constant for an image; negative without an image, so that batches can part by sign."""
    n = F.aggregate(conv, F.lit(0), lambda a, t: a + words(t["value"]))
    return F.when(has_image, n + image_tokens).otherwise(-n)


def instruction(text: Column) -> Column:
    """What follows a correction marker, up to the next image."""
    return F.nullif(strip(F.regexp_extract(text, r"(?si)Correction\s*:\s*(.*?)(?:<image>|$)", 1)), F.lit(""))


def correction_of(conv: Column) -> Column:
    """Assistant turns first, else human ones."""
    of = lambda names: F.get(F.filter(F.transform(F.filter(conv, lambda t: side(t, names)), lambda t: instruction(t["value"])), lambda v: v.isNotNull()), F.lit(0))
    return F.coalesce(of(ASSISTANT), of(HUMAN))


def needs_correction(conv: Column) -> Column:
    """False only if an assistant turn's correction says that all is well; without a marker, true."""
    return ~F.exists(conv, lambda t: side(t, ASSISTANT) & F.coalesce(instruction(t["value"]).rlike(r"(?i)looks good|no issues"), F.lit(False)))


def asks_again(reflection: Column) -> Column:
    """Whether the first pass has a correction line that doesn't say "looks good"; later passes don't count."""
    parts = F.split(reflection, r"(?im)^[ \t]*Self-reflect:[ \t]*")
    line = F.regexp_extract(F.coalesce(F.get(parts, F.lit(1)), F.get(parts, F.lit(0))), r"(?im)^([ \t]*Correction[\w/ -]*:[ \t]*.*?)\s*$", 1)
    return (line != "") & ~F.contains(F.lower(line), F.lit("looks good"))


def numbered(steps: Column) -> Column:
    return F.array_join(F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")


def clean_steps(steps: Column) -> Column:
    """Numbering stripped, blanks dropped."""
    return F.filter(F.transform(steps, lambda s: strip(F.regexp_replace(s, r"^\s*\d+\s*[.)]\s*", ""))), lambda s: s != "")


def fit_codes(codes: Column, n: int) -> Column:
    """Cut or filled with 0 to n codes."""
    return F.slice(F.concat(codes, F.array_repeat(F.lit(0), n)), 1, n)


def until_stop(tokens: Column, stops: list[int]) -> Column:
    at = F.array_position(F.transform(tokens, lambda t: t.isin(*stops)), F.lit(True))
    return F.when(at > 0, F.slice(tokens, F.lit(1), at.cast("int") - 1)).otherwise(tokens)


def plain_caption(text: Column) -> Column:
    """White space collapsed; null if it reads as an instruction."""
    return F.when(~F.contains(text, F.lit("orrection")), strip(F.regexp_replace(text, r"\s+", " ")))


def strip_photo_of(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)^a photo of \s*", "")


def answers(reply: Column, n: Column) -> Column:
    """yes and no words of a reply; null unless there are n of them."""
    found = F.transform(F.regexp_extract_all(reply, F.lit(r"(?i)\b(yes|no)\b"), F.lit(1)), lambda x: F.lower(x))
    return F.when(F.size(found) == n, found)


def json_part(reply: Column) -> Column:
    """From the first brace to the last, after a thinking block."""
    return F.regexp_extract(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""), r"(?s)\{.*\}", 0)
