"""Rules for curating critiques and captions as columns: turn parsing, step and caption checks, ordered first reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomery.functions import lexicon

# Patterns, word lists and wordings that must equal those of the data.
TURN = r"(?s)^(.*?)(?:(Self-reflect(?:ion)?\s*:)\s*(.*?)\s*)?((?:Self-)?Correction\s*:)\s*(.*?)(\s*<image>\s*)?$"
JUNK = {
    "placeholder": r"PLACEHOLDER|EDIT_OPERATION|</?[a-z]+_[a-z_]+>",
    "no_edit": r"(?i)\bno edits? (?:operation )?(?:is |are |was )?(?:required|needed|performed)|\bno changes? (?:is |are )?(?:required|needed)|\bimages are identical\b|\bno image content\b|\bmatches the description perfectly\b",
    "diptych": r"(?i)\b(?:diptych|(?:left|right|first|second) panel|both (?:images|panels)|initial description)\b",
}
DELTA_STRICT = (
    r"(?i)\b(?:now|no longer|replacing|previous(?:ly)?|(?:has|have) been|(?:is|are) absent|compared to|than before|than (?:in )?the (?:original|first|previous)|removed|replaced|instead of|rather than"
    r"|slightly (?:more|less|reduced|increased|darker|brighter|lighter)|(?:increased|reduced|decreased|enhanced) (?:colou?r )?(?:saturation|contrast|brightness|vibranc\w*|sharpness|exposure))\b"
)
DELTA = DELTA_STRICT + r"|\bmore \w+ than\b"
SECOND_ACTION = r"(?i)(?:,|\band)\s+(?:then\s+)?(add(?:ing)?|remov(?:e|ing)|replac(?:e|ing)|delet(?:e|ing)|insert(?:ing)?|chang(?:e|ing)|adjust(?:ing)?|alter(?:ing)?|mov(?:e|ing))\b"
ACTIONS = {"add": "add", "remo": "remove", "dele": "remove", "repl": "replace", "inse": "add", "chan": "change", "adju": "change", "alte": "change", "make": "change", "turn": "change", "move": "move", "movi": "move"}
VERBS, ONE_OBJECT = ("Add", "Remove", "Replace", "Move", "Change"), ("Add", "Remove", "Replace")
_DET = r"(?:a|an|the|another|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|\d+)"
MULTI_OBJECT, BETWEEN = r"(?i)(?:,|\band)\s+" + _DET + r"\s", r"(?i)\bbetween\b.*?\band\b"
COUNT_TAIL = (
    r"(?i),?\s*(?:so that (?:only\b|there (?:is|are) (?:only |now )?(?:" + _DET + r"|no)\b|(?:the )?(?:total|count|number)\b)"
    r"|(?:to|in order to) (?:make|bring|reach|have|leave|ensure|get|create)\b[^.]*?\b(?:total|remains?|there (?:is|are)|only)\b)[^.]*"
)
SCENE = r"(?i)\s+(?:to|from|in|into) (?:the|this) (?:scene|image|picture)\b"
KEEP_STEP = r"(?i)^(?:keep|maintain|preserve|retain|leave)\b|\b(?:remains?|stays?|kept) (?:unchanged|the same|consistent|intact)\b|\bunchanged\b"
KEEP_SENTENCE, ENSURE_SENTENCE = r"(?i)^(?:keep|maintain|preserve|retain|leave)\b", r"(?i)^(?:ensure|make sure)\b.*\b(?:remains?|unchanged|the same|consistent|intact|unaltered)\b"
KEEP_CLAUSE = r"(?i),?\s*(?:while\s+|and\s+|but\s+)?(?:maintaining|keeping|preserving|retaining|leaving)\b[^.;]*|,?\s*(?:while\s+|and\s+)?ensuring (?:that )?[^.;]*\b(?:remains?|unchanged|the same|consistent|intact)\b[^.;]*"
STEP_LEAK = r"(?i)\b(?:first|second|original|edited|initial|previous) (?:image|picture|version|panel)\b|\b(?:has|have) been\b|\bthe edit(?:ing)? operation\b|\bis replaced (?:by|with)\b|\bdiptych\b"
SECTION, NUMBERING = r"(?i)\b(self-reflect|correction)\s*:", r"^\s*(?:\d+[.)]|[-*•])\s*"
NO_ISSUE = r"(?i)\b(?:looks\s+good|no\s+issues)\b"
NOT_A_PROBLEM = (
    r"(?i)\b(?:(?:which |that )?match(?:es)? (?:the )?(?:caption|prompt|description)|(?:is|are) correct|correctly (?:shown|depicted|present|rendered)|however|looking (?:more )?closely|upon closer"
    r"|(?:is|are) (?:met|satisfied)|match(?:es)? the (?:count|number))\b"
)
_NUM = r"(?:zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|\d+)"
DETECTOR = r"(?i)\bdetector|\bmeasured\b|\b" + _NUM + " or " + _NUM + r"\b|\bbetween " + _NUM + " and " + _NUM + r"\b"
NOT_ASKED = r"(?i)\bnot (?:mentioned|specified|requested|asked for|described|included)\b|\bnot in the (?:caption|prompt)\b|\b(?:caption|prompt) does not (?:mention|ask|specify|request)"
SHOULD_NOT = r"(?i)\bshould not (?:be )?(?:present|there|appear|exist|be (?:in|visible|included))\b|\bshould ?n[o']t be\b|\bshould be absent\b|\bnot supposed to\b|\bunwanted\b|\bextraneous\b|\bshould be removed\b|\bshould not have\b"
NEGATION = r"(?i)\b(?:no|without|not|lacking|lacks|devoid of|free of|absent|missing|except|minus|nor|none|empty|bare|headless|tailless|wingless|handleless)\b(?:(?:\s+[\w'-]+){0,5})"
INSTEAD_OF, QUOTED = r"(?i)\binstead of\b(.*?)(?:[.;]|$)", "[\"'‘’“”]([^\"'‘’“”]{1,40})[\"'‘’“”]"
STOP = "a an the and or of to in on with for from by at is are be it its that this as into than then there their but".split()
META = [
    *dict.fromkeys(
        w[:5]
        for w in (
            "edit edited editing image picture scene show shows showing make making ensure change changed changing adjust adjusted adjusting modify modified apply applied create creating transform transformed transforming "
            "second first overall entire seems appear appears appearance now more slightly while maintain maintaining keep keeping enhance enhancing additionally operation involves featuring feature resulting instead rather "
            "should would will been have has now also remains remain same altered alter different suggesting includes including"
        ).split()
    )
]
GROUND_STOP = (
    "a an the of in on at to for with and or but is are was were be being been it its this that these those there here as by from into onto than then so just only very more most less least some any all each every both "
    "either neither one single pair such other another same different also rather instead not no nor which who whose whom what where when while how do does did have has had having make makes made get gets got lot lots "
    "kind sort type part parts way ways object objects item items thing things scene image picture caption prompt visible shown appears appear seems seem present them they their he she his her him us we our you your i me my "
    "directly entirely completely clearly should would could can may might must shall will positioned placed located shaped shape"
).split()
SPATIAL = (
    "taller shorter bigger smaller larger higher lower longer wider narrower above below left right behind front top bottom under over beside inside outside near far up down between beneath atop underneath next adjacent side "
    "foreground background center middle ahead"
).split()
NO_ISSUE_CRITIQUE = "<image>\nSelf-reflect: no issues, it matches the prompt.\nCorrection: looks good."


def _in(word: Column, words) -> Column:
    return F.array_contains(F.array(*map(F.lit, words)), word)


def split_turn(text: Column) -> Column:
    """Parts of a turn that carries a Correction: pre, self_reflect (null without its marker), correction, post; null without a Correction."""
    part = lambda i: F.regexp_extract(text, TURN, i)
    parts = F.struct(
        part(1).alias("pre"), F.nullif(part(2), F.lit("")).alias("reflect_marker"), F.when(part(2) != "", F.trim(part(3))).alias("self_reflect"),
        part(4).alias("correction_marker"), F.trim(part(5)).alias("correction"), part(6).alias("post"),
    )
    return F.when(text.rlike(TURN) & (F.trim(part(5)) != ""), parts)


def edit_turn(turns: Column) -> Column:
    """Place (from 0) of the turn that holds the Correction: a gpt turn if there is one, else a human turn; else null."""
    place = lambda role: F.array_position(F.transform(turns, lambda t: (t["from"] == role) & t["value"].contains("orrection") & split_turn(t["value"]).isNotNull()), True)
    gpt, human = place("gpt"), place("human")
    return F.when(gpt > 0, gpt - 1).when(human > 0, human - 1)


def junk_reason(self_reflect: Column, correction: Column) -> Column:
    text = F.concat(F.coalesce(self_reflect, F.lit("")), F.lit("\n"), correction)
    return F.coalesce(*(F.when(text.rlike(p), F.lit(name)) for name, p in JUNK.items()))


def numbered(steps: Column) -> Column:
    return F.array_join(F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")


def rebuild_turn(parts: Column, self_reflect: Column, correction: Column) -> Column:
    """A turn with numbered items in place of its texts, under the markers it had."""
    head = F.when(parts["reflect_marker"].isNotNull(), F.concat(parts["reflect_marker"], F.lit("\n"), numbered(self_reflect), F.lit("\n"))).otherwise("")
    tail = F.when(parts["post"] != "", F.concat(F.lit("\n"), F.regexp_replace(parts["post"], r"^\s+|\s+$", ""))).otherwise("")
    return F.concat(parts["pre"], head, parts["correction_marker"], F.lit("\n"), numbered(correction), tail)


def critique_text(self_reflect: Column, correction: Column) -> Column:
    """The critique's text; without a correction the fixed no-issue text."""
    return F.when(F.size(correction) == 0, NO_ISSUE_CRITIQUE).otherwise(F.concat(F.lit("<image>\nSelf-reflect:\n"), numbered(self_reflect), F.lit("\nCorrection:\n"), numbered(correction)))


def first_word(step: Column) -> Column:
    return F.regexp_extract(step, r"^\s*(\S+)", 1)


def _action(word: Column, other: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv)), word), other)


def second_action(step: Column) -> Column:
    """Whether a step joins a second, different action."""
    own = F.substring(F.lower(first_word(step)), 1, 4)
    own = _action(own, own)
    return F.exists(F.regexp_extract_all(step, F.lit(SECOND_ACTION), F.lit(1)), lambda m: _action(F.substring(F.lower(m), 1, 4), F.lit("")) != own)


def several_objects(step: Column) -> Column:
    """Whether an add, remove or replace step names more than one object."""
    return _in(first_word(step), ONE_OBJECT) & F.regexp_replace(step, BETWEEN, "between").rlike(MULTI_OBJECT)


def simplify_step(step: Column) -> Column:
    """A step without tails on counts and scene fillers, with a final period."""
    short = F.when(_in(first_word(step), ONE_OBJECT), F.regexp_replace(step, COUNT_TAIL, "")).otherwise(step)
    short = F.trim(F.regexp_replace(short, SCENE, ""))
    return F.when((short == "") | short.rlike("[.!?]$"), short).otherwise(F.concat(short, F.lit(".")))


def edit_text(correction: Column) -> Column:
    """The Correction without sentences and clauses that say what to keep; as it is if nothing is left."""
    kept = F.filter(F.split(F.trim(correction), r"(?<=[.!?])\s+"), lambda s: ~s.rlike(KEEP_SENTENCE) & ~s.rlike(ENSURE_SENTENCE))
    kept = F.filter(F.transform(kept, lambda s: F.regexp_replace(s, KEEP_CLAUSE, "")), lambda s: F.trim(s) != "")
    return F.when(F.size(kept) == 0, correction).otherwise(F.array_join(kept, " "))


def content_stems(text: Column) -> Column:
    """Distinct 5-letter stems of words over two letters, without stop words and words about editing."""
    w = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0)), lambda w: (F.length(w) > 2) & ~_in(w, STOP))
    return F.array_except(F.array_distinct(F.transform(w, lambda w: F.substring(w, 1, 5))), F.array(*map(F.lit, META)))


def covers(original: Column, steps: Column) -> Column:
    """Share of the original's stems that the steps keep; 1 for an original without any."""
    return lexicon.coverage(content_stems(original), content_stems(F.array_join(steps, " ")))


def clean_steps(steps: Column) -> Column:
    """Steps with white space collapsed and numbering stripped, blanks dropped."""
    tidy = F.transform(steps, lambda s: F.regexp_replace(F.trim(F.regexp_replace(s, r"\s+", " ")), NUMBERING, ""))
    return F.filter(tidy, lambda s: s != "")


def bad_step(steps: Column) -> Column:
    """Why cleaned steps are turned down as a list: marker or leak; else null."""
    return F.when(F.exists(steps, lambda s: s.contains("<image>") | s.rlike(SECTION)), "marker").when(F.exists(steps, lambda s: s.rlike(STEP_LEAK)), "leak")


def caption_reason(new: Column, original: Column, least: float = 0.5, precise: float = 0.8) -> Column:
    """Why a rewritten caption is turned down, the first of: missing, image, delta, drops, adds; else null."""
    tidy = F.trim(F.regexp_replace(new, r"\s+", " "))
    return (
        F.when(F.coalesce(tidy, F.lit("")) == "", "missing").when(tidy.contains("<image>"), "image").when(tidy.rlike(DELTA_STRICT), "delta")
        .when(covers(original, F.array(tidy)) < least, "drops").when(covers(tidy, F.array(original)) < precise, "adds")
    )


def decompose_reason(correction: Column, self_reflect: Column, source_correction: Column, source_reflect: Column, most: int = 12, least: float = 0.6, least_reflect: float = 0.6) -> Column:
    """Why a decomposition is turned down; the first rule that fails names it, null if none does. Steps are cleaned ones."""
    with_reflect = source_reflect.isNotNull()
    return F.coalesce(
        bad_step(correction), bad_step(self_reflect), F.when(F.size(correction) == 0, "empty"), F.when(F.size(correction) > most, "too_many"),
        F.when(with_reflect & ~F.size(self_reflect).between(1, most), "reflect_size"),
        F.when(with_reflect & (covers(source_reflect, F.concat(self_reflect, correction)) < least_reflect), "reflect_drops"),
        F.when(covers(edit_text(source_correction), correction) < least, "drops"),
        F.get(F.filter(F.transform(correction, lambda s: F.when(second_action(s), "second_action").when(s.rlike(KEEP_STEP), "keep")), lambda r: r.isNotNull()), F.lit(0)),
    )


def _stem(word: Column) -> Column:
    """Singular, then the first of ing, ed, ly, er, est that leaves more than three letters; numbers as they are."""
    return lexicon.let(lexicon.singular(word), _without_ending)


def _without_ending(w: Column) -> Column:
    out = F.when(w.rlike("^[0-9]+$"), w)
    for end in ("ing", "ed", "ly", "er", "est"):
        out = out.when(F.endswith(w, F.lit(end)) & (F.length(w) > len(end) + 3), F.substring(w, F.lit(1), F.length(w) - len(end)))
    return out.otherwise(w)


critic_stem = _stem


def ground_words(text: Column) -> Column:
    w = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9']*"), F.lit(0))
    w = F.filter(w, lambda w: ~_in(w, GROUND_STOP) & ((F.length(w) > 2) | w.rlike("^[0-9]+$")))
    return F.array_distinct(F.transform(w, _stem))


def words_match(a: Column, b: Column) -> Column:
    """A shared stem, or one stem that begins the other where both have four letters."""
    near = lambda x, y: (F.length(x) >= 4) & (F.length(y) >= 4) & (F.startswith(x, y) | F.startswith(y, x))
    return lexicon.let(b, lambda other: F.exists(a, lambda x: F.exists(other, lambda y: (x == y) | near(x, y))))


def ungrounded(item: Column, caption: Column) -> Column:
    """Why an item faults something that the caption does not ask for: not_excluded, not_asked; else null."""
    excluded = ground_words(F.array_join(F.regexp_extract_all(caption, F.lit(NEGATION), F.lit(0)), " "))
    wanted = F.regexp_extract(item, INSTEAD_OF, 1)
    quoted = F.exists(F.regexp_extract_all(wanted, F.lit(QUOTED), F.lit(1)), lambda q: F.contains(F.lower(caption), F.lower(q)))
    want, tokens = ground_words(wanted), lambda t: F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9][a-z0-9']*"), F.lit(0))
    spatial = F.arrays_overlap(tokens(wanted), F.array(*map(F.lit, SPATIAL))) & F.arrays_overlap(tokens(caption), F.array(*map(F.lit, SPATIAL)))
    return F.when(item.rlike(SHOULD_NOT) & ~words_match(ground_words(item), excluded), "not_excluded").when(
        item.rlike(INSTEAD_OF) & ~quoted & (F.size(want) > 0) & ~words_match(want, ground_words(caption)) & ~spatial, "not_asked"
    )


def critic_reason(self_reflect: Column, correction: Column, caption: Column, decisive: Column | None = None, most: int = 12, words: int = 50) -> Column:
    """Why a critic's reply is turned down, first rule first; null if it stands. Steps are cleaned and simplified ones.

    decisive: whether the detector contradicts the caption's counts, which a reply without problems may not ignore.
    """
    none, half = (F.size(correction) == 0) & (F.size(self_reflect) == 0), (F.size(correction) == 0) | (F.size(self_reflect) == 0)
    every = F.concat(self_reflect, correction)
    long = lambda s: F.size(F.split(F.trim(s), r"\s+")) > words
    first = lambda steps, why: F.get(F.filter(F.transform(steps, why), lambda r: r.isNotNull()), F.lit(0))
    detector = first(every, lambda s: F.when(s.rlike(DETECTOR), "detector").when(long(s), "long"))
    item = first(self_reflect, lambda s: F.coalesce(F.when(s.rlike(NOT_A_PROBLEM), "no_problem"), F.when(s.rlike(NOT_ASKED), "not_asked_for"), ungrounded(s, caption), F.when(_in(first_word(s), VERBS), "instruction")))
    step = first(correction, lambda s: F.when(~_in(first_word(s), VERBS), "verb").when(second_action(s), "second_action").when(several_objects(s), "several_objects").when(s.rlike(KEEP_STEP), "keep"))
    missed = F.when(F.coalesce(decisive, F.lit(False)), "count") if decisive is not None else F.lit(None).cast("string")
    rest = F.coalesce(F.when(half, "one_list"), F.when((F.size(correction) > most) | (F.size(self_reflect) > most), "too_many"), F.when(F.exists(every, lambda s: s.rlike(NO_ISSUE)), "no_issue"), detector, item, step)
    return F.coalesce(bad_step(correction), bad_step(self_reflect), F.when(none, missed).otherwise(rest))
