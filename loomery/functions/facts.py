"""Counts, positions and attributes of detected objects as columns: evidence, numbers in texts, relations, votes and checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomery.functions import lexicon
from loomery.operators import boxes

# Words that end phrases or are no totals, quantities, colours and materials, irregular plurals, structures.
PHRASE_END = (
    "than that which who so to and or while with without near next beside behind in on at of from by under over above below between among around inside outside into onto along across against toward towards for as then where until "
    "positioned placed standing sitting lying resting floating nearby atop beneath underneath alongside opposite amid"
).split()
NOT_A_TOTAL = "the adding removing add remove of these those both".split()
ORDINALS = "second third fourth fifth sixth seventh eighth ninth tenth".split()
QUANTIFIERS = "a an the another more additional extra remaining all some".split() + ORDINALS
RELATIVE = r"(?i)\b(?:more|additional|extra|another|in total|a total|total of|total count)\b|\b(?:a|an)\s+(?:second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)\b"
TOTAL = r"(?i)\bin total\b|\ba total\b|\btotal of\b|\btotal count\b"
TOKEN = r"[A-Za-z0-9][\w'-]*|[^\w\s]"
PHRASE_STOP = (
    "a an the some several many few lone single with and or of in on at to by near beside behind above below under over from into onto than while where that which who is are was were sits sit stands stand rests rest lies lie hangs hang "
    "no without not each both all its their his her this these those around across through along against between among inside outside atop beneath underneath alongside next nearby there here as taller shorter bigger smaller larger "
    "higher lower longer wider same equal other another"
).split()
UNIQUE = "sun moon sky earth horizon rainbow".split()
COLOR_WORDS = {
    "grey": "gray", "golden": "gold", "tan": "beige", "cream": "beige", "violet": "purple", "navy": "blue", "maroon": "red", "burgundy": "red", "crimson": "red", "turquoise": "blue",
    "teal": "green", "olive": "green", "ivory": "white", "khaki": "beige", "bronze": "brown", "copper": "orange", "magenta": "pink", "lavender": "purple",
}
COLORS = "red orange yellow green blue purple pink brown black white gray silver gold beige".split()
IRREGULAR_PLURALS = {
    "man": "men", "woman": "women", "child": "children", "person": "people", "mouse": "mice", "goose": "geese", "foot": "feet", "tooth": "teeth", "sheep": "sheep", "fish": "fish", "deer": "deer", "knife": "knives",
    "leaf": "leaves", "shelf": "shelves", "loaf": "loaves", "wolf": "wolves", "calf": "calves", "life": "lives", "wife": "wives", "half": "halves", "scarf": "scarves", "ox": "oxen", "cactus": "cacti",
}
QUANTITY = "a an one some several many few group pride herd flock pack crowd bunch couple pair number various multiple zero one two three four five six seven eight nine ten eleven twelve".split()
FUNCTION = "the and or of is are be its it that this as there their".split()
GLUE = "with without no in on at to left right front behind above below next beside under over facing wearing has have by near between among along around across inside outside atop onto into from for while and or".split() + lexicon.NUMBER_WORDS[:13]
RELATION = r"\b((?:to the (?:left|right) of|in front of|behind|above|below|on top of|beneath|next to|beside|underneath) (?:the |a |an |his |her |its |their )?[\w-]+)"
EXACTLY = r"(?i)\bexactly\s+((?:" + "|".join(lexicon.NUMBER_WORDS[:13]) + r"|\d+)\b)"
VAGUE = "group pride herd flock pack crowd bunch number variety row set series collection few several couple lot lots stack pile".split()


def _in(word: Column, words) -> Column:
    return F.array_contains(F.array(*map(F.lit, words)), word)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def head(noun: Column) -> Column:
    return lexicon.singular(F.regexp_extract(noun, r"(\S+)\s*$", 1))


def nouns_at(words: Column, noun: Column) -> Column:
    """For each token whether it is the noun: its head, and for a noun of several words after one of them, a number or a quantifier."""

    def flags(parts: Column, last: Column) -> Column:
        def flag(w: Column, j: Column) -> Column:
            before = F.get(words, j - 1)
            own = F.array_contains(parts, before) | lexicon.number_of(before).isNotNull() | _in(before, QUANTIFIERS)
            return (lexicon.singular(w) == last) & ((F.size(parts) == 1) | (j == 0) | F.coalesce(own, F.lit(False)))

        return F.transform(words, flag)

    return lexicon.let(F.split(F.lower(noun), r"\s+"), lambda parts: lexicon.let(head(noun), lambda last: flags(parts, last)))


def _stops(word: Column) -> Column:
    return lexicon.number_of(word).isNotNull() | ~word.rlike("^[a-z]") | _in(word, PHRASE_END)


def _places(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))


def numbers_of(text: Column, noun: Column, totals: bool = True) -> Column:
    """Numbers that count the noun: up to four words before it, no stop between, not one, and (for totals) after no article or verb."""

    def found(words: Column, stop: Column, here: Column) -> Column:
        def counts(k: Column) -> Column:
            near = F.filter(F.sequence(k + 1, k + 4), lambda j: (j < F.size(words)) & (F.get(stop, j) | F.get(here, j)))
            hit = F.coalesce(~F.get(stop, F.get(near, F.lit(0))), F.lit(False))
            value = lexicon.number_of(F.get(words, k))
            free = (k == 0) | ~_in(F.get(words, k - 1), NOT_A_TOTAL) if totals else F.lit(True)
            return value.isNotNull() & (value != 1) & free & hit

        return F.transform(F.filter(_places(words), counts), lambda k: lexicon.number_of(F.get(words, k)))

    return lexicon.let(tokens(text), lambda words: lexicon.let(F.transform(words, _stops), lambda stop: lexicon.let(nouns_at(words, noun), lambda here: found(words, stop, here))))


def count_edit(step: Column, noun: Column) -> Column:
    """(op, k, relative, definite) of an Add or Remove step on the noun; null for other steps."""

    def edit(op: Column, phrase: Column, at: Column, numbers: Column) -> Column:
        own = F.slice(phrase, 1, at)
        first = F.coalesce(F.get(own, F.lit(0)), F.lit(""))
        relative = F.array_join(own, " ").rlike(RELATIVE) | step.rlike(TOTAL)
        number = F.get(F.filter(F.slice(numbers, 1, at), lambda n: n.isNotNull()), F.lit(0))
        plural = lexicon.singular(F.get(phrase, at)) != F.get(phrase, at)
        made = lambda k, rel, definite: F.struct(op.alias("op"), k.cast("int").alias("k"), rel.alias("relative"), F.lit(definite).alias("definite"))
        return F.when(
            op.isin("add", "remove") & at.isNotNull(),
            F.when(number.isNotNull(), made(number, relative, False)).when(first.isin("a", "an", "another") | F.exists(own, lambda w: _in(w, ORDINALS)), made(F.lit(1), relative, False))
            .when((first == "the") & (op == "remove") & ~relative, made(F.when(~plural, 1), F.lit(False), True)).when(relative, made(F.lit(None), F.lit(True), False)),
        )

    def phrase_of(words: Column) -> Column:
        rest = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
        end = F.array_position(F.transform(rest, lambda w: _in(w, PHRASE_END) | ~w.rlike("^[a-z0-9]")), True)
        return F.when(end > 0, F.slice(rest, 1, (end - 1).cast("int"))).otherwise(rest)

    def at_of(phrase: Column) -> Column:
        return F.nullif(F.array_position(nouns_at(phrase, noun), True), F.lit(0).cast("long")).cast("int") - 1

    let = lexicon.let
    return let(tokens(step), lambda words: let(phrase_of(words), lambda phrase: let(at_of(phrase), lambda at: let(F.transform(phrase, lexicon.number_of), lambda numbers: edit(F.get(words, F.lit(0)), phrase, at, numbers)))))


def replace_changes_count(step: Column, noun: Column) -> Column:
    changed = lexicon.let(numbers_of(step, noun, totals=False), lambda v: (F.size(v) >= 2) & (F.get(v, F.lit(0)) != F.get(v, F.size(v) - 1)))
    return F.startswith(step, F.lit("Replace")) & changed


def evidence_state(lo: Column, hi: Column, shared: Column, most: int) -> Column:
    """exact, range or unmeasured, of confident boxes (lo) and all that may count (hi)."""
    return F.when(shared | (lo == 0) | (hi > most), "unmeasured").when(lo == hi, "exact").otherwise("range")


def narrow(state: Column, lo: Column, hi: Column) -> Column:
    return (state == "range") & (hi - lo == 1)


def consistent(state: Column, lo: Column, hi: Column, value: Column) -> Column:
    return state.isin("exact", "range") & value.between(lo, hi)


def decisive(state: Column, lo: Column, hi: Column, target: Column) -> Column:
    return state.isin("exact", "range") & ~target.between(lo, hi)


def evidence_text(noun: Column, state: Column, lo: Column, hi: Column, target: Column) -> Column:
    """The line about one counted object."""
    word = lexicon.number_word
    text = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))
    seen = F.when(state == "unmeasured", "not measured").when(state == "exact", text("exactly ", word(lo))).when(narrow(state, lo, hi), text(word(lo), " or ", word(hi))).otherwise(text("between ", word(lo), " and ", word(hi)))
    return text("- ", noun, ": ", seen, " (the caption asks for ", word(target), ")")


COUNT_STEP = r"(?i)\bnumber of ([^,.;]+?)\b(?:from|to)\b"


def names(text: Column, noun: Column) -> Column:
    """Whether a text has the noun's head as a word."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\w'-]+"), F.lit(0))
    return lexicon.let(head(noun), lambda last: F.exists(words, lambda w: lexicon.singular(w) == last))


def count_reason(items: Column, steps: Column, noun: Column, target: Column, lo: Column, hi: Column, state: Column) -> Column:
    """Why a reply's counts of one object disagree with the detector; the first rule that fails, or null.

    change, replace: a step hides a number; total: a step implies one; said: an item says a count that was ruled out; add_unknown, not_end: the
    steps, applied in order to every count that may be, do not end on the target; missing: a wrong count is not fixed; implies, states:
    a count is touched or told although nothing speaks against it.
    """
    hidden = F.transform(steps, lambda s: F.when(F.startswith(s, F.lit("Change")) & s.rlike(COUNT_STEP), "change").when(replace_changes_count(s, noun), "replace"))
    hidden = F.get(F.filter(hidden, lambda r: r.isNotNull()), F.lit(0))
    said = F.filter(F.flatten(F.transform(items, lambda i: numbers_of(i, noun))), lambda v: v != target)
    edits = F.filter(F.transform(steps, lambda s: count_edit(s, noun)), lambda e: e.isNotNull())
    total = F.exists(steps, lambda s: s.rlike(TOTAL) & names(s, noun) & count_edit(s, noun).isNull())
    replaced = F.exists(steps, lambda s: F.startswith(s, F.lit("Replace")) & F.array_contains(numbers_of(s, noun), target))
    wrong = decisive(state, lo, hi, target)

    def applied(found: Column) -> Column:
        def one(counts: Column, e: Column) -> Column:
            moved = F.transform(counts, lambda n: F.when(e["k"].isNull(), F.lit(0)).when(e["op"] == "add", n + e["k"]).otherwise(F.greatest(n - e["k"], F.lit(0))))
            return F.array_distinct(F.when(e["k"].isNull() & e["relative"], F.transform(counts, lambda n: F.least(n, target))).otherwise(moved))

        return F.aggregate(found, F.sequence(lo, F.greatest(lo, hi)), one)

    def reason(found: Column, told: Column) -> Column:
        first = F.get(found, F.lit(0))
        whole = (F.size(found) == 1) & (first["op"] == "add") & (first["k"] == target) & (lo == 0)
        unknown = F.exists(found, lambda e: e["k"].isNull() & (e["op"] == "add"))
        ends = F.when(unknown, "add_unknown").when(~F.array_contains(applied(found), target) & ~F.coalesce(whole, F.lit(False)), "not_end")
        open_ = F.when(F.exists(told, lambda v: ~consistent(state, lo, hi, v)), "said").when(F.size(found) > 0, ends).when(wrong & (target >= 2) & ~replaced, "missing")
        touched = F.exists(found, lambda e: ~e["definite"] & ((e["op"] == "remove") | e["relative"] | ~F.coalesce(e["k"] == target, F.lit(False))))
        return F.coalesce(hidden, F.when(total, "total"), F.when(wrong | narrow(state, lo, hi), open_).otherwise(F.when(touched, "implies").when(F.size(told) > 0, "states")))

    return lexicon.let(edits, lambda found: lexicon.let(said, lambda told: reason(found, told)))


def noun_phrase(caption: Column, noun: Column, extra: int = 3) -> Column:
    """The noun as the caption writes it, with up to `extra` words before it that end at no stop word; the noun itself if it is not there."""

    def phrase(words: Column, last: Column, parts: Column) -> Column:
        place = F.array_position(F.transform(words, lambda w: lexicon.singular(w) == last), True).cast("int") - 1
        start = place - F.size(parts) + 1
        stop = lambda w: ~w.rlike("^[a-z]") | _in(w, PHRASE_STOP) | lexicon.number_of(w).isNotNull() | F.endswith(w, F.lit("ing"))
        back = F.array(*(F.coalesce((start - k < 0) | stop(F.get(words, start - k)), F.lit(True)) for k in range(1, extra + 1)))
        many = F.coalesce(F.nullif(F.array_position(back, True), F.lit(0).cast("long")) - 1, F.lit(extra)).cast("int")
        return F.when((place < 0) | (start < 0), noun).otherwise(F.array_join(F.slice(words, F.greatest(start - many + 1, F.lit(1)), many + F.size(parts)), " "))

    let = lexicon.let
    return let(tokens(caption), lambda words: let(head(noun), lambda last: let(F.split(F.lower(noun), r"\s+"), lambda parts: phrase(words, last, parts))))


def caption_count(caption: Column, name: Column, plural: Column) -> Column:
    """The number that a caption gives an object, null if none: a number word, digits, an article or a pair up to three words before the noun.

    Vague quantities between the two are no number, and an article counts only its own singular noun.
    """
    numbers = "|".join([*lexicon.NUMBER_WORDS[1:13], "a", "an", "single", "pair of", r"\d+"])
    pattern = F.concat(F.lit(rf"(?i)(?=\b({numbers})\b((?:\s+[\w-]+){{0,3}}?)\s+("), name, F.lit("|"), plural, F.lit(r")\b)"))
    group = lambda i: F.regexp_extract_all(F.lower(caption), pattern, F.lit(i))

    def value(m: Column) -> Column:
        between, word = F.regexp_extract_all(m["between"], F.lit("[a-z]+"), F.lit(0)), m["word"]
        article = word.isin("a", "an", "single") & (plural != name) & (m["noun"] == plural)
        number = F.coalesce(lexicon.number_of(word), F.when(word == "pair of", 2).otherwise(1))
        return F.when(F.arrays_overlap(between, F.array(*map(F.lit, VAGUE))), F.lit(None)).when(F.array_contains(between, F.lit("pair")), 2).when(~article, number)

    found = F.transform(F.arrays_zip(group(1).alias("word"), group(2).alias("between"), group(3).alias("noun")), value)
    return F.get(F.filter(found, lambda n: n.isNotNull()), F.lit(0))


def pluralize(noun: Column) -> Column:
    n = F.length(noun)
    return F.when(noun.rlike("(s|x|ch|sh)$"), F.concat(noun, F.lit("es"))).when(noun.rlike("([^aeiou]|^)y$"), F.concat(F.substring(noun, F.lit(1), n - 1), F.lit("ies"))).otherwise(F.concat(noun, F.lit("s")))


def irregular_plural(noun: Column) -> Column:
    """Plural of a noun whose last word ends in an irregular one; else null."""
    rule = None
    for one, many in IRREGULAR_PLURALS.items():
        hit, new = F.endswith(noun, F.lit(one)), F.concat(F.substring(noun, F.lit(1), F.length(noun) - len(one)), F.lit(many))
        rule = F.when(hit, new) if rule is None else rule.when(hit, new)
    return rule


def enrich_stem(word: Column) -> Column:
    """The first of ing, ed, ly, s that leaves three letters, then a last e of longer words."""
    return lexicon.let(lexicon.let(word, _without_ending), lambda out: F.when(F.endswith(out, F.lit("e")) & (F.length(out) > 3), F.substring(out, F.lit(1), F.length(out) - 1)).otherwise(out))


def _without_ending(word: Column) -> Column:
    out = None
    for end in ("ing", "ed", "ly", "s"):
        hit, new = F.endswith(word, F.lit(end)) & (F.length(word) - len(end) >= 3), F.substring(word, F.lit(1), F.length(word) - len(end))
        out = F.when(hit, new) if out is None else out.when(hit, new)
    return out.otherwise(word)


def dropped_words(original: Column, new: Column) -> Column:
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9']+"), F.lit(0))
    return F.filter(words(original), lambda w: ~F.array_contains(words(new), w) & ~_in(w, QUANTITY) & ~_in(w, FUNCTION) & ~w.rlike("^[0-9]+$"))


def foreign_words(text: Column, allowed: Column) -> Column:
    """Words of a text whose stem the allowed text does not have."""
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit("[a-z]+(?:'[a-z]+)?"), F.lit(0))
    known = F.transform(words(allowed), enrich_stem)
    return lexicon.let(known, lambda have: F.filter(words(text), lambda w: ~F.array_contains(have, enrich_stem(w)) & ~_in(w, FUNCTION) & ~_in(w, QUANTITY) & ~_in(w, GLUE)))


def relation_phrases(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(RELATION), F.lit(1)), F.lower)


def new_digits(original: Column, new: Column) -> Column:
    digits = lambda t: F.regexp_extract_all(t, F.lit("[0-9]+"), F.lit(0))
    return F.size(F.array_except(digits(new), digits(original))) > 0


def strip_exactly(original: Column, new: Column) -> Column:
    return F.when(F.contains(F.lower(original), F.lit("exactly")), new).otherwise(F.regexp_replace(new, EXACTLY, "$1"))


def spell_count(original: Column, new: Column, value: Column) -> Column:
    """A digit that the rewrite added for a counted value, in words."""
    had = F.array_contains(F.regexp_extract_all(original, F.lit("[0-9]+"), F.lit(0)), value.cast("string"))
    spelled = F.regexp_replace(new, F.concat(F.lit(r"\b"), value.cast("string"), F.lit(r"\b(\s+[A-Za-z])")), F.concat(lexicon.number_word(value), F.lit("$1")))
    return F.when(had, new).otherwise(spelled)


def normalize_word(text: Column, table: dict[str, str], allowed: list[str]) -> Column:
    """The last word of a free attribute that maps onto the vocabulary; else null."""
    words = F.transform(F.reverse(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))), lambda w: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), w), w))
    return F.get(F.filter(words, lambda w: _in(w, allowed)), F.lit(0))


def restates(value: Column, noun: Column) -> Column:
    """Whether an attribute already is the noun; trailing letters e and n do not count."""
    words, short = F.split(noun, " "), F.regexp_replace(value, "[en]+$", "")
    return F.array_contains(words, value) | F.array_contains(words, short) | F.exists(words, lambda w: F.startswith(w, short))


def count_vote(first: Column, second: Column, gray: Column, faint: Column, most: int) -> Column:
    """The count that two detectors settle: the first one's boxes, its borderline boxes (gray), and whether the second sees a lone one faintly."""
    equal = (first == second) & first.between(1, most)
    doubtful = (gray >= F.greatest(F.lit(2), F.floor(first / 2))) | ((gray > 0) & (first < 2))
    return F.when(equal, F.when(~doubtful, first)).when((first == 1) & (gray == 0) & (second == 0) & faint, 1)


def relation_2d(a: Column, b: Column, width: float, height: float) -> Column:
    """Relation of two boxes: left and right unless one spans the other, above and below across a gap; else null."""
    centre = lambda x: (x[0] + x[2]) / 2
    across, least = F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.least(a[2] - a[0], b[2] - b[0])
    side = F.when(across < 0.5 * least, F.when(centre(a) < centre(b) - 0.03 * width, "to the left of").when(centre(a) > centre(b) + 0.03 * width, "to the right of"))
    over = F.when(across > 0.3 * least, F.when(a[3] < b[1] - 0.02 * height, "above").when(a[1] > b[3] + 0.02 * height, "below"))
    return F.coalesce(side, over)


def held_by(outer: Column, inner: Column, share: float) -> Column:
    return boxes.overlap(outer, inner) / F.greatest(boxes.area(inner), F.lit(1e-6)) >= share


def relation_3d(a: Column, b: Column, depth_a: Column, depth_b: Column, margin: float) -> Column:
    """in front of or behind, for boxes that line up and do not lie in one another; larger depth is nearer."""
    lined = F.least(a[2], b[2]) - F.greatest(a[0], b[0]) >= 0.3 * F.least(a[2] - a[0], b[2] - b[0])
    fine = lined & ~held_by(a, b, 0.5) & ~held_by(b, a, 0.5)
    return F.when(fine & (depth_a > depth_b + margin), "in front of").when(fine & (depth_a < depth_b - margin), "behind")
