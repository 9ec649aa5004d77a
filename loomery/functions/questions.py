"""Rules over a prompt's questions (array of struct q, a, skill, p) as columns: nouns, subjects, oracle critiques, terms, rewards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomery.functions.lexicon import NUMBER_WORDS

# Question forms, order of skills, plurals on -ie, words that name nothing, and the wordings of a critique.
COUNT, OBJECT, BE = r"^How many (.+) are in the image\?$", r"^Are there any (.+) in the image\?$", r"^(Is|Are) the (.+)\?$"
SKILL_ORDER = ("object", "count", "attribute", "position", "verb")
IE_PLURALS = ("cookies", "movies", "pies", "ties", "zombies", "brownies", "smoothies")
STOP = "the a an is are in image there any of to and it its do does how many with on at or than this that have has".split()
NO_ISSUE = "no issues, it matches the prompt.\nCorrection: looks good."


def singular_ie(noun: Column) -> Column:
    """Singular of a noun's last word, which knows plurals on -ie. Not the rule of lexicon.singular."""
    last, n = F.regexp_extract(noun, r"(\S+)$", 1), F.length(noun)
    cut = lambda k: F.substring(noun, F.lit(1), n - k)
    return (
        F.when(F.array_contains(F.array(*map(F.lit, IE_PLURALS)), last), cut(1)).when(F.endswith(last, F.lit("ies")) & (F.length(last) > 4), F.concat(cut(3), F.lit("y")))
        .when(last.rlike("(ss|ch|sh|x)es$"), cut(2)).when(last.rlike("s$") & ~last.rlike("(ss|us)$"), cut(1)).otherwise(noun)
    )


def is_no(answer: Column) -> Column:
    return F.lower(F.trim(answer)) == "no"


def _part(q: Column, pattern: str, group: int = 1) -> Column:
    return F.when(q.rlike(pattern), F.regexp_extract(q, pattern, group))


def nouns(vqa: Column) -> Column:
    """Plural nouns of count questions and of object questions that are not negated."""
    named = F.transform(vqa, lambda x: F.coalesce(_part(x["q"], COUNT), F.when(~is_no(x["a"]), _part(x["q"], OBJECT))))
    return F.array_distinct(F.filter(named, lambda n: n.isNotNull()))


def expected_count(vqa: Column, noun: Column) -> Column:
    """The answer of the noun's last count question; null without one."""
    return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(vqa, lambda x: _part(x["q"], COUNT) == noun), lambda x: x["a"])), -1)


def with_count(count: Column, plural: Column) -> Column:
    return F.when(count == "one", F.concat(F.lit("one "), singular_ie(plural))).otherwise(F.concat(count, F.lit(" "), plural))


def split_subject(rest: Column, known: Column) -> Column:
    """(subject, predicate): the longest known noun, plural or singular, that begins the rest; else its first word."""
    forms = F.filter(F.concat(known, F.transform(known, singular_ie)), lambda n: F.startswith(rest, F.concat(n, F.lit(" "))))
    best = F.array_max(F.transform(forms, lambda n: F.struct(F.length(n).alias("size"), n.alias("noun"))))["noun"]
    subject = F.coalesce(best, F.regexp_extract(rest, r"^([^ ]*)", 1))
    return F.struct(subject.alias("subject"), F.substr(rest, F.length(subject) + 2).alias("predicate"))


def atom_critique(x: Column, vqa: Column, known: Column) -> Column:
    """(issue, fix) of one failed question."""
    q, a = x["q"], x["a"]
    counted, thing, verb = _part(q, COUNT), _part(q, OBJECT), F.lower(_part(q, BE))
    s = split_subject(_part(q, BE, 2), known)
    said, pred = F.concat(F.lit("the "), s["subject"], F.lit(" "), verb), s["predicate"]
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    pair = lambda issue, fix: F.struct(issue.alias("issue"), fix.alias("fix"))
    exact, want = with_count(a, counted), expected_count(vqa, thing)
    fix = F.when(x["skill"] == "position", text("move the ", s["subject"], " so that ", F.when(verb == "is", "it is").otherwise("they are"), " ", pred)).when(x["skill"] == "verb", text("show the ", s["subject"], " ", pred)).otherwise(text("make the ", s["subject"], " ", pred))
    return (
        F.when(counted.isNotNull(), pair(text("the image does not show exactly ", exact), text("make sure there ", F.when(a == "one", "is").otherwise("are"), " exactly ", exact)))
        .when(thing.isNotNull() & is_no(a), pair(text("the image shows ", thing, ", which the prompt excludes"), text("remove the ", thing)))
        .when(thing.isNotNull(), pair(text("there are no ", thing, " in the image"), text("add ", F.coalesce(with_count(want, thing), thing))))
        .when((pred != "") & is_no(a), pair(text(said, " ", pred), text("make sure the ", s["subject"], " ", verb, " not ", pred)))
        .when(pred != "", pair(text(said, " not ", pred), fix))
        .otherwise(pair(text("the image does not satisfy: ", q), text('change the image so that the answer to "', q, '" is ', a)))
    )


def failed(vqa: Column, threshold: float) -> Column:
    """Questions under the threshold, in the order of skills; a missing object's count question is left out."""
    low = F.filter(vqa, lambda x: x["p"] < threshold)
    missing = F.transform(F.filter(low, lambda x: x["q"].rlike(OBJECT) & ~is_no(x["a"])), lambda x: F.regexp_extract(x["q"], OBJECT, 1))
    low = F.filter(low, lambda x: ~(x["q"].rlike(COUNT) & F.array_contains(missing, F.regexp_extract(x["q"], COUNT, 1))))
    place = lambda s: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SKILL_ORDER)), s), F.lit(0)), F.lit(len(SKILL_ORDER) + 1))
    ranked = F.array_sort(F.transform(low, lambda x, i: F.struct(place(x["skill"]).alias("r"), i.alias("i"), x.alias("x"))))
    return F.transform(ranked, lambda r: r["x"])


def oracle_critique(vqa: Column, threshold: float) -> Column:
    """The critique that names exactly the failed questions; the fixed one if none failed."""
    known = nouns(vqa)
    parts = F.transform(failed(vqa, threshold), lambda x: atom_critique(x, vqa, known))
    some = F.exists(vqa, lambda x: x["p"] < threshold)
    return F.when(~some, NO_ISSUE).otherwise(F.concat(F.array_join(parts["issue"], ", and "), F.lit("\nCorrection: "), F.array_join(parts["fix"], ", and ")))


def failed_terms(vqa: Column, threshold: float) -> Column:
    """Words that a critique of the failed questions should name."""
    known = nouns(vqa)
    words = lambda t: F.filter(F.regexp_extract_all(F.lower(t), F.lit("[a-z]+"), F.lit(0)), lambda w: ~F.array_contains(F.array(*map(F.lit, STOP)), w))

    def terms(x: Column) -> Column:
        noun, s = F.coalesce(_part(x["q"], COUNT), _part(x["q"], OBJECT)), split_subject(_part(x["q"], BE, 2), known)
        both = lambda n: F.array(n, singular_ie(n))
        return F.when(noun.isNotNull(), both(noun)).when(x["q"].rlike(BE), F.concat(both(s["subject"]), words(s["predicate"]))).otherwise(words(x["q"]))

    every = F.flatten(F.transform(F.filter(vqa, lambda x: x["p"] < threshold), terms))
    return F.array_sort(F.array_distinct(F.transform(F.filter(every, lambda t: t != ""), F.lower)))


def grounded(text: Column, terms: Column) -> Column:
    """Whether a critique names one of the terms: a word as a word, a phrase anywhere."""
    own = F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))
    return F.arrays_overlap(own, terms) | F.exists(terms, lambda t: F.contains(t, F.lit(" ")) & F.contains(F.lower(text), t))


def answer_variants(question: Column, answer: Column) -> Column:
    """Spellings whose probabilities count for an answer."""
    cap = F.concat(F.upper(F.substring(answer, 1, 1)), F.lower(F.substr(answer, F.lit(2))))
    place = F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), F.lower(answer))
    digit = F.when(place > 0, (place - 1).cast("string")).otherwise("other")
    sp = lambda c: F.concat(F.lit(" "), c)
    fixed = lambda *w: F.array(*map(F.lit, w))
    return F.when(F.startswith(question, F.lit("How many")), F.array(answer, cap, sp(answer), sp(cap), digit, sp(digit))).when(is_no(answer), fixed("No", "no", " no", " No")).otherwise(fixed("Yes", "yes", " yes", " Yes"))


def refine_reward(child: Column, parent: Column, gm_child: Column, gm_parent: Column, alpha: float, threshold: float, weight: float) -> Column:
    """Score of a child less its parent's, with the parent's passed questions weighted in the arithmetic part."""
    delta = F.zip_with(child, parent, lambda c, p: F.when(p >= threshold, weight).otherwise(1.0) * (c - p))
    return F.lit(alpha) * F.aggregate(delta, F.lit(0.0), lambda s, x: s + x) / F.size(child) + F.lit(1 - alpha) * (gm_child - gm_parent)
