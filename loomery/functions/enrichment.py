"""Checks of captions and critiques that a model rewrote with measured facts, and of the objects it named: the first reason, or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomery.functions import curation, facts

# Wordings that a rewrite must not bring in, words that name no object, kinds.
AFTERTHOUGHT = r"(?i)\b(?:totaling|totalling|a total of|in total|in number|specifically|namely|in particular|one of (?:the )?(?:two|three|four|five|six|seven|eight|nine|ten))\b"
GLUE = r"(?i)\b(?:keep(?:ing|s)?|while|as described|indeed|remains?|remaining|still|already|intact|unchanged|as well|also)\b"
QUOTED = "\"([^\"]+)\""
NAME = "^[a-z][a-z' -]{0,40}$"
NO_OBJECTS = (
    "wall floor ceiling sky ground grass snow water sea ocean river lake field road street sidewalk background foreground room kitchen bedroom scene view landscape area light shadow sunlight cloud clouds fog mist forest mountain mountains "
    "hill hills beach sand dirt soil air smoke fire image photo human face head hair eye eyes nose mouth ear hand hands arm leg foot beard body clothing shirt jacket coat trousers pants jeans shorts dress skirt sweater hat cap helmet "
    "glasses shoe shoes boot boots belt ring watch tie scarf glove gloves bag backpack suit pavement path lawn countertop tabletop"
).split()


def words(text: Column) -> Column:
    return F.size(F.split(F.trim(text), r"\s+"))


def _quotes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1))


def _lost_quote(new: Column, original: Column) -> Column:
    return F.exists(_quotes(original), lambda q: ~F.contains(new, q))


def _lost_relation(new: Column, original: Column) -> Column:
    return F.exists(facts.relation_phrases(original), lambda p: ~F.contains(F.lower(new), p))


def _leaks(pattern: str, new: Column, original: Column) -> Column:
    return new.rlike(pattern) & ~original.rlike(pattern)


def caption_reason(new: Column, original: Column, fact_text: Column, used: Column, least: float = 0.6, added: int = 30, dropped: int = 1, foreign: int = 3) -> Column:
    """Why a caption rewritten with facts is turned down. An "exactly" before a number, which facts are worded with, is taken out first."""
    tidy = facts.strip_exactly(original, F.trim(F.regexp_replace(new, r"\s+", " ")))
    return (
        F.when(F.coalesce(tidy, F.lit("")) == "", "missing").when(tidy.contains("<image>") | tidy.rlike(curation.SECTION), "marker").when(curation.covers(original, F.array(tidy)) < least, "coverage")
        .when(words(tidy) > words(original) + added, "growth").when(F.size(facts.dropped_words(original, tidy)) > dropped, "dropped").when(_leaks("(?i)exactly", tidy, original), "exactly")
        .when(_leaks(AFTERTHOUGHT, tidy, original), "afterthought").when(F.size(facts.foreign_words(tidy, F.concat_ws(" ", original, fact_text))) > foreign, "foreign").when(_lost_quote(tidy, original), "quote")
        .when(_lost_relation(tidy, original), "relation").when(facts.new_digits(original, tidy), "digits").when(used < 1, "unused")
    )


def critique_reason(new: Column, original: Column, fact_text: Column, value: Column, noun: Column, least: float = 0.6, added: int = 15) -> Column:
    """Why a critique rewritten with facts is turned down: it keeps all of the original and only says facts about objects it names."""
    tidy = facts.strip_exactly(original, F.trim(F.regexp_replace(new, r"\s+", " ")))
    many = lambda text, pattern: F.regexp_count(text, pattern)
    own = F.concat(F.lit(r"(?i)\b"), value, F.lit(r"\b"))
    said = lambda text: F.regexp_extract_all(F.lower(text), F.lit("[a-z]+(?:'[a-z]+)?"), F.lit(0))
    forms = F.array(noun, facts.pluralize(noun))
    return (
        F.when(F.coalesce(tidy, F.lit("")) == "", "missing").when(curation.covers(original, F.array(tidy)) < least, "coverage").when(words(tidy) > words(original) + added, "growth")
        .when(F.size(facts.dropped_words(original, tidy)) > 0, "dropped").when(_leaks("(?i)exactly", tidy, original), "exactly").when(F.size(facts.foreign_words(tidy, F.concat_ws(" ", original, fact_text))) > 0, "foreign")
        .when((many(original, own) > 0) & (many(tidy, own) > many(original, own)), "repeated").when(many(tidy, F.lit(GLUE)) > many(original, F.lit(GLUE)), "glue")
        .when(F.arrays_overlap(forms, said(tidy)) & ~F.arrays_overlap(forms, said(original)), "new_object").when(_lost_quote(tidy, original), "quote").when(_lost_relation(tidy, original), "relation").when(facts.new_digits(original, tidy), "digits")
    )


def objects(names: Column, most: int = 10) -> Column:
    """Distinct nouns that can be placed, of the first `most` named, in order."""
    tidy = F.transform(F.slice(names, 1, most), lambda n: F.trim(F.regexp_replace(F.lower(n), r"\s+", " ")))
    return F.array_distinct(F.filter(tidy, lambda n: n.rlike(NAME) & ~F.arrays_overlap(F.split(n, " "), F.array(*map(F.lit, NO_OBJECTS)))))


def plural_of(name: Column, said: Column) -> Column:
    """The plural that was said if it is a regular or a known irregular one, else the regular one."""
    regular = F.array(facts.pluralize(name), F.concat(name, F.lit("s")), F.concat(name, F.lit("es")), F.coalesce(facts.irregular_plural(name), F.lit("")))
    return F.when(F.array_contains(regular, said), said).otherwise(facts.pluralize(name))


def absents(names: Column, there: Column, caption: Column, most: int = 3) -> Column:
    """Up to `most` absent things that are no object and not in the caption."""
    tidy = F.transform(names, lambda n: F.trim(F.regexp_replace(F.lower(n), r"\s+", " ")))
    return F.slice(F.filter(tidy, lambda n: n.rlike(NAME) & ~F.array_contains(there, n) & ~F.contains(F.lower(caption), n)), 1, most)
