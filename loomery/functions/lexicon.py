"""Word-level expressions: numbers in words, singulars and stems. Look-alike rules differ on purpose; don't merge them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words in order of their value, and irregular plurals.
NUMBER_WORDS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty").split()
IRREGULAR = {
    "people": "person", "men": "man", "women": "woman", "children": "child", "mice": "mouse", "geese": "goose", "teeth": "tooth", "feet": "foot",
    "knives": "knife", "leaves": "leaf", "wolves": "wolf", "shelves": "shelf", "loaves": "loaf", "calves": "calf", "scarves": "scarf",
}
# Suffixes of plurals, in the order in which they are tried.
SUFFIXES = {"ies": "y", "ches": "ch", "shes": "sh", "sses": "ss", "xes": "x", "zes": "z"}


def to_number(word: Column) -> Column:
    """Digits, or a word from zero to twenty; else null."""
    w = F.lower(word)
    return F.when(w.rlike("^[0-9]+$"), w.try_cast("int")).otherwise(F.array_position(F.array(*map(F.lit, NUMBER_WORDS)), w).cast("int") - 1).cast("int")


def number_of(word: Column) -> Column:
    n = to_number(word)
    return F.when(n >= 0, n)


def number_word(value: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, NUMBER_WORDS)), value), value.cast("string"))


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: a long rule names it many times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def singular(word: Column) -> Column:
    """Irregular words, then suffix rules in order, then a plain s; last, compounds of irregular words."""
    return let(F.regexp_replace(F.lower(word), r"^['\"]+|['\"]+$", ""), _singular)


def _singular(w: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in IRREGULAR.items() for x in pair))
    n = F.length(w)
    rule = F.when(F.element_at(table, w).isNotNull(), F.element_at(table, w))
    for end, new in SUFFIXES.items():
        rule = rule.when(F.endswith(w, F.lit(end)) & (n > len(end) + 1), F.concat(F.substring(w, F.lit(1), n - len(end)), F.lit(new)))
    rule = rule.when(w.rlike("s$") & ~w.rlike("(ss|us|is)$") & (n > 3), F.substring(w, F.lit(1), n - 1))
    for many, one in IRREGULAR.items():
        rule = rule.when(F.endswith(w, F.lit(many)), F.concat(F.substring(w, F.lit(1), n - len(many)), F.lit(one)))
    return rule.otherwise(w)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def prefix_stems(text: Column, size: int = 5) -> Column:
    """Distinct content words as prefixes of `size` letters."""
    return F.array_distinct(F.transform(F.filter(words(text), lambda w: F.length(w) > 2), lambda w: F.substring(w, 1, size)))


def coverage(source: Column, other: Column) -> Column:
    """Share of the source's stems that the other has; an empty source is covered."""
    return F.when(F.size(source) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(source, other)) / F.size(source))


def requested_objects(counts: Column) -> Column:
    """Sum of number words or digits; unknown words count nothing, and a sum of 0 is null."""
    return F.nullif(F.aggregate(counts, F.lit(0), lambda a, w: a + F.coalesce(number_of(w), F.lit(0))), F.lit(0))


def safe_name(text: Column, most: int = 80) -> Column:
    return F.substring(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), 1, most)
