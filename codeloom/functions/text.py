"""Scalar functions on names and texts, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes in the order they are tried, with the letters that must remain.
SUFFIXES = [
    ("tion", 3), ("sion", 3), ("ing", 3), ("ment", 3), ("ness", 3), ("able", 3), ("ible", 3), ("ized", 3), ("ise", 3), ("ize", 3),
    ("ous", 3), ("ful", 3), ("less", 4), ("ity", 3), ("ed", 3), ("er", 3), ("es", 3), ("ly", 3), ("s", 4),
]
# Words left out of free text.
STOP_WORDS = [
    "a", "an", "the", "and", "or", "for", "to", "in", "of", "on", "at", "is", "it", "by", "be", "as", "do", "if", "no", "up", "so", "my",
    "new", "get", "set", "def", "self", "this", "that", "from", "with",
]
# Phrases by which a user corrects.
CORRECTIONS = ["no ", "no,", "don't", "dont", "stop", "wrong", "instead", "not that", "undo", "revert", "why did you", "that's not"]
# Fixed value: commands that run tests.
VERIFICATION = r"\b(pytest|py\.test|npm\s+test|cargo\s+test|go\s+test|dotnet\s+test|jest|vitest|mocha)\b"


# Marks that part the words of a name, and places within it where a word begins.
NAME_MARKS = r"[_\-./]+"
NAME_HUMPS = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


def split_identifier(c: Column) -> Column:
    """Lower-case words of a snake, camel, kebab or dotted name; null and empty names have none."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), NAME_MARKS, " ")
    s = F.regexp_replace(s, NAME_HUMPS, " ")
    return F.filter(F.split(F.lower(s), r"\s+"), lambda w: w != "")


def stem(word: Column) -> Column:
    """A word without the first listed suffix that leaves enough letters."""
    out = None
    for suffix, least in SUFFIXES:
        hit = word.endswith(suffix) & (F.length(word) - len(suffix) >= least)
        cut = F.substring(word, F.lit(1), F.length(word) - len(suffix))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(word)


def tokenize(c: Column) -> Column:
    """Stemmed words of free text without stop words."""
    words = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))
    parts = F.flatten(F.transform(words, split_identifier))
    return F.transform(F.filter(parts, lambda w: ~w.isin(STOP_WORDS)), stem)


def name_stems(c: Column) -> Column:
    return F.array_distinct(F.transform(split_identifier(c), stem))


def function_tokens(name: Column, params: Column, return_type: Column, docstring: Column) -> Column:
    """Searchable tokens of a function: name, parameter names and hints, return type, docstring."""
    empty = F.array().cast("array<string>")
    of_params = F.flatten(F.transform(F.coalesce(params, F.array().cast("array<struct<name:string,type_hint:string,default_value:string>>")), lambda p: F.concat(split_identifier(p["name"]), split_identifier(p["type_hint"]))))
    return F.array_distinct(F.concat(F.transform(F.concat(split_identifier(name), of_params, split_identifier(return_type)), stem), F.coalesce(tokenize(docstring), empty)))


def signature(params: Column, return_type: Column) -> Column:
    """(a: T, b) -> R, without the parts that are missing."""
    one = F.transform(F.coalesce(params, F.array().cast("array<struct<name:string,type_hint:string,default_value:string>>")), lambda p: F.concat(p["name"], F.when(F.coalesce(p["type_hint"], F.lit("")) != "", F.concat(F.lit(": "), p["type_hint"])).otherwise("")))
    return F.concat(F.lit("("), F.array_join(one, ", "), F.lit(")"), F.when(F.coalesce(return_type, F.lit("")) != "", F.concat(F.lit(" -> "), return_type)).otherwise(""))


def one_liner(c: Column, limit: int = 140) -> Column:
    """Text on one line, cut to `limit` characters with an ellipsis."""
    s = F.regexp_replace(F.trim(c), r"\s+", " ")
    return F.when(F.length(s) > limit, F.concat(F.substring(s, 1, limit - 1), F.lit("…"))).otherwise(s)


def is_test_path(c: Column) -> Column:
    return F.lower(c).rlike(r"tests?/|test_|conftest\.py")


def zone_of_path(c: Column) -> Column:
    """First directory below the project, or the stem of a file directly in it."""
    parts = F.split(c, "/")
    return F.when(F.size(parts) > 2, F.element_at(parts, 2)).otherwise(F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", ""))


def cyrillic_share(c: Column) -> Column:
    """Cyrillic letters over all characters; null for null and empty texts."""
    return F.try_divide(F.length(F.regexp_replace(c, "[^Ѐ-ӿ]", "")).cast("double"), F.length(c).cast("double"))


def round_half_up(c: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d, which both engines compute alike."""
    k = float(10**digits)
    return F.floor(c * k + 0.5) / k


def looks_like_correction(c: Column) -> Column:
    low = F.lower(c)
    out = F.lit(False)
    for phrase in CORRECTIONS:
        out = out | low.contains(phrase)
    return out


def tool_class(name: Column, command: Column) -> Column:
    """modification, verification (a test command) or exploration."""
    return F.when(name.isin("Write", "Edit", "MultiEdit"), "modification").when((name == "Bash") & command.rlike(VERIFICATION), "verification").otherwise("exploration")


def score_label(v: Column) -> Column:
    return F.when(v >= 0.8, "good").when(v >= 0.6, "ok").when(v >= 0.4, "weak").otherwise("poor")
