"""Short texts made of and taken from other texts, all inside the JVM.

Null texts count as empty unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a wish to create something looks like, and words that only introduce it.
CREATION = r"(?i)(?<![A-Za-z0-9_])(add|create|implement|write|build|make|introduce|new)(?![A-Za-z0-9_]).*(?<![A-Za-z0-9_])(function|method|class|module|endpoint|route|handler|component|service)(?![A-Za-z0-9_])"
NOISE = r"(?i)(?<![A-Za-z0-9_])(please|can you|could you|i need to|i want to)(?![A-Za-z0-9_])"
_PARAMS = "array<struct<name:string,type_hint:string,default_value:string>>"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def clip(c: Column, most: int) -> Column:
    """A text of at most `most` characters; a longer one ends in three dots."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def signature_key(params: Column) -> Column:
    """name:type of every parameter joined by commas, ? for a missing type."""
    xs = F.coalesce(params, F.array().cast(_PARAMS))
    return F.array_join(F.transform(xs, lambda p: F.concat(p["name"], F.lit(":"), F.when(_text(p["type_hint"]) == "", "?").otherwise(p["type_hint"]))), ",")


def definition_line(name: Column, params: Column, return_type: Column, is_async: Column) -> Column:
    """async def name(a: T) -> R: as a provider of intents is shown a function."""
    from codeloom.functions.text import signature

    return F.concat(F.when(F.coalesce(is_async, F.lit(False)), "async def ").otherwise("def "), name, signature(params, return_type), F.lit(":"))


def param_summary(params: Column) -> Column:
    """name=default of the parameters that have a default, each default clipped to 60 characters."""
    xs = F.filter(F.coalesce(params, F.array().cast(_PARAMS)), lambda p: p["default_value"].isNotNull())
    return F.array_join(F.transform(xs, lambda p: F.concat(p["name"], F.lit("="), clip(p["default_value"], 60))), ", ")


def call_literals(expression: Column) -> Column:
    """Quoted strings without escapes, then bare integers, of a call's expression."""
    quoted = F.regexp_extract_all(_text(expression), F.lit(r"""("[^"\\\n]*"|'[^'\\\n]*')"""), F.lit(1))
    bare = F.regexp_replace(_text(expression), r"""("[^"\\\n]*"|'[^'\\\n]*')""", " ")
    numbers = F.regexp_extract_all(bare, F.lit(r"(?<![A-Za-z0-9_.])(-?[0-9]+)(?![A-Za-z0-9_.])"), F.lit(1))
    return F.concat(F.transform(quoted, lambda q: F.substring(q, F.lit(2), F.length(q) - 2)), numbers)


def canonical_value(value: Column, values: Column) -> Column:
    """A value as it is, a list as its sorted JSON list."""
    return F.coalesce(value, F.when(F.size(values) > 0, F.to_json(F.array_sort(values))))


def embed_text(*parts: str) -> Column:
    """The parts that aren't empty, with a blank line between."""
    return F.array_join(F.filter(F.array(*[F.trim(F.col(p)) for p in parts]), lambda x: x.isNotNull() & (x != "")), "\n\n")


def fallback_message(files: Column, functions: Column) -> Column:
    """A commit message of the first four file names and three functions, clipped to 72 characters."""
    short = F.transform(F.slice(files, 1, 4), lambda f: F.element_at(F.split(f, "/"), -1))
    more = F.when(F.size(files) > 4, F.concat(F.lit(" (+"), F.size(files) - 4, F.lit(" more)"))).otherwise("")
    fns = F.when(F.size(functions) > 0, F.concat(F.lit(" | "), F.array_join(F.slice(functions, 1, 3), ", "))).otherwise("")
    return F.when(F.size(files) == 0, "wip: changes").otherwise(clip(F.concat(F.lit("wip: "), F.array_join(short, ", "), more, fns), 72))


def clean_intent(c: Column) -> Column:
    """The first sentence of a text without quotes around it, at most 200 characters."""
    s = F.regexp_replace(F.regexp_replace(_text(c), r"^[\s\"']+|[\s\"']+$", ""), r"(?s)^(.*?[.。\n]).*$", "$1")
    return clip(s, 200)


def creation_intent(c: Column) -> Column:
    """True where a text asks for new code on one line."""
    return _text(c).rlike(CREATION)


def intent_words(c: Column) -> Column:
    """The first 200 characters of a wish without its introduction."""
    return F.substring(F.trim(F.regexp_replace(_text(c), NOISE, "")), 1, 200)


def source_lines(content: Column, start: Column, end: Column) -> Column:
    """Lines start to end of a text, counted from 1; both are held within it."""
    lines = F.split(F.regexp_replace(content, "\r\n?", "\n"), "\n")
    a = F.greatest(start, F.lit(1))
    return F.slice(lines, a, F.greatest(F.least(end, F.size(lines)) - a + 1, F.lit(0)))


def head_and_tail(lines: Column, most: int = 200) -> Column:
    """Lines as a text; of more than `most` the first and last halves, with a mark between."""
    half = most // 2
    cut = F.concat(F.slice(lines, 1, half), F.array(F.lit("...")), F.slice(lines, F.size(lines) - half + 1, half))
    return F.array_join(F.when(F.size(lines) > most, cut).otherwise(lines), "\n")


def value_summary(name: Column, kind: Column, values: Column, functions: Column, files: Column) -> Column:
    """One line on a collection of values: its first six and where it is used."""
    n = F.size(values)
    shown = F.array_join(F.transform(F.slice(values, 1, 6), lambda v: F.concat(F.lit("'"), v, F.lit("'"))), ", ")
    more = F.when(n > 6, F.concat(F.lit(", … (+"), n - 6, F.lit(")"))).otherwise("")
    return F.concat(name, F.lit(": "), kind, F.lit(" of "), n, F.lit(" value(s) ["), shown, more, F.lit("]; referenced by "), functions, F.lit(" function(s) across "), files, F.lit(" file(s)."))


def class_summary(name: Column, start: Column, end: Column, methods: Column, attributes: Column, bases: Column) -> Column:
    tail = F.when(_text(bases) != "", F.concat(F.lit("; bases: "), F.regexp_replace(bases, ",", ", "))).otherwise("")
    return F.concat(name, F.lit(" (lines "), start, F.lit("-"), end, F.lit(") — "), methods, F.lit(" method(s), "), attributes, F.lit(" attribute(s)"), tail, F.lit("."))


def attribute_summary(name: Column, ctor: Column, annotation: Column) -> Column:
    return F.concat(name, F.lit(" — "), ctor, F.when(_text(annotation) != "", F.concat(F.lit("; annotation: "), annotation)).otherwise(""), F.lit("."))


def include_list(c: Column) -> Column:
    """Section names given as a JSON list, as names between commas, or as one name."""
    inner = F.regexp_replace(_text(c), r"[\[\]\"'\s]", "")
    return F.filter(F.split(inner, ","), lambda x: x != "")


def _codepage() -> tuple[str, str]:
    """The upper half of windows-1251 and the characters whose numbers are its bytes."""
    upper = [(bytes([b]).decode("cp1251", "ignore"), chr(b)) for b in range(128, 256)]
    return "".join(c for c, _ in upper if c), "".join(b for c, b in upper if c)


def repaired(c: Column) -> Column:
    """Text that was UTF-8 read as windows-1251, read rightly; any other text as it is."""
    chars, raw = _codepage()
    back = F.encode(F.translate(c, chars, raw), "ISO-8859-1").cast("string")
    whole = F.translate(c, chars, "").rlike(r"^[\x00-\x7F]*$") & c.rlike(r"[^\x00-\x7F]")
    return F.when(whole & F.is_valid_utf8(back), back).otherwise(c)


def version_numbers(c: Column) -> Column:
    """The numbers of a dotted version, which compare as versions do; [0] if one isn't a number."""
    parts = F.split(_text(c), r"\.")
    return F.when(F.forall(parts, lambda x: x.rlike(r"^[0-9]{1,9}$")), F.transform(parts, lambda x: x.try_cast("int"))).otherwise(F.array(F.lit(0)))


def safe_name(c: Column) -> Column:
    """A session id that can name a file: slashes, double dots and zero bytes become underscores; unknown if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.trim(_text(c)), r"[/\\\x00]", "_"), r"\.\.", "_")
    return F.when(s == "", "unknown").otherwise(s)


def session_file(started: Column, task_hash: Column, n: Column) -> Column:
    """date_hash.json, with a number from the second session of a day and task on."""
    return F.concat(F.date_format(started, "yyyy-MM-dd"), F.lit("_"), F.substring(task_hash, 1, 8), F.when(n > 1, F.concat(F.lit("_"), n - 1)).otherwise(""), F.lit(".json"))


def hunk_lines(diff: Column) -> Column:
    """array<struct<file, first, n>> of the lines that a unified diff without context adds or changes; +N alone is one line, +N,0 none."""
    lines = F.split(diff, "\n")
    start = F.struct(F.lit("").alias("file"), F.array().cast("array<struct<file:string,first:int,n:int>>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        file = F.when(line.startswith("+++ b/"), F.substring(line, 7, 1_000_000)).otherwise(acc["file"])
        first = F.regexp_extract(line, r"^@@ \S+ \+(\d+)", 1).try_cast("int")
        n = F.coalesce(F.regexp_extract(line, r"^@@ \S+ \+\d+,(\d+)", 1).try_cast("int"), F.lit(1))
        hit = line.startswith("@@ ") & first.isNotNull() & (n > 0) & (acc["file"] != "")
        row = F.struct(acc["file"].alias("file"), first.alias("first"), n.alias("n"))
        return F.struct(file.alias("file"), F.when(hit, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(lines, start, step)["out"]


def numstat(diff: Column) -> Column:
    """array<struct<file, added, removed>> of `git diff --numstat` lines; binary files count as 0."""
    rows = F.filter(F.transform(F.split(diff, "\n"), lambda x: F.split(x, "\t")), lambda p: (F.size(p) == 3) & p[0].rlike(r"^(\d+|-)$"))
    number = lambda x: F.coalesce(x.try_cast("int"), F.lit(0))
    return F.transform(rows, lambda p: F.struct(p[2].alias("file"), number(p[0]).alias("added"), number(p[1]).alias("removed")))
