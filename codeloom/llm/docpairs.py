"""Functions paired with their own documentation.

Method: comment spans and function spans are extracted independently; an as-of join on the
place in the file gives each function the nearest documentation comment before it, and a
comment with other statements between is rejected. For Python, where the docstring stands in
the body, the place is the start of the body.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.functions.keys import plain_key
from codeloom.sources.spans import LANGUAGES, spans

SPANS = "path string, lang string, is_fn boolean, tok int, pos int, line int, name string, body string"

# Texts that stand in for a documentation, without case and punctuation.
FILLERS = {
    "todo", "fixme", "xxx", "tbd", "tba", "tbc", "wip", "hack", "na", "n a", "none", "nil", "null", "nothing", "empty", "missing", "undocumented", "unknown", "placeholder", "stub",
    "doc", "docs", "documentation", "docstring", "comment", "comments", "description", "summary", "missing docs", "docs missing", "doc missing", "missing docstring", "documentation missing",
    "docs go here", "doc goes here", "docs here", "documentation goes here", "documentation here", "description goes here", "description here", "insert description here", "insert docs here",
    "text goes here", "comment goes here", "add docs", "add documentation", "add description", "add docstring", "write docs", "write me", "fill in", "fill me in", "to do", "to be done", "to be written", "to be documented", "to be added", "to be defined", "to be determined", "coming soon", "lorem ipsum", "see above", "see code", "self explanatory",
    "no description", "no documentation", "no docs", "no doc", "no docstring", "no comment", "no comments", "no summary", "no description available", "no documentation available", "no description provided", "no documentation provided", "no docs yet", "no description yet", "no documentation yet", "not documented", "not documented yet", "not yet documented",
    "auto generated", "autogenerated", "auto generated stub", "autogenerated stub", "auto generated method stub", "autogenerated method stub", "auto generated code", "auto generated documentation", "auto generated docs", "auto generated docstring", "auto generated by tool", "auto generated do not edit", "generated", "generated code", "generated stub", "generated method stub", "generated automatically", "automatically generated", "this was generated", "this stub was generated automatically", "this method was generated automatically", "this function was generated automatically", "this method is generated", "this function is generated", "code generated do not edit", "do not edit", "generated by tool", "generated by script",
}
# Marks after which a short remark about documentation still is a filler.
_MARK = re.compile(r"^(?:todo|fixme|xxx|tbd|hack|wip)\b\s*(?:\([^)]*\))?\s*[:\-–—.]?\s*", re.I)
_MARK_REST = re.compile(r"^(?:(?:please |to )?(?:write|add|fill|document|describe|complete|finish|update|fix|explain|provide|improve|supply)\b.{0,40}|.{0,24}\b(?:docs?|documentation|docstring|description|comment|summary)\b.{0,16}|this|me|later|\W*)$", re.I)
_GENERATED = re.compile(r"^(?:this (?:code|file|method|function|stub|comment|docstring|documentation) (?:was|is|has been) )?(?:auto(?:matically)?[- ]?)?generated\b(?: (?:stub|code|method|function|docs?|documentation|docstring|comment|constructor|from (?:the )?\w+|by (?:the )?[\w.-]+|automatically))*(?:[,;]? do not (?:edit|modify|change))?$", re.I)
_NOTHING = re.compile(r"^(?:there (?:is|are) )?(?:no|without|missing|lacks?)(?: (?:any|a|further|proper|real|more))? (?:docs?|documentation|docstring|description|comment|comments|summary|text|details|information)(?: (?:yet|here|available|provided|given|needed|necessary|required|so far|at the moment|for this (?:function|method)))*$", re.I)
_ARTICLES = {"a", "an", "the"}
# Tags whose text is the documentation itself.
_TEXT_TAGS = {"description", "desc", "summary", "brief", "remarks", "details", "note", "deprecated", "remark"}


def comment_text(raw: str, lang: str) -> str:
    """The words of a comment or docstring without its marks."""
    s = raw
    if lang == "python":
        m = re.match(r"(?i)^([rbuft]{0,3})('''|\"\"\"|'|\")", s)
        if not m or set(m[1].lower()) & {"b", "f", "t"}:
            return ""
        s = s[m.end() :]
        s = s[: -len(m[2])] if s.endswith(m[2]) else s
        return s
    if s.startswith("/*"):
        s = re.sub(r"^/\*+|\*+/$", "", s)
        return "\n".join(re.sub(r"^\s*\*+(?!/) ?", "", x) for x in s.split("\n"))
    lines = [re.sub(r"^\s*///? ?", "", x) for x in s.split("\n")]
    if lang == "go":
        lines = [x for x, y in zip(lines, s.split("\n")) if not re.match(r"^\s*//(?:go|line|export|nolint)\b:?\S", y)]
    return "\n".join(lines)


def documentation(text: str, lang: str) -> str:
    """Its text without tags and markup; blank if there is nothing else."""
    if lang == "csharp":
        text = re.sub(r"(?is)<(param|typeparam|returns|exception|value|seealso)\b[^>]*?(?:/>|>.*?</\1>)", " ", text)
    text = re.sub(r"<!--.*?-->|</?[A-Za-z][^<>]*>", " ", text, flags=re.S)
    text = re.sub(r"\{@(?:inheritDoc|docRoot)\}", " ", text, flags=re.I)
    kept, tagged = [], False
    for line in text.split("\n"):
        t = line.strip()
        if lang != "python" and (m := re.match(r"^[@\\]([A-Za-z]+)\b[ \t]*(.*)$", t)):
            tagged = m[1].lower() not in _TEXT_TAGS
            t = "" if tagged else m[2]
        elif m := re.match(r"^:([A-Za-z]+)\b[^:]*:(.*)$", t):
            tagged = True
            t = ""
        elif not t:
            tagged = tagged and lang != "python"
        elif tagged:
            t = ""
        if re.match(r"^(?:#{1,6}\s.*|[=\-~*_#+^`.\s|/]*|(?:args|arguments|parameters|params|returns?|raises|yields|examples?|notes?|attributes|throws)\s*:?)$", t, re.I):
            t = ""
        kept.append(t)
    return re.sub(r"\s+", " ", " ".join(kept)).strip()


def name_words(name: str) -> set[str]:
    """The words of an identifier in lower case."""
    return {w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\d_A-Z]+|\d+", name)}


def is_trivial(doc: str, name: str) -> bool:
    """Blank, a filler, or nothing but the words of the function's name and articles."""
    words = re.findall(r"[^\W_]+", doc)
    if not words:
        return True
    flat = " ".join(words).lower()
    bare = doc.strip(" .!…-_*`'\"()[]:;,")
    if flat in FILLERS or _GENERATED.match(re.sub(r"\s+", " ", bare)) or _NOTHING.match(bare):
        return True
    m = _MARK.match(bare)
    if m and (_MARK_REST.match(bare[m.end() :]) or " ".join(re.findall(r"[^\W_]+", bare[m.end() :])).lower() in FILLERS):
        return True
    own = name_words(name)
    text = {w for part in words for w in name_words(part)}
    return (text - _ARTICLES) <= own or flat.replace(" ", "") == name.replace("_", "").lower()


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = [c.split()[0] for c in SPANS.split(", ")]
    for batch in batches:
        rows = []
        for path, lang, content in zip(batch["path"], batch["lang"], batch["content"]):
            comments, functions = spans(content or "", lang or "")
            rows += [(path, lang, False, c.tok, c.pos, c.end_line, None, c.text) for c in comments]
            rows += [(path, lang, True, f.tok, f.pos, f.line, f.name, f.code) for f in functions]
        yield pd.DataFrame(rows, columns=cols)


def source_spans(files: DataFrame) -> DataFrame:
    """Comment and function spans of files(path, prog_lang, content, read_at).

    Of rows with one path the one read last holds (at equal times the greater content). Rows
    without path are left out; the language is that of the extension, else prog_lang; null,
    empty and unreadable texts have no spans.
    """
    latest = files.select(plain_key(F.col("path")).alias("path"), "read_at", "content", F.lower(F.trim("prog_lang")).alias("given")).where("path is not null")
    latest = latest.groupBy("path").agg(F.max(F.struct("read_at", "content", "given")).alias("m")).select("path", "m.content", "m.given")
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    known = table[F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))]
    return latest.select("path", F.coalesce(known, "given").alias("lang"), "content").mapInPandas(_extract, SPANS)


def attach_comments(rows: DataFrame) -> DataFrame:
    """(path, name, lang, code, comment): as-of join of the spans of source_spans.

    The nearest comment at or before a function's place counts if no statement stands between
    (equal numbers of significant tokens); in Go it must also end on the line before.
    """
    w = W.partitionBy("path").orderBy("pos", "is_fn").rowsBetween(W.unboundedPreceding, W.currentRow)
    near = F.last(F.when(~F.col("is_fn"), F.struct("tok", "line", "body")), ignorenulls=True).over(w)
    joined = rows.withColumn("near", near).where("is_fn and near.tok = tok and (lang <> 'go' or near.line + 1 = line)")
    return joined.select("path", "name", "lang", F.col("body").alias("code"), F.col("near.body").alias("comment"))


def documented_functions(files: DataFrame) -> DataFrame:
    """(fn_id, code, doc): code and documentation of every function whose documentation isn't trivial."""
    schema = "fn_id string, code string, doc string"

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, name, lang, code, comment in zip(b["path"], b["name"], b["lang"], b["code"], b["comment"]):
                doc = documentation(comment_text(comment, lang), lang)
                if not is_trivial(doc, name):
                    rows.append((f"{path}::{name}", code, doc))
            yield pd.DataFrame(rows, columns=["fn_id", "code", "doc"])

    return attach_comments(source_spans(files)).mapInPandas(keep, schema)


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return documented_functions(spark.read.parquet(f"{root}/source_files.parquet")).select("fn_id").distinct()


def p2_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Code and documentation of every documented function."""
    return documented_functions(spark.read.parquet(f"{root}/source_files.parquet"))
