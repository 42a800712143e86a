"""Facts of source texts in seven languages: functions, classes, imports, exports and calls.

All come from the tokens of spans.py, so text in strings and comments is never taken for code.
A language is an entry of PROFILES: how it writes parameters, return types, imports, classes
and exports. Broken texts give what can be read of them; unknown languages and null texts
give nothing.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame

from codeloom.sources.spans import Function, Token, _match, clean_source, spans, tokens

# Words that keep their name in a normalised function.
KEYWORDS = {
    "if", "else", "elif", "for", "while", "return", "def", "class", "import", "from", "try", "except", "finally", "with", "as", "yield", "raise", "break", "continue", "pass", "lambda",
    "and", "or", "not", "in", "is", "True", "False", "None", "async", "await", "function", "const", "let", "var", "new", "this", "super", "extends", "implements", "interface",
    "public", "private", "protected", "static", "void", "int", "float", "str", "bool", "list", "dict", "set", "tuple", "type", "struct", "fn", "pub", "mut", "self", "match", "enum", "trait",
}
_BRANCH = {"if", "elif", "for", "while", "except", "with", "catch", "case", "and", "or", "&&", "||", "?"}
_OPEN, _CLOSE = "([{<", ")]}>"


class Class(NamedTuple):
    name: str
    bases: str
    line: int
    end: int


class Import(NamedTuple):
    capture: str
    text: str
    line: int


class Call(NamedTuple):
    callee: str
    receiver: str | None
    line: int
    expression: str


@dataclass(frozen=True)
class Profile:
    """What tells a language's declarations apart; see the functions that read it."""

    name_first: bool = True  # a parameter's name stands before its type
    colon_types: bool = True  # and a colon between them
    class_words: frozenset = frozenset({"class", "interface", "enum"})
    import_words: frozenset = frozenset({"import"})
    export: str = "word"  # word: export or public or pub before it; capital: by its first letter; plain: no leading underscore
    marks: frozenset = field(default_factory=frozenset)  # the words of `export`


PROFILES = {
    "python": Profile(class_words=frozenset({"class"}), import_words=frozenset({"import", "from"}), export="plain"),
    "typescript": Profile(marks=frozenset({"export"})),
    "javascript": Profile(class_words=frozenset({"class"}), marks=frozenset({"export"})),
    "java": Profile(name_first=False, class_words=frozenset({"class", "interface", "enum", "record"}), marks=frozenset({"public"})),
    "csharp": Profile(name_first=False, class_words=frozenset({"class", "interface", "enum", "record", "struct"}), import_words=frozenset({"using"}), marks=frozenset({"public"})),
    "go": Profile(colon_types=False, class_words=frozenset({"struct", "interface"}), export="capital"),
    "rust": Profile(class_words=frozenset({"struct", "enum", "trait", "impl"}), import_words=frozenset({"use"}), marks=frozenset({"pub"})),
}
_MODIFIERS = {"final", "mut", "ref", "out", "in", "readonly", "public", "private", "protected", "params", "static", "async", "abstract", "override", "virtual", "export", "default", "unsafe", "sealed", "synchronized", "internal", "partial", "extern", "pub"}
#: Words that a bracket follows without a call.
_NO_CALLS = {"if", "for", "while", "switch", "catch", "return", "function", "def", "func", "fn", "class", "new", "elif", "with", "and", "or", "not", "in", "is", "lambda", "print_", "match", "case", "assert", "await", "yield", "throw", "super", "using", "lock", "foreach", "except", "else", "do", "try", "pub", "impl", "interface", "struct", "enum", "record", "trait", "typeof", "sizeof", "import", "export", "raise", "del"}


def code_of(text: str, lang: str) -> list[Token]:
    return [t for t in tokens(text, lang)[0] if t.kind != "comment"]


def complexity(ts: list[Token], lang: str) -> int:
    """One plus the branching words and boolean operators among a function's tokens."""
    n = 1
    for i, t in enumerate(ts):
        if t.kind in ("comment", "string"):
            continue
        n += t.text in _BRANCH and not (t.text == "?" and lang in ("typescript", "rust", "csharp"))
        n += t.text in "&|" and t.kind == "op" and i + 1 < len(ts) and ts[i + 1].text == t.text and ts[i + 1].start == t.end
    return n


def shape_hash(ts: list[Token], lang: str) -> str | None:
    """First 16 hex digits of the SHA-256 of a function's tokens without comments and docstrings, names numbered by first appearance; these hashes are this engine's own.

    The name of the function is one of the names, so a renamed copy has the same hash.
    """
    numbers: dict[str, int] = {}
    out: list[str] = []
    for i, t in enumerate(ts):
        if t.kind == "comment":
            continue
        if t.kind == "string" and lang == "python" and (i == 0 or ts[i - 1].text == ":") and (i + 1 == len(ts) or ts[i + 1].line > t.line):
            continue
        if t.kind == "ident" and t.text not in KEYWORDS:
            out.append(f"v{numbers.setdefault(t.text, len(numbers))}")
        else:
            out.append(t.text)
    return hashlib.sha256("\x1f".join(out).encode()).hexdigest()[:16] if out else None


def _text(ts: list[Token]) -> str:
    """Tokens as one text, with blanks where names would run together."""
    out = ""
    for a, b in zip(ts, ts[1:] + [None]):
        out += a.text
        if b is not None and (b.start > a.end or a.text == ",") and not (a.text in "([<.&*" or b.text in ")]>,.("):
            out += " "
    return out


def _split(ts: list[Token]) -> list[list[Token]]:
    parts, depth = [[]], 0
    for t in ts:
        if t.kind == "op":
            depth += (t.text in _OPEN) - (t.text in _CLOSE)
        if t.text == "," and depth == 0:
            parts.append([])
        else:
            parts[-1].append(t)
    return [p for p in parts if p]


def _until(ts: list[Token], marks: tuple[str, ...]) -> int:
    """Index of the first of marks outside brackets, or the length."""
    depth = 0
    for i, t in enumerate(ts):
        if t.kind == "op":
            if depth == 0 and t.text in marks:
                return i
            depth += (t.text in _OPEN) - (t.text in _CLOSE)
    return len(ts)


def header(ts: list[Token], name: str) -> tuple[int, int] | None:
    """Indexes of a function's parameter brackets (open, behind the closing one)."""
    at = next((i for i, t in enumerate(ts) if t.kind == "ident" and t.text == name), None)
    while at is not None and at < len(ts) and ts[at].text != "(":
        if ts[at].text == "<":
            depth = 0
            while at < len(ts):
                depth += (ts[at].text == "<") - (ts[at].text == ">")
                at += 1
                if not depth:
                    break
        elif ts[at].text == "[" and at + 1 < len(ts):
            at = _match(ts, at)
        elif ts[at].text in ("{", ";", "=>"):
            return None
        else:
            at += 1
    return None if at is None or at >= len(ts) else (at, _match(ts, at))


def parameters(ts: list[Token], name: str, lang: str) -> list[tuple[str, str | None, str | None]]:
    """(name, type, default) of a function's parameters; self, cls, this and starred ones are left out, Go names without a type have that of the next."""
    p = PROFILES[lang]
    span = header(ts, name)
    if span is None:
        at = next((i for i, t in enumerate(ts) if t.text == "=>"), 0)  # x => ...
        return [(ts[at - 1].text, None, None)] if at and ts[at - 1].kind == "ident" else []
    out: list[tuple[str, str | None, str | None]] = []
    for part in _split(ts[span[0] + 1 : span[1] - 1]):
        cut = _until(part, ("=",))
        default = _text(part[cut + 1 :]) or None
        part = part[:cut]
        if not part or part[0].text in ("*", "...", "&", "/", "{", "["):
            continue
        while len(part) > 1 and (part[0].text in _MODIFIERS or part[0].text == "@"):
            part = part[2:] if part[0].text == "@" else part[1:]
        if p.name_first:
            cut = _until(part, (":",)) if p.colon_types else 1
            head, kind = part[:cut], part[cut + 1 :] if p.colon_types else part[1:]
            names = [t.text for t in head if t.kind == "ident"]
        else:
            names = [t.text for t in part if t.kind == "ident"]
            names, kind = names[-1:], part[:-1]
        if names and names[0] not in ("self", "cls", "this"):
            out.append((names[0], _text(kind) or None, default))
    if lang == "go":
        last = None
        for i in range(len(out) - 1, -1, -1):
            last = out[i][1] or last
            out[i] = (out[i][0], last, out[i][2])
    return out


def return_type(ts: list[Token], name: str, lang: str) -> str | None:
    span = header(ts, name)
    if span is None:
        return None
    rest = ts[span[1] :]
    if lang == "python" or lang == "rust":
        if not rest or rest[0].text != "->":
            return None
        rest = rest[1:]
        stop = _until(rest, (":",)) if lang == "python" else next((i for i, t in enumerate(rest) if t.text in ("{", ";", "where")), len(rest))
        return _text(rest[:stop]) or None
    if lang in ("typescript", "javascript"):
        if not rest or rest[0].text != ":":
            return None
        rest = rest[1:]
        return _text(rest[: next((i for i, t in enumerate(rest) if t.text in ("{", ";", "=>")), len(rest))]) or None
    if lang == "go":
        return _text(rest[: next((i for i, t in enumerate(rest) if t.text == "{"), len(rest))]) or None
    at = next((i for i, t in enumerate(ts) if t.kind == "ident" and t.text == name), 0)
    head = [t for t in ts[:at] if t.text not in _MODIFIERS]
    return _text(head) or None


def classes_of(code: list[Token], text: str, lang: str) -> list[Class]:
    """Classes and what a language has in their place, with their bases and lines."""
    p, out = PROFILES[lang], []
    lines = text.split("\n")
    for i, t in enumerate(code):
        if t.kind != "ident" or t.text not in p.class_words or i + 1 >= len(code) or (i and code[i - 1].text == "."):
            continue
        if lang == "go":  # type Name struct {
            if not (i >= 2 and code[i - 2].text == "type" and code[i + 1].text == "{"):
                continue
            out.append(Class(code[i - 1].text, "", code[i - 2].line, code[_match(code, i + 1) - 1].line))
            continue
        nxt = code[i + 1]
        if lang == "rust" and t.text == "impl":
            stop = next((j for j in range(i, len(code)) if code[j].text in ("{", ";")), len(code))
            names = [x.text for x in code[i + 1 : stop] if x.kind == "ident" and x.text != "for"]
            if names and stop < len(code):
                out.append(Class(names[-1], "", t.line, code[_match(code, stop) - 1].line))
            continue
        if nxt.kind != "ident":
            continue
        if lang == "python":
            j = i + 2
            bases = ""
            if j < len(code) and code[j].text == "(":
                stop = _match(code, j)
                bases = ",".join(_text(x) for x in _split(code[j + 1 : stop - 1]) if _until(x, ("=",)) == len(x))
            indent = len(lines[t.line - 1]) - len(lines[t.line - 1].lstrip())
            end = t.line
            for x in code[i + 1 :]:
                row = lines[x.line - 1]
                if x.line > t.line and len(row) - len(row.lstrip()) <= indent and x.start == text.rfind("\n", 0, x.start) + 1 + (len(row) - len(row.lstrip())):
                    break
                end = x.line + x.text.count("\n")
            out.append(Class(nxt.text, bases, t.line, end))
            continue
        stop = next((j for j in range(i + 2, len(code)) if code[j].text in ("{", ";")), None)
        if stop is None:
            continue
        bases = ",".join(x.text for x in code[i + 2 : stop] if x.kind == "ident" and x.text not in ("extends", "implements", "where", "permits"))
        end = code[_match(code, stop) - 1].line if code[stop].text == "{" else code[stop].line
        out.append(Class(nxt.text, bases, t.line, end))
    return out


def imports_of(code: list[Token], lang: str) -> list[Import]:
    """Imported modules (imp.module) and names (imp.name), each once, in order."""
    p, out, i = PROFILES[lang], [], 0

    def quoted(t: Token) -> str:
        return t.text.strip("\"'`")

    while i < len(code):
        t = code[i]
        first = i == 0 or code[i - 1].line < t.line or code[i - 1].text == ";"
        if t.kind != "ident" or t.text not in p.import_words or not first:
            i += 1
            continue
        line = t.line
        if lang == "python":
            stop = i + 1
            while stop < len(code) and (code[stop].line == line or code[stop - 1].text in (",", "(", "\\")) and code[stop].text != ";":
                stop = _match(code, stop) if code[stop].text == "(" else stop + 1
            body = code[i + 1 : stop]
            if t.text == "from":
                k = next((j for j, x in enumerate(body) if x.text == "import"), len(body))
                out.append(Import("imp.module", "".join(x.text for x in body[:k]), line))
                body = [x for x in body[k + 1 :] if x.text not in "()"]
                out += [Import("imp.name", part[0].text, line) for part in _split(body) if part[0].kind == "ident"]
            else:
                out += [Import("imp.module", "".join(x.text for x in part[: next((j for j, x in enumerate(part) if x.text == "as"), len(part))]), line) for part in _split(body)]
        elif lang in ("typescript", "javascript"):
            stop = next((j for j in range(i + 1, len(code)) if code[j].kind == "string" or code[j].text == ";"), len(code) - 1)
            if code[stop].kind == "string" and (i + 1 >= len(code) or code[i + 1].text != "("):
                out.append(Import("imp.module", quoted(code[stop]), line))
                names = [x for x in code[i + 1 : stop] if x.kind == "ident" and x.text not in ("from", "type")]
                out += [Import("imp.name", x.text, line) for j, x in enumerate(names) if not (j and names[j - 1].text == "as") and x.text != "as"]
            stop += 1
        elif lang == "go":
            stop = i + 2
            if i + 1 < len(code) and code[i + 1].text == "(":
                stop = _match(code, i + 1)
            elif i + 1 < len(code) and code[i + 1].kind == "ident":
                stop = i + 3
            out += [Import("imp.module", quoted(x), x.line) for x in code[i + 1 : stop] if x.kind == "string"]
        else:
            stop = next((j for j in range(i + 1, len(code)) if code[j].text == ";"), len(code))
            body = [x for x in code[i + 1 : stop] if x.text not in ("static", "pub", "crate") or lang != "java"]
            eq = next((j for j, x in enumerate(body) if x.text == "="), None)
            body = body[eq + 1 :] if eq is not None else body
            if lang == "rust" and any(x.text == "{" for x in body):
                k = next(j for j, x in enumerate(body) if x.text == "{")
                out.append(Import("imp.module", "".join(x.text for x in body[:k]).removesuffix("::"), line))
                out += [Import("imp.name", x.text, line) for j, x in enumerate(body[k:]) if x.kind == "ident" and x.text not in ("self", "as")]
            elif body and not (lang == "csharp" and body[0].text in ("(", "var")):
                k = next((j for j, x in enumerate(body) if x.text == "as"), len(body))
                text = "".join(quoted(x) if x.kind == "string" else x.text for x in body[:k])
                out.append(Import("imp.module", text, line))
        i = max(stop, i + 1)
    return list({(x.capture, x.text): x for x in reversed(out)}.values())[::-1]


def calls_of(code: list[Token], text: str, lang: str, declared: set[int], most: int = 120) -> list[Call]:
    """Calls by name, with what stands before the last dot; the places in `declared` are declarations. Expressions are cut to `most` characters."""
    out = []
    for i, t in enumerate(code[:-1]):
        if t.kind != "ident" or code[i + 1].text != "(" or t.text in _NO_CALLS or t.start in declared:
            continue
        if i and code[i - 1].text in ("def", "func", "fn", "function", "class", "new", "record"):
            continue
        j, names = i, []
        while j >= 2 and code[j - 1].text in (".", "::", "?.") and code[j - 2].kind == "ident":
            names.append(code[j - 2].text)
            j -= 2
        if j and code[j - 1].text in (".", "::"):
            names.append("?")  # a call on a result
        start, end = code[j].start, code[_match(code, i + 1) - 1].end
        out.append(Call(t.text, ".".join(reversed(names)) if names else None, t.line, " ".join(text[start:end].split())[:most]))
    return out


class Facts(NamedTuple):
    functions: list[tuple]  # (Function, tokens, class name or None, docstring or None)
    classes: list[Class]
    imports: list[Import]
    calls: list[Call]
    exports: list[tuple[str, int]]


def facts(text: str, lang: str) -> Facts:
    """All facts of one file."""
    if lang not in PROFILES:
        return Facts([], [], [], [], [])
    text = clean_source(text)
    code = code_of(text, lang)
    comments, found = spans(text, lang)
    classes = classes_of(code, text, lang)
    p = PROFILES[lang]
    docs = {c.tok: c.text for c in comments} if lang == "python" else {}
    functions, declared, exports, seen, nested = [], set(), [], set(), {}
    starts = [t.start for t in code]
    for f in found:
        ts = [t for t in code if f.line <= t.line <= f.end] if lang == "python" else _inside(code, starts, f)
        own = next((t for t in ts if t.kind == "ident" and t.text == f.name), None)
        if own:
            declared.add(own.start)
        around = [c for c in classes if c.line <= f.line and f.end <= c.end]
        holder = max(around, key=lambda c: c.line).name if around else None
        functions.append((f, ts, holder, _docline(docs.get(f.tok))))
        if _exported(f.name, ts, own, p) and (lang != "python" or holder is None) and f.name not in seen:
            seen.add(f.name)
            exports.append((f.name, f.line))
    for c in classes:
        head = [t for t in code if t.line == c.line]
        if c.name not in seen and _exported(c.name, head, next((t for t in head if t.text == c.name), None), p):
            seen.add(c.name)
            exports.append((c.name, c.line))
    return Facts(functions, classes, imports_of(code, lang), calls_of(code, text, lang, declared), exports)


def _inside(code: list[Token], starts: list[int], f: Function) -> list[Token]:
    from bisect import bisect_left

    a = bisect_left(starts, f.pos)
    return code[a : bisect_left(starts, f.pos + len(f.code))]


def _docline(raw: str | None) -> str | None:
    """First line of a docstring."""
    if not raw:
        return None
    body = raw.lstrip("rRbBuUfF").strip("\"'").strip()
    return body.split("\n")[0].strip() or None


def _exported(name: str, ts: list[Token], own: Token | None, p: Profile) -> bool:
    if p.export == "plain":
        return not name.startswith("_")
    if p.export == "capital":
        return name[:1].isupper()
    before = [t.text for t in ts if own is None or t.start < own.start]
    return bool(p.marks & set(before))


FUNCTIONS = "path string, fn_name string, kind string, prog_lang string, line_start int, line_end int, line_count int, complexity int, params array<struct<name:string,type_hint:string,default_value:string>>, return_type string, is_async boolean, docstring string, class_name string, ast_hash string"


def _each(files: DataFrame, extract, schema: str) -> DataFrame:
    from codeloom.sources.scan import each_file

    return each_file(files, extract, schema)


def functions(files: DataFrame) -> DataFrame:
    """One row per function of files(path, prog_lang, content): span, parameters with types and defaults, return type, async flag, docstring (Python), enclosing class, complexity and shape hash; kind is method within a class, arrow for a function held by a variable, else function; of equal names in a file the first."""

    def extract(path: str, lang: str, text: str) -> list[tuple]:
        seen, rows = set(), []
        for f, ts, holder, doc in facts(text, lang).functions:
            if f.name in seen:
                continue
            seen.add(f.name)
            own = next((k for k, t in enumerate(ts) if t.text == f.name), 0)
            is_async = any(t.text == "async" for t in ts[: own + 3])
            params = [{"name": a, "type_hint": b, "default_value": c} for a, b, c in parameters(ts, f.name, lang)]
            arrow = own + 1 < len(ts) and ts[own + 1].text in ("=", ":") and lang in ("javascript", "typescript")
            rows.append((f.name, "method" if holder else "arrow" if arrow else "function", lang, f.line, f.end, f.end - f.line + 1, complexity(ts, lang), params, return_type(ts, f.name, lang), is_async, doc, holder, shape_hash(ts, lang)))
        return rows

    return _each(files, extract, FUNCTIONS)


def classes(files: DataFrame) -> DataFrame:
    return _each(files, lambda path, lang, text: [tuple(c) for c in facts(text, lang).classes], "path string, class_name string, bases string, line_start int, line_end int")


def imports(files: DataFrame) -> DataFrame:
    return _each(files, lambda path, lang, text: [tuple(x) for x in facts(text, lang).imports], "path string, capture string, text string, line int")


def exports(files: DataFrame) -> DataFrame:
    return _each(files, lambda path, lang, text: facts(text, lang).exports, "path string, name string, line int")


def calls(files: DataFrame) -> DataFrame:
    return _each(files, lambda path, lang, text: [tuple(c) for c in facts(text, lang).calls], "path string, callee string, receiver string, line int, expression string")


def file_rows(files: DataFrame) -> DataFrame:
    """(path, source_hash, lines_of_code) of files with at least one function or import."""
    from pyspark.sql import functions as F

    def extract(path: str, lang: str, text: str) -> list[tuple]:
        x = facts(text, lang)
        return [(text.count("\n") + (not text.endswith("\n")),)] if x.functions or x.imports else []

    rows = _each(files, extract, "path string, lines_of_code int")
    return rows.join(files.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("source_hash")), "path")
