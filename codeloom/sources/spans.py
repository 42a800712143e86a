"""Comment spans and function spans of source files, found independently of each other.

A small lexer per language family turns a text into tokens. Every comment and every function
gets the number of significant tokens before it, where comments, blanks, and attributes or
annotations don't count. A comment and a declaration with the same number have no statement
between them.
"""

from __future__ import annotations

import re
from typing import NamedTuple

# Extension to language.
LANGUAGES = {
    "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "java": "java", "go": "go", "rs": "rust", "cs": "csharp",
}


class Comment(NamedTuple):
    """A documentation comment or docstring: significant tokens before it, place, last line, raw text."""

    tok: int
    pos: int
    end_line: int
    text: str


class Function(NamedTuple):
    """A function: name, significant tokens before its declaration (Python: before its body), place, first and last line of the declaration, code."""

    name: str
    tok: int
    pos: int
    line: int
    end: int
    code: str


_IDENT = r"[^\W\d]\w*|\$[\w$]*"
_STRINGS = {
    "python": r"(?i:[rbuft]{0,3})(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')",
    "js": r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\}|[^`\\])*`",
    "java": r"\"\"\"(?:\\.|[^\\])*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'",
    "go": r"`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'",
    "rust": r"b?r(?P<h>#*)\"(?:.|\n)*?\"(?P=h)|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\(?:u\{[^}]*\}|x..|.)|[^'\\\n])'|'[^\W\d]\w*",
    "csharp": r"\$*\"\"\"(?:.|\n)*?\"\"\"|(?:\$@|@\$|@)\"(?:\"\"|[^\"])*\"|\$?\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'",
}


def _lexer(strings: str, slashes: bool) -> re.Pattern:
    comment = r"//[^\n]*|/\*(?:.|\n)*?(?:\*/|\Z)" if slashes else r"\#[^\n]*"
    return re.compile(rf"(?P<ws>\s+|\\\n)|(?P<comment>{comment})|(?P<string>{strings})|(?P<ident>{_IDENT})|(?P<num>\d[\w.]*)|(?P<op>=>|->|::|:=|.)", re.S if False else 0)


_LEXERS = {
    "python": _lexer(_STRINGS["python"], False), "typescript": _lexer(_STRINGS["js"], True), "javascript": _lexer(_STRINGS["js"], True),
    "java": _lexer(_STRINGS["java"], True), "go": _lexer(_STRINGS["go"], True), "rust": _lexer(_STRINGS["rust"], True), "csharp": _lexer(_STRINGS["csharp"], True),
}
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int
    line: int


def _line_of(starts: list[int], pos: int) -> int:
    lo, hi = 0, len(starts)
    while lo < hi:
        mid = (lo + hi) // 2
        if starts[mid] <= pos:
            lo = mid + 1
        else:
            hi = mid
    return lo


def clean_source(text: str) -> str:
    return text.replace("﻿", "").replace("\r\n", "\n").replace("\r", "\n")


def tokens(text: str, lang: str) -> tuple[list[Token], list[int]]:
    """All tokens but blanks, and the start of each line."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    lex, out, pos, n = _LEXERS[lang], [], 0, len(text)
    js = lang in ("javascript", "typescript")
    before = ""
    line_at = 0
    while pos < n:
        m = lex.match(text, pos)
        if m is None:
            pos += 1
            continue
        kind = m.lastgroup if m.lastgroup != "h" else "string"
        if js and kind == "op" and m[0] == "/" and (before == "" or before in "(,=:[!&|?{};+-*%<>~^" or before in ("return", "typeof", "case", "=>")):
            r = _REGEX.match(text, pos)
            if r:
                m, kind = r, "string"
        if kind == "comment" and m[0].startswith("/*") and lang == "rust":  # block comments nest
            depth, end = 1, m.start() + 2
            while depth and end < n:
                if text.startswith("/*", end):
                    depth, end = depth + 1, end + 2
                elif text.startswith("*/", end):
                    depth, end = depth - 1, end + 2
                else:
                    end += 1
            out.append(Token("comment", text[pos:end], pos, end, _line_of(starts, pos)))
            pos = end
            continue
        if kind != "ws":
            while line_at < len(starts) and starts[line_at] <= pos:
                line_at += 1
            out.append(Token(kind, m[0], pos, m.end(), line_at))
            if kind != "comment":
                before = m[0]
        pos = m.end()
    return out, starts


def _match(ts: list[Token], i: int) -> int:
    """Index behind the bracket that closes the one at i."""
    depth = 0
    while i < len(ts):
        t = ts[i]
        if t.kind == "op":
            if t.text in _OPEN:
                depth += 1
            elif t.text in _CLOSE:
                depth -= 1
                if depth <= 0:
                    return i + 1
        i += 1
    return i


def _is_doc(t: Token, lang: str) -> bool:
    s = t.text
    if lang in ("java", "javascript", "typescript"):
        return s.startswith("/**") and len(s) > 4
    if lang in ("rust", "csharp"):
        return s.startswith("///") and not s.startswith("////")
    return lang == "go" and s.startswith("//")


def _attribute_end(ts: list[Token], i: int, lang: str, fresh: bool) -> int:
    """Index behind an attribute or annotation at i, or i. fresh: a statement could begin here."""
    t = ts[i]
    nxt = ts[i + 1] if i + 1 < len(ts) else None
    if lang == "rust" and t.text == "#" and nxt and nxt.text in ("[", "!"):
        j = i + 1 if nxt.text == "[" else i + 2
        return _match(ts, j) if j < len(ts) and ts[j].text == "[" else i
    if lang == "csharp" and t.text == "[" and fresh:
        return _match(ts, i)
    if lang in ("java", "typescript", "javascript") and t.text == "@" and nxt and nxt.kind == "ident" and nxt.text != "interface":
        j = i + 2
        while j + 1 < len(ts) and ts[j].text == "." and ts[j + 1].kind == "ident":
            j += 2
        return _match(ts, j) if j < len(ts) and ts[j].text == "(" else j
    return i


def spans(text: str, lang: str) -> tuple[list[Comment], list[Function]]:
    """Documentation comments and functions of one file; unknown languages have none."""
    if lang not in _LEXERS:
        return [], []
    text = clean_source(text)
    ts, starts = tokens(text, lang)
    code, comments = [], []
    i, fresh = 0, True
    lines_with_code: set[int] = set()
    while i < len(ts):
        t = ts[i]
        if t.kind == "comment":
            if _is_doc(t, lang) and (t.text.startswith("/*") or t.line not in lines_with_code):
                last = _line_of(starts, t.end - 1)
                prev = comments[-1] if comments else None
                if prev and t.text.startswith("//") and prev.tok == len(code) and prev.text.startswith("//") and (lang != "go" or prev.end_line + 1 == t.line):
                    comments[-1] = Comment(prev.tok, prev.pos, last, prev.text + "\n" + t.text)
                else:
                    comments.append(Comment(len(code), t.start, last, t.text))
            i += 1
            continue
        j = _attribute_end(ts, i, lang, fresh)
        if j > i:
            i = j
            continue
        if lang == "python" and t.kind == "string":
            comments.append(Comment(len(code), t.start, _line_of(starts, t.end - 1), t.text))
        code.append(t)
        lines_with_code.add(t.line)
        fresh = t.text in ("{", "}", ";", "]") if t.text != "]" else False
        i += 1
    find = {"python": _python, "go": _go, "rust": _rust, "java": _typed, "csharp": _typed}.get(lang, _script)
    return comments, find(code, text, lang)


def _function(code: list[Token], text: str, name: str, first: int, stop: int, tok: int | None = None, pos: int | None = None) -> Function:
    a, b = code[first], code[min(max(stop - 1, first), len(code) - 1)]
    return Function(name, first if tok is None else tok, a.start if pos is None else pos, a.line, b.line, text[a.start : b.end])


def _python(code: list[Token], text: str, lang: str) -> list[Function]:
    out = []
    lines = text.split("\n")
    for i, t in enumerate(code):
        if t.text != "def" or t.kind != "ident" or i + 2 >= len(code) or code[i + 1].kind != "ident" or code[i + 2].text not in ("(", "["):
            continue
        first = i - 1 if i and code[i - 1].text == "async" else i
        if first and code[first - 1].line == t.line and code[first - 1].text not in (":", ";"):
            continue
        j = i + 2
        if code[j].text == "[":
            j = _match(code, j)
        j = _match(code, j) if j < len(code) and code[j].text == "(" else j
        depth = 0
        while j < len(code) and not (code[j].text == ":" and depth == 0):
            depth += code[j].text in _OPEN
            depth -= code[j].text in _CLOSE
            j += 1
        if j >= len(code):
            continue
        indent = len(lines[t.line - 1]) - len(lines[t.line - 1].lstrip())
        k = j + 1
        while k < len(code) and (code[k].line == code[j].line or _column(text, code[k].start) > indent or not _first_on_line(text, code[k].start)):
            k += 1
        body = code[j + 1].start if j + 1 < len(code) else code[j].end
        out.append(_function(code, text, code[i + 1].text, first, k, tok=j + 1, pos=body))
    return out


def _column(text: str, pos: int) -> int:
    return pos - (text.rfind("\n", 0, pos) + 1)


def _first_on_line(text: str, pos: int) -> bool:
    return not text[text.rfind("\n", 0, pos) + 1 : pos].strip()


def _body_end(code: list[Token], j: int) -> int:
    """Index behind the body or the semicolon that ends a declaration whose parameters close before j."""
    while j < len(code):
        if code[j].text == "{":
            return _match(code, j)
        if code[j].text in (";", "}"):
            return j + 1
        j = _match(code, j) if code[j].text in ("(", "[") else j + 1
    return j


def _go(code: list[Token], text: str, lang: str) -> list[Function]:
    out = []
    for i, t in enumerate(code):
        if t.text == "func" and t.kind == "ident":
            j = i + 1
            if j < len(code) and code[j].text == "(":
                j = _match(code, j)
            if j + 1 < len(code) and code[j].kind == "ident" and code[j + 1].text in ("(", "[") and (i == 0 or code[i - 1].line < t.line):
                k = _match(code, j + 1)
                k = _match(code, k) if k < len(code) and code[k].text == "(" and code[j + 1].text == "[" else k
                stop = k
                while stop < len(code) and code[stop].text != "{" and code[stop].line == code[k - 1].line:
                    stop = _match(code, stop) if code[stop].text in ("(", "[") else stop + 1
                stop = _match(code, stop) if stop < len(code) and code[stop].text == "{" else stop
                out.append(_function(code, text, code[j].text, i, stop))
    return out


# Words that stand before `fn` in a declaration.
_RUST_WORDS = {"pub", "async", "unsafe", "extern", "const", "default", "crate", "super", "self", "in"}


def _rust(code: list[Token], text: str, lang: str) -> list[Function]:
    out = []
    for i, t in enumerate(code):
        if t.text == "fn" and t.kind == "ident" and i + 1 < len(code) and code[i + 1].kind == "ident":
            first = i
            while first and (code[first - 1].text in _RUST_WORDS or code[first - 1].text in ("(", ")") or (code[first - 1].kind == "string" and first > 1 and code[first - 2].text == "extern")):
                first -= 1
            while code[first].text in ("(", ")"):
                first += 1
            out.append(_function(code, text, code[i + 1].text, first, _body_end(code, i + 2)))
    return out


# Words that no declared method or its type is called.
_NOT_TYPES = {
    "return", "new", "else", "throw", "await", "case", "yield", "in", "is", "as", "if", "for", "while", "switch", "catch", "do", "using", "lock", "assert", "goto", "package",
    "import", "class", "interface", "enum", "record", "struct", "namespace", "var", "try", "synchronized", "foreach", "when", "not", "and", "or", "super", "this", "fixed", "delegate", "event", "operator",
}


def _typed(code: list[Token], text: str, lang: str) -> list[Function]:
    out = []
    for i, t in enumerate(code):
        if t.kind != "ident" or t.text in _NOT_TYPES or i + 1 >= len(code):
            continue
        j = i + 1
        if code[j].text == "<":  # C#: type parameters stand behind the name
            while j < len(code) and code[j].text not in (">", "(", ";", "{"):
                j += 1
            j += 1
        if j >= len(code) or code[j].text != "(":
            continue
        first = i
        while first and (code[first - 1].kind == "ident" or code[first - 1].text in (".", "<", ">", "[", "]", ",", "?", "&", "*")):
            first -= 1
        head = code[first:i]
        if first and code[first - 1].text not in ("{", "}", ";"):
            continue
        if not head or head[-1].text in (".", ",", "&") or any(x.text in _NOT_TYPES for x in head) or code[first].kind != "ident":
            continue
        k = _match(code, j)
        while k < len(code) and (code[k].kind == "ident" or code[k].text in (".", ",", ":", "<", ">")) and code[k].text not in ("class", "interface"):
            k += 1
        if k < len(code) and code[k].text in ("{", ";", "=>", "=") or k >= len(code):
            arrow = k < len(code) and code[k].text in ("=>", "=")
            stop = k
            if arrow:
                while stop < len(code) and code[stop].text != ";":
                    stop = _match(code, stop) if code[stop].text in _OPEN else stop + 1
                stop += 1
            out.append(_function(code, text, t.text, first, stop if arrow else _body_end(code, k)))
    return out


# Words before a function or a method, and words that look like a call with a block.
_SCRIPT_WORDS = {"export", "default", "async", "declare", "public", "private", "protected", "static", "abstract", "override", "readonly", "get", "set"}
_SCRIPT_BLOCKS = {"if", "for", "while", "switch", "catch", "with", "function", "return", "super", "await", "typeof", "new", "do", "else"}


def _script(code: list[Token], text: str, lang: str) -> list[Function]:
    out = []
    classes: list[int] = []  # brace depths of open class bodies
    depth, pending = 0, False
    for i, t in enumerate(code):
        nxt = code[i + 1].text if i + 1 < len(code) else ""
        if t.text == "{" and t.kind == "op":
            depth += 1
            if pending:
                classes.append(depth)
                pending = False
        elif t.text == "}" and t.kind == "op":
            if classes and classes[-1] == depth:
                classes.pop()
            depth -= 1
        elif t.kind == "ident" and t.text in ("class", "interface") and (i == 0 or code[i - 1].text != ".") and nxt not in ("=", ":", ")", ","):
            pending = True
        elif t.kind == "ident" and t.text == "function":
            j = i + 2 if nxt == "*" else i + 1
            if j + 1 < len(code) and code[j].kind == "ident" and code[j + 1].text in ("(", "<"):
                first = _back(code, i)
                out.append(_function(code, text, code[j].text, first, _script_end(code, j + 1)))
        elif t.kind == "ident" and t.text in ("const", "let", "var") and i + 2 < len(code) and code[i + 1].kind == "ident":
            j = _initial(code, i + 2)
            if j and _is_arrow(code, j):
                out.append(_function(code, text, code[i + 1].text, _back(code, i), _arrow_end(code, j)))
        elif t.kind == "ident" and classes and classes[-1] == depth and t.text not in _SCRIPT_BLOCKS:
            before = code[i - 1].text if i else ""
            if before in (".", "new", "=", ":", "(", ",", "=>", "return", "|", "<"):
                continue
            if nxt in ("(", "<"):
                j = i + 1
                if nxt == "<":
                    while j < len(code) and code[j].text not in ("(", "{", ";"):
                        j += 1
                if j < len(code) and code[j].text == "(":
                    stop = _script_end(code, j)
                    out.append(_function(code, text, t.text, _back(code, i), stop))
            elif nxt in ("=", ":") and t.text not in _SCRIPT_WORDS:
                j = _initial(code, i + 1)
                if j and _is_arrow(code, j):
                    out.append(_function(code, text, t.text, _back(code, i), _arrow_end(code, j)))
    return out


def _back(code: list[Token], i: int) -> int:
    while i and (code[i - 1].text in _SCRIPT_WORDS or code[i - 1].text in ("*", "#")):
        i -= 1
    return i


def _initial(code: list[Token], j: int) -> int:
    """Index behind the `=` of a variable, past its type; 0 if there is none."""
    if j < len(code) and code[j].text == ":":
        while j < len(code) and code[j].text not in ("=", ";"):
            j = _match(code, j) if code[j].text in _OPEN else j + 1
    return j + 1 if j < len(code) and code[j].text == "=" else 0


def _is_arrow(code: list[Token], j: int) -> bool:
    if j < len(code) and code[j].text == "async":
        j += 1
    if j >= len(code):
        return False
    if code[j].text == "function":
        return True
    if code[j].text == "<":
        while j < len(code) and code[j].text != "(":
            j += 1
    if j < len(code) and code[j].text == "(":
        j = _match(code, j)
        if j < len(code) and code[j].text == ":":
            while j < len(code) and code[j].text not in ("=>", ";", "="):
                j = _match(code, j) if code[j].text in _OPEN else j + 1
        return j < len(code) and code[j].text == "=>"
    return code[j].kind == "ident" and j + 1 < len(code) and code[j + 1].text == "=>"


def _script_end(code: list[Token], j: int) -> int:
    while j < len(code) and code[j].text != "(":
        j += 1
    return _body_end(code, _match(code, j))


def _arrow_end(code: list[Token], j: int) -> int:
    line = code[j].line if j < len(code) else 0
    while j < len(code) and code[j].text != ";":
        if code[j].text == "{":
            return _match(code, j)
        if code[j].text in ("(", "["):
            j = _match(code, j)
            line = code[j - 1].line
            continue
        if code[j].line > line and code[j - 1].text != "=>":
            break
        line = code[j].line
        j += 1
    return j
