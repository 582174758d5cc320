"""Whether a source file is valid in the language that its extension stands for."""

from __future__ import annotations

import re
from dataclasses import dataclass

from strandwork.llm.parsing import lexers
from strandwork.llm.syntax.grammars import grammar

# The extensions and what they stand for (language, grammar).
EXTENSIONS = {
    "ts": ("TypeScript", "ts"), "mts": ("TypeScript", "ts"), "cts": ("TypeScript", "ts"), "tsx": ("TypeScript", "tsx"),
    "js": ("JavaScript", "js"), "jsx": ("JavaScript", "jsx"), "mjs": ("JavaScript", "js"), "cjs": ("JavaScript", "js"),
    "py": ("Python", "python"), "pyi": ("Python", "python"), "go": ("Go", "go"), "java": ("Java", "java"), "json": ("JSON", "json"),
}
_CONFLICT = re.compile(r"^(?:<{7}(?: |$)|={7}$|>{7}(?: |$)|\|{7}(?: |$))", re.M)


@dataclass(frozen=True)
class Verdict:
    """valid; of an invalid file the furthest failure's line and column and its cause."""

    language: str
    valid: bool
    line: int = 0
    column: int = 0
    cause: str = ""


def extension_language(path: str | None) -> tuple[str, str] | None:
    """(language, grammar) for a path, in any case; None for an extension of no known language."""
    name = re.split(r"[/\\]", path or "")[-1]
    return EXTENSIONS.get(name.rsplit(".", 1)[-1].lower()) if "." in name else None


def lex(text: str, kind: str) -> lexers.Lexed:
    if kind in ("js", "jsx", "ts", "tsx"):
        return lexers.lex_js(text, kind in ("jsx", "tsx"))
    return {"go": lexers.lex_go, "java": lexers.lex_java, "json": lexers.lex_json, "python": lexers.lex_python}[kind](text)


# What may stand before a constructor's name.
_BEFORE_CONSTRUCTOR = frozenset(["public", "private", "protected", "{", "}", ";"])
_METHOD_ONLY = frozenset(["static", "abstract", "final", "native", "synchronized", "default", "strictfp"])


def _misnamed(t: lexers.Lexed) -> int:
    """The first Java member without a return type that is not named as its class, or -1.

    A grammar cannot compare names; everything else about the member it has checked.
    """
    k, v = t.kinds, t.texts
    stack: list[str] = []
    header = ""
    opened: list[int] = []
    close: dict[int, int] = {}
    for i, x in enumerate(k):
        if x == "(":
            opened.append(i)
        elif x == ")" and opened:
            close[i] = opened.pop()
    for i, x in enumerate(k):
        if x in ("class", "interface", "enum") and k[i - 1] != "." and k[i + 1] == "NAME" or x == "NAME" and v[i] == "record" and k[i + 1] == "NAME" and k[i + 2] in ("(", "<"):
            header = ("enum " if x == "enum" else "") + v[i + 1]
        if x == "{":
            stack.append(header)
            header = ""
        elif x == "}" and stack:
            stack.pop()
        elif x == "NAME" and stack and stack[-1] and not header and k[i + 1] == "(":
            own = stack[-1].removeprefix("enum ")
            if own != stack[-1] and k[i - 1] in ("{", ","):
                continue
            j = i - 1
            if k[j] == ")" and j in close:
                j = close[j] - 1
            annotated = k[j] == "NAME" and k[j - 1] == "@"
            if (k[i - 1] in _BEFORE_CONSTRUCTOR or k[i - 1] in _METHOD_ONLY or annotated) and v[i] != own:
                return i
    return -1


def parse(text: str, kind: str) -> tuple[bool, int, lexers.Lexed]:
    """(valid, start of the token that stopped the parse, tokens)."""
    t = lex(text, kind)
    return *parse_tokens(t, kind), t


def parse_tokens(t: lexers.Lexed, kind: str) -> tuple[bool, int]:
    """(valid, start of the token that stopped the parse) of lexed text."""
    try:
        ok, far = grammar("js" if kind == "jsx" else kind).parse(t.kinds, t.texts, t.newline, t.adjacent)
    except RecursionError:
        return False, -1
    if ok and kind == "java" and (bad := _misnamed(t)) >= 0:
        return False, t.starts[bad]
    return ok, t.starts[min(far, len(t.starts) - 1)]


def check(text: str | None, path: str | None) -> Verdict | None:
    """The verdict for a file, None where there is nothing to judge: null content or another extension.

    Empty and comment-only content and a leading byte order mark are valid, but in JSON, where RFC 8259 asks for a value.
    Cause is 'conflict' for merge marks left standing, 'extension' where another language's grammar accepts the text,
    'truncated' where the text ends too early, 'nesting' beyond the depth that can be parsed, else 'syntax'.
    """
    found = extension_language(path)
    if text is None or found is None:
        return None
    language, kind = found
    ok, at, t = parse(text, kind)
    if ok:
        return Verdict(language, True)
    if at < 0:
        return Verdict(language, False, 0, 0, "nesting")
    line = lexers.Lines(text).of(at)
    start = lexers.Lines(text).starts[line - 1]
    near = [m.start() for m in _CONFLICT.finditer(text)]
    if any(abs(lexers.Lines(text).of(p) - line) <= 1 for p in near):
        cause = "conflict"
    elif not text.strip():
        cause = "truncated"
    elif any(k != kind and parse(text, k)[0] for k in ("python", "js", "ts", "go", "java", "json") if k != kind):
        cause = "extension"
    elif at >= len(text.rstrip()) or "ERR" in t.kinds[-3:]:
        cause = "truncated"
    else:
        cause = "syntax"
    return Verdict(language, False, line, at - start + 1, cause)
