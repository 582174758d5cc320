"""Functions in a list of tokens: a name, its parameters and a matched body.

Brackets are matched over the tokens; what stands before an opening bracket decides what stands in it (a class body, an
object or a block). What looks like a function inside a text or comment is no token and so is none.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from strandwork.llm.parsing.lexers import Lexed

_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


def pairs(kinds: list[str]) -> dict[int, int]:
    """Index of each opening bracket's partner, and the other way round."""
    out: dict[int, int] = {}
    stack: list[int] = []
    for i, k in enumerate(kinds):
        if k in _OPEN or k == "TEMPLATE_START":
            stack.append(i)
        elif (k in _CLOSE or k == "TEMPLATE_END") and stack:
            j = stack.pop()
            out[i], out[j] = j, i
    return out


# Words that may stand before a declaration as part of it.
_JS_BEFORE = {"export", "default", "async", "declare", "abstract", "public", "private", "protected", "readonly", "static", "override", "accessor", "get", "set", "*", "const", "var", "let"}
_JS_OBJECT_AFTER = {"=", "(", ",", "[", "return", "?", "&&", "||", "??", "...", "default", ":", "typeof", "in", "TEMPLATE_START", "TEMPLATE_MIDDLE", "throw", "new", "await", "yield"}


def js_functions(t: Lexed) -> Iterator[tuple[int, int, int]]:
    """(name token, first token of the declaration, last token of the body)."""
    k, v, n = t.kinds, t.texts, len(t.kinds)
    match = pairs(k)

    def after_params(i: int) -> int:
        """From the opening bracket of parameters to the token after a return type, which is '{' or '=>' or neither."""
        j = match.get(i, n) + 1
        if j < n and k[j] == ":":
            j += 1
            depth = 0
            while j < n:
                x = k[j]
                if x in ("(", "["):
                    j = match.get(j, n) + 1
                    continue
                if x == "{":
                    # a type in braces stands where a type can begin, else the body starts
                    if k[j - 1] in (":", "|", "&", "<", ",", "=>", "is", "keyof") or depth:
                        j = match.get(j, n) + 1
                        continue
                    return j
                if x == "<":
                    depth += 1
                elif x == ">":
                    depth -= 1
                elif x == "=>" and not depth:
                    # the arrow of a function type has a bracket before it that begins the type
                    return j
                elif x in (";", "}", ")") or x == "=" and not depth:
                    return j
                j += 1
        return j

    def generics(i: int) -> int:
        if i < n and k[i] == "<":
            depth = 0
            while i < n:
                depth += (k[i] == "<") - (k[i] == ">")
                i += 1
                if not depth:
                    return i
        return i

    def body_end(i: int) -> int:
        """The last token of an arrow's body that begins at i."""
        if k[i] == "{":
            return match.get(i, n - 1)
        while i < n and k[i] not in (";", ",", ")", "]", "}", "EOF"):
            if t.newline[i] and k[i - 1] not in _JS_OBJECT_AFTER | {"=>", "+", "-", "*", "/", "."} and k[i] not in (".", "?.", "?", ":", "+", "-", "&&", "||"):
                break
            i = match.get(i, i) + 1 if k[i] in _OPEN else i + 1
        return i - 1

    def value(i: int) -> int:
        """The last token of a function that a value starting at i is, or -1."""
        if i < n and v[i] == "async" and not t.newline[i + 1]:
            i += 1
        if i >= n:
            return -1
        if k[i] == "function":
            j = i + 1
            while j < n and k[j] in ("*", "NAME"):
                j += 1
            j = generics(j)
            if j < n and k[j] == "(":
                j = after_params(j)
                return match.get(j, -1) if j < n and k[j] == "{" else -1
            return -1
        if k[i] == "NAME" and k[i + 1] == "=>":
            return body_end(i + 2)
        i = generics(i)
        if i < n and k[i] == "(":
            j = after_params(i)
            return body_end(j + 1) if j < n and k[j] == "=>" else -1
        return -1

    def first(i: int) -> int:
        """The first token of the declaration whose name or keyword is at i: over modifiers and decorators."""
        while i > 0:
            if v[i - 1] in _JS_BEFORE and k[i - 1] != "STR":
                i -= 1
                continue
            # a decorator before: @name(.name)*(args)?
            j = i - 1
            if k[j] == ")" and j in match:
                j = match[j] - 1
            while j > 1 and k[j] in ("NAME",) and k[j - 1] == ".":
                j -= 2
            if j > 0 and k[j - 1] == "@":
                i = j - 1
                continue
            return i
        return i

    what: list[str] = []
    header: str | None = None
    for i in range(n):
        x = k[i]
        if x == "class" and not (i and k[i - 1] in (".", "?.")) and k[i + 1] not in (":", ",", "("):
            header = "class"
        if x == "{":
            prev = k[i - 1] if i else ""
            if header == "class" and prev not in ("=", "(", ",", "<", ":"):
                what.append("class")
                header = None
            elif prev in _JS_OBJECT_AFTER:
                what.append("object")
            else:
                what.append("block")
        elif x == "}" and what:
            what.pop()
        elif x == "function" and i + 1 < n:
            j = i + 1 + (k[i + 1] == "*")
            if k[j] == "NAME":
                # assigned to a const, that name is found below
                b = i - (i > 0 and v[i - 1] == "async")
                if not (b > 0 and k[b - 1] == "=" and _assigned(k, b - 1)):
                    p = generics(j + 1)
                    if k[p] == "(":
                        e = after_params(p)
                        if e < n and k[e] == "{":
                            yield j, first(i), match.get(e, n - 1)
        elif x in ("const", "var") or x == "NAME" and v[i] == "let" and k[i + 1] == "NAME":
            j = i + 1
            if k[j] == "NAME":
                p = j + 1
                if k[p] in (":", "!"):
                    p = _type_end(k, match, p + 1, n)
                if p < n and k[p] == "=":
                    e = value(p + 1)
                    if e >= 0:
                        yield j, first(i), e
        elif what and what[-1] in ("class", "object") and (x in ("NAME", "PRIVATE") or x.isalpha() and x.islower()):
            prev = k[i - 1]
            starts = prev in ("{", "}", ";", ",", "*", ")", "@") or t.newline[i] or v[i - 1] in _JS_BEFORE
            if not starts or prev in (".", "?."):
                continue
            p = i + 1
            if what[-1] == "class" and k[p] in ("?", "!"):
                p += 1
            p = generics(p)
            if p < n and k[p] == "(" and prev != "@":
                e = after_params(p)
                if e < n and k[e] == "{" and v[i] not in ("if", "for", "while", "switch", "catch", "function"):
                    yield i, first(i), match.get(e, n - 1)
            elif what[-1] == "class" and prev != "@":
                if k[p] == ":":
                    p = _type_end(k, match, p + 1, n)
                if p < n and k[p] == "=":
                    e = value(p + 1)
                    if e >= 0:
                        yield i, first(i), e


def _assigned(k: list[str], eq: int) -> bool:
    """Whether the '=' at eq belongs to a declaration."""
    i = eq - 1
    while i > 0 and k[i] not in (";", "{", "}", "const", "var", "=", ","):
        i -= 1
    return k[i] in ("const", "var")


def _type_end(k: list[str], match: dict[int, int], i: int, n: int) -> int:
    """The '=' after a type that starts at i."""
    while i < n and k[i] not in ("=", ";", ",", ")", "}"):
        i = match.get(i, n) + 1 if k[i] in _OPEN else i + 1
    return i


def java_functions(t: Lexed) -> Iterator[tuple[int, int, int]]:
    k, v, n = t.kinds, t.texts, len(t.kinds)
    match = pairs(k)
    what: list[str] = []
    header = ""
    for i in range(n):
        x = k[i]
        if x in ("class", "interface", "enum") and k[i - 1] != ".":
            header = "enum" if x == "enum" else "class"
        elif x == "NAME" and v[i] == "record" and k[i + 1] == "NAME" and k[i + 2] in ("(", "<"):
            header = "class"
        if x == "{":
            kind = "block"
            if header:
                kind, header = header, ""
            elif k[i - 1] == ")" and i - 1 in match:
                j = match[i - 1] - 1
                # back over a type to 'new'
                depth = 0
                while j > 0 and (k[j] in ("NAME", ".", ",", "?", "extends", "super", "[", "]", "&") and (depth or k[j] != ",") or k[j] in ("<", ">")):
                    depth += (k[j] == ">") - (k[j] == "<")
                    j -= 1
                if k[j] == "new" or what and what[-1] == "enum" and k[j] in ("{", ","):
                    kind = "class"
            elif k[i - 1] == "NAME" and what and what[-1] == "enum" and k[i - 2] in ("{", ","):
                kind = "class"
            what.append(kind)
        elif x == "}" and what:
            what.pop()
        elif x == "NAME" and what and what[-1] != "block" and k[i + 1] == "(" and i + 1 in match:
            if k[i - 1] in (".", "@", "new") or what[-1] == "enum" and k[i - 1] in ("{", ","):
                continue
            p = match[i + 1] + 1
            while p < n and k[p] in ("[", "]"):
                p += 1
            if p < n and k[p] == "throws":
                while p < n and k[p] not in ("{", ";"):
                    p += 1
            if p < n and k[p] == "{":
                j = i
                while j > 0 and k[j - 1] not in ("{", "}", ";"):
                    # back over annotation arguments, whose braces are not a body's
                    j = match[j - 1] if k[j - 1] in (")", "]") and j - 1 in match else j - 1
                yield i, j, match.get(p, n - 1)


def go_functions(t: Lexed) -> Iterator[tuple[int, int, int]]:
    k, n = t.kinds, len(t.kinds)
    match = pairs(k)
    for i in range(n):
        if k[i] != "func" or i and k[i - 1] != ";":
            continue
        j = i + 1
        if k[j] == "(":
            j = match.get(j, n) + 1
        if j >= n or k[j] != "NAME":
            continue
        p = j + 1
        if k[p] == "[":
            p = match.get(p, n) + 1
        if p >= n or k[p] != "(":
            continue
        p = match.get(p, n) + 1
        while p < n and k[p] != ";":
            if k[p] == "{":
                if k[p - 1] in ("interface", "struct"):
                    p = match.get(p, n) + 1
                    continue
                yield j, i, match.get(p, n - 1)
                break
            p = match.get(p, n) + 1 if k[p] in ("(", "[") else p + 1


def python_functions(t: Lexed) -> Iterator[tuple[int, int, int, str]]:
    k, v, n = t.kinds, t.texts, len(t.kinds)
    match = pairs(k)
    for i in range(n - 1):
        if k[i] != "def" or k[i + 1] != "NAME":
            continue
        p = i + 2
        while p < n and k[p] != ":":
            p = match.get(p, n) + 1 if k[p] in _OPEN else p + 1
        p += 1
        block = p + 1 < n and k[p] == "NEWLINE" and k[p + 1] == "INDENT"
        q = p + 2 if block else p
        j, doc = q, ""
        while j < n and k[j] == "STR":
            j += 1
        if j > q and j < n and k[j] in ("NEWLINE", ";"):
            parts = v[q:j]
            if not any("f" in re.match(r"\w*", s).group().lower() for s in parts):
                try:
                    doc = ast.literal_eval("(" + "\n".join(parts) + ")")
                except (ValueError, SyntaxError, MemoryError, RecursionError):
                    doc = "\n".join(re.sub(r"^\w*(?:'''|\"\"\"|'|\")|(?:'''|\"\"\"|'|\")$", "", s) for s in parts)
        depth, e = 1, q
        if block:
            while e < n and depth:
                depth += (k[e] == "INDENT") - (k[e] == "DEDENT")
                e += 1
        else:
            while e < n and k[e] != "NEWLINE":
                e += 1
        first = i - (i > 0 and k[i - 1] == "async")
        yield i + 1, first, max(i + 1, e - 1), doc
