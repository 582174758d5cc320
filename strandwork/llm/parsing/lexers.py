"""String- and comment-aware lexers: the state machines below parsers and extractors.

A lexer turns a text into tokens (kind, text, start) and comments. The kind of a keyword or sign is its own text; other
kinds are NAME, NUM, STR, REGEX, TEMPLATE (parts of a template text), NEWLINE, INDENT, DEDENT, EOF, and ERR for what no
token can be made of: an unclosed text or comment, a stray sign.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field


@dataclass
class Lexed:
    kinds: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    newline: list[bool] = field(default_factory=list)
    adjacent: list[bool] = field(default_factory=list)
    comments: list[tuple[int, int]] = field(default_factory=list)
    text: str = ""

    def add(self, kind: str, text: str, start: int, newline: bool, adjacent: bool) -> None:
        self.kinds.append(kind)
        self.texts.append(text)
        self.starts.append(start)
        self.newline.append(newline)
        self.adjacent.append(adjacent)


class Lines:
    """1-based line numbers of a text with any mixture of line ends."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer(r"\r\n|\r|\n", text))]

    def of(self, pos: int) -> int:
        return bisect_right(self.starts, pos)


def _words(s: str) -> frozenset[str]:
    return frozenset(s.split())


# Reserved words and signs of the languages.
JS_WORDS = _words(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof "
    "new return super switch this throw try typeof var void while with null true false enum"
)
GO_WORDS = _words(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select "
    "struct switch type var"
)
JAVA_WORDS = _words(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for "
    "goto if implements import instanceof int interface long native new package private protected public return short static strictfp super "
    "switch synchronized this throw throws transient try void volatile while true false null _"
)
PY_WORDS = _words(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda "
    "nonlocal not or pass raise return try while with yield"
)


def _signs(s: str) -> str:
    return "|".join(re.escape(x) for x in sorted(s.split(), key=len, reverse=True))


# combining marks and the like: letters of an identifier after the first that \\w does not hold
_MARKS = "".join(chr(i) for i in range(0x300, 0xFFFF) if not 0xD800 <= i < 0xE000 and not re.match(r"\w", chr(i)) and ("a" + chr(i)).isidentifier())
_ID = r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$MARKS‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*".replace("MARKS", _MARKS)
_JS_SPACE = r"[ \t\v\f ﻿  -   　]+"

_JS = re.compile(
    rf"(?P<sp>{_JS_SPACE})|(?P<nl>\r\n|[\n\r  ])|(?P<com>//[^\n\r  ]*|/\*(?s:.*?)\*/)|(?P<open>/\*)"
    rf"|(?P<name>#?{_ID})"
    r"|(?P<num>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[oO][0-7](?:_?[0-7])*|0[bB][01](?:_?[01])*)n?(?![\w$])|(?:\d(?:_?\d)*n(?![\w$])|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?(?![\w$])))"
    r"|(?P<str>'(?:[^'\\\n\r]|\\(?:\r\n|(?s:.)))*'|\"(?:[^\"\\\n\r]|\\(?:\r\n|(?s:.)))*\")"
    rf"|(?P<sign>{_signs('... => === !== == != <= **= ** ++ -- += -= *= %= <<= << && || ?? &&= ||= ??= &= |= ^= ?. { } ( ) [ ] ; , < > + - * % & | ^ ! ~ ? : = . @')})"
    r"|(?P<err>(?s:.))"
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_TEMPLATE_PART = re.compile(r"(?:[^`\\$]|\\(?s:.)|\$(?!\{))*(`|\$\{)?")
_OPERAND_END = frozenset(["NAME", "NUM", "STR", "REGEX", "TEMPLATE_END", "TEMPLATE_FULL", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--"])
_JSX_NAME = re.compile(r"[^\W\d][\w.$:-]*")
_JSX_TEXT = re.compile(r"[^<{>}]+")


def lex_js(text: str, jsx: bool = False) -> Lexed:
    """JavaScript and TypeScript. A slash is a regular expression where no operand can end before it."""
    out = Lexed(text=text)
    pos, n, nl, adj = 0, len(text), False, False
    stack: list[str] = []  # '{' block or object, '`' template hole, '(' or 'c(' a condition's bracket, 'j{' hole in markup
    control = False
    if text.startswith("#!"):
        pos = len(re.match(r"[^\n\r]*", text).group())

    def put(kind: str, s: str, at: int) -> None:
        nonlocal nl, adj
        out.add(kind, s, at, nl, adj)
        nl, adj = False, True

    def template(at: int, first: bool) -> int:
        m = _TEMPLATE_PART.match(text, at)
        if m.group(1) is None:
            put("ERR", "`", at - 1)
            return n
        if m.group(1) == "`":
            put("TEMPLATE" if first else "TEMPLATE_END", text[at - 1 : m.end()], at - 1)
            if first:
                out.kinds[-1] = "TEMPLATE_FULL"
        else:
            put("TEMPLATE_START" if first else "TEMPLATE_MIDDLE", text[at - 1 : m.end()], at - 1)
            stack.append("`")
        return m.end()

    regex_paren = False
    while pos < n:
        c = text[pos]
        if c == "/" and text[pos : pos + 2] not in ("//", "/*"):
            last = out.kinds[-1] if out.kinds else ""
            operand = last in _OPERAND_END
            if last == ")" and regex_paren:
                operand = False
            if last == "}" and nl:
                operand = False
            m = None if operand else _JS_REGEX.match(text, pos)
            if m:
                flags = m.group().rpartition("/")[2]
                put("REGEX" if len(set(flags)) == len(flags) and set(flags) <= set("dgimsuvy") else "ERR", m.group(), pos)
                pos = m.end()
            else:
                s = "/=" if text.startswith("/=", pos) else "/"
                put(s, s, pos)
                pos += len(s)
            continue
        if c == "`":
            pos = template(pos + 1, True)
            continue
        if c == "}" and stack and stack[-1] == "`":
            stack.pop()
            pos = template(pos + 1, False)
            continue
        if jsx and c == "<" and (not out.kinds or out.kinds[-1] not in _OPERAND_END or out.kinds[-1] == "}" and nl) and re.match(r"<(?:>|[^\W\d][\w.$:-]*(?!\s*,|\s+extends\b)[\s/>])", text[pos:pos + 200]):
            end = _lex_jsx(text, pos, out, put)
            if end > 0:
                pos = end
                continue
        m = _JS.match(text, pos)
        kind, s, start = m.lastgroup, m.group(), pos
        pos = m.end()
        if kind == "sp":
            adj = False
        elif kind == "nl":
            nl, adj = True, False
        elif kind == "com":
            out.comments.append((start, pos))
            if s[1] == "*" and re.search(r"[\n\r  ]", s):
                nl = True
            adj = False
        elif kind == "open":
            put("ERR", s, start)
            pos = n
        elif kind == "name":
            control = s in ("if", "while", "for", "with") and (not out.kinds or out.kinds[-1] not in (".", "?."))
            put(s if s in JS_WORDS else "PRIVATE" if s[0] == "#" else "NAME", s, start)
            continue
        elif kind == "sign":
            if s in "({[":
                stack.append("c(" if s == "(" and control else s)
            elif s in ")}]" and stack:
                regex_paren = stack.pop() == "c("
            if s == "?." and text[pos : pos + 1].isdigit():
                s, pos = "?", start + 1
            put(s, s, start)
        elif kind == "num":
            put("NUM", s, start)
        elif kind == "str":
            put("STR", s, start)
        else:
            put("ERR", s, start)
        if kind not in ("sp", "nl", "com"):
            control = False
    if "`" in stack:
        put("ERR", "", n)
    put("EOF", "", n)
    return out


def _lex_jsx(text: str, pos: int, out: Lexed, put) -> int:
    """One markup element as JSX_OPEN .. JSX_CLOSE tokens; the text must be balanced, else -1 and nothing is put."""
    got: list[tuple[str, str, int]] = []
    open_: list[str] = []
    n = len(text)
    i = pos
    while True:
        if i >= n:
            return -1
        if text[i] == "<":
            close = text.startswith("</", i)
            j = i + (2 if close else 1)
            m = _JSX_NAME.match(text, j)
            name = m.group() if m else ""
            j = m.end() if m else j
            if close:
                m = re.compile(r"\s*>").match(text, j)
                if not m or not open_ or open_.pop() != name:
                    return -1
                i = m.end()
            else:
                while True:
                    m = re.compile(r"\s*").match(text, j)
                    j = m.end()
                    if text.startswith("/>", j):
                        i = j + 2
                        break
                    if text.startswith(">", j):
                        open_.append(name)
                        i = j + 1
                        break
                    if not name:
                        return -1
                    if text.startswith("{", j):
                        j = _jsx_hole(text, j, got)
                        if j < 0:
                            return -1
                        continue
                    m = re.compile(r"[^\W\d][\w$:-]*(?:\s*=\s*(\"[^\"]*\"|'[^']*'|(?=\{)))?").match(text, j)
                    if not m:
                        return -1
                    j = m.end()
                    if text[j : j + 1] == "{" and text[m.start() : j].rstrip().endswith("="):
                        j = _jsx_hole(text, j, got)
                        if j < 0:
                            return -1
            if not open_:
                break
        elif text[i] == "{":
            i = _jsx_hole(text, i, got)
            if i < 0:
                return -1
        elif text[i] in ">}":
            return -1
        else:
            i = _JSX_TEXT.match(text, i).end()
    put("JSX_OPEN", "<", pos)
    for g in got:
        put(*g)
    put("JSX_CLOSE", ">", i - 1)
    out.kinds[-1] = "JSX_CLOSE"
    return i


def _jsx_hole(text: str, pos: int, got: list) -> int:
    """A bracketed expression in markup: its tokens between JSX_HOLE and JSX_END."""
    depth, i, n = 0, pos, len(text)
    while i < n:
        c = text[i]
        if c in "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                inner = lex_js(text[pos + 1 : i], True)
                got.append(("JSX_HOLE", "{", pos))
                got.extend((k, s, pos + 1 + at) for k, s, at in zip(inner.kinds[:-1], inner.texts, inner.starts))
                got.append(("JSX_END", "}", i))
                return i + 1
        elif c in "'\"`":
            m = re.compile(rf"{c}(?:[^{c}\\]|\\(?s:.))*{c}").match(text, i)
            if not m:
                return -1
            i = m.end()
            continue
        i += 1
    return -1


_GO = re.compile(
    r"(?P<sp>[ \t﻿]+)|(?P<nl>\r\n|[\n\r])|(?P<com>//[^\n]*|/\*(?s:.*?)\*/)|(?P<open>/\*)|(?P<name>[^\W\d]\w*)"
    r"|(?P<num>(?:0[xX](?:_?[0-9a-fA-F])*(?:\.(?:[0-9a-fA-F](?:_?[0-9a-fA-F])*)?)?(?:[pP][+-]?\d(?:_?\d)*)?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)i?(?!\w))"
    r"|(?P<str>`[^`]*`|\"(?:[^\"\\\n\r]|\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*\"|'(?:[^'\\\n\r]|\\(?:[abfnrtv\\'\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))')"
    rf"|(?P<sign>{_signs('... <<= >>= &^= := <- ++ -- == != <= >= && || << >> &^ += -= *= /= %= &= |= ^= { } ( ) [ ] ; , < > + - * / % & | ^ ! : = . ~')})|(?P<err>(?s:.))"
)
_GO_ENDS = frozenset(["NAME", "NUM", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])


def lex_go(text: str) -> Lexed:
    """Go, with the semicolons that line ends stand for."""
    out = Lexed(text=text)
    pos, nl, adj = 0, False, False

    def line_end(at: int) -> None:
        if out.kinds and out.kinds[-1] in _GO_ENDS:
            out.add(";", "\n", at, False, False)

    for m in _GO.finditer(text):
        kind, s, start = m.lastgroup, m.group(), m.start()
        if pos > start:
            continue
        if kind == "sp":
            adj = False
        elif kind == "nl":
            line_end(start)
            nl, adj = True, False
        elif kind == "com":
            out.comments.append((start, m.end()))
            if s[1] == "*" and "\n" in s:
                line_end(start)
                nl = True
            adj = False
        else:
            if kind == "open":
                pos = len(text)
            k = {"name": s if s in GO_WORDS else "NAME", "num": "NUM", "str": "STR", "sign": s}.get(kind, "ERR")
            out.add(k, s, start, nl, adj)
            nl, adj = False, True
    line_end(len(text))
    out.add("EOF", "", len(text), nl, False)
    return out


_JAVA = re.compile(
    r"(?P<sp>[ \t\f﻿\x1a]+)|(?P<nl>\r\n|[\n\r])|(?P<com>//[^\n\r]*|/\*(?s:.*?)\*/)|(?P<open>/\*)"
    r"|(?P<name>(?:[^\W\d]|\$)(?:\w|\$)*)"
    r"|(?P<num>(?:0[xX][0-9a-fA-F_]*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d[\d_]*)?|0[bB][01_]+|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)[lLfFdD]?(?![\w$]))"
    r"|(?P<str>\"\"\"[ \t\f]*(?:\r\n|[\n\r])(?:[^\\\"]|\\(?s:.)|\"(?!\"\"))*\"\"\"|\"(?!\"\")(?:[^\"\\\n\r]|\\(?:[btnfrs\\'\"]|u+[0-9a-fA-F]{4}|[0-7]{1,3}))*\"|'(?:[^'\\\n\r]|\\(?:[btnfrs\\'\"]|u+[0-9a-fA-F]{4}|[0-7]{1,3}))')"
    rf"|(?P<sign>{_signs('... -> :: ++ -- && || == != <= += -= *= /= &= |= ^= %= <<= << { } ( ) [ ] ; , . @ = < > ! ~ ? : + - * / & | ^ %')})|(?P<err>(?s:.))"
)


def _plain(pattern: re.Pattern, words: frozenset[str], text: str) -> Lexed:
    out = Lexed(text=text)
    pos, nl, adj = 0, False, False
    for m in pattern.finditer(text):
        kind, s, start = m.lastgroup, m.group(), m.start()
        if pos > start:
            continue
        if kind == "sp":
            adj = False
        elif kind == "nl":
            nl, adj = True, False
        elif kind == "com":
            out.comments.append((start, m.end()))
            nl = nl or "\n" in s or "\r" in s
            adj = False
        else:
            if kind == "open":
                pos = len(text)
            k = {"name": s if s in words else "NAME", "num": "NUM", "str": "STR", "sign": s}.get(kind, "ERR")
            out.add(k, s, start, nl, adj)
            nl, adj = False, True
    out.add("EOF", "", len(text), nl, False)
    return out


def lex_java(text: str) -> Lexed:
    return _plain(_JAVA, JAVA_WORDS, text)


_JSON = re.compile(
    r"(?P<sp>[ \t\n\r]+)|(?P<name>(?:true|false|null)(?!\w))|(?P<num>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![\w.]))"
    r"|(?P<str>\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\")|(?P<sign>[{}\[\],:])|(?P<err>(?s:.))"
)


def lex_json(text: str) -> Lexed:
    """JSON as in RFC 8259, a leading byte order mark aside."""
    return _plain(_JSON, frozenset(["true", "false", "null"]), text[1:] if text.startswith("﻿") else text)


_PY_PREFIX = r"(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?"
_PY = re.compile(
    rf"(?P<sp>[ \t\f]+|\\(?:\r\n|[\n\r]))|(?P<nl>\r\n|[\n\r])|(?P<com>\#[^\n\r]*)"
    rf"|(?P<str>{_PY_PREFIX}(?:'''(?:[^'\\]|\\(?s:.)|'(?!''))*'''|\"\"\"(?:[^\"\\]|\\(?s:.)|\"(?!\"\"))*\"\"\"|'(?!'')(?:[^'\\\n\r]|\\(?:\r\n|(?s:.)))*'|''|\"(?!\"\")(?:[^\"\\\n\r]|\\(?:\r\n|(?s:.)))*\"|\"\"))"
    rf"|(?P<name>[^\W\d][\w{_MARKS}]*)"
    r"|(?P<num>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?![^\W_]))"
    rf"|(?P<sign>{_signs('... := -> ** // << >> <= >= == != += -= *= /= //= %= @= &= |= ^= >>= <<= **= { } ( ) [ ] : , ; . @ = < > + - * / % & | ^ ~')})|(?P<err>(?s:.))"
)
_PY_INDENT = re.compile(r"[ \t\f]*")
_PY_KEYWORD_AFTER_NUMBER = re.compile(r"(?:and|else|for|if|in|is|not|or)\b")


def lex_python(text: str) -> Lexed:
    """Python, with NEWLINE, INDENT and DEDENT; a dedent to no open level or mixed tabs and spaces give ERR."""
    out = Lexed(text=text)
    n, pos = len(text), 1 if text.startswith("﻿") else 0
    levels: list[tuple[int, int]] = [(0, 0)]
    depth, start_of_line, adj = 0, True, False
    brackets: list[str] = []
    pairs = {")": "(", "]": "[", "}": "{"}
    while pos < n:
        if start_of_line and not depth:
            m = _PY_INDENT.match(text, pos)
            at = m.end()
            if at >= n:
                break
            if text[at] in "\r\n" or text[at] == "#":
                m = re.compile(r"#[^\n\r]*").match(text, at)
                if m:
                    out.comments.append((at, m.end()))
                    at = m.end()
                m = re.compile(r"\r\n|[\n\r]").match(text, at)
                pos = m.end() if m else n
                continue
            lead = text[pos:at].rpartition("\f")[2]
            width, alt = 0, 0
            for c in lead:
                width = (width // 8 + 1) * 8 if c == "\t" else width + 1
                alt = alt + 1
            if width > levels[-1][0]:
                if alt <= levels[-1][1]:
                    out.add("ERR", "", at, True, False)
                levels.append((width, alt))
                out.add("INDENT", "", at, True, False)
            else:
                while width < levels[-1][0]:
                    levels.pop()
                    out.add("DEDENT", "", at, True, False)
                if (width, alt) != levels[-1]:
                    out.add("ERR", "", at, True, False)
            pos, start_of_line, adj = at, False, False
        m = _PY.match(text, pos)
        kind, s, start = m.lastgroup, m.group(), pos
        pos = m.end()
        if kind == "sp":
            adj = False
            continue
        if kind == "com":
            out.comments.append((start, pos))
            continue
        if kind == "nl":
            adj = False
            if not depth:
                out.add("NEWLINE", "\n", start, False, False)
                start_of_line = True
            continue
        if kind == "sign":
            if s in "([{":
                depth += 1
                brackets.append(s)
            elif s in ")]}":
                if not brackets or brackets.pop() != pairs[s]:
                    kind = "err"
                depth = max(0, depth - 1)
        if kind == "num" and text[pos : pos + 1].isalpha() and not _PY_KEYWORD_AFTER_NUMBER.match(text, pos):
            kind = "err"
        if kind == "num" and re.fullmatch(r"0[\d_]*[1-9][\d_]*", s):
            kind = "err"
        if kind == "str" and "f" in re.match(r"\w*", s).group().lower() and not _f_string(s):
            kind = "err"
        if kind == "str" and "b" in re.match(r"\w*", s).group().lower() and not s.isascii():
            kind = "err"
        k = {"name": s if s in PY_WORDS else "NAME", "num": "NUM", "str": "STR", "sign": s}.get(kind, "ERR")
        if k == "STR" and "b" in re.match(r"\w*", s).group().lower():
            k = "BYTES"
        out.add(k, s, start, False, adj)
        adj = True
    if out.kinds and out.kinds[-1] not in ("NEWLINE", "DEDENT") and not start_of_line:
        out.add("NEWLINE", "", n, False, False)
    for _ in levels[1:]:
        out.add("DEDENT", "", n, True, False)
    if depth:
        out.add("ERR", "", n, True, False)
    out.add("EOF", "", n, True, False)
    return out


def _f_string(s: str) -> bool:
    """Whether the holes of a formatted text are balanced and not empty."""
    body = re.sub(r"^\w*('''|\"\"\"|'|\")|('''|\"\"\"|'|\")$", "", s)
    depth, i, start = 0, 0, 0
    while i < len(body):
        c = body[i]
        if not depth:
            if body.startswith(("{{", "}}"), i):
                i += 2
                continue
            if c == "}":
                return False
            if c == "{":
                depth, start = 1, i + 1
        elif c in "{[(":
            depth += 1
        elif c in "}])":
            depth -= 1
            if not depth and not re.sub(r"(?:![rsa])?(?::.*)?$", "", body[start:i], flags=re.S).strip():
                return False
        elif c in "'\"":
            m = re.compile(rf"{c}[^{c}]*{c}").match(body, i)
            if m:
                i = m.end()
                continue
        i += 1
    return depth == 0
