"""One pass over a source file: functions with their classes and spans, and the calls inside them.

Languages with braces share one machine: a stack of open brackets, each frame knowing where its current statement begins.
What stands between there and an opening brace (the header) tells whether a class, a function or a plain block opens.
Python is read by indentation, Ruby by its ``end`` words. Comments and texts are skipped by the scanner's expression, so
nothing inside them counts. Every token is looked at a fixed number of times.
"""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

# Extensions and their languages.
LANGUAGE = {
    "ts": "js", "tsx": "js", "mts": "js", "cts": "js", "js": "js", "jsx": "js", "mjs": "js", "cjs": "js", "py": "python", "pyi": "python", "go": "go", "java": "java", "rs": "rust", "rb": "ruby",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c": "cpp", "h": "cpp", "hpp": "cpp", "hh": "cpp", "swift": "swift",
}
# Words before a bracket that make no call, and names that are not followed.
_WORDS = frozenset(
    "if for while switch catch return function func fn def class new await yield throw typeof instanceof in of do else case import export super sizeof decltype alignof static_cast dynamic_cast "
    "const_cast reinterpret_cast match loop unsafe guard defer repeat elsif unless until when rescue ensure begin and or not lambda with assert except elif del raise synchronized try using delete "
    "operator template typename where let var const mut pub impl struct enum trait mod use as async static final".split()
)
IGNORED = frozenset("print println printf len make append panic cap copy String Number Boolean Object Array Promise Symbol require puts".split())
_DECIDE = frozenset("if for while case catch switch elif except and or with assert elsif unless until when rescue match guard && || ??".split())
_CLASS = {
    "js": ("class", "interface", "namespace"), "java": ("class", "interface", "enum", "record"), "go": (), "rust": ("trait", "mod"),
    "cpp": ("class", "struct", "namespace", "union"), "swift": ("class", "struct", "enum", "extension", "protocol", "actor"),
}
_NEW_LINE_ENDS = frozenset(("js", "go", "swift"))

_C_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_STRING = r'"(?:\\.|[^"\\\n])*"?'
_CHAR = r"'(?:\\.[^']{0,8}|[^'\\\n])'"
_LONG = r'"""(?:\\.|[^\\])*?(?:"""|\Z)'
_REST = r"[A-Za-z_$\u0080-\uffff][\w$]*[!?]?(?=\W|\Z)|[A-Za-z_$\u0080-\uffff][\w$]*|\d[\w.]*|=>|->|::|\?\.|\?\?|&&|\|\||:=|[^\s\w]"
_NAME = r"[A-Za-z_$\u0080-\uffff][\w$]*|\d[\w.]*|=>|->|::|\?\.|\?\?|&&|\|\||:=|[^\s\w]"
_JS_REGEX = r"(?<=[=(,:\[!&|?{};\n])\s*/(?![/*\s])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
_TOKENS = {
    "js": rf"(?P<skip>{_C_COMMENT}|{_STRING}|'(?:\\.|[^'\\\n])*'?|{_JS_REGEX})|(?P<tick>`)|(?P<tok>{_NAME})|(?P<nl>\n)",
    "java": rf"(?P<skip>{_C_COMMENT}|{_LONG}|{_STRING}|{_CHAR})|(?P<tok>{_NAME})|(?P<nl>\n)",
    "go": rf"(?P<skip>{_C_COMMENT}|`[^`]*(?:`|\Z)|{_STRING}|{_CHAR})|(?P<tok>{_NAME})|(?P<nl>\n)",
    "rust": rf'(?P<skip>{_C_COMMENT}|b?r(?P<h>#*)".*?"(?P=h)|b?{_STRING}|b?{_CHAR})|(?P<tok>{_NAME})|(?P<nl>\n)',
    "cpp": rf'(?P<skip>{_C_COMMENT}|^[ \t]*#[^\n]*(?:\\\n[^\n]*)*|R"(?P<d>[^(\s]*)\(.*?\)(?P=d)"|{_STRING}|{_CHAR})|(?P<tok>{_NAME})|(?P<nl>\n)',
    "swift": rf"(?P<skip>{_C_COMMENT}|{_LONG}|{_STRING})|(?P<tok>{_NAME})|(?P<nl>\n)",
    "python": r"(?P<skip>#[^\n]*|(?:\b[rRbBuUfF]{1,2})?(?:\"\"\"(?:\\.|[^\\])*?(?:\"\"\"|\Z)|'''(?:\\.|[^\\])*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|\\\n)" + rf"|(?P<tok>{_NAME})|(?P<nl>\n)",
    "ruby": r"(?P<skip>^=begin\b.*?(?:^=end\b|\Z)|#[^\n]*|\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?)" + rf"|(?P<tok>{_REST})|(?P<nl>\n)",
}
_SCAN = {k: re.compile(p, re.S | re.M) for k, p in _TOKENS.items()}


@dataclass
class Function:
    name: str
    class_name: str | None
    start: int
    at: int
    end: int
    is_async: bool
    complexity: int = 1


@dataclass
class Scan:
    functions: list[Function] = field(default_factory=list)
    #: (index of the calling function, callee, object or None, place, kind of call)
    calls: list[tuple[int, str, str | None, int, str]] = field(default_factory=list)


def _tokens(text: str, lang: str) -> tuple[list[str], list[int]]:
    """Tokens and their places; line ends come as '\\n'. A JavaScript template is skipped but for what it holds in ${}."""
    out: list[str] = []
    at: list[int] = []
    pos, n, scan = 0, len(text), _SCAN[lang]
    ticks: list[int] = []
    depth = 0
    while pos < n:
        m = scan.search(text, pos)
        if m is None:
            break
        pos = m.end()
        kind = m.lastgroup
        if kind in ("h", "d"):
            kind = "skip"
        if kind == "nl":
            out.append("\n")
            at.append(m.start())
        elif kind == "tok":
            x = m.group()
            if ticks and x == "{":
                depth += 1
            elif ticks and x == "}":
                if depth == ticks[-1]:
                    ticks.pop()
                    out.append(")")
                    at.append(m.start())
                    pos = _template(text, pos, out, at)
                    if text[pos - 1 : pos] == "{":
                        ticks.append(depth)
                    continue
                depth -= 1
            out.append(x)
            at.append(m.start())
        elif kind == "tick":
            pos = _template(text, pos, out, at)
            if text[pos - 1 : pos] == "{":
                ticks.append(depth)
    return out, at


_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(?:`|\$\{|\Z)", re.S)


def _template(text: str, pos: int, out: list[str], at: list[int]) -> int:
    """The place after the next end of a template or opening of a hole in it; a hole is put in round brackets."""
    end = _TEMPLATE.match(text, pos).end()
    if text[end - 1 : end] == "{":
        out.append("(")
        at.append(end - 1)
    return end


_IS_NAME = re.compile(r"[A-Za-z_$\u0080-\uffff][\w$]*[!?]?\Z").match


def scan(text: str, lang: str) -> Scan:
    t, at = _tokens(text, lang)
    found = {"python": _python, "ruby": _ruby}.get(lang, _braces)(t, at, len(text), lang)
    return found


class _Open:
    """Functions under construction and the calls that go to the innermost."""

    def __init__(self, t: list[str], at: list[int]):
        self.t, self.at, self.out, self.names, self.stack = t, at, Scan(), set(), []

    def begin(self, name: int, cls: str | None, start: int, is_async: bool) -> int:
        self.out.functions.append(Function(self.t[name], cls, self.at[start], self.at[name], -1, is_async))
        self.names.add(name)
        self.stack.append(len(self.out.functions) - 1)
        return self.stack[-1]

    def finish(self, end: int) -> None:
        self.out.functions[self.stack.pop()].end = end

    def token(self, i: int) -> None:
        if not self.stack:
            return
        t, x = self.t, self.t[i]
        if x in _DECIDE:
            self.out.functions[self.stack[-1]].complexity += 1
        if i + 1 < len(t) and t[i + 1] == "(" and i not in self.names and x not in _WORDS and _IS_NAME(x):
            before = t[i - 1] if i else ""
            dotted = before in (".", "?.", "::", "->") and i > 1
            if x in IGNORED and not dotted:
                return
            obj = t[i - 2] if dotted and _IS_NAME(t[i - 2]) else None
            kind = "constructor" if before == "new" else "method" if dotted else "direct"
            first = i - 2 if obj else i
            if first and t[first - 1] == "await":
                kind = "await"
            self.out.calls.append((self.stack[-1], x, obj, self.at[i], kind))


def _header(t: list[str], start: int, i: int, lang: str) -> tuple[str, int, str | None, bool]:
    """(kind, index of the name, class, async) of the block that opens at i; kind is class, function, object or block."""
    h = range(start, i)
    last = t[i - 1] if i > start else ""
    words = {t[j] for j in h}
    is_async = "async" in words
    if lang == "go":
        for j in reversed(h):
            if t[j] == "func":
                if j + 1 < i and t[j + 1] == "(":
                    k = _closing(t, j + 1, i)
                    if k + 2 < i and _IS_NAME(t[k + 1]) and t[k + 2] in ("(", "["):
                        inner = [t[x] for x in range(j + 2, k) if _IS_NAME(t[x])]
                        return "function", k + 1, inner[-1] if inner else None, False
                    return "block", -1, None, False
                if j + 1 < i and _IS_NAME(t[j + 1]):
                    return "function", j + 1, None, False
                return "block", -1, None, False
        return "block", -1, None, False
    if lang == "rust":
        for j in reversed(h):
            if t[j] == "fn" and j + 1 < i:
                return "function", j + 1, None, is_async
            if t[j] == "impl":
                names, depth = [], 0
                for k in range(j + 1, i):
                    depth += (t[k] == "<") - (t[k] == ">")
                    if t[k] == "for" and not depth:
                        names = []
                    elif t[k] == "where":
                        break
                    elif not depth and _IS_NAME(t[k]):
                        names.append(t[k])
                return "class", -1, names[-1] if names else None, False
            if t[j] in _CLASS[lang] and j + 1 < i and _IS_NAME(t[j + 1]):
                return "class", j + 1, t[j + 1] if t[j] == "trait" else None, False
        return "block", -1, None, False
    if lang == "swift":
        for j in reversed(h):
            if t[j] == "func" and j + 1 < i:
                return "function", j + 1, None, is_async
            if t[j] in ("init", "deinit") and (t[j] == "deinit" or j + 1 < i and t[j + 1] in ("(", "?", "<")) and (j == start or t[j - 1] != "."):
                return "function", j, None, is_async
    for j in h:
        if t[j] in _CLASS[lang] and j + 1 < i and _IS_NAME(t[j + 1]) and (j == start or t[j - 1] != "."):
            if lang == "cpp" and "(" in {t[k] for k in range(j, i)}:
                break
            k = j + 1
            while lang == "cpp" and k + 2 < i and t[k + 1] == "::":
                k += 2
            return "class", k, None if t[j] == "namespace" else t[k], False
    if lang == "js":
        for j in reversed(h):
            if t[j] == "function":
                k = j + 2 if j + 1 < i and t[j + 1] == "*" else j + 1
                if k < i and _IS_NAME(t[k]):
                    return "function", k, None, is_async
                return ("function", *_assigned(t, start, j), is_async) if last == ")" or ":" in words else ("block", -1, None, False)
        if last == "=>":
            return "function", *_assigned(t, start, i), is_async
    if lang in ("js", "java", "cpp") and "(" in words:
        if lang == "cpp":
            j = next(k for k in h if t[k] == "(")
        else:
            k = i - 1
            while k > start and t[k] != ")":
                k -= 1
            depth, j = 0, -1
            for x in range(k, start - 1, -1):
                depth += (t[x] == ")") - (t[x] == "(")
                if not depth:
                    j = x
                    break
        name = j - 1
        if lang == "js" and name > start and t[name] == ">":
            depth = 0
            while name > start:
                depth += (t[name] == ">") - (t[name] == "<")
                name -= 1
                if not depth:
                    break
        if name >= start and _IS_NAME(t[name]) and t[name] not in _WORDS and (name == start or t[name - 1] not in (".", "new", "=", "@", "?.")):
            cls = t[name - 2] if lang == "cpp" and name - 2 >= start and t[name - 1] == "::" else None
            return "method", name, cls, is_async
    return ("object" if last in ("=", "(", ",", ":", "return", "[", "?") else "block"), -1, None, False


def _assigned(t: list[str], start: int, i: int) -> tuple[int, None]:
    """The name that a function literal is given: const name = ..., name: ... or name = ... as a field; -1 if none."""
    j = start
    while j < i and t[j] in ("export", "default", "const", "let", "var", "public", "private", "protected", "readonly", "static", "declare"):
        j += 1
    if j + 1 < i and _IS_NAME(t[j]) and t[j] not in _WORDS and t[j + 1] in ("=", ":"):
        depth = 0
        for k in range(j + 1, i):
            depth += (t[k] in "([{") - (t[k] in ")]}")
            if t[k] in ("&&", "||", "??"):
                return -1, None
            if t[k] == "(" and k > j + 2 and depth == 1 and _IS_NAME(t[k - 1]) and t[k - 1] not in ("async", "function"):
                return -1, None
        return j, None
    return -1, None


def _closing(t: list[str], i: int, end: int) -> int:
    depth = 0
    for k in range(i, end):
        depth += (t[k] == "(") - (t[k] == ")")
        if not depth:
            return k
    return end


_GOES_ON = frozenset(". ?. => = + - * / % & | && || ?? ? : , < > ( [ { ! -> :: ^ ~".split()) | {"else", "extends", "implements", "throws", "where", "of", "in", "instanceof"}


def _braces(t: list[str], at: list[int], length: int, lang: str) -> Scan:
    f = _Open(t, at)
    # frames: (bracket, kind, class, whether a function ends with it); starts: where each frame's statement begins
    frames: list[tuple[str, str, str | None, bool]] = [("", "block", None, False)]
    starts = [0]
    arrows: list[int] = []
    clean: list[str] = []
    where: list[int] = []
    line_before: list[bool] = []
    broke = False
    for x, p in zip(t, at):
        if x == "\n":
            broke = True
        else:
            clean.append(x)
            where.append(p)
            line_before.append(broke)
            broke = False
    f.t, f.at = t, at = clean, where

    def close_arrows(i: int) -> None:
        while arrows and arrows[-1] == len(frames):
            arrows.pop()
            f.finish(at[i - 1] + len(t[i - 1]))

    for i, x in enumerate(t):
        ends_line = lang in _NEW_LINE_ENDS and line_before[i] and i and frames[-1][0] != "(" and t[i - 1] not in _GOES_ON and x not in _GOES_ON and x != "{"
        if ends_line:
            close_arrows(i)
            if not (lang == "js" and frames[-1][1] == "class" and t[i - 1] == ")"):
                starts[-1] = i
        if x == ";" or (x == "," and frames[-1][0] != "{"):
            close_arrows(i)
            starts[-1] = i + 1
        elif x == "," and frames[-1][1] == "object":
            close_arrows(i)
            starts[-1] = i + 1
        elif x == ":" and lang == "cpp" and i and t[i - 1] in ("public", "private", "protected"):
            starts[-1] = i + 1
        elif x in ("(", "["):
            frames.append(("(", "group", None, False))
            starts.append(i + 1)
        elif x in (")", "]"):
            close_arrows(i)
            if len(frames) > 1 and frames[-1][0] == "(":
                frames.pop()
                starts.pop()
        elif x == "{":
            last = t[i - 1] if i else ""
            if lang == "js" and last in (":", "|", "&", "<", "extends") and frames[-1][1] != "object" and starts[-1] < i - 1:
                frames.append(("{", "type", None, False))
                starts.append(i + 1)
                f.token(i)
                continue
            kind, name, cls, is_async = _header(t, starts[-1], i, lang)
            inside = frames[-1][1]
            if kind == "method":
                kind = "function" if inside in ("class", "object") or (lang == "cpp" and inside in ("block", "class") and not f.stack) else "block"
            opened = False
            if kind == "function":
                if name >= 0:
                    owner = cls
                    if owner is None and not f.stack or owner is None and inside == "class":
                        owner = next((c for b, k, c, e in reversed(frames) if k == "class"), None)
                    first = starts[-1]
                    while first < name and t[first] in ("export", "default", "declare"):
                        first += 1
                    f.begin(name, owner, min(first, name), is_async)
                    opened = True
                else:
                    kind = "block"
            label = cls if kind == "class" and name < 0 else t[name] if kind == "class" and name >= 0 and cls is not None else None
            frames.append(("{", kind if kind in ("class", "object") else "block", label, opened))
            starts.append(i + 1)
        elif x == "}":
            close_arrows(i)
            while len(frames) > 1 and frames[-1][0] == "(":
                frames.pop()
                starts.pop()
                close_arrows(i)
            if len(frames) > 1:
                _, kind, _, opened = frames.pop()
                starts.pop()
                if opened:
                    f.finish(at[i] + 1)
                if kind != "type" and frames[-1][0] != "(":
                    starts[-1] = i + 1
        elif x == "=>" and lang == "js" and i + 1 < len(t) and t[i + 1] != "{":
            name, _ = _assigned(t, starts[-1], i)
            if name >= 0 and frames[-1][1] != "type":
                owner = next((c for b, k, c, e in reversed(frames) if k == "class"), None) if frames[-1][1] == "class" else None
                f.begin(name, owner, min(starts[-1], name), "async" in t[starts[-1] : i])
                arrows.append(len(frames))
        f.token(i)
    while f.stack:
        f.finish(length)
    return f.out


def _python(t: list[str], at: list[int], length: int, lang: str) -> Scan:
    f = _Open(t, at)
    frames: list[tuple[int, str, str]] = []
    depth, fresh, line_start, last = 0, True, 0, 0
    for i, x in enumerate(t):
        if x == "\n":
            line_start = at[i] + 1
            if not depth:
                fresh = True
            continue
        if fresh:
            fresh = False
            indent = at[i] - line_start
            while frames and frames[-1][0] >= indent:
                if frames.pop()[1] == "def":
                    f.finish(last)
            j = i + 1 if x == "async" else i
            if j + 1 < len(t) and t[j] in ("def", "class") and _IS_NAME(t[j + 1]):
                if t[j] == "def":
                    cls = frames[-1][2] if frames and frames[-1][1] == "class" else None
                    f.begin(j + 1, cls, i, x == "async")
                frames.append((indent, t[j], t[j + 1]))
        depth = max(0, depth + (x in "([{") - (x in ")]}")) if len(x) == 1 else depth
        last = at[i] + len(x)
        f.token(i)
    while f.stack:
        f.finish(max(last, 0))
    return f.out


_RUBY_OPEN = frozenset(("def", "class", "module", "begin", "do", "case"))
_RUBY_AT_START = frozenset(("if", "unless", "while", "until", "for"))


def _ruby(t: list[str], at: list[int], length: int, lang: str) -> Scan:
    f = _Open(t, at)
    frames: list[tuple[str, str | None]] = []
    loop_line = one_line = False
    for i, x in enumerate(t):
        before = t[i - 1] if i else "\n"
        fresh = before in ("\n", ";")
        if x == "\n":
            loop_line = False
            if one_line:
                one_line = False
                f.finish(at[i])
            continue
        if before in (".", "?.", "::", ":") or (i + 1 < len(t) and t[i + 1] == ":" and x not in ("else",)):
            f.token(i)
            continue
        if x in _RUBY_OPEN and not (x == "do" and loop_line):
            label = None
            if x in ("class", "module") and i + 1 < len(t) and _IS_NAME(t[i + 1]):
                j = i + 1
                while j + 2 < len(t) and t[j + 1] == "::":
                    j += 2
                label = t[j]
            if x == "def" and i + 1 < len(t):
                j = i + 3 if i + 3 < len(t) and t[i + 2] == "." else i + 1
                f.begin(j, next((c for k, c in reversed(frames) if k in ("class", "module") and c), None), i, False)
                k = j + 1
                if k < len(t) and t[k] == "(":
                    k = _closing(t, k, len(t)) + 1
                if k < len(t) and t[k] == "=":
                    # def name(..) = value, without an end
                    one_line = True
                    continue
            frames.append((x, label))
        elif x in _RUBY_AT_START and (fresh or before in ("=", "else", "then")):
            frames.append((x, None))
            loop_line = x in ("while", "until", "for")
        elif x == "end" and frames:
            if frames.pop()[0] == "def":
                f.finish(at[i] + 3)
        f.token(i)
    while f.stack:
        f.finish(length)
    return f.out


class Lines:
    """Line numbers, from 1, of places in a text."""

    def __init__(self, text: str):
        self.starts = [0] + [m.end() for m in re.finditer(r"\r\n|\r|\n", text)]

    def of(self, place: int) -> int:
        return bisect.bisect_right(self.starts, place)
