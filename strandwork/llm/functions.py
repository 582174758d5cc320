"""Functions of source files with their documentation.

The documentation of a function is the comment right above its declaration (in Python the text that opens its body), with
nothing but decorators, annotations and directives between.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from strandwork.llm.doctext import _DIRECTIVE
from strandwork.llm.parsing.functions import go_functions, java_functions, js_functions, python_functions
from strandwork.llm.parsing.lexers import Lexed, Lines

@dataclass(frozen=True)
class Found:
    name: str
    line: int
    start: int
    end: int
    doc: str


class _Above:
    """The documentation that stands right above a position."""

    def __init__(self, t: Lexed):
        self.t = t
        self.ends = {b: a for a, b in t.comments}

    def block(self, start: int) -> str:
        """The /** */ comment before start, over directives, without a blank line."""
        text = self.t.text
        at = start
        while True:
            e = len(text[:at].rstrip())
            if _blank_line(text[e:at]) or e not in self.ends:
                return ""
            a = self.ends[e]
            comment = text[a:e]
            if comment.startswith("/**") and len(comment) > 4:
                return comment
            if not _DIRECTIVE.match(re.sub(r"^(?://+|/\*+)[ \t@]*", "", comment)):
                return ""
            at = a

    def group(self, start: int) -> str:
        """The comment lines before start, without a blank line among them, each first on its line."""
        text = self.t.text
        got: list[str] = []
        at = start
        while True:
            e = len(text[:at].rstrip())
            if _blank_line(text[e:at]) or e not in self.ends:
                break
            a = self.ends[e]
            if re.split(r"[\r\n]", text[:a])[-1].strip():
                break
            got.append(text[a:e])
            at = a
        return "\n".join(reversed(got))


def _blank_line(gap: str) -> bool:
    return len(re.findall(r"\r\n|\r|\n", gap)) > 1


def find_functions(t: Lexed, kind: str) -> list[Found]:
    """All functions and methods with a body, in the order of their names' places."""
    lines, above = Lines(t.text), _Above(t)
    out = []
    if kind == "python":
        for name, first, last, doc in python_functions(t):
            end = t.starts[last] + len(t.texts[last])
            out.append(Found(t.texts[name], lines.of(t.starts[name]), t.starts[first], end, doc))
        return sorted(out, key=lambda f: (f.line, f.start))
    finder = {"go": go_functions, "java": java_functions}.get(kind, js_functions)
    for name, first, last in finder(t):
        start, end = t.starts[first], t.starts[last] + len(t.texts[last])
        doc = above.group(start) if kind == "go" else above.block(start)
        out.append(Found(t.texts[name], lines.of(t.starts[name]), start, end, doc))
    return sorted(out, key=lambda f: (f.line, f.start))
