"""Packrat parsers from parsing-expression grammars over tokens.

A grammar is text, one rule a line: ``Rule <- expression`` with sequence, ordered choice ``/``, ``* + ?``, the
look-aheads ``& !`` and brackets. Terminals: ``'x'`` the token of kind x, ``"x"`` a name spelt x, UPPER a kind of token,
``@NL`` / ``@NONL`` a line end or none before the next token, ``@ADJ`` no space before the next token. A rule is turned
into a Python function with a memo by position, so that parsing takes linear time; before an alternative is tried, the
next token's kind is looked up among those it can begin with. The greatest position at which a token was refused is kept
as the place of the error.
"""

from __future__ import annotations

import re
import sys

_ITEM = re.compile(r"\s*(?:(?P<lit>'[^']+')|(?P<word>\"[^\"]+\")|(?P<pred>@[A-Z]+)|(?P<kind>[A-Z][A-Z_]*\b(?![a-z]))|(?P<rule>[A-Z]\w*)|(?P<op>[()/*+?!&]))")


def _parse(text: str, rule: str):
    pos = 0

    def peek():
        m = _ITEM.match(text, pos)
        if m is None and text[pos:].strip():
            raise ValueError(f"{rule}: {text[pos:]}")
        return m

    def choice():
        nonlocal pos
        alts = [sequence()]
        while (m := peek()) and m["op"] == "/":
            pos = m.end()
            alts.append(sequence())
        return alts[0] if len(alts) == 1 else ("choice", alts)

    def sequence():
        nonlocal pos
        items = []
        while (m := peek()) and m["op"] not in ("/", ")"):
            items.append(prefixed())
        return items[0] if len(items) == 1 else ("seq", items)

    def prefixed():
        nonlocal pos
        m = peek()
        if m["op"] in ("!", "&"):
            pos = m.end()
            return ("not" if m["op"] == "!" else "and", prefixed())
        e = primary()
        while (m := peek()) and m["op"] in ("*", "+", "?"):
            pos = m.end()
            e = ({"*": "star", "+": "plus", "?": "opt"}[m["op"]], e)
        return e

    def primary():
        nonlocal pos
        m = peek()
        pos = m.end()
        if m["lit"]:
            return ("tok", m["lit"][1:-1])
        if m["word"]:
            return ("word", m["word"][1:-1])
        if m["pred"]:
            return ("pred", m["pred"][1:])
        if m["kind"]:
            return ("tok", m["kind"])
        if m["rule"]:
            return ("rule", m["rule"])
        if m["op"] == "(":
            e = choice()
            pos = peek().end()
            return e
        raise ValueError(f"{rule}: {m.group()}")

    e = choice()
    if text[pos:].strip():
        raise ValueError(f"{rule}: {text[pos:]}")
    return e


class Grammar:
    """A compiled grammar; parse(tokens) gives (whether all input was consumed, furthest position)."""

    def __init__(self, text: str, start: str, classes: dict[str, set[str]] | None = None):
        self.classes = classes or {}
        self.rules = {}
        for line in re.sub(r"\n[ \t]+", " ", text).split("\n"):
            if line.strip() and not line.startswith("#"):
                name, body = line.split("<-", 1)
                self.rules[name.strip()] = _parse(body, name.strip())
        self._prune(start)
        self._first_sets()
        self._n = 0
        code = ["def make(T, V, NL, ADJ, F):"]
        for name in self.rules:
            code.append(f" M_{name} = {{}}")
        for name, e in self.rules.items():
            body: list[str] = []
            self._emit(e, "p", "q", body, 2)
            code += [f" def R_{name}(p):", f"  q = M_{name}.get(p)", "  if q is not None: return q", *body, f"  M_{name}[p] = q", "  return q"]
        code.append(f" return R_{start}")
        self.source = "\n".join(code)
        space: dict = {"K": self._sets}
        exec(compile(self.source, f"<grammar {start}>", "exec"), space)  # noqa: S102 - built from the grammar above
        self._make = space["make"]

    def _prune(self, start: str) -> None:
        """Keep the rules that the start leads to."""
        todo, seen = [("rule", start)], set()
        while todo:
            kind, x = todo.pop()
            if kind == "rule" and x not in seen:
                if x not in self.rules:
                    raise ValueError(f"no rule {x}")
                seen.add(x)
                todo.append(self.rules[x])
            elif kind in ("seq", "choice"):
                todo += x
            elif kind in ("star", "plus", "opt", "not", "and"):
                todo.append(x)
        self.rules = {r: e for r, e in self.rules.items() if r in seen}

    def _first_sets(self) -> None:
        self.first = {r: set() for r in self.rules}
        self.null = {r: False for r in self.rules}
        self._sets: list[frozenset] = []
        changed = True
        while changed:
            changed = False
            for r, e in self.rules.items():
                f, n = self._first(e)
                if f - self.first[r] or n != self.null[r]:
                    self.first[r] |= f
                    self.null[r] = n or self.null[r]
                    changed = True

    def _first(self, e) -> tuple[set[str], bool]:
        kind, x = e
        if kind == "tok":
            return set(self.classes.get(x, {x})), False
        if kind == "word":
            return {"NAME"}, False
        if kind in ("pred", "not", "and"):
            return set(), True
        if kind == "rule":
            return self.first[x], self.null[x]
        if kind in ("star", "opt"):
            return self._first(x)[0], True
        if kind == "plus":
            return self._first(x)
        parts = [self._first(y) for y in x]
        if kind == "choice":
            return set().union(*(f for f, _ in parts)), any(n for _, n in parts)
        out: set[str] = set()
        for f, n in parts:
            out |= f
            if not n:
                return out, False
        return out, True

    def _test(self, e, p: str) -> str | None:
        """A test of the next token that every match of e must pass."""
        f, n = self._first(e)
        if n or not f:
            return None
        if len(f) == 1:
            return f"T[{p}] == {next(iter(f))!r}"
        s = frozenset(f)
        if s not in self._sets:
            self._sets.append(s)
        return f"T[{p}] in K[{self._sets.index(s)}]"

    def _var(self) -> str:
        self._n += 1
        return f"v{self._n}"

    def _emit(self, e, p: str, q: str, out: list[str], d: int) -> None:
        """Code that matches e at p and leaves the end, or -1, in q."""
        pad = " " * d
        kind, x = e
        if kind in ("tok", "word"):
            test = self._test(e, p) if kind == "tok" else f"T[{p}] == 'NAME' and V[{p}] == {x!r}"
            out += [f"{pad}if {test}: {q} = {p} + 1", f"{pad}else:", f"{pad} {q} = -1", f"{pad} if {p} > F[0]: F[0] = {p}"]
        elif kind == "pred":
            test = {"NL": f"NL[{p}]", "NONL": f"not NL[{p}]", "ADJ": f"ADJ[{p}]"}[x]
            out += [f"{pad}{q} = {p} if {test} else -1"]
        elif kind == "rule":
            out += [f"{pad}{q} = R_{x}({p})"]
        elif kind in ("not", "and"):
            v, w = self._var(), self._var()
            # what a look-ahead refuses is not where the text goes wrong
            out += [f"{pad}{w} = F[0]"]
            self._emit(x, p, v, out, d)
            out += [f"{pad}F[0] = {w}", f"{pad}{q} = {p} if {v} {'<' if kind == 'not' else '>='} 0 else -1"]
            if kind == "and":
                out += [f"{pad}if {q} < 0 and {p} > F[0]: F[0] = {p}"]
        elif kind == "opt":
            v, test = self._var(), self._test(x, p)
            if test:
                out += [f"{pad}{q} = {p}", f"{pad}if {test}:"]
                self._emit(x, p, v, out, d + 1)
                out += [f"{pad} if {v} >= 0: {q} = {v}"]
            else:
                self._emit(x, p, v, out, d)
                out += [f"{pad}{q} = {v} if {v} >= 0 else {p}"]
        elif kind in ("star", "plus"):
            at, v = self._var(), self._var()
            test = self._test(x, at) or "True"
            out += [f"{pad}{at} = {p}", f"{pad}while {test}:"]
            self._emit(x, at, v, out, d + 1)
            out += [f"{pad} if {v} <= {at}: break", f"{pad} {at} = {v}"]
            if kind == "star":
                out += [f"{pad}{q} = {at}"]
            else:
                out += [f"{pad}if {at} > {p}: {q} = {at}", f"{pad}else:", f"{pad} {q} = -1", f"{pad} if {p} > F[0]: F[0] = {p}"]
        elif kind == "seq":
            if not x:
                out += [f"{pad}{q} = {p}"]
                return
            at, last = p, len(x) - 1
            for i, y in enumerate(x):
                v = q if i == last else self._var()
                self._emit(y, at, v, out, d + i)
                if i != last:
                    out += [f"{' ' * (d + i)}if {v} < 0: {q} = -1", f"{' ' * (d + i)}else:"]
                at = v
        elif kind == "choice":
            out += [f"{pad}{q} = -1"]
            for i, y in enumerate(x):
                test = self._test(y, p)
                tests = [t for t in (f"{q} < 0" if i else None, test) if t]
                if tests:
                    out += [f"{pad}if {' and '.join(tests)}:"]
                    self._emit(y, p, q, out, d + 1)
                else:
                    self._emit(y, p, q, out, d)
            out += [f"{pad}if {q} < 0 and {p} > F[0]: F[0] = {p}"]

    def parse(self, kinds: list[str], texts: list[str], newline: list[bool], adjacent: list[bool]) -> tuple[bool, int]:
        """kinds must end with 'EOF'."""
        far = [0]
        old = sys.getrecursionlimit()
        # frames live on the heap; no grammar nests deeper than this for a token
        sys.setrecursionlimit(max(old, 40 * len(kinds) + 10_000))
        try:
            end = self._make(kinds, texts, newline, adjacent, far)(0)
        finally:
            sys.setrecursionlimit(old)
        return end >= 0, far[0]
