import ast
import json
import os
import random
import string

import pytest

from strandwork.llm import bpe, langid, packing, source
from strandwork.llm.doctext import informative
from strandwork.llm.functions import find_functions
from strandwork.llm.syntax.check import check, parse

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="needs the public vocabulary")


# -- p8 ------------------------------------------------------------------------------------------------------------


def junk(seed, n=200):
    r = random.Random(seed)
    pick = lambda: chr(r.choice([r.randrange(1, 128), r.randrange(0x80, 0xD7FF), r.randrange(0xE000, 0x1FFFF)]))
    return ["".join(pick() for _ in range(r.randrange(1, 120))) for _ in range(n)]


TEXTS = [None, "", " ", "\n\n", "Hello  world", "<|endoftext|> as text", "a" * 30_000, " " * 5000, "naïve 日本語 🙂👩‍👩‍👧‍👦", "x\0y▁z", "it's we'll 123abc"] + junk(1)


def test_ids_match_other_encoders_and_round_trip():
    tiktoken = pytest.importorskip("tiktoken")
    e = bpe.Encoder(bpe.VOCABULARY)
    other = tiktoken.Encoding("own", pat_str=bpe.PRE_TOKEN, mergeable_ranks={t: i for i, t in enumerate(e.vocabulary)}, special_tokens={})
    for t in TEXTS:
        ids = e.encode(t)
        assert e.decode(ids) == (t or "")
        if t and len(t) < 10_000:
            assert ids == other.encode_ordinary(t)


def test_encode_table(spark):
    docs = spark.createDataFrame([(i, t, "en", [1]) for i, t in enumerate(TEXTS)] + [(None, "x", "en", [1])], "doc_id long, text string, lang string, ids array<int>")
    out = bpe.encode_texts(docs)
    assert dict(out.dtypes)["ids"] == "array<int>"
    got = {r["doc_id"]: r["ids"] for r in out.collect()}
    assert got[0] == [] and got[1] == [] and len(got) == len(TEXTS) + 1
    back = {r["doc_id"]: r["text"] for r in bpe.decode_ids(out).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert bpe.encode_texts(docs.limit(0)).collect() == []


# -- p9 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(8))
def test_plan_uses_every_item_once(seed):
    r = random.Random(seed)
    low = [1, 300, 700, 1025][seed % 4]
    histogram = {r.randrange(low, 2049): r.randrange(1, 60) for _ in range(120)}
    plan, _ = packing.plan_containers(histogram)
    used = {}
    for group, times in plan:
        assert sum(group) <= packing.CAPACITY and times > 0
        for s in group:
            used[s] = used.get(s, 0) + times
    assert used == histogram
    # first fit decreasing as a yardstick
    free = []
    for s in sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True):
        k = next((i for i, f in enumerate(free) if f >= s), None)
        if k is None:
            free.append(packing.CAPACITY - s)
        else:
            free[k] -= s
    assert sum(n for _, n in plan) <= len(free) * 1.01 + 1


def test_reduction_is_optimal_on_small_instances():
    from functools import lru_cache

    def best(items, capacity):
        items = tuple(sorted(items, reverse=True))

        @lru_cache(None)
        def can(i, free):
            if i == len(items):
                return True
            return any(can(i + 1, tuple(sorted(free[:k] + (free[k] - items[i],) + free[k + 1 :]))) for k in range(len(free)) if free[k] >= items[i])

        n = 1
        while not can(0, (capacity,) * n):
            n += 1
        return n

    for seed in range(25):
        r = random.Random(seed)
        items = [r.randrange(3, 20) for _ in range(9)]
        counts = {}
        for s in items:
            counts[s] = counts.get(s, 0) + 1
        left = dict(counts)
        fixed = packing._reduce(left, 20)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(n for _, n in fixed) + (best(rest, 20) if rest else 0) == best(items, 20)


def test_fill(spark):
    r = random.Random(2)
    items = [(i, r.choice([None, 0, -3, 1, 2048, 2049, 5000, r.randrange(1, 900)]), "pos") for i in range(500)] + [(7, 12, "again"), (7, 12, "again")]
    df = spark.createDataFrame(items, "doc_id long, n_tokens int, position string").repartition(4)
    out = packing.fill_containers(df).collect()
    total = {}
    for _, n, _ in items:
        total["sum"] = total.get("sum", 0) + max(n or 0, 0)
    assert sum(o["n_tokens"] for o in out) == total["sum"]
    filling, places = {}, set()
    for o in out:
        filling[o["container_id"]] = filling.get(o["container_id"], 0) + o["n_tokens"]
        assert (o["container_id"], o["position"]) not in places
        places.add((o["container_id"], o["position"]))
    assert max(filling.values()) <= 2048 and set(filling) == set(range(len(filling)))
    for c in filling:
        assert sorted(p for k, p in places if k == c) == list(range(sum(k == c for k, _ in places)))
    split = {}
    for o in out:
        split.setdefault(o["doc_id"], []).append((o["first_token"], o["n_tokens"]))
    for i, n, _ in items:
        if n and n > 0 and i != 7:
            parts = sorted(split[i])
            assert len(parts) == -(-n // 2048) and parts[0][0] == 0
            assert all(a + b == c for (a, b), (c, _) in zip(parts, parts[1:])) and sum(parts[-1]) == n
    assert packing.fill_containers(df.limit(0)).collect() == []


# -- p10 -----------------------------------------------------------------------------------------------------------

PROSE = {
    "en": ["The reviewers could not follow the reasoning because the log was missing.", "Nobody wants to rebuild the whole table before the next release is out."],
    "de": ["Die Prüfer konnten der Begründung nicht folgen, weil das Protokoll fehlte.", "Niemand möchte die ganze Tabelle vor der nächsten Ausgabe neu aufbauen."],
    "fr": ["Les relecteurs ne pouvaient pas suivre le raisonnement parce que le journal manquait.", "Personne ne veut reconstruire toute la table avant la prochaine version."],
    "es": ["Los revisores no podían seguir el razonamiento porque faltaba el registro.", "Nadie quiere reconstruir toda la tabla antes de la próxima versión."],
    "pt": ["Os revisores não conseguiam acompanhar o raciocínio porque faltava o registro.", "Ninguém quer reconstruir a tabela inteira antes da próxima versão."],
    "it": ["I revisori non potevano seguire il ragionamento perché mancava il registro.", "Nessuno vuole ricostruire tutta la tabella prima della prossima versione."],
    "nl": ["De beoordelaars konden de redenering niet volgen omdat het logboek ontbrak.", "Niemand wil de hele tabel opnieuw opbouwen voor de volgende uitgave."],
    "ru": ["Проверяющие не могли следить за ходом мысли, потому что журнал отсутствовал.", "Никто не хочет перестраивать всю таблицу до следующего выпуска."],
    "ja": ["記録がなかったため、確認の担当者は理由を追うことができませんでした。", "次の版の前に表をすべて作り直したい人は誰もいません。"],
}


@pytest.mark.parametrize(("label", "want"), [("EN", "en"), ("en-GB", "en"), ("Deutsch", "de"), ("français", "fr"), ("pt_BR", "pt"), ("jpn", "ja"), ("und", None), ("", None), (None, None), (" ", None), ("??", None), ("nld", "nl")])
def test_notation(label, want):
    assert langid.notation(label) == want


def corpus():
    r = random.Random(4)
    docs, want = [], set()
    for i in range(400):
        lang = r.choice(langid.LANGS)
        text = " ".join(r.choices(PROSE[lang], k=2))
        kind = i % 8
        label = lang
        if kind == 0:
            label = r.choice([None, "", "und"])
            want.add((i, 0, lang))
        elif kind == 1:
            label = r.choice([x for x in langid.LANGS if x != lang])
            want.add((i, 0, lang))
        elif kind == 2:
            other = r.choice([x for x in langid.LANGS if x != lang])
            text += r.choice([" ", "\n\n```\nfor (;;) {}\n```\n\n"]) + " ".join(PROSE[other])
            want |= {(i, 0, lang), (i, 1, other)}
        elif kind == 3:
            text = "# A heading\n\n" + text + "\n\n| a | b |\n|---|---|\n| the | of |\n"
        elif kind == 4 and lang != "ja":
            text = langid._bare(text).upper()
        elif kind == 5:
            text, label = r.choice([("", "en"), (None, None), ("OK", "fr"), ("LGTM 👍", None), ("\x07\n", "xx")])
        docs.append((i, text, label, "x", 0.5))
    return docs, want


def test_language_cases(spark):
    docs, want = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, label string, confidence double")
    got = {tuple(r) for r in langid.language_cases(df).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    every = langid.document_languages(df).collect()
    assert {r["doc_id"] for r in every} == {d[0] for d in docs}
    assert all(0 <= r["confidence"] <= 1 for r in every)
    assert langid.language_cases(df.limit(0)).collect() == []


def test_held_out_accuracy():
    r = random.Random(9)
    rows = [(PROSE[lang][0], lang) for lang in langid.LANGS for _ in range(20)]
    wrong = [(t, r.choice(langid.LANGS) if r.random() < 0.1 else lang) for t, lang in rows]
    m = langid.fit(wrong)
    assert all(langid.stretches(PROSE[lang][1], m)[0][0][0] == lang for lang in langid.LANGS)
    assert langid.stretches(None, m) == ([], False) and langid.stretches("123 !!", m) == ([], False)


# -- p6 ------------------------------------------------------------------------------------------------------------

GOOD = {
    "a.ts": ["", "// only\n", "﻿export const f = async <T,>(x: T): Promise<T> => x;", "abstract class A<T extends B> extends C<T> implements D { private x?: number; constructor(readonly a = 1) { super(); } get y(): string { return `${this.x}`; } static #p = 1; }", "type M<T> = { readonly [K in keyof T]?: T[K] extends infer U ? U : never };\nenum E { A = 1, B }", "let a = b as unknown as C<D<E>>;\nfor (const [k, v] of m) label: while (1) break label;", "declare module 'x' { export function f(a: number): void; }", "if (a / b > /[/]/.test(c)) x = y! ?? z?.[0]?.(1);"],
    "a.js": ["const a = { b, c() {}, get d() { return 1; }, [e]: async () => {}, ...f };\nlet x = 1\nlet y = 2", "export default class { static async *g() { yield* h(); } }", "import a, { b as c } from 'd';\nexport * as e from 'f';", "x = a\n++b", "async function f() { for await (const x of y) {} }", "var s = 'a\\\nb', r = /[({]/g;"],
    "a.py": ["", "def f(a, /, b=1, *c, d, **e) -> int: return lambda x, *y: (yield)\n", "match x:\n    case {'a': [1, *r]} if r: pass\n    case A(b=1) | None as c:\n        pass\n", "async def f():\n\tasync with a as b, c: pass\n\treturn [x async for x in y if x]\n", "x: int = 3; a.b[1:2, ::3] += f'{x!r:>{w}}'\n", "try:\n  pass\nexcept* (A, B) as e:\n  raise X from e\n"],
    "a.go": ["package p\nimport (\n\t\"a\"\n\tb \"c\"\n)\ntype T[K comparable, V any] struct { a, b int; *C }\nfunc (t *T[K, V]) F(x ...int) (r int, err error) {\n\tif v, ok := m[x[0]]; ok && v == (T{}) { return }\n\tfor i := range 10 { go func() { ch <- i }() }\n\tswitch y := z.(type) { case int: fallthrough; default: }\n\tselect { case <-ch: }\n\treturn map[string][]int{\"a\": {1}}[\"a\"][1:], nil\n}\n"],
    "A.java": ["package p; import static a.B.*; @A(x = {1, 2}) public sealed class C<T extends D & E> permits F { record R(int a, String... b) { R { } } enum G { X(1) { int y() { return 1; } }, Y; } int f(List<? super T> x) throws Z { var t = \"\"\"\n hi \"there\" \"\"\"; for (int i = 0, j = 1; i < 3; i++) { x.forEach(e -> { }); } return switch (o) { case R(int a, var b) when a > 1 -> a >> 2; case null, default -> { yield (int) 'c'; } }; } }"],
    "a.json": ['{"a": [1, -2.5e+3, null, true, "\\u00e9"]}', "﻿[]", " 0 "],
}
BAD = {
    "a.ts": ["function f( {", "const = 1;", "<<<<<<< ours\nlet a;\n=======\n>>>>>>> theirs\n", "let s = 'open;\n", "class A { m() { }", "/* open", "import json\nimport functools as f\n"],
    "a.js": ["let a: number = 1;", "function f(a b) {}", "x = {a: 1;}", "`${", "return return;", "interface A {}\n"],
    "a.py": ["def f(:\n  pass\n", "if x:\npass\n", "x = (1,\n", "x = 'a\n", "def f():\n\treturn\n  x\n", "1 = x\n", "print 'a'\n", "f(a=1, b)\n"],
    "a.go": ["func f() {}\n", "package p\nfunc f() {\n", "package p\nfunc f()\n{\n}\n", "package p\nx := 1\n", "package p\nvar s = \"a\n"],
    "A.java": ["class A {", "class A { int f() { return 1 } }", "class A { void f() { a + b; } }", "class A { String s = \"a; }", "class A { int = 5; }"],
    "a.json": ["", "{'a': 1}", "[1,]", "{\"a\": 01}", "[NaN]", "// c\n{}", "{} {}", '"\t"'],
}


@pytest.mark.parametrize("path", GOOD)
def test_grammars(path):
    for t in GOOD[path]:
        v = check(t, path)
        assert v.valid, (t, v)
    for t in BAD[path]:
        v = check(t, path)
        assert not v.valid and v.cause and v.line >= 1, t
    assert check(None, path) is None and check("x", "a.txt") is None and check("x", None) is None


def test_python_and_json_against_their_parsers():
    r = random.Random(6)
    base = "\n".join(GOOD["a.py"]) + "\nclass A(B, metaclass=C):\n    @d(1)\n    def f(self, *, x: int = 2): return self.g(x, *y, z=1, **w) if not x else {**a, 'b': (1,)}\n"
    for _ in range(400):
        i, j = sorted((r.randrange(len(base)), r.randrange(len(base))))
        t = base[:i] + r.choice(["", base[i : i + 3], *"()[]{}:,=.*"]) + base[i + r.randrange(3) :]
        try:
            ast.parse(t)
            want = True
        except (SyntaxError, ValueError):
            want = False
        assert parse(t, "python")[0] == want, t
    for _ in range(300):
        t = "".join(r.choice(['{', '}', '[', ']', ',', ':', '"a"', "1", "-", "null", " ", "e", "."]) for _ in range(r.randrange(1, 9)))
        try:
            json.loads(t)
            want = True
        except ValueError:
            want = False
        assert parse(t, "json")[0] == want, t


def test_deep_nesting_does_not_crash():
    assert check("[" * 3000 + "]" * 3000, "a.json").valid
    assert not check("[" * 3000, "a.json").valid
    assert check("x = " + "(" * 150 + "1" + ")" * 150, "a.py") is not None
    assert check("x" * 500_000, "a.js").valid


def test_check_files(spark):
    files = [(1, "r", "x/A.PY", "x = (", "a"), (1, "r", "x/A.PY", "x = (", "a"), (2, "r", "b.py", "x = 1", "a"), (3, None, "c.json", "", "a"), (4, "r", "d.txt", "(", "a"), (5, "r", "e.go", None, "a"), (None, "r", "f.go", "x", "a"), (6, "r", None, "x", "a")]
    df = spark.createDataFrame(files, "file_id long, repo string, file_path string, content string, valid string")
    assert sorted(r[0] for r in source.invalid_files(df).collect()) == [1, 3]
    rates = {(r["repo"], r["language"]): (r["n_files"], r["n_invalid"], r["rate"], r["n_truncated"]) for r in source.invalid_rates(df).collect()}
    assert rates == {("r", "Python"): (2, 1, 0.5, 1), (None, "JSON"): (1, 1, 1.0, 1)}
    assert source.invalid_files(df.limit(0)).collect() == []


# -- p4 ------------------------------------------------------------------------------------------------------------

TS = """\
/** Reads the rows and returns how many were fresh. */
export function readRows(a: string): { n: number } {
  const s = "function fake() {"; // function fake2() {
  /** Adds one to whatever came in. */
  const inner = (x: number): number => x + 1;
  return { n: inner(1) };
}

/** Far away. */

function noDoc() {}
/** Keeps the newest entry of every group. */
@traced('x')
class K {
  /** Tells whether the label was seen before. */
  // eslint-disable-next-line
  @dec({ a: 1 })
  private async seen(label: string): Promise<boolean> { return !!label; }
  declared(x: string): void;
  /** @internal */
  hidden() { if (1) { } }
}
"""
JAVA = """\
class A {
    /** Returns the age in days. */
    @Override @SuppressWarnings({"a", "b"})
    public int age(int[] a) throws X { return new B() { /** Compares by size. */ int cmp() { return 1; } }.cmp(); }
    /* Not documentation. */
    int other() { return "/** x */ int fake() {".length(); }
    interface P { /** No body here. */ boolean probe(String s); }
}
"""
GO = """\
package p

// Sum adds up what the reader gives.
//go:noinline
func Sum(r Reader) (n int, err error) {
	return 0, nil
}

// Gone because of the blank line.

func (s *S) Two() interface{} { return nil }

/*
Three waits for the lock.
*/
func Three() {}
"""
PY = '''\
class A:
    def f(self):
        r"""Gives back the oldest entry.

        :param x: x
        """
        def g(x): "Doubles what it gets."; return x
        return g

    async def h(self):
        f"""no {1}"""
        """neither"""
'''


def names(text, kind):
    ok, _, t = parse(text, kind)
    assert ok
    return [(f.name, f.line) for f in find_functions(t, kind) if informative(f.doc, f.name)]


def test_functions_with_documentation():
    assert names(TS, "ts") == [("readRows", 2), ("inner", 5), ("seen", 18)]
    assert names(JAVA, "java") == [("age", 4), ("cmp", 4)]
    assert names(GO, "go") == [("Sum", 5), ("Three", 16)]
    assert names(PY, "python") == [("f", 2), ("g", 7)]
    every = [f.name for f in find_functions(parse(TS, "ts")[2], "ts")]
    assert every == ["readRows", "inner", "noDoc", "seen", "hidden"]
    assert [f.line for f in find_functions(parse(TS.replace("\n", "\r\n"), "ts")[2], "ts")] == [2, 5, 11, 18, 21]


@pytest.mark.parametrize("doc", [None, "", "  ", "========", "/** * */", "TODO: document this", "@internal\n@since 1.2\n@see foldEdge", "{@inheritDoc}", "noqa", "eslint-disable-next-line no-console", "Folds the edge.", "The foldEdge function.", "This function does exactly what its name says: fold edge.", "foldEdge()", "No documentation.", "Description of foldEdge goes here. Describe what it does, its parameters and its return value.", "See above.", "Auto-generated method stub", "Description.\n@param x the x to use", "Documentation for foldEdge will follow in a later change, once somebody finds the time.", "# ---", "Noch nicht dokumentiert.", "説明なし"])
def test_trivial(doc):
    assert not informative(doc, "foldEdge")


@pytest.mark.parametrize("doc", ["Keeps ties in input order.", "Internal: drops repeated entries.", "TODO remove once the old path is gone; until then it keeps every row.", "Safe to call twice in a row.", "foldEdge walks every row below the given one.", "Deprecated but kept: sorts by age.", "@returns the number of rows removed", "Bei leerer Eingabe kommt nichts heraus.", "/** Never throws. */", "Must run after the nightly rebuild.\n@param x", "空の入力には空を返します。"])
def test_not_trivial(doc):
    assert informative(doc, "foldEdge")


def test_pairs_table(spark):
    files = spark.createDataFrame([(1, "a.ts", TS, 1), (1, "a.ts", TS, 1), (2, "b.go", GO, 1), (3, "c.go", GO + "}", 1), (4, None, "x", 1), (5, "d.py", None, 1)], "file_id long, file_path string, content string, name int")
    cand = spark.createDataFrame([(9, "f", "f()", "Gives the age.", "x"), (9, "f", "f()", "Gives the age.", "x"), (10, "f", " \t", "Gives the age.", "x"), (11, "f", "f()", "TODO", "x"), (12, None, "g()", "/** Gives the age. */", "x"), (13, "f", None, None, "x")], "candidate_id long, name string, signature string, docstring string, code string")
    got = sorted(((r["origin"], r["record_id"], r["name"], r["line"]) for r in source.documented_functions(files, cand).collect()), key=str)
    assert got == sorted([("file", 1, "readRows", 2), ("file", 1, "inner", 5), ("file", 1, "seen", 18), ("file", 2, "Sum", 5), ("file", 2, "Three", 16), ("candidate", 9, "f", 0), ("candidate", 12, None, 0)], key=str)
    assert source.documented_functions(files.limit(0), cand.limit(0)).collect() == []


def test_lexers_survive_anything():
    r = random.Random(3)
    for _ in range(150):
        t = "".join(r.choice(string.printable + "é日🙂`'\"/*{}") for _ in range(r.randrange(200)))
        for p in ("a.ts", "a.jsx", "a.py", "a.go", "A.java", "a.json"):
            assert check(t, p) is not None


STRICTER = {
    "a.ts": ["function () {}", "async function () {}", "class { }", "const a;", "let = 1;", "return 1;", "a 'b';", "x = [a b];", "class A { public public b() {} }", "{ a } from 'b'", "for (let = 0; ;) {}"],
    "a.js": ["if (a) { return; }", "const a", "x = /a/gg;", "export function () {}"],
    "A.java": ["class A { public b() { } }", "interface A { probe(String s); }", "class A { @X b(int c) { } }"],
}
LOOSER = {
    "a.ts": ["export default function () {}", "export default class {}", "declare const a: number;", "declare namespace N { const a: number; function f(): void; }", "let a, b: number;", "for (const x of y) {}", "const f = function () { return 1; }", "x = [, a, , ...b, ];", "tag`a${b}`; tag`c`;", "class A { async() {} static() {} get() {} async = 1; }", "class A { static { for (;;) {} } }", "const { a } = b, c = () => { return 2; };"],
    "A.java": ["class A { A() { } <T> A(T x) { } static class B { B() { this(1); } B(int i) { super(); } } }", "enum E { X(1) { int f() { return g(); } }, Y(2); E(int i) { } }", "record R(int a) { R { } static int h() { return k(); } }", "class A { int a = b(); { c(); } @X A(int i) { } }"],
}


@pytest.mark.parametrize("path", sorted({*STRICTER, *LOOSER}))
def test_grammars_at_the_edges(path):
    for t in STRICTER.get(path, []):
        assert not check(t, path).valid, t
    for t in LOOSER.get(path, []):
        assert check(t, path).valid, (t, check(t, path))


def test_orders_about_things_are_no_absent_documentation():
    from strandwork.llm.doctext import informative

    for said in ("Replace the default value.", "Update the link above.", "Refer the issue to the parent."):
        assert informative(said, "run")
    for nothing in ("Replace this text.", "See above.", "Refer to the parent.", "Add a description here.", "As described above."):
        assert not informative(nothing, "run")


def test_deep_nesting_is_valid():
    from strandwork.llm.syntax.check import check

    n = 20_000
    assert check("[" * n + "]" * n, "a.json").valid and not check("[" * n + "]" * (n - 1), "a.json").valid


def test_packing_report(spark):
    from strandwork.llm.packing import packing_report

    rows = [(i, 1024) for i in range(10)] + [(20, 2048), (21, 5000), (22, None), (23, 0)]
    r = packing_report(spark.createDataFrame(rows, "doc_id long, n_tokens long")).first()
    assert (r["n_pieces"], r["n_tokens"], r["n_containers"], r["least"]) == (14, 17288, 9, 9) and r["n_fixed"] == 9
    none = packing_report(spark.createDataFrame([], "doc_id long, n_tokens long")).first()
    assert (none["n_pieces"], none["n_containers"], none["fill"]) == (0, 0, None)
