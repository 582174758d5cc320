from strandwork.operators.codegraph import build_call_graph, code_sites

TS = """import { far } from './b';
class A {
  async m(x: number) { if (x && this.n()) { await far(x); } return this.missing(); }
  n() { const inner = () => helper(1); return inner(); }
}
function helper(y: number) { return new A().m(y) || "fake()"; } // fake2()
"""
PY = "class K:\n    def run(self):\n        self.stop()\n        return other()\n\n    def stop(self): pass\n\ndef other():\n    def deep(): return lonely()\n    return deep()\n"
GO = "package p\nfunc (r *Reader) Read(n int) int {\n\treturn r.fill(n)\n}\nfunc (r *Reader) fill(n int) int { return n }\n"
JAVA = "class J { int a() { return b(1) + K.run(); } int b(int x) { return x; } }\n"


def test_call_graph(spark):
    files = spark.createDataFrame([("src/a.ts", TS, "x"), ("src/b.ts", "export function far(z) { return lonely(z); }\nfunction lonely() {}\n", "x"), ("k.py", PY, "x"), ("r.go", GO, "x"), ("J.java", JAVA, "x"), ("n.py", None, "x"), ("q.txt", "f()", "x")], "file_path string, content string, name string")
    imported = spark.createDataFrame([("src/a.ts", "src/b.ts")], "file_path string, target_path string")
    fn, edges = build_call_graph(files, imported)
    f = {r["id"]: r for r in fn.collect()}
    assert set(f) == {"src/a.ts::A.m", "src/a.ts::A.n", "src/a.ts::inner", "src/a.ts::helper", "src/b.ts::far", "src/b.ts::lonely", "k.py::K.run", "k.py::K.stop", "k.py::other", "k.py::deep", "r.go::Reader.Read", "r.go::Reader.fill", "J.java::J.a", "J.java::J.b"}
    assert f["src/a.ts::A.m"]["is_async"] and f["src/a.ts::A.m"]["complexity"] == 3 and (f["src/a.ts::A.m"]["start_line"], f["k.py::other"]["start_line"]) == (3, 8)
    got = {(r["caller_id"].split("::")[1], r["callee_id"], r["call_type"], r["confidence"]) for r in edges.collect()}
    assert got == {
        ("A.m", "src/a.ts::A.n", "method", "self_cls"), ("A.m", "src/b.ts::far", "await", "import"), ("A.m", "external::this.missing", "method", "external"),
        ("inner", "src/a.ts::helper", "direct", "same_file"), ("A.n", "src/a.ts::inner", "direct", "same_file"), ("helper", "external::A", "constructor", "external"), ("helper", "src/a.ts::A.m", "method", "same_file"),
        ("far", "src/b.ts::lonely", "direct", "same_file"), ("K.run", "k.py::K.stop", "method", "self_cls"), ("K.run", "k.py::other", "direct", "same_file"), ("other", "k.py::deep", "direct", "same_file"),
        ("deep", "src/b.ts::lonely", "direct", "name_only"), ("Reader.Read", "r.go::Reader.fill", "method", "name_only"), ("J.a", "J.java::J.b", "direct", "same_file"), ("J.a", "k.py::K.run", "method", "type_name"),
    }
    assert code_sites(files.limit(0)).collect() == []


RUST = 'mod m { impl<T: Clone> Show for Deck<T> { pub async fn show(&self, s: &\'a str) -> String { helper(s); self.fill(1).await } fn fill(&self, n: u8) -> Vec<u8> { if n > 0 { Deck::make(n) } else { vec![] } } } }\nfn helper(s: &str) { println!("fill({})", s); let r = r#"helper(1)"#; }\n'
RUBY = 'module Store\n  class Box < Base\n    def put(x)\n      return if x.nil?\n      items.each do |i|\n        check(i)\n      end\n      flush(x) # check(2)\n    end\n\n    def self.flush(y) = size(y)\n  end\nend\n\ndef check(z)\n  while z do\n    z = step(z)\n  end\nend\n'
CPP = '#include "far.h"\nnamespace a {\nclass Ring : public Base {\n public:\n  Ring(int n) : size_(n) { reset(n); }\n  int at(int i) const noexcept override { return data_.get(i) + sizeof(int); }\n};\nvoid Ring::reset(int n) { if (n) { clear(n); } const char* s = "clear(1)"; }\nstatic int clear(int n) { return n; }\n}\n'
SWIFT = 'extension Feed: Sync {\n  init(n: Int) { load(n) }\n  func load(_ n: Int) async throws -> [Int] {\n    guard n > 0 else { return [] }\n    return try await pull(n)\n  }\n}\nfunc pull(_ n: Int) -> [Int] { let s = "load(\\(n))"; return items.map { twice($0) } }\n'


def test_other_languages():
    from strandwork.operators.codegraph import scan_file

    def read(path, text):
        rows = scan_file(path, text)
        return {r[2].split("::", 1)[1] for r in rows if r[0] == "function"}, {(r[9].split("::", 1)[1], r[10], r[11], r[13]) for r in rows if r[0] == "call"}

    assert read("a.rs", RUST) == ({"Deck.show", "Deck.fill", "helper"}, {("Deck.show", "helper", None, "direct"), ("Deck.show", "fill", "self", "method"), ("Deck.fill", "make", "Deck", "method")})
    fns, calls = read("a.rb", RUBY)
    assert fns == {"Box.put", "Box.flush", "check"} and {("Box.put", "check", None, "direct"), ("Box.put", "flush", None, "direct"), ("Box.flush", "size", None, "direct"), ("check", "step", None, "direct")} == calls
    assert read("a.cpp", CPP) == ({"Ring.Ring", "Ring.at", "Ring.reset", "clear"}, {("Ring.Ring", "reset", None, "direct"), ("Ring.at", "get", "data_", "method"), ("Ring.reset", "clear", None, "direct")})
    assert read("a.swift", SWIFT) == ({"Feed.init", "Feed.load", "pull"}, {("Feed.init", "load", None, "direct"), ("Feed.load", "pull", None, "await"), ("pull", "twice", None, "direct")})


def test_scanner_on_odd_texts():
    from strandwork.operators.scanner import scan

    for lang in ("js", "python", "go", "java", "rust", "ruby", "cpp", "swift"):
        for text in ("", "}", ")]}", "function", "def", "def f(", "class", "{" * 2000, "`${`${a(1)}`}`", "﻿ x", "/*", '"', "'''", "end end end", "a" * 100_000):
            scan(text, lang)
    js = "const f = <T>(a: { b: T }): { c: T } => { return g(`x ${h(a, `${i(1)}`)} y`); };\nexport default class K<T> extends M {\n  private p = async (x) => x + this.q(x)\n  get v() { return /[/(]r(1)/.test(s(2)); }\n}\nconst o = { run() { return w(); }, go: () => z() };\nvoid (function () { return y(); })();\n"
    got = scan(js, "js")
    names = [(f.class_name, f.name) for f in got.functions]
    assert names == [(None, "f"), ("K", "p"), ("K", "v"), (None, "run"), (None, "go")]
    assert [(got.functions[c[0]].name, c[1]) for c in got.calls] == [("f", "g"), ("f", "h"), ("f", "i"), ("p", "q"), ("v", "test"), ("v", "s"), ("run", "w"), ("go", "z")]
