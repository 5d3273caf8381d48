import ast

import pytest

from sparkloom.llm import validity

VALID = {
    "js": [
        "import a, { b as c } from './x';\nexport default class K extends L {\n  static #p = 1;\n  get x() { return this.#p }\n  async *g(a = 1, ...r) { yield* r }\n}\n", "", "var a = b ? c : d\nlet { x, y: [z] } = q, f = async (u) => ({ ...u })\n",
        "for (const x of y) { if (!x) continue; else break }\ndo { i++ } while (i < 3)\nlabel: for (;;) { break label }\n", "const r = /[)}\\]]/g.test(`a${b + `c${d}`}e`)\n", "try { a() } catch { b() } finally { c() }\nswitch (a) { case 1: default: x() }\n",
        "!function(){return 1}();var a=function(b){for(var c=0;c<b.length;c++)if(b[c]===1)return!0;return!1};", "a = b\n++c\nx?.y?.[z]?.(w) ?? 0n\n/* c */ // d\n", "'a' in b; new X; new Y(1).z; delete a.b, void 0; a **= 2\n", "if (a)\n  b()\nelse\n  c()\n",
    ],
    "ts": [
        "interface A<T extends B = C> extends D { a?: string; readonly [k: string]: number | null; m(x: T): void }\n", "type X = { [K in keyof T]?: T[K] } & (A | B[])\nconst f = <T,>(a: T): a is string => true\n",
        "abstract class P<T> implements Q { constructor(private readonly a: Map<string, number[]>) { super() }\n  abstract b(): Promise<void>;\n  c!: string }\n", "enum E { A = 1, B }\nlet x = y as unknown as Record<string, X[]>\nlet m = new Map<string, number>([['a', 1]])\n", "namespace N { export const a: number = 1 }\ndeclare function g(a?: string): void;\n",
    ],
    "go": [
        "package a\n\nimport (\n\t\"x\"\n\ty \"z\"\n)\n\ntype S struct {\n\tA int `t:\"a\"`\n\tB\n}\n\nfunc (s *S) M(a, b int, c ...string) (*T, error) {\n\tif x := f(); x != nil {\n\t\treturn nil, x\n\t}\n\tfor i, v := range m[1:2] {\n\t\tgo func() { ch <- v }()\n\t}\n\tswitch t := y.(type) {\n\tcase int, string:\n\tdefault:\n\t}\n\treturn &T{A: 1, B: []int{1, 2}}, nil\n}\n",
        "package a\nfunc F[T any](x T) map[string]int { return map[string]int{\"a\": 1} }\nconst (\n\tA = iota\n\tB\n)\nvar r = 'x'\ntype I interface { M() error }\n",
    ],
    "rs": [
        "#![allow(x)]\nuse a::{b, c::*};\n#[derive(Debug)]\npub struct S<'a, T: Clone + 'a> { x: &'a T, y: Vec<u8> }\nimpl<'a, T> S<'a, T> where T: Clone {\n    pub fn f(&mut self, n: usize) -> Result<Vec<T>, String> {\n        let Some(x) = self.g() else { return Err(\"a\".into()); };\n        match n { 0 | 1 => {} 2..=5 if x > 3 => y(), _ => { z() } }\n        let v = it.map(|a| a + 1).collect::<Vec<_>>();\n        while let Some(k) = q.pop() { *m.entry(k).or_insert(0) += 1; }\n        if a < b && c { vec![1, 2] } else { format!(\"{} {{\", x); return Ok(v) }\n    }\n}\n",
        "fn main() { let s = r#\"a \" b\"#; let c = '\\''; 'l: loop { break 'l; } }\nenum E { A(i32), B { x: u8 }, C = 3 }\nconst X: &[&str] = &[\"a\"];\ntrait T { fn f(&self) -> i32 { 1 } type O; }\n",
    ],
    "json": ["{}", "[1, -2.5e3, true, null, \"a\\u00e9\\n\"]", " 3 ", '{"a": {"b": []}}\n'],
    "py": ["", "def f(a, *, b=1): return [x async for x in y]\n", "match x:\n  case 1: pass\n"],
}
INVALID = {
    "js": ["function f() {", "var a = ;", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x\n", "let x: number = 1\n", "x = {{ a.b }} {% c %}\n", '{"a": 1}', "f(a b)\n", "import re\nimport os\n", "class A { b: 1 }", "'abc\n'", "if a { b }", "a }"],
    "ts": ["let x: = 1\n", "interface A { b(: string }\n", "package main\n\nimport (\n\t\"a\"\n)\n", "const a = [1, 2\n"],
    "go": ["func f() {}\n", "package a\nfunc f( {\n}\n", "package a\nx = 1\n", "package a\nfunc f() {\n\treturn f(1,\n\t\t2\n\t)\n}\n", "", "package a\n@@ -1,2 +1,2 @@\n"],
    "rs": ["fn f() { let x = ; }\n", "fn f( { }\n", "def f():\n    pass\n", "struct S { a: i32 b: i32 }\n", "fn f() -> { }\n", "/* open"],
    "json": ["", "{'a': 1}", "[1,]", '{"a": 01}', "{\"a\": 1} x", "[NaN]", "// c\n{}", '{"a" 1}', '"\t"', "[1"],
    "py": ["def f(:\n", "print 'a'\n", "x = {{ a }} {% b %}\n", "\tif a:\n  b\n"],
}


def reason(source: bytes, ending: str) -> str | None:
    """As invalid() judges one file."""
    g = validity.grammars()[validity.language_of(ending)]
    number = lambda t: ord(g.terminals[t]) - validity.TERMINAL
    allowed = {number(a) * validity.BASE + number(b) for a, b in g.pairs() if a in g.terminals and b in g.terminals}
    tokens = validity.tokens_of(source, ending)
    if tokens is None:
        return "tokens"
    return "pair" if {*validity.pairs_in(tokens)} - allowed else validity.reduced(tokens, validity.language_of(ending))


@pytest.mark.parametrize("ending", sorted(VALID))
def test_valid_texts_are_accepted(ending):
    for t in VALID[ending]:
        assert reason(t.encode(), ending) is None, t


@pytest.mark.parametrize("ending", sorted(INVALID))
def test_invalid_texts_are_rejected(ending):
    for t in INVALID[ending]:
        assert reason(t.encode(), ending), t


PYTHON = [
    "@a.b(c)\n@d\nasync def f[T: int](a, /, b: int = 1, *c, d, e=2, **g) -> x:\n    async with a as b, c as (d, e): pass\n    async for i, *j in k: await l\n    else: return\n", "x: int = 1; y[0]: str; (a.b): c = yield\n", "a, *b = c = d\na.b[0].c += yield\n", "if x:\n  a\n\n  # c\n# d\nelif y: b\nelse:\n  c\n",
    "try:\n  a\nexcept* (A, B) as e:\n  b\nelse: c\nfinally:\n  d\n", "lambda: 0\nlambda a, *b, c=1, **d: (yield)\n", "[x for x in y if z if w for a, b in c]\n{**a, 'b': c}\n{k: v for k, v in d}\n{*a, b}\n()\n(a,)\n", "f(a, *b, c=1, **d)\nf(x for x in y)\nf(a := 1, b)\n", "with (open(a) as b, c as d,):\n  pass\n",
    "with (a, b): pass\n", "match = 1\nmatch[0] = case\nmatch(x)\nmatch a, b:\n  case [1, *r] | {'a': -1.5, **k} if y: pass\n  case A.B(x, y=1) as z:\n    pass\n", "type X[T] = int\ntype = 3\n", "from .. import (a as b, c,)\nfrom ...x.y import *\nimport a.b as c, d\n", "x = not a in b is not c not in d\n", "print(f'{a!r:>{w}}' r'x')\n",
    "a[1:2, ::3, ..., *b]\n", "del (a), b[0], [c, d.e]\nglobal g, h\nassert a, b\nraise A from b\n", "x = 0xF_F + 0b1 + 0o7 + 1_0.5e-3j + 00 + .5 + 5. + 1e5\n", "if a:\n\tb\n", "a = \\\n  b\n", "class A(B, metaclass=C): ...\n", "\x0cdef f(): pass\n", "def f():\r\n  return {\r\n 'a': 1 }\r\n", "x = -1 ** -a @ b if c else d\n", "# -*- coding: latin-1 -*-\nx = 'é'\n",
    "a\n  b\n", "if a:\nb\n", "if a:\n    b\n  c\n", "f() = 1\n", "a + b = c\n", "1 = x\n", "f(a=1, b)\n", "def f(a b): pass\n", "print a\n", "x = 1 +\n", "x = (1\n", "x = 1)\n", "x = [1}\n", "'abc\n", "\"\"\"abc\n", "x = 012\n", "x = 1a\n", "else: a\n", "try: a\n", "import a.b.\n", "from a import\n", "for x y in z: a\n", "a = b c\n", "class A: \n", "return return\n", "@a\nx = 1\n", "x := 1\n", "except: a\n",
    "<<<<<<< HEAD\n", "if x:\n\ta\n        b\n", "a?b\n", "a <> b\n", "del f()\n", "for f() in x: a\n", "with a as f(): b\n", "x = yield = 1\n", "lambda x y: 0\n", "a.1\n", "{a: b, c}\n", "{a, b: c}\n", "async x\n", "None = 1\n", "import a as b.c\n", "pass pass\n", "a; ; b\n", "b'é'\n",
]


@pytest.mark.parametrize("text", PYTHON)
def test_python_agrees_with_its_own_parser(text):
    try:
        ast.parse(text.encode())
        valid = True
    except (SyntaxError, ValueError):
        valid = False
    assert (reason(text.encode(), "py") is None) == valid


def test_the_reason_tells_the_step(spark):
    rows = [(1, "a.py", b"print 'a'\n"), (1, "b.py", b"x = (\n"), (1, "c.py", b"f() = 1\n"), (1, "d.py", b"x = $\n"), (1, "e.go", b"package a\nvar = 1\n"), (1, "f.json", b"[1 2]"), (1, "g.json", b"[[1]"), (1, "h.py", b"x = 1\n")]
    got = {r["file_path"]: r["reason"] for r in validity.invalid(spark.createDataFrame(rows, "repo_id long, file_path string, source binary")).collect()}
    assert got == {"a.py": "pair", "b.py": "nesting", "c.py": "structure", "d.py": "tokens", "e.go": "pair", "f.json": "pair", "g.json": "nesting"}


def test_files_and_rates(spark):
    rows = [(1, "a/b.py", b"x = 1\n", "s", "p"), (1, "c.js", b"var a = (;\n", "s", "p"), (1, "c.js", b"var a = (;\n", "s", "p"), (2, "d.json", b"", "s", "p"), (2, "e.txt", b"((", "s", "p"), (2, "f.ts", None, "s", "p"), (2, "g.go", b"\xff\xfe\x00", "s", "p"), (3, "h.js", b"\xef\xbb\xbfvar a;\r\n", "s", "p"), (3, None, b"x", "s", "p")]
    sources = spark.createDataFrame(rows, "repo_id long, file_path string, source binary, language string, pair string")
    bad = {(r["repo_id"], r["file_path"]) for r in validity.invalid(sources).collect()}
    assert bad == {(1, "c.js"), (2, "d.json"), (2, "g.go")}
    docs = spark.createDataFrame([(1, "c.js", "x"), (1, "c.js", None), (1, "a/b.py", None), (2, "d.json", None)], "repo_id long, file_path string, error string")
    got = {(r["repo_id"], r["language"]): (r["files"], r["invalid"], r["reported"]) for r in validity.rates(sources, docs).collect()}
    assert got == {(1, "javascript"): (1, 1, 1), (1, "python"): (1, 0, 0), (2, "json"): (1, 1, 0)}
    assert validity.invalid(sources.limit(0)).count() == 0


def test_long_and_deep_texts():
    assert reason(("var a = [" + "1, " * 200_000 + "1];\n").encode(), "js") is None
    assert reason(("[" * 300 + "]" * 300).encode(), "json") is None
    assert reason(b"(" * 5000, "py") == "nesting"
    assert reason(("x = " + "(" * 150 + ")" * 150 + "\n").encode(), "py") is None
    assert reason("".join("  " * i + "if a:\n" for i in range(90)).encode() + b"  " * 90 + b"b\n", "py") is None
