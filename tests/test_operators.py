import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import changes, chunks, documentation, graph, imports, providers, review, vectors
from sparkloom.sources.parsers import braces, python


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_change_sets(spark):
    s = "relative_path string, content_hash string"
    now, then = spark.createDataFrame([("a", "n"), ("c", "s"), ("d", None)], s), spark.createDataFrame([("a", "o"), ("b", "x"), ("c", "s"), ("d", None)], s)
    assert rows(changes.diff(now, then)) == [("a", "modified"), ("b", "deleted"), ("c", "unchanged"), ("d", "unchanged")]
    assert rows(changes.diff(now, None)) == [("a", "added"), ("c", "added"), ("d", "added")] and rows(changes.changed(changes.diff(now, then))) == [("a", "modified")]


def test_memo_round_trip(spark, tmp_path):
    m = changes.Memo(spark, str(tmp_path / "memo"))
    f = lambda *r: spark.createDataFrame(list(r), "relative_path string, content_hash string")
    assert m.hashes("r") is None
    m.save("r", "file_hash", f(("a", "1"), ("b", "1")))
    m.save("r", "file_hash", f(("a", "2")))
    m.save("other", "file_hash", f(("a", "9")))
    assert rows(m.hashes("r")) == [("a", "2"), ("b", "1")]
    m.save("r", "doc", f(("a", "2")).withColumn("payload", F.lit("p")))
    want = f(("a", "2"), ("a2", "2"), ("b", "1")).withColumn("repository_path", F.lit("r")).withColumn("record_type", F.lit("doc"))
    hits, misses = changes.split_by_memo(want, m.read().where("record_type = 'doc'"), changes.KEY)
    assert rows(hits, "relative_path", "payload") == [("a", "p")] and rows(misses, "relative_path") == [("a2",), ("b",)]
    m.clear()
    assert m.hashes("r") is None


def test_stores_keep_old_readers_and_untouched_buckets(spark, tmp_path):
    s = changes.Store(spark, str(tmp_path / "s"), "k int, v string")
    assert s.read().count() == 0
    s.write(spark.range(200).selectExpr("CAST(id AS INT) AS k", "'old' AS v"), ["k"])
    before, old = s._manifest()["parts"], s.read()
    s.upsert(spark.createDataFrame([(3, "new"), (300, "new")], "k int, v string"), ["k"])
    after = s._manifest()["parts"]
    assert 1 <= sum(before.get(b) != after[b] for b in after) <= 2
    assert rows(s.read().where("v = 'new'")) == [(3, "new"), (300, "new")] and s.read().count() == 201
    assert old.count() == 200  # what was read before is still there
    s.upsert(spark.createDataFrame([(3, "x")], "k int, v string"), ["v"])
    assert s.read().count() == 202


def test_latest_and_batches(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None)], "k int, v int, x string")
    assert rows(changes.latest(df, ["k"], "v"), "k", "x") == [(1, "b"), (2, None)]
    sizes = [r["n"] for r in changes.batches(spark.range(100), 7, "id").groupBy("batch").agg(F.count("*").alias("n")).collect()]
    assert sorted(sizes) == [2] + [7] * 14
    with pytest.raises(ValueError):
        changes.batches(df, 0, "k")


def test_python_symbols():
    p = python.extract("a.py", b'import os as o\nfrom ..x import a, b\n@dec\ndef f(a: int, b=2, *args, **kw) -> str:\n    """Doc."""\nclass _C(Base):\n    def m(self): pass\n')
    assert [(s.name, s.kind, s.parent, s.is_exported) for s in p.symbols] == [("f", "function", None, True), ("_C", "class", None, False), ("m", "method", "_C", True)]
    assert p.symbols[0].signature == "def f(a: int, b = 2, *args, **kw) -> str" and p.symbols[0].docstring == "Doc." and p.symbols[0].decorators == ["dec"]
    assert [(i.module, i.imported_names, i.alias, i.is_relative) for i in p.imports] == [("os", [], "o", False), ("..x", ["a", "b"], None, True)]
    broken = python.extract("a.py", b"def foo(:\n  pass\nclass A:\n  def b(self):\n    x\nimport y\n")
    assert broken.has_syntax_errors and broken.errors and [s.name for s in broken.symbols] == ["foo", "A", "b"] and broken.imports[0].module == "y"


def test_brace_languages():
    j = braces.javascript("a.ts", b'import d, { a as b } from "./u";\nexport async function f(x: number, y?: string): Promise<void> { return "}" }\nconst g = (a) => a + 1;\nexport class P extends Q {\n  #p() { }\n  run(x = 1) { if (x) { } }\n}\nexport interface I { a: string }\ntype T = A | B;\n')
    assert [(s.name, s.kind, s.is_exported) for s in j.symbols] == [("f", "function", True), ("g", "function", False), ("P", "class", True), ("#p", "method", False), ("run", "method", True), ("I", "interface", True), ("T", "type_alias", False)]
    assert j.symbols[0].parameters[1]["type_annotation"] == "string | undefined" and j.imports[0].imported_names == ["d", "a"] and j.imports[0].is_relative
    g = braces.go("a.go", b'package a\nimport (\n  "fmt"\n  x "a/b"\n)\nfunc (m *Msg) Get(a int) error {\n return "}"\n}\ntype S struct {\n A int\n}\nfunc low() {}\n')
    assert [(s.name, s.kind, s.parent, s.is_exported) for s in g.symbols] == [("Get", "method", "Msg", True), ("S", "struct", None, True), ("low", "function", None, False)] and [(i.module, i.alias) for i in g.imports] == [("fmt", None), ("a/b", "x")]
    r = braces.rust("a.rs", b"use crate::a::{B, c};\npub struct S { a: i32 }\nimpl S {\n pub fn new(x: &'static str) -> Self { S { a: 1 } }\n}\nimpl Tr for S { fn t(&self) {} }\npub trait Tr { fn t(&self); }\n")
    assert [(s.name, s.kind, s.parent) for s in r.symbols] == [("S", "struct", None), ("new", "method", "S"), ("t", "method", "S"), ("Tr", "interface", None)] and r.imports[0].module == "crate::a"


IMPORT = "repo int, file_path string, language string, ord int, module string, imported_names array<string>, is_relative boolean"


def test_imports_resolve_by_priority(spark):
    files = ["pkg/__init__.py", "pkg/utils.py", "pkg/a.py", "pkg/b.py", "main.py", "src/main.js", "src/utils.js", "src/utils.ts", "lib/index.ts", "utils/helper.go", "utils/more.go", "main.go", "src/lib.rs", "src/foo.rs", "src/bar/mod.rs"]
    f = spark.createDataFrame([(1, p) for p in files] + [(2, "pkg/utils.py")], "repo int, file_path string")
    i = [("main.py", "python", "pkg", ["utils"]), ("pkg/b.py", "python", ".", ["a"]), ("main.py", "python", "os", []), ("src/main.js", "javascript", "./utils", []), ("src/main.js", "javascript", "../lib", []), ("src/main.js", "javascript", "react", []), ("main.go", "go", "example.com/proj/utils", []), ("main.go", "go", "fmt", []), ("src/lib.rs", "rust", "crate::foo", ["x"]), ("src/lib.rs", "rust", "crate::bar", []), ("src/foo.rs", "rust", "serde", []), ("x.rb", "ruby", "y", [])]
    frame = spark.createDataFrame([(1, p, la, n, m, names, m.startswith(".")) for n, (p, la, m, names) in enumerate(i)], IMPORT)
    got = {r["ord"]: r["targets"] for r in imports.resolve(frame, f, ["repo"], spark.createDataFrame([(1, "example.com/proj")], "repo int, go_module string")).collect()}
    assert got == {0: ["pkg/utils.py"], 1: ["pkg/a.py"], 2: [], 3: ["src/utils.ts"], 4: ["lib/index.ts"], 5: [], 6: ["utils/helper.go", "utils/more.go"], 7: [], 8: ["src/foo.rs"], 9: ["src/bar/mod.rs"], 10: []}


def test_roots_gaps_and_packing(spark):
    spans = [(0, 10), (2, 5), (2, 5), (12, 20), (12, 20), (30, 40)]
    df = spark.createDataFrame([("f", i, a, b) for i, (a, b) in enumerate(spans)], "file string, ord int, start_byte int, end_byte int")
    roots = chunks.roots(df, ["file"])
    assert rows(roots, "ord") == [(0,), (3,), (5,)]
    assert rows(chunks.gaps(roots, spark.createDataFrame([("f", 50), ("g", 3)], "file string, size int"), ["file"])) == [("f", 10, 12), ("f", 20, 30), ("f", 40, 50), ("g", 0, 3)]
    r = random.Random(1)
    sizes = [(k, i, r.randrange(1, 90)) for k in range(5) for i in range(60)]

    def greedy(xs):
        n, used = 0, 0
        for x in xs:
            if n and used + x <= 100:
                used += x
            else:
                n, used = n + 1, x
        return n

    got = dict(rows(chunks.pack_lines(spark.createDataFrame(sizes, "k int, i int, size int"), ["k"], "size", 100, "i")))
    assert got == {k: greedy([s for a, _, s in sizes if a == k]) for k in range(5)}


@pytest.mark.parametrize("limit", [15, 50, 100, 1500])
def test_chunks_cover_the_file(limit):
    source = b"import os\n\n" + b"def one(a):\n    return a\n\n" + b"class K:\n    x = 1\n" + b"".join(b"    def m%d(self):\n        return %d  # padding padding padding\n" % (i, i) for i in range(40)) + b"    tail = 2\n\n" + b"".join(b"v%d = %d\n" % (i, i) for i in range(200))
    symbols = [s for s in python.extract("a.py", source).rows()["symbols"]]
    got = chunks.pack(source, symbols, limit)
    assert got == sorted(got, key=lambda c: c[2]) and all(a[3] <= b[2] for a, b in zip(got, got[1:]))
    covered = b" ".join(source[c[2] : c[3]] for c in got)
    assert covered.split() == source.split()
    names = [n for c in got for n in c[5]]
    assert sorted(n for n in names if n.startswith("m")) == sorted(f"m{i}" for i in range(40))
    assert all(source[: c[2]].count(b"\n") + 1 == c[0] for c in got)


def test_degrees_neighbours_and_knowledge(spark):
    e = spark.createDataFrame([("a", "b", ["b"]), ("c", "b", ["b", "b"]), ("a", "x", [])], "source string, module string, targets array<string>")
    assert rows(graph.degrees(e, [])) == [("a", 0, 1, 1), ("b", 2, 0, 2), ("c", 0, 2, 2)]
    assert rows(graph.neighbours(e, "b")) == [("a", "used by"), ("c", "used by")] and rows(graph.adjacency(e, [])) == [("a", ["b"]), ("c", ["b"])]
    f = spark.createDataFrame([("a", "python"), ("b", "python")], "file_path string, language string")
    s = spark.createDataFrame([("a", "python", "K", "class", None, "d"), ("a", "python", "m", "method", "K", None)], "file_path string, language string, name string, kind string, parent string, docstring string")
    docs = spark.createDataFrame([("a", "sum", None), ("b", "bad", "err")], "file_path string, summary string, error string")
    nodes = graph.knowledge_nodes(f, s, docs, [])
    assert rows(nodes, "id", "node_type") == [("a", "file"), ("a::K", "symbol"), ("a::K.m", "symbol"), ("b", "file")]
    assert rows(nodes.where("node_type = 'file'"), "id", "summary") == [("a", "sum"), ("b", None)]
    assert rows(graph.knowledge_edges(f, s, e, [])) == [("a", "a::K", "defines"), ("a", "b", "imports"), ("a::K.m", "a::K", "member_of")]
    assert [r["id"] for r in graph.find_symbols(nodes, "K").collect()] == ["a::K"] and [r["id"] for r in graph.find_symbols(nodes, "M").collect()] == ["a::K.m"]
    d = graph.mermaid(f, graph.file_edges(e, [])).first()["diagram"]
    assert d == 'flowchart TD\n    n0["a"]\n    n1["b"]\n    n0 --> n1'


def test_vector_store_and_search(spark, tmp_path):
    v = spark.createDataFrame([("a", "chunk", "f", "t", "m", [1.0, 0.0], None), ("b", "file", "f", "t", "m", [0.0, 1.0], None), ("c", "chunk", "f", "t", "m", None, "err")], vectors.STORED + ", error string")
    s = vectors.VectorStore(spark, str(tmp_path / "v"))
    assert s.count() == 0 and s.search([1.0, 0.0]).count() == 0
    s.save(v.limit(0))
    assert not s.exists()
    s.save(v)
    assert s.count() == 2 and [r["id"] for r in s.search([0.9, 0.1]).collect()] == ["a", "b"] and [r["id"] for r in s.search([0.9, 0.1], 1, "file").collect()] == ["b"]
    s.merge(spark.createDataFrame([("a", "chunk", "f", "new", "m", [0.0, 2.0]), ("d", "chunk", "f", "t", "m", [5.0, 5.0])], vectors.STORED))
    assert rows(s.read(), "id", "text") == [("a", "new"), ("b", "t"), ("d", "t")]
    rnd = random.Random(2)
    many = [(i, [rnd.random() for _ in range(5)]) for i in range(300)]
    df = spark.createDataFrame(many, "id long, vector array<float>")
    got = rows(vectors.search_many(df.where("id % 50 = 0").withColumnRenamed("id", "query"), df, 4, block=2), "query", "rank", "id")
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assert got == [(q, r + 1, i) for q in range(0, 300, 50) for r, i in enumerate(sorted(range(300), key=lambda i: (dist(many[q][1], many[i][1]), i))[:4])]


class Flaky:
    model, fails = "flaky", 0

    def generate(self, prompt, max_tokens=1):
        if "bad" in prompt:
            raise providers.ProviderError("no")
        return prompt.upper()

    def embed(self, texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("batch")
        return [[float(len(t))] for t in texts[: len(texts) - (1 if any("short" in t for t in texts) else 0)]]


def test_one_failure_does_not_stop_others(spark):
    df = spark.createDataFrame([(i, "bad" if i == 3 else f"t{i}") for i in range(7)], "i int, t string").coalesce(1)
    assert [(r["summary"], r["error"] is None) for r in providers.generate(df, "t", Flaky()).orderBy("i").collect()] == [(None, False) if i == 3 else (f"T{i}", True) for i in range(7)]
    e = providers.embed(df, "t", Flaky(), batch=3).orderBy("i").collect()
    assert [r["error"] is None for r in e] == [True, True, True, False, False, False, True]
    calls = []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise providers.ProviderError("again", True)
        return "ok"

    assert providers.retried(call, sleep=lambda s: None) == "ok" and len(calls) == 3
    assert providers.Offline().embed(["a b", "a b"])[0] == providers.Offline().embed(["a b"])[0]


def test_reviews(spark):
    docs = spark.createDataFrame([("a", "See `src/x.py`, `x.py`, `gone.py` and `src/`, `other/`, `http://a.b/c.py`.\nIt ensures reliability."), ("b", "fine")], "name string, text string")
    files = spark.createDataFrame([("src/x.py",)], "file_path string")
    assert rows(review.missing_references(docs, files)) == [("a", "gone.py"), ("a", "other/")]
    found = review.findings(docs, files)
    old = spark.createDataFrame([("a", True, ["x"], None), ("b", False, ["y"], None), ("c", True, [], "failed")], "name string, passed boolean, issues array<string>, error string")
    merged = {r["name"]: (r["passed"], len(r["issues"]), r["error"]) for r in review.merge_reviews(old, found).collect()}
    assert merged == {"a": (False, 4, None), "b": (False, 1, None), "c": (True, 0, "failed")}
    assert {r["name"]: (r["banned"], r["missing"], r["other"]) for r in review.issue_classes(review.merge_reviews(old, found)).collect()}["a"] == (1, 2, 1)
    bullets = spark.createDataFrame([(1, i, t) for i, t in enumerate(["the cat sat here", "the cat sat there", "dogs bark loud", "dogs bark loud", "x y", "z w"])], "k int, i int, t string")
    assert review.dedupe_bullets(bullets, ["k"], "t", "i", 3).first()["kept"] == ["the cat sat here", "dogs bark loud", "x y"]
    r = random.Random(5)
    words = [f"w{i}" for i in range(25)]
    texts = [(0, i, " ".join(r.sample(words, r.randrange(3, 9)))) for i in range(60)]
    df = spark.createDataFrame(texts, "k int, id int, t string")
    over = lambda a, b: len(a & b) / min(len(a), len(b))
    sets = {i: set(t.split()) for _, i, t in texts}
    want = {(a, b) for a in sets for b in sets if a < b and over(sets[a], sets[b]) >= 0.8}
    assert {(x["a"], x["b"]) for x in review.near_duplicates(df, ["k"], "id", "t").collect()} == want


def test_documents(spark):
    docs = spark.createDataFrame([("a.py", "python", "First. Second.", None), ("d/b.go", "go", None, "err"), ("d/c.go", "go", "Has | pipe", None)], "file_path string, language string, summary string, error string")
    edges = spark.createDataFrame([("a.py", 0, ["d/c.go"])], "source string, ord int, targets array<string>")
    d = documentation.repository_digest(docs, edges, [], 1).first()
    assert d["file_digest"] == "- d/c.go (go): Has | pipe" and d["truncated"]
    assert documentation.repository_digest(docs, edges, []).first()["imports"] == "- a.py imports: d/c.go"
    text = documentation.structure_document(docs, []).first()["text"]
    assert "### Repository root" in text and "| `a.py` | First. |" in text and "Has \\| pipe." in text and "### `d`" in text
    assert documentation.manifest("go.mod", "module a\ngo 1.21\nrequire (\n b v1 // x\n)\n")["dependencies"] == ["b v1"]
    assert documentation.manifest("pyproject.toml", '[project]\nname="x"\ndependencies=["a>1"]\n')["dependencies"] == ["a>1"] and documentation.manifest("package.json", "{") is None
    h = spark.createDataFrame([(0, "abc", "2024-01-01", "s", 1), (1, "def", "2024-01-02", "t", 2)], "ord int, short_hash string, date string, subject string, files_changed int")
    assert "- `abc` (2024-01-01) s (1 file changed)\n- `def` (2024-01-02) t (2 files changed)" in documentation.changelog_document(h).first()["text"]
    out = documentation.export_set(spark.createDataFrame([("API", "# A\n\n## X\n\n### Y\n"), ("README", "# R\n\ntext"), ("EMPTY", " ")], "name string, text string")).orderBy("place").collect()
    assert [r["name"] for r in out] == ["README", "API"] and "- [X](#x)\n  - [Y](#y)" in out[1]["text"]
    p = spark.createDataFrame([("c1", "f", "one", None), ("c2", "f", "two", None), ("c3", "f", None, "e")], "chunk_id string, file_path string, summary string, error string")
    c = spark.createDataFrame([("c1", 20), ("c2", 3)], "id string, start_line int")
    r = documentation.file_parts(p, c, []).first()
    assert (r["chunk_count"], r["failed"], r["summaries"], r["complete"]) == (3, 1, ["two", "one"], False)


def test_statistics(spark):
    r = spark.createDataFrame([(1, None, 2.0, None), (3, 5, 1.0, 9.0)], "a int, b int, started_at double, finished_at double")
    assert tuple(changes.merge_statistics(r, ["a", "b"]).first()) == (3, 5, 1.0, 9.0)
    assert rows(review.summarise(r, ["a"])) == [("a", 2.0, 1.0, 3.0)]
