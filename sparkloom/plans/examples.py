"""Queries over small inputs that no Parquet table holds: source texts, trees of files, reviews, agent replies, stores and streams.

Each goes through the operator as it is and has its rows, worked out by hand from what the operator has to do, as SQL values.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import functions as F

from sparkloom.functions import paths, text
from sparkloom.operators import changes, documentation, graph, imports, providers, review, vectors, writing
from sparkloom.operators import chunks as chunk_ops
from sparkloom.plans.catalog import QUERIES, SQL
from sparkloom.session import cut_lineage, shared_dir
from sparkloom.sources import export as exporting
from sparkloom.sources import scan as scanning
from sparkloom.sources.parsers import imports as import_rows
from sparkloom.sources.parsers import parse
from sparkloom.sources.parsers import symbols as symbol_rows
from sparkloom.streaming import events as streams


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def example(columns: str, rows: list[tuple]):
    """Registers a query with its rows. columns: name type, ... in types of DuckDB."""
    names = [c.split() for c in columns.split(", ")]
    picked = ", ".join(f"CAST(c{i} AS {t}) AS {n}" for i, (n, t) in enumerate(names))
    listed = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    sql = f"SELECT {picked} FROM (VALUES {listed}) AS v({', '.join(f'c{i}' for i in range(len(names)))})"

    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _place(spark, *more: str) -> str:
    """A new folder below the shared one, as a path of the file system it is on."""
    return "/".join((shared_dir(spark).removeprefix("file:").replace("//", "/"), f"examples-{uuid.uuid4().hex}", *more))


# ---------------------------------------------------------------- parsing
SOURCES = [
    (1, "a.py", "python", 'import os as o\nfrom ..x import a, b\n@dec\ndef f(a: int, b=2, *args, **kw) -> str:\n    """Doc."""\nclass _C(Base):\n    def m(self): pass\n'),
    (2, "a.ts", "typescript", 'import d, { a as b } from "./u";\nexport async function f(x: number, y?: string): Promise<void> { return "}" }\nconst g = (a) => a + 1;\nexport class P extends Q {\n  #p() { }\n  run(x = 1) { if (x) { } }\n}\nexport interface I { a: string }\ntype T = A | B;\n'),
    (3, "a.go", "go", 'package a\nimport (\n  "fmt"\n  x "a/b"\n)\nfunc (m *Msg) Get(a int) error {\n return "}"\n}\ntype S struct {\n A int\n}\nfunc low() {}\n'),
    (4, "a.rs", "rust", "use crate::a::{B, c};\npub struct S { a: i32 }\nimpl S {\n pub fn new(x: &'static str) -> Self { S { a: 1 } }\n}\nimpl Tr for S { fn t(&self) {} }\npub trait Tr { fn t(&self); }\n"),
    (5, "b.py", "python", "def foo(:\n  pass\nclass A:\n  def b(self):\n    x\nimport y\n"),
    (6, "c.rb", "ruby", "def x; end\n"),
    (7, "d.js", "javascript", "class K {\n  #h() { }\n  open() { }\n}\n"),
]


def _sources(spark):
    return spark.createDataFrame([(n, p, la, bytearray(t.encode())) for n, p, la, t in SOURCES], "n int, file_path string, language string, source binary")


@example("n BIGINT, ord BIGINT, name VARCHAR, kind VARCHAR, parent VARCHAR, exported BOOLEAN", [
    (1, 0, "f", "function", None, True), (1, 1, "_C", "class", None, False), (1, 2, "m", "method", "_C", True), (2, 0, "f", "function", None, True), (2, 1, "g", "function", None, False), (2, 2, "P", "class", None, True), (2, 3, "#p", "method", "P", False),
    (2, 4, "run", "method", "P", True), (2, 5, "I", "interface", None, True), (2, 6, "T", "type_alias", None, False), (3, 0, "Get", "method", "Msg", True), (3, 1, "S", "struct", None, True), (3, 2, "low", "function", None, False), (4, 0, "S", "struct", None, True),
    (4, 1, "new", "method", "S", True), (4, 2, "t", "method", "S", False), (4, 3, "Tr", "interface", None, True), (5, 0, "foo", "function", None, True), (5, 1, "A", "class", None, True), (5, 2, "b", "method", "A", True), (7, 0, "K", "class", None, False), (7, 1, "#h", "method", "K", False), (7, 2, "open", "method", "K", True),
])
def example_symbols(spark, d):
    """Symbols of Python, TypeScript, Go, Rust and JavaScript, of a broken file too; a language without extractor has none."""
    s = symbol_rows(parse(_sources(spark), ["n", "file_path"]), ["n", "file_path"])
    return s.select(F.col("n").cast("bigint").alias("n"), F.col("ord").cast("bigint").alias("ord"), "name", "kind", "parent", F.col("is_exported").alias("exported"))


@example("n BIGINT, name VARCHAR, signature VARCHAR, docstring VARCHAR, decorators VARCHAR, children VARCHAR", [(1, "_C", "class _C(Base)", None, "", "m"), (1, "f", "def f(a: int, b = 2, *args, **kw) -> str", "Doc.", "dec", ""), (1, "m", "def m(self)", None, "", "")])
def example_signatures(spark, d):
    s = symbol_rows(parse(_sources(spark), ["n", "file_path"]), ["n", "file_path"]).where("n = 1")
    return s.select(F.col("n").cast("bigint").alias("n"), "name", "signature", "docstring", F.array_join("decorators", "|").alias("decorators"), F.array_join("children", "|").alias("children"))


@example("n BIGINT, module VARCHAR, names VARCHAR, alias VARCHAR, relative BOOLEAN", [(1, "os", "", "o", False), (1, "..x", "a|b", None, True), (2, "./u", "d|a", None, True), (3, "fmt", "", None, False), (3, "a/b", "", "x", False), (4, "crate::a", "B|c", None, False), (5, "y", "", None, False)])
def example_imports(spark, d):
    i = import_rows(parse(_sources(spark), ["n", "file_path"]), ["n", "file_path"])
    return i.select(F.col("n").cast("bigint").alias("n"), "module", F.array_join("imported_names", "|").alias("names"), "alias", F.col("is_relative").alias("relative"))


@example("n BIGINT, broken BOOLEAN, errors BOOLEAN", [(1, False, False), (2, False, False), (3, False, False), (4, False, False), (5, True, True), (7, False, False)])
def example_parse_errors(spark, d):
    """One broken file does not stop the others."""
    p = parse(_sources(spark), ["n", "file_path"])
    return p.select(F.col("n").cast("bigint").alias("n"), F.col("has_syntax_errors").alias("broken"), (F.size("errors") > 0).alias("errors"))


# ---------------------------------------------------------------- imports to files
@example("ord BIGINT, targets VARCHAR, internal BOOLEAN", [(0, "pkg/utils.py", True), (1, "pkg/a.py", True), (2, "", False), (3, "src/utils.ts", True), (4, "lib/index.ts", True), (5, "", False), (6, "utils/helper.go|utils/more.go", True), (7, "", False), (8, "src/foo.rs", True), (9, "src/bar/mod.rs", True), (10, "", False)])
def example_import_targets(spark, d):
    """Modules of Python, paths of JavaScript by endings and index, packages of Go below the module, paths of Rust; without a hit an import is external."""
    files = "pkg/__init__.py pkg/utils.py pkg/a.py pkg/b.py main.py src/main.js src/utils.js src/utils.ts lib/index.ts utils/helper.go utils/more.go main.go src/lib.rs src/foo.rs src/bar/mod.rs".split()
    f = spark.createDataFrame([(1, p) for p in files] + [(2, "pkg/utils.py")], "repo int, file_path string")
    i = [("main.py", "python", "pkg", ["utils"]), ("pkg/b.py", "python", ".", ["a"]), ("main.py", "python", "os", []), ("src/main.js", "javascript", "./utils", []), ("src/main.js", "javascript", "../lib", []), ("src/main.js", "javascript", "react", []), ("main.go", "go", "example.com/proj/utils", []), ("main.go", "go", "fmt", []), ("src/lib.rs", "rust", "crate::foo", ["x"]), ("src/lib.rs", "rust", "crate::bar", []), ("src/foo.rs", "rust", "serde", []), ("x.rb", "ruby", "y", [])]
    rows = spark.createDataFrame([(1, p, la, n, m, names, m.startswith(".")) for n, (p, la, m, names) in enumerate(i)], "repo int, file_path string, language string, ord int, module string, imported_names array<string>, is_relative boolean")
    edges = imports.resolve(rows, f, ["repo"], spark.createDataFrame([(1, "example.com/proj")], "repo int, go_module string"))
    both = imports.internal(edges).withColumn("internal", F.lit(True)).unionByName(imports.external(edges).withColumn("internal", F.lit(False)))
    return both.select(F.col("ord").cast("bigint").alias("ord"), F.array_join("targets", "|").alias("targets"), "internal")


# ---------------------------------------------------------------- chunks
_CODE = "import os\n\ndef one(a):\n    return a\n\n\nclass K:\n    x = 1\n\n    def first(self):\n        return 'first method of the class'\n\n    def second(self):\n        return 'second method of the class'\n\nlast = 1\n"


@example("start_line BIGINT, end_line BIGINT, content VARCHAR, names VARCHAR, parent VARCHAR, partial BOOLEAN, header VARCHAR, tokens BIGINT", [
    (1, 4, "import os\n\ndef one(a):\n    return a", "one", None, False, None, 8),
    (7, 11, "class K:\n    x = 1\n\n    def first(self):\n        return 'first method of the class'", "first", "K", True, None, 20),
    (11, 14, "# class K (continued)\n\n\n\n    def second(self):\n        return 'second method of the class'", "second", "K", True, "# class K (continued)", 22),
    (14, 16, "\n\nlast = 1\n", "", None, False, None, 2),
])
def example_chunks(spark, d):
    """Whole symbols within a budget of 20 tokens; a class beyond it is cut at the ends of its members, which keep what is before them; gaps that are more than white space are chunks."""
    f = spark.createDataFrame([("k.py", "python", bytearray(_CODE.encode()))], "file_path string, language string, source binary")
    c = chunk_ops.chunk(f, parse(f, ["file_path"]), ["file_path"], 20)
    return c.select(*(F.col(x).cast("bigint").alias(x) for x in ("start_line", "end_line")), "content", F.array_join("symbol_names", "|").alias("names"), F.col("parent_symbol").alias("parent"), F.col("is_partial").alias("partial"), F.col("context_header").alias("header"), F.col("token_estimate").cast("bigint").alias("tokens"))


# ---------------------------------------------------------------- graph
def _graph(spark):
    e = spark.createDataFrame([("a", "b", ["b"]), ("c", "b", ["b", "b"]), ("a", "x", [])], "source string, module string, targets array<string>")
    f = spark.createDataFrame([("a", "python"), ("b", "python")], "file_path string, language string")
    s = spark.createDataFrame([("a", "python", "K", "class", None, "d"), ("a", "python", "m", "method", "K", None)], "file_path string, language string, name string, kind string, parent string, docstring string")
    docs = spark.createDataFrame([("a", "sum", None), ("b", "bad", "err")], "file_path string, summary string, error string")
    return f, s, e, docs


@example("id VARCHAR, node_type VARCHAR, label VARCHAR, symbol_kind VARCHAR, summary VARCHAR", [("a", "file", "a", None, "sum"), ("b", "file", "b", None, None), ("a::K", "symbol", "K", "class", "d"), ("a::K.m", "symbol", "m", "method", None)])
def example_nodes(spark, d):
    """Files with the summaries that have no error, and symbols under their path and parent."""
    f, s, _, docs = _graph(spark)
    return graph.knowledge_nodes(f, s, docs, []).select("id", "node_type", "label", "symbol_kind", "summary")


@example("source VARCHAR, target VARCHAR, edge_type VARCHAR", [("a", "a::K", "defines"), ("a::K.m", "a::K", "member_of"), ("a", "b", "imports")])
def example_edges(spark, d):
    """Imports count only between files that are both there."""
    f, s, e, _ = _graph(spark)
    return graph.knowledge_edges(f, s, e, [])


@example("asked VARCHAR, id VARCHAR, parent VARCHAR", [("K", "a::K", None), ("M", "a::K.m", "a::K")])
def example_symbol_search(spark, d):
    """Exact names first, else names that contain the word, each with what it is a member of."""
    f, s, e, docs = _graph(spark)
    nodes, edges = graph.knowledge_nodes(f, s, docs, []), graph.knowledge_edges(f, s, e, [])
    one = lambda n: graph.member_of(graph.find_symbols(nodes, n), edges).select(F.lit(n).alias("asked"), "id", "parent")
    return one("K").unionByName(one("M"))


@example("file VARCHAR, dependents BIGINT, dependencies BIGINT, degree BIGINT", [("a", 0, 1, 1), ("b", 2, 0, 2), ("c", 0, 2, 2)])
def example_degrees(spark, d):
    """Dependents are edges, dependencies are targets with repeats."""
    return graph.degrees(_graph(spark)[2], [])


@example("source VARCHAR, targets VARCHAR", [("a", "b"), ("c", "b")])
def example_adjacency(spark, d):
    return graph.adjacency(_graph(spark)[2], []).select("source", F.array_join("targets", "|").alias("targets"))


# ---------------------------------------------------------------- documents
_DOCS = [("a.py", "python", "First. Second.", None), ("d/b.go", "go", None, "err"), ("d/c.go", "go", "Has | pipe", None)]


def _docs(spark):
    return spark.createDataFrame(_DOCS, "file_path string, language string, summary string, error string"), spark.createDataFrame([("a.py", 0, ["d/c.go"])], "source string, ord int, targets array<string>")


@example("most BIGINT, file_digest VARCHAR, imports VARCHAR, truncated BOOLEAN", [(1, "- d/c.go (go): Has | pipe", "(no imports among these files)", True), (40, "- a.py (python): First. Second.\n- d/c.go (go): Has | pipe", "- a.py imports: d/c.go", False)])
def example_repository_digest(spark, d):
    """The files most depended on, by path, and the imports among them; files with errors are left out."""
    f, e = _docs(spark)
    one = lambda n: documentation.repository_digest(f, e, [], n).select(F.lit(n).cast("bigint").alias("most"), "file_digest", "imports", "truncated")
    return one(1).unionByName(one(40))


@example("diagram VARCHAR, file_digest VARCHAR", [('flowchart TD\n    n0["a.py"]\n    n1["d/c.go"]\n    n0 --> n1', "- a.py: First. Second.\n- d/c.go: Has | pipe")])
def example_architecture(spark, d):
    f, e = _docs(spark)
    return documentation.architecture(f, e, 2)


@example("digest VARCHAR", [("- def run(a) -> int\n  file: a.py\n  decorators: app.get(\"/x\")\n  doc: Runs it.\n- def list(request)\n  file: b.py\n  decorators: api_view([\"GET\"])\n  doc: (no docstring)",)])
def example_endpoints(spark, d):
    """Functions with a decorator of a route, by file and name; other decorators are none."""
    t = [("b.py", '@api_view(["GET"])\ndef list(request):\n    pass\n@cached\ndef no(): pass\n'), ("a.py", '@app.get("/x")\ndef run(a) -> int:\n    """Runs it. Twice."""\n')]
    f = spark.createDataFrame([(p, "python", bytearray(x.encode())) for p, x in t], "file_path string, language string, source binary")
    return documentation.endpoint_digest(symbol_rows(parse(f, ["file_path"]), ["file_path"]), [])


@example("text VARCHAR", [("# Project structure\n\n### Repository root\n\n| File | Purpose |\n|---|---|\n| `a.py` | First. |\n\n### `d`\n\n| File | Purpose |\n|---|---|\n| `b.go` | (not documented) |\n| `c.go` | Has \\| pipe. |\n",)])
def example_structure_document(spark, d):
    return documentation.structure_document(_docs(spark)[0], [])


@example("text VARCHAR", [("# Changelog\n\n- `abc` (2024-01-01) s (1 file changed)\n- `def` (2024-01-02) t (2 files changed)\n- `fed` (2024-01-03) u\n",)])
def example_changelog(spark, d):
    return documentation.changelog_document(spark.createDataFrame([(0, "abc", "2024-01-01", "s", 1), (1, "def", "2024-01-02", "t", 2), (2, "fed", "2024-01-03", "u", 0)], "ord int, short_hash string, date string, subject string, files_changed int"))


_MANIFESTS = [("pyproject.toml", '[project]\nname="x"\nrequires-python=">=3.9"\ndependencies=["a>1"]\n[project.optional-dependencies]\ndev=["b"]\n[project.scripts]\nrun="x:main"\n'), ("requirements.txt", "# c\na==1\n\n b \n"), ("package.json", '{"dependencies": {"r": "^1"}, "engines": {"node": ">=18"}}'), ("Cargo.toml", '[package]\nrust-version="1.70"\n[dependencies]\ns = "1"\nt = {version="2"}\n'), ("go.mod", "module a\ngo 1.21\nrequire (\n b v1 // x\n)\nrequire c v2\n"), ("x/package.json", "{"), ("a.txt", "x")]


def _manifests(spark):
    f = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in _MANIFESTS], "file_path string, source binary")
    return documentation.manifests(f, [])


@example("file_path VARCHAR, ecosystem VARCHAR, install VARCHAR, requires VARCHAR, dependencies VARCHAR", [("pyproject.toml", "python", "pip install .", ">=3.9", "a>1"), ("requirements.txt", "python", "pip install -r requirements.txt", None, "a==1|b"), ("package.json", "node", "npm install", ">=18", "r@^1"), ("Cargo.toml", "rust", "cargo build", "1.70", 's = "1"|t = "2"'), ("go.mod", "go", "go mod download", "1.21", "b v1|c v2")])
def example_manifests(spark, d):
    """Broken manifests and other files give nothing."""
    return _manifests(spark).select("file_path", "ecosystem", "install", "requires", F.array_join("dependencies", "|").alias("dependencies"))


@example("text VARCHAR", [("# Dependencies\n\n## node (`package.json`)\n\nRequires: >=18\n\n```\nnpm install\n```\n\n- `r@^1`\n\n## python (`requirements.txt`)\n\n```\npip install -r requirements.txt\n```\n\n- `a==1`\n- `b`\n",)])
def example_dependencies_document(spark, d):
    return documentation.dependencies_document(_manifests(spark).where("file_path IN ('package.json', 'requirements.txt')"), [])


@example("place BIGINT, name VARCHAR, text VARCHAR", [(1, "README", "# R\n\ntext"), (3, "API", "# A\n\n## Table of Contents\n\n- [X y](#x-y)\n  - [Z](#z)\n\n## X y\n\n### Z\n")])
def example_export_set(spark, d):
    """In the order of a site, with a table of contents after the title; empty documents are left out."""
    t = spark.createDataFrame([("API", "# A\n\n## X y\n\n### Z\n"), ("README", "# R\n\ntext"), ("EMPTY", " ")], "name string, text string")
    return documentation.export_set(t).select(F.col("place").cast("bigint").alias("place"), "name", "text")


@example("text VARCHAR", [('<h1 align="center">x</h1>\n\n<p align="center">\n  <img src="https://img.shields.io/badge/license-Apache--2.0-green?style=flat-square" alt="license">\n  <img src="https://img.shields.io/badge/files-3-lightgrey?style=flat-square" alt="files">\n</p>\n\n---\n',)])
def example_readme_header(spark, d):
    """A badge for each value that is known."""
    none = F.lit(None).cast("string")
    return spark.range(1).select(documentation.readme_header(F.lit("x"), F.lit("Apache-2.0"), none, F.lit(3)).alias("text"))


@example("license VARCHAR, file VARCHAR", [("MIT", "LICENSE")])
def example_repository_license(spark, d):
    """The first of the usual files at the top that is there."""
    f = [("COPYING", "GNU General Public License version 3"), ("LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy"), ("sub/LICENSE", "Apache License Version 2.0")]
    return documentation.licenses(spark.createDataFrame([(p, bytearray(t.encode())) for p, t in f], "file_path string, source binary"), [])


@example("id BIGINT, license VARCHAR", [(0, "Apache-2.0"), (1, "GPL-3.0"), (2, "GPL-2.0"), (3, "LGPL-3.0"), (4, "MPL-2.0"), (5, "BSD-3-Clause"), (6, "BSD-2-Clause"), (7, "ISC"), (8, "Unlicense"), (9, "MIT"), (10, None)])
def example_license_texts(spark, d):
    """Each rule on the words of its licence; the more special rule comes first."""
    t = ["Apache License\nVersion 2.0", "GNU General Public License\nVersion 3", "GNU GENERAL PUBLIC LICENSE version 2", "GNU Lesser General Public License, Version 3", "Mozilla Public License Version 2.0", "Redistributions of source code must retain x. Neither the name of y", "Redistributions of source code must retain x", "Permission to use, copy, modify, and/or distribute this software", "This is free and unencumbered software released into the public domain", "Permission is hereby granted, free of charge, to any person obtaining a copy", "All rights reserved"]
    return spark.createDataFrame(list(enumerate(t)), "id long, t string").select("id", text.license_of_text(F.col("t")).alias("license"))


@example("chunk_count BIGINT, failed BIGINT, summaries VARCHAR, complete BOOLEAN, file_path VARCHAR", [(3, 1, "two|one", False, "f"), (1, 0, "x", True, "g")])
def example_file_parts(spark, d):
    """Summaries in the order of the chunks' first lines; a file is complete if no chunk failed."""
    p = spark.createDataFrame([("c1", "f", "one", None), ("c2", "f", "two", None), ("c3", "f", None, "e"), ("c4", "g", "x", None)], "chunk_id string, file_path string, summary string, error string")
    r = documentation.file_parts(p, spark.createDataFrame([("c1", 20), ("c2", 3)], "id string, start_line int"), [])
    return r.select("chunk_count", "failed", F.array_join("summaries", "|").alias("summaries"), "complete", "file_path")


@example("text VARCHAR", [("1. scan\n2. api, readme (in any order)\n3. review",)])
def example_stage_order(spark, d):
    return documentation.stage_order(spark.createDataFrame([(1, "scan"), (2, "readme"), (2, "api"), (5, "review")], "group int, stage string"))


# ---------------------------------------------------------------- reviews
def _reviewed(spark):
    docs = spark.createDataFrame([("a", "See `src/x.py`, `x.py`, `gone.py` and `src/`, `other/`, `http://a.b/c.py`.\nIt ensures reliability."), ("b", "fine")], "name string, text string")
    return docs, spark.createDataFrame([("src/x.py",)], "file_path string")


@example("name VARCHAR, ref VARCHAR", [("a", "gone.py"), ("a", "other/")])
def example_missing_references(spark, d):
    """Paths, base names and directories that are there are no findings, nor are addresses."""
    return review.missing_references(*_reviewed(spark))


_BANNED, _GONE, _OTHER = 'contains a banned generic phrase: "ensures reliability"', "mentions `gone.py`, which doesn't exist in this repository", "mentions `other/`, which doesn't exist in this repository"


@example("name VARCHAR, passed BOOLEAN, issues VARCHAR, error VARCHAR", [("a", False, f"x|{_BANNED}|{_GONE}|{_OTHER}", None), ("b", False, "y", None), ("c", True, "", "failed")])
def example_reviews(spark, d):
    """Findings are added and fail a review; a review without findings stays as it is."""
    old = spark.createDataFrame([("a", True, ["x"], None), ("b", False, ["y"], None), ("c", True, [], "failed")], "name string, passed boolean, issues array<string>, error string")
    return review.merge_reviews(old, review.findings(*_reviewed(spark))).select("name", "passed", F.array_join("issues", "|").alias("issues"), "error")


@example("name VARCHAR, banned BIGINT, missing BIGINT, other BIGINT", [("a", 1, 2, 1), ("b", 0, 0, 0)])
def example_issue_classes(spark, d):
    return review.issue_classes(spark.createDataFrame([("a", [_BANNED, _GONE, _OTHER, "x"]), ("b", [])], "name string, issues array<string>"))


@example("kept VARCHAR", [("the cat sat here|dogs bark loud|x y",)])
def example_first_bullets(spark, d):
    """The first of bullets that overlap by 0.55 or more, three at most."""
    b = spark.createDataFrame([(1, i, t) for i, t in enumerate(["the cat sat here", "the cat sat there", "dogs bark loud", "dogs bark loud", "x y", "z w"])], "k int, i int, t string")
    return review.dedupe_bullets(b, ["k"], "t", "i", 3).select(F.array_join("kept", "|").alias("kept"))


@example("a BIGINT, b BIGINT, share DOUBLE", [(1, 2, 1.0), (1, 4, 0.8), (2, 4, 0.8)])
def example_near_duplicates(spark, d):
    """Pairs by the overlap of their words, 0.8 of the smaller set or more; empty sets match nothing."""
    t = spark.createDataFrame([(0, 1, "a b c d e"), (0, 2, "E d c b a f"), (0, 3, "x y"), (0, 4, "a b c d z"), (0, 5, ""), (1, 6, "a b c d e")], "k int, id long, t string")
    return review.near_duplicates(t, ["k"], "id", "t", 0.8).select("a", "b", "share")


@example("text VARCHAR", [("# Documentation Review\n\n## a\n\n**Status:** ISSUES FOUND\n\n- x\n- y\n\n## b\n\n**Status:** PASS\n\nNo issues found.\n\n## c\n\n**Status:** not reviewed (timeout)\n",)])
def example_review_document(spark, d):
    r = [("b", True, [], None), ("a", False, ["x", "y"], None), ("c", True, [], "timeout")]
    return review.review_document(spark.createDataFrame(r, "name string, passed boolean, issues array<string>, error string"))


@example("name VARCHAR, prompt VARCHAR", [("API", "Document:\n# A\n\nFacts:\ndigest of routes"), ("README", "Document:\n# R\n\nFacts:\n(none)")])
def example_grounding(spark, d):
    """Each document with the facts it is checked against."""
    docs = spark.createDataFrame([("API", "# A"), ("README", "# R")], "name string, text string")
    return review.grounded(docs, spark.createDataFrame([("API", "digest of routes"), ("OTHER", "x")], "name string, facts string"))


@example("name VARCHAR, words BIGINT, overview BOOLEAN, license BOOLEAN, toc BOOLEAN", [("r", 7, True, False, False)])
def example_document_metrics(spark, d):
    m = review.document_metrics(spark.createDataFrame([("r", "# R\n\n## Overview\n\none two three")], "name string, text string"))
    return m.select("name", "words", F.col("has_overview").alias("overview"), F.col("has_license").alias("license"), F.col("has_toc").alias("toc"))


# ---------------------------------------------------------------- text
@example("id BIGINT, kind VARCHAR, name VARCHAR, argument VARCHAR", [(0, "action", "search", "x (y)"), (1, "final", None, "done\nnow"), (2, "final", None, "just text"), (3, "action", "get_file", "a/b.py")])
def example_agent_replies(spark, d):
    """Tool calls, final answers, and text that is neither, which is an answer."""
    t = ['ACTION: search("x (y)")', "so\nFINAL ANSWER: done\nnow", "just text", "THOUGHT: see\nACTION: get_file('a/b.py')"]
    a = spark.createDataFrame(list(enumerate(t)), "id long, t string").select("id", text.action(F.col("t")).alias("a"))
    return a.select("id", "a.kind", "a.name", "a.argument")


@example("id BIGINT, words VARCHAR", [(0, "in parallel|Meanwhile"), (1, ""), (2, ""), (3, "simultaneously")])
def example_ordering_words(spark, d):
    """Words that claim stages run at once are allowed near two members of one group."""
    t = ["Stages run in parallel. Meanwhile x.", "The readme and the api run concurrently.", "none", "Scan and parse run simultaneously."]
    return spark.createDataFrame(list(enumerate(t)), "id long, t string").select("id", F.array_join(text.ordering_words(F.col("t"), [["readme", "api"]]), "|").alias("words"))


@example("id BIGINT, found VARCHAR", [(0, "improves reliability and efficiency|SEAMLESS"), (1, "Promotes flexibility, maintainability, and scalability"), (2, "significantly improve performance|robust and scalable"), (3, ""), (4, "ensuring consistency|seamlessly")])
def example_banned_phrases(spark, d):
    t = ["This SEAMLESS tool improves reliability and efficiency", "Promotes flexibility, maintainability, and scalability.", "It is robust and scalable and will significantly improve performance", "It improves speed", "works seamlessly, ensuring consistency"]
    return spark.createDataFrame(list(enumerate(t)), "id long, t string").select("id", F.array_join(text.banned_phrases(F.col("t")), "|").alias("found"))


@example("id BIGINT, bullets VARCHAR, passed BOOLEAN, levels VARCHAR, bare VARCHAR, short VARCHAR", [(0, "a|b", True, "", "- a\n-- b\ntext\n* c\n", "- a\n...")
    , (1, "x", False, "", "STATUS: ISSUES\n- x\n", "STAT..."), (2, "", True, "2 A b|3 C", "# t\n## A b\n### C\n", "# t\n..."), (3, "", True, "", "a\n", "a\n--...")])
def example_markdown(spark, d):
    """Bullets, the status of a review, headings of the second and third level, dividers at the end, the mark of a cut."""
    t = ["- a\n-- b\ntext\n* c", "STATUS: ISSUES\n- x", "# t\n## A b\n### C", "a\n---\n\n***\n"]
    c, join = F.col("t"), lambda x: F.array_join(x, "|")
    levels = F.transform(text.headings(c), lambda h: F.concat(h["level"].cast("string"), F.lit(" "), h["title"]))
    return spark.createDataFrame(list(enumerate(t)), "id long, t string").select("id", join(text.bullets(c)).alias("bullets"), text.review_passed(c).alias("passed"), join(levels).alias("levels"), text.strip_trailing_divider(c).alias("bare"), text.truncate(c, 4, "...").alias("short"))


@example("id BIGINT, sentence VARCHAR, share DOUBLE", [(0, "Then it ensures reliability.", None), (1, None, 1.0)])
def example_sentences(spark, d):
    """The sentence around a phrase; how far bullets only list paths."""
    t = [(0, "First this. Then it ensures reliability. Last."), (1, "- `a/b.py`\n- `c.go`")]
    return spark.createDataFrame(t, "id long, t string").select("id", text.sentence_around(F.col("t"), F.lit("ENSURES reliability")).alias("sentence"), text.path_like_share(F.col("t")).alias("share"))


@example("npm VARCHAR, go VARCHAR, pip VARCHAR, module VARCHAR", [("a@^2|b@1", "c v1|d v2|e v3", "a==1|b", "a/b")])
def example_dependency_strings(spark, d):
    t = [('{"dependencies": {"b": "1", "a": "^2"}}', "module a/b\nrequire (\n  c v1 // x\n  d v2\n)\nrequire e v3\n", "# c\n\na==1\r\n b \n")]
    df = spark.createDataFrame(t, "n string, g string, p string")
    return df.select(*(F.array_join(f(F.col(c)), "|").alias(a) for f, c, a in ((text.npm_dependencies, "n", "npm"), (text.go_requires, "g", "go"), (text.requirement_lines, "p", "pip"))), text.go_module(F.col("g")).alias("module"))


@example("address VARCHAR, repository VARCHAR", [("https://github.com/a/b.git", "a/b"), ("git@github.com:a/b-c.git", "a/b-c"), ("http://www.github.com/a/b/", "a/b"), ("a/b", "a/b"), ("https://x.org/a/b", None)])
def example_addresses(spark, d):
    t = ["https://github.com/a/b.git", "git@github.com:a/b-c.git", "http://www.github.com/a/b/", "a/b", "https://x.org/a/b"]
    return spark.createDataFrame([(x,) for x in t], "address string").select("address", text.github_repository(F.col("address")).alias("repository"))


@example("path VARCHAR, name VARCHAR, directory VARCHAR, ending VARCHAR, language VARCHAR", [("a/main.py", "main.py", "a", "py", "python"), ("Dockerfile", "Dockerfile", "", "", "dockerfile"), ("bin/run", "run", "bin", "", "python"), ("b/x.D.TSX", "x.D.TSX", "b", "tsx", "tsx"), (".bashrc", ".bashrc", "", "", None), ("run3", "run3", "", "", None)])
def example_paths(spark, d):
    """By name, else ending, else interpreter."""
    t = [("a/main.py", b""), ("Dockerfile", b""), ("bin/run", b"#!/usr/bin/env python3\n"), ("b/x.D.TSX", b""), (".bashrc", b""), ("run3", b"#!/bin/")]
    p = F.col("path")
    return spark.createDataFrame([(x, bytearray(h)) for x, h in t], "path string, h binary").select("path", paths.basename(p).alias("name"), paths.dirname(p).alias("directory"), paths.extension(p).alias("ending"), paths.language(p, F.col("h")).alias("language"))


@example("path VARCHAR, ignored BOOLEAN", [("a.log", True), ("b/c.log", True), ("b/keep.log", False), ("build/x", True), ("b/build/x", False), ("doc/a/b/x1.txt", True), ("doc/x2.txt", True), ("#a", True), ("x", False)])
def example_ignore_rules(spark, d):
    """Globs, negation, anchors, directories, escaped marks; the last rule that matches decides."""
    rules = paths.compile_gitignore("*.log\n!keep.log\n/build/\ndoc/**/x?.txt\n# c\n\\#a\n")
    files = "a.log b/c.log b/keep.log build/x b/build/x doc/a/b/x1.txt doc/x2.txt #a x".split()
    return spark.createDataFrame([(f,) for f in files], "path string").select("path", paths.last_match(F.col("path"), rules).alias("ignored"))


# ---------------------------------------------------------------- changes, stores, streams
@example("relative_path VARCHAR, status VARCHAR", [("a", "modified"), ("e", "added")])
def example_changed(spark, d):
    s = "relative_path string, content_hash string"
    return changes.changed(changes.diff(spark.createDataFrame([("a", "n"), ("c", "s"), ("d", None), ("e", "1")], s), spark.createDataFrame([("a", "o"), ("b", "x"), ("c", "s"), ("d", None)], s)))


@example("error VARCHAR, part BIGINT", [("x", 0), ("y", 0), ("z", 1)])
def example_error_union(spark, d):
    """Errors of several stages, each once, where it came first."""
    p = [spark.createDataFrame([(e,) for e in part], "error string") for part in (["x", "y", "x"], ["y", "z"])]
    return changes.ordered_union(p, "error").select("error", F.col("ord.part").cast("bigint").alias("part"))


@example("batch BIGINT, rows BIGINT", [(0, 7), (1, 7), (2, 6)])
def example_batches(spark, d):
    return changes.batches(spark.range(20), 7, "id").groupBy("batch").agg(F.count("*").alias("rows"))


@example("step VARCHAR, relative_path VARCHAR, value VARCHAR", [("saved", "a", "2"), ("saved", "b", "1"), ("hit", "a", "p"), ("miss", "b", None), ("cleared", None, None)])
def example_memo(spark, d):
    """Saved hashes, hits and misses of a memo, and nothing after it is cleared."""
    m = changes.Memo(spark, _place(spark, "memo"))
    f = lambda *r: spark.createDataFrame(list(r), "relative_path string, content_hash string")
    m.save("r", "file_hash", f(("a", "1"), ("b", "1")))
    m.save("r", "file_hash", f(("a", "2")))
    m.save("other", "file_hash", f(("a", "9")))
    m.save("r", "doc", f(("a", "2")).withColumn("payload", F.lit("p")))
    saved = m.hashes("r").select(F.lit("saved").alias("step"), "relative_path", F.col("content_hash").alias("value"))
    want = f(("a", "2"), ("b", "1")).withColumn("repository_path", F.lit("r")).withColumn("record_type", F.lit("doc"))
    hits, misses = changes.split_by_memo(want, m.read().where("record_type = 'doc'"), changes.KEY)
    out = cut_lineage(saved.unionByName(hits.select(F.lit("hit").alias("step"), "relative_path", F.col("payload").alias("value"))).unionByName(misses.select(F.lit("miss").alias("step"), "relative_path", F.lit(None).cast("string").alias("value"))))
    m.clear()
    gone = spark.createDataFrame([("cleared" if m.hashes("r") is None else "kept", None, None)], "step string, relative_path string, value string")
    return out.unionByName(gone)


@example("id VARCHAR, text VARCHAR, rank BIGINT", [("b", "t", 1)])
def example_vector_store(spark, d):
    """Rows with errors are not saved, a merge replaces by id, a search takes one record type before its nearest."""
    v = spark.createDataFrame([("a", "chunk", "f", "t", "m", [1.0, 0.0], None), ("b", "file", "f", "t", "m", [0.0, 1.0], None), ("c", "chunk", "f", "t", "m", None, "err")], vectors.STORED + ", error string")
    s = vectors.VectorStore(spark, _place(spark, "vectors"))
    s.save(v)
    s.merge(spark.createDataFrame([("a", "chunk", "f", "new", "m", [0.0, 2.0]), ("d", "chunk", "f", "t", "m", [5.0, 5.0])], vectors.STORED))
    return s.search([0.9, 0.1], 1, "file").select("id", "text", F.lit(1).cast("bigint").alias("rank"))


@example("id VARCHAR, text VARCHAR", [("a", "new"), ("b", "t"), ("d", "t")])
def example_vector_upsert(spark, d):
    s = vectors.VectorStore(spark, _place(spark, "vectors"))
    s.save(spark.createDataFrame([("a", "chunk", "f", "t", "m", [1.0]), ("b", "file", "f", "t", "m", [0.0])], vectors.STORED))
    s.merge(spark.createDataFrame([("a", "chunk", "f", "new", "m", [2.0]), ("d", "chunk", "f", "t", "m", [5.0])], vectors.STORED))
    return s.read().select("id", "text")


@example("relative_path VARCHAR, content_hash VARCHAR", [("a", "1"), ("b", "2")])
def example_file_updates(spark, d):
    """A stream of file versions kept in a memo: of two versions in one batch the newer counts."""
    folder = _place(spark)
    spark.createDataFrame([("a", "9", 1.0), ("a", "1", 2.0), ("b", "2", 1.0)], "relative_path string, content_hash string, mtime double").coalesce(1).write.parquet(folder + "/in")
    stream = spark.readStream.schema("relative_path string, content_hash string, mtime double").parquet(folder + "/in")
    memo = changes.Memo(spark, folder + "/memo")
    streams.file_updates(stream, memo, "r", lambda df: df.count(), folder + "/checkpoint").awaitTermination(120)
    return memo.hashes("r")


# ---------------------------------------------------------------- trees, exports, providers
_TREE = {"src/main.py": "x = 1\n", "src/__init__.py": "", "a.js": "let a\n", ".gitignore": "*.log\nsecret.txt\n", "debug.log": "x", "sub/deep.log": "x", "secret.txt": "x", ".env": "A=1", ".env.example": "A=", "node_modules/p/index.js": "x", "logo.png": "x", "data": "a\0b"}


@example("relative_path VARCHAR, disposition VARCHAR, language VARCHAR, size BIGINT", [("src/main.py", "kept", "python", 6), ("src/__init__.py", "kept", "python", 0), ("a.js", "kept", "javascript", 6), (".gitignore", "kept", None, 17), ("debug.log", "ignored", None, 1), ("sub/deep.log", "ignored", None, 1), ("secret.txt", "ignored", None, 1), (".env", "secret", None, 3), (".env.example", "kept", None, 2), ("logo.png", "binary", None, 1), ("data", "binary", None, 3)])
def example_scan(spark, d):
    """A tree: secret before ignored before binary before kept; directories that are never entered have no rows."""
    root = _place(spark, "tree")
    for p, t in _TREE.items():
        exporting.write_atomically(os.path.join(root, p), t)
    all_ = scanning.dispositions(scanning.read_files(spark, root), scanning.ignore_rules(root))
    return all_.select("relative_path", "disposition", "language", F.col("size_bytes").alias("size"))


@example("files BIGINT, errors BIGINT, error VARCHAR", [(0, 1, "no such path")])
def example_scan_of_nothing(spark, d):
    files, _, errors = scanning.scan(spark, _place(spark, "nowhere"))
    return spark.createDataFrame([(files.count(), len(errors), errors[0].split(":")[0])], "files long, errors long, error string")


@example("file VARCHAR, kind VARCHAR", [("README.md", "# T"), ("README.html", "<!doc"), ("README.pdf", "%PDF-"), ("documentation.json", "{")])
def example_exports(spark, d):
    """A document in every format."""
    folder = _place(spark, "out")
    written = exporting.export({"README": "# T"}, ["md", "html", "pdf", "json"], folder)
    rows = []
    for p in written:
        with open(p, "rb") as f:
            rows.append((os.path.basename(p), f.read(5).decode("latin-1").split("\n")[0]))
    return spark.createDataFrame(rows, "file string, kind string")


@example("html VARCHAR, there BOOLEAN", [(x, True) for x in ("<strong>b</strong>", "<code>c&lt;d</code>", "<ul><li>a</li>", '<a href="u">l</a>', "<ol><li>x</li>", "<pre><code>code &lt;x&gt;</code></pre>", "<th>a</th>", "<td>2</td>", "<hr>")])
def example_html(spark, d):
    h = exporting.to_html("# T & t\n\npara **b** `c<d`\nmore\n\n- a\n- [l](u)\n\n1. x\n\n```py\ncode <x>\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n---\n", "t")
    parts = ("<strong>b</strong>", "<code>c&lt;d</code>", "<ul><li>a</li>", '<a href="u">l</a>', "<ol><li>x</li>", "<pre><code>code &lt;x&gt;</code></pre>", "<th>a</th>", "<td>2</td>", "<hr>")
    return spark.createDataFrame([(p, p in h) for p in parts], "html string, there boolean")


class _Flaky:
    """A provider that fails where a text says bad and answers short where it says short."""

    model, calls = "flaky", 0

    def generate(self, prompt: str, max_tokens: int = 1) -> str:
        if "bad" in prompt:
            raise providers.ProviderError("no")
        return prompt.upper()

    def embed(self, texts: list[str]) -> list[list[float]]:
        if any("bad" in t for t in texts):
            raise RuntimeError("batch")
        return [[float(len(t))] for t in texts[: len(texts) - any("short" in t for t in texts)]]


@example("i BIGINT, summary VARCHAR, model VARCHAR, error VARCHAR", [(0, "T0", "flaky", None), (1, None, "flaky", "ProviderError: no"), (2, "T2", "flaky", None)])
def example_generate(spark, d):
    """A call that fails marks its own row only."""
    return providers.generate(spark.createDataFrame([(0, "t0"), (1, "bad"), (2, "t2")], "i long, t string"), "t", _Flaky()).select("i", "summary", "model", "error")


@example("i BIGINT, dimensions BIGINT, error VARCHAR", [(0, 1, None), (1, 1, None), (2, 0, "RuntimeError: batch"), (3, 0, "RuntimeError: batch"), (4, 0, "1 vectors for 2 texts"), (5, 0, "1 vectors for 2 texts")])
def example_embed(spark, d):
    """Batches of two: a failed or short answer marks its batch."""
    t = spark.createDataFrame(list(enumerate(["a", "b", "bad", "c", "short", "d"])), "i long, t string").coalesce(1)
    return providers.embed(t, "t", _Flaky(), batch=2).select("i", F.col("dimensions").cast("bigint").alias("dimensions"), "error")


@example("tokens BIGINT", [(6,)])
def example_tokens_used(spark, d):
    return providers.tokens_used(spark.createDataFrame([(1, 2), (3, None), (None, None)], "prompt_tokens int, completion_tokens int"))


# ---------------------------------------------------------------- writing
class _Scripted:
    """A model that follows a script: a draft with an empty phrase, one objection to the second version, then nothing."""

    model = "scripted"

    def generate(self, prompt: str, max_tokens: int = 1) -> str:
        if prompt.startswith("Write"):
            if "broken" in prompt:
                raise providers.ProviderError("no")
            return "It works seamlessly." if "tool" in prompt else "Plain."
        if prompt.startswith("Check"):
            return "STATUS: ISSUES\n- too short" if "Second." in prompt else "STATUS: PASS"
        return "Third, longer." if "too short" in prompt else "Second."


@example("name VARCHAR, text VARCHAR, rounds BIGINT, issues VARCHAR, error VARCHAR", [("a", "Third, longer.", 2, "", None), ("b", "Plain.", 0, "", None), ("c", "", 0, "", "ProviderError: no")])
def example_written(spark, d):
    """A draft is revised for an empty phrase, then for the model's objection; another passes at once; a failed one does not stop them."""
    facts = spark.createDataFrame([("a", "a tool"), ("b", "nothing"), ("c", "broken")], "name string, facts string")
    w = writing.written(facts, spark.createDataFrame([("x.py",)], "file_path string"), _Scripted())
    return w.select("name", "text", F.col("rounds").cast("bigint").alias("rounds"), F.array_join("issues", "|").alias("issues"), "error")


@example("name VARCHAR, issues VARCHAR, rounds BIGINT", [("a", "too short", 1)])
def example_written_in_one_round(spark, d):
    """What is objected to after the last round stays."""
    w = writing.written(spark.createDataFrame([("a", "a tool")], "name string, facts string"), spark.createDataFrame([("x.py",)], "file_path string"), _Scripted(), rounds=1)
    return w.select("name", F.array_join("issues", "|").alias("issues"), F.col("rounds").cast("bigint").alias("rounds"))


@example("prompt VARCHAR", [("Code of x in python:  end",)])
def example_prompt(spark, d):
    """Names without a value, and nulls, render as nothing."""
    return spark.range(1).select(writing.rendered("Code of {name} in {language}: {code}{other} end", {"name": F.lit("x"), "language": F.lit("python"), "code": F.lit(None)}).alias("prompt"))


@example("name VARCHAR, text VARCHAR", [("API", "a2"), ("README", "r"), ("ARCHITECTURE", "x")])
def example_merged_documents(spark, d):
    """Branches that ran beside each other lose no document; of one that both have the later counts."""
    s = "name string, text string"
    return writing.merged_documents([spark.createDataFrame([("API", "a1"), ("README", "r")], s), spark.createDataFrame([("API", "a2"), ("ARCHITECTURE", "x")], s)])


@example("n BIGINT, names VARCHAR", [(1, "f|_C"), (2, "f|g|P|I|T"), (3, "S|low"), (4, "S|Tr"), (5, "foo|A"), (7, "K")])
def example_top_symbols(spark, d):
    t = writing.top_symbols(symbol_rows(parse(_sources(spark), ["n", "file_path"]), ["n", "file_path"]), ["n"])
    return t.select(F.col("n").cast("bigint").alias("n"), F.array_join("names", "|").alias("names"))


@example("text VARCHAR", [("# T\n## 🔍 Overview of data\n### Sub\n## 🧩 Modules\n## 📄 Other\ntext ## x",)])
def example_heading_marks(spark, d):
    """The first word of the list that a heading contains decides."""
    return spark.createDataFrame([("# T\n## Overview of data\n### Sub\n## Modules\n## Other\ntext ## x",)], "t string").select(writing.marked_headings(F.col("t")).alias("text"))


@example("repo BIGINT, license VARCHAR, file VARCHAR", [(1, "MIT OR ISC", "pyproject.toml"), (2, "BSD", "package.json"), (3, None, "LICENSE"), (4, "X", "pyproject.toml")])
def example_declared_licenses(spark, d):
    """A manifest counts where there is no licence file, and only if what it declares is short enough for a name; a licence file of unknown words stops the search."""
    f = [(1, "pyproject.toml", '[project]\nlicense = "MIT OR ISC"\n'), (1, "package.json", '{"license": "Y"}'), (2, "pyproject.toml", "[project]\nlicense = {file = 'L'}\n"), (2, "package.json", '{"license": " BSD "}'), (3, "LICENSE", "all rights reserved"), (3, "package.json", '{"license": "MIT"}'), (4, "pyproject.toml", "[project]\nlicense = {text = 'X'}\n"), (5, "package.json", '{"license": "' + "long " * 20 + '"}'), (6, "package.json", "{")]
    s = spark.createDataFrame([(r, p, bytearray(t.encode())) for r, p, t in f], "repo long, file_path string, source binary")
    return documentation.licenses(s, ["repo"])


@example("service VARCHAR, protocol VARCHAR, address VARCHAR, embeds BOOLEAN, error VARCHAR", [("ollama", "Local", "http://localhost:11434", True, None), ("openai", "Http", "https://api.openai.com/v1", True, None), ("anthropic", "Messages", "https://api.anthropic.com", False, None), ("gemini", "Contents", "https://generativelanguage.googleapis.com", True, None), ("groq", None, None, None, "groq needs a key, such as in GROQ_API_KEY"), ("custom", None, None, None, "custom needs an endpoint"), ("nobody", None, None, None, "unknown provider nobody"), ("offline", "Offline", None, True, None)])
def example_services(spark, d):
    """Services by name with keys from the environment; what is missing raises before any row is read."""
    rows, env = [], {"OPENAI_API_KEY": "k", "ANTHROPIC_API_KEY": "k", "GEMINI_API_KEY": "k"}
    for name in ("ollama", "openai", "anthropic", "gemini", "groq", "custom", "nobody", "offline"):
        try:
            p = providers.resolve(name, "m", env=env)
            rows.append((name, type(p).__name__, getattr(p, "base_url", None), providers.can_embed(p), None))
        except providers.ProviderError as e:
            rows.append((name, None, None, None, str(e)))
    return spark.createDataFrame(rows, "service string, protocol string, address string, embeds boolean, error string")


@example("protocol VARCHAR, path VARCHAR, answer VARCHAR, vectors BIGINT", [("Http", "/chat/completions", "hi", 2), ("Messages", "/v1/messages", "hi", None), ("Contents", "/v1beta/models/m:generateContent", "hi", 2), ("Local", "/api/chat", "hi", 2)])
def example_protocols(spark, d):
    """What each protocol asks for and how it reads the answer, against canned answers."""
    answers = {
        "/chat/completions": {"choices": [{"message": {"content": "hi"}}]}, "/v1/messages": {"content": [{"type": "text", "text": "h"}, {"type": "text", "text": "i"}]}, "/v1beta/models/m:generateContent": {"candidates": [{"content": {"parts": [{"text": "hi"}]}}]}, "/api/chat": {"message": {"content": "hi"}},
        "/embeddings": {"data": [{"embedding": [1.0]}, {"embedding": [2.0]}]}, "/v1beta/models/e:batchEmbedContents": {"embeddings": [{"values": [1.0]}, {"values": [2.0]}]}, "/api/embed": {"embeddings": [[1.0], [2.0]]},
    }
    rows = []
    for kind in (providers.Http, providers.Messages, providers.Contents, providers.Local):
        asked: list[str] = []
        canned = type(kind.__name__, (kind,), {"_post": lambda self, path, body, asked=asked: asked.append(path) or answers[path]})
        p = canned("http://x", "m", "k", "e")
        answer = p.generate("p", 5)
        rows.append((kind.__name__, asked[0], answer, len(p.embed(["a", "b"])) if providers.can_embed(p) else None))
    return spark.createDataFrame(rows, "protocol string, path string, answer string, vectors long")


@example("ram DOUBLE, vram DOUBLE, tier VARCHAR", [(None, None, "minimal"), (7.9, None, "minimal"), (8.0, None, "standard"), (4.0, 16.0, "high"), (64.0, 8.0, "workstation")])
def example_tiers(spark, d):
    r = [(None, None), (7.9, None), (8.0, None), (4.0, 16.0), (64.0, 8.0)]
    return spark.createDataFrame([(a, b, providers.tier(a, b)) for a, b in r], "ram double, vram double, tier string")


@example("key VARCHAR", [("repository_path",), ("repo_summary",), ("generated_docs.README",), ("review.0.issues",), ("statistics.files_total",), ("statistics.tokens_used",)])
def example_structured_export(spark, d):
    """Where the parts of a JSON export are."""
    j = json.loads(json.dumps(exporting.structured("/r", "s", {"README": "x"}, [{"name": "README", "passed": False, "issues": ["y"], "error": None}], {"files_total": 3})))
    there = []
    for key in ("repository_path", "repo_summary", "generated_docs.README", "review.0.issues", "statistics.files_total", "statistics.tokens_used", "statistics.other"):
        at = j
        for k in key.split("."):
            at = at[int(k)] if isinstance(at, list) else at.get(k, KeyError)
        if at is not KeyError:
            there.append((key,))
    return spark.createDataFrame(there, "key string")
