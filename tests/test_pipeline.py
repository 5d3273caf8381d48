import os

import pytest

from sparkloom.operators.changes import Memo, Store
from sparkloom.plans import pipeline
from sparkloom.sources import export
from sparkloom.sources.scan import scan
from sparkloom.streaming import events


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "repo"
    files = {"src/main.py": '"""Main."""\nfrom src.util import helper\n\n@app.get("/x")\ndef run(a: int) -> int:\n    """Runs it."""\n    return helper(a)\n', "src/util.py": "def helper(a):\n    return a\n", "src/__init__.py": "", "a.js": 'import { x } from "./b";\nexport function f(y) { return x(y); }\n', "b.js": "export const x = (y) => y;\n", ".gitignore": "*.log\nsecret.txt\n", "debug.log": "x", "secret.txt": "x", ".env": "A=1", ".env.example": "A=", "node_modules/p/index.js": "x", "package.json": '{"dependencies": {"r": "^1"}}', "LICENSE": "Permission is hereby granted, free of charge, to any person obtaining a copy"}
    for p, t in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    (root / "logo.png").write_bytes(b"\x89PNG\0")
    return str(root)


def test_scan(spark, tree, tmp_path):
    files, counts, errors = scan(spark, tree)
    assert {r["relative_path"] for r in files.collect()} == {"src/main.py", "src/util.py", "src/__init__.py", "a.js", "b.js", ".gitignore", ".env.example", "package.json", "LICENSE"} and not errors
    assert {r["disposition"]: r["count"] for r in counts.collect()} == {"kept": 9, "ignored": 2, "secret": 1, "binary": 1}
    assert all(len(r["content_hash"]) == 64 for r in files.collect())
    none, _, problems = scan(spark, str(tmp_path / "nowhere"))
    assert none.count() == 0 and len(problems) == 1


def test_document_update_and_export(spark, tree, tmp_path):
    memo = Memo(spark, str(tmp_path / "memo"))
    s = pipeline.scan(spark, tree, memo)
    assert {r["status"]: r["count"] for r in s.changes.groupBy("status").count().collect()} == {"added": 9}
    assert {(r["source"], r["module"]): r["targets"] for r in s.edges.collect()} == {("src/main.py", "src.util"): ["src/util.py"], ("a.js", "./b"): ["b.js"]}
    os.remove(os.path.join(tree, "a.js"))
    open(os.path.join(tree, "b.js"), "a").write("// more\n")
    d = pipeline.document(spark, tree, memo=memo)
    assert {r["status"]: r["count"] for r in d.scan.changes.groupBy("status").count().collect()} == {"deleted": 1, "modified": 1, "unchanged": 7}
    assert d.file_docs.where("error IS NULL").count() == d.file_docs.count() == 3 and d.vectors.where("error IS NULL").count() > 3
    assert "flowchart TD" in d.documents["ARCHITECTURE"] and "def run(a: int) -> int" in d.documents["API"] and "`r@^1`" in d.documents["DEPENDENCIES"] and "MIT" in d.documents["GITHUB_README"]
    written = pipeline.export(d, ["md", "html", "pdf", "json"], str(tmp_path / "out"))
    assert len(written) == 3 * len(d.documents) + 1 and all(os.path.getsize(p) for p in written)
    assert pipeline.ask(d, "what is this?") and "src/util.py::helper" in pipeline._tool_symbol(d, "help", None)
    with pytest.raises(ValueError):
        pipeline.export(d, ["docx"], str(tmp_path / "out"))


def test_markdown_to_html_and_pdf():
    md = "# T & t\n\npara **b** `c<d`\nmore\n\n- a\n- [l](u)\n\n1. x\n\n```py\ncode <x>\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n---\n"
    h = export.to_html(md, "t")
    for x in ("<h1", "<strong>b</strong>", "<code>c&lt;d</code>", "<ul><li>a</li>", '<a href="u">l</a>', "<ol><li>x</li>", "<pre><code>code &lt;x&gt;</code></pre>", "<th>a</th>", "<td>2</td>", "<hr>"):
        assert x in h
    p = export.to_pdf(md)
    assert p.startswith(b"%PDF") and b"(code <x>)" in p and b"empty document" in export.to_pdf("")


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT * FROM VALUES (TIMESTAMP '2024-01-01 00:10:00', 'a', 1), (TIMESTAMP '2024-01-01 00:20:00', 'a', 2), (TIMESTAMP '2024-01-01 03:00:00', 'b', 1) AS t(ts, k, v)").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, k string, v int").parquet(src)
    q = events.tumbling_counts(stream, "ts", ["k"]).writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["k"], r["n"]) for r in spark.table("tumbling").collect()) == [("a", 2), ("b", 1)]
    store = Store(spark, str(tmp_path / "store"), "ts timestamp, k string, v int")
    from sparkloom.operators.changes import latest

    for _ in range(2):
        events.into_store(stream, store, ["k"], str(tmp_path / "ck"), lambda b: latest(b, ["k"], "v")).awaitTermination(60)
    assert sorted((r["k"], r["v"]) for r in store.read().collect()) == [("a", 2), ("b", 1)]
    seen = []
    memo = Memo(spark, str(tmp_path / "memo"))
    hashes = str(tmp_path / "hashes")
    # a has two versions in one batch: the newer one has the smaller hash.
    spark.createDataFrame([("a", "9", 1.0), ("a", "1", 2.0), ("b", "2", 1.0)], "relative_path string, content_hash string, mtime double").coalesce(1).write.parquet(hashes)
    files = spark.readStream.schema("relative_path string, content_hash string, mtime double").parquet(hashes)
    events.file_updates(files, memo, "r", lambda df: seen.extend(sorted(r["relative_path"] for r in df.collect())), str(tmp_path / "ck2")).awaitTermination(60)
    assert seen == ["a", "b"] and sorted(tuple(r) for r in memo.hashes("r").collect()) == [("a", "1"), ("b", "2")]


def test_catalogue_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    from sparkloom.plans import catalog, examples  # noqa: F401

    def shown(x):
        return round(x, 6) if isinstance(x, float) else tuple(map(shown, x)) if isinstance(x, (list, tuple)) else x

    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    for name, sql in catalog.oracle_sql().items():
        df = catalog.queries()[name](spark, folder)
        r = con.execute(sql)
        columns = [c[0] for c in r.description]
        assert sorted(columns) == sorted(df.columns), name
        at = [columns.index(c) for c in df.columns]
        assert sorted((tuple(shown(x[i]) for i in at) for x in r.fetchall()), key=repr) == sorted((tuple(map(shown, x)) for x in df.collect()), key=repr), name
