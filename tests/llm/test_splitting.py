import datetime as dt
import random

from sparkloom.llm import splitting

SCHEMA = "chunk_no long, id string, repo_id long, file_path string, language string, start_line int, content string, symbol_names array<string>, parent_symbol string, context_header string, ingested_at timestamp, _key string, _k string, piece_no string"
NOW = dt.datetime(2024, 1, 1)


def row(no, content, start=10, header=None, parent=None, at=NOW):
    return (no, f"a.py:{no}", 1, "src/a.py", "python", start, content, None, parent, header, at, "x", "y", "z")


def code(n, seed=1):
    r = random.Random(seed)
    out = []
    while sum(map(len, out)) < n:
        out.append(f"def f{r.randrange(10**6)}(a):\n    b = {r.randrange(10**9)}\n    return b\n\n")
    return "".join(out)


def check(text, pieces, limit=6000, overlap=400):
    assert pieces[0]["start"] == 0 and pieces[-1]["end"] == len(text)
    for p in pieces:
        assert text[p["start"] : p["end"]] == p["content"] and len(p["content"]) <= limit and p["is_partial"] and p["parent_symbol"] is not None
    for a, b in zip(pieces, pieces[1:]):
        assert 1 <= a["end"] - b["start"] <= overlap


def cut(spark, rows):
    got = splitting.split_chunks(spark.createDataFrame(rows, SCHEMA)).orderBy("chunk_no", "piece_no").collect()
    return {no: [r for r in got if r["chunk_no"] == no] for no in {r["chunk_no"] for r in got}}


def test_boundaries_lines_and_overlap(spark):
    texts = {1: code(20_000), 2: "x" * 13_000, 3: "word " * 3000, 4: "é漢🚀\n" * 3000, 5: "\n" * 7000, 6: code(6001)[:6001]}
    got = cut(spark, [row(n, t) for n, t in texts.items()] + [row(7, "short"), row(8, None), row(9, "y" * 6000)])
    assert set(got) == set(texts)
    for n, t in texts.items():
        check(t, got[n])
        for p in got[n]:
            assert p["start_line"] == 10 + t[: p["start"]].count("\n")
    assert all(p["content"].endswith("\n\n") or p["end"] == len(texts[1]) for p in got[1])
    assert all(texts[1][p["end"] :].startswith("def ") for p in got[1][:-1])


def test_header_versions_and_nulls(spark):
    t = "# head\n" + code(9000)
    late = dt.datetime(2024, 2, 1)
    got = cut(spark, [row(1, t, 5, "# head", "K"), row(1, t, 5, "# head", "K"), row(1, None, 5), row(2, code(7000), None), row(2, code(8000, 2), None, at=late)])
    assert got[1][0]["start_line"] == 5 and {p["parent_symbol"] for p in got[1]} == {"K"}
    for p in got[1][1:]:
        assert p["start_line"] == 5 + t[: p["start"]].count("\n") - 1
    assert {p["start_line"] for p in got[2]} == {None} and got[2][-1]["end"] == len(code(8000, 2))


def test_very_long_and_empty(spark):
    t = code(400_000)
    check(t, cut(spark, [row(1, t)])[1])
    assert cut(spark, []) == {}


def test_files_are_cut_by_seeking(spark, tmp_path):
    texts = {"a.py": code(50_000, 3), "b.txt": "größe 漢字 " * 3000, "c.txt": "short"}
    for n, t in texts.items():
        (tmp_path / n).write_text(t, encoding="utf-8")
    got = splitting.split_files(spark, [str(tmp_path / n) for n in texts]).orderBy("file_path", "piece_no").collect()
    for n in ("a.py", "b.txt"):
        raw = texts[n].encode()
        own = [r for r in got if r["file_path"].endswith(n)]
        assert own[0]["start"] == 0 and own[-1]["end"] == len(raw) and own[0]["n_pieces"] == len(own)
        for r in own:
            assert raw[r["start"] : r["end"]].decode() == r["content"] and r["end"] - r["start"] <= 6000 and r["lines_before"] == raw[: r["start"]].count(b"\n")
        assert all(1 <= a["end"] - b["start"] <= 400 for a, b in zip(own, own[1:]))
    assert not [r for r in got if r["file_path"].endswith("c.txt")]
    table = spark.createDataFrame([(str(tmp_path / n),) for n in texts], "path string")
    assert splitting.split_files(spark, table).count() == len(got)


def test_windows_hold_no_texts(spark):
    df = spark.createDataFrame([(1, code(40_000)), (None, code(30_000, 2))], "k long, t string")
    got = splitting.pieces(df, "k", "t")
    nodes, windows = [got._jdf.queryExecution().optimizedPlan()], []
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Window":
            windows.append({node.output().apply(i).name() for i in range(node.output().size())})
    assert windows and not any({"_part", "content"} & w for w in windows)
    for k, t in ((1, code(40_000)), (None, code(30_000, 2))):
        own = sorted((r for r in got.collect() if r["k"] == k), key=lambda r: r["piece_no"])
        assert own[0]["n_pieces"] == len(own) and own[-1]["end"] == len(t)
        assert all(t[r["start"] : r["end"]] == r["content"] and r["lines_before"] == t[: r["start"]].count("\n") for r in own)
