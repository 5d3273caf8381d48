import random

import numpy as np

from sparkloom.llm import handwritten, repair

R = random.Random(4)


def hand(n=40, seed=0):
    r = random.Random(seed)
    w = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    forms = [lambda: f"    {w()} = {w()}({w()}, {r.randrange(99)})", lambda: f"    if {w()}:\n        {w()}.{w()}()", lambda: f"    for {w()} in {w()}:\n        print({w()}[{w()}])", lambda: f"    # {w()} {w()} {w()}\n    {w()}: int = {w()} or {w()}", lambda: f"    return {w()}"]
    return "".join(f"def {w()}({w()}):\n" + "\n".join(r.choice(forms)() for _ in range(r.randrange(3, 8))) + "\n\n" for _ in range(n))


LIB = hand(20, 77)
CASES = {
    "src/a.py": (hand(), None), "src/b.py": ("# Code generated by foogen v1. DO NOT EDIT.\n" + hand(3, 1), "generated"), "src/c.py": ('H = "# Code generated by foogen. DO NOT EDIT."\n' + hand(5, 2), None), "src/d.go": ("package a\n\n" + "".join(f"func (m *M) GetA{i}() int {{\n\treturn m.f[{i}]\n}}\n\n" for i in range(60)), "generated"),
    "src/e.js": ("var a=1;" + "".join(f"function f{i}(a,b){{return a?b[{i}]:null}}" for i in range(90)), "minified"), "src/f.py": ('D = "' + "".join(R.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(3000)) + '"\n', "data"), "src/g.py": ("T = [\n" + "".join("  " + ", ".join(f"{R.uniform(-9, 9):.5f}" for _ in range(6)) + ",\n" for _ in range(200)) + "]\n", "data"),
    "package-lock.json": ('{"x": {\n' + "".join(f'"p{i}": {{"version": "1.{i}", "integrity": "sha384-{R.random()}"}},\n' for i in range(20)) + '"z": 1}}', "lock"), "vendor/lib/h.py": (hand(3, 5), "vendored"), "app/vendor_portal/i.py": (hand(3, 6), None), "src/j.py": (LIB, "vendored"), "src/k.py": ("# changed\n" + LIB.replace("return", "yield", 2) + hand(4, 9), "vendored"), "src/compat/l.py": ("# Vendored from foo 1.2; local changes: none.\n" + hand(3, 8), "vendored"),
    "LICENSE": ("Code generated by x.\n" * 20, None), "config.json": ('{"a": [' + ", ".join(str(i) for i in range(500)) + "]}", None), "src/m.py": ("", None), "src/n.py": (None, None), "src/o.py": ("\0\1" * 500, None), "src/p.py": ('WORDS = "' + " ".join("abc def ghi".split() * 700) + '"\n' + hand(10, 12), None), "src/q.py": ("# Not generated: keep in step by hand.\n" + hand(4, 13), None),
}


def test_kinds(spark):
    rows = [(1, p, t.encode() if t is not None else None, "x", "y") for p, (t, _) in CASES.items()] + [(1, "src/a.py", CASES["src/a.py"][0].encode(), "x", "y"), (1, None, b"x", "x", "y")]
    shared = hand(12, 99)
    rows += [(2, "src/shared.py", shared.encode(), "x", "y"), (3, "lib/copy.py", ("\n" + shared).encode(), "x", "y")]
    s = spark.createDataFrame(rows, "repo_id long, file_path string, source binary, kinds string, rule string")
    known = spark.createDataFrame([("lib", "a.py", LIB, "1"), ("lib", "a.py", LIB + hand(2, 3), "2"), ("lib", "a.py", LIB, "3"), ("nil", "b.py", None, "1"), ("other", "c.py", hand(9, 55), "1"), ("none", None, "x", "1")], "library string, file_name string, content string, rule string")
    got = {(r["repo_id"], r["file_path"]): r["kinds"] for r in handwritten.not_by_hand(s, known).collect()}
    for p, (_, kind) in CASES.items():
        assert (kind is None) == ((1, p) not in got), (p, got.get((1, p)))
        assert kind is None or kind in got[1, p], (p, got[1, p])
    assert got[2, "src/shared.py"] == ["vendored"] == got[3, "lib/copy.py"]


def test_empty(spark):
    s = spark.createDataFrame([], "repo_id long, file_path string, source binary")
    assert handwritten.not_by_hand(s, spark.createDataFrame([], "library string, file_name string, content string")).count() == 0


def test_repair_finds_long_rules():
    rng = np.random.default_rng(1)
    phrase, noise = np.tile(rng.integers(0, 500, 20), 50), rng.integers(0, 500, 1000)
    g = repair.grammars([phrase, noise, np.zeros(0, np.int64), np.array([1])])
    assert g.left[0] < 20 and g.long[0] > 900 and g.long[1] == 0 and list(g.left[2:]) == [0, 1] and g.rules[0] > 0
    # A run is halved in each round.
    assert repair.grammars([np.zeros(2**20 - 1, np.int8)]).left[0] < 40


def test_grammars_do_not_depend_on_the_batch():
    rng = np.random.default_rng(2)
    many = [np.concatenate([rng.integers(0, 8, n), np.tile(rng.integers(0, 8, 40), 4), rng.integers(0, 8, n)]) for n in (100, 300, 5, 900)]
    words = [rng.integers(0, 30, len(m)) for m in many]
    all_ = repair.grammars(many, words)
    for i, (m, w) in enumerate(zip(many, words)):
        own = repair.grammars([m], [w])
        assert (own.left[0], own.rules[0], own.long[0], own.phrases(0)) == (all_.left[i], all_.rules[i], all_.long[i], all_.phrases(i))
    # What is derived from a grammar is the text: its phrases are numbers of words of the sequence.
    assert len(all_.phrases(1)) > 5 and not {*all_.phrases(0)} & {*all_.phrases(1)}


def test_short_files_are_judged_too():
    short = "".join(f"x{i} = f({i})\n" for i in range(16))
    c, w = handwritten.tokens(short, handwritten.Classes())
    assert len(c) < 120 and repair.grammars([c], [w]).long[0] >= handwritten.REUSED * len(c)
    assert handwritten.literal_share('D = "' + "".join(random.Random(3).choices("ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789", k=200)) + '"') > 0.9


def test_copies_in_very_many_repositories(spark):
    text = hand(12, 99)
    rows = [(n, f"src/m{n}.py", text.encode()) for n in range(120)] + [(500, "src/own.py", hand(12, 98).encode())]
    s = spark.createDataFrame(rows, "repo_id long, file_path string, source binary")
    got = handwritten.not_by_hand(s, spark.createDataFrame([], "library string, file_name string, content string")).collect()
    assert {(r["repo_id"], r["file_path"], *r["kinds"]) for r in got} == {(n, f"src/m{n}.py", "vendored") for n in range(120)}


def test_whole_blobs_are_compressed():
    r = random.Random(8)
    noise = ["".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=100)) for _ in range(15_000)]
    padding = ["A" * 100] * 15_000
    assert handwritten.literal_share("\n".join(padding[:2200] + noise)) > 0.9  # the head compresses, the whole does not
    assert handwritten.literal_share("\n".join(noise[:2200] + padding)) == 0  # the other way round


def test_path_tells_of_binary_contents(spark):
    gz = b"\x1f\x8b\x08\0" + bytes(R.randrange(256) for _ in range(900))
    want = {"vendor/lib/a.py": "vendored", "web/b.min.js": "minified", "api/c_pb2.py": "generated", "yarn.lock": "lock", "src/d.py": None, "vendor/lib/LICENSE": None}
    rows = [(n, p, s) for n, s in enumerate((gz, None)) for p in want]
    s = spark.createDataFrame([*rows, (2, "vendor/lib/__init__.py", b"")], "repo_id long, file_path string, source binary")
    got = {(r["repo_id"], r["file_path"]): r["kinds"] for r in handwritten.not_by_hand(s, spark.createDataFrame([], "library string, file_name string, content string")).collect()}
    assert got == {(n, p): [want[p]] for n, p, _ in rows if want[p]} | {(2, "vendor/lib/__init__.py"): ["vendored"]}
