from sparkloom.llm import licenses

TEXTS = [("AAA-1.0", "Able Arch License", "1.0", "f", "ABLE ARCH LICENSE\nRelease 1.0\n\nCopyright (c) [year] [holder]\n\nYou may use these files freely and for good.\n\nNo promise is made."), ("AAA-2.0", "Able Arch License", "2.0", "f", "ABLE ARCH LICENSE\nRelease 2.0\n\nCopyright (c) [year] [holder]\n\nYou may use these files freely. Claims on inventions are granted.\n\nNo promise is made."), ("BBL", "Big Barn License", "1", "f", "BIG BARN LICENSE\n\nCopyright (c) [year] [holder]\n\nKeep this line.\n\nNo promise is made.")]
FULL = "ABLE ARCH LICENSE\nRelease 1.0\n\nCopyright (c) 2020 the Foo Works\n\nYou may use these files\nfreely and for good.\n\nNo promise is made.\n"


def run(spark, files, repos=(1, 2, 3, 4, 5)):
    s = spark.createDataFrame([(r, p, t.encode() if isinstance(t, str) else t, "x", "y") for r, p, t in files], "repo_id long, file_path string, source binary, license string, own string")
    r = spark.createDataFrame([(i, "x") for i in repos], "repo_id long, license string")
    t = spark.createDataFrame(TEXTS, "license_id string, name string, version string, family string, full_text string")
    rows = licenses.licenses(s, r, t).collect()
    out = {(x["repo_id"], x["file_path"]): x["license"] for x in rows}
    assert len(out) == len(rows)
    return out


def test_notices_of_all_forms_and_mentions(spark):
    notices = {
        "a.py": ("# Copyright 2020 the Foo Works. Licensed under the Able Arch\n# License, version 2.0; you may not use this file except as that\n# license allows.\nx = 1\n", "AAA-2.0"),
        "b.js": ("/*\n * Copyright © 2020 Foo authors\n * SPDX-License-Identifier: bbl\n */\nlet a;\n", "BBL"),
        "c.go": ("package a\n\n// License: AAA v1.0\n", "AAA-1.0"),
        "d.rs": ("// Dual licensed: choose BBL or AAA-1.0.\nfn f<'a>() {}\n", "AAA-1.0 OR BBL"),
        "e.ts": ("//\n// @license AAA-2.0\n// @copyright the Foo Works\n", "AAA-2.0"),
        "f.sh": ("#!/bin/sh\n# Terms: https://x.example/aaa-1.0\n", "AAA-1.0"),
        "g.py": ('"""\n' + FULL + '"""\n', "AAA-1.0"),
        "h.py": ("# Released under BIG BARN LICENSE. Copyright 2012 the Foo\n# authors. All other use needs written consent.\n\n# Portions of this file come from Bar Labs and stay under the Able Arch License 1.0.\n", "CONFLICT"),
        "i.py": ("KNOWN = ['AAA-1.0', 'License: BBL']\n# see the table of allowed terms (AAA-1.0, BBL)\n# sample: 'License: BBL'\n", "UNKNOWN"),
        "j.py": ("", "UNKNOWN"), "k.py": (None, "UNKNOWN"), "l.mjs": ("let s = '// SPDX-License-Identifier: BBL';\n", "UNKNOWN"), "m.py": ("x = 1\n" * 50_000 + "# SPDX-License-Identifier: BBL\n", "BBL"),
    }
    got = run(spark, [(1, p, t) for p, (t, _) in notices.items()] + [(1, "a.py", notices["a.py"][0]), (1, "n.md", "x")])
    assert got == {(1, p): v for p, (_, v) in notices.items()} | {(i, ""): "UNKNOWN" for i in (1, 2, 3, 4, 5)}


def test_repositories_and_conflicts(spark):
    files = [
        (1, "LICENSE", FULL), (1, "a.py", "# License: BBL\n"), (1, "b.py", "# License: AAA-1.0\n"), (1, "c.py", "x = 1\n"), (1, "d.py", "# SPDX-License-Identifier: AAA-1.0 OR BBL\n"),
        (2, "LICENSE.md", "# License\n\n" + FULL), (2, "package.json", '{"name": "a",\n "license": "BBL"}'), (2, "a.py", "x = 1\n"), (2, "b.py", "# License: BBL\n"),
        (3, "pyproject.toml", '[project]\nlicense = { text = "BBL OR AAA-2.0" }\n'), (3, "a.py", "# License: BBL\n"), (3, "b.py", "\n"), (4, "LICENSE", "All rights stay with us.\n"), (4, "a.py", "\n"), (5, "README.md", "# x\n\nuses AAA-2.0\n\n## License\n\nPublished under BBL.\n"), (5, "src/LICENSE", FULL),
    ]
    got = run(spark, files)
    assert got == {
        (1, ""): "AAA-1.0", (1, "a.py"): "CONFLICT", (1, "b.py"): "AAA-1.0", (1, "c.py"): "AAA-1.0", (1, "d.py"): "CONFLICT", (2, ""): "CONFLICT", (2, "a.py"): "CONFLICT", (2, "b.py"): "BBL",
        (3, ""): "AAA-2.0 OR BBL", (3, "a.py"): "BBL", (3, "b.py"): "AAA-2.0 OR BBL", (4, ""): "UNKNOWN", (4, "a.py"): "UNKNOWN", (5, ""): "BBL",
    }


def test_long_notices_and_denials(spark):
    long = "# SPDX-License-Identifier: BBL; see the file NOTICE for " + "the very long story of " * 120 + "it.\n"
    owner = "# Copyright 2020 the " + "very " * 40 + "old Works. Licensed under the Able Arch License 2.0\n"
    got = run(spark, [(1, "a.py", long), (1, "b.py", owner), (2, "README.md", "# x\n\n## License\n\nNot released under BBL; ask us.\n"), (3, "README.md", "# x\n\n## License\n\nThis is not BBL any more. Released under AAA-1.0.\n")], (1, 2, 3))
    assert len(long) > 2500 and got == {(1, "a.py"): "BBL", (1, "b.py"): "AAA-2.0", (1, ""): "UNKNOWN", (2, ""): "UNKNOWN", (3, ""): "AAA-1.0"}


def test_empty(spark):
    assert run(spark, [], ()) == {}
