import pytest
from pyspark.sql import functions as F

from sparkloom.functions import paths, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "value,f,want",
    [
        ("One. Two.", text.first_sentence, "One."), ("No end\nhere", text.first_sentence, "No end here."), ("", text.first_sentence, ""), ("Go! Now. x", text.first_sentence, "Go!"),
        ("Hello, Wörld x-1!", text.slug, "hello-wörld-x-1"), ("a\n---\n\n***\n", text.strip_trailing_divider, "a\n"), ("---", text.strip_trailing_divider, ""), ("a --- b", text.strip_trailing_divider, "a --- b\n"),
        ("abcdefgh", text.token_estimate, 2), ("", text.token_estimate, 1), (" a  b\nc ", text.word_count, 3), ("STATUS: PASS\n- x", text.review_passed, True), ("x", text.review_passed, True), ("status: issues found", text.review_passed, False),
        ("https://github.com/a/b.git", text.github_repository, "a/b"), ("git@github.com:a/b-c.git", text.github_repository, "a/b-c"), ("https://x.org/a/b", text.github_repository, None),
        ("This SEAMLESS tool improves reliability and efficiency", text.banned_phrases, ["improves reliability and efficiency", "SEAMLESS"]), ("- a\n-- b\ntext\n* c", text.bullets, ["a", "b"]),
        ('{"dependencies": {"b": "1", "a": "^2"}}', text.npm_dependencies, ["a@^2", "b@1"]), ("module a/b\nrequire (\n  c v1 // x\n  d v2\n)\nrequire e v3\n", text.go_requires, ["c v1", "d v2", "e v3"]), ("# c\n\na==1\r\n b \n", text.requirement_lines, ["a==1", "b"]),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", text.license_of_text, "MIT"), ("GNU General Public License version 2", text.license_of_text, "GPL-2.0"), ("nothing", text.license_of_text, None),
    ],
)
def test_functions(spark, value, f, want):
    assert one(spark, value, f) == want


def test_actions_and_headings(spark):
    a = lambda v: tuple(one(spark, v, text.action))
    assert a('ACTION: search("x (y)")') == ("action", "search", "x (y)")
    assert a("so\nFINAL ANSWER: done\nnow") == ("final", None, "done\nnow") and a("just text") == ("final", None, "just text")
    assert [tuple(h) for h in one(spark, "# t\n## A b\n### C\n#### d", text.headings)] == [(2, "A b"), (3, "C")]


def test_ordering_words_are_allowed_within_a_group(spark):
    f = lambda c: text.ordering_words(c, [["readme", "api"]])
    assert one(spark, "Stages run in parallel. Meanwhile x.", f) == ["in parallel", "Meanwhile"]
    assert one(spark, "The readme and the api run concurrently.", f) == [] and one(spark, "none", f) == []


def test_languages_secrets_and_ignores(spark):
    rows = [("a/main.py", b""), ("x.tsx", b""), ("Dockerfile", b""), ("run", b"#!/usr/bin/env python3\n"), ("run2", b"#!/bin/bash -e\n"), ("run3", b"#!/bin/"), ("a.unknownext", b""), (".bashrc", b""), ("Makefile", b""), ("a/.env", b""), ("a/.env.example", b""), ("id_rsa.pub", b""), ("k.pem", b""), ("n.dat", b"a\0b"), ("i.PNG", b"x")]
    df = spark.createDataFrame(rows, "p string, h binary")
    got = {r["p"]: (r["l"], r["s"], r["b"]) for r in df.select("p", paths.language(F.col("p"), F.col("h")).alias("l"), paths.is_secret(F.col("p")).alias("s"), paths.is_binary(F.col("p"), F.col("h")).alias("b")).collect()}
    assert [got[p][0] for p, _ in rows[:9]] == ["python", "tsx", "dockerfile", "python", "shell", None, None, None, "makefile"]
    assert {p for p in got if got[p][1]} == {"a/.env", "k.pem"} and {p for p in got if got[p][2]} == {"n.dat", "i.PNG"}
    rules = paths.compile_gitignore("*.log\n!keep.log\n/build/\ndoc/**/x?.txt\n# c\n\\#a\n")
    files = ["a.log", "b/c.log", "b/keep.log", "build/x", "b/build/x", "doc/a/b/x1.txt", "doc/x2.txt", "#a", "x"]
    out = {r["p"]: r["i"] for r in spark.createDataFrame([(f,) for f in files], "p string").select("p", paths.last_match(F.col("p"), rules).alias("i")).collect()}
    assert [out[f] for f in files] == [True, True, False, True, False, True, True, True, False]
