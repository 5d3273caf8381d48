"""Scalar functions over text as columns: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(c: Column) -> Column:
    """SHA-256 of text or bytes, in hex."""
    return F.sha2(c, 256)


def token_estimate(c: Column) -> Column:
    """A quarter of the code points, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("bigint")


def word_count(c: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(c, r"\s+"), lambda x: x != "")).cast("bigint")


def truncate(c: Column, n: int, mark: str = "\n... (truncated)") -> Column:
    """The first n characters and a mark where there were more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def first_sentence(c: Column) -> Column:
    """Up to the earliest end of a sentence, line ends as spaces; a full stop is added where there is none. Empty stays empty."""
    flat = F.trim(F.regexp_replace(c, r"\s*\n\s*", " "))
    cut = F.regexp_extract(flat, r"^(.*?[.!?])(?: |$)", 1)
    return F.when(flat == "", "").when(cut != "", cut).otherwise(F.concat(flat, F.lit(".")))


def slug(c: Column) -> Column:
    """The anchor of a heading: lower case, word characters and hyphens only, spaces as hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"(?U)[^\w\s-]", ""), r"\s", "-")


def headings(c: Column) -> Column:
    """(level, title) of the second and third level headings of a Markdown text, in order."""
    lines = F.filter(F.split(c, "\n"), lambda x: F.trim(x).rlike(r"^#{2,3} +\S"))
    return F.transform(lines, lambda x: F.struct(F.length(F.regexp_extract(F.trim(x), "^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(F.trim(x), "^#+ +", "")).alias("title")))


def strip_trailing_divider(c: Column) -> Column:
    """The text without dividers at its end, with one line end after it; empty stays empty."""
    bare = F.rtrim(F.regexp_replace(F.regexp_replace(c, r"\s+$", ""), r"(?:(?:^|\n)[ \t]*(?:---|\*\*\*|___)\s*)+$", ""))
    bare = F.regexp_replace(bare, r"\s+$", "")
    return F.when(bare == "", "").otherwise(F.concat(bare, F.lit("\n")))


def word_keys(c: Column) -> Column:
    """The distinct words of a text for comparing bullets."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9_./]+"), F.lit(0)))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two sets of words; 0 where one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least <= 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / least)


def bullets(c: Column) -> Column:
    """The texts of lines that begin with a dash."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("-"))
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "^-+", ""))), lambda x: x != "")


def review_passed(c: Column) -> Column:
    """Whether a review's status line passes it; without a status line it does."""
    status = F.regexp_extract(c, r"(?im)^\s*STATUS:([^\n]*)", 1)
    return ~F.upper(status).contains("ISSUES")


def action(c: Column) -> Column:
    """(kind, name, argument) of a step of an agent: final answer, tool call, or the text as final answer."""
    final = F.regexp_extract(c, r"(?s)FINAL ANSWER:\s*(.*)$", 1)
    name, argument = F.regexp_extract(c, r"(?s)ACTION:\s*(\w+)\((.*)\)", 1), F.regexp_extract(c, r"(?s)ACTION:\s*(\w+)\((.*)\)", 2)
    quoted = F.regexp_replace(F.trim(argument), r"^[\"'](.*)[\"']$", "$1")
    has = c.rlike(r"(?s)FINAL ANSWER:")
    return F.struct(F.when(has, "final").when(name != "", "action").otherwise("final").alias("kind"), F.when(~has & (name != ""), name).alias("name"), F.when(has, F.trim(final)).when(name != "", quoted).otherwise(F.trim(c)).alias("argument"))


def github_repository(c: Column) -> Column:
    """owner/name of a GitHub address in any of its usual forms; null for others."""
    patterns = [r"^https?://(?:www\.)?github\.com/([\w.-]+)/([\w.-]+?)(?:\.git)?/?$", r"^git@github\.com:([\w.-]+)/([\w.-]+?)(?:\.git)?$", r"^([\w.-]+)/([\w.-]+)$"]
    return F.coalesce(*(F.when(F.trim(c).rlike(p), F.concat_ws("/", F.regexp_extract(F.trim(c), p, 1), F.regexp_extract(F.trim(c), p, 2))) for p in patterns))


# What texts of well-known licences contain, in the order in which they are tried.
LICENSE_RULES = [
    ("Apache-2.0", ["apache license", "version 2.0"]),
    ("GPL-3.0", ["gnu general public license", "version 3"]),
    ("GPL-2.0", ["gnu general public license", "version 2"]),
    ("LGPL-3.0", ["gnu lesser general public license", "version 3"]),
    ("MPL-2.0", ["mozilla public license", "version 2.0"]),
    ("BSD-3-Clause", ["redistributions of source code must retain", "neither the name of"]),
    ("BSD-2-Clause", ["redistributions of source code must retain"]),
    ("ISC", ["permission to use, copy, modify, and/or distribute this software"]),
    ("Unlicense", ["this is free and unencumbered software released into the public domain"]),
    ("MIT", ["permission is hereby granted, free of charge, to any person obtaining a copy"]),
]


def license_of_text(c: Column) -> Column:
    """The first licence all of whose marks a text contains."""
    low, out = F.lower(c), None
    for name, marks in LICENSE_RULES:
        hit = low.contains(marks[0])
        for m in marks[1:]:
            hit = hit & low.contains(m)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


# Empty phrases that a review objects to, as patterns.
BANNED_VERBS = ["promotes?", "promoting", "ensures?", "ensuring", "improves?", "improving", "enhances?", "enhancing"]
BANNED_NOUNS = ["flexibility", "maintainability", "scalability", "reliability", "efficiency", "consistency"]
BANNED_OTHERS = ["significantly improves? performance", "robust and (?:reliable|scalable|maintainable)", "seamless(?:ly)?"]
_NOUN = f"(?:{'|'.join(BANNED_NOUNS)})"
#: A verb with one of the nouns or a list of them, and the others.
BANNED = [f"(?i){p}" for p in (rf"(?:{'|'.join(BANNED_VERBS)})\s+{_NOUN}(?:\s*,?\s*(?:and\s+)?{_NOUN})*", *BANNED_OTHERS)]


def banned_phrases(c: Column) -> Column:
    """The phrases found, by pattern and then by place."""
    return F.concat(*(F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in BANNED))


# Words that claim that stages run at the same time.
ORDERING = r"(?i)\b(simultaneously|concurrently|in parallel|parallel to|meanwhile)\b"


def ordering_words(c: Column, concurrent: list[list[str]], reach: int = 200) -> Column:
    """The ordering words of a text, but for those with two members of one concurrent group within reach.

    The text is cut at the words; a word sees reach characters of what is before and behind it.
    """
    words = F.regexp_extract_all(c, F.lit(ORDERING), F.lit(1))
    rests = F.split(c, ORDERING)
    place = lambda i: F.lower(F.concat(F.substring(F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), i), lambda j: F.array(F.get(rests, j), F.when(j < i, F.get(words, j)).otherwise("")))), ""), -reach, reach), F.get(words, i), F.substring(F.array_join(F.flatten(F.transform(F.sequence(i + 1, F.size(words)), lambda j: F.array(F.get(rests, j), F.coalesce(F.get(words, j), F.lit(""))))), ""), 1, reach)))

    def allowed(i):
        near = place(i)
        hits = [sum((near.contains(m.lower()).cast("int") for m in g), F.lit(0)) >= 2 for g in concurrent]
        out = F.lit(False)
        for h in hits:
            out = out | h
        return out

    index = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(F.filter(index, lambda i: ~allowed(i)), lambda i: F.get(words, i))


def is_path_like(c: Column, extensions: list[str]) -> Column:
    """Whether a code span names a file or directory: no spaces or brackets, and a known extension or a slash at its end."""
    ext = F.lower(F.regexp_extract(c, r"\.([A-Za-z0-9]+)$", 1))
    return ~c.rlike(r"[\s()<>{}]|://") & (ext.isin(*extensions) | c.endswith("/")) & (F.length(c) > 1)


def path_like_share(c: Column) -> Column:
    """Distinct path-like code spans over bullets: how far a text only enumerates files; null without bullets."""
    spans = F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit(r"`([^`\n]+)`"), F.lit(1)), lambda x: x.contains("/") | x.rlike(r"\.[A-Za-z]{1,4}$")))
    n = F.size(bullets(c))
    return F.when(n > 0, F.size(spans) / n)


def sentence_around(c: Column, phrase: Column) -> Column:
    """The sentence that contains a phrase, whatever its case; null if it does not occur."""
    at = F.instr(F.lower(c), F.lower(phrase))
    head, tail = F.substring(c, F.lit(1), at - 1), F.substring(c, at, F.length(c))
    before = F.regexp_extract(head, r"(?s)([^.!?\n]*)$", 1)
    after = F.regexp_extract(tail, r"(?s)^([^.!?\n]*[.!?]?)", 1)
    return F.when(at > 0, F.trim(F.concat(before, after)))


def npm_dependencies(c: Column, field: str = "dependencies") -> Column:
    """name@version of each dependency of a package.json, in order of the names."""
    m = F.from_json(F.get_json_object(c, f"$.{field}"), "map<string,string>")
    return F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("@"), e["value"]))


def go_requires(c: Column) -> Column:
    """module version of each require of a go.mod, in the block form and the single form."""
    block = F.regexp_extract(c, r"(?s)require\s*\(\s*(.*?)\)", 1)
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(F.regexp_replace(x, "//.*$", ""))), lambda x: x != "")
    return F.concat(lines, F.regexp_extract_all(c, F.lit(r"(?m)^require\s+([^\s(]+\s+\S+)"), F.lit(1)))


def requirement_lines(c: Column) -> Column:
    """The lines of a requirements file that are neither blank nor comments."""
    return F.filter(F.transform(F.split(c, r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#"))


def go_module(c: Column) -> Column:
    """The module that a go.mod names first; null if none."""
    return F.nullif(F.regexp_extract(c, r"(?m)^\s*module\s+(\S+)", 1), F.lit(""))


def duration(started: Column, finished: Column) -> Column:
    """Seconds of a run; null while it is not finished."""
    return finished - started
