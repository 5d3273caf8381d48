"""Licence of each code file and repository.

The texts of the known licences are compiled into templates, with the heading and the copyright line as optional and the year
and holder as replaceable sections, and further into one backtracking pattern beside the usual short notices. A comment is a
notice only if the pattern takes its text completely, so a mere mention is none. Detected licences are then aggregated per
file and repository with their contradictions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import spread

CODE = r"\.(py|js|mjs|ts|mts|go|rs|sh)$"
LICENSE_FILE = r"(?i)^(?:licen[sc]e|copying|unlicen[sc]e)(?:[.-].*)?$"
MANIFEST = r"(?i)^(?:package\.json|pyproject\.toml|cargo\.toml|setup\.cfg|composer\.json)$"
README = r"(?i)^readme(?:\..*)?$"
UNKNOWN, CONFLICT = "UNKNOWN", "CONFLICT"
#: Licences are few: a list longer than this is no list of known licences and is refused.
MOST_LICENSES = 2000

_YEAR = r"\d{4}(?: ?[-–,] ?\d{4})*"
#: A statement of ownership ends before the notice that follows it, at the latest with its sentence.
_COPY = re.compile(
    rf"(?:@?Copyright:? ?(?:(?:\(c\)|©),? ?)?|(?:\(c\)|©) ?(?=\d))(?:{_YEAR},? ?)?(?:by )?[^.:;]{{2,}}?\.?(?= *(?:$|SPDX-|@?Licen[sc]|Released |This |These |Terms:|All |Dual|Portions|Parts |Distributed |@copyright|Published))|All rights reserved\.?",
    re.I,
)


_DENIED = re.compile(r"(?i)\b(?:not|never|no longer|isn't|aren't|formerly|previously|used to be|instead of|unlike|incompatible with)\b")


def _words(text: str) -> str:
    return " ".join(re.escape(w) for w in text.split())


def _name(row: dict, single: bool) -> str:
    """The name in prose, with the version where the family has several."""
    version = row["version"] or ""
    name = _words(row["name"]).replace("\\,", ",").replace(", ", ",? ")
    name = re.sub(r"(?i)licen[sc]e", "licen[sc]e", name)
    spelled = rf"(?:,? ?\(?(?:version|release|ver\.?|v\.?)? ?{re.escape(version)}\)?)"
    tail = "" if "," in row["name"] else spelled + ("?" if single else "")
    return rf"(?:the )?{name}{tail}"


def _identifier(identifier: str) -> str:
    return r"(?<![\w.-])" + r"[- ]?v?".join(re.escape(p) for p in identifier.split("-")) + r"(?![\w-]|\.\d)"


class Notices:
    """The compiled grammar of a set of licences: rows with license_id, name, version and full_text."""

    def __init__(self, rows: list[dict]):
        rows = sorted(rows, key=lambda r: r["license_id"])
        self.ids = [r["license_id"] for r in rows]
        names = [r["name"] for r in rows]
        single = {r["license_id"]: names.count(r["name"]) == 1 for r in rows}
        # Longer forms first: the name of one licence may be the end of another's.
        forms = [(f"(?P<n{i}>{_name(r, single[r['license_id']])}|{_identifier(r['license_id'])})", len(r["name"])) for i, r in enumerate(rows)]
        one = "(?:" + "|".join(f for f, _ in sorted(forms, key=lambda x: -x[1])) + ")"
        self.one = re.compile(one, re.I)
        plain = re.sub(r"\(\?P<\w+>", "(?:", one)
        known = rf"(?:{plain}(?:(?: or |/| \| |, or ){plain})*)"
        unknown = r"(?:LicenseRef-[\w.-]+|[A-Z][\w.+-]*[\d.]+[\w.+-]*)"
        expr = rf"(?P<e>\(?(?:{known})\)?)"
        rest = r"(?:[.;,:]? ?(?:you may not use this file except[^.]*\.|see (?:the )?(?:file )?\S+[^.]*(?:\.|$)|all other use needs[^.]*\.|at your (?:choice|option)\.?|all rights reserved\.?|(?:for|see) details?[^.]*\.?|no warranty[^.]*\.?))*"
        under = r"(?:under|subject to|by)(?: (?:the )?(?:terms|conditions)(?: (?:and|or) conditions)?(?: of)?)?"
        short = [
            rf"SPDX-License-Identifier: ?{expr}",
            rf"@?Licen[sc]es?:? {expr}",
            rf"Terms: https?://[^\s/]+/(?:[\w-]+/)*{expr}/?",
            rf"(?:Dual|Multi|Tri)[- ]licen[sc]ed:? (?:choose |under )?(?:either )?{expr}",
            rf"(?:(?:This|These) (?:file|code|program|software|module|source|work|files)s? (?:is|are) )?(?:free software,? )?(?:distributed|released|licen[sc]ed|available|published|provided|covered|made available|offered) {under} {expr}",
            rf"(?:Portions|Parts) of this (?:file|module|code) come from [^:;]{{2,}}? and (?:stay|remain|are) (?:licen[sc]ed )?{under} {expr}",
        ]
        self.short = [re.compile(rf"{s}{rest}[.\s]*", re.I) for s in short]
        self.line = [re.compile(rf"\W*{s}{rest}\W*", re.I) for s in short[:3]]
        self.full = []
        for r in rows:
            title, _, body = r["full_text"].partition("[holder]")
            heading = " ".join(title.split("Copyright")[0].split())
            body = _words(body).replace("\\[year\\]", _YEAR).replace("\\[holder\\]", ".{2,}?")
            # What is before the body: the optional heading and line of ownership, in this order.
            before = re.compile(rf"(?:[#=\s*-]*)(?:Licen[sc]e )?(?:{_words(heading)} ?)?(?:(?:Copyright|©|\(c\))[^;]*)?", re.I)
            self.full.append((r["license_id"], re.compile(body, re.I), before))
        self.unknown = re.compile(rf"(?:SPDX-License-Identifier: ?|@licen[sc]e:? |Licen[sc]e: ){unknown}{rest}[.\s]*", re.I)
        self.trigger = re.compile(r"(?i)licen[sc]|copyright|spdx|release[ds]? under|distributed under|terms: |published under|©|" + "|".join(_words(" ".join(r["full_text"].partition("[holder]")[2].split()[:4])) for r in rows))

    def expression(self, text: str) -> str:
        """The licences of an expression, a choice in alphabetical order."""
        found = {self.ids[int(k[1:])] for m in self.one.finditer(text) for k, v in m.groupdict().items() if v}
        return " OR ".join(sorted(found))

    def of_text(self, text: str) -> list[str]:
        """The licence that a whole text states, if the grammar takes it completely."""
        flat = " ".join(text.split())
        for name, p, before in self.full:
            m = p.search(flat)
            if m and before.fullmatch(flat, 0, m.start()) and not _COPY.sub("", flat[m.end() :]).strip(" ."):
                return [name]
        flat = " ".join(_COPY.sub(" ", flat).split())
        for p in self.short:
            m = p.fullmatch(flat)
            if m:
                return [self.expression(m["e"])]
        return [UNKNOWN] if self.unknown.fullmatch(flat) else []

    def of_comment(self, text: str) -> list[str]:
        """The licences that a comment states: as a whole, else by paragraphs, else by lines."""
        whole = self.of_text(text)
        if whole:
            return whole
        found = []
        for paragraph in re.split(r"\n[ \t]*\n", text):
            own = self.of_text(paragraph)
            if not own:
                own = [self.expression(m["e"]) for line in paragraph.split("\n") for p in self.line if (m := p.fullmatch(line.strip()))]
            found += own
        return found

    def of_code(self, source: str, ending: str) -> list[str]:
        """The distinct licences of the notices in the comments of a file."""
        if not self.trigger.search(source):
            return []
        found: list[str] = []
        for c in comments(source, ending):
            if self.trigger.search(c):
                found += self.of_comment(c)
        return sorted({*found})

    def of_license_file(self, text: str) -> list[str]:
        """What a licence file states: a whole text, else the expression of its notices, else unknown."""
        found = self.of_comment(text)
        flat = " ".join(text.split())
        if not found:
            m = re.search(rf"(?i)identifier: ?(?P<e>[^.;]+)|(?:is|are) (?:available|licen[sc]ed|released|distributed) under (?P<e2>.*)", flat)
            found = [x] if m and (x := self.expression(m["e"] or m["e2"])) else []
        if not found:
            # The heading of a known text with changed wording states the licence still, if it is the only one named.
            x = self.expression(" ".join(flat.split()[:12]))
            found = [x] if x and " OR " not in x else []
        return sorted({*found}) or [UNKNOWN]

    def of_manifest(self, text: str) -> list[str]:
        m = re.search(r"(?m)^\s*[\"']?licen[sc]e[\"']?\s*[:=]\s*(?:\{\s*(?:[\"']?(?:text|type)[\"']?\s*[:=]\s*))?[\"']([^\"'\n]+)[\"']", text)
        if not m:
            return []
        x = self.expression(m[1]) if self._covers(m[1]) else ""
        return [x or UNKNOWN]

    def _covers(self, text: str) -> bool:
        return not re.sub(r"(?i)\bor\b|[\s()/|,]", "", self.one.sub("", text))

    def of_readme(self, text: str) -> list[str]:
        """What the section on the licence states in one of the usual ways."""
        m = re.search(r"(?im)^(?:#+\s*(?:licen[sc]e|licen[sc]ing|copyright)[^\n]*|licen[sc]e\s*\n[-=]{3,}[ \t]*)\r?\n(.*?)(?=^#+\s|\Z)", text, re.S | re.M)
        if not m:
            return []
        section = " ".join(m[1].split())
        # What a sentence denies or tells of the past is not stated.
        x = self.expression(" ".join(t for t in re.split(r"(?<=[.;!?])\s+|;\s*", section) if not _DENIED.search(t)))
        return [x] if x else [UNKNOWN] if re.search(r"(?i)licen|rights|terms|published|released", section) else []


# Strings are passed over, so that only real comments are seen.
_HASH = re.compile(r"(\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*+\"\"\"|'''(?:[^\\']|\\.|'(?!''))*+''')|(\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+')|(#[^\n]*+)", re.S)
_SLASH = re.compile(r"(\"(?:[^\"\\]|\\.)*+\"|`(?:[^`\\]|\\.)*+`|'(?:[^'\\\n]|\\.)*+')|(\Zx)|(//[^\n]*+)|(/\*(?:[^*]|\*(?!/))*+\*/)", re.S)
_RUST = re.compile(r"(r(#*)\".*?\"\2|\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\\n]|\\.[^']{0,8})')|(//[^\n]*+)|(/\*(?:[^*]|\*(?!/))*+\*/)", re.S)


def comments(source: str, ending: str) -> Iterator[str]:
    """The comments of a source without their marks; line comments on consecutive lines are one. In Python, strings that are statements count too."""
    source = source.replace("\r\n", "\n").replace("\r", "\n").removeprefix("﻿")
    block: list[str] = []
    end = -2
    hashes = ending in ("py", "sh")
    for m in (_HASH if hashes else _RUST if ending == "rs" else _SLASH).finditer(source):
        line = m[3]
        other = m[1] if hashes else m[4]
        if line:
            text = re.sub(r"^(?:#+!?|/{2,}!?)", "", line).strip()
            if block and source[end : m.start()].strip(" \t") == "\n":
                block.append(text)
            else:
                if block:
                    yield "\n".join(block)
                block = [text]
            end = m.end()
        elif other and (not hashes or ending == "py" and not source[source.rfind("\n", 0, m.start()) + 1 : m.start()].strip()):
            if block:
                yield "\n".join(block)
                block = []
            if hashes:
                yield "\n".join(x.strip() for x in other[3:-3].split("\n"))
            else:
                yield "\n".join(re.sub(r"^\s*\*+ ?", "", x).strip() for x in other[2:-2].split("\n"))
    if block:
        yield "\n".join(block)


def stated(sources: DataFrame, notices: Notices) -> DataFrame:
    """(repo_id, file_path, role, licenses) of code files (role code) and of top-level licence files, manifests and readmes (role repository)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, role, source in zip(b["file_path"], b["role"], b["source"]):
                text = (source or b"").decode("utf-8", "replace")
                if role == "code":
                    found = notices.of_code(text, path.rsplit(".", 1)[-1])
                elif role == "license":
                    found = notices.of_license_file(text)
                elif role == "manifest":
                    found = notices.of_manifest(text)
                else:
                    found = notices.of_readme(text)
                out.append(found)
            yield b.assign(licenses=out)[["repo_id", "file_path", "role", "licenses"]]

    p = F.col("file_path")
    role = F.when(p.rlike(CODE), "code").when(p.rlike(LICENSE_FILE) & ~p.contains("/"), "license").when(p.rlike(MANIFEST), "manifest").when(p.rlike(README) & ~p.contains("/"), "readme")
    rows = sources.select("repo_id", "file_path", "source", role.alias("role")).where("role IS NOT NULL")
    repo = sources.schema["repo_id"].dataType.simpleString()
    return spread(rows).mapInPandas(read, f"repo_id {repo}, file_path string, role string, licenses array<string>")


def licenses(sources: DataFrame, repos: DataFrame, texts: DataFrame) -> DataFrame:
    """(repo_id, file_path, license): a row per code file and, with file_path '', one per repository.

    A repository has the licence that its top-level licence files, manifests and readme state, CONFLICT if they disagree and
    UNKNOWN if there is none or it is not among texts. A file has the licence of its own notice; CONFLICT if its notices differ
    or differ from a single licence of the repository; without a notice the repository's value. A choice is written 'A OR B'.
    Files of a repository that is not in repos have the values its own files give. Null and empty contents have no notice. Rows
    that repeat a file give one row.
    """
    rows = [r.asDict() for r in texts.select("license_id", "name", "version", "full_text").limit(MOST_LICENSES + 1).collect()]
    if len(rows) > MOST_LICENSES:
        raise ValueError(f"more than {MOST_LICENSES} licences")
    found = stated(sources, Notices(rows)).groupBy("repo_id", "file_path").agg(F.first("role").alias("role"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("licenses")))).alias("own"))
    top = found.where("role != 'code'").groupBy("repo_id").agg(F.array_distinct(F.flatten(F.collect_list("own"))).alias("all"))
    value = F.when(F.coalesce(F.size("all"), F.lit(0)) < 1, UNKNOWN).when(F.size("all") == 1, F.element_at("all", 1)).otherwise(CONFLICT)
    by_repo = repos.select("repo_id").union(sources.select("repo_id")).distinct().join(top, "repo_id", "left").select("repo_id", value.alias("repo"))
    code = found.where("role = 'code'").join(by_repo, "repo_id", "left")
    single = ~F.col("repo").isin(UNKNOWN, CONFLICT) & ~F.col("repo").contains(" OR ")
    own = F.element_at("own", 1)
    license_ = F.when(F.size("own") == 0, F.col("repo")).when(F.size("own") > 1, CONFLICT).when(single & (own != F.col("repo")), CONFLICT).otherwise(own)
    one_each = repos.select("repo_id").distinct().join(by_repo, "repo_id").select("repo_id", F.lit("").alias("file_path"), F.col("repo").alias("license"))
    return code.select("repo_id", "file_path", license_.alias("license")).unionByName(one_each)
