"""From chunk summaries to file summaries, digests and the documents made of them."""

from __future__ import annotations

import json
import subprocess
import tomllib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions.paths import dirname
from sparkloom.functions.text import first_sentence, license_of_text
from sparkloom.operators.graph import degrees, mermaid, top_files, within

# Marks of a route in a decorator.
ROUTES = [".route(", ".get(", ".post(", ".put(", ".delete(", ".patch(", "api_view", "api_route"]
LICENSE_FILES = ["LICENSE", "LICENSE.md", "LICENSE.txt", "LICENSE.rst", "COPYING"]
#: Manifests that may declare a licence, in the order in which they are asked.
DECLARING = ["pyproject.toml", "package.json"]


def file_parts(chunk_docs: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """keys, file_path, chunk_count, failed, summaries in the order of the chunks' first lines; chunks that are not known come first."""
    lines = chunks.select(*keys, F.col("id").alias("chunk_id"), "start_line").dropDuplicates([*keys, "chunk_id"])
    joined = chunk_docs.join(lines, [*keys, "chunk_id"], "left")
    good = F.when(F.col("error").isNull() & (F.col("summary") != ""), F.struct(F.coalesce("start_line", F.lit(0)).alias("line"), "chunk_id", "summary"))
    return joined.groupBy(*keys, "file_path").agg(F.count("*").alias("chunk_count"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.transform(F.array_sort(F.collect_list(good)), lambda x: x["summary"]).alias("summaries"), F.bool_and(F.col("error").isNull()).alias("complete"))


def language_breakdown(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, files, breakdown 'language: n, ...' by number and name, and the primary language."""
    counts = files.groupBy(*keys, F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "language", "n")))
    return counts.groupBy(*keys).agg(F.sum("n").alias("files"), F.array_join(F.transform(ordered, lambda x: F.concat(x["language"], F.lit(": "), x["n"].cast("string"))), ", ").alias("breakdown"), F.element_at(F.transform(ordered, lambda x: x["language"]), 1).alias("primary"))


def repository_digest(file_docs: DataFrame, edges: DataFrame, keys: list[str], most: int = 40) -> DataFrame:
    """keys, file_digest, imports, truncated: a line for each of the most depended on files, by path, and the imports among them."""
    if not keys:
        one = F.lit(1).alias("_one")
        return repository_digest(file_docs.select("*", one), edges.select("*", one), ["_one"], most).drop("_one")
    good = file_docs.where(F.col("error").isNull() & (F.col("summary") != "")).dropDuplicates([*keys, "file_path"])
    chosen = top_files(good, degrees(edges, keys), keys, "dependents", most)
    line = F.format_string("- %s (%s): %s", "file_path", F.coalesce("language", F.lit("unknown")), "summary")
    text = chosen.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_path", line.alias("l")))), lambda x: x["l"]), "\n").alias("file_digest"))
    pairs = within(edges.select(*keys, "source", F.explode("targets").alias("target")).distinct(), chosen, keys)
    imports = pairs.groupBy(*keys, "source").agg(F.format_string("- %s imports: %s", F.first("source"), F.array_join(F.array_sort(F.collect_set("target")), ", ")).alias("l")).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("l")), "\n").alias("imports"))
    counts = good.groupBy(*keys).agg((F.count("*") > most).alias("truncated"))
    return text.join(imports, keys, "left").join(counts, keys).select(*keys, "file_digest", F.coalesce("imports", F.lit("(no imports among these files)")).alias("imports"), "truncated")


def architecture(file_docs: DataFrame, edges: DataFrame, most: int = 25) -> DataFrame:
    """(diagram, file_digest) of one repository: its files of highest degree."""
    files = file_docs.dropDuplicates(["file_path"])
    chosen = top_files(files, degrees(edges, []), [], "degree", most)
    line = F.format_string("- %s: %s", "file_path", F.coalesce(F.nullif("summary", F.lit("")), F.lit("(not documented)")))
    digest = chosen.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_path", line.alias("l")))), lambda x: x["l"]), "\n").alias("file_digest"))
    pairs = within(edges.select("source", F.explode("targets").alias("target")).distinct(), chosen, [])
    return mermaid(chosen, pairs).join(F.broadcast(digest), how="cross")  # one row each


def endpoints(symbols: DataFrame) -> DataFrame:
    """The symbols with a decorator that marks a route."""
    return symbols.where(F.exists("decorators", lambda d: F.exists(F.array(*map(F.lit, ROUTES)), lambda r: F.contains(F.lower(d), r))))


def endpoint_digest(symbols: DataFrame, keys: list[str]) -> DataFrame:
    block = F.format_string("- %s\n  file: %s\n  decorators: %s\n  doc: %s", F.coalesce("signature", "name"), "file_path", F.array_join("decorators", ", "), F.coalesce(F.nullif(first_sentence(F.col("docstring")), F.lit("")), F.lit("(no docstring)")))
    return endpoints(symbols).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_path", "name", block.alias("b")))), lambda x: x["b"]), "\n").alias("digest"))


def directories(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, directory and its files, sorted."""
    return files.groupBy(*keys, dirname(F.col("file_path")).alias("directory")).agg(F.array_sort(F.collect_set("file_path")).alias("files"))


def structure_document(file_docs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text: a table of the files of each directory with the first sentence of their summary."""
    d = dirname(F.col("file_path"))
    row = F.format_string("| `%s` | %s |", F.regexp_extract("file_path", "([^/]*)$", 1), F.coalesce(F.nullif(F.regexp_replace(first_sentence(F.col("summary")), r"\|", "\\\\|"), F.lit("")), F.lit("(not documented)")))
    per = file_docs.dropDuplicates([*keys, "file_path"]).groupBy(*keys, d.alias("d")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_path", row.alias("r")))), lambda x: x["r"]), "\n").alias("rows"))
    head = F.when(F.col("d") == "", F.lit("### Repository root")).otherwise(F.format_string("### `%s`", "d"))
    return per.groupBy(*keys).agg(F.concat(F.lit("# Project structure\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", F.concat(head, F.lit("\n\n| File | Purpose |\n|---|---|\n"), F.col("rows")).alias("t")))), lambda x: x["t"]), "\n\n"), F.lit("\n")).alias("text"))


def commits(spark: SparkSession, root: str, most: int = 20, timeout: float = 10) -> DataFrame | None:
    """(short_hash, date, subject, files_changed), newest first (ord); None if the folder is no repository, no rows without commits."""
    run = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, timeout=timeout)
    schema = "ord int, short_hash string, date string, subject string, files_changed int"
    try:
        if run("rev-parse", "--git-dir").returncode:
            return None
        got = run("log", f"-{most}", "--date=short", "--format=%x1e%h%x1f%ad%x1f%s", "--numstat")
    except (OSError, subprocess.TimeoutExpired):
        return None
    rows = []
    for i, block in enumerate(got.stdout.split("\x1e")[1:] if not got.returncode else []):
        head, *stats = block.strip("\n").split("\n")
        h, date, subject = head.split("\x1f", 2)
        rows.append((i, h, date, subject, sum(1 for x in stats if x.strip())))
    return spark.createDataFrame(rows, schema)


def changelog_document(history: DataFrame) -> DataFrame:
    n = F.col("files_changed")
    line = F.concat(F.format_string("- `%s` (%s) %s", "short_hash", "date", "subject"), F.when(n > 0, F.format_string(" (%d file%s changed)", n, F.when(n == 1, "").otherwise("s"))).otherwise(""))
    return history.agg(F.concat(F.lit("# Changelog\n\n"), F.coalesce(F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n"), F.lit("")), F.lit("No commits yet.")), F.lit("\n")).alias("text"))


def _toml(text: str) -> dict:
    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return {}


def manifest(path: str, text: str) -> dict | None:
    """What a manifest tells: ecosystem, install command, requirement, dependencies, optional ones and scripts. None for other files and broken ones."""
    name = path.rsplit("/", 1)[-1]
    none = {"requires": None, "dependencies": [], "optional": {}, "scripts": {}}
    if name == "pyproject.toml" and (t := _toml(text).get("project")):
        return none | {"ecosystem": "python", "install": "pip install .", "requires": t.get("requires-python"), "dependencies": list(t.get("dependencies", [])), "optional": dict(t.get("optional-dependencies", {})), "scripts": dict(t.get("scripts", {}))}
    if name == "requirements.txt" or path.endswith("requirements/base.txt"):
        return none | {"ecosystem": "python", "install": f"pip install -r {path}", "dependencies": [x.strip() for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]}
    if name == "package.json":
        try:
            j = json.loads(text)
        except ValueError:
            return None
        pairs = lambda k: [f"{a}@{b}" for a, b in (j.get(k) or {}).items()]
        return none | {"ecosystem": "node", "install": "npm install", "requires": (j.get("engines") or {}).get("node"), "dependencies": pairs("dependencies"), "optional": {"development": pairs("devDependencies")} if j.get("devDependencies") else {}, "scripts": dict(j.get("scripts") or {})}
    if name == "Cargo.toml" and (t := _toml(text)):
        shown = lambda d: [f'{k} = "{v if isinstance(v, str) else v.get("version", "*")}"' for k, v in d.items()]
        return none | {"ecosystem": "rust", "install": "cargo build", "requires": t.get("package", {}).get("rust-version"), "dependencies": shown(t.get("dependencies", {})), "optional": {"development": shown(t["dev-dependencies"])} if t.get("dev-dependencies") else {}}
    if name == "go.mod":
        found, block = [], False
        for x in (line.split("//")[0].strip() for line in text.splitlines()):
            if x.startswith("require ("):
                block = True
            elif x == ")":
                block = False
            elif block and x or x.startswith("require "):
                found.append(x.removeprefix("require ").strip())
        version = next((x.split()[1] for x in text.splitlines() if x.startswith("go ") and len(x.split()) > 1), None)
        return none | {"ecosystem": "go", "install": "go mod download", "requires": version, "dependencies": found}
    return None


MANIFEST = "ecosystem string, install string, requires string, dependencies array<string>, optional map<string,array<string>>, scripts map<string,string>"
MANIFEST_NAMES = r"(?:^|/)(?:pyproject\.toml|requirements\.txt|package\.json|Cargo\.toml|go\.mod)$|requirements/base\.txt$"


def manifests(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, file_path and the columns of MANIFEST of every manifest. files: keys, file_path, source."""

    def run(batches):
        for b in batches:
            got = [manifest(p, (s or b"").decode("utf-8", "replace")) for p, s in zip(b["file_path"], b["source"])]
            yield b.assign(m=got)[[*keys, "file_path", "m"]]

    own = files.where(F.col("file_path").rlike(MANIFEST_NAMES)).select(*keys, "file_path", "source")
    types = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in [*keys, "file_path"])
    fields = ", ".join(x.replace(" ", ": ", 1) for x in MANIFEST.split(", "))
    return own.mapInPandas(run, f"{types}, m struct<{fields}>").where("m IS NOT NULL").select(*keys, "file_path", "m.*")


def dependencies_document(found: DataFrame, keys: list[str]) -> DataFrame:
    listed = F.when(F.size("dependencies") > 0, F.concat(F.lit("\n\n"), F.array_join(F.transform("dependencies", lambda x: F.concat(F.lit("- `"), x, F.lit("`"))), "\n"))).otherwise("\n\nNo dependencies.")
    part = F.concat(F.format_string("## %s (`%s`)", "ecosystem", "file_path"), F.coalesce(F.concat(F.lit("\n\nRequires: "), "requires"), F.lit("")), F.format_string("\n\n```\n%s\n```", "install"), listed)
    return found.groupBy(*keys).agg(F.concat(F.lit("# Dependencies\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_path", part.alias("p")))), lambda x: x["p"]), "\n\n"), F.lit("\n")).alias("text"))


#: A declared licence longer than this is a text, not a name.
LONGEST_DECLARED = 40


def declared_license(path: str, text: str) -> str | None:
    """The licence that a pyproject.toml or package.json declares, as a string or the text of a table; null if none, or too long for a name."""
    try:
        found = _toml(text).get("project", {}).get("license") if path == "pyproject.toml" else json.loads(text).get("license")
    except (ValueError, AttributeError):
        return None
    value = (found if isinstance(found, str) else str(found.get("text", "")) if isinstance(found, dict) else "").strip()
    return value if value and len(value) <= LONGEST_DECLARED else None


def licenses(files: DataFrame, keys: list[str]) -> DataFrame:
    """keys, license, file: what the first of the usual licence files at the top says, without one what a manifest at the top declares. files: keys, file_path, source.

    A licence file with unknown words gives a null licence, and manifests are not asked then.
    """
    rank = F.array_position(F.array(*map(F.lit, [*LICENSE_FILES, *DECLARING])), F.col("file_path"))

    @F.pandas_udf("string")
    def declared(path: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([declared_license(p, t or "") for p, t in zip(path, text)], dtype=object)

    own = files.where(F.col("file_path").isin(*LICENSE_FILES, *DECLARING)).select(*keys, "file_path", rank.alias("r"), F.decode("source", "UTF-8").alias("t"))
    texts = own.where(F.col("file_path").isin(*LICENSE_FILES)).select(*keys, "file_path", "r", license_of_text(F.col("t")).alias("license"))
    manifests_ = own.where(F.col("file_path").isin(*DECLARING)).select(*keys, "file_path", "r", declared("file_path", "t").alias("license")).where("license IS NOT NULL")
    return texts.unionByName(manifests_).groupBy(*keys).agg(F.min_by(F.struct("license", F.col("file_path").alias("file")), "r").alias("x")).select(*keys, "x.license", "x.file")


def readme_header(name, license_, language, files):
    """The centred title with its badges, as a column."""
    badge = lambda label, value, colour: F.when(value.isNotNull(), F.concat(F.lit(f'  <img src="https://img.shields.io/badge/{label}-'), F.regexp_replace(F.regexp_replace(value.cast("string"), "-", "--"), " ", "_"), F.lit(f'-{colour}?style=flat-square" alt="{label}">')))
    return F.concat(F.lit('<h1 align="center">'), name, F.lit('</h1>\n\n<p align="center">\n'), F.concat_ws("\n", badge("license", license_, "green"), badge("language", language, "blue"), badge("files", files, "lightgrey")), F.lit("\n</p>\n\n---\n"))


def export_set(documents: DataFrame) -> DataFrame:
    """documents (name, text) in the order of a site, each with a table of contents after its title; empty ones are left out."""
    from sparkloom.functions.text import headings, slug

    order = ["README", "ARCHITECTURE", "API", "GITHUB_README", "STRUCTURE", "CHANGELOG", "DEPENDENCIES", "REVIEW"]
    h = headings(F.col("text"))
    entries = F.transform(h, lambda x: F.concat(F.repeat(F.lit("  "), x["level"] - 2), F.lit("- ["), x["title"], F.lit("](#"), slug(x["title"]), F.lit(")")))
    toc = F.concat(F.lit("## Table of Contents\n\n"), F.array_join(entries, "\n"), F.lit("\n\n"))
    after = F.regexp_extract("text", r"(?s)^(\s*# [^\n]*\n+)", 1)
    text = F.when((F.size(h) > 1) & ~F.col("text").contains("## Table of Contents"), F.concat(after, toc, F.substring("text", F.length(after) + 1, F.length("text")))).otherwise(F.col("text"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("name")), F.lit(0)), F.lit(99))
    return documents.where(F.trim("text") != "").select(place.alias("place"), "name", text.alias("text"))


def stage_order(groups: DataFrame) -> DataFrame:
    """(text): numbered groups of stages (group, stage); stages of one group may run at once."""
    per = groups.groupBy("group").agg(F.array_join(F.array_sort(F.collect_set("stage")), ", ").alias("s"), F.count("*").alias("n"))
    line = F.concat(F.format_string("%d. ", F.row_number().over(Window.orderBy("group"))), "s", F.when(F.col("n") > 1, " (in any order)").otherwise(""))
    return per.select("group", line.alias("l")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group", "l"))), lambda x: x["l"]), "\n").alias("text"))
