"""Documents written by a model: prompts, drafts that are checked and revised, and their merge."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import providers, review
from sparkloom.session import cut_lineage

#: Prompts by name, with {placeholders}. Others can be added or put in their place.
PROMPTS = {
    "chunk": "Summarise this {language} code for someone who will maintain it.\n\n{code}",
    "file": "Summarise this file from the summaries of its parts.\n\n{parts}",
    "repository": "Describe what this repository is for, from its files and their imports.\n\n{files}\n\n{imports}",
    "architecture": "Explain how the parts of this repository work together.\n\n{files}\n\n{diagram}",
    "api": "Document these endpoints.\n\n{endpoints}",
    "readme": "Write a readme from these facts alone.\n\n{facts}",
    "critique": "Check the document against the facts. Reply STATUS: PASS, or STATUS: ISSUES and a bullet for each claim without support.\n\nDocument:\n{document}\n\nFacts:\n{facts}",
    "revise": "Rewrite the document so that none of these objections holds, and change nothing else.\n\nObjections:\n{issues}\n\nDocument:\n{document}\n\nFacts:\n{facts}",
    "review": "Review the document. Reply STATUS: PASS, or STATUS: ISSUES and a bullet for each of them.\n\n{document}",
}
_PLACE = re.compile(r"\{(\w+)\}")


def rendered(template: str, values: dict[str, Column]) -> Column:
    """The template with the columns in the place of their names; a name without a column, and a null, render as nothing."""
    parts = _PLACE.split(template)
    return F.concat(*(F.lit(p) if i % 2 == 0 else F.coalesce(values[p].cast("string"), F.lit("")) if p in values else F.lit("") for i, p in enumerate(parts)))


def written(facts: DataFrame, files: DataFrame, provider, rounds: int = 3, draft: str = "readme", wait: float = 1.0) -> DataFrame:
    """(name, facts, text, rounds, issues, error): documents written from (name, facts), criticised by rules and by the model, and revised until nothing is
    objected to, at most so many times. files (file_path) are what a document may refer to.

    Each round asks the model about the documents that are still open only. What is left to object to after the last round stays in issues. A failed draft
    or a failed revision ends with its error and the text so far; a failed critique objects to nothing.
    """
    ask = lambda rows, prompt, most: providers.generate(rows.withColumn("_prompt", prompt), "_prompt", provider, most, wait=wait)
    none = F.array().cast("array<string>")
    first = ask(facts.select("name", "facts"), rendered(PROMPTS[draft], {"facts": F.col("facts")}), 4500)
    open_ = cut_lineage(first.select("name", "facts", F.coalesce("summary", F.lit("")).alias("text"), F.lit(0).alias("rounds"), none.alias("issues"), "error"))
    done = open_.where("error IS NOT NULL")
    open_ = open_.where("error IS NULL")
    for n in range(rounds + 1):
        told = ask(open_.drop("issues", "error"), rendered(PROMPTS["critique"], {"document": F.col("text"), "facts": F.col("facts")}), 1200)
        passed, said = review.review_of(F.coalesce("summary", F.lit("")))
        objected = told.select("name", "facts", "text", "rounds", F.when(passed, none).otherwise(said).alias("said"))
        rules = review.findings(open_.select("name", "text"), files).withColumnRenamed("issues", "_f")
        checked = cut_lineage(objected.join(rules, "name", "left").select("name", "facts", "text", "rounds", F.array_distinct(F.concat(F.coalesce("_f", none), "said")).alias("issues"), F.lit(None).cast("string").alias("error")))
        settled = F.size("issues") == 0
        done = done.unionByName(checked if n == rounds else checked.where(settled))
        if n == rounds or checked.where(~settled).isEmpty():
            break
        again = ask(checked.where(~settled), rendered(PROMPTS["revise"], {"issues": F.array_join("issues", "\n"), "document": F.col("text"), "facts": F.col("facts")}), 4500)
        revised = cut_lineage(again.select("name", "facts", F.coalesce("summary", "text").alias("text"), (F.col("rounds") + 1).alias("rounds"), "issues", "error"))
        done, open_ = done.unionByName(revised.where("error IS NOT NULL")), revised.where("error IS NULL")
    return done


def merged_documents(parts: list[DataFrame]) -> DataFrame:
    """(name, text): the documents of branches that ran beside each other, name by name; of one that several have, the later branch's counts."""
    out = None
    for i, p in enumerate(parts):
        own = p.select("name", "text", F.lit(i).alias("i"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("name").agg(F.max_by("text", F.struct("i", "text")).alias("text"))


def top_symbols(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """keys, names: the names of each file's symbols that belong to no other, in their order (ord)."""
    return symbols.where("parent IS NULL").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("names"))


# What a heading that contains a word is marked with, the first word that fits counts; and the mark of all others.
HEADING_MARKS = [
    ("overview", "🔍"), ("summary", "🔍"), ("architecture", "🏗️"), ("design", "🏗️"), ("component", "🧩"), ("module", "🧩"), ("subsystem", "🧩"), ("api", "🔌"), ("interface", "🔌"), ("config", "⚙️"), ("setting", "⚙️"), ("database", "💾"), ("storage", "💾"), ("persist", "💾"), ("memory", "💾"),
    ("security", "🔐"), ("auth", "🔐"), ("performance", "⚡"), ("test", "🧪"), ("deploy", "🚀"), ("infrastructure", "🚀"), ("decision", "🎯"), ("pattern", "🎯"), ("pipeline", "🔄"), ("workflow", "🔄"), ("stage", "🔄"), ("util", "🛠️"), ("helper", "🛠️"), ("tool", "🛠️"), ("provider", "🔗"), ("backend", "🔗"),
    ("integration", "🔗"), ("dependency", "🔗"), ("dependencies", "🔗"), ("scan", "🔎"), ("language", "🌐"), ("lexer", "🌐"), ("syntax", "🌳"), ("symbol", "🌳"), ("parsing", "🌳"), ("parser", "🌳"), ("graph", "🕸️"), ("state", "🧠"), ("orchestrat", "🎼"), ("export", "📤"), ("output", "📤"), ("render", "📤"),
    ("format", "📤"), ("knowledge", "📚"), ("review", "🔬"), ("embed", "🧬"), ("vector", "🧬"), ("semantic", "🧬"), ("retriev", "🧭"), ("search", "🧭"), ("changelog", "📝"), ("version", "📝"), ("release", "📝"), ("cache", "🗃️"), ("log", "📜"), ("hash", "🔑"), ("error", "⚠️"), ("exception", "⚠️"), ("cli", "💻"),
    ("command", "💻"), ("queue", "⏱️"), ("schedul", "⏱️"), ("document", "📖"), ("data", "📊"),
]
DEFAULT_MARK = "📄"


def marked_headings(text: Column) -> Column:
    """The text with a mark before the title of each heading of the second level."""

    def line(x: Column) -> Column:
        title = F.lower(x)
        mark = F.coalesce(*(F.when(title.contains(word), m) for word, m in HEADING_MARKS), F.lit(DEFAULT_MARK))
        return F.when(x.rlike(r"^## \S"), F.concat(F.lit("## "), mark, F.lit(" "), F.substring(x, F.lit(4), F.length(x)))).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")
