"""Source files that do not parse.

Files are lexed into rows of tokens and of the distinct pairs of adjacent tokens. The pairs are anti-joined against those that the grammar of the file's
language permits; a file with a pair left over is invalid. The tokens of the other files are validated by windowed reductions: bracket groups and
blocks, innermost first, and statements are windows of tokens that are replaced by their readings under the productions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import python_grammar
from sparkloom.llm.grammar import TERMINAL, Grammar, Reducer
from sparkloom.llm.languages import LANGUAGES, Bad
from sparkloom.session import cut_lineage, spread

ENDINGS = r"\.(py|js|mjs|ts|mts|go|rs|json)$"
#: A pair is BASE times the first token and the second; a grammar has fewer terminals.
BASE = 256


@lru_cache(maxsize=8)
def _reducer(language: str) -> Reducer:
    return Reducer(grammars()[language])


def grammars() -> dict[str, Grammar]:
    """Language -> its grammar."""
    return {"python": python_grammar.PYTHON} | {name: g for name, g, _ in LANGUAGES.values()}


def language_of(ending: str) -> str:
    return "python" if ending == "py" else LANGUAGES[ending][0]


def tokens_of(source: bytes, ending: str) -> bytes | None:
    """A byte for each token of a file; None if its bytes are no tokens of the language."""
    try:
        if ending == "py":
            chars = python_grammar.lex(source)
        else:
            _, g, lex = LANGUAGES[ending]
            chars = "".join(map(g.terminals.__getitem__, lex(source.decode("utf-8").removeprefix("\ufeff"))))
    except (ValueError, LookupError, Bad):  # no text, or a token that no production has
        return None
    return chars.encode("utf-16-le")[::2]  # terminals are TERMINAL, a multiple of 256, and more


def pairs_in(tokens: bytes) -> list[int]:
    """The distinct pairs of adjacent tokens."""
    t = np.frombuffer(tokens, np.uint8).astype(np.int32)
    return np.unique(t[:-1] * BASE + t[1:]).tolist()


def reduced(tokens: bytes, language: str) -> str | None:
    """Why the windows of the tokens do not reduce to a sentence of the grammar: nesting or structure; None if they do."""
    chars = (np.frombuffer(tokens, np.uint8).astype("<u2") + TERMINAL).tobytes().decode("utf-16-le")
    return _reducer(language).rejects(chars)


def permitted(spark: SparkSession) -> DataFrame:
    """(language, pair): all pairs that the grammars permit; as many as the grammars have, whatever the data."""
    number = lambda g, t: ord(g.terminals[t]) - TERMINAL
    rows = {(name, number(g, a) * BASE + number(g, b)) for name, g in grammars().items() for a, b in g.pairs() if a in g.terminals and b in g.terminals}
    return spark.createDataFrame(pd.DataFrame(sorted(rows), columns=["language", "pair"]).astype({"pair": "int32"}), "language string, pair int")


def lexed(sources: DataFrame) -> DataFrame:
    """(repo_id, file_path, language, tokens, pairs) of the files that are judged by the ending of their name; tokens is null if there are none of the language."""

    def lex(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tokens = [tokens_of(s, e) for s, e in zip(b["source"], b["ending"])]
            yield pd.DataFrame({"repo_id": b["repo_id"], "file_path": b["file_path"], "language": [language_of(e) for e in b["ending"]], "tokens": tokens, "pairs": [[] if t is None else pairs_in(t) for t in tokens]})

    judged = sources.where(F.col("file_path").rlike(ENDINGS) & F.col("source").isNotNull()).select("repo_id", "file_path", F.regexp_extract("file_path", ENDINGS, 1).alias("ending"), "source")
    kind = sources.schema["repo_id"].dataType.simpleString()
    return spread(judged).mapInPandas(lex, f"repo_id {kind}, file_path string, language string, tokens binary, pairs array<int>")


def by_reduction(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, language, reason) of the files whose tokens do not reduce."""

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["reason"] = [reduced(t, name) for t, name in zip(b["tokens"], b["language"])]
            yield b.loc[b["reason"].notna(), ["repo_id", "file_path", "language", "reason"]]

    kind = files.schema["repo_id"].dataType.simpleString()
    return files.select("repo_id", "file_path", "language", "tokens").mapInPandas(reduce, f"repo_id {kind}, file_path string, language string, reason string")


def invalid(sources: DataFrame) -> DataFrame:
    """(repo_id, file_path, language, reason), one row for each file that the grammar of its language rejects.

    Judged are names ending in .py, .js, .mjs, .ts, .mts, .go, .rs and .json; a leading byte-order mark is no part of the text.
    Other names and null contents are not judged. An empty file is rejected where the grammar has no empty text (JSON, Go).
    A file that is there twice with different bytes is invalid if one of them is. reason: tokens (its bytes are no tokens of the
    language), pair (a pair of adjacent tokens that the grammar does not permit), nesting or structure.
    """
    keys = ["repo_id", "file_path", "language"]
    files = cut_lineage(lexed(sources))
    unread = files.where("tokens IS NULL").select(*keys, F.lit("tokens").alias("reason"))
    pairs = files.select(*keys, F.explode("pairs").alias("pair"))
    apart = pairs.join(F.broadcast(permitted(sources.sparkSession)), ["language", "pair"], "left_anti").select(*keys, F.lit("pair").alias("reason")).distinct()
    # Only files all of whose pairs are permitted are reduced.
    rest = files.where("tokens IS NOT NULL").join(apart, keys, "left_anti")
    return unread.unionByName(apart).unionByName(by_reduction(rest)).groupBy(*keys).agg(F.max("reason").alias("reason"))


def rates(sources: DataFrame, file_docs: DataFrame) -> DataFrame:
    """(repo_id, language, files, invalid, rate, reported) of the judged files with documentation; reported counts invalid files with an error there."""
    ending = F.regexp_extract("file_path", ENDINGS, 1)
    names = {e: language_of(e) for e in ["py", *LANGUAGES]}
    language = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[ending]
    files = file_docs.where(F.col("file_path").rlike(ENDINGS)).groupBy("repo_id", "file_path").agg(F.max(F.when(F.coalesce("error", F.lit("")) != "", 1).otherwise(0)).alias("_error"))
    bad = invalid(sources).select("repo_id", "file_path", F.lit(1).alias("_bad"))
    both = files.withColumn("language", language).join(bad, ["repo_id", "file_path"], "left")
    out = both.groupBy("repo_id", "language").agg(F.count("*").alias("files"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("invalid"), F.coalesce(F.sum(F.col("_bad") * F.col("_error")), F.lit(0)).alias("reported"))
    return out.select("repo_id", "language", "files", "invalid", (F.col("invalid") / F.col("files")).alias("rate"), "reported")
