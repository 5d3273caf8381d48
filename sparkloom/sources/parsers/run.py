"""Parsing whole tables of files; one bad file never stops the others."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import spread
from sparkloom.sources.parsers import braces, python

SYMBOL = "struct<name: string, kind: string, start_byte: int, end_byte: int, start_line: int, end_line: int, signature: string, docstring: string, return_type: string, parent: string, parameters: array<struct<name: string, type_annotation: string, default_value: string>>, decorators: array<string>, children: array<string>, is_exported: boolean>"
IMPORT = "struct<module: string, imported_names: array<string>, alias: string, is_relative: boolean>"
SYMBOLS, IMPORTS = f"array<{SYMBOL}>", f"array<{IMPORT}>"

#: Language -> (path, bytes) -> Parsed; more languages can be added.
EXTRACTORS = {"python": python.extract, "javascript": braces.javascript, "jsx": braces.javascript, "typescript": braces.javascript, "tsx": braces.javascript, "go": braces.go, "rust": braces.rust}


def parse(files: DataFrame, keys: list[str], path: str = "file_path", language: str = "language", source: str = "source") -> DataFrame:
    """keys and file_path, language, symbols, imports, has_syntax_errors, errors of the files whose language has an extractor.

    Null contents give no symbols. What an extractor throws becomes an error of its file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, lang, x in zip(b["file_path"], b["language"], b["source"]):
                try:
                    rows.append(EXTRACTORS[lang](p, x or b"").rows())
                except Exception as e:  # noqa: BLE001
                    rows.append({"symbols": [], "imports": [], "has_syntax_errors": True, "errors": [f"{type(e).__name__}: {e}"]})
            yield pd.concat([b.drop(columns="source").reset_index(drop=True), pd.DataFrame(rows, columns=["symbols", "imports", "has_syntax_errors", "errors"])], axis=1)

    others = {"file_path": F.col(path), "language": F.lower(language)}
    names = [*keys, *(c for c in others if c not in keys)]
    own = files.where(F.lower(language).isin(*EXTRACTORS)).select(*keys, *(e.alias(c) for c, e in others.items() if c not in keys), F.col(source).alias("source"))
    types = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in names)
    return spread(own).mapInPandas(run, f"{types}, symbols {SYMBOLS}, imports {IMPORTS}, has_syntax_errors boolean, errors array<string>")


def symbols(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per symbol with its place in the file (ord)."""
    return parsed.select(*keys, "language", F.posexplode("symbols").alias("ord", "s")).select(*keys, "language", "ord", "s.*")


def imports(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per import with its place in the file (ord)."""
    return parsed.select(*keys, "language", F.posexplode("imports").alias("ord", "i")).select(*keys, "language", "ord", "i.*")
