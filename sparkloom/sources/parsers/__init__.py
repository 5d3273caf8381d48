"""Parsing sources into symbols and imports."""

from sparkloom.sources.parsers.run import EXTRACTORS, IMPORTS, SYMBOLS, imports, parse, symbols

__all__ = ["EXTRACTORS", "IMPORTS", "SYMBOLS", "imports", "parse", "symbols"]
