"""Cutting files into chunks of whole symbols within a budget of tokens.

The units of a file (symbols that no other contains, and the gaps between them) come from windows over its symbols; the greedy packing
depends on what was packed before and so runs file by file, one file being the unit of work.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import spread

CHUNK = "start_line int, end_line int, start_byte int, end_byte int, content string, symbol_names array<string>, parent_symbol string, is_partial boolean, context_header string, token_estimate int"


def roots(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """The symbols whose span no other of the file contains; of equal spans the first counts.

    A running maximum of the ends over the spans in order of their start: no join of the spans with themselves.
    """
    w = Window.partitionBy(*keys).orderBy("start_byte", F.desc("end_byte"), "ord").rowsBetween(Window.unboundedPreceding, -1)
    return symbols.withColumn("_reach", F.max("end_byte").over(w)).where(F.col("_reach").isNull() | (F.col("end_byte") > F.col("_reach"))).drop("_reach")


def gaps(roots_: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start_byte, end_byte of what lies between the roots, before the first and after the last. sizes: keys, size."""
    w = Window.partitionBy(*keys).orderBy("start_byte").rowsBetween(Window.unboundedPreceding, -1)
    between = roots_.select(*keys, F.coalesce(F.max("end_byte").over(w), F.lit(0)).alias("a"), F.col("start_byte").alias("b"))
    last = sizes.join(roots_.groupBy(*keys).agg(F.max("end_byte").alias("e")), keys, "left").select(*keys, F.coalesce("e", F.lit(0)).alias("a"), F.col("size").alias("b"))
    return between.unionByName(last).where("a < b").select(*keys, F.col("a").alias("start_byte"), F.col("b").alias("end_byte"))


def _estimate(text: str) -> int:
    return max(1, len(text) // 4)


def _decode(b: bytes) -> str:
    return b.decode("utf-8", "replace")


def _by_lines(source: bytes, a: int, b: int, limit: int) -> list[tuple[int, int]]:
    """Spans of whole lines of at most limit bytes; a longer line is a span of its own."""
    out, start, at = [], a, a
    while at < b:
        end = source.find(b"\n", at, b)
        end = b if end < 0 else end + 1
        if end - start > limit and at > start:
            out.append((start, at))
            start = at
        at = end
    if start < b:
        out.append((start, b))
    return out


class _Lengths:
    """Code points of spans of a source by prefix sums, so that no span is decoded again and again; bytes that do not decode count as they are shown."""

    def __init__(self, source: bytes):
        self.source = source
        self.sums = None
        if not source.isascii():
            try:
                source.decode("utf-8")
            except UnicodeDecodeError:
                return
            starts = (np.frombuffer(source, np.uint8) & 0xC0) != 0x80
            self.sums = np.concatenate([[0], np.cumsum(starts)])
        self.plain = self.sums is None

    plain = None

    def tokens(self, a: int, b: int) -> int:
        """The estimate of the tokens of source[a:b]."""
        if self.plain is None:
            return _estimate(_decode(self.source[a:b]))
        return max(1, (b - a if self.plain else int(self.sums[b] - self.sums[a])) // 4)


def _split(sizes: _Lengths, symbol: dict, children: list[dict], limit: int) -> list[dict]:
    """An oversized symbol at the ends of its members, which keep what is before them; small neighbours are joined, larger ones cut at lines."""
    source = sizes.source
    cuts, at = [], symbol["start_byte"]
    for c in children:
        if c["end_byte"] > at:
            cuts.append((at, c["end_byte"], [c["name"]]))
            at = c["end_byte"]
    if at < symbol["end_byte"]:
        cuts.append((at, symbol["end_byte"], []))
    if not children:
        cuts = [(a, b, [symbol["name"]]) for a, b in _by_lines(source, symbol["start_byte"], symbol["end_byte"], 4 * limit)]
    pieces: list[tuple[int, int, list[str]]] = []
    for a, b, names in cuts:
        if pieces and sizes.tokens(pieces[-1][0], b) <= limit:
            pieces[-1] = (pieces[-1][0], b, pieces[-1][2] + names)
        elif sizes.tokens(a, b) > 2 * limit:
            pieces += [(x, y, names) for x, y in _by_lines(source, a, b, 4 * limit)]
        else:
            pieces.append((a, b, names))
    head = f"# {symbol['signature'] or symbol['name']} (continued)"
    return [{"a": a, "b": b, "names": names, "partial": True, "parent": symbol["name"], "header": head if i else None} for i, (a, b, names) in enumerate(pieces)]


def pack(source: bytes, symbols: list[dict], limit: int) -> list[tuple]:
    """The chunks of a file, in order; together they cover all but white space."""
    sizes = _Lengths(source)
    ordered = sorted(symbols, key=lambda s: (s["start_byte"], -s["end_byte"]))
    starts = [s["start_byte"] for s in ordered]
    tops, reach = [], -1
    for s in ordered:
        if s["end_byte"] > reach:
            tops.append(s)
            reach = s["end_byte"]
    units, at = [], 0
    gap = lambda a, b: [{"a": x, "b": y, "names": [], "partial": y - x < b - a, "parent": None, "header": None} for x, y in _by_lines(source, a, b, 4 * limit)] if source[a:b].strip() else []
    for s in tops:
        # Symbols in order of their start: those of this one are a run of them.
        own = [x for x in ordered[bisect_left(starts, s["start_byte"]) : bisect_left(starts, s["end_byte"])] if x["end_byte"] <= s["end_byte"]]
        a = max(at, s["start_byte"])
        units += gap(at, a)
        if sizes.tokens(a, s["end_byte"]) <= limit:
            units.append({"a": a, "b": s["end_byte"], "names": [x["name"] for x in own if x is s or s["kind"] != "function"], "partial": False, "parent": None, "header": None})
        else:
            inner = [x for x in own if x is not s and x["parent"] == s["name"]]
            units += _split(sizes, s | {"start_byte": a}, inner, limit)
        at = max(at, s["end_byte"])
    units += gap(at, len(source))
    packed: list[dict] = []
    open_ = False
    for u in units:
        if open_ and not u["partial"] and sizes.tokens(packed[-1]["a"], u["b"]) <= limit:
            packed[-1]["b"] = u["b"]
            packed[-1]["names"] = packed[-1]["names"] + u["names"]
        else:
            packed.append(dict(u))
        open_ = not u["partial"]
    out = []
    first, counted = 1, 0
    for u in packed:
        body = _decode(source[u["a"] : u["b"]])
        content = f"{u['header']}\n\n{body}" if u["header"] else body
        first += source.count(b"\n", counted, u["a"])
        counted = u["a"]
        out.append((first, first + source.count(b"\n", u["a"], max(u["a"], u["b"] - 1)), u["a"], u["b"], content, list(dict.fromkeys(u["names"])), u["parent"], u["partial"], u["header"], _estimate(content)))
    return out


def chunk(files: DataFrame, parsed: DataFrame, keys: list[str], limit: int = 1500) -> DataFrame:
    """keys, file_path, language, id and the columns of CHUNK. files: keys with file_path, source; parsed: keys with file_path, language, symbols."""
    names = [*keys, *(c for c in ("file_path",) if c not in keys)]
    joined = files.select(*names, F.col("source")).join(parsed.select(*names, "language", "symbols"), names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in CHUNK.split(", ")]
        for b in batches:
            for i, (source, symbols) in enumerate(zip(b["source"], b["symbols"])):
                rows = pack(source or b"", list(symbols), limit)
                if rows:
                    out = pd.DataFrame(rows, columns=columns)
                    for c in (*names, "language"):
                        out[c] = b[c].iloc[i]
                    yield out[[*names, "language", *columns]]

    types = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in names)
    rows = spread(joined).mapInPandas(run, f"{types}, language string, {CHUNK}")
    return rows.withColumn("id", F.concat("file_path", F.lit(":"), "start_line", F.lit("-"), "end_line"))


def partial_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where("is_partial")


def pack_lines(lines: DataFrame, keys: list[str], size: str, limit: int, order: str) -> DataFrame:
    """keys, packs: into how many packs of at most limit the lines of a group go greedily, as one fold over their ordered sizes."""
    sizes = F.transform(F.array_sort(F.collect_list(F.struct(order, size))), lambda x: x[size].cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("used"))
    fold = lambda acc, x: F.when((acc["n"] > 0) & (acc["used"] + x <= limit), F.struct(acc["n"].alias("n"), (acc["used"] + x).alias("used"))).otherwise(F.struct((acc["n"] + 1).alias("n"), x.alias("used")))
    return lines.groupBy(*keys).agg(F.aggregate(sizes, start, fold, lambda a: a["n"]).alias("packs"))
