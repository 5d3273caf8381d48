"""Cutting oversized texts into pieces at natural boundaries.

A text is seen as ranges of characters, each with a halo before it and after it. A worker that holds one range finds the
cut at its end and the start of the overlap; the boundary tables of the ranges are stitched by a window over the range number, lines are
numbered by prefix sums of the ranges' line counts, and each piece is emitted by offset from its own range. Ranges are made
by slicing in one linear pass, or, for files on shared storage, by seeking; no later step holds a whole text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.session import cut_lineage, parallelism

#: Characters after a cut that are looked at, so that a boundary at the very end of a range is seen whole.
AHEAD = 120
#: A line that begins a declaration in one of the languages at hand.
DECLARATION = r"[ \t]*(?:@\w|#\[|(?:export |default |pub(?:\([a-z]+\))? |async |abstract |static |public |private |unsafe )*(?:def|class|func|fn|function|impl|struct|enum|trait|interface|type|mod|const fn)\b)"
_NAME = r"(?m)^[ \t]*(?:(?:export|default|pub(?:\([a-z]+\))?|async|abstract|static|public|private|unsafe|const) +)*(?:def|class|func|fn|function\*?|impl(?:<[^>\n]*>)?|struct|enum|trait|interface|type|mod) +(?:\([^)\n]*\) *)?([A-Za-z_$][\w$]*)"


def _geometry(limit: int, overlap: int) -> tuple[int, int]:
    """(stride, depth): cuts lie at most depth before multiples of about the stride, so a piece has at most limit characters."""
    depth = max(1, (limit - overlap) * 2 // 7)
    return max(1, limit - overlap - depth), depth


def ranges(texts: DataFrame, key: str, text: str, limit: int, overlap: int) -> DataFrame:
    """(key, _k, _last, _from, _to, _base, _part): the ranges of each text longer than limit; _part begins at offset _base."""
    stride, depth = _geometry(limit, overlap)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["_key"], b["_text"]):
                n = len(content)
                many = -(-n // stride)
                rows = []
                for k in range(many):
                    lo, hi = k * n // many, (k + 1) * n // many
                    base = max(0, lo - depth - overlap)
                    rows.append((name, k, k == many - 1, lo, hi, base, content[base : hi + AHEAD]))
                    if len(rows) == 256 or k == many - 1:
                        yield pd.DataFrame(rows, columns=["_key", "_k", "_last", "_from", "_to", "_base", "_part"])
                        rows = []

    long = texts.where(F.length(text) > limit).select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kind = long.schema["_key"].dataType.simpleString()
    return long.mapInPandas(cut, f"_key {kind}, _k int, _last boolean, _from long, _to long, _base long, _part string")


def file_ranges(spark: SparkSession, files: list[str] | DataFrame, limit: int, overlap: int) -> DataFrame:
    """The ranges of files on storage that all executors see, as ranges() makes them; workers seek to their range, so no file is loaded whole.

    files: paths, or a table with a column path. Sizes are asked for by the workers. Offsets are bytes: a part holds one character (of ISO-8859-1) for each byte. Files within the limit have no ranges.
    """
    stride, depth = _geometry(limit, overlap)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = pd.Series([os.path.getsize(f) for f in b["_key"]], dtype="int64")
            yield pd.DataFrame({"_key": b["_key"], "_n": n, "_many": (n + stride - 1) // stride})

    paths = files.select(F.col("path").alias("_key")) if isinstance(files, DataFrame) else spark.createDataFrame([(f,) for f in files], "_key string")
    sized = paths.distinct().mapInPandas(measure, "_key string, _n long, _many int").where(F.col("_n") > limit)
    places = sized.select("_key", "_n", "_many", F.explode(F.sequence(F.lit(0), F.col("_many") - 1)).alias("_k")).repartition(4 * parallelism(spark))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lo_ in range(0, len(b), 256):
                rows = []
                for name, n, many, k in b.iloc[lo_ : lo_ + 256].itertuples(index=False):
                    lo, hi = k * n // many, (k + 1) * n // many
                    base = max(0, lo - depth - overlap)
                    with open(name, "rb") as f:
                        f.seek(base)
                        rows.append((name, k, k == many - 1, lo, hi, base, f.read(hi + AHEAD - base).decode("latin-1")))
                yield pd.DataFrame(rows, columns=["_key", "_k", "_last", "_from", "_to", "_base", "_part"])

    return places.mapInPandas(read, "_key string, _k int, _last boolean, _from long, _to long, _base long, _part string")


def split_files(spark: SparkSession, files: list[str] | DataFrame, limit: int = 6000, overlap: int = 400) -> DataFrame:
    """The pieces of files longer than limit bytes, as pieces() gives them: start and end are bytes, content is text in UTF-8.

    A cut lies inside a character only where no white space is in reach; its bytes are then shown as replacement characters.
    """
    cut = _pieces(file_ranges(spark, files, limit, overlap), "file_path", limit, overlap)
    text = F.decode(F.encode("content", "ISO-8859-1"), "UTF-8")
    return cut.withColumn("content", text).withColumn("symbol", F.decode(F.encode("symbol", "ISO-8859-1"), "UTF-8"))


def _latest(part: Column, pattern: str) -> Column:
    """Offset in part just after the last match of pattern, 0 if there is none."""
    return F.length(F.regexp_extract(part, f"(?s)^(.*{pattern})", 1))


def pieces(texts: DataFrame, key: str, text: str, limit: int = 6000, overlap: int = 400) -> DataFrame:
    """(key, piece_no, n_pieces, start, end, lines_before, lines_in, content, symbol) of each text longer than limit.

    A piece is content = text[start:end] of at most ``limit`` characters; consecutive pieces share 1 to ``overlap``
    characters and together they cover the text. The cut is at the latest declaration in reach, else blank line, else line end, else
    word end, else anywhere. lines_before counts the line ends before start. symbol is the last name declared before the
    piece, else the first declared in it, else null. Null texts and those within the limit give no rows; a table without rows
    gives none. A key that repeats must carry the same text and then counts once.
    """
    return _pieces(ranges(texts, key, text, limit, overlap).dropDuplicates(["_key", "_k"]), key, limit, overlap)


def _joined(r: DataFrame, table: DataFrame) -> DataFrame:
    """The ranges with the other columns of a table of the same (_key, _k); null keys are equal."""
    table = table.withColumnsRenamed({"_key": "_key2", "_k": "_k2"})
    return r.join(table, F.col("_key").eqNullSafe(F.col("_key2")) & (F.col("_k") == F.col("_k2"))).drop("_key2", "_k2")


def _pieces(r: DataFrame, key: str, limit: int, overlap: int) -> DataFrame:
    """The pieces of texts given as ranges: boundary tables stitched, lines counted by prefix sums, pieces cut by offset."""
    _, depth = _geometry(limit, overlap)
    to, lo = (F.col("_to") - F.col("_base")).cast("int"), (F.col("_from") - F.col("_base")).cast("int")
    reach = F.substring(F.col("_part"), 1, 0)  # placeholder of the right type for the last range
    window = F.when(F.col("_last"), reach).otherwise(F.substring("_part", to - depth + 1, F.lit(depth)))
    seen = F.concat(window, F.when(F.col("_last"), reach).otherwise(F.substring("_part", to + 1, F.lit(AHEAD))))
    # Boundaries: a line end before a declaration, a blank line, a line end, the end of a word.
    symbol = F.length(F.regexp_extract("_seen", rf"(?s)^(.{{0,{depth - 1}}}\n)(?={DECLARATION})", 1))
    blank, line, word = (_latest(F.col("_window"), p) for p in (r"\n[ \t\r]*\n", r"\n", r"\s"))
    depth_ = F.length("_window")
    found = F.coalesce(*(F.when(x > 0, x) for x in (symbol, blank, line, word)), depth_)
    r = r.withColumn("_window", window).withColumn("_seen", seen)
    r = r.withColumn("_cut", F.when(F.col("_last"), F.col("_to")).otherwise(F.col("_to") - depth_ + found))
    tail = F.substring("_part", (F.col("_cut") - F.col("_base")).cast("int") - overlap + 1, F.lit(overlap))
    r = r.withColumn("_tail", F.when(F.col("_last"), reach).otherwise(tail))
    # The next piece begins at the first line, else word, that begins in the overlap; else in its middle.
    first = F.length(F.regexp_extract("_tail", r"(?s)^([^\n]*\n)(?=.)", 1))
    space = F.length(F.regexp_extract("_tail", r"(?s)^(\S*\s+)(?=\S)", 1))
    shared = F.coalesce(F.when(first > 0, first), F.when(space > 0, space), F.lit(overlap // 2))
    r = r.withColumn("_next", F.col("_cut") - F.length("_tail") + shared)
    own = F.substring("_part", lo + 1, (F.col("_to") - F.col("_from")).cast("int"))
    r = r.withColumn("_lines", F.length(own) - F.length(F.regexp_replace(own, "\n", "")))
    # Ranges are spread by (key, number); only the boundary table, without texts, comes together by key.
    r = cut_lineage(r.select("_key", "_k", "_from", "_base", "_part", "_cut", "_next", "_lines"))
    by = Window.partitionBy("_key").orderBy("_k")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    starts = F.coalesce(F.lag("_next").over(by), F.lit(0).cast("long")).alias("_start")
    counted = F.coalesce(F.sum("_lines").over(before), F.lit(0).cast("long")).alias("_before")
    r = _joined(r, r.select("_key", "_k", starts, counted, F.count("*").over(Window.partitionBy("_key")).cast("int").alias("_many")))
    head = F.substring("_part", (F.col("_start") - F.col("_base")).cast("int") + 1, (F.col("_from") - F.col("_start")).cast("int"))
    r = r.withColumn("_back", F.length(head) - F.length(F.regexp_replace(head, "\n", "")))
    content = F.substring("_part", (F.col("_start") - F.col("_base")).cast("int") + 1, (F.col("_cut") - F.col("_start")).cast("int"))
    r = r.withColumn("content", content)
    known = F.regexp_extract_all(F.substring("_part", F.lit(1), (F.col("_start") - F.col("_base")).cast("int")), F.lit(_NAME), F.lit(1))
    r = r.withColumn("_known", F.when(F.size(known) > 0, F.element_at(known, -1))).withColumn("_names", F.regexp_extract_all("content", F.lit(_NAME), F.lit(1)))
    last_name = F.when(F.size("_names") > 0, F.element_at("_names", -1))
    last = r.select("_key", "_k", last_name.alias("_name"))
    r = _joined(r, last.select("_key", "_k", F.last("_name", ignorenulls=True).over(before).alias("_passed")))
    earlier = F.coalesce("_known", "_passed")
    symbol_ = F.coalesce(earlier, F.when(F.size("_names") > 0, F.element_at("_names", 1)))
    return r.select(
        F.col("_key").alias(key), F.col("_k").alias("piece_no"), F.col("_many").alias("n_pieces"), F.col("_start").alias("start"), F.col("_cut").alias("end"),
        (F.col("_before") - F.col("_back")).alias("lines_before"), (F.length("content") - F.length(F.regexp_replace("content", "\n", ""))).alias("lines_in"), "content", symbol_.alias("symbol"),
    )


def split_chunks(chunks: DataFrame, limit: int = 6000, overlap: int = 400) -> DataFrame:
    """The pieces of every chunk whose content is longer than limit, with the columns of a chunk.

    A chunk's rows are told apart by chunk_no; of several the one ingested last counts, null content never. start_line
    and end_line are lines of the file: a context header is the first line of content but no line of the file. Null start_line gives null lines. parent_symbol is the chunk's own, else the name declared last before the piece, else the first of symbol_names,
    else the stem of the file's name: data without declarations belongs to the file.
    """
    # The last version of each chunk is found by numbers alone; only the contents that are cut are moved.
    when = F.coalesce("ingested_at", F.lit("1900-01-01").cast("timestamp_ntz").cast(chunks.schema["ingested_at"].dataType))
    versions = chunks.where("content IS NOT NULL").groupBy("chunk_no").agg(F.max(F.struct(when.alias("t"), F.length("content").alias("n"), F.xxhash64("content").alias("h"))).alias("x"))
    last = versions.where(F.col("x.n") > limit).select(F.col("chunk_no").alias("_c"), F.col("x.n").alias("_n"), F.col("x.h").alias("_h"))
    long = chunks.where(F.length("content") > limit).join(last, F.col("chunk_no").eqNullSafe(F.col("_c")) & (F.length("content") == F.col("_n")) & (F.xxhash64("content") == F.col("_h")), "left_semi")
    picked = ["content", "start_line", "parent_symbol", "symbol_names", "context_header", "repo_id", "file_path", "language", "id"]
    one = long.groupBy("chunk_no").agg(F.max_by(F.struct(*picked), F.struct(when, "start_line", "parent_symbol")).alias("c")).select("chunk_no", "c.*")
    cut = pieces(one, "chunk_no", "content", limit, overlap)
    headed = F.when(F.col("context_header").isNotNull(), 1).otherwise(0)
    start = F.col("start_line") + F.greatest(F.col("lines_before") - headed, F.lit(0))
    lines = F.col("lines_in") - F.when(F.col("content").endswith("\n"), 1).otherwise(0)
    end = F.greatest(start, F.col("start_line") + F.col("lines_before") - headed + lines)
    stem = F.regexp_extract("file_path", r"([^/]*?)(?:\.[^./]*)?$", 1)
    parent = F.coalesce("parent_symbol", "symbol", F.get("symbol_names", F.lit(0)), stem)
    return cut.join(one.drop("content"), "chunk_no").select("chunk_no", "piece_no", "n_pieces", F.concat_ws("#", "id", "piece_no").alias("id"), "repo_id", "file_path", "language", start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), "start", "end", "content", F.lit(True).alias("is_partial"), parent.alias("parent_symbol"), F.greatest(F.lit(1), F.floor(F.length("content") / 4)).cast("int").alias("token_estimate"))
