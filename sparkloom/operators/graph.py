"""The file and symbol graph: degrees, neighbours, knowledge graph and diagram."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def degrees(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, file, dependents (edges that have the file as a target), dependencies (targets, repeats counted) and degree.

    One pass: each edge gives its own count and one row a target, so there is one shuffle and no join.
    """
    # Plain columns, so the sums stay in generated code; a null target stands for the edge itself.
    each = edges.select(*keys, "source", F.size("targets").alias("n"), F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("targets"))).alias("t"))
    own = F.col("t").isNull()
    rows = each.select(*keys, F.coalesce("t", "source").alias("file"), F.when(own, 0).otherwise(1).alias("i"), F.when(own, F.col("n")).otherwise(0).alias("o"))
    return rows.groupBy(*keys, "file").agg(F.sum("i").alias("dependents"), F.sum("o").alias("dependencies")).withColumn("degree", F.col("dependents") + F.col("dependencies"))


def top_files(files: DataFrame, scores: DataFrame, keys: list[str], score: str, n: int) -> DataFrame:
    """The n files of highest score of each group, ties by path. Files without a score have 0."""
    joined = files.join(scores.withColumnRenamed("file", "file_path"), [*keys, "file_path"], "left").withColumn(score, F.coalesce(score, F.lit(0)))
    if not keys:
        return joined.orderBy(F.desc(score), "file_path").limit(n)
    w = Window.partitionBy(*keys).orderBy(F.desc(score), "file_path")
    return joined.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def adjacency(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, source and its distinct targets, sorted."""
    return edges.where(F.size("targets") > 0).groupBy(*keys, "source").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("targets")))).alias("targets"))


def fan_out(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, source and the number of its distinct targets; no list of them is built."""
    return edges.select(*keys, "source", F.explode("targets").alias("t")).groupBy(*keys, "source").agg(F.countDistinct("t").alias("targets"))


def file_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, source, target: each pair once."""
    return edges.select(*keys, "source", F.explode("targets").alias("target")).distinct()


def within(edges: DataFrame, chosen: DataFrame, keys: list[str], name: str = "file_path") -> DataFrame:
    """The pairs both ends of which are chosen."""
    ids = chosen.select(*keys, F.col(name).alias("_f")).distinct()
    return edges.join(ids.withColumnRenamed("_f", "source"), [*keys, "source"], "left_semi").join(ids.withColumnRenamed("_f", "target"), [*keys, "target"], "left_semi")


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """(file, direction) of the files one step from a node."""
    pairs = edges.select("source", F.explode("targets").alias("target"))
    out = pairs.where(F.col("source") == node).select(F.col("target").alias("file"), F.lit("depends on").alias("direction"))
    return out.unionByName(pairs.where(F.col("target") == node).select(F.col("source").alias("file"), F.lit("used by").alias("direction"))).distinct()


def symbol_id(path, parent, name):
    return F.concat(path, F.lit("::"), F.when(parent.isNull(), name).otherwise(F.concat(parent, F.lit("."), name)))


def knowledge_nodes(files: DataFrame, symbols: DataFrame, summaries: DataFrame | None, keys: list[str]) -> DataFrame:
    """keys, id, node_type, label, file_path, language, symbol_kind, summary: the files, with the summaries that have no error, and their symbols."""
    base = files.select(*keys, "file_path", "language")
    if summaries is not None:
        good = summaries.where(F.col("error").isNull()).select(*keys, "file_path", "summary").dropDuplicates([*keys, "file_path"])
        base = base.join(good, [*keys, "file_path"], "left")
    else:
        base = base.withColumn("summary", F.lit(None).cast("string"))
    none = F.lit(None).cast("string")
    f = base.select(*keys, F.col("file_path").alias("id"), F.lit("file").alias("node_type"), F.regexp_extract("file_path", "([^/]*)$", 1).alias("label"), "file_path", "language", none.alias("symbol_kind"), "summary")
    s = symbols.select(*keys, symbol_id(F.col("file_path"), F.col("parent"), F.col("name")).alias("id"), F.lit("symbol").alias("node_type"), F.col("name").alias("label"), "file_path", "language", F.col("kind").alias("symbol_kind"), F.col("docstring").alias("summary"))
    return f.unionByName(s)


def knowledge_edges(files: DataFrame, symbols: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, source, target, edge_type: defines and member_of of the symbols; imports between files that are both there."""
    own = symbol_id(F.col("file_path"), F.col("parent"), F.col("name"))
    top = F.col("parent").isNull()
    s = symbols.select(*keys, F.when(top, F.col("file_path")).otherwise(own).alias("source"), F.when(top, own).otherwise(F.concat("file_path", F.lit("::"), "parent")).alias("target"), F.when(top, "defines").otherwise("member_of").alias("edge_type"))
    i = within(edges.select(*keys, "source", F.explode("targets").alias("target")), files, keys).select(*keys, "source", "target", F.lit("imports").alias("edge_type"))
    return s.unionByName(i)


def find_symbols(nodes: DataFrame, name: str, most: int = 10) -> DataFrame:
    """Symbols of this name, or, without any, those whose name contains it, at most so many."""
    s = nodes.where("node_type = 'symbol'").where(F.lower("label").contains(name.lower())).withColumn("_near", F.when(F.col("label") == name, 0).otherwise(1))
    # The count of exact hits is one row.
    best = s.agg(F.min("_near").alias("_best"))
    return s.join(F.broadcast(best), F.col("_near") == F.col("_best")).drop("_near", "_best").orderBy("id").limit(most)


def member_of(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """The symbols (id, ...) with the one they are a member of (parent); null for those at the top."""
    up = edges.where("edge_type = 'member_of'").select(F.col("source").alias("id"), F.col("target").alias("parent")).dropDuplicates(["id"])
    return symbols.join(up, "id", "left")


def mermaid(chosen: DataFrame, pairs: DataFrame) -> DataFrame:
    """(diagram): a flow chart of at most a few dozen chosen files (file_path) and the pairs among them, nodes named by their place."""
    nodes = chosen.select("file_path").distinct().withColumn("i", F.row_number().over(Window.orderBy("file_path")) - 1)
    quoted = F.regexp_replace("file_path", '"', "'")
    lines = nodes.select(F.lit(1).alias("k"), F.col("i").alias("a"), F.lit(0).alias("b"), F.format_string('    n%d["%s"]', "i", quoted).alias("line"))
    a, b = nodes.select(F.col("file_path").alias("source"), F.col("i").alias("a")), nodes.select(F.col("file_path").alias("target"), F.col("i").alias("b"))
    links = pairs.select("source", "target").distinct().join(a, "source").join(b, "target").select(F.lit(2).alias("k"), "a", "b", F.format_string("    n%d --> n%d", "a", "b").alias("line"))
    return lines.unionByName(links).agg(F.concat_ws("\n", F.lit("flowchart TD"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "a", "b", "line"))), lambda x: x["line"]), "\n")).alias("diagram"))
