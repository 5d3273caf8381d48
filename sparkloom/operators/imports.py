"""Resolving imports to files.

Every import is turned into its candidates with a priority; one equi-join against the files of its repository finds those
that exist, and the first priority with a hit wins. An import without a hit stays, with no targets: it is external.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.paths import dirname

# Endings tried for JavaScript and TypeScript, and for Rust.
JS_ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
RUST_ENDINGS = [".rs", "/mod.rs"]


def normalised(path):
    """A path without . and .. steps; steps above the root are dropped."""
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda acc, x: F.when((x == ".") | (x == ""), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x))), "/")


def python_module(path):
    """The dotted module that a Python file is; null for other files."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.pyi?$", ""), r"(?:^|/)__init__$", "")
    return F.when(path.rlike(r"\.pyi?$"), F.regexp_replace(bare, "/", "."))




def candidates(imports: DataFrame, keys: list[str]) -> DataFrame:
    """keys, file_path, ord and (prio, want, kind): what an import may mean, best first."""
    lang = F.col("language")
    module, names, here = F.col("module"), F.col("imported_names"), dirname(F.col("file_path"))
    cand = lambda prio, want, kind: F.struct(prio.cast("int").alias("prio"), want.alias("want"), F.lit(kind).alias("kind"))
    # Python: each imported name as a module of the package, then the package; relative ones from the file's directory.
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.regexp_replace(module, r"^\.+", "")
    parts = F.filter(F.split(here, "/"), lambda x: x != "")
    base = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - (dots - 1), F.lit(0))), ".")
    absolute = F.concat(F.transform(names, lambda n: cand(F.lit(0), F.concat_ws(".", module, n), "module")), F.array(cand(F.lit(1), module, "module")))
    joined = F.array_join(F.filter(F.array(base, rest), lambda x: x != ""), ".")
    relative = F.when(rest == "", F.transform(names, lambda n: cand(F.lit(0), F.array_join(F.filter(F.array(base, n), lambda x: x != ""), "."), "module"))).otherwise(F.array(cand(F.lit(0), joined, "module")))
    # JavaScript and TypeScript: the path with each ending, then as a directory with an index.
    target = normalised(F.concat_ws("/", here, module))
    js = F.when(module.startswith("."), F.array(*(cand(F.lit(i), F.concat(target, F.lit(e)), "path") for i, e in enumerate(JS_ENDINGS)), *(cand(F.lit(len(JS_ENDINGS) + i), F.concat(target, F.lit("/index" + e)), "path") for i, e in enumerate(JS_ENDINGS[1:]))))
    # Go: the directory of the package below the module of go.mod.
    prefix = F.coalesce(F.col("go_module"), F.lit("\0"))
    go = F.when((module == prefix) | module.startswith(F.concat(prefix, F.lit("/"))), F.array(cand(F.lit(0), F.regexp_replace(F.expr("substring(module, length(go_module) + 1)"), "^/+", ""), "dir")))
    # Rust: crate from its root, self and super from the directory, each path with two endings.
    steps = F.split(module, "::")
    tail = F.array_join(F.slice(steps, F.lit(2), F.greatest(F.size(steps) - 1, F.lit(0))), "/")
    head = F.element_at(steps, 1)
    start = F.when(head == "crate", "src").when(head.isin("self", "super"), here)
    each = lambda p, prio: [cand(F.lit(prio + i), F.concat(p, F.lit(e)), "path") for i, e in enumerate(RUST_ENDINGS)]
    shorter = F.array_join(F.slice(F.split(tail, "/"), F.lit(1), F.greatest(F.size(F.split(tail, "/")) - 1, F.lit(0))), "/")
    inside = F.concat_ws("/", start, tail)
    crate = F.when(head.isin("crate", "self", "super"), F.when(tail == "", F.array(*(cand(F.lit(i), F.lit(p), "path") for i, p in enumerate(("src/lib.rs", "src/main.rs"))))).otherwise(F.array(*each(inside, 0), *each(F.concat_ws("/", start, F.nullif(shorter, F.lit(""))), 2))))
    none = F.array().cast("array<struct<prio:int,want:string,kind:string>>")
    all_ = F.when(lang == "python", F.when(dots > 0, relative).otherwise(absolute)).when(lang.isin("javascript", "jsx", "typescript", "tsx"), js).when(lang == "go", go).when(lang == "rust", crate)
    return imports.withColumn("_c", F.coalesce(all_, none))


def resolve(imports: DataFrame, files: DataFrame, keys: list[str], go_modules: DataFrame | None = None) -> DataFrame:
    """keys, source, ord, module, imported_names, is_relative, targets of each import; targets are in the order of the files.

    imports: keys, file_path, language, ord, module, imported_names, is_relative; files: keys, file_path; go_modules: keys, go_module.
    Imports of languages without rules have no row.
    """
    from sparkloom.sources.parsers import EXTRACTORS

    own = imports.where(F.col("language").isin(*EXTRACTORS))
    own = own.join(go_modules, keys, "left") if go_modules is not None else own.withColumn("go_module", F.lit(None).cast("string"))
    wanted = candidates(own, keys).select(*keys, "file_path", "ord", "module", "imported_names", "is_relative", F.explode_outer("_c").alias("c")).select(*keys, "file_path", "ord", "module", "imported_names", "is_relative", "c.*")
    there = files.select(*keys, F.col("file_path").alias("target"))
    index = there.select(*keys, "target", F.explode(F.array(F.struct(F.lit("path").alias("kind"), F.col("target").alias("want")), F.struct(F.lit("module").alias("kind"), python_module(F.col("target")).alias("want")), F.struct(F.lit("dir").alias("kind"), F.when(F.col("target").endswith(".go"), dirname(F.col("target"))).alias("want")))).alias("i")).select(*keys, "target", "i.*").where("want IS NOT NULL")
    hits = wanted.join(index, [*keys, "kind", "want"], "left")
    per = hits.groupBy(*keys, "file_path", "ord").agg(F.first("module").alias("module"), F.first("imported_names").alias("imported_names"), F.first("is_relative").alias("is_relative"), F.array_sort(F.collect_set(F.when(F.col("target").isNotNull(), F.struct("prio", "target")))).alias("h"))
    best = F.filter("h", lambda x: x["prio"] == F.get(F.col("h"), F.lit(0))["prio"])
    return per.select(*keys, F.col("file_path").alias("source"), "ord", "module", "imported_names", "is_relative", F.array_distinct(F.transform(best, lambda x: x["target"])).alias("targets"))


def internal(edges: DataFrame) -> DataFrame:
    return edges.where(F.size("targets") > 0)


def external(edges: DataFrame) -> DataFrame:
    return edges.where(F.size("targets") == 0)
