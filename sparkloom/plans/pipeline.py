"""The commands: scan a tree, document it, search it, ask about it, update it, export it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.text import action, content_hash, go_module, truncate
from sparkloom.operators import changes, chunks, documentation, graph, imports, providers, review, vectors, writing
from sparkloom.session import cut_lineage
from sparkloom.sources import export as exporting
from sparkloom.sources.parsers import imports as import_rows
from sparkloom.sources.parsers import parse
from sparkloom.sources.parsers import symbols as symbol_rows
from sparkloom.sources.scan import scan as scan_tree


@dataclass
class Scan:
    files: DataFrame
    counts: DataFrame
    parsed: DataFrame
    symbols: DataFrame
    edges: DataFrame
    chunks: DataFrame
    nodes: DataFrame
    links: DataFrame
    errors: list[str] = field(default_factory=list)
    changes: DataFrame | None = None


@dataclass
class Documented:
    scan: Scan
    chunk_docs: DataFrame
    file_docs: DataFrame
    vectors: DataFrame
    documents: dict[str, str]
    reviews: DataFrame
    root: str = ""
    summary: str | None = None


def structure(files: DataFrame, keys: list[str], limit: int = 1500, errors: list[str] | None = None, counts: DataFrame | None = None) -> Scan:
    """Symbols, import edges, chunks and the graph of files (keys, file_path, language, source)."""
    parsed = cut_lineage(parse(files, keys))
    names = [*keys, "file_path"]
    syms, imps = symbol_rows(parsed, names), import_rows(parsed, names)
    modules = files.where(F.col("file_path") == "go.mod").select(*keys, go_module(F.decode("source", "UTF-8")).alias("go_module")) if keys else None
    if not keys:
        found = files.where(F.col("file_path") == "go.mod").select(go_module(F.decode("source", "UTF-8"))).first()
        own = imps.withColumn("_k", F.lit(1))
        modules = files.sparkSession.createDataFrame([(1, found[0] if found else None)], "_k int, go_module string")
        edges = imports.resolve(own, files.withColumn("_k", F.lit(1)), ["_k"], modules).drop("_k")
    else:
        edges = imports.resolve(imps, files, keys, modules)
    edges = cut_lineage(edges)
    cut = chunks.chunk(files, parsed, names, limit)
    known = parsed.select(*names, "language")
    return Scan(files, counts, parsed, syms, edges, cut, graph.knowledge_nodes(known, syms, None, keys), graph.knowledge_edges(known, syms, edges, keys), errors or [])


def scan(spark: SparkSession, root: str, memo: changes.Memo | None = None, extra_ignore: list[str] | None = None) -> Scan:
    """The structure of a source tree, with the changes since the last run if a memo is given."""
    files, counts, errors = scan_tree(spark, root, extra_ignore)
    own = cut_lineage(files.select("ord", F.col("relative_path").alias("file_path"), "language", F.col("content").alias("source"), "size_bytes", "content_hash"))
    out = structure(own, [], errors=errors, counts=counts)
    if memo is not None:
        now = own.select(F.col("file_path").alias("relative_path"), "content_hash")
        out.changes = cut_lineage(changes.diff(now, memo.hashes(root)))
        memo.save(root, "file_hash", now)
    return out


def document(spark: SparkSession, root: str, provider=None, memo: changes.Memo | None = None) -> Documented:
    """Summaries, vectors, documents and reviews of a source tree. With a memo, chunks of files that did not change keep their summaries."""
    provider = provider or providers.Offline()
    s = scan(spark, root, memo)
    prompts = s.chunks.withColumn("prompt", writing.rendered(writing.PROMPTS["chunk"], {"language": F.col("language"), "code": truncate(F.col("content"), 8000)})).withColumn("content_hash", content_hash(F.col("content"))).withColumn("relative_path", F.col("id")).withColumn("repository_path", F.lit(root)).withColumn("record_type", F.lit("chunk_doc"))
    columns = ["id", "file_path", "symbol_names", "prompt", "content_hash"]
    if memo is not None:
        hits, misses = changes.split_by_memo(prompts, memo.read().where("record_type = 'chunk_doc'"), changes.KEY)
        fresh = providers.generate(misses.select(*columns), "prompt", provider)
        old = hits.select(*columns, F.col("payload").alias("summary"), F.lit(provider.model).alias("model"), F.lit(None).cast("string").alias("error"))
        done = cut_lineage(fresh.unionByName(old))
        memo.save(root, "chunk_doc", done.where("error IS NULL").select(F.col("id").alias("relative_path"), "content_hash", F.col("summary").alias("payload")))
    else:
        done = cut_lineage(providers.generate(prompts.select(*columns), "prompt", provider))
    chunk_docs = done.select(F.col("id").alias("chunk_id"), "file_path", "summary", "model", "symbol_names", "error")
    parts = documentation.file_parts(chunk_docs, s.chunks, [])
    asked = parts.withColumn("prompt", writing.rendered(writing.PROMPTS["file"], {"parts": truncate(F.array_join("summaries", "\n"), 8000)}))
    told = providers.generate(asked.select("file_path", "chunk_count", "failed", "prompt"), "prompt", provider, 650)
    nothing = F.when(F.col("failed") == F.col("chunk_count"), F.lit("every chunk in this file failed"))
    file_docs = cut_lineage(told.join(s.parsed.select("file_path", "language"), "file_path").withColumn("error", F.coalesce(nothing, "error")))
    items = vectors.embeddable(chunk_docs, file_docs)
    embedded = cut_lineage(providers.embed(items, "text", provider))
    documents, summary = _documents(spark, root, s, file_docs, provider)
    table = spark.createDataFrame(list(documents.items()), "name string, text string")
    found = review.findings(table, s.files.select("file_path"))
    passed, issues = review.review_of(F.coalesce("summary", F.lit("")))
    told = providers.generate(table.withColumn("prompt", writing.rendered(writing.PROMPTS["review"], {"document": F.col("text")})), "prompt", provider, 1000)
    own = cut_lineage(told.select("name", passed.alias("passed"), F.when(passed, F.array().cast("array<string>")).otherwise(issues).alias("issues"), "error"))
    return Documented(s, chunk_docs, file_docs, embedded, documents, review.merge_reviews(own, found), root, summary)


def _told(spark: SparkSession, provider, prompt: str, values: dict[str, str], most: int) -> str:
    """The answer to one prompt about the whole repository, empty if the call fails."""
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(writing.rendered(writing.PROMPTS[prompt], {k: F.col(k) for k in values}).alias("prompt"))
    return providers.generate(row, "prompt", provider, most).first()["summary"] or ""


def _documents(spark: SparkSession, root: str, s: Scan, file_docs: DataFrame, provider) -> tuple[dict[str, str], str]:
    """(the documents of one repository, a handful of texts; what it is for)."""
    text = lambda df, c="text": (lambda r: (r[c] if r else None) or "")(df.first())
    digest = documentation.repository_digest(file_docs, s.edges, []).first()
    arch = documentation.architecture(file_docs, s.edges).first()
    languages = documentation.language_breakdown(s.files, []).first()
    name = root.rstrip("/").rsplit("/", 1)[-1]
    files, links = (digest["file_digest"], digest["imports"]) if digest else ("", "")
    summary = _told(spark, provider, "repository", {"files": files, "imports": links}, 600) if files else ""
    facts = f"{name}: {languages['files'] if languages else 0} files ({languages['breakdown'] if languages else ''}).\n{summary}\n{files}"
    draft = writing.written(spark.createDataFrame([("README", facts)], "name string, facts string"), s.files.select("file_path"), provider).first()
    said = f"{draft['text']}\n\n" if draft and not draft["error"] and draft["text"] else ""
    endpoints = text(documentation.endpoint_digest(s.symbols, []), "digest")
    structure_ = _told(spark, provider, "architecture", {"files": arch["file_digest"] or "", "diagram": arch["diagram"]}, 500) if arch["file_digest"] else ""
    out = {
        "README": f"# {name}\n\n## Overview\n\n{languages['files'] if languages else 0} files ({languages['breakdown'] if languages else ''}).\n\n{said}## Files\n\n{files}\n",
        "ARCHITECTURE": f"# Architecture\n\n{structure_}\n\n{arch['file_digest'] or ''}\n\n```mermaid\n{arch['diagram']}\n```\n",
        "API": "# API\n\n" + (f"{_told(spark, provider, 'api', {'endpoints': endpoints}, 800)}\n\n{endpoints}" if endpoints else "No endpoints.") + "\n",
        "STRUCTURE": text(documentation.structure_document(file_docs, [])),
        "DEPENDENCIES": text(documentation.dependencies_document(documentation.manifests(s.files, []), [])),
    }
    history = documentation.commits(spark, root)
    if history is not None:
        out["CHANGELOG"] = text(documentation.changelog_document(history))
    own = documentation.licenses(s.files, []).first()
    head = spark.range(1).select(documentation.readme_header(F.lit(name), F.lit(own["license"] if own else None).cast("string"), F.lit(languages["primary"] if languages else None).cast("string"), F.lit(languages["files"] if languages else 0)).alias("t"))
    body = spark.createDataFrame([(out["README"].split("\n", 1)[1],)], "t string").select(writing.marked_headings(F.col("t")).alias("t"))
    out["GITHUB_README"] = text(head, "t") + "\n" + text(body, "t")
    return {k: v for k, v in out.items() if v.strip()}, summary


def export(result: Documented, formats: list[str], folder: str) -> list[str]:
    """The files written. Documents come in their order, with tables of contents."""
    spark = result.file_docs.sparkSession
    table = spark.createDataFrame(list(result.documents.items()), "name string, text string")
    ordered = {r["name"]: r["text"] for r in documentation.export_set(table).orderBy("place", "name").collect()}  # at most eight documents
    reviews = [r.asDict() for r in result.reviews.collect()]
    counted = result.scan.counts.agg(F.sum("count")).first()[0] if result.scan.counts is not None else None
    vectors_ = result.vectors.where("error IS NULL").count()
    statistics = {"files_total": counted, "files_changed": changes.changed(result.scan.changes).count() if result.scan.changes is not None else None, "chunks_documented": result.chunk_docs.where("error IS NULL").count(), "embeddings_generated": vectors_, "vectors_persisted": None, "tokens_used": None}
    more = exporting.structured(result.root, result.summary, ordered, reviews, statistics)
    return exporting.export(ordered, formats, folder, **{k: v for k, v in more.items() if k != "generated_docs"})


# Tools of an agent: name -> (result, argument) -> text.
def _tool_search(r: Documented, arg: str, provider) -> str:
    rows = vectors.search(r.vectors, provider.embed([arg])[0], 8).collect()
    return "\n".join(f"- [{x['record_type']}] {x['file_path']}: {x['text'][:200]}" for x in rows) or "Nothing found."


def _tool_file(r: Documented, arg: str, provider) -> str:
    row = r.scan.files.where(F.col("file_path") == arg).select(truncate(F.decode("source", "UTF-8"), 6000).alias("t")).first()
    if row:
        return row["t"]
    told = r.file_docs.where((F.col("file_path") == arg) & (F.col("summary") != "")).select("summary").first()  # without the file, what was said of it
    return told["summary"] if told else f"No file {arg}."


def _tool_symbol(r: Documented, arg: str, provider) -> str:
    rows = graph.member_of(graph.find_symbols(r.scan.nodes, arg), r.scan.links).orderBy("id").collect()  # at most ten
    return "\n".join(f"- {x['id']} ({x['symbol_kind']}{', member of ' + x['parent'] if x['parent'] else ''}): {x['summary'] or ''}" for x in rows) or f"No symbol {arg}."


def _tool_dependencies(r: Documented, arg: str, provider) -> str:
    rows = graph.neighbours(r.scan.edges, arg).orderBy("direction", "file").collect()
    return "\n".join(f"- {x['direction']} {x['file']}" for x in rows) or f"No dependencies of {arg}."


TOOLS = {"search": _tool_search, "get_file": _tool_file, "get_symbol": _tool_symbol, "list_dependencies": _tool_dependencies}


def ask(result: Documented, question: str, provider=None, steps: int = 6) -> str:
    """An answer found by a model that may call tools, after so many steps forced."""
    provider = provider or providers.Offline()
    spark = result.file_docs.sparkSession
    said = f"Question: {question}\nTools: {', '.join(TOOLS)}. Reply ACTION: tool(argument) or FINAL ANSWER: text."
    for i in range(steps):
        reply = provider.generate(said, 800)
        got = spark.createDataFrame([(reply,)], "t string").select(action(F.col("t")).alias("a")).first()["a"]
        if got["kind"] == "final":
            return got["argument"]
        tool = TOOLS.get(got["name"])
        said += f"\nStep {i + 1}: {got['name']}({got['argument']})\nResult: {tool(result, got['argument'], provider) if tool else 'unknown tool ' + got['name']}"
    return provider.generate(said + "\nAnswer now.", 800)
