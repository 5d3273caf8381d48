"""Queries over the Parquet tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import paths
from sparkloom.functions.text import BANNED, LICENSE_RULES, banned_phrases, content_hash, duration, first_sentence, github_repository, go_module, license_of_text, slug, token_estimate, word_count
from sparkloom.operators import changes, documentation, graph, imports, review, vectors
from sparkloom.operators import chunks as chunk_ops
from sparkloom.session import cut_lineage
from sparkloom.sources.parsers import imports as import_rows
from sparkloom.sources.parsers import parse
from sparkloom.sources.parsers import symbols as symbol_rows
from sparkloom.sources.tables import table
from sparkloom.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as the query of its name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


@query("""SELECT coalesce(lower(language), 'unknown') AS language, count(*) AS files, sum(octet_length(source)) AS bytes,
 count(DISTINCT repo_id) AS repositories FROM sources GROUP BY 1""")
def language_summary(spark, d):
    s = table(spark, d, "sources")
    return s.groupBy(F.coalesce(F.lower("language"), F.lit("unknown")).alias("language")).agg(F.count("*").alias("files"), F.sum(F.octet_length("source")).alias("bytes"), F.countDistinct("repo_id").alias("repositories"))


# ---------------------------------------------------------------- files
@query("SELECT DISTINCT repo_id, file_path, sha256(source) AS hash, octet_length(source) AS bytes FROM sources")
def content_hashes(spark, d):
    s = table(spark, d, "sources")
    return s.select("repo_id", "file_path", content_hash(F.col("source")).alias("hash"), F.octet_length("source").cast("bigint").alias("bytes")).distinct()


@query(r"""SELECT doc_id, greatest(1, length(text) // 4) AS tokens, len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '')) AS words FROM documents WHERE text IS NOT NULL""")
def token_estimates(spark, d):
    x = F.col("text")
    return table(spark, d, "documents").where(x.isNotNull()).select("doc_id", token_estimate(x).alias("tokens"), word_count(x).alias("words"))


_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in paths.EXTENSIONS.items())
_NAMED = ", ".join(f"('{k}', '{v}')" for k, v in paths.NAMES.items())


@query(f"""WITH f AS (SELECT DISTINCT repo_id, file_path, regexp_extract(file_path, '([^/]*)$', 1) AS b FROM sources), e(e, l) AS (VALUES {_VALUES}), n(n, l) AS (VALUES {_NAMED})
SELECT coalesce(n.l, e.l, 'unknown') AS language, count(*) AS files FROM f LEFT JOIN n ON f.b = n.n LEFT JOIN e ON lower(regexp_extract(f.b, '^.+\\.([^.]*)$', 1)) = e.e GROUP BY 1""")
def languages_by_path(spark, d):
    f = table(spark, d, "sources").select("repo_id", "file_path").distinct()
    return f.groupBy(F.coalesce(paths.language(F.col("file_path")), F.lit("unknown")).alias("language")).agg(F.count("*").alias("files"))


_SECRETS = [(paths.glob_regex(p.lstrip("!")) + "$", not p.startswith("!")) for p in paths.SECRET_PATTERNS]
_SECRET_SQL = " ".join(f"WHEN regexp_matches(file_path, '{r}') THEN {str(v).lower()}" for r, v in reversed(_SECRETS))
_DIRS = ", ".join(f"'{x}'" for x in paths.IGNORED_DIRS)
_BINARY = ", ".join(f"'{x}'" for x in paths.BINARY)


@query(f"""WITH f AS (SELECT DISTINCT repo_id, file_path, source, string_split(regexp_replace(file_path, '/?[^/]*$', ''), '/') AS dirs FROM sources)
SELECT CASE WHEN (CASE {_SECRET_SQL} ELSE false END) THEN 'secret' WHEN len(list_filter(dirs, lambda x: list_contains([{_DIRS}], x))) > 0 THEN 'ignored'
 WHEN lower(regexp_extract(regexp_extract(file_path, '([^/]*)$', 1), '^.+\\.([^.]*)$', 1)) IN ({_BINARY}) OR contains(substring(hex(source), 1, 2 * {paths.SNIFFED}), '00') AND regexp_matches(substring(hex(source), 1, 2 * {paths.SNIFFED}), '^(..)*00') THEN 'binary' ELSE 'kept' END AS disposition, count(*) AS files, sum(octet_length(source)) AS bytes FROM f GROUP BY 1""")
def dispositions(spark, d):
    """What a scan does with each file, secret before ignored before binary."""
    f = table(spark, d, "sources").select("repo_id", "file_path", "source").distinct()
    p = F.col("file_path")
    what = F.when(paths.is_secret(p), "secret").when(paths.in_ignored_dir(p), "ignored").when(paths.is_binary(p, F.col("source")), "binary").otherwise("kept")
    return f.groupBy(what.alias("disposition")).agg(F.count("*").alias("files"), F.sum(F.octet_length("source")).alias("bytes"))


@query("""WITH a AS (SELECT DISTINCT repo_id || ':' || file_path AS relative_path, sha256(source) AS h FROM sources), b AS (SELECT repo_id || ':' || file_path AS relative_path, max(content_hash) AS h FROM sources WHERE content_hash IS NOT NULL GROUP BY 1)
SELECT coalesce(a.relative_path, b.relative_path) AS relative_path, CASE WHEN b.relative_path IS NULL THEN 'added' WHEN a.relative_path IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'modified' END AS status FROM a FULL JOIN b USING (relative_path)""")
def change_set(spark, d):
    """The files as they are against the hashes that were recorded."""
    s = table(spark, d, "sources")
    key = F.concat(F.col("repo_id").cast("string"), F.lit(":"), "file_path").alias("relative_path")
    now = s.select(key, content_hash(F.col("source")).alias("content_hash")).distinct()
    then = s.where("content_hash IS NOT NULL").groupBy(key).agg(F.max("content_hash").alias("content_hash"))
    return changes.diff(now, then)


@query("""WITH w AS (SELECT DISTINCT repo_id, file_path, sha256(source) AS h FROM sources), m AS (SELECT repo_id, file_path, max(content_hash) AS h FROM sources WHERE content_hash IS NOT NULL GROUP BY ALL)
SELECT w.repo_id, count(*) FILTER (m.h = w.h) AS hits, count(*) FILTER (m.h IS NULL OR m.h <> w.h) AS misses FROM w LEFT JOIN m USING (repo_id, file_path) GROUP BY 1""")
def memo_hits(spark, d):
    s = table(spark, d, "sources")
    want = s.select("repo_id", "file_path", content_hash(F.col("source")).alias("content_hash")).distinct()
    memo = s.where("content_hash IS NOT NULL").groupBy("repo_id", "file_path").agg(F.max("content_hash").alias("content_hash")).withColumn("payload", F.lit("x"))
    hits, misses = changes.split_by_memo(want, memo, ["repo_id", "file_path"])
    both = hits.select("repo_id", F.lit(1).alias("h")).unionByName(misses.select("repo_id", F.lit(0).alias("h")))
    return both.groupBy("repo_id").agg(F.sum("h").alias("hits"), F.sum(1 - F.col("h")).alias("misses"))


@query("""SELECT repo_id, regexp_replace(file_path, '/?[^/]*$', '') AS directory, count(DISTINCT file_path) AS files, string_agg(DISTINCT file_path, '|' ORDER BY file_path) AS listing FROM sources GROUP BY 1, 2""")
def directory_listing(spark, d):
    x = documentation.directories(table(spark, d, "sources").select("repo_id", "file_path"), ["repo_id"])
    return x.select("repo_id", "directory", F.size("files").cast("bigint").alias("files"), F.array_join("files", "|").alias("listing"))


@query("""WITH f AS (SELECT DISTINCT repo_id, file_path, lower(language) AS language FROM sources), c AS (SELECT repo_id, coalesce(language, 'unknown') AS l, count(*) AS n FROM f GROUP BY 1, 2)
SELECT repo_id, sum(n) AS files, string_agg(l || ': ' || n, ', ' ORDER BY n DESC, l) AS breakdown, first(l ORDER BY n DESC, l) AS primary FROM c GROUP BY 1""".replace("AS primary", 'AS "primary"'))
def language_breakdown(spark, d):
    f = table(spark, d, "sources").select("repo_id", "file_path", F.lower("language").alias("language")).distinct()
    return documentation.language_breakdown(f, ["repo_id"])


# ---------------------------------------------------------------- chunks
_SPANS = "SELECT DISTINCT repo_id, file_path, chunk_no, start_byte, end_byte FROM chunks WHERE start_byte IS NOT NULL AND end_byte IS NOT NULL"


def _spans(spark, d):
    return table(spark, d, "chunks").where("start_byte IS NOT NULL AND end_byte IS NOT NULL").select("repo_id", "file_path", "chunk_no", "start_byte", "end_byte").distinct()


@query(f"""WITH s AS ({_SPANS}) SELECT repo_id, file_path, chunk_no AS ord, start_byte, end_byte FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE a.repo_id = b.repo_id AND a.file_path = b.file_path AND b.start_byte <= a.start_byte AND b.end_byte >= a.end_byte
 AND ((b.start_byte, b.end_byte) <> (a.start_byte, a.end_byte) OR b.chunk_no < a.chunk_no))""")
def span_roots(spark, d):
    """The spans that no other span of their file contains."""
    return chunk_ops.roots(_spans(spark, d).withColumnRenamed("chunk_no", "ord"), ["repo_id", "file_path"])


@query(f"""WITH s AS ({_SPANS}), g AS (SELECT repo_id, file_path, coalesce(max(end_byte) OVER (PARTITION BY repo_id, file_path ORDER BY start_byte, end_byte DESC, chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, start_byte AS b FROM s
 UNION ALL SELECT f.repo_id, f.file_path, coalesce(m.e, 0), f.size FROM (SELECT repo_id, file_path, max(octet_length(source))::INT AS size FROM sources GROUP BY ALL) f LEFT JOIN (SELECT repo_id, file_path, max(end_byte) AS e FROM s GROUP BY ALL) m USING (repo_id, file_path))
SELECT repo_id, file_path, a AS start_byte, b AS end_byte FROM g WHERE a < b""")
def span_gaps(spark, d):
    """What no chunk of a file covers."""
    keys = ["repo_id", "file_path"]
    sizes = table(spark, d, "sources").groupBy(*keys).agg(F.max(F.octet_length("source")).alias("size"))
    return chunk_ops.gaps(chunk_ops.roots(_spans(spark, d).withColumnRenamed("chunk_no", "ord"), keys), sizes, keys)


@query("""SELECT repo_id, file_path, count(DISTINCT chunk_no) AS chunks, count(DISTINCT chunk_no) FILTER (is_partial) AS partial, coalesce(sum(token_estimate), 0) AS tokens, min(start_line) AS first_line, max(end_line) AS last_line FROM chunks GROUP BY 1, 2""")
def chunks_by_file(spark, d):
    c = table(spark, d, "chunks")
    return c.groupBy("repo_id", "file_path").agg(F.countDistinct("chunk_no").alias("chunks"), F.countDistinct(F.when(F.col("is_partial"), F.col("chunk_no"))).alias("partial"), F.coalesce(F.sum("token_estimate"), F.lit(0)).alias("tokens"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"))


@query("""SELECT repo_id, file_path, n AS symbols, r AS rank FROM (SELECT repo_id, file_path, n, row_number() OVER (PARTITION BY repo_id ORDER BY n DESC, file_path) AS r FROM (SELECT repo_id, file_path, sum(len(symbol_names)) AS n FROM (SELECT DISTINCT repo_id, file_path, chunk_no, symbol_names FROM chunks WHERE symbol_names IS NOT NULL) GROUP BY 1, 2)) WHERE r <= 10""")
def top_files_by_symbols(spark, d):
    c = table(spark, d, "chunks").where("symbol_names IS NOT NULL").select("repo_id", "file_path", "chunk_no", "symbol_names").distinct()
    n = c.groupBy("repo_id", "file_path").agg(F.sum(F.size("symbol_names")).alias("symbols"))
    w = Window.partitionBy("repo_id").orderBy(F.desc("symbols"), "file_path")
    return n.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


@query("""WITH s AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: {'n': 0::BIGINT, 'used': octet_length(encode(x)) + 1}) AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, list_reduce(list_concat([{'n': 0::BIGINT, 'used': 0::BIGINT}], l), lambda a, x: CASE WHEN a.n > 0 AND a.used + x.used <= 1500 THEN {'n': a.n, 'used': a.used + x.used} ELSE {'n': a.n + 1, 'used': x.used} END).n AS packs FROM s""")
def greedy_packs(spark, d):
    """Into how many packs of 1,500 bytes the lines of each document go, greedily."""
    lines = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return chunk_ops.pack_lines(lines.select("doc_id", "i", (F.octet_length("line") + 1).alias("size")), ["doc_id"], "size", 1500, "i")


# ---------------------------------------------------------------- structure of the sources
def _files(spark, d):
    """Each file once: of rows that repeat its key the longest, of equally long ones the one of the larger hash. Only hashes are compared and grouped."""
    s = table(spark, d, "sources").select("repo_id", "file_path", "source")
    size, digest = F.octet_length("source"), F.xxhash64("source")
    keys = ["repo_id", "file_path"]
    # Few keys are there twice, so both joins are with a small table, which adaptive execution broadcasts where it is small.
    again = s.groupBy(*keys).agg(F.max(F.struct(size.alias("n"), digest.alias("h"))).alias("_x"), F.count("*").alias("_c")).where("_c > 1").select(*keys, F.col("_x.n").alias("_n"), F.col("_x.h").alias("_h"))
    again = cut_lineage(again)
    rest = s.join(again, keys).where((size == F.col("_n")) & (digest == F.col("_h"))).dropDuplicates(keys).drop("_n", "_h")
    return s.join(again, keys, "left_anti").unionByName(rest).withColumn("language", paths.language(F.col("file_path")))


def _go_modules(files):
    """The module of each repository's go.mod, the topmost of several."""
    own = files.where(paths.basename(F.col("file_path")) == "go.mod").select("repo_id", "file_path", go_module(F.decode("source", "UTF-8")).alias("go_module"))
    return own.groupBy("repo_id").agg(F.min_by("go_module", F.struct(F.length("file_path"), "file_path")).alias("go_module"))


@query()
def symbols_by_kind(spark, d):
    """Symbols of every parsed file, by language and kind."""
    s = symbol_rows(parse(_files(spark, d), ["repo_id", "file_path"]), ["repo_id", "file_path"])
    return s.groupBy("language", "kind").agg(F.count("*").alias("symbols"), F.count_if("is_exported").alias("exported"), F.countDistinct("repo_id", "file_path").alias("files"))


@query()
def import_edges(spark, d):
    """Imports resolved to files of their repository."""
    f = _files(spark, d)
    i = import_rows(parse(f, ["repo_id", "file_path"]), ["repo_id", "file_path"])
    return imports.resolve(i, f, ["repo_id"], _go_modules(f))


@query()
def knowledge_graph(spark, d):
    """Nodes and edges of the graph of files and symbols, counted by repository and type."""
    f = _files(spark, d)
    p = cut_lineage(parse(f, ["repo_id", "file_path"]))
    s, i = symbol_rows(p, ["repo_id", "file_path"]), import_rows(p, ["repo_id", "file_path"])
    known = p.select("repo_id", "file_path", "language")
    nodes, edges = graph.knowledge_nodes(known, s, None, ["repo_id"]), graph.knowledge_edges(known, s, imports.resolve(i, f, ["repo_id"], _go_modules(f)), ["repo_id"])
    return nodes.groupBy("repo_id", F.concat(F.lit("node "), "node_type").alias("what")).count().unionByName(edges.groupBy("repo_id", F.concat(F.lit("edge "), "edge_type").alias("what")).count())


@query()
def rechunked(spark, d):
    """Chunks of whole symbols of every parsed file."""
    f = _files(spark, d)
    return chunk_ops.chunk(f, parse(f, ["repo_id", "file_path"]), ["repo_id", "file_path"]).drop("content")


@query()
def endpoint_digests(spark, d):
    s = symbol_rows(parse(_files(spark, d), ["repo_id", "file_path"]), ["repo_id", "file_path"])
    return documentation.endpoint_digest(s, ["repo_id"])


@query()
def manifests(spark, d):
    return documentation.manifests(_files(spark, d), ["repo_id"])


@query(r"""WITH f AS (SELECT repo_id, file_path, trim(regexp_replace(summary, '[ \t\n\r\f\v]*\n[ \t\n\r\f\v]*', ' ', 'g')) AS t FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, file_path ORDER BY updated_at DESC NULLS LAST, summary DESC NULLS LAST) AS r FROM file_docs) WHERE r = 1),
 s AS (SELECT repo_id, file_path, regexp_replace(file_path, '/?[^/]*$', '') AS d, regexp_extract(file_path, '([^/]*)$', 1) AS b, CASE WHEN t = '' THEN '' WHEN regexp_extract(t, '^(.*?[.!?])(?: |$)', 1) <> '' THEN regexp_extract(t, '^(.*?[.!?])(?: |$)', 1) ELSE t || '.' END AS p FROM f),
 g AS (SELECT repo_id, d, string_agg('| `' || b || '` | ' || coalesce(nullif(replace(p, '|', '\|'), ''), '(not documented)') || ' |', chr(10) ORDER BY file_path) AS rows FROM s GROUP BY 1, 2)
SELECT repo_id, '# Project structure' || chr(10) || chr(10) || string_agg(CASE WHEN d = '' THEN '### Repository root' ELSE '### `' || d || '`' END || chr(10) || chr(10) || '| File | Purpose |' || chr(10) || '|---|---|' || chr(10) || rows, chr(10) || chr(10) ORDER BY d) || chr(10) AS text FROM g GROUP BY 1""")
def structure_documents(spark, d):
    f = table(spark, d, "file_docs")
    return documentation.structure_document(changes.latest(f.select("repo_id", "file_path", "summary", "updated_at"), ["repo_id", "file_path"], "updated_at", "summary"), ["repo_id"])


_ENDINGS = ", ".join(f"'{e}'" for e in review.PATH_ENDINGS)


@query(rf"""WITH d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, string_split(regexp_replace(line, '``+', chr(1), 'g'), '`') AS p FROM d), s AS (SELECT doc_id, unnest(list_filter(p, lambda x, i: i % 2 = 0 AND i < len(p))) AS ref FROM t),
 r AS (SELECT DISTINCT doc_id AS name, regexp_replace(ref, '^\./', '') AS ref FROM s WHERE ref <> '' AND NOT regexp_matches(ref, '[ \t\r\f\v()<>{{}}*]|://') AND (lower(regexp_extract(ref, '\.([A-Za-z0-9]+)$', 1)) IN ({_ENDINGS}) OR ref LIKE '%/')),
 f AS (SELECT DISTINCT string_split(file_path, '/') AS p FROM sources WHERE file_path IS NOT NULL), k AS (SELECT p[-1] AS ref FROM f UNION SELECT unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[1:i], '/') || CASE WHEN i < len(p) THEN '/' ELSE '' END)) FROM f)
SELECT name, ref FROM r ANTI JOIN k USING (ref)""")
def missing_references(spark, d):
    """Code spans of documents that look like paths but are no file of any source."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("name"), "text")
    return review.missing_references(docs, table(spark, d, "sources").select("file_path").distinct())


# ---------------------------------------------------------------- documentation rows
@query("""SELECT repo_id, file_path, updated_at, model, summary, error FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, file_path ORDER BY updated_at DESC NULLS LAST, model DESC NULLS LAST, summary DESC NULLS LAST, error DESC NULLS LAST) AS r FROM file_docs) WHERE r = 1""")
def latest_file_docs(spark, d):
    f = table(spark, d, "file_docs").select("repo_id", "file_path", "updated_at", "model", "summary", "error")
    return changes.latest(f, ["repo_id", "file_path"], "updated_at", "model", "summary", "error")


@query("""SELECT repo_id, count(*) AS docs, count(*) FILTER (error IS NULL) AS good, count(*) FILTER (error LIKE 'provider%' OR error LIKE 'rate limit%' OR error LIKE 'connection%') AS provider, count(*) FILTER (error LIKE '%yntax%' OR error LIKE 'unexpected%') AS parser,
 coalesce(sum(coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0)), 0) AS tokens FROM file_docs GROUP BY 1""")
def documentation_quality(spark, d):
    f, e = table(spark, d, "file_docs"), F.col("error")
    return f.groupBy("repo_id").agg(F.count("*").alias("docs"), F.count_if(e.isNull()).alias("good"), F.count_if(e.startswith("provider") | e.startswith("rate limit") | e.startswith("connection")).alias("provider"), F.count_if(e.contains("yntax") | e.startswith("unexpected")).alias("parser"), F.sum(F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))).alias("tokens"))


@query(r"""WITH x AS (SELECT DISTINCT repo_id, file_path, trim(regexp_replace(summary, '[ \t\n\r\f\v]*\n[ \t\n\r\f\v]*', ' ', 'g')) AS t FROM file_docs WHERE summary IS NOT NULL)
SELECT repo_id, file_path, CASE WHEN t = '' THEN '' WHEN regexp_extract(t, '^(.*?[.!?])(?: |$)', 1) <> '' THEN regexp_extract(t, '^(.*?[.!?])(?: |$)', 1) ELSE t || '.' END AS sentence FROM x""")
def first_sentences(spark, d):
    f = table(spark, d, "file_docs").where("summary IS NOT NULL").select("repo_id", "file_path", "summary")
    return f.select("repo_id", "file_path", first_sentence(F.col("summary")).alias("sentence")).distinct()


@query("""SELECT record_type, id, file_path, text FROM (SELECT 'chunk' AS record_type, CAST(doc_id AS VARCHAR) AS id, file_path, text FROM documents WHERE kind = 'summary' AND text <> '' UNION ALL SELECT 'file', file_path, file_path, summary FROM file_docs WHERE error IS NULL AND summary <> '')""")
def embeddable_items(spark, d):
    c = table(spark, d, "documents").where("kind = 'summary'").select(F.col("doc_id").cast("string").alias("chunk_id"), "file_path", F.col("text").alias("summary"), F.lit(None).cast("string").alias("error"))
    return vectors.embeddable(c, table(spark, d, "file_docs").select("file_path", "summary", "error"))


_LICENSES = " ".join("WHEN " + " AND ".join(f"contains(lower(text), '{m}')" for m in marks) + f" THEN '{name}'" for name, marks in LICENSE_RULES)


@query(f"SELECT coalesce(CASE {_LICENSES} END, 'none') AS license, count(*) AS documents FROM documents WHERE text IS NOT NULL GROUP BY 1")
def licenses_mentioned(spark, d):
    t = table(spark, d, "documents").where("text IS NOT NULL")
    return t.groupBy(F.coalesce(license_of_text(F.col("text")), F.lit("none")).alias("license")).agg(F.count("*").alias("documents"))


_PHRASES = [f"regexp_extract_all(text, '{p}')" for p in BANNED]


@query(f"SELECT doc_id, len(p) AS phrases, array_to_string(p, '|') AS listing FROM (SELECT doc_id, list_concat(list_concat({_PHRASES[0]}, {_PHRASES[1]}), list_concat({_PHRASES[2]}, {_PHRASES[3]})) AS p FROM documents WHERE text IS NOT NULL)")
def banned_phrase_counts(spark, d):
    p = banned_phrases(F.col("text"))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(p).cast("bigint").alias("phrases"), F.array_join(p, "|").alias("listing"))


# ---------------------------------------------------------------- runs and repositories
_COUNTERS = ["files_total", "files_changed", "files_skipped", "files_skipped_secret", "chunks_documented", "embeddings_generated", "vectors_persisted", "tokens_used"]


@query(f"SELECT {', '.join(f'max({c}) AS {c}' for c in _COUNTERS)}, min(started_at) AS started_at, max(finished_at) AS finished_at FROM run_stats")
def merged_statistics(spark, d):
    return changes.merge_statistics(table(spark, d, "run_stats"), _COUNTERS)


@query("""SELECT repo_id, count(*) AS runs, count(*) FILTER (finished_at IS NULL) AS unfinished, round(avg(finished_at - started_at), 3) AS mean_seconds, max(tokens_used) AS most_tokens FROM (SELECT DISTINCT * FROM run_stats) GROUP BY 1""")
def run_durations(spark, d):
    r = table(spark, d, "run_stats").distinct()
    return r.groupBy("repo_id").agg(F.count("*").alias("runs"), F.count_if(F.col("finished_at").isNull()).alias("unfinished"), F.round(F.avg(duration(F.col("started_at"), F.col("finished_at"))), 3).alias("mean_seconds"), F.max("tokens_used").alias("most_tokens"))


_METRICS = ["files_total", "files_changed", "chunks_documented", "tokens_used"]


@query(" UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 2) AS mean, min({m})::DOUBLE AS least, max({m})::DOUBLE AS most FROM run_stats" for m in _METRICS))
def run_summary(spark, d):
    return review.summarise(table(spark, d, "run_stats"), _METRICS)


@query("SELECT repo_id, owner || '/' || name AS repository FROM repos WHERE owner IS NOT NULL AND name IS NOT NULL AND regexp_matches(owner, '^[A-Za-z0-9_.-]+$') AND regexp_matches(name, '^[A-Za-z0-9_.-]+$')")
def repository_addresses(spark, d):
    """The owner and name that the address of a repository tells."""
    r = table(spark, d, "repos")
    address = F.concat(F.lit("https://github.com/"), "owner", F.lit("/"), "name", F.lit(".git"))
    return r.select("repo_id", github_repository(address).alias("repository")).where("repository IS NOT NULL")


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '[^a-z0-9_ \\t-]', '', 'g'), '[ \\t]', '-', 'g') AS slug FROM part")
def slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", slug(F.col("p_name")).alias("slug"))


# ---------------------------------------------------------------- graph, on orders of parts from suppliers
def _supply(spark, d):
    x = table(spark, d, "lineitem")
    return x.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"), F.array(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("targets"))


@query("""SELECT file, sum(i)::BIGINT AS dependents, sum(o)::BIGINT AS dependencies, (sum(i) + sum(o))::BIGINT AS degree FROM (SELECT 's' || l_suppkey AS file, 0 AS i, 1 AS o FROM lineitem UNION ALL SELECT 'p' || l_partkey, 1, 0 FROM lineitem) GROUP BY 1 ORDER BY 4 DESC, 1 LIMIT 25""")
def degree_top25(spark, d):
    return graph.degrees(_supply(spark, d), []).orderBy(F.desc("degree"), "file").limit(25)


@query("SELECT 's' || l_suppkey AS source, count(DISTINCT l_partkey) AS targets FROM lineitem GROUP BY 1")
def adjacency_sizes(spark, d):
    return graph.fan_out(_supply(spark, d), [])


@query("SELECT 's' || l_suppkey AS source, string_agg(DISTINCT 'p' || l_partkey, '|' ORDER BY 'p' || l_partkey) AS parts FROM lineitem GROUP BY 1")
def adjacency_lists(spark, d):
    return graph.adjacency(_supply(spark, d), []).select("source", F.array_join("targets", "|").alias("parts"))


@query("SELECT DISTINCT 'p' || l_partkey AS file, 'depends on' AS direction FROM lineitem WHERE l_suppkey = 1")
def neighbours_of_one(spark, d):
    return graph.neighbours(_supply(spark, d), "s1")


@query("""WITH n AS (SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), f AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS i FROM (SELECT n_name AS name FROM n UNION SELECT r_name FROM n)),
l AS (SELECT 1 AS k, i AS a, 0 AS b, '    n' || i || '["' || name || '"]' AS line FROM f UNION ALL SELECT 2, a.i, b.i, '    n' || a.i || ' --> n' || b.i FROM (SELECT DISTINCT n_name, r_name FROM n) x JOIN f a ON a.name = n_name JOIN f b ON b.name = r_name)
SELECT 'flowchart TD' || chr(10) || string_agg(line, chr(10) ORDER BY k, a, b) AS diagram FROM l""")
def region_diagram(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    pairs = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source"), F.col("r_name").alias("target"))
    chosen = pairs.select(F.col("source").alias("file_path")).union(pairs.select("target"))
    return graph.mermaid(chosen, pairs)


# ---------------------------------------------------------------- vectors
@query("""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT vec_id, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], q.v), lambda p: (p[1] - p[2]) ** 2)), 6) AS distance FROM embeddings, q ORDER BY list_sum(list_transform(list_zip(embedding::DOUBLE[], q.v), lambda p: (p[1] - p[2]) ** 2)), vec_id LIMIT 10""")
def knn_of_one(spark, d):
    e = table(spark, d, "embeddings")
    q = e.orderBy("vec_id").select("embedding").first()[0]
    return vectors.search(e, q, 10, key="vec_id", vector="embedding").select("vec_id", F.round("distance", 6).alias("distance"))


@query("""SELECT query, id, round(distance, 6) AS distance, rank FROM (SELECT q.vec_id AS query, v.vec_id AS id, list_sum(list_transform(list_zip(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) ** 2)) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) ** 2)), v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0) WHERE rank <= 10""")
def knn_of_many(spark, d):
    """Searches take every row whose id is divisible by 100 as queries, against all rows."""
    e = table(spark, d, "embeddings")
    v = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = v.where("id % 100 = 0").withColumnRenamed("id", "query")
    return vectors.search_many(q, v).withColumn("distance", F.round("distance", 6))


@query("""SELECT model, record_type, count(*) AS records, count(*) FILTER (error IS NULL AND len(vector) > 0) AS stored, count(DISTINCT vec_no) AS ids FROM vectors GROUP BY 1, 2""")
def vector_records(spark, d):
    v = table(spark, d, "vectors")
    return v.groupBy("model", "record_type").agg(F.count("*").alias("records"), F.count_if(F.col("error").isNull() & (F.size("vector") > 0)).alias("stored"), F.countDistinct("vec_no").alias("ids"))


@query("""SELECT query_no, count(*) AS hits, count(*) FILTER (distance IS NULL) AS unknown, round(min(distance), 6) AS nearest, count(DISTINCT file_path) AS files FROM (SELECT DISTINCT query_no, hit_rank, vec_no, distance, file_path FROM search_results) GROUP BY 1""")
def logged_searches(spark, d):
    s = table(spark, d, "search_results").select("query_no", "hit_rank", "vec_no", "distance", "file_path").distinct()
    return s.groupBy("query_no").agg(F.count("*").alias("hits"), F.count_if(F.col("distance").isNull()).alias("unknown"), F.round(F.min("distance"), 6).alias("nearest"), F.countDistinct("file_path").alias("files"))


# ---------------------------------------------------------------- events
@query("SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events")
def event_properties(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def events_by_hour(spark, d):
    """The batch form of the stream of windowed counts."""
    return streams.tumbling_counts(table(spark, d, "events"), "ts", ["event_type"])


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), y AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM y GROUP BY user_id, s""")
def user_sessions(spark, d):
    return streams.sessions(table(spark, d, "events"), "ts", ["user_id"])


# ---------------------------------------------------------------- relational extensions
@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    x = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("lines"))


@query("""SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def customers_rollup(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
