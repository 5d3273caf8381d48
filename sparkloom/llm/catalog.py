"""The queries of the training-data operators over the Parquet tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import handwritten, licenses, neighbours, packing, secrets, splitting, tokens, truncation, validity
from sparkloom.sources.tables import table

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


@query()
def p1_found(spark, d):
    """Pairs of usable vectors of one model of which one is among the ten most similar of the other."""
    return neighbours.pairs(neighbours.usable(table(spark, d, "vectors")))


@query()
def p1_nearest(spark, d):
    """The ten most similar vectors of each usable vector, with their distance."""
    return neighbours.nearest(neighbours.usable(table(spark, d, "vectors")))


@query("SELECT DISTINCT chunk_no FROM chunks WHERE length(content) > 6000")
def p2_found(spark, d):
    """The chunks that are cut, as the operator cuts them."""
    return splitting.split_chunks(table(spark, d, "chunks")).select("chunk_no").distinct()


@query()
def p2_pieces(spark, d):
    """The pieces of every chunk longer than 6,000 characters."""
    return splitting.split_chunks(table(spark, d, "chunks"))


@query()
def p3_found(spark, d):
    """The files that the grammar of their language rejects."""
    return validity.invalid(table(spark, d, "sources")).select("repo_id", "file_path").distinct()


@query()
def p3_rates(spark, d):
    """Rates of invalid files by repository and language."""
    return validity.rates(table(spark, d, "sources"), table(spark, d, "file_docs"))


@query()
def p4_found(spark, d):
    """The licence of every code file and repository."""
    return licenses.licenses(table(spark, d, "sources"), table(spark, d, "repos"), table(spark, d, "license_texts"))


@query()
def p5_found(spark, d):
    """The lines of files on which the value of a credential begins."""
    return secrets.credentials(table(spark, d, "chunks")).where("line_no IS NOT NULL").select("repo_id", "file_path", "line_no").distinct()


@query()
def p5_redacted(spark, d):
    """The contents that hold credentials, with their values masked."""
    chunks = table(spark, d, "chunks")
    return secrets.redact(chunks, secrets.credentials(chunks))


@query()
def p5_calibration(spark, d):
    """How scores of candidates that were held out of the training relate to their weak labels."""
    return secrets.calibrated(table(spark, d, "chunks"))


@query()
def p5_report(spark, d):
    """Files with credentials per repository beside the files left out before."""
    return secrets.report(secrets.credentials(table(spark, d, "chunks")), table(spark, d, "run_stats"))


@query()
def p6_found(spark, d):
    """The files of each repository that nobody there wrote by hand."""
    return handwritten.not_by_hand(table(spark, d, "sources"), table(spark, d, "upstream_files")).select("repo_id", "file_path")


@query()
def p6_kinds(spark, d):
    """The same files with what they are."""
    return handwritten.not_by_hand(table(spark, d, "sources"), table(spark, d, "upstream_files"))


@query()
def p7_ids(spark, d):
    """The ids of every document under byte_bpe_50k."""
    return tokens.encode_corpus(table(spark, d, "documents"))


@query("SELECT doc_id, TRUE AS same FROM documents")
def p7_decoded(spark, d):
    """Whether each document's ids give back its text; a null text comes back empty."""
    from pyspark.sql import functions as F

    docs = table(spark, d, "documents")
    back = tokens.decode_corpus(tokens.encode_corpus(docs)).withColumnRenamed("text", "back")
    return docs.join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("back")).alias("same"))


@query()
def p8_containers(spark, d):
    """The place of every document in containers of 2,048 tokens of byte_bpe_50k."""
    return packing.pack(tokens.count_tokens(table(spark, d, "documents")))


@query()
def p9_found(spark, d):
    """The documents whose text lost its end."""
    return truncation.truncated(table(spark, d, "documents")).select("doc_id").distinct()


@query()
def p9_rates(spark, d):
    """The share of such documents per source."""
    docs = table(spark, d, "documents")
    return truncation.rates(docs, truncation.truncated(docs))
