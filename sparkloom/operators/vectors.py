"""Storing and searching vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.changes import Store

STORED = "id string, record_type string, file_path string, text string, model string, vector array<float>"


def squared_distance(vector, query: list[float]):
    """Squared Euclidean distance to a fixed vector; null where lengths differ."""
    q = F.array(*(F.lit(float(x)) for x in query))
    d = F.aggregate(F.zip_with(vector, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(vector) == len(query), d)


def cosine_distance(a, b):
    """One minus the cosine of two vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def search(vectors: DataFrame, query: list[float], k: int = 10, record_type: str | None = None, key: str = "id", vector: str = "vector") -> DataFrame:
    """The k nearest of the rows, of one type if given; the filter comes before the top k, ties go by key. Each partition keeps its own k."""
    rows = vectors.where(F.col("record_type") == record_type) if record_type else vectors
    return rows.withColumn("distance", squared_distance(F.col(vector), query)).where("distance IS NOT NULL").orderBy("distance", key).limit(k)


#: Queries that are broadcast at once, about; more are handled in rounds of this size.
ROUND = 20_000


def search_many(queries: DataFrame, vectors: DataFrame, k: int = 10, block: int = 2048) -> DataFrame:
    """(query, id, distance, rank) of the k nearest vectors of every query: queries in blocks against all rows, partial heaps merged by query.

    queries: query, vector; vectors: id, vector. Null vectors are left out; all others have one length.
    """
    own = queries.select("query", "vector").where("vector IS NOT NULL")
    rounds = own.count() // ROUND + 1
    kind, name = queries.schema["query"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    local = None
    for r in range(rounds):
        part = own.where(F.pmod(F.xxhash64("query"), F.lit(rounds)) == r).toPandas()
        names, matrix = part["query"].to_numpy(), np.stack(part["vector"].to_numpy()).astype("f4") if len(part) else np.zeros((0, 1), "f4")
        shared = vectors.sparkSession.sparkContext.broadcast((names, matrix))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names_, matrix_ = shared.value
            for v in batches:
                if not len(v):
                    continue
                x, ids = np.stack(v["vector"].to_numpy()).astype("f4"), v["id"].to_numpy()
                for lo in range(0, len(names_), block):
                    q = matrix_[lo : lo + block]
                    d = (q**2).sum(1)[:, None] - 2 * q @ x.T + (x**2).sum(1)[None]
                    # All that float rounding may put among the k nearest are measured exactly.
                    if d.shape[1] > k:
                        slack = 1e-5 * ((q**2).sum(1)[:, None] + (x**2).sum(1).max())
                        row, col = np.nonzero(d <= np.partition(d, k - 1, axis=1)[:, k - 1 : k] + slack)
                    else:
                        row, col = (i.ravel() for i in np.indices(d.shape))
                    for at in range(0, len(row), 100_000):
                        r, c = row[at : at + 100_000], col[at : at + 100_000]
                        exact = ((q[r].astype("f8") - x[c].astype("f8")) ** 2).sum(-1)
                        yield pd.DataFrame({"query": names_[lo : lo + block][r], "id": ids[c], "distance": exact})

        rows = vectors.select("id", "vector").where("vector IS NOT NULL").mapInPandas(run, f"query {kind}, id {name}, distance double")
        local = rows if local is None else local.unionByName(rows)
    best = local.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "id"))), 1, k).alias("h"))
    return best.select("query", F.posexplode("h").alias("p", "x")).select("query", "x.id", "x.distance", (F.col("p") + 1).alias("rank"))


def embeddable(chunk_docs: DataFrame, file_docs: DataFrame) -> DataFrame:
    """(record_type, id, file_path, text) of the summaries that have no error and are not empty."""
    good = F.col("error").isNull() & (F.col("summary") != "")
    c = chunk_docs.where(good).select(F.lit("chunk").alias("record_type"), F.col("chunk_id").alias("id"), "file_path", F.col("summary").alias("text"))
    return c.unionByName(file_docs.where(good).select(F.lit("file").alias("record_type"), F.col("file_path").alias("id"), "file_path", F.col("summary").alias("text")))


class VectorStore(Store):
    """Vectors without errors, by id. A missing table is empty."""

    def __init__(self, spark, path: str):
        super().__init__(spark, path, STORED)

    def save(self, records: DataFrame) -> None:
        """Replaces the table; nothing happens without records."""
        good = records.where("error IS NULL") if "error" in records.columns else records
        good = good.select(*(c.split()[0] for c in STORED.split(", ")))
        if not good.isEmpty():
            self.write(good, ["id"])

    def merge(self, records: DataFrame) -> None:
        self.upsert(records.select(*(c.split()[0] for c in STORED.split(", "))), ["id"])

    def count(self) -> int:
        return self.read().count()

    def search(self, query: list[float], k: int = 10, record_type: str | None = None) -> DataFrame:
        return search(self.read(), query, k, record_type).select("id", "record_type", "file_path", "text", "distance")
