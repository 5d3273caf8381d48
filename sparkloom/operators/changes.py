"""Changes between snapshots and the memo of computed results."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.session import cut_lineage

MEMO = "repository_path string, relative_path string, record_type string, content_hash string, payload string, updated_at timestamp"
KEY = ["repository_path", "relative_path", "record_type"]


def diff(current: DataFrame, previous: DataFrame | None, key: str = "relative_path", value: str = "content_hash") -> DataFrame:
    """(key, status): added, modified, unchanged or deleted. Without a previous snapshot everything is added."""
    now = current.select(F.col(key), F.col(value).alias("_now"), F.lit(True).alias("_c"))
    if previous is None:
        return now.select(key, F.lit("added").alias("status"))
    then = previous.select(F.col(key), F.col(value).alias("_then"), F.lit(True).alias("_p"))
    status = F.when(F.col("_p").isNull(), "added").when(F.col("_c").isNull(), "deleted").when(F.col("_now").eqNullSafe(F.col("_then")), "unchanged").otherwise("modified")
    return now.join(then, key, "full").select(key, status.alias("status"))


def changed(changes: DataFrame) -> DataFrame:
    """What must be computed again."""
    return changes.where("status IN ('added', 'modified')")


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key. An aggregate, so partial results shrink before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_x")).select(*keys, *(F.col(f"_x.{c}").alias(c) for c in others))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows but for those whose key is in new, and the new rows; of repeated new keys one is kept. The old side is only filtered, never grouped."""
    one = new.dropDuplicates(keys)
    return old.join(one.select(*keys), keys, "left_anti").unionByName(one, allowMissingColumns=True)


def split_by_memo(wanted: DataFrame, memo: DataFrame, keys: list[str], value: str = "content_hash") -> tuple[DataFrame, DataFrame]:
    """(hits with their payload, misses): a row hits if its key and hash are in the memo; an outdated hash is a miss."""
    known = memo.select(*keys, F.col(value).alias("_h"), "payload").dropDuplicates(keys)
    joined = wanted.join(known, keys, "left")
    hit = F.col("payload").isNotNull() & (F.col("_h") == F.col(value))
    return joined.where(hit).drop("_h"), joined.where(~F.coalesce(hit, F.lit(False))).drop("_h", "payload")


class Store:
    """A Parquet table in buckets by the hash of its key. Every change writes new folders and then a numbered manifest that names the folders that
    count, so a reader finds the old table or the new one at any time, and an upsert rewrites only the buckets it touches.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def _fs(self, *more: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *more)))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _manifests(self) -> list[str]:
        """The names of the manifests, oldest first."""
        fs, p = self._fs()
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in names if n.startswith("_manifest-"))

    def _load(self, name: str) -> dict:
        fs, p = self._fs(name)
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _manifest(self) -> dict | None:
        """{keys, parts: bucket -> folder} of the table as it is."""
        names = self._manifests()
        return self._load(names[-1]) if names else None

    def _commit(self, keys: list[str], parts: dict[str, str]) -> None:
        names = self._manifests()
        after = f"_manifest-{int(names[-1].split('-')[1]) + 1 if names else 0:012d}"
        fs, beside = self._fs(f"_next-{uuid.uuid4().hex}")
        out = fs.create(beside, True)
        out.write(bytearray(json.dumps({"keys": keys, "parts": parts}).encode()))
        out.close()
        if not fs.rename(beside, self._fs(after)[1]):
            raise OSError(f"another writer has changed {self.path}")
        # Folders that neither this manifest nor the one before names are no longer read.
        kept = set(parts.values()) | (set(self._load(names[-1])["parts"].values()) if names else set())
        kept = {k.split("/")[0] for k in kept}
        for s in fs.listStatus(self._fs()[1]):
            n = s.getPath().getName()
            if n.startswith("data-") and n not in kept or n in names[:-1]:
                fs.delete(s.getPath(), True)

    def exists(self) -> bool:
        return bool(self._manifests())

    def _read(self, parts: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{p}" for p in parts)) if parts else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """The rows; none if the table is missing."""
        m = self._manifest()
        return self._read(list(m["parts"].values()) if m else [])

    def _bucket(self, keys: list[str]):
        return F.pmod(F.xxhash64(*keys), F.lit(self.BUCKETS)).cast("int")

    def _save(self, rows: DataFrame, keys: list[str]) -> dict[str, str]:
        """Bucket -> folder of the rows, as written."""
        folder = f"data-{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket(keys)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        fs, p = self._fs(folder)
        names = [s.getPath().getName() for s in fs.listStatus(p)]  # at most BUCKETS
        return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith("_bucket=")}

    def write(self, rows: DataFrame, keys: list[str] | None = None) -> None:
        """Replaces the table."""
        keys = keys or [rows.columns[0]]
        self._commit(keys, self._save(rows, keys))

    def upsert(self, rows: DataFrame, keys: list[str]) -> None:
        m = self._manifest()
        if m is None or m["keys"] != keys:
            self.write(upsert(self.read(), rows, keys), keys)
            return
        rows = cut_lineage(rows.dropDuplicates(keys))
        touched = {str(r[0]) for r in rows.select(self._bucket(keys)).distinct().collect()}  # at most BUCKETS
        old = self._read([p for b, p in m["parts"].items() if b in touched])
        self._commit(keys, m["parts"] | self._save(upsert(old, rows, keys), keys))

    def clear(self) -> None:
        fs, p = self._fs()
        fs.delete(p, True)


class Memo(Store):
    """Results by repository, path and kind, valid for one hash of the content."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, MEMO)

    def hashes(self, repository: str) -> DataFrame | None:
        """(relative_path, content_hash) as saved for a repository; None before its first run."""
        rows = self.read().where((F.col("repository_path") == repository) & (F.col("record_type") == "file_hash")).select("relative_path", "content_hash")
        return None if rows.isEmpty() else rows

    def save(self, repository: str, record_type: str, rows: DataFrame) -> None:
        """rows: relative_path, content_hash and, but for hashes, payload."""
        payload = F.col("payload") if "payload" in rows.columns else F.lit(None).cast("string")
        self.upsert(rows.select(F.lit(repository).alias("repository_path"), "relative_path", F.lit(record_type).alias("record_type"), "content_hash", payload.alias("payload"), F.current_timestamp().alias("updated_at")), KEY)


def ordered_union(parts: list[DataFrame], column: str) -> DataFrame:
    """The distinct values of a column over several frames, each with the place of its first occurrence."""
    out = None
    for i, p in enumerate(parts):
        own = p.select(F.col(column), F.struct(F.lit(i).alias("part"), F.monotonically_increasing_id().alias("row")).alias("ord"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy(column).agg(F.min("ord").alias("ord"))


def merge_statistics(rows: DataFrame, counters: list[str]) -> DataFrame:
    """One row: the largest of each counter, the first start and the last end; nulls do not count."""
    return rows.agg(*(F.max(c).alias(c) for c in counters), F.min("started_at").alias("started_at"), F.max("finished_at").alias("finished_at"))


def batches(rows: DataFrame, size: int, order: str) -> DataFrame:
    """The rows with the number of their batch in the order of a column; all batches have size rows but the last."""
    if size <= 0:
        raise ValueError("size must be positive")
    w = Window.partitionBy("_part").orderBy(order)
    numbered = cut_lineage(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()).withColumn("_i", F.row_number().over(w) - 1))
    # One row for each partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = numbered.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return numbered.join(F.broadcast(offsets), "_part").withColumn("batch", F.floor((F.col("_before") + F.col("_i")) / size)).drop("_part", "_i", "_before")
