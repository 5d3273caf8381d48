"""Filling containers of fixed capacity with items of varying length.

What fits together depends only on the number of items of each length, and there are at most ``capacity`` lengths. So the
plan is made on that histogram: variable-capacity best fit over all permitted lengths of containers at once. Each step opens,
for the longest items left, the container whose cost a token is least among the permitted lengths, fills it by best fit,
repeats that pattern as often as the histogram allows, and last downsizes it to the least permitted length that holds its
contents. Items then get their place by their rank among items of their length, which is found without ordering a whole length in one
task: ranks are counted by (length, salt) and offset by sums over salts.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import cut_lineage

#: Rows of one (length, salt) that are ranked in one task, about.
RANKED = 200_000
#: Cost of a container besides its length, in tokens: half-empty short containers are no way round a poor fit.
OVERHEAD = 64


def _fill(sizes: list[int], left: dict[int, int], first: int, room: int) -> dict[int, int]:
    """Best fit: the longest item that fits, again and again, beside one item of length first."""
    pattern, room = {first: 1}, room - first
    while room > 0:
        at = bisect_right(sizes, room) - 1
        while at >= 0 and left[sizes[at]] - pattern.get(sizes[at], 0) <= 0:
            at -= 1
        if at < 0:
            break
        size = sizes[at]
        many = min(left[size] - pattern.get(size, 0), room // size)
        pattern[size] = pattern.get(size, 0) + many
        room -= many * size
    return pattern


def plan(histogram: dict[int, int], capacity: int, permitted: list[int]) -> list[tuple[dict[int, int], int, int]]:
    """(pattern, times, length of the container) whose patterns use up the histogram of lengths from 1 to capacity."""
    permitted = sorted({*permitted, capacity})
    left = {s: n for s, n in histogram.items() if n > 0}
    sizes, out = sorted(left), []
    while sizes:
        longest, best = sizes[-1], None
        for room in permitted:
            if room >= longest:
                pattern = _fill(sizes, left, longest, room)
                filled = sum(s * k for s, k in pattern.items())
                cost = (room + OVERHEAD) / filled
                if best is None or cost <= best[0]:
                    best = cost, pattern, filled
        _, pattern, filled = best
        times = min(left[s] // k for s, k in pattern.items())
        out.append((pattern, times, next(c for c in permitted if c >= filled)))
        for s, k in pattern.items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
        sizes = sorted(left)
    return out


def slots(planned: list[tuple[dict[int, int], int, int]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """(size, from rank, to rank, items of the size in a container, first container, place in it, container's length)."""
    rows, used, first = [], {}, 0
    for pattern, times, length in planned:
        place = 0
        for size, k in sorted(pattern.items(), reverse=True):
            lo = used.get(size, 0)
            used[size] = lo + k * times
            rows.append((size, lo, lo + k * times, k, first, place, length))
            place += k * size
        first += times
    return rows


def pack(items: DataFrame, key: str = "doc_id", length: str = "n_tokens", capacity: int = 2048, permitted: tuple[int, ...] = (256, 512, 1024, 2048)) -> DataFrame:
    """(key, part_no, n_tokens, container_id, start, container_tokens): the place of every item.

    An item of at most ``capacity`` is whole in one container. A longer one is cut into parts of the whole capacity, each in a
    container of its own, and a rest that is packed like an item. Items of no or null length take no room: their container_id
    is null. Rows that repeat a key are items of their own. Ties of length are placed in the order of the key.
    An empty table gives an empty one. container_tokens is the least permitted length that holds the container's contents.
    """
    spark = items.sparkSession
    rows = items.select(F.col(key).alias("_key"), F.greatest(F.coalesce(F.col(length), F.lit(0)), F.lit(0)).cast("long").alias("_n"))
    full = F.floor(F.col("_n") / capacity).cast("int")
    part = F.explode(F.when(F.col("_n") <= capacity, F.array(F.struct(F.lit(0).alias("p"), F.col("_n").alias("n")))).otherwise(
        F.filter(F.transform(F.sequence(F.lit(0), full), lambda p: F.struct(p.alias("p"), F.when(p < full, F.lit(capacity).cast("long")).otherwise(F.col("_n") % capacity).alias("n"))), lambda x: x["n"] > 0)))
    parts = rows.select("_key", part.alias("_x")).select("_key", F.col("_x.p").alias("_part"), F.col("_x.n").alias("_size"))
    parts = cut_lineage(parts)
    # At most ``capacity`` rows, whatever the number of items.
    histogram = {r["_size"]: r["n"] for r in parts.where("_size > 0").groupBy("_size").agg(F.count("*").alias("n")).collect()}
    salts = max(1, max(histogram.values(), default=0) // RANKED + 1)
    table = spark.createDataFrame(slots(plan(histogram, capacity, list(permitted))), "_size long, _lo long, _hi long, _k long, _first long, _place long, _length long")
    salted = parts.where("_size > 0").withColumn("_salt", F.pmod(F.xxhash64("_key", "_part"), F.lit(salts)))
    before = Window.partitionBy("_size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("_size", "_salt").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    ranked = salted.withColumn("_r", F.row_number().over(Window.partitionBy("_size", "_salt").orderBy("_key", "_part")) - 1)
    ranked = ranked.join(offsets, ["_size", "_salt"]).withColumn("_rank", F.col("_r") + F.col("_before"))
    # The slots depend on the lengths alone (some for each of at most ``capacity`` lengths), not on the number of items.
    at = F.col("_rank") - F.col("_lo")
    placed = ranked.join(F.broadcast(table), "_size").where((F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    placed = placed.select("_key", "_part", "_size", (F.col("_first") + F.floor(at / F.col("_k"))).cast("long").alias("container_id"), (F.col("_place") + at % F.col("_k") * F.col("_size")).alias("start"), F.col("_length").alias("container_tokens"))
    none = F.lit(None).cast("long")
    empty = parts.where("_size = 0").select("_key", "_part", "_size", none.alias("container_id"), none.alias("start"), none.alias("container_tokens"))
    return placed.unionByName(empty).select(F.col("_key").alias(key), F.col("_part").alias("part_no"), F.col("_size").alias("n_tokens"), "container_id", "start", "container_tokens")
