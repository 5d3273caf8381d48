import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import neighbours

SCHEMA = "vec_no long, model string, vector array<float>, error string, created_at timestamp, vec_a string, s int"
T = [dt.datetime(2024, 1, i) for i in range(1, 5)]


def brute(x, ids, k):
    out = set()
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    for i in range(len(ids)):
        for j in sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:k]:
            if i != j:
                out.add((ids[i], ids[j]))
    return out


@pytest.mark.parametrize("stripe", [16, 1000])
def test_equals_brute_force_over_tiles(spark, stripe):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(6, 12))
    x = (centre[rng.integers(0, 6, 90)] + 0.2 * rng.normal(size=(90, 12))).astype("f4") * rng.uniform(0.5, 3, (90, 1)).astype("f4")
    df = spark.createDataFrame([(i, "m", r.tolist()) for i, r in enumerate(x)], "vec_no long, model string, vector array<float>")
    got = {(r["vec_no"], r["neighbour"]) for r in neighbours.nearest(df, 5, stripe).collect()}
    assert got == brute(x, list(range(90)), 5)


def test_copies_and_near_copies(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(160, 10)).astype("f4")
    x[:50] = x[0]  # a hot group of copies
    x[50:53] = x[60]
    x[100:130] = x[100] + 1e-6 * rng.normal(size=(30, 10)).astype("f4")  # closer than the codes can tell
    ids = rng.permutation(160).tolist()
    df = spark.createDataFrame([(i, "m", r.tolist()) for i, r in zip(ids, x)], "vec_no long, model string, vector array<float>").withColumn("extra", F.lit(1))
    near = {(r["vec_no"], r["rank"]): r["distance"] for r in neighbours.nearest(df, 5, 50).collect()}
    assert len(near) == 800
    u = x.astype("f8") / np.linalg.norm(x.astype("f8"), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(ids[i], r + 1): d for i in range(160) for r, d in enumerate(np.sort(1 - s[i])[:5])}
    assert all(abs(near[k] - d) < 1e-12 for k, d in want.items())
    got = {(r["vec_no"], r["neighbour"]) for r in neighbours.nearest(df, 5, 50).collect()}
    assert {tuple(r) for r in neighbours.pairs(df, 5, 50).collect()} == {(min(p), max(p)) for p in got}
    copies = sorted(ids[:50])
    assert all((i, j) in got for i in ids[:50] for j in [c for c in copies if c != i][:5])


def test_codes_and_their_bounds():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 96))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = neighbours.quantised(np.arange(200), x)
    assert c.code.dtype == np.int8 == c.fine.dtype and c.rest.max() < 5e-3 * c.error.max()
    first = c.code.astype("f8") * c.scale[:, None]
    assert (np.linalg.norm(x - first, axis=1) <= c.error + 1e-6).all() and (np.linalg.norm(x - c.near(np.arange(200)), axis=1) <= c.rest + 1e-6).all()


def test_unusable_versions_and_models(spark):
    nan = float("nan")
    rows = [
        (1, "m", [1.0, 0.0], None, T[0], "x", 1), (1, "m", [0.0, 1.0], None, T[2], "x", 1), (2, "m", [0.0, 2.0], None, T[0], None, 2), (2, "m", [0.0, 2.0], None, T[0], None, 2),
        (3, "m", [0.0, 0.0], None, T[0], None, 3), (4, "m", [nan, 1.0], None, T[0], None, 3), (5, "m", [], None, T[0], None, 3), (6, "m", None, "timeout", T[0], None, 3),
        (7, "m", [1.0, 1.0], "late", T[0], None, 3), (8, "other", [1.0, 1.0], None, None, None, 3), (None, "m", [1.0, 1.0], None, T[0], None, 3), (9, "m", [1.0, 1.0], None, T[0], None, 1), (9, "m", None, None, T[3], None, 1),
        (10, None, [1.0, 2.0], None, T[0], None, 1), (11, None, [2.0, 1.0], None, T[0], None, 1),
    ]
    use = neighbours.usable(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r["vec_no"] for r in use.collect()) == [1, 2, 8, 10, 11]
    pairs = {tuple(r) for r in neighbours.pairs(use).collect()}
    assert pairs == {(1, 2), (10, 11)}
    assert {r["vec_no"]: r["distance"] for r in neighbours.nearest(use).collect()}[1] == pytest.approx(0, abs=1e-9)


def test_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(i, "m", [1.0, 1.0]) for i in range(6)], "vec_no long, model string, vector array<float>")
    got = {(r["vec_no"], r["neighbour"]) for r in neighbours.nearest(df, 2).collect()}
    assert got == {(i, j) for i in range(6) for j in [x for x in range(6) if x != i][:2]}


def test_empty(spark):
    assert neighbours.pairs(neighbours.usable(spark.createDataFrame([], SCHEMA))).count() == 0


def test_alike_vectors_are_only_compared_within_reach(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(60, 48))
    x = np.concatenate([np.repeat(centre, 14, axis=0) + 0.2 * rng.normal(size=(840, 48)), rng.normal(size=(20, 48))]).astype("f4")
    ids = rng.permutation(len(x)).tolist()
    df = spark.createDataFrame([(i, "m", r.tolist()) for i, r in zip(ids, x)], "vec_no long, model string, vector array<float>")
    unit = df.select("vec_no", "model", F.size("vector").alias("dims"), "vector")
    sizes = unit.groupBy("model", "dims").agg(F.count("*").alias("n"))
    groups = neighbours.groups(unit, neighbours.leaders(unit, sizes), 5).cache()
    open_ = groups.where("reach IS NULL").agg(F.sum("n")).first()[0]
    # Only what is alike nothing, and a few that the cells missed, are compared with all.
    assert groups.agg(F.sum("n")).first()[0] == len(x) and 20 <= open_ < 60
    assert neighbours.touching(groups).count() < 60
    got = {(r["vec_no"], r["neighbour"]) for r in neighbours.nearest(df, 5).collect()}
    assert got == brute(x, ids, 5)
    assert {tuple(r) for r in neighbours.pairs(df, 5).collect()} == {(min(p), max(p)) for p in got}
