"""The most similar vectors of every vector, exactly, by groups of alike vectors and a block join of the rest.

Vectors of one model that are alike meet in cells, named by the random directions they are nearest to, and follow the smallest number there: these are groups. A group has a
centre and a radius, so the angle between two centres bounds all similarities between two groups. Of a group in which every vector has k others
near enough (a closed one), only groups that the bound cannot rule out are looked at; its distances come from the float vectors. How well the cells
do decides how much is ruled out, never what is found.
All other vectors are compared with all: those of them in a stripe meet a stripe of all vectors in a tile. What travels to the tiles are int8
codes: a first code of each number and a second one of what the first leaves out. Products of the first codes give all similarities with a
bound of their quantisation error; what the bound cannot rule out of the k best is recomputed from both codes, with a far smaller bound,
and goes into heaps that are merged over tiles. What is left is recomputed from the float vectors, which are joined to the surviving pairs alone.
Exact copies of a vector are one vector with several numbers until the end, so no group of copies makes pairs of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.session import cut_lineage, parallelism

#: Vectors without a closed group in a stripe, and numbers of the vectors in a stripe of all.
STRIPE, ALL = 16_384, 1 << 24
#: Vectors of a cell on average before each goes to PROBES cells, and the most cells of a model.
CELL, PROBES, CELLS = 300, 4, 4096
#: Vectors follow one that is so similar; candidates of a cell that others may follow; vectors of a group, of which a task holds all products.
ALIKE, LEADERS, GROUP = 0.8, 8192, 2048
#: Angles: a closed group reaches at most so far from its centre, and an open one that is wider is taken apart. What rounding may add to angles, near zero most of all.
REACH, WIDTH, SLACK = 1.1, 0.6, 5e-3
#: Groups in a stripe of centres.
CENTRES = 8192
#: So many rows of group numbers are broadcast at most; more go through a shuffle.
FEW = 100_000
#: Rows of a block of products, of STEP x STEP x 4 bytes.
STEP = 2048
#: Products of a block that give a vector its first bound.
WARM = 512
#: Parts of a group of copies whose smallest numbers are found apart.
SALTS = 256


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_no, model, vector): of each vec_no the row created last, if it has no error and a vector that is not null, not empty, not all zero and free of NaN.

    Null created_at counts as the oldest. Rows equal in vec_no and created_at: one without error, then the larger vector, counts.
    """
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    ok = F.col("error").isNull() & v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)
    flagged = vectors.where(F.col("vec_no").isNotNull()).select("vec_no", "model", "created_at", F.coalesce(ok, F.lit(False)).alias("_ok"), v.alias("vector"))
    last = flagged.groupBy("vec_no").agg(F.max_by(F.struct("model", "_ok", "vector"), F.struct(F.col("created_at").isNotNull(), "created_at", "_ok", "vector")).alias("x"))
    return last.where("x._ok").select("vec_no", F.col("x.model").alias("model"), F.col("x.vector").alias("vector"))


@dataclass
class Codes:
    """Unit vectors as x = (code + fine / 254) * scale, but for a rest; error is the norm of what the first codes leave out, rest that of what both do."""

    ids: np.ndarray
    code: np.ndarray
    fine: np.ndarray
    scale: np.ndarray
    error: np.ndarray
    rest: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)

    def near(self, rows: np.ndarray) -> np.ndarray:
        """The vectors as both codes tell them."""
        return (self.code[rows].astype("f4") + self.fine[rows].astype("f4") / np.float32(254)) * self.scale[rows, None]


def quantised(ids: np.ndarray, x: np.ndarray) -> Codes:
    """The codes of unit vectors."""
    scale = (np.abs(x).max(axis=1) / 127).astype("f4")
    code = np.clip(np.rint(x / scale[:, None]), -127, 127)
    left = x - code * scale[:, None].astype("f8")
    fine = np.clip(np.rint(left * 254 / scale[:, None]), -127, 127)
    last = left - fine / 254 * scale[:, None].astype("f8")
    return Codes(ids, code.astype(np.int8), fine.astype(np.int8), scale, np.linalg.norm(left, axis=1).astype("f4"), (np.linalg.norm(last, axis=1) + 1e-7).astype("f4"))


def _first(rows: np.ndarray, k: int) -> np.ndarray:
    """Which of the sorted rows are among the first k of their row."""
    start = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    return np.arange(len(rows)) - np.repeat(start, np.diff(np.r_[start, len(rows)])) < k


class _Side:
    """The candidates of a tile for each of its own vectors, with the k best lower bounds of each so far."""

    def __init__(self, own: Codes, other_error: float, k: int):
        self.own, self.k = own, k
        # |a.b - qa.qb| <= |ea| |b| + |qa| |eb| with |b| = 1 and |qa| <= 1 + |ea|; rounding of float32 is far below the slack.
        self.bound = (own.error + (1 + own.error) * other_error + 1e-5).astype("f4")
        self.top = np.full((len(own), k), -9, "f4")
        self.least = np.full(len(own), -9, "f4")  # a product below this cannot be among the k best
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.many = 0

    def offer(self, r: np.ndarray, c: np.ndarray, v: np.ndarray) -> None:
        """Products v of own vectors r with the other side's vectors c."""
        on = v >= self.least[r]
        r, c, v = r[on], c[on], v[on]
        self.kept.append((r, c, v))
        self.many += len(r)
        better = v - self.bound[r] > self.top[r, 0]
        if better.any():
            rows = np.unique(r[better])
            allr = np.concatenate([r[better], np.repeat(rows, self.k)])
            allv = np.concatenate([v[better] - self.bound[r[better]], self.top[rows].ravel()])
            order = np.lexsort((-allv, allr))
            allr, allv = allr[order], allv[order]
            first = _first(allr, self.k)
            self.top[rows] = allv[first].reshape(-1, self.k)[:, ::-1]
            self.least[rows] = self.top[rows, 0] - self.bound[rows]
        if self.many > 4_000_000:
            self._prune()

    def _prune(self) -> None:
        r, c, v = map(np.concatenate, zip(*self.kept))
        on = v >= self.least[r]
        self.kept, self.many = [(r[on], c[on], v[on])], int(on.sum())

    def best(self, other: Codes) -> pd.DataFrame:
        """(vec_no, neighbour, similarity, error): of the survivors recomputed from both codes those that may be among the k best, all whose bounds overlap."""
        if not self.kept:
            return pd.DataFrame({"vec_no": np.zeros(0, "i8"), "neighbour": np.zeros(0, "i8"), "similarity": np.zeros(0), "error": np.zeros(0)})
        self._prune()
        r, c, _ = self.kept[0]
        near = np.empty(len(r), "f4")
        for p in range(0, len(r), 65_536):
            q = slice(p, p + 65_536)
            near[q] = np.einsum("ij,ij->i", self.own.near(r[q]), other.near(c[q]))
        error = self.own.rest[r] + (1 + self.own.rest[r]) * other.rest[c] + np.float32(2e-6)
        order = np.lexsort((-(near - error), r))
        first = _first(r[order], self.k)
        kth, many = np.full(len(self.own), 9, "f4"), np.zeros(len(self.own), np.int64)
        np.minimum.at(kth, r[order][first], (near - error)[order][first])
        np.add.at(many, r[order][first], 1)
        on = near + error >= np.where(many == self.k, kth, -9)[r]
        return pd.DataFrame({"vec_no": self.own.ids[r[on]], "neighbour": other.ids[c[on]], "similarity": near[on].astype("f8"), "error": error[on].astype("f8")})


def tile(a: Codes, b: Codes, k: int) -> pd.DataFrame:
    """What the vectors of a may have among their k most similar of b; a number is no neighbour of itself."""
    side = _Side(a, float(b.error.max()), k)
    order = np.argsort(b.ids)
    at = order[np.minimum(np.searchsorted(b.ids, a.ids, sorter=order), len(b) - 1)]
    self_ = np.where(b.ids[at] == a.ids, at, -1)
    # The codes are whole numbers, and so are their products: at most 127 * 127 * dimensions, which float32 holds exactly below 2 ** 24. BLAS has no faster product of int8.
    fa = a.code.astype("f4")
    for lo2 in range(0, len(b), STEP):
        fb = b.code[lo2 : lo2 + STEP].astype("f4").T
        for lo in range(0, len(a), STEP):
            rows = slice(lo, lo + STEP)
            s = fa[rows] @ fb
            s *= b.scale[None, lo2 : lo2 + STEP]
            scale = a.scale[rows]
            own = np.flatnonzero((self_[rows] >= lo2) & (self_[rows] < lo2 + STEP))
            s[own, self_[rows][own] - lo2] = -np.float32(1e30)
            if side.least[rows].min() < -8:
                # No bounds yet: the k best of some products of each row give first ones.
                part = s[:, :WARM]
                n = min(k, part.shape[1])
                top = np.argpartition(part, part.shape[1] - n, axis=1)[:, -n:].ravel()
                r = np.repeat(np.arange(part.shape[0]), n)
                _warm(side, lo + r, part[r, top] * scale[r])
            # Rounding of the quotient is below the slack of the bounds.
            hit = np.flatnonzero(s >= np.maximum(side.least[rows] / scale, -np.float32(1e29))[:, None])
            r, c = np.divmod(hit, s.shape[1])
            side.offer(lo + r, lo2 + c, s.ravel()[hit] * scale[r])
    return side.best(b)


def _warm(side: _Side, r: np.ndarray, v: np.ndarray) -> None:
    """Lower bounds only: the products are offered again when they are kept."""
    rows = np.unique(r)
    rows = rows[side.least[rows] < -8]
    if not len(rows):
        return
    on = np.isin(r, rows) & (v > -5)
    allr = np.concatenate([r[on], np.repeat(rows, side.k)])
    allv = np.concatenate([v[on] - side.bound[r[on]], np.full(len(rows) * side.k, -9, "f4")])
    order = np.lexsort((-allv, allr))
    allr, allv = allr[order], allv[order]
    # One bound less than the k-th, so that the product that gave it passes again.
    low = allv[_first(allr, side.k)].reshape(-1, side.k)[:, -1]
    side.least[rows] = np.maximum(side.least[rows], low - side.bound[rows])


def _with_counts(df: DataFrame, counts: DataFrame) -> DataFrame:
    """df with the columns of counts, a row for each model and dims, null models too."""
    m = counts.withColumnsRenamed({"model": "_m", "dims": "_d"})
    return df.join(F.broadcast(m), F.col("model").eqNullSafe(F.col("_m")) & (F.col("dims") == F.col("_d"))).drop("_m", "_d")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype("f8")
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of each row of x and that of y, the same in either order."""
    x, y = x.astype("f8"), y.astype("f8")
    x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def leaders(unit: DataFrame, sizes: DataFrame) -> DataFrame:
    """(vec_no, leader) for each row of (vec_no, model, dims, vector): the smallest number it was led to by vectors like it, itself if there are none."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        directions: dict[int, np.ndarray] = {}
        for b in batches:
            for (model, dims, n), g in b.groupby(["model", "dims", "n"], dropna=False):
                if dims not in directions:
                    d = np.random.default_rng(int(dims)).normal(size=(CELLS, int(dims))).astype("f4")
                    directions[dims] = d / np.linalg.norm(d, axis=1, keepdims=True)
                cells = int(np.clip(-(-n // CELL), 1, CELLS))
                for p in range(0, len(g), STEP):
                    own = g.iloc[p : p + STEP]
                    u = _unit(np.stack(own["vector"].to_numpy()))
                    c = quantised(own["vec_no"].to_numpy("<i8"), u)
                    s = u.astype("f4") @ directions[dims][:cells].T
                    code = [x.tobytes() for x in c.code]
                    for _ in range(min(PROBES, cells)):
                        cell = s.argmax(axis=1)
                        s[np.arange(len(s)), cell] = -9
                        yield pd.DataFrame({"model": own["model"].to_numpy(), "dims": dims, "cell": cell.astype("i4"), "vec_no": c.ids, "code": code, "scale": c.scale})

    def follow(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("vec_no")
        ids = g["vec_no"].to_numpy()
        f = np.frombuffer(b"".join(g["code"]), np.int8).reshape(len(g), -1) * g["scale"].to_numpy("f4")[:, None]
        led, rest = ids.copy(), np.arange(len(g))
        for lo in range(0, min(len(g), LEADERS), WARM):
            rest = rest[rest >= lo]
            hit = f[rest] @ f[lo : lo + WARM].T >= ALIKE
            any_ = hit.any(axis=1)
            led[rest[any_]] = ids[lo + hit[any_].argmax(axis=1)]
            rest = rest[~any_]
        return pd.DataFrame({"vec_no": ids, "leader": np.minimum(led, ids)})

    placed = _with_counts(unit, sizes).mapInPandas(place, "model string, dims int, cell int, vec_no long, code binary, scale float")
    first = cut_lineage(placed.groupBy("model", "dims", "cell").applyInPandas(follow, "vec_no long, leader long").groupBy("vec_no").agg(F.min("leader").alias("leader")))
    # Those that missed the leader of the others in their cells are brought to it by the one they follow.
    on = first.select(F.col("leader").alias("next"), F.col("vec_no").alias("leader"))
    second = first.join(on, "leader").select("vec_no", F.col("next").alias("leader"))
    return second.join(on, "leader").select("vec_no", F.col("next").alias("leader"))


def groups(unit: DataFrame, led: DataFrame, k: int) -> DataFrame:
    """Of each group (model, dims, gid, n, centre, radius, reach, ids, x, near, sims): the angle from its centre within which its vectors are; reach, null if it is not closed, the
    angle from it within which all are that may be among the k nearest of its vectors; the k nearest within a closed group, of each of its vectors."""
    many = led.groupBy("leader").agg(F.count("*").alias("m")).where(F.col("m") > GROUP)
    parted = led.join(many, "leader", "left").select("vec_no", "leader", F.coalesce(F.pmod(F.xxhash64("vec_no"), F.ceil(2 * F.col("m") / GROUP)), F.lit(0)).cast("int").alias("part"))

    def one(model, dims: int, ids: np.ndarray, x: np.ndarray) -> Iterator[tuple]:
        u = _unit(x)
        if len(ids) == 1:
            yield model, dims, int(ids[0]), 1, u.astype("<f4").tobytes(), SLACK, None, ids.tobytes(), x.tobytes(), None, None
            return
        c = u.mean(axis=0)
        c = c / np.linalg.norm(c) if np.linalg.norm(c) > 1e-6 else u[0]
        angle = np.arccos(np.clip(u @ c, -1, 1))
        radius, closed = float(angle.max()) + SLACK, False
        if len(ids) > k:
            s = u @ u.T
            np.fill_diagonal(s, -9)
            kth = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k]
            reach = float((angle + np.arccos(np.clip(kth - 1e-9, -1, 1))).max()) + SLACK
            closed = reach <= REACH
        if closed:
            r, q = np.nonzero(s >= (kth - 1e-12)[:, None])
            v = _cosines(x[r], x[q])
            order = np.lexsort((ids[q], -v, r))
            order = order[_first(r[order], k)]
            yield model, dims, int(ids.min()), len(ids), c.astype("<f4").tobytes(), radius, reach, ids.tobytes(), x.tobytes(), ids[q[order]].tobytes(), v[order].tobytes()
        elif radius > WIDTH:
            for i in range(len(ids)):
                yield from one(model, dims, ids[i : i + 1], x[i : i + 1])
        else:
            yield model, dims, int(ids.min()), len(ids), c.astype("<f4").tobytes(), radius, None, ids.tobytes(), x.tobytes(), None, None

    names = ["model", "dims", "gid", "n", "centre", "radius", "reach", "ids", "x", "near", "sims"]

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The rows come in the order of their groups; the last group of a batch may go on in the next."""
        held: list[pd.DataFrame] = []

        def whole(b: pd.DataFrame) -> pd.DataFrame:
            ids, model, dims, vectors = b["vec_no"].to_numpy("<i8"), b["model"].tolist(), b["dims"].tolist(), b["vector"].to_numpy()
            key = b[["leader", "part"]].to_numpy()
            start = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(b)]
            rows = [row for p, q in zip(start[:-1], start[1:]) for row in one(model[p] if isinstance(model[p], str) else None, dims[p], ids[p:q], np.stack(vectors[p:q]).astype("<f4"))]
            return pd.DataFrame({c: pd.Series(x, dtype=object) for c, x in zip(names, zip(*rows))})

        for b in batches:
            if not len(b):
                continue
            key = b[["leader", "part"]].to_numpy()
            other = np.flatnonzero((key != key[-1]).any(axis=1))
            if held and (held[0][["leader", "part"]].to_numpy()[-1] != key[0]).any():
                yield whole(pd.concat(held))
                held = []
            if len(other):
                yield whole(pd.concat([*held, b.iloc[: other[-1] + 1]]))
                held = []
            held.append(b.iloc[other[-1] + 1 if len(other) else 0 :])
        if held:
            yield whole(pd.concat(held))

    sorted_ = unit.join(parted, "vec_no").select("vec_no", "model", "dims", "vector", "leader", "part").repartition("leader", "part").sortWithinPartitions("leader", "part")
    return sorted_.mapInPandas(gather, "model string, dims int, gid long, n int, centre binary, radius double, reach double, ids binary, x binary, near binary, sims binary")


def touching(groups_: DataFrame) -> DataFrame:
    """(a, b): to each closed group a the other groups b of which one may be among the k nearest of its vectors."""
    counts = groups_.groupBy("model", "dims").agg(F.ceil(F.count("reach") / CENTRES).cast("int").alias("i"), F.ceil(F.count("*") / CENTRES).cast("int").alias("j")).where("i > 0")
    all_ = _with_counts(groups_.select("model", "dims", "gid", "centre", "radius", "reach"), counts)
    h = F.xxhash64("gid")
    closed = all_.where("reach IS NOT NULL").withColumn("p", F.pmod(h, F.col("i")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("j") - 1))).withColumn("own", F.lit(True))
    others = all_.withColumn("q", F.pmod(h, F.col("j")).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("i") - 1))).withColumn("own", F.lit(False))

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        found = []
        a, b = g[g["own"]], g[~g["own"]].sort_values("radius")
        if len(a) and len(b):
            dims = int(g["dims"].iloc[0])
            ca, cb = (np.frombuffer(b"".join(x["centre"]), "<f4").reshape(-1, dims) for x in (a, b))
            ga, gb, reach, radius = a["gid"].to_numpy(), b["gid"].to_numpy(), a["reach"].to_numpy(), b["radius"].to_numpy()
            for lo in range(0, len(a), STEP):
                for lo2 in range(0, len(b), STEP):
                    s = ca[lo : lo + STEP] @ cb[lo2 : lo2 + STEP].T
                    least = np.cos(np.minimum(reach[lo : lo + STEP] + radius[lo2 : lo2 + STEP][-1], np.pi)).astype("f4") - np.float32(1e-5)
                    r, c = np.divmod(np.flatnonzero(s >= least[:, None]), s.shape[1])
                    on = (np.arccos(np.clip(s[r, c], -1, 1)) <= reach[lo + r] + radius[lo2 + c]) & (ga[lo + r] != gb[lo2 + c])
                    found.append((ga[lo + r[on]], gb[lo2 + c[on]]))
        one, two = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, "i8"), np.zeros(0, "i8"))
        return pd.DataFrame({"a": one, "b": two})

    columns = ["model", "dims", "p", "q", "own", "gid", "centre", "radius", "reach"]
    return closed.select(columns).unionByName(others.select(columns)).groupBy("model", "dims", "p", "q").applyInPandas(meet, "a long, b long")


def candidates(open_: DataFrame, unit: DataFrame, sizes: DataFrame, k: int, stripe: int) -> DataFrame:
    """(model, vec_no, neighbour) for each row of open_ (vec_no, model, dims, vector): all of unit that may be among its k most similar."""
    n, cores = F.col("n"), 2 * parallelism(unit.sparkSession)
    many = open_.groupBy("model", "dims").agg(F.ceil(F.count("*") / stripe).cast("int").alias("i"))
    # Stripes for two tiles a core, but none of less than a block.
    wide = F.greatest(F.lit(STEP), F.least(F.lit(8 * stripe), (F.lit(ALL) / F.col("dims")).cast("int")))
    counts = _with_counts(many, sizes).select("model", "dims", "i", F.greatest(F.ceil(n / wide), F.least(F.ceil(F.lit(cores) / F.col("i")), F.ceil(n / STEP))).cast("int").alias("j"))
    names = ["model", "dims", "i", "j", "s", "ids", "code", "fine", "numbers"]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for (model, dims, i, j, s), g in b.groupby(["model", "dims", "i", "j", "s"], dropna=False):
                c = quantised(g["vec_no"].to_numpy("<i8"), _unit(np.stack(g["vector"].to_numpy())))
                rows.append((model if isinstance(model, str) else None, dims, i, j, s, c.ids.tobytes(), c.code.tobytes(), c.fine.tobytes(), np.stack([c.scale, c.error, c.rest], axis=1).astype("<f4").tobytes()))
            yield pd.DataFrame(rows, columns=names)

    def packed(df: DataFrame, by: str, other: str) -> DataFrame:
        rows = _with_counts(df, counts).withColumn("s", F.pmod(F.xxhash64("vec_no"), F.col(by)).cast("int")).select("model", "dims", "i", "j", "s", "vec_no", "vector")
        blocks = rows.mapInPandas(pack, "model string, dims int, i int, j int, s int, ids binary, code binary, fine binary, numbers binary")
        each = blocks.withColumn("t", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        p, q = ("s", "t") if by == "i" else ("t", "s")
        return each.select("model", "dims", F.col(p).alias("p"), F.col(q).alias("q"), F.lit(by == "i").alias("own"), "ids", "code", "fine", "numbers")

    def codes(g: pd.DataFrame, dims: int) -> Codes:
        numbers = np.frombuffer(b"".join(g["numbers"]), "<f4").reshape(-1, 3)
        return Codes(np.frombuffer(b"".join(g["ids"]), "<i8"), np.frombuffer(b"".join(g["code"]), np.int8).reshape(-1, dims), np.frombuffer(b"".join(g["fine"]), np.int8).reshape(-1, dims), *(numbers[:, q].copy() for q in range(3)))

    def meet(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        model, dims, _, _ = key
        a, b = codes(g[g["own"]], dims), codes(g[~g["own"]], dims)
        found = tile(a, b, k) if len(a) and len(b) else pd.DataFrame({"vec_no": [], "neighbour": [], "similarity": [], "error": []})
        found.insert(0, "model", pd.Series([model if isinstance(model, str) else None] * len(found), dtype=object, index=found.index))
        return found

    tiles = packed(open_, "i", "j").unionByName(packed(unit, "j", "i"))
    local = tiles.groupBy("model", "dims", "p", "q").applyInPandas(meet, "model string, vec_no long, neighbour long, similarity double, error double")
    # The heaps of a vector's tiles, of about k each, are merged: the k-th lower bound rules out what is below it.
    low = F.sort_array(F.collect_list(F.col("error") - F.col("similarity")))
    all_ = local.groupBy("model", "vec_no").agg(F.collect_list(F.struct("neighbour", "similarity", "error")).alias("h"), F.get(low, F.lit(k - 1)).alias("low"))
    return all_.select("model", "vec_no", F.explode("h").alias("x"), "low").where(F.col("low").isNull() | (-F.col("x.similarity") - F.col("x.error") <= F.col("low"))).select("model", "vec_no", "x.neighbour")


_NEAR = "model string, vec_no long, neighbour long, similarity double"


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The k nearest within each closed group as rows."""
    for b in batches:
        for model, n, ids, near, sims in zip(b["model"], b["n"], b["ids"], b["near"], b["sims"]):
            found = np.frombuffer(near, "<i8")
            yield pd.DataFrame({"model": pd.Series([model] * len(found), dtype=object), "vec_no": np.repeat(np.frombuffer(ids, "<i8"), len(found) // n), "neighbour": found, "similarity": np.frombuffer(sims, "<f8")})


def _across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What the vectors of a closed group have in another that is not farther than their k nearest so far."""
    for b in batches:
        for model, dims, ids, x, sims, ids2, x2 in zip(b["model"], b["dims"], b["ids"], b["x"], b["sims"], b["ids2"], b["x2"]):
            one, two = np.frombuffer(ids, "<i8"), np.frombuffer(ids2, "<i8")
            p, q = (np.frombuffer(y, "<f4").reshape(-1, dims) for y in (x, x2))
            kth = np.frombuffer(sims, "<f8").reshape(len(one), -1)[:, -1]
            r, c = np.nonzero(_unit(p) @ _unit(q).T >= (kth - 1e-12)[:, None])
            if len(r):
                yield pd.DataFrame({"model": pd.Series([model] * len(r), dtype=object), "vec_no": one[r], "neighbour": two[c], "similarity": _cosines(p[r], q[c])})


def _opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for model, dims, ids, x in zip(b["model"], b["dims"], b["ids"], b["x"]):
            own = np.frombuffer(ids, "<i8")
            yield pd.DataFrame({"model": pd.Series([model] * len(own), dtype=object), "dims": np.int32(dims), "vec_no": own, "vector": list(np.frombuffer(x, "<f4").reshape(-1, dims))})


def _best(near: DataFrame, k: int) -> DataFrame:
    """The k most similar of each vec_no, ties to the smaller number."""
    heap = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("n"), "neighbour"))), 1, k)
    return near.groupBy("model", "vec_no").agg(heap.alias("h")).select("model", "vec_no", F.explode("h").alias("x")).select("model", "vec_no", "x.neighbour", (-F.col("x.n")).alias("similarity"))


def nearest_of_each(vectors: DataFrame, k: int, stripe: int = STRIPE) -> DataFrame:
    """(model, vec_no, neighbour, similarity): the k most similar for each row of (vec_no, model, vector), in which no two of a model are copies."""
    unit = vectors.select("vec_no", "model", F.size("vector").alias("dims"), "vector")
    sizes = unit.groupBy("model", "dims").agg(F.count("*").alias("n"))
    all_ = cut_lineage(groups(unit, leaders(unit, sizes), k))
    pairs_ = cut_lineage(touching(all_))
    few = pairs_.count() <= FEW  # which join, not what is joined
    hint = F.broadcast if few else lambda x: x
    closed = all_.where("reach IS NOT NULL")
    touched = hint(pairs_.select(F.col("a").alias("gid")).distinct())
    settled = closed.join(touched, "gid", "left_anti").select("model", "n", "ids", "near", "sims").mapInPandas(_listed, _NEAR)
    inside = closed.join(touched, "gid", "left_semi").select("model", "n", "ids", "near", "sims").mapInPandas(_listed, _NEAR)
    with_a = closed.select(F.col("gid").alias("a"), "model", "dims", "ids", "x", "sims").join(hint(pairs_), "a")
    second = all_.join(hint(pairs_.select(F.col("b").alias("gid")).distinct()), "gid", "left_semi").select(F.col("gid").alias("b"), F.col("ids").alias("ids2"), F.col("x").alias("x2"))
    across = with_a.join(second, "b").select("model", "dims", "ids", "x", "sims", "ids2", "x2").mapInPandas(_across, _NEAR)
    open_ = all_.where("reach IS NULL").select("model", "dims", "ids", "x").mapInPandas(_opened, "model string, dims int, vec_no long, vector array<float>")
    survived = cut_lineage(candidates(open_, unit, sizes, k, stripe))
    measured = exact(survived, vectors).join(survived, ["vec_no", "neighbour"]).select("model", "vec_no", "neighbour", "similarity")
    return settled.unionByName(_best(inside.unionByName(across).unionByName(measured), k))


def exact(pairs_: DataFrame, vectors: DataFrame) -> DataFrame:
    """(vec_no, neighbour, similarity) of the pairs in both directions, the cosine in double precision of the float vectors (vec_no, vector)."""
    once = pairs_.select(F.least("vec_no", "neighbour").alias("a"), F.greatest("vec_no", "neighbour").alias("b")).distinct()
    with_a = once.join(vectors.select(F.col("vec_no").alias("a"), F.col("vector").alias("x")), "a")
    both = with_a.join(vectors.select(F.col("vec_no").alias("b"), F.col("vector").alias("y")), "b")

    def cosine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            out = np.zeros(len(g))
            lengths = g["x"].map(len).to_numpy() if len(g) else np.zeros(0, int)
            for n in np.unique(lengths):
                on = np.flatnonzero(lengths == n)
                out[on] = _cosines(*(np.stack(g[c].to_numpy()[on]) for c in ("x", "y")))
            yield pd.DataFrame({"a": g["a"], "b": g["b"], "similarity": out})

    measured = both.select("a", "b", "x", "y").mapInPandas(cosine, "a long, b long, similarity double")
    return measured.select(F.explode(F.array(F.struct(F.col("a").alias("vec_no"), F.col("b").alias("neighbour"), "similarity"), F.struct(F.col("b").alias("vec_no"), F.col("a").alias("neighbour"), "similarity"))).alias("x")).select("x.*")


def grouped(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vectors without copies, under their least vec_no; (rep, members): of each vector with copies the k + 1 least vec_no; (vec_no, rep) of the copies and their vector).

    Copies have equal numbers and one model; they are told by two hashes. The least numbers of a group are found in SALTS parts first.
    """
    hashed = vectors.select("vec_no", "model", "vector", F.xxhash64("model", "vector").alias("h"), F.xxhash64(F.lit(7), "vector", "model").alias("h2"))
    salted = hashed.groupBy("h", "h2", F.pmod(F.xxhash64("vec_no"), F.lit(SALTS)).alias("salt")).agg(F.slice(F.array_sort(F.collect_list("vec_no")), 1, k + 1).alias("m"))
    groups = salted.groupBy("h", "h2").agg(F.slice(F.array_sort(F.flatten(F.collect_list("m"))), 1, k + 1).alias("members")).where(F.size("members") > 1)
    groups = cut_lineage(groups.withColumn("rep", F.get("members", F.lit(0))))
    marked = hashed.join(groups.select("h", "h2", "rep"), ["h", "h2"], "left")
    alone = marked.where(F.col("rep").isNull() | (F.col("rep") == F.col("vec_no"))).select("vec_no", "model", "vector")
    return alone, groups.select("rep", "members"), marked.where("rep IS NOT NULL").select("vec_no", "rep", "model")


def expanded(near: DataFrame, copies: DataFrame, of: DataFrame, k: int) -> DataFrame:
    """(model, vec_no, neighbour, similarity) of the k nearest, ties to the smaller vec_no, from those (near) of vectors without copies: copies of a neighbour are neighbours alike,
    and copies of a vector are nearest to each other."""
    each = near.join(copies.select(F.col("rep").alias("neighbour"), "members"), "neighbour", "left").select("model", "vec_no", F.explode(F.coalesce("members", F.array("neighbour"))).alias("neighbour"), "similarity")
    own = copies.join(of.where("rep = vec_no").select("rep", "model"), "rep").select("model", F.col("rep").alias("vec_no"), F.explode("members").alias("neighbour"), F.lit(1.0).alias("similarity"))
    heap = F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("n"), "neighbour")))
    heaps = each.unionByName(own).groupBy("model", "vec_no").agg(F.slice(heap, 1, k + 1).alias("h"))
    lists = heaps.join(copies.select(F.col("rep").alias("vec_no")), "vec_no", "left_anti").unionByName(of.join(heaps.select(F.col("vec_no").alias("rep"), "h"), "rep").select("vec_no", "model", "h"))
    best = F.slice(F.filter("h", lambda x: x["neighbour"] != F.col("vec_no")), 1, k)
    return lists.select("model", "vec_no", F.posexplode(best).alias("p", "x")).select("model", "vec_no", F.col("x.neighbour").alias("neighbour"), (-F.col("x.n")).alias("similarity"), (F.col("p") + 1).alias("rank"))


def nearest(vectors: DataFrame, k: int = 10, stripe: int = STRIPE) -> DataFrame:
    """(model, vec_no, neighbour, distance, rank): the k most similar vectors of the same model for each row of (vec_no, model, vector).

    distance is one minus cosine, in double precision of the float values. Ties go to the smaller vec_no. Vectors of another length than most of
    their model belong to a group of their own. A null model is a model. Fewer than k others give fewer rows; a single vector gives none.
    """
    alone, copies, of = grouped(vectors, k)
    near = nearest_of_each(cut_lineage(alone), k, stripe)
    return expanded(near, copies, of, k).select("model", "vec_no", "neighbour", (1 - F.col("similarity")).alias("distance"), "rank")


def pairs(vectors: DataFrame, k: int = 10, stripe: int = STRIPE) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b: each pair of which one is among the k nearest of the other, once, as nearest() gives them.

    Heaps are only made again where copies change who is among them.
    """
    alone, copies, of = grouped(vectors, k)
    near = cut_lineage(nearest_of_each(cut_lineage(alone), k, stripe))
    open_ = copies.select(F.col("rep").alias("vec_no")).union(near.join(copies.select(F.col("rep").alias("neighbour")), "neighbour", "left_semi").select("vec_no")).distinct()
    settled = near.join(open_, "vec_no", "left_anti").select("vec_no", "neighbour")
    found = settled.unionByName(expanded(near.join(open_, "vec_no", "left_semi"), copies, of, k).select("vec_no", "neighbour"))
    return found.select(F.least("vec_no", "neighbour").alias("vec_a"), F.greatest("vec_no", "neighbour").alias("vec_b")).distinct()
