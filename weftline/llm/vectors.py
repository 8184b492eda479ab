"""Near-duplicate vectors: an exact metric range join over pivot cells.

Vectors are scaled to length one, where cosine >= t is an angle of at most arccos t. Each belongs to the cell of its
nearest pivot, its home. The border between two cells is the plane half-way between their pivots, and a vector whose
angle to it is at most that angle may have partners beyond it (the triangle inequality on the sphere): it is copied
there as a guest. Of two cells only the one with the higher number gets the other's guests, so each pair meets in one
place, and cells join independently. Members of large cells are dealt over a grid of tiles, so that no task holds more
than two sides of a tile, whatever the cell.

How many pivots are used (two at least) is planned on a bounded sample (4 * `most_pivots` vectors): the number whose cells
are estimated to ship and compare least. Where directions are spread evenly in many dimensions no border is far, every cell
gets guests from all lower ones, and the join does as much work as all pairs; where space parts, cells see few guests.

Equal vectors are one class from the start, counted by size. Each tile returns partner counts and a spanning forest of
its links, never all pairs; components over these are the components over all links.

Nulls: vectors that are null, empty, zero, or hold null or non-finite numbers link with nothing and stand for
themselves, as do rows with a null vec_id. Vectors of different lengths never link; each length has cells of its own.
Repeated rows each get their answer, and count as partners of each other. Empty tables give no rows; other columns are
ignored. Numbers are read as they are: floats as floats, all others as doubles; cosines are doubles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, components, cut


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def classes(table: DataFrame, ident: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the class of each valid vector: i, v, w, classes: rep, n, v, w); v: the numbers packed, w: how many."""
    kind, code = ("float", "<f4") if dict(table.dtypes)[vector] == "array<float>" else ("double", "<f8")
    rows = table.select(F.col(f"`{ident}`").cast("long").alias("i"), F.col(f"`{vector}`").cast(f"array<{kind}>").alias("x"))
    finite = F.coalesce(~F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), F.lit(False))
    ok = F.col("i").isNotNull() & F.col("x").isNotNull() & finite & F.coalesce(F.exists("x", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))

    def packed(batches):
        for batch in batches:
            out, size = [], []
            for x, ok in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                out.append((np.array(x, dtype=code) + np.zeros(1, dtype=code)).tobytes() if ok else None)
                size.append(len(x) if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(size, pa.int32())], names=["i", "v", "w"])

    rows = cut(rows.mapInArrow(packed, "i long, v binary, w int"))
    groups = cut(rows.where("v IS NOT NULL").groupBy("v", "w").agg(F.min("i").alias("rep"), F.count(F.lit(1)).alias("n")))
    return rows, groups


def _matrix(rows: list[bytes], width: int) -> np.ndarray:
    raw = b"".join(rows)
    return np.frombuffer(raw, dtype="<f4" if len(raw) == 4 * width * len(rows) else "<f8").reshape(len(rows), width)


def _cells(x: np.ndarray, pivots: np.ndarray, bar: float) -> tuple[np.ndarray, np.ndarray]:
    """(which cells each unit vector goes to, its own cell); bar: the sine of the angle that partners may have.

    A vector goes to its own cell, and to those of higher number whose border is near."""
    dots = x @ pivots.T
    own = dots.argmax(axis=1)
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-18))
    border = (dots[np.arange(len(x)), own][:, None] - dots) / between[own]
    goes = (border <= bar + 1e-9) & (np.arange(len(pivots)) > own[:, None])
    goes[np.arange(len(x)), own] = True
    return goes, own


def _cost(sample: np.ndarray, pivots: np.ndarray, bar: float, n: int, tile: int) -> float:
    """Rows shipped and tiles compared per vector, estimated for n vectors on a sample."""
    goes, own = _cells(sample, pivots, bar)
    home = np.bincount(own, minlength=len(pivots)) * n / len(sample)
    guests = goes.sum(axis=0) * n / len(sample) - home
    a, b = np.maximum(1, np.ceil(home / tile)), np.ceil(guests / tile)
    return float((home * (a + 1 + b) + guests * a + (home * home / 2 + home * guests) / tile).sum() / n)


def plan_pivots(groups: DataFrame, cosine: float, most_pivots: int, tile: int, most_planned: int = 16, least: int = 64) -> dict[int, np.ndarray]:
    """Pivots for each length of vectors; lengths with few vectors, and all but the most common ones, get one cell."""
    found = {r["w"]: r["c"] for r in groups.groupBy("w").agg(F.count(F.lit(1)).alias("c")).collect()}  # one row for each length
    out = {w: np.zeros((1, w)) for w in found}
    for w in sorted((w for w in found if found[w] >= least), key=lambda w: (-found[w], w))[:most_planned]:
        got = groups.where(F.col("w") == w).orderBy(F.xxhash64("rep"), "rep").limit(4 * most_pivots).select("v").collect()
        x = _unit(_matrix([bytes(r["v"]) for r in got], w))
        most = min(most_pivots, len(x) // 4)
        sizes = [m for m in (2**k for k in range(1, 31)) if m <= most]
        out[w] = min((x[:m] for m in sizes), key=lambda p: (_cost(x[most:], p, np.sqrt(1 - cosine**2), found[w], tile), -len(p)))
    return out


def _spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the edges."""
    up: dict[int, int] = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = top(x), top(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def near_vectors(table: DataFrame, cosine: float = 0.9, ident: str = "vec_id", vector: str = "embedding", most_pivots: int = 256, tile: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept): links are pairs with cosine >= cosine, in double precision."""
    if not 0 < cosine <= 1:
        raise ValueError("cosine must be above 0 and at most 1")
    with Scratch() as scratch:
        rows, groups = classes(table, ident, vector)
        found = cut(tiles(groups, plan_pivots(groups, cosine, most_pivots, tile), cosine, tile).applyInArrow(_meet(cosine), "i long, links long, other long"))
        links = found.where("other IS NULL").groupBy(F.col("i").alias("li")).agg(F.sum("links").alias("links"))
        parts = components(found.where("other IS NOT NULL").select(F.col("i").alias("a"), F.col("other").alias("b")))
        known = groups.join(links, F.col("rep") == F.col("li"), "left").join(parts, F.col("rep") == F.col("node"), "left")
        n_links = (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")
        known = cut(known.select(F.col("v").alias("kv"), F.col("w").alias("kw"), n_links, F.coalesce("component", "rep").alias("part")))
        scratch.keep(rows, known)
    out = rows.join(known, (F.col("v") == F.col("kv")) & (F.col("w") == F.col("kw")), "left")
    component = F.coalesce("part", "i")
    return out.select(F.col("i").alias(ident), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("i") == component, F.lit(True)).alias("kept"))


def members(groups: DataFrame, pivots: dict[int, np.ndarray], cosine: float) -> DataFrame:
    """(cell, home, rep, n, v, w): each class in its own cell and in those where it is a guest."""
    shared = groups.sparkSession.sparkContext.broadcast(pivots)
    first = dict(zip(sorted(pivots), np.cumsum([0, *(len(pivots[w]) for w in sorted(pivots))]).tolist()))
    bar = float(np.sqrt(1 - cosine**2))

    def deal(batches):
        for batch in batches:
            widths = batch.column("w").to_numpy()
            for w in sorted(set(widths.tolist())):
                same = batch.filter(pa.array(widths == w))
                for at in range(0, same.num_rows, 4096):
                    some = same.slice(at, 4096)
                    goes, own = _cells(_unit(_matrix(some.column("v").to_pylist(), w)), shared.value[w], bar)
                    r, cell = np.nonzero(goes)
                    take = pa.array(r)
                    yield pa.RecordBatch.from_arrays([pa.array((cell + first[w]).astype(np.int32)), pa.array(own[r] == cell), *(some.column(k).take(take) for k in ("rep", "n", "v", "w"))], names=["cell", "home", "rep", "n", "v", "w"])

    return groups.select("rep", "n", "v", "w").mapInArrow(deal, "cell int, home boolean, rep long, n long, v binary, w int")


def tiles(groups: DataFrame, pivots: dict[int, np.ndarray], cosine: float, tile: int):
    """Members of all cells, grouped by tile. A cell's home rows are cut into parts that meet each other, each pair of
    parts once, and every part of its guests."""
    cells = cut(members(groups, pivots, cosine))
    counts = cells.groupBy("cell").agg(F.count_if("home").alias("h"), F.count_if(~F.col("home")).alias("g")).collect()  # a row for each pivot
    grid = [(c, max(1, -(-h // tile)), -(-g // tile)) for c, h, g in counts] or [(0, 1, 0)]
    sides = groups.sparkSession.createDataFrame(grid, "c int, a int, b int")
    cells = cells.join(F.broadcast(sides), F.col("cell") == F.col("c")).drop("c")
    part = F.pmod(F.xxhash64(F.lit("part"), "rep"), F.when(F.col("home"), F.col("a")).otherwise(F.greatest("b", F.lit(1)))).cast("int")
    cells = cells.withColumn("part", part)
    kept = ["rep", "n", "v", "w", "cell"]
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    home = cells.where("home")
    inner = home.withColumn("k", F.explode(upto("a"))).select(*kept, (F.col("part") <= F.col("k")).alias("left"), (F.col("part") >= F.col("k")).alias("right"), F.least("k", "part").alias("ra"), F.greatest("k", "part").alias("cb"))
    outer = home.where("b > 0").withColumn("k", F.explode(upto("b"))).select(*kept, F.lit(True).alias("left"), F.lit(False).alias("right"), F.col("part").alias("ra"), (-1 - F.col("k")).alias("cb"))
    guest = cells.where("NOT home").withColumn("k", F.explode(upto("a"))).select(*kept, F.lit(False).alias("left"), F.lit(True).alias("right"), F.col("k").alias("ra"), (-1 - F.col("part")).alias("cb"))
    return inner.unionByName(outer).unionByName(guest).groupBy("cell", "ra", "cb")


def _meet(cosine: float):
    """Partner counts of a tile's members, and a spanning forest of its links. A row on both sides is in a tile with itself."""

    def join(group):
        left, right = group.filter(group.column("left")), group.filter(group.column("right"))
        x, y = left.column("rep").to_numpy(), right.column("rep").to_numpy()
        own, other = np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64)
        edges: list[tuple[int, int]] = []
        if len(x) and len(y):
            width = left.column("w")[0].as_py()
            ux, uy = _unit(_matrix(left.column("v").to_pylist(), width)), _unit(_matrix(right.column("v").to_pylist(), width))
            n, m = left.column("n").to_numpy(), right.column("n").to_numpy()
            twice = np.isin(x, y)  # then each pair of them is met from either side
            again = np.isin(y, x)
            for at in range(0, len(ux), 1024):
                r, c = np.nonzero(ux[at : at + 1024] @ uy.T >= cosine)
                r += at
                apart = x[r] != y[c]
                r, c = r[apart], c[apart]
                own += np.bincount(r, weights=m[c], minlength=len(x)).astype(np.int64)
                once = ~(twice[r] & again[c])
                other += np.bincount(c[once], weights=n[r[once]], minlength=len(y)).astype(np.int64)
                edges = _spanning(np.concatenate(([e[0] for e in edges], x[r])).astype(np.int64), np.concatenate(([e[1] for e in edges], y[c])).astype(np.int64))
        ex, ey = [list(k) for k in zip(*edges)] if edges else ([], [])
        some, more = np.flatnonzero(own), np.flatnonzero(other)
        ids = [*x[some].tolist(), *y[more].tolist(), *ex]
        counts = [*own[some].tolist(), *other[more].tolist(), *[0] * len(ex)]
        return pa.table({"i": pa.array(ids, pa.int64()), "links": pa.array(counts, pa.int64()), "other": pa.array([*[None] * (len(ids) - len(ex)), *ey], pa.int64())})

    return join
