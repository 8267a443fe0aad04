"""Exact k-means over integer vectors, with clusters as balls.

A cluster is a ball: its centroid and a radius that covers its members. Another centroid can only be nearer to a member if it lies
within twice the radius; these are the cluster's neighbours, in order of their distance. A member that is nearer to its centroid than half the way to the
first neighbour is in the stable core and stays; the others lie in annuli by how many neighbours they must be compared with.
All comparisons are of integers, so no rounding can change an assignment.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filigraph.llm.shared import cut, discard

#: Components up to this size are compared in 64-bit integers, larger ones in Python's.
_NARROW = 1 << 24
#: A model of up to so many numbers goes to the tasks.
MAX_MODEL = 4_000_000


def whole_vectors(vectors: DataFrame, dims: int, scale: int, vec_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """``vec_id, v``: the vectors of exactly ``dims`` components, none null or not finite, each component x as floor(scale * x).

    Components whose integer doesn't fit 64 bits are beyond the contract; such a vector isn't kept either.
    """
    x = F.transform(F.col(vec_col), lambda c: c.cast("double") * scale)
    fits = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float(1 << 62)))
    kept = F.when(F.size(vec_col) == dims, x)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), kept.alias("x")).where(F.col("x").isNotNull() & F.forall("x", fits))
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c)).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of `seed:vec_id`, at most; a null id counts as empty, equal ids come by their vectors."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [list(r["v"]) for r in rows.select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()]


@dataclass
class Balls:
    """The centroids of a round and, for each, its neighbours by distance, as far as its ball reaches."""

    centroids: list[list[int]]
    neighbours: list[list[int]]

    @staticmethod
    def of(centroids: list[list[int]], reach: list[int | None]) -> Balls:
        """``reach``: the square of each ball's radius, or None where nothing is known and all others are neighbours."""
        grid = _matrix(centroids)
        found = []
        for i, square in enumerate(reach):
            apart = _squares(grid, grid[i])
            near = [j for j in range(len(centroids)) if j != i and (square is None or int(apart[j]) <= 4 * square)]
            found.append(sorted(near, key=lambda j, apart=apart: (int(apart[j]), j)))
        return Balls(centroids, found)


def _matrix(rows: list[list[int]] | np.ndarray) -> np.ndarray:
    out = np.asarray(rows, dtype=np.int64)
    return out if not out.size or max(int(out.max()), -int(out.min())) < _NARROW else out.astype(object)


def _squares(points: np.ndarray, center: np.ndarray) -> np.ndarray:
    gap = points - center
    return (gap * gap).sum(axis=1)


def nearest(points: np.ndarray, cluster: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each point (ties: the smaller number) and its squared distance. ``cluster``: where the points were."""
    centers = _matrix(balls.centroids)
    if centers.dtype == object or points.dtype == object:
        centers, points = centers.astype(object), points.astype(object)
    best, square = cluster.copy(), np.zeros(len(points), dtype=points.dtype)
    order = np.argsort(cluster, kind="stable")
    for members in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1) if len(order) else []:
        i = int(cluster[members[0]])
        inside = points[members]
        own = _squares(inside, centers[i])
        low, name = own.copy(), np.full(len(members), i, dtype=np.int64)
        others = balls.neighbours[i]
        if others:
            apart = _squares(centers[others], centers[i])
            # the annulus of a member: with how many neighbours it must be compared; none in the stable core
            annulus = np.searchsorted(apart, own * 4, side="right") if apart.dtype != object else np.array([sum(a <= 4 * o for a in apart) for o in own])
            for place in range(int(annulus.max())):
                rows = np.flatnonzero(annulus > place)
                got = _squares(inside[rows], centers[others[place]])
                wins = (got < low[rows]) | ((got == low[rows]) & (others[place] < name[rows]))
                low[rows[wins]], name[rows[wins]] = got[wins], others[place]
        best[members], square[members] = name, low
    return best, square


def _assigned(rows: DataFrame, balls: Balls) -> DataFrame:
    """``vec_id, v, cluster, distance``; a distance beyond 64 bits is null."""
    dims = len(balls.centroids[0])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False)
            best, square = nearest(_matrix(flat.reshape(-1, dims)), b.column("cluster").to_numpy(zero_copy_only=False), balls)
            fits = [int(x) if x < 1 << 63 else None for x in square] if square.dtype == object else square
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.array(best, pa.int64()), pa.array(fits, pa.int64())], ["vec_id", "v", "cluster", "distance"])

    return rows.select("vec_id", "v", "cluster").mapInArrow(assign, "vec_id long, v array<bigint>, cluster long, distance long")


def _sums(rows: DataFrame, dims: int) -> dict[int, tuple[int, list[int], int | None]]:
    """{cluster: (count, sum of each component, largest distance)}. Every task adds up its rows first, so a large cluster is no large group."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        far: dict[int, int | None] = {}
        for b in batches:
            grid = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            grid = grid if not grid.size or np.abs(grid).max() < 1 << 40 else grid.astype(object)
            cluster = b.column("cluster").to_numpy(zero_copy_only=False)
            distance = b.column("distance").fill_null(-1).to_numpy(zero_copy_only=False)
            for c in map(int, np.unique(cluster)):
                kept, mine = total.setdefault(c, [0] * (dims + 1)), cluster == c
                kept[dims] += int(mine.sum())
                for i, x in enumerate(grid[mine].sum(axis=0).tolist()):
                    kept[i] += x
                known = None if distance[mine].min() < 0 else int(distance[mine].max())
                far[c] = None if known is None or far.get(c, 0) is None else max(known, far.get(c, 0))
        flat = [(c, i, str(x), far[c]) for c, sums in total.items() for i, x in enumerate(sums)]
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in flat], t) for j, t in enumerate(types)], ["cluster", "part", "total", "far"])

    parts = rows.select("v", "cluster", "distance").mapInArrow(partial, "cluster long, part long, total string, far long")
    sums = parts.groupBy("cluster", "part").agg(
        F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total"), F.max("far").alias("far"), F.bool_or(F.col("far").isNull()).alias("unknown")
    )
    out: dict[int, list[int]] = {}
    far: dict[int, int | None] = {}
    for r in sums.collect():  # k * (dims + 1) rows
        out.setdefault(r["cluster"], [0] * (dims + 1))[r["part"]] = int(r["total"])
        far[r["cluster"]] = None if r["unknown"] else r["far"]
    return {c: (x[dims], x[:dims], far[c]) for c, x in out.items()}


def _moved(balls: Balls, sums: dict[int, tuple[int, list[int], int | None]]) -> Balls:
    """The next round's balls. A ball's radius is at most its last one and how far its centroid moved, rounded up."""
    centroids, reach = [], []
    for i, old in enumerate(balls.centroids):
        if i not in sums:  # nobody is in it, so nobody is compared from it
            centroids.append(old)
            reach.append(0)
            continue
        count, total, far = sums[i]
        new = [x // count for x in total]
        step = math.isqrt(sum((a - b) ** 2 for a, b in zip(new, old))) + 1
        centroids.append(new)
        reach.append(None if far is None else (math.isqrt(far) + 1 + step) ** 2)
    return Balls.of(centroids, reach)


def fit(rows: DataFrame, centroids: list[list[int]], rounds: int) -> tuple[DataFrame, Balls]:
    """The last assignment of ``rows`` (vec_id, v), and the balls that it was made with.

    A round reads and writes the vectors with their cluster once, in the shared folder; the table of the round before is deleted.
    Centroids, neighbours and sums are of the size of the model, which ``MAX_MODEL`` bounds.
    """
    if len(centroids) * max(len(centroids), len(centroids[0])) > MAX_MODEL:
        raise ValueError(f"a model of more than {MAX_MODEL} numbers isn't sent to the tasks")
    balls = Balls.of(centroids, [None] * len(centroids))
    table = cut(_assigned(rows.withColumn("cluster", F.lit(0).cast("long")), balls), "ball_round")
    for _ in range(rounds):
        balls = _moved(balls, _sums(table, len(centroids[0])))
        after = cut(_assigned(table, balls), "ball_round")
        discard(table)
        table = after
    return table, balls


def _long(total: Column) -> Column:
    """A decimal sum as a long, null beyond 64 bits."""
    return F.when(total.between(F.lit(-(1 << 63)).cast("decimal(38,0)"), F.lit((1 << 63) - 1).cast("decimal(38,0)")), total).cast("long")


def cluster(vectors: DataFrame, k: int = 40, dims: int = 64, rounds: int = 5, scale: int = 256, seed: int = 2) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``, one row per kept vector.

    Null vectors, those of another length and those with a null or non-finite component aren't kept. Fewer vectors than ``k`` make fewer
    centroids; no vector, no row. Null and repeated ids and equal vectors are rows like any others; equal first centroids tie, and the smaller
    number gets their vectors. Distances and sums beyond 64 bits are null. Further columns aren't read.
    """
    rows = whole_vectors(vectors, dims, scale)
    centroids = first_centroids(rows, k, seed)
    names = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return vectors.sparkSession.createDataFrame([], names)
    table, balls = fit(rows, centroids, rounds)
    each = F.sum(F.col("distance").cast("decimal(38,0)"))
    some_lost = F.bool_or(F.col("distance").isNull())
    per = table.groupBy("cluster").agg(F.when(~some_lost, each).alias("total")).collect()  # k rows
    whole = None if any(r["total"] is None for r in per) else sum(int(r["total"]) for r in per)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in balls.centroids]
    known = [(r["cluster"], r["total"], digests[r["cluster"]]) for r in per]
    named = vectors.sparkSession.createDataFrame(known, "cluster long, total decimal(38,0), centroid_sha256 string")
    out = table.join(F.broadcast(named), "cluster")
    everything = F.lit(whole if whole is not None and whole < 1 << 63 else None).cast("long")
    return out.select("vec_id", F.col("cluster").cast("int").alias("cluster"), "distance", _long(F.col("total")).alias("cluster_inertia"), everything.alias("inertia"), "centroid_sha256")
