"""An inverted-file index of vectors: cells around centroids, written by cell, searched by probing a few cells.

Centroids are fitted on a bounded sample; every row is assigned to the nearest one and written to its cell's folder, so a probe
reads the folders of its cells and scores all their rows exactly. How many cells to probe is measured when the index is built: as many as
reach the wanted recall on queries of the sample. Versions never change; appended rows are a new part of the next version.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigraph.functions.vectors import normalised
from filigraph.operators.retrieval import _ready, nearest, nearest_in_groups
from filigraph.sources import versions

#: Numbers in all centroids together, at most: they go to every task.
MAX_CENTROIDS = 8_000_000


def _unit(matrix: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(length > 0, length, 1.0)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Centroids of length one by Lloyd's rounds over the sample's directions; an empty cell takes the row that fits its own centroid least."""
    rows = _unit(sample)
    picked = np.random.default_rng(seed).choice(len(rows), size=min(cells, len(rows)), replace=False)
    centroids = rows[np.sort(picked)].copy()
    for _ in range(rounds):
        scores = rows @ centroids.T
        cell, best = scores.argmax(axis=1), scores.max(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, cell, rows)
        worst = iter(np.argsort(best, kind="stable"))
        for empty in np.setdiff1d(np.arange(len(centroids)), cell):
            sums[empty] = rows[next(worst)]
        centroids = _unit(sums)
    return centroids


def probes_for(sample: np.ndarray, centroids: np.ndarray, recall: float, k: int = 10, queries: int = 200) -> int:
    """How many cells must be probed so that queries of the sample find this share of their nearest ``k`` in it, on average."""
    rows = np.unique(sample, axis=0)  # copies of one row would be each other's neighbours
    cell = (rows @ centroids.T).argmax(axis=1)
    asked = rows[np.random.default_rng(7).permutation(len(rows))[:queries]]
    near = np.argsort(-(asked @ rows.T), axis=1, kind="stable")[:, :k]
    rank = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(rank, cell[near], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


@dataclass
class VectorIndex:
    """``rows`` (part, cell, id, v, unit and the kept columns) of a version; ``centroids`` and how many cells a search probes."""

    rows: DataFrame
    centroids: np.ndarray
    probes: int
    id_col: str
    column: str
    about: dict[str, Any]


def _assigned(vectors: DataFrame, centroids: np.ndarray, column: str) -> DataFrame:
    """``vectors`` with ``cell``, for those with a whole vector of the centroids' width."""

    @F.pandas_udf("int")
    def cell(batch):
        import pandas as pd

        return pd.Series((np.stack(batch.to_numpy()) @ centroids.T).argmax(axis=1).astype(np.int32), index=batch.index)

    whole = (F.size(column) == centroids.shape[1]) & ~F.exists(column, lambda x: x.isNull())
    rows = vectors.where(whole).withColumn(column, F.transform(column, lambda x: x.cast("double")))
    return rows.withColumn("cell", cell(F.col(column)))


def _write(vectors: DataFrame, path: str, part: int, centroids: np.ndarray, column: str, sort: list[str], file_rows: int) -> None:
    """Rows by cell, sorted by what searches filter by. A large cell is dealt over as many tasks as it has files."""
    rows = _assigned(vectors, centroids, column)
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20))
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).select("cell", F.ceil(F.col("n") / file_rows).cast("int").alias("files"))
    dealt = rows.join(F.broadcast(sizes), "cell").withColumn("salt", salt % F.col("files"))
    dealt = dealt.repartition("cell", "salt").sortWithinPartitions("cell", *sort).drop("files", "salt")
    dealt.write.option("maxRecordsPerFile", file_rows).partitionBy("cell").parquet(f"{path}/cells/part={part}")


def build_index(
    vectors: DataFrame, path: str, cells: int | None = None, recall: float = 0.95, sample_rows: int = 50_000, id_col: str = "vec_id", column: str = "embedding",
    sort: list[str] | None = None, normalise: bool = False, file_rows: int = 1_000_000,
) -> int:
    """Writes an index of all whole vectors below ``path`` and returns its version.

    Centroids come from ``sample_rows`` rows at most, those with the smallest hash of their id. Without ``cells`` there is one for the root of
    the number of rows, and no more than one for 39 rows of the sample. ``normalise`` stores vectors at length one. Rows with a null vector, or one of another
    width than most of the sample, aren't indexed. Other columns are kept; ``sort`` names those that searches filter by.
    """
    spark = vectors.sparkSession
    rows = vectors.withColumn(column, normalised(F.transform(column, lambda x: x.cast("double")))) if normalise else vectors
    picked = _ready(rows, id_col, column).orderBy(F.xxhash64("id"), "id").limit(sample_rows).collect()
    widths = [len(r["v"]) for r in picked]
    width = max(set(widths), key=widths.count) if widths else 1
    sample = np.array([r["v"] for r in picked if len(r["v"]) == width], np.float64).reshape(-1, width)
    cells = cells or max(1, min(int(rows.count() ** 0.5), len(sample) // 39))
    if cells * width > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} numbers in {cells} centroids")
    centroids = fit_centroids(sample, cells) if len(sample) else np.zeros((1, width))
    probes = probes_for(sample, centroids, recall) if len(sample) else 1
    version = versions.next_version(spark, path)
    _write(rows, path, version, centroids, column, sort or [], file_rows)
    names = [[i, c.tolist()] for i, c in enumerate(centroids)]
    spark.createDataFrame(names, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids/of={version}")
    versions.publish(spark, path, version, {"parts": [version], "centroids": version, "probes": probes, "id_col": id_col, "column": column, "normalise": normalise, "sort": sort or [], "schema": rows.schema.json(), "file_rows": file_rows})
    return version


def open_index(spark: SparkSession, path: str, version: int | None = None) -> VectorIndex:
    """A stored index, its newest version without a number."""
    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType
    import json

    _, about = versions.describe(spark, path, version)
    stored = StructType.fromJson(json.loads(about["schema"]))
    fields = [StructField(f.name, ArrayType(DoubleType()) if f.name == about["column"] else f.dataType) for f in stored]
    schema = StructType([*fields, StructField("part", IntegerType()), StructField("cell", IntegerType())])
    parts = F.col("part").isin(about["parts"])
    rows = spark.read.schema(schema).parquet(f"{path}/cells").where(parts)
    found = spark.read.parquet(f"{path}/centroids/of={about['centroids']}").orderBy("cell").collect()  # bounded by MAX_CENTROIDS
    return VectorIndex(rows, np.array([r["centroid"] for r in found], np.float64), about["probes"], about["id_col"], about["column"], about)


def append(spark: SparkSession, path: str, vectors: DataFrame) -> int:
    """A new version with more rows, in the cells of the newest one. What is there already isn't touched or read."""
    last, about = versions.describe(spark, path)
    index = open_index(spark, path, last)
    version = versions.next_version(spark, path)
    column = about["column"]
    rows = vectors.withColumn(column, normalised(F.transform(column, lambda x: x.cast("double")))) if about["normalise"] else vectors
    _write(rows.select(*[f.name for f in index.rows.schema if f.name not in ("part", "cell")]), path, version, index.centroids, column, about["sort"], about["file_rows"])
    versions.publish(spark, path, version, about | {"parts": [*about["parts"], version]})
    return version


def _order(index: VectorIndex, query: list[float]) -> list[int]:
    """All cells, the nearest first."""
    return np.argsort(-(index.centroids @ np.asarray(query, np.float64)), kind="stable").tolist()


def search(index: VectorIndex, query: list[float], k: int = 10, where: Column | None = None, probes: int | None = None, exhaustive: bool = False) -> DataFrame:
    """The nearest ``k`` rows that satisfy ``where`` in the nearest cells, by exact scores as in :func:`filigraph.operators.retrieval.nearest`.

    Where the probed cells hold fewer than ``k`` such rows, twice as many are probed, in the end all. ``exhaustive`` reads all cells and is exact.
    """
    kept = index.rows if where is None else index.rows.where(where)
    hits = lambda rows: nearest(rows, query, k, index.id_col, index.column)
    if exhaustive or len(query) != index.centroids.shape[1]:
        return hits(kept)
    order, n = _order(index, query), probes or index.probes
    while n < len(order):
        found = hits(kept.where(F.col("cell").isin(order[:n])))
        if found.select(index.id_col).count() >= k:
            return found
        n *= 2
    return hits(kept)


def search_each(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int | None = None, where: Column | None = None, exhaustive: bool = False, share_rows: int = 250_000) -> DataFrame:
    """``query_id, {id_col}, score, place`` for a table of queries (query_id, and a vector in the index's column): each meets the rows of its nearest cells.

    A query goes to its cells, and the rows of a large cell to several tasks; rows of cells that no query probes are only read.
    A query whose cells hold fewer than ``k`` rows gets those.
    """
    n = len(index.centroids) if exhaustive else min(len(index.centroids), probes or index.probes)
    centroids = index.centroids
    asked = _ready(queries, "query_id", index.column).where(F.size("v") == centroids.shape[1])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, centroids.shape[1])
            cells = np.argsort(-(v @ centroids.T), axis=1, kind="stable")[:, :n]
            taken = pa.array(np.repeat(np.arange(len(v)), n))
            yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int64)), b.column("id").take(taken), b.column("v").take(taken)], ["tile", "id", "v"])

    tiles = asked.mapInArrow(probe, "tile long, id long, v array<double>")
    kept = index.rows if where is None else index.rows.where(where)
    rows = kept.select(F.col("cell").cast("long").alias("tile"), F.col(index.id_col).cast("long").alias("id"), F.col(index.column).alias("v"))
    shares = rows.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / share_rows).cast("int").alias("shares"))
    return nearest_in_groups(tiles, rows, shares, k, index.id_col)


def recall(found: DataFrame, exact: DataFrame, id_col: str = "vec_id") -> float:
    """The share of the exact hits (query_id, id) that were found."""
    both = exact.select("query_id", id_col).join(found.select("query_id", id_col).withColumn("hit", F.lit(1)), ["query_id", id_col], "left")
    row = both.agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("all")).first()
    return row["hits"] / row["all"] if row["all"] else 1.0
