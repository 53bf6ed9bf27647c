"""Nearest neighbours by cosine: an index of coarse cells with exact re-ranking, and an exact mode.

Centroids are fitted on a bounded sample (``SAMPLE`` rows); every vector is put
into the cell of its nearest centroid.  A query visits the ``probes`` cells whose
centroids are nearest, or all cells (exact mode), and every vector of a visited
cell is compared.  How many cells are needed is measured: as many as hold ``aim``
of the neighbours that sampled queries have inside the sample.  A large cell is cut into parts, queries into blocks, so a task
compares at most ``PART`` vectors with ``QUERIES`` queries at a time; what leaves
it are the best k of each query.

Null vectors, vectors of zeros and vectors with a null element have no neighbours
and are none; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut
from . import order

#: Rows that the centroids are fitted on, vectors of a part, queries of a block.
SAMPLE, PART, QUERIES = 20_000, 20_000, 2_000


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit rows of a column of equally long lists."""
    if not len(column):
        return np.zeros((0, 0))
    flat = np.array(column.to_pylist(), dtype=np.float64)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _usable(vectors: DataFrame, vector: str) -> DataFrame:
    whole = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double"))) & F.exists(vector, lambda x: x != 0)
    return vectors.filter(F.col(vector).isNotNull() & whole)


def probes_needed(x: np.ndarray, centroids: np.ndarray, k: int, aim: float, asked: int = 200) -> int:
    """Cells to visit so that ``aim`` of the ``k`` nearest rows of the first ``asked`` rows of ``x`` are met."""
    queries = x[:asked]
    like = queries @ x.T
    like[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    near = np.argsort(-like, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    cell = np.argmax(x @ centroids.T, axis=1)
    ranks = np.argsort(np.argsort(-(queries @ centroids.T), axis=1, kind="stable"), axis=1)
    visits = np.sort(np.take_along_axis(ranks, cell[near], axis=1).ravel())
    return int(visits[max(int(np.ceil(aim * len(visits))) - 1, 0)]) + 1 if len(visits) else len(centroids)


def fit_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cells: int = 64, rounds: int = 10, sample: int = SAMPLE, k: int = 10, aim: float = 0.95) -> tuple[np.ndarray, int]:
    """Unit centroids by spherical k-means on the ``sample`` rows with the smallest keyed
    hashes, and the number of cells to visit."""
    rows = order.sample_rows(_usable(vectors, vector).select(key, vector), key, sample).select(key, vector).orderBy(key).toArrow()  # at most ``sample``
    x = _matrix(rows[vector])
    if not len(x):
        return np.zeros((0, 0)), 0
    chosen = [0]  # far apart: each next start is the row least like all before
    like = x @ x[0]
    while len(chosen) < min(cells, len(x)):
        chosen.append(int(np.argmin(like)))
        like = np.maximum(like, x @ x[chosen[-1]])
    centroids = x[chosen]
    for _ in range(rounds):
        nearest = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-30), centroids)
    return centroids, probes_needed(x, centroids, k, aim)


def nearest_cells(vector: Column, centroids: np.ndarray, n: int) -> Column:
    """The ``n`` cells with the nearest centroids, nearest first."""

    @F.arrow_udf("array<int>")
    def find(rows: pa.Array) -> pa.Array:
        like = _matrix(rows) @ centroids.T
        return pa.array(np.argsort(-like, axis=1, kind="stable")[:, :n].astype(np.int32).tolist(), pa.list_(pa.int32()))

    return find(vector)


def _compared(k: int):
    def work(queries: pa.Table, rows: pa.Table) -> pa.Table:
        kind = pa.list_(pa.struct([("less", pa.float64()), ("id", pa.int64())]))
        out: list[list[dict]] = []
        if rows.num_rows:
            x, ids = _matrix(rows["_v"]), rows["_id"].to_numpy()
            for at in range(0, queries.num_rows, QUERIES):
                like = np.round(_matrix(queries["_v"].slice(at, QUERIES)) @ x.T, 9)
                for i, q in enumerate(queries["_q"].slice(at, QUERIES).to_pylist()):
                    row = np.where(ids == q, -np.inf, like[i])
                    n = min(k, len(row) - 1)
                    least = np.partition(row, len(row) - k)[len(row) - k] if k < len(row) else -np.inf
                    near = np.nonzero((row >= least) & (row > -np.inf))[0]
                    best = near[np.lexsort((ids[near], -row[near]))][: max(n, 0)]
                    out.append([{"less": -s, "id": j} for s, j in zip(row[best].tolist(), ids[best].tolist())])
        else:
            out = [[] for _ in range(queries.num_rows)]
        return pa.table({"_q": queries["_q"].cast(pa.int64()), "best": pa.array(out, kind)})

    return work


def neighbours(queries: DataFrame, vectors: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", cells: int = 64, aim: float | None = 0.95) -> DataFrame:
    """(query, id, rank, similarity): the ``k`` nearest vectors of each query, itself left out.

    ``aim``: the part of the neighbours to meet, as measured on the sample; None visits
    all cells, the exact mode.
    """
    centroids, probes = fit_index(vectors, key, vector, cells, k=k, aim=1.0 if aim is None else aim)
    schema = "query bigint, id bigint, rank int, similarity double"
    if not len(centroids):
        return queries.sparkSession.createDataFrame([], schema)
    placed = _usable(vectors, vector).select(F.col(key).cast("long").alias("_id"), F.col(vector).alias("_v")).withColumn("cell", nearest_cells(F.col("_v"), centroids, 1)[0])
    placed = cut(placed)
    # a row a cell: at most ``cells``
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    placed = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("_id"), F.col("parts")).cast("int")).drop("parts")
    asked = _usable(queries, vector).select(F.col(key).cast("long").alias("_q"), F.col(vector).alias("_v"))
    visits = asked.withColumn("cell", F.explode(nearest_cells(F.col("_v"), centroids, len(centroids) if aim is None else probes)))
    visits = visits.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    found = visits.groupBy("cell", "part").cogroup(placed.groupBy("cell", "part")).applyInArrow(_compared(k), "_q bigint, best array<struct<less:double,id:bigint>>")
    best = found.groupBy("_q").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))
    return best.select(F.col("_q").alias("query"), F.posexplode("best").alias("_r", "b")).select("query", "b.id", (F.col("_r") + 1).alias("rank"), (-F.col("b.less")).alias("similarity"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The part of the exact neighbours (query, id) that were found."""
    pairs = exact.select("query", "id")
    total = pairs.count()
    return pairs.join(found.select("query", "id"), ["query", "id"], "left_semi").count() / total if total else 1.0
