"""Word vectors by factorising a sparse matrix of positive pointwise mutual information.

The symmetric matrix of grams that stand near each other is never held whole:
its cells are a table, a product with a narrow matrix is a join and ``size``
sums, combined in the map tasks, and a basis is made orthonormal from its
``size`` x ``size`` Gram matrix alone.  Starting from signs by hash, a few rounds
of product and basis (randomised subspace iteration) give the space of the
largest eigenvalues; no stage has one task, and reruns agree but for the last
digits of sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut


def near_counts(rows: DataFrame, grams: Column, window: int, min_count: int) -> DataFrame:
    """(a, b, n): how often two grams with ``min_count`` occurrences stand within ``window`` places in a row's list."""
    lists = rows.select(grams.alias("g")).filter(F.col("g").isNotNull())
    frequent = cut(lists.select(F.explode("g").alias("a")).groupBy("a").count().filter(F.col("count") >= min_count).select("a"))
    g = F.col("g")

    def around(token: Column, i: Column) -> Column:
        # pairs (here, later) only: the matrix is symmetric
        return F.struct(token.alias("a"), F.slice(g, i + 2, window).alias("near"))

    later = lists.select(F.explode(F.transform(g, around)).alias("x")).select("x.a", F.explode("x.near").alias("b"))
    half = later.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    half = cut(half.join(frequent, "a", "left_semi").join(frequent.withColumnRenamed("a", "b"), "b", "left_semi"))
    both = half.unionByName(half.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    # a gram beside itself is met from both sides
    return both.withColumn("n", F.when(F.col("a") == F.col("b"), 2 * F.col("n")).otherwise(F.col("n")))


def positive_information(counts: DataFrame) -> DataFrame:
    """(a, b, x): log of the count against chance, where positive."""
    sums = cut(counts.groupBy("a").agg(F.sum("n").alias("total")))
    whole = sums.agg(F.sum("total")).first()[0] or 0
    x = F.log(F.col("n") * F.lit(float(whole)) / (F.col("ta") * F.col("tb")))
    joined = counts.join(sums.withColumnRenamed("total", "ta"), "a").join(sums.select(F.col("a").alias("b"), F.col("total").alias("tb")), "b")
    return joined.select("a", "b", x.alias("x")).filter("x > 0")


def _orthonormal(vectors: DataFrame, size: int) -> DataFrame:
    """(b, v) with the columns of ``v`` turned into an orthonormal basis of their span."""
    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            v = np.asarray(batch.column("v").flatten()).reshape(-1, size)
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], ["at", "s"])

    sums = vectors.select("v").mapInArrow(gram, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).orderBy("at").collect()  # size * size rows
    values, basis = np.linalg.eigh(np.array([r["s"] for r in sums]).reshape(size, size)) if sums else (np.zeros(size), np.zeros((size, size)))
    scale = np.where(values > max(values.max(), 0) * 1e-12, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
    turn = basis * scale  # a direction without length becomes a column of zeros

    @F.arrow_udf("array<double>")
    def turned(v: pa.Array) -> pa.Array:
        flat = np.asarray(v.flatten()).reshape(-1, size) @ turn
        return pa.array(list(flat), pa.list_(pa.float64()))

    return vectors.select("b", turned(F.col("v")).alias("v"))


def factor_vectors(cells: DataFrame, size: int, rounds: int, seed: int) -> DataFrame:
    """(gram, vector): the rows of the symmetric matrix (a, b, x), projected on ``size`` directions."""
    cells = cut(cells)
    sign = lambda i: (F.xxhash64("b", F.lit(seed), i) % 2).cast("double")
    start = cells.select("b").distinct()
    vectors = cut(start.select("b", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(sign(i) == 0, -1.0).otherwise(1.0)).alias("v")))
    for _ in range(max(rounds, 1)):
        joined = cells.join(_orthonormal(vectors, size), "b")
        product = joined.groupBy("a").agg(F.array(*[F.sum(F.col("x") * F.col("v")[i]) for i in range(size)]).alias("v"))
        vectors = cut(product.select(F.col("a").alias("b"), "v"))
    return vectors.select(F.col("b").alias("gram"), F.col("v").alias("vector"))
