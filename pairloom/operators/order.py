"""Order-aware deduplication, ordering, sampling and splits.

Every operator takes its order from stored columns, never from row positions.
Where only one row a key is wanted, a mergeable aggregate is used instead of a
window, text keys are grouped by their digests, and only the wanted columns
travel.  Ranks inside groups come from range partitions and one offset a group
and partition, so a hot group is ranked by many tasks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_digest(*columns: Column) -> Column:
    """128 bits of the columns' values, lengths and nulls included, in place of long keys."""
    part = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat(*map(part, columns))))


def _pick(df: DataFrame, keys: list[str], order: list[str], last: bool, keep: list[str] | None) -> DataFrame:
    row, rank = F.struct(*(keep or df.columns)), F.struct(*order)
    chosen = (F.max_by if last else F.min_by)(row, rank).alias("_row")
    kinds = dict(df.dtypes)
    by = [key_digest(*map(F.col, keys)).alias("_k")] if any(kinds[k] == "string" for k in keys) else [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*by).agg(chosen).select("_row.*")


def keep_first(df: DataFrame, keys: list[str], order: list[str], keep: list[str] | None = None) -> DataFrame:
    """First row of each key in ``order`` (which must be total), with the columns ``keep``.  Map-side combined."""
    return _pick(df, keys, order, False, keep)


def keep_last(df: DataFrame, keys: list[str], order: list[str], keep: list[str] | None = None) -> DataFrame:
    """Latest row of each key: the view of an append-only log."""
    return _pick(df, keys, order, True, keep)


def union_keep_first(frames: list[DataFrame], keys: list[str], order: list[str]) -> DataFrame:
    """Union where earlier frames win a key (gold before synthetic)."""
    tagged = [f.withColumn("_source", F.lit(i)) for i, f in enumerate(frames)]
    return keep_first(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged), keys, ["_source", *order]).drop("_source")


def ranked_within(df: DataFrame, group: Column, order: list[str]) -> DataFrame:
    """``df`` plus ``_rank``, the place (from 0) of a row inside its group, and
    ``_first``, the least first order column of the group.

    Rows are range-partitioned by (group, order) and written, which freezes the
    partitions; offsets are one row a group and partition.
    """
    from ..sources.shared import cut

    at = F.col(order[0])
    parts = cut(df.withColumn("_g", F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))).repartitionByRange("_g", *order).withColumn("_part", F.spark_partition_id()))
    per = parts.groupBy("_g", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_low"))
    by = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_n").over(by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = per.select("_g", "_part", before.alias("_from"), F.min("_low").over(by).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_part", "_g").orderBy(*order)) - 1
    return parts.withColumn("_in", inside).join(offsets, ["_g", "_part"]).select(*df.columns, (F.col("_from") + F.col("_in")).cast("int").alias("_rank"), "_first")


def round_robin(df: DataFrame, group: str, order: str) -> DataFrame:
    """Adds ``turn`` and ``group_order``; sorting by (turn, group_order, order)
    interleaves groups in the order in which they are first seen.  A row
    without a group is a group of its own."""
    own = F.coalesce(F.nullif(F.col(group).cast("string"), F.lit("")), F.concat(F.lit("missing-"), F.col(order).cast("string")))
    return ranked_within(df, own, [order]).withColumnsRenamed({"_rank": "turn", "_first": "group_order"})


def first_seen_codes(df: DataFrame, group: str, order: str) -> DataFrame:
    """(group, code): groups numbered by first appearance."""
    firsts = df.groupBy(group).agg(F.min(order).alias("_seen"))
    return ranked_within(firsts, F.lit(""), ["_seen"]).select(group, F.col("_rank").alias("code"))


def within_group_index(df: DataFrame, group: str, order: list[str], name: str = "segment_index") -> DataFrame:
    return ranked_within(df, F.col(group), order).drop("_first").withColumnRenamed("_rank", name)


def circular_next(df: DataFrame, position: str, start: int, size: int, limit: int = 1) -> DataFrame:
    """The next rows at or after ``start``, wrapping around ``size`` positions."""
    return df.orderBy(F.pmod(F.col(position) - start, F.lit(size)), position).limit(limit)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("rank") <= k)


def hash_rank(seed: int | str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 2026) -> DataFrame:
    """``n`` rows without replacement, the same on every run and partitioning."""
    return df.orderBy(hash_rank(seed, F.col(key)), key).limit(n)


def sample_per_group(df: DataFrame, group: list[str], key: str, n: int, seed: int = 2026) -> DataFrame:
    return top_per_group(df, group, [hash_rank(seed, F.col(key)), F.col(key)], n).drop("rank")


def unit_interval(seed: int | str, key: Column) -> Column:
    """A number in [0, 1) drawn from a key: the generator of all row-wise choices."""
    return F.conv(F.substring(hash_rank(seed, key), 1, 13), 16, 10).cast("double") / float(16**13)


def weighted_key(u: Column, weight: Column) -> Column:
    """Largest key first gives a weighted order without replacement."""
    return F.pow(u, F.lit(1.0) / weight)


def greedy_spans(candidates: Column, budget: Column | int) -> Column:
    """Of array<struct<score, start, end, target, ...>> sorted best first, those
    that neither overlap a chosen span nor repeat a chosen target, at most
    ``budget``.  The fold stays inside the row."""
    budget = F.lit(budget) if isinstance(budget, int) else budget

    def step(chosen: Column, c: Column) -> Column:
        clash = F.exists(chosen, lambda x: ((x["start"] < c["end"]) & (c["start"] < x["end"])) | (x["target"] == c["target"]))
        return F.when((F.size(chosen) < budget) & ~clash, F.array_append(chosen, c)).otherwise(chosen)

    return F.aggregate(candidates, F.slice(candidates, 1, 0), step)


def greedy_group_splits(groups: list[tuple[str, int]], fractions: dict[str, float], mode: str = "ratio") -> dict[str, str]:
    """Whole groups to splits, largest first.

    ``ratio``: the split whose filled share would be least (ties by name);
    ``deficit``: the split with the largest relative deficit (ties by order).
    """
    total = sum(n for _, n in groups)
    want = {k: total * f for k, f in fractions.items()}
    have = dict.fromkeys(fractions, 0)
    out = {}
    for name, n in groups:
        if mode == "ratio":
            chosen = min(sorted(fractions), key=lambda k: (have[k] + n) / want[k])
        else:
            chosen = max(fractions, key=lambda k: (want[k] - have[k]) / want[k])
        out[name] = chosen
        have[chosen] += n
    return out


class _Run:
    """Greedy splits inside a run of groups of one size, without a step a group.

    A split's j-th group (from 1) of the run has a key that never falls with j,
    and the greedy takes the least key first (ties by place of the split), so it
    merges the splits' keys.  What stands before a key can be counted directly.
    """

    def __init__(self, want: list[float], mode: str):
        self.want, self.ratio = want, mode == "ratio"

    def key(self, k, j, n, have):
        if self.ratio:
            return (have[k] + j * n) / self.want[k]
        return -((self.want[k] - (have[k] + (j - 1) * n)) / self.want[k])

    def place(self, k, j, n, have):
        """The rank in the run of the j-th group of split k."""
        mine = self.key(k, j, n, have)
        out = j - 1
        for other in range(len(self.want)):
            if other != k:
                near = mine * self.want[other] - have[other] + (0 if self.ratio else self.want[other] + n)
                # the division is near; the four keys around it decide
                count = np.floor(near / n).astype(np.int64) - 2
                theirs = [self.key(other, count + d, n, have) for d in (1, 2, 3, 4)]
                out = out + np.maximum(count + sum(((t < mine) | ((t == mine) & (other < k))).astype(np.int64) for t in theirs), 0)
        return out

    def taken(self, k, rank, n, have):
        """How many of the first ``rank`` groups go to split k."""
        low, high = np.zeros_like(rank), rank.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            fits = self.place(k, np.maximum(mid, 1), n, have) < rank
            low, high = np.where(fits & (low < high), mid, low), np.where(fits | (low >= high), high, mid - 1)
        return low

    def split_of(self, rank, n, have):
        out = np.zeros(len(rank), np.int64)
        for k in range(len(self.want)):
            out[self.place(k, self.taken(k, rank, n, have) + 1, n, have) == rank] = k
        return out


def assign_group_splits(df: DataFrame, group: str, fractions: dict[str, float], seed: int = 2026, mode: str = "ratio", steps: int = 4_096) -> DataFrame:
    """``df`` plus ``split``; a group never crosses splits, and null is a group.

    The result is that of ``greedy_group_splits``, largest groups first, but the
    driver sees a row a distinct size only (at most the square root of twice the
    rows); the groups of a size are ranked and find their splits in the tasks.
    Runs of more than ``steps`` groups are counted instead of walked.
    """
    if not all(f > 0 for f in fractions.values()):
        raise ValueError("fractions must be positive")
    spark, names = df.sparkSession, sorted(fractions) if mode == "ratio" else list(fractions)
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    found = sorted(((r["_n"], r["_m"]) for r in sizes.groupBy("_n").agg(F.count(F.lit(1)).alias("_m")).collect()), reverse=True)
    number, total = sum(m for _, m in found), sum(n * m for n, m in found)
    if number < len(fractions):
        raise ValueError(f"{number} groups cannot fill {len(fractions)} splits")
    run = _Run([total * fractions[k] for k in names], mode)
    have, states = [0] * len(names), []
    for n, m in found:
        states.append((n, list(have)))
        if m <= steps:
            for _ in range(m):
                have[min(range(len(names)), key=lambda k: (run.key(k, 1, n, have), k))] += n
        else:
            have = [h + n * int(run.taken(k, np.array([m]), n, [np.array([h]) for h in states[-1][1]])[0]) for k, h in enumerate(have)]

    @F.arrow_udf("string")
    def split_of(rank: pa.Array, n: pa.Array, have: pa.Array) -> pa.Array:
        held = have.flatten().to_numpy().reshape(-1, len(names)).T
        return pa.array([names[k] for k in run.split_of(rank.to_numpy().astype(np.int64), n.to_numpy(), held)], pa.string())

    ranked = ranked_within(sizes.withColumn("_h", hash_rank(seed, F.col(group))), F.col("_n"), ["_h", group])
    placed = ranked.join(F.broadcast(spark.createDataFrame(states, "_n long, _have array<long>")), "_n")
    table = placed.select(F.col(group).alias("_group"), split_of("_rank", "_n", "_have").alias("split"))
    return df.join(F.broadcast(table) if number <= 200_000 else table, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def hold_out_group(df: DataFrame, group: str, fraction: float = 0.2) -> DataFrame:
    """The one group whose size is closest to a fraction of all rows."""
    total = df.count()
    return df.groupBy(group).count().orderBy(F.abs(F.col("count") - F.lit(total * fraction)), group).limit(1)


def common_keys(df: DataFrame, key: str, by: str, parts: int) -> DataFrame:
    """Keys that occur in all ``parts`` values of ``by``."""
    return df.groupBy(key).agg(F.count_distinct(by).alias("_n")).filter(F.col("_n") == parts).select(key)
