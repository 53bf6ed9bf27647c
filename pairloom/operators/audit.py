"""Validation, leakage audits and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import order


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_unique(df: DataFrame, key: list[str], what: str = "keys") -> DataFrame:
    """One aggregate; raises if a key repeats."""
    if df.groupBy(*key).count().filter("count > 1").limit(1).count():
        raise ValueError(f"duplicate {what}: {key}")
    return df


def one_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    require_unique(left, on, "left keys")
    require_unique(right, on, "right keys")
    return left.join(right, on, how)


def overlap_groups(df: DataFrame, key: Column, split: str) -> DataFrame:
    """(key, splits) of keys that occur in more than one split."""
    return df.groupBy(key.alias("key")).agg(F.array_sort(F.collect_set(split)).alias("splits")).filter(F.size("splits") > 1)


def require_disjoint(df: DataFrame, key: Column, split: str) -> DataFrame:
    found = overlap_groups(df, key, split).limit(3).collect()
    if found:
        raise ValueError(f"keys cross splits: {[r['key'] for r in found]}")
    return df


def leakage(train: DataFrame, held_out: DataFrame, source: str, target: str, form: str | None = "NFC") -> DataFrame:
    """One row: distinct input, target and pair overlaps; unsafe if inputs or pairs overlap.

    Every row is normalised once and gives three digests; one aggregate finds
    those that both sides have.
    """
    def keys(df: DataFrame, side: int) -> DataFrame:
        s, t = T.pair_key(F.col(source), form), T.pair_key(F.col(target), form)
        made = df.select(F.struct(s.alias("s"), t.alias("t")).alias("k"))
        each = F.array(*[F.struct(F.lit(n).alias("measure"), order.key_digest(*c).alias("digest")) for n, c in (
            ("input_overlap", [F.col("k.s")]), ("target_overlap", [F.col("k.t")]), ("pair_overlap", [F.col("k.s"), F.col("k.t")]))])
        return made.select(F.explode(each).alias("x")).select("x.*", F.lit(side).alias("side"))

    both = keys(train, 1).unionByName(keys(held_out, 2)).groupBy("measure", "digest").agg(F.bit_or("side").alias("sides")).filter("sides = 3")
    names = ["input_overlap", "target_overlap", "pair_overlap"]
    wide = both.agg(*[F.count_if(F.col("measure") == n).alias(n) for n in names])
    return wide.withColumn("safe", (F.col("input_overlap") == 0) & (F.col("pair_overlap") == 0))


def require_no_leakage(train: DataFrame, held_out: DataFrame, source: str, target: str) -> None:
    row = leakage(train, held_out, source, target).first()
    if not row["safe"]:
        raise ValueError(f"held-out leakage: {row.asDict()}")


def reject_reasons(*rules: tuple[str, Column]) -> Column:
    """Array of the names of all rules that hold; empty means accepted."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))


def first_reason(*rules: tuple[str, Column], otherwise: str = "accepted") -> Column:
    """Name of the first rule that holds."""
    out = F.lit(otherwise)
    for name, c in reversed(rules):
        out = F.when(c, F.lit(name)).otherwise(out)
    return out


def anti_keys(df: DataFrame, forbidden: DataFrame, keys: list[tuple[Column, str]]) -> DataFrame:
    """Rows of ``df`` none of whose keys is forbidden: one anti join a key, so
    each stays an equi join (an OR of keys would be a nested loop)."""
    out = df
    for column, name in keys:
        listed = forbidden.filter(F.col(name).isNotNull()).select(order.key_digest(F.col(name)).alias("_k")).distinct()
        out = out.withColumn("_k", F.when(column.isNotNull(), order.key_digest(column))).join(listed, "_k", "left_anti").drop("_k")
    return out


def flag_overlaps(df: DataFrame, others: dict[str, tuple[Column, DataFrame]]) -> DataFrame:
    """A boolean a named key table; rows are never lost."""
    out = df
    for name, (column, table) in others.items():
        name_of = table.columns[0]
        digest = (lambda c: F.when(c.isNotNull(), order.key_digest(c))) if dict(table.dtypes)[name_of] == "string" else (lambda c: c)
        keys = table.select(digest(F.col(name_of)).alias("_k")).distinct().withColumn("_in", F.lit(True))
        out = out.withColumn("_k", digest(column)).join(keys, "_k", "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_k", "_in")
    return out


def reconcile(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, issue): orphan, missing or changed rows between two versions."""
    a = before.select(F.col(key).alias("_a"), F.struct(*fields).alias("_av"))
    b = after.select(F.col(key).alias("_b"), F.struct(*fields).alias("_bv"))
    joined = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    issue = F.when(F.col("_b").isNull(), "orphan").when(F.col("_a").isNull(), "missing").when(~F.col("_av").eqNullSafe(F.col("_bv")), "changed")
    return joined.select(F.coalesce("_a", "_b").alias(key), issue.alias("issue")).filter("issue is not null")


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side's name."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled, rows, share) in one pass."""
    row = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "").alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    out = row.selectExpr("_rows as rows", f"stack({len(columns)}, {pairs}) as (column, filled)")
    return out.select("column", "filled", "rows", F.when(F.col("rows") == 0, F.lit(0.0)).otherwise(F.col("filled") / F.col("rows")).alias("share"))


def audit_lines(lines: DataFrame, column: str = "value", mojibake: tuple[str, ...] = ("Ã", "â€", "Â ", "ï»¿", "�")) -> DataFrame:
    """(line, issues): mojibake stretches and control characters."""
    v = F.col(column)
    found = reject_reasons(*[(f"mojibake:{m}", F.contains(v, F.lit(m))) for m in mojibake], ("control_character", v.rlike("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]")))
    return lines.withColumn("issues", found).filter(F.size("issues") > 0)


def readiness(df: DataFrame, group: str, min_rows: int = 200, min_groups: int = 5) -> DataFrame:
    """One row with all problems of a data set, not only the first."""
    counted = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(group).alias("groups"))
    return counted.withColumn("problems", reject_reasons(
        ("too_few_rows", F.col("rows") < min_rows), ("too_few_groups", F.col("groups") < min_groups)))


def funnel(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """(stage, rows): rows left after each condition, all in one aggregate."""
    conditions, left = [], F.lit(True)
    for name, c in stages:
        left = left & F.coalesce(c, F.lit(False))
        conditions.append(F.count_if(left).alias(name))
    row = df.agg(F.count(F.lit(1)).alias("input"), *conditions)
    names = ["input", *[n for n, _ in stages]]
    pairs = ", ".join(f"{i}, '{n}', `{n}`" for i, n in enumerate(names))
    return row.selectExpr(f"stack({len(names)}, {pairs}) as (step, stage, rows)")


def audit_files(spark, folder: str, suffixes: tuple[str, ...] = (".py", ".md", ".txt", ".csv", ".json"), skip: str = "/(\\.git|__pycache__|node_modules)/") -> DataFrame:
    """(path, line, issues) over all text files below a folder: invalid UTF-8, mojibake, control characters."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")
    files = files.filter(F.col("path").rlike("(" + "|".join(s.replace(".", "\\.") for s in suffixes) + ")$") & ~F.col("path").rlike(skip))
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.make_valid_utf8(F.col("content").cast("string")))
    broken = ~F.is_valid_utf8(F.col("content").cast("string"))
    whole = files.filter(broken).select("path", F.lit(0).alias("line"), F.array(F.lit("invalid_utf8")).alias("issues"))
    lines = files.select("path", F.posexplode(F.split(text, "\n")).alias("line", "value"))
    return whole.unionByName(audit_lines(lines).select("path", (F.col("line") + 1).alias("line"), "issues"))
