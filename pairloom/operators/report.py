"""Report tables: label counts, diagnostics, confusion, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def label_counts(df: DataFrame, labels: Column) -> DataFrame:
    """Rows a label, each label once a row, with its share of all rows."""
    total = df.count()
    counted = df.select(F.explode(F.array_distinct(labels)).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    return counted.withColumn("share", _ratio(F.col("rows"), F.lit(total)))


def categorical_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, rows) of several fields in one pass."""
    pairs = ", ".join(f"'{f}', cast(`{f}` as string)" for f in fields)
    long = df.selectExpr(f"stack({len(fields)}, {pairs}) as (field, value)")
    return long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("rows"))


def measure_summary(df: DataFrame, by: list[str], measures: list[str]) -> DataFrame:
    """(by, measure, total, mean, rows_above_zero, percent) unpivoted."""
    pairs = ", ".join(f"'{m}', cast(`{m}` as double)" for m in measures)
    keys = ", ".join(f"`{b}`" for b in by)
    long = df.selectExpr(keys, f"stack({len(measures)}, {pairs}) as (measure, value)")
    out = long.groupBy(*by, "measure").agg(
        F.sum("value").alias("total"), F.avg("value").alias("mean"), F.count_if(F.col("value") > 0).alias("rows_above_zero"), F.count(F.lit(1)).alias("_n"))
    return out.withColumn("percent", 100.0 * F.col("rows_above_zero") / F.col("_n")).drop("_n")


def prediction_diagnostics(df: DataFrame, by: list[str], prediction: str, cer: str, identity_cer: str) -> DataFrame:
    """Empties, distinct predictions, comparison with the identity, and the median error."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.trim(F.coalesce(F.col(prediction), F.lit(""))) == "").alias("empty"),
        F.count_distinct(prediction).alias("distinct_predictions"),
        F.count_if(F.col(cer) < F.col(identity_cer)).alias("better"), F.count_if(F.col(cer) == F.col(identity_cer)).alias("equal"),
        F.count_if(F.col(cer) > F.col(identity_cer)).alias("worse"), F.percentile(cer, 0.5).alias("median_cer"))


def dominant_token_share(df: DataFrame, by: list[str], words: Column) -> DataFrame:
    counted = df.select(*by, F.explode(words).alias("token")).groupBy(*by, "token").count()
    return counted.groupBy(*by).agg((F.max("count") / F.sum("count")).alias("dominant_share"))


def over_seeds(df: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Mean, number, and deviation (null for one seed) of each metric."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), *[x for m in metrics for x in (
        F.avg(m).alias(f"{m}_mean"), F.when(F.count(F.lit(1)) > 1, F.stddev_samp(m)).alias(f"{m}_std"))])


def confusion(df: DataFrame, truth: str, guess: str, labels: list[str]) -> DataFrame:
    """One row a true label in the given order; absent labels are zero rows."""
    wide = df.groupBy(F.col(truth).alias("label")).pivot(guess, labels).agg(F.count(F.lit(1)))
    order = df.sparkSession.createDataFrame(list(enumerate(labels)), "position int, label string")
    return order.join(wide, "label", "left").na.fill(0, labels).select("position", "label", *labels)


def per_class(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(label, support, precision, recall, f1): each row counts for its two labels."""
    both = df.select(F.explode(F.array(
        F.struct(F.col(truth).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("g"), (F.col(truth) == F.col(guess)).cast("int").alias("hit")),
        F.struct(F.col(guess).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("g"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    out = both.groupBy("label").agg(F.sum("t").alias("support"), F.sum("g").alias("_g"), F.sum("hit").alias("_h"))
    p, r = _ratio(F.col("_h"), F.col("_g")), _ratio(F.col("_h"), F.col("support"))
    return out.select("label", "support", p.alias("precision"), r.alias("recall"), _ratio(2 * p * r, p + r).alias("f1"))


def confidence_summary(df: DataFrame, correct: Column, confidence: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.when(correct, F.col(confidence))).alias("mean_correct"), F.avg(F.when(~correct, F.col(confidence))).alias("mean_incorrect"))


def mode_by(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Most frequent non-empty value; ties give the smallest."""
    return df.filter(F.trim(F.coalesce(F.col(column), F.lit(""))) != "").groupBy(*by).agg(F.mode(column, True).alias(column))


def best_by(df: DataFrame, by: list[str], metric: str, order: str) -> DataFrame:
    """Row with the least metric of each group; ties: the first in ``order``."""
    row = F.min_by(F.struct(*df.columns), F.struct(metric, order)).alias("_r")
    return df.groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(row).select("_r.*")


def group_all(df: DataFrame, by: list[str], flag: str) -> DataFrame:
    return df.groupBy(*by).agg(F.every(flag).alias(flag))


def inverse_sqrt_weights(df: DataFrame, label: str, low: float = 0.25, high: float = 4.0) -> DataFrame:
    """Bounded class weights, 1 / sqrt(share), scaled to mean one over the rows."""
    counted = df.groupBy(label).count()
    total = counted.agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("k")).first()
    raw = F.sqrt(F.lit(float(total["n"] or 1)) / (F.col("count") * F.lit(float(max(1, total["k"])))))
    return counted.withColumn("weight", F.least(F.lit(high), F.greatest(F.lit(low), raw)))


def domain_weights(df: DataFrame, is_formal: Column, formal_share: float) -> DataFrame:
    """``df`` plus the sampling weight that gives formal rows ``formal_share`` of the draws."""
    n = df.agg(F.count_if(is_formal).alias("f"), F.count_if(~is_formal).alias("i")).first()
    return df.withColumn("sampling_weight", F.when(is_formal, F.lit(formal_share / max(1, n["f"]))).otherwise(F.lit((1 - formal_share) / max(1, n["i"]))))


def side_by_side(df: DataFrame, key: list[str], condition: str, values: list[str], column: str) -> DataFrame:
    """One column a condition: a single pivot in place of a chain of joins."""
    return df.groupBy(*key).pivot(condition, values).agg(F.first(column))


def corpus_summary(df: DataFrame, by: list[str], document: str, text: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(document).alias("documents"), F.sum(F.length(text)).alias("characters"))


def shares(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, rows, share of the group)."""
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("rows"))
    return counted.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy(*by)))
