"""Readers with explicit schemas, and checks at the boundary."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, generate, order


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def load_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """By extension: csv, tsv, json, jsonl, parquet, txt.  Text files give ``value``."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind in ("csv", "tsv"):
        return reader.option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("multiLine", True).option("escape", '"').csv(path)
    if kind in ("json", "jsonl"):
        return reader.json(path)
    if kind == "parquet":
        return reader.parquet(path)
    if kind == "txt":
        return spark.read.text(path)
    raise ValueError(f"unknown file type: {path}")


def load_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An empty table of the schema where the file is absent."""
    return load_table(spark, path, schema) if _exists(spark, path) else spark.createDataFrame([], schema)


def load_columns(spark: SparkSession, path: str, columns: list[str], schema: str | None = None) -> DataFrame:
    """Only some columns; the scan is pruned."""
    return audit.require_columns(load_table(spark, path, schema), columns).select(*columns)


def load_word_list(spark: SparkSession, path: str, column: str) -> DataFrame:
    words = load_columns(spark, path, [column]).select(F.lower(F.trim(column)).alias("word"))
    return words.filter("word <> ''").distinct()


def load_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''")


def load_splits(spark: SparkSession, folder: str, names: tuple[str, ...] = ("train", "dev", "test"), kind: str = "csv") -> DataFrame:
    """Union of one file a split, with ``gold_split``; ids must not repeat."""
    parts = [load_table(spark, f"{folder}/{n}.{kind}").withColumn("gold_split", F.lit(n)) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def locked_gold(spark: SparkSession, folder: str, key: str, group: str, names: tuple[str, ...] = ("train", "dev", "test")) -> DataFrame:
    """Splits behind a manifest, checked for repeated ids and groups that cross splits."""
    if not _exists(spark, f"{folder}/manifest.json"):
        raise FileNotFoundError(f"{folder}/manifest.json")
    out = load_splits(spark, folder, names)
    audit.require_unique(out, [key], "ids")
    return audit.require_disjoint(out, F.col(group), "gold_split")


def gold_pairs(df: DataFrame, split: str, index: str, source: str, target: str) -> DataFrame:
    """Training pairs of a gold split: blanks collapsed, ids ``gold:split:index``."""
    return df.select(
        F.concat_ws(":", F.lit("gold"), F.lit(split), F.col(index).cast("string")).alias("source_id"), F.lit("gold").alias("method"),
        T.collapse(F.col(source)).alias("source_text"), T.collapse(F.col(target)).alias("target_text"), F.lit("gold").alias("source_type"))


def synthetic_pairs(df: DataFrame, manifest: dict, max_rows: int | None = None, seed: int = 2026, allow_provisional: bool = False) -> DataFrame:
    """Generated pairs as training pairs, gated by their manifest."""
    if (manifest.get("provisional") or manifest.get("pending")) and not allow_provisional:
        raise ValueError("the manifest is provisional")
    audit.require_columns(df, ["source_id", "method", "informal", "formal"])
    audit.require_unique(df, ["source_id"], "source ids")
    out = df.filter("trim(informal) <> '' and trim(formal) <> ''").select(
        "source_id", "method", F.col("informal").alias("source_text"), F.col("formal").alias("target_text"), F.lit("synthetic").alias("source_type"))
    return out if max_rows is None else order.sample_rows(out, "source_id", max_rows, seed)


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def checkpoint_labels(spark: SparkSession, glob: str) -> DataFrame:
    """(index, label) of map-shaped JSON batches; the last file by name wins."""
    raw = spark.read.text(glob, wholetext=True).select(F.input_file_name().alias("_f"), F.explode(F.from_json("value", "map<string,boolean>")).alias("index", "label"))
    return order.keep_last(raw.withColumn("index", F.col("index").cast("long")), ["index"], ["_f"]).select("index", "label").orderBy("index")


formal_sources = generate.formal_sources


def labelled_comments(comments: DataFrame, labels: DataFrame) -> DataFrame:
    """Comments whose label is true, one to one by source_index, in round-robin order."""
    flag = T.strict_boolean(F.col("label"))
    latest = labels.select("source_index", flag.alias("_l"))
    return audit.one_to_one(comments, latest, ["source_index"]).filter("_l").drop("_l")
