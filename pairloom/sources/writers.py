"""Writers: data, review samples and manifests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import order


def row_digest(*columns: str):
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def table_digest(df: DataFrame, columns: list[str] | None = None) -> dict:
    """Rows and an order-free fingerprint from one aggregate, whatever the partitioning."""
    columns = sorted(columns or df.columns)
    words = [F.conv(F.substring(row_digest(*columns), 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(4)]
    row = df.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(w).alias(f"w{i}") for i, w in enumerate(words)]).first()
    return {"rows": row["rows"], "digest": "-".join(str(row[f"w{i}"] or 0) for i in range(4))}


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """A small driver-side file through Hadoop's file system, so any store works."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(content.encode("utf-8")))
    out.close()


def write_dataset(df: DataFrame, folder: str, config: dict | None = None, kind: str = "parquet", overwrite: bool = False, partition: str | None = None,
                  review: tuple[str, int] | None = None, review_by: list[str] | None = None) -> dict:
    """Data, an optional keyed review sample, and ``manifest.json``.

    Refuses to overwrite unless told to.  Counts and digest come from the
    written table, so the plan runs once.
    """
    spark = df.sparkSession
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    writer = writer.partitionBy(partition) if partition else writer
    (writer.option("header", True).csv if kind == "csv" else writer.parquet)(f"{folder}/data")
    written = spark.read.parquet(f"{folder}/data") if kind == "parquet" else spark.read.schema(df.schema).option("header", True).csv(f"{folder}/data")
    manifest = {"config": config or {}, "columns": df.columns, **table_digest(written)}
    if review:
        key, n = review
        sample = order.sample_per_group(written, review_by, key, n) if review_by else order.sample_rows(written, key, n)
        sample.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{folder}/review")
    write_text(spark, f"{folder}/manifest.json", json.dumps(manifest, indent=2, sort_keys=True, default=str))
    return manifest


def write_bundle(tables: dict[str, DataFrame], folder: str, config: dict | None = None, reviews: dict[str, tuple[str, int]] | None = None, overwrite: bool = False) -> dict:
    """Several tables below one folder and one manifest with the rows and digest of each.

    ``reviews``: table -> (key, rows) of a keyed sample, written as ``table_review``.
    A failed run leaves no manifest, so what has one is whole.
    """
    spark = next(iter(tables.values())).sparkSession
    mode = "overwrite" if overwrite else "errorifexists"
    out = {}
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{folder}/{name}")
        written = spark.read.parquet(f"{folder}/{name}")
        out[name] = {"columns": df.columns, **table_digest(written)}
        if name in (reviews or {}):
            key, n = reviews[name]
            order.sample_rows(written, key, n).write.mode(mode).parquet(f"{folder}/{name}_review")
    manifest = {"config": config or {}, "tables": out}
    write_text(spark, f"{folder}/manifest.json", json.dumps(manifest, indent=2, sort_keys=True, default=str))
    return manifest


def archive(tables: dict[str, DataFrame], folder: str, label: str) -> dict:
    """Copies of tables before they change, below ``folder/label``, with their digests;
    an archive that exists is never written over."""
    return write_bundle(tables, f"{folder}/{label}", {"archive": label})


def recover_table(spark: SparkSession, path: str) -> bool:
    """After a crash between the two renames of ``replace_table``: put the new version,
    else the old one, at ``path``.  True if there was something to mend."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hadoop(path)):
        return False
    for spare in (f"{path}.new", f"{path}.old"):
        if fs.exists(hadoop(f"{spare}/_SUCCESS")):
            return bool(fs.rename(hadoop(spare), hadoop(path)))
    return False


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside the table, then swap by two renames; the old version stays as ``.old``."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}.new")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(hadoop(f"{path}.old"), True)
    if fs.exists(hadoop(path)):
        fs.rename(hadoop(path), hadoop(f"{path}.old"))
    fs.rename(hadoop(f"{path}.new"), hadoop(path))


def write_audited(df: DataFrame, folder: str, overwrite: bool = False) -> dict:
    """Accepted and rejected rows of an audited table, in one partitioned write."""
    return write_dataset(df, folder, partition="accepted", overwrite=overwrite)


def markdown(df: DataFrame, rows: int = 1000, digits: int = 4) -> str:
    """A small result table as Markdown, numbers with fixed digits."""
    cells = [[f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v) for v in r] for r in df.limit(rows).collect()]
    lines = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join([*lines, *("| " + " | ".join(c) + " |" for c in cells)]) + "\n"


def config_fingerprint(config: dict) -> str:
    """The same for equal settings, whatever their order."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode("utf-8")).hexdigest()


def lock_selection(spark: SparkSession, path: str, selection: dict) -> dict:
    """Write a selection once; a later call must bring the same one."""
    from .readers import _exists, read_manifest

    locked = {"selection": selection, "fingerprint": config_fingerprint(selection)}
    if _exists(spark, path):
        found = read_manifest(spark, path)
        if found["fingerprint"] != locked["fingerprint"]:
            raise ValueError("another selection is locked already")
        return found
    write_text(spark, path, json.dumps(locked, sort_keys=True))
    return locked
